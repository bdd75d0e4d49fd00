"""Frontmatter trees as YAML, TOML, JSON and ZON text; what is written reads back as the same tree."""

from __future__ import annotations

import json
import re

from quire.meta.values import decimal, number

# Words that other YAML readers take for something else than text.
YAML_WORDS = ("true", "false", "null", "yes", "no", "on", "off", "~")
_YAML_FIRST = set("{}[],#&*?|<>=!%@`:\"'\\")
_BARE = re.compile(r"[A-Za-z0-9_-]+$")
_IDENT = re.compile(r"[A-Za-z0-9_]+$")


def _num(value) -> str:
    if isinstance(value, float):
        text = decimal(value)
        return text if "." in text else text + ".0"  # a float stays a float
    return str(value)


def _quoted(s: str) -> str:
    out = s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{out}"'


def yaml_needs_quote(s: str) -> bool:
    if not s or s.lower() in YAML_WORDS or s[0] in _YAML_FIRST or s != s.strip() or s[-1] == ":":
        return True
    if s[0] == "-" and (len(s) == 1 or s[1] in " -"):
        return True
    return any(x in s for x in ("\n", "\r", "\t", ": ", " #")) or number(s) is not None


def _yaml_scalar(v) -> str:
    if v is None:
        return ""  # the empty scalar is null; the word would be read as text
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return _quoted(v) if yaml_needs_quote(v) else v
    if isinstance(v, dict):
        return "{}"
    return "[]" if isinstance(v, list) else _num(v)


def _yaml(v, indent: int, out: list[str]) -> None:
    pad = "  " * indent
    if isinstance(v, dict):
        for key, x in v.items():
            name = _quoted(key) if yaml_needs_quote(key) or ":" in key else key
            if isinstance(x, (dict, list)) and x:
                out.append(f"{pad}{name}:\n")
                _yaml(x, indent + 1, out)
            else:
                out.append(f"{pad}{name}: {_yaml_scalar(x)}".rstrip() + "\n")
    else:
        for x in v:
            if isinstance(x, (dict, list)) and x:
                out.append(f"{pad}-\n")
                _yaml(x, indent + 1, out)
            else:
                out.append(f"{pad}- {_yaml_scalar(x)}".rstrip() + "\n")


def to_yaml(root) -> str:
    if not isinstance(root, (dict, list)) or not root:
        return _yaml_scalar(root) + "\n"
    out: list[str] = []
    _yaml(root, 0, out)
    return "".join(out)


def _toml_key(key: str) -> str:
    return key if _BARE.match(key) else _quoted(key)


def _toml_inline(v) -> str:
    if v is None:
        return '""'  # TOML has no null
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return _quoted(v)
    if isinstance(v, list):
        return "[" + ", ".join(_toml_inline(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_inline(x)}" for k, x in v.items()) + "}"
    return _num(v)


def _is_tables(v) -> bool:
    return isinstance(v, list) and bool(v) and all(isinstance(x, dict) for x in v)


def _toml(obj: dict, prefix: str, out: list[str]) -> None:
    for key, v in obj.items():
        if not isinstance(v, dict) and not _is_tables(v):
            out.append(f"{_toml_key(key)} = {_toml_inline(v)}\n")
    for key, v in obj.items():
        name = f"{prefix}.{_toml_key(key)}" if prefix else _toml_key(key)
        if isinstance(v, dict):
            out.append(f"\n[{name}]\n")
            _toml(v, name, out)
        elif _is_tables(v):
            for item in v:
                out.append(f"\n[[{name}]]\n")
                _toml(item, name, out)


def to_toml(root) -> str:
    out: list[str] = []
    if isinstance(root, dict):
        _toml(root, "", out)
    return "".join(out)


def _zon(v, indent: int) -> str:
    pad = "  " * (indent + 1)
    if isinstance(v, dict):
        body = "".join(f"{pad}.{k if _IDENT.match(k) else '@' + _quoted(k)} = {_zon(x, indent + 1)},\n" for k, x in v.items())
        return ".{\n" + body + "  " * indent + "}"
    if isinstance(v, list):
        return ".{\n" + "".join(f"{pad}{_zon(x, indent + 1)},\n" for x in v) + "  " * indent + "}"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return _quoted(v) if isinstance(v, str) else _num(v)


def to_zon(root) -> str:
    return _zon(root, 0)


def to_json(root, pretty: bool = True) -> str:
    return json.dumps(root, ensure_ascii=False, indent=2 if pretty else None)
