"""Frontmatter of one document: sniff, read, query, edit, serialize."""

from __future__ import annotations

import json
import tomllib

from quire.meta import emit, values, yaml, zon

KINDS = ("yaml", "toml", "json", "zon")


class FrontMatterError(ValueError):
    """There is frontmatter, and it cannot be read."""


def brace_end(text: str) -> int | None:
    """The end of the object that begins with the text's first brace; braces in strings do not count."""
    depth, i, string = 0, 0, False
    while i < len(text):
        c = text[i]
        if string:
            if c == "\\":
                i += 1
            elif c == '"':
                string = False
        elif c == '"':
            string = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return None


def locate(text: str, sniff: str = "strict") -> tuple[str, str, int] | None:
    """(kind, source without delimiters, offset of the body), or None without frontmatter.

    ``strict`` wants the full three-character opener; ``loose`` takes any text that begins with ``-``
    or ``+``, so a bullet list can be mistaken. The closer is the first delimiter after the opener,
    even inside a line. One line feed after it belongs to the frontmatter.
    """
    if len(text) < 3:
        return None
    if text[0] == "{" or text.startswith(".{"):
        lead = 0 if text[0] == "{" else 1
        end = brace_end(text[lead:])
        if end is None:
            return None
        end += lead
        return ("zon" if lead else "json"), text[:end], end + (text[end : end + 1] == "\n")
    kind = {"-": "yaml", "+": "toml"}.get(text[0])
    if kind is None or (sniff == "strict" and text[:3] != text[0] * 3):
        return None
    close = text.find(text[0] * 3, 3)
    if close < 0:
        return None
    end = close + 3
    return kind, text[3:close], end + (text[end : end + 1] == "\n")


def body_offset(text: str, sniff: str = "strict") -> int | None:
    """Where the body begins; None without frontmatter."""
    found = locate(text, sniff)
    return found[2] if found else None


def _no_constant(name: str):
    raise ValueError(name)


def _plain(v):
    """TOML's own types as text; the tree holds JSON values only."""
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return v if v - v == 0 else str(v)
    return v.isoformat()


class FrontMatter:
    """A tree of JSON values with the source it came from and the format it goes back to."""

    def __init__(self, source: str, kind: str):
        if kind not in KINDS:
            raise FrontMatterError(f"unknown format {kind}")
        self.source, self.kind = source, kind
        try:
            if kind == "yaml":
                self.root = yaml.loads(source)
            elif kind == "toml":
                self.root = _plain(tomllib.loads(source.replace("\r\n", "\n")))
            elif kind == "json":
                self.root = json.loads(source, parse_constant=_no_constant)
            else:
                self.root = zon.loads(source)
        except (ValueError, RecursionError) as e:
            raise FrontMatterError(f"{kind}: {e or type(e).__name__}") from None

    @classmethod
    def of(cls, root, kind: str) -> FrontMatter:
        fm = cls.__new__(cls)
        fm.root, fm.kind, fm.source = root, kind, ""
        return fm

    @classmethod
    def from_markdown(cls, text: str, sniff: str = "strict") -> FrontMatter:
        found = locate(text, sniff)
        if not found:
            raise FrontMatterError("no frontmatter")
        return cls(found[1], found[0])

    def get(self, path: str):
        """The value at a path, or None; use ``has`` to tell a null from nothing."""
        value = values.find(self.root, path)
        return None if value is values.MISSING else value

    def has(self, path: str) -> bool:
        return values.find(self.root, path) is not values.MISSING

    def set(self, path: str, value) -> None:
        values.assign(self.root, path, value)

    def set_raw(self, path: str, raw: str) -> None:
        self.set(path, values.infer(raw))

    def delete(self, path: str) -> bool:
        return values.remove(self.root, path)

    def merge(self, overlay: FrontMatter) -> None:
        self.root = values.merged(self.root, overlay.root)

    def to_json(self, pretty: bool = True) -> str:
        return emit.to_json(self.root, pretty)

    def serialize(self) -> str:
        """The frontmatter with its delimiters, in its own format."""
        if self.kind == "yaml":
            return f"---\n{emit.to_yaml(self.root)}---\n"
        if self.kind == "toml":
            return f"+++\n{emit.to_toml(self.root)}+++\n"
        return (emit.to_json(self.root) if self.kind == "json" else emit.to_zon(self.root)) + "\n"

    def to_markdown(self, body: str) -> str:
        """Frontmatter and body, with a line feed between them unless the body brings one or is empty."""
        return self.serialize() + ("" if not body or body.startswith("\n") else "\n") + body
