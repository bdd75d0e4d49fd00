"""Paths and values of frontmatter trees (dicts keep their order)."""

from __future__ import annotations

import math
import re

I64 = 1 << 63
_INT = re.compile(r"[+-]?\d+(?:_\d+)*$")
_FLOAT = re.compile(r"[+-]?(?:\d+(?:_\d+)*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|[+-]?(?:inf|infinity|nan)$", re.I)


class FieldError(ValueError):
    """A path or assignment that cannot be applied."""


def number(raw: str):
    """An integer of 64 bits or a float, or None if the text is neither."""
    if _INT.match(raw):
        value = int(raw)
        return value if -I64 <= value < I64 else float(value)
    if _FLOAT.match(raw):
        value = float(raw.replace("_", ""))
        return value if math.isfinite(value) else None
    return None


def infer(raw: str):
    """The value of a command-line text: true, false, null, a number, else the text itself."""
    words = {"true": True, "false": False, "null": None}
    if raw in words:
        return words[raw]
    value = number(raw)
    return raw if value is None else value


def field_arg(arg: str) -> tuple[str, object]:
    """``path=value`` as (path, inferred value)."""
    path, eq, raw = arg.partition("=")
    if not eq or not path:
        raise FieldError(f"expected path=value: {arg}")
    return path, infer(raw)


def segments(path: str) -> list[str]:
    """The keys of a dotted path; repeated dots count once, so a key with a dot cannot be named."""
    return [s for s in path.split(".") if s]


MISSING = object()


def find(root, path: str):
    """The value at a path, MISSING if there is none. Only objects are entered, lists never. The
    empty path finds nothing; a path of dots alone is the root itself."""
    if not path:
        return MISSING
    for key in segments(path):
        if not isinstance(root, dict) or key not in root:
            return MISSING
        root = root[key]
    return root


def assign(root, path: str, value) -> None:
    """Sets a path in place, making the objects on the way; raises FieldError where a scalar or list is in the way."""
    keys = segments(path)
    if not keys:
        raise FieldError("empty path")
    for key in keys[:-1]:
        if not isinstance(root, dict):
            raise FieldError("not an object")
        root = root.setdefault(key, {})
    if not isinstance(root, dict):
        raise FieldError("not an object")
    root[keys[-1]] = value


def remove(root, path: str) -> bool:
    """Deletes a path in place, keeping the order of the rest; tells whether it was there."""
    keys = segments(path)
    if not keys:
        return False
    holder = find(root, ".".join(keys[:-1])) if len(keys) > 1 else root
    if not isinstance(holder, dict) or keys[-1] not in holder:
        return False
    del holder[keys[-1]]
    return True


def merged(base, overlay):
    """A deep merge: objects key by key, anything else (lists too) replaced by the overlay's value."""
    if isinstance(base, dict) and isinstance(overlay, dict):
        out = dict(base)
        for key, value in overlay.items():
            out[key] = merged(out[key], value) if key in out else value
        return out
    return overlay


def as_text(value) -> str | None:
    """A scalar as filters compare it: decimal numbers without exponent, 1.0 as 1; None for objects and lists."""
    if isinstance(value, (dict, list)):
        return None
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, float):
        return decimal(value)
    return str(value)


def decimal(value: float) -> str:
    """The shortest decimal spelling of a float without an exponent."""
    text = repr(value)
    if "e" in text or "E" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text[:-2] if text.endswith(".0") else text


def matches(value, expected: str) -> bool:
    """Equality of a filter: scalars by their text, lists if any item matches, at any depth."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack.extend(v)
        elif not isinstance(v, dict) and as_text(v) == expected:
            return True
    return False
