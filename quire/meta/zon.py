"""ZON object notation: ``.{ .key = value }`` structs, ``.{ a, b }`` tuples, scalars and comments."""

from __future__ import annotations

import re

_SPACE = re.compile(r"(?:[ \t\r\n]|//[^\n]*)*")
_FIELD = re.compile(r"\.([A-Za-z0-9_]+|@\"(?:\\.|[^\"\\])*\")(?:[ \t\r\n]|//[^\n]*)*=")
_NAME = re.compile(r"\.([A-Za-z0-9_]+)")
_NUMBER = re.compile(r"-?(?:0[xX][0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.\d*)?(?:[eE][+-]?\d+)?)")
_STRING = re.compile(r"\"((?:\\.|[^\"\\\n])*)\"")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u\{([0-9a-fA-F]+)\}|(.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


class ZonError(ValueError):
    pass


def _unescape(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16))
    if m[2]:
        code = int(m[2], 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            raise ZonError("bad code point")
        return chr(code)
    if m[3] not in _SIMPLE:
        raise ZonError(f"bad escape {m[3]}")
    return _SIMPLE[m[3]]


class _Reader:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def space(self) -> str:
        self.i = _SPACE.match(self.s, self.i).end()
        return self.s[self.i : self.i + 1]

    def value(self, depth: int = 0):
        if depth > 200:
            raise ZonError("too deep")
        c = self.space()
        if c == ".":
            if self.s[self.i + 1 : self.i + 2] == "{":
                self.i += 2
                return self.body(depth)
            m = _NAME.match(self.s, self.i)
            if m:
                self.i = m.end()
                return m[1]  # an enum literal is its name
        elif c == '"':
            m = _STRING.match(self.s, self.i)
            if m:
                self.i = m.end()
                return _ESCAPE.sub(_unescape, m[1])
        elif c == "\\":
            lines = []
            while self.s.startswith("\\\\", self.i):
                end = self.s.find("\n", self.i)
                end = len(self.s) if end < 0 else end
                lines.append(self.s[self.i + 2 : end].rstrip("\r"))
                self.i = end
                self.space()
            if lines:
                return "\n".join(lines) + "\n"
        elif c == "-" or c.isdigit():
            m = _NUMBER.match(self.s, self.i)
            if m:
                self.i = m.end()
                raw = m[0].replace("_", "")
                digits = raw.lstrip("-")[:2].lower()
                if digits in ("0x", "0o", "0b"):
                    return int(raw, 0)
                return float(raw) if any(x in raw for x in ".eE") else int(raw)
        else:
            for word, value in (("true", True), ("false", False), ("null", None)):
                if self.s.startswith(word, self.i):
                    self.i += len(word)
                    return value
        raise ZonError(f"unexpected at {self.i}")

    def body(self, depth: int):
        if self.space() == "}":
            self.i += 1
            return {}
        out = {} if _FIELD.match(self.s, self.i) else []
        while self.space() != "}":
            if isinstance(out, dict):
                m = _FIELD.match(self.s, self.i)
                if not m:
                    raise ZonError(f"expected a field at {self.i}")
                self.i = m.end()
                name = m[1]
                out[_ESCAPE.sub(_unescape, name[2:-1]) if name[0] == "@" else name] = self.value(depth + 1)
            else:
                out.append(self.value(depth + 1))
            if self.space() == ",":
                self.i += 1
            elif self.s[self.i : self.i + 1] != "}":
                raise ZonError(f"expected , or }} at {self.i}")
        self.i += 1
        return out


def loads(text: str):
    r = _Reader(text)
    return r.value()
