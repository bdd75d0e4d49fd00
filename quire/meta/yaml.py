"""The YAML that frontmatter uses: block and flow collections, plain, quoted and block scalars.

Plain scalars are null if empty, else an integer, else a float, else a string: ``true`` and ``null``
are strings. Quoted scalars are strings always. Anchors, aliases, tags and several documents are errors.
"""

from __future__ import annotations

import re

from quire.meta.values import number

_KEY = re.compile(r"(\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|[^\s\"'\[\]{},#&*!|>%@`-][^#\n]*?|-[^\s#][^#\n]*?|[^\s\"'\[\]{},&*!|>%@`-][^\n]*?)[ \t]*:(?=[ \t]|$)")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "/": "/", '"': '"', "\\": "\\", " ": " ", "_": "\xa0", "N": "\x85"}
_COMMENT = re.compile(r"(?:^|[ \t])#.*$")


class YamlError(ValueError):
    pass


def _double(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c != "\\":
            out.append(c)
            i += 1
            continue
        e = s[i + 1 : i + 2]
        width = {"x": 2, "u": 4, "U": 8}.get(e)
        if width:
            try:
                out.append(chr(int(s[i + 2 : i + 2 + width], 16)))
            except (ValueError, OverflowError):
                raise YamlError("bad escape") from None
            i += 2 + width
        elif e in _ESCAPES:
            out.append(_ESCAPES[e])
            i += 2
        else:
            raise YamlError(f"bad escape \\{e}")
    return "".join(out)


def plain(raw: str):
    if raw == "":
        return None
    if raw[0] in "&*!%@`":
        raise YamlError(f"unsupported: {raw[:20]}")
    value = number(raw)
    return raw if value is None else value


class _Flow:
    """Flow collections and scalars inside them."""

    def __init__(self, s: str):
        self.s, self.i = s, 0

    def space(self):
        while self.i < len(self.s) and self.s[self.i] in " \t\n":
            self.i += 1

    def value(self, depth=0):
        if depth > 200:
            raise YamlError("too deep")
        self.space()
        c = self.s[self.i : self.i + 1]
        if c == "[":
            self.i += 1
            out = []
            while True:
                self.space()
                if self.s[self.i : self.i + 1] == "]":
                    self.i += 1
                    return out
                item = self.value(depth + 1)
                self.space()
                if self.s[self.i : self.i + 1] == ":":
                    self.i += 1
                    item = {str(item): self.value(depth + 1)}
                    self.space()
                out.append(item)
                self.end("]")
        if c == "{":
            self.i += 1
            out = {}
            while True:
                self.space()
                if self.s[self.i : self.i + 1] == "}":
                    self.i += 1
                    return out
                at = self.i
                key = self.value(depth + 1)
                key = key if isinstance(key, str) else self.s[at : self.i].strip()
                self.space()
                if self.s[self.i : self.i + 1] == ":":
                    self.i += 1
                    out[key] = self.value(depth + 1)
                else:
                    out[key] = None
                self.space()
                self.end("}")
        if c in "\"'" and c:
            return self.quoted(c)
        start = self.i
        while self.i < len(self.s) and self.s[self.i] not in ",[]{}\n" and not (self.s[self.i] == ":" and self.s[self.i + 1 : self.i + 2] in ("", " ", ",", "]", "}", "\n")):
            self.i += 1
        return plain(self.s[start : self.i].strip())

    def quoted(self, mark):
        i = self.i + 1
        while i < len(self.s):
            if mark == '"' and self.s[i] == "\\":
                i += 2
            elif self.s[i] == mark:
                if mark == "'" and self.s[i + 1 : i + 2] == "'":
                    i += 2
                    continue
                raw = self.s[self.i + 1 : i]
                self.i = i + 1
                raw = re.sub(r"[ \t]*\n[ \t]*(\n[ \t]*)*", lambda m: "\n" * (m[0].count("\n") - 1) or " ", raw)
                return _double(raw) if mark == '"' else raw.replace("''", "'")
            else:
                i += 1
        raise YamlError("unclosed quote")

    def end(self, closer):
        c = self.s[self.i : self.i + 1]
        if c == ",":
            self.i += 1
        elif c != closer:
            raise YamlError("expected , or " + closer)


class _Blocks:
    def __init__(self, text: str):
        self.lines = []
        for raw in text.replace("\r\n", "\n").split("\n"):
            body = raw.lstrip(" ")
            if body.startswith("\t"):
                if body.strip():
                    raise YamlError("tab in indentation")
                body = ""
            self.lines.append((len(raw) - len(body), body.rstrip()))
        self.i = 0

    def skip(self):
        while self.i < len(self.lines) and (not self.lines[self.i][1] or self.lines[self.i][1][0] == "#"):
            self.i += 1
        return self.i < len(self.lines)

    def node(self, least: int, depth: int = 0):
        """The collection or scalar that begins at the next line with at least this indent."""
        if depth > 200:
            raise YamlError("too deep")
        if not self.skip() or self.lines[self.i][0] < least:
            return None
        indent, body = self.lines[self.i]
        if body == "-" or body.startswith("- "):
            return self.sequence(indent, depth)
        if _KEY.match(body):
            return self.mapping(indent, depth)
        self.i += 1
        return self.scalar(body, least - 1)

    def sequence(self, indent: int, depth: int):
        out = []
        while self.skip():
            at, body = self.lines[self.i]
            if at != indent or not (body == "-" or body.startswith("- ")):
                if at > indent:
                    raise YamlError("bad indentation")
                break
            rest = body[1:].lstrip(" ")
            if not rest or rest[0] == "#":
                self.i += 1
                out.append(self.node(indent + 1, depth + 1))
            elif rest == "-" or rest.startswith("- ") or (_KEY.match(rest) and rest[0] not in "[{"):
                self.lines[self.i] = (indent + len(body) - len(rest), rest)
                out.append(self.node(indent + 1, depth + 1))
            else:
                self.i += 1
                out.append(self.scalar(rest, indent))
        return out

    def mapping(self, indent: int, depth: int):
        out = {}
        while self.skip():
            at, body = self.lines[self.i]
            if at != indent:
                if at > indent:
                    raise YamlError("bad indentation")
                break
            m = _KEY.match(body)
            if not m:
                if body == "-" or body.startswith("- "):
                    break
                raise YamlError(f"expected a key: {body[:40]}")
            raw = m[1]
            key = _double(raw[1:-1]) if raw[0] == '"' else raw[1:-1].replace("''", "'") if raw[0] == "'" else raw
            rest = body[m.end() :].strip()
            self.i += 1
            if not rest or rest[0] == "#":
                following = self.skip() and self.lines[self.i]
                if following and following[0] == indent and (following[1] == "-" or following[1].startswith("- ")):
                    out[key] = self.sequence(indent, depth + 1)  # a list may stand at its key's indent
                else:
                    out[key] = self.node(indent + 1, depth + 1)
            else:
                out[key] = self.scalar(rest, indent)
        return out

    def scalar(self, rest: str, indent: int):
        """A scalar whose first line is ``rest``; further lines are indented more than ``indent``."""
        if rest[0] in "|>":
            return self.block(rest, indent)
        if rest[0] in "[{\"'":
            text = rest
            while True:
                flow = _Flow(text)
                try:
                    value = flow.value()
                    left = flow.s[flow.i :].strip()
                    if left and left[0] != "#":
                        raise YamlError("text after value")
                    return value
                except YamlError:
                    # The value may go on in the next line.
                    if self.i < len(self.lines) and (not self.lines[self.i][1] or self.lines[self.i][0] > indent) and (flow.i >= len(text) - 1 or text[0] in "[{\"'"):
                        text += "\n" + self.lines[self.i][1]
                        self.i += 1
                        continue
                    raise
        parts = [_COMMENT.sub("", rest).rstrip()]
        while self.i < len(self.lines) and parts[0] and self.lines[self.i][1] and self.lines[self.i][0] > indent and self.lines[self.i][1][0] != "#":
            if _KEY.match(self.lines[self.i][1]):
                raise YamlError("a mapping inside a plain scalar")
            parts.append(_COMMENT.sub("", self.lines[self.i][1]).rstrip())
            self.i += 1
        if re.search(r":[ \t]", parts[0]):
            raise YamlError("a mapping inside a plain scalar")
        return plain(" ".join(parts))

    def block(self, head: str, indent: int):
        m = re.match(r"([|>])(?:([-+])([1-9])?|([1-9])([-+])?)?[ \t]*(?:#.*)?$", head)
        if not m:
            raise YamlError("bad block scalar")
        chomp, width = m[2] or m[5], m[3] or m[4]
        lines, inner = [], indent + int(width) if width else None
        while self.i < len(self.lines):
            at, body = self.lines[self.i]
            if body and inner is None:
                inner = at
                if at <= indent:
                    break
            if body and at < inner:
                break
            lines.append(" " * (at - inner) + body if body else "")
            self.i += 1
        tail = 0
        while lines and not lines[-1]:
            lines.pop()
            tail += 1
        if m[1] == "|":
            text = "\n".join(lines)
        else:
            text = ""
            for k, line in enumerate(lines):
                if k == 0:
                    text = line
                elif not line:
                    text += "\n"
                elif lines[k - 1] == "" or line[0] == " " or lines[k - 1][:1] == " ":
                    text += ("\n" if line[0] == " " or lines[k - 1][:1] == " " else "") + line
                else:
                    text += " " + line
        return text + ("" if chomp == "-" or not lines else "\n" * (1 + tail) if chomp == "+" else "\n")


def loads(text: str):
    """YAML text to a tree; an empty document is an error, as no document is there."""
    b = _Blocks(text)
    if not b.skip():
        raise YamlError("empty document")
    value = b.node(0)
    if b.skip():
        if b.lines[b.i][1] in ("...",):
            return value
        raise YamlError(f"unexpected: {b.lines[b.i][1][:40]}")
    return value
