"""Inline structure by the delimiter-stack and bracket-stack method of the CommonMark specification."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from quire.core.nodes import Inline, flatten

MAX_DEPTH = 100  # deeper emphasis stays text
ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SPECIAL = "\\\n`*_~[]!<"
_RUN = re.compile(r"[^" + re.escape(_SPECIAL) + r"]+")
_ACTIVE = re.compile(r"[\\\n`*_~\[\]!<@]|www\.|://", re.I)  # without any of these a text is one node
_AUTO = re.compile(r"(?<![^\s*_~(])(?:www\.|https?://|ftp://)", re.I)
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*)>")
_MAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
RAW_HTML = re.compile(
    r"<(?:[A-Za-z][A-Za-z0-9-]*" + _ATTRIBUTE + r"*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>|<!---?>|<!--(?:(?!-->)[\s\S])*-->|<\?(?:(?!\?>)[\s\S])*\?>|<![A-Za-z][^>]*>|<!\[CDATA\[(?:(?!\]\]>)[\s\S])*\]\]>"
)
_TICKS = re.compile(r"`+")
_FOOTNOTE = re.compile(r"\[\^([^\]\n\[]+)\]")
_LABEL = re.compile(r"\[((?:\\[\s\S]|[^\\\[\]])*)\]")
_SPACE = re.compile(r"[ \t]*(?:\n[ \t]*)?")
_ANGLE_DEST = re.compile(r"<((?:\\[\s\S]|[^<>\n\\])*)>")
_TITLE = re.compile(r"\"((?:\\[\s\S]|[^\"\\])*)\"|'((?:\\[\s\S]|[^'\\])*)'|\(((?:\\[\s\S]|[^()\\])*)\)")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*")
_EMAIL = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
_BARE = re.compile(r"(?:www\.|https?://|ftp://)", re.I)
_PUNCT = "?!.,:*_~'\""


@lru_cache(maxsize=8192)
def _class(c: str) -> int:
    """0 other, 1 white space, 2 punctuation (categories P and S)."""
    if c == "" or c in " \t\n\f\r" or unicodedata.category(c) == "Zs":
        return 1
    return 2 if c in ESCAPABLE or unicodedata.category(c)[0] in "PS" else 0


def normalize_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def destination(s: str, i: int) -> tuple[str, int] | None:
    """A link destination at i and where it ends."""
    if s[i : i + 1] == "<":
        m = _ANGLE_DEST.match(s, i)
        return (m[1], m.end()) if m else None
    depth, j, n = 0, i, len(s)
    while j < n:
        c = s[j]
        if c == "\\" and j + 1 < n and s[j + 1] in ESCAPABLE:
            j += 2
            continue
        if c == "(":
            depth += 1
            if depth > 32:
                return None
        elif c == ")":
            if depth == 0:
                break
            depth -= 1
        elif c <= " " or c == "\x7f":
            break
        j += 1
    return (s[i:j], j) if depth == 0 else None


def title_at(s: str, i: int) -> tuple[str, int] | None:
    m = _TITLE.match(s, i)
    if not m:
        return None
    value = m[1] if m[1] is not None else m[2] if m[2] is not None else m[3]
    return None if re.search(r"\n[ \t]*\n", value) else (value, m.end())


def url_end(s: str, start: int, after: int) -> int:
    """Where an extended autolink that starts at ``start`` ends; 0 if its domain is not valid."""
    m = _DOMAIN.match(s, after)
    if not m:
        return 0
    parts = m[0].split(".")
    if any("_" in p for p in parts[-2:]):
        return 0
    end = m.end()
    while end < len(s) and not s[end].isspace() and s[end] != "<":
        end += 1
    while end > after:
        c = s[end - 1]
        if c in _PUNCT:
            end -= 1
        elif c == ")" and s.count(")", start, end) > s.count("(", start, end):
            end -= 1
        elif c == ";":
            m = re.search(r"&[A-Za-z0-9]+;$", s[start:end])
            end -= len(m[0]) if m else 1
        else:
            break
    return end if end > after else 0


class _Run:
    """A run of delimiters that may still open or close emphasis."""

    __slots__ = ("char", "count", "length", "at", "can_open", "can_close", "prev", "next")

    def __init__(self, char, count, at, can_open, can_close):
        self.char, self.count, self.length, self.at, self.can_open, self.can_close = char, count, count, at, can_open, can_close
        self.prev = self.next = None


class _Bracket:
    __slots__ = ("at", "pos", "image", "active", "prev_run", "bracket_after")

    def __init__(self, at, pos, image, prev_run):
        self.at, self.pos, self.image, self.prev_run, self.active, self.bracket_after = at, pos, image, prev_run, True, False


class InlineParser:
    def __init__(self, refs: dict, gfm: bool = True):
        self.refs, self.gfm = refs, gfm

    def parse(self, s: str) -> list[Inline]:
        if not s:
            return []
        if not _ACTIVE.search(s):
            return [Inline("text", s.rstrip(" ") if s[-1] == " " else s)]
        self.s, self.out, self.last = s, [], None
        self.brackets: list[_Bracket] = []
        self.no_ticks: dict[int, int] = {}
        self.jumps: dict[int, int] = {}  # stretches of ``out`` that are inside a finished node: start to end
        self.ticks_scanned = False
        i, n, out = 0, len(s), self.out
        while i < n:
            c = s[i]
            if c not in _SPECIAL:
                i = self._plain(i)
            elif c == "\\":
                nxt = s[i + 1 : i + 2]
                if nxt == "\n":
                    out.append(Inline("hard_break"))
                    i = self._skip_blanks(i + 2)
                elif nxt and nxt in ESCAPABLE:
                    out.append(Inline("text", nxt, marker="\\"))  # never merged: its content is literal
                    i += 2
                else:
                    self._text("\\")
                    i += 1
            elif c == "\n":
                i = self._newline(i)
            elif c == "`":
                i = self._code(i)
            elif c in "*_" or (c == "~"):
                i = self._delimiter(i, c)
            elif c == "[":
                m = _FOOTNOTE.match(s, i) if s[i + 1 : i + 2] == "^" else None
                if m and not s.startswith("(", m.end()):
                    out.append(Inline("footnote_reference", label=m[1]))
                    i = m.end()
                else:
                    self._open(i, False)
                    i += 1
            elif c == "!":
                if s[i + 1 : i + 2] == "[":
                    self._open(i, True)
                    i += 2
                else:
                    self._text("!")
                    i += 1
            elif c == "]":
                i = self._close(i)
            else:
                i = self._angle(i)
        self._emphasis(None)
        result = self._merge(self._live(0, len(out)))
        return _extend(result) if self.gfm else result

    # pieces ---------------------------------------------------------------------------------------
    def _text(self, t: str) -> None:
        out = self.out
        if out and out[-1] is not None and out[-1].kind == "text" and out[-1].marker is None:
            out[-1].content += t
        else:
            out.append(Inline("text", t))

    def _plain(self, i: int) -> int:
        s = self.s
        end = _RUN.match(s, i).end()
        if self.gfm and not self.brackets:
            m = _AUTO.search(s, i, end)
            while m:
                stop = url_end(s, m.start(), m.start() if m[0][-1] == "." else m.end())
                if stop > m.end():
                    if m.start() > i:
                        self._text(s[i : m.start()])
                    url = s[m.start() : stop]
                    self.out.append(Inline("autolink", url=url, is_www=m[0][-1] == "."))
                    return stop
                m = _AUTO.search(s, m.end(), end)
        self._text(s[i:end])
        return end

    def _skip_blanks(self, i: int) -> int:
        s = self.s
        while i < len(s) and s[i] in " \t":
            i += 1
        return i

    def _newline(self, i: int) -> int:
        out, hard = self.out, False
        if out and out[-1] is not None and out[-1].kind == "text" and out[-1].marker is None:
            body = out[-1].content
            hard = body.endswith("  ")
            out[-1].content = body.rstrip(" ") if hard or body.endswith(" ") else body
            if not out[-1].content:
                out.pop()
        out.append(Inline("hard_break" if hard else "soft_break"))
        return self._skip_blanks(i + 1)

    def _code(self, i: int) -> int:
        s = self.s
        n = _TICKS.match(s, i).end() - i
        if not self.ticks_scanned or self.no_ticks.get(n, -1) > i:
            for m in _TICKS.finditer(s, i + n):
                size = m.end() - m.start()
                if size == n:
                    body = s[i + n : m.start()].replace("\n", " ")
                    if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" "):
                        body = body[1:-1]
                    self.out.append(Inline("code_span", body))
                    return m.end()
                self.no_ticks[size] = m.start()
            self.ticks_scanned = True
        self._text("`" * n)
        return i + n

    def _delimiter(self, i: int, c: str) -> int:
        s, j = self.s, i
        while j < len(s) and s[j] == c:
            j += 1
        before, after = _class(s[i - 1] if i else ""), _class(s[j] if j < len(s) else "")
        left = after != 1 and (after != 2 or before != 0)
        right = before != 1 and (before != 2 or after != 0)
        if c == "_":
            can_open, can_close = left and (not right or before == 2), right and (not left or after == 2)
        else:
            can_open, can_close = left, right
        count = j - i
        if c == "~" and count > 2:
            can_open = can_close = False
        self.out.append(Inline("text", s[i:j], marker=c))
        if can_open or can_close:
            run = _Run(c, count, len(self.out) - 1, can_open, can_close)
            run.prev = self.last
            if self.last:
                self.last.next = run
            self.last = run
        return j

    def _open(self, i: int, image: bool) -> None:
        if self.brackets:
            self.brackets[-1].bracket_after = True
        self.out.append(Inline("text", "![" if image else "[", marker="["))
        self.brackets.append(_Bracket(len(self.out) - 1, i + (2 if image else 1), image, self.last))

    def _close(self, i: int) -> int:
        s = self.s
        if not self.brackets:
            self._text("]")
            return i + 1
        b = self.brackets.pop()
        if not b.active:
            self._text("]")
            return i + 1
        found = self._inline_link(i + 1)
        kind, label = "in_line", None
        if not found:
            m = _LABEL.match(s, i + 1)
            end = i + 1
            if m and m[1].strip():
                label, kind, end = m[1], "reference", m.end()
            elif not b.bracket_after or (m and not m[1].strip()):
                label = s[b.pos : i]
                kind = "collapsed" if m and m[1] == "" else "shortcut"
                end = m.end() if m and m[1] == "" else end
            if label is not None and len(label) <= 999:
                ref = self.refs.get(normalize_label(label))
                if ref is not None and label.strip():
                    found = (ref[0], ref[1], end)
        if not found:
            self._text("]")
            return i + 1
        url, title, end = found
        self._emphasis(b.prev_run)
        inner = self._merge(self._live(b.at + 1, len(self.out)))
        del self.out[b.at :]
        self.jumps.clear()  # all of them lay inside the link
        if b.image:
            self.out.append(Inline("image", url=url, title=title, link_type=kind, alt=flatten(inner)))
        else:
            self.out.append(Inline("link", children=inner, url=url, title=title, link_type=kind))
            for other in self.brackets:
                if not other.image:
                    other.active = False
        return end

    def _inline_link(self, i: int):
        s = self.s
        if s[i : i + 1] != "(":
            return None
        i = _SPACE.match(s, i + 1).end()
        got = destination(s, i)
        if got is None:
            return None
        url, i = got
        j = _SPACE.match(s, i).end()
        title = None
        if j > i:
            t = title_at(s, j)
            if t:
                title, j = t
                j = _SPACE.match(s, j).end()
        return (url, title, j + 1) if s[j : j + 1] == ")" else None

    def _angle(self, i: int) -> int:
        s = self.s
        m = _URI.match(s, i)
        if m:
            self.out.append(Inline("autolink", url=m[1]))
            return m.end()
        m = _MAIL.match(s, i)
        if m:
            self.out.append(Inline("autolink", url=m[1], is_email=True))
            return m.end()
        m = RAW_HTML.match(s, i)
        if m:
            self.out.append(Inline("html_in_line", m[0]))
            return m.end()
        self._text("<")
        return i + 1

    # emphasis -------------------------------------------------------------------------------------
    def _emphasis(self, bottom) -> None:
        out, floors = self.out, {}
        closer = self.last
        while closer is not None and closer.prev is not bottom:
            closer = closer.prev
        if closer is bottom:
            return
        while closer is not None:
            if not closer.can_close:
                closer = closer.next
                continue
            key = (closer.char, closer.can_open, closer.length % 3)
            floor, opener, found = floors.get(key, bottom), closer.prev, False
            while opener is not None and opener is not bottom and opener is not floor:
                if opener.char == closer.char and opener.can_open:
                    if closer.char == "~":
                        found = opener.count == closer.count
                    else:
                        odd = (opener.can_close or closer.can_open) and (opener.length + closer.length) % 3 == 0 and (opener.length % 3 or closer.length % 3)
                        found = not odd
                    if found:
                        break
                opener = opener.prev
            if not found:
                floors[key] = closer.prev
                following = closer.next
                if not closer.can_open:
                    self._drop(closer)
                closer = following
                continue
            use = closer.count if closer.char == "~" else 2 if closer.count >= 2 and opener.count >= 2 else 1
            inner = self._merge(self._live(opener.at + 1, closer.at))
            if any(x.height >= MAX_DEPTH for x in inner):
                while opener is not None and opener is not bottom:  # all of them would enclose it too
                    before = opener.prev
                    self._drop(opener)
                    opener = before
                continue
            kind = "strikethrough" if closer.char == "~" else "strong" if use == 2 else "emphasis"
            node = Inline(kind, children=inner, marker=None if closer.char == "~" else closer.char)
            between = opener.next
            while between is not closer:
                following = between.next
                self._drop(between)
                between = following
            opener.count -= use
            closer.count -= use
            out[opener.at].content = out[opener.at].content[: opener.count]
            out[closer.at].content = out[closer.at].content[: closer.count]
            # The node goes between what is left of both runs; if nothing is left of one, into its place.
            if opener.count == 0:
                out[opener.at] = node
                self.jumps[opener.at + 1] = closer.at
                self._drop(opener)
            else:  # there is something between the runs, or they would be one
                out[opener.at + 1] = node
                self.jumps[opener.at + 2] = closer.at
            if closer.count == 0:
                out[closer.at] = None
                following = closer.next
                self._drop(closer)
                closer = following
        while self.last is not bottom and self.last is not None:
            self._drop(self.last)

    def _drop(self, run: _Run) -> None:
        if run.prev:
            run.prev.next = run.next
        if run.next:
            run.next.prev = run.prev
        else:
            self.last = run.prev

    def _live(self, at: int, end: int) -> list[Inline]:
        """The nodes between two places that are not inside a finished node."""
        out, jumps = self.out, self.jumps
        if not jumps:
            return [x for x in out[at:end] if x is not None]
        found = []
        while at < end:
            to = jumps.get(at)
            if to is not None and to > at:
                at = to
                continue
            if out[at] is not None:
                found.append(out[at])
            at += 1
        return found

    @staticmethod
    def _merge(items: list[Inline]) -> list[Inline]:
        """Joins neighbouring text; an escaped ampersand stays alone, as its content is no reference."""
        merged: list[Inline] = []
        for x in items:
            if x.kind == "text":
                if not x.content:
                    continue
                literal = x.marker == "\\" and x.content == "&"
                if merged and merged[-1].kind == "text" and merged[-1].marker != "\\" and not literal:
                    merged[-1].content += x.content
                    continue
                merged.append(Inline("text", x.content, marker="\\" if literal else None))
            else:
                merged.append(x)
        return merged


def _extend(items: list[Inline]) -> list[Inline]:
    """Bare e-mail addresses, and bare links that stood inside brackets, outside of links."""
    out: list[Inline] = []
    for x in items:
        if x.kind == "text" and ("@" in x.content or "://" in x.content or "www." in x.content.lower()):
            out.extend(_split(x.content))
        else:
            if x.children and x.kind != "link":
                x.children = _extend(x.children)
            out.append(x)
    return out


def _split(t: str) -> list[Inline]:
    out, at = [], 0
    hits = [(m.start(), "mail", m) for m in _EMAIL.finditer(t)] + [(m.start(), "bare", m) for m in _AUTO.finditer(t)]
    for start, kind, m in sorted(hits, key=lambda h: h[:2]):
        if start < at:
            continue
        if kind == "mail":
            end = m.end()
            while end > start and t[end - 1] == ".":
                end -= 1
            if t[end - 1] in "-_" or (start and t[start - 1] == "/"):
                continue
            node = Inline("autolink", url=t[start:end], is_email=True)
        else:
            end = url_end(t, start, start if m[0][-1] == "." else m.end())
            if end <= m.end():
                continue
            node = Inline("autolink", url=t[start:end], is_www=m[0][-1] == ".")
        if start > at:
            out.append(Inline("text", t[at:start]))
        out.append(node)
        at = end
    if at < len(t) or not out:
        out.append(Inline("text", t[at:]))
    return out
