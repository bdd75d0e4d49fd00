"""Block structure: one pass over the lines with a stack of open containers."""

from __future__ import annotations

import re

from quire.core.inlines import InlineParser, destination, normalize_label, title_at
from quire.core.nodes import Block, Document

MAX_DEPTH = 100
MAX_COLUMNS = 64

_STARTERS = frozenset("#`~><=-|:*_[+0123456789")  # what a block other than a paragraph can begin with
_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_ATX_END = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_SETEXT = re.compile(r"(?:=+|-+)[ \t]*$")
_BULLET = re.compile(r"[*+-](?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
_FOOTNOTE = re.compile(r"\[\^([A-Za-z0-9]+)\]: +(?=\S)|\[\^([A-Za-z0-9]+)\]:\t+(?=\S)")
_TASK = re.compile(r"\[([ xX])\][ \t]+(?=\S)")
_DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_FRONT = re.compile(r"(---|\+\+\+|%%%)[ \t]*$")

# Elements that begin an HTML block (kind 6) by the CommonMark specification.
_HTML6 = """
address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset
figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem
nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul
""".split()
_HTML_OPEN = [
    re.compile(r"<(?:script|pre|textarea|style)(?:\s|>|$)", re.I),
    re.compile(r"<!--"),
    re.compile(r"<\?"),
    re.compile(r"<![A-Za-z]"),
    re.compile(r"<!\[CDATA\["),
    re.compile(rf"</?(?:{'|'.join(_HTML6)})(?:\s|/?>|$)", re.I),
    re.compile(
        r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$"
    ),
]
_HTML_CLOSE = [re.compile(r"</(?:script|pre|textarea|style)>", re.I), re.compile(r"-->"), re.compile(r"\?>"), re.compile(r">"), re.compile(r"\]\]>")]


class _State:
    """What an open block needs besides its fields."""

    __slots__ = ("lines", "offset", "indent", "blank_end", "marker")

    def __init__(self):
        self.lines: list[str] = []
        self.offset = self.indent = 0
        self.marker = None
        self.blank_end = False


def split_lines(text: str) -> list[str]:
    """Lines end at LF; one CR before it belongs to the line end."""
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    if lines and lines[-1] == "":
        lines.pop()
    return lines


def skip_front(lines: list[str]) -> int:
    """Lines of a leading front-matter block, which holds a colon somewhere; else 0."""
    if not lines or not _FRONT.match(lines[0]):
        return 0
    colon = False
    for i in range(1, len(lines)):
        if _FRONT.match(lines[i]):
            return i + 1 if colon else 0
        colon = colon or ":" in lines[i]
    return 0


class BlockParser:
    def __init__(self, gfm: bool = True):
        self.gfm = gfm
        self.refs: dict[str, tuple[str, str | None]] = {}

    def parse(self, text: str, skip_frontmatter: bool = True) -> Document:
        lines = split_lines(text.replace("\x00", "�"))
        self.root = Block("document")
        self.root._p = _State()
        self.open: list[Block] = [self.root]
        for line in lines[skip_front(lines) if skip_frontmatter else 0 :]:
            self._line(line)
        while len(self.open) > 1:
            self._pop()
        self._inlines(self.root)
        return Document(self.root.children, self.refs, self.gfm)

    # cursor ---------------------------------------------------------------------------------------
    def _find(self) -> None:
        line, i, col = self.line, self.pos, self.col
        n = len(line)
        while i < n:
            c = line[i]
            if c == " ":
                col += 1
            elif c == "\t":
                col += 4 - col % 4
            else:
                break
            i += 1
        self.at, self.at_col, self.blank = i, col, i >= n
        self.indent = col - self.col

    def _advance(self, columns: int) -> None:
        """Moves over white space by columns; part of a tab may be left, as ``self.rest`` blanks."""
        target = self.col + columns
        line = self.line
        while self.col < target and self.pos < len(line):
            c = line[self.pos]
            if c == "\t":
                width = 4 - self.col % 4
                if self.col + width > target:
                    self.rest = self.col + width - target
                    self.col = target
                    return
                self.col += width
            else:
                self.col += 1
            self.pos += 1
            self.rest = 0

    def _jump(self) -> None:
        self.pos, self.col, self.rest = self.at, self.at_col, 0

    def _rest(self) -> str:
        """The remaining line; a tab that was partly used counts as the blanks it has left."""
        if self.rest:
            return " " * self.rest + self.line[self.pos + 1 :]
        return self.line[self.pos :]

    # tree -----------------------------------------------------------------------------------------
    def _add(self, kind: str, **fields) -> Block:
        while self.open[-1].kind not in ("document", "blockquote", "list_item", "list") or (self.open[-1].kind == "list" and kind != "list_item"):
            self._pop()
        b = Block(kind, **fields)
        b._p = _State()
        self.open[-1].children.append(b)
        self.open.append(b)
        return b

    def _pop(self) -> None:
        b = self.open.pop()
        p = b._p
        if b.kind == "paragraph":
            self._take_definitions(b)
            if not p.lines:
                self.open[-1].children.remove(b)
            else:
                b.raw = "\n".join(p.lines).rstrip(" \t")
        elif b.kind == "code_block":
            while p.lines and not p.lines[-1].strip(" \t"):
                p.lines.pop()
            b.content = "\n".join(p.lines)
        elif b.kind == "fenced_code_block":
            b.content = "\n".join(p.lines)
        elif b.kind == "html_block":
            while p.lines and b.html_type >= 6 and not p.lines[-1].strip(" \t"):
                p.lines.pop()
            b.content = "\n".join(p.lines) + "\n"
        elif b.kind == "list":
            last = len(b.children) - 1
            b.tight = not any(
                (item._p.blank_end and k < last) or any((k < last or j + 1 < len(item.children)) and self._ends_blank(c) for j, c in enumerate(item.children))
                for k, item in enumerate(b.children)
            )

    def _ends_blank(self, b: Block) -> bool:
        while b is not None:
            if b._p.blank_end:
                return True
            b = b.children[-1] if b.kind in ("list", "list_item") and b.children else None
        return False

    def _take_definitions(self, b: Block) -> None:
        """Moves link definitions from a paragraph's start into the references; the first of a label wins."""
        p = b._p
        if not p.lines or not p.lines[0].startswith("["):
            return
        s = "\n".join(p.lines)
        while s.startswith("["):
            found = _definition(s)
            if not found:
                break
            label, url, title, end = found
            self.refs.setdefault(label, (url, title))
            s = s[end:]
        p.lines = s.split("\n") if s.strip(" \t\n") else []

    # one line -------------------------------------------------------------------------------------
    def _line(self, line: str) -> None:
        self.line, self.pos, self.col, self.rest = line, 0, 0, 0
        depth = 1
        stack = self.open
        while depth < len(stack):
            b = stack[depth]
            self._find()
            kind = b.kind
            if kind == "blockquote":
                if self.indent <= 3 and not self.blank and line[self.at] == ">":
                    self._quote_mark()
                else:
                    break
            elif kind == "list_item":
                if self.blank:
                    if not b.children:
                        break
                    self._jump()
                elif self.indent >= b._p.offset:
                    self._advance(b._p.offset)
                else:
                    break
            elif kind == "fenced_code_block":
                m = None if self.blank or self.indent > 3 else re.match(rf"{re.escape(b.fence_char)}{{{b.fence_length},}}[ \t]*$", line[self.at :])
                if m:
                    while len(stack) > depth:
                        self._pop()
                    return
                self._advance(min(self.indent, b._p.indent))
            elif kind == "code_block":
                if self.indent >= 4:
                    self._advance(4)
                elif self.blank:
                    self._advance(min(4, self.indent))
                else:
                    break
            elif kind == "html_block":
                if self.blank and b.html_type >= 6:
                    break
            elif kind == "paragraph":
                if self.blank:
                    break
            elif kind == "table":
                if self.blank:
                    break
            elif kind != "list":
                break
            depth += 1
        matched = depth
        leaf = stack[-1]
        tip = stack[matched - 1]
        if tip.kind in ("fenced_code_block", "code_block", "html_block") and matched == len(stack):
            self._find()
            self._mark(tip, self.blank and tip.kind == "code_block")
            self._text(tip)
            return
        self.unmatched = matched < len(stack)

        # new blocks
        started = False
        while True:
            self._find()
            if self.blank:
                break
            opened = self._start(matched, started)
            if not opened:
                break
            started = True
            if opened == "leaf":
                self._mark(stack[-1], False)
                return
        if self.blank:
            self._blank(matched, started)
            return
        if not started and self.unmatched and leaf.kind == "paragraph":
            leaf._p.lines.append(line[self.at :])  # lazy continuation
            return
        if not started:
            while len(stack) > matched:
                self._pop()
        tip = stack[-1]
        self._mark(tip, False)
        if tip.kind == "paragraph":
            tip._p.lines.append(line[self.at :])
        elif tip.kind == "table":
            tip.rows.append(self._row(line[self.at :], len(tip.aligns)))
        else:
            b = self._add("paragraph")
            b._p.lines.append(line[self.at :])

    def _quote_mark(self) -> None:
        self._jump()
        self.pos += 1
        self.col += 1
        if self.pos < len(self.line) and self.line[self.pos] in " \t":
            self._advance(1)

    def _text(self, b: Block) -> None:
        rest = self._rest()
        b._p.lines.append(rest)
        if b.kind == "html_block" and b.html_type < 6 and _HTML_CLOSE[b.html_type - 1].search(rest):
            self._pop()

    def _blank(self, matched: int, started: bool) -> None:
        stack = self.open
        if not started:
            while len(stack) > matched:
                self._pop()
        if stack[-1].kind in ("paragraph", "table"):
            self._pop()
        tip = stack[-1]
        if tip.children:
            tip.children[-1]._p.blank_end = True
        self._mark(tip, not (tip.kind == "blockquote" or (tip.kind == "list_item" and started)))

    def _mark(self, tip: Block, blank: bool) -> None:
        """Remembers whether the innermost open block ended with a blank line; outer ones did not."""
        for b in self.open:
            b._p.blank_end = False
        tip._p.blank_end = blank

    # block starts ---------------------------------------------------------------------------------
    def _close_to(self, matched: int, started: bool) -> None:
        if not started:
            while len(self.open) > matched:
                self._pop()

    def _start(self, matched: int, started: bool):
        line, at, stack = self.line, self.at, self.open
        tip = stack[-1] if started else stack[matched - 1]
        c = line[at]
        in_paragraph = tip.kind == "paragraph" and not started
        lazy = stack[-1].kind == "paragraph"
        if self.indent > 3:
            if lazy and not started or tip.kind == "table":
                return None
            self._close_to(matched, started)
            self._advance(4)
            b = self._add("code_block")
            self._text(b)
            return "leaf"
        if c not in _STARTERS:
            return None
        rest = line[at:]
        if c == "#":
            m = _ATX.match(rest)
            if m:
                self._close_to(matched, started)
                body = _ATX_END.sub("", rest[m.end() :]).strip(" \t")
                self._add("heading", level=len(m[1]), raw=body)
                self._pop()
                return "leaf"
        if c in "`~":
            m = _FENCE.match(rest)
            if m:
                self._close_to(matched, started)
                mark, info = (m[1], m[2]) if m[1] else (m[3], m[4])
                words = info.split()
                b = self._add("fenced_code_block", fence_char=mark[0], fence_length=len(mark), language=words[0] if words else None)
                b._p.indent = self.indent
                return "leaf"
        if c == ">":
            if len(stack) >= MAX_DEPTH:
                return None
            self._close_to(matched, started)
            self._quote_mark()
            self._add("blockquote")
            return "container"
        if c == "<" and tip.kind != "table":
            for kind, pattern in enumerate(_HTML_OPEN, 1):
                if pattern.match(rest) and (kind < 7 or not (in_paragraph or (lazy and not started))):
                    self._close_to(matched, started)
                    b = self._add("html_block", html_type=kind)
                    self._text(b)
                    return "leaf"
        if in_paragraph and c in "=-" and _SETEXT.match(rest):
            self._take_definitions(tip)
            if tip._p.lines:
                self._close_to(matched, started)
                parent = stack[-2]
                parent.children.remove(tip)
                stack.pop()
                h = self._add("heading", level=1 if c == "=" else 2, raw="\n".join(tip._p.lines).strip(" \t"))
                self._pop()
                return "leaf" if h else None
        if in_paragraph and (c in "|:-") and len(tip._p.lines) >= 1 and _DELIMITER.match(rest):
            if self._table(tip, rest):
                return "leaf"
        if c in "*-_" and _BREAK.match(rest):
            self._close_to(matched, started)
            self._add("thematic_break", char=c)
            self._pop()
            return "leaf"
        if c == "[" and not in_paragraph and rest.startswith("[^"):
            m = _FOOTNOTE.match(rest)
            if m:
                self._close_to(matched, started)
                f = self._add("footnote_definition", label=m[1] or m[2])
                p = Block("paragraph", raw=rest[m.end() :].rstrip(" \t"))
                p._p = _State()
                f.children.append(p)
                self._pop()
                return "leaf"
        return self._item(matched, started, in_paragraph, rest)

    def _item(self, matched: int, started: bool, in_paragraph: bool, rest: str):
        stack = self.open
        m = _BULLET.match(rest) or _ORDERED.match(rest)
        if not m or len(stack) >= MAX_DEPTH:
            return None
        ordered = m.lastindex is not None
        after = rest[m.end() :]
        if in_paragraph and (not after.strip(" \t") or (ordered and int(m[1]) != 1)):
            return None
        self._close_to(matched, started)
        outer = self.indent
        self._jump()
        self.pos += m.end()
        self.col += m.end()
        self._find()
        if self.blank:
            width = 1
        elif self.indent > 4:
            width = 1
        else:
            width = self.indent
        offset = outer + m.end() + width
        mark = m[2] if ordered else m[0]
        while stack[-1].kind not in ("document", "blockquote", "list_item", "list"):
            self._pop()
        tip = stack[-1]
        if tip.kind != "list" or tip._p.marker != mark:
            if tip.kind == "list":
                self._pop()
            lst = self._add("list", list_type="ordered" if ordered else "unordered", start=int(m[1]) if ordered else None)
            lst._p.marker = mark
        item = self._add("list_item")
        item._p.offset = offset
        if self.blank:
            self._jump()
            return "container"
        self._advance(width)
        t = _TASK.match(self._rest()) if not self.rest else None
        if t:
            item.checked = t[1] != " "
            self.pos += t.end()
            self.col += t.end()
        return "container"

    # tables ---------------------------------------------------------------------------------------
    def _table(self, paragraph: Block, rest: str) -> bool:
        head = paragraph._p.lines[-1]
        if "|" not in head and "|" not in rest:
            return False
        marks = [x.strip(" \t") for x in rest.strip(" \t").strip("|").split("|")]
        cells = _cells(head)
        if len(marks) != len(cells) or len(marks) > MAX_COLUMNS or "|" not in head:
            return False
        aligns = [("center" if m.endswith(":") else "left") if m.startswith(":") else "right" if m.endswith(":") else "none" for m in marks]
        paragraph._p.lines.pop()
        while self.open[-1] is not paragraph:
            self._pop()
        self._pop()
        t = self._add("table", aligns=aligns)
        t.rows.append(cells)
        return True

    def _row(self, line: str, n: int) -> list:
        cells = _cells(line)[:n]
        return cells + [""] * (n - len(cells))

    # inlines --------------------------------------------------------------------------------------
    def _inlines(self, root: Block) -> None:
        parser = InlineParser(self.refs, self.gfm)
        stack = [root]
        while stack:
            b = stack.pop()
            b._p = None
            if b.raw is not None and b.kind in ("paragraph", "heading"):
                b.inlines = parser.parse(b.raw)
            elif b.kind == "table":
                b.rows = [[parser.parse(c) for c in row] for row in b.rows]
            stack.extend(b.children)


def _cells(line: str) -> list[str]:
    """Cell texts of a row; ``\\|`` is a pipe inside a cell."""
    s = line.strip(" \t")
    if s.startswith("|"):
        s = s[1:]
    out, cell, i = [], [], 0
    while i < len(s):
        if s[i] == "\\" and s[i + 1 : i + 2] == "|":
            cell.append("|")
            i += 2
        elif s[i] == "|":
            out.append("".join(cell).strip(" \t"))
            cell = []
            i += 1
        else:
            cell.append(s[i])
            i += 1
    if "".join(cell).strip(" \t") or not s.endswith("|") or s.endswith("\\|"):
        out.append("".join(cell).strip(" \t"))
    return out


_DEF_LABEL = re.compile(r"\[((?:\\[\s\S]|[^\\\[\]]){1,999})\]:")
_DEF_SPACE = re.compile(r"[ \t]*(?:\n[ \t]*)?")
_DEF_END = re.compile(r"[ \t]*(?:\n|$)")


def _definition(s: str):
    """(label, url, title, end) of a link definition at the start of s."""
    m = _DEF_LABEL.match(s)
    if not m or not m[1].strip() or m[1].startswith("^"):
        return None
    i = _DEF_SPACE.match(s, m.end()).end()
    got = destination(s, i)
    if got is None or (got[1] == i):
        return None
    url, i = got
    line_end = _DEF_END.match(s, i)
    j = _DEF_SPACE.match(s, i).end()
    if j > i:
        t = title_at(s, j)
        if t:
            e = _DEF_END.match(s, t[1])
            if e:
                return normalize_label(m[1]), url, t[0], e.end()
    return (normalize_label(m[1]), url, None, line_end.end()) if line_end else None


def parse(text: str, gfm: bool = True, skip_frontmatter: bool = True) -> Document:
    """Markdown text to a document tree."""
    return BlockParser(gfm).parse(text, skip_frontmatter)
