"""Text for terminals, with ANSI styles and OSC 8 links. Image protocols belong to the host terminal."""

from __future__ import annotations

import re
import unicodedata

from quire.core.nodes import Block, Document, Inline

# Terminal control sequences.
RESET, BOLD, DIM, ITALIC, UNDERLINE, STRIKE = (f"\x1b[{n}m" for n in (0, 1, 2, 3, 4, 9))
RED, GREEN, YELLOW, BLUE, MAGENTA, CYAN, WHITE = (f"\x1b[{n}m" for n in range(31, 38))
CODE_BACKGROUND = "\x1b[48;5;236m"
LINK_OPEN, LINK_CLOSE = "\x1b]8;;", "\x1b\\"
RULE = 60
HEADINGS = [BOLD + MAGENTA + UNDERLINE, BOLD + CYAN, BOLD + GREEN, BOLD + YELLOW, BOLD + BLUE, BOLD + DIM]

_ANSI = re.compile("\x1b(?:\\[[0-9;?]*[A-Za-z]|\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|_[^\x1b]*\x1b\\\\)")


def strip(s: str) -> str:
    return _ANSI.sub("", s)


def width(s: str) -> int:
    """Columns a text takes: wide characters two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _link(url: str, inner: str) -> str:
    return f"{LINK_OPEN}{url}{LINK_CLOSE}{UNDERLINE}{BLUE}{inner}{RESET}{LINK_OPEN}{LINK_CLOSE}"


def inlines(items: list[Inline]) -> str:
    out = []
    for i in items:
        k = i.kind
        if k == "text":
            out.append(i.content)
        elif k in ("emphasis", "strong", "strikethrough"):
            style = {"emphasis": ITALIC, "strong": BOLD, "strikethrough": STRIKE}[k]
            out.append(style + inlines(i.children) + RESET)
        elif k == "code_span":
            out.append(f"{RED}{CODE_BACKGROUND} {i.content} {RESET}")
        elif k == "link":
            out.append(f"{_link(i.url, inlines(i.children))}{DIM} ({i.url}){RESET}")
        elif k == "image":
            out.append(f"{YELLOW}🖼 {i.alt}{RESET}{DIM} ({_link(i.url, i.url)}{DIM}){RESET}")
        elif k == "autolink":
            out.append(_link(("mailto:" if i.is_email else "") + i.url, i.url))
        elif k == "footnote_reference":
            out.append(f"{CYAN}{DIM}[^{i.label}]{RESET}")
        elif k == "html_in_line":
            out.append(DIM + i.content + RESET)
        else:
            out.append("\n")
    return "".join(out)


def _padded(text: str, to: int, align: str) -> str:
    room = to - width(text)
    left = room if align == "right" else room // 2 if align == "center" else 0
    return " " * left + text + " " * (room - left)


def _table(b: Block) -> list[str]:
    rows = [[strip(inlines(c)).replace("\n", " ") for c in row] for row in b.rows]
    widths = [max(width(r[k]) for r in rows) for k in range(len(b.aligns))]
    lines = ["".join(f"| {_padded(c, w, a)} " for c, w, a in zip(r, widths, b.aligns)) + "|" for r in rows]
    lines.insert(1, "|" + "".join(f" {'-' * w} |" for w in widths))
    return lines


def _block(b: Block, indent: int, quotes: int, out: list[str]) -> None:
    lead = " " * indent + (DIM + WHITE + "│ " + RESET) * quotes
    k = b.kind
    if k == "heading":
        out.append(f"{lead}{HEADINGS[b.level - 1]}{'#' * b.level} {inlines(b.inlines)}{RESET}\n")
    elif k == "paragraph":
        out.append(lead + inlines(b.inlines).replace("\n", "\n" + lead) + "\n")
    elif k == "code_block":
        out.append("".join(f"{lead}{GREEN}{CODE_BACKGROUND}  {line}  {RESET}\n" for line in b.content.split("\n")))
    elif k == "fenced_code_block":
        lines = b.content.split("\n") if b.content else []
        out.append(f"{lead}{DIM}╭─{b.language or ''}{RESET}\n" + "".join(f"{lead}{DIM}│ {RESET}{GREEN}{line}{RESET}\n" for line in lines) + f"{lead}{DIM}╰─{RESET}\n")
    elif k == "blockquote":
        for c in b.children:
            _block(c, indent, quotes + 1, out)
    elif k == "list":
        _list(b, indent, quotes, lead, out)
    elif k == "thematic_break":
        out.append(f"{lead}{DIM}{'─' * RULE}{RESET}\n")
    elif k == "html_block":
        out.append(f"{lead}{DIM}{b.content}{RESET}")
    elif k == "footnote_definition":
        out.append(f"{lead}{CYAN}{DIM}[^{b.label}]: {RESET}")
        _first(b.children, indent + 4, quotes, out)
    else:
        out.append("".join(lead + line + "\n" for line in _table(b)))


def _first(children: list[Block], indent: int, quotes: int, out: list[str], gap: bool = False) -> None:
    """Children of which the first paragraph stands behind a mark that is already written."""
    for n, c in enumerate(children):
        if n == 0 and c.kind == "paragraph":
            out.append(inlines(c.inlines) + "\n")
        else:
            if n == 0:
                out.append("\n")
            _block(c, indent, quotes, out)
        if gap and c.kind == "paragraph":
            out.append("\n")
    if not children:
        out.append("\n")


def _list(b: Block, indent: int, quotes: int, lead: str, out: list[str]) -> None:
    for n, item in enumerate(b.children):
        mark = f"{CYAN}{(b.start if b.start is not None else 1) + n}.{RESET} " if b.list_type == "ordered" else f"{CYAN}• {RESET}"
        box = "" if item.checked is None else "[x] " if item.checked else "[ ] "
        out.append(lead + mark + box)
        _first(item.children, indent + 3, quotes, out, gap=not b.tight)


def render(doc: Document) -> str:
    out: list[str] = []
    for n, b in enumerate(doc.blocks):
        if n and doc.blocks[n - 1].kind != "thematic_break":
            out.append("\n")
        _block(b, 0, 0, out)
    return "".join(out)
