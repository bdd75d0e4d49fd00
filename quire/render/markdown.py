"""Normalised Markdown: ATX headings, inline links, fences, dashes for bullets and breaks."""

from __future__ import annotations

import re

from quire.core.nodes import Block, Document, Inline

_ESCAPE = re.compile(r"([\\*_`\[\]<>!#|~&])")
_ALIGN = {"none": "---|", "left": ":---|", "center": ":---:|", "right": "---:|"}
_NUMBER_START = re.compile(r"^(\d{1,9})([.)])(?=[ \t]|$)", re.M)
_MARK_START = re.compile(r"^([+=-])(?=[ \t]|$|[=-]*[ \t]*$)", re.M)


def escape(s: str) -> str:
    return _ESCAPE.sub(r"\\\1", s)


def _text(i: Inline) -> str:
    """Text keeps its character references; only the ampersand of an escaped one is escaped."""
    if i.marker == "\\":
        return "\\&"
    return re.sub(r"([\\*_`\[\]<>!#|~]|&(?!#\d{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]{1,31};))", r"\\\1", i.content)


def _target(i: Inline) -> str:
    url = i.url or ""
    if re.search(r"\s", url) or url == "":
        url = f"<{url}>"
    return url if i.title is None else f'{url} "' + re.sub(r'(?<!\\)"', '\\"', i.title) + '"'


def _code(s: str) -> str:
    runs = {len(m) for m in re.findall(r"`+", s)}
    n = 1
    while n in runs:
        n += 1
    if not runs:
        return f"`{s}`" if not (s[:1] == s[-1:] == " " and s.strip()) else f"` {s} `"
    return f"{'`' * max(2, n)} {s} {'`' * max(2, n)}" if max(2, n) not in runs else f"{'`' * n} {s} {'`' * n}"


def inlines(items: list[Inline]) -> str:
    out = []
    for i in items:
        k = i.kind
        if k == "text":
            out.append(_text(i))
        elif k == "soft_break":
            out.append("\n")
        elif k == "hard_break":
            out.append("  \n")
        elif k == "code_span":
            out.append(_code(i.content))
        elif k == "emphasis":
            out.append(i.marker + inlines(i.children) + i.marker)
        elif k == "strong":
            out.append(i.marker * 2 + inlines(i.children) + i.marker * 2)
        elif k == "strikethrough":
            out.append("~~" + inlines(i.children) + "~~")
        elif k == "link":
            out.append(f"[{inlines(i.children)}]({_target(i)})")
        elif k == "image":
            out.append(f"![{re.sub(r'([][])', r'\\\1', i.alt or '')}]({_target(i)})")
        elif k == "autolink":
            out.append(i.url if i.is_www else f"<{i.url}>")
        elif k == "footnote_reference":
            out.append(f"[^{i.label}]")
        else:
            out.append(i.content)
    return "".join(out)


def _paragraph(b: Block) -> str:
    """The text, with what would begin another block at a line's start escaped."""
    text = inlines(b.inlines)
    text = _NUMBER_START.sub(r"\1\\\2", text)
    return _MARK_START.sub(r"\\\1", text) + "\n"


def _prefixed(text: str, first: str, rest: str, blank: str = "") -> str:
    lines = text[:-1].split("\n") if text.endswith("\n") else text.split("\n")
    return "".join((first if n == 0 else rest if line else blank) + line + "\n" for n, line in enumerate(lines))


def _fence(char: str, length: int, content: str) -> str:
    """A fence longer than any run of its character at a line's start inside."""
    inside = [len(m) for m in re.findall(rf"^[ \t]*({re.escape(char)}{{3,}})", content, re.M)]
    return char * max([length, *[n + 1 for n in inside]])


def block(b: Block, other: bool = False) -> str:
    """One block; ``other`` takes the second kind of list mark, as a list of the same kind stands before."""
    k = b.kind
    if k == "paragraph":
        return _paragraph(b)
    if k == "heading":
        return f"{'#' * b.level} {inlines(b.inlines).replace(chr(10), ' ')}".rstrip(" ") + "\n"
    if k in ("code_block", "fenced_code_block"):
        char, length = (b.fence_char, b.fence_length) if k == "fenced_code_block" else ("`", 3)
        fence = _fence(char, length, b.content)
        body = b.content + "\n" if b.content else ""
        return f"{fence}{b.language or ''}\n{body}{fence}\n"
    if k == "blockquote":
        inner = blocks(b.children)
        return _prefixed(inner, "> ", "> ", ">") if inner else ">\n"
    if k == "list":
        return _list(b, other)
    if k == "thematic_break":
        return "---\n"
    if k == "html_block":
        return b.content
    if k == "footnote_definition":
        inner = "".join(block(c) for c in b.children)
        return _prefixed(inner, f"[^{b.label}]: ", "    ") if inner else f"[^{b.label}]:\n"
    rows = ["| " + " | ".join(_cell(c) for c in row) + " |\n" for row in b.rows]
    return rows[0] + "|" + "".join(_ALIGN[a] for a in b.aligns) + "\n" + "".join(rows[1:])


def _cell(items: list[Inline]) -> str:
    """Pipes in code and links need the backslash the table takes away again."""
    return re.sub(r"(?<!\\)\|", r"\\|", inlines(items))


def _list(b: Block, other: bool) -> str:
    out = []
    for n, item in enumerate(b.children):
        mark = f"{(b.start if b.start is not None else 1) + n}{')' if other else '.'} " if b.list_type == "ordered" else "* " if other else "- "
        box = "" if item.checked is None else "[x] " if item.checked else "[ ] "
        parts = _parts(item.children)
        # Blocks of a loose item keep a blank line between them; in a tight one only where it is needed.
        inner = parts[0] if parts else ""
        for before, c, text in zip(item.children, item.children[1:], parts[1:]):
            apart = not b.tight or (before.kind == c.kind and c.kind in ("paragraph", "blockquote", "list", "html_block"))
            inner += ("\n" if apart else "") + text
        if n and not b.tight:
            out.append("\n")
        out.append(_prefixed(inner, mark + box, " " * len(mark)) if inner else mark.rstrip() + "\n")
    return "".join(out)


def _parts(items: list[Block]) -> list[str]:
    """The blocks' texts; of neighbouring lists of one kind every second takes the other mark."""
    out, other = [], False
    for n, b in enumerate(items):
        before = items[n - 1] if n else None
        other = bool(before and b.kind == before.kind == "list" and b.list_type == before.list_type) and not other
        out.append(block(b, other))
    return out


def blocks(items: list[Block]) -> str:
    """Blocks with one blank line between them."""
    return "\n".join(_parts(items))


def render(doc: Document) -> str:
    return blocks(doc.blocks)
