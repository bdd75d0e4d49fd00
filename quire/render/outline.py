"""A compact outline for language models: one short tag a line, one blank per level."""

from __future__ import annotations

from quire.core.nodes import Block, Document, Inline


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _only_text(items: list[Inline]) -> str | None:
    """The text, if the inlines are text and nothing else."""
    return "".join(i.content for i in items) if items and all(i.kind == "text" for i in items) else None


def _inlines(items: list[Inline], pad: str, out: list[str]) -> None:
    run: list[str] = []
    for i in [*items, None]:
        if i is not None and i.kind == "text":
            run.append(i.content)
            continue
        if run:
            out.append(f"{pad}. {_quoted(''.join(run))}")
            run = []
        if i is not None:
            _inline(i, pad, out)


def _with_children(head: str, items: list[Inline], pad: str, out: list[str]) -> None:
    text = _only_text(items)
    if text is not None:
        out.append(f"{pad}{head} {_quoted(text)}")
    else:
        out.append(pad + head)
        _inlines(items, pad + " ", out)


def _inline(i: Inline, pad: str, out: list[str]) -> None:
    k = i.kind
    target = (i.url or "") + (f" {_quoted(i.title)}" if i.title is not None else "")
    if k in ("emphasis", "strong"):
        _with_children(("E" if k == "emphasis" else "S") + i.marker, i.children, pad, out)
    elif k == "strikethrough":
        _with_children("~~", i.children, pad, out)
    elif k == "link":
        _with_children(f"L({target})", i.children, pad, out)
    elif k == "code_span":
        out.append(f"{pad}` {_quoted(i.content)}")
    elif k == "image":
        out.append(f"{pad}I({target}) {_quoted(i.alt or '')}")
    elif k == "autolink":
        out.append(f"{pad}<{i.url}>")
    elif k == "footnote_reference":
        out.append(f"{pad}^{i.label}")
    elif k == "html_in_line":
        out.append(f"{pad}<> {_quoted(i.content)}")
    else:
        out.append(pad + ("BR" if k == "hard_break" else "NL"))


def _row(tag: str, cells: list[list[Inline]], pad: str, out: list[str]) -> None:
    texts = [_only_text(c) for c in cells]
    if all(t is not None for t in texts):
        out.append(f"{pad}{tag} " + " | ".join(map(_quoted, texts)))
        return
    out.append(pad + tag)
    for cell in cells:
        _with_children("C", cell, pad + " ", out)


def _block(b: Block, pad: str, out: list[str]) -> None:
    k = b.kind
    deeper = pad + " "
    if k == "heading":
        _with_children(f"H{b.level}", b.inlines, pad, out)
    elif k == "paragraph":
        _with_children("P", b.inlines, pad, out)
    elif k == "code_block":
        out.append(f"{pad}CB {_quoted(b.content)}")
    elif k == "fenced_code_block":
        out.append(f"{pad}F{b.fence_char}{b.language or ''}")
        lines = b.content.split("\n")
        out.extend(deeper + line for line in (lines[:-1] if lines[-1] == "" else lines))
    elif k == "blockquote":
        out.append(pad + "BQ")
        _blocks(b.children, deeper, out)
    elif k == "list":
        tag = ("OL" if b.start is None else f"OL={b.start}") if b.list_type == "ordered" else "UL"
        out.append(f"{pad}{tag} {'tight' if b.tight else 'loose'}")
        for item in b.children:
            out.append(deeper + "+" + ("" if item.checked is None else "[x]" if item.checked else "[ ]"))
            _blocks(item.children, deeper + " ", out)
    elif k == "thematic_break":
        out.append(pad + "HR")
    elif k == "html_block":
        out.append(f"{pad}HTML {_quoted(b.content)}")
    elif k == "footnote_definition":
        out.append(f"{pad}FN={b.label}")
        _blocks(b.children, deeper, out)
    else:
        out.append(pad + "TABLE")
        for n, row in enumerate(b.rows):
            _row("TR" if n else "TH", row, deeper, out)


def _blocks(blocks: list[Block], pad: str, out: list[str]) -> None:
    for b in blocks:
        _block(b, pad, out)


def render(doc: Document) -> str:
    out: list[str] = []
    _blocks(doc.blocks, "", out)
    return "".join(line + "\n" for line in out)
