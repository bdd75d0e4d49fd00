"""Edits of documents: blocks by selector, sections between markers."""

from __future__ import annotations

import re

from quire.core.blocks import parse
from quire.core.nodes import BLOCK_KINDS, Block, Document

_SELECTOR = re.compile(r"(\w+)\[(\d+)\]$")


class EditError(ValueError):
    """An edit that does not apply to the document."""


def resolve(doc: Document, selector: str) -> int | None:
    """The index of ``kind[N]``, the N-th top-level block of a kind from 0; ``block[N]`` counts all."""
    m = _SELECTOR.match(selector)
    if not m or (m[1] != "block" and m[1] not in BLOCK_KINDS):
        return None
    found = [i for i, b in enumerate(doc.blocks) if m[1] in ("block", b.kind)]
    n = int(m[2])
    return found[n] if n < len(found) else None


def set_block(doc: Document, selector: str, markdown: str) -> None:
    """Replaces a selected block by the first block of a Markdown text."""
    at = resolve(doc, selector)
    new = parse(markdown, doc.gfm, skip_frontmatter=False).blocks
    if at is None or not new:
        raise EditError(f"no block {selector}" if at is None else "no block in the replacement")
    doc.replace_block(at, new[0])


def _marker(doc: Document, text: str) -> int | None:
    return next((i for i, b in enumerate(doc.blocks) if b.kind == "html_block" and text in b.content), None)


def replace_section(doc: Document, start: str, end: str, markdown: str) -> None:
    """Replaces what stands between two HTML blocks that contain the markers; the markers stay."""
    first, last = _marker(doc, start), _marker(doc, end)
    if first is None or last is None:
        raise EditError("start marker not found" if first is None else "end marker not found")
    if first >= last:
        raise EditError("the markers are in the wrong order")
    new: list[Block] = parse(markdown, doc.gfm, skip_frontmatter=False).blocks
    doc.blocks[first + 1 : last] = new
