"""Document trees as flat rows: pre-order numbers, parents and depths instead of nesting."""

from __future__ import annotations

from collections.abc import Callable

from quire.core.blocks import parse
from quire.core.nodes import Block, Document, flatten

BLOCK_FIELDS = [
    ("block_id", "int"), ("parent_id", "int"), ("parent_kind", "string"), ("depth", "int"), ("ordinal", "int"), ("top_index", "int"), ("item_no", "int"),
    ("kind", "string"), ("level", "int"), ("text", "string"), ("content", "string"), ("language", "string"), ("fence_char", "string"), ("fence_length", "int"),
    ("list_type", "string"), ("list_start", "bigint"), ("list_tight", "boolean"), ("task_checked", "boolean"), ("break_char", "string"), ("label", "string"),
    ("n_cols", "int"), ("html_type", "int"), ("last_desc", "int"),
]
INLINE_FIELDS = [
    ("block_id", "int"), ("block_kind", "string"), ("cell_row", "int"), ("cell_col", "int"), ("inline_id", "int"), ("parent_inline", "int"), ("depth", "int"), ("ordinal", "int"),
    ("kind", "string"), ("content", "string"), ("text", "string"), ("marker", "string"), ("url", "string"), ("title", "string"), ("link_type", "string"), ("alt_text", "string"),
    ("is_email", "boolean"), ("is_gfm_www", "boolean"), ("label", "string"), ("in_footnote", "boolean"),
]
CELL_FIELDS = [("block_id", "int"), ("row_no", "int"), ("col_no", "int"), ("align", "string"), ("text", "string")]
LINK_FIELDS = [("label_norm", "string"), ("url", "string"), ("title", "string")]
FIELDS = {"blocks": BLOCK_FIELDS, "inlines": INLINE_FIELDS, "cells": CELL_FIELDS, "link_defs": LINK_FIELDS}


def _ordered(doc: Document):
    """(number, parent number, parent kind, depth, ordinal, item number, in footnote, block) in pre-order."""
    out = []
    stack = [(b, None, None, 0, i, None, False) for i, b in reversed(list(enumerate(doc.blocks)))]
    while stack:
        b, parent, parent_kind, depth, ordinal, item, foot = stack.pop()
        n = len(out)
        out.append((n, parent, parent_kind, depth, ordinal, item, foot, b))
        foot = foot or b.kind == "footnote_definition"
        for i in range(len(b.children) - 1, -1, -1):
            stack.append((b.children[i], n, b.kind, depth + 1, i, i if b.kind == "list" else item if b.kind == "list_item" else None, foot))
    return out


def block_rows(doc: Document, test: Callable[[Block], bool] | None = None):
    """Every block, or those a test of the block with its inlines lets through."""
    nodes = _ordered(doc)
    last = list(range(len(nodes)))
    for n, parent, *_ in reversed(nodes):
        if parent is not None and last[n] > last[parent]:
            last[parent] = last[n]
    for n, parent, parent_kind, depth, ordinal, item, _, b in nodes:
        if test is not None and not test(b):
            continue
        kind = b.kind
        text = flatten(b.inlines) if kind in ("paragraph", "heading") else None
        yield (
            n, parent, parent_kind, depth, ordinal, ordinal if depth == 0 else None, item, kind, b.level, text, b.content, b.language, b.fence_char, b.fence_length,
            b.list_type, b.start, b.tight if kind == "list" else None, b.checked, b.char, b.label, len(b.aligns) if kind == "table" else None, b.html_type, last[n],
        )


def inline_rows(doc: Document):
    for n, *_, foot, b in _ordered(doc):
        if b.kind == "table":
            groups = [(r, c, cell) for r, row in enumerate(b.rows) for c, cell in enumerate(row)]
        else:
            groups = [(None, None, b.inlines)]
        number = 0
        for r, c, inlines in groups:
            stack = [(i, None, 0, k) for k, i in reversed(list(enumerate(inlines)))]
            while stack:
                i, parent, depth, ordinal = stack.pop()
                nested = flatten(i.children) if i.children else None
                yield (n, b.kind, r, c, number, parent, depth, ordinal, i.kind, i.content, nested, None if i.kind == "text" else i.marker, i.url, i.title, i.link_type, i.alt, i.is_email if i.kind == "autolink" else None, i.is_www if i.kind == "autolink" else None, i.label, foot)
                stack.extend((x, number, depth + 1, k) for k, x in reversed(list(enumerate(i.children))))
                number += 1


def cell_rows(doc: Document):
    for n, *_, b in _ordered(doc):
        if b.kind == "table":
            for r, row in enumerate(b.rows):
                for c, cell in enumerate(row):
                    yield n, r, c, b.aligns[c], flatten(cell)


def link_rows(doc: Document):
    for label, (url, title) in doc.refs.items():
        yield label, url, title


ROWS = {"blocks": block_rows, "inlines": inline_rows, "cells": cell_rows, "link_defs": link_rows}


def rows_of(text: str, what: str, gfm: bool = True, skip_frontmatter: bool = True) -> list[tuple]:
    return list(ROWS[what](parse(text, gfm, skip_frontmatter)))
