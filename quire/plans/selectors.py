"""The selector language of collection queries: ``path``, ``path=value`` and ``@kind``, all ANDed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quire.core.nodes import BLOCK_KINDS

#: What a source must contain for a block kind to occur in it; may match too much, never too little.
NEEDLES = {
    "heading": r"#|(?m)^.*[=-]",
    "fenced_code_block": r"```|~~~",
    "blockquote": r">",
    "table": r"\|",
    "html_block": r"<",
    "footnote_definition": r"\[\^",
    "thematic_break": r"[*_-]",
    "list": r"[*+-]|\d[.)]",
    "code_block": r"    |\t",
}


@dataclass(frozen=True)
class Filter:
    """``value`` is None for an existence test."""

    path: str
    value: str | None = None


@dataclass
class Selector:
    """A parsed query: filters on frontmatter, and optionally the kind of blocks to return."""

    filters: list[Filter] = field(default_factory=list)
    selects_blocks: bool = False
    kind: str | None = None  # None with selects_blocks: a kind that does not exist


def parse(query: str, max_filters: int | None = None) -> Selector:
    """Tokens are separated by blanks and tabs only. Of several ``@kind`` the last counts; ``path=``
    compares with the empty text. All filters count; 16 for ``max_filters`` drops those beyond the
    sixteenth, as some readers of the language do."""
    out = Selector()
    for token in re.split(r"[ \t]+", query):
        if not token:
            continue
        if token[0] == "@":
            out.selects_blocks = True
            out.kind = token[1:] if token[1:] in BLOCK_KINDS else None
        elif max_filters is None or len(out.filters) < max_filters:
            path, eq, value = token.partition("=")
            out.filters.append(Filter(path, value if eq else None))
    return out
