"""The document tree: blocks and inlines as plain objects, and constructors for building by hand."""

from __future__ import annotations

BLOCK_KINDS = ("paragraph", "heading", "code_block", "fenced_code_block", "blockquote", "list", "thematic_break", "html_block", "footnote_definition", "table")
INLINE_KINDS = ("text", "emphasis", "strong", "strikethrough", "code_span", "link", "image", "autolink", "footnote_reference", "hard_break", "soft_break", "html_in_line")


class Block:
    """One block; ``kind`` decides which of the other fields mean something.

    Containers (blockquote, list, list_item, footnote_definition) have ``children``; paragraphs,
    headings have ``inlines``; a table has ``aligns`` and ``rows`` (row 0 is the header), each a list
    of cells, each a list of inlines.
    """

    __slots__ = ("kind", "children", "inlines", "raw", "level", "content", "language", "fence_char", "fence_length", "list_type", "start", "tight", "checked", "char", "label", "aligns", "rows", "html_type", "_p")

    def __init__(self, kind: str, **fields):
        self.kind = kind
        self.children: list[Block] = []
        self.inlines: list[Inline] = []
        self.raw = self.level = self.content = self.language = self.fence_char = self.fence_length = None
        self.list_type = self.start = self.tight = self.checked = self.char = self.label = self.html_type = self._p = None
        self.aligns: list[str] = []
        self.rows: list[list[list[Inline]]] = []
        for name, value in fields.items():
            setattr(self, name, value)

    def __repr__(self):
        return f"Block({self.kind})"


class Inline:
    __slots__ = ("kind", "children", "content", "marker", "url", "title", "link_type", "alt", "is_email", "is_www", "label", "height")

    def __init__(self, kind: str, content=None, children=None, marker=None, url=None, title=None, link_type=None, alt=None, is_email=False, is_www=False, label=None):
        self.kind, self.content, self.children, self.marker = kind, content, children if children is not None else [], marker
        self.url, self.title, self.link_type, self.alt = url, title, link_type, alt
        self.is_email, self.is_www, self.label = is_email, is_www, label
        self.height = 1 + max((c.height for c in self.children), default=0) if self.children else 0

    def __repr__(self):
        return f"Inline({self.kind}, {self.content or self.children!r})"


class Document:
    """A parsed document: its top-level blocks, link definitions and dialect."""

    __slots__ = ("blocks", "refs", "gfm")

    def __init__(self, blocks=None, refs=None, gfm: bool = True):
        self.blocks: list[Block] = blocks if blocks is not None else []
        self.refs: dict[str, tuple[str, str | None]] = refs or {}
        self.gfm = gfm

    # building and editing -------------------------------------------------------------------------
    def append_block(self, block: Block) -> None:
        self.blocks.append(block)

    def insert_block(self, index: int, block: Block) -> None:
        if not 0 <= index <= len(self.blocks):
            raise IndexError(index)
        self.blocks.insert(index, block)

    def remove_block(self, index: int) -> Block:
        if not 0 <= index < len(self.blocks):
            raise IndexError(index)
        return self.blocks.pop(index)

    def replace_block(self, index: int, block: Block) -> None:
        if not 0 <= index < len(self.blocks):
            raise IndexError(index)
        self.blocks[index] = block

    # in-document queries --------------------------------------------------------------------------
    def of_kind(self, kind: str) -> list[Block]:
        """Top-level blocks of a kind."""
        return [b for b in self.blocks if b.kind == kind]

    def headings(self, level: int | None = None) -> list[Block]:
        return [b for b in self.blocks if b.kind == "heading" and level in (None, b.level)]

    def count(self, kind: str) -> int:
        return len(self.of_kind(kind))

    def paragraphs_with(self, inline_kind: str) -> list[Block]:
        """Top-level paragraphs that have an inline of the kind as a direct child."""
        return [b for b in self.blocks if b.kind == "paragraph" and any(i.kind == inline_kind for i in b.inlines)]

    def links(self) -> list[Inline]:
        """Links that are direct children of paragraphs and headings, also in quotes and list items."""
        out: list[Inline] = []

        def collect(blocks):
            for b in blocks:
                if b.kind in ("paragraph", "heading"):
                    out.extend(i for i in b.inlines if i.kind == "link")
                elif b.kind in ("blockquote", "list", "list_item"):
                    collect(b.children)

        collect(self.blocks)
        return out

    def text_at(self, path: str) -> str | None:
        """``heading[N]``: the first text of the N-th top-level block, if that is a heading."""
        if not (path.startswith("heading[") and path.endswith("]") and path[8:-1].isdigit()):
            return None
        n = int(path[8:-1])
        if n >= len(self.blocks) or self.blocks[n].kind != "heading":
            return None
        first = self.blocks[n].inlines[:1]
        return first[0].content if first and first[0].kind == "text" else None

    def walk(self):
        """Every block in pre-order, list items left out."""
        stack = list(reversed(self.blocks))
        while stack:
            b = stack.pop()
            if b.kind != "list_item":
                yield b
            stack.extend(reversed(b.children))


def text(content: str) -> Inline:
    return Inline("text", content)


def heading(level: int, content: str) -> Block:
    return Block("heading", level=level, inlines=[text(content)])


def paragraph(content: str) -> Block:
    return Block("paragraph", inlines=[text(content)])


def table(header: list[str], body: list[list[str]] = (), aligns: list[str] | None = None) -> Block:
    rows = [[[text(c)] if c else [] for c in r] for r in (header, *body)]
    return Block("table", rows=rows, aligns=aligns or ["none"] * len(header))


def flatten(inlines: list[Inline]) -> str:
    """The plain text of inlines: breaks become blanks, images their alternative text."""
    out: list[str] = []
    stack = list(reversed(inlines))
    while stack:
        i = stack.pop()
        if i.kind in ("text", "code_span"):
            out.append(i.content)
        elif i.kind in ("soft_break", "hard_break"):
            out.append(" ")
        elif i.kind == "image":
            out.append(i.alt or "")
        elif i.kind == "autolink":
            out.append(i.url)
        else:
            stack.extend(reversed(i.children))
    return "".join(out)
