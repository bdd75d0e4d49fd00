"""The document as a tree drawn with box characters."""

from __future__ import annotations

from quire.core.nodes import Block, Document, Inline

CUT = 60  # bytes of a text node that are shown


def _cut(s: str) -> str:
    raw = s.encode("utf-8", "surrogatepass")
    return s if len(raw) <= CUT else raw[:CUT].decode("utf-8", "ignore") + "..."


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def _label(x) -> tuple[str, list]:
    """The line of a node and its children; strings among the children are rows and cells of a table."""
    k = x.kind
    if isinstance(x, Inline):
        plain = {
            "text": lambda: f'Text "{_cut(x.content)}"',
            "code_span": lambda: f'CodeSpan "{x.content}"',
            "image": lambda: f'Image alt="{x.alt}" url="{x.url}"',
            "autolink": lambda: f'Autolink "{x.url}"',
            "footnote_reference": lambda: f"FootnoteRef [{x.label}]",
            "hard_break": lambda: "HardBreak",
            "soft_break": lambda: "SoftBreak",
            "html_in_line": lambda: f'HtmlInline "{x.content}"',
            "emphasis": lambda: f"Emphasis ('{x.marker}')",
            "strong": lambda: f"Strong ('{x.marker}')",
            "strikethrough": lambda: "Strikethrough",
            "link": lambda: f'Link url="{x.url}"',
        }
        return plain[k](), x.children
    if k == "paragraph":
        return "Paragraph", x.inlines
    if k == "heading":
        return f"Heading (level={x.level})", x.inlines
    if k == "code_block":
        return f"CodeBlock ({_size(x.content)} bytes)", []
    if k == "fenced_code_block":
        lang = f' lang="{x.language}"' if x.language else ""
        return f"FencedCodeBlock{lang} ({_size(x.content)} bytes)", []
    if k == "blockquote":
        return "Blockquote", x.children
    if k == "list":
        start = f", start={x.start}" if x.start is not None else ""
        return f"List ({x.list_type}, {'tight' if x.tight else 'loose'}{start})", x.children
    if k == "list_item":
        return "ListItem", x.children
    if k == "thematic_break":
        return f"ThematicBreak ('{x.char}')", []
    if k == "html_block":
        return f"HtmlBlock ({_size(x.content)} bytes)", []
    if k == "footnote_definition":
        return f"FootnoteDefinition [{x.label}]", x.children
    rows = [_Group("Row" if n else "Header", [_Group("Cell", cell) for cell in row]) for n, row in enumerate(x.rows)]
    return f"Table ({len(x.aligns)} cols)", rows


class _Group:
    """A node of the drawing that is none of the document: a table row or cell."""

    __slots__ = ("name", "children")

    def __init__(self, name: str, children: list):
        self.name, self.children = name, children


def render(doc: Document) -> str:
    lines = ["Document"]
    stack: list[tuple[Block | Inline | _Group, str, bool]] = [(b, "", i == 0) for i, b in enumerate(reversed(doc.blocks))]
    while stack:
        node, prefix, last = stack.pop()
        name, children = (node.name, node.children) if isinstance(node, _Group) else _label(node)
        lines.append(prefix + ("└── " if last else "├── ") + name)
        below = prefix + ("    " if last else "│   ")
        stack.extend((c, below, i == 0) for i, c in enumerate(reversed(children)))
    return "\n".join(lines) + "\n"
