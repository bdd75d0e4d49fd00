"""Typst: the body alone, or a whole document with page setup, title page and contents."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass, fields

from quire.core.nodes import Block, Document, Inline
from quire.meta import values

_ESCAPE = re.compile(r"([\\*_`#$@<\[\]~])")


def escape(s: str) -> str:
    return _ESCAPE.sub(r"\\\1", s)


def literal(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"')


@dataclass
class Options:
    """Settings of a whole document; the defaults are fixed values of the format."""

    title: str | None = None
    subtitle: str | None = None
    author: str | None = None
    date: str | None = None
    paper: str = "a4"
    lang: str = "en"
    fontsize: str = "11pt"
    titlepage: bool = False
    titlepage_color: str = "1E3A5F"
    titlepage_text_color: str = "FFFFFF"
    titlepage_rule_color: str = "AAAAAA"
    titlepage_rule_height: int = 4
    disable_header_and_footer: bool = False
    header_left: str | None = None
    header_center: str | None = None
    header_right: str | None = None
    footer_left: str | None = None
    footer_center: str | None = None
    footer_right: str | None = None
    toc: bool = False
    toc_title: str = "Contents"
    toc_depth: int = 3
    numbersections: bool = False
    colorlinks: bool = True
    linkcolor: str = "A50000"
    urlcolor: str = "4077C0"

    @classmethod
    def from_frontmatter(cls, root) -> Options:
        """Options from frontmatter fields named with dashes; ``papersize`` (or ``paper``) is the paper.

        Values of the wrong type are ignored; yes and no count as booleans, and of a list of authors
        the first counts.
        """
        out = cls()
        for f in fields(cls):
            found = values.find(root, f.name.replace("_", "-"))
            if f.name == "paper":
                size = values.find(root, "papersize")
                found = found if size is values.MISSING else size
            if f.name == "author" and isinstance(found, list) and found:
                found = found[0]
            default = f.default
            if isinstance(default, bool):
                found = {"true": True, "yes": True, "false": False, "no": False}.get(found, found) if isinstance(found, str) else found
                ok = isinstance(found, bool)
            elif isinstance(default, int):
                ok = isinstance(found, int) and not isinstance(found, bool) and found >= 0
            else:
                ok = isinstance(found, str)
            if ok:
                setattr(out, f.name, found)
        return out


class _Writer:
    def __init__(self, doc: Document, mermaid: Callable[[str], str] | None):
        # Of several definitions of a label the last counts, and only those at the top level.
        self.notes = {b.label: b for b in doc.blocks if b.kind == "footnote_definition"}
        self.mermaid, self.inside = mermaid, []

    def inlines(self, items: list[Inline]) -> str:
        return "".join(map(self.inline, items))

    def inline(self, i: Inline) -> str:
        k = i.kind
        if k == "text":
            return escape(i.content)
        if k == "soft_break":
            return " "
        if k == "hard_break":
            return "\\\n"
        if k == "code_span":
            return f"`{i.content}`" if "`" not in i.content else f'#raw("{literal(i.content)}")'
        if k in ("emphasis", "strong"):
            mark = "_" if k == "emphasis" else "*"
            return mark + self.inlines(i.children) + mark
        if k == "strikethrough":
            return f"#strike[{self.inlines(i.children)}]"
        if k == "link":
            return f'#link("{literal(i.url)}")[{self.inlines(i.children)}]'
        if k == "image":
            caption = i.title if i.title is not None else i.alt
            image = f'image("{literal(i.url)}")'
            return f"#figure({image}, caption: [{escape(caption or '')}])" if i.title or i.alt else f"#{image}"
        if k == "autolink":
            lead = "mailto:" if i.is_email else "http://" if i.is_www else ""
            return f'#link("{lead}{literal(i.url)}")[{escape(i.url)}]'
        if k == "footnote_reference":
            note = self.notes.get(i.label)
            if note is None or i.label in self.inside:  # a note that refers to itself ends here
                return f"#footnote[{escape(i.label)}]"
            self.inside.append(i.label)
            body = "".join(self.inlines(c.inlines) if c.kind == "paragraph" else self.block(c) for c in note.children)
            self.inside.pop()
            return f"#footnote[{body}]"
        return ""

    def block(self, b: Block) -> str:
        k = b.kind
        if k == "heading":
            return f"{'=' * b.level} {self.inlines(b.inlines)}\n"
        if k == "paragraph":
            return self.inlines(b.inlines) + "\n\n"
        if k == "thematic_break":
            return '#line(length: 100%, stroke: rgb("#999999"))\n\n'
        if k == "code_block":
            return f"```\n{b.content}\n```\n\n"
        if k == "fenced_code_block":
            if self.mermaid and b.language in ("mermaid", "mermaidjs"):
                try:
                    data = base64.b64encode(self.mermaid(b.content).encode()).decode()
                    return f'#image.decode(bytes.fromBase64("{data}"), format: "svg", width: 100%)\n\n'
                except Exception:  # any failure of the hook leaves the code block
                    pass
            return f"```{b.language or ''}\n{b.content + chr(10) if b.content else ''}```\n\n"
        if k == "blockquote":
            inner = "".join((self.inlines(c.inlines) if c.kind == "paragraph" else self.block(c)) + "\n" for c in b.children)
            style = 'inset: (left: 12pt, top: 4pt, bottom: 4pt),\n  stroke: (left: (thickness: 3pt, paint: rgb("#DDDDDD"))),\n  text(fill: rgb("#777777"))'
            return f"#block(\n  {style}[\n{inner}])\n\n"
        if k == "list":
            return self.list(b, 0) + "\n"
        if k == "table":
            return self.table(b)
        return ""

    def list(self, b: Block, depth: int) -> str:
        out = []
        for item in b.children:
            box = "" if item.checked is None else "[x] " if item.checked else "[ ] "
            out.append("  " * depth + ("+ " if b.list_type == "ordered" else "- ") + box)
            for n, c in enumerate(item.children):
                if c.kind == "paragraph":
                    out.append(("  " * (depth + 1) if n else "") + self.inlines(c.inlines) + ("\n" if b.tight else "\n\n"))
                    continue
                if n == 0:
                    out.append("\n")
                out.append(self.list(c, depth + 1) if c.kind == "list" else self.block(c))
        return "".join(out)

    def table(self, b: Block) -> str:
        aligns = ", ".join("auto" if a == "none" else a for a in b.aligns)
        head = "".join(f"    [*{self.inlines(c)}*],\n" for c in b.rows[0])
        body = "".join(f"  [{self.inlines(c)}],\n" for row in b.rows[1:] for c in row)
        return f'#table(\n  columns: {len(b.aligns)},\n  align: ({aligns}),\n  stroke: rgb("#999999"),\n  table.header(\n{head}  ),\n{body})\n\n'


def _strip(left: str, center: str, right: str) -> str:
    grid = '    #set text(size: 9pt, fill: rgb("#777777"))\n    #grid(\n      columns: (1fr, 1fr, 1fr),\n      align: (left, center, right),\n'
    return f"[\n{grid}[{left}],\n[{center}],\n[{right}],\n    )\n  ],\n"


# Styles every document gets.
_STYLES = """#show raw: set text(font: ("Source Code Pro", "Courier New", "monospace"))

#show raw.where(block: true): it => block(
  fill: rgb("#F7F7F7"),
  inset: 10pt,
  radius: 4pt,
  width: 100%,
  stroke: 0.5pt + rgb("#DDDDDD"),
  it,
)

#show heading: it => {
  set text(fill: rgb("#282828"))
  it
}

"""
_CAPTIONS = """#show figure.caption: it => {
  set text(fill: rgb("#777777"), size: 9pt)
  it
}

"""


def preamble(o: Options) -> str:
    pick = lambda *texts: escape(next((t for t in texts if t is not None), ""))
    named = "".join(f'  {name}: "{literal(value)}",\n' for name, value in (("title", o.title), ("author", o.author)) if value is not None)
    out = [f"#set document(\n{named})\n\n", f'#set page(\n  paper: "{o.paper}",\n  margin: (x: 2.5cm, y: 2.5cm),\n']
    if not o.disable_header_and_footer:
        out.append("  header: " + _strip(pick(o.header_left, o.title), pick(o.header_center), pick(o.header_right, o.date)))
        page = '#context counter(page).display("1")' if o.footer_right is None else escape(o.footer_right)
        out.append("  footer: " + _strip(pick(o.footer_left, o.author), pick(o.footer_center), page))
    out.append(f')\n\n#set text(\n  font: ("Source Sans Pro", "Helvetica", "Arial"),\n  size: {o.fontsize},\n  lang: "{o.lang}",\n)\n\n{_STYLES}')
    if o.numbersections:
        out.append('#set heading(numbering: "1.")\n\n')
    if o.colorlinks:
        out.append(f'#show link: set text(fill: rgb("#{o.linkcolor}"))\n\n')
    out.append(_CAPTIONS)
    if o.titlepage:
        out.append(_title_page(o))
    if o.toc:
        out.append(f'#outline(\n  title: "{literal(o.toc_title)}",\n  depth: {o.toc_depth},\n)\n\n')
    return "".join(out)


def _title_page(o: Options) -> str:
    line = lambda size, text, extra="": "" if text is None else f"        #text(size: {size}pt{extra})[{escape(text)}]\n\n"
    rule = f'        #line(length: 100%, stroke: {o.titlepage_rule_height}pt + rgb("#{o.titlepage_rule_color}"))\n\n'
    inner = line(36, o.title, ', weight: "bold"') + line(24, o.subtitle) + rule + line(18, o.author) + line(14, o.date)
    return (
        f'#page(\n  margin: (x: 0cm, y: 0cm),\n  header: none,\n  footer: none,\n)[\n  #rect(width: 100%, height: 100%, fill: rgb("#{o.titlepage_color}"))[\n'
        f'    #set text(fill: rgb("#{o.titlepage_text_color}"))\n    #align(horizon)[\n      #pad(left: 2.5cm, right: 2.5cm)[\n{inner}      ]\n    ]\n  ]\n]\n\n'
    )


def render(doc: Document, options: Options | None = None, mermaid: Callable[[str], str] | None = None) -> str:
    """The document's body, or with ``options`` the whole document. Footnotes expand where they are used."""
    w = _Writer(doc, mermaid)
    return ("" if options is None else preamble(options)) + "".join(map(w.block, doc.blocks))
