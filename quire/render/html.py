"""HTML by the CommonMark reference output, with the GFM extensions and footnotes."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable

from quire.core.nodes import Block, Document, Inline

_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));")
_BACKSLASH = re.compile(r"\\([!\"#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~-])")
_URL_SAFE = re.compile(r"[^A-Za-z0-9_.!~*'();/?:@&=+$,#%-]")
# Tags that GFM does not let through.
FILTERED = ("title", "textarea", "style", "xmp", "iframe", "noembed", "noframes", "script", "plaintext")
_FILTER = re.compile(rf"<(?=/?(?:{'|'.join(FILTERED)})(?:[\s/>]|$))", re.I)


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _decoded(m: re.Match) -> str:
    if m[3]:
        return _html.entities.html5.get(m[3] + ";", m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return "�" if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def decode_entities(s: str) -> str:
    """Character references as their characters; unknown names stay."""
    return _ENTITY.sub(_decoded, s) if "&" in s else s


def unescape(s: str) -> str:
    """Backslash escapes and character references resolved, an escaped ampersand staying literal."""
    if "\\" not in s:
        return decode_entities(s)
    parts, at = [], 0
    for m in _BACKSLASH.finditer(s):
        parts.append(decode_entities(s[at : m.start()]))
        parts.append(m[1])
        at = m.end()
    parts.append(decode_entities(s[at:]))
    return "".join(parts)


def percent_encode(s: str) -> str:
    """Percent-encodes what a URL cannot hold; existing escapes stay."""
    return _URL_SAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), s)


def link_url(raw: str) -> str:
    """A link's destination as it is used: unescaped, decoded, percent-encoded."""
    return percent_encode(unescape(raw))


def filter_tags(s: str) -> str:
    """Disallowed raw HTML: the opening angle of nine tags, open or close, becomes text."""
    return _FILTER.sub("&lt;", s)


def render(doc: Document, mermaid: Callable[[str], str] | None = None) -> str:
    """The document as HTML. ``mermaid`` turns diagram source into SVG; if it fails, the code stays."""
    out: list[str] = []
    _blocks(doc.blocks, out, doc.gfm, mermaid)
    return "".join(out)


def _inline(items: list[Inline], out: list[str], gfm: bool) -> None:
    for i in items:
        kind = i.kind
        if kind == "text":
            out.append(escape(i.content if i.marker == "\\" else decode_entities(i.content)))
        elif kind == "soft_break":
            out.append("\n")
        elif kind == "hard_break":
            out.append("<br />\n")
        elif kind == "code_span":
            out.append(f"<code>{escape(i.content)}</code>")
        elif kind in ("emphasis", "strong", "strikethrough"):
            tag = {"emphasis": "em", "strong": "strong", "strikethrough": "del"}[kind]
            out.append(f"<{tag}>")
            _inline(i.children, out, gfm)
            out.append(f"</{tag}>")
        elif kind == "link":
            out.append(f'<a href="{escape(link_url(i.url))}"{_title(i)}>')
            _inline(i.children, out, gfm)
            out.append("</a>")
        elif kind == "image":
            out.append(f'<img src="{escape(link_url(i.url))}" alt="{escape(decode_entities(i.alt or ""))}"{_title(i)} />')
        elif kind == "autolink":
            lead = "mailto:" if i.is_email else "http://" if i.is_www else ""
            out.append(f'<a href="{lead}{escape(percent_encode(i.url))}">{escape(i.url)}</a>')
        elif kind == "footnote_reference":
            out.append(f'<a href="#fn:{i.label}" class="footnote-ref">{i.label}</a>')
        else:
            out.append(filter_tags(i.content) if gfm else i.content)


def _title(i: Inline) -> str:
    return "" if i.title is None else f' title="{escape(unescape(i.title))}"'


def _cells(row, aligns, tag, out, gfm):
    out.append("<tr>\n")
    for cell, align in zip(row, aligns):
        out.append(f"<{tag}>" if align == "none" else f'<{tag} align="{align}">')
        _inline(cell, out, gfm)
        out.append(f"</{tag}>\n")
    out.append("</tr>\n")


def _blocks(blocks: list[Block], out: list[str], gfm: bool, mermaid) -> None:
    for b in blocks:
        kind = b.kind
        if kind == "paragraph":
            out.append("<p>")
            _inline(b.inlines, out, gfm)
            out.append("</p>\n")
        elif kind == "heading":
            out.append(f"<h{b.level}>")
            _inline(b.inlines, out, gfm)
            out.append(f"</h{b.level}>\n")
        elif kind == "thematic_break":
            out.append("<hr />\n")
        elif kind == "code_block":
            out.append(f"<pre><code>{escape(b.content)}\n</code></pre>\n")
        elif kind == "fenced_code_block":
            if mermaid and b.language in ("mermaid", "mermaidjs"):
                try:
                    out.append(f'<figure class="mermaid-diagram">\n{mermaid(b.content)}</figure>\n')
                    continue
                except Exception:  # any failure of the hook leaves the code block
                    pass
            lang = f' class="language-{escape(unescape(b.language))}"' if b.language else ""
            body = escape(b.content) + "\n" if b.content else ""
            out.append(f"<pre><code{lang}>{body}</code></pre>\n")
        elif kind == "blockquote":
            out.append("<blockquote>\n")
            _blocks(b.children, out, gfm, mermaid)
            out.append("</blockquote>\n")
        elif kind == "list":
            _list(b, out, gfm, mermaid)
        elif kind == "table":
            out.append("<table>\n<thead>\n")
            _cells(b.rows[0], b.aligns, "th", out, gfm)
            out.append("</thead>\n")
            if len(b.rows) > 1:
                out.append("<tbody>\n")
                for row in b.rows[1:]:
                    _cells(row, b.aligns, "td", out, gfm)
                out.append("</tbody>\n")
            out.append("</table>\n")
        elif kind == "footnote_definition":
            out.append(f'<div class="footnote" id="fn:{b.label}">\n')
            for child in b.children:
                if child.kind == "paragraph":
                    out.append(f"<p><b>{b.label}</b>: ")
                    _inline(child.inlines, out, gfm)
                    out.append("</p>\n")
                else:
                    _blocks([child], out, gfm, mermaid)
            out.append("</div>\n")
        elif kind == "html_block":
            out.append(filter_tags(b.content) if gfm else b.content)


def _list(b: Block, out: list[str], gfm: bool, mermaid) -> None:
    tag = "ol" if b.list_type == "ordered" else "ul"
    out.append(f'<ol start="{b.start}">\n' if tag == "ol" and b.start not in (None, 1) else f"<{tag}>\n")
    for item in b.children:
        out.append("<li>")
        box = "" if item.checked is None else '<input checked="" disabled="" type="checkbox"> ' if item.checked else '<input disabled="" type="checkbox"> '
        first = item.children[:1]
        if not b.tight:
            if item.children:
                out.append("\n")
                if box and first[0].kind == "paragraph":
                    out.append("<p>" + box)
                    _inline(first[0].inlines, out, gfm)
                    out.append("</p>\n")
                    _blocks(item.children[1:], out, gfm, mermaid)
                else:
                    _blocks(item.children, out, gfm, mermaid)
        else:
            if first and first[0].kind == "paragraph":
                out.append(box)
            elif item.children:
                out.append("\n")
            inline = False
            for child in item.children:
                if child.kind == "paragraph":
                    _inline(child.inlines, out, gfm)
                    inline = True
                else:
                    if inline:
                        out.append("\n")
                    inline = False
                    _blocks([child], out, gfm, mermaid)
        out.append("</li>\n")
    out.append(f"</{tag}>\n")
