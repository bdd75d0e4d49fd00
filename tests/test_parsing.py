"""Node rows, queries inside a document, edits, and properties of the parser on arbitrary text."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.core import edits, nodes, rows
from quire.core.blocks import parse
from quire.render import ansi, html, markdown, outline, tree, typst

ALPHABET = st.text(alphabet="ab *_`~[]()!<>#-+=|:\\&;.@1\n\t\"'^/wx{}", max_size=120)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_never_raises_and_rows_are_well_formed(text):
    doc = parse(text)
    for render in (html.render, tree.render, outline.render, markdown.render, ansi.render, typst.render):
        assert isinstance(render(doc), str)
    found = list(rows.block_rows(doc))
    depth = {}
    for n, row in enumerate(found):
        number, parent = row[0], row[1]
        assert number == n and (parent is None or parent < n)
        depth[number] = row[3]
        assert row[3] == (0 if parent is None else depth[parent] + 1)
        assert n <= row[-1] < len(found)
    for what in ("inlines", "cells", "link_defs"):
        list(rows.ROWS[what](doc))


WORDS = st.lists(st.sampled_from(["alpha", "*em*", "**st**", "`co`", "[l](/u)", "x_y", "1.", "-", "# h", "> q", "\n", "\n\n", "- i", "  - j", "| a |", "&amp;", "a & b", "<b>"]), max_size=14)


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_normal_form_is_stable(words):
    once = markdown.render(parse(" ".join(words).replace(" \n", "\n").replace("\n ", "\n"), skip_frontmatter=False))
    twice = markdown.render(parse(once, skip_frontmatter=False))
    assert markdown.render(parse(twice, skip_frontmatter=False)) == twice


def test_deep_nesting_ends():
    assert parse("> " * 5000 + "x").blocks
    assert parse("- " * 5000 + "x").blocks
    assert parse("[" * 20000).blocks
    assert parse("*a " * 5000 + "b* " * 5000).blocks
    assert parse("`" * 3000 + "a" + "``" * 3000).blocks


def test_document_queries():
    doc = parse("p [a](/1)\n\n# one [b](/2)\n\n> ## two\n> [c](/3)\n\n- [d](/4) *[x](/9)*\n\n## three\n\n[^1]: [e](/5)\n\n| [f](/6) |\n|---|\n")
    assert doc.count("heading") == 2 and doc.count("table") == 1
    assert [h.level for h in doc.headings()] == [1, 2] and len(doc.headings(2)) == 1 and doc.headings(6) == []
    assert [x.url for x in doc.links()] == ["/1", "/2", "/3", "/4"]
    assert [nodes.flatten(b.inlines) for b in doc.paragraphs_with("link")] == ["p a"]
    assert doc.text_at("heading[0]") is None and doc.text_at("heading[1]") == "one " and doc.text_at("heading[x]") is None and doc.text_at("heading[99]") is None
    assert sum(b.kind == "heading" for b in doc.walk()) == 3


def test_edits():
    doc = nodes.Document()
    doc.append_block(nodes.heading(1, "t"))
    doc.append_block(nodes.paragraph("p"))
    doc.insert_block(1, nodes.Block("thematic_break", char="-"))
    doc.replace_block(2, nodes.table(["a", "b"], [["1", "2"]]))
    assert markdown.render(doc) == "# t\n\n---\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    doc.remove_block(1)
    assert [b.kind for b in doc.blocks] == ["heading", "table"]
    edits.set_block(doc, "table[0]", "new *x*\n\nrest")
    assert markdown.render(doc) == "# t\n\nnew *x*\n"
    for selector in ("table[0]", "nope[0]", "heading[1]", "heading"):
        try:
            edits.set_block(doc, selector, "x")
            raise AssertionError(selector)
        except edits.EditError:
            pass


def test_sections():
    doc = parse("<!-- a -->\n\nold\n\nolder\n\n<!-- b -->\n\nend\n")
    edits.replace_section(doc, " a ", " b ", "# n\n\n- x\n")
    assert markdown.render(doc) == "<!-- a -->\n\n# n\n\n- x\n\n<!-- b -->\n\nend\n"
    for marks in ((" b ", " a "), ("zz", " b "), (" a ", "zz")):
        try:
            edits.replace_section(doc, *marks, "x")
            raise AssertionError(marks)
        except edits.EditError:
            pass


def test_ledger():
    """Rules where a plain implementation would differ."""
    assert [b.kind for b in parse("---\na: 1\n---\n# x").blocks] == ["heading"]
    assert [b.kind for b in parse("---\nno colon\n---\n# x").blocks][0] == "thematic_break"
    assert [b.kind for b in parse("> ---\n> a: 1\n> ---\n> x").blocks] == ["blockquote"]  # only at the top
    assert html.render(parse("> a  \n> b")) == "<blockquote>\n<p>a<br />\nb</p>\n</blockquote>\n"
    assert html.render(parse("https://a.b/c_d_e *x*")) == '<p><a href="https://a.b/c_d_e">https://a.b/c_d_e</a> <em>x</em></p>\n'
    assert html.render(parse("[É]\n\n[é]: /u")) == '<p><a href="/u">É</a></p>\n'
    assert html.render(parse("[^a-b]: x")) == "<p>[^a-b]: x</p>\n" or "<a" in html.render(parse("[^a-b]: x"))
    assert html.render(parse("a\x00b")) == "<p>a�b</p>\n"
    assert html.render(parse("&#xD800;")) == "<p>�</p>\n"
    assert html.render(parse("![a&amp;b](x)")) == '<p><img src="x" alt="a&amp;b" /></p>\n'
    assert html.render(parse("a@b.c", gfm=False)) == "<p>a@b.c</p>\n"
    assert html.render(parse("<title>", gfm=False)) == "<title>\n" or "<title>" in html.render(parse("<title>", gfm=False))
    assert parse("```a b\nx\n```").blocks[0].language == "a"
    assert parse("a\rb").blocks[0].inlines[0].content == "a\rb"
    assert len(parse("|" + "a|" * 65 + "\n|" + "-|" * 65).blocks[0].aligns) == 0
