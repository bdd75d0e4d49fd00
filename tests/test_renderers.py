"""Exact output of every renderer, one small input per construct."""

import pytest

from quire.core.blocks import parse
from quire.render import ansi, html, markdown, outline, tree, typst

OUTLINE = [
    ("## Names", 'H2 "Names"\n'),
    ("x *y*", 'P\n . "x "\n E* "y"\n'),
    ("__a__ _b_", 'P\n S_ "a"\n . " "\n E_ "b"\n'),
    ("~~gone~~", 'P\n ~~ "gone"\n'),
    ("1. a\n\n2. b", 'OL=1 loose\n +\n  P "a"\n +\n  P "b"\n'),
    ("- [ ] t", 'UL tight\n +[ ]\n  P "t"\n'),
    ("~~~py\na\nb\n~~~", "F~py\n a\n b\n"),
    ("> a\n> b", 'BQ\n P\n  . "a"\n  NL\n  . "b"\n'),
    ('[*a* b](/u "t")', 'P\n L(/u "t")\n  E* "a"\n  . " b"\n'),
    ("![x](y)", 'P\n I(y) "x"\n'),
    ("<b>q</b>", 'P\n <> "<b>"\n . "q"\n <> "</b>"\n'),
    ("say \\\"hi\\\"", 'P "say \\"hi\\""\n'),
    ("|h|\n|-|\n|`c`|", 'TABLE\n TH "h"\n TR\n  C\n   ` "c"\n'),
    ("[^n]\n\n[^n]: t", 'P\n ^n\nFN=n\n P "t"\n'),
    ("<div>\nx\n</div>", 'HTML "<div>\\nx\\n</div>\\n"\n'),
    ("***", "HR\n"),
    ("a\tb", 'P "a\\tb"\n'),
    ("    a\rb", 'CB "a\\rb"\n'),
    ("", ""),
]


@pytest.mark.parametrize("source, expected", OUTLINE)
def test_outline(source, expected):
    assert outline.render(parse(source)) == expected


TREE = [
    ("### H", 'Document\n└── Heading (level=3)\n    └── Text "H"\n'),
    ("5. a", 'Document\n└── List (ordered, tight, start=5)\n    └── ListItem\n        └── Paragraph\n            └── Text "a"\n'),
    ("a\nb `c`", 'Document\n└── Paragraph\n    ├── Text "a"\n    ├── SoftBreak\n    ├── Text "b "\n    └── CodeSpan "c"\n'),
    ("x" * 70, f'Document\n└── Paragraph\n    └── Text "{"x" * 60}..."\n'),
    ("    é", "Document\n└── CodeBlock (2 bytes)\n"),
    ("|a|\n|-|", 'Document\n└── Table (1 cols)\n    └── Header\n        └── Cell\n            └── Text "a"\n'),
    ("~~s~~ <i>", 'Document\n└── Paragraph\n    ├── Strikethrough\n    │   └── Text "s"\n    ├── Text " "\n    └── HtmlInline "<i>"\n'),
    ("", "Document\n"),
]


@pytest.mark.parametrize("source, expected", TREE)
def test_tree(source, expected):
    assert tree.render(parse(source)) == expected


NORMAL = [
    ("Head\n----", "## Head\n"),
    ("+ a\n+ b", "- a\n- b\n"),
    ("7) a\n8) b", "7. a\n8. b\n"),
    ("___", "---\n"),
    ("    code", "```\ncode\n```\n"),
    ("[x][r]\n\n[r]: </a b> 't'", '[x](</a b> "t")\n'),
    ("a\\*b", "a\\*b\n"),
    ("a & b &amp; c", "a \\& b &amp; c\n"),
    ("`` a`b ``", "`` a`b ``\n"),
    ("- a\n\n  b", "- a\n\n  b\n"),
    ("> - a\n>\n> b", "> - a\n>\n> b\n"),
    ("- a\n- b\n\n* c", "- a\n- b\n\n* c\n"),
    ("www.a.b", "www.a.b\n"),
    ("|a\\|b|\n|:-:|", "| a\\|b |\n|:---:|\n"),
]


@pytest.mark.parametrize("source, expected", NORMAL)
def test_normal_form(source, expected):
    assert markdown.render(parse(source)) == expected


TYPST = [
    ("# A *b*", "= A _b_\n"),
    ("**x** ~~y~~", "*x* #strike[y]\n\n"),
    ("a#b $c @d", "a\\#b \\$c \\@d\n\n"),
    ("[l](/u)", '#link("/u")[l]\n\n'),
    ("![c](i.png)", '#figure(image("i.png"), caption: [c])\n\n'),
    ("![](i.png)", '#image("i.png")\n\n'),
    ("1. a\n   - b", "+ a\n  - b\n\n"),
    ("a\nb", "a b\n\n"),
    ("x[^1]\n\n[^1]: *n*", "x#footnote[_n_]\n\n"),
    ("x[^9]", "x#footnote[9]\n\n"),
    ("<div>\n</div>", ""),
    ("a@b.c", '#link("mailto:a@b.c")[a\\@b.c]\n\n'),
]


@pytest.mark.parametrize("source, expected", TYPST)
def test_typst(source, expected):
    assert typst.render(parse(source)) == expected


def test_typst_document():
    options = typst.Options.from_frontmatter({"title": 'T "x"', "author": ["A", "B"], "toc": "yes", "toc-depth": 2, "papersize": "a5", "titlepage": True, "header-left": "L", "colorlinks": False, "fontsize": 12, "titlepage-rule-height": "x"})
    assert options.author == "A" and options.toc and options.toc_depth == 2 and options.paper == "a5" and not options.colorlinks and options.fontsize == "11pt" and options.titlepage_rule_height == 4
    text = typst.render(parse("# h"), options)
    assert 'title: "T \\"x\\""' in text and "#outline(" in text and "depth: 2" in text and 'paper: "a5"' in text and "[L]," in text and "show link" not in text and text.endswith("= h\n")
    assert "header:" not in typst.render(parse(""), typst.Options(disable_header_and_footer=True))


def test_mermaid_hook():
    source = "```mermaid\ng\n```"
    assert html.render(parse(source), mermaid=lambda s: f"<svg>{s}</svg>") == '<figure class="mermaid-diagram">\n<svg>g</svg></figure>\n'
    assert html.render(parse(source), mermaid=lambda s: 1 / 0) == '<pre><code class="language-mermaid">g\n</code></pre>\n'
    assert html.render(parse(source.replace("mermaid", "zig")), mermaid=lambda s: "no") == '<pre><code class="language-zig">g\n</code></pre>\n'
    assert "image.decode" in typst.render(parse(source), mermaid=lambda s: "<svg/>") and typst.render(parse(source), mermaid=lambda s: 1 / 0).startswith("```mermaid\n")


def test_terminal():
    out = ansi.render(parse("# T\n\n**b** [l](/u)\n\n1. x\n2. y\n\n> q\n\n| a | bb |\n|--:|:-:|\n| 1 | 2 |\n\n---\n"))
    plain = ansi.strip(out)
    assert "\x1b[1m" in out and "\x1b]8;;/u\x1b\\" in out
    assert plain == "# T\n\nb l (/u)\n\n1. x\n2. y\n\n│ q\n\n| a | bb |\n| - | -- |\n| 1 | 2  |\n\n" + "─" * 60 + "\n"
    assert ansi.width("日本") == 4 and ansi.width("e\u0301") == 1
