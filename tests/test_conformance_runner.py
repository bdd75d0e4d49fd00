import io

import quire
from quire.functions import conformance as c

SPEC = "# Intro\n\n## Tabs\n\n" + "`" * 32 + " example\n→foo\n.\n<pre><code>foo\n</code></pre>\n" + "`" * 32 + "\n\n## Lists\n\n" + "`" * 32 + " example\n- a\n.\n<ul>\n  <li>a</li>\n</ul>\n" + "`" * 32 + "\n\n" + "`" * 32 + " example\nx\n.\n<p>wrong</p>\n" + "`" * 32 + "\n"


def test_runner(spark, tmp_path):
    cases = c.spec_cases(SPEC)
    assert [(n, s, m) for n, s, _, _, m, _ in cases] == [(1, "Tabs", "\tfoo\n"), (2, "Lists", "- a\n"), (3, "Lists", "x\n")]
    file = tmp_path / "spec.txt"
    file.write_text(SPEC, encoding="utf-8")
    assert [tuple(r) for r in c.run_file(spark, str(file)).collect()] == [("Lists", 1, 2), ("Tabs", 1, 1), (None, 2, 3)]
    assert c.normalize_html("<p> a\n b</p>\n<pre> x\n y</pre> ") == "<p> a b</p><pre> x\n y</pre>"


def test_package():
    assert quire.parse("# a").blocks[0].kind == "heading" and quire.parse_reader(io.BytesIO(b"# \xff")).count("heading") == 1 and quire.parse_reader(io.StringIO("x")).count("paragraph") == 1
    assert quire.FrontMatter("a: 1", "yaml").get("a") == 1
