"""Collection queries on Spark: selectors, filters, sorting, node tables, files, streams."""

import os

import pytest
from pyspark.sql import functions as F

from quire.functions import frontmatter as fmf
from quire.functions import parsing, rendering, text
from quire.operators import edit
from quire.operators.library import Library
from quire.plans import selectors
from quire.sources.markdown_files import markdown_files, write_markdown
from quire.streaming import ingest

A = '---\ntitle: "A"\nextra:\n  owner: ops\n  n: 1\n  f: 1.0\n  nul:\n  nest: [[a, [b]], c]\nrefs:\n  X: ["x-1", "x-2"]\n---\n## Head\n\npara [l](/u)\n\n> ### quoted\n\n- item\n\n```py\nx\n```\n'
DOCS = [(1, 0, "a.md", A), (2, 1, "b.md", "# plain\n"), (3, 2, None, '{"title": "J", "draft": true, "extra": {"n": 2.5}}\n# j *x*'), (4, 3, "d.md", "+++\nbroken\n+++\nx"), (5, 4, "e.md", None), (6, 5, "f.md", "")]


@pytest.fixture(scope="module")
def lib(spark):
    return Library.from_rows(spark.createDataFrame(DOCS, "doc_id bigint, doc_seq bigint, path string, source string"))


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_selector_language():
    p = selectors.parse("a.b=1 \t@heading c @table d==x e=")
    assert p.filters == [selectors.Filter("a.b", "1"), selectors.Filter("c"), selectors.Filter("d", "=x"), selectors.Filter("e", "")] and p.kind == "table" and p.selects_blocks
    assert selectors.parse("@x").selects_blocks and selectors.parse("@x").kind is None and selectors.parse(" ").filters == []
    many = " ".join(f"f{i}" for i in range(30))
    assert len(selectors.parse(many).filters) == 30 and len(selectors.parse(many, max_filters=16).filters) == 16
    assert selectors.parse("a\nb").filters == [selectors.Filter("a\nb")]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("", [1, 2, 3, 4, 5, 6]), ("title", [1, 3]), ("title=J", [3]), ("extra.owner=ops", [1]), ("extra.n=1", [1]), ("extra.n=2.5", [3]), ("extra.f=1", [1]), ("extra.f=1.0", []),
        ("extra.nul", [1]), ("extra.nul=null", [1]), ("extra.nest=b", [1]), ("extra.nest=c", [1]), ("extra.nest=d", []), ("refs.X=x-2", [1]), ("draft=true", [3]), ("extra=x", []),
        ("extra..owner=ops", [1]), (".", [1, 3]), ("title extra.n=1", [1]), ("missing", []), ("=x", []), ("title=", []),
    ],
)
def test_filters(lib, query, expected):
    assert ids(lib.query(query)) == expected


def test_blocks(lib):
    rows = lib.query("@heading").collect()
    assert [(r["doc_id"], r["level"], r["text"]) for r in rows] == [(1, 2, "Head"), (1, 3, "quoted"), (2, 1, "plain"), (3, 1, "j x")]
    assert [r["language"] for r in lib.query("@fenced_code_block title").collect()] == ["py"]
    assert lib.query("@nope").count() == 0 and lib.query("@table").count() == 0
    assert rows[0]["confidence"] == 1.0
    stored = lib.store_nodes()
    assert stored.query("@heading").collect() == rows


def test_filter_runs_before_the_parse(lib):
    plan = lib.query("extra.owner=ops @heading")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("ArrowEvalPython") and plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_sorting(spark):
    rows = [(i, i, None, f"---\nk: {v}\n---\nx") for i, v in enumerate(["b", "2", '"10"', "1.5", "[1]", "a"])] + [(9, 9, None, "no")]
    lib = Library.from_rows(spark.createDataFrame(rows, "doc_id bigint, doc_seq bigint, path string, source string"))
    found = lib.query("")
    assert ids(Library.sort_by(found, "k")) == [2, 5, 0, 3, 1, 4, 9]
    assert ids(Library.sort_by(found, "k", ascending=False)) == [4, 1, 3, 0, 5, 2, 9]
    assert ids(Library.sort_by(found, "k", ascending=False, nulls="reference"))[0] == 9


def test_document_queries(lib):
    assert {(r["doc_id"], r["kind"], r["n"]) for r in lib.count("heading").collect()} == {(1, "heading", 1), (2, "heading", 1), (3, "heading", 1)}
    assert [r["url"] for r in lib.links().collect()] == ["/u"]
    assert {(r["doc_id"], r["text"]) for r in lib.text_at("heading[0]").collect()} == {(1, "Head"), (2, "plain"), (3, "j ")}
    assert lib.text_at("x").count() == 0 and lib.headings(1).count() == 2
    assert [r["text"] for r in lib.paragraphs_with("link").collect()] == ["para l"]
    assert [r["kind"] for r in lib.nth("block", 2).where("doc_id = 1").collect()] == ["blockquote"]


def test_errors_and_modes(spark, lib):
    assert [r["doc_id"] for r in lib.docs.where("fm_error is not null").collect()] == [4]
    frame = spark.createDataFrame(DOCS[3:4], "doc_id bigint, doc_seq bigint, path string, source string")
    with pytest.raises(Exception, match="toml"):
        Library.from_rows(frame, on_error="failfast").docs.select("fm_error").collect()
    json_doc = spark.createDataFrame([(1, 1, None, '{"a": 1}\n# x')], "doc_id bigint, doc_seq bigint, path string, source string")
    assert Library.from_rows(json_doc, strip="library").query("@paragraph").count() == 1 and Library.from_rows(json_doc).query("@paragraph").count() == 0


def test_building(spark):
    lib = Library.empty(spark)
    assert lib.query("").count() == 0 and lib.query("@heading").count() == 0
    lib = lib.add("# one", "1.md").add("# two")
    assert [(r["doc_seq"], r["path"], r["text"]) for r in lib.query("@heading").collect()] == [(0, "1.md", "one"), (1, None, "two")]
    both = lib.union(lib)
    assert [r["text"] for r in both.query("@heading").collect()] == ["one", "two", "one", "two"] and both.docs.select("doc_id").distinct().count() == 4
    assert [r["path"] for r in both.changed(lib.docs.where("path is null").select("path", "content_hash")).collect()] == ["1.md", "1.md"]


def test_locations(tmp_path):
    from quire.sources.markdown_files import local_path

    assert [local_path(x) for x in ("/a/b", "file:/a/b", "file:///a/b", "a", "a:b")] == ["/a/b", "/a/b", "/a/b", "a", "a:b"]
    with pytest.raises(ValueError):
        local_path("s3a://bucket/a")


def test_node_tables(spark, lib):
    tables = parsing.node_tables(lib.docs.where("body is not null"), "doc_id", "body")
    assert set(tables) == {"blocks", "inlines", "cells", "link_defs"}
    assert sorted(tables["blocks"].collect()) == sorted(lib.nodes().collect())
    frame = spark.createDataFrame([(1, "x" * 100, "k")], "id int, text string, kind string")
    limited = Library.from_column(frame, "id", "text", max_bytes=50)
    assert limited.docs.first()["parse_error"] == "larger than 50 bytes" and limited.nodes().count() == 0 and limited.text_at("heading[0]").count() == 0
    assert parsing.nodes(frame.drop("kind"), "id", "text").count() == 1
    with pytest.raises(ValueError):
        parsing.nodes(frame, "id", "text", keep=["kind"])


def test_column_functions(spark):
    df = spark.createDataFrame([(1, "---\na: 1\n---\n# h"), (2, "# n"), (3, None)], "id int, s string")
    out = {r["id"]: r for r in df.select("id", fmf.edit(F.col("s"), sets=["b=x", "bad", "a.c=1"], deletes=["a"]).alias("e"), rendering.normalize(F.col("s")).alias("n"), rendering.render(F.col("s"), "ai").alias("r")).collect()}
    assert out[1]["e"] == "---\nb: x\n---\n\n# h" and out[2]["e"] == "# n" and out[3]["e"] is None and out[1]["n"] == "---\na: 1\n---\n\n# h\n" and out[3]["n"] is None and out[2]["r"] == 'H1 "n"\n'
    rendering.register_renderer("count", lambda doc: str(len(doc.blocks)))
    assert [r[0] for r in df.select(rendering.render(F.col("s"), "count")).collect()][1] == "1"
    s = spark.createDataFrame([("<a & \"b\">", "\x1b[1mx\x1b[0m \x1b]8;;u\x1b\\y\x1b]8;;\x1b\\", "p/I.PNG", "a\nb\n"), (None, None, None, None)], "h string, a string, p string, l string")
    row = s.select(text.html_escape("h"), text.strip_ansi("a"), text.is_image("p"), text.line_count(F.col("l"))).first()
    assert tuple(row) == ("&lt;a &amp; &quot;b&quot;&gt;", "x y", True, 2)


def test_table_edits(spark):
    blocks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, top_index int, text string")
    new = spark.createDataFrame([(1, "N"), (2, "N"), (3, "N")], "doc_id int, text string")
    order = lambda df: [(r["doc_id"], r["top_index"], r["text"]) for r in df.orderBy("doc_id", "top_index").collect()]
    assert order(edit.append_block(blocks, new)) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "N"), (2, 0, "c"), (2, 1, "N"), (3, 0, "N")]
    assert order(edit.insert_block(blocks, new, 1)) == [(1, 0, "a"), (1, 1, "N"), (1, 2, "b"), (2, 0, "c"), (2, 1, "N"), (3, 0, "N")]
    assert order(edit.remove_block(blocks, 0)) == [(1, 0, "b")]
    assert order(edit.replace_block(blocks, new, 1)) == [(1, 0, "a"), (1, 1, "N"), (2, 0, "c")]
    assert order(edit.renumber(blocks.where("text <> 'a'"))) == [(1, 0, "b"), (2, 0, "c")]


def test_files(spark, tmp_path):
    for name, body in (("a.md", b"# a"), ("_index.md", b"# i"), ("notes.txt", b"no"), ("sub/.hid/x.md", b"# \xff"), ("sub/Y.MD", b"no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    lib = Library.empty(spark).add_dir(str(tmp_path))
    assert sorted(r["text"] for r in lib.query("@heading").collect()) == ["a", "i", "�"]
    assert Library.empty(spark).add_dir(str(tmp_path / "none")).docs.count() == 0
    with pytest.raises(Exception, match="larger"):
        markdown_files(spark, str(tmp_path), maxbytes="2").collect()
    assert markdown_files(spark, str(tmp_path), maxbytes="2", keep_errors=True).where("error is not null").count() == 3
    out = tmp_path / "out"
    write_markdown(spark.createDataFrame([("p/q.md", "é"), ("r.md", None)], "path string, text string"), str(out))
    assert (out / "p/q.md").read_text() == "é" and (out / "r.md").read_text() == "" and not [n for n in os.listdir(out) if n.endswith(".part")]
    with pytest.raises(Exception, match="leads out"):
        write_markdown(spark.createDataFrame([("../x.md", "a")], "path string, text string"), str(out))


def test_stream(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, text string")
    frame([(1, "# a"), (2, "b")]).write.parquet(source)
    stream = lambda: ingest.store_stream(spark.readStream.schema("id bigint, text string").parquet(source), "id", "text", target, check)
    stream().awaitTermination()
    frame([(3, "# c\n\nd")]).write.mode("append").parquet(source)
    stream().awaitTermination()
    stream().awaitTermination()
    assert sorted((r["id"], r["kind"]) for r in spark.read.parquet(target).collect()) == [(1, "heading"), (2, "paragraph"), (3, "heading"), (3, "paragraph")]


def test_stream_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT 1L AS id, '# a\n\nb' AS text, timestamp'2025-01-01 00:10:00' AS ts UNION ALL SELECT 2L, '# c', timestamp'2025-01-01 01:10:00'").write.parquet(source)
    docs = spark.readStream.schema("id bigint, text string, ts timestamp").parquet(source)
    counts = ingest.kinds_per_window(ingest.parse_stream(docs, "id", "text", keep=["ts"]), "ts")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("kinds").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sql("SELECT hour(window.start) AS h, kind, n FROM kinds").collect()
    assert sorted(map(tuple, rows)) == [(0, "heading", 1), (0, "paragraph", 1), (1, "heading", 1)]
