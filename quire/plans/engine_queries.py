"""Queries of sources, sinks, builders, options and the rarer rules, each with SQL that writes down what
must come out. The Markdown is made from table rows."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import conformance, parsing, rendering, text
from quire.functions import frontmatter as fmf
from quire.operators.library import Library
from quire.plans import fixtures as fx
from quire.runtime import shared_dir, spread, table

QUERIES, ORACLE = {}, {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _parts(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "part"))


def _made(spark, sf_dir, *pieces) -> DataFrame:
    """part rows with a source put together from columns and literals (what is no column name)."""
    columns = {"p_name", "p_type", "p_size", "p_brand", "p_partkey"}
    return _parts(spark, sf_dir).select("p_partkey", F.concat(*[F.col(p).cast("string") if p in columns else F.lit(p) for p in pieces]).alias("source"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources and sinks -------------------------------------------------------------------------------


@_query("SELECT CASE WHEN entry_id % 2 = 0 THEN '_index/' ELSE '.hidden/' END || entry_id || '.md' AS name, strlen(document)::BIGINT AS n_bytes, document FROM entries")
def s3_files(spark, sf_dir):
    """Every entry written as a file and read back, names that begin with underscores and dots included."""
    from quire.sources.markdown_files import markdown_files, utf8, write_markdown

    name = F.concat(F.when(F.col("entry_id") % 2 == 0, "_index/").otherwise(".hidden/"), F.col("entry_id").cast("string"), F.lit(".md"))
    root = _folder(spark, "files")
    write_markdown(table(spark, sf_dir, "entries").select(name.alias("path"), F.col("document").alias("text")), root)
    files = markdown_files(spark, root)
    return files.select(F.substring_index("path", "/", -2).alias("name"), F.octet_length("content").cast("bigint").alias("n_bytes"), utf8(F.col("content")).alias("document"))


@_query("SELECT entry_id, fence_char, fence_length, language FROM code_blocks")
def s4_stream(spark, sf_dir):
    """The fenced code of the entries, parsed from a stream into stored nodes."""
    from quire.streaming.ingest import store_stream

    path = f"{sf_dir}/entries.parquet"
    one_file = all(f.endswith("/entries.parquet") for f in spark.read.parquet(path).inputFiles())  # a stream reads folders
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    docs = source.option("pathGlobFilter", "entries.parquet").parquet(sf_dir) if one_file else source.parquet(path)
    target = _folder(spark, "stream")
    store_stream(docs, "entry_id", "document", target, _folder(spark, "stream-checkpoint"), skip_frontmatter=False).awaitTermination()
    return spark.read.parquet(target).where("kind = 'fenced_code_block'").select("entry_id", "fence_char", "fence_length", "language")


@_query("SELECT c_custkey, 1::BIGINT AS n_blocks, 4::BIGINT AS n_inlines, 0::BIGINT AS n_cells, 1::BIGINT AS n_defs, c_name AS link_text FROM customer")
def s6_parsed(spark, sf_dir):
    """All node tables of a document from one parse: a paragraph of text, link (with its text), text."""
    one = parsing.parsed(fx.cards(spark, sf_dir), "doc_id", "source")
    n = lambda c: F.size(c).cast("bigint")
    link = F.get(F.filter("inlines", lambda i: i["kind"] == "link"), 0)["text"]
    return one.select(F.col("doc_id").alias("c_custkey"), n("blocks").alias("n_blocks"), n("inlines").alias("n_inlines"), n("cells").alias("n_cells"), n("link_defs").alias("n_defs"), link.alias("link_text"))


@_query("""SELECT p_partkey, '<h2>' || p_name || '</h2>' || chr(10) || '<p>' || p_type || '</p>' || chr(10) || '<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || '<th>size</th>' || chr(10)
 || '</tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr>' || chr(10) || '<td>' || p_size || '</td>' || chr(10) || '</tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10) AS html FROM part""")
def s9_builders(spark, sf_dir):
    """Documents put together from builders, without a source."""
    from quire.core import nodes
    from quire.render import html

    @F.pandas_udf("string")
    def built(names: pd.Series, types: pd.Series, sizes: pd.Series) -> pd.Series:
        docs = [nodes.Document([nodes.heading(2, n), nodes.paragraph(t), nodes.table(["size"], [[str(s)]])]) for n, t, s in zip(names, types, sizes)]
        return pd.Series([html.render(d) for d in docs], dtype=object)

    return _parts(spark, sf_dir).select("p_partkey", built("p_name", "p_type", "p_size").alias("html"))


@_query("""SELECT p_partkey, '---' || chr(10) || 'b: 7' || chr(10) || '---' || chr(10) || chr(10) || '## ' || p_name || chr(10) || chr(10) || '- ' || p_type || chr(10) AS out FROM part""")
def k3_convert(spark, sf_dir):
    """What the command line writes for ``convert --to normalize --set b=7 --delete a``."""
    from quire.cli import convert

    @F.pandas_udf("string")
    def converted(sources: pd.Series) -> pd.Series:
        return pd.Series([convert(s, "normalize", ["b=7"], ["a"]) for s in sources], dtype=object)

    made = _made(spark, sf_dir, "---\na: 1\n---\n", "p_name", "\n---\n* ", "p_type")
    return made.select("p_partkey", converted("source").alias("out"))


@_query("SELECT p_partkey, '2 blocks, first ' || p_name AS text FROM part")
def k5_renderer(spark, sf_dir):
    """A renderer of one's own, by its name."""
    rendering.register_renderer("summary", lambda doc: f"{len(doc.blocks)} blocks, first {doc.blocks[0].inlines[0].content}")
    return _made(spark, sf_dir, "p_name", "\n\n- ", "p_type").select("p_partkey", rendering.render(F.col("source"), "summary").alias("text"))


def _diagram(source: str) -> str:
    """Stands for a diagram library in the queries of the hook; refuses long sources."""
    if len(source.split()) > 2:
        raise ValueError("too long")
    return f"<svg>{source.strip()}</svg>"


@_query("""SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) > 2 THEN '<pre><code class="language-mermaid">' || p_name || chr(10) || '</code></pre>' || chr(10) ELSE '<figure class="mermaid-diagram">' || chr(10) || '<svg>' || p_name || '</svg></figure>' || chr(10) END
 || '<pre><code class="language-dot">' || p_type || chr(10) || '</code></pre>' || chr(10) AS html FROM part""")
def k6_mermaid(spark, sf_dir):
    """Diagrams through the hook; code of another language, and what the hook refuses, stays code."""
    made = _made(spark, sf_dir, "```mermaid\n", "p_name", "\n```\n```dot\n", "p_type", "\n```")
    return made.select("p_partkey", rendering.render(F.col("source"), "html", mermaid=_diagram).alias("html"))


# -- frontmatter -------------------------------------------------------------------------------------


@_query("""SELECT p_partkey, '{"a": ' || p_size || ', "b": "' || p_name || '", "c": {"d": true}, "e": null}' AS fm FROM part""")
def f16_set_raw(spark, sf_dir):
    """Raw command-line values set with the types they look like."""
    from quire.meta.frontmatter import FrontMatter

    @F.pandas_udf("string")
    def made(names: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for n, s in zip(names, sizes):
            fm = FrontMatter("{}", "json")
            for path, raw in (("a", str(s)), ("b", n), ("c.d", "true"), ("e", "null")):
                fm.set_raw(path, raw)
            out.append(fm.to_json(pretty=False))
        return pd.Series(out, dtype=object)

    return _parts(spark, sf_dir).select("p_partkey", made("p_name", "p_size").alias("fm"))


def _deep(levels: int) -> tuple[str, str]:
    return "[" * levels, "]" * levels


@_query("SELECT p_partkey AS doc_id FROM part WHERE p_size = 7 OR p_size = 9")
def c4_deep(spark, sf_dir):
    """Values in lists at any depth: one, ten and none; objects in lists do not match."""
    front = F.when(F.col("p_size") == 9, F.lit(_deep(1)[0] + '"x", "seven"' + _deep(1)[1])).when(F.col("p_size") == 7, F.lit('[[], 1, ' + _deep(10)[0] + '2, "seven"' + _deep(10)[1] + "]"))
    front = front.otherwise(F.lit('[{"seven": "seven"}, ["sevens", [7]]]'))
    docs = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('{"tags": '), front, F.lit("}\n# x")).alias("source"))
    return Library.from_column(docs, "doc_id", "source").query("tags=seven").select("doc_id")


@_query("SELECT p_partkey AS doc_id, p_size % 2 = 0 AS every, true AS first_sixteen FROM part")
def c1_filters(spark, sf_dir):
    """Seventeen filters: the last counts too, unless only sixteen are asked for."""
    docs = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('{"a": 1, "even": '), (F.col("p_size") % 2 == 0).cast("string"), F.lit("}\n# x")).alias("source"))
    lib, selector = Library.from_column(docs, "doc_id", "source"), "a=1 " * 16 + "even=true"
    mark = lambda rows, name: rows.select("doc_id", F.lit(True).alias(name))
    both = docs.select("doc_id").join(mark(lib.query(selector), "every"), "doc_id", "left").join(mark(lib.query(selector, max_filters=16), "first_sixteen"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("every", F.lit(False)).alias("every"), F.coalesce("first_sixteen", F.lit(False)).alias("first_sixteen"))


@_query("""SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, CASE WHEN p_size % 4 = 0 THEN encode(p_type) END,
 CASE WHEN p_size % 4 = 1 THEN p_retailprice END, p_partkey) - 1 AS place FROM part""")
def c13_mixed(spark, sf_dir):
    """Ascending by a field of several types: strings bytewise, numbers, the rest, and last those without."""
    kind = F.col("p_size") % 4
    value = F.when(kind == 0, F.concat(F.lit(', "v": "'), "p_type", F.lit('"'))).when(kind == 1, F.concat(F.lit(', "v": '), F.col("p_retailprice").cast("string"))).when(kind == 2, F.lit(', "v": true')).otherwise("")
    docs = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('{"a": 1'), value, F.lit("}\n# x")).alias("source"))
    lib = Library.from_column(docs, "doc_id", "source")
    return placed(lib.sort_by(lib.query("a=1"), "v"))


def placed(ordered: DataFrame) -> DataFrame:
    """(doc_id, place) of rows in the order they come, from 0; for comparing an order as rows."""
    return ordered.select("doc_id").coalesce(1).select("doc_id", F.monotonically_increasing_id().alias("place"))


# -- rules with more than one shape ------------------------------------------------------------------

_HTML = {
    1: ("<pre>\n\n{p_name}\n</pre>", "<pre>\n\n{p_name}\n</pre>\n"), 2: ("<!-- {p_name}\n\n{p_type} -->", "<!-- {p_name}\n\n{p_type} -->\n"), 3: ("<?x {p_name}\n\n?>", "<?x {p_name}\n\n?>\n"),
    4: ("<!X {p_name}>", "<!X {p_name}>\n"), 5: ("<![CDATA[\n\n{p_name}]]>", "<![CDATA[\n\n{p_name}]]>\n"), 6: ("<div>\n{p_name}", "<div>\n{p_name}\n"), 7: ('<x-y a="{p_type}">\n{p_name}', '<x-y a="{p_type}">\n{p_name}\n'),
}


def _sql_text(template: str) -> str:
    out = template.replace("'", "''").replace("\n", "' || chr(10) || '")
    for c in ("p_name", "p_type"):
        out = out.replace("{" + c + "}", f"' || {c} || '")
    return f"'{out}'"


@_query(" UNION ALL ".join(f"SELECT p_partkey AS doc_id, {k}::INT AS html_type, {_sql_text(content)} AS content FROM part" for k, (_, content) in _HTML.items()))
def parse_p13_types(spark, sf_dir):
    """The seven kinds of HTML blocks: which end at a blank line and which do not."""
    name = lambda t: F.expr("concat(" + ", ".join(x if x in ("p_name", "p_type") else "'" + x.replace("'", "\\'").replace("\n", "\\n") + "'" for x in re.split(r"\{(\w+)\}", t)) + ")")
    docs = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat_ws("\n\nbetween\n\n", *[name(source) for source, _ in _HTML.values()]).alias("source"))
    return parsing.nodes(docs, "doc_id", "source", kinds=["html_block"], skip_frontmatter=False).select("doc_id", "html_type", "content")


@_query("""SELECT p_partkey AS doc_id, c.row_no::INT AS row_no, c.col_no::INT AS col_no, CASE c.t WHEN 'n' THEN p_name WHEN 't' THEN p_type || '|x' ELSE c.t END AS text, CASE c.col_no WHEN 0 THEN 'none' ELSE 'center' END AS align
 FROM part, (VALUES (0, 0, 'a'), (0, 1, 'b'), (1, 0, 'n'), (1, 1, ''), (2, 0, 't'), (2, 1, 'y')) c(row_no, col_no, t)""")
def parse_p15_cells(spark, sf_dir):
    """Rows with too few cells are filled, with too many are cut; an escaped pipe is text."""
    made = _made(spark, sf_dir, "a | b\n--- | :-:\n", "p_name", "\n| ", "p_type", "\\|x | y | z |\n").withColumnRenamed("p_partkey", "doc_id")
    return parsing.nodes(made, "doc_id", "source", "cells", skip_frontmatter=False).select("doc_id", "row_no", "col_no", "text", "align")


@_query("""SELECT p_partkey AS doc_id, p_size % 3 = 0 AS tight, CASE p_size % 2 WHEN 0 THEN 'ordered' ELSE 'unordered' END AS list_type, CASE p_size % 2 WHEN 0 THEN p_size END::BIGINT AS list_start, 2::BIGINT AS n_items FROM part""")
def agg_looseness(spark, sf_dir):
    """A blank line between items, or between the blocks of one, makes a list loose."""
    mark, second = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(". "))).otherwise("- "), F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") + 1).cast("string"), F.lit(". "))).otherwise("- ")
    gap = F.when(F.col("p_size") % 3 == 0, "\n").when(F.col("p_size") % 3 == 1, "\n\n").otherwise(F.concat(F.lit("\n\n"), F.repeat(F.lit(" "), F.length(mark)), F.lit("more\n")))
    docs = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat(mark, "p_name", gap, second, "p_type").alias("source"))
    lists = F.explode(F.filter("blocks", lambda b: b["kind"] == "list")).alias("l")
    one = parsing.parsed(docs, "doc_id", "source", skip_frontmatter=False, tables=["blocks"]).select("doc_id", "blocks", lists)
    items = F.size(F.filter("blocks", lambda b: (b["kind"] == "list_item") & (b["parent_id"] == F.col("l.block_id")))).cast("bigint")
    return one.select("doc_id", F.col("l.list_tight").alias("tight"), F.col("l.list_type").alias("list_type"), F.col("l.list_start").alias("list_start"), items.alias("n_items"))


@_query("""SELECT p_brand AS section, sum((p_size % 3 > 0)::INT)::BIGINT AS passed, count(*)::BIGINT AS total FROM part GROUP BY ROLLUP (p_brand)""")
def agg_sections(spark, sf_dir):
    """A specification's cases run: passed and all per section, with a total; every third expects another output."""
    html = F.concat(F.lit("<p><em>"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).otherwise("other"), F.lit("</em></p>"))
    cases = _parts(spark, sf_dir).select(F.col("p_partkey").cast("int").alias("example"), F.col("p_brand").alias("section"), F.concat(F.lit("*"), "p_name", F.lit("*\n")).alias("markdown"), html.alias("html"))
    return conformance.summary(conformance.run(cases))


@_query("SELECT p_partkey AS doc_id, 'same' AS label_norm, '/' || p_size AS url, p_name AS title FROM part")
def agg_first_label(spark, sf_dir):
    """Of several definitions of a label, in whatever case, the first counts."""
    made = _made(spark, sf_dir, "[same]\n\n[Same]: /", "p_size", " '", "p_name", "'\n[same]: /other\n> [SAME]: /quoted\n").withColumnRenamed("p_partkey", "doc_id")
    return parsing.nodes(made, "doc_id", "source", "link_defs", skip_frontmatter=False)


@_query("SELECT p_partkey, 'x#footnote[' || p_type || ']' || chr(10) || chr(10) AS text FROM part")
def agg_last_footnote(spark, sf_dir):
    """Of several definitions of a footnote, Typst output takes the last."""
    made = _made(spark, sf_dir, "x[^n]\n\n[^n]: ", "p_name", "\n\n[^n]: ", "p_type", "\n")
    return made.select("p_partkey", rendering.render(F.col("source"), "typst").alias("text"))


@_query("""SELECT p_partkey, '| ' || rpad('é', w, ' ') || ' | ' || lpad('n', 2, ' ') || ' |' || chr(10) || '| ' || repeat('-', w) || ' | -- |' || chr(10) || '| ' || rpad(p_name, w, ' ') || ' | ' || lpad(p_size::VARCHAR, 2, ' ') || ' |' || chr(10)
 || '| ' || rpad('long enough for all of them, is it not', w, ' ') || ' | 10 |' || chr(10) AS text FROM (SELECT *, greatest(len(p_name), 38)::INT AS w FROM part)""")
def agg_cell_width(spark, sf_dir):
    """Terminal tables: every column as wide as its widest cell, aligned."""
    made = _made(spark, sf_dir, "| é | n |\n|---|--:|\n| ", "p_name", " | ", "p_size", " |\n| long enough for all of them, is it not | 10 |\n")
    return made.select("p_partkey", text.strip_ansi(rendering.render(F.col("source"), "terminal")).alias("text"))


@_query("""SELECT text, row_number() OVER (ORDER BY part, k)::BIGINT AS place FROM (SELECT n_name AS text, 0 AS part, n_nationkey AS k FROM nation UNION ALL SELECT r_name, 1, r_regionkey FROM region UNION ALL SELECT 'last', 2, 0)""")
def agg_union(spark, sf_dir):
    """Two collections and one more document: the second after the first, identifiers made apart."""
    of = lambda name, c: Library.from_column(table(spark, sf_dir, name).select(F.col(f"{c}_{name}key").alias("k"), F.concat(F.lit("# "), f"{c}_name").alias("t")), "k", "t")
    both = of("nation", "n").union(of("region", "r")).add("# last")
    rows = both.query("@heading")
    return rows.select("text", F.row_number().over(Window.orderBy("doc_seq")).cast("bigint").alias("place"))


# -- renderers ---------------------------------------------------------------------------------------


@_query(r"""SELECT p_partkey, 'P "' || p_name || '\t\"x\\"' || chr(10) || 'CB "' || p_type || '\tend"' || chr(10) AS text FROM part""")
def r3_quoting(spark, sf_dir):
    """Tabs, quotes and backslashes in the outline."""
    made = _made(spark, sf_dir, "p_name", "\t\"x\\\\\n\n    ", "p_type", "\tend\n")
    return made.select("p_partkey", rendering.render(F.col("source"), "ai").alias("text"))


@_query("""SELECT p_partkey, e || '[1m' || e || '[35m' || e || '[4m# ' || p_name || e || '[0m' || n || n || 'a ' || e || ']8;;/u' || e || chr(92) || e || '[4m' || e || '[34m' || p_type || e || '[0m' || e || ']8;;' || e || chr(92)
 || e || '[2m (/u)' || e || '[0m' || n AS text FROM part, (SELECT chr(27) AS e, chr(10) AS n)""")
def r4_styles(spark, sf_dir):
    """Terminal output with its control sequences: a heading and a link."""
    made = _made(spark, sf_dir, "# ", "p_name", "\n\na [", "p_type", "](/u)")
    return made.select("p_partkey", rendering.render(F.col("source"), "terminal").alias("text"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a5' ELSE 'us-letter' END AS paper, p_size || 'pt' AS size, p_name AS title, 'true' AS numbered FROM part""")
def r8_options(spark, sf_dir):
    """Paper, type size, title and numbering of a Typst document from frontmatter, yes being true."""
    front = F.concat(F.lit("title: "), "p_name", F.when(F.col("p_size") % 2 == 0, F.lit("\npapersize: a5\npaper: a4")).otherwise("\npaper: us-letter"), F.lit("\nfontsize: "), F.col("p_size").cast("string"), F.lit("pt\nnumbersections: 'yes'\n"))
    rows = _parts(spark, sf_dir).select("p_partkey", rendering.typst_document(F.lit("x"), fmf.to_json(front, F.lit("yaml"))).alias("t"))
    find = lambda pattern: F.regexp_extract("t", pattern, 1)
    numbered = F.contains("t", F.lit("#set heading(numbering:"))
    return rows.select("p_partkey", find(r'paper: "([^"]*)"').alias("paper"), find(r"(?m)^  size: (\d+pt),$").alias("size"), find(r'title: "([^"]*)"').alias("title"), numbered.cast("string").alias("numbered"))


# -- string functions --------------------------------------------------------------------------------


@_query(r"""SELECT p_partkey, p_name || ' &amp; &quot;é&quot; &lt;*&gt; &amp;nope;' AS title FROM part""")
def x5_titles(spark, sf_dir):
    """Link titles as HTML attributes."""
    raw = F.concat("p_name", F.lit(' &amp; "&eacute;&quot; <\\*> &nope;'))
    return _parts(spark, sf_dir).select("p_partkey", text.title_attribute(raw).alias("title"))


@_query(r"SELECT block_id, regexp_replace(content, '([\\*_`#$@<\[\]~])', '\\\1', 'g') AS text FROM code_blocks")
def x6_typst(spark, sf_dir):
    return table(spark, sf_dir, "code_blocks").select("block_id", text.typst_escape(F.col("content")).alias("text"))


@_query(r"""SELECT block_id, '"' || replace(replace(replace(replace(replace(content, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS text FROM code_blocks""")
def x6_outline(spark, sf_dir):
    return table(spark, sf_dir, "code_blocks").select("block_id", text.outline_quote(F.col("content")).alias("text"))


@_query("SELECT p_partkey, '<p>' || p_name || ' ' || p_type || '</p><pre>  a' || chr(10) || ' b</pre><ul><li>x</li></ul>' AS html FROM part")
def x12_normalized(spark, sf_dir):
    """HTML without white space that means nothing; preformatted text keeps its own."""
    raw = F.concat(F.lit("\n<p>"), "p_name", F.lit(" \n\t "), "p_type", F.lit("</p>\n<pre>  a\n b</pre>\n<ul>\n<li>x</li>\n</ul>\n"))
    return _parts(spark, sf_dir).select("p_partkey", text._each(conformance.normalize_html)(raw).alias("html"))
