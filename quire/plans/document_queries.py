"""Queries of the document engine: sources, parsing, frontmatter, collection and document queries,
edits, renderers, string functions. Each key names the operator it shows; ORACLE has the SQL over the
same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import frontmatter as fmf
from quire.functions import parsing, rendering, text
from quire.operators import edit
from quire.operators.library import Library
from quire.plans import fixtures as fx
from quire.plans.engine_queries import placed
from quire.runtime import spread, table

QUERIES, ORACLE = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _lib(df, **options) -> Library:
    return Library.from_column(df, "doc_id", "source", **options)


def _bare(df) -> Library:
    """Documents without frontmatter: nothing to sniff for."""
    docs = df.select("doc_id", F.col("doc_id").alias("doc_seq"), F.lit(None).cast("string").alias("path"), "source", F.col("source").alias("body"), F.xxhash64("source").alias("content_hash"))
    return Library(docs.withColumns({c: F.lit(None).cast("string") for c in ("fm_format", "fm_json", "fm_error", "parse_error")}))


def _entries(spark, sf_dir, **options) -> Library:
    return Library.from_parts(spread(table(spark, sf_dir, "entries")), "entry_id", "document", "frontmatter", "fm_format", path_col="path", **options)


# -- collection queries ------------------------------------------------------------------------------


@_query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents")
def s1_library(spark, sf_dir):
    """Documents of a library with their bodies."""
    body = F.expr("substring(body, 10)")
    return _lib(fx.pages(spark, sf_dir)).docs.select("doc_id", F.octet_length(body).cast("bigint").alias("n_bytes"))


@_query("SELECT doc_id FROM documents WHERE align_score IS NOT NULL")
def c2_exists(spark, sf_dir):
    return _lib(fx.pages(spark, sf_dir)).query("extra.score").select("doc_id")


@_query("SELECT doc_id FROM documents WHERE lang = 'de'")
def c3_equals(spark, sf_dir):
    return _lib(fx.pages(spark, sf_dir)).query("extra.lang=de").select("doc_id")


@_query("SELECT event_id AS doc_id FROM events WHERE json_extract(props, '$.k')::INT = 7")
def c3_number(spark, sf_dir):
    return _lib(fx.events(spark, sf_dir)).query("k=7").select("doc_id")


@_query("SELECT doc_id FROM documents WHERE source = 'council_minutes'")
def c4_contains(spark, sf_dir):
    return _lib(fx.pages(spark, sf_dir)).query("tags=council_minutes").select("doc_id")


@_query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'copper_manual' AND align_score IS NOT NULL")
def c5_and(spark, sf_dir):
    return _lib(fx.pages(spark, sf_dir)).query("extra.lang=fr \textra.source=copper_manual extra.score").select("doc_id")


@_query("SELECT doc_id FROM documents")
def c6_wildcard(spark, sf_dir):
    return _lib(fx.pages(spark, sf_dir)).query("").select("doc_id")


@_query("SELECT doc_id, 'doc ' || doc_id AS title, true AS no_block FROM documents WHERE lang = 'es'")
def c7_document(spark, sf_dir):
    rows = _lib(fx.pages(spark, sf_dir)).query("extra.lang=es")
    return rows.select("doc_id", F.try_variant_get(F.try_parse_json("fm_json"), "$.title", "string").alias("title"), F.col("block_id").isNull().alias("no_block"))


@_query("""SELECT user_id AS doc_id, CASE event_type WHEN 'click' THEN 2 ELSE 3 END::INT AS level, event_type || ' ' || event_id AS text
FROM events WHERE event_type IN ('click', 'view')""")
def c8_headings(spark, sf_dir):
    return _bare(fx.journals(spark, sf_dir)).query("@heading").select("doc_id", "level", "text")


@_query("SELECT user_id AS doc_id, count(*)::BIGINT AS n FROM events WHERE event_type = 'error' OR event_type = 'purchase' GROUP BY 1")
def c8_nested(spark, sf_dir):
    """Paragraphs at any depth: those of quotes count."""
    return _bare(fx.journals(spark, sf_dir)).query("@paragraph").groupBy("doc_id").agg(F.count("*").alias("n"))


@_query("SELECT doc_id FROM documents WHERE false")
def c9_unknown(spark, sf_dir):
    return _lib(fx.pages(spark, sf_dir)).query("@nope").select("doc_id")


@_query("SELECT event_type AS text, count(*)::BIGINT AS n FROM events WHERE json_extract(props, '$.k')::INT = 3 GROUP BY 1")
def c10_semi(spark, sf_dir):
    return _lib(fx.events(spark, sf_dir)).query("k=3 @heading").groupBy("text").agg(F.count("*").alias("n"))


@_query("SELECT 1.0::DOUBLE AS confidence, count(*)::BIGINT AS n FROM documents WHERE lang = 'en'")
def c11_rank(spark, sf_dir):
    return _lib(fx.pages(spark, sf_dir)).query("extra.lang=en").groupBy(F.col("confidence").cast("double").alias("confidence")).agg(F.count("*").alias("n"))


@_query("SELECT doc_id FROM documents WHERE false")
def c12_empty(spark, sf_dir):
    return _lib(fx.pages(spark, sf_dir)).query("missing.field=1").select("doc_id")


@_query("""SELECT doc_id, row_number() OVER (ORDER BY align_score IS NULL, round(align_score, 4) DESC, doc_id) - 1 AS place FROM documents WHERE lang = 'de'""")
def c13_sort(spark, sf_dir):
    """All by a numeric field, descending, documents without it last."""
    lib = _lib(fx.pages(spark, sf_dir))
    return placed(lib.sort_by(lib.query("extra.lang=de"), "extra.score", ascending=False))


@_query("""SELECT entry_id AS doc_id FROM entries e WHERE NOT EXISTS
 (SELECT 1 FROM entries k WHERE k.fm_format = 'yaml' AND k.path IS NOT DISTINCT FROM e.path AND k.document = e.document)""")
def c14_changed(spark, sf_dir):
    """Entries whose (path, content hash) the YAML part of the collection does not hold."""
    lib = _entries(spark, sf_dir)
    return lib.changed(lib.docs.where("fm_format = 'yaml'").select("path", "content_hash")).select("doc_id")


# -- in-document queries -----------------------------------------------------------------------------


@_query("SELECT user_id AS doc_id, count(*)::BIGINT AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def q1_blocks(spark, sf_dir):
    """Top-level paragraphs: those of quotes do not count."""
    return _bare(fx.journals(spark, sf_dir)).top("paragraph").groupBy("doc_id").agg(F.count("*").alias("n"))


@_query("SELECT user_id AS doc_id, count(*)::BIGINT AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def q2_levels(spark, sf_dir):
    return _bare(fx.journals(spark, sf_dir)).headings(3).groupBy("doc_id").agg(F.count("*").alias("n"))


@_query("SELECT c_custkey AS doc_id, 'See ' || c_name || ' now.' AS text FROM customer")
def q3_paragraphs_with(spark, sf_dir):
    return _bare(fx.cards(spark, sf_dir)).paragraphs_with("link").select("doc_id", "text")


@_query("SELECT c_custkey AS doc_id, c_name AS text, '/c/' || c_custkey AS url, c_mktsegment AS title, 'reference' AS link_type FROM customer")
def q4_links(spark, sf_dir):
    return _bare(fx.cards(spark, sf_dir)).links().select("doc_id", "text", "url", "title", "link_type")


@_query("SELECT event_id AS doc_id, event_type AS text FROM events")
def q5_text_at(spark, sf_dir):
    return _lib(fx.events(spark, sf_dir)).text_at("heading[0]")


@_query("""SELECT user_id AS doc_id, CASE event_type WHEN 'purchase' THEN 'blockquote' WHEN 'signup' THEN 'fenced_code_block' WHEN 'error' THEN 'paragraph' ELSE 'heading' END AS kind,
 count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def q6_count(spark, sf_dir):
    return _bare(fx.journals(spark, sf_dir)).count()


# -- parsing -----------------------------------------------------------------------------------------


@_query("SELECT doc_id, (len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def parse_p2_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.line_count(F.col("text")).cast("bigint").alias("n"))


@_query("""SELECT entry_id, language, replace(content, chr(13) || chr(10), chr(10)) AS content, fence_char, fence_length FROM code_blocks""")
def parse_p9_fences(spark, sf_dir):
    """The fenced code of every entry, at the top level and in order."""
    blocks = parsing.nodes(spread(table(spark, sf_dir, "entries")), "entry_id", "document", "blocks", skip_frontmatter=False, kinds=["fenced_code_block"])
    return blocks.select("entry_id", "language", F.concat("content", F.lit("\n")).alias("content"), "fence_char", "fence_length")


@_query("SELECT n_regionkey::BIGINT AS doc_id, n_name AS text, n_nationkey % 2 = 0 AS checked FROM nation")
def parse_p12_tasks(spark, sf_dir):
    """Paragraphs of task items, each with the state of the item above it."""
    one = parsing.parsed(fx.nations(spark, sf_dir), "doc_id", "source", tables=["blocks"])
    rows = one.select("doc_id", "blocks", F.explode("blocks").alias("b")).where("b.kind = 'paragraph'")
    return rows.select("doc_id", "b.text", F.get("blocks", F.col("b.parent_id"))["task_checked"].alias("checked"))


@_query("SELECT n_regionkey::BIGINT AS doc_id, count(*)::BIGINT AS n, true AS tight, 'unordered' AS list_type FROM nation GROUP BY 1")
def parse_p11_lists(spark, sf_dir):
    one = parsing.parsed(fx.nations(spark, sf_dir), "doc_id", "source", tables=["blocks"])
    items = one.select("doc_id", "blocks", F.explode("blocks").alias("b")).where("b.kind = 'list_item'").select("doc_id", F.get("blocks", F.col("b.parent_id")).alias("l"))
    return items.groupBy("doc_id", F.col("l.list_tight").alias("tight"), F.col("l.list_type").alias("list_type")).agg(F.count("*").alias("n"))


@_query("SELECT s_suppkey AS doc_id, '<div>' || chr(10) || s_name || chr(10) || '</div>' || chr(10) AS content FROM supplier")
def parse_p13_html(spark, sf_dir):
    return _bare(fx.contacts(spark, sf_dir)).nodes(kinds=["html_block"]).where("html_type = 6").select("doc_id", "content")


@_query("SELECT o_orderkey AS doc_id, o_orderkey::VARCHAR AS label, o_orderpriority AS text FROM orders")
def parse_p14_footnotes(spark, sf_dir):
    """Footnote references joined with their definitions."""
    one = parsing.parsed(fx.notes(spark, sf_dir), "doc_id", "source", tables=["blocks", "inlines"])
    refs = one.select("doc_id", "blocks", F.explode(F.filter("inlines", lambda i: i["kind"] == "footnote_reference")).alias("r"))
    definition = F.filter("blocks", lambda b: (b["kind"] == "footnote_definition") & (b["label"] == F.col("r.label")))
    refs = refs.select("doc_id", "blocks", "r", F.explode(definition).alias("d"))
    texts = F.explode(F.filter("blocks", lambda b: b["parent_id"] == F.col("d.block_id"))).alias("b")
    return refs.select("doc_id", "r.label", texts).select("doc_id", "label", "b.text")


@_query("SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n, sum(l_quantity::INT)::BIGINT AS qty FROM lineitem GROUP BY 1")
def parse_p15_tables(spark, sf_dir):
    cells = _bare(fx.order_tables(spark, sf_dir)).nodes("cells").where("row_no > 0 and col_no = 2 and align = 'right'")
    return cells.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("bigint")).alias("qty"))


@_query("SELECT c_custkey AS doc_id, 'k' || c_custkey AS label_norm, '/c/' || c_custkey AS url, c_mktsegment AS title FROM customer")
def parse_p17_link_defs(spark, sf_dir):
    return _bare(fx.cards(spark, sf_dir)).nodes("link_defs")


@_query("""SELECT p_partkey AS doc_id, 'emphasis' AS kind, p_name AS text FROM part UNION ALL SELECT p_partkey, 'strong', p_type FROM part
 UNION ALL SELECT p_partkey, 'code_span', p_size::VARCHAR FROM part""")
def parse_p20_emphasis(spark, sf_dir):
    rows = _bare(fx.parts(spark, sf_dir)).nodes("inlines", kinds=["emphasis", "strong", "code_span"])
    return rows.select("doc_id", "kind", F.coalesce("text", "content").alias("text"))


@_query("""SELECT s_suppkey AS doc_id, 'https://s.example/' || s_suppkey AS url, false AS is_email, false AS is_www FROM supplier
 UNION ALL SELECT s_suppkey, 'www.s.example/' || s_suppkey, false, true FROM supplier
 UNION ALL SELECT s_suppkey, 's' || s_suppkey || '@s.example', true, false FROM supplier""")
def parse_p25_autolinks(spark, sf_dir):
    return _bare(fx.contacts(spark, sf_dir)).nodes("inlines", kinds=["autolink"]).select("doc_id", "url", "is_email", F.col("is_gfm_www").alias("is_www"))


@_query("""SELECT s_suppkey AS doc_id, k.kind, k.n::BIGINT AS n FROM supplier, (VALUES ('hard_break', 1), ('soft_break', 1), ('html_in_line', 2)) k(kind, n)""")
def parse_p27_breaks(spark, sf_dir):
    rows = _bare(fx.contacts(spark, sf_dir)).nodes("inlines", kinds=["hard_break", "soft_break", "html_in_line"])
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@_query()
def parse_entries_profile(spark, sf_dir):
    """Blocks of the stored entries by kind, depth and level."""
    blocks = parsing.nodes(spread(table(spark, sf_dir, "entries")), "entry_id", "document", "blocks", skip_frontmatter=False)
    return blocks.groupBy("kind", "depth", "level").agg(F.count("*").alias("n"), F.countDistinct("entry_id").alias("n_entries"))


@_query("SELECT entry_id AS doc_id, strlen(document) > 2500 AS marked, strlen(document) <= 2500 AND regexp_matches(document, '\\S') AS parsed FROM entries")
def s2_limits(spark, sf_dir):
    """Documents above a collection's limit are marked, not failed, and have no nodes."""
    lib = _entries(spark, sf_dir, max_bytes=2500)
    some = lib.nodes().where("block_id = 0").select("doc_id", F.lit(True).alias("p"))
    return lib.docs.select("doc_id", F.col("parse_error").isNotNull().alias("marked")).join(some, "doc_id", "left").select("doc_id", "marked", F.coalesce("p", F.lit(False)).alias("parsed"))


#: The stored entries without their fenced code, and their headings found by patterns.
_HEADINGS = r"""
WITH codes AS (SELECT entry_id, list(content ORDER BY block_no) AS contents FROM code_blocks GROUP BY 1),
plain AS (SELECT e.entry_id, replace(list_reduce(list_prepend(document, coalesce(contents, [])), lambda acc, x: CASE WHEN x = '' THEN acc ELSE replace(acc, x, '') END), chr(13), '') AS t FROM entries e LEFT JOIN codes USING (entry_id)),
found AS (
 SELECT entry_id, unnest(list_transform(regexp_extract_all(chr(10) || replace(t, chr(10), chr(10) || chr(10)), '\n {0,3}(#{1,6})(?:[ \t][^\n]*)?(?:\n|$)', 1), lambda h: len(h)))::INT AS level FROM plain
 UNION ALL SELECT entry_id, unnest(list_transform(regexp_extract_all(t, '(?:^|\n)[A-Za-z][^\n]*\n {0,3}(=+|-+)[ \t]*(?:\n|$)', 1), lambda h: CASE WHEN h[1] = '=' THEN 1 ELSE 2 END))::INT FROM plain)
"""


@_query(_HEADINGS + "SELECT entry_id, level, count(*)::BIGINT AS n FROM found GROUP BY ALL")
def parse_entries_headings(spark, sf_dir):
    """Headings of every stored entry by level, against patterns over its text without code."""
    rows = parsing.nodes(spread(table(spark, sf_dir, "entries")), "entry_id", "document", "blocks", skip_frontmatter=False, kinds=["heading"])
    return rows.groupBy("entry_id", "level").agg(F.count("*").alias("n"))


@_query(_HEADINGS + """SELECT e.entry_id, (SELECT count(*) FROM found f WHERE f.entry_id = e.entry_id)::BIGINT + len(regexp_extract_all(regexp_replace(p.t, '`[^`\n]*`', '', 'g'), '<h[1-6]>'))::BIGINT AS n_headings,
 (SELECT count(*) FROM code_blocks b WHERE b.entry_id = e.entry_id AND language IS NOT NULL)::BIGINT AS n_code FROM entries e JOIN plain p USING (entry_id)""")
def r1_elements(spark, sf_dir):
    """Headings and code with a language in the HTML of every entry."""
    html = rendering.render(F.col("document"), "html")
    count = lambda pattern: F.size(F.regexp_extract_all("h", F.lit(pattern), 0)).cast("bigint")
    rows = spread(table(spark, sf_dir, "entries")).select("entry_id", html.alias("h"))
    return rows.select("entry_id", count("<h[1-6]>").alias("n_headings"), count('<pre><code class="language-').alias("n_code"))


@_query(_HEADINGS + "SELECT level, count(*)::BIGINT AS n FROM found GROUP BY ROLLUP (level)")
def agg_levels(spark, sf_dir):
    """Headings per level and in all: sums per section with a separate total."""
    rows = parsing.nodes(spread(table(spark, sf_dir, "entries")), "entry_id", "document", "blocks", skip_frontmatter=False, kinds=["heading"])
    return rows.rollup("level").agg(F.count("*").alias("n"))


# -- frontmatter -------------------------------------------------------------------------------------


@_query("SELECT 'json' AS format, count(*)::BIGINT AS n, max(strlen(props) + 1)::BIGINT AS furthest FROM events UNION ALL SELECT 'yaml', count(*), 0 FROM documents")
def f1_sniff(spark, sf_dir):
    """Formats found at the start of documents, and where bodies begin."""
    j = fx.events(spark, sf_dir).select(fmf.read(F.col("source")).alias("f")).groupBy(F.col("f.format").alias("format")).agg(F.count("*").alias("n"), F.max("f.body_start").cast("bigint").alias("furthest"))
    y = fx.pages(spark, sf_dir).select(fmf.read(F.col("source")).alias("f")).groupBy(F.col("f.format").alias("format")).agg(F.count("*").alias("n"))
    return j.unionByName(y.withColumn("furthest", F.lit(0).cast("bigint")))


@_query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def f2_json(spark, sf_dir):
    rows = _lib(fx.events(spark, sf_dir)).docs.select(F.try_variant_get(F.try_parse_json("fm_json"), "$.k", "bigint").alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("n"))


def _trees(rows):
    """Rows with the variant of their raw frontmatter, and a getter of its fields."""
    v = F.try_parse_json(fmf.to_json(F.col("frontmatter"), F.col("fm_format")))
    return rows, lambda path, kind: F.try_variant_get(v, path, kind)


@_query(r"""SELECT fm_id, CASE WHEN whole THEN nullif(regexp_extract(frontmatter, '(?:^|[\s,{.])"?title"?\s*[:=]\s*"([^"]*)"', 1), '') END AS title, CASE WHEN whole THEN nullif(regexp_extract(frontmatter, '(?:^|[\s,{.])"?weight"?\s*[:=]\s*"?([0-9.]+)', 1), '') END AS weight
 FROM (SELECT *, len(regexp_extract_all(frontmatter, '"')) % 2 = 0 AND len(regexp_extract_all(frontmatter, '[{\[]')) = len(regexp_extract_all(frontmatter, '[}\]]')) AND (fm_format <> 'yaml' OR regexp_matches(frontmatter, '(?:^|\n)[ ]*(?:-(?: .*)?|[^\s:]+:(?: .*)?)\s*$')) AS whole
       FROM frontmatters WHERE frontmatter IS NOT NULL)""")
def f2_formats(spark, sf_dir):
    """The four source formats read into one tree; the SQL finds the fields in the raw source, where it is not cut off."""
    rows, get = _trees(spread(table(spark, sf_dir, "frontmatters")).where("frontmatter is not null"))
    return rows.select("fm_id", get("$.title", "string").alias("title"), get("$.weight", "string").alias("weight"))


@_query("""SELECT fm_id, CASE WHEN json_type(root, '$.tags') = 'ARRAY' THEN json_array_length(root, '$.tags') END::BIGINT AS n_tags, json_extract_string(root, '$.extra.owner') AS owner
 FROM frontmatters WHERE json_valid(root) AND json_type(root) = 'OBJECT' AND frontmatter IS NOT NULL""")
def f2_trees(spark, sf_dir):
    """Lists and nested fields of the raw source, for the files whose exported root there is to compare with."""
    rows, get = _trees(spread(table(spark, sf_dir, "frontmatters")).where(F.schema_of_variant(F.try_parse_json("root")).startswith("OBJECT") & F.col("frontmatter").isNotNull()))
    tags = get("$.tags", "array<variant>")
    return rows.select("fm_id", F.when(tags.isNotNull(), F.size(tags)).cast("bigint").alias("n_tags"), get("$.extra.owner", "string").alias("owner"))


@_query("SELECT doc_id, coalesce(lang, '') AS lang, source FROM documents")
def f7_get(spark, sf_dir):
    fm = F.try_parse_json("fm_json")
    get = lambda p: F.try_variant_get(fmf.field(fm, p), "$", "string")
    return _lib(fx.pages(spark, sf_dir)).docs.select("doc_id", get("extra..lang").alias("lang"), get("extra.source").alias("source"))


@_query("""SELECT event_id AS doc_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || ',' || chr(10) || '  "seen": true,' || chr(10) || '  "a": {' || chr(10)
 || '    "b": 1.5' || chr(10) || '  }' || chr(10) || '}' || chr(10) || chr(10) || '# ' || event_type AS source FROM events""")
def f8_set(spark, sf_dir):
    """Fields set with inferred types; one that leads into a scalar is skipped."""
    return fx.events(spark, sf_dir).select("doc_id", fmf.edit(F.col("source"), sets=["seen=true", "a.b=1.5", "k.x=1"]).alias("source"))


@_query("SELECT event_id AS doc_id, '{}' || chr(10) || chr(10) || '# ' || event_type AS source FROM events")
def f9_delete(spark, sf_dir):
    return fx.events(spark, sf_dir).select("doc_id", fmf.edit(F.col("source"), deletes=["k", "none"]).alias("source"))


@_query("""SELECT event_id AS doc_id, '{"k": 1, "t": {"u": ["' || event_type || '"]}}' AS fm_json FROM events""")
def f10_merge(spark, sf_dir):
    overlay = F.concat(F.lit('{"t": {"u": ["'), "event_type", F.lit('"]}, "k": 1}'))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), fmf.merge(F.col("props"), overlay).alias("fm_json"))


@_query("SELECT event_id AS doc_id, '# ' || event_type AS body FROM events")
def f11_body(spark, sf_dir):
    return _lib(fx.events(spark, sf_dir)).docs.select("doc_id", "body")


@_query("""SELECT event_id AS doc_id, f.format, CASE f.format WHEN 'yaml' THEN '---' || chr(10) || 'k: ' || k || chr(10) || '---' || chr(10) WHEN 'toml' THEN '+++' || chr(10) || 'k = ' || k || chr(10) || '+++' || chr(10)
 WHEN 'json' THEN '{' || chr(10) || '  "k": ' || k || chr(10) || '}' || chr(10) ELSE '.{' || chr(10) || '  .k = ' || k || ',' || chr(10) || '}' || chr(10) END AS source
 FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events), (VALUES ('yaml'), ('toml'), ('json'), ('zon')) f(format)""")
def f13_serialize(spark, sf_dir):
    """Trees written in each of the four formats."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "props", F.explode(F.array(*map(F.lit, ("yaml", "toml", "json", "zon")))).alias("format"))
    return rows.select("doc_id", "format", fmf.serialize(F.col("props"), F.col("format")).alias("source"))


@_query("""SELECT event_id AS doc_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS dump FROM events""")
def k4_dump(spark, sf_dir):
    return _lib(fx.events(spark, sf_dir)).docs.select("doc_id", rendering.frontmatter_dump(F.col("fm_json")).alias("dump"))


# -- edits -------------------------------------------------------------------------------------------


def _new(spark, sf_dir, kind, content):
    docs = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return docs.withColumns({"kind": F.lit(kind), "text": F.lit(content), "depth": F.lit(0)})


def _tops(spark, sf_dir):
    return _bare(fx.journals(spark, sf_dir)).top().select("doc_id", "top_index", "kind", F.coalesce("text", "content").alias("text"), "depth")


_ORDERED = """SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
 CASE event_type WHEN 'purchase' THEN 'blockquote' WHEN 'signup' THEN 'fenced_code_block' WHEN 'error' THEN 'paragraph' ELSE 'heading' END AS kind,
 CASE event_type WHEN 'purchase' THEN NULL WHEN 'signup' THEN event_id::VARCHAR ELSE event_type || ' ' || event_id END AS text FROM events"""


@_query(f"SELECT doc_id, i::INT AS top_index, kind, text FROM ({_ORDERED}) UNION ALL SELECT user_id, count(*)::INT, 'paragraph', 'end' FROM events GROUP BY 1")
def e1_append(spark, sf_dir):
    blocks = _tops(spark, sf_dir)
    return edit.append_block(blocks, _new(spark, sf_dir, "paragraph", "end")).select("doc_id", "top_index", "kind", "text")


@_query(f"SELECT doc_id, (i + CASE WHEN i >= 2 THEN 1 ELSE 0 END)::INT AS top_index, kind, text FROM ({_ORDERED}) UNION ALL SELECT user_id, least(2, count(*))::INT, 'thematic_break', NULL FROM events GROUP BY 1")
def e2_insert(spark, sf_dir):
    blocks = _tops(spark, sf_dir)
    return edit.insert_block(blocks, _new(spark, sf_dir, "thematic_break", None), 2).select("doc_id", "top_index", "kind", "text")


@_query(f"SELECT doc_id, (i - CASE WHEN i > 0 THEN 1 ELSE 0 END)::INT AS top_index, kind, text FROM ({_ORDERED}) WHERE i <> 0")
def e3_remove(spark, sf_dir):
    return edit.remove_block(_tops(spark, sf_dir), 0).select("doc_id", "top_index", "kind", "text")


@_query(f"SELECT doc_id, i::INT AS top_index, CASE WHEN i = 1 THEN 'html_block' ELSE kind END AS kind, CASE WHEN i = 1 THEN '<hr>' ELSE text END AS text FROM ({_ORDERED})")
def e4_replace(spark, sf_dir):
    blocks = _tops(spark, sf_dir)
    return edit.replace_block(blocks, _new(spark, sf_dir, "html_block", "<hr>"), 1).select("doc_id", "top_index", "kind", "text")


@_query("""SELECT user_id AS doc_id, event_type || ' ' || event_id AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
 FROM events WHERE event_type IN ('click', 'view')) WHERE n = 2""")
def e5_nth(spark, sf_dir):
    """``heading[1]``: the second top-level heading of each document."""
    return _bare(fx.journals(spark, sf_dir)).nth("heading", 1).select("doc_id", "text")


@_query("SELECT event_id AS doc_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' || chr(10) || chr(10) || '## new' || chr(10) AS source FROM events")
def e6_set_block(spark, sf_dir):
    return fx.events(spark, sf_dir).select("doc_id", rendering.normalize(F.col("source"), set_blocks=[("heading[0]", "## new"), ("table[0]", "x")]).alias("source"))


@_query("SELECT s_suppkey AS doc_id, 'old ' || s_suppkey AS text FROM supplier")
def e7_section(spark, sf_dir):
    """The blocks between two marker comments."""
    blocks = _bare(fx.contacts(spark, sf_dir)).top().select("doc_id", "top_index", "kind", "content", "text")
    return edit.section(blocks, "from", "to").select("doc_id", "text")


@_query("""SELECT s_suppkey AS doc_id, '<https://s.example/' || s_suppkey || '>  ' || chr(10) || 'www.s.example/' || s_suppkey || ',' || chr(10) || 'mail <s' || s_suppkey || '@s.example>.' || chr(10) || chr(10) || '<div>' || chr(10) || s_name || chr(10)
 || '</div>' || chr(10) || chr(10) || '<!-- from -->' || chr(10) || chr(10) || '# new' || chr(10) || chr(10) || '- a' || chr(10) || chr(10) || '<!-- to -->' || chr(10) || chr(10) || 'end <b>x</b>' || chr(10) AS source FROM supplier""")
def e7_replace(spark, sf_dir):
    """The section between the markers replaced, the rest normalised."""
    return fx.contacts(spark, sf_dir).select("doc_id", rendering.normalize(F.col("source"), sections=[("from", "to", "new\n===\n\n* a\n")]).alias("source"))


# -- renderers ---------------------------------------------------------------------------------------


def _rendered(spark, sf_dir, to, name="text", fixture=fx.parts):
    return fixture(spark, sf_dir).select("doc_id", rendering.render(F.col("source"), to).alias(name))


@_query("""SELECT p_partkey AS doc_id, '<p><em>' || p_name || '</em> is <strong>' || p_type || '</strong> in <code>' || p_size || '</code></p>' || chr(10)
 || '<pre><code class="language-' || p_brand || '">' || p_name || chr(10) || '</code></pre>' || chr(10) AS text FROM part""")
def r1_html(spark, sf_dir):
    return _rendered(spark, sf_dir, "html")


@_query("""SELECT p_partkey AS doc_id, 'Document' || chr(10) || '├── Paragraph' || chr(10) || '│   ├── Emphasis (''*'')' || chr(10) || '│   │   └── Text "' || p_name || '"' || chr(10) || '│   ├── Text " is "' || chr(10)
 || '│   ├── Strong (''*'')' || chr(10) || '│   │   └── Text "' || p_type || '"' || chr(10) || '│   ├── Text " in "' || chr(10) || '│   └── CodeSpan "' || p_size || '"' || chr(10)
 || '└── FencedCodeBlock lang="' || p_brand || '" (' || strlen(p_name) || ' bytes)' || chr(10) AS text FROM part""")
def r2_tree(spark, sf_dir):
    return _rendered(spark, sf_dir, "ast")


@_query("""SELECT p_partkey AS doc_id, 'P' || chr(10) || ' E* "' || p_name || '"' || chr(10) || ' . " is "' || chr(10) || ' S* "' || p_type || '"' || chr(10) || ' . " in "' || chr(10) || ' ` "' || p_size || '"' || chr(10)
 || 'F~' || p_brand || chr(10) || ' ' || p_name || chr(10) AS text FROM part""")
def r3_outline(spark, sf_dir):
    return _rendered(spark, sf_dir, "ai")


@_query("""SELECT p_partkey AS doc_id, p_name || ' is ' || p_type || ' in  ' || p_size || ' ' || chr(10) || chr(10) || '╭─' || p_brand || chr(10) || '│ ' || p_name || chr(10) || '╰─' || chr(10) AS text FROM part""")
def r4_terminal(spark, sf_dir):
    """Terminal output, compared with its control sequences taken away."""
    return fx.parts(spark, sf_dir).select("doc_id", text.strip_ansi(rendering.render(F.col("source"), "terminal")).alias("text"))


@_query("""SELECT p_partkey AS doc_id, '*' || p_name || '* is **' || p_type || '** in `' || p_size || '`' || chr(10) || chr(10) || '~~~~' || p_brand || chr(10) || p_name || chr(10) || '~~~~' || chr(10) AS text FROM part""")
def r5_normalized(spark, sf_dir):
    return _rendered(spark, sf_dir, "markdown")


@_query("""SELECT p_partkey AS doc_id, '_' || p_name || '_ is *' || p_type || '* in `' || p_size || '`' || chr(10) || chr(10) || '```' || p_brand || chr(10) || p_name || chr(10) || '```' || chr(10) || chr(10) AS text FROM part""")
def r6_typst(spark, sf_dir):
    return _rendered(spark, sf_dir, "typst")


@_query("""SELECT o_orderkey AS doc_id, 'Order#footnote[' || o_orderpriority || '] stands.' || chr(10) || chr(10) AS text FROM orders""")
def r6_typst_footnotes(spark, sf_dir):
    return _rendered(spark, sf_dir, "typst", fixture=fx.notes)


@_query("SELECT doc_id, true AS title_set, true AS ends FROM documents")
def r7_typst_document(spark, sf_dir):
    """Whole documents: the title comes from the frontmatter."""
    docs = _lib(fx.pages(spark, sf_dir)).docs.select("doc_id", rendering.typst_document(F.col("body"), F.col("fm_json")).alias("t"))
    return docs.select("doc_id", F.contains("t", F.concat(F.lit('title: "doc '), F.col("doc_id").cast("string"), F.lit('"'))).alias("title_set"), F.contains("t", F.lit("== Text\n")).alias("ends"))


@_query("SELECT event_id AS doc_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' || chr(10) || chr(10) || '# ' || event_type AS source FROM events")
def r9_passthrough(spark, sf_dir):
    """Frontmatter serialized again, the body verbatim."""
    return fx.events(spark, sf_dir).select("doc_id", fmf.edit(F.col("source")).alias("source"))


@_query("SELECT event_id AS doc_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' || chr(10) || chr(10) || '# ' || event_type || chr(10) AS source FROM events")
def r10_normalize(spark, sf_dir):
    return fx.events(spark, sf_dir).select("doc_id", rendering.normalize(F.col("source")).alias("source"))


@_query()
def r1_entries(spark, sf_dir):
    """Every entry as HTML."""
    return spread(table(spark, sf_dir, "entries")).select("entry_id", rendering.render(F.col("document"), "html").alias("html"))


# -- string functions --------------------------------------------------------------------------------


@_query("SELECT entry_id, replace(replace(replace(replace(document, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM entries")
def x1_escape(spark, sf_dir):
    return table(spark, sf_dir, "entries").select("entry_id", text.html_escape(F.col("document")).alias("text"))


@_query("SELECT entry_id, len(regexp_extract_all(document, '(?i)</?(title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext)([\\s/>]|$)'))::BIGINT AS n FROM entries")
def x4_tag_filter(spark, sf_dir):
    """Angles of disallowed tags that became text."""
    before, after = F.length("document"), F.length(text.filter_tags(F.col("document")))
    return table(spark, sf_dir, "entries").select("entry_id", ((after - before) / 3).cast("bigint").alias("n"))


@_query("SELECT block_id, regexp_replace(content, '([\\\\*_`\\[\\]<>!#|~&])', '\\\\\\1', 'g') AS text FROM code_blocks")
def x6_escape(spark, sf_dir):
    return table(spark, sf_dir, "code_blocks").select("block_id", text.markdown_escape(F.col("content")).alias("text"))


@_query("SELECT block_id, base64(encode(content)) AS text FROM code_blocks")
def x8_base64(spark, sf_dir):
    return table(spark, sf_dir, "code_blocks").select("block_id", F.regexp_replace(F.base64(F.encode("content", "utf-8")), "\r\n", "").alias("text"))


@_query("SELECT entry_id, coalesce(regexp_matches(lower(path), '\\.(png|jpg|jpeg|gif|webp|bmp|tiff|tif|svg|ico)$'), false) AS is_image FROM entries")
def x9_images(spark, sf_dir):
    return table(spark, sf_dir, "entries").select("entry_id", text.is_image(F.col("path")).alias("is_image"))
