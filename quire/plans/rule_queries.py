"""One query per parsing rule and scalar function: Markdown made from part rows, compared with SQL
that writes down what the rule must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import frontmatter as fmf
from quire.functions import rendering, text
from quire.operators.library import Library
from quire.runtime import spread, table

QUERIES, ORACLE = {}, {}

#: rule -> (source, expected HTML), both SQL expressions over p_name, p_type, p_size; N is a line feed.
HTML_RULES = {
    "p1_driver": ("p_name || N || N || '# ' || p_type", "'<p>' || p_name || '</p>' || N || '<h1>' || p_type || '</h1>' || N"),
    "p4_order": ("'- - -' || N || '    ' || p_name || N || '+ ' || p_type", "'<hr />' || N || '<pre><code>' || p_name || N || '</code></pre>' || N || '<ul>' || N || '<li>' || p_type || '</li>' || N || '</ul>' || N"),
    "p5_atx": ("'### ' || p_name || ' ##' || N || '#' || p_type", "'<h3>' || p_name || '</h3>' || N || '<p>#' || p_type || '</p>' || N"),
    "p6_setext": ("p_name || N || '===' || N || p_type || N || '---'", "'<h1>' || p_name || '</h1>' || N || '<h2>' || p_type || '</h2>' || N"),
    "p7_breaks": ("'***' || N || p_name || N || N || '_ _ _'", "'<hr />' || N || '<p>' || p_name || '</p>' || N || '<hr />' || N"),
    "p8_indented": ("'    ' || p_name || N || N || '      ' || p_type", "'<pre><code>' || p_name || N || N || '  ' || p_type || N || '</code></pre>' || N"),
    "p10_quotes": ("'> ' || p_name || N || p_type || N || N || '> > x'", "'<blockquote>' || N || '<p>' || p_name || N || p_type || '</p>' || N || '</blockquote>' || N || '<blockquote>' || N || '<blockquote>' || N || '<p>x</p>' || N || '</blockquote>' || N || '</blockquote>' || N"),
    "p11_nested": ("p_size || '. a' || N || '   - ' || p_name || N || N || p_size || '. b'", "CASE WHEN p_size < 10 THEN (CASE WHEN p_size = 1 THEN '<ol>' ELSE '<ol start=\"' || p_size || '\">' END) || N || '<li>' || N || '<p>a</p>' || N || '<ul>' || N || '<li>' || p_name || '</li>' || N || '</ul>' || N || '</li>' || N || '<li>' || N || '<p>b</p>' || N || '</li>' || N || '</ol>' || N ELSE '<ol start=\"' || p_size || '\">' || N || '<li>a</li>' || N || '</ol>' || N || '<ul>' || N || '<li>' || p_name || '</li>' || N || '</ul>' || N || '<ol start=\"' || p_size || '\">' || N || '<li>b</li>' || N || '</ol>' || N END"),
    "p16_paragraphs": ("p_name || N || '  ' || p_type || N || N || N || 'x'", "'<p>' || p_name || N || p_type || '</p>' || N || '<p>x</p>' || N"),
    "p18_labels": ("'[A  ' || p_type || ']' || N || N || '[a ' || lower(p_type) || ']: /u'", "'<p><a href=\"/u\">A  ' || p_type || '</a></p>' || N"),
    "p19_inlines": ("'a * b _ ' || p_name || ' ] ['", "'<p>a * b _ ' || p_name || ' ] [</p>' || N"),
    "p20_rule_of_three": ("'***' || p_name || '** ' || p_type || '*'", "'<p><em><strong>' || p_name || '</strong> ' || p_type || '</em></p>' || N"),
    "p20_strikethrough": ("'~~' || p_name || '~~ ~~~' || p_type || '~~~'", "'<p><del>' || p_name || '</del> ~~~' || p_type || '~~~</p>' || N"),
    "p21_code_spans": ("'`` ' || p_name || ' ` x ``'", "'<p><code>' || p_name || ' ` x</code></p>' || N"),
    "p22_links": ("'[' || p_name || '](/a(b)' || p_size || ' \"t\") ![' || p_type || '](<i m>)'", "'<p><a href=\"/a(b)' || p_size || '\" title=\"t\">' || p_name || '</a> <img src=\"i%20m\" alt=\"' || p_type || '\" /></p>' || N"),
    "p23_references": ("'[' || p_type || '][] [x][' || p_type || '] [y [z](/w)](/v)' || N || N || '[' || p_type || ']: /r'", "'<p><a href=\"/r\">' || p_type || '</a> <a href=\"/r\">x</a> [y <a href=\"/w\">z</a>](/v)</p>' || N"),
    "p24_autolinks": ("'<ab+c:' || p_size || '> <m' || p_size || '@x.y> <5 b>'", "'<p><a href=\"ab+c:' || p_size || '\">ab+c:' || p_size || '</a> <a href=\"mailto:m' || p_size || '@x.y\">m' || p_size || '@x.y</a> &lt;5 b&gt;</p>' || N"),
    "p26_raw_html": ("'x <b class=\"' || p_type || '\"> <!-- c --> <3 <script>'", "'<p>x <b class=\"' || p_type || '\"> <!-- c --> &lt;3 &lt;script></p>' || N"),
    "p27_escapes": ("'\\*' || p_name || '\\* a\\' || N || 'b  ' || N || 'c'", "'<p>*' || p_name || '* a<br />' || N || 'b<br />' || N || 'c</p>' || N"),
    "p28_unicode": ("'a*«' || p_name || '»*b *«' || p_name || '»*'", "'<p>a*«' || p_name || '»*b <em>«' || p_name || '»</em></p>' || N"),
    "p29_alt_text": ("'![*' || p_name || '* [' || p_type || '](/x) `c`](/i)'", "'<p><img src=\"/i\" alt=\"' || p_name || ' ' || p_type || ' c\" /></p>' || N"),
}


def _parts(spark, sf_dir):
    return spread(table(spark, sf_dir, "part"))


def _add_html(rule: str, source: str, expected: str) -> None:
    def query(spark, sf_dir):
        # Spark's string literals read a backslash as an escape; SQL's do not.
        made = F.expr(source.replace("\\", "\\\\").replace(" N", " char(10)"))
        return _parts(spark, sf_dir).select("p_partkey", rendering.render(made, "html").alias("html"))

    query.__name__ = name = f"parse_{rule}"
    query.__doc__ = f"Rule {rule} as HTML."
    QUERIES[name] = query
    ORACLE[name] = f"SELECT p_partkey, {expected.replace(' N', ' chr(10)')} AS html FROM part"


for _rule, (_source, _expected) in HTML_RULES.items():
    _add_html(_rule, _source, _expected)


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@_query("SELECT p_partkey, '<p>m' || p_size || '@x.y &lt;b&gt;</p>' || chr(10) || '<title>' || chr(10) AS html FROM part")
def parse_p31_plain(spark, sf_dir):
    """Without the GFM extensions: no bare autolinks, no tag filter."""
    made = F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit("@x.y \\<b>\n\n<title>"))
    return _parts(spark, sf_dir).select("p_partkey", rendering.render(made, "html", gfm=False).alias("html"))


@_query("SELECT p_partkey AS doc_id, 'heading' AS kind, p_name AS text FROM part")
def parse_p3_front(spark, sf_dir):
    """The parser itself skips a leading delimited block that holds a colon."""
    made = F.concat(F.lit("%%%\na: 1\n%%%\n# "), "p_name")
    lib = Library.from_column(_parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), made.alias("source")), "doc_id", "source", strip="library")
    return lib.nodes().select("doc_id", "kind", "text")


@_query("SELECT p_partkey AS doc_id, p_name AS title, p_size::BIGINT AS size, true AS tagged FROM part")
def f4_zon(spark, sf_dir):
    """ZON frontmatter, braces inside strings and enum literals included."""
    made = F.concat(F.lit('.{ .title = "'), "p_name", F.lit(' }", .size = '), F.col("p_size").cast("string"), F.lit(", .tags = .{ .part, 0x10 }, }\n# x"))
    lib = Library.from_column(_parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), made.alias("source")), "doc_id", "source")
    fm = F.try_parse_json("fm_json")
    tagged = fmf.equals(fm, "tags", "part") & fmf.equals(fm, "tags", "16")
    return lib.docs.select("doc_id", F.regexp_replace(F.try_variant_get(fm, "$.title", "string"), " }$", "").alias("title"), F.try_variant_get(fm, "$.size", "bigint").alias("size"), tagged.alias("tagged"))


@_query("SELECT p_partkey AS doc_id, p_name AS title, p_size::BIGINT AS size, p_retailprice AS price FROM part")
def f6_toml(spark, sf_dir):
    made = F.concat(F.lit('+++\ntitle = "'), "p_name", F.lit('"\n[extra]\nsize = '), F.col("p_size").cast("string"), F.lit("\nprice = "), F.format_string("%.4f", F.col("p_retailprice")), F.lit("\n+++\n# x"))
    lib = Library.from_column(_parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), made.alias("source")), "doc_id", "source")
    get = lambda p, t: F.try_variant_get(F.try_parse_json("fm_json"), p, t)
    return lib.docs.select("doc_id", get("$.title", "string").alias("title"), get("$.extra.size", "bigint").alias("size"), get("$.extra.price", "double").alias("price"))


@_query("""SELECT p_partkey, v.raw, CASE v.k WHEN 'n' THEN p_size::VARCHAR WHEN 'f' THEN p_size || '.5' WHEN 's' THEN '"' || p_name || '"' ELSE v.k END AS value
 FROM part, LATERAL (VALUES (p_size::VARCHAR, 'n'), (p_size || '.5', 'f'), (p_name, 's'), ('true', 'true'), ('null', 'null')) v(raw, k)""")
def f12_infer(spark, sf_dir):
    size = F.col("p_size").cast("string")
    raw = F.explode(F.array(size, F.concat(size, F.lit(".5")), F.col("p_name"), F.lit("true"), F.lit("null")))
    return _parts(spark, sf_dir).select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", text.infer(F.col("raw")).alias("value"))


@_query("SELECT p_partkey, p_name AS value, false AS quoted FROM part UNION ALL SELECT p_partkey, p_size::VARCHAR, true FROM part UNION ALL SELECT p_partkey, '#' || p_type, true FROM part")
def f17_quoting(spark, sf_dir):
    value = F.explode(F.array(F.col("p_name"), F.col("p_size").cast("string"), F.concat(F.lit("#"), "p_type")))
    return _parts(spark, sf_dir).select("p_partkey", value.alias("value")).select("p_partkey", "value", text.yaml_needs_quote(F.col("value")).alias("quoted"))


@_query("SELECT event_id AS doc_id, '{' || chr(10) || '  \"t\": \"x\"' || chr(10) || '}' || chr(10) || chr(10) || '# ' || event_type AS source FROM events")
def e8_set_then_delete(spark, sf_dir):
    """Fields are set first, then deleted; what cannot be done is skipped."""
    made = F.concat("props", F.lit("\n# "), "event_type")
    return spread(table(spark, sf_dir, "events")).select(F.col("event_id").alias("doc_id"), fmf.edit(made, sets=["t=x", "k.a=1", "noequals"], deletes=["k", "zz"]).alias("source"))


@_query("SELECT p_partkey, p_name || ' & <é> ' || chr(65) || ' &nope;' AS text FROM part")
def x2_entities(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" &amp; &lt;&eacute;&gt; &#65; &nope;"))
    return _parts(spark, sf_dir).select("p_partkey", text.decode_entities(raw).alias("text"))


@_query("SELECT p_partkey, '/' || replace(p_name, ' ', '%20') || '?a=%C3%A9&b=(1)%20' AS url FROM part")
def x3_urls(spark, sf_dir):
    raw = F.concat(F.lit("/"), "p_name", F.lit("?a=&eacute;&amp;b=\\(1\\)%20"))
    return _parts(spark, sf_dir).select("p_partkey", text.link_url(raw).alias("url"))


@_query("SELECT p_partkey, p_name || ' ' || p_type AS text FROM part")
def x7_strip_ansi(spark, sf_dir):
    raw = F.concat(F.lit("\x1b[1m\x1b[35m"), "p_name", F.lit("\x1b[0m \x1b]8;;http://x\x1b\\"), "p_type", F.lit("\x1b]8;;\x1b\\"))
    return _parts(spark, sf_dir).select("p_partkey", text.strip_ansi(raw).alias("text"))


@_query("SELECT p_partkey, v.s, v.class FROM part, LATERAL (VALUES (p_name, 'letter'), (p_size::VARCHAR, 'digit'), ('#' || p_type, 'punctuation'), (' ' || p_type, 'whitespace'), ('é', 'other'), ('', 'empty')) v(s, class)")
def x10_classes(spark, sf_dir):
    s = F.explode(F.array(F.col("p_name"), F.col("p_size").cast("string"), F.concat(F.lit("#"), "p_type"), F.concat(F.lit(" "), "p_type"), F.lit("é"), F.lit("")))
    return _parts(spark, sf_dir).select("p_partkey", s.alias("s")).select("p_partkey", "s", text.char_class(F.col("s")).alias("class"))


@_query("SELECT p_partkey, lower(p_type) || ' ' || p_name || ' ss' AS label FROM part")
def x11_labels(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_type", F.lit(" \n\t"), "p_name", F.lit(" ẞ "))
    return _parts(spark, sf_dir).select("p_partkey", text.normalize_label(raw).alias("label"))
