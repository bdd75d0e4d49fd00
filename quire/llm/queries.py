"""Queries of the training-data problems (p4 to p9) and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import chunking, mixing, neardup, packing, reading, residue, template
from quire.runtime import materialize, table


def p4_found(spark, sf_dir):
    cut = chunking.split_oversized(table(spark, sf_dir, "entries"), "entry_id", "document")
    return cut.where("piece_no = 0").select("entry_id", F.col("item_level").alias("cut_level"))


def p4_pieces(spark, sf_dir):
    """Every piece of every oversized entry, with its text."""
    return chunking.split_oversized(table(spark, sf_dir, "entries"), "entry_id", "document")


def p4_joined(spark, sf_dir):
    """Every oversized entry put together again from its pieces without their overlaps, the largest piece and
    whether all overlaps agree."""
    cut = p4_pieces(spark, sf_dir).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"))
    rest = F.transform(F.slice("p", 2, F.size("p")), lambda x: F.substring(x["piece"], 201, 4000))
    shared = lambda x, i: F.substring(F.get("p", i)["piece"], -200, 200) == F.substring(x["piece"], 1, 200)
    return cut.select(
        "entry_id", F.concat(F.get("p", 0)["piece"], F.array_join(rest, "")).alias("document"), (F.array_max(F.transform("p", lambda x: F.length(x["piece"]))) <= 4000).alias("fits"),
        F.forall(F.transform(F.slice("p", 2, F.size("p")), shared), lambda same: same).alias("overlaps"),
    )


def p5_found(spark, sf_dir):
    entries = table(spark, sf_dir, "entries").select("entry_id", "document")
    blocks = table(spark, sf_dir, "code_blocks").select("block_id", "content", "language")
    return residue.found_kinds(entries, "entry", "entry_id", residue.residue(F.col("document"), with_text=False)).unionByName(
        residue.found_kinds(blocks, "block", "block_id", residue.residue(F.col("content"), F.col("language"), block=True, with_text=False))
    )


def p5_clean(spark, sf_dir):
    """The clean text of every entry and code block."""
    entries = table(spark, sf_dir, "entries").select(F.lit("entry").alias("record_kind"), F.col("entry_id").alias("record_id"), residue.residue(F.col("document"))["text"].alias("text"))
    blocks = table(spark, sf_dir, "code_blocks")
    return entries.unionByName(blocks.select(F.lit("block").alias("record_kind"), F.col("block_id").alias("record_id"), residue.residue(F.col("content"), F.col("language"), block=True)["text"].alias("text")))


def p5_classes(spark, sf_dir):
    """Equivalence classes of tokens over the entries of each library: how many of what size on how many pages."""
    found = template.occurrences(table(spark, sf_dir, "entries"), "library_id", "document")
    return template.equivalence_classes(found).groupBy("host", "class_id", "pages", "n_tokens").agg(F.count("*").alias("n")).groupBy(F.col("host").alias("library_id"), "pages", "n_tokens").agg(F.count("*").alias("n_classes"))


def p5_templates(spark, sf_dir):
    """What template deduction finds in each library: classes, valid and nested ones, and those with markup."""
    classes, _ = template.deduce(table(spark, sf_dir, "entries"), "library_id", "document")
    markup = F.exists("tokens", lambda t: t.rlike(template.MARKUP))
    return classes.groupBy(F.col("host").alias("library_id")).agg(
        F.count("*").alias("n_classes"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("parent").isNotNull()).alias("n_nested"), F.count_if(F.col("valid") & markup).alias("n_markup")
    )


def p5_reach(spark, sf_dir):
    """Entries with residue by the scanner, and how many of them hold a markup token of a valid class."""
    entries = table(spark, sf_dir, "entries").select(F.col("entry_id").alias("page"), "library_id", "document")
    _, places = template.deduce(entries, "library_id", "document", page_col="page")
    held = places.where(F.exists("at", lambda x: x["token"].rlike(template.MARKUP))).select("page").distinct().withColumn("held", F.lit(True))
    kinds = residue.residue(F.col("document"), with_text=False)["markup"]
    marked = entries.select("page", kinds.alias("m")).where(F.size("m") > 0)
    return marked.join(held, "page", "left").agg(F.count("*").alias("n_entries"), F.count("held").alias("n_reached"))


def p5_slots(spark, sf_dir):
    """What stands between the template's tokens on every entry."""
    return template.slots(table(spark, sf_dir, "entries"), "library_id", "entry_id", "document")


def _near(spark, sf_dir):
    return neardup.links(table(spark, sf_dir, "entries"), "entry_id", "document", words=3, similarity=0.6, min_words=20)


def p6_found(spark, sf_dir):
    return neardup.pairs(*_near(spark, sf_dir)).select(F.col("id_1").alias("entry_id_1"), F.col("id_2").alias("entry_id_2"))


def p6_groups(spark, sf_dir):
    """One row per entry: its class of equal shingle sets and its group."""
    return neardup.grouped(table(spark, sf_dir, "entries"), "entry_id", "document", words=3, similarity=0.6, min_words=20).withColumnRenamed("id", "entry_id")


def p6_links(spark, sf_dir):
    """One row per entry: its class, its group and how many entries of other texts it is linked to."""
    members, verified = _near(spark, sf_dir)
    return neardup.groups(members, materialize(verified, "neardup-links")).withColumnRenamed("id", "entry_id")


def p7_found(spark, sf_dir):
    packed = packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packed.where("piece_no = 1").select("doc_id")


def p7_containers(spark, sf_dir):
    """The container of every document, in pieces where one alone is too large."""
    return packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_fill(spark, sf_dir):
    """Containers, tokens and the share of room in use."""
    used = p7_containers(spark, sf_dir).groupBy("container").agg(F.sum("n").alias("n"))
    return used.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), (F.sum("n") / (F.count("*") * 1024)).alias("fill"))


def p7_by_length(spark, sf_dir):
    """Documents packed by their characters: pieces and size of each, and whether its containers keep to the capacity."""
    packed = packing.pack(table(spark, sf_dir, "documents"), "doc_id", F.length("text"))
    full = packed.groupBy("container").agg(F.sum("n").alias("_in"))
    return packed.join(full, "container").groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.sum("n").alias("n"), F.bool_and(F.col("_in") <= 1024).alias("fits"))


def p8_by_length(spark, sf_dir):
    """A mixture by characters: what each source has, whether it is short, and whether it keeps its bounds."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    rows = docs.select("doc_id", mixing.source_key(F.col("source")).alias("source_key"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"), mixing.quality_of(F.col("align_score")).alias("quality"))
    planned = materialize(mixing.plan(rows, targets), "mix-plan")
    found = mixing.shares(planned, mixing.draw(rows, planned)).join(planned.select("source", "budget"), "source")
    return found.select("source", "size", "short", ((F.col("drawn") <= F.col("budget")) & (F.col("most_repeats") <= F.col("max_repeats"))).alias("bounded"))


def p8_found(spark, sf_dir):
    return p8_shares(spark, sf_dir).where("short").select("source")


def p8_drawn(spark, sf_dir):
    """The drawn documents and how often each is used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_shares(spark, sf_dir):
    """Target and reached share of each source."""
    return mixing.shares(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def _graded(spark, sf_dir):
    return reading.grade(table(spark, sf_dir, "documents"), reading.train(table(spark, sf_dir, "graded_samples")), "doc_id", "text")


def p9_found(spark, sf_dir):
    return _graded(spark, sf_dir).where("grade >= 4").select("doc_id")


def p9_levels(spark, sf_dir):
    """Language, grade and its probability for every document."""
    return _graded(spark, sf_dir)


def p9_profile(spark, sf_dir):
    """Documents per language and grade; ungraded ones under a null grade."""
    return _graded(spark, sf_dir).groupBy("lang", "grade").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


QUERIES = {f.__name__: f for f in (p4_found, p4_pieces, p4_joined, p5_found, p5_clean, p5_classes, p5_templates, p5_reach, p5_slots, p6_found, p6_groups, p6_links, p7_found, p7_containers, p7_fill, p7_by_length, p8_found, p8_drawn, p8_shares, p8_by_length, p9_found, p9_levels, p9_profile)}

_NEAR = r"""
WITH RECURSIVE words AS (SELECT entry_id, regexp_extract_all(lower(document), '[\p{L}\p{N}]+') AS w FROM entries),
shingles AS (SELECT DISTINCT entry_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) >= 20),
sizes AS (SELECT entry_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.entry_id AS x, b.entry_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.entry_id < b.entry_id GROUP BY ALL),
pairs AS (SELECT x, y, shared.n = p.n AND shared.n = q.n AS equal FROM shared JOIN sizes p ON p.entry_id = x JOIN sizes q ON q.entry_id = y WHERE shared.n >= 0.6 * (p.n + q.n - shared.n)),
sides AS (SELECT x, y, equal FROM pairs UNION ALL SELECT y, x, equal FROM pairs),
reach AS (SELECT entry_id AS x, entry_id AS y FROM sizes UNION SELECT r.x, b.y FROM reach r JOIN sides b ON b.x = r.y),
grouped AS (SELECT s.entry_id, least(s.entry_id, (SELECT min(y) FROM sides b WHERE b.x = s.entry_id AND equal)) AS class_id, (SELECT min(y) FROM reach r WHERE r.x = s.entry_id) AS group_id FROM sizes s)
"""

ORACLE: dict[str, str] = {
    "p4_joined": "SELECT entry_id, document, true AS fits, true AS overlaps FROM entries WHERE len(document) > 4000",
    "p7_by_length": "SELECT doc_id, greatest(1, ceil(coalesce(len(text), 0) / 1024))::BIGINT AS n_pieces, coalesce(len(text), 0)::BIGINT AS n, true AS fits FROM documents",
    "p8_by_length": """
WITH sizes AS (SELECT lower(trim(source)) AS k, sum(coalesce(len(text), 0)) AS n FROM documents GROUP BY 1),
have AS (SELECT t.*, coalesce(s.n, 0)::BIGINT AS size FROM mix_targets t LEFT JOIN sizes s ON s.k = lower(trim(t.source)))
SELECT source, size, size * max_repeats < target_share * (SELECT sum(size) FROM have)::DOUBLE AS short, true AS bounded FROM have""",
    "p5_classes": r"""
WITH tokens AS (SELECT library_id, entry_id, unnest(regexp_extract_all(document, '</?[A-Za-z][A-Za-z0-9]*|\{\{|\}\}|\[\[|\]\]|''''+|\\[A-Za-z]+|[\p{L}\p{N}]+')) AS token FROM entries),
counts AS (SELECT library_id, entry_id, token, count(*) AS n FROM tokens GROUP BY ALL),
vectors AS (SELECT library_id, token, list((entry_id, n) ORDER BY entry_id) AS v FROM counts GROUP BY ALL HAVING count(*) >= 3),
classes AS (SELECT library_id, v, len(v)::BIGINT AS pages, count(*)::BIGINT AS n_tokens FROM vectors GROUP BY ALL HAVING count(*) >= 2)
SELECT library_id, pages, n_tokens, count(*)::BIGINT AS n_classes FROM classes GROUP BY ALL""",
    "p6_found": _NEAR + "SELECT x AS entry_id_1, y AS entry_id_2 FROM pairs",
    "p6_groups": _NEAR + "SELECT * FROM grouped",
    "p6_links": _NEAR + "SELECT *, (SELECT count(*) FROM sides b WHERE b.x = g.entry_id AND NOT equal)::BIGINT AS n_links FROM grouped g",
}
