"""The training-data operators on Spark: brute force, edge cases, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chunking, mixing, neardup, packing, queries, reading, residue, template, tokens

TOKENIZER = tokens.DEFAULT_TOKENIZER
WORDS = [f"w{i}" for i in range(400)]


def jaccard_pairs(rows, n, threshold, least):
    sets = []
    for i, t in rows:
        w = neardup.WORD.findall((t or "").lower())
        if t is not None and i is not None and len(w) >= max(least, n):
            sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}))
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if a != b and len(x & y) >= threshold * len(x | y)}


def documents(seed=1):
    rng, rows = random.Random(seed), []
    for i in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(25, 120))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.choice([0, 1])] = [rng.choice(WORDS)]
            rows.append((len(rows), " ".join(copy)))
    stub = "one two three"
    return rows + [(len(rows) + k, t) for k, t in enumerate([None, "", stub, stub, rows[0][1], rows[0][1].upper()])]


def test_links_against_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc bigint, text string").withColumns({"id": F.lit(1), "bands": F.lit(2)})
    for n, threshold, least in ((3, 0.6, 20), (5, 0.8, 1)):
        found = [tuple(r) for r in neardup.pairs(*neardup.links(df, "doc", "text", n, threshold, least)).collect()]
        assert len(found) == len(set(found)) and set(found) == jaccard_pairs(rows, n, threshold, least)


def test_large_bucket(spark, monkeypatch):
    """Near copies that all share their bands: dealt into cells, searched by the tree, none lost."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(80)]
    rows = [(i, " ".join(base[:40] + [f"x{i}"] + base[40:])) for i in range(70)]
    monkeypatch.setattr(neardup, "CHUNK", 20)
    df = spark.createDataFrame(rows, "doc bigint, text string")
    members, verified = neardup.links(df, "doc", "text", 3, 0.6, 20)
    assert verified.count() == 70 * 69 // 2
    found = neardup.groups(members, verified).collect()
    assert {r["group_id"] for r in found} == {0} and {r["n_links"] for r in found} == {69} and len(found) == 70


def test_groups_without_pairs(spark, monkeypatch):
    """``grouped`` finds the groups of ``links``, in buckets where not all are linked to the least too."""
    monkeypatch.setattr(neardup, "CHUNK", 7)
    rng, rows = random.Random(9), documents()
    base = [rng.choice(WORDS) for _ in range(60)]
    for _ in range(40):  # a chain: each differs a little from the one before, the ends are not alike
        base = [*base[3:], *(rng.choice(WORDS) for _ in range(3))]
        rows.append((len(rows), " ".join(base)))
    df = spark.createDataFrame(rows + [(3, rows[9][1]), (None, rows[1][1])], "doc bigint, text string")
    want = {(r["id"], r["class_id"], r["group_id"]) for r in neardup.groups(*neardup.links(df, "doc", "text", 3, 0.6, 20)).collect()}
    assert {tuple(r) for r in neardup.grouped(df, "doc", "text", 3, 0.6, 20).collect()} == want
    assert neardup.grouped(df.where("false"), "doc", "text").count() == 0


def test_large_sets_keep_their_bound():
    """Sets of millions of shingles: counts above 16 bits still bound the overlap from above."""
    h = np.arange(6_000_000, dtype=np.uint64)
    large, small = neardup._points([neardup.group_counts(h)]), neardup._points([neardup.group_counts(h[:100])])
    assert large.sum() == 6_000_000 and small.sum() == 100 and neardup._points([neardup.group_counts(h), neardup.group_counts(h[:100])]).sum() == 6_000_100


def test_groups_along_a_chain(spark):
    members = spark.createDataFrame([(i, i) for i in range(12)] + [(20, 3)], "id bigint, class_id bigint")
    verified = spark.createDataFrame([(i, i + 1, 0.9) for i in range(8)] + [(9, 10, 0.9)], "a bigint, b bigint, similarity double")
    found = {r["id"]: (r["group_id"], r["n_links"]) for r in neardup.groups(members, verified).collect()}
    assert [found[i][0] for i in range(12)] == [0] * 9 + [9, 9, 11] and found[20] == (0, 2) and found[2][1] == 3 and found[11] == (11, 0)


def test_tree_prunes_nothing_it_must_keep():
    rng = np.random.default_rng(4)
    points = rng.poisson(2, (200, neardup.GROUPS)).astype(np.uint16)
    points[50:60] = points[0] + rng.poisson(0.1, (10, neardup.GROUPS)).astype(np.uint16)
    sizes = points.sum(1).astype(np.int64)
    tree = neardup.CountTree(points, sizes)
    for q in range(0, 200, 7):
        bound = np.minimum(points, points[q]).sum(1)
        assert set(tree.search(points[q], int(sizes[q]), 0.4)) == set(np.flatnonzero(bound >= 0.4 * (sizes + sizes[q])))


def test_links_edge_cases(spark):
    empty = spark.createDataFrame([], "doc bigint, text string")
    members, verified = neardup.links(empty, "doc", "text")
    assert members.count() == 0 and neardup.pairs(members, verified).count() == 0 and neardup.groups(members, verified).count() == 0
    long = " ".join(f"t{i % 5000}x{i // 5000}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (None, long), (3, None)]
    found = neardup.pairs(*neardup.links(spark.createDataFrame(rows, "doc bigint, text string"), "doc", "text")).collect()
    assert [tuple(r) for r in found] == [(1, 2)]
    assert neardup.bands_for(0.8) < neardup.bands_for(0.6) and (1 - 0.6**neardup.ROWS) ** neardup.bands_for(0.6) < neardup.MISS


def test_one_identifier_with_several_texts(spark):
    """Each text keeps its class and its links; the representative of both classes is identifier 1."""
    rng = random.Random(6)
    a, b, c = ([rng.choice(WORDS) for _ in range(60)] for _ in range(3))
    text = lambda w, *more: " ".join([*w, *more])
    rows = [(1, text(a)), (2, text(a)), (2, text(b)), (1, text(b)), (3, text(b)), (4, text(b, "end")), (5, text(a, "end")), (6, text(c)), (4, text(b, "end"))]
    members, verified = neardup.links(spark.createDataFrame(rows, "doc bigint, text string"), "doc", "text", 3, 0.6, 20)
    found = [tuple(r) for r in neardup.pairs(members, verified).collect()]
    assert len(found) == len(set(found)) and set(found) == jaccard_pairs(rows, 3, 0.6, 20) >= {(3, 4), (2, 3), (1, 5)}
    out = sorted(tuple(r) for r in neardup.groups(members, verified).collect())
    assert out == [(1, 1, 1, 2), (2, 1, 1, 2), (3, 1, 1, 1), (4, 4, 1, 3), (5, 5, 1, 2), (6, 6, 6, 0)]


def test_splitting(spark):
    text = "para one.\n\n" * 30
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (3, None), (4, ""), (5, "é" * 120)], "id int, text string").withColumns({"piece": F.lit(0), "_text": F.lit("x")})
    rows = chunking.split_oversized(df, "id", "text", 100, 10).collect()
    assert {r["id"] for r in rows} == {1, 5} and all(len(r["piece"]) == r["end"] - r["start"] <= 100 for r in rows)
    assert all(r["piece"] == text[r["start"] : r["end"]] for r in rows if r["id"] == 1) and {r["item_level"] for r in rows if r["id"] == 5} == {"char"}
    small = chunking.split_oversized(df, "id", "text", 100, 10, keep_small=True).where("id in (2, 3, 4)").collect()
    assert sorted((r["id"], r["piece"]) for r in small) == [(2, "short"), (4, "")]
    assert chunking.split_oversized(df.where("false"), "id", "text").count() == 0


def test_residue(spark):
    df = spark.createDataFrame([(1, "<b>x</b> [[y]]", None), (2, None, "py"), (3, "", None), (4, "x" * 500_000 + " &amp; y", "c")], "id int, t string, lang string")
    found = residue.found_kinds(df, "entry", "id", residue.residue(F.col("t"))).collect()
    assert sorted(tuple(r) for r in found) == [("entry", 1, "html"), ("entry", 1, "wiki"), ("entry", 4, "html")]
    clean = {r["id"]: r["c"]["text"] for r in df.select("id", residue.residue(F.col("t"), F.col("lang"), block=True).alias("c")).collect()}
    assert clean[2] is None and clean[3] == "" and clean[4].endswith(" & y")
    assert residue.found_kinds(df.where("false"), "e", "id", residue.residue(F.col("t"))).count() == 0


def test_template_deduction(spark):
    """A frame with a list of entries in it, on every page of a host; another host has its own."""
    rng = random.Random(3)
    word = lambda: rng.choice(WORDS)

    def page(k):
        items = "".join(f"<item> name {word()} price {word()} </item>" for _ in range(k))
        return f"<head> Shop {word()} {word()} Welcome <body> {items} Footer imprint {word()}"

    rows = [(k, "a", page(k)) for k in range(1, 7)] + [(10 + k, "b", f"{word()} Other {word()} frame {word()}") for k in range(4)] + [(20, None, page(2)), (21, "a", None), (22, "c", page(1)), (23, "c", "")]
    df = spark.createDataFrame(rows, "id int, site string, text string").withColumns({"host": F.lit(1), "page": F.lit(2)})
    classes, places = template.deduce(df, "site", "text")
    found = {tuple(r["tokens"]): r for r in classes.where("valid").collect()}
    frame, item = ("<head", "Shop", "Welcome", "<body", "Footer", "imprint"), ("<item", "name", "price", "</item")
    assert found[frame]["pages"] == 6 and found[frame]["parent"] is None and found[frame]["host"] == "a"
    assert (found[item]["parent"], found[item]["gap"]) == (found[frame]["class_id"], 4) and ("Other", "frame") in found and all(r["host"] != "c" for r in found.values())
    got = {}
    for r in template.slots(df, "site", "id", "text").orderBy("id", "slot_no").collect():
        got.setdefault(r["id"], []).append(r["slot"].strip(" >"))
    words = lambda t: [w for w in t.split() if w in WORDS]
    assert [w for s in got[3] for w in s.split()] == words(rows[2][2]) and got[22] == [rows[-2][2]] and set(got) == {1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 22}
    assert template.deduce(df.where("false"), "site", "text")[0].count() == 0


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 0, 5, 10, 30, 64, 65, 200, rng.randrange(64)])) for i in range(500)] + [(0, 200), (0, 200), (None, 7)]
    df = spark.createDataFrame(rows, "id bigint, size bigint").withColumns({"n": F.lit(1), "_shard": F.lit(2), "container": F.lit("x")})
    out = packing.pack(df, "id", F.col("size"), 64, bucket_items=100)
    got = out.collect()
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n"]
    assert max(fill.values()) <= 64 and sum(fill.values()) == sum(s or 0 for _, s in rows)
    assert sum(r["piece_no"] == 0 for r in got) == len(rows) and sum(fill.values()) / (64 * len(fill)) > 0.95
    assert {r["id"] for r in got if r["piece_no"] >= 1} == {i for i, s in rows if s and s > 64}
    assert packing.pack(df.where("false"), "id", F.col("size"), 64).count() == 0
    # The containers of the plain algorithm over all items at once, however many buckets there are.
    whole = packing.best_fit_decreasing([n for _, s in rows for n in [(s or 0) % 64] if n or not s], 64)
    assert len({r["container"] for r in got if r["n"] < 64}) == len(set(whole))
    assert len({r["container"] for r in packing.pack(df, "id", F.col("size"), 64, bucket_items=7).collect()}) == len(fill)


@pytest.fixture
def tokenizer():
    import os

    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer files")


def test_tokens(spark, tokenizer):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",), ("a " * 30_000,)], "t string")
    n = [r[0] for r in df.select(tokens.n_tokens(F.col("t"))).collect()]
    assert n[0] == 2 and n[1:3] == [0, 0] and n[3] > 1 and n[4] >= 30_000


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice([" Big", "big", "BIG "]), rng.randrange(1, 50), rng.random()) for i in range(3000)] + [(10_000 + i, "small", 10, 0.5) for i in range(50)] + [(20_000, "other", 9999, 1.0), (20_001, None, 5, 1.0), (20_002, "zero", 0, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, n bigint, score double")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small", 0.05, 4), ("none", 0.1, 9), ("zero", 0.0, 1), ("null", None, None)], "source string, target_share double, max_repeats int")
    rows = frame.select("doc_id", mixing.source_key(F.col("source")).alias("source_key"), "n", mixing.quality_of(F.col("score")).alias("quality"))
    planned = mixing.plan(rows, targets)
    by = {r["source"]: r for r in planned.collect()}
    big = sum(n for _, s, n, _ in docs if s and s.strip().lower() == "big")
    assert by["big"]["size"] == big and by["big"]["total"] == big + 500 and by["Small"]["size"] == 500 and not by["big"]["short"]
    assert by["Small"]["short"] == (500 * 4 < 0.05 * (big + 500)) and by["none"]["short"] and not by["zero"]["short"] and by["null"]["short"] is None
    drawn = mixing.draw(rows, planned, per_octave=4).collect()
    total = sum(r["n"] * r["repeats"] for r in drawn if r["source"] == "big")
    assert 0.5 * (big + 500) - 50 <= total <= 0.5 * (big + 500) and len({r["doc_id"] for r in drawn}) == len(drawn)
    assert all(r["repeats"] <= 4 for r in drawn) and {r["source"] for r in drawn} <= {"big", "Small"}
    # The same documents whatever the number of ranges: prefix sums in the order of the keys.
    assert {(r["doc_id"], r["repeats"]) for r in mixing.draw(rows, planned, per_octave=1).collect()} == {(r["doc_id"], r["repeats"]) for r in drawn}
    shares = {r["source"]: r for r in mixing.shares(planned, mixing.draw(rows, planned)).collect()}
    assert abs(shares["big"]["share_of_total"] - 0.5) < 0.01 and shares["none"]["drawn"] == 0
    assert {k: r["short"] for k, r in shares.items()} == {k: r["short"] for k, r in by.items()}
    assert mixing.plan(rows.where("false"), targets).where("short").count() == 0 and mixing.draw(rows, mixing.plan(rows, targets.where("false"))).count() == 0


def test_scale_of_a_source(spark):
    """0.8 is low in a source that counts to 100, and high in one that counts to 1."""
    df = spark.createDataFrame([(1, "a", "x", 0.8), (2, "A ", "x", 90.0), (3, "b", "x", 0.8), (4, "b", "x", None), (5, None, "x", 50.0), (6, "b", None, float("nan"))], "doc_id int, source string, text string, align_score double")
    assert {r["doc_id"]: round(r["quality"], 3) for r in mixing.sized(df).collect()} == {1: 0.01, 2: 0.9, 3: 0.8, 4: 0.5, 5: 0.5, 6: 0.5}


def test_heavier_documents_come_first(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source_key"), F.lit(1).cast("bigint").alias("n"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1).alias("quality"))
    targets = spark.createDataFrame([("s", 0.25, 1)], "source string, target_share double, max_repeats int")
    drawn = [r["doc_id"] for r in mixing.draw(rows, mixing.plan(rows, targets)).collect()]
    assert len(drawn) == 1000 and sum(d % 2 == 0 for d in drawn) > 800


def test_grading(spark):
    samples = spark.createDataFrame([("en", g, f"{w} {w} and the") for g, w in ((1, "cat"), (5, "law")) for _ in range(3)] + [(None, 1, "x"), ("en", None, "y"), ("en", 2, None)], "lang string, grade int, text string")
    model = reading.train(samples)
    df = spark.createDataFrame([(1, "the law and the law and the law"), (2, "law law"), (3, None), (4, ""), (5, "q " * 20), (6, "the cat and " * 20_000)], "id int, t string").withColumn("grade", F.lit(0))
    assert {r["id"]: r["grade"] for r in reading.grade(df, model, "id", "t").collect()} == {1: 5, 2: None, 3: None, 4: None, 5: None, 6: 1}
    assert reading.grade(df.where("false"), model, "id", "t").count() == 0
    with pytest.raises(ValueError):
        reading.train(samples, max_samples=3)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, tokenizer, name):
    assert queries.QUERIES[name](spark, small).count() >= 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW entries AS SELECT * FROM '{small}/entries.parquet'")
    for other in ("documents", "mix_targets", "code_blocks"):
        con.sql(f"CREATE VIEW {other} AS SELECT * FROM '{small}/{other}.parquet'")
    found = queries.QUERIES[name](spark, small)
    want = con.sql(queries.ORACLE[name])
    assert sorted(tuple(r) for r in found.select(*want.columns).collect()) == sorted(want.fetchall())
