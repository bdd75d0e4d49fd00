"""Incremental loads, shredding and schema drift: rules, edge cases, brute force."""

import hashlib
import json
import posixpath
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.core import jsontree
from quire.operators import drift, incremental, shred



@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """The plans of this module run with code generation, as users' plans do."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


T0 = datetime(2025, 1, 1)
FEED = "feed_id bigint, library_id bigint, path string, content_hash bigint, n_bytes bigint, modified_at timestamp, arrived_at timestamp, scanner string"
RUNS = "run_id bigint, library_id bigint, cutoff_at timestamp, status string"


def brute(feed, runs):
    out, rows = set(), {}
    for f in feed:
        if f[3] is not None:
            key = ("p", posixpath.normpath(f[2]) if f[2] else ".") if f[2] is not None else ("h", f[3])
            rows.setdefault((f[1], key), []).append(f)

    def state(rs, cutoff):
        seen = [r for r in rs if r[6] <= cutoff]
        return max(seen, key=lambda r: (r[5] or r[6], r[0])) if seen else None

    ok = sorted((r for r in runs if r[3] == "succeeded"), key=lambda r: (r[1], r[2], r[0]))
    for i, run in enumerate(ok):
        before = ok[i - 1] if i and ok[i - 1][1] == run[1] else None
        for (lib, _), rs in rows.items():
            if lib == run[1]:
                now, old = state(rs, run[2]), state(rs, before[2]) if before else None
                if now and (not old or old[3] != now[3]):
                    out.add((run[0], now[0]))
    return out


def test_replay_against_brute_force(spark):
    rng = random.Random(5)
    paths = ["a.md", "./a.md", "x/../a.md", "d//b.md", "d/b.md", None, "", "../u.md"]
    at = lambda: T0 + timedelta(hours=rng.randrange(60))
    # Library 1 holds most rows, and library 3 has no run.
    feed = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice(paths), rng.choice([1, 2, 3, None]), 9, rng.choice([None, at()]), at(), "s") for i in range(400)]
    runs = [(i, rng.choice([1, 1, 2]), at() + timedelta(minutes=i), rng.choice(["succeeded", "succeeded", "failed", "running"])) for i in range(40)]
    frames = spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS)
    found = [tuple(r) for r in incremental.replay(*frames).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(feed, runs)
    repeated = incremental.replay(frames[0].union(frames[0]), frames[1]).collect()
    assert {tuple(r) for r in repeated} == set(found) and len(repeated) == len(found)
    extra = frames[0].withColumns({"_k": F.lit(1), "cutoff": F.lit(2), "run": F.lit(3), "file": F.lit("x")})
    assert {tuple(r) for r in incremental.replay(extra, frames[1].withColumn("_t", F.lit(1))).collect()} == set(found)


def test_as_of_join_of_many_runs(spark):
    """Four levels of blocks, one key with most rows, equal cutoffs, times between and beyond all runs."""
    rng = random.Random(6)
    runs = [(i, 1 if i % 4 else 2, T0 + timedelta(minutes=rng.randrange(3000)), "succeeded") for i in range(300)] + [(999, 1, None, "succeeded"), (998, None, T0, "succeeded")]
    feed = [(i, rng.choice([1, 1, 1, 2, 3, None]), T0 + timedelta(minutes=rng.randrange(-50, 3050))) for i in range(500)] + [(500, 1, None)]
    df = spark.createDataFrame(feed, "feed_id bigint, library_id bigint, arrived_at timestamp")
    found = incremental.first_run_at_or_after(df, spark.createDataFrame(runs, RUNS), "library_id", "arrived_at", "cutoff_at", "run_id", fan_out=4).collect()
    assert len(found) == len(feed)
    for r in found:
        later = [(c, i) for i, k, c, _ in runs if k is not None and k == r["library_id"] and c is not None and r["arrived_at"] is not None and c >= r["arrived_at"]]
        assert (tuple(r["_run"]) if r["_run"] else None) == min(later, default=None)


def test_replay_of_nothing(spark):
    feed, runs = spark.createDataFrame([], FEED), spark.createDataFrame([], RUNS)
    some = spark.createDataFrame([(1, 1, "a", 1, 1, None, T0, None)], FEED)
    assert incremental.replay(feed, runs).collect() == [] and incremental.replay(some, runs).collect() == []
    nulls = spark.createDataFrame([(1, None, None, 5, None, None, T0, None), (2, 1, "a", None, None, None, T0, None)], FEED)
    run = spark.createDataFrame([(7, 1, T0, "succeeded"), (8, None, T0, None)], RUNS)
    assert incremental.replay(nulls, run).collect() == []
    assert [tuple(r) for r in incremental.replay(some, run).collect()] == [(7, 1)]


def test_posix_location(spark):
    cases = {"a/./b": "a/b", "a//b/": "a/b", "a/../b": "b", "../a": "../a", "a/../../b": "../b", "/../a": "/a", "": "", ".": "", "..": ".."}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", incremental.posix_location(F.col("p")).alias("q")).collect()
    assert {r["p"]: r["q"] for r in rows} == cases
    assert spark.createDataFrame([(None,)], "p string").select(incremental.posix_location(F.col("p"))).first()[0] is None


def test_manifest_survives_failures(spark, tmp_path):
    store = incremental.ManifestStore(spark, str(tmp_path / "store"))
    listing = lambda rows: spark.createDataFrame(rows, "path string, size bigint, checksum string")
    first = listing([("a", 1, "x"), ("b", 1, "y"), ("b", 1, "y")])
    assert store.data() is None and store.manifest().count() == 0

    def broken(df):
        raise RuntimeError("lost")

    try:
        store.run(first, "1", broken)
        raise AssertionError
    except RuntimeError:
        pass
    assert store.data() is None and store.manifest().count() == 0
    assert store.run(first, "1", lambda df: df).count() == 2
    assert store.run(first, "1", lambda df: df).count() == 0  # committed already
    second = listing([("a", 1, "x"), ("b", 2, "z"), ("c", None, None)])
    assert sorted(r["path"] for r in store.run(second, "2", lambda df: df).collect()) == ["b", "c"]
    assert sorted(r["path"] for r in store.data().collect()) == ["a", "b", "b", "c"]
    assert store.run(second, "3", lambda df: df).count() == 0
    (tmp_path / "f.md").write_text("hello")
    found = incremental.list_files(spark, str(tmp_path), ".md").collect()
    assert [(r["size"], r["checksum"]) for r in found] == [(5, hashlib.sha256(b"hello").hexdigest())]


def test_manifest_sees_earlier_content_again(spark, tmp_path):
    """A, B, A; gone and back; everything gone; batch identifiers out of order."""
    store = incremental.ManifestStore(spark, str(tmp_path / "store"))
    steps = [
        ("10", {"a": ["x"], "b": ["y"]}, ["a", "b"]), ("9", {"a": ["z"], "b": ["y"]}, ["a"]), ("8", {"a": ["x"], "b": ["y"]}, ["a"]), ("7", {"a": ["x"]}, []), ("6", {"a": ["x"], "b": ["y"]}, ["b"]),
        ("5", {}, []), ("4", {"b": ["y", "w"]}, ["b", "b"]), ("3", {"b": ["y", "v"]}, ["b"]), ("2", {"b": ["y", "v"]}, []), ("1", {"b": ["y", "w"]}, ["b"]),
    ]
    for batch, files, new in steps:
        listing = spark.createDataFrame([(p, 1, c) for p, cs in files.items() for c in cs], "path string, size bigint, checksum string")
        assert sorted(r["path"] for r in store.run(listing, batch, lambda df: df).collect()) == new, batch
    assert store.data().where("path = 'a' and checksum = 'x'").count() == 2


def test_manifest_agrees_with_replay(spark, tmp_path):
    """The store, run over the listing at each cutoff, has to do what replay finds for all runs at once."""
    at = lambda h: T0 + timedelta(hours=h)
    states = [("a", 1), ("b", 7), ("a", 2), ("a", 1), ("c", 7), ("b", 7)]  # a goes back, b is delivered again unchanged
    feed = [(i, 1, p, h, 9, None, at(i), "s") for i, (p, h) in enumerate(states)]
    runs = [(i, 1, at(i) + timedelta(minutes=1), "succeeded") for i in (1, 2, 3, 5)]
    store, done = incremental.ManifestStore(spark, str(tmp_path / "store")), set()
    for run, _, cutoff, _ in runs:
        newest = {f[2]: f for f in feed if f[6] <= cutoff}
        listing = spark.createDataFrame([(p, f[4], str(f[3])) for p, f in newest.items()], "path string, size bigint, checksum string")
        done |= {(run, newest[r["path"]][0]) for r in store.run(listing, str(run), lambda df: df).collect()}
    assert done == {tuple(r) for r in incremental.replay(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS)).collect()} == {(1, 0), (1, 1), (2, 2), (3, 3), (5, 4)}


ROOTS = [
    (1, '{"a": {"b": [{"c": 1}, [{"d": {}}], 2, "{}"]}, "k.v": {"x": null}}'),
    (2, json.dumps('{"o": {"p": "q"}}')), (3, None), (4, '{"a": '), (5, "[1]"), (6, ""), (7, "{}"), (8, '{"a": NaN}'), (9, '{"a": {"z": 1}, "a": {"y": "\\ud800"}}'), (9, '{"a": {"z": 1}}'),
]


def test_objects(spark):
    df = spark.createDataFrame(ROOTS, "id int, root string").withColumns({"node": F.lit(1), "path": F.lit("p")})
    found = sorted(tuple(r) for r in shred.objects(df, "id", "root").collect())
    assert found == [
        (1, "$.a", "$"), (1, "$.a.b[0]", "$.a"), (1, "$.a.b[1][0]", "$.a"), (1, "$.a.b[1][0].d", "$.a.b[1][0]"), (1, "$.k.v", "$"), (2, "$.o", "$"), (9, "$.a", "$"), (9, "$.a", "$"),
    ]
    assert shred.objects(df.where("false"), "id", "root").count() == 0


def test_rows_of_one_identifier_stay_apart(spark):
    df = spark.createDataFrame([(1, '{"a": {"x": 1}}'), (1, '{"a": {"x": 2}}'), (None, '{"a": {"y": null}, "n": 5}')], "id int, root string").withColumn("record", F.lit(7))
    nodes = shred.shred(df, "id", "root")
    found = sorted((r["id"] or 0, r["node_path"], sorted(r["scalars"].items()) if r["scalars"] else None) for r in shred.entities(nodes, "id").collect())
    assert found == [(0, "$", [("n", "5")]), (0, "$.a", [("y", None)]), (1, "$", None), (1, "$", None), (1, "$.a", [("x", "1")]), (1, "$.a", [("x", "2")])]
    assert sorted((r["id"], r["x"]) for r in shred.entity_table(nodes, "id", "$.a", ["x"]).collect() if r["id"]) == [(1, "1"), (1, "2")]


def test_entity_table(spark):
    df = spark.createDataFrame([(1, '{"r": [{"a": 1, "ID": "x", "n": {"q": 2}}, {"a": null}, 5, {}]}')], "id int, root string")
    nodes = shred.shred(df, "id", "root")
    table = shred.entity_table(nodes, "id", "$.r[]")
    assert table.columns == ["id", "node_path", "parent_path", "ordinal", "ID_", "a"]
    assert sorted((r["node_path"], r["ID_"], r["a"]) for r in table.collect()) == [("$.r[0]", "x", "1"), ("$.r[1]", None, None), ("$.r[3]", None, None)]
    assert shred.entity_table(nodes, "id", "$.none").count() == 0


def test_deep_json_and_numbers():
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert sum(1 for _ in jsontree.adjacency(jsontree._iterative(deep))) == 3001
    assert jsontree.read_root('{"a":' * 100_000 + "[1.50, true, null]" + "}" * 100_000) is not None
    assert jsontree._iterative('{"a": [1.50, {"b": "x\\n"}], "c": {}}') == {"a": ["1.50", {"b": "x\n"}], "c": {}}
    for bad in ("{", "{}x", '{"a" 1}', "[1,]", '{"a":1,}', "01", ""):
        try:
            jsontree._iterative(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert jsontree.fields(jsontree.parse('{"a": [{"b": 1}, {"b": 1.5}, 3], "c": "x", "d": null, "e": {}}')) == {"a": (16, ['[{"b": "1"}, {"b": "1.5"}, "3"]']), "c": (1, ["x"]), "a[].b": (6, ["1", "1.5"])}


FILES = "fm_id bigint, library_id bigint, export_no int, exported_at timestamp, path string, root string"


def test_changes(spark):
    rows, n = [], 0
    before = [{"k": i, "old": f"v{i}", "gone": 1, "t": 1, "l": [{"x": i}]} for i in range(5)]
    now = [{"k": i, "new": f"v{i}" if i else "other", "t": 1.5 if i else 1, "l": [{"y": i}], "plus": True} for i in range(5)]
    for export, docs in ((1, before), (2, now), (4, now)):
        for i, d in enumerate(docs):
            n += 1
            rows.append((n, 1, export, T0, f"f{i}", json.dumps(d)))
    rows += [(90, 1, 2, T0, None, None), (91, 1, 3, T0, "f", "{"), (92, None, None, None, None, None)]
    rows += [r[:1] + (2,) + r[2:] for r in rows[:10] if r[4] in ("f0", "f1")]  # two files are too few for a rename
    df = spark.createDataFrame(rows, FILES)
    found = {tuple(r) for r in drift.changes(df).collect()}
    assert {x[2:5] for x in found if x[0] == 1} == {("renamed", "old", "new"), ("renamed", "l[].x", "l[].y"), ("removed", "gone", ""), ("added", "", "plus"), ("retyped", "t", "t")}
    assert {x[2:5] for x in found if x[0] == 2} == {("removed", "old", ""), ("added", "", "new"), ("removed", "l[].x", ""), ("added", "", "l[].y"), ("removed", "gone", ""), ("added", "", "plus"), ("retyped", "t", "t")}
    assert {tuple(r) for r in drift.changes(df.union(df)).collect()} == found
    assert drift.changes(df.where("false")).count() == 0
    assert drift.change_log(df).where("library_id = 1").agg(F.max("change_no")).first()[0] == 5


def test_unify(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "B": "x", "b": true, "id": 9}'), (2, '{"a": 1.5, "l": [1]}'), (3, "{}"), (4, None)], "id int, root string")
    out = drift.unify(df, ["id"])
    assert dict(out.dtypes) == {"id": "int", "B": "string", "a": "double", "b_": "boolean", "id_": "bigint", "l": "string"}
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, "x", 1.0, True, 9, None), (2, None, 1.5, None, None, '["1"]'), (3, None, None, None, None, None)]
    assert drift.unify(df.where("id = 4"), ["id"]).count() == 0
    try:
        drift.unify(df, ["id"], max_columns=2)
        raise AssertionError
    except ValueError:
        pass
    assert [drift.promote(b) for b in (1, 2, 4, 6, 8, 10, 16, 3)] == ["string", "bigint", "double", "double", "boolean", "string", "string", "string"]


def test_unify_keeps_every_value(spark):
    """Below lists, in fields that occur twice in a record, and in numbers beyond 64 bits."""
    long = "1" + "0" * 5000
    roots = [
        '{"l": [{"n": 412, "f": 1, "b": true, "s": "x", "m": [1]}, {"n": 7, "f": 2.5, "b": false, "s": "[1]"}], "g": [[{"c": 1}], [{"c": 2}]], "a.b": 1, "a": {"b": 2}}',
        f'{{"l": [{{"n": -1}}], "a": {{"b": 3}}, "big": {2**63}, "huge": {long}, "mixed": {2**53 + 1}, "whole": 5, "far": 1e400, "tiny": 1e-400}}',
        f'{{"big": -{10**37}, "huge": 1, "mixed": 0.5, "whole": {2**63 - 1}, "far": 1.0, "tiny": 0.0}}',
        "{}",
    ]
    out = drift.unify(spark.createDataFrame(list(enumerate(roots)), "id int, root string"), ["id"])
    kinds = dict(out.dtypes)
    assert kinds == {
        "id": "int", "l": "string", "g": "string", "l[].n": "array<bigint>", "l[].f": "array<double>", "l[].b": "array<boolean>", "l[].s": "array<string>", "l[].m": "array<string>", "g[][].c": "array<bigint>",
        "a.b": "array<bigint>", "big": "decimal(38,0)", "huge": "string", "mixed": "string", "whole": "bigint", "far": "string", "tiny": "string",
    }
    found = [{k: v for k, v in r.asDict().items() if v is not None and k not in ("id", "l", "g")} for r in sorted(out.collect(), key=lambda r: r["id"])]
    assert found == [
        {"l[].n": [412, 7], "l[].f": [1.0, 2.5], "l[].b": [True, False], "l[].s": ["x", "[1]"], "l[].m": ['["1"]', None], "g[][].c": [1, 2], "a.b": [1, 2]},
        {"l[].n": [-1], "a.b": [3], "big": 2**63, "huge": long, "mixed": str(2**53 + 1), "whole": 5, "far": "1e400", "tiny": "1e-400"},
        {"big": -(10**37), "huge": "1", "mixed": "0.5", "whole": 2**63 - 1, "far": "1.0", "tiny": "0.0"},
        {},
    ]


def test_unify_keeps_places(spark):
    """Which object of a list lacks a field; lists in lists; an object below an object of a list."""
    roots = ['{"c": [{"n": "a", "r": "x"}, {"n": "b"}, {"n": "c", "r": "z", "d": {"e": 1}}], "g": [[{"c": 1}], [{"k": 0}, {"c": 2}]]}', '{"c": [{"n": "q"}, 5, {"r": "y"}]}']
    out = [r.asDict() for r in drift.unify(spark.createDataFrame(list(enumerate(roots)), "id int, root string"), ["id"]).orderBy("id").collect()]
    assert (out[0]["c[].n"], out[0]["c[].r"], out[0]["c[].d.e"], out[0]["g[][].c"], out[0]["g[][].k"]) == (["a", "b", "c"], ["x", None, "z"], [None, None, 1], [1, None, 2], [None, 0, None])
    assert (out[1]["c[].n"], out[1]["c[].r"], out[1]["c[].d.e"]) == (["q", None], [None, "y"], None)


def test_unify_reads_the_raw_source(spark):
    rows = [(1, '{"a": 1}', "a: 9", "yaml"), (2, '{"a": ', "a: 2\nb: x", "yaml"), (3, None, 'a = 1.5', "toml"), (4, None, "a: [", "yaml"), (5, None, None, None), (6, "[]", "{}", "json")]
    df = spark.createDataFrame(rows, "id int, root string, front string, kind string")
    out = drift.unify(df, ["id"], raw=("front", "kind"))
    assert dict(out.dtypes) == {"id": "int", "read_from": "string", "a": "double", "b": "string"}
    assert sorted(map(tuple, out.collect())) == [(1, "root", 1.0, None), (2, "raw", 2.0, "x"), (3, "raw", 1.5, None), (6, "raw", None, None)]
    assert {r["id"]: r["values"] for r in drift.as_map(df, ["id"]).collect()} == {1: {"a": ["1"]}}
