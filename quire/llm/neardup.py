"""Near-duplicate texts: groups of documents whose word-shingle sets are similar enough.

The stages, none of which gathers the collection in one place:

1. one pass over the texts makes, per document, a digest of its shingle set, the set's size, MinHash
   band keys and a vector of group counts (shingles hashed into ``GROUPS`` groups);
2. documents with the same set collapse into one representative;
3. representatives that share a band key meet in a bucket; buckets with the same members are one. The
   overlap of two sets is at most the sum of the coordinate-wise minima of their group counts, and pairs
   that cannot reach the threshold by it drop out. Above ``CountTree.FANOUT`` members, and between
   chunks, the counts are points in an R-tree, where the same sum with a node's maxima bounds all
   its points and drops whole subtrees; a smaller bucket is one leaf of it;
4. the surviving pairs are verified on the complete shingle sets.

A bucket of any size is dealt into chunks, and pairs of chunks are separate units of work. ``links``
gives every pair of classes; ``grouped`` needs the groups only: it verifies each bucket's members
against one of them, and then such pairs alone as are still in different groups, so a large group of
near copies costs its size and not its square.
An R-tree alone cannot carry the search: vectors of unrelated texts are alike enough that inner
nodes prune nothing, which makes it quadratic in the collection (figures in the README). Bands are
chosen so that a pair at the threshold is missed with probability below ``MISS``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialize

GROUPS, ROWS, MISS, CHUNK = 64, 3, 1e-5, 512
WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def bands_for(similarity: float) -> int:
    """Bands of ROWS hashes that miss a pair at the threshold with probability below MISS."""
    return max(4, math.ceil(math.log(MISS) / math.log(1 - min(similarity, 0.999) ** ROWS)))


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.cache = words, {}
        self.mix = [_U(xxhash.xxh64_intdigest(b"shingle", i) | 1) for i in range(words)]

    def __call__(self, text: str, min_words: int) -> np.ndarray | None:
        found, cache = WORD.findall(text.lower()), self.cache
        if len(found) < max(min_words, self.words):
            return None
        if len(cache) > 500_000:
            cache.clear()
        try:
            codes = [cache[w] for w in found]
        except KeyError:
            for w in found:
                if w not in cache:
                    cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            codes = [cache[w] for w in found]
        codes = np.array(codes, _U)
        n = len(codes) - self.words + 1
        h = np.zeros(n, _U)
        for i, k in enumerate(self.mix):
            h = (h ^ (codes[i : i + n] * k)) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        h.sort()
        return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _signer(bands: int):
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 2**63, bands * ROWS, dtype=np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 2**63, bands * ROWS, dtype=np.uint64)
    salt = rng.integers(1, 2**63, bands, dtype=np.uint64)
    mix = [_U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)]

    def sign(h: np.ndarray) -> np.ndarray:
        low = np.full(bands * ROWS, _U(2**64 - 1))
        for at in range(0, len(h), 2048):  # long texts in slices: memory stays bounded
            low = np.minimum(low, (h[at : at + 2048, None] * a + b).min(0))
        low = low.reshape(bands, ROWS)
        key = salt.copy()
        for i in range(ROWS):
            key = (key ^ low[:, i]) * mix[i]
            key ^= key >> _U(31)
        return key.view(np.int64)

    return sign


def group_counts(h: np.ndarray) -> bytes:
    """The point of a shingle set, 16 bits a count, or 32 where a set is too large for that."""
    c = np.bincount((h & _U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return c.astype(np.uint16 if c.max() < 1 << 16 else np.uint32).tobytes()


def _points(counts: list[bytes]) -> np.ndarray:
    if all(len(c) == 2 * GROUPS for c in counts):
        return np.frombuffer(b"".join(counts), np.uint16).reshape(-1, GROUPS)
    return np.array([np.frombuffer(c, np.uint16 if len(c) == 2 * GROUPS else np.uint32) for c in counts], np.uint32).reshape(-1, GROUPS)


def features(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float, min_words: int) -> DataFrame:
    """(id, digest, size, bands, counts) of each document with at least ``min_words`` words."""
    kind = df.schema[id_col].dataType.simpleString()
    bands = bands_for(similarity)

    def run(batches):
        shingle, sign = Shingler(words), _signer(bands)
        for batch in batches:
            take, digest, size, keys, counts = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                h = None if text is None else shingle(text, min_words)
                if h is None:
                    continue
                take.append(i)
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
                keys.append(sign(h))
                counts.append(group_counts(h))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(counts, pa.binary())],
                ["id", "digest", "size", "bands", "counts"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, digest binary, size int, bands array<bigint>, counts binary")


class CountTree:
    """R-tree over group-count points, bulk loaded in order of the points' largest axes.

    ``search`` yields the points whose summed minima with the query reach the overlap that the
    similarity demands; inner nodes hold the maxima of their points and the smallest set size.
    """

    FANOUT = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.astype(np.int64).var(0).argsort()[::-1][:4]
        self.order = np.lexsort(tuple(points[:, k] for k in spread))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, least = self.points, self.sizes
        while len(high) > self.FANOUT:
            starts = np.arange(0, len(high), self.FANOUT)
            high, least = np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts)
            self.levels.append((high, least))

    def search(self, point: np.ndarray, size: int, share: float) -> np.ndarray:
        alive = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[depth]
            bound = np.minimum(high[alive], point).sum(1, dtype=np.int64)
            alive = alive[bound >= share * (size + least[alive]) - 1e-9]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            alive = (alive[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
            alive = alive[alive < below]
        bound = np.minimum(self.points[alive], point).sum(1, dtype=np.int64)
        return self.order[alive[bound >= share * (size + self.sizes[alive]) - 1e-9]]


def _near(left: np.ndarray, right: np.ndarray, same: bool, points: np.ndarray, sizes: np.ndarray, share: float):
    """Index pairs (one of each side, or any two of one side) that the count bound lets through."""
    if same and len(left) <= CountTree.FANOUT:
        i, j = np.triu_indices(len(left), 1)
        i, j = left[i], left[j]
        keep = np.minimum(points[i], points[j]).sum(1, dtype=np.int64) >= share * (sizes[i] + sizes[j]) - 1e-9
        return i[keep], j[keep]
    tree, out_i, out_j = CountTree(points[right], sizes[right]), [], []
    for q in left:
        hits = right[tree.search(points[q], int(sizes[q]), share)]
        hits = hits[hits > q] if same else hits
        out_i.append(np.full(len(hits), q))
        out_j.append(hits)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def buckets_of(reps: DataFrame) -> DataFrame:
    """(key, n, a, b) of each set of members that share a band: its size, least and greatest member.

    Near copies share many bands; of the buckets with the same members (by a 128-bit hash of them) one
    stays.
    """
    met = reps.select("id", F.explode("bands").alias("key"))
    same = [F.bit_xor(F.xxhash64(F.lit(salt), "id")).alias(f"x{salt}") for salt in (1, 2)]
    found = met.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), *same).where("a < b")
    return materialize(found.groupBy("n", "a", "b", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n", "a", "b"), "neardup-buckets")


def bounded(near: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose group counts let them reach the similarity."""
    kind, share = reps.schema["id"].dataType.simpleString(), similarity / (1 + similarity)
    both = near
    for c in ("a", "b"):
        both = both.join(reps.select(F.col("id").alias(c), F.col("size").alias(f"_n{c}"), F.col("counts").alias(f"_c{c}")), c)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                size = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
                overlap = np.minimum(_points(batch.column(3).to_pylist()), _points(batch.column(5).to_pylist())).sum(1, dtype=np.int64)
                batch = batch.filter(pa.array(overlap >= share * size - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])

    return both.select("a", "b", "_na", "_ca", "_nb", "_cb").mapInArrow(keep, f"a {kind}, b {kind}")


def candidates(reps: DataFrame, similarity: float, buckets: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a < b) of representatives that share a bucket and pass the count bound.

    With ``labels`` (id, label) only pairs with different labels; buckets of two are left out then.
    """
    kind = reps.schema["id"].dataType.simpleString()
    share = similarity / (1 + similarity)
    met = reps.select("id", F.explode("bands").alias("key"))
    members = reps.select("id", "size", "counts")
    members = members.withColumn("label", F.lit(0).cast("bigint")) if labels is None else members.join(labels, "id")

    # Larger buckets: members dealt into chunks, one unit of work (cell) for each pair of chunks.
    more = met.join(buckets.where("n > 2").select("key", "n"), "key").join(members, "id")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    more = more.withColumn("c", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    more = more.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "id", "size", "counts", "label")
    unlike = labels is not None

    def pairs(batches):
        def solve(rows: pa.Table):
            cols = {n: rows.column(n).combine_chunks() for n in rows.column_names}
            ids = cols["id"]
            key, i, j, c = (cols[n].to_numpy(zero_copy_only=False) for n in ("key", "i", "j", "c"))
            sizes = cols["size"].to_numpy(zero_copy_only=False).astype(np.int64)
            points = _points(cols["counts"].to_pylist())
            label = cols["label"].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True])))
            left, right = [], []
            for s, e in zip(edges[:-1], edges[1:]):
                rows_here = np.arange(s, e)
                if i[s] == j[s]:
                    x, y = _near(rows_here, rows_here, True, points, sizes, share)
                else:
                    first = c[s:e] == i[s]
                    x, y = _near(rows_here[first], rows_here[~first], False, points, sizes, share)
                left.append(x)
                right.append(y)
            x, y = np.concatenate(left), np.concatenate(right)
            if unlike:
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
            x, y = ids.take(pa.array(x)), ids.take(pa.array(y))
            table = pa.table([x, y], ["a", "b"])
            import pyarrow.compute as pc

            low, high = pc.min_element_wise(x, y), pc.max_element_wise(x, y)
            return pa.table([low, high], table.column_names).group_by(["a", "b"]).aggregate([]).to_batches()

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000:
                continue
            k, i, j = (held.column(n).to_numpy() for n in ("key", "i", "j"))
            last = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            if len(last):  # the open group at the end waits for the next batch; a cell has at most two chunks
                yield from solve(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows:
            yield from solve(held)

    grouped = more.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    many = grouped.mapInArrow(pairs, f"a {kind}, b {kind}").where("a < b")
    if unlike:
        return many.distinct()
    two = bounded(buckets.where("n = 2").select("a", "b").distinct(), reps, similarity)
    return two.unionByName(many).distinct()


def shingle_sets(df: DataFrame, text_col: str, words: int, min_words: int) -> DataFrame:
    """(digest, set) of each text; digests as in ``features``."""

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            digests, sets = [], []
            for text in batch.column(0).to_pylist():
                h = shingle(text, min_words) if text is not None else None
                if h is not None:
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sets.append(h.view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int64).astype(np.int32))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["digest", "set"])

    return df.select(text_col).mapInArrow(run, "digest binary, set array<bigint>")


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, representatives) of the texts; see ``links``."""
    found = materialize(features(df, id_col, text_col, words, similarity, min_words), "neardup")
    # All but the identifier follows from the digest, so any row of a class will do.
    one = [F.first(c).alias(c) for c in ("size", "bands", "counts")]
    stored = found.groupBy("digest").agg(F.min("id").alias("class_id"), *one).withColumn("class_no", F.monotonically_increasing_id())
    stored = materialize(stored, "neardup-classes")
    classes = stored.select("digest", "class_id", "class_no")
    members = found.select("id", "digest").join(classes, "digest").select("id", "class_id", "class_no").distinct()
    return classes, materialize(members, "neardup-members"), stored.select(F.col("class_no").alias("id"), "size", "bands", "counts")


def _verified(near: DataFrame, classes: DataFrame, df: DataFrame, id_col: str, text_col: str, words: int, similarity: float, min_words: int) -> DataFrame:
    """(a, b, similarity) of the candidate pairs that reach the similarity on their complete sets."""
    near = materialize(near, "neardup-candidates")
    wanted = near.select(F.col("a").alias("class_no")).union(near.select("b")).distinct().join(classes, "class_no")
    wanted = materialize(wanted, "neardup-wanted")
    sets = shingle_sets(df.join(wanted.select(F.col("class_id").alias("_w")), df[id_col] == F.col("_w"), "left_semi"), text_col, words, min_words)
    sets = materialize(sets, "neardup-sets")
    side = lambda c: wanted.select(F.col("class_no").alias(c), F.col("digest").alias(f"_d{c}"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    for c in ("a", "b"):
        both = both.join(sets.select(F.col("digest").alias(f"_d{c}"), F.col("set").alias(f"_{c}")), f"_d{c}")
    shared = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - F.col("_s")
    verified = both.withColumn("_s", shared).select("a", "b", (F.col("_s") / union).alias("similarity")).where(F.col("similarity") >= similarity)
    return verified.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def links(df: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, class_id, class_no) for every document and shingle set it has, and
    (a, b, similarity) between the numbers of classes.

    A class holds the documents with the same shingle set, ``class_id`` is the least of them and
    ``class_no`` its own number, as classes of an identifier with several texts may have the same
    least one; links join different classes whose Jaccard similarity reaches the threshold. Null texts, and texts under
    ``min_words`` or ``words`` words, are in no class; rows without an identifier are left out. A row
    that occurs twice counts once; one identifier with several texts is linked by any of them. An
    empty table gives two empty ones.
    """
    df = df.where(F.col(id_col).isNotNull())
    classes, members, reps = _classes(df, id_col, text_col, words, similarity, min_words)
    near = candidates(reps, similarity, buckets_of(reps))
    return members, _verified(near, classes, df, id_col, text_col, words, similarity, min_words)


def grouped(df: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8, min_words: int = 1) -> DataFrame:
    """(id, class_id, group_id): the connected groups of ``links`` without its pairs, one row per document.

    First each bucket's members are verified against the least of them. Pairs that are then in one group
    already cannot change it, so only pairs of different groups are looked at after that, in the buckets
    that hold such. Cases are as in ``links`` and ``groups``.
    """
    df = df.where(F.col(id_col).isNotNull())
    classes, members, reps = _classes(df, id_col, text_col, words, similarity, min_words)
    how = (classes, df, id_col, text_col, words, similarity, min_words)
    met, buckets = reps.select("id", F.explode("bands").alias("key")), buckets_of(reps)
    stars = met.join(buckets, "key").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    first = materialize(_verified(bounded(stars, reps, similarity), *how), "neardup-stars")
    root = _roots(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = reps.select("id").join(root.withColumnRenamed("_c", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("label"))
    labels = materialize(labels, "neardup-labels")
    open_keys = met.join(buckets.where("n > 2").select("key"), "key").join(labels, "id").groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
    second = _verified(candidates(reps, similarity, buckets.join(open_keys, "key", "left_semi"), labels), *how)
    edges = materialize(first.unionByName(second), "neardup-links")
    return _group_of(_by_class(members), edges)[3].select("id", "class_id", "group_id")


def _by_class(members: DataFrame) -> DataFrame:
    """Members with what links name classes by as ``_c``: the number, or the identifier where there is none."""
    return members.withColumn("_c", F.col("class_no" if "class_no" in members.columns else "class_id"))


def pairs(members: DataFrame, verified: DataFrame) -> DataFrame:
    """Every pair of documents (id_1 < id_2), once: members of linked classes, and members of one class."""
    members = _by_class(members)
    m1, m2 = members.select(F.col("id").alias("x"), F.col("_c").alias("a")), members.select(F.col("id").alias("y"), F.col("_c").alias("b"))
    across = verified.select("a", "b").join(m1, "a").join(m2, "b").where("x <> y").select("x", "y")
    within = m1.join(m2, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2")).distinct()


def _roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(_c, root) of every vertex that has an edge (u, v): the least vertex of its component.

    Alternating large-star and small-star steps (logarithmically many rounds), each written to the
    shared folder.
    """
    edges = materialize(edges.where("u <> v").distinct(), "groups-0")
    for round_no in range(1, max_rounds + 1):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, f"groups-{round_no}")
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    else:
        raise RuntimeError("groups did not settle")
    root = edges.groupBy(F.col("u").alias("_c")).agg(F.min("v").alias("root"))
    return root.union(root.select("root", "root").distinct())


def _group_of(members: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents of several texts, their classes, members of one text, rows with group_id)."""
    several = members.groupBy("id").agg(F.min("_c").alias("u"), F.min("class_id").alias("class_id"), F.count("*").alias("k")).where("k > 1").drop("k")
    several = materialize(several, "groups-several")
    texts = several.select("id", "u").join(members.select("id", F.col("_c").alias("v")), "id")
    root = _roots(verified.select(F.col("a").alias("u"), F.col("b").alias("v")).union(texts.select("u", "v")))
    named = root.join(members.select("_c", "class_id"), "_c").groupBy("root").agg(F.min("class_id").alias("group_id"))
    group_of = root.join(named, "root").select("_c", "group_id")
    single = members.join(several, "id", "left_anti")
    rows = single.select("id", "class_id", "_c").union(several.select("id", "class_id", "u"))
    return several, texts, single, rows.join(group_of, "_c", "left").select("id", "class_id", "_c", F.coalesce("group_id", "class_id").alias("group_id"))


def groups(members: DataFrame, verified: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): connected groups of classes, one row per document.

    ``group_id`` is the least class of the component. ``n_links`` counts the
    linked documents of other texts. A document with several texts joins their classes, and its
    ``class_id`` is the least of them.
    """
    members = _by_class(members)
    several, texts, single, rows = _group_of(members, verified)

    # Documents of one text are counted by class, those of several one by one: they may be met twice.
    sizes = single.groupBy(F.col("_c").alias("o")).agg(F.count("*").alias("n"))
    others = texts.select(F.col("v").alias("o"), F.col("id").alias("m"))
    linked = verified.select(F.col("a").alias("_c"), F.col("b").alias("o")).union(verified.select("b", "a"))
    owned = texts.select("id", F.col("v").alias("_c")).join(linked, "_c").select("id", "o").distinct()
    met = linked.join(others, "o").select("_c", "m").distinct().groupBy("_c").agg(F.count("*").alias("n"))
    of_class = linked.join(sizes, "o").select("_c", "n").union(met).groupBy("_c").agg(F.sum("n").alias("n_links"))
    met = owned.join(others, "o").where("m <> id").select("id", "m").distinct().groupBy("id").agg(F.count("*").alias("n"))
    of_id = owned.join(sizes, "o").select("id", "n").union(met).groupBy("id").agg(F.sum("n").alias("n_links"))

    counted = single.join(of_class, "_c", "left").select("id", "n_links").union(several.join(of_id, "id", "left").select("id", "n_links"))
    return rows.join(counted, "id").select("id", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
