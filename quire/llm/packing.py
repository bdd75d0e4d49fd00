"""Filling fixed-capacity containers: best-fit decreasing with a segment tree over remaining room.

Sizes are whole numbers up to the capacity, so the sequence of best-fit decreasing depends only on how
many items each size has. The search runs over that histogram, whole runs of equal items and equal
containers at a time, and gives exactly the containers of the plain algorithm; items then take their
places by their rank among the items of their size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tokens import DEFAULT_TOKENIZER, n_tokens
from quire.runtime import materialize


class RoomTree:
    """Segment tree over the values of remaining room; each leaf a stack of runs of open bins with it.

    A run is (first bin, number of bins), its bins numbered consecutively.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, first: int, bins: int = 1) -> None:
        if bins:
            self.runs[room].append((first, bins))
            self._add(room, 1)

    def take_tightest(self, size: int) -> tuple[int, int, int] | None:
        """Removes and returns (room, first, bins): a run with the least room that still holds ``size``."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first right sibling that holds a run
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, *self.runs[room].pop()


def best_fit_of_sizes(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over a histogram: ([(size, first rank, first bin, items a bin)], bins).

    The items of a size from ``first rank`` on go into consecutive bins from ``first bin`` on, so many
    to each. A bin that has taken an item is tighter than before, so it stays the tightest until it
    cannot hold another: each bin of a run takes as many items as fit. The work depends on the number
    of sizes and of runs, not on that of items.
    """
    tree, segments, opened = RoomTree(capacity), [], 0
    for size in sorted((s for s, c in counts.items() if c), reverse=True):
        if not 0 <= size <= capacity:
            raise ValueError("an item is larger than a bin")
        rank, left = 0, counts[size]
        while left:
            found = tree.take_tightest(size)
            if found is None:
                each = capacity // size if size else left
                found = capacity, opened, -(-left // each)
                opened += found[2]
            room, first, bins = found
            each = room // size if size else left
            full = min(bins, left // each)
            segments.append((size, rank, first, each))
            rank, left = rank + full * each, left - full * each
            tree.put(room - each * size, first, full)
            if full < bins and left:  # one more bin takes the rest
                tree.put(room - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            tree.put(room, first + full, bins - full)
    return segments, opened


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, items given in any order; equal sizes are taken in the order given."""
    counts: dict[int, int] = {}
    ranks = []
    for s in sizes:
        ranks.append(counts.get(s, 0))
        counts[s] = ranks[-1] + 1
    place = _places(best_fit_of_sizes(counts, capacity)[0])
    return place(np.array(sizes, np.int64), np.array(ranks, np.int64)).tolist()


def _places(segments: list[tuple[int, int, int, int]]):
    """The bin of an item as a function of its size and its rank in it, over arrays."""
    size, rank, first, each = (np.array(c, np.int64) for c in zip(*segments)) if segments else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((rank, size))
    size, rank, first, each = size[order], rank[order], first[order], each[order]
    distinct, starts = np.unique(size, return_index=True)
    ends = np.append(starts[1:], len(size))

    def place(sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        for s in np.unique(sizes):
            k = np.searchsorted(distinct, s)
            lo, hi, mine = starts[k], ends[k], sizes == s
            at = lo + np.searchsorted(rank[lo:hi], ranks[mine], "right") - 1
            out[mine] = first[at] + (ranks[mine] - rank[at]) // each[at]
        return out

    return place


def pack(df: DataFrame, id_col: str, size: Column, capacity: int = 1024, bucket_items: int = 100_000) -> DataFrame:
    """(id, piece_no, start, n, container) of every item, no container above ``capacity``.

    An item is cut only if it alone exceeds the capacity: into full containers and one remainder that
    is packed like any other item. Items without size (0, null, negative) take part with size 0. Rows
    with equal identifiers are separate items. The containers are those of best-fit decreasing over all
    items, whatever their number.

    Only the histogram (at most ``capacity`` rows) reaches the driver, and the runs it sends back are
    bounded by the capacity too. Items are ranked within their size and a hash bucket of about
    ``bucket_items`` items, so no size, however common, is gathered in one task.
    """
    items = materialize(df.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("_n"), F.monotonically_increasing_id().alias("_row")), "pack")
    buckets = max(1, math.ceil(items.count() / bucket_items))
    cut = items.select(
        "_id", "_row",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0))), lambda i: F.least(F.lit(capacity), F.col("_n") - i * capacity))).alias("piece_no", "n"),
    )
    # A full piece needs no search: its container is named after the piece itself.
    full = F.col("n") == capacity
    own = cut.where(full).select("_id", "piece_no", "n", F.concat_ws("-", F.lit("full"), F.col("_row").cast("string"), F.col("piece_no").cast("string")).alias("container"))
    rest = cut.where(~full).withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))

    counted = materialize(rest.groupBy("n", "_b").agg(F.count("*").alias("_c")), "pack-sizes")
    counts = {r["n"]: r["c"] for r in counted.groupBy("n").agg(F.sum("_c").alias("c")).collect()}  # at most `capacity` sizes
    place = df.sparkSession.sparkContext.broadcast(best_fit_of_sizes(counts, capacity)[0])

    @F.pandas_udf("string")
    def bin_of(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series(_places(place.value)(sizes.to_numpy(), ranks.to_numpy())).astype(str)

    before = Window.partitionBy("n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("n", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    ranked = rest.join(offsets, ["n", "_b"]).withColumn("_rank", F.col("_first") + F.row_number().over(Window.partitionBy("n", "_b").orderBy("_row", "piece_no")) - 1)
    packed = ranked.select("_id", "piece_no", "n", bin_of("n", "_rank").alias("container"))
    return own.unionByName(packed).select(F.col("_id").alias(id_col), "piece_no", (F.col("piece_no") * F.lit(capacity)).cast("bigint").alias("start"), F.col("n"), "container")


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = 1024, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``pack`` with sizes in tokens; null and empty texts have size 0."""
    return pack(df, id_col, n_tokens(F.col(text_col), tokenizer), capacity)
