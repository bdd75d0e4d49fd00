"""Processing only new or changed records: the listing of inputs minus the manifest of those done.

``pending`` is the one rule, an anti-join of a listing with a manifest. Two operators apply it:

* ``ManifestStore`` runs one batch after another: a manifest of the inputs of the last run with size
  and checksum, the anti-join of the present listing with it, output written under the batch identifier
  (so that a repeated attempt replaces its own output), and the manifest committed last.
* ``replay`` does the same for a whole history of deliveries and load runs at once. Listings and
  manifests are written as differences: a file has a row in the batches that saw it delivered, and stays
  in the manifest from the batch that committed it until the next such row. The listing of every batch
  is then anti-joined with the manifest its predecessor left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.runtime import materialize


def posix_location(path: Column) -> Column:
    """A path resolved as POSIX does it, without looking at a file system.

    Empty and ``.`` segments vanish, ``..`` takes the segment before it away. A relative path keeps
    the ``..`` that lead out of its root; an absolute one cannot leave it. Null stays null, and the
    empty path is the root itself (``''``).
    """
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s)))
        .when((F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(absolute, acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(resolved, "/"))


def pending(listing: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``listing`` that the manifest does not hold with the same ``keys`` (null-safe).

    With keys (path, size, checksum) these are the new and the changed inputs. An empty manifest
    leaves the listing as it is; an empty listing gives no rows.
    """
    # Spark hashes and sorts null-safe equality like any other, so this stays an equi-join.
    known = manifest.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)]).distinct()
    on = [listing[k].eqNullSafe(known[f"_m{i}"]) for i, k in enumerate(keys)]
    return listing.join(known, on, "left_anti")


def first_run_at_or_after(feed: DataFrame, runs: DataFrame, key: str, at: str, cutoff: str, run: str, fan_out: int = 32) -> DataFrame:
    """As-of join forward: each feed row with the key's first run whose cutoff is not before it.

    Adds ``_run`` = struct(cutoff, run), null where no run follows or the row has no time. The runs of a key form a B-tree:
    blocks of ``fan_out`` runs in order of cutoff, blocks of blocks above them, one at the top. A feed
    row descends it by one equi-join per level, so the feed is neither sorted nor gathered by key; Spark
    broadcasts a level if it is small enough and splits skewed keys if it is not. Only the number of
    levels reaches the driver. Runs with equal cutoffs: the smaller identifier comes first.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = runs.select(F.col(key).alias("_k"), micros(cutoff).alias("_t"), F.struct(F.col(cutoff).alias("cutoff"), F.col(run).alias("run")).alias("_run"))
    r = r.where(F.col("_t").isNotNull() & F.col("_k").isNotNull()).withColumn("_h", F.floor(F.col("_t") / 3_600_000_000))
    # Numbered within the hour, after the runs of earlier hours: no key is sorted in one task.
    hours = r.groupBy("_k", "_h").agg(F.count("*").alias("_in"))
    earlier = Window.partitionBy("_k").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("_k", "_h", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_first"))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_k", "_h").orderBy("_t", "_run")) - 1
    r = materialize(r.join(hours, ["_k", "_h"]).select("_k", place.alias("_n"), "_t", "_run"), "asof")
    most = r.agg(F.max("_n")).first()[0] or 0

    block = F.floor(F.col("_n") / fan_out)
    levels = [r.groupBy("_k", block.alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_n", "_t", "_run"))).alias("_items"))]
    while most >= fan_out:
        most //= fan_out
        below = levels[-1].select("_k", F.col("_b").alias("_n"), F.element_at("_items", -1)["_t"].alias("_t"))
        levels.append(below.groupBy("_k", block.alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_items")))

    rows = feed.select(F.col(key).alias("_k"), micros(at).alias("_t"), F.lit(0).cast("bigint").alias("_b"), F.struct("*").alias("_row"))
    hit = F.when(F.col("_t").isNotNull(), F.get("_items", F.size(F.filter("_items", lambda x: x["_t"] < F.col("_t")))))
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth].select(F.col("_k").alias("_lk"), F.col("_b").alias("_lb"), "_items")
        rows = rows.join(level, (F.col("_k") == F.col("_lk")) & (F.col("_b") == F.col("_lb")), "left")
        rows = rows.select("_k", "_t", "_row", hit["_n"].alias("_b")) if depth else rows.select("_row.*", hit["_run"].alias("_run"))
    return rows


def listings(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """What each succeeded run lists of the files delivered since the one before, as differences.

    (library_id, file, batch, feed_id, size, checksum, superseded): ``batch`` is the run, ``superseded``
    the run that lists the file next, null if none does. In between, the row is in every manifest.
    """
    ok = runs.where("status = 'succeeded'").select("run_id", "library_id", "cutoff_at")
    size = F.col("n_bytes") if "n_bytes" in feed.columns else F.lit(None).cast("bigint")
    seen = feed.where(F.col("content_hash").isNotNull() & F.col("arrived_at").isNotNull()).select(
        "library_id", "arrived_at", "feed_id", "content_hash", size.alias("size"),
        F.coalesce(F.concat(F.lit("p"), posix_location(F.col("path"))), F.concat(F.lit("h"), F.col("content_hash").cast("string"))).alias("file"),
        F.coalesce("modified_at", "arrived_at").alias("changed"),
    )
    delivered = (
        first_run_at_or_after(seen, ok, "library_id", "arrived_at", "cutoff_at", "run_id")
        .where("_run is not null")
        .groupBy("library_id", "file", "_run")  # combined before the shuffle: a hot file costs a row a run
        .agg(F.max(F.struct("changed", "feed_id", "content_hash", "size")).alias("newest"))
    )
    by_file = Window.partitionBy("library_id", "file").orderBy("_run")
    current = F.max("newest").over(by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = delivered.select("library_id", "file", F.col("_run.run").alias("batch"), current.alias("c"), F.lead("_run.run").over(by_file).alias("superseded"))
    return rows.select("library_id", "file", "batch", F.col("c.feed_id").alias("feed_id"), F.col("c.size").alias("size"), F.col("c.content_hash").alias("checksum"), "superseded")


def replay(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, feed_id): for each succeeded run, every file that is new or changed since the last.

    ``feed`` has library_id, path?, content_hash?, modified_at?, arrived_at, feed_id, n_bytes?; ``runs``
    has run_id, library_id, cutoff_at, status. Extra columns are ignored. Rows without a checksum were
    not read and do not count. Failed, cancelled and running runs commit nothing, so what they saw
    stays pending for the next succeeded run. Empty inputs give an empty result.

    A file is changed if its checksum is another; the manifest holds its size as well, which tells
    nothing more where the checksum is of the whole content.
    """
    listed = materialize(listings(feed, runs), "listing")
    manifest = listed.where("superseded is not null").select("library_id", "file", F.col("superseded").alias("batch"), "size", "checksum")
    return pending(listed, manifest, ["library_id", "file", "batch", "checksum"]).select(F.col("batch").alias("run_id"), "feed_id")


def list_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """(path, size, checksum) of the files under a folder, read and hashed by the executors."""
    from quire.sources.markdown_files import markdown_files

    files = markdown_files(spark, root, suffix, keep_errors=True, maxbytes=2**31 - 1)
    return files.select("path", "size", F.sha2("content", 256).alias("checksum"))


class ManifestStore:
    """Batches and the manifest of what they processed, under one folder of a shared file system.

    ``data/batch_id=…`` holds output, ``manifest/batch_id=…/seq=N`` the whole listing that batch N in
    order of commits saw. What is new is judged by the last of them, so a file that returns to an
    earlier content, or comes back after it was gone, is processed again. A batch counts only once its
    manifest has its _SUCCESS marker, so an attempt that dies anywhere before that leaves nothing
    visible, and its repetition overwrites the same folders. One batch runs at a time.
    """

    KEYS = ["path", "size", "checksum"]
    SCHEMA = "path string, size bigint, checksum string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _committed(self) -> list[tuple[int, str, str]]:
        """(seq, batch identifier, manifest folder) of each batch, in order of commits.

        Manifests without a number, of what single batches processed, come before the others as 0.
        """
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        path = Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = []
        for batch in (s.getPath() for s in fs.listStatus(path)):
            if batch.getName().startswith("batch_id="):
                numbered = [s.getPath() for s in fs.listStatus(batch) if s.getPath().getName().startswith("seq=")]
                for folder in [batch, *numbered]:
                    if fs.exists(Path(folder, "_SUCCESS")):
                        seq = 0 if folder is batch else int(folder.getName().split("=", 1)[1])
                        found.append((seq, batch.getName().split("=", 1)[1], folder.toString()))
        return sorted(found)

    def manifest(self) -> DataFrame:
        """The inputs as the last committed batch saw them; empty before the first commit."""
        done = self._committed()
        paths = [folder for seq, _, folder in done if seq == done[-1][0]]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def data(self) -> DataFrame | None:
        """Output of the committed batches, or None before the first."""
        paths = [f"{self.root}/data/batch_id={b}" for _, b, _ in self._committed()]
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths) if paths else None

    def run(self, listing: DataFrame, batch_id: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Process what is new in ``listing`` with ``process(pending) -> DataFrame``; returns the new inputs.

        ``listing`` is everything there is now; a file it lacks counts as gone. A batch identifier
        that is committed already does nothing, whatever the listing says.
        """
        done = self._committed()
        if batch_id in [b for _, b, _ in done]:
            return self.spark.createDataFrame([], self.SCHEMA)
        # Listing and inputs are fixed before processing, so data and manifest agree.
        listed, inputs = (f"{self.root}/{x}/batch_id={batch_id}" for x in ("listing", "inputs"))
        listing.select(*self.KEYS).distinct().write.mode("overwrite").parquet(listed)
        present = self.spark.read.schema(self.SCHEMA).parquet(listed)
        pending(present, self.manifest(), self.KEYS).write.mode("overwrite").parquet(inputs)
        fixed = self.spark.read.schema(self.SCHEMA).parquet(inputs)
        process(fixed).write.mode("overwrite").parquet(f"{self.root}/data/batch_id={batch_id}")
        present.write.mode("overwrite").parquet(f"{self.root}/manifest/batch_id={batch_id}/seq={done[-1][0] + 1 if done else 1}")
        return fixed
