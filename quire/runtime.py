"""Session helpers shared by every operator: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores, for CPU-heavy Python steps.

    Only an input of fewer files than cores is dealt out anew: a small Parquet file is one row group,
    so one task would do all the work. Larger inputs stay as they are, without a shuffle. ``df`` must
    be a plain scan; anything else would be planned here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes what ``materialize`` has written so far; results that still read it must be done."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss.

    Used where a Python step feeds several branches, which Spark would otherwise run once per branch.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/quire-{tag}-{uuid.uuid4().hex}"
    _written.append(where)
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)
