"""Streams of documents into stored node tables, exactly once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import parsing


def parse_stream(docs: DataFrame, id_col: str, text_col: str, what: str = "blocks", **options) -> DataFrame:
    """The node table of a stream of documents; the same parse as for a batch, without state."""
    return parsing.nodes(docs, id_col, text_col, what, **options)


def store_stream(docs: DataFrame, id_col: str, text_col: str, target: str, checkpoint: str, what: str = "blocks", available_now: bool = True, **options) -> StreamingQuery:
    """Appends the nodes of new documents to ``target``.

    Each micro-batch overwrites the folder of its own number, so one that is repeated after a failure
    leaves no duplicates, and the checkpoint makes the next run go on after the last finished batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsing.nodes(batch, id_col, text_col, what, **options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = docs.select(id_col, text_col).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kinds_per_window(blocks: DataFrame, time_col: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Blocks of each kind per time window, with a bound on how late documents may come."""
    return blocks.withWatermark(time_col, late).groupBy(F.window(time_col, window), "kind").agg(F.count("*").alias("n"))
