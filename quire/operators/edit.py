"""Edits of node tables: appending, inserting, removing and replacing top-level blocks, set by set.

The tables hold one row per block with (doc_id, top_index, …); all edits keep top_index gapless. Text
edits of whole sources are in ``functions.rendering`` and ``functions.frontmatter``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remove_block(blocks: DataFrame, index: int) -> DataFrame:
    """Without the top-level block at ``index``; documents that have none there stay."""
    return blocks.where(F.col("top_index") != index).withColumn("top_index", F.col("top_index") - (F.col("top_index") > index).cast("int"))


def _with_new(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """Both, told apart by ``_new``: documents meet in one shuffle, whatever is then asked of them."""
    return blocks.withColumn("_new", F.lit(False)).unionByName(new.drop("top_index").withColumn("_new", F.lit(True)), allowMissingColumns=True)


def insert_block(blocks: DataFrame, new: DataFrame, index: int) -> DataFrame:
    """``new`` (one row a document, the same columns but top_index) put in at ``index``; documents with
    fewer blocks get it at their end."""
    of_doc = Window.partitionBy("doc_id")
    rows = _with_new(blocks, new).withColumns({
        "_at": F.least(F.lit(index), F.coalesce(F.max("top_index").over(of_doc) + 1, F.lit(0))).cast("int"), "_has": F.max("_new").over(of_doc),
    })
    moved = F.col("top_index") + (F.col("_has") & (F.col("top_index") >= F.col("_at"))).cast("int")
    return rows.withColumn("top_index", F.when(F.col("_new"), F.col("_at")).otherwise(moved)).drop("_new", "_at", "_has")


def append_block(blocks: DataFrame, new: DataFrame) -> DataFrame:
    return insert_block(blocks, new, 2**31 - 2)


def replace_block(blocks: DataFrame, new: DataFrame, index: int) -> DataFrame:
    """``new`` in place of the block at ``index``, in documents that have one there and a new one."""
    of_doc, at = Window.partitionBy("doc_id"), F.coalesce(F.col("top_index") == index, F.lit(False))
    rows = _with_new(blocks, new).withColumns({"_old": F.max(at).over(of_doc), "_has": F.max("_new").over(of_doc)})
    kept = rows.where(F.when(F.col("_new"), F.col("_old")).otherwise(~(F.col("_has") & at)))
    return kept.withColumn("top_index", F.when(F.col("_new"), F.lit(index)).otherwise(F.col("top_index"))).drop("_new", "_old", "_has")


def section(blocks: DataFrame, start: str, end: str) -> DataFrame:
    """Top-level blocks between the first HTML blocks that contain the markers."""
    marks = blocks.where("kind = 'html_block'").groupBy("doc_id").agg(
        F.min(F.when(F.contains("content", F.lit(start)), F.col("top_index"))).alias("_from"), F.min(F.when(F.contains("content", F.lit(end)), F.col("top_index"))).alias("_to")
    )
    return blocks.join(marks.where("_from < _to"), "doc_id").where((F.col("top_index") > F.col("_from")) & (F.col("top_index") < F.col("_to"))).drop("_from", "_to")


def renumber(blocks: DataFrame) -> DataFrame:
    """top_index counted anew from 0 in the present order."""
    return blocks.withColumn("top_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("top_index")) - 1)
