"""Deeply nested records into flat tables with parent-child links (adjacency-table shredding).

``shred`` stores every node of a record's tree as a row: node, parent, label, ordinal, scalar.
``entities`` joins the object nodes with their scalar children and pivots these into one map a row;
``entity_table`` is the rows of one entity with a column per label; ``objects`` names each row's parent.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.core import jsontree
from quire.runtime import materialize

NODES = "record bigint, node bigint, parent bigint, owner bigint, label string, ordinal int, kind string, scalar string, path string, owner_path string, entity string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
_NAMES = ["node", "parent", "owner", "label", "ordinal", "kind", "scalar", "path", "owner_path", "entity"]


def shred(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The adjacency table of every readable record: one row per node of its tree.

    A record is readable if ``json_col`` is the text of a JSON object, or of a string that holds one;
    other records (null, cut off, lists, scalars) give no rows. ``record`` numbers the input rows, so
    rows that share an identifier stay apart. The identifier keeps its type; other columns are dropped
    before the Python step.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {NODES}"

    def walk(batches):
        for batch in batches:
            take, cols = [], [[] for _ in _NAMES]
            for i, text in enumerate(batch.column(2).to_pylist()):
                root = jsontree.read_root(text)
                if root is None:
                    continue
                for row in jsontree.adjacency(root):
                    take.append(i)
                    for c, v in zip(cols, row):
                        c.append(v)
                if len(take) > 50_000:
                    yield _rows(batch, take, cols)
                    take, cols = [], [[] for _ in _NAMES]
            if take:
                yield _rows(batch, take, cols)

    def _rows(batch, take, cols):
        at = pa.array(take, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, t) for c, t in zip(cols, _TYPES)]], [id_col, "record", *_NAMES])

    return df.select(id_col, F.monotonically_increasing_id().alias("_record"), json_col).mapInArrow(walk, schema)


def _is_scalar() -> Column:
    """Scalars that are values of an object's keys."""
    return ~F.col("kind").isin("object", "list") & F.col("label").isNotNull()


def entities(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, record, node, entity, node_path, parent_path, ordinal, scalars) of each object node.

    ``scalars`` maps the labels of its scalar children to their values: the pivot without a bound on the
    number of labels, null for objects that have none. ``nodes`` is an adjacency table; store it first,
    as both sides of the join read it. The children of an object meet before the shuffle.
    """
    below = nodes.where(_is_scalar()).groupBy("record", F.col("owner").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("label", "scalar"))).alias("scalars"))
    rows = nodes.where(F.col("kind") == "object").select(id_col, "record", "node", "entity", F.col("path").alias("node_path"), F.col("owner_path").alias("parent_path"), "ordinal")
    return rows.join(below, ["record", "node"], "left").select(id_col, "record", "node", "entity", "node_path", "parent_path", "ordinal", "scalars")


def objects(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, node_path, parent_path) of each object below the root, with its nearest enclosing object."""
    nodes = materialize(shred(df, id_col, json_col), "shred")
    return entities(nodes, id_col).where("node > 0").select(id_col, "node_path", "parent_path")


def entity_table(nodes: DataFrame, id_col: str, entity: str, labels: list[str] | None = None, max_columns: int = 2000) -> DataFrame:
    """One flat table: the object nodes of one entity path joined with their scalar children, pivoted.

    Columns: id, node_path, parent_path, ordinal, then one per label. ``labels`` defaults to the
    scalar keys found under the entity; more than ``max_columns`` of them are an error, and the map of
    ``entities`` is the form without that bound. A label that clashes with a fixed column, in any case,
    gets a trailing underscore. Objects without scalars keep their row with nulls.
    """
    rows = nodes.where((F.col("kind") == "object") & (F.col("entity") == entity)).select(
        id_col, "record", "node", F.col("path").alias("node_path"), F.col("owner_path").alias("parent_path"), "ordinal"
    )
    # The children of an entity are recognised by its path, so unrelated nodes never reach the shuffle.
    scalars = nodes.where(_is_scalar() & (F.col("entity") == F.concat(F.lit(entity + "."), F.col("label"))))
    if labels is None:
        found = scalars.select("label").distinct().limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"more than {max_columns} labels below {entity}")
        labels = sorted(r[0] for r in found)
    if not labels:
        return rows.drop("record", "node")
    wide = scalars.groupBy("record", F.col("owner").alias("node")).pivot("label", labels).agg(F.first("scalar"))
    taken, names = {id_col.lower(), "record", "node", "node_path", "parent_path", "ordinal"}, {}
    for label in labels:
        name = label
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names[label] = name
    wide = wide.toDF("record", "node", *[names[x] for x in labels])
    return rows.join(wide, ["record", "node"], "left").drop("record", "node")
