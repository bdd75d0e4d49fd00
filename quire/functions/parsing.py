"""Markdown text to node tables. One parse per document and call, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.core import rows as R
from quire.core.blocks import parse
from quire.core.nodes import Block, Document
from quire.runtime import materialize

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_FLUSH = 100_000


def _ddl(what: str) -> str:
    return ", ".join(f"{n} {t}" for n, t in R.FIELDS[what])


def nodes(
    df: DataFrame, id_col: str, text_col: str, what: str = "blocks", gfm: bool = True, skip_frontmatter: bool = True,
    keep: list[str] | None = None, kinds: list[str] | None = None, test: Callable[[Block], bool] | None = None,
) -> DataFrame:
    """One node table (blocks, inlines, cells, link_defs) of every document, keyed by ``id_col``.

    Null texts have no nodes; texts of any size are parsed. Filter the
    documents first: the parse is a Python step no predicate passes through. ``keep`` names document
    columns to carry along, which saves the join back to the documents; ``kinds`` limits the rows that
    leave the parse, and of blocks so does ``test``, a function of the block with its inlines.
    """
    fields, make = R.FIELDS[what], R.ROWS[what]
    carried = [id_col, *(keep or [])]
    clash = {n.lower() for n, _ in fields} & {c.lower() for c in carried}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are node columns; rename them first")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    at_kind = next((i for i, (n, _) in enumerate(fields) if n == "kind"), None)
    wanted = set(kinds) if kinds is not None else None

    def run(batches):
        for batch in batches:
            take, cols = [], [[] for _ in fields]

            def flush():
                index = pa.array(take, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(index) for k in range(len(carried))], *[pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields)]], [*carried, *[n for n, _ in fields]]
                )

            for i, text in enumerate(batch.column(len(carried)).to_pylist()):
                if text is None:
                    continue
                doc = parse(text, gfm, skip_frontmatter)
                found = make(doc) if test is None else make(doc, test)
                found = list(found) if wanted is None else [r for r in found if r[at_kind] in wanted]
                take.extend([i] * len(found))
                for c, values in zip(cols, zip(*found)):
                    c.extend(values)
                if len(take) > _FLUSH:
                    yield flush()
                    take, cols = [], [[] for _ in fields]
            yield flush()

    schema = ", ".join([f"`{c}` {types[c]}" for c in carried] + [_ddl(what)])
    return df.select(*carried, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def parsed(df: DataFrame, id_col: str, text_col: str, gfm: bool = True, skip_frontmatter: bool = True, tables: list[str] | None = None) -> DataFrame:
    """One row per document with its node tables (all four, or those named) as arrays of structs, from a
    single parse. A block's number is its place in the array, so parents are found without a join."""
    kind = df.schema[id_col].dataType.simpleString()
    names = tables or list(R.FIELDS)
    types = [pa.list_(pa.struct([(n, _ARROW[t]) for n, t in R.FIELDS[w]])) for w in names]

    def run(batches):
        for batch in batches:
            cols = [[] for _ in names]
            for text in batch.column(1).to_pylist():
                doc = None if text is None else parse(text, gfm, skip_frontmatter)
                for c, w in zip(cols, names):
                    c.append(None if doc is None else [dict(zip([n for n, _ in R.FIELDS[w]], r)) for r in R.ROWS[w](doc)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], [id_col, *names])

    structs = ", ".join(f"{w} array<struct<{', '.join(f'{n}: {t}' for n, t in R.FIELDS[w])}>>" for w in names)
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {structs}")


def of_document(text: Column, f: Callable[[Document], str | None], gfm: bool = True, skip_frontmatter: bool = True) -> Column:
    """Any text a function makes of the parsed document; null texts give null."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(parse(t, gfm, skip_frontmatter)) for t in texts], dtype=object)

    return made(text)


def node_tables(df: DataFrame, id_col: str, text_col: str, path: str | None = None, **options) -> dict[str, DataFrame]:
    """All four node tables from one parse, stored as Parquet (``path``, else the shared folder)."""
    one = parsed(df, id_col, text_col, **options)
    if path:
        one.write.mode("overwrite").parquet(path)
        one = df.sparkSession.read.parquet(path)
    else:
        one = materialize(one, "nodes")
    return {w: one.select(id_col, F.inline(w)) for w in R.FIELDS}
