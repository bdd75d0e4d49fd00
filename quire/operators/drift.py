"""Schemas that drift between exports: observe, promote, unify, and log every change.

The schemas of all records are read in parallel (``observe``) and folded through a lattice of type sets,
whose join is the union (``fold``); ``promote`` maps a set to the narrowest column type that holds it.
``unify`` casts every record to the union of all fields, ``change_log`` lists the ordered differences
between exports.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.core import jsontree
from quire.meta import emit
from quire.meta.frontmatter import FrontMatter, FrontMatterError
from quire.runtime import materialize

#: The promotion lattice above sets of types: integer < float < string, boolean < string, list on top.
LATTICE = {1: "string", 2: "bigint", 4: "double", 6: "double", 8: "boolean"}


def promote(bits: int) -> str:
    """The narrowest Spark type that holds all observed types; lists are kept as JSON text."""
    return LATTICE.get(bits, "string")


def promoted(types: Column) -> Column:
    """``promote`` as a column; null stays null."""
    out = F.when(types.isNull(), F.lit(None).cast("string"))
    for bits, name in LATTICE.items():
        out = out.when(types == bits, name)
    return out.otherwise("string")


BEYOND_BIGINT, BEYOND_DECIMAL, BEYOND_DOUBLE = 1, 2, 4


def misfit(bits: int, values: list[str | None]) -> int:
    """Which number types cannot hold some of a field's values, as bits; 0 where not all are numbers."""
    if bits & ~(jsontree.BIT["integer"] | jsontree.BIT["float"]):
        return 0  # promoted to string anyway
    out = 0
    for v in values:
        if v is None:
            continue
        near = float(v)
        if any(c in v for c in ".eE"):
            lost = math.isinf(near) or near == 0 and any(c in "123456789" for c in re.split("[eE]", v)[0])
        elif len(v.lstrip("-")) > 38:
            out, lost = out | BEYOND_BIGINT | BEYOND_DECIMAL, True
        else:
            whole = int(v)
            out, lost = out | (0 if -(1 << 63) <= whole < 1 << 63 else BEYOND_BIGINT), int(near) != whole
        out |= BEYOND_DOUBLE if lost else 0
    return out


def _reader(raw: bool):
    """Reads one record's root from (root text, raw source, format); the raw source only if ``raw``."""

    def read(text, source, kind):
        root = jsontree.read_root(text)
        if root is not None or not raw or source is None or kind is None:
            return root, "root"
        try:
            return jsontree.read_root(emit.to_json(FrontMatter(source, kind).root, pretty=False)), "raw"
        except (FrontMatterError, ValueError):
            return None, None

    return read


def _sources(df: DataFrame, keys: list[str], json_col: str, raw: tuple[str, str] | None) -> DataFrame:
    source = [F.col(c).cast("string") for c in raw] if raw else [F.lit(None).cast("string")] * 2
    return df.select(*keys, F.col(json_col).alias("_json"), source[0].alias("_raw"), source[1].alias("_format"))


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def observe(df: DataFrame, keys: list[str], json_col: str, raw: tuple[str, str] | None = None) -> DataFrame:
    """One row per readable record and field: keys, field, types (bits), value (hash), n, misfit.

    ``value`` is the hash of the field's values in order, each written as text, ``n`` their number, and
    ``misfit`` has the bits of ``misfit()``. ``raw`` names the columns of the raw source and its format,
    which are read where the root is not readable. A readable record without any field gives one row
    with a null field, so its export is known.
    """
    n, read = len(keys), _reader(raw is not None)

    def run(batches):
        for batch in batches:
            take, field, types, value, counts, misfits = [], [], [], [], [], []
            for i, given in enumerate(zip(*(batch.column(n + k).to_pylist() for k in range(3)))):
                root, _ = read(*given)
                if root is None:
                    continue
                seen = jsontree.fields(root) or {None: (0, [])}
                for name, (bits, values) in seen.items():
                    take.append(i)
                    field.append(name)
                    types.append(bits)
                    value.append(xxhash.xxh64_intdigest("\x1f".join(values).encode("utf-8", "surrogatepass")) - (1 << 63))
                    counts.append(len(values))
                    misfits.append(misfit(bits, values))
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(at) for k in range(n)], pa.array(field, pa.string()), pa.array(types, pa.int32()), pa.array(value, pa.int64()), pa.array(counts, pa.int32()), pa.array(misfits, pa.int32())],
                [*keys, "field", "types", "value", "n", "misfit"],
            )

    return _sources(df, keys, json_col, raw).mapInArrow(run, _ddl(df, keys) + "field string, types int, value bigint, n int, misfit int")


def fold(seen: DataFrame, by: list[str]) -> DataFrame:
    """(by, field, types): all observations of a field joined in the lattice, combined before the shuffle."""
    return seen.groupBy(*by, "field").agg(F.bit_or("types").alias("types"))


def differences(seen: DataFrame) -> DataFrame:
    """(library_id, export_no, field, types, types_before) of fields that are new, gone or of other types.

    Each export is compared with the one before (export_no - 1), if the library has that one. The folded
    schemas are small; a field's exports stand side by side in one window, without a join of exports.
    """
    folded = fold(seen, ["library_id", "export_no"])
    exports = folded.groupBy("library_id").agg(F.collect_set("export_no").alias("_exports"))
    of_field = Window.partitionBy("library_id", "field").orderBy("export_no")
    beside = folded.where("field is not null").select(
        "*", F.lag("export_no").over(of_field).alias("_at"), F.lag("types").over(of_field).alias("_types"), F.lead("export_no").over(of_field).alias("_next")
    ).join(exports, "library_id")
    no, before, after = F.col("export_no"), F.col("export_no") - 1, F.col("export_no") + 1
    follows = F.coalesce(F.col("_at") == before, F.lit(False))
    changed = F.when(follows, F.col("types") != F.col("_types")).otherwise(F.array_contains("_exports", before))
    gone = ~F.coalesce(F.col("_next") == after, F.lit(False)) & F.array_contains("_exports", after)
    none = F.lit(None).cast("int")
    row = lambda cond, at, now, old: F.when(cond, F.struct(at.alias("export_no"), now.alias("types"), old.alias("types_before")))
    rows = F.array_compact(F.array(row(changed, no, F.col("types"), F.when(follows, F.col("_types"))), row(gone, after, none, F.col("types"))))
    return beside.select("library_id", "field", F.explode(rows).alias("d")).select("library_id", "d.export_no", "field", "d.types", "d.types_before")


def changes(files: DataFrame, min_files: int = 3, share: float = 0.8) -> DataFrame:
    """(library_id, export_no, change, old_field, new_field, old_type, new_type) against the export before.

    ``files`` has library_id, export_no, exported_at, fm_id, path?, root?. A gone and a new field are
    a rename if, among the files that hold the old one before and the new one now (at least
    ``min_files``), at least ``share`` have the same values in the same order. Of a file that an
    export holds twice, the latest row counts. Exports without a readable row do not exist. The types
    are the promoted ones, null where there is no field.
    """
    seen = materialize(observe(files, ["library_id", "export_no", "exported_at", "fm_id", "path"], "root").drop("n", "misfit"), "drift")
    diff = materialize(differences(seen), "drift-diff")  # small: only what changed

    # The values of gone fields in the export before and of new ones in this, file by file.
    sought = diff.where("types is null or types_before is null").withColumn("_gone", F.col("types").isNull())
    sought = sought.select(F.col("library_id").alias("_l"), (F.col("export_no") - F.col("_gone").cast("int")).alias("_e"), F.col("field").alias("_f"), "_gone", F.col("export_no").alias("at"))
    held = seen.where("path is not null").join(sought, (F.col("library_id") == F.col("_l")) & (F.col("export_no") == F.col("_e")) & (F.col("field") == F.col("_f")))
    latest = held.groupBy("library_id", "at", "path", "_gone", "field").agg(F.max(F.struct("exported_at", "fm_id", "value"))["value"].alias("value"))
    side = lambda gone: F.collect_list(F.when(F.col("_gone") == gone, F.struct("field", "value")))
    of_file = latest.groupBy("library_id", "at", "path").agg(side(True).alias("old"), side(False).alias("new"))  # at most a file's fields
    pairs = of_file.select("library_id", "at", F.explode("old").alias("o"), "new").select("library_id", "at", "o", F.explode("new").alias("n"))
    renamed = (
        pairs.groupBy("library_id", "at", F.col("o.field").alias("old_field"), F.col("n.field").alias("new_field"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("o.value") == F.col("n.value")).alias("same"))
        .where((F.col("n") >= min_files) & (F.col("same") >= share * F.col("n")))
        .select("library_id", F.col("at").alias("export_no"), "old_field", "new_field")
    )
    renamed = materialize(renamed, "drift-renamed")
    names = renamed.select("library_id", "export_no", F.explode(F.array(F.struct(F.lit(True).alias("gone"), F.col("old_field").alias("field")), F.struct(F.lit(False).alias("gone"), F.col("new_field").alias("field")))).alias("r"))
    names = names.select(F.col("library_id").alias("_l"), F.col("export_no").alias("_e"), "r.*").distinct()
    left = diff.join(names, (F.col("library_id") == F.col("_l")) & (F.col("export_no") == F.col("_e")) & (diff["field"] == names["field"]) & (names["gone"] == diff["types"].isNull()), "left_anti")
    kind = F.when(F.col("types").isNull(), "removed").when(F.col("types_before").isNull(), "added").otherwise("retyped")
    single = left.select(
        "library_id", "export_no", kind.alias("change"), F.when(F.col("types_before").isNotNull(), F.col("field")).otherwise("").alias("old_field"), F.when(F.col("types").isNotNull(), F.col("field")).otherwise("").alias("new_field"),
        promoted(F.col("types_before")).alias("old_type"), promoted(F.col("types")).alias("new_type"),
    )
    typed = lambda name, t, gone: diff.where(F.col("types").isNull() if gone else F.col("types_before").isNull()).select("library_id", "export_no", F.col("field").alias(name), promoted(F.col("types_before" if gone else "types")).alias(t))
    both = renamed.join(typed("old_field", "old_type", True), ["library_id", "export_no", "old_field"]).join(typed("new_field", "new_type", False), ["library_id", "export_no", "new_field"])
    return single.unionByName(both.withColumn("change", F.lit("renamed")))


def change_log(files: DataFrame) -> DataFrame:
    """The changes in order, numbered from 1 within each export of a library."""
    order = Window.partitionBy("library_id", "export_no").orderBy("change", "old_field", "new_field")
    return changes(files).withColumn("change_no", F.row_number().over(order))


def union_schema(seen: DataFrame) -> DataFrame:
    """(field, types, spark_type, records, item_type, many): all observations folded through the lattice.

    ``spark_type`` is the promoted type of the field's values. ``item_type`` is that too unless values
    do not fit: then decimal(38,0) for integers, else string. ``many`` says that a record can hold
    several values: the field lies below a list, or occurs twice in some record.
    """
    folded = seen.where("field is not null").groupBy("field").agg(
        F.bit_or("types").alias("types"), F.count("*").alias("records"), F.bit_or("misfit").alias("misfit"), (F.col("field").contains("[]") | (F.max("n") > 1)).alias("many")
    )
    beyond = lambda bit: F.col("misfit").bitwiseAND(bit) != 0
    item = (
        F.when((F.col("spark_type") == "bigint") & beyond(BEYOND_BIGINT), F.when(beyond(BEYOND_DECIMAL), "string").otherwise("decimal(38,0)"))
        .when((F.col("spark_type") == "double") & beyond(BEYOND_DOUBLE), "string")
        .otherwise(F.col("spark_type"))
    )
    return folded.withColumn("spark_type", promoted(F.col("types"))).withColumn("item_type", item).drop("misfit")


def as_map(files: DataFrame, keys: list[str], json_col: str = "root", raw: tuple[str, str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Every readable record as (keys, read_from, values map<field, array<string>>): the union without
    a bound on the number of fields. With ``fields`` the values are an array in their order instead.

    A value's text is as ``observe`` reads it. Values below a list stand at the places of the list's
    objects, null where an object lacks the field.
    """
    n, read = len(keys), _reader(raw is not None)
    value = pa.list_(pa.string())
    kind = pa.map_(pa.string(), value) if fields is None else pa.list_(value)

    def run(batches):
        for batch in batches:
            take, origin, values = [], [], []
            for i, given in enumerate(zip(*(batch.column(n + k).to_pylist() for k in range(3)))):
                root, come_from = read(*given)
                if root is None:
                    continue
                found = {name: v for name, (_, v) in jsontree.fields(root, places=True).items()}
                take.append(i)
                origin.append(come_from)
                values.append(list(found.items()) if fields is None else [found.get(f) for f in fields])
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(n)], pa.array(origin, pa.string()), pa.array(values, kind)], [*keys, "read_from", "values"])

    return _sources(files, keys, json_col, raw).mapInArrow(run, _ddl(files, keys) + "read_from string, values " + ("map<string, array<string>>" if fields is None else "array<array<string>>"))


def _cast(items: Column, kind: str, many: bool) -> Column:
    return F.transform(items, lambda x: x.cast(kind)) if many else F.get(items, 0).cast(kind)


def unify(files: DataFrame, keys: list[str], json_col: str = "root", max_columns: int = 2000, raw: tuple[str, str] | None = None) -> DataFrame:
    """Every readable record in one table: the keys, then each field cast to its promoted type.

    A field of which a record can hold several values (below a list, or a dotted key beside a nested
    one) is an array of that type, its values in order and, below a list, at the places of its objects.
    Numbers that the promoted type cannot hold widen the whole field, to decimal(38,0) or string, so
    every value is kept. With ``raw`` (the columns of the raw source and its format) records whose root
    is not readable are read from there, and ``read_from`` says where from.

    Two passes over the records, the first for the union schema, and no shuffle of their values. The
    union schema is bounded by the number of distinct fields; more than ``max_columns`` raise an
    error instead of a silently cut table, and ``as_map`` has no bound. Column names keep the field's
    path; one that clashes with a key, or with another field in another case, gets a trailing underscore.
    """
    schema = union_schema(observe(files, keys, json_col, raw)).orderBy("field").limit(max_columns + 1).collect()
    if len(schema) > max_columns:
        raise ValueError(f"more than {max_columns} distinct fields; use as_map")
    keep = [*keys, *(["read_from"] if raw else [])]
    taken, columns = {k.lower() for k in keep}, []
    for i, r in enumerate(schema):
        name = r["field"]
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(_cast(F.get("values", i), r["item_type"], r["many"]).alias(name))
    return as_map(files, keys, json_col, raw, [r["field"] for r in schema]).select(*keep, *columns)
