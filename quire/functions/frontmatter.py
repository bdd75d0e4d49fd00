"""Frontmatter as columns: reading in Python (four syntaxes), querying natively on VARIANT."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.meta import emit, values
from quire.meta.frontmatter import FrontMatter, FrontMatterError, body_offset, locate

READ = "struct<format: string, json: string, error: string, body_start: int>"


def read(text: Column, sniff: str = "strict") -> Column:
    """struct(format, json, error, body_start) of the frontmatter a document begins with.

    ``json`` is the ordered tree; unreadable frontmatter has a null tree and an error, and its body
    still begins after it. Documents without frontmatter have null format and body_start 0.
    """

    @F.pandas_udf(READ)
    def reading(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = None if t is None else locate(t, sniff)
            if not found:
                out.append((None, None, None, 0 if t is not None else None))
                continue
            try:
                out.append((found[0], emit.to_json(FrontMatter(found[1], found[0]).root, pretty=False), None, found[2]))
            except FrontMatterError as e:
                out.append((found[0], None, str(e), found[2]))
        return pd.DataFrame(out, columns=["format", "json", "error", "body_start"]).astype({"body_start": "Int32"})

    # Marked so that Catalyst does not copy it into every expression over its fields: one reading a
    # document. Filters on other columns belong before it.
    return reading.asNondeterministic()(text)


def to_json(source: Column, kind: Column) -> Column:
    """The ordered JSON text of frontmatter whose delimiters are gone; null if it cannot be read."""

    @F.pandas_udf("string")
    def tree(sources: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for s, k in zip(sources, kinds):
            try:
                out.append(None if s is None or k is None else emit.to_json(FrontMatter(s, k).root, pretty=False))
            except FrontMatterError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return tree(source, kind)


def edit(source: Column, sets: list[str] = (), deletes: list[str] = (), serialize: bool = True) -> Column:
    """Documents with frontmatter fields set (``path=value``), then deleted; edits that cannot be
    applied are skipped, documents without readable frontmatter stay as they are."""
    pairs = []
    for s in sets:
        try:
            pairs.append(values.field_arg(s))
        except values.FieldError:
            continue
    deletes = list(deletes)

    @F.pandas_udf("string")
    def edited(texts: pd.Series) -> pd.Series:
        import copy

        out = []
        for t in texts:
            try:
                fm = None if t is None else FrontMatter.from_markdown(t)
            except FrontMatterError:
                fm = None
            if fm is None:
                out.append(t)
                continue
            for path, value in pairs:
                try:
                    fm.set(path, copy.deepcopy(value))
                except values.FieldError:
                    pass
            for path in deletes:
                fm.delete(path)
            out.append(fm.to_markdown(t[body_offset(t) :]) if serialize else fm.to_json(pretty=False))
        return pd.Series(out, dtype=object)

    return edited(source)


def merge(base_json: Column, overlay_json: Column) -> Column:
    """Two trees as JSON text merged deeply, the overlay winning; a null side leaves the other."""
    import json

    @F.pandas_udf("string")
    def merged(bases: pd.Series, overlays: pd.Series) -> pd.Series:
        out = []
        for b, o in zip(bases, overlays):
            out.append(o if b is None else b if o is None else emit.to_json(values.merged(json.loads(b), json.loads(o)), pretty=False))
        return pd.Series(out, dtype=object)

    return merged(base_json, overlay_json)


def serialize(json_text: Column, kind: Column) -> Column:
    """A tree as frontmatter text with delimiters, in the format named."""
    import json

    @F.pandas_udf("string")
    def text(trees: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or k is None else FrontMatter.of(json.loads(t), k).serialize() for t, k in zip(trees, kinds)], dtype=object)

    return text(json_text, kind)


# -- native queries on the tree ----------------------------------------------------------------------

def variant_path(path: str) -> str | None:
    """The VARIANT path of a dotted one; None for the empty path, and for keys no path can name."""
    if not path:
        return None
    out = "$"
    for key in values.segments(path):
        if '"' not in key:
            out += f'["{key}"]'
        elif "'" not in key:
            out += f"['{key}']"
        else:
            return None
    return out


def field(fm: Column, path: str) -> Column:
    """The value at a path as VARIANT; SQL null if absent, a VARIANT null if the value is null."""
    where = variant_path(path)
    return F.lit(None).cast("variant") if where is None else F.try_variant_get(fm, where, "variant")


def exists(fm: Column, path: str) -> Column:
    """Whether the tree has the path; a JSON null counts. Null trees have nothing."""
    return field(fm, path).isNotNull()


def _scalar(v: Column, expected: str) -> Column:
    kind = F.schema_of_variant(v)
    plain = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    text = F.try_variant_get(v, "$", "string")
    same = F.when(kind == "VOID", F.lit(expected == "null")).when(plain, text == F.lit(expected))
    number = values.number(expected)
    if isinstance(number, (int, float)) and values.as_text(float(number)) == expected:
        # Floats are compared by decimal spelling without exponent, which VARIANT's own text is not.
        same = F.when(kind == "DOUBLE", F.try_variant_get(v, "$", "double") == F.lit(float(number))).otherwise(same)
    return F.coalesce(same, F.lit(False))


def equals(fm: Column, path: str, expected: str) -> Column:
    """Filter equality: a scalar by its text, or a list with a matching item, in lists of any depth.
    Objects never match."""

    def items(v: Column) -> Column:
        # One level of lists goes in each round; a value has no more levels than opening brackets.
        inner = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
        levels = F.length(F.regexp_replace(F.coalesce(F.to_json(v), F.lit("")), r"[^\[]", ""))
        rounds = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, F.array(v), lambda acc, _: F.flatten(F.transform(acc, inner)))

    # Bound by a lambda, so that the tree is parsed once and not in each place that looks at it.
    found = lambda v: F.exists(items(v), lambda x: x.isNotNull() & _scalar(x, expected))
    return F.exists(F.array(field(fm, path)), lambda v: F.coalesce(v.isNotNull() & found(v), F.lit(False)))


def sort_keys(fm: Column, path: str) -> list[Column]:
    """(rank, number, text): strings first, then numbers, then everything else, then nothing."""
    v = field(fm, path)
    kind = F.schema_of_variant(v)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    rank = F.when(v.isNull(), 3).when(kind == "STRING", 0).when(numeric, 1).otherwise(2)
    return [rank, F.when(numeric, F.try_variant_get(v, "$", "double")), F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))]
