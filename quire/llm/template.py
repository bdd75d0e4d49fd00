"""Template deduction over pages of one host: equivalence classes of tokens, nested into a template.

Tokens that occur equally often on each page of a host (the same occurrence vector) form an equivalence
class. A class of enough tokens on enough pages is valid if its tokens come in one order on every page,
repeated as a whole. A valid class is nested in another if all its occurrences lie in one and the same
gap between two of the other's tokens, on every page. What stands between the template's tokens are the
page's slots.

Vectors are compared by a hash that is summed up before the shuffle, so no token and no host is gathered
in one task; only the tokens of classes come back to their pages.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialize

#: Tags, marks of wiki and LaTeX constructs, words.
TOKEN = re.compile(r"</?[A-Za-z][A-Za-z0-9]*|\{\{|\}\}|\[\[|\]\]|''+|\\[A-Za-z]+|[^\W_]+")
MARKUP = r"^(?:<|\{\{|\}\}|\[\[|\]\]|''|\\)"
CLASSES = "host, class_id, pages, n_tokens, tokens, valid, parent, gap"


def occurrences(df: DataFrame, host_col: str, text_col: str, page_col: str | None = None) -> DataFrame:
    """(host, page, token, at): each distinct token of each page with the places where it stands.

    Pages are numbered by row, or by ``page_col``, a number no two rows share.
    """
    page = F.monotonically_increasing_id() if page_col is None else F.col(page_col).cast("bigint")

    def run(batches):
        for batch in batches:
            take, tokens, places = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found: dict[str, list[int]] = {}
                for m in TOKEN.finditer(text):
                    found.setdefault(m[0], []).append(m.start())
                take.extend([i] * len(found))
                tokens.extend(found)
                places.extend(found.values())
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(tokens, pa.string()), pa.array(places, pa.list_(pa.int32()))], ["host", "page", "token", "at"])

    rows = df.select(F.col(host_col).alias("host"), page.alias("page"), F.col(text_col).alias("text")).where("host is not null and text is not null")
    return rows.mapInArrow(run, f"host {df.schema[host_col].dataType.simpleString()}, page bigint, token string, at array<int>")


def equivalence_classes(found: DataFrame, min_pages: int = 3, min_tokens: int = 2) -> DataFrame:
    """(host, token, class_id, pages, n_tokens) of tokens with equal vectors, in classes large and frequent enough."""
    vector = [F.bit_xor(F.xxhash64(F.lit(salt), "page", F.size("at"))).alias(f"_v{salt}") for salt in (1, 2)]
    tokens = found.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(F.size("at")).alias("_n"), *vector).where(F.col("pages") >= min_pages)
    tokens = tokens.select("host", "token", "pages", F.xxhash64("host", "pages", "_n", "_v1", "_v2").alias("class_id"))
    large = tokens.groupBy("host", "class_id").agg(F.count("*").alias("n_tokens")).where(F.col("n_tokens") >= min_tokens)
    return tokens.join(large, ["host", "class_id"])


def deduce(df: DataFrame, host_col: str, text_col: str, min_pages: int = 3, min_tokens: int = 2, page_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, places): host, class_id, pages, n_tokens, tokens in order, valid, parent, gap; and where the
    tokens of valid classes stand: host, page, class_id, at (array of token and place, in order).

    Null hosts and texts take no part; an empty table has no classes. Pages are numbered by row, so a row
    that occurs twice is two pages. ``parent`` and ``gap`` (from 1) are null for classes of the top level
    and for those that are not valid.
    """
    found = materialize(occurrences(df, host_col, text_col, page_col), "template")
    classes = materialize(equivalence_classes(found, min_pages, min_tokens), "template-classes")
    placed = found.join(classes.select("host", "token", "class_id", "n_tokens"), ["host", "token"])
    rows = placed.select("host", "page", "class_id", "n_tokens", F.explode("at").alias("place"), "token").groupBy("host", "page", "class_id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("at"))
    n, names = F.col("n_tokens").cast("int"), F.transform("at", lambda x: x["token"])
    whole = F.forall(F.transform(names, lambda x, i: x == F.get(names, F.pmod(i, n))), lambda same: same)
    rows = materialize(rows.select("host", "page", "class_id", "n_tokens", "at", F.slice(names, F.lit(1), n).alias("tokens"), (whole & (F.size("at") % n == 0)).alias("ordered")), "template-places")
    judged = rows.groupBy("host", "class_id", "n_tokens").agg(F.count("*").alias("pages"), F.min("tokens").alias("tokens"), (F.min("tokens") == F.max("tokens")).alias("_same"), F.bool_and("ordered").alias("_ordered"))
    judged = materialize(judged.select("host", "class_id", "pages", "n_tokens", "tokens", (F.col("_same") & F.col("_ordered")).alias("valid")), "template-valid")
    places = rows.join(judged.where("valid").select("host", "class_id"), ["host", "class_id"], "left_semi").select("host", "page", "class_id", "n_tokens", "at")

    page = places.groupBy("host", "page").agg(F.collect_list(F.struct("class_id", "n_tokens", F.transform("at", lambda x: x["place"]).alias("at"))).alias("classes"))
    inside = page.mapInArrow(_nesting, f"host {df.schema[host_col].dataType.simpleString()}, class_id bigint, parent bigint, gap int")
    nested = inside.groupBy("host", "class_id").agg(F.min("parent").alias("_p"), F.max("parent").alias("_q"), F.min("gap").alias("_g"), F.max("gap").alias("_h"), F.count("parent").alias("_k"), F.count("*").alias("_n"))
    settled = (F.col("_p") == F.col("_q")) & (F.col("_g") == F.col("_h")) & (F.col("_k") == F.col("_n"))
    nested = nested.select("host", "class_id", F.when(settled, F.col("_p")).alias("parent"), F.when(settled, F.col("_g")).alias("gap"))
    return judged.join(nested, ["host", "class_id"], "left").select(*CLASSES.split(", ")), places.select("host", "page", "class_id", "at")


def _nesting(batches):
    """For each class of a page the smallest class around it and the gap it lies in, nulls where there is none."""
    for batch in batches:
        hosts, classes, parents, gaps = [], [], [], []
        for i, found in enumerate(batch.column(2).to_pylist()):
            spans = {c["class_id"]: (c["n_tokens"], c["at"]) for c in found}
            for name, (n, at) in spans.items():
                best = None
                for other, (m, places) in spans.items():
                    if other == name:
                        continue
                    gap = _gap(at, n, places, m)
                    reach = places[m - 1] - places[0] if gap else None
                    if gap and (best is None or (reach, other) < best[:2]):
                        best = reach, other, gap
                hosts.append(i)
                classes.append(name)
                parents.append(best[1] if best else None)
                gaps.append(best[2] if best else None)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hosts, pa.int64())), pa.array(classes, pa.int64()), pa.array(parents, pa.int64()), pa.array(gaps, pa.int32())], ["host", "class_id", "parent", "gap"])


def _gap(at: list[int], n: int, places: list[int], m: int) -> int | None:
    """The gap (from 1) between two tokens of the outer class that holds every run of the inner one."""
    import bisect

    out = None
    for s in range(0, len(at), n):
        first, last = bisect.bisect(places, at[s]), bisect.bisect(places, at[s + n - 1])
        if first != last or first % m == 0 or (out is not None and out != first % m):
            return None
        out = first % m
    return out


def slots(df: DataFrame, host_col: str, id_col: str, text_col: str, min_pages: int = 3, min_tokens: int = 2) -> DataFrame:
    """(id, slot_no, start, slot): what stands between the template's tokens, blank stretches left out.

    A page without template tokens is one slot, as far as it has text; null texts and hosts give none.
    """
    pages = df.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.monotonically_increasing_id().alias("page"), F.col(text_col).alias("_text")).where("_host is not null and _text is not null")
    pages = materialize(pages, "template-pages")
    _, places = deduce(pages, "_host", "_text", min_pages, min_tokens, "page")
    cuts = places.groupBy("page").agg(F.array_sort(F.flatten(F.collect_list(F.transform("at", lambda x: F.struct(x["place"].alias("start"), (x["place"] + F.length(x["token"])).alias("end")))))).alias("cuts"))
    edge = lambda end: F.struct(end.alias("start"), end.alias("end"))
    pages = pages.join(cuts, "page", "left").withColumn("cuts", F.concat(F.array(edge(F.lit(0))), F.coalesce("cuts", F.array().cast("array<struct<start: int, end: int>>")), F.array(edge(F.length("_text")))))
    between = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.get("cuts", i - 1)["end"].alias("start"), F.substring(F.col("_text"), F.get("cuts", i - 1)["end"] + 1, F.get("cuts", i)["start"] - F.get("cuts", i - 1)["end"]).alias("slot")))
    kept = F.filter(between, lambda x: x["slot"].rlike(r"\S"))
    return pages.select("_id", F.posexplode(kept).alias("slot_no", "s")).select(F.col("_id").alias(id_col), "slot_no", F.col("s.start").alias("start"), F.col("s.slot").alias("slot"))
