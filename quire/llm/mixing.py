"""Mixing sources to target shares of the total size, with capped repeats.

A source first contributes complete epochs; what is then missing is drawn without replacement by
exponential keys (Efraimidis-Spirakis): key = -ln(u) / quality, the smallest keys first, until their
sizes fill the rest of the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tokens import DEFAULT_TOKENIZER, n_tokens
from quire.runtime import materialize


def source_key(source: Column) -> Column:
    """Sources are the same if they agree trimmed and in lower case."""
    return F.lower(F.trim(source))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source has, must give and can give.

    ``sizes``: rows of (source key, n). ``targets``: source, target_share, max_repeats. Columns:
    source, target_share, max_repeats, size, total, budget, drawn_budget, epochs, rest, short. Sources
    that are not targets stay out of the total; a target without documents has size 0. ``targets`` is
    a handful of rows, so the sums joined to it are as well.
    """
    by_source = sizes.groupBy("source_key").agg(F.sum("n").alias("size"))  # combined before the shuffle
    wanted = targets.select("source", "target_share", "max_repeats", source_key(F.col("source")).alias("source_key"))
    rows = wanted.join(by_source, "source_key", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    # A handful of rows: one window over all of them, a source that is named twice counted once.
    once = F.row_number().over(Window.partitionBy("source_key").orderBy("source")) == 1
    rows = rows.withColumn("_once", F.when(once, F.col("size"))).withColumn("total", F.sum("_once").over(Window.partitionBy(F.lit(0)))).drop("_once")
    rows = rows.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("budget", F.col("target_share") * F.col("total"))
    most = F.col("size") * F.coalesce("max_repeats", F.lit(1))
    rows = rows.withColumn("short", most < F.col("budget")).withColumn("drawn_budget", F.least("budget", most.cast("double")))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("drawn_budget") / F.col("size"))).otherwise(F.lit(0))
    return rows.withColumn("epochs", epochs.cast("bigint")).withColumn("rest", F.col("drawn_budget") - F.col("epochs") * F.col("size"))


def quality_of(score: Column, hundred: Column | None = None) -> Column:
    """A score as a weight between 0.01 and 1, unknown ones 0.5. ``hundred`` says that the score's source
    counts to 100; without it only scores above 1 are taken so."""
    unit = F.when(score > 1 if hundred is None else F.coalesce(hundred, F.lit(False)), score / 100).otherwise(score)
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.coalesce(F.nanvl(unit, F.lit(0.5)), F.lit(0.5))))


def draw(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id", seed: int = 42, per_octave: int = 64) -> DataFrame:
    """(id, source, n, repeats) of every drawn document; repeats never exceeds max_repeats.

    ``docs``: id, source_key, n, quality. Keys are hashes, so a run repeats exactly. The prefix sums
    of a source run over ranges of the key and then within the one range where the budget ends, never
    over a whole source in one task: a source may hold a third of all rows. Ranges are logarithmic,
    ``per_octave`` to each doubling of the key: of exponential keys, whatever their weights, none then
    holds more than ln(2) / (e * per_octave) of a source, 0.4 % here.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = docs.join(planned.select("source_key", "source", "epochs", "rest"), "source_key")
    keyed = keyed.withColumn("_key", -F.log(u) / F.col("quality"))
    keyed = keyed.withColumn("_bucket", F.floor(F.log2(F.col("_key")) * per_octave).cast("int"))
    whole = keyed.groupBy("source_key", "_bucket").agg(F.sum("n").alias("_in"))  # a few thousand ranges a source
    upto = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("source_key", "_bucket", F.coalesce(F.sum("_in").over(upto), F.lit(0)).alias("_before"), "_in")
    keyed = keyed.join(before, ["source_key", "_bucket"])
    inside = Window.partitionBy("source_key", "_bucket").orderBy("_key", id_col, "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partial = (F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_in") > F.col("rest"))
    fixed = keyed.where(~partial).withColumn("_extra", ((F.col("rest") > 0) & (F.col("_before") + F.col("_in") <= F.col("rest"))).cast("int"))
    summed = keyed.where(partial).withColumn("_extra", (F.col("_before") + F.sum("n").over(inside) <= F.col("rest")).cast("int"))
    drawn = fixed.unionByName(summed).withColumn("repeats", F.col("epochs") + F.coalesce("_extra", F.lit(0)))
    return drawn.where("repeats > 0").select(id_col, "source", "n", "repeats")


def sized(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, source_key, n, quality) with sizes in tokens; null texts have size 0.

    A source whose greatest score is above 1 counts its scores to 100, the low ones too.
    """
    docs = docs.select("doc_id", source_key(F.col("source")).alias("source_key"), "text", "align_score")
    scales = docs.where(~F.isnan("align_score")).groupBy("source_key").agg((F.max("align_score") > 1).alias("_hundred"))
    docs = docs.join(scales.withColumnRenamed("source_key", "_s"), F.col("source_key").eqNullSafe(F.col("_s")), "left")
    return docs.select("doc_id", "source_key", n_tokens(F.col("text"), tokenizer).cast("bigint").alias("n"), quality_of(F.col("align_score"), F.col("_hundred")).alias("quality"))


def of_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Only the documents whose source is a target, found before any text is tokenized."""
    keys = targets.select(source_key(F.col("source")).alias("_t")).where("_t is not null").distinct()
    return docs.join(keys, source_key(docs["source"]) == keys["_t"], "left_semi")


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(plan, drawn documents) of a mixture."""
    rows = materialize(sized(of_targets(docs, targets), tokenizer), "mix")
    planned = materialize(plan(rows, targets), "mix-plan")
    return planned, draw(rows, planned, seed=seed)


def shares(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """Target and reached share of each source, of the intended total and of what was drawn.

    ``short`` is judged by what was drawn: a source gave every document ``max_repeats`` times and still
    stayed below its budget.
    """
    got = drawn.groupBy("source").agg(F.sum(F.col("n") * F.col("repeats")).alias("drawn"), F.max("repeats").alias("most_repeats"))
    rows = planned.select("source", "target_share", "max_repeats", "size", "total", "budget").join(got, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    rows = rows.withColumn("_all", F.sum("drawn").over(Window.partitionBy(F.lit(0))))  # a handful of rows
    spent = F.col("drawn") == F.col("size") * F.coalesce("max_repeats", F.lit(1))
    return rows.select(
        "source", "target_share", "max_repeats", "size", (spent & (F.col("drawn") < F.col("budget"))).alias("short"), "drawn", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.try_divide(F.col("drawn"), F.col("total")).alias("share_of_total"), F.try_divide(F.col("drawn"), F.col("_all")).alias("share_of_drawn"),
    )
