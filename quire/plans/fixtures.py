"""Markdown documents derived from the star tables, so that SQL over those tables knows the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import spread, table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with YAML frontmatter: title, extra.lang, extra.source, extra.score?, tags [lang, source]."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lang, source = F.coalesce(q("lang"), F.lit('""')), q("source")
    score = F.when(F.col("align_score").isNotNull(), F.concat(F.lit("\n  score: "), F.format_string("%.4f", F.col("align_score")))).otherwise("")
    front = F.concat(
        F.lit('---\ntitle: "doc '), F.col("doc_id").cast("string"), F.lit('"\nextra:\n  lang: '), lang, F.lit("\n  source: "), source, score,
        F.lit("\ntags:\n  - "), lang, F.lit("\n  - "), source, F.lit("\n---\n## Text\n\n"), F.coalesce("text", F.lit("")),
    )
    return spread(table(spark, sf_dir, "documents")).select("doc_id", front.alias("source"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their props as JSON frontmatter and a heading."""
    return spread(table(spark, sf_dir, "events")).select(F.col("event_id").alias("doc_id"), F.concat("props", F.lit("\n# "), "event_type").alias("source"))


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per user: purchases are quotes, clicks headings of level 2, views of level 3,
    sign-ups fenced code, errors paragraphs, in order."""
    e = table(spark, sf_dir, "events")
    block = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("> bought "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.lit("## click "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit("### view "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("```txt\n"), F.col("event_id").cast("string"), F.lit("\n```")))
        .otherwise(F.concat(F.lit("error "), F.col("event_id").cast("string")))
    )
    rows = e.select("user_id", F.struct("event_id", block.alias("b")).alias("r")).repartition(2 * spark.sparkContext.defaultParallelism, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(F.col("user_id").alias("doc_id"), F.array_join(F.transform("rs", lambda x: x["b"]), "\n\n").alias("source"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order: a table of its lines, quantities aligned right."""
    line = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.col("l_returnflag"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" |"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("r")).repartition(2 * spark.sparkContext.defaultParallelism, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("| line | flag | qty |\n|---|:-:|--:|\n"), F.array_join("rs", "\n")).alias("source"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per region: its nations as tasks, done for even keys."""
    box = F.when(F.col("n_nationkey") % 2 == 0, "- [x] ").otherwise("- [ ] ")
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey", F.concat(box, "n_name").alias("b")).alias("r")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(F.col("n_regionkey").cast("bigint").alias("doc_id"), F.array_join(F.transform("rs", lambda x: x["b"]), "\n").alias("source"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as a reference link whose definition stands at the end."""
    key = F.col("c_custkey").cast("string")
    return spread(table(spark, sf_dir, "customer")).select(
        F.col("c_custkey").alias("doc_id"), F.concat(F.lit("See ["), "c_name", F.lit("][K"), key, F.lit("] now.\n\n[k"), key, F.lit("]: /c/"), key, F.lit(' "'), "c_mktsegment", F.lit('"')).alias("source")
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts: a styled sentence, then fenced code with the brand as its language."""
    return spread(table(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(F.lit("*"), "p_name", F.lit("* is **"), "p_type", F.lit("** in `"), F.col("p_size").cast("string"), F.lit("`\n\n~~~~"), "p_brand", F.lit(" x\n"), "p_name", F.lit("\n~~~~")).alias("source"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a footnote reference and its definition."""
    key = F.col("o_orderkey").cast("string")
    return spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Order[^"), key, F.lit("] stands.\n\n[^"), key, F.lit("]: "), "o_orderpriority").alias("source"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers: an autolink in angles, a bare www link, an e-mail address, hard and soft breaks, HTML."""
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doc_id"),
        F.concat(
            F.lit("<https://s.example/"), key, F.lit(">  \nwww.s.example/"), key, F.lit(",\nmail s"), key, F.lit("@s.example.\n\n<div>\n"), "s_name", F.lit("\n</div>\n\n<!-- from -->\n\nold "), key, F.lit("\n\n<!-- to -->\n\nend <b>x</b>")
        ).alias("source"),
    )
