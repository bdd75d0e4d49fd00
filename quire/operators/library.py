"""A queryable collection of Markdown documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import frontmatter as fmf
from quire.functions import parsing
from quire.plans import selectors
from quire.runtime import materialize

DOCUMENTS = "doc_id bigint, doc_seq bigint, path string, source string"
RESULT = ["doc_seq", "doc_id", "path", "fm_json", "block_id", "kind", "level", "text", "language", "confidence"]


def _parse_error(name: str, max_bytes: int | None) -> Column:
    """Why a document has no nodes: it is above the limit its collection sets."""
    if max_bytes is None:
        return F.lit(None).cast("string").alias("parse_error")
    return F.when(F.octet_length(name) > max_bytes, F.lit(f"larger than {max_bytes} bytes")).alias("parse_error")


class Library:
    """Documents with frontmatter, and queries over them.

    ``docs`` has doc_id, doc_seq (the collection's order), path, source, body, content_hash,
    fm_format, fm_json, fm_error, parse_error. All methods return DataFrames; nothing runs before an action.
    ``strip`` decides what is parsed as body: ``cli`` (the text after the frontmatter) or ``library``
    (the whole source, of which the parser itself skips a leading delimited block).
    """

    def __init__(self, docs: DataFrame, strip: str = "cli"):
        self.docs, self.strip, self._blocks = docs, strip, None

    # building -------------------------------------------------------------------------------------
    @classmethod
    def empty(cls, spark: SparkSession) -> Library:
        return cls.from_rows(spark.createDataFrame([], DOCUMENTS))

    @classmethod
    def from_rows(cls, df: DataFrame, on_error: str = "permissive", sniff: str = "strict", strip: str = "cli", max_bytes: int | None = None) -> Library:
        """From doc_id, doc_seq, path?, source?. Documents above ``max_bytes`` have parse_error and no
        nodes, whichever way they are asked for; without it all are parsed. Unreadable frontmatter gives fm_error, or with
        ``on_error='failfast'`` ends the job. Null sources are documents without anything."""
        base = df.select("doc_id", "doc_seq", "path", "source")
        read = base.withColumn("_fm", fmf.read(F.col("source"), sniff))
        error = F.col("_fm.error")
        if on_error == "failfast":
            error = F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.lit(None)).cast("string")
        docs = read.select(
            "doc_id", "doc_seq", "path", "source",
            F.expr("substring(source, _fm.body_start + 1)").alias("body"),
            F.xxhash64("source").alias("content_hash"),
            F.col("_fm.format").alias("fm_format"), F.col("_fm.json").alias("fm_json"), error.alias("fm_error"), _parse_error("source", max_bytes),
        )
        return cls(docs, strip)

    @classmethod
    def from_column(cls, df: DataFrame, id_col: str, text_col: str, seq_col: str | None = None, path_col: str | None = None, **options) -> Library:
        """From any DataFrame with an identifier and a text column; order by ``seq_col``, else by id."""
        return cls.from_rows(
            df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(seq_col or id_col).cast("bigint").alias("doc_seq"), (F.col(path_col) if path_col else F.lit(None)).cast("string").alias("path"), F.col(text_col).cast("string").alias("source")),
            **options,
        )

    @classmethod
    def from_parts(cls, df: DataFrame, id_col: str, body_col: str, fm_col: str, format_col: str, seq_col: str | None = None, path_col: str | None = None, max_bytes: int | None = None) -> Library:
        """From documents whose frontmatter is stored apart, without its delimiters."""
        docs = df.select(
            F.col(id_col).cast("bigint").alias("doc_id"), F.col(seq_col or id_col).cast("bigint").alias("doc_seq"), (F.col(path_col) if path_col else F.lit(None)).cast("string").alias("path"),
            F.col(body_col).alias("source"), F.col(body_col).alias("body"), F.xxhash64(body_col).alias("content_hash"), F.col(format_col).alias("fm_format"),
            fmf.to_json(F.col(fm_col), F.col(format_col)).alias("fm_json"), F.lit(None).cast("string").alias("fm_error"), _parse_error(body_col, max_bytes),
        )
        return cls(docs)

    @classmethod
    def from_files(cls, files: DataFrame, **options) -> Library:
        """From (path, content BINARY): bytes that are no UTF-8 become replacement characters.
        Identifiers, and the order, are hashes of the path: the same in every run and no sort. The
        order keeps 56 bits, which leaves room for the shifts of many unions."""
        from quire.sources.markdown_files import utf8

        key = F.xxhash64("path")
        return cls.from_rows(files.select(key.alias("doc_id"), F.shiftrightunsigned(key, 8).alias("doc_seq"), "path", utf8(F.col("content")).alias("source")), **options)

    def add(self, source: str, path: str | None = None, **options) -> Library:
        """The collection with one more document at its end."""
        spark = self.docs.sparkSession
        last = self.docs.agg(F.coalesce(F.max("doc_seq"), F.lit(-1)).alias("s"), F.coalesce(F.max("doc_id"), F.lit(-1)).alias("d"))
        row = spark.createDataFrame([(source, path)], "source string, path string")
        new = row.withColumn("_k", F.lit(1)).join(last.withColumn("_k", F.lit(1)), "_k").select((F.col("d") + 1).alias("doc_id"), (F.col("s") + 1).alias("doc_seq"), "path", "source")
        return Library(self.docs.unionByName(Library.from_rows(new, **options).docs), self.strip)

    def add_file(self, path: str, **options) -> Library:
        from quire.sources.markdown_files import MAX_BYTES

        with open(path, "rb") as f:
            data = f.read(MAX_BYTES + 1)
        if len(data) > MAX_BYTES:
            raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
        return self.add(data.decode("utf-8", "replace"), path, **options)

    def add_dir(self, root: str, **options) -> Library:
        """The collection and every ``.md`` file below a folder, hidden ones too."""
        from quire.sources.markdown_files import markdown_files

        return self.union(Library.from_files(markdown_files(self.docs.sparkSession, root), **options))

    def union(self, other: Library) -> Library:
        """Both collections, the other one's documents after this one's."""
        last = self.docs.agg(F.coalesce(F.max("doc_seq"), F.lit(-1)).alias("_s")).withColumn("_k", F.lit(1))
        first = other.docs.agg(F.coalesce(F.min("doc_seq"), F.lit(0)).alias("_f")).withColumn("_k", F.lit(1))
        shift = last.join(first, "_k")
        moved = other.docs.withColumn("_k", F.lit(1)).join(F.broadcast(shift), "_k")  # one row
        moved = moved.withColumn("doc_seq", F.col("doc_seq") - F.col("_f") + F.col("_s") + 1).withColumn("doc_id", F.xxhash64("doc_id", "path", "_s"))
        return Library(self.docs.unionByName(moved.drop("_k", "_s", "_f")), self.strip)

    # nodes ----------------------------------------------------------------------------------------
    def text_column(self) -> str:
        return "body" if self.strip == "cli" else "source"

    def nodes(self, what: str = "blocks", docs: DataFrame | None = None, keep: list[str] | None = None, kinds: list[str] | None = None, test: Callable | None = None) -> DataFrame:
        """A node table of the collection, or of a part of its documents."""
        docs = (docs if docs is not None else self.docs).where("parse_error is null")
        return parsing.nodes(docs, "doc_id", self.text_column(), what, skip_frontmatter=self.strip != "cli", keep=keep, kinds=kinds, test=test)

    def store_nodes(self, path: str | None = None) -> Library:
        """Parses once and keeps the blocks, partitioned by kind so that ``@kind`` reads its files only."""
        if path is None:
            stored = materialize(self.nodes("blocks"), "blocks")
        else:
            self.nodes("blocks").write.mode("overwrite").partitionBy("kind").parquet(path)
            stored = self.docs.sparkSession.read.parquet(path)
        out = Library(self.docs, self.strip)
        out._blocks = stored
        return out

    # queries --------------------------------------------------------------------------------------
    def where(self, filters: list[selectors.Filter]) -> DataFrame:
        """Documents that pass all filters; without frontmatter none passes any."""
        if not filters:
            return self.docs
        fm = F.try_parse_json("fm_json")
        tests: list[Column] = [fmf.exists(fm, f.path) if f.value is None else fmf.equals(fm, f.path, f.value) for f in filters]
        return self.docs.where(reduce(lambda a, b: a & b, tests))

    def query(self, selector: str, max_filters: int | None = None) -> DataFrame:
        """The rows a selector asks for: documents, or with ``@kind`` their blocks at any depth.

        Documents are filtered before anything is parsed. Rows rank by confidence (always 1), then in
        collection order; an unknown kind gives no rows.
        """
        plan = selectors.parse(selector, max_filters)
        docs = self.where(plan.filters)
        head = ["doc_seq", "doc_id", "path", "fm_json"]
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        if not plan.selects_blocks:
            rows = docs.select(*head, none("block_id", "int"), none("kind", "string"), none("level", "int"), none("text", "string"), none("language", "string"))
        elif plan.kind is None:
            rows = docs.where(F.lit(False)).select(*head, none("block_id", "int"), none("kind", "string"), none("level", "int"), none("text", "string"), none("language", "string"))
        else:
            needle = selectors.NEEDLES.get(plan.kind)
            if self._blocks is not None:
                blocks = self._blocks.where(F.col("kind") == plan.kind).select("doc_id", "block_id", "kind", "level", "text", "content", "language")
                rows = docs.select(*head).join(blocks, "doc_id")
            else:  # one pass, no join: the parse carries the document's columns along
                source = docs.where(F.col(self.text_column()).rlike(needle)) if needle else docs
                rows = self.nodes("blocks", source, keep=["doc_seq", "path", "fm_json"], kinds=[plan.kind])
            rows = rows.select(*head, "block_id", "kind", "level", F.coalesce("text", "content").alias("text"), "language")
        return rows.withColumn("confidence", F.lit(1.0).cast("float")).select(*RESULT).orderBy(F.desc("confidence"), "doc_seq", "doc_id", "block_id")

    @staticmethod
    def sort_by(results: DataFrame, path: str, ascending: bool = True, nulls: str = "last") -> DataFrame:
        """Results ordered by a frontmatter field: strings bytewise, then numbers, then the rest.

        Rows without the field come last; with ``nulls='reference'`` a descending order is a plain
        reversal and puts them first. Ties keep collection order.
        """
        rank, num, text = fmf.sort_keys(F.try_parse_json("fm_json"), path)
        rows = results.withColumns({"_rank": rank, "_num": num, "_text": text})
        missing = F.col("_rank") == 3
        if ascending:
            keys = [F.asc("_rank"), F.asc("_num"), F.asc("_text")]
        else:
            lead = missing.asc() if nulls == "last" else missing.desc()
            keys = [lead, F.desc("_rank"), F.desc("_num"), F.desc("_text")]
        return rows.orderBy(*keys, "doc_seq", "doc_id", "block_id").drop("_rank", "_num", "_text")

    # in-document queries --------------------------------------------------------------------------
    def top(self, kind: str | None = None) -> DataFrame:
        """Top-level blocks, of one kind or all."""
        rows = (self._blocks if self._blocks is not None else self.nodes(kinds=[kind] if kind else None)).where("depth = 0")
        return rows.where(F.col("kind") == kind) if kind else rows

    def headings(self, level: int | None = None) -> DataFrame:
        rows = self.top("heading")
        return rows.where(F.col("level") == level) if level else rows

    def count(self, kind: str | None = None) -> DataFrame:
        """(doc_id, kind, n) of top-level blocks."""
        return self.top(kind).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))

    def nth(self, kind: str, n: int) -> DataFrame:
        """The n-th (from 0) top-level block of a kind in each document; ``block`` counts all kinds."""
        rows = self.top(None if kind == "block" else kind)
        order = Window.partitionBy("doc_id").orderBy("top_index")
        return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == n + 1).drop("_n")

    def links(self) -> DataFrame:
        """Links directly in paragraphs and headings, also in quotes and list items, in document order."""
        rows = self.nodes("inlines", kinds=["link"]).where("kind = 'link' and depth = 0 and block_kind in ('paragraph', 'heading') and not in_footnote")
        return rows.select("doc_id", "block_id", "inline_id", "text", "url", "title", "link_type")

    def paragraphs_with(self, inline_kind: str) -> DataFrame:
        """Top-level paragraphs with an inline of the kind as a direct child, tested in the parse."""
        return self.nodes(kinds=["paragraph"], test=lambda b: any(i.kind == inline_kind for i in b.inlines)).where("depth = 0")

    def text_at(self, path: str) -> DataFrame:
        """(doc_id, text) of ``heading[N]``, N counting all top-level blocks from 0."""
        docs = self.docs.where("parse_error is null")
        found = parsing.of_document(F.col(self.text_column()), lambda d: d.text_at(path), skip_frontmatter=self.strip != "cli")
        return docs.select("doc_id", found.alias("text")).where("text is not null")

    def changed(self, known: DataFrame) -> DataFrame:
        """Documents whose (path, content_hash) is not in ``known``."""
        from quire.operators.incremental import pending

        return pending(self.docs, known, ["path", "content_hash"])
