"""A source of Markdown files that misses none: hidden names and underscores included.

Spark's own file sources skip names that begin with ``_`` or ``.``, and ``_index.md`` is usual.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAX_BYTES = 16 * 1024 * 1024
SCHEMA = "path string, size bigint, content binary, error string"


def local_path(root: str) -> str:
    """A folder as the operating system names it; ``file:`` locations lose their scheme, others are refused."""
    scheme, colon, rest = root.partition(":")
    if scheme == "file" and colon:
        return "/" + rest.lstrip("/")
    if "://" in root:
        raise ValueError(f"{root} is no folder of the file system; mount it, or read a table with a text column")
    return root


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class MarkdownReader(DataSourceReader):
    def __init__(self, options):
        self.root = local_path(options["path"])
        self.suffix = options.get("suffix", ".md")
        self.limit = int(options.get("maxbytes", MAX_BYTES))
        self.group = int(options.get("filespertask", 256))
        self.group_bytes = int(options.get("bytespertask", 64 * 1024 * 1024))

    def partitions(self):
        """Groups of files by number and size; only names and sizes pass through the driver."""
        groups, now, size = [], [], 0
        for folder, folders, names in os.walk(self.root):
            folders.sort()
            for name in sorted(names):
                if name.endswith(self.suffix):
                    path = os.path.join(folder, name)
                    n = os.path.getsize(path)
                    if now and (len(now) >= self.group or size + n > self.group_bytes):
                        groups.append(_Files(now))
                        now, size = [], 0
                    now.append(path)
                    size += n
        return groups + ([_Files(now)] if now else []) or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            size = os.path.getsize(path)
            if size > self.limit:
                yield path, size, None, f"larger than {self.limit} bytes"
                continue
            with open(path, "rb") as f:
                yield path, size, f.read(), None


class _Written(WriterCommitMessage):
    def __init__(self, count: int):
        self.count = count


class MarkdownWriter(DataSourceWriter):
    """One file per row (path, text) below a folder. A repeated task writes the same files again."""

    def __init__(self, options):
        self.root = os.path.abspath(local_path(options["path"]))

    def write(self, rows):
        count = 0
        for row in rows:
            target = os.path.abspath(os.path.join(self.root, row["path"].lstrip("/")))
            if not target.startswith(self.root + os.sep):
                raise ValueError(f"{row['path']} leads out of the target folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.{os.getpid()}.part"
            with open(partial, "w", encoding="utf-8", newline="") as f:
                f.write(row["text"] or "")
            os.replace(partial, target)  # readers see the old file or the new one
            count += 1
        return _Written(count)


class MarkdownSource(DataSource):
    @classmethod
    def name(cls):
        return "quire_markdown"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MarkdownReader(self.options)

    def writer(self, schema, overwrite):
        return MarkdownWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarkdownSource)


def markdown_files(spark: SparkSession, root: str, suffix: str = ".md", **options) -> DataFrame:
    """(path, content) of every file below ``root`` whose name ends with ``suffix``, case-sensitively.
    Files above 16 MiB raise an error in the task that meets them, unless ``keep_errors`` is set."""
    keep = options.pop("keep_errors", False)
    register(spark)
    reader = spark.read.format("quire_markdown").option("suffix", suffix)
    for name, value in options.items():
        reader = reader.option(name, value)
    files = reader.load(root)
    if keep:
        return files
    return files.select("path", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error"))).otherwise(F.col("content")).cast("binary").alias("content"))


def write_markdown(df: DataFrame, root: str, shared: bool = False) -> None:
    """Writes (path, text) rows as files below ``root``.

    Each executor writes through its own file system. On a cluster ``root`` must therefore be in the
    folder that spark.checkpoint.dir names, or ``shared`` must say that all machines have it.
    """
    spark = df.sparkSession
    if not shared and not spark.sparkContext.master.startswith("local["):
        from quire.runtime import shared_dir

        if not os.path.abspath(local_path(root)).startswith(os.path.abspath(local_path(shared_dir(spark))) + os.sep):
            raise ValueError(f"{root} may be a different folder on each machine; say shared=True if it is not")
    register(spark)
    df.select("path", "text").write.format("quire_markdown").mode("append").save(root)


def utf8(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD, as decode() would fail on it."""

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else bytes(v).decode("utf-8", "replace") for v in values], dtype=object)

    return decoded(content)
