"""Running a Markdown specification's examples: cases as rows, results per section and in all."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.core.blocks import parse
from quire.render import html

CASES = "example int, section string, start_line int, end_line int, markdown string, html string"
_FENCE = "`" * 32


def spec_cases(text: str) -> list[tuple]:
    """The examples of a specification text: fences of 32 back-ticks marked ``example``, Markdown and
    HTML parted by a line with a full stop, arrows for tabs, sections by the headings before them."""
    out, section, lines = [], "", text.replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.startswith(_FENCE) and "example" in line:
            end = next((k for k in range(i + 1, len(lines)) if lines[k].startswith(_FENCE)), len(lines))
            body = lines[i + 1 : end]
            cut = body.index(".") if "." in body else len(body)
            texts = ["".join(x + "\n" for x in part).replace("→", "\t") for part in (body[:cut], body[cut + 1 :])]
            out.append((len(out) + 1, section, i + 1, end + 1, *texts))
            i = end
        else:
            m = re.match(r"#{1,6} +(.*?) *#*$", line)
            section = m[1] if m else section
        i += 1
    return out


def normalize_html(s: str) -> str:
    """HTML with white space that means nothing taken out, except inside preformatted text."""
    parts = re.split(r"(<pre\b.*?</pre>)", s, flags=re.S)
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"(^|>)\s+(?=<|$)", r"\1", re.sub(r"\s+", " ", parts[k]))
    return "".join(parts).strip()


def run(cases: DataFrame, gfm: bool = True, normalize: bool = True) -> DataFrame:
    """The cases with ``actual`` and ``passed``; a parser failure is a failed case, not a failed job."""

    @F.pandas_udf("struct<actual: string, passed: boolean>")
    def check(sources: pd.Series, expected: pd.Series) -> pd.DataFrame:
        rows = []
        for s, e in zip(sources, expected):
            try:
                actual = html.render(parse(s or "", gfm, skip_frontmatter=False))
            except Exception as error:  # noqa: BLE001
                actual = f"{type(error).__name__}: {error}"
            same = normalize_html(actual) == normalize_html(e or "") if normalize else actual == (e or "")
            rows.append((actual, same))
        return pd.DataFrame(rows, columns=["actual", "passed"])

    return cases.withColumn("_r", check("markdown", "html")).select("*", "_r.*").drop("_r")


def summary(results: DataFrame) -> DataFrame:
    """(section, passed, total), with a row of a null section for all."""
    return results.rollup("section").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total")).orderBy(F.col("section").asc_nulls_last())


def run_file(spark: SparkSession, path: str, gfm: bool = True) -> DataFrame:
    """The summary of a specification file."""
    with open(path, encoding="utf-8") as f:
        return summary(run(spark.createDataFrame(spec_cases(f.read()), CASES), gfm))
