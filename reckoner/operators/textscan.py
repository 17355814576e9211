"""Scanning text by line: lines, merged hits, context windows, citations and evidence shapes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ln, line): the lines of each text from 1; null texts have none, an empty text has one empty line."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("ln", "line")).withColumn("ln", F.col("ln") + 1)


def hits(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with `hits`: array<struct<start, stop, tag>> of merged matches; overlapping ones are one hit with the longest's tag.

    A keyword prefilter should go before: only positions need Python, since Spark's functions give none.
    """
    compiled = [(tag, re.compile(p)) for tag, p in patterns.items()]
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("tag", T.StringType())]))

    @F.pandas_udf(kind)
    def scan(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return []
            found = sorted((m.start(), m.end(), tag) for tag, p in compiled for m in p.finditer(t) if m.end() > m.start())
            out: list[list] = []
            for a, b, tag in found:
                if out and a < out[-1][1]:
                    if b - a > out[-1][3]:
                        out[-1][2:] = [tag, b - a]
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b, tag, b - a])
            return [(a, b, tag) for a, b, tag, _ in out]

        return s.map(one)

    return df.withColumn("hits", scan(text))


def context_windows(all_lines: DataFrame, keys: list[str], hit: Column, around: int) -> DataFrame:
    """(keys, ln, context): for each line that hits, the lines from ln - around to ln + around, in order.

    Each line is sent to the at most 2 * around + 1 windows around it, so no range join is needed.
    """
    at = all_lines.where(hit).select(*keys, F.col("ln").alias("_at"))
    near = all_lines.withColumn("_at", F.explode(F.sequence(F.col("ln") - around, F.col("ln") + around)))
    j = near.join(at, [*keys, "_at"])
    ctx = F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"])
    return j.groupBy(*keys, "_at").agg(ctx.alias("context")).withColumnRenamed("_at", "ln")


def shape(c: Column) -> Column:
    """The shape of an evidence text: figures are #, quoted parts S."""
    return F.regexp_replace(F.regexp_replace(c, r"[\"'`][^\"'`\n]*[\"'`]", "S"), "[0-9]+", "#")


def cited_lines(c: Column) -> Column:
    """The line numbers that a text cites as L<n>."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\bL(\d{1,9})\b"), F.lit(1)), lambda x: x.cast("int"))


def running_depth(all_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with `depth`: the number of braces open before the line."""
    opened = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    w = Window.partitionBy(*keys).orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return all_lines.withColumn("depth", F.coalesce(F.sum(opened).over(w), F.lit(0)))
