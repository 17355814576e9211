"""Ordered classification (first match wins) and accounting in exclusive, zero-filled, conserving buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rungs = list[tuple[str, Column]]


def ladder(rungs: Rungs, default: str) -> Column:
    """The name of the first rung whose predicate is true; null predicates don't match; else default."""
    c = F
    for name, predicate in rungs:
        c = c.when(predicate, name)
    return c.otherwise(default)


def bucket_totals(df: DataFrame, bucket: Column, declared: list[str], expected: Column | None = None, unaccounted: str | None = None) -> DataFrame:
    """(bucket, n): a row for each declared bucket, empty ones with 0.

    expected, an aggregate over df, tells how many rows there should be; what is missing is added to `unaccounted`.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(i, b) for i, b in enumerate(declared)], "ord int, bucket string")
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    out = names.join(counts, "bucket", "left").select("ord", "bucket", F.coalesce("c", F.lit(0)).alias("n"))
    if expected is not None:
        gap = df.agg(F.greatest(expected - F.count(F.lit(1)), F.lit(0)).alias("gap"))
        out = out.crossJoin(F.broadcast(gap)).withColumn("n", F.col("n") + F.when(F.col("bucket") == unaccounted, F.col("gap")).otherwise(0)).drop("gap")
    return out.select("bucket", "n")


def crosstab(df: DataFrame, keys: list[str], bucket: Column, declared: list[str]) -> DataFrame:
    """One row per key and one count column per declared bucket."""
    return df.withColumn("_b", bucket).groupBy(*keys).agg(*[F.count_if(F.col("_b") == b).alias(b.lower()) for b in declared])


def conserve(parts: DataFrame, whole: DataFrame, column: str = "n") -> DataFrame:
    """(parts, whole, holds): whether the counts in parts sum to the rows of whole; a row to assert on, not an action."""
    a, b = parts.agg(F.coalesce(F.sum(column), F.lit(0)).alias("parts")), whole.agg(F.count(F.lit(1)).alias("whole"))
    return a.crossJoin(b).withColumn("holds", F.col("parts") == F.col("whole"))
