"""Half-open intervals per group: trimming overlaps, locating points, clipped coverage.

Spans are (start, end) longs; spans of size 0 or with nulls are no spans. A hot group sorts within one task, as any
window does; `group` may be a list of columns, so a finer key (unit and file, user and day) keeps groups small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trim_spans(spans: DataFrame, group: list[str], order: str) -> DataFrame:
    """Non-overlapping spans in the order (start, end, order): contained ones dropped, heads cut, `overlapped` marks the cut.

    Equals the sequential rule that keeps a span only beyond the greatest end so far.
    """
    s = spans.where(F.col("end") > F.col("start"))
    w = Window.partitionBy(*group).orderBy("start", "end", order).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_pm", F.max("end").over(w))
    kept = s.where(F.col("_pm").isNull() | (F.col("end") > F.col("_pm")))
    over = F.coalesce(F.col("start") < F.col("_pm"), F.lit(False))
    return kept.withColumn("overlapped", over).withColumn("start", F.greatest("start", "_pm")).drop("_pm")


def overlap_counts(spans: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, n_spans, n_overlaps): how many spans start before the greatest end so far."""
    s = spans.where(F.col("end") > F.col("start"))
    w = Window.partitionBy(*group).orderBy("start", "end", order).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("_o", F.coalesce(F.col("start") < F.max("end").over(w), F.lit(False))).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_spans"), F.count_if("_o").alias("n_overlaps")
    )


def locate(points: DataFrame, spans: DataFrame, group: list[str], at: str, payload: str) -> DataFrame:
    """points with `payload` of the trimmed span that covers `at`, null in a gap: an as-of join by union and window."""
    p = points.select(*group, F.col(at).alias("_at"), F.lit(1).alias("_is_point"), F.lit(None).cast("struct<end:bigint,v:string>").alias("_s"), F.struct(*points.columns).alias("_row"))
    empty = F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType)
    s = spans.select(*group, F.col("start").alias("_at"), F.lit(0).alias("_is_point"), F.struct(F.col("end").cast("long").alias("end"), F.col(payload).cast("string").alias("v")).alias("_s"), empty.alias("_row"))
    w = Window.partitionBy(*group).orderBy("_at", "_is_point").rowsBetween(Window.unboundedPreceding, 0)
    hit = p.unionByName(s).withColumn("_last", F.last("_s", ignorenulls=True).over(w)).where("_is_point = 1")
    return hit.select("_row.*", F.when(F.col("_at") < F.col("_last.end"), F.col("_last.v")).alias("covered_by"))


def clip_coverage(trimmed: DataFrame, group: list[str], low: int, high: int) -> DataFrame:
    """(group, covered): the length of trimmed spans within [low, high)."""
    part = F.greatest(F.least("end", F.lit(high)) - F.greatest("start", F.lit(low)), F.lit(0))
    return trimmed.groupBy(*group).agg(F.sum(part).alias("covered"))
