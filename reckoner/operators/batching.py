"""Partitioning rows into batches and packs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk(df: DataFrame, unit: str, order: list[str], size: int, prefix: int = 8) -> DataFrame:
    """df with `chunk` (from 0 within the unit, at most `size` rows each) and `batch_no`, numbered over units in order.

    Rows without unit form no batch. Rows are ranked within a unit and its first order column alone; where each of these starts follows from their
    counts, so no task sorts a large unit. Units are numbered the same way, by the first `prefix` characters and then within them.
    """
    rows = df.where(F.col(unit).isNotNull())
    first = order[0]
    counts = rows.groupBy(unit, first).agg(F.count(F.lit(1)).alias("_n"))
    start = counts.select(F.col(unit).alias("_u"), F.col(first).alias("_f"), (F.sum("_n").over(Window.partitionBy(unit).orderBy(first)) - F.col("_n")).alias("_start"))
    local = F.row_number().over(Window.partitionBy(unit, first).orderBy(*order))
    rows = rows.withColumn("_r", local).join(start, (F.col(unit) == F.col("_u")) & F.col(first).eqNullSafe(F.col("_f")))
    rows = rows.withColumn("chunk", F.floor((F.col("_start") + F.col("_r") - 1) / size).cast("int")).drop("_r", "_start", "_u", "_f")
    per = counts.groupBy(unit).agg(F.ceil(F.sum("_n") / size).cast("long").alias("_n")).withColumn("_p", F.substring(F.lower(unit), 1, prefix))
    heads = per.groupBy("_p").agg(F.sum("_n").alias("_pn"))
    heads = heads.select("_p", (F.sum("_pn").over(Window.orderBy("_p")) - F.col("_pn")).alias("_head"))  # one row per prefix
    within = F.sum("_n").over(Window.partitionBy("_p").orderBy(F.lower(unit), unit)) - F.col("_n")
    numbered = per.join(heads, "_p").select(F.col(unit), (F.col("_head") + within).alias("_first"))
    return rows.join(numbered, unit).withColumn("batch_no", (F.col("_first") + F.col("chunk") + 1).cast("long")).drop("_first")


def greedy_packs(units: DataFrame, group: str, unit: str, size: str, cap: int, most: int) -> DataFrame:
    """(group, unit, size, pack): units in order fill packs up to `cap` size and `most` units; a unit is never split.

    State resets with every pack, so each group is folded in order in one task; a group holds units, not rows.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(unit, kind="stable")
        pack, held, n, out = 0, 0, 0, []
        for s in g[size].fillna(0).tolist():
            if n and (held + s > cap or n + 1 > most):
                pack, held, n = pack + 1, 0, 0
            held, n = held + s, n + 1
            out.append(pack)
        return g.assign(pack=out)

    return units.select(F.col(group).cast("string").alias(group), unit, F.col(size).cast("long").alias(size)).groupBy(group).applyInPandas(
        fold, f"{group} string, {unit} string, {size} long, pack int"
    )
