"""Samples that match target shares of categories.

Seats are allocated per frame by largest remainder, between a floor (min_seats, or what there is) and a cap (the
usable candidates); what a capped category can't take goes to the others in proportion. A category with a target share of 0 gets
its floor and no more. frame_gap tells by how many seats a frame misses its total: above 0 where caps leave seats unfilled, below 0 where
floors ask for more than the total. The candidates with the smallest seeded hashes are drawn, so a draw depends on neither row order nor partitioning.

Null or empty frames, categories and candidates are not usable. Repeated candidates count once. Categories without
a target are not drawn. Targets without candidates get no seat and are reported. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repo_key, spelling, strip

BUCKET_DIGITS = 3  # hex digits of the hash that make 4,096 ranges


def apportion(share: np.ndarray, floor: np.ndarray, cap: np.ndarray, total: int) -> np.ndarray:
    """Whole seats within [floor, cap] (floors first cut to the caps) that sum to total where caps and floors allow.

    Seats follow clip(share * x) for the x at which they sum to total; the remainders go to the largest fractions,
    ties to the earlier category. A share of 0 takes its floor alone.
    """
    weight = np.where(share > 0, share, 0.0)
    low = np.minimum(floor, cap).astype(float)
    high = np.where(weight > 0, cap, low).astype(float)
    goal = min(max(total, low.sum()), high.sum())
    a, b = 0.0, 1.0
    while np.clip(weight * b, low, high).sum() < goal and b < 1e18:
        b *= 2
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if np.clip(weight * mid, low, high).sum() < goal else (a, mid)
    exact = np.clip(weight * b, low, high)
    seats = np.floor(exact + 1e-6)
    order = np.argsort(-np.round(exact - seats, 6), kind="stable")
    left = int(round(goal - seats.sum()))
    for i in order:
        if left > 0 and seats[i] < high[i]:
            seats[i], left = seats[i] + 1, left - 1
    return seats.astype("int64")


def usable_repos(targets: DataFrame) -> DataFrame:
    """(frame, linkage, repo): distinct candidates, with a sha and in state CANDIDATE, each in one spelling."""
    return (
        targets.where((strip(F.col("sha")) != "") & (strip(F.col("state")) == "CANDIDATE"))
        .select("frame", spelling(F.col("linkage")).alias("linkage"), repo_key(F.col("repo")).alias("repo"))
        .dropna().distinct()
    )


def quotas(usable: DataFrame, draw_quota: DataFrame) -> DataFrame:
    """(frame, linkage, target, min_seats, available, seats, short, frame_gap): one row per row of draw_quota.

    target is share * n_total; short tells by how many the usable repos, which cap the seats, miss the larger of min_seats and target.
    Allocation is one small group per frame: its categories.
    """
    available = usable.groupBy("frame", "linkage").agg(F.count(F.lit(1)).alias("available"))
    q = draw_quota.select("frame", F.col("linkage").alias("label"), spelling(F.col("linkage")).alias("linkage"), "share", "min_seats", "n_total")
    q = q.join(available, ["frame", "linkage"], "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))

    def allocate(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("label", kind="stable")
        total = int(g["n_total"].fillna(0).max())
        seats = apportion(g["share"].fillna(0).to_numpy(), g["min_seats"].fillna(0).to_numpy(), g["available"].to_numpy(), total)
        return g.assign(seats=seats)

    schema = "frame string, label string, linkage string, share double, min_seats int, n_total int, available long, seats long"
    q = q.select("frame", "label", "linkage", "share", "min_seats", "n_total", "available").repartition(q.sparkSession.sparkContext.defaultParallelism, "frame")  # few rows, but work for each frame
    out = q.groupBy("frame").applyInPandas(allocate, schema)
    target = F.col("share") * F.col("n_total")
    frame = Window.partitionBy("frame")
    need = F.greatest(F.coalesce(target, F.lit(0.0)), F.coalesce(F.col("min_seats").cast("double"), F.lit(0.0)))
    return out.select(
        "frame", F.col("label").alias("linkage"), F.col("linkage").alias("linkage_key"), F.round(target, 6).alias("target"), "min_seats", "available", "seats",
        F.greatest(F.round(need - F.col("available"), 6), F.lit(0.0)).alias("short"),
        (F.max(F.coalesce("n_total", F.lit(0))).over(frame) - F.sum("seats").over(frame)).alias("frame_gap"),
    )


def draw(usable: DataFrame, seats: DataFrame, seed: str = "draw-1") -> DataFrame:
    """(frame, linkage, repo, rank): for each category the `seats` candidates with the smallest seeded hashes.

    Hashes fall into BUCKETS ranges in order. Counts per range tell how many candidates stand before each, so ranges beyond the seats are
    left out and ranks need only the order within a range; no task sorts a large category, however many seats it has.
    """
    key = F.sha2(F.concat_ws("|", F.lit(seed), "frame", "linkage", "repo"), 256)
    q = seats.select("frame", F.col("linkage_key").alias("linkage"), "seats").where("seats > 0")
    rows = usable.withColumn("_k", key).withColumn("_bucket", F.substring("_k", 1, BUCKET_DIGITS))
    before = F.sum("_n").over(Window.partitionBy("frame", "linkage").orderBy("_bucket")) - F.col("_n")
    counts = rows.groupBy("frame", "linkage", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before)
    some = counts.join(q, ["frame", "linkage"]).where("_before < seats").drop("_n")
    local = F.row_number().over(Window.partitionBy("frame", "linkage", "_bucket").orderBy("_k", "repo"))
    ranked = rows.join(some, ["frame", "linkage", "_bucket"]).withColumn("rank", F.col("_before") + local).where("rank <= seats")
    return ranked.select("frame", F.upper("linkage").alias("linkage"), "repo", "rank")
