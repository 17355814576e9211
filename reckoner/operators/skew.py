"""A few keys holding most records: find them, and keep them from making a few tasks run far longer than the rest.

Heavy keys are found with Spark's mergeable frequent-items sketch and confirmed by an exact count of the few
candidates. Per-key work then splits: rows of heavy keys stay where they are and meet their side by broadcast
(the number of heavy keys is bounded by 1 / share), all other keys are shuffled as usual, and the parts are united.

Null keys are no keys: they are never heavy, and joins keep or drop them as Spark's own join does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

LEAST_SHARE = 2e-4  # smaller shares would ask the sketch for more than 1,000,000 items


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n, n_all): the keys that hold at least `share` of all rows of df, null keys counting among all rows.

    The sketch tracks far more items than 1 / share, so its error is far below share and no heavy key is missed;
    candidates down to half the share are counted exactly over a broadcast of at most 4 / share keys.
    """
    if not LEAST_SHARE <= share <= 1:
        raise ValueError(f"share lies between {LEAST_SHARE} and 1")
    k = max(8, math.ceil(4 / share))
    tracked = max(10_000, 50 * k)
    rows = df.select(F.col(key).alias(key))
    top = rows.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("top"))
    candidates = top.select(F.explode("top").alias("t")).select(F.col(f"t.item").alias(key))
    n_all = rows.agg(F.count(F.lit(1)).alias("n_all"))
    exact = rows.join(F.broadcast(candidates), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return exact.crossJoin(F.broadcast(n_all)).where(F.col("n") >= F.col("n_all") * F.lit(share))


def split_heavy(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy keys, all other rows); heavy holds the bounded list of heavy_keys()."""
    h = F.broadcast(heavy.select(key))
    return df.join(h, key, "left_semi"), df.join(h, key, "left_anti")


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, how: str = "inner", max_rows: int = 200_000) -> DataFrame:
    """left join right on key, left being the side with the heavy keys.

    Rows of heavy keys meet the matching rows of right by broadcast, as long as those are at most max_rows
    (beyond that Spark joins them by shuffle and splits the skewed partitions); other keys join by shuffle.
    """
    if how not in ("inner", "left"):
        raise ValueError("skew_join knows inner and left joins")
    heavy = cut(heavy_keys(left, key, share))  # at most 1 / share rows, used four times
    on, off = split_heavy(left, key, heavy)
    right_on = cut(right.join(F.broadcast(heavy.select(key)), key, "left_semi"))
    return on.join(broadcast_if_small(right_on, max_rows), key, how).unionByName(off.join(right, key, how))


def salted_counts(df: DataFrame, keys: list[str], aggs: list[Column], merge: list[Column]) -> DataFrame:
    """Aggregate in two steps, by keys and salt and then by keys alone, so no task gets all rows of a hot key.

    aggs are the partial aggregates; merge combines them under their aliases.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    return df.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*aggs).groupBy(*keys).agg(*merge)
