"""Largest-remainder seats, stratified draws, purposive census and quotas with back-fill, all by windows over few strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(weights: DataFrame, keys: list[str], label: str, weight: str, total: Column) -> DataFrame:
    """(keys, label, weight, seats): total seats per key in proportion to weight; remainders largest first, ties by label."""
    w = Window.partitionBy(*keys)
    exact = F.col("_total") * F.col(weight) / F.col("_sum")
    x = weights.withColumn("_total", total).withColumn("_sum", F.sum(weight).over(w)).withColumn("_exact", F.when(F.col("_sum") > 0, exact).otherwise(0.0))
    x = x.withColumn("_floor", F.floor("_exact")).withColumn("_frac", F.round(F.col("_exact") - F.col("_floor"), 9))
    left = F.when(F.col("_sum") > 0, F.col("_total") - F.sum("_floor").over(w)).otherwise(0)
    rank = F.row_number().over(w.orderBy(F.desc("_frac"), label))
    x = x.withColumn("_left", left).withColumn("seats", F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0))
    return x.select(*keys, label, weight, F.col("seats").cast("long").alias("seats"))


def seeded(*parts: Column | str) -> Column:
    """A hash order that depends on the seed and the row alone."""
    return F.sha1(F.concat_ws("|", *parts))


def draw_by_seats(df: DataFrame, seats: DataFrame, keys: list[str], order: list[Column], salts: int = 32) -> DataFrame:
    """The first `seats` rows of each stratum in the given order: first within salted parts, then among those kept."""
    s = df.join(seats.select(*keys, "seats").where("seats > 0"), keys)
    s = s.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    s = s.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where("_r <= seats")
    return s.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r <= seats").drop("_r", "_salt", "seats")


def census(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """df exploded by the reasons that a row meets; rows that meet none are left out."""
    return df.withColumn("reason", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in reasons.items()]))))


def floored_seats(sizes: DataFrame, label: str, size: str, total: int, floor: int) -> DataFrame:
    """(label, size, seats): min(floor, size) seats for each, the rest by largest remainder in proportion to the room that is left.

    A label never gets more than it has, since its share of the room is at most its room. Labels are few beside rows; their number bounds the window.
    The frame is empty if the floors alone ask for more than total; all rows are taken if total exceeds them.
    """
    x = sizes.where(F.col(size) > 0).select(label, size, F.least(F.col(size), F.lit(floor)).cast("long").alias("_low"))
    sums = x.agg(F.coalesce(F.sum("_low"), F.lit(0)).alias("_base"), F.coalesce(F.sum(F.col(size)), F.lit(0)).alias("_all"))
    x = x.crossJoin(F.broadcast(sums)).where(F.col("_base") <= total)
    room = x.withColumn("_room", F.col(size) - F.col("_low"))
    left = F.least(F.lit(total), F.col("_all")) - F.col("_base")
    extra = largest_remainder(room, [], label, "_room", left).select(F.col(label).alias("_l"), F.col("seats").alias("_extra"))
    return room.join(extra, F.col(label) == F.col("_l")).select(label, size, (F.col("_low") + F.col("_extra")).alias("seats"))
