"""Relational division, gates with reasons, paired comparison and resolution of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_ok_wins(df: DataFrame, keys: list[str], ok: Column, order: list[Column]) -> DataFrame:
    """One row per key: the last that is ok, else the last; combinable, so a hot key costs one row per task."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.coalesce(ok, F.lit(False)), *order))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("_r")).select("_r.*")


def division(df: DataFrame, keys: list[str], slot: str, slots: list) -> DataFrame:
    """The keys that hold every slot."""
    return df.where(F.col(slot).isin(slots)).groupBy(*keys).agg(F.countDistinct(slot).alias("_n")).where(F.col("_n") == len(slots)).drop("_n")


def missing_slots(df: DataFrame, keys: list[str], slot: str, slots: list) -> DataFrame:
    """(keys, slot): each slot that a key lacks; slots are few and given, so they are exploded and not joined."""
    have = df.groupBy(*keys).agg(F.collect_set(F.when(F.col(slot).isin(slots), F.col(slot))).alias("_have"))
    return have.select(*keys, F.explode(F.array_except(F.array(*[F.lit(s) for s in slots]), "_have")).alias(slot))


def gate(df: DataFrame, keys: list[str], requirements: dict[str, Column]) -> DataFrame:
    """(keys, passed, reasons): reasons lists, in order, the requirements (aggregates) that don't hold; null fails."""
    agg = df.groupBy(*keys).agg(*[F.coalesce(c, F.lit(False)).alias(f"_{n}") for n, c in requirements.items()])
    reasons = F.array_compact(F.array(*[F.when(~F.col(f"_{n}"), n) for n in requirements]))
    return agg.select(*keys, (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def comparable(df: DataFrame, keys: list[str], config: str, base, reason: str, ok: str, equal: dict[str, str]) -> DataFrame:
    """df (one row per key and configuration) with `reason` replaced where a good row can't be compared with the base of its key.

    equal maps a column to the reason if a row differs there from its base, in order; a base without a value, or no base at all, hinders nothing.
    """
    b = df.where(F.col(config) == base).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in equal])
    changed = F
    for c, why in equal.items():
        changed = changed.when(F.col(f"_b_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_b_{c}")), why)
    looked_at = (F.col(reason) == ok) & (F.col(config) != base)
    return df.join(b, keys, "left").withColumn(reason, F.when(looked_at, F.coalesce(changed.otherwise(F.lit(None)), F.col(reason))).otherwise(F.col(reason))).drop(*[f"_b_{c}" for c in equal])


def complete(df: DataFrame, keys: list[str], config: str, required: list, reason: str, ok: str, missing: str) -> DataFrame:
    """(keys, complete, excluded): excluded maps each required configuration that is not ok to its reason; one without a row has the reason `missing`."""
    have = df.where(F.col(config).isin(required)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(config), F.coalesce(F.col(reason), F.lit(missing))))).alias("_have"))
    every = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.coalesce(F.try_element_at("_have", F.lit(c)), F.lit(missing))) for c in required]))
    bad = F.map_filter(every, lambda _, r: r != ok)
    return have.select(*keys, (F.size(bad) == 0).alias("complete"), bad.alias("excluded"))


def paired_compare(df: DataFrame, keys: list[str], config: str, base, metrics: list[str]) -> DataFrame:
    """(keys, config, metric, base_value, value) for metrics of each configuration that differ from the base of its key."""
    entry = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    long = df.select(*keys, config, entry.alias("_e")).select(*keys, config, "_e.metric", F.col("_e.v").alias("value"))
    b = long.where(F.col(config) == base).select(*keys, "metric", F.col("value").alias("base_value"))
    return long.where(F.col(config) != base).join(b, [*keys, "metric"]).where(~F.col("value").eqNullSafe(F.col("base_value"))).select(*keys, config, "metric", "base_value", "value")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The values at index int(share * n) of the sorted values (the last one for 1), per key.

    Ranks come from a count per distinct value, which is combinable, and a window over distinct values.
    """
    from pyspark.sql import Window

    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    c = c.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    index = {name: F.least(F.floor(F.lit(s) * F.col("_n")), F.col("_n") - 1) for name, s in shares.items()}
    hit = {name: F.min(F.when(F.col("_upto") > i, F.col(value))) for name, i in index.items()}
    return c.groupBy(*keys).agg(F.max("_n").alias("n"), *[h.alias(name) for name, h in hit.items()])
