"""Reconciling declared with observed sets, identity by content, nearest ancestors and positional copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile_sets(declared: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict): AGREE in both, OVER declared alone, UNDER observed alone; repeated members count once."""
    a = declared.select(*keys).dropna().distinct().withColumn("_d", F.lit(1))
    b = observed.select(*keys).dropna().distinct().withColumn("_o", F.lit(1))
    v = F.when(F.col("_d").isNull(), "UNDER").when(F.col("_o").isNull(), "OVER").otherwise("AGREE")
    return a.join(b, keys, "full").select(*keys, v.alias("verdict"))


def reconcile_content(source: DataFrame, shipped: DataFrame, key: str, content: str) -> DataFrame:
    """(key, verdict): IDENTICAL or DIFFERENT by hash where both tables have the key, else SOURCE_ONLY or SHIPPED_ONLY.

    A key that stands repeatedly is identical if some of its contents are the same on both sides; null contents are the empty content.
    """
    digest = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).alias(name))
    a, b = digest(source, "_a"), digest(shipped, "_b")
    verdict = F.when(F.col("_b").isNull(), "SOURCE_ONLY").when(F.col("_a").isNull(), "SHIPPED_ONLY").when(F.arrays_overlap("_a", "_b"), "IDENTICAL").otherwise("DIFFERENT")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"))


def nearest_ancestor(paths: DataFrame, path: str, owners: DataFrame, owner: str) -> DataFrame:
    """paths with `nearest`: the deepest owner directory that is an ancestor of the path, null if there is none.

    Each path is exploded to its ancestors (as many as it is deep), so the join is an equality.
    """
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    one = paths.select(path).distinct().select(path, F.explode(up).alias("_a"))
    hit = one.join(owners.select(F.col(owner).alias("_a")).distinct(), "_a").groupBy(path).agg(F.max_by("_a", F.length("_a")).alias("nearest"))
    return paths.join(hit, path, "left")


def equal_multiplicity_copies(df: DataFrame, group: list[Column], unit: str, order: list[str], row_id: str) -> DataFrame:
    """(copy_id, original_id): rows of a unit that repeat those of the group's first unit, position by position.

    Only units with as many rows in the group as the first unit are copies; rows without unit or group are none.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    x = df.select(*[g.alias(k) for g, k in zip(group, keys)], F.col(unit).alias("_u"), F.col(row_id).alias("_id"), *order).dropna(subset=[*keys, "_u"])
    first = x.groupBy(*keys).agg(F.min("_u").alias("_first"), F.countDistinct("_u").alias("_units")).where("_units > 1")
    per = x.groupBy(*keys, "_u").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "_u").orderBy(*order, "_id")
    y = x.join(first, keys).join(per, [*keys, "_u"]).withColumn("_pos", F.row_number().over(w))
    rep = y.where("_u = _first").select(*keys, "_pos", F.col("_n").alias("_rep_n"), F.col("_id").alias("original_id"))
    return y.where("_u <> _first").join(rep, [*keys, "_pos"]).where("_n = _rep_n").select(F.col("_id").alias("copy_id"), "original_id")


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of sha1 over the parts joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)
