"""Inter-rater agreement: closed forms from sufficient statistics, strata, flips and a cluster bootstrap.

Items are rows with an array of marks, one per rater in a fixed order. An absent mark is its own category (NONE or
ABSENT), never dropped. Coefficients that are undefined (one category) are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category(c: Column, none: str = "NONE") -> Column:
    """A mark as a category: null is one of its own."""
    return F.coalesce(c.cast("string"), F.lit(none))


def set_category(c: Column) -> Column:
    """A set as a category: its sorted members in braces."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(c)), ","), F.lit("}"))


def pair_items(df: DataFrame, item: list[str], rater: str, mark: Column, raters: list) -> DataFrame:
    """(item, marks): items that all the given raters marked; one mark per item and rater is expected (the least counts)."""
    at = {r: F.min(F.when(F.col(rater) == r, mark)) for r in raters}
    wide = df.where(F.col(rater).isin(raters)).groupBy(*item).agg(*[c.alias(f"_m{i}") for i, c in enumerate(at.values())])
    return wide.dropna(subset=[f"_m{i}" for i in range(len(raters))]).select(*item, F.array(*[f"_m{i}" for i in range(len(raters))]).alias("marks"))


def coefficients(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, k, po, fleiss, ac1, pabak) for items with two or more marks each, m being the same within a group.

    Items are first counted by their marks, a few rows; agreeing pairs and the count of each category follow from these.
    """
    items = items.groupBy(*by, "marks").agg(F.count(F.lit(1)).alias("_n"))
    m = F.size("marks")
    cats = F.array_distinct("marks")
    same = F.aggregate(cats, F.lit(0), lambda a, c: a + F.pow(F.size(F.filter("marks", lambda x: x == c)), 2).cast("int"))
    po = (same - m) / (m * (m - 1))
    per = items.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(po * F.col("_n")) / F.sum("_n")).alias("po")).where("n > 0")
    counts = items.select(*by, "_n", F.explode("marks").alias("cat")).groupBy(*by, "cat").agg(F.sum("_n").alias("c"))
    tot = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    x = per.join(tot, by) if by else per.crossJoin(tot)
    pe = F.col("ss") / (F.col("t") * F.col("t"))
    ac = F.try_divide(1 - pe, F.col("k") - 1)
    fleiss = F.when(F.col("k") > 1, F.try_divide(F.col("po") - pe, 1 - pe))
    ac1 = F.when(F.col("k") == 1, 1.0).otherwise(F.try_divide(F.col("po") - ac, 1 - ac))
    pabak = F.when(F.col("k") > 1, (F.col("k") * F.col("po") - 1) / (F.col("k") - 1))
    return x.select(*by, "n", "k", F.round("po", 6).alias("po"), F.round(fleiss, 6).alias("fleiss"), F.round(ac1, 6).alias("ac1"), F.round(pabak, 6).alias("pabak"))


def cohen(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, cohen): Cohen's coefficient of the first two marks, each rater with own marginals."""
    a, b = F.col("marks")[0], F.col("marks")[1]
    per = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((a == b).cast("int")).alias("po"))
    x = items.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("r"), a.alias("cat")), F.struct(F.lit(1).alias("r"), b.alias("cat")))).alias("e"))
    c = x.groupBy(*by, "e.cat").agg(F.count_if(F.col("e.r") == 0).alias("ca"), F.count_if(F.col("e.r") == 1).alias("cb")).groupBy(*by).agg(F.sum(F.col("ca") * F.col("cb")).alias("s"))
    pe = F.col("s") / (F.col("n") * F.col("n"))
    j = per.join(c, by) if by else per.crossJoin(c)
    return j.select(*by, "n", F.round(F.when(pe < 1, (F.col("po") - pe) / (1 - pe)), 6).alias("cohen"))


def confusion(items: DataFrame, top: int | None, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, n): the most frequent unequal pairs of the first two marks (all without top), ties by marks."""
    by = by or []
    n = items.select(*by, F.col("marks")[0].alias("a"), F.col("marks")[1].alias("b")).where("a <> b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return n if top is None else n.orderBy(F.desc("n"), *by, "a", "b").limit(top)


def cluster_bootstrap(items: DataFrame, cluster: str, replicates: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """(by, replicate, po, fleiss): agreement of two raters with whole clusters drawn with replacement.

    Items are first reduced to one row per cluster and category. Cluster u of replicate b gets weight
    Poisson(1) by a seeded hash, the usual bootstrap where clusters are many and lie on many tasks: each
    cluster decides alone, no draw looks at all clusters.
    """
    by = by or []
    a, b = F.col("marks")[0], F.col("marks")[1]
    per = items.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum((a == b).cast("int")).alias("same"))
    cats = items.select(*by, cluster, F.explode("marks").alias("cat")).groupBy(*by, cluster, "cat").agg(F.count(F.lit(1)).alias("c"))
    stat = per.join(cats.groupBy(*by, cluster).agg(F.map_from_entries(F.collect_list(F.struct("cat", "c"))).alias("cats")), [*by, cluster])
    u = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(seed), "replicate", F.col(cluster))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rep = stat.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # The distribution function of Poisson(1).
    weight = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.99634, 4).otherwise(5)
    rep = rep.withColumn("w", weight).where("w > 0")
    total = rep.groupBy(*by, "replicate").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("same")).alias("same"))
    per_cat = rep.select(*by, "replicate", "w", F.explode("cats").alias("cat", "c")).groupBy(*by, "replicate", "cat").agg(F.sum(F.col("w") * F.col("c")).alias("c"))
    ss = per_cat.groupBy(*by, "replicate").agg(F.sum(F.col("c") * F.col("c")).alias("ss"))
    po, pe = F.col("same") / F.col("n"), F.col("ss") / (4 * F.col("n") * F.col("n"))
    return total.join(ss, [*by, "replicate"]).select(*by, "replicate", F.round(po, 6).alias("po"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("fleiss"))


def rater_pairs(df: DataFrame, item: list[str], rater: str, mark: Column, cluster: Column | None = None) -> DataFrame:
    """(rater_a, rater_b, item, marks, cluster): every two raters of every item, in order of name; an item gives at most raters squared.

    One mark per item and rater is expected (the least counts); a null mark is none. The cluster is that of rater_a's row.
    """
    one = df.where(F.col(rater).isNotNull() & mark.isNotNull()).groupBy(*item, rater).agg(F.min(F.struct(mark.alias("m"), (F.lit(None).cast("string") if cluster is None else cluster).alias("c"))).alias("_x"))
    all_of = one.groupBy(*item).agg(F.array_sort(F.collect_list(F.struct(F.col(rater).alias("r"), F.col("_x.m").alias("m"), F.col("_x.c").alias("c")))).alias("_l")).where(F.size("_l") > 1)
    pairs = F.flatten(F.transform("_l", lambda x, i: F.transform(F.slice("_l", i + 2, F.size("_l")), lambda y: F.struct(x["r"].alias("rater_a"), y["r"].alias("rater_b"), F.array(x["m"], y["m"]).alias("marks"), x["c"].alias("cluster")))))
    return all_of.select(*item, F.explode(pairs).alias("_p")).select("_p.rater_a", "_p.rater_b", *item, "_p.marks", "_p.cluster")


def field_marks(latest: DataFrame, item: str, rater: str) -> DataFrame:
    """(field, item, rater, mark, universe): a row per record and rated field of an annotation table with one record per item and rater.

    universe names the items that a field is rated on: ALL, SOME_YES (not every rater of the item says NO), ALT (some record is of that class) or
    ALL_YES. An absent mark is a category of its own.
    """
    api = category(F.col("is_api_use"))
    fate, escape = set_category(F.coalesce("value_fate", F.array().cast("array<string>"))), F.when(F.col("escape_info").isNull(), "NO_ESCAPE").otherwise(
        F.concat_ws("|", category(F.col("escape_info.kind")), category(F.col("escape_info.value")))
    )
    one = lambda name, universe, mark: F.struct(F.lit(name).alias("field"), F.lit(universe).alias("universe"), mark.alias("mark"))
    scalar = lambda c: category(F.col(c))
    fields = [one("is_api_use", "ALL", api), *[one(c, "ALL", scalar(c)) for c in ("operation", "unit_role", "declaring_unit")]]
    layers = {"applicable_reason": scalar("applicable_reason"), "value_fate": fate, "escape": escape}
    fields += [one(c, "SOME_YES", m) for c, m in layers.items()] + [one(c, "ALT", scalar(c)) for c in ("alt_equivalence", "exceeds_all_reasons")]
    fields += [one(f"{c}|bothYES", "ALL_YES", m) for c, m in ({"operation": scalar("operation")} | layers).items()]
    return latest.select(item, rater, api.alias("_api"), F.col("site_class").alias("_class"), F.explode(F.array(*fields)).alias("f")).select(item, rater, "_api", "_class", "f.*")


def pair_fields(latest: DataFrame, item: str, rater: str) -> DataFrame:
    """(rater_a, rater_b, field, item, marks): every two raters of an item on every field, within the field's universe for these two."""
    marks = field_marks(latest, item, rater)
    row = F.struct(F.col(rater).alias("r"), F.col("mark").alias("m"), F.col("_api").alias("api"), F.col("_class").alias("c"))
    lists = marks.groupBy(item, "field", "universe").agg(F.array_sort(F.collect_list(row)).alias("l")).where(F.size("l") > 1)
    two = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    p = lists.select(item, "field", "universe", F.explode(two).alias("p")).select(item, "field", "universe", "p.x", "p.y")
    x, y = F.col("x"), F.col("y")
    inside = (
        F.when(F.col("universe") == "SOME_YES", ~((x["api"] == "NO") & (y["api"] == "NO"))).when(F.col("universe") == "ALL_YES", (x["api"] == "YES") & (y["api"] == "YES"))
        .when(F.col("universe") == "ALT", F.coalesce(x["c"] == "ALT", F.lit(False)) | F.coalesce(y["c"] == "ALT", F.lit(False))).otherwise(F.lit(True))
    )
    return p.where(inside).select(x["r"].alias("rater_a"), y["r"].alias("rater_b"), "field", item, F.array(x["m"], y["m"]).alias("marks"))


def only_in_one(latest: DataFrame, item: str, rater: str) -> DataFrame:
    """(rater, n_items, n_alone): the items of each rater, and those that no other rater has."""
    per = latest.groupBy(item).agg(F.collect_set(rater).alias("_r"))
    return per.select(F.explode("_r").alias(rater), (F.size("_r") == 1).alias("_one")).groupBy(rater).agg(F.count(F.lit(1)).alias("n_items"), F.count_if("_one").alias("n_alone"))
