"""Consensus from several annotators' labels by triplet moments.

Model: on a task, annotator i knows the answer with probability a_i and otherwise answers from an own habit q_i.
Agreement of i and j corrected for chance is then a_i * a_j, so any triplet gives a_i^2 = e_ij * e_ik / e_jk; the
weighted median over triplets is taken. Pairs that agree far more than the better of them knows depend on each other
(one copies the other) and share one vote. Votes are combined by log-odds weights log((a + (1 - a) q_label) / ((1 - a) q_label)),
so a label that an annotator gives by habit weighs little.

Input of the model is (item, task, annotator, label), at most one row for each item, task and annotator. Null
labels, annotators, items are no marks. Ties are broken by the smaller label. Empty tables give empty results.
An annotator that stands in no triplet (fewer than two partners that agree beyond chance) gets the median of the task.

Marks are shuffled once, by site, and all that follows per item stays where it is. The model's size is pairs of annotators that share items times
labels, never items. All triplets count, whatever their number: beyond a counted bound they are gone through in blocks of annotators (triplets.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import broadcast_if_small, cut
from .triplets import medians

MAX_WEIGHTS = 200_000  # rows (annotator, label) of the model up to which it is broadcast
DEPENDENT = 0.25  # excess agreement from which a pair counts as dependent


def latest_marks(annotation: DataFrame) -> DataFrame:
    """Each annotator's latest record for each site: (annotator, site_id, api, fate, verdicts, reason).

    site_id and is_api_use are compared without case and outer blanks; the fate is its sorted distinct members
    joined by +, null if empty; ties in annotated_at go to the later load and then the greater ann_id.
    """
    site, api = F.lower(strip(F.col("site_id"))), F.upper(strip(F.col("is_api_use")))
    fate = F.array_join(F.array_sort(F.array_distinct(F.array_compact("value_fate"))), "+")
    mark = F.struct(
        F.when(api != "", api).alias("api"), F.when(fate != "", fate).alias("fate"),
        F.col("constraint_verdicts").alias("verdicts"), strip(F.col("applicable_reason")).alias("reason"),
    )
    order = F.struct(F.col("annotated_at"), F.col("loaded_at"), F.col("ann_id"))
    rows = annotation.where(F.col("pass_name").isNotNull() & (site != "")).select(F.col("pass_name").alias("annotator"), site.alias("site_id"), mark.alias("m"), order.alias("o"))
    # A site has few rows; one shuffle by site serves the records, the items and the labels.
    return rows.repartition("site_id").groupBy("annotator", "site_id").agg(F.max_by("m", "o").alias("m")).select("annotator", "site_id", "m.*")


def task_marks(latest: DataFrame) -> DataFrame:
    """(site_id, task, field, annotator, label): is_api_use, value_fate, the reason, and one item per constraint id.

    All constraint ids share one task, so reliability is estimated over all of them; a verdict given by domain is MIXED.
    """
    one = lambda task, field, label: F.struct(F.lit(task).alias("task"), field.alias("field"), label.alias("label"))
    verdict = lambda v: F.when(F.size(F.coalesce(F.map_keys(v["by_domain"]), F.array())) > 0, "MIXED").otherwise(v["scalar"])
    reason = F.when((F.col("api") == "YES") & (F.col("reason") != "") & (F.col("reason") != "NA"), F.col("reason"))
    constraints = F.transform(F.map_entries("verdicts"), lambda e: one("constraint", e["key"], verdict(e["value"])))
    marks = F.concat(
        F.array(one("is_api_use", F.lit("is_api_use"), F.col("api")), one("value_fate", F.lit("value_fate"), F.col("fate")), one("reason", F.lit("reason"), reason)),
        F.coalesce(constraints, F.array().cast("array<struct<task:string,field:string,label:string>>")),
    )
    return latest.select("site_id", "annotator", F.explode(F.filter(marks, lambda m: m["label"].isNotNull())).alias("m")).select("site_id", "m.task", "m.field", "annotator", "m.label")


def items_of(marks: DataFrame) -> DataFrame:
    """(site_id, field, task, votes): the marks of an item as an array, at most one per annotator."""
    return marks.groupBy("site_id", "field", "task").agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("votes"))


def reliability(items: DataFrame, partners: int | None = None) -> DataFrame:
    """(task, annotator, label, knows, habit, prior, share): the fitted model, one row per annotator and label.

    knows is a_i, habit is q_i(label), prior the share of the label among true answers, share the part of a vote
    that is left to the annotator after dependence on others. All triplets count, unless a caller asks for the
    `partners` with most shared items of each annotator.
    """
    several = items.where(F.size("votes") > 1)
    pairs = several.select("task", F.explode(F.expr(
        "flatten(transform(votes, (x, i) -> transform(filter(votes, (y, j) -> j > i), y -> struct(x.annotator as i, y.annotator as j, int(x.label = y.label) as same))))"
    )).alias("p")).groupBy("task", "p.i", "p.j").agg(F.count(F.lit(1)).alias("n"), F.sum("p.same").alias("same"))
    counts = several.select("task", F.explode("votes").alias("v")).groupBy("task", "v.annotator", "v.label").agg(F.count(F.lit(1)).alias("c"))
    pairs, counts = cut(pairs), cut(counts)
    w = Window.partitionBy("task", "annotator")
    marginal = counts.withColumn("m", F.col("c") / F.sum("c").over(w))
    # Chance agreement of the pairs that share items: the labels of one, then those that the other has too.
    mi, mj = marginal.select("task", F.col("annotator").alias("i"), "label", F.col("m").alias("mi")), marginal.select("task", F.col("annotator").alias("j"), "label", F.col("m").alias("mj"))
    chance = pairs.join(mi, ["task", "i"]).join(mj, ["task", "j", "label"]).groupBy("task", "i", "j").agg(F.sum(F.col("mi") * F.col("mj")).alias("chance"))
    e = (
        pairs.join(chance, ["task", "i", "j"], "left")
        .withColumn("e", (F.col("same") / F.col("n") - F.coalesce("chance", F.lit(0.0))) / F.greatest(1 - F.coalesce("chance", F.lit(0.0)), F.lit(0.02)))
        .select("task", "i", "j", "e", "n")
    )
    e = cut(e.unionByName(e.select("task", F.col("j").alias("i"), F.col("i").alias("j"), "e", "n")))
    # Dependent pairs bend the triplets they are in: find them with a first estimate, solve without them, find them again.
    dependent = e.select("task", "i", "j").limit(0)
    for _ in range(2):
        knows = _knows(e, dependent.select("task", "i", "j"), partners)
        dependent = cut(_dependence(e, knows).where(F.col("excess") >= DEPENDENT))
    knows = cut(_knows(e, dependent.select("task", "i", "j"), partners))
    share = dependent.groupBy("task", "i").agg((1 / (1 + F.sum(F.least("excess", F.lit(1.0))))).alias("share"))
    mean = knows.withColumn("w", F.col("knows") / (1.02 - F.col("knows")))
    prior = (
        marginal.join(mean.withColumnRenamed("i", "annotator"), ["task", "annotator"]).groupBy("task", "label").agg(F.sum(F.col("m") * F.col("w")).alias("p"))
        .withColumn("prior", F.greatest(F.col("p") / F.sum("p").over(Window.partitionBy("task")), F.lit(1e-4))).select("task", "label", "prior")
    )
    # An annotator in no triplet gets the median of the task.
    typical = knows.groupBy("task").agg(F.median("knows").alias("typical"))
    grid = counts.select("task", "annotator").distinct().join(prior, "task")
    own = marginal.select("task", "annotator", "label", "m")
    knows, share = knows.withColumnRenamed("i", "annotator"), share.withColumnRenamed("i", "annotator")
    return (
        grid.join(own, ["task", "annotator", "label"], "left").join(knows, ["task", "annotator"], "left").join(share, ["task", "annotator"], "left").join(typical, "task", "left")
        .withColumn("knows", F.least(F.coalesce("knows", "typical", F.lit(0.5)), F.lit(0.98)))
        .withColumn("habit", F.greatest((F.coalesce("m", F.lit(0.0)) - F.col("knows") * F.col("prior")) / (1 - F.col("knows")), F.lit(0.01)))
        .withColumn("share", F.coalesce("share", F.lit(1.0)))
        .select("task", "annotator", "label", "knows", "habit", "prior", "share")
    )


def _knows(e: DataFrame, without: DataFrame, partners: int | None) -> DataFrame:
    """(task, i, knows): the weighted median over the triplets of each annotator, pairs in `without` left out."""
    e = e.join(without, ["task", "i", "j"], "left_anti")
    near = e if partners is None else e.withColumn("_r", F.row_number().over(Window.partitionBy("task", "i").orderBy(F.desc("n"), "j"))).where(F.col("_r") <= partners).drop("_r")
    return medians(near, e)


def _dependence(e: DataFrame, knows: DataFrame) -> DataFrame:
    """(task, i, j, excess): agreement beyond the knowledge of the better of the two, which independent annotators can't reach."""
    x = e.join(knows.select("task", "i", F.col("knows").alias("ai")), ["task", "i"]).join(knows.select("task", F.col("i").alias("j"), F.col("knows").alias("aj")), ["task", "j"])
    better = F.greatest("ai", "aj")
    return x.select("task", "i", "j", F.greatest((F.col("e") - better) / F.greatest(1 - better, F.lit(0.05)), F.lit(0.0)).alias("excess"))


def consensus(items: DataFrame, model: DataFrame) -> DataFrame:
    """(site_id, field, task, label, score, confidence, n_votes, n_labels, agreement).

    agreement is the share of agreeing pairs of marks; confidence the posterior share of the label among those voted.
    """
    weight = F.col("share") * F.log((F.col("knows") + (1 - F.col("knows")) * F.col("habit")) / ((1 - F.col("knows")) * F.col("habit")))
    weights = model.select("task", "annotator", "label", weight.alias("w"), F.log("prior").alias("lp"))
    votes = items.repartition("site_id").select("site_id", "field", "task", F.size("votes").alias("n_votes"), F.explode("votes").alias("v")).select("site_id", "field", "task", "n_votes", "v.annotator", "v.label")
    marks = (
        votes.join(broadcast_if_small(weights, MAX_WEIGHTS), ["task", "annotator", "label"], "left")
        .groupBy("site_id", "field", "task", "n_votes").agg(F.collect_list(F.struct("label", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("lp", F.lit(-9.0)).alias("lp"))).alias("m"))
    )
    # An item has at most one mark per annotator, so its labels are scored within the row.
    own = lambda x: F.filter("m", lambda y: y["label"] == x)
    score = lambda ms: F.aggregate(F.array_sort(F.transform(ms, lambda y: y["w"])), F.lit(0.0), lambda acc, w: acc + w) + F.array_max(F.transform(ms, lambda y: y["lp"]))
    labels = F.transform(F.array_distinct(F.transform("m", lambda y: y["label"])), lambda x: F.struct((-score(own(x))).alias("cost"), x.alias("label"), F.size(own(x)).alias("n")))
    best = marks.withColumn("ls", labels).withColumn("b", F.array_min("ls"))
    total = F.aggregate("ls", F.lit(0.0), lambda acc, x: acc + F.exp(F.col("b.cost") - x["cost"]))
    agreeing = F.aggregate("ls", F.lit(0), lambda acc, x: acc + x["n"] * (x["n"] - 1))
    return best.select(
        "site_id", "field", "task", F.col("b.label").alias("label"), (-F.col("b.cost")).alias("score"), (1 / total).alias("confidence"), "n_votes", F.size("ls").alias("n_labels"),
        F.try_divide(agreeing, F.col("n_votes") * (F.col("n_votes") - 1)).alias("agreement"),
    )


def label_sites(annotation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(consensus per item, model) of an annotation table.

    value_fate and constraint items are kept where the consensus of is_api_use is YES, constraint items only if
    their id belongs to the consensus reason of the site (id R<code>_C<n> for reason <code>.<m>).
    """
    items = cut(items_of(task_marks(latest_marks(annotation))))
    model = cut(reliability(items))
    labels = consensus(items, model)
    site = Window.partitionBy("site_id")  # the few items of a site, which lie together
    labels = labels.withColumn("api", F.max(F.when(F.col("task") == "is_api_use", F.col("label"))).over(site)).withColumn("reason", F.max(F.when(F.col("task") == "reason", F.col("label"))).over(site))
    stem = F.concat(F.lit("R"), F.substring_index("reason", ".", 1), F.lit("_"))
    kept = labels.where(F.col("task") != "reason").where(
        (F.col("task") == "is_api_use") | ((F.col("api") == "YES") & ((F.col("task") == "value_fate") | F.col("field").startswith(stem)))
    )
    return kept.drop("api", "reason"), model
