"""Queries of the training-data problems p2, p3, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..session import cut
from . import consensus, leakage, mixing, residue, sampling


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    labels, _ = consensus.label_sites(table(spark, d, "annotation"))
    return labels.where("n_votes >= 3 and n_labels > 1").select("site_id", "field", "label")


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The label of every item, its agreement and confidence."""
    return consensus.label_sites(table(spark, d, "annotation"))[0]


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    """How reliable each pass is on each task: share of answers known, expected accuracy, part of a vote."""
    items = consensus.items_of(consensus.task_marks(consensus.latest_marks(table(spark, d, "annotation"))))
    m = consensus.reliability(items)
    return m.groupBy("task", "annotator").agg(
        F.round(F.max("knows"), 4).alias("knows"), F.round(F.max("knows") + (1 - F.max("knows")) * F.sum(F.col("prior") * F.least("habit", F.lit(1.0))), 4).alias("accuracy"), F.round(F.max("share"), 4).alias("vote_share")
    )


def _quotas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    usable = sampling.usable_repos(table(spark, d, "targets"))
    return usable, sampling.quotas(usable, table(spark, d, "draw_quota"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _quotas(spark, d)[1].where("short > 0").select("frame", "linkage")


def p3_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Target, floor, usable repos, seats and shortfall of every row of draw_quota."""
    return _quotas(spark, d)[1].drop("linkage_key")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(*_quotas(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("doc_id", "item_id").distinct()


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """Per document and leaked item: longest verbatim match, passage, edits and place."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents it leaked into."""
    hits = p6_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(hits, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without the documents that items leaked into."""
    return table(spark, d, "documents").join(p6_found(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan(mixing.source_sizes(table(spark, d, "documents"), mixing.token_count(spark)), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).where("is_short").select("mix_id", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Repeats, shares that the emitted copies reach in tokens, and whether the source falls short."""
    sizes = mixing.document_sizes(table(spark, d, "documents"), mixing.token_count(spark))
    return mixing.reached_shares(sizes, table(spark, d, "mix_targets")).drop("source_key")


def p7_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    """The same with sizes in characters, which SQL can count."""
    sizes = mixing.document_sizes(table(spark, d, "documents"), F.length)
    return mixing.reached_shares(sizes, table(spark, d, "mix_targets")).select("mix_id", "source", "n_docs", "size", F.round("rate", 6).alias("rate"), "emitted", F.round("reached", 6).alias("reached"), "is_short")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix with copy number and size in tokens."""
    sizes = cut(mixing.document_sizes(table(spark, d, "documents"), mixing.token_count(spark)))
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("size"))
    return mixing.mixture(sizes, mixing.plan(per, table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages that are residue, with family and coverage."""
    return residue.find_residue(table(spark, d, "documents")).withColumn("cover", F.round("cover", 4))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without residue documents."""
    return table(spark, d, "documents").join(p8_found(spark, d), "doc_id", "left_anti")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_consensus, p2_reliability, p3_found, p3_quotas, p3_sample, p6_found, p6_matches, p6_items, p6_clean, p7_found, p7_shares, p7_shares_chars, p7_mixture, p8_found, p8_passages, p8_clean)
}

_SPELLING = "nullif(lower(regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '[-\\s]', '_', 'g')), '')"
_USABLE = f"""
WITH u AS (SELECT DISTINCT frame, {_SPELLING.format('linkage')} AS l, nullif(regexp_replace(lower(regexp_replace(repo, '^\\s+|\\s+$', '', 'g')), '(\\.git|/)+$', ''), '') AS r
  FROM targets WHERE trim(sha) <> '' AND state = 'CANDIDATE'),
n AS (SELECT frame, l, count(r) AS available FROM u WHERE l IS NOT NULL GROUP BY ALL)
"""

# Seats by water-filling: between two break points the seats of all categories grow along a line.
_SEATS = _USABLE + """,
q AS (SELECT q.frame, q.linkage, q.share, q.min_seats, q.n_total, coalesce(available, 0) AS cap, CASE WHEN share > 0 THEN share ELSE 0 END AS w FROM draw_quota q LEFT JOIN n ON n.frame = q.frame AND n.l = lower(q.linkage)),
b AS (SELECT *, least(min_seats, cap)::DOUBLE AS lo, (CASE WHEN w > 0 THEN cap ELSE least(min_seats, cap) END)::DOUBLE AS hi FROM q),
g AS (SELECT *, least(greatest(max(n_total) OVER f, sum(lo) OVER f), sum(hi) OVER f) AS goal FROM b WINDOW f AS (PARTITION BY frame)),
bp AS (SELECT DISTINCT frame, unnest([0, lo / w, hi / w]) AS x FROM g WHERE w > 0),
fx AS (SELECT bp.frame, x, max(goal) AS goal, sum(greatest(lo, least(hi, w * x))) AS v, sum(CASE WHEN w * x >= lo - 1e-12 AND w * x < hi - 1e-12 THEN w ELSE 0 END) AS slope FROM bp JOIN g USING (frame) GROUP BY bp.frame, x),
pt AS (SELECT frame, arg_max(x + CASE WHEN slope > 0 THEN (goal - v) / slope ELSE 0 END, x) AS x FROM fx WHERE v <= goal + 1e-9 GROUP BY 1),
e AS (SELECT g.*, coalesce(greatest(lo, least(hi, w * x)), lo) AS exact FROM g LEFT JOIN pt USING (frame)),
s AS (SELECT *, floor(exact + 1e-6) AS s, row_number() OVER (PARTITION BY frame ORDER BY (floor(exact + 1e-6) >= hi), round(exact - floor(exact + 1e-6), 6) DESC, linkage) AS r FROM e),
z AS (SELECT *, CAST(s + CASE WHEN r <= round(goal - sum(s) OVER (PARTITION BY frame)) AND s < hi THEN 1 ELSE 0 END AS BIGINT) AS seats FROM s)
"""

ORACLE = {
    "p3_quotas": _SEATS + """SELECT frame, linkage, round(share * n_total, 6) AS target, min_seats, cap AS available, seats,
  greatest(round(greatest(coalesce(share * n_total, 0), coalesce(min_seats, 0)) - cap, 6), 0) AS short, CAST(max(n_total) OVER (PARTITION BY frame) - sum(seats) OVER (PARTITION BY frame) AS BIGINT) AS frame_gap FROM z""",
    "p3_sample": _SEATS + """, d AS (SELECT u.frame, u.l, u.r, seats, row_number() OVER (PARTITION BY u.frame, u.l ORDER BY sha256('draw-1|' || u.frame || '|' || u.l || '|' || u.r), u.r) AS rank
  FROM u JOIN z ON z.frame = u.frame AND lower(z.linkage) = u.l WHERE u.r IS NOT NULL)
SELECT frame, upper(l) AS linkage, r AS repo, rank FROM d WHERE rank <= seats""",
    "p7_shares_chars": f"""
WITH x AS (SELECT doc_id, {_SPELLING.format('source')} AS source, coalesce(length(text), 0) AS n FROM documents), s AS (SELECT source, count(*) AS n_docs, sum(n) AS size FROM x WHERE source IS NOT NULL GROUP BY 1),
m AS (SELECT mix_id, m.source, weight, max_repeat, coalesce(n_docs, 0) AS n_docs, CAST(coalesce(size, 0) AS BIGINT) AS size, weight * (SELECT sum(n) FROM x) AS wanted FROM mix_targets m LEFT JOIN s USING (source)),
r AS (SELECT *, CASE WHEN size > 0 THEN least(max_repeat, wanted / size) ELSE 0.0 END AS rate FROM m),
c AS (SELECT r.mix_id, r.source, x.n, floor(rate) + CASE WHEN ('0x' || substr(sha1('mix-1|' || r.mix_id || '|' || x.doc_id), 1, 10))::BIGINT / 1099511627776.0 < rate - floor(rate) THEN 1 ELSE 0 END AS k FROM r JOIN x USING (source)),
e AS (SELECT mix_id, source, sum(n * k) AS emitted FROM c GROUP BY ALL), f AS (SELECT r.*, CAST(coalesce(emitted, 0) AS BIGINT) AS emitted FROM r LEFT JOIN e USING (mix_id, source))
SELECT mix_id, source, n_docs, size, round(rate, 6) AS rate, emitted, round(emitted / sum(emitted) OVER (PARTITION BY mix_id), 6) AS reached, max_repeat * size < wanted AS is_short FROM f""",
    "p3_found": _USABLE + "SELECT q.frame, q.linkage FROM draw_quota q LEFT JOIN n ON n.frame = q.frame AND n.l = lower(q.linkage) WHERE coalesce(available, 0) < greatest(min_seats, round(share * n_total, 6))",
    # The cases don't depend on the tokenizer, so sizes in characters give the same rows.
    "p7_found": f"""
WITH s AS (SELECT {_SPELLING.format('source')} AS source, sum(length(text)) AS size FROM documents GROUP BY 1)
SELECT m.mix_id, m.source FROM mix_targets m LEFT JOIN s USING (source)
WHERE m.max_repeat * coalesce(s.size, 0) < m.weight * (SELECT sum(length(text)) FROM documents)""",
}
