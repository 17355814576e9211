"""Queries of the reconciliation, accounting, agreement, sampling and text operators, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import agreement, apportion, batching, gates, guards, intervals, ladders, reconcile, textscan
from .tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function as a query, with its SQL oracle if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- ordered buckets -------------------------------------------------------------------------------------------

ORDER_BUCKETS = ["NO_PRICE", "CLOSED", "OPEN_URGENT", "OPEN_LARGE", "PARTIAL", "OPEN_SMALL", "OTHER"]
_BUCKET_SQL = """CASE WHEN coalesce(o_totalprice, 0) = 0 THEN 'NO_PRICE' WHEN o_orderstatus = 'F' THEN 'CLOSED' WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1-%' THEN 'OPEN_URGENT'
 WHEN o_orderstatus = 'O' AND o_totalprice >= 250000 THEN 'OPEN_LARGE' WHEN o_orderstatus = 'P' THEN 'PARTIAL' WHEN o_orderstatus = 'O' THEN 'OPEN_SMALL' ELSE 'OTHER' END"""


def _order_bucket():
    is_open = F.col("o_orderstatus") == "O"
    return ladders.ladder([
        ("NO_PRICE", F.coalesce("o_totalprice", F.lit(0.0)) == 0), ("CLOSED", F.col("o_orderstatus") == "F"), ("OPEN_URGENT", is_open & F.col("o_orderpriority").startswith("1-")),
        ("OPEN_LARGE", is_open & (F.col("o_totalprice") >= 250000)), ("PARTIAL", F.col("o_orderstatus") == "P"), ("OPEN_SMALL", is_open),
    ], "OTHER")


@query(f"SELECT b.bucket, count(o.x) AS n FROM (SELECT unnest({ORDER_BUCKETS}) AS bucket) b LEFT JOIN (SELECT {_BUCKET_SQL} AS x FROM orders) o ON o.x = b.bucket GROUP BY 1")
def q01_ladder_totals(spark: SparkSession, d: str) -> DataFrame:
    return ladders.bucket_totals(table(spark, d, "orders"), _order_bucket(), ORDER_BUCKETS)


@query(f"""WITH o AS (SELECT *, {_BUCKET_SQL} = 'CLOSED' AS ok FROM orders), c AS (SELECT o_custkey, bool_or(ok) AS ok FROM o GROUP BY 1),
l AS (SELECT ok FROM lineitem JOIN (SELECT o_orderkey, ok FROM o) ON l_orderkey = o_orderkey)
SELECT 'order' AS grain, count(*) AS n, count_if(ok) AS n_ok, round(count_if(ok) / count(*), 6) AS rate FROM o UNION ALL
SELECT 'customer', count(*), count_if(ok), round(count_if(ok) / count(*), 6) FROM c UNION ALL SELECT 'line', count(*), count_if(ok), round(count_if(ok) / count(*), 6) FROM l""")
def q02_grain_rates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (_order_bucket() == "CLOSED").alias("ok"))
    lines = table(spark, d, "lineitem").select("l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("ok")
    rate = [F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("rate")]
    grains = {"order": o, "customer": o.groupBy("o_custkey").agg(F.bool_or("ok").alias("ok")), "line": lines}
    parts = [df.groupBy(F.lit(g).alias("grain")).agg(*rate) for g, df in grains.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT o_orderpriority, " + ", ".join(f"count_if({_BUCKET_SQL} = '{b}') AS {b.lower()}" for b in ORDER_BUCKETS) + " FROM orders GROUP BY 1")
def q03_bucket_by_group(spark: SparkSession, d: str) -> DataFrame:
    return ladders.crosstab(table(spark, d, "orders"), ["o_orderpriority"], _order_bucket(), ORDER_BUCKETS)


@query("""WITH v AS (SELECT site_id, pass_name, unnest(CASE WHEN cardinality(constraint_verdicts) > 0 THEN map_keys(constraint_verdicts) ELSE [NULL] END) AS c, coalesce(cardinality(constraint_verdicts), 0) = 0 AS synth FROM annotation)
SELECT pass_name, c AS constraint_id, synth AS synthesized, count(*) AS n FROM v GROUP BY ALL""")
def q04_legacy_explode(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotation")
    have = F.size(F.coalesce(F.map_keys("constraint_verdicts"), F.array())) > 0
    keys = F.when(have, F.map_keys("constraint_verdicts")).otherwise(F.array(F.lit(None).cast("string")))
    return a.select("pass_name", F.explode(keys).alias("constraint_id"), (~have).alias("synthesized")).groupBy("pass_name", "constraint_id", "synthesized").agg(F.count(F.lit(1)).alias("n"))


# --- intervals --------------------------------------------------------------------------------------------------

_SPANS = "SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 10000000) AS BIGINT) AS e FROM events WHERE value > 0"
_TRIM = f"""WITH sp AS ({_SPANS}), w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp WHERE e > s),
t AS (SELECT user_id, event_id, greatest(s, coalesce(pm, s)) AS s, e, coalesce(s < pm, false) AS overlapped FROM w WHERE pm IS NULL OR e > pm)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").where("value > 0").select("user_id", "event_id", at.alias("start"), (at + F.floor(F.col("value") * 10000000)).alias("end"))


@query(_TRIM + ' SELECT user_id, event_id, s AS "start", e AS "end", overlapped FROM t')
def q05_trim_spans(spark: SparkSession, d: str) -> DataFrame:
    return intervals.trim_spans(_spans(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "start", "end", "overlapped")


@query(f"""WITH sp AS ({_SPANS}), w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp WHERE e > s)
SELECT user_id, count(*) AS n_spans, count_if(coalesce(s < pm, false)) AS n_overlaps FROM w GROUP BY 1""")
def q06_overlap_count(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_counts(_spans(spark, d), ["user_id"], "event_id")


@query(_TRIM + """, p AS (SELECT user_id, event_id AS point_id, epoch_us(ts) + 1800000000 AS at FROM events)
SELECT p.user_id, p.point_id, CASE WHEN p.at < t.e THEN CAST(t.event_id AS VARCHAR) END AS covered_by FROM p ASOF LEFT JOIN t ON p.user_id = t.user_id AND p.at >= t.s""")
def q07_locate(spark: SparkSession, d: str) -> DataFrame:
    trimmed = intervals.trim_spans(_spans(spark, d), ["user_id"], "event_id")
    points = table(spark, d, "events").select("user_id", F.col("event_id").alias("point_id"), (F.unix_micros(F.col("ts").cast("timestamp")) + 1800000000).alias("at"))
    return intervals.locate(points, trimmed, ["user_id"], "at", "event_id").select("user_id", "point_id", "covered_by")


WEEK = (1704672000000000, 1705276800000000)  # 2024-01-08 to 2024-01-15


@query(_TRIM + f" SELECT user_id, CAST(sum(greatest(least(e, {WEEK[1]}) - greatest(s, {WEEK[0]}), 0)) AS BIGINT) AS covered FROM t GROUP BY 1")
def q08_clip_coverage(spark: SparkSession, d: str) -> DataFrame:
    return intervals.clip_coverage(intervals.trim_spans(_spans(spark, d), ["user_id"], "event_id"), ["user_id"], *WEEK)


@query("""WITH t AS (SELECT unit_location, count(*) AS n, count(DISTINCT pass_name) AS n_passes FROM annotation GROUP BY 1 ORDER BY n DESC, unit_location NULLS FIRST LIMIT 16)
SELECT * FROM t WHERE unit_location IS NOT NULL ORDER BY n DESC, unit_location LIMIT 15""")
def q09_owner_topk(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "annotation").groupBy("unit_location").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pass_name").alias("n_passes"))
    return g.orderBy(F.desc("n"), F.asc_nulls_first("unit_location")).limit(16).where("unit_location is not null").orderBy(F.desc("n"), "unit_location").limit(15)


# --- gates and pairs --------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(value > 100, false) DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q10_last_ok_wins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return gates.last_ok_wins(e, ["user_id", "event_type"], F.col("value") > 100, [F.col("ts"), F.col("event_id")]).drop("ts")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"SELECT user_id, date_trunc('week', ts)::DATE::VARCHAR AS week FROM events WHERE event_type IN {tuple(TYPES)} GROUP BY ALL HAVING count(DISTINCT event_type) = {len(TYPES)}")
def q11_division(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("week", F.date_trunc("week", "ts").cast("date").cast("string"))
    return gates.division(e, ["user_id", "week"], "event_type", TYPES)


PASSES = [f"r{i}" for i in range(1, 10)]


@query(f"""WITH u AS (SELECT DISTINCT unit_location FROM annotation WHERE unit_location IS NOT NULL)
SELECT unit_location, p AS pass_name FROM u, (SELECT unnest({PASSES}) AS p) EXCEPT SELECT unit_location, pass_name FROM annotation""")
def q12_missing_slots(spark: SparkSession, d: str) -> DataFrame:
    return gates.missing_slots(table(spark, d, "annotation").where("unit_location is not null"), ["unit_location"], "pass_name", PASSES)


@query("""WITH g AS (SELECT o_custkey, count(*) >= 5 AS a, coalesce(bool_or(o_orderstatus = 'F'), false) AS b, coalesce(min(o_totalprice) >= 1000, false) AS c FROM orders GROUP BY 1)
SELECT o_custkey, a AND b AND c AS passed, array_to_string(list_filter([CASE WHEN NOT a THEN 'FIVE_ORDERS' END, CASE WHEN NOT b THEN 'ONE_CLOSED' END, CASE WHEN NOT c THEN 'NO_TINY' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g""")
def q13_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    need = {"FIVE_ORDERS": F.count(F.lit(1)) >= 5, "ONE_CLOSED": F.bool_or(F.col("o_orderstatus") == "F"), "NO_TINY": F.min("o_totalprice") >= 1000}
    return gates.gate(table(spark, d, "orders"), ["o_custkey"], need).withColumn("reasons", F.array_join("reasons", ","))


_CFG = """WITH m AS (SELECT l_suppkey, l_returnflag, count(*)::DOUBLE AS n_lines, round(sum(l_quantity), 2) AS quantity, max(l_discount) AS top_discount FROM lineitem GROUP BY ALL),
e AS (SELECT l_suppkey, l_returnflag, 'n_lines' AS metric, n_lines AS v FROM m UNION ALL SELECT l_suppkey, l_returnflag, 'quantity', quantity FROM m UNION ALL SELECT l_suppkey, l_returnflag, 'top_discount', top_discount FROM m),
p AS (SELECT c.l_suppkey, c.l_returnflag, c.metric, b.v AS base_value, c.v AS value FROM e c JOIN e b ON b.l_suppkey = c.l_suppkey AND b.metric = c.metric AND b.l_returnflag = 'N' WHERE c.l_returnflag <> 'N' AND c.v IS DISTINCT FROM b.v)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.max("l_discount").alias("top_discount")
    )
    return gates.paired_compare(m, ["l_suppkey"], "l_returnflag", "N", ["n_lines", "quantity", "top_discount"])


@query(_CFG + " SELECT * FROM p")
def q14_paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(_CFG + """, r AS (SELECT l_returnflag, metric, round(value - base_value, 6) AS x, row_number() OVER (PARTITION BY l_returnflag, metric ORDER BY round(value - base_value, 6)) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, metric) AS n FROM p)
SELECT l_returnflag, metric, max(n) AS n, min(x) AS low, max(CASE WHEN i = n // 2 THEN x END) AS middle, max(x) AS high FROM r GROUP BY ALL""")
def q15_effect_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    effect = _pairs(spark, d).withColumn("x", F.round(F.col("value") - F.col("base_value"), 6))
    return gates.nearest_rank(effect, ["l_returnflag", "metric"], "x", {"low": 0.0, "middle": 0.5, "high": 1.0})


_SPELL = "nullif(lower(regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '[-\\s]', '_', 'g')), '')"


@query(f"""WITH t AS (SELECT frame, {_SPELL.format('linkage')} AS l, state FROM targets)
SELECT q.frame, q.linkage, count_if(t.state = 'CANDIDATE') AS candidates, count_if(t.state <> 'CANDIDATE') AS others, count(t.state) = 0 AS is_missing
FROM draw_quota q LEFT JOIN t ON t.frame = q.frame AND t.l = lower(q.linkage) GROUP BY ALL""")
def q16_cells_matrix(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import spelling

    t = table(spark, d, "targets").groupBy("frame", spelling(F.col("linkage")).alias("l")).agg(
        F.count_if(F.col("state") == "CANDIDATE").alias("candidates"), F.count_if(F.col("state") != "CANDIDATE").alias("others")
    )
    q = table(spark, d, "draw_quota").select("frame", "linkage", F.lower("linkage").alias("l")).distinct()
    zero = F.lit(0).cast("long")
    return q.join(t, ["frame", "l"], "left").select(
        "frame", "linkage", F.coalesce("candidates", zero).alias("candidates"), F.coalesce("others", zero).alias("others"),
        (F.coalesce("candidates", zero) + F.coalesce("others", zero) == 0).alias("is_missing"),
    )


# --- agreement --------------------------------------------------------------------------------------------------

_SID = "lower(regexp_replace(site_id, '^\\s+|\\s+$', '', 'g'))"
_API = "upper(regexp_replace(is_api_use, '^\\s+|\\s+$', '', 'g'))"
_TREE = "split_part(unit_location, '/', 1)"


@query(f"""WITH s AS (SELECT site_id AS sid, min(unit_location) AS su FROM site GROUP BY 1), b AS (SELECT x AS sid, min(unit_location) AS bu FROM (SELECT unnest(site_ids) AS x, unit_location FROM batch) GROUP BY 1),
a AS (SELECT {_SID} AS sid, unit_location AS au FROM annotation)
SELECT CASE WHEN au IS NOT NULL THEN 'record' WHEN su IS NOT NULL THEN 'site' WHEN bu IS NOT NULL THEN 'batch' ELSE 'unknown' END AS provenance, split_part(coalesce(au, su, bu, '(unknown)'), '/', 1) AS tree, count(*) AS n
FROM a LEFT JOIN s USING (sid) LEFT JOIN b USING (sid) GROUP BY ALL""")
def q17_provenance_coalesce(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotation").select(F.lower(strip(F.col("site_id"))).alias("sid"), F.col("unit_location").alias("au"))
    s = table(spark, d, "site").groupBy(F.col("site_id").alias("sid")).agg(F.min("unit_location").alias("su"))
    b = table(spark, d, "batch").select(F.explode("site_ids").alias("sid"), "unit_location").groupBy("sid").agg(F.min("unit_location").alias("bu"))
    # Only records without a unit of their own need the lookups.
    own, rest = a.where("au is not null"), a.where("au is null").join(s, "sid", "left").join(b, "sid", "left")
    found = own.select(F.lit("record").alias("provenance"), F.col("au").alias("u")).unionByName(
        rest.select(F.when(F.col("su").isNotNull(), "site").when(F.col("bu").isNotNull(), "batch").otherwise("unknown").alias("provenance"), F.coalesce("su", "bu", F.lit("(unknown)")).alias("u"))
    )
    return found.groupBy("provenance", F.substring_index("u", "/", 1).alias("tree")).agg(F.count(F.lit(1)).alias("n"))


_LAST = f"""WITH x AS (SELECT *, {_SID} AS sid, row_number() OVER (PARTITION BY pass_name, {_SID} ORDER BY annotated_at DESC, loaded_at DESC, ann_id DESC) AS rn FROM annotation WHERE site_id IS NOT NULL), a AS (SELECT * FROM x WHERE rn = 1)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotation").where("site_id is not null").withColumn("sid", F.lower(strip(F.col("site_id"))))
    return a.groupBy("pass_name", "sid").agg(
        F.max_by(F.struct("unit_location", F.coalesce(F.upper(strip(F.col("is_api_use"))), F.lit("NONE")).alias("api"), "operation", "value_fate", "constraint_verdicts", "is_api_use_reason"), F.struct("annotated_at", "loaded_at", "ann_id")).alias("m")
    ).select("pass_name", "sid", "m.*")


PAIR = ("r1", "r2")
_PAIR_SQL = _LAST + f""", l AS (SELECT sid, coalesce({_API}, 'NONE') AS m, {_TREE} AS tree FROM a WHERE pass_name = '{PAIR[0]}'), r AS (SELECT sid, coalesce({_API}, 'NONE') AS m FROM a WHERE pass_name = '{PAIR[1]}'),
i AS (SELECT sid, tree, l.m AS a, r.m AS b FROM l JOIN r USING (sid))"""


def _pair_items(spark: SparkSession, d: str) -> DataFrame:
    a = _latest(spark, d).where(F.col("pass_name").isin(*PAIR))
    return agreement.rater_pairs(a, ["sid"], "pass_name", F.col("api"), F.substring_index("unit_location", "/", 1)).withColumnRenamed("cluster", "tree")


_COEF = """, mk AS (SELECT {g} a AS c FROM i UNION ALL SELECT {g} b FROM i), ct AS (SELECT {g} c, count(*) AS n FROM mk GROUP BY ALL), t AS (SELECT {g} count(*) AS k, sum(n) AS t, sum(n * n) AS ss FROM ct {by}),
p AS (SELECT {g} count(*) AS n, avg((a = b)::INT) AS po FROM i {by}), z AS (SELECT * FROM p {j} t {u})
SELECT {g} n, k, round(po, 6) AS po, round(CASE WHEN k > 1 AND ss < t * t THEN (po - ss / (t * t)) / (1 - ss / (t * t)) END, 6) AS fleiss,
round(CASE WHEN k = 1 THEN 1.0 ELSE (po - (1 - ss / (t * t)) / (k - 1)) / (1 - (1 - ss / (t * t)) / (k - 1)) END, 6) AS ac1, round(CASE WHEN k > 1 THEN (k * po - 1) / (k - 1) END, 6) AS pabak FROM z"""


@query(_PAIR_SQL + _COEF.format(g="", by="", j="CROSS JOIN", u=""))
def q18_kappa_2(spark: SparkSession, d: str) -> DataFrame:
    return agreement.coefficients(_pair_items(spark, d), [])


@query("""WITH i AS (SELECT [value > 20, value > 40, value > 60] AS m FROM events WHERE value IS NOT NULL), s AS (SELECT list_sum([x::INT FOR x IN m])::INT AS y FROM i),
p AS (SELECT count(*) AS n, avg((y * y + (3 - y) * (3 - y) - 3) / 6.0) AS po, sum(y) AS c1, sum(3 - y) AS c0, sum(3) AS t FROM s), e AS (SELECT *, (c1 * c1 + c0 * c0) / (t * t) AS pe FROM p)
SELECT n, 2::BIGINT AS k, round(po, 6) AS po, round((po - pe) / (1 - pe), 6) AS fleiss, round((po - (1 - pe)) / pe, 6) AS ac1, round(2 * po - 1, 6) AS pabak FROM e""")
def q19_kappa_3(spark: SparkSession, d: str) -> DataFrame:
    marks = F.array(*[(F.col("value") > t).cast("string") for t in (20, 40, 60)])
    return agreement.coefficients(table(spark, d, "events").where("value is not null").select(marks.alias("marks")), [])


@query(_PAIR_SQL + """, c AS (SELECT x, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT a AS x, 1 AS ca, 0 AS cb FROM i UNION ALL SELECT b, 0, 1 FROM i) GROUP BY 1), p AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM i), s AS (SELECT sum(ca * cb) AS s FROM c)
SELECT n, round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS cohen FROM p, s""")
def q20_cohen(spark: SparkSession, d: str) -> DataFrame:
    return agreement.cohen(_pair_items(spark, d), [])


@query(_LAST + f" SELECT pass_name, coalesce({_API}, 'NONE') AS mark, count(*) AS n FROM a GROUP BY ALL")
def q21_marginals(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).groupBy("pass_name", F.col("api").alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@query(_PAIR_SQL + " SELECT a, b, count(*) AS n FROM i WHERE a <> b GROUP BY ALL ORDER BY n DESC, a, b LIMIT 40")
def q22_confusion_top(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion(_pair_items(spark, d), 40)


@query(_PAIR_SQL.replace("(SELECT sid, tree, l.m", "(SELECT sid, coalesce(tree, 'none') AS tree, l.m") + _COEF.format(g="tree,", by="GROUP BY tree", j="JOIN", u="USING (tree)"))
def q23_kappa_strata(spark: SparkSession, d: str) -> DataFrame:
    return agreement.coefficients(_pair_items(spark, d).withColumn("tree", F.coalesce("tree", F.lit("none"))), ["tree"])


_CON = "CASE WHEN cardinality(e.value.by_domain) > 0 THEN 'MIXED' ELSE coalesce(e.value.scalar, 'NONE') END"


@query(_LAST + f""", v AS (SELECT pass_name, sid, e.key AS cid, {_CON} AS m FROM (SELECT pass_name, sid, unnest(map_entries(constraint_verdicts)) AS e FROM a WHERE pass_name IN {PAIR})),
two AS (SELECT sid FROM a WHERE pass_name IN {PAIR} GROUP BY 1 HAVING count(*) = 2), l AS (SELECT * FROM v WHERE pass_name = '{PAIR[0]}' AND sid IN (FROM two)), r AS (SELECT * FROM v WHERE pass_name = '{PAIR[1]}' AND sid IN (FROM two))
SELECT coalesce(l.m, 'ABSENT') AS a, coalesce(r.m, 'ABSENT') AS b, count(*) AS n FROM l FULL JOIN r ON l.sid = r.sid AND l.cid = r.cid GROUP BY ALL""")
def q24_items_absent(spark: SparkSession, d: str) -> DataFrame:
    a = _latest(spark, d).where(F.col("pass_name").isin(*PAIR))
    mark = F.when(F.size(F.coalesce(F.map_keys("e.value.by_domain"), F.array())) > 0, "MIXED").otherwise(F.coalesce("e.value.scalar", F.lit("NONE")))
    has = {p: F.bool_or(F.col("pass_name") == p) for p in PAIR}
    both = a.groupBy("sid").agg(*[c.alias(p) for p, c in has.items()]).where(" and ".join(PAIR)).select("sid")
    v = a.select("pass_name", "sid", F.explode(F.map_entries("constraint_verdicts")).alias("e")).select("pass_name", "sid", F.col("e.key").alias("cid"), mark.alias("m")).join(both, "sid", "left_semi")
    at = lambda p: F.coalesce(F.min(F.when(F.col("pass_name") == p, F.col("m"))), F.lit("ABSENT"))
    return v.groupBy("sid", "cid").agg(at(PAIR[0]).alias("a"), at(PAIR[1]).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(_LAST + f""", y AS (SELECT sid FROM a WHERE pass_name = '{PAIR[0]}' AND {_API} = 'YES')
SELECT coalesce(nullif(regexp_extract(is_api_use_reason, '^\\s*([A-Z_]{{4,}})', 1), ''), 'NO_CODE') AS code, count(*) AS n FROM a WHERE pass_name = '{PAIR[1]}' AND {_API} = 'NO' AND sid IN (FROM y) GROUP BY 1""")
def q25_flips(spark: SparkSession, d: str) -> DataFrame:
    a = _latest(spark, d)
    yes, no = a.where((F.col("pass_name") == PAIR[0]) & (F.col("api") == "YES")), a.where((F.col("pass_name") == PAIR[1]) & (F.col("api") == "NO"))
    code = F.regexp_extract("is_api_use_reason", r"^\s*([A-Z_]{4,})", 1)
    return no.join(yes.select("sid"), "sid", "left_semi").groupBy(F.when(code != "", code).otherwise("NO_CODE").alias("code")).agg(F.count(F.lit(1)).alias("n"))


REPLICATES = 200


@query(_LAST + f""", l AS (SELECT sid, coalesce({_API}, 'NONE') AS m, coalesce(unit_location, 'none') AS u FROM a WHERE pass_name = '{PAIR[0]}'), r AS (SELECT sid, coalesce({_API}, 'NONE') AS m FROM a WHERE pass_name = '{PAIR[1]}'),
i AS (SELECT u, l.m AS a, r.m AS b FROM l JOIN r USING (sid)), st AS (SELECT u, count(*) AS n, sum((a = b)::INT) AS same FROM i GROUP BY 1), ct AS (SELECT u, c, count(*) AS n FROM (SELECT u, a AS c FROM i UNION ALL SELECT u, b FROM i) GROUP BY ALL),
rp AS (SELECT u, n, same, rep, ('0x' || substr(sha1('boot-1|' || rep || '|' || u), 1, 8))::BIGINT / 4294967296.0 AS h FROM st, (SELECT unnest(range({REPLICATES})) AS rep)),
w AS (SELECT *, CASE WHEN h < 0.367879 THEN 0 WHEN h < 0.735759 THEN 1 WHEN h < 0.919699 THEN 2 WHEN h < 0.981012 THEN 3 WHEN h < 0.99634 THEN 4 ELSE 5 END AS w FROM rp),
t AS (SELECT rep, sum(w * n) AS n, sum(w * same) AS same FROM w WHERE w > 0 GROUP BY 1), k AS (SELECT rep, sum(c * c) AS ss FROM (SELECT rep, ct.c AS cat, sum(w.w * ct.n) AS c FROM w JOIN ct USING (u) WHERE w.w > 0 GROUP BY ALL) GROUP BY 1)
SELECT rep::INT AS replicate, round(same / n, 6) AS po, round((same / n - ss / (4.0 * n * n)) / (1 - ss / (4.0 * n * n)), 6) AS fleiss FROM t JOIN k USING (rep)""")
def q26_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    a = _latest(spark, d).where(F.col("pass_name").isin(*PAIR)).withColumn("u", F.when(F.col("pass_name") == PAIR[0], F.coalesce("unit_location", F.lit("none"))))
    unit = a.groupBy("sid").agg(F.max("u").alias("u"))
    return agreement.cluster_bootstrap(agreement.pair_items(a, ["sid"], "pass_name", F.col("api"), list(PAIR)).join(unit, "sid"), "u", REPLICATES, "boot-1")


# The same statistics for every pair of passes; q18 to q26 keep their two raters and their SQL.

BY = ["rater_a", "rater_b"]
_ALL_SQL = _LAST + f""", m AS (SELECT pass_name AS p, sid, coalesce({_API}, 'NONE') AS m, coalesce({_TREE}, 'none') AS tree, coalesce(unit_location, 'none') AS u, is_api_use_reason AS why FROM a WHERE pass_name IS NOT NULL),
i AS (SELECT l.p AS rater_a, r.p AS rater_b, sid, l.m AS a, r.m AS b, l.tree, l.u, r.why FROM m l JOIN m r USING (sid) WHERE l.p < r.p)"""


def _all_pairs(spark: SparkSession, d: str, cluster: Column | None = None) -> DataFrame:
    return agreement.rater_pairs(_latest(spark, d), ["sid"], "pass_name", F.col("api"), cluster)


@query(_ALL_SQL + _COEF.format(g="rater_a, rater_b,", by="GROUP BY rater_a, rater_b", j="JOIN", u="USING (rater_a, rater_b)"))
def q18_kappa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.coefficients(_all_pairs(spark, d), BY)


@query(_ALL_SQL + """, p AS (SELECT rater_a, rater_b, count(*) AS n, avg((a = b)::INT) AS po FROM i GROUP BY ALL),
c AS (SELECT rater_a, rater_b, x, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT rater_a, rater_b, a AS x, 1 AS ca, 0 AS cb FROM i UNION ALL SELECT rater_a, rater_b, b, 0, 1 FROM i) GROUP BY ALL), s AS (SELECT rater_a, rater_b, sum(ca * cb) AS s FROM c GROUP BY ALL)
SELECT rater_a, rater_b, n, round(CASE WHEN s < n * n THEN (po - s / (n * n)) / (1 - s / (n * n)) END, 6) AS cohen FROM p JOIN s USING (rater_a, rater_b)""")
def q20_cohen_pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.cohen(_all_pairs(spark, d), BY)


@query(_ALL_SQL + " SELECT rater_a, rater_b, a, b, count(*) AS n FROM i WHERE a <> b GROUP BY ALL")
def q22_confusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion(_all_pairs(spark, d), None, BY)


@query(_ALL_SQL + _COEF.format(g="rater_a, rater_b, tree,", by="GROUP BY rater_a, rater_b, tree", j="JOIN", u="USING (rater_a, rater_b, tree)"))
def q23_strata_pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.coefficients(_all_pairs(spark, d, F.coalesce(F.substring_index("unit_location", "/", 1), F.lit("none"))).withColumnRenamed("cluster", "tree"), [*BY, "tree"])


@query(_LAST + f""", m AS (SELECT pass_name AS p, sid, constraint_verdicts AS cv FROM a WHERE pass_name IS NOT NULL), v AS (SELECT p, sid, e.key AS cid, {_CON} AS m FROM (SELECT p, sid, unnest(map_entries(cv)) AS e FROM m)),
i AS (SELECT l.p AS rater_a, r.p AS rater_b, sid FROM m l JOIN m r USING (sid) WHERE l.p < r.p), k AS (SELECT DISTINCT rater_a, rater_b, i.sid, cid FROM i JOIN v ON v.sid = i.sid AND v.p IN (rater_a, rater_b))
SELECT rater_a, rater_b, coalesce(x.m, 'ABSENT') AS a, coalesce(y.m, 'ABSENT') AS b, count(*) AS n FROM k LEFT JOIN v x ON x.sid = k.sid AND x.cid = k.cid AND x.p = rater_a LEFT JOIN v y ON y.sid = k.sid AND y.cid = k.cid AND y.p = rater_b GROUP BY ALL""")
def q24_absent_pairs(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda v: F.when(F.size(F.coalesce(F.map_keys(v["by_domain"]), F.array())) > 0, "MIXED").otherwise(F.coalesce(v["scalar"], F.lit("NONE")))
    verdicts = F.map_from_entries(F.transform(F.map_entries(F.coalesce("constraint_verdicts", F.create_map().cast("map<string,struct<scalar:string,by_domain:map<string,string>>>"))), lambda e: F.struct(e["key"].alias("k"), mark(e["value"]).alias("m"))))
    rows = _latest(spark, d).where("pass_name is not null").select("sid", F.struct(F.col("pass_name").alias("p"), verdicts.alias("v")).alias("x"))
    lists = rows.groupBy("sid").agg(F.collect_list("x").alias("l")).where(F.size("l") > 1)
    two = lists.select("l", F.explode("l").alias("x")).select("x", F.explode("l").alias("y")).where("x.p < y.p")
    c = two.select(F.col("x.p").alias("rater_a"), F.col("y.p").alias("rater_b"), "x", "y", F.explode(F.array_union(F.map_keys("x.v"), F.map_keys("y.v"))).alias("cid"))
    at = lambda s: F.coalesce(F.try_element_at(F.col(f"{s}.v"), F.col("cid")), F.lit("ABSENT"))
    return c.groupBy(*BY, at("x").alias("a"), at("y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query(_LAST + f""", m AS (SELECT pass_name AS p, sid, {_API} AS m, is_api_use_reason AS why FROM a)
SELECT l.p AS rater_yes, r.p AS rater_no, coalesce(nullif(regexp_extract(r.why, '^\\s*([A-Z_]{{4,}})', 1), ''), 'NO_CODE') AS code, count(*) AS n FROM m l JOIN m r USING (sid) WHERE l.m = 'YES' AND r.m = 'NO' AND l.p IS NOT NULL AND r.p IS NOT NULL GROUP BY ALL""")
def q25_flips_pairs(spark: SparkSession, d: str) -> DataFrame:
    code = F.regexp_extract("is_api_use_reason", r"^\s*([A-Z_]{4,})", 1)
    a = _latest(spark, d).where("pass_name is not null and api in ('YES', 'NO')")
    m = a.groupBy("sid").agg(F.collect_list(F.when(F.col("api") == "YES", F.col("pass_name"))).alias("yes"), F.collect_list(F.when(F.col("api") == "NO", F.struct(F.col("pass_name").alias("p"), F.when(code != "", code).otherwise("NO_CODE").alias("code")))).alias("no"))
    x = m.select(F.explode("yes").alias("rater_yes"), "no").select("rater_yes", F.explode("no").alias("x"))
    return x.groupBy("rater_yes", F.col("x.p").alias("rater_no"), F.col("x.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(_ALL_SQL + f""", st AS (SELECT rater_a, rater_b, u, count(*) AS n, sum((a = b)::INT) AS same FROM i GROUP BY ALL), ct AS (SELECT rater_a, rater_b, u, c, count(*) AS n FROM (SELECT rater_a, rater_b, u, a AS c FROM i UNION ALL SELECT rater_a, rater_b, u, b FROM i) GROUP BY ALL),
h AS (SELECT u, rep, ('0x' || substr(sha1('boot-1|' || rep || '|' || u), 1, 8))::BIGINT / 4294967296.0 AS h FROM (SELECT DISTINCT u FROM st), (SELECT unnest(range({REPLICATES})) AS rep)),
w AS (SELECT u, rep, CASE WHEN h < 0.367879 THEN 0 WHEN h < 0.735759 THEN 1 WHEN h < 0.919699 THEN 2 WHEN h < 0.981012 THEN 3 WHEN h < 0.99634 THEN 4 ELSE 5 END AS w FROM h),
t AS (SELECT rater_a, rater_b, rep, sum(w * n) AS n, sum(w * same) AS same FROM st JOIN w USING (u) WHERE w > 0 GROUP BY ALL),
k AS (SELECT rater_a, rater_b, rep, sum(c * c) AS ss FROM (SELECT rater_a, rater_b, rep, ct.c AS cat, sum(w.w * ct.n) AS c FROM w JOIN ct USING (u) WHERE w.w > 0 GROUP BY ALL) GROUP BY ALL)
SELECT rater_a, rater_b, rep::INT AS replicate, round(same / n, 6) AS po, round(CASE WHEN ss < 4 * n * n THEN (same / n - ss / (4.0 * n * n)) / (1 - ss / (4.0 * n * n)) END, 6) AS fleiss FROM t JOIN k USING (rater_a, rater_b, rep)""")
def q26_bootstrap_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = _all_pairs(spark, d, F.coalesce("unit_location", F.lit("none"))).withColumnRenamed("cluster", "u")
    return agreement.cluster_bootstrap(pairs, "u", REPLICATES, "boot-1", BY)


# --- sampling ---------------------------------------------------------------------------------------------------

_SEATS = """WITH c AS (SELECT coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, 200 * n / sum(n) OVER () AS x FROM c),
f AS (SELECT lang, n, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS r, 200 - sum(floor(x)) OVER () AS left_over FROM e), s AS (SELECT lang, n, CAST(f + (r <= left_over)::INT AS BIGINT) AS seats FROM f)"""


def _lang_seats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("none")))
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return docs, apportion.largest_remainder(counts, [], "lang", "n", F.lit(200))


@query(_SEATS + " SELECT lang, n, seats FROM s")
def q27_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    return _lang_seats(spark, d)[1]


@query(_SEATS + ", o AS (SELECT doc_id, s.lang, seats, row_number() OVER (PARTITION BY s.lang ORDER BY sha1('s1|' || doc_id), doc_id) AS r FROM documents d JOIN s ON s.lang = coalesce(d.lang, 'none')) SELECT doc_id, lang FROM o WHERE r <= seats")
def q28_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs, seats = _lang_seats(spark, d)
    return apportion.draw_by_seats(docs.select("doc_id", "lang"), seats, ["lang"], [apportion.seeded(F.lit("s1"), F.col("doc_id").cast("string")), F.col("doc_id")])


@query(f"""SELECT ann_id, unnest(list_filter([CASE WHEN list_contains(value_fate, 'OFF_DEVICE') THEN 'OFF_DEVICE_FATE' END, CASE WHEN list_contains([v.scalar FOR v IN map_values(constraint_verdicts)], 'CONFLICT') THEN 'CONFLICT' END,
CASE WHEN site_class = 'ALT' AND {_API} = 'YES' THEN 'ALT_IN_USE' END, CASE WHEN escape_info IS NOT NULL THEN 'ESCAPES' END], lambda x: x IS NOT NULL)) AS reason FROM annotation""")
def q29_census_reasons(spark: SparkSession, d: str) -> DataFrame:
    reasons = {
        "OFF_DEVICE_FATE": F.array_contains("value_fate", "OFF_DEVICE"), "CONFLICT": F.exists(F.map_values("constraint_verdicts"), lambda v: v["scalar"] == "CONFLICT"),
        "ALT_IN_USE": (F.col("site_class") == "ALT") & (F.upper(strip(F.col("is_api_use"))) == "YES"), "ESCAPES": F.col("escape_info").isNotNull(),
    }
    return apportion.census(table(spark, d, "annotation"), reasons).select("ann_id", "reason")


@query(f"""WITH t AS (SELECT DISTINCT ON (frame, l, r) frame, l, r, stars, target_id FROM (SELECT frame, {_SPELL.format('linkage')} AS l, lower(trim(repo)) AS r, coalesce(stars, 0) AS stars, target_id FROM targets WHERE state = 'CANDIDATE') WHERE l IS NOT NULL AND r IS NOT NULL ORDER BY frame, l, r, stars DESC, target_id),
q AS (SELECT frame, lower(linkage) AS l, CAST(floor(round(share * n_total, 6)) AS BIGINT) AS want, n_total FROM draw_quota),
k AS (SELECT t.*, q.want, q.n_total, row_number() OVER (PARTITION BY t.frame, t.l ORDER BY stars DESC, target_id) AS rk FROM t JOIN q USING (frame, l)),
m AS (SELECT *, rk <= want AS in_quota FROM k), f AS (SELECT *, sum(in_quota::INT) OVER (PARTITION BY frame) AS got, row_number() OVER (PARTITION BY frame, in_quota ORDER BY stars DESC, target_id) AS br FROM m)
SELECT frame, l AS linkage, target_id, CASE WHEN in_quota THEN 'QUOTA' WHEN br <= n_total - got THEN 'BACKFILL' ELSE 'NOT_SELECTED' END AS outcome FROM f""")
def q30_quota_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Top stars per linkage up to the quota, back-fill to the frame's total, and a name for all that fell out."""
    from ..functions.text import spelling

    t = table(spark, d, "targets").where("state = 'CANDIDATE'").select("frame", spelling(F.col("linkage")).alias("l"), F.lower(F.trim("repo")).alias("r"), F.coalesce("stars", F.lit(0)).alias("stars"), "target_id").dropna(subset=["frame", "l", "r"])
    t = t.groupBy("frame", "l", "r").agg(F.min_by(F.struct("stars", "target_id"), F.struct(-F.col("stars"), F.col("target_id"))).alias("b")).select("frame", "l", "b.*")
    q = table(spark, d, "draw_quota").select("frame", F.lower("linkage").alias("l"), F.floor(F.round(F.col("share") * F.col("n_total"), 6)).alias("want"), "n_total")
    by = [F.desc("stars"), F.col("target_id")]
    k = t.join(q, ["frame", "l"]).withColumn("in_quota", F.row_number().over(Window.partitionBy("frame", "l").orderBy(*by)) <= F.col("want"))
    k = k.withColumn("got", F.sum(F.col("in_quota").cast("int")).over(Window.partitionBy("frame"))).withColumn("br", F.row_number().over(Window.partitionBy("frame", "in_quota").orderBy(*by)))
    outcome = F.when(F.col("in_quota"), "QUOTA").when(F.col("br") <= F.col("n_total") - F.col("got"), "BACKFILL").otherwise("NOT_SELECTED")
    return k.select("frame", F.col("l").alias("linkage"), "target_id", outcome.alias("outcome"))


# --- batches and reconciliation ---------------------------------------------------------------------------------


@query("""WITH s AS (SELECT DISTINCT site_id, unit_location, file, line, col FROM site WHERE unit_location IS NOT NULL), c AS (SELECT *, (row_number() OVER (PARTITION BY unit_location ORDER BY file, line, col, site_id) - 1) // 40 AS chunk FROM s),
k AS (SELECT unit_location, chunk, row_number() OVER (ORDER BY lower(unit_location), unit_location, chunk) AS batch_no FROM (SELECT DISTINCT unit_location, chunk FROM c))
SELECT site_id, unit_location, chunk, batch_no FROM c JOIN k USING (unit_location, chunk)""")
def q31_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site").select("site_id", "unit_location", "file", "line", "col").distinct()
    return batching.chunk(s, "unit_location", ["file", "line", "col", "site_id"], 40).select("site_id", "unit_location", "chunk", "batch_no")


@query("""WITH s AS (SELECT doc_id, unit_location AS u, sha256(text) AS h FROM documents WHERE unit_location IS NOT NULL AND text IS NOT NULL),
g AS (SELECT h, min(u) AS first FROM s GROUP BY 1 HAVING count(DISTINCT u) > 1), n AS (SELECT h, u, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT s.*, g.first, n.n, row_number() OVER (PARTITION BY s.h, s.u ORDER BY doc_id) AS pos FROM s JOIN g USING (h) JOIN n USING (h, u))
SELECT a.doc_id AS copy_id, b.doc_id AS original_id FROM p a JOIN p b ON a.h = b.h AND a.pos = b.pos AND b.u = b.first AND a.u <> a.first AND a.n = b.n""")
def q32_equal_mult_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand as often in another unit as in the first one: each with the row it copies."""
    docs = table(spark, d, "documents").select("doc_id", "unit_location", F.sha2("text", 256).alias("h"))
    return reconcile.equal_multiplicity_copies(docs, [F.col("h")], "unit_location", [], "doc_id")


@query("""WITH k AS (SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events), a AS (SELECT k, event_type, count(*) AS n_users FROM k WHERE k IS NOT NULL GROUP BY ALL)
SELECT x.k, x.event_type, y.event_type AS other_type, y.n_users FROM a x JOIN a y ON x.k = y.k AND x.event_type <> y.event_type""")
def q33_channel_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For each key and event type the other types that use the key, with their users."""
    e = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k")).where("k is not null").distinct()
    a = e.groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("n_users"))
    return a.select("k", "event_type").join(a.select("k", F.col("event_type").alias("other_type"), "n_users"), "k").where("event_type <> other_type")


@query("""WITH r AS (SELECT DISTINCT unit_location AS u, category, operation_prefill AS op FROM site WHERE unit_location IS NOT NULL AND operation_prefill IN ('READ', 'WRITE')), c AS (SELECT u, category, bool_or(op = 'WRITE') AS w, bool_or(op = 'READ') AS r FROM r GROUP BY ALL)
SELECT category, count_if(w AND r) AS both_units, count_if(w AND NOT r) AS write_only, count_if(r AND NOT w) AS read_only, count_if(w) * count_if(r) - count_if(w AND r) AS n_pairs FROM c GROUP BY 1""")
def q34_writer_reader_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per category how many units write, read or do both; pairs writer <> reader are counted, not listed."""
    s = table(spark, d, "site").where("unit_location is not null and operation_prefill in ('READ', 'WRITE')")
    c = s.groupBy("unit_location", "category").agg(F.bool_or(F.col("operation_prefill") == "WRITE").alias("w"), F.bool_or(F.col("operation_prefill") == "READ").alias("r"))
    w, r, both = F.count_if("w"), F.count_if("r"), F.count_if(F.col("w") & F.col("r"))
    return c.groupBy("category").agg(both.alias("both_units"), (w - both).alias("write_only"), (r - both).alias("read_only"), (w * r - both).alias("n_pairs"))


@query("""WITH o AS (SELECT DISTINCT 'Sources' AS o UNION ALL SELECT 'Sources/Core' UNION ALL SELECT 'App/Model'), f AS (SELECT DISTINCT unit_location, file FROM site WHERE file IS NOT NULL),
h AS (SELECT file, max(o) FILTER (WHERE length(o) = l) AS nearest FROM (SELECT f.file, o.o, max(length(o.o)) OVER (PARTITION BY f.file) AS l FROM (SELECT DISTINCT file FROM f) f JOIN o ON starts_with(f.file, o.o || '/')) GROUP BY 1)
SELECT unit_location, coalesce(nearest, 'NONE') AS nearest, count(*) AS n_files FROM f LEFT JOIN h USING (file) GROUP BY ALL""")
def q35_nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    owners = spark.createDataFrame([("Sources",), ("Sources/Core",), ("App/Model",)], "dir string")
    files = table(spark, d, "site").where("file is not null").select("unit_location", "file").distinct()
    found = reconcile.nearest_ancestor(files, "file", owners, "dir")
    return found.groupBy("unit_location", F.coalesce("nearest", F.lit("NONE")).alias("nearest")).agg(F.count(F.lit(1)).alias("n_files"))


_DECL = "SELECT DISTINCT unit_location AS u, e.key AS cat, unnest(e.value) AS reason FROM (SELECT unit_location, unnest(map_entries({col})) AS e FROM {t} WHERE unit_location IS NOT NULL AND {col} IS NOT NULL)"


@query(f"""WITH a AS ({_DECL.format(col='declares', t='batch')}), b AS ({_DECL.format(col='declared_reasons', t='site')})
SELECT coalesce(a.u, b.u) AS unit_location, coalesce(a.cat, b.cat) AS category, coalesce(a.reason, b.reason) AS reason, CASE WHEN a.u IS NULL THEN 'UNDER' WHEN b.u IS NULL THEN 'OVER' ELSE 'AGREE' END AS verdict
FROM a FULL JOIN b ON a.u = b.u AND a.cat = b.cat AND a.reason = b.reason WHERE coalesce(a.reason, b.reason) IS NOT NULL""")
def q36_reconcile_pairs(spark: SparkSession, d: str) -> DataFrame:
    def pairs(t: str, c: str) -> DataFrame:
        e = table(spark, d, t).where("unit_location is not null").select("unit_location", F.explode(c).alias("category", "rs"))
        return e.select("unit_location", "category", F.explode("rs").alias("reason"))

    return reconcile.reconcile_sets(pairs("batch", "declares"), pairs("site", "declared_reasons"), ["unit_location", "category", "reason"])


@query("""WITH h AS (SELECT sha256(text) AS h, min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT d.doc_id, h.first AS original_id, h.n AS n_copies FROM documents d JOIN h ON sha256(d.text) = h.h WHERE n > 1""")
def q37_hash_identity(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies by content hash: each with the first of its class and the size of the class."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    classes = docs.groupBy("h").agg(F.min("doc_id").alias("original_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return docs.join(classes, "h").select("doc_id", "original_id", "n_copies")


# --- text -------------------------------------------------------------------------------------------------------

_SHAPE = """regexp_replace(regexp_replace(fate_evidence, '["''`][^"''`\n]*["''`]', 'S', 'g'), '[0-9]+', '#', 'g')"""


@query(f"SELECT pass_name, count(fate_evidence) AS n, count(DISTINCT {_SHAPE}) AS n_shapes, round(count(DISTINCT {_SHAPE}) / count(fate_evidence), 6) AS ratio, count(fate_evidence) >= 10 AND count(DISTINCT {_SHAPE}) / count(fate_evidence) < 0.34 AS alarm FROM annotation WHERE fate_evidence <> '' GROUP BY 1")
def q38_evidence_shapes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotation").where("fate_evidence <> ''").select("pass_name", textscan.shape(F.col("fate_evidence")).alias("s"))
    per = a.groupBy("pass_name", "s").agg(F.count(F.lit(1)).alias("c")).groupBy("pass_name").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_shapes"))
    ratio = F.col("n_shapes") / F.col("n")
    return per.select("pass_name", "n", "n_shapes", F.round(ratio, 6).alias("ratio"), ((F.col("n") >= 10) & (ratio < 0.34)).alias("alarm"))


@query(f"""WITH s AS (SELECT site_id AS sid, min(context.start_line) AS lo, max(context.start_line + len(context.lines) - 1) AS hi FROM site WHERE context IS NOT NULL GROUP BY 1),
c AS (SELECT ann_id, {_SID} AS sid, unnest([x::INT FOR x IN regexp_extract_all(fate_evidence, '\\bL([0-9]{{1,9}})\\b', 1)]) AS ln FROM annotation WHERE fate_evidence IS NOT NULL)
SELECT CASE WHEN s.sid IS NULL THEN 'NO_SITE' WHEN ln BETWEEN lo AND hi THEN 'IN_WINDOW' ELSE 'OUTSIDE' END AS verdict, count(*) AS n FROM c LEFT JOIN s USING (sid) GROUP BY 1""")
def q39_line_citations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotation").where("fate_evidence is not null").select(F.lower(strip(F.col("site_id"))).alias("sid"), F.explode(textscan.cited_lines(F.col("fate_evidence"))).alias("ln"))
    s = table(spark, d, "site").where("context is not null").groupBy(F.col("site_id").alias("sid")).agg(F.min("context.start_line").alias("lo"), F.max(F.col("context.start_line") + F.size("context.lines") - 1).alias("hi"))
    verdict = F.when(F.col("lo").isNull(), "NO_SITE").when(F.col("ln").between(F.col("lo"), F.col("hi")), "IN_WINDOW").otherwise("OUTSIDE")
    return a.join(s, "sid", "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS ln, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)), h AS (SELECT doc_id, ln AS at FROM l WHERE contains(line, 'CONFLICT'))
SELECT h.doc_id, h.at AS ln, string_agg(l.line, '|' ORDER BY l.ln) AS context FROM h JOIN l ON l.doc_id = h.doc_id AND l.ln BETWEEN h.at - 2 AND h.at + 2 GROUP BY ALL""")
def q40_context_window(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    all_lines = textscan.lines(docs, ["doc_id"], "text")
    return textscan.context_windows(all_lines, ["doc_id"], F.col("line").contains("CONFLICT"), 2).withColumn("context", F.array_join("context", "|"))


PATTERNS = {"domain_is": r"UserDefaults(?:\.standard)?", "suite": r"suiteName:\s*\S+", "key": r"forKey:\s*\"[^\"]*\"", "call": r"\b[a-z]+[A-Z]\w*\("}


@query()
def q41_hit_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").rlike("UserDefaults|suiteName|forKey|\\(")).select("doc_id", "text")
    found = textscan.hits(docs, "text", PATTERNS).select("doc_id", F.explode("hits").alias("h"))
    return found.select("doc_id", F.col("h.start").alias("start"), F.col("h.stop").alias("stop"), F.col("h.tag").alias("tag"))


@query("""SELECT CASE WHEN live IS NULL THEN 'unknown' WHEN live THEN 'live' ELSE 'dead' END AS evaluated, coalesce(guard_live_on_ios::VARCHAR, 'unknown') AS recorded, count(*) AS n FROM
(SELECT guard_live_on_ios, CASE WHEN compile_guard IS NULL OR len(compile_guard) = 0 OR compile_guard IN (['#if os(iOS)'], ['#if DEBUG', '#else']) THEN true END AS live FROM site) GROUP BY ALL""")
def q42_three_valued_guards(spark: SparkSession, d: str) -> DataFrame:
    live = guards.liveness(guards.RELEASE_IOS)("compile_guard")
    s = table(spark, d, "site").select(live.alias("live"), F.coalesce(F.col("guard_live_on_ios").cast("string"), F.lit("unknown")).alias("recorded"))
    word = F.when(F.col("live").isNull(), "unknown").when(F.col("live"), "live").otherwise("dead")
    return s.groupBy(word.alias("evaluated"), "recorded").agg(F.count(F.lit(1)).alias("n"))


# --- validation, correction, publication ------------------------------------------------------------------------

from ..operators import validate  # noqa: E402


@query(f"""WITH a AS (SELECT *, {_API} AS api FROM annotation), e AS (SELECT pass_name, unnest(list_filter([
 CASE WHEN api IS NULL THEN 'MISSING_API_USE' END, CASE WHEN api IS NOT NULL AND api NOT IN ('YES', 'NO', 'UNSURE') THEN 'BAD_API_USE' END, CASE WHEN unit_confirmed IS NULL THEN 'MISSING_UNIT_CONFIRMED' END,
 CASE WHEN site_id IS NULL OR NOT regexp_matches(lower(regexp_replace(site_id, '^\\s+|\\s+$', '', 'g')), '^[0-9a-f]{{16}}$') THEN 'BAD_SITE_ID' END, CASE WHEN api = 'NO' AND len(value_fate) > 0 THEN 'NO_WITH_FATE' END,
 CASE WHEN api = 'NO' AND cardinality(constraint_verdicts) > 0 THEN 'NO_WITH_VERDICTS' END, CASE WHEN api = 'YES' AND coalesce(len(value_fate), 0) = 0 THEN 'YES_WITHOUT_FATE' END,
 CASE WHEN len(value_fate) > len(list_distinct(value_fate)) THEN 'REPEATED_FATE' END, CASE WHEN site_class = 'RRA' AND alt_equivalence IS NOT NULL THEN 'RRA_WITH_ALT' END, CASE WHEN loaded_at < annotated_at THEN 'LOADED_BEFORE' END], lambda x: x IS NOT NULL)) AS rule FROM a)
SELECT rule, pass_name, count(*) AS n FROM e GROUP BY ALL""")
def q43_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    errors = validate.violations(table(spark, d, "annotation"), validate.RECORD_RULES, ["ann_id", "pass_name"])
    return errors.groupBy("rule", "pass_name").agg(F.count(F.lit(1)).alias("n"))


@query(_LAST + f""", p AS (SELECT sid, coalesce({_API}, 'NONE') AS old FROM a WHERE pass_name = 'r1'), q AS (SELECT sid, coalesce({_API}, 'NONE') AS new FROM a WHERE pass_name = 'r2'), g AS (SELECT sid, coalesce({_API}, 'NONE') AS got FROM a WHERE pass_name = 'r3')
SELECT CASE WHEN old IS NULL OR new IS NULL THEN 'NOT_APPLICABLE' WHEN old = new THEN 'SAME_UNDER_BOTH' WHEN got = old THEN 'FLIPPED' WHEN got = new THEN 'ALREADY_NEW' ELSE 'DIVERGENT' END AS outcome, count(*) AS n, count_if(old IS NOT NULL AND new IS NOT NULL AND old <> new AND got = old) AS n_written
FROM g LEFT JOIN p USING (sid) LEFT JOIN q USING (sid) GROUP BY 1""")
def q44_patch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a two-version rule change does to recorded marks: two passes stand for the old and new rule, a third for the record."""
    a = _latest(spark, d)
    of = lambda p, c: a.where(F.col("pass_name") == p).select("sid", F.col("api").alias(c))
    j = of("r3", "got").join(of("r1", "old"), "sid", "left").join(of("r2", "new"), "sid", "left")
    out = validate.patch(j, "old", "new", "got")
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("patched") != F.col("got")).alias("n_written"))


@query("""WITH b AS (SELECT n_sites, site_ids FROM batch), k AS (SELECT unnest(site_ids) AS s FROM b), t AS (SELECT DISTINCT site_id AS s FROM site)
SELECT 'COUNTS_MATCH' AS gate, count_if(n_sites <> len(site_ids)) = 0 AS passed, count_if(n_sites <> len(site_ids)) AS n FROM b UNION ALL
SELECT 'EACH_SITE_ONCE', count(*) - count(DISTINCT s) = 0, count(*) - count(DISTINCT s) FROM k UNION ALL SELECT 'SITES_EXIST', count(*) = 0, count(*) FROM (SELECT DISTINCT s FROM k WHERE s NOT IN (FROM t)) UNION ALL
SELECT 'ALL_SITES_BATCHED', count(*) = 0, count(*) FROM t WHERE s NOT IN (SELECT s FROM k WHERE s IS NOT NULL)""")
def q45_gates(spark: SparkSession, d: str) -> DataFrame:
    b, t = table(spark, d, "batch"), table(spark, d, "site").select(F.col("site_id").alias("s")).distinct()
    k = b.select(F.explode("site_ids").alias("s"))
    n = {
        "COUNTS_MATCH": b.agg(F.count_if(F.col("n_sites") != F.size("site_ids")).alias("n")), "EACH_SITE_ONCE": k.groupBy("s").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")),
        "SITES_EXIST": k.distinct().join(t, "s", "left_anti").agg(F.count(F.lit(1)).alias("n")), "ALL_SITES_BATCHED": t.join(k, "s", "left_anti").agg(F.count(F.lit(1)).alias("n")),
    }
    return validate.gate_rows(n)


@query(_LAST + f""", v AS (SELECT sid, {_API} AS m FROM a WHERE is_api_use IS NOT NULL), c AS (SELECT sid, count(*) AS n, count(DISTINCT m) AS k FROM v GROUP BY 1)
SELECT CASE WHEN n >= 3 AND k = 1 THEN 'UNANIMOUS' WHEN n >= 3 THEN 'ADJUDICATED' WHEN n = 2 THEN 'DOUBLE' ELSE 'SINGLE' END AS tier, count(*) AS n FROM c GROUP BY 1""")
def q46_confidence_tier(spark: SparkSession, d: str) -> DataFrame:
    c = _latest(spark, d).where("api <> 'NONE'").groupBy("sid").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("api").alias("k"))
    tier = ladders.ladder([("UNANIMOUS", (F.col("c") >= 3) & (F.col("k") == 1)), ("ADJUDICATED", F.col("c") >= 3), ("DOUBLE", F.col("c") == 2)], "SINGLE")
    return c.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT DISTINCT substr(sha1(concat_ws('|', unit_location, file, line, col, api)), 1, 16) AS id, unit_location, file, line, col, api FROM site)
SELECT id, count(*) AS n_places FROM i GROUP BY 1""")
def q47_stable_id(spark: SparkSession, d: str) -> DataFrame:
    cols = ["unit_location", "file", "line", "col", "api"]
    i = table(spark, d, "site").select(reconcile.stable_id(*[F.col(c).cast("string") for c in cols]).alias("id"), *cols).distinct()
    return i.groupBy("id").agg(F.count(F.lit(1)).alias("n_places"))


@query("SELECT pass_name, count(*) AS n, CAST(sum(epoch_us(loaded_at) - epoch_us(annotated_at)) // 1000000 AS BIGINT) AS total_s, round(avg(epoch_us(loaded_at) - epoch_us(annotated_at)) / 1e6, 3) AS mean_s, max(epoch_us(loaded_at) - epoch_us(annotated_at)) // 1000000 AS longest_s FROM annotation WHERE loaded_at IS NOT NULL AND annotated_at IS NOT NULL GROUP BY 1")
def q48_elapsed_stats(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("annotated_at").cast("timestamp"))
    a = table(spark, d, "annotation").select("pass_name", us.alias("us")).where("us is not null")
    return a.groupBy("pass_name").agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.sum("us") / 1000000).cast("long").alias("total_s"), F.round(F.avg("us") / 1e6, 3).alias("mean_s"), F.floor(F.max("us") / 1000000).cast("long").alias("longest_s")
    )


@query()
def q49_greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "documents").where("unit_location is not null").groupBy(F.substring_index("unit_location", "/", 1).alias("tree"), "unit_location").agg(F.sum(F.length("text")).alias("size"))
    return batching.greedy_packs(units, "tree", "unit_location", "size", 200_000, 10)


@query("""SELECT kind, rule, count(*) AS n FROM (SELECT CASE WHEN file IS NULL THEN 'NONE' WHEN regexp_matches(file, '^Pods/[^/]+/') THEN 'POD' WHEN regexp_matches(file, '(^|/)Tests?/') THEN 'TEST' WHEN file LIKE '%.swift' THEN 'SWIFT' WHEN regexp_matches(file, '\\.mm?$') THEN 'OBJC' ELSE 'OTHER' END AS kind,
CASE WHEN file IS NULL THEN 'NO_FILE' WHEN regexp_matches(file, '^Pods/[^/]+/') THEN 'POD_FOLDER' WHEN regexp_matches(file, '(^|/)Tests?/') THEN 'TEST_FOLDER' WHEN file LIKE '%.swift' THEN 'SUFFIX_SWIFT' WHEN regexp_matches(file, '\\.mm?$') THEN 'SUFFIX_OBJC' ELSE 'NO_RULE_MATCHED' END AS rule FROM site) GROUP BY ALL""")
def q50_path_ladder(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("file")
    tests = [(f.isNull(), "NONE", "NO_FILE"), (f.rlike("^Pods/[^/]+/"), "POD", "POD_FOLDER"), (f.rlike("(^|/)Tests?/"), "TEST", "TEST_FOLDER"), (f.endswith(".swift"), "SWIFT", "SUFFIX_SWIFT"), (f.rlike(r"\.mm?$"), "OBJC", "SUFFIX_OBJC")]
    kind, rule = ladders.ladder([(k, p) for p, k, _ in tests], "OTHER"), ladders.ladder([(r, p) for p, _, r in tests], "NO_RULE_MATCHED")
    return table(spark, d, "site").groupBy(kind.alias("kind"), rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT DISTINCT batch_file, unnest(site_ids) AS sid FROM batch), a AS (SELECT DISTINCT pass_name, unit_location, {_SID} AS sid FROM annotation WHERE unit_location IS NOT NULL),
o AS (SELECT pass_name, unit_location, batch_file, count(*) AS n FROM a JOIN k USING (sid) GROUP BY ALL)
SELECT pass_name, unit_location, batch_file, n FROM (SELECT *, row_number() OVER (PARTITION BY pass_name, unit_location ORDER BY n DESC, batch_file) AS r FROM o) WHERE r = 1""")
def q51_argmax_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The batch that shares most sites with each pass's output for a unit, ties to the first name."""
    k = table(spark, d, "batch").select("batch_file", F.explode("site_ids").alias("sid")).distinct()
    a = table(spark, d, "annotation").where("unit_location is not null").select("pass_name", "unit_location", F.lower(strip(F.col("site_id"))).alias("sid")).distinct()
    o = a.join(k, "sid").groupBy("pass_name", "unit_location", "batch_file").agg(F.count(F.lit(1)).alias("n"))
    best = o.groupBy("pass_name", "unit_location").agg(F.min_by(F.struct("batch_file", "n"), F.struct(-F.col("n"), F.col("batch_file"))).alias("b"))
    return best.select("pass_name", "unit_location", "b.*")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(raw, '^\\s*$') THEN 'BLANK' WHEN regexp_matches(raw, '^\\s*#') THEN 'COMMENT' WHEN NOT json_valid(raw) THEN 'BROKEN' WHEN json_type(raw) <> 'OBJECT' THEN 'NOT_OBJECT' ELSE 'RECORD' END AS kind FROM annotation_raw) GROUP BY 1""")
def q52_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.jsonl import line_kind

    return table(spark, d, "annotation_raw").groupBy(line_kind(F.col("raw")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- all fields, all raters; content, floors, comparable rows ---------------------------------------------------

_NONE = "coalesce({0}::VARCHAR, 'NONE')"
_FATE = "'{' || array_to_string(list_sort(list_distinct(list_filter(coalesce(value_fate, []), lambda x: x IS NOT NULL))), ',') || '}'"
_ESC = "CASE WHEN escape_info IS NULL THEN 'NO_ESCAPE' ELSE coalesce(escape_info.kind, 'NONE') || '|' || coalesce(escape_info.value, 'NONE') END"
_FIELD_SQL = [(c, "ALL", _NONE.format(c)) for c in ("operation", "unit_role", "declaring_unit")]
_LAYER_SQL = {"applicable_reason": _NONE.format("applicable_reason"), "value_fate": _FATE, "escape": _ESC}
_FIELD_SQL = [("is_api_use", "ALL", "api"), *_FIELD_SQL, *[(c, "SOME_YES", m) for c, m in _LAYER_SQL.items()], *[(c, "ALT", _NONE.format(c)) for c in ("alt_equivalence", "exceeds_all_reasons")]]
_FIELD_SQL += [(f"{c}|bothYES", "ALL_YES", m) for c, m in ({"operation": _NONE.format("operation")} | _LAYER_SQL).items()]
_ALL_FIELDS = _LAST + f""", b AS (SELECT *, coalesce({_API}, 'NONE') AS api FROM a WHERE pass_name IS NOT NULL),
f AS ({" UNION ALL ".join(f"SELECT pass_name AS p, sid, api, site_class, '{n}' AS field, '{u}' AS universe, {m} AS m FROM b" for n, u, m in _FIELD_SQL)}),
i AS (SELECT l.p AS rater_a, r.p AS rater_b, l.field, l.sid, l.m AS a, r.m AS b FROM f l JOIN f r ON l.sid = r.sid AND l.field = r.field AND l.p < r.p
  WHERE CASE l.universe WHEN 'SOME_YES' THEN NOT (l.api = 'NO' AND r.api = 'NO') WHEN 'ALL_YES' THEN l.api = 'YES' AND r.api = 'YES' WHEN 'ALT' THEN coalesce(l.site_class = 'ALT', false) OR coalesce(r.site_class = 'ALT', false) ELSE true END)"""


def _latest_whole(spark: SparkSession, d: str) -> DataFrame:
    """Each pass's latest record of each site, whole, with is_api_use in one spelling."""
    a = table(spark, d, "annotation").where("site_id is not null and pass_name is not null").withColumn("sid", F.lower(strip(F.col("site_id"))))
    keep = ["site_class", "operation", "unit_role", "declaring_unit", "applicable_reason", "value_fate", "escape_info", "alt_equivalence", "exceeds_all_reasons"]
    m = F.struct(F.upper(strip(F.col("is_api_use"))).alias("is_api_use"), *keep)
    return a.groupBy("pass_name", "sid").agg(F.max_by(m, F.struct("annotated_at", "loaded_at", "ann_id")).alias("m")).select("pass_name", "sid", "m.*")


@query(_ALL_FIELDS + _COEF.format(g="rater_a, rater_b, field,", by="GROUP BY rater_a, rater_b, field", j="JOIN", u="USING (rater_a, rater_b, field)"))
def q53_field_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of every two passes on every rated field, each within its universe."""
    return agreement.coefficients(agreement.pair_fields(_latest_whole(spark, d), "sid", "pass_name"), [*BY, "field"])


@query(_LAST + ", c AS (SELECT sid, count(DISTINCT pass_name) AS n FROM a WHERE pass_name IS NOT NULL GROUP BY 1) SELECT pass_name, count(*) AS n_items, count_if(n = 1) AS n_alone FROM a JOIN c USING (sid) WHERE pass_name IS NOT NULL GROUP BY 1")
def q54_only_in_one(spark: SparkSession, d: str) -> DataFrame:
    return agreement.only_in_one(_latest(spark, d).where("pass_name is not null"), "sid", "pass_name")


@query("WITH r AS (" + ORACLE["q26_bootstrap_pairs"] + """), o AS (SELECT rater_a, rater_b, fleiss, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY rater_a, rater_b) AS n FROM r WHERE fleiss IS NOT NULL WINDOW w AS (PARTITION BY rater_a, rater_b ORDER BY fleiss))
SELECT rater_a, rater_b, max(n) AS n, max(CASE WHEN i = least(floor(0.025 * n), n - 1) THEN fleiss END) AS low, max(CASE WHEN i = least(floor(0.975 * n), n - 1) THEN fleiss END) AS high FROM o GROUP BY ALL""")
def q55_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """The middle 95 percent of the bootstrap replicates of every two passes, by nearest rank."""
    return gates.nearest_rank(q26_bootstrap_pairs(spark, d), BY, "fleiss", {"low": 0.025, "high": 0.975})


@query("""WITH u AS (SELECT unit_location, count(*) AS n FROM (SELECT DISTINCT site_id, unit_location FROM site WHERE unit_location IS NOT NULL AND site_id IS NOT NULL) GROUP BY 1),
b AS (SELECT *, least(n, 2) AS low, n - least(n, 2) AS room FROM u), s AS (SELECT *, sum(low) OVER () AS base, least(450, sum(n) OVER ()) - sum(low) OVER () AS extra, sum(room) OVER () AS rooms FROM b),
x AS (SELECT *, CASE WHEN rooms > 0 THEN extra * room / rooms ELSE 0 END AS e FROM s WHERE base <= 450), f AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, unit_location) AS r, CASE WHEN rooms > 0 THEN extra - sum(floor(e)) OVER () ELSE 0 END AS rest FROM x)
SELECT unit_location, n, CAST(low + f + (r <= rest)::INT AS BIGINT) AS seats FROM f""")
def q56_floored_seats(spark: SparkSession, d: str) -> DataFrame:
    """Two sites of every unit and the rest of 450 in proportion to what is left."""
    sizes = table(spark, d, "site").where("unit_location is not null and site_id is not null").select("site_id", "unit_location").distinct().groupBy("unit_location").agg(F.count(F.lit(1)).alias("n"))
    return apportion.floored_seats(sizes, "unit_location", "n", 450, 2)


_PAIRS_SQL = "SELECT u AS unit_location, string_agg(DISTINCT cat || '=' || reason, ';' ORDER BY cat || '=' || reason) AS c FROM ({0}) WHERE reason IS NOT NULL GROUP BY 1"


@query(f"""WITH a AS ({_PAIRS_SQL.format(_DECL.format(col='declares', t='batch'))}), b AS ({_PAIRS_SQL.format(_DECL.format(col='declared_reasons', t='site'))})
SELECT unit_location, CASE WHEN b.c IS NULL THEN 'SOURCE_ONLY' WHEN a.c IS NULL THEN 'SHIPPED_ONLY' WHEN sha256(a.c) = sha256(b.c) THEN 'IDENTICAL' ELSE 'DIFFERENT' END AS verdict FROM a FULL JOIN b USING (unit_location)""")
def q57_content_identity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the reasons that a unit declares in its batches and in its sites are the same, by hash of their sorted pairs."""
    def content(t: str, c: str) -> DataFrame:
        e = table(spark, d, t).where("unit_location is not null").select("unit_location", F.explode(c).alias("category", "rs")).select("unit_location", "category", F.explode("rs").alias("reason"))
        pair = F.concat_ws("=", "category", "reason")
        return e.where("reason is not null").groupBy("unit_location").agg(F.array_join(F.array_sort(F.collect_set(pair)), ";").alias("c"))

    return reconcile.reconcile_content(content("batch", "declares"), content("site", "declared_reasons"), "unit_location", "c")


_REPO = "nullif(regexp_replace(lower(regexp_replace(repo, '^\\s+|\\s+$', '', 'g')), '(\\.git|/)+$', ''), '')"


@query(f"""WITH t AS (SELECT {_REPO} AS r, frame, target_id, sha, state FROM targets WHERE frame IS NOT NULL), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, frame ORDER BY coalesce(state = 'CANDIDATE', false) DESC, target_id DESC) AS n FROM t WHERE r IS NOT NULL) WHERE n = 1),
b AS (SELECT r, min(frame) AS base FROM l GROUP BY 1), j AS (SELECT l.*, base FROM l JOIN b USING (r)), k AS (SELECT j.*, x.sha AS base_sha FROM j LEFT JOIN l x ON x.r = j.r AND x.frame = j.base)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(state, '') <> 'CANDIDATE' THEN 'NOT_CANDIDATE' WHEN coalesce(sha, '') = '' THEN 'NO_SHA' WHEN frame <> base AND base_sha IS NOT NULL AND sha <> base_sha THEN 'SHA_MISMATCH' ELSE 'OK' END AS reason FROM k) GROUP BY 1""")
def q58_comparable(spark: SparkSession, d: str) -> DataFrame:
    """Listings of a repo in later frames, held against its first frame: good ones of another commit can't be compared."""
    from ..functions.text import repo_key

    t = table(spark, d, "targets").where("frame is not null").select(repo_key(F.col("repo")).alias("r"), "frame", "target_id", "sha", "state").where("r is not null")
    t = gates.last_ok_wins(t, ["r", "frame"], F.col("state") == "CANDIDATE", [F.col("target_id")])
    first = t.groupBy("r").agg(F.min("frame").alias("base"))
    reason = ladders.ladder([("NOT_CANDIDATE", F.coalesce("state", F.lit("")) != "CANDIDATE"), ("NO_SHA", F.coalesce("sha", F.lit("")) == "")], "OK")
    t = t.join(first, "r").withColumn("config", F.when(F.col("frame") == F.col("base"), "base").otherwise("later")).withColumn("reason", reason)
    return gates.comparable(t, ["r"], "config", "base", "reason", "OK", {"sha": "SHA_MISMATCH"}).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT DISTINCT file FROM site WHERE file IS NOT NULL), o AS (SELECT regexp_replace(file, '/[^/]*$', '') AS dir FROM f WHERE contains(file, '/') GROUP BY 1 HAVING count(*) >= 5),
p AS (SELECT file, string_split(file, '/') AS x FROM f), a AS (SELECT file, i, array_to_string(x[1:i], '/') AS dir FROM (SELECT file, x, unnest(range(1, len(x))) AS i FROM p)),
h AS (SELECT file, arg_max(dir, i) AS nearest FROM a JOIN o USING (dir) GROUP BY 1) SELECT coalesce(nearest, 'NONE') AS nearest, count(*) AS n_files FROM f LEFT JOIN h USING (file) GROUP BY 1""")
def q59_nearest_owner(spark: SparkSession, d: str) -> DataFrame:
    """Folders that hold five files or more own what lies below them: the files that each owns as the deepest one."""
    files = table(spark, d, "site").where("file is not null").select("file").distinct()
    folder = F.regexp_replace("file", "/[^/]*$", "")
    owners = files.where(F.col("file").contains("/")).groupBy(folder.alias("dir")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return reconcile.nearest_ancestor(files, "file", owners, "dir").groupBy(F.coalesce("nearest", F.lit("NONE")).alias("nearest")).agg(F.count(F.lit(1)).alias("n_files"))
