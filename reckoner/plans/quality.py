"""Queries of the general data problems: drift (p1), heavy keys (p4) and orphan references (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import drift, orphans, skew
from ..session import cut
from .tables import table

HEAVY_SHARE = 0.03


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "annotation_raw")).select("file_name", "field", "change").distinct()


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "annotation_raw"))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Of every unified record the two fields that drift: the tri-state, and how many constraints and which scalars it has."""
    u = drift.unify(table(spark, d, "annotation_raw"))
    scalars = F.array_join(F.array_sort(F.transform(F.map_entries("constraint_verdicts"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["scalar"], F.lit("MIXED"))))), ";")
    return u.select("file_name", "line_no", "exceeds_all_reasons", scalars.alias("verdicts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        skew.heavy_keys(table(spark, d, t), "unit_location", HEAVY_SHARE).select(F.lit(t).alias("table_name"), "unit_location")
        for t in ("site", "annotation", "documents")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts per unit, pass and value, next to the number of sites of the unit (null: the unit has no site)."""
    site = table(spark, d, "site").where("unit_location is not null").groupBy("unit_location").agg(F.countDistinct("site_id").alias("n_sites"))
    verdict = F.when(F.size(F.coalesce(F.map_keys("v.value.by_domain"), F.array())) > 0, "MIXED").otherwise(F.col("v.value.scalar"))
    marks = (
        table(spark, d, "annotation").where("unit_location is not null")
        .select("unit_location", "pass_name", F.explode(F.map_entries("constraint_verdicts")).alias("v")).select("unit_location", "pass_name", verdict.alias("verdict"))
    )
    # Counted first, so the join has a row per unit, pass and verdict and no hot unit.
    counts = marks.groupBy("unit_location", "pass_name", "verdict").agg(F.count(F.lit(1)).alias("n_verdicts"))
    return counts.join(site, "unit_location", "left")


def p4_early(spark: SparkSession, d: str) -> DataFrame:
    """Per unit and pass the records, and those made before the unit's sites were all scanned: every record meets its unit, so hot units are joined by broadcast."""
    site = table(spark, d, "site").where("unit_location is not null").groupBy("unit_location").agg(F.max("scanned_at").alias("scanned"))
    a = table(spark, d, "annotation").where("unit_location is not null").select("unit_location", "pass_name", "annotated_at")
    joined = skew.skew_join(a, site, "unit_location", share=HEAVY_SHARE, how="left")
    return joined.groupBy("unit_location", "pass_name").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("annotated_at") < F.col("scanned")).alias("n_early"))


def p4_categories(spark: SparkSession, d: str) -> DataFrame:
    """Sites per unit and category, repeated rows as they lie; Spark combines before it shuffles, so a hot unit is a row per task."""
    s = table(spark, d, "site").where("unit_location is not null")
    return s.groupBy("unit_location", "category").agg(F.count(F.lit(1)).alias("n_rows"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.site_orphans(table(spark, d, "annotation"), table(spark, d, "site"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ann_id", "field", "site_ref", "reason")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring table, column, month of annotated_at and reason."""
    return _orphans(spark, d).groupBy(F.lit("annotation").alias("table_name"), "field", "month", "reason").agg(F.count(F.lit(1)).alias("n_refs"))


def p5_semantics(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of the composite reference (unit_location, site_id) of annotation to site, under each of the match semantics."""
    t = table(spark, d, "site").select("unit_location", F.lower(F.trim("site_id")).alias("site_id"), "scanned_at", "dropped_at")
    r = table(spark, d, "annotation").select("ann_id", "unit_location", F.lower(strip(F.col("site_id"))).alias("site_id"), "annotated_at").distinct()
    t, r = cut(t.distinct()), cut(r)
    parts = [
        orphans.find_orphans(r, t, None, ["unit_location", "site_id"], "annotated_at", "scanned_at", "dropped_at", match=m).groupBy(F.lit(m).alias("semantics"), "reason").agg(F.count(F.lit(1)).alias("n_refs"))
        for m in ("partial", "simple", "full")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p1_values, p4_found, p4_verdicts, p4_early, p4_categories, p5_found, p5_counts, p5_semantics)}

_CHANGES = """
WITH lines AS (SELECT DISTINCT run_id, file_seq, file_name, raw FROM annotation_raw WHERE NOT regexp_matches(raw, '^\\s*(#|$)') AND json_valid(raw)),
keyed AS (SELECT run_id, file_seq, file_name, raw, unnest(json_keys(raw)) AS key FROM lines),
named AS (SELECT run_id, file_seq, file_name, key, json_type(json_extract(raw, '$."' || key || '"')) AS jt,
  CASE WHEN key IN ('exceeds_reasons', 'exceeds_all', 'beyond_all_reasons', 'exceedsAllReasons') THEN 'exceeds_all_reasons'
       WHEN key IN ('verdicts', 'constraintVerdicts', 'constraint_results', 'verdict_by_constraint') THEN 'constraint_verdicts' ELSE key END AS field FROM keyed),
prof AS (SELECT run_id, file_seq, file_name, field, min(key) AS key,
  string_agg(DISTINCT CASE WHEN jt = 'VARCHAR' THEN 's' WHEN jt = 'BOOLEAN' THEN 'b' WHEN jt = 'ARRAY' THEN 'a' WHEN jt = 'OBJECT' THEN 'o' WHEN jt <> 'NULL' THEN 'n' END, ',' ORDER BY CASE WHEN jt = 'VARCHAR' THEN 's' WHEN jt = 'BOOLEAN' THEN 'b' WHEN jt = 'ARRAY' THEN 'a' WHEN jt = 'OBJECT' THEN 'o' WHEN jt <> 'NULL' THEN 'n' END) AS types
  FROM named GROUP BY ALL),
files AS (SELECT run_id, file_seq, file_name, lag(file_name) OVER (PARTITION BY run_id ORDER BY file_seq, file_name) AS before FROM (SELECT DISTINCT run_id, file_seq, file_name FROM prof)),
a AS (SELECT f.file_name, p.field, p.key, p.types FROM files f JOIN prof p ON p.run_id = f.run_id AND p.file_name = f.before),
b AS (SELECT f.file_name, p.field, p.key, p.types FROM files f JOIN prof p ON p.run_id = f.run_id AND p.file_name = f.file_name WHERE f.before IS NOT NULL),
j AS (SELECT coalesce(a.file_name, b.file_name) AS file_name, coalesce(a.field, b.field) AS field, a.key AS ka, b.key AS kb, a.types AS ta, b.types AS tb
  FROM a FULL JOIN b ON a.file_name = b.file_name AND a.field = b.field)
SELECT file_name, field, 'ADDED' AS change FROM j WHERE ka IS NULL UNION ALL SELECT file_name, field, 'REMOVED' FROM j WHERE kb IS NULL
UNION ALL SELECT file_name, field, 'RENAMED' FROM j WHERE ka <> kb UNION ALL SELECT file_name, field, 'RETYPED' FROM j WHERE ta <> tb
"""

_VALUES = """
WITH l AS (SELECT file_name, line_no, arg_min(raw, arrived_at) AS raw FROM annotation_raw WHERE NOT regexp_matches(raw, '^\\s*(#|$)') AND json_valid(raw) AND json_type(raw) = 'OBJECT' GROUP BY ALL),
v AS (SELECT file_name, line_no, coalesce(raw->'$.exceeds_all_reasons', raw->'$.exceeds_reasons', raw->'$.exceeds_all', raw->'$.beyond_all_reasons', raw->'$.exceedsAllReasons') AS x,
  coalesce(raw->'$.constraint_verdicts', raw->'$.verdicts', raw->'$.constraintVerdicts', raw->'$.constraint_results', raw->'$.verdict_by_constraint') AS c FROM l),
t AS (SELECT *, upper(CASE json_type(x) WHEN 'ARRAY' THEN x->>'$[0]' WHEN 'OBJECT' THEN x->>'$.value' WHEN 'NULL' THEN NULL ELSE x->>'$' END) AS s,
  CASE WHEN json_type(c) = 'VARCHAR' AND json_valid(c->>'$') AND (c->>'$') LIKE '{%' THEN (c->>'$')::JSON ELSE c END AS o FROM v),
k AS (SELECT file_name, line_no, s, CASE json_type(o)
    WHEN 'OBJECT' THEN [id || '=' || coalesce(CASE WHEN json_type(o->id) = 'VARCHAR' THEN o->>id END, 'MIXED') FOR id IN json_keys(o)]
    WHEN 'ARRAY' THEN [CASE WHEN json_type(e) = 'OBJECT' THEN (e->>'$.id') || '=' || coalesce(CASE WHEN json_type(e->'$.verdict') = 'VARCHAR' THEN e->>'$.verdict' END, 'MIXED')
                       ELSE (e->>'$[0]') || '=' || coalesce(CASE WHEN json_type(e->'$[1]') = 'VARCHAR' THEN e->>'$[1]' END, 'MIXED') END FOR e IN CAST(o AS JSON[])]
    WHEN 'VARCHAR' THEN [p FOR p IN string_split(o->>'$', ';') IF contains(p, '=')] END AS vs FROM t)
SELECT file_name, line_no, CASE WHEN s IN ('TRUE', '1') THEN 'YES' WHEN s IN ('FALSE', '0') THEN 'NO' WHEN s = '-1' THEN 'UNKNOWN' ELSE s END AS exceeds_all_reasons, array_to_string(list_sort(vs), ';') AS verdicts FROM k
"""

_REFS = r"""
WITH n AS (SELECT ann_id, annotated_at, unit_location, notes, regexp_replace(notes, '(?:defined in|@)\s*[\w+./-]+\.\w+:\d+', ' ', 'g') AS m FROM annotation),
r AS (
  SELECT ann_id, annotated_at, 'site_id' AS field, lower(regexp_replace(site_id, '\s+', '', 'g')) AS site_ref, 'full' AS kind, NULL AS u FROM annotation WHERE site_id IS NOT NULL
  UNION ALL SELECT ann_id, annotated_at, 'notes', lower(trim(x, '`[]=: ')), 'full', NULL FROM (SELECT *, unnest(regexp_extract_all(' ' || replace(notes, '...', '…') || ' ', '(?:^|[^0-9A-Za-z@_-])([0-9A-Fa-f]{16})(?:[^0-9A-Za-z_…-]|$)', 1)) AS x FROM n)
  UNION ALL SELECT ann_id, annotated_at, 'notes', lower(x), 'short', NULL FROM (SELECT *, unnest(regexp_extract_all(' ' || replace(notes, '...', '…'), '[^0-9A-Za-z@_-]([0-9A-Fa-f]{12})\s*…', 1)) AS x FROM n)
  UNION ALL SELECT ann_id, annotated_at, 'notes', x, 'place', unit_location FROM (SELECT *, unnest(regexp_extract_all(m, '[\w+-][\w+./-]*\.[A-Za-z]\w*:\d+', 0)) AS x FROM n)),
d AS (SELECT DISTINCT * FROM r),
s AS (SELECT DISTINCT lower(trim(site_id)) AS sid, substr(lower(trim(site_id)), 1, 12) AS pre, unit_location AS u, file || ':' || line AS place, scanned_at, dropped_at FROM site),
t AS (SELECT d.*, s.sid, s.scanned_at, s.dropped_at FROM d LEFT JOIN s ON d.kind = 'full' AND s.sid = d.site_ref WHERE d.kind = 'full'
  UNION ALL SELECT d.*, s.sid, s.scanned_at, s.dropped_at FROM d LEFT JOIN s ON s.pre = d.site_ref WHERE d.kind = 'short'
  UNION ALL SELECT d.*, s.sid, s.scanned_at, s.dropped_at FROM d LEFT JOIN s ON s.place = d.site_ref AND s.u = d.u WHERE d.kind = 'place' AND d.u IS NOT NULL
  UNION ALL SELECT d.*, s.sid, s.scanned_at, s.dropped_at FROM d LEFT JOIN s ON s.place = d.site_ref WHERE d.kind = 'place' AND d.u IS NULL),
o AS (SELECT ann_id, field, site_ref, min(strftime(annotated_at, '%Y-%m')) AS month,
    CASE WHEN count(sid) = 0 THEN 'MISSING' WHEN bool_or(scanned_at <= annotated_at) THEN 'DELETED' ELSE 'LATE' END AS reason
  FROM t GROUP BY ann_id, field, site_ref
  HAVING NOT coalesce(bool_or(sid IS NOT NULL AND scanned_at <= annotated_at AND (dropped_at IS NULL OR annotated_at < dropped_at)), false))
"""

ORACLE = {
    "p1_found": _CHANGES,
    "p1_values": _VALUES,
    "p4_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, unit_location FROM {t} WHERE unit_location IS NOT NULL GROUP BY unit_location HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM {t})"
        for t in ("site", "annotation", "documents")
    ),
    "p4_categories": "SELECT unit_location, category, count(*) AS n_rows FROM site WHERE unit_location IS NOT NULL GROUP BY ALL",
    "p4_verdicts": """
WITH v AS (SELECT unit_location, pass_name, unnest(map_values(constraint_verdicts)) AS v FROM annotation WHERE unit_location IS NOT NULL),
m AS (SELECT unit_location, pass_name, CASE WHEN cardinality(v.by_domain) > 0 THEN 'MIXED' ELSE v.scalar END AS verdict FROM v),
s AS (SELECT unit_location, count(DISTINCT site_id) AS n_sites FROM site GROUP BY 1)
SELECT m.unit_location, pass_name, verdict, count(*) AS n_verdicts, max(n_sites) AS n_sites FROM m LEFT JOIN s USING (unit_location) GROUP BY ALL""",
    "p4_early": """
WITH s AS (SELECT unit_location, max(scanned_at) AS scanned FROM site GROUP BY 1)
SELECT a.unit_location, pass_name, count(*) AS n_records, count_if(annotated_at < scanned) AS n_early FROM annotation a LEFT JOIN s USING (unit_location) WHERE a.unit_location IS NOT NULL GROUP BY ALL""",
    "p5_semantics": """
WITH t AS (SELECT DISTINCT unit_location AS u, lower(trim(site_id)) AS s, scanned_at, dropped_at FROM site),
r AS (SELECT DISTINCT ann_id, unit_location AS u, lower(regexp_replace(site_id, '^\\s+|\\s+$', '', 'g')) AS s, annotated_at AS at FROM annotation WHERE unit_location IS NOT NULL OR site_id IS NOT NULL),
b AS (SELECT u, s, min(coalesce(scanned_at, TIMESTAMP '0001-01-01')) AS first, TRUE AS known FROM t GROUP BY ALL), us AS (SELECT DISTINCT s FROM t), uu AS (SELECT u, min(coalesce(scanned_at, TIMESTAMP '0001-01-01')) AS first, TRUE AS known FROM t GROUP BY 1),
ss AS (SELECT s, min(coalesce(scanned_at, TIMESTAMP '0001-01-01')) AS first, TRUE AS known FROM t GROUP BY 1),
x AS (SELECT 'both' AS mask, CASE WHEN b.known IS NULL THEN 'MISSING' WHEN b.first <= r.at THEN 'DELETED' ELSE 'LATE' END AS reason FROM r LEFT JOIN b USING (u, s) WHERE r.u IS NOT NULL AND r.s IS NOT NULL
    AND NOT EXISTS (FROM t WHERE t.u = r.u AND t.s = r.s AND coalesce(t.scanned_at <= r.at, TRUE) AND coalesce(r.at < t.dropped_at, TRUE))
  UNION ALL SELECT 'part', CASE WHEN ss.known IS NULL THEN 'MISSING' WHEN ss.first <= r.at THEN 'DELETED' ELSE 'LATE' END FROM r LEFT JOIN ss USING (s) WHERE r.u IS NULL AND r.s IS NOT NULL
    AND NOT EXISTS (FROM t WHERE t.s = r.s AND coalesce(t.scanned_at <= r.at, TRUE) AND coalesce(r.at < t.dropped_at, TRUE))
  UNION ALL SELECT 'part', CASE WHEN uu.known IS NULL THEN 'MISSING' WHEN uu.first <= r.at THEN 'DELETED' ELSE 'LATE' END FROM r LEFT JOIN uu USING (u) WHERE r.s IS NULL AND r.u IS NOT NULL
    AND NOT EXISTS (FROM t WHERE t.u = r.u AND coalesce(t.scanned_at <= r.at, TRUE) AND coalesce(r.at < t.dropped_at, TRUE)))
SELECT 'partial' AS semantics, reason, count(*) AS n_refs FROM x GROUP BY ALL UNION ALL SELECT 'simple', reason, count(*) FROM x WHERE mask = 'both' GROUP BY ALL
UNION ALL SELECT 'full', reason, count(*) FROM (SELECT reason FROM x WHERE mask = 'both' UNION ALL SELECT 'MISSING' FROM r WHERE u IS NULL OR s IS NULL) GROUP BY ALL""",
    "p5_found": _REFS + "SELECT ann_id, field, site_ref, reason FROM o",
    "p5_counts": _REFS + "SELECT 'annotation' AS table_name, field, month, reason, count(*) AS n_refs FROM o GROUP BY ALL",
}
