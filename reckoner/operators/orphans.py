"""References to records that do not exist, do not exist any more, or do not exist yet.

References are composite keys with partial nulls. They are grouped by null mask; each mask is anti-joined on its non-null columns alone, and the
declared match semantics say which masks are looked at:

- MATCH PARTIAL: a reference is satisfied by any target that agrees on the columns it has.
- MATCH SIMPLE: a reference with a null among the declared columns is not checked.
- MATCH FULL: a reference with a null among the declared columns is an orphan (MISSING too), whatever targets there are.

A reference whose columns are all null is no reference. reason is MISSING (no target with these columns), DELETED (one was there, its end known and
reached) or LATE (they all began later); a target of unknown beginning has always been there. Where the reference has no time, a target counts at any
time, so only MISSING can be found. Repeated references and repeated targets count once. Empty tables give an
empty result, except that without targets every reference is MISSING.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def find_orphans(
    refs: DataFrame, targets: DataFrame, masks: list[list[str]] | None, columns: list[str], at: str, since: str, until: str, match: str = "partial"
) -> DataFrame:
    """refs with the column `reason` added, those alone that no target satisfies.

    refs holds the key columns and `at`; targets holds them with `since` and `until` (null: still there). masks lists the sets of non-null
    columns that MATCH PARTIAL looks at; None: all sets that refs has, by a small aggregate. Both frames are read once for each mask, so
    callers give them cut or cached.
    """
    if match not in ("partial", "simple", "full"):
        raise ValueError("match is partial, simple or full")
    has = lambda mask: reduce(Column.__and__, [F.col(c).isNotNull() if c in mask else F.col(c).isNull() for c in columns])
    if match != "partial":
        masks = [list(columns)]
    elif masks is None:
        seen = refs.select(*[F.col(c).isNotNull().alias(c) for c in columns]).distinct().collect()  # at most 2 ^ columns
        masks = sorted(m for m in ([c for c in columns if r[c]] for r in seen) if m)
    parts = []
    for mask in masks:
        keys = [f"_k{i}" for i in range(len(mask))]
        there = targets.select(*[F.col(c).alias(k) for c, k in zip(mask, keys)], F.col(since).alias("_since"), F.col(until).alias("_until"))
        there = there.dropna(subset=keys).distinct()
        same = reduce(Column.__and__, [F.col(c) == F.col(k) for c, k in zip(mask, keys)])
        begun = F.col("_since").isNull() | F.col(at).isNull() | (F.col("_since") <= F.col(at))
        alive = begun & (F.col("_until").isNull() | F.col(at).isNull() | (F.col(at) < F.col("_until")))
        orphans = refs.where(has(mask)).join(there, same & alive, "left_anti")
        ever = there.groupBy(*keys).agg(F.min("_since").alias("_first"), F.bool_or(F.col("_since").isNull()).alias("_always"))
        reason = F.when(F.col(keys[0]).isNull(), "MISSING").when(F.col("_always") | (F.col("_first") <= F.col(at)), "DELETED").otherwise("LATE")
        parts.append(orphans.join(ever, same, "left").withColumn("reason", reason).drop(*keys, "_first", "_always"))
    if match == "full":
        some = reduce(Column.__or__, [F.col(c).isNotNull() for c in columns])
        parts.append(refs.where(some & ~has(columns)).withColumn("reason", F.lit("MISSING")))
    if not parts:
        return refs.limit(0).withColumn("reason", F.lit("MISSING"))
    return reduce(DataFrame.unionByName, parts)


# How notes name a site, and what looks alike but is no reference.
FULL_ID = r"(?<![0-9A-Za-z@_-])([0-9A-Fa-f]{16})(?![0-9A-Za-z_-]|\.\.\.|…)"
SHORT_ID = r"(?<![0-9A-Za-z@_-])([0-9A-Fa-f]{12})\s*(?:…|\.\.\.)"
DEFINITION = r"(?:defined in|declared in|定义在|定义于|@)\s*[\w+./-]+\.\w+:\d+"
PLACE = r"(?<![\w/.+-])([\w+-][\w+./-]*\.[A-Za-z]\w*:\d+)(?![\w:])"


def site_references(annotation: DataFrame) -> DataFrame:
    """(ann_id, annotated_at, field, site_ref, site_id, prefix, unit_location, file, line): one row per reference.

    site_id gives a full id; notes give full ids, ids of twelve digits with an ellipsis, and file:line within the
    record's own unit. Addresses (0x...), revisions (@...), longer or shorter hashes and uuids fail the bounds of
    the patterns; a line beyond all numbers is -1, which no site has; the place of a definition is cut out before places are read; quoted lines name `file Lnn`.
    """
    lower = lambda c: F.lower(c)
    notes = F.regexp_replace("notes", DEFINITION, " ")
    full = F.transform(F.regexp_extract_all("notes", F.lit(FULL_ID), F.lit(1)), lambda x: F.struct(F.lit("full").alias("kind"), lower(x).alias("ref")))
    short = F.transform(F.regexp_extract_all("notes", F.lit(SHORT_ID), F.lit(1)), lambda x: F.struct(F.lit("short").alias("kind"), lower(x).alias("ref")))
    place = F.transform(F.regexp_extract_all(notes, F.lit(PLACE), F.lit(1)), lambda x: F.struct(F.lit("place").alias("kind"), x.alias("ref")))
    none = F.array().cast("array<struct<kind:string,ref:string>>")
    own = F.lower(F.regexp_replace("site_id", r"\s+|…|\.\.\.", ""))
    base = annotation.select("ann_id", "annotated_at", "unit_location", "site_id", "notes")
    in_notes = base.where(F.col("notes").rlike("[0-9A-Fa-f]{12}|:[0-9]")).select(
        "ann_id", "annotated_at", "unit_location", F.lit("notes").alias("field"),
        F.explode(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in (full, short, place)]))).alias("r"),
    )
    in_id = base.where(own != "").select(
        "ann_id", "annotated_at", "unit_location", F.lit("site_id").alias("field"), F.struct(F.lit("full").alias("kind"), own.alias("ref")).alias("r")
    )
    kind, ref = F.col("r.kind"), F.col("r.ref")
    return in_id.unionByName(in_notes).select(
        "ann_id", "annotated_at", "field", ref.alias("site_ref"),
        F.when(kind == "full", ref).alias("site_id"), F.when(kind == "short", ref).alias("prefix"),
        F.when(kind == "place", F.col("unit_location")).alias("unit_location"),
        F.when(kind == "place", F.regexp_extract(ref, r"^(.*):\d+$", 1)).alias("file"),
        F.when(kind == "place", F.expr("coalesce(try_cast(regexp_extract(r.ref, ':([0-9]+)$', 1) as bigint), -1)")).alias("line"),
    )


def site_orphans(annotation: DataFrame, site: DataFrame) -> DataFrame:
    """(ann_id, field, site_ref, reason, month): every reference of annotation to a site that cannot be resolved."""
    # Both are cut, so the patterns run once over each note and not once for each mask.
    targets = cut(site.select(F.lower(F.trim("site_id")).alias("site_id"), "unit_location", "file", "line", "scanned_at", "dropped_at").distinct().withColumn("prefix", F.substring("site_id", 1, 12)))
    refs = cut(site_references(annotation))
    found = find_orphans(refs, targets, None, ["site_id", "prefix", "unit_location", "file", "line"], "annotated_at", "scanned_at", "dropped_at")
    return found.groupBy("ann_id", "field", "site_ref").agg(
        F.min_by("reason", F.struct("annotated_at", "reason")).alias("reason"), F.min(F.date_format("annotated_at", "yyyy-MM")).alias("month")
    )
