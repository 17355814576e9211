"""Accounting of job manifests: every job in one bucket, every variant and bundle in one of its own, and the jobs that left no manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ladders import bucket_totals, ladder

# The buckets in the order in which they are reported, and what a scheme verdict comes to.
BUCKETS = [
    "OK", "MAP_BINARY_MISMATCH", "BUILT_NO_BINARY", "BUILT_NO_MAP", "BUILD_FAILED", "BUILD_NOT_ATTEMPTED", "NO_USABLE_MAP_MODE", "NO_APP_SCHEME", "NO_SHARED_SCHEMES", "PLATFORM_MISMATCH",
    "SCHEMES_JSON_UNREADABLE", "NO_XCODE_CONTAINER", "MANIFEST_MISSING",
]
VARIANT_BUCKETS = ["OK", "MAP_BINARY_MISMATCH", "STRIP_FAILED", "NO_BINARY", "STRIP_CHANGED_LAYOUT"]
BUNDLE_BUCKETS = ["OK", "OK_NO_PRIVACY_MANIFEST", "PACK_FAILED", "VERIFY_FAILED", "NO_APP_BUNDLE", "NOT_COLLECTED"]
SCHEME_VERDICTS = {
    "NO_APP_SCHEME_OBSERVED": "NO_APP_SCHEME", "NO_SHARED_SCHEMES": "NO_SHARED_SCHEMES", "PLATFORM_MISMATCH": "PLATFORM_MISMATCH", "SCHEMES_JSON_UNREADABLE": "SCHEMES_JSON_UNREADABLE",
    "SCHEME_STEP_CRASHED": "SCHEMES_JSON_UNREADABLE",
}
VARIANT = "struct<strip_style:string,binary_bytes:bigint,map_matches_binary:boolean,strip_did_run:boolean,strip_rc:int,strip_preserves_layout:boolean>"
SCHEMA = (
    "repo string, config_id string, scheme string, scheme_verdict string, map_verdict string, build_outcome string, maps_by_output_kind map<string,bigint>, "
    f"maps_with_requested_basename bigint, variants array<{VARIANT}>, strip_style string, binary_bytes bigint, map_matches_binary boolean, strip_did_run boolean, "
    "strip_rc int, strip_preserves_layout boolean, app_bundle string, bundle_zip string, bundle_verify struct<verdict:string>"
)


def parse(raw: DataFrame, text: str = "raw") -> DataFrame:
    """raw with the fields of SCHEMA, `readable`, `has_bundle` (the key bundle_zip stands there, if only as null), `legacy` and `all_variants`.

    A manifest without the list `variants` is of the old kind and gets one variant from its own fields.
    """
    m = F.from_json(text, SCHEMA)
    keys = F.json_object_keys(text)
    x = raw.withColumn("_m", m).withColumn("readable", keys.isNotNull()).withColumn("has_bundle", F.coalesce(F.array_contains(keys, "bundle_zip"), F.lit(False)))
    own = F.struct(F.coalesce("_m.strip_style", F.lit("none")).alias("strip_style"), *[F.col(f"_m.{c}").alias(c) for c in ("binary_bytes", "map_matches_binary", "strip_did_run", "strip_rc", "strip_preserves_layout")])
    legacy = F.col("readable") & F.col("_m.variants").isNull()
    return x.select(*raw.columns, "_m.*", "readable", "has_bundle", legacy.alias("legacy"), F.coalesce("_m.variants", F.when(F.col("readable"), F.array(own.cast(VARIANT)))).alias("all_variants"))


def job_bucket() -> Column:
    """The bucket of a parsed manifest; the first that fits."""
    outcome = F.lower(F.coalesce("build_outcome", F.lit("")))
    verdict = F.col("scheme_verdict")
    maps = F.when(F.col("maps_by_output_kind").isNotNull(), F.try_element_at("maps_by_output_kind", F.lit("APP_BUNDLE"))).otherwise(F.col("maps_with_requested_basename"))
    some = lambda p: F.exists("all_variants", lambda v: F.coalesce(p(v), F.lit(False)))
    return ladder([
        ("MANIFEST_MISSING", ~F.col("readable")), ("NO_XCODE_CONTAINER", F.coalesce(verdict, F.lit("")) == ""), *[(b, verdict == v) for v, b in SCHEME_VERDICTS.items()],
        ("NO_USABLE_MAP_MODE", F.col("map_verdict") == "NO_USABLE_MAP_MODE"), ("BUILD_NOT_ATTEMPTED", outcome == "skipped"), ("BUILD_FAILED", outcome != "success"),
        ("BUILT_NO_MAP", F.coalesce(maps, F.lit(0)) == 0), ("BUILT_NO_BINARY", ~some(lambda v: v["binary_bytes"] > 0)), ("MAP_BINARY_MISMATCH", ~some(lambda v: v["map_matches_binary"])),
    ], "OK")


def variant_bucket(v: Column) -> Column:
    """The bucket of one variant; a table that was not measured is a mismatch, not a match."""
    return ladder([
        ("STRIP_FAILED", v["strip_did_run"] & (v["strip_rc"] != 0)), ("NO_BINARY", F.coalesce(v["binary_bytes"], F.lit(0)) == 0),
        ("STRIP_CHANGED_LAYOUT", ~v["strip_preserves_layout"]), ("MAP_BINARY_MISMATCH", ~F.coalesce(v["map_matches_binary"], F.lit(False))),
    ], "OK")


def bundle_bucket() -> Column:
    """The bucket of a parsed manifest's bundle: not collected then is not the same as collected and empty."""
    verdict = F.coalesce("bundle_verify.verdict", F.lit(""))
    return ladder([
        ("NOT_COLLECTED", ~F.col("has_bundle")), ("NO_APP_BUNDLE", F.coalesce("app_bundle", F.lit("")) == ""), ("PACK_FAILED", F.coalesce("bundle_zip", F.lit("")) == ""),
        ("OK", verdict == "OK"), ("OK_NO_PRIVACY_MANIFEST", verdict == "OK_NO_PRIVACY_MANIFEST"),
    ], "VERIFY_FAILED")


def account(manifests: DataFrame, expected: int) -> DataFrame:
    """(level, bucket, n): jobs, variants and bundles of parsed manifests, empty buckets with 0; jobs without a manifest count as MANIFEST_MISSING."""
    jobs = bucket_totals(manifests, job_bucket(), BUCKETS, F.lit(expected), "MANIFEST_MISSING")
    variants = bucket_totals(manifests.select(F.explode("all_variants").alias("v")), variant_bucket(F.col("v")), VARIANT_BUCKETS)
    bundles = bucket_totals(manifests.where("readable"), bundle_bucket(), BUNDLE_BUCKETS)
    parts = [df.select(F.lit(level).alias("level"), "bucket", "n") for level, df in (("job", jobs), ("variant", variants), ("bundle", bundles))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rates(manifests: DataFrame, expected: int) -> DataFrame:
    """(grain, n, n_ok, rate) of jobs (of all expected ones), repositories with an OK job, and variants."""
    ok = job_bucket() == "OK"
    rate = lambda df, n: df.select("grain", n.cast("long").alias("n"), "n_ok", F.coalesce(F.round(F.try_divide("n_ok", n), 4), F.lit(0.0)).alias("rate"))
    count = lambda df, grain: df.groupBy().agg(F.lit(grain).alias("grain"), F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))
    job = count(manifests.select(ok.alias("ok")), "job")
    repo = count(manifests.where("repo is not null").groupBy("repo").agg(F.bool_or(ok).alias("ok")), "repo")
    variant = count(manifests.select(F.explode("all_variants").alias("v")).select((variant_bucket(F.col("v")) == "OK").alias("ok")), "variant")
    return rate(job, F.greatest(F.col("n"), F.lit(expected))).unionByName(rate(repo, F.col("n"))).unionByName(rate(variant, F.col("n")))
