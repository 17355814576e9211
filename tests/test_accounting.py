"""Manifest accounting, comparable configurations, floors, agreement over fields: cases with known results."""

import json

import pytest
from pyspark.sql import functions as F

from reckoner.operators import agreement, apportion, gates, manifests, reconcile
from reckoner.session import ensure_checkpoint_dir
from reckoner.sources import jsonl, linkmap, sinks


def variant(style="all", ok=True, **more):
    return {"strip_style": style, "binary_bytes": 777, "map_matches_binary": ok, "strip_did_run": style != "none", "strip_rc": None if style == "none" else 0, "strip_preserves_layout": True} | more


def manifest(**more):
    return {"repo": "o/r", "config_id": "base", "scheme_verdict": "APP_SCHEME_FOUND", "map_verdict": "MAP_MODE_CHOSEN", "build_outcome": "success", "maps_by_output_kind": {"APP_BUNDLE": 1}, "variants": [variant("none"), variant()]} | more


def no(m, key):
    return {k: v for k, v in m.items() if k != key}


JOBS = [
    ("OK", manifest()), ("BUILD_FAILED", manifest(build_outcome="Failure", variants=[])), ("BUILT_NO_MAP", manifest(maps_by_output_kind={"PRELINK_OBJECT": 30})), ("BUILT_NO_BINARY", manifest(variants=[variant(binary_bytes=None)])),
    ("NO_APP_SCHEME", manifest(scheme_verdict="NO_APP_SCHEME_OBSERVED")), ("NO_USABLE_MAP_MODE", manifest(map_verdict="NO_USABLE_MAP_MODE")), ("OK", manifest(config_id="lto", scheme_verdict="APP_SCHEME_AMBIGUOUS")),
    ("BUILD_NOT_ATTEMPTED", manifest(build_outcome="skipped", variants=[])), ("MAP_BINARY_MISMATCH", manifest(variants=[variant(ok=False)])), ("MAP_BINARY_MISMATCH", manifest(variants=[variant(ok=None)])),
    ("NO_XCODE_CONTAINER", manifest(scheme_verdict=None)), ("SCHEMES_JSON_UNREADABLE", manifest(scheme_verdict="SCHEME_STEP_CRASHED")),
    ("OK", no(no(manifest(), "variants"), "maps_by_output_kind") | {"maps_with_requested_basename": 1, "binary_bytes": 5, "map_matches_binary": True}), ("MANIFEST_MISSING", "{unreadable"),
]


def test_manifests_are_accounted_for(spark):
    raw = spark.createDataFrame([(i, m if isinstance(m, str) else json.dumps(m)) for i, (_, m) in enumerate(JOBS)], "job int, raw string")
    m = manifests.parse(raw)
    assert [r.b for r in m.select("job", manifests.job_bucket().alias("b")).orderBy("job").collect()] == [b for b, _ in JOBS]
    got = {(r.level, r.bucket): r.n for r in manifests.account(m, 16).collect()}
    assert sum(n for (level, _), n in got.items() if level == "job") == 16 and got["job", "MANIFEST_MISSING"] == 3 and got["job", "PLATFORM_MISMATCH"] == 0
    assert got["variant", "OK"] == 15 and got["variant", "MAP_BINARY_MISMATCH"] == 2 and got["variant", "NO_BINARY"] == 1 and got["bundle", "NOT_COLLECTED"] == 13
    assert {(r.grain, r.n, r.n_ok, r.rate) for r in manifests.rates(m, 16).collect()} == {("job", 16, 3, 0.1875), ("repo", 1, 1, 1.0), ("variant", 18, 15, 0.8333)}
    assert m.where("legacy").count() == 1 and sum(r.n for r in manifests.account(m.limit(0), 0).collect()) == 0


def test_variant_and_bundle_buckets(spark):
    vs = [("STRIP_FAILED", variant(strip_rc=1)), ("STRIP_CHANGED_LAYOUT", variant(strip_preserves_layout=False)), ("NO_BINARY", variant(binary_bytes=0)), ("OK", variant(strip_did_run=None, strip_rc=1))]
    bundles = [("NOT_COLLECTED", {}), ("NO_APP_BUNDLE", {"bundle_zip": None}), ("PACK_FAILED", {"bundle_zip": None, "app_bundle": "A.app"}), ("OK", {"bundle_zip": "z", "app_bundle": "A", "bundle_verify": {"verdict": "OK"}}),
               ("OK_NO_PRIVACY_MANIFEST", {"bundle_zip": "z", "app_bundle": "A", "bundle_verify": {"verdict": "OK_NO_PRIVACY_MANIFEST"}}), ("VERIFY_FAILED", {"bundle_zip": "z", "app_bundle": "A", "bundle_verify": None})]
    raw = [(i, json.dumps(manifest(variants=[v]))) for i, (_, v) in enumerate(vs)] + [(10 + i, json.dumps(manifest(**b))) for i, (_, b) in enumerate(bundles)]
    m = manifests.parse(spark.createDataFrame(raw, "job int, raw string"))
    got = m.where("job < 10").orderBy("job").select(manifests.variant_bucket(F.col("all_variants")[0]).alias("b")).collect()
    assert [r.b for r in got] == [b for b, _ in vs]
    assert [r.b for r in m.where("job >= 10").orderBy("job").select(manifests.bundle_bucket().alias("b")).collect()] == [b for b, _ in bundles]


def test_comparable_and_complete(spark):
    rows = [("a", "base", "s1", "x", "OK"), ("a", "lto", "s1", "x", "OK"), ("b", "base", "s1", "x", "OK"), ("b", "lto", "s2", "x", "OK"), ("c", "base", "s1", "x", "OK"), ("c", "lto", "s1", "y", "OK"),
            ("d", "base", None, None, "OK"), ("d", "lto", "s9", "z", "OK"), ("e", "lto", "s1", "x", "OK"), ("f", "base", "s1", "x", "BUILD_FAILED"), ("f", "lto", "s2", "x", "NO_APP_MAP")]
    df = spark.createDataFrame(rows, "repo string, config string, sha string, toolchain string, reason string")
    r = gates.comparable(df, ["repo"], "config", "base", "reason", "OK", {"sha": "SHA_MISMATCH", "toolchain": "TOOLCHAIN_MISMATCH"})
    got = {x.repo: (x.complete, dict(x.excluded)) for x in gates.complete(r, ["repo"], "config", ["base", "lto"], "reason", "OK", "NO_MANIFEST").collect()}
    assert got == {
        "a": (True, {}), "b": (False, {"lto": "SHA_MISMATCH"}), "c": (False, {"lto": "TOOLCHAIN_MISMATCH"}), "d": (True, {}), "e": (False, {"base": "NO_MANIFEST"}),
        "f": (False, {"base": "BUILD_FAILED", "lto": "NO_APP_MAP"}),
    }


def test_floored_seats(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 2)], "u string, n long")
    seats = lambda n: {r.u: r.seats for r in apportion.floored_seats(sizes, "u", "n", n, 2).collect()}
    assert sum(seats(30).values()) == 30 and seats(30)["c"] == 2 and seats(30)["b"] >= 2
    assert seats(112) == seats(500) == {"a": 100, "b": 10, "c": 2} and seats(3) == {}


def test_fields_keep_to_their_universe(spark):
    cols = "sid string, pass_name string, is_api_use string, site_class string, operation string, unit_role string, declaring_unit string, applicable_reason string, value_fate array<string>, escape_info struct<kind:string,value:string>, alt_equivalence string, exceeds_all_reasons string"
    rec = lambda sid, p, api, c="RRA", fate=(), esc=None: (sid, p, api, c, "READ", None, None, None, list(fate), esc, None, None)
    df = spark.createDataFrame([rec("1", "a", "YES", fate="BA"), rec("1", "b", "YES", fate="AB"), rec("2", "a", "NO"), rec("2", "b", "NO"), rec("3", "a", "YES", "ALT", esc=("K", "V")), rec("3", "b", "NO"), rec("4", "a", "YES")], cols)
    p = agreement.pair_fields(df, "sid", "pass_name")
    n = {r.field: r["count"] for r in p.groupBy("field").count().collect()}
    assert (n["is_api_use"], n["value_fate"], n["alt_equivalence"], n["operation|bothYES"]) == (3, 2, 1, 1)
    marks = {(r.field, r.sid): list(r.marks) for r in p.collect()}
    assert marks["value_fate", "1"] == ["{A,B}", "{A,B}"] and marks["escape", "3"] == ["K|V", "NO_ESCAPE"] and marks["exceeds_all_reasons", "3"] == ["NONE", "NONE"]
    assert {(r.pass_name, r.n_items, r.n_alone) for r in agreement.only_in_one(df, "sid", "pass_name").collect()} == {("a", 4, 1), ("b", 3, 0)}


def test_content_identity(spark):
    a = spark.createDataFrame([("k1", "x"), ("k2", "x"), ("k3", "x"), (None, "x"), ("k5", None)], "k string, c string")
    b = spark.createDataFrame([("k1", "x"), ("k1", "y"), ("k2", "y"), ("k4", "x"), ("k5", "")], "k string, c string")
    got = {r.k: r.verdict for r in reconcile.reconcile_content(a, b, "k", "c").collect()}
    assert got == {"k1": "IDENTICAL", "k2": "DIFFERENT", "k3": "SOURCE_ONLY", "k4": "SHIPPED_ONLY", "k5": "IDENTICAL"}


def test_batches_are_in_the_order_of_their_columns(spark, tmp_path):
    rows = spark.createDataFrame([("b1", i) for i in range(1, 13)], "batch string, ln int")
    sinks.write_batches(spark.createDataFrame([("b1", 12)], "batch string, n int"), rows.orderBy(F.desc("ln")), "batch", ["ln"], str(tmp_path / "out"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [r.get("ln") for r in got] == [None, *range(1, 13)]


def test_row_patterns_and_parts_of_objects(spark):
    text = ["# Object files:", "[  1] /x/Pods/kit/libOther.a(b.o)", "[  2] /x/Intermediates.noindex/P.build/R/T.build/Objects-normal/arm64/a.o", "[  3] /x/Intermediates.noindex/P.build/R/T.build/Objects-normal/arm64/T_lto.o",
            "[  4] /x/odd.a(b(c).o)", "# Dead Stripped Symbols:", "<<dead>> \t0x3C\t[  1] _gone"]
    tagged = linkmap.tag_lines(spark.createDataFrame([("m", i, t) for i, t in enumerate(text)], "map_id string, ln int, line string"))
    o = {r.idx: (r.unit, r.archive, r.member, r.archive_name_agrees, r.target, r.project) for r in linkmap.objects(tagged).collect()}
    assert o[1] == ("kit", "libOther", "b.o", False, None, None) and o[2] == ("T", None, "a.o", None, None, "P") and o[3] == (None, None, None, None, "T", None)
    assert tagged.where("bad").count() == 1 and linkmap.objects(tagged).where("idx = 4").first().rule == "NO_RULE_MATCHED"


def test_unit_in_file_names(spark, tmp_path):
    for name in ("b0164__deps__kit@98.out.jsonl", "c1__deps__kit.jsonl"):
        (tmp_path / name).write_text("{}\n")
    got = {r.file.rsplit("/", 1)[1]: r.unit for r in jsonl.read_lines(spark, str(tmp_path)).where("ln = 1").collect()}
    assert got == {"b0164__deps__kit@98.out.jsonl": "deps/kit@98", "c1__deps__kit.jsonl": None}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
