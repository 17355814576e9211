"""Drift, heavy keys and orphan references: cases of each, empty tables, nulls, ties, repeated rows, clashing names."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckoner.operators import drift, orphans, skew

RAW = "run_id long, file_name string, file_seq int, line_no int, arrived_at timestamp_ntz, raw string, note string"
T0 = dt.datetime(2025, 1, 1)


def raw_rows(files):
    out = []
    for run, seq, name, lines in files:
        out += [(run, name, seq, i, T0, x if isinstance(x, str) or x is None else json.dumps(x), "clash") for i, x in enumerate(lines)]
    return out


def record(**more):
    base = {f: "v" for f in drift.RECORD_FIELDS}
    return base | {"value_fate": ["LOCAL_ONLY"], "escape": None, "needs_context": None, "flows": [], "constraint_verdicts": {"RA_C1": "SUPPORTED"}, "exceeds_all_reasons": "NO"} | more


def renamed(rec, old, new):
    return {(new if k == old else k): v for k, v in rec.items()}


def test_changes_between_files(spark):
    a = record()
    b = renamed(record(constraint_verdicts=[["RA_C1", "SUPPORTED"]]), "exceeds_all_reasons", "exceeds_all")
    c = record(review_state="open")
    files = [(1, 1, "f1", [a, "# note", "", "{broken", None, "[1]"]), (1, 2, "f2", [b, b]), (1, 3, "f3", [c]), (2, 1, "g1", [b]), (3, 5, "empty", ["#"])]
    df = spark.createDataFrame(raw_rows(files) + raw_rows([(1, 2, "f2", [b])]), RAW)
    got = {(r.file_name, r.field, r.change) for r in drift.schema_changes(df).collect()}
    assert got == {
        ("f2", "exceeds_all_reasons", "RENAMED"), ("f2", "constraint_verdicts", "RETYPED"),
        ("f3", "exceeds_all_reasons", "RENAMED"), ("f3", "constraint_verdicts", "RETYPED"), ("f3", "review_state", "ADDED"),
    }


def test_unknown_keys_are_matched_between_versions(spark):
    """A key outside the target schema is renamed; another goes while an unlike one comes; a run may start with a renamed field."""
    a = record(review_state="open", elapsed_s=5)
    b = record(reviewState="open", checked=True)
    c = renamed(record(), "constraint_verdicts", "verdicts")
    d = renamed(record(), "constraint_verdicts", "constraintVerdicts")
    df = spark.createDataFrame(raw_rows([(1, 1, "f1", [a]), (1, 2, "f2", [b]), (2, 1, "g1", [c]), (2, 2, "g2", [d]), (2, 3, "g3", [record()])]), RAW)
    got = {(r.file_name, r.field, r.change) for r in drift.schema_changes(df).collect()}
    assert got == {
        ("f2", "reviewState", "RENAMED"), ("f2", "elapsed_s", "REMOVED"), ("f2", "checked", "ADDED"),
        ("g2", "constraint_verdicts", "RENAMED"), ("g3", "constraint_verdicts", "RENAMED"),
    }


def test_lines_without_a_place_are_left_out(spark):
    line = json.dumps(record())
    df = spark.createDataFrame([(1, "f1", 1, 1, T0, line, ""), (1, "f2", 2, 1, T0, json.dumps(record(more=1)), ""), (None, "f3", 1, 1, T0, line, ""), (1, None, 3, 1, T0, line, ""), (1, "f4", None, 1, T0, line, "")], RAW)
    assert {(r.file_name, r.field, r.change) for r in drift.schema_changes(df).collect()} == {("f2", "more", "ADDED")}
    assert {r.file_name for r in drift.unify(df).collect()} == {"f1", "f2"}


def test_repeated_keys_and_odd_values(spark):
    line = json.dumps(record(extra_key={}))[:-1] + ', "extra_key": [], "notes": "last"}'
    df = spark.createDataFrame(raw_rows([(1, 1, "f1", [record(extra_key={})]), (1, 2, "f2", [line, '{"x": NaN}', "{", "x" * 100_000])]), RAW)
    assert [tuple(r) for r in drift.line_report(df).collect()] == [(1, 2, "f2", 1)]
    assert {(r.field, r.change) for r in drift.schema_changes(df).collect()} == {("extra_key", "RETYPED")}
    got = {r.file_name: r.notes for r in drift.unify(df).collect()}
    assert got == {"f1": "v", "f2": "last"}


def test_unify_reads_every_form(spark):
    forms = [
        (True, {"RA_C1": "CONFLICT"}), (0, [["RA_C1", "CONFLICT"], ["RA_C1", "UNKNOWN"]]), (-1, [{"id": "RA_C1", "verdict": "CONFLICT"}]), (["YES"], "RA_C1=CONFLICT;"),
        ({"value": "no", "why": "x"}, '{"RA_C1": "CONFLICT"}'), (None, {"RA_C1": {"APP": "CONFLICT"}}), ("UNKNOWN", ""), ("NO", None),
    ]
    files = [(i, 1, f"f{i}", [record(exceeds_all_reasons=e, constraint_verdicts=c, extra_key=1)]) for i, (e, c) in enumerate(forms)]
    got = {r.run_id: r for r in drift.unify(spark.createDataFrame(raw_rows(files), RAW)).collect()}
    assert [got[i].exceeds_all_reasons for i in range(8)] == ["YES", "NO", "UNKNOWN", "YES", "NO", None, "UNKNOWN", "NO"]
    assert all(got[i].constraint_verdicts["RA_C1"].scalar == "CONFLICT" for i in range(5))
    assert got[5].constraint_verdicts["RA_C1"].by_domain == {"APP": "CONFLICT"}
    assert got[0].extra == {"extra_key": "1"} and got[0].value_fate == ["LOCAL_ONLY"]


def test_drift_on_empty_table(spark):
    df = spark.createDataFrame([], RAW)
    assert drift.schema_changes(df).count() == 0
    assert drift.unify(df).count() == 0


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(50):
        n, m = rng.integers(1, 6), rng.integers(1, 6)
        w = rng.random((n, m))
        got = sum(w[i, j] for i, j in drift.assign(w))
        small = w if n <= m else w.T
        assert got == pytest.approx(max(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small))))


def test_heavy_keys(spark):
    data = [("a",)] * 40 + [("b",)] * 3 + [(None,)] * 30 + [(f"k{i}",) for i in range(27)]
    df = spark.createDataFrame(data, "unit_location string").withColumn("n", F.lit(1))
    got = {(r.unit_location, r.n, r.n_all) for r in skew.heavy_keys(df, "unit_location", 0.03).collect()}
    assert got == {("a", 40, 100), ("b", 3, 100)}
    assert skew.heavy_keys(df.limit(0), "unit_location", 0.03).count() == 0


def test_skew_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(200)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, x int")
    right = spark.createDataFrame([("hot", "H"), ("k1", "A"), ("k1", "B"), ("zz", "Z")], "k string, y string")
    for how in ("inner", "left"):
        a = sorted(map(str, skew.skew_join(left, right, "k", 0.1, how).select("k", "x", "y").collect()))
        assert a == sorted(map(str, left.join(right, "k", how).select("k", "x", "y").collect()))
    assert skew.skew_join(left.limit(0), right, "k").count() == 0


ANN = "ann_id long, annotated_at timestamp_ntz, unit_location string, site_id string, notes string, file string"
SITE = "site_id string, unit_location string, file string, line int, scanned_at timestamp_ntz, dropped_at timestamp_ntz"
OLD, NEW = "0123456789abcdef", "fedcba9876543210"


def day(n):
    return T0 + dt.timedelta(days=n)


def test_orphans(spark):
    site = spark.createDataFrame([(OLD, "u", "A/x.swift", 3, day(0), day(10)), (OLD, "u", "A/x.swift", 3, day(0), day(10)), (NEW, "v", "B/y.m", 7, day(5), None)], SITE)
    ann = spark.createDataFrame([
        (1, day(1), "u", f" {OLD.upper()} ", f"cf. {NEW}; see A/x.swift L3: old"), (2, day(10), "u", OLD, f"cf. {NEW[:12]}…; rev @{NEW[:12]} pinned; symbol at 0x{OLD}"),
        (3, day(6), "u", "ffffffffffffffff", "stored by A/x.swift:3; key=K @ A/z.swift:9; K is defined in A/z.swift:9"), (3, day(6), "u", "ffffffffffffffff", "stored by A/x.swift:3; key=K @ A/z.swift:9"),
        (4, day(6), None, None, "SELF:B/y.m:7 and B/y.m:8"), (5, day(6), "u", NEW, "B/y.m:7"), (6, None, "u", "eeeeeeeeeeeeeeee", OLD), (7, day(1), "u", "", None),
    ], ANN.replace(", file string", "")).withColumn("file", F.lit("clash"))
    got = {tuple(r) for r in orphans.site_orphans(ann, site).select("ann_id", "field", "site_ref", "reason").collect()}
    assert got == {
        (1, "notes", NEW, "LATE"), (2, "site_id", OLD, "DELETED"), (3, "site_id", "ffffffffffffffff", "MISSING"), (4, "notes", "B/y.m:8", "MISSING"),
        (5, "notes", "B/y.m:7", "MISSING"), (6, "site_id", "eeeeeeeeeeeeeeee", "MISSING"),
    }
    assert orphans.site_orphans(ann.limit(0), site).count() == 0
    missing = orphans.site_orphans(ann, site.limit(0))
    assert {r.reason for r in missing.collect()} == {"MISSING"}


def test_match_full_counts_partial_keys(spark):
    refs = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, None, None)], "id int, x string, y string").withColumn("at", F.lit(T0).cast("timestamp_ntz"))
    tgt = spark.createDataFrame([("a", "b", None, None)], "x string, y string, s timestamp_ntz, u timestamp_ntz")
    got = orphans.find_orphans(refs, tgt, [["x", "y"]], ["x", "y"], "at", "s", "u", match="full")
    assert [(r.id, r.reason) for r in got.collect()] == [(1, "MISSING")]
    assert orphans.find_orphans(refs, tgt, [["x", "y"], ["x"]], ["x", "y"], "at", "s", "u").count() == 0


def test_references_with_any_null_mask_are_checked(spark):
    t = dt.datetime(2025, 1, 1)
    ann = spark.createDataFrame([(1, t, "u", None, "see a.swift:99999999999"), (2, t, "u", None, "see a.swift:" + "9" * 30), (3, t, None, None, "see a.swift:88888888888"), (4, t, "u", None, "see a.swift:7")], "ann_id long, annotated_at timestamp, unit_location string, site_id string, notes string")
    site = spark.createDataFrame([("00000000000000aa", "u", "a.swift", 7, t, None)], "site_id string, unit_location string, file string, line int, scanned_at timestamp, dropped_at timestamp")
    assert {(r.ann_id, r.reason) for r in orphans.site_orphans(ann, site).collect()} == {(1, "MISSING"), (2, "MISSING"), (3, "MISSING")}
    refs = spark.createDataFrame([("a", None, t), (None, "b", t), (None, None, t), ("x", "y", t)], "p string, q string, at timestamp")
    targets = spark.createDataFrame([("a", "c", t, None)], "p string, q string, since timestamp, until timestamp")
    assert {(r.p, r.q) for r in orphans.find_orphans(refs, targets, None, ["p", "q"], "at", "since", "until").collect()} == {(None, "b"), ("x", "y")}
    assert orphans.site_orphans(ann.limit(0), site).count() == 0


def test_match_semantics_differ(spark):
    """SIMPLE leaves references with a null alone, FULL counts them, PARTIAL looks them up; a target of unknown beginning was deleted, not late."""
    refs = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, None, None), (4, "z", None), (5, "a", "c"), (6, "d", "d")], "id int, x string, y string").withColumn("at", F.lit(day(5)).cast("timestamp_ntz"))
    tgt = spark.createDataFrame([("a", "b", None, None), ("d", "d", None, day(1))], "x string, y string, s timestamp_ntz, u timestamp_ntz")
    for match, want in (("partial", {(4, "MISSING"), (5, "MISSING"), (6, "DELETED")}), ("simple", {(5, "MISSING"), (6, "DELETED")}), ("full", {(1, "MISSING"), (4, "MISSING"), (5, "MISSING"), (6, "DELETED")})):
        assert {(r.id, r.reason) for r in orphans.find_orphans(refs, tgt, None, ["x", "y"], "at", "s", "u", match=match).collect()} == want


def test_small_shares_are_refused(spark):
    with pytest.raises(ValueError):
        skew.heavy_keys(spark.createDataFrame([("a",)], "k string"), "k", 1e-7)


def test_scans(spark, tmp_path):
    """Patterns run once over each note, and marks are counted before they are joined."""
    from reckoner.plans import quality

    d = "/root/testdata/sf0.001"
    plan = lambda f: f(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(quality.p5_found).count("parquet") == 0 and plan(quality.p4_verdicts).count("parquet") == 2
