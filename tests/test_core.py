"""Closed forms, truth tables and random-input equivalence of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from reckoner.operators import agreement, apportion, batching, gates, guards, intervals, ladders, reconcile, textscan, validate


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ladder_keeps_empty_buckets_and_conserves(spark):
    df = spark.createDataFrame([(1,), (5,), (None,), (9,)], "x int")
    bucket = ladders.ladder([("SMALL", F.col("x") < 3), ("BIG", F.col("x") > 8)], "OTHER")
    out = ladders.bucket_totals(df, bucket, ["SMALL", "MID", "BIG", "OTHER"], expected=F.lit(6), unaccounted="MID")
    assert rows(out, "bucket", "n") == [("BIG", 1), ("MID", 2), ("OTHER", 2), ("SMALL", 1)]
    assert ladders.conserve(ladders.bucket_totals(df, bucket, ["SMALL", "BIG", "OTHER"]), df).first()["holds"]


def test_ladder_on_an_empty_table(spark):
    df = spark.createDataFrame([], "x int")
    assert rows(ladders.bucket_totals(df, F.lit("A"), ["A"]), "bucket", "n") == [("A", 0)]


def sequential_trim(spans):
    out, most = [], None
    for s, e, i in sorted(spans):
        if e <= s:
            continue
        if most is None or e > most:
            out.append((i, s if most is None else max(s, most), e))
        most = e if most is None else max(most, e)
    return sorted(out)


def test_trim_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    data = {g: [(a := rng.randrange(100), a + rng.randrange(12), i) for i in range(rng.randrange(1, 15))] for g in range(60)}
    df = spark.createDataFrame([(g, s, e, i) for g, v in data.items() for s, e, i in v], "g int, start long, end long, i int")
    got = {}
    for r in intervals.trim_spans(df, ["g"], "i").collect():
        got.setdefault(r["g"], []).append((r["i"], r["start"], r["end"]))
    for g, v in data.items():
        assert sorted(got.get(g, [])) == sequential_trim(v)


def test_locate_gaps_bounds_and_nulls(spark):
    spans = spark.createDataFrame([(1, 10, 20, "a"), (1, 30, 40, "b"), (2, 0, 5, "c"), (1, 50, 50, "zero")], "g int, start long, end long, name string").where("end > start")
    points = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (1, 35), (1, 99), (2, 4), (3, 1)], "g int, at long")
    out = intervals.locate(points, spans, ["g"], "at", "name")
    assert rows(out.fillna("-"), "g", "at", "covered_by") == [(1, 9, "-"), (1, 10, "a"), (1, 19, "a"), (1, 20, "-"), (1, 35, "b"), (1, 99, "-"), (2, 4, "c"), (3, 1, "-")]
    assert rows(intervals.clip_coverage(spans, ["g"], 15, 35), "g", "covered") == [(1, 10), (2, 0)]


def items(spark, marks):
    return spark.createDataFrame([(list(m),) for m, n in marks for _ in range(n)], "marks array<string>")


def test_agreement_closed_forms(spark):
    two = items(spark, [("AA", 40), ("AB", 10), ("BA", 5), ("BB", 45)])
    r = agreement.coefficients(two, []).first()
    assert (r["n"], r["k"], r["po"], r["pabak"]) == (100, 2, 0.85, 0.7)
    assert r["fleiss"] == pytest.approx(0.34875 / 0.49875, abs=1e-6)
    assert r["ac1"] == pytest.approx(0.35125 / 0.50125, abs=1e-6)
    assert agreement.cohen(two, []).first()["cohen"] == pytest.approx(0.7)
    r = agreement.coefficients(items(spark, [("XYZ", 12)]), []).first()
    assert (r["po"], r["fleiss"]) == (0.0, -0.5)
    assert agreement.coefficients(items(spark, [("XXY", 9)]), []).first()["po"] == pytest.approx(1 / 3, abs=1e-6)
    r = agreement.coefficients(items(spark, [("XX", 5)]), []).first()
    assert (r["po"], r["fleiss"], r["pabak"], r["ac1"]) == (1.0, None, None, 1.0)


def test_bootstrap_is_reproducible_and_centred(spark):
    df = spark.createDataFrame([(f"u{i % 40}", ["A", "A" if i % 10 else "B"]) for i in range(800)], "u string, marks array<string>")
    a = rows(agreement.cluster_bootstrap(df, "u", 100, "s"), "replicate", "po")
    assert a == rows(agreement.cluster_bootstrap(df.repartition(7), "u", 100, "s"), "replicate", "po")
    assert sum(p for _, p in a) / len(a) == pytest.approx(0.9, abs=0.02)


def test_largest_remainder(spark):
    w = spark.createDataFrame([("f", "a", 50), ("f", "b", 30), ("f", "c", 20), ("g", "x", 1), ("g", "y", 1), ("g", "z", 1), ("h", "q", 0)], "k string, l string, w int")
    total = F.when(F.col("k") == "g", 5).otherwise(10)
    assert rows(apportion.largest_remainder(w, ["k"], "l", "w", total), "k", "l", "seats") == [("f", "a", 5), ("f", "b", 3), ("f", "c", 2), ("g", "x", 2), ("g", "y", 2), ("g", "z", 1), ("h", "q", 0)]


def test_draw_does_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("s", F.when(F.col("id") < 400, "hot").otherwise("cold"))
    seats = spark.createDataFrame([("hot", 7), ("cold", 3)], "s string, seats int")
    order = [apportion.seeded(F.lit("x"), F.col("id").cast("string")), F.col("id")]
    a = rows(apportion.draw_by_seats(df, seats, ["s"], order), "s", "id")
    assert a == rows(apportion.draw_by_seats(df.repartition(5), seats, ["s"], order, salts=3), "s", "id")
    assert [s for s, _ in a] == ["cold"] * 3 + ["hot"] * 7


def test_gates(spark):
    df = spark.createDataFrame([("a", "x", 1, True), ("a", "x", 2, False), ("a", "y", 3, None), ("b", "x", 1, False), ("b", "x", 2, False)], "k string, s string, t int, ok boolean")
    assert rows(gates.last_ok_wins(df, ["k"], F.col("ok"), [F.col("t")]), "k", "t") == [("a", 1), ("b", 2)]
    assert rows(gates.division(df, ["k"], "s", ["x", "y"]), "k") == [("a",)]
    assert rows(gates.missing_slots(df, ["k"], "s", ["x", "y"]), "k", "s") == [("b", "y")]
    g = gates.gate(df, ["k"], {"HAS_OK": F.bool_or("ok"), "THREE": F.count(F.lit(1)) >= 3})
    assert rows(g, "k", "passed", "reasons") == [("a", True, []), ("b", False, ["HAS_OK", "THREE"])]
    n = spark.createDataFrame([("k", float(v)) for v in (1, 1, 2, 5, 9)], "k string, v double")
    assert gates.nearest_rank(n, ["k"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()[2:] == (1.0, 2.0, 9.0)


def test_reconcile_and_ancestors(spark):
    a, b = spark.createDataFrame([("u", 1), ("u", 2), ("u", 2), (None, 3)], "u string, r int"), spark.createDataFrame([("u", 2), ("u", 4)], "u string, r int")
    assert rows(reconcile.reconcile_sets(a, b, ["u", "r"]), "r", "verdict") == [(1, "OVER"), (2, "AGREE"), (4, "UNDER")]
    files = spark.createDataFrame([("A/B/c.m",), ("A/x.m",), ("z.m",)], "f string")
    own = spark.createDataFrame([("A",), ("A/B",)], "d string")
    assert rows(reconcile.nearest_ancestor(files, "f", own, "d").fillna("-"), "f", "nearest") == [("A/B/c.m", "A/B"), ("A/x.m", "A"), ("z.m", "-")]
    c = spark.createDataFrame([("h", "u1", 1), ("h", "u1", 2), ("h", "u2", 3), ("h", "u2", 4), ("h", "u3", 5)], "h string, u string, i int")
    assert rows(reconcile.equal_multiplicity_copies(c, [F.col("h")], "u", [], "i"), "copy_id", "original_id") == [(3, 1), (4, 2)]


def test_guards_are_not_kleene():
    k = guards.RELEASE_IOS
    both = lambda c: (guards.evaluate(c, k, True), guards.evaluate(c, k, False))
    assert both("X || !X") == (True, True)
    assert both("X && !Y") == (False, False)
    assert both("os(iOS) && !DEBUG") == (True, True)
    assert both("X") == (True, False)
    assert both("a b") == (None, None)


def test_guard_chains(spark):
    live = guards.liveness(guards.RELEASE_IOS)
    cases = [(None, True), ([], True), (["#if os(iOS)"], True), (["#if DEBUG", "#else"], True), (["#if DEBUG"], False), (["#if FOO"], None), (["#if FOO", "#else"], None),
             (["#if os(iOS)", "#elseif FOO"], False), (["#if FOO", "#elseif DEBUG"], False), (["#if FOO", "#if DEBUG"], False), (["#ifndef DEBUG"], True)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<string>")
    got = {r["i"]: r["v"] for r in df.select("i", live("c").alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_hits_merge_and_context(spark):
    df = spark.createDataFrame([(1, "ab abcd x"), (2, None), (3, "")], "i int, t string")
    got = {r["i"]: [tuple(h) for h in r["hits"]] for r in textscan.hits(df, "t", {"short": "ab", "long": "abcd"}).collect()}
    assert got == {1: [(0, 2, "short"), (3, 7, "long")], 2: [], 3: []}
    lines = textscan.lines(spark.createDataFrame([(1, "a\nHIT\nb\nc\nHIT")], "i int, t string"), ["i"], "t")
    assert rows(textscan.context_windows(lines, ["i"], F.col("line") == "HIT", 1), "ln", "context") == [(2, ["a", "HIT", "b"]), (5, ["c", "HIT"])]


def test_chunks_and_packs(spark):
    df = spark.createDataFrame([("b", i) for i in range(5)] + [("a", i) for i in range(2)] + [(None, 1)], "u string, i int")
    assert rows(batching.chunk(df, "u", ["i"], 2), "batch_no", "u", "i") == [(1, "a", 0), (1, "a", 1), (2, "b", 0), (2, "b", 1), (3, "b", 2), (3, "b", 3), (4, "b", 4)]
    units = spark.createDataFrame([("g", "a", 60), ("g", "b", 50), ("g", "c", 40), ("g", "d", 500), ("g", "e", None)], "g string, u string, s long")
    assert rows(batching.greedy_packs(units, "g", "u", "s", 100, 2), "u", "pack") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]


def test_patch_is_idempotent(spark):
    df = spark.createDataFrame([("A", "B", "A"), ("A", "B", "B"), ("A", "B", "C"), ("A", "A", "Z"), (None, "B", "Q")], "o string, n string, g string")
    out = validate.patch(df, "o", "n", "g")
    assert rows(out, "outcome", "g", "patched") == [("ALREADY_NEW", "B", "B"), ("DIVERGENT", "C", "C"), ("FLIPPED", "A", "B"), ("NOT_APPLICABLE", "Q", "Q"), ("SAME_UNDER_BOTH", "Z", "Z")]
    again = validate.patch(out.select("o", "n", F.col("patched").alias("g")), "o", "n", "g")
    assert again.where("outcome = 'FLIPPED'").count() == 0


def test_publish_is_all_or_nothing(spark, tmp_path):
    df = spark.range(3)
    bad = spark.createDataFrame([("G", False, 1)], "gate string, passed boolean, n long")
    with pytest.raises(ValueError, match="G"):
        validate.publish(df, bad, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    validate.publish(df, bad.withColumn("passed", F.lit(True)), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3


def test_agreement_takes_every_pair_of_raters(spark):
    rows = [("i1", "r1", "Y"), ("i1", "r2", "Y"), ("i1", "r9", "N"), ("i2", "r2", "N"), ("i2", "r9", "N"), ("i3", "r9", "Y")]
    pairs = agreement.rater_pairs(spark.createDataFrame(rows, "item string, rater string, mark string"), ["item"], "rater", F.col("mark"))
    assert {(r.rater_a, r.rater_b, r.item, *r.marks) for r in pairs.collect()} == {("r1", "r2", "i1", "Y", "Y"), ("r1", "r9", "i1", "Y", "N"), ("r2", "r9", "i1", "Y", "N"), ("r2", "r9", "i2", "N", "N")}
    assert {(r.rater_a, r.rater_b, r.n) for r in agreement.cohen(pairs, ["rater_a", "rater_b"]).collect()} == {("r1", "r2", 1), ("r1", "r9", 1), ("r2", "r9", 2)}


def test_chunks_of_many_files_and_units(spark):
    """Numbers follow from counts per file and per prefix; ties in order columns and null files are kept."""
    data = [(u, f, i % 3) for u in ("deps/aa", "deps/AB", "pods/zz", "deps/aaaaaaaaaaaa1", "deps/aaaaaaaaaaaa2") for f in (None, "x", "y") for i in range(5)] + [(None, "x", 1)]
    df = spark.createDataFrame(data, "u string, f string, i int")
    got = batching.chunk(df, "u", ["f", "i"], 4).toPandas()
    assert len(got) == 75 and got.groupby("batch_no").size().max() <= 4 and sorted(got.batch_no.unique()) == list(range(1, 21))
    first = got.groupby("u").batch_no.min().sort_values()
    assert list(first.index) == sorted(first.index, key=lambda u: (u.lower(), u))
