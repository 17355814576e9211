"""Training-data operators: simulated truth, brute force, edge cases (nulls, empty and long texts, ties, repeated rows, clashing names)."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reckoner.llm import consensus, exemplars, leakage, mixing, residue, sampling, triplets
from reckoner.llm.plaintext import plain

from . import held_out

T0 = dt.datetime(2025, 1, 1)
ANN = (
    "ann_id long, pass_name string, site_id string, is_api_use string, value_fate array<string>, applicable_reason string, "
    "constraint_verdicts map<string,struct<scalar:string,by_domain:map<string,string>>>, annotated_at timestamp_ntz, loaded_at timestamp_ntz, label string"
)


def annotations(n, seed):
    """Three good annotators, one fair, one that always says YES, and one that copies the fair one."""
    rng = random.Random(seed)
    truth, rows, k = {}, [], 0
    for s in range(n):
        sid = f"{s:016x}"
        t = truth[sid] = "YES" if rng.random() < 0.7 else "NO"
        marks = {p: t if rng.random() < acc else ("NO" if t == "YES" else "YES") for p, acc in (("g1", 0.95), ("g2", 0.94), ("g3", 0.93), ("fair", 0.7))}
        marks["yes"] = "YES"
        marks["copy"] = marks["fair"] if rng.random() < 0.97 else marks["g3"]
        for p, m in marks.items():
            if p[0] != "g" or rng.random() < 0.75:
                k += 1
                fate = (["A", "B", "A"] if t == "YES" else ["C"]) if m == "YES" else []
                rows.append((k, p, sid.upper() if k % 3 else f" {sid}\t", m.lower() if k % 2 else f"{m} ", fate, "X1.1", {"RX1_C1": ("SUPPORTED", None), "RZZ_C1": ("CONFLICT", None)}, T0, T0, "clash"))
    return truth, rows


def test_consensus_finds_the_truth(spark):
    truth, rows = annotations(1500, 5)
    labels, model = consensus.label_sites(spark.createDataFrame(rows, ANN))
    got = labels.toPandas()
    api = got[got.field == "is_api_use"].set_index("site_id").label.to_dict()
    right = np.mean([api[s] == t for s, t in truth.items()])
    votes = pd.DataFrame([(r[2].strip().lower(), r[3].strip().upper()) for r in rows], columns=["s", "m"]).groupby("s").m.agg(lambda x: x.mode()[0]).to_dict()
    majority = np.mean([votes[s] == t for s, t in truth.items()])
    assert right > 0.96 and right > majority + 0.02
    m = model.where("task = 'is_api_use'").toPandas().groupby("annotator")[["knows", "share"]].max()
    assert m.knows["g1"] > 0.8 > m.knows["fair"] and m.knows["yes"] < 0.2
    assert m.share["copy"] < 0.7 and m.share["fair"] < 0.7 and m.share["g1"] == 1
    fates = got[got.field == "value_fate"]
    assert set(fates.label) <= {"A+B", "C"} and all(api[s] == "YES" for s in fates.site_id)
    assert set(got.field) == {"is_api_use", "value_fate", "RX1_C1"}


def test_partners_and_few_shared_items(spark):
    """All partners give the same model as the default while annotators are few; one that shares three items is estimated from them."""
    _, rows = annotations(300, 8)
    rows += [(10**6 + i, "late", r[2], r[3], [], "NA", None, T0, T0, None) for i, r in enumerate([r for r in rows if r[1] == "g1"][:3])]
    items = consensus.items_of(consensus.task_marks(consensus.latest_marks(spark.createDataFrame(rows, ANN)))).cache()
    pick = lambda m: sorted((r.task, r.annotator, r.label, round(r.knows, 6)) for r in m.collect())
    whole = pick(consensus.reliability(items, partners=None))
    assert whole == pick(consensus.reliability(items)) and any(a == "late" and k > 0.5 for _, a, _, k in whole)
    assert len(consensus.reliability(items, partners=2).select("annotator").distinct().collect()) == 7


def middle(a, w):
    """The median of values a, each as often as w tells."""
    a, upto = a[np.argsort(a, kind="stable")], np.cumsum(w[np.argsort(a, kind="stable")])
    low, high = a[np.searchsorted(upto, (upto[-1] - 1) // 2, "right")], a[np.searchsorted(upto, upto[-1] // 2, "right")]
    return min(low if low == high else 0.5 * low + 0.5 * high, 0.99)


def brute_medians(e):
    """Every triplet of every annotator, one task."""
    names = sorted({i for i, _ in e})
    at, n = {x: r for r, x in enumerate(names)}, len(names)
    m, shared = np.full((n, n), np.nan), np.zeros((n, n))
    for (i, j), (x, c) in e.items():
        m[at[i], at[j]], shared[at[i], at[j]] = x, c
    got, upper = {}, np.triu(np.ones((n, n), bool), 1)
    for i in names:
        x, c = m[at[i]], shared[at[i]]
        with np.errstate(all="ignore"):
            ok = upper & (m > 0) & ~np.isnan(x[:, None] + x[None, :])
            a = np.where((x[:, None] <= 0) & (x[None, :] <= 0), 0.0, np.sqrt(np.maximum(x[:, None] * x[None, :] / m, 0.0)))
            few = np.minimum(np.minimum(c[:, None], c[None, :]), shared)
            w = np.ceil(1000 * m * m * few / (few + 20))
        if ok.any():
            got[i] = middle(a[ok], w[ok].astype("int64"))
    return got


def test_every_triplet_counts(spark, monkeypatch):
    """Medians over all triplets, joined and in blocks, equal brute force: a dense task, a sparse one, one with a hub, ties, and agreement below chance."""
    rng = np.random.default_rng(4)
    know = {t: rng.uniform(0, 1.1, 110) for t in ("dense", "sparse", "hub", "ties")}
    e = {t: {} for t in know}
    for t, a in know.items():
        for i in range(110):
            for j in range(i):
                if t == "dense" or (t == "hub" and (j == 0 or rng.random() < 0.2)) or (t in ("sparse", "ties") and rng.random() < 0.08):
                    x = float(np.round(a[i] * a[j], 1) if t == "ties" else a[i] * a[j] + rng.normal(0, 0.15)), int(rng.integers(1, 300))
                    e[t][f"a{i}", f"a{j}"] = e[t][f"a{j}", f"a{i}"] = x
    rows = [(t, i, j, *x) for t, es in e.items() for (i, j), x in es.items()]
    df = spark.createDataFrame(rows + [("dense", None, "a1", 0.5, 9), ("dense", "a1", None, 0.5, 9)], "task string, i string, j string, e double, n long").cache()
    want = {(t, i): k for t, es in e.items() for i, k in brute_medians(es).items()}
    for way, edges in ((triplets.by_join, 0), (triplets.by_blocks, 700), (triplets.by_blocks, 10**6)):
        monkeypatch.setattr(triplets, "BLOCK_EDGES", edges)
        got = {(r.task, r.i): r.knows for r in way(df, df).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert 0.0 in want.values() and 0.99 in want.values() and len(want) > 350
    assert triplets.by_blocks(df.limit(0), df.limit(0)).count() == 0


def test_annotators_beyond_64_partners(spark, monkeypatch):
    """All partners of an annotator count by default, however many, and in blocks as when joined."""
    rng = np.random.default_rng(9)
    rows = []
    for s in range(60):
        t = rng.integers(0, 3)
        rows += [(f"s{s}", "f", "t", f"a{i}", str(t if rng.random() < 0.2 + i / 100 else rng.integers(0, 3))) for i in range(75) if rng.random() < 0.8]
    items = consensus.items_of(spark.createDataFrame(rows, "site_id string, field string, task string, annotator string, label string")).cache()
    pick = lambda m: {(r.annotator, r.label): round(r.knows, 9) for r in m.collect()}
    every = pick(consensus.reliability(items, partners=74))
    monkeypatch.setattr(triplets, "MAX_JOINED", 0)
    assert pick(consensus.reliability(items)) == every


def test_latest_mark_counts_and_nulls_are_no_marks(spark):
    later = T0 + dt.timedelta(days=1)
    rows = [
        (1, "a", "S1", "YES", None, None, None, T0, T0, None), (2, "a", "s1 ", "no", [], "NA", None, later, later, None), (2, "a", "s1", "no", [], "NA", None, later, later, None),
        (3, "b", "s1", None, [None], None, None, T0, T0, None), (4, None, "s1", "YES", None, None, None, T0, T0, None), (5, "c", None, "YES", None, None, None, T0, T0, None),
    ]
    df = spark.createDataFrame(rows, ANN)
    marks = consensus.task_marks(consensus.latest_marks(df)).collect()
    assert [(m.site_id, m.annotator, m.label) for m in marks] == [("s1", "a", "NO")]
    labels, _ = consensus.label_sites(df)
    assert [(r.site_id, r.label, r.n_votes) for r in labels.collect()] == [("s1", "NO", 1)]
    labels, model = consensus.label_sites(df.limit(0))
    assert labels.count() == 0 and model.count() == 0


def test_verdict_by_domain_is_mixed(spark):
    rows = [(1, "a", "s1", "YES", ["B", "A"], "X1.1", {"RX1_C1": (None, {"P": "CONFLICT"}), "RX1_C2": ("UNKNOWN", {})}, T0, T0, None)]
    got = {(m.field, m.label) for m in consensus.task_marks(consensus.latest_marks(spark.createDataFrame(rows, ANN))).collect()}
    assert got == {("is_api_use", "YES"), ("value_fate", "A+B"), ("reason", "X1.1"), ("RX1_C1", "MIXED"), ("RX1_C2", "UNKNOWN")}


def test_apportionment_properties():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = rng.integers(1, 6)
        share, cap, total = rng.dirichlet(np.ones(n)), rng.integers(0, 30, n), int(rng.integers(0, 60))
        floor = rng.integers(0, 6, n)
        seats = sampling.apportion(share, floor, cap, total)
        low = np.minimum(floor, cap)
        assert (seats >= low).all() and (seats <= cap).all()
        assert seats.sum() == min(max(total, low.sum()), cap.sum())
    assert list(sampling.apportion(np.array([0.5, 0.3, 0.2]), np.zeros(3, int), np.full(3, 99), 10)) == [5, 3, 2]
    assert list(sampling.apportion(np.array([1, 1, 1]) / 3, np.zeros(3, int), np.full(3, 99), 5)) == [2, 2, 1]


def test_zero_targets_and_floors_beyond_the_total(spark):
    assert list(sampling.apportion(np.array([0.9, 0.0]), np.zeros(2, int), np.array([10, 1000]), 100)) == [10, 0]
    assert list(sampling.apportion(np.array([0.5, 0.5]), np.array([8, 8]), np.array([20, 20]), 10)) == [8, 8]
    usable = spark.createDataFrame([("f", "a", f"r{i}") for i in range(20)] + [("f", "b", f"s{i}") for i in range(20)] + [("g", "a", "t")], "frame string, linkage string, repo string")
    quota = spark.createDataFrame([("f", "A", 0.5, 8, 10), ("f", "B", 0.5, 8, 10), ("g", "A", 1.0, 0, 5)], QUO)
    assert {(r.frame, r.seats, r.frame_gap) for r in sampling.quotas(usable, quota).collect()} == {("f", 8, -6), ("g", 1, 4)}


TGT = "target_id long, frame string, repo string, sha string, linkage string, state string, share double"
QUO = "frame string, linkage string, share double, min_seats int, n_total int"


def test_sample_reports_what_cannot_be_filled(spark):
    rows = [(i, "f", f"Own/r{i}", "sha", " spm-only\t", "CANDIDATE", 0.0) for i in range(30)] + [(100, "f", "own/R1.git", "sha", "SPM ONLY", "CANDIDATE", 0.0), (101, "f", "own/r2/", "sha", "SPM_ONLY", "CANDIDATE", 0.0)]
    rows += [(i, "f", f"own/b{i}", ["sha", None, ""][i % 3], "BOTH", "CANDIDATE" if i % 2 else "ARCHIVED", 0.0) for i in range(200, 212)] + [(300, None, "x/y", "sha", "BOTH", "CANDIDATE", 0.0), (301, "f", None, "sha", None, "CANDIDATE", 0.0)]
    targets = spark.createDataFrame(rows, TGT)
    quota = spark.createDataFrame([("f", "SPM_ONLY", 0.5, 2, 20), ("f", "BOTH", 0.25, 3, 20), ("f", "DYNAMIC_LIKELY", 0.25, 1, 20), ("g", "BOTH", 1.0, 1, 5)], QUO)
    usable = sampling.usable_repos(targets)
    q = {(r.frame, r.linkage): r for r in sampling.quotas(usable, quota).collect()}
    assert (q["f", "SPM_ONLY"].available, q["f", "SPM_ONLY"].seats, q["f", "SPM_ONLY"].short) == (30, 18, 0)
    assert (q["f", "BOTH"].available, q["f", "BOTH"].seats, q["f", "BOTH"].short) == (2, 2, 3)
    assert q["f", "DYNAMIC_LIKELY"].short == 5 and q["g", "BOTH"].short == 5
    seats = sampling.quotas(usable, quota)
    a = sorted(tuple(r) for r in sampling.draw(usable, seats).collect())
    assert len(a) == 20 == len({(r[0], r[2]) for r in a})
    assert a == sorted(tuple(r) for r in sampling.draw(sampling.usable_repos(targets.repartition(7)), seats).collect())
    assert sampling.quotas(usable.limit(0), quota).where("short > 0").count() == 4
    assert sampling.draw(usable, sampling.quotas(usable, quota.limit(0))).count() == 0


DOC = "doc_id long, text string, source string, lang string, weight double"


def test_mixture_shares(spark):
    docs = spark.createDataFrame(
        [(i, "ten words are in this text and it is short", "Big-Source", "en", 9.0) for i in range(400)] + [(1000 + i, "ten words are in this text and it is short", " small source", "en", 9.0) for i in range(20)]
        + [(2000, None, "big_source", "en", 9.0), (2001, "", "big_source", "en", 9.0), (2002, "ten words are in this text and it is short", None, "en", 9.0)], DOC)
    targets = spark.createDataFrame([("m", "big_source", 0.8, 1), ("m", "small_source", 0.1, 3), ("m", "absent", 0.1, 5)], "mix_id string, source string, weight double, max_repeat int")
    sizes = mixing.source_sizes(docs, mixing.token_count(spark))
    p = {r.source: r for r in mixing.plan(sizes, targets).collect()}
    assert p["big_source"].rate == pytest.approx(0.8 * 421 / 400) and not p["big_source"].is_short
    assert p["small_source"].rate == pytest.approx(0.1 * 421 / 20) and not p["small_source"].is_short
    assert p["absent"].is_short and p["absent"].rate == 0
    reached = {r.source: r for r in mixing.reached_shares(mixing.document_sizes(docs, mixing.token_count(spark)), targets).collect()}
    emitted = mixing.mixture(mixing.document_sizes(docs, mixing.token_count(spark)), mixing.plan(sizes, targets)).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r.source: r.n for r in emitted} == {k: r.emitted for k, r in reached.items() if r.emitted} and sum(r.reached for r in reached.values()) == pytest.approx(1)
    m = mixing.mixture(docs, mixing.plan(sizes, targets)).toPandas()
    assert 28 <= len(m[m.source == "small_source"]) <= 56 and m["copy"].max() <= 3
    assert m.groupby("doc_id")["copy"].max().eq(m.groupby("doc_id").size()).all()
    again = mixing.mixture(docs.repartition(9), mixing.plan(sizes, targets)).toPandas()
    assert sorted(map(tuple, m.values)) == sorted(map(tuple, again.values))
    assert mixing.mixture(docs.limit(0), mixing.plan(sizes.limit(0), targets)).count() == 0


def test_copies_are_unbiased(spark):
    n = spark.range(20000).select(mixing.copies(F.lit(2.3), F.col("id").cast("string")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert n[0] == pytest.approx(2.3, abs=0.02) and (n[1], n[2]) == (2, 3)


def test_plain_form(spark):
    df = spark.createDataFrame([("r2> A <b>bo</b>ld​ wo­rd &quot;x.y&quot;\n// next_line\tHERE",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(plain(F.col("t"))).collect()] == ["a bold word xy nextline here", None, ""]


def brute_leak(item, doc, least):
    """Is there a run of at least `least` item tokens within a tenth of edits of a run of the document? Dynamic program over all starts."""
    for a in range(len(item) - least + 1):
        for b in range(a + least, min(len(item), a + 2 * least) + 1):
            part = item[a:b]
            row = [0] * (len(doc) + 1)
            for i, w in enumerate(part, 1):
                new = [i]
                for j, x in enumerate(doc, 1):
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
                row = new
            if min(row) <= len(part) // 10:
                return True
    return False


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(45)] for _ in range(5)]
    docs = []
    for _ in range(70):
        k = rng.randrange(5)
        n = rng.choice([8, 15, 19, 20, 21, 26, 40])
        a = rng.randrange(0, 45 - n + 1)
        part = list(items[k][a : a + n])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            at = rng.randrange(len(part))
            op = rng.randrange(3)
            part[at : at + 1] = [["zz"], [], [part[at], "zz"]][op]
        docs.append([rng.choice(words) for _ in range(rng.randrange(12))] + part + [rng.choice(words) for _ in range(rng.randrange(12))])
    want = {(d, k) for d, doc in enumerate(docs) for k, item in enumerate(items) if brute_leak(item, doc, 20)}
    ev = spark.createDataFrame([(k, "s", "en", " ".join(t)) for k, t in enumerate(items)], "item_id long, suite string, lang string, text string")
    dd = spark.createDataFrame([(d, " ".join(t), "clash") for d, t in enumerate(docs)], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(dd, ev).collect()}
    assert got == want and len(want) > 15
    one_way = sorted(map(tuple, leakage.find_leaks(dd, ev).collect()))
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 300)  # items in blocks, documents in shards, nothing on the driver
    monkeypatch.setattr(leakage, "SHARD_CHARS", 2000)
    assert sorted(map(tuple, leakage.find_leaks(dd, ev).collect())) == one_way
    assert leakage.find_leaks(dd.limit(0), ev).count() == 0


def test_passages_are_followed_to_their_end(spark):
    """400 words of an item with 16 of them changed; the passage is all of it. Common openings of six words cost no more than they must."""
    item = [f"w{i}" for i in range(400)]
    edited = [("zz" if i % 25 == 12 else w) for i, w in enumerate(item)]
    docs = [(1, " ".join(edited)), (2, "a b c d e f " * 3000)]
    ev = [(7, "en", " ".join(item)), (8, "en", "a b c d e f " + " ".join(f"x{i}" for i in range(30)))]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ev, "item_id long, lang string, text string")).collect()
    assert [(r.doc_id, r.item_id, r.span, r.edits) for r in got] == [(1, 7, 400, 16)]


def test_a_hundred_thousand_items_in_one_pass(spark):
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("item_id", "k"), F.lit(50_000)).cast("string"))
    ev = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit("en").alias("lang"), F.explode(F.sequence(F.lit(1), F.lit(24))).alias("k")).groupBy("item_id", "lang").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", word.alias("w")))), lambda x: x["w"]), " ").alias("text")
    )
    some = ev.where("item_id % 1000 = 7").cache()
    docs = some.select((F.col("item_id") * 10).alias("doc_id"), F.concat(F.lit("before it "), "text", F.lit(" and after")).alias("text"))
    out = leakage.find_leaks(docs, ev)
    assert out._jdf.queryExecution().toString().count("MapInPandas") > 0
    assert {(r.doc_id, r.item_id, r.span) for r in out.collect()} == {(r.item_id * 10, r.item_id, 24) for r in some.collect()}


def test_leak_edge_cases(spark):
    opening = "Read the record that stands below and give the answer which a careful second reviewer of the team would give to it today."
    body = [" ".join(f"{x}{i}" for i in range(30)) for x in "ab"]
    zh = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    ev = spark.createDataFrame([(1, "en", f"{opening} {body[0]}."), (2, "en", f"{opening} {body[1]}."), (3, "zh", zh), (4, "en", "too short"), (5, "en", None), (6, "en", "")], "item_id long, lang string, text string")
    wrapped = "\n".join("r1> " + " ".join(body[0].split()[i : i + 4]).upper() for i in range(0, 30, 4))
    docs = spark.createDataFrame([
        (1, opening), (2, f"see {body[0]}"), (2, f"see {body[0]}"), (3, "x" + "\n".join(zh[i : i + 7] for i in range(0, 60, 7))), (4, None), (5, ""), (6, wrapped), (7, "word " * 200_000 + body[1]),
        (8, " ".join(body[1].split()[:15])), (9, zh[:30]),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, ev).collect()}
    assert got == {(2, 1), (3, 3), (6, 1), (7, 2)}
    assert leakage.find_leaks(docs.limit(0), ev).count() == 0
    assert leakage.find_leaks(docs, ev.limit(0)).count() == 0


def test_suffix_array_is_sorted_and_whole():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 400).astype(np.uint32)
    keys, places = leakage.suffix_array(text, 3)
    want = [p for p in range(398) if (text[p : p + 3] > 0).all()]
    assert sorted(places.tolist()) == want
    tails = [tuple(text[p : p + leakage.DEPTH]) + (0,) * (leakage.DEPTH - len(text[p : p + leakage.DEPTH])) for p in places]
    assert tails == sorted(tails)


GENUINE = [
    "We moved 12 sites to the next pass because the guard chain was not decidable.", "Our report template prints `{{unit}}` and `{{n}}` per row, and the writer fills both from the header.",
    "When the session has expired the app asks the user to sign in again and writes no key.", "The podspec sets `${PODS_ROOT}/Kit` as a search path, which the parser expands before it compares.",
    "let x = a[[0]]; print(\"404\") // not found in cache", "func f() { return map[key] }", "A page not found answer in the client clears the cached date and nothing else.", "ok",
]
RESIDUE = [
    "Owner: {{owner}}\nUnit: <%= unit %>", "The build of [[unit_name]] failed twice.\nAll else is fine.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "TBD TBD TBD.", "404 Not Found",
    "Sorry, without JS, nothing will load here.", "Please enable JavaScript to continue using this application.", "<html><body><h1>502 Bad Gateway</h1><p>The upstream did not answer in time.</p>",
    "The guard holds.\nToo many requests. Your address is limited for the next 30 seconds.", "您的浏览器不支持脚本,无法显示内容。", "Seite nicht gefunden.", "CHECKING YOUR BROWSER BEFORE THE PAGE OPENS.",
]


def test_residue(spark):
    rows = [(i, t, "clash") for i, t in enumerate(GENUINE * 5)] + [(1000 + i, t, "clash") for i, t in enumerate(RESIDUE)] + [(2000, None, ""), (2001, "", ""), (2002, "fine words " * 100_000 + "\nLorem ipsum dolor sit amet.", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, passage string")
    got = {r.doc_id for r in residue.find_residue(df).select("doc_id").distinct().collect()}
    assert got == {1000 + i for i in range(len(RESIDUE))} | {2002}
    assert residue.find_residue(df.limit(0)).count() == 0


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(2**60 + 1, text), (None, text), (2**60 + 3, "404 Not Found"), (None, "404 Not Found")] + [(i, t) for i, t in enumerate(PLAIN)], "doc_id long, text string")
    ev = spark.createDataFrame([(2**60 + 5, "en", text), (None, "en", text)], "item_id long, lang string, text string")
    assert [(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, ev).collect()] == [(2**60 + 1, 2**60 + 5)]
    assert {r.doc_id for r in residue.find_residue(docs).collect()} == {2**60 + 3}


def test_document_frequencies_cover_all_documents(spark):
    df = spark.createDataFrame([(i, f"common word{i % 7}") for i in range(500)], "doc_id long, text string").repartition(6)
    got = {r.term: r.df for r in residue.term_counts(df).collect()}
    assert got["common"] == 500 and got["word3"] == 71


PLAIN = [f"The guard of unit {w} holds, so the sites of pass {w}b stay with the {w}c reviewer." for w in "abcdefghijklmnopqrstuvwxyz"]


def test_residue_is_weighed_not_counted(spark):
    """Fragments that are short and rare, and notices within long or wrapped lines."""
    inside = "step nine of the nightly run went on and then the requested page could not be located on this server and the run of pass b went on with the sites of unit c"
    wrapped = "The requested page could not be\nlocated on this server while step nine\nof the nightly run went on"
    lines = ["Lorem ipsum dolor.", inside, wrapped]
    quoted = ['the help shows "the requested page could not be located on this server" and the run of pass b went on with unit c', "later?", "The page"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PLAIN * 4 + quoted)] + [(1000 + i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id for r in residue.find_residue(df).select("doc_id").distinct().collect()}
    assert got == {1000, 1001, 1002}


def test_lookup_weighs_words(spark):
    index = residue.Index({"error": ["alpha beta gamma delta epsilon zeta"]}, [])
    common = "of the and to in is it"
    df = spark.createDataFrame([(i, f"{common} {'alpha beta gamma delta epsilon zeta' if i == 0 else f'w{i}'}") for i in range(300)], "doc_id long, text string")
    assert [r.doc_id for r in residue.find_residue(df, index).select("doc_id").distinct().collect()] == [0]


def test_fields_are_looked_up(spark):
    forms = ["{{ owner | upper }}", "{{#if x}}", "{{ .Values.x }}", "{% if a == b %}", "<% if (ready) %>", "{{owner}}"]
    rows = [(i, t) for i, t in enumerate(PLAIN)] + [(1000 + i, f"The owner of unit {t} is asked.") for i, t in enumerate(forms)]
    rows += [(2000, "Our report template prints {{ unit | upper }} and {{n}} per row, and the writer fills both from the header."), (2001, "style={{ color: red }}"), (2002, "The log has `{{ owner | upper }}` in it.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.family, r.cover) for r in residue.find_residue(df).collect()}
    assert got == {(1000 + i, "field", 1.0) for i in range(len(forms))}
    index = residue.Index({"error": ["404 Not Found"]})  # a field that the index doesn't hold is no residue
    assert residue.find_residue(df, index).count() == 0


HELD_OUT = [(held_out.TUNED, held_out.GENUINE, 0.85, 1), (held_out.FRESH, held_out.FRESH_GENUINE, 0.85, 1), (held_out.LAST, held_out.LAST_GENUINE, 0.75, 0)]


def test_residue_in_new_wordings(spark):
    """Recall on wordings that no exemplar has, before a background of plain documents; LAST was written last and no exemplar followed from it."""
    known = {e for f in (exemplars.PUBLIC, exemplars.SEEN) for es in f.values() for e in es}
    base = [(i, t) for i, t in enumerate(PLAIN * 40)]
    for residue_of, genuine, least, most in HELD_OUT:
        new = [t for ts in residue_of.values() for t in ts if t not in known]
        assert len(new) > 100
        rows = base + [(10_000 + i, t) for i, t in enumerate(new)] + [(20_000 + i, t) for i, t in enumerate(genuine)]
        got = {r.doc_id for r in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id").distinct().collect()}
        print("recall", sum(10_000 <= i < 20_000 for i in got), len(new), sum(i >= 20_000 for i in got))
        assert sum(10_000 <= i < 20_000 for i in got) >= least * len(new)
        assert sum(i >= 20_000 for i in got) <= most and not any(i < 10_000 for i in got)


def test_openings_are_shared_by_items_not_rows(spark):
    zh = ["".join(chr(a + 7 * i) for i in range(50)) for a in (0x4E00, 0x5E00, 0x6E00)]
    one = " ".join(f"c{i}" for i in range(30)) + "."
    items = [(1, "en", one), (1, "en", one), (2, "zh", f"{zh[0]}。{zh[1]}。"), (3, "zh", f"{zh[0]}。{zh[2]}。"), (4, "zh", f"{zh[0]}。")]
    got = {(r.item_id, r.text.replace(" ", "")) for r in leakage.without_shared_openings(spark.createDataFrame(items, "item_id long, lang string, text string")).collect()}
    assert got == {(1, one.replace(" ", "").rstrip(".")), (2, zh[1]), (3, zh[2]), (4, zh[0])}


def test_passages_are_reported_whole(spark):
    text = "<code> </code>" + " " * 3000 + "404 Not Found"
    got = residue.find_residue(spark.createDataFrame([(i, t) for i, t in enumerate(PLAIN + [text])], "doc_id long, text string")).collect()
    assert got and all(r.passage.endswith("404 Not Found") for r in got)
