"""Schemas that drift between files: profile, match, report, unify.

Every line of JSON is parsed once: per file its top-level keys with their JSON types, per key a one-permutation MinHash of the words in its values.
Versions are the distinct sets of keys. Each version is matched with the target schema, and its remaining unknown keys with those of the
version before it in the run, both by an assignment of greatest total similarity (names, value sketches, types). The matchings name every key, so that
neighbouring files can be compared and all records unified. Between unknown keys a rename also asks for alike names or for long sketches, since short
values (flags, numbers) are alike by chance.

Nulls, blank, comment, broken and non-object lines are no records. Of a key that a line repeats the last value counts (line_report counts such
lines). A file delivered twice counts once. Lines without run_id, file_seq or file_name belong to no version and are left out. An empty table gives
empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import jaccard, name_words
from ..session import cut, spread

# The fields of an annotation record and the JSON types they have where nothing drifted.
RECORD_FIELDS = {
    "site_id": "string", "site_class": "string", "is_api_use": "string", "is_api_use_reason": "string",
    "unit_confirmed": "string", "unit_role": "string", "declaring_unit": "string", "operation": "string",
    "value_fate": "array", "fate_evidence": "string", "escape": "object", "applicable_reason": "string",
    "constraint_verdicts": "object", "alt_equivalence": "string", "exceeds_all_reasons": "string",
    "needs_context": "object", "flows": "array", "notes": "string",
}

SKETCH_BINS = 64
NAME_WEIGHT, VALUE_WEIGHT, TYPE_WEIGHT, LEAST_SCORE = 0.55, 0.35, 0.10, 0.30
LEAST_RENAME, LEAST_NAME, LONG_SKETCH = 0.40, 0.3, 16  # between unknown keys: the score, and either the likeness of names or the filled bins of both sketches


def json_type(value: Column) -> Column:
    """string, number, boolean, array or object of a VARIANT; null for JSON null."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", F.lit(None).cast("string"))
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number")
    )


def records(raw: DataFrame) -> DataFrame:
    """The lines that hold a JSON object, with rec: map<string, variant>; other lines are left out."""
    v = F.try_parse_json("raw")
    body = raw.where(F.col("raw").isNotNull() & ~F.col("raw").rlike(r"^\s*(#|$)")).withColumn("_v", v)
    return body.where(F.schema_of_variant("_v").startswith("OBJECT")).withColumn("rec", F.expr("try_variant_get(_v, '$', 'map<string,variant>')")).drop("_v")


_WORD = re.compile("[a-z9_]+")
_TYPE = {str: "string", int: "number", float: "number", bool: "boolean", list: "array"}
PROFILE = "run_id long, file_seq int, file_name string, key string, types array<string>, bin int, least long, repeated long"


class _Object(dict):
    """A JSON object that knows how many members were written; of repeated keys the last value counts."""

    def __init__(self, members: list):
        super().__init__(members)
        self.members = len(members)


_TYPE[_Object] = "object"


def _no_constant(name: str):
    raise ValueError(name)


def profile(raw: DataFrame) -> DataFrame:
    """Rows of PROFILE from one parse of every line: types per file and key (bin null), least hashes per key and bin, and per file the lines that repeat a key.

    Each batch gives a row per file and key and per key and bin, so what is shuffled afterwards doesn't grow with lines.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes: dict[str, tuple[int, int]] = {}
        for batch in batches:
            types: dict[tuple, set] = {}
            bins: dict[tuple, int] = {}
            kinds: dict[str, set] = {}
            seen: dict[str, set] = {}
            repeated: dict[tuple, int] = {}
            for run, seq, name, line in zip(batch["run_id"], batch["file_seq"], batch["file_name"], batch["raw"]):
                if line is None or line.lstrip()[:1] != "{":
                    continue
                try:
                    record = json.loads(line, object_pairs_hook=_Object, parse_constant=_no_constant)
                except (ValueError, RecursionError):
                    continue
                if record.members > len(record):
                    repeated[run, seq, name] = repeated.get((run, seq, name), 0) + 1
                for key, value in record.items():
                    at = types.setdefault((run, seq, name, key), set())
                    if value is None:
                        continue
                    kind = _TYPE[type(value)]
                    at.add(kind)
                    kinds.setdefault(key, set()).add(kind)
                    text = value if kind == "string" else str(value)
                    known = seen.setdefault(key, set())
                    if text in known:
                        continue
                    known.add(text)
                    for w in set(_WORD.findall(re.sub("[0-9]", "9", text.lower()))):
                        if w not in hashes:
                            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big", signed=True)
                            hashes[w] = (h % SKETCH_BINS, h)
                        b, h = hashes[w]
                        if h < bins.get((key, b), 1 << 63):
                            bins[key, b] = h
            if len(hashes) > 500_000:
                hashes = {}
            rows = [(*k, sorted(v), None, None, None) for k, v in types.items()]
            rows += [(None, None, None, key, sorted(kinds[key]), b, h, None) for (key, b), h in bins.items()]
            rows += [(*k, None, None, None, None, n) for k, n in repeated.items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")]).astype({"run_id": "Int64", "file_seq": "Int32", "bin": "Int32", "least": "Int64", "repeated": "Int64"})

    placed = raw.select("run_id", "file_seq", "file_name", "raw").dropna()  # a line without a run, place or file has no version
    return spread(placed).mapInPandas(scan, PROFILE)


def profile_files(rows: DataFrame) -> DataFrame:
    """(run_id, file_seq, file_name, key, types): the sorted set of non-null JSON types of each key of each file."""
    return rows.where("bin is null and key is not null").groupBy("run_id", "file_seq", "file_name", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types")
    )


def value_sketches(rows: DataFrame) -> DataFrame:
    """(key, bins, types): for each of SKETCH_BINS bins the least hash of the words in the values of a key."""
    per_bin = rows.where("bin is not null").groupBy("key", "bin").agg(F.min("least").alias("least"), F.flatten(F.collect_set("types")).alias("types"))
    return per_bin.groupBy("key").agg(
        F.collect_list(F.concat_ws(":", "bin", "least")).alias("bins"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types")
    )


def line_report(raw: DataFrame) -> DataFrame:
    """(run_id, file_seq, file_name, n): the files with lines that repeat a key, and how many."""
    return profile(raw).where("repeated is not null").groupBy("run_id", "file_seq", "file_name").agg(F.sum("repeated").alias("n"))


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment of greatest total weight (Hungarian method, rows <= columns after transposing)."""
    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights)
    n, m = cost.shape
    u, v, at, back = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        at[0], j, least, seen = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while at[j]:
            seen[j] = True
            slack = np.where(seen[1:], np.inf, cost[at[j] - 1] - u[at[j]] - v[1:])
            back[1:] = np.where(slack < least[1:], j, back[1:])
            least[1:] = np.where(seen[1:], least[1:], np.minimum(least[1:], slack))
            nxt = 1 + int(np.argmin(np.where(seen[1:], np.inf, least[1:])))
            d = least[nxt]
            u[at[seen]] += d
            v[seen] -= d
            least[~seen] -= d
            j = nxt
        while j:
            at[j], j = at[back[j]], back[j]
    pairs = [(at[j] - 1, j - 1) for j in range(1, m + 1) if at[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _matching(edges: pd.Series) -> pd.Series:
    """array<struct<key, field, score>> of one schema version -> key to field."""

    def one(es) -> dict[str, str]:
        keys, fields = sorted({e["key"] for e in es}), sorted({e["field"] for e in es})
        w = np.zeros((len(keys), len(fields)))
        for e in es:
            w[keys.index(e["key"]), fields.index(e["field"])] = e["score"]
        return {keys[i]: fields[j] for i, j in assign(w) if w[i, j] >= LEAST_SCORE}

    return edges.map(one)


def _scores(edges: DataFrame, sketches: DataFrame, fields: dict[str, str]) -> DataFrame:
    """edges (key, field, ...) with the similarity of the two: score, and likely for two keys that the target schema doesn't know."""
    types = F.create_map(*[x for f, t in fields.items() for x in (F.lit(f), F.lit(t))])
    k, f = sketches.alias("k"), sketches.select(F.col("key").alias("field"), F.col("bins").alias("fbins"), F.col("types").alias("ftypes")).alias("f")
    name, value = jaccard(name_words(F.col("key")), name_words(F.col("field"))), F.coalesce(jaccard(F.col("bins"), F.col("fbins")), F.lit(0.0))
    declared = F.try_element_at(types, F.col("field"))
    kinds = F.array_union(F.coalesce("ftypes", F.array().cast("array<string>")), F.when(declared.isNotNull(), F.array(declared)).otherwise(F.array().cast("array<string>")))
    score = NAME_WEIGHT * name + VALUE_WEIGHT * value + TYPE_WEIGHT * F.coalesce(jaccard(F.col("types"), kinds), F.lit(0.0))
    likely = (score >= LEAST_RENAME) & ((name >= LEAST_NAME) | (F.least(F.size("bins"), F.size("fbins")) >= LONG_SKETCH))
    return edges.join(k, "key", "left").join(f, "field", "left").withColumn("score", score).withColumn("likely", F.coalesce(likely, F.lit(False)))


def _solve(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, mapping): the assignment of greatest total score of each pair of versions; key to field."""
    return edges.groupBy(*by).agg(F.collect_list(F.struct("key", "field", "score")).alias("edges")).select(*by, _matching("edges").alias("mapping"))


_NONE = "cast(map() as map<string,string>)"


def match_keys(profiled: DataFrame, sketches: DataFrame, fields: dict[str, str] = RECORD_FIELDS) -> DataFrame:
    """(run_id, file_seq, file_name, now, mapping, before, before_mapping, renamed): for each file and the one before it in its run their keys with types,
    the unknown keys that stand for a field of the target schema, and the keys of the file before that were renamed (to which key).

    Versions, that is distinct sets of keys, and pairs of them are few; an assignment is solved once for each.
    """
    known = F.array(*[F.lit(f) for f in fields])
    files = (
        profiled.groupBy("run_id", "file_seq", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("key", "types"))).alias("now"))
        .withColumn("keys", F.array_sort(F.map_keys("now"))).select("*", F.array_except("keys", known).alias("unknown"), F.array_except(known, "keys").alias("lacking"))
    )
    distinct = files.where((F.size("unknown") > 0) & (F.size("lacking") > 0)).select("unknown", "lacking").distinct()
    edges = distinct.select("unknown", "lacking", F.explode("unknown").alias("key")).select("*", F.explode("lacking").alias("field"))
    solved = _solve(_scores(edges, sketches, fields), ["unknown", "lacking"])
    files = files.join(solved, ["unknown", "lacking"], "left").select("run_id", "file_seq", "file_name", "now", "unknown", F.coalesce("mapping", F.expr(_NONE)).alias("mapping"))
    w = Window.partitionBy("run_id").orderBy("file_seq", "file_name")
    free = F.array_except("unknown", F.map_keys("mapping"))
    x = cut(files.select("run_id", "file_seq", "file_name", "now", "mapping", free.alias("free")).withColumn("last", F.lag(F.struct("now", "mapping", "free")).over(w)))
    gone, come = F.array_except("last.free", F.map_keys("now")), F.array_except("free", F.map_keys("last.now"))
    x = x.select("run_id", "file_seq", "file_name", "now", "mapping", F.col("last.now").alias("before"), F.col("last.mapping").alias("before_mapping"), gone.alias("gone"), come.alias("come"))
    pairs = x.where((F.size("gone") > 0) & (F.size("come") > 0)).select("gone", "come").distinct()
    edges = pairs.select("gone", "come", F.explode("gone").alias("key")).select("*", F.explode("come").alias("field"))
    solved = _solve(_scores(edges, sketches, fields).where("likely"), ["gone", "come"]).withColumnRenamed("mapping", "renamed")
    return x.join(solved, ["gone", "come"], "left").select("run_id", "file_seq", "file_name", "now", "mapping", "before", "before_mapping", F.coalesce("renamed", F.expr(_NONE)).alias("renamed"))


def schema_changes(raw: DataFrame, fields: dict[str, str] = RECORD_FIELDS) -> DataFrame:
    """(run_id, file_seq, file_name, field, change) between each file and the one before it in its run.

    change is ADDED, REMOVED, RENAMED or RETYPED; the last two may both hold for a field. A field whose values are
    all null in one of the two files has no type there and is not RETYPED. A renamed key beyond the target schema goes by its new name.
    """
    rows = cut(profile(raw))
    pairs = match_keys(profile_files(rows), value_sketches(rows), fields).where("before is not null")
    named = lambda keys, name: F.map_from_entries(F.transform(F.map_entries(keys), lambda e: F.struct(name(e["key"]), F.struct(e["key"].alias("key"), e["value"].alias("types")))))
    at = lambda m, k: F.try_element_at(F.col(m), k)
    now = named("now", lambda k: F.coalesce(at("mapping", k), k))
    before = named("before", lambda k: F.coalesce(at("before_mapping", k), at("renamed", k), k))
    both = pairs.select("run_id", "file_seq", "file_name", now.alias("now"), before.alias("before"))
    both = both.select("*", F.explode(F.array_union(F.map_keys("now"), F.map_keys("before"))).alias("field"))
    a, b = at("before", F.col("field")), at("now", F.col("field"))
    retyped = (F.size(a["types"]) > 0) & (F.size(b["types"]) > 0) & (a["types"] != b["types"])
    changes = F.array_compact(F.array(
        F.when(a.isNull(), "ADDED"), F.when(b.isNull(), "REMOVED"),
        F.when(a["key"] != b["key"], "RENAMED"), F.when(retyped, "RETYPED"),
    ))
    return both.select("run_id", "file_seq", "file_name", "field", F.explode(changes).alias("change"))


@F.pandas_udf(T.StringType())
def _once(raw: pd.Series) -> pd.Series:
    """Lines of JSON with the last value of a key that stands repeatedly; other lines as they are."""

    def one(line: str) -> str:
        repeats = []

        def pairs(items: list) -> dict:
            d = dict(items)
            repeats.append(len(d) < len(items))
            return d

        try:
            value = json.loads(line, object_pairs_hook=pairs)
        except (ValueError, RecursionError):
            return line
        return json.dumps(value, ensure_ascii=False) if any(repeats) else line

    return raw.map(one, na_action="ignore")


def tri_state(value: Column) -> Column:
    """YES, NO or UNKNOWN from a VARIANT that is a string, a boolean, 1 / 0 / -1, a list of one or an object with `value`."""
    t = json_type(value)
    inner = (
        F.when(t == "array", F.expr("try_variant_get(x, '$[0]', 'string')")).when(t == "object", F.expr("try_variant_get(x, '$.value', 'string')"))
        .otherwise(F.expr("try_variant_get(x, '$', 'string')"))
    )
    s = F.upper(inner)
    return F.when(s.isin("TRUE", "1"), "YES").when(s.isin("FALSE", "0"), "NO").when(s == "-1", "UNKNOWN").otherwise(s)


# Verdicts come as an object, as JSON text of one, as [[id, verdict], ...], as [{id, verdict}, ...] or as id=verdict;id=verdict.
_ENTRIES = """
case when t = 'array' then transform(try_variant_get(x, '$', 'array<variant>'), e ->
          if(schema_of_variant(e) like 'OBJECT%',
             struct(coalesce(try_variant_get(e, '$.id', 'string'), '') as k, try_variant_get(e, '$.verdict', 'variant') as v),
             struct(coalesce(try_variant_get(e, '$[0]', 'string'), '') as k, try_variant_get(e, '$[1]', 'variant') as v)))
     when t = 'string' then transform(filter(split(x_text, ';'), p -> p like '%=%'), p ->
             struct(trim(substring_index(p, '=', 1)) as k, try_parse_json(concat('"', trim(substring_index(p, '=', -1)), '"')) as v)) end
"""
_VERDICTS = """
case when t = 'object' then try_variant_get(x, '$', 'map<string,variant>')
     when t = 'string' and ltrim(x_text) like '{%' then try_variant_get(try_parse_json(x_text), '$', 'map<string,variant>')
     when entries is not null then map_from_entries(filter(entries, (e, i) -> array_position(transform(entries, z -> z.k), e.k) = i + 1)) end
"""


def unify(raw: DataFrame, fields: dict[str, str] = RECORD_FIELDS) -> DataFrame:
    """All records in one schema: one row per line of each file, first delivery.

    Scalars are strings, value_fate is an array, exceeds_all_reasons is YES / NO / UNKNOWN / null, constraint_verdicts
    is map<string, struct<scalar, by_domain>>, and keys beyond the schema stay as JSON text in `extra`.
    """
    rows = cut(profile(raw))
    mapping = match_keys(profile_files(rows), value_sketches(rows), fields).select("run_id", "file_seq", "file_name", "mapping")
    lines = raw.where(F.col("raw").isNotNull() & F.ltrim("raw").startswith("{"))
    first = lines.groupBy("run_id", "file_seq", "file_name", "line_no").agg(F.min_by("raw", "arrived_at").alias("raw"), F.min("arrived_at").alias("arrived_at"))
    body = records(first.withColumn("raw", _once("raw"))).join(mapping, ["run_id", "file_seq", "file_name"])
    rec = F.transform_keys("rec", lambda k, v: F.coalesce(F.element_at("mapping", k), k))
    body = body.withColumn("rec", rec)
    plain = [f for f in fields if f not in ("exceeds_all_reasons", "constraint_verdicts", "value_fate")]
    text = [F.expr(f"if(schema_of_variant(rec['{f}']) in ('VOID'), null, cast(rec['{f}'] as string))").alias(f) for f in plain]
    verdict = "struct(if(schema_of_variant(v) like 'OBJECT%', null, try_variant_get(v, '$', 'string')) as scalar, if(schema_of_variant(v) like 'OBJECT%', try_variant_get(v, '$', 'map<string,string>'), null) as by_domain)"
    known = ",".join(f"'{f}'" for f in fields)
    out = body.select(
        "run_id", "file_seq", "file_name", "line_no", "arrived_at", *text,
        F.expr("try_variant_get(rec['value_fate'], '$', 'array<string>')").alias("value_fate"),
        F.expr("rec['exceeds_all_reasons']").alias("x"), F.expr("rec['constraint_verdicts']").alias("c"),
        F.expr(f"transform_values(map_filter(rec, (k, v) -> k not in ({known})), (k, v) -> to_json(v))").alias("extra"),
    )
    out = out.withColumn("exceeds_all_reasons", tri_state(F.col("x"))).drop("x").withColumnRenamed("c", "x")
    out = out.withColumn("t", json_type(F.col("x"))).withColumn("x_text", F.expr("try_variant_get(x, '$', 'string')"))
    out = out.withColumn("entries", F.expr(_ENTRIES)).withColumn("m", F.expr(_VERDICTS))
    return out.withColumn("constraint_verdicts", F.expr(f"transform_values(m, (k, v) -> {verdict})")).drop("x", "t", "x_text", "entries", "m")
