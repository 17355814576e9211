"""Readers for manifests, property lists, lock files and section dumps, and identity of file contents."""

from __future__ import annotations

import plistlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256, content) of every file below path whose name fits the pattern."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return b.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def privacy_declares(content: pd.Series) -> pd.Series:
    """Category to sorted reasons of a privacy manifest, XML or binary; null if it can't be read."""

    def one(b):
        try:
            top = plistlib.loads(bytes(b))
            return {
                str(e["NSPrivacyAccessedAPIType"]): sorted(str(r) for r in e.get("NSPrivacyAccessedAPITypeReasons", []))
                for e in top.get("NSPrivacyAccessedAPITypes", [])
                if isinstance(e, dict) and "NSPrivacyAccessedAPIType" in e
            }
        except Exception:  # noqa: BLE001 - malformed is a value here
            return None

    return content.map(one)


def read_json_manifests(spark: SparkSession, path: str, schema: T.StructType, name: str = "manifest.json") -> DataFrame:
    """One row per manifest; an unreadable one has its text in `_corrupt` and nulls elsewhere; `has` tells which keys are there."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    rec = F.from_json("raw", schema)
    v = F.try_parse_json("raw")
    return raw.select("file", rec.alias("m"), F.map_keys(F.expr("try_variant_get(try_parse_json(raw), '$', 'map<string,variant>')")).alias("has"), F.when(v.isNull(), F.col("raw")).alias("_corrupt")).select("file", "m.*", "has", "_corrupt")


def parse_pins(text: Column) -> Column:
    """array<struct<identity, revision>> of a Package.resolved text, version 1 (object.pins) or later (pins)."""
    pin = "array<struct<identity:string,package:string,state:struct<revision:string>>>"
    doc = F.from_json(text, f"struct<pins:{pin},object:struct<pins:{pin}>>")
    pins = F.coalesce(doc["pins"], doc["object"]["pins"], F.array().cast(pin))
    return F.array_distinct(F.transform(pins, lambda p: F.struct(F.lower(F.coalesce(p["identity"], p["package"])).alias("identity"), p["state"]["revision"].alias("revision"))))


def podfile_lock_pods(lines: DataFrame) -> DataFrame:
    """(file, name, version) of the PODS section of lock files given as (file, ln, line); subspecs count as their pod."""
    head = F.when(F.col("line").rlike(r"^[A-Z][A-Z ]+:"), F.regexp_extract("line", r"^([A-Z][A-Z ]+):", 1))
    w = Window.partitionBy("file").orderBy("ln")
    rows = lines.withColumn("_s", F.last(head, ignorenulls=True).over(w)).where("_s = 'PODS'")
    entry = r'^  - "?([^\s/"]+)(?:/[^\s"]*)? \(([^)]+)\)'
    return rows.where(F.col("line").rlike(entry)).select("file", F.regexp_extract("line", entry, 1).alias("name"), F.regexp_extract("line", entry, 2).alias("version")).distinct()


def otool_sections(lines: DataFrame) -> DataFrame:
    """(file, ord, segname, sectname, addr, size): blocks of key-value lines, each opened by a line `Section`."""
    w = Window.partitionBy("file").orderBy("ln")
    rows = lines.withColumn("ord", F.sum((F.trim("line") == "Section").cast("int")).over(w)).where("ord > 0")
    kv = rows.select("file", "ord", F.split(F.trim("line"), r"\s+").alias("kv")).select("file", "ord", F.col("kv")[0].alias("k"), F.try_element_at("kv", F.lit(2)).alias("v"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    number = lambda c: F.when(c.startswith("0x"), F.conv(F.substring(c, 3, 32), 16, 10)).otherwise(c).cast("long")
    return kv.groupBy("file", "ord").agg(at("segname").alias("segname"), at("sectname").alias("sectname"), number(at("addr")).alias("addr"), number(at("size")).alias("size"))


def compare_section_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, verdict): IDENTICAL, SAME_NAMES_OTHER_LAYOUT, OTHER_NAMES or NO_DATA for two ordered section tables."""
    def seq(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "segname", "sectname", "addr", "size"))).alias(n))

    j = seq(a, "x").join(seq(b, "y"), "file", "full")
    names = lambda c: F.transform(c, lambda s: F.struct(s["segname"], s["sectname"]))
    layout = lambda c: F.transform(c, lambda s: F.struct(s["segname"], s["sectname"], s["addr"], s["size"]))
    verdict = F.when(F.col("x").isNull() | F.col("y").isNull(), "NO_DATA").when(layout("x") == layout("y"), "IDENTICAL").when(names("x") == names("y"), "SAME_NAMES_OTHER_LAYOUT").otherwise("OTHER_NAMES")
    return j.select("file", verdict.alias("verdict"))
