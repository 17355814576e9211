"""Readers, sinks and incremental runs over small invented files."""

import gzip
import json
import plistlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.operators import intervals
from reckoner.sources import files, jsonl, linkmap, sinks
from reckoner.streaming.incremental import only_new, process_new_files

MAP = """# Path: /x/Build/Products/Release/Demo.app/Demo
# Arch: arm64
# Object files:
[  0] linker synthesized
[  1] /x/Intermediates.noindex/P.build/Release/T.build/Objects-normal/arm64/a.o
[  2] /x/Pods/lovely-pod/libOther.a(b.o)
[  3] /x/Build/Products/Release/Kit/libKit.a(c.o)
[  4] /x/Build/Products/Release/Kit/libElse.a(c.o)
[  5] /usr/lib/libz.a(z.o)
[  6] /x/Intermediates.noindex/P.build/Release/T.build/Objects-normal/arm64/T_lto.o
[  7] /sdk/UIKit.tbd
[  8] /usr/lib/libobjc.dylib
[  9] /x/Build/Products/Release/Prod.o
[ 10] /sdk/Maps.framework/Maps
[ 11] /tmp/lone.o
[ 12] /tmp/strange
# Sections:
# Address\tSize\tSegment\tSection
0x1000\t0x100\t__TEXT\t__text
0x1100\t0x40\t__DATA\t__data
# Symbols:
# Address\tSize\tFile  Name
0x1000\t0x40\t[  1] _a
0x1040\t0x00\t[  1] _alias
0x1040\t0x40\t[  2] _b with blanks
0x1060\t0x80\t[  6] _lto
garbage line
# Dead Stripped Symbols:
<<dead>>\t0x0000003C\t[  1] _gone
"""


def test_link_map(spark, tmp_path):
    (tmp_path / "m1.txt").write_text(MAP)
    with gzip.open(tmp_path / "m2.txt.gz", "wt") as f:
        f.write(MAP)
    tagged = linkmap.read_maps(spark, str(tmp_path))
    rules = [(r.idx, r.unit, r.rule) for r in linkmap.objects(tagged).where(F.col("map_id").endswith("m1.txt")).orderBy("idx").collect()]
    assert rules == [
        (0, None, "INDEX_ZERO"), (1, "T", "TARGET_INTERMEDIATE"), (2, "lovely-pod", "POD_VENDORED_ARCHIVE"), (3, "Kit", "POD_BUILT_FROM_SOURCE"), (4, "Kit", "BUILT_PRODUCT_ARCHIVE"),
        (5, "libz", "ARCHIVE_MEMBER"), (6, None, "LTO_OUTPUT"), (7, "UIKit", "TBD"), (8, "libobjc", "DYLIB"), (9, "Prod", "BUILD_PRODUCT_OBJECT"), (10, "Maps", "FRAMEWORK_BINARY"),
        (11, "lone", "BARE_OBJECT"), (12, None, "NO_RULE_MATCHED"),
    ]
    s = linkmap.summary(tagged).collect()
    assert len(s) == 2 and all((r.n_bad, r.n_objects, r.n_symbols, r.n_sized, r.n_unattributed, r.covered, r.coverage) == (1, 13, 4, 3, 1, 224, 0.875) for r in s)
    spans = linkmap.spans(tagged).where(F.col("map_id").endswith("m1.txt"))
    points = spark.createDataFrame([(0x0FFF,), (0x1000,), (0x105F,), (0x1070,), (0x10FF,)], "at long").crossJoin(spans.select("map_id").distinct())
    got = {r["at"]: r["covered_by"] for r in intervals.locate(points, spans, ["map_id"], "at", "idx").collect()}
    assert got == {0x0FFF: None, 0x1000: "1", 0x105F: "2", 0x1070: "2", 0x10FF: None} | {0x10FF: None}


def test_jsonl_kinds_and_headers(spark, tmp_path):
    d = tmp_path / "a0001__pods__Kit@1.jsonl"
    d.write_text('# c\n{"_batch": 1}\n\n{"x": 1}\n{"x":\n[1]\n')
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert [r.kind for r in lines.orderBy("ln").collect()] == ["COMMENT", "RECORD", "BLANK", "RECORD", "BROKEN", "NOT_OBJECT", "BLANK"]
    head, rows = jsonl.header_and_rows(lines)
    assert [(r.line, r.unit) for r in head.collect()] == [('{"_batch": 1}', "pods/Kit@1")]
    assert [r.line for r in rows.collect()] == ['{"x": 1}']


def test_manifests_and_lock_files(spark, tmp_path):
    good = plistlib.dumps({"NSPrivacyAccessedAPITypes": [{"NSPrivacyAccessedAPIType": "Cat", "NSPrivacyAccessedAPITypeReasons": ["B.1", "A.1"]}]}, fmt=plistlib.FMT_BINARY)
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.xcprivacy").write_bytes(good)
    (tmp_path / "p/b.xcprivacy").write_bytes(b"no")
    got = files.read_binary(spark, str(tmp_path / "p"), "*.xcprivacy").select(files.privacy_declares("content").alias("d")).collect()
    assert sorted(map(str, [r.d for r in got])) == ["None", "{'Cat': ['A.1', 'B.1']}"]
    pins = spark.createDataFrame([(json.dumps({"object": {"pins": [{"package": "Kit", "state": {"revision": "r"}}]}}),), (json.dumps({"pins": [{"identity": "Foo", "state": {"revision": "q"}}]}),), ("no",)], "t string")
    assert [[tuple(p) for p in r.p] for r in pins.select(files.parse_pins(F.col("t")).alias("p")).collect()] == [[("kit", "r")], [("foo", "q")], []]
    lock = "PODS:\n  - Kit (1.0):\n    - Dep\n  - Kit/Core (1.0)\n  - \"Odd+Pod (2.0)\"\n\nDEPENDENCIES:\n  - Kit (9.9)\n"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(lock.split("\n"))], "file string, ln int, line string")
    assert sorted(tuple(r) for r in files.podfile_lock_pods(lines).collect()) == [("f", "Kit", "1.0"), ("f", "Odd+Pod", "2.0")]


def test_section_tables(spark):
    def dump(size):
        text = f"Load command 1\nSection\n  sectname __text\n   segname __TEXT\n      addr 0x1000\n      size {size}\nSection\n  sectname __data\n   segname __DATA\n      addr 0x2000\n      size 0x10\n"
        return [(i, x) for i, x in enumerate(text.split("\n"))]

    def frame(d):
        return files.otool_sections(spark.createDataFrame([(f, i, x) for f, t in d.items() for i, x in t], "file string, ln int, line string"))

    v = files.compare_section_tables(frame({"a": dump("0x20"), "b": dump("32"), "c": dump("0x20")}), frame({"a": dump("0x20"), "b": dump("0x21")}))
    assert sorted(tuple(r) for r in v.collect()) == [("a", "IDENTICAL"), ("b", "SAME_NAMES_OTHER_LAYOUT"), ("c", "NO_DATA")]


def test_json_manifests_tell_absent_from_null(spark, tmp_path):
    for name, text in (("j1", '{"repo": "r", "zip": null}'), ("j2", '{"repo": "s"}'), ("j3", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    schema = T.StructType([T.StructField("repo", T.StringType()), T.StructField("zip", T.StringType())])
    got = sorted((r.repo or "", sorted(r.has or []), r._corrupt) for r in files.read_json_manifests(spark, str(tmp_path), schema).collect())
    assert got == [("", [], "{broken"), ("r", ["repo", "zip"], None), ("s", ["repo"], None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", 1), ("v", 2)], "unit string, x int")
    sinks.write_json_by(df, "unit", str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_batches(df.select("unit"), df.unionByName(df), "unit", ["x"], str(tmp_path / "b"))
    text = [r.value for r in spark.read.text(str(tmp_path / "b")).collect()]
    assert len(text) == 6 and text.count('{"unit":"u"}') == 1
    assert sinks.to_markdown(df.orderBy("x")) == "| unit | x |\n|---|---|\n| u | 1 |\n| v | 2 |"
    assert "More than 1 rows." in sinks.to_markdown(df, 1)


def test_incremental_runs_see_each_file_once(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    op = lambda d: d.groupBy("k").agg(F.sum("x").alias("x"))
    df.write.parquet(src)
    process_new_files(spark, src, df.schema, op, out, cp)
    process_new_files(spark, src, df.schema, op, out, cp)
    assert spark.read.parquet(out).count() == 2
    df.write.mode("append").parquet(src)
    process_new_files(spark, src, df.schema, op, out, cp)
    assert spark.read.parquet(out).count() == 4
    assert [r.k for r in only_new(df, spark.createDataFrame([("a",), (None,)], "k string"), "k").collect()] == ["b"]
