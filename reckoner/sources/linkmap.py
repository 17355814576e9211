"""Linker maps as text: sections tagged by window, rows parsed per section, bad lines kept, objects classified in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import trim_spans
from ..operators.ladders import ladder

# The comment lines that open a section of a map, and the row pattern of each section.
MARKERS = {"# Object files:": "objects", "# Sections:": "sections", "# Symbols:": "symbols", "# Dead Stripped Symbols:": "dead"}
ROW = {
    "objects": r"^\[\s*(\d+)\]\s(.*)$",
    "sections": r"^0x([0-9A-Fa-f]+)\t0x([0-9A-Fa-f]+)\t(\S+)\t(\S+)$",
    "symbols": r"^0x([0-9A-Fa-f]+)\t0x([0-9A-Fa-f]+)\t\[\s*(\d+)\]\s(.*)$",
    "dead": r"^<<dead>>\t0x([0-9A-Fa-f]+)\t\[\s*(\d+)\]\s(.*)$",
}
# Folders below Pods/ that are no pods.
POD_SCAFFOLD = ["Target Support Files", "Headers", "Local Podspecs", "Pods.xcodeproj"]


def hex_long(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, ln, line) of every map below path; .gz files are read as they are."""
    return tag_lines(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("map_id"), F.posexplode(F.split("value", "\r?\n")).alias("ln", "line")))


def tag_lines(lines: DataFrame) -> DataFrame:
    """lines with `section`, carried down from the last marker, and `bad`: in a section, but not of its form."""
    marker = F.coalesce(*[F.when(F.col("line").startswith(m), s) for m, s in MARKERS.items()])
    w = Window.partitionBy("map_id").orderBy("ln")
    tagged = lines.withColumn("section", F.last(marker, ignorenulls=True).over(w)).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    good = F.lit(False)
    for s, p in ROW.items():
        good |= (F.col("section") == s) & F.col("line").rlike(p)
    return tagged.withColumn("bad", F.col("section").isNotNull() & ~good)


def _rows(tagged: DataFrame, section: str) -> tuple[DataFrame, list[Column]]:
    rows = tagged.where((F.col("section") == section) & ~F.col("bad"))
    groups = {"objects": 2, "sections": 4, "symbols": 4, "dead": 3}[section]
    return rows, [F.regexp_extract("line", ROW[section], i + 1) for i in range(groups)]


def objects(tagged: DataFrame) -> DataFrame:
    """(map_id, idx, path, unit, kind, rule, archive, member, archive_name_agrees, target, project): first rule that fits wins; LTO output has no unit; no fit is UNKNOWN."""
    rows, (idx, path) = _rows(tagged, "objects")
    o = rows.select("map_id", idx.cast("int").alias("idx"), path.alias("path"))
    p = F.col("path")
    archive, lib, member = (F.regexp_extract(p, r"^(.*/([^/]+)\.a)\(([^)]+)\)$", n) for n in (1, 2, 3))
    pod = F.regexp_extract(archive, r"/Pods/([^/]+)/", 1)
    folder = F.regexp_extract(archive, r"/Build/Products/[^/]+/([^/]+)/[^/]+\.a$", 1)
    target = F.regexp_extract(p, r"/Intermediates\.noindex/[^/]+\.build/[^/]+/([^/]+)\.build/.*?/[^/]+\.o$", 1)
    base = F.regexp_extract(p, r"([^/]+)$", 1)
    framework = F.regexp_extract(p, r"([^/]+)\.framework/", 1)
    rungs = [
        ("INDEX_ZERO", (F.col("idx") == 0) | (p == "linker synthesized"), None, "LINKER_SYNTHESIZED"),
        ("POD_VENDORED_ARCHIVE", (pod != "") & ~pod.isin(POD_SCAFFOLD), pod, "COCOAPOD"),
        ("POD_BUILT_FROM_SOURCE", (folder != "") & (lib == F.concat(F.lit("lib"), folder)), folder, "COCOAPOD"),
        ("BUILT_PRODUCT_ARCHIVE", folder != "", folder, "STATIC_ARCHIVE"),
        ("ARCHIVE_MEMBER", archive != "", lib, "STATIC_ARCHIVE"),
        ("LTO_OUTPUT", p.rlike(r"/Objects-normal/[^/]+/[^/]+_lto\.o$"), None, "LTO_MERGED"),
        ("TARGET_INTERMEDIATE", target != "", target, "TARGET_OBJECT"),
        ("TBD", p.endswith(".tbd"), F.regexp_replace(base, r"\.tbd$", ""), "DYLIB_STUB"),
        ("DYLIB", p.endswith(".dylib"), F.regexp_replace(base, r"\.dylib$", ""), "DYLIB"),
        ("BUILD_PRODUCT_OBJECT", p.contains("/Build/Products/") & p.endswith(".o"), F.regexp_replace(base, r"\.o$", ""), "MERGED_PRODUCT"),
        ("FRAMEWORK_BINARY", framework != "", framework, "FRAMEWORK"),
        ("BARE_OBJECT", p.endswith(".o"), F.regexp_replace(base, r"\.o$", ""), "OBJECT"),
    ]
    rule = ladder([(name, cond) for name, cond, _, _ in rungs], "NO_RULE_MATCHED")
    o = o.withColumn("rule", rule)
    unit, kind = F.lit(None).cast("string"), F.lit("UNKNOWN")
    for name, _, u, k in rungs:
        unit = F.when(F.col("rule") == name, u if u is not None else F.lit(None).cast("string")).otherwise(unit)
        kind = F.when(F.col("rule") == name, k).otherwise(kind)
    some = lambda c, when=F.lit(True): F.when((c != "") & when, c)
    made = F.col("rule") == "TARGET_INTERMEDIATE"
    intermediate = r"/Intermediates\.noindex/([^/]+)\.build/[^/]+/([^/]+)\.build/.*?/([^/]+\.o)$"
    stem = F.regexp_extract(p, r"/Objects-normal/[^/]+/([^/]+)_lto\.o$", 1)
    agrees = F.when(F.col("rule").isin("POD_VENDORED_ARCHIVE", "POD_BUILT_FROM_SOURCE", "BUILT_PRODUCT_ARCHIVE"), lib == F.concat(F.lit("lib"), unit))
    return o.select(
        "map_id", "idx", "path", unit.alias("unit"), kind.alias("kind"), "rule", some(lib).alias("archive"),
        F.coalesce(some(member), some(F.regexp_extract(p, intermediate, 3), made)).alias("member"), agrees.alias("archive_name_agrees"),
        F.when(F.col("rule") == "LTO_OUTPUT", F.coalesce(some(F.regexp_extract(p, intermediate, 2)), stem)).alias("target"), some(F.regexp_extract(p, intermediate, 1), made).alias("project"),
    )


def sections(tagged: DataFrame) -> DataFrame:
    rows, (addr, size, segment, section) = _rows(tagged, "sections")
    return rows.select("map_id", F.col("ln").alias("ord"), hex_long(addr).alias("addr"), hex_long(size).alias("size"), segment.alias("segment"), section.alias("name"))


def symbols(tagged: DataFrame) -> DataFrame:
    rows, (addr, size, idx, name) = _rows(tagged, "symbols")
    return rows.select("map_id", "ln", hex_long(addr).alias("addr"), hex_long(size).alias("size"), idx.cast("int").alias("idx"), name.alias("name"))


def spans(tagged: DataFrame) -> DataFrame:
    """(map_id, start, end, idx): the address ranges of symbols, trimmed so that none overlap."""
    s = symbols(tagged).select("map_id", F.col("addr").alias("start"), (F.col("addr") + F.col("size")).alias("end"), "idx")
    return trim_spans(s, ["map_id"], "idx")


def summary(tagged: DataFrame) -> DataFrame:
    """One row per map: objects, symbols, symbols of a size, symbols without a unit, bad lines, covered share of __text."""
    o, s = objects(tagged), symbols(tagged)
    own = s.join(o.select("map_id", "idx", "unit"), ["map_id", "idx"], "left").groupBy("map_id").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("size") > 0).alias("n_sized"), F.count_if((F.col("size") > 0) & F.col("unit").isNull()).alias("n_unattributed"), F.countDistinct("unit").alias("n_units")
    )
    text = sections(tagged).where("name = '__text'").groupBy("map_id").agg(F.min_by("addr", "ord").alias("lo"), F.min_by("size", "ord").alias("text_size"))
    part = F.greatest(F.least("end", F.col("lo") + F.col("text_size")) - F.greatest("start", "lo"), F.lit(0))
    covered = spans(tagged).join(text, "map_id").groupBy("map_id", "text_size").agg(F.sum(part).alias("covered"))
    bad = tagged.groupBy("map_id").agg(F.count_if("bad").alias("n_bad"))
    n_obj = o.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_objects"))
    return bad.join(n_obj, "map_id", "left").join(own, "map_id", "left").join(covered, "map_id", "left").withColumn("coverage", F.try_divide("covered", "text_size"))
