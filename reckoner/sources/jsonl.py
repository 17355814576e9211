"""JSON-lines files: comments, blanks and broken lines are kept apart, not fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ladders import ladder

# Fixed value: how an output file's name gives its unit, tree and name parted by two underscores.
UNIT_IN_NAME = r"^[ab]\d+__([a-z]+)__(.+?)(?:\.out)?\.jsonl$"


def line_kind(line: Column) -> Column:
    """BLANK, COMMENT, BROKEN, NOT_OBJECT or RECORD; null is BLANK."""
    v = F.try_parse_json(line)
    return ladder([
        ("BLANK", line.isNull() | line.rlike(r"^\s*$")), ("COMMENT", line.rlike(r"^\s*#")), ("BROKEN", v.isNull()),
        ("NOT_OBJECT", ~F.schema_of_variant(v).startswith("OBJECT")),
    ], "RECORD")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ln, line, kind, unit): the numbered lines of every file below path."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = whole.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("ln", "line")).withColumn("ln", F.col("ln") + 1)
    name = F.substring_index("file", "/", -1)
    unit = F.concat_ws("/", F.regexp_extract(name, UNIT_IN_NAME, 1), F.regexp_extract(name, UNIT_IN_NAME, 2))
    return rows.withColumn("kind", line_kind(F.col("line"))).withColumn("unit", F.when(name.rlike(UNIT_IN_NAME), unit))


def header_and_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, rows): the first record of each file is its header, all further records are rows."""
    r = lines.where("kind = 'RECORD'").withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("ln")))
    return r.where("_n = 1").drop("_n"), r.where("_n > 1").drop("_n")
