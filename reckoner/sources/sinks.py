"""Sinks: one folder per key, batches with a header line, small Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_by(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in one folder per value of key; rows of a value are first brought together, hot values split by salt."""
    salt = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in df.columns[:3]]), F.lit(8))
    df.repartition(F.col(key), salt).write.mode(mode).partitionBy(key).json(path)


def write_batches(headers: DataFrame, rows: DataFrame, batch: str, order: list[str], path: str) -> None:
    """Text files in which each batch is its header followed by its rows in order (columns in their own types), batches kept whole within a file."""
    r = rows.select(F.col(batch).alias("_b"), F.lit(1).alias("_n"), F.to_json(F.struct(*rows.columns)).alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    none = [F.lit(None).cast(r.schema[f"_o{i}"].dataType).alias(f"_o{i}") for i in range(len(order))]
    h = headers.select(F.col(batch).alias("_b"), F.lit(0).alias("_n"), F.to_json(F.struct(*headers.columns)).alias("value"), *none)
    every = h.unionByName(r).repartition("_b").sortWithinPartitions("_b", "_n", *[f"_o{i}" for i in range(len(order))])
    every.select("value").write.text(path)


def to_markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; at most `most` rows are fetched, and a last line tells if more exist."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + (["", f"More than {most} rows."] if len(rows) > most else []))
