"""Newly arrived files through the batch operators: a file stream with AvailableNow and foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_new_files(
    spark: SparkSession, source: str, schema: T.StructType, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet"
) -> None:
    """Apply a batch operator to the files below source that no earlier run has seen, and append its result to out.

    Each micro-batch goes to a folder of its own number, which is overwritten on a retry, so a batch counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).format(fmt).load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def only_new(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The rows whose key an earlier result does not hold; rows without key are new each time."""
    return df.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
