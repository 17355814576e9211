"""Mixtures of sources by target weights.

Sizes are tokens of a public tokenizer, summed per source. Per mix, a source's rate is weight * size of all
documents / size of the source, capped at max_repeat; each document is emitted floor(rate) times and once more if a
seeded hash of it falls below the fraction. Shares reached and sources that fall short are reported.

A null or empty text has size 0; documents without a source count in the size of all documents and are in no mix.
Targets for a source without documents fall short wholly. Rates of 0 emit nothing. Empty tables give empty results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import spelling
from ..session import broadcast_if_small, cut, spread

DEFAULT_TOKENIZER = os.environ.get("RECKONER_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
MAX_TARGETS = 100_000  # rows of mix_targets up to which rates are broadcast


def token_count(spark, path: str = DEFAULT_TOKENIZER):
    """A column function: tokens of a text under the tokenizer file, which travels to the workers once (a few MB)."""
    with open(path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model.value)
        t.encode_special_tokens = True
        for s in parts:
            out: list[int] = []
            texts = s.fillna("").tolist()
            for i in range(0, len(texts), 256):
                out += [len(e) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pd.Series(out, dtype="int64")

    return count


def document_sizes(documents: DataFrame, size) -> DataFrame:
    """(doc_id, source, n): the size of each document, in the spelling of its source that all share; size is a function of the text column."""
    return spread(documents.select("doc_id", "source", "text")).select("doc_id", spelling(F.col("source")).alias("source"), F.coalesce(size("text"), F.lit(0)).cast("long").alias("n"))


def source_sizes(documents: DataFrame, tokens) -> DataFrame:
    """(source, n_docs, size): spellings of a source count together; documents without a source stand under null."""
    return spread(documents.select("source", "text")).select(spelling(F.col("source")).alias("source"), tokens("text").alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("size"))


def plan(sizes: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(mix_id, source, weight, max_repeat, n_docs, size, wanted, rate, expected, is_short), one row per target.

    expected is the size that the rate gives on average; is_short tells that even max_repeat copies stay below wanted.
    """
    sizes = cut(sizes)  # one row per source; texts are tokenized once, not once per use
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    per = sizes.where(F.col("source").isNotNull())
    t = mix_targets.select("mix_id", F.col("source").alias("label"), spelling(F.col("source")).alias("source"), "weight", "max_repeat")
    t = t.join(per, "source", "left").crossJoin(F.broadcast(total)).withColumn("size", F.coalesce("size", F.lit(0)))
    wanted = F.col("weight") * F.col("total")
    rate = F.when(F.col("size") > 0, F.least(F.col("max_repeat").cast("double"), wanted / F.col("size"))).otherwise(0.0)
    t = t.withColumn("wanted", wanted).withColumn("rate", rate).withColumn("expected", F.col("rate") * F.col("size"))
    return t.select(
        "mix_id", F.col("label").alias("source"), F.col("source").alias("source_key"), "weight", "max_repeat", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "size", "wanted",
        "rate", "expected", (F.col("max_repeat") * F.col("size") < F.col("wanted")).alias("is_short"),
    )


def reached_shares(sizes: DataFrame, mix_targets: DataFrame, seed: str = "mix-1") -> DataFrame:
    """plan() of the documents in sizes (doc_id, source, n) with `emitted`, the size of the copies that mixture() emits, and `reached`, its share of the mix.

    Every document decides by its own hash how often it stands in a mix, so sizes are summed where they lie.
    """
    sizes = cut(sizes)  # texts are measured once
    p = cut(plan(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("size")), mix_targets))
    out = mixture(sizes, p, seed).groupBy("mix_id", F.col("source").alias("source_key")).agg(F.sum("n").alias("emitted"))
    out = p.join(out, ["mix_id", "source_key"], "left").withColumn("emitted", F.coalesce("emitted", F.lit(0)))
    whole = out.groupBy("mix_id").agg(F.sum("emitted").alias("_all"))
    return out.join(whole, "mix_id").withColumn("reached", F.try_divide("emitted", "_all")).drop("_all")


def copies(rate: Column, seed: Column) -> Column:
    """floor(rate), and one more with the probability of the fraction, by a hash of the seed."""
    u = F.conv(F.substring(F.sha1(seed), 1, 10), 16, 10).cast("double") / float(1 << 40)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixture(documents: DataFrame, rates: DataFrame, seed: str = "mix-1") -> DataFrame:
    """(mix_id, doc_id, source, copy): the documents of every mix, repeated ones with copy numbers 1, 2, ...; with the size n if documents has it."""
    r = broadcast_if_small(rates.select("mix_id", F.col("source_key").alias("source"), "rate").where("rate > 0"), MAX_TARGETS)
    docs = documents.select("doc_id", spelling(F.col("source")).alias("source"), *[c for c in documents.columns if c == "n"])
    n = copies(F.col("rate"), F.concat_ws("|", F.lit(seed), "mix_id", F.col("doc_id").cast("string")))
    out = docs.join(r, "source").withColumn("_n", n).where("_n > 0")
    return out.select("mix_id", "doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"), *[c for c in docs.columns if c == "n"])
