"""Rules that emit error rows, corrections with five outcomes, and gates before publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .ladders import ladder



def RECORD_RULES() -> dict[str, Column]:
    """Vocabulary and cross-field rules of an annotation record; true marks an error."""
    api, fate = F.upper(strip(F.col("is_api_use"))), F.coalesce(F.size("value_fate"), F.lit(0))
    n_fate = F.greatest(fate, F.lit(0))
    n_verdicts = F.greatest(F.coalesce(F.size("constraint_verdicts"), F.lit(0)), F.lit(0))
    return {
        "MISSING_API_USE": api.isNull(), "BAD_API_USE": ~api.isin("YES", "NO", "UNSURE"), "MISSING_UNIT_CONFIRMED": F.col("unit_confirmed").isNull(),
        "BAD_SITE_ID": F.col("site_id").isNull() | ~F.lower(strip(F.col("site_id"))).rlike("^[0-9a-f]{16}$"),
        "NO_WITH_FATE": (api == "NO") & (n_fate > 0), "NO_WITH_VERDICTS": (api == "NO") & (n_verdicts > 0), "YES_WITHOUT_FATE": (api == "YES") & (n_fate == 0),
        "REPEATED_FATE": F.size("value_fate") > F.size(F.array_distinct("value_fate")), "RRA_WITH_ALT": (F.col("site_class") == "RRA") & F.col("alt_equivalence").isNotNull(),
        "LOADED_BEFORE": F.col("loaded_at") < F.col("annotated_at"),
    }


def violations(df: DataFrame, rules, keys: list[str]) -> DataFrame:
    """(keys, rule): one row per rule that a row breaks, in one pass; null predicates break nothing."""
    found = F.array_compact(F.array(*[F.when(p, name) for name, p in rules().items()]))
    return df.select(*keys, F.explode(found).alias("rule"))


def patch(df: DataFrame, old: str, new: str, got: str) -> DataFrame:
    """df with `outcome` and `patched`: only a mark that follows the old rule where the rules differ is rewritten."""
    o, n, g = F.col(old), F.col(new), F.col(got)
    outcome = ladder([("NOT_APPLICABLE", o.isNull() | n.isNull()), ("SAME_UNDER_BOTH", o == n), ("FLIPPED", g == o), ("ALREADY_NEW", g == n)], "DIVERGENT")
    return df.withColumn("outcome", outcome).withColumn("patched", F.when(F.col("outcome") == "FLIPPED", n).otherwise(g))


def gate_rows(counts: dict[str, DataFrame]) -> DataFrame:
    """(gate, passed, n): one row per gate; a gate passes if its count of offences is 0."""
    parts = [df.select(F.lit(g).alias("gate"), (F.col("n") == 0).alias("passed"), F.col("n").cast("long").alias("n")) for g, df in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def publish(df: DataFrame, gates: DataFrame, path: str) -> None:
    """Write df to a new folder if every gate passes; otherwise raise and write nothing. An existing folder is never replaced."""
    failed = [r.gate for r in gates.where(~F.coalesce("passed", F.lit(False))).collect()]  # gates are declared, so few
    if failed:
        raise ValueError("gates failed: " + ", ".join(sorted(failed)))
    df.write.mode("errorifexists").parquet(path)
