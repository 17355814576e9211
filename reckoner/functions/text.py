"""Column helpers for text and for values that come in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Drop outer white space of any kind (trim() drops spaces alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def spelling(c: Column) -> Column:
    """One spelling for a code: lower case, no outer blanks, `_` for `-` and blanks; '' becomes null."""
    s = F.lower(F.regexp_replace(strip(c), r"[-\s]", "_"))
    return F.when(s != "", s)


def repo_key(c: Column) -> Column:
    """One spelling for a repository: lower case, no outer blanks, no final `/` or `.git`; '' becomes null."""
    s = F.regexp_replace(F.lower(strip(c)), r"(\.git|/)+$", "")
    return F.when(s != "", s)


def name_words(c: Column) -> Column:
    """The distinct words of a field name: camelCase and `_` split, lower case, no plural s."""
    parts = F.split(F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "(?<=..)s$", "")), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
