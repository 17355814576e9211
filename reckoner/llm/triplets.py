"""Weighted medians over all triplets of annotators, whatever their number.

Few triplets are joined as rows. More are never rows: annotators fall into blocks by hash, and each cell of three blocks (of i, j and k) gets the pairs
between them, so a task holds three times BLOCK_EDGES pairs, and a pair travels to about twice the number of blocks. Each cell goes through its triplets
in two passes: the first counts weights by BINS ranges of the value, the second gives the distinct values of the one or two ranges that hold the middle.
Both ways take every triplet and give the same medians.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

MAX_JOINED = 1_000_000  # triplets up to which they are joined as rows
BLOCK_EDGES = 100_000  # pairs between two blocks of annotators, about
MAX_TASKS = 100_000  # tasks up to which their numbers of blocks are broadcast
BINS = 1024  # ranges of values from 0 to 1, and one of all from 1
FEW_SHARED = 20  # shared items at which a triplet weighs half
MOST = 0.99  # medians are cut to it
WEDGES, OWNERS = 1 << 20, 512  # candidates and annotators that are looked up at once
IJ, IK, JK = 0, 1, 2  # roles of a pair in a cell


def medians(near: DataFrame, e: DataFrame) -> DataFrame:
    """(task, i, knows): the median over triplets of the square root of e_ij * e_ik / e_jk; pairs of i from near, those of j and k from e.

    Both hold (task, i, j, e, n), e each pair in both directions. Triplets weigh as e_jk squared, the inverse of the variance that a small
    denominator brings, and less if two of the three share few items (half at FEW_SHARED).
    """
    degree = F.col("d").cast("double")
    some = near.groupBy("task", "i").agg(F.count(F.lit(1)).alias("d")).agg(F.sum(degree * (degree - 1) / 2)).first()[0] or 0
    return (by_join if some <= MAX_JOINED else by_blocks)(near, e)


def by_join(near: DataFrame, e: DataFrame) -> DataFrame:
    ij, ik = near.select("task", "i", "j", F.col("e").alias("ij"), F.col("n").alias("nij")), near.select("task", "i", F.col("j").alias("k"), F.col("e").alias("ik"), F.col("n").alias("nik"))
    jk = e.select("task", F.col("i").alias("j"), F.col("j").alias("k"), F.col("e").alias("jk"), F.col("n").alias("njk"))
    t = ij.join(ik, ["task", "i"]).where("j < k").join(jk, ["task", "j", "k"]).where("jk > 0")
    square = F.greatest(F.col("ij") * F.col("ik") / F.col("jk"), F.lit(0.0))
    signed = F.when((F.col("ij") <= 0) & (F.col("ik") <= 0), 0.0).otherwise(F.sqrt(square))
    fewest = F.least("nij", "nik", "njk")
    t = t.select("task", "i", signed.alias("a"), F.ceil(1000 * F.col("jk") * F.col("jk") * fewest / (fewest + FEW_SHARED)).alias("w"))
    return t.groupBy("task", "i").agg(F.least(F.expr("percentile(a, 0.5, w)"), F.lit(MOST)).alias("knows"))


def by_blocks(near: DataFrame, e: DataFrame) -> DataFrame:
    near, e = cut(near.dropna(subset=["task", "i", "j"])), cut(e.dropna(subset=["task", "i", "j"]))
    blocks = e.groupBy("task").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / BLOCK_EDGES)).cast("int").alias("_n"))
    blocks = broadcast_if_small(blocks, MAX_TASKS)
    every = near.withColumn("least", F.lit(0)).withColumn("most", F.lit(BINS))
    bins = cut(_middle(_visit(every, e, blocks, binned=True)))
    # A middle from 1 on is cut to MOST, whatever it is; all others follow from the values of their ranges.
    open_ = bins.where(F.col("low") < BINS).select("task", "i", F.col("low").cast("int").alias("least"), F.col("high").cast("int").alias("most"), "before", "total")
    values = _visit(near.join(open_.drop("before", "total"), ["task", "i"]), e, blocks, binned=False)
    exact = _middle(values, open_).select("task", "i", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0.5 * F.col("low") + 0.5 * F.col("high")).alias("a"))
    return bins.select("task", "i").join(exact, ["task", "i"], "left").select("task", "i", F.least(F.coalesce("a", F.lit(MOST)), F.lit(MOST)).alias("knows"))


def _middle(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(task, i, low, high, before, total): the values at the lower and upper middle of the weight w, the weight before low and in all.

    known has the weight before all of the rows, and the total, where the rows are not all there is.
    """
    group = Window.partitionBy("task", "i")
    s = rows.groupBy("task", "i", "value").agg(F.sum("w").alias("w"))
    s = s.withColumn("before", F.lit(0)).withColumn("total", F.sum("w").over(group)) if known is None else s.join(known.select("task", "i", "before", "total"), ["task", "i"])
    running = F.sum("w").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumn("upto", F.col("before") + running)
    half = F.when(2 * F.col("upto") >= F.col("total"), F.struct("value", (F.col("upto") - F.col("w")).alias("before")))
    m = s.groupBy("task", "i").agg(F.min(half).alias("m"), F.min(F.when(2 * F.col("upto") > F.col("total"), F.col("value"))).alias("high"), F.max("total").alias("total"))
    return m.select("task", "i", F.col("m.value").alias("low"), "high", F.col("m.before").alias("before"), "total")


def _visit(near: DataFrame, e: DataFrame, blocks: DataFrame, binned: bool) -> DataFrame:
    """(task, i, value, w): weights by range, or by value in the ranges from least to most of i, as each cell has them."""
    block = lambda name: F.pmod(F.xxhash64(name), F.col("_n")).cast("int")
    cell = lambda i, j, k: F.struct(i.alias("bi"), j.alias("bj"), k.alias("bk"))
    x, y, last = F.col("_x"), F.col("_y"), F.col("_n") - 1

    def rows(df: DataFrame, role: int, cells, *ranges) -> DataFrame:
        return df.select("task", F.explode(cells).alias("c"), F.lit(role).alias("role"), "i", "j", "e", "n", *ranges).select("task", "c.*", "role", "i", "j", "e", "n", "least", "most")

    own = near.join(blocks, "task").withColumn("_x", block("i")).withColumn("_y", block("j"))
    others = e.where("e > 0").join(blocks, "task").withColumn("_x", block("i")).withColumn("_y", block("j")).where("_x < _y or (_x = _y and i < j)")
    none = F.lit(0).alias("least"), F.lit(0).alias("most")
    placed = (
        rows(own, IJ, F.transform(F.sequence(y, last), lambda c: cell(x, y, c)), "least", "most")
        .unionByName(rows(own, IK, F.transform(F.sequence(F.lit(0), y), lambda c: cell(x, c, y)), "least", "most"))
        .unionByName(rows(others, JK, F.transform(F.sequence(F.lit(0), last), lambda c: cell(c, x, y)), *none))
    )
    return placed.groupBy("task", "bi", "bj", "bk").applyInPandas(_binned if binned else _valued, "task string, i string, value double, w long")


def _binned(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    def sums(owners: np.ndarray, owner: np.ndarray, value: np.ndarray, bin_: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = np.bincount(owner * (BINS + 1) + bin_, w, minlength=len(owners) * (BINS + 1))
        at = np.flatnonzero(total)
        return owners[at // (BINS + 1)], (at % (BINS + 1)).astype(float), total[at]

    return _collect(key, rows, sums)


def _valued(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    def sums(owners: np.ndarray, owner: np.ndarray, value: np.ndarray, bin_: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((value, owner))
        owner, value, w = owner[order], value[order], w[order]
        first = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(value) != 0)])
        return owners[owner[first]], value[first], np.add.reduceat(w, first)

    return _collect(key, rows, sums)


def _collect(key: tuple, rows: pd.DataFrame, sums) -> pd.DataFrame:
    names, found = _triplets(rows)
    parts = [sums(*f) for f in found if len(f[1])]
    if not parts:
        return pd.DataFrame({"task": [], "i": [], "value": [], "w": []})
    i, value, w = (np.concatenate(p) for p in zip(*parts))
    return pd.DataFrame({"task": key[0], "i": names[i], "value": value, "w": w.astype("int64")})


def _triplets(rows: pd.DataFrame) -> tuple[np.ndarray, Iterator[tuple]]:
    """The names of the annotators i of a cell, and its triplets in parts: (numbers of the annotators, which of them, value, range, weight).

    An annotator with few candidates has each pair of its j and k looked up, many annotators at once; one with more marks its own among the pairs of the cell.
    """
    role = rows["role"].to_numpy()
    ij, ik, jk = (rows[role == r] for r in (IJ, IK, JK))
    js, ks, names = (pd.Index(c.unique()) for c in (jk["i"], jk["j"], ij["i"]))

    def side(df: pd.DataFrame, index: pd.Index) -> tuple[np.ndarray, ...]:
        """Where the pairs of each annotator start, and their partners, agreements and shared items."""
        i, other = names.get_indexer(df["i"]), index.get_indexer(df["j"])
        order = np.argsort(np.where(other >= 0, i, -1), kind="stable")
        order = order[np.count_nonzero((i < 0) | (other < 0)):]
        return np.searchsorted(i[order], np.arange(len(names) + 1)), other[order], df["e"].to_numpy()[order], df["n"].to_numpy()[order]

    sj, j, je, jn = side(ij, js)
    sk, k, ke, kn = side(ik, ks)
    pj, pk = js.get_indexer(jk["i"]), ks.get_indexer(jk["j"])
    order = np.argsort(pj * len(ks) + pk)
    pj, pk, pe, pn = pj[order], pk[order], jk["e"].to_numpy()[order], jk["n"].to_numpy()[order]
    code = pj * len(ks) + pk
    ranges = ij[["i", "least", "most"]].drop_duplicates("i")
    least, most = ranges["least"].to_numpy(), ranges["most"].to_numpy()  # in the order of names
    dj, dk = np.diff(sj), np.diff(sk)
    cost = dj * dk
    marked = (cost > 1000) & (cost * 8 > len(code))

    def part(owners: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple:
        x, y, z = je[a], ke[b], pe[p]
        fewest = np.minimum(np.minimum(jn[a], kn[b]), pn[p])
        with np.errstate(over="ignore"):
            value = np.where((x <= 0) & (y <= 0), 0.0, np.sqrt(np.maximum(x * y / z, 0.0))) + 0.0
        w = np.ceil(1000 * z * z * fewest / (fewest + FEW_SHARED))
        bin_ = (np.minimum(value, 1.0) * BINS).astype("int64")
        keep = (w > 0) & (bin_ >= least[owners][owner]) & (bin_ <= most[owners][owner])
        return owners, owner[keep], value[keep], bin_[keep], w[keep]

    def found() -> Iterator[tuple]:
        at_j, at_k = np.full(len(js), -1), np.full(len(ks), -1)
        for i in np.flatnonzero(marked):
            mine, its = j[sj[i]:sj[i + 1]], k[sk[i]:sk[i + 1]]
            at_j[mine], at_k[its] = np.arange(sj[i], sj[i + 1]), np.arange(sk[i], sk[i + 1])
            a, b = at_j[pj], at_k[pk]
            p = np.flatnonzero((a >= 0) & (b >= 0))
            yield part(np.array([i]), np.zeros(len(p), "int64"), a[p], b[p], p)
            at_j[mine], at_k[its] = -1, -1
        few = np.flatnonzero(~marked & (cost > 0))
        step = np.cumsum(cost[few]) // WEDGES * (len(few) + 1) + np.arange(len(few)) // OWNERS
        for owners in np.split(few, np.flatnonzero(np.diff(step)) + 1) if len(code) and len(few) else ():
            owner = np.repeat(np.arange(len(owners)), cost[owners])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(cost[owners]) - cost[owners], cost[owners])
            a, b = sj[owners][owner] + nth // dk[owners][owner], sk[owners][owner] + nth % dk[owners][owner]
            wanted = j[a] * len(ks) + k[b]
            p = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            hit = code[p] == wanted
            yield part(owners, owner[hit], a[hit], b[hit], p[hit])

    return names.to_numpy(), found()
