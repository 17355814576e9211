"""Evaluation texts that leaked into training text, by suffix arrays over shards of the training text.

Documents and items are brought into one plain form. Each shard of documents becomes a sorted array of suffixes, in which every suffix of
every item is binary-searched; that gives all verbatim matches with their places. A match is then extended on both sides over changed, dropped or
added words; it is a leak if LEAST words of the item stand in a row with at most one in ten edited. Of the best match of a document and an item the
passage is followed as far as that share allows. Items in Chinese are matched by character. The opening sentence that several items share is cut off first.

Seeds of SEED words lose nothing: LEAST words with a tenth edited always hold an unedited run of that length. Suffixes that can't start such a run
(two words within it that follow each other in no item) are left out of the array.

The corpus is read once. Items of up to MAX_ITEM_CHARS characters in all are counted first and then broadcast, so documents never leave their tasks.
Larger sets of items never meet the driver: they are cut into blocks of that size and documents into shards of SHARD_CHARS by hash, and each pair of
shard and block is one group of a co-grouped shuffle. Frequent seeds need no shuffle of their own in either way.

Null and empty texts match nothing, as do rows without doc_id or item_id; items shorter than LEAST can't leak; repeated documents each get their rows;
texts of any length are scanned whole. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .plaintext import plain, plain_text

WORDS, CHARS = "words", "chars"
LEAST = {WORDS: 20, CHARS: 40}
SEED = {WORDS: 6, CHARS: 8}
DEPTH = 16  # tokens by which suffixes are sorted; longer matches are followed in the text
MAX_ITEM_CHARS = 32_000_000
SHARD_CHARS = 32_000_000
SHARD_TOKENS = 2_000_000  # tokens of one suffix array within a task
HITS = 20_000  # matches that are looked at together
SCHEMA = "doc_id long, item_id long, verbatim int, span int, edits int, place long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
SENTENCE_END = r"^(.*?(?:[。？！]+|[.?!]+(?=\s|$)))"


def without_shared_openings(items: DataFrame) -> DataFrame:
    """(item_id, unit, text): items in plain form, less an opening sentence that two or more items have; one that is all of an item stays."""
    opening = plain(F.regexp_extract("text", SENTENCE_END, 1))
    t = items.where("item_id is not null").select("item_id", F.when(F.lower("lang").startswith("zh"), CHARS).otherwise(WORDS).alias("unit"), plain(F.col("text")).alias("text"), opening.alias("opening"))
    shared = t.where("opening <> ''").groupBy("opening").agg(F.count_distinct("item_id").alias("n")).where("n > 1").select("opening", F.lit(True).alias("shared"))
    rest = F.expr("trim(substring(text, length(opening) + 1))")
    return t.join(shared, "opening", "left").select("item_id", "unit", F.when(F.col("shared") & (rest != ""), rest).otherwise(F.col("text")).alias("text")).where("text <> ''")


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.replace(" ", "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Items:
    """The items of one unit as codes (from 1; 0 parts them), one after the other, and the sorted keys of their suffixes."""

    def __init__(self, rows: list[tuple[int, str]], unit: str):
        self.unit, self.least, self.seed = unit, LEAST[unit], SEED[unit]
        self.code: dict[str, int] = {}
        if unit == WORDS:
            number = self.code
            each = [(i, [number.setdefault(w, len(number) + 1) for w in t.split()]) for i, t in rows if t.count(" ") + 1 >= self.least]
        else:
            each = [(i, c) for i, c in ((i, _chars(t)) for i, t in rows) if len(c) >= self.least]
        self.ids = np.array([i for i, _ in each], dtype=np.int64)
        length = np.array([len(c) for _, c in each], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(length + 1)]).astype(np.int64)
        self.text = np.zeros(self.start[-1] + DEPTH, dtype=np.uint32)
        for s, (_, c) in zip(self.start.tolist(), each):
            self.text[s : s + len(c)] = c
        if unit == CHARS and len(each):
            seen = np.unique(self.text[self.text > 0])
            self.table = np.zeros(int(seen.max()) + 1, dtype=np.uint32)
            self.table[seen] = np.arange(1, len(seen) + 1)
            self.text = self.table[self.text]
        # Texts in ASCII alone may be passed over if each passage has more other characters than may be edited.
        self.beyond_ascii = unit == CHARS and all(
            (o[self.least :] - o[: -self.least]).min() > self.least // 10 for o in (np.cumsum(np.concatenate([[0], c > 127])) for _, c in each)
        )
        self.follows = np.unique(_pairs(self.text))
        self.pos = _starts(self.text, self.seed)
        heads = self.text[self.pos[:, None] + np.arange(self.seed)[None, :]]
        pad = np.zeros((len(heads), DEPTH - self.seed), dtype=np.uint32)
        self.low, self.high = _keys(np.hstack([heads, pad])), _keys(np.hstack([heads, pad + np.uint32(0xFFFFFFFF)]))

    def codes(self, text: str) -> np.ndarray:
        """A document's tokens as codes, 0 for what no item has."""
        if self.unit == WORDS:
            get = self.code.get
            return np.array([get(w, 0) for w in text.split()], dtype=np.uint32)
        c = _chars(text)
        return self.table[np.where(c < len(self.table), c, 0)]


def _pairs(text: np.ndarray) -> np.ndarray:
    """Each two codes that follow each other as one number; 0 where one of them is 0."""
    a, b = text[:-1].astype(np.uint64), text[1:].astype(np.uint64)
    return np.where((a > 0) & (b > 0), (a << np.uint64(32)) | b, np.uint64(0))


def _starts(text: np.ndarray, seed: int, follows: np.ndarray | None = None) -> np.ndarray:
    """Places where `seed` codes above 0 begin, each two of which stand in `follows` (sorted)."""
    if len(text) < seed:
        return np.empty(0, dtype=np.int64)
    pairs = _pairs(text)
    good = pairs > 0
    if follows is not None:
        some = np.flatnonzero(good)
        at = np.minimum(np.searchsorted(follows, pairs[some]), len(follows) - 1)
        good[some[follows[at] != pairs[some]]] = False
    run = np.concatenate([[0], np.cumsum(good)])
    return np.flatnonzero(run[seed - 1 :] - run[: len(run) - seed + 1] == seed - 1)


def _keys(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings, which sort as the rows do."""
    if not len(codes):
        return np.empty(0, dtype=f"S{4 * DEPTH + 1}")
    # A final byte keeps numpy from cutting trailing zeros, so equal keys stay equal.
    raw = np.ascontiguousarray(codes.astype(">u4")).view(np.uint8).reshape(len(codes), -1)
    raw = np.hstack([raw, np.ones((len(raw), 1), np.uint8)])
    return np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel()


def suffix_array(text: np.ndarray, seed: int, follows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places), sorted by the first DEPTH codes: the suffixes of text that begin with `seed` codes above 0, each two of which are in `follows`."""
    start = _starts(text, seed, follows)
    padded = np.concatenate([text, np.zeros(DEPTH, text.dtype)])
    head = padded[start[:, None] + np.arange(DEPTH)[None, :]].astype(np.uint64)
    # Several codes in one number sort faster than byte strings.
    each = 4 if not len(text) or text.max() < 1 << 16 else 2
    columns = [sum(head[:, c + j] << np.uint64(64 // each * (each - 1 - j)) for j in range(each)) for c in range(0, DEPTH, each)]
    order = np.lexsort(columns[::-1])
    return _keys(head[order]), start[order]


def reach(x: list[int], y: list[int], most: int) -> list[int]:
    """How many tokens of x are matched from the start of y with 0, 1, ... `most` edits (furthest point on each diagonal)."""
    n, m = len(x), len(y)

    def slide(i: int, d: int) -> int:
        while i < n and i + d < m and x[i] == y[i + d]:
            i += 1
        return i

    at = {0: slide(0, 0)}
    out = [at[0]]
    for _ in range(most):
        nxt: dict[int, int] = {}
        for d, i in at.items():
            for e, k in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # changed, dropped, added
                if k <= n and 0 <= k + e <= m:
                    nxt[e] = max(nxt.get(e, -1), k)
        at = {d: slide(i, d) for d, i in nxt.items()}
        out.append(max([out[-1], *at.values()]))
        if out[-1] == n:
            break
    return out


def extend(item: list[int], a: int, text: list[int], p: int, n: int, least: int, most: int, far: int) -> tuple[int, int] | None:
    """(span, edits) of the longest passage of at least `least` tokens around the match of n tokens at a and p, with a tenth edited.

    At most `most` edits and `far` tokens are looked at on either side.
    """
    right = reach(item[a + n : a + n + far], text[p + n : p + n + far + most], most)
    left = reach(item[max(0, a - far) : a][::-1], text[max(0, p - far - most) : p][::-1], most)
    found = [(n + le + ri, i + j) for i, le in enumerate(left) for j, ri in enumerate(right) if n + le + ri >= max(least, 10 * (i + j))]
    return max(found, key=lambda f: (f[0] - f[1], -f[1])) if found else None


def _search(ids: list[int], codes: list[np.ndarray], items: _Items) -> Iterator[tuple]:
    """Rows of SCHEMA for the documents of one shard."""
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in codes])]).astype(np.int64)
    text = np.zeros(starts[-1] + DEPTH, dtype=np.uint32)
    for s, c in zip(starts.tolist(), codes):
        text[s : s + len(c)] = c
    keys, places = suffix_array(text, items.seed, items.follows)
    if not len(keys):
        return
    lo, hi = np.searchsorted(keys, items.low, "left"), np.searchsorted(keys, items.high, "right")
    some = np.flatnonzero(hi > lo)
    total = np.concatenate([[0], np.cumsum((hi - lo)[some])])
    best: dict[tuple[int, int], tuple] = {}
    first = 0
    while first < len(some):
        last = max(first + 1, int(np.searchsorted(total, total[first] + HITS, "right")) - 1)
        part = some[first:last]
        n = (hi - lo)[part]
        at = items.pos[np.repeat(part, n)]
        place = places[np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        # A match that a longer one to its left holds is looked at there.
        inner = (at > 0) & (place > 0) & (items.text[at - 1] == text[place - 1]) & (text[place - 1] > 0)
        at, place = at[~inner], place[~inner]
        doc, item = np.searchsorted(starts, place, "right") - 1, np.searchsorted(items.start, at, "right") - 1
        ok = _passes(text, starts, items, at, place, doc, item)
        for a, p, d, k in zip(at[ok].tolist(), place[ok].tolist(), doc[ok].tolist(), item[ok].tolist()):
            length, end, e = items.seed, int(starts[d + 1]) - 1, int(items.start[k + 1]) - 1
            while a + length < e and p + length < end and text[p + length] == items.text[a + length]:
                length += 1
            if length > best.get((d, k), (0,))[0]:
                best[d, k] = (length, p, a)
        first = last
    for (d, k), (verbatim, place, at) in best.items():
        begin, end, s, e = int(starts[d]), int(starts[d + 1]) - 1, int(items.start[k]), int(items.start[k + 1]) - 1
        most = (e - s) // 10 + 1
        near = max(begin, place - (at - s) - most)
        whole = items.text[s:e].tolist()
        span, edits = extend(whole, at - s, text[near : min(end, place + (e - at) + most)].tolist(), place - near, verbatim, items.least, most, e - s)
        yield int(ids[d]), int(items.ids[k]), verbatim, span, edits, place - begin


def reach_many(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """reach() of many rows at once: x holds tokens of items, y those of texts from `most` places earlier on; tokens that are none differ in x and y."""
    rows, n = x.shape
    wide = 2 * most + 1
    same = x[:, None, :] == np.lib.stride_tricks.sliding_window_view(y, n, axis=1)[:, :wide, :]
    stop = np.full((rows, wide, n + 1), n, dtype=np.int16)
    stop[:, :, :n] = np.where(same, np.int16(n), np.arange(n, dtype=np.int16))
    stop = np.minimum.accumulate(stop[:, :, ::-1], axis=2)[:, :, ::-1]  # where the run of equal tokens from each place on ends
    at = np.full((rows, wide), -1, dtype=np.int64)
    at[:, most] = stop[:, most, 0]
    out = [at[:, most].copy()]
    for _ in range(most):
        gone = np.full((rows, 1), -1, dtype=np.int64)
        step = np.where(at >= 0, at + 1, -1)
        nxt = np.maximum(np.maximum(step, np.hstack([step[:, 1:], gone])), np.hstack([gone, at[:, :-1]]))  # changed, dropped, added
        nxt = np.minimum(nxt, n)
        slid = np.take_along_axis(stop, np.maximum(nxt, 0)[:, :, None], axis=2)[:, :, 0]
        at = np.where(nxt >= 0, slid, -1)
        out.append(np.maximum(out[-1], at.max(axis=1)))
    return np.stack(out, axis=1)


def _passes(text: np.ndarray, starts: np.ndarray, items: _Items, at: np.ndarray, place: np.ndarray, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether `least` tokens of the item in a row, the match among them, stand in the document with at most a tenth edited.

    A passage with a tenth edited always holds such a stretch, and a match in it, so no more need be looked at to find all leaks.
    """
    least, most, seed = items.least, items.least // 10, items.seed
    other, none = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)

    def take(codes: np.ndarray, i: np.ndarray, low: np.ndarray, high: np.ndarray, pad: np.uint32) -> np.ndarray:
        return np.where((i >= low[:, None]) & (i < high[:, None]), codes[np.clip(i, 0, len(codes) - 1)], pad)

    d_lo, d_hi, i_lo, i_hi = starts[doc], starts[doc + 1] - 1, items.start[item], items.start[item + 1] - 1
    n, m = np.arange(least - seed)[None, :], np.arange(-most, least - seed + most)[None, :]
    room_right, room_left = (i_hi - at - seed)[:, None], (at - i_lo)[:, None]
    right = np.minimum(reach_many(take(items.text, at[:, None] + seed + n, i_lo, i_hi, none), take(text, place[:, None] + seed + m, d_lo, d_hi, other), most), room_right)
    left = np.minimum(reach_many(take(items.text, at[:, None] - 1 - n, i_lo, i_hi, none), take(text, place[:, None] - 1 - m, d_lo, d_hi, other), most), room_left)
    ok = np.zeros(len(at), dtype=bool)
    for i in range(most + 1):
        for j in range(most + 1 - i):
            ok |= seed + left[:, i] + right[:, j] >= least
    return ok


def _rows(ids: list, texts: list, units: list[_Items]) -> Iterator[tuple]:
    """Rows of SCHEMA for documents; about SHARD_TOKENS tokens at a time become one suffix array."""
    plains = [(i, plain_text(t)) for i, t in zip(ids, texts) if t]
    for items in units:
        own, codes, held = [], [], 0
        for doc_id, text in plains if len(items.ids) else ():
            if items.beyond_ascii and text.isascii():
                continue
            c = items.codes(text)
            if len(c) < items.seed:
                continue
            own.append(doc_id)
            codes.append(c)
            held += len(c)
            if held > SHARD_TOKENS:
                yield from _search(own, codes, items)
                own, codes, held = [], [], 0
        if own:
            yield from _search(own, codes, items)


def find_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """One row per document and leaked item: the longest verbatim match that is part of a leak, its passage and its place in the document."""
    spark = documents.sparkSession
    items = cut(without_shared_openings(eval_items))  # read twice: to be counted and to be taken
    docs = documents.select("doc_id", "text").where("text <> '' and doc_id is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars <= MAX_ITEM_CHARS:
        rows = items.collect()  # at most MAX_ITEM_CHARS characters
        held = spark.sparkContext.broadcast([_Items([(r.item_id, r.text) for r in rows if r.unit == u], u) for u in (WORDS, CHARS)])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(list(_rows(batch["doc_id"].tolist(), batch["text"].tolist(), held.value)), columns=COLUMNS)

        return spread(docs).mapInPandas(scan, SCHEMA)

    def search(docs: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        units = [_Items([(i, t) for i, t, x in zip(items["item_id"].tolist(), items["text"], items["unit"]) if x == u], u) for u in (WORDS, CHARS)]
        return pd.DataFrame(list(_rows(docs["doc_id"].tolist(), docs["text"].tolist(), units)), columns=COLUMNS)

    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards, blocks = size // SHARD_CHARS + 1, chars // MAX_ITEM_CHARS + 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    d = docs.withColumn("_shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).withColumn("_block", numbers(blocks))
    i = items.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).withColumn("_shard", numbers(shards))
    return d.groupBy("_shard", "_block").cogroup(i.groupBy("_shard", "_block")).applyInPandas(search, SCHEMA)
