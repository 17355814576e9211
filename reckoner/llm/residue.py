"""Template residue, filler, error pages and scripts-required notices in place of content.

Labelled exemplars are looked up through an inverted index. A passage window is a line or sentence, two that follow each other, an open
template field, or a run of words inside longer text. It is residue if the exemplars that it retrieves hold most of its TF-IDF weight
(containment): one exemplar alone, or the best TOGETHER ones, since notices are put together from the same parts in ever new ways.
An exemplar of genuine text that speaks about such things and holds more clears it. Document frequencies come from all documents. They are
counted first, so the lookup weighs words and loses no window: frequent words and those of exemplars have their weight, rarer ones the
least they can have. What is left is weighed exactly.

Words are compared as stems with a few synonyms. An open field, such as {{name}}, is one term for each kind of delimiter, so fields go
through index and containment like all words; which brackets are delimiters is what the tokenizer knows (FIELD, NO_FIELD).
Runs of words must hold most of one exemplar of five or more words (filler: a quarter) and count only outside quotes and outside of
sentences that are genuine by exemplar, since running text mentions short notices more often than it is one.

Null and empty texts have no windows and are no residue; a document without doc_id counts in the frequencies and can't be named. Texts of any length are scanned whole; repeated documents each
get their rows. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, spread
from .exemplars import FIELDS, GENUINE, PUBLIC, SEEN

LEAST_COVER = 0.72  # share of a window's TF-IDF weight that one exemplar must hold
TOGETHER, TOGETHER_COVER, TOGETHER_BEST = 4, 0.7, 0.35  # exemplars that count together, what they must hold, and what the best must
TOGETHER_WORDS, TOGETHER_RARE = 4, 2  # distinct words that they must hold, and how many of them must be distinctive
LEAST_OF_EXEMPLAR = 0.45  # share of the exemplar's words (filler: 0.25) that a window must hold, unless it is distinctive
DISTINCTIVE_WORDS, DISTINCTIVE_DF = 3, 0.05  # a fragment of so many held words, each in at most this share of the documents
INNER = (6, 8, 11, 15, 20)  # words of the overlapping windows inside longer text, each at most 1 / LEAST_COVER of the one before
INNER_OF_EXEMPLAR, INNER_WORDS, RUN_RARE = 0.8, 5, 2  # share of the exemplar that they must hold, the least words of such an exemplar, and how many held ones must be distinctive
GENUINE_COVER = 0.5
AROUND = 20  # words before and after a run that are weighed as its sentence
KNOWN_TERMS = 20_000  # most frequent terms whose weights go to the tasks; rarer ones have a bound
CHUNK = 2_000_000  # characters of whole texts that a task holds as tokens at once (one text may be longer)
MEMO = 500_000  # spellings whose term a task remembers

# The ways of writing an open template field, by the name of their term.
_NAME = r" ?[A-Za-z][\w .|#'-]*"
_CODE = r" ?[A-Za-z_][^{}:;|\n]*(?:\|[^{}\n]*)?"  # a name, a condition, filters
FIELD = {
    "⟦xxx⟧": rf"(?:XXX|xxx)-{_NAME}-(?:XXX|xxx)\b", "⟦{{⟧": rf"\{{\{{\{{?[~-]? ?[#/^>&!.$@]{{0,2}}{_CODE}\}}?\}}\}}", "⟦{%⟧": r"\{%[-+]? ?[A-Za-z_][^{}%\n]*%\}", "⟦<%⟧": r"<%[=-]? ?@?[A-Za-z_][^%\n]*%>",
    "⟦${⟧": rf"\$\{{{_NAME}\}}", "⟦#{⟧": rf"#\{{{_NAME}\}}", "⟦[[⟧": rf"\[\[{_NAME}\]\]", "⟦«⟧": r"«[a-z][a-z0-9_]+»", "⟦@@⟧": rf"@@{_NAME}@@", "⟦%%⟧": rf"%%{_NAME}%%", "⟦*|⟧": r"\*\|[A-Z][A-Z0-9_:]*\|\*",
    "⟦__⟧": r"(?<!\w)__[A-Za-z][A-Za-z_]*?__(?!\w)", "⟦[insert⟧": r"\[(?:INSERT|insert|Insert|YOUR|your|Your|ENTER|enter|Enter) [^\]\n]+\]", "⟦<your⟧": r"<(?:your|YOUR|Your|insert|INSERT|Insert|enter|ENTER|Enter) [\w ]+>",
    "⟦<⟧": r"<[A-Z][A-Z_ ]{2,}>", "⟦[⟧": r"\[[A-Z][A-Z_ ]{2,}\]", "⟦(_)⟧": r"\([A-Za-z_ ]{2,}: ?_{2,}\)", "⟦【⟧": r"【[^】\n]+】", "⟦_⟧": r"(?<=[:：] )_{4,}",
    "⟦{⟧": r"(?<![\w$#@{\"'(/=.\\])\{[A-Za-z][\w. -]*\}(?![\w}/\"'])", "⟦[n⟧": r"(?<![\w\]])\[[A-Z][a-z]+(?: [A-Za-z]+)*\](?![\w(\[:])",
}
# Brackets and names that code, logs and mark-up use and that are no open fields.
NO_FIELD = re.compile(
    r"\[(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL|NOTE|NOTICE|PASS|PASSED|FAIL|FAILED|SKIP|SKIPPED|DONE|START|END|REDACTED)\]"
    r"|</?(?:HTML|HEAD|BODY|DIV|SPAN|SCRIPT|NOSCRIPT|STYLE|TABLE|CENTER|PRE|CODE|STRONG|META|LINK|FORM|INPUT|IMG|FOOTER|HEADER|MAIN|NAV)>"
    r"|__(?:FILE|LINE|FUNCTION|DATE__ __TIME|TIMESTAMP|COUNTER|APPLE|init|main|name|file|weak|strong|block|func)__|【\d+】"
)
_KINDS = [(term, re.compile(p)) for term, p in FIELD.items()]
_ANY = "|".join(FIELD.values())
_TAG = r"</?[A-Za-z!][^<>\n]*>"
_BLOCK = re.compile(r"</?(?:p|h\d|title|body|html|head|br|div|li|tr|td|ul|ol|table|center|hr)\b", re.I)
_OPENS = r"[\[(<{$#«@%*【_]"  # a field or tag starts with one of these; tried first, so other characters cost little
_TOKEN = re.compile(
    rf"(?:XXX|xxx)-{_NAME}-(?:XXX|xxx)|[^\W_一-鿿]+(?:['’](?:s|t|re|ve|ll|d|m)\b)?|[一-鿿]|\n|[`'\"](?={_OPENS})(?:{_ANY})[`'\"]|(?={_OPENS})(?:{_ANY}|{_TAG})|[.?!;]+(?=\s|$)|[。？！]|[\"`“”„「」]"
)
_HEX = re.compile(r"(?=.*\d)[0-9a-f]+$")

# Words that count as one, by stem.
SYNONYMS = {
    w: to
    for to, ws in {
        "script": "javascript js scripts scripting noscript javascripts", "enabl": "activat allow permit", "disabl": "deactivat block", "not": "cannot can't couldn't won't doesn't don't isn't wasn't aren't didn't haven't hasn't no unabl ohne nicht kein keine",
        "page": "website webpage", "find": "found locat", "requir": "need necessary must", "view": "see display show read shown seen", "login": "signin logged", "request": "ask", "wrong": "broke broken", "exist": "exists",
        "fail": "failed failure", "content": "contents", "script_de": "skripte", "reload": "refresh", "insert": "add enter put", "text": "texts", "sorry": "oops", "deny": "denied forbidden refused", "busy": "overload", "maintenanc": "downtime",
        "second": "minut moment", "browser": "browsers", "switch": "turn", "work": "function run load", "sampl": "placeholder example dummy", "describ": "description", "remov": "delet", "unauthoriz": "unauthoris authoriz authoris",
    }.items()
    for w in ws.split()
}
# Words that are never distinctive, even where a small corpus lacks them.
FUNCTION_WORDS = "a an and are as at be been but by can do for from has have if in is it its no not of on or our so that the their there they this to was we were will with you your der die das ein eine ist und in auf zu".split()


def stem(w: str) -> str:
    """A word without the common English endings; synonyms count as one."""
    if w in SYNONYMS:
        return SYNONYMS[w]
    if w.endswith(("'s", "’s")):
        w = w[:-2]
    if w.isascii() and w.isalpha():
        for end, least in (("ing", 7), ("ed", 6), ("es", 6), ("s", 4), ("e", 5)):
            if len(w) >= least and w.endswith(end) and not w.endswith("ss"):
                w = w[: -len(end)]
                break
        else:
            return SYNONYMS.get(w, w)
        if w.endswith("e") and len(w) >= 5:
            w = w[:-1]
    return SYNONYMS.get(w, w)


PLAIN_WORDS = frozenset(map(stem, FUNCTION_WORDS))
LINE, SENTENCE, QUOTE, DROP, DOC = -1, -2, -3, -4, -5


class Terms(dict):
    """Spelling to the number of its term, or to one of LINE, SENTENCE, QUOTE, DROP, DOC; terms holds the terms by number."""

    def __init__(self):
        super().__init__({"\n": LINE, "\0": DOC, "。": SENTENCE, "？": SENTENCE, "！": SENTENCE} | dict.fromkeys('"`“”„「」', QUOTE))
        self.terms: list[str] = []
        self.number: dict[str, int] = {}

    def __missing__(self, raw: str) -> int:
        n = self[raw] = self.code(raw)
        return n

    def code(self, raw: str) -> int:
        if raw[0] in ".?!;":
            return SENTENCE
        if not raw[0].isalnum() or raw.lower().startswith("xxx-"):
            term = next((t for t, p in _KINDS if p.fullmatch(raw, 0)), None) if not NO_FIELD.fullmatch(raw) else None
            if term is None and raw[0] in "_(:" and set(raw) == {"_"}:
                term = "⟦_⟧"
            if term is None and raw[0] in "{[":
                term = "⟦{⟧" if raw[0] == "{" else "⟦[n⟧"
            if NO_FIELD.fullmatch(raw):
                term = None if raw[0] == "<" else raw.lower().strip("[]_【】")
            elif raw[0] in "\"'`":
                term = "quoted"  # a field that is quoted is spoken about
            elif raw[0] == "<" and term is None:
                return LINE if _BLOCK.match(raw) else DROP
            if term is None:
                return DROP
            return self.of(term)
        w = raw.lower().replace("’", "'")
        if w.isascii() and _HEX.match(w) and len(w) != 3:
            return self.of("#")
        return self.of(stem(w))

    def of(self, term: str) -> int:
        if term not in self.number:
            self.number[term] = len(self.terms)
            self.terms.append(term)
        return self.number[term]


def words(passage: str) -> list[str]:
    """The terms of a passage in order."""
    terms = Terms()
    return [terms.terms[c] for c in map(terms.__getitem__, _TOKEN.findall(passage)) if c >= 0]


class Index:
    """Inverted index of the exemplars: term to the exemplars that hold it."""

    def __init__(self, residue: dict[str, list[str]] | None = None, genuine: list[str] = GENUINE):
        if residue is None:
            residue = {"field": FIELDS} | {f: PUBLIC[f] + SEEN[f] for f in PUBLIC}
        rows = [(label, e) for label, es in residue.items() for e in es] + [("genuine", e) for e in genuine]
        self.label = [label for label, _ in rows]
        self.words = [frozenset(t for t in words(e) if label != "field" or t[0] == "⟦") for label, e in rows]
        self.families = sorted({f for f in self.label if f not in ("field", "genuine")})
        self.terms = sorted({w for ws in self.words for w in ws})
        self.number = {w: n for n, w in enumerate(self.terms)}
        self.posting = [np.array([n for n, ws in enumerate(self.words) if t in ws], dtype=np.int64) for t in self.terms]
        self.field_terms = frozenset(w for n, ws in enumerate(self.words) if self.label[n] == "field" for w in ws)
        self.size = np.array([len(ws) for ws in self.words], dtype=float)
        self.genuine = [n for n, f in enumerate(self.label) if f == "genuine"]
        self.is_genuine = np.array([f == "genuine" for f in self.label], dtype=bool)
        self.family = np.array([self.families.index(f) if f in self.families else -1 for f in self.label])
        self.is_long = np.array([f in self.families and len(ws) >= INNER_WORDS for f, ws in zip(self.label, self.words)], dtype=bool)
        self.run_hold = np.array([0.25 if f == "filler" else INNER_OF_EXEMPLAR for f in self.label])
        self.bag = np.zeros((len(self.terms) + 1, 3), dtype=bool)  # words of any residue exemplar, of long filler, of other long ones; last row: words of none
        for n, ws in enumerate(self.words):
            for w in ws:
                if self.family[n] >= 0:
                    self.bag[self.number[w]] |= (True, self.is_long[n] and self.label[n] == "filler", self.is_long[n] and self.label[n] != "filler")

    def held(self, window: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """The weight of each of n windows that each exemplar holds; term is -1 for words of no exemplar."""
        known = term >= 0
        window, term, weight = window[known], term[known], weight[known]
        lists = [self.posting[t] for t in term.tolist()]
        k = np.array([len(x) for x in lists], dtype=np.int64)
        size = len(self.label)
        at = np.repeat(window, k) * size + (np.concatenate(lists) if lists else np.empty(0, dtype=np.int64))
        return np.bincount(at, np.repeat(weight, k), n * size).reshape(n, size)


class Weights:
    """TF-IDF weights of the most frequent terms and of all terms of exemplars; for other terms the least they can have."""

    def __init__(self, counts: DataFrame, n_docs: int, index: Index):
        frequent = counts.orderBy(F.desc("df"), "term").limit(KNOWN_TERMS).collect()
        mine = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in index.terms], "term string")), "term").collect()
        self.known = {r.term: math.log(1 + n_docs / r.df) for r in frequent + mine}
        self.rest = math.log(1 + n_docs / frequent[-1].df) if frequent else 0.0

    def __call__(self, term: str) -> float:
        return self.known.get(term, self.rest)


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, list[str]]]:
    """(ids, tokens) of documents, about CHUNK characters at a time; each document ends with the token \\0."""
    held, out, tokens = 0, [], []
    for i, t in zip(ids, texts):
        if t:
            out.append(i)
            tokens += _TOKEN.findall(t)
            tokens.append("\0")
            held += len(t)
            if held >= CHUNK:
                yield out, tokens
                held, out, tokens = 0, [], []
    if out:
        yield out, tokens


def term_counts(documents: DataFrame) -> DataFrame:
    """(term, df) over all documents: in how many documents a word stands; counted per chunk, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            for _, tokens in _chunks(list(range(len(batch))), batch["text"].tolist()):
                a = np.fromiter(map(terms.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                doc = np.cumsum(a == DOC)
                pairs = np.unique((doc[a >= 0] << 32) | a[a >= 0])
                df = np.bincount(pairs & 0xFFFFFFFF, minlength=len(terms.terms))
                some = np.flatnonzero(df)
                yield pd.DataFrame({"term": [terms.terms[n] for n in some.tolist()], "df": df[some]})
                if len(terms) > MEMO:
                    terms = Terms()

    return documents.select("text").mapInPandas(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


VERDICT = T.StructType([T.StructField("family", T.StringType()), T.StructField("cover", T.DoubleType())])
BAG = "array<struct<term:string,n:int>>"
CANDIDATE = f"doc_id long, passage string, place int, family string, cover double, terms {BAG}, context {BAG}, exemplars array<int>"


class _Scan:
    """Windows of tokens that exemplars may hold; numpy over all tokens of a chunk, Python only for the windows that are left."""

    def __init__(self, index: Index, weight: Weights):
        self.index, self.weight = index, weight
        self.reset()

    def reset(self) -> None:
        self.terms, self.of, self.w, self.plain = Terms(), np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=bool)

    def learn(self) -> None:
        new = self.terms.terms[len(self.of) :]
        self.of = np.concatenate([self.of, np.array([self.index.number.get(t, -1) for t in new], dtype=np.int64)])
        self.w = np.concatenate([self.w, np.array([self.weight(t) for t in new], dtype=float)])
        self.plain = np.concatenate([self.plain, np.array([t in PLAIN_WORDS for t in new], dtype=bool)])

    def rows(self, ids: list, tokens: list[str]) -> Iterator[tuple]:
        index = self.index
        a = np.fromiter(map(self.terms.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        self.learn()
        line_end = (a == LINE) | (a == DOC)
        line, quote = np.cumsum(line_end), np.cumsum(a == QUOTE)
        # A word is quoted if an odd number of quote signs of its line stand before it and the line has an even number of them.
        before = np.concatenate([[0], quote[line_end]])
        in_line = quote - before[np.minimum(line - line_end, len(before) - 1)]
        total = np.diff(np.concatenate([before, [quote[-1]]]))
        odd = (in_line % 2 == 1) & (total[np.minimum(line - line_end, len(total) - 1)] % 2 == 0)
        part_end = line_end | (a == SENTENCE)
        keep = np.flatnonzero(a >= 0)
        if not len(keep):
            return
        t, doc, part, quoted = a[keep], (np.cumsum(a == DOC) - (a == DOC))[keep], np.cumsum(part_end)[keep], odd[keep]
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        stop = np.concatenate([start[1:], [len(t)]])
        seg = np.repeat(np.arange(len(start)), stop - start)
        w, code = self.w[t], self.of[t]
        bag = index.bag[code]
        c = np.concatenate([[0.0], np.cumsum(w)])
        any_of, filler_of, other_of = (np.concatenate([[0.0], np.cumsum(w * bag[:, k])]) for k in range(3))
        most = lambda lo, hi: any_of[hi] - any_of[lo]
        enough = min(LEAST_COVER, TOGETHER_COVER) - 1e-9

        # Lines and sentences, and two in a row.
        ok = most(start, stop) >= enough * (c[stop] - c[start])
        lo, hi = start[ok], stop[ok]
        if len(start) > 1:
            two = (doc[start[:-1]] == doc[start[1:]]) & (most(start[:-1], stop[1:]) >= enough * (c[stop[1:]] - c[start[:-1]]))
            lo, hi = np.concatenate([lo, start[:-1][two]]), np.concatenate([hi, stop[1:][two]])
        yield from self._emit(ids, tokens, keep, t, code, w, doc, lo, hi, None, None)

        # Open fields, each with the words around it.
        fields = np.flatnonzero(np.isin(t, [n for x in index.field_terms if (n := self.terms.number.get(x)) is not None]))
        if len(fields):
            s = seg[fields]
            yield from self._emit(ids, tokens, keep, t, code, w, doc, fields, fields + 1, np.maximum(start[s], fields - AROUND), np.minimum(stop[s], fields + 1 + AROUND))

        # Runs of words over the ends of lines, outside quotes.
        count = lambda x: np.concatenate([[0], np.cumsum(x)])
        cq, rare = count(quoted), count(bag[:, 0] & (w >= DISTINCTIVE) & ~self.plain[t])
        other = count(bag[:, 2])
        least = min((index.size * index.run_hold)[index.is_long & (index.run_hold == INNER_OF_EXEMPLAR)], default=math.inf)
        best: dict[tuple, tuple] = {}
        for size in INNER:
            i = np.arange(len(t) - size + 1)
            j = i + size
            need = (LEAST_COVER - 1e-9) * (c[j] - c[i])
            good = (doc[i] == doc[j - 1]) & (cq[j] == cq[i]) & (rare[j] - rare[i] >= RUN_RARE)
            good &= (filler_of[j] - filler_of[i] >= need) | (other_of[j] - other_of[i] >= need) & (other[j] - other[i] >= least)
            i, j = i[good], j[good]
            for row in self._emit(ids, tokens, keep, t, code, w, doc, i, j, np.maximum(start[seg[i]], i - AROUND), np.minimum(stop[seg[j - 1]], j + AROUND), run=True):
                doc_id, passage, place, family, cover = row[:5]
                if family is None:
                    yield row
                elif (key := (doc_id, family)) not in best or (cover, len(passage), -place) > (best[key][4], len(best[key][1]), -best[key][2]):
                    best[key] = row
        yield from best.values()

    def _emit(self, ids, tokens, keep, t, code, w, doc, lo, hi, around_lo, around_hi, run: bool = False) -> Iterator[tuple]:
        """Rows of CANDIDATE for the windows lo to hi: judged where all weights are exact, to be judged where they are bounds."""
        index, weight = self.index, self.weight.known
        for b in range(0, len(lo), 2000):
            l, h = lo[b : b + 2000], hi[b : b + 2000]
            total, held = self._held(code, w, t, l, h)
            fits = ~index.is_genuine & (held >= (LEAST_COVER - 1e-9) * total[:, None])
            if run:
                fits &= index.is_long
            elif around_lo is None:
                best = np.where(index.family >= 0, held, 0.0)
                for r in np.flatnonzero(best.max(axis=1) >= (TOGETHER_BEST - 1e-9) * total).tolist():
                    order = np.argsort(-best[r], kind="stable")[:TOGETHER]
                    fits[r, order[best[r, order] > 0]] = True
            al, ah = (l, h) if around_lo is None else (around_lo[b : b + 2000], around_hi[b : b + 2000])
            for r in np.flatnonzero(fits.any(axis=1)).tolist():
                x, y, p, q = int(l[r]), int(h[r]), int(al[r]), int(ah[r])
                words_of, context = self._bag(t, x, y), None if around_lo is None else self._bag(t, p, q)
                found = np.flatnonzero(fits[r]).tolist()
                idf = {k: self.weight(k) for k in (context or words_of)}  # the context of a run or field holds its words
                if verdict(index, idf, words_of, context, found, run, cleared=False)[0] is None:
                    continue
                around = (context or words_of).keys()
                found += [n for n in index.genuine if len(around & index.words[n]) >= LEAST_OF_EXEMPLAR * len(index.words[n])]
                family = cover = None
                if sure := all(k in weight for k in idf):
                    family, cover = verdict(index, idf, words_of, context, found, run)
                    if family is None:
                        continue
                first, last = (x, y) if run or context is None else (p, q)
                passage = " ".join(" ".join(tokens[keep[first] : keep[last - 1] + 1]).split())
                rest = (None, None, None) if sure else (sorted(words_of.items()), context and sorted(context.items()), found)
                yield ids[int(doc[x])], passage, x if run else None, family, cover, *rest

    def _held(self, code, w, t, lo, hi):
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        window = np.repeat(np.arange(len(lo)), n)
        return np.bincount(window, w[at], len(lo)), self.index.held(window, code[at], w[at], len(lo))

    def _bag(self, t, lo: int, hi: int) -> dict[str, int]:
        bag: dict[str, int] = {}
        for k in t[lo:hi].tolist():
            bag[self.terms.terms[k]] = bag.get(self.terms.terms[k], 0) + 1
        return bag


def candidate_windows(documents: DataFrame, index: Index, weight: Weights) -> DataFrame:
    """Rows of CANDIDATE: windows that are residue (with family), and those with words whose weight is not known exactly, still to be judged (with terms).

    context is null but for runs of words and fields, place but for runs; of judged runs a chunk gives the best of each document and family.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "passage", "place", "family", "cover", "terms", "context", "exemplars"]
        s = _Scan(index, weight)
        for batch in batches:
            for ids, tokens in _chunks(batch["doc_id"].tolist(), batch["text"].tolist()):
                yield pd.DataFrame(list(s.rows(ids, tokens)), columns=columns).astype({"place": "Int32"})
                if len(s.terms) > MEMO:
                    s.reset()

    return documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(scan, CANDIDATE)


def find_residue(documents: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, passage, family, cover): the windows that are residue, as words, with the family and coverage of the best exemplars.

    Of the overlapping runs of words in a document the best one of each family is given, and only where no line or sentence of it is of that family.
    """
    index = index or Index()
    documents = spread(documents.select("doc_id", "text"))
    counts = cut(term_counts(documents))
    n_docs = documents.count()
    found = cut(candidate_windows(documents, index, Weights(counts, n_docs, index)))  # few windows of the corpus
    todo = found.where("terms is not null").withColumn("run", F.col("place").isNotNull())
    key = ["terms", "context", "exemplars", "run"]
    distinct = todo.select(*key).distinct()
    both = F.array_distinct(F.transform(F.concat("terms", F.coalesce("context", F.array().cast(BAG))), lambda x: x["term"]))
    idf = (
        counts.join(distinct.select(F.explode(both).alias("term")).distinct(), "term", "left_semi")
        .select("term", F.log(1 + F.lit(n_docs) / F.col("df")).alias("idf"))
    )
    weighed = (
        distinct.select(*key, F.explode(both).alias("term")).join(idf, "term")
        .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"))
    )
    judged = weighed.select(*key, _judge(index)("idf", "terms", "context", "exemplars", "run").alias("v")).where("v.family is not null")
    same = F.lit(True)
    for k in key:
        same &= F.col(f"f.{k}").eqNullSafe(F.col(f"j.{k}"))
    late = todo.alias("f").join(judged.alias("j"), same).select("doc_id", "passage", "place", "v.family", "v.cover")
    hits = cut(found.where("family is not null").select("doc_id", "passage", "place", "family", "cover").unionByName(late))
    whole = hits.where("place is null").drop("place")
    inner = hits.where("place is not null").groupBy("doc_id", "family").agg(F.max_by(F.struct("passage", "cover"), F.struct("cover", F.length("passage"), -F.col("place"))).alias("b"))
    inner = inner.join(whole.select("doc_id", "family").distinct(), ["doc_id", "family"], "left_anti")
    return whole.unionByName(inner.select("doc_id", "b.passage", "family", "b.cover"))


DISTINCTIVE = math.log(1 + 1 / DISTINCTIVE_DF)


def verdict(index: Index, idf, ws: dict[str, int], around: dict[str, int] | None, found: list[int], run: bool, cleared: bool = True) -> tuple:
    """(family, cover) of a window of words and their numbers, (None, None) if it is no residue; around are the words around a run or field.

    Genuine exemplars don't count if not cleared; with the least that weights can be, cover is then the most that it can be.
    """
    total = sum(idf[t] * n for t, n in ws.items()) or math.inf
    weigh = lambda held: sum(idf[t] * ws[t] for t in held)
    rare_in = lambda held: sum(idf[t] >= DISTINCTIVE for t in held if t not in PLAIN_WORDS)
    best, family, genuine, some = 0.0, None, 0.0, []
    for n in found:
        label, own = index.label[n], index.words[n]
        if label == "genuine":
            c = ws if around is None else around
            held = c.keys() & own
            if len(held) >= LEAST_OF_EXEMPLAR * len(own):
                genuine = max(genuine, sum(idf[t] * c[t] for t in held) / (sum(idf[t] * k for t, k in c.items()) or math.inf))
            continue
        held = ws.keys() & own
        cover, hold = weigh(held) / total, len(held) / len(own)
        some.append((cover, held, label))
        if run:
            enough = hold >= index.run_hold[n] and rare_in(held) >= RUN_RARE
        elif label == "field":
            enough = True
        else:
            enough = hold >= (0.25 if label == "filler" else LEAST_OF_EXEMPLAR) or (len(held) >= DISTINCTIVE_WORDS and min(idf[t] for t in held) >= DISTINCTIVE)
        if cover >= LEAST_COVER and enough and len(held) >= min(2, len(own)) and cover > best:
            best, family = cover, label
    if around is None and family is None and some:
        top = sorted(some, key=lambda x: -x[0])[:TOGETHER]
        held = set().union(*(h for _, h, _ in top))
        cover = weigh(held) / total
        if len(held) >= TOGETHER_WORDS and rare_in(held) >= TOGETHER_RARE and top[0][0] >= TOGETHER_BEST and cover >= TOGETHER_COVER:
            best, family = cover, top[0][2]
    if cleared and around is not None and genuine >= GENUINE_COVER:
        family = None
    return (family, best) if family and (not cleared or around is not None or best > genuine) else (None, None)


def _judge(index: Index):
    @F.pandas_udf(VERDICT)
    def judge(idf: pd.Series, terms: pd.Series, context: pd.Series, exemplars: pd.Series, run: pd.Series) -> pd.DataFrame:
        bag = lambda x: None if x is None else {e["term"]: e["n"] for e in x}
        return pd.DataFrame([verdict(index, dict(i), bag(t), bag(c), list(e), r) for i, t, c, e, r in zip(idf, terms, context, exemplars, run)], columns=["family", "cover"])

    return judge
