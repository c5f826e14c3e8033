"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Terms are words and their beginnings of 4 to 6 letters. Every term that at least two examples hold counts, and every example
of a bounded sample of labelled rows (EXAMPLES rows, those with the smallest hash of doc_id), clean or toxic. A term weighs
its inverse document frequency times the size of its log odds between toxic and clean examples (at least LEAST), a ratio that
does not grow with the number of rows; without it the many neutral words of a text drown the few that speak.
The K nearest are exact. Terms with the same postings share one list. Short posting lists are summed. The LONG longest lists are
not read: they have, for each block of BLOCK examples, their largest weight, which bounds what they add to an example's cosine;
the bounds of a batch of texts are one product of matrices. The FIRST examples by bound are compared with the text on the long
lists, then all others whose bound reaches the K-th best, best bounds first, in portions after each of which the K-th best rises.
Votes, weighted by distance, are calibrated by Platt's method on the examples, each scored without itself.
Documents without any term get the smoothed rate of the examples.

Weights are numbers of single precision; cosines of them are summed in double precision.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0; doc_id, lang and source are not scored.

Defined cases: a null or empty text has no terms; without learnable labels all scores are 0, with those of one class only
all are its smoothed rate; labels other than 0 and 1 and labels of a null doc_id are not used; ids and labels may be of any
type that casts to a string and to a number; of repeated labels the largest holds, of repeated ids with unlike texts the one
whose vector's bytes come first is an example; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import platt

EXAMPLES, LEAST = 12_000, 0.01
#: Examples in a block, nearest ones that vote, posting lists that are bounded by blocks, and examples compared first.
BLOCK, K, LONG, FIRST = 16, 15, 6144, 24
#: Bounds may be lower than what they are compared with by this much; they are raised by what sums of single precision may be off.
SLACK, EPSILON = 1e-6, 2.0**-24
#: Texts searched at once.
BATCH = 256
#: Weight of the prior in a vote, in neighbours at distance 0.1.
PRIOR = 0.5
WORDS = re.compile(r"[^\W\d_]+")
#: The same for texts of Latin-1 only: what no word holds becomes blank.
LETTERS = bytes(c if WORDS.fullmatch(chr(c)) else 32 for c in range(256))
REMEMBERED = 600_000


def words_of(text: str) -> list[str]:
    low = text.lower()
    try:
        return low.encode("latin-1").translate(LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(low)


def terms_of(word: str) -> tuple[str, ...]:
    """The word and its beginnings; a beginning is marked by its closing hyphen."""
    n = len(word)
    if n < 4:
        return (word,)
    return (word, word[:4] + "-") if n == 4 else (word, word[:4] + "-", word[:5] + "-") if n == 5 else (word, word[:4] + "-", word[:5] + "-", word[:6] + "-")


def numbers(counts: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by term number as two arrays, terms ascending."""
    if isinstance(counts, dict):
        t = np.fromiter(counts, np.int32, len(counts))
        order = np.argsort(t)
        return t[order], np.fromiter(counts.values(), np.int32, len(counts))[order]
    return counts


class Words(dict):
    """Numbers of the words met, and the numbers of each one's terms."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms, self.ids, self.cut = terms, array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        for t in terms_of(word):
            if t in self.terms:
                self.ids.append(self.terms[t])
        self.cut.append(len(self.ids))
        self[word] = n = len(self)
        return n


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the runs of these starts and sizes, run by run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, ascending, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values[order], first)


class Vocabulary:
    """Terms by number."""

    def __init__(self, names: list[str]):
        self.names = names

    def __getstate__(self) -> dict:
        return {"names": self.names}

    @cached_property
    def terms(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.names)}

    @cached_property
    def words(self) -> Words:
        return Words(self.terms)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms, ascending, and how often it has each."""
        words = self.words
        if len(words) >= REMEMBERED:
            words = self.words = Words(self.terms)
        met, times = np.unique(np.fromiter(map(words.__getitem__, words_of(text)), np.int64), return_counts=True)
        ids, cut = np.frombuffer(words.ids, np.int32) if words.ids else np.empty(0, np.int32), np.frombuffer(words.cut, np.int64)
        size = cut[met + 1] - cut[met]
        t, n = totals(ids[runs(cut[met], size)], np.repeat(times, size))
        return t, n.astype(np.int32)


class Index(Vocabulary):
    """Vectors of examples with labels, searched exactly by blocks.

    What is kept and sent to workers are the postings: by list of equal terms, the examples that hold them and how often.
    Weights, and the rows of the longest lists, are made of them wherever the index is loaded.
    """

    def __init__(self, idf: dict[str, float], rows: Iterable[tuple[str, dict[int, int], int]], empty: tuple[int, int]):
        """idf: weights of the terms. rows: doc_id, counts by term number, label. empty: how many examples a text without any term is judged by, and how many of those are toxic."""
        super().__init__(list(idf))
        self.idf = np.array(list(idf.values()) or [0.0])
        self.empty = (empty[1] + 1) / (empty[0] + 2) if empty[0] else 0.0
        found = []
        for i, c, y in rows:
            t, n = numbers(c)
            found.append((i, t, n, y))
        found.sort(key=lambda r: (len(r[1]), r[0]))  # those of like weights side by side, so that bounds are tight
        self.ids = np.array([r[0] for r in found], object)
        self.y = np.array([r[3] for r in found], np.float64)
        sizes = [len(r[1]) for r in found]
        term = np.concatenate([r[1] for r in found] or [np.empty(0, np.int32)])
        count = np.concatenate([r[2] for r in found] or [np.empty(0, np.int32)])
        del found
        order = np.argsort(term, kind="stable").astype(np.int32)
        n = np.repeat(np.arange(len(sizes)).astype(np.min_scalar_type(len(sizes))), sizes)
        self.at, self.n = n[order], count[order].astype(np.min_scalar_type(int(count.max(initial=0))))
        self.cut = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.idf)))))
        del n, count, term, order
        self.merge()
        self.a, self.b, self.shared = 1.0, 0.0, None

    def merge(self) -> None:
        """Terms of equal postings and weights, as a rare word and its beginnings are, share the list of the first of them."""
        lists: dict[tuple[bytes, float], int] = {}
        self.list_of, cut, first = np.empty(len(self.names), np.int32), self.cut.tolist(), []
        for k, value in enumerate(self.idf[: len(self.names)].tolist()):
            its = slice(cut[k], cut[k + 1])
            key = hashlib.blake2b(self.at[its].tobytes() + self.n[its].tobytes(), digest_size=16).digest(), value
            if key not in lists:
                lists[key] = len(first)
                first.append(k)
            self.list_of[k] = lists[key]
        df, kept = np.diff(self.cut), np.zeros(len(self.cut) - 1, bool)
        kept[first] = True
        its = np.repeat(kept, df)
        self.at, self.n, self.cut = self.at[its], self.n[its], np.concatenate(([0], np.cumsum(df[kept])))

    def weigh(self) -> None:
        """Makes the weights of the short lists, the rows of the long ones, and their bounds."""
        self.seen: dict = {}
        self.blocks = -(-len(self.ids) // BLOCK)
        df = np.diff(self.cut)
        self.members, value = np.bincount(self.list_of, minlength=len(df)), np.empty(len(df))
        value[self.list_of] = self.idf[: len(self.names)]
        of = np.repeat(np.arange(len(df), dtype=np.int32), df)
        square, weight, step = np.zeros(len(self.ids)), np.empty(len(self.at), np.float32), 1 << 20
        raw = lambda k: (1 + np.log(self.n[k : k + step].astype(np.float64))) * value[of[k : k + step]]
        parts = range(0, len(self.at), step)
        for k in parts:
            square += np.bincount(self.at[k : k + step], raw(k) ** 2 * self.members[of[k : k + step]], minlength=len(square))
        for k in parts:
            weight[k : k + step] = raw(k) / np.sqrt(square)[self.at[k : k + step]]
        top = np.zeros(len(df))
        np.maximum.at(top, of, weight)
        # Long lists save most, and bounds of small weights lose least.
        long = np.argsort(-df / np.maximum(value * top, 1e-9) ** 0.25, kind="stable")[:LONG]
        self.row = np.full(len(df), -1, np.int32)
        self.row[long] = np.arange(len(long))
        self.bound = np.zeros((len(long), self.blocks), np.float32)
        for k, t in enumerate(long.tolist()):
            its = slice(self.cut[t], self.cut[t + 1])
            np.maximum.at(self.bound[k], self.at[its] // BLOCK, weight[its])
        is_long = np.repeat(self.row >= 0, df)
        self.short_at, self.short = self.at[~is_long].astype(np.intp), weight[~is_long]
        self.short_size = np.where(self.row < 0, df, 0)
        self.short_cut = np.cumsum(self.short_size) - self.short_size
        at = self.at[is_long]
        order = np.argsort(at, kind="stable")
        self.row_of, self.weight_of = self.row[of[is_long][order]].astype(np.intp), weight[is_long][order]
        self.cut_of = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.ids)))))
        square = np.zeros(len(self.ids))
        for k in range(0, len(at), step):
            part = order[k : k + step]
            square += np.bincount(at[part], self.members[long[self.row_of[k : k + step]]] * self.weight_of[k : k + step].astype(np.float64) ** 2, minlength=len(square))
        self.norm = np.sqrt(square)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("names", "idf", "list_of", "empty", "ids", "y", "at", "n", "cut", "a", "b")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.weigh()

    def vector(self, counts: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Terms, ascending, and their weights, rounded to single precision."""
        t, n = numbers(counts)
        w = (1 + np.log(n.astype(np.float64))) * self.idf[t]
        return t, (w / np.sqrt(np.add.accumulate(w * w)[-1])).astype(np.float32).astype(np.float64)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = K) -> list[tuple[float, int]]:
        """The k examples of the largest cosine, as (cosine, example), ties by example."""
        return self.nearest([self.query(terms, weights)], k)[0]

    def query(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A vector by lists: the sums of their terms' weights."""
        return totals(self.list_of[terms], weights)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K, skips: Iterable[int] = ()) -> list[list[tuple[float, int]]]:
        """The same for many queries; skips: by query, an example left out."""
        if not hasattr(self, "norm"):
            self.weigh()
        long, rows = np.zeros((len(queries), len(self.bound)), np.float32), [self.row[lists] for lists, _ in queries]
        for n, (row, (_, weights)) in enumerate(zip(rows, queries, strict=True)):
            long[n, row[row >= 0]] = weights[row >= 0]
        bounds = long @ self.bound
        return [self.best(*q, row, bound, k, skip) for q, row, bound, skip in zip(queries, rows, bounds, chain(skips, repeat(-1)))]

    def products(self, q: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """Those of examples with a text on the long lists."""
        cuts = list(zip(self.cut_of[examples].tolist(), self.cut_of[examples + 1].tolist(), strict=True))
        parts = q.take(np.concatenate([self.row_of[a:b] for a, b in cuts]))
        parts *= np.concatenate([self.weight_of[a:b] for a, b in cuts])
        size = np.array([b - a for a, b in cuts])
        out, held = np.zeros(len(cuts)), size > 0
        if held.any():
            out[held] = np.add.reduceat(parts, (np.cumsum(size) - size)[held])
        return out

    def best(self, lists: np.ndarray, weights: np.ndarray, row: np.ndarray, bound: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        is_long = row >= 0
        q, short, at, weight = np.zeros(len(self.bound)), lists[~is_long], row[is_long], weights[is_long]
        q[at] = weight
        size = self.short_size[short]
        its = runs(self.short_cut[short], size)
        short = np.bincount(self.short_at.take(its), np.repeat(weights[~is_long], size) * self.short.take(its), minlength=len(self.ids))
        # Of an example the long lists add at most the product of the norms, and at most its block's largest weights.
        bounds = np.repeat(bound.astype(np.float64) * (1 + EPSILON * (len(at) + 2)), BLOCK)[: len(short)]
        np.minimum(bounds, math.sqrt(weight @ (weight / self.members[lists[is_long]])) * self.norm, out=bounds)
        bounds += short
        if skip >= 0:
            bounds[skip] = 0
        now = np.argpartition(-bounds, min(FIRST, len(bounds)) - 1)[:FIRST]
        now = now[bounds[now] > 0]
        found, scores, rest, portion = now[:0], np.empty(0), None, FIRST
        while len(now):
            found, scores = np.concatenate((found, now)), np.concatenate((scores, short[now] + self.products(q, now)))
            kth = float(np.partition(scores, -k)[-k]) if len(scores) >= k else 0.0
            if rest is None:
                bounds[now] = 0
                rest = np.flatnonzero(bounds >= kth - SLACK) if kth > SLACK else np.flatnonzero(bounds)
            else:
                rest = rest[bounds[rest] >= kth - SLACK]
            portion *= 2
            if len(rest) > 2 * portion:
                order = np.argpartition(-bounds[rest], portion)
                now, rest = rest[order[:portion]], rest[order[portion:]]
            else:
                now, rest = rest, rest[:0]
        order = np.lexsort((found, -scores))[:k]
        return [(s, n) for s, n in zip(scores[order].tolist(), found[order].tolist(), strict=True) if s > 0]

    def logit(self, near: list[tuple[float, int]]) -> float:
        w = np.array([1 / (0.1 + max(0.0, 1 - s)) for s, _ in near])
        y = self.y[[n for _, n in near]] if near else np.empty(0)
        p = (float(w @ y) + PRIOR * 10 * self.empty) / (float(w.sum()) + PRIOR * 10)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def scores(self, texts: list[str]) -> list[tuple[float, str]]:
        """The calibrated scores, and their evidence: the nearest examples as doc_id:label:cosine."""
        if not hasattr(self, "norm"):
            self.weigh()
        if len(self.seen) > 50_000:
            self.seen.clear()
        keys, new = [], {}
        for text in texts:
            counts = self.counts(text)
            if not len(counts[0]) or not len(self.ids):
                keys.append(None)
                continue
            terms, weights = self.vector(counts)
            keys.append(hashlib.blake2b(terms.tobytes() + weights.tobytes(), digest_size=16).digest())
            if keys[-1] not in self.seen and keys[-1] not in new:
                new[keys[-1]] = self.query(terms, weights)
        for key, near in zip(new, self.nearest(list(new.values())), strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * self.logit(near) + self.b))))
            self.seen[key] = p, ",".join(f"{self.ids[n]}:{int(self.y[n])}:{s:.4f}" for s, n in near[:5])
        return [(self.empty, "") if key is None else self.seen[key] for key in keys]


def sample(labels: DataFrame, rows: int = EXAMPLES) -> DataFrame:
    """doc_id, toxic of the labelled rows to learn from, at most that many."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(crc % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


def train(docs: DataFrame, labels: DataFrame) -> Index:
    common.arrow_batches(docs.sparkSession)
    chosen = common.stored(sample(labels), "examples")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "toxic")  # at most EXAMPLES narrow rows

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (Counter(), Counter())
            for text, y in zip(batch.column("text"), batch.column("toxic"), strict=True):
                n[y.as_py()].update({t for w in set(words_of(text.as_py() or "")) for t in terms_of(w)})
            terms = list(n[0] | n[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], ["term", "pos", "neg"])

    totals = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n1, n = int(totals[0] or 0), int(totals[1])
    if not 0 < n1 < n:
        return Index({}, [], (n, n1))
    kept = (
        rows.mapInArrow(frequencies, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter("pos + neg >= 2").orderBy("term").toArrow()  # at most the terms of EXAMPLES texts
    )
    pos, neg = kept.column("pos").to_numpy(), kept.column("neg").to_numpy()
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n - n1 + 1))
    weights = (np.log((1 + n) / (1 + pos + neg)) + 1) * np.maximum(np.abs(odds), LEAST)
    idf = dict(zip(kept.column("term").to_pylist(), weights.tolist(), strict=True))
    known = docs.sparkSession.sparkContext.broadcast(Vocabulary(list(idf)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.concatenate(known.value.counts(t.as_py() or "")).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(counts, pa.binary())], ["doc_id", "toxic", "counts"])

    found = rows.mapInArrow(vectors, "doc_id string, toxic int, counts binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("counts").alias("counts"))
    found = common.stored(found.filter("octet_length(counts) > 0"), "vectors")  # at most EXAMPLES rows
    del kept, pos, neg, odds, weights
    index = Index(idf, ((r.doc_id, counted(r.counts), r.toxic) for r in found.toLocalIterator()), (n, n1))
    calibrate(index, found)
    return index


def counted(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(bytes(counts), np.int32).reshape(2, -1))


def calibrate(index: Index, found: DataFrame) -> None:
    """Fits the index to its examples' labels, each example (doc_id, counts) scored without itself."""
    if len(index.ids) < 10 or not 0 < index.y.sum() < len(index.ids):
        return
    shared = index.shared = found.sparkSession.sparkContext.broadcast(index)  # written to a file piece by piece

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        number = {i: n for n, i in enumerate(index.ids)}
        for batch in batches:
            ns = [number[i] for i in batch.column("doc_id").to_pylist()]
            queries = [index.query(*index.vector(counted(c.as_py()))) for c in batch.column("counts")]
            got = [x for k in range(0, len(ns), BATCH) for x in index.nearest(queries[k : k + BATCH], skips=ns[k : k + BATCH])]
            yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int32()), pa.array(map(index.logit, got), pa.float64())], ["n", "logit"])

    s = np.empty(len(index.ids))
    got = found.select("doc_id", "counts").mapInArrow(logits, "n int, logit double").toArrow()  # at most EXAMPLES numbers
    s[got.column("n").to_numpy()] = got.column("logit").to_numpy()
    index.a, index.b = platt(s, index.y.astype(int))


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence. One pass, no shuffle."""
    common.arrow_batches(docs.sparkSession)
    shared, fit = index.shared or docs.sparkSession.sparkContext.broadcast(index), (index.a, index.b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value  # workers that helped to fit it have it already
        index.a, index.b = fit
        for batch in batches:
            got = [x for k in range(0, len(batch), BATCH) for x in index.scores([t or "" for t in batch.column("text").slice(k, BATCH).to_pylist()])]
            p = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([g[1] for g in got], pa.string())], ["doc_id", "score", "predicted", "evidence"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, evidence string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, train(docs, common.table(spark, sf_dir, "labels")))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
