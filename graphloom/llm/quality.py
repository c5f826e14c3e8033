"""Quality rules: counted rules, and a logistic regression over hashed word and character n-grams.

The classifier is fitted on a bounded sample of labelled rows (FIT_ROWS rows, those with the smallest hash of doc_id),
then calibrated by Platt's method on the part of the sample that the fit did not see. All rows are scored in Arrow
batches against the fixed threshold KEEP.

Defined cases: a null text has no words, all counts 0, fails the base rules and is not kept; without labelled rows, or
with labels of one kind only, the verdict is the base rules' alone (score null); labels other than 0 and 1 and those of a
null doc_id are not used; ids and labels may be of any type that casts to a string and to a number; of repeated labels the
largest holds, of repeated ids with unlike texts the one whose features' bytes come first is fitted; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import byte_ngrams, word_hashes

#: Labelled rows that the fit takes at most, and features.
FIT_ROWS, FEATURES = 4000, 1 << 12
#: Kept if the calibrated probability of good quality is at least this.
KEEP = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, REPEATED_PERCENT = 50, 50


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes, split() takes exactly the six white-space characters meant here
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        n, last = Counter(windows), -1
        for k, w in enumerate(windows):
            if n[w] > 1:
                repeated += k + 3 - max(k, last)
                last = k + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEATED_PERCENT * n_words


def features(text: str) -> np.ndarray:
    """Hashed counts of words and of runs of 2 to 4 bytes, each kind divided by its number."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(FEATURES, np.float32)
    for kind, h in enumerate((word_hashes(data), *(byte_ngrams(data, n) for n in (2, 3, 4)))):
        if len(h):
            out += np.bincount(((h >> np.uint64(20 + kind)) % np.uint64(FEATURES)).astype(np.int64), minlength=FEATURES).astype(np.float32) / len(h)
    return np.sqrt(out)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full gradient steps (Adam), classes weighted alike."""
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -30, 30)))  # in x's type: mixed types would convert x in each product
        g = (p - y) * weight
        gw, gb = g.astype(x.dtype) @ x + decay * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def platt(s: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a s + b))): Newton's method on smoothed targets, with steps halved until the loss falls, since on separable scores full steps run away."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        z = a * s + b
        return float((np.logaddexp(0, z) - t * z).sum() + 5e-4 * (a - 1) ** 2)

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -500, 500)))
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * s).sum() + 1e-3 * (a - 1), (p - t).sum()])
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        step, size = np.linalg.solve(hess, g), 1.0
        while size > 1e-10 and (new := loss(a - size * step[0], b - size * step[1])) > now - 1e-4 * size * float(g @ step):
            size /= 2
        if size <= 1e-10:
            break
        a, b, now = a - size * step[0], b - size * step[1], new
        if abs(size * step).max() < 1e-7:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float] | None:
    """Weights, bias and calibration from at most FIT_ROWS labelled rows."""
    common.arrow_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "quality")  # at most FIT_ROWS narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.float16(features(t.as_py() or "")).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id string, quality int, x binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()  # at most FIT_ROWS rows
    if not got:
        return None
    y = np.array([r.quality for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float16).reshape(len(got), FEATURES).astype(np.float32)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    w, b = fit(x[~held], y[~held])
    a, c = platt(x[held] @ w + b, y[held]) if held.any() else (1.0, 0.0)
    return w.astype(np.float32), float(b), a, c


def verdicts(docs: DataFrame, model) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                n = counts(text)
                bad, p = failed(n[0], n[4]), None
                if model is not None:
                    w, b, a, c = model
                    p = float(1 / (1 + np.exp(-np.clip(a * (features(text) @ w + b) + c, -30, 30))))
                rows.append((*n, bad, not bad and (p is None or p >= KEEP), p))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return verdicts(docs, train(docs, common.table(spark, sf_dir, "labels")))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the same verdicts that SQL can express."""
    return op10_quality(spark, sf_dir).select("doc_id", *NAMES[:6])


QUERIES = {"op10_quality": op10_quality, "quality_counts": quality_counts}
_WORD = r"[^\x20\x09-\x0D]"
ORACLE_SQL: dict[str, str] = {
    "quality_counts": f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{_WORD}+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from d),
p as (select r, unnest(range(1, len(w) - 1)) as p, w from w where len(w) >= 3),
g as (select r, p, count(*) over (partition by r, w[p], w[p + 1], w[p + 2]) as n from p),
m as (select r, count(distinct q) as n_repeat_words from (select r, unnest([p, p + 1, p + 2]) as q from g where n > 1) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
  len(w) < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {REPEATED_PERCENT} * len(w) as base_failed
from w left join m using (r)""",
}
