"""Byte-level BPE, encoding and decoding, as a monoid tree reduction.

The encodings of byte strings form a monoid: join(encode(a), encode(b)) = encode(a + b). A piece (one match of the
tokenizer's pattern) is cut into halves down to a few bytes, each leaf is encoded by plain merging, and neighbours are
joined by encoding anew a window of tokens at their border. A sequence of tokens is the encoding of its bytes exactly
if each pair of neighbouring tokens is the encoding of its own bytes. So the window has grown far enough as soon as the
pairs at its two edges are such pairs: then nothing outside can change, and it is otherwise doubled.

Decoding concatenates the bytes of tokens up a tree as well.

Defined cases: a null text is empty (no tokens, digests of no bytes); any text round-trips, whatever its length;
repeated rows give repeated results; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: The pattern for which texts may be cut at single blanks and line ends.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a leaf of the tree.
LEAF = 16
#: Encodings in each of the two generations that a worker remembers.
REMEMBERED = 400_000
#: The rank of no token.
NONE = 1 << 60


class Memory(dict):
    """Encodings by text, of which those used since the last change of generations survive the next."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Bpe:
    """A vocabulary of ranks; tokens are byte strings, ids their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.fits = lru_cache(1 << 18)(self._fits)
        self.pieces, self.starts, self.spaced = Memory(self.piece), Memory(self.matches), Memory(lambda w: self.matches(" " + w))
        self.uneven = regex.compile(r"\s\s|[^\S \n]")
        self.line_end = self.matches("\n")
        self.plain = pattern == PLAIN  # the cuts of encode() are proven for this pattern only

    def forget(self) -> None:
        """Gives up all that is remembered."""
        for memory in (self.pieces, self.starts, self.spaced):
            memory.clear()
            memory.old = {}
        self.fits.cache_clear()

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging: again and again the neighbours whose union has the lowest rank, the leftmost first."""
        if len(data) > 64:
            return self.merged_by_heap(data)
        parts, get = [data[k : k + 1] for k in range(len(data))], self.ranks.get
        ranks = [get(data[k : k + 2], NONE) for k in range(len(data) - 1)]
        while ranks and (best := min(ranks)) != NONE:
            k = ranks.index(best)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], NONE)
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], NONE)
        return parts

    def merged_by_heap(self, data: bytes) -> list[bytes]:
        """The same merges, for long windows, from a heap of neighbours."""
        n = len(data)
        token: list[bytes | None] = [data[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, 2) for k in range(n - 1) if (r := self.ranks.get(data[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            rank, k, size = heappop(heap)
            if token[k] is None or (r := after[k]) >= n or len(token[k]) + len(token[r]) != size:
                continue
            token[k] += token[r]
            token[r] = None
            after[k] = after[r]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and (b := after[a]) < n and (rank := self.ranks.get(token[a] + token[b])) is not None:
                    heappush(heap, (rank, a, len(token[a]) + len(token[b])))
        return [t for t in token if t is not None]

    def _fits(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens a, b are the encoding of a + b."""
        return self.merged(a + b) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of two encodings in a row."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        n = 1
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            data = b"".join(left[len(left) - a :] + right[:b])
            window = self.merged(data)
            if (a == len(left) or self.fits(left[-a - 1], window[0])) and (b == len(right) or self.fits(window[-1], right[b])):
                return left[: len(left) - a] + window + right[b:]
            n *= 2

    def tree(self, data: bytes) -> list[bytes]:
        """The encoding of data by halves."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern, packed as little-endian unsigned 32-bit integers; a piece that is itself a token is that token."""
        data = text.encode("utf-8", "surrogatepass")
        tokens = [data] if data in self.ranks else self.tree(data)
        return np.array([self.ranks[t] for t in tokens], "<u4").tobytes()

    def matches(self, text: str) -> bytes:
        """The packed ids of text, match by match."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def line(self, words: list[str]) -> bytes:
        """The packed ids of words with single blanks between them."""
        return self.starts[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text.

        No match of the pattern reaches over a blank or line end that stands alone between other characters: a blank
        begins the match after it, a line end is a match of its own. So texts whose white space is all of this kind are
        cut there, and words already met are looked up. All others are matched as a whole.
        """
        if not self.plain or self.uneven.search(text):
            return self.matches(text)
        return self.line_end.join([self.line(x.split(" ")) for x in text.split("\n")])

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids, concatenated up a tree over runs of tokens."""
        ids, of = np.frombuffer(packed, "<u4"), self.bytes_of.__getitem__
        level = [b"".join(map(of, ids[k : k + 65536].tolist())) for k in range(0, len(ids), 65536)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(2)
def bpe(path: str, pattern: str) -> Bpe:
    """Loaded once in each Python worker."""
    return Bpe.load(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and ids (packed, little-endian unsigned 32 bits) and decoded (bytes) of text. One pass, no shuffle. Tasks forget the encodings that they met, since other operators follow in the same Python workers."""
    return _mapped(docs, path, pattern, keep, "ids binary, decoded binary", lambda ids, data: (ids, data), forget=True)


def _mapped(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...], fields: str, row, forget: bool = False) -> DataFrame:
    spark = docs.sparkSession
    common.arrow_batches(spark)
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    out = [f for f in rows.schema.fields if f.name in keep]
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path, pattern)
        types = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        kinds = [types[x.split()[1]] for x in fields.split(", ")]
        try:
            for batch in batches:
                made = []
                for text in batch.column("text"):
                    ids = model.encode(text.as_py() or "")
                    made.append(row(ids, model.decode(ids)))
                columns = list(zip(*made, strict=True)) if made else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in out], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*[f.name for f in out], *names])
        finally:
            if forget:
                model.forget()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return rows.mapInArrow(run, f"{kept}, {fields}" if kept else fields)


def digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_tokens, ids_sha256 and decoded_sha256 of each row's text."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _mapped(docs, path, pattern, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, data: (len(ids) // 4, sha(ids), sha(data)))


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), *public_vocabulary())


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
