"""Breadth-first searches from many sources at a time, over an adjacency of numbers in compressed rows.

Searches from a batch of sources go level by level together: the edges out of all nodes that any of them reached last are
taken once, sorted by target, for one row of bits (or of path counts) a node, with a place for each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges, and nodes, up to which an adjacency is sent to all tasks.
ADJACENCY_EDGES = 20_000_000
#: Bytes of the rows of all nodes that a batch of searches may take, and 64-bit words of a row at most; elements handled at once.
ROW_BYTES, WORDS, ELEMENTS = 64 << 20, 16, 1 << 20
#: Nodes up to which sums of path counts are taken by a matrix of links, and pairs an edge up to which it is worth it.
MATRIX_NODES, MATRIX_PAIRS = 3000, 60


class Adjacency:
    """Out-edges by source, and the same by target, in compressed rows."""

    def __init__(self, starts: np.ndarray, targets: np.ndarray):
        self.n, self.starts, self.targets = len(starts) - 1, starts, targets
        order = np.argsort(targets, kind="stable")
        self.sources = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(starts))[order]
        into = np.bincount(targets, minlength=self.n) if len(targets) else np.zeros(self.n, np.int64)
        self.reached = np.flatnonzero(into)
        self.heads = (np.cumsum(into) - into)[self.reached]
        self.local = np.full(self.n, -1, np.int32)
        self.matrix = None

    def dense(self) -> bool:
        """Whether so many of all pairs are linked that sums are faster by a matrix, which is made then; for what takes many sums."""
        if self.matrix is None and self.n <= MATRIX_NODES and len(self.targets) * MATRIX_PAIRS > self.n**2:
            every = np.repeat(np.arange(self.n), np.diff(self.starts)) * self.n + self.targets
            self.matrix = np.bincount(every, minlength=self.n**2).reshape(self.n, self.n).astype(np.float64)
        return self.matrix is not None

    def spread(self, rows: np.ndarray, x: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The product of columns of the matrix and x, which is given at rows."""
        every = np.zeros((self.n, x.shape[1]))
        every[rows] = x
        return columns @ every

    def out_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Targets of the edges out of rows, and how many each has."""
        counts = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + counts, counts)
        return self.targets[at], counts

    def onward(self, rows: np.ndarray, x: np.ndarray, ufunc: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that edges out of rows reach, ascending, and ufunc over the rows of x from which they are reached, once for each edge."""
        if int((self.starts[rows + 1] - self.starts[rows]).sum()) * 4 > len(self.targets):
            if ufunc is np.add and self.dense():
                return self.reached, self.spread(rows, x, self.matrix.T)[self.reached]
            self.local[rows] = np.arange(len(rows), dtype=np.int32)
            at = self.local[self.sources]
            self.local[rows] = -1
            return self.reached, grouped(np.concatenate((x, np.zeros((1, x.shape[1]), x.dtype))), at, self.heads, ufunc)
        to, counts = self.out_of(rows)
        order = np.argsort(to, kind="stable")
        to, at = to[order], np.repeat(np.arange(len(rows), dtype=np.int32), counts)[order]
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(to)), bool), to[1:] != to[:-1])))
        return to[heads], grouped(x, at, heads, ufunc)

    def backward(self, rows: np.ndarray, near: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows those with edges to near, and the rows of x, which are those of near, to which the edges lead, summed once for each edge."""
        if len(near) * 4 > self.n and self.dense():
            return rows, self.spread(near, x, self.matrix)[rows]
        self.local[near] = np.arange(len(near), dtype=np.int32)
        to, counts = self.out_of(rows)
        to = self.local[to]
        self.local[near] = -1
        of = np.repeat(np.arange(len(rows)), counts)[to >= 0]
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
        return rows[of[heads]], grouped(x, to[to >= 0], heads, np.add)


def grouped(x: np.ndarray, at: np.ndarray, heads: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """ufunc over the rows x[at] of each group; groups begin at heads. The rows are taken a part at a time."""
    out = np.empty((len(heads), x.shape[1]), x.dtype)
    ends, size, k = np.append(heads[1:], len(at)), max(1, ELEMENTS // x.shape[1]), 0
    while k < len(heads):
        to = max(k + 1, int(np.searchsorted(ends, heads[k] + size, "right")))
        out[k:to] = ufunc.reduceat(x[at[heads[k] : ends[to - 1]]], heads[k:to] - heads[k], axis=0)
        k = to
    return out


def batch_of(n: int, width: int, most: int) -> int:
    """How many places of width bytes a row may have."""
    return max(1, min(most, ROW_BYTES // (width * max(n, 1))))


def levels(graph: Adjacency, sources: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """depth, nodes reached first at that depth, and by node whether each source does so, a part of a level at a time."""
    words = -(-len(sources) // 64)
    seen = np.zeros((graph.n, words), np.uint64)
    k = np.arange(len(sources))
    np.bitwise_or.at(seen, (sources, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    rows = np.unique(sources)
    new, depth = seen[rows], 0
    while len(rows):
        part = max(1, ELEMENTS // len(sources))
        for k in range(0, len(rows), part):
            yield depth, rows[k : k + part], np.unpackbits(new[k : k + part].view(np.uint8), axis=1, bitorder="little")[:, : len(sources)]
        rows, new = graph.onward(rows, new, np.bitwise_or)
        new &= ~seen[rows]
        some = new.any(axis=1)
        rows, new = rows[some], new[some]
        seen[rows] |= new
        depth += 1


def closeness(graph: Adjacency, sources: np.ndarray) -> np.ndarray:
    """Of each source the share of nodes that it reaches, by the mean distance."""
    out, size = [], 64 * batch_of(graph.n, 8, WORDS)
    for k in range(0, len(sources), size):
        some = sources[k : k + size]
        got, far = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        for depth, _, hit in levels(graph, some):
            if depth:
                n = hit.sum(axis=0, dtype=np.int64)
                got, far = got + n, far + depth * n
        out.append(np.where(far > 0, got / max(graph.n - 1, 1) * got / np.maximum(far, 1), 0.0))
    return np.concatenate(out) if out else np.empty(0)


def dependencies(graph: Adjacency, sources: np.ndarray) -> np.ndarray:
    """By node the sum over sources of the shares of shortest paths from the source that pass it, Brandes' way; parallel edges are paths of their own."""
    ones = np.ones(graph.n)
    return weighted_dependencies(graph, sources, ones, ones, np.arange(graph.n), ones)[0]


def weighted_dependencies(graph: Adjacency, sources: np.ndarray, many: np.ndarray, found: np.ndarray, by: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same where a source's search counts many times and a node found counts for found nodes; for nodes that search by a source, and for it, own times less. Also the weights of what each source reaches, itself included, and which nodes are reached by the source by which they search."""
    total, reached, back, size = np.zeros(graph.n), np.zeros(len(sources)), np.zeros(graph.n, bool), batch_of(graph.n, 8, 64)
    column = np.full(graph.n, -1, np.int32)
    for k in range(0, len(sources), size):
        some = sources[k : k + size]
        at = np.arange(len(some))
        column[some] = at
        mine = column[by]
        column[some] = -1
        dist, paths = np.full((graph.n, len(some)), -1, np.int32), np.zeros((graph.n, len(some)))
        dist[some, at], paths[some, at] = 0, 1.0
        fronts = [np.unique(some)]
        while len(rows := fronts[-1]):
            depth = len(fronts)
            to, sums = graph.onward(rows, np.where(dist[rows] == depth - 1, paths[rows], 0.0), np.add)
            fresh = (sums > 0) & (dist[to] < 0)
            new = fresh.any(axis=1)
            to, sums, fresh = to[new], sums[new], fresh[new]
            dist[to] = np.where(fresh, depth, dist[to])
            paths[to] = np.where(fresh, sums, paths[to])
            fronts.append(to)
        reached[k : k + size] = found @ (dist >= 0)
        asked = np.flatnonzero(mine >= 0)
        back[asked] |= dist[asked, mine[asked]] >= 0
        below = np.zeros((graph.n, len(some)))
        for depth in range(len(fronts) - 2, 0, -1):
            near, rows = fronts[depth], fronts[depth - 1]
            here = dist[near] == depth
            weight = found[near, None] * many[some]
            its = np.flatnonzero(mine[near] >= 0)
            weight[its, mine[near[its]]] -= found[near[its]] * own[near[its]]
            share = np.where(here, (weight + below[near]) / np.where(here, paths[near], 1.0), 0.0)
            to, sums = graph.backward(rows, near, share)
            below[to] += np.where(dist[to] == depth - 1, paths[to] * sums, 0.0)
        below[some, at] = 0
        total += below.sum(axis=1)
    return total, reached, back


def large(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of at least that many rows, and of ELEMENTS / 4, since each look-up builds its table of ids anew."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= max(rows, ELEMENTS // 4):
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def numbered(ids: pa.Array, edges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sources and targets of edges (src, dst) as numbers of ids, in the order of the rows; edges that touch others are left out. Ends become numbers where the edges are, so that only numbers come to the driver."""
    shared = edges.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in large(batches, len(shared.value)):
            ends = [pc.index_in(rows.column(c).combine_chunks(), value_set=shared.value) for c in ("src", "dst")]
            known = pc.and_(pc.is_valid(ends[0]), pc.is_valid(ends[1]))
            yield pa.RecordBatch.from_arrays(ends, ["s", "d"]).filter(known)

    got = edges.select("src", "dst").mapInArrow(run, "s int, d int").toArrow()
    return got.column("s").to_numpy(), got.column("d").to_numpy()


def compressed(s: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of targets by source, in the order given: starts and targets."""
    return np.concatenate(([0], np.cumsum(np.bincount(s, minlength=n)))), d[np.argsort(s, kind="stable")].astype(np.int32)


def distances(ids: pa.Array, s: np.ndarray, d: np.ndarray, seeds: DataFrame) -> DataFrame:
    """seed, id, depth: what each seed (id) reaches, the seeds being dealt over tasks, each with the whole adjacency."""
    spark, n = seeds.sparkSession, len(ids)
    shared = spark.sparkContext.broadcast((ids, *compressed(s, d, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, targets = shared.value
        graph, size = Adjacency(starts, targets), 64 * batch_of(n, 8, WORDS)
        for batch in batches:
            asked = pc.index_in(batch.column("id"), value_set=names).to_numpy()
            for k in range(0, len(asked), size):
                some = asked[k : k + size].astype(np.int64)
                for depth, rows, hit in levels(graph, some):
                    node, place = np.nonzero(hit)
                    out = [names.take(pa.array(some[place])), names.take(pa.array(rows[node])), pa.array(np.full(len(node), depth, np.int32))]
                    yield pa.RecordBatch.from_arrays(out, ["seed", "id", "depth"])

    return seeds.mapInArrow(run, "seed string, id string, depth int")
