"""Exact betweenness with less work: graphs are cut at articulation points, and a node with a single out-edge searches with its successor.

A shortest path enters and leaves a biconnected block at articulation points only, so that a block is searched by itself, with
its articulation points standing for the nodes behind them that reach them, or that they reach. All paths from a node with one
out-edge begin with it, so that the search from where the edges lead serves for both, the targets on the way left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import searches

#: Sources times edges of blocks that are not strongly connected, up to which what articulation points reach is found one by one; beyond, a graph stays whole.
REACH = 1 << 34
#: Nodes of small blocks that are searched together.
TOGETHER = 512


@dataclass
class Pieces:
    """The blocks of a graph beside each other as one graph of places: an articulation point has a place in each of its blocks."""

    starts: np.ndarray  # out-edges of places, in compressed rows
    targets: np.ndarray
    node: np.ndarray  # of each place
    heads: np.ndarray  # first place of each block, and the number of places
    sources: np.ndarray  # how many nodes of the whole graph search through a place of its block, and how many are found through it
    found: np.ndarray
    through: np.ndarray  # by node: pairs in different blocks whose paths pass it


def whole(starts: np.ndarray, targets: np.ndarray) -> Pieces:
    """The graph as one block."""
    n = len(starts) - 1
    return Pieces(starts, targets, np.arange(n), np.array([0, n]), np.ones(n), np.ones(n), np.zeros(n))


def biconnected(starts: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node its number in a depth-first search that ignores directions, and the block in which it lies below the block's top, -1 for roots; the tops of the blocks, lower blocks first."""
    n = len(starts) - 1
    source = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[np.argsort(targets, kind="stable")]
    ends = np.concatenate(([0], np.cumsum(np.bincount(targets, minlength=n)))).tolist()
    begins = starts.tolist()
    near = lambda v: iter(targets[begins[v] : begins[v + 1]].tolist() + source[ends[v] : ends[v + 1]].tolist())
    number, low, home, tops, count = [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        path, rest, held = [root], [near(root)], []
        while path:
            v = path[-1]
            least = low[v]
            for w in rest[-1]:
                if not number[w]:
                    low[v] = least
                    count += 1
                    number[w] = low[w] = count
                    path.append(w)
                    rest.append(near(w))
                    held.append(w)
                    break
                if number[w] < least:
                    least = number[w]
            else:
                path.pop()
                rest.pop()
                if path and least >= number[path[-1]]:
                    x = -1
                    while x != v:
                        x = held.pop()
                        home[x] = len(tops)
                    tops.append(path[-1])
                elif path:
                    low[path[-1]] = min(low[path[-1]], least)
    return np.array(number, np.int32), np.array(home, np.int32), np.array(tops, np.int32)


def weight_reached(graph: searches.Adjacency, sources: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each source the weights of the other nodes that it reaches, summed."""
    out, size = [], 64 * searches.batch_of(graph.n, 8, searches.WORDS)
    for k in range(0, len(sources), size):
        some = sources[k : k + size]
        got = np.zeros(len(some))
        for depth, rows, hit in searches.levels(graph, some):
            if depth:
                got += weights[rows] @ hit
        out.append(got)
    return np.concatenate(out)


def split(starts: np.ndarray, targets: np.ndarray) -> Pieces:
    """The graph's blocks, with what lies behind their articulation points."""
    n = len(starts) - 1
    number, home, tops = biconnected(starts, targets)
    blocks = len(tops)
    if blocks < 2:
        return whole(starts, targets)
    s = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    of = np.where(number[s] < number[targets], home[targets], home[s])
    below = np.flatnonzero(home >= 0)
    block, node = np.concatenate((np.arange(blocks, dtype=np.int32), home[below])), np.concatenate((tops, below.astype(np.int32)))
    order = np.argsort(block, kind="stable")  # the top is the first of its block
    node, heads = node[order], np.concatenate(([0], np.cumsum(np.bincount(block, minlength=blocks))))
    place, tip = np.empty(n, np.int32), heads[:-1].astype(np.int32)
    first = np.zeros(len(node), bool)
    first[heads[:-1]] = True
    place[node[~first]] = np.flatnonzero(~first)
    a, b = (np.where(home[x] == of, place[x], tip[of]) for x in (s, targets))
    del s
    starts, targets = searches.compressed(a, b, len(node))
    edges = starts[heads]
    size = np.diff(heads)
    # An edge alone: whether it leads down from the top, or up to it.
    down, up = np.zeros(blocks, bool), np.zeros(blocks, bool)
    down[of[a == heads[of]]] = True
    up[of[b == heads[of]]] = True
    del a, b, of
    joint = np.zeros(n, bool)
    joint[tops] = True

    def graphs(k: int) -> tuple[searches.Adjacency, searches.Adjacency]:
        there = searches.Adjacency(starts[heads[k] : heads[k + 1] + 1] - edges[k], targets[edges[k] : edges[k + 1]] - heads[k].astype(np.int32))
        back = searches.Adjacency(np.concatenate(([0], np.cumsum(np.bincount(there.targets, minlength=there.n)))), there.sources)
        return there, back

    out, into = np.ones(n), np.ones(n)  # nodes that a node reaches, and that reach it, itself included: first in lower blocks, then in all
    lower_out, lower_in, strong, work = np.zeros(blocks), np.zeros(blocks), np.zeros(blocks, bool), 0
    top = np.array([0])
    for k in range(blocks):
        inner = node[heads[k] + 1 : heads[k + 1]]
        if size[k] == 2:
            lower_out[k], lower_in[k] = down[k] * out[inner[0]], up[k] * into[inner[0]]
        else:
            there, back = graphs(k)
            ones = np.ones(size[k])
            strong[k] = weight_reached(there, top, ones)[0] == weight_reached(back, top, ones)[0] == size[k] - 1
            if strong[k]:
                lower_out[k], lower_in[k] = out[inner].sum(), into[inner].sum()
            else:
                lower_out[k] = weight_reached(there, top, np.append(0, out[inner]))[0]
                lower_in[k] = weight_reached(back, top, np.append(0, into[inner]))[0]
                work += int(joint[inner].sum()) * len(there.targets)
                if work > REACH:
                    return whole(*searches.compressed(*_ends(starts, targets, node), n))
        out[tops[k]] += lower_out[k]
        into[tops[k]] += lower_in[k]
    found, sources, paired = out[node], into[node], np.zeros(n)
    np.add.at(paired, tops, lower_out * lower_in)
    for k in range(blocks - 1, -1, -1):
        at = heads[k]
        found[at], sources[at] = out[tops[k]] - lower_out[k], into[tops[k]] - lower_in[k]
        inner = node[at + 1 : heads[k + 1]]
        turn = np.flatnonzero(joint[inner])
        if not len(turn):
            continue
        f, g, x = found[at : heads[k + 1]], sources[at : heads[k + 1]], inner[turn]
        if size[k] == 2:
            upper_out, upper_in = up[k] * f[:1], down[k] * g[:1]
        elif strong[k]:
            upper_out, upper_in = f.sum() - f[turn + 1], g.sum() - g[turn + 1]
        else:
            there, back = graphs(k)
            upper_out, upper_in = weight_reached(there, turn + 1, f), weight_reached(back, turn + 1, g)
        out[x] += upper_out
        into[x] += upper_in
        paired[x] += upper_out * upper_in
    return Pieces(starts, targets, node, heads, sources, found, np.where(joint, (out - 1) * (into - 1) - paired, 0.0))


def _ends(starts: np.ndarray, targets: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(node, np.diff(starts)), node[targets]


@dataclass
class Shared:
    """Which place searches for each, and what the others add."""

    by: np.ndarray  # the place whose search serves a place: itself, or where its single out-edges lead
    size: np.ndarray  # sources of a place and of those that search with it by way of it
    after: np.ndarray  # the next place, itself for those that search
    depth: np.ndarray  # steps to the place that searches


def followed(after: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where steps end, and values summed on the way; they are 0 where steps end."""
    while True:
        further = after[after]
        if np.array_equal(further, after):
            return after, values
        values, after = values + values[after], further


def shared(pieces: Pieces) -> Shared:
    """Deals places with a single out-edge to the place where such edges lead; on a circle of such places one searches."""
    n = len(pieces.node)
    single = np.diff(pieces.starts) == 1
    after = np.arange(n)
    after[single] = pieces.targets[pieces.starts[:-1][single]]
    end = after
    for _ in range(max(1, n).bit_length()):
        end = end[end]
    for v in np.unique(end[single[end]]).tolist():  # those on circles
        x = v
        while single[x]:
            single[x] = False
            x = int(after[x])
            if x == v:
                single[v] = False
                after[v] = v
                break
    by, depth = followed(after, (after != np.arange(n)).astype(np.int64))
    return Shared(by, pieces.sources + below(after, depth, pieces.sources), after, depth)


def below(after: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """By place the values of all from which steps lead to it, summed."""
    total = values.astype(np.float64)
    order = np.argsort(-depth, kind="stable")
    order = order[: np.count_nonzero(depth)]
    for part in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(total, after[part], total[part])
    return total - values


def complete(pieces: Pieces, how: Shared, total: np.ndarray, reached: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Betweenness by node, from what searches found by place: the sums of dependencies, the weights of what each place that searches reaches (itself included), and which of the places that it serves are among these."""
    f = pieces.found
    lead = np.where(how.depth > 0, f, 0.0)
    way = followed(how.after, lead)[1] + f[how.by]
    fresh = followed(how.after, np.where(back, 0.0, lead))[1]
    many = np.where(how.depth > 0, pieces.sources, 0.0)
    ahead = many * (reached[how.by] + fresh - way)
    total = total + below(how.after, how.depth, ahead) + below(how.after, how.depth, many) * (way - f)
    return np.bincount(pieces.node, total, minlength=len(pieces.through)) + pieces.through


def portions(pieces: Pieces, how: Shared) -> tuple[np.ndarray, np.ndarray]:
    """The places that search, in order, and portions of them: the places from the first to before the last of blocks that are searched together, and the same of sources. Neighbouring portions lie apart, so that tasks get some of all. Blocks of one link hold no paths with a place between."""
    size = np.diff(pieces.heads)
    searching = (how.depth == 0) & (np.diff(pieces.starts) > 0) & (np.repeat(size, size) > 2)
    sources = np.flatnonzero(searching)
    if not len(sources):
        return sources, np.empty((0, 4), np.int64)
    bin_ = pieces.heads[:-1] // TOGETHER
    bounds = np.append(pieces.heads[:-1][np.flatnonzero(np.diff(bin_, prepend=-1))], pieces.heads[-1])
    at = np.searchsorted(sources, bounds)
    out = []
    for lo, hi, a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        batch = searches.batch_of(hi - lo, 8, 64)
        out += [(lo, hi, k, min(k + batch, b)) for k in range(a, b, batch)]
    return sources, np.array(out, np.int64)
