"""Graph algorithms.

Iterative ones are loops of DataFrame steps whose state is stored each round. Exact betweenness and closeness deal the
sources out over tasks, each with a broadcast copy of the adjacency, whose size is checked. What depends on the order in
which nodes are visited runs as a kernel in one task, with a size check.
"""

from __future__ import annotations

from array import array
from collections import Counter, deque
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model, storage
from ..graph import PropertyGraph, owner
from . import blocks, searches

#: Edges, and nodes, that a broadcast adjacency may have: what the driver and a Python worker hold as numbers, some 40 bytes an edge at most.
ADJACENCY_EDGES = searches.ADJACENCY_EDGES
#: Edges, and nodes, up to which a loop's rounds cost more in scheduling than in work, so that one task does them all, with the same result.
SMALL_EDGES = 50_000


def is_small(graph: PropertyGraph, small: int) -> bool:
    return small > 0 and graph.edges.limit(small + 1).count() <= small and graph.nodes.limit(small + 1).count() <= small


def adjacency(graph: PropertyGraph, limit: int = ADJACENCY_EDGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Ids by ord, and the out-edges of known nodes in compressed rows (starts, targets), by idx. Raises TooLarge beyond limit nodes or edges."""
    storage.check_size(graph.nodes, graph.edges, limit, "a broadcast adjacency")
    ids = graph.nodes.orderBy("ord").select("id").toArrow().column("id").combine_chunks()
    s, d = searches.numbered(ids, graph.edges.orderBy("idx"))
    return ids.to_pylist(), *searches.compressed(s, d, len(ids))


# op: A1
def betweenness(graph: PropertyGraph) -> DataFrame:
    """id, betweenness: directed, unweighted, parallel edges count as paths of their own; scaled by (n - 1)(n - 2). Blocks between articulation points are searched by themselves, from nodes with several out-edges; tasks are dealt the sources. Computed at once."""
    spark = graph.nodes.sparkSession
    ids, starts, targets = adjacency(graph)
    n = len(ids)
    source = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    other = source != targets
    pieces = blocks.split(*searches.compressed(source[other], targets[other], n))
    del source, other, starts, targets
    how = blocks.shared(pieces)
    sources, parts = blocks.portions(pieces, how)
    total, reached, back = np.zeros(len(pieces.node)), pieces.found.copy(), np.zeros(len(pieces.node), bool)
    if len(parts):
        send = spark.sparkContext.broadcast((pieces.starts, pieces.targets, how.size, pieces.found, how.by, sources, parts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, targets, many, found, by, sources, parts = send.value
            asked = np.sort(np.concatenate([b.column("id").to_numpy() for b in batches] or [np.empty(0, np.int64)]))
            for lo in np.unique(parts[asked, 0]):
                mine = parts[asked[parts[asked, 0] == lo]]
                hi = mine[0, 1]
                some = np.concatenate([sources[a:b] for a, b in mine[:, 2:]])
                edges = slice(starts[lo], starts[hi])
                block = searches.Adjacency(starts[lo : hi + 1] - starts[lo], targets[edges] - np.int32(lo))
                v, w, x = searches.weighted_dependencies(block, some - lo, many[lo:hi], found[lo:hi], by[lo:hi] - lo, many[lo:hi])
                for kind, k, values in ((0, np.flatnonzero(v) + lo, v[v != 0]), (1, some, w), (2, np.flatnonzero(x) + lo, np.ones(np.count_nonzero(x)))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k, pa.int64()), pa.array(values)], ["kind", "k", "v"])

        tasks = min(len(parts), 4 * spark.sparkContext.defaultParallelism)
        got = spark.range(0, len(parts), 1, tasks).mapInArrow(run, "kind int, k long, v double").groupBy("kind", "k").agg(F.sum("v").alias("v")).toArrow()
        kind, k, v = (got.column(c).to_numpy() for c in ("kind", "k", "v"))
        total[k[kind == 0]], reached[k[kind == 1]], back[k[kind == 2]] = v[kind == 0], v[kind == 1], True
        send.unpersist()
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.string()), "betweenness": pa.array(blocks.complete(pieces, how, total, reached, back) * scale)}))


# op: A6
def closeness(graph: PropertyGraph) -> DataFrame:
    """id, closeness: over distances along out-edges; the share of nodes reached, by the mean distance. Tasks are dealt the nodes as sources."""
    spark = graph.nodes.sparkSession
    ids, starts, targets = adjacency(graph)
    shared = spark.sparkContext.broadcast((starts, targets))
    n = len(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources = np.concatenate([b.id.to_numpy(np.int64) for b in batches] or [np.empty(0, np.int64)])
        if len(sources):
            v = searches.closeness(searches.Adjacency(*shared.value), sources)
            yield pd.DataFrame({"k": sources, "v": v})[v != 0]

    tasks = max(1, min(n // 64 or 1, 4 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, n, 1, tasks).mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    names = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "id": ids}) if n else [], "k long, id string")
    return names.join(found, "k", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("closeness"))


def closeness_of(distances: DataFrame, n: int) -> DataFrame:
    """The same from distances (seed, id, depth), as of bfs."""
    r = F.sum((F.col("depth") > 0).cast("int"))
    return distances.groupBy("seed").agg(F.when(F.sum("depth") > 0, r / (n - 1) * r / F.sum("depth")).otherwise(0.0).alias("closeness")).withColumnRenamed("seed", "id")


# op: A2
def pagerank(graph: PropertyGraph, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6, phantoms: str = "drop", small: int = SMALL_EDGES) -> DataFrame:
    """id, pagerank. Stops once no rank moves by tol; tol=None runs max_iter rounds. phantoms='keep' counts edges to unknown nodes in the out-degree. Graphs of at most small edges are done in one task."""
    if phantoms != "keep" and is_small(graph, small):

        def work(ids, pairs):
            n = len(ids)
            src, dst = np.array(pairs, np.int64).reshape(-1, 2).T
            deg = np.bincount(src, minlength=n)
            x = np.full(n, 1.0 / max(n, 1))
            for _ in range(max_iter):
                new = (1 - alpha) / max(n, 1) + alpha * (np.bincount(dst, x[src] / deg[src], minlength=n) + x[deg == 0].sum() / max(n, 1))
                moved = np.abs(new - x).max(initial=0.0)
                x = new
                if tol is not None and moved < tol:
                    break
            return list(zip(ids, x.tolist(), strict=True))

        return storage.kernel(graph.nodes, graph.edges, work, "id string, pagerank double")
    nodes = storage.stored(graph.nodes.select("id").distinct(), "ids")
    n = nodes.count()
    links = graph.edges.select("src", "dst") if phantoms == "keep" else graph.without_phantoms().edges.select("src", "dst")
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    # Parallel edges are summed into shares once, so a round moves one row for each pair.
    shares = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share"))
    shares = storage.stored(shares.join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"), "shares")
    sinks = nodes.join(out.select(F.col("src").alias("id"), F.lit(False).alias("sink")), "id", "left").select("id", F.coalesce("sink", F.lit(True)).alias("sink"))
    ranks = storage.stored(sinks.withColumn("rank", F.lit(1.0 / n if n else 0.0)), "ranks")
    for turn in range(max_iter):
        got = ranks.select(F.col("id").alias("src"), "rank").join(shares, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        ranks = ranks.join(got, "id", "left").crossJoin(F.broadcast(lost)).select(
            "id", "sink", ((1 - alpha) / max(n, 1) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("rank"), F.col("rank").alias("old")
        )
        if tol is not None or turn % 4 == 3:
            ranks = storage.stored(ranks, "ranks")
        if tol is not None:
            moved = ranks.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved is None or moved < tol:
                break
        ranks = ranks.drop("old")
    return ranks.select("id", F.col("rank").alias("pagerank"))


# op: A7
def hits(graph: PropertyGraph, max_iter: int = 100, tol: float | None = 1e-6, small: int = SMALL_EDGES) -> DataFrame:
    """id, hub, authority, each summing to 1. Edges to unknown nodes are left out. Graphs of at most small edges are done in one task."""
    if is_small(graph, small):

        def work(ids, pairs):
            n = len(ids)
            src, dst = np.array(pairs, np.int64).reshape(-1, 2).T
            hub = authority = np.full(n, 1.0 / max(n, 1))
            for _ in range(max_iter):
                a = np.bincount(dst, hub[src], minlength=n)
                h = np.bincount(src, a[dst], minlength=n)
                a, h = a / (np.sqrt((a * a).sum()) or 1.0), h / (np.sqrt((h * h).sum()) or 1.0)
                moved = max(np.abs(a - authority).max(initial=0.0), np.abs(h - hub).max(initial=0.0))
                hub, authority = h, a
                if tol is not None and moved < tol:
                    break
            share = lambda x: x / x.sum() if x.sum() > 0 else np.zeros(n)
            return list(zip(ids, share(hub).tolist(), share(authority).tolist(), strict=True))

        return storage.kernel(graph.nodes, graph.edges, work, "id string, hub double, authority double")
    nodes = storage.stored(graph.nodes.select("id").distinct(), "ids")
    n = nodes.count()
    pairs = storage.stored(graph.without_phantoms().edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")), "pairs")
    state = nodes.select("id", F.lit(1.0 / n if n else 0.0).alias("hub"), F.lit(1.0 / n if n else 0.0).alias("authority"))
    for _ in range(max_iter):
        auth = state.select(F.col("id").alias("src"), "hub").join(pairs, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("hub") * F.col("m")).alias("a"))
        hub = auth.select(F.col("id").alias("dst"), "a").join(pairs, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("a") * F.col("m")).alias("h"))
        new = state.withColumnsRenamed({"hub": "old_hub", "authority": "old_authority"}).join(auth, "id", "left").join(hub, "id", "left")
        new = storage.stored(new.na.fill(0.0, ["a", "h"]), "hits")
        # Only the two lengths come to the driver; they are constants of the next round's plan.
        norm = new.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("a"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("h")).first()
        new = new.select("id", "old_hub", "old_authority", (F.col("h") / F.lit(norm.h or 1.0)).alias("hub"), (F.col("a") / F.lit(norm.a or 1.0)).alias("authority"))
        state = new.select("id", "hub", "authority")
        if tol is not None:
            moved = new.agg(F.max(F.greatest(F.abs(F.col("hub") - F.col("old_hub")), F.abs(F.col("authority") - F.col("old_authority"))))).first()[0]
            if moved is None or moved < tol:
                break
    sums = state.agg(F.sum("hub").alias("sh"), F.sum("authority").alias("sa"))
    share = lambda c, s: F.when(F.col(s) > 0, F.col(c) / F.col(s)).otherwise(0.0)
    return state.crossJoin(F.broadcast(sums)).select("id", share("hub", "sh").alias("hub"), share("authority", "sa").alias("authority"))


def _components_work(ids, pairs):
    """Strong components by two depth-first searches: finishing order forwards, then gathering backwards."""
    out, into, seen, order = [[] for _ in ids], [[] for _ in ids], set(), []
    for a, b in pairs:
        out[a].append(b)
        into[b].append(a)
    for root in range(len(ids)):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            v, rest = stack[-1]
            step = next((w for w in rest if w not in seen), None)
            if step is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(out[step])))
    home: dict[int, int] = {}
    for root in reversed(order):
        front = [] if root in home else [root]
        while front:
            v = front.pop()
            if v not in home:
                home[v] = root
                front += into[v]
    least: dict[int, str] = {}
    for v, root in home.items():
        least[root] = min(least.get(root, ids[v]), ids[v])
    return [(x, least[home[k]]) for k, x in enumerate(ids)]


# op: A3
def strongly_connected(graph: PropertyGraph, small: int = SMALL_EDGES) -> DataFrame:
    """id, component (its smallest id), size, by colouring: the smallest id that reaches a node is its colour; those of a colour that also reach that id are a component, which is taken out. Graphs of at most small edges are done in one task."""
    if is_small(graph, small):
        found = storage.kernel(graph.nodes, graph.edges, _components_work, "id string, component string")
        return found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("id", "component", "size")
    left = storage.stored(graph.nodes.select("id").distinct(), "left")
    links = storage.stored(graph.without_phantoms().edges.select("src", "dst").filter("src <> dst").distinct(), "links")
    done = None
    while not storage.is_empty(left):
        # Nodes without an in- or out-edge are components of their own.
        single = left.join(links.select(F.col("src").alias("id")).distinct(), "id", "left_anti").union(left.join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")).distinct()
        single = storage.stored(single.withColumn("component", F.col("id")), "single")
        if storage.is_empty(single):
            colour = storage.stored(left.withColumn("colour", F.col("id")), "colour")
            while True:
                near = colour.select(F.col("id").alias("src"), "colour").join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
                now = storage.stored(colour.join(near, "id", "left").select("id", F.least("colour", F.coalesce("near", "colour")).alias("colour"), F.col("colour").alias("old")), "colour")
                colour = now.select("id", "colour")
                if storage.is_empty(now.filter("colour <> old")):
                    break
            # Backwards from each colour's root, inside the colour.
            member = storage.stored(colour.filter("id = colour"), "member")
            front = member
            inside = storage.stored(links.join(colour.withColumnsRenamed({"id": "src", "colour": "c1"}), "src").join(colour.withColumnsRenamed({"id": "dst", "colour": "c2"}), "dst").filter("c1 = c2").select("src", "dst"), "inside")
            while not storage.is_empty(front):
                front = storage.stored(front.select(F.col("id").alias("dst"), "colour").join(inside, "dst").select(F.col("src").alias("id"), "colour").distinct().join(member.select("id"), "id", "left_anti"), "front")
                member = storage.stored(member.unionByName(front), "member")
            found = member.select("id", F.col("colour").alias("component"))
        else:
            found = single
        done = found if done is None else done.unionByName(found)
        left = storage.stored(left.join(found.select("id"), "id", "left_anti"), "left")
        links = storage.stored(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"), "links")
    if done is None:
        return graph.nodes.sparkSession.createDataFrame([], "id string, component string, size long")
    done = storage.stored(done, "components")
    return done.join(done.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("id", "component", "size")


# op: A14
def cyclic_nodes(graph: PropertyGraph, small: int = SMALL_EDGES) -> DataFrame:
    """Ids that lie on a cycle: those of components of several nodes, and of self-loops."""
    many = strongly_connected(graph, small).filter("size > 1").select("id")
    return many.union(graph.edges.filter("src = dst").select("src")).join(graph.nodes.select("id"), "id", "left_semi").distinct()


# op: A4
def topological_levels(graph: PropertyGraph) -> DataFrame:
    """id, level: the longest path from a source, by peeling; no rows if there is a cycle."""
    left = storage.stored(graph.nodes.select("id").distinct(), "left")
    links = storage.stored(graph.without_phantoms().edges.select("src", "dst").distinct(), "links")
    out, level = None, 0
    while not storage.is_empty(left):
        free = storage.stored(left.join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if storage.is_empty(free):
            return graph.nodes.sparkSession.createDataFrame([], "id string, level int")
        out = free if out is None else out.unionByName(free)
        left = storage.stored(left.join(free.select("id"), "id", "left_anti"), "left")
        links = storage.stored(links.join(free.withColumnRenamed("id", "src"), "src", "left_anti"), "links")
        level += 1
    return out if out is not None else graph.nodes.sparkSession.createDataFrame([], "id string, level int")


def topological_order(graph: PropertyGraph, limit: int = storage.KERNEL_EDGES) -> DataFrame:
    """id, position in first-in first-out order; no rows if there is a cycle. A kernel for at most limit nodes and edges, else by rounds."""

    def work(ids, pairs):
        indegree, after = np.bincount(pairs.dst, minlength=len(ids)).tolist(), pairs.rows(len(ids))
        queue, order = deque(k for k, d in enumerate(indegree) if d == 0), []
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in after(v):
                indegree[w] -= 1
                if indegree[w] == 0:
                    queue.append(w)
        return ((ids[v], k) for k, v in enumerate(order)) if len(order) == len(ids) else []

    if graph.edges.select(F.lit(1)).limit(limit + 1).count() <= limit and graph.nodes.select(F.lit(1)).limit(limit + 1).count() <= limit:
        return storage.kernel(graph.nodes, graph.edges, work, "id string, position long", limit)
    return _order_by_rounds(graph)


def _order_by_rounds(graph: PropertyGraph) -> DataFrame:
    """The same order, distributed: a node follows in the round after that of its last predecessor, by the place of that one and the edge from it, which is the moment at which it joins the queue."""
    nodes = storage.stored(graph.nodes.groupBy("id").agg(F.min("ord").alias("ord")), "ids")
    links = storage.stored(graph.without_phantoms().edges.select("src", "dst", "idx"), "links")
    need = storage.stored(links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("need")), "need")
    front = storage.with_ordinals(nodes.join(need, "id", "left_anti"), "position", "ord").select("id", "position")
    parts, placed, met = [], 0, None
    while True:
        front = storage.stored(front.select("id", (F.col("position") + placed).alias("position")), "order")
        n = front.count()
        if not n:
            break
        parts, placed = [*parts, front], placed + n
        last = F.struct("position", "idx")
        fresh = links.join(storage.if_small(front.withColumnRenamed("id", "src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("got"), F.max(last).alias("last"))
        met = storage.stored((fresh if met is None else met.unionByName(fresh)).groupBy("id").agg(F.sum("got").alias("got"), F.max("last").alias("last")).join(need, "id"), "met")
        free = met.filter("got = need").select("id", F.col("last.position").alias("by"), F.col("last.idx").alias("edge"))
        front = storage.with_ordinals(free, "position", "by", "edge").select("id", "position")
        met = met.filter("got < need").drop("need")
    if placed < nodes.count() or not parts:
        return graph.nodes.sparkSession.createDataFrame([], "id string, position long")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# op: A15
def longest_depths(graph: PropertyGraph) -> DataFrame:
    """id, depth: edges of the longest path from each node, for acyclic graphs: from the sinks, level by level."""
    links = graph.without_phantoms().edges.select("src", "dst").distinct()
    turned = PropertyGraph.of(graph.nodes, links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return topological_levels(turned).withColumnRenamed("level", "depth")


def depths(graph: PropertyGraph) -> DataFrame:
    """id, depth as a memoised depth-first search finds it, also with cycles, where an edge back to a node in progress ends the path. A kernel."""

    def work(ids, pairs):
        after = pairs.rows(len(ids))
        memo: dict[int, int] = {}
        for root in range(len(ids)):
            if root in memo:
                continue
            best, stack, active = {root: 0}, [(root, iter(after(root)))], {root}
            while stack:
                v, rest = stack[-1]
                step = next(rest, None)
                if step is None:
                    stack.pop()
                    active.discard(v)
                    memo[v] = best[v]
                    if stack:
                        up = stack[-1][0]
                        best[up] = max(best[up], 1 + memo[v])
                elif step in memo:
                    best[v] = max(best[v], 1 + memo[step])
                elif step in active:
                    best[v] = max(best[v], 1)
                else:
                    best[step] = 0
                    active.add(step)
                    stack.append((step, iter(after(step))))
        return [(x, memo[k]) for k, x in enumerate(ids)]

    return storage.kernel(graph.nodes, graph.edges, work, "id string, depth int")


# op: A16
def hot_paths(graph: PropertyGraph, top: int | None = model.HOT_PATHS) -> DataFrame:
    """rank, path, length (in nodes) of the longest paths, each the first longest from its node; a path that a longer one contains is left out. A kernel."""

    def work(ids, pairs):
        after = pairs.rows(len(ids))
        # Of each node the length of its path behind it, the next node, and whether the path ends there.
        length, following, ends = [0] * len(ids), [-1] * len(ids), [False] * len(ids)
        done, active = [False] * len(ids), [False] * len(ids)

        def offer(v, more, to, end):
            if more > length[v]:
                length[v], following[v], ends[v] = more, to, end

        for root in range(len(ids)):
            if done[root]:
                continue
            stack, active[root] = [(root, iter(after(root)))], True
            while stack:
                v, rest = stack[-1]
                step = next(rest, None)
                if step is None:
                    stack.pop()
                    active[v], done[v] = False, True
                    if stack:
                        offer(stack[-1][0], length[v] + 1, v, False)
                elif done[step]:
                    offer(v, length[step] + 1, step, False)
                elif active[step]:
                    offer(v, 1, step, True)
                else:
                    active[step] = True
                    stack.append((step, iter(after(step))))

        def path_from(v):
            out = [v]
            while following[v] >= 0:
                out.append(following[v])
                if ends[v]:
                    break
                v = following[v]
            return out

        chosen, keys, covered = [], [], set()
        for v in sorted((v for v in range(len(ids)) if length[v]), key=lambda v: -length[v]):
            if v in covered:  # its path is the rest of a chosen one
                continue
            path = path_from(v)
            key = "→".join(ids[w] for w in path)
            if not any(key in k for k in keys):
                keys.append(key)
                chosen.append([ids[w] for w in path])
                covered.update(path[:-1])
                if top is not None and len(chosen) >= top:
                    break
        return [(k, p, len(p)) for k, p in enumerate(chosen)]

    return storage.kernel(graph.nodes, graph.edges, work, "rank int, path array<string>, length int")


def longest_paths(graph: PropertyGraph) -> DataFrame:
    """id, path, length (in nodes): a longest path from each node of an acyclic graph, the smallest by its ids.

    Of the successors one level lower the smallest comes next, since each has one path, which begins with it. Paths are put
    together by doubling: each round appends to a path the path of its last node.
    """
    levels = storage.stored(longest_depths(graph), "depths")
    top = levels.agg(F.max("depth")).first()[0] or 0
    near = levels.withColumnsRenamed({"id": "dst", "depth": "d"})
    steps = graph.without_phantoms().edges.select("src", "dst").join(levels.withColumnRenamed("id", "src"), "src").join(near, "dst").filter("depth = d + 1")
    following = steps.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("next"))
    now = levels.select("id").join(following, "id", "left").select("id", F.array("id").alias("path"), "next")
    reach = 1
    while reach <= top:
        now = storage.stored(now, "paths")
        tails = now.select(F.col("id").alias("next"), F.col("path").alias("tail"), F.col("next").alias("further"))
        now = now.join(tails, "next", "left").select("id", F.concat("path", F.coalesce("tail", F.array().cast("array<string>"))).alias("path"), F.col("further").alias("next"))
        reach *= 2
    return now.select("id", "path", F.size("path").alias("length"))


# op: A8
def louvain(graph: PropertyGraph, max_passes: int = model.LOUVAIN_PASSES) -> DataFrame:
    """id, community: one level of greedy moves in node order, communities numbered by first appearance. A kernel."""

    def work(ids, pairs):
        n, m = len(ids), len(pairs)
        ends, near, starts = pairs.rows(n, both=True), array("i"), [0]
        for v in range(n):
            near.extend(dict.fromkeys(ends(v)))
            starts.append(len(near))
        k = [b - a for a, b in pairwise(starts)]
        loops = set(pairs.src[pairs.src == pairs.dst].tolist())
        home, total = list(range(n)), [float(x) for x in k]
        for _ in range(max_passes):
            moved = False
            for v in range(n):
                own, best, gain = home[v], home[v], 0.0
                if m:
                    links = Counter(map(home.__getitem__, near[starts[v] : starts[v + 1]]))  # by community, in the order met
                    stay = links[own] - (v in loops)
                    for c, inside in links.items():
                        if c == own:
                            continue
                        g = (inside - stay) / (2 * m) - k[v] * (total[c] - (total[own] - k[v])) / (2 * m) ** 2
                        if g > gain:
                            best, gain = c, g
                if best != own:
                    total[own] -= k[v]
                    total[best] += k[v]
                    home[v], moved = best, True
            if not moved:
                break
        names: dict[int, int] = {}
        return [(x, names.setdefault(home[v], len(names))) for v, x in enumerate(ids)]

    return storage.kernel(graph.nodes, graph.edges, work, "id string, community int")


def modularity(graph: PropertyGraph, communities: DataFrame) -> DataFrame:
    """community, modularity: each community's share of the undirected modularity."""
    pairs = graph.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    m = pairs.count() or 1
    of = storage.if_small(communities)
    both = pairs.join(of.withColumnsRenamed({"id": "a", "community": "ca"}), "a").join(of.withColumnsRenamed({"id": "b", "community": "cb"}), "b")
    inside = both.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    ends = both.select(F.col("ca").alias("community")).union(both.select("cb")).groupBy("community").agg(F.count(F.lit(1)).alias("d"))
    return communities.select("community").distinct().join(ends, "community", "left").join(inside, "community", "left").select("community", (F.coalesce("l", F.lit(0)) / m - (F.coalesce("d", F.lit(0)) / (2 * m)) ** 2).alias("modularity"))


# op: A13
def clusters(graph: PropertyGraph, communities: DataFrame | None = None) -> DataFrame:
    """community, members (sorted), size."""
    found = louvain(graph) if communities is None else communities
    return found.groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community")


def cycles_work(ids, pairs):
    """The depth-first forest as rows (0, node, the node before it or -1, depth, id), and in the order met the edges back to a node in progress as rows (1, number, node, the node in progress, null). Each node is expanded once."""
    after, state, depth, k = pairs.rows(len(ids)), bytearray(len(ids)), [0] * len(ids), 0
    for root in range(len(ids)):
        if state[root]:
            continue
        yield 0, root, -1, 0, ids[root]
        state[root], path, stack = 1, [root], [iter(after(root))]
        while stack:
            w = next(stack[-1], None)
            if w is None:
                stack.pop()
                state[path.pop()] = 2
            elif state[w] == 1:
                yield 1, k, path[-1], w, None
                k += 1
            elif state[w] == 0:
                yield 0, w, path[-1], len(path), ids[w]
                state[w] = 1
                path.append(w)
                stack.append(iter(after(w)))


def cycles(graph: PropertyGraph) -> DataFrame:
    """k, path, length, cross_file: cycles closed by edges back to a node in progress, in depth-first order. A kernel finds the edges; the paths, which are far longer together, are read off the forest in many tasks."""
    spark = graph.nodes.sparkSession
    found = storage.stored(storage.kernel(graph.nodes, graph.edges, cycles_work, "kind int, a int, b int, c int, id string"), "forest")
    forest = found.filter("kind = 0").select("a", "b", "c", "id").toArrow().sort_by("a")
    names = forest.column("id").combine_chunks()
    files = np.unique([x.split("::")[0] for x in names.to_pylist()], return_inverse=True)[1] if len(names) else np.empty(0, np.int64)
    shared = spark.sparkContext.broadcast((names, files.astype(np.int32), forest.column("b").to_numpy(), forest.column("c").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, files, before, depth = shared.value
        path = np.full(int(depth.max(initial=0)) + 1, -1, np.int32)  # numbers ascend, so that it is mended at its end only

        def made(rows: list, numbers: list) -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in rows])
            every, heads = np.concatenate(rows), np.concatenate(([0], ends[:-1]))
            its = files[every]
            paths = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), names.take(pa.array(every)))
            cross = np.minimum.reduceat(its, heads) != np.maximum.reduceat(its, heads)
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), paths, pa.array(ends - heads, pa.int32()), pa.array(cross)], ["k", "path", "length", "cross_file"])

        rows, numbers, held = [], [], 0
        for batch in batches:
            for k, v, w in zip(*(batch.column(c).to_pylist() for c in "abc"), strict=True):
                x = v
                while x >= 0 and path[depth[x]] != x:
                    path[depth[x]] = x
                    x = before[x]
                rows.append(path[depth[w] : depth[v] + 1].copy())
                numbers.append(k)
                held += len(rows[-1])
                if held >= searches.ELEMENTS:
                    yield made(rows, numbers)
                    rows, numbers, held = [], [], 0
        if rows:
            yield made(rows, numbers)

    tasks = 4 * spark.sparkContext.defaultParallelism
    back = found.filter("kind = 1").select("a", "b", "c").repartitionByRange(tasks, "a").sortWithinPartitions("a")
    return back.mapInArrow(run, "k int, path array<string>, length int, cross_file boolean")


# op: A19
def reference_cycles(graph: PropertyGraph) -> DataFrame:
    """Cycles among DEFINITION nodes along REF edges."""
    files = F.array_distinct(F.transform("path", lambda x: F.substring_index(x, "#", 1)))
    return cycles(graph.subgraph(("DEFINITION",), ("REF",))).withColumn("level", F.lit("symbol")).withColumn("cross_file", F.size(files) > 1)


# op: A18
def depth_first_order(graph: PropertyGraph) -> DataFrame:
    """id, position: predecessors before their successors, in depth-first order; edges that would close a cycle are skipped. A kernel."""

    def work(ids, pairs):
        before = [[] for _ in ids]
        for a, b in pairs:
            before[b].append(a)
        seen, order = set(), []
        for root in range(len(ids)):
            stack = [(root, iter(before[root]))] if root not in seen else []
            seen.add(root)
            while stack:
                v, rest = stack[-1]
                step = next((x for x in rest if x not in seen), None)
                if step is None:
                    order.append(v)
                    stack.pop()
                else:
                    seen.add(step)
                    stack.append((step, iter(before[step])))
        return [(ids[v], k) for k, v in enumerate(order)]

    return storage.kernel(graph.nodes, graph.edges, work, "id string, position int")


# op: A9
def neighbors(graph: PropertyGraph) -> DataFrame:
    """id, other: distinct neighbours in either direction."""
    e = graph.edges.select("src", "dst")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(e.select("dst", "src")).distinct()


# op: A17
def clustering_coefficients(graph: PropertyGraph) -> DataFrame:
    """id, coefficient of nodes with two or more neighbours: the share of neighbour pairs that are linked.

    Triangles are counted by direction from the lower to the higher degree, so that a hub does not pair out all its
    neighbours.
    """
    pairs = graph.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = storage.stored(pairs, "pairs")
    deg = storage.stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("k")), "degrees")
    known = pairs.join(deg.withColumnsRenamed({"id": "a", "k": "ka"}), "a").join(deg.withColumnsRenamed({"id": "b", "k": "kb"}), "b")
    up = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    directed = storage.stored(known.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi")), "directed")
    wedges = directed.select("lo", F.col("hi").alias("x")).join(directed.select("lo", F.col("hi").alias("y")), "lo").filter("x < y")
    triangles = wedges.join(pairs, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))).select("lo", "x", "y")
    per = triangles.select(F.explode(F.array("lo", "x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    rows = deg.filter("k >= 2").join(per, "id", "left").join(graph.nodes.select("id"), "id", "left_semi")
    return rows.select("id", (F.coalesce("t", F.lit(0)) * 2 / (F.col("k") * (F.col("k") - 1))).alias("coefficient"))


# op: A10
def centrality(graph: PropertyGraph) -> DataFrame:
    """id, file, symbol, betweenness, pagerank, closeness, hub, authority, degree, by betweenness."""
    out = graph.nodes.select("ord", "id", owner(F.col("id")).alias("file"), F.try_element_at(F.split("id", "::"), F.lit(2)).alias("symbol"))
    for part in (betweenness(graph), pagerank(graph), closeness(graph), hits(graph), graph.degrees().select("id", "degree")):
        out = out.join(part, "id", "left")
    filled = out.na.fill(0.0, ["betweenness", "pagerank", "closeness", "hub", "authority"]).na.fill(0, ["degree"])
    return filled.orderBy(F.desc("betweenness"), "ord")


# op: A11
def centrality_stats(table: DataFrame, column: str = "betweenness") -> DataFrame:
    return table.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("stddev"))


# op: A12
def bottlenecks(table: DataFrame, sigmas: float = model.BOTTLENECK_SIGMAS) -> DataFrame:
    stats = centrality_stats(table)
    return table.crossJoin(F.broadcast(stats)).filter(F.col("betweenness") > F.col("mean") + sigmas * F.col("stddev")).drop("mean", "stddev")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of floats depend on their order; comparisons use rounded values."""
    value: dict[str, Column] = {c: F.round(c, digits) for c in columns}
    return df.withColumns(value)
