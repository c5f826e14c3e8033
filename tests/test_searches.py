"""Searches from many sources at a time."""

import random

import numpy as np
import pytest

from graphloom import storage
from graphloom.operators import algorithms as A
from graphloom.operators import blocks
from graphloom.operators import searches
from graphloom.operators import traversal as T

from .test_graph import graph


def test_many_seeds_take_no_rounds(spark, monkeypatch):
    """A chain of 60 nodes, all of them seeds: distances are found without a stored level a round."""
    g, steps, stored = graph(spark, [(f"v{k:02d}", f"v{k + 1:02d}") for k in range(59)]), [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name="step": steps.append(name) or stored(df, name))
    found = {(r.seed, r.id): r.depth for r in T.bfs(g.edges, g.nodes.select("id")).collect()}
    assert found == {(f"v{a:02d}", f"v{b:02d}"): b - a for a in range(60) for b in range(a, 60)} and len(steps) < 10


def test_many_seeds_against_one_by_one(spark):
    """Self-loops, parallel edges, unknown seeds and ends that are no seeds; a null end is no link."""
    r = random.Random(5)
    pairs = [(f"v{r.randrange(40):02d}", f"v{r.randrange(40):02d}") for _ in range(70)]
    edges = spark.createDataFrame([*pairs, pairs[0], ("v01", None), ("v02", "out")], "src string, dst string")
    seeds = [f"v{k:02d}" for k in range(0, 40)] + ["alone"]
    many = T.bfs(edges, spark.createDataFrame([(x,) for x in seeds], "id string")).collect()
    assert len({(x.seed, x.id) for x in many}) == len(many)
    for x in ("v01", "v02", "v33", "alone"):
        one = T.bfs(edges, spark.createDataFrame([(x,)], "id string")).collect()
        assert {(y.id, y.depth) for y in one} == {(y.id, y.depth) for y in many if y.seed == x}


def naive(pairs, n):
    """Closeness and unscaled betweenness by one queue a source."""
    close, total = np.zeros(n), np.zeros(n)
    for s in range(n):
        dist, paths, order, below = {s: 0}, np.zeros(n), [s], np.zeros(n)
        paths[s] = 1
        for v in order:
            for a, b in pairs:
                if a == v:
                    if b not in dist:
                        dist[b] = dist[v] + 1
                        order.append(b)
                    if dist[b] == dist[v] + 1:
                        paths[b] += paths[v]
        for w in reversed(order[1:]):
            for a, b in pairs:
                if b == w and dist.get(a, n) == dist[w] - 1:
                    below[a] += paths[a] / paths[w] * (1 + below[w])
            total[w] += below[w]
        far = sum(dist.values())
        close[s] = (len(order) - 1) ** 2 / (n - 1) / far if far else 0
    return close, total


@pytest.mark.parametrize("row_bytes, elements", [(searches.ROW_BYTES, searches.ELEMENTS), (200, 7)])
def test_batches_against_queues(monkeypatch, row_bytes, elements):
    """Dense and sparse, with parallel edges and self-loops, in one batch and in many small ones."""
    monkeypatch.setattr(searches, "ROW_BYTES", row_bytes)
    monkeypatch.setattr(searches, "ELEMENTS", elements)
    r = random.Random(3)
    for n, m in ((1, 0), (5, 3), (30, 45), (30, 300), (70, 90)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        s, d = np.array(pairs, np.int64).reshape(-1, 2).T
        g = searches.Adjacency(*searches.compressed(s, d, n))
        close, total = naive(pairs, n)
        assert searches.closeness(g, np.arange(n)) == pytest.approx(close)
        assert searches.dependencies(g, np.arange(n)) == pytest.approx(total)


def by_blocks(pairs, n):
    """Betweenness by blocks and places that search for others, and how often an edge may be met: edges of a block times its sources."""
    s, d = np.array([x for x in pairs if x[0] != x[1]], np.int64).reshape(-1, 2).T
    pieces = blocks.split(*searches.compressed(s, d, n))
    how = blocks.shared(pieces)
    sources, parts = blocks.portions(pieces, how)
    total, reached, back, work = np.zeros(len(pieces.node)), pieces.found.copy(), np.zeros(len(pieces.node), bool), 0
    for lo, hi, a, b in parts:
        g = searches.Adjacency(pieces.starts[lo : hi + 1] - pieces.starts[lo], pieces.targets[pieces.starts[lo] : pieces.starts[hi]] - np.int32(lo))
        v, w, x = searches.weighted_dependencies(g, sources[a:b] - lo, how.size[lo:hi], pieces.found[lo:hi], how.by[lo:hi] - lo, how.size[lo:hi])
        total[lo:hi] += v
        reached[sources[a:b]] = w
        back[lo:hi] |= x
        work += (b - a) * len(g.targets)
    return blocks.complete(pieces, how, total, reached, back), work


@pytest.mark.parametrize("together, reach, matrix", [(512, 1 << 34, 3000), (1, 1 << 34, 0), (4, 0, 3000)])
def test_betweenness_by_blocks_against_queues(monkeypatch, together, reach, matrix):
    """Graphs with bridges, one-way parts, circles, parallel edges and self-loops; small blocks apart and together, or the graph whole."""
    monkeypatch.setattr(blocks, "TOGETHER", together)
    monkeypatch.setattr(blocks, "REACH", reach)
    monkeypatch.setattr(searches, "MATRIX_NODES", matrix)
    r = random.Random(8)
    for turn in range(60):
        n = r.randrange(1, 16)
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(2 * n + 1))]
        if turn % 2:
            pairs = [(a, min(n - 1, a + r.randrange(3))) if r.random() < 0.7 else (min(n - 1, a + 1), a) for a, _ in pairs]
        assert by_blocks(pairs, n)[0] == pytest.approx(naive(pairs, n)[1])
    circle = [(k, (k + 1) % 9) for k in range(9)]
    assert by_blocks([*circle, (9, 3), (10, 9)], 11)[0] == pytest.approx(naive([*circle, (9, 3), (10, 9)], 11)[1])


def test_betweenness_takes_few_searches(spark, monkeypatch):
    """Copies one after the other are searched by themselves, and long ways without forks by their ends. Before, all edges were met from all nodes."""
    monkeypatch.setattr(blocks, "TOGETHER", 1)
    r = random.Random(9)
    one = [(k, (k + 1) % 20) for k in range(20)] + [(r.randrange(20), r.randrange(20)) for _ in range(60)]
    chain = [(a + 20 * k, b + 20 * k) for k in range(12) for a, b in one] + [(20 * k + 19, 20 * k + 20) for k in range(11)]
    got, work = by_blocks(chain, 240)
    assert got == pytest.approx(naive(chain, 240)[1]) and work * 10 < 240 * len(chain)
    ways = [(a + 200, b) for a, b in one] + [(a + 20 * k, a + 20 * k + 20) for k in range(10) for a in range(20)]
    got, work = by_blocks(ways, 220)
    assert got == pytest.approx(naive(ways, 220)[1]) and work * 10 < 220 * len(ways)
    g = graph(spark, [(f"v{a:02d}", f"v{b:02d}") for a, b in ways], 220)
    found = {x.id: x.betweenness for x in A.betweenness(g).collect()}
    assert [found[f"v{k:02d}"] * 219 * 218 for k in range(220)] == pytest.approx(got)


def test_bottlenecks_search_once(spark):
    """Bottlenecks read betweenness twice; their plan holds no search, before it held two."""
    pairs = [(k, (k + 1) % 6) for k in range(6)] + [(0, 6), (6, 7), (7, 8), (8, 9), (9, 7), (3, 0)]
    found = A.bottlenecks(A.betweenness(graph(spark, [(f"v{a:02d}", f"v{b:02d}") for a, b in pairs], 10)), 1.0)
    assert "MapIn" not in found._jdf.queryExecution().toString()
    x = naive(pairs, 10)[1] / 72
    assert {r.id: r.betweenness for r in found.collect()} == pytest.approx({f"v{k:02d}": x[k] for k in range(10) if x[k] > x.mean() + x.std()})


def test_centrality_stats_of_a_chain(spark):
    """All blocks of a chain are single links, which need no search: before, there was one from each node, in tasks that were part of the plan."""
    stats = A.centrality_stats(A.betweenness(graph(spark, [(f"v{k:02d}", f"v{k + 1:02d}") for k in range(29)])))
    x = np.array([k * (29 - k) / (29 * 28) for k in range(30)])
    assert "MapIn" not in stats._jdf.queryExecution().toString() and tuple(stats.first()) == pytest.approx((x.mean(), x.std()))


def test_adjacency_of_the_users_of_a_gigabyte():
    """The users graph of 60 x sf0.1 has 5,868,959 links."""
    assert A.ADJACENCY_EDGES >= 5_868_959


def test_kernels_of_the_users_of_a_gigabyte():
    assert storage.KERNEL_EDGES >= 5_868_959


def test_kernels_keep_numbers_and_the_order_of_edges(spark):
    """Edges come by idx whatever the order of rows, as two arrays; unknown ends are left out."""
    nodes = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "ord long, id string")
    edges = spark.createDataFrame([(3, "c", "a"), (1, "a", "c"), (2, "a", "gone"), (0, "a", "b")], "idx long, src string, dst string")
    work = lambda ids, pairs: [(str(ids), str(list(pairs)), f"{pairs.src.dtype} {pairs.rows(3)(0)} {pairs.rows(3, both=True)(0)}")]
    assert tuple(storage.kernel(nodes, edges, work, "a string, b string, c string").first()) == ("['a', 'b', 'c']", "[(0, 1), (0, 2), (2, 0)]", "int32 [1, 2] [1, 2, 2]")


def louvain_by_lists(n, pairs, passes=50):
    """The moves as written before, counting links anew for each community."""
    out, into = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in pairs:
        out[a].append(b)
        into[b].append(a)
    near, m = [list(dict.fromkeys([*out[v], *into[v]])) for v in range(n)], len(pairs)
    k = [len(x) for x in near]
    home, total = list(range(n)), [float(x) for x in k]
    links = lambda v, c: sum(1 for w in near[v] if w != v and home[w] == c)
    for _ in range(passes):
        moved = False
        for v in range(n):
            own, best, gain = home[v], home[v], 0.0
            for c in dict.fromkeys(home[w] for w in near[v]):
                g = (links(v, c) - links(v, own)) / (2 * m) - k[v] * (total[c] - (total[own] - k[v])) / (2 * m) ** 2
                if c != own and g > gain:
                    best, gain = c, g
            if best != own:
                total[own] -= k[v]
                total[best] += k[v]
                home[v], moved = best, True
        if not moved:
            break
    names = {}
    return [names.setdefault(c, len(names)) for c in home]


def test_louvain_moves_as_before(spark):
    """With self-loops and parallel edges, whose counts a community's links must leave out."""
    for seed in (1, 2):
        r = random.Random(seed)
        pairs = [(a := r.randrange(30), r.choice([a, a // 10 * 10 + r.randrange(10), r.randrange(30)])) for _ in range(90)]
        g = graph(spark, [(f"v{a:02d}", f"v{b:02d}") for a, b in pairs], 30)
        assert [x.community for x in A.louvain(g).orderBy("id").collect()] == louvain_by_lists(30, pairs)


def test_communities_are_found_once(spark, monkeypatch):
    """a_clusters reads them three times."""
    from graphloom.plans import graph_queries

    names, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name="step": names.append(name) or stored(df, name))
    found = graph_queries._communities(graph(spark, [("a", "b"), ("b", "a"), ("c", "d")])).collect()
    assert names.count("communities") == 1 and sorted(r.members for r in found) == [["a", "b"], ["c", "d"]]


def cycles_by_lists(n, pairs):
    after, state, found = [[b for a, b in pairs if a == v] for v in range(n)], [0] * n, []
    for root in range(n):
        if state[root]:
            continue
        state[root], path, stack = 1, [root], [iter(after[root])]
        while stack:
            w = next(stack[-1], None)
            if w is None:
                stack.pop()
                state[path.pop()] = 2
            elif state[w] == 1:
                found.append(path[path.index(w) :])
            elif state[w] == 0:
                state[w] = 1
                path.append(w)
                stack.append(iter(after[w]))
    return found


def test_cycles_are_read_off_the_forest_in_many_tasks(spark, monkeypatch):
    """Deep and branching forests of several roots, in batches of few ids; only one cycle crosses files."""
    monkeypatch.setattr(searches, "ELEMENTS", 5)
    for seed, m in ((1, 30), (2, 70)):
        r = random.Random(seed)
        pairs = [(r.randrange(25), r.randrange(25)) for _ in range(m)]
        g = graph(spark, [(f"v{a:02d}", f"v{b:02d}") for a, b in pairs], 25)
        rows = A.cycles(g)
        assert rows.rdd.getNumPartitions() > 1
        expected = cycles_by_lists(25, pairs)
        assert [[int(x[1:]) for x in row.path] for row in rows.orderBy("k").collect()] == expected
        assert [row.k for row in rows.orderBy("k").collect()] == list(range(len(expected))) and all(row.length == len(row.path) for row in rows.collect())
    g = graph(spark, [("a::x", "a::y"), ("a::y", "a::x"), ("a::y", "b::x"), ("b::x", "a::x")])
    assert {(len(x.path), x.cross_file) for x in A.cycles(g).collect()} == {(2, False), (3, True)}


def test_topological_order_by_rounds(spark):
    """First in, first out, beyond the kernel's limit too: nodes join the queue at the last edge into them, also among parallel edges."""
    for seed in (1, 2):
        r = random.Random(seed)
        pairs = [tuple(sorted(r.sample(range(14), 2))) for _ in range(24)]
        pairs += pairs[:3]
        g = graph(spark, [(f"v{a:02d}", f"v{b:02d}") for a, b in pairs], 14)
        one, many = ({x.id: x.position for x in A.topological_order(g, limit=limit).collect()} for limit in (100, 5))
        assert one == many and len(one) == 14
    for pairs in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")]):
        assert A.topological_order(graph(spark, pairs), limit=1).count() == 0
