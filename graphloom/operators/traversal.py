"""Breadth-first operators: distances, shortest paths, blast radius, context and symbol lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model, storage
from ..graph import PropertyGraph, owner
from . import searches


#: Seeds up to which one loop over frontiers does all searches.
FEW = 20
#: Rounds of a search up to which edges are scanned anew in each instead of being stored.
SCANS = 3


# op: A20
def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, per_seed: bool = True) -> DataFrame:
    """seed, id, depth: what each seed reaches along edges (src, dst), the seeds themselves at depth 0.

    Without per_seed all seeds are one (seed is empty), so each node is visited once. A loop over frontiers: each round joins the newest level with the edges and drops what was seen. Every level is stored. Up to SCANS rounds scan the edges as they are, since a small frontier is sent to them. More than FEW seeds without max_depth are dealt over tasks with the whole adjacency, if that is not too large to send.
    """
    links = edges.select("src", "dst").filter("src is not null and dst is not null")
    if max_depth is None or max_depth > SCANS:  # many rounds read the edges: they are made once, each pair once
        links = storage.stored(links.distinct(), "links")
    if per_seed and max_depth is None and seeds.select("id").distinct().limit(FEW + 1).count() > FEW and links.count() <= searches.ADJACENCY_EDGES:
        seeds = storage.stored(seeds.select("id").distinct(), "seeds")
        ids = seeds.union(links.select("src")).union(links.select("dst")).distinct()
        if ids.count() <= searches.ADJACENCY_EDGES:
            ids = ids.toArrow().column("id").combine_chunks()
            tasks = max(1, min(seeds.count() // 64, 4 * seeds.sparkSession.sparkContext.defaultParallelism))
            return searches.distances(ids, *searches.numbered(ids, links), seeds.repartitionByRange(tasks, "id").sortWithinPartitions("id"))
    frontier = storage.stored(seeds.select((F.col("id") if per_seed else F.lit("")).alias("seed"), "id").distinct().withColumn("depth", F.lit(0)), "frontier")
    levels, depth = [frontier], 0
    while (max_depth is None or depth < max_depth) and not storage.is_empty(frontier):
        depth += 1
        reached = links.join(storage.if_small(frontier.select("seed", F.col("id").alias("src"))), "src").select("seed", F.col("dst").alias("id")).distinct()
        for old in levels:
            reached = reached.join(old.select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = storage.stored(reached.withColumn("depth", F.lit(depth)), "frontier")
        levels.append(frontier)
        if len(levels) > 8:  # fewer anti-joins on deep graphs
            every = levels[0]
            for x in levels[1:]:
                every = every.unionByName(x)
            levels = [storage.stored(every, "reached")]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


# op: A5
def shortest_path(graph: PropertyGraph, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """One row (path, length in nodes) or none. Among shortest paths the first discovered: the smallest sequence of edge indices."""
    spark = graph.nodes.sparkSession
    known = graph.nodes.filter(F.col("id").isin(source, target)).select("id").distinct().count()
    empty = spark.createDataFrame([], "path array<string>, length int")
    if known < (1 if source == target else 2):
        return empty
    if source == target:
        return spark.createDataFrame([([source], 1)], "path array<string>, length int")
    links = storage.stored(graph.edges.filter("dst is not null").select("idx", "src", "dst"), "links")
    level = spark.createDataFrame([(source, [source], [])], "id string, path array<string>, steps array<long>")
    seen, depth = level.select("id"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), F.concat("steps", F.array("idx")).alias("steps"))
        level = storage.stored(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min_by("path", "steps").alias("path"), F.min("steps").alias("steps")), "level")
        hit = level.filter(F.col("id") == target)
        if not storage.is_empty(hit):
            return hit.select("path", F.size("path").alias("length"))
        if storage.is_empty(level):
            return empty
        seen = storage.stored(seen.union(level.select("id")), "seen")
    return empty


# op: Q1
def symbols_named(graph: PropertyGraph, name: str) -> DataFrame:
    return graph.nodes.filter((F.col("name") == name) & (F.col("label") != "FILE"))


# op: Q2
def symbol_at(graph: PropertyGraph, file: str, name: str) -> DataFrame:
    return graph.node(f"{file}::{name}")


# op: Q3
def incoming_edges(graph: PropertyGraph, file: str, file_label: str = "FILE") -> DataFrame:
    return graph.edges.filter((F.col("dst") == file) & (F.col("dst_label") == file_label))


def outgoing_edges(graph: PropertyGraph, file: str, file_label: str = "FILE") -> DataFrame:
    return graph.edges.filter((F.col("src") == file) & (F.col("src_label") == file_label))


# op: Q4
def incoming_symbol_edges(graph: PropertyGraph, file: str, symbol: str) -> DataFrame:
    return graph.in_edges(f"{file}::{symbol}")


def outgoing_symbol_edges(graph: PropertyGraph, file: str, symbol: str) -> DataFrame:
    return graph.out_edges(f"{file}::{symbol}")


# op: Q5
def file_edges(graph: PropertyGraph, file_label: str = "FILE") -> DataFrame:
    return graph.edges.filter((F.col("src_label") == file_label) & (F.col("dst_label") == file_label))


def symbol_edges(graph: PropertyGraph, file_label: str = "FILE") -> DataFrame:
    both = (F.col("src_label") == file_label) & (F.col("dst_label") == file_label)
    return graph.edges.filter(~F.coalesce(both, F.lit(False)))


# op: Q6
def all_symbols(graph: PropertyGraph) -> DataFrame:
    return graph.symbol_nodes()


# op: Q9
def seeds(graph: PropertyGraph, target: str) -> DataFrame:
    """id, label, file: the nodes that target means, by the first rule that gives any: the id if it has ::, the exact id, the first file of the same base name, the first file that ends with it, all symbols of that name.

    The five rules are one scan: each node gets the rank of the best rule that it meets.
    """
    base = F.element_at(F.split("id", "/"), -1)
    last = target.rstrip("/").split("/")[-1]
    is_file, exact = F.col("label") == "FILE", F.col("id") == target
    ranked = graph.nodes.select(
        "id", "label", "file", "ord",
        F.when(exact & F.lit("::" in target), 1).when(exact, 2).when(is_file & (base == last), 3).when(is_file & F.endswith("id", F.lit(target)), 4).when(~is_file & (F.col("name") == target), 5).alias("rank"),
    ).filter("rank is not null")
    if "::" in target:
        ranked = ranked.filter("rank = 1")
    best = ranked.agg(F.min(F.struct("rank", "ord")).alias("b"))
    one = F.col("rank").isin(3, 4) & (F.col("ord") != F.col("b.ord"))
    return ranked.crossJoin(F.broadcast(best)).filter((F.col("rank") == F.col("b.rank")) & ~one).select("id", "label", "file")


# op: Q8
def impact(graph: PropertyGraph, target: str | DataFrame, direction: str = "upstream", max_depth: int = model.IMPACT_DEPTH, granularity: str = "auto") -> DataFrame:
    """id, label, name, file, depth (from 1) of what depends on the target (upstream) or what it depends on (downstream)."""
    start = seeds(graph, target) if isinstance(target, str) else target
    links = graph.edges.select("src", "dst", "src_label", "dst_label")
    if granularity == "file" and isinstance(target, str):
        start = start.select(owner(F.col("id")).alias("id")).distinct()
    elif granularity == "symbol" and isinstance(target, str):
        start = start.filter("label <> 'FILE'")
    if direction == "upstream":
        links = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    levels = bfs(links.select("src", "dst"), start, max_depth, per_seed=False)
    nearest = levels.groupBy("id").agg(F.min("depth").alias("depth")).filter("depth > 0")
    return nearest.join(graph.nodes.select("id", "label", "name", "file"), "id", "left").select("id", "label", "name", F.coalesce("file", owner(F.col("id"))).alias("file"), "depth")


# op: Q10
def risk(depth):
    return F.when(depth == 1, "WILL BREAK").when(depth == 2, "LIKELY AFFECTED").otherwise("MAY NEED TESTING")


# op: Q7
def context(graph: PropertyGraph, target: str) -> DataFrame:
    """part, id, other, label: the targets themselves, and callers and callees of their files and of the symbols."""
    found = graph.nodes.filter(F.col("id") == target)
    if "::" not in target:
        by_file = graph.nodes.filter((F.col("file") == target) & (F.col("label") != "FILE"))
        by_name = symbols_named(graph, target)
        found = by_file if not storage.is_empty(by_file) else by_name
    targets = storage.stored(found.select("id", "file").distinct(), "targets")
    files = targets.select(F.col("file").alias("id")).distinct()

    def part(name: str, ids: DataFrame, inward: bool, level: str) -> DataFrame:
        end, other = ("dst", "src") if inward else ("src", "dst")
        on_file = F.col(f"{end}_label") == "FILE"
        e = graph.edges.filter(on_file if level == "file" else ~on_file)
        return e.join(storage.if_small(ids), F.col(end) == F.col("id")).select(F.lit(name).alias("part"), "id", F.col(other).alias("other"), "label")

    own = targets.select(F.lit("target").alias("part"), "id", F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("label"))
    return (
        own.unionByName(part("file_caller", files, True, "file")).unionByName(part("file_callee", files, False, "file"))
        .unionByName(part("symbol_caller", targets.select("id"), True, "symbol")).unionByName(part("symbol_callee", targets.select("id"), False, "symbol"))
    )
