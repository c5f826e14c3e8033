"""Analyses of schema graphs: audit, blocks and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from . import algorithms as A

#: Definitions whose name holds this are roots and never dead.
ROOT_NAME = "AnalysisResult"
# Path prefixes of schema files and the blocks that they belong to.
BLOCKS = (("schema/graph/", "graph"), ("schema/acorn/", "parse"), ("schema/parse/", "parse"), ("schema/analysis/", "analysis"), ("schema/query/", "query"), ("schema/output/", "output"), ("schema/tool/", "tool"), ("schema/cli/", "cli"))


# op: N12
def schema_audit(graph: PropertyGraph, hub: str | None = None, root_name: str = ROOT_NAME) -> DataFrame:
    """kind, item, detail: totals, dead definitions, broken references, reference cycles, duplicate names and orphan files."""
    defs, refs = graph.nodes.filter("label = 'DEFINITION'"), graph.edges.filter("label = 'REF'")
    row = lambda df, kind, item, detail: df.select(F.lit(kind).alias("kind"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    targets = refs.select(F.col("dst").alias("id")).distinct()
    dead = defs.join(targets, "id", "left_anti").filter(~F.contains("name", F.lit(root_name)))
    broken = refs.join(graph.nodes.select(F.col("id").alias("dst")), "dst", "left_anti")
    twice = defs.groupBy("name").agg(F.countDistinct("file").alias("n")).filter("n > 1")
    used = targets.join(graph.nodes.select("id", "file"), "id").select(F.col("file").alias("name")).distinct()
    orphans = graph.nodes.filter("label = 'SCHEMA_FILE'").select("name").join(used, "name", "left_anti").filter(F.col("name") != F.lit(hub or ""))
    total = lambda df, name: row(df.agg(F.count(F.lit(1)).alias("n")), "total", F.lit(name), F.col("n"))
    return (
        total(defs, "definitions").unionByName(total(refs, "refs")).unionByName(total(graph.nodes.filter("label = 'PROPERTY'"), "properties"))
        .unionByName(row(dead, "dead_definition", F.col("id"), none)).unionByName(row(broken, "broken_ref", F.col("src"), F.col("dst")))
        .unionByName(row(A.reference_cycles(graph), "ref_cycle", F.array_join("path", " -> "), F.col("cross_file")))
        .unionByName(row(twice, "duplicate_name", F.col("name"), F.col("n"))).unionByName(row(orphans, "orphan_file", F.col("name"), none))
    )


def definition_graph(graph: PropertyGraph) -> PropertyGraph:
    return graph.subgraph(("DEFINITION",), ("REF",)).without_phantoms()


# op: N13
def schema_blocks(graph: PropertyGraph, bridges: int = 15) -> DataFrame:
    """kind, item, members, score: clusters, bridges (the highest betweenness above 0) and reference cycles of definitions."""
    g = definition_graph(graph).indexed()
    short = F.regexp_replace("id", "^schema::", "")
    clusters = A.clusters(g).select(F.lit("cluster").alias("kind"), F.col("community").cast("string").alias("item"), F.transform("members", lambda m: F.regexp_replace(m, "^schema::", "")).alias("members"), F.col("size").cast("double").alias("score"))
    top = A.betweenness(g).filter("betweenness > 0").orderBy(F.desc("betweenness"), "id").limit(bridges).select(F.lit("bridge").alias("kind"), short.alias("item"), F.array(short).alias("members"), F.col("betweenness").alias("score"))
    scc = A.strongly_connected(g).filter("size > 1").groupBy("component").agg(F.sort_array(F.collect_list(short)).alias("members"))
    rings = scc.select(F.lit("cycle").alias("kind"), F.element_at("members", 1).alias("item"), "members", F.size("members").cast("double").alias("score"))
    return clusters.unionByName(top).unionByName(rings)


def _aligned(members: DataFrame, part: str) -> DataFrame:
    """cluster, size, parts (with counts, largest first), aligned, primary, spillover. members: cluster, size, and the part of each member."""
    counts = members.groupBy("cluster", "size", part).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), part))
    ranked = counts.withColumn("r", first)
    grouped = ranked.groupBy("cluster", "size").agg(F.sort_array(F.collect_list(F.struct("r", F.col(part).alias("part"), "n"))).alias("s"))
    return grouped.select("cluster", "size", F.transform("s", lambda x: F.concat_ws(":", x.part, x.n)).alias("parts"), (F.size("s") == 1).alias("aligned"), F.col("s")[0]["part"].alias("primary"), F.transform(F.slice("s", 2, 1_000_000), lambda x: x.part).alias("spillover"))


def _members(blocks: DataFrame) -> DataFrame:
    return blocks.filter("kind = 'cluster'").select(F.col("item").alias("cluster"), F.col("score").cast("long").alias("size"), F.explode("members").alias("m")).withColumn("file", F.substring_index("m", "#", 1))


# op: N14
def file_alignment(blocks: DataFrame) -> DataFrame:
    return _aligned(_members(blocks), "file")


# op: N15
def block_alignment(blocks: DataFrame, prefixes: tuple[tuple[str, str], ...] = BLOCKS, hub: str | None = None) -> DataFrame:
    block = F.when(F.col("file") == F.lit(hub or ""), "system")
    for prefix, name in prefixes:
        block = block.when(F.startswith("file", F.lit(prefix)), name)
    return _aligned(_members(blocks).withColumn("block", block.otherwise("unknown")), "block").withColumn("mixed", ~F.col("aligned"))
