"""Diagrams: Mermaid, DOT and swimlanes. Lines are made in DataFrames; only rendering collects them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..graph import PropertyGraph
from ..operators import algorithms as A

#: Edge labels drawn dotted.
DOTTED = ("EXTEND", "DYNAMIC_IMPORT")


def _numbered(graph: PropertyGraph) -> DataFrame:
    return storage.with_ordinals(graph.nodes.select("ord", "id", "name"), "k", "ord")


def _unique_edges(graph: PropertyGraph) -> DataFrame:
    """The first edge of each pair, in edge order."""
    return graph.edges.groupBy("src", "dst").agg(F.min("idx").alias("idx"), F.min_by("label", "idx").alias("label"))


# op: K5
def mermaid_edges(graph: PropertyGraph) -> DataFrame:
    """line of each distinct pair of known nodes."""
    n = _numbered(graph)
    e = _unique_edges(graph).join(n.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    arrow = F.when(F.col("label").isin(*DOTTED), " -.-> ").otherwise(" --> ")
    return e.orderBy("idx").select(F.concat(F.lit("  n"), "a", arrow, F.lit("n"), "b").alias("line"))


def mermaid(graph: PropertyGraph) -> str:
    nodes = [f'  n{r.k}["{re.sub(r"[^\w./:#-]", "_", r.id)}"]' for r in _numbered(graph).orderBy("k").collect()]
    return "\n".join(["graph LR", *nodes, *(r.line for r in mermaid_edges(graph).collect())])


# op: K6
def dot(graph: PropertyGraph) -> str:
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    nodes = [f"  {quote(r.id)};" for r in graph.nodes.orderBy("ord").select("id").collect()]
    edges = [f"  {quote(r.src)} -> {quote(r.dst)}{' [style=dashed]' if r.label in DOTTED else ''};" for r in _unique_edges(graph).orderBy("idx").collect()]
    return "\n".join(["digraph G {", "  rankdir=LR;", "  node [shape=box];", *nodes, *edges, "}"])


# The marks of an edge's source and target, of a lane that it crosses, of an empty lane and between lanes.
SOURCE, TARGET, CROSSED, LANE, BETWEEN = "╤", "╧", "╪", "═", "│"
#: Width of a name, and of its lane, where there are no edges.
PLAIN_WIDTH = 20


# op: K7
def swimlane(graph: PropertyGraph) -> str:
    """Nodes as lanes, predecessors first, and one column for each edge between known nodes, the short ones first, parallel ones too. Between lanes an edge is drawn from its upper to its lower end."""
    lanes = [r.id for r in A.depth_first_order(graph).orderBy("position").collect()]
    at = {x: k for k, x in enumerate(lanes)}
    found = [(at[r.src], at[r.dst]) for r in graph.without_phantoms().edges.orderBy("idx").select("src", "dst").collect()]
    columns = sorted(found, key=lambda e: (abs(e[0] - e[1]), e[0]))
    if not columns:
        return "\n".join(f"{x.ljust(PLAIN_WIDTH)} {LANE * PLAIN_WIDTH}" for x in lanes)
    width = max(map(len, lanes)) + 1
    out = []
    for k, name in enumerate(lanes):
        marks = (SOURCE if k == a else TARGET if k == b else CROSSED if min(a, b) < k < max(a, b) else LANE for a, b in columns)
        out.append(name.ljust(width) + "".join(marks))
        if k + 1 < len(lanes):
            out.append(" " * width + "".join(BETWEEN if min(a, b) <= k < max(a, b) else " " for a, b in columns))
    return "\n".join(out) + "\n"


# op: K8
def swimlane_of(spark, edges: list[tuple[str, str]], files: list[str]) -> str:
    """From pairs and names; each pair counts once, and pairs of unknown names are left out."""
    nodes = spark.createDataFrame([(k, x, "FILE", x) for k, x in enumerate(files)], "ord long, id string, label string, name string")
    known = set(files)
    rows = [(k, a, b, "IMPORT") for k, (a, b) in enumerate(dict.fromkeys(edges)) if a in known and b in known]
    return swimlane(PropertyGraph.of(nodes, spark.createDataFrame(rows, "idx long, src string, dst string, label string")))
