"""The property graph: nodes, edges and bindings as DataFrames, with its primitive views."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import model, storage


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of schema; missing ones are null."""
    fields = T.StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def owner(node_id: Column) -> Column:
    """The file of an id."""
    return F.substring_index(node_id, "::", 1)


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable directed multigraph. Nodes are unique by id; edges may repeat and may point at unknown ids (phantoms)."""

    nodes: DataFrame
    edges: DataFrame
    bindings: DataFrame | None = None

    # op: G1
    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, bindings: DataFrame | None = None) -> PropertyGraph:
        """From any DataFrames that have some of the columns of the model."""
        return cls(conform(nodes, model.NODES), conform(edges, model.EDGES), conform(bindings, model.BINDINGS) if bindings is not None else None)

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], model.NODES), spark.createDataFrame([], model.EDGES), spark.createDataFrame([], model.BINDINGS))

    # op: G2
    def add_nodes(self, more: DataFrame) -> PropertyGraph:
        """Upserts: of nodes of one id the last (largest ord) gives the values, the first the position."""
        rows = self.nodes.unionByName(conform(more, model.NODES))
        names = [c for c in rows.columns if c not in ("id", "ord")]
        merged = rows.groupBy("id").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*names), "ord").alias("v"))
        return replace(self, nodes=conform(merged.select("ord", "id", "v.*"), model.NODES))

    # op: G3
    def add_edges(self, more: DataFrame) -> PropertyGraph:
        return replace(self, edges=self.edges.unionByName(conform(more, model.EDGES)))

    # op: G4
    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    # op: G5
    def in_edges(self, node_id: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == node_id)

    def out_edges(self, node_id: str) -> DataFrame:
        return self.edges.filter(F.col("src") == node_id)

    # op: G6
    def in_neighbors(self, node_id: str) -> DataFrame:
        """With multiplicity: parallel edges repeat."""
        return self.in_edges(node_id).select(F.col("src").alias("id"))

    def out_neighbors(self, node_id: str) -> DataFrame:
        return self.out_edges(node_id).select(F.col("dst").alias("id"))

    # op: G7
    def degrees(self) -> DataFrame:
        """id, in_degree, out_degree, degree of all nodes; a self-loop counts on both sides. One shuffle, with partial sums."""
        one = lambda end, o, i: F.struct(F.col(end).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
        ends = self.edges.select(F.explode(F.array(one("src", 1, 0), one("dst", 0, 1))).alias("e")).select("e.*")  # edges are made once for both ends
        rows = ends.withColumn("n", F.lit(0)).unionByName(self.nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("n")))
        sums = rows.groupBy("id").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"), F.max("n").alias("n"))
        return sums.filter("n = 1").select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"))

    # op: G8
    def linked(self, node_id: str) -> DataFrame:
        """id, label, direction, edge_label of each linked known node, for each edge: out edges, then in edges."""
        out = self.out_edges(node_id).select(F.col("dst").alias("id"), F.lit("out").alias("direction"), F.col("label").alias("edge_label"))
        into = self.in_edges(node_id).select(F.col("src").alias("id"), F.lit("in").alias("direction"), F.col("label").alias("edge_label"))
        return out.unionByName(into).join(self.nodes.select("id", "label"), "id")

    # op: G9
    def phantoms(self) -> DataFrame:
        """Endpoints that are no nodes."""
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()
        return ends.join(self.nodes.select("id"), "id", "left_anti")

    def without_phantoms(self) -> PropertyGraph:
        """Only edges between known nodes."""
        known = self.nodes.select("id")
        e = self.edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, edges=e.select(*self.edges.columns))

    def indexed(self) -> PropertyGraph:
        """A copy stored and dealt by source, for repeated joins."""
        return replace(self, nodes=storage.stored(self.nodes, "nodes"), edges=storage.stored(self.edges, "edges"))

    # op: G10
    def file_nodes(self) -> DataFrame:
        return self.nodes.filter("label = 'FILE'")

    def symbol_nodes(self) -> DataFrame:
        return self.nodes.filter("label <> 'FILE'")

    def nodes_by_file(self, file: str) -> DataFrame:
        return self.nodes.filter(F.col("file") == file)

    # op: G13
    def edge_kinds(self, symbols: DataFrame) -> DataFrame:
        """symbols (symbol, file) with kind: the label of file::symbol in lower case, `namespace` for *, else `unknown`."""
        known = self.nodes.select(F.col("id").alias("_id"), F.lower("label").alias("_label"))
        joined = symbols.withColumn("_id", F.concat_ws("::", "file", "symbol")).join(known, "_id", "left")
        return joined.withColumn("kind", F.when(F.col("symbol") == "*", "namespace").otherwise(F.coalesce("_label", F.lit("unknown")))).drop("_id", "_label")

    def subgraph(self, node_labels: tuple[str, ...] | None = None, edge_labels: tuple[str, ...] | None = None) -> PropertyGraph:
        n = self.nodes.filter(F.col("label").isin(*node_labels)) if node_labels else self.nodes
        e = self.edges.filter(F.col("label").isin(*edge_labels)) if edge_labels else self.edges
        return replace(self, nodes=n, edges=e)

    # op: K1
    def save(self, path: str, mode: str = "overwrite") -> None:
        """Three Parquet tables; edges are partitioned by label, so that scans for some labels read only those."""
        self.nodes.write.mode(mode).parquet(f"{path}/nodes")
        self.edges.write.mode(mode).partitionBy("label").parquet(f"{path}/edges")
        if self.bindings is not None:
            self.bindings.write.mode(mode).parquet(f"{path}/bindings")

    def to_json(self) -> DataFrame:
        """One JSON text for each element: kind, json."""
        parts = [("nodes", self.nodes.drop("ord")), ("edges", self.edges.drop("idx").withColumnsRenamed({"src": "from", "dst": "to", "src_label": "fromLabel", "dst_label": "toLabel"}))]
        if self.bindings is not None:
            parts.append(("bindings", self.bindings))
        out = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json")) for kind, df in parts]
        first = out[0]
        for x in out[1:]:
            first = first.unionByName(x)
        return first

    # op: S12
    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PropertyGraph:
        import contextlib

        from pyspark.errors import AnalysisException

        bindings = None
        with contextlib.suppress(AnalysisException):
            bindings = spark.read.parquet(f"{path}/bindings")
        return cls.of(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), bindings)

    # op: K15
    def as_views(self, prefix: str = "") -> None:
        """Temporary views nodes and edges for SQL; nothing is copied."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")
