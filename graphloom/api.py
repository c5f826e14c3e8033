"""The library's front: analyse a project, then ask."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model, storage
from .frontend import build
from .graph import PropertyGraph
from .operators import algorithms as A
from .operators import code_analysis as C
from .operators import schema_analysis as S
from .operators import traversal as T
from .plans import cypher
from .report import diagrams, text
from .sources import files, schemas

FORMATS = ("text", "json", "mermaid", "dot", "swimlane", "graph", "summary", "table")


@dataclass
class Result:
    """What an analysis found; tables are lazy but stored where several others need them."""

    project: str
    timestamp: str
    graph: PropertyGraph
    files: DataFrame
    cycles: DataFrame
    violations: DataFrame
    complexity: DataFrame
    hot_paths: DataFrame
    clusters: DataFrame
    centrality: DataFrame
    schema_gaps: DataFrame | None
    duplicate_instantiations: DataFrame
    advice: DataFrame
    stats: DataFrame
    schema_graph: PropertyGraph | None
    schema_audit: DataFrame | None
    registry: DataFrame | None

    def tables(self) -> dict[str, DataFrame]:
        every = {"nodes": self.graph.nodes, "edges": self.graph.edges} | {k: getattr(self, k) for k in ("files", "cycles", "violations", "complexity", "hot_paths", "clusters", "centrality", "schema_gaps", "duplicate_instantiations", "advice", "stats", "schema_audit", "registry")}
        return {k: df for k, df in every.items() if df is not None}


class NotAnalyzed(RuntimeError):
    pass


# op: Q13
class Analyzer:
    """Holds the last analysis; there is no global state."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.result: Result | None = None
        self.raw_schema: str | None = None

    def analyze(self, paths: list[str], root: str | None = None, extensions: tuple[str, ...] = files.EXTENSIONS, registry: str | None = None, schema: list[str] | None = None, thresholds: dict | None = None) -> Result:
        root = files.infer_root(paths, root)
        found = files.collect_files(paths, tuple(extensions))
        reg, self.raw_schema = schemas.build_registry(self.spark, root, registry, schema)
        docs = schemas.schema_texts(self.spark, root)
        return self.analyze_texts(files.texts(self.spark, found, root), root, reg, docs, thresholds)

    def analyze_texts(self, texts: DataFrame, project: str = "project", registry: DataFrame | None = None, schema_docs: DataFrame | None = None, thresholds: dict | None = None) -> Result:
        """The same from source texts (ord, path, text) that are already a DataFrame."""
        facts = build.parse_files(texts, registry)
        graph = build.source_graph(facts).indexed()
        schema_graph = audit = None
        if schema_docs is not None and not storage.is_empty(schema_docs):
            schema_graph = schemas.schema_graph(schema_docs).indexed()
            audit = S.schema_audit(schema_graph)
        found = C.violations(graph)
        if registry is not None:
            found = C.overlay(found, registry)
        cycles, hot = storage.stored(A.cycles(graph), "cycles"), storage.stored(A.hot_paths(graph), "hot-paths")
        found, table = storage.stored(found, "violations"), storage.stored(C.complexity(facts, graph), "complexity")
        communities = storage.stored(A.louvain(graph), "communities")
        clusters = storage.stored(A.clusters(graph, communities).join(A.modularity(graph, communities), "community", "left"), "clusters")
        central = storage.stored(A.centrality(graph), "centrality")
        gaps = storage.stored(C.schema_gaps(facts, registry), "gaps") if registry is not None else None
        twice = storage.stored(C.duplicate_factories(graph.bindings), "duplicates")
        self.result = Result(
            project, datetime.now(UTC).isoformat(), graph, facts, cycles, found, table, hot, clusters, central, gaps, twice,
            C.advice(facts, graph.edges, cycles, found, hot, table, clusters, central, gaps, twice, thresholds),
            C.stats(facts, graph, cycles, found, hot, table, clusters, central, twice), schema_graph, audit, registry,
        )
        return self.result

    def _need(self) -> Result:
        if self.result is None:
            raise NotAnalyzed("analyze a project first")
        return self.result

    def impact(self, target: str, direction: str = "upstream", max_depth: int = model.IMPACT_DEPTH, granularity: str = "auto") -> DataFrame:
        return T.impact(self._need().graph, target, direction, max_depth, granularity)

    def context(self, target: str) -> DataFrame:
        return T.context(self._need().graph, target)

    def clusters(self) -> DataFrame:
        return self._need().clusters

    def processes(self, threshold: float = model.PROCESS["threshold"], max_depth: int = model.PROCESS["max_depth"]) -> DataFrame:
        entries = None
        if self.raw_schema:
            docs = self.spark.createDataFrame([(self.raw_schema,)], "text string")
            given = schemas.entry_point_overrides(docs)
            entries = None if storage.is_empty(given) else given
        return C.process_traces(self._need().graph, threshold, max_depth, entries)

    def schema_blocks(self) -> DataFrame | None:
        g = self._need().schema_graph
        return None if g is None else S.schema_blocks(g)

    def schema_blocks_text(self) -> str:
        g = self._need().schema_graph
        blocks = storage.stored(S.schema_blocks(g), "blocks")
        own = S.definition_graph(g)
        return text.blocks_text(text.rows_of(blocks), text.rows_of(S.file_alignment(blocks).orderBy("cluster")), text.rows_of(S.block_alignment(blocks, S.BLOCKS).orderBy("cluster")), own.nodes.count(), own.edges.count())

    def map(self) -> DataFrame:
        r = self._need()
        return C.architecture_map(r.files, r.graph)

    def query(self, cypher_text: str) -> DataFrame:
        return cypher.run(self._need().graph, cypher_text)

    # op: K11
    def render(self, format: str = "text") -> str:
        if format not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        r = self._need()
        file_graph = r.graph.subgraph(("FILE",), (*model.DEPENDENCIES, "REQUIRE", "EXTEND"))
        return {
            "text": lambda: text.as_text(r), "table": lambda: text.as_table_text(r), "json": lambda: text.as_json(r), "summary": lambda: text.summary(r), "mermaid": lambda: diagrams.mermaid(file_graph),
            "graph": lambda: diagrams.mermaid(r.graph), "dot": lambda: diagrams.dot(file_graph), "swimlane": lambda: diagrams.swimlane(file_graph),
        }[format]()

    # op: K14
    def passes(self) -> bool:
        """Whether no violation is confirmed."""
        return self._need().violations.filter(F.col("confirmed")).isEmpty()
