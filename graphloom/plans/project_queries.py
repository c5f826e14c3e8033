"""Registered queries over small literal projects, schemas and documents. Their rows in project_goldens.py were computed once and then read over against the rules of the operators."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api, storage
from ..frontend import build
from ..functions.scalars import half_up, padded, to_fixed_1
from ..graph import PropertyGraph
from ..operators import algorithms as A
from ..operators import code_analysis as C
from ..operators import schema_analysis as S
from ..operators import traversal as T
from ..report import diagrams, text
from ..sources import files, schemas, tables
from ..validate.columns import validated
from ..validate.engine import Document, Hub, Loader, Validator
from .corpus import FILES, REGISTRY, SCHEMAS, project, texts, values
from .graph_queries import H
from .project_goldens import GOLDENS

#: A project with the constructs that FILES lacks.
MORE_FILES = {
    "all.mjs": "export * from './m.mjs'\nexport * as deep from './x.mjs'\n",
    "dyn.js": "const m = require('./m.mjs')\nexport async function late() { return import('./x.mjs') }\n",
    "lone.mjs": "const alone = 1\n",
    "m.mjs": "/**\n * Makes one.\n * @returns {object} of two methods\n */\nexport function make(kind) {\n  return { go, stop }\n}\nfunction go() {}\nfunction stop() {}\nexport class Base { run() {} }\nexport const tag = (s) => s\nexport const cfg = []\n",
    "x.mjs": "import { make, Base as B, tag, cfg } from './m.mjs'\nconst inst = make()\nconst { left: l } = make()\nconst [first] = make()\ninst.go()\nmake.call(null)\nmake.apply(null)\nnew B()\ntag`x`\nf(...cfg)\nlet other\nother = make\nexport class K extends B { run() { inst.stop() } }\nconst L = class extends B {}\n",
}
MORE_REGISTRY = [("m.mjs", "make", True, 1), ("m.mjs", "go", True, 0)]
REGISTRY_DOCS = {
    "config/public.json": '{"title":"lib/store.mjs","x-methods":{"createStore":{"properties":{"params":{"minItems":0}}},"helper":{}},"x-entry-points":[{"file":"a.mjs"},{"file":"lib/index.mjs"}]}',
    "schema/more.json": '{"definitions":{"b.mjs":{"x-methods":{"run":{"properties":{"params":{"maxItems":2}}}}}}}',
    "own.schema.json": '{"title":"a.mjs","x-methods":{"main":{"properties":{"params":{"minItems":2,"maxItems":3}}}}}',
    "registry.json": '{"lib/store.mjs":["createStore","hidden"],"a.mjs":["main"]}',
    "hub-registry.json": '{"definitions":{"PublicInterfaceRegistry":{"default":{"b.mjs":["run"]}}}}',
}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def literal(f):
    """Registers f(spark), with the golden rows of its name."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark)

    q.__name__, q.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = q
    if f.__name__ in GOLDENS:
        names, rows = GOLDENS[f.__name__]
        ORACLE_SQL[f.__name__] = values(names, *rows)
    return f


def table(sql: str):
    """Registers f(spark, sf_dir) with SQL over the tables."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def lines(spark: SparkSession, out: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(out.rstrip("\n").split("\n"))), "k int, line string")


def registry(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "file string, method string, has_xmethod boolean, param_count int")


def facts(spark: SparkSession, of: dict[str, str] = FILES, known=None) -> DataFrame:
    return project(spark).facts if of is FILES else build.parse_files(texts(spark, of), registry(spark, known) if known else None)


def graph(spark: SparkSession, of: dict[str, str] = FILES, known=None) -> PropertyGraph:
    return project(spark).graph if of is FILES else build.source_graph(facts(spark, of, known)).indexed()


_analyzers: dict[tuple, api.Analyzer] = {}


def analyzer(spark: SparkSession, known=REGISTRY) -> api.Analyzer:
    """The project analysed, once in an application with and once without a registry."""
    key = spark.sparkContext.applicationId, known is None
    if key in _analyzers:
        return _analyzers[key]
    a = _analyzers[key] = api.Analyzer(spark)
    docs = schemas.schema_documents(texts(spark, SCHEMAS))
    a.analyze_texts(texts(spark, FILES), "/work/corpus", registry(spark, known) if known else None, docs)
    return a


def folder(spark: SparkSession, of: dict[str, str]) -> str:
    """A new folder of files in the shared folder."""
    root = os.path.join(storage.shared_dir(spark), "graphloom", f"project-{abs(hash(tuple(of))) % 10**8}-{os.urandom(4).hex()}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path, body in of.items():
        at = jvm.org.apache.hadoop.fs.Path(os.path.join(root, path))
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(body.encode()))
        out.close()
    return root


# --- extraction
@literal
def e_more_edges(spark):
    return graph(spark, MORE_FILES, MORE_REGISTRY).edges.select("src", "dst", "label", "src_label", "dst_label")


@literal
def e_more_bindings(spark):
    return graph(spark, MORE_FILES).bindings


@literal
def e_schema_names(spark):
    """Symbols of edges that the registry makes public."""
    e = graph(spark, MORE_FILES, MORE_REGISTRY).edges.select("src", "dst", "label", F.explode("attrs.symbols").alias("s"))
    return e.select("src", "dst", "label", F.col("s.name").alias("symbol"), F.col("s.schema").alias("public")).filter("public is not null")


@literal
def e_documentation(spark):
    n = graph(spark, MORE_FILES).nodes.filter("label = 'FUNCTION'")
    return n.select("id", "attrs.jsdoc", "attrs.returns", "attrs.signature", "attrs.async")


@literal
def e_classes(spark):
    return facts(spark, MORE_FILES).select(F.col("path").alias("file"), F.explode("classes").alias("c")).select("file", "c.name", F.col("c.extends").alias("above"), F.array_join("c.methods", ",").alias("methods"))


@literal
def e_exports(spark):
    return facts(spark, MORE_FILES).select(F.col("path").alias("file"), F.explode("exports").alias("e")).select("file", "e.name", "e.type", "e.source")


@literal
def e_dynamic_imports(spark):
    return facts(spark, MORE_FILES).select(F.col("path").alias("file"), F.explode("imports").alias("i")).filter("i.isDynamic").select("file", "i.name", "i.source")


@literal
def e_files(spark):
    """One record for each file, with its parse error if there is one."""
    return facts(spark, {**MORE_FILES, "bad.js": "function ("}).select("path", "lines", F.size("functions").alias("functions"), F.array_join("calls", ",").alias("calls"), F.col("error").isNotNull().alias("broken"))


# --- graph views
@literal
def g_edge_kinds(spark):
    g = graph(spark)
    asked = g.edges.filter("label = 'IMPORT'").select(F.explode("attrs.symbols").alias("s"), F.col("dst").alias("file")).select(F.col("s.name").alias("symbol"), "file").distinct()
    return g.edge_kinds(asked)


@literal
def g_file_views(spark):
    g = graph(spark)
    name = lambda df, part: df.select(F.lit(part).alias("part"), "id")
    return name(g.file_nodes(), "files").unionByName(name(g.symbol_nodes(), "symbols")).unionByName(name(g.nodes_by_file("lib/store.mjs"), "of lib/store.mjs"))


@table(f"with {H} select id, label, name, 0 as added from h_nodes where label <> 'NATION' union all select id, label, lower(name), 0 from h_nodes where label = 'NATION' union all select 'X1', 'NATION', 'new', 1")
def g_add_nodes(spark, sf_dir):
    """Upserts: each nation again, under another name, and one more node."""
    g = tables.hierarchy(spark, sf_dir)
    again = g.nodes.filter("label = 'NATION'").withColumn("ord", F.col("ord") + 10**17).withColumn("name", F.lower("name"))
    more = again.unionByName(again.limit(1).withColumn("id", F.lit("X1")).withColumn("name", F.lit("new")))
    return g.add_nodes(more).nodes.select("id", "label", "name", (F.col("id") == "X1").cast("int").alias("added"))


@table(f"with {H} select label, count(*) as n from (select label from h_edges union all select 'HOLDS' from h_edges where label = 'IN_REGION') group by 1")
def g_add_edges(spark, sf_dir):
    g = tables.hierarchy(spark, sf_dir)
    more = g.edges.filter("label = 'IN_REGION'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("HOLDS").alias("label"))
    return g.add_edges(more).edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@table(f"with {H}, e as (select 'node' as kind, label, count(*) as n from h_nodes group by all union all select 'edge', label, count(*) from h_edges group by all) select kind, label, n from e")
def k_save_and_load(spark, sf_dir):
    path = os.path.join(storage.shared_dir(spark), "graphloom", f"saved-{os.urandom(6).hex()}")
    tables.hierarchy(spark, sf_dir).save(path)
    g = PropertyGraph.load(spark, path)
    count = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), "label").agg(F.count(F.lit(1)).alias("n"))
    return count(g.nodes, "node").unionByName(count(g.edges, "edge"))


@table(f"with {H} select n.label, count(*) as n, count(distinct e.src) as sources from h_edges e join h_nodes n on n.id = e.dst group by 1")
def k_sql_views(spark, sf_dir):
    tables.hierarchy(spark, sf_dir).as_views("hierarchy_")
    return spark.sql("select n.label, count(*) as n, count(distinct e.src) as sources from hierarchy_edges e join hierarchy_nodes n on n.id = e.dst group by 1")


@table(f"with {H}, p as (select src as id, dst as other from h_edges union select dst, src from h_edges) select id, count(*) as n, min(other) as first from p group by 1")
def a_neighbors(spark, sf_dir):
    return A.neighbors(tables.hierarchy(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first"))


# --- algorithms whose result depends on the order of visits
def _shape(spark, edges: str) -> PropertyGraph:
    """Nodes a, b, ... by name and edges like ab, in the order given."""
    ids = sorted(set(edges) - {" "})
    nodes = spark.createDataFrame([(k, x, "FILE", x) for k, x in enumerate(ids)], "ord long, id string, label string, name string")
    pairs = spark.createDataFrame([(k, e[0], e[1]) for k, e in enumerate(edges.split())], "idx long, src string, dst string")
    return PropertyGraph.of(nodes, pairs)


@literal
def a_louvain_triangles(spark):
    return A.louvain(_shape(spark, "ab bc ca de ef fd cd"))


@literal
def a_clusters_triangles(spark):
    g = _shape(spark, "ab bc ca de ef fd cd")
    found = A.louvain(g)
    return A.rounded(A.clusters(g, found).join(A.modularity(g, found), "community"), "modularity").withColumn("members", F.array_join("members", ","))


@literal
def a_hot_paths_shape(spark):
    """The longest chains, one of which an edge back ends; what a longer one contains is left out."""
    return A.hot_paths(_shape(spark, "ab bc cd db ef fg ag")).withColumn("path", F.array_join("path", ">"))


@literal
def a_cycles_shape(spark):
    return A.cycles(_shape(spark, "ab bc ca cd dc dd ea")).withColumn("path", F.array_join("path", ">"))


@literal
def a_depth_first_shape(spark):
    return A.depth_first_order(_shape(spark, "ab bc ca ed"))


@literal
def a_topo_order_shape(spark):
    return A.topological_order(_shape(spark, "ac bc cd ad be ed"))


@literal
def a_centrality_shape(spark):
    """All measures of a star with one chain."""
    return A.rounded(A.centrality(_shape(spark, "ab ac ad de")), "betweenness", "pagerank", "closeness", "hub", "authority", digits=3).drop("ord")


# --- queries on symbols, and their output
@literal
def q_symbol_in_out(spark):
    g = graph(spark)
    pick = lambda d, df: df.select(F.lit(d).alias("direction"), "src", "dst", "label")
    return pick("in", T.incoming_symbol_edges(g, "lib/store.mjs", "hidden")).unionByName(pick("out", T.outgoing_symbol_edges(g, "a.mjs", "main")))


@literal
def q_all_symbols(spark):
    return T.all_symbols(graph(spark)).select("id", "label", "exported")


@literal
def q_cypher_print(spark):
    from . import cypher

    out, n = text.as_tsv(cypher.run(graph(spark), "MATCH (a)-[:IMPORT]->(b) RETURN a.gid AS a, b.gid AS b ORDER BY a, b"))
    return lines(spark, out).withColumn("of", F.lit(n))


@literal
def q_analyze(spark):
    """The facade: what an analysis counts, and which formats it renders."""
    a = analyzer(spark)
    shown = ",".join(f for f in api.FORMATS if a.render(f).strip())
    n = {name: df.count() for name, df in a.result.tables().items()}
    return spark.createDataFrame([*sorted(n.items())], "part string, n long").withColumn("formats", F.lit(shown))


# --- reports
@literal
def k_report(spark):
    return lines(spark, analyzer(spark).render("text")).filter("k <> 1")  # but for the line of the time


@literal
def k_report_boxes(spark):
    """The lines of the report's boxes."""
    return lines(spark, analyzer(spark, None).render("table")).filter("line rlike '^[┌│├└]'")


@literal
def k_report_json(spark):
    found = json.loads(analyzer(spark).render("json"))
    return spark.createDataFrame([(k, len(v)) for k, v in found.items() if isinstance(v, list)], "part string, n long")


@literal
def k_one_line(spark):
    return lines(spark, analyzer(spark).render("summary"))


@literal
def k_box(spark):
    return lines(spark, text.table([{"a": 1, "b": "x" * 60, "c": [1, 2], "d": 0.12345, "e": None}, {"a": 22, "b": "y", "c": [], "d": 2.0, "e": "z"}]))


@literal
def k_modes(spark):
    """What the modes of the command line print."""
    a = analyzer(spark)
    g = a.result.graph
    rows = text.rows_of(a.context("hidden").orderBy("part", "id", "other"))
    ids = [r["id"] for r in rows if r["part"] == "target"]
    parts = [
        text.impact_text("hidden", text.rows_of(a.impact("hidden"))), text.context_text("hidden", rows, text.rows_of(g.nodes.filter(F.col("id").isin(ids)).orderBy("ord"))), text.context_text("nothing", [], []),
        text.clusters_text(text.rows_of(a.clusters().orderBy(F.desc("size"), "community"))), text.audit_text(text.rows_of(a.result.schema_audit)), a.schema_blocks_text(), text.processes_text(text.rows_of(a.processes()), 0.4), text.map_text(text.rows_of(a.map())),
    ]
    return lines(spark, "\n".join(parts))


@literal
def k_swimlane(spark):
    return lines(spark, diagrams.swimlane_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("a", "zz")], ["a", "b", "c"]))


@literal
def k_swimlane_of_a_graph(spark):
    """Parallel edges and a self-loop have columns of their own."""
    return lines(spark, diagrams.swimlane(_shape(spark, "ab ab bb")))


@literal
def k_dot(spark):
    return lines(spark, diagrams.dot(graph(spark).subgraph(("FILE",), ("IMPORT", "REEXPORT"))))


@literal
def k_mermaid(spark):
    return lines(spark, diagrams.mermaid(graph(spark).subgraph(("FILE",), ("IMPORT", "REEXPORT"))))


@literal
def k_gate(spark):
    return spark.createDataFrame([("without registry", analyzer(spark, None).passes()), ("with registry", analyzer(spark).passes())], "project string, passes boolean")


# --- analyses
@literal
def n_orphan_files(spark):
    f = facts(spark, MORE_FILES)
    return C.orphans(f, build.source_graph(f).edges)


@literal
def n_all_entry_points(spark):
    return C.entry_points(graph(spark)).withColumn("reasons", F.array_join("reasons", ","))


@literal
def n_all_processes(spark):
    return C.process_traces(graph(spark), 0.4).select("entry", "depth", F.array_join("steps", ",").alias("steps"), F.array_join("terminals", ",").alias("terminals"))


@literal
def n_all_advice(spark):
    a = analyzer(spark, None)
    return a.result.advice.select("type", "severity", "file", "message")


@literal
def n_whole_map(spark):
    r = C.architecture_map(facts(spark), graph(spark))
    return r.select("file", "fan_in", "fan_out", *[F.array_join(c, "; ").alias(c) for c in ("exports", "internals", "imports", "calls_out")])


@literal
def n_whole_stats(spark):
    s = analyzer(spark).result.stats.first().asDict()
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in s.items()], "name string, value double")


def _blocks(spark) -> DataFrame:
    return storage.stored(S.schema_blocks(schemas.schema_graph(schemas.schema_documents(texts(spark, SCHEMAS)))), "blocks")


@literal
def n_all_schema_blocks(spark):
    return A.rounded(_blocks(spark), "score").withColumn("members", F.array_join("members", ","))


@literal
def n_schema_file_alignment(spark):
    return S.file_alignment(_blocks(spark)).withColumn("parts", F.array_join("parts", ",")).withColumn("spillover", F.array_join("spillover", ","))


@literal
def n_schema_block_alignment(spark):
    return S.block_alignment(_blocks(spark), (("schema/a", "first"), ("schema/", "second")), "hub.json").withColumn("parts", F.array_join("parts", ",")).withColumn("spillover", F.array_join("spillover", ","))


# --- files and registries
@literal
def s_scan(spark):
    """Files of a folder by a scan, by name, and the root that they give."""
    root = folder(spark, {"b.js": "", "_a.mjs": "x\n", ".hid.js": "", "node_modules/x.js": "", "d/c.js": "é", "d/t.txt": "t", "a[1].js": "y", "d/e/f g.mjs": "z"})
    found = files.collect_files([f"{root}/d/t.txt", root, f"{root}/none"])
    got = files.texts(spark, found, files.infer_root([f"{root}/none", root]))
    return got.withColumn("same_root", F.lit(files.infer_root([f"{root}/b.js"]) == root and files.infer_root([root], f"{root}/d") == f"{root}/d"))


@literal
def s_schema_scan(spark):
    root = folder(spark, {**SCHEMAS, "x.json": '{"a":1}', "y.json": "{", "z.txt": '{"$schema":"x"}'})
    return schemas.schema_texts(spark, root).select("path", F.length("text").alias("n"))


@literal
def s_registries(spark):
    """The registry by each way, in their order of precedence."""
    root = folder(spark, REGISTRY_DOCS)
    out = None
    for way, args in {
        "file": (f"{root}/registry.json", [f"{root}/own.schema.json"]), "hub file": (f"{root}/hub-registry.json", None), "schemas": (None, [f"{root}/own.schema.json"]), "found": (None, None),
    }.items():
        rows, _ = schemas.build_registry(spark, root, *args)
        rows = rows.select(F.lit(way).alias("way"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@literal
def s_entry_points(spark):
    return schemas.entry_point_overrides(texts(spark, REGISTRY_DOCS))


@literal
def s_staleness(spark):
    """A cache that is missing, newer and older than its sources."""
    import time

    root = folder(spark, {"a.js": "x"})
    rows = [("missing", files.is_stale(spark, f"{root}/cache", [f"{root}/a.js"]))]
    time.sleep(1.1)
    spark.range(1).write.parquet(f"{root}/cache")
    rows.append(("newer", files.is_stale(spark, f"{root}/cache", [f"{root}/a.js"])))
    time.sleep(1.1)
    spark.range(1).write.mode("overwrite").parquet(f"{root}/a.js")
    return spark.createDataFrame([*rows, ("older", files.is_stale(spark, f"{root}/cache", [f"{root}/a.js"]))], "cache string, stale boolean")


# --- JSON documents
@literal
def j_loader(spark):
    """References inside a document, by anchor, by escaped names, and into another document."""
    schema = {"$id": "http://x/s", "definitions": {"n~/%": {"type": "integer"}, "t": {"$id": "#t", "type": "string"}}}
    loader = Loader(schema, {"other": {"d": {"const": 1}}})
    rows = [(ref, json.dumps(loader.resolve(ref)[0], sort_keys=True)) for ref in ("#/definitions/n~0~1%25", "#t", "other#/d", "#/definitions/t/type")]
    return spark.createDataFrame(rows, "ref string, found string")


@table("""select event_id, case when cast(json_extract(props, '$.k') as double) > 50 then 1 else 0 end + case when cast(json_extract(props, '$.k') as bigint) % 2 <> 0 then 1 else 0 end as n,
  cast(json_extract(props, '$.k') as double) <= 50 and cast(json_extract(props, '$.k') as bigint) % 2 = 0 as valid from events""")
def j_errors(spark, sf_dir):
    """How many rules each event's properties break."""
    rows = tables.table(spark, sf_dir, "events").select("event_id", "props")
    return validated(rows, "props", {"properties": {"k": {"maximum": 50, "multipleOf": 2}}}).select("event_id", F.size("errors").alias("n"), "valid")


@literal
def j_error_places(spark):
    df = spark.createDataFrame([(1, '{"a":1,"l":[1,"x"]}'), (2, '{"a":"s"}'), (3, None), (4, "{"), (5, '{"l":[1]}')], "id int, j string")
    schema = {"required": ["a"], "properties": {"a": {"type": "integer"}, "l": {"items": {"type": "integer"}}}}
    return validated(df, "j", schema).select("id", "valid", F.explode_outer(F.transform("errors", lambda e: F.substring_index(e, ":", 1))).alias("place"))


@literal
def j_document(spark):
    """Reads with defaults, writes that give a new document, and what both leave alone."""
    schema = {"type": "object", "x-top": 1, "properties": {"a": {"default": 1}, "o": {"default": {}, "properties": {"x": {"default": 2, "x-unit": "m"}}}, "l": {"type": "array", "items": {"properties": {"y": {"default": 3}}}}}}
    d = Document({"l": [{}], "b": None}, schema)
    changed = d.with_value("o", {"x": 9})
    show = lambda v: json.dumps(v, sort_keys=True)
    rows = {
        "get a": d.get("a"), "get l.0.y": d.get("l.0.y"), "get none": d.get("none"), "changed o.x": changed.get("o.x"), "old o": d.get("o"), "value": d.value(), "replaced": d.replaced({"a": 5}).value(), "schema": sorted(d.schema()),
        "contains l": d.contains("l"), "contains a": d.contains("a"), "dict": d.to_dict(), "json": json.loads(d.to_json()), "list contains": Document([1, {"k": 2}], True).contains({"k": 2.0}),
    }
    return spark.createDataFrame([(k, show(v)) for k, v in rows.items()], "what string, value string")


@literal
def j_schema_places(spark):
    v = Validator({"x-a": 1, "properties": {"p": {"x-b": 2, "items": {"x-c": 3}}, "q": {"$ref": "#/definitions/d"}}, "patternProperties": {"^z": {"x-z": 4}}, "definitions": {"d": {"x-d": 5}}})
    rows = [(p, json.dumps(v.extensions_at(p), sort_keys=True)) for p in ("", "p", "p.0", "p.*", "q", "zz", "none")]
    return spark.createDataFrame(rows, "path string, extensions string")


@literal
def j_branches(spark):
    v = Validator({"oneOf": [{"type": "string"}, {"type": "integer"}], "anyOf": [{"minimum": 1}, {"minimum": 5}], "if": {"const": 1}, "then": {"title": "t"}, "else": {"title": "e"}, "not": {"const": 3}})
    rows = [(json.dumps(x), v.one_of_index(x), ",".join(map(str, v.any_of_indices(x))), (v.if_then(x) or {}).get("title"), v.not_of(x)) for x in (1, 3, 6, "s", None)]
    return spark.createDataFrame(rows, "value string, one_of int, any_of string, branch string, not_of boolean")


@literal
def j_all_of(spark):
    whole = Validator({"allOf": [{"required": ["b"], "properties": {"b": {"type": "string"}}}, {"required": ["a", "c"]}], "required": ["a"], "properties": {"a": {}}}).all_of()
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in whole.items()], "key string, value string")


@literal
def j_hub(spark):
    import tempfile

    with tempfile.TemporaryDirectory() as at:  # read at once, by the driver
        with open(f"{at}/hub.json", "w", encoding="utf-8") as f:
            json.dump({"definitions": {"Label": {"enum": ["FILE", "CLASS"]}, "Kind": {"$ref": "kinds.json#/definitions/K"}}}, f)
        with open(f"{at}/kinds.json", "w", encoding="utf-8") as f:
            json.dump({"definitions": {"K": {"enum": ["CALL"]}}}, f)
        hub = Hub(f"{at}/hub.json")
        rows = [(k, ",".join(v["enum"])) for k, v in hub.definitions.items()] + [("by reference", ",".join(hub.enum("#/definitions/Label")))]
    return spark.createDataFrame(rows, "name string, items string")


@literal
def f_numbers(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (1.005,), (2.5,), (-0.5,)], "x double")
    return df.select("x", half_up(F.col("x")).cast("double").alias("whole"), half_up(F.col("x"), 2).cast("double").alias("two"), to_fixed_1(F.col("x")).alias("one"), padded(F.lit("ab"), 4).alias("after_"), padded(F.lit("ab"), 4, True).alias("before_"))


# --- path lengths without an end, lists and conditions of optional matches
def _cypher(name: str, query: str, sql: str) -> None:
    from . import cypher

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cypher.run(tables.hierarchy(spark, sf_dir), query)

    f.__name__, f.__doc__ = name, query
    QUERIES[name], ORACLE_SQL[name] = f, sql


_cypher("c_open_length", "MATCH (o:ORDER {gid: 'O9'})-[*]->(x) RETURN x.gid AS id, count(*) AS n",
        f"with recursive {H}, r(id) as (select 'O9' union all select e.dst from r join h_edges e on e.src = r.id) select id, count(*) as n from r where id <> 'O9' group by 1")
_cypher("c_unwind", "UNWIND ['N1', 'N2', 'N99'] AS k MATCH (n:NATION) WHERE n.gid = k RETURN k, n.name AS name",
        f"with {H} select id as k, name from h_nodes where id in ('N1', 'N2', 'N99')")
_cypher("c_optional_where", "MATCH (n:NATION) OPTIONAL MATCH (s:SUPPLIER)-[:IN_NATION]->(n) WHERE s.name ENDS WITH '1' RETURN n.name AS nation, count(s) AS suppliers",
        f"with {H} select n.name as nation, count(s.id) as suppliers from h_nodes n left join h_edges e on e.dst = n.id and e.src_label = 'SUPPLIER' left join h_nodes s on s.id = e.src and ends_with(s.name, '1') where n.label = 'NATION' group by 1")
