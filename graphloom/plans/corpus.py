"""A small literal project and schemas for the registered queries that work on sources, and queries over JSON values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frontend import build
from ..frontend.enrich import params_of
from ..frontend.extract import extract
from ..functions.scalars import normalised
from ..graph import PropertyGraph
from ..operators import algorithms as A
from ..operators import code_analysis as C
from ..operators import schema_analysis as S
from ..operators import traversal as T
from ..sources import schemas, tables
from ..validate.columns import projected, validated, variants, with_defaults

FILES = {
    "a.mjs": "import { createStore, helper as h } from './lib/store.mjs'\nimport def from './b.mjs'\nimport * as ns from './lib/index.mjs'\nimport { z } from './missing.mjs'\nexport function main(x, y = 1) {\n  const s = createStore()\n  s.save(x)\n  h(y)\n  ns.util()\n  if (x && y) return def(x)\n  return s\n}\n",
    "b.mjs": "import { hidden, createStore } from './lib/store.mjs'\nimport { main } from './a.mjs'\nconst t = createStore()\nexport default function run() { hidden(1); return main }\n",
    "lib/index.mjs": "export { helper as util } from './store.mjs'\nexport class Base { go() { return 1 } }\nexport class Kid extends Base { stop() {} }\n",
    "lib/store.mjs": "export function createStore() {\n  return { save, load }\n}\nfunction save(v) { return hidden(v) }\nfunction load() { return null }\nfunction hidden(v) { return v }\nexport const helper = (q) => q ? 1 : 0\n",
}
SCHEMAS = {
    "hub.json": '{"$schema":"x","definitions":{"Root":{"properties":{"a":{"$ref":"schema/a.json#/definitions/A"},"bs":{"type":"array","items":{"$ref":"schema/b.json#/definitions/B"}}}}}}',
    "schema/a.json": '{"definitions":{"A":{"type":"object","properties":{"b":{"$ref":"b.json#/definitions/B"}},"required":["b"]},"Dead":{"type":"string"}}}',
    "schema/b.json": '{"definitions":{"B":{"oneOf":[{"$ref":"a.json#/definitions/A"},{"$ref":"#/definitions/Gone"}]},"Dead":{"type":"null"}}}',
}
REGISTRY = [("lib/store.mjs", "hidden", True, 2), ("lib/store.mjs", "createStore", False, None), ("a.mjs", "gone", True, 1)]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def texts(spark: SparkSession, of: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(of.items())], "ord long, path string, text string")


class Project:
    """The literal project, parsed."""

    def __init__(self, spark: SparkSession):
        self.facts = build.parse_files(texts(spark, FILES))
        self.graph = build.source_graph(self.facts).indexed()
        self.registry = spark.createDataFrame(REGISTRY, "file string, method string, has_xmethod boolean, param_count int")


_projects: dict[str, Project] = {}


def project(spark: SparkSession) -> Project:
    """The project, parsed once in an application; its tables are stored."""
    key = spark.sparkContext.applicationId
    if key not in _projects:
        _projects[key] = Project(spark)
    return _projects[key]


def code(sql: str | None = None):
    """Registers a query over the literal project."""

    def add(f):
        def q(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(project(spark))

        q.__name__, q.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = q
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(names: str, *rows: tuple) -> str:
    lit = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v).lower()
    quoted = ", ".join(f'"{n.strip()}"' for n in names.split(","))
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({quoted})"


@code(values("file, name, alias, source", ("a.mjs", "createStore", "createStore", "./lib/store.mjs"), ("a.mjs", "helper", "h", "./lib/store.mjs"), ("a.mjs", "default", "def", "./b.mjs"), ("a.mjs", "*", "ns", "./lib/index.mjs"), ("a.mjs", "z", "z", "./missing.mjs"), ("b.mjs", "hidden", "hidden", "./lib/store.mjs"), ("b.mjs", "createStore", "createStore", "./lib/store.mjs"), ("b.mjs", "main", "main", "./a.mjs")))
def e_facts_imports(p: Project) -> DataFrame:
    return p.facts.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.name", "i.alias", "i.source")


@code(values("file, name, type", ("a.mjs", "main", "function"), ("b.mjs", "run", "function"), ("lib/index.mjs", "util", "reexport"), ("lib/index.mjs", "Base", "class"), ("lib/index.mjs", "Kid", "class"), ("lib/store.mjs", "createStore", "function"), ("lib/store.mjs", "helper", "const")))
def e_facts_exports(p: Project) -> DataFrame:
    return p.facts.select(F.col("path").alias("file"), F.explode("exports").alias("e")).select("file", "e.name", "e.type")


@code(values("file, name, exported, lines, complexity, calls", ("a.mjs", "main", True, 8, 3, 5), ("b.mjs", "run", True, 1, 1, 1), ("lib/index.mjs", "go", False, 1, 1, 0), ("lib/index.mjs", "stop", False, 1, 1, 0), ("lib/store.mjs", "createStore", True, 3, 1, 0), ("lib/store.mjs", "save", True, 1, 1, 1), ("lib/store.mjs", "load", True, 1, 1, 0), ("lib/store.mjs", "hidden", False, 1, 1, 0), ("lib/store.mjs", "helper", True, 1, 2, 0)))
def e_facts_functions(p: Project) -> DataFrame:
    return p.facts.select(F.col("path").alias("file"), F.explode("functions").alias("f")).select("file", "f.name", F.col("f.isExported").alias("exported"), "f.lines", "f.complexity", "f.calls")


@code(values("file, local, source_file, symbol_name, kind", ("a.mjs", "createStore", "lib/store.mjs", "createStore", "import"), ("a.mjs", "h", "lib/store.mjs", "helper", "import"), ("a.mjs", "def", "b.mjs", "default", "import"), ("a.mjs", "ns", "lib/index.mjs", "*", "import"), ("a.mjs", "s", "lib/store.mjs", "createStore", "factory_instance"), ("b.mjs", "hidden", "lib/store.mjs", "hidden", "import"), ("b.mjs", "createStore", "lib/store.mjs", "createStore", "import"), ("b.mjs", "main", "a.mjs", "main", "import"), ("b.mjs", "t", "lib/store.mjs", "createStore", "factory_instance")))
def e_facts_bindings(p: Project) -> DataFrame:
    return p.graph.bindings


@code(values("src, dst", ("a.mjs", "lib/store.mjs::save"), ("a.mjs", "lib/index.mjs::util"), ("a.mjs::main", "lib/store.mjs::createStore"), ("a.mjs::main", "lib/store.mjs::helper"), ("a.mjs::main", "b.mjs::default"), ("b.mjs", "lib/store.mjs::createStore"), ("b.mjs::run", "lib/store.mjs::hidden")))
def e_facts_calls(p: Project) -> DataFrame:
    return p.graph.edges.filter("label = 'CALL'").select("src", "dst")


@code(values("label, n", ("IMPORT", 6), ("CALL", 7), ("CONTAINS", 11), ("METHOD_OF", 2), ("REEXPORT", 1)))
def e_edges_by_label(p: Project) -> DataFrame:
    return p.graph.edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@code(values("id", ("./missing.mjs",), ("lib/index.mjs::util",), ("b.mjs::default",)))
def e_phantoms(p: Project) -> DataFrame:
    return p.graph.phantoms()


@code(values("id, signature", ("a.mjs::main", "main(x, y)"), ("b.mjs::run", "run()"), ("lib/index.mjs::go", "go()"), ("lib/index.mjs::stop", "stop()"), ("lib/store.mjs::createStore", "createStore()"), ("lib/store.mjs::save", "save(v)"), ("lib/store.mjs::load", "load()"), ("lib/store.mjs::hidden", "hidden(v)"), ("lib/store.mjs::helper", "helper(q)")))
def e_signatures(p: Project) -> DataFrame:
    return p.graph.nodes.filter("label = 'FUNCTION'").select("id", "attrs.signature")


@code(values("file, functions, exports, internals, calls, fan_in, fan_out", ("a.mjs", 1, 1, 0, 5, 1, 7), ("b.mjs", 1, 1, 0, 2, 1, 4), ("lib/index.mjs", 2, 3, 2, 0, 1, 5), ("lib/store.mjs", 5, 2, 1, 1, 3, 5)))
def n_complexity(p: Project) -> DataFrame:
    return C.complexity(p.facts, p.graph).select("file", "functions", "exports", "internals", "calls", "fan_in", "fan_out")


@code(values("fn, defined_in, called_from, confirmed, reason", ("hidden", "lib/store.mjs", "b.mjs", True, "import_link")))
def n_violations(p: Project) -> DataFrame:
    return C.violations(p.graph).select("fn", "defined_in", "called_from", "confirmed", "reason")


@code(values("fn, defined_in, called_from, confirmed, reason", ("hidden", "lib/store.mjs", "b.mjs", True, "import_link")))
def n_violations_legacy(p: Project) -> DataFrame:
    return C.violations_by_name(p.facts, p.graph.edges).select("fn", "defined_in", "called_from", "confirmed", "reason")


@code(values("fn, defined_in, called_from, confirmed, reason", ("hidden", "lib/store.mjs", "b.mjs", False, "schema_public")))
def n_overlay(p: Project) -> DataFrame:
    return C.overlay(C.violations(p.graph), p.registry).select("fn", "defined_in", "called_from", "confirmed", "reason")


@code(values("factory, source_file, callers", ("createStore", "lib/store.mjs", "a.mjs,b.mjs")))
def n_duplicates(p: Project) -> DataFrame:
    return C.duplicate_factories(p.graph.bindings).withColumn("callers", F.array_join("callers", ","))


@code(values("type, file, symbol, detail", ("stale_in_schema", "a.mjs", "gone", None), ("stale_xmethod", "a.mjs", "gone", None), ("missing_in_schema", "a.mjs", "main", None), ("no_xmethods", "lib/store.mjs", "createStore", None), ("missing_in_schema", "lib/store.mjs", "helper", None), ("stale_in_schema", "lib/store.mjs", "hidden", None), ("param_mismatch", "lib/store.mjs", "hidden", "schema: 2, code: 1")))
def n_gaps(p: Project) -> DataFrame:
    return C.schema_gaps(p.facts, p.registry)


@code(values("path", ("a.mjs>b.mjs",)))
def n_cycles(p: Project) -> DataFrame:
    return A.cycles(p.graph).select(F.array_join("path", ">").alias("path"))


@code(values("id, depth", ("b.mjs::run", 1), ("lib/store.mjs", 1), ("a.mjs", 2), ("b.mjs", 2), ("lib/index.mjs", 2)))
def q_impact_symbol(p: Project) -> DataFrame:
    return T.impact(p.graph, "hidden").select("id", "depth")


@code(values("id", ("lib/store.mjs::hidden",)))
def q_symbol_at(p: Project) -> DataFrame:
    return T.symbol_at(p.graph, "lib/store.mjs", "hidden").select("id")


@code()
def a_centrality(p: Project) -> DataFrame:
    return A.centrality(p.graph)


def _schema_graph(spark: SparkSession) -> PropertyGraph:
    return schemas.schema_graph(schemas.schema_documents(texts(spark, SCHEMAS)))


def n_schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.schema_audit(_schema_graph(spark))


# --- page scripts
def e_script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the pages' inline scripts, by parsing each script."""
    import pandas as pd

    scripts = tables.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<script>([^\n]*?)</script>"), F.lit(1))).alias("js"))

    def run(batches):
        for batch in batches:
            rows = [(p, c) for p, js in zip(batch.page_id, batch.js, strict=True) for c in extract("page.js", js, {}, {})["calls"]]
            yield pd.DataFrame(rows, columns=["page_id", "callee"])

    return scripts.mapInPandas(run, "page_id long, callee string")


def e_params_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b, ",".join(params_of(b))) for b in ("function f(a, b = 1) {}", "async (x, {y}) => {}", "const g = z => z", "function h() {}")]
    return spark.createDataFrame(rows, "body string, params string")


def s_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution of specifiers from files."""
    index = build.path_index(texts(spark, FILES).select("ord", "path"))
    asked = spark.createDataFrame([("a.mjs", "./lib/store.mjs"), ("a.mjs", "./lib"), ("lib/index.mjs", "../a"), ("lib/index.mjs", "./store"), ("a.mjs", "react"), ("a.mjs", "./x")], "path string, source string")
    return build.resolve_imports(asked, index).select("path", "source", "target")


def f_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("a/./b",), ("a/../b",), ("../a",), ("a//b/..",)], "p string")
    return df.select("p", normalised(F.col("p")).alias("plain"), normalised(F.col("p"), True).alias("kept"))


# --- JSON values
def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", "props")


_K = "cast(json_extract(props, '$.k') as double)"


def _validate(name: str, schema: dict, condition: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return validated(_props(spark, sf_dir), "props", schema).select("event_id", "valid")

    f.__name__ = name
    QUERIES[name] = f
    ORACLE_SQL[name] = f"select event_id, {condition} as valid from events"


def _k(rule: dict) -> dict:
    return {"type": "object", "properties": {"k": rule}}


_validate("j_validate_type", _k({"type": "integer"}), f"{_K} = floor({_K})")
_validate("j_validate_enum", _k({"enum": [1, 2, 3]}), f"{_K} in (1, 2, 3)")
_validate("j_validate_numeric", _k({"minimum": 10, "exclusiveMaximum": 50, "multipleOf": 2}), f"{_K} >= 10 and {_K} < 50 and {_K} % 2 = 0")
_validate("j_validate_object", {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {}}, "maxProperties": 1}, "json_keys(props) = ['k']")
_validate("j_validate_combinators", _k({"oneOf": [{"minimum": 20}, {"maximum": 60}], "not": {"const": 7}}), f"(({_K} >= 20) <> ({_K} <= 60)) and {_K} <> 7")
_validate("j_validate_if", _k({"if": {"minimum": 50}, "then": {"multipleOf": 5}, "else": {"multipleOf": 3}}), f"case when {_K} >= 50 then {_K} % 5 = 0 else {_K} % 3 = 0 end")


def j_validate_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("s"))).alias("j"))
    return validated(df, "j", {"properties": {"s": {"type": "string", "minLength": 9, "pattern": "^[A-M]"}}}).select("c_custkey", "valid")


def j_validate_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list("l_linenumber"))).alias("j"))
    return validated(df, "j", {"type": "array", "minItems": 2, "maxItems": 5, "uniqueItems": True, "contains": {"const": 2}, "items": {"maximum": 4}}).select("l_orderkey", "valid")


def j_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defaults(_props(spark, sf_dir), "props", {"properties": {"k": {"default": 0}, "unit": {"default": "x"}}}).select("event_id", F.get_json_object("completed", "$.k").alias("k"), F.get_json_object("completed", "$.unit").alias("unit"))


def j_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(_props(spark, sf_dir), "props", _k({"maximum": 50})).select("event_id", F.get_json_object("projected", "$.k").cast("double").alias("k"))


def j_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"oneOf": [_k({"maximum": 30}), _k({"minimum": 31, "maximum": 60})], "anyOf": [_k({"minimum": 10}), _k({"multipleOf": 2})]}
    return variants(_props(spark, sf_dir), "props", schema).select("event_id", "one_of", F.array_join(F.col("any_of").cast("array<string>"), ",").alias("any_of"))


for _f in (n_schema_audit, e_script_calls, e_params_regex, s_paths, f_normalised, j_validate_string, j_validate_array, j_defaults, j_project, j_variants):
    QUERIES[_f.__name__] = _f

ORACLE_SQL |= {
    "n_schema_audit": values("kind, item, detail", ("total", "definitions", "5"), ("total", "refs", "5"), ("total", "properties", "3"), ("dead_definition", "schema::hub.json#Root", None), ("dead_definition", "schema::schema/a.json#Dead", None), ("dead_definition", "schema::schema/b.json#Dead", None), ("broken_ref", "schema::schema/b.json#B", "schema::schema/b.json#Gone"), ("ref_cycle", "schema::schema/a.json#A -> schema::schema/b.json#B", "true"), ("duplicate_name", "Dead", "2"), ("orphan_file", "hub.json", None)),
    "e_script_calls": "select page_id, 'track' as callee from (select page_id, unnest(regexp_extract_all(html, '<script>([^\\n]*?)</script>', 1)) as js from pages) where contains(js, 'track(')",
    "e_params_regex": values("body, params", ("function f(a, b = 1) {}", "a,b"), ("async (x, {y}) => {}", "x,..."), ("const g = z => z", "z"), ("function h() {}", "")),
    "s_paths": values("path, source, target", ("a.mjs", "./lib/store.mjs", "lib/store.mjs"), ("a.mjs", "./lib", "lib/index.mjs"), ("lib/index.mjs", "../a", "a.mjs"), ("lib/index.mjs", "./store", "lib/store.mjs"), ("a.mjs", "react", None), ("a.mjs", "./x", None)),
    "f_normalised": values("p, plain, kept", ("a/./b", "a/b", "a/b"), ("a/../b", "b", "b"), ("../a", "a", "../a"), ("a//b/..", "a", "a")),
    "j_validate_string": "select c_custkey, length(c_mktsegment) >= 9 and regexp_matches(c_mktsegment, '^[A-M]') as valid from customer",
    "j_validate_array": "select l_orderkey, n between 2 and 5 and u = n and has2 and m <= 4 as valid from (select l_orderkey, count(*) as n, count(distinct l_linenumber) as u, bool_or(l_linenumber = 2) as has2, max(l_linenumber) as m from lineitem group by 1)",
    "j_defaults": "select event_id, coalesce(json_extract_string(props, '$.k'), '0') as k, coalesce(json_extract_string(props, '$.unit'), 'x') as unit from events",
    "j_project": f"select event_id, case when {_K} <= 50 then {_K} end as k from events",
    "j_variants": f"select event_id, case when {_K} <= 30 then 0 when {_K} between 31 and 60 then 1 end as one_of, concat_ws(',', case when {_K} >= 10 then '0' end, case when {_K} % 2 = 0 then '1' end) as any_of from events",
}
