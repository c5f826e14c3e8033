"""Analyses of source graphs: complexity, violations, duplicates, gaps, entry points, traces, statistics and advice."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model, storage
from ..functions.scalars import half_up, to_fixed_1
from ..graph import PropertyGraph, owner
from . import algorithms as A
from .traversal import bfs


# op: N1
def complexity(facts: DataFrame, graph: PropertyGraph, exact_rounding: bool = True) -> DataFrame:
    """file, functions, exports, internals, ratio, calls, classes, fan_in, fan_out, depth, lines of parsed files."""
    inner = F.size(F.filter("functions", lambda f: ~F.coalesce(f.isExported, F.lit(False))))
    rows = facts.select("ord", F.col("path").alias("file"), F.size("functions").alias("functions"), F.size("exports").alias("exports"), inner.alias("internals"), F.size("calls").alias("calls"), F.size("classes").alias("classes"), "lines")
    share = F.col("internals") / F.greatest(F.col("exports"), F.lit(1))
    ratio = F.when(F.col("exports") > 0, to_fixed_1(share) if exact_rounding else F.round(share, 1)).otherwise(F.col("internals").cast("double"))
    deg = graph.degrees().select(F.col("id").alias("file"), F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"))
    deep = A.depths(graph).withColumnRenamed("id", "file")
    out = rows.withColumn("ratio", ratio).join(deg, "file", "left").join(deep, "file", "left")
    return out.na.fill(0, ["fan_in", "fan_out", "depth"]).orderBy("ord").drop("ord")


# op: N2
def violations(graph: PropertyGraph) -> DataFrame:
    """caller, callee, fn, defined_in, called_from, confirmed, reason, cross_file: calls into other files of what is not exported, unless it is a method of an exported class there."""
    calls = graph.edges.filter((F.col("label") == "CALL") & ~(F.coalesce(F.col("attrs.resolved"), F.lit(True)) == F.lit(False))).filter(owner(F.col("src")) != owner(F.col("dst"))).select("idx", "src", "dst")
    callee = graph.nodes.filter("exported = false").select(F.col("id").alias("dst"), F.col("name").alias("fn"), F.col("file").alias("defined_in"))
    methods = graph.nodes.filter("label = 'CLASS' and exported").select(F.col("file").alias("defined_in"), F.explode("attrs.methods").alias("fn")).distinct()
    caller = graph.nodes.select(F.col("id").alias("src"), F.col("file").alias("caller_file"))
    found = calls.join(callee, "dst").join(methods, ["defined_in", "fn"], "left_anti").join(caller, "src", "left")
    return found.orderBy("idx").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "fn", "defined_in", F.coalesce("caller_file", owner(F.col("src"))).alias("called_from"), F.lit(True).alias("confirmed"), F.lit("import_link").alias("reason"), F.lit(True).alias("cross_file"))


# op: N3
def violations_by_name(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """The same from names alone: confirmed where the calling file imports the other, else a collision of names."""
    inner = facts.select(F.col("path").alias("defined_in"), F.explode("functions").alias("f")).filter(~F.col("f.isExported")).select("defined_in", F.col("f.name").alias("fn"))
    calls = facts.select(F.col("path").alias("called_from"), F.explode("calls").alias("fn"))
    links = edges.filter(F.col("label").isin(*model.DEPENDENCIES)).select(F.col("src").alias("called_from"), F.col("dst").alias("defined_in"), F.lit(True).alias("linked")).distinct()
    found = inner.join(calls, "fn").filter("defined_in <> called_from").join(links, ["called_from", "defined_in"], "left")
    linked = F.coalesce("linked", F.lit(False))
    return found.select(F.concat_ws("::", "called_from", "fn").alias("caller"), F.concat_ws("::", "defined_in", "fn").alias("callee"), "fn", "defined_in", "called_from", linked.alias("confirmed"), F.when(linked, "import_link").otherwise("name_collision").alias("reason"), F.lit(True).alias("cross_file"))


# op: N4
def overlay(found: DataFrame, registry: DataFrame) -> DataFrame:
    """violations, of which those to methods that the registry makes public are no longer confirmed."""
    public = registry.select(F.col("file").alias("defined_in"), F.col("method").alias("fn"), F.lit(True).alias("public")).distinct()
    hit = F.coalesce("public", F.lit(False))
    return found.join(public, ["defined_in", "fn"], "left").withColumn("confirmed", F.col("confirmed") & ~hit).withColumn("reason", F.when(hit, "schema_public").otherwise(F.col("reason"))).select(*found.columns)


# op: N5
def duplicate_factories(bindings: DataFrame) -> DataFrame:
    """factory, source_file, callers (sorted) of factories that several files instantiate."""
    made = bindings.filter("kind = 'factory_instance'").groupBy("source_file", F.col("symbol_name").alias("factory")).agg(F.sort_array(F.collect_set("file")).alias("callers"))
    return made.filter(F.size("callers") >= 2).select("factory", "source_file", "callers")


# op: N6
def schema_gaps(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """type, file, symbol, detail: where the registry and the code differ, for files that it has."""
    reg = registry.withColumnRenamed("method", "symbol").withColumn("listed", F.lit(True))
    known = registry.select("file").distinct()
    exports = facts.select(F.col("path").alias("file"), F.explode("exports").alias("e")).filter("e.type <> 'reexport'").select("file", F.col("e.name").alias("symbol")).distinct().join(known, "file", "left_semi").withColumn("exported", F.lit(True))
    fns = facts.select(F.col("path").alias("file"), F.posexplode("functions").alias("k", "f")).groupBy("file", F.col("f.name").alias("symbol")).agg(F.max_by("f.paramCount", "k").alias("params")).join(known, "file", "left_semi").withColumn("defined", F.lit(True))
    every = reg.join(exports, ["file", "symbol"], "full").join(fns, ["file", "symbol"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    row = lambda when, name, detail=None: F.when(when, F.struct(F.lit(name).alias("type"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail")))
    parts = F.array_compact(F.array(
        row(yes("listed") & ~yes("exported"), "stale_in_schema"),
        row(~yes("listed") & yes("exported"), "missing_in_schema"),
        row(yes("listed") & yes("exported") & yes("defined") & ~yes("has_xmethod"), "no_xmethods"),
        row(yes("listed") & yes("has_xmethod") & ~yes("defined") & ~yes("exported"), "stale_xmethod"),
        row(yes("listed") & yes("has_xmethod") & yes("defined") & ~F.col("params").eqNullSafe(F.col("param_count")), "param_mismatch", F.concat(F.lit("schema: "), F.coalesce(F.col("param_count").cast("string"), F.lit("null")), F.lit(", code: "), F.col("params").cast("string"))),
    ))
    return every.select("file", "symbol", F.explode(parts).alias("g")).select("g.type", "file", "symbol", "g.detail")


def validated_gaps(facts: DataFrame, schema: dict) -> DataFrame:
    """type, file, symbol, detail of files whose facts do not satisfy a schema."""
    from ..validate.columns import validated

    rows = facts.select(F.col("path").alias("file"), F.to_json(F.struct(*[c for c in facts.columns if c not in ("ord", "bindings", "edges", "extras")])).alias("json"))
    return validated(rows, "json", schema).filter("not valid").select(F.lit("invalid").alias("type"), "file", F.lit(None).cast("string").alias("symbol"), F.array_join("errors", "; ").alias("detail"))


# op: N8
def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files (path) that no edge touches."""
    ends = edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct()
    return files.select("path").join(ends, "path", "left_anti")


# op: N9
# Names of entry points, their weights and labels. (?i) only where the case does not matter.
ENTRY_NAMES = (
    (r"(^|/)index\.[^/]+$", 0.40, "index"),
    (r"(^|/)main\.[^/]+$", 0.40, "main"),
    (r"(?i)background", 0.35, "background"),
    (r"cli\.[^/]+$", 0.35, "cli"),
    (r"app\.[^/]+$", 0.25, "app"),
    (r"server\.[^/]+$", 0.25, "server"),
)
FAN_IN_WEIGHT, DOMINANT, LONELY = 0.4, 0.1, 0.1


def entry_points(graph: PropertyGraph) -> DataFrame:
    """file, score, reasons, fan_in, fan_out of all nodes, the best first."""
    deg = graph.degrees().select(F.col("id").alias("file"), F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"))
    most = deg.agg(F.greatest(F.max("fan_in"), F.lit(1)).alias("most"))
    weight, name = F.lit(0.0), F.lit(None).cast("string")
    for pattern, w, label in reversed(ENTRY_NAMES):
        hit = F.regexp_like("file", F.lit(pattern))
        weight, name = F.when(hit, w).otherwise(weight), F.when(hit, f"name:{label}").otherwise(name)
    dominant = (F.col("fan_in") > F.col("fan_out")) & (F.col("fan_in") > 0)
    lonely = (F.col("fan_in") == 0) & name.isNull()
    score = weight + F.col("fan_in") / F.col("most") * FAN_IN_WEIGHT + F.when(dominant, DOMINANT).otherwise(0.0)
    score = F.when(lonely, F.greatest(F.lit(0.0), score - LONELY)).otherwise(score)
    reasons = F.array_compact(F.array(name, F.when(F.col("fan_in") > 0, F.concat(F.lit("fan_in:"), F.col("fan_in"))), F.when(dominant, F.lit("fan_in_dominant")), F.when(lonely, F.lit("orphan"))))
    out = deg.crossJoin(F.broadcast(most)).select("file", F.least(F.lit(1.0), half_up(score, 2)).alias("score"), reasons.alias("reasons"), "fan_in", "fan_out")
    return out.join(graph.nodes.select(F.col("id").alias("file"), "ord"), "file").orderBy(F.desc("score"), "ord").drop("ord")


# op: N10
def process_traces(graph: PropertyGraph, threshold: float = 0.4, max_depth: int = 10, entries: DataFrame | None = None) -> DataFrame:
    """entry, steps (in visiting order, with repeats along parallel edges), terminals, depth. A kernel."""
    storage.check_size(graph.nodes, graph.edges, storage.KERNEL_EDGES, "a single-task kernel")
    start = entries.select(F.col("file").alias("id")) if entries is not None else entry_points(graph).filter(F.col("score") >= threshold).select(F.col("file").alias("id"))
    roots = [r.id for r in graph.nodes.join(start.distinct(), "id").orderBy("ord").select("id").collect()]  # entry points of a graph that a kernel takes

    def work(ids, pairs):
        after = defaultdict(list)
        for a, b in pairs:
            after[ids[a]].append(ids[b])
        out = []
        for root in roots:
            seen, steps, ends, front, depth = {root}, [], [], [root], 0
            while front and depth < max_depth:
                ahead = []
                for f in front:
                    fresh = [t for t in after[f] if t not in seen]
                    if not fresh and f != root:
                        ends.append(f)
                    seen.update(fresh)
                    ahead += fresh
                steps += ahead
                front = ahead
                depth += bool(front)
            inside = set(steps)
            ends += [f for f in steps if all(t not in inside or t == f for t in after[f])]
            out.append((root, steps, sorted(set(ends)), depth))
        return out

    # Unknown ends are steps too, so they take part as nodes of their own.
    links = graph.edges.filter("src_label = 'FILE'").select("idx", "src", "dst")
    known = graph.nodes.select("ord", "id").unionByName(graph.phantoms().select(F.lit(2**62).alias("ord"), "id"))
    return storage.kernel(known, links, work, "entry string, steps array<string>, terminals array<string>, depth int")


def process_reach(graph: PropertyGraph, entries: DataFrame, max_depth: int = 10) -> DataFrame:
    """seed, id, depth: the same as a set, distributed over any number of entries."""
    return bfs(graph.edges.filter("src_label = 'FILE'"), entries.select(F.col("file").alias("id")), max_depth).filter("depth > 0")


# op: N16
def fan_in_ranking(graph: PropertyGraph) -> DataFrame:
    """file, fan_in, fan_out over dependencies between files, the most used first."""
    g = graph.subgraph(None, model.DEPENDENCIES)
    return g.degrees().join(graph.file_nodes().select("id", "ord"), "id").orderBy(F.desc("in_degree"), "ord").select(F.col("id").alias("file"), F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"))


# op: N7
def stats(facts: DataFrame, graph: PropertyGraph, cycles: DataFrame, found: DataFrame, hot: DataFrame, table: DataFrame, clusters: DataFrame, central: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row of project statistics."""
    one = lambda df, **k: df.agg(*[v.alias(n) for n, v in k.items()])
    n = F.count(F.lit(1))
    calls = graph.edges.filter("label = 'CALL'")
    rows = [
        one(facts, total_files=n), one(graph.edges, total_edges=n), one(found, confirmed_violations=F.count_if("confirmed"), false_positives=F.count_if(~F.col("confirmed")), boundary_violations=F.count_if("cross_file")),
        one(orphans(facts, graph.edges), orphan_nodes=n), one(table, complex_files=n, max_fan_in=F.coalesce(F.max("fan_in"), F.lit(0)), max_fan_out=F.coalesce(F.max("fan_out"), F.lit(0))),
        one(cycles, cycles=n), one(hot, longest_path=F.coalesce(F.max("length"), F.lit(0))), one(A.depths(graph), max_depth=F.coalesce(F.max("depth"), F.lit(0))), one(duplicates, duplicate_instantiations=n),
        one(clusters, num_clusters=n, modularity=F.coalesce(F.avg("modularity"), F.lit(0.0)) if "modularity" in clusters.columns else F.lit(0.0)),
        one(central, max_betweenness=F.coalesce(F.max("betweenness"), F.lit(0.0)), avg_betweenness=F.coalesce(F.avg("betweenness"), F.lit(0.0)), max_pagerank=F.coalesce(F.max("pagerank"), F.lit(0.0))),
        one(A.clustering_coefficients(graph), avg_clustering_coefficient=F.coalesce(F.avg("coefficient"), F.lit(0.0))),
        one(graph.symbol_nodes(), total_symbols=n), one(calls, total_call_edges=n, cross_file_calls=F.count_if(owner(F.col("src")) != owner(F.col("dst")))), one(graph.edges.filter("label = 'CONTAINS'"), total_contains_edges=n),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(F.broadcast(r))  # one row each
    return out


# op: N11
def advice(facts: DataFrame, edges: DataFrame, cycles: DataFrame, found: DataFrame, hot: DataFrame, table: DataFrame, clusters: DataFrame, central: DataFrame, gaps: DataFrame | None, duplicates: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """type, severity, file, message, detail: one rule each, by severity, then rule and place."""
    t = {**model.ADVICE, **(thresholds or {})}
    none = F.lit(None).cast("string")

    def rule(df: DataFrame, rank: Column, order: Column, kind: str, severity: str, file: Column, message: Column, detail: Column = none) -> DataFrame:
        return df.select(rank.cast("int").alias("rank"), order.cast("string").alias("at"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), file.alias("file"), message.alias("message"), detail.alias("detail"))

    msg = lambda text, *cols: F.format_string(text, *cols)
    where = table.join(facts.select(F.col("path").alias("file"), "ord"), "file", "left")
    at = F.lpad(F.col("ord").cast("string"), 18, "0")

    def per_file(k: int, cond: Column, kind: str, severity: str, message: Column) -> DataFrame:
        return rule(where.filter(cond), F.lit(3), F.concat(at, F.lit(f".{k}")), kind, severity, F.col("file"), message)

    c = F.col
    both = c("fan_in") + c("fan_out")
    parts = [
        rule(found.filter("confirmed"), F.lit(1), c("caller"), "violation", "error", c("defined_in"), msg("%s is not exported, but %s calls it: export it, or change the caller.", c("fn"), c("called_from"))),
        rule(cycles, F.lit(2), F.lpad(c("k").cast("string"), 12, "0"), "cycle", "error", c("path")[0], F.concat(F.lit("Cycle: "), F.array_join(F.concat("path", F.slice("path", 1, 1)), " → "))),
        per_file(0, c("functions") > t["functions"], "complexity", "warning", msg("%d functions, more than %d; %d exported, %d internal.", c("functions"), F.lit(t["functions"]), c("exports"), c("internals"))),
        per_file(1, c("exports") > t["exports"], "complexity", "warning", msg("%d exports, more than %d: a wide interface.", c("exports"), F.lit(t["exports"]))),
        per_file(2, c("ratio") > t["ratio"], "complexity", "warning", msg("%s internal functions for each export, more than %d.", c("ratio").cast("string"), F.lit(t["ratio"]))),
        per_file(3, c("calls") > t["calls"], "complexity", "warning", msg("%d distinct calls, more than %d.", c("calls"), F.lit(t["calls"]))),
        per_file(4, c("fan_out") > t["fan_out"], "coupling", "warning", msg("fan-out %d, more than %d.", c("fan_out"), F.lit(t["fan_out"]))),
        per_file(5, c("fan_in") > t["fan_in"], "coupling", "info", msg("fan-in %d, more than %d: many depend on it.", c("fan_in"), F.lit(t["fan_in"]))),
        per_file(6, both > t["coupling_degree"], "coupling", "warning", msg("degree %d, more than %d.", both, F.lit(t["coupling_degree"]))),
        rule(A.bottlenecks(central), F.lit(10), F.lpad((F.lit(10**9) - c("betweenness") * 10**8).cast("long").cast("string"), 12, "0"), "bottleneck", "warning", c("file"), F.concat(F.lit("Bottleneck of dependencies, betweenness "), F.format_number("betweenness", 2))),
        rule(clusters.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("modularity"), F.lit(0.0)).alias("m") if "modularity" in clusters.columns else F.lit(0.0).alias("m")).filter((c("n") > 0) & (c("m") < t["modularity"])), F.lit(11), none, "poor_separation", "info", F.lit("project"), F.concat(F.lit("Clusters are poorly separated, modularity "), F.format_number("m", 2))),
        rule(facts.join(orphans(facts, edges), "path", "left_semi"), F.lit(12), at, "orphan", "warning", c("path"), F.lit("No edge touches this file."), F.when(F.size("exports") > 0, F.concat(F.lit("exports: "), F.array_join(F.transform("exports", lambda e: e["name"]), ", ")))),
        rule(hot, F.lit(13), c("rank"), "hot_path", "info", c("path")[0], F.concat(F.lit("Chain of "), c("length").cast("string"), F.lit(": "), F.array_join("path", " → "))),
        rule(duplicates, F.lit(14), F.concat_ws("|", "source_file", "factory"), "duplicate_instantiation", "warning", c("source_file"), msg("%s is instantiated in %d files.", c("factory"), F.size("callers")), F.array_join("callers", ", ")),
    ]
    if gaps is not None:
        missing = c("type") == "missing_in_schema"
        place = F.concat_ws("|", "file", "type", "symbol")
        parts.append(rule(gaps.filter(missing), F.lit(15), place, "schema_gap", "warning", c("file"), msg("%s is exported, but the schema lacks it.", c("symbol")), c("detail")))
        parts.append(rule(gaps.filter(~missing), F.lit(15), place, "schema_stale", "warning", c("file"), msg("%s differs between schema and code.", c("symbol")), F.coalesce("detail", "type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    severity = F.when(c("severity") == "error", 0).when(c("severity") == "warning", 1).otherwise(2)
    return out.orderBy(severity, "rank", "at").select("type", "severity", "file", "message", "detail")


def architecture_map(facts: DataFrame, graph: PropertyGraph) -> DataFrame:
    """file, fan_in, fan_out, exports (with signatures), internals, imports, calls_out."""
    symbols = graph.nodes.filter("label in ('FUNCTION', 'CLASS')").groupBy("file").agg(
        F.sort_array(F.collect_list(F.when(F.col("exported"), F.concat(F.coalesce("attrs.signature", "name"), F.coalesce(F.concat(F.lit(" — "), F.col("attrs.jsdoc")), F.lit("")))))).alias("exports"),
        F.sort_array(F.collect_list(F.when(~F.col("exported"), F.col("name")))).alias("internals"),
    )
    imports = facts.select(F.col("path").alias("file"), F.sort_array(F.array_distinct(F.transform("imports", lambda i: i.source))).alias("imports"))
    calls = graph.edges.filter("label = 'CALL'").filter(owner(F.col("src")) != owner(F.col("dst"))).groupBy(owner(F.col("src")).alias("file")).agg(F.sort_array(F.collect_set("dst")).alias("calls_out"))
    return fan_in_ranking(graph).join(symbols, "file", "left").join(imports, "file", "left").join(calls, "file", "left").orderBy(F.desc("fan_in"), "file")
