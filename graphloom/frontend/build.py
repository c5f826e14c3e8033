"""From source texts to the property graph.

Two narrow passes parse the files in tasks: the first gives import specifiers, which a join with the path index
resolves; the second extracts facts with each file's own resolved imports. Everything between files is a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model, storage
from ..functions.scalars import normalised
from ..graph import PropertyGraph
from .enrich import enriched
from .extract import extract, specifiers

_EDGE = f"k int, src string, dst string, label string, src_label string, dst_label string, resolved boolean, line int, symbols {model.SYMBOLS}"
FACTS = model.FILES + ", bindings array<struct<local:string,source_file:string,symbol_name:string,kind:string>>, edges array<struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in _EDGE.split(", ")) + ">>, extras array<struct<name:string,body:string,params:array<string>,jsdoc:string,returns:string,signature:string>>"


# op: G11
def path_index(paths: DataFrame) -> DataFrame:
    """key, target of paths (ord, path): the path itself, without its extension, and the directory of an index file; exact paths win, then the first file."""
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    folder = F.when(F.regexp_like(bare, F.lit(r"(^|/)index$")), F.regexp_replace(bare, "/?index$", ""))
    keys = F.array(F.struct(F.col("path").alias("key"), F.lit(0).alias("prio")), F.struct(bare.alias("key"), F.lit(1).alias("prio")), F.struct(folder.alias("key"), F.lit(1).alias("prio")))
    each = paths.select("ord", "path", F.explode(keys).alias("e")).filter("e.key is not null")
    return each.groupBy(F.col("e.key").alias("key")).agg(F.min_by("path", F.struct("e.prio", "ord")).alias("target"))


def specifier_key(path: Column, source: Column) -> Column:
    """The path that a relative specifier means, seen from a file; null for packages."""
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "/")).otherwise("")
    return F.when(F.startswith(source, F.lit(".")), normalised(F.concat(folder, source)))


# op: G12
def resolve_imports(sources: DataFrame, index: DataFrame) -> DataFrame:
    """sources (path, source) with target, null where no file of the project is meant."""
    return sources.withColumn("key", specifier_key(F.col("path"), F.col("source"))).join(index, "key", "left").drop("key")


def parse_files(texts: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """FACTS of source texts (ord, path, text)."""

    def sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, s) for p, t in zip(batch.path, batch.text, strict=True) for s in specifiers(t)[0]]
            yield pd.DataFrame(rows, columns=["path", "source"])

    found = texts.select("path", "text").mapInPandas(sources, "path string, source string")
    targets = resolve_imports(found, path_index(texts.select("ord", "path"))).filter("target is not null")
    own = targets.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("resolved"), F.collect_set("target").alias("targets"))
    rows = texts.join(own, "path", "left")
    if registry is None:
        rows = rows.withColumn("public", F.lit(None).cast("map<string,array<string>>"))
    else:
        methods = registry.groupBy("file").agg(F.collect_set("method").alias("methods"))
        seen = own.select("path", F.explode("targets").alias("file")).join(methods, "file").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("file", "methods"))).alias("public"))
        rows = rows.join(seen, "path", "left")

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text, resolved, public in zip(batch.path, batch.text, batch.resolved, batch.public, strict=True):
                f = extract(path, text, dict(json.loads(resolved)), json.loads(public))
                lines = text.split("\n")
                f["extras"] = [{"name": x["name"], **enriched(x["name"], x["loc"]["start"], x["loc"]["end"], lines)} for x in f["functions"]]
                out.append(json.dumps(f))
            yield pd.DataFrame({"ord": batch.ord, "path": batch.path, "facts": out})

    as_text = rows.select("ord", "path", "text", F.coalesce(F.to_json("resolved"), F.lit("{}")).alias("resolved"), F.coalesce(F.to_json("public"), F.lit("{}")).alias("public"))
    made = as_text.mapInPandas(facts, "ord long, path string, facts string")
    inner = FACTS.replace("ord long, path string, ", "", 1)
    return storage.stored(made.select("ord", "path", F.from_json("facts", inner).alias("f")).select("ord", "path", "f.*"), "facts")


# op: E19
def source_graph(facts: DataFrame) -> PropertyGraph:
    """Nodes, edges and bindings of parsed files. Where nodes share an id, the first gives the position and the last the values."""
    good = facts.filter("error is null")
    none, no_bool = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    attrs = lambda **k: F.from_json(F.to_json(F.struct(*[v.alias(n) for n, v in k.items()])), model.NODE_ATTRS)
    files = good.select(
        F.col("ord").alias("f"), F.lit(0).alias("g"), F.lit(0).alias("k"), F.lit(0).alias("m"), F.col("path").alias("id"), F.lit("FILE").alias("label"), F.col("path").alias("name"), F.col("path").alias("file"), none.alias("parent"), F.lit(False).alias("exported"),
        F.named_struct(F.lit("start"), F.lit(1), F.lit("end"), F.col("lines"), F.lit("line"), F.lit(None).cast("int")).alias("loc"), attrs(lines=F.col("lines")).alias("attrs"),
    )
    fn = good.select("ord", "path", F.posexplode(F.arrays_zip("functions", "extras")).alias("k", "z")).select("ord", "path", "k", F.col("z.functions").alias("x"), F.col("z.extras").alias("e"))
    functions = fn.select(
        F.col("ord").alias("f"), F.lit(1).alias("g"), "k", F.lit(0).alias("m"), F.concat("path", F.lit("::"), "x.name").alias("id"), F.lit("FUNCTION").alias("label"), F.col("x.name").alias("name"), F.col("path").alias("file"), F.col("path").alias("parent"), F.col("x.isExported").alias("exported"),
        F.named_struct(F.lit("start"), F.col("x.loc.start"), F.lit("end"), F.col("x.loc.end"), F.lit("line"), F.lit(None).cast("int")).alias("loc"),
        attrs(**{"async": F.col("x.isAsync"), "arrow": F.col("x.isArrow")}, lines=F.col("x.lines"), complexity=F.col("x.complexity"), paramCount=F.col("x.paramCount"), params=F.col("e.params"), returns=F.col("e.returns"), jsdoc=F.col("e.jsdoc"), signature=F.col("e.signature"), body=F.col("e.body")).alias("attrs"),
    )
    cl = good.select("ord", "path", F.posexplode("classes").alias("k", "x"))
    at = F.concat("path", F.lit("::"), "x.name")
    loc = F.lit(None).cast(model.LOC).alias("loc")
    classes = cl.select(F.col("ord").alias("f"), F.lit(2).alias("g"), "k", F.lit(-1).alias("m"), at.alias("id"), F.lit("CLASS").alias("label"), F.col("x.name").alias("name"), F.col("path").alias("file"), F.col("path").alias("parent"), F.col("x.isExported").alias("exported"), loc, attrs(superClass=F.col("x.extends"), methods=F.col("x.methods")).alias("attrs"))
    members = cl.select("ord", "path", "k", "x", F.posexplode("x.methods").alias("m", "method"))
    methods = members.select(F.col("ord").alias("f"), F.lit(2).alias("g"), "k", "m", F.concat(at, F.lit("."), "method").alias("id"), F.lit("METHOD").alias("label"), F.col("method").alias("name"), F.col("path").alias("file"), at.alias("parent"), F.col("x.isExported").alias("exported"), loc, F.from_json(none, model.NODE_ATTRS).alias("attrs"))
    every = storage.with_ordinals(files.unionByName(functions).unionByName(classes).unionByName(methods), "ord", "f", "g", "k", "m")
    nodes = PropertyGraph.of(every.limit(0), facts.sparkSession.createDataFrame([], model.EDGES)).add_nodes(every.withColumn("full_name", F.col("id"))).nodes
    # A scoped call's end is labelled by the node it means if that file came first, or is the same; else it counts as a function.
    raw = good.select("ord", F.explode("edges").alias("e")).select("ord", "e.*")
    seen = nodes.select(F.col("id").alias("dst"), F.col("label").alias("known"), F.col("file").alias("to_file")).join(facts.select(F.col("path").alias("to_file"), F.col("ord").alias("to_ord")), "to_file")
    labelled = raw.join(seen, "dst", "left").withColumn("dst_label", F.coalesce("dst_label", F.when(F.col("to_ord") <= F.col("ord"), F.col("known")), F.lit("FUNCTION")))
    edges = labelled.withColumn("loc", F.named_struct(F.lit("start"), F.lit(None).cast("int"), F.lit("end"), F.lit(None).cast("int"), F.lit("line"), F.col("line"))).withColumn("attrs", F.struct("resolved", no_bool.alias("dynamic"), F.lit(None).cast("double").alias("weight"), "symbols"))
    bindings = good.select(F.col("path").alias("file"), F.explode("bindings").alias("b")).select("file", "b.*")
    return PropertyGraph.of(nodes, storage.with_ordinals(edges, "idx", "ord", "k"), bindings)
