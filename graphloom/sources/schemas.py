"""JSON Schema files: scans, their graph, and public-interface registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.scalars import normalised
from ..graph import PropertyGraph
from ..storage import with_ordinals
from . import files

_TRUE = lambda c: c.isNotNull() & ~c.isin("", "null", "false", "0")


# op: S9
def schema_texts(spark: SparkSession, root: str) -> DataFrame:
    """ord, path, text of the JSON files below root that have truthy definitions or $schema."""
    docs = files.texts(spark, files.scan_dir(root, (".json",)), root)
    return schema_documents(docs)


def schema_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs (ord, path, text) that are JSON Schemas. Cheap string tests come before parsing."""
    maybe = docs.filter(F.contains("text", F.lit('"definitions"')) | F.contains("text", F.lit('"$schema"')))
    parsed = maybe.filter(F.expr("try_parse_json(text)").isNotNull())
    return parsed.filter(_TRUE(F.get_json_object("text", "$.definitions")) | _TRUE(F.get_json_object("text", "$['$schema']")))


# op: S11
def ref_target(ref: Column, path: Column) -> Column:
    """The id that a $ref means, seen from a file: its own definitions, another file's (relative to the directory unless it begins with schema/), or a whole file."""
    file, name = F.substring_index(ref, "#", 1), F.element_at(F.split(ref, "/definitions/"), -1)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "/")).otherwise("")
    target = normalised(F.when(F.startswith(file, F.lit("schema/")), file).otherwise(F.concat(folder, file)), keep_leading=True)
    return (
        F.when(F.startswith(ref, F.lit("#/definitions/")), F.concat(F.lit("schema::"), path, F.lit("#"), name))
        .when(F.contains(ref, F.lit("#/definitions/")), F.concat(F.lit("schema::"), target, F.lit("#"), name))
        .otherwise(F.concat(F.lit("schema::"), target))
    )


# op: S10
def schema_graph(docs: DataFrame) -> PropertyGraph:
    """Files, definitions and properties of schema documents (ord, path, text), with DEFINES, HAS_PROPERTY and REF edges in document order."""
    body = "struct<`$ref`:string,type:string,required:array<string>,`x-methods`:string,`x-source`:string,properties:map<string,string>,allOf:array<struct<`$ref`:string>>,oneOf:array<struct<`$ref`:string>>>"
    prop = "struct<`$ref`:string,type:string,items:struct<`$ref`:string>>"
    defs = docs.select("ord", "path", F.posexplode(F.from_json(F.get_json_object("text", "$.definitions"), "map<string,string>")).alias("d", "name", "json"))
    defs = defs.withColumn("b", F.from_json("json", body)).withColumn("file_id", F.concat(F.lit("schema::"), "path")).withColumn("id", F.concat("file_id", F.lit("#"), "name"))
    props = defs.select("ord", "d", "path", F.col("id").alias("def_id"), F.posexplode("b.properties").alias("p", "name", "json"))
    props = props.withColumn("b", F.from_json("json", prop)).withColumn("id", F.concat("def_id", F.lit("."), "name"))
    a = lambda **k: F.from_json(F.to_json(F.struct(*[v.alias(n) for n, v in k.items()])), model.NODE_ATTRS)
    none = F.lit(None).cast("string")
    nodes = (
        docs.select("ord", F.lit(-1).alias("d"), F.lit(-1).alias("p"), F.concat(F.lit("schema::"), "path").alias("id"), F.lit("SCHEMA_FILE").alias("label"), F.col("path").alias("name"), F.col("path").alias("file"), none.alias("parent"), F.lit(False).alias("exported"), F.from_json(none, model.NODE_ATTRS).alias("attrs"))
        .unionByName(defs.select("ord", "d", F.lit(-1).alias("p"), "id", F.lit("DEFINITION").alias("label"), "name", F.col("path").alias("file"), F.col("file_id").alias("parent"), F.lit(True).alias("exported"), a(type=F.col("b.type"), required=F.col("b.required"), hasXMethods=F.col("b.`x-methods`").isNotNull(), hasXSource=F.col("b.`x-source`").isNotNull()).alias("attrs")))
        .unionByName(props.select("ord", "d", "p", "id", F.lit("PROPERTY").alias("label"), "name", F.col("path").alias("file"), F.col("def_id").alias("parent"), F.lit(False).alias("exported"), a(type=F.col("b.type"), hasRef=F.col("b.`$ref`").isNotNull(), refTarget=F.col("b.`$ref`")).alias("attrs")))
    )
    ref = lambda df, src, r, p, k, sym: df.filter(r.isNotNull()).select("ord", "d", p.alias("p"), F.lit(k).alias("k"), src.alias("src"), ref_target(r, F.col("path")).alias("dst"), F.lit("REF").alias("label"), F.lit("DEFINITION").alias("src_label"), F.lit("DEFINITION").alias("dst_label"), sym.alias("symbol"))
    last, no = F.lit(1_000_000), none
    inner = lambda key: defs.select("ord", "d", "path", "id", F.explode(f"b.{key}").alias("s"))
    edges = (
        defs.select("ord", "d", F.lit(-1).alias("p"), F.lit(0).alias("k"), F.col("file_id").alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("label"), F.lit("SCHEMA_FILE").alias("src_label"), F.lit("DEFINITION").alias("dst_label"), no.alias("symbol"))
        .unionByName(props.select("ord", "d", "p", F.lit(0).alias("k"), F.col("def_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_PROPERTY").alias("label"), F.lit("DEFINITION").alias("src_label"), F.lit("PROPERTY").alias("dst_label"), no.alias("symbol")))
        .unionByName(ref(props, F.col("def_id"), F.col("b.`$ref`"), F.col("p"), 1, F.col("name")))
        .unionByName(ref(props, F.col("def_id"), F.col("b.items.`$ref`"), F.col("p"), 2, F.col("name")))
        .unionByName(ref(defs, F.col("id"), F.col("b.`$ref`"), last, 3, no))
        .unionByName(ref(inner("allOf"), F.col("id"), F.col("s.`$ref`"), last, 4, no))
        .unionByName(ref(inner("oneOf"), F.col("id"), F.col("s.`$ref`"), last, 5, no))
    )
    symbols = F.when(F.col("symbol").isNull(), F.array().cast(model.SYMBOLS)).otherwise(F.array(F.struct(F.col("symbol").alias("name"), none.alias("kind"), none.alias("schema"))).cast(model.SYMBOLS))
    attrs = F.struct(F.lit(True).alias("resolved"), F.lit(None).cast("boolean").alias("dynamic"), F.lit(None).cast("double").alias("weight"), symbols.alias("symbols"))
    numbered = with_ordinals(nodes.withColumnRenamed("ord", "file_ord"), "ord", "file_ord", "d", "p").withColumn("full_name", F.col("id"))
    return PropertyGraph.of(numbered, with_ordinals(edges.withColumn("attrs", attrs), "idx", "ord", "d", "p", "k", "dst"))


# op: S5
def find_registry_schemas(root: str) -> list[str]:
    """JSON files of the folders config, schema and schemas, and *.schema.json of the root itself; not recursive."""
    tree, found = files.tree_of(root), []
    json_of = lambda folder, end: [p for name, p, is_dir in tree.children(folder) if name.endswith(end) and not is_dir]
    for folder in ("config", "schema", "schemas"):
        at = f"{root.rstrip('/')}/{folder}"
        if tree.is_dir(at):
            found += json_of(at, ".json")
    return found + json_of(root, ".schema.json")


# op: S6
def registry_from_schemas(docs: DataFrame) -> DataFrame:
    """file (the title, or a definition's name), method, has_xmethod, param_count of schema documents (path, text) with x-methods."""
    whole = docs.select(F.col("text").alias("json"), F.get_json_object("text", "$.title").alias("file")).filter("file is not null")
    parts = docs.select(F.explode(F.from_json(F.get_json_object("text", "$.definitions"), "map<string,string>")).alias("file", "json"))
    each = whole.select("file", "json").unionByName(parts.select("file", "json"))
    methods = each.select("file", F.explode(F.from_json(F.get_json_object("json", "$['x-methods']"), "map<string,string>")).alias("method", "m"))
    count = F.coalesce(F.get_json_object("m", "$.properties.params.minItems"), F.get_json_object("m", "$.properties.params.maxItems"))
    return methods.select("file", "method", F.lit(True).alias("has_xmethod"), count.cast("int").alias("param_count"))


# op: S7
def registry_from_json(docs: DataFrame) -> DataFrame:
    """The same of registry documents (text): a flat map of files to methods, or the default of definitions.PublicInterfaceRegistry."""
    flat = F.coalesce(F.get_json_object("text", "$.definitions.PublicInterfaceRegistry.default"), F.col("text"))
    rows = docs.select(F.explode(F.from_json(flat, "map<string,array<string>>")).alias("file", "methods")).filter("methods is not null")
    return rows.select("file", F.explode("methods").alias("method"), F.lit(False).alias("has_xmethod"), F.lit(None).cast("int").alias("param_count"))


# op: S8
def build_registry(spark: SparkSession, root: str, registry: str | None = None, schemas: list[str] | None = None) -> tuple[DataFrame | None, str | None]:
    """The registry by precedence: a registry file, given schemas, those found; and the text of the first schema, for its entry points."""
    if registry:
        return registry_from_json(files.texts(spark, [registry], root)), None
    paths = schemas or find_registry_schemas(root)
    if not paths:
        return None, None
    docs = files.texts(spark, paths, root)
    return registry_from_schemas(docs), docs.orderBy("ord").first()["text"]


# op: S14
def entry_point_overrides(docs: DataFrame) -> DataFrame:
    """The files of x-entry-points of schema documents (text)."""
    kind = "array<struct<file:string>>"
    return docs.select(F.explode(F.from_json(F.get_json_object("text", "$['x-entry-points']"), kind)).alias("e")).select("e.file").filter("file is not null")
