"""Relational tables as property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..graph import PropertyGraph

#: Key column, id prefix, label and name column of each entity table.
ENTITIES = {
    "region": ("r_regionkey", "R", "REGION", "r_name"),
    "nation": ("n_nationkey", "N", "NATION", "n_name"),
    "customer": ("c_custkey", "C", "CUSTOMER", "c_name"),
    "supplier": ("s_suppkey", "S", "SUPPLIER", "s_name"),
    "part": ("p_partkey", "P", "PART", "p_name"),
    "orders": ("o_orderkey", "O", "ORDER", "o_orderstatus"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column))


def _edges(df: DataFrame, src: tuple[str, str], dst: tuple[str, str], label: str, src_label: str, dst_label: str) -> DataFrame:
    return df.select(_id(*src).alias("src"), _id(*dst).alias("dst"), F.lit(label).alias("label"), F.lit(src_label).alias("src_label"), F.lit(dst_label).alias("dst_label"))


def hierarchy(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders with their references: an acyclic graph. The ordinal of a node is made of its label's rank and its key, so no global sort is needed."""
    t = {name: table(spark, sf_dir, name) for name in (*ENTITIES, "lineitem")}
    nodes = None
    for rank, (name, (key, prefix, label, title)) in enumerate(ENTITIES.items()):
        part = t[name].select((F.lit(rank * 10**15) + F.col(key)).cast("long").alias("ord"), _id(prefix, key).alias("id"), F.lit(label).alias("label"), F.col(title).alias("name"), F.lit(name).alias("file"), F.lit(True).alias("exported"))
        nodes = part if nodes is None else nodes.unionByName(part)
    lines = t["lineitem"]
    edges = (
        _edges(t["nation"], ("N", "n_nationkey"), ("R", "n_regionkey"), "IN_REGION", "NATION", "REGION")
        .unionByName(_edges(t["customer"], ("C", "c_custkey"), ("N", "c_nationkey"), "IN_NATION", "CUSTOMER", "NATION"))
        .unionByName(_edges(t["supplier"], ("S", "s_suppkey"), ("N", "s_nationkey"), "IN_NATION", "SUPPLIER", "NATION"))
        .unionByName(_edges(t["orders"], ("O", "o_orderkey"), ("C", "o_custkey"), "PLACED_BY", "ORDER", "CUSTOMER"))
        .unionByName(_edges(lines.select("l_orderkey", "l_partkey").distinct(), ("O", "l_orderkey"), ("P", "l_partkey"), "HAS_PART", "ORDER", "PART"))
        .unionByName(_edges(lines.select("l_orderkey", "l_suppkey").distinct(), ("O", "l_orderkey"), ("S", "l_suppkey"), "FROM_SUPPLIER", "ORDER", "SUPPLIER"))
    )
    return PropertyGraph.of(nodes, edges)


def trade(spark: SparkSession, sf_dir: str, top: int | None = None) -> PropertyGraph:
    """Nations linked from the supplier's to the customer's, weighted by order lines; with top, only each nation's heaviest links. Small whatever the tables' size: at most the square of the nations."""
    t = {name: table(spark, sf_dir, name) for name in ("nation", "customer", "supplier", "orders", "lineitem")}
    # Lines are summed by order and supplier's nation before they meet customers, and both dimension joins carry two columns.
    links = (
        t["lineitem"].select("l_orderkey", "l_suppkey").join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").alias("s"), F.col("c_nationkey").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    )
    if top:
        links = links.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "d"))).filter(F.col("r") <= top)
    edges = links.select(
        _id("N", "s").alias("src"), _id("N", "d").alias("dst"), F.lit("TRADE").alias("label"), F.lit("NATION").alias("src_label"), F.lit("NATION").alias("dst_label"),
        F.named_struct(F.lit("resolved"), F.lit(True), F.lit("dynamic"), F.lit(False), F.lit("weight"), F.col("n").cast("double"), F.lit("symbols"), F.lit(None).cast("array<struct<name:string,kind:string,schema:string>>")).alias("attrs"),
        (F.row_number().over(Window.orderBy(_id("N", "s"), _id("N", "d"))).cast("long") - 1).alias("idx"),
    )
    nodes = t["nation"].select(F.col("n_nationkey").cast("long").alias("ord"), _id("N", "n_nationkey").alias("id"), F.lit("NATION").alias("label"), F.col("n_name").alias("name"), F.lit("nation").alias("file"), F.lit(True).alias("exported"))
    return PropertyGraph.of(nodes, edges)


def event_flow(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Event types linked from each event to the user's next one; parallel edges stay. idx is the event's id."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.withColumn("next", following).filter("next is not null").select(F.col("event_id").alias("idx"), F.col("event_type").alias("src"), F.col("next").alias("dst"), F.lit("NEXT").alias("label"))
    names = events.select("event_type").filter("event_type is not null").distinct()
    nodes = names.select((F.row_number().over(Window.orderBy("event_type")).cast("long") - 1).alias("ord"), F.col("event_type").alias("id"), F.lit("EVENT_TYPE").alias("label"), F.col("event_type").alias("name"))
    return PropertyGraph.of(nodes, edges)


def users(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users linked from each event's to the next event's in global time order, each pair once. Events are numbered by ranges, without a single-task sort."""
    events = storage.with_ordinals(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), "k", "ts", "event_id").select("k", "user_id")
    following = events.select((F.col("k") - 1).alias("k"), F.col("user_id").alias("next"))
    pairs = events.join(following, "k").filter("user_id is not null and next is not null").select(F.col("user_id").cast("string").alias("src"), F.col("next").cast("string").alias("dst")).distinct()
    edges = storage.with_ordinals(pairs, "idx", "src", "dst").withColumn("label", F.lit("NEXT_USER"))
    names = events.select("user_id").filter("user_id is not null").distinct()
    nodes = names.select(F.col("user_id").cast("long").alias("ord"), F.col("user_id").cast("string").alias("id"), F.lit("USER").alias("label"), F.col("user_id").cast("string").alias("name"))
    return PropertyGraph.of(nodes, edges)


def page_links(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Pages linked to the targets of their href attributes: the first page of that url, else a phantom of that name."""
    pages = table(spark, sf_dir, "pages")
    nodes = pages.select(F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("id"), F.lit("PAGE").alias("label"), F.col("url").alias("name"))
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("k", "href"))
    of = pages.filter("url is not null").groupBy(F.col("url").alias("href")).agg(F.min("page_id").cast("string").alias("page"))
    edges = links.join(of, "href", "left").select(F.col("page_id").cast("string").alias("src"), F.coalesce("page", "href").alias("dst"), F.lit("LINK").alias("label"), (F.shiftleft(F.col("page_id").cast("long"), 32) + F.col("k")).alias("idx"))
    return PropertyGraph.of(nodes, edges)
