"""Registered queries over graphs made of the relational tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..graph import PropertyGraph
from ..operators import algorithms as A
from ..operators import traversal as T
from ..sources import tables

# --- SQL of the graphs
H_NODES = """h_nodes as (
  select 'R' || r_regionkey as id, 'REGION' as label, r_name as name from region
  union all select 'N' || n_nationkey, 'NATION', n_name from nation
  union all select 'C' || c_custkey, 'CUSTOMER', c_name from customer
  union all select 'S' || s_suppkey, 'SUPPLIER', s_name from supplier
  union all select 'P' || p_partkey, 'PART', p_name from part
  union all select 'O' || o_orderkey, 'ORDER', o_orderstatus from orders)"""
H_EDGES = """h_edges as (
  select 'N' || n_nationkey as src, 'R' || n_regionkey as dst, 'IN_REGION' as label, 'NATION' as src_label, 'REGION' as dst_label from nation
  union all select 'C' || c_custkey, 'N' || c_nationkey, 'IN_NATION', 'CUSTOMER', 'NATION' from customer
  union all select 'S' || s_suppkey, 'N' || s_nationkey, 'IN_NATION', 'SUPPLIER', 'NATION' from supplier
  union all select 'O' || o_orderkey, 'C' || o_custkey, 'PLACED_BY', 'ORDER', 'CUSTOMER' from orders
  union all select distinct 'O' || l_orderkey, 'P' || l_partkey, 'HAS_PART', 'ORDER', 'PART' from lineitem
  union all select distinct 'O' || l_orderkey, 'S' || l_suppkey, 'FROM_SUPPLIER', 'ORDER', 'SUPPLIER' from lineitem)"""
H = f"{H_NODES}, {H_EDGES}"
T_EDGES = """t_edges as (
  select 'N' || s_nationkey as src, 'N' || c_nationkey as dst, count(*) as n, s_nationkey as sk, c_nationkey as dk
  from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all)"""
T3 = f"""{T_EDGES}, t3 as (
  select src, dst, n, row_number() over (order by src, dst) - 1 as idx from (select *, row_number() over (partition by sk order by n desc, dk) as r from t_edges) where r <= 3),
  ids as (select 'N' || n_nationkey as id from nation)"""
E_EDGES = "e_edges as (select event_id as idx, event_type as src, nxt as dst from (select *, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null)"
L_EDGES = """l_edges as (select cast(page_id as varchar) as src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as dst from pages)"""
#: Distances on t3, by levels without repetition.
DIST = f"""with recursive {T3}, d(s, v, k) as (
  select id, id, 0 from ids union select d.s, t3.dst, d.k + 1 from d join t3 on d.v = t3.src where d.k < 24),
  dist as (select s, v, min(k) as k from d group by s, v)"""

#: The whole trade graph under the names that the SQL of t3 reads, so that one text serves both.
T_ALL = T3.replace(" where r <= 3", "")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t3(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The trade graph of each nation's three heaviest links, stored, since loops read it often."""
    return tables.trade(spark, sf_dir, 3).indexed()


def _trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The whole trade graph, stored."""
    return tables.trade(spark, sf_dir).indexed()


def _farthest(g: PropertyGraph) -> DataFrame:
    """The shortest path from the first source to the farthest node."""
    start = g.edges.agg(F.min("src")).first()[0]
    reach = T.bfs(g.edges, g.nodes.filter(F.col("id") == start).select("id"))
    goal = reach.agg(F.max(F.struct("depth", "id")).alias("m")).first()["m"]["id"]
    return T.shortest_path(g, start, goal).select(F.array_join("path", ">").alias("path"), "length")


def _communities(g: PropertyGraph) -> DataFrame:
    found = storage.stored(A.louvain(g), "communities")  # read more than once
    return A.clusters(g, found).join(A.modularity(g, found), "community")


def _users(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The users graph of all events, stored."""
    return tables.users(spark, sf_dir).indexed()


@query(f"with {H} select label, count(*) as n, min(name) as first_name from h_nodes group by label")
def g_nodes_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hierarchy(spark, sf_dir).nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query(f"with {H} select label, src_label, dst_label, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from h_edges group by all")
def g_edges_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hierarchy(spark, sf_dir).edges.groupBy("label", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(f"""with {H}, o as (select src as id, count(*) as n from h_edges group by 1), i as (select dst as id, count(*) as n from h_edges group by 1)
select id, cast(coalesce(i.n, 0) as bigint) as in_degree, cast(coalesce(o.n, 0) as bigint) as out_degree, cast(coalesce(i.n, 0) + coalesce(o.n, 0) as bigint) as degree from h_nodes left join o using (id) left join i using (id)""")
def g_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hierarchy(spark, sf_dir).degrees()


@query(f"with {H} select src as id, count(*) as n from h_edges where dst = 'N3' group by 1")
def g_in_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hierarchy(spark, sf_dir).in_neighbors("N3").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {H} select dst as id, count(*) as n from h_edges where src = 'O5' group by 1")
def g_out_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hierarchy(spark, sf_dir).out_neighbors("O5").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {H} select id, h_nodes.label, direction, edge_label from (
  select dst as id, 'out' as direction, label as edge_label from h_edges where src = 'C1' union all select src, 'in', label from h_edges where dst = 'C1') join h_nodes using (id)""")
def g_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hierarchy(spark, sf_dir).linked("C1").select("id", "label", "direction", "edge_label")


@query(f"with {L_EDGES} select distinct dst as id from l_edges where dst not in (select cast(page_id as varchar) from pages)")
def g_phantoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_links(spark, sf_dir).phantoms()


@query(f"with {L_EDGES} select src, dst, count(*) as n from l_edges group by all")
def s_links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_links(spark, sf_dir).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("with n as (select 'N' || n_nationkey as id, n_name as name from nation) select id, name from n where id = 'N7'")
def g_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hierarchy(spark, sf_dir).node("N7").select("id", "name")


@query(f"with {H} select id, label from h_nodes where name = (select n_name from nation where n_nationkey = 4) and label <> 'FILE'")
def q_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.hierarchy(spark, sf_dir)
    name = g.node("N4").first()["name"]
    return T.symbols_named(g, name).select("id", "label")


def _with_files(g: PropertyGraph) -> PropertyGraph:
    """g in which customers and nations play the files."""
    end = lambda c: F.when(F.col(c).isin("CUSTOMER", "NATION"), "FILE").otherwise(F.col(c)).alias(c)
    return PropertyGraph.of(g.nodes, g.edges.withColumn("src_label", end("src_label")).withColumn("dst_label", end("dst_label")))


@query(f"with {H} select src, dst, label from h_edges where src_label in ('CUSTOMER', 'NATION') and dst_label in ('CUSTOMER', 'NATION')")
def q_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.file_edges(_with_files(tables.hierarchy(spark, sf_dir))).select("src", "dst", "label")


@query(f"with {H} select label, src_label, count(*) as n from h_edges where not (src_label in ('CUSTOMER', 'NATION') and dst_label in ('CUSTOMER', 'NATION')) group by all")
def q_symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.symbol_edges(_with_files(tables.hierarchy(spark, sf_dir)))
    return found.groupBy("label", F.when(F.col("src_label") == "FILE", "NATION").otherwise(F.col("src_label")).alias("src_label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {H} select 'in' as direction, src, dst, label from h_edges where dst = 'N2' and dst_label = 'NATION' union all select 'out', src, dst, label from h_edges where src = 'N2' and src_label = 'NATION'")
def q_in_out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.hierarchy(spark, sf_dir)
    pick = lambda d, df: df.select(F.lit(d).alias("direction"), "src", "dst", "label")
    return pick("in", T.incoming_edges(g, "N2", "NATION")).unionByName(pick("out", T.outgoing_edges(g, "N2", "NATION")))


_IMPACT = """with recursive {h}, r(id, k) as (select '{seed}', 0 union select e.{far}, r.k + 1 from r join h_edges e on e.{near} = r.id where r.k < {depth})
select r.id, h_nodes.label, h_nodes.name, min(k) as depth{extra} from r join h_nodes using (id) where r.id <> '{seed}' group by all"""


def _impact_sql(seed: str, up: bool, depth: int, extra: str = "") -> str:
    return "select * from (" + _IMPACT.format(h=H, seed=seed, far="src" if up else "dst", near="dst" if up else "src", depth=depth, extra=extra).replace("min(k) as depth", "cast(min(k) as int) as depth") + ")"


@query(_impact_sql("N3", True, 2))
def q_impact_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.impact(tables.hierarchy(spark, sf_dir), "N3", "upstream", 2).select("id", "label", "name", "depth")


@query(_impact_sql("O7", False, 3))
def q_impact_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.impact(tables.hierarchy(spark, sf_dir), "O7", "downstream", 3).select("id", "label", "name", "depth")


@query(f"select risk, depth, count(*) as n from (select *, case depth when 1 then 'WILL BREAK' when 2 then 'LIKELY AFFECTED' else 'MAY NEED TESTING' end as risk from ({_impact_sql('R1', True, 3)})) group by all")
def q_impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.impact(tables.hierarchy(spark, sf_dir), "R1", "upstream", 3)
    return found.withColumn("risk", T.risk(F.col("depth"))).groupBy("risk", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {H} select id, label from h_nodes where name = (select c_name from customer where c_custkey = 9) and label <> 'FILE'")
def q_seed_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.hierarchy(spark, sf_dir)
    return T.seeds(g, g.node("C9").first()["name"]).select("id", "label")


@query(f"""with {H} select 'target' as part, 'S2' as id, null as other, null as label
union all select 'symbol_caller', dst, src, label from h_edges where dst = 'S2' union all select 'symbol_callee', src, dst, label from h_edges where src = 'S2'""")
def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of a supplier under an id of the form file::symbol."""
    g = tables.hierarchy(spark, sf_dir)
    full = lambda c: F.when(F.col(c) == "S2", "supplier::S2").otherwise(F.col(c)).alias(c)
    g2 = PropertyGraph.of(g.nodes.withColumn("id", full("id")), g.edges.withColumn("src", full("src")).withColumn("dst", full("dst")))
    short = lambda c: F.element_at(F.split(c, "::"), -1).alias(c)
    return T.context(g2, "supplier::S2").select("part", short("id"), short("other"), "label")


@query(f"{DIST} select s as seed, v as id, cast(k as int) as depth from dist")
def a_bfs_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _t3(spark, sf_dir)
    return T.bfs(g.edges, g.nodes.select("id")).select("seed", "id", "depth")


@query(f"""with recursive {T3}, ends as (select min(src) as a from t3), d(v, path, steps) as (
  select a, [a], cast([] as bigint[]) from ends union all select t3.dst, list_append(path, t3.dst), list_append(steps, t3.idx) from d join t3 on d.v = t3.src where len(path) < 6 and not list_contains(path, t3.dst)),
  far as (select v, min(len(path)) as k from d group by v), goal as (select max(v) as b from far where k = (select max(k) from far)),
  best as (select path, row_number() over (order by len(path), steps) as r from d join goal on v = b)
select array_to_string(path, '>') as path, cast(len(path) as int) as length from best where r = 1""")
def a_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first source to the farthest nation."""
    return _farthest(_t3(spark, sf_dir))


@query(f"""{DIST}, c as (select s, sum(case when k > 0 then 1 else 0 end) as r, sum(k) as far from dist group by s), n as (select count(*) as n from ids)
select s as id, round(case when far > 0 then r / (n - 1) * r / far else 0 end, 6) as closeness from c, n""")
def a_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(A.closeness(_t3(spark, sf_dir)), "closeness")


def _pagerank_sql(rounds: int) -> str:
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"""r{k} as (select ids.id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(x), 0) from r{k - 1} where id not in (select src from deg)) / n) as x
  from ids cross join num left join (select t3.dst as id, sum(r{k - 1}.x / deg.d) as got from t3 join deg on t3.src = deg.src join r{k - 1} on r{k - 1}.id = t3.src group by 1) g on g.id = ids.id)""")
    return f"with {T3}, num as (select cast(count(*) as double) as n from ids), deg as (select src, cast(count(*) as double) as d from t3 group by 1), r0 as (select id, 1 / n as x from ids, num), {', '.join(steps)} select id, round(x, 6) as pagerank from r{rounds}"


@query(_pagerank_sql(20))
def a_pagerank_20it(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(A.pagerank(_t3(spark, sf_dir), max_iter=20, tol=None), "pagerank")


def _hits_sql(rounds: int) -> str:
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"""a{k} as materialized (select ids.id, coalesce(sum(h{k - 1}.x), 0) as x from ids left join t3 on t3.dst = ids.id left join h{k - 1} on h{k - 1}.id = t3.src group by ids.id),
  b{k} as materialized (select ids.id, coalesce(sum(a{k}.x), 0) as x from ids left join t3 on t3.src = ids.id left join a{k} on a{k}.id = t3.dst group by ids.id),
  u{k} as materialized (select id, x / (select sqrt(sum(x * x)) from a{k}) as x from a{k}), h{k} as materialized (select id, x / (select sqrt(sum(x * x)) from b{k}) as x from b{k})""")
    last = f"select h.id, round(h.x / (select sum(x) from h{rounds}), 6) as hub, round(u.x / (select sum(x) from u{rounds}), 6) as authority from h{rounds} h join u{rounds} u using (id)"
    return f"with {T3}, h0 as (select id, 1.0 / (select count(*) from ids) as x from ids), {', '.join(steps)} {last}"


@query(_hits_sql(20))
def a_hits_20it(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(A.hits(_t3(spark, sf_dir), max_iter=20, tol=None), "hub", "authority")


_SIGMA = f"""{DIST}, m as (select src, dst, count(*) as c from t3 group by all),
  sg(s, v, k, c) as (select id, id, 0, cast(1 as double) from ids union all
    select s, v, k, c from (select sg.s, m.dst as v, sg.k + 1 as k, sum(sg.c * m.c) as c from sg join m on sg.v = m.src join dist on dist.s = sg.s and dist.v = m.dst and dist.k = sg.k + 1 group by 1, 2, 3)),
  sig as (select s, v, k, sum(c) as c from sg group by all), n as (select count(*) as n from ids),
  b as (select v.v as id, sum(v.c * t.c / st.c) as x from sig v join sig t on t.s = v.v join sig st on st.s = v.s and st.v = t.v where v.s <> v.v and t.v <> v.v and v.s <> t.v and v.k + t.k = st.k group by 1)"""


@query(f"{_SIGMA} select ids.id, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 6) as betweenness from ids cross join n left join b using (id)")
def a_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(A.betweenness(_t3(spark, sf_dir)), "betweenness")


@query(f"{_SIGMA}, t as (select coalesce(x, 0) / ((n - 1) * (n - 2)) as y from ids cross join n left join b using (id)) select round(avg(y), 6) as mean, round(stddev_pop(y), 6) as stddev from t")
def a_centrality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(A.centrality_stats(A.betweenness(_t3(spark, sf_dir))), "mean", "stddev")


@query(f"{_SIGMA}, t as (select ids.id, coalesce(x, 0) / ((n - 1) * (n - 2)) as y from ids cross join n left join b using (id)) select id, round(y, 6) as betweenness from t where y > (select avg(y) + 1.0 * stddev_pop(y) from t)")
def a_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(A.bottlenecks(A.betweenness(_t3(spark, sf_dir)), 1.0), "betweenness")


@query(f"""with {T3}, p as (select distinct least(src, dst) as a, greatest(src, dst) as b from t3 where src <> dst), nb as (select a as id, b as o from p union select b, a from p),
  k as (select id, count(*) as k from nb group by id), t as (select x.id, count(*) as t from nb x join nb y on x.id = y.id and x.o < y.o join p on p.a = x.o and p.b = y.o group by x.id)
select k.id, round(coalesce(t.t, 0) / (k * (k - 1) / 2), 6) as coefficient from k left join t using (id) where k >= 2""")
def a_clustering_coeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rounded(A.clustering_coefficients(_t3(spark, sf_dir)), "coefficient")


_SCC = f"{DIST}, c as (select x.s as id, min(y.s) as component from dist x join dist y on x.v = y.s and y.v = x.s group by 1)"


@query(f"{_SCC} select id, component, count(*) over (partition by component) as size from c")
def a_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.strongly_connected(_t3(spark, sf_dir))


@query(f"{_SCC} select distinct id from (select id from c where component in (select component from c group by 1 having count(*) > 1) union select src from t3 where src = dst)")
def a_cyclic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cyclic_nodes(_t3(spark, sf_dir))


_DAG = """h2_nodes as (select * from h_nodes where label in ('REGION', 'NATION', 'CUSTOMER', 'SUPPLIER', 'ORDER')), h2_edges as (select src, dst from h_edges where label in ('IN_REGION', 'IN_NATION', 'PLACED_BY', 'FROM_SUPPLIER'))"""


def _dag(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return tables.hierarchy(spark, sf_dir).subgraph(("REGION", "NATION", "CUSTOMER", "SUPPLIER", "ORDER"), ("IN_REGION", "IN_NATION", "PLACED_BY", "FROM_SUPPLIER"))


@query(f"with recursive {H}, {_DAG}, r(id, k) as (select id, 0 from h2_nodes where id not in (select dst from h2_edges) union select e.dst, r.k + 1 from r join h2_edges e on e.src = r.id) select id, cast(max(k) as int) as level from r group by id")
def a_topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topological_levels(_dag(spark, sf_dir))


@query(f"with recursive {H}, {_DAG}, r(id, k) as (select id, 0 from h2_nodes where id not in (select src from h2_edges) union select e.src, r.k + 1 from r join h2_edges e on e.dst = r.id) select id, cast(max(k) as int) as depth from r group by id")
def a_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.longest_depths(_dag(spark, sf_dir))


@query(f"""with recursive {H}, {_DAG}, r(id, path) as (select id, [id] from h2_nodes where id not in (select src from h2_edges) union all select e.src, list_prepend(e.src, path) from r join h2_edges e on e.dst = r.id)
select id, array_to_string(path, '>') as path, cast(len(path) as int) as length from (select *, row_number() over (partition by id order by len(path) desc, path) as k from r) where k = 1""")
def a_hot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.longest_paths(_dag(spark, sf_dir)).select("id", F.array_join("path", ">").alias("path"), "length")


@query()
def a_cycles_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cycles(_trade(spark, sf_dir))


@query()
def a_hot_paths_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hot_paths(_trade(spark, sf_dir))


@query()
def a_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.louvain(_trade(spark, sf_dir))


@query()
def a_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _communities(_trade(spark, sf_dir))


@query()
def a_topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..storage import with_ordinals

    g = tables.hierarchy(spark, sf_dir)
    return A.topological_order(PropertyGraph.of(g.nodes, with_ordinals(g.edges.drop("idx"), "idx", "label", "src", "dst")))


#: The whole hierarchy under the names that the SQL of the graph without parts reads.
_DAG_ALL = "h2_nodes as (select * from h_nodes), h2_edges as (select src, dst from h_edges)"
for _name, _f in {
    "a_topo_levels": A.topological_levels, "a_depth": A.longest_depths,
    "a_hot_paths": lambda g: A.longest_paths(g).select("id", F.array_join("path", ">").alias("path"), "length"),
}.items():
    QUERIES[f"{_name}_whole"] = lambda spark, sf_dir, f=_f: f(tables.hierarchy(spark, sf_dir))
    ORACLE_SQL[f"{_name}_whole"] = ORACLE_SQL[_name].replace(_DAG, _DAG_ALL)


@query(f"with {E_EDGES} select src, dst, count(*) as n from e_edges group by all")
def g_event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_flow(spark, sf_dir).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"with recursive {E_EDGES}, p as (select distinct src, dst from e_edges), r(a, b) as (select src, dst from p union select r.a, p.dst from r join p on r.b = p.src) select a as id from r where a = b")
def a_event_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that lie on a cycle of the event flow."""
    g = tables.event_flow(spark, sf_dir)
    return A.cyclic_nodes(PropertyGraph.of(g.nodes, g.edges.select("src", "dst").distinct()))


@query(f"with {E_EDGES} select t.event_type as id, count(*) as out_degree, (select count(*) from e_edges where dst = t.event_type) as in_degree from (select distinct event_type from events) t join e_edges on src = t.event_type group by 1")
def g_event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the event flow and their degrees, parallel edges and all."""
    return tables.event_flow(spark, sf_dir).degrees().select("id", "out_degree", "in_degree")


#: The users graph under the same names.
T_USERS = """t_edges as (
  select distinct cast(user_id as varchar) as src, cast(nxt as varchar) as dst from (select user_id, lead(user_id) over (order by ts, event_id) as nxt from events) where user_id is not null and nxt is not null),
  t3 as (select src, dst, 1 as n, row_number() over (order by src, dst) - 1 as idx from t_edges),
  ids as (select distinct cast(user_id as varchar) as id from events where user_id is not null)"""
#: The operators over whole graphs: queries named a_..._trade and a_..._users have the SQL of their namesakes on t3. On the users graph the loops run distributed, whatever its size.
WHOLE = {
    "bfs_dist": lambda g: T.bfs(g.edges, g.nodes.select("id")).select("seed", "id", "depth"),
    "closeness": lambda g: A.rounded(A.closeness(g), "closeness"),
    "pagerank_20it": lambda g: A.rounded(A.pagerank(g, max_iter=20, tol=None), "pagerank"),
    "hits_20it": lambda g: A.rounded(A.hits(g, max_iter=20, tol=None), "hub", "authority"),
    "betweenness": lambda g: A.rounded(A.betweenness(g), "betweenness"),
    "centrality_stats": lambda g: A.rounded(A.centrality_stats(A.betweenness(g)), "mean", "stddev"),
    "bottlenecks": lambda g: A.rounded(A.bottlenecks(A.betweenness(g), 1.0), "betweenness"),
    "clustering_coeff": lambda g: A.rounded(A.clustering_coefficients(g), "coefficient"),
    "scc": A.strongly_connected,
    "cyclic_nodes": A.cyclic_nodes,
    "shortest_path": lambda g: _farthest(g),
}
LOOPS = {
    "pagerank_20it": lambda g: A.rounded(A.pagerank(g, max_iter=20, tol=None, small=0), "pagerank"),
    "hits_20it": lambda g: A.rounded(A.hits(g, max_iter=20, tol=None, small=0), "hub", "authority"),
    "scc": lambda g: A.strongly_connected(g, small=0),
    "cyclic_nodes": lambda g: A.cyclic_nodes(g, small=0),
}
for _name, _f in WHOLE.items():
    QUERIES[f"a_{_name}_trade"] = lambda spark, sf_dir, f=_f: f(_trade(spark, sf_dir))
    QUERIES[f"a_{_name}_users"] = lambda spark, sf_dir, f=LOOPS.get(_name, _f): f(_users(spark, sf_dir))
    if _name != "shortest_path":  # its SQL lists all simple paths
        ORACLE_SQL[f"a_{_name}_trade"] = ORACLE_SQL[f"a_{_name}"].replace(T3, T_ALL)
        ORACLE_SQL[f"a_{_name}_users"] = ORACLE_SQL[f"a_{_name}"].replace(T3, T_USERS)
for _name, _f in {"cycles_dfs": A.cycles, "hot_paths_dfs": A.hot_paths, "louvain": A.louvain, "clusters": lambda g: _communities(g)}.items():
    QUERIES[f"a_{_name}_users"] = lambda spark, sf_dir, f=_f: f(_users(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on a nation, with degrees and risk."""
    g = tables.hierarchy(spark, sf_dir)
    found = T.impact(g, "N3", "upstream", 2)
    return found.join(g.degrees(), "id").withColumn("risk", T.risk(F.col("depth")))
