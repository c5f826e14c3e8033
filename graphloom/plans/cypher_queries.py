"""Registered pattern queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import cypher
from .graph_queries import H, T3, T_ALL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def pattern(name: str, text: str, sql: str, graph: str = "h") -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = tables.hierarchy(spark, sf_dir) if graph == "h" else tables.trade(spark, sf_dir, 3 if graph == "t" else None)
        return cypher.run(g, text)

    f.__name__, f.__doc__ = name, text
    QUERIES[name] = f
    ORACLE_SQL[name] = sql


_N = "join h_nodes"
pattern("c_match_hop", "MATCH (n:NATION)-[r:IN_REGION]->(g:REGION) RETURN n.name AS nation, g.name AS region",
        f"with {H} select n.name as nation, g.name as region from h_edges e {_N} n on n.id = e.src {_N} g on g.id = e.dst where e.label = 'IN_REGION'")
pattern("c_match_two_hop", "MATCH (c:CUSTOMER)-[:IN_NATION]->(n:NATION)-[:IN_REGION]->(g:REGION {name: 'ASIA'}) RETURN n.name AS nation, count(c) AS customers",
        f"with {H} select n.name as nation, count(*) as customers from h_edges e {_N} n on n.id = e.dst join h_edges f on f.src = n.id and f.label = 'IN_REGION' {_N} g on g.id = f.dst and g.name = 'ASIA' where e.label = 'IN_NATION' and e.src_label = 'CUSTOMER' group by 1")
pattern("c_where", "MATCH (s:SUPPLIER)-[:IN_NATION]->(n:NATION) WHERE n.name STARTS WITH 'N' AND NOT s.name CONTAINS '1' RETURN s.name AS supplier, n.name AS nation",
        f"with {H} select s.name as supplier, n.name as nation from h_edges e {_N} s on s.id = e.src {_N} n on n.id = e.dst where e.label = 'IN_NATION' and s.label = 'SUPPLIER' and starts_with(n.name, 'N') and not contains(s.name, '1')")
pattern("c_agg", "MATCH (o:ORDER)-[:PLACED_BY]->(c:CUSTOMER) WITH c, count(o) AS orders WHERE orders > 12 RETURN c.gid AS customer, orders",
        f"with {H} select dst as customer, count(*) as orders from h_edges where label = 'PLACED_BY' group by 1 having count(*) > 12")
pattern("c_varlen", "MATCH (o:ORDER {gid: 'O9'})-[:PLACED_BY|IN_NATION|IN_REGION*1..3]->(x) RETURN x.gid AS id, x.label AS label",
        f"with recursive {H}, r(id, k) as (select 'O9', 0 union all select e.dst, k + 1 from r join h_edges e on e.src = r.id where k < 3 and e.label in ('PLACED_BY', 'IN_NATION', 'IN_REGION')) select r.id, n.label from r {_N} n on n.id = r.id where k > 0")
pattern("c_order_limit", "MATCH (c:CUSTOMER)-[:IN_NATION]->(n:NATION) RETURN n.name AS nation, count(*) AS n ORDER BY n DESC, nation SKIP 2 LIMIT 5",
        f"with {H} select n.name as nation, count(*) as n from h_edges e {_N} n on n.id = e.dst where e.label = 'IN_NATION' and e.src_label = 'CUSTOMER' group by 1 order by 2 desc, 1 limit 5 offset 2")
pattern("c_exists", "MATCH (x) WHERE NOT (:ORDER)-[:PLACED_BY]->(x) RETURN x.label AS label, count(*) AS n",
        f"with {H} select label, count(*) as n from h_nodes where id not in (select dst from h_edges where label = 'PLACED_BY') group by 1")
pattern("c_exists_some", "MATCH (s:SUPPLIER) WHERE (:ORDER)-[:FROM_SUPPLIER]->(s) AND s.gid <> 'S1' RETURN s.gid AS supplier",
        f"with {H} select id as supplier from h_nodes where label = 'SUPPLIER' and id <> 'S1' and id in (select dst from h_edges where label = 'FROM_SUPPLIER')")
pattern("c_optional", "MATCH (n:NATION) OPTIONAL MATCH (s:SUPPLIER)-[:IN_NATION]->(n) RETURN n.name AS nation, count(s) AS suppliers",
        f"with {H} select n.name as nation, count(e.src) as suppliers from h_nodes n left join h_edges e on e.dst = n.id and e.src_label = 'SUPPLIER' where n.label = 'NATION' group by 1")
pattern("c_union", "MATCH (r:REGION) RETURN r.name AS name UNION MATCH (n:NATION) WHERE n.name =~ '.*[AN]1.*' RETURN n.name AS name",
        f"with {H} select name from h_nodes where label = 'REGION' union select name from h_nodes where label = 'NATION' and regexp_full_match(name, '.*[AN]1.*')")
pattern("c_triangle", "MATCH (a)-[:TRADE]->(b)-[:TRADE]->(c)-[:TRADE]->(a) WHERE a.gid < b.gid AND a.gid < c.gid RETURN a.gid AS a, b.gid AS b, c.gid AS c",
        f"with {T3} select x.src as a, y.src as b, z.src as c from t3 x join t3 y on x.dst = y.src join t3 z on y.dst = z.src and z.dst = x.src where x.src < y.src and x.src < z.src and x.idx <> y.idx and y.idx <> z.idx and x.idx <> z.idx", "t")
pattern("c_undirected", "MATCH (a {gid: 'N1'})-[r:TRADE]-(b) RETURN b.gid AS id, count(r) AS n",
        f"with {T3} select id, count(*) as n from (select dst as id from t3 where src = 'N1' union all select src from t3 where dst = 'N1' and src <> dst) group by 1", "t")


for _name in ("c_triangle", "c_undirected"):
    pattern(f"{_name}_trade", QUERIES[_name].__doc__, ORACLE_SQL[_name].replace(T3, T_ALL), "trade")


def k_mermaid_edges(spark: SparkSession, sf_dir: str, top: int | None = 3) -> DataFrame:
    from ..report.diagrams import mermaid_edges

    return mermaid_edges(tables.trade(spark, sf_dir, top))


QUERIES["k_mermaid_edges"] = k_mermaid_edges
ORACLE_SQL |= {
    "k_mermaid_edges": f"with {T3}, n as (select 'N' || n_nationkey as id, row_number() over (order by n_nationkey) - 1 as k from nation) select '  n' || a.k || ' --> n' || b.k as line from (select distinct src, dst from t3) t join n a on a.id = t.src join n b on b.id = t.dst",
}
for _name in ("k_mermaid_edges",):
    QUERIES[f"{_name}_trade"] = lambda spark, sf_dir, f=QUERIES[_name]: f(spark, sf_dir, None)
    ORACLE_SQL[f"{_name}_trade"] = ORACLE_SQL[_name].replace(T3, T_ALL)
