"""A subset of Cypher, lowered to DataFrame joins.

MATCH and OPTIONAL MATCH of linear patterns with labels, property maps, relationship types, directions and variable lengths,
also open ones; UNWIND; WHERE with comparisons, AND, OR, NOT, XOR, IN, STARTS WITH, ENDS WITH, CONTAINS, =~, IS NULL and
existence of a pattern; WITH; RETURN [DISTINCT] with aliases and count, sum, avg, min, max, collect; ORDER BY, SKIP,
LIMIT; UNION [ALL]. Write clauses raise Unsupported.

A node pattern is a filtered scan of nodes, a hop a join with edges, a repeated variable an equality, and no edge is used
twice within one MATCH. Predicates on one variable of an equality join are left to Catalyst, which moves them to the scans.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..graph import PropertyGraph

WRITES = ("CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "CALL", "LOAD", "FOREACH")
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
TOKEN = re.compile(r"""\s+|//[^\n]*|(?P<s>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<n>\d+(?:\.\d+(?!\.))?(?:[eE][+-]?\d+)?)|(?P<q>`[^`]*`)|(?P<w>[^\W\d]\w*)|(?P<p><>|<=|>=|=~|\.\.|<-|->|[-+*/%^=<>()\[\]{},.:|;$])""")


class Unsupported(ValueError):
    pass


class CypherSyntax(ValueError):
    pass


# --- syntax
@dataclass
class NodePattern:
    name: str | None
    labels: list[str]
    props: dict


@dataclass
class RelPattern:
    name: str | None
    types: list[str]
    direction: str  # out, in, both
    hops: tuple[int, int | None] | None
    props: dict = field(default_factory=dict)


class Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise CypherSyntax(f"unexpected {text[at]!r} at {at}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.k = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.k + ahead] if self.k + ahead < len(self.tokens) else ("end", "")

    def next(self) -> str:
        t = self.peek()
        self.k += 1
        return t[1]

    def at(self, *words: str) -> bool:
        """Whether these words or punctuators come next."""
        return all((v.upper() == w if kind == "w" else v == w) and kind in "wp" for w, (kind, v) in ((w, self.peek(i)) for i, w in enumerate(words)))

    def eat(self, *words: str) -> bool:
        if self.at(*words):
            self.k += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.eat(*words):
            raise CypherSyntax(f"expected {' '.join(words)}, found {self.peek()[1] or 'the end'!r}")

    def name(self) -> str:
        kind, v = self.peek()
        if kind not in "wq" or kind == "end":
            raise CypherSyntax(f"expected a name, found {v!r}")
        self.k += 1
        return v.strip("`")

    # patterns
    def props(self) -> dict:
        out = {}
        if self.eat("{"):
            while not self.eat("}"):
                key = self.name()
                self.need(":")
                out[key] = self.expression()
                if not self.at("}"):
                    self.need(",")
        return out

    def node(self) -> NodePattern:
        self.need("(")
        name = self.name() if self.peek()[0] in "wq" else None
        labels = []
        while self.eat(":"):
            labels.append(self.name())
        props = self.props()
        self.need(")")
        return NodePattern(name, labels, props)

    def rel(self) -> RelPattern:
        left = self.eat("<-") or self.eat("<", "-")
        if not left:
            self.need("-")
        name, types, hops, props = None, [], None, {}
        if self.eat("["):
            if self.peek()[0] in "wq":
                name = self.name()
            if self.eat(":"):
                types.append(self.name())
                while self.eat("|"):
                    self.eat(":")
                    types.append(self.name())
            if self.eat("*"):
                low = int(self.next()) if self.peek()[0] == "n" else None
                high = low
                if self.eat(".."):
                    high = int(self.next()) if self.peek()[0] == "n" else None
                hops = (1 if low is None else low, high)  # no upper end: as far as edges go
            props = self.props()
            self.need("]")
        right = self.eat("->")
        if not right:
            self.need("-")
        return RelPattern(name, types, "both" if left == right else "in" if left else "out", hops, props)

    def path(self) -> list:
        out = [self.node()]
        while self.at("-") or self.at("<-") or self.at("<", "-"):
            out += [self.rel(), self.node()]
        return out

    # expressions, by rising precedence
    def expression(self):
        e = self.xor()
        while self.eat("OR"):
            e = ("or", e, self.xor())
        return e

    def xor(self):
        e = self.and_()
        while self.eat("XOR"):
            e = ("xor", e, self.and_())
        return e

    def and_(self):
        e = self.not_()
        while self.eat("AND"):
            e = ("and", e, self.not_())
        return e

    def not_(self):
        return ("not", self.not_()) if self.eat("NOT") else self.comparison()

    def comparison(self):
        e = self.sum()
        while True:
            if self.eat("IS", "NOT", "NULL"):
                e = ("not", ("null", e))
            elif self.eat("IS", "NULL"):
                e = ("null", e)
            elif self.eat("STARTS", "WITH"):
                e = ("starts", e, self.sum())
            elif self.eat("ENDS", "WITH"):
                e = ("ends", e, self.sum())
            elif self.eat("CONTAINS"):
                e = ("contains", e, self.sum())
            elif self.eat("IN"):
                e = ("in", e, self.sum())
            elif self.peek()[1] in ("=", "<>", "<", ">", "<=", ">=", "=~") and self.peek()[0] == "p":
                e = (self.next(), e, self.sum())
            else:
                return e

    def sum(self):
        e = self.product()
        while self.at("+") or self.at("-"):
            e = (self.next(), e, self.product())
        return e

    def product(self):
        e = self.atom()
        while self.at("*") or self.at("/") or self.at("%"):
            e = (self.next(), e, self.atom())
        return e

    def atom(self):
        kind, v = self.peek()
        if self.eat("-"):
            return ("neg", self.atom())
        if kind == "n":
            self.next()
            return ("lit", float(v) if "." in v or "e" in v.lower() else int(v))
        if kind == "s":
            self.next()
            return ("lit", re.sub(r"\\(.)", r"\1", v[1:-1]))
        if self.eat("["):
            items = []
            while not self.eat("]"):
                items.append(self.expression())
                if not self.at("]"):
                    self.need(",")
            return ("list", items)
        if self.at("("):
            at = self.k
            try:
                p = self.path()
                if len(p) > 1:
                    return ("exists", p)
            except CypherSyntax:
                pass
            self.k = at
            self.need("(")
            e = self.expression()
            self.need(")")
            return e
        word = v.upper() if kind == "w" else ""
        if word in ("TRUE", "FALSE", "NULL"):
            self.next()
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[word])
        if word == "EXISTS" and self.peek(1)[1] in ("(", "{"):
            self.next()
            close = ")" if self.next() == "(" else "}"
            self.eat("MATCH")
            p = self.path()
            self.need(close)
            return ("exists", p)
        if kind == "w" and self.peek(1) == ("p", "("):
            f = self.next().lower()
            self.need("(")
            distinct = self.eat("DISTINCT")
            args = []
            if self.eat("*"):
                args = ["*"]
            while not self.eat(")"):
                args.append(self.expression())
                if not self.at(")"):
                    self.need(",")
            return ("call", f, args, distinct)
        name = self.name()
        return ("prop", name, self.name()) if self.eat(".") else ("var", name)


def has_aggregate(e) -> bool:
    if isinstance(e, tuple):
        return e[0] == "call" and e[1] in AGGREGATES or any(has_aggregate(x) for x in e[1:])
    return isinstance(e, list) and any(map(has_aggregate, e))


def text_of(e) -> str:
    """A column name for an expression without an alias."""
    match e:
        case ("prop", a, b):
            return f"{a}.{b}"
        case ("var", a):
            return a
        case ("lit", v):
            return repr(v)
        case ("call", f, args, distinct):
            return f"{f}({'DISTINCT ' if distinct else ''}{', '.join('*' if a == '*' else text_of(a) for a in args)})"
        case (op, a, b):
            return f"{text_of(a)} {op} {text_of(b)}"
    return str(e[0])


# --- lowering
class Rows:
    """Bound rows: a column for each variable, nodes and edges as structs."""

    def __init__(self, df: DataFrame | None, nodes: set[str], rels: set[str], values: set[str]):
        self.df, self.nodes, self.rels, self.values = df, nodes, rels, values


class Planner:
    def __init__(self, graph: PropertyGraph):
        self.nodes = node_table(graph)
        self.edges = graph.edges.select(F.struct(F.coalesce("idx", F.xxhash64("src", "dst", "label")).alias("idx"), F.col("label").alias("type"), "src", "dst", F.col("attrs.weight").alias("weight")).alias("e"))
        self.fresh = 0

    def name(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    def column(self, e, rows: Rows) -> Column:
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "list":
            return F.array(*[self.column(x, rows) for x in e[1]])
        if kind == "var":
            if e[1] not in rows.nodes | rows.rels | rows.values:
                raise CypherSyntax(f"{e[1]} is not defined")
            return F.col(f"`{e[1]}`.gid") if e[1] in rows.nodes else F.col(f"`{e[1]}`")
        if kind == "prop":
            if e[1] not in rows.nodes | rows.rels | rows.values:
                raise CypherSyntax(f"{e[1]} is not defined")
            return F.col(f"`{e[1]}`.`{e[2]}`")
        if kind == "null":
            return self.column(e[1], rows).isNull()
        if kind == "not":
            return ~self.column(e[1], rows)
        if kind == "neg":
            return -self.column(e[1], rows)
        if kind == "call":
            return self.call(e, rows)
        if kind == "in" and e[2][0] == "list":
            return self.column(e[1], rows).isin(*[x[1] for x in e[2][1]]) if all(x[0] == "lit" for x in e[2][1]) else F.array_contains(self.column(e[2], rows), self.column(e[1], rows))
        a, b = self.column(e[1], rows), self.column(e[2], rows)
        return {
            "or": lambda: a | b, "and": lambda: a & b, "xor": lambda: (a | b) & ~(a & b), "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), "starts": lambda: F.startswith(a, b), "ends": lambda: F.endswith(a, b), "contains": lambda: F.contains(a, b), "in": lambda: F.array_contains(b, a),
            "+": lambda: F.concat(a, b) if any(x[0] == "lit" and isinstance(x[1], str) for x in e[1:]) else a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }[kind]()

    def call(self, e, rows: Rows) -> Column:
        _, f, args, distinct = e
        if f == "count" and args == ["*"]:
            return F.count(F.lit(1))
        a = [self.column(x, rows) for x in args]
        if f == "count":
            return F.countDistinct(a[0]) if distinct else F.count(a[0])
        if f == "collect":
            return F.sort_array(F.collect_set(a[0]) if distinct else F.collect_list(a[0]))
        if f in ("sum", "avg", "min", "max"):
            return {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[f](a[0])
        if f == "labels":
            return F.array(F.col(f"`{args[0][1]}`.label"))
        simple = {"size": F.size, "tolower": F.lower, "toupper": F.upper, "abs": F.abs, "trim": F.trim, "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.cast("long"), "coalesce": F.coalesce, "length": F.char_length}
        if f == "type":
            return F.col(f"`{args[0][1]}`.type")
        if f == "id":
            return F.col(f"`{args[0][1]}`.gid")
        if f in simple:
            return simple[f](*a)
        raise Unsupported(f"function {f}")

    def scan(self, p: NodePattern, name: str) -> DataFrame:
        df = self.nodes.select(F.struct("*").alias(name))
        for label in p.labels:
            df = df.filter(F.col(f"`{name}`.label") == label)
        for key, value in p.props.items():
            df = df.filter(F.col(f"`{name}`.`{key}`") == self.column(value, Rows(None, set(), set(), set())))
        return df

    def hop(self, rows: Rows, start: str, rel: RelPattern, end: NodePattern, used: list[str]) -> str:
        """Adds a relationship and its other node to rows; gives the node's variable."""
        r, other = rel.name or self.name(), end.name or self.name()
        links = self.edges.filter(F.col("e.type").isin(*rel.types)) if rel.types else self.edges
        ends = self.nodes.select(F.struct("*").alias(other)) if other not in rows.nodes else None

        def step(df: DataFrame, at: Column, name: str) -> DataFrame:
            """df joined with one edge from the node id at; the id reached is _to."""
            out = links.select(F.col("e").alias(name), F.col("e.src").alias("_from"), F.col("e.dst").alias("_to"))
            into = links.select(F.col("e").alias(name), F.col("e.dst").alias("_from"), F.col("e.src").alias("_to"))
            both = out.unionByName(into.filter("_from <> _to"))
            e = {"out": out, "in": into, "both": both}[rel.direction]
            return df.join(e, at == F.col("_from")).drop("_from")

        df = rows.df
        if rel.hops is None:
            df = step(df, F.col(f"`{start}`.gid"), r)
            for key, value in rel.props.items():
                df = df.filter(F.col(f"`{r}`.`{key}`") == self.column(value, rows))
            for u in used:
                df = df.filter(F.col(f"`{u}`.idx") != F.col(f"`{r}`.idx"))
            used.append(r)
            rows.rels.add(r)
        else:
            low, high = rel.hops
            now = df.withColumn("_to", F.col(f"`{start}`.gid")).withColumn(r, F.array().cast("array<long>"))
            parts = [now] if low == 0 else []
            for k in itertools.count(1) if high is None else range(1, high + 1):
                if high is None:  # a path has each edge once, so that an open range comes to an end
                    now = storage.stored(now, "paths")
                    if storage.is_empty(now):
                        break
                now = now.withColumnRenamed("_to", "_at")
                now = step(now, F.col("_at"), "_e").filter(~F.array_contains(r, F.col("_e.idx"))).withColumn(r, F.concat(r, F.array("_e.idx"))).drop("_e", "_at")
                if k >= low:
                    parts.append(now)
            df = parts[0] if parts else now.limit(0)
            for p in parts[1:]:
                df = df.unionByName(p)
            rows.values.add(r)
        if ends is None:
            df = df.filter(F.col("_to") == F.col(f"`{other}`.gid")).drop("_to")
        else:
            for label in end.labels:
                ends = ends.filter(F.col(f"`{other}`.label") == label)
            for key, value in end.props.items():
                ends = ends.filter(F.col(f"`{other}`.`{key}`") == self.column(value, Rows(None, set(), set(), set())))
            df = df.join(ends, F.col("_to") == F.col(f"`{other}`.gid")).drop("_to")
            rows.nodes.add(other)
        rows.df = df
        return other

    @staticmethod
    def weight(p: NodePattern) -> int:
        """How selective a node pattern is: an end with properties or labels is a better start."""
        return 4 * len(p.props) + len(p.labels)

    def match(self, rows: Rows, paths: list[list], optional: bool = False, condition=None) -> Rows:
        before = rows
        if optional and rows.df is not None:
            key = self.name()
            base = rows.df.withColumn(key, F.monotonically_increasing_id())
            rows = Rows(base, set(rows.nodes), set(rows.rels), set(rows.values))
        used: list[str] = []
        for path in paths:
            first, last = path[0], path[-1]
            bound = lambda p: p.name is not None and p.name in rows.nodes  # noqa: B023, E731
            if len(path) > 1 and not bound(first) and (bound(last) or self.weight(last) > self.weight(first)):
                turn = {"out": "in", "in": "out", "both": "both"}
                path = [RelPattern(x.name, x.types, turn[x.direction], x.hops, x.props) if isinstance(x, RelPattern) else x for x in reversed(path)]
                first = path[0]
            start = first.name or self.name()
            if start not in rows.nodes:
                scan = self.scan(first, start)
                rows.df = scan if rows.df is None else rows.df.crossJoin(scan)
                rows.nodes.add(start)
            else:
                for label in first.labels:
                    rows.df = rows.df.filter(F.col(f"`{start}`.label") == label)
            for rel, node in zip(path[1::2], path[2::2], strict=True):
                start = self.hop(rows, start, rel, node, used)
        if condition is not None:
            rows = self.where(rows, condition)
        if optional and before.df is not None:
            new = [c for c in rows.df.columns if c not in base.columns]
            rows.df = base.join(rows.df.select(key, *[F.col(f"`{c}`") for c in new]), key, "left").drop(key)
        return rows

    def unwind(self, rows: Rows, e, name: str) -> Rows:
        """One row for each element of a list; none for an empty list or null."""
        if rows.df is None:
            rows.df = self.nodes.sparkSession.range(1).withColumnRenamed("id", self.name())
        rows.df = rows.df.withColumn(name, F.explode(self.column(e, rows)))
        rows.values.add(name)
        return rows

    def where(self, rows: Rows, e) -> Rows:
        """Filters; existence of patterns at the top of a conjunction becomes a semi- or anti-join."""
        if e[0] == "and":
            return self.where(self.where(rows, e[1]), e[2])
        negated = e[0] == "not" and e[1][0] == "exists"
        if e[0] == "exists" or negated:
            path = e[1][1] if negated else e[1]
            shared = [p.name for p in path[::2] if p.name in rows.nodes]
            if not shared:
                raise Unsupported("a pattern in WHERE needs a bound variable")
            found = self.match(Rows(None, set(), set(), set()), [path])
            cond = None
            right = found.df.select(*[F.col(f"`{n}`.gid").alias(f"_k{i}") for i, n in enumerate(shared)]).distinct()
            for i, n in enumerate(shared):
                c = F.col(f"`{n}`.gid") == F.col(f"_k{i}")
                cond = c if cond is None else cond & c
            rows.df = rows.df.join(right, cond, "left_anti" if negated else "left_semi")
        else:
            rows.df = rows.df.filter(self.column(e, rows))
        return rows

    def project(self, rows: Rows, items: list[tuple], distinct: bool, order: list[tuple], skip: int | None, limit: int | None, final: bool) -> Rows:
        if items == ["*"]:
            items = [(("var", n), n) for n in sorted(n for n in rows.nodes | rows.rels | rows.values if not n.startswith("_"))]
        keep_structs = not final
        nodes, rels, values = set(), set(), set()

        def value(e) -> Column:
            if keep_structs and e[0] == "var" and e[1] in rows.nodes | rows.rels:
                return F.col(f"`{e[1]}`")
            return self.column(e, rows)

        for e, name in items:
            if keep_structs and e[0] == "var" and e[1] in rows.nodes:
                nodes.add(name)
            elif keep_structs and e[0] == "var" and e[1] in rows.rels:
                rels.add(name)
            else:
                values.add(name)
        aggregated = any(has_aggregate(e) for e, _ in items)
        names = {text_of(e): n for e, n in items} | {n: n for _, n in items}
        hidden = []
        if aggregated:
            keys = [value(e).alias(n) for e, n in items if not has_aggregate(e)]
            df = rows.df.groupBy(*keys).agg(*[self.column(e, rows).alias(n) for e, n in items if has_aggregate(e)])
        else:
            extra = [(self.name(), e) for e, _ in order if text_of(e) not in names and not distinct]
            hidden = [n for n, _ in extra]
            names |= {text_of(e): n for n, e in extra}
            df = rows.df.select(*[value(e).alias(n) for e, n in items], *[self.column(e, rows).alias(n) for n, e in extra])
        df = df.select(*[F.col(f"`{n}`") for _, n in items], *[F.col(h) for h in hidden])
        if distinct:
            df = df.distinct()
        if order:
            after = Rows(df, nodes, rels, values)
            cols = [F.col(f"`{names[text_of(e)]}`") if text_of(e) in names else self.column(e, after) for e, _ in order]
            df = df.orderBy(*[c.desc() if down else c.asc() for c, (_, down) in zip(cols, order, strict=True)])
        if skip:
            df = df.offset(skip)
        if limit is not None:
            df = df.limit(limit)
        return Rows(df.drop(*hidden), nodes, rels, values)


def node_table(graph: PropertyGraph) -> DataFrame:
    """Nodes with the properties that queries see."""
    return graph.nodes.select(
        F.col("id").alias("gid"), "label", "name", "file", "parent", "exported", "attrs.signature", "attrs.jsdoc", F.when(F.col("attrs.params").isNotNull(), F.size("attrs.params")).alias("paramCount"),
        "attrs.returns", F.when(F.col("attrs.async"), True).alias("async"), F.nullif("attrs.lines", F.lit(0)).alias("lines"), F.nullif("attrs.complexity", F.lit(0)).alias("complexity"), F.col("loc.start").alias("locStart"), F.col("loc.end").alias("locEnd"),
    )


# op: Q11
def run(graph: PropertyGraph, text: str) -> DataFrame:
    """The rows that a query returns."""
    reader, planner = Reader(text), Planner(graph)

    def single() -> DataFrame:
        rows = Rows(None, set(), set(), set())
        while True:
            optional = reader.eat("OPTIONAL")
            if reader.eat("MATCH"):
                paths = [reader.path()]
                while reader.eat(","):
                    paths.append(reader.path())
                # After OPTIONAL MATCH a condition belongs to the optional part: it says what is found, not which rows stay.
                condition = reader.expression() if optional and reader.eat("WHERE") else None
                rows = planner.match(rows, paths, optional, condition)
            elif reader.eat("UNWIND"):
                e = reader.expression()
                reader.need("AS")
                rows = planner.unwind(rows, e, reader.name())
            elif reader.eat("WHERE"):
                rows = planner.where(rows, reader.expression())
            elif reader.at("WITH") or reader.at("RETURN"):
                final = reader.next().upper() == "RETURN"
                distinct, items = reader.eat("DISTINCT"), []
                if reader.eat("*"):
                    items = ["*"]
                else:
                    while True:
                        e = reader.expression()
                        items.append((e, reader.name() if reader.eat("AS") else text_of(e)))
                        if not reader.eat(","):
                            break
                order, skip, limit = [], None, None
                if reader.eat("ORDER", "BY"):
                    while True:
                        e = reader.expression()
                        down = reader.eat("DESC") or reader.eat("DESCENDING")
                        if not down:
                            reader.eat("ASC") or reader.eat("ASCENDING")
                        order.append((e, down))
                        if not reader.eat(","):
                            break
                if reader.eat("SKIP"):
                    skip = int(reader.next())
                if reader.eat("LIMIT"):
                    limit = int(reader.next())
                rows = planner.project(rows, items, distinct, order, skip, limit, final)
                if final:
                    return rows.df
            else:
                word = reader.peek()[1].upper()
                if word in WRITES:
                    raise Unsupported(f"{word} is not supported: queries only read")
                raise CypherSyntax(f"unexpected {reader.peek()[1] or 'end'!r}")

    df = single()
    while reader.eat("UNION"):
        every = reader.eat("ALL")
        df = df.union(single())
        df = df if every else df.distinct()
    reader.eat(";")
    if reader.peek()[0] != "end":
        raise CypherSyntax(f"unexpected {reader.peek()[1]!r}")
    return df
