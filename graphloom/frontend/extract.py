"""Facts of one source file, from its syntax tree: imports, exports, functions, classes, bindings, calls and edges.

Facts are met in post-order, children before parents, since a use sees only the names bound before it in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .lexer import SyntaxProblem
from .parser import parse

# Names that are no calls.
NO_CALLS = frozenset("if for while switch catch return typeof new require async await".split())
FUNCTIONS = ("ArrowFunctionExpression", "FunctionExpression")
_SKIP = frozenset(("type", "start", "end"))


def children(node: dict) -> Iterator[dict]:
    for key, value in node.items():
        if key in _SKIP:
            continue
        if isinstance(value, dict):
            if key in ("key", "property") and not node.get("computed") and value["type"] in ("Identifier", "PrivateIdentifier", "Literal"):
                continue
            yield value
        elif isinstance(value, list):
            yield from (x for x in value if isinstance(x, dict))


def post_order(node: dict) -> Iterator[tuple[dict, tuple[dict, ...]]]:
    """Each node after its children, with its ancestors, the outermost first."""
    stack = [(node, (), iter(list(children(node))))]
    while stack:
        now, above, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            yield now, above
        else:
            stack.append((step, (*above, now), iter(list(children(step)))))


# op: E9
def counts_as_branch(node: dict) -> bool:
    kind = node["type"]
    if kind in ("IfStatement", "CatchClause", "WhileStatement", "DoWhileStatement", "ForStatement", "ForInStatement", "ForOfStatement", "ConditionalExpression"):
        return True
    return kind == "SwitchCase" and node["test"] is not None or kind == "LogicalExpression" and node["operator"] in ("&&", "||")


def metrics(fn: dict) -> dict:
    """lines, complexity and calls of a function, nested ones included."""
    branches = calls = 0
    for node, _ in post_order(fn):
        branches += counts_as_branch(node)
        calls += node["type"] == "CallExpression" and node["callee"]["type"] in ("Identifier", "MemberExpression")
    return {"lines": fn["end"] - fn["start"] + 1, "complexity": 1 + branches, "calls": calls}


def name_of(node: dict | None) -> str | None:
    return node["name"] if node and node["type"] == "Identifier" else None


def owner_name(node: dict, methods: bool) -> str | None:
    """The name of a function that a declaration, a variable or (with methods) a class member gives."""
    if node["type"] == "FunctionDeclaration":
        return name_of(node["id"])
    if node["type"] == "VariableDeclarator" and node["init"] and node["init"]["type"] in FUNCTIONS:
        return name_of(node["id"])
    if methods and node["type"] == "MethodDefinition":
        return name_of(node["key"])
    return None


class Facts:
    """What one file says. resolve(specifier) gives the path of a project file, or None."""

    def __init__(self, path: str, tree: dict, lines: int, resolve: Callable[[str], str | None], public: Callable[[str, str], str | None]):
        self.path, self.lines, self.resolve, self.public = path, lines, resolve, public
        self.imports: list[dict] = []
        self.exports: list[dict] = []
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.bindings: dict[str, dict] = {}
        self.edges: dict[tuple, dict] = {}
        self.exported: set[str] = set()
        self.exposed: set[str] = set()
        self.scoped: list[tuple[str | None, str, int]] = []
        walk = list(post_order(tree))
        for node, above in walk:
            visit = getattr(self, f"on_{node['type']}", None)
            if visit:
                visit(node, above)
        for node, above in walk:
            if node["type"] == "ReturnStatement" and node["argument"]:
                self.returned(node["argument"], above)
            elif node["type"] == "CallExpression":
                self.scoped_call(node, above)

    # op: E1
    def edge(self, target: str, label: str, symbol: str, kind: str, to_label: str = "FILE", schema: str | None = None) -> dict:
        """The edge from this file to target, made once; it gathers distinct symbols."""
        e = self.edges.setdefault((self.path, target, label), {"src": self.path, "dst": target, "label": label, "src_label": "FILE", "dst_label": to_label, "resolved": True, "symbols": []})
        if all(s["name"] != symbol for s in e["symbols"]):
            e["symbols"].append({"name": symbol, "kind": kind, "schema": schema})
        return e

    def target(self, source) -> str | None:
        found = self.resolve(source) if isinstance(source, str) else None
        return found if found != self.path else None

    # op: E2
    def schema_name(self, name: str, file: str) -> str | None:
        return self.public(file, name)

    def bind(self, local: str, source: str, symbol: str, kind: str) -> None:
        self.bindings[local] = {"local": local, "source_file": source, "symbol_name": symbol, "kind": kind}

    # op: E3
    def on_ImportDeclaration(self, node, _):
        source = node["source"]["value"]
        target, known = self.target(source), self.resolve(source)
        for spec in node["specifiers"]:
            kind = spec["type"]
            name = {"ImportDefaultSpecifier": "default", "ImportNamespaceSpecifier": "*"}.get(kind) or spec["imported"].get("name") or spec["imported"].get("value")
            local = spec["local"].get("name") or spec["local"].get("value")
            self.imports.append({"name": name, "alias": local, "source": source, "isDefault": kind == "ImportDefaultSpecifier", "isDynamic": False, "isNamespace": kind == "ImportNamespaceSpecifier"})
            if target:
                self.bind(local, target, name, "import")
                self.edge(target, "IMPORT", name, "unknown", schema=self.schema_name(name, target))
            elif not known and source.startswith("."):
                self.edge(source, "IMPORT", name, "unknown")["resolved"] = False

    # op: E4
    def on_ImportExpression(self, node, _):
        source = node["source"].get("value") if node["source"]["type"] == "Literal" else None
        if isinstance(source, str):
            self.imports.append({"name": "*", "alias": "*", "source": source, "isDefault": False, "isDynamic": True, "isNamespace": True})
            if target := self.target(source):
                self.edge(target, "DYNAMIC_IMPORT", "*", "namespace")

    # op: E5
    def on_ExportNamedDeclaration(self, node, _):
        names = [s["exported"].get("name") or s["exported"].get("value") for s in node["specifiers"]]
        self.exported.update(names)
        if node["source"]:
            source = node["source"]["value"]
            target = self.target(source)
            for name in names:
                self.exports.append({"name": name, "type": "reexport", "source": source})
                if target:
                    self.edge(target, "REEXPORT", name, "unknown", schema=self.schema_name(name, target))
            return
        d = node["declaration"]
        if d and d["type"] in ("FunctionDeclaration", "ClassDeclaration"):
            self.exported.add(d["id"]["name"])
            self.exports.append({"name": d["id"]["name"], "type": "function" if d["type"][0] == "F" else "class", "source": None})
        elif d and d["type"] == "VariableDeclaration":
            for v in d["declarations"]:
                if name := name_of(v["id"]):
                    self.exported.add(name)
                    self.exports.append({"name": name, "type": d["kind"], "source": None})
        self.exports += [{"name": n, "type": "const", "source": None} for n in names]

    # op: E6
    def on_ExportDefaultDeclaration(self, node, _):
        d = node["declaration"]
        name = name_of(d.get("id")) or "default"
        self.exported |= {name, "default"}
        self.exports.append({"name": name, "type": {"FunctionDeclaration": "function", "ClassDeclaration": "class"}.get(d["type"], "default"), "source": None})

    # op: E7
    def on_ExportAllDeclaration(self, node, _):
        e = node["exported"]
        name, source = (e.get("name") or e.get("value")) if e else "*", node["source"]["value"]
        self.exports.append({"name": name, "type": "reexport", "source": source})
        if target := self.target(source):
            self.edge(target, "REEXPORT", name, "unknown")

    # op: E8
    def function(self, name: str, fn: dict, span: dict, arrow: bool = False) -> None:
        self.functions.append({"name": name, "isExported": False, "isAsync": fn["async"], "isArrow": arrow, "paramCount": len(fn["params"]), **metrics(fn), "loc": {"start": span["start"], "end": span["end"]}})

    def on_FunctionDeclaration(self, node, _):
        if name := name_of(node["id"]):
            self.function(name, node, node)

    def on_FunctionExpression(self, node, _):
        if name := name_of(node["id"]):
            self.function(name, node, node)

    def on_MethodDefinition(self, node, _):
        if name := name_of(node["key"]):
            self.function(name, node["value"], node)

    # op: E10
    def on_VariableDeclarator(self, node, _):
        init, local = node["init"], name_of(node["id"])
        if not init:
            return
        if local and init["type"] in FUNCTIONS:
            self.function(local, init, init, init["type"] == "ArrowFunctionExpression")
            return
        made = self.bindings.get(name_of(init.get("callee")) or "")
        kind = node["id"]["type"]
        if made is None:
            return
        if local and init["type"] == "CallExpression":
            self.bind(local, made["source_file"], init["callee"]["name"], "factory_instance")
        elif kind == "ObjectPattern" and init["type"] == "CallExpression":
            for p in node["id"]["properties"]:
                if key := name_of(p.get("key")):
                    self.bind(key, made["source_file"], key, "destructure")
        elif kind == "ArrayPattern":
            for x in node["id"]["elements"]:
                if name := name_of(x):
                    self.bind(name, made["source_file"], name, "array_destructure")

    # op: E11
    def on_AssignmentExpression(self, node, _):
        right = self.bindings.get(name_of(node["right"]) or "")
        if right and (left := name_of(node["left"])):
            self.bind(left, right["source_file"], right["symbol_name"], "reassignment")

    # op: E12
    def extends(self, node) -> str | None:
        above = name_of(node["superClass"])
        if above and (b := self.bindings.get(above)):
            self.edge(b["source_file"], "EXTEND", above, "class", schema=self.schema_name(above, b["source_file"]))
        return above

    def on_ClassDeclaration(self, node, _):
        methods = [m["key"]["name"] for m in node["body"]["body"] if m["type"] == "MethodDefinition" and name_of(m["key"])]
        above = self.extends(node)
        if node["id"]:
            self.classes.append({"name": node["id"]["name"], "isExported": False, "extends": above, "methods": methods})

    def on_ClassExpression(self, node, _):
        self.extends(node)

    def on_CallExpression(self, node, _):
        callee, args = node["callee"], node["arguments"]
        # op: E13
        if name_of(callee) == "require" and args and args[0]["type"] == "Literal":
            if target := self.target(args[0]["value"]):
                self.edge(target, "REQUIRE", "*", "namespace")
            return
        if callee["type"] != "MemberExpression":
            return
        on, method = name_of(callee["object"]), name_of(callee["property"])
        b = self.bindings.get(on or "")
        if b is None or method is None:
            return
        # op: E14
        if method in ("call", "apply", "bind"):
            self.edge(f"{b['source_file']}::{on}", "CALL_INDIRECT", on, "unknown", "FUNCTION")
        # op: E15
        self.edge(f"{b['source_file']}::{method}", "CALL", method, "unknown", "FUNCTION", self.schema_name(method, b["source_file"]))

    # op: E16
    def on_NewExpression(self, node, _):
        name = name_of(node["callee"])
        if name and (b := self.bindings.get(name)):
            self.edge(f"{b['source_file']}::{name}", "CALL", name, "class", "CLASS", self.schema_name(name, b["source_file"]))

    def on_TaggedTemplateExpression(self, node, _):
        name = name_of(node["tag"])
        if name and (b := self.bindings.get(name)):
            self.edge(f"{b['source_file']}::{name}", "CALL", name, "function", "FUNCTION", self.schema_name(name, b["source_file"]))

    def on_SpreadElement(self, node, _):
        b = self.bindings.get(name_of(node["argument"]) or "")
        if b and b["kind"] in ("import", "factory_instance"):
            self.edge(b["source_file"], "CALL", b["symbol_name"], "unknown")

    # op: E17
    def returned(self, value: dict, above: tuple[dict, ...]) -> None:
        """What an exported function gives out: names of a returned object, methods of a returned instance, properties put on a returned variable."""
        name = next((n for a in reversed(above) if (n := owner_name(a, methods=False))), None)
        if name not in self.exported:
            return
        if value["type"] == "ObjectExpression":
            self.exposed.update(k for p in value["properties"] if (k := name_of(p.get("key"))))
        elif value["type"] == "NewExpression":
            of = name_of(value["callee"])
            self.exposed.update(next((c["methods"] for c in self.classes if c["name"] == of), ()))
        elif value["type"] == "Identifier":
            body = next((a["body"]["body"] for a in reversed(above) if a["type"] in ("FunctionDeclaration", *FUNCTIONS) and a["body"]["type"] == "BlockStatement"), ())
            for s in body:
                e = s.get("expression") or {}
                left = e.get("left") if s["type"] == "ExpressionStatement" and e.get("type") == "AssignmentExpression" else None
                if left and left["type"] == "MemberExpression" and name_of(left["object"]) == value["name"] and (p := name_of(left["property"])):
                    self.exposed.add(p)

    # op: E18
    def scoped_call(self, node: dict, above: tuple[dict, ...]) -> None:
        callee = node["callee"]
        name = name_of(callee) or (name_of(callee["property"]) if callee["type"] == "MemberExpression" else None)
        if name and name not in NO_CALLS:
            caller = next((n for a in reversed(above) if (n := owner_name(a, methods=True))), None)
            self.scoped.append((caller, name, node["start"]))

    def rows(self) -> dict:
        """All facts, with edges in the order in which they came up. dst_label of scoped calls is left open (null)."""
        out, known = list(self.edges.values()), dict(self.edges)
        one = lambda a, b, label, la, lb, s: {"src": a, "dst": b, "label": label, "src_label": la, "dst_label": lb, "resolved": True, "symbols": [s]}
        for f in self.functions:
            f["isExported"] = f["name"] in self.exported or f["name"] in self.exposed
            out.append(one(self.path, f"{self.path}::{f['name']}", "CONTAINS", "FILE", "FUNCTION", {"name": f["name"], "kind": "function", "schema": None}))
        for c in self.classes:
            c["isExported"] = c["name"] in self.exported
            at = f"{self.path}::{c['name']}"
            out.append(one(self.path, at, "CONTAINS", "FILE", "CLASS", {"name": c["name"], "kind": "class", "schema": None}))
            out += [one(at, f"{at}.{m}", "METHOD_OF", "CLASS", "METHOD", {"name": m, "kind": None, "schema": None}) for m in c["methods"]]
        # op: E20
        for caller, name, line in self.scoped:
            b = self.bindings.get(name)
            if b is None:
                continue
            src, dst = (f"{self.path}::{caller}" if caller else self.path), f"{b['source_file']}::{b['symbol_name']}"
            e = known.get((src, dst, "CALL"))
            if e is None:
                e = known[src, dst, "CALL"] = {"src": src, "dst": dst, "label": "CALL", "src_label": "FUNCTION" if caller else "FILE", "dst_label": None, "resolved": True, "symbols": [], "line": line}
                out.append(e)
            if all(s["name"] != name for s in e["symbols"]):
                e["symbols"].append({"name": name, "kind": "unknown", "schema": self.schema_name(name, b["source_file"])})
        # op: E21
        calls = list(dict.fromkeys(n for _, n, _ in self.scoped))
        return {"imports": self.imports, "exports": self.exports, "functions": self.functions, "classes": self.classes, "calls": calls, "bindings": list(self.bindings.values()), "edges": [{**e, "k": k} for k, e in enumerate(out)]}


def without_shebang(text: str) -> str:
    """Blanked, so that lines stay."""
    return "//" + text[2:] if text.startswith("#!") else text


def specifiers(text: str) -> tuple[list[str], str | None]:
    """The specifiers that a file imports from, and why it could not be read."""
    try:
        tree = parse(without_shebang(text))
    except SyntaxProblem as e:
        return [], str(e)
    found = []
    for node, _ in post_order(tree):
        source = node.get("source")
        if isinstance(source, dict) and source["type"] == "Literal":
            found.append(source.get("value"))
        elif node["type"] == "CallExpression" and name_of(node["callee"]) == "require" and node["arguments"] and node["arguments"][0]["type"] == "Literal":
            found.append(node["arguments"][0]["value"])
    return list(dict.fromkeys(x for x in found if isinstance(x, str))), None


# op: S4
def extract(path: str, text: str, resolved: dict[str, str], public: dict[str, list[str]]) -> dict:
    """The facts of a file, or only its line count and the problem."""
    code = without_shebang(text)
    lines = code.count("\n") + 1
    empty = {"imports": [], "exports": [], "functions": [], "classes": [], "calls": [], "bindings": [], "edges": []}
    try:
        tree = parse(code)
    except SyntaxProblem as e:
        return {**empty, "lines": lines, "error": str(e)}
    facts = Facts(path, tree, lines, resolved.get, lambda f, n: n if n in public.get(f, ()) else None)
    return {**facts.rows(), "lines": lines, "error": None}
