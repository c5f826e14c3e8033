"""A recursive-descent parser of ECMAScript 2022 modules.

Nodes are dictionaries with the public ESTree names; start and end are lines. Children stand in source order.
"""

from __future__ import annotations

import sys

from .lexer import TEMPLATE, Lexer, SyntaxProblem, Token, unescaped

BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
UNARY = frozenset("! ~ + - typeof void delete".split())
RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())


class Parser:
    def __init__(self, code: str):
        self.lex = Lexer(code)
        self.code = code
        self.no_in = False
        self.last_line = 1
        self.last_end = 0
        self.t: Token = self.lex.token(0)

    # --- tokens
    def next(self) -> Token:
        t = self.t
        self.last_line, self.last_end = self.lex.line_at(max(t.start, t.end - 1)), t.end
        self.t = self.lex.token(t.end)
        return t

    def save(self):
        return self.t, self.last_line, self.last_end, self.no_in

    def restore(self, s) -> None:
        self.t, self.last_line, self.last_end, self.no_in = s

    def peek(self) -> Token:
        return self.lex.token(self.t.end)

    def at(self, value: str) -> bool:
        return self.t.value == value and self.t.kind in ("punct", "name")

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.next()
            return True
        return False

    def need(self, value: str) -> Token:
        if not self.at(value):
            self.fail(f"expected {value}")
        return self.next()

    def fail(self, why: str = "unexpected token"):
        raise SyntaxProblem(f"line {self.t.line}: {why}, found {self.t.value or 'the end'!r}")

    def semicolon(self) -> None:
        if self.eat(";") or self.at("}") or self.t.kind == "end" or self.t.after_newline:
            return
        self.fail("expected ;")

    def node(self, type_: str, start: int, /, **fields) -> dict:
        return {"type": type_, "start": start, "end": self.last_line, **fields}

    # --- program and statements
    def program(self) -> dict:
        body = []
        while self.t.kind != "end":
            body.append(self.statement(top=True))
        return self.node("Program", 1, body=body)

    def block(self) -> dict:
        start = self.need("{").line
        body = []
        while not self.at("}"):
            if self.t.kind == "end":
                self.fail("expected }")
            body.append(self.statement())
        self.next()
        return self.node("BlockStatement", start, body=body)

    def statement(self, top: bool = False) -> dict:
        t, start = self.t, self.t.line
        v = t.value
        if t.kind == "punct":
            if v == "{":
                return self.block()
            if v == ";":
                self.next()
                return self.node("EmptyStatement", start)
            if v == "@":
                self.decorators()
                return self.statement(top)
        if t.kind == "name":
            if v in ("var", "const") or v == "let" and (self.peek().kind == "name" and self.peek().value not in ("in", "instanceof", "of") or self.peek().value in ("{", "[")):
                d = self.variables()
                self.semicolon()
                d["end"] = self.last_line
                return d
            if v == "function" or v == "async" and self.peek().value == "function" and not self.peek().after_newline:
                return self.function("FunctionDeclaration")
            if v == "class":
                return self.klass("ClassDeclaration")
            if v == "import" and self.peek().value not in ("(", "."):
                return self.import_()
            if v == "export":
                return self.export()
            method = getattr(self, f"s_{v}", None)
            if method:
                return method()
            if self.peek().value == ":" and v not in RESERVED:
                label = self.identifier()
                self.next()
                return self.node("LabeledStatement", start, label=label, body=self.statement())
        e = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, expression=e)

    def paren(self) -> dict:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def s_if(self):
        start = self.next().line
        test = self.paren()
        yes = self.statement()
        no = self.statement() if self.eat("else") else None
        return self.node("IfStatement", start, test=test, consequent=yes, alternate=no)

    def s_for(self):
        start = self.next().line
        self.eat("await")
        self.need("(")
        init = None
        if not self.at(";"):
            self.no_in = True
            if self.t.value in ("var", "const") or self.at("let") and (self.peek().kind == "name" and self.peek().value not in ("in", "of") or self.peek().value in ("{", "[")):
                init = self.variables()
            else:
                init = self.expression()
            self.no_in = False
            if self.at("of") or self.at("in"):
                kind = "ForOfStatement" if self.next().value == "of" else "ForInStatement"
                right = self.expression()
                self.need(")")
                return self.node(kind, start, left=init, right=right, body=self.statement())
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        update = None if self.at(")") else self.expression()
        self.need(")")
        return self.node("ForStatement", start, init=init, test=test, update=update, body=self.statement())

    def s_while(self):
        start = self.next().line
        return self.node("WhileStatement", start, test=self.paren(), body=self.statement())

    def s_do(self):
        start = self.next().line
        body = self.statement()
        self.need("while")
        test = self.paren()
        self.eat(";")
        return self.node("DoWhileStatement", start, body=body, test=test)

    def s_return(self):
        start = self.next().line
        e = None if self.at(";") or self.at("}") or self.t.kind == "end" or self.t.after_newline else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", start, argument=e)

    def s_throw(self):
        start = self.next().line
        e = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", start, argument=e)

    def s_break(self):
        start, kind = self.t.line, "BreakStatement" if self.next().value == "break" else "ContinueStatement"
        label = self.identifier() if self.t.kind == "name" and not self.t.after_newline and self.t.value not in RESERVED else None
        self.semicolon()
        return self.node(kind, start, label=label)

    s_continue = s_break

    def s_debugger(self):
        start = self.next().line
        self.semicolon()
        return self.node("DebuggerStatement", start)

    def s_try(self):
        start = self.next().line
        block, handler, final = self.block(), None, None
        if self.at("catch"):
            at = self.next().line
            param = None
            if self.eat("("):
                param = self.binding()
                self.need(")")
            handler = {"type": "CatchClause", "start": at, "param": param, "body": self.block(), "end": self.last_line}
        if self.eat("finally"):
            final = self.block()
        return self.node("TryStatement", start, block=block, handler=handler, finalizer=final)

    def s_switch(self):
        start = self.next().line
        e = self.paren()
        self.need("{")
        cases = []
        while not self.eat("}"):
            at = self.t.line
            test = None
            if not self.eat("default"):
                self.need("case")
                test = self.expression()
            self.need(":")
            body = []
            while not (self.at("case") or self.at("default") or self.at("}")):
                body.append(self.statement())
            cases.append(self.node("SwitchCase", at, test=test, consequent=body))
        return self.node("SwitchStatement", start, discriminant=e, cases=cases)

    def variables(self) -> dict:
        start, kind = self.t.line, self.next().value
        decls = []
        while True:
            at = self.t.line
            target = self.binding()
            init = self.assignment() if self.eat("=") else None
            decls.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.eat(","):
                break
        return self.node("VariableDeclaration", start, kind=kind, declarations=decls)

    # --- modules
    def module_name(self) -> dict:
        return self.string() if self.t.kind == "string" else self.identifier(any_word=True)

    def string(self) -> dict:
        if self.t.kind != "string":
            self.fail("expected a string")
        t = self.next()
        return self.node("Literal", t.line, value=unescaped(t.value[1:-1]))

    def attributes(self) -> None:
        if self.at("with") or self.at("assert") and not self.t.after_newline:
            self.next()
            self.object_()

    def import_(self) -> dict:
        start = self.next().line
        specs = []
        if self.t.kind != "string":
            if self.t.kind == "name":
                at = self.t.line
                specs.append(self.node("ImportDefaultSpecifier", at, local=self.identifier()))
                self.eat(",")
            if self.at("*"):
                at = self.next().line
                self.need("as")
                specs.append(self.node("ImportNamespaceSpecifier", at, local=self.identifier()))
            elif self.eat("{"):
                while not self.eat("}"):
                    at = self.t.line
                    name = self.module_name()
                    local = self.identifier() if self.eat("as") else name
                    specs.append(self.node("ImportSpecifier", at, imported=name, local=local))
                    if not self.at("}"):
                        self.need(",")
            self.need("from")
        source = self.string()
        self.attributes()
        self.semicolon()
        return self.node("ImportDeclaration", start, specifiers=specs, source=source)

    def export(self) -> dict:
        start = self.next().line
        if self.eat("*"):
            name = self.module_name() if self.eat("as") else None
            self.need("from")
            source = self.string()
            self.attributes()
            self.semicolon()
            return self.node("ExportAllDeclaration", start, exported=name, source=source)
        if self.eat("default"):
            if self.at("@"):
                self.decorators()
            if self.at("function") or self.at("async") and self.peek().value == "function" and not self.peek().after_newline:
                d = self.function("FunctionDeclaration", optional=True)
            elif self.at("class"):
                d = self.klass("ClassDeclaration", optional=True)
            else:
                d = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", start, declaration=d)
        if self.eat("{"):
            specs = []
            while not self.eat("}"):
                at = self.t.line
                local = self.module_name()
                exported = self.module_name() if self.eat("as") else local
                specs.append(self.node("ExportSpecifier", at, local=local, exported=exported))
                if not self.at("}"):
                    self.need(",")
            source = None
            if self.eat("from"):
                source = self.string()
                self.attributes()
            self.semicolon()
            return self.node("ExportNamedDeclaration", start, declaration=None, specifiers=specs, source=source)
        return self.node("ExportNamedDeclaration", start, declaration=self.statement(), specifiers=[], source=None)

    # --- patterns
    def identifier(self, any_word: bool = False) -> dict:
        if self.t.kind != "name" or not any_word and self.t.value in RESERVED:
            self.fail("expected a name")
        t = self.next()
        return self.node("Identifier", t.line, name=unescaped(t.value))

    def binding(self) -> dict:
        start = self.t.line
        if self.eat("["):
            items = []
            while not self.eat("]"):
                if self.at(","):
                    self.next()
                    items.append(None)
                    continue
                items.append(self.rest() if self.at("...") else self.with_default())
                if not self.at("]"):
                    self.need(",")
            return self.node("ArrayPattern", start, elements=items)
        if self.eat("{"):
            props = []
            while not self.eat("}"):
                at = self.t.line
                if self.at("..."):
                    props.append(self.rest())
                else:
                    computed = self.at("[")
                    key = self.property_key()
                    if self.eat(":"):
                        value = self.with_default()
                    else:
                        value = key
                        if self.eat("="):
                            value = self.node("AssignmentPattern", at, left=key, right=self.assignment())
                    props.append(self.node("Property", at, key=key, computed=computed, value=value, kind="init"))
                if not self.at("}"):
                    self.need(",")
            return self.node("ObjectPattern", start, properties=props)
        return self.identifier()

    def rest(self) -> dict:
        start = self.next().line
        return self.node("RestElement", start, argument=self.binding())

    def with_default(self) -> dict:
        start = self.t.line
        target = self.binding()
        return self.node("AssignmentPattern", start, left=target, right=self.with_in(self.assignment)) if self.eat("=") else target

    def params(self) -> list[dict]:
        self.need("(")
        out = []
        while not self.eat(")"):
            if self.at("@"):
                self.decorators()
            out.append(self.rest() if self.at("...") else self.with_default())
            if not self.at(")"):
                self.need(",")
        return out

    # --- functions and classes
    def with_in(self, f):
        old, self.no_in = self.no_in, False
        try:
            return f()
        finally:
            self.no_in = old

    def function(self, kind: str, optional: bool = False) -> dict:
        start = self.t.line
        is_async = self.eat("async")
        self.need("function")
        generator = self.eat("*")
        name = None
        if self.t.kind == "name" and not self.at("("):
            name = self.identifier()
        elif kind == "FunctionDeclaration" and not optional:
            self.fail("expected a name")
        params = self.with_in(self.params)
        body = self.with_in(self.block)
        return self.node(kind, start, id=name, params=params, body=body, **{"async": is_async}, generator=generator)

    def method(self, start: int, is_async: bool = False, generator: bool = False) -> dict:
        params = self.with_in(self.params)
        body = self.with_in(self.block)
        return self.node("FunctionExpression", start, id=None, params=params, body=body, **{"async": is_async}, generator=generator)

    def decorators(self) -> None:
        while self.eat("@"):
            self.postfix()

    def klass(self, kind: str, optional: bool = False) -> dict:
        start = self.next().line
        name = self.identifier() if self.t.kind == "name" and not self.at("extends") else None
        if name is None and kind == "ClassDeclaration" and not optional:
            self.fail("expected a name")
        above = self.postfix() if self.eat("extends") else None
        at = self.need("{").line
        members = []
        while not self.eat("}"):
            if self.eat(";"):
                continue
            members.append(self.with_in(self.member))
        return self.node(kind, start, id=name, superClass=above, body=self.node("ClassBody", at, body=members))

    def member(self) -> dict:
        self.decorators()
        start, static, is_async, generator, kind = self.t.line, False, False, False, "method"

        def modifier(word: str) -> bool:
            if self.at(word) and self.t.kind == "name" and self.peek().value not in ("(", "=", ";", "}", ",") and not (word != "static" and self.peek().after_newline):
                self.next()
                return True
            return False

        static = modifier("static")
        if static and self.at("{"):
            return self.node("StaticBlock", start, body=self.block()["body"])
        is_async = modifier("async")
        generator = self.eat("*")
        if not is_async and not generator:
            for word in ("get", "set"):
                if modifier(word):
                    kind = word
                    break
        computed = self.at("[")
        key = self.property_key()
        if self.at("("):
            value = self.method(self.t.line, is_async, generator)
            if not static and key["type"] == "Identifier" and key["name"] == "constructor":
                kind = "constructor"
            return self.node("MethodDefinition", start, key=key, computed=computed, value=value, kind=kind, static=static)
        value = self.assignment() if self.eat("=") else None
        self.semicolon()
        return self.node("PropertyDefinition", start, key=key, computed=computed, value=value, static=static)

    def property_key(self) -> dict:
        if self.eat("["):
            e = self.with_in(self.assignment)
            self.need("]")
            return e
        t = self.t
        if t.kind == "string":
            return self.string()
        if t.kind == "number":
            self.next()
            return self.node("Literal", t.line, value=t.value)
        if t.kind == "private":
            self.next()
            return self.node("PrivateIdentifier", t.line, name=t.value[1:])
        return self.identifier(any_word=True)

    # --- expressions
    def expression(self) -> dict:
        start = self.t.line
        e = self.assignment()
        if self.at(","):
            items = [e]
            while self.eat(","):
                items.append(self.assignment())
            return self.node("SequenceExpression", start, expressions=items)
        return e

    def arrow(self, start: int, params: list[dict], is_async: bool) -> dict:
        self.need("=>")
        old = self.no_in
        if self.at("{"):
            body = self.with_in(self.block)
        else:
            body = self.assignment()
        self.no_in = old
        return self.node("ArrowFunctionExpression", start, params=params, body=body, **{"async": is_async}, generator=False, expression=body["type"] != "BlockStatement")

    def try_arrow(self) -> dict | None:
        """An arrow function, if one begins here."""
        start, t = self.t.line, self.t
        is_async = t.kind == "name" and t.value == "async" and not self.peek().after_newline and (self.peek().value == "(" or self.peek().kind == "name" and self.peek().value not in ("function", "in", "of", "instanceof"))
        if t.kind == "name" and not is_async:
            if t.value not in RESERVED and self.peek().value == "=>" and not self.peek().after_newline:
                return self.arrow(start, [self.identifier()], False)
            return None
        if not is_async and not self.at("("):
            return None
        saved = self.save()
        try:
            if is_async:
                self.next()
            params = [self.identifier()] if self.t.kind == "name" else self.with_in(self.params)
            if not self.at("=>") or self.t.after_newline:
                raise SyntaxProblem("no arrow")
        except SyntaxProblem:
            self.restore(saved)
            return None
        return self.arrow(start, params, is_async)

    def assignment(self) -> dict:
        start = self.t.line
        if self.at("yield") and self.t.kind == "name":
            self.next()
            star = self.eat("*")
            ends = self.t.after_newline or self.t.kind == "end" or self.t.value in (")", "]", "}", ",", ";", ":") and self.t.kind == "punct"
            return self.node("YieldExpression", start, argument=None if ends and not star else self.assignment(), delegate=star)
        found = self.try_arrow()
        if found is not None:
            return found
        left = self.conditional()
        if self.t.kind == "punct" and self.t.value in ASSIGN:
            op = self.next().value
            left = self.as_pattern(left) if op == "=" else left
            return self.node("AssignmentExpression", start, operator=op, left=left, right=self.assignment())
        return left

    def as_pattern(self, e: dict) -> dict:
        """An expression on the left of an assignment, read as a pattern."""
        if e["type"] == "ArrayExpression":
            return {**e, "type": "ArrayPattern", "elements": [x and self.as_pattern(x) for x in e["elements"]]}
        if e["type"] == "ObjectExpression":
            return {**e, "type": "ObjectPattern", "properties": [{**p, "value": self.as_pattern(p["value"])} if p["type"] == "Property" else self.as_pattern(p) for p in e["properties"]]}
        if e["type"] == "SpreadElement":
            return {**e, "type": "RestElement", "argument": self.as_pattern(e["argument"])}
        if e["type"] == "AssignmentExpression":
            return {**{k: v for k, v in e.items() if k != "operator"}, "type": "AssignmentPattern"}
        return e

    def conditional(self) -> dict:
        start = self.t.line
        test = self.binary(0)
        if not self.eat("?"):
            return test
        yes = self.with_in(self.assignment)
        self.need(":")
        return self.node("ConditionalExpression", start, test=test, consequent=yes, alternate=self.assignment())

    def binary(self, least: int) -> dict:
        start = self.t.line
        if self.t.kind == "private" and self.peek().value == "in":
            t = self.next()
            left = self.node("PrivateIdentifier", t.line, name=t.value[1:])
        else:
            left = self.unary()
        while True:
            op = self.t.value
            level = BINARY.get(op, 0) if self.t.kind in ("punct", "name") else 0
            if not level or level <= least or op == "in" and self.no_in:
                return left
            self.next()
            right = self.binary(level - 1 if op == "**" else level)
            left = self.node("LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression", start, operator=op, left=left, right=right)

    def unary(self) -> dict:
        t, start = self.t, self.t.line
        if t.kind in ("punct", "name"):
            if t.value in UNARY:
                self.next()
                return self.node("UnaryExpression", start, operator=t.value, argument=self.unary())
            if t.value in ("++", "--"):
                self.next()
                return self.node("UpdateExpression", start, operator=t.value, prefix=True, argument=self.unary())
            if t.value == "await" and (self.peek().kind != "punct" or self.peek().value in ("(", "[", "{", "!", "+", "-", "/") or self.peek().kind == "template"):
                saved = self.save()
                try:
                    self.next()
                    return self.node("AwaitExpression", start, argument=self.unary())
                except SyntaxProblem:
                    self.restore(saved)
        e = self.postfix()
        if self.t.kind == "punct" and self.t.value in ("++", "--") and not self.t.after_newline:
            return self.node("UpdateExpression", start, operator=self.next().value, prefix=False, argument=e)
        return e

    def arguments(self) -> list[dict]:
        self.need("(")
        out = []
        while not self.eat(")"):
            out.append(self.with_in(self.spread))
            if not self.at(")"):
                self.need(",")
        return out

    def spread(self) -> dict:
        if self.at("..."):
            start = self.next().line
            return self.node("SpreadElement", start, argument=self.assignment())
        return self.assignment()

    def postfix(self, calls: bool = True) -> dict:
        start = self.t.line
        e = self.new() if self.at("new") else self.primary()
        chained = False
        while True:
            t = self.t
            if t.kind == "template":
                e = self.node("TaggedTemplateExpression", start, tag=e, quasi=self.template())
                continue
            if t.kind != "punct":
                break
            if t.value == "?." and calls:
                self.next()
                chained = True
                if self.at("("):
                    e = self.node("CallExpression", start, callee=e, arguments=self.arguments(), optional=True)
                    continue
                if self.at("["):
                    e = self.index(e, start)
                    continue
                if self.t.kind == "template":
                    continue
                e = self.node("MemberExpression", start, object=e, property=self.property_name(), computed=False)
            elif t.value == ".":
                self.next()
                e = self.node("MemberExpression", start, object=e, property=self.property_name(), computed=False)
            elif t.value == "[":
                e = self.index(e, start)
            elif t.value == "(" and calls:
                e = self.node("CallExpression", start, callee=e, arguments=self.arguments())
            else:
                break
        return self.node("ChainExpression", start, expression=e) if chained else e

    def property_name(self) -> dict:
        if self.t.kind == "private":
            t = self.next()
            return self.node("PrivateIdentifier", t.line, name=t.value[1:])
        return self.identifier(any_word=True)

    def index(self, e: dict, start: int) -> dict:
        self.need("[")
        p = self.with_in(self.expression)
        self.need("]")
        return self.node("MemberExpression", start, object=e, property=p, computed=True)

    def new(self) -> dict:
        start = self.next().line
        if self.eat("."):
            return self.node("MetaProperty", start, property=self.identifier(any_word=True))
        callee = self.postfix(calls=False)
        args = self.arguments() if self.at("(") else []
        return self.node("NewExpression", start, callee=callee, arguments=args)

    def template(self) -> dict:
        start = self.t.line
        at = self.t.end
        quasis, parts = [], []
        while True:
            m = TEMPLATE.match(self.code, at)
            quasis.append(m[0])
            at = m.end()
            if self.code.startswith("${", at):
                self.t = self.lex.token(at + 2)
                parts.append(self.with_in(self.expression))
                if not self.at("}"):
                    self.fail("expected }")
                at = self.t.end
            elif self.code.startswith("`", at):
                end = at + 1
                self.last_line, self.last_end = self.lex.line_at(at), end
                self.t = self.lex.token(end)
                return self.node("TemplateLiteral", start, quasis=quasis, expressions=parts)
            else:
                self.fail("unterminated template")

    def primary(self) -> dict:
        t, start = self.t, self.t.line
        if t.kind == "number":
            self.next()
            return self.node("Literal", start, value=t.value)
        if t.kind == "string":
            return self.string()
        if t.kind == "template":
            return self.template()
        if t.kind == "punct":
            if t.value == "(":
                self.next()
                e = self.with_in(self.expression)
                self.need(")")
                return e
            if t.value == "[":
                return self.array()
            if t.value == "{":
                return self.object_()
            if t.value in ("/", "/="):
                self.t = self.lex.regex(t)
                self.next()
                return self.node("Literal", start, value=None, regex=True)
            if t.value == "@":
                self.decorators()
                return self.klass("ClassExpression")
            self.fail()
        if t.kind != "name":
            self.fail()
        v = t.value
        if v == "function" or v == "async" and self.peek().value == "function" and not self.peek().after_newline:
            return self.function("FunctionExpression")
        if v == "class":
            return self.klass("ClassExpression")
        if v == "import":
            self.next()
            if self.eat("."):
                return self.node("MetaProperty", start, property=self.identifier(any_word=True))
            self.need("(")
            source = self.with_in(self.assignment)
            if self.eat(",") and not self.at(")"):
                self.with_in(self.assignment)
                self.eat(",")
            self.need(")")
            return self.node("ImportExpression", start, source=source)
        if v in ("this", "super"):
            self.next()
            return self.node("ThisExpression" if v == "this" else "Super", start)
        if v in ("null", "true", "false"):
            self.next()
            return self.node("Literal", start, value={"null": None, "true": True, "false": False}[v])
        return self.identifier()

    def array(self) -> dict:
        start = self.next().line
        items = []
        while not self.eat("]"):
            if self.at(","):
                self.next()
                items.append(None)
                continue
            items.append(self.with_in(self.spread))
            if not self.at("]"):
                self.need(",")
        return self.node("ArrayExpression", start, elements=items)

    def object_(self) -> dict:
        start = self.need("{").line
        props = []
        while not self.eat("}"):
            props.append(self.with_in(self.object_property))
            if not self.at("}"):
                self.need(",")
        return self.node("ObjectExpression", start, properties=props)

    def object_property(self) -> dict:
        start = self.t.line
        if self.at("..."):
            return self.spread()
        is_async = generator = False
        kind = "init"
        ends = ("(", ":", ",", "}", "=")
        if self.at("async") and self.peek().value not in ends and not self.peek().after_newline:
            self.next()
            is_async = True
        if self.eat("*"):
            generator = True
        if not is_async and not generator and (self.at("get") or self.at("set")) and self.peek().value not in ends:
            kind = self.next().value
        computed = self.at("[")
        word = self.t.kind == "name"
        key = self.property_key()
        if self.at("("):
            value = self.method(self.t.line, is_async, generator)
        elif self.eat(":"):
            value = self.assignment()
        elif word and not computed:
            value = key
            if self.eat("="):  # a default, if this turns out to be a pattern
                value = self.node("AssignmentExpression", start, operator="=", left=key, right=self.assignment())
        else:
            self.fail()
        return self.node("Property", start, key=key, computed=computed, value=value, kind=kind)


def parse(code: str) -> dict:
    """The program of a module. Raises SyntaxProblem."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        return Parser(code).program()
    except RecursionError as e:
        raise SyntaxProblem("nested too deeply") from e
    finally:
        sys.setrecursionlimit(limit)
