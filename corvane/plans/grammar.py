"""The dialect's SQL text as trees.

A hand-written lexer and an operator-precedence parser.  Forms that the dialect refuses are refused here, with SQLSTATE
0A000 or 42601.  Names that aren't quoted are lower case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corvane.functions.types import DialectError, NotSupported

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")
    |(?P<param>\$\d+)|(?P<name>[^\W\d]\w*)|(?P<op>::|<>|!=|<=|>=|\|\||[-+*/%=<>(),.;\[\]])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def lex(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        found = _TOKEN.match(sql, at)
        if not found:
            raise DialectError("42601", f"syntax error at {sql[at : at + 20]!r}")
        at, kind, text = found.end(), found.lastgroup, found.group()
        if kind == "space":
            continue
        if kind == "name":
            text = text.lower()
        elif kind == "quoted":
            text = text[1:-1].replace('""', '"')
        elif kind == "string":
            text = text[1:-1].replace("''", "'")
        out.append(Token(kind, text))
    return [*out, Token("end", "")]


@dataclass
class Node:
    kind: str
    args: tuple = ()

    def __getitem__(self, i):
        return self.args[i]


@dataclass
class Select:
    items: list[tuple[Node, str | None]] = field(default_factory=list)
    source: Node | None = None
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    having: Node | None = None
    distinct: bool = False
    distinct_on: list[Node] = field(default_factory=list)


@dataclass
class Query:
    body: object  # Select, SetOp, Values or Query
    ctes: list[tuple[str, list[str] | None, Query]] = field(default_factory=list)
    order: list[tuple[Node, bool, str | None]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class SetOp:
    op: str
    every: bool
    left: object
    right: object


@dataclass
class Values:
    rows: list[list[Node]]


@dataclass
class Statement:
    kind: str
    parts: dict = field(default_factory=dict)


#: Words that end an expression or a name, and so are no aliases.
_RESERVED = frozenset(
    "select from where group having order limit offset union intersect except on join inner left right full cross natural using as and or not in is between like ilike case when then else end "
    "with values all distinct returning set conflict do nothing update for lateral by asc desc nulls any some window qualify fetch escape over filter".split()
)
#: Of these, the ones that can't be the name of a column either.
_NO_COLUMN = _RESERVED - frozenset("do nothing conflict set update by any some first last escape filter over lateral window qualify fetch natural left right values".split())
_COMPARE = ("=", "<>", "!=", "<", "<=", ">", ">=")


class Parser:
    def __init__(self, sql: str):
        self.tokens, self.at = lex(sql), 0

    # ---- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def fail(self) -> None:
        raise DialectError("42601", f"syntax error at or near {self.now.text!r}")

    def word(self, *words: str) -> bool:
        """Takes the words if they come next."""
        for i, w in enumerate(words):
            t = self.peek(i)
            if t.kind != "name" or t.text != w:
                return False
        self.at += len(words)
        return True

    def sign(self, *signs: str) -> str | None:
        if self.now.kind == "op" and self.now.text in signs:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def need(self, *words: str) -> None:
        for w in words:
            if not (self.word(w) or self.sign(w)):
                self.fail()

    def name(self) -> str:
        if self.now.kind == "quoted" or self.now.kind == "name":
            self.at += 1
            return self.tokens[self.at - 1].text
        self.fail()

    def dotted(self) -> str:
        out = self.name()
        while self.sign("."):
            out += "." + self.name()
        return out

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.sign(","):
            out.append(self.name())
        self.need(")")
        return out

    def listed(self, what) -> list:
        out = [what()]
        while self.sign(","):
            out.append(what())
        return out

    def alias(self) -> str | None:
        if self.word("as"):
            return self.name()
        if self.now.kind == "quoted" or self.now.kind == "name" and self.now.text not in _RESERVED:
            return self.name()
        return None

    # ---- queries

    def query(self) -> Query:
        ctes = []
        if self.word("with"):
            if self.word("recursive"):
                raise NotSupported("WITH RECURSIVE")

            def cte():
                name = self.name()
                columns = self.names() if self.now.text == "(" else None
                self.need("as")
                if self.word("materialized") or self.word("not"):
                    raise NotSupported("MATERIALIZED")
                self.need("(")
                query = self.query()
                self.need(")")
                return name, columns, query

            ctes = self.listed(cte)
        out = Query(self.set_level(), ctes)
        if self.word("order", "by"):
            out.order = self.listed(self.order_key)
        while True:
            if self.word("limit"):
                out.limit = None if self.word("all") else self.count()
            elif self.word("offset"):
                out.offset = self.count()
                self.word("rows") or self.word("row")
            else:
                break
        if self.word("for"):
            self.locking(out)
        if self.now.text in ("window", "qualify", "fetch") and self.now.kind == "name":
            raise NotSupported(self.now.text.upper())
        return out

    def locking(self, query: Query) -> None:
        """FOR UPDATE and the like: reads are snapshots, so they are checked and passed over."""
        self.word("no", "key", "update") or self.word("key", "share") or self.word("update") or self.word("share") or self.fail()
        self.word("nowait") or self.word("skip", "locked")
        if not isinstance(query.body, Select) or query.body.source is None or query.body.source.kind != "table" or query.body.group:
            raise NotSupported("row locks but on a single table")

    def count(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            raise NotSupported("LIMIT and OFFSET other than integer literals")
        self.at += 1
        return int(self.tokens[self.at - 1].text)

    def order_key(self) -> tuple[Node, bool, str | None]:
        x, down = self.expression(), False
        if self.word("desc"):
            down = True
        else:
            self.word("asc")
        nulls = None
        if self.word("nulls"):
            nulls = "first" if self.word("first") else self.need("last") or "last"
        return x, down, nulls

    def set_level(self):
        left = self.intersect_level()
        while self.now.kind == "name" and self.now.text in ("union", "except", "minus"):
            op = self.name()
            if op == "minus":
                raise NotSupported("MINUS")
            every = self.word("all")
            self.word("distinct")
            if self.word("by"):
                raise NotSupported("BY NAME")
            left = SetOp(op, every, left, self.intersect_level())
        return left

    def intersect_level(self):
        left = self.query_term()
        while self.word("intersect"):
            every = self.word("all")
            left = SetOp("intersect", every, left, self.query_term())
        return left

    def query_term(self):
        if self.sign("("):
            out = self.query()
            self.need(")")
            return out
        if self.word("values"):

            def row():
                self.need("(")
                out = self.listed(self.expression)
                self.need(")")
                return out

            return Values(self.listed(row))
        self.need("select")
        out = Select()
        if self.word("distinct"):
            if self.word("on"):
                self.need("(")
                out.distinct_on = self.listed(self.expression)
                self.need(")")
            else:
                out.distinct = True
        else:
            self.word("all")

        def item():
            if self.sign("*"):
                return Node("star", (None,)), None
            x = self.expression()
            return x, None if x.kind == "star" else self.alias()

        out.items = self.listed(item)
        if self.word("from"):
            out.source = self.source()
            while self.sign(","):
                out.source = Node("join", ("cross", out.source, self.source(), None))
        if self.word("where"):
            out.where = self.expression()
        if self.word("group", "by"):
            if self.now.text in ("all", "rollup", "cube", "grouping") and self.now.kind == "name":
                raise NotSupported(f"GROUP BY {self.now.text.upper()}")
            out.group = self.listed(self.expression)
        if self.word("having"):
            out.having = self.expression()
        return out

    def source(self) -> Node:
        left = self.relation()
        while True:
            kind = None
            if self.word("natural"):
                raise NotSupported("NATURAL JOIN")
            if self.word("cross", "join"):
                kind = "cross"
            elif self.word("inner", "join") or self.word("join"):
                kind = "inner"
            else:
                for side in ("left", "right", "full"):
                    if self.now.kind == "name" and self.now.text == side:
                        self.at += 1
                        self.word("outer")
                        if self.now.text in ("semi", "anti"):
                            raise NotSupported(f"{self.now.text.upper()} JOIN")
                        self.need("join")
                        kind = side
                        break
            if kind is None:
                return left
            right, on = self.relation(), None
            if kind != "cross":
                if self.word("using"):
                    raise NotSupported("USING")
                self.need("on")
                on = self.expression()
            left = Node("join", (kind, left, right, on))

    def relation(self) -> Node:
        lateral = self.word("lateral")
        if self.sign("("):
            if self.now.kind == "name" and self.now.text in ("select", "values", "with") or self.now.text == "(":
                query = self.query()
                self.need(")")
                alias = self.alias()
                if alias is None:
                    raise DialectError("42601", "a subquery in FROM must have an alias")
                return Node("derived", (query, alias, self.names() if self.now.text == "(" else None, lateral))
            inner = self.source()
            self.need(")")
            return inner
        name = self.dotted()
        if self.sign("("):
            args = [] if self.now.text == ")" else self.listed(self.expression)
            self.need(")")
            if self.word("with", "ordinality"):
                raise NotSupported("WITH ORDINALITY")
            alias = self.alias()
            return Node("call", (name, args, alias or name, self.names() if alias and self.now.text == "(" else None))
        alias = self.alias()
        return Node("table", (name, alias, self.names() if alias and self.now.text == "(" else None))

    # ---- expressions

    def expression(self, level: int = 0) -> Node:
        if level == 0:
            left = self.expression(1)
            while self.word("or"):
                left = Node("bool", ("OR", left, self.expression(1)))
            return left
        if level == 1:
            left = self.expression(2)
            while self.word("and"):
                left = Node("bool", ("AND", left, self.expression(2)))
            return left
        if level == 2:
            return Node("not", (self.expression(2),)) if self.word("not") else self.predicate()
        if level == 3:
            left = self.expression(4)
            while op := self.sign("+", "-", "||"):
                left = Node("op", (op, left, self.expression(4)))
            return left
        left = self.unary()
        while op := self.sign("*", "/", "%"):
            left = Node("op", (op, left, self.unary()))
        return left

    def predicate(self) -> Node:
        left = self.expression(3)
        while True:
            if op := self.sign(*_COMPARE):
                op = "<>" if op == "!=" else op
                if self.now.kind == "name" and self.now.text in ("any", "some") and self.peek().text == "(":
                    self.at += 2
                    array = self.expression()
                    self.need(")")
                    left = Node("any", (left, op, array))
                else:
                    left = Node("compare", (op, left, self.expression(3)))
            elif self.word("is"):
                negated = self.word("not")
                if self.word("null"):
                    left = Node("null", (left, negated))
                elif self.word("distinct", "from"):
                    left = Node("distinct", (left, self.expression(3), negated))
                elif self.now.text in ("true", "false"):
                    value = self.name()
                    left = Node("distinct", (left, Node("literal", ("bool", value)), not negated))
                else:
                    self.fail()
            else:
                back, negated = self.at, self.word("not")
                if self.word("in"):
                    self.need("(")
                    if self.now.kind == "name" and self.now.text in ("select", "values", "with"):
                        left = Node("in_query", (left, self.query(), negated))
                    else:
                        left = Node("in", (left, self.listed(self.expression), negated))
                    self.need(")")
                elif self.word("between"):
                    low = self.expression(3)
                    self.need("and")
                    left = Node("between", (left, low, self.expression(3), negated))
                elif self.now.text in ("like", "ilike") and self.now.kind == "name":
                    fold = self.name() == "ilike"
                    pattern = self.expression(3)
                    escape = self.string() if self.word("escape") else "\\"
                    left = Node("like", (left, pattern, escape, fold, negated))
                else:
                    self.at = back
                    return left

    def string(self) -> str:
        if self.now.kind != "string":
            self.fail()
        self.at += 1
        return self.tokens[self.at - 1].text

    def unary(self) -> Node:
        if self.sign("-"):
            x = self.unary()
            return Node("literal", (x[0], "-" + x[1])) if x.kind == "literal" and x[0] in ("int", "double") and not x[1].startswith("-") else Node("negate", (x,))
        if self.sign("+"):
            return self.unary()
        x = self.primary()
        while True:
            if self.sign("::"):
                x = Node("cast", (x, self.type_name()))
            elif self.sign("["):
                place = self.expression()
                self.need("]")
                x = Node("subscript", (x, place))
            else:
                return x

    def type_name(self) -> str:
        out = self.name()
        if out == "double" and self.word("precision"):
            out = "double precision"
        if out == "character" and self.word("varying"):
            out = "varchar"
        if self.sign("("):
            sizes = [str(self.count())]
            while self.sign(","):
                sizes.append(str(self.count()))
            self.need(")")
            out += f"({', '.join(sizes)})"
        if out in ("timestamp", "time") and self.word("with", "time", "zone"):
            out = "timestamptz"
        else:
            self.word("without", "time", "zone")
        while self.sign("["):
            self.need("]")
            out += "" if out.endswith("[]") else "[]"
        return out

    def primary(self) -> Node:
        t = self.now
        if t.kind == "number":
            self.at += 1
            return Node("literal", ("int" if t.text.isdigit() else "double", t.text))
        if t.kind == "string":
            self.at += 1
            return Node("literal", ("text", t.text))
        if t.kind == "param":
            self.at += 1
            return Node("param", (int(t.text[1:]),))
        if self.sign("("):
            if self.now.kind == "name" and self.now.text in ("select", "values", "with"):
                query = self.query()
                self.need(")")
                return Node("scalar", (query,))
            x = self.expression()
            self.need(")")
            return x
        if t.kind == "name":
            if self.word("null"):
                return Node("literal", ("unknown", "NULL"))
            if self.now.text in ("true", "false"):
                return Node("literal", ("bool", self.name()))
            if self.word("case"):
                return self.case()
            if self.now.text == "cast" and self.peek().text == "(":
                self.at += 2
                x = self.expression()
                self.need("as")
                kind = self.type_name()
                self.need(")")
                return Node("cast", (x, kind))
            if self.word("exists"):
                self.need("(")
                query = self.query()
                self.need(")")
                return Node("exists", (query,))
            if self.now.text == "array" and self.peek().text == "[":
                self.at += 1
                return self.array()
            if self.now.text in ("date", "timestamp", "timestamptz", "time", "bytea", "uuid", "real", "numeric", "interval") and self.peek().kind == "string":
                kind = self.name()
                return Node("cast", (Node("literal", ("text", self.string())), kind))
            if self.now.text in ("extract", "position", "substring", "trim") and self.peek().text == "(":
                return self.special(self.name())
            if self.now.text in ("current_timestamp", "current_user", "session_user", "user", "current_catalog", "current_schema") and self.peek().text != "(":
                return Node("call", (self.name(), [], False))
            if self.now.text in _NO_COLUMN:
                self.fail()
        name = self.name()
        if self.sign("("):
            return self.call(name)
        parts = [name]
        while self.sign("."):
            if self.sign("*"):
                return Node("star", (".".join(parts),))
            parts.append(self.name())
        if len(parts) > 1 and self.sign("("):
            return self.call(parts[-1])
        return Node("column", tuple(parts))

    def array(self) -> Node:
        self.need("[")
        items = []
        if self.now.text != "]":
            items = self.listed(lambda: self.array() if self.now.text == "[" else self.expression())
        self.need("]")
        return Node("array", tuple(items))

    def case(self) -> Node:
        of = None if self.now.text == "when" else self.expression()
        arms = []
        while self.word("when"):
            test = self.expression()
            self.need("then")
            arms.append((test, self.expression()))
        other = self.expression() if self.word("else") else None
        self.need("end")
        return Node("case", (of, arms, other))

    def call(self, name: str) -> Node:
        if self.sign("*"):
            self.need(")")
            out = Node("call", (name, [Node("star", (None,))], False))
        else:
            distinct = self.word("distinct")
            if distinct and self.now.text == "*":
                self.fail()
            args = [] if self.now.text == ")" else self.listed(self.expression)
            if self.now.text == "order":
                raise NotSupported("ORDER BY within an aggregate")
            self.need(")")
            out = Node("call", (name, args, distinct))
        if self.now.kind == "name" and self.now.text in ("over", "within") or self.now.text == "filter" and self.peek().text == "(":
            raise NotSupported(self.now.text.upper())
        return out

    def special(self, name: str) -> Node:
        self.need("(")
        if name == "extract":
            unit = self.string() if self.now.kind == "string" else self.name()
            self.need("from")
            out = Node("extract", (unit.lower(), self.expression()))
        elif name == "position":
            part = self.expression(3)
            self.need("in")
            out = Node("call", ("position", [part, self.expression()], False))
        elif name == "trim":
            if self.now.text in ("leading", "trailing", "both"):
                raise NotSupported("TRIM with options")
            out = Node("call", ("trim", [self.expression()], False))
        else:
            args = [self.expression()]
            if self.word("from"):
                args.append(self.expression())
                if self.word("for"):
                    args.append(self.expression())
            elif self.word("for"):
                args += [Node("literal", ("int", "1")), self.expression()]
            else:
                while self.sign(","):
                    args.append(self.expression())
            out = Node("call", ("substring", args, False))
        self.need(")")
        return out

    # ---- statements

    def statement(self) -> Statement:
        out = self._statement()
        self.sign(";")
        if self.now.kind != "end":
            self.fail()
        return out

    def _returning(self) -> list | None:
        if not self.word("returning"):
            return None
        return self.listed(lambda: (Node("star", (None,)), None) if self.sign("*") else (self.expression(), self.alias()))

    def _assignments(self) -> list[tuple[str, Node]]:
        def one():
            name = self.name()
            self.need("=")
            return name, Node("default", ()) if self.word("default") else self.expression()

        return self.listed(one)

    def _statement(self) -> Statement:
        if self.now.text in ("select", "values", "with", "("):
            return Statement("query", {"query": self.query()})
        if self.word("explain"):
            analyze = self.word("analyze")
            return Statement("explain", {"query": self.query(), "analyze": analyze})
        if self.word("insert", "into"):
            parts = {"table": self.dotted(), "columns": self.names() if self.now.text == "(" and self.peek().text not in ("select", "values", "with") else None}
            parts["query"] = None if self.word("default", "values") else self.query()
            parts |= {"conflict": None, "update": [], "where": None}
            if self.word("on", "conflict"):
                parts["target"] = self.names() if self.now.text == "(" else None
                self.need("do")
                if self.word("nothing"):
                    parts["conflict"] = "nothing"
                else:
                    self.need("update", "set")
                    parts |= {"conflict": "update", "update": self._assignments(), "where": self.expression() if self.word("where") else None}
            return Statement("insert", parts | {"returning": self._returning()})
        if self.word("update"):
            parts = {"table": self.dotted(), "alias": self.alias()}
            self.need("set")
            parts["changes"] = self._assignments()
            parts["source"] = self.source() if self.word("from") else None
            parts["where"] = self.expression() if self.word("where") else None
            return Statement("update", parts | {"returning": self._returning()})
        if self.word("delete", "from"):
            parts = {"table": self.dotted(), "alias": self.alias()}
            parts["source"] = self.source() if self.word("using") else None
            parts["where"] = self.expression() if self.word("where") else None
            return Statement("delete", parts | {"returning": self._returning()})
        if self.word("truncate"):
            self.word("table")
            return Statement("truncate", {"tables": self.listed(self.dotted)})
        if self.word("create"):
            return self._create()
        if self.word("drop"):
            kind = self.name()
            exists = self.word("if", "exists")
            return Statement("drop", {"what": kind, "names": self.listed(self.dotted), "if_exists": exists})
        if self.word("alter", "table"):
            return self._alter()
        if self.word("declare"):
            name = self.name()
            if self.word("scroll"):
                raise NotSupported("SCROLL cursors")
            self.word("no", "scroll")
            self.need("cursor")
            self.word("without", "hold")
            self.need("for")
            return Statement("declare", {"name": name, "query": self.query()})
        if self.word("fetch"):
            count: int | None = 1
            if self.word("all"):
                count = None
            elif self.now.kind == "number":
                count = self.count()
            else:
                self.word("next")
            self.word("from") or self.word("in")
            return Statement("fetch", {"count": count, "name": self.name()})
        if self.word("close"):
            return Statement("close", {"name": self.name()})
        if self.word("analyze"):
            return Statement("analyze", {"table": self.dotted() if self.now.kind != "end" and self.now.text != ";" else None})
        if self.word("vacuum"):
            analyze = self.word("analyze")
            return Statement("analyze" if analyze else "nothing", {"table": self.dotted() if self.now.kind == "name" else None})
        if self.word("set"):
            name = self.name()
            self.sign("=") or self.need("to")
            value = self.now.text
            self.at += 1
            return Statement("set", {"name": name, "value": value})
        if self.word("show"):
            return Statement("show", {"name": self.name()})
        if self.word("reset"):
            return Statement("reset", {"name": None if self.word("all") else self.name()})
        if self.word("discard", "all"):
            return Statement("discard")
        raise NotSupported(f"statement {self.now.text.upper()}")

    def _alter(self) -> Statement:
        parts: dict = {"table": self.dotted()}
        if self.word("add"):
            if self.word("constraint"):
                self.name()
            if self.word("primary", "key"):
                parts |= {"do": "add_primary_key", "columns": self.names()}
            elif self.word("unique"):
                parts |= {"do": "add_unique", "columns": self.names()}
            elif self.word("foreign", "key"):
                columns = self.names()
                self.need("references")
                parts |= {"do": "add_foreign_key", "columns": columns, "other": self.dotted(), "references": self.names() if self.now.text == "(" else []}
            else:
                self.word("column")
                parts |= {"do": "add_column", "column": self.name(), "type": self.type_name(), "default": self.expression(3) if self.word("default") else None}
        elif self.word("drop"):
            if self.word("constraint"):
                parts |= {"do": "drop_constraint", "name": self.name()}
            else:
                self.word("column")
                parts |= {"do": "drop_column", "column": self.name()}
        elif self.word("rename"):
            if self.word("to"):
                parts |= {"do": "rename", "to": self.name()}
            else:
                self.word("column")
                parts |= {"do": "rename_column", "column": self.name()}
                self.need("to")
                parts["to"] = self.name()
        else:
            self.need("alter")
            self.word("column")
            parts |= {"do": "alter_type", "column": self.name()}
            self.word("set", "data")
            self.need("type")
            parts["type"] = self.type_name()
        return Statement("alter", parts)

    def _create(self) -> Statement:
        replace = self.word("or", "replace")
        if self.word("schema"):
            exists = self.word("if", "not", "exists")
            return Statement("create_schema", {"name": self.name(), "if_not_exists": exists})
        if self.word("view"):
            name = self.dotted()
            columns = self.names() if self.now.text == "(" else None
            self.need("as")
            return Statement("create_view", {"name": name, "columns": columns, "query": self.query(), "replace": replace})
        unique = self.word("unique")
        if self.word("index"):
            name = self.name()
            self.need("on")
            return Statement("create_index", {"name": name, "table": self.dotted(), "columns": self.names(), "unique": unique})
        if self.word("sequence"):
            parts: dict = {"name": self.dotted()}
            while self.now.kind == "name":
                if self.word("increment"):
                    self.word("by")
                    parts["increment"] = self._signed()
                elif self.word("start"):
                    self.word("with")
                    parts["start"] = self._signed()
                elif self.word("minvalue"):
                    parts["minimum"] = self._signed()
                elif self.word("maxvalue"):
                    parts["maximum"] = self._signed()
                elif self.word("cycle"):
                    parts["cycle"] = True
                elif not self.word("no", "cycle"):
                    self.fail()
            return Statement("create_sequence", parts)
        self.need("table")
        exists = self.word("if", "not", "exists")
        parts = {"name": self.dotted(), "columns": {}, "key": (), "unique": [], "not_null": set(), "checks": [], "defaults": {}, "foreign": [], "if_not_exists": exists}
        self.need("(")
        while True:
            if self.now.text in ("primary", "unique", "check", "foreign", "constraint") and self.now.kind == "name":
                if self.word("constraint"):
                    self.name()
                if self.word("primary", "key"):
                    parts["key"] = tuple(self.names())
                elif self.word("unique"):
                    parts["unique"].append(tuple(self.names()))
                elif self.word("check"):
                    self.need("(")
                    parts["checks"].append(self.expression())
                    self.need(")")
                else:
                    self.need("foreign", "key")
                    columns = self.names()
                    self.need("references")
                    parts["foreign"].append((tuple(columns), self.dotted(), tuple(self.names()) if self.now.text == "(" else ()))
            else:
                column = self.name()
                parts["columns"][column] = self.type_name()
                while self.now.text not in (",", ")"):
                    if self.word("primary", "key"):
                        parts["key"] = (column,)
                    elif self.word("unique"):
                        parts["unique"].append((column,))
                    elif self.word("not", "null"):
                        parts["not_null"].add(column)
                    elif self.word("default"):
                        parts["defaults"][column] = self.expression(3)
                    elif self.word("check"):
                        self.need("(")
                        parts["checks"].append(self.expression())
                        self.need(")")
                    elif self.word("references"):
                        parts["foreign"].append(((column,), self.dotted(), tuple(self.names()) if self.now.text == "(" else ()))
                    elif not self.word("null"):
                        self.fail()
            if not self.sign(","):
                break
        self.need(")")
        return Statement("create_table", parts)

    def _signed(self) -> int:
        minus = self.sign("-")
        return -self.count() if minus else self.count()


def parse(sql: str) -> Statement:
    return Parser(sql).statement()
