"""Tokens and syntax trees of the dialect. Expressions are tuples whose first element names the kind."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import QueryError

_TOKEN = re.compile(
    r"""(?P<hint>/\*\+.*?\*/)|(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<hex>0[xX][0-9a-fA-F]+)|(?P<num>\d+\.\d+|\.\d+|\d+)
    |(?P<str>'(?:[^']|'')*')|(?P<quoted>"[^"]*"|`[^`]*`)|(?P<op>->>|->|\#>>|\#>|>>>|>>|<<|<>|!=|>=|<=|\|\||::|[-+*/%&|^~<>=(),.\[\]?{}])
    |(?P<bind>:\w+)|(?P<name>[$@\w\u0080-￿][$\w\u0080-￿]*)""",
    re.VERBOSE | re.DOTALL,
)
RESERVED = {"select", "from", "where", "group", "having", "order", "limit", "join", "on", "inner", "left", "right", "full", "cross", "union", "minus", "except", "intersect", "and", "or", "not", "as", "then", "else", "end", "when", "case", "by", "asc", "desc", "nulls", "between", "in", "is", "like", "natural", "using"}
SET_OPS = {"union", "minus", "except", "intersect"}


@dataclass
class Token:
    kind: str
    text: str
    at: int


@dataclass
class Source:
    kind: str  # table, query, values, call
    alias: str = ""
    name: str = ""
    query: object = None
    args: list = field(default_factory=list)
    columns: list[str] = field(default_factory=list)


@dataclass
class Join:
    kind: str
    source: Source
    on: tuple | None


@dataclass
class Query:
    items: list = field(default_factory=list)  # (expression, alias)
    source: Source | None = None
    joins: list[Join] = field(default_factory=list)
    where: tuple | None = None
    group: list = field(default_factory=list)
    having: tuple | None = None
    order: list = field(default_factory=list)  # (expression, descending, nulls)
    limit: tuple | None = None
    offset: tuple | None = None
    distinct: bool = False
    distinct_on: list = field(default_factory=list)
    hints: dict[str, str] = field(default_factory=dict)


@dataclass
class SetQuery:
    kind: str
    left: object
    right: object


@dataclass
class With:
    """Named queries, then the query that may name them."""

    names: list[tuple[str, list[str], object]]
    body: object


class Parser:
    def __init__(self, sql: str) -> None:
        self.sql, self.tokens, self.i, self.positional = sql, [], 0, 0
        at = 0
        while at < len(sql):
            m = _TOKEN.match(sql, at)
            if not m:
                self.fail(at, f"unexpected {sql[at]!r}")
            if m.lastgroup != "skip":
                self.tokens.append(Token(m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(Token("end", "", len(sql)))

    def fail(self, at: int, why: str) -> None:
        line = self.sql.count("\n", 0, at) + 1
        raise QueryError("syntax", why, line=line, column=at - self.sql.rfind("\n", 0, at))

    # tokens
    def peek(self, *words: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return t.kind in ("name", "op") and t.text.lower() in words

    def accept(self, *words: str) -> str | None:
        if self.peek(*words):
            self.i += 1
            return self.tokens[self.i - 1].text.lower()
        return None

    def expect(self, *words: str) -> str:
        got = self.accept(*words)
        if got is None:
            t = self.tokens[self.i]
            self.fail(t.at, f"expected {' or '.join(words)}, found {t.text or 'the end'}")
        return got

    def next(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def name(self) -> str:
        t = self.next()
        if t.kind == "quoted":
            return t.text[1:-1]
        if t.kind != "name":
            self.fail(t.at, f"expected a name, found {t.text or 'the end'}")
        return t.text

    # queries
    def statement(self) -> object:
        if not self.peek("select", "with", "(") and self.tokens[self.i].kind != "hint":
            self.fail(0, "only SELECT is supported")
        q = self.with_query() if self.peek("with") else self.set_query()
        if self.tokens[self.i].kind != "end":
            self.fail(self.tokens[self.i].at, f"unexpected {self.tokens[self.i].text}")
        return q

    def with_query(self) -> With:
        self.expect("with")
        names = []
        while True:
            name, columns = self.name(), []
            if self.accept("("):
                columns = [self.name()]
                while self.accept(","):
                    columns.append(self.name())
                self.expect(")")
            self.expect("as")
            self.expect("(")
            names.append((name, columns, self.set_query()))
            self.expect(")")
            if not self.accept(","):
                return With(names, self.set_query())

    def set_query(self) -> object:
        left = self.one_query()
        while op := self.accept(*SET_OPS):
            every = bool(self.accept("all"))
            left = SetQuery("union all" if op == "union" and every else op, left, self.one_query())
        return left

    def one_query(self) -> object:
        if self.accept("("):
            q = self.set_query()
            self.expect(")")
            return q
        return self.select()

    def hint(self) -> dict[str, str]:
        out: dict[str, str] = {}
        while self.tokens[self.i].kind == "hint":
            for key, _, value in re.findall(r"([\w.]+)\s*(\(([^)]*)\))?", self.next().text[3:-2]):
                out[key] = value or "true"
        return out

    def select(self) -> Query:
        q = Query(hints=self.hint())
        self.expect("select")
        q.hints |= self.hint()
        if self.accept("distinct"):
            q.distinct = True
            if self.accept("on"):
                self.expect("(")
                q.distinct_on = self.expressions()
                self.expect(")")
        q.items = [self.item()]
        while self.accept(","):
            q.items.append(self.item())
        if self.accept("from"):
            q.source = self.from_item()
            while join := self.join():
                q.joins.append(join)
        if self.accept("where"):
            q.where = self.expression()
        if self.accept("group"):
            self.expect("by")
            q.group = self.expressions()
        if self.accept("having"):
            q.having = self.expression()
        if self.accept("order"):
            self.expect("by")
            q.order = [self.order_item()]
            while self.accept(","):
                q.order.append(self.order_item())
        if self.accept("limit"):
            q.limit = self.expression()
            if self.accept(","):
                q.offset, q.limit = q.limit, self.expression()
            elif self.accept("offset"):
                q.offset = self.expression()
        return q

    def order_item(self) -> tuple:
        e = self.expression()
        down = self.accept("asc", "desc") == "desc"
        nulls = self.expect("first", "last") if self.accept("nulls") else None
        return e, down, nulls

    def item(self) -> tuple:
        if self.accept("*"):
            return ("star", None), None
        start = self.tokens[self.i].at
        e = self.expression()
        text = self.sql[start : self.tokens[self.i].at].strip()
        if self.accept("as"):
            return e, self.name()
        t = self.tokens[self.i]
        if t.kind == "quoted" or t.kind == "name" and t.text.lower() not in RESERVED:
            return e, self.name()
        return e, None if e[0] == "star" else re.sub(r"[`\"]", "", text)

    def alias(self, source: Source) -> Source:
        named = self.accept("as")
        t = self.tokens[self.i]
        if named or t.kind == "quoted" or t.kind == "name" and t.text.lower() not in RESERVED:
            source.alias = self.name()
            if self.accept("("):
                source.columns = [self.name()]
                while self.accept(","):
                    source.columns.append(self.name())
                self.expect(")")
        return source

    def from_item(self) -> Source:
        if self.accept("("):
            if self.accept("values"):
                rows = []
                while self.accept("(", ","):
                    if self.tokens[self.i - 1].text == "(":
                        rows.append(self.expressions())
                        self.expect(")")
                self.expect(")")
                return self.alias(Source("values", args=rows))
            if self.peek("select", "("):
                q = self.set_query()
                self.expect(")")
                return self.alias(Source("query", query=q))
            inner = self.from_item()
            self.expect(")")
            return self.alias(inner)
        name = self.name()
        while self.accept("."):
            name += "." + self.name()
        if self.accept("("):
            args = []
            while not self.accept(")"):
                if self.peek("(") and self.peek("select", "(", ahead=1):
                    self.expect("(")
                    q = self.set_query()
                    self.expect(")")
                    args.append(self.alias(Source("query", query=q)))
                else:
                    args.append(self.expression())
                self.accept(",")
            return self.alias(Source("call", name=name.lower(), args=args))
        return self.alias(Source("table", name=name, alias=""))

    def join(self) -> Join | None:
        if self.accept(","):
            return Join("inner", self.from_item(), None)
        kind = None
        if self.peek("left", "right", "full", "inner", "cross", "join", "natural"):
            kind = self.accept("left", "right", "full", "inner", "cross", "natural") or "inner"
            semi = self.accept("semi", "anti")
            self.accept("outer")
            self.expect("join")
            source = self.from_item()
            on = self.expression() if self.accept("on") else None
            if on is None and self.accept("using"):
                self.expect("(")
                shared = [self.name()]
                while self.accept(","):
                    shared.append(self.name())
                self.expect(")")
                on = ("using", shared)
            return Join(f"{kind} {semi}" if semi else kind, source, on)
        return None

    # expressions, loosest first
    def expressions(self) -> list:
        out = [self.expression() if not self.accept("*") else ("star", None)]
        while self.accept(","):
            out.append(self.expression() if not self.accept("*") else ("star", None))
        return out

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.accept("or"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.negation()
        while self.accept("and"):
            e = ("and", e, self.negation())
        return e

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.accept("not") else self.predicate()

    def predicate(self) -> tuple:
        e = self.binary(0)
        while True:
            if op := self.accept("=", "!=", "<>", ">", ">=", "<", "<="):
                e = ("compare", {"!=": "<>"}.get(op, op), e, self.binary(0))
            elif self.accept("is"):
                negated = bool(self.accept("not"))
                e = ("is", e, self.expect("null", "true", "false"), negated)
            else:
                negated = self.peek("not") and self.peek("like", "between", "in", ahead=1)
                if negated:
                    self.expect("not")
                if self.accept("like"):
                    e = ("like", e, self.binary(0), negated)
                elif self.accept("between"):
                    low = self.binary(0)
                    self.expect("and")
                    e = ("between", e, low, self.binary(0), negated)
                elif self.accept("in"):
                    if self.accept("("):
                        inner = self.set_query() if self.peek("select") else self.expressions()
                        self.expect(")")
                    else:
                        inner = [self.binary(0)]
                    e = ("in", e, inner, negated)
                else:
                    return e

    LEVELS = (("|",), ("^",), ("&",), ("<<", ">>", ">>>"), ("+", "-", "||"), ("*", "/", "%"))

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        e = self.binary(level + 1)
        while op := self.accept(*self.LEVELS[level]):
            e = ("binary", op, e, self.binary(level + 1))
        return e

    def unary(self) -> tuple:
        if op := self.accept("-", "+", "~"):
            return ("unary", op, self.unary())
        return self.postfix(self.primary())

    def postfix(self, e: tuple) -> tuple:
        while True:
            if self.accept("["):
                e = ("at", e, self.expression())
                self.expect("]")
            elif self.accept("::"):
                e = ("cast", e, self.kind())
            elif op := self.accept("->", "->>", "#>", "#>>"):
                e = ("json", op, e, self.primary())
            elif e[0] in ("at", "call", "query") and self.accept("."):
                e = ("at", e, ("string", self.name()))
            else:
                return e

    def primary(self) -> tuple:
        t = self.next()
        word = t.text.lower()
        if t.kind == "num":
            return ("number", t.text)
        if t.kind == "hex":
            return ("number", str(int(t.text, 16)))
        if t.kind == "str":
            return ("string", t.text[1:-1].replace("''", "'"))
        if t.kind == "bind":
            return ("param", t.text[1:])
        if t.kind == "quoted" or t.kind == "name" and word not in RESERVED - {"left", "right", "case", "replace", "in", "using"}:
            return self.named(t, word)
        if t.text == "?":
            if self.tokens[self.i].kind == "num":
                return ("param", str(int(self.next().text) - 1))
            self.positional += 1
            return ("param", str(self.positional - 1))
        if t.text == "{":
            kind, value = self.name().lower(), self.next().text[1:-1]
            self.expect("}")
            return ("typed", {"ts": "timestamp", "d": "date", "t": "time"}.get(kind, kind), value)
        if t.text == "(":
            if self.peek("select"):
                q = self.set_query()
                self.expect(")")
                return ("query", q)
            e = self.expression()
            self.expect(")")
            return e
        self.fail(t.at, f"unexpected {t.text or 'end'}")

    def named(self, t: Token, word: str) -> tuple:
        if t.kind == "name":
            if word == "case":
                return self.case()
            if word in ("left", "right", "in") and not self.peek("("):
                self.fail(t.at, f"unexpected {t.text}")
            if word == "exists" and self.accept("("):
                q = self.set_query()
                self.expect(")")
                return ("exists", q)
            if word == "cast" and self.accept("("):
                e = self.expression()
                self.expect("as")
                kind = self.kind()
                if self.accept("("):
                    self.expressions()
                    self.expect(")")
                self.expect(")")
                return ("cast", e, kind)
            if word == "array" and self.accept("["):
                items = [] if self.peek("]") else self.expressions()
                self.expect("]")
                return ("call", "array", items, "")
            if word in ("true", "false", "null") and not self.peek("."):
                return ("word", word)
            if word == "interval" and not self.peek("("):
                return self.unary()
        parts = [t.text[1:-1] if t.kind == "quoted" else t.text]
        while self.peek(".") :
            self.expect(".")
            if self.accept("*"):
                return ("star", ".".join(parts))
            if self.accept("["):
                parts.append(f"[{self.next().text}]")
                self.expect("]")
            elif self.tokens[self.i].kind == "num":
                parts.append(self.next().text)
            else:
                parts.append(self.name())
        if self.accept("("):
            modifier = self.accept("distinct", "unique") or ""
            args = [] if self.peek(")") else self.expressions()
            if modifier and self.peek(")") is False:
                self.fail(self.tokens[self.i].at, "expected )")
            self.expect(")")
            return ("call", ".".join(parts).lower(), args, modifier)
        return ("column", parts)

    def kind(self) -> str:
        """The name of a type, which may be of two words."""
        name = self.name()
        if (name.lower(), self.tokens[self.i].text.lower()) in (("double", "precision"), ("character", "varying")):
            return f"{name} {self.name()}"
        return name

    def case(self) -> tuple:
        switch = None if self.peek("when") else self.expression()
        whens = []
        while self.accept("when"):
            c = self.expression()
            self.expect("then")
            whens.append((c, self.expression()))
        other = self.expression() if self.accept("else") else None
        self.expect("end")
        return ("case", switch, whens, other)


def parse(sql: str) -> object:
    return Parser(sql).statement()
