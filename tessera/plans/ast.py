"""Tokens, syntax tree and parser of the predicate language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class CompileError(ValueError):
    """A predicate that can't be compiled, with the place in its text."""

    def __init__(self, message: str, at: int = -1):
        super().__init__(f"{message} (at {at})" if at >= 0 else message)
        self.at = at


@dataclass(frozen=True)
class Token:
    kind: str  # word, key, int, real, str, op, end
    text: str
    at: int


@dataclass
class Node:
    kind: str
    args: list = field(default_factory=list)
    at: int = -1


#: Reserved words.
FUNCTIONS = {"abs", "sin", "cos", "tan", "asin", "acos", "atan", "sqrt", "exp", "log", "ceal", "floor", "lower", "upper", "length", "string", "integer", "real"}
AGGREGATES = {"count", "sum", "avg", "min", "max"}
KEYWORDS = FUNCTIONS | AGGREGATES | {"and", "or", "not", "like", "escape", "between", "in", "is", "null", "exists", "contains", "with", "group", "having", "order", "by", "asc", "desc", "current", "true", "false", "last"}
LEXER = re.compile(r"\s*(?:(?P<real>\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)|(?P<str>'(?:[^']|'')*')|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<op>\|\||<>|!=|<=|>=|[=<>+\-*/^()\[\],.?:]))")


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = LEXER.match(text, at)
        if not m:
            raise CompileError("unexpected character", at + len(text[at:]) - len(text[at:].lstrip()))
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "word" and value.lower() in KEYWORDS:
            kind, value = "key", value.lower()
        elif kind == "str":
            value = value[1:-1].replace("''", "'")
        elif value == "||":
            value = "+"
        out.append(Token(kind, value, m.start(m.lastgroup)))
        at = m.end()
    return [*out, Token("end", "", len(text))]


@dataclass
class Query:
    where: Node | None
    order: list[tuple[Node, bool]]  # expression, ascending
    parameters: int


class Parser:
    """Recursive descent, loosest first: or, and, comparison, + -, * /, ^ (to the right), term."""

    def __init__(self, text: str):
        self.tokens, self.i, self.parameters = tokenize(text), 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def take(self, *texts: str, kind: str | None = None) -> Token | None:
        t = self.now
        if (t.kind == kind if kind else t.kind in ("key", "op") and t.text in texts):
            self.i += 1
            return t
        return None

    def need(self, *texts: str, kind: str | None = None) -> Token:
        t = self.take(*texts, kind=kind)
        if t is None:
            raise CompileError(f"{' or '.join(texts) or kind} expected", self.now.at)
        return t

    def query(self) -> Query:
        where = None
        if self.now.kind != "end" and not (self.now.kind == "key" and self.now.text == "order"):
            where = self.either()
        order = []
        if self.take("order"):
            self.need("by")
            while True:
                e = self.addition()
                order.append((e, not self.take("desc")))
                self.take("asc")
                if not self.take(","):
                    break
        if self.now.kind != "end":
            raise CompileError("end of the query expected", self.now.at)
        return Query(where, order, self.parameters)

    def either(self) -> Node:
        left = self.both()
        if t := self.take("or"):
            return Node("or", [left, self.either()], t.at)
        return left

    def both(self) -> Node:
        left = self.comparison()
        if t := self.take("and"):
            return Node("and", [left, self.both()], t.at)
        return left

    def comparison(self) -> Node:
        left = self.addition()
        negate = None
        t = self.now
        if t.kind == "key" and t.text == "not" and self.tokens[self.i + 1].text in ("like", "between", "in"):
            negate = self.take("not")
            t = self.now
        if op := self.take("=", "<>", "!=", "<", "<=", ">", ">="):
            return Node("compare", ["<>" if op.text == "!=" else op.text, left, self.addition()], op.at)
        if self.take("is"):
            no = self.take("not")
            self.need("null")
            node = Node("isnull", [left], t.at)
            return Node("not", [node], t.at) if no else node
        if self.take("between"):
            low = self.addition()
            self.need("and")
            node = Node("between", [left, low, self.addition()], t.at)
        elif self.take("like"):
            pattern = self.addition()
            escape = self.addition() if self.take("escape") else None
            node = Node("like", [left, pattern, escape], t.at)
        elif self.take("in"):
            if self.take("("):
                values = [self.addition()]
                while self.take(","):
                    values.append(self.addition())
                self.need(")")
                node = Node("inlist", [left, values], t.at)
            else:
                node = Node("in", [left, self.addition()], t.at)
        else:
            return left
        return Node("not", [node], t.at) if negate else node

    def addition(self) -> Node:
        left = self.product()
        while op := self.take("+", "-"):
            left = Node("arith", [op.text, left, self.product()], op.at)
        return left

    def product(self) -> Node:
        left = self.power()
        while op := self.take("*", "/"):
            left = Node("arith", [op.text, left, self.power()], op.at)
        return left

    def power(self) -> Node:
        left = self.term()
        if op := self.take("^"):
            return Node("arith", ["^", left, self.power()], op.at)
        return left

    def term(self) -> Node:
        t = self.now
        if self.take("("):
            e = self.either()
            self.need(")")
            return self.path(e) if self.now.text in (".", "[") and self.now.kind == "op" else e
        if self.take("?"):
            self.parameters += 1
            return Node("param", [self.parameters], t.at)
        if self.take("not"):
            return Node("not", [self.comparison()], t.at)
        if self.take("-"):
            return Node("neg", [self.term()], t.at)
        if self.take("true", "false"):
            return Node("bool", [t.text == "true"], t.at)
        if self.take("null"):
            return Node("null", [], t.at)
        for kind in ("int", "real", "str"):
            if self.take(kind=kind):
                return Node(kind, [t.text if kind == "str" else int(t.text) if kind == "int" else float(t.text)], t.at)
        if self.take("current"):
            return self.path(Node("current", [], t.at))
        if t.kind == "key" and t.text in AGGREGATES:
            self.i += 1
            if t.text == "count":
                self.need("(")
                self.need("*")
                self.need(")")
                return Node("agg", ["count", None], t.at)
            return Node("agg", [t.text, self.term()], t.at)
        if t.kind == "key" and t.text in FUNCTIONS:
            self.i += 1
            return Node("call", [t.text, self.term()], t.at)
        if self.take("exists"):
            name = self.need(kind="word").text
            self.need(":")
            self.need("(")
            e = self.either()
            self.need(")")
            return Node("exists", [name, e], t.at)
        if self.take("contains"):
            coll = self.path(Node("name", [self.need(kind="word").text], t.at))
            cond = self.both() if self.take("with") else None
            group = having = None
            if self.take("group"):
                self.need("by")
                group = self.path(Node("name", [self.need(kind="word").text], self.now.at))
                self.need("having")
                having = self.both()
            if cond is None and having is None:
                raise CompileError("with or group by expected", self.now.at)
            return Node("contains", [coll, cond, group, having], t.at)
        if t.kind == "word":
            self.i += 1
            return self.path(Node("name", [t.text], t.at))
        raise CompileError("expression expected", t.at)

    def path(self, node: Node) -> Node:
        while True:
            t = self.now
            if self.take("."):
                node = Node("field", [node, self.need(kind="word").text], t.at)
            elif self.take("["):
                node = Node("at", [node, self.addition()], t.at)
                self.need("]")
            elif t.kind == "op" and t.text == "(" and node.kind in ("name", "field"):
                self.i += 1
                args = []
                if not self.take(")"):
                    args.append(self.addition())
                    while self.take(","):
                        args.append(self.addition())
                    self.need(")")
                node = Node("method", [node, args], t.at)
            else:
                return node


def parse(text: str) -> Query:
    return Parser(text).query()
