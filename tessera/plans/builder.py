"""Builds predicates in code: the same syntax tree as the parser's."""

from __future__ import annotations

from tessera.plans.ast import Node, Query


def lit(v) -> Node:
    kind = {bool: "bool", int: "int", float: "real", str: "str", type(None): "null"}[type(v)]
    return Node(kind, [] if v is None else [v])


def _node(x) -> Node:
    return x.node if isinstance(x, Expr) else x if isinstance(x, Node) else lit(x)


class Expr:
    """An expression; Python's operators make larger ones (& | ~ for and, or, not)."""

    def __init__(self, node: Node):
        self.node = node

    def _compare(self, op: str, other) -> Expr:
        return Expr(Node("compare", [op, self.node, _node(other)]))

    def _arith(self, op: str, other) -> Expr:
        return Expr(Node("arith", [op, self.node, _node(other)]))

    __eq__ = lambda self, o: self._compare("=", o)
    __ne__ = lambda self, o: self._compare("<>", o)
    __lt__ = lambda self, o: self._compare("<", o)
    __le__ = lambda self, o: self._compare("<=", o)
    __gt__ = lambda self, o: self._compare(">", o)
    __ge__ = lambda self, o: self._compare(">=", o)
    __add__ = lambda self, o: self._arith("+", o)
    __sub__ = lambda self, o: self._arith("-", o)
    __mul__ = lambda self, o: self._arith("*", o)
    __truediv__ = lambda self, o: self._arith("/", o)
    __pow__ = lambda self, o: self._arith("^", o)
    __and__ = lambda self, o: Expr(Node("and", [self.node, _node(o)]))
    __or__ = lambda self, o: Expr(Node("or", [self.node, _node(o)]))
    __invert__ = lambda self: Expr(Node("not", [self.node]))
    __neg__ = lambda self: Expr(Node("neg", [self.node]))
    __hash__ = None

    def __getitem__(self, i) -> Expr:
        return Expr(Node("at", [self.node, _node(i)]))

    def field(self, name: str) -> Expr:
        return Expr(Node("field", [self.node, name]))

    def invoke(self, *args) -> Expr:
        return Expr(Node("method", [self.node, [_node(a) for a in args]]))

    def between(self, low, high) -> Expr:
        return Expr(Node("between", [self.node, _node(low), _node(high)]))

    def like(self, pattern: str, escape: str | None = None) -> Expr:
        return Expr(Node("like", [self.node, lit(pattern), None if escape is None else lit(escape)]))

    def is_in(self, values) -> Expr:
        if isinstance(values, (list, tuple)):
            return Expr(Node("inlist", [self.node, [_node(v) for v in values]]))
        return Expr(Node("in", [self.node, _node(values)]))

    def is_null(self) -> Expr:
        return Expr(Node("isnull", [self.node]))

    def call(self, function: str) -> Expr:
        return Expr(Node("call", [function, self.node]))


def name(n: str) -> Expr:
    first, *rest = n.split(".")
    e = Expr(Node("name", [first]))
    for r in rest:
        e = e.field(r)
    return e


def current() -> Expr:
    return Expr(Node("current"))


def param(i: int) -> Expr:
    return Expr(Node("param", [i]))


def exists(variable: str, body: Expr) -> Expr:
    return Expr(Node("exists", [variable, body.node]))


def contains(collection: str, condition: Expr | None = None, group: Expr | None = None, having: Expr | None = None) -> Expr:
    return Expr(Node("contains", [name(collection).node, *(None if x is None else x.node for x in (condition, group, having))]))


def aggregate(kind: str, e: Expr | None = None) -> Expr:
    return Expr(Node("agg", [kind, None if e is None else e.node]))


def query(where: Expr | None = None, order: list[tuple[Expr, bool]] = ()) -> Query:
    return Query(None if where is None else where.node, [(e.node, up) for e, up in order], 0)


def run(catalog, cls: str, q: Query, *params, null_mode: str = "sql"):
    from tessera.plans.compile import Compiler

    return Compiler(catalog, catalog[cls], params, null_mode).run(q)
