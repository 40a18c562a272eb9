"""Compiles predicates to joins and Columns, so that Catalyst sees one plain plan.

Navigation a.b.c becomes one left join per distinct path (null-rejecting filters turn it into an inner one).
Contains over a collection held by foreign key becomes a semi-join, over an embedded array a lambda. A null
string reads as ''; errors are nulls, which filters drop. null_mode "sql" is three-valued logic; "lenient"
reads an error left of AND as true.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalar
from tessera.plans.ast import CompileError, Node, Query, parse
from tessera.plans.listener import pushed
from tessera.sources.catalog import Catalog, ClassDef


@dataclass(frozen=True)
class Value:
    col: Column | None
    type: str  # int real str date bool bin obj coll array struct null list
    spark: T.DataType | None = None
    ci: bool = False
    path: tuple[str, ...] = ()
    cls: ClassDef | None = None
    literal: Any = None


#: Values of a list beyond which `in` joins a table of them.
MANY = 1000


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return {"BooleanType": "bool", "BinaryType": "bin", "ArrayType": "array", "StructType": "struct", "NullType": "null"}.get(type(t).__name__, "any")


def typed(col: Column, t: T.DataType, **more) -> Value:
    kind = kind_of(t)
    if kind == "int":
        col = col.cast("long")
    elif kind == "real":
        col = col.cast("double")
    return Value(col, kind, t, **more)


def literal(v: Any) -> Value:
    if v is None:
        return Value(F.lit(None), "null")
    if isinstance(v, (list, tuple, set, frozenset)):
        return Value(None, "list", literal=list(v))
    kind = {bool: "bool", int: "int", float: "real", str: "str", datetime: "date", date: "date", bytes: "bin"}.get(type(v))
    if kind is None:
        raise CompileError(f"a parameter can't be a {type(v).__name__}")
    return Value(F.lit(v).cast("long") if kind == "int" else F.lit(v), kind, literal=v)


class Compiler:
    """One use of a class in a query: its DataFrame grows by the joins that its expressions need."""

    def __init__(self, catalog: Catalog, cls: ClassDef, params: Sequence[Any] = (), null_mode: str = "sql", prefix: str = "", outer: Compiler | None = None, overflow: str = "null"):
        self.catalog, self.cls, self.params, self.null_mode, self.overflow = catalog, cls, list(params), null_mode, overflow
        self.prefix, self.outer = prefix, outer
        base = catalog.extent(cls.name)
        self.schema = base.schema
        self.df = base if not prefix else base.select(*[F.col(f"`{c}`").alias(prefix + c) for c in base.columns])
        self.joined: dict[tuple[str, ...], ClassDef] = {(): cls}
        self.scopes: list[dict[str, Value]] = []
        self.aggregates: list[Column] | None = None
        self.outer_fields: set[str] = set()
        self.markers = 0

    # names and paths

    def _prefix(self, path: tuple[str, ...]) -> str:
        return self.prefix + "".join(f"{p}__" for p in path)

    def _join(self, path: tuple[str, ...]) -> ClassDef:
        if path in self.joined:
            return self.joined[path]
        owner = self._join(path[:-1])
        fk, target = owner.references[path[-1]]
        cls, prefix = self.catalog[target], self._prefix(path)
        here = f"{self._prefix(path[:-1])}{fk}"
        if target in self.catalog.resolvers:  # the record referred to leads to the one in its place
            column, final = self.catalog.resolvers[target]
            between = self.catalog.extent(target).select(F.col(f"`{cls.key}`").alias(f"{prefix}__key"), F.col(f"`{column}`").alias(f"{prefix}__to"))
            self.df = self.df.join(between, F.col(f"`{here}`") == F.col(f"`{prefix}__key`"), "left")
            cls, target, here = self.catalog[final], final, f"{prefix}__to"
        df = self.catalog.extent(target)
        df = df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])
        self.df = self.df.join(df, F.col(f"`{here}`") == F.col(f"`{prefix}{cls.key}`"), "left")
        self.joined[path] = cls
        return cls

    def _member(self, path: tuple[str, ...], cls: ClassDef, name: str, at: int) -> Value | None:
        """A member of the class at a path, or None."""
        schema = self.schema if not path else self.catalog.extent(cls.name).schema
        if name in schema.names:
            self._join(path)
            return typed(F.col(f"`{self._prefix(path)}{name}`"), schema[name].dataType, ci=name in cls.ci_fields)
        if name in cls.references:
            target = self.catalog.resolved(cls.references[name][1])
            fk = F.col(f"`{self._prefix(path)}{cls.references[name][0]}`")
            self._join(path)
            return Value(fk, "obj", path=(*path, name), cls=target)
        if name in cls.collections:
            return Value(None, "coll", path=(*path, name), cls=cls)
        for m in (name, f"get{name[:1].upper()}{name[1:]}"):
            if m in cls.methods:
                return self._call(path, cls, m, [])
        return None

    def _call(self, path: tuple[str, ...], cls: ClassDef, name: str, args: list[Value]) -> Value:
        if name not in cls.methods:
            raise CompileError(f"no method {name} in {cls.name}")
        self._join(path)
        col = cls.methods[name](lambda c: F.col(f"`{self._prefix(path)}{c}`"), *[a.col for a in args])
        return typed(col, self.df.select(col).schema[0].dataType)

    def name(self, node: Node) -> Value:
        name = node.args[0]
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
            element = scope.get("")
            if element is not None and element.type == "struct" and name in element.spark.names:
                return typed(element.col[name], element.spark[name].dataType)
        if (v := self._member((), self.cls, name, node.at)) is not None:
            return v
        if self.outer is not None and name in self.outer.schema.names:
            self.outer_fields.add(name)
            return typed(F.col(f"`outer__{name}`"), self.outer.schema[name].dataType, ci=name in self.outer.cls.ci_fields)
        raise CompileError(f"no field or method {name} in {self.cls.name}", node.at)

    def field(self, node: Node) -> Value:
        base, name = self.value(node.args[0]), node.args[1]
        if base.type == "obj":
            if (v := self._member(base.path, base.cls, name, node.at)) is not None:
                return v
        elif base.type == "struct" and name in base.spark.names:
            return typed(base.col[name], base.spark[name].dataType)
        raise CompileError(f"no field {name}", node.at)

    # expressions

    def value(self, node: Node) -> Value:
        k, a = node.kind, node.args
        if k in ("int", "real", "str", "bool"):
            return literal(a[0])
        if k == "null":
            return literal(None)
        if k == "param":
            if a[0] > len(self.params):
                raise CompileError(f"parameter {a[0]} has no value", node.at)
            return literal(self.params[a[0] - 1])
        if k == "current":
            key = self.cls.key
            return Value(F.col(f"`{self.prefix}{key}`") if key else None, "obj", path=(), cls=self.cls)
        if k == "name":
            return self.name(node)
        if k == "field":
            return self.field(node)
        if k == "method":
            return self.method(node)
        if k == "at":
            return self.item(self.value(a[0]), self.value(a[1]), node.at)
        if k == "arith":
            return self.arith(a[0], self.value(a[1]), self.value(a[2]), node.at)
        if k == "neg":
            v = self.value(a[0])
            if v.type not in ("int", "real"):
                raise CompileError("a number expected", node.at)
            return Value(-v.col if v.type == "real" else scalar.int_op("-", F.lit(0).cast("long"), v.col, self.overflow), v.type)
        if k == "call":
            return self.function(a[0], self.value(a[1]), node.at)
        if k == "agg":
            return self.aggregate(node)
        return self.logic(node)

    def method(self, node: Node) -> Value:
        target, args = node.args[0], [self.value(x) for x in node.args[1]]
        if target.kind == "name":
            return self._call((), self.cls, target.args[0], args)
        base = self.value(target.args[0])
        if base.type != "obj":
            raise CompileError("an object expected", node.at)
        return self._call(base.path, base.cls, target.args[1], args)

    def item(self, base: Value, i: Value, at: int) -> Value:
        if i.type != "int":
            raise CompileError("an index is a whole number", at)
        if base.type == "str":
            return Value(scalar.char_at(self.text(base), i.col), "int")
        if base.type != "array":
            raise CompileError("an array or string expected", at)
        return typed(F.get(base.col, F.when(i.col >= 0, i.col.cast("int")).otherwise(-1)), base.spark.elementType)

    def arith(self, op: str, a: Value, b: Value, at: int) -> Value:
        if op == "+" and a.type == b.type == "str":
            return Value(F.concat(self.text(a), self.text(b)), "str")
        if {a.type, b.type} - {"int", "real", "any"}:
            raise CompileError(f"{op} can't take {a.type} and {b.type}", at)
        if a.type == b.type == "int":
            if op == "/":
                return Value(scalar.int_div(a.col, b.col), "int")
            return Value(scalar.int_pow(a.col, b.col) if op == "^" else scalar.int_op(op, a.col, b.col, self.overflow), "int")
        x, y = a.col.cast("double"), b.col.cast("double")
        made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: scalar.real_div(x, y), "^": lambda: F.pow(x, y)}
        return Value(made[op](), "real")

    def function(self, name: str, v: Value, at: int) -> Value:
        def want(*types: str) -> None:
            if v.type not in (*types, "any"):
                raise CompileError(f"{name} can't take {v.type}", at)

        if name in ("lower", "upper"):
            want("str")
            return Value(getattr(F, name)(self.text(v)), "str")
        if name == "length":
            want("str", "array")
            return Value((F.size(v.col) if v.type == "array" else F.char_length(self.text(v))).cast("long"), "int")
        if name == "string":
            return Value(v.col.cast("string"), "str")
        if name == "integer":
            want("int", "real")
            return Value(scalar.to_int(v.col), "int")
        want("int", "real")
        if name == "real":
            return Value(v.col.cast("double"), "real")
        if name == "abs":
            return Value(F.abs(v.col), v.type)
        x = v.col.cast("double")
        special = {"ceal": scalar.ceil, "floor": scalar.floor, "log": scalar.log}
        return Value(special[name](x) if name in special else getattr(F, name)(x), "real")

    def aggregate(self, node: Node) -> Value:
        if self.aggregates is None:
            raise CompileError("an aggregate stands only in having", node.at)
        name, arg = node.args
        if name == "count":
            col, kind = F.count(F.lit(1)), "int"
        else:
            v = self.value(arg)
            if v.type not in ("int", "real"):
                raise CompileError(f"{name} can't take {v.type}", node.at)
            kind = v.type
            if name == "avg" and kind == "int":
                col = F.call_function("div", F.sum(v.col), F.count(v.col))
            else:
                col = getattr(F, name)(v.col)
        self.aggregates.append(col.alias(f"__agg{len(self.aggregates)}"))
        return Value(F.col(f"__agg{len(self.aggregates) - 1}"), kind)

    # conditions

    def text(self, v: Value) -> Column:
        return F.coalesce(v.col, F.lit("")) if v.literal is None else v.col

    def known(self, x: Value, test: Column) -> Column:
        """A test that '' fails, on the raw column: false for null, and fit for the scan to push down."""
        return test & x.col.isNotNull()

    def logic(self, node: Node) -> Value:
        k, a = node.kind, node.args
        if k in ("and", "or"):
            x, y = self.value(a[0]), self.value(a[1])
            if x.type == y.type == "int":
                return Value(x.col.bitwiseAND(y.col) if k == "and" else x.col.bitwiseOR(y.col), "int")
            self._boolean(x, y, at=node.at)
            if k == "or":
                return Value(F.coalesce(x.col, F.lit(False)) | y.col, "bool")
            return Value((F.coalesce(x.col, F.lit(True)) if self.null_mode == "lenient" else x.col) & y.col, "bool")
        if k == "not":
            x = self.value(a[0])
            if x.type == "int":
                return Value(F.bitwise_not(x.col), "int")
            self._boolean(x, at=node.at)
            return Value(~x.col, "bool")
        if k == "isnull":
            x = self.value(a[0])
            if x.type not in ("obj", "str", "date", "array", "struct", "bin", "null", "any"):
                raise CompileError(f"is null can't take {x.type}", node.at)
            return Value(x.col.isNull(), "bool")
        if k == "compare":
            return Value(self.compare(a[0], self.value(a[1]), self.value(a[2]), node.at), "bool")
        if k == "between":
            x, lo, hi = (self.value(n) for n in a)
            return Value(self.compare(">=", x, lo, node.at) & self.compare("<=", x, hi, node.at), "bool")
        if k == "like":
            return self.like(*a, node.at)
        if k == "inlist":
            x, values = self.value(a[0]), [self.value(n) for n in a[1]]
            if all(v.literal is not None for v in values) and x.type in ("int", "real", "str") and not x.ci and {v.type for v in values} == {x.type}:
                test = x.col.isin([v.literal for v in values])
                return Value(test if x.type != "str" else self.known(x, test) if all(v.literal for v in values) else self.text(x).isin([v.literal for v in values]), "bool")
            out = F.lit(False)
            for v in values:
                out = out | self.compare("=", x, v, node.at)
            return Value(out, "bool")
        if k == "in":
            return self.within(self.value(a[0]), self.value(a[1]), node.at)
        if k == "exists":
            return self.exists(*a, node.at)
        if k == "contains":
            return self.contains(*a, node.at)
        raise CompileError(f"unexpected {k}", node.at)

    def _boolean(self, *values: Value, at: int) -> None:
        for v in values:
            if v.type not in ("bool", "any"):
                raise CompileError(f"a condition expected, not {v.type}", at)

    def compare(self, op: str, x: Value, y: Value, at: int) -> Column:
        types = {x.type, y.type}
        if types == {"date", "str"}:
            x, y = (v if v.type == "date" else Value(scalar.to_date(v.col), "date") for v in (x, y))
        elif types == {"int", "real"}:
            x, y = (replace(v, col=v.col.cast("double"), type="real") for v in (x, y))
        elif types == {"str"}:
            ci = x.ci or y.ci
            if not ci and x.literal is None and y.literal and op in ("=", ">", ">="):
                return self.known(x, {"=": x.col == y.col, ">": x.col > y.col, ">=": x.col >= y.col}[op])
            x, y = (Value(F.lower(self.text(v)) if ci else self.text(v), "str") for v in (x, y))
        elif "obj" in types or "null" in types:
            if op not in ("=", "<>"):
                raise CompileError(f"{op} can't take {x.type} and {y.type}", at)
            same = x.col.eqNullSafe(y.col)
            return same if op == "=" else ~same
        elif len(types) > 1 and "any" not in types:
            raise CompileError(f"{op} can't take {x.type} and {y.type}", at)
        elif types & {"bool", "bin"} and op not in ("=", "<>"):
            raise CompileError(f"{op} can't take {x.type}", at)
        a, b = x.col, y.col
        if x.type == "real":  # NaN equals nothing, itself included
            plain = ~(F.isnan(a) | F.isnan(b))
            if op in ("=", "<", "<=", ">", ">="):
                return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op] & plain if x.literal is None and y.literal is None else {"=": a == b, "<": a < b, "<=": a <= b, ">": (a > b) & ~F.isnan(a), ">=": (a >= b) & ~F.isnan(a)}[op]
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def like(self, left: Node, pattern: Node, escape: Node | None, at: int) -> Value:
        x, p = self.value(left), self.value(pattern)
        if x.type != "str" or p.type != "str":
            raise CompileError("like takes strings", at)
        a, b = self.text(x), self.text(p)
        if x.ci:
            a, b = F.lower(a), F.lower(b)
        if escape is not None:
            return Value(F.like(a, b, self.value(escape).col), "bool")
        if p.literal is not None:
            text = p.literal.lower() if x.ci else p.literal
            if not x.ci and x.literal is None and text.strip("%"):
                return Value(self.known(x, x.col.like(text.replace("\\", "\\\\"))), "bool")
            return Value(a.like(text.replace("\\", "\\\\")), "bool")
        return Value(F.like(a, F.replace(b, F.lit("\\"), F.lit("\\\\"))), "bool")

    def within(self, x: Value, y: Value, at: int) -> Value:
        if y.type == "list" and len(y.literal) > MANY and not self.scopes:
            # a table of the values, joined: what it marks is in it
            self.markers += 1
            mark, col = f"__in{self.markers}", self.text(x) if x.type == "str" else x.col
            kind = {"int": "long", "real": "double", "str": "string"}.get(x.type)
            values = sorted({v for v in y.literal if v is not None})
            table = self.df.sparkSession.createDataFrame([(v,) for v in values], f"{mark} {kind}" if kind else [mark])
            self.df = self.df.join(table, col == F.col(mark), "left")
            return Value(F.when(col.isNotNull(), F.col(mark).isNotNull()), "bool")
        if y.type == "list":
            return Value(self.known(x, x.col.isin(y.literal)) if x.type == "str" and all(y.literal) else (self.text(x) if x.type == "str" else x.col).isin(y.literal), "bool")
        if y.type == "array":
            return Value(F.array_contains(y.col, x.col.cast(y.spark.elementType)), "bool")
        if x.type == y.type == "str":
            return Value(F.contains(self.text(y), self.text(x)), "bool")
        raise CompileError(f"in can't take {x.type} and {y.type}", at)

    def exists(self, name: str, body: Node, at: int) -> Value:
        sizes: list[Column] = []

        def scan(n: Any) -> None:
            if isinstance(n, Node):
                if n.kind == "at" and isinstance(n.args[1], Node) and n.args[1].kind == "name" and n.args[1].args[0] == name:
                    arr = self.value(n.args[0])
                    sizes.append(F.size(arr.col) if arr.type == "array" else F.char_length(self.text(arr)))
                for x in n.args:
                    scan(x)
            elif isinstance(n, list):
                for x in n:
                    scan(x)

        scan(body)
        if not sizes:
            raise CompileError(f"{name} indexes no array", at)
        n = F.coalesce(sizes[0] if len(sizes) == 1 else F.least(*sizes), F.lit(0))
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return Value(F.exists(places, self._lambda(name, lambda i: Value(i.cast("long"), "int"), body, at)), "bool")

    def _lambda(self, name: str, wrap: Callable[[Column], Value], body: Node, at: int) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            self.scopes.append({name: wrap(x)})
            try:
                v = self.value(body)
            finally:
                self.scopes.pop()
            self._boolean(v, at=at)
            return v.col

        return run

    def contains(self, coll: Node, cond: Node | None, group: Node | None, having: Node | None, at: int) -> Value:
        target = self.value(coll)
        if target.type == "array":
            element = target.spark.elementType
            if having is None:
                return Value(F.exists(target.col, self._lambda("", lambda x: Value(x, kind_of(element), element), cond, at)), "bool")
            if kind_of(element) != "struct" or coll.kind != "name" or self.cls.key is None or self.prefix:
                raise CompileError("group by needs a collection of records of a class with a key", at)
            # the elements as a class of their own, which knows its owner
            name = f"{self.cls.name}.{coll.args[0]}"
            elements = self.catalog.extent(self.cls.name).select(F.col(f"`{self.cls.key}`").alias("__owner"), F.explode(f"`{coll.args[0]}`").alias("__e")).select("__owner", "__e.*")
            owner = replace(self.cls, collections={**self.cls.collections, name: (name, "__owner")})
            self.catalog = self.catalog.extended(ClassDef(name, elements))
            target = Value(None, "coll", path=(name,), cls=owner)
        if target.type != "coll":
            raise CompileError("a collection expected", at)
        self.markers += 1
        keys = self.holders(target, cond, group, having, at).select(F.col("__key").alias(f"__m{self.markers}"))
        self._join(target.path[:-1])
        self.df = self.df.join(keys, F.col(f"`{self._prefix(target.path[:-1])}{target.cls.key}`") == F.col(f"__m{self.markers}"), "left")
        return Value(F.col(f"__m{self.markers}").isNotNull(), "bool")

    def holders(self, target: Value, cond: Node | None, group: Node | None, having: Node | None, at: int) -> DataFrame:
        """The distinct keys (__key) of records whose collection has a member, or a group of members, as asked."""
        child, fk = target.cls.collections[target.path[-1]]
        sub = Compiler(self.catalog, self.catalog[child], self.params, self.null_mode, "el__", self, self.overflow)
        where = sub.value(cond).col if cond is not None else None
        if having is not None:
            by = sub.value(group).col
            sub.aggregates = []
            test = sub.value(having).col
        df = sub.df
        if sub.outer_fields:
            if len(target.path) != 1:
                raise CompileError("a condition on a collection further away can't name the record's own fields", at)
            mine = self.catalog.extent(self.cls.name).select(F.col(self.cls.key).alias("outer__key"), *[F.col(c).alias(f"outer__{c}") for c in sorted(sub.outer_fields)])
            df = df.join(mine, F.col(f"el__{fk}") == F.col("outer__key"))
        if where is not None:
            df = df.where(where)
        df = df.withColumn("__key", F.col(f"el__{fk}"))
        if having is not None:
            df = df.groupBy("__key", by.alias("__by")).agg(*sub.aggregates or [F.count(F.lit(1)).alias("__n")]).where(test)
        return df.where(F.col("__key").isNotNull()).select("__key").distinct()

    # queries

    def conjuncts(self, node: Node) -> list[Node]:
        return [x for n in node.args for x in self.conjuncts(n)] if node.kind == "and" else [node]

    def run(self, query: Query) -> DataFrame:
        tests = []
        if query.where is not None:
            parts = [query.where] if self.null_mode == "lenient" else self.conjuncts(query.where)
            for n in parts:
                if n.kind == "contains" and (target := self.value(n.args[0])).type == "coll" and len(target.path) == 1:
                    keys = self.holders(target, *n.args[1:], n.at)
                    self.df = self.df.join(keys, F.col(f"`{self.cls.key}`") == F.col("__key"), "left_semi")
                    continue
                v = self.value(n)
                self._boolean(v, at=n.at)
                tests.append(v.col)
        order = []
        for e, up in query.order:
            v = self.value(e)
            col = F.lower(v.col) if v.ci and v.type == "str" else v.col
            order.append(col.asc_nulls_first() if up else col.desc_nulls_last())
        df = self.df
        for t in tests:
            df = df.where(t)
        if order:
            df = df.orderBy(*order, *([F.col(f"`{self.cls.key}`")] if self.cls.key else []))
        return df.select(*[F.col(f"`{c}`") for c in self.schema.names])


class Prepared:
    """A parsed predicate over a class; parameters are numbered from 1."""

    def __init__(self, catalog: Catalog, cls: str, text: str, null_mode: str = "sql", overflow: str = "null"):
        self.catalog, self.cls, self.text, self.query, self.null_mode, self.overflow = catalog, catalog[cls], text, parse(text), null_mode, overflow
        self.params: list[Any] = [None] * self.query.parameters

    def set_parameter(self, i: int, value: Any) -> Prepared:
        if not 1 <= i <= len(self.params):
            raise CompileError(f"no parameter {i}")
        self.params[i - 1] = value
        return self

    def execute(self, *params: Any) -> DataFrame:
        df = Compiler(self.catalog, self.cls, params or self.params, self.null_mode, overflow=self.overflow).run(self.query)
        if self.catalog.listeners:
            scanned = not pushed(df)
            for x in self.catalog.listeners:
                x.compiled(self.cls.name, self.text)
                if scanned:
                    x.sequential_scan(self.cls.name, self.text)
                if self.query.order:
                    x.sorted(self.cls.name, self.text)
        return df


def select(catalog: Catalog, cls: str, predicate: str, *params: Any, null_mode: str = "sql", overflow: str = "null") -> DataFrame:
    """The records of a class (subclasses included) that a predicate selects, in its order."""
    return Prepared(catalog, cls, predicate, null_mode, overflow).execute(*params)


def select_from(df: DataFrame, predicate: str, *params: Any, ci_fields: frozenset[str] = frozenset(), null_mode: str = "sql") -> DataFrame:
    """The same over any DataFrame."""
    return select(Catalog(ClassDef("row", df, ci_fields=ci_fields)), "row", predicate, *params, null_mode=null_mode)


def value_of(catalog: Catalog, cls: str, expression: str, *params: Any) -> tuple[DataFrame, Column]:
    """The DataFrame (with its joins) and the Column of an expression, for projections."""
    from tessera.plans.ast import Parser

    parser = Parser(expression)
    node = parser.either()
    c = Compiler(catalog, catalog[cls], params)
    v = c.value(node)
    return c.df, v.col
