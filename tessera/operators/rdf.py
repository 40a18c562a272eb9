"""Versioned things with properties: one row per property, (uri, version, ts, type, prop, value, number, ref)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.collections import reachable
from tessera.operators.lookup import between

LATEST, ALL, LATEST_BEFORE, OLDEST_AFTER = "latest", "all", "latest_before", "oldest_after"


def wildcard(col: Column, pattern: str) -> Column:
    """* stands for any characters; a plain end or start stays a prefix or suffix test."""
    head, _, tail = pattern.partition("*")
    if "*" not in pattern:
        return col == pattern
    if "*" not in tail and not tail:
        return F.startswith(col, F.lit(head))
    if "*" not in tail and not head:
        return F.endswith(col, F.lit(tail))
    return col.like(pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%"))


def versions(things: DataFrame, kind: str = LATEST, ts=None) -> DataFrame:
    """The rows of the versions that a search kind asks for."""
    if kind == ALL:
        return things
    rows = things if kind == LATEST else things.where(F.col("ts") <= F.lit(ts) if kind == LATEST_BEFORE else F.col("ts") >= F.lit(ts))
    pick = F.min if kind == OLDEST_AFTER else F.max
    chosen = rows.groupBy(F.col("uri").alias("_u")).agg(pick("version").alias("_v"))
    return rows.join(chosen, (F.col("uri") == F.col("_u")) & (F.col("version") == F.col("_v"))).drop("_u", "_v")


def subtypes(types: DataFrame, root: str) -> DataFrame:
    """root and all types below it; types has (type, parent)."""
    below = types.select(F.col("parent").alias("src"), F.col("type").alias("dst"))
    return reachable(below, types.sparkSession.createDataFrame([(root,)], "id string")).select(F.col("id").alias("type"))


@dataclass(frozen=True)
class Region:
    """A pattern for properties with a place (box: x0, y0, x1, y1; a point has x0 = x1 and y0 = y1): what overlaps it."""

    low: tuple[float, float]
    high: tuple[float, float]

    def holds(self) -> Column:
        x0, y0, x1, y1 = (F.get("box", F.lit(i)) for i in range(4))
        return (x0 <= self.high[0]) & (x1 >= self.low[0]) & (y0 <= self.high[1]) & (y1 >= self.low[1])


def _has(things: DataFrame, prop: str, pattern) -> DataFrame:
    """(uri, version) with a property that matches: a text with wildcards, a number, (low, high[, inclusive flags]), a Region, or a dict of patterns for what it refers to."""
    rows = things.where(F.col("prop") == prop)
    if isinstance(pattern, dict):
        targets = None
        for p, v in pattern.items():
            one = _has(things, p, v).select(F.col("uri").alias("ref")).distinct()
            targets = one if targets is None else targets.join(one, "ref", "left_semi")
        rows = rows.join(targets, "ref", "left_semi")
    elif isinstance(pattern, Region):
        rows = rows.where(pattern.holds())
    elif isinstance(pattern, tuple):
        text = any(isinstance(v, str) for v in pattern[:2])
        rows = rows.where(between(F.col("value" if text else "number"), *pattern))
    elif isinstance(pattern, str):
        rows = rows.where(wildcard(F.col("value"), pattern))
    else:
        rows = rows.where(F.col("number") == F.lit(float(pattern)))
    return rows.select("uri", "version").distinct()


def search(things: DataFrame, type_: str | None = None, uri: str | None = None, properties: dict | None = None, kind: str = LATEST, ts=None, types: DataFrame | None = None) -> DataFrame:
    """(uri, version) of the things that match a type (with subtypes if given), a uri and all property patterns."""
    rows = versions(things, kind, ts)
    out = rows.select("uri", "version", "type").distinct()
    if uri is not None:
        out = out.where(wildcard(F.col("uri"), uri))
    if type_ is not None:
        out = out.where(F.col("type") == type_) if types is None else out.join(subtypes(types, type_), "type", "left_semi")
    for p, v in (properties or {}).items():
        out = out.join(_has(rows, p, v), ["uri", "version"], "left_semi")
    return out.select("uri", "version")


def keywords(things: DataFrame, text: str) -> DataFrame:
    """(uri, version) whose property values hold all words of a text."""
    from tessera.operators.fulltext import word_list

    asked = sorted({w.lower() for w in text.split()})
    rows = things.select("uri", "version", F.explode(word_list(F.coalesce("value", F.lit("")))).alias("word")).where(F.col("word").isin(asked))
    return rows.groupBy("uri", "version").agg(F.count_distinct("word").alias("n")).where(F.col("n") == len(asked)).select("uri", "version")


def dump(things: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, depth, uri, prop, value, number, ref) of things reached from roots (uri) in at most depth steps.

    Joined by shuffle only: things made from a small file may be many, and Spark would broadcast them by the file's size.
    """
    properties = things.drop("version", "ts", "type").hint("merge")
    now = roots.select(F.col("uri").alias("root"), "uri").distinct()
    out = None
    for d in range(depth + 1):
        rows = now.join(properties, "uri").withColumn("depth", F.lit(d))
        out = rows if out is None else out.unionByName(rows)
        now = rows.where("ref is not null").select("root", F.col("ref").alias("uri")).distinct()
    return out.select("root", "depth", "uri", "prop", "value", "number", "ref")


@dataclass
class Find:
    """What a find document asks for: the arguments of search(), and how deep its results are dumped."""

    type_: str | None = None
    uri: str | None = None
    properties: dict[str, Any] = field(default_factory=dict)
    kind: str = LATEST
    ts: datetime | None = None
    depth: int = 0

    def run(self, things: DataFrame, types: DataFrame | None = None) -> DataFrame:
        return search(things, self.type_, self.uri, self.properties, self.kind, self.ts, types)


#: Names of a find document that aren't properties, whatever their namespace.
BEFORE, AFTER, EVERY, DEPTH, URI, THING = "before", "after", "all", "depth", "about", "thing"


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _number(text: str) -> float | str:
    try:
        return float(text) if re.match(r"[+\-0-9]", text) else text
    except ValueError:
        return text


def _pattern(text: str) -> Any:
    """[low, high] and (low, high) are ranges, with or without their bounds; a number is one; the rest are texts with wildcards."""
    m = re.fullmatch(r"([\[(])([^,]+),(.+)([\])])", text)
    if m is None:
        return _number(text)
    low, high = _number(m[2].strip()), _number(m[3].strip())
    if type(low) is not type(high):
        low, high = m[2].strip(), m[3].strip()
    return low, high, m[1] == "[", m[4] == "]"


def find_document(xml: str) -> list[Find]:
    """The searches of a find document: each child of its root names a type (or thing, for any).

    Attributes: about (a URI, with wildcards), before or after (a time), all, depth; others are properties. Child
    elements are properties, by their text, or by their own properties for what they refer to.
    """

    def properties(e: ET.Element) -> dict[str, Any]:
        found = {_local(k): _pattern(v) for k, v in e.attrib.items() if _local(k) not in (BEFORE, AFTER, EVERY, DEPTH, URI)}
        for c in e:
            inner = properties(c)
            found[_local(c.tag)] = inner or _pattern((c.text or "").strip())
        return found

    out = []
    for e in ET.fromstring(xml):
        given = {_local(k): v for k, v in e.attrib.items()}
        find = Find(None if _local(e.tag).lower() == THING else _local(e.tag), given.get(URI), properties(e))
        if EVERY in given:
            find.kind = ALL if given[EVERY].lower() == "true" else LATEST
        for name, kind in ((BEFORE, LATEST_BEFORE), (AFTER, OLDEST_AFTER)):
            if name in given:
                find.kind, find.ts = kind, datetime.fromisoformat(given[name])
        find.depth = int(given.get(DEPTH, 0))
        out.append(find)
    return out
