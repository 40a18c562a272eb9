"""Associative data: one row per attribute value, (item, attr, pos, text, number, ref)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.fulltext import Index, parse

SCHEMA = "item string, attr string, pos int, text string, number double, ref string"


def from_table(df: DataFrame, cls: str, key: str, texts: list[str] = (), numbers: list[str] = (), refs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A table as items `cls:key`; refs: attribute -> (own column, class of the target)."""
    item = F.concat(F.lit(f"{cls}:"), F.col(key).cast("string"))
    no = F.lit(None)
    rows = [F.struct(F.lit("class").alias("attr"), F.lit(cls).alias("text"), no.cast("double").alias("number"), no.cast("string").alias("ref"))]
    rows += [F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("text"), no.cast("double").alias("number"), no.cast("string").alias("ref")) for c in texts]
    rows += [F.struct(F.lit(c).alias("attr"), no.cast("string").alias("text"), F.col(c).cast("double").alias("number"), no.cast("string").alias("ref")) for c in numbers]
    rows += [F.struct(F.lit(a).alias("attr"), no.cast("string").alias("text"), no.cast("double").alias("number"), F.concat(F.lit(f"{t}:"), F.col(c).cast("string")).alias("ref")) for a, (c, t) in (refs or {}).items()]
    return df.select(item.alias("item"), F.explode(F.array(*rows)).alias("x")).select("item", "x.attr", F.lit(0).alias("pos"), "x.text", "x.number", "x.ref")


def _value(v) -> tuple[str, Column]:
    return ("text", F.lit(v.lower())) if isinstance(v, str) else ("number", F.lit(float(v)))


def _items(eav: DataFrame, attr: str, test: Column) -> DataFrame:
    return eav.where((F.col("attr") == attr) & test).select("item").distinct()


def compare(eav: DataFrame, attr: str, op: str, value) -> DataFrame:
    """Items with a value of attr that stands in a relation to value; strings compare in lower case."""
    column, v = _value(value)
    c = F.lower(column) if column == "text" else F.col(column)
    return _items(eav, attr, {"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op])


def starts_with(eav: DataFrame, attr: str, start: str) -> DataFrame:
    return _items(eav, attr, F.startswith(F.lower("text"), F.lit(start.lower())))


def is_prefix_of(eav: DataFrame, attr: str, word: str) -> DataFrame:
    return _items(eav, attr, F.lower("text").isin([word.lower()[:i] for i in range(len(word) + 1)]))


def in_array(eav: DataFrame, attr: str, values: list) -> DataFrame:
    column, _ = _value(values[0])
    c = F.lower(column) if column == "text" else F.col(column)
    return _items(eav, attr, c.isin([v.lower() if isinstance(v, str) else float(v) for v in values]))


def between(eav: DataFrame, attr: str, low, high) -> DataFrame:
    column, lo = _value(low)
    c = F.lower(column) if column == "text" else F.col(column)
    return _items(eav, attr, c.between(lo, _value(high)[1]))


def both(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "item", "left_semi"), sets)


def either(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionAll(b), sets).distinct()


def related(eav: DataFrame, attr: str, targets: DataFrame) -> DataFrame:
    """Items whose relation attr points into targets; -attr is the inverse: items that targets point to."""
    if attr.startswith("-"):
        return eav.where(F.col("attr") == attr[1:]).join(targets, "item", "left_semi").select(F.col("ref").alias("item")).where("item is not null").distinct()
    return eav.where(F.col("attr") == attr).join(targets.select(F.col("item").alias("ref")), "ref", "left_semi").select("item").distinct()


def occurrences(eav: DataFrame, attr: str, descending: bool = False) -> DataFrame:
    """Items that have attr with each value, in its order."""
    rows = eav.where(F.col("attr") == attr).select("item", "pos", "text", "number", "ref")
    keys = [F.lower("text"), F.col("number"), F.col("ref"), F.col("item"), F.col("pos")]
    return rows.orderBy(*[k.desc() if descending else k for k in keys])


def order_by(eav: DataFrame, items: DataFrame, attrs: list[tuple[str, bool]]) -> DataFrame:
    """Items in order of their first values of attributes: (attr, ascending)."""
    out = items
    for i, (a, _) in enumerate(attrs):
        first = eav.where((F.col("attr") == a) & (F.col("pos") == 0)).select("item", F.struct(F.lower("text").alias("t"), "number").alias(f"_k{i}"))
        out = out.join(first, "item", "left")
    return out.orderBy(*[F.col(f"_k{i}").asc_nulls_first() if up else F.col(f"_k{i}").desc_nulls_last() for i, (_, up) in enumerate(attrs)], "item").select("item")


def link(eav: DataFrame, new: DataFrame) -> DataFrame:
    """Appends values (item, attr, text, number, ref) after those that are there."""
    last = eav.groupBy("item", "attr").agg((F.max("pos") + 1).alias("_next"))
    placed = new.join(last, ["item", "attr"], "left").withColumn("pos", F.coalesce("_next", F.lit(0)))
    return eav.unionByName(placed.select(*eav.columns))


def link_at(eav: DataFrame, item: str, attr: str, pos: int, text: str | None = None, number: float | None = None, ref: str | None = None) -> DataFrame:
    here = (F.col("item") == item) & (F.col("attr") == attr)
    moved = eav.withColumn("pos", F.when(here & (F.col("pos") >= pos), F.col("pos") + 1).otherwise(F.col("pos")))
    return moved.unionByName(eav.sparkSession.createDataFrame([(item, attr, pos, text, number, ref)], SCHEMA))


def unlink(eav: DataFrame, item: str, attr: str, pos: int | None = None) -> DataFrame:
    """Without an attribute of an item, or without its value at a place; later values move up."""
    here = (F.col("item") == item) & (F.col("attr") == attr)
    if pos is None:
        return eav.where(~here)
    kept = eav.where(~(here & (F.col("pos") == pos)))
    return kept.withColumn("pos", F.when(here & (F.col("pos") > pos), F.col("pos") - 1).otherwise(F.col("pos")))


def update(eav: DataFrame, item: str, attr: str, text: str | None = None, number: float | None = None, ref: str | None = None, pos: int = 0) -> DataFrame:
    here = (F.col("item") == item) & (F.col("attr") == attr) & (F.col("pos") == pos)
    for c, v, t in (("text", text, "string"), ("number", number, "double"), ("ref", ref, "string")):
        eav = eav.withColumn(c, F.when(here, F.lit(v).cast(t)).otherwise(F.col(c)))
    return eav


def rename(eav: DataFrame, item: str, old: str, new: str) -> DataFrame:
    return eav.withColumn("attr", F.when((F.col("item") == item) & (F.col("attr") == old), new).otherwise(F.col("attr")))


def remove(eav: DataFrame, items: DataFrame) -> DataFrame:
    """Without the items, and without the relations that point to them."""
    kept = eav.join(items.select("item"), "item", "left_anti")
    return kept.join(items.select(F.col("item").alias("ref")), "ref", "left_anti").select(*eav.columns)


def verbs(eav: DataFrame) -> DataFrame:
    return eav.select("attr").distinct()


def attribute_map(eav: DataFrame) -> DataFrame:
    """item, attributes: a map of each attribute to its values as text, in their order."""
    value = F.coalesce("text", F.col("number").cast("string"), "ref")
    per = eav.groupBy("item", "attr").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]).alias("values"))
    return per.groupBy("item").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "values")))).alias("attributes"))


def full_text(eav: DataFrame, attrs: list[str]) -> DataFrame:
    """item and text of the attributes, for a full-text index."""
    rows = eav.where(F.col("attr").isin(attrs) & F.col("text").isNotNull())
    return rows.groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("attr", "pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def match(eav: DataFrame, attrs: list[str], query: str) -> DataFrame:
    """Items whose attributes a full-text query selects, as a set for both() and either()."""
    return Index(full_text(eav, attrs), "item", "text").match(parse(query)).select(F.col("doc").alias("item"))
