import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import aggregates as A
from tessera.functions.user import UserAggregate, user_aggregate
from tessera.operators import assoc, compare, fulltext, lookup, rdf, spatial, timeseries, versions
from tessera.operators import collections as C
from tessera.queries import QUERIES
from tessera.sources import files
from tessera.plans import listener
from tessera.plans.compile import CompileError, select
from tessera.sources import scratch
from tessera.sources.catalog import TABLES, Catalog, ClassDef
from tessera.streaming import streams


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1, 5, "b"), (2, 5, None), (3, None, "a"), (4, 9, "b")], "k int, v int, g string")


def test_aggregates(numbers):
    row = numbers.agg(A.count().alias("n"), A.distinct_count("v").alias("d"), A.top("v", 2).alias("t"), A.variance("v").alias("var"), A.product("v").alias("p"), A.first("g", "k").alias("f"), A.last("g", "k").alias("l")).first()
    assert (row["n"], row["d"], row["t"], row["p"], row["f"], row["l"]) == (4, 3, [9, 5], 225.0, "b", "b") and row["var"] == pytest.approx(32 / 9)
    assert values(A.repeat_count(numbers, [], "v", 2)) == [(1,)]
    assert values(A.aggregate(numbers, ["g"], A.integer_sum("v").alias("s")).where("g is null")) == [(None, 5)]


def test_lookups(numbers):
    assert [r["k"] for r in lookup.range_of(numbers, "v", 5, 9, high_inclusive=False, descending=False).collect()] == [1, 2]
    assert values(lookup.compound_range(numbers, ["v", "k"], (5, 2), (9,)).select("k")) == [(2,), (4,)]
    assert values(lookup.positions(numbers, "k", "k", 3).select("k", "position")) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert values(lookup.kth(numbers, ["k"], 2).select("k")) == [(3,)]
    assert values(lookup.by_example(numbers, v=5, g="b").select("k")) == [(1,)]
    assert values(lookup.box(numbers, {"v": (None, 5)}).select("k")) == [(1,), (2,)]
    assert values(lookup.projection(numbers, "g")) == [("a",), ("b",)]


def test_writes(numbers):
    more = numbers.where("k > 3").withColumn("g", F.lit("new")).unionAll(numbers.where("k = 1").withColumn("k", F.lit(7)))
    assert values(lookup.insert(numbers, more, "k").select("k")) == [(1,), (2,), (3,), (4,), (7,)]
    assert values(lookup.replace(numbers, more, "k").where("k in (4, 7)").select("g")) == [("b",), ("new",)]
    assert values(lookup.append_numbered(numbers, numbers.where("k < 3"), "k", "v").select("k")) == [(1,), (2,), (3,), (4,), (5,), (6,)]


def test_longest_prefix(spark):
    table = spark.createDataFrame([("724885", "ATT"), ("72488547", "BCC")], "p string, name string")
    keys = spark.createDataFrame([("724885",), ("7248854799",), ("7",), ("72488546",)], "k string")
    assert values(lookup.longest_prefix(keys, "k", table, "p", "name").select("k", "name").where("name is not null")) == [("724885", "ATT"), ("72488546", "ATT"), ("7248854799", "BCC")]


def test_spatial(spark):
    boxes = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(100)], "k int, x double, y double")
    b = spatial.Box.of(("x", F.col("x") + 1), ("y", F.col("y") + 1))
    assert boxes.where(b.intersects(spatial.Box.of((2, 3), (2, 3)))).count() == 9
    assert values(spatial.nearest(boxes, b, (0.5, 0.5), 2, "k").select("k", "distance")) == [(0, 0.0), (1, 0.5)]
    other = boxes.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    b2 = spatial.Box.of(("x2", F.col("x2") + 1), ("y2", F.col("y2") + 1))
    assert values(spatial.overlap_join(boxes, b, other, b2, 3.0).select("k", "k2")) == values(boxes.crossJoin(other).where(b.intersects(b2)).select("k", "k2"))
    assert spark.range(1).select(spatial.great_circle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0] == pytest.approx(1.0)
    assert spark.range(1).where(spatial.on_line(F.lit(0.5), F.lit(0.0), (0.0, 0.0), (1.0, 0.0))).count() == 1


def test_overlap_join_of_whole_table(spark, tmp_path):
    rows = [(k, 1 + k * 7 % 50, 900.0 + k * 37 % 400) for k in range(1, 60)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    expected = [(a, b) for a, s, p in rows for b, t, q in rows if a < b and abs(s - t) <= 5 and abs(p - q) <= 100]
    assert values(QUERIES["spatial_overlap_join"](spark, str(tmp_path))) == sorted(expected)


def test_overlap_join_of_full_cells(spark):
    """A cell with many records is shared by tasks, though the file is small."""

    def side(n):
        df = spark.range(0, 4000, 1, 1).select(F.col("id").alias(f"{n}k"), F.lit(10.0).alias(f"{n}x"), (10 + F.col("id") * 0.001).alias(f"{n}y"))
        return df, spatial.Box.of((f"{n}x", F.col(f"{n}x") + 1), (f"{n}y", F.col(f"{n}y") + 0.0105))

    pairs = spatial.overlap_join(*side("a"), *side("b"), 100.0)
    shares = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 21 * 4000 - 110 and len(shares) > 1
    assert pairs.where("abs(ak - bk) > 10").isEmpty() and pairs.distinct().count() == sum(shares)


@pytest.mark.parametrize("block", [1, 7])
def test_overlap_join_of_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(spatial, "BLOCK", block)
    monkeypatch.setattr(spatial, "TASK_PAIRS", 50)
    rng = random.Random(block)

    def rows(n):
        lows = [(rng.choice([-6.0, 0.0, 2.5]) + rng.randrange(8) / 2, rng.randrange(-8, 8) / 2) for _ in range(n)]
        return [(k, x, x + rng.choice([0, 1, 7]), y, y + rng.choice([0, 0.5, 4])) for k, (x, y) in enumerate(lows)] + [(n, None, 1.0, 0.0, 1.0), (n + 1, 0.0, 1.0, 0.0, None)]

    def side(n, data):
        return spark.createDataFrame(data, f"{n}k int, {n}x0 double, {n}x1 double, {n}y0 double, {n}y1 double"), spatial.Box.of((f"{n}x0", f"{n}x1"), (f"{n}y0", f"{n}y1"))

    a, b = rows(60), rows(40)
    got = spatial.overlap_join(*side("a", a), *side("b", b), 3.0)
    assert got.columns == ["ak", "ax0", "ax1", "ay0", "ay1", "bk", "bx0", "bx1", "by0", "by1"]
    expected = [(i, j) for i, *p in a for j, *q in b if None not in p + q and p[0] <= q[1] and p[1] >= q[0] and p[2] <= q[3] and p[3] >= q[2]]
    assert values(got.select("ak", "bk")) == sorted(expected)
    empty = spatial.overlap_join(*side("a", a[:0]), *side("b", b), 3.0)
    assert empty.isEmpty()


def test_best_match_in_whole_table(spark, tmp_path):
    spark.createDataFrame([(k, name) for k, name in enumerate(["kettle", "kernel", "lamp post"], 1)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["patricia_best_match"](spark, str(tmp_path)).select("p_name", "matched", "value")
    assert values(got) == [("kernel", "kerne", 5), ("kettle", "kettl", 5), ("lamp post", "lamp ", 5)]


def test_memory_profile_of_every_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["class"]: r for r in QUERIES["memory_profile"](spark, sf).collect()}
    assert set(got) == set(TABLES)
    assert all(got[t]["records"] == spark.read.parquet(f"{sf}/{t}.parquet").count() and got[t]["size"] > 0 for t in TABLES)


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "g int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "g int, u int, v string")
    assert values(timeseries.as_of(left, right, ["g"], "t", "u", ["v"])) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_versions(spark):
    df = spark.createDataFrame([("a", 1, 10, False), ("a", 2, 20, True), ("b", 3, 15, False), ("b", 4, 25, False)], "id string, tx int, at int, gone boolean")
    h = versions.History(df, "id", ["tx"], "at", "gone")
    assert values(h.current().select("tx")) == [(4,)] and values(h.all().select("tx")) == [(1,), (3,), (4,)]
    assert values(h.time_slice(10, 25).select("tx")) == [(3,), (4,)]
    assert values(h.latest_before(20).select("tx")) == [(2,), (3,)] and values(h.earliest_after(15).select("tx")) == [(2,), (3,)]
    edges = spark.createDataFrame([(3, 1), (3, 2), (2, 1), (4, 3)], "c int, p int")
    assert values(versions.ancestors(edges, "c", "p")) == [(2, 1, 1), (3, 1, 1), (3, 2, 1), (4, 1, 2), (4, 2, 2), (4, 3, 1)]
    base = spark.createDataFrame([(1, 0, "x"), (2, 3, "y")], "k int, v int, t string")
    done, refused = versions.commit(base, spark.createDataFrame([(1, 0, "n"), (2, 2, "late")], base.schema), "k", "v")
    assert values(done) == [(1, 1, "n"), (2, 3, "y")] and values(refused) == [(2, 2, "late")]


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "brown quick dogs, and a fox"), (3, None), (4, "quick, BROWN bear; quickest")], "d int, t string")
    index = fulltext.Index(docs, "d", "t")

    def found(q):
        return [r["doc"] for r in index.match(fulltext.parse(q)).orderBy("doc").collect()]

    assert found("quick") == [1, 2, 4] and found("quick NOT fox") == [4] and found("fox OR bear") == [1, 2, 4]
    assert found('"quick brown"') == [1, 4] and found('"brown quick"') == [2] and found("NOT quick") == [] and found("(fox bear) OR dogs") == [2] and found("the") == []
    ranked = index.search("quick brown").collect()
    assert {r["doc"] for r in ranked} == {1, 2, 4} and ranked[-1]["doc"] == 2
    text = docs.select(fulltext.places(F.lower("t"), "quick").alias("p")).collect()
    assert [r["p"] for r in text] == [[4], [6], [], [0]]
    assert values(index.prefix("quickes")) == [(4,)]


def test_assoc(spark):
    rows = [("p:1", "class", 0, "patient", None, None), ("p:1", "name", 0, "John", None, None), ("p:1", "age", 0, None, 55.0, None), ("p:1", "sees", 0, None, None, "d:1"), ("d:1", "name", 0, "Dr Who", None, None)]
    e = spark.createDataFrame(rows, assoc.SCHEMA)
    assert values(assoc.related(e, "sees", assoc.starts_with(e, "name", "dr"))) == [("p:1",)]
    assert values(assoc.related(e, "-sees", assoc.compare(e, "age", ">", 50))) == [("d:1",)]
    more = assoc.link_at(assoc.link_at(e, "p:1", "name", 0, text="Jack"), "p:1", "name", 2, text="Jim")
    assert assoc.attribute_map(more).where("item = 'p:1'").first()["attributes"]["name"] == ["Jack", "John", "Jim"]
    assert assoc.attribute_map(assoc.unlink(more, "p:1", "name", 1)).where("item = 'p:1'").first()["attributes"]["name"] == ["Jack", "Jim"]
    assert values(assoc.compare(assoc.update(e, "p:1", "age", number=7.0), "age", "=", 7)) == [("p:1",)]
    assert assoc.remove(e, spark.createDataFrame([("d:1",)], "item string")).count() == 3
    assert values(assoc.verbs(assoc.rename(e, "p:1", "sees", "meets"))) == [("age",), ("class",), ("meets",), ("name",)]


def test_rdf(spark):
    t = spark.createDataFrame([("b/1", 1, 1, "book", "title", "A_B", None, None), ("b/1", 2, 5, "book", "title", "AxB", None, None), ("b/1", 2, 5, "book", "by", None, None, "a/1"), ("a/1", 1, 1, "author", "name", "Knuth D", None, None)], "uri string, version int, ts int, type string, prop string, value string, number double, ref string")
    assert values(rdf.search(t, properties={"title": "A_*"})) == [] and values(rdf.search(t, properties={"title": "A_*"}, kind=rdf.ALL)) == [("b/1", 1)]
    assert values(rdf.search(t, properties={"by": {"name": "Knuth*"}})) == [("b/1", 2)]
    assert values(rdf.keywords(t, "d knuth")) == [("a/1", 1)]
    assert rdf.dump(rdf.versions(t), spark.createDataFrame([("b/1",)], "uri string"), 2).count() == 3


def test_dump_of_many_things_in_a_small_file(spark, tmp_path):
    """The file's size says little of the things made from it, so none of its joins is by broadcast."""
    spark.range(0, 300, 1, 1).write.parquet(f"{tmp_path}/keys")
    uri, null = (lambda k: F.concat(F.lit("p/"), k.cast("string"))), F.lit(None)
    t = spark.read.parquet(f"{tmp_path}/keys").select(uri(F.col("id")).alias("uri"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("version"), F.lit(1).alias("ts"), F.lit("p").alias("type"), F.lit("next").alias("prop"), null.cast("string").alias("value"), null.cast("double").alias("number"), F.when(F.col("id") < 100, uri(F.col("id") + 1)).alias("ref"))
    found = rdf.dump(t, t.select("uri"), 2).groupBy("depth").count()
    assert values(found) == [(0, 300 * 20), (1, 100 * 20), (2, 99 * 20)]
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_collections(spark):
    df = spark.createDataFrame([(1, [3, 1, 2], {"a": 1, "c": 3})], "k int, l array<int>, m map<string,int>")
    row = df.select(C.list_insert(F.col("l"), 1, 9), C.list_remove(F.col("l"), 0), C.list_set(F.col("l"), 2, 7), C.list_index(F.col("l"), 5), C.list_sub(F.col("l"), 1, 9), C.map_put(F.col("m"), "a", 5), C.sub_map(F.col("m"), "b"), C.set_add(F.col("l"), 3), C.list_get(F.col("l"), 8)).first()
    assert tuple(row) == ([3, 9, 1, 2], [1, 2], [3, 1, 7], -1, [1, 2], {"a": 5, "c": 3}, {"c": 3}, [3, 1, 2], None)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9)], "src int, dst int")
    assert values(C.reachable(edges, spark.createDataFrame([(1,)], "id int"))) == [(1,), (2,), (3,)]


def test_files(spark, numbers, tmp_path):
    files.save(numbers, f"{tmp_path}/n.parquet", partition_by=["g"])
    assert files.open_store(spark, str(tmp_path), "n")["n"].count() == 4
    files.export_xml(numbers, f"{tmp_path}/x")
    assert values(files.import_xml(spark, f"{tmp_path}/x", "k int, v int, g string").select("k", "v")) == values(numbers.select("k", "v"))
    (tmp_path / "log").write_text("1 ! a ! x\n2 ! b\n3 ! c ! y\n")
    assert values(files.split_lines(spark, f"{tmp_path}/log", " ! ", ["n", "s", "t"])) == [("1", "a", "x"), ("3", "c", "y")]
    key = F.lit("0123456789abcdef")
    assert numbers.where(files.decrypt(files.encrypt(F.col("g"), key), key).cast("string") == F.col("g")).count() == 3
    assert files.blobs(spark, f"{tmp_path}/log").select(files.blob_range(F.col("content"), 4, 1).cast("string")).first()[0] == "a"


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), u, float(m)) for m in range(0, 60, 5) for u in (1, 2)]
    df = spark.createDataFrame(rows, "ts timestamp, u int, v double")
    df.repartition(1).write.parquet(f"{tmp_path}/e")
    source = streams.read(spark, f"{tmp_path}/e", df.schema)
    out = streams.drain(streams.tumbling(source, "ts", "30 minutes", ["u"], A.count().alias("n")), "tumbled", "complete")
    assert values(out.select("u", "n")) == values(streams.tumbling(df, "ts", "30 minutes", ["u"], A.count().alias("n")).select("u", "n")) == [(1, 6), (1, 6), (2, 6), (2, 6)]
    totals = streams.drain(streams.running_totals(streams.read(spark, f"{tmp_path}/e", df.schema), "u", "v"), "totals", "update")
    assert values(totals) == [(1, 12, 330.0), (2, 12, 330.0)]


def test_as_of_of_a_hot_key(spark):
    rng = random.Random(0)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.randrange(500), i) for i in range(300)], "g int, t int, i int")
    right = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3]), u, str(u)) for u in range(0, 500, 7)], "g int, u int, v string")
    plain = values(timeseries.as_of(left, right, ["g"], "t", "u", ["v"]).select("i", "v").fillna("-"))
    for spread in (2, 7, 60):
        assert values(timeseries.as_of(left, right, ["g"], "t", "u", ["v"], spread).select("i", "v").fillna("-")) == plain
    assert len(values(timeseries.blocks(left.where("g = 1"), "t", 50).select("block").distinct())) >= 2


def test_user_aggregate(spark, numbers):
    longest = UserAggregate(lambda: [], lambda s, v: [*s, v], lambda a, b: a + b, lambda s: ",".join(sorted(str(x) for x in s)), "string")
    assert values(user_aggregate(numbers.repartition(3), ["g"], "all", "v", longest).fillna("-", ["g"])) == [("-", "5"), ("a", "None"), ("b", "5,9")]
    assert user_aggregate(numbers.limit(0), ["g"], "all", "v", longest).count() == 0
    assert values(user_aggregate(numbers, [], "n", "v", UserAggregate(lambda: 0, lambda s, _: s + 1, lambda a, b: a + b, lambda s: s, "int"))) == [(4,)]


def test_comparators(numbers):
    by = compare.Comparator(((lambda c: F.coalesce(c("v"), F.lit(-1)) % 4, True), (lambda c: c("k"), False)))
    assert [r["k"] for r in by.range_of(numbers).collect()] == [3, 4, 2, 1]
    assert [r["k"] for r in by.range_of(numbers, {"v": 9, "k": 2}, {"v": 5, "k": 1}).collect()] == [2, 1]
    assert [r["k"] for r in by.range_of(numbers, {"v": 9, "k": 2}, {"v": 5, "k": 1}, low_inclusive=False).collect()] == [1]
    assert values(by.get(numbers, {"v": 1, "k": 4}).select("k")) == [(4,)]
    kept = compare.host_filter(numbers, lambda r: r["g"] == "b")
    assert values(kept.select("k")) == [(1,), (4,)] and values(compare.survivors(numbers, kept)) == [(2, 2)]


def test_listeners(spark, numbers, tmp_path):
    numbers.write.parquet(f"{tmp_path}/n")
    heard = []

    class Ear(listener.Listener):
        def compiled(self, cls, query):
            heard.append(("compiled", cls))

        def sequential_scan(self, cls, query):
            heard.append(("scan", query))

        def sorted(self, cls, query):
            heard.append(("sorted", query))

        def failed(self, query, error):
            heard.append(("failed", type(error).__name__))

        def committed(self, path):
            heard.append(("committed", path))

    catalog = Catalog(ClassDef("n", spark.read.parquet(f"{tmp_path}/n"), "k"))
    catalog.listeners += [Ear(), profile := listener.QueryProfile()]
    assert len(listener.run(catalog, "n", "k = 2")) == 1
    listener.run(catalog, "n", "k * k = 4 order by v")
    with pytest.raises(CompileError):
        listener.run(catalog, "n", "nothing = 2")
    assert heard == [("compiled", "n"), ("compiled", "n"), ("scan", "k * k = 4 order by v"), ("sorted", "k * k = 4 order by v"), ("failed", "CompileError")]
    assert values(profile.report(spark).select("query", "runs", "rows")) == [("k * k = 4 order by v", 1, 1), ("k = 2", 1, 1)]
    where = files.commit(numbers, f"{tmp_path}/store", catalog.listeners)
    assert heard[-1] == ("committed", where)
    files.commit(numbers.where("k = 1"), f"{tmp_path}/store")
    assert files.latest(spark, f"{tmp_path}/store").count() == 1
    assert files.rollback(spark, f"{tmp_path}/store").endswith(where.rpartition("/")[2]) and files.latest(spark, f"{tmp_path}/store").count() == 4
    assert files.rollback(spark, f"{tmp_path}/store") is None


def test_resolver_and_lists(spark):
    pets = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, owner int")
    people = spark.createDataFrame([(10, 7), (11, 8)], "id int, now int")
    now = spark.createDataFrame([(7, "Ann"), (8, "Bo")], "id int, name string")
    catalog = Catalog(ClassDef("pet", pets, "id", {"who": ("owner", "person")}), ClassDef("person", people, "id"), ClassDef("now", now, "id"))
    catalog.resolvers["person"] = ("now", "now")
    assert values(select(catalog, "pet", "who.name = 'Bo'").select("id")) == [(2,)]
    many = list(range(2, 5000))
    assert values(select(catalog, "pet", "id in ?", many).select("id")) == [(2,), (3,)]
    assert values(select(catalog, "pet", "not id in ?", many).select("id")) == [(1,)]
    assert values(select(catalog, "pet", "not owner in ?", many).select("id")) == []


def test_longest_prefix_of_nulls(spark):
    table = spark.createDataFrame([("7", "a"), (None, "b")], "p string, name string")
    keys = spark.createDataFrame([("71",), (None,)], "k string")
    assert values(lookup.longest_prefix(keys, "k", table, "p", "name").select("name").fillna("-")) == [("-",), ("a",)]


def test_bitmaps(spark):
    a, b = (lookup.bitmap(spark.createDataFrame([(i,) for i in ids], "i long"), "i") for ids in ([-3, 0, 1, 5, 32768, 32769, 100_000], [0, 5, 6, 32769]))
    assert values(lookup.bitmap_ids(a, "i")) == [(-3,), (0,), (1,), (5,), (32768,), (32769,), (100_000,)]
    assert values(lookup.bitmap_ids(lookup.bitmap_intersection(a, b), "i")) == [(0,), (5,), (32769,)]
    assert values(lookup.bitmap_ids(lookup.bitmap_difference(a, b), "i")) == [(-3,), (1,), (6,), (32768,), (100_000,)]
    assert values(lookup.bitmap_contains(b, spark.createDataFrame([(i,) for i in (0, 1, 5, 7, 32769)], "i long"), "i")) == [(0,), (5,), (32769,)]


def test_histories_with_maps(spark):
    df = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"x": 2})], "id string, tx int, m map<string,int>")
    assert versions.History(df, "id", ["tx"], "tx").current().first()["m"] == {"x": 2}
    assert [r["version"] for r in versions.History(df, "id", ["tx"], "tx").numbered().orderBy("tx").collect()] == [1, 2]
    assert values(versions.singletons(df, "id")) == [("a", 2)] and values(versions.singletons(df, "tx")) == []


def test_version_graphs(spark):
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 1)], "c int, p int")
    assert values(versions.ancestors(cycle, "c", "p")) == sorted((c, (c + k - 1) % 3 + 1, k) for c in (1, 2, 3) for k in (1, 2, 3))
    first = spark.createDataFrame([("o", "1.1")], "object string, id string")
    graph = versions.VersionGraph(first.withColumns({"date": F.lit(1), "labels": F.array().cast("array<string>")}), spark.createDataFrame([], "id string, predecessor string"), first)
    root = graph.check_out(first)
    graph = graph.check_in(root, 2).label("1.2", "good")
    branch = graph.check_in(root, 3)
    assert values(graph.current) == [("o", "1.2")] and values(branch.current) == [("o", "1.1.1.1")]
    assert values(branch.successors(first)) == [("1.1", "1.1.1.1"), ("1.1", "1.2")] and values(branch.predecessors(branch.current)) == [("1.1.1.1", "1.1")]
    assert values(branch.by_label("good")) == [("o", "1.2")] and values(branch.roots()) == [("o", "1.1")] and branch.by_id("1.2").count() == 1
    merged = branch.check_in(branch.versions.where("id <> '1.1'").select("object", F.col("id").alias("predecessor")), 4)
    assert merged.edges.count() == 4 and merged.current.count() == 1


def plain_nearness(found, lengths):
    """The definition, step by step: pointers into each word's places, the least of them moved on."""
    if not all(found):
        return 0.0
    at, best = [0] * len(found), 0.0
    while any(i < len(p) for i, p in zip(at, found)):
        total, last, first = 0.0, None, None
        for w, p in enumerate(found):
            if at[w] < len(p):
                if last is not None:
                    step = p[at[w]] - found[last][at[last]]
                    step = (-step - lengths[w]) * 10 if step < 0 else step - lengths[last]
                    total += 1 / math.sqrt(step if step > 2 else 1)
                if first is None or p[at[w]] < found[first][at[first]]:
                    first = w
                last = w
        at[first] += 1
        best = max(best, total)
    return best


def test_nearness(spark):
    rng = random.Random(3)
    rows = [[sorted(rng.sample(range(0, 400, 7), rng.randint(0, 6))) for _ in range(3)] for _ in range(80)]
    lengths = [3, 5, 2]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<int>, b array<int>, c array<int>")
    got = [r[0] for r in df.orderBy("i").select(fulltext.near([F.col("a"), F.col("b"), F.col("c")], lengths)).collect()]
    assert got == pytest.approx([plain_nearness(r, lengths) for r in rows])


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "brown quick dogs, and a fox"), (3, None), (4, "quick, BROWN bear; quickest foxes")], "d int, t string")
    index = fulltext.StoredIndex(spark, f"{tmp_path}/index")
    index.add(docs.where("d < 3"), "d", "t")
    index.add(docs.where("d >= 3"), "d", "t")
    scan = fulltext.Index(docs, "d", "t")
    for q in ("quick", "quick NOT fox", "fox OR bear", '"quick brown"', "NOT quick", "(fox bear) OR dogs", "the", "quick brown"):
        assert values(index.match(q)) == values(scan.match(fulltext.parse(q)))
        assert [(r["doc"], round(r["rank"], 9)) for r in index.search(q).collect()] == [(r["doc"], round(r["rank"], 9)) for r in scan.search(q).collect()]
    assert values(index.keywords("qu")) == values(scan.keywords("qu"))
    index.remove(docs.where("d = 2"), "d")
    assert values(index.match("quick")) == [(1,), (4,)] and index.documents.count() == 3
    small = index.compact()
    assert values(small.match("fox")) == [(1,)]
    index.add(docs.where("d = 2"), "d", "t")
    assert values(index.match("fox")) == [(1,), (2,)]
    plan = index.postings(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(word,fox)" in plan and "PartitionFilters" in plan
    stems = fulltext.StoredIndex(spark, f"{tmp_path}/stems", lambda w: w.removesuffix("es"))
    stems.add(docs, "d", "t")
    assert values(stems.match("foxes")) == values(fulltext.Index(docs, "d", "t", lambda w: w.removesuffix("es")).match(fulltext.parse("fox"))) == [(1,), (2,), (4,)]
    assert values(fulltext.merge(scan.search("fox"), scan.search("quick")).select("doc")) == [(1,), (2,)]
    best = fulltext.optimized(fulltext.parse("quick AND fox AND bear"), {"quick": 3, "fox": 2, "bear": 1})
    assert values(index.documents.sparkSession.createDataFrame([(t.word,) for t in fulltext._matches(best)], "w string"))[0] == ("bear",) and fulltext._matches(best)[0].word in ("fox", "bear")


def test_assoc_text_and_order(spark):
    rows = [("p:1", "name", 0, "John Brown", None, None), ("p:2", "name", 0, "Ann Brown", None, None), ("p:2", "age", 0, None, 7.0, None), ("p:1", "note", 0, "likes dogs", None, None)]
    e = spark.createDataFrame(rows, assoc.SCHEMA)
    assert values(assoc.match(e, ["name", "note"], "brown dogs")) == [("p:1",)] and values(assoc.match(e, ["name"], "dogs")) == []
    items = e.select("item").distinct()
    assert [r["item"] for r in assoc.order_by(e, items, [("name", True)]).collect()] == ["p:2", "p:1"]
    assert [r["item"] for r in assoc.order_by(e, items, [("age", False), ("name", True)]).collect()] == ["p:2", "p:1"]
    more = assoc.link(e, spark.createDataFrame([("p:1", "name", "Jack", None, None)], "item string, attr string, text string, number double, ref string"))
    assert assoc.attribute_map(more).where("item = 'p:1'").first()["attributes"]["name"] == ["John Brown", "Jack"]
    assert assoc.full_text(e, ["name", "note"]).where("item = 'p:1'").first()["text"] == "John Brown likes dogs"


def test_find_documents(spark):
    found = rdf.find_document('<f xmlns:v="http://x#"><v:book v:about="b/*" before="2020-01-01" title="A*" pages="[1, 20)"><by><name>Knuth*</name></by></v:book><thing depth="2" all="true"/></f>')
    assert found[0] == rdf.Find("book", "b/*", {"title": "A*", "pages": (1.0, 20.0, True, False), "by": {"name": "Knuth*"}}, rdf.LATEST_BEFORE, datetime(2020, 1, 1), 0)
    assert found[1] == rdf.Find(None, None, {}, rdf.ALL, None, 2)
    types = spark.createDataFrame([("b'c", "a"), ("d", "b'c"), ("a", "d"), ("e", "z")], "type string, parent string")
    assert values(rdf.subtypes(types, "b'c")) == [("a",), ("b'c",), ("d",)]


def test_reachable_goes_on(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 3), (None, 7)], "src int, dst int")
    assert C.reachable(edges, spark.createDataFrame([(1,), (None,)], "id int")).count() == 40


def test_scratch(spark, numbers):
    made = scratch.materialize(numbers, "test")
    assert values(made.select("k")) == values(numbers.select("k"))
    scratch.discard(made)
    with pytest.raises(Exception):
        made.count()

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())


def test_more_files(spark, numbers, tmp_path):
    files.save(numbers, f"{tmp_path}/a.parquet", "snappy")
    files.recompress(spark, f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet", "gzip")
    assert values(spark.read.parquet(f"{tmp_path}/b.parquet").select("k")) == values(numbers.select("k")) and list((tmp_path / "b.parquet").glob("*.gz.parquet"))
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    files.backup({"n": numbers}, f"{tmp_path}/plain")
    assert spark.read.parquet(f"{tmp_path}/plain/n.parquet").count() == 4
    files.backup({"n": numbers}, f"{tmp_path}/sealed", key)
    assert values(files.restore(spark, f"{tmp_path}/sealed", "n", "k int, v int, g string", key).fillna("-").fillna(-1)) == values(numbers.fillna("-").fillna(-1))
    assert files.restore(spark, f"{tmp_path}/sealed", "n", "k int, v int, g string", other).where("k is not null").count() == 0
    (tmp_path / "s.txt").write_text("# c\n1|x\n2|y\n")
    assert values(files.separated(spark, f"{tmp_path}/s.txt", "k int, t string")) == [(1, "x"), (2, "y")]


def test_mirror(spark, numbers, tmp_path):
    numbers.write.parquet(f"{tmp_path}/in")
    stream = streams.read(spark, f"{tmp_path}/in", numbers.schema)
    for _ in range(2):  # a second run finds nothing new
        streams.mirror(stream, lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/marks").awaitTermination()
    assert values(spark.read.parquet(f"{tmp_path}/out").select("k")) == values(numbers.select("k"))


def test_windows_of_plain_times(spark, tmp_path):
    """Times without a zone fall into the same windows in a stream and in a table, where the session's clocks change too."""
    df = spark.createDataFrame([(m,) for m in range(0, 240, 10)], "m int").select(F.expr("timestampadd(MINUTE, m, TIMESTAMP_NTZ'2024-03-31 00:00:00')").alias("ts"))
    df.write.parquet(f"{tmp_path}/t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        stream = streams.tumbling(streams.read(spark, f"{tmp_path}/t", df.schema), "ts", "1 hour", [], A.count().alias("n"))
        got = values(streams.drain(stream, "plain_times", "complete").select(F.col("window_start").cast("string"), "n"))
        assert got == values(streams.tumbling(df, "ts", "1 hour", [], A.count().alias("n")).select(F.col("window_start").cast("string"), "n")) == [(f"2024-03-31 0{h}:00:00", 6) for h in range(4)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
