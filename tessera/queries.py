"""The registered queries over the engine's own operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import aggregates as A
from tessera.functions import scalar
from tessera.functions.user import UserAggregate, user_aggregate
from tessera.operators import assoc, compare, fulltext, lookup, rdf, spatial, timeseries
from tessera.operators import collections as C
from tessera.operators.versions import History, VersionGraph
from tessera.plans import builder as B
from tessera.plans import listener
from tessera.plans.compile import select, select_from, value_of
from tessera.sources.catalog import TABLES, Catalog, ClassDef, load
from tessera.sources.scratch import shared_dir
from tessera.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def predicate(name: str, cls: str, text: str, columns: list[str], where: str, *params, joins: str = "", **more) -> None:
    """A query by predicate, with SQL for the same condition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(load(spark, sf_dir), cls, text, *params, **more).select(*columns)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {', '.join(f't.{c}' for c in columns)} FROM {cls} t {joins} WHERE {where}"


def expressions(name: str, cls: str, columns: dict[str, str], sql: dict[str, str], key: str) -> None:
    """A projection of expressions of the predicate language, with SQL for each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = load(spark, sf_dir)
        df = catalog.extent(cls)
        return df.select(key, *[value_of(catalog, cls, e)[1].alias(n) for n, e in columns.items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {cls}"


# predicates

L = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
TO_REGION = "JOIN orders o ON t.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"
predicate("jsql_path_join", "lineitem", "l_quantity > 45 and ord.customer.nation.region.r_name = 'ASIA' order by l_extendedprice desc", L, "t.l_quantity > 45 AND r.r_name = 'ASIA'", joins=TO_REGION)
predicate("jsql_compare", "part", "p_size >= 10 and p_size < 40 and p_retailprice <> 1000.0 and p_type != 'X' and p_size <= 35 and p_retailprice > 900", ["p_partkey", "p_size"], "p_size >= 10 AND p_size < 40 AND p_retailprice <> 1000 AND p_type <> 'X' AND p_size <= 35 AND p_retailprice > 900")
predicate("jsql_between", "part", "p_size between 10 and 20 and p_name between 'a' and 'm'", ["p_partkey", "p_name", "p_size"], "p_size BETWEEN 10 AND 20 AND p_name BETWEEN 'a' AND 'm'")
predicate("jsql_like", "part", "p_name like '%e%' and not p_type like '_A%'", ["p_partkey", "p_name"], "p_name LIKE '%e%' AND NOT p_type LIKE '_A%'")
predicate("jsql_like_escape", "customer", "c_name like 'Customer|_%1' escape '|' or c_name like '%#00000%' escape '!'", ["c_custkey", "c_name"], "c_name LIKE 'Customer|_%1' ESCAPE '|' OR c_name LIKE '%#00000%' ESCAPE '!'")
predicate("jsql_in", "part", "p_size in (1, 2, 3, ?) and p_type in ('ECONOMY', 'PROMO', 'SMALL')", ["p_partkey", "p_size", "p_type"], "p_size IN (1, 2, 3, 7) AND p_type IN ('ECONOMY', 'PROMO', 'SMALL')", 7)
predicate("jsql_in_collection", "orders", "o_orderpriority in ?", ["o_orderkey"], "o_orderpriority IN ('1-URGENT', '2-HIGH')", ["1-URGENT", "2-HIGH"])
predicate("jsql_ci_eq", "customer", "c_mktsegment = 'building' or c_mktsegment like 'AUTO%' or c_mktsegment between 'M' and 'MZ'", ["c_custkey", "c_mktsegment"], "lower(c_mktsegment) = 'building' OR lower(c_mktsegment) LIKE 'auto%' OR lower(c_mktsegment) BETWEEN 'm' AND 'mz'")
predicate("jsql_substr_in", "part", "'ar' in p_name", ["p_partkey", "p_name"], "contains(p_name, 'ar')")
predicate("jsql_param", "orders", "o_totalprice > ? and o_orderstatus = ?", ["o_orderkey", "o_totalprice"], "o_totalprice > 1000 AND o_orderstatus = 'F'", 1000, "F")
predicate("jsql_isnull_nav", "lineitem", "supplier.nation.n_name is null or ord.o_orderstatus is not null and l_linenumber = 1", L, "n.n_name IS NULL OR (o.o_orderstatus IS NOT NULL AND t.l_linenumber = 1)", joins="LEFT JOIN supplier s ON t.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN orders o ON t.l_orderkey = o.o_orderkey")
predicate("jsql_bool_logic", "lineitem", "(l_linenumber and 1) = 0 and not (l_quantity < 10 or l_quantity > 40) or (l_linenumber or 4) = 7", L, "((l_linenumber & 1) = 0 AND NOT (l_quantity < 10 OR l_quantity > 40)) OR (l_linenumber | 4) = 7")
predicate("jsql_date", "orders", "o_orderdate between '1996-01-01' and 'Dec 31, 1996 11:59:59 PM'", ["o_orderkey", "o_orderdate"], "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59'")
predicate("jsql_literals", "region", "true and not false and r_name <> 'it''s' and r_regionkey < 1e1", ["r_regionkey", "r_name"], "r_name <> 'it''s' AND r_regionkey < 10")
predicate("jsql_current", "region", "current is not null and current <> null", ["r_regionkey"], "TRUE")
predicate("jsql_div_zero", "part", "p_size / (p_size - p_size) = 1 or p_size = 5", ["p_partkey"], "p_size = 5")
predicate("contains_with", "orders", "contains items with l_quantity > 49 and l_returnflag = 'R'", ["o_orderkey", "o_totalprice"], "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = t.o_orderkey AND l_quantity > 49 AND l_returnflag = 'R')")
predicate("contains_outer", "orders", "contains items with l_extendedprice > o_totalprice", ["o_orderkey"], "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = t.o_orderkey AND l.l_extendedprice > t.o_totalprice)")
predicate("contains_not", "customer", "not contains orders with o_orderstatus = 'F' and c_acctbal > 0", ["c_custkey"], "NOT (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = t.c_custkey AND o_orderstatus = 'F' AND t.c_acctbal > 0))")
predicate("contains_group_having", "orders", "contains items with l_quantity > 5 group by l_returnflag having count(*) >= 2 and avg l_linenumber > 2 and max l_quantity < 45 and sum l_quantity > 10 and min l_tax >= 0", ["o_orderkey"], "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = t.o_orderkey AND l_quantity > 5 GROUP BY l_returnflag HAVING count(*) >= 2 AND sum(l_linenumber) // count(*) > 2 AND max(l_quantity) < 45 AND sum(l_quantity) > 10 AND min(l_tax) >= 0)")
predicate("jsql_order_by", "customer", "order by c_mktsegment, c_acctbal desc", ["c_custkey", "c_mktsegment", "c_acctbal"], "TRUE")
predicate("jsql_lenient", "orders", "o_totalprice / 0 > 1 and o_orderstatus = 'F'", ["o_orderkey"], "o_orderstatus = 'F' AND o_totalprice > 0", null_mode="lenient")

predicate("jsql_in_large", "orders", "o_orderkey in ? and o_totalprice > 0", ["o_orderkey"], "o_orderkey % 3 = 0 AND o_orderkey < 9000 AND o_totalprice > 0", [*range(0, 9000, 3), None])
predicate("contains_nested", "orders", "o_orderstatus = 'P' and contains customer.orders with o_orderstatus = 'F' and o_totalprice > 400", ["o_orderkey"], "o_orderstatus = 'P' AND EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = t.o_custkey AND x.o_orderstatus = 'F' AND x.o_totalprice > 400)")


@add("jsql_boolean", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT c_mktsegment = 'BUILDING'")
def jsql_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean fields as conditions."""
    c = table(spark, sf_dir, "customer").withColumns({"solvent": F.col("c_acctbal") > 0, "builds": F.col("c_mktsegment") == "BUILDING"})
    return select_from(c, "solvent and not builds").select("c_custkey")


@add("nav_resolver", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 100")
def nav_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation that finds a region in the place of each nation."""
    catalog = load(spark, sf_dir)
    catalog.resolvers["nation"] = ("n_regionkey", "region")
    return select(catalog, "customer", "nation.r_name = 'ASIA' and c_acctbal > 100").select("c_custkey")


@add("query_profile", "SELECT 'p_size > 10' AS query, 2 AS runs, count(*) AS rows, true AS timed FROM part WHERE p_size > 10 UNION ALL SELECT 'p_size = ?', 1, count(*), true FROM part WHERE p_size = 7")
def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, profile = load(spark, sf_dir), listener.QueryProfile()
    catalog.listeners.append(profile)
    for text, params in (("p_size > 10", []), ("p_size = ?", [7]), ("p_size > 10", [])):
        listener.run(catalog, "part", text, *params)
    return profile.report(spark).select("query", "runs", "rows", ((F.col("total") >= F.col("longest")) & (F.col("longest") > 0)).alias("timed"))


expressions(
    "scalar_math", "part",
    {"add": "p_size + 3 * 2 - 1", "div": "(p_size - 25) / 4", "pow": "p_size ^ 2", "neg": "-p_size", "abs": "abs(p_size - 25)", "bits": "(p_size and 6) or 1", "inv": "not p_size", "rdiv": "p_retailprice / (p_size - 5)", "sin": "sin p_size", "cos": "cos p_size", "tan": "tan(p_size / 100.0)", "asin": "asin(p_size / 50.0)", "acos": "acos(p_size / 50.0)", "atan": "atan p_size", "sqrt": "sqrt p_size", "exp": "exp(p_size / 10.0)", "log": "log(p_size - 1)", "ceal": "ceal(p_retailprice / 7)", "floor": "floor(p_retailprice / 7)", "rpow": "p_retailprice ^ 0.5"},
    {"add": "CAST(p_size + 3 * 2 - 1 AS BIGINT)", "div": "CAST((p_size - 25) // 4 AS BIGINT)", "pow": "CAST(p_size ^ 2 AS BIGINT)", "neg": "CAST(-p_size AS BIGINT)", "abs": "CAST(abs(p_size - 25) AS BIGINT)", "bits": "CAST((p_size & 6) | 1 AS BIGINT)", "inv": "CAST(~p_size AS BIGINT)", "rdiv": "p_retailprice / CAST(p_size - 5 AS DOUBLE)", "sin": "sin(p_size)", "cos": "cos(p_size)", "tan": "tan(p_size / 100.0)", "asin": "asin(p_size / 50.0)", "acos": "acos(p_size / 50.0)", "atan": "atan(p_size)", "sqrt": "sqrt(p_size)", "exp": "exp(p_size / 10.0)", "log": "CASE WHEN p_size = 1 THEN '-inf'::DOUBLE ELSE ln(p_size - 1) END", "ceal": "ceil(p_retailprice / 7)", "floor": "floor(p_retailprice / 7)", "rpow": "p_retailprice ^ 0.5"},
    "p_partkey",
)
expressions(
    "scalar_string", "part",
    {"cat": "p_name + '-' || p_type", "low": "lower p_name", "up": "upper p_name", "len": "length p_name", "code": "p_name[1]", "beyond": "p_name[1000]", "text": "string(p_size)"},
    {"cat": "p_name || '-' || p_type", "low": "lower(p_name)", "up": "upper(p_name)", "len": "CAST(length(p_name) AS BIGINT)", "code": "CAST(unicode(substr(p_name, 2, 1)) AS BIGINT)", "beyond": "CAST(NULL AS BIGINT)", "text": "CAST(p_size AS VARCHAR)"},
    "p_partkey",
)
expressions("scalar_cast", "part", {"whole": "integer(p_retailprice / 3)", "negative": "integer(-p_retailprice)", "real_size": "real(p_size)", "mixed": "p_size + 0.5"}, {"whole": "CAST(trunc(p_retailprice / 3) AS BIGINT)", "negative": "CAST(trunc(-p_retailprice) AS BIGINT)", "real_size": "CAST(p_size AS DOUBLE)", "mixed": "CAST(p_size AS DOUBLE) + 0.5"}, "p_partkey")


@add(
    "scalar_decimal",
    "SELECT p_partkey, round(p, 1)::DECIMAL(12,1) AS r1, (p + 1.25::DECIMAL(12,2))::DECIMAL(14,2) AS plus, (p - 1000.5::DECIMAL(12,2))::DECIMAL(14,2) AS minus, abs(p - 1000.5::DECIMAL(12,2))::DECIMAL(14,2) AS away, (-p)::DECIMAL(12,2) AS neg, (p * p_size)::DECIMAL(18,2) AS times, floor(p)::BIGINT AS fl, ceil(p)::BIGINT AS ce, lpad(p::VARCHAR, 12, '0') AS txt FROM (SELECT *, p_retailprice::DECIMAL(12,2) AS p FROM part)",
)
def scalar_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, half = scalar.decimal_scale(F.col("p_retailprice"), 10, 2), F.lit("1000.50").cast("decimal(12,2)")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        scalar.decimal_scale(p, 11, 1).alias("r1"),
        (p + F.lit("1.25").cast("decimal(12,2)")).cast("decimal(14,2)").alias("plus"),
        (p - half).cast("decimal(14,2)").alias("minus"),
        scalar.decimal_abs((p - half).cast("decimal(14,2)")).alias("away"),
        scalar.decimal_neg(p).alias("neg"),
        scalar.decimal_mul(p, F.col("p_size"), 18, 2).alias("times"),
        F.floor(p).cast("long").alias("fl"),
        F.ceil(p).cast("long").alias("ce"),
        scalar.decimal_format(p, 2, 12, "0").alias("txt"),
    )


@add("scalar_decimal_div", "SELECT p_partkey, abs(q * p_size - p_retailprice) <= 0.0001 * p_size AS near FROM (SELECT *, round(p_retailprice / nullif(p_size, 0), 4) AS q FROM part)")
def scalar_decimal_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = scalar.decimal_div(scalar.decimal_scale(F.col("p_retailprice"), 10, 2), F.col("p_size").cast("decimal(10,0)"), 18, 4)
    return table(spark, sf_dir, "part").select("p_partkey", (F.abs(q.cast("double") * F.col("p_size") - F.col("p_retailprice")) <= 0.0001 * F.col("p_size")).alias("near"))


def _vectors(spark: SparkSession, sf_dir: str, text: str, *params) -> DataFrame:
    return select_from(table(spark, sf_dir, "embeddings"), text, *params).select("vec_id")


add("array_get", "SELECT vec_id FROM embeddings WHERE embedding[1] > 0.1 AND embedding[64] < 0")(lambda s, d: _vectors(s, d, "embedding[0] > 0.1 and embedding[63] < 0 and length embedding = 64"))
add("array_beyond", "SELECT vec_id FROM embeddings WHERE label = 3")(lambda s, d: _vectors(s, d, "embedding[64] > 0 or label = 3"))
add("array_in", "SELECT vec_id FROM embeddings WHERE list_contains([1, 2, 3], label)")(lambda s, d: select_labels(s, d))
add("array_exists", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3)) > 0")(lambda s, d: _vectors(s, d, "exists i: (embedding[i] > 0.3)"))
add("array_exists_pair", "SELECT vec_id FROM embeddings WHERE len(list_filter(range(1, 64), lambda i: embedding[i] > 0.15 AND embedding[i + 1] < -0.25)) > 0")(lambda s, d: _vectors(s, d, "exists i: (embedding[i] > 0.15 and embedding[i + 1] < -0.25)"))


@add("contains_array_group", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 5 GROUP BY l_returnflag HAVING count(*) >= 2 AND max(l_quantity) < 45)")
def contains_array_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups within an embedded collection."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    catalog = Catalog(ClassDef("orders", orders, "o_orderkey"))
    return select(catalog, "orders", "contains items with l_quantity > 5 group by l_returnflag having count(*) >= 2 and max l_quantity < 45").select("o_orderkey")


def select_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").withColumn("wanted", F.array(F.lit(1), F.lit(2), F.lit(3)))
    return select_from(df, "label in wanted").select("vec_id")


@add("contains_embedded", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 40 AND l_tax > 0.05 AND l_discount * 100 < o.o_totalprice)")
def contains_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_tax", "l_discount")).alias("items"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return select_from(rows, "contains items with l_quantity > 40 and l_tax > 0.05 and l_discount * 100 < o_totalprice").select("o_orderkey")


@add("builder_query", "SELECT p_partkey FROM part WHERE (p_size BETWEEN 5 AND 15 AND p_name LIKE '%a%') OR p_size IN (40, 41) AND NOT p_retailprice * 2 < 1900")
def builder_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = B.name("p_size"), B.name("p_retailprice")
    where = (size.between(5, 15) & B.name("p_name").like("%a%")) | (size.is_in([40, 41]) & ~(price * 2 < 1900))
    return B.run(load(spark, sf_dir), "part", B.query(where, [(size, True)])).select("p_partkey")


@add("method_call", "SELECT o_orderkey FROM orders WHERE extract(year FROM o_orderdate) = 1997")
def method_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load(spark, sf_dir)
    catalog["orders"].methods["getYear"] = lambda get: F.year(get("o_orderdate"))
    return select(catalog, "orders", "year = 1997").select("o_orderkey")


@add("polymorphic_scan", "SELECT 'customer' AS _class, c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def polymorphic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.catalog import Catalog, ClassDef

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    catalog = Catalog(ClassDef("party", c.limit(0)), ClassDef("customer", c, parent="party"), ClassDef("supplier", s, parent="party"))
    found = select(catalog, "party", "balance > 5000")
    return catalog.is_instance(found, "party").select("_class", "id", "balance")


add("get_by_key", "SELECT * FROM nation WHERE n_nationkey = 7")(lambda s, d: load(s, d).get("nation", 7))
add("count_records", "SELECT count(*) AS n FROM lineitem")(lambda s, d: table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n")))


# aggregates

EVENTS = "event_type"


def grouped(name: str, tbl: str, key: str, sql: str, *aggs) -> None:
    QUERIES[name] = lambda s, d: A.aggregate(table(s, d, tbl), [key], *[a() for a in aggs])
    ORACLE_SQL[name] = f"SELECT {key}, {sql} FROM {tbl} GROUP BY {key}"


grouped("agg_count", "events", EVENTS, "count(*) AS n", lambda: A.count().alias("n"))
grouped("agg_max_min", "events", EVENTS, "max(value) AS hi, min(value) AS lo", lambda: A.maximum("value").alias("hi"), lambda: A.minimum("value").alias("lo"))
grouped("agg_sums", "lineitem", "l_returnflag", "round(sum(l_quantity), 4) AS total, CAST(sum(l_linenumber) AS BIGINT) AS lines", lambda: F.round(A.real_sum("l_quantity"), 4).alias("total"), lambda: A.integer_sum("l_linenumber").alias("lines"))
grouped("agg_avg", "lineitem", "l_returnflag", "round(avg(l_quantity), 8) AS mean", lambda: F.round(A.average("l_quantity"), 8).alias("mean"))
grouped("agg_prd", "nation", "n_regionkey", "product(n_nationkey + 1) AS prd", lambda: A.product(F.col("n_nationkey") + 1).alias("prd"))
grouped("agg_var_dev", "events", EVENTS, "round(var_pop(value), 6) AS var, round(stddev_pop(value), 6) AS dev", lambda: F.round(A.variance("value"), 6).alias("var"), lambda: F.round(A.deviation("value"), 6).alias("dev"))
grouped("agg_distinct", "events", EVENTS, "count(DISTINCT nullif(user_id, 3)) + max(CASE WHEN nullif(user_id, 3) IS NULL THEN 1 ELSE 0 END) AS users", lambda: A.distinct_count(F.nullif("user_id", F.lit(3))).alias("users"))
grouped("agg_first_last", "events", EVENTS, "arg_min(user_id, ts) AS first_user, arg_max(user_id, ts) AS last_user", lambda: A.first("user_id", "ts").alias("first_user"), lambda: A.last("user_id", "ts").alias("last_user"))
grouped("agg_compound", "orders", "o_orderstatus", "count(*) AS n, max(o_totalprice) AS hi, min(o_orderdate) AS since, count(DISTINCT o_custkey) AS customers", lambda: A.count().alias("n"), lambda: A.maximum("o_totalprice").alias("hi"), lambda: A.minimum("o_orderdate").alias("since"), lambda: A.distinct_count("o_custkey").alias("customers"))
add("agg_topn", "SELECT o_orderstatus, max(o_totalprice, 3) AS best FROM orders GROUP BY o_orderstatus")(lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(A.top("o_totalprice", 3).alias("best")))
add("agg_top_rows", "SELECT o_orderstatus, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 5")(lambda s, d: A.top_rows(table(s, d, "orders"), ["o_orderstatus"], "o_totalprice", 5, ["o_orderkey"]).select("o_orderstatus", "o_orderkey", "rank"))
add("agg_repeat", "SELECT event_type, count(*) FILTER (WHERE n >= 12) AS repeats FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")(lambda s, d: A.repeat_count(table(s, d, "events"), ["event_type"], "user_id", 12))
CLOSE = "SELECT event_type, true AS close FROM events GROUP BY event_type"  # estimates within a twentieth of the exact counts


def _close(estimates: DataFrame, events: DataFrame) -> DataFrame:
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return estimates.join(exact, "event_type").select("event_type", (F.abs(F.col("users") - F.col("n")) <= 0.05 * F.col("n") + 1).alias("close"))


@add("agg_approx_distinct", CLOSE)
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return _close(e.groupBy("event_type").agg(A.approx_distinct("user_id").alias("users")), e)


@add("agg_hll_merge", CLOSE)
def agg_hll_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of days, merged."""
    e = table(spark, sf_dir, "events")
    days = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(A.hll_state("user_id").alias("state"))
    return _close(days.groupBy("event_type").agg(A.hll_merge("state").alias("users")), e)


@add("agg_user", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY event_type")
def agg_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of the user's own: the root of the mean square."""
    rms = UserAggregate(lambda: (0, 0.0), lambda s, v: s if v is None else (s[0] + 1, s[1] + v * v), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: (s[1] / s[0]) ** 0.5 if s[0] else None)
    return user_aggregate(table(spark, sf_dir, "events"), ["event_type"], "rms", "value", rms).withColumn("rms", F.round("rms", 6))


@add("agg_merge_partials", "SELECT event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY event_type")
def agg_merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    odd = F.dayofmonth("ts") % 2
    parts = [e.where(odd == i).groupBy("event_type").agg(A.count().alias("n"), A.maximum("value").alias("hi")) for i in (0, 1)]
    return A.merge(parts, ["event_type"], n="sum", hi="max")


add("agg_ordered", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")(lambda s, d: A.aggregate(table(s, d, "nation"), ["n_regionkey"], A.count().alias("n"), ordered=True))
add("memory_profile")(lambda s, d: A.memory_profile({n: table(s, d, n) for n in TABLES}))


# lookups

add("idx_get", "SELECT * FROM part WHERE p_partkey = 17")(lambda s, d: lookup.get(table(s, d, "part"), "p_partkey", 17))
add("idx_range", "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 20")(lambda s, d: lookup.range_of(table(s, d, "part"), "p_size", 10, 20, low_inclusive=False, descending=True).select("p_partkey", "p_size"))
add("idx_prefix", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b')")(lambda s, d: lookup.prefix(table(s, d, "part"), "p_name", "b").select("p_partkey", "p_name"))
add("idx_prefix_ci", "SELECT c_custkey FROM customer WHERE starts_with(lower(c_mktsegment), 'bu')")(lambda s, d: lookup.prefix(table(s, d, "customer"), "c_mktsegment", "BU", ci=True).select("c_custkey"))
add("idx_prefix_of", "SELECT n_nationkey, n_name FROM nation WHERE starts_with('NATION_12x', n_name)")(lambda s, d: lookup.prefixes_of(table(s, d, "nation"), "n_name", "NATION_12x").select("n_nationkey", "n_name"))
add("idx_compound", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey > 10 OR (l_orderkey = 10 AND l_linenumber >= 3)) AND (l_orderkey < 40 OR (l_orderkey = 40 AND l_linenumber < 2))")(lambda s, d: lookup.compound_range(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], (10, 3), (40, 2), high_inclusive=False).select("l_orderkey", "l_linenumber", "l_partkey"))
add("idx_example", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size = 7")(lambda s, d: lookup.by_example(table(s, d, "part"), p_type="PROMO", p_size=7, p_brand=None).select("p_partkey"))
add("idx_regex", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A_E%'")(lambda s, d: lookup.match(table(s, d, "part"), "p_name", "%A_E%", ci=True).select("p_partkey", "p_name"))
add("idx_md_range", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice >= 950")(lambda s, d: lookup.box(table(s, d, "part"), {"p_size": (10, 30), "p_retailprice": (950, None), "p_name": (None, None)}).select("p_partkey"))
add("idx_bit", "SELECT event_id FROM events WHERE (event_id & 5) = 5 AND (event_id & 8) = 0")(lambda s, d: lookup.bits(table(s, d, "events"), "event_id", 5, 8).select("event_id"))
add("idx_kth", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 100")(lambda s, d: lookup.kth(table(s, d, "orders"), ["o_totalprice", "o_orderkey"], 100).select("o_orderkey"))
add("idx_rank", "SELECT count(*) FILTER (WHERE o_totalprice < 5000) AS position FROM orders")(lambda s, d: lookup.rank_of(table(s, d, "orders"), "o_totalprice", 5000.0))
add("idx_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 50")(lambda s, d: lookup.page(table(s, d, "orders"), ["o_totalprice", "o_orderkey"], 50, 10).select("o_orderkey"))
add("idx_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders")(lambda s, d: lookup.positions(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 8).select("o_orderkey", "position"))


def _clicks(s: SparkSession, d: str) -> list[DataFrame]:
    """Bitmaps of the users who viewed on even days and clicked on the others."""
    e = table(s, d, "events")
    even = F.dayofmonth("ts") % 2 == 0
    return [lookup.bitmap(e.where((F.col("event_type") == t) & (even if t == "view" else ~even)), "user_id") for t in ("view", "click")]


BITS = "(SELECT user_id FROM events WHERE event_type = 'view' AND day(ts) % 2 = 0) {} (SELECT user_id FROM events WHERE event_type = 'click' AND day(ts) % 2 = 1)"
add("bitmap_or_count", f"SELECT count(*) AS n FROM ({BITS.format('UNION')})")(lambda s, d: lookup.bitmap_count(lookup.bitmap_union(*_clicks(s, d))))
add("bitmap_and", BITS.format("INTERSECT"))(lambda s, d: lookup.bitmap_ids(lookup.bitmap_intersection(*_clicks(s, d)), "user_id"))
add("bitmap_xor", f"({BITS.format('EXCEPT')}) UNION (SELECT user_id FROM events WHERE event_type = 'click' AND day(ts) % 2 = 1 EXCEPT SELECT user_id FROM events WHERE event_type = 'view' AND day(ts) % 2 = 0)")(lambda s, d: lookup.bitmap_ids(lookup.bitmap_difference(*_clicks(s, d)), "user_id"))
add("bitmap_contains", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'view' AND day(ts) % 2 = 0)")(lambda s, d: lookup.bitmap_contains(_clicks(s, d)[0], table(s, d, "customer").select("c_custkey"), "c_custkey"))

BY_LENGTH = compare.Comparator(((lambda c: F.char_length(c("p_name")), True), (lambda c: F.lower(c("p_name")), False)))
add("cmp_range", "SELECT p_partkey, p_name FROM part WHERE (length(p_name) = 10 AND lower(p_name) <= 'mmmmmmmmmm') OR length(p_name) BETWEEN 11 AND 13 OR (length(p_name) = 14 AND lower(p_name) > 'mmmmmmmmmmmmmm')")(lambda s, d: BY_LENGTH.range_of(table(s, d, "part"), {"p_name": "m" * 10}, {"p_name": "m" * 14}, high_inclusive=False).select("p_partkey", "p_name"))
add("cmp_get", "SELECT p_partkey FROM part WHERE length(p_name) = 12")(lambda s, d: compare.Comparator(BY_LENGTH.keys[:1]).get(table(s, d, "part"), {"p_name": "x" * 12}).select("p_partkey"))
add("cmp_multidimensional", "SELECT p_partkey FROM part WHERE length(p_name) BETWEEN 8 AND 12 AND p_size % 10 >= 5")(lambda s, d: compare.within(table(s, d, "part"), {"length": lambda c: F.char_length(c("p_name")), "digit": lambda c: c("p_size") % 10}, {"length": 8, "digit": 5}, {"length": 12}).select("p_partkey"))
DIGITS = "list_sum(list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda x: CAST(x AS INT))) = 10"
add("host_filter", f"SELECT p_partkey, p_name FROM part WHERE {DIGITS}")(lambda s, d: _digits(table(s, d, "part").select("p_partkey", "p_name")))
add("host_filter_survivors", f"SELECT count(*) FILTER (WHERE {DIGITS}) AS n, count(*) FILTER (WHERE NOT {DIGITS}) AS dropped FROM part")(lambda s, d: compare.survivors(table(s, d, "part"), _digits(table(s, d, "part"))))


def _digits(df: DataFrame) -> DataFrame:
    return compare.host_filter(df, lambda r: sum(map(int, str(r["p_partkey"]))) == 10)


def _ids(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).where("k < 20"), table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).where("k > 5")


SETS = "SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 20 {} SELECT s_nationkey FROM supplier WHERE s_nationkey > 5"
add("set_intersect", SETS.format("INTERSECT"))(lambda s, d: lookup.intersection(*_ids(s, d)))
add("set_union", SETS.format("UNION"))(lambda s, d: lookup.union(*_ids(s, d)))
add("set_except", SETS.format("EXCEPT"))(lambda s, d: lookup.difference(*_ids(s, d)))
add("set_xor", "(" + SETS.format("EXCEPT") + ") UNION (SELECT s_nationkey FROM supplier WHERE s_nationkey > 5 EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 20)")(lambda s, d: lookup.symmetric_difference(*_ids(s, d)))
add("set_bag_union", SETS.format("UNION ALL"))(lambda s, d: lookup.bag_union(*_ids(s, d)))
add("set_bag_except", SETS.format("EXCEPT ALL"))(lambda s, d: lookup.bag_difference(*_ids(s, d)))
add("proj_distinct", "SELECT DISTINCT nullif(o_orderpriority, '5-LOW') AS p FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL")(lambda s, d: lookup.projection(table(s, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")), "p"))
add("proj_join", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")(lambda s, d: lookup.intersection(*[lookup.projection(table(s, d, "orders").where(F.col("o_orderstatus") == x), "o_custkey") for x in "FP"]))
add("join_junction", "SELECT s_name, p_name, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_acctbal > 5000 AND p_size < 3")(lambda s, d: table(s, d, "lineitem").join(table(s, d, "supplier").where("s_acctbal > 5000"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "part").where("p_size < 3"), F.col("l_partkey") == F.col("p_partkey")).select("s_name", "p_name", "l_quantity"))


@add("patricia_best_match", "WITH p AS (SELECT DISTINCT substr(p_name, 1, n) AS prefix, n FROM part, (VALUES (1), (2), (3), (5)) v(n)) SELECT p_name, arg_max(prefix, length(prefix)) AS matched, max(n)::INT AS value FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN p ON starts_with(p_name, prefix) GROUP BY p_name")
def patricia_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return lookup.longest_prefix(part.select("p_name"), "p_name", _prefixes(part), "prefix", "value")


def _prefixes(part: DataFrame) -> DataFrame:
    """The first 1, 2, 3 and 5 characters of all names, with their number."""
    given = part.select(F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("n"), "p_name")
    return given.select(F.expr("substring(p_name, 1, n)").alias("prefix"), F.col("n").alias("value")).distinct()


@add("patricia_edit", "WITH p AS (SELECT DISTINCT substr(p_name, 1, n) AS prefix, n FROM part, (VALUES (1), (2), (3), (5)) v(n)) SELECT prefix, CAST(n AS INT) AS value FROM p WHERE length(prefix) > 1 UNION ALL SELECT '~new', 9")
def patricia_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix table with an entry more and its one-letter entries removed; all its entries."""
    prefixes = _prefixes(table(spark, sf_dir, "part"))
    more = lookup.prefix_add(prefixes, "prefix", spark.createDataFrame([("~new", 9)], "prefix string, value int"))
    return lookup.prefix_remove(more, "prefix", prefixes.where("char_length(prefix) = 1"))


@add("insert_unique", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 20, 'NEW' FROM nation WHERE n_nationkey + 20 > 24")
def insert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return lookup.insert(n, n.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.lit("NEW").alias("n_name")), "n_nationkey")


@add("update_delete", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'X' ELSE n_name END AS n_name FROM nation WHERE n_nationkey < 20")
def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = lookup.replace(n, n.where("n_nationkey < 5").withColumn("n_name", F.lit("X")), "n_nationkey")
    return lookup.remove(new, n.where("n_nationkey >= 20"), "n_nationkey")


@add("append_numbered", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY r_name), 'N' || r_name FROM region")
def append_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    return lookup.append_numbered(r, r.withColumn("r_name", F.concat(F.lit("N"), "r_name")), "r_regionkey", "r_name")


# spatial: customers as points (balance, key), parts as boxes

add("spatial_overlap", "SELECT p_partkey FROM part WHERE p_size <= 30 AND p_size + 5 >= 20 AND p_retailprice <= 1500 AND p_retailprice + 100 >= 1050")(lambda s, d: table(s, d, "part").where(_boxes().intersects(spatial.Box.of((20, 30), (1050, 1500)))).select("p_partkey"))
add("spatial_contains", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_size + 5 <= 40 AND p_retailprice >= 920 AND p_retailprice + 100 <= 1050")(lambda s, d: table(s, d, "part").where(spatial.Box.of((20, 40), (920, 1050)).contains(_boxes())).select("p_partkey"))
add("spatial_mbr", "SELECT CAST(min(p_size) AS INT) AS low0, CAST(max(p_size + 5) AS INT) AS high0, min(p_retailprice) AS low1, max(p_retailprice + 100) AS high1 FROM part")(lambda s, d: spatial.wrapping(table(s, d, "part"), _boxes()))
add("spatial_knn", "SELECT p_partkey, round(distance, 9) AS distance FROM (SELECT p_partkey, sqrt(pow(greatest(0, p_size - 25, 25 - (p_size + 5)), 2) + pow(greatest(0, p_retailprice - 1300, 1300 - (p_retailprice + 100)), 2)) AS distance FROM part ORDER BY distance, p_partkey LIMIT 20)")(lambda s, d: spatial.nearest(table(s, d, "part"), _boxes(), (25, 1300), 20, "p_partkey").select("p_partkey", F.round("distance", 9).alias("distance")))
add("spatial_area", "SELECT p_partkey, 5.0::DOUBLE * 100 AS area, round((greatest(p_size + 5, 30) - least(p_size, 20)) * (greatest(p_retailprice + 100, 1500) - least(p_retailprice, 1050)), 6) AS joined FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.round(_boxes().area(), 6).alias("area"), F.round(_boxes().join_area(spatial.Box.of((20, 30), (1050, 1500))), 6).alias("joined")))
add("spatial_knn_nd", "SELECT vec_id, round(distance, 6) AS distance FROM (SELECT e.vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2)))) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT 10)")(lambda s, d: table(s, d, "embeddings").crossJoin(F.broadcast(table(s, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))).withColumn("distance", spatial.euclidean(F.col("embedding"), F.col("q"))).orderBy("distance", "vec_id").limit(10).select("vec_id", F.round("distance", 6).alias("distance")))
add("spatial_bits_knn", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' ORDER BY sqrt(pow(p_size - 25, 2) + pow(p_retailprice - 1300, 2)), p_partkey LIMIT 10")(lambda s, d: spatial.nearest(lookup.keep_ids(table(s, d, "part"), table(s, d, "part").where("p_type = 'PROMO'"), "p_partkey"), spatial.Box.of(("p_size", "p_size"), ("p_retailprice", "p_retailprice")), (25, 1300), 10, "p_partkey").select("p_partkey"))
add("sphere_distance", "SELECT c_custkey, round(2 * asin(least(1.0, sqrt(pow(sin((0.3 - dec) / 2), 2) + cos(dec) * cos(0.3) * pow(sin((1.0 - ra) / 2), 2)))), 8) AS distance FROM (SELECT c_custkey, (c_custkey % 628) / 100.0::DOUBLE AS ra, c_acctbal / 10000.0::DOUBLE AS dec FROM customer)")(lambda s, d: _sky(s, d).select("c_custkey", F.round(spatial.great_circle(F.col("ra"), F.col("dec"), F.lit(1.0), F.lit(0.3)), 8).alias("distance")))
add("sphere_box", "SELECT c_custkey FROM (SELECT c_custkey, (c_custkey % 628) / 100.0::DOUBLE AS ra, c_acctbal / 10000.0::DOUBLE AS dec FROM customer) WHERE (ra >= 6.0 OR ra <= 0.5) AND dec BETWEEN 0.1 AND 0.5")(lambda s, d: _sky(s, d).where(spatial.in_sky_box(F.col("ra"), F.col("dec"), (6.0, 0.1), (0.5, 0.5))).select("c_custkey"))
add("sphere_circle", "SELECT c_custkey FROM (SELECT c_custkey, (c_custkey % 628) / 100.0::DOUBLE AS ra, c_acctbal / 10000.0::DOUBLE AS dec FROM customer) WHERE 2 * asin(least(1.0, sqrt(pow(sin((0.3 - dec) / 2), 2) + cos(dec) * cos(0.3) * pow(sin((1.0 - ra) / 2), 2)))) <= 0.5")(lambda s, d: _sky(s, d).where(spatial.in_circle(F.col("ra"), F.col("dec"), (1.0, 0.3), 0.5)).select("c_custkey"))


def _boxes() -> spatial.Box:
    return spatial.Box.of(("p_size", F.col("p_size") + 5), ("p_retailprice", F.col("p_retailprice") + 100))


def _sky(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", ((F.col("c_custkey") % 628) / 100.0).alias("ra"), (F.col("c_acctbal") / 10000.0).alias("dec"))


@add("spatial_overlap_join", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a, part b WHERE a.p_partkey < b.p_partkey AND a.p_size <= b.p_size + 5 AND a.p_size + 5 >= b.p_size AND a.p_retailprice <= b.p_retailprice + 100 AND a.p_retailprice + 100 >= b.p_retailprice")
def spatial_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys a < b of parts with overlapping boxes; sizes are spread so that both sides are 100 long."""
    part = table(spark, sf_dir, "part")

    def side(df: DataFrame, n: str) -> tuple[DataFrame, spatial.Box]:
        df = df.select(F.col("p_partkey").alias(n), (F.col("p_size") * 20).alias(f"{n}x"), F.col("p_retailprice").alias(f"{n}y"))
        return df, spatial.Box.of((f"{n}x", F.col(f"{n}x") + 100), (f"{n}y", F.col(f"{n}y") + 100))

    (a, abox), (b, bbox) = side(part, "a"), side(part, "b")
    return spatial.overlap_join(a, abox, b, bbox, 200.0).where("a < b").select("a", "b")


# time series and versions

T1, T2 = "2024-01-05 00:00:00", "2024-01-12 00:00:00"


def _ts(x: str):
    return F.lit(x).cast("timestamp_ntz")


add("ts_range", f"SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '{T1}' AND TIMESTAMP '{T2}'")(lambda s, d: timeseries.ticks(table(s, d, "events"), "ts", _ts(T1), _ts(T2)).select("event_id", "ts"))
add("ts_first_last", "SELECT min(ts) AS first_time, max(ts) AS last_time, count(*) AS n FROM events")(lambda s, d: timeseries.extent(table(s, d, "events"), "ts"))
add("ts_tick", "SELECT event_id FROM events WHERE ts = (SELECT min(ts) FROM events)")(lambda s, d: table(s, d, "events").join(F.broadcast(timeseries.extent(table(s, d, "events"), "ts")), F.col("ts") == F.col("first_time"), "left_semi").select("event_id"))
add("ts_day_dev", "SELECT date_trunc('day', ts)::TIMESTAMP AS period, round(stddev_pop(value), 6) AS dev, count(*) AS n FROM events GROUP BY 1")(lambda s, d: timeseries.by_period(table(s, d, "events"), "ts", "day", F.round(A.deviation("value"), 6).alias("dev"), A.count().alias("n")).withColumn("period", F.col("period").cast("timestamp_ntz")))
add("ts_remove_count", f"SELECT count(*) AS removed FROM events WHERE ts BETWEEN TIMESTAMP '{T1}' AND TIMESTAMP '{T2}'")(lambda s, d: timeseries.remove(table(s, d, "events"), "ts", _ts(T1), _ts(T2))[1])
add("ts_remove_rest", f"SELECT event_id FROM events WHERE NOT ts BETWEEN TIMESTAMP '{T1}' AND TIMESTAMP '{T2}'")(lambda s, d: timeseries.remove(table(s, d, "events"), "ts", _ts(T1), _ts(T2))[0].select("event_id"))
add("ts_blocks", "SELECT user_id, block, count(*) AS n FROM (SELECT user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // 16 AS BIGINT) AS block FROM events) GROUP BY ALL")(lambda s, d: timeseries.blocks(table(s, d, "events"), "ts", 16, ["user_id"]).groupBy("user_id", "block").agg(A.count().alias("n")))
add(
    "ts_blocks_interval",
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), w AS (SELECT user_id, event_id, t, rn, 0 AS block, 1 AS used, t AS began FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.t, e.rn, CASE WHEN used >= 4 OR e.t - began > 36000000000 THEN block + 1 ELSE block END, CASE WHEN used >= 4 OR e.t - began > 36000000000 THEN 1 ELSE used + 1 END, CASE WHEN used >= 4 OR e.t - began > 36000000000 THEN e.t ELSE began END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1) SELECT user_id, CAST(block AS BIGINT) AS block, count(*) AS n FROM w GROUP BY ALL",
)(lambda s, d: timeseries.blocks(table(s, d, "events"), "ts", 4, ["user_id"], 36_000).groupBy("user_id", "block").agg(A.count().alias("n")))
add("as_of_join", "SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")(lambda s, d: timeseries.as_of(table(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"), table(s, d, "events").where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value")), ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "last_value"))
V = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {0}, o_orderkey {0}) AS rn FROM orders {1}"


def _history(s: SparkSession, d: str) -> History:
    return History(table(s, d, "orders").withColumn("gone", F.col("o_orderstatus") == "P"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", "gone")


AT = "1997-06-01 00:00:00"
add("ver_current", f"SELECT o_custkey, o_orderkey FROM ({V.format('DESC', '')}) WHERE rn = 1 AND o_orderstatus <> 'P'")(lambda s, d: _history(s, d).current().select("o_custkey", "o_orderkey"))
add("ver_all", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P'")(lambda s, d: _history(s, d).all().select("o_custkey", "o_orderkey"))
add("ver_slice", f"SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '{AT}' AND o_orderstatus <> 'P'")(lambda s, d: _history(s, d).time_slice(_ts("1996-01-01 00:00:00"), _ts(AT)).select("o_custkey", "o_orderkey"))
add("ver_latest_before", f"SELECT o_custkey, o_orderkey FROM ({V.format('DESC', f"WHERE o_orderdate <= TIMESTAMP '{AT}'")}) WHERE rn = 1")(lambda s, d: _history(s, d).latest_before(_ts(AT)).select("o_custkey", "o_orderkey"))
add("ver_earliest_after", f"SELECT o_custkey, o_orderkey FROM ({V.format('ASC', f"WHERE o_orderdate >= TIMESTAMP '{AT}'")}) WHERE rn = 1")(lambda s, d: _history(s, d).earliest_after(_ts(AT)).select("o_custkey", "o_orderkey"))
add("ver_find", f"SELECT o_custkey, o_orderkey FROM ({V.format('DESC', '')}) WHERE rn = 1 AND o_orderstatus <> 'P' AND o_totalprice > 3000")(lambda s, d: _history(s, d).current().where("o_totalprice > 3000").select("o_custkey", "o_orderkey"))
VERSIONED = "SELECT doc_id // 4 AS object, doc_id % 4 AS version, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 4 * 10 AS INT)) AS date, text FROM documents"


def _texts(s: SparkSession, d: str) -> History:
    """Documents as versions, four of an object."""
    docs = table(s, d, "documents")
    version = F.col("doc_id") % 4
    date = F.timestamp_add("DAY", (version * 10).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return History(docs.select(F.floor(F.col("doc_id") / 4).cast("long").alias("object"), version.alias("version"), date.alias("date"), "text"), "object", ["version"], "date")


def _word(w: str) -> str:
    return f"regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{Nd}}]){w}($|[^\\p{{L}}\\p{{Nd}}])')"


add("ver_text_slice", f"SELECT object, version FROM ({VERSIONED}) WHERE date > TIMESTAMP '2024-01-05' AND date <= TIMESTAMP '2024-01-25' AND {_word('license')}")(lambda s, d: _texts(s, d).search("text", "license", _ts("2024-01-05 00:00:00"), _ts("2024-01-25 00:00:00"), newest_first=True).select("object", "version"))
add("ver_text_current", f"SELECT object, version FROM (SELECT *, max(version) OVER (PARTITION BY object) AS last FROM ({VERSIONED})) WHERE version = last AND {_word('license')} AND {_word('version')}")(lambda s, d: _texts(s, d).search("text", "license version", current=True).select("object", "version"))


@add("ver_graph", "SELECT 'nation ' || n_nationkey || CASE n_nationkey % 2 WHEN 0 THEN ' 1.2' ELSE ' 1.1' END AS id, CASE n_nationkey % 2 WHEN 0 THEN 2 ELSE 1 END AS versions, CASE WHEN n_nationkey < 3 THEN 1 ELSE 0 END AS labelled FROM nation")
def ver_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as version graphs: those with even keys checked out and in, the first three labelled; each one's current id, versions, labelled versions."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("object"), "n_nationkey")
    first = n.select("object", F.concat("object", F.lit(" 1.1")).alias("id"))
    graph = VersionGraph(first.select("object", "id", _ts("2024-01-01 00:00:00").alias("date"), F.array().cast("array<string>").alias("labels")), spark.createDataFrame([], "id string, predecessor string"), first)
    graph = graph.check_in(graph.check_out(n.where("n_nationkey % 2 = 0")), _ts("2024-02-01 00:00:00"))
    for k in range(3):
        graph = graph.label(f"nation {k} 1.1", "base")
    counts = graph.versions.groupBy("object").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.array_contains("labels", "base")).alias("labelled"))
    return graph.current.join(counts, "object").select("id", "versions", "labelled")


# full text

TOKENS = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS word FROM documents), p AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word NOT IN ('a', 'the', 'at', 'on', 'of', 'to', 'an') AND length(word) <= 100 GROUP BY ALL) "


def _index(s: SparkSession, d: str) -> fulltext.Index:
    return fulltext.Index(table(s, d, "documents"), "doc_id", "text")


def text_query(name: str, query: str, where: str) -> None:
    QUERIES[name] = lambda s, d: _index(s, d).match(fulltext.parse(query)).select(F.col("doc").alias("doc_id"))
    ORACLE_SQL[name] = TOKENS + f"SELECT doc_id FROM documents d WHERE {where}"


def _in(word: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM p WHERE word = '{word}')"


text_query("ft_match", "license", _in("license"))
text_query("ft_and", "license AND the version", f"{_in('license')} AND {_in('version')}")
text_query("ft_or", "idiot OR clown", f"{_in('idiot')} OR {_in('clown')}")
text_query("ft_not", "license NOT version", f"{_in('license')} AND NOT {_in('version')}")
text_query("ft_precedence", "license AND version OR public", f"{_in('license')} AND ({_in('version')} OR {_in('public')})")
text_query("ft_phrase", '"general public license"', "regexp_matches(lower(text), '(^|[^\\p{L}\\p{Nd}])general[^\\p{L}\\p{Nd}]{1,2}public[^\\p{L}\\p{Nd}]{1,2}license($|[^\\p{L}\\p{Nd}])')")
add("ft_prefix", TOKENS + "SELECT DISTINCT doc_id FROM p WHERE starts_with(word, 'licens')")(lambda s, d: _index(s, d).prefix("licens").select(F.col("doc").alias("doc_id")))
add("ft_keywords", TOKENS + "SELECT word, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS documents FROM p WHERE starts_with(word, 'wor') GROUP BY word")(lambda s, d: _index(s, d).keywords("wor"))
add("ft_counts", TOKENS + "SELECT count(DISTINCT word) AS words, (SELECT count(*) FROM documents) AS documents FROM p")(lambda s, d: _index(s, d).counts())
RANK = TOKENS + ", n AS (SELECT doc_id, sum(tf) AS n_words FROM p GROUP BY doc_id), s AS (SELECT p.*, n_words, (SELECT count(*) FROM documents) AS docs, (SELECT count(DISTINCT word) FROM p) / (SELECT count(*) FROM documents) AS avg_words, (SELECT count(*) FROM p q WHERE q.word = p.word) AS df FROM p JOIN n USING (doc_id) WHERE word IN ('license', 'version')) "
add("ft_rank", RANK + "SELECT doc_id, round(ln(1 + tf * ln(1 + 2 * avg_words / n_words) * ln(docs / df)), 6) AS rank FROM s WHERE word = 'license' ORDER BY rank DESC, doc_id LIMIT 20")(lambda s, d: _index(s, d).search("license", 20).select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank")))
add("ft_rank_and", RANK + "SELECT doc_id, round(sum(ln(1 + tf * ln(1 + 2 * avg_words / n_words) * ln(docs / df))), 6) AS rank FROM s GROUP BY doc_id HAVING count(*) = 2")(lambda s, d: _index(s, d).search("license version", nearness=False).select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank")))
NEAR = (
    TOKENS
    + """, t AS (SELECT doc_id, lower(text) AS low FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{Nd}])general[^\\p{L}\\p{Nd}]{1,2}public[^\\p{L}\\p{Nd}]{1,2}license($|[^\\p{L}\\p{Nd}])')),
k(word, i) AS (VALUES ('general', 0), ('public', 1), ('license', 2)),
g AS (SELECT doc_id, unnest(string_split_regex(low, '[^\\p{L}\\p{Nd}]')) AS x, unnest(range(len(string_split_regex(low, '[^\\p{L}\\p{Nd}]')))) AS j FROM t),
q AS (SELECT doc_id, x, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY j) - length(x) - 1 AS pos FROM g),
e AS (SELECT doc_id, pos, i, length(word) AS n FROM q JOIN k ON x = word),
nx AS (SELECT e.doc_id, e.pos, e.i, (SELECT min(f.pos) FROM e f WHERE f.doc_id = e.doc_id AND f.i = 0 AND (f.pos, f.i) >= (e.pos, e.i)) AS a, (SELECT min(f.pos) FROM e f WHERE f.doc_id = e.doc_id AND f.i = 1 AND (f.pos, f.i) >= (e.pos, e.i)) AS b, (SELECT min(f.pos) FROM e f WHERE f.doc_id = e.doc_id AND f.i = 2 AND (f.pos, f.i) >= (e.pos, e.i)) AS c FROM e),
gap AS (SELECT doc_id, CASE WHEN b IS NULL THEN NULL WHEN b < a THEN (a - b - 6) * 10 ELSE b - a - 7 END AS ab, CASE WHEN c < b THEN (b - c - 7) * 10 ELSE c - b - 6 END AS bc, CASE WHEN b IS NULL THEN CASE WHEN c < a THEN (a - c - 7) * 10 ELSE c - a - 7 END END AS ac FROM nx),
near AS (SELECT doc_id, max(coalesce(1 / sqrt(greatest(CASE WHEN ab <= 2 THEN 1 ELSE ab END, 1)), 0) + coalesce(1 / sqrt(CASE WHEN bc <= 2 THEN 1 ELSE bc END), 0) + coalesce(1 / sqrt(CASE WHEN ac <= 2 THEN 1 ELSE ac END), 0)) AS near FROM gap GROUP BY doc_id),
n AS (SELECT doc_id, sum(tf) AS n_words FROM p GROUP BY doc_id),
r AS (SELECT p.doc_id, sum(ln(1 + tf * ln(1 + 2 * (SELECT count(DISTINCT word) FROM p) / (SELECT count(*) FROM documents) / n_words) * ln((SELECT count(*) FROM documents) / (SELECT count(*) FROM p z WHERE z.word = p.word)))) AS rank FROM p JOIN n USING (doc_id) JOIN k USING (word) GROUP BY p.doc_id)
SELECT doc_id, round(rank * (1 + 10 * near), 6) AS rank FROM r JOIN near USING (doc_id)"""
)
add("ft_rank_near", NEAR)(lambda s, d: _index(s, d).search('"general public license"').select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank")))


def _singular(w: str) -> str:
    return w[:-1] if len(w) > 3 and w.endswith("s") else w


add("ft_normal_forms", TOKENS + "SELECT DISTINCT doc_id FROM p WHERE word IN ('license', 'licenses', 'word', 'words')")(lambda s, d: fulltext.Index(table(s, d, "documents"), "doc_id", "text", _singular).match(fulltext.parse("licenses OR word")).select(F.col("doc").alias("doc_id")))


def _stored(s: SparkSession, d: str, normal_form: fulltext.NormalForm | None = None) -> fulltext.StoredIndex:
    """An index of all documents in two batches, one of which is taken away and added again."""
    index = fulltext.StoredIndex(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}", normal_form)
    docs = table(s, d, "documents")
    index.add(docs.where("doc_id % 2 = 0"), "doc_id", "text")
    index.add(docs.where("doc_id % 2 = 1"), "doc_id", "text")
    index.remove(docs.where("doc_id % 2 = 0"), "doc_id")
    index.add(docs.where("doc_id % 2 = 0"), "doc_id", "text")
    return index


add("ft_stored_rank", ORACLE_SQL["ft_rank_and"])(lambda s, d: _stored(s, d).search("license version", nearness=False).select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank")))
add("ft_stored_phrase", ORACLE_SQL["ft_phrase"])(lambda s, d: _stored(s, d).match('"general public license"').select(F.col("doc").alias("doc_id")))
add("ft_stored_not", ORACLE_SQL["ft_not"])(lambda s, d: _stored(s, d).compact().match("license NOT version").select(F.col("doc").alias("doc_id")))
add("ft_stored_keywords", ORACLE_SQL["ft_keywords"])(lambda s, d: _stored(s, d).keywords("wor"))


# associative data and triples

EAV_ITEMS = "SELECT 'customer:' || c_custkey AS item FROM customer c JOIN nation n ON c_nationkey = n_nationkey"


def _eav(s: SparkSession, d: str) -> DataFrame:
    c = assoc.from_table(table(s, d, "customer"), "customer", "c_custkey", ["c_name", "c_mktsegment"], ["c_acctbal"], {"nation": ("c_nationkey", "nation")})
    n = assoc.from_table(table(s, d, "nation"), "nation", "n_nationkey", ["n_name"], [], {"region": ("n_regionkey", "region")})
    return c.unionByName(n).unionByName(assoc.from_table(table(s, d, "region"), "region", "r_regionkey", ["r_name"]))


add("eav_compare", EAV_ITEMS + " WHERE c_acctbal >= 5000 AND lower(c_mktsegment) = 'building'")(lambda s, d: (lambda e: assoc.both(assoc.compare(e, "c_acctbal", ">=", 5000), assoc.compare(e, "c_mktsegment", "=", "Building")))(_eav(s, d)))
add("eav_between_or", EAV_ITEMS + " WHERE c_acctbal BETWEEN 0 AND 100 OR lower(c_mktsegment) IN ('machinery', 'furniture')")(lambda s, d: (lambda e: assoc.either(assoc.between(e, "c_acctbal", 0, 100), assoc.in_array(e, "c_mktsegment", ["MACHINERY", "furniture"])))(_eav(s, d)))
add("eav_startswith", "SELECT 'nation:' || n_nationkey AS item FROM nation WHERE starts_with(lower(n_name), 'nation_1')")(lambda s, d: assoc.starts_with(_eav(s, d), "n_name", "NATION_1"))
add("eav_prefix_of", "SELECT 'nation:' || n_nationkey AS item FROM nation WHERE starts_with('nation_12x', lower(n_name))")(lambda s, d: assoc.is_prefix_of(_eav(s, d), "n_name", "Nation_12x"))
add("eav_in_subquery", EAV_ITEMS + " JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")(lambda s, d: (lambda e: assoc.related(e, "nation", assoc.related(e, "region", assoc.compare(e, "r_name", "=", "asia"))))(_eav(s, d)))
add("eav_inverse", "SELECT DISTINCT 'nation:' || c_nationkey AS item FROM customer WHERE c_acctbal > 9500")(lambda s, d: (lambda e: assoc.related(e, "-nation", assoc.compare(e, "c_acctbal", ">", 9500)))(_eav(s, d)))
add("eav_verbs", "SELECT unnest(['class', 'c_name', 'c_mktsegment', 'c_acctbal', 'nation', 'n_name', 'region', 'r_name']) AS attr")(lambda s, d: assoc.verbs(_eav(s, d)))
add("eav_occurrences", "SELECT 'region:' || r_regionkey AS item, r_name AS text FROM region")(lambda s, d: assoc.occurrences(_eav(s, d), "r_name").select("item", "text"))


add("eav_match", "SELECT 'customer:' || c_custkey AS item FROM customer WHERE lower(c_mktsegment) = 'building' AND c_acctbal > 100")(lambda s, d: (lambda e: assoc.both(assoc.match(e, ["c_name", "c_mktsegment"], "customer AND building"), assoc.compare(e, "c_acctbal", ">", 100)))(_eav(s, d)))


def _things(s: SparkSession, d: str) -> DataFrame:
    """Parts as things with two versions, suppliers with one, related through their keys."""
    p = table(s, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uri"), F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), "*")
    ts = F.when(F.col("version") == 1, _ts("2020-01-01 00:00:00")).otherwise(_ts("2022-01-01 00:00:00"))
    null = F.lit(None)
    props = [F.struct(F.lit("name").alias("prop"), F.col("p_name").alias("value"), null.cast("double").alias("number"), null.cast("string").alias("ref")), F.struct(F.lit("price").alias("prop"), null.cast("string").alias("value"), (F.col("p_retailprice") * F.col("version")).alias("number"), null.cast("string").alias("ref")), F.struct(F.lit("maker").alias("prop"), null.cast("string").alias("value"), null.cast("double").alias("number"), F.concat(F.lit("supplier/"), (F.col("p_partkey") % 10 + 1).cast("string")).alias("ref"))]
    p = p.select("uri", "version", ts.alias("ts"), F.concat(F.lit("part."), F.lower("p_type")).alias("type"), F.explode(F.array(*props)).alias("x")).select("uri", "version", "ts", "type", "x.*")
    u = table(s, d, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("uri"), F.lit(1).alias("version"), _ts("2020-01-01 00:00:00").alias("ts"), F.lit("supplier").alias("type"), F.lit("name").alias("prop"), F.col("s_name").alias("value"), null.cast("double").alias("number"), null.cast("string").alias("ref"))
    return p.unionByName(u)


add("rdf_latest_before", "SELECT 'part/' || p_partkey AS uri, 1 AS version FROM part WHERE p_retailprice BETWEEN 930 AND 960")(lambda s, d: rdf.search(_things(s, d), properties={"price": (930, 960)}, kind=rdf.LATEST_BEFORE, ts=_ts("2021-01-01 00:00:00")))
add("rdf_oldest_after", "SELECT 'part/' || p_partkey AS uri, 2 AS version FROM part WHERE p_retailprice * 2 >= 1900 AND p_retailprice * 2 < 1950")(lambda s, d: rdf.search(_things(s, d), properties={"price": (1900, 1950, True, False)}, kind=rdf.OLDEST_AFTER, ts=_ts("2021-01-01 00:00:00")))
add("rdf_wildcard", "SELECT 'part/' || p_partkey AS uri, 2 AS version FROM part WHERE p_name LIKE '%a%e%' AND 'part/' || p_partkey LIKE 'part/1%'")(lambda s, d: rdf.search(_things(s, d), uri="part/1*", properties={"name": "*a*e*"}))
add("rdf_reference", "SELECT 'part/' || p_partkey AS uri, 2 AS version FROM part WHERE p_partkey % 10 + 1 IN (SELECT s_suppkey FROM supplier WHERE s_name LIKE '%3')")(lambda s, d: rdf.search(_things(s, d), properties={"maker": {"name": "*3"}}))
add("rdf_subtype", "SELECT 'part/' || p_partkey AS uri, 2 AS version FROM part")(lambda s, d: rdf.search(_things(s, d), "thing", uri="part/*", types=_things(s, d).select("type").where("type like 'part.%'").distinct().select("type", F.lit("part").alias("parent")).unionAll(s.createDataFrame([("part", "thing"), ("supplier", "other")], "type string, parent string"))))
add("rdf_keyword", "SELECT 'part/' || p_partkey AS uri, v AS version FROM part, (VALUES (1), (2)) t(v) WHERE regexp_matches(lower(p_name), '(^| )' || (SELECT lower(split_part(p_name, ' ', 1)) FROM part WHERE p_partkey = 1) || '( |$)')")(lambda s, d: rdf.keywords(_things(s, d), table(s, d, "part").where("p_partkey = 1").first()["p_name"].split(" ")[0]))
add("rdf_dump", "SELECT 0 AS depth, 6 * count(*) AS n FROM part UNION ALL SELECT 1, count(*) FROM part JOIN supplier ON p_partkey % 10 + 1 = s_suppkey")(lambda s, d: (lambda t: rdf.dump(t, t.where("uri like 'part/%'").select("uri"), 3).groupBy("depth").agg(F.count(F.lit(1)).alias("n")))(_things(s, d)))
FIND = """<find><part.promo about="part/*" before="2021-01-01" price="[930, 1800)"><maker><name>*3</name></maker></part.promo><thing all="true" price="950.0"/></find>"""
add("rdf_find", "SELECT 'part/' || p_partkey AS uri, 1 AS version FROM part WHERE p_type = 'PROMO' AND p_retailprice >= 930 AND p_retailprice < 1800 AND p_partkey % 10 + 1 IN (SELECT s_suppkey FROM supplier WHERE s_name LIKE '%3') UNION ALL SELECT 'part/' || p_partkey, v FROM part, (VALUES (1), (2)) t(v) WHERE p_retailprice * v = 950")(lambda s, d: (lambda t, found: found[0].run(t).unionByName(found[1].run(t)))(_things(s, d), rdf.find_document(FIND)))


def _places(s: SparkSession, d: str) -> DataFrame:
    """Parts as things with a place: a rectangle, or a point for every other one."""
    p, null = table(s, d, "part"), F.lit(None)
    wide = F.when(F.col("p_partkey") % 2 == 0, 5).otherwise(0)
    corner = [F.col("p_size").cast("double"), F.col("p_retailprice"), (F.col("p_size") + wide).cast("double"), F.col("p_retailprice") + wide * 20]
    return p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uri"), F.lit(1).alias("version"), _ts("2020-01-01 00:00:00").alias("ts"), F.lit("part").alias("type"), F.lit("place").alias("prop"), null.cast("string").alias("value"), null.cast("double").alias("number"), null.cast("string").alias("ref"), F.array(*corner).alias("box"))


add("rdf_region", "SELECT 'part/' || p_partkey AS uri, 1 AS version FROM part WHERE p_size <= 20 AND p_size + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END >= 10 AND p_retailprice <= 1000 AND p_retailprice + CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 0 END >= 920")(lambda s, d: rdf.search(_places(s, d), "part", properties={"place": rdf.Region((10, 920), (20, 1000))}))


# collections and maps

add("list_ops", "SELECT vec_id, embedding[1] AS head, len(embedding[3:5]) AS part, CAST(list_position(embedding, embedding[4]) - 1 AS INT) AS place FROM embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", C.list_get(F.col("embedding"), 0).alias("head"), F.size(C.list_sub(F.col("embedding"), 2, 5)).cast("long").alias("part"), C.list_index(F.col("embedding"), F.get("embedding", F.lit(3))).alias("place")))
add("map_ops", "SELECT o_custkey, count(*) FILTER (WHERE o_orderkey >= 100 AND o_orderkey < 5000) AS inside, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("m")).select("o_custkey", F.size(C.sub_map(F.col("m"), 100, 5000)).cast("long").alias("inside"), C.first_key(F.col("m")).alias("first_key"), C.last_key(F.col("m")).alias("last_key")))
add("json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))


# windows over events, as a table

add("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda s, d: streams.tumbling(table(s, d, "events"), "ts", "1 hour", ["event_type"], A.count().alias("n")))
add("stream_sessions", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")(lambda s, d: streams.sessions(table(s, d, "events"), "ts", "2 hours", ["user_id"], A.count().alias("n")))
