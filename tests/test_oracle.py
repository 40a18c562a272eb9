"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = ordered([tuple(plain(r[c]) for c in names) for r in df.collect()])
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        given = [x[0] for x in cursor.description]
        assert sorted(given) == names
        places = sorted(range(len(given)), key=given.__getitem__)
        assert rows == ordered([tuple(plain(r[i]) for i in places) for r in cursor.fetchall()])


#: What queries that give an order sort by.
ORDERS = {
    "jsql_path_join": lambda r: -r["l_extendedprice"],
    "jsql_order_by": lambda r: (r["c_mktsegment"].lower(), -r["c_acctbal"], r["c_custkey"]),
    "idx_range": lambda r: -r["p_size"],
    "cmp_range": lambda r: (len(r["p_name"]), tuple(-ord(c) for c in r["p_name"].lower())),
    "agg_ordered": lambda r: r["n_regionkey"],
    "spatial_knn": lambda r: (r["distance"], r["p_partkey"]),
    "spatial_knn_nd": lambda r: (r["distance"], r["vec_id"]),
    "ts_range": lambda r: r["ts"],
    "ver_text_slice": lambda r: -r["version"],
    "ft_rank": lambda r: (-r["rank"], r["doc_id"]),
    "ft_stored_rank": lambda r: (-r["rank"], r["doc_id"]),
    "ft_rank_near": lambda r: (-r["rank"], r["doc_id"]),
    "eav_occurrences": lambda r: r["text"].lower(),
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_order(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and rows == sorted(rows, key=ORDERS[name])
