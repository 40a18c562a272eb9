"""The registered queries on the smallest tables: columns, rows, and DuckDB's rows where SQL can express them."""

import duckdb
import pytest

from tessera.llm.oracle import ORACLE_SQL
from tessera.llm.queries import QUERIES
from tests.test_oracle import SF, TABLES, ordered, plain

COLUMNS = {
    "op1_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op3_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5_pii": {"doc_id", "text", "pii_spans"},
    "op6_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted", "toxic_spans"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_each_is_covered():
    assert set(QUERIES) == set(COLUMNS) | set(ORACLE_SQL) and not set(COLUMNS) & set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = ordered([tuple(plain(r[c]) for c in names) for r in df.collect()])
    if name in COLUMNS:
        assert set(names) == COLUMNS[name] and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
        return
    cursor = duck.execute(ORACLE_SQL[name])
    given = [x[0] for x in cursor.description]
    assert sorted(given) == names
    places = sorted(range(len(given)), key=given.__getitem__)
    assert rows == ordered([tuple(plain(r[i]) for i in places) for r in cursor.fetchall()])
