"""Every query against its SQL on another engine, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from convoforge.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["path", "chunk", "chunks", "record"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hits_in_long_conversations_equal_sql(spark, tmp_path):
    talk = [(c, t, ("user", "assistant")[t % 2], f"{'then' if t % 3 else 'now'} comes step {t}") for c in (0, 8, 24, 25) for t in range(150)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["q_q2_hits"](spark, str(tmp_path)).select("path", "line_index").collect())
    want = con.sql(f"SELECT path, line_index FROM ({ORACLE_SQL['q_q2_hits']})").fetchall()
    assert got == sorted(want) and len(got) >= 400
