"""Queries of this subpackage that have SQL, against DuckDB; and the registry itself."""

import pytest

from scoreloom.llm import queries as Q

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    result = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))
