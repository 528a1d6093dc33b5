"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from riffle.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted(tuple("null" if v is None else repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert cols
        return
    want = db.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert _rows(got) == _rows(want.select(*[f'"{c}"' for c in cols]).fetchall())
