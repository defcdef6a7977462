"""Every query of the engine against its SQL in DuckDB, or that it gives rows where it has none."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from gapengine.queries import core, oracle

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and pd.isna(value)) or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, db, name):
    got = core.queries()[name](spark, SF).toPandas()
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(core.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
