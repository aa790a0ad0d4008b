"""Every query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from talkloom.plans.registry import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    with duckdb.connect() as db:
        for name in ("conversations", "orders"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
        yield db


def plain(frame):
    columns = sorted(frame.columns)
    text = lambda x: "" if x is None or pd.isna(x) else str(x)
    return columns, sorted(tuple(map(text, row)) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, name):
    want = tables.sql(ORACLE_SQL[name]).df()
    assert plain(QUERIES[name](spark, SMALL).toPandas()) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
