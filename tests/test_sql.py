"""Every registered base query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from taxaflow.plans.catalogue import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def canonical(row):
    out = []
    for x in row:
        if isinstance(x, float):
            out.append("nan" if math.isnan(x) else f"{x:.5g}")
        elif x is None or isinstance(x, bool | str):
            out.append(str(x))
        elif hasattr(x, "isoformat"):
            out.append(x.isoformat(" "))
        else:
            out.append(f"{float(x):.5g}")
    return out


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = queries()[name](spark, DIR)
    cols = sorted(df.columns)
    asked = duck.sql(oracle_sql()[name])
    assert sorted(asked.columns) == cols
    mine = sorted(canonical(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    theirs = sorted(canonical(r) for r in asked.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert mine == theirs
