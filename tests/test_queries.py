"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    text = lambda x: "null" if x is None or x is pd.NaT or isinstance(x, float) and x != x else str(round(float(x), 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(text(x) for x in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got)


def test_extraction_needs_one_shuffle(spark):
    """The adapter groups events once; graphs and workflows add no exchange."""
    plan = registry.QUERIES["actions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


@pytest.mark.parametrize("name", ["nodes", "edges", "adjacency", "actions", "gateway_branches", "workflow_json", "validation_diagnostics"])
def test_graphs_are_built_once(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    builds = sum("make(" in line and "ArrowEvalPython" in line for line in plan.splitlines())
    # with states, or with extracted workflows beside raw records, there are two different functions or two sides
    assert builds <= (2 if name in ("workflow_json", "validation_diagnostics") else 1)


def test_entry():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
