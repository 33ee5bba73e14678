"""Each query with SQL gives what DuckDB gives on the smallest tables; the others run and have rows."""

import math

import pytest
from helpers import SF, normal

from gridloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows, "no rows"
    for row in rows:  # results are whole: no missing and no unusable numbers
        for v in row:
            assert v is not None and not any(isinstance(x, float) and not math.isfinite(x) for x in (v if isinstance(v, list) else [v]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
