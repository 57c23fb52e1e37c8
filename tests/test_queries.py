"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest

from tests.conftest import SF
from tidemark.plans.registry import QUERIES, SQL


def rows(df):
    cols = sorted(df.columns)

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        try:
            return "None" if v != v else str(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    return cols, sorted(tuple(map(cell, r)) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
