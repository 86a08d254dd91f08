"""Every query with SQL against DuckDB on the smallest tables, and rows of the others."""

import duckdb
import pytest

from conceptspark.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r))
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    ours = registry.QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = _rows(ours), _rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-5) if all(isinstance(v, float) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
