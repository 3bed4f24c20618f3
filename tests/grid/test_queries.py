"""Every grid query against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest

from gridfire.queries import ORACLE_SQL, QUERIES

TABLES = ["customer", "lineitem", "nation", "orders", "part", "supplier"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    rel = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
