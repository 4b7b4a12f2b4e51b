"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from loomdex.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_resolution_counts_of_repeated_orders(spark, tmp_path):
    """A row of orders is counted once, however many rows have its key."""
    c = duckdb.connect()
    for t in ("part", "customer", "orders"):
        again = f" UNION ALL SELECT * FROM '{SF}/{t}.parquet' WHERE o_orderkey % 3 = 0" if t == "orders" else ""
        c.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet'{again}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = catalog.QUERIES["resolution_counts"](spark, str(tmp_path)).toPandas(), c.execute(catalog.SQL["resolution_counts"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
