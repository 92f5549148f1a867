"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from shoebox.plans import binary_queries, file_queries, heif_queries, registry, table_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([list(r[i]) if isinstance(r[i], (list, tuple)) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(want.columns, want.fetchall())
