"""Registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from gainset.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v + 0.0:.5f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", ["token_roundtrip", "profit_assign", "item_rank", "suffix_remaining", "metrics_2", "prune_pub", "topk_merge", "mine_brand_k500", "mine_type_all", "mine_waves", "speedup_table"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "part", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert normal(got) == normal(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
