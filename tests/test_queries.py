"""Each query against its SQL, by DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quarrylake.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet(['{p}'])")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same(spark, tables, name):
    df = QUERIES[name](spark, SF)
    want = tables.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})")
    assert sorted([d[0] for d in want.description]) == sorted(df.columns)
    got, want = df.collect(), want.fetchall()
    assert sorted(repr(tuple(map(plain, r))) for r in got) == sorted(repr(tuple(map(plain, r))) for r in want)
    assert got or name in ("similar_pools", "hamming_pairs")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_the_same_again(spark, name):
    """Their results are tested in test_groups_and_folds.py and test_upkeep.py; here, that rows there are and that they do not depend on the partitions."""
    one = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert one and one == sorted(map(repr, QUERIES[name](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
