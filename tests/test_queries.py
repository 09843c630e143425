"""Queries against the same result computed by another engine, on the smallest tables."""

from pathlib import Path

import pytest

from tidemark.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CHECKED = ["abnormal_returns", "session_bucketing", "seam_backward_mask", "category_summary", "backtest_equity", "classification_metrics", "split_plan", "validate_drop_reasons", "training_matrix", "matrix_exclusions", "feature_null_counts"]


def cells(df):
    def cell(v):
        if v is None or v != v:
            return ""
        return f"{float(v) + 0.0:.5g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(bool(v)) if type(v).__name__ in ("bool", "bool_") else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine, other = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert cells(mine) == cells(other)


def test_every_query_is_named():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 60
