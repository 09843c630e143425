"""Bars of trades whose keys outgrow their digits of the order, against SQL, value by value."""

from pathlib import Path

import pytest

from tests.test_queries import SF
from tidemark.plans.queries import ORACLE, QUERIES, nearest

#: Queries on opens and closes, each found to differ from its SQL on tables with larger keys.
CHECKED = ["panel_bars", "abnormal_returns", "adjust_prices", "bollinger", "buy_hold", "event_outcome_join", "forward_returns_calendar", "forward_returns_positional", "labels", "macd", "outcomes_wide", "repair_seam", "returns_multi"]


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """The smallest tables, with parts and suppliers numbered up to a million, few orders and one date a month."""
    import duckdb

    out, con = tmp_path_factory.mktemp("keys"), duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        (out / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (out / "lineitem.parquet").unlink(), (out / "supplier.parquet").unlink()
    con.execute(f"copy (select * replace (l_orderkey % 50 as l_orderkey, l_partkey * 6007 as l_partkey, l_suppkey * 6007 as l_suppkey, date_trunc('month', l_shipdate)::timestamp as l_shipdate) from '{SF}/lineitem.parquet') to '{out}/lineitem.parquet'")
    con.execute(f"copy (select * replace (s_suppkey * 6007 as s_suppkey) from '{SF}/supplier.parquet') to '{out}/supplier.parquet'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{out}/{t}.parquet'")
    return str(out), con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql_on_large_keys(spark, large_keys, name):
    folder, con = large_keys
    QUERIES[name](spark, folder).write.parquet(mine := f"{folder}/out_{name}")
    con.execute(f"create or replace table theirs as {ORACLE[name]}")
    names = ", ".join(sorted(row[0] for row in con.execute("describe theirs").fetchall()))
    for a, b in (("theirs", f"'{mine}/*.parquet'"), (f"'{mine}/*.parquet'", "theirs")):
        assert con.execute(f"select {names} from {a} except all select {names} from {b}").fetchall() == []


def test_halves_round_as_in_sql(spark):
    import duckdb

    values = [(n / 100 / 32,) for n in range(1, 200_000, 3)] + [(2.5e-6,), (-2.5e-6,), (-1.5e-6,), (0.0,), (None,), (float("inf"),), (1e300,)]
    got = [row[0] for row in spark.createDataFrame(values, "x double").coalesce(1).select(nearest("x")).collect()]
    con = duckdb.connect()
    assert got == [row[0] for row in con.execute("select round(x, 6) from (select unnest($1::double[]) as x)", [[v[0] for v in values]]).fetchall()]
