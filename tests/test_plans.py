"""Plans that stay small enough for a driver."""

from pathlib import Path

import pytest

from tests.test_queries import SF, TABLES, cells
from tidemark.plans.queries import ORACLE, QUERIES


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_established_changes_reads_finished_cells(spark):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES["established_changes"](spark, SF)
    assert found._jdf.queryExecution().logical().collectLeaves().size() <= 4  # uncut: hundreds of copies of the events' plan
    assert cells(found.toPandas()) == cells(con.sql(ORACLE["established_changes"]).df())


def test_equal_cells_establish_no_change(spark):
    """A category with the values of OTHER on every session does not differ from it, however the rows arrive."""
    import datetime

    from tidemark.operators.rolling import rolling_categories, temporal_change

    up, down = (0.1, 0.2, 0.3) + (0.0,) * 7, (0.3, 0.2, 0.1) + (0.0,) * 7  # their sums in this order: 0.6000000000000001 and 0.6
    last, rows = datetime.date(2005, 1, 1), []
    for window in range(4):  # 455 days apart: the disjoint ones
        for d in [*range(0, 360, 15), 364]:
            pos = 2000 - 455 * window - d
            turned = (d // 15) % 2 == 0
            for category, values in (("MANAGEMENT", up if turned and window == 3 else down), ("OTHER", up if turned and window == 0 else down)):
                rows += [(f"T{values.index(v) if v else i}", category, 1, last - datetime.timedelta(2000 - pos), pos, v, True) for i, v in enumerate(values)]
    events = spark.createDataFrame(rows, "ticker string, category string, horizon int, date date, pos int, abnormal_ret double, valid boolean").coalesce(1)
    cells = rolling_categories(events, horizons=(1,))
    found = cells.where("category = 'MANAGEMENT' and k % 5 = 0").collect()
    assert len(found) == 4 and all(x["vs_other_sufficient"] for x in found)
    assert [(x["vs_other_diff_mean"], x["vs_other_se"], x["vs_other_p_value"]) for x in found] == [(0.0, 0.0, None)] * 4
    change = temporal_change(cells).where("metric = 'vs_other_diff'").collect()
    assert [(x["n_nonoverlapping_sufficient"], x["diff_p_value"], x["change_established"]) for x in change] == [(4, None, False)]
