import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import backtest, calendar, indicators, outcomes, quality, seams
from tidemark.sources import registry

START = dt.date(2020, 1, 1)


def bars(spark, n=80, tickers=("A", "B"), seed=3):
    rng, rows = random.Random(seed), []
    for t in tickers:
        close = 100.0
        for i in range(n):
            o, close = close, close * (1 + rng.gauss(0, 0.02))
            rows.append((START + dt.timedelta(days=i), t, o, max(o, close) * 1.01, min(o, close) * 0.99, close, float(rng.randint(10, 99)), "fnspid"))
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double, source string")


def test_drop_reasons_are_sequential(spark):
    good = bars(spark, 40, ("A",))
    day = START + dt.timedelta(days=20)
    bad = spark.createDataFrame([(day, "A", 1.0, 2.0, 0.5, None, 5.0, "x", 0), (day, "A", 1.0, 0.5, 2.0, 1.0, 5.0, "x", 0), (day, "A", 9e4, 9e4, 9e4, 9e4, 5.0, "x", 9), (day, "A", 100.0, 101.0, 99.0, 100.0, 0.0, "x", 9)], good.schema.simpleString()[7:-1].replace(":", " ") + ", ord int")
    both = good.withColumn("ord", F.lit(1)).unionByName(bad).unionByName(good.where(F.col("date") == day).withColumn("ord", F.lit(2)))
    got = {r[0]: r[1] for r in quality.judged_bars(both, "ord").groupBy("drop_reason").count().collect()}
    assert got == {None: 40, "missing_value": 1, "invalid_bar": 2, "implausible": 1, "duplicate_date": 1}


def test_warm_up_and_no_look_ahead(spark):
    full = bars(spark, 80, ("A",))
    head = full.where(F.col("date") < START + dt.timedelta(days=60))
    a = {r["date"]: r for r in indicators.indicators(full).collect()}
    b = {r["date"]: r for r in indicators.indicators(head).collect()}
    for day, row in b.items():
        assert all(row[c] == a[day][c] or abs(row[c] - a[day][c]) < 1e-9 for c in row.asDict() if isinstance(row[c], float))
    day = lambda i: a[START + dt.timedelta(days=i)]
    assert day(20)["vol_21d"] is None and day(21)["vol_21d"] is not None
    assert day(18)["sma_20"] is None and day(19)["sma_20"] is not None
    assert day(4)["obv_delta_5d"] is None and day(5)["obv_delta_5d"] is not None
    assert day(0)["atr_14"] is None and day(13)["atr_14"] is not None


def test_ewma_over_gaps(spark):
    rows = [(START + dt.timedelta(days=i), "A", v) for i, v in enumerate([0.6, None, -0.2, None, 1.0])]
    got = [r["ewma_sent"] for r in indicators.carried_sentiment(spark.createDataFrame(rows, "date date, ticker string, sent_mean double")).orderBy("date").collect()]
    assert [round(x, 4) for x in got] == [0.6, 0.6, 0.2571, 0.2571, 0.5755]


def test_calendar_return_never_shifts(spark):
    panel = bars(spark, 20, ("A", "B")).where(~((F.col("ticker") == "A") & (F.col("date") == START + dt.timedelta(days=5))))
    got = outcomes.calendar_returns(panel, calendar.session_calendar(panel), (2,)).where("ticker = 'A'")
    by_day = {r["date"]: r["fwd_ret"] for r in got.collect()}
    assert by_day[START + dt.timedelta(days=3)] is None and by_day[START + dt.timedelta(days=4)] is not None
    reasons = outcomes.abnormal_returns(panel, panel.where("ticker = 'B'").drop("ticker", "source"), calendar.session_calendar(panel), seams.registry(spark, ()), (2, 30))
    n = {(r["horizon"], r["reason"]): r["count"] for r in reasons.groupBy("horizon", "reason").count().collect()}
    assert n[30, "beyond_calendar"] == 39 and n[2, "missing_price"] == 1 and sum(n.values()) == 78


def test_seam_masks(spark):
    panel = bars(spark, 30, ("A",))
    reg = seams.registry(spark, (("fnspid", None, "2020-01-11"),))
    rows = {r["date"]: r for r in outcomes.with_labels(seams.with_seam_distance(panel, reg), (3,), seams=reg).collect()}
    nulls = [i for i in range(27) if rows[START + dt.timedelta(days=i)]["fwd_ret_3d"] is None]
    assert nulls == [7, 8, 9]
    masked = seams.mask_features(seams.with_seam_distance(panel, reg).withColumn("ret_5d", F.lit(1.0)), {"ret_5d": 6})
    assert masked.where("ret_5d is null").count() == 5


def test_session_boundaries(spark):
    days = [dt.date(2023, 3, d) for d in (8, 9, 10, 13)]
    cal = calendar.session_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    cases = {"2023-03-08 14:29:00": days[0], "2023-03-08 14:30:00": days[1], "2023-03-10 20:00:00": days[3], "2023-03-11 12:00:00": days[3], "2023-03-13 14:00:00": None, "2023-02-01 00:00:00": days[0]}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("published_at", F.to_timestamp("t"))
    assert {r["t"]: r["trade_date"] for r in calendar.to_sessions(df, cal).collect()} == cases


def test_backtest_by_hand(spark):
    px = spark.createDataFrame([(START + dt.timedelta(days=i), "A", o, c) for i, (o, c) in enumerate([(10.0, 10.0), (10.0, 11.0), (12.0, 12.0), (12.0, 9.0)])], "date date, ticker string, open double, close double")
    pr = spark.createDataFrame([(START, "A", 0.9), (START + dt.timedelta(days=1), "A", None), (START + dt.timedelta(days=2), "A", 0.1)], "date date, ticker string, proba double")
    got = [(r["pos"], round(r["ret"], 6)) for r in backtest.positions(px, pr).orderBy("date").collect()]
    assert got == [(0, 0.0), (1, 0.1), (1, round(12 / 11 - 1, 6)), (0, 0.0)]
    perf = backtest.performance(spark.createDataFrame([(START, -0.5), (START + dt.timedelta(days=1), 0.5)], "date date, ret double")).first()
    assert perf["total_return"] == -0.25 and perf["max_drawdown"] == 0.0


def test_champions_keep_the_earliest_of_equals(spark):
    rows = [("a", 1, "c", 0.5, 1), ("b", 1, "c", 0.7, 2), ("c", 1, "c", 0.7, 3), ("d", 2, "c", None, 4)]
    got = registry.champions_of(spark.createDataFrame(rows, "run_id string, horizon int, objective string, metric double, created_at int")).collect()
    assert [(r["horizon"], r["run_id"]) for r in got] == [(1, "b")]
