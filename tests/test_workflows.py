"""Chained runs, the service functions and settings."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import learning
from tidemark.plans import reports, service, workflows
from tidemark.sources import registry


def test_settings(spark, tmp_path):
    made = config.Settings(tickers=(" aa", "B "), start="2020-01-01", horizons=(5, 1))
    assert made.tickers == ("AA", "B") and made.horizons == (1, 5)
    for bad in ({"tickers": ("a", "A")}, {"tickers": (" ",)}, {"horizons": ()}, {"horizons": (0,)}, {"horizons": (1, 1)}, {"objective": "x"}):
        with pytest.raises(ValueError):
            config.Settings(**{"tickers": ("a",), "start": "2020-01-01"} | bad)
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"tickers": ["x"], "start": "2021-01-01", "horizons": [21], "colour": 1}, indent=1))
    got = config.settings_from(spark, str(path))
    assert got.tickers == ("X",) and got.horizons == (21,) and got.extra == {"colour": 1}
    assert config.universe_from(spark, str(path)) == ("X",)


@pytest.fixture
def prices(spark):
    rows = [(t, f"2020-01-{d:02d}", 10.0 + d, 10.5 + d) for t in ("A", "B") for d in range(1, 11)]
    return spark.createDataFrame(rows, "ticker string, d string, open double, close double").withColumn("date", F.to_date("d")).drop("d")


def test_backtest_report(prices):
    signals = prices.where("date >= '2020-01-04'").select("ticker", "date", F.lit(0.9).alias("proba"), F.lit(1).alias("horizon"), F.when(F.col("date") >= "2020-01-06", "test").otherwise("1").alias("split"))
    got = {r["strategy"]: r for r in workflows.backtest_report(prices, signals).collect()}
    assert set(got) == {"model", "buy_hold", "sma_rule"} and got["model"]["n_days"] == 5 and got["buy_hold"]["n_days"] == 5
    assert got["sma_rule"]["total_return"] == 0 and got["buy_hold"]["total_return"] == pytest.approx(20.5 / 15.5 - 1)
    with pytest.raises(ValueError):
        workflows.backtest_report(prices, signals.withColumn("horizon", F.lit(5)))
    with pytest.raises(ValueError):
        workflows.backtest_report(prices, signals.withColumn("split", F.lit("1")))


def test_train_runs(spark, tmp_path, monkeypatch):
    def quick(matrix, name, horizon):
        rows = matrix.select("date", "ticker", F.lit(horizon).alias("horizon"), F.col("p").alias("proba"), "label", F.col("part").alias("split"))
        rows = rows.withColumn("proba", 1 - F.col("proba")) if name == "worse" else rows
        return rows, learning.classification_metrics(rows, ["split"]).withColumn("majority_proba", F.lit(0.5))

    monkeypatch.setattr(learning, "train", quick)
    rows = [(f"2020-01-{i + 1:02d}", "A", i / 20, float(i > 9), s, None) for i in range(20) for s in ("1", "2", "test")]
    matrix = spark.createDataFrame(rows, "date string, ticker string, p double, label double, part string, exclusion string")
    runs, made = str(tmp_path / "runs"), str(tmp_path / "made")
    got = workflows.train_runs(spark, lambda h: matrix, [1], ["worse", "better", "worse"], runs, made)
    assert [(r["model"], r["champion"]) for r in got] == [("worse", True), ("better", True), ("worse", False)]
    stored = {r["run_id"]: r for r in registry.read_runs(spark, runs).collect()}
    body = json.loads(stored[got[1]["run_id"]]["payload"])
    assert len(stored) == 3 and set(body["splits"]) == {"1", "2", "test"} and body["periods"]["1"] == ["2020-01-01", "2020-01-20"] and body["folds"]["roc_auc_mean"] == 1
    assert service.predictions(spark, made, got[0]["run_id"]).count() == 60 and service.models(registry.read_runs(spark, runs)).count() == 3
    with pytest.raises(LookupError):
        service.predictions(spark, made, "none")
    with pytest.raises(ValueError):
        workflows.train_runs(spark, lambda h: matrix, [3], ["better"], runs, made)


def test_current_news_without_articles_removes_what_an_earlier_run_wrote(spark, tmp_path):
    calendar = spark.createDataFrame([("2020-01-02", 0), ("2020-01-03", 1)], "d string, pos int").select(F.to_date("d").alias("date"), "pos")
    articles = spark.createDataFrame([("1", "A", "Acme beats estimates", "2020-01-02 12:00:00"), ("2", "A", "Firm beats estimates", "2020-01-02 13:00:00"), ("3", "A", "x", "2020-01-04 12:00:00")], "article_id string, ticker string, headline string, t string").withColumn("published_at", F.to_timestamp("t")).drop("t")
    cache = spark.createDataFrame([], "text_key string, positive double, negative double, neutral double, label string, score double")
    summary = spark.createDataFrame([], "ticker string, category string, horizon int, evidence_tier string, mean_abnormal_return double, shrunk_mean double, n_events_valid long")
    versus = spark.createDataFrame([], "ticker string, category string, horizon int, diff_mean double, p_value double, significant_fdr boolean")
    status = spark.createDataFrame([("A", 3, 3, 0, False)], "ticker string, found int, returned int, withheld int, truncated boolean")
    run = lambda some: workflows.current_news(some, calendar, cache, summary, versus, horizons=(1, 5))
    news = run(articles)
    events = {str(r["trade_date"]): r for r in news["events"].collect()}
    assert events["2020-01-02"]["n_articles"] == 2 and events["2020-01-06"]["session_status"] == "after_panel"
    assert {r["evidence_status"] for r in news["evidence"].collect()} == {"no_history"} and news["evidence"].count() == 4
    folder = str(tmp_path)
    assert not workflows.save_current_news(folder, news, status)["empty"] and spark.read.parquet(f"{folder}/current_news_events_v1.parquet").count() == 2
    record = workflows.save_current_news(folder, run(articles.where("false")), status)
    assert record["empty"] and record["providers"]["found"] == 3 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["current_news_v1.json"]


def test_service(spark, prices):
    assert [r[0] for r in service.tickers(prices).collect()] == ["A", "B"]
    got = service.prices(prices, "a", "2020-01-03", "2020-01-04").collect()
    assert [r["date"] for r in got] == ["2020-01-03", "2020-01-04"]
    with pytest.raises(LookupError):
        service.sentiment(prices.withColumnRenamed("date", "trade_date"), "none")
    assert reports.in_order(prices.repartition(3)).first()["ticker"] == "A"
