"""Runs that chain operators: training over horizons and models, the backtest report, current news."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import COST_BPS, ENTRY, EXIT, LABEL_HORIZONS, OUTCOME_HORIZONS
from tidemark.functions.text import headline_category
from tidemark.operators import backtest, current, indicators, learning, scoring
from tidemark.operators.calendar import business_day, to_sessions
from tidemark.plans.reports import write_phase
from tidemark.sources import registry


# --- training ------------------------------------------------------------------------------


def train_runs(spark: SparkSession, matrix: Callable[[int], DataFrame], horizons: Sequence[int], models: Sequence[str], runs: str, artifacts: str, known: Sequence[int] = LABEL_HORIZONS) -> list[dict[str, Any]]:
    """Trains each model at each horizon on ``matrix(horizon)`` (usable rows only are taken) and records the runs.

    Predictions are written as predictions_<run>.parquet, the metrics of each fold, their mean and the
    test block go into the run; ``metric`` of a run is its test ROC-AUC. Each entry says whether
    the run is the champion of its horizon now. An unknown horizon is an error before anything is trained.
    """
    if unknown := sorted(set(horizons) - set(known)):
        raise ValueError(f"no labels of horizons {unknown}")
    report = []
    for horizon in horizons:
        usable = matrix(horizon).where("exclusion is null").persist()
        try:
            for name in models:
                predictions, metrics = learning.train(usable, name, horizon)
                predictions = predictions.persist()  # the fits run once for metrics and file
                rows = {r["split"]: r.asDict() for r in metrics.collect()}  # folds and test
                folds = learning.fold_summary(metrics.where("split <> 'test'")).first().asDict()
                period = predictions.groupBy("split").agg(F.min("date").alias("first"), F.max("date").alias("last")).collect()
                payload = {"splits": rows, "folds": folds, "periods": {r["split"]: [str(r["first"]), str(r["last"])] for r in period}}
                metric = rows["test"]["roc_auc"]
                run_id = registry.record(spark, runs, name, "classification", horizon, metric, payload)
                predictions.write.parquet(f"{artifacts}/predictions_{run_id}.parquet")
                predictions.unpersist()
                best = registry.champion(registry.read_runs(spark, runs), horizon, "classification").first()
                report.append({"run_id": run_id, "model": name, "horizon": horizon, "test_roc_auc": metric, "champion": best is not None and best["run_id"] == run_id})
        finally:
            usable.unpersist()
    return report


# --- backtest ------------------------------------------------------------------------------


def backtest_report(prices: DataFrame, predictions: DataFrame, entry: float = ENTRY, exit_: float = EXIT, cost_bps: float = COST_BPS) -> DataFrame:
    """Performance of the model's signals, of holding all tickers and of the moving-average rule over the test period.

    Columns are ``strategy`` and those of ``performance``. Predictions may have ``horizon`` and
    ``split``; a horizon other than one day is refused, and only the test split counts.
    """
    if "horizon" in predictions.columns and not predictions.where(~F.col("horizon").eqNullSafe(1)).isEmpty():
        raise ValueError("the backtest takes one-day predictions only")
    test = predictions.where("split = 'test'") if "split" in predictions.columns else predictions
    first, last = test.agg(F.min("date"), F.max("date")).first()
    if first is None:
        raise ValueError("no test predictions")
    in_period = lambda df: df.where(F.col("date").between(F.lit(first), F.lit(last)))
    rule = in_period(indicators.sma_signal(prices)).select("ticker", "date", F.col("signal").alias("proba"))
    curves = {
        "model": backtest.equity(backtest.positions(prices, test, entry, exit_), cost_bps),
        "buy_hold": in_period(backtest.buy_and_hold(prices)),
        "sma_rule": backtest.equity(backtest.positions(prices, rule, 0.5, 0.5), cost_bps),
    }
    out = None
    for name, curve in curves.items():
        part = backtest.performance(curve.select("date", "ret")).select(F.lit(name).alias("strategy"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# --- current news --------------------------------------------------------------------------


def current_articles(articles: DataFrame, calendar: DataFrame, cache: DataFrame, scorer: str = "lexicon") -> tuple[DataFrame, DataFrame]:
    """(articles with score, label, headline category, session and session_status, new score cache).

    An article after the calendar's end belongs to the next business day.
    """
    name, score = scoring.scorer(scorer)
    scored, cache = scoring.score_articles(articles, cache, score, name)
    placed = to_sessions(scored.withColumn("category", headline_category(F.col("headline"))), calendar)
    status = F.when(F.col("trade_date").isNull(), "after_panel").otherwise("in_panel")
    return placed.withColumns({"session_status": status, "trade_date": F.coalesce("trade_date", business_day(F.col("_day")))}), cache


def current_news(articles: DataFrame, calendar: DataFrame, cache: DataFrame, summary: DataFrame, versus: DataFrame, scorer: str = "lexicon", horizons: Sequence[int] = OUTCOME_HORIZONS, since: Column | None = None) -> dict[str, DataFrame]:
    """articles (scored, placed), events (one a ticker, session and category), evidence (what history says of each at each horizon) and cache."""
    placed, cache = current_articles(articles, calendar, cache, scorer)
    if since is not None:
        placed = placed.where(F.col("trade_date") >= since)
    events = current.collapse(placed)
    return {"articles": placed, "events": events, "evidence": current.with_evidence(events, summary, versus, horizons), "cache": cache}


def save_current_news(folder: str, news: dict[str, DataFrame], status: DataFrame) -> dict[str, Any]:
    """Writes the tables of ``current_news`` and a record of the run, which it returns.

    Without articles no table is written and those of an earlier run are removed, so that a reader can't take
    them for this one's; the record then says what the providers answered.
    """
    limits = current.provider_limits(status).first().asDict()
    empty = news["articles"].isEmpty()
    tables = {k: news[k].where(F.lit(not empty)) for k in ("articles", "events", "evidence")}
    record = {"empty": empty, "providers": limits, "answers": [r.asDict() for r in status.limit(1000).collect()]}
    write_phase(folder, "current_news", tables, record)
    return record
