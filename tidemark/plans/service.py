"""What a price service and a dashboard ask for, as DataFrames; a LookupError where there is nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.panel import in_dates
from tidemark.sources.registry import last_runs


def tickers(bars: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct().orderBy("ticker")


def prices(bars: DataFrame, ticker: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a ticker (any case) between inclusive dates, by date; dates are texts."""
    mine = in_dates(bars.where(F.col("ticker") == ticker.upper()), start, end)
    return mine.withColumn("date", F.date_format("date", "yyyy-MM-dd")).orderBy("date")


def sentiment(daily: DataFrame, ticker: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily sentiment of a ticker, by session."""
    mine = daily.where(F.col("ticker") == ticker.upper())
    if mine.isEmpty():
        raise LookupError(f"no sentiment for {ticker}")
    return in_dates(mine, start, end, "trade_date").withColumn("trade_date", F.date_format("trade_date", "yyyy-MM-dd")).orderBy("trade_date")


def models(runs: DataFrame) -> DataFrame:
    """The last 50 runs, newest first."""
    if runs.isEmpty():
        raise LookupError("no runs recorded")
    return last_runs(runs, 50)


def predictions(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    try:
        found = spark.read.parquet(f"{folder}/predictions_{run_id}.parquet")
    except Exception as error:  # only an absent path is not found
        if "PATH_NOT_FOUND" in str(error):
            raise LookupError(f"no predictions of run {run_id}") from error
        raise
    return found.withColumn("date", F.date_format("date", "yyyy-MM-dd")).orderBy("date", "ticker")
