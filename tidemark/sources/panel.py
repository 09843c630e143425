"""The curated panel store, the benchmark cache and the sector dimension."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import PANEL


def _absent(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def save_bars(bars: DataFrame, folder: str, source: str) -> None:
    """Writes bars, stamped with their source, replacing only the tickers that ``bars`` has."""
    out = bars.withColumn("source", F.lit(source)).select(*PANEL.fieldNames())
    out.repartition("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(folder)


def load_bars(spark: SparkSession, folder: str, tickers: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a folder; tickers prune directories, inclusive dates are pushed down. An absent folder is an empty panel."""
    try:
        bars = spark.read.schema(PANEL).parquet(folder).select(*PANEL.fieldNames())
    except Exception as error:
        if not _absent(error):
            raise
        bars = spark.createDataFrame([], PANEL)
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(*[t.strip().upper() for t in tickers]))
    return in_dates(bars, start, end)


def in_dates(rows: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    if start is not None:
        rows = rows.where(F.col(column) >= F.lit(start).cast("date"))
    return rows if end is None else rows.where(F.col(column) <= F.lit(end).cast("date"))


def spans(benchmark: DataFrame, panel: DataFrame) -> bool:
    """Whether the benchmark covers the panel's dates from first to last."""
    b, p = (x.agg(F.min("date"), F.max("date")).first() for x in (benchmark, panel))
    return p[0] is None or (b[0] is not None and b[0] <= p[0] and b[1] >= p[1])


def require_span(benchmark: DataFrame, panel: DataFrame) -> DataFrame:
    """The benchmark, or an error if it covers the panel only in part."""
    if not spans(benchmark, panel):
        raise ValueError("the benchmark series does not span the panel's dates")
    return benchmark


def sector_map(spark: SparkSession, path: str) -> DataFrame:
    """ticker, sector of a JSON file that has them as a map ``ticker_sector``."""
    got = spark.read.schema("ticker_sector map<string,string>").option("multiLine", "true").json(path)
    return got.select(F.explode("ticker_sector").alias("ticker", "sector"))


def last_change(bars: DataFrame) -> DataFrame:
    """ticker, date, close, change of the last bar against the one before it (a dashboard figure)."""
    two = bars.groupBy("ticker").agg(F.slice(F.sort_array(F.collect_list(F.struct("date", "close")), asc=False), 1, 2).alias("x"))  # one ticker's days
    x: Column = F.col("x")
    return two.select("ticker", x[0]["date"].alias("date"), x[0]["close"].alias("close"), (F.try_divide(x[0]["close"], F.try_element_at(x, F.lit(2))["close"]) - 1).alias("change"))
