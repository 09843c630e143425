"""Seams: dates at which a price series changes its adjustment vintage, and what they make unusable."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import LOOKBACK, SEAMS

NEVER = 2**31 - 1


def registry(spark: SparkSession, seams: tuple[tuple[str, str | None, str], ...] = SEAMS) -> DataFrame:
    """source, ticker (null: all of the source), seam_date. A small fixed table."""
    rows = [(s.strip().lower(), t.strip().upper() if t else None, d) for s, t, d in seams]
    return spark.createDataFrame(rows, "source string, ticker string, seam string").select("source", "ticker", F.to_date("seam").alias("seam_date"))


def ticker_seams(bars: DataFrame, seams: DataFrame) -> DataFrame:
    """ticker, seam_pos: seams of each ticker as positions in its own rows, over all sources it has.

    A seam that is no session of the ticker moves to its next one; a seam at its first row, before
    it or after its end does not count.
    """
    pos = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    mine = bars.select("ticker", "date", F.lower("source").alias("_source")).withColumn("pos", pos)
    sources = mine.select("ticker", "_source").distinct()
    s = seams.select(F.col("source").alias("s_source"), F.col("ticker").alias("s_ticker"), "seam_date")
    wanted = sources.join(F.broadcast(s), (F.col("_source") == F.col("s_source")) & (F.col("s_ticker").isNull() | (F.upper("ticker") == F.col("s_ticker"))))
    wanted = wanted.select("ticker", "seam_date").distinct()
    at = mine.join(wanted, "ticker").where("date >= seam_date").groupBy("ticker", "seam_date").agg(F.min("pos").alias("seam_pos"))
    return at.where("seam_pos > 0").select("ticker", "seam_pos").distinct()


def with_seam_distance(bars: DataFrame, seams: DataFrame) -> DataFrame:
    """``bars`` with pos, sessions_since_seam (NEVER before any) and sessions_to_seam (NEVER after the last)."""
    spec = Window.partitionBy("ticker").orderBy("date")
    numbered = bars.withColumn("pos", F.row_number().over(spec) - 1)
    marks = ticker_seams(bars, seams).withColumnRenamed("ticker", "_t")
    marked = numbered.join(marks, (F.col("ticker") == F.col("_t")) & (F.col("pos") == F.col("seam_pos")), "left").drop("_t")
    back = F.last("seam_pos", ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("seam_pos", ignorenulls=True).over(spec.rowsBetween(1, Window.unboundedFollowing))
    out = marked.withColumn("sessions_since_seam", F.coalesce(F.col("pos") - back, F.lit(NEVER))).withColumn("sessions_to_seam", F.coalesce(ahead - F.col("pos"), F.lit(NEVER)))
    return out.drop("seam_pos")


def backward_masked(lookback: int) -> Column:
    """Whether a value that looks back ``lookback`` rows (itself included) spans a seam."""
    return F.lit(False) if lookback < 2 else F.col("sessions_since_seam") <= lookback - 2


def forward_masked(horizon: int) -> Column:
    """Whether a return over the next ``horizon`` rows spans a seam."""
    return F.col("sessions_to_seam") <= horizon


def mask_features(features: DataFrame, lookback: Mapping[str, int] = LOOKBACK) -> DataFrame:
    """Null for each listed column where its window spans a seam; needs ``with_seam_distance``."""
    return features.withColumns({c: F.when(~backward_masked(n), F.col(c)) for c, n in lookback.items() if c in features.columns})
