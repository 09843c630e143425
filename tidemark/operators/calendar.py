"""The session calendar and the mapping of publication times to sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
OPEN_MINUTE = 9 * 60 + 30


def session_calendar(panel: DataFrame) -> DataFrame:
    """date, pos: the distinct panel dates with their position (0 first).

    The un-partitioned window is over trading days only, some 250 a year, whatever the panel's size.
    """
    return panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def market_day(published_at: Column) -> Column:
    """Day on which a publication can first be traded: New York date before the open, the next from 09:30 on."""
    local = F.from_utc_timestamp(published_at, MARKET_ZONE)
    late = F.hour(local) * 60 + F.minute(local) >= OPEN_MINUTE
    return F.date_add(F.to_date(local), late.cast("int"))


def business_day(day: Column) -> Column:
    """``day`` or, at a weekend, the Monday after it."""
    return F.date_add(day, F.greatest(F.lit(0), 7 - F.weekday(day)) * (F.weekday(day) >= 5).cast("int"))


def next_sessions(calendar: DataFrame) -> DataFrame:
    """day, session: for each calendar day up to the last session, the first session on or after it.

    Filling this small table turns the as-of join into an equality join.
    """
    span = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence(F.date_sub("lo", 10), "hi")).alias("day"))
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    joined = days.join(calendar.select(F.col("date").alias("open_day")), F.col("day") == F.col("open_day"), "left")
    return joined.select("day", F.first("open_day", ignorenulls=True).over(ahead).alias("session"))


def to_sessions(articles: DataFrame, calendar: DataFrame, name: str = "trade_date") -> DataFrame:
    """``articles`` with the first session in which each could be acted on; null outside the calendar.

    Days long before the calendar roll to its first session, as days within it do.
    """
    first = calendar.agg(F.min("date").alias("_first"))
    with_day = articles.withColumn("_day", market_day(F.col("published_at")))
    joined = with_day.join(F.broadcast(next_sessions(calendar)), F.col("_day") == F.col("day"), "left").join(F.broadcast(first))
    rolled = F.coalesce("session", F.when(F.col("_day") < F.col("_first"), F.col("_first")))
    return joined.withColumn(name, rolled).drop("day", "session", "_first")


def assign_trade_dates(articles: DataFrame, calendar: DataFrame) -> DataFrame:
    """As ``to_sessions``, with ``placement``: before_calendar, after_calendar or placed."""
    first = calendar.agg(F.min("date").alias("_lo"))
    out = to_sessions(articles, calendar).join(F.broadcast(first))
    placement = F.when(F.col("_day") < F.col("_lo"), "before_calendar").when(F.col("trade_date").isNull(), "after_calendar").otherwise("placed")
    return out.withColumn("placement", placement).drop("_lo")
