"""From articles to events and daily sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import ENTITY_START

LABELS = ("positive", "negative", "neutral")


def entity_registry(spark: SparkSession, starts: tuple[tuple[str, str], ...] = ENTITY_START) -> DataFrame:
    return spark.createDataFrame(list(starts), "ticker string, start string").select("ticker", F.to_date("start").alias("entity_start"))


def of_current_entity(articles: DataFrame, starts: DataFrame, day: str = "trade_date") -> DataFrame:
    """Drops articles dated before the entity that now has the ticker; its first day and others' days stay."""
    return articles.join(F.broadcast(starts), "ticker", "left").where(F.coalesce(F.col(day) >= F.col("entity_start"), F.lit(True))).drop("entity_start")


def event_table(articles: DataFrame) -> DataFrame:
    """ticker, date, category, n_articles: one row for each ticker, session and category."""
    placed = articles.where("trade_date is not null")
    return placed.groupBy("ticker", F.col("trade_date").alias("date"), "category").agg(F.count("*").alias("n_articles"))


def with_outcomes(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events with their long outcomes; ``matched`` is false (and horizon null) where there is no bar."""
    right = outcomes.withColumn("matched", F.lit(True))
    return events.join(right, ["ticker", "date"], "left").withColumn("matched", F.coalesce("matched", F.lit(False))).withColumn("valid", F.coalesce("valid", F.lit(False)))


def with_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(sectors), "ticker", "left")  # one row a ticker


def unknown_labels(articles: DataFrame) -> DataFrame:
    return articles.where(~F.col("label").isin(*LABELS) | F.col("label").isNull())


def daily_label_sentiment(articles: DataFrame) -> DataFrame:
    """ticker, trade_date, mean_sentiment, the three label shares, article_count. Raises on unknown labels."""
    if not unknown_labels(articles).isEmpty():
        raise ValueError("articles carry labels other than positive, negative, neutral")
    share = {f"{k}_ratio": F.avg((F.col("label") == k).cast("double")) for k in LABELS}
    return articles.groupBy("ticker", "trade_date").agg(F.avg("score").alias("mean_sentiment"), *[v.alias(k) for k, v in share.items()], F.count("*").alias("article_count"))


def daily_sign_sentiment(articles: DataFrame) -> DataFrame:
    """ticker, trade_date, n_articles, sent_mean, sent_pos_share, sent_neg_share, sent_dispersion (0 for one article)."""
    return articles.groupBy("ticker", "trade_date").agg(
        F.count("*").alias("n_articles"),
        F.avg("score").alias("sent_mean"),
        F.avg((F.col("score") > 0).cast("double")).alias("sent_pos_share"),
        F.avg((F.col("score") < 0).cast("double")).alias("sent_neg_share"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sent_dispersion"),
    )
