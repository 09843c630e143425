"""Current articles: collapse to events, attach historical evidence, compare classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import OUTCOME_HORIZONS


def collapse(articles: DataFrame, keys: Sequence[str] = ("ticker", "trade_date", "category"), headlines: int = 3) -> DataFrame:
    """One row an event: articles, mean sentiment, status of the earliest, first and last publication, first headlines.

    Articles are ordered by publication, then id. Only the first ``headlines`` articles of an event
    are collected; the others are counted and summed as they come by.
    """
    first = F.struct("published_at", "article_id")
    head = F.struct("published_at", "article_id", "headline")
    order = Window.partitionBy(*keys).orderBy("published_at", "article_id")
    ranked = articles.withColumn("_n", F.row_number().over(order)).groupBy(*keys).agg(
        F.count("*").alias("n_articles"),
        F.avg("score").alias("mean_sentiment"),
        F.min_by("session_status", first).alias("session_status"),
        F.min("published_at").alias("first_published"),
        F.max("published_at").alias("last_published"),
        F.sort_array(F.collect_list(F.when(F.col("_n") <= headlines, head))).alias("_head"),
    )
    return ranked.withColumn("headlines", F.array_join(F.transform("_head", lambda x: x["headline"]), " | ")).drop("_head")


def evidence_status(tier: Column, flag: Column) -> Column:
    """no_history, insufficient, exploratory, supported_no_comparison, significant or not_significant.

    A missing flag is not false: it means that no comparison was possible.
    """
    return (
        F.when(tier.isNull(), "no_history")
        .when(tier == "insufficient", "insufficient_history")
        .when(tier == "exploratory", "exploratory_only")
        .when(flag.isNull(), "supported_no_comparison")
        .when(flag, "supported_significant")
        .otherwise("supported_not_significant")
    )


def with_evidence(events: DataFrame, summary: DataFrame, versus: DataFrame, horizons: Sequence[int] = OUTCOME_HORIZONS) -> DataFrame:
    """Every event at every horizon with what history says of (ticker, category, horizon)."""
    key = ["ticker", "category", "horizon"]
    at = events.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    history = summary.select(*key, "evidence_tier", "mean_abnormal_return", "shrunk_mean", "n_events_valid")
    tests = versus.select(*key, "diff_mean", F.when(F.col("p_value").isNotNull(), F.col("significant_fdr")).alias("significant_fdr"))
    out = at.join(history, key, "left").join(tests, key, "left")
    status = evidence_status(F.col("evidence_tier"), F.col("significant_fdr"))
    return out.withColumn("evidence_status", status).withColumn("evidence_is_actionable", F.col("evidence_status") == "supported_significant")


def agreement(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per category: labelled, predicted and agreeing rows, recall and precision (4 places), and the overall agreement."""
    pairs = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    real = pairs.groupBy(F.col("a").alias("category")).agg(F.sum("n").alias("n_actual"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("n_agree"))
    said = pairs.groupBy(F.col("p").alias("category")).agg(F.sum("n").alias("n_predicted"))
    total = pairs.agg((F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("_all"))
    out = real.join(said, "category", "full").na.fill(0, ["n_actual", "n_agree", "n_predicted"]).join(F.broadcast(total))
    four = lambda c: F.round(c, 4)
    return out.select("category", "n_actual", "n_predicted", "n_agree", four(F.try_divide("n_agree", "n_actual")).alias("recall"), four(F.try_divide("n_agree", "n_predicted")).alias("precision"), four(F.col("_all")).alias("overall"))


def provider_limits(status: DataFrame) -> DataFrame:
    """Totals of what providers found, returned and withheld, and whether any was capped."""
    return status.agg(F.sum("found").alias("found"), F.sum("returned").alias("returned"), F.sum("withheld").alias("withheld"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("any_truncated"))
