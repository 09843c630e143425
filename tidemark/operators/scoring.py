"""Batch scoring of texts: duplicates once, known texts from a cache, scores joined back."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import lexicon_score, text_key

Scorer = Callable[[DataFrame], DataFrame]
CACHE_COLUMNS = ["text_key", "positive", "negative", "neutral", "label", "score"]


def lexicon_scores(texts: DataFrame) -> DataFrame:
    """text_key, positive, negative, neutral, label, score of ``texts`` (text_key, headline) by the word lists."""
    s = texts.withColumn("score", lexicon_score(F.col("headline")))
    parts = {"positive": F.greatest("score", F.lit(0.0)), "negative": F.greatest(-F.col("score"), F.lit(0.0))}
    s = s.withColumns(parts).withColumn("neutral", 1 - F.col("positive") - F.col("negative"))
    return s.withColumn("label", label_of()).select(*CACHE_COLUMNS)


def label_of() -> Column:
    """The most probable of positive, negative, neutral; ties in this order."""
    top = F.greatest("positive", "negative", "neutral")
    return F.when(F.col("positive") == top, "positive").when(F.col("negative") == top, "negative").otherwise("neutral")


def scorer(name: str) -> tuple[str, Scorer]:
    """The scorer of a name: lexicon; transformer (raises where it is not installed); auto takes what there is."""
    if name not in ("lexicon", "transformer", "auto"):
        raise ValueError(f"unknown scorer {name!r}")
    installed = importlib.util.find_spec("transformers") is not None and importlib.util.find_spec("torch") is not None
    if name == "transformer" and not installed:
        raise RuntimeError("the transformer scorer needs the transformers package")
    if name == "transformer" or (name == "auto" and installed):
        return "transformer", transformer_scores()
    return "lexicon", lexicon_scores


def transformer_scores(model: str = "ProsusAI/finbert", cut: int = 512) -> Scorer:
    """A scorer that runs a three-class model over Arrow batches, one pipeline per Python worker."""
    import pandas as pd

    def score(texts: DataFrame) -> DataFrame:
        @F.pandas_udf("positive double, negative double, neutral double")
        def run(batches: "pd.Series") -> pd.DataFrame:
            from transformers import pipeline

            if not hasattr(run, "_pipe"):
                run._pipe = pipeline("text-classification", model=model, top_k=None)
            out = run._pipe([(t or "")[:cut] for t in batches], batch_size=32, truncation=True, max_length=64)
            return pd.DataFrame([{p["label"].lower(): p["score"] for p in o} for o in out])[["positive", "negative", "neutral"]]

        s = texts.withColumn("_p", run("headline")).select("text_key", "_p.*").withColumn("score", F.col("positive") - F.col("negative"))
        return s.withColumn("label", label_of()).select(*CACHE_COLUMNS)

    return score


def score_articles(articles: DataFrame, cache: DataFrame, score: Scorer, model: str) -> tuple[DataFrame, DataFrame]:
    """(articles with their scores, new cache). Each distinct text is scored once, and only if the cache lacks it."""
    keyed = articles.withColumn("text_key", text_key(F.col("headline"), model))
    unique = keyed.groupBy("text_key").agg(F.min("headline").alias("headline"))
    fresh = score(unique.join(cache.select("text_key"), "text_key", "left_anti"))
    full = cache.select(*CACHE_COLUMNS).unionByName(fresh).dropDuplicates(["text_key"])
    return keyed.join(full, "text_key", "left"), full


def unscored(scored: DataFrame) -> int:
    """Rows without a score; anything but 0 means that the join back lost a text."""
    return scored.where(F.col("score").isNull()).count()
