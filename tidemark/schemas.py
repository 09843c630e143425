"""Explicit schemas; sources are always read with one of these."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

PANEL = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
    + [T.StructField("source", T.StringType())]
)
ARTICLES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("article_id", "headline", "source", "url")]
    + [T.StructField("published_at", T.TimestampType()), T.StructField("ticker", T.StringType())]
)
RAW_NEWS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Date", "Article_title", "Stock_symbol", "Url", "Publisher", "Author", "Article", "Lsa_summary", "Luhn_summary", "Textrank_summary", "Lexrank_summary")]
)
RUNS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("run_id", "model", "objective")]
    + [T.StructField("horizon", T.IntegerType()), T.StructField("metric", T.DoubleType()), T.StructField("created_at", T.TimestampType()), T.StructField("payload", T.StringType())]
)

TARGET_PREFIXES = ("fwd_ret_", "label_up_")


def targets(columns: Iterable[str]) -> list[str]:
    """Columns that hold the future; they are never features."""
    return [c for c in columns if c.startswith(TARGET_PREFIXES)]


def outcome_columns(horizon: int) -> list[str]:
    return [f"stock_fwd_ret_{horizon}d", f"benchmark_fwd_ret_{horizon}d", f"abnormal_ret_{horizon}d", f"valid_{horizon}d"]


def feature_columns(schema: T.StructType, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns that are neither targets, metadata nor excluded (for example scale-dependent ones)."""
    gone = {"ticker", "date", "source", *exclude}
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in gone and not f.name.startswith(TARGET_PREFIXES)]
