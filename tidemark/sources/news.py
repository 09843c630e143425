"""News sources: the raw CSV archive, provider payloads and the article store."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import article_id, clean_ticker
from tidemark.operators.quality import keep_last
from tidemark.schemas import ARTICLES, RAW_NEWS

ARCHIVE_TIME = "yyyy-MM-dd HH:mm:ss 'UTC'"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of the CSV archive; quoted line breaks are part of a field, unread columns are pruned."""
    return spark.read.schema(RAW_NEWS).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def archive_articles(raw: DataFrame, tickers: Iterable[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Articles of the wanted tickers with a strictly parsed time and a headline, one for each id."""
    t = raw.select("Date", "Article_title", "Stock_symbol", "Url", "Publisher").withColumn("ticker", clean_ticker(F.col("Stock_symbol")))
    t = t.where(F.col("ticker").isin(*[x.strip().upper() for x in tickers]))
    t = t.withColumn("published_at", F.try_to_timestamp("Date", F.lit(ARCHIVE_TIME))).where("published_at is not null")
    t = t.withColumn("headline", F.trim("Article_title")).where(F.length("headline") > 0)
    if start:
        t = t.where(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end:
        t = t.where(F.col("published_at") <= F.lit(end).cast("timestamp"))
    out = t.select(article_id(F.col("Url"), F.col("headline"), F.col("ticker")).alias("article_id"), "headline", F.coalesce("Publisher", F.lit("unknown")).alias("source"), F.coalesce("Url", F.lit("")).alias("url"), "published_at", "ticker")
    return keep_last(out, ["article_id"], [F.col("published_at"), F.col("headline")])


def archive_accounting(raw: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """Rows read, in the universe, with a bad time, without a headline, and kept ids."""
    mine = clean_ticker(F.col("Stock_symbol")).isin(*[x.strip().upper() for x in tickers])
    mine = F.coalesce(mine, F.lit(False))
    time = F.try_to_timestamp("Date", F.lit(ARCHIVE_TIME))
    blank = F.coalesce(F.length(F.trim("Article_title")) == 0, F.lit(True))
    return raw.agg(F.count("*").alias("n_read"), F.count_if(mine).alias("n_universe"), F.count_if(mine & time.isNull()).alias("n_bad_time"), F.count_if(mine & time.isNotNull() & blank).alias("n_blank"))


def stored_articles(spark: SparkSession, folder: str, tickers: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = spark.read.schema(ARTICLES).parquet(folder)
    if tickers is not None:
        rows = rows.where(F.col("ticker").isin(*tickers))
    if start:
        rows = rows.where(F.col("published_at") >= F.lit(start).cast("timestamp"))
    return rows if end is None else rows.where(F.col("published_at") <= F.lit(end).cast("timestamp"))


def coverage(articles: DataFrame) -> DataFrame:
    return articles.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.countDistinct(F.to_date("published_at")).alias("n_days"))


FEED = "struct<feed: array<struct<title: string, url: string, time_published: string, source: string, ticker_sentiment: array<struct<ticker: string, relevance_score: string>>>>, Information: string, Note: string, `Error Message`: string>"


def feed_articles(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Articles of feed payloads (ticker, payload): Eastern times become UTC; each needs the ticker's own relevance."""
    p = payloads.select("ticker", F.from_json(column, FEED).alias("p")).select("ticker", F.explode("p.feed").alias("a"))
    own = F.try_element_at(F.filter("a.ticker_sentiment", lambda x: x["ticker"] == F.col("ticker")), F.lit(1))
    at = F.to_utc_timestamp(F.coalesce(F.try_to_timestamp("a.time_published", F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp("a.time_published", F.lit("yyyyMMdd'T'HHmm"))), "America/New_York")
    out = p.select(article_id(F.col("a.url"), F.col("a.title")).alias("article_id"), F.col("a.title").alias("headline"), F.coalesce("a.source", F.lit("unknown")).alias("source"), F.coalesce("a.url", F.lit("")).alias("url"), at.alias("published_at"), "ticker", own["relevance_score"].alias("_r"))
    return out.where("headline is not null and published_at is not null").withColumn("relevance", F.expr("try_cast(_r as double)")).drop("_r")


def feed_status(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """ticker, status, n_returned: a refusal (advisory text in a successful answer) is never zero rows."""
    p = payloads.select("ticker", F.from_json(column, FEED).alias("p"))
    note = F.lower(F.coalesce("p.Information", "p.Note", "p.`Error Message`", F.lit("")))
    status = F.when(note.contains("premium"), "premium_required").when(note.rlike("rate limit|requests per"), "rate_limited").when(F.length(note) > 0, "refused").when(F.col("p.feed").isNull(), "malformed").otherwise("ok")
    return p.select("ticker", status.alias("status"), F.coalesce(F.size("p.feed"), F.lit(0)).alias("n_returned"))


ENTITIES = "struct<meta: struct<found: bigint, returned: bigint, `limit`: bigint, page: bigint>, error: struct<code: string, message: string>, data: array<struct<uuid: string, title: string, url: string, published_at: string, source: string, entities: array<struct<symbol: string, match_score: double, sentiment_score: double>>>>>"
#: Error codes of the entity provider (fixed values).
ERROR_STATUS = {"invalid_api_token": "auth", "usage_limit_reached": "daily_quota", "rate_limit_reached": "minute_burst", "endpoint_access_restricted": "plan"}


def entity_articles(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Articles of entity payloads (ticker, payload): the entity must be the requested symbol."""
    p = payloads.select("ticker", F.from_json(column, ENTITIES).alias("p")).select("ticker", F.explode("p.data").alias("a"))
    own = F.try_element_at(F.filter("a.entities", lambda x: F.upper(x["symbol"]) == F.upper(F.col("ticker"))), F.lit(1))
    at = F.try_to_timestamp("a.published_at")
    out = p.select(article_id(F.col("a.url"), F.col("a.title")).alias("article_id"), F.col("a.title").alias("headline"), F.coalesce("a.source", F.lit("unknown")).alias("source"), F.coalesce("a.url", F.lit("")).alias("url"), at.alias("published_at"), "ticker", own["match_score"].alias("match_score"), own["sentiment_score"].alias("provider_sentiment"), own.isNotNull().alias("_own"))
    return out.where("_own and headline is not null and published_at is not null").drop("_own")


def entity_status(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """ticker, status, found, returned, withheld, truncated of each answer."""
    p = payloads.select("ticker", F.from_json(column, ENTITIES).alias("p"))
    status = F.lit("other")
    for code, name in ERROR_STATUS.items():
        status = F.when(F.col("p.error.code") == code, name).otherwise(status)
    status = F.when(F.col("p.error.code").isNotNull(), status).when(F.col("p.data").isNull(), "malformed").otherwise("ok")
    found, got = F.coalesce("p.meta.found", F.lit(0)), F.coalesce("p.meta.returned", F.lit(0))
    return p.select("ticker", status.alias("status"), found.alias("found"), got.alias("returned"), F.greatest(found - got, F.lit(0)).alias("withheld"), (found > got).alias("truncated"))


def first_time(*columns: str) -> Column:
    """The first of several publication fields that parses (text, or epoch seconds)."""
    return F.coalesce(*[F.coalesce(F.try_to_timestamp(F.col(c).cast("string")), F.timestamp_seconds(F.expr(f"try_cast({c} as double)"))) for c in columns])
