"""Articles as a stream: ids once within a watermark, placed into sessions, collapsed in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import headline_category, lexicon_score
from tidemark.operators.calendar import to_sessions
from tidemark.operators.current import collapse
from tidemark.schemas import ARTICLES


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ARTICLES).parquet(folder)


def prepared(articles: DataFrame, delay: str = "2 days") -> DataFrame:
    """Late repeats of an id are dropped; category and lexicon score are added."""
    once = articles.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["article_id"])
    return once.withColumn("category", headline_category(F.col("headline"))).withColumn("score", lexicon_score(F.col("headline")))


def collapse_stream(articles: DataFrame, calendar: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what is there, micro-batch by micro-batch: each batch's articles are placed, collapsed and given to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        placed = to_sessions(rows, calendar).withColumn("session_status", F.when(F.col("trade_date").isNull(), "beyond_price_panel").otherwise("in_panel"))
        sink(collapse(placed), number)

    return prepared(articles).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
