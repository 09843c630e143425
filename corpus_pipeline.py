"""A corpus pipeline of five stages; each works on all that its predecessor kept.

quality classifier -> MinHash near-dedup -> suffix-array dedup -> mixing -> SentencePiece ids.
``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's ``docs``. All but the last return
the columns of ``documents``; other columns of ``docs``, of any name, are left out. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, order_minhash, piece_transducer, quality_mil, suffix_dedup
from tidemark.llm._common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage of some fifty words; one that recurs is cut out.
PASSAGE_BYTES = 300


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, scores THRESHOLD or more; null and empty texts have a score too."""
    model = quality_mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_mil.with_score(docs.select(*COLUMNS), model, "_quality").where(F.col("_quality") >= quality_mil.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id; null and empty texts are one text, of repeated rows one stays."""
    return order_minhash.without_near_copies(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of recurring passages; every document stays, a null text too, with what is left of its text."""
    return suffix_dedup.without_repeats(docs.select(*COLUMNS), PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows with 0 copies go, rows with 2 come twice."""
    return mixing.take(docs.select(*COLUMNS)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with their number, hash and whether they decode to the text; a null text has none, like an empty one."""
    coded = piece_transducer.with_ids(docs.select("doc_id", "text", "lang", "source"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "n_fallback", "ids", "ids_sha256", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: None: the classifier, the mix and the encoding cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
