"""The corpus pipeline: each stage on nulls, empty and very long texts, repeats, an empty table and extra columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("tidemark.llm")

from tidemark.llm import order_minhash  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "ing", "ti", "sh", "ea"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(3)
    good = [prose(rng, rng.randint(80, 160)) for _ in range(80)]
    junk = [" ".join(f"{w}###$$" for w in prose(rng, 60).split()) for _ in range(60)]
    passage = prose(rng, 70)
    texts = [*good, *junk, f"{prose(rng, 90)} {passage}", f"{passage} {prose(rng, 90)}", good[0], good[1] + " end", None, "", "one", prose(rng, 30_000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, good[3], None, None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 80), 0) for i in range(140)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def run(spark, sf, name, docs):
    out = STAGES[name](spark, docs.withColumns({"_u": F.lit(1), "key": F.lit("x"), "spans": F.lit(2.0), "shard": F.lit(3)}), sf)
    if name != "sentencepiece":
        assert out.columns == corpus_pipeline.COLUMNS
        assert [t for _, t in out.dtypes] == [t for _, t in docs.select(*corpus_pipeline.COLUMNS).dtypes]
    assert STAGES[name](spark, docs.where("false"), sf).count() == 0
    return out


def test_quality_stage_drops_junk_only(spark, sf, docs):
    kept = rows_of(run(spark, sf, "quality_classifier", docs))
    before = rows_of(docs)
    assert all(kept[k] == before[k] for k in kept)
    assert not any(80 <= (d if d is not None else 0) < 140 for d, _ in kept) and sum(d is not None and d < 80 for d, _ in kept) >= 78


def test_minhash_stage_keeps_one_of_each_group(spark, sf, docs):
    kept = rows_of(run(spark, sf, "minhash_near_dedup", docs))
    ids = Counter(d for d, _ in kept.elements())
    first = {r["class_id"] for r in order_minhash.classes(docs).collect()}
    assert set(ids) == first and set(ids.values()) == {1}
    assert 142 not in ids and 143 not in ids and None not in ids and ids[2] == 1 and 145 not in ids  # copies; null and empty are one text


def test_suffix_stage_cuts_shared_passages(spark, sf, docs):
    before, after = rows_of(docs), run(spark, sf, "suffix_array_dedup", docs)
    got = rows_of(after)
    assert got.total() == before.total()
    texts = {d: t for d, t in got if d is not None}
    whole = {d: t for d, t in before if d is not None}
    assert all(len(texts[d]) < len(whole[d]) - 250 for d in (140, 141, 0, 142)) and texts[144] is None and texts[145] == ""
    assert texts[147] == whole[147] and sum(texts[d] == whole[d] for d in range(4, 140)) == 136
    assert all(r["n_chars"] == len(r["text"]) for r in after.where("text is not null").collect())


def test_mixing_stage_takes_whole_documents(spark, sf, docs):
    before, got = rows_of(docs), rows_of(run(spark, sf, "source_mixing", docs))
    assert set(got) <= set(before) and all(got[k] <= 2 * before[k] for k in got)
    assert rows_of(STAGES["source_mixing"](spark, docs.repartition(2), sf)) == got


def test_encoding_stage_round_trips(spark, sf, docs):
    got = run(spark, sf, "sentencepiece", docs).collect()
    assert len(got) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_run_is_its_stages(spark, sf, docs):
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
    key = lambda df: Counter((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(now)
