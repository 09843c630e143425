import json
import zipfile

from pyspark.sql import functions as F

from tidemark.functions.text import headline_category, lexicon_score, text_key
from tidemark.operators.scoring import lexicon_scores, score_articles, unscored
from tidemark.plans import reports
from tidemark.sources import archive, news, panel
from tidemark.streaming.articles import collapse_stream, read_articles


def test_archive_csv(spark, tmp_path):
    head = "Date,Article_title,Stock_symbol,Url,Publisher,Author,Article,Lsa_summary,Luhn_summary,Textrank_summary,Lexrank_summary\n"
    body = '2020-01-02 10:00:00 UTC,"Big, ""quoted""\nline",aapl,u1,p,,,,,,\n2020-01-02 10:00:00 UTC,"Big, ""quoted""\nline",AAPL,u1,p,,,,,,\nbad,x,AAPL,u2,p,,,,,,\n2020-01-03 10:00:00 UTC, ,AAPL,u3,,,,,,,\n2020-01-03 10:00:00 UTC,y,ZZZ,u4,,,,,,,\n'
    (tmp_path / "n.csv").write_text(head + body)
    raw = news.read_archive(spark, str(tmp_path / "n.csv"))
    got = news.archive_articles(raw, ["AAPL"]).collect()
    assert len(got) == 1 and got[0]["headline"] == 'Big, "quoted"\nline' and len(got[0]["article_id"]) == 16
    acc = news.archive_accounting(raw, ["AAPL"]).first().asDict()
    assert acc == {"n_read": 5, "n_universe": 4, "n_bad_time": 1, "n_blank": 1}


def test_price_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("full_history/A.csv", "Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-03,10,11,9,10,5,7\n2020-01-02,4,4,4,0,4,x\n2020-01-03,20,22,18,20,10,8\n")
        z.writestr("__MACOSX/full_history/._A.csv", "junk")
    got = archive.archive_bars(archive.raw_rows(spark, str(tmp_path / "p.zip"))).orderBy("date").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in got] == [(4.0, 0.0, None), (10.0, 10.0, 8.0)]
    assert archive.raw_rows(spark, str(tmp_path / "p.zip"), ["B"]).count() == 0


def test_panel_store(spark, tmp_path):
    folder = str(tmp_path / "panel")
    assert panel.load_bars(spark, folder).count() == 0
    rows = spark.createDataFrame([("2020-01-02", "A", 1.0, 1.0, 1.0, 1.0, 1.0), ("2020-01-03", "B", 2.0, 2.0, 2.0, 2.0, 2.0)], "d string, ticker string, open double, high double, low double, close double, volume double").withColumn("date", F.to_date("d")).drop("d")
    panel.save_bars(rows, folder, "live")
    panel.save_bars(rows.where("ticker = 'B'").withColumn("close", F.lit(3.0)), folder, "live")
    got = {r["ticker"]: r["close"] for r in panel.load_bars(spark, folder).collect()}
    assert got == {"A": 1.0, "B": 3.0}
    assert panel.load_bars(spark, folder, ["b"], "2020-01-03", "2020-01-03").count() == 1


def test_payloads(spark):
    feed = json.dumps({"feed": [{"title": "t", "url": "u", "time_published": "20230310T093000", "source": "s", "ticker_sentiment": [{"ticker": "A", "relevance_score": "0.5"}]}]})
    df = spark.createDataFrame([("A", feed), ("B", json.dumps({"Information": "rate limit reached"}))], "ticker string, payload string")
    row = news.feed_articles(df).first()
    assert str(row["published_at"]) == "2023-03-10 14:30:00" and row["relevance"] == 0.5
    assert {r["ticker"]: r["status"] for r in news.feed_status(df).collect()} == {"A": "ok", "B": "rate_limited"}
    body = json.dumps({"meta": {"found": 9, "returned": 3}, "data": [{"uuid": "1", "title": "t", "url": "u", "published_at": "2023-03-10T14:30:00.000000Z", "entities": [{"symbol": "a", "match_score": 2.0, "sentiment_score": 0.1}]}, {"title": "other", "published_at": "2023-03-10T14:30:00Z", "entities": []}]})
    df = spark.createDataFrame([("A", body), ("B", json.dumps({"error": {"code": "usage_limit_reached"}}))], "ticker string, payload string")
    assert news.entity_articles(df).count() == 1
    assert {r["ticker"]: (r["status"], r["withheld"]) for r in news.entity_status(df).collect()} == {"A": ("ok", 6), "B": ("daily_quota", 0)}


def test_text(spark):
    cases = {"Broker maintains outperform on Acme after earnings": "ANALYST_ACTION", "Q3 revenue beats": "EARNINGS_RESULTS", "GPC/SEC Solutions": "OTHER", "Firm outlook raised": "OTHER", "Chair ousted by board": "MANAGEMENT", "Acme to acquire Beta": "OTHER", "Acme acquires Beta": "M_AND_A"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "h string").select("h", headline_category(F.col("h"))).collect()}
    assert got["Broker maintains outperform on Acme after earnings"] == "ANALYST_ACTION" and got["GPC/SEC Solutions"] == "OTHER" and got["Acme acquires Beta"] == "M_AND_A" and got["Chair ousted by board"] == "MANAGEMENT"
    row = spark.createDataFrame([("Profit profit loss",), (None,)], "h string").select(lexicon_score(F.col("h")).alias("s"), text_key(F.col("h"), "m").alias("k")).collect()
    assert abs(row[0]["s"] - 1 / 3) < 1e-12 and row[1]["s"] == 0 and len(row[1]["k"]) == 20


def test_cached_scoring(spark):
    articles = spark.createDataFrame([(1, "a gain"), (2, "a  gain "), (3, "a loss"), (4, None)], "id int, headline string")
    empty = lexicon_scores(spark.createDataFrame([], "text_key string, headline string"))
    scored, cache = score_articles(articles, empty, lexicon_scores, "m")
    assert cache.count() == 3 and unscored(scored) == 0
    assert {r["id"]: r["score"] for r in scored.collect()} == {1: 1.0, 2: 1.0, 3: -1.0, 4: 0.0}
    again, _ = score_articles(articles, cache, lambda df: (_ for _ in ()).throw(AssertionError) if not df.isEmpty() else lexicon_scores(df), "m")
    assert again.count() == 4


def test_stream_drops_repeats(spark, tmp_path):
    rows = [("i1", "Acme gain", "s", "u", "2023-03-08 10:00:00", "A"), ("i1", "Acme gain", "s", "u", "2023-03-08 10:00:00", "A"), ("i2", "Acme loss", "s", "u", "2023-03-08 11:00:00", "A")]
    df = spark.createDataFrame(rows, "article_id string, headline string, source string, url string, t string, ticker string").withColumn("published_at", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    cal = spark.createDataFrame([(0, "2023-03-08")], "pos int, d string").select(F.to_date("d").alias("date"), "pos")
    got = []
    collapse_stream(read_articles(spark, str(tmp_path / "in")), cal, lambda d, n: got.extend(d.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert len(got) == 1 and got[0]["n_articles"] == 2 and got[0]["headlines"] == "Acme gain | Acme loss"


def test_report_helpers(spark):
    assert reports.percent(0.1234) == "12.34%" and reports.percent(None) == "n/a"
    assert reports.sparkline([0, None, 1]) == "▁ █"
    assert "| 1 |" in reports.markdown("T", spark.range(1, 2), ["id"])
