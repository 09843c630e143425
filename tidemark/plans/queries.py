"""Every operator as a query over the driver's tables, with the same result in SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import CATEGORIES, HEADLINE_RULES, LOOKBACK, NEGATIVE, NEWS_FEATURES, OUTCOME_HORIZONS, POSITIVE
from tidemark.functions.maths import by, full, ratio
from tidemark.functions.text import article_id, headline_category, lexicon_score
from tidemark.operators import backtest, current, indicators, learning, news, outcomes, quality, rolling, scoring, seams, statistics, summaries
from tidemark.operators.calendar import assign_trade_dates, business_day, session_calendar, to_sessions
from tidemark.plans import bindings as b
from tidemark.plans import oracle as o
from tidemark.plans import service, workflows
from tidemark.session import cut
from tidemark.sources.news import coverage as article_coverage
from tidemark.sources.panel import last_change

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = o.sql(sql)
        return f

    return add


def nearest(c: str, digits: int = DIGITS) -> Column:
    """A double to so many places as the SQL engine rounds: the scaled double, halves away from zero (``round`` goes by the decimal digits)."""
    scaled = F.col(c) * float(10**digits)
    off = scaled - F.rint(scaled)
    whole = F.rint(scaled) + F.when((off == 0.5) & (scaled > 0), 1.0).when((off == -0.5) & (scaled < 0), -1.0).otherwise(0.0)
    return F.when(F.abs(scaled) < float("inf"), whole / float(10**digits)).otherwise(F.col(c))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many places: sums may be taken in any order."""
    return df.select(*[nearest(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) AS {name}"


def rs(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


OVER = "OVER (PARTITION BY ticker ORDER BY date)"


def frame(rows: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def gated(agg: str, col: str, rows: int) -> str:
    return f"(CASE WHEN count({col}) {frame(rows)} = {rows} THEN {agg}({col}) {frame(rows)} END)"


# --- bars ----------------------------------------------------------------------------------


@query(f"SELECT date, ticker, {rs('open', 'high', 'low', 'close', 'volume')}, source FROM panel")
def panel_bars(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(b.panel(spark, sf))


#: Damaged copies of the bars, to have something to repair (key parts are fixed values).
_DIRTY = """SELECT date, ticker, open, CASE WHEN (date - DATE '1995-01-01') % 97 = 0 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN (date - DATE '1995-01-01') % 89 = 0 THEN close * 30 WHEN (date - DATE '1995-01-01') % 83 = 0 THEN NULL ELSE close END AS close,
  CASE WHEN (date - DATE '1995-01-01') % 79 = 0 THEN 0 ELSE volume END AS volume, source, 0 AS ord FROM panel"""


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    n = F.datediff("date", F.lit("1995-01-01").cast("date"))
    bars = b.panel(spark, sf)
    bad = bars.withColumns({"high": F.when(n % 97 == 0, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(n % 89 == 0, F.col("close") * 30).when(n % 83 == 0, None).otherwise(F.col("close")), "volume": F.when(n % 79 == 0, 0.0).otherwise(F.col("volume")), "ord": F.lit(0)})
    return bad.unionByName(bars.where(n % 71 == 0).withColumn("ord", F.lit(1)))


_JUDGED = f"""(WITH d AS ({_DIRTY} UNION ALL SELECT date, ticker, open, high, low, close, volume, source, 1 AS ord FROM panel WHERE (date - DATE '1995-01-01') % 71 = 0),
  s AS (SELECT *, CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'missing_value'
    WHEN least(open, high, low, close) < 0.01 OR high < low OR high < greatest(open, close) OR low > least(open, close) OR volume <= 0 THEN 'invalid_bar' END AS r1 FROM d),
  w AS (SELECT *, CASE WHEN count(close) OVER x >= 11 THEN quantile_cont(close, 0.5) OVER x END AS med FROM s WHERE r1 IS NULL
    WINDOW x AS (PARTITION BY ticker ORDER BY date, ord ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
  v AS (SELECT *, CASE WHEN med > 0 AND (close / med > 10 OR close / med < 0.1) THEN 'implausible' END AS r2 FROM w),
  u AS (SELECT *, CASE WHEN r2 IS NULL AND row_number() OVER (PARTITION BY ticker, date, r2 IS NULL ORDER BY ord DESC) > 1 THEN 'duplicate_date' ELSE r2 END AS r3 FROM v)
  SELECT date, ticker, close, r1 AS drop_reason FROM s WHERE r1 IS NOT NULL UNION ALL SELECT date, ticker, close, r3 FROM u)"""


@query(f"SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM {_JUDGED} GROUP BY 1")
def validate_drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judged_bars(_dirty(spark, sf), "ord")
    return judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


@query(f"SELECT date, ticker, {rs('close')} FROM {_JUDGED} WHERE drop_reason = 'implausible'")
def implausible_bars(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.judged_bars(_dirty(spark, sf), "ord").where("drop_reason = 'implausible'").select("date", "ticker", "close"))


@query(f"""SELECT date, ticker, {', '.join(r(c + " * coalesce(CASE WHEN close > 0 THEN adj / close END, 1.0)", c) for c in ('open', 'high', 'low'))},
  {r("close * coalesce(CASE WHEN close > 0 THEN adj / close END, 1.0)", 'close')}, {rs('volume')}
  FROM (SELECT *, CASE WHEN date < DATE '1997-01-01' THEN close / 2 WHEN date < DATE '1998-01-01' THEN NULL ELSE close END AS adj FROM panel)""")
def adjust_prices(spark: SparkSession, sf: str) -> DataFrame:
    adj = F.when(F.col("date") < "1997-01-01", F.col("close") / 2).when(F.col("date") >= "1998-01-01", F.col("close"))
    return rounded(quality.adjusted(b.panel(spark, sf).withColumn("adj_close", adj)).select("date", "ticker", "open", "high", "low", "close", "volume"))


_STEP = "(SELECT date, ticker, source, volume, " + ", ".join(f"CASE WHEN date < DATE '{b.SEAM}' AND ticker < 'NATION_2' THEN {c} * 4 ELSE {c} END AS {c}" for c in ("open", "high", "low", "close")) + " FROM panel)"
_FACTOR = f"""(WITH p AS {_STEP}, a AS (SELECT ticker, arg_max(close, date) AS pc FROM p WHERE date < DATE '{b.SEAM}' GROUP BY ticker),
  n AS (SELECT *, row_number() {OVER} AS rn FROM p WHERE date >= DATE '{b.SEAM}'),
  s AS (SELECT ticker, arg_min(open, date) AS so, quantile_cont(close, 0.5) AS med, count(*) AS k FROM n WHERE rn <= 10 GROUP BY ticker)
  SELECT ticker, pc / so AS factor FROM a JOIN s USING (ticker) WHERE k >= 2 AND (pc / so >= 1.3 OR pc / so <= 1 / 1.3) AND abs(ln((pc / med) / (pc / so))) <= ln(1.25))"""


def _stepped(spark: SparkSession, sf: str) -> DataFrame:
    old = (F.col("date") < b.SEAM) & (F.col("ticker") < "NATION_2")
    return b.panel(spark, sf).withColumns({c: F.when(old, F.col(c) * 4).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})


@query(f"SELECT ticker, {rs('factor')} FROM {_FACTOR}")
def detect_seam(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.seam_factors(_stepped(spark, sf), b.SEAM))


@query(f"SELECT date, p.ticker, {', '.join(r(f'''CASE WHEN date < DATE '{b.SEAM}' AND factor IS NOT NULL THEN {c} / factor ELSE {c} END''', c) for c in ('open', 'high', 'low', 'close'))}, {rs('volume')} FROM {_STEP} p LEFT JOIN {_FACTOR} f ON f.ticker = p.ticker")
def repair_seam(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.without_seam(_stepped(spark, sf), b.SEAM).select("date", "ticker", "open", "high", "low", "close", "volume"))


@query(f"""SELECT ticker, max(gap) AS max_gap_days, count(*) FILTER (volume = 0) AS n_zero_volume, coalesce(max(gap) > 10, false) AS wide_gap
  FROM (SELECT *, (date - lag(date) {OVER})::INT AS gap FROM panel) GROUP BY ticker""")
def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gap_warnings(b.panel(spark, sf))


# --- windows -------------------------------------------------------------------------------


def _ind(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return rounded(b.panel(spark, sf).withColumns(columns).select("date", "ticker", *columns))


def _ret(k: int) -> str:
    return f"close / nullif(lag(close, {k}) {OVER}, 0) - 1"


@query(f"SELECT date, ticker, {r(_ret(1), 'ret_1d')}, {r(_ret(5), 'ret_5d')}, {r(_ret(21), 'ret_21d')} FROM panel")
def returns_multi(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, **{f"ret_{k}d": indicators.returns(k) for k in (1, 5, 21)})


@query(f"SELECT date, ticker, {r(gated('stddev_samp', 'ret_1d', 21), 'vol_21d')}, {r(gated('stddev_samp', 'ret_1d', 63), 'vol_63d')} FROM (SELECT *, {_ret(1)} AS ret_1d FROM panel)")
def volatility(spark: SparkSession, sf: str) -> DataFrame:
    bars = b.panel(spark, sf).withColumn("ret_1d", indicators.returns(1))
    return rounded(bars.select("date", "ticker", indicators.volatility(21).alias("vol_21d"), indicators.volatility(63).alias("vol_63d")))


@query(f"SELECT date, ticker, {r(gated('avg', 'close', 20), 'sma_20')}, {r(gated('avg', 'close', 50), 'sma_50')}, {r(gated('avg', 'close', 20) + ' / ' + gated('avg', 'close', 50) + ' - 1', 'sma_ratio_20_50')} FROM panel")
def sma_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, sma_20=indicators.sma(20), sma_50=indicators.sma(50), sma_ratio_20_50=ratio(indicators.sma(20), indicators.sma(50)) - 1)


@query(f"SELECT date, ticker, {r('(close - ' + gated('avg', 'close', 20) + ') / nullif(' + gated('stddev_samp', 'close', 20) + ', 0)', 'bb_zscore_20')} FROM panel")
def bollinger(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, bb_zscore_20=indicators.bollinger_z())


@query(f"SELECT date, ticker, {r(gated('avg', 'tr', 14), 'atr_14')} FROM (SELECT *, greatest(high - low, abs(high - lag(close) {OVER}), abs(low - lag(close) {OVER})) AS tr FROM panel)")
def atr(spark: SparkSession, sf: str) -> DataFrame:
    bars = b.panel(spark, sf).withColumn("tr", indicators.true_range())
    return rounded(bars.select("date", "ticker", full(F.avg("tr"), F.col("tr"), by("ticker"), 14).alias("atr_14")))


_SIGNED = f"(SELECT *, coalesce(sign(close - lag(close) {OVER}), 0) * volume AS sv, row_number() {OVER} AS rn FROM panel)"
_OBV = f"CASE WHEN rn > 5 THEN sum(sv) {frame(5)} END"


@query(f"SELECT date, ticker, {r(_OBV, 'obv_delta_5d')}, round(({_OBV}) / nullif({gated('avg', 'volume', 21)} * 5, 0), 9) AS obv_delta_norm FROM {_SIGNED}")
def obv_delta(spark: SparkSession, sf: str) -> DataFrame:
    change = F.col("close") - F.lag("close").over(by("ticker"))
    bars = b.panel(spark, sf).withColumn("signed_volume", F.coalesce(F.signum(change), F.lit(0.0)) * F.col("volume"))
    x = indicators.obv_delta()
    return rounded(bars.select("date", "ticker", x.alias("obv_delta_5d"), ratio(x, indicators.sma(21, "volume") * 5).alias("obv_delta_norm")), 9)


@query(f"SELECT date, ticker, {r('(volume - ' + gated('avg', 'volume', 21) + ') / nullif(' + gated('stddev_samp', 'volume', 21) + ', 0)', 'volume_zscore_21')} FROM panel")
def volume_z(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, volume_zscore_21=indicators.volume_z())


@query("SELECT date, ticker, isodow(date)::INT - 1 AS day_of_week FROM panel")
def day_of_week(spark: SparkSession, sf: str) -> DataFrame:
    return b.panel(spark, sf).select("date", "ticker", F.weekday("date").alias("day_of_week"))


def _ewm(col: str, alpha: float) -> str:
    """Exponential mean of a column without gaps after its first value, by folding the ordered list of values so far."""
    return f"list_reduce(list({col}) FILTER ({col} IS NOT NULL) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), lambda a, x: {1 - alpha!r} * a + {alpha!r} * x)"


_RSI = f"(SELECT *, {_ewm('up', 1 / 14)} AS g, {_ewm('down', 1 / 14)} AS l FROM (SELECT *, greatest(close - lag(close) {OVER}, 0) + 0 * lag(close) {OVER} AS up, greatest(lag(close) {OVER} - close, 0) + 0 * lag(close) {OVER} AS down FROM panel))"


@query(f"SELECT date, ticker, {r('100 - 100 / (1 + g / nullif(l, 0))', 'rsi_14')} FROM {_RSI}")
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.with_rsi(b.panel(spark, sf)).select("date", "ticker", "rsi_14"))


_MACD = f"(SELECT *, {_ewm('macd', 2 / 10)} AS macd_signal FROM (SELECT *, {_ewm('close', 2 / 13)} - {_ewm('close', 2 / 27)} AS macd FROM panel))"


@query(f"SELECT date, ticker, {rs('macd', 'macd_signal')}, {r('macd - macd_signal', 'macd_hist')} FROM {_MACD}")
def macd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.with_macd(b.panel(spark, sf)).select("date", "ticker", "macd", "macd_signal", "macd_hist"))


@query(f"""SELECT p.date, p.ticker, {r('close / nullif(' + gated('avg', 'close', 20) + ', 0) - 1', 'close_to_sma20')}, {r('close / nullif(' + gated('avg', 'close', 50) + ', 0) - 1', 'close_to_sma50')},
  {r('macd / nullif(close, 0)', 'macd_norm')}, {r('macd_signal / nullif(close, 0)', 'macd_signal_norm')}, {r('(macd - macd_signal) / nullif(close, 0)', 'macd_hist_norm')} FROM {_MACD} p""")
def scale_free_features(spark: SparkSession, sf: str) -> DataFrame:
    out = indicators.indicators(b.panel(spark, sf))
    return rounded(out.select("date", "ticker", "close_to_sma20", "close_to_sma50", "macd_norm", "macd_signal_norm", "macd_hist_norm"))


_SEAMED = f"""(WITH n AS (SELECT *, row_number() {OVER} - 1 AS p FROM panel),
  s AS (SELECT t.ticker, min(n.p) AS sp FROM ticker_seam t JOIN n ON n.ticker = t.ticker AND n.date >= t.seam_date GROUP BY t.ticker, t.seam_date HAVING min(n.p) > 0)
  SELECT n.*, (SELECT n.p - max(sp) FROM s WHERE s.ticker = n.ticker AND sp <= n.p) AS since, (SELECT min(sp) - n.p FROM s WHERE s.ticker = n.ticker AND sp > n.p) AS ahead,
  n.close / nullif(lag(n.close, 21) {OVER.replace('ticker', 'n.ticker').replace('date', 'n.date')}, 0) - 1 AS ret_21d, lead(n.close, 5) {OVER.replace('ticker', 'n.ticker').replace('date', 'n.date')} / n.close - 1 AS fwd FROM n)"""


@query(f"SELECT date, ticker, coalesce(since, 2147483647) AS sessions_since_seam, {r('CASE WHEN coalesce(since, 2147483647) > 20 THEN ret_21d END', 'ret_21d')} FROM {_SEAMED}")
def seam_backward_mask(spark: SparkSession, sf: str) -> DataFrame:
    bars = seams.with_seam_distance(b.panel(spark, sf), b.seams(spark)).withColumn("ret_21d", indicators.returns(21))
    return rounded(seams.mask_features(bars, {"ret_21d": 22}).select("date", "ticker", F.col("sessions_since_seam").cast("long").alias("sessions_since_seam"), "ret_21d"))


@query(f"SELECT date, ticker, {r('CASE WHEN coalesce(ahead, 2147483647) > 5 THEN fwd END', 'fwd_ret_5d')} FROM {_SEAMED}")
def seam_forward_mask(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outcomes.with_labels(b.panel(spark, sf), (5,), seams=b.seams(spark)).select("date", "ticker", "fwd_ret_5d"))


# --- outcomes ------------------------------------------------------------------------------

_FWD = {k: f"lead(close, {k}) {OVER} / close - 1" for k in (1, 5, 21)}


@query(f"SELECT date, ticker, {', '.join(r(x, f'fwd_ret_{k}d') for k, x in _FWD.items())} FROM panel")
def forward_returns_positional(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, **{f"fwd_ret_{k}d": outcomes.positional_return(k) for k in _FWD})


@query(f"SELECT date, ticker, {', '.join(f'CASE WHEN {x} IS NOT NULL THEN ({x} > 0)::INT::DOUBLE END AS label_up_{k}d' for k, x in _FWD.items())} FROM panel")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.with_labels(b.panel(spark, sf), tuple(_FWD)).select("date", "ticker", *[f"label_up_{k}d" for k in _FWD])


@query(f"SELECT ticker, date, horizon, {r('s_ret', 'fwd_ret')} FROM raw_out")
def forward_returns_calendar(spark: SparkSession, sf: str) -> DataFrame:
    bars = b.panel(spark, sf)
    return rounded(outcomes.calendar_returns(bars, session_calendar(bars), OUTCOME_HORIZONS).select("ticker", "date", "horizon", "fwd_ret"))


@query(f"SELECT ticker, date, source, horizon, {rs('stock_ret', 'benchmark_ret', 'abnormal_ret')}, valid, reason FROM outcome")
def abnormal_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(b.long_outcomes(spark, sf).select("ticker", "date", "source", "horizon", "stock_ret", "benchmark_ret", "abnormal_ret", "valid", "reason"))


@query(f"SELECT date, ticker, source, {', '.join(r(f'max(CASE WHEN horizon = {h} THEN {c} END)', f'{n}_{h}d') for h in (1, 20) for c, n in (('stock_ret', 'stock_fwd_ret'), ('benchmark_ret', 'benchmark_fwd_ret'), ('abnormal_ret', 'abnormal_ret')))}, bool_or(valid AND horizon = 1) AS valid_1d, bool_or(valid AND horizon = 20) AS valid_20d FROM outcome GROUP BY ALL")
def outcomes_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outcomes.wide(b.long_outcomes(spark, sf, (1, 20)), (1, 20)))


@query("""SELECT category, horizon, CASE WHEN valid THEN NULL WHEN reason = 'beyond_calendar' THEN reason WHEN crosses_seam THEN 'seam' WHEN stock_missing THEN 'missing_stock_price' ELSE 'missing_benchmark_price' END AS event_reason,
  count(*) AS n FROM ev GROUP BY ALL""")
def invalidity_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return b.events(spark, sf).groupBy("category", "horizon", outcomes.event_reason().alias("event_reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT horizon, count(*) AS n_rows, count(*) FILTER (valid) AS n_valid, count(*) FILTER (reason = 'beyond_calendar') AS n_beyond_calendar, count(*) FILTER (reason = 'missing_price') AS n_missing_price,
  count(*) FILTER (reason = 'seam') AS n_seam, {r('corr(stock_ret, benchmark_ret)', 'corr')}, {r('avg(stock_ret)', 'mean_stock')}, {r('avg(benchmark_ret)', 'mean_benchmark')}, {r('avg(abnormal_ret)', 'mean_abnormal')} FROM outcome GROUP BY horizon""")
def outcome_sanity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outcomes.outcome_sanity(b.long_outcomes(spark, sf)))


# --- news ----------------------------------------------------------------------------------


@query("SELECT article_id, published_at::VARCHAR AS published_at, day, trade_date, (day + CASE isodow(day) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END::INT)::DATE AS next_business_day FROM placed_all")
def session_bucketing(spark: SparkSession, sf: str) -> DataFrame:
    placed = to_sessions(b.articles(spark, sf), session_calendar(b.panel(spark, sf)))
    return placed.select("article_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.col("_day").alias("day"), "trade_date", business_day(F.col("_day")).alias("next_business_day"))


@query("SELECT CASE WHEN day < (SELECT min(date) FROM cal) THEN 'before_calendar' WHEN trade_date IS NULL THEN 'after_calendar' ELSE 'placed' END AS placement, count(*) AS n FROM placed_all GROUP BY 1")
def trade_date_stats(spark: SparkSession, sf: str) -> DataFrame:
    # The calendar is cut short at both ends so that both kinds of drop occur.
    return assign_trade_dates(b.articles(spark, sf), session_calendar(b.panel(spark, sf))).groupBy("placement").agg(F.count("*").alias("n"))


@query("SELECT ticker, count(*) AS n_kept, min(trade_date) AS first_kept FROM placed GROUP BY ticker")
def entity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return b.placed_articles(spark, sf).groupBy("ticker").agg(F.count("*").alias("n_kept"), F.min("trade_date").alias("first_kept"))


@query("SELECT ticker, date, category, n_articles FROM event")
def event_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return news.event_table(b.placed_articles(spark, sf))


_SHARE = ", ".join(r(f"avg((label = '{k}')::INT)", f"{k}_ratio") for k in ("positive", "negative", "neutral"))


@query(f"SELECT ticker, trade_date, {r('avg(score)', 'mean_sentiment')}, {_SHARE}, count(*) AS article_count FROM placed GROUP BY ticker, trade_date")
def daily_label_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(news.daily_label_sentiment(b.placed_articles(spark, sf)))


_SIGN = "(SELECT ticker, trade_date, count(*) AS n_articles, avg(score) AS sent_mean, avg((score > 0)::INT) AS sent_pos_share, avg((score < 0)::INT) AS sent_neg_share, coalesce(stddev_samp(score), 0) AS sent_dispersion FROM placed GROUP BY ticker, trade_date)"


@query(f"SELECT ticker, trade_date, n_articles, {rs('sent_mean', 'sent_pos_share', 'sent_neg_share', 'sent_dispersion')} FROM {_SIGN}")
def daily_sign_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(news.daily_sign_sentiment(b.placed_articles(spark, sf)))


@query(f"""SELECT date, ticker, {r('''(list_reduce(list_prepend({'y': NULL::DOUBLE, 'g': 0.0::DOUBLE}, list_transform(list(sent_mean) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), lambda v: {'y': v, 'g': -1.0::DOUBLE})),
  lambda a, c: CASE WHEN c.y IS NULL THEN {'y': a.y, 'g': a.g + 1} WHEN a.y IS NULL THEN {'y': c.y, 'g': 0.0::DOUBLE}
  ELSE {'y': (pow(2 / 3.0::DOUBLE, a.g + 1) * a.y + (1 - 2 / 3.0::DOUBLE) * c.y) / (pow(2 / 3.0::DOUBLE, a.g + 1) + 1 - 2 / 3.0::DOUBLE), 'g': 0.0::DOUBLE} END)).y''', 'ewma_sent')}
  FROM (SELECT p.date, p.ticker, s.sent_mean FROM panel p LEFT JOIN {_SIGN} s ON s.ticker = p.ticker AND s.trade_date = p.date)""")
def ewma_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    daily = news.daily_sign_sentiment(b.placed_articles(spark, sf)).select("ticker", F.col("trade_date").alias("date"), "sent_mean")
    grid = b.panel(spark, sf).select("date", "ticker").join(daily, ["ticker", "date"], "left")
    return rounded(indicators.carried_sentiment(grid).select("date", "ticker", "ewma_sent"))


_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_LEX = f"(SELECT *, len(list_filter(regexp_extract_all(lower(headline), '[a-z]+'), lambda w: list_contains({_LIST(POSITIVE)}, w))) AS np, len(list_filter(regexp_extract_all(lower(headline), '[a-z]+'), lambda w: list_contains({_LIST(NEGATIVE)}, w))) AS nn FROM labelled)"


@query(f"SELECT article_id, {r('coalesce((np - nn)::DOUBLE / nullif(np + nn, 0), 0)', 'lexicon_score')} FROM {_LEX}")
def lexicon_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(b.articles(spark, sf).select("article_id", lexicon_score(F.col("headline")).alias("lexicon_score")))


_RULE = "CASE " + " ".join(f"WHEN regexp_matches(headline, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{c}'" for c, p in HEADLINE_RULES) + " ELSE 'OTHER' END"


@query(f"SELECT article_id, {_RULE} AS headline_category FROM labelled")
def headline_categories(spark: SparkSession, sf: str) -> DataFrame:
    return b.articles(spark, sf).select("article_id", headline_category(F.col("headline")).alias("headline_category"))


@query(f"""WITH x AS (SELECT category AS a, {_RULE} AS p FROM labelled), c AS (SELECT a AS category FROM x UNION SELECT p FROM x)
  SELECT category, (SELECT count(*) FROM x WHERE a = category) AS n_actual, (SELECT count(*) FROM x WHERE p = category) AS n_predicted, (SELECT count(*) FROM x WHERE a = category AND p = category) AS n_agree,
  round((SELECT count(*) FROM x WHERE a = category AND p = category) / nullif((SELECT count(*) FROM x WHERE a = category), 0)::DOUBLE, 4) AS recall,
  round((SELECT count(*) FROM x WHERE a = category AND p = category) / nullif((SELECT count(*) FROM x WHERE p = category), 0)::DOUBLE, 4) AS precision,
  round((SELECT avg((a = p)::INT) FROM x), 4) AS overall FROM c""")
def classifier_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return current.agreement(b.articles(spark, sf).withColumn("predicted", headline_category(F.col("headline"))), "category", "predicted")


@query("SELECT article_id, substr(sha1('http://x/' || article_id::VARCHAR || '|' || headline), 1, 16) AS id_short, substr(sha1('http://x/' || article_id::VARCHAR || '|' || headline || '|' || ticker), 1, 16) AS id_full FROM labelled")
def article_ids(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("http://x/"), F.col("article_id").cast("string"))
    return b.articles(spark, sf).select("article_id", article_id(url, F.col("headline")).alias("id_short"), article_id(url, F.col("headline"), F.col("ticker")).alias("id_full"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT) AS sum_k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    got = b.read(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("sum_k"))


# --- events and summaries ------------------------------------------------------------------


@query(f"SELECT e.ticker, e.date, e.category, e.n_articles, o.horizon, {r('o.abnormal_ret', 'abnormal_ret')}, coalesce(o.valid, false) AS valid, s.sector, o.ticker IS NOT NULL AS matched FROM event e LEFT JOIN outcome o ON o.ticker = e.ticker AND o.date = e.date LEFT JOIN sector s ON s.ticker = e.ticker")
def event_outcome_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = news.with_sector(news.with_outcomes(news.event_table(b.placed_articles(spark, sf)), b.long_outcomes(spark, sf)), b.sectors(spark, sf))
    return rounded(joined.select("ticker", "date", "category", "n_articles", "horizon", "abnormal_ret", "valid", "sector", "matched"))


_DESC = ("mean_abnormal_return", "p25_abnormal_return", "median_abnormal_return", "p75_abnormal_return", "std_abnormal_return", "pct_positive", "pct_negative", "nw_mean", "nw_se", "nw_ci95_lo", "nw_ci95_hi")
_COUNT = ("n_events_total", "n_events_valid", "n_events_invalid", "n_tickers", "n_dates", "sufficient_sample", "exploratory_horizon")


def _desc(keys: str) -> str:
    return f"SELECT {keys}, horizon, {', '.join(_COUNT)}, {rs(*_DESC)}"


def _described(events: DataFrame, *keys: str) -> DataFrame:
    return rounded(summaries.describe(events, list(keys)).select(*keys, "horizon", *_COUNT, *_DESC))


@query(f"{_desc('category')} FROM {o.summary('ev', 'category')}")
def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _described(b.events(spark, sf), "category")


@query(f"{_desc('sector, category')} FROM {o.summary('ev', 'sector, category')}")
def sector_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _described(b.events(spark, sf).where("sector is not null"), "sector", "category")


_TIER = "CASE WHEN n_events_valid >= 20 THEN 'adequately_supported' WHEN n_events_valid >= 8 THEN 'exploratory' ELSE 'insufficient' END"


@query(f"{_desc('ticker, category')}, {_TIER} AS evidence_tier FROM {o.summary('ev', 'ticker, category')}")
def ticker_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _described(b.events(spark, sf), "ticker", "category").withColumn("evidence_tier", summaries.tier())


@query("""SELECT horizon, n_valid, n_invalid, last_event, last_valid, round(n_valid / (n_valid + n_invalid)::DOUBLE, 6) AS pct_valid, (last_event - last_valid)::INT AS days_lost, (DATE '2002-01-01' - last_valid)::INT AS staleness_days
  FROM (SELECT horizon, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid, max(date) AS last_event, max(date) FILTER (valid) AS last_valid FROM ev GROUP BY horizon)""")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summaries.freshness(b.events(spark, sf), F.to_date(F.lit("2002-01-01"))))


@query(f"SELECT category, horizon, n, {rs('mean', 'se', 't_stat', 'p_value', 'ci95_lo', 'ci95_hi')} FROM {o.hac(o.daily('ev', 'category'), 'category', 'abnormal_ret')}")
def newey_west(spark: SparkSession, sf: str) -> DataFrame:
    means = statistics.hac_means(summaries.by_date(b.events(spark, sf), ["category"]), ["category"], "abnormal_ret", horizons=OUTCOME_HORIZONS)
    return rounded(means.select("category", "horizon", "n", "mean", "se", "t_stat", "p_value", "ci95_lo", "ci95_hi"))


_VS = "n_events_category, n_tickers_category, n_overlapping_dates, sufficient_sample, exploratory_horizon, " + rs("diff_mean", "se", "t_stat", "p_value", "ci95_lo", "ci95_hi") + ", significant_fdr, n_tests_in_family"
_VS_COLUMNS = ["n_events_category", "n_tickers_category", "n_overlapping_dates", "sufficient_sample", "exploratory_horizon", "diff_mean", "se", "t_stat", "p_value", "ci95_lo", "ci95_hi", "significant_fdr", "n_tests_in_family"]


@query(f"SELECT category, horizon, {_VS} FROM {o.bh(o.versus('ev', ''))}")
def category_vs_other(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summaries.category_versus_other(b.events(spark, sf)).select("category", "horizon", *_VS_COLUMNS))


@query(f"SELECT sector, category, horizon, {_VS} FROM {o.bh(o.versus('ev', 'sector'))}")
def sector_vs_other(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summaries.sector_versus_other(b.events(spark, sf)).select("sector", "category", "horizon", *_VS_COLUMNS))


_P = "(SELECT l_orderkey AS id, l_linenumber AS ln, l_returnflag AS family, CASE WHEN l_linenumber <> 3 THEN pow(((l_orderkey * 7919 + l_partkey * 104729) % 10007) / 10007.0::DOUBLE, 4) END AS p FROM lineitem)"


@query(f"SELECT family, count(*) AS n, count(*) FILTER (flag) AS n_flagged, {r('max(p) FILTER (flag)', 'threshold')}, max(m) AS m FROM {o.bh(_P, 'p', 'family', flag='flag', size='m')} GROUP BY family")
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    x = b.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("family"), F.when(F.col("l_linenumber") != 3, F.pow(((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 10007) / 10007.0, 4)).alias("p"))
    flagged = statistics.benjamini_hochberg(x, "p", ["family"], flag="flag", size="m")
    return rounded(flagged.groupBy("family").agg(F.count("*").alias("n"), F.count_if("flag").alias("n_flagged"), F.max(F.when(F.col("flag"), F.col("p"))).alias("threshold"), F.max("m").alias("m")))


# --- tickers -------------------------------------------------------------------------------

_CATS = "(SELECT * FROM ev WHERE valid AND category <> 'OTHER')"
_ONLY = "(SELECT q.ticker, q.category, o.horizon, o.date, o.pos, o.abnormal_ret FROM (SELECT DISTINCT ticker, category, horizon FROM ev WHERE category <> 'OTHER') q JOIN ev o ON o.ticker = q.ticker AND o.horizon = q.horizon AND o.category = 'OTHER' AND o.valid)"
_SAME = "SELECT 1 FROM ev c WHERE c.valid AND c.ticker = x.ticker AND c.category = x.category AND c.horizon = x.horizon AND c.date = x.date"
_APART = f"(SELECT * FROM {_ONLY} x WHERE NOT EXISTS ({_SAME}))"
_TVO = f"""(WITH base AS (SELECT DISTINCT ticker, category, horizon FROM ev WHERE category <> 'OTHER'),
  sz AS (SELECT ticker, category, horizon, count(*) AS ne FROM {_CATS} GROUP BY ALL), sd AS (SELECT ticker, category, horizon, count(*) AS ns FROM {_ONLY} x WHERE EXISTS ({_SAME}) GROUP BY ALL),
  j AS (SELECT ticker, category, horizon, coalesce(ne, 0) AS n_events_category, coalesce(h2.n, 0) AS n_other_dates, coalesce(ns, 0) AS n_same_day_overlap_excluded, h1.n AS n1, h2.n AS n2,
    CASE WHEN h1.n >= 2 AND h2.n >= 2 THEN h1.mean - h2.mean END AS diff_mean, CASE WHEN h1.n >= 2 AND h2.n >= 2 THEN sqrt(h1.se * h1.se + h2.se * h2.se) END AS se
    FROM base LEFT JOIN sz USING (ticker, category, horizon) LEFT JOIN sd USING (ticker, category, horizon)
    LEFT JOIN {o.hac(_CATS, 'ticker, category', 'abnormal_ret')} h1 USING (ticker, category, horizon) LEFT JOIN {o.hac(_APART, 'ticker, category', 'abnormal_ret')} h2 USING (ticker, category, horizon)),
  t AS (SELECT *, CASE WHEN se > 0 THEN diff_mean / se END AS t_stat, greatest(least(n1, n2) - 1, 1) AS df, n_events_category >= 20 AND n_other_dates >= 10 AS sufficient_sample FROM j),
  p AS (SELECT *, {o.t_p('t_stat', 'df')} AS p_value, diff_mean - 1.96 * se AS ci95_lo, diff_mean + 1.96 * se AS ci95_hi FROM t),
  f AS (SELECT *, CASE WHEN sufficient_sample THEN p_value END AS pf, {_TIER.replace('n_events_valid', 'n_events_category')} AS evidence_tier FROM p)
  SELECT * FROM {o.bh('f', 'pf', 'category, horizon')})"""


@query(f"SELECT ticker, category, horizon, n_events_category, n_other_dates, n_same_day_overlap_excluded, sufficient_sample, evidence_tier, {rs('diff_mean', 'se', 't_stat', 'p_value', 'ci95_lo', 'ci95_hi')}, significant_fdr, n_tests_in_family FROM {_TVO}")
def ticker_vs_other(spark: SparkSession, sf: str) -> DataFrame:
    out = summaries.ticker_versus_other(b.events(spark, sf))
    return rounded(out.select("ticker", "category", "horizon", "n_events_category", "n_other_dates", "n_same_day_overlap_excluded", "sufficient_sample", "evidence_tier", "diff_mean", "se", "t_stat", "p_value", "ci95_lo", "ci95_hi", "significant_fdr", "n_tests_in_family"))


_SHR = f"""(WITH s AS (SELECT *, {_TIER} AS evidence_tier FROM {o.summary('ev', 'ticker, category')}), w AS (SELECT *, 1 / (nw_se * nw_se) AS w FROM s WHERE evidence_tier = 'adequately_supported' AND nw_se > 0),
  m AS (SELECT category, horizon, sum(w * mean_abnormal_return) / sum(w) AS mu, sum(w) AS w1, sum(w * w) AS w2, count(*) AS k FROM w GROUP BY ALL HAVING count(*) >= 20),
  q AS (SELECT category, horizon, any_value(k) AS k, any_value(w1) AS w1, any_value(w2) AS w2, sum(w.w * pow(mean_abnormal_return - mu, 2)) AS q FROM w JOIN m USING (category, horizon) GROUP BY ALL),
  t AS (SELECT category, horizon, CASE WHEN w1 - w2 / w1 > 0 THEN greatest(0.0, (q - (k - 1)) / (w1 - w2 / w1)) ELSE 0.0 END AS tau2 FROM q),
  pr AS (SELECT category, horizon, mean_abnormal_return AS prior FROM {o.described('ev', 'category')} WHERE mean_abnormal_return IS NOT NULL),
  x AS (SELECT s.*, t.tau2, pr.prior, CASE WHEN nw_se > 0 AND t.tau2 IS NOT NULL THEN t.tau2 / (t.tau2 + nw_se * nw_se) END AS shrinkage_weight FROM s LEFT JOIN t USING (category, horizon) LEFT JOIN pr USING (category, horizon))
  SELECT *, coalesce(prior + shrinkage_weight * (mean_abnormal_return - prior), mean_abnormal_return) AS shrunk_mean FROM x)"""


def _shrunk(spark: SparkSession, sf: str) -> DataFrame:
    events = b.events(spark, sf)
    return summaries.shrunk_summary(summaries.describe(events, ["ticker", "category"]), summaries.describe(events, ["category"], hac=False))


@query(f"SELECT ticker, category, horizon, evidence_tier, {rs('mean_abnormal_return', 'shrunk_mean', 'shrinkage_weight', 'tau2')} FROM {_SHR}")
def shrinkage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_shrunk(spark, sf).select("ticker", "category", "horizon", "evidence_tier", "mean_abnormal_return", "shrunk_mean", "shrinkage_weight", "tau2"))


@query(f"""SELECT t.ticker, t.category, t.horizon, s.sector, {', '.join(r(f'CASE WHEN z.sufficient_sample THEN z.{c} END', n) for c, n in (('mean_abnormal_return', 'sector_mean'), ('nw_mean', 'sector_nw_mean'), ('nw_se', 'sector_nw_se')))},
  CASE WHEN z.sufficient_sample THEN z.n_tickers END AS sector_n_tickers, coalesce(z.sufficient_sample, false) AS sector_sufficient
  FROM (SELECT DISTINCT ticker, category, horizon FROM ev) t LEFT JOIN sector s ON s.ticker = t.ticker LEFT JOIN {o.summary('ev', 'sector, category')} z ON z.sector = s.sector AND z.category = t.category AND z.horizon = t.horizon""")
def sector_baseline(spark: SparkSession, sf: str) -> DataFrame:
    events = b.events(spark, sf)
    mine = news.with_sector(summaries.describe(events, ["ticker", "category"], hac=False), b.sectors(spark, sf))
    out = summaries.with_sector_baseline(mine, summaries.describe(events.where("sector is not null"), ["sector", "category"]))
    return rounded(out.select("ticker", "category", "horizon", "sector", "sector_mean", "sector_nw_mean", "sector_nw_se", "sector_n_tickers", "sector_sufficient"))


@query(f"""SELECT ticker, category, horizon, {rs('diff_mean', 'abs_diff_mean', 'shrunk_mean')}, rank FROM (SELECT v.ticker, v.category, v.horizon, v.diff_mean, abs(v.diff_mean) AS abs_diff_mean, s.shrunk_mean,
  row_number() OVER (ORDER BY abs(v.diff_mean) DESC, v.n_events_category DESC, v.ticker, v.category, v.horizon) AS rank
  FROM {_TVO} v LEFT JOIN {_SHR} s ON s.ticker = v.ticker AND s.category = v.category AND s.horizon = v.horizon WHERE v.evidence_tier = 'adequately_supported' AND v.significant_fdr)""")
def ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranked = summaries.ranking(summaries.ticker_versus_other(b.events(spark, sf)), _shrunk(spark, sf))
    return rounded(ranked.select("ticker", "category", "horizon", "diff_mean", "abs_diff_mean", "shrunk_mean", "rank"))


@query(f"SELECT category, horizon, count(*) FILTER (t = 'adequately_supported') AS adequately_supported, count(*) FILTER (t = 'exploratory') AS exploratory, count(*) FILTER (t = 'insufficient') AS insufficient FROM (SELECT *, {_TIER} AS t FROM {o.described('ev', 'ticker, category')}) GROUP BY category, horizon")
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.tier_counts(summaries.describe(b.events(spark, sf), ["ticker", "category"], hac=False).withColumn("evidence_tier", summaries.tier()))


# --- rolling -------------------------------------------------------------------------------

_GRID = "(SELECT k::INT AS k, hi - (k * {s})::INT - 364 AS window_start, hi - (k * {s})::INT AS window_end FROM (SELECT min(date) AS lo, max(date) AS hi FROM ev), range(0, 100) g(k) WHERE hi - (k * {s})::INT - 364 >= lo)"
_IN = "(SELECT g.*, e.* FROM " + _GRID + " g JOIN ev e ON e.date BETWEEN g.window_start AND g.window_end)"


@query(f"SELECT k, window_start, window_end, k % 5 = 0 AS disjoint FROM {_GRID.format(s=91)}")
def window_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.window_grid(b.events(spark, sf)).withColumn("disjoint", rolling.non_overlapping())


_RC = f"""(WITH i AS {_IN.format(s=91)}, own AS (SELECT * FROM {o.summary('i', 'k, window_start, window_end, category')}),
  v AS (SELECT * FROM {o.versus('i', 'k, window_start, window_end', emit_all=False)}),
  j AS (SELECT own.*, n_events_valid >= 30 AND own.n_tickers >= 10 AS window_sufficient, coalesce(v.sufficient_sample, false) AS vs_other_sufficient, v.n_overlapping_dates AS vs_other_n_overlapping_dates,
    v.diff_mean AS vs_other_diff_mean, v.se AS vs_other_se, v.p_value AS vs_other_p_value, v.ci95_lo AS vs_other_ci95_lo, v.ci95_hi AS vs_other_ci95_hi FROM own LEFT JOIN v USING (k, window_start, window_end, category, horizon)),
  f AS (SELECT *, CASE WHEN vs_other_sufficient AND window_sufficient THEN vs_other_p_value END AS pf FROM j)
  SELECT * FROM {o.bh('f', 'pf', flag='vs_other_significant_fdr_exploratory', size='n_tests_in_rolling_family')})"""
_DIR = "CASE WHEN {0}_lo > 0 THEN 'positive' WHEN {0}_hi < 0 THEN 'negative' ELSE 'inconclusive' END"
_RC_NUM = ("mean_abnormal_return", "median_abnormal_return", "nw_mean", "nw_se", "vs_other_diff_mean", "vs_other_se", "vs_other_p_value")
_RC_COLUMNS = ["window_start", "window_end", "category", "horizon", "n_events_valid", "n_tickers", "window_sufficient", "vs_other_sufficient", "vs_other_significant_fdr_exploratory", "n_tests_in_rolling_family"]


@query(f"SELECT {', '.join(_RC_COLUMNS)}, {rs(*_RC_NUM)}, {_DIR.format('nw_ci95')} AS own_direction FROM {_RC}")
def rolling_category(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rolling.rolling_categories(b.events(spark, sf)).select(*_RC_COLUMNS, *_RC_NUM, "own_direction"))


_FORCED = (("NATION_4", "MANAGEMENT", 20), ("NATION_8", "M_AND_A", 1))


def _candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_FORCED), "ticker string, category string, horizon int")


_CAND = f"(SELECT * FROM {o.rows(_FORCED, 'ticker, category, horizon')})"
_RT = f"""(WITH once AS (SELECT DISTINCT ticker, category, date FROM ev), den AS (SELECT ticker, category, count(*) OVER (PARTITION BY ticker, category ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 364 DAY FOLLOWING) AS c FROM once),
  pairs AS (SELECT ticker, category FROM den GROUP BY ALL HAVING max(c) >= 8 UNION SELECT ticker, category FROM {_CAND}),
  i AS (SELECT * FROM {_IN.format(s=182)} SEMI JOIN pairs USING (ticker, category)), d AS (SELECT * FROM {o.summary('i', 'k, window_start, window_end, ticker, category')}),
  forced AS (SELECT g.*, c.ticker, c.category, h.horizon, true AS phase2_candidate FROM {_GRID.format(s=182)} g, {_CAND} c, hz h)
  SELECT k, window_start, window_end, ticker, category, horizon, coalesce(n_events_valid, 0) AS n_events_valid, nw_mean, nw_se, mean_abnormal_return, coalesce(phase2_candidate, false) AS phase2_candidate
  FROM d FULL JOIN forced USING (k, window_start, window_end, ticker, category, horizon) WHERE coalesce(n_events_valid, 0) >= 4 OR phase2_candidate)"""


@query(f"SELECT window_start, window_end, ticker, category, horizon, n_events_valid, phase2_candidate, {rs('mean_abnormal_return', 'nw_mean', 'nw_se')}, CASE WHEN n_events_valid >= 8 THEN 'exploratory' WHEN n_events_valid >= 4 THEN 'sparse' ELSE 'insufficient' END AS evidence_tier FROM {_RT}")
def rolling_ticker(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling.rolling_tickers(b.events(spark, sf), _candidates(spark))
    return rounded(out.select("window_start", "window_end", "ticker", "category", "horizon", "n_events_valid", "phase2_candidate", "mean_abnormal_return", "nw_mean", "nw_se", "evidence_tier"))


_TC_SIDE = "arg_{f}({c}, window_end) FILTER (ok AND m IS NOT NULL AND k % 5 = 0)"
_TC = f"""(WITH rc AS {_RC}, x AS (
    SELECT 'vs_other_diff' AS metric, category, horizon, k, window_end, n_events_valid, window_sufficient, vs_other_diff_mean AS m, vs_other_se AS s, vs_other_ci95_lo AS lo, vs_other_ci95_hi AS hi, vs_other_n_overlapping_dates AS n, window_sufficient AND vs_other_sufficient AS ok FROM rc WHERE category <> 'OTHER'
    UNION ALL SELECT 'own_nw_mean', category, horizon, k, window_end, n_events_valid, window_sufficient, nw_mean, nw_se, nw_ci95_lo, nw_ci95_hi, n_dates, window_sufficient FROM rc),
  g AS (SELECT metric, category, horizon, count(*) AS n_windows_total, count(*) FILTER (window_sufficient) AS n_windows_sufficient, count(*) FILTER (k % 5 = 0) AS n_nonoverlapping_windows,
    count(*) FILTER (ok AND m IS NOT NULL AND k % 5 = 0) AS n_nonoverlapping_sufficient, max(window_end) AS recent_window_end, arg_max(ok, window_end) AS recent_window_sufficient,
    {', '.join(f"{_TC_SIDE.format(f=f, c=c)} AS {n}_{c}" for f, n in (('min', 'early'), ('max', 'late')) for c in ('m', 's', 'lo', 'hi', 'n'))} FROM x GROUP BY metric, category, horizon),
  e AS (SELECT *, n_nonoverlapping_sufficient >= 4 AS enough FROM g),
  d AS (SELECT *, CASE WHEN enough THEN late_m - early_m END AS diff, CASE WHEN enough THEN sqrt(late_s * late_s + early_s * early_s) END AS dse, greatest(least(late_n, early_n) - 1, 1) AS df FROM e),
  t AS (SELECT *, CASE WHEN dse > 0 THEN diff / dse END AS ts FROM d), p AS (SELECT *, {o.t_p('ts', 'df')} AS pv, enough AND coalesce(early_hi < late_lo OR late_hi < early_lo, false) AS intervals_disjoint,
    CASE WHEN NOT enough THEN 'insufficient_windows' WHEN early_m IS NULL OR late_m IS NULL THEN 'inconclusive' WHEN sign(early_m) * sign(late_m) < 0 THEN
      CASE WHEN (early_lo > 0 OR early_hi < 0) AND (late_lo > 0 OR late_hi < 0) THEN 'reversed' ELSE 'direction_unstable' END
      WHEN abs(early_m) <= 0 THEN CASE WHEN abs(late_m) > 0 THEN 'strengthened' ELSE 'broadly_consistent' END
      WHEN abs(late_m) / abs(early_m) >= 1.25 THEN 'strengthened' WHEN abs(late_m) / abs(early_m) <= 0.75 THEN 'weakened' ELSE 'broadly_consistent' END AS change_label FROM t)
  SELECT * FROM {o.bh('p', 'pv', flag='diff_significant_fdr', size='n_tests_in_change_family')})"""
_TC_COLUMNS = ["metric", "category", "horizon", "n_windows_total", "n_windows_sufficient", "n_nonoverlapping_windows", "n_nonoverlapping_sufficient", "recent_window_end", "recent_window_sufficient", "change_label", "intervals_disjoint", "diff_significant_fdr", "n_tests_in_change_family"]


@query(f"SELECT {', '.join(_TC_COLUMNS)}, {r('diff', 'diff_late_minus_early')}, {r('dse', 'diff_se')}, {r('pv', 'diff_p_value')}, diff_significant_fdr AND intervals_disjoint AS change_established FROM {_TC}")
def temporal_change(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling.temporal_change(rolling.rolling_categories(b.events(spark, sf)))
    return rounded(out.select(*_TC_COLUMNS, "diff_late_minus_early", "diff_se", "diff_p_value", "change_established"))


_CC = f"""(WITH v AS (SELECT e.*, avg(abnormal_ret) OVER (PARTITION BY ticker, category, horizon) AS mu, count(*) OVER (PARTITION BY ticker, category, horizon ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 364 DAY FOLLOWING) AS dn
    FROM ev e SEMI JOIN {_CAND} c USING (ticker, category, horizon) WHERE valid), w AS (SELECT *, row_number() OVER (PARTITION BY ticker, category, horizon ORDER BY abs(abnormal_ret - mu) DESC, date) AS rk FROM v)
  SELECT ticker, category, horizon, count(*) AS n_events_valid, avg(abnormal_ret) AS mean_abnormal_return, avg(abnormal_ret) FILTER (rk > 1) AS mean_excl_most_extreme, avg(abnormal_ret) FILTER (rk > 3) AS mean_excl_3_most_extreme,
    max(abnormal_ret) FILTER (rk = 1) AS largest_event_return, max(date) FILTER (rk = 1) AS largest_event_date, max(dn) AS max_events_in_window, count(*) FILTER (date >= (SELECT max(date) FROM ev) - 364) AS n_recent FROM w GROUP BY ticker, category, horizon)"""


@query(f"SELECT ticker, category, horizon, n_events_valid, {rs('mean_abnormal_return', 'mean_excl_most_extreme', 'mean_excl_3_most_extreme', 'largest_event_return')}, largest_event_date, max_events_in_window, n_recent, coalesce(round(abs(mean_excl_most_extreme - mean_abnormal_return) / nullif(abs(mean_abnormal_return), 0) * 100, 1) >= 25, false) OR n_events_valid < 30 AS event_dominated FROM {_CC}")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling.concentration(b.events(spark, sf), _candidates(spark)).where("n_events_valid > 0")
    return rounded(out.select("ticker", "category", "horizon", "n_events_valid", "mean_abnormal_return", "mean_excl_most_extreme", "mean_excl_3_most_extreme", "largest_event_return", "largest_event_date", "max_events_in_window", "n_recent", "event_dominated"))


@query(f"SELECT metric, count(*) FILTER (diff_significant_fdr AND intervals_disjoint) AS n_established, (SELECT count(*) FROM (SELECT category, horizon FROM {_TC} WHERE diff_significant_fdr AND intervals_disjoint GROUP BY ALL HAVING count(*) = 2)) AS n_on_both FROM {_TC} GROUP BY metric")
def established_changes(spark: SparkSession, sf: str) -> DataFrame:
    # Cells of a report. Each step reads the one before it several times: uncut, the plans multiply to more than a driver holds.
    cells = cut(rolling.rolling_categories(cut(b.events(spark, sf))))
    change = cut(rolling.temporal_change(cells))
    both = rolling.established_on_both(change).agg(F.count("*").alias("n_on_both"))
    return change.groupBy("metric").agg(F.count_if("change_established").alias("n_established")).join(F.broadcast(both))


# --- current events ------------------------------------------------------------------------

_CE = """(SELECT ticker, trade_date, category, count(*) AS n_articles, avg(score) AS mean_sentiment, min(published_at) AS first_published, max(published_at) AS last_published,
  array_to_string(list(headline ORDER BY published_at, article_id)[1:3], ' | ') AS headlines FROM placed WHERE trade_date >= DATE '2001-06-01' GROUP BY ALL)"""


def _current(spark: SparkSession, sf: str) -> DataFrame:
    recent = b.placed_articles(spark, sf).where(F.col("trade_date") >= "2001-06-01").withColumn("session_status", F.lit("in_panel"))
    return current.collapse(recent)


@query(f"SELECT ticker, trade_date, category, n_articles, {rs('mean_sentiment')}, first_published::VARCHAR AS first_published, last_published::VARCHAR AS last_published, headlines FROM {_CE}")
def current_events(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rounded(_current(spark, sf).select("ticker", "trade_date", "category", "n_articles", "mean_sentiment", text("first_published"), text("last_published"), "headlines"))


@query(f"""SELECT c.ticker, c.trade_date, c.category, h.horizon, {r('s.shrunk_mean', 'shrunk_mean')}, CASE WHEN s.evidence_tier IS NULL THEN 'no_history' WHEN s.evidence_tier = 'insufficient' THEN 'insufficient_history'
  WHEN s.evidence_tier = 'exploratory' THEN 'exploratory_only' WHEN v.p_value IS NULL THEN 'supported_no_comparison' WHEN v.significant_fdr THEN 'supported_significant' ELSE 'supported_not_significant' END AS evidence_status
  FROM {_CE} c CROSS JOIN hz h LEFT JOIN {_SHR} s ON s.ticker = c.ticker AND s.category = c.category AND s.horizon = h.horizon LEFT JOIN {_TVO} v ON v.ticker = c.ticker AND v.category = c.category AND v.horizon = h.horizon""")
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    out = current.with_evidence(_current(spark, sf), _shrunk(spark, sf), summaries.ticker_versus_other(b.events(spark, sf)))
    return rounded(out.select("ticker", "trade_date", "category", "horizon", "shrunk_mean", "evidence_status"))


_CN = f"""(SELECT ticker, trade_date, category, count(*) AS n_articles, avg(score) AS mean_sentiment, min(published_at) AS first_published, array_to_string(list(headline ORDER BY published_at, article_id)[1:3], ' | ') AS headlines,
  arg_min(session_status, (published_at, article_id)) AS session_status FROM (
  SELECT l.article_id, l.ticker, l.headline, l.published_at, coalesce(p.trade_date, (p.day + CASE isodow(p.day) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END::INT)::DATE) AS trade_date, CASE WHEN p.trade_date IS NULL THEN 'after_panel' ELSE 'in_panel' END AS session_status,
    {_RULE.replace('headline', 'l.headline')} AS category, coalesce((l.np - l.nn)::DOUBLE / nullif(l.np + l.nn, 0), 0) AS score FROM {_LEX} l JOIN placed_all p ON p.article_id = l.article_id) WHERE trade_date >= DATE '2001-06-01' GROUP BY ticker, trade_date, category)"""


@query(f"""SELECT c.ticker, c.trade_date, c.category, h.horizon, c.n_articles, {r('c.mean_sentiment', 'mean_sentiment')}, c.first_published::VARCHAR AS first_published, c.headlines, c.session_status, {r('s.shrunk_mean', 'shrunk_mean')}, CASE WHEN s.evidence_tier IS NULL THEN 'no_history'
  WHEN s.evidence_tier = 'insufficient' THEN 'insufficient_history' WHEN s.evidence_tier = 'exploratory' THEN 'exploratory_only' WHEN v.p_value IS NULL THEN 'supported_no_comparison' WHEN v.significant_fdr THEN 'supported_significant' ELSE 'supported_not_significant' END AS evidence_status
  FROM {_CN} c CROSS JOIN hz h LEFT JOIN {_SHR} s ON s.ticker = c.ticker AND s.category = c.category AND s.horizon = h.horizon LEFT JOIN {_TVO} v ON v.ticker = c.ticker AND v.category = c.category AND v.horizon = h.horizon""")
def current_news(spark: SparkSession, sf: str) -> DataFrame:
    articles = b.articles(spark, sf).drop("score", "label", "category")
    cache = spark.createDataFrame([], "text_key string, positive double, negative double, neutral double, label string, score double")
    run = workflows.current_news(articles, session_calendar(b.panel(spark, sf)), cache, _shrunk(spark, sf), summaries.ticker_versus_other(b.events(spark, sf)), since=F.lit("2001-06-01").cast("date"))
    first = F.date_format("first_published", "yyyy-MM-dd HH:mm:ss").alias("first_published")
    return rounded(run["evidence"].select("ticker", "trade_date", "category", "horizon", "n_articles", "mean_sentiment", first, "headlines", "session_status", "shrunk_mean", "evidence_status"))


# --- training ------------------------------------------------------------------------------


def _matrix(spark: SparkSession, sf: str, horizon: int = 5) -> DataFrame:
    features = learning.build_features(b.panel(spark, sf), b.seams(spark), horizons=(horizon,))
    return learning.training_matrix(features, news.daily_label_sentiment(b.placed_articles(spark, sf).where("trade_date is not null")), horizon, checked=False)


def _avg(col: str, rows: int) -> str:
    return gated("avg", col, rows)


def _over(a: str, c: str) -> str:
    return f"{a} / nullif({c}, 0)"


#: Each indicator over ``x`` (bars with returns, true range, signed volume, MACD and Wilder means).
_FEATURES = {
    **{c: c for c in ("ret_1d", "ret_5d", "ret_21d", "macd", "macd_signal")},
    "vol_21d": gated("stddev_samp", "ret_1d", 21),
    "vol_63d": gated("stddev_samp", "ret_1d", 63),
    "rsi_14": "100 - 100 / (1 + g / nullif(l, 0))",
    "macd_hist": "macd - macd_signal",
    "sma_20": _avg("close", 20),
    "sma_50": _avg("close", 50),
    "sma_ratio_20_50": f"{_over(_avg('close', 20), _avg('close', 50))} - 1",
    "bb_zscore_20": _over(f"(close - {_avg('close', 20)})", gated("stddev_samp", "close", 20)),
    "atr_14": _avg("tr", 14),
    "volume_zscore_21": _over(f"(volume - {_avg('volume', 21)})", gated("stddev_samp", "volume", 21)),
    "obv_delta_5d": _OBV,
    "day_of_week": "isodow(date)::INT - 1",
    "close_to_sma20": f"{_over('close', _avg('close', 20))} - 1",
    "close_to_sma50": f"{_over('close', _avg('close', 50))} - 1",
    "macd_norm": _over("macd", "close"),
    "macd_signal_norm": _over("macd_signal", "close"),
    "macd_hist_norm": _over("(macd - macd_signal)", "close"),
    "atr_pct": _over(_avg("tr", 14), "close"),
    "obv_delta_norm": _over(f"({_OBV})", f"{_avg('volume', 21)} * 5"),
}
_BARS = ("open", "high", "low", "close", "volume")
#: Quotients of whole numbers often lie half-way between two values of six places.
_FINE = (*_BARS, "obv_delta_norm")
_NEWS = f"(SELECT ticker, trade_date AS date, avg(score) AS mean_sentiment, {', '.join(f"avg((label = '{k}')::INT) AS {k}_ratio" for k in ('positive', 'negative', 'neutral'))}, count(*) AS article_count FROM placed WHERE trade_date IS NOT NULL GROUP BY ALL)"
_MASKED = ", ".join(f"CASE WHEN coalesce(since, {seams.NEVER}) > {LOOKBACK[c] - 2} THEN {c} END AS {c}" for c in _FEATURES)
_MATRIX = f"""(WITH x AS (SELECT p.*, macd, macd_signal, g, l, since, CASE WHEN coalesce(ahead, {seams.NEVER}) > 5 THEN fwd END AS fwd_ret_5d, {', '.join(f'p.{_ret(k).replace("lag(close", "lag(p.close").replace(OVER, "OVER w")} AS ret_{k}d' for k in (1, 5, 21))},
    greatest(p.high - p.low, abs(p.high - lag(p.close) OVER w), abs(p.low - lag(p.close) OVER w)) AS tr, coalesce(sign(p.close - lag(p.close) OVER w), 0) * p.volume AS sv, row_number() OVER w AS rn
    FROM panel p JOIN {_MACD} m USING (date, ticker) JOIN {_RSI} r USING (date, ticker) JOIN {_SEAMED} s USING (date, ticker) WINDOW w AS (PARTITION BY p.ticker ORDER BY p.date)),
  y AS (SELECT date, ticker, {', '.join(_BARS)}, source, since, fwd_ret_5d, {', '.join(f'{e} AS {c}' for c, e in _FEATURES.items())} FROM x),
  z AS (SELECT date, ticker, {', '.join(_BARS)}, source, fwd_ret_5d, CASE WHEN fwd_ret_5d IS NOT NULL THEN (fwd_ret_5d > 0)::INT::DOUBLE END AS label_up_5d, {_MASKED} FROM y)
  SELECT z.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in NEWS_FEATURES)}, article_count IS NOT NULL AS has_news,
    CASE WHEN label_up_5d IS NULL THEN 'no_label' WHEN {' OR '.join(f'{c} IS NULL' for c in learning.TECHNICAL)} THEN 'feature_null' END AS exclusion
  FROM z LEFT JOIN {_NEWS} n USING (date, ticker))"""


@query(f"""SELECT date, ticker, source, day_of_week, article_count, has_news, exclusion, {', '.join(f'round({c}, 9) AS {c}' for c in _FINE)}, {rs('fwd_ret_5d', 'label_up_5d', *[c for c in _FEATURES if c not in ('day_of_week', *_FINE)], *[c for c in NEWS_FEATURES if c != 'article_count'])}
  FROM {_MATRIX}""")
def training_matrix(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _matrix(spark, sf)
    return matrix.select(*[nearest(c, 9 if c in _FINE else DIGITS).alias(c) if t == "double" else F.col(c) for c, t in matrix.dtypes])


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (exclusion = 'no_label') AS n_no_label, count(*) FILTER (exclusion = 'feature_null') AS n_feature_null,
  count(*) FILTER (exclusion IS NULL) AS n_kept, count(*) FILTER (exclusion IS NULL AND has_news) AS n_with_news, count(DISTINCT ticker) FILTER (exclusion IS NULL) AS n_tickers,
  min(date) FILTER (exclusion IS NULL) AS first_session, max(date) FILTER (exclusion IS NULL) AS last_session, {r('avg(label_up_5d) FILTER (exclusion IS NULL)', 'positive_share')} FROM {_MATRIX}""")
def matrix_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(learning.matrix_stats(_matrix(spark, sf), 5))


@query(f"WITH mx AS MATERIALIZED (SELECT * FROM {_MATRIX} WHERE label_up_5d IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_null FROM mx" for c in learning.TECHNICAL))
def feature_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return learning.null_counts(_matrix(spark, sf), 5)


_RANKED = "(SELECT date, row_number() OVER (ORDER BY date) - 1 AS rk, count(*) OVER () AS d FROM (SELECT DISTINCT date FROM panel))"


@query(f"""WITH x AS (SELECT *, d // 7 AS blk FROM {_RANKED}), f AS (SELECT i::INT AS fold FROM range(1, 6) g(i)), y AS (
  SELECT fold, 'train' AS role, date FROM x, f WHERE rk < fold * blk - 15 UNION ALL SELECT fold, 'validate', date FROM x, f WHERE rk >= fold * blk AND rk < CASE WHEN fold < 5 THEN (fold + 1) * blk ELSE d - blk - 15 END
  UNION ALL SELECT 0, 'final_train', date FROM x WHERE rk < d - blk - 15 UNION ALL SELECT 0, 'test', date FROM x WHERE rk >= d - blk)
  SELECT fold, role, count(*) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM y GROUP BY fold, role""")
def split_plan(spark: SparkSession, sf: str) -> DataFrame:
    dates = learning.with_date_rank(b.panel(spark, sf).select("date").distinct())
    plan = learning.split_plan(dates.count(), 5)
    return learning.fold_rows(dates, plan).groupBy("fold", "role").agg(F.count("*").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_SCORED = "(SELECT o_orderpriority AS g, ((o_orderkey * 7919) % 101) / 101.0::DOUBLE AS proba, (((o_orderkey * 104729) % 97) / 97.0::DOUBLE < ((o_orderkey * 7919) % 101) / 101.0::DOUBLE)::INT AS label FROM orders)"


@query(f"""WITH s AS (SELECT * FROM {_SCORED}), c AS (SELECT g, proba, count(*) AS m, sum(label) AS k FROM s GROUP BY ALL),
  u AS (SELECT *, sum(k) OVER w AS tp, sum(m) OVER w AS al, sum(k) OVER (PARTITION BY g) AS pp, sum(m - k) OVER (PARTITION BY g) AS nn FROM c WINDOW w AS (PARTITION BY g ORDER BY proba DESC)),
  v AS (SELECT *, tp / pp::DOUBLE AS rec, tp / al::DOUBLE AS pre FROM u), z AS (SELECT *, lag(rec, 1, 0.0) OVER w AS r0, lag(pre, 1, 1.0) OVER w AS p0 FROM v WINDOW w AS (PARTITION BY g ORDER BY proba DESC)),
  a AS (SELECT g, sum(k * (nn - (al - tp) + (m - k) / 2.0::DOUBLE)) / (max(pp) * max(nn))::DOUBLE AS roc_auc, sum((rec - r0) * (pre + p0) / 2) AS pr_auc FROM z GROUP BY g),
  b AS (SELECT g, count(*) AS n, avg(label) AS pos_rate, avg(pow(proba - label, 2)) AS brier, avg(-ln(CASE WHEN label = 1 THEN greatest(proba, 1e-9) ELSE 1 - greatest(proba, 1e-9) END)) AS log_loss,
    count(*) FILTER (proba >= 0.5 AND label = 1) / count(*) FILTER (proba >= 0.5)::DOUBLE AS precision, count(*) FILTER (proba >= 0.5 AND label = 1) / sum(label)::DOUBLE AS recall FROM s GROUP BY g)
  SELECT g, n, {rs('roc_auc', 'pr_auc', 'precision', 'recall', 'brier', 'log_loss', 'pos_rate')}, {r('2 * precision * recall / (precision + recall)', 'f1')} FROM a JOIN b USING (g)""")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    proba = ((k * 7919) % 101) / 101.0
    scored = b.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), proba.alias("proba"), (((k * 104729) % 97) / 97.0 < proba).cast("int").alias("label"))
    out = learning.classification_metrics(scored, ["g"])
    return rounded(out.select("g", "n", "roc_auc", "pr_auc", "precision", "recall", "brier", "log_loss", "pos_rate", "f1"))


@query()
def train_logistic(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _matrix(spark, sf).where("exclusion is null").cache()
    return rounded(learning.train(matrix, "logistic", 5, ["ret_5d", "vol_21d", "rsi_14", "close_to_sma20", "mean_sentiment"], folds=2)[1])


@query()
def train_boosted(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _matrix(spark, sf).where("exclusion is null").cache()
    rows = learning.with_date_rank(matrix)
    fitted = learning.boosted(["ret_5d", "vol_21d", "rsi_14"], "label_up_5d", 1.0, trees=5)
    weighted, _ = learning.balanced(rows.withColumn("label_up_5d", F.col("label_up_5d")), "label_up_5d")
    from pyspark.ml.functions import vector_to_array

    scored = fitted.fit(weighted).transform(rows).withColumn("proba", vector_to_array("probability")[1]).withColumnRenamed("label_up_5d", "label")
    return rounded(learning.classification_metrics(scored))


@query(f"SELECT {r('avg(y)', 'majority_proba')}, count(y) AS n FROM (SELECT ({_FWD[5]} > 0)::INT::DOUBLE AS y FROM panel)")
def majority(spark: SparkSession, sf: str) -> DataFrame:
    rows = outcomes.with_labels(b.panel(spark, sf), (5,)).where("label_up_5d is not null")
    return rounded(rows.agg(F.count("*").alias("n")).withColumn("majority_proba", F.lit(learning.majority(rows, "label_up_5d"))).select("majority_proba", "n"))


# --- backtest ------------------------------------------------------------------------------

_PRED = "(SELECT ticker, date, CASE WHEN (date - DATE '1995-01-01') % 11 = 0 THEN NULL ELSE ((date - DATE '1995-01-01') * 7 + length(ticker) * 13) % 100 / 100.0::DOUBLE END AS proba FROM panel WHERE date >= DATE '1996-01-01')"
_BT = f"""(WITH pr AS {_PRED}, grid AS (SELECT t.ticker, d.date, p.open, p.close, q.proba FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN (SELECT DISTINCT date FROM panel) d LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = d.date LEFT JOIN pr q ON q.ticker = t.ticker AND q.date = d.date),
  a AS (SELECT *, coalesce(last_value(CASE WHEN proba >= 0.55 THEN 1 WHEN proba <= 0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, lag(close) {OVER} AS pc FROM grid),
  c AS (SELECT *, coalesce(lag(pos) {OVER}, 0) AS prev_pos FROM a)
  SELECT ticker, date, pos, prev_pos, coalesce(CASE WHEN pos = 1 AND prev_pos = 0 THEN close / open - 1 WHEN pos = 1 AND prev_pos = 1 THEN close / pc - 1 WHEN pos = 0 AND prev_pos = 1 THEN open / pc - 1 END, 0) AS ret FROM c WHERE date >= (SELECT min(date) FROM pr))"""
_EQ = f"(SELECT date, sum(pos) AS n_long, sum(abs(pos - prev_pos)) / count(*)::DOUBLE AS turnover, sum(ret) / count(*) - sum(abs(pos - prev_pos)) / count(*)::DOUBLE * 10 / 10000 AS ret FROM {_BT} GROUP BY date)"


def _predictions(bars: DataFrame) -> DataFrame:
    n = F.datediff("date", F.lit("1995-01-01").cast("date"))
    return bars.where(F.col("date") >= "1996-01-01").select("ticker", "date", F.when(n % 11 != 0, (n * 7 + F.length("ticker") * 13) % 100 / 100.0).alias("proba"))


@query(f"SELECT ticker, date, pos, prev_pos, {rs('ret')} FROM {_BT}")
def backtest_positions(spark: SparkSession, sf: str) -> DataFrame:
    bars = b.panel(spark, sf)
    return rounded(backtest.positions(bars, _predictions(bars)))


@query(f"SELECT date, n_long::BIGINT AS n_long, {rs('turnover', 'ret')} FROM {_EQ}")
def backtest_equity(spark: SparkSession, sf: str) -> DataFrame:
    bars = b.panel(spark, sf)
    return rounded(backtest.equity(backtest.positions(bars, _predictions(bars))))


@query(f"""SELECT date, {r('avg(coalesce(rt, 0))', 'ret')} FROM (SELECT g.date, p.close / lag(p.close) OVER (PARTITION BY g.ticker ORDER BY g.date) - 1 AS rt
  FROM (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN (SELECT DISTINCT date FROM panel) d) g LEFT JOIN panel p ON p.ticker = g.ticker AND p.date = g.date) GROUP BY date""")
def buy_hold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.buy_and_hold(b.panel(spark, sf)))


@query(f"SELECT date, ticker, coalesce(({gated('avg', 'close', 20)} > {gated('avg', 'close', 50)})::INT::DOUBLE, 0.0) AS signal FROM panel")
def sma_signal(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.sma_signal(b.panel(spark, sf))


@query(f"""WITH e AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM {_EQ}), d AS (SELECT *, eq / max(eq) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
  SELECT count(*) AS n_days, {r('arg_max(eq, date) - 1', 'total_return')}, {r('pow(arg_max(eq, date), 252.0 / count(*)) - 1', 'cagr')}, {r('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe')},
  {r('avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252)', 'sortino')}, {r('min(dd)', 'max_drawdown')} FROM d""")
def performance(spark: SparkSession, sf: str) -> DataFrame:
    bars = b.panel(spark, sf)
    return rounded(backtest.performance(backtest.equity(backtest.positions(bars, _predictions(bars)))))


def _backtest_sql(predictions: str, entry: str, exit_: str) -> str:
    """Daily returns of signals, as ``_EQ`` has them, with other thresholds."""
    held = _BT.replace(_PRED, predictions).replace("proba >= 0.55", f"proba >= {entry}").replace("proba <= 0.5 ", f"proba <= {exit_} ")
    return _EQ.replace(_BT, held)


_RULE_SIGNAL = f"(SELECT date, ticker, coalesce(({gated('avg', 'close', 20)} > {gated('avg', 'close', 50)})::INT::DOUBLE, 0.0) AS proba FROM panel)"
_HOLD = """(SELECT date, avg(coalesce(rt, 0)) AS ret FROM (SELECT g.date, p.close / lag(p.close) OVER (PARTITION BY g.ticker ORDER BY g.date) - 1 AS rt
  FROM (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN (SELECT DISTINCT date FROM panel) d) g LEFT JOIN panel p ON p.ticker = g.ticker AND p.date = g.date) GROUP BY date)"""
_TEST = f"(SELECT min(date) AS a, max(date) AS b FROM {_PRED})"
_CURVES = f"""SELECT 'model' AS strategy, date, ret FROM {_EQ} UNION ALL SELECT 'buy_hold', date, ret FROM {_HOLD}, {_TEST} WHERE date BETWEEN a AND b
  UNION ALL SELECT 'sma_rule', date, ret FROM {_backtest_sql(f'(SELECT s.* FROM {_RULE_SIGNAL} s, {_TEST} WHERE date BETWEEN a AND b)', '0.5', '0.5')}"""


@query(f"""WITH c AS ({_CURVES}), e AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM c), d AS (SELECT *, eq / max(eq) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
  SELECT strategy, count(*) AS n_days, {r('arg_max(eq, date) - 1', 'total_return')}, {r('pow(arg_max(eq, date), 252.0 / count(*)) - 1', 'cagr')}, {r('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe')},
  {r('avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252)', 'sortino')}, {r('min(dd)', 'max_drawdown')} FROM d GROUP BY strategy""")
def backtest_report(spark: SparkSession, sf: str) -> DataFrame:
    bars = b.panel(spark, sf)
    return rounded(workflows.backtest_report(bars, _predictions(bars).withColumns({"horizon": F.lit(1), "split": F.lit("test")})))


# --- service -------------------------------------------------------------------------------


@query("SELECT date::VARCHAR AS date, ticker, open, high, low, close, volume FROM panel WHERE ticker = 'NATION_3' AND date BETWEEN DATE '1995-03-01' AND DATE '1997-03-01'")
def prices_of_ticker(spark: SparkSession, sf: str) -> DataFrame:
    return service.prices(b.panel(spark, sf), "nation_3", "1995-03-01", "1997-03-01").drop("source")


@query("SELECT DISTINCT ticker FROM panel")
def tickers(spark: SparkSession, sf: str) -> DataFrame:
    return service.tickers(b.panel(spark, sf))


@query(f"SELECT ticker, trade_date::VARCHAR AS trade_date, n_articles, {rs('sent_mean', 'sent_pos_share', 'sent_neg_share', 'sent_dispersion')} FROM {_SIGN} WHERE ticker = 'NATION_7' AND trade_date IS NOT NULL")
def sentiment_of_ticker(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(service.sentiment(news.daily_sign_sentiment(b.placed_articles(spark, sf)).where("trade_date is not null"), "nation_7"))


@query(f"SELECT ticker, date, {rs('close', 'change')} FROM (SELECT *, close / lag(close) {OVER} - 1 AS change, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM panel) WHERE n = 1")
def last_changes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(last_change(b.panel(spark, sf)))


# --- scoring -------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n_articles, count(DISTINCT headline) AS n_texts, {r('sum(coalesce((np - nn)::DOUBLE / nullif(np + nn, 0), 0))', 'sum_score')}, 0 AS n_unscored FROM {_LEX}")
def cached_scoring(spark: SparkSession, sf: str) -> DataFrame:
    articles = b.articles(spark, sf).drop("score", "label")
    half = articles.where("article_id % 2 = 0").withColumn("text_key", scoring.text_key(F.col("headline"), "lexicon"))
    cache = scoring.lexicon_scores(half.groupBy("text_key").agg(F.min("headline").alias("headline")))
    scored, full_cache = scoring.score_articles(articles, cache, scoring.lexicon_scores, "lexicon")
    totals = scored.agg(F.count("*").alias("n_articles"), F.sum("score").alias("sum_score"), F.count_if(F.col("score").isNull()).cast("int").alias("n_unscored"))
    return rounded(totals.join(full_cache.agg(F.count("*").alias("n_texts"))).select("n_articles", "n_texts", "sum_score", "n_unscored"))


@query("SELECT ticker, count(*) AS n_rows, min(published_at)::VARCHAR AS first, max(published_at)::VARCHAR AS last, count(DISTINCT published_at::DATE) AS n_days FROM placed GROUP BY ticker")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per-ticker coverage report."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return article_coverage(b.placed_articles(spark, sf)).select("ticker", "n_rows", text("first"), text("last"), "n_days")


@query(f"SELECT category, rank FROM {o.rows(tuple((c, i) for i, c in enumerate(CATEGORIES)), 'category, rank')}")
def categories(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, rank int")


@query("""SELECT horizon, objective, run_id, metric FROM (SELECT *, row_number() OVER (PARTITION BY horizon, objective ORDER BY metric DESC, created_at) AS n FROM (
  SELECT o_orderkey AS run_id, (o_orderkey % 3)::INT AS horizon, o_orderstatus AS objective, (o_orderkey % 1000) / 1000.0::DOUBLE AS metric, o_orderkey AS created_at FROM orders)) WHERE n = 1""")
def champions(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.sources.registry import champions_of

    k = F.col("o_orderkey")
    runs = b.read(spark, sf, "orders").select(k.alias("run_id"), (k % 3).cast("int").alias("horizon"), F.col("o_orderstatus").alias("objective"), ((k % 1000) / 1000.0).alias("metric"), k.alias("created_at"))
    return champions_of(runs).select("horizon", "objective", "run_id", "metric")


