"""Validation and repair of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import BAR, GAP_DAYS, MIN_PRICE, OUTLIER_MIN, OUTLIER_RATIO, OUTLIER_WINDOW, PRICES, SEAM_GAP, SEAM_LOG_TOLERANCE, SEAM_SESSIONS
from tidemark.functions.maths import ratio


def structural_reason(allow_zero_volume: bool = False) -> Column:
    """missing_value, invalid_bar or null."""
    missing = F.lit(False)
    for c in BAR:
        missing = missing | F.col(c).isNull() | F.isnan(c)
    bad = F.lit(False)
    for c in PRICES:
        bad = bad | (F.col(c) < MIN_PRICE)
    bad = bad | (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    bad = bad | (F.col("volume") < 0) | (F.lit(not allow_zero_volume) & (F.col("volume") == 0))
    return F.when(missing, "missing_value").when(bad, "invalid_bar")


def implausible(keys: tuple[str, ...] = ("ticker",)) -> Column:
    """Whether the close is beyond OUTLIER_RATIO times or parts of the centred rolling median.

    Fewer than OUTLIER_MIN neighbours or a median that is not positive flag nothing.
    """
    half = OUTLIER_WINDOW // 2
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(-half, half)
    middle = F.percentile("close", F.lit(0.5)).over(frame)
    known = (F.count("close").over(frame) >= OUTLIER_MIN) & (middle > 0)
    x = F.col("close") / middle
    return F.coalesce(known & ((x > OUTLIER_RATIO) | (x < 1 / OUTLIER_RATIO)), F.lit(False))


def judged_bars(bars: DataFrame, ordinal: str | None = None, allow_zero_volume: bool = False) -> DataFrame:
    """``bars`` with ``drop_reason``: missing_value, invalid_bar, implausible, duplicate_date or null (kept).

    The steps are sequential, as each one's window sees only what the one before it left: bars
    that are structurally sound, then plausible ones; of several for a date the last by
    ``ordinal`` (a source order; the whole bar where there is none) stays.
    """
    tie = [ordinal] if ordinal else list(BAR)
    first = bars.withColumn("_reason", structural_reason(allow_zero_volume))
    sound, unsound = first.where("_reason is null"), first.where("_reason is not null")
    sound = sound.withColumn("_odd", implausible()).withColumn("_reason", F.when(F.col("_odd"), "implausible")).drop("_odd")
    plain, odd = sound.where("_reason is null"), sound.where("_reason is not null")
    last = Window.partitionBy("ticker", "date").orderBy(*[F.col(c).desc() for c in tie])
    plain = plain.withColumn("_reason", F.when(F.row_number().over(last) > 1, "duplicate_date"))
    return unsound.unionByName(odd).unionByName(plain).withColumnRenamed("_reason", "drop_reason")


def valid_bars(bars: DataFrame, ordinal: str | None = None, allow_zero_volume: bool = False) -> DataFrame:
    return judged_bars(bars, ordinal, allow_zero_volume).where("drop_reason is null").drop("drop_reason")


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order`` (descending columns keep the last)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def adjusted(bars: DataFrame, adjusted_close: str = "adj_close") -> DataFrame:
    """Prices times adjusted close / close (1 where that is unknown); volume stays. Text is cast, errors become null."""
    number = {c: F.expr(f"try_cast({c} as double)") for c in (*BAR, adjusted_close)}
    factor = F.coalesce(ratio(number[adjusted_close], F.when(number["close"] > 0, number["close"])), F.lit(1.0))
    factor = F.when(F.isnan(factor) | (F.abs(factor) == float("inf")), F.lit(1.0)).otherwise(factor)
    return bars.withColumns({**{c: number[c] * factor for c in PRICES}, "volume": number["volume"]}).drop(adjusted_close)


def seam_factors(bars: DataFrame, seam_date: str) -> DataFrame:
    """ticker, factor for each ticker whose level steps at ``seam_date`` and stays there.

    The step is previous close / open at the seam; it counts beyond SEAM_GAP either way, and if
    the median of the next closes agrees with it within SEAM_LOG_TOLERANCE.
    """
    day = F.to_date(F.lit(seam_date))
    before = bars.where(F.col("date") < day).groupBy("ticker").agg(F.max_by("close", "date").alias("prev_close"))
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    after = bars.where(F.col("date") >= day).withColumn("_n", nth).where(F.col("_n") <= SEAM_SESSIONS).groupBy("ticker")
    after = after.agg(F.min_by("open", "date").alias("seam_open"), F.percentile("close", F.lit(0.5)).alias("level"), F.count("*").alias("_rows"))
    both = before.join(after, "ticker").where("_rows >= 2").withColumn("factor", ratio(F.col("prev_close"), F.col("seam_open")))
    steps = both.where((F.col("factor") >= SEAM_GAP) | (F.col("factor") <= 1 / SEAM_GAP))
    drift = F.abs(F.ln(ratio(ratio(F.col("prev_close"), F.col("level")), F.col("factor"))))
    return steps.where(drift <= F.ln(F.lit(SEAM_LOG_TOLERANCE))).select("ticker", "factor")


def without_seam(bars: DataFrame, seam_date: str) -> DataFrame:
    """Prices before a confirmed seam divided by its factor; volume stays."""
    joined = bars.join(seam_factors(bars, seam_date), "ticker", "left")
    hit = (F.col("date") < F.to_date(F.lit(seam_date))) & F.col("factor").isNotNull()
    return joined.withColumns({c: F.when(hit, F.col(c) / F.col("factor")).otherwise(F.col(c)) for c in PRICES}).drop("factor")


def gap_warnings(bars: DataFrame) -> DataFrame:
    """ticker, max_gap_days, wide_gap, n_zero_volume."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("ticker").orderBy("date")))
    out = bars.withColumn("_gap", gap).groupBy("ticker").agg(F.max("_gap").alias("max_gap_days"), F.count_if(F.col("volume") == 0).alias("n_zero_volume"))
    return out.withColumn("wide_gap", F.coalesce(F.col("max_gap_days") > GAP_DAYS, F.lit(False)))
