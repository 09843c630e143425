"""Technical indicators: one ordered window per ticker serves them all."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.maths import by, full, ratio, trailing


def spec() -> WindowSpec:
    """Rows of a ticker in date order (built on use: a window needs a running session)."""
    return by("ticker")


def returns(k: int) -> Column:
    return ratio(F.col("close"), F.lag("close", k).over(spec())) - 1


def volatility(rows: int, of: str = "ret_1d") -> Column:
    return full(F.stddev_samp(of), F.col(of), spec(), rows)


def sma(rows: int, of: str = "close") -> Column:
    return full(F.avg(of), F.col(of), spec(), rows)


def bollinger_z(rows: int = 20) -> Column:
    spread = full(F.stddev_samp("close"), F.col("close"), spec(), rows)
    return ratio(F.col("close") - sma(rows), spread)


def true_range() -> Column:
    """Largest of the day's range and its distances to the previous close; the first row has the range only."""
    prev = F.lag("close").over(spec())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def obv_delta(rows: int = 5) -> Column:
    """Sum of signed volume over the last ``rows`` rows (needs ``signed_volume``); null for the first ``rows`` rows."""
    return F.when(F.row_number().over(spec()) > rows, F.sum("signed_volume").over(trailing(spec(), rows)))


def volume_z(rows: int = 21) -> Column:
    return ratio(F.col("volume") - sma(rows, "volume"), full(F.stddev_samp("volume"), F.col("volume"), spec(), rows))


def exponential(bars: DataFrame, columns: Mapping[str, tuple[str, float]], keys: tuple[str, ...] = ("ticker",), order: str = "date") -> DataFrame:
    """``bars`` plus exponentially weighted means {name: (input, alpha)}, without adjustment.

    y = (1 - alpha) y + alpha x from the first value on; g missing values between two weaken
    the old one by (1 - alpha)^(g + 1), and missing rows carry y on. The recursion is linear in
    the rows of one series, which built-in windows are not, so each series is one Arrow group
    (the daily bars of one ticker: bounded by its trading days). Later columns may use earlier ones.
    """
    schema = T.StructType([*bars.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").copy()
        for name, (of, alpha) in columns.items():
            part[name] = part[of].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=False).mean()
        return part[schema.names]

    return bars.groupBy(*keys).applyInPandas(run, schema)


def span(n: int) -> float:
    return 2.0 / (n + 1)


def with_rsi(bars: DataFrame, rows: int = 14) -> DataFrame:
    """rsi_{rows} from Wilder means of gains and losses; null while losses are zero."""
    change = F.col("close") - F.lag("close").over(spec())
    moved = bars.withColumn("_up", F.greatest(change, F.lit(0.0)) + change * 0).withColumn("_down", F.greatest(-change, F.lit(0.0)) + change * 0)
    smooth = exponential(moved, {"_gain": ("_up", 1 / rows), "_loss": ("_down", 1 / rows)})
    strength = ratio(F.col("_gain"), F.col("_loss"))
    return smooth.withColumn(f"rsi_{rows}", 100 - 100 / (1 + strength)).drop("_up", "_down", "_gain", "_loss")


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    means = exponential(bars, {"_fast": ("close", span(fast)), "_slow": ("close", span(slow))})
    line = exponential(means.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow"), {"macd_signal": ("macd", span(signal))})
    return line.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def indicators(bars: DataFrame) -> DataFrame:
    """All 23 indicators and day_of_week (Monday 0), each null until its window is full."""
    change = F.col("close") - F.lag("close").over(spec())
    base = bars.withColumns({"ret_1d": returns(1), "ret_5d": returns(5), "ret_21d": returns(21), "_tr": true_range(), "signed_volume": F.coalesce(F.signum(change), F.lit(0.0)) * F.col("volume")})
    out = with_macd(with_rsi(base)).withColumns(
        {
            "vol_21d": volatility(21),
            "vol_63d": volatility(63),
            "sma_20": sma(20),
            "sma_50": sma(50),
            "bb_zscore_20": bollinger_z(),
            "atr_14": full(F.avg("_tr"), F.col("_tr"), spec(), 14),
            "volume_zscore_21": volume_z(),
            "obv_delta_5d": obv_delta(),
            "_vol_mean": sma(21, "volume"),
            "day_of_week": F.weekday("date"),
        }
    )
    close = F.when(F.col("close") != 0, F.col("close"))
    out = out.withColumns(
        {
            "sma_ratio_20_50": ratio(F.col("sma_20"), F.col("sma_50")) - 1,
            "close_to_sma20": ratio(F.col("close"), F.col("sma_20")) - 1,
            "close_to_sma50": ratio(F.col("close"), F.col("sma_50")) - 1,
            **{f"{c}_norm": ratio(F.col(c), close) for c in ("macd", "macd_signal", "macd_hist")},
            "atr_pct": ratio(F.col("atr_14"), close),
            "obv_delta_norm": ratio(F.col("obv_delta_5d"), F.col("_vol_mean") * 5),
        }
    )
    return out.drop("_tr", "_vol_mean", "signed_volume")


def sma_signal(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """date, ticker, signal: 1.0 while the fast mean is above the slow one, else 0.0 (warm-up included)."""
    return bars.select("date", "ticker", F.coalesce((sma(fast) > sma(slow)).cast("double"), F.lit(0.0)).alias("signal"))


def carried_sentiment(daily: DataFrame, of: str = "sent_mean", n: int = 5) -> DataFrame:
    """``daily`` (a row for each session, null where nothing was published) with ewma_sent, carried over gaps."""
    return exponential(daily, {"ewma_sent": (of, span(n))})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column, as null is the only missing value here."""
    kinds = (T.DoubleType, T.FloatType)
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, kinds)})


