"""Next-session backtest of probability signals, benchmarks and performance figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import COST_BPS, ENTRY, EXIT
from tidemark.functions.maths import by, ratio


def dense_grid(prices: DataFrame) -> DataFrame:
    """Every ticker at every panel date, null where it has no bar. Tickers x trading days."""
    dates, tickers = prices.select("date").distinct(), prices.select("ticker").distinct()
    return tickers.join(F.broadcast(dates)).join(prices, ["ticker", "date"], "left")


def position(entry: float = ENTRY, exit_: float = EXIT) -> Column:
    """1 while long: the last decisive signal before today (long at or above ``entry``, flat at or below ``exit_``)."""
    signal = F.when(F.col("proba") >= entry, 1).when(F.col("proba") <= exit_, 0)
    return F.coalesce(F.last(signal, ignorenulls=True).over(by("ticker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def positions(prices: DataFrame, predictions: DataFrame, entry: float = ENTRY, exit_: float = EXIT) -> DataFrame:
    """ticker, date, pos, prev_pos, ret: what each ticker earns on each session from the first signal on.

    A signal of day T acts on T + 1: on entry from open to close, while held from close to close,
    on exit from the previous close to the open. A null signal holds. A missing price earns 0.
    """
    spec = by("ticker")
    grid = dense_grid(prices.select("ticker", "date", "open", "close")).join(predictions.select("ticker", "date", "proba"), ["ticker", "date"], "left")
    first = predictions.agg(F.min("date").alias("_first"))
    moved = grid.withColumn("pos", position(entry, exit_)).withColumn("_prev_close", F.lag("close").over(spec))
    moved = moved.withColumn("prev_pos", F.coalesce(F.lag("pos").over(spec), F.lit(0)))
    ret = (
        F.when((F.col("pos") == 1) & (F.col("prev_pos") == 0), ratio(F.col("close"), F.col("open")) - 1)
        .when((F.col("pos") == 1) & (F.col("prev_pos") == 1), ratio(F.col("close"), F.col("_prev_close")) - 1)
        .when((F.col("pos") == 0) & (F.col("prev_pos") == 1), ratio(F.col("open"), F.col("_prev_close")) - 1)
    )
    out = moved.withColumn("ret", F.coalesce(ret, F.lit(0.0))).join(F.broadcast(first))
    return out.where(F.col("date") >= F.col("_first")).select("ticker", "date", "pos", "prev_pos", "ret")


def equity(held: DataFrame, cost_bps: float = COST_BPS) -> DataFrame:
    """date, n_long, turnover, ret (after costs): equal weight over all tickers of the panel."""
    n = F.count("*")
    turnover = F.sum(F.abs(F.col("pos") - F.col("prev_pos"))) / n
    return held.groupBy("date").agg(F.sum("pos").alias("n_long"), turnover.alias("turnover"), (F.sum("ret") / n - turnover * cost_bps / 1e4).alias("ret"))


def buy_and_hold(prices: DataFrame, start: Column | None = None) -> DataFrame:
    """date, ret: mean close-to-close return between adjacent panel dates over all tickers, missing as 0."""
    change = ratio(F.col("close"), F.lag("close").over(by("ticker"))) - 1
    out = dense_grid(prices.select("ticker", "date", "close")).withColumn("_r", F.coalesce(change, F.lit(0.0))).groupBy("date").agg(F.avg("_r").alias("ret"))
    return out if start is None else out.where(F.col("date") >= start)


def performance(returns: DataFrame) -> DataFrame:
    """One row: n_days, total_return, cagr (252 a year), sharpe, sortino, max_drawdown (peak from the first value on).

    The cumulative window runs over one return a day, some 250 rows a year.
    """
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("_eq", F.product(1 + F.col("ret")).over(upto)).withColumn("_draw", F.col("_eq") / F.max("_eq").over(upto) - 1)
    g = curve.agg(
        F.count("*").alias("n_days"),
        F.max_by("_eq", "date").alias("_end"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_std"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("_down"),
        F.min("_draw").alias("max_drawdown"),
    )
    year = F.sqrt(F.lit(252.0))
    return g.select(
        "n_days",
        (F.col("_end") - 1).alias("total_return"),
        F.when(F.col("_end") > 0, F.pow(F.col("_end"), F.lit(252.0) / F.col("n_days")) - 1).alias("cagr"),
        F.coalesce(ratio(F.col("_mean"), F.when(F.col("_std") > 0, F.col("_std"))) * year, F.lit(0.0)).alias("sharpe"),
        F.coalesce(ratio(F.col("_mean"), F.when(F.col("_down") > 0, F.col("_down"))) * year, F.lit(0.0)).alias("sortino"),
        "max_drawdown",
    )
