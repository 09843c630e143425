"""Forward returns, labels, and benchmark-adjusted outcomes with reasons for what cannot be used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import LABEL_HORIZONS, OUTCOME_HORIZONS
from tidemark.functions.maths import by, ratio
from tidemark.operators.seams import forward_masked, with_seam_distance


def positional_return(k: int) -> Column:
    """Close k rows later over close, minus 1, on the ticker's own rows."""
    return ratio(F.lead("close", k).over(by("ticker")), F.col("close")) - 1


def label_up(forward: Column, threshold: float = 0.0) -> Column:
    return F.when(forward.isNotNull(), (forward > threshold).cast("double"))


def with_labels(bars: DataFrame, horizons: Sequence[int] = LABEL_HORIZONS, threshold: float = 0.0, seams: DataFrame | None = None) -> DataFrame:
    """fwd_ret_{k}d and label_up_{k}d; null at the end of a series and, with ``seams``, across one."""
    if seams is not None and "sessions_to_seam" not in bars.columns:
        bars = with_seam_distance(bars, seams)
    for k in horizons:
        forward = positional_return(k)
        bars = bars.withColumn(f"fwd_ret_{k}d", forward if seams is None else F.when(~forward_masked(k), forward))
    return bars.withColumns({f"label_up_{k}d": label_up(F.col(f"fwd_ret_{k}d"), threshold) for k in horizons})


def calendar_returns(bars: DataFrame, calendar: DataFrame, horizons: Sequence[int], keys: tuple[str, ...] = ("ticker",), carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, pos, horizon, carry, close, close_then, fwd_ret): both ends are sessions of the shared calendar.

    A missing bar at T + h gives null, never the next bar there is. Each bar is matched with the
    bar h positions on by an equality join on (keys, position), one row for each horizon.
    """
    placed = bars.join(F.broadcast(calendar), "date").select(*keys, "date", "pos", "close", *carry)  # calendar: trading days
    now = placed.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("then_pos", F.col("pos") + F.col("horizon"))
    then = placed.select(*keys, F.col("pos").alias("then_pos"), F.col("close").alias("close_then"))
    joined = now.join(then, [*keys, "then_pos"], "left")
    return joined.select(*keys, "date", "pos", "horizon", *carry, "close", "close_then", (ratio(F.col("close_then"), F.col("close")) - 1).alias("fwd_ret"))


def abnormal_returns(panel: DataFrame, benchmark: DataFrame, calendar: DataFrame, seams: DataFrame, horizons: Sequence[int] = OUTCOME_HORIZONS) -> DataFrame:
    """Long outcomes: ticker, date, source, horizon, pos, stock_ret, benchmark_ret, abnormal_ret, valid, reason.

    ``reason`` is the first that applies of beyond_calendar, missing_price (stock or benchmark, at
    either end) and seam; the three returns are null unless valid. Only bars that exist get rows.
    """
    stock = calendar_returns(panel, calendar, horizons, carry=("source",))
    mark = calendar_returns(benchmark.select("date", "close", F.lit("*").alias("ticker")), calendar, horizons)
    mark = mark.select("pos", "horizon", F.col("fwd_ret").alias("b_ret"))  # sessions x horizons
    last = calendar.agg(F.max("pos").alias("last_pos"))
    # A seam at calendar position s spoils the returns from T < s to T + h >= s.
    spoiled = _seam_positions(panel, calendar, seams)
    joined = stock.join(F.broadcast(mark), ["pos", "horizon"], "left").join(F.broadcast(last)).join(spoiled, "ticker", "left")
    crossed = F.coalesce(F.exists("seam_list", lambda s: (s > F.col("pos")) & (s <= F.col("pos") + F.col("horizon"))), F.lit(False))
    missing = F.col("fwd_ret").isNull() | F.col("b_ret").isNull()
    reason = F.when(F.col("pos") + F.col("horizon") > F.col("last_pos"), "beyond_calendar").when(missing, "missing_price").when(crossed, "seam")
    out = joined.withColumn("reason", reason).withColumn("crosses_seam", crossed)
    ok = F.col("reason").isNull()
    out = out.withColumns({"valid": ok, "stock_ret": F.when(ok, F.col("fwd_ret")), "benchmark_ret": F.when(ok, F.col("b_ret")), "abnormal_ret": F.when(ok, F.col("fwd_ret") - F.col("b_ret"))})
    return out.select("ticker", "date", "source", "horizon", "pos", "stock_ret", "benchmark_ret", "abnormal_ret", "valid", "reason", "crosses_seam", F.col("fwd_ret").isNull().alias("stock_missing"), F.col("b_ret").isNull().alias("benchmark_missing"))


def _seam_positions(panel: DataFrame, calendar: DataFrame, seams: DataFrame) -> DataFrame:
    """ticker, seam_list: calendar positions of each ticker's seams (moved to the next session)."""
    sources = panel.select("ticker", F.lower("source").alias("_source")).distinct()
    s = seams.select(F.col("source").alias("s_source"), F.col("ticker").alias("s_ticker"), "seam_date")
    mine = sources.join(F.broadcast(s), (F.col("_source") == F.col("s_source")) & (F.col("s_ticker").isNull() | (F.upper("ticker") == F.col("s_ticker")))).select("ticker", "seam_date").distinct()
    days = mine.select("seam_date").distinct().join(F.broadcast(calendar)).where("date >= seam_date").groupBy("seam_date").agg(F.min("pos").alias("seam_pos"))
    return mine.join(F.broadcast(days), "seam_date").where("seam_pos > 0").groupBy("ticker").agg(F.collect_set("seam_pos").alias("seam_list"))


def wide(outcomes: DataFrame, horizons: Sequence[int] = OUTCOME_HORIZONS) -> DataFrame:
    """One row a bar with stock_fwd_ret_{h}d, benchmark_fwd_ret_{h}d, abnormal_ret_{h}d, valid_{h}d."""
    names = {"stock_ret": "stock_fwd_ret", "benchmark_ret": "benchmark_fwd_ret", "abnormal_ret": "abnormal_ret", "valid": "valid"}
    picks = [F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{n}_{h}d") for h in horizons for c, n in names.items()]
    return outcomes.groupBy("date", "ticker", "source").agg(*picks)


def outcome_sanity(outcomes: DataFrame) -> DataFrame:
    """By horizon: rows, valid rows, rows by reason, correlation with the benchmark, mean returns."""
    count = lambda r: F.count_if(F.col("reason") == r)
    return outcomes.groupBy("horizon").agg(
        F.count("*").alias("n_rows"),
        F.count_if("valid").alias("n_valid"),
        count("beyond_calendar").alias("n_beyond_calendar"),
        count("missing_price").alias("n_missing_price"),
        count("seam").alias("n_seam"),
        F.corr("stock_ret", "benchmark_ret").alias("corr"),
        F.avg("stock_ret").alias("mean_stock"),
        F.avg("benchmark_ret").alias("mean_benchmark"),
        F.avg("abnormal_ret").alias("mean_abnormal"),
    )


def event_reason() -> Column:
    """Reason of an invalid event: calendar, then seam, then the stock's and last the benchmark's price."""
    return (
        F.when(F.col("valid"), F.lit(None).cast("string"))
        .when(F.col("reason") == "beyond_calendar", "beyond_calendar")
        .when(F.col("crosses_seam"), "seam")
        .when(F.col("stock_missing"), "missing_stock_price")
        .otherwise("missing_benchmark_price")
    )
