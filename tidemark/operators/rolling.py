"""Overlapping windows over event time: is an effect stable?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import CATEGORY_STRIDE, OTHER, OUTCOME_HORIZONS, ROLL_EVENTS, ROLL_TICKER_EVENTS, ROLL_TICKER_MIN, ROLL_TICKERS, STRENGTHEN, TICKER_STRIDE, TREND_WINDOWS, WEAKEN, WINDOW_DAYS
from tidemark.operators.statistics import benjamini_hochberg, difference, direction
from tidemark.operators.summaries import describe, versus_other


def window_grid(events: DataFrame, days: int = WINDOW_DAYS, stride: int = CATEGORY_STRIDE) -> DataFrame:
    """k, window_start, window_end: windows that end on the last date and every ``stride`` days before, wholly inside the data.

    k counts back from the newest (0). The grid is computed from two dates.
    """
    span = events.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    room = F.datediff("hi", "lo") - (days - 1)
    k = F.explode(F.when(room >= 0, F.sequence(F.lit(0), F.floor(room / stride).cast("int"))).otherwise(F.array().cast("array<int>")))
    ends = span.select("hi", k.alias("k")).withColumn("window_end", F.date_sub("hi", F.col("k") * stride))
    return ends.select("k", F.date_sub("window_end", days - 1).alias("window_start"), "window_end")


def non_overlapping(days: int = WINDOW_DAYS, stride: int = CATEGORY_STRIDE) -> Column:
    """Whether window k is one of the disjoint ones chosen backwards from the newest."""
    return F.col("k") % -(-days // stride) == 0


def in_windows(events: DataFrame, days: int = WINDOW_DAYS, stride: int = CATEGORY_STRIDE, of: DataFrame | None = None) -> DataFrame:
    """Events (a selection of the events ``of`` that span the grid) once for each window that holds them, with its k and bounds; the ids follow from the date by arithmetic."""
    span = (events if of is None else of).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    back = F.datediff("_hi", "date")  # window k covers back in [k stride, k stride + days - 1]
    newest = F.floor(back / stride)
    oldest = F.greatest(F.ceil((back - (days - 1)) / stride), F.lit(0))
    last = F.floor((F.datediff("_hi", "_lo") - (days - 1)) / stride)
    ids = F.when(oldest <= F.least(newest, last), F.sequence(oldest, F.least(newest, last))).otherwise(F.array().cast("array<bigint>"))
    out = events.join(F.broadcast(span)).withColumn("k", F.explode(ids)).withColumn("k", F.col("k").cast("int"))
    out = out.withColumn("window_end", F.date_sub("_hi", F.col("k") * stride)).withColumn("window_start", F.date_sub("window_end", days - 1))
    return out.drop("_lo", "_hi")


def rolling_categories(events: DataFrame, horizons: Sequence[int] = OUTCOME_HORIZONS, days: int = WINDOW_DAYS, stride: int = CATEGORY_STRIDE) -> DataFrame:
    """One row for each window, category and horizon with events: own statistics, paired comparison with OTHER, one exploratory family."""
    keys = ["k", "window_start", "window_end"]
    inside = in_windows(events.select("ticker", "category", "horizon", "date", "pos", "abnormal_ret", "valid"), days, stride)
    own = describe(inside, [*keys, "category"], horizons).withColumnRenamed("sufficient_sample", "phase1_gate_sufficient")
    own = own.withColumn("window_sufficient", (F.col("n_events_valid") >= ROLL_EVENTS) & (F.col("n_tickers") >= ROLL_TICKERS)).withColumn("own_direction", direction("nw_ci95_lo", "nw_ci95_hi"))
    vs = versus_other(inside, keys, horizons, emit_all=False)
    vs = vs.select(*keys, "category", "horizon", *[F.col(c).alias(f"vs_other_{c}") for c in ("n_overlapping_dates", "diff_mean", "se", "p_value", "ci95_lo", "ci95_hi")], F.col("sufficient_sample").alias("vs_other_sufficient"))
    out = own.join(vs, [*keys, "category", "horizon"], "left").withColumn("vs_other_sufficient", F.coalesce("vs_other_sufficient", F.lit(False)))
    out = out.withColumn("vs_other_direction", F.when(F.col("category") == OTHER, "n/a").otherwise(direction("vs_other_ci95_lo", "vs_other_ci95_hi")))
    out = out.withColumn("_p", F.when(F.col("vs_other_sufficient") & F.col("window_sufficient"), F.col("vs_other_p_value")))
    return benjamini_hochberg(out, "_p", flag="vs_other_significant_fdr_exploratory", size="n_tests_in_rolling_family").drop("_p")


def densest(keys: Sequence[str], days: int = WINDOW_DAYS) -> Column:
    """Events from this row's date on within ``days`` days (rows need ``_day``, days since the epoch)."""
    return F.count("*").over(Window.partitionBy(*keys).orderBy("_day").rangeBetween(0, days - 1))


def dense_pairs(events: DataFrame, least: int = ROLL_TICKER_EVENTS, days: int = WINDOW_DAYS) -> DataFrame:
    """ticker, category pairs that reach ``least`` events in some window: others can never qualify."""
    once = events.select("ticker", "category", "date").distinct().withColumn("_day", F.unix_date("date"))
    return once.withColumn("_n", densest(("ticker", "category"), days)).groupBy("ticker", "category").agg(F.max("_n").alias("max_in_window")).where(F.col("max_in_window") >= least)


def rolling_tickers(events: DataFrame, candidates: DataFrame, horizons: Sequence[int] = OUTCOME_HORIZONS, days: int = WINDOW_DAYS, stride: int = TICKER_STRIDE) -> DataFrame:
    """Per window, ticker, category and horizon with ROLL_TICKER_MIN valid events (or a candidate): statistics and tier."""
    named = candidates.select("ticker", "category").distinct()
    pairs = dense_pairs(events, days=days).select("ticker", "category").unionByName(named).distinct()
    some = events.select("ticker", "category", "horizon", "date", "pos", "abnormal_ret", "valid").join(pairs, ["ticker", "category"], "left_semi")
    keys = ["k", "window_start", "window_end", "ticker", "category"]
    out = describe(in_windows(some, days, stride, of=events), keys, horizons)
    # A candidate has a row in every window, even an empty one: its sparsity is a finding.
    spark = events.sparkSession
    cells = window_grid(events, days, stride).join(F.broadcast(named)).join(spark.createDataFrame([(h,) for h in horizons], "horizon int"))
    cells = cells.withColumn("phase2_candidate", F.lit(True))
    out = out.join(cells, [*keys, "horizon"], "full").withColumn("phase2_candidate", F.coalesce("phase2_candidate", F.lit(False)))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events_total", "n_events_valid", "n_events_invalid", "n_tickers", "n_dates")})
    n = F.col("n_events_valid")
    out = out.where((n >= ROLL_TICKER_MIN) | F.col("phase2_candidate"))
    return out.withColumns(
        {
            "window_sufficient": n >= ROLL_TICKER_EVENTS,
            "evidence_tier": F.when(n >= ROLL_TICKER_EVENTS, "exploratory").when(n >= ROLL_TICKER_MIN, "sparse").otherwise("insufficient"),
            "own_direction": direction("nw_ci95_lo", "nw_ci95_hi"),
        }
    ).drop("sufficient_sample")


METRICS = {
    "vs_other_diff": ("vs_other_diff_mean", "vs_other_se", "vs_other_ci95_lo", "vs_other_ci95_hi", "vs_other_n_overlapping_dates", "vs_other_sufficient"),
    "own_nw_mean": ("nw_mean", "nw_se", "nw_ci95_lo", "nw_ci95_hi", "n_dates", None),
}


def temporal_change(rolling: DataFrame, days: int = WINDOW_DAYS, stride: int = CATEGORY_STRIDE) -> DataFrame:
    """Per metric, category and horizon: first against last of the disjoint, sufficient windows."""
    parts = []
    for metric, (mean, se, lo, hi, n, gate) in METRICS.items():
        rows = rolling if metric == "own_nw_mean" else rolling.where(F.col("category") != OTHER)
        ok = F.col("window_sufficient") & (F.coalesce(F.col(gate), F.lit(False)) if gate else F.lit(True))
        x = rows.select("category", "horizon", "k", "window_end", "n_events_valid", "window_sufficient", F.col(mean).alias("m"), F.col(se).alias("s"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(n).cast("long").alias("n"), ok.alias("ok"))
        parts.append(x.withColumn("metric", F.lit(metric)))
    x = parts[0].unionByName(parts[1])
    usable = F.col("ok") & F.col("m").isNotNull() & non_overlapping(days, stride)
    side = F.struct("window_end", "m", "s", "lo", "hi", "n")
    g = x.groupBy("metric", "category", "horizon").agg(
        F.count("*").alias("n_windows_total"),
        F.count_if("window_sufficient").alias("n_windows_sufficient"),
        F.count_if(non_overlapping(days, stride)).alias("n_nonoverlapping_windows"),
        F.count_if(usable).alias("n_nonoverlapping_sufficient"),
        F.max("window_end").alias("recent_window_end"),
        F.max_by("ok", "window_end").alias("recent_window_sufficient"),
        F.max_by("n_events_valid", "window_end").alias("recent_n_events_valid"),
        F.max_by("m", "window_end").alias("recent_estimate"),
        F.min_by(F.when(usable, side), F.when(usable, F.col("window_end"))).alias("e"),
        F.max_by(F.when(usable, side), F.when(usable, F.col("window_end"))).alias("l"),
    )
    enough = F.col("n_nonoverlapping_sufficient") >= TREND_WINDOWS
    for part, name in (("e", "early"), ("l", "late")):
        for field in ("window_end", "m", "s", "lo", "hi", "n"):
            g = g.withColumn(f"{name}_{field}", F.when(enough, F.col(part)[field]))
    g = difference(g, "late_m", "late_s", "late_n", "early_m", "early_s", "early_n")
    disjoint = F.coalesce((F.col("early_hi") < F.col("late_lo")) | (F.col("late_hi") < F.col("early_lo")), F.lit(False))
    g = g.withColumn("intervals_disjoint", disjoint).withColumn("change_label", F.when(~enough, "insufficient_windows").otherwise(change_label()))
    g = g.withColumn("recent_status", F.when(F.col("recent_window_sufficient"), "assessable").otherwise("insufficient_recent_data"))
    g = benjamini_hochberg(g, "p_value", flag="diff_significant_fdr", size="n_tests_in_change_family")
    g = g.withColumn("change_established", F.col("diff_significant_fdr") & F.col("intervals_disjoint"))
    names = {"early_m": "early_estimate", "late_m": "late_estimate", "diff_mean": "diff_late_minus_early", "se": "diff_se", "t_stat": "diff_t_stat", "p_value": "diff_p_value", "ci95_lo": "diff_ci95_lo", "ci95_hi": "diff_ci95_hi"}
    return g.withColumnsRenamed(names).drop("e", "l", "early_s", "early_lo", "early_hi", "early_n", "late_s", "late_lo", "late_hi", "late_n")


def change_label() -> Column:
    """A sign change before any ratio: reversed only if both intervals exclude zero, else direction_unstable."""
    e, l = F.col("early_m"), F.col("late_m")
    excluded = (direction("early_lo", "early_hi") != "inconclusive") & (direction("late_lo", "late_hi") != "inconclusive")
    size = F.abs(l) / F.when(F.abs(e) > 0, F.abs(e))
    return (
        F.when(e.isNull() | l.isNull(), "inconclusive")
        .when(F.signum(e) * F.signum(l) < 0, F.when(excluded, "reversed").otherwise("direction_unstable"))
        .when(F.abs(e) <= 0, F.when(F.abs(l) > 0, "strengthened").otherwise("broadly_consistent"))
        .when(size >= STRENGTHEN, "strengthened")
        .when(size <= WEAKEN, "weakened")
        .otherwise("broadly_consistent")
    )


def established_on_both(change: DataFrame) -> DataFrame:
    """category, horizon of the cells whose change is established on the raw mean and on the difference."""
    of = lambda m: change.where((F.col("metric") == m) & F.col("change_established")).select("category", "horizon")
    return of("own_nw_mean").join(of("vs_other_diff"), ["category", "horizon"], "left_semi")


def concentration(events: DataFrame, candidates: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """For each candidate (ticker, category, horizon): how much of its mean rests on few events, and how dense it ever was."""
    key = ["ticker", "category", "horizon"]
    last = events.agg(F.max("date").alias("_last"))
    v = events.where("valid").join(F.broadcast(candidates.select(*key)), key).join(F.broadcast(last)).withColumn("_day", F.unix_date("date"))
    cell = Window.partitionBy(*key)
    v = v.withColumn("_mean", F.avg("abnormal_ret").over(cell)).withColumn("_n", densest(key, days))
    v = v.withColumn("_rank", F.row_number().over(cell.orderBy(F.desc(F.abs(F.col("abnormal_ret") - F.col("_mean"))), F.col("date"))))
    r = F.col("abnormal_ret")
    g = v.groupBy(*key).agg(
        F.count("*").alias("n_events_valid"),
        F.avg(r).alias("mean_abnormal_return"),
        F.avg(F.when(F.col("_rank") > 1, r)).alias("mean_excl_most_extreme"),
        F.avg(F.when(F.col("_rank") > 3, r)).alias("mean_excl_3_most_extreme"),
        F.max(F.when(F.col("_rank") == 1, r)).alias("largest_event_return"),
        F.max(F.when(F.col("_rank") == 1, F.col("date"))).alias("largest_event_date"),
        F.sum(F.abs(r)).alias("_abs"),
        F.max("_n").alias("max_events_in_window"),
        F.count_if(F.col("date") >= F.date_sub("_last", days - 1)).alias("n_recent"),
    )
    change = F.abs(F.col("mean_excl_most_extreme") - F.col("mean_abnormal_return")) / F.when(F.col("mean_abnormal_return") != 0, F.abs("mean_abnormal_return")) * 100
    g = g.withColumn("pct_change_excl_most_extreme", F.round(change, 1)).withColumn("largest_share_of_sum_pct", F.round(F.abs("largest_event_return") / F.when(F.col("_abs") > 0, F.col("_abs")) * 100, 1)).drop("_abs")
    out = candidates.select(*key).join(g, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events_valid", "max_events_in_window", "n_recent")})
    dominated = F.coalesce(F.col("pct_change_excl_most_extreme") >= 25.0, F.lit(False)) | (F.col("n_events_valid") < 30)
    out = out.withColumn("event_dominated", dominated)
    verdict = (
        F.when(F.col("n_events_valid") == 0, "no valid events")
        .when(F.col("max_events_in_window") < ROLL_TICKER_EVENTS, "insufficient evidence for rolling assessment")
        .when(F.col("n_recent") < ROLL_TICKER_EVENTS, "historically assessable, recent stability not assessable")
        .when(F.col("event_dominated"), "assessable, sensitive to single events")
        .otherwise("assessable, not dominated by single events")
    )
    return out.withColumn("verdict", verdict)
