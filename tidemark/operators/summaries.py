"""Grouped summaries of event outcomes, and comparisons of categories with OTHER."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import ADEQUATE_EVENTS, CATEGORIES, EXPLORATORY_EVENTS, EXPLORATORY_HORIZONS, MIN_EVENTS, MIN_OTHER_DATES, MIN_OVERLAP, MIN_TICKERS, OTHER, OUTCOME_HORIZONS, SHRINK_TICKERS
from tidemark.functions.maths import ratio
from tidemark.operators.statistics import benjamini_hochberg, difference, hac_means, shrink, tau_squared


def tier(n: str = "n_events_valid") -> Column:
    return F.when(F.col(n) >= ADEQUATE_EVENTS, "adequately_supported").when(F.col(n) >= EXPLORATORY_EVENTS, "exploratory").otherwise("insufficient")


def by_date(events: DataFrame, keys: Sequence[str], value: str = "abnormal_ret") -> DataFrame:
    """Mean of the valid values of each cell and session: (keys, horizon, date, pos, value).

    Summed in order of size: cells of the same values have the same mean however their rows arrive, so
    that the difference of two such cells is zero, not a rounding error that is then tested.
    """
    ordered = F.sort_array(F.collect_list(value))  # of one cell and session: bounded by the tickers
    mean = ratio(F.aggregate(ordered, F.lit(0.0), lambda total, x: total + x), F.count(value))
    return events.where("valid").groupBy(*keys, "horizon", "date", "pos").agg(mean.alias(value))


def describe(events: DataFrame, keys: Sequence[str], horizons: Sequence[int] = OUTCOME_HORIZONS, hac: bool = True) -> DataFrame:
    """One row for each (keys, horizon): counts, quantiles, shares and the HAC mean of the session means."""
    r = F.when(F.col("valid"), F.col("abnormal_ret"))
    quantile = F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = events.groupBy(*keys, "horizon").agg(
        F.count("*").alias("n_events_total"),
        F.count_if("valid").alias("n_events_valid"),
        F.countDistinct(F.when(F.col("valid"), F.col("ticker"))).alias("n_tickers"),
        F.countDistinct(F.when(F.col("valid"), F.col("date"))).alias("n_dates"),
        F.avg(r).alias("mean_abnormal_return"),
        quantile.alias("_q"),
        F.stddev_samp(r).alias("std_abnormal_return"),
        F.avg((r > 0).cast("double")).alias("pct_positive"),
        F.avg((r < 0).cast("double")).alias("pct_negative"),
    )
    out = out.withColumns(
        {
            "n_events_invalid": F.col("n_events_total") - F.col("n_events_valid"),
            "p25_abnormal_return": F.col("_q")[0],
            "median_abnormal_return": F.col("_q")[1],
            "p75_abnormal_return": F.col("_q")[2],
            "sufficient_sample": (F.col("n_events_valid") >= MIN_EVENTS) & (F.col("n_tickers") >= MIN_TICKERS),
            "exploratory_horizon": F.col("horizon").isin(*EXPLORATORY_HORIZONS),
            "nw_lag_sessions": F.greatest(F.col("horizon") - 1, F.lit(0)),
        }
    ).drop("_q")
    if not hac:
        return out
    means = hac_means(by_date(events, keys), keys, "abnormal_ret", horizons=horizons)
    means = means.select(*keys, "horizon", F.col("mean").alias("nw_mean"), F.col("se").alias("nw_se"), F.col("ci95_lo").alias("nw_ci95_lo"), F.col("ci95_hi").alias("nw_ci95_hi"))
    return out.join(means, [*keys, "horizon"], "left")


def versus_other(events: DataFrame, keys: Sequence[str] = (), horizons: Sequence[int] = OUTCOME_HORIZONS, emit_all: bool = True) -> DataFrame:
    """Each category against OTHER on the sessions both have, within ``keys``: paired differences.

    Estimates are null below the gate (events, tickers, shared sessions). With ``emit_all`` every
    category of every key and horizon gets a row.
    """
    cells = events.where("valid")
    sizes = cells.where(F.col("category") != OTHER).groupBy(*keys, "category", "horizon").agg(F.count("*").alias("n_events_category"), F.countDistinct("ticker").alias("n_tickers_category"))
    daily = by_date(events, [*keys, "category"])
    other = daily.where(F.col("category") == OTHER).select(*keys, "horizon", "date", F.col("abnormal_ret").alias("_other"))
    paired = daily.where(F.col("category") != OTHER).join(other, [*keys, "horizon", "date"]).withColumn("diff", F.col("abnormal_ret") - F.col("_other"))
    means = hac_means(paired, [*keys, "category"], "diff", horizons=horizons)
    named = ("mean", "se", "t_stat", "p_value", "ci95_lo", "ci95_hi")
    joined = sizes.join(means.withColumnRenamed("n", "n_overlapping_dates"), [*keys, "category", "horizon"], "left")
    if emit_all:
        spark = events.sparkSession
        grid = spark.createDataFrame([(c, h) for c in CATEGORIES if c != OTHER for h in horizons], "category string, horizon int")
        if keys:
            grid = events.select(*keys).distinct().join(F.broadcast(grid))  # cells of a report
        joined = grid.join(joined, [*keys, "category", "horizon"], "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events_category", "n_tickers_category", "n_overlapping_dates")})
    enough = (F.col("n_events_category") >= MIN_EVENTS) & (F.col("n_tickers_category") >= MIN_TICKERS) & (F.col("n_overlapping_dates") >= MIN_OVERLAP)
    out = joined.withColumn("sufficient_sample", enough).withColumn("exploratory_horizon", F.col("horizon").isin(*EXPLORATORY_HORIZONS))
    return out.withColumns({("diff_mean" if c == "mean" else c): F.when(F.col("sufficient_sample"), F.col(c)) for c in named}).drop("mean")


def category_versus_other(events: DataFrame, horizons: Sequence[int] = OUTCOME_HORIZONS) -> DataFrame:
    """Every category and horizon, one family of tests."""
    return benjamini_hochberg(versus_other(events, (), horizons), "p_value")


def sector_versus_other(events: DataFrame, horizons: Sequence[int] = OUTCOME_HORIZONS) -> DataFrame:
    """Within known sectors; one family of tests over all of them."""
    return benjamini_hochberg(versus_other(events.where("sector is not null"), ("sector",), horizons), "p_value")


def ticker_versus_other(events: DataFrame, horizons: Sequence[int] = OUTCOME_HORIZONS) -> DataFrame:
    """Each ticker's category sessions against its OTHER sessions without those: two independent HAC means.

    Estimates exist from two sessions on each side; only sufficient rows enter the tests, which
    form a family for each (category, horizon).
    """
    valid = events.where("valid").select("ticker", "category", "horizon", "date", "pos", "abnormal_ret")
    cats = valid.where(F.col("category") != OTHER)
    others = valid.where(F.col("category") == OTHER).drop("category")
    present = events.where(F.col("category") != OTHER).select("ticker", "category", "horizon").distinct()
    key = ["ticker", "category", "horizon"]
    spread = present.join(others, ["ticker", "horizon"])
    dates = cats.select(*key, "date").distinct()
    apart = spread.join(dates, [*key, "date"], "left_anti")
    once = lambda df: df.groupBy(*key, "date", "pos").agg(F.min("abnormal_ret").alias("abnormal_ret"))  # noqa: E731  one value a session
    mine = hac_means(once(cats), ["ticker", "category"], "abnormal_ret", horizons=horizons).select(*key, F.col("n").alias("n_cat_dates"), F.col("mean").alias("m_cat"), F.col("se").alias("se_cat"))
    base = hac_means(once(apart), ["ticker", "category"], "abnormal_ret", horizons=horizons).select(*key, F.col("n").alias("n_other_dates"), F.col("mean").alias("m_oth"), F.col("se").alias("se_oth"))
    sizes = cats.groupBy(*key).agg(F.count("*").alias("n_events_category"))
    same_day = spread.join(dates, [*key, "date"], "left_semi").groupBy(*key).agg(F.count("*").alias("n_same_day_overlap_excluded"))
    out = present.join(sizes, key, "left").join(mine, key, "left").join(base, key, "left").join(same_day, key, "left")
    zero = ("n_events_category", "n_other_dates", "n_cat_dates", "n_same_day_overlap_excluded")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    both = (F.col("n_cat_dates") >= 2) & (F.col("n_other_dates") >= 2)
    out = out.withColumns({c: F.when(both, F.col(c)) for c in ("m_cat", "se_cat", "m_oth", "se_oth")})
    out = difference(out, "m_cat", "se_cat", "n_cat_dates", "m_oth", "se_oth", "n_other_dates")
    enough = (F.col("n_events_category") >= ADEQUATE_EVENTS) & (F.col("n_other_dates") >= MIN_OTHER_DATES)
    out = out.withColumn("sufficient_sample", enough).withColumn("evidence_tier", tier("n_events_category")).withColumn("_p", F.when(enough, F.col("p_value")))
    return benjamini_hochberg(out, "_p", ["category", "horizon"]).drop("_p", "m_cat", "se_cat", "m_oth", "se_oth", "n_cat_dates")


def shrunk_summary(ticker_summary: DataFrame, category_summary: DataFrame) -> DataFrame:
    """Ticker means pulled towards the category mean; tau2 is fitted where SHRINK_TICKERS are adequately supported."""
    key = ["category", "horizon"]
    with_tier = ticker_summary.withColumn("evidence_tier", tier())
    fit = with_tier.where((F.col("evidence_tier") == "adequately_supported") & F.col("nw_se").isNotNull())
    spread = tau_squared(fit, key, "mean_abnormal_return", "nw_se").where(F.col("k") >= SHRINK_TICKERS).select(*key, "tau2")
    prior = category_summary.where("mean_abnormal_return is not null").select(*key, F.col("mean_abnormal_return").alias("_prior"))
    spread = spread.join(prior, key)
    joined = with_tier.join(F.broadcast(spread), key, "left")  # cells of a report
    return shrink(joined, F.col("_prior"), "mean_abnormal_return", "nw_se").drop("_prior")


def with_sector_baseline(summary: DataFrame, sector_summary: DataFrame) -> DataFrame:
    """Adds sector_mean, sector_nw_mean, sector_nw_se, sector_n_tickers, sector_sufficient of the ticker's sector."""
    ok = F.col("sufficient_sample")
    side = sector_summary.select(
        "sector",
        "category",
        "horizon",
        F.when(ok, F.col("mean_abnormal_return")).alias("sector_mean"),
        F.when(ok, F.col("nw_mean")).alias("sector_nw_mean"),
        F.when(ok, F.col("nw_se")).alias("sector_nw_se"),
        F.when(ok, F.col("n_tickers")).alias("sector_n_tickers"),
        ok.alias("sector_sufficient"),
    )
    return summary.join(side, ["sector", "category", "horizon"], "left").withColumn("sector_sufficient", F.coalesce("sector_sufficient", F.lit(False)))


def ranking(versus: DataFrame, shrunk: DataFrame, top: int | None = None) -> DataFrame:
    """Adequately supported, significant cells by size of their difference; ties by events, then names."""
    extra = shrunk.select("ticker", "category", "horizon", "shrunk_mean", "shrinkage_weight", "tau2", "n_tickers")
    eligible = versus.where((F.col("evidence_tier") == "adequately_supported") & F.col("significant_fdr"))
    joined = eligible.join(extra, ["ticker", "category", "horizon"], "left").withColumn("abs_diff_mean", F.abs("diff_mean"))
    order = [F.desc("abs_diff_mean"), F.desc("n_events_category"), F.col("ticker"), F.col("category"), F.col("horizon")]
    if top is not None:
        joined = joined.orderBy(*order).limit(top)
    return joined.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # significant cells only


def tier_counts(summary: DataFrame) -> DataFrame:
    """category, horizon and the number of cells in each evidence tier."""
    tiers = ["adequately_supported", "exploratory", "insufficient"]
    return summary.groupBy("category", "horizon").pivot("evidence_tier", tiers).count().na.fill(0, tiers)


def freshness(events: DataFrame, as_of: Column) -> DataFrame:
    """By horizon: valid and invalid counts, share valid, last valid date, days lost before the last event, staleness."""
    out = events.groupBy("horizon").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"), F.max("date").alias("last_event"), F.max(F.when(F.col("valid"), F.col("date"))).alias("last_valid"))
    return out.withColumns({"pct_valid": F.col("n_valid") / (F.col("n_valid") + F.col("n_invalid")), "days_lost": F.datediff("last_event", "last_valid"), "staleness_days": F.datediff(as_of, "last_valid")})
