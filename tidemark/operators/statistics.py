"""Inference: HAC means over irregular sessions, false-discovery control, shrinkage, differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import FDR_Q, Z95
from tidemark.functions.maths import ratio, t_two_sided


def hac_means(series: DataFrame, keys: Sequence[str], value: str, pos: str = "pos", horizons: Sequence[int] = (1,)) -> DataFrame:
    """(keys, horizon) -> n, mean, se, t_stat, p_value, ci95_lo, ci95_hi of series with one row a session.

    Newey-West with Bartlett weights 1 - k/(L+1), L = horizon - 1, where only observations exactly
    k sessions apart count. The weights are linear in the distance, so the sum over earlier
    observations within L sessions needs only their sum and position-weighted sum, each the
    difference of two running sums: no self-join, and no frame that is summed again for each row.
    Positions are stretched by M / horizon, M the least common multiple of the horizons, so that
    one literal frame serves all of them in one pass.
    """
    multiple = math.lcm(*horizons)
    cell = Window.partitionBy(*keys, "horizon")
    r = series.where(F.col("horizon").isin(*horizons))
    r = r.withColumn("_mean", F.avg(value).over(cell)).withColumn("_p", (F.col(pos) - F.min(pos).over(cell)).cast("long"))
    r = r.withColumn("_r", F.col(value) - F.col("_mean")).withColumn("_at", F.col("_p") * (F.lit(multiple) / F.col("horizon")).cast("long"))
    upto = lambda c, back: F.coalesce(F.sum(c).over(cell.orderBy("_at").rangeBetween(Window.unboundedPreceding, -back)), F.lit(0.0))
    r = r.withColumn("_rp", F.col("_r") * F.col("_p"))
    r = r.withColumns({f"_{c}_{k}": upto(c, back) for c in ("_r", "_rp") for k, back in (("near", 1), ("far", multiple))})
    s0, s1 = F.col("__r_near") - F.col("__r_far"), F.col("__rp_near") - F.col("__rp_far")
    r = r.withColumn("_c", 2 * F.col("_r") * (s0 * (1 - F.col("_p") / F.col("horizon")) + s1 / F.col("horizon")))
    out = r.groupBy(*keys, "horizon").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_r") * F.col("_r") + F.col("_c")).alias("_v"))
    se = F.when(F.col("n") >= 2, F.sqrt(F.greatest(F.col("_v") / F.col("n"), F.lit(0.0)) / F.col("n")))
    return with_t(out.withColumn("se", se).drop("_v"), "mean", "n")


def with_t(rows: DataFrame, mean: str, n: str) -> DataFrame:
    """Adds t_stat, p_value (Student, n - 1), ci95_lo, ci95_hi (normal) for ``mean`` and ``se``.

    Without a standard error all are null; with a zero one only the interval has a value, the mean.
    """
    t = F.when(F.col("se") > 0, F.col(mean) / F.col("se"))
    df = F.greatest(F.col(n) - 1, F.lit(1)).cast("long")
    return rows.withColumn("t_stat", t).withColumns(
        {"p_value": t_two_sided(F.col("t_stat"), df), "ci95_lo": F.col(mean) - Z95 * F.col("se"), "ci95_hi": F.col(mean) + Z95 * F.col("se")}
    )


def benjamini_hochberg(rows: DataFrame, p: str, family: Sequence[str] = (), q: float = FDR_Q, flag: str = "significant_fdr", size: str = "n_tests_in_family") -> DataFrame:
    """Step-up flags within each family; null p-values are neither tested nor flagged. p = 0 can be flagged.

    Families are report-sized (cells, not observations); without keys there is one.
    """
    group = [F.lit(0).alias("_f")] if not family else [F.col(c) for c in family]
    tested = rows.where(F.col(p).isNotNull()).select(*group, F.col(p).alias("_p"))
    keys = ["_f"] if not family else list(family)
    ranked = tested.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))).withColumn("_m", F.count("*").over(Window.partitionBy(*keys)))
    limit = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_p") <= F.col("_rank") / F.col("_m") * q, F.col("_p"))).alias("_limit"), F.max("_m").alias("_m"))
    if family:
        joined = rows.join(limit, list(family), "left")
    else:
        joined = rows.join(F.broadcast(limit.drop("_f")), how="left")
    return joined.withColumn(flag, F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False))).withColumn(size, F.coalesce("_m", F.lit(0)).cast("long")).drop("_limit", "_m")


def difference(rows: DataFrame, mean_a: str, se_a: str, n_a: str, mean_b: str, se_b: str, n_b: str) -> DataFrame:
    """Adds diff_mean = a - b of two independent means with se, t_stat, p_value (min n - 1) and interval."""
    se = F.sqrt(F.pow(F.col(se_a), 2) + F.pow(F.col(se_b), 2))
    out = rows.withColumn("diff_mean", F.col(mean_a) - F.col(mean_b)).withColumn("se", se).withColumn("_n", F.least(n_a, n_b))
    return with_t(out, "diff_mean", "_n").drop("_n")


def tau_squared(rows: DataFrame, keys: Sequence[str], mean: str, se: str) -> DataFrame:
    """(keys) -> tau2, k: DerSimonian-Laird spread of true effects; rows with se 0 or null are left out."""
    w = F.when(F.col(se) > 0, 1 / F.pow(F.col(se), 2))
    known = rows.withColumn("_w", w).where(F.col("_w").isNotNull() & F.col(mean).isNotNull())
    centre = known.withColumn("_centre", F.sum(F.col("_w") * F.col(mean)).over(Window.partitionBy(*keys)) / F.sum("_w").over(Window.partitionBy(*keys)))
    sums = centre.groupBy(*keys).agg(
        F.sum(F.col("_w") * F.pow(F.col(mean) - F.col("_centre"), 2)).alias("_q"), F.sum("_w").alias("_w1"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"), F.count("*").alias("k")
    )
    c = F.col("_w1") - F.col("_w2") / F.col("_w1")
    return sums.select(*keys, F.when(c > 0, F.greatest(F.lit(0.0), (F.col("_q") - (F.col("k") - 1)) / c)).otherwise(F.lit(0.0)).alias("tau2"), "k")


def direction(lo: str, hi: str) -> Column:
    """positive or negative where the interval excludes zero, else inconclusive."""
    return F.when(F.col(lo) > 0, "positive").when(F.col(hi) < 0, "negative").otherwise("inconclusive")


def shrink(rows: DataFrame, prior: Column, mean: str, se: str) -> DataFrame:
    """shrinkage_weight = tau2 / (tau2 + se^2) and shrunk_mean towards ``prior``; the raw mean where there is no tau2."""
    w = F.when((F.col(se) > 0) & F.col("tau2").isNotNull(), ratio(F.col("tau2"), F.col("tau2") + F.pow(F.col(se), 2)))
    return rows.withColumn("shrinkage_weight", w).withColumn("shrunk_mean", F.coalesce(prior + F.col("shrinkage_weight") * (F.col(mean) - prior), F.col(mean)))
