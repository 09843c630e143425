import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.maths import t_two_sided
from tidemark.operators import learning, statistics


def test_t_p_values(spark):
    cases = [(2.0, 10, 0.0733880), (1.0, 1, 0.5), (2.5758, 1001, 0.0101440), (0.0, 5, 1.0), (3.0, 2, 0.0954660), (40.0, 300, 0.0)]
    got = spark.createDataFrame([(t, df) for t, df, _ in cases], "t double, df long").select(t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    for (_, _, want), row in zip(cases, got, strict=True):
        assert row["p"] == pytest.approx(want, abs=2e-5) and row["p"] >= 0


def _hac(values, positions, h):
    n, m = len(values), sum(values) / len(values)
    r = [v - m for v in values]
    var = sum(x * x for x in r) / n
    for i in range(n):
        for j in range(n):
            k = positions[j] - positions[i]
            if 1 <= k < h:
                var += 2 * (1 - k / h) * r[i] * r[j] / n
    return m, math.sqrt(max(var, 0) / n)


def test_hac_equals_pair_sums(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for key in ("a", "b"):
        for h in (1, 5, 20):
            pos = sorted(rng.sample(range(300), 60))
            val = [rng.gauss(0, 1) for _ in pos]
            rows += [(key, h, p, v) for p, v in zip(pos, val, strict=True)]
            want[key, h] = _hac(val, pos, h)
    df = spark.createDataFrame(rows, "key string, horizon int, pos int, x double")
    for row in statistics.hac_means(df, ["key"], "x", horizons=(1, 5, 20)).collect():
        m, se = want[row["key"], row["horizon"]]
        assert row["mean"] == pytest.approx(m) and row["se"] == pytest.approx(se)


def test_hac_single_and_constant(spark):
    df = spark.createDataFrame([("a", 1, 0, 2.0), ("b", 1, 0, 3.0), ("b", 1, 4, 3.0)], "key string, horizon int, pos int, x double")
    got = {r["key"]: r for r in statistics.hac_means(df, ["key"], "x", horizons=(1,)).collect()}
    assert got["a"]["se"] is None and got["a"]["p_value"] is None
    assert got["b"]["se"] == 0 and got["b"]["t_stat"] is None and got["b"]["ci95_lo"] == 3.0


def test_false_discovery(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.04), (3, 0.9), (4, None)], "i int, p double")
    got = {r["i"]: (r["significant_fdr"], r["n_tests_in_family"]) for r in statistics.benjamini_hochberg(df, "p").collect()}
    assert got == {1: (True, 3), 2: (True, 3), 3: (False, 3), 4: (False, 3)}


def test_tau_is_zero_for_equal_effects(spark):
    df = spark.createDataFrame([("c", 0.1, 0.2)] * 5 + [("d", float(i), 0.01) for i in range(5)], "c string, m double, s double")
    got = {r["c"]: r["tau2"] for r in statistics.tau_squared(df, ["c"], "m", "s").collect()}
    assert got["c"] == 0 and got["d"] > 1


def test_split_geometry():
    plan = learning.split_plan(700, 5, folds=5, embargo=10)
    for below, start, stop in plan.folds:
        assert below == start - 15 and start < stop
    assert plan.folds[-1][2] == plan.test_from - 15 == plan.final_train_below
    with pytest.raises(ValueError):
        learning.split_plan(60, 21)
    with pytest.raises(ValueError):
        learning.purge_gap(0)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.2)], "label int, proba double")
    row = learning.classification_metrics(df).first()
    assert row["roc_auc"] == pytest.approx(0.75) and row["precision"] == pytest.approx(2 / 3) and row["recall"] == 1.0
    # points (recall, precision): (0,1) (.5,1) (.5,.5) (1,2/3) (1,.5)
    assert row["pr_auc"] == pytest.approx(0.5 + 0.5 * (0.5 + 2 / 3) / 2)
    assert learning.classification_metrics(df.where("label = 1")).first()["roc_auc"] is None
