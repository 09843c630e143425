"""Training matrices, purged splits, models, metrics and the training loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import EMBARGO, FOLDS, LABEL_HORIZONS, LOOKBACK, NEWS_FEATURES, SCALE_DEPENDENT
from tidemark.operators.indicators import indicators
from tidemark.operators.outcomes import with_labels
from tidemark.operators.seams import mask_features, with_seam_distance
from tidemark.schemas import feature_columns

TECHNICAL = [c for c in LOOKBACK if c not in SCALE_DEPENDENT]


# --- features ------------------------------------------------------------------------------


def build_features(bars: DataFrame, seams: DataFrame, sentiment: DataFrame | None = None, horizons: Sequence[int] = LABEL_HORIZONS, threshold: float = 0.0) -> DataFrame:
    """Indicators and labels, masked at seams, with optional daily sign sentiment (counts 0 where absent, measures null)."""
    placed = with_seam_distance(bars, seams)
    out = with_labels(mask_features(indicators(placed)), horizons, threshold, seams).drop("pos", "sessions_since_seam", "sessions_to_seam")
    if sentiment is not None:
        out = out.join(sentiment.withColumnRenamed("trade_date", "date"), ["ticker", "date"], "left").na.fill(0, ["n_articles"])
    return out


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def training_matrix(features: DataFrame, news: DataFrame, horizon: int, checked: bool = True) -> DataFrame:
    """Features left-joined with daily news (all five zero where absent), has_news, and ``exclusion``.

    ``exclusion`` is no_label, feature_null (given a label) or null for usable rows. The news must
    have one row for each (ticker, date); ``checked`` asserts it.
    """
    right = news.withColumnRenamed("trade_date", "date")
    if checked and not repeated_keys(right, ["ticker", "date"]).isEmpty():
        raise ValueError("several news rows for one ticker and date")
    out = features.join(right.select("ticker", "date", *NEWS_FEATURES), ["ticker", "date"], "left")
    out = out.withColumn("has_news", F.col("article_count").isNotNull()).na.fill(0, list(NEWS_FEATURES))
    empty = F.lit(False)
    for c in TECHNICAL:
        empty = empty | F.col(c).isNull()
    reason = F.when(F.col(f"label_up_{horizon}d").isNull(), "no_label").when(empty, "feature_null")
    return out.withColumn("exclusion", reason)


def matrix_stats(matrix: DataFrame, horizon: int) -> DataFrame:
    """One row: rows in, excluded by reason, kept, with news, tickers, first and last session, positive share."""
    ok = F.col("exclusion").isNull()
    return matrix.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("exclusion") == "no_label").alias("n_no_label"),
        F.count_if(F.col("exclusion") == "feature_null").alias("n_feature_null"),
        F.count_if(ok).alias("n_kept"),
        F.count_if(ok & F.col("has_news")).alias("n_with_news"),
        F.countDistinct(F.when(ok, F.col("ticker"))).alias("n_tickers"),
        F.min(F.when(ok, F.col("date"))).alias("first_session"),
        F.max(F.when(ok, F.col("date"))).alias("last_session"),
        F.avg(F.when(ok, F.col(f"label_up_{horizon}d"))).alias("positive_share"),
    )


def null_counts(matrix: DataFrame, horizon: int) -> DataFrame:
    """feature, n_null among labelled rows, most first."""
    known = matrix.where(F.col(f"label_up_{horizon}d").isNotNull())
    wide = known.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in TECHNICAL])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_null")) for c in TECHNICAL])
    return wide.select(F.explode(pairs).alias("x")).select("x.*").orderBy(F.desc("n_null"), "feature")


def resolve_features(columns: Sequence[str], kind: str = "auto") -> list[str]:
    """matrix (scale-free and news), legacy (all indicators and sign sentiment), or what the columns allow."""
    legacy = [c for c in (*LOOKBACK, "n_articles", "sent_mean", "sent_pos_share", "sent_neg_share", "sent_dispersion", "ewma_sent") if c in columns]
    matrix = [c for c in (*TECHNICAL, *NEWS_FEATURES) if c in columns]
    if kind == "auto":
        kind = "matrix" if set(NEWS_FEATURES) <= set(columns) else "legacy"
    if kind not in ("matrix", "legacy"):
        raise ValueError(f"unknown feature set {kind!r}")
    return matrix if kind == "matrix" else legacy


# --- splits --------------------------------------------------------------------------------


def purge_gap(horizon: int, embargo: int = EMBARGO) -> int:
    if horizon < 1 or embargo < 0:
        raise ValueError("horizon must be positive and embargo not negative")
    return horizon + embargo


@dataclass(frozen=True)
class SplitPlan:
    """Date ranks of an expanding walk-forward: per fold (train below, validate from, validate below), and the test block."""

    folds: tuple[tuple[int, int, int], ...]
    final_train_below: int
    test_from: int


def split_plan(n_dates: int, horizon: int, folds: int = FOLDS, embargo: int = EMBARGO) -> SplitPlan:
    gap, block = purge_gap(horizon, embargo), n_dates // (folds + 2)
    if block <= gap or n_dates - block - gap <= folds * block:
        raise ValueError("too few dates for these folds, horizon and embargo")
    test = n_dates - block
    rows = []
    for i in range(1, folds + 1):
        stop = (i + 1) * block if i < folds else test - gap
        rows.append((i * block - gap, i * block, stop))
    return SplitPlan(tuple(rows), test - gap, test)


def with_date_rank(rows: DataFrame) -> DataFrame:
    """``rows`` with date_rank (0 first), ranked on the distinct dates only."""
    dates = rows.select("date").distinct().withColumn("date_rank", F.row_number().over(Window.orderBy("date")) - 1)
    return rows.join(F.broadcast(dates), "date")


def fold_rows(ranked: DataFrame, plan: SplitPlan) -> DataFrame:
    """fold, role, date_rank rows: train and validate of each fold, final_train and test as fold 0."""
    r = F.col("date_rank")
    parts = []
    for i, (below, start, stop) in enumerate(plan.folds, 1):
        parts.append(F.when(r < below, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role"))))
        parts.append(F.when((r >= start) & (r < stop), F.struct(F.lit(i).alias("fold"), F.lit("validate").alias("role"))))
    parts.append(F.when(r < plan.final_train_below, F.struct(F.lit(0).alias("fold"), F.lit("final_train").alias("role"))))
    parts.append(F.when(r >= plan.test_from, F.struct(F.lit(0).alias("fold"), F.lit("test").alias("role"))))
    return ranked.withColumn("_x", F.explode(F.array_compact(F.array(*parts)))).select("*", "_x.fold", "_x.role").drop("_x")


# --- metrics -------------------------------------------------------------------------------


def classification_metrics(scored: DataFrame, keys: Sequence[str] = (), label: str = "label", proba: str = "proba") -> DataFrame:
    """Exact metrics of each group: roc_auc and pr_auc (null for one class), precision, recall, f1, balanced accuracy,
    brier, log_loss, pos_rate, n. Rows are first counted by distinct score; curves run over those."""
    group = [F.lit(0).alias("_g")] if not keys else list(keys)
    names = ["_g"] if not keys else list(keys)
    base = scored.select(*group, F.col(label).cast("double").alias("y"), F.greatest(F.least(F.col(proba), F.lit(1 - 1e-9)), F.lit(1e-9)).alias("p"))
    hit = F.col("p") >= 0.5
    pos = F.col("y") == 1
    flat = base.groupBy(*names).agg(
        F.count("*").alias("n"),
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        F.avg(-F.when(pos, F.ln("p")).otherwise(F.ln(1 - F.col("p")))).alias("log_loss"),
        F.avg("y").alias("pos_rate"),
    )
    counts = base.groupBy(*names, "p").agg(F.count("*").cast("double").alias("m"), F.sum("y").alias("k"))
    down = Window.partitionBy(*names).orderBy(F.desc("p"))
    all_ = Window.partitionBy(*names)
    curve = counts.withColumn("tp_", F.sum("k").over(down)).withColumn("all_", F.sum("m").over(down)).withColumn("P", F.sum("k").over(all_)).withColumn("N", F.sum(F.col("m") - F.col("k")).over(all_))
    curve = curve.withColumn("rec", F.try_divide("tp_", "P")).withColumn("pre", F.col("tp_") / F.col("all_"))
    curve = curve.withColumn("rec0", F.lag("rec", 1, 0.0).over(down)).withColumn("pre0", F.lag("pre", 1, 1.0).over(down))
    below = F.col("N") - (F.col("all_") - F.col("tp_"))  # negatives scored lower
    area = curve.groupBy(*names).agg(
        F.sum(F.col("k") * (below + (F.col("m") - F.col("k")) / 2)).alias("_u"),
        F.max("P").alias("_P"),
        F.max("N").alias("_N"),
        F.sum((F.col("rec") - F.col("rec0")) * (F.col("pre") + F.col("pre0")) / 2).alias("_pr"),
    )
    two = (F.col("_P") > 0) & (F.col("_N") > 0)
    out = flat.join(area, names).withColumns({"roc_auc": F.when(two, F.col("_u") / (F.col("_P") * F.col("_N"))), "pr_auc": F.when(two, F.col("_pr"))})
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("tp") + F.col("fn"))})
    out = out.withColumn("f1", zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    specificity = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    sensitivity = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumn("balanced_accuracy", F.coalesce((specificity + sensitivity) / 2, specificity, sensitivity))
    return out.drop("_u", "_P", "_N", "_pr", "_g", "tp", "fp", "fn", "tn")


def fold_summary(metrics: DataFrame, names: Sequence[str] = ("roc_auc", "pr_auc", "precision", "recall", "f1", "balanced_accuracy", "brier", "log_loss", "pos_rate")) -> DataFrame:
    """Mean and population deviation over folds of each metric, and the total of rows."""
    return metrics.agg(*[f(c).alias(f"{c}_{s}") for c in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))], F.sum("n").alias("n_total"))


# --- models --------------------------------------------------------------------------------


def _assembled(features: Sequence[str], scale: bool) -> list[Any]:
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"_{c}" for c in features]
    stages: list[Any] = [Imputer(strategy="median", relativeError=0.0, inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "_x", handleInvalid="keep")]
    return stages + ([StandardScaler(withMean=True, inputCol="_raw", outputCol="_x")] if scale else [])


def logistic(features: Sequence[str], label: str, weights: float) -> Any:
    """L2 logistic regression, C = 0.5 on balanced weights (column ``_w``); ``weights`` is their sum."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=2000, regParam=1 / (0.5 * max(weights, 1.0)), elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[*_assembled(features, True), model])


def boosted(features: Sequence[str], label: str, weights: float, trees: int = 300) -> Any:
    """Gradient-boosted trees: the analogue of leaf-wise boosting with 31 leaves."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=trees, stepSize=0.05, maxDepth=5, minInstancesPerNode=50, subsamplingRate=0.9, seed=42)
    return Pipeline(stages=[*_assembled(features, False), model])


MODELS: dict[str, Callable[..., Any]] = {"logistic": logistic, "boosted": boosted, "boosted_small": lambda f, y, w: boosted(f, y, w, 200)}


def model(name: str, features: Sequence[str], label: str, weights: float, objective: str = "classification") -> Any:
    if objective == "regression":
        raise NotImplementedError("regression is declared but has no model")
    if objective != "classification" or name not in MODELS:
        raise ValueError(f"unknown model {name!r} or objective {objective!r}")
    return MODELS[name](features, label, weights)


def balanced(rows: DataFrame, label: str) -> tuple[DataFrame, float]:
    """Rows with weight n / (2 n_class), and the sum of weights."""
    g = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    n = sum(g.values())
    w = F.lit(1.0)
    for y, k in g.items():
        w = F.when(F.col(label) == y, F.lit(n / (len(g) * k))).otherwise(w)
    return rows.withColumn("_w", w), float(n)


def majority(train: DataFrame, label: str) -> float:
    """The constant probability of the majority baseline: the share of positives in training."""
    return float(train.agg(F.avg(label)).first()[0] or 0.0)


def fit_predict(name: str, train: DataFrame, score: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    weighted, total = balanced(train, label)
    fitted = model(name, features, label, total).fit(weighted)
    return fitted.transform(score).withColumn("proba", vector_to_array("probability")[1])


def train(matrix: DataFrame, name: str, horizon: int, features: Sequence[str] | None = None, folds: int = FOLDS, embargo: int = EMBARGO) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics by fold): walk-forward folds, then a final fit scored on the test block.

    Predictions have date, ticker, horizon, proba, label, split (fold number or test). The majority
    baseline is fitted once, on rows up to the largest fold's training end.
    """
    label = f"label_up_{horizon}d"
    rows = with_date_rank(matrix.where(F.col(label).isNotNull()))
    features = list(features or [c for c in resolve_features(matrix.columns) if c in feature_columns(matrix.schema)])
    rows = rows.withColumns({c: F.col(c).cast("double") for c in features})
    plan = split_plan(rows.agg(F.max("date_rank")).first()[0] + 1, horizon, folds, embargo)
    rank = F.col("date_rank")
    out = None
    jobs = [(str(i), rank < below, (rank >= a) & (rank < b)) for i, (below, a, b) in enumerate(plan.folds, 1)] + [("test", rank < plan.final_train_below, rank >= plan.test_from)]
    for split, fit_on, score_on in jobs:
        part = fit_predict(name, rows.where(fit_on), rows.where(score_on), features, label)
        part = part.select("date", "ticker", F.lit(horizon).alias("horizon"), "proba", F.col(label).alias("label"), F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    base = majority(rows.where(rank < plan.folds[-1][0]), label)
    metrics = classification_metrics(out, ["split"]).withColumn("majority_proba", F.lit(base))
    return out, metrics
