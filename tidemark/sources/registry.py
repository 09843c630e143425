"""Runs, backtests and champions as append-only tables: no update in place is needed."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import RUNS


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs; later columns of newer files are merged in, and an absent folder is an empty table."""
    try:
        return spark.read.schema(RUNS).option("mergeSchema", "true").parquet(folder)
    except Exception as error:  # only an absent path is empty
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], RUNS)
        raise


def record(spark: SparkSession, folder: str, model: str, objective: str, horizon: int | None, metric: float | None, payload: dict[str, Any]) -> str:
    """Appends a run (or a backtest) and returns its id."""
    run_id = uuid.uuid4().hex[:12]
    row = (run_id, model, objective, horizon, metric, datetime.now(UTC).replace(tzinfo=None), json.dumps(payload, sort_keys=True, default=str))
    spark.createDataFrame([row], RUNS).write.mode("append").parquet(folder)
    return run_id


def latest_run(runs: DataFrame, model: str | None = None, horizon: int | None = None) -> DataFrame:
    """The newest run of a model and horizon; runs without a horizon are of horizon 1."""
    if model is not None:
        runs = runs.where(F.col("model") == model)
    if horizon is not None:
        runs = runs.where(F.coalesce("horizon", F.lit(1)) == horizon)
    return runs.orderBy(F.desc("created_at"), "run_id").limit(1)


def last_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "run_id").limit(n)


def champions_of(runs: DataFrame) -> DataFrame:
    """The best run for each (horizon, objective): only a strictly better one replaces an earlier one."""
    names = [c for c in runs.columns if c not in ("horizon", "objective")]
    known = runs.where(F.col("metric").isNotNull())
    # Highest metric first, then the earliest: the minimum of (-metric, created_at).
    best = known.groupBy("horizon", "objective").agg(F.min_by(F.struct(*names), F.struct(-F.col("metric"), F.col("created_at"))).alias("x"))
    return best.select("horizon", "objective", "x.*")


def champion(runs: DataFrame, horizon: int, objective: str) -> DataFrame:
    return champions_of(runs.where((F.col("horizon") == horizon) & (F.col("objective") == objective)))
