"""Settings of a run: which tickers and dates, where tables lie, what is trained; checked when they are made."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from tidemark.constants import COST_BPS, EMBARGO, ENTRY, EXIT, FOLDS, LABEL_HORIZONS


def tickers_of(names: Sequence[str]) -> tuple[str, ...]:
    """Trimmed upper-case tickers in their order; none, or one twice, is an error."""
    clean = tuple(n.strip().upper() for n in names if n.strip())
    if not clean:
        raise ValueError("a universe needs a ticker at least")
    if len(set(clean)) < len(clean):
        raise ValueError("a ticker occurs twice in the universe")
    return clean


def horizons_of(days: Sequence[int]) -> tuple[int, ...]:
    """Ascending horizons in trading days; none, one below 1, or one twice is an error."""
    if not days or min(days) < 1 or len(set(days)) < len(days):
        raise ValueError("horizons must be distinct positive numbers of trading days")
    return tuple(sorted(days))


@dataclass(frozen=True)
class Settings:
    tickers: tuple[str, ...]
    start: str
    end: str | None = None
    panel: str = "data/panel"
    artifacts: str = "data/artifacts"
    runs: str = "data/runs"
    min_price: float = 0.01
    allow_zero_volume: bool = False
    model: str = "logistic"
    objective: str = "classification"
    horizons: tuple[int, ...] = tuple(LABEL_HORIZONS)
    folds: int = FOLDS
    embargo: int = EMBARGO
    entry: float = ENTRY
    exit: float = EXIT
    cost_bps: float = COST_BPS
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "tickers", tickers_of(self.tickers))
        object.__setattr__(self, "horizons", horizons_of(self.horizons))
        if self.objective not in ("classification", "regression"):
            raise ValueError("the objective is classification or regression")


def settings_from(spark: SparkSession, path: str) -> Settings:
    """Settings of a JSON object that any of Spark's file systems holds; names that are not settings go to ``extra``."""
    got = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in Settings.__dataclass_fields__ and k != "extra"}
    return Settings(**known, extra={k: v for k, v in got.items() if k not in known})


def universe_from(spark: SparkSession, path: str, key: str = "tickers") -> tuple[str, ...]:
    """Tickers of a JSON universe file: a list, or an object with a list ``key``."""
    got = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    return tickers_of(got if isinstance(got, list) else got[key])
