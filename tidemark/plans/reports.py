"""Texts from collected summary rows; facts never come here, only report-sized tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

BARS = "▁▂▃▄▅▆▇█"


def percent(x: float | None, digits: int = 2) -> str:
    return "n/a" if x is None or x != x else f"{100 * x:.{digits}f}%"


def sparkline(values: Iterable[float | None]) -> str:
    values = list(values)
    known = [v for v in values if v is not None and v == v]
    if not known:
        return ""
    low, span = min(known), (max(known) - min(known)) or 1.0
    return "".join(" " if v is None or v != v else BARS[min(int((v - low) / span * len(BARS)), len(BARS) - 1)] for v in values)


def markdown(title: str, table: DataFrame, columns: Sequence[str], top: int = 120, notes: Sequence[str] = ()) -> str:
    """A titled table of at most ``top`` rows, in the table's order."""
    rows = table.select(*columns).limit(top).collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", *notes, *([""] if notes else []), "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def in_order(table: DataFrame) -> DataFrame:
    """``table`` in the order that outputs have: by ticker and date, then whatever else keys it. For sinks only."""
    keys = [c for c in ("ticker", "date", "trade_date", "category", "horizon", "split") if c in table.columns]
    return table.orderBy(*keys) if keys else table


def write_phase(folder: str, name: str, tables: dict[str, DataFrame], summary: dict[str, Any]) -> None:
    """Versioned tables in order and a JSON summary; without any rows only the summary is written and stale tables go.

    All files are reached through Hadoop's file systems, so the folder may be in any store.
    """
    for key, table in tables.items():
        path = f"{folder}/{name}_{key}_v1.parquet"
        if table.isEmpty():
            _file(table.sparkSession, path, lambda fs, at: fs.delete(at, True))
        else:
            in_order(table).write.mode("overwrite").parquet(path)
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    text = json.dumps(summary, sort_keys=True, default=str).encode()

    def put(fs: Any, at: Any) -> None:
        out = fs.create(at, True)
        out.write(bytearray(text))
        out.close()

    _file(spark, f"{folder}/{name}_v1.json", put)


def _file(spark: SparkSession, path: str, do: Callable[[Any, Any], Any]) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)
