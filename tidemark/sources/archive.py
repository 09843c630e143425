"""A zip of one CSV a ticker: unzipped in Arrow batches, then adjusted, ordered and repaired as columns."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import adjusted, keep_last, without_seam
from tidemark.sources.panel import in_dates

FOLDER = "full_history/"
RAW = "ticker string, ordinal long, date string, open string, high string, low string, close string, adj_close string, volume string"


def members(names: Iterable[str]) -> list[str]:
    """Members that are price files: CSVs of the folder, without the junk that archivers add."""
    return [n for n in names if n.startswith(FOLDER) and n.endswith(".csv") and "__MACOSX" not in n and not n.rsplit("/", 1)[-1].startswith(".")]


def raw_rows(spark: SparkSession, path: str, tickers: Iterable[str] | None = None) -> DataFrame:
    """Rows of all members as text, with the ticker of the file name and the row's place in the file."""
    wanted = {t.strip().upper() for t in tickers} if tickers is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in members(z.namelist()):
                        ticker = name.rsplit("/", 1)[-1][:-4].upper()
                        if wanted is not None and ticker not in wanted:
                            continue
                        with z.open(name) as f:
                            rows = list(csv.DictReader(io.TextIOWrapper(f, "utf-8")))
                        rows = [{k.strip().lower().replace(" ", "_"): v for k, v in r.items() if k} for r in rows]
                        need = ["date", "open", "high", "low", "close", "adj_close", "volume"]
                        if rows and not set(need) <= set(rows[0]):
                            raise ValueError(f"{name} lacks columns")
                        yield pd.DataFrame([(ticker, i, *[r[c] for c in need]) for i, r in enumerate(rows)], columns=["ticker", "ordinal", *need])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RAW)


def archive_bars(raw: DataFrame, seam_date: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Adjusted bars, the last row of each date; the seam is repaired before dates are cut off."""
    typed = raw.withColumn("date", F.try_to_date("date")).where("date is not null")
    bars = keep_last(adjusted(typed), ["ticker", "date"], [F.desc("ordinal")]).drop("ordinal")
    return in_dates(without_seam(bars, seam_date) if seam_date else bars, start, end)
