"""Bars of a symbol's tick files or CSV as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import profile, resample
from barloom.sources.bars import read_bars
from barloom.sources.ticks import read_tick_files

#: Columns of the views of bars.
VIEWS = {
    "kline": ["symbol", "x", "ts", "open", "high", "low", "close", "volume"],
    "volume_chip": ["symbol", "x", "ts", "volume", "bins"],
    "all": ["symbol", "x", "ts", "open", "high", "low", "close", "volume", "amount", "trades", "bought", "sold", "bins"],
}


def load_bars(spark: SparkSession, path: str, period: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of ``period`` between two times from the tick files below a path, with trades by side and volume by price.

    Ticks are spread over their minute, made to bars, and numbered anew in the range; only files of its days are read.
    """
    ticks = read_tick_files(spark, path, begin, end)
    spread = resample.spread(ticks)
    slotted = spread.withColumn("slot", resample.slot(F.col("ts"), period))
    bars = resample.ticks_to_bars(spread, period).join(resample.trade_counts(spread, period), ["symbol", "slot"], "left").na.fill(0.0, ["trades", "bought", "sold"])
    return resample.in_range(profile.with_bins(bars, slotted), begin, end)


def load_csv(spark: SparkSession, path: str, symbol: str, period: str | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a CSV file between two times, as they are or merged to ``period``."""
    bars = resample.in_range(read_bars(spark, path, symbol), begin, end)
    if period is None:
        return bars
    return resample.resampled(bars.withColumns({"amount": F.col("close") * F.col("volume"), "n_ticks": F.lit(0).cast("long")}), period)


def view(bars: DataFrame, name: str) -> DataFrame:
    """The columns of a view of bars, as far as they are there."""
    return bars.select(*(c for c in VIEWS[name] if c in bars.columns))
