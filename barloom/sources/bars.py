"""Bars as CSV files: ``time,open,high,low,close`` and optionally ``volume``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def bar_time(text: Column) -> Column:
    """A time written with a day alone, a day and minutes, or a day and seconds; null if it is none of these."""
    t = F.regexp_replace(F.trim(text), "/", "-")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd", "yyyyMMddHHmmssSSS")))


def is_sound(bar_low: str = "low", bar_high: str = "high") -> Column:
    """Whether low and high enclose all prices."""
    return (F.col(bar_low) <= F.least(*PRICES)) & (F.col(bar_high) >= F.greatest(*PRICES))


def repaired(bars: DataFrame) -> DataFrame:
    """Bars whose low and high are widened to enclose all prices."""
    return bars.withColumns({"low": F.least(*PRICES), "high": F.greatest(*PRICES)})


def read_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of CSV files; a missing volume is zero. Reading fails on a bar that isn't sound."""
    raw = spark.read.option("header", True).csv(path)
    volume = F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) if "volume" in raw.columns else F.lit(0.0)
    rows = raw.select(F.lit(symbol).alias("symbol"), bar_time(F.col("time")).alias("ts"), *(F.col(c).cast("double").alias(c) for c in PRICES), volume.alias("volume"))
    checked = F.when(is_sound(), F.col("low")).otherwise(F.raise_error(F.concat(F.lit("unsound bar at "), F.col("ts").cast("string"))).cast("double"))
    return rows.withColumn("low", checked)


def write_bars(bars: DataFrame, path: str) -> None:
    """Sound bars of one symbol as CSV, replacing what was there."""
    checked = F.when(is_sound(), F.col("low")).otherwise(F.raise_error(F.lit("unsound bar")).cast("double"))
    bars.select(F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("time"), "open", "high", checked.alias("low"), "close", "volume").write.mode(
        "overwrite"
    ).option("header", True).csv(path)
