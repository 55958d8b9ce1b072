"""Bars from ticks and longer bars from shorter ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Months or years of the periods that count them.
MONTHS = {"month": 1, "2month": 2, "3month": 3, "quarter": 3, "6month": 6, "9month": 9}
YEARS = {"year": 1, "12month": 1, "3year": 3, "6year": 6}


def slot(ts: Column, period: str) -> Column:
    """Begin of the slot that a time falls in. ``period`` is minutes (``"5m"``), ``day``, ``week``, months or years.

    Minutes count from midnight of each day, months inside the year, years from year zero.
    """
    if period.endswith("m") and period[:-1].isdigit():
        n = int(period[:-1])
        minute = F.floor((F.hour(ts) * 60 + F.minute(ts)) / n) * n
        return F.date_trunc("day", ts) + F.make_dt_interval(mins=minute.cast("int"))
    if period in ("day", "week"):
        return F.date_trunc(period, ts)
    if period in MONTHS:
        n = MONTHS[period]
        return F.make_date(F.year(ts), (F.floor((F.month(ts) - 1) / n) * n + 1).cast("int"), F.lit(1)).cast("timestamp")
    n = YEARS[period]
    return F.make_date((F.floor(F.year(ts) / n) * n).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")


def placed(rows: DataFrame, order: list[str], block: Column, name: str) -> DataFrame:
    """``rows`` with their number per symbol from 0 in that order; ``block`` grows with the first of ``order``.

    Rows are numbered block by block, and a running sum of the blocks' sizes tells where each begins, so that a
    symbol's rows aren't one task's.
    """
    rows = rows.withColumn("_block", block)
    before = W.partitionBy("symbol").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("symbol", "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("symbol", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy("symbol", "_block").orderBy(*order)) - 1
    return rows.withColumn(name, own).join(starts, ["symbol", "_block"]).withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_block", "_start")


def numbered(bars: DataFrame, order: str = "slot") -> DataFrame:
    """``bars`` with ``x``, their number per symbol from 0. Bars are few against the ticks they are made of, so a symbol's are one window."""
    return bars.withColumn("x", (F.row_number().over(W.partitionBy("symbol").orderBy(order)) - 1).cast("long"))


def ticks_to_bars(ticks: DataFrame, period: str) -> DataFrame:
    """One bar per symbol and slot: first and last price by time and seq, extremes, sums; ``ts`` is the last tick's time.

    A daily bar is stamped 15:00.
    """
    order = F.struct("ts", "seq")
    bars = ticks.groupBy("symbol", slot(F.col("ts"), period).alias("slot")).agg(
        F.max("ts").alias("ts"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("amount"),
        F.count(F.lit(1)).alias("n_ticks"),
    )
    if period == "day":
        bars = bars.withColumn("ts", F.col("slot") + F.expr("INTERVAL 15 HOURS"))
    return numbered(bars)


def _merged(bars: DataFrame, *by: Column) -> DataFrame:
    return bars.groupBy("symbol", *by).agg(
        F.max("ts").alias("ts"), F.min_by("open", "x").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "x").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
        F.sum("n_ticks").alias("n_ticks"),
    )


def resampled(bars: DataFrame, period: str) -> DataFrame:
    """Longer bars from numbered ones."""
    return numbered(_merged(bars, slot(F.col("ts"), period).alias("slot")))


def chunks(bars: DataFrame, n: int) -> DataFrame:
    """Bars of ``n`` consecutive ones each; the last may have fewer."""
    return _merged(bars, F.floor(F.col("x") / n).alias("slot")).withColumn("x", F.col("slot")).drop("slot")


def into_quantity(bars: DataFrame, q: int) -> DataFrame:
    """``q`` bars per symbol: all but the last take the same number of bars, the last the rest."""
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    size = F.greatest(F.floor(n / q), F.lit(1))
    at = F.when(n <= q, F.col("x")).otherwise(F.least(F.floor(F.col("x") / size), F.lit(q - 1)))
    return _merged(bars.withColumn("slot", at), F.col("slot")).withColumn("x", F.col("slot")).drop("slot")


def spread(ticks: DataFrame) -> DataFrame:
    """Ticks of one minute, spread evenly over it in order of ``seq``: the k-th of n stands k/n of a minute in."""
    minute = F.date_trunc("minute", "ts")
    of = W.partitionBy("symbol", minute)
    k, n = F.row_number().over(of.orderBy("ts", "seq")) - 1, F.count(F.lit(1)).over(of)
    millis = F.floor(k * 60000 / n)
    return ticks.withColumn("ts", F.timestamp_millis(F.unix_millis(minute) + millis))


def growing(bars: DataFrame, period: str) -> DataFrame:
    """For each bar, the longer bar it belongs to as known at that bar, without what comes later."""
    w = W.partitionBy("symbol", slot(F.col("ts"), period)).orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    return bars.select(
        "symbol", "x", slot(F.col("ts"), period).alias("slot"), F.first("open").over(w).alias("open"), F.max("high").over(w).alias("high"),
        F.min("low").over(w).alias("low"), "close", F.sum("volume").over(w).alias("volume"),
    )


def one_price_bars(ticks: DataFrame) -> DataFrame:
    """Each tick as a bar of one price; the side stays."""
    price = F.col("price")
    rows = ticks.select("symbol", "ts", "seq", *(price.alias(c) for c in ("open", "high", "low", "close")), F.col("qty").alias("volume"), "side")
    return rows.withColumn("x", (F.row_number().over(W.partitionBy("symbol").orderBy("ts", "seq")) - 1).cast("long"))


def sided(ticks: DataFrame) -> DataFrame:
    """Ticks of a day that have no side, merged: the first ones into the day's first sided tick, the last ones into its last.

    Others count as bought. A day without a sided tick is left out. ``low`` and ``high`` are of the prices merged.
    """
    day = W.partitionBy("symbol", F.to_date("ts"))
    has = F.col("side").isin("B", "S")
    rows = ticks.withColumn("n", F.row_number().over(day.orderBy("ts", "seq")))
    rows = rows.withColumns({"first": F.min(F.when(has, F.col("n"))).over(day), "last": F.max(F.when(has, F.col("n"))).over(day)}).where("first IS NOT NULL")
    rows = rows.withColumn("to", F.greatest("first", F.least("last", "n")))
    own = F.col("n") == F.col("to")
    return rows.groupBy("symbol", F.to_date("ts").alias("day"), "to").agg(
        *(F.max(F.when(own, F.col(c))).alias(c) for c in ("ts", "seq", "price")), F.sum("qty").alias("qty"),
        F.max(F.when(own, F.when(has, F.col("side")).otherwise("B"))).alias("side"), F.min("price").alias("low"), F.max("price").alias("high"),
    ).drop("to")


def trade_counts(ticks: DataFrame, period: str) -> DataFrame:
    """Trades (``trades`` of ticks with a price and quantity; an explicit 0 counts as none) per slot: all, bought, sold."""
    usable = ticks.where("price > 0 AND qty > 0")
    of = lambda s: F.sum(F.when(F.upper(F.trim("side")) == s, F.col("trades")).otherwise(0.0))
    return usable.groupBy("symbol", slot(F.col("ts"), period).alias("slot")).agg(F.sum("trades").alias("trades"), of("B").alias("bought"), of("S").alias("sold"))


def in_range(bars: DataFrame, begin: str | None, end: str | None) -> DataFrame:
    """Bars between two times, both included and numbered anew; a bound that is a day alone is its first or last second."""
    bound = lambda text, time: F.coalesce(
        F.try_to_timestamp(F.lit(text), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.lit(f"{text} {time}"), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.lit(f"{text} {time}"), F.lit("yyyyMMdd HH:mm:ss")),
    )
    for text, time, test in ((begin, "00:00:00", F.Column.__ge__), (end, "23:59:59", F.Column.__le__)):
        if text:
            bars = bars.where(test(F.col("ts"), bound(text, time)))
    return numbered(bars.drop("x"), "ts")
