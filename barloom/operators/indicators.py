"""Indicators over numbered bars. Frames are trailing rows; rows before the first don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from barloom.operators.recurrence import recurrences

EDGE = 1e-7


def by_x() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("x")


def trailing(n: int) -> WindowSpec:
    return by_x().rowsBetween(-(n - 1), 0)


def trend(bars: DataFrame, n: int) -> DataFrame:
    """Mean, highest and lowest close of the last ``n`` bars."""
    return bars.select("symbol", "x", *(f("close").over(trailing(n)).alias(c) for f, c in ((F.avg, "mean"), (F.max, "channel_max"), (F.min, "channel_min"))))


def bollinger(bars: DataFrame, n: int = 20) -> DataFrame:
    """Bands of two population deviations; a deviation or lower band of zero counts as a small number."""
    theta = F.stddev_pop("close").over(trailing(n))
    rows = bars.select("symbol", "x", F.avg("close").over(trailing(n)).alias("boll_mid"), theta.alias("t"))
    low = F.col("boll_mid") - 2 * F.col("t")
    return rows.select(
        "symbol", "x", "boll_mid", (F.col("boll_mid") + 2 * F.col("t")).alias("boll_up"), F.when(low == 0, EDGE).otherwise(low).alias("boll_down"),
        F.when(F.col("t") == 0, EDGE).otherwise(F.col("t")).alias("theta"),
    )


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """DIF, DEA and twice their difference; both averages start from the first close, DEA from zero.

    An average of an average is a weighted difference of two averages of the closes, so all are folded in one pass.
    ``fast`` and ``slow`` must differ from ``signal``.
    """
    keep = {n: (p - 1) / (p + 1) for n, p in (("f", fast), ("s", slow), ("h", signal), ("g", signal))}
    close, first = F.col("close"), F.col("x") == 0
    add = {n: F.when(first, close).otherwise(close * (1 - keep[n])) for n in "fs"}
    add |= {"h": F.when(first, 0.0).otherwise(close), "g": F.when(first, close).otherwise(0.0)}
    rows = recurrences(bars.select("symbol", "x", "close"), {n: F.lit(k) for n, k in keep.items()}, add)
    d = keep["h"]
    again = lambda n: (keep[n] * F.col(n) - d * (F.col("g") + (1 - keep[n]) * F.col("h"))) / (keep[n] - d)
    rows = rows.select("symbol", "x", (F.col("f") - F.col("s")).alias("dif"), F.when(F.col("x") == 0, 0.0).otherwise((1 - d) * (again("f") - again("s"))).alias("dea"))
    return rows.select("symbol", "x", "dif", "dea", (2 * (F.col("dif") - F.col("dea"))).alias("hist"))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """50 for the first bar; plain means of gains and losses while there are fewer than ``n``, then Wilder's."""
    rows = bars.select("symbol", "x", F.coalesce(F.col("close") - F.lag("close").over(by_x()), F.lit(0.0)).alias("d"))
    weight = F.when(F.col("x") == 0, 1).when(F.col("x") < n, F.col("x")).otherwise(n)
    keep = 1 - 1 / weight
    add = {"up": F.greatest("d", F.lit(0.0)) / weight, "down": F.greatest(-F.col("d"), F.lit(0.0)) / weight}
    rows = recurrences(rows, {"up": keep, "down": keep}, add)
    value = F.when(F.col("x") == 0, 50.0).when(F.col("down") == 0, F.when(F.col("up") > 0, 100.0).otherwise(0.0))
    return rows.select("symbol", "x", value.otherwise(100 - 100 / (1 + F.col("up") / F.when(F.col("down") != 0, F.col("down")))).alias("rsi"))


def kdj(bars: DataFrame, n: int = 9) -> DataFrame:
    """K and D start from 50; a flat range counts as zero."""
    hn, ln = F.max("high").over(trailing(n)), F.min("low").over(trailing(n))
    rows = bars.select("symbol", "x", F.when(hn != ln, 100 * (F.col("close") - ln) / (hn - ln)).otherwise(0.0).alias("rsv"))
    seeded = lambda v: v / 3 + F.when(F.col("x") == 0, 100.0 / 3).otherwise(0.0)
    rows = recurrences(rows, {"k": F.lit(2 / 3)}, {"k": seeded(F.col("rsv"))})
    rows = recurrences(rows, {"d": F.lit(2 / 3)}, {"d": seeded(F.col("k"))})
    return rows.select("symbol", "x", "k", "d", (3 * F.col("k") - 2 * F.col("d")).alias("j"))


def crossings(lines: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where ``a`` crosses ``b``: ``golden`` from below, ``death`` from above."""
    now, before = F.col(a) - F.col(b), F.lag(F.col(a) - F.col(b)).over(by_x())
    rows = lines.withColumn("cross", F.when((before <= 0) & (now > 0), "golden").when((before >= 0) & (now < 0), "death"))
    return rows.where("cross IS NOT NULL")


def signals(lines: DataFrame) -> DataFrame:
    """Signals of bars from their ``dif``, ``dea``, ``rsi``, ``close``, ``boll_up`` and ``boll_down``: ``symbol``, ``x``, ``signal``.

    ``golden`` and ``death`` crosses, ``above_zero`` and ``below_zero`` of DIF, ``overbought`` from 70, ``oversold`` to 30,
    ``touch_up`` and ``touch_down`` of the bands. A line is crossed when it wasn't past it the bar before.
    """
    up = lambda a, b: (F.lag(a - b).over(by_x()) <= 0) & (a > b)
    found = {
        "golden": up(F.col("dif"), F.col("dea")), "death": up(F.col("dea"), F.col("dif")), "above_zero": up(F.col("dif"), F.lit(0.0)),
        "below_zero": up(-F.col("dif"), F.lit(0.0)), "overbought": up(F.col("rsi"), F.lit(70.0)), "oversold": up(-F.col("rsi"), F.lit(-30.0)),
        "touch_up": F.col("close") >= F.col("boll_up"), "touch_down": F.col("close") <= F.col("boll_down"),
    }
    told = lines.select("symbol", "x", *(c.alias(n) for n, c in found.items()))
    names = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in found)))
    return told.select("symbol", "x", F.explode(names).alias("signal"))
