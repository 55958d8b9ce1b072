"""Market structure over numbered bars: merged groups, fractals, legs between them, and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.folds import ordered_fold

GROUP = "seq long, x1 long, x2 long, high double, low double, dir string, n_units long, born_high double, born_low double, closed boolean"
PIVOT = "seq long, x1 long, x2 long, zg double, zd double, gg double, dd double, n_members long, is_sure boolean"
LEAST_TICK, NOTHING = 0.01, 1e-12


class Groups:
    """Bars one of which holds the other merge; the first two never do."""

    def __init__(self) -> None:
        self.seq, self.open = -1, None

    def _born(self, x, high, low, direction) -> None:
        self.seq += 1
        self.open = [self.seq, x, x, high, low, direction, 1, high, low]

    def add(self, x, high, low) -> list[tuple]:
        if self.open is None:
            self._born(x, high, low, "up")
            return []
        g = self.open
        holds = (g[3] >= high and g[4] <= low) or (g[3] <= high and g[4] >= low)
        if holds and self.seq > 0:
            pick = max if g[5] == "up" else min
            g[2], g[3], g[4], g[6] = x, pick(g[3], high), pick(g[4], low), g[6] + 1
            return []
        self._born(x, high, low, "down" if not holds and g[3] > high else "up")
        return [(*g, True)]

    def end(self) -> list[tuple]:
        return [(*self.open, False)] if self.open else []


def merged_groups(bars: DataFrame) -> DataFrame:
    """Runs of bars merged by containment, in the direction in which the run began; the last is still open."""
    return ordered_fold(bars, Groups, ["x", "high", "low"], GROUP)


def peak_bars(groups: DataFrame, bars: DataFrame) -> DataFrame:
    """The last bar of each merged group that has the group's high (``high_x``) or low (``low_x``); null if none has."""
    held = groups.select("symbol", "seq", F.col("high").alias("h"), F.col("low").alias("l"), F.explode(F.sequence("x1", "x2")).alias("x")).join(bars.select("symbol", "x", "high", "low"), ["symbol", "x"])
    last = lambda c: F.max(F.when(c, F.col("x")))
    return held.groupBy("symbol", "seq").agg(last(F.col("high") == F.col("h")).alias("high_x"), last(F.col("low") == F.col("l")).alias("low_x"))


def fractals(groups: DataFrame) -> DataFrame:
    """Groups higher (``top``) or lower (``bottom``) than both neighbours in high and low.

    The next group counts as it was born, since the fractal is told then: ``confirm_x``.
    """
    w = W.partitionBy("symbol").orderBy("seq")
    before = lambda c: F.lag(c).over(w)
    after = lambda c: F.lead(c).over(w)
    top = (before("high") < F.col("high")) & (after("born_high") < F.col("high")) & (before("low") < F.col("low")) & (after("born_low") < F.col("low"))
    bottom = (before("high") > F.col("high")) & (after("born_high") > F.col("high")) & (before("low") > F.col("low")) & (after("born_low") > F.col("low"))
    rows = groups.withColumns({"fx": F.when(top, "top").when(bottom, "bottom"), "confirm_x": after("x1")})
    return rows.where("fx IS NOT NULL").select("symbol", "seq", "fx", "x1", "x2", "high", "low", "confirm_x")


class Pivots:
    """A bar seeds a pivot, bars that touch it extend it and tighten its edges until it is flat; the first that
    doesn't touch it closes it and seeds the next. A bar that opens and closes at one price seeds a flat pivot."""

    def __init__(self) -> None:
        self.seq, self.open = -1, None

    def add(self, x, open_, high, low, close, tick) -> list[tuple]:
        p = self.open
        if p is not None and high >= p[4] and low <= p[3]:
            if abs(p[3] - p[4]) > tick + NOTHING:
                p[3], p[4] = min(p[3], high), max(p[4], low)
            p[2], p[5], p[6], p[7] = x, max(p[5], high), min(p[6], low), p[7] + 1
            return []
        self.seq += 1
        flat = abs(open_ - close) <= NOTHING
        self.open = [self.seq, x, x, open_ if flat else high, open_ if flat else low, high, low, 1]
        return [(*p, True)] if p else []

    def end(self) -> list[tuple]:
        return [(*self.open, False)] if self.open else []


def numbered_units(lines: DataFrame) -> DataFrame:
    """Lines as units of pivots: numbered by ``x``."""
    return lines.select("symbol", F.col("idx").alias("x"), "open", "high", "low", "close")


def pivots(bars: DataFrame) -> DataFrame:
    """Pivots over bars; the last is unsure. A pivot no higher than the symbol's tick is flat."""
    span = F.col("high") - F.col("low")
    ticks = bars.groupBy("symbol").agg(F.least(F.lit(LEAST_TICK), F.min(F.when(span > NOTHING, span))).alias("tick"))
    return ordered_fold(bars.join(ticks, "symbol"), Pivots, ["x", "open", "high", "low", "close", "tick"], PIVOT)


def first_class_points(pivots_: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of a pivot strictly below (``buy``) or above (``sell``) the one before: its first, and each that goes further."""
    w = W.partitionBy("symbol").orderBy("seq")
    below, above = F.col("zg") < F.lag("zd").over(w), F.col("zd") > F.lag("zg").over(w)
    rows = pivots_.withColumn("side", F.when(below, "buy").when(above, "sell")).where("side IS NOT NULL")
    inside = rows.select("symbol", "seq", "side", F.explode(F.sequence("x1", "x2")).alias("x")).join(bars.select("symbol", "x", "high", "low"), ["symbol", "x"])
    so_far = W.partitionBy("symbol", "seq").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    buy = F.col("side") == "buy"
    price = F.when(buy, F.col("low")).otherwise(F.col("high"))
    sign = F.when(buy, -1.0).otherwise(1.0)
    best = F.max(sign * price).over(so_far)
    rows = inside.select("symbol", "seq", "side", "x", price.alias("price"), (best.isNull() | (sign * price > best)).alias("goes_on"))
    return rows.where("goes_on").drop("goes_on")
