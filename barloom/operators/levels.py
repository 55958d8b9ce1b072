"""Levels of market structure: fractals of units are paired to lines, and lines are the units of the next level.

Units merge by containment (the first two never do); three groups make a fractal when the third is born, and then it is
frozen. A unit that would be merged but breaks the last low or high of the running leg truncates it: its group becomes a
fractal at once and the unit opens a group of its own. Fractals of alternating kind are paired to lines; what is frozen
never changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.folds import ordered_fold
from barloom.operators.stages import written

CONFIRM = (
    "uid long, fx string, confirm_x long, fx_x1 long, fx_x2 long, fx_high double, fx_low double, pole_x long, used boolean, truncated boolean, "
    "idx long, dir int, begin_confirm_x long, begin_x long, begin_high double, begin_low double"
)
UNIT = ["uid", "x1", "x2", "high", "low", "top", "top_x", "bottom", "bottom_x", "confirm_x"]
TOP, BOTTOM = "top", "bottom"
#: Bars that long lines take in as one.
BLOCK = 256


class _Group:
    """Merged units; ``top`` and ``bottom`` are the extremes of the bars below, at their first bar."""

    def __init__(self, unit, high, low, rising):
        self.uid, self.x1, self.x2, _, _, self.top, self.top_x, self.bottom, self.bottom_x, _ = unit
        self.high, self.low, self.rising = high, low, rising

    def take(self, unit) -> None:
        _, _, self.x2, high, low, top, top_x, bottom, bottom_x, _ = unit
        pick = max if self.rising else min
        self.high, self.low = pick(self.high, high), pick(self.low, low)
        if top > self.top:
            self.top, self.top_x = top, top_x
        if bottom < self.bottom:
            self.bottom, self.bottom_x = bottom, bottom_x

    def pole(self, fx: str) -> int:
        return self.top_x if fx == TOP else self.bottom_x

    def holds(self, high, low) -> bool:
        return (self.high >= high and self.low <= low) or (self.high <= high and self.low >= low)


class Level:
    """The state of one level; rows are its confirmed fractals, with the line that each ends if it is used."""

    def __init__(self, truncation: bool = True, validity: bool = True):
        self.truncation, self.validity = truncation, validity
        self.first: _Group | None = None
        self.before: _Group | None = None
        self.last: _Group | None = None
        self.may_cut_first = True
        self.anchor: tuple | None = None  # kind, confirm, pole, high, low
        self.broken = {TOP: None, BOTTOM: None}
        self.idx = -1

    def _open(self, unit, high, low, rising) -> None:
        self.before, self.last = self.last, _Group(unit, high, low, rising)

    def _cut(self, unit, kind: str) -> list[tuple]:
        """The last group becomes a fractal of ``kind``; the unit is moved past it and opens a group."""
        group, (high, low) = self.last, unit[3:5]
        step = max(abs(group.high - group.low) * 1e-4, max(abs(group.low), abs(group.high), 1.0) * 1e-8, 1e-8)
        if kind == TOP:
            high = group.high - step if high >= group.high else high
            low = group.low - step if low >= group.low else low
            high = max(high, low)
        else:
            low = group.low + step if low <= group.low else low
            high = group.high + step if high <= group.high else high
            low = min(high, low)
        self._open(unit, high, low, kind == BOTTOM)
        return self._confirm(group, kind, unit, True)

    def _confirm(self, group: _Group, kind: str, unit, truncated: bool) -> list[tuple]:
        self.broken[kind] = group.high if kind == TOP else group.low
        pole, confirm_x = group.pole(kind), unit[-1]
        other = BOTTOM if kind == TOP else TOP
        line = (None,) * 6
        anchor = self.anchor
        if anchor is None:  # the first line begins at the first group
            anchor = (other, confirm_x, self.first.pole(other), self.first.high, self.first.low)
        elif anchor[0] == kind or (self.validity and not (group.high > anchor[4] if kind == TOP else group.low < anchor[3])):
            anchor = None
        if anchor:
            self.idx += 1
            line = (self.idx, 1 if kind == TOP else -1, *anchor[1:])
            self.anchor = (kind, confirm_x, pole, group.high, group.low)
        return [(group.uid, kind, confirm_x, group.x1, group.x2, group.high, group.low, pole, anchor is not None, truncated, *line)]

    def add(self, *unit) -> list[tuple]:
        high, low = unit[3:5]
        if self.first is None:
            self._open(unit, high, low, True)
            self.first = self.last
            return []
        group = self.last
        holds = group.holds(high, low)
        if self.before is None:
            higher, lower = high - group.high, group.low - low
            if self.truncation and higher >= 0 and lower >= 0 and (higher or lower):
                return self._cut(unit, TOP if lower > higher else BOTTOM)
        elif holds:
            watched = self.anchor and (BOTTOM if self.anchor[0] == BOTTOM else TOP)
            if self.truncation and watched and self.broken[watched] is not None:
                if watched == BOTTOM and high >= group.high and low < self.broken[BOTTOM]:
                    return self._cut(unit, TOP)
                if watched == TOP and low <= group.low and high > self.broken[TOP]:
                    return self._cut(unit, BOTTOM)
            group.take(unit)
            return []
        mid, left = group, self.before
        self._open(unit, high, low, holds or group.high < high)
        if left is None:
            return []
        if left.high < mid.high > high and left.low < mid.low > low:
            return self._confirm(mid, TOP, unit, False)
        if left.high > mid.high < high and left.low > mid.low < low:
            return self._confirm(mid, BOTTOM, unit, False)
        return []

    def end(self) -> list[tuple]:
        return []


def bar_units(bars: DataFrame) -> DataFrame:
    """Bars as the units of the first level."""
    x = F.col("x")
    return bars.select(
        "symbol", x.alias("uid"), x.alias("x1"), x.alias("x2"), "high", "low", F.col("high").alias("top"), x.alias("top_x"),
        F.col("low").alias("bottom"), x.alias("bottom_x"), x.alias("confirm_x"),
    )


def confirms(units: DataFrame, truncation: bool = True, validity: bool = True) -> DataFrame:
    """Confirmed fractals of a level, used as the end of a line or not."""
    return ordered_fold(units, lambda: Level(truncation, validity), UNIT, CONFIRM, order="uid")


def lines(confirms_: DataFrame) -> DataFrame:
    """Lines between the poles of used fractals."""
    price = lambda up, high, low: F.when((F.col("dir") > 0) == F.lit(up), F.col(high)).otherwise(F.col(low))
    return confirms_.where("used").select(
        "symbol", "idx", "dir", "begin_x", F.col("pole_x").alias("end_x"), "begin_confirm_x", "confirm_x",
        price(False, "begin_high", "begin_low").alias("begin_price"), price(True, "fx_high", "fx_low").alias("end_price"),
        "begin_high", "begin_low", F.col("fx_high").alias("end_high"), F.col("fx_low").alias("end_low"),
    )


def _spans(lines_: DataFrame, bars: DataFrame, block: int) -> DataFrame:
    """The bars that each line takes in, whole blocks of them as one row: ``symbol``, ``idx``, ``begin_x`` and for the row its first
    ``x``, ``last_x``, extremes with their first bar, ``close`` and ``volume``.

    So a line of any length reads its bars at both ends and a row for each block between, and a high level costs little.
    """
    x = F.col("x")
    ones = bars.select("symbol", F.lit(0).alias("kind"), x.alias("n"), "x", "high", x.alias("high_x"), "low", x.alias("low_x"), "close", "volume")
    blocks = bars.groupBy("symbol", F.floor(x / block).alias("n")).agg(
        F.min("x").alias("x"), F.max("high").alias("high"), F.max_by("x", F.struct("high", -x)).alias("high_x"), F.min("low").alias("low"), F.min_by("x", F.struct("low", "x")).alias("low_x"),
        F.max_by("close", "x").alias("close"), F.sum("volume").alias("volume"),
    )
    units = ones.unionByName(blocks.withColumn("kind", F.lit(1)))
    first, last = F.floor(F.col("begin_x") / block) + 1, F.floor(F.col("end_x") / block) - 1
    between = last >= first
    each = lambda a, b, kind: F.transform(F.sequence(a, b), lambda n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n")))
    ends = F.concat(each(F.col("begin_x"), first * block - 1, 0), each(first, last, 1), each((last + 1) * block, F.col("end_x"), 0))
    rows = lines_.select("symbol", "idx", "begin_x", F.explode(F.when(between, ends).otherwise(each(F.col("begin_x"), F.col("end_x"), 0))).alias("u"))
    return rows.select("symbol", "idx", "begin_x", "u.*").join(units, ["symbol", "kind", "n"])


def line_bars(lines_: DataFrame, bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lines as bars: they open at the begin's extreme; high, low and close are of the bars after the pole, volume counts the pole too.

    Also ``top``, ``bottom`` and their first bars over all bars of the line. A line without a bar after its pole is flat.
    """
    held = _spans(lines_, bars, block)
    body = F.col("x") > F.col("begin_x")
    after = lambda c: F.when(body, F.col(c))
    found = held.groupBy("symbol", "idx").agg(
        F.max(after("high")).alias("body_high"), F.min(after("low")).alias("body_low"), F.max_by(after("close"), F.when(body, F.col("x"))).alias("body_close"),
        F.sum("volume").alias("volume"), F.max("high").alias("top"), F.max_by("high_x", F.struct("high", -F.col("high_x"))).alias("top_x"),
        F.min("low").alias("bottom"), F.min_by("low_x", F.struct("low", "low_x")).alias("bottom_x"),
    )
    rows = lines_.join(found, ["symbol", "idx"]).withColumn("open", F.col("begin_price"))
    return rows.select(
        "symbol", "idx", "dir", "begin_x", "end_x", "begin_confirm_x", "confirm_x", "open", F.greatest("body_high", "open").alias("high"),
        F.least("body_low", "open").alias("low"), F.coalesce("body_close", "open").alias("close"), "volume", "top", "top_x", "bottom", "bottom_x",
        "begin_price", "end_price", "begin_high", "begin_low", "end_high", "end_low",
    )


def line_units(line_bars_: DataFrame) -> DataFrame:
    """Lines as the units of the next level."""
    return line_bars_.select(
        "symbol", F.col("idx").alias("uid"), F.col("begin_x").alias("x1"), F.col("end_x").alias("x2"), "high", "low", "top", "top_x", "bottom", "bottom_x", "confirm_x"
    )


def levels(bars: DataFrame, most: int = 16, truncation: bool = True, validity: bool = True) -> list[tuple[DataFrame, DataFrame]]:
    """Confirmed fractals and lines (as bars) of each level from the first, until a level has no line or there are ``most``.

    Each level is written, since the next one and the caller read it; a level has a fraction of the rows of the one below.
    """
    out: list[tuple[DataFrame, DataFrame]] = []
    units = bar_units(bars)
    while len(out) < most:
        found = written(confirms(units, truncation, validity))
        made = written(line_bars(lines(found), bars))
        if made.isEmpty():
            break
        out.append((found, made))
        units = line_units(made)
    return out


def running_line(confirms_: DataFrame, bars: DataFrame) -> DataFrame:
    """The line that has begun at each symbol's last used fractal and has no end yet, up to its last bar."""
    anchor = confirms_.where("used").groupBy("symbol").agg(F.max_by(F.struct("fx", "pole_x", "fx_high", "fx_low", "confirm_x", "idx"), "idx").alias("a"))
    last = bars.groupBy("symbol").agg(F.max("x").alias("end_x"))
    up = F.col("a.fx") == BOTTOM
    price = F.when(up, F.col("a.fx_low")).otherwise(F.col("a.fx_high"))
    lines_ = anchor.join(last, "symbol").select(
        "symbol", (F.col("a.idx") + 1).alias("idx"), F.when(up, 1).otherwise(-1).alias("dir"), F.col("a.pole_x").alias("begin_x"), "end_x",
        F.col("a.confirm_x").alias("begin_confirm_x"), F.col("end_x").alias("confirm_x"), price.alias("begin_price"), price.alias("end_price"),
        F.col("a.fx_high").alias("begin_high"), F.col("a.fx_low").alias("begin_low"), F.col("a.fx_high").alias("end_high"), F.col("a.fx_low").alias("end_low"),
    )
    return line_bars(lines_, bars)
