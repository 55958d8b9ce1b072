"""What is known of a level at each bar: its running line, judged fractals, pivots with their signals, and divergence.

A level's frozen lines never change, and one line is running: from the pole of the last used fractal to the bar. All
here is told with that line as it is at the bar, so nothing depends on later bars, and rows are a few for each bar. The
running line is a window over its own bars; fractals and pivots are one fold each over frozen and running units in the
order in which they become known, where the running unit is tried on a copy of the small state.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import indicators
from barloom.operators.folds import ordered_fold
from barloom.operators.levels import BOTTOM, UNIT, Level
from barloom.operators.recurrence import recurrences
from barloom.operators.stages import written
from barloom.operators.structure import LEAST_TICK, NOTHING

JUDGED = "x long, fx string, truncated boolean, fx_x1 long, fx_x2 long, fx_high double, fx_low double, right_x1 long"
TAIL = (
    "x long, back int, seq long, x1 long, x2 long, zg double, zd double, gg double, dd double, n_members long, dir int, end_idx long, is_sure boolean, merged boolean, value int"
)
LEAST = 1e-7
#: Measures of the strength of a line, in and out of a pivot.
MEASURES = ("area", "peak", "full_area", "diff", "slope", "amp", "amount", "volume", "amount_avg", "volume_avg", "rsi", "line_slope")


def running_lines(confirms: DataFrame, bars: DataFrame) -> DataFrame:
    """The running line at each bar from the first used fractal on: ``symbol``, ``x``, ``idx``, ``dir``, ``begin_x``, ``open``,
    ``high``, ``low``, ``close`` and ``volume``.

    It runs from the last used fractal's pole; extremes are of the bars after the pole, volume counts the pole too. A bar
    is read once for each line that it is part of, two as a rule.
    """
    up = F.col("fx") == BOTTOM
    spans = confirms.where("used").select(
        "symbol", (F.col("idx") + 1).alias("idx"), F.when(up, 1).otherwise(-1).alias("dir"), F.col("pole_x").alias("begin_x"), "confirm_x",
        F.when(up, F.col("fx_low")).otherwise(F.col("fx_high")).alias("open"), F.lead("confirm_x").over(W.partitionBy("symbol").orderBy("confirm_x")).alias("until"),
    ).join(bars.groupBy("symbol").agg(F.max("x").alias("last_x")), "symbol")
    held = spans.withColumn("x", F.explode(F.sequence("begin_x", F.coalesce(F.col("until") - 1, "last_x")))).join(bars.select("symbol", "x", "high", "low", "close", "volume"), ["symbol", "x"])
    w = W.partitionBy("symbol", "idx").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    body = F.col("x") > F.col("begin_x")
    rows = held.select(
        "symbol", "x", "idx", "dir", "begin_x", "open", F.greatest("open", F.max(F.when(body, F.col("high"))).over(w)).alias("high"),
        F.least("open", F.min(F.when(body, F.col("low"))).over(w)).alias("low"), "close", F.sum("volume").over(w).alias("volume"), "confirm_x",
    )
    return rows.where("x >= confirm_x").drop("confirm_x")


def _known(frozen: DataFrame, running: DataFrame, columns: list[str]) -> DataFrame:
    """Frozen rows at their confirm and running ones at their bar, in one order: ``at``, ``kind`` (0 frozen, 1 running)."""
    kind = lambda n, x: (F.lit(n).alias("kind"), (F.col(x) * 2 + n).alias("at"))
    return frozen.select("symbol", *kind(0, "confirm_x"), *columns).unionByName(running.select("symbol", *kind(1, "confirm_x"), *columns))


class _Judge:
    """A level's state; a running unit is tried on a copy of it, which is a few numbers whatever went before."""

    def __init__(self, truncation: bool, validity: bool):
        self.level = Level(truncation, validity)

    def add(self, kind, *unit) -> list[tuple]:
        if kind == 0:
            self.level.add(*unit)
            return []
        tried = copy.copy(self.level)
        tried.last, tried.broken = copy.copy(self.level.last), dict(self.level.broken)
        found = tried.add(*unit)
        return [(unit[-1], fx, cut, x1, x2, high, low, unit[1]) for _, fx, _, x1, x2, high, low, _, _, cut, *_ in found]

    def end(self) -> list[tuple]:
        return []


def judged_fractals(line_units: DataFrame, running: DataFrame, truncation: bool = True, validity: bool = True) -> DataFrame:
    """Fractals of the level above that the running line would confirm at each bar, were it frozen as it is.

    ``x`` is the bar, ``fx_x1`` to ``fx_x2`` the middle group, ``right_x1`` where the running line began. A judgment can
    be dropped again: at a later bar the line may be taken into the group before it.
    """
    x = F.col("x")
    units = running.select(
        "symbol", F.col("idx").alias("uid"), F.col("begin_x").alias("x1"), x.alias("x2"), "high", "low", F.col("high").alias("top"), x.alias("top_x"),
        F.col("low").alias("bottom"), x.alias("bottom_x"), x.alias("confirm_x"),
    )
    return ordered_fold(_known(line_units, units, UNIT), lambda: _Judge(truncation, validity), ["kind", *UNIT], JUDGED, order="at")


class _Box:
    """A pivot of lines. ``least_high`` and ``most_low`` are of all members, the edges stop at a flat one."""

    def __init__(self, seq: int, idx, way, x1, x2, open_, high, low, close):
        one_price = abs(open_ - close) <= NOTHING
        self.seq, self.x1, self.x2, self.dir, self.end, self.n, self.sure, self.merged = seq, x1, x2, way, idx, 1, False, False
        self.zg, self.zd = (open_, open_) if one_price else (high, low)
        self.gg, self.dd, self.least_high, self.most_low, self.anchor = high, low, high, low, open_ if one_price else None

    def touches(self, high: float, low: float) -> bool:
        return high >= self.zd and low <= self.zg

    def take(self, idx, x2, high, low, tick) -> None:
        if abs(self.zg - self.zd) > tick + NOTHING:
            self.zg, self.zd = min(self.zg, high), max(self.zd, low)
        self._members(idx, x2, 1, high, low, high, low)

    def _members(self, idx, x2, n, most, least, least_high, most_low) -> None:
        self.gg, self.dd, self.x2, self.end, self.n = max(self.gg, most), min(self.dd, least), x2, idx, self.n + n
        self.least_high, self.most_low = min(self.least_high, least_high), max(self.most_low, most_low)

    def merge(self, other: _Box) -> None:
        """Take all members of ``other``; the edges are those of the members, or the first one's only price."""
        self._members(other.end, other.x2, other.n, other.gg, other.dd, other.least_high, other.most_low)
        self.zg, self.zd = (self.least_high, self.most_low) if self.anchor is None else (self.anchor, self.anchor)
        self.merged = True

    def value(self, before: _Box | None) -> int:
        shift = (self.zg + self.zd) - (before.zg + before.zd) if before else 0
        return 1 if shift > 0 else -1 if shift < 0 else 1 if self.dir >= 0 else -1

    def row(self, x: int, back: int, before: _Box | None) -> tuple:
        return (x, back, self.seq, self.x1, self.x2, self.zg, self.zd, self.gg, self.dd, self.n, self.dir, self.end, self.sure, self.merged, self.value(before))


class _Boxes:
    """Pivots over frozen lines; at a bar the running line is a member of the last, or one of its own that leaves it unsure."""

    def __init__(self, merge: str):
        self.merge, self.closed, self.open, self.tick = merge, [], None, LEAST_TICK

    def add(self, kind, idx, way, x1, x2, open_, high, low, close, x) -> list[tuple]:
        span = high - low
        tick = min(self.tick, span) if span > NOTHING else self.tick
        unit = idx, way, x1, x2, open_, high, low, close
        if kind == 0:
            self.tick = tick
            if self.open and self.open.touches(high, low):
                self.open.take(idx, x2, high, low, tick)
                return []
            if self.open:
                self.open.sure = True
                self.closed = [*self.closed[-3:], self.open]
            self.open = _Box(self.open.seq + 1 if self.open else 0, *unit)
            return []
        last = copy.copy(self.open)
        tail = [*self.closed]
        if last is None:
            tail.append(_Box(0, *unit))
        elif last.touches(high, low):
            last.take(idx, x2, high, low, tick)
            tail.append(last)
        else:
            own = _Box(last.seq + 1, *unit)
            a, b = ((last.zd, last.zg), (own.zd, own.zg)) if self.merge == "range" else ((last.dd, last.gg), (own.dd, own.gg))
            if self.merge and a[0] <= b[1] and b[0] <= a[1]:
                last.merge(own)
                tail.append(last)
            else:
                tail += [last, own]
        n = len(tail)
        return [tail[n - 1 - back].row(x, back, tail[n - 2 - back] if n - 2 - back >= 0 else None) for back in range(min(n, 3))]

    def end(self) -> list[tuple]:
        return []


def pivot_tails(line_bars: DataFrame, running: DataFrame, merge: str = "range") -> DataFrame:
    """The last three pivots of a level at each bar, ``back`` from 0: over its frozen lines and the running one.

    A pivot is sure (``is_sure``) once a frozen line has left it; left by the running line alone it stays unsure, and so
    does the last. An unsure pivot and the one behind it become one (``merged``) if their edges (``merge`` is ``range``) or
    their peaks (``peak``) overlap; the next bar may undo that. ``value`` is 1 if the middle is above that of the pivot before,
    -1 if below, and the first line's direction if neither. The smallest tick is that of the lines known at the bar.
    """
    columns = ["idx", "dir", "begin_x", "end_x", "open", "high", "low", "close", "confirm_x"]
    now = running.withColumns({"end_x": F.col("x"), "confirm_x": F.col("x")})
    return ordered_fold(_known(line_bars, now, columns), lambda: _Boxes(merge), ["kind", *columns], TAIL, order="at")


def pivot_signals(tails: DataFrame) -> DataFrame:
    """``symbol``, ``x``, ``kind``, ``x1``, ``value``: a ``confirm`` where a pivot is sure for the first time, and a ``judge`` there and
    at each bar where the last but one is left but not sure. ``x1`` is the pivot's first bar, by which it is known."""
    sure = tails.where("is_sure").groupBy("symbol", "x1").agg(F.min_by(F.struct("x", "value"), "x").alias("s")).select("symbol", "s.x", "x1", "s.value")
    left = tails.where("back = 1 AND NOT is_sure").select("symbol", "x", "x1", "value")
    kind = lambda rows, name: rows.select("symbol", "x", F.lit(name).alias("kind"), "x1", "value")
    return kind(sure, "confirm").unionAll(kind(sure.unionAll(left), "judge"))


def line_macd(line_bars: DataFrame, running: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``symbol``, ``x``, ``dif``, ``dea``, ``hist`` of a level's closes at each bar, the running line's close the last of them."""
    keep = {n: (p - 1) / (p + 1) for n, p in (("f", fast), ("s", slow), ("e", signal))}
    first = F.col("n") == 0
    rows = line_bars.select("symbol", F.col("idx").alias("n"), "close")
    seeded = lambda n, v: F.when(first, v).otherwise(v * (1 - keep[n]))
    rows = recurrences(rows, {n: F.lit(keep[n]) for n in "fs"}, {n: seeded(n, F.col("close")) for n in "fs"}, x="n")
    rows = recurrences(rows, {"e": F.lit(keep["e"])}, {"e": F.when(first, 0.0).otherwise((F.col("f") - F.col("s")) * (1 - keep["e"]))}, x="n")
    found = running.select("symbol", "x", (F.col("idx") - 1).alias("n"), F.col("close").alias("now")).join(rows, ["symbol", "n"])
    step = lambda n, v: keep[n] * F.col(n) + (1 - keep[n]) * v
    found = found.withColumn("dif", step("f", F.col("now")) - step("s", F.col("now"))).withColumn("dea", step("e", F.col("dif")))
    return found.select("symbol", "x", "dif", "dea", (2 * (F.col("dif") - F.col("dea"))).alias("hist"))


def line_rsi(line_bars: DataFrame, running: DataFrame, n: int = 14) -> DataFrame:
    """``symbol``, ``x``, ``rsi`` of a level's closes at each bar, the running line's close the last of them."""
    by = W.partitionBy("symbol").orderBy("n")
    rows = line_bars.select("symbol", F.col("idx").alias("n"), "close").withColumn("d", F.coalesce(F.col("close") - F.lag("close").over(by), F.lit(0.0)))
    weight = F.when(F.col("n") == 0, 1).when(F.col("n") < n, F.col("n")).otherwise(n)
    gain = lambda d: {"up": F.greatest(d, F.lit(0.0)), "down": F.greatest(-d, F.lit(0.0))}
    rows = recurrences(rows, {k: 1 - 1 / weight for k in ("up", "down")}, {k: v / weight for k, v in gain(F.col("d")).items()}, x="n")
    found = running.select("symbol", "x", (F.col("idx") - 1).alias("n"), F.col("close").alias("now")).join(rows, ["symbol", "n"])
    weight = F.least(F.col("n") + 1, F.lit(n))
    found = found.withColumns({k: (1 - 1 / weight) * F.col(k) + v / weight for k, v in gain(F.col("now") - F.col("close")).items()})
    flat = F.when(F.col("up") > 0, 100.0).otherwise(0.0)
    return found.select("symbol", "x", F.when(F.col("down") == 0, flat).otherwise(100 - 100 / (1 + F.col("up") / F.nullif("down", F.lit(0.0)))).alias("rsi"))


def _with_last(line_bars: DataFrame, running: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """``running`` with ``last``, the last ``n - 1`` lines before it (an array of structs of ``columns``)."""
    w = W.partitionBy("symbol").orderBy("n").rowsBetween(-(n - 2), 0)
    rows = line_bars.select("symbol", (F.col("idx") + 1).alias("idx"), F.col("idx").alias("n"), *columns)
    held = rows.select("symbol", "idx", (F.collect_list(F.struct(*columns)).over(w) if n > 1 else F.array().cast(f"array<struct<{','.join(f'{c}:double' for c in columns)}>>")).alias("last"))
    return running.select("symbol", "x", "idx", *(c for c in ("high", "low", "close"))).join(held, ["symbol", "idx"])


def line_trend(line_bars: DataFrame, running: DataFrame, n: int = 5) -> DataFrame:
    """``symbol``, ``x``, ``mean``, ``channel_max`` and ``channel_min`` of the last ``n`` closes of a level, the running line's the last of them."""
    closes = F.concat(F.transform("last", lambda r: r["close"]), F.array("close"))
    rows = _with_last(line_bars, running, n, ["close"]).withColumn("closes", closes)
    return rows.select("symbol", "x", (F.aggregate("closes", F.lit(0.0), lambda a, c: a + c) / F.size("closes")).alias("mean"), F.array_max("closes").alias("channel_max"), F.array_min("closes").alias("channel_min"))


def line_bollinger(line_bars: DataFrame, running: DataFrame, n: int = 20) -> DataFrame:
    """``symbol``, ``x`` and the bands (as :func:`indicators.bollinger`) of the last ``n`` closes of a level, the running line's the last."""
    rows = _with_last(line_bars, running, n, ["close"]).withColumn("closes", F.concat(F.transform("last", lambda r: r["close"]), F.array("close")))
    rows = rows.withColumn("m", F.aggregate("closes", F.lit(0.0), lambda a, c: a + c) / F.size("closes"))
    rows = rows.withColumn("t", F.sqrt(F.aggregate("closes", F.lit(0.0), lambda a, c: a + (c - F.col("m")) * (c - F.col("m"))) / F.size("closes")))
    theta = F.when(F.col("t") == 0, LEAST).otherwise(F.col("t"))
    low = F.col("m") - 2 * theta
    return rows.select("symbol", "x", F.col("m").alias("boll_mid"), (F.col("m") + 2 * theta).alias("boll_up"), F.when(low == 0, LEAST).otherwise(low).alias("boll_down"), theta.alias("theta"))


def line_kdj(line_bars: DataFrame, running: DataFrame, n: int = 9) -> DataFrame:
    """``symbol``, ``x``, ``k``, ``d`` and ``j`` of a level, the running line the last of its ``n``."""
    before = indicators.kdj(line_bars.select("symbol", F.col("idx").alias("x"), "high", "low", "close"), n).select("symbol", (F.col("x") + 1).alias("idx"), F.col("k").alias("k0"), F.col("d").alias("d0"))
    rows = _with_last(line_bars, running, n, ["high", "low"]).join(before, ["symbol", "idx"])
    top = F.array_max(F.concat(F.transform("last", lambda r: r["high"]), F.array("high")))
    bottom = F.array_min(F.concat(F.transform("last", lambda r: r["low"]), F.array("low")))
    rows = rows.withColumn("rsv", F.when(top != bottom, 100 * (F.col("close") - bottom) / (top - bottom)).otherwise(0.0)).withColumn("k", F.col("k0") * 2 / 3 + F.col("rsv") / 3)
    rows = rows.withColumn("d", F.col("d0") * 2 / 3 + F.col("k") / 3)
    return rows.select("symbol", "x", "k", "d", (3 * F.col("k") - 2 * F.col("d")).alias("j"))


def end_pairs(tails: DataFrame, running: DataFrame) -> DataFrame:
    """Which two lines are compared at each bar: ``symbol``, ``x``, ``mode``, ``in_idx``, ``out_idx``.

    While the running line is inside of the last pivot (``contained``) those that end the two pivots before it; else
    (``broke``) the one that ends the pivot before it, and the running line itself. Bars without enough pivots have no row.
    """
    at = lambda back, c: F.max(F.when(F.col("back") == back, F.col(c)))
    rows = tails.groupBy("symbol", "x").agg(at(0, "zg").alias("zg"), at(0, "zd").alias("zd"), at(1, "end_idx").alias("one"), at(2, "end_idx").alias("two"))
    rows = rows.join(running.select("symbol", "x", "idx", "high", "low"), ["symbol", "x"])
    inside = (F.col("high") <= F.col("zg")) & (F.col("low") >= F.col("zd"))
    pick = lambda a, b: F.when(inside, F.col(a)).otherwise(F.col(b))
    rows = rows.select("symbol", "x", F.when(inside, "contained").otherwise("broke").alias("mode"), pick("two", "one").alias("in_idx"), pick("one", "idx").alias("out_idx"))
    return rows.where("in_idx IS NOT NULL AND out_idx IS NOT NULL")


def _priced(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows with the extremes of the bars at ``begin_x`` and ``end_x``."""
    edge = lambda at, p: bars.select("symbol", F.col("x").alias(at), F.col("high").alias(f"{p}_high"), F.col("low").alias(f"{p}_low"))
    return rows.join(edge("begin_x", "b"), ["symbol", "begin_x"]).join(edge("end_x", "e"), ["symbol", "end_x"])


def _measures(rows: DataFrame, side: str) -> list[Column]:
    """The measures from sums, extremes and prices of a line's bars; ``side`` is ``in`` or ``out`` for the area."""
    up, n = F.col("dir") > 0, F.col("end_x") - F.col("begin_x") + 1
    change = F.when(up, F.col("e_high") - F.col("b_low")).otherwise(F.col("b_high") - F.col("e_low"))
    steep = F.abs(F.col("line_change") / F.when(F.col("line_bars") >= 1, F.col("line_bars")))
    found = {
        "area": F.coalesce(F.col(f"area_{side}"), F.lit(0.0)) + LEAST, "peak": F.greatest(F.lit(LEAST), F.coalesce("most", F.lit(0.0))),
        "full_area": F.coalesce("mine", F.lit(0.0)) + LEAST, "diff": F.col("high_hist") - F.col("low_hist"),
        "slope": change / F.nullif(F.when(up, F.col("e_high")).otherwise(F.col("b_high")), F.lit(0.0)) / n,
        "amp": change / F.nullif(F.when(up, F.col("b_low")).otherwise(F.col("b_high")), F.lit(0.0)), "amount": F.col("sum_amount"), "volume": F.col("sum_volume"),
        "amount_avg": F.col("sum_amount") / n, "volume_avg": F.col("sum_volume") / n,
        "rsi": F.when(up, F.col("high_rsi")).otherwise(10000.0 / (F.col("low_rsi") + LEAST)), "line_slope": F.when(steep < NOTHING, LEAST).otherwise(steep),
    }
    return [found[m].alias(m) for m in MEASURES]


def _signed_runs(series: DataFrame) -> DataFrame:
    """``series`` with the running sums that any line's areas follow from: ``total`` of the sizes of ``hist`` up to the bar,
    ``run_x`` and ``run_end`` (first and last bar of the run of one sign; null for none) and ``edge`` (``total`` before the run)."""
    w = W.partitionBy("symbol").orderBy("x")
    sign = F.signum("hist")
    same = F.coalesce(sign * F.lag(sign).over(w) > 0, F.lit(False))
    rows = series.withColumns({"size": F.coalesce(F.abs("hist"), F.lit(0.0)), "begins": (~same).cast("int")})
    rows = rows.withColumns({"total": F.sum("size").over(w), "run": F.sum("begins").over(w)})
    one = W.partitionBy("symbol", "run")
    return rows.withColumns({"run_x": F.min("x").over(one), "run_end": F.max("x").over(one), "edge": F.min(F.col("total") - F.col("size")).over(one)}).drop("begins")


def frozen_measures(line_bars: DataFrame, series: DataFrame) -> DataFrame:
    """``symbol``, ``idx`` and each measure of a frozen line, as the line into (``in_``) and out of (``out_``) a pivot.

    ``series`` is the bars with ``hist`` and ``rsi``. Each bar is read once for each line that it is part of.
    """
    runs = _signed_runs(series)
    lines = line_bars.select("symbol", "idx", "dir", "begin_x", "end_x", "confirm_x", (F.col("end_price") - F.col("begin_price")).alias("line_change")).withColumn("line_bars", F.col("confirm_x") - F.col("begin_x"))
    held = lines.select("symbol", "idx", "dir", F.explode(F.sequence("begin_x", "end_x")).alias("x")).join(series.select("symbol", "x", "hist", "rsi", "volume", "amount"), ["symbol", "x"])
    mine = F.col("hist") * F.col("dir") > 0
    found = held.groupBy("symbol", "idx").agg(
        F.max(F.when(mine, F.abs("hist"))).alias("most"), F.sum(F.when(mine, F.abs("hist"))).alias("mine"), F.max("hist").alias("high_hist"), F.min("hist").alias("low_hist"),
        F.sum("volume").alias("sum_volume"), F.sum("amount").alias("sum_amount"), F.max("rsi").alias("high_rsi"), F.min("rsi").alias("low_rsi"),
    )
    at = lambda x, p: runs.select("symbol", F.col("x").alias(x), *(F.col(c).alias(f"{p}_{c}") for c in ("hist", "total", "size", "edge", "run_x", "run_end")))
    ends = lines.join(at("begin_x", "b"), ["symbol", "begin_x"]).join(at("end_x", "e"), ["symbol", "end_x"])
    # The run at the begin is cut at the end, and the run at the end at the begin.
    until = runs.select("symbol", F.col("x").alias("stop"), F.col("total").alias("stop_total"))
    ends = ends.withColumn("stop", F.least("b_run_end", "end_x")).join(until, ["symbol", "stop"])
    into = F.when(F.col("b_hist") != 0, F.col("stop_total") - F.col("b_total") + F.col("b_size"))
    out = F.when(F.col("e_hist") != 0, F.col("e_total") - F.greatest("e_edge", F.col("b_total") - F.col("b_size")))
    rows = _priced(ends.withColumns({"area_in": into, "area_out": out}).join(found, ["symbol", "idx"]), series)
    one = rows.select("symbol", "idx", F.struct(*_measures(rows, "in")).alias("i"), F.struct(*_measures(rows, "out")).alias("o"))
    return one.select("symbol", "idx", *(F.col(f"i.{m}").alias(f"in_{m}") for m in MEASURES), *(F.col(f"o.{m}").alias(f"out_{m}") for m in MEASURES))


def running_measures(running: DataFrame, series: DataFrame) -> DataFrame:
    """``symbol``, ``x`` and each measure (``out_``) of the running line at each bar, from windows over its bars."""
    runs = _signed_runs(series)
    spans = running.groupBy("symbol", "idx", "dir", "begin_x").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"))
    held = spans.withColumn("x", F.explode(F.sequence("begin_x", "last_x"))).join(runs.select("symbol", "x", "hist", "rsi", "volume", "amount", "total", "size", "edge"), ["symbol", "x"])
    w = W.partitionBy("symbol", "idx").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    mine = F.col("hist") * F.col("dir") > 0
    rows = held.select(
        "symbol", "x", "idx", "dir", "begin_x", F.col("x").alias("end_x"), "first_x", F.max(F.when(mine, F.abs("hist"))).over(w).alias("most"), F.sum(F.when(mine, F.abs("hist"))).over(w).alias("mine"),
        F.max("hist").over(w).alias("high_hist"), F.min("hist").over(w).alias("low_hist"), F.sum("volume").over(w).alias("sum_volume"), F.sum("amount").over(w).alias("sum_amount"),
        F.max("rsi").over(w).alias("high_rsi"), F.min("rsi").over(w).alias("low_rsi"),
        F.when(F.col("hist") != 0, F.col("total") - F.greatest("edge", F.first(F.col("total") - F.col("size")).over(w))).alias("area_out"),
    ).where("x >= first_x")
    rows = rows.join(running.select("symbol", "x", (F.col("high") - F.col("low")).alias("line_change")), ["symbol", "x"]).withColumn("line_bars", F.col("x") - F.col("begin_x"))
    rows = _priced(rows, series)
    return rows.select("symbol", "x", F.struct(*_measures(rows, "out")).alias("o")).select("symbol", "x", *(F.col(f"o.{m}").alias(f"out_{m}") for m in MEASURES))


def divergences(line_bars: DataFrame, running: DataFrame, bars: DataFrame, rate: float = 1.0, merge: str = "range") -> DataFrame:
    """Divergence of a level at each bar, by each of ``MEASURES``: ``symbol``, ``x``, ``mode``, ``measure``, ``in_value``, ``out_value``, ``ratio``, ``flag``.

    ``flag`` is 1 if the line out has at most ``rate`` of the strength of the line in (over 100: always), else -1. Measures
    without a value have no row. The histogram and the RSI are the level's own, as they were known at each bar; they are
    written once, since frozen and running lines are both measured by them.
    """
    series = bars.join(line_macd(line_bars, running).select("symbol", "x", "hist"), ["symbol", "x"], "left").join(line_rsi(line_bars, running), ["symbol", "x"], "left")
    series = written(series.select("symbol", "x", "high", "low", "volume", "amount", "hist", "rsi"))
    pairs = end_pairs(pivot_tails(line_bars, running, merge), running)
    frozen = frozen_measures(line_bars, series)
    into = frozen.select("symbol", F.col("idx").alias("in_idx"), *(f"in_{m}" for m in MEASURES))
    held = frozen.select("symbol", F.col("idx").alias("out_idx"), *(F.col(f"out_{m}").alias(f"held_{m}") for m in MEASURES))
    now = running_measures(running, series)
    rows = pairs.join(into, ["symbol", "in_idx"]).join(held, ["symbol", "out_idx"], "left").join(now, ["symbol", "x"])
    out = lambda m: F.when(F.col("mode") == "contained", F.col(f"held_{m}")).otherwise(F.col(f"out_{m}"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"in_{m}").alias("in_value"), out(m).alias("out_value")) for m in MEASURES)))
    rows = rows.select("symbol", "x", "mode", each.alias("m")).select("symbol", "x", "mode", "m.*").where("in_value <> 0 AND out_value IS NOT NULL")
    passes = F.lit(True) if rate > 100 else F.col("out_value") <= rate * F.col("in_value")
    return rows.withColumns({"ratio": F.col("out_value") / F.col("in_value"), "flag": F.when(passes, 1).otherwise(-1)})
