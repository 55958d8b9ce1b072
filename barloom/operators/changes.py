"""What is known of a level as a log of changes: bar by bar, each line and pivot as it is set, frozen or dropped.

The newest line and the last pivots are revised until they are frozen. A change tells a whole row, so the last change of
each key up to a bar is all that was known there, and a log is linear in the bars. The state is the level's open tail: a few
groups and pivots, and the bars since the last pole. The same state serves tables and streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.asof import _Box, _Boxes
from barloom.operators.folds import ordered_fold
from barloom.operators.levels import Level, _Group

CHANGE = (
    "x long, what string, key long, op string, dir int, x1 long, x2 long, open double, high double, low double, close double, volume double, "
    "top double, bottom double, n long"
)
#: A row that may be revised, one that won't be, and a key that is no more.
SET, FREEZE, DROP = "set", "freeze", "drop"
LINE, PIVOT = "line", "pivot"
BAR = ["x", "open", "high", "low", "close", "volume"]


class OpenLevel:
    """A level's open tail. ``add`` takes the next bar and gives its changes."""

    def __init__(self, truncation: bool = True, validity: bool = True, merge: str = "range"):
        self.level, self.boxes = Level(truncation, validity), _Boxes(merge)
        self.bars: list[tuple] = []  # x, high, low, close, volume since the last pole
        self.running: list | None = None  # idx, dir, begin, open, high, low, close, volume
        self.told: dict[int, tuple] = {}  # the last pivots as they were told
        self.sure = -1  # the last pivot that was told as frozen

    def _line(self, idx: int, way: int, begin: int, end: int, open_: float) -> list:
        line = [idx, way, begin, open_, open_, open_, open_, 0.0]
        for bar in self.bars:
            if begin <= bar[0] <= end:
                self._extend(line, bar)
        return line

    @staticmethod
    def _extend(line: list, bar: tuple) -> None:
        x, high, low, close, volume = bar
        line[7] += volume
        if x > line[2]:
            line[4], line[5], line[6] = max(line[4], high), min(line[5], low), close

    @staticmethod
    def _change(x: int, op: str, line: list, end: int) -> tuple:
        idx, way, begin, open_, high, low, close, volume = line
        return (x, LINE, idx, op, way, begin, end, open_, high, low, close, volume, None, None, None)

    def add(self, x, open_, high, low, close, volume) -> list[tuple]:
        bar = (x, high, low, close, volume)
        self.bars.append(bar)
        out: list[tuple] = []
        if self.running:
            self._extend(self.running, bar)
        for _, fx, _, _, _, fx_high, fx_low, pole, used, _, idx, way, _, begin, begin_high, begin_low in self.level.add(x, x, x, high, low, high, x, low, x, x):
            if used:
                line = self._line(idx, way, begin, pole, begin_low if way > 0 else begin_high)
                out.append(self._change(x, FREEZE, line, pole))
                self.boxes.add(0, idx, way, begin, pole, line[3], line[4], line[5], line[6], x)
                self.bars = [b for b in self.bars if b[0] >= pole]
                self.running = self._line(idx + 1, -way, pole, x, fx_high if way > 0 else fx_low)
        if self.running:
            idx, way, begin, open_, high, low, _, _ = self.running
            self.running[6] = close  # at its pole a line's close is the bar's
            out.append(self._change(x, SET, self.running, x))
            out += self._pivots(x, self.boxes.add(1, idx, way, begin, x, open_, high, low, close, x))
        return out

    def _pivots(self, x: int, tails: list[tuple]) -> list[tuple]:
        now = {}
        for _, _, seq, x1, x2, zg, zd, gg, dd, n, way, _, sure, _, _ in tails:
            now[seq] = (x, PIVOT, seq, FREEZE if sure else SET, way, x1, x2, None, zg, zd, None, None, gg, dd, n)
        out = [row for seq, row in sorted(now.items()) if self.told.get(seq, (None,))[1:] != row[1:] and seq > self.sure]
        self.sure = max([self.sure, *(row[2] for row in out if row[3] == FREEZE)])
        out += [(x, PIVOT, seq, DROP, *[None] * 11) for seq in self.told if seq > max(now)]
        self.told = now
        return out

    def end(self) -> list[tuple]:
        return []

    def saved(self) -> dict:
        """The state in plain values, without the bars."""
        level, boxes = self.level, self.boxes
        groups = {n: vars(g) if (g := getattr(level, n)) else None for n in ("first", "before", "last")}
        return {
            "groups": groups, "anchor": level.anchor, "broken": level.broken, "idx": level.idx, "tick": boxes.tick, "running": self.running,
            "closed": [vars(b) for b in boxes.closed], "open": vars(boxes.open) if boxes.open else None, "told": [list(r) for r in self.told.values()], "sure": self.sure,
        }

    def restore(self, saved: dict, bars: list[tuple]) -> OpenLevel:
        def made(cls, values):
            if values is None:
                return None
            one = cls.__new__(cls)
            vars(one).update(values)
            return one

        level, boxes = self.level, self.boxes
        for name, values in saved["groups"].items():
            setattr(level, name, made(_Group, values))
        level.anchor, level.broken, level.idx = saved["anchor"] and tuple(saved["anchor"]), saved["broken"], saved["idx"]
        boxes.tick, boxes.closed, boxes.open = saved["tick"], [made(_Box, b) for b in saved["closed"]], made(_Box, saved["open"])
        self.bars, self.running, self.told, self.sure = list(bars), saved["running"], {r[2]: tuple(r) for r in saved["told"]}, saved["sure"]
        return self


def change_log(bars: DataFrame, truncation: bool = True, validity: bool = True, merge: str = "range") -> DataFrame:
    """The changes of the first level's lines and pivots over bars: ``what`` is ``line`` or ``pivot``, ``key`` its number, ``op`` what became of it.

    ``x1`` to ``x2`` are its bars; ``high`` and ``low`` a line's extremes or a pivot's edges, ``top`` and ``bottom`` a
    pivot's extremes, ``n`` its lines. Of a dropped key nothing else is told. Pivots are told until two others follow them.
    """
    return ordered_fold(bars, lambda: OpenLevel(truncation, validity, merge), BAR, CHANGE)


def versions(log: DataFrame) -> DataFrame:
    """Each change with ``until_x``, the bar at which the next one of its key takes its place (null: none did); drops are left out.

    The snapshot of bar ``x`` is the rows with ``x`` from their own to before ``until_x``.
    """
    w = W.partitionBy("symbol", "what", "key").orderBy("x", F.col("op") == FREEZE)
    return log.withColumn("until_x", F.lead("x").over(w)).where(F.col("op") != DROP).where("until_x IS NULL OR until_x > x")


def snapshot(log: DataFrame, x: int) -> DataFrame:
    """All that was known at bar ``x``."""
    return versions(log.where(F.col("x") <= x)).where("until_x IS NULL").drop("until_x")


def snapshots(log: DataFrame, bars: DataFrame, skip: int = 0, last: int = 2) -> DataFrame:
    """At each bar (``at_x``, the first ``skip`` left out) the newest ``last`` lines and pivots that were known: step by step, as a replay shows it.

    Rows are ``last`` times two for each bar at most: each change stands until the next of its key, and older keys are
    left out as soon as newer ones are there.
    """
    found = versions(log)
    newer = log.where(F.col("op") != DROP).groupBy("symbol", "what", "key").agg(F.min("x").alias("born_x"))
    gone = newer.select("symbol", "what", (F.col("key") - last).alias("key"), F.col("born_x").alias("gone_x"))
    found = found.join(gone, ["symbol", "what", "key"], "left").join(bars.groupBy("symbol").agg(F.max("x").alias("last_x")), "symbol")
    end = F.least(F.coalesce(F.col("until_x") - 1, "last_x"), F.coalesce(F.col("gone_x") - 1, "last_x"), F.col("last_x"))
    begin = F.greatest(F.col("x"), F.lit(skip))
    rows = found.withColumns({"_from": begin, "_to": end}).where("_from <= _to").withColumn("at_x", F.explode(F.sequence("_from", "_to")))
    return rows.select("symbol", "at_x", "what", "key", "op", "dir", "x1", "x2", "open", "high", "low", "close", "volume", "top", "bottom", "n")
