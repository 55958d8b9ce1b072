"""Counts of closes beyond earlier ones: runs of nine (setups) and the countdowns to thirteen that follow them.

A run is of consecutive bars, so a symbol has one live run at most, and one countdown: a run that reaches nine takes the
place of whatever was counted before. The state is those two counters and the last bars.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame

from barloom.operators.folds import ordered_fold

MARK = "x long, kind string, dir int, n int"


@dataclass(frozen=True)
class Demark:
    """``strict``: a countdown counts a close beyond the low or high two back instead of the close; ``perfect``: of a setup's
    last two bars one must go beyond its sixth and seventh; ``breaks``: a close the other way ends countdowns too;
    ``gap``: a setup that begins behind a gap takes the close before it into account."""

    run: int = 9
    back: int = 4
    countdown: int = 13
    countdown_back: int = 2
    gap: bool = True
    strict: bool = False
    perfect: bool = False
    breaks: bool = True


class _Bar(NamedTuple):
    """A bar as one direction sees it: ``far`` is its extreme that way, ``near`` the other one; rising is better in all."""

    close: float
    far: float
    near: float


class Demarks:
    """The counters of one symbol. Prices are turned round for falling runs, so that both directions read as one."""

    def __init__(self, rules: Demark):
        self.rules = rules
        self.way, self.n = 0, 0  # the live run
        self.counted, self.count, self.peak, self.own = 0, 0, 0.0, False  # the countdown: direction, count, edge, is the live run its own
        self.bars: deque = deque(maxlen=max(rules.run + rules.back + 1, rules.countdown_back + 1))

    def _seen(self, way: int, back: int = 0) -> _Bar:
        close, high, low = self.bars[-1 - back]
        return _Bar(close, high, low) if way > 0 else _Bar(-close, -low, -high)

    def _perfect(self, way: int) -> bool:
        far = [self._seen(way, back).far for back in range(4)]
        return not self.rules.perfect or max(far[:2]) > max(far[2:])

    def _edge(self, way: int) -> float:
        """The worst price of the run, or of the close before it if it began behind a gap."""
        edge = min(self._seen(way, back).near for back in range(self.rules.run))
        before, first = self._seen(way, self.rules.run + self.rules.back).close, self._seen(way, self.rules.run - 1)
        return min(edge, before) if self.rules.gap and first.near > before else edge

    def add(self, x, close, high, low) -> list[tuple]:
        rules, marks = self.rules, []
        self.bars.append((close, high, low))
        if len(self.bars) < rules.back + 2:
            return marks
        change = close - self.bars[-1 - rules.back][0]
        way = (change > 0) - (change < 0)
        self.own = self.own and way == self.counted
        self.way, self.n = way, self.n + 1 if way and way == self.way else abs(way)
        if way:
            marks.append((x, "setup", way, self.n))
        whole = self.n == rules.run
        if whole or rules.breaks and way == -self.counted:
            self.counted = 0
        if whole and self._perfect(way):
            marks.append((x, "complete", way, rules.run))
            self.counted, self.count, self.peak, self.own = way, 0, self._edge(way), True
        if self.counted:
            marks += self._countdown(x)
        return marks

    def _countdown(self, x: int) -> list[tuple]:
        rules, way = self.rules, self.counted
        bar, earlier = self._seen(way), self._seen(way, rules.countdown_back)
        if self.count == rules.countdown or bar.near < self.peak:
            self.counted = 0
            if self.own:
                self.n = 0
            return []
        if not (bar.close >= earlier.far if rules.strict else bar.close > earlier.close):
            return []
        self.count += 1
        told = [(x, "countdown", way, self.count)]
        return told + [(x, "complete", way, self.count)] * (self.count == rules.countdown)

    def end(self) -> list[tuple]:
        return []


def demarks(bars: DataFrame, rules: Demark = Demark()) -> DataFrame:
    """Marks of bars: ``kind`` is ``setup``, ``countdown`` or ``complete``, ``n`` the count."""
    return ordered_fold(bars, lambda: Demarks(rules), ["x", "close", "high", "low"], MARK)
