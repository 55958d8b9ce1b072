"""Classic structure: merged groups, strokes between fractals, segments of strokes, and pivots inside of segments.

Each step is a stream over the ordered rows of a symbol with a small state; what needs no order is a join or a window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.folds import ordered_fold, ordered_stream
from barloom.operators.structure import GROUP, fractals

STROKE = "idx long, dir int, begin_seq long, end_seq long, begin_price double, end_price double"
SEGMENT = "idx long, dir int, begin_line long, end_line long, begin_price double, end_price double, begin_x long, end_x long, is_sure boolean, reason string"
PIVOT = "seq long, seg_idx long, begin_line long, end_line long, low double, high double, peak_low double, peak_high double, is_sure boolean, n_merged long"
TOP, BOTTOM = "top", "bottom"


class ClassicGroups:
    """Bars one of which holds the other merge in the direction of their group; a bar of one price at the group's edge changes nothing."""

    def __init__(self) -> None:
        self.open: list | None = None

    def add(self, x, high, low) -> list[tuple]:
        g = self.open
        if g is None:
            self.open = [0, x, x, high, low, "up", 1, high, low]
            return []
        if (g[3] >= high and g[4] <= low) or (g[3] <= high and g[4] >= low):
            up = g[5] == "up"
            if high != low or high != (g[3] if up else g[4]):
                pick = max if up else min
                g[3], g[4] = pick(g[3], high), pick(g[4], low)
            g[2], g[6] = x, g[6] + 1
            return []
        self.open = [g[0] + 1, x, x, high, low, "up" if high > g[3] else "down", 1, high, low]
        return [(*g, True)]

    def end(self) -> list[tuple]:
        return [(*self.open, False)] if self.open else []


def classic_groups(bars: DataFrame) -> DataFrame:
    """Bars merged by containment, the first two too."""
    return ordered_fold(bars, ClassicGroups, ["x", "high", "low"], GROUP)


@dataclass(frozen=True)
class StrokeRules:
    """``check``: how an end is held against the begin and its neighbours (``strict``, ``loss``, ``half``, ``totally``).

    ``strict``: four groups apart, else three and three bars between; ``gaps``: a gap between groups counts as one;
    ``any_span``: no least span; ``peaks``: nothing between goes beyond the ends; ``inner_peaks``: an end isn't moved
    over a stroke that goes back.
    """

    check: str = "strict"
    strict: bool = True
    gaps: bool = False
    any_span: bool = False
    peaks: bool = True
    inner_peaks: bool = True


class Turn(NamedTuple):
    """A fractal with its neighbours; ``born_``: the next group as it was when the fractal was told."""

    seq: int
    fx: str
    high: float
    low: float
    before_high: float
    before_low: float
    next_high: float
    next_low: float
    born_high: float
    born_low: float
    x1: int
    x2: int
    gaps: int

    def price(self) -> float:
        return self.high if self.fx == TOP else self.low


def _far_enough(rules: StrokeRules, span: int, gaps: int, bars: int) -> bool:
    if rules.any_span:
        return True
    if rules.gaps and span < 4:
        span += gaps
    return span >= 4 if rules.strict else span >= 3 and bars >= 3


def _valid(check: str, a: Turn, b: Turn) -> bool:
    """Whether the fractal b is beyond a and its neighbours, and a beyond b and its own."""
    flip = 1 if a.fx == TOP else -1  # of a bottom with a top all is upside down
    near = (lambda low, high: high) if flip > 0 else (lambda low, high: low)
    far = (lambda low, high: low) if flip > 0 else (lambda low, high: high)
    ends = [(b.low, b.high)] + ([(b.before_low, b.before_high)] if check != "loss" else []) + ([(b.born_low, b.born_high)] if check in ("strict", "totally") else [])
    begins = [(a.low, a.high)] + ([(a.next_low, a.next_high)] if check != "loss" else []) + ([(a.before_low, a.before_high)] if check in ("strict", "totally") else [])
    edge = max(flip * near(*p) for p in ends)
    if check == "totally":
        return flip * far(a.low, a.high) > edge
    return flip * near(a.low, a.high) > edge and flip * far(b.low, b.high) < min(flip * far(*p) for p in begins)


class Strokes:
    """Strokes between fractals; the last may still move its end, so it is given at the end or when the next begins."""

    def __init__(self, rules: StrokeRules):
        self.rules = rules
        self.waiting: list[list] = []  # before the first stroke: fractals and what lies behind each
        self.strokes: deque = deque()  # begin and end
        self.behind: tuple[float, float] = (float("-inf"), float("inf"))
        self.idx = -1

    def _joins(self, a: Turn, b: Turn, behind: tuple[float, float]) -> bool:
        rules = self.rules
        if a.fx == b.fx or not _far_enough(rules, b.seq - a.seq, b.gaps - a.gaps, b.x1 - a.x2 - 1) or not _valid(rules.check, a, b):
            return False
        return not rules.peaks or (behind[0] <= b.high if b.fx == TOP else behind[1] >= b.low)

    def _out(self, stroke: tuple[Turn, Turn]) -> tuple:
        a, b = stroke
        self.idx += 1
        return (self.idx, 1 if b.fx == TOP else -1, a.seq, b.seq, a.price(), b.price())

    def _inner_peak(self, new: Turn) -> bool:
        """Whether the last stroke falls away, and the one before it ends at ``new``."""
        if self.rules.inner_peaks or len(self.strokes) < 2:
            return False
        (before_begin, before_end), (begin, end) = self.strokes[-2], self.strokes[-1]
        up = end.fx == TOP
        if (new.low > begin.price() if up else new.high < begin.price()) or (end.price() > before_begin.price() if up else end.price() < before_begin.price()):
            return False
        inside = [t for s in list(self.strokes)[-2:] for t in s if before_begin.seq < t.seq < new.seq]
        return new.fx == before_end.fx and all(t.high <= new.high if new.fx == TOP else t.low >= new.low for t in inside)

    def add(self, *row) -> list[tuple]:
        new = Turn(*row)
        out: list[tuple] = []
        if not self.strokes:
            for old, behind in self.waiting:
                if self._joins(old, new, behind):
                    self.strokes.append((old, new))
                    self.waiting, self.behind = [], (float("-inf"), float("inf"))
                    return []
            for entry in self.waiting:
                entry[1] = (max(entry[1][0], new.high), min(entry[1][1], new.low))
            self.waiting.append([new, (float("-inf"), float("inf"))])
            return []
        begin, end = self.strokes[-1]
        if new.fx == end.fx:
            if new.high >= end.high if end.fx == TOP else new.low <= end.low:
                self.strokes[-1], self.behind = (begin, new), (float("-inf"), float("inf"))
                return []
        elif self._joins(end, new, self.behind):
            self.strokes.append((end, new))
            self.behind = (float("-inf"), float("inf"))
            while len(self.strokes) > 1 and self.rules.inner_peaks:
                out.append(self._out(self.strokes.popleft()))
            return out
        elif self._inner_peak(new) and (new.high >= self.strokes[-2][1].high if new.fx == TOP else new.low <= self.strokes[-2][1].low):
            self.strokes.pop()
            self.strokes[-1], self.behind = (self.strokes[-1][0], new), (float("-inf"), float("inf"))
            return []
        self.behind = (max(self.behind[0], new.high), min(self.behind[1], new.low))
        return []

    def end(self) -> list[tuple]:
        return [self._out(s) for s in self.strokes]


def turns(groups: DataFrame, bars: DataFrame) -> DataFrame:
    """Fractals of groups with their neighbours and the number of gaps before them."""
    w = W.partitionBy("symbol").orderBy("seq")
    held = groups.select("symbol", "seq", F.explode(F.sequence("x1", "x2")).alias("x")).join(bars.select("symbol", "x", "high", "low"), ["symbol", "x"])
    wide = held.groupBy("symbol", "seq").agg(F.max("high").alias("most"), F.min("low").alias("least"))
    rows = groups.join(wide, ["symbol", "seq"])
    gap = (F.lead("least").over(w) > F.col("most")) | (F.lead("most").over(w) < F.col("least"))
    rows = rows.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int"))
    near = {f"{n}_{c}": f(c).over(w) for n, f in (("before", F.lag), ("next", F.lead)) for c in ("high", "low")}
    near |= {"next_born_high": F.lead("born_high").over(w), "next_born_low": F.lead("born_low").over(w)}
    rows = rows.withColumns(near | {"gaps": F.coalesce(F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    told = fractals(groups).select("symbol", "seq", "fx")
    return rows.drop("dir").join(told, ["symbol", "seq"], "left").join(groups.select("symbol", "seq", "dir"), ["symbol", "seq"])


def sure_strokes(turns_: DataFrame, rules: StrokeRules = StrokeRules()) -> DataFrame:
    """Strokes between fractals."""
    rows = turns_.where("fx IS NOT NULL").withColumns({"born_high": F.col("next_born_high"), "born_low": F.col("next_born_low")})
    return ordered_fold(rows, lambda: Strokes(rules), list(Turn._fields), STROKE, order="seq")


def strokes(turns_: DataFrame, bars: DataFrame, rules: StrokeRules = StrokeRules()) -> DataFrame:
    """Strokes, the last of which may be unsure: it goes on to the last group, or the newest group that a stroke could end at ends one.

    With the bars of the extremes (the last that has it in its group), ``begin_x`` and ``end_x``, and those of the groups, ``from_x`` and ``to_x``.
    """
    found = sure_strokes(turns_, rules)
    last = found.groupBy("symbol").agg(F.max_by(F.struct("idx", "dir", "end_seq", "end_price"), "idx").alias("s"))
    groups = turns_.join(last, "symbol").where(F.col("seq") >= F.col("s.end_seq"))
    up = F.col("s.dir") > 0
    w = W.partitionBy("symbol").orderBy("seq")
    newest = W.partitionBy("symbol")
    end = {c: F.max(F.when(F.col("seq") == F.col("s.end_seq"), F.col(c))).over(newest) for c in ("high", "low", "before_high", "before_low", "next_high", "next_low", "x2", "gaps")}
    inner = w.rowsBetween(W.unboundedPreceding, -1)
    after = lambda c: F.when(F.col("seq") > F.col("s.end_seq"), F.col(c))
    rows = groups.withColumns({f"end_{c}": v for c, v in end.items()} | {"top": F.max(after("high")).over(inner), "bottom": F.min(after("low")).over(inner), "newest": F.max("seq").over(newest)})
    rows = rows.where(F.col("seq") > F.col("s.end_seq"))
    goes_on = (F.col("seq") == F.col("newest")) & F.when(up, F.col("high") >= F.col("s.end_price")).otherwise(F.col("low") <= F.col("s.end_price"))
    span, between = F.col("seq") - F.col("s.end_seq"), F.col("x1") - F.col("end_x2") - 1
    if rules.gaps:
        span = F.when(span < 4, span + F.col("gaps") - F.col("end_gaps")).otherwise(span)
    far = F.lit(True) if rules.any_span else span >= 4 if rules.strict else (span >= 3) & (between >= 3)
    ok = far & (F.col("dir") == F.when(up, "down").otherwise("up")) & _virtual(rules.check, up)
    if rules.peaks:
        ok &= F.when(up, F.coalesce(F.col("bottom") >= F.col("low"), F.lit(True))).otherwise(F.coalesce(F.col("top") <= F.col("high"), F.lit(True)))
    kind = F.when(goes_on, 2).when(ok, 1)
    tail = rows.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("symbol").agg(F.max_by(F.struct("kind", "seq", "high", "low"), F.struct("kind", "seq")).alias("t"), F.any_value("s").alias("s"))
    extended = tail.where("t.kind = 2").select("symbol", F.col("s.idx").alias("idx"), F.col("t.seq").alias("new_end"), F.when(up, F.col("t.high")).otherwise(F.col("t.low")).alias("new_price"))
    old = found.join(extended, ["symbol", "idx"], "left").select(
        "symbol", "idx", "dir", "begin_seq", F.coalesce("new_end", "end_seq").alias("end_seq"), "begin_price", F.coalesce("new_price", "end_price").alias("end_price"), F.col("new_end").isNull().alias("is_sure")
    )
    added = tail.where("t.kind = 1").select(
        "symbol", (F.col("s.idx") + 1).alias("idx"), (-F.col("s.dir")).alias("dir"), F.col("s.end_seq").alias("begin_seq"), F.col("t.seq").alias("end_seq"), F.col("s.end_price").alias("begin_price"),
        F.when(up, F.col("t.low")).otherwise(F.col("t.high")).alias("end_price"), F.lit(False).alias("is_sure"),
    )
    return _placed(old.unionByName(added), turns_, bars)


def _virtual(check: str, up: Column) -> Column:
    """The check of a stroke's begin (``end_`` columns) and a group that may end it; ``up``: the begin is a top."""
    g = lambda f, *cs: f(*cs) if len(cs) > 1 else F.col(cs[0])
    wide = check in ("strict", "totally")
    b_high, b_low = (["high"], ["low"]) if check == "loss" else (["high", "before_high"], ["low", "before_low"])
    a_low, a_high = (["end_low"], ["end_high"]) if check == "loss" else (["end_low", "end_next_low"], ["end_high", "end_next_high"])
    if wide:
        a_low, a_high = [*a_low, "end_before_low"], [*a_high, "end_before_high"]
    if check == "totally":
        return F.when(up, F.col("end_low") > g(F.greatest, *b_high)).otherwise(F.col("end_high") < g(F.least, *b_low))
    down = (F.col("end_high") > g(F.greatest, *b_high)) & (F.col("low") < g(F.least, *a_low))
    rise = (F.col("end_low") < g(F.least, *b_low)) & (F.col("high") > g(F.greatest, *a_high))
    return F.when(up, down).otherwise(rise)


def _placed(strokes_: DataFrame, groups: DataFrame, bars: DataFrame) -> DataFrame:
    held = groups.select("symbol", "seq", "x1", "x2", F.col("high").alias("h"), F.col("low").alias("l"), F.explode(F.sequence("x1", "x2")).alias("x")).join(bars.select("symbol", "x", "high", "low"), ["symbol", "x"])
    of = lambda c: F.max(F.when(c, F.col("x")))
    peaks = held.groupBy("symbol", "seq").agg(of(F.col("high") == F.col("h")).alias("high_x"), of(F.col("low") == F.col("l")).alias("low_x"), F.min("x").alias("x1"), F.max("x").alias("x2"))
    begin, end = (peaks.select("symbol", F.col("seq").alias(f"{n}_seq"), *(F.col(c).alias(f"{n}_{c}") for c in ("high_x", "low_x", "x1", "x2"))) for n in ("begin", "end"))
    up = F.col("dir") > 0
    return strokes_.join(begin, ["symbol", "begin_seq"]).join(end, ["symbol", "end_seq"]).select(
        "symbol", "idx", "dir", "begin_seq", "end_seq", "begin_price", "end_price", "is_sure", F.when(up, F.col("begin_low_x")).otherwise(F.col("begin_high_x")).alias("begin_x"),
        F.when(up, F.col("end_high_x")).otherwise(F.col("end_low_x")).alias("end_x"), F.col("begin_x1").alias("from_x"), F.col("end_x2").alias("to_x"),
    )


class Line(NamedTuple):
    idx: int
    dir: int
    begin_price: float
    end_price: float
    begin_x: int
    end_x: int
    is_sure: bool

    @property
    def high(self) -> float:
        return max(self.begin_price, self.end_price)

    @property
    def low(self) -> float:
        return min(self.begin_price, self.end_price)


class Lines:
    """Lines by number, read as they are asked for; those before the last segment are let go."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows, self.first, self.held = rows, 0, deque()

    def get(self, i: int) -> Line | None:
        while i >= self.first + len(self.held):
            row = next(self.rows, None)
            if row is None:
                return None
            self.held.append(Line(*row))
        return self.held[i - self.first] if i >= self.first else None

    def let_go(self, i: int) -> None:
        while self.first < i and self.held:
            self.held.popleft()
            self.first += 1

    def since(self, i: int) -> Iterator[Line]:
        while (line := self.get(i)) is not None:
            yield line
            i += 1


class _Element:
    """Counter lines merged by containment."""

    def __init__(self, line: Line, way: int):
        self.lines, self.high, self.low, self.way = [line], line.high, line.low, way

    def holds(self, line: Line) -> bool:
        return self.high >= line.high and self.low <= line.low

    def merges(self, line: Line) -> bool:
        """Whether one holds the other; not if the line holds this and shares its edge in the segment's direction."""
        if self.holds(line):
            return True
        if self.high <= line.high and self.low >= line.low:
            return not (self.high == line.high if self.way > 0 else self.low == line.low)
        return False

    def take(self, line: Line) -> None:
        pick, edge = (max, self.high) if self.way > 0 else (min, self.low)
        if line.high != line.low or line.high != edge:
            self.high, self.low = pick(self.high, line.high), pick(self.low, line.low)
        self.lines.append(line)

    def peak(self) -> int:
        value = self.high if self.way > 0 else self.low
        return next((x.idx for x in reversed(self.lines) if (x.high if self.way > 0 else x.low) == value), self.lines[-1].idx) - 1


class Feature:
    """Looks for the turn of a segment that goes ``way``: three elements of its counter lines, the middle one beyond the others."""

    def __init__(self, way: int, lines: Lines):
        self.way, self.lines = way, lines
        self.clear()

    def clear(self) -> None:
        self.seen: list[Line] = []
        self.one: _Element | None = None
        self.two: _Element | None = None
        self.gap, self.evidence = False, None

    def again(self) -> bool:
        """Begin from the second line seen."""
        rest = self.seen[1:]
        self.clear()
        return any(self.add(line) for line in rest)

    def add(self, line: Line) -> bool:
        self.seen.append(line)
        way = self.way
        if self.one is None:
            self.one = _Element(line, way)
        elif self.two is None:
            if self.one.holds(line):
                self.one.take(line)
                return False
            self.two = _Element(line, way)
            if line.high < self.one.high if way > 0 else line.low > self.one.low:
                return self.again()
        else:
            self.evidence = line
            if self.two.merges(line):
                self.two.take(line)
                return False
            one, two = self.one, self.two
            if way > 0:
                turned = one.high < two.high and line.high <= two.high and line.low < two.low
                self.gap = one.high < two.low
            else:
                turned = one.low > two.low and line.low >= two.low and line.high > two.high
                self.gap = one.low > two.high
            return True if self._breaks(line) and turned else self.again()
        return False

    def _breaks(self, line: Line) -> bool:
        """Whether the third element goes past the last line of the second, or the line after next past it."""
        last = self.two.lines[-1]
        if line.low < last.low if self.way > 0 else line.high > last.high:
            return True
        ahead = self.lines.get(line.idx + 2)
        if ahead and (ahead.low < line.low if self.way > 0 else ahead.high > line.high):
            self.evidence = ahead
            return True
        return False

    def turns(self, i: int) -> Iterator[Line]:
        """The counter lines from ``i`` on at which a turn is seen, each read from the second line of the one before."""
        while (line := self.lines.get(i)) is not None:
            seen = self.add(line)
            while seen:
                yield line
                seen = self.again()
            i += 2

    def ends(self) -> bool | None:
        """Whether the turn ends the segment: at once without a gap between its first two elements, else by the first turn
        back that ends itself. None if lines run out before that is told."""
        if not self.gap:
            return True
        start = self.two.peak() + 2
        back = Feature(-self.lines.get(start).dir, self.lines)
        told = ((line, back.ends()) for line in back.turns(start))
        line, answer = next(((line, answer) for line, answer in told if answer is not False), (self.evidence, None))
        self.evidence = line
        return answer

    def sure(self) -> bool:
        return self.evidence.is_sure and all(x.is_sure for x in self.seen)


class Segments:
    """Segments of lines: those ended by a turn, and what is left over behind them."""

    def __init__(self, lines: Lines, by_peak: bool):
        self.lines, self.by_peak = lines, by_peak
        self.made: list[tuple] = []
        self.count, self.last = 0, None  # last: direction, end line

    def _peak(self, lines: Iterator[Line], high: bool) -> Line | None:
        """The line up (or down) that ends furthest, the later read of equal ones; one that the line two before outdoes is none."""
        sign = 1 if high else -1

        def stands(line: Line) -> bool:
            before = self.lines.get(line.idx - 2) if line.idx >= 2 else None
            return line.dir == sign and (before is None or sign * before.end_price <= sign * line.end_price)

        ranked = ((sign * line.end_price, n, line) for n, line in enumerate(lines) if stands(line))
        return max(ranked, default=(0, 0, None), key=lambda r: r[:2])[2]

    def add(self, end: int, sure: bool, way: int = 0, split: bool = True, reason: str = "normal") -> bool:
        get = self.lines.get
        last = get(end)
        if self.last is None and split and end >= 3:
            peak = self._peak((get(i) for i in range(end - 3, -1, -1)), last.dir < 0)
            if peak and (peak.idx == 0 or (peak.low < get(0).low if peak.dir < 0 else peak.high > get(0).high)):
                self.add(peak.idx, False, peak.dir, reason="split_first_1st")
                self.add(end, False, reason="split_first_2nd")
                return True
        start = self.last[1].idx + 1 if self.last else 0
        first, way = get(start), way or last.dir
        sure = sure and end - start >= 2
        if sure and way * (last.end_price - first.begin_price) < 0:
            if self.last is None:
                return False
            sure, reason = False, "wrong_side"  # told as it is, so that one symbol's odd lines end no query
        self.made.append((self.count, way, start, end, first.begin_price, last.end_price, first.begin_x, last.end_x, sure, reason))
        self.count, self.last = self.count + 1, (way, last)
        return True

    def _turn(self, begin: int) -> Feature | None:
        """The first turn from line ``begin`` on.

        ==================  =========================  ====================
        looked for          the counter lines read     looked for from then
        ==================  =========================  ====================
        one way, told       any                        that way
        both ways           two elements of a way      that way, tentatively
        one way, tentative  two elements still         that way, tentatively
        one way, tentative  back to one element        both ways
        ==================  =========================  ====================

        A way is told by the segment before; the first segment has none, and its direction isn't told by the first turn alone.
        """
        both = {way: Feature(way, self.lines) for way in (1, -1)}
        told = {-self.last[0]} if self.last else set()
        wanted = told or set(both)
        for line in self.lines.since(begin):
            way = -line.dir
            if way not in wanted:
                continue
            if both[way].add(line):
                return both[way]
            if not told:
                wanted = {way} if both[way].two else set(both)
                for other in set(both) - wanted:
                    both[other].clear()
        return None

    def run(self) -> Iterator[tuple]:
        begin: int | None = 0
        while begin is not None and (turn := self._turn(begin)):
            told, end = turn.ends(), turn.two.peak()
            if told is False:
                begin = turn.seen[1].idx
            elif not self.add(end, told is True and turn.sure()):
                begin = end + 1
            else:
                begin = end + 1 if told else None
                yield from self.made
                self.made = []
                self.lines.let_go(self.last[1].idx - 3)
        self._left()
        yield from self.made

    def _left(self) -> None:
        if self.last is None:
            lines = list(self.lines.since(0))
            if len(lines) < 3:
                return
            start = lines[0].begin_price
            if not self.by_peak:
                self.add(lines[-1].idx, False, 1 if lines[-1].end_price >= start else -1, False, "0seg_collect_all")
                return
            high = abs(max(x.high for x in lines) - start) >= abs(min(x.low for x in lines) - start)
            if peak := self._peak(iter(lines), high):
                self.add(peak.idx, False, 1 if high else -1, False, "0seg_find_high" if high else "0seg_find_low")
                self._rest(lines[-1])
            return
        tail = deque(self.lines.since(self.last[1].idx), maxlen=1)[0]
        forced = True  # lines that go on beyond the last segment are cut at a peak first; from the first free peak on no more
        while not forced or tail.idx - self.last[1].idx >= 3:
            end = self.last[1]
            beyond = forced and end.dir * (tail.end_price - end.end_price) >= 0
            high = end.dir < 0
            peak = self._peak(self.lines.since(end.idx + 3), high) if beyond or self.by_peak else None
            if peak:
                self.add(peak.idx, False, 1 if high else -1, reason=f"collectleft_find_{'high' if high else 'low'}{'_force' if beyond else ''}")
                forced = beyond
            else:
                if not beyond:
                    self._rest(tail)
                return

    def _rest(self, last: Line) -> None:
        end = self.last[1]
        if end.idx < last.idx:
            same = end.dir == last.dir
            self.add(last.idx - same, False, reason="collect_left_1" if same else "collect_left_0")


def segments(lines: DataFrame, by_peak: bool = True) -> DataFrame:
    """Segments of lines (strokes, or segments themselves); those behind the last turn aren't sure."""
    return ordered_stream(lines, lambda rows: Segments(Lines(rows), by_peak).run(), list(Line._fields), SEGMENT, order="idx")


def as_lines(segments_: DataFrame) -> DataFrame:
    """Segments as the lines of a higher level."""
    return segments_.select("symbol", "idx", "dir", "begin_price", "end_price", "begin_x", "end_x", "is_sure")


def in_segments(lines: DataFrame, segments_: DataFrame) -> DataFrame:
    """``lines`` with ``seg_idx``, ``seg_dir`` and ``seg_sure``; those behind the last segment are in the next, which goes the other way. Without segments all are in 0."""
    held = segments_.select("symbol", F.col("idx").alias("seg_idx"), F.col("dir").alias("seg_dir"), F.col("is_sure").alias("seg_sure"), F.explode(F.sequence("begin_line", "end_line")).alias("idx"))
    last = segments_.groupBy("symbol").agg((F.max("idx") + 1).alias("next_idx"), (-F.max_by("dir", "idx")).alias("next_dir"))
    rows = lines.join(held, ["symbol", "idx"], "left").join(last, "symbol", "left")
    return rows.select(
        *(c for c in lines.columns), F.coalesce("seg_idx", "next_idx", F.lit(0)).alias("seg_idx"), F.coalesce("seg_dir", "next_dir").alias("seg_dir"), F.coalesce("seg_sure", F.lit(False)).alias("seg_sure")
    )


@dataclass(frozen=True)
class PivotRules:
    """``merge``: pivots of a segment that overlap by range (``range``) or by peaks (``peak``) become one, or none do (empty);
    ``single``: one line makes a pivot; ``over_segments``: three lines make one, wherever segments end."""

    merge: str = "range"
    single: bool = False
    over_segments: bool = False


class _Pivot:
    def __init__(self, lines: list[tuple], seg_idx: int, sure: bool):
        self.begin, self.end, self.seg_idx, self.sure, self.merged = lines[0][0], lines[-1][0], seg_idx, sure, 1
        self.range(lines)
        self.peak_high, self.peak_low = max(x[2] for x in lines), min(x[3] for x in lines)
        self.first = lines[0]

    def range(self, lines: list[tuple]) -> None:
        self.low, self.high = max(x[3] for x in lines), min(x[2] for x in lines)

    def touches(self, line: tuple) -> bool:
        return line[2] > self.low and self.high > line[3]

    def take(self, line: tuple) -> bool:
        if not self.touches(line):
            return False
        if self.begin == self.end:
            self.range([self.first, line])
        self.end, self.peak_high, self.peak_low = line[0], max(self.peak_high, line[2]), min(self.peak_low, line[3])
        return True

    def merges(self, other: _Pivot, how: str) -> bool:
        if other.begin == other.end or self.seg_idx != other.seg_idx or not how:
            return False
        if how == "range":
            meet = other.high >= self.low and self.high >= other.low
        else:
            meet = other.peak_high > self.peak_low and self.peak_high > other.peak_low
        if meet:
            self.low, self.high, self.end = min(self.low, other.low), max(self.high, other.high), other.end
            self.peak_low, self.peak_high, self.merged = min(self.peak_low, other.peak_low), max(self.peak_high, other.peak_high), self.merged + other.merged
        return meet


class SegmentPivots:
    """Pivots of the counter lines of each segment: two that overlap make one, others that touch it extend it."""

    def __init__(self, rules: PivotRules):
        self.rules, self.seq, self.seg, self.free, self.made, self.late = rules, -1, None, [], [], None

    def _given(self, keep: int) -> list[tuple]:
        out = []
        while len(self.made) > keep:
            p = self.made.pop(0)
            self.seq += 1
            out.append((self.seq, p.seg_idx, p.begin, p.end, p.low, p.high, p.peak_low, p.peak_high, p.sure, p.merged))
        return out

    def _joined(self) -> None:
        while len(self.made) > 1 and self.made[-2].merges(self.made[-1], self.rules.merge):
            self.made.pop()

    def _wait(self, line: tuple, sure: bool) -> None:
        self.free.append(line)
        n = 3 if self.rules.over_segments else 1 if self.rules.single and len(self.free) == 1 else 2
        some = self.free[-n:]
        if len(some) < n or (self.rules.over_segments and some[0][1] == some[0][5]):
            return
        if min(x[2] for x in some) > max(x[3] for x in some) and some[0][0] > 0:
            self.made.append(_Pivot(some, some[0][4], sure))
            self.free = []
            self._joined()

    def add(self, *line) -> list[tuple]:
        idx, way, _, _, seg, seg_way, sure, _ = line
        if self.rules.over_segments:
            late, self.late = self.late, line
            if late:
                self._over(late, line)
            return self._given(2)
        out: list[tuple] = []
        if seg != self.seg:
            self.seg, self.free = seg, []
            out = self._given(0)
        if way == seg_way or seg_way is None:
            return out
        if self.made and not self.free and self.made[-1].take(line):
            self._joined()
        else:
            self._wait(line, sure)
        return out

    def _over(self, line: tuple, after: tuple | None) -> None:
        last = self.made[-1] if self.made and not self.free else None
        if last:
            if after is None:
                return
            near = line[0] - last.end <= 1
            if near and last.touches(after) and last.take(line) or near and last.touches(line):
                return
        self._wait(line, line[7])

    def end(self) -> list[tuple]:
        if self.late:
            self._over(self.late, None)
        return self._given(0)


def segment_pivots(lines: DataFrame, rules: PivotRules = PivotRules()) -> DataFrame:
    """Pivots of ``lines`` (of :func:`in_segments`)."""
    rows = lines.withColumns({"high": F.greatest("begin_price", "end_price"), "low": F.least("begin_price", "end_price")})
    return ordered_fold(rows, lambda: SegmentPivots(rules), ["idx", "dir", "high", "low", "seg_idx", "seg_dir", "seg_sure", "is_sure"], PIVOT, order="idx")


def in_and_out(pivots: DataFrame, lines: DataFrame, segments_: DataFrame) -> DataFrame:
    """``pivots`` with ``in_line`` and ``out_line`` (null if there is none yet) and ``segment``, the one that their first line is in (null behind the last)."""
    last = lines.groupBy("symbol").agg(F.max("idx").alias("last_line"))
    held = segments_.select("symbol", F.col("idx").alias("segment"), F.explode(F.sequence("begin_line", "end_line")).alias("begin_line"))
    rows = pivots.join(last, "symbol").join(held, ["symbol", "begin_line"], "left")
    out = F.when(F.col("end_line") < F.col("last_line"), F.col("end_line") + 1)
    return rows.select(*pivots.columns, (F.col("begin_line") - 1).alias("in_line"), out.alias("out_line"), "segment")
