"""Classic structure against models written from the rules, over random walks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import classic, divergence, levels, points, structure

START = datetime(2024, 1, 2, 9, 30)
RULES = [
    classic.StrokeRules(), classic.StrokeRules(check="half", strict=False), classic.StrokeRules(check="loss", strict=False, gaps=True), classic.StrokeRules(check="totally", any_span=True, peaks=False),
]


def walk(seed, n=260):
    rng = random.Random(seed)
    price, out = 50.0, []
    for _ in range(n):
        price += rng.choice((-1.5, -0.5, 0.5, 1.5)) + rng.choice((0, 0, 0, 3, -3))
        high = price + rng.choice((0.0, 0.3, 0.9))
        out.append((round(high, 2), round(min(high, price - rng.choice((0.0, 0.3, 0.9))), 2)))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(f"w{s}", x, START + timedelta(minutes=x), l, h, l, h, 1.0, 2.0) for s in range(5) for x, (h, l) in enumerate(walk(s, 3 if s == 4 else 260))]
    return spark.createDataFrame(rows, "symbol string, x long, ts timestamp, open double, high double, low double, close double, volume double, amount double").cache()


def model_groups(ranges):
    out = []
    for x, (h, l) in enumerate(ranges):
        if out:
            g = out[-1]
            if (g["h"] >= h and g["l"] <= l) or (g["h"] <= h and g["l"] >= l):
                if not (h == l and h == (g["h"] if g["up"] else g["l"])):
                    f = max if g["up"] else min
                    g["h"], g["l"] = f(g["h"], h), f(g["l"], l)
                g["xs"].append(x)
                continue
        out.append({"h": h, "l": l, "up": not out or h > out[-1]["h"], "xs": [x], "born": (h, l)})
    return out


def model_strokes(ranges, rules):
    g = model_groups(ranges)
    last = len(g) - 1

    def kind(i):
        if not 0 < i < last:
            return None
        a, b, (ch, cl) = g[i - 1], g[i], g[i + 1]["born"]
        return "top" if a["h"] < b["h"] > ch and a["l"] < b["l"] > cl else "bottom" if a["h"] > b["h"] < ch and a["l"] > b["l"] < cl else None

    def joins(i, j, virtual=False):
        k = kind(i)
        span = j - i
        if not rules.any_span:
            if rules.gaps and span < 4:
                for m in range(i, j):
                    lo, hi = min(ranges[x][1] for x in g[m]["xs"]), max(ranges[x][0] for x in g[m]["xs"])
                    lo2, hi2 = min(ranges[x][1] for x in g[m + 1]["xs"]), max(ranges[x][0] for x in g[m + 1]["xs"])
                    span += lo2 > hi or hi2 < lo
            if rules.strict and span < 4:
                return False
            if not rules.strict and (span < 3 or sum(len(g[m]["xs"]) for m in range(i + 1, j)) < 3):
                return False
        if virtual and g[j]["up"] != (k == "bottom") or not virtual and kind(j) in (None, k):
            return False
        ends, begins = [(g[j]["h"], g[j]["l"])], [(g[i]["h"], g[i]["l"])]
        if rules.check != "loss":
            ends.append((g[j - 1]["h"], g[j - 1]["l"]))
            begins.append((g[i + 1]["h"], g[i + 1]["l"]))
        if rules.check in ("strict", "totally"):
            begins.append((g[i - 1]["h"], g[i - 1]["l"]))
            if not virtual:
                ends.append(g[j + 1]["born"])
        if k == "top":
            edge = max(h for h, _ in ends)
            ok = g[i]["l"] > edge if rules.check == "totally" else g[i]["h"] > edge and g[j]["l"] < min(l for _, l in begins)
            inner = all(g[m]["l"] >= g[j]["l"] for m in range(i + 1, j))
        else:
            edge = min(l for _, l in ends)
            ok = g[i]["h"] < edge if rules.check == "totally" else g[i]["l"] < edge and g[j]["h"] > max(h for h, _ in begins)
            inner = all(g[m]["h"] <= g[j]["h"] for m in range(i + 1, j))
        return ok and (inner or not rules.peaks)

    free, out = [], []
    for j in range(len(g)):
        if kind(j) is None:
            continue
        if not out:
            i = next((i for i in free if kind(i) != kind(j) and joins(i, j)), None)
            if i is None:
                free.append(j)
            else:
                out.append([i, j])
        elif kind(j) == kind(out[-1][1]):
            if g[j]["h"] >= g[out[-1][1]]["h"] if kind(j) == "top" else g[j]["l"] <= g[out[-1][1]]["l"]:
                out[-1][1] = j
        elif joins(out[-1][1], j):
            out.append([out[-1][1], j])
    rows = [(i, j, True) for i, j in out]
    if out and out[-1][1] != last:
        i, j = out[-1]
        up = kind(j) == "top"
        if g[last]["h"] >= g[j]["h"] if up else g[last]["l"] <= g[j]["l"]:
            rows[-1] = (i, last, False)
        else:
            new = next((m for m in range(last, j, -1) if joins(j, m, True)), None)
            if new is not None:
                rows.append((j, new, False))
    return rows


@pytest.mark.parametrize("rules", RULES)
def test_strokes(bars, rules):
    got = {}
    for r in classic.strokes(classic.turns(classic.classic_groups(bars), bars), bars, rules).orderBy("symbol", "idx").collect():
        got.setdefault(r.symbol, []).append((r.begin_seq, r.end_seq, r.is_sure))
    want = {f"w{s}": model_strokes(walk(s, 3 if s == 4 else 260), rules) for s in range(5)}
    assert got == {k: v for k, v in want.items() if v}


def lines_of(spark, prices, symbol="s"):
    rows = [(symbol, i, 1 if b > a else -1, float(a), float(b), 10 * i, 10 * i + 10, True) for i, (a, b) in enumerate(zip(prices, prices[1:]))]
    return spark.createDataFrame(rows, "symbol string, idx long, dir int, begin_price double, end_price double, begin_x long, end_x long, is_sure boolean")


def spans(df):
    return [(r.begin_line, r.end_line, r.dir, r.is_sure, r.reason) for r in df.orderBy("idx").collect()]


def test_segments_by_hand(spark):
    # Up in three lines, then down: the highs 10, 14, 12 of the counter lines make the turn at 14.
    prices = [0, 10, 6, 14, 8, 12, 4, 7, 1, 5, 2]
    assert spans(classic.segments(lines_of(spark, prices)))[0] == (0, 2, 1, True, "normal")
    # A gap between the first two counter lines needs the turn back.
    gap = [0, 5, 3, 20, 12, 16, 8, 18, 10, 30]
    assert spans(classic.segments(lines_of(spark, gap)))[-1][3] is False
    assert spans(classic.segments(lines_of(spark, [0, 3]))) == []
    assert spans(classic.segments(lines_of(spark, [0, 5, 2, 8]), by_peak=False)) == [(0, 2, 1, False, "0seg_collect_all")]


def test_segments_tile_the_lines(spark):
    for seed in range(4):
        rng = random.Random(seed)
        prices, up = [50.0], True
        for _ in range(120):
            prices.append(prices[-1] + (1 if up else -1) * rng.uniform(0.5, 9))
            up = not up
        lines = lines_of(spark, prices)
        found = classic.segments(lines).orderBy("idx").collect()
        assert found[0].begin_line == 0
        for a, b in zip(found, found[1:]):
            assert b.begin_line == a.end_line + 1
        for r in found:
            assert not r.is_sure or (r.end_line - r.begin_line >= 2 and (r.end_price - r.begin_price) * r.dir >= 0)
            assert r.begin_price == prices[r.begin_line] and r.end_price == prices[r.end_line + 1]
        placed = classic.in_segments(lines, classic.segments(lines)).collect()
        assert len(placed) == 120
        for merge in ("", "range", "peak"):
            for p in classic.segment_pivots(classic.in_segments(lines, classic.segments(lines)), classic.PivotRules(merge=merge)).collect():
                inside = [(prices[i], prices[i + 1]) for i in range(p.begin_line, p.end_line + 1, 2)]
                assert p.begin_line > 0 and p.peak_high == max(map(max, inside)) and p.peak_low == min(map(min, inside))
                if not merge:
                    two = inside[:2]
                    assert (p.low, p.high) == (max(map(min, two)), min(map(max, two))) and p.low < p.high
                    assert all(max(x) > p.low and min(x) < p.high for x in inside)


def test_strengths_by_hand(spark):
    bars = spark.createDataFrame([("s", x, h, r, 1.0, 2.0) for x, (h, r) in enumerate([(1.0, 40.0), (2.0, 60.0), (-1.0, 50.0), (3.0, 70.0), (1.0, 30.0)])], "symbol string, x long, hist double, rsi double, volume double, amount double")
    line = spark.createDataFrame([("s", 0, 1, 0, 4, 10.0, 20.0, 0, 4)], "symbol string, idx long, dir int, begin_x long, end_x long, begin_price double, end_price double, from_x long, to_x long")
    r = divergence.strengths(line, bars).first()
    assert (r.area_in, r.area_out, r.full_area) == pytest.approx((3 + 1e-7, 4 + 1e-7, 7 + 1e-7))
    assert (r.peak, r["diff"], r.volume, r.amount, r.volume_avg, r.amount_avg, r.rsi) == (3, 4, 5, 10, 1, 2, 70)
    assert (r.slope, r.amp) == pytest.approx((10 / 20 / 5, 1.0))


def test_strengths_from_and_to_a_price_of_zero(spark):
    bars = spark.createDataFrame([("s", x, 1.0, 50.0, 1.0, 2.0) for x in range(5)], "symbol string, x long, hist double, rsi double, volume double, amount double")
    rows = [("s", 0, 1, 0, 1, 0.0, 20.0, 0, 1), ("s", 1, -1, 1, 2, 20.0, 0.0, 1, 2), ("s", 2, 1, 2, 3, -4.0, 0.0, 2, 3)]
    lines = spark.createDataFrame(rows, "symbol string, idx long, dir int, begin_x long, end_x long, begin_price double, end_price double, from_x long, to_x long")
    got = [(r.slope, r.amp, r.volume) for r in divergence.strengths(lines, bars).orderBy("idx").collect()]
    assert got == [(0.5, None, 2), (0.5, 1, 2), (None, -1, 2)]


def test_exits_to_a_price_of_zero_and_from_no_strength(spark):
    prices, peaks = [10.0, 4.0, 8.0, 5.0, 0.0, 6.0, 12.0], [0.0, 1.0, 2.0, None, 3.0, 1.0]
    rows = [("s", i, 1 if b > a else -1, a, b, p) for i, (a, b, p) in enumerate(zip(prices, prices[1:], peaks))]
    lines = spark.createDataFrame(rows, "symbol string, idx long, dir int, begin_price double, end_price double, peak double")
    pivots = spark.createDataFrame([("s", 0, 1, 2, 0, 3, 5.0, 8.0), ("s", 1, 1, 2, 1, 4, 5.0, 8.0)], "symbol string, seq long, begin_line long, end_line long, in_line long, out_line long, low double, high double")
    told = lambda rate: [(r.breaks, r.ratio, r.diverges, r.is_peak, r.nearest) for r in divergence.exits(pivots, lines, rate=rate).orderBy("seq").collect()]
    assert told(float("inf")) == [(True, None, True, True, None), (False, 3, False, False, None)]
    assert told(0.9) == [(True, None, False, True, None), (False, 3, False, False, None)]


def test_letters(spark):
    got = [r.s for r in spark.range(30).select(points.suffix(F.col("id")).alias("s")).collect()]
    assert got[:3] == ["a", "b", "c"] and got[25:28] == ["z", "aa", "ab"]


def test_first_and_later_points(spark):
    ranges = [(20, 10), (19, 12), (8, 4), (9, 5), (8, 3), (8, 6), (14, 11), (15, 12), (30, 20)]
    units = spark.createDataFrame([("s", x, float(l), float(h), float(l), float(h) - 0.5) for x, (h, l) in enumerate(ranges)], "symbol string, x long, open double, high double, low double, close double")
    pivots = structure.pivots(units)
    label = lambda f: [(r.x, r.label) for r in f(pivots, units).orderBy("x", "label").collect()]
    assert label(points.first_class) == [(2, "1Ba"), (4, "1Ba"), (6, "1Sa"), (7, "1Sa"), (8, "1Sa")]
    assert label(points.second_class) == [(3, "2Ba"), (5, "2Ba")]
    assert label(points.nth_class) == [(6, "3Ba"), (7, "3Bb"), (8, "4Ba")]


def test_truncated_levels(spark):
    # A bar that swallows the running group and breaks the last bottom cuts it: its top is told at once.
    ranges = [(10, 9), (9, 8), (10.5, 9.5), (12, 11), (13, 7), (12.5, 6)]
    rows = [("s", x, START, float(l), float(h), float(l), float(h), 1.0) for x, (h, l) in enumerate(ranges)]
    bars = spark.createDataFrame(rows, "symbol string, x long, ts timestamp, open double, high double, low double, close double, volume double")
    found = [(r.fx, r.confirm_x, r.pole_x, r.truncated) for r in levels.confirms(levels.bar_units(bars)).orderBy("confirm_x").collect()]
    assert found[:2] == [("bottom", 2, 1, False), ("top", 4, 3, True)]
    plain = [(r.fx, r.confirm_x, r.pole_x, r.truncated) for r in levels.confirms(levels.bar_units(bars), truncation=False).orderBy("confirm_x").collect()]
    assert plain == [("bottom", 2, 1, False), ("top", 5, 4, False)]
