"""Segments, their pivots and points of the second and third class against plain models on random lines."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from barloom.operators import classic, divergence

Line = namedtuple("Line", "idx dir high low begin end")
LINE = "symbol string, idx long, dir int, begin_price double, end_price double, begin_x long, end_x long, is_sure boolean, peak double"


def walk(seed, n=140):
    rng = random.Random(seed)
    prices, up = [50.0], rng.random() < 0.5
    step = (lambda: float(rng.randrange(1, 7))) if seed % 3 == 0 else (lambda: rng.uniform(0.5, 9))
    drift = rng.choice((0, 0.4, 1.0))
    for i in range(n):
        turn = drift if (i // 25) % 2 else -drift
        prices.append(prices[-1] + (1 if up else -1) * step() + turn)
        up = not up
    rows = []
    for i, (a, b) in enumerate(zip(prices, prices[1:])):
        rows.append((f"w{seed}", i, 1 if b > a else -1, a, b, 10 * i, 10 * i + 10, True, rng.uniform(1, 9)))
    return rows


def alternating(rows):
    return all(a[2] != b[2] for a, b in zip(rows, rows[1:]))


WALKS = [w for seed in range(60) if alternating(w := walk(seed))][:24]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([r for w in WALKS for r in w], LINE).cache()


@pytest.fixture(scope="module")
def segments(lines):
    return classic.segments(lines).cache()


def of_symbol(df, order):
    out = {}
    for r in df.orderBy("symbol", order).collect():
        out.setdefault(r.symbol, []).append(r)
    return out


def attempt(some, way):
    """The state that counter lines leave, read from the first one: ``turn``, ``fail`` or ``open``, with the first element and the second."""
    key = (lambda x: (x.high, x.low)) if way > 0 else (lambda x: (-x.low, -x.high))
    one, two, members = key(some[0]), None, []
    for n, line in enumerate(some[1:], 1):
        top, low = key(line)
        if two is None:
            if one[0] >= top and one[1] <= low:
                if top != low or top != one[0]:
                    one = (max(one[0], top), max(one[1], low))
                continue
            two, members = (top, low), [line]
            if top < one[0]:
                return "fail", None, None, None
            continue
        inner = two[0] >= top and two[1] <= low
        outer = two[0] <= top and two[1] >= low and two[0] != top
        if inner or outer:
            if top != low or top != two[0]:
                two = (max(two[0], top), max(two[1], low))
            members.append(line)
            continue
        return ("third", one, two, members)
    return "open", one, two, members


def peak_of(two, members, way):
    return max(x.idx for x in members if (x.high if way > 0 else -x.low) == two[0]) - 1


def search(all_lines, start, way, stop=None):
    """Reads every second line from ``start``; gives (begin of what was read, last line read, gap, peak) for each turn."""
    first = start
    for at in range(start, len(all_lines), 2):
        while first <= at:
            some = all_lines[first : at + 1 : 2]
            told, one, two, members = attempt(some, way)
            if told == "open":
                break
            if told == "third":
                line, key = all_lines[at], (lambda x: (x.high, x.low)) if way > 0 else (lambda x: (-x.low, -x.high))
                top, low = key(line)
                ahead = all_lines[at + 2] if at + 2 < len(all_lines) else None
                breaks = low < key(members[-1])[1] or (ahead is not None and key(ahead)[1] < low)
                if breaks and one[0] < two[0] and top <= two[0] and low < two[1]:
                    yield first, at, one[0] < two[1], peak_of(two, members, way)
            first += 2
    return


def ends(all_lines, gap, peak):
    """True, False (never here) or None, as the turn back tells."""
    if not gap:
        return True
    if peak + 2 >= len(all_lines):
        return None
    for _, _, back_gap, back_peak in search(all_lines, peak + 2, -all_lines[peak + 2].dir):
        if (told := ends(all_lines, back_gap, back_peak)) is not False:
            return told
    return None


def model_turns(rows):
    """End lines of the segments that turns tell, behind the first one: each looked for anew from the end before."""
    all_lines = [Line(r[1], r[2], max(r[3:5]), min(r[3:5]), r[3], r[4]) for r in rows]

    def after(end):
        way = -all_lines[end].dir
        start = end + 1
        while True:
            counter = start if all_lines[start].dir == -way else start + 1
            turn = next(search(all_lines, counter, way), None) if start < len(all_lines) - 1 else None
            if turn is None:
                return None
            first, _, gap, peak = turn
            if ends(all_lines, gap, peak) is False:
                start = first + 2
                continue
            return peak, ends(all_lines, gap, peak)

    return after


def test_segments_behind_the_first(segments):
    got = of_symbol(segments, "idx")
    compared = 0
    for w in WALKS:
        found = got[w[0][0]]
        after = model_turns(w)
        for a, b in zip(found, found[1:]):
            if a.reason in ("normal", "split_first_2nd") and b.reason == "normal":
                end, told = after(a.end_line)
                assert end == b.end_line and (told or not b.is_sure), (w[0][0], a.end_line)
                compared += 1
    assert compared > 40


def model_pivots(rows, segs, merge):
    """Pivots of each segment's counter lines, those of a segment together: (begin, end, low, high)."""
    out = []
    spans = [(s.begin_line, s.end_line, s.dir) for s in segs]
    if segs:
        spans.append((segs[-1].end_line + 1, len(rows) - 1, -segs[-1].dir))
    made = []  # begin, end, low, high, peak low, peak high, segment

    def join():
        while len(made) > 1:
            a, b = made[-2:]
            meet = b[3] >= a[2] and a[3] >= b[2] if merge == "range" else b[5] > a[4] and a[5] > b[4]
            if not merge or a[6] != b[6] or b[0] == b[1] or not meet:
                return
            made[-2:] = [[a[0], b[1], min(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4]), max(a[5], b[5]), a[6]]]

    for k, (begin, end, way) in enumerate(spans):
        free = []
        for i in range(begin, end + 1):
            if rows[i][2] == way:
                continue
            high, low = max(rows[i][3:5]), min(rows[i][3:5])
            if made and not free and made[-1][6] == k and high > made[-1][2] and low < made[-1][3]:
                p = made[-1]
                p[1], p[4], p[5] = i, min(p[4], low), max(p[5], high)
                join()
                continue
            if made and not free and made[-1][6] == k:
                free = []
            free = [*free[-1:], (i, high, low)]
            if len(free) == 2:
                (a, h1, l1), (b, h2, l2) = free
                if min(h1, h2) > max(l1, l2) and a > 0:
                    made.append([a, b, max(l1, l2), min(h1, h2), min(l1, l2), max(h1, h2), k])
                    free = []
                    join()
    return [tuple(p[:4]) for p in made]


@pytest.mark.parametrize("merge", ["", "range", "peak"])
def test_pivots(lines, segments, merge):
    got = of_symbol(classic.segment_pivots(classic.in_segments(lines, segments), classic.PivotRules(merge=merge)), "seq")
    segs = of_symbol(segments, "idx")
    for w in WALKS:
        name = w[0][0]
        assert [(p.begin_line, p.end_line, p.low, p.high) for p in got.get(name, [])] == model_pivots(w, segs.get(name, []), merge), name


def model_later(rows, segs, pivots, targets, rules):
    """Points of class 2, 2s, 3a and 3b, line by line: (line, type)."""
    lines = [Line(r[1], r[2], max(r[3:5]), min(r[3:5]), r[3], r[4]) for r in rows]
    n, m = len(lines), len(segs)
    home = {i: k for k, s in enumerate(segs) for i in range(s.begin_line, s.end_line + 1)}
    seg_of = lambda i: home.get(i, m)
    span = lambda x: x.high - x.low
    several = {k: [p for p in pivots if p.segment == k and p.begin_line < p.end_line] for k in range(m)}
    back = lambda x, p: x.low < p.high if x.dir < 0 else x.high > p.low
    found = set()
    heads = [s.end_line for s in segs if not rules.follow or s.end_line in targets] if m > 1 else [-1] if m == 1 and not rules.follow else []
    for e in heads:
        if e + 2 >= n:
            continue
        turn, two = lines[e + 1], lines[e + 2]
        fine = span(two) / span(turn) <= rules.retrace
        if fine:
            found.add((two.idx, "2"))
        if not fine and rules.follow_2s:
            continue
        band = (two.low, two.high)
        for level, like in enumerate(lines[e + 4 :: 2], 1):
            away = seg_of(like.idx) - seg_of(two.idx)
            if rules.most_2s is not None and level > rules.most_2s or away and (seg_of(like.idx) < m - 1 or away > 1 or segs[seg_of(two.idx)].is_sure):
                break
            if not (like.high > band[0] and like.low < band[1]) or (like.low < turn.low if like.dir < 0 else like.high > turn.high):
                break
            if abs(like.end - turn.end) / span(turn) > rules.retrace:
                break
            if level == 1:
                band = (max(band[0], like.low), min(band[1], like.high))
            found.add((like.idx, "2s"))
    stored = set(targets) | {i for i, _ in found}
    heads = [(k, s.end_line, k + 1) for k, s in enumerate(segs)] if m > 1 else [(0, -1, 0)] if m == 1 else []
    for k, e, nxt in heads:
        if rules.follow_3 and (m == 1 or e not in stored):
            continue
        if nxt < m and several[nxt] and not (rules.strict_3 and several[nxt][0].in_line != e + 1):
            for p in several[nxt][: rules.pivots_3a]:
                if p.out_line is None or p.out_line + 1 >= n:
                    break
                three = lines[p.out_line + 1]
                own = seg_of(three.idx)
                if own == m and nxt != m - 1 or own < m and own != nxt and segs[own].end_line - segs[own].begin_line >= 2:
                    break
                if three.dir == segs[nxt].dir or own != nxt and nxt < m - 2:
                    break
                far = three.high >= p.peak_high if three.dir < 0 else three.low <= p.peak_low
                if not back(three, p) and (far or not rules.peak_3):
                    found.add((three.idx, "3a"))
        if m > 1 and several[k] and not (rules.strict_3 and several[k][-1].out_line != e):
            until = n
            if nxt < m and (several[nxt] or nxt < m - 1):
                until = next((p.out_line for p in several[nxt] if p.out_line is not None), segs[nxt].end_line - 1)
            for three in lines[e + 2 :: 2]:
                own = seg_of(three.idx)
                if three.idx > until or own != k + 1 and own < m - 1:
                    break
                if not back(three, several[k][-1]):
                    found.add((three.idx, "3b"))
                    break
    return found


RULES = [
    divergence.PointRules(), divergence.PointRules(follow=False, follow_3=False), divergence.PointRules(follow=False, follow_2s=True, most_2s=2, retrace=0.7, strict_3=True),
    divergence.PointRules(least_pivots=0, peak=False, peak_3=True, pivots_3a=3, follow_3=False, rate=0.9),
]


@pytest.mark.parametrize("rules", RULES)
def test_later_points(lines, segments, rules):
    placed = classic.in_segments(lines, segments).cache()
    pivots = classic.in_and_out(classic.segment_pivots(placed), lines, segments).cache()
    ones = divergence.first_points(placed, segments, pivots, rules)
    got = of_symbol(divergence.classic_points(placed, segments, pivots, rules), "line")
    targets = {k: {r.line for r in v if r.is_target} for k, v in of_symbol(ones, "line").items()}
    segs, pivs = of_symbol(segments, "idx"), of_symbol(pivots, "seq")
    types = set()
    for w in WALKS:
        name = w[0][0]
        want = model_later(w, segs.get(name, []), pivs.get(name, []), targets.get(name, set()), rules)
        assert {(r.line, r.type) for r in got.get(name, []) if r.type not in ("1", "1p")} == want, name
        types |= {t for _, t in want}
    assert {"2", "2s", "3a", "3b"} <= types or rules.strict_3


def test_wanted_types(lines, segments):
    placed = classic.in_segments(lines, segments)
    pivots = classic.in_and_out(classic.segment_pivots(placed), lines, segments)
    rules = divergence.PointRules(least_pivots=0, buys=("1", "2"), sells=("1p", "3a", "3b"))
    got = divergence.classic_points(placed, segments, pivots, rules).collect()
    assert {(r.type, r.is_buy) for r in got if r.is_target} <= {("1", True), ("2", True), ("1p", False), ("3a", False), ("3b", False)}
    assert any(r.type == "1" and not r.is_buy and not r.is_target for r in got)


def test_second_points_behind_a_flat_line(spark):
    prices = [10.0, 8.0, 12.0, 6.0, 6.0, 7.0, 6.5]
    rows = [("s", i, -1 if i % 2 == 0 else 1, a, b, i // 3) for i, (a, b) in enumerate(zip(prices, prices[1:]))]
    lines = spark.createDataFrame(rows, "symbol string, idx long, dir int, begin_price double, end_price double, seg_idx long")
    segments = spark.createDataFrame([("s", 0, -1, 0, 2, True), ("s", 1, 1, 3, 5, True)], "symbol string, idx long, dir int, begin_line long, end_line long, is_sure boolean")
    ones = spark.createDataFrame([("s", 2, True)], "symbol string, line long, is_target boolean")
    assert divergence.second_points(lines, segments, ones, divergence.PointRules()).collect() == []
    rising = lines.withColumn("end_price", F.when(F.col("idx") == 3, 9.0).otherwise(F.col("end_price")))
    assert [(r.line, r.type, r.ratio) for r in divergence.second_points(rising, segments, ones, divergence.PointRules()).collect()] == [(4, "2", pytest.approx(1 / 3))]
