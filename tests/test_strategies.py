"""Counts, trend lines, backtests and loading of files."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, demark, lines
from barloom.sources import loading, ticks


def bars_of(spark, closes):
    rows = [("s", x, float(c), float(c) + 1, float(c) - 1) for x, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, x long, close double, high double, low double")


def marks(df):
    return [(r.x, r.kind, r.dir, r.n) for r in df.orderBy("x", "kind", "n").collect()]


def test_a_rising_run(spark):
    got = marks(demark.demarks(bars_of(spark, range(30))))
    # The bar behind the last of the countdown ends the series; the next begins another.
    assert [m for m in got if m[1] == "setup"] == [(4 + n, "setup", 1, n) for n in range(1, 23)] + [(26 + n, "setup", 1, n) for n in range(1, 4)]
    assert [m for m in got if m[1] == "countdown"] == [(12 + n, "countdown", 1, n) for n in range(1, 14)]
    assert [m for m in got if m[1] == "complete"] == [(13, "complete", 1, 9), (25, "complete", 1, 13)]


def test_a_turn_ends_counts(spark):
    closes = [*range(16), *range(14, 0, -1)]
    got = marks(demark.demarks(bars_of(spark, closes)))
    assert max(x for x, k, way, _ in got if way > 0) <= 18 and (13, "complete", 1, 9) in got
    assert any(k == "setup" and way < 0 and n == 9 for _, k, way, n in got)
    kept = marks(demark.demarks(bars_of(spark, closes), demark.Demark(breaks=False)))
    assert set(m for m in got if m[2] > 0) <= set(kept)


def model_line(points, way, inner):
    """The line by the rule: from each point of the walk to the one of most slope that goes with the last line. Where none does
    an inner line is flat."""
    best, at = None, 0
    while True:
        x, y = points[at]
        pick, to = (0.0 if inner else way * float("inf")), at + 1
        for i in range(at + 1, len(points)):
            slope = (points[i][1] - y) / (points[i][0] - x)
            if way * slope < 0:
                continue
            if (way * slope > way * pick) if inner else (way * slope < way * pick):
                pick, to = slope, i
        if abs(pick) != float("inf"):
            away = sum(abs(pick * (a - x) - b + y) / (pick * pick + 1) ** 0.5 for a, b in points)
            if best is None or away < best[0]:
                best = away, x, y, pick
        at = to
        if at >= len(points) - 1:
            return best[1:] if best else None


@pytest.mark.parametrize("inner", [True, False])
def test_trend_lines(spark, inner):
    rows, want = [], {}
    hand = [[10, 20, 30, 40, 8, 9], [30, 60, 30, 60, 30, 60]]  # begins 10, 30, 8: the flat line through 8 is nearest
    for seg in range(40):
        rng = random.Random(seg + 5)
        price, prices = 50.0, [50.0]
        n = rng.choice((3, 5, 7, 9))
        drift = rng.choice((-1.5, 0.0, 1.5))
        for i in range(n):
            price += (1 if i % 2 == 0 else -1) * rng.choice((rng.uniform(1, 9), 4.0)) + drift
            prices.append(price)
        if seg < len(hand):
            prices, n = [float(p) for p in hand[seg]], len(hand[seg]) - 1
        made = [("s", i, 1 if prices[i + 1] > prices[i] else -1, prices[i], prices[i + 1], 10 * i, 10 * i + 10, seg) for i in range(n)]
        rows += [(f"s{seg}", *r[1:]) for r in made]
        line = model_line([((r[5], r[3]) if inner else (r[6], r[4])) for r in made[::-2]], made[-1][2], inner)
        if line:
            want[f"s{seg}"] = line
    df = spark.createDataFrame(rows, "symbol string, idx long, dir int, begin_price double, end_price double, begin_x long, end_x long, seg_idx long")
    got = {r.symbol: (r.x0, r.y0, r.slope) for r in lines.trend_lines(df, inner).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k]), k
    if inner:
        assert want["s0"] == (40, 8, 0.0) and sum(line[2] == 0.0 for line in want.values()) > 3


def test_trades(spark):
    bars = bars_of(spark, [5, 3, 4, 9, 2, 8, 1])
    rule = {"field": "close", "op": "<", "value": 3.5}, {"all": [{"field": "close", "op": ">", "value": {"field": "low"}}, {"field": "close", "op": ">=", "value": 8.0}]}
    made = backtest.trades(bars, *map(backtest.condition, rule))
    assert [tuple(r)[1:] for r in made.orderBy("n").collect()] == [(0, 1, 3, 3.0, 9.0), (1, 4, 5, 2.0, 8.0), (2, 6, None, 1.0, None)]
    r = backtest.summary(made).first()
    assert (r.n_trades, r.n_won, r.win_rate, r.profit) == (2, 2, 1.0, 12.0)


def test_loading(spark, tmp_path):
    head = "\u4ee3\u7801 \u6d4b\u8bd5\n"
    body = "09:30 3 100 2 B\n09:30 4 100 1 S\n09:31 2 100 0 B\nnot a tick\n"
    (tmp_path / "20240105_000001.txt").write_bytes((head + body).encode("gbk"))
    (tmp_path / "20240108_000001.txt").write_bytes(("\ufeff" + body).encode())
    (tmp_path / "20240301_000001.txt").write_text(body)
    (tmp_path / "notes.txt").write_text(body)
    got = loading.load_bars(spark, str(tmp_path), "1m", "2024-01-05", "20240131").orderBy("x").collect()
    assert [(r.x, r.open, r.high, r.low, r.close, r.volume, r.trades, r.bought, r.sold) for r in got] == [
        (0, 3, 4, 3, 4, 200, 3, 2, 1), (1, 2, 2, 2, 2, 100, 0, 0, 0), (2, 3, 4, 3, 4, 200, 3, 2, 1), (3, 2, 2, 2, 2, 100, 0, 0, 0),
    ]
    assert [(b.price, b.s, b.b) for b in got[0].bins] == [(3.0, 0.0, 100.0), (4.0, 100.0, 0.0)]
    found = ticks.catalog(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("000001", 3, "20240105", "20240301")]
    frame = loading.load_bars(spark, str(tmp_path), "5m")
    assert loading.view(frame, "volume_chip").columns == ["symbol", "x", "ts", "volume", "bins"]
    (tmp_path / "b.csv").write_text("time,open,high,low,close,volume\n2024/01/05 09:30:00,1,2,1,2,5\n2024/01/05 09:31:00,2,3,1,3,5\n2024/01/06 09:30:00,3,3,3,3,1\n")
    csv = loading.load_csv(spark, str(tmp_path / "b.csv"), "s", "day", end="2024-01-05").collect()
    assert [(r.x, r.open, r.high, r.low, r.close, r.volume) for r in csv] == [(0, 1, 3, 1, 3, 10)]
    assert loading.load_csv(spark, str(tmp_path / "b.csv"), "s").where(F.col("x") == 2).count() == 1
