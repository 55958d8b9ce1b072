"""Known values of single operators, streams against batches, and files."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, joins, levels, profile, recurrence, resample, structure
from barloom.sources import bars as bar_files
from barloom.sources.ticks import read_tick_files, symbol_code
from barloom.streaming.bars import streamed_bars, streamed_groups

START = datetime(2024, 1, 2, 9, 30)


def bars_of(spark, ranges, symbol="s"):
    """Numbered minute bars of (high, low) or (open, high, low, close)."""
    rows = [(symbol, x, START + timedelta(minutes=x), *(map(float, (r[1], r[0], r[1], r[0]) if len(r) == 2 else r)), 1.0) for x, r in enumerate(ranges)]
    return spark.createDataFrame(rows, "symbol string, x long, ts timestamp, open double, high double, low double, close double, volume double")


def closes(spark, values):
    return bars_of(spark, [(v, v + 1, v - 1, v) for v in values])


def column(df, name, order="x"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_trailing_windows(spark):
    assert column(indicators.trend(closes(spark, [1, 2, 3, 6]), 3), "mean") == pytest.approx([1, 1.5, 2, 11 / 3])
    found = indicators.trend(closes(spark, [3, 5, 4]), 2)
    assert column(found, "channel_max") == [3, 5, 5] and column(found, "channel_min") == [3, 3, 4]
    assert column(indicators.bollinger(closes(spark, [1, 2, 3, 4, 5]), 3), "boll_mid")[2] == 2


def test_first_values(spark):
    one = closes(spark, [7])
    assert indicators.macd(one).first()[2:] == (0, 0, 0)
    assert indicators.rsi(one).first().rsi == 50


def test_recurrences_in_blocks(spark):
    rng = random.Random(1)
    rows = [(s, x, rng.uniform(0.1, 0.99), rng.uniform(-1, 1)) for s in "ab" for x in range(60)]
    df = spark.createDataFrame(rows, "symbol string, x long, k double, a double")
    got = {(r.symbol, r.x): r.y for r in recurrence.recurrences(df, {"y": F.col("k")}, {"y": F.col("a")}, block=7).collect()}
    y = {}
    for s, x, k, a in rows:
        y[s] = k * y.get(s, 0.0) + a
        assert math.isclose(got[s, x], y[s], abs_tol=1e-12)


def test_merged_groups(spark):
    found = structure.merged_groups(bars_of(spark, [(10, 9), (9.5, 9.2)]))
    assert column(found, "n_units", "seq") == [1, 1]
    up = structure.merged_groups(bars_of(spark, [(11.93, 11.92), (11.96, 11.95), (11.96, 11.96)])).orderBy("seq").collect()[1]
    assert (up.x1, up.x2, up.high, up.low) == (1, 2, 11.96, 11.96)
    down = structure.merged_groups(bars_of(spark, [(12.0, 11.9), (11.8, 11.7), (11.7, 11.7)])).orderBy("seq").collect()[1]
    assert (down.x1, down.x2, down.high, down.low) == (1, 2, 11.7, 11.7)
    fx = structure.fractals(structure.merged_groups(bars_of(spark, [(10, 9), (9, 8), (10.5, 9.5)]))).collect()
    assert [(r.fx, r.x1, r.confirm_x) for r in fx] == [("bottom", 1, 2)]


def test_pivots(spark):
    one = structure.pivots(bars_of(spark, [(20, 10)])).collect()
    assert [(r.x1, r.x2, r.is_sure) for r in one] == [(0, 0, False)]
    flat = structure.pivots(bars_of(spark, [(11.71, 11.72, 11.70, 11.71)])).first()
    assert (flat.zg, flat.zd) == (11.71, 11.71)
    rising = bars_of(spark, [(20, 10), (22, 12), (21, 11), (40, 30), (42, 32), (41, 31)])
    found = structure.pivots(rising)
    assert found.count() >= 2
    assert structure.first_class_points(found, rising).where("side = 'buy'").count() == 0


def test_legs_alternate(spark):
    rng = random.Random(4)
    price, ranges = 50.0, []
    for _ in range(300):
        price += rng.choice((-1.3, -0.4, 0.5, 1.2))
        ranges.append((price + rng.random(), price - rng.random()))
    found = levels.lines(levels.confirms(levels.bar_units(bars_of(spark, ranges)))).orderBy("idx").collect()
    assert len(found) > 5
    for a, b in zip(found, found[1:]):
        assert a.end_x == b.begin_x and a.dir == -b.dir
    assert all((r.end_price - r.begin_price) * r.dir > 0 for r in found)


def test_bins_and_peaks(spark):
    ticks = spark.createDataFrame([(0, 10.0, 100.0, "S"), (0, 10.0, 50.0, "B"), (0, 10.1, 200.0, "B"), (0, 10.0, 30.0, "")], "x int, price double, qty double, side string")
    assert [tuple(r) for r in profile.bins(ticks, "x").orderBy("price_key").select("price", "s", "b", "w").collect()] == [(10.0, 100.0, 50.0, 30.0), (10.1, 0.0, 200.0, 0.0)]
    prices, totals = [9.5, 10.0, 10.3, 10.5, 10.7, 11.0, 11.5, 12.0, 12.5, 13.0, 13.5], [1, 5, 1, 6, 1, 7, 1, 8, 1, 9, 1]
    rows = [("s", k, p, float(t), 10.4, 11.2) for k, (p, t) in enumerate(zip(prices, totals))]
    found = profile.labelled(profile.peaks(spark.createDataFrame(rows, "symbol string, bucket long, price double, total double, lo double, hi double"), "symbol"), "lo", "hi", "symbol")
    assert {r.price: r.label for r in found.collect()} == {10.0: -1, 12.0: 1, 13.0: 2}


def test_spread_over_a_minute(spark):
    ticks = spark.createDataFrame([("s", START, k, 1.0) for k in range(3)], "symbol string, ts timestamp, seq long, price double")
    assert [r.ts.second for r in resample.spread(ticks).orderBy("seq").collect()] == [0, 20, 40]


def test_stepped_is_null_before_the_first(spark):
    points = spark.createDataFrame([("s", 1, 5.0), ("s", 3, 7.0)], "symbol string, x long, v double")
    assert column(joins.stepped(closes(spark, [1] * 5), points, "v"), "v") == [None, 5, 5, 7, 7]


def test_tick_files(spark, tmp_path):
    lines = ["header", "09:30\t25.24\t10\t2\tS", "09:25\t35.07\t144\t25", "09:30\t35.10\t60\tB", "09:30\t11.72\t33\t0\tS", "09:31\tx\t1\t1\tB"]
    (tmp_path / "20260710_test123.txt").write_text("\n".join(lines))
    got = [(r.symbol, r.price, r.side, r.trades) for r in read_tick_files(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("000123", 25.24, "S", 2), ("000123", 35.07, "", 25), ("000123", 35.10, "B", 1), ("000123", 11.72, "S", 0)]
    assert spark.range(1).select(symbol_code(F.lit("sh.600519001"))).first()[0] == "519001"


def test_bar_files(spark, tmp_path):
    bar_files.write_bars(closes(spark, [5, 6]), str(tmp_path / "a"))
    assert [r.close for r in bar_files.read_bars(spark, str(tmp_path / "a"), "s").orderBy("ts").collect()] == [5, 6]
    (tmp_path / "b.csv").write_text("time,open,high,low,close\n2024-01-02 09:30:00,5,4,3,4\n")
    with pytest.raises(Exception, match="unsound"):
        bar_files.read_bars(spark, str(tmp_path / "b.csv"), "s").collect()


def test_streams_agree_with_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [("ab"[k % 2], START + timedelta(seconds=7 * k), k, rng.uniform(1, 9), 1.0) for k in range(400)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, qty double")
    parts = ticks.withColumn("part", F.floor(F.col("seq") / 100))
    for k in range(4):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streamed_bars(source, "1 minute", "0 seconds").writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {(r.symbol, r.slot): (r.open, r.high, r.low, r.close) for r in resample.ticks_to_bars(ticks, "1m").collect()}
    got = {(r.symbol, r.slot): (r.open, r.high, r.low, r.close) for r in spark.table("bars").collect()}
    assert len(got) > 50 and got.items() <= batch.items()

    bars = resample.ticks_to_bars(ticks, "1m").select("symbol", "x", "high", "low").orderBy("x").coalesce(1)
    for k in range(3):
        bars.where(F.floor(F.col("x") / 20) == k).write.mode("append").parquet(str(tmp_path / "bars"))
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    query = streamed_groups(source).writeStream.format("memory").queryName("groups").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    closed = structure.merged_groups(bars).where("closed")
    assert sorted(map(tuple, spark.table("groups").collect())) == sorted(map(tuple, closed.collect()))
