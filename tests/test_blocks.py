"""Work by blocks gives what work by whole symbols gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import joins, levels, resample
from walks import BARS, walk

START = datetime(2024, 1, 30)


def rows_of(df):
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_long_lines(spark, block):
    bars = spark.createDataFrame(walk(4, 400) + walk(5, 90), BARS)
    made = levels.lines(levels.confirms(levels.bar_units(bars)))
    # Lines over many lines: from each begin to the end four further on.
    later = made.select("symbol", (F.col("idx") - 4).alias("idx"), F.col("end_x").alias("far_x"))
    wide = made.join(later, ["symbol", "idx"]).withColumn("end_x", F.col("far_x")).drop("far_x")
    for lines in (made, wide):
        got = levels.line_bars(lines, bars, block)
        assert rows_of(got) == rows_of(levels.line_bars(lines, bars, 10**6)) and not got.isEmpty()


def test_numbers_and_parents_over_days(spark):
    rng = random.Random(2)
    ticks, bars = [], []
    for symbol in ("a", "b", "c"):
        times = sorted(rng.randrange(60 * 24 * 40) for _ in range(120))
        ticks += [(symbol, START + timedelta(minutes=t), n, float(n)) for n, t in enumerate(times)]
        ends = sorted(set(rng.randrange(60 * 24 * (5 if symbol == "c" else 40)) for _ in range(30)))
        bars += [(symbol, START + timedelta(minutes=t), n, 1.0) for n, t in enumerate(ends)]
    tick, bar = spark.createDataFrame(ticks, "symbol string, ts timestamp, x long, price double"), spark.createDataFrame(bars, "symbol string, ts timestamp, x long, close double")
    want = []
    for symbol, ts, x, _ in ticks:
        behind = [(t, n) for s, t, n, _ in bars if s == symbol and t >= ts]
        want.append((symbol, x, ts, min(behind)[1] if behind else None))
    assert rows_of(joins.parents_of(tick, bar)) == sorted(want, key=repr)
    numbers = resample.placed(tick.drop("x").withColumn("seq", F.col("price").cast("long")), ["ts", "seq"], F.to_date("ts"), "x").select("symbol", "x", "price").collect()
    assert all(r.x == int(r.price) for r in numbers) and len(numbers) == len(ticks)
    again = resample.numbered(bar.withColumnRenamed("x", "old").withColumnRenamed("ts", "slot")).collect()
    assert all(r.x == r.old for r in again)
