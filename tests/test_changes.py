"""The log of changes: replayed it gives what is known at each bar, as a table and as a stream that is started again."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import asof, changes, levels
from barloom.streaming.changes import streamed_changes
from walks import BARS, walk

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows_of(df):
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(0) + walk(10, 300), BARS).cache()


@pytest.fixture(scope="module")
def log(bars):
    return changes.change_log(bars).cache()


def test_replay_is_the_batch_result_at_each_bar(bars, log):
    confirms, made = levels.levels(bars, 1)[0]
    running = asof.running_lines(confirms, bars)
    want_lines = {(r.symbol, r.x): r for r in running.collect()}
    tails = {}
    for r in asof.pivot_tails(made, running).collect():
        tails.setdefault((r.symbol, r.x), {})[r.seq] = (r.x1, r.x2, r.zg, r.zd, r.gg, r.dd, r.n_members, r.dir, r.is_sure)
    known = {}
    state = {}
    for r in log.orderBy("symbol", "x", F.col("op") != "freeze").collect():
        state.setdefault((r.symbol, r.x), []).append(r)
    for symbol in ("w0", "w10"):
        lines, pivots, frozen = {}, {}, {}
        for x in range(bars.where(F.col("symbol") == symbol).count()):
            for r in state.get((symbol, x), []):
                at = lines if r.what == "line" else pivots
                if r.op == "drop":
                    del at[r.key]
                else:
                    assert r.key not in frozen.get(r.what, {}), (symbol, x, r)
                    at[r.key] = r
                if r.op == "freeze":
                    frozen.setdefault(r.what, {})[r.key] = r
            now = want_lines.get((symbol, x))
            if now is None:
                continue
            line = lines[max(lines)]
            assert (line.key, line.dir, line.x1, line.x2) == (now.idx, now.dir, now.begin_x, x)
            assert (line.open, line.high, line.low, line.close, line.volume) == pytest.approx((now.open, now.high, now.low, now.close, now.volume))
            for seq, want in tails[symbol, x].items():
                p = pivots[seq]
                assert (p.x1, p.x2, p.high, p.low, p.top, p.bottom, p.n, p.dir, p.op == "freeze") == want, (symbol, x, seq)
            assert max(pivots) == max(tails[symbol, x])
            known[symbol, x] = len(lines)
        want = {r.idx: (r.dir, r.begin_x, r.end_x, r.open, r.high, r.low, r.close, r.volume) for r in made.where(F.col("symbol") == symbol).collect()}
        assert {k: (r.dir, r.x1, r.x2, r.open, r.high, r.low, r.close, r.volume) for k, r in frozen["line"].items()} == want
    assert len(known) > 400


def test_the_log_is_linear(bars, log):
    assert log.count() < 4 * bars.count()


def test_snapshots(bars, log):
    for x in (60, 200):
        one = changes.snapshot(log, x)
        assert one.groupBy("symbol", "what", "key").count().where("count > 1").isEmpty()
        newest = one.groupBy("symbol", "what").agg(F.max("key").alias("key"))
        steps = changes.snapshots(log, bars, skip=50).where(F.col("at_x") == x)
        assert {tuple(r) for r in steps.groupBy("symbol", "what").agg(F.max("key")).collect()} == {tuple(r) for r in newest.collect()}
        assert rows_of(steps.join(newest, ["symbol", "what", "key"]).select("symbol", "what", "key", "x1", "x2", "high", "low")) == rows_of(
            one.join(newest, ["symbol", "what", "key"]).select("symbol", "what", "key", "x1", "x2", "high", "low")
        )
    every = changes.snapshots(log, bars, skip=50)
    assert every.agg(F.min("at_x")).first()[0] == 50 and every.groupBy("symbol", "at_x", "what").count().agg(F.max("count")).first()[0] == 2


def test_state_is_saved_and_restored():
    rows = [r[1:7] for r in walk(3, 220)]
    whole, parts = changes.OpenLevel(), changes.OpenLevel()
    import json

    for n, row in enumerate(rows):
        want = whole.add(*row)
        assert parts.add(*row) == want
        if n % 7 == 0:
            parts = changes.OpenLevel().restore(json.loads(json.dumps(parts.saved())), parts.bars)


def test_stream_with_restarts(spark, tmp_path, log, bars):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rng = random.Random(1)
    rows = bars.orderBy("symbol", "x").collect()
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [[r for r in rows if r.x < 70], [r for r in rows if 70 <= r.x < 73], [r for r in rows if r.x >= 73]]
    parts[1], parts[2] = parts[1] + rng.sample(parts[2], 5), [*parts[2], *rng.sample(parts[0], 3)]
    early = [(r.symbol, r.x) for r in parts[1] if r.x >= 73]
    parts[2] = [r for r in parts[2] if (r.symbol, r.x) not in early]
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, BARS).repartition(3).write.mode("append").parquet(source)
        stream = streamed_changes(spark.readStream.schema(BARS).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination(120)
    got = spark.read.parquet(out)
    assert rows_of(got.where("what <> 'late'")) == rows_of(log)
    assert got.where("what = 'late'").count() == 3
