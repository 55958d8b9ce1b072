"""One wide row of features for each bar and level, from any number of streams in one sort.

Each stream's rows are tagged into one union, dealt by symbol once, folded to a row for each bar, and carried forward
from the last bar that had one. So a further stream costs its rows and no further join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import asof, levels
from barloom.operators.stages import written


@dataclass(frozen=True)
class Stream:
    """Rows (``symbol``, ``x`` and ``columns``; one a bar) of a level ``n``; ``carried`` columns hold until the next row, others are of their bar alone."""

    n: int
    rows: DataFrame
    columns: Sequence[str]
    carried: bool = False


def wide_rows(bars: DataFrame, streams: Sequence[Stream], own: Sequence[str] = ("close",)) -> DataFrame:
    """``symbol``, ``x``, ``n``, the ``own`` columns of the bars and those of the streams, a row for each bar and level.

    Streams of several levels may share columns. A stream's null says nothing: what was carried holds. Rows of bars
    that aren't there are carried, but give no row.
    """
    kinds = {c: dict(s.rows.dtypes)[c] for s in streams for c in s.columns}
    own_kinds = {c: t for c, t in bars.dtypes if c in own}
    carried = {c for s in streams if s.carried for c in s.columns}
    numbers = sorted({s.n for s in streams})

    def tagged(rows: DataFrame, n, have: Sequence[str], is_bar: bool) -> DataFrame:
        columns = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (own_kinds | kinds).items()]
        return rows.select("symbol", "x", n.cast("int").alias("n"), F.lit(is_bar).alias("is_bar"), *columns)

    base = bars.select("symbol", "x", *own, F.explode(F.array(*map(F.lit, numbers))).alias("n"))
    union = tagged(base, F.col("n"), own, True)
    for s in streams:
        union = union.unionAll(tagged(s.rows, F.lit(s.n), s.columns, False))
    one = union.repartition("symbol").groupBy("symbol", "n", "x").agg(F.max("is_bar").alias("is_bar"), *(F.first(c, ignorenulls=True).alias(c) for c in (own_kinds | kinds)))
    so_far = W.partitionBy("symbol", "n").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    held = one.select("symbol", "x", "n", "is_bar", *own, *(F.last(c, ignorenulls=True).over(so_far).alias(c) if c in carried else F.col(c) for c in kinds))
    return held.where("is_bar").drop("is_bar")


def level_streams(n: int, confirms: DataFrame, made: DataFrame, units: DataFrame, bars: DataFrame) -> list[Stream]:
    """The streams of level ``n``, as they are known at each bar: its running line with slope and ratio to the line before, its
    last confirmed fractal, the next level's judged fractal, its last pivot with confirm and judgment, MACD and RSI of its lines."""
    running = written(asof.running_lines(confirms, bars))
    tails = written(asof.pivot_tails(made, running))
    signals = asof.pivot_signals(tails).groupBy("symbol", "x").agg(
        F.max(F.when(F.col("kind") == "confirm", F.col("value"))).alias("pivot_confirm"), F.max_by(F.when(F.col("kind") == "judge", F.col("value")), F.when(F.col("kind") == "judge", F.col("x1"))).alias("pivot_judgment")
    )
    span = F.col("x") - F.col("begin_x")
    lines = running.select(
        "symbol", "x", F.col("idx").alias("line_idx"), F.col("dir").alias("line_dir"), F.col("begin_x").alias("line_begin_x"), F.col("high").alias("line_high"), F.col("low").alias("line_low"),
        F.when(span >= 1, F.col("dir") * (F.col("high") - F.col("low")) / span).alias("line_slope"),
    )
    amplitude = made.select("symbol", F.col("idx") + 1, F.abs(F.col("end_price") - F.col("begin_price"))).toDF("symbol", "line_idx", "before")
    ratio = lines.join(amplitude, ["symbol", "line_idx"]).select("symbol", "x", ((F.col("line_high") - F.col("line_low")) / F.when(F.col("before") != 0, F.col("before"))).alias("adjacent_ratio"))
    fractals = confirms.select("symbol", F.col("confirm_x").alias("x"), F.when(F.col("fx") == "top", -1).otherwise(1).alias("fractal"), F.col("pole_x").alias("fractal_pole_x"))
    judged = asof.judged_fractals(units, running).select("symbol", "x", F.when(F.col("fx") == "top", -1).otherwise(1).alias("judgment"), F.col("truncated").alias("judgment_cut"))
    last = tails.where("back = 0").select("symbol", "x", F.col("seq").alias("pivot_seq"), F.col("zg").alias("pivot_high"), F.col("zd").alias("pivot_low"))
    return [
        Stream(n, lines, ["line_idx", "line_dir", "line_begin_x", "line_high", "line_low", "line_slope"]), Stream(n, ratio, ["adjacent_ratio"]),
        Stream(n, fractals, ["fractal", "fractal_pole_x"], carried=True), Stream(n, judged, ["judgment", "judgment_cut"]), Stream(n, last, ["pivot_seq", "pivot_high", "pivot_low"]),
        Stream(n, signals, ["pivot_confirm", "pivot_judgment"]), Stream(n, asof.line_macd(made, running), ["dif", "dea", "hist"]), Stream(n, asof.line_rsi(made, running), ["rsi"]),
    ]


def feature_rows(bars: DataFrame, most: int = 2) -> DataFrame:
    """The wide rows of the first ``most`` levels (those that there are): ``n`` is the level, from 0."""
    streams = []
    for n, (confirms, made) in enumerate(levels.levels(bars, most)):
        streams += level_streams(n, confirms, made, levels.line_units(made), bars)
    if not streams:
        return bars.select("symbol", "x", F.lit(0).alias("n"), "close").limit(0)
    return wide_rows(bars, streams)
