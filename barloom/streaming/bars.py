"""Streams of ticks and bars: windowed bars under a watermark, and folds as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.structure import GROUP, Groups


def streamed_bars(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """Bars of a stream of ticks, each once it is final; ticks later than ``late`` are left out."""
    order = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_ticks"),
        )
        .select("symbol", F.col("w.start").alias("slot"), "open", "high", "low", "close", "volume", "n_ticks")
    )


def streamed_groups(bars: DataFrame) -> DataFrame:
    """Closed merged groups of a stream of bars (``symbol``, ``x``, ``high``, ``low``); a bar that comes after a later one is an error."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, groups = None, Groups()
        if state.exists:
            last, *opened = state.get
            groups.seq, groups.open = opened[0], list(opened)
        out = []
        for row in pd.concat(batches).sort_values("x").itertuples():
            if last is not None and row.x <= last:
                raise ValueError(f"bar {row.x} of {key[0]} comes after bar {last}")
            last = row.x
            out += groups.add(row.x, row.high, row.low)
        state.update((last, *groups.open))
        names = [c.split()[0] for c in GROUP.split(", ")]
        yield pd.DataFrame(out, columns=names).assign(symbol=key[0])[["symbol", *names]]

    return bars.select("symbol", "x", "high", "low").groupBy("symbol").applyInPandasWithState(
        step, f"symbol string, {GROUP}", f"last_x long, {GROUP.removesuffix(', closed boolean')}", "append", GroupStateTimeout.NoTimeout
    )
