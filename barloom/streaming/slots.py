"""Bars in calendar slots from a stream of ticks, with trailing means and a row for each tick that comes too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.resample import slot

BAR, LATE = "bar", "late"
OUT = (
    "symbol string, kind string, x long, slot timestamp, ts timestamp, open double, high double, low double, close double, volume double, amount double, "
    "n_ticks long, mean double, channel_max double, channel_min double"
)
_PARTIAL = "first_ts long, first_seq long, open double, last_ts long, last_seq long, close double, high double, low double, volume double, amount double, n long"
_NAMES = [c.split()[0] for c in OUT.split(", ")]


class Partial:
    """A bar that grows tick by tick, or bar by bar."""

    def __init__(self, *values):
        self.values = list(values)

    @classmethod
    def of(cls, ts: int, seq: int, price: float, qty: float) -> Partial:
        return cls(ts, seq, price, ts, seq, price, price, price, qty, price * qty, 1)

    def merge(self, other: Partial) -> Partial:
        a, b = self.values, other.values
        first, last = (a if a[:2] <= b[:2] else b), (a if a[3:5] >= b[3:5] else b)
        self.values = [*first[:3], *last[3:6], max(a[6], b[6]), min(a[7], b[7]), a[8] + b[8], a[9] + b[9], a[10] + b[10]]
        return self


class _Slots(StatefulProcessor):
    """A symbol's open slots, its clock, the closes that trailing means need, and the bars of an unfinished chunk."""

    def __init__(self, every: int, trail: int):
        self.every, self.trail = every, trail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "slot long, x long, in_chunk long, chunk_slot long")
        self.open = handle.getMapState("open", "slot long", _PARTIAL)
        self.chunk = handle.getValueState("chunk", _PARTIAL)
        self.closes = handle.getListState("closes", "close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, x, in_chunk, chunk_slot = self.clock.get() if self.clock.exists() else (-(1 << 62), 0, 0, 0)
        slots = {k[0]: Partial(*v) for k, v in self.open.iterator()}
        chunk = Partial(*self.chunk.get()) if self.chunk.exists() else None
        closes = [c[0] for c in self.closes.get()]
        clock, out = closed, []
        for batch in rows:
            for ts, seq, price, qty, at, now in batch[["ts", "seq", "price", "qty", "slot", "clock"]].itertuples(index=False, name=None):
                if at < closed:
                    out.append((key[0], LATE, None, at, ts, price, price, price, price, qty, price * qty, 1, None, None, None))
                    continue
                tick = Partial.of(ts, seq, price, qty)
                slots[at] = slots[at].merge(tick) if at in slots else tick
                clock = max(clock, now)
        for at in sorted(s for s in slots if s < clock):
            bar = slots.pop(at)
            if self.open.containsKey((at,)):
                self.open.removeKey((at,))
            chunk_slot = at if chunk is None else chunk_slot
            chunk, in_chunk = (bar, 1) if chunk is None else (chunk.merge(bar), in_chunk + 1)
            if in_chunk == self.every:
                v = chunk.values
                closes = [*closes, v[5]][-self.trail :]
                out.append((key[0], BAR, x, chunk_slot, v[3], v[2], v[6], v[7], v[5], v[8], v[9], v[10], sum(closes) / len(closes), max(closes), min(closes)))
                x, chunk, in_chunk = x + 1, None, 0
        for at, bar in slots.items():
            self.open.updateValue((at,), tuple(bar.values))
        if chunk is not None:
            self.chunk.update(tuple(chunk.values))
        elif self.chunk.exists():
            self.chunk.clear()
        if closes:
            self.closes.put([(c,) for c in closes])
        self.clock.update((clock, x, in_chunk, chunk_slot))
        if out:
            frame = pd.DataFrame(out, columns=_NAMES).astype({"x": "Int64"})
            for c in ("slot", "ts"):
                frame[c] = pd.to_datetime(frame[c], unit="us")
            yield frame

    def close(self) -> None:
        pass


def streamed_slots(ticks: DataFrame, period: str, late: str = "0 seconds", every: int = 1, trail: int = 5) -> DataFrame:
    """Bars of a stream of ticks (``symbol``, ``ts``, ``seq``, ``price``, ``qty``) in calendar slots, appended once they are final.

    ``period`` is one of :func:`barloom.operators.resample.slot`: minutes, days, weeks, months or years; ``every`` of its bars that
    follow one another, as trading days do, make one. A symbol has its own clock, its latest tick less ``late``: a slot is
    final when the clock is past it, and a tick of such a slot is told as ``late`` (``kind``) and changes nothing, so nothing
    is left out without a word. ``mean``, ``channel_max`` and ``channel_min`` are of the last ``trail`` closes. Times are UTC.
    The state is the open slots and ``trail`` closes; it needs the session's RocksDB store.
    """
    rows = ticks.select(
        "symbol", F.unix_micros("ts").alias("ts"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"),
        F.unix_micros(slot(F.col("ts"), period)).alias("slot"), F.unix_micros(slot(F.col("ts") - F.expr(f"INTERVAL {late}"), period)).alias("clock"),
    )
    return rows.groupBy("symbol").transformWithStateInPandas(_Slots(every, trail), OUT, "append", "none")
