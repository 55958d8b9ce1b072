"""The log of changes of a level as a stream of bars comes in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.changes import BAR, CHANGE, OpenLevel

LATE = "late"
_BARS = "x long, high double, low double, close double, volume double"
_WAITING = "x long, open double, high double, low double, close double, volume double"
_NAMES = [c.split()[0] for c in CHANGE.split(", ")]


class _Changes(StatefulProcessor):
    """A symbol's open tail. Bars are numbered, so one that comes early waits for those before it; one that is there already is late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "last_x long, saved string")
        self.bars = handle.getListState("bars", _BARS)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, level = -1, OpenLevel()
        if self.tail.exists():
            last, saved = self.tail.get()
            level.restore(json.loads(saved), [tuple(b) for b in self.bars.get()])
        waiting = {b[0]: tuple(b) for b in self.waiting.get()}
        for batch in rows:
            out: list[tuple] = []
            for bar in batch[BAR].itertuples(index=False, name=None):
                bar = (int(bar[0]), *map(float, bar[1:]))
                if bar[0] <= last or bar[0] in waiting:
                    out.append((bar[0], LATE, bar[0], LATE, None, None, None, *bar[1:], None, None, None))
                    continue
                waiting[bar[0]] = bar
                while last + 1 in waiting:
                    last += 1
                    out += level.add(*waiting.pop(last))
            if out:
                yield self._frame(key[0], out)
        self.tail.update((last, json.dumps(level.saved())))
        for state, rows_ in ((self.bars, level.bars), (self.waiting, [waiting[x] for x in sorted(waiting)])):
            if rows_:
                state.put([tuple(r) for r in rows_])
            elif state.exists():
                state.clear()

    @staticmethod
    def _frame(symbol: str, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_NAMES).astype({"key": "Int64", "dir": "Int32", "x1": "Int64", "x2": "Int64", "n": "Int64"})
        frame.insert(0, "symbol", symbol)
        return frame

    def close(self) -> None:
        pass


def streamed_changes(bars: DataFrame) -> DataFrame:
    """The change log of a stream of bars (``symbol``, ``x`` from 0, prices and ``volume``), appended as bars come in.

    Replaying the log gives what the whole table gives, at every bar and after any restart. A bar whose number has been
    taken is told as ``late`` (``what`` and ``op``), with its prices, and changes nothing: keep those rows as a table of
    rejects. The state needs the session's RocksDB store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return bars.select("symbol", *BAR).groupBy("symbol").transformWithStateInPandas(_Changes(), f"symbol string, {CHANGE}", "append", "none")
