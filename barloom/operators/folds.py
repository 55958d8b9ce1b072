"""Folds along ordered rows, for what depends on all rows before.

Rows are dealt by key, sorted in their partition and streamed through a small state, so memory doesn't grow with
the rows of a key. The same states serve batches and streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T


class State(Protocol):
    def add(self, *row) -> list[tuple]:
        """Take a row; return the rows that are now final."""

    def end(self) -> list[tuple]:
        """The rows that are still open."""


def ordered_fold(rows: DataFrame, new: Callable[[], State], inputs: list[str], output: str, by: str = "symbol", order: str = "x") -> DataFrame:
    """The rows that a state for each key gives, with their key; ``output`` is their schema without it."""
    schema = T.StructType([rows.schema[by], *T.StructType.fromDDL(output).fields])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            columns = batch.to_pydict()
            for k, row in zip(columns[by], zip(*(columns[c] for c in inputs))):
                if state is None or k != key:
                    if state is not None:
                        out += [(key, *r) for r in state.end()]
                    key, state = k, new()
                out += [(k, *r) for r in state.add(*row)]
            yield _batch(out, arrow)
        if state is not None:
            yield _batch([(key, *r) for r in state.end()], arrow)

    return rows.select(by, order, *(c for c in inputs if c != order)).repartition(by).sortWithinPartitions(by, order).mapInArrow(fold, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def ordered_stream(rows: DataFrame, of: Callable[[Iterator[tuple]], Iterator[tuple]], inputs: list[str], output: str, by: str = "symbol", order: str = "x", batch: int = 4096) -> DataFrame:
    """As :func:`ordered_fold` for what reads the rows of a key as it needs them: ``of`` takes them in order and gives rows."""
    schema = T.StructType([rows.schema[by], *T.StructType.fromDDL(output).fields])
    arrow = to_arrow_schema(schema)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for one in batches:
            columns = one.to_pydict()
            yield from zip(columns[by], zip(*(columns[c] for c in inputs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, some in groupby(flat(batches), key=lambda r: r[0]):
            for row in of(r for _, r in some):
                out.append((key, *row))
                if len(out) >= batch:
                    yield _batch(out, arrow)
                    out = []
        yield _batch(out, arrow)

    return rows.select(by, order, *(c for c in inputs if c != order)).repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)
