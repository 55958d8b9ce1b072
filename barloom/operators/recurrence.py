"""Linear recurrences along ordered rows, worked on in blocks.

``y[t] = keep[t] * y[t-1] + add[t]``: the rows of a block compose to one such step, so blocks are folded
side by side, their steps are chained over the few blocks of a key, and each row adds the carried part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096


def _folded(keep: list[float], add: list[float]) -> tuple[list[float], list[float]]:
    """The recurrence from zero, and the products of ``keep``."""
    y, product, ys, products = 0.0, 1.0, [], []
    for k, a in zip(keep, add):
        y, product = k * y + a, k * product
        ys.append(y)
        products.append(product)
    return ys, products


def recurrences(rows: DataFrame, keep: dict[str, Column], add: dict[str, Column], by: str = "symbol", x: str = "x", block: int = BLOCK) -> DataFrame:
    """``rows`` with a column for each name of ``keep`` and ``add``; ``x`` numbers the rows of a key from 0.

    Recurrences start from zero: the first row's ``add`` is the seed.
    """
    names = list(keep)
    inputs = rows.withColumns({f"_k_{n}": keep[n].cast("double") for n in names} | {f"_a_{n}": add[n].cast("double") for n in names})
    inputs = inputs.withColumn("_block", F.floor(F.col(x) / block))
    parts = T.StructType(inputs.schema.fields + [T.StructField(c, T.DoubleType()) for n in names for c in (f"_y_{n}", f"_p_{n}")])

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by(x)
        for n in names:
            for c, values in zip((f"_y_{n}", f"_p_{n}"), _folded(table[f"_k_{n}"].to_pylist(), table[f"_a_{n}"].to_pylist())):
                table = table.append_column(c, pa.array(values, pa.float64()))
        return table

    folded = inputs.groupBy(by, "_block").applyInArrow(local, parts)
    # A block's step alone is an aggregate, so that the rows are folded once.
    fields = [f"{p}{n}" for n in names for p in ("_k_", "_a_")]
    steps = F.array_sort(F.collect_list(F.struct(x, *fields)))
    start = F.struct(*(v.alias(f"{p}{n}") for n in names for p, v in (("y", F.lit(0.0)), ("p", F.lit(1.0)))))
    step = lambda acc, r: F.struct(
        *(v.alias(c) for n in names for c, v in ((f"y{n}", r[f"_k_{n}"] * acc[f"y{n}"] + r[f"_a_{n}"]), (f"p{n}", r[f"_k_{n}"] * acc[f"p{n}"])))
    )
    ends = inputs.groupBy(by, "_block").agg(F.aggregate(steps, start, step).alias("_e"))
    ends = ends.select(by, "_block", *(F.col(f"_e.{p}{n}").alias(f"_{p}_{n}") for n in names for p in "yp"))
    carried = T.StructType([rows.schema[by], ends.schema["_block"]] + [T.StructField(f"_c_{n}", T.DoubleType()) for n in names])

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        out = table.select([by, "_block"])
        for n in names:
            before = [0.0]
            for y, p in zip(table[f"_y_{n}"].to_pylist(), table[f"_p_{n}"].to_pylist()):
                before.append(y + p * before[-1])
            out = out.append_column(f"_c_{n}", pa.array(before[:-1], pa.float64()))
        return out

    starts = ends.groupBy(by).applyInArrow(chained, carried)
    joined = folded.join(starts, [by, "_block"])
    return joined.select(*rows.columns, *((F.col(f"_y_{n}") + F.col(f"_p_{n}") * F.col(f"_c_{n}")).alias(n) for n in names))
