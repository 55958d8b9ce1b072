"""Logs, sets and selections of structure rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(points: DataFrame, n: int, order: str = "x") -> DataFrame:
    """Each symbol's ``n`` latest points numbered from 1, the newest first; all if ``n`` is 0."""
    rows = points.withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc(order))))
    return rows.where(F.col("n") <= n) if n else rows


def recent(points: DataFrame, bars: DataFrame, days: int = 3, stale: int = 15) -> DataFrame:
    """Points (with ``ts``) of the last ``days`` days of symbols whose last bar is at most ``stale`` days older than the last of all."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    newest = bars.agg(F.max("ts").alias("newest_ts"))
    live = last.join(F.broadcast(newest)).where(F.datediff("newest_ts", "last_ts") <= stale)  # one row
    return points.join(live.select("symbol", "last_ts"), "symbol").where(F.datediff("last_ts", "ts") <= days).drop("last_ts")


def kept_first(rows: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """For each ``key`` the first value that isn't null, in order; it never changes later."""
    w = W.partitionBy(*key).orderBy(order)
    return rows.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def appended(log: DataFrame, events: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """``log`` and those of ``events`` whose key it doesn't have, each key once, the first in order."""
    w = W.partitionBy(*key).orderBy(order)
    new = events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(log, list(key), "left_anti")
    return log.unionByName(new)


def with_running(frozen: DataFrame, running: DataFrame, key: Sequence[str] = ("symbol", "idx")) -> DataFrame:
    """Frozen rows and those running ones whose key isn't frozen."""
    return frozen.unionByName(running.join(frozen, list(key), "left_anti"))


def all_levels(levels: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Rows of several levels in one table, ``level`` counting from 0."""
    out = levels[0].select(F.lit(0).alias("level"), *columns)
    for n, rows in enumerate(levels[1:], 1):
        out = out.unionByName(rows.select(F.lit(n).alias("level"), *columns))
    return out


def peak_line(lines: DataFrame, up: bool) -> DataFrame:
    """Each symbol's line that ends furthest up (or down), unless the line two before it ends further; the later of equal ones."""
    end = F.col("end_price") if up else -F.col("end_price")
    before = F.lag(end, 2).over(W.partitionBy("symbol").orderBy("idx"))
    rows = lines.withColumns({"_end": end, "_before": before})
    rows = rows.where((F.col("dir") == (1 if up else -1)) & (F.col("_before").isNull() | (F.col("_before") <= F.col("_end"))))
    return rows.groupBy("symbol").agg(F.max_by("idx", F.struct("_end", "idx")).alias("idx"), F.max(F.col("_end")).alias("_end")).select(
        "symbol", "idx", (F.col("_end") if up else -F.col("_end")).alias("end_price")
    )


def tail_signature(rows: DataFrame, columns: Sequence[str], n: int, order: str) -> DataFrame:
    """A hash of each symbol's last ``n`` rows, by which two runs are compared: ``symbol`` and ``signature``."""
    last = latest(rows, n, order)
    one = F.concat_ws(":", *(F.col(c).cast("string") for c in columns))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("t")))), lambda r: r["t"])
    return last.groupBy("symbol").agg(F.sha2(F.array_join(texts, "|"), 256).alias("signature"))

