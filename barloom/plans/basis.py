"""What the registered queries share: hourly bars of the events and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import resample
from barloom.sources.ticks import event_ticks

DIGITS = 6

EVENTS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
  CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS qty,
  CASE user_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'S' ELSE '' END AS side FROM events)"""
ORDERS = """ticks AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS price,
  1.0::DOUBLE AS qty, '' AS side FROM orders)"""
_SLOTS = {
    "day": "date_trunc('day', ts)",
    "week": "date_trunc('week', ts)",
    "month": "date_trunc('month', ts)",
    "9month": "make_date(year(ts), (month(ts) - 1) // 9 * 9 + 1, 1)",
    "quarter": "make_date(year(ts), (month(ts) - 1) // 3 * 3 + 1, 1)",
    "year": "make_date(year(ts), 1, 1)",
    "3year": "make_date(year(ts) // 3 * 3, 1, 1)",
}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ticks_to_bars(event_ticks(spark, sf_dir), "60m")


def slot_sql(period: str) -> str:
    if period in _SLOTS:
        return f"CAST({_SLOTS[period]} AS TIMESTAMP)"
    n = int(period[:-1])
    return f"date_trunc('day', ts) + to_minutes(CAST((hour(ts) * 60 + minute(ts)) // {n} * {n} AS INTEGER))"


def bars_sql(ticks: str, period: str) -> str:
    stamp = "max(slot) + INTERVAL 15 HOUR" if period == "day" else "max(ts)"
    return f"""{ticks}, s AS (SELECT *, {slot_sql(period)} AS slot FROM ticks),
b AS (SELECT symbol, slot, {stamp} AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, seq)) AS close, sum(qty) AS volume, sum(price * qty) AS amount, count(*) AS n_ticks FROM s GROUP BY symbol, slot),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY slot) - 1 AS x FROM b)"""


HOURLY = bars_sql(EVENTS, "60m")
