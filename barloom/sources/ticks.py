"""Ticks: rows of symbol, ts, seq, price, qty and side; from text files and from tables of events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a line: time, price, volume, optional number of trades, optional side.
LINE = r"^\s*(\d{1,2}:\d{2})\s+(\S+)\s+(\S+)(?:\s+(\d+))?(?:\s+([BS]))?\s*$"
FILE = r"(\d{8})_([^/.]+)\.txt$"


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks from ``events``: the event's type is the symbol, its value the price, ``k`` of its properties the quantity."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = F.col("user_id") % 3
    return e.select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
        F.when(side == 0, "B").when(side == 1, "S").otherwise("").alias("side"),
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks from ``orders``, whose dates have no time of day: for daily and longer bars."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"), F.lit(1.0).alias("qty"), F.lit("").alias("side"),
    )


def symbol_code(code: Column) -> Column:
    """The last six digits, padded on the left."""
    digits = F.regexp_replace(code, r"\D", "")
    return F.lpad(F.substring(digits, F.greatest(F.length(digits) - 5, F.lit(1)), F.lit(6)), 6, "0")


def tick_lines(lines: DataFrame, path: str = "path", line: str = "line", number: str = "number") -> DataFrame:
    """Ticks of text lines; lines that aren't ticks or whose numbers can't be read are left out.

    ``trades`` is one where the line has no number of trades.
    """
    at = lambda k: F.regexp_extract(F.col(line), LINE, k)
    day, code = F.regexp_extract(F.col(path), FILE, 1), F.regexp_extract(F.col(path), FILE, 2)
    rows = lines.where(F.col(line).rlike(LINE)).select(
        symbol_code(code).alias("symbol"),
        F.try_to_timestamp(F.concat(day, F.lit(" "), F.lpad(at(1), 5, "0")), F.lit("yyyyMMdd HH:mm")).alias("ts"),
        F.col(number).alias("seq"), at(2).try_cast("double").alias("price"), at(3).try_cast("double").alias("qty"),
        at(5).alias("side"), F.coalesce(at(4).try_cast("double"), F.lit(1.0)).alias("trades"),
    )
    return rows.where("ts IS NOT NULL AND price IS NOT NULL AND qty IS NOT NULL")


def _decoded(content: bytes, other: str) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode(other, errors="replace")


def read_tick_files(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None, other: str = "GBK") -> DataFrame:
    """Ticks of the text files ``YYYYMMDD_code.txt`` below a path, of the days between two. Lines are numbered in order of their file.

    A file that isn't UTF-8 is read as ``other``. A file is one row, so it must be under 2 GB; files of other days aren't read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    files = files_between(files, begin, end)

    @F.arrow_udf("string")
    def text(content: pa.Array) -> pa.Array:
        return pa.array([_decoded(x, other) for x in content.to_pylist()], pa.string())

    lines = files.select("path", F.posexplode(F.split(text("content"), "\r?\n")).alias("number", "line"))
    return tick_lines(lines)


def files_between(files: DataFrame, begin: str | None = None, end: str | None = None, path: str = "path") -> DataFrame:
    """Rows of ``files`` whose name begins with a day (``YYYYMMDD``) between two, both included; files of other names are left out."""
    day = F.regexp_extract(F.col(path), FILE, 1)
    rows = files.where(day != "")
    rows = rows.where(day >= begin.replace("-", "")[:8]) if begin else rows
    return rows.where(day <= end.replace("-", "")[:8]) if end else rows


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The codes that a path has tick files of, and the days of the first and last: ``symbol``, ``n_files``, ``first_day``, ``last_day``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("path")
    day, code = F.regexp_extract("path", FILE, 1), F.regexp_extract("path", FILE, 2)
    return files.where(day != "").groupBy(symbol_code(code).alias("symbol")).agg(F.count(F.lit(1)).alias("n_files"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
