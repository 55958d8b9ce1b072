"""Buy and sell points of pivots over units (bars, or lines numbered by ``x``), with their labels.

A pivot wholly below the one before is a place to buy, one wholly above a place to sell. Of its units the first and each
that goes further are of the first class, the others of the second. Pivots that then follow one another back, each
wholly beyond the one before, are of the third class and up. The first unit of a symbol is no point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.structure import NOTHING


def suffix(n: Column) -> Column:
    """The letters of a number from 0: ``a`` to ``z``, then ``aa``, ``ab`` and so on; up to three letters."""
    letter = lambda k: F.char(F.lit(97) + k % 26)
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.when(n < 26, letter(n)).when(n < 702, F.concat(letter(two), letter(n))).otherwise(F.concat(letter(three), letter(two), letter(n)))


def sides(pivots: DataFrame) -> DataFrame:
    """``pivots`` with ``side``: ``buy`` below the one before, ``sell`` above, else null."""
    w = W.partitionBy("symbol").orderBy("seq")
    below, above = F.col("zg") < F.lag("zd").over(w), F.col("zd") > F.lag("zg").over(w)
    return pivots.withColumn("side", F.when(below, "buy").when(above, "sell"))


def _members(rows: DataFrame, units: DataFrame) -> DataFrame:
    held = rows.withColumn("x", F.explode(F.sequence("x1", "x2"))).where("x > 0").select(*rows.columns, "x")
    found = held.join(units.select("symbol", "x", F.col("high").alias("unit_high"), F.col("low").alias("unit_low")), ["symbol", "x"])
    return found.withColumn("price", F.when(F.col("side") == "buy", F.col("unit_low")).otherwise(F.col("unit_high")))


def _told(rows: DataFrame, cls: Column, letter: Column) -> DataFrame:
    name = F.concat(cls.cast("string"), F.upper(F.substring("side", 1, 1)), suffix(letter))
    return rows.select("symbol", F.col("seq"), "side", "x", "price", cls.cast("int").alias("class"), name.alias("label"))


def _ranked(pivots: DataFrame, units: DataFrame) -> DataFrame:
    rows = _members(sides(pivots).where("side IS NOT NULL").select("symbol", "seq", "side", "x1", "x2"), units)
    further = F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price"))
    before = W.partitionBy("symbol", "seq").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    best = F.max(further).over(before)
    return rows.withColumn("news", best.isNull() | (further > best + NOTHING))


def first_class(pivots: DataFrame, units: DataFrame) -> DataFrame:
    """The first unit of each pivot and each that goes further; all have the letter ``a``."""
    return _told(_ranked(pivots, units).where("news"), F.lit(1), F.lit(0))


def second_class(pivots: DataFrame, units: DataFrame) -> DataFrame:
    """The units that go no further, lettered from each that did."""
    so_far = W.partitionBy("symbol", "seq").orderBy("x")
    rows = _ranked(pivots, units).withColumn("run", F.sum(F.col("news").cast("int")).over(so_far)).where("NOT news")
    return _told(rows, F.lit(2), F.row_number().over(W.partitionBy("symbol", "seq", "run").orderBy("x")) - 1)


def nth_class(pivots: DataFrame, units: DataFrame) -> DataFrame:
    """All units of the pivots that go back one after another behind a pivot with points: class 3 and up."""
    w = W.partitionBy("symbol").orderBy("seq")
    rows = sides(pivots).withColumn("before", F.lag("side").over(w))
    goes_on = F.coalesce(F.col("side") == F.col("before"), F.lit(False))
    rows = rows.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w)).where("side IS NOT NULL")
    run = W.partitionBy("symbol", "run").orderBy("seq")
    rows = rows.withColumns({"class": F.row_number().over(run) + 2, "origin": F.first("before").over(run)}).where("origin IS NOT NULL")
    other = F.when(F.col("side") == "sell", "buy").otherwise("sell")
    found = _members(rows.select("symbol", "seq", other.alias("side"), "x1", "x2", "class"), units)
    return _told(found, F.col("class"), F.row_number().over(W.partitionBy("symbol", "seq").orderBy("x")) - 1)
