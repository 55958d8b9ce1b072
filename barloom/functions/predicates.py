"""Predicates over price ranges, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column, touching: bool = False) -> Column:
    """Whether two ranges overlap; ``touching``: whether a shared edge is enough."""
    return (high_b >= low_a) & (high_a >= low_b) if touching else (high_b > low_a) & (high_a > low_b)


def containment(high_a: Column, low_a: Column, high_b: Column, low_b: Column) -> Column:
    """How range b stands to a: ``combine`` if one holds the other, else ``up`` or ``down``."""
    return (
        F.when(((high_a >= high_b) & (low_a <= low_b)) | ((high_a <= high_b) & (low_a >= low_b)), "combine")
        .when((high_a > high_b) & (low_a > low_b), "down")
        .when((high_a < high_b) & (low_a < low_b), "up")
        .otherwise("combine")
    )


def direction(high: Column, low: Column, window) -> Column:
    """+1 or -1 by the middle against the middle before; +1 for the first row and for ties."""
    middle = (high + low) / 2
    return F.when(middle < F.lag(middle).over(window), -1).otherwise(1)


def gap_to_next(high: Column, low: Column, window) -> Column:
    """Whether the next range has no point in common with this one; false for the last."""
    return F.coalesce((F.lead(low).over(window) > high) | (F.lead(high).over(window) < low), F.lit(False))


def tradable(code: Column, name: Column, volume: Column, price: Column) -> Column:
    """Codes and names of ordinary shares with trade."""
    return ~code.rlike("^(688|8|43|920|200|900)") & ~F.upper(name).contains("ST") & (volume > 0) & (price > 0)
