"""Positions that entry and exit conditions open and close, and what they made."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.folds import ordered_fold

TRADE = "n long, entry_x long, exit_x long, entry_price double, exit_price double"
_TESTS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}


def condition(rule: Mapping) -> Column:
    """A condition over columns: ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}`` or ``{"field", "op", "value"}``, whose value may be ``{"field"}``."""
    if "all" in rule or "any" in rule:
        both = "all" in rule
        out = F.lit(both)
        for part in rule["all" if both else "any"]:
            out = out & condition(part) if both else out | condition(part)
        return out
    if "not" in rule:
        return ~condition(rule["not"])
    value = rule["value"]
    return getattr(F.col(rule["field"]), _TESTS[rule["op"]])(F.col(value["field"]) if isinstance(value, Mapping) else F.lit(value))


class Positions:
    """One position at a time: opened by a bar's entry, closed by a later one's exit at its price."""

    def __init__(self) -> None:
        self.n, self.open = -1, None

    def add(self, x, price, enters, leaves) -> list[tuple]:
        if self.open is None:
            if enters:
                self.open = (x, price)
            return []
        if not leaves:
            return []
        (begin, paid), self.open = self.open, None
        self.n += 1
        return [(self.n, begin, x, paid, price)]

    def end(self) -> list[tuple]:
        return [(self.n + 1, self.open[0], None, self.open[1], None)] if self.open else []


def trades(bars: DataFrame, entry: Column, exit_: Column, price: str = "close") -> DataFrame:
    """Trades of each symbol; one that is still open has no exit. A null condition is none."""
    no = F.lit(False)
    rows = bars.withColumns({"price": F.col(price), "enters": F.coalesce(entry, no), "leaves": F.coalesce(exit_, no)})
    return ordered_fold(rows, Positions, ["x", "price", "enters", "leaves"], TRADE)


def summary(trades_: DataFrame) -> DataFrame:
    """Closed trades, those that won and their share, profit per unit, and the logarithm of the compounded growth of each symbol."""
    done = trades_.where("exit_x IS NOT NULL").withColumns({"profit": F.col("exit_price") - F.col("entry_price"), "growth": F.col("exit_price") / F.col("entry_price")})
    won = F.sum(F.when(F.col("profit") > 0, 1).otherwise(0))
    return done.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), won.alias("n_won"), (won / F.count(F.lit(1))).alias("win_rate"), F.sum("profit").alias("profit"), F.sum(F.log("growth")).alias("log_growth")
    )
