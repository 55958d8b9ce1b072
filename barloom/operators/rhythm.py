"""Step rhythm: what earlier pullbacks of a move say of the price that the running move may fall back to.

A fractal of the level above begins a group at its pole, with the opposite direction of the move that it ended; before the first
the first line does. Within a group the lines alternate, so the line of a round is known by its number alone: advances
are the even ones from the group's first line on, pullbacks the odd ones. Everything is told at each bar as of the lines and
fractals known then, by windows and joins on numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A pullback extended so many times is a target of the next advance.
EXTENSION = 1.382
NOTHING = 1e-12


def _latest(rows: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """``rows`` with the struct ``name`` of the latest of ``events`` (``symbol``, ``x``, that struct) at or before them."""
    so_far = W.partitionBy("symbol").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(events, ["symbol", "x"], "left").withColumn(name, F.last(name, ignorenulls=True).over(so_far))


def _first_lines(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """``groups`` with ``first_idx``, the first line of the group's direction that begins at its pole or behind it."""
    both = groups.select("symbol", "group", "dir", F.col("pole_x").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("int").alias("line_dir")).unionAll(
        lines.select("symbol", F.lit(None).cast("long"), F.lit(None).cast("int"), "begin_x", F.lit(1), "idx", "dir")
    )
    behind = W.partitionBy("symbol").orderBy("at", "kind").rowsBetween(0, W.unboundedFollowing)
    first = lambda way: F.first(F.when(F.col("line_dir") == way, F.col("idx")), ignorenulls=True).over(behind)
    found = both.withColumns({"up": first(1), "down": first(-1)}).where("kind = 0")
    return groups.join(found.select("symbol", "group", F.when(F.col("dir") > 0, F.col("up")).otherwise(F.col("down")).alias("first_idx")), ["symbol", "group"])


def step_rhythm(lines: DataFrame, running: DataFrame, child_confirms: DataFrame, parent_confirms: DataFrame, bars: DataFrame) -> DataFrame:
    """Rhythm prices at each bar: ``symbol``, ``x``, ``group``, ``dir``, ``round`` (from 0), ``ref`` (the earlier round looked at),
    ``label``, ``ratio``, ``price``, ``threshold`` and ``hit``, whether the bar reaches the threshold.

    ``lines`` are the frozen lines of a level and ``running`` its running ones, ``child_confirms`` the fractals that end
    them, ``parent_confirms`` those of the level above. In a rising group a bottom opens the window and a top closes it, in a
    falling one the other way; a new group opens it. ``ratio`` is the share of the move so far that the pullback behind
    round ``ref`` took back, and ``price`` where the same share leads from the latest advance. Rows grow with the rounds of a group.
    """
    top = F.col("fx") == "top"
    w = W.partitionBy("symbol").orderBy("confirm_x")
    groups = parent_confirms.select(
        "symbol", F.row_number().over(w).cast("long").alias("group"), F.col("confirm_x").alias("start_x"), F.when(top, -1).otherwise(1).alias("dir"), "pole_x",
        F.when(top, F.col("fx_high")).otherwise(F.col("fx_low")).alias("origin"),
    ).unionAll(
        lines.where("idx = 0").select("symbol", F.lit(0).cast("long"), F.lit(-1).cast("long"), "dir", F.col("begin_x"), F.col("begin_price"))
    )
    last = running.groupBy("symbol").agg(F.max_by(F.struct("idx", "dir", "begin_x"), "x").alias("r")).select("symbol", "r.*")
    groups = _first_lines(groups, lines.select("symbol", "idx", "dir", "begin_x").unionByName(last))
    state = F.struct("group", "start_x", F.col("dir").alias("way"), "origin", "first_idx").alias("g")
    first = groups.where("group = 0").select("symbol", state).withColumnRenamed("g", "g0")
    rows = _latest(running.select("symbol", "x", "idx", F.when(F.col("dir") > 0, F.col("high")).otherwise(F.col("low")).alias("end_now")), groups.where("group > 0").select("symbol", F.col("start_x").alias("x"), state), "g")
    rows = _latest(rows, child_confirms.select("symbol", F.col("confirm_x").alias("x"), F.struct(F.col("confirm_x").alias("at"), "fx").alias("c")), "c")
    rows = rows.join(first, "symbol", "left").withColumn("g", F.coalesce("g", "g0")).select("symbol", "x", "idx", "end_now", "g.*", "c")
    opens = F.when(F.col("way") > 0, F.col("c.fx") == "bottom").otherwise(F.col("c.fx") == "top")
    since = F.coalesce(F.col("c.at") > F.col("start_x"), F.lit(False))
    even = F.floor((F.col("idx") - F.col("first_idx")) / 2) * 2
    rows = rows.where(F.when(since, opens).otherwise(True)).withColumn("even", even).where("even >= 2")
    rows = rows.withColumn("ref", F.explode(F.sequence(F.lit(0), (F.col("even") / 2 - 1).cast("int"))))
    ends = lambda n: lines.select("symbol", F.col("idx").alias(n), F.col("end_price").alias(f"{n}_end"))
    rows = rows.withColumns({"d": F.col("first_idx") + F.col("even"), "b": F.col("first_idx") + 2 * F.col("ref"), "c": F.col("first_idx") + 2 * F.col("ref") + 1})
    rows = rows.join(ends("b"), ["symbol", "b"]).join(ends("c"), ["symbol", "c"]).join(ends("d"), ["symbol", "d"], "left")
    d = F.when(F.col("d") == F.col("idx"), F.col("end_now")).otherwise(F.col("d_end"))
    move = F.col("b_end") - F.col("origin")
    ratio = F.when(F.abs(move) > NOTHING, (F.col("b_end") - F.col("c_end")) / move)
    rows = rows.withColumns({"ratio": ratio, "price": d - (d - F.col("origin")) * ratio, "threshold": F.col("c_end") + (F.col("b_end") - F.col("c_end")) * EXTENSION}).where("ratio >= 0")
    rows = rows.join(bars.select("symbol", "x", "high", "low"), ["symbol", "x"])
    now: Column = (F.col("even") / 2 - 1).cast("int")
    return rows.select(
        "symbol", "x", "group", F.col("way").alias("dir"), now.alias("round"), "ref", F.concat_ws("-", "ref", now - F.col("ref")).alias("label"), "ratio", "price", "threshold",
        F.when(F.col("way") > 0, F.col("high") >= F.col("threshold")).otherwise(F.col("low") <= F.col("threshold")).alias("hit"),
    )


def rhythm_hits(rhythm: DataFrame) -> DataFrame:
    """The first bar of each group that reaches the threshold of a round: ``symbol``, ``group``, ``ref``, ``x``, ``threshold``."""
    return rhythm.where("hit").groupBy("symbol", "group", "ref").agg(F.min_by(F.struct("x", "threshold"), "x").alias("h")).select("symbol", "group", "ref", "h.*")
