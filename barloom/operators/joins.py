"""Joins along time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.resample import placed


def parents_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` with ``parent_x``, the first bar of ``parents`` whose time isn't before theirs; null after the last.

    One sort of both sides by time; no range join. It goes day by day, and a child behind its day's last parent takes
    the first one of a later day, so that a symbol isn't one task's.
    """
    both = children.select("symbol", "ts", F.lit(0).alias("is_parent"), F.col("x").alias("child_x"), F.lit(None).cast("long").alias("own_x")).unionAll(
        parents.select("symbol", "ts", F.lit(1), F.lit(None).cast("long"), "x")
    ).withColumn("day", F.to_date("ts"))
    back = W.partitionBy("symbol", "day").orderBy(F.desc("ts"), F.desc("is_parent"), F.desc("own_x")).rowsBetween(W.unboundedPreceding, 0)
    firsts = both.groupBy("symbol", "day").agg(F.min(F.when(F.col("is_parent") == 1, F.struct("ts", "own_x"))).alias("first"))
    later = W.partitionBy("symbol").orderBy("day").rowsBetween(1, W.unboundedFollowing)
    firsts = firsts.select("symbol", "day", F.first("first", ignorenulls=True).over(later)["own_x"].alias("later_x"))
    found = both.withColumn("parent_x", F.last("own_x", ignorenulls=True).over(back)).where("is_parent = 0")
    return found.join(firsts, ["symbol", "day"]).select("symbol", F.col("child_x").alias("x"), "ts", F.coalesce("parent_x", "later_x").alias("parent_x"))


def childless(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Bars of ``parents`` that are no child's parent."""
    used = parents_of(children, parents).where("parent_x IS NOT NULL").select("symbol", F.col("parent_x").alias("x")).distinct()
    return parents.join(used, ["symbol", "x"], "left_anti")


def stepped(bars: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """``bars`` with the value of the latest of ``points`` (``symbol``, ``x``, ``value``) at or before them; null before the first."""
    before = W.partitionBy("symbol").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    rows = bars.join(points.select("symbol", "x", value), ["symbol", "x"], "left")
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(before))


def inside(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """``spans`` (``symbol``, ``x1``, ``x2``, ...) repeated for each bar they hold, by an equality join."""
    return spans.withColumn("x", F.explode(F.sequence("x1", "x2"))).join(bars.select("symbol", "x"), ["symbol", "x"])


def within_bars(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """``ticks`` (``symbol``, ``ts``, ``x``) with ``parent_x``, the first bar that ends at or after them; the last bar after that."""
    last = bars.groupBy("symbol").agg(F.max("x").alias("last_x"))
    found = parents_of(ticks, bars).join(last, "symbol")
    return found.withColumn("parent_x", F.coalesce("parent_x", "last_x")).drop("last_x")


def other_days(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Bars of ``parents`` that hold children of another day, with their number: ``symbol``, ``x``, ``n``."""
    found = parents_of(children, parents).select("symbol", "ts", F.col("parent_x").alias("x"))
    days = parents.select("symbol", "x", F.to_date("ts").alias("day"))
    return found.join(days, ["symbol", "x"]).where(F.to_date("ts") != F.col("day")).groupBy("symbol", "x").agg(F.count(F.lit(1)).alias("n"))


def by_ordinal(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """The k-th tick with the k-th bar of its symbol, as far as both go: ``symbol``, ``x``, ``seq``, ``price``, ``close``."""
    return placed(ticks, ["ts", "seq"], F.to_date("ts"), "x").select("symbol", "x", "seq", "price").join(bars.select("symbol", "x", "close"), ["symbol", "x"])


def spans_of(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """For each coarse bar the fine bars it spans: ``first_x``, ``last_x``, ``middle``, and ``halfway`` to the next one's middle.

    A bar without fine ones spans from 0 to 0, as does what is ``halfway`` to it.
    """
    found = parents_of(fine, coarse).groupBy("symbol", F.col("parent_x").alias("coarse_x")).agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"))
    rows = coarse.select("symbol", F.col("x").alias("coarse_x")).join(found, ["symbol", "coarse_x"], "left").na.fill(0, ["first_x", "last_x"])
    rows = rows.withColumn("middle", (F.col("first_x") + F.col("last_x")) / 2)
    after = F.coalesce(F.lead("middle").over(W.partitionBy("symbol").orderBy("coarse_x")), F.col("middle"))
    return rows.withColumn("halfway", F.col("middle") + (after - F.col("middle")) / 2)


def since_pole(bars: DataFrame, confirms: DataFrame) -> DataFrame:
    """Bars since the pole of the latest confirm (``confirm_x``, ``pole_x``) at or before each bar; 0 before any."""
    points = confirms.groupBy("symbol", F.col("confirm_x").alias("x")).agg(F.max("pole_x").alias("pole_x"))
    rows = stepped(bars.select("symbol", "x"), points, "pole_x")
    return rows.select("symbol", "x", F.coalesce(F.col("x") - F.col("pole_x"), F.lit(0)).alias("since"))


def most_overlapping(spans: DataFrame, remembered: DataFrame, bars: DataFrame) -> DataFrame:
    """For each of ``remembered`` (``symbol``, ``id``, ``x1``, ``x2``) the span (``seq``) that shares most with it, by bars.

    Spans that share a single bar don't count; of equal ones the first is taken.
    """
    one = inside(spans.select("symbol", "seq", "x1", "x2"), bars).select("symbol", "seq", "x")
    other = inside(remembered.select("symbol", "id", "x1", "x2"), bars).select("symbol", "id", "x")
    shared = one.join(other, ["symbol", "x"]).groupBy("symbol", "id", "seq").agg((F.count(F.lit(1)) - 1).alias("shared")).where("shared > 0")
    return shared.groupBy("symbol", "id").agg(F.max_by("seq", F.struct("shared", -F.col("seq"))).alias("seq"), F.max("shared").alias("shared"))


def groups_of_parents(children: DataFrame, parents: DataFrame, groups: DataFrame) -> DataFrame:
    """Merged groups of children that each parent bar holds, each once in a row: ``symbol``, ``parent_x``, ``seq``, ``x``."""
    of = inside(groups.select("symbol", "seq", "x1", "x2"), children).select("symbol", "seq", "x")
    rows = parents_of(children, parents).where("parent_x IS NOT NULL").join(of, ["symbol", "x"])
    before = F.lag("seq").over(W.partitionBy("symbol", "parent_x").orderBy("x"))
    return rows.withColumn("before", before).where("before IS NULL OR before <> seq").select("symbol", "parent_x", "seq", "x")


def aligned(recorded: DataFrame, new: DataFrame) -> DataFrame:
    """Where the bars of ``new`` begin in ``recorded``: of all places whose bar equals the first new one, that from which most
    bars in a row are equal; the first of equal ones. ``symbol``, ``place`` and ``run``."""
    mark = F.struct(*(F.round(c, 6) for c in ("open", "high", "low", "close")), F.round("volume", 4))
    old = recorded.select("symbol", F.col("x").alias("old_x"), mark.alias("old"))
    fresh = new.select("symbol", F.col("x").alias("new_x"), mark.alias("mark"))
    starts = old.join(fresh.where("new_x = 0"), "symbol").where("old = mark").select("symbol", F.col("old_x").alias("place"))
    pairs = starts.join(fresh, "symbol").withColumn("old_x", F.col("place") + F.col("new_x")).join(old, ["symbol", "old_x"], "left")
    differs = F.min(F.when(~F.coalesce(F.col("old") == F.col("mark"), F.lit(False)), F.col("new_x")))
    runs = pairs.groupBy("symbol", "place").agg(F.coalesce(differs, F.max("new_x") + 1).alias("run"))
    return runs.groupBy("symbol").agg(F.max_by("place", F.struct("run", -F.col("place"))).alias("place"), F.max("run").alias("run"))


def children_within(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Lines of ``children`` that lie in the span of a line of ``parents``: ``symbol``, ``idx`` of the parent and ``child``."""
    spans = parents.select("symbol", "idx", F.col("end_x").alias("last_x"), F.explode(F.sequence("begin_x", "end_x")).alias("begin_x"))
    lines = children.select("symbol", F.col("idx").alias("child"), "begin_x", "end_x")
    return spans.join(lines, ["symbol", "begin_x"]).where("end_x <= last_x").select("symbol", "idx", "child")


def shares_time(parents: DataFrame, children: DataFrame, times: DataFrame) -> DataFrame:
    """Bars of ``parents`` that carry one of ``times`` (``symbol``, ``ts``) themselves or in one of their children."""
    below = parents_of(children, parents).join(times.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_semi").select("symbol", F.col("parent_x").alias("x"))
    own = parents.join(times.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_semi").select("symbol", "x")
    return parents.join(below.unionAll(own).distinct(), ["symbol", "x"], "left_semi")
