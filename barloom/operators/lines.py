"""Measures of lines between poles, and rays through poles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_idx():
    return W.partitionBy("symbol").orderBy("idx")


def measures(lines: DataFrame) -> DataFrame:
    """Middle, amplitude, number of bars, slope per bar (null below one bar), share of the begin, and amplitude against the line before."""
    change, bars = F.col("end_price") - F.col("begin_price"), F.col("end_x") - F.col("begin_x")
    rows = lines.withColumns(
        {
            "middle": (F.col("end_price") + F.col("begin_price")) / 2, "amplitude": F.abs(change), "n_bars": bars + 1,
            "slope": F.when(bars >= 1, change / bars), "share": change / F.when(F.col("begin_price") != 0, F.col("begin_price")),
        }
    )
    before = F.lag("amplitude").over(by_idx())
    return rows.withColumn("ratio", F.when(before != 0, F.col("amplitude") / before))


def over_spans(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """First open, extremes, last close and volume of the bars of each span (``symbol``, ``seq``, ``x1``, ``x2``)."""
    held = spans.select("symbol", "seq", F.explode(F.sequence("x1", "x2")).alias("x")).join(bars.select("symbol", "x", "open", "high", "low", "close", "volume"), ["symbol", "x"])
    return held.groupBy("symbol", "seq").agg(
        F.min_by("open", "x").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "x").alias("close"), F.sum("volume").alias("volume")
    )


def poles(confirms: DataFrame) -> DataFrame:
    """Poles of confirmed fractals in order of their confirm: ``n`` from 0, ``fx``, ``x``, ``price``, ``confirm_x``."""
    w = W.partitionBy("symbol").orderBy("confirm_x", "uid")
    price = F.when(F.col("fx") == "top", F.col("fx_high")).otherwise(F.col("fx_low"))
    return confirms.select("symbol", (F.row_number().over(w) - 1).cast("long").alias("n"), "fx", F.col("pole_x").alias("x"), price.alias("price"), "confirm_x")


def _window(poles_: DataFrame, size: int) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("n")
    points = F.array(*(F.lead(F.struct("fx", "x", "price", "confirm_x"), k).over(w) if k else F.struct("fx", "x", "price", "confirm_x") for k in range(size)))
    rows = poles_.select("symbol", "n", points.alias("p")).where(f"p[{size - 1}] IS NOT NULL")
    xs = F.transform("p", lambda p: p["x"])
    of = lambda fx: F.array_sort(F.transform(F.filter("p", lambda p: p["fx"] == fx), lambda p: F.struct(p["x"].alias("x"), p["price"].alias("price"))))
    return rows.select(
        "symbol", "n", F.array_min(xs).alias("low_x"), F.array_max(xs).alias("high_x"), F.array_max(F.transform("p", lambda p: p["confirm_x"])).alias("known_x"),
        of("top").alias("tops"), of("bottom").alias("bottoms"),
    )


def _slope(two):
    return (two[1]["price"] - two[0]["price"]) / F.nullif(two[1]["x"] - two[0]["x"], F.lit(0).cast("long"))


def parallel_rays(poles_: DataFrame) -> DataFrame:
    """For each three poles in a row of two kinds: a ray from the odd one with the slope of the other two."""
    rows = _window(poles_, 3).where("size(tops) > 0 AND size(bottoms) > 0")
    same, odd = F.when(F.size("tops") == 2, F.col("tops")).otherwise(F.col("bottoms")), F.when(F.size("tops") == 2, F.col("bottoms")).otherwise(F.col("tops"))
    rows = rows.withColumns({"same": same, "odd": odd[0]}).where("same[1].x > same[0].x")
    return rows.select("symbol", "n", "low_x", "high_x", "known_x", F.lit("triple").alias("kind"), F.col("odd.x").alias("x0"), F.col("odd.price").alias("y0"), _slope(F.col("same")).alias("slope"))


def pair_rays(poles_: DataFrame) -> DataFrame:
    """For each four poles in a row with two tops and two bottoms: a ray from the later of each two, with their slope."""
    rows = _window(poles_, 4).where("size(tops) = 2 AND size(bottoms) = 2")
    two = F.explode(F.array(F.struct(F.lit("top_pair").alias("kind"), F.col("tops").alias("two")), F.struct(F.lit("bottom_pair").alias("kind"), F.col("bottoms").alias("two"))))
    rows = rows.withColumn("r", two).where("r.two[1].x > r.two[0].x")
    last = F.col("r.two")[1]
    return rows.select("symbol", "n", "low_x", "high_x", "known_x", "r.kind", last["x"].alias("x0"), last["price"].alias("y0"), _slope(F.col("r.two")).alias("slope"))


def nearest_rays(rays: DataFrame, focus: DataFrame) -> DataFrame:
    """Of each symbol's rays those of the window nearest to its ``focus`` (``symbol``, ``focus_x``), with their price there.

    A window that holds the focus is nearest; of several the latest, else the one known last.
    """
    away = F.greatest(F.col("low_x") - F.col("focus_x"), F.col("focus_x") - F.col("high_x"), F.lit(0))
    rows = rays.join(focus, "symbol").withColumn("away", away)
    order = W.partitionBy("symbol").orderBy("away", F.desc(F.when(F.col("away") > 0, F.col("known_x")).otherwise(F.lit(0))), F.desc("n"))
    best = rows.withColumn("rank", F.dense_rank().over(order)).where("rank = 1")
    return best.select("symbol", "n", "kind", "focus_x", (F.col("y0") + F.col("slope") * (F.col("focus_x") - F.col("x0"))).alias("price"))


def gated_volume(units: DataFrame, bars: DataFrame, amount: str = "volume") -> DataFrame:
    """Volume of the running unit at each bar, shown from the confirm of the unit before: ``symbol``, ``x``, ``gated``.

    ``units`` have ``idx``, ``begin_x``, ``end_x``, ``confirm_x`` and ``is_open`` (the last one, up to the last bar). A unit sums
    from behind the end of the one before to the bar before its own confirm. Bars of no unit have 0.
    """
    w = by_idx()
    before_end, before_confirm = F.lag("end_x").over(w), F.lag("confirm_x").over(w)
    last = bars.groupBy("symbol").agg(F.max("x").alias("last_x"))
    spans = units.join(last, "symbol").select(
        "symbol", "idx", F.coalesce(before_end + 1, "begin_x").alias("first_x"), F.coalesce(before_confirm, "begin_x").alias("shown_x"),
        F.when(F.col("is_open"), F.col("last_x")).otherwise(F.col("confirm_x") - 1).alias("last_x"),
    )
    held = spans.where("last_x >= first_x").withColumn("x", F.explode(F.sequence("first_x", "last_x"))).join(bars.select("symbol", "x", amount), ["symbol", "x"])
    run = F.sum(amount).over(W.partitionBy("symbol", "idx").orderBy("x"))
    shown = held.withColumn("gated", run).where("x >= shown_x").groupBy("symbol", "x").agg(F.max_by("gated", "idx").alias("gated"))
    return bars.select("symbol", "x").join(shown, ["symbol", "x"], "left").na.fill(0.0, ["gated"])


def trend_lines(groups: DataFrame, inner: bool) -> DataFrame:
    """Support (``inner``: through begins) or resistance lines of groups of lines: ``symbol``, ``seg_idx``, ``x0``, ``y0``, ``slope``.

    ``groups`` are lines with their group (``seg_idx``), at least three in one. Points are those of every second line from
    the last. From a point the line goes to the one of steepest (``inner``) or flattest slope that doesn't go against the
    last line; the walk goes on from there, and of all lines the one nearest to all points is kept. Where no point lies that
    way an inner line is flat and an outer one none; the walk goes on from the next point. Groups without a line have no row.
    """
    w = W.partitionBy("symbol", "seg_idx")
    rows = groups.withColumns({"n": F.max("idx").over(w) - F.col("idx"), "size": F.count(F.lit(1)).over(w), "way": F.last("dir").over(w.orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    x, y = (F.col("begin_x"), F.col("begin_price")) if inner else (F.col("end_x"), F.col("end_price"))
    points = rows.where("size >= 3 AND n % 2 = 0").select("symbol", "seg_idx", "way", (F.col("n") / 2).cast("int").alias("k"), x.cast("double").alias("x"), y.alias("y"))
    one, other = points.alias("a"), points.select("symbol", "seg_idx", *(F.col(c).alias(f"{c}2") for c in ("k", "x", "y"))).alias("b")
    # Groups are segments, of few lines each, so their points are paired.
    slope = (F.col("y2") - F.col("y")) / F.nullif(F.col("x2") - F.col("x"), F.lit(0.0))
    pairs = one.join(other, ["symbol", "seg_idx"]).where("k2 > k").withColumn("slope", slope).where("way * slope >= 0")
    steep = F.col("way") * F.col("slope") * (1 if inner else -1)
    best = pairs.where("slope <> 0" if inner else "true").groupBy("symbol", "seg_idx", "k").agg(F.max_by(F.struct("slope", "k2"), F.struct(steep, -F.col("k2"))).alias("b"))
    steps = points.join(best, ["symbol", "seg_idx", "k"], "left").groupBy("symbol", "seg_idx").agg(
        F.array_sort(F.collect_list(F.struct("k", "x", "y", F.coalesce("b.slope", F.lit(0.0)).alias("slope"), F.coalesce("b.k2", F.col("k") + 1).alias("to"), F.col("b").isNotNull().alias("real")))).alias("p")
    )
    walk = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen")), lambda a, q: F.when(
        q["k"] == a["at"], F.struct(q["to"].alias("at"), F.concat(a["seen"], F.array(q["k"])).alias("seen"))).otherwise(a))["seen"]
    lines_ = steps.withColumn("k", F.explode(F.filter(walk, lambda k: (k < F.size("p") - 1) | (F.size("p") == 1)))).withColumn("q", F.element_at("p", F.col("k") + 1)).where(F.lit(inner) | F.col("q.real"))
    away = F.aggregate("p", F.lit(0.0), lambda a, r: a + F.abs(F.col("q.slope") * (r["x"] - F.col("q.x")) - r["y"] + F.col("q.y")) / F.sqrt(F.col("q.slope") * F.col("q.slope") + 1))
    return lines_.withColumn("away", away).groupBy("symbol", "seg_idx").agg(F.min_by(F.struct("q.x", "q.y", "q.slope"), F.struct("away", "k")).alias("l")).select(
        "symbol", "seg_idx", F.col("l.x").alias("x0"), F.col("l.y").alias("y0"), F.col("l.slope").alias("slope")
    )
