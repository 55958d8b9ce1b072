"""Strength of lines, divergence of the lines into and out of pivots, and the points that follow from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST = 1e-7
TYPES = ("1", "1p", "2", "2s", "3a", "3b")
METRICS = ("area", "peak", "full_area", "diff", "slope", "amp", "volume", "amount", "volume_avg", "amount_avg", "rsi")


def _over(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is zero."""
    return a / F.nullif(b, F.lit(0.0))


def strengths(strokes: DataFrame, bars: DataFrame) -> DataFrame:
    """Strokes (with ``from_x`` to ``to_x``, the bars of their groups) and their strength by each of ``METRICS``.

    ``bars`` have ``hist``, ``rsi``, ``volume`` and ``amount``. ``area_in`` and ``area_out`` are the histogram's areas of one sign
    from the begin on and back from the end; the others are those of ``METRICS``. What is measured against a price of zero
    (``slope``, ``amp``) is null.
    """
    line = W.partitionBy("symbol", "idx")
    keep = ["symbol", "idx", "dir", "begin_x", "end_x", "begin_price", "end_price"]
    held = strokes.select(*keep, F.explode(F.sequence("from_x", "to_x")).alias("x")).join(bars.select("symbol", "x", "hist", "rsi", "volume", "amount"), ["symbol", "x"])
    at = lambda c: F.max(F.when(F.col("x") == F.col(c), F.col("hist"))).over(line)
    held = held.withColumns({"h0": at("begin_x"), "h1": at("end_x")})
    stop0 = F.min(F.when((F.col("x") >= F.col("begin_x")) & (F.col("hist") * F.col("h0") <= 0), F.col("x"))).over(line)
    stop1 = F.max(F.when((F.col("x") <= F.col("end_x")) & (F.col("hist") * F.col("h1") <= 0), F.col("x"))).over(line)
    held = held.withColumns({"stop0": stop0, "stop1": stop1})
    x, size, up = F.col("x"), F.abs("hist"), F.col("dir") > 0
    mine = F.col("hist") * F.col("dir") > 0
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    found = held.groupBy(*keep).agg(
        (total((x >= F.col("begin_x")) & (x < F.coalesce("stop0", x + 1)), size) + LEAST).alias("area_in"),
        (total((x <= F.col("end_x")) & (x > F.coalesce("stop1", x - 1)), size) + LEAST).alias("area_out"),
        F.greatest(F.lit(LEAST), F.coalesce(F.max(F.when(mine, size)), F.lit(0.0))).alias("peak"),
        (total(mine & (x >= F.col("begin_x")) & (x <= F.col("end_x")), size) + LEAST).alias("full_area"), (F.max("hist") - F.min("hist")).alias("diff"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.max("rsi").alias("high_rsi"), F.min("rsi").alias("low_rsi"),
    )
    n = F.col("end_x") - F.col("begin_x") + 1
    begin, end = F.col("begin_price"), F.col("end_price")
    return found.select(
        "symbol", "idx", "area_in", "area_out", "peak", "full_area", "diff", (_over(F.abs(end - begin), F.when(up, end).otherwise(begin)) / n).alias("slope"),
        _over(F.abs(end - begin), begin).alias("amp"), "volume", "amount", (F.col("volume") / n).alias("volume_avg"), (F.col("amount") / n).alias("amount_avg"),
        F.when(up, F.col("high_rsi")).otherwise(10000.0 / (F.col("low_rsi") + LEAST)).alias("rsi"),
    )


@dataclass(frozen=True)
class PointRules:
    """``rate``: the most that a line out may have of the strength of the line in (over 100: any); ``least_pivots`` in a segment,
    of several lines only with ``several``; ``peak``: the line out must go furthest; ``retrace``: the most of the line before a
    second-class point that it may take back; ``follow``: only behind a point of the first class.

    ``follow_2s``: points like the second ones only behind one; ``most_2s``: how many at most; ``follow_3``: third-class
    points only behind another point; ``strict_3``: only at the pivots next to the segment's end; ``peak_3``: only if they
    reach the pivot's furthest price; ``pivots_3a``: how many pivots are looked at; ``buys`` and ``sells``: the types wanted."""

    metric: str = "peak"
    rate: float = float("inf")
    least_pivots: int = 1
    several: bool = True
    peak: bool = True
    retrace: float = 0.9999
    follow: bool = True
    follow_2s: bool = False
    most_2s: int | None = None
    follow_3: bool = True
    strict_3: bool = False
    peak_3: bool = False
    pivots_3a: int = 1
    buys: tuple[str, ...] = TYPES
    sells: tuple[str, ...] = TYPES


def _strength(lines: DataFrame, metric: str, out: bool, name: str, key: str) -> DataFrame:
    column = f"area_{'out' if out else 'in'}" if metric == "area" else metric
    high, low = F.greatest("begin_price", "end_price"), F.least("begin_price", "end_price")
    return lines.select(
        "symbol", F.col("idx").alias(key), F.col(column).alias(f"{name}_strength"), F.col("dir").alias(f"{name}_dir"), high.alias(f"{name}_high"),
        low.alias(f"{name}_low"), F.col("end_price").alias(f"{name}_end"),
    )


def exits(pivots: DataFrame, lines: DataFrame, metric: str = "peak", rate: float = float("inf"), out_line: str = "out_line", until: str | None = None) -> DataFrame:
    """With ``until``, lines of the pivot beyond that one don't count for the peak.

    ``pivots`` (with ``in_line`` and ``out_line``) and whether the line out leaves their range (``breaks``), its strength against
    that of the line in (``ratio``), whether it ``diverges``, whether it goes furthest (``is_peak``) and how near the nearest inner end comes (``nearest``).

    What would be divided by zero is null: ``ratio`` against no strength, ``nearest`` to an end at a price of zero. A line without a
    strength diverges only if any strength passes."""
    rows = pivots.join(_strength(lines, metric, False, "in", "in_line"), ["symbol", "in_line"])
    rows = rows.join(_strength(lines, metric, True, "out", out_line), ["symbol", out_line])
    inner = lines.select("symbol", F.col("idx").alias("line"), F.greatest("begin_price", "end_price").alias("h"), F.least("begin_price", "end_price").alias("l"), F.col("end_price").alias("e"))
    last = F.least("end_line", F.greatest("begin_line", until)) if until else F.col("end_line")
    held = rows.select("symbol", "seq", "out_dir", "out_high", "out_low", "out_end", F.explode(F.sequence(F.col("begin_line"), last)).alias("line")).join(inner, ["symbol", "line"])
    beyond = F.when(F.col("out_dir") < 0, F.col("l") < F.col("out_low")).otherwise(F.col("h") > F.col("out_high"))
    peaks = held.groupBy("symbol", "seq").agg((~F.bool_or(beyond)).alias("is_peak"), F.min(_over(F.abs(F.col("e") - F.col("out_end")), F.col("out_end"))).alias("nearest"))
    breaks = F.when(F.col("out_dir") < 0, F.col("out_low") < F.col("low")).otherwise(F.col("out_high") > F.col("high"))
    ratio = _over(F.col("out_strength"), F.col("in_strength"))
    passes = F.lit(True) if rate > 100 else F.coalesce(F.col("out_strength") <= rate * F.col("in_strength"), F.lit(False))
    rows = rows.withColumns({"breaks": breaks, "ratio": ratio, "diverges": breaks & passes}).join(peaks, ["symbol", "seq"])
    return rows.select(*pivots.columns, "breaks", "ratio", "diverges", "is_peak", F.when(F.col("is_peak"), F.col("nearest")).alias("nearest"))


def first_points(lines: DataFrame, segments: DataFrame, pivots: DataFrame, rules: PointRules) -> DataFrame:
    """Points at the ends of segments: class ``1`` if the last pivot is of several lines and reaches that end, else ``1p`` if it
    goes beyond the line two before; it is a target if strength diverges."""
    several = F.col("begin_line") < F.col("end_line")
    counts = pivots.where("segment IS NOT NULL").groupBy("symbol", "segment").agg(
        F.count(F.when(several, 1) if rules.several else F.lit(1)).alias("n_pivots"),
        F.max_by(F.struct("seq", "begin_line", "end_line", "in_line", "out_line", "low", "high"), "seq").alias("p"),
    )
    rows = segments.select("symbol", F.col("idx").alias("segment"), F.col("dir").alias("seg_dir"), "begin_line", F.col("end_line").alias("line")).join(counts, ["symbol", "segment"], "left")
    reaches = F.coalesce(F.col("p.out_line") >= F.col("line"), F.lit(False)) | (F.col("p.end_line") >= F.col("line"))
    trend = F.coalesce((F.col("p.begin_line") < F.col("p.end_line")) & reaches & (F.col("line") - F.col("p.in_line") > 2), F.lit(False))
    enough = F.lit(True) if rules.least_pivots <= 0 else F.coalesce(F.col("n_pivots"), F.lit(0)) >= rules.least_pivots
    rows = rows.withColumns({"trend": trend, "enough": enough})
    with_end = rows.where("trend").select("symbol", "segment", "line", "seg_dir", "enough", "p.*").withColumn("end_out", F.col("line"))
    told = exits(with_end, lines, rules.metric, rules.rate, out_line="end_out")
    own_peak = exits(with_end.where("out_line IS NOT NULL"), lines, rules.metric, until="line").select("symbol", "segment", F.col("is_peak").alias("out_peak"))
    told = told.join(own_peak, ["symbol", "segment"], "left")
    fine = F.col("diverges") & F.col("enough") & (F.coalesce("out_peak", F.lit(False)) if rules.peak else F.lit(True))
    first = told.select("symbol", "line", F.lit("1").alias("type"), (F.col("seg_dir") < 0).alias("is_buy"), fine.alias("is_target"), F.when(F.col("breaks"), F.col("ratio")).alias("ratio"), F.lit(None).cast("long").alias("of_line"))
    flat = rows.where("NOT trend").withColumn("before", F.col("line") - 2).where("before >= begin_line")
    flat = flat.join(_strength(lines, rules.metric, False, "in", "before"), ["symbol", "before"]).join(_strength(lines, rules.metric, True, "out", "line"), ["symbol", "line"])
    flat = flat.where("out_dir = seg_dir").where(F.when(F.col("out_dir") < 0, F.col("out_low") <= F.col("in_low")).otherwise(F.col("out_high") >= F.col("in_high")))
    passes = F.lit(True) if rules.rate == float("inf") else F.coalesce(F.col("out_strength") <= rules.rate * F.col("in_strength"), F.lit(False))
    second = flat.select("symbol", "line", F.lit("1p"), F.col("out_dir") < 0, passes & F.col("enough"), _over(F.col("out_strength"), F.col("in_strength") + LEAST), F.lit(None).cast("long"))
    return first.unionAll(second)


def _wanted(points: DataFrame, rules: PointRules) -> DataFrame:
    """Points of the wanted types; those of the first class stay, but as no targets."""
    wanted = F.when(F.col("is_buy"), F.col("type").isin(*rules.buys)).otherwise(F.col("type").isin(*rules.sells))
    return points.withColumn("is_target", F.col("is_target") & wanted).where(F.col("is_target") | F.col("type").isin("1", "1p"))


def classic_points(lines: DataFrame, segments: DataFrame, pivots: DataFrame, rules: PointRules = PointRules()) -> DataFrame:
    """Points at the ends of lines: ``symbol``, ``line``, ``type`` (of ``TYPES``), ``is_buy``, ``is_target``, ``ratio``, ``of_line`` (of the first class).

    ``lines`` have their strengths and segments (``seg_idx``), ``pivots`` their lines in and out and segment. Types that
    a side doesn't want are left out; a point of the first class stays, but is no target then. A line has a row for
    each type that its end is of.
    """
    ones = _wanted(first_points(lines, segments, pivots, rules), rules)
    twos = _wanted(second_points(lines, segments, ones, rules), rules)
    stored = ones.where("is_target").unionAll(twos).select("symbol", F.col("line").alias("of_line")).distinct()
    threes = after_points(lines, segments, pivots, stored, rules).unionAll(before_points(lines, segments, pivots, stored, rules))
    return ones.unionAll(twos).unionAll(_wanted(threes, rules))


def _shaped(lines: DataFrame, prefix: str) -> DataFrame:
    """Lines by number with their extremes, end and span, under names with ``prefix``."""
    high, low = F.greatest("begin_price", "end_price"), F.least("begin_price", "end_price")
    found = {"": F.col("idx"), "_dir": F.col("dir"), "_high": high, "_low": low, "_end": F.col("end_price"), "_span": high - low, "_seg": F.col("seg_idx")}
    return lines.select("symbol", *(c.alias(f"{prefix}{n}") for n, c in found.items()))


def _ends(segments: DataFrame) -> DataFrame:
    """Segments with the number of their symbol's segments."""
    size = (F.col("end_line") - F.col("begin_line") + 1).alias("seg_size")
    rows = segments.select("symbol", F.col("idx").alias("segment"), F.col("dir").alias("seg_dir"), "is_sure", F.col("end_line").alias("of_line"), size)
    return rows.join(segments.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_segments")), "symbol")


def _told(rows: DataFrame, kind: str, line: str, ratio: Column) -> DataFrame:
    return rows.select("symbol", F.col(line).alias("line"), F.lit(kind).alias("type"), (F.col(f"{line}_dir") < 0).alias("is_buy"), F.lit(True).alias("is_target"), ratio.alias("ratio"), "of_line")


def second_points(lines: DataFrame, segments: DataFrame, ones: DataFrame, rules: PointRules) -> DataFrame:
    """Points ``2``, where the line after next takes back little of the next one, and ``2s``: every second line behind, as long as
    they overlap the first two of them, don't go past the next line and take back as little.

    The lines looked at are of the point's own segment, or of the last one behind it: a segment's lines at most. Of a flat line
    nothing is taken back, so behind one there are none.
    """
    ends = _ends(segments)
    starts = ends.where("n_segments > 1").select("symbol", "of_line", "n_segments", (F.col("of_line") + 1).alias("turn"), (F.col("of_line") + 2).alias("two"))
    if rules.follow:
        starts = starts.join(ones.where("is_target").select("symbol", F.col("line").alias("of_line")).distinct(), ["symbol", "of_line"], "left_semi")
    else:
        none = F.lit(None).cast("long")
        starts = starts.unionAll(ends.where("n_segments = 1").select("symbol", none, "n_segments", F.lit(0).cast("long"), F.lit(1).cast("long")))
    rows = starts.join(_shaped(lines, "turn"), ["symbol", "turn"]).join(_shaped(lines, "two"), ["symbol", "two"])
    rows = rows.withColumn("rate", _over(F.col("two_span"), F.col("turn_span")))
    twos = _told(rows.where(F.col("rate") <= rules.retrace), "2", "two", F.col("rate"))
    sure = ends.select("symbol", F.col("segment").alias("two_seg"), F.col("is_sure").alias("two_sure"))
    base = (rows.where(F.col("rate") <= rules.retrace) if rules.follow_2s else rows).join(sure, ["symbol", "two_seg"], "left")
    near = base.withColumn("like_seg", F.explode(F.array(F.col("two_seg"), F.col("two_seg") + 1))).join(_shaped(lines, "like"), ["symbol", "like_seg"])
    near = near.where("like > two AND (like - two) % 2 = 0").withColumn("level", (F.col("like") - F.col("two")) / 2)
    chain = W.partitionBy("symbol", "turn")
    at_first = lambda c: F.max(F.when(F.col("level") == 1, F.col(c))).over(chain)
    near = near.withColumns({"first_high": at_first("like_high"), "first_low": at_first("like_low")})
    one = F.col("level") == 1
    low, high = F.when(one, F.col("two_low")).otherwise(F.greatest("two_low", "first_low")), F.when(one, F.col("two_high")).otherwise(F.least("two_high", "first_high"))
    past = F.when(F.col("like_dir") < 0, F.col("like_low") < F.col("turn_low")).otherwise(F.col("like_high") > F.col("turn_high"))
    back = _over(F.abs(F.col("like_end") - F.col("turn_end")), F.col("turn_span"))
    inside = (F.col("like_seg") == F.col("two_seg")) | ((F.col("like_seg") >= F.col("n_segments") - 1) & ~F.coalesce("two_sure", F.lit(False)))
    good = inside & (F.col("like_high") > low) & (F.col("like_low") < high) & ~past & F.coalesce(back <= rules.retrace, F.lit(False))
    if rules.most_2s is not None:
        good &= F.col("level") <= rules.most_2s
    near = near.withColumns({"back": back, "stop": F.min(F.when(good, None).otherwise(F.col("level"))).over(chain)})
    return twos.unionAll(_told(near.where("stop IS NULL OR level < stop"), "2s", "like", F.col("back")))


def _several(pivots: DataFrame) -> DataFrame:
    return pivots.where("segment IS NOT NULL AND begin_line < end_line").select("symbol", "segment", "seq", "in_line", "out_line", "low", "high", "peak_low", "peak_high")


def _comes_back(line: str) -> Column:
    return F.when(F.col(f"{line}_dir") < 0, F.col(f"{line}_low") < F.col("high")).otherwise(F.col(f"{line}_high") > F.col("low"))


def after_points(lines: DataFrame, segments: DataFrame, pivots: DataFrame, stored: DataFrame, rules: PointRules) -> DataFrame:
    """Points ``3a``: behind the line out of the next segment's first pivot (or first few), a line that doesn't come back to it."""
    ends = _ends(segments)
    many = ends.where("n_segments > 1")
    if rules.follow_3:
        many = many.join(stored, ["symbol", "of_line"], "left_semi")
    nexts = many.select("symbol", "of_line", "n_segments", (F.col("segment") + 1).alias("segment"))
    if not rules.follow_3:
        nexts = nexts.unionAll(ends.where("n_segments = 1").select("symbol", F.lit(None).cast("long"), "n_segments", "segment"))
    sizes = ends.select("symbol", F.col("segment").alias("three_seg"), F.col("seg_size").alias("three_size"))
    rows = nexts.join(ends.select("symbol", "segment", "seg_dir"), ["symbol", "segment"]).join(_several(pivots), ["symbol", "segment"])
    by = W.partitionBy("symbol", "segment").orderBy("seq")
    rows = rows.withColumns({"rank": F.row_number().over(by), "first_in": F.first("in_line").over(by)})
    if rules.strict_3:
        rows = rows.where(F.col("first_in") == F.coalesce(F.col("of_line"), F.lit(-1)) + 1)
    rows = rows.where(F.col("rank") <= rules.pivots_3a).withColumn("three", F.col("out_line") + 1)
    rows = rows.join(_shaped(lines, "three"), ["symbol", "three"], "left").join(sizes, ["symbol", "three_seg"], "left")
    other = F.when(F.col("three_size").isNull(), F.col("segment") != F.col("n_segments") - 1).otherwise((F.col("three_seg") != F.col("segment")) & (F.col("three_size") >= 3))
    stops = F.col("three_dir").isNull() | other | (F.col("three_dir") == F.col("seg_dir")) | ((F.col("three_seg") != F.col("segment")) & (F.col("segment") < F.col("n_segments") - 2))
    rows = rows.withColumn("stop", F.min(F.when(stops, F.col("rank"))).over(W.partitionBy("symbol", "segment"))).where("stop IS NULL OR rank < stop")
    far = F.when(F.col("three_dir") < 0, F.col("three_high") >= F.col("peak_high")).otherwise(F.col("three_low") <= F.col("peak_low"))
    rows = rows.where(~_comes_back("three") & (far if rules.peak_3 else F.lit(True)))
    return _told(rows, "3a", "three", F.lit(None).cast("double"))


def before_points(lines: DataFrame, segments: DataFrame, pivots: DataFrame, stored: DataFrame, rules: PointRules) -> DataFrame:
    """Points ``3b``: of every second line behind a segment's end the first that doesn't come back to the segment's last pivot, up
    to the line out of the next segment's first pivot."""
    ends = _ends(segments)
    rows = ends.where("n_segments > 1")
    if rules.follow_3:
        rows = rows.join(stored, ["symbol", "of_line"], "left_semi")
    several = _several(pivots)
    last = several.groupBy("symbol", "segment").agg(F.max_by(F.struct("out_line", "low", "high"), "seq").alias("p"))
    rows = rows.join(last, ["symbol", "segment"]).select("symbol", "segment", "of_line", "n_segments", "p.*")
    if rules.strict_3:
        rows = rows.where("out_line = of_line")
    first_out = several.groupBy("symbol", "segment").agg(F.min_by("out_line", F.when(F.col("out_line").isNotNull(), F.col("seq"))).alias("next_out"), F.count(F.lit(1)).alias("next_pivots"))
    nexts = ends.select("symbol", "segment", F.col("of_line").alias("next_end")).join(first_out, ["symbol", "segment"], "left").withColumn("segment", F.col("segment") - 1)
    rows = rows.join(nexts, ["symbol", "segment"], "left")
    open_ = F.col("next_end").isNull() | (F.coalesce("next_pivots", F.lit(0)) == 0) & (F.col("segment") + 2 >= F.col("n_segments"))
    until = F.when(~open_, F.coalesce("next_out", F.col("next_end") - 1))
    reach = F.when(F.col("segment") + 3 >= F.col("n_segments"), F.col("n_segments")).otherwise(F.col("segment") + 1)
    near = rows.withColumn("until", until).withColumn("three_seg", F.explode(F.sequence(F.col("segment") + 1, reach))).join(_shaped(lines, "three"), ["symbol", "three_seg"])
    near = near.where("three >= of_line + 2 AND (three - of_line) % 2 = 0 AND (until IS NULL OR three <= until)").where(~_comes_back("three"))
    found = near.groupBy("symbol", "segment", "of_line").agg(F.min_by(F.struct("three", "three_dir"), "three").alias("t")).select("symbol", "of_line", "t.*")
    return _told(found, "3b", "three", F.lit(None).cast("double"))
