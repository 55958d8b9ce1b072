"""Queries of the classic structure, and the SQL that says what they return where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import classic, divergence, indicators
from barloom.operators.stages import written
from barloom.plans.basis import HOURLY, hourly, rounded

#: Rules under which the test tables have segments.
LOOSE = classic.StrokeRules(check="loss", strict=False, gaps=True)

GROUPS = """g AS (SELECT symbol, x, 0 AS seq, high, low, 'up' AS dir, high AS bar_high, low AS bar_low FROM bars WHERE x = 0 UNION ALL
  SELECT b.symbol, b.x, CASE WHEN c.holds THEN g.seq ELSE g.seq + 1 END,
    CASE WHEN NOT c.holds THEN b.high WHEN c.flat THEN g.high WHEN g.dir = 'up' THEN greatest(g.high, b.high) ELSE least(g.high, b.high) END,
    CASE WHEN NOT c.holds THEN b.low WHEN c.flat THEN g.low WHEN g.dir = 'up' THEN greatest(g.low, b.low) ELSE least(g.low, b.low) END,
    CASE WHEN c.holds THEN g.dir WHEN g.high > b.high THEN 'down' ELSE 'up' END, b.high, b.low
  FROM g JOIN bars b ON b.symbol = g.symbol AND b.x = g.x + 1,
    LATERAL (SELECT (g.high >= b.high AND g.low <= b.low) OR (g.high <= b.high AND g.low >= b.low) AS holds,
      b.high = b.low AND b.high = CASE WHEN g.dir = 'up' THEN g.high ELSE g.low END AS flat) c),
groups AS (SELECT symbol, seq, min(x) AS x1, max(x) AS x2, arg_max(high, x) AS high, arg_max(low, x) AS low, any_value(dir) AS dir,
  count(*) AS n_units, arg_min(bar_high, x) AS born_high, arg_min(bar_low, x) AS born_low FROM g GROUP BY symbol, seq)"""
FRACTALS = """near AS (SELECT *, lead(x1) OVER w AS confirm_x, lag(high) OVER w AS bh, lag(low) OVER w AS bl, lead(high) OVER w AS nh, lead(low) OVER w AS nl,
  lead(born_high) OVER w AS oh, lead(born_low) OVER w AS ol FROM groups WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
fractals AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS k FROM (SELECT *, CASE WHEN bh < high AND oh < high AND bl < low AND ol < low THEN 'top'
  WHEN bh > high AND oh > high AND bl > low AND ol > low THEN 'bottom' END AS fx FROM near) WHERE fx IS NOT NULL)"""
#: Strict strokes: four groups apart, each end beyond the other with its neighbours, nothing between beyond the ends.
_JOINS = """b.fx <> {a}fx AND b.seq - {a}seq >= 4 AND CASE WHEN b.fx = 'bottom' THEN {a}high > greatest(b.bh, b.high, b.oh) AND b.low < least({a}bl, {a}low, {a}nl)
  ELSE {a}low < least(b.bl, b.low, b.ol) AND b.high > greatest({a}bh, {a}high, {a}nh) END"""
STROKES = f"""firsts AS (SELECT b.symbol, b.k, min(a.k) AS a FROM fractals a JOIN fractals b ON b.symbol = a.symbol AND b.k > a.k WHERE {_JOINS.format(a='a.')} AND NOT EXISTS
  (SELECT 1 FROM fractals c WHERE c.symbol = a.symbol AND c.k > a.k AND c.k < b.k AND CASE WHEN b.fx = 'top' THEN c.high > b.high ELSE c.low < b.low END) GROUP BY b.symbol, b.k),
r AS (SELECT e.symbol, e.k, 0 AS idx, a.seq AS begin_seq, CASE WHEN a.fx = 'top' THEN a.high ELSE a.low END AS begin_price, e.seq AS e_seq, e.fx AS e_fx, e.high AS e_high, e.low AS e_low,
    e.bh AS e_bh, e.bl AS e_bl, e.nh AS e_nh, e.nl AS e_nl, -1e300::DOUBLE AS hi, 1e300::DOUBLE AS lo
  FROM (SELECT symbol, min(k) AS k, arg_min(a, k) AS a FROM firsts GROUP BY symbol) f JOIN fractals e ON e.symbol = f.symbol AND e.k = f.k JOIN fractals a ON a.symbol = f.symbol AND a.k = f.a
  UNION ALL SELECT symbol, k, CASE WHEN act = 'new' THEN idx + 1 ELSE idx END, CASE WHEN act = 'new' THEN e_seq ELSE begin_seq END,
    CASE WHEN act = 'new' THEN CASE WHEN e_fx = 'top' THEN e_high ELSE e_low END ELSE begin_price END,
    CASE WHEN act = 'skip' THEN e_seq ELSE seq END, CASE WHEN act = 'skip' THEN e_fx ELSE fx END, CASE WHEN act = 'skip' THEN e_high ELSE high END, CASE WHEN act = 'skip' THEN e_low ELSE low END,
    CASE WHEN act = 'skip' THEN e_bh ELSE bh END, CASE WHEN act = 'skip' THEN e_bl ELSE bl END, CASE WHEN act = 'skip' THEN e_nh ELSE nh END, CASE WHEN act = 'skip' THEN e_nl ELSE nl END,
    CASE WHEN act = 'skip' THEN greatest(hi, high) ELSE -1e300 END, CASE WHEN act = 'skip' THEN least(lo, low) ELSE 1e300 END
  FROM (SELECT b.symbol, b.k, b.seq, b.fx, b.high, b.low, b.bh, b.bl, b.nh, b.nl, r.idx, r.begin_seq, r.begin_price, r.e_seq, r.e_fx, r.e_high, r.e_low, r.e_bh, r.e_bl, r.e_nh, r.e_nl, r.hi, r.lo,
    CASE WHEN b.fx = r.e_fx THEN CASE WHEN CASE WHEN b.fx = 'top' THEN b.high >= r.e_high ELSE b.low <= r.e_low END THEN 'move' ELSE 'skip' END
      WHEN {_JOINS.format(a='r.e_')} AND CASE WHEN b.fx = 'top' THEN r.hi <= b.high ELSE r.lo >= b.low END THEN 'new' ELSE 'skip' END AS act
    FROM r JOIN fractals b ON b.symbol = r.symbol AND b.k = r.k + 1)),
strokes AS (SELECT symbol, idx::BIGINT AS idx, CASE WHEN arg_max(e_fx, k) = 'top' THEN 1 ELSE -1 END AS dir, any_value(begin_seq) AS begin_seq, arg_max(e_seq, k) AS end_seq, any_value(begin_price) AS begin_price,
  arg_max(CASE WHEN e_fx = 'top' THEN e_high ELSE e_low END, k) AS end_price FROM r GROUP BY symbol, idx)"""


def turned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = hourly(spark, sf_dir)
    return classic.turns(written(classic.classic_groups(bars)), bars), bars


def _strokes(spark: SparkSession, sf_dir: str, rules: classic.StrokeRules = classic.StrokeRules()) -> DataFrame:
    return classic.strokes(*turned(spark, sf_dir), rules)


def structure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strokes, their segments, and the pivots of those with the lines in and out."""
    lines = written(_strokes(spark, sf_dir, LOOSE))
    segments = written(classic.segments(lines))
    pivots = classic.segment_pivots(classic.in_segments(lines, segments))
    return lines, segments, written(classic.in_and_out(pivots, lines, segments))


def strong(lines: DataFrame, bars: DataFrame) -> DataFrame:
    """Lines with their strengths."""
    measured = bars.join(indicators.macd(bars).select("symbol", "x", "hist"), ["symbol", "x"]).join(indicators.rsi(bars), ["symbol", "x"])
    return lines.join(divergence.strengths(lines, measured), ["symbol", "idx"])


def _strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strong(_strokes(spark, sf_dir), hourly(spark, sf_dir)).select("symbol", "idx", "area_in", "area_out", *divergence.METRICS[1:]))


def _exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _, pivots = structure(spark, sf_dir)
    return rounded(divergence.exits(pivots, strong(lines, hourly(spark, sf_dir)), "area", 0.9).select("symbol", "seq", "breaks", "ratio", "diverges", "is_peak", "nearest"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, segments, pivots = structure(spark, sf_dir)
    placed = classic.in_segments(strong(lines, hourly(spark, sf_dir)), segments)
    return rounded(divergence.classic_points(written(placed), segments, pivots))


def _segment_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same a level up: points of segments by their segments, by slope."""
    _, segments, _ = structure(spark, sf_dir)
    lines = written(classic.as_lines(segments))
    upper = written(classic.segments(lines))
    n = F.col("end_x") - F.col("begin_x") + 1
    slope = F.abs(F.col("end_price") - F.col("begin_price")) / F.greatest("begin_price", "end_price") / n
    placed = written(classic.in_segments(lines.withColumn("slope", slope), upper))
    pivots = classic.in_and_out(classic.segment_pivots(placed), lines, upper)
    rules = divergence.PointRules(metric="slope", several=False)
    return rounded(divergence.classic_points(placed, upper, written(pivots), rules))


def entries() -> dict[str, tuple[Callable, str]]:
    group = "symbol, seq::BIGINT AS seq, x1, x2, high, low, dir, n_units, born_high, born_low"
    return {
        "classic_groups": (lambda s, d: rounded(classic.classic_groups(hourly(s, d)).drop("closed")), f"WITH RECURSIVE {HOURLY}, {GROUPS} SELECT {group} FROM groups"),
        "classic_fractals": (
            lambda s, d: turned(s, d)[0].where("fx IS NOT NULL").select("symbol", "seq", "fx", "high", "low", "before_high", "next_low"),
            f"WITH RECURSIVE {HOURLY}, {GROUPS}, {FRACTALS} SELECT symbol, seq::BIGINT AS seq, fx, high, low, bh AS before_high, nl AS next_low FROM fractals",
        ),
        "sure_strokes": (
            lambda s, d: classic.sure_strokes(turned(s, d)[0]),
            f"WITH RECURSIVE {HOURLY}, {GROUPS}, {FRACTALS}, {STROKES} SELECT symbol, idx, dir, begin_seq::BIGINT AS begin_seq, end_seq::BIGINT AS end_seq, begin_price, end_price FROM strokes",
        ),
        "strokes": (_strokes, ""),
        "stroke_strengths": (_strengths, ""),
        "segments": (lambda s, d: structure(s, d)[1], ""),
        "segments_of_segments": (lambda s, d: classic.segments(classic.as_lines(structure(s, d)[1])), ""),
        "lines_in_segments": (lambda s, d: classic.in_segments(*structure(s, d)[:2]), ""),
        "segment_pivots": (lambda s, d: structure(s, d)[2], ""),
        "pivots_over_segments": (lambda s, d: classic.segment_pivots(classic.in_segments(*structure(s, d)[:2]), classic.PivotRules(over_segments=True)), ""),
        "pivot_exits": (_exits, ""),
        "classic_points": (_points, ""),
        "segment_points": (_segment_points, ""),
    }
