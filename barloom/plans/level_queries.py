"""Queries over the levels of market structure, and the SQL that says what they return."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import levels, points, structure
from barloom.plans.basis import HOURLY, hourly, rounded

BAR_UNITS = "u0 AS (SELECT symbol, x AS uid, x AS x1, x AS x2, high, low, high AS top, x AS top_x, low AS bottom, x AS bottom_x, x AS confirm_x FROM bars)"


def level_sql(n: int, truncation: bool = True) -> str:
    """CTEs ``c{n}`` (confirms) and ``l{n}`` (lines as bars) of the units ``u{n}``, and ``u{n+1}``, the next level's units."""
    cut = "true" if truncation else "false"
    return f"""s{n} AS (SELECT symbol, uid AS n, uid AS gu, x1 AS g1, x2 AS g2, high AS gh, low AS gl, true AS up, top AS gt, top_x AS gtx, bottom AS gb, bottom_x AS gbx,
  NULL::DOUBLE AS bh, NULL::DOUBLE AS bl, high AS fh, low AS fl, top_x AS ftx, bottom_x AS fbx, NULL::VARCHAR AS afx, NULL::DOUBLE AS ah, NULL::DOUBLE AS al,
  NULL::DOUBLE AS low_broken, NULL::DOUBLE AS high_broken, NULL::VARCHAR AS ev, NULL::BIGINT AS eu, NULL::BIGINT AS e1, NULL::BIGINT AS e2, NULL::DOUBLE AS eh, NULL::DOUBLE AS el,
  NULL::BIGINT AS pole, false AS used, false AS cut, confirm_x FROM u{n} WHERE uid = 0
UNION ALL SELECT symbol, uid, CASE WHEN act = 'take' THEN gu ELSE uid END, CASE WHEN act = 'take' THEN g1 ELSE x1 END, x2, nh, nl,
  CASE act WHEN 'take' THEN up WHEN 'cut_top' THEN false WHEN 'cut_bottom' THEN true ELSE holds OR gh < high END,
  CASE WHEN act = 'take' THEN greatest(gt, top) ELSE top END, CASE WHEN act = 'take' AND top <= gt THEN gtx ELSE top_x END,
  CASE WHEN act = 'take' THEN least(gb, bottom) ELSE bottom END, CASE WHEN act = 'take' AND bottom >= gb THEN gbx ELSE bottom_x END,
  CASE WHEN act = 'take' THEN bh ELSE gh END, CASE WHEN act = 'take' THEN bl ELSE gl END, fh, fl, ftx, fbx,
  CASE WHEN used THEN kind ELSE afx END, CASE WHEN used THEN gh ELSE ah END, CASE WHEN used THEN gl ELSE al END,
  CASE WHEN kind = 'bottom' THEN gl ELSE low_broken END, CASE WHEN kind = 'top' THEN gh ELSE high_broken END,
  kind, gu, g1, g2, gh, gl, CASE WHEN kind = 'top' THEN gtx ELSE gbx END, used, act LIKE 'cut%', confirm_x
FROM (SELECT *, kind IS NOT NULL AND (afx IS NULL OR (afx <> kind AND CASE WHEN kind = 'top' THEN gh > al ELSE gl < ah END)) AS used FROM
  (SELECT *, CASE WHEN act = 'cut_top' THEN 'top' WHEN act = 'cut_bottom' THEN 'bottom' WHEN act = 'take' OR bh IS NULL THEN NULL
      WHEN bh < gh AND high < gh AND bl < gl AND low < gl THEN 'top' WHEN bh > gh AND high > gh AND bl > gl AND low > gl THEN 'bottom' END AS kind,
    CASE WHEN act = 'take' THEN CASE WHEN up THEN greatest(gh, high) ELSE least(gh, high) END WHEN act = 'cut_top' THEN greatest(th, tl) WHEN act = 'cut_bottom' THEN oh ELSE high END AS nh,
    CASE WHEN act = 'take' THEN CASE WHEN up THEN greatest(gl, low) ELSE least(gl, low) END WHEN act = 'cut_top' THEN tl WHEN act = 'cut_bottom' THEN least(ol, oh) ELSE low END AS nl FROM
  (SELECT *, CASE WHEN high >= gh THEN gh - step ELSE high END AS th, CASE WHEN low >= gl THEN gl - step ELSE low END AS tl,
    CASE WHEN low <= gl THEN gl + step ELSE low END AS ol, CASE WHEN high <= gh THEN gh + step ELSE high END AS oh,
    CASE WHEN bh IS NULL THEN CASE WHEN {cut} AND high >= gh AND low <= gl AND NOT (high = gh AND low = gl)
        THEN CASE WHEN gl - low > high - gh THEN 'cut_top' ELSE 'cut_bottom' END ELSE 'open' END
      WHEN NOT holds THEN 'open'
      WHEN {cut} AND afx = 'bottom' AND high >= gh AND low < low_broken THEN 'cut_top' WHEN {cut} AND afx = 'top' AND low <= gl AND high > high_broken THEN 'cut_bottom'
      ELSE 'take' END AS act FROM
  (SELECT u.*, s.* EXCLUDE (symbol, confirm_x, ev, eu, e1, e2, eh, el, pole, used, cut), (gh >= u.high AND gl <= u.low) OR (gh <= u.high AND gl >= u.low) AS holds,
    greatest(abs(gh - gl) * 1e-4, greatest(abs(gl), abs(gh), 1.0) * 1e-8, 1e-8) AS step FROM s{n} s JOIN u{n} u ON u.symbol = s.symbol AND u.uid = s.n + 1))))),
k{n} AS (SELECT symbol, n, eu AS uid, ev AS fx, confirm_x, e1 AS fx_x1, e2 AS fx_x2, eh AS fx_high, el AS fx_low, pole AS pole_x, used, cut AS truncated,
  CASE WHEN used THEN sum(used::INT) OVER w - 1 END AS idx, fh, fl, ftx, fbx FROM s{n} WHERE ev IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY n)),
v{n} AS (SELECT *, CASE WHEN fx = 'top' THEN 1 ELSE -1 END AS dir, coalesce(lag(confirm_x) OVER w, confirm_x) AS begin_confirm_x,
  coalesce(lag(pole_x) OVER w, CASE WHEN fx = 'top' THEN fbx ELSE ftx END) AS begin_x, coalesce(lag(fx_high) OVER w, fh) AS begin_high, coalesce(lag(fx_low) OVER w, fl) AS begin_low
  FROM k{n} WHERE used WINDOW w AS (PARTITION BY symbol ORDER BY n)),
c{n} AS (SELECT k.symbol, k.uid, k.fx, k.confirm_x, k.fx_x1, k.fx_x2, k.fx_high, k.fx_low, k.pole_x, k.used, k.truncated, k.idx::BIGINT AS idx, v.dir, v.begin_confirm_x, v.begin_x,
  v.begin_high, v.begin_low FROM k{n} k LEFT JOIN v{n} v ON v.symbol = k.symbol AND v.n = k.n),
l{n} AS (SELECT v.symbol, v.idx::BIGINT AS idx, v.dir, v.begin_x, v.pole_x AS end_x, v.begin_confirm_x, v.confirm_x, b.open,
  greatest(b.open, b.body_high) AS high, least(b.open, b.body_low) AS low, coalesce(b.body_close, b.open) AS close, b.volume, b.top, b.top_x, b.bottom, b.bottom_x,
  b.open AS begin_price, CASE WHEN v.dir > 0 THEN v.fx_high ELSE v.fx_low END AS end_price, v.begin_high, v.begin_low, v.fx_high AS end_high, v.fx_low AS end_low
  FROM v{n} v, LATERAL (SELECT CASE WHEN v.dir > 0 THEN v.begin_low ELSE v.begin_high END AS open, max(high) FILTER (x > v.begin_x) AS body_high, min(low) FILTER (x > v.begin_x) AS body_low,
    arg_max(close, x) FILTER (x > v.begin_x) AS body_close, sum(volume) AS volume, max(high) AS top, arg_max(x, (high, -x)) AS top_x, min(low) AS bottom, arg_min(x, (low, x)) AS bottom_x
    FROM bars WHERE bars.symbol = v.symbol AND x BETWEEN v.begin_x AND v.pole_x) b),
u{n + 1} AS (SELECT symbol, idx AS uid, begin_x AS x1, end_x AS x2, high, low, top, top_x, bottom, bottom_x, confirm_x FROM l{n})"""


TWO = f"WITH RECURSIVE {HOURLY}, {BAR_UNITS}, {level_sql(0)}, {level_sql(1)}"
C_COLS = "symbol, uid, fx, confirm_x, fx_x1, fx_x2, round(fx_high, 6) AS fx_high, round(fx_low, 6) AS fx_low, pole_x, used, truncated, idx, dir, begin_confirm_x, begin_x, round(begin_high, 6) AS begin_high, round(begin_low, 6) AS begin_low"
L_COLS = """symbol, idx, dir, begin_x, end_x, begin_confirm_x, confirm_x, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume,
top, top_x, bottom, bottom_x, round(begin_price, 6) AS begin_price, round(end_price, 6) AS end_price, round(begin_high, 6) AS begin_high, round(begin_low, 6) AS begin_low,
round(end_high, 6) AS end_high, round(end_low, 6) AS end_low"""
#: Pivots of units ``z`` (symbol, x from 0, open, high, low, close).
PIVOTS_OF_UNITS = """t AS (SELECT symbol, least(0.01, min(CASE WHEN high - low > 1e-12 THEN high - low END)) AS tick FROM z GROUP BY symbol),
p AS (SELECT symbol, x, 0 AS seq, CASE WHEN abs(open - close) <= 1e-12 THEN open ELSE high END AS zg,
    CASE WHEN abs(open - close) <= 1e-12 THEN open ELSE low END AS zd, high, low FROM z WHERE x = 0 UNION ALL
  SELECT b.symbol, b.x, CASE WHEN c.touches THEN p.seq ELSE p.seq + 1 END,
    CASE WHEN c.touches THEN CASE WHEN abs(p.zg - p.zd) > t.tick + 1e-12 THEN least(p.zg, b.high) ELSE p.zg END
         WHEN abs(b.open - b.close) <= 1e-12 THEN b.open ELSE b.high END,
    CASE WHEN c.touches THEN CASE WHEN abs(p.zg - p.zd) > t.tick + 1e-12 THEN greatest(p.zd, b.low) ELSE p.zd END
         WHEN abs(b.open - b.close) <= 1e-12 THEN b.open ELSE b.low END, b.high, b.low
  FROM p JOIN z b ON b.symbol = p.symbol AND b.x = p.x + 1 JOIN t ON t.symbol = p.symbol,
    LATERAL (SELECT b.high >= p.zd AND b.low <= p.zg AS touches) c),
pivots AS (SELECT symbol, seq, min(x) AS x1, max(x) AS x2, arg_max(zg, x) AS zg, arg_max(zd, x) AS zd, max(high) AS gg, min(low) AS dd,
  count(*) AS n_members, seq < max(seq) OVER (PARTITION BY symbol) AS is_sure FROM p GROUP BY symbol, seq)"""
_SUFFIX = re.compile(r"suffix\((row_number\(\) OVER \([^()]*\)) - 1\)")
_LETTER = "chr((97 + ({k}) % 26)::INT)"


def _suffix(match: re.Match) -> str:
    """Letters of a number from 0, up to two: ``a`` to ``z``, then ``aa``."""
    k = f"{match[1]} - 1"
    return f"CASE WHEN {k} < 26 THEN {_LETTER.format(k=k)} ELSE {_LETTER.format(k=f'({k}) // 26 - 1')} || {_LETTER.format(k=k)} END"


POINTS_OF_UNITS = _SUFFIX.sub(_suffix, """side AS (SELECT *, CASE WHEN zg < lag(zd) OVER w THEN 'buy' WHEN zd > lag(zg) OVER w THEN 'sell' END AS side FROM pivots WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
member AS (SELECT s.symbol, s.seq, s.side, b.x, CASE WHEN s.side = 'buy' THEN b.low ELSE b.high END AS price FROM side s JOIN z b ON b.symbol = s.symbol AND b.x BETWEEN s.x1 AND s.x2
  WHERE s.side IS NOT NULL AND b.x > 0),
far AS (SELECT *, CASE WHEN side = 'buy' THEN -price ELSE price END AS far FROM member),
best AS (SELECT *, max(far) OVER (PARTITION BY symbol, seq ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM far),
first_class AS (SELECT symbol, seq, side, x, price, 1 AS class, '1' || upper(left(replace(side, 'sell', 's'), 1)) || 'a' AS label FROM best WHERE best IS NULL OR far > best + 1e-12),
marked AS (SELECT *, best IS NULL OR far > best + 1e-12 AS news FROM best),
second_class AS (SELECT symbol, seq, side, x, price, 2 AS class, '2' || upper(left(side, 1)) || suffix(row_number() OVER (PARTITION BY symbol, seq, run ORDER BY x) - 1) AS label FROM
  (SELECT *, sum(news::INT) OVER (PARTITION BY symbol, seq ORDER BY x) AS run FROM marked) WHERE NOT news),
runs AS (SELECT *, sum(CASE WHEN side = lag_side AND side IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY seq) AS run FROM
  (SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY seq) AS lag_side FROM side)),
chains AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY seq) + 2 AS class, first_value(lag_side) OVER (PARTITION BY symbol, run ORDER BY seq) AS origin FROM runs WHERE side IS NOT NULL),
nth_class AS (SELECT c.symbol, c.seq, CASE WHEN c.side = 'sell' THEN 'buy' ELSE 'sell' END AS side, b.x, CASE WHEN c.side = 'sell' THEN b.low ELSE b.high END AS price, c.class::INT AS class,
  c.class || CASE WHEN c.side = 'sell' THEN 'B' ELSE 'S' END || suffix(row_number() OVER (PARTITION BY c.symbol, c.seq ORDER BY b.x) - 1) AS label
  FROM chains c JOIN z b ON b.symbol = c.symbol AND b.x BETWEEN c.x1 AND c.x2 WHERE c.origin IS NOT NULL AND b.x > 0)""")


def _level(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, DataFrame]:
    return levels.levels(hourly(spark, sf_dir), n + 1)[n]


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.numbered_units(_level(spark, sf_dir, 0)[1])


def _points(cls: Callable) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        units = _units(spark, sf_dir)
        found = structure.pivots(units)
        return rounded(cls(found, units))

    return query


def entries() -> dict[str, tuple[Callable, str]]:
    z = "z AS (SELECT symbol, idx AS x, open, high, low, close FROM l0)"
    of_lines = f"WITH RECURSIVE {HOURLY}, {BAR_UNITS}, {level_sql(0)}, {z}, {PIVOTS_OF_UNITS}"
    legs = f"WITH RECURSIVE {HOURLY}, {BAR_UNITS}, {level_sql(0, False)}"
    point = "symbol, seq::BIGINT AS seq, side, x, round(price, 6) AS price, class::INTEGER AS class, label"
    return {
        "legs": (
            lambda s, d: rounded(levels.lines(levels.confirms(levels.bar_units(hourly(s, d)), truncation=False)).drop("begin_high", "begin_low", "end_high", "end_low")),
            f"{legs} SELECT symbol, idx, dir, begin_x, end_x, begin_confirm_x, confirm_x, begin_price, end_price FROM l0",
        ),
        "level_confirms": (lambda s, d: rounded(levels.confirms(levels.bar_units(hourly(s, d)))), f"{TWO} SELECT {C_COLS} FROM c0"),
        "level_lines": (lambda s, d: rounded(_level(s, d, 0)[1]), f"{TWO} SELECT {L_COLS} FROM l0"),
        "level_2_confirms": (lambda s, d: rounded(_level(s, d, 1)[0]), f"{TWO} SELECT {C_COLS} FROM c1"),
        "level_2_lines": (lambda s, d: rounded(_level(s, d, 1)[1]), f"{TWO} SELECT {L_COLS} FROM l1"),
        "level_pivots": (
            lambda s, d: rounded(structure.pivots(_units(s, d))),
            f"{of_lines} SELECT symbol, seq::BIGINT AS seq, x1, x2, round(zg, 6) AS zg, round(zd, 6) AS zd, round(gg, 6) AS gg, round(dd, 6) AS dd, n_members, is_sure FROM pivots",
        ),
        "points_1": (_points(points.first_class), f"{of_lines}, {POINTS_OF_UNITS} SELECT {point} FROM first_class"),
        "points_2": (_points(points.second_class), f"{of_lines}, {POINTS_OF_UNITS} SELECT {point} FROM second_class"),
        "points_n": (_points(points.nth_class), f"{of_lines}, {POINTS_OF_UNITS} SELECT {point} FROM nth_class"),
    }
