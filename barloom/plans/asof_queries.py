"""Queries of what is known of a level at each bar, and the SQL that says what they return."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import asof, changes, features, levels, rhythm
from barloom.operators.stages import written
from barloom.plans.basis import HOURLY, hourly, rounded
from barloom.plans.level_queries import BAR_UNITS, PIVOTS_OF_UNITS, level_sql

RUNNING = """held0 AS (SELECT symbol, idx + 1 AS idx, CASE WHEN fx = 'bottom' THEN 1 ELSE -1 END AS dir, pole_x AS begin_x, confirm_x, CASE WHEN fx = 'bottom' THEN fx_low ELSE fx_high END AS open,
  lead(confirm_x) OVER (PARTITION BY symbol ORDER BY confirm_x) AS until FROM c0 WHERE used),
run0 AS (SELECT * FROM (SELECT h.symbol, b.x, h.idx, h.dir, h.begin_x, h.confirm_x, h.open, greatest(h.open, max(CASE WHEN b.x > h.begin_x THEN b.high END) OVER w) AS high,
    least(h.open, min(CASE WHEN b.x > h.begin_x THEN b.low END) OVER w) AS low, b.close, sum(b.volume) OVER w AS volume
  FROM held0 h JOIN bars b ON b.symbol = h.symbol AND b.x >= h.begin_x AND (h.until IS NULL OR b.x < h.until) WINDOW w AS (PARTITION BY h.symbol, h.idx ORDER BY b.x)) WHERE x >= confirm_x)"""
ONE = f"WITH RECURSIVE {HOURLY}, {BAR_UNITS}, {level_sql(0)}, {RUNNING}"
JUDGED = f"""{ONE}, {level_sql(1)}, states AS (SELECT *, lead(confirm_x) OVER (PARTITION BY symbol ORDER BY n) AS until FROM s1),
tried AS (SELECT r.x, r.begin_x, r.high AS h, r.low AS l, s.*, (gh >= r.high AND gl <= r.low) OR (gh <= r.high AND gl >= r.low) AS holds
  FROM run0 r JOIN states s ON s.symbol = r.symbol AND s.confirm_x <= r.x AND (s.until IS NULL OR s.until > r.x)),
judged AS (SELECT symbol, x, CASE WHEN bh IS NULL THEN CASE WHEN h >= gh AND l <= gl AND NOT (h = gh AND l = gl) THEN CASE WHEN gl - l > h - gh THEN 'top' ELSE 'bottom' END END
    WHEN holds THEN CASE WHEN afx = 'bottom' AND h >= gh AND l < low_broken THEN 'top' WHEN afx = 'top' AND l <= gl AND h > high_broken THEN 'bottom' END
    WHEN bh < gh AND h < gh AND bl < gl AND l < gl THEN 'top' WHEN bh > gh AND h > gh AND bl > gl AND l > gl THEN 'bottom' END AS fx,
  bh IS NULL OR holds AS truncated, g1, g2, gh, gl, begin_x FROM tried)
SELECT symbol, x, fx, truncated, g1 AS fx_x1, g2 AS fx_x2, round(gh, 6) AS fx_high, round(gl, 6) AS fx_low, begin_x AS right_x1 FROM judged WHERE fx IS NOT NULL"""
TAILS = f"""{ONE}, z AS (SELECT symbol, idx AS x, open, high, low, close FROM l0), {PIVOTS_OF_UNITS},
so_far AS (SELECT p.symbol, p.x, p.seq, p.zg, p.zd, l.end_x, first_value(l.dir) OVER w AS dir, first_value(l.begin_x) OVER w AS x1, max(p.high) OVER w AS gg, min(p.low) OVER w AS dd, count(*) OVER w AS n
  FROM p JOIN l0 l ON l.symbol = p.symbol AND l.idx = p.x WINDOW w AS (PARTITION BY p.symbol, p.seq ORDER BY p.x)),
final AS (SELECT symbol, seq, arg_max(zg, x) AS zg, arg_max(zd, x) AS zd, max(x) AS end_idx, arg_max(end_x, x) AS x2, min(x1) AS x1, any_value(dir) AS dir, max(gg) AS gg, min(dd) AS dd, max(n) AS n FROM so_far GROUP BY symbol, seq),
now AS (SELECT r.symbol, r.x, r.idx, r.dir AS way, r.begin_x, r.open, r.high, r.low, r.close, o.x AS last, o.* EXCLUDE (symbol, x), r.high >= o.zd AND r.low <= o.zg AS touches, t.tick
  FROM run0 r JOIN so_far o ON o.symbol = r.symbol AND o.x = r.idx - 1 JOIN t ON t.symbol = r.symbol),
boxes AS (SELECT symbol, x, seq, x1, x AS x2, CASE WHEN abs(zg - zd) > tick + 1e-12 THEN least(zg, high) ELSE zg END AS zg, CASE WHEN abs(zg - zd) > tick + 1e-12 THEN greatest(zd, low) ELSE zd END AS zd,
    greatest(gg, high) AS gg, least(dd, low) AS dd, n + 1 AS n, dir, idx AS end_idx, false AS is_sure FROM now WHERE touches
  UNION ALL SELECT symbol, x, seq, x1, end_x, zg, zd, gg, dd, n, dir, last, false FROM now WHERE NOT touches
  UNION ALL SELECT symbol, x, seq + 1, begin_x, x, CASE WHEN abs(open - close) <= 1e-12 THEN open ELSE high END, CASE WHEN abs(open - close) <= 1e-12 THEN open ELSE low END, high, low, 1, way, idx, false FROM now WHERE NOT touches
  UNION ALL SELECT n.symbol, n.x, f.seq, f.x1, f.x2, f.zg, f.zd, f.gg, f.dd, f.n, f.dir, f.end_idx, true FROM now n JOIN final f ON f.symbol = n.symbol AND f.seq BETWEEN n.seq - 3 AND n.seq - 1),
tails AS (SELECT *, CASE WHEN shift > 0 THEN 1 WHEN shift < 0 THEN -1 ELSE dir END AS value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, x ORDER BY seq DESC) - 1 AS back,
  (zg + zd) - lag(zg + zd) OVER (PARTITION BY symbol, x ORDER BY seq) AS shift FROM boxes) WHERE back <= 2)"""
SIGNALS = f"""{TAILS}, sure AS (SELECT symbol, min(x) AS x, x1, arg_min(value, x) AS value FROM tails WHERE is_sure GROUP BY symbol, x1)
SELECT symbol, x, 'confirm' AS kind, x1, value::INTEGER AS value FROM sure UNION ALL SELECT symbol, x, 'judge', x1, value::INTEGER FROM sure
UNION ALL SELECT symbol, x, 'judge', x1, value::INTEGER FROM tails WHERE back = 1 AND NOT is_sure"""
STRENGTH = """m AS (SELECT symbol, idx, close, close AS f, close AS s, 0.0::DOUBLE AS e FROM l0 WHERE idx = 0 UNION ALL
  SELECT symbol, idx, close, f, s, 0.8 * e + 0.2 * (f - s) FROM (SELECT l.symbol, l.idx, l.close, m.f * 11 / 13 + l.close * 2 / 13 AS f, m.s * 25 / 27 + l.close * 2 / 27 AS s, m.e
    FROM m JOIN l0 l ON l.symbol = m.symbol AND l.idx = m.idx + 1)),
macd AS (SELECT symbol, x, f - s AS dif, 0.8 * e + 0.2 * (f - s) AS dea FROM (SELECT r.symbol, r.x, m.f * 11 / 13 + r.close * 2 / 13 AS f, m.s * 25 / 27 + r.close * 2 / 27 AS s, m.e
  FROM run0 r JOIN m ON m.symbol = r.symbol AND m.idx = r.idx - 1)),
g AS (SELECT symbol, idx, close, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM l0 WHERE idx = 0 UNION ALL
  SELECT l.symbol, l.idx, l.close, (g.up * (least(l.idx, 14) - 1) + greatest(l.close - g.close, 0)) / least(l.idx, 14), (g.down * (least(l.idx, 14) - 1) + greatest(g.close - l.close, 0)) / least(l.idx, 14)
  FROM g JOIN l0 l ON l.symbol = g.symbol AND l.idx = g.idx + 1),
rsi AS (SELECT symbol, x, CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 100.0 ELSE 0.0 END ELSE 100 - 100 / (1 + up / down) END AS rsi FROM
  (SELECT r.symbol, r.x, (g.up * (least(r.idx, 14) - 1) + greatest(r.close - g.close, 0)) / least(r.idx, 14) AS up, (g.down * (least(r.idx, 14) - 1) + greatest(g.close - r.close, 0)) / least(r.idx, 14) AS down
   FROM run0 r JOIN g ON g.symbol = r.symbol AND g.idx = r.idx - 1))"""
DIVERGENCE = f"""{TAILS}, {STRENGTH},
series AS (SELECT b.symbol, b.x, b.high, b.low, b.volume, b.amount, 2 * (m.dif - m.dea) AS hist, r.rsi FROM bars b LEFT JOIN macd m ON m.symbol = b.symbol AND m.x = b.x LEFT JOIN rsi r ON r.symbol = b.symbol AND r.x = b.x),
pairs AS (SELECT t.symbol, t.x, r.idx, r.high <= zg AND r.low >= zd AS inside, one, two FROM (SELECT symbol, x, max(zg) FILTER (back = 0) AS zg, max(zd) FILTER (back = 0) AS zd, max(end_idx) FILTER (back = 1) AS one,
  max(end_idx) FILTER (back = 2) AS two FROM tails GROUP BY symbol, x) t JOIN run0 r ON r.symbol = t.symbol AND r.x = t.x),
seg AS (SELECT symbol, idx, NULL::BIGINT AS upto, dir, begin_x AS b, end_x AS e, end_price - begin_price AS change, confirm_x - begin_x AS span FROM l0
  UNION ALL SELECT symbol, idx, x, dir, begin_x, x, high - low, x - begin_x FROM run0),
ends AS (SELECT g.*, p.hist AS hb, q.hist AS he, p.high AS bh, p.low AS bl, q.high AS eh, q.low AS el FROM seg g JOIN series p ON p.symbol = g.symbol AND p.x = g.b JOIN series q ON q.symbol = g.symbol AND q.x = g.e),
stops AS (SELECT n.symbol, n.idx, n.upto, min(s.x) FILTER (NOT coalesce(s.hist * hb > 0, false)) AS first_stop, max(s.x) FILTER (NOT coalesce(s.hist * he > 0, false)) AS last_stop
  FROM ends n JOIN series s ON s.symbol = n.symbol AND s.x BETWEEN n.b AND n.e GROUP BY n.symbol, n.idx, n.upto),
sums AS (SELECT n.symbol, n.idx, n.upto, coalesce(sum(abs(hist)) FILTER (s.x < coalesce(first_stop, s.x + 1)), 0) + 1e-7 AS area_in, coalesce(sum(abs(hist)) FILTER (s.x > coalesce(last_stop, s.x - 1)), 0) + 1e-7 AS area_out,
    greatest(1e-7, max(abs(hist)) FILTER (hist * dir > 0)) AS peak, coalesce(sum(abs(hist)) FILTER (hist * dir > 0), 0) + 1e-7 AS full_area, max(hist) - min(hist) AS diff, sum(amount) AS amount, sum(volume) AS volume,
    avg(amount) AS amount_avg, avg(volume) AS volume_avg, max(rsi) AS top_rsi, 10000 / (min(rsi) + 1e-7) AS low_rsi
  FROM ends n JOIN stops o ON o.symbol = n.symbol AND o.idx = n.idx AND o.upto IS NOT DISTINCT FROM n.upto JOIN series s ON s.symbol = n.symbol AND s.x BETWEEN n.b AND n.e GROUP BY n.symbol, n.idx, n.upto),
told AS (SELECT n.symbol, n.idx, n.upto, [{{'m': 'area', 'i': area_in, 'o': area_out}}, {{'m': 'peak', 'i': peak, 'o': peak}}, {{'m': 'full_area', 'i': full_area, 'o': full_area}}, {{'m': 'diff', 'i': diff, 'o': diff}},
    {{'m': 'slope', 'i': slope, 'o': slope}}, {{'m': 'amp', 'i': amp, 'o': amp}}, {{'m': 'amount', 'i': amount, 'o': amount}}, {{'m': 'volume', 'i': volume, 'o': volume}}, {{'m': 'amount_avg', 'i': amount_avg, 'o': amount_avg}},
    {{'m': 'volume_avg', 'i': volume_avg, 'o': volume_avg}}, {{'m': 'rsi', 'i': rsi, 'o': rsi}}, {{'m': 'line_slope', 'i': steep, 'o': steep}}] AS all_
  FROM (SELECT *, CASE WHEN dir > 0 THEN top_rsi ELSE low_rsi END AS rsi, CASE WHEN dir > 0 THEN (eh - bl) / nullif(eh, 0) / (e - b + 1) ELSE (bh - el) / nullif(bh, 0) / (e - b + 1) END AS slope,
    CASE WHEN dir > 0 THEN (eh - bl) / nullif(bl, 0) ELSE (bh - el) / nullif(bh, 0) END AS amp, CASE WHEN span >= 1 THEN CASE WHEN abs(change / span) < 1e-12 THEN 1e-7 ELSE abs(change / span) END END AS steep
    FROM ends JOIN sums USING (symbol, idx)  WHERE ends.upto IS NOT DISTINCT FROM sums.upto) n),
flat AS (SELECT symbol, idx, upto, u.m, u.i, u.o FROM (SELECT symbol, idx, upto, unnest(all_) AS u FROM told)),
pair AS (SELECT symbol, x, CASE WHEN inside THEN 'contained' ELSE 'broke' END AS mode, CASE WHEN inside THEN two ELSE one END AS i, CASE WHEN inside THEN one ELSE idx END AS o, CASE WHEN inside THEN NULL ELSE x END AS upto FROM pairs)
SELECT p.symbol, p.x, p.mode, a.m AS measure, round(a.i + 1e-9, 5) AS in_value, round(b.o + 1e-9, 5) AS out_value, CASE WHEN abs(b.o / a.i) < 1000 THEN round(b.o / a.i + 1e-9, 5) ELSE round(b.o / a.i, -2) END AS ratio, CASE WHEN b.o <= a.i THEN 1 ELSE -1 END AS flag
FROM pair p JOIN flat a ON a.symbol = p.symbol AND a.idx = p.i AND a.upto IS NULL JOIN flat b ON b.symbol = p.symbol AND b.idx = p.o AND b.upto IS NOT DISTINCT FROM p.upto AND b.m = a.m
WHERE a.i <> 0 AND b.o IS NOT NULL"""


LAST = """vals AS (SELECT r.symbol, r.x, r.idx, l.idx AS n, l.close, l.high, l.low FROM run0 r JOIN l0 l ON l.symbol = r.symbol AND l.idx < r.idx AND l.idx > r.idx - {n}
  UNION ALL SELECT symbol, x, idx, idx, close, high, low FROM run0)"""
KDJ = """ranged AS (SELECT symbol, idx, close, max(high) OVER w AS top, min(low) OVER w AS bottom FROM l0 WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
rsv AS (SELECT symbol, idx, CASE WHEN top <> bottom THEN 100 * (close - bottom) / (top - bottom) ELSE 0.0 END AS rsv FROM ranged),
kd AS (SELECT symbol, idx, 100.0 / 3 + rsv / 3 AS k, 100.0 / 3 + (100.0 / 3 + rsv / 3) / 3 AS d FROM rsv WHERE idx = 0 UNION ALL
  SELECT r.symbol, r.idx, kd.k * 2 / 3 + r.rsv / 3, kd.d * 2 / 3 + (kd.k * 2 / 3 + r.rsv / 3) / 3 FROM kd JOIN rsv r ON r.symbol = kd.symbol AND r.idx = kd.idx + 1),
live AS (SELECT v.symbol, v.x, any_value(v.idx) AS idx, arg_max(close, n) AS close, max(high) AS top, min(low) AS bottom FROM vals v GROUP BY v.symbol, v.x),
lived AS (SELECT l.symbol, l.x, kd.d, kd.k * 2 / 3 + CASE WHEN top <> bottom THEN 100 * (close - bottom) / (top - bottom) ELSE 0.0 END / 3 AS k FROM live l JOIN kd ON kd.symbol = l.symbol AND kd.idx = l.idx - 1)"""
RHYTHM = f"""{ONE}, {level_sql(1)},
par AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY confirm_x) AS grp, confirm_x AS start_x, CASE WHEN fx = 'top' THEN -1 ELSE 1 END AS way, pole_x, CASE WHEN fx = 'top' THEN fx_high ELSE fx_low END AS origin FROM c1
  UNION ALL SELECT symbol, 0, -1, dir, begin_x, begin_price FROM l0 WHERE idx = 0),
every AS (SELECT symbol, idx, dir, begin_x FROM l0 UNION SELECT symbol, idx, dir, begin_x FROM run0),
grouped AS (SELECT p.*, (SELECT min(idx) FROM every e WHERE e.symbol = p.symbol AND e.dir = p.way AND e.begin_x >= p.pole_x) AS first_idx FROM par p),
told AS (SELECT r.symbol, r.x, r.idx, CASE WHEN r.dir > 0 THEN r.high ELSE r.low END AS end_now, g.* EXCLUDE (symbol, pole_x) FROM run0 r ASOF JOIN grouped g ON g.symbol = r.symbol AND r.x >= g.start_x),
open_ AS (SELECT t.*, (t.idx - t.first_idx) // 2 AS n FROM told t ASOF LEFT JOIN c0 c ON c.symbol = t.symbol AND t.x >= c.confirm_x
  WHERE c.confirm_x IS NULL OR c.confirm_x <= t.start_x OR c.fx = CASE WHEN way > 0 THEN 'bottom' ELSE 'top' END),
refs AS (SELECT *, unnest(range(0, n)) AS ref FROM open_ WHERE n >= 1),
priced AS (SELECT r.*, b.end_price AS b, c.end_price AS c, CASE WHEN first_idx + 2 * n = r.idx THEN end_now ELSE d.end_price END AS d FROM refs r JOIN l0 b ON b.symbol = r.symbol AND b.idx = first_idx + 2 * ref
  JOIN l0 c ON c.symbol = r.symbol AND c.idx = first_idx + 2 * ref + 1 LEFT JOIN l0 d ON d.symbol = r.symbol AND d.idx = first_idx + 2 * n),
rhythm AS (SELECT p.symbol, p.x, grp AS group_, way AS dir, n - 1 AS round_, ref, (b - c) / (b - origin) AS ratio, d - (d - origin) * (b - c) / (b - origin) AS price, c + (b - c) * 1.382 AS threshold,
  CASE WHEN way > 0 THEN q.high >= c + (b - c) * 1.382 ELSE q.low <= c + (b - c) * 1.382 END AS hit FROM priced p JOIN bars q ON q.symbol = p.symbol AND q.x = p.x WHERE abs(b - origin) > 1e-12 AND (b - c) / (b - origin) >= 0)"""


#: Lines as they run and are frozen, and pivots where they are another thing than at the bar before.
CHANGES = f"""{TAILS}, run_seen AS (SELECT symbol, x, seq, x1, x2, zg, zd, gg, dd, n, dir, is_sure, lag((x1, x2, zg, zd, gg, dd, n, is_sure)) OVER w AS old, lag(x) OVER w AS old_x, min(x) FILTER (is_sure) OVER (PARTITION BY symbol, seq) AS sure_x FROM tails WINDOW w AS (PARTITION BY symbol, seq ORDER BY x)),
before AS (SELECT symbol, x, lag(x) OVER (PARTITION BY symbol ORDER BY x) AS last_x FROM (SELECT DISTINCT symbol, x FROM tails)),
gone AS (SELECT b.symbol, b.x, t.seq FROM before b JOIN tails t ON t.symbol = b.symbol AND t.x = b.last_x WHERE t.seq > (SELECT max(seq) FROM tails q WHERE q.symbol = b.symbol AND q.x = b.x)),
changes AS (SELECT symbol, confirm_x AS x, 'line' AS what, idx AS key, 'freeze' AS op, dir, begin_x AS x1, end_x AS x2, open, high, low, close, volume, NULL::DOUBLE AS top, NULL::DOUBLE AS bottom, NULL::BIGINT AS n FROM l0
  UNION ALL SELECT symbol, x, 'line', idx, 'set', dir, begin_x, x, open, high, low, close, volume, NULL, NULL, NULL FROM run0
  UNION ALL SELECT r.symbol, r.x, 'pivot', seq, CASE WHEN is_sure THEN 'freeze' ELSE 'set' END, dir, x1, x2, NULL, zg, zd, NULL, NULL, gg, dd, n FROM run_seen r JOIN before b ON b.symbol = r.symbol AND b.x = r.x
    WHERE (old_x IS DISTINCT FROM b.last_x OR old IS DISTINCT FROM (x1, x2, zg, zd, gg, dd, n, is_sure)) AND NOT (is_sure AND r.x > sure_x)
  UNION ALL SELECT symbol, x, 'pivot', seq, 'drop', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM gone)
SELECT symbol, x, what, key::BIGINT AS key, op, dir::INTEGER AS dir, x1, x2, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume,
  round(top, 6) AS top, round(bottom, 6) AS bottom, n::BIGINT AS n FROM changes"""


_CTES = {"held0", "run0", "z", "t", "p", "pivots", "so_far", "final", "now", "boxes", "tails", "m", "macd", "g", "rsi", "states", "tried", "judged"}


def features_sql(levels_: int) -> str:
    """The wide rows of each level by joins; the CTEs of a level are those of the first, under names of its own."""
    out, parts = [f"WITH RECURSIVE {HOURLY}, {BAR_UNITS}, " + ", ".join(level_sql(n) for n in range(levels_ + 1))], []
    judged = JUDGED.split("states AS")[1].rsplit("\nSELECT", 1)[0]
    pieces = [RUNNING, f"z AS{TAILS.split('z AS', 1)[1]}", STRENGTH, f"states AS{judged}"]
    for n in range(levels_):
        names = {"c0": f"c{n}", "l0": f"l{n}", "s1": f"s{n + 1}"}
        # Names of CTEs stand behind FROM, JOIN and a comma, and before AS (; what else is spelled so is a column or an alias.
        def named(sql: str, n: int = n, names: dict = names) -> str:
            sql = re.sub(r"\b(\w+)( AS \((?:SELECT|\n))", lambda m: f"{names.get(m[1], f'{m[1]}_{n}')}{m[2]}", sql)
            known = set(re.findall(rf"\b(\w+)_{n} AS \(", sql)) | _CTES
            def of_level(m: re.Match) -> str:
                name = names.get(m[2]) or (f"{m[2]}_{n}" if m[2] in known else m[2])
                bare = name != m[2] and not re.match(r" +(?!ON|JOIN|WHERE|GROUP|WINDOW|UNION|LEFT|ASOF|USING)\w", sql[m.end() :])
                return f"{m[1]}{name} {m[2]}" if bare else f"{m[1]}{name}"

            return re.sub(r"(\b(?:FROM|JOIN) +)(\w+)\b", of_level, sql)

        out += [named(piece) for piece in pieces]
        parts.append(f"""SELECT b.symbol, b.x, {n} AS n, round(b.close, 6) AS close, r.idx AS line_idx, r.dir AS line_dir, r.begin_x AS line_begin_x, round(r.high, 6) AS line_high, round(r.low, 6) AS line_low,
  round(CASE WHEN r.x - r.begin_x >= 1 THEN r.dir * (r.high - r.low) / (r.x - r.begin_x) END, 6) AS line_slope,
  round((r.high - r.low) / nullif(abs(f.end_price - f.begin_price), 0), 6) AS adjacent_ratio, CASE k.fx WHEN 'top' THEN -1 WHEN 'bottom' THEN 1 END AS fractal, k.pole_x AS fractal_pole_x,
  CASE j.fx WHEN 'top' THEN -1 WHEN 'bottom' THEN 1 END AS judgment, CASE WHEN j.fx IS NOT NULL THEN j.truncated END AS judgment_cut, t.seq::BIGINT AS pivot_seq, round(t.zg, 6) AS pivot_high, round(t.zd, 6) AS pivot_low,
  (SELECT max(value)::INTEGER FROM (SELECT x1, min(x) AS x, arg_min(value, x) AS value FROM tails_{n} q WHERE q.symbol = b.symbol AND is_sure GROUP BY x1) q WHERE q.x = b.x) AS pivot_confirm,
  (SELECT arg_max(value, x1)::INTEGER FROM (SELECT x1, min(x) AS x, arg_min(value, x) AS value FROM tails_{n} q WHERE q.symbol = b.symbol AND is_sure GROUP BY x1
     UNION ALL SELECT x1, x, value FROM tails_{n} q WHERE q.symbol = b.symbol AND back = 1 AND NOT is_sure) q WHERE q.x = b.x) AS pivot_judgment,
  round(m.dif, 6) AS dif, round(m.dea, 6) AS dea, round(2 * (m.dif - m.dea), 6) AS hist, round(s.rsi, 6) AS rsi
FROM bars b LEFT JOIN run0_{n} r ON r.symbol = b.symbol AND r.x = b.x LEFT JOIN l{n} f ON f.symbol = r.symbol AND f.idx = r.idx - 1 ASOF LEFT JOIN c{n} k ON k.symbol = b.symbol AND b.x >= k.confirm_x
LEFT JOIN judged_{n} j ON j.symbol = b.symbol AND j.x = b.x LEFT JOIN tails_{n} t ON t.symbol = b.symbol AND t.x = b.x AND t.back = 0 LEFT JOIN macd_{n} m ON m.symbol = b.symbol AND m.x = b.x
LEFT JOIN rsi_{n} s ON s.symbol = b.symbol AND s.x = b.x""")
    return ", ".join(out) + "\n" + "\nUNION ALL ".join(f"({p})" for p in parts)


SNAPSHOTS = f"""{CHANGES.rsplit("SELECT", 1)[0]}, versions AS (SELECT *, lead(x) OVER (PARTITION BY symbol, what, key ORDER BY x, op = 'freeze') AS until FROM changes),
born AS (SELECT symbol, what, key, min(x) AS x FROM changes WHERE op <> 'drop' GROUP BY ALL)
SELECT v.symbol, b.x AS at_x, v.what, v.key::BIGINT AS key, v.op, v.dir::INTEGER AS dir, v.x1, v.x2, round(v.open, 6) AS open, round(v.high, 6) AS high, round(v.low, 6) AS low, round(v.close, 6) AS close,
  round(v.volume, 6) AS volume, round(v.top, 6) AS top, round(v.bottom, 6) AS bottom, v.n::BIGINT AS n
FROM versions v LEFT JOIN born g ON g.symbol = v.symbol AND g.what = v.what AND g.key = v.key + 2 JOIN bars b ON b.symbol = v.symbol AND b.x >= greatest(v.x, 24) AND (until IS NULL OR b.x < until) AND (g.x IS NULL OR b.x < g.x)
WHERE v.op <> 'drop'"""


def _level(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The first level's confirmed fractals, lines and running line, and the bars."""
    bars = hourly(spark, sf_dir)
    confirms, made = levels.levels(bars, 1)[0]
    return confirms, made, written(asof.running_lines(confirms, bars)), bars


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, made, running, _ = _level(spark, sf_dir)
    return rounded(asof.judged_fractals(levels.line_units(made), running))


def _tails(spark: SparkSession, sf_dir: str, merge: str = "range") -> DataFrame:
    _, made, running, _ = _level(spark, sf_dir)
    return asof.pivot_tails(made, running, merge)


def _strength(of: Callable) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, made, running, _ = _level(spark, sf_dir)
        return rounded(of(made, running))

    return query


def _divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, made, running, bars = _level(spark, sf_dir)
    found = asof.divergences(made, running, bars)
    large = F.abs("ratio") >= 1000  # a strength against nothing but the least one: few of its digits count
    up = lambda c: F.col(c) + 1e-9  # noqa: E731  # so that ties round up in SQL, too
    return rounded(found.withColumns({"ratio": F.when(large, F.round("ratio", -2)).otherwise(up("ratio")), "in_value": up("in_value"), "out_value": up("out_value")}), 5)


def _rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    found = levels.levels(bars, 2)
    (confirms, made), (upper, _) = found[0], found[1]
    return rhythm.step_rhythm(made, written(asof.running_lines(confirms, bars)), confirms, upper, bars)


def entries() -> dict[str, tuple[Callable, str]]:
    line = "symbol, x, idx, dir, begin_x, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume"
    tail = """symbol, x, back::INTEGER AS back, seq::BIGINT AS seq, x1, x2, round(zg, 6) AS zg, round(zd, 6) AS zd, round(gg, 6) AS gg, round(dd, 6) AS dd, n::BIGINT AS n_members, dir,
    end_idx, is_sure, value::INTEGER AS value"""
    return {
        "running_lines": (lambda s, d: rounded(_level(s, d)[2]), f"{ONE} SELECT {line} FROM run0"),
        "judged_fractals": (_judged, JUDGED),
        "level_pivot_tails": (lambda s, d: rounded(_tails(s, d).drop("merged")), f"{TAILS} SELECT {tail} FROM tails"),
        "level_pivot_signals": (lambda s, d: asof.pivot_signals(_tails(s, d)), SIGNALS),
        "running_line_macd": (
            _strength(asof.line_macd),
            f"{ONE}, {STRENGTH} SELECT symbol, x, round(dif, 6) AS dif, round(dea, 6) AS dea, round(2 * (dif - dea), 6) AS hist FROM macd",
        ),
        "running_line_rsi": (_strength(asof.line_rsi), f"{ONE}, {STRENGTH} SELECT symbol, x, round(rsi, 6) AS rsi FROM rsi"),
        "level_divergences": (_divergences, DIVERGENCE),
        "running_line_trend": (
            _strength(asof.line_trend),
            f"{ONE}, {LAST.format(n=5)} SELECT symbol, x, round(avg(close), 6) AS mean, round(max(close), 6) AS channel_max, round(min(close), 6) AS channel_min FROM vals GROUP BY symbol, x",
        ),
        "running_line_bands": (
            _strength(asof.line_bollinger),
            f"""{ONE}, {LAST.format(n=20)}, bands AS (SELECT symbol, x, avg(close) AS m, CASE WHEN min(close) = max(close) THEN 1e-7 ELSE stddev_pop(close) END AS t FROM vals GROUP BY symbol, x)
            SELECT symbol, x, round(m, 6) AS boll_mid, round(m + 2 * t, 6) AS boll_up, round(CASE WHEN m - 2 * t = 0 THEN 1e-7 ELSE m - 2 * t END, 6) AS boll_down, round(t, 6) AS theta FROM bands""",
        ),
        "running_line_kdj": (
            _strength(asof.line_kdj),
            f"{ONE}, {LAST.format(n=9)}, {KDJ} SELECT symbol, x, round(k, 6) AS k, round(d * 2 / 3 + k / 3, 6) AS d, round(3 * k - 2 * (d * 2 / 3 + k / 3), 6) AS j FROM lived",
        ),
        "feature_rows": (lambda s, d: rounded(features.feature_rows(hourly(s, d))), features_sql(2)),
        "step_rhythm": (
            lambda s, d: rounded(_rhythm(s, d)),
            f"""{RHYTHM} SELECT symbol, x, group_::BIGINT AS "group", dir::INTEGER AS dir, round_::INTEGER AS "round", ref::INTEGER AS ref, ref || '-' || (round_ - ref) AS label, round(ratio, 6) AS ratio,
            round(price, 6) AS price, round(threshold, 6) AS threshold, hit FROM rhythm""",
        ),
        "rhythm_hits": (
            lambda s, d: rounded(rhythm.rhythm_hits(_rhythm(s, d))),
            f'{RHYTHM} SELECT symbol, group_::BIGINT AS "group", ref::INTEGER AS ref, min(x) AS x, round(arg_min(threshold, x), 6) AS threshold FROM rhythm WHERE hit GROUP BY symbol, group_, ref',
        ),
        "level_changes": (lambda s, d: rounded(changes.change_log(hourly(s, d))), CHANGES),
        "level_snapshots": (lambda s, d: rounded(changes.snapshots(changes.change_log(hourly(s, d)), hourly(s, d), skip=24)), SNAPSHOTS),
    }
