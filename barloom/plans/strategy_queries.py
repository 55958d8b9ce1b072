"""Queries of counts, trend lines, indicators of lines, snapshots and backtests, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import backtest, classic, demark, indicators, joins, levels, lines, structure
from barloom.plans import classic_queries
from barloom.plans.basis import HOURLY, hourly, rounded
from barloom.plans.level_queries import BAR_UNITS, level_sql

ENTRY = {"all": [{"field": "close", "op": "<", "value": 20.0}, {"field": "x", "op": ">=", "value": 10}]}
EXIT = {"any": [{"field": "close", "op": ">", "value": {"field": "mean"}}, {"not": {"field": "close", "op": "<=", "value": 150.0}}]}


def _line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.levels(hourly(spark, sf_dir), 1)[0][1]


def _line_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last five lines' closes, at each bar as of the lines known then."""
    made = _line_bars(spark, sf_dir)
    means = indicators.trend(structure.numbered_units(made), 5).join(made.select("symbol", F.col("idx").alias("x"), "confirm_x"), ["symbol", "x"])
    points = means.groupBy("symbol", F.col("confirm_x").alias("x")).agg(F.max_by("mean", "x").alias("mean"))
    return rounded(joins.stepped(hourly(spark, sf_dir).select("symbol", "x"), points, "mean"))


def _line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.bollinger(structure.numbered_units(_line_bars(spark, sf_dir)), 5))


def _trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, segments, _ = classic_queries.structure(spark, sf_dir)
    groups = classic.in_segments(made, segments).where("seg_dir IS NOT NULL")
    sides = [lines.trend_lines(groups, inner).withColumn("side", F.lit(name)) for inner, name in ((True, "inner"), (False, "outer"))]
    return rounded(sides[0].unionByName(sides[1]))


def _level_trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend lines of the lines that each line of the level above is made of."""
    found = levels.levels(hourly(spark, sf_dir), 2)
    upper = found[1][1].select("symbol", F.col("idx").alias("seg_idx"), F.col("begin_x").alias("from_x"), F.col("end_x").alias("to_x"))
    groups = found[0][1].join(upper, "symbol").where("begin_x >= from_x AND end_x <= to_x")
    sides = [lines.trend_lines(groups, inner).withColumn("side", F.lit(name)) for inner, name in ((True, "inner"), (False, "outer"))]
    return rounded(sides[0].unionByName(sides[1]))


def demark_sql(strict: bool = False, perfect: bool = False, breaks: bool = True) -> str:
    """The counters as a recursion: the live run (``w``, ``n``) and the countdown (``cw``, ``cn``, its edge, whether the run is its own)."""
    far = "CASE WHEN w > 0 THEN close >= high2 ELSE close <= low2 END" if strict else "w2 * (close - close2) > 0"
    far = far.replace("w > 0", "w2 > 0")
    whole = "(w < 0 AND least(low, low1) < least(low2, low3)) OR (w > 0 AND greatest(high, high1) > greatest(high2, high3))" if perfect else "true"
    reverse = "OR w = -cw" if breaks else ""
    return f"""WITH RECURSIVE {HOURLY}, d AS (SELECT symbol, x, close, high, low, CASE WHEN x >= 5 THEN sign(close - lag(close, 4) OVER s)::INT ELSE 0 END AS way, lag(close, 2) OVER s AS close2, lag(high, 1) OVER s AS high1,
  lag(low, 1) OVER s AS low1, lag(high, 2) OVER s AS high2, lag(low, 2) OVER s AS low2, lag(high, 3) OVER s AS high3, lag(low, 3) OVER s AS low3, max(high) OVER nine AS most, min(low) OVER nine AS least_,
  lag(close, 13) OVER s AS before, lag(high, 8) OVER s AS first_high, lag(low, 8) OVER s AS first_low FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY x), nine AS (PARTITION BY symbol ORDER BY x ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
r AS (SELECT symbol, x, 0 AS w, 0 AS n, 0 AS cw, 0 AS cn, 0.0::DOUBLE AS edge, false AS own, 0 AS run, false AS starts, 0 AS told_way, 0 AS told FROM d WHERE x = 0 UNION ALL
  SELECT symbol, x, w, CASE WHEN over_ AND own2 THEN 0 ELSE n2 END, CASE WHEN over_ THEN 0 ELSE w2 END, cn2 + hit::INT, edge2, own2, n2, starts, CASE WHEN hit THEN w2 ELSE 0 END, CASE WHEN hit THEN cn2 + 1 ELSE 0 END
  FROM (SELECT *, w2 <> 0 AND NOT over_ AND coalesce({far}, false) AS hit FROM (SELECT *, w2 <> 0 AND (cn2 = 13 OR CASE WHEN w2 > 0 THEN low < edge2 ELSE high > edge2 END) AS over_ FROM
    (SELECT *, CASE WHEN starts THEN w WHEN n2 = 9 {reverse} THEN 0 ELSE cw END AS w2, CASE WHEN starts THEN 0 ELSE cn END AS cn2, starts OR (own AND w = cw) AS own2,
      CASE WHEN NOT starts THEN edge WHEN w > 0 THEN CASE WHEN first_low > before THEN least(least_, before) ELSE least_ END ELSE CASE WHEN first_high < before THEN greatest(most, before) ELSE most END END AS edge2
    FROM (SELECT *, n2 = 9 AND ({whole}) AS starts FROM (SELECT d.symbol, d.x, d.close, d.high, d.low, d.way AS w, CASE WHEN d.way = 0 THEN 0 WHEN d.way = r.w THEN r.n + 1 ELSE 1 END AS n2, r.cw, r.cn, r.edge, r.own,
      d.* EXCLUDE (symbol, x, close, high, low, way) FROM r JOIN d ON d.symbol = r.symbol AND d.x = r.x + 1)))))),
marks AS (SELECT symbol, x, 'setup' AS kind, w AS dir, run AS n FROM r WHERE w <> 0 UNION ALL SELECT symbol, x, 'complete', w, 9 FROM r WHERE starts
  UNION ALL SELECT symbol, x, 'countdown', told_way, told FROM r WHERE told_way <> 0 UNION ALL SELECT symbol, x, 'complete', told_way, 13 FROM r WHERE told = 13)
SELECT symbol, x, kind, dir::INTEGER AS dir, n::INTEGER AS n FROM marks"""


TREND_LINES = """grouped AS (SELECT c.symbol, p.idx AS seg_idx, c.dir, c.idx, c.begin_x, c.begin_price, c.end_x, c.end_price, max(c.idx) OVER w - c.idx AS back, count(*) OVER w AS size, arg_max(c.dir, c.idx) OVER w AS way
  FROM l0 c JOIN l1 p ON p.symbol = c.symbol AND c.begin_x >= p.begin_x AND c.end_x <= p.end_x WINDOW w AS (PARTITION BY c.symbol, p.idx)),
pts AS (SELECT symbol, seg_idx, 'inner' AS side, way, back // 2 AS k, begin_x::DOUBLE AS x, begin_price AS y FROM grouped WHERE size >= 3 AND back % 2 = 0
  UNION ALL SELECT symbol, seg_idx, 'outer', way, back // 2, end_x, end_price FROM grouped WHERE size >= 3 AND back % 2 = 0),
far AS (SELECT a.symbol, a.seg_idx, a.side, a.k, b.k AS k2, (b.y - a.y) / (b.x - a.x) AS slope, a.way * (b.y - a.y) / (b.x - a.x) * CASE WHEN a.side = 'inner' THEN 1 ELSE -1 END AS rank
  FROM pts a JOIN pts b ON b.symbol = a.symbol AND b.seg_idx = a.seg_idx AND b.side = a.side AND b.k > a.k WHERE b.x <> a.x AND a.way * (b.y - a.y) / (b.x - a.x) >= CASE WHEN a.side = 'inner' THEN 1e-300 ELSE 0 END),
pick AS (SELECT symbol, seg_idx, side, k, arg_max(slope, (rank, -k2)) AS slope, arg_max(k2, (rank, -k2)) AS k2 FROM far GROUP BY ALL),
step AS (SELECT p.*, c.slope AS told, coalesce(c.slope, 0) AS slope, coalesce(c.k2, p.k + 1) AS to_k, max(p.k) OVER (PARTITION BY p.symbol, p.seg_idx, p.side) AS last FROM pts p
  LEFT JOIN pick c ON c.symbol = p.symbol AND c.seg_idx = p.seg_idx AND c.side = p.side AND c.k = p.k),
walk AS (SELECT * FROM step WHERE k = 0 UNION ALL SELECT s.* FROM walk w JOIN step s ON s.symbol = w.symbol AND s.seg_idx = w.seg_idx AND s.side = w.side AND s.k = w.to_k WHERE s.k < s.last),
away AS (SELECT w.symbol, w.seg_idx, w.side, w.k, w.x, w.y, w.slope, sum(abs(w.slope * (p.x - w.x) - p.y + w.y) / sqrt(w.slope * w.slope + 1)) AS away FROM walk w
  JOIN pts p ON p.symbol = w.symbol AND p.seg_idx = w.seg_idx AND p.side = w.side WHERE w.side = 'inner' OR w.told IS NOT NULL GROUP BY ALL)
SELECT symbol, seg_idx, arg_min(x, (away, k)) AS x0, round(arg_min(y, (away, k)), 6) AS y0, round(arg_min(slope, (away, k)), 6) AS slope, side FROM away GROUP BY symbol, seg_idx, side"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir).withColumn("mean", F.avg("close").over(indicators.trailing(20)))
    return backtest.trades(bars, backtest.condition(ENTRY), backtest.condition(EXIT))


_TRADES = f"""WITH RECURSIVE {HOURLY}, m AS (SELECT symbol, x, close, avg(close) OVER (PARTITION BY symbol ORDER BY x ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM bars),
c AS (SELECT symbol, x, close, close < 20 AND x >= 10 AS enters, close > mean OR close > 150 AS leaves FROM m),
p AS (SELECT symbol, x, enters AS held, CASE WHEN enters THEN x END AS entry_x, CASE WHEN enters THEN close END AS entry_price, NULL::BIGINT AS done_x, NULL::DOUBLE AS done_price, NULL::BIGINT AS exit_x, NULL::DOUBLE AS exit_price
    FROM c WHERE x = 0 UNION ALL
  SELECT c.symbol, c.x, CASE WHEN p.held THEN NOT c.leaves ELSE c.enters END, CASE WHEN p.held THEN CASE WHEN c.leaves THEN NULL ELSE p.entry_x END WHEN c.enters THEN c.x END,
    CASE WHEN p.held THEN CASE WHEN c.leaves THEN NULL ELSE p.entry_price END WHEN c.enters THEN c.close END, CASE WHEN p.held AND c.leaves THEN p.entry_x END,
    CASE WHEN p.held AND c.leaves THEN p.entry_price END, CASE WHEN p.held AND c.leaves THEN c.x END, CASE WHEN p.held AND c.leaves THEN c.close END
  FROM p JOIN c ON c.symbol = p.symbol AND c.x = p.x + 1),
done AS (SELECT symbol, done_x AS entry_x, exit_x, done_price AS entry_price, exit_price FROM p WHERE exit_x IS NOT NULL),
trades AS (SELECT * FROM done UNION ALL SELECT p.symbol, p.entry_x, NULL, p.entry_price, NULL FROM p JOIN (SELECT symbol, max(x) AS x FROM p GROUP BY symbol) l USING (symbol, x) WHERE p.held)"""


def entries() -> dict[str, tuple[Callable, str]]:
    of_lines = f"WITH RECURSIVE {HOURLY}, {BAR_UNITS}, {level_sql(0)}"
    return {
        "demarks": (lambda s, d: demark.demarks(hourly(s, d)), demark_sql()),
        "demarks_strict": (lambda s, d: demark.demarks(hourly(s, d), demark.Demark(strict=True, perfect=True, breaks=False)), demark_sql(True, True, False)),
        "demarks_kept": (lambda s, d: demark.demarks(hourly(s, d), demark.Demark(breaks=False)), demark_sql(breaks=False)),
        "level_trend_lines": (_level_trend_lines, f"WITH RECURSIVE {HOURLY}, {BAR_UNITS}, {level_sql(0)}, {level_sql(1)}, {TREND_LINES}"),
        "trend_lines": (_trend_lines, ""),
        "line_means": (
            _line_means,
            f"""{of_lines}, m AS (SELECT symbol, idx, confirm_x, avg(close) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean FROM l0)
            SELECT b.symbol, b.x, round((SELECT arg_max(m.mean, m.idx) FROM m WHERE m.symbol = b.symbol AND m.confirm_x <= b.x), 6) AS mean FROM bars b""",
        ),
        "line_bands": (
            _line_bands,
            f"""{of_lines}, m AS (SELECT symbol, idx AS x, avg(close) OVER w AS m, stddev_pop(close) OVER w AS t FROM l0 WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
            SELECT symbol, x, round(m, 6) AS boll_mid, round(m + 2 * t, 6) AS boll_up, round(CASE WHEN m - 2 * t = 0 THEN 1e-7 ELSE m - 2 * t END, 6) AS boll_down, round(CASE WHEN t = 0 THEN 1e-7 ELSE t END, 6) AS theta FROM m""",
        ),
        "trades": (
            lambda s, d: rounded(_trades(s, d)),
            f"{_TRADES} SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY entry_x) - 1 AS n, entry_x, exit_x, entry_price, exit_price FROM trades",
        ),
        "trade_summary": (
            lambda s, d: rounded(backtest.summary(_trades(s, d)), 4),
            f"""{_TRADES} SELECT symbol, count(*) AS n_trades, sum((exit_price > entry_price)::INT)::BIGINT AS n_won, round(sum((exit_price > entry_price)::INT) / count(*), 4) AS win_rate,
            round(sum(exit_price - entry_price), 4) AS profit, round(sum(ln(exit_price / entry_price)), 4) AS log_growth FROM done GROUP BY symbol""",
        ),
    }
