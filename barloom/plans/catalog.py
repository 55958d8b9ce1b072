"""Registered queries over the driver's tables, each with the SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import predicates
from barloom.operators import indicators, joins, profile, resample, structure
from barloom.operators.indicators import by_x
from barloom.plans import asof_queries, classic_queries, level_queries, small_queries, strategy_queries
from barloom.plans.basis import DIGITS, EVENTS, HOURLY, ORDERS, bars_sql, hourly, rounded, slot_sql
from barloom.sources.ticks import event_ticks, order_ticks


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event ticks with their five-bar mean."""
    bars = hourly(spark, sf_dir)
    return rounded(bars.withColumn("mean", F.avg("close").over(indicators.trailing(5))), 4)


_BAR = "symbol, slot, ts, open, high, low, close, volume, round(amount, 4) AS amount, n_ticks, x"
_W = "OVER (PARTITION BY symbol ORDER BY x ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _ema_sql(source: str, value: str, name: str, n: int) -> str:
    return f"""{name} AS (SELECT symbol, x, {value} AS y FROM {source} WHERE x = 0 UNION ALL
  SELECT b.symbol, b.x, (2 * b.{value} + {n - 1} * e.y) / {n + 1} FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.x = e.x + 1)"""


_GROUPS = """g AS (SELECT symbol, x, 0 AS seq, high, low, 'up' AS dir, high AS bar_high, low AS bar_low FROM bars WHERE x = 0 UNION ALL
  SELECT b.symbol, b.x, CASE WHEN c.holds AND g.seq > 0 THEN g.seq ELSE g.seq + 1 END,
    CASE WHEN NOT (c.holds AND g.seq > 0) THEN b.high WHEN g.dir = 'up' THEN greatest(g.high, b.high) ELSE least(g.high, b.high) END,
    CASE WHEN NOT (c.holds AND g.seq > 0) THEN b.low WHEN g.dir = 'up' THEN greatest(g.low, b.low) ELSE least(g.low, b.low) END,
    CASE WHEN c.holds AND g.seq > 0 THEN g.dir WHEN NOT c.holds AND g.high > b.high THEN 'down' ELSE 'up' END, b.high, b.low
  FROM g JOIN bars b ON b.symbol = g.symbol AND b.x = g.x + 1,
    LATERAL (SELECT (g.high >= b.high AND g.low <= b.low) OR (g.high <= b.high AND g.low >= b.low) AS holds) c),
groups AS (SELECT symbol, seq, min(x) AS x1, max(x) AS x2, arg_max(high, x) AS high, arg_max(low, x) AS low, any_value(dir) AS dir,
  count(*) AS n_units, arg_min(bar_high, x) AS born_high, arg_min(bar_low, x) AS born_low FROM g GROUP BY symbol, seq)"""
_FRACTALS = """f AS (SELECT symbol, seq, x1, x2, high, low, lead(x1) OVER w AS confirm_x,
  CASE WHEN lag(high) OVER w < high AND lead(born_high) OVER w < high AND lag(low) OVER w < low AND lead(born_low) OVER w < low THEN 'top'
       WHEN lag(high) OVER w > high AND lead(born_high) OVER w > high AND lag(low) OVER w > low AND lead(born_low) OVER w > low THEN 'bottom' END AS fx
  FROM groups WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
fractals AS (SELECT symbol, seq, fx, x1, x2, high, low, confirm_x FROM f WHERE fx IS NOT NULL)"""
_PIVOTS = """t AS (SELECT symbol, least(0.01, min(CASE WHEN high - low > 1e-12 THEN high - low END)) AS tick FROM bars GROUP BY symbol),
p AS (SELECT symbol, x, 0 AS seq, CASE WHEN abs(open - close) <= 1e-12 THEN open ELSE high END AS zg,
    CASE WHEN abs(open - close) <= 1e-12 THEN open ELSE low END AS zd, high, low FROM bars WHERE x = 0 UNION ALL
  SELECT b.symbol, b.x, CASE WHEN c.touches THEN p.seq ELSE p.seq + 1 END,
    CASE WHEN c.touches THEN CASE WHEN abs(p.zg - p.zd) > t.tick + 1e-12 THEN least(p.zg, b.high) ELSE p.zg END
         WHEN abs(b.open - b.close) <= 1e-12 THEN b.open ELSE b.high END,
    CASE WHEN c.touches THEN CASE WHEN abs(p.zg - p.zd) > t.tick + 1e-12 THEN greatest(p.zd, b.low) ELSE p.zd END
         WHEN abs(b.open - b.close) <= 1e-12 THEN b.open ELSE b.low END, b.high, b.low
  FROM p JOIN bars b ON b.symbol = p.symbol AND b.x = p.x + 1 JOIN t ON t.symbol = p.symbol,
    LATERAL (SELECT b.high >= p.zd AND b.low <= p.zg AS touches) c),
pivots AS (SELECT symbol, seq, min(x) AS x1, max(x) AS x2, arg_max(zg, x) AS zg, arg_max(zd, x) AS zd, max(high) AS gg, min(low) AS dd,
  count(*) AS n_members, seq < max(seq) OVER (PARTITION BY symbol) AS is_sure FROM p GROUP BY symbol, seq)"""
_PROFILE = """bins AS (SELECT symbol, CAST(round(price * 10000) AS BIGINT) AS price_key, sum(CASE WHEN side = 'S' THEN qty ELSE 0 END) AS s,
  sum(CASE WHEN side = 'B' THEN qty ELSE 0 END) AS b, sum(CASE WHEN side NOT IN ('S', 'B') THEN qty ELSE 0 END) AS w FROM ticks GROUP BY ALL),
profile AS (SELECT symbol, CAST(floor(price_key / 10000 / 5.0) AS BIGINT) AS bucket, sum(s) AS s, sum(b) AS b, sum(w) AS w,
  sum(s) + sum(b) + sum(w) AS total FROM bins GROUP BY ALL)"""


def _resampled(period: str, ticks: Callable = event_ticks) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(resample.ticks_to_bars(ticks(spark, sf_dir), period), 4)

    return query


def _over_hours(make: Callable[[DataFrame], DataFrame], digits: int = DIGITS) -> Callable:
    return lambda spark, sf_dir: rounded(make(hourly(spark, sf_dir)), digits)


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = event_ticks(spark, sf_dir)
    return joins.parents_of(hourly(spark, sf_dir), resample.ticks_to_bars(ticks, "day"))


def _childless(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = event_ticks(spark, sf_dir)
    return joins.childless(hourly(spark, sf_dir), resample.ticks_to_bars(ticks, "240m")).select("symbol", "x", "ts")


def _steps(bars: DataFrame) -> DataFrame:
    found = structure.fractals(structure.merged_groups(bars)).select("symbol", F.col("confirm_x").alias("x"), F.col("high").alias("last_high"))
    return joins.stepped(bars.select("symbol", "x", "close"), found, "last_high")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(profile.bins(event_ticks(spark, sf_dir), "symbol"), 5.0, "symbol")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.peaks(_profile(spark, sf_dir), "symbol").withColumns({"lo": F.lit(100.0), "hi": F.lit(200.0)})
    return profile.labelled(found, "lo", "hi", "symbol").select("symbol", "bucket", "price", "total", "label")


def _predicates(bars: DataFrame) -> DataFrame:
    high, low = F.col("high"), F.col("low")
    return bars.select(
        "symbol", "x", predicates.direction(high, low, by_x()).alias("dir"), predicates.gap_to_next(high, low, by_x()).alias("gap"),
        F.when(F.col("x") == 0, "first").otherwise(predicates.containment(F.lag("high").over(by_x()), F.lag("low").over(by_x()), high, low)).alias("stands"),
    )


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    points = structure.first_class_points(structure.pivots(bars), bars)
    newest = F.row_number().over(by_x().orderBy(F.desc("x")))
    return points.withColumn("n", newest).where("n <= 10")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.spread(event_ticks(spark, sf_dir)).select("symbol", "seq", "ts")


_MACD = f"""{_ema_sql('bars', 'close', 'fast', 12)}, {_ema_sql('bars', 'close', 'slow', 26)},
difs AS (SELECT symbol, x, f.y - s.y AS dif FROM fast f JOIN slow s USING (symbol, x)), {_ema_sql('difs', 'dif', 'deas', 9)},
macd AS (SELECT symbol, x, dif, y AS dea, 2 * (dif - y) AS hist FROM difs JOIN deas USING (symbol, x))"""
_RSI = """d AS (SELECT symbol, x, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY x), 0) AS d FROM bars),
r AS (SELECT symbol, x, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM d WHERE x = 0 UNION ALL
  SELECT d.symbol, d.x, r.up + (greatest(d.d, 0) - r.up) / least(d.x, 14), r.down + (greatest(-d.d, 0) - r.down) / least(d.x, 14)
  FROM r JOIN d ON d.symbol = r.symbol AND d.x = r.x + 1)"""
_KDJ = """v AS (SELECT symbol, x, CASE WHEN h <> l THEN 100 * (close - l) / (h - l) ELSE 0 END AS rsv FROM (SELECT symbol, x, close,
  max(high) {w} AS h, min(low) {w} AS l FROM bars)),
k AS (SELECT symbol, x, 100.0 / 3 + rsv / 3 AS k, 100.0 / 3 + (100.0 / 3 + rsv / 3) / 3 AS d FROM v WHERE x = 0 UNION ALL
  SELECT v.symbol, v.x, 2 * k.k / 3 + v.rsv / 3, 2 * k.d / 3 + (2 * k.k / 3 + v.rsv / 3) / 3 FROM k JOIN v ON v.symbol = k.symbol AND v.x = k.x + 1)""".format(
    w=_W.format(8)
)
_LABELS = """peaks AS (SELECT * FROM (SELECT *, coalesce(lag(total) OVER w, 0) AS before, coalesce(lead(total) OVER w, 0) AS after FROM profile
  WINDOW w AS (PARTITION BY symbol ORDER BY bucket)) WHERE total > 0 AND total >= before AND total > after),
zones AS (SELECT *, CASE WHEN bucket * 5.0 < 100 THEN -1 WHEN bucket * 5.0 > 200 THEN 1 END AS zone FROM peaks)"""
_POINTS = """side AS (SELECT *, CASE WHEN zg < lag(zd) OVER w THEN 'buy' WHEN zd > lag(zg) OVER w THEN 'sell' END AS side FROM pivots
  WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
member AS (SELECT s.symbol, s.seq, s.side, b.x, CASE WHEN s.side = 'buy' THEN b.low ELSE b.high END AS price, CASE WHEN s.side = 'buy' THEN -b.low ELSE b.high END AS far
  FROM side s JOIN bars b ON b.symbol = s.symbol AND b.x BETWEEN s.x1 AND s.x2 WHERE s.side IS NOT NULL),
points AS (SELECT symbol, seq, side, x, price FROM (SELECT *, max(far) OVER (PARTITION BY symbol, seq ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM member) WHERE best IS NULL OR far > best)"""


def _all() -> dict[str, tuple[Callable, str]]:
    """Name, query and SQL."""
    out: dict[str, tuple[Callable, str]] = {}
    for period in ("1m", "5m", "15m", "60m", "240m", "day", "week"):
        out[f"bars_{period}"] = _resampled(period), f"WITH {bars_sql(EVENTS, period)} SELECT {_BAR} FROM bars"
    for period in ("month", "quarter", "9month", "year", "3year"):
        out[f"order_bars_{period}"] = _resampled(period, order_ticks), f"WITH {bars_sql(ORDERS, period)} SELECT {_BAR} FROM bars"
    w5, w20 = _W.format(4), _W.format(19)
    out |= {
        "bars_with_mean": (flagship, f"WITH {HOURLY} SELECT {_BAR}, round(avg(close) {w5}, 4) AS mean FROM (SELECT *, amount AS amount FROM bars)"),
        "bars_merged_to_day": (
            _over_hours(lambda b: resample.resampled(b, "day"), 4),
            f"""WITH {HOURLY} SELECT symbol, slot, ts, open, high, low, close, volume, round(amount, 4) AS amount, n_ticks,
            row_number() OVER (PARTITION BY symbol ORDER BY slot) - 1 AS x FROM (SELECT symbol, date_trunc('day', ts) AS slot, max(ts) AS ts, arg_min(open, x) AS open,
            max(high) AS high, min(low) AS low, arg_max(close, x) AS close, sum(volume) AS volume, sum(amount) AS amount, sum(n_ticks)::BIGINT AS n_ticks FROM bars GROUP BY ALL
) """,
        ),
        "bars_by_three": (
            _over_hours(lambda b: resample.chunks(b, 3), 4),
            f"""WITH {HOURLY} SELECT symbol, x // 3 AS x, max(ts) AS ts, arg_min(open, x) AS open, max(high) AS high, min(low) AS low, arg_max(close, x) AS close,
            sum(volume) AS volume, round(sum(amount), 4) AS amount, sum(n_ticks)::BIGINT AS n_ticks FROM bars GROUP BY symbol, x // 3""",
        ),
        "bars_into_quantity": (
            _over_hours(lambda b: resample.into_quantity(b, 50).select("symbol", "x", "open", "high", "low", "close", "volume")),
            f"""WITH {HOURLY}, q AS (SELECT *, CASE WHEN n <= 50 THEN x ELSE least(x // greatest(n // 50, 1), 49) END AS place
            FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars))
            SELECT symbol, place AS x, arg_min(open, q.x) AS open, max(high) AS high, min(low) AS low, arg_max(close, q.x) AS close, sum(volume) AS volume FROM q GROUP BY symbol, place""",
        ),
        "bars_growing": (
            _over_hours(lambda b: resample.growing(b, "day")),
            f"""WITH {HOURLY} SELECT symbol, x, date_trunc('day', ts) AS slot, first(open) OVER w AS open, max(high) OVER w AS high, min(low) OVER w AS low, close,
            sum(volume) OVER w AS volume FROM bars WINDOW w AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        ),
        "ticks_spread": (
            _spread,
            f"""WITH {EVENTS} SELECT symbol, seq, date_trunc('minute', ts) + to_milliseconds(CAST((row_number() OVER w - 1) * 60000 // count(*) OVER (PARTITION BY symbol,
            date_trunc('minute', ts)) AS BIGINT)) AS ts FROM ticks WINDOW w AS (PARTITION BY symbol, date_trunc('minute', ts) ORDER BY ts, seq)""",
        ),
        "trend": (
            _over_hours(lambda b: indicators.trend(b, 5)),
            f"WITH {HOURLY} SELECT symbol, x, round(avg(close) {w5}, 6) AS mean, max(close) {w5} AS channel_max, min(close) {w5} AS channel_min FROM bars",
        ),
        "bollinger": (
            _over_hours(indicators.bollinger),
            f"""WITH {HOURLY}, m AS (SELECT symbol, x, avg(close) {w20} AS m, stddev_pop(close) {w20} AS t FROM bars) SELECT symbol, x, round(m, 6) AS boll_mid,
            round(m + 2 * t, 6) AS boll_up, round(CASE WHEN m - 2 * t = 0 THEN 1e-7 ELSE m - 2 * t END, 6) AS boll_down, round(CASE WHEN t = 0 THEN 1e-7 ELSE t END, 6) AS theta FROM m""",
        ),
        "macd": (_over_hours(indicators.macd), f"WITH RECURSIVE {HOURLY}, {_MACD} SELECT symbol, x, round(dif, 6) AS dif, round(dea, 6) AS dea, round(hist, 6) AS hist FROM macd"),
        "macd_crossings": (
            lambda s, d: indicators.crossings(indicators.macd(hourly(s, d)), "dif", "dea").select("symbol", "x", "cross"),
            f"""WITH RECURSIVE {HOURLY}, {_MACD}, c AS (SELECT symbol, x, dif - dea AS now, lag(dif - dea) OVER (PARTITION BY symbol ORDER BY x) AS before FROM macd)
            SELECT symbol, x, CASE WHEN before <= 0 AND now > 0 THEN 'golden' ELSE 'death' END AS "cross" FROM c WHERE (before <= 0 AND now > 0) OR (before >= 0 AND now < 0)""",
        ),
        "indicator_signals": (
            _signals,
            f"""WITH RECURSIVE {HOURLY}, {_MACD}, {_RSI}, m AS (SELECT symbol, x, avg(close) {w20} AS m, stddev_pop(close) {w20} AS t FROM bars),
            i AS (SELECT b.symbol, b.x, b.close, c.dif, c.dea, CASE WHEN r.x = 0 THEN 50 WHEN down = 0 THEN CASE WHEN up > 0 THEN 100 ELSE 0 END ELSE 100 - 100 / (1 + up / down) END AS rsi, m + 2 * t AS band_up,
              CASE WHEN m - 2 * t = 0 THEN 1e-7 ELSE m - 2 * t END AS band_down FROM bars b JOIN macd c ON c.symbol = b.symbol AND c.x = b.x JOIN r ON r.symbol = b.symbol AND r.x = b.x JOIN m ON m.symbol = b.symbol AND m.x = b.x),
            l AS (SELECT *, lag(dif - dea) OVER w AS d0, lag(dif) OVER w AS z0, lag(rsi) OVER w AS r0 FROM i WINDOW w AS (PARTITION BY symbol ORDER BY x))
            SELECT symbol, x, unnest(list_filter([CASE WHEN d0 <= 0 AND dif > dea THEN 'golden' END, CASE WHEN d0 >= 0 AND dif < dea THEN 'death' END, CASE WHEN z0 <= 0 AND dif > 0 THEN 'above_zero' END,
              CASE WHEN z0 >= 0 AND dif < 0 THEN 'below_zero' END, CASE WHEN r0 <= 70 AND rsi > 70 THEN 'overbought' END, CASE WHEN r0 >= 30 AND rsi < 30 THEN 'oversold' END, CASE WHEN close >= band_up THEN 'touch_up' END,
              CASE WHEN close <= band_down THEN 'touch_down' END], lambda s: s IS NOT NULL)) AS signal FROM l""",
        ),
        "rsi": (
            _over_hours(indicators.rsi),
            f"""WITH RECURSIVE {HOURLY}, {_RSI} SELECT symbol, x, round(CASE WHEN x = 0 THEN 50 WHEN down = 0 THEN CASE WHEN up > 0 THEN 100 ELSE 0 END
            ELSE 100 - 100 / (1 + up / down) END, 6)::DOUBLE AS rsi FROM r""",
        ),
        "kdj": (_over_hours(indicators.kdj), f"WITH RECURSIVE {HOURLY}, {_KDJ} SELECT symbol, x, round(k, 6) AS k, round(d, 6) AS d, round(3 * k - 2 * d, 6) AS j FROM k"),
        "bar_predicates": (
            _over_hours(_predicates),
            f"""WITH {HOURLY} SELECT symbol, x, CASE WHEN (high + low) / 2 < lag((high + low) / 2) OVER w THEN -1 ELSE 1 END AS dir,
            coalesce(lead(low) OVER w > high OR lead(high) OVER w < low, false) AS gap, CASE WHEN x = 0 THEN 'first'
            WHEN lag(high) OVER w > high AND lag(low) OVER w > low THEN 'down' WHEN lag(high) OVER w < high AND lag(low) OVER w < low THEN 'up' ELSE 'combine' END AS stands
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY x)""",
        ),
        "bar_parents": (
            _parents,
            f"""WITH {HOURLY}, days AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 15 HOUR AS ts, row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('day', ts)) - 1 AS x
            FROM (SELECT DISTINCT symbol, date_trunc('day', ts) AS ts FROM ticks))
            SELECT b.symbol, b.x, b.ts, (SELECT min(d.x) FROM days d WHERE d.symbol = b.symbol AND d.ts >= b.ts) AS parent_x FROM bars b""",
        ),
        "bars_childless": (
            _childless,
            f"""WITH {HOURLY}, q AS (SELECT symbol, max(ts) AS ts FROM (SELECT symbol, ts, {slot_sql('240m')} AS slot FROM ticks) GROUP BY symbol, slot),
            used AS (SELECT DISTINCT q.symbol, (SELECT min(b.x) FROM bars b WHERE b.symbol = q.symbol AND b.ts >= q.ts) AS x FROM q)
            SELECT symbol, x, ts FROM bars b WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.symbol = b.symbol AND u.x = b.x)""",
        ),
        "stepped_highs": (
            _over_hours(_steps),
            f"""WITH RECURSIVE {HOURLY}, {_GROUPS}, {_FRACTALS} SELECT b.symbol, b.x, b.close, (SELECT arg_max(f.high, f.confirm_x) FROM fractals f
            WHERE f.symbol = b.symbol AND f.confirm_x <= b.x) AS last_high FROM bars b""",
        ),
        "volume_profile": (lambda s, d: rounded(_profile(s, d)), f"WITH {EVENTS}, {_PROFILE} SELECT symbol, bucket, s, b, w, bucket * 5.0::DOUBLE AS price, total FROM profile"),
        "profile_labels": (
            lambda s, d: rounded(_labels(s, d)),
            f"""WITH {EVENTS}, {_PROFILE}, {_LABELS} SELECT symbol, bucket, bucket * 5.0::DOUBLE AS price, total,
            (zone * row_number() OVER (PARTITION BY symbol, zone ORDER BY zone * bucket))::INTEGER AS label FROM zones WHERE zone IS NOT NULL""",
        ),
        "triangle_profile": (
            lambda s, d: rounded(profile.triangle(hourly(s, d), 1.0).groupBy("symbol", "bucket").agg(F.sum("b").alias("b"))),
            f"""WITH {HOURLY}, e AS (SELECT symbol, x, low AS lo, high AS hi, close AS mode, volume, unnest(range(CAST(floor(low) AS BIGINT), CASE WHEN high - low < 1e-12
            THEN CAST(floor(low) AS BIGINT) ELSE CAST(ceil(high) AS BIGINT) END + 1)) AS bucket FROM bars WHERE volume > 0),
            v AS (SELECT *, greatest(0, CASE WHEN hi - lo < 1e-12 THEN 1 WHEN mode - lo < 1e-12 THEN (hi - bucket) / (hi - lo) WHEN hi - mode < 1e-12 THEN (bucket - lo) / (hi - lo)
            WHEN bucket <= mode THEN (bucket - lo) / (mode - lo) ELSE (hi - bucket) / (hi - mode) END) AS weight FROM e),
            u AS (SELECT *, sum(weight) OVER (PARTITION BY symbol, x) AS whole FROM v)
            SELECT symbol, bucket, round(sum(weight / whole * volume), 6) AS b FROM u WHERE weight > 0 AND whole > 1e-12 GROUP BY symbol, bucket""",
        ),
        "merged_groups": (
            _over_hours(lambda b: structure.merged_groups(b).drop("closed")),
            f"WITH RECURSIVE {HOURLY}, {_GROUPS} SELECT symbol, seq::BIGINT AS seq, x1, x2, high, low, dir, n_units, born_high, born_low FROM groups",
        ),
        "fractals": (
            _over_hours(lambda b: structure.fractals(structure.merged_groups(b))),
            f"WITH RECURSIVE {HOURLY}, {_GROUPS}, {_FRACTALS} SELECT symbol, seq::BIGINT AS seq, fx, x1, x2, high, low, confirm_x FROM fractals",
        ),
        "pivots": (_over_hours(structure.pivots), f"WITH RECURSIVE {HOURLY}, {_PIVOTS} SELECT symbol, seq::BIGINT AS seq, x1, x2, zg, zd, gg, dd, n_members, is_sure FROM pivots"),
        "first_class_points": (
            _over_hours(lambda b: structure.first_class_points(structure.pivots(b), b)),
            f"WITH RECURSIVE {HOURLY}, {_PIVOTS}, {_POINTS} SELECT symbol, seq::BIGINT AS seq, side, x, price FROM points",
        ),
        "latest_points": (
            _latest,
            f"""WITH RECURSIVE {HOURLY}, {_PIVOTS}, {_POINTS} SELECT symbol, seq::BIGINT AS seq, side, x, price, n FROM
            (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY x DESC)::INTEGER AS n FROM points) WHERE n <= 10""",
        ),
    }
    return out | level_queries.entries() | small_queries.entries(_PIVOTS, _GROUPS) | classic_queries.entries() | strategy_queries.entries() | asof_queries.entries()


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    rows = bars.select("symbol", "x", "close")
    for one in (indicators.macd(bars), indicators.rsi(bars), indicators.bollinger(bars)):
        rows = rows.join(one, ["symbol", "x"])
    return indicators.signals(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
