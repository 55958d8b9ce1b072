"""Queries of joins along time, profiles, lines, rays, logs and selections, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import predicates
from barloom.operators import indicators, joins, levels, lines, profile, records, resample, structure
from barloom.operators.indicators import by_x
from barloom.plans.basis import EVENTS, HOURLY, bars_sql, hourly, rounded, slot_sql
from barloom.plans.level_queries import BAR_UNITS, level_sql
from barloom.sources import bars as bar_files
from barloom.sources.ticks import event_ticks

LINES = f"WITH RECURSIVE {HOURLY}, {BAR_UNITS}, {level_sql(0)}"
DAYS = """days AS (SELECT symbol, d + INTERVAL 15 HOUR AS ts, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS x FROM
  (SELECT DISTINCT symbol, date_trunc('day', ts) AS d FROM ticks))"""
PARENTS = "parents AS (SELECT b.symbol, b.x, b.ts, (SELECT min(d.x) FROM days d WHERE d.symbol = b.symbol AND d.ts >= b.ts) AS parent_x FROM bars b)"
TRADES = """trades AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS qty,
  CASE user_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'S' ELSE '' END AS side, CAST(event_id % 4 AS DOUBLE) AS trades FROM events)"""
BINS = """binned AS (SELECT symbol, date_trunc('hour', ts) AS slot, CAST(round(price * 10000) AS BIGINT) / 10000 AS price, sum(CASE WHEN side = 'S' THEN {q} ELSE 0 END) AS s,
  sum(CASE WHEN side = 'B' THEN {q} ELSE 0 END) AS b, sum(CASE WHEN side NOT IN ('B', 'S') THEN {q} ELSE 0 END) AS w FROM trades WHERE price > 0 AND qty > 0 {more} GROUP BY ALL)"""
TRIANGLE = """tri AS (SELECT symbol, x, lo, hi, mode, volume, unnest(range(CAST(floor(lo / {step}) AS BIGINT), CASE WHEN hi - lo < 1e-12 THEN CAST(floor(lo / {step}) AS BIGINT)
    ELSE CAST(ceil(hi / {step}) AS BIGINT) END + 1)) AS bucket FROM (SELECT symbol, x, low AS lo, high AS hi, close AS mode, volume FROM bars WHERE volume > 0)),
weights AS (SELECT *, greatest(0, CASE WHEN hi - lo < 1e-12 THEN 1 WHEN mode - lo < 1e-12 THEN (hi - bucket * {step}) / (hi - lo) WHEN hi - mode < 1e-12 THEN (bucket * {step} - lo) / (hi - lo)
    WHEN bucket * {step} <= mode THEN (bucket * {step} - lo) / (mode - lo) ELSE (hi - bucket * {step}) / (hi - mode) END) AS weight FROM tri),
shares AS (SELECT *, sum(weight) OVER (PARTITION BY symbol, x) AS whole FROM weights),
spread AS (SELECT symbol, x, bucket, weight / whole * volume AS b FROM shares WHERE weight > 0 AND whole > 1e-12)"""
POLES = """poles AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY confirm_x, uid) - 1 AS n, fx, pole_x AS x, CASE WHEN fx = 'top' THEN fx_high ELSE fx_low END AS price, confirm_x FROM c0)"""


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ticks(spark, sf_dir).withColumn("trades", (F.col("seq") % 4).cast("double"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ticks_to_bars(event_ticks(spark, sf_dir), "day")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.levels(hourly(spark, sf_dir), 1)[0][1]


def _confirms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.confirms(levels.bar_units(hourly(spark, sf_dir)))


def _two_levels(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [made for _, made in levels.levels(hourly(spark, sf_dir), 2)]


def _with_bins(spark: SparkSession, sf_dir: str, quantity: str = "qty") -> DataFrame:
    """Hourly bars, every third of them with bins."""
    ticks = _ticks(spark, sf_dir).withColumn("slot", F.date_trunc("hour", "ts"))
    if quantity == "trades":
        ticks = ticks.where("price > 0 AND qty > 0 AND trades > 0").withColumn("qty", F.col("trades"))
    found = profile.with_bins(hourly(spark, sf_dir), ticks)
    return found.withColumn("bins", F.when(F.col("x") % 3 == 0, F.col("bins")))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = resample.trade_counts(_ticks(spark, sf_dir), "60m")
    return _with_bins(spark, sf_dir, "trades").join(counts, ["symbol", "slot"], "left").na.fill(0.0, ["trades", "bought", "sold"])


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _with_bins(spark, sf_dir).withColumns(
        {"side": F.when(F.col("x") % 3 == 1, "B").when(F.col("x") % 7 == 2, "S"), "trades": F.when(F.col("x") % 2 == 0, (F.col("x") % 5).cast("double"))}
    )
    return rounded(profile.volume_by_side(bars))


def _within(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = event_ticks(spark, sf_dir).select("symbol", "ts", F.col("seq").alias("x"))
    return joins.within_bars(ticks, _days(spark, sf_dir)).select("symbol", F.col("x").alias("seq"), "parent_x")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    fresh = bars.where("x >= 40").withColumns({"x": F.col("x") - 40, "close": F.when(F.col("x") >= 60, F.col("close") + 1).otherwise(F.col("close"))})
    return joins.aligned(bars, fresh)


def _remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    spans = bars.where("x % 50 = 0").select("symbol", (F.col("x") / 50).cast("long").alias("id"), F.col("x").alias("x1"), (F.col("x") + 30).alias("x2"))
    return joins.most_overlapping(structure.pivots(bars), spans, bars)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, found = hourly(spark, sf_dir), levels.levels(hourly(spark, sf_dir), 1)[0]
    rows = found[1].withColumn("is_open", F.lit(False))
    return lines.gated_volume(rows.unionByName(levels.running_line(found[0], bars).withColumn("is_open", F.lit(True))), bars)


def _rays(kind: Callable) -> Callable:
    return lambda s, d: rounded(kind(lines.poles(_confirms(s, d))))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    focus = hourly(spark, sf_dir).groupBy("symbol").agg(F.floor(F.max("x") / 2).alias("focus_x"))
    return rounded(lines.nearest_rays(lines.pair_rays(lines.poles(_confirms(spark, sf_dir))), focus))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = structure.first_class_points(structure.pivots(hourly(spark, sf_dir)), hourly(spark, sf_dir)).select("symbol", "seq", "x")
    return records.appended(points.where("x < 300 AND x % 2 = 0").select("symbol", "seq", "x").dropDuplicates(["symbol", "seq"]).select("symbol", "seq", F.lit(0).cast("long").alias("x")), points, ["symbol", "seq"], "x")


_POINTS_SQL = """side AS (SELECT *, CASE WHEN zg < lag(zd) OVER w THEN 'buy' WHEN zd > lag(zg) OVER w THEN 'sell' END AS side FROM pivots WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
member AS (SELECT s.symbol, s.seq, s.side, b.x, b.ts, CASE WHEN s.side = 'buy' THEN b.low ELSE b.high END AS price, CASE WHEN s.side = 'buy' THEN -b.low ELSE b.high END AS far
  FROM side s JOIN bars b ON b.symbol = s.symbol AND b.x BETWEEN s.x1 AND s.x2 WHERE s.side IS NOT NULL),
points AS (SELECT symbol, seq::BIGINT AS seq, side, x, ts, price FROM (SELECT *, max(far) OVER (PARTITION BY symbol, seq ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM member) WHERE best IS NULL OR far > best)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    return structure.first_class_points(structure.pivots(bars), bars)


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    code = F.lpad((F.col("s_suppkey") * 7919 % 1000000).cast("string"), 6, "0")
    rows = codes.select(code.alias("code"), F.concat(F.when(F.col("s_suppkey") % 5 == 0, "*st ").otherwise(""), F.col("s_name")).alias("name"), (F.col("s_suppkey") % 9).cast("double").alias("volume"), F.lit(1.5).alias("price"))
    return rows.where(predicates.tradable(F.col("code"), F.col("name"), F.col("volume"), F.col("price"))).select("code", "name")


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    broken = bars.withColumns({"high": F.when(F.col("x") % 4 == 1, F.col("low")).otherwise(F.col("high")), "low": F.when(F.col("x") % 4 == 2, F.col("high")).otherwise(F.col("low"))})
    return bar_files.repaired(broken.withColumn("sound", bar_files.is_sound())).select("symbol", "x", "low", "high", "sound")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("low"), F.col("high")
    before = F.lag("low").over(by_x()), F.lag("high").over(by_x())
    return hourly(spark, sf_dir).select("symbol", "x", predicates.overlap(*before, low, high).alias("strictly"), predicates.overlap(*before, low, high, touching=True).alias("touching")).where("x > 0")


def entries(pivots_sql: str, groups_sql: str) -> dict[str, tuple[Callable, str]]:
    of_pivots = f"WITH RECURSIVE {HOURLY}, {pivots_sql}"
    times = "times AS (SELECT symbol, ts FROM bars WHERE x % 40 = 0)"
    five = """five AS (SELECT symbol, ts, seq FROM ticks)"""
    measure = """m AS (SELECT *, (end_price + begin_price) / 2 AS middle, abs(end_price - begin_price) AS amplitude, end_x - begin_x + 1 AS n_bars,
      CASE WHEN end_x - begin_x >= 1 THEN (end_price - begin_price) / (end_x - begin_x) END AS slope, (end_price - begin_price) / nullif(begin_price, 0) AS share FROM l0)"""
    pairs = """w AS (SELECT symbol, n, [fx, lead(fx) OVER o, lead(fx, 2) OVER o, lead(fx, 3) OVER o] AS f, [x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o] AS xs,
      [price, lead(price) OVER o, lead(price, 2) OVER o, lead(price, 3) OVER o] AS ps, [confirm_x, lead(confirm_x) OVER o, lead(confirm_x, 2) OVER o, lead(confirm_x, 3) OVER o] AS cs
      FROM poles WINDOW o AS (PARTITION BY symbol ORDER BY n)),
    e AS (SELECT symbol, n, unnest([1, 2, 3, 4]) AS k, f, xs, ps, cs FROM w WHERE xs[4] IS NOT NULL),
    g AS (SELECT symbol, n, f[k] AS fx, count(*) AS c, min(xs[k]) AS xa, max(xs[k]) AS xb, arg_min(ps[k], xs[k]) AS pa, arg_max(ps[k], xs[k]) AS pb, any_value(list_min(xs)) AS low_x,
      any_value(list_max(xs)) AS high_x, any_value(list_max(cs)) AS known_x FROM e GROUP BY symbol, n, f[k]),
    rays AS (SELECT symbol, n, low_x, high_x, known_x, fx || '_pair' AS kind, xb AS x0, pb AS y0, (pb - pa) / (xb - xa) AS slope FROM g WHERE c = 2 AND xb > xa)"""
    triples = """w AS (SELECT symbol, n, [fx, lead(fx) OVER o, lead(fx, 2) OVER o] AS f, [x, lead(x) OVER o, lead(x, 2) OVER o] AS xs, [price, lead(price) OVER o, lead(price, 2) OVER o] AS ps,
      [confirm_x, lead(confirm_x) OVER o, lead(confirm_x, 2) OVER o] AS cs FROM poles WINDOW o AS (PARTITION BY symbol ORDER BY n)),
    e AS (SELECT symbol, n, unnest([1, 2, 3]) AS k, f, xs, ps, cs FROM w WHERE xs[3] IS NOT NULL),
    g AS (SELECT symbol, n, f[k] AS fx, count(*) AS c, min(xs[k]) AS xa, max(xs[k]) AS xb, arg_min(ps[k], xs[k]) AS pa, arg_max(ps[k], xs[k]) AS pb, any_value(list_min(xs)) AS low_x,
      any_value(list_max(xs)) AS high_x, any_value(list_max(cs)) AS known_x FROM e GROUP BY symbol, n, f[k])"""
    return {
        "bars_in_range": (
            lambda s, d: resample.in_range(hourly(s, d), "20240105", "2024-01-20").select("symbol", "x", "ts", "close"),
            f"WITH {HOURLY} SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x, ts, close FROM bars WHERE ts >= '2024-01-05 00:00:00' AND ts <= '2024-01-20 23:59:59'",
        ),
        "bars_repaired": (
            _repaired,
            f"""WITH {HOURLY}, k AS (SELECT symbol, x, open, close, CASE WHEN x % 4 = 1 THEN low ELSE high END AS h, CASE WHEN x % 4 = 2 THEN CASE WHEN x % 4 = 1 THEN low ELSE high END ELSE low END AS l FROM bars)
            SELECT symbol, x, least(open, h, l, close) AS low, greatest(open, h, l, close) AS high, l <= least(open, h, l, close) AND h >= greatest(open, h, l, close) AS sound FROM k""",
        ),
        "bar_overlaps": (
            _overlaps,
            f"""WITH {HOURLY} SELECT symbol, x, high > lag(low) OVER w AND lag(high) OVER w > low AS strictly, high >= lag(low) OVER w AND lag(high) OVER w >= low AS touching
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY x) QUALIFY x > 0""",
        ),
        "tradable_shares": (
            _shares,
            """SELECT code, name FROM (SELECT lpad(CAST(s_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code, CASE WHEN s_suppkey % 5 = 0 THEN '*st ' ELSE '' END || s_name AS name, s_suppkey % 9 AS volume FROM supplier)
            WHERE NOT regexp_matches(code, '^(688|8|43|920|200|900)') AND upper(name) NOT LIKE '%ST%' AND volume > 0""",
        ),
        "recent_points": (
            lambda s, d: records.recent(_points(s, d).join(hourly(s, d).select("symbol", "x", "ts"), ["symbol", "x"]), hourly(s, d)).select("symbol", "seq", "side", "x", "ts"),
            f"""{of_pivots}, {_POINTS_SQL} SELECT p.symbol, p.seq, p.side, p.x, p.ts FROM points p JOIN (SELECT symbol, max(ts) AS last FROM bars GROUP BY symbol) l USING (symbol),
            (SELECT max(ts) AS newest FROM bars) n WHERE date_diff('day', l.last, n.newest) <= 15 AND date_diff('day', p.ts, l.last) <= 3""",
        ),
        "bars_sharing_times": (
            lambda s, d: joins.shares_time(_days(s, d), hourly(s, d), hourly(s, d).where("x % 40 = 0")).select("symbol", "x"),
            f"WITH {HOURLY}, {DAYS}, {PARENTS}, {times} SELECT DISTINCT symbol, x FROM (SELECT p.symbol, p.parent_x AS x FROM parents p JOIN times USING (symbol, ts) WHERE p.parent_x IS NOT NULL UNION SELECT d.symbol, d.x FROM days d JOIN times USING (symbol, ts))",
        ),
        "other_days": (
            lambda s, d: joins.other_days(hourly(s, d), _days(s, d)),
            f"WITH {HOURLY}, {DAYS}, {PARENTS} SELECT p.symbol, d.x, count(*) AS n FROM parents p JOIN days d ON d.symbol = p.symbol AND d.x = p.parent_x WHERE p.ts::DATE <> d.ts::DATE GROUP BY p.symbol, d.x",
        ),
        "ticks_within_bars": (
            _within,
            f"WITH {EVENTS}, {DAYS} SELECT t.symbol, t.seq, coalesce((SELECT min(d.x) FROM days d WHERE d.symbol = t.symbol AND d.ts >= t.ts), (SELECT max(d.x) FROM days d WHERE d.symbol = t.symbol)) AS parent_x FROM ticks t",
        ),
        "ticks_by_ordinal": (
            lambda s, d: joins.by_ordinal(event_ticks(s, d), hourly(s, d)),
            f"WITH {HOURLY}, o AS (SELECT symbol, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS x FROM ticks) SELECT symbol, x, seq, price, close FROM o JOIN bars USING (symbol, x)",
        ),
        "coarse_spans": (
            lambda s, d: joins.spans_of(_days(s, d), hourly(s, d)),
            f"""WITH {HOURLY}, {DAYS}, {PARENTS}, g AS (SELECT symbol, parent_x, min(x) AS a, max(x) AS b FROM parents GROUP BY symbol, parent_x),
            m AS (SELECT d.symbol, d.x AS coarse_x, coalesce(a, 0) AS first_x, coalesce(b, 0) AS last_x, (coalesce(a, 0) + coalesce(b, 0)) / 2 AS middle FROM days d LEFT JOIN g ON g.symbol = d.symbol AND g.parent_x = d.x)
            SELECT *, middle + (coalesce(lead(middle) OVER (PARTITION BY symbol ORDER BY coarse_x), middle) - middle) / 2 AS halfway FROM m""",
        ),
        "since_pole": (
            lambda s, d: joins.since_pole(hourly(s, d), _confirms(s, d)),
            f"{LINES} SELECT b.symbol, b.x, coalesce(b.x - (SELECT arg_max(pole_x, confirm_x) FROM (SELECT confirm_x, max(pole_x) AS pole_x FROM c0 c WHERE c.symbol = b.symbol AND c.confirm_x <= b.x GROUP BY confirm_x)), 0) AS since FROM bars b",
        ),
        "bars_in_pivots": (
            lambda s, d: joins.inside(structure.pivots(hourly(s, d)).select("symbol", "seq", "x1", "x2"), hourly(s, d)).select("symbol", "seq", "x"),
            f"{of_pivots} SELECT b.symbol, p.seq::BIGINT AS seq, b.x FROM bars b JOIN pivots p ON p.symbol = b.symbol AND b.x BETWEEN p.x1 AND p.x2",
        ),
        "most_overlapping": (
            _remembered,
            f"""{of_pivots}, r AS (SELECT symbol, x // 50 AS id, x AS x1, x + 30 AS x2 FROM bars WHERE x % 50 = 0), last AS (SELECT symbol, max(x) AS m FROM bars GROUP BY symbol),
            o AS (SELECT p.symbol, r.id, p.seq, least(p.x2, r.x2, m) - greatest(p.x1, r.x1) AS shared FROM pivots p JOIN r ON r.symbol = p.symbol JOIN last ON last.symbol = p.symbol)
            SELECT symbol, id, arg_max(seq, (shared, -seq))::BIGINT AS seq, max(shared) AS shared FROM o WHERE shared > 0 GROUP BY symbol, id""",
        ),
        "groups_of_parents": (
            lambda s, d: joins.groups_of_parents(hourly(s, d), _days(s, d), structure.merged_groups(hourly(s, d))),
            f"""WITH RECURSIVE {HOURLY}, {groups_sql}, {DAYS}, {PARENTS}, j AS (SELECT p.symbol, p.parent_x, g.seq, p.x, lag(g.seq) OVER (PARTITION BY p.symbol, p.parent_x ORDER BY p.x) AS before
            FROM parents p JOIN groups g ON g.symbol = p.symbol AND p.x BETWEEN g.x1 AND g.x2 WHERE p.parent_x IS NOT NULL) SELECT symbol, parent_x, seq::BIGINT AS seq, x FROM j WHERE before IS NULL OR before <> seq""",
        ),
        "bars_aligned": (
            _aligned,
            f"""WITH {HOURLY}, k AS (SELECT symbol, x, (round(open, 6), round(high, 6), round(low, 6), round(close, 6), round(volume, 4)) AS key FROM bars),
            n AS (SELECT symbol, x - 40 AS x, (round(open, 6), round(high, 6), round(low, 6), round(CASE WHEN x >= 60 THEN close + 1 ELSE close END, 6), round(volume, 4)) AS key FROM bars WHERE x >= 40),
            p AS (SELECT k.symbol, k.x AS place FROM k JOIN n ON n.symbol = k.symbol AND n.x = 0 AND n.key = k.key),
            r AS (SELECT p.symbol, p.place, coalesce(min(n.x) FILTER (k.key IS NULL OR k.key <> n.key), max(n.x) + 1) AS run FROM p JOIN n ON n.symbol = p.symbol LEFT JOIN k ON k.symbol = p.symbol AND k.x = p.place + n.x GROUP BY p.symbol, p.place)
            SELECT symbol, arg_max(place, (run, -place)) AS place, max(run) AS run FROM r GROUP BY symbol""",
        ),
        "children_within": (
            lambda s, d: joins.children_within(*_two_levels(s, d)[::-1]),
            f"{LINES}, {level_sql(1)} SELECT p.symbol, p.idx, c.idx AS child FROM l1 p JOIN l0 c ON c.symbol = p.symbol AND c.begin_x >= p.begin_x AND c.end_x <= p.end_x",
        ),
        "one_price_bars": (
            lambda s, d: resample.one_price_bars(event_ticks(s, d)),
            f"WITH {EVENTS} SELECT symbol, ts, seq, price AS open, price AS high, price AS low, price AS close, qty AS volume, side, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS x FROM ticks",
        ),
        "ticks_sided": (
            lambda s, d: rounded(resample.sided(event_ticks(s, d)).drop("day")),
            f"""WITH {EVENTS}, n AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, seq) AS n FROM ticks),
            t AS (SELECT *, greatest(min(n) FILTER (side <> '') OVER w, least(max(n) FILTER (side <> '') OVER w, n)) AS "to" FROM n WINDOW w AS (PARTITION BY symbol, day)),
            f AS (SELECT * FROM t WHERE (symbol, day) IN (SELECT (symbol, day) FROM n WHERE side <> ''))
            SELECT symbol, max(ts) FILTER (n = "to") AS ts, max(seq) FILTER (n = "to") AS seq, max(price) FILTER (n = "to") AS price, sum(qty) AS qty,
            max(CASE WHEN side = '' THEN 'B' ELSE side END) FILTER (n = "to") AS side, min(price) AS low, max(price) AS high FROM f GROUP BY symbol, day, "to" """,
        ),
        "trade_counts": (
            lambda s, d: resample.trade_counts(_ticks(s, d), "60m"),
            f"""WITH {TRADES} SELECT symbol, date_trunc('hour', ts) AS slot, sum(trades) AS trades, sum(CASE WHEN side = 'B' THEN trades ELSE 0 END) AS bought,
            sum(CASE WHEN side = 'S' THEN trades ELSE 0 END) AS sold FROM trades WHERE price > 0 AND qty > 0 GROUP BY ALL""",
        ),
        "bars_with_bins": (
            lambda s, d: _with_bins(s, d).select("symbol", "x", F.explode("bins").alias("p")).select("symbol", "x", "p.*"),
            f"WITH {HOURLY}, {TRADES}, {BINS.format(q='qty', more='')} SELECT symbol, x, price, s, b, w FROM bars JOIN binned USING (symbol, slot) WHERE x % 3 = 0",
        ),
        "profile_to": (
            lambda s, d: rounded(profile.profile_to(_with_bins(s, d), 300, 2.0)),
            f"""WITH {HOURLY}, {TRADES}, {BINS.format(q='qty', more='')}, {TRIANGLE.format(step='2.0')}, parts AS (
            SELECT symbol, CAST(floor(price / 2.0) AS BIGINT) AS bucket, s, b, w FROM bars JOIN binned USING (symbol, slot) WHERE x % 3 = 0 AND x <= 300
            UNION ALL SELECT symbol, CAST(floor(close / 2.0) AS BIGINT), 0, volume, 0 FROM bars WHERE x % 3 <> 0 AND x <= 300 AND high - low < 1e-12 AND volume > 0
            UNION ALL SELECT s.symbol, s.bucket, 0, s.b, 0 FROM spread s JOIN bars USING (symbol, x) WHERE x % 3 <> 0 AND x <= 300 AND high - low >= 1e-12)
            SELECT symbol, bucket, round(sum(s), 6) AS s, round(sum(b), 6) AS b, round(sum(w), 6) AS w, round(sum(s) + sum(b) + sum(w), 6) AS total FROM parts GROUP BY ALL HAVING sum(s) + sum(b) + sum(w) > 0""",
        ),
        "trade_count_profile": (
            lambda s, d: rounded(profile.counts_to(_counted(s, d), 300, 2.0)),
            f"""WITH {HOURLY}, {TRADES}, {BINS.format(q='trades', more='AND trades > 0')}, c AS (SELECT symbol, date_trunc('hour', ts) AS slot, sum(trades) AS t, sum(CASE WHEN side = 'B' THEN trades ELSE 0 END) AS bo,
            sum(CASE WHEN side = 'S' THEN trades ELSE 0 END) AS so FROM trades WHERE price > 0 AND qty > 0 GROUP BY ALL),
            parts AS (SELECT k.symbol, CAST(floor(coalesce(n.price, k.close) / 2.0) AS BIGINT) AS bucket, CASE WHEN n.price IS NULL THEN so ELSE n.s END AS s, CASE WHEN n.price IS NULL THEN bo ELSE n.b END AS b,
            CASE WHEN n.price IS NULL THEN greatest(t - bo - so, 0) ELSE n.w END AS w FROM bars k LEFT JOIN binned n ON n.symbol = k.symbol AND n.slot = k.slot AND k.x % 3 = 0
            LEFT JOIN c ON c.symbol = k.symbol AND c.slot = k.slot WHERE k.x <= 300 AND (n.price IS NOT NULL OR t > 0))
            SELECT symbol, bucket, sum(s) AS s, sum(b) AS b, sum(w) AS w, sum(s) + sum(b) + sum(w) AS total FROM parts GROUP BY ALL HAVING sum(s) + sum(b) + sum(w) > 0""",
        ),
        "profiles_merged": (
            lambda s, d: rounded(profile.merged_profiles(*(profile.profile(profile.bins(event_ticks(s, d).where(f"seq % 2 = {k}"), "symbol"), 5.0, "symbol") for k in (0, 1)))),
            f"""WITH {EVENTS}, k AS (SELECT symbol, CAST(floor(CAST(round(price * 10000) AS BIGINT) / 10000 / 5.0) AS BIGINT) AS bucket, side, qty FROM ticks) SELECT symbol, bucket, sum(CASE WHEN side = 'S' THEN qty ELSE 0 END) AS s,
            sum(CASE WHEN side = 'B' THEN qty ELSE 0 END) AS b, sum(CASE WHEN side NOT IN ('S', 'B') THEN qty ELSE 0 END) AS w FROM k GROUP BY ALL""",
        ),
        "volume_by_side": (
            _sides,
            f"""WITH {HOURLY}, {TRADES}, {BINS.format(q='qty', more='')}, g AS (SELECT symbol, slot, sum(s) AS s, sum(b) AS b, sum(w) AS w, count(*) AS n FROM binned GROUP BY symbol, slot),
            j AS (SELECT b.symbol, b.x, b.volume, CASE WHEN b.x % 3 = 0 THEN g.s END AS s, CASE WHEN b.x % 3 = 0 THEN g.b END AS bb, CASE WHEN b.x % 3 = 0 THEN g.w END AS w, CASE WHEN b.x % 3 = 0 THEN g.n END AS n,
              CASE WHEN b.x % 3 = 1 THEN 'B' WHEN b.x % 7 = 2 THEN 'S' END AS side, CASE WHEN b.x % 2 = 0 THEN CAST(b.x % 5 AS DOUBLE) END AS t FROM bars b LEFT JOIN g USING (symbol, slot))
            SELECT symbol, x, round(CASE WHEN s + bb + w > 0 THEN volume * bb / (s + bb + w) WHEN side = 'B' THEN volume ELSE 0 END, 6) AS bought,
            round(CASE WHEN s + bb + w > 0 THEN volume * s / (s + bb + w) WHEN side = 'S' THEN volume ELSE 0 END, 6) AS sold,
            round(CASE WHEN s + bb + w > 0 THEN volume * w / (s + bb + w) WHEN side IS NULL THEN volume ELSE 0 END, 6) AS neither,
            coalesce(t, CASE WHEN n > 0 THEN 3.0 * n END, CASE WHEN side IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS trades FROM j""",
        ),
        "gated_volume": (
            lambda s, d: rounded(_units(s, d)),
            f"""{LINES}, last AS (SELECT symbol, max(x) AS m FROM bars GROUP BY symbol), a AS (SELECT symbol, max(idx) + 1 AS idx, arg_max(end_x, idx) AS begin_x FROM l0 GROUP BY symbol),
            q AS (SELECT symbol, idx, begin_x, end_x, confirm_x, false AS is_open FROM l0 UNION ALL SELECT a.symbol, a.idx, a.begin_x, m, m, true FROM a JOIN last USING (symbol)),
            g AS (SELECT q.symbol, idx, coalesce(lag(end_x) OVER w + 1, begin_x) AS a, coalesce(lag(confirm_x) OVER w, begin_x) AS shown, CASE WHEN is_open THEN m ELSE confirm_x - 1 END AS b
              FROM q JOIN last ON last.symbol = q.symbol WINDOW w AS (PARTITION BY q.symbol ORDER BY idx)),
            r AS (SELECT g.symbol, g.idx, b.x, g.shown, sum(b.volume) OVER (PARTITION BY g.symbol, g.idx ORDER BY b.x) AS v FROM g JOIN bars b ON b.symbol = g.symbol AND b.x BETWEEN g.a AND g.b)
            SELECT b.symbol, b.x, coalesce(f.v, 0) AS gated FROM bars b LEFT JOIN (SELECT symbol, x, arg_max(v, idx) AS v FROM r WHERE x >= shown GROUP BY symbol, x) f ON f.symbol = b.symbol AND f.x = b.x""",
        ),
        "spans_as_bars": (
            lambda s, d: rounded(lines.over_spans(structure.pivots(hourly(s, d)).select("symbol", "seq", "x1", "x2"), hourly(s, d))),
            f"""{of_pivots} SELECT p.symbol, p.seq::BIGINT AS seq, arg_min(b.open, b.x) AS open, max(b.high) AS high, min(b.low) AS low, arg_max(b.close, b.x) AS close, sum(b.volume) AS volume
            FROM pivots p JOIN bars b ON b.symbol = p.symbol AND b.x BETWEEN p.x1 AND p.x2 GROUP BY p.symbol, p.seq""",
        ),
        "peak_bars": (
            lambda s, d: structure.peak_bars(structure.merged_groups(hourly(s, d)), hourly(s, d)),
            f"""WITH RECURSIVE {HOURLY}, {groups_sql} SELECT g.symbol, g.seq::BIGINT AS seq, max(b.x) FILTER (b.high = g.high) AS high_x, max(b.x) FILTER (b.low = g.low) AS low_x
            FROM groups g JOIN bars b ON b.symbol = g.symbol AND b.x BETWEEN g.x1 AND g.x2 GROUP BY g.symbol, g.seq""",
        ),
        "groups_of_bars": (
            lambda s, d: joins.inside(structure.merged_groups(hourly(s, d)).select("symbol", "seq", "x1", "x2"), hourly(s, d)).select("symbol", "x", "seq"),
            f"WITH RECURSIVE {HOURLY}, {groups_sql} SELECT symbol, x, seq::BIGINT AS seq FROM g",
        ),
        "line_measures": (
            lambda s, d: rounded(lines.measures(_lines(s, d)).select("symbol", "idx", "middle", "amplitude", "n_bars", "slope", "share", "ratio")),
            f"{LINES}, {measure} SELECT symbol, idx, round(middle, 6) AS middle, round(amplitude, 6) AS amplitude, n_bars, round(slope, 6) AS slope, round(share, 6) AS share, round(amplitude / nullif(lag(amplitude) OVER (PARTITION BY symbol ORDER BY idx), 0), 6) AS ratio FROM m",
        ),
        "pair_rays": (
            _rays(lines.pair_rays),
            f"{LINES}, {POLES}, {pairs} SELECT symbol, n, low_x, high_x, known_x, kind, x0, round(y0, 6) AS y0, round(slope, 6) AS slope FROM rays WHERE (symbol, n) IN (SELECT (symbol, n) FROM g WHERE c = 2)",
        ),
        "parallel_rays": (
            _rays(lines.parallel_rays),
            f"""{LINES}, {POLES}, {triples} SELECT a.symbol, a.n, a.low_x, a.high_x, a.known_x, 'triple' AS kind, o.xa AS x0, round(o.pa, 6) AS y0, round((a.pb - a.pa) / (a.xb - a.xa), 6) AS slope
            FROM g a JOIN g o ON o.symbol = a.symbol AND o.n = a.n AND a.c = 2 AND o.c = 1 WHERE a.xb > a.xa""",
        ),
        "nearest_rays": (
            _nearest,
            f"""{LINES}, {POLES}, {pairs}, f AS (SELECT symbol, max(x) // 2 AS focus_x FROM bars GROUP BY symbol),
            d AS (SELECT *, greatest(low_x - focus_x, focus_x - high_x, 0) AS away FROM rays JOIN f USING (symbol)),
            r AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY away, CASE WHEN away > 0 THEN known_x ELSE 0 END DESC, n DESC) AS rank FROM d)
            SELECT symbol, n, kind, focus_x, round(y0 + slope * (focus_x - x0), 6) AS price FROM r WHERE rank = 1""",
        ),
        "all_points": (
            lambda s, d: records.latest(_points(s, d), 0),
            f"{of_pivots}, {_POINTS_SQL} SELECT symbol, seq, side, x, price, row_number() OVER (PARTITION BY symbol ORDER BY x DESC)::INTEGER AS n FROM points",
        ),
        "points_kept_first": (
            lambda s, d: records.kept_first(_points(s, d), ["symbol", "seq"], "x", "price"),
            f"{of_pivots}, {_POINTS_SQL} SELECT symbol, seq, side, x, price FROM points QUALIFY row_number() OVER (PARTITION BY symbol, seq ORDER BY x) = 1",
        ),
        "log_appended": (
            _log,
            f"""{of_pivots}, {_POINTS_SQL}, log AS (SELECT DISTINCT symbol, seq, 0 AS x FROM points WHERE x < 300 AND x % 2 = 0)
            SELECT symbol, seq, x::BIGINT AS x FROM log UNION ALL SELECT symbol, seq, min(x) FROM points p WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.symbol = p.symbol AND l.seq = p.seq) GROUP BY symbol, seq""",
        ),
        "tail_signatures": (
            lambda s, d: records.tail_signature(_lines(s, d), ["idx", "dir", "begin_x", "end_x"], 5, "idx"),
            f"""{LINES}, t AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) <= 5)
            SELECT symbol, sha256(string_agg(idx || ':' || dir || ':' || begin_x || ':' || end_x, '|' ORDER BY idx)) AS signature FROM t GROUP BY symbol""",
        ),
        "peak_lines": (
            lambda s, d: rounded(records.peak_line(_lines(s, d), True)),
            f"""{LINES}, k AS (SELECT *, lag(end_price, 2) OVER (PARTITION BY symbol ORDER BY idx) AS before FROM l0)
            SELECT symbol, arg_max(idx, (end_price, idx)) AS idx, round(max(end_price), 6) AS end_price FROM k WHERE dir = 1 AND (before IS NULL OR before <= end_price) GROUP BY symbol""",
        ),
        "lines_with_running": (
            lambda s, d: (lambda f: rounded(records.with_running(f[1], levels.running_line(f[0], hourly(s, d))).select("symbol", "idx", "dir", "begin_x", "end_x", "high", "low", "close", "volume")))(levels.levels(hourly(s, d), 1)[0]),
            f"""{LINES}, a AS (SELECT symbol, max(idx) + 1 AS idx, arg_max(end_x, idx) AS begin_x, -arg_max(dir, idx) AS dir, arg_max(end_price, idx) AS open FROM l0 GROUP BY symbol),
            r AS (SELECT a.symbol, a.idx, a.dir, a.begin_x, max(b.x) AS end_x, greatest(any_value(a.open), max(b.high) FILTER (b.x > a.begin_x)) AS high, least(any_value(a.open), min(b.low) FILTER (b.x > a.begin_x)) AS low,
              coalesce(arg_max(b.close, b.x) FILTER (b.x > a.begin_x), any_value(a.open)) AS close, sum(b.volume) AS volume FROM a JOIN bars b ON b.symbol = a.symbol AND b.x >= a.begin_x GROUP BY a.symbol, a.idx, a.dir, a.begin_x)
            SELECT symbol, idx, dir, begin_x, end_x, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM l0 UNION ALL
            SELECT symbol, idx, dir, begin_x, end_x, round(high, 6), round(low, 6), round(close, 6), round(volume, 6) FROM r""",
        ),
        "all_levels": (
            lambda s, d: rounded(records.all_levels(_two_levels(s, d), ["symbol", "idx", "begin_x", "end_x", "open", "close"])),
            f"""{LINES}, {level_sql(1)} SELECT 0 AS level, symbol, idx, begin_x, end_x, round(open, 6) AS open, round(close, 6) AS close FROM l0 UNION ALL
            SELECT 1, symbol, idx, begin_x, end_x, round(open, 6), round(close, 6) FROM l1""",
        ),
    }
