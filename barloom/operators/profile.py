"""Volume by price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Prices are told apart to this part of one.
PRICE_PARTS = 10_000
LEAST_STEP = 0.001


def bins(ticks: DataFrame, *by: str) -> DataFrame:
    """Quantity sold (``s``), bought (``b``) and neither (``w``) per key and price."""
    key = F.round(F.col("price") * PRICE_PARTS).cast("long")
    part = lambda c: F.sum(F.when(c, F.col("qty")).otherwise(0.0))
    side = F.col("side")
    return (
        ticks.groupBy(*by, key.alias("price_key"))
        .agg(part(side == "S").alias("s"), part(side == "B").alias("b"), part(~side.isin("S", "B")).alias("w"))
        .withColumn("price", F.col("price_key") / PRICE_PARTS)
    )


def profile(bins_: DataFrame, step: float, *by: str) -> DataFrame:
    """Bins added up into buckets of ``step``."""
    step = max(step, LEAST_STEP)
    rows = bins_.groupBy(*by, F.floor(F.col("price") / step).alias("bucket")).agg(*(F.sum(c).alias(c) for c in "sbw"))
    return rows.withColumns({"price": F.col("bucket") * step, "total": F.col("s") + F.col("b") + F.col("w")})


def triangle(bars: DataFrame, step: float) -> DataFrame:
    """A bar's volume over the buckets from its low to its high, highest at its close: ``symbol``, ``x``, ``bucket``, ``b``."""
    step = max(step, LEAST_STEP)
    low, high = F.least("low", "high"), F.greatest("low", "high")
    rows = bars.where("volume > 0").select("symbol", "x", low.alias("lo"), high.alias("hi"), F.greatest(F.least("close", high), low).alias("mode"), "volume")
    first = F.floor(F.col("lo") / step)
    last = F.when(F.col("hi") - F.col("lo") < 1e-12, first).otherwise(F.ceil(F.col("hi") / step))
    rows = rows.withColumn("bucket", F.explode(F.sequence(first, last)))
    p, lo, hi, mode = F.col("bucket") * step, F.col("lo"), F.col("hi"), F.col("mode")
    span = F.greatest(hi - lo, F.lit(1e-12))
    weight = (
        F.when(hi - lo < 1e-12, 1.0).when(mode - lo < 1e-12, (hi - p) / span).when(hi - mode < 1e-12, (p - lo) / span)
        .when(p <= mode, (p - lo) / (mode - lo)).otherwise((hi - p) / (hi - mode))
    )
    rows = rows.withColumn("weight", F.greatest(weight, F.lit(0.0)))
    rows = rows.withColumn("whole", F.sum("weight").over(W.partitionBy("symbol", "x"))).where("weight > 0 AND whole > 1e-12")
    return rows.select("symbol", "x", "bucket", (F.col("weight") / F.col("whole") * F.col("volume")).alias("b"))


def peaks(profile_: DataFrame, *by: str) -> DataFrame:
    """Buckets with volume, not less than the one before and more than the one after."""
    w = W.partitionBy(*by).orderBy("bucket")
    before, after = (F.coalesce(f("total").over(w), F.lit(0.0)) for f in (F.lag, F.lead))
    rows = profile_.withColumn("is_peak", (F.col("total") > 0) & (F.col("total") >= before) & (F.col("total") > after))
    return rows.where("is_peak").drop("is_peak")


def labelled(peaks_: DataFrame, low: str, high: str, *by: str) -> DataFrame:
    """Peaks outside of ``low`` to ``high``: -1, -2, ... downward below, 1, 2, ... upward above."""
    price = F.col("price")
    zone = F.when(price < F.col(low), -1).when(price > F.col(high), 1)
    rows = peaks_.withColumn("zone", zone).where("zone IS NOT NULL")
    nearest = W.partitionBy(*by, "zone").orderBy(F.col("zone") * price)
    return rows.withColumn("label", F.col("zone") * F.row_number().over(nearest)).drop("zone")


def with_bins(bars: DataFrame, ticks: DataFrame, slots: str = "slot") -> DataFrame:
    """``bars`` with ``bins``, an array of ``price``, ``s``, ``b`` and ``w`` of the ticks of their slot; null without any.

    ``ticks`` have the column ``slots``, the key that both share.
    """
    found = bins(ticks.where("price > 0 AND qty > 0"), "symbol", slots)
    arrays = found.groupBy("symbol", slots).agg(F.array_sort(F.collect_list(F.struct("price", "s", "b", "w"))).alias("bins"))
    return bars.join(arrays, ["symbol", slots], "left")


def profile_to(bars: DataFrame, cutoff: int | None, step: float) -> DataFrame:
    """Volume per bucket of the bars (with ``bins``) up to ``cutoff``, included: ``symbol``, ``bucket``, ``s``, ``b``, ``w``, ``total``.

    A bar with bins counts by them; one of a single price at its close, all bought; others by a triangle.
    """
    step = max(step, LEAST_STEP)
    bars = bars if cutoff is None else bars.where(F.col("x") <= cutoff)
    empty = F.coalesce(F.size("bins"), F.lit(-1)) < 0
    point = F.abs(F.col("high") - F.col("low")) < 1e-12
    bucket = lambda price: F.floor(price / step).alias("bucket")
    none = F.lit(0.0)
    whole = bars.where(~empty).select("symbol", F.explode("bins").alias("p")).select("symbol", bucket(F.col("p.price")), *(F.greatest(f"p.{c}", none).alias(c) for c in "sbw"))
    single = bars.where(empty & point & (F.col("volume") > 0)).select("symbol", bucket(F.col("close")), none.alias("s"), F.col("volume").alias("b"), none.alias("w"))
    spread_ = triangle(bars.where(empty & ~point), step).select("symbol", "bucket", none.alias("s"), "b", none.alias("w"))
    rows = whole.unionAll(single).unionAll(spread_).groupBy("symbol", "bucket").agg(*(F.sum(c).alias(c) for c in "sbw"))
    rows = rows.withColumn("total", F.col("s") + F.col("b") + F.col("w"))
    return rows.where("total > 0")


def counts_to(bars: DataFrame, cutoff: int | None, step: float) -> DataFrame:
    """As :func:`profile_to` for numbers of trades: by ``bins`` of trades, else all of a bar's (``trades``, ``bought``, ``sold``) at its close."""
    step = max(step, LEAST_STEP)
    bars = bars if cutoff is None else bars.where(F.col("x") <= cutoff)
    has = F.coalesce(F.size("bins"), F.lit(0)) > 0
    bucket = lambda price: F.floor(price / step).alias("bucket")
    whole = bars.where(has).select("symbol", F.explode("bins").alias("p")).select("symbol", bucket(F.col("p.price")), *(F.greatest(f"p.{c}", F.lit(0.0)).alias(c) for c in "sbw"))
    other = F.greatest(F.col("trades") - F.col("bought") - F.col("sold"), F.lit(0.0))
    single = bars.where(~has & (F.col("trades") > 0)).select("symbol", bucket(F.col("close")), F.col("sold").alias("s"), F.col("bought").alias("b"), other.alias("w"))
    rows = whole.unionAll(single).groupBy("symbol", "bucket").agg(*(F.sum(c).alias(c) for c in "sbw"))
    return rows.withColumn("total", F.col("s") + F.col("b") + F.col("w")).where("total > 0")


def merged_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets of either profile (``symbol``, ``bucket``, ``s``, ``b``, ``w``), with the sum of both."""
    columns = ["symbol", "bucket", "s", "b", "w"]
    return a.select(columns).unionByName(b.select(columns)).groupBy("symbol", "bucket").agg(*(F.sum(c).alias(c) for c in "sbw"))


def volume_by_side(bars: DataFrame) -> DataFrame:
    """A bar's volume bought, sold and neither: in the shares of its ``bins``, else by its ``side``; and its number of trades.

    The number is ``trades`` where there is one (0 too), else that of the bins' prices, else 1 for a side.
    """
    share = lambda c: F.aggregate("bins", F.lit(0.0), lambda a, p: a + p[c])
    whole = share("s") + share("b") + share("w")
    by_bins, side = whole > 0, F.col("side")
    part = lambda c, own: F.when(by_bins, F.col("volume") * share(c) / whole).when(own, F.col("volume")).otherwise(0.0)
    count = F.coalesce("trades", F.when(F.size("bins") > 0, 3.0 * F.size("bins")), F.when(side.isin("B", "S"), 1.0).otherwise(0.0))
    neither = ~side.isin("B", "S") | side.isNull()
    return bars.select("symbol", "x", part("b", side == "B").alias("bought"), part("s", side == "S").alias("sold"), part("w", neither).alias("neither"), count.alias("trades"))
