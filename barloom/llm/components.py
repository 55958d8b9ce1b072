"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) for every node of a link.

    Each round hangs the neighbours of a node under the smallest of them, first those above it and
    then those below it, until nothing moves; rounds grow with the logarithm of the longest path.
    Minima are combined before the shuffle and written out, so that the joins with them are plain
    shuffled joins whose large keys Spark can split. Self links and nulls are ignored.
    """
    edges = checkpoint(
        links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
        .where("low < high")
        .distinct()
    )
    before = _mark(edges)
    while before[0]:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(
            edges.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpoint(
            both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        )
        least = checkpoint(large.groupBy("high").agg(F.min("low").alias("m")))
        edges = checkpoint(
            large.join(least, "high")
            .where("low > m")
            .select(F.col("m").alias("low"), F.col("low").alias("high"))
            .unionAll(least.select(F.col("m").alias("low"), "high"))
            .distinct()
        )
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select("low").distinct().select(F.col("low").alias("node"), F.col("low").alias("component"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(roots)
