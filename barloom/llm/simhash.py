"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints within two bits of each other
have a segment that differs by at most one bit. Either a segment is equal, or both differ by exactly one
bit; so the index holds each segment whole, and the upper segment once for each of its bits with that bit
as a wildcard. Equality joins on the index find every such pair once and the distance is verified.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, rows_kept, text_or_empty
from barloom.llm.components import connected_components

BLOCK = 1 << 16
SEED = 42
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def simhash(text: str, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; zero if there are no words."""
    words = text.encode().lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], dtype=np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * set_bits > n].sum(dtype=np.uint64).astype(np.int64))


def simhash_of(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in texts], dtype="int64")

    return of(text)


def _half(fp: Column, upper: bool) -> Column:
    return F.shiftrightunsigned(fp, 32) if upper else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def close_pairs(fps: DataFrame) -> DataFrame:
    """``a`` and ``b`` (values of ``node``) of all pairs of ``fps`` (distinct ``fp``, ``node``) within two bits.

    Equal keys meet in plain shuffled joins, whose large keys Spark splits; the condition is part of the
    join, so only verified pairs leave it, each once.
    """
    distance = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp")))
    whole = [
        fps.select(_half(F.col("fp"), upper).alias("key"), "fp", "node") for upper in (True, False)
    ]
    equal_segment = [
        x.alias("l").join(x.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & (distance <= 2))
        for x in whole
    ]
    bit = F.expr("shiftright(seg, wild) & 1")
    variants = (
        fps.select("fp", "node", _half(F.col("fp"), True).alias("seg"))
        .withColumn("wild", F.explode(F.sequence(F.lit(0), F.lit(31))))
        .select("fp", "node", bit.alias("bit"), F.expr("(seg & ~shiftleft(1L, wild)) | shiftleft(cast(wild as bigint), 32)").alias("key"))
    )
    one_bit = variants.where("bit = 0").drop("bit").alias("l").join(
        variants.where("bit = 1").drop("bit").alias("r"), (F.col("l.key") == F.col("r.key")) & (distance == 2)
    )
    pairs = [x.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")) for x in (*equal_segment, one_bit)]
    return pairs[0].unionAll(pairs[1]).unionAll(pairs[2])


def _labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``mark`` (a hash of the text), ``fp``, ``component`` (its least fingerprint) and ``component_id`` of each row."""
    body = text_or_empty(text)
    rows = checkpoint(docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("mark"), simhash_of(body).alias("fp")))
    fps = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least_id")).withColumn("node", F.col("fp")))
    parts = connected_components(close_pairs(fps), "a", "b")
    labelled = checkpoint(
        fps.join(parts, "node", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    )
    least = checkpoint(labelled.groupBy("component").agg(F.min("least_id").alias("component_id")))
    return rows.join(labelled.join(least, "component").select("fp", "component", "component_id"), "fp")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents link at two or fewer differing bits; ``component_id`` is the smallest key reachable. Null
    and wordless texts have fingerprint zero and link like any other. Null keys take part; a component
    of null keys alone has a null id. Links are made between distinct fingerprints only, so exact copies
    cost nothing. Repeated rows have a row each. Texts of any length are read whole. Other columns are left out,
    whatever their names. An empty table gives no rows.
    """
    return _labelled(docs, key, text).select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key; all columns as they were.

    Of several rows with that key (null keys too), the one whose text has the smallest hash stays.
    """
    least = F.min(F.struct(F.col("id").isNull(), "id", "mark"))
    kept = _labelled(docs, key, text).groupBy("component").agg(least.alias("r")).select("r.id", "r.mark")
    return rows_kept(docs, kept, key, F.xxhash64(text_or_empty(text)))
