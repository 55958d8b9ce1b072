"""Exact deduplication by composable polynomial fingerprints and a chunkwise comparison.

A text's fingerprint is its length in bytes and two polynomial hashes. Hashes of chunks combine by
length-shifted arithmetic, ``h(ab) = h(a) * base**len(b) + h(b)``. A huge text is cut into parts that are rows of
their own and hashed side by side; a part's hash is shifted by the length of what follows it, so the sum over the
parts is the text's hash, whatever order they come in.
Texts of equal fingerprint are then compared chunk by chunk with the group's first text; those that differ
form groups of their own in a further round, so a collision never merges different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, rows_kept, same, text_or_empty

CHUNK = 1 << 15
#: (modulus, base) of the two hashes; moduli below 2**31 keep a chunk's sum of products in 64 bits.
MODULI = ((2147483647, 911382323), (2147483629, 972663749))
#: Texts of more bytes are hashed in parts of this many.
PART = 64 * CHUNK
#: Members of a group that one key of the comparison holds at most, about.
SALT_ROWS = 256
FINGERPRINT = ("fp_len", "fp_a", "fp_b")


def _powers(modulus: int, base: int) -> np.ndarray:
    out = np.empty(CHUNK, dtype=np.uint64)
    x = 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


def chunk_hash(chunk: bytes, modulus: int, powers: np.ndarray) -> int:
    """Hash of up to ``CHUNK`` bytes."""
    a = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64)
    return int(np.dot(a, powers[CHUNK - len(a) :])) % modulus


def combine(left: int, right: int, right_length: int, modulus: int, base: int) -> int:
    """Hash of two adjoining parts from the hashes of each."""
    return (left * pow(base, right_length, modulus) + right) % modulus


def text_hash(data: bytes, modulus: int, base: int, powers: np.ndarray) -> int:
    h = 0
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        h = combine(h, chunk_hash(part, modulus, powers), len(part), modulus, base)
    return h


def fingerprint(text: Column, moduli=MODULI, behind: Column | None = None) -> Column:
    """A struct of ``fp_len``, ``fp_a`` and ``fp_b``; shifted by ``behind`` bytes that follow, if given."""

    @F.arrow_udf("fp_len long, fp_a long, fp_b long")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = [(m, b, _powers(m, b)) for m, b in moduli]
        for texts, shifts in batches:
            raw = texts.cast(pa.binary()).to_pylist()
            hashes = [[text_hash(x, *one) * pow(one[1], n, one[0]) % one[0] for x, n in zip(raw, shifts.to_pylist())] for one in tables]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in ([len(x) for x in raw], *hashes)], names=list(FINGERPRINT))

    return of(text, F.lit(0).cast("long") if behind is None else behind)


def fingerprints(rows: DataFrame, moduli=MODULI, part: int = PART) -> DataFrame:
    """``rows`` (``text_sha256``, ``size``, ``body`` and others) with the fingerprint of ``body`` in place of it and ``size``.

    Those of a ``size`` over ``part`` are hashed in parts; it may be any bound of the length in bytes.
    """
    short, huge = rows.where(F.col("size") <= part), rows.where(F.col("size") > part).withColumn("fp_len", F.octet_length("body").cast("long"))
    out = short.select(*(c for c in rows.columns if c not in ("body", "size")), fingerprint(F.col("body"), moduli).alias("fp")).select("*", "fp.*").drop("fp")
    at = F.col("at").cast("long") * part
    parts = (
        huge.select("text_sha256", "fp_len", F.col("body").cast("binary").alias("data"))
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("fp_len") - 1, F.lit(0)) / part).cast("int"))))
        .select("text_sha256", "fp_len", "at", F.substring("data", (at + 1).cast("int"), F.lit(part)).alias("data"))
        .repartition("text_sha256", "at")
        .select("text_sha256", "fp_len", "at", fingerprint(F.col("data"), moduli, F.greatest(F.col("fp_len") - at - part, F.lit(0))).alias("fp"))
        .groupBy("text_sha256", "fp_len", "at").agg(F.min("fp.fp_a").alias("a"), F.min("fp.fp_b").alias("b"))  # copies count once
        .groupBy("text_sha256", "fp_len").agg(*((F.sum(c) % moduli[i][0]).alias(f"fp_{c}") for i, c in enumerate("ab")))
    )
    return out.unionByName(huge.drop("body").join(parts, ["text_sha256", "fp_len"]).select(out.columns))


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space as one space; null as empty. The pattern leaves single spaces alone."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _differing(docs: DataFrame, pending: DataFrame, key: str, text: str) -> DataFrame:
    """Of ``pending``, the rows of groups of several whose text isn't the text of the group's first row."""
    suspects = pending.where("group_size > 1").groupBy("id", "text_sha256", *FINGERPRINT).agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    body = normalised(text)
    rows = docs.select(F.col(key).alias("d_id"), body.alias("body"), F.sha2(body, 256).alias("d_sha"))
    on = same(rows["d_id"], suspects["id"]) & (rows["d_sha"] == suspects["text_sha256"])
    data = F.col("body").cast("binary")
    last = F.floor(F.greatest(F.length(data) - 1, F.lit(0)) / CHUNK).cast("int")
    chunks = (
        rows.join(suspects, on)
        .select(
            "id", "keep_id", "group_size", *FINGERPRINT, data.alias("data"),
            F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"),
        )
        .withColumn("chunk", F.substring("data", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)))
        .drop("data")
        .withColumn("salts", F.ceil(F.col("group_size") / SALT_ROWS).cast("int"))
    )
    first = (
        chunks.where(same(F.col("id"), F.col("keep_id")))
        .groupBy(*FINGERPRINT, "chunk_no", "salts")
        .agg(F.any_value("chunk").alias("first_chunk"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("salts")
    )
    others = chunks.where(~same(F.col("id"), F.col("keep_id"))).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    )
    return (
        others.join(first, [*FINGERPRINT, "chunk_no", "salt"])
        .where("chunk <> first_chunk")
        .select("id", *FINGERPRINT)
        .distinct()
    )


def _grouped(pending: DataFrame) -> DataFrame:
    """``pending`` with ``keep_id`` and ``group_size``; rows of a large group are dealt by ``salt`` all the way."""
    parts = pending.groupBy(*FINGERPRINT, "salt").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy(*FINGERPRINT).agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = checkpoint(parts.select(*FINGERPRINT, "salt").join(groups, list(FINGERPRINT)))
    return pending.join(groups, [*FINGERPRINT, "salt"])


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", moduli=MODULI, part: int = PART) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Null texts count as empty. A null key stands behind all others; if a group has no other, its
    ``keep_id`` is null and its rows are kept. Rows that repeat a key and its text belong to one group
    and share ``kept``. Texts of any length are hashed and compared whole, chunk by chunk. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    body = normalised(text)
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).alias("size")
    rows = docs.select(F.col(key).alias("id"), size, body.alias("body"), F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(salts)).alias("salt"))
    pending = checkpoint(fingerprints(rows.withColumn("text_sha256", F.sha2("body", 256)), moduli, part))
    done: list[DataFrame] = []
    while True:
        marked = _grouped(pending)
        differing = checkpoint(_differing(docs, marked, key, text))
        if differing.isEmpty():
            break
        on = same(marked["id"], differing["id"])
        for c in FINGERPRINT:
            on &= marked[c] == differing[c]
        agree = checkpoint(marked.join(differing, on, "left_anti").drop("group_size"))
        sizes = agree.groupBy(*FINGERPRINT).agg(F.count(F.lit(1)).alias("group_size"))
        done.append(agree.join(sizes, list(FINGERPRINT)).select(*marked.columns))
        pending = checkpoint(marked.join(differing, on, "left_semi").select(*pending.columns))
    for part_ in done:
        marked = marked.unionByName(part_)
    return marked.select(
        F.col("id").alias(key), "keep_id", "group_size", same(F.col("id"), F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns as they were."""
    kept = exact_groups(docs, key, text).where("kept").select(F.col(key).alias("id"), F.col("text_sha256").alias("mark"))
    return rows_kept(docs, kept.distinct(), key, F.sha2(normalised(text), 256))
