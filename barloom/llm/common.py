"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session
    has a temporary folder; on a cluster it is an error, since executors share no folder of a machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again. A checkpoint keeps the estimated size of its plan, which joins multiply
    in every round until planning takes minutes; the size of files is known."""
    folder = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Write ``df`` to the shared folder by buckets of ``column``, so that joins and groups by it don't shuffle it again."""
    spark = df.sparkSession
    name = f"barloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for new columns, none of which ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def excerpts(docs: DataFrame, text: str, most: int, chars: int, by: str | None = None) -> list[tuple]:
    """A bounded sample to fit a model on: for each value of ``by``, excerpts of ``most`` different texts, at most.

    Texts are dealt to ``most`` buckets by their hash, and each bucket gives the one of smallest hash, so copies
    count once and the sample doesn't depend on the order of rows. An excerpt has ``chars`` characters at most,
    from a place in its text that the hash tells. Null texts and null values of ``by`` are left out.
    """
    group = F.col(by) if by else F.lit("")
    rows = docs.where(F.col(text).isNotNull() & group.isNotNull()).select(group.alias("by"), F.col(text).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    chosen = rows.groupBy("by", F.pmod("hash", F.lit(most)).alias("bucket")).agg(F.min("hash").alias("hash"))
    wanted = [(r["by"], r["hash"]) for r in chosen.select("by", "hash").collect()]  # at most ``most`` for each value
    if not wanted:
        return []
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    found = rows.where(F.col("hash").isin([h for _, h in wanted])).select(
        "by", "hash", F.substring("text", (F.pmod(F.shiftright("hash", 7), room) + 1).cast("int"), F.lit(chars)).alias("text")
    )
    got = found.dropDuplicates(["by", "hash"]).collect()
    keep = set(wanted)
    return sorted((r["text"], r["by"]) for r in got if (r["by"], r["hash"]) in keep)


_held: dict = {}


def held(mark, make: Callable):
    """What ``make`` gives, made once per mark in a Python worker; whatever was held for another mark goes first."""
    if mark not in _held:
        _held.clear()
        _held[mark] = make()
    return _held[mark]


def slices(batches: Iterable[pa.Array], rows: int = 256) -> Iterator[pa.Array]:
    """The batches in parts of ``rows`` rows, so that a batch is never whole in Python's objects, which take many times its bytes."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def rows_kept(docs: DataFrame, kept: DataFrame, key: str, mark: Column) -> DataFrame:
    """One row of ``docs`` for each ``id`` and ``mark`` of ``kept`` (distinct); ``mark`` is computed from a row."""
    kept = checkpoint(kept.select(F.col("id").alias("_kept_id"), F.col("mark").alias("_kept_mark")))
    (own,) = fresh(docs, "_mark")
    rows = docs.withColumn(own, mark)
    found = rows.join(kept, same(rows[key], kept["_kept_id"]) & (rows[own] == kept["_kept_mark"]), "left_semi")
    repeated = docs.select(F.col(key).alias("id"), mark.alias("mark")).groupBy("id", "mark").count().where("count > 1")
    if not repeated.isEmpty():
        found = found.dropDuplicates([key, own])
    return found.drop(own)
