"""A corpus pipeline over ``documents``: language ID, exact and near deduplication, secret masking, packing.

Each stage takes all that the one before kept, is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, langid, near_copies, packing, secrets
from barloom.llm.common import fresh, shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with confidence; rows of null texts and of texts without letters go.

    Rows are judged one by one, so repeated rows, null keys and null languages need no care; texts are read whole.
    """
    pred, score = fresh(docs, "lang_pred", "score")
    found = langid.predict(docs, docs, pred=pred, score=score)
    return found.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= langid.LEAST_SCORE)).select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, that of the smallest key; null keys stand behind all others.

    Of rows that repeat key and text one stays. Null texts count as empty.
    """
    return exact_dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles that overlap by 0.8 or more.

    Texts without words are near copies of each other. Of rows that repeat key and text one stays.
    """
    return near_copies.keep_one_of_each(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; ``n_chars`` follows the text where there is such a column. All rows stay; null texts stay null."""
    spans, masked = fresh(docs, "spans", "masked")
    found = secrets.scan(docs, mask=True, spans=spans, masked_text=masked).withColumn("text", F.col(masked))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece. All rows are packed, repeated ones and null texts (the end alone) too."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("secret_masking", secret_masking),
    ("packing", packing_stage),
]

#: SQL can express neither the random fields nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
