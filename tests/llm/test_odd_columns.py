"""Byte-pair encoding and Katz scores as columns of odd tables."""

import math
import random

import public_tokenizers
from pyspark.sql import functions as F
from tiktoken import Encoding
from tiktoken.load import load_tiktoken_bpe

from barloom.llm import bpe, katz
from test_corpus_operators import brute_katz

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RNG = random.Random(12)
TEXTS = [None, "", " ", "a", "a", "a", "x" * 60_000, "ab" * 30_000, "Ünder 日本語 \U0001f600‍́", "\t\n  \r\n", "don't 12345 ...", " ".join(RNG.choices(["alpha", "beta", "γάμμα", "12"], k=40_000))]


def numbers(ids: bytes) -> list[int]:
    return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]


def test_byte_bpe_of_a_table(spark):
    """Null is empty, repeated rows are encoded alike, long texts and other columns of any name are no matter."""
    library = Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(PATH), special_tokens={})
    codec = bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(None if i == 4 else i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, decoded int").repartition(3)
    coded = docs.select("doc_id", "text", codec.encode(F.coalesce("text", F.lit(""))).alias("code"))
    got = coded.select("doc_id", "text", "code", codec.decode(F.col("code")).alias("back")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert numbers(bytes(r.code)) == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert docs.limit(0).select(codec.encode(F.col("text")).alias("code")).count() == 0


def test_katz_of_an_odd_table(spark):
    """Null keys and repeated rows are rows of their own, a text may be longer than a block, and columns may clash."""
    words = ["the", "cat", "sat", "on", "mat", "Zoë", "x1"]
    texts = [None, "", " \t", "the cat", "the cat", *(" ".join(RNG.choices(words, weights=range(7, 0, -1), k=RNG.randrange(1, 30))) for _ in range(60)), " ".join(RNG.choices(words, k=5000)), "y" * 50_000]
    train = [i % 10 != 0 for i in range(len(texts))]
    keys = [None if i % 13 == 3 else i // 2 for i in range(len(texts))]
    rows = spark.createDataFrame([(k, t, u, 1, "s", 0) for k, t, u in zip(keys, texts, train)], "doc_id long, text string, train boolean, score int, block string, n_tokens int").repartition(4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(rows, block_tokens=200, part_rows=30).collect())
    want = sorted((k is None, k or 0, u, n, known, total, round(base, 6), round(score, 6)) for k, u, (n, known, total, base, score) in zip(keys, train, brute_katz(texts, train)))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:6] == b[:6] and math.isclose(a[6], b[6], abs_tol=1e-5) and math.isclose(a[7], b[7], abs_tol=1e-5)
