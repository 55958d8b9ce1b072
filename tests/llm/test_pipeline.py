"""The pipeline's stages against brute force, over documents with odd rows and clashing columns."""

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from barloom.llm import secrets

DATA = "/root/testdata/sf0.001"
CLASHES = "score lang_pred spans masked _mark _scan _lang fp keep_id id body row ids component mark node".split()


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    near = "We met by the river and talked about the plans for the coming year until it was late and dark and cold outside " * 4
    odd = [
        (None, "a null key, and a text of some words in it", "en", None, None), (None, None, None, None, None), (90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0),
        (90_003, near, "en", "s", 5), (90_003, near, "en", "s", 5), (90_004, near + "now", "en", "s", 5), (90_005, "  " + near.replace(" ", "\n"), "en", "s", 5),
        (90_006, "the password = hunter2hunter2 is for the house of the man and it is what it is", "en", "s", 1), (90_007, "12 345 ..!", "en", "s", 1),
        (90_008, "of the and " * 60_000, "en", "s", 1),
    ]
    rows = base.unionByName(spark.createDataFrame(odd, base.schema))
    return rows.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)}).cache()


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_language_id_keeps_clean_documents(spark, docs):
    kept = pipeline.language_id(spark, docs, DATA)
    assert kept.columns == docs.columns
    have, got = counted(docs), counted(kept)
    assert not got - have
    lettered = Counter({k: n for k, n in have.items() if k[1] and len(re.findall(r"[^\W\d_]{3,}", k[1])) > 20})
    assert sum((lettered & got).values()) >= 0.97 * sum(lettered.values())
    assert not any(not t or not re.search(r"[^\W\d_]", t) for _, t in got)


def test_exact_dedup(spark, docs):
    kept = pipeline.exact_dedup_stage(spark, docs, DATA)
    assert kept.columns == docs.columns
    least = {}
    for k, t in counted(docs):
        key = (k is None, k or 0)
        if plain(t) not in least or key < least[plain(t)]:
            least[plain(t)] = key
    got = [((k is None, k or 0), plain(t)) for k, t in counted(kept).elements()]
    assert sorted(got) == sorted((k, t) for t, k in least.items())


def test_near_dedup(spark, docs):
    rows = sorted(counted(docs).elements(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            small, large = sorted((len(a), len(b)))
            if small >= 0.8 * large and (not large or len(a & b) >= 0.8 * len(a | b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = Counter(rows[i] for i in range(len(rows)) if root[i] == i)
    kept = pipeline.near_dedup(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert Counter(k for k, _ in counted(kept).elements()) == Counter(k for k, _ in want.elements())


def test_secret_masking(spark, docs):
    found = pipeline.secret_masking(spark, docs, DATA)
    assert found.columns == docs.columns and found.count() == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in found.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        if r.text is None:
            assert None in texts[r.doc_id]
            continue
        assert not secrets.base_spans(r.text)
        parts = [re.escape(x) for x in r.text.split(secrets.MASK)]
        assert any(t is not None and re.fullmatch("(?s:.+)".join(parts), t) for t in texts[r.doc_id])
    without = pipeline.secret_masking(spark, docs.drop("n_chars"), DATA)
    assert "n_chars" not in without.columns and without.count() == docs.count()


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = pipeline.packing_stage(spark, docs, DATA).collect()
    want = sum(n * (1 + len(library.encode(t or "", add_special_tokens=False).ids)) for (_, t), n in counted(docs).items())
    assert sum(p.length for p in pieces) == want
    used = Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 2048


def test_empty_documents(spark, docs):
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_run(spark):
    assert 4 <= len(pipeline.STAGES) <= 5
    out = pipeline.run(spark, DATA)
    keys = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    found = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert found <= keys and len(found) > 0.5 * len(keys)
