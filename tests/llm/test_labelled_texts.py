"""Secret scans and language ID: what the fields find, and odd tables."""

import random
import string

from pyspark.sql import functions as F

from barloom.llm import common, langid, secrets

DATA = "/root/testdata/sf0.01/documents.parquet"


def planted(rng, text):
    """``text`` with secrets of known formats put between its words."""
    words, found = text.split(), []
    for _ in range(3):
        secret = secrets.made_up(rng)
        while secret.startswith(("password", "token", "api_key", "secret", "-----")):
            secret = secrets.made_up(rng)
        found.append(secret.removeprefix("Bearer "))
        words.insert(rng.randrange(len(words) + 1), secret)
    return " ".join(words), found


def test_the_field_finds_secrets_it_has_not_seen(spark):
    rng = random.Random(11)
    docs = spark.read.parquet(DATA)
    texts = [r.text for r in docs.where("text IS NOT NULL AND doc_id % 7 = 3 AND length(text) > 40").orderBy("doc_id").limit(60).collect()]
    rows, want = [], {}
    for i, text in enumerate(texts):
        text, found = planted(rng, text)
        rows.append((i, text))
        want[i] = found
    field = secrets.fit([t for t, _ in common.excerpts(docs.where("doc_id % 7 <> 3"), "text", 600, 5000)])
    found = secrets.Scanner(field).scan([t for _, t in rows])
    hits = total = 0
    wrong = 0
    for (i, text), spans in zip(rows, found):
        got = [text[a:b] for a, k, b in spans]
        total += len(want[i])
        hits += sum(any(w in g or g in w and len(g) > len(w) // 2 for g in got) for w in want[i])
        wrong += sum(k == 3 and not any(w in text[a:b] or text[a:b] in w for w in want[i]) for a, k, b in spans)
    assert hits >= 0.9 * total and wrong <= 0.1 * total


def test_secrets_in_long_words_and_odd_tables(spark):
    rng = random.Random(2)
    key = "ghp_" + "".join(rng.choices(string.ascii_letters + string.digits, k=36))
    minified = '{"a":1,' * 200 + f'"k":"{key}",' + '"b":2,' * 200 + "}"
    rows = [(1, minified, 5, "m"), (1, minified, 5, "m"), (None, None, None, None), (2, "", 0, ""), (3, "word " * 300_000 + "password=abcdef12", 1, "x"), (4, "x" * 100_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, masked string")
    train = spark.read.parquet(DATA).select("doc_id", "text", F.lit(1).alias("spans"), F.lit("").alias("masked"))
    got = secrets.scan(docs.unionByName(train), mask=True)
    assert got.columns == ["doc_id", "text", "spans", "masked"]
    found = got.where("doc_id IS NULL OR text IN ('') OR length(text) > 2000 AND doc_id < 5").collect()
    of = {}
    for r in found:
        of.setdefault(r.doc_id, []).append(r)
    ones = [r for r in of[1] if r.text == minified]
    assert len(ones) == 2 and all(key not in r.masked and r.masked.count('"b":2') == 200 for r in ones)
    assert of[None][0].masked is None and of[None][0].spans == []
    long = next(r for r in of[3] if r.text.startswith("word word"))
    assert [(s.kind, s.end) for s in long.spans] == [("assign", 1_500_017)]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_languages_of_odd_tables(spark):
    docs = spark.read.parquet(DATA)
    odd = spark.createDataFrame([(1, "la casa de la ciudad y", 7, 1.0)] * 2 + [(None, None, None, None), (2, "", 0, 0.0), (3, "and the " * 200_000, 1, 1.0)], "doc_id long, text string, lang_pred int, score double")
    got = langid.predict(odd, docs)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == 5 and [r.lang_pred for r in rows if r.doc_id in (None, 2)] == ["und", "und"]
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in rows)
    other = langid.predict(odd, docs, pred="p", score="s")
    assert other.columns == [*odd.columns, "p", "s"]
    assert langid.predict(odd.limit(0), docs).count() == 0


def test_each_language_and_each_text_is_sampled(spark):
    rows = [("same text of a third", "a")] * 3000 + [(f"text {i} of it", "a") for i in range(500)] + [("rare " * 9000, "b"), (None, "c"), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = common.excerpts(docs, "text", 50, 1000, by="lang")
    assert len({t for t, _ in got}) == len(got) and {by for _, by in got} == {"a", "b"}
    assert 40 <= sum(by == "a" for _, by in got) <= 50 and max(len(t) for t, _ in got) == 1000
    assert got == common.excerpts(docs.repartition(3), "text", 50, 1000, by="lang")
