"""The pipeline's near deduplication against brute force on planted copies."""

import random

import corpus_pipeline
from barloom.llm import near_copies

LEAST = 0.8


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_finds_all_planted_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for n in (8, 20, 60, 200, 1500):
        for _ in range(12):
            words = rng.choices(vocabulary, k=n)
            texts.append(" ".join(words))
            for changes in (1, n // 80 + 1, n // 60 + 1, n // 45 + 1, n // 30 + 1):
                copy = list(words)
                for _ in range(changes):
                    copy[rng.randrange(n)] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
            texts.append(" ".join(words[: n - n // 10]))
    sets = [brute_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= LEAST * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [i for i in range(len(texts)) if find(i) == i]
    assert len(kept) < 0.6 * len(texts)


def test_fingerprints_within_two_bits_and_equal_ones_are_candidates(spark):
    rows = spark.createDataFrame([(1, 0), (2, 3), (3, 7), (4, 3), (4, 3), (5, 1 << 40)], "node long, fp long")
    assert {(r.a, r.b) for r in near_copies._fingerprinted(rows).collect()} == {(1, 2), (2, 3), (2, 4), (1, 5)}


def test_only_sets_that_share_rare_shingles_meet_and_no_near_copy_is_lost(spark):
    rng = random.Random(5)
    sets = []
    for size in (1, 2, 5, 9, 10, 40, 90):
        base = rng.sample(range(10**6), size)
        for k in range(12):
            some = set(base)
            for _ in range(rng.randrange(0, max(2, size // 12 + 1))):
                some.discard(rng.choice(base))
                if rng.random() < 0.7:
                    some.add(rng.randrange(10**6, 10**7))
            sets.append(some or {k})
    far = rng.sample(range(10**7, 10**8), 60)  # a large group of texts that are two thirds alike
    sets += [set(far[12:]) | set(rng.sample(range(10**8, 10**9), 12)) for _ in range(60)]
    df = spark.createDataFrame([(i, i, sorted(x)) for i, x in enumerate(sets)], "node long, part long, parts array<long>")
    got = {(r.a, r.b) for r in near_copies._sharing(df).collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert alike and alike <= got
    assert not any(a >= len(sets) - 60 for a, _ in got)


def test_edited_copies_of_one_text_meet_by_their_edits_and_no_link_is_lost(spark):
    rng = random.Random(6)
    base = list(range(150))
    sets = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
            words[rng.randrange(len(words))] = rng.randrange(1000, 10**6)
        sets.append({hash(tuple(words[j : j + 5])) for j in range(146)})
    rows = [(i, i, sorted(x), 1) for i, x in enumerate(sets)] + [(1000 + i, 1000 + i, [7000 + i, 8000 + i], 2) for i in range(5)]
    df = spark.createDataFrame(rows, "node long, part long, parts array<long>, place long")
    got = [(r.a, r.b) for r in near_copies._sharing(df, "place").collect()]
    alike = [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]

    def parts(pairs):
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            low, high = sorted((find(a), find(b)))
            root[high] = low
        return [find(i) for i in range(len(sets))]

    assert len(alike) > 3000 and len(got) < len(alike) / 4  # all alike were met in pairs before
    assert parts(set(got) & set(alike)) == parts(alike) and len(set(parts(alike))) > 3


def test_words_of_one_text_at_a_time_are_held():
    import tracemalloc

    import pyarrow as pa
    from barloom.llm.common import slices

    rng = random.Random(8)
    texts = pa.array([" ".join(f"w{rng.randrange(4000)}" for _ in range(400)) for _ in range(1500)])
    kind = pa.struct([("node", pa.int64()), ("parts", pa.list_(pa.int64()))])
    hashes = near_copies._Words()

    def one(text):
        words = near_copies._words(text)
        return near_copies.node_of(words), near_copies.shingles(words, hashes).view("int64")

    all_at_once = [one(t) for t in texts.to_pylist()]
    tracemalloc.start()
    parts = list(near_copies._told(iter([texts]), one, kind))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(x["node"], x["parts"]) for p in parts for x in p.to_pylist()] == [(a, b.tolist()) for a, b in all_at_once]
    assert peak < 3e6  # the words of all texts take over 20 MB
    assert [len(x) for x in slices([texts, texts[:0], texts[:3]], 1000)] == [1000, 500, 3]
