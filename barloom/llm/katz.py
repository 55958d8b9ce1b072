"""Language-model scores by Katz backoff over words and word pairs.

Counts are discounted by Good-Turing; what a context's discounts leave goes to the words not seen in it, in
proportion to their one-word probability, by a backoff weight that makes its probabilities sum to one exactly.
A token is scored by its pair if that was seen, else by the weight of its context times its one-word
probability, where unknown words share the mass that the one-word discounts leave.

Texts are numbered block by block; a block asks the partitions of the count tables for the counts of its own
distinct words and pairs, and later those of the contexts for their weights. So all that is shuffled is summed
per block first, each partition of a table answers for a range of hashes, and no key is hot. Words and pairs
are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import bucketed, checkpoint, text_or_empty

#: Counts above this are not discounted.
KATZ = 5
ADD = 0.1
#: Tokens of a block, and hashes of one partition of a table, about.
BLOCK_TOKENS, PART_ROWS = 4_500_000, 2_000_000
END, START = 0, 1  # their numbers in each block's list of words
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers words as they come."""

    def __init__(self):
        super().__init__({b"": END, b" ": START})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, first bytes first, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 3)


def loosen(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def loosen_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(loosen(data, "<u8"), dtype=np.uint64)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    with np.errstate(over="ignore"):
        x = (first * _MIX) ^ (second + (first << np.uint64(6)) + (first >> np.uint64(2)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(hashes: np.ndarray, parts: int) -> list[int]:
    """Where the ranges of ``parts`` equal parts begin in sorted hashes, and their end."""
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    return [0, *np.searchsorted(hashes, bounds, side="left").tolist(), len(hashes)]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Factors for the counts 0 to ``KATZ`` by Good-Turing from the numbers of words with count 1, 2, ... .

    If those are too few or too uneven for it, absolute discounting with the usual estimate from the
    first two.
    """
    n = [0, *counts_of_counts]
    k = KATZ
    out = np.ones(k + 1)
    if all(n[1 : k + 2]):
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            out[1:] = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
            if (out[1:] > 0).all() and (out[1:] < 1).all():
                return out
    d = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = min(max(d, 0.1), 0.9)
    out[1:] = [1 - d / r for r in range(1, k + 1)]
    return out


class Block:
    """One block's texts as numbers into its list of words."""

    def __init__(self, row: dict):
        self.hashes = loosen(row["words"], "<u8")
        self.codes = loosen(row["codes"], "<u4").view(np.int32)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.train = np.array(row["train"], dtype=bool)
        self.before = np.roll(self.codes, 1)
        self.before[self.before == END] = START
        self.before[:1] = START
        self.trained = np.repeat(self.train, self.lengths)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the words by hash, and their training counts in it."""
        order = np.argsort(self.hashes)
        return order, np.bincount(self.codes[self.trained], minlength=len(self.hashes))[order]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct pairs in order, the first place and the pair's number of each token."""
        found = pair_hash(self.hashes[self.before], self.hashes[self.codes])
        order = np.argsort(found)
        found = found[order]
        new = np.concatenate([[True], found[1:] != found[:-1]])
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.cumsum(new, dtype=np.int32) - 1
        return found[new], order[new], number


ENCODED = "block long, words binary, codes binary, n_words long, n_tokens long, lengths array<long>, train array<boolean>"
ASKED = "ngram int, part long, block long, hashes binary, counts binary"
ANSWERED = "kind string, ngram int, part long, block long, hashes binary, counts binary, owned binary, n array<long>"
SCORED = "kind string, part long, block long, a binary, b binary, c binary, d binary, doc array<double>, known array<long>, base array<double>"
WEIGHED = "part long, block long, backoff binary, correction binary"


def _table(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def encoded(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``docs`` (``id``, ``text``, ``train``) as numbered words, with the ids of their rows."""
    id_kind = docs.schema["id"].dataType
    schema = T.StructType([*T.StructType.fromDDL(ENCODED).fields, T.StructField("ids", T.ArrayType(id_kind))])
    plain = _arrow(ENCODED)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        words, codes, lengths, train, ids, size = Words(), [], [], [], [], 0

        def flushed() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
            row = {"block": block, "words": squeeze(hashes), "codes": squeeze(np.concatenate(codes)), "n_words": len(words), "n_tokens": size, "lengths": lengths, "train": train}
            flat = pa.chunked_array(ids).combine_chunks()
            listed = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            return pa.RecordBatch.from_arrays([*_table(plain, [row]).columns, listed], names=[*plain.names, "ids"])

        for batch in batches:
            first = 0
            texts, fresh = batch.column("text"), batch.column("train").to_pylist()
            for i in range(len(batch)):
                found = words_of(texts[i].as_py())
                codes.append(np.fromiter((*map(words.__getitem__, found), END), dtype="<u4", count=len(found) + 1))
                lengths.append(len(found) + 1)
                train.append(fresh[i])
                size += len(found) + 1
                if size >= block_tokens:
                    ids.append(batch.column("id").slice(first, i + 1 - first))
                    first = i + 1
                    yield flushed()
                    block += 1
                    words, codes, lengths, train, ids, size = Words(), [], [], [], [], 0
            ids.append(batch.column("id").slice(first))
        if lengths:
            yield flushed()

    return docs.select("id", "text", "train").mapInArrow(encode, schema)


def _asked(blocks: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """Each block's distinct words and pairs with their training counts, cut by the partition that has them."""
    schema = _arrow(ASKED)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row)
                order, counts = block.words()
                pairs, _, number = block.pairs()
                pair_counts = np.bincount(number[block.trained], minlength=len(pairs))
                for ngram, hashes, n in ((1, block.hashes[order], counts), (2, pairs, pair_counts)):
                    at = cuts(hashes, parts[ngram - 1])
                    for part, (a, b) in enumerate(zip(at, at[1:])):
                        if a < b:
                            yield _table(schema, [{"ngram": ngram, "part": part, "block": row["block"], "hashes": squeeze_sorted(hashes[a:b]), "counts": squeeze(n[a:b].astype("<u4"))}])

    return blocks.mapInArrow(ask, ASKED)


def _count(asked: pa.Table) -> pa.Table:
    """One partition of a table: its hashes and counts, the numbers of small counts, and an answer to each block.

    The first block that has a pair owns it: it alone adds the pair to its context.
    """
    rows = sorted(asked.to_pylist(), key=lambda r: r["block"])
    hashes = [loosen_sorted(r["hashes"]) for r in rows]
    counts = np.concatenate([loosen(r["counts"], "<u4") for r in rows])
    distinct, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.bincount(number, counts).astype(np.int64)
    owned = np.zeros(len(counts), dtype=bool)
    owned[first] = True
    seen = total > 0
    n = [*np.bincount(np.minimum(total[seen], KATZ + 2), minlength=KATZ + 3)[1 : KATZ + 2].tolist(), int(seen.sum()), int(total.sum())]
    same = {"ngram": rows[0]["ngram"], "part": rows[0]["part"]}
    out = [{"kind": "table", **same, "hashes": squeeze_sorted(distinct[seen]), "counts": squeeze(total[seen].astype("<u8")), "n": n}]
    at = 0
    for r, h in zip(rows, hashes):
        one = slice(at, at + len(h))
        at += len(h)
        out.append({"kind": "answer", **same, "block": r["block"], "counts": squeeze(total[number[one]].astype("<u8")), "owned": squeeze(np.packbits(owned[one]))})
    return pa.Table.from_pylist(out, _arrow(ANSWERED))


class Model:
    """What scoring needs besides the tables: discounts and totals."""

    def __init__(self, words: list[int], pairs: list[int]):
        self.one, self.two = discounts(words[: KATZ + 1]), discounts(pairs[: KATZ + 1])
        self.distinct, self.tokens = words[KATZ + 1], words[KATZ + 2]
        left = sum(r * n * (1 - self.one[r]) for r, n in enumerate(words[:KATZ], 1))
        # If no count is small, one token more is the unknown word's.
        self.among = self.tokens if left else self.tokens + 1
        self.unknown = (left or 1) / self.among

    def discounted(self, counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= KATZ, factors[np.minimum(counts, KATZ)], 1.0)

    def one_word(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words with these training counts."""
        return np.where(counts > 0, self.discounted(counts, self.one) / max(1, self.among), self.unknown)


def _answers(answers: pa.Table, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r for r in answers.select(["ngram", "part", "counts", "owned"]).to_pylist() if r["ngram"] == ngram), key=lambda r: r["part"])
    counts = [loosen(r["counts"], "<u8").astype(np.int64) for r in rows]
    owned = [np.unpackbits(loosen(r["owned"], "u1"))[: len(c)].astype(bool) for r, c in zip(rows, counts)]
    return np.concatenate(counts), np.concatenate(owned)


def _score(row: dict, answers: pa.Table, model: Model, parts: int) -> pa.Table:
    """A block's scores but for the backoff weights, its share of the contexts' sums, and the contexts it needs."""
    block = Block(row)
    order, _ = block.words()
    count = np.zeros(len(block.hashes), dtype=np.int64)
    count[order], _ = _answers(answers, 1)
    one = model.one_word(count)
    count_as_context = count.copy()
    count_as_context[START] = count[END]
    pairs, first, number = block.pairs()
    pair_count, owned = _answers(answers, 2)
    ctx, word = block.before[first], block.codes[first]
    seen = pair_count > 0
    size = len(block.hashes)

    with np.errstate(divide="ignore"):
        logs = np.where(seen, np.log10(np.maximum(model.discounted(pair_count, model.two), 1e-300) / np.maximum(1, count_as_context[ctx])), np.log10(one[word]))
    starts = np.cumsum(block.lengths) - block.lengths
    doc = np.add.reduceat(logs[number], starts)
    del logs
    known = np.add.reduceat((count[block.codes] > 0).astype(np.int64), starts)
    base = np.log10((count + ADD) / (model.tokens + ADD * (model.distinct + 1)))
    base = np.add.reduceat(base[block.codes], starts)
    out = [{"kind": "docs", "block": row["block"], "doc": doc.tolist(), "known": known.tolist(), "base": base.tolist()}]

    # A context whose pairs are all frequent leaves no mass; only one of which no rare pair is here can be such.
    rare = np.zeros(size, dtype=bool)
    rare[ctx[seen & (pair_count <= KATZ)]] = True
    unseen, unsure = ~seen & (count_as_context[ctx] > 0), seen & ~rare[ctx]
    of_doc = np.repeat(np.arange(len(starts)), block.lengths)
    wanted = np.nonzero((unseen | unsure)[number])[0]
    key, times = np.unique((of_doc[wanted] * size + block.before[wanted]) * 2 + unsure[number][wanted], return_counts=True)
    needs_doc, needs_ctx, needs_kind = key // (2 * size), key // 2 % size, key % 2

    own = owned & seen
    total, likely = (np.bincount(ctx[own], x[own], size) for x in (pair_count, one[word]))
    # How many pairs of each small count a context has tells what its discounts leave.
    small = [np.bincount(ctx[own & (pair_count == r)], minlength=size) for r in range(1, KATZ + 1)]
    needed = np.zeros(size, dtype=bool)
    needed[needs_ctx] = True
    used = np.nonzero((total > 0) | needed)[0]
    used = used[np.argsort(block.hashes[used])]
    place = np.cumsum(needed[used]) - 1
    rank = np.zeros(size, dtype=np.int64)
    rank[used] = place
    out.append({"kind": "needs", "block": row["block"], "a": squeeze(needs_doc.astype("<u4")), "b": squeeze(rank[needs_ctx].astype("<u4")), "c": squeeze(needs_kind.astype("u1")), "d": squeeze(times.astype("<u4"))})
    hashes = block.hashes[used]
    at = cuts(hashes, parts)
    for part, (a, b) in enumerate(zip(at, at[1:])):
        if a < b:
            k = used[a:b]
            whole = np.concatenate([total[k], *(n[k] for n in small)]).astype("<u8")
            out.append({"kind": "context", "part": part, "block": row["block"], "a": squeeze_sorted(hashes[a:b]), "b": squeeze(whole), "c": squeeze(likely[k]), "d": squeeze(np.packbits(needed[k]))})
    return pa.Table.from_pylist(out, _arrow(SCORED))


def _weigh(rows: pa.Table, model: Model) -> pa.Table:
    """Backoff weights of one partition's contexts, as logarithms, for the blocks that need them."""
    rows = sorted(rows.select(["part", "block", "a", "b", "c", "d"]).to_pylist(), key=lambda r: r["block"])
    hashes = [loosen_sorted(r["a"]) for r in rows]
    _, number = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.concatenate([loosen(r["b"], "<u8").reshape(KATZ + 1, -1) for r in rows], axis=1).astype(float)
    total, *small = (np.bincount(number, c) for c in counts)
    one = np.bincount(number, np.concatenate([loosen(r["c"], "<f8") for r in rows]))
    discounted = total - sum(r * n * (1 - model.two[r]) for r, n in enumerate(small, 1))
    spent = total - discounted <= 1e-9 * total
    total_ = np.where(spent, total + 1, total)
    backoff = np.log10(np.maximum((total_ - discounted) / np.maximum(total_, 1), 1e-300) / np.maximum(1 - one, 1e-300))
    correction = np.where(spent, np.log10(np.maximum(total, 1) / np.maximum(total_, 1)), 0.0)
    out, at = [], 0
    for r, h in zip(rows, hashes):
        k = number[at : at + len(h)][np.unpackbits(loosen(r["d"], "u1"))[: len(h)].astype(bool)]
        at += len(h)
        if len(k):
            out.append({"part": r["part"], "block": r["block"], "backoff": squeeze(backoff[k]), "correction": squeeze(correction[k])})
    return pa.Table.from_pylist(out, _arrow(WEIGHED))


def _parts(rows: int | None, part_rows: int) -> int:
    return max(1, math.ceil((rows or 0) / part_rows))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", train: str = "train", block_tokens: int = BLOCK_TOKENS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``; the model learns from the rows with ``train``.

    Tokens are the words of a text, A-Z lowered, and one end. Null and empty texts are the end alone. A null
    ``train`` counts as false. Repeated rows are counted and scored one by one; null keys are kept. A long text
    stays whole in one block, which it ends. Other columns are left out, whatever their names. Words and pairs whose
    64-bit hashes clash count as one. Without training rows every text scores zero. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = bucketed(encoded(rows, block_tokens), "block")
    sizes = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    parts = _parts(sizes["words"], part_rows), _parts(sizes["tokens"], part_rows)
    counted = checkpoint(_asked(blocks, parts).groupBy("ngram", "part").applyInArrow(_count, ANSWERED))
    sums = {
        (r["ngram"], r["pos"]): r["n"]
        for r in counted.where("kind = 'table'").select("ngram", F.posexplode("n").alias("pos", "n")).groupBy("ngram", "pos").agg(F.sum("n").alias("n")).collect()
    }
    model = Model(*([sums.get((ngram, i), 0) for i in range(KATZ + 3)] for ngram in (1, 2)))
    context_parts = parts[0]

    def scored(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left.to_pylist()[0], right, model, context_parts)

    answers = counted.where("kind = 'answer'").select("block", "ngram", "part", "counts", "owned")
    found = checkpoint(
        blocks.drop("ids").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, SCORED)
    )

    def weigh(rows: pa.Table) -> pa.Table:
        return _weigh(rows, model)

    weights = found.where("kind = 'context'").groupBy("part").applyInArrow(weigh, WEIGHED)
    id_kind = docs.schema[key].dataType
    result = T.StructType([T.StructField("id", id_kind), *T.StructType.fromDDL("train boolean, n_tokens long, n_known long, base_score double, score double").fields])

    def finished(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        # The block's docs and needs come in one row each.
        row = left.to_pylist()[0]
        score = np.array(row["doc"])
        doc, place, kind, times = (loosen(row[c], t) for c, t in (("a", "<u4"), ("b", "<u4"), ("c", "u1"), ("d", "<u4")))
        if len(doc):
            answers = sorted(right.to_pylist(), key=lambda r: r["part"])
            backoff, correction = (np.concatenate([loosen(r[c], "<f8") for r in answers]) for c in ("backoff", "correction"))
            score = score + np.bincount(doc, times * np.where(kind == 1, correction[place], backoff[place]), len(score))
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table(
            [ids, pa.array(row["train"], pa.bool_()), pa.array(row["lengths"], pa.int64()), pa.array(row["known"], pa.int64()), pa.array(row["base"]), pa.array(score)],
            names=["id", "train", "n_tokens", "n_known", "base_score", "score"],
        )

    per_block = (
        blocks.select("block", "ids", "train", "lengths")
        .join(found.where("kind = 'docs'").select("block", "doc", "known", "base"), "block")
        .join(found.where("kind = 'needs'").select("block", "a", "b", "c", "d"), "block")
    )
    return (
        per_block.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(finished, result)
        .select(F.col("id").alias(key), "train", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )
