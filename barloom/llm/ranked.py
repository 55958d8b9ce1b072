"""Ranked lexical search, score at a time over postings in the order of their impact.

An impact is the whole number that a term's occurrences add to a document's score before the term's weight.
One pass over the texts keeps the occurrences of the terms that are asked for, with each document's length.
Those rows are read in shards of a bounded number of postings. In a shard a term's postings stand in descending
impact, equal ones together, and each query takes its terms' groups from the largest product of weight and
impact down. What the next group of each term could add bounds all that has not been read: once no document
outside the best can reach the k-th of them any more, reading ends and the scores of the documents that still can
are completed from their own rows. A task carries its k-th score from shard to shard, and gives k rows a query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barloom.llm.common import checkpoint

#: Documents told for each query.
BEST = 50
#: Terms of a block of queries, about; each block is a pass of its own, so that what is sent to the executors is bounded.
BLOCK_TERMS = 200_000
#: Postings of a shard, about.
SHARD_POSTINGS = 1_000_000
#: Bytes that are cut into terms at once.
STEP = 1 << 24
#: Candidates at which reading ends, in multiples of the documents told.
ROOM = 4
#: Parts of a query's rows that are cut to the best on their own before all are.
SALTS = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8: letters and digits of ASCII and all beyond it belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def counts_of(text: bytes) -> Counter:
    """How often each term occurs in a text in UTF-8."""
    folded = text.translate(_FOLD)
    counts: Counter = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + STEP)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """The postings of some documents; ``ids`` are their keys."""

    def __init__(self, ids: list, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, n_terms: int):
        self.ids, self.terms = ids, terms
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(len(ids)), counts)
        self.impact = 1_000_000_000 * tfs // (1000 * tfs + 20 * m[doc])
        order = np.lexsort((-self.impact, terms))
        self.doc, self.falling = doc[order], -self.impact[order]  # ascending: minus the impact, term by term
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.scores = np.zeros(len(ids), dtype=np.int64)

    def best(self, query: list[int], weights: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, document) of this shard's best ``k`` for the terms of ``query``, those of equal last score too;
        only documents that reach ``least`` count."""
        at = [(int(weights[t]), int(self.bounds[t]), int(self.bounds[t + 1])) for t in query]
        at = [(w, a, b) for w, a, b in at if w > 0 and a < b]
        scores = self.scores
        scores.fill(0)
        heads = [-w * int(self.falling[a]) for w, a, _ in at]
        rest = sum(heads)
        floor = max(least, 1)
        while rest:
            level = (max(heads) + 1) // 2
            for i, (w, a, b) in enumerate(at):
                if heads[i] >= level:
                    end = a + int(np.searchsorted(self.falling[a:b], -level // w, side="right"))
                    scores[self.doc[a:end]] -= w * self.falling[a:end]
                    at[i] = w, end, b
                    heads[i] = -w * int(self.falling[end]) if end < b else 0
            rest = sum(heads)
            if len(scores) > k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            if rest < floor and np.count_nonzero(scores >= floor - rest) <= ROOM * k:
                break
        found = np.nonzero(scores >= max(floor - rest, 1))[0]
        if rest and len(found):
            found_scores = self._whole(found, query, weights)
        else:
            found_scores = scores[found]
        keep = found_scores >= floor
        return list(zip(found_scores[keep].tolist(), found[keep].tolist()))

    def _whole(self, docs: np.ndarray, query: list[int], weights: np.ndarray) -> np.ndarray:
        """The full scores of some documents, from their own postings."""
        asked = np.zeros(len(weights), dtype=np.int64)
        asked[query] = weights[query]
        sizes = self.starts[docs + 1] - self.starts[docs]
        firsts = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[docs] - firsts, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(asked[self.terms[at]] * self.impact[at], firsts)


def _order(key) -> tuple:
    return (key is None, key)


def _postings(docs: DataFrame, key: str, text: str, numbers) -> DataFrame:
    """Of each document its key, its number of terms, and the numbers and occurrences of the terms asked for."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("n long, terms array<int>, tfs array<long>").fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value
        for batch in batches:
            sizes, terms, tfs, offsets = [], [], [], [0]
            for text in batch.column(1):
                counts = counts_of(text.as_py() or b"")
                sizes.append(counts.total())
                asked = number.keys() & counts.keys()
                terms += [number[t] for t in asked]
                tfs += [counts[t] for t in asked]
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))],
                names=["id", "n", "terms", "tfs"],
            )

    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(of, schema)


def _search(postings: DataFrame, model, k: int, shard_postings: int) -> DataFrame:
    """Each task's best ``k`` documents of each query, by number; ``model`` is the broadcast queries and statistics."""
    kind = postings.schema["id"].dataType
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, total = model.value
        best: list[list[tuple]] = [[] for _ in queries]
        held: list[pa.RecordBatch] = []

        def run() -> None:
            rows = pa.Table.from_batches(held)
            lists = rows.column("terms").combine_chunks()
            n = rows.column("n").to_numpy()
            shard = Shard(
                rows.column("id").to_pylist(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(),
                rows.column("tfs").combine_chunks().flatten().to_numpy(), 50 + 50 * n * documents // max(total, 1), len(weights),
            )
            for q, query in enumerate(queries):
                least = best[q][-1][2] if len(best[q]) == k else 1
                found = [(-s, _order(shard.ids[d]), s, shard.ids[d]) for s, d in shard.best(query, weights, k, least)]
                if found:
                    best[q] = sorted(best[q] + found)[:k]
            held.clear()

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held.append(part)
                size += len(part.column("terms").flatten())
                if size >= shard_postings:
                    run()
                    size = 0
        if held:
            run()
        rows = [(q, r[3], r[2]) for q, found in enumerate(best) for r in found]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), id_type, pa.int64()))], names=["query", "id", "score"])

    id_type = to_arrow_type(kind)
    return postings.mapInArrow(of, schema)


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    k: int = BEST, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each value of ``item``: ``item``, ``rank``, ``key``, ``score``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered, of whole texts.
    Null and empty texts have none: such documents aren't found, such items get no rows. Rows of one item (null is
    one, too) are one query of all their terms, each once. Equal scores go by ascending key, null keys last;
    documents that repeat a key are ranked one by one. Empty tables give no rows. Other columns may have any names.
    Queries are worked on in blocks of about ``block_terms`` terms, each one pass over all documents; what a block
    sends to the executors is its own terms, their weights and its queries. A query's own terms are never divided.
    """
    spark = docs.sparkSession
    asked = checkpoint(
        items.select(F.col(item).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(F.translate(item_text, _UPPER, _LOWER), F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    )
    blocks = max(1, math.ceil(asked.count() / block_terms))
    item_kind = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", items.schema[item].dataType)])
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        terms = sorted({r["term"] for r in rows})
        number = {t.encode(): i for i, t in enumerate(terms)}
        names = sorted({r["item"] for r in rows}, key=_order)
        place = {name: i for i, name in enumerate(names)}
        queries: list[list[int]] = [[] for _ in names]
        for r in rows:
            queries[place[r["item"]]].append(number[r["term"].encode()])
        postings = checkpoint(_postings(docs, key, text, spark.sparkContext.broadcast(number)))
        sums = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
        df = {r["term"]: r["df"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        weights = np.array([weight(sums["documents"], df.get(i, 0)) for i in range(len(terms))], dtype=np.int64)
        model = spark.sparkContext.broadcast((queries, weights, sums["documents"], sums["total"] or 0))
        best = _search(postings, model, k, shard_postings).withColumn("salt", F.spark_partition_id() % SALTS)
        order = [F.desc("score"), F.asc_nulls_last("id")]
        for groups in (["query", "salt"], ["query"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)
        one = best.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), item_kind)), "query").select(
            F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score"
        )
        found = one if found is None else found.unionAll(one)
    return found


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (row), total GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
