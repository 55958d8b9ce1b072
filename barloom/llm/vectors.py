"""Near-duplicate vectors by a pivot-permutation index.

Vectors are described by their nearest reference points (pivots) in order, both less the vectors' common mean. The
inverted lists are kept for sets of ``SHARED`` pivots: a vector is listed under every such set among its nearest
pivots, so two vectors meet in a list exactly if they have at least ``SHARED`` of their nearest pivots in common.
What meets is verified by its cosine in double precision. Long lists are cut into blocks, and each pair of blocks is
a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint
from barloom.llm.components import connected_components

COSINE = 0.9
#: Pivots grow with the square root of the distinct vectors between these bounds, so that lists keep their length up to the
#: upper one, and what is broadcast is bounded by it.
FEWEST_PIVOTS, MOST_PIVOTS = 64, 4096
#: The index is fitted on so many vectors for each pivot, and on so many pairs of a cosine of about the threshold: made-up ones,
#: and those between so many vectors of the sample, if there are some.
SAMPLE, LEAST_SAMPLE, PAIRS, PAIRED, SOME = 4, 2048, 1000, 4096, 50
#: No two pivots are closer than the first of these; where that leaves too few, than the next.
APART = (0.7, 0.85, 0.95)
#: How many of their nearest pivots two vectors must share, and the share of the made-up pairs that must do so: as many
#: nearest pivots describe a vector as that takes, in these bounds.
SHARED, RECALL, FEWEST_NEAREST, MOST_NEAREST = 2, 0.97, 4, 24
#: Vectors of one list that one task compares with as many others, at most.
BLOCK = 2048
#: Rows of short lists that are compared list by list in one task, about.
BUNDLE = 20_000


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of a column of lists of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit vectors less their mean, as unit vectors again; one that is the mean itself is zero."""
    x = x - mean
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first; ties go to the lower number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest]


@dataclass(frozen=True)
class Index:
    """The mean of unit vectors, the pivots less it, and how many nearest ones describe a vector."""

    mean: np.ndarray
    pivots: np.ndarray
    nearest: int
    shared: int

    def order(self, x: np.ndarray, nearest: int | None = None) -> np.ndarray:
        return nearest_pivots(centred(x, self.mean), self.pivots, nearest or self.nearest)


def _pairs(x: np.ndarray, cosine: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of just this cosine: partners in any direction, in directions in which the vectors differ, and found ones."""
    one, other, third = (x[rng.integers(0, len(x), PAIRS)] for _ in range(3))
    out = []
    for way in (rng.normal(size=one.shape), other - third + 1e-9 * rng.normal(size=one.shape)):
        way = way - (way * one).sum(1, keepdims=True) * one
        way = way / np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-300)
        out.append((one, cosine * one + np.sqrt(max(0.0, 1 - cosine * cosine)) * way))
    y, a, b = x[:PAIRED], [], []
    for at in range(0, len(y), 512):
        c = y[at : at + 512] @ y.T
        i, j = np.nonzero((c >= cosine) & (c < cosine + (1 - cosine) / 4))
        a.append(i + at)
        b.append(j)
    i, j = np.concatenate(a), np.concatenate(b)
    if len(i) >= SOME:
        k = rng.permutation(len(i))[:PAIRS]
        out.append((y[i[k]], y[j[k]]))
    return out


def fit(x: np.ndarray, pivots: int, shared: int = SHARED, cosine: float = COSINE, recall: float = RECALL, most: int = MOST_NEAREST, seed: int = 7) -> Index:
    """The index of a sample of unit vectors in the order in which they may become pivots."""
    mean = x.mean(axis=0)
    y = centred(x, mean)
    chosen = np.zeros((min(pivots, len(x)), x.shape[1]))
    taken, n = np.zeros(len(y), dtype=bool), 0
    for apart in APART:
        for i in np.nonzero(~taken)[0].tolist():
            if n < len(chosen) and (n == 0 or (chosen[:n] @ y[i]).max() < apart):
                chosen[n], taken[i], n = y[i], True, n + 1
        if n == len(chosen):
            break
    index = Index(mean, chosen[:n], 0, min(shared, n))
    most = min(most, n)
    orders = [(index.order(a, most), index.order(b, most)) for a, b in _pairs(x, cosine, np.random.default_rng(seed))]
    nearest = min(FEWEST_NEAREST, most)
    while nearest < most:
        meet = [((a[:, :nearest, None] == b[:, None, :nearest]).sum((1, 2)) >= index.shared).mean() for a, b in orders]
        if min(meet) >= recall:
            break
        nearest += 1
    return replace(index, nearest=nearest)


def set_numbers(order: np.ndarray, shared: int, pivots: int) -> np.ndarray:
    """A number for each set of ``shared`` pivots of a row, in a column of its own for each choice of places."""
    rows = np.sort(order, axis=1).astype(np.int64)
    out = []
    for places in combinations(range(rows.shape[1]), shared):
        key = np.zeros(len(rows), dtype=np.int64)
        for p in places:
            key = key * pivots + rows[:, p]
        out.append(key)
    return np.stack(out, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _describe(vectors: DataFrame, index: Index) -> DataFrame:
    """``vectors`` (``node``, ``copies``, ``vector``) with ``sets``, the numbers of its pivot sets in order."""
    sent = vectors.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("array<long>")
    def sets(column: pa.Array) -> pa.Array:
        index = sent.value
        found = np.sort(set_numbers(index.order(_matrix(column)), index.shared, len(index.pivots)), axis=1)
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.reshape(-1))

    return vectors.withColumn("sets", sets("vector"))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest number each of ``n`` nodes is connected to by the links ``a``-``b``."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(node: np.ndarray, copies: np.ndarray, x: np.ndarray, sets: np.ndarray, mine: np.ndarray, key: int, first: int, second: int, threshold: float):
    """Links within one pair of blocks of one list. A pair that meets in several lists counts in the first only."""
    left, right = np.nonzero(mine == first)[0], np.nonzero(mine == second)[0]
    i, j = np.nonzero(x[left] @ x[right].T >= threshold - 1e-9)
    a, b = left[i], right[j]
    if first == second:
        a, b = a[a < b], b[a < b]
    found = []
    for at in range(0, len(a), 1 << 16):
        p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        keep = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
        for c in range(sets.shape[1]):  # an earlier set that both have
            s = sets[p, c]
            if not (s < key).any():
                break
            keep &= ~((s < key) & (sets[q] == s[:, None]).any(axis=1))
        found.append(np.stack([p, q])[:, keep])
    if not found:
        return None
    p, q = np.concatenate(found, axis=1)
    n = len(node)
    links = (np.bincount(p, copies[q], n) + np.bincount(q, copies[p], n)).astype(np.int64)
    root = _forest(n, p, q)
    used = links > 0
    return node[used], node[root[used]], links[used]


def _compare(rows: pa.Table, threshold: float) -> pa.Table:
    """For each list and pair of blocks: how many copies each node is linked to, and a forest of the links."""
    names = ("key", "first", "second", "node", "copies", "block")
    key, first, second, node, copies, mine = (rows[c].to_numpy() for c in names)
    order = np.lexsort((node, second, first, key))
    key, first, second, node, copies, mine = (v[order] for v in (key, first, second, node, copies, mine))
    x, sets = _matrix(rows["vector"])[order], _sets(rows["sets"])[order]
    new = (np.diff(key) != 0) | (np.diff(first) != 0) | (np.diff(second) != 0)
    starts = np.concatenate([[0], np.nonzero(new)[0] + 1, [len(key)]])
    found = [np.zeros((3, 0), dtype=np.int64)]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        one = slice(a, b)
        if (got := _links(node[one], copies[one], x[one], sets[one], mine[one], key[a], first[a], second[a], threshold)) is not None:
            found.append(np.stack(got))
    node, root, links = np.concatenate(found, axis=1)
    return pa.table({"node": node, "root": root, "links": links})


def _sets(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fitted(vectors: DataFrame, rows: int, threshold: float, shared: int, pivots: int | None) -> Index:
    """The index for distinct ``vectors`` of one length, of which there are ``rows``: fitted on those of smallest hash."""
    pivots = pivots or int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, np.ceil(np.sqrt(rows)))))
    sample = vectors.select("vector").orderBy(F.xxhash64("vector"), "node").limit(max(LEAST_SAMPLE, SAMPLE * pivots)).toArrow()
    return fit(_matrix(sample["vector"]), pivots, shared, threshold)


def _linked(vectors: DataFrame, index: Index, threshold: float, block: int) -> DataFrame:
    listed = _describe(vectors, index).withColumn("key", F.explode("sets")).select("key", "node", "copies", "vector", "sets")
    sizes = checkpoint(
        listed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("n", F.ceil(F.col("rows") / block).cast("int"))
    )
    short = sizes.where("n = 1").agg(F.sum("rows")).first()[0] or 0
    # Each vector goes to every pair of blocks that has its own block; many short lists make one task's group.
    dealt = (
        listed.join(sizes.drop("rows"), "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .withColumn("bundle", F.when(F.col("n") > 1, F.col("key")).otherwise(-1 - F.pmod(F.xxhash64("key"), F.lit(short // BUNDLE + 1))))
        .drop("n", "other")
    )

    def compare(rows: pa.Table) -> pa.Table:
        return _compare(rows, threshold)

    return dealt.groupBy("bundle", "first", "second").applyInArrow(compare, "node long, root long, links long")


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = COSINE,
    pivots: int | None = None, shared: int = SHARED, block: int = BLOCK, hashed: Callable[..., Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``vectors``: ``key``, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other rows found with a cosine of ``threshold`` or more (never fewer than are linked
    by it); ``component_id`` is the smallest key reachable by links, itself included.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Vectors of
    different length don't link. Equal vectors are compared once, as one node with its number of copies. A row
    with a null key links as any other and has the id of its component, or null if it is alone. A cosine of exactly
    ``threshold`` in double precision links; one that rounding alone keeps below it doesn't. Repeated rows
    are copies of each other. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = checkpoint(
        vectors.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("raw"))
        .withColumn("vector", F.when(usable(F.col("raw")), F.transform("raw", lambda x: F.when(x == 0, 0).otherwise(x)).cast(kind)))
        .select("id", "vector", F.coalesce(F.size("vector"), F.lit(0)).alias("width"), hashed("vector").alias("node"))
    )
    # Different vectors of one hash, if there are any, are told apart by another hash.
    several = checkpoint(
        rows.where("vector IS NOT NULL").groupBy("node").agg(F.min(F.xxhash64("vector", F.lit(1))).alias("a"), F.max(F.xxhash64("vector", F.lit(1))).alias("b")).where("a < b").select("node")
    )
    if not several.isEmpty():
        rows = checkpoint(
            rows.join(several.withColumn("again", F.lit(True)), "node", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("vector", F.lit(1))).otherwise(F.col("node"))).drop("again")
        )
    good = rows.where(F.col("vector").isNotNull())
    distinct = checkpoint(
        good.groupBy("width", "node", "vector").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    )
    found: DataFrame | None = None
    for width, n in distinct.groupBy("width").count().collect():  # the lengths of vectors are few
        same_width = distinct.where(F.col("width") == width)
        part = _linked(same_width, fitted(same_width, n, threshold, shared, pivots), threshold, block)
        found = part if found is None else found.unionAll(part)
    if found is None:
        linked = distinct.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("component"))
    else:
        found = checkpoint(found)
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        parts = connected_components(found.where("node <> root").select("node", "root"), "node", "root")
        linked = links.join(parts, "node", "left").select("node", "links", F.coalesce("component", "node").alias("component"))
    nodes = checkpoint(
        distinct.select("node", "least_id", "copies")
        .join(linked, "node", "left")
        .select("node", "least_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    )
    least = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = nodes.join(least, "component").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    of_good = good.select("id", "node").join(labels, "node").select("id", "n_links", "component_id")
    alone = rows.where(F.col("vector").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return of_good.unionAll(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
