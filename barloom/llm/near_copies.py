"""Near copies: texts whose sets of word shingles overlap by four fifths or more (Jaccard), linked transitively.

Candidates agree on a band of minhash values or have SimHash fingerprints within two bits; each is verified on the two
whole sets. Members of a bucket are held against its least member. Those that are then still in different components
are told by what sets them off from the shingles that most texts of their group hold: two sets that overlap enough share
one of their rarest differences, so that only such pairs meet, no pair at ``LEAST`` or more is lost, and a large group
of edited copies of one text costs its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, held, rows_kept, slices, text_or_empty, written
from barloom.llm.components import connected_components
from barloom.llm.simhash import close_pairs, simhash

#: Words of a shingle, and the least overlap of near copies.
SHINGLE, LEAST = 5, 0.8
#: A pair at the least overlap shares no band once in (1 - LEAST**ROWS) ** -BANDS = 330,000 cases.
BANDS, ROWS = 32, 5
BLOCK = 1 << 12
SEED = 42
#: Words whose hashes a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 1 << 18, 64
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], hashes: _Words, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of ``shingle`` words; of all words if they are fewer; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - shingle + 1)
    x = np.zeros(n, dtype=np.uint64)
    for j in range(min(shingle, len(w))):
        x = _mixed(x + w[j : j + n] + np.uint64(j + 1))
    return np.unique(x)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of the minhash values of a set."""
    h = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), BLOCK):
        values = np.multiply.outer(h[i : i + BLOCK], _TIMES)
        values += _PLUS
        np.minimum(least, values.min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + column)
    return keys.view(np.int64)


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def node_of(words: list[bytes]) -> int:
    """A signed hash of the words in their order."""
    x = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return x - (1 << 64) if x >> 63 else x


def _told(batches: Iterator[pa.Array], of: Callable[[str], tuple], kind: pa.StructType) -> Iterator[pa.Array]:
    """A struct of ``kind`` for each text, whose words and sets go before the next text is taken."""
    for texts in slices(batches):
        columns = zip(*[of(t.as_py()) for t in texts])
        yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))


def _signed(text: Column, shingle: int) -> Column:
    @F.arrow_udf("node long, fp long, keys array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = held("near words", _Words)

        def one(t: str) -> tuple:
            words = _words(t)
            return node_of(words), simhash(t), bands(shingles(words, hashes, shingle))

        yield from _told(batches, one, pa.struct([("node", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))]))

    return of(text)


def _sets(text: Column, shingle: int) -> Column:
    @F.arrow_udf("node long, parts array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = held("near words", _Words)

        def one(t: str) -> tuple:
            words = _words(t)
            return node_of(words), shingles(words, hashes, shingle).view(np.int64)

        yield from _told(batches, one, pa.struct([("node", pa.int64()), ("parts", pa.list_(pa.int64()))]))

    return of(text)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets overlap by ``LEAST`` or more; two empty sets are equal and no pair."""
    one, other = (sets.select(F.col("node").alias(c), F.col("parts").alias(f"{c}_parts")) for c in "ab")
    sizes = F.size("a_parts") + F.size("b_parts")
    small, large = F.least(F.size("a_parts"), F.size("b_parts")), F.greatest(F.size("a_parts"), F.size("b_parts"))
    both = pairs.join(one, "a").join(other, "b").where(small / large >= LEAST)
    common = F.size(F.array_intersect("a_parts", "b_parts"))
    return both.where(common / (sizes - common) >= LEAST).select("a", "b")


def _fingerprinted(rows: DataFrame) -> DataFrame:
    """Pairs of nodes with fingerprints within two bits; of equal fingerprints the least node stands for the others."""
    nodes = rows.select("node", "fp").distinct()
    fps = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    equal = nodes.join(fps.withColumnRenamed("node", "least"), "fp").where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return close_pairs(fps).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(equal)


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with their ``part`` (component by ``links``), of the keys that hold more than one component."""
    parts = connected_components(links, "a", "b")
    placed = checkpoint(members.join(parts, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("part")))
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    return written(placed.join(mixed, "key"))


def _moved(sets: DataFrame, group: str | None) -> tuple[DataFrame, DataFrame]:
    """What sets each of ``sets`` off from the shingles that over half of its group hold: ``tokens``, those it has besides
    and those it lacks, ``d`` in all. ``far`` is ``9 * d - n``, ``near`` the least ``far`` of the group and ``mid`` its node.

    Then how often: ``often`` counts the sets of the group that differ by ``token``; where it is 1 there may be no row.
    """
    rows = sets.select((F.col(group) if group else F.lit(0)).alias("group"), "node", "part", "parts", F.size("parts").alias("n"))
    rows = checkpoint(rows.join(rows.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "group"))
    held_by = rows.select("group", "size", F.explode("parts").alias("token")).groupBy("group", "size", "token").agg(F.count(F.lit(1)).alias("held"))
    held_by = checkpoint(held_by.where("held > 1"))
    usual = held_by.where("2 * held > size").groupBy("group").agg(F.collect_list("token").alias("usual"))
    both = rows.join(usual, "group", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<bigint>")))
    tokens = F.concat(F.array_except("parts", "usual"), F.array_except("usual", "parts"))
    moved = both.select("group", "node", "part", "n", tokens.alias("tokens")).withColumn("d", F.size("tokens"))
    moved = checkpoint(moved.withColumn("far", F.expr("9 * d - n")))
    least = moved.groupBy("group").agg(F.min(F.struct("far", "node", "part")).alias("l"))
    least = least.select("group", F.col("l.far").alias("near"), F.col("l.node").alias("mid"), F.col("l.part").alias("mid_part"))
    often = F.expr("if(2 * held > size, size - held, held)")
    return moved.join(least, "group"), held_by.select("group", "token", often.alias("often"))


def _sharing(sets: DataFrame, group: str | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``sets`` (``node``, ``part``, ``parts``) in different parts and one ``group`` (a column; else all are one)
    that link all which overlap by four fifths or more.

    Sets of ``n`` and ``m`` shingles that differ from the usual ones of their group by ``d`` and ``e`` shingles, ``o`` of them the same, overlap
    so if ``9 * (d + e - 2 * o) <= n + m``, thus if ``18 * o`` is the sum of both ``far`` or more. Where that sum is 0 or less nothing need be
    shared: all such pairs hang together by the set nearest to the usual one, which is paired with each of them. For the others, differences
    are put in order, the rarest first. The one less far must share one of its first differences with the first of the other,
    which isn't linked to the nearest set; else the overlap is less. Behind the first that two share there must be enough others in both.
    """
    moved, often = _moved(sets, group)
    sure = moved.where("far + near <= 0 AND part != mid_part").select(F.least("node", "mid").alias("a"), F.greatest("node", "mid").alias("b"))
    rows = moved.select("group", "node", "part", "n", "d", "far", "near", F.explode("tokens").alias("token")).join(often, ["group", "token"], "left")
    rows = rows.withColumn("often", F.coalesce("often", F.lit(1)))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("often", "token")))
    rows = rows.withColumn("short", F.expr("place <= d + 1 - greatest(1, (far + 8) div 9, (far - near) div 18 + 1)"))
    rows = rows.withColumn("long", F.expr("far + near > 0 AND place <= d + 1 - greatest(1, (far + near + 17) div 18, d - n div 4)"))
    rows = rows.where("often > 1 AND (short OR long)").withColumn("rest", F.expr("d - place"))
    rows = checkpoint(rows.select("group", "token", "node", "part", "n", "far", "rest", "short", "long"))
    x, y = rows.where("short").alias("x"), rows.where("long").alias("y")
    both = F.expr("x.part != y.part AND x.far <= y.far AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n AND 18 * (1 + least(x.rest, y.rest)) >= x.far + y.far")
    met = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.token") == F.col("y.token")) & both)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).unionAll(sure).distinct()


def _links(rows: DataFrame, docs: DataFrame, body: Column, shingle: int) -> DataFrame:
    """Pairs of nodes that link all near copies: every verified candidate, but for those already in one component."""
    keys = rows.groupBy("node").agg(F.any_value("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("top")).where("head < top").drop("top")
    members = checkpoint(keys.join(heads, "key"))
    star = members.where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    star = checkpoint(star.unionAll(_fingerprinted(rows)).distinct())
    near = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = checkpoint(rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("r")).join(near, "node").select("node", "r.id", "r.mark"))
    d = docs.select(F.col(docs.columns[0]).alias("id"), F.xxhash64(body).alias("mark"), body.alias("body"))
    sets = checkpoint(
        d.join(texts, d["id"].eqNullSafe(texts["id"]) & (d["mark"] == texts["mark"]), "left_semi")
        .select(_sets(F.col("body"), shingle).alias("s")).select("s.*").dropDuplicates(["node"])
    )
    links = checkpoint(_verified(star, sets))
    open_ = _open(members, links)
    groups = written(connected_components(open_, "head", "node").withColumnRenamed("component", "group"))
    apart = sets.join(open_.select("node", "part").distinct(), "node").join(groups, "node")
    return links.unionAll(checkpoint(_verified(checkpoint(_sharing(apart, "group")), sets)))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``mark`` (a hash of the text) and ``component`` of each row of ``docs``.

    Texts link when the Jaccard overlap of their sets of ``shingle``-word shingles is ``LEAST`` or more. Words are
    cut at ASCII white space, A-Z count as a-z; fewer words than a shingle are one shingle. Null and wordless
    texts are equal to each other and link to nothing else. Repeated rows have a row each and one component. Texts of
    any length are read whole. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    body = text_or_empty(text)
    docs = docs.select(F.col(key), F.col(text))
    rows = checkpoint(docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("mark"), _signed(body, shingle).alias("s")).select("id", "mark", "s.*"))
    parts = connected_components(_links(rows, docs, body, shingle), "a", "b")
    return rows.select("id", "mark", "node").join(parts, "node", "left").select("id", "mark", F.coalesce("component", "node").alias("component"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key; all columns as they were.

    Null keys stand behind all others; of several rows with the key, the one whose text has the smallest hash stays.
    """
    least = F.min(F.struct(F.col("id").isNull(), "id", "mark"))
    kept = near_copies(docs, key, text, shingle).groupBy("component").agg(least.alias("r")).select("r.id", "r.mark")
    return rows_kept(docs, kept, key, F.xxhash64(text_or_empty(text)))
