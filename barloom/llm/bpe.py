"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece holds, for each span, the lowest rank of a pair that
starts there; the leftmost lowest pair is found by one descent from the root, and a merge updates the
leaves of the merged pair and of its live neighbours in logarithmic time. A piece of n bytes takes
O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import held

NONE = 1 << 62
#: Pieces of one generation that a worker remembers, and the longest piece it does so for.
REMEMBERED, REMEMBERED_LENGTH = 1 << 19, 64
#: Pieces that are worked on at once, and new ones that are merged at once.
PIECES_AT_ONCE, MERGED_AT_ONCE = 1 << 18, 1 << 13
#: Longer texts are cut into pieces one by one, not at once.
LONG_TEXT = 1 << 22


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece: the leftmost pair of lowest rank is merged until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    get = ranks.get
    after = list(range(1, n + 3))  # start of the next live part, by start
    before = list(range(-1, n + 1))
    size = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * size)
    tree[size : size + n - 1] = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    while (lowest := tree[1]) != NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != lowest:
                k += 1
        i = k - size
        j = after[i]
        end = after[i] = after[j]
        before[end] = i
        last = after[end] if end < n else 0
        tree[size + j] = NONE
        tree[size + i] = get(piece[i:last], NONE) if last and last - i <= longest else NONE
        h = before[i] if i else i
        if i:
            tree[size + h] = get(piece[h:end], NONE) if end - h <= longest else NONE
        for k in (size + j, size + i, size + h):  # the spans above each changed place
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pairs:
    """Ranks of pairs of parts, for arrays of them. A part is a token or a single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = top = max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks.get(bytes([i]), top + 1 + i) for i in range(256)])  # bytes without a rank have numbers above
        self.times = top + 257
        parts = {bytes([i]): n for i, n in enumerate(self.bytes.tolist())} | ranks
        found = {
            x * self.times + y: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (x := parts.get(token[:i])) is not None and (y := parts.get(token[i:])) is not None
        }
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.ranks = np.array([*map(found.get, self.keys.tolist()), NONE], dtype=np.int64)
        self.keys = np.append(self.keys, NONE)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.times + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids of pieces of about one length, little-endian; each has a segment tree, as in :func:`merge`, all make a merge at a time."""
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    levels = max(1, int(lengths.max() - 1).bit_length())
    size, rows = 1 << levels, len(pieces)
    width = size + 2
    place = np.arange(width)
    live = place < lengths[:, None]
    parts = np.full((rows, width), pairs.none)  # behind the end, and before the begin, is a part that no pair has
    parts[live] = pairs.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    tree = np.full((rows, 2 * size), NONE)
    tree[:, size:] = pairs(parts[:, :size], parts[:, 1 : size + 1])
    for k in range(levels - 1, -1, -1):
        below = tree[:, 2 << k : 4 << k]
        tree[:, 1 << k : 2 << k] = np.minimum(below[:, ::2], below[:, 1::2])
    after, before = np.tile(place + 1, (rows, 1)).ravel(), np.tile(place - 1, (rows, 1)).ravel()
    tree, parts, live = tree.ravel(), parts.ravel(), live.ravel()
    row = np.arange(rows)
    while True:
        lowest = tree[row * 2 * size + 1]
        row, lowest = row[lowest != NONE], lowest[lowest != NONE]
        if not len(row):
            break
        root, start = row * 2 * size, row * width
        k = np.ones(len(row), dtype=np.int64)
        for _ in range(levels):
            k *= 2
            k += tree[root + k] != lowest
        i = k - size
        j = after[start + i]
        end = after[start + j]
        after[start + i] = end
        before[start + end] = i
        live[start + j] = False
        parts[start + i] = lowest
        h = before[start + i]
        h = np.where(h < 0, width - 1, h)  # that place has no part
        left = pairs(parts[start + h], lowest)
        tree[root + size + j] = NONE
        tree[root + size + i] = pairs(lowest, parts[start + end])
        inside = h < size
        tree[(root + size + h)[inside]] = left[inside]
        for k in (size + j, size + i, np.where(inside, size + h, size + i)):
            for _ in range(levels):
                k = k >> 1
                tree[root + k] = np.minimum(tree[root + 2 * k], tree[root + 2 * k + 1])
    ids = parts[live]
    if len(ids) and ids.max() > pairs.none:
        raise KeyError("a byte has no rank")
    data = ids.astype("<u4").tobytes()
    ends = (4 * np.cumsum(live.reshape(rows, width).sum(1))).tolist()
    return [data[x:y] for x, y in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts by ranks and the pattern whose matches are the pieces; remembers short pieces.

    Memory of pieces has two generations: when the young one is full it becomes the old one, and an old piece
    that is met again is young again. So pieces in use stay known. New pieces of many texts are merged at once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = Pairs(ranks)
        self.tokens = {b: a for a, b in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, blocks: list[list[str]]) -> None:
        """Know all pieces of ``blocks``."""
        used = set().union(*blocks)
        new = used.difference(self.young)
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young = self.young, {}
            new = used
        young = self.young
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            if (ids := self.old.get(piece)) is None:
                data = piece.encode()
                if data in self.ranks:
                    ids = struct.pack("<I", self.ranks[data])
                elif len(data) <= REMEMBERED_LENGTH:
                    classes.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
                    continue
                else:
                    found = merge(data, self.ranks, self.longest)
                    ids = struct.pack(f"<{len(found)}I", *found)
            young[piece] = ids
        for some in classes.values():
            for at in range(0, len(some), MERGED_AT_ONCE):
                part = some[at : at + MERGED_AT_ONCE]
                young.update(zip([p for p, _ in part], merge_many([d for _, d in part], self.pairs)))

    def blocks(self, text: str) -> Iterable[list[str]]:
        if len(text) < LONG_TEXT:
            yield self.pattern.findall(text)
        else:
            found = (m[0] for m in self.pattern.finditer(text))
            while block := list(islice(found, PIECES_AT_ONCE)):
                yield block

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts are taken as they are needed."""
        out: list[list[bytes]] = []
        held: list[tuple[int, list[str]]] = []
        size = 0

        def told() -> None:
            self.learn([b for _, b in held])
            get = self.young.__getitem__
            for n, block in held:
                out[n].append(b"".join(map(get, block)))
            for piece in {p for _, b in held for p in b if len(p) > REMEMBERED_LENGTH}:
                del self.young[piece]

        for n, text in enumerate(texts):
            out.append([])
            for block in self.blocks(text):
                held.append((n, block))
                size += len(block)
                if size > PIECES_AT_ONCE:
                    told()
                    held, size = [], 0
        told()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _encoder(data: bytes, pattern: str) -> Encoder:
    return held(("bytes", hash(data), pattern), lambda: Encoder(parse_ranks(data), pattern))


class ByteBpe:
    """Columns that encode and decode with one rank file, which is sent to the executors once.

    The file's size bounds what is broadcast; executors don't read its path. Rows are worked on one by one, so repeated
    rows and other columns are no matter; texts of any length are encoded whole; an empty table gives no rows.
    """

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self._data = spark.sparkContext.broadcast(f.read())
        self._pattern = pattern

    def encode(self, text: Column) -> Column:
        """Ids of each text as little-endian unsigned 32-bit integers in a binary; null and empty texts
        have no ids. Each match of the pattern is encoded by itself; special tokens are ordinary text."""
        data, pattern = self._data, self._pattern

        @F.pandas_udf("binary")
        def encoded(texts: pd.Series) -> pd.Series:
            encoder = _encoder(data.value, pattern)
            return pd.Series(encoder.encode_all(t or "" for t in texts), dtype=object)

        return encoded(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of ids made by :meth:`encode`; null counts as no ids."""
        data, pattern = self._data, self._pattern

        @F.pandas_udf("binary")
        def decoded(ids: pd.Series) -> pd.Series:
            encoder = _encoder(data.value, pattern)
            return pd.Series([encoder.decode(x or b"") for x in ids], dtype=object)

        return decoded(ids)
