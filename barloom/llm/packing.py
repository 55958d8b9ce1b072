"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays inside a piece). Documents are
dealt to groups of bounded size; in a group, pieces in descending length go to the sequence of lowest cost
that has room for them. Only when none has room is a piece cut, into the sequences with most room.
A group has the least number of sequences that holds its tokens, so at most one sequence's worth of it is padding.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import held, text_or_empty

LENGTH = 2048
#: Bytes of text that a group holds, about (documents are dealt by hash), and rows equal in key and text that go together.
GROUP_CHARS, EQUAL_ROWS = 4_000_000, 16
#: Words that a worker remembers, words of texts that are worked on at once, and new words at once.
REMEMBERED, WORDS_AT_ONCE, AT_ONCE = 3 << 17, 200_000, 20_000
#: Marks at the end of a word that follow a Latin-1 letter or digit.
MARKS = re.compile("[.,;:!?](?<=[%s].)[.,;:!?]*(?=[ \n]|\\Z)" % "".join(c for c in map(chr, range(256)) if c.isalnum()))
#: Byte-level tokenizers write bytes that are no visible character as the characters from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _bytes_as_characters(word: str) -> str | None:
    """The word as a byte-level tokenizer writes it; None if it isn't all Latin-1."""
    if word.isascii():
        return word
    return word.encode().decode("latin-1").translate(BYTES) if _is_latin(word) else None


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, word by word, with words remembered.

    Special tokens that are written in a text have their own ids, as in the library's plain call.
    """

    def __init__(self, data: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4"
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}

    def learn(self, texts: list[list[str]]) -> None:
        """Know all words of ``texts``; if too many are known, the others are forgotten."""
        known = self.known
        used = set().union(*texts)
        new = used.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {w: known[w] for w in used if w in known} | {"": b""}
        others: list[str] = []
        merges, code = self.tokenizer.model.tokenize, "HI"[self.kind == "<u4"]
        for w in new:
            # Latin-1 letters alone need no splitting and are in normal form once lowered: the model's merges will do.
            if w.isalpha() and (raw := _bytes_as_characters(w.lower())) is not None:
                known[w] = array(code, [x.id for x in merges(raw)]).tobytes()
            else:
                others.append(w)
        for at in range(0, len(others), AT_ONCE):
            some = others[at : at + AT_ONCE]
            got = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            known.update((w, array(code, x.ids).tobytes()) for w, x in zip(some, got))

    def words(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after the other, are those of the text; lowered if nothing but Latin-1 is in it."""
        # The tokenizer drops spaces and line ends and merges nothing across them. Marks after a Latin-1 letter or digit
        # are never merged with it, nor changed by it.
        if text.isascii() or _is_latin(text):
            low = text.lower()
            if not any(name in low for name in self.special):
                text = low
        return MARKS.sub(r" \g<0>", text).replace("\n", " ").split(" ")

    def encode(self, texts: Iterable[str], end: bytes) -> list[bytes]:
        """The ids of each text and ``end``. Texts are taken as they are needed."""
        out: list[bytes] = []
        split: list[list[str]] = []
        size = 0

        def told() -> Iterator[bytes]:
            self.learn(split)
            known = self.known.__getitem__
            return (b"".join(map(known, words)) + end for words in split)

        for text in texts:
            split.append(self.words(text))
            size += len(split[-1])
            if size > WORDS_AT_ONCE:
                out += told()
                split, size = [], 0
        return out + list(told())


def _tokenizer(data: str) -> WordTokenizer:
    return held(("words", hash(data)), lambda: WordTokenizer(data))


def assign(lengths: list[int], capacity: int = LENGTH) -> list[list[tuple[int, int, int, int]]]:
    """For each document, its pieces ``(start, length, sequence, offset)``; sequences number from 0."""
    total = sum(lengths)
    n = math.ceil(total / capacity)
    room, cost = np.full(n, capacity, dtype=np.int64), np.zeros(n)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]

    def put(doc: int, start: int, length: int, s: int) -> None:
        out[doc].append((start, length, s, int(capacity - room[s])))
        room[s] -= length
        cost[s] += LINEAR * length + QUADRATIC * length * length

    whole = 0  # pieces that fill a sequence need no search
    rest: list[tuple[int, int, int]] = []
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= capacity:
            put(doc, start, capacity, whole)
            whole += 1
            start += capacity
        if start < length:
            rest.append((length - start, doc, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    room_, cost_ = room[whole:], cost[whole:]  # views
    for length, doc, start in rest:
        s = int(np.argmin(np.where(room_ >= length, cost_, np.inf)))
        if room_[s] >= length:
            put(doc, start, length, whole + s)
            continue
        for s in np.argsort(-room_, kind="stable").tolist():
            part = min(length, int(room_[s]))
            put(doc, start, part, whole + s)
            start, length = start + part, length - part
            if not length:
                break
    return out


def token_ids(spark: SparkSession, tokenizer_file: str, text: Column, row: Column, end_id: int) -> tuple[Column, str]:
    """A struct of ``ids``, each text's and ``end_id`` after them, in a binary of the numpy type that is also returned,
    and ``nth``, how many rows of the same number ``row`` its partition had before."""
    with open(tokenizer_file, encoding="utf-8") as f:
        data = spark.sparkContext.broadcast(f.read())
    kind = WordTokenizer(data.value).kind

    @F.arrow_udf("ids binary, nth long")
    def ids(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(data.value)
        end = np.array([end_id], dtype=tokenizer.kind).tobytes()
        seen: Counter = Counter()
        for texts, rows in batches:
            nth = []
            for row in rows.to_pylist():
                nth.append(seen[row])
                seen[row] += 1
            found = pa.array(tokenizer.encode((t.as_py() for t in texts), end), pa.binary())
            yield pa.StructArray.from_arrays([found, pa.array(nth, pa.int64())], names=["ids", "nth"])

    return ids(text, row), kind


def pack(
    docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text",
    end_id: int = 1, capacity: int = LENGTH, group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """One row per piece: ``key``, ``start`` (ids of its document before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` (its place in the sequence, gapless from 0).

    Null and empty texts have the end id alone. Rows count one by one, so repeated rows and null keys are
    packed like any other. A text of any length is tokenised whole and cut into pieces. An empty table gives no
    rows. Other columns, whatever their names, are ignored. Sequences are padded to ``capacity`` by whoever reads them.

    A row's group depends on its key, its text, its partition and on how many equal rows the partition has, and
    not on the order of rows, so a task that is run again deals them alike. Ties in length go by that number.
    """
    spark = docs.sparkSession
    sizes = docs.agg(F.sum(F.octet_length(text)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, math.ceil(((sizes["n"] or 0) + sizes["rows"]) / group_chars))
    ids, kind = token_ids(spark, tokenizer_file, F.col("body"), F.col("row"), end_id)
    rows = (
        docs.select(F.col(key).alias("id"), text_or_empty(text).alias("body"), F.xxhash64(key, text, F.spark_partition_id()).alias("row"))
        .select("id", "row", ids.alias("found"))
        .select("id", "row", "found.*")
        .withColumn("grp", F.pmod(F.xxhash64("row", F.floor(F.col("nth") / EQUAL_ROWS)), F.lit(groups)))
    )
    out = T.StructType(
        [T.StructField("id", docs.schema[key].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.BinaryType())]
    )

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("row", "ascending"), ("nth", "ascending")])
        tokens = [np.frombuffer(x, dtype=kind) for x in rows["ids"].to_pylist()]
        base = rows["grp"][0].as_py() << 32
        found = [
            (doc, start, n, len(tokens[doc]), base + s, offset, tokens[doc][start : start + n].astype("<u4").tobytes())
            for doc, pieces in enumerate(assign([len(x) for x in tokens], capacity))
            for start, n, s, offset in pieces
        ]
        doc, *cols = zip(*found)
        ids = rows["id"].take(pa.array(doc, pa.int64())).combine_chunks()
        numbers = [pa.array(c, pa.int64()) for c in cols[:-1]]
        return pa.table([ids, *numbers, pa.array(cols[-1], pa.binary())], names=out.fieldNames())

    return rows.groupBy("grp").applyInArrow(packed, out).withColumnRenamed("id", key)
