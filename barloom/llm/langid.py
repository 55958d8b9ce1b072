"""Language ID by a linear-chain conditional random field over the words of a text.

A position is a word, or a piece of one that is long: of text without spaces all is seen, at bounded work a position.

Word features are affixes, character n-grams and the word itself (the lexicon); transitions are learned
from windows that switch between languages. Forward-backward gives each word's probability of each
language; a text's language is the one with the largest mean.
"""

from __future__ import annotations

import random
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import excerpts, fresh, held
from barloom.llm.crf import Channel, Crf, Cut, windows_of

UNKNOWN = "und"
#: The classifier is fitted on excerpts of at most so many characters of at most so many different texts of each language.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 5_000
FEATURES, LEAST_COUNT = 200_000, 3
WINDOW, ROUNDS, RATE, L2 = 16, 60, 0.15, 1e-5
#: Words that are worked on in one row; longer texts are several, joined exactly.
SEQUENCE = 1024
WORDS_AT_ONCE = 150_000
#: Characters of a position; a longer word is several.
LONGEST = 40
REMEMBERED = 1 << 18
#: Numbers of a worker's table of three characters.
TABLE = 4_000_000
#: Texts below this share of their language are rejected.
LEAST_SCORE = 0.5
_EDGE = "".join(chr(i) for i in range(128) if not chr(i).isalpha())


def bare(word: str) -> str:
    """The word without ASCII marks and digits around it, in lower case; empty if it has no letter."""
    word = word.strip(_EDGE).lower()
    return word if word and any(map(str.isalpha, word)) else ""


def words_of(text: str) -> list[str]:
    """The words of a text; those over ``LONGEST`` characters, as of scripts without spaces, in consecutive pieces."""
    words = text.split()
    if len(text) <= LONGEST or max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def word_features(word: str) -> list[str]:
    w = f"^{word}$"
    pairs = map("".join, zip(w, w[1:]))
    triples = map("".join, zip(w, w[1:], w[2:]))
    return [w, *w[1:-1], *pairs, *triples, w[:5], w[-5:]]


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Crf | None:
    """A model of ``(text, language)`` pairs, or None without any; of ``FEATURES`` features at most, the most frequent."""
    labels = sorted({lang for _, lang in texts})
    if not labels:
        return None
    crf = Crf(labels, [Channel(word_features, len(labels))])
    numbers: dict[str, int] = {}
    per_label: dict[int, list[int]] = {i: [] for i in range(len(labels))}
    counts: Counter = Counter()
    for text, lang in texts:
        words = [b for w in words_of(text) if (b := bare(w))]
        counts.update(words)
        per_label[labels.index(lang)] += [numbers.setdefault(w, len(numbers)) for w in words]
    names: Counter = Counter()
    for w, n in counts.items():
        for f in set(word_features(w)):
            names[f] += n
    crf.channels[0].learn_names(names, FEATURES, LEAST_COUNT)
    parts = [(windows_of(np.array(ids, dtype=np.int64), WINDOW), k) for k, ids in per_label.items()]
    windows = np.concatenate([w for w, _ in parts])
    gold = np.concatenate([np.full_like(w, k) for w, k in parts])
    if len(windows):
        rng = random.Random(seed)
        for i in range(0, len(windows), 2):  # half of the windows go on in another one's text
            j, cut = rng.randrange(len(windows)), rng.randrange(1, WINDOW)
            windows[i, cut:], gold[i, cut:] = windows[j, cut:], gold[j, cut:]
        crf.fit([list(numbers)], [windows], gold, ROUNDS, RATE, L2)
    return crf


class Emissions:
    """Emissions of words by a fitted channel. N-grams of the characters that its features know best are looked up in
    tables, for all words of a length at once; words with other characters go the plain way."""

    def __init__(self, channel: Channel):
        self.channel = channel
        index, weights = channel.index, channel.weights
        s = max(1, channel.labels)
        counts = Counter(c for f in index if len(f) <= 3 for c in f)
        most = int((TABLE / s) ** (1 / 3)) - 1
        chars = sorted(counts, key=lambda c: (-counts[c], c))[: min(most, 254)]
        self.size = size = len(chars) + 1
        self.code = np.zeros(0x110000, dtype=np.uint8)  # 0: a character without a number
        numbers = {c: n for n, c in enumerate(chars, 1)}
        for c, n in numbers.items():
            self.code[ord(c)] = n
        self.tables = [np.zeros((size**n, s)) for n in (1, 2, 3)]
        for f, i in index.items():
            if len(f) <= 3 and all(c in numbers for c in f):
                at = 0
                for c in f:
                    at = at * size + numbers[c]
                self.tables[len(f) - 1][at] = weights[i]
        self.weights = np.concatenate([weights, np.zeros((1, weights.shape[1]))])  # the last row: features that the fit doesn't know

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.channel.labels))
        by_length: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            by_length.setdefault(len(w), []).append(n)
        slow: list[int] = []
        one, two, three = self.tables
        get, size, none = self.channel.index.get, self.size, len(self.weights) - 1
        for length, numbers in by_length.items():
            for start in range(0, len(numbers), 8192):
                part = np.array(numbers[start : start + 8192])
                marked = [f"^{words[n]}$" for n in part.tolist()]
                codes = self.code[np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4")].reshape(len(part), length + 2).astype(np.int64)
                pairs = codes[:, :-1] * size + codes[:, 1:]
                e = one[codes[:, 1:-1]].sum(1) + two[pairs].sum(1) + three[pairs[:, :-1] * size + codes[:, 2:]].sum(1)
                for some in (marked, [w[:5] for w in marked], [w[-5:] for w in marked]):
                    e += self.weights[np.fromiter(map(get, some, repeat(none)), dtype=np.int64, count=len(some))]
                out[part] = e
                slow += part[(codes == 0).any(1)].tolist()
        if slow:
            out[slow] = self.channel.emissions([words[n] for n in slow])
        return out


class Predictor:
    """Predicts texts with a fitted model; remembers the emissions of words."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.emissions = Emissions(crf.channels[0])
        self.forget(set())

    def forget(self, but: set[str]) -> None:
        """Keep the numbers of the words of ``but`` alone; words without a letter have none."""
        old = getattr(self, "number", {})
        kept = {w: old[w] for w in but if w in old}
        rows = sorted({n for n in kept.values() if n >= 0})
        new = {n: i for i, n in enumerate(rows)}
        self.table = self.table[rows] if rows else np.zeros((0, len(self.crf.labels)))
        self.number = {w: new.get(n, -1) for w, n in kept.items()}

    def learn(self, words: set[str]) -> None:
        """Give numbers to new words; words of one core share it."""
        if len(self.number) + len(words) > REMEMBERED:
            self.forget(words)
        cores = {w: bare(w) for w in words if w not in self.number}
        lettered = sorted({c for c in cores.values() if c})
        rows = {c: i for i, c in enumerate(lettered, len(self.table))} | {"": -1}
        self.number |= {w: rows[c] for w, c in cores.items()}
        if lettered:
            self.table = np.concatenate([self.table, self.emissions(lettered)])

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores. Texts are taken as they are needed."""
        labels: list[str] = []
        scores: list[float] = []
        batch: list[tuple[int, list[str]]] = []
        size = 0

        def told() -> None:
            self.learn(set().union(*(w for _, w in batch)))
            get = self.number.__getitem__
            rows = [(k, np.fromiter(map(get, w), dtype=np.int64, count=len(w))) for k, w in batch]
            rows = [(k, r[r >= 0]) for k, r in rows]
            self._run([(k, r) for k, r in rows if len(r)], labels, scores)

        for i, text in enumerate(texts):
            labels.append(UNKNOWN)
            scores.append(0.0)
            words = words_of(text or "")
            batch.append((i, words))
            size += len(words)
            if size > WORDS_AT_ONCE:
                told()
                batch, size = [], 0
        told()
        return labels, scores

    def _run(self, batch: list[tuple[int, np.ndarray]], labels: list[str], scores: list[float]) -> None:
        if not batch:
            return
        counts = np.array([len(r) for _, r in batch])
        p = self.crf.marginals(self.table[np.concatenate([r for _, r in batch])], Cut(counts, SEQUENCE))
        mean = np.add.reduceat(p, np.cumsum(counts) - counts) / counts[:, None]
        best = mean.argmax(1)
        for (i, _), k, m in zip(batch, best.tolist(), mean):
            labels[i], scores[i] = self.crf.labels[k], float(min(1.0, max(0.0, m[k])))


def predict(
    docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    pred: str = "lang_pred", score: str = "score", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """``docs`` with ``pred`` and ``score``; ``train`` gives the labelled texts to learn from, every label among them.

    ``und`` with score 0 if the text is null, has no letter, or nothing could be learned. Of languages that are
    equally likely the first by name is told. Rows are told one by one, so repeated rows and null keys need no care;
    texts of any length are read whole. Columns of ``docs`` that are called as the new ones are replaced, others stay
    as they are. An empty table gives no rows. The model is bounded by its sample and its number of features, and sent
    to the executors once.
    """
    sample = excerpts(train, text, sample_docs, sample_chars, by=lang)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample))
    mark = uuid.uuid4().hex

    @F.arrow_udf("pred string, score double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = held(mark, lambda: Predictor(model.value) if model.value else None)
        for texts in batches:
            found = p.predict(t.as_py() for t in texts) if p else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.StructArray.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], names=["pred", "score"])

    (own,) = fresh(docs, "_lang")
    found = docs.withColumn(own, of(F.col(text)))
    rest = [F.col(c) for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    return found.select(*rest, F.col(f"{own}.pred").alias(pred), F.col(f"{own}.score").alias(score))
