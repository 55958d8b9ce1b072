"""Toxicity by a support vector machine with a string kernel of subsequences.

Two strings are alike by the triples of characters they share, in order, with others between them or not: a triple
counts less the longer the stretch it takes, so letters put between others lower the likeness but don't end it. The
strings are the words of a sentence, and its runs of single characters taken together (``i d i o t``).
The machine works in the Nyström coordinates of landmarks chosen among the words of the sample.

Labels belong to texts, not to sentences: in turn the machine tells which strings of toxic texts are toxic, at least
one of each text, and is fitted again. A sentence is as toxic as its most toxic string and a text as its most toxic
sentence; a logistic curve fitted on texts kept apart makes that a score. Since the kernel has explicit
coordinates, the fitted sum over landmarks is one table over triples, which is what executors hold.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, held

#: The machine is fitted on excerpts of at most so many characters of at most so many labelled texts of each label.
SAMPLE_DOCS, SAMPLE_CHARS = 1_200, 8_000
#: Every n-th text of the sample tells the curve and isn't fitted on.
APART = 4
LANDMARKS, ROUNDS, COST = 256, 4, 10.0
#: Strings of clean texts that are fitted on at once; all that the machine takes for toxic ones come in every round.
CLEAN = 20_000
#: The chance allowed for a string to be in toxic texts alone without being toxic, for it to be taken for toxic at first.
CHANCE = 0.01
#: What a character more takes of a triple's weight, and the longest stretch of a triple.
DECAY, SPAN = 0.85, 9
#: Characters of a string; a longer word is several that overlap by half.
LONGEST = 24
#: Score from which a text is toxic.
TOXIC = 0.7
REMEMBERED = 1 << 19
_FIRST, _LAST = 62, 63
_EDGE = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
_RUN = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def _code(ch: str) -> int:
    """Letters and digits as numbers from 1; letters beyond ASCII share 25 of them. Others are 0 and only take room."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if "0" <= ch <= "9":
        return ord(ch) - 21
    return 37 + ord(ch) % 25 if ch.isalnum() else 0


class _Codes(dict):
    def __missing__(self, ch: str) -> int:
        self[ch] = code = _code(ch)
        return code


_CODES = _Codes()


def pieces(word: str) -> list[str]:
    """The strings of a lower-case word: itself without marks around it, or overlapping ones if it is long."""
    word = word.strip(_EDGE)
    if len(word) <= LONGEST:
        return [word] if word else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def strings_of(text: str) -> set[str]:
    """The distinct words of a text, in lower case as they stand, and its runs of single characters."""
    text = text.lower()
    return set(text.split()).union(" ".join(m.split()) for m in _RUN.findall(text))


_triples: dict[int, tuple] = {}


def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and weights of the triples of a string of ``n`` characters."""
    if n not in _triples:
        at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
        i, j, k = np.array(at, dtype=np.int64).reshape(-1, 3).T
        _triples[n] = i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)
    return _triples[n]


def coordinates(strings: list[str], at_once: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of strings of one length: their numbers, triples and weights (rows of length 1)."""
    by_length: dict[int, list[int]] = {}
    for n, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(n)
    for length, numbers in by_length.items():
        i, j, k, weight = _places(length + 2)
        for start in range(0, len(numbers), at_once):
            part = numbers[start : start + at_once]
            codes = np.zeros((len(part), length + 2), dtype=np.int32)
            codes[:, 0], codes[:, -1] = _FIRST, _LAST
            if length:
                codes[:, 1:-1] = np.array([[_CODES[c] for c in strings[n]] for n in part], dtype=np.int32)
            a, b, c = codes[:, i], codes[:, j], codes[:, k]
            weights = np.where((a > 0) & (b > 0) & (c > 0), weight, np.float32(0))
            size = np.sqrt((weights * weights).sum(1, keepdims=True))
            yield np.array(part), (a << 12) | (b << 6) | c, weights / np.maximum(size, 1e-12)


class Machine:
    """The fitted table over triples, the bias and the curve; ``slope`` and ``offset`` make a score of a decision."""

    def __init__(self, table: np.ndarray | None, bias: float, slope: float, offset: float):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset

    def decide(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        for numbers, triples, weights in coordinates(strings):
            out[numbers] += np.einsum("ij,ij->i", self.table[triples], weights)
        return out

    def score(self, decision: float) -> float:
        return 1 / (1 + math.exp(min(max(self.slope * decision + self.offset, -500), 500)))


class _Landmarks:
    """Nyström coordinates by the landmarks' own triples."""

    def __init__(self, landmarks: list[str]):
        self.column = np.zeros(1 << 18, dtype=np.int64)
        for _, triples, weights in coordinates(landmarks):
            self.column[triples[weights > 0]] = 1
        self.column = np.where(self.column > 0, np.cumsum(self.column), 0)  # 0: triples that no landmark has
        self.rows = np.zeros((int(self.column.max()) + 1, len(landmarks)))
        for numbers, triples, weights in coordinates(landmarks):
            for n, t, w in zip(numbers, triples, weights):
                np.add.at(self.rows[:, n], self.column[t[w > 0]], w[w > 0])
        values, vectors = np.linalg.eigh(self.rows.T @ self.rows)
        good = values > 1e-6 * max(values.max(), 1e-12)
        self.project = vectors[:, good] / np.sqrt(values[good])

    def __call__(self, strings: list[str]) -> np.ndarray:
        basis = (self.rows @ self.project).astype(np.float32)
        out = np.zeros((len(strings), basis.shape[1]), dtype=np.float32)
        for numbers, triples, weights in coordinates(strings, 1024):
            at = self.column[triples]
            weights = np.where(at > 0, weights, 0)
            for f in range(at.shape[1]):
                hit = np.nonzero(weights[:, f])[0]
                out[numbers[hit]] += weights[hit, f, None] * basis[at[hit, f]]
        return out

    def table(self, w: np.ndarray) -> np.ndarray:
        return (self.rows @ (self.project @ w))[self.column].astype(np.float32)


def separate(x: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear machine with squared hinge loss, by Newton's steps on the rows within the margin;
    ``times`` is how often each row counts."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3

    def loss(v: np.ndarray) -> float:
        return v @ ridge @ v / 2 + cost * (times * np.maximum(1 - y * (x @ v), 0) ** 2).sum()

    for _ in range(40):
        inside = y * (x @ w) < 1
        a = x[inside]
        pull = 2 * cost * (a * times[inside, None]).T
        step = np.linalg.solve(ridge + pull @ a, pull @ y[inside]) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def curve(decisions: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through decisions, by Newton's steps; labels are smoothed by their number."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([decisions, np.ones(len(decisions))], axis=1)
    v = np.array([-1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def _different(texts: Iterable[tuple[str, bool]]) -> list[tuple[set[str], bool]]:
    """The texts' strings without near copies of texts before: those that share half of their eight least hashes."""
    seen: dict[int, set[int]] = {}
    out = []
    for text, toxic in texts:
        strings = {p for w in strings_of(text) for p in pieces(w)}
        least = sorted(hash_of(s) for s in strings)[:8]
        near = Counter(n for h in least for n in seen.get(h, ()))
        if near and near.most_common(1)[0][1] * 2 >= len(least):
            continue
        for h in least:
            seen.setdefault(h, set()).add(len(out))
        out.append((strings, toxic))
    return out


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def evidence(n1: int, n0: int, share: float) -> float:
    """How unlikely it is that a string which is in ``n1`` toxic and ``n0`` clean texts is so by chance: a bound of the
    logarithm, 0 where clean texts have it more often."""
    p = n1 / (n1 + n0)
    if p <= share:
        return 0.0
    return (n1 + n0) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if n0 else 0.0))


def fit(texts: list[tuple[str, bool]]) -> Machine:
    """The machine of texts and their labels; of one label alone, or none, a constant score by its share."""
    docs = [d for d in _different(sorted(texts)) if d[0]]
    own = [d for n, d in enumerate(docs) if n % APART]
    apart = docs[::APART]
    n1 = sum(t for _, t in docs)
    share_alone = Machine(None, 0.0, 0.0, -math.log((n1 + 1) / (len(docs) - n1 + 1)))
    toxic, clean = [s for s, t in own if t], [s for s, t in own if not t]
    if not toxic or not clean or len({t for _, t in apart}) < 2:
        return share_alone
    in_toxic, in_clean = (Counter(s for doc in part for s in doc) for part in (toxic, clean))
    share = len(toxic) / len(own)
    strength = {s: evidence(n, in_clean[s], share) for s, n in in_toxic.items()}
    by_hash = sorted(in_clean, key=hash_of)
    most = sorted(strength, key=lambda s: (-strength[s], s))[: LANDMARKS // 2]
    landmarks = _Landmarks(list(dict.fromkeys(most + by_hash))[:LANDMARKS])
    # Strings that stand for their text: those that toxic texts have more often, by more than half of what is possible.
    numbers = {s: n for n, s in enumerate(sorted(s for s in strength if 2 * in_toxic[s] > (1 + share) * (in_toxic[s] + in_clean[s])))}
    if not numbers:
        return share_alone
    bags_x = landmarks(list(numbers))
    places = [p for bag in toxic if len(p := np.array([numbers[s] for s in sorted(bag) if s in numbers], dtype=np.int64))]
    told = np.array([strength[s] for s in numbers])
    enough = math.log(len(in_toxic) / CHANCE)
    sure, fair = told >= min(enough, told.max()), told >= min(enough / 2, told.max())

    def stand(yes: np.ndarray, rank: np.ndarray) -> Counter:
        """How many texts each string stands for: all that are told toxic, or else the first by rank with fair evidence."""
        return Counter(int(n) for p in places for n in (p[yes[p]] if yes[p].any() else p[[np.argmax(rank[p])]]) if yes[n] or fair[n])

    picked = stand(sure, told)
    hard = dict.fromkeys(by_hash[:CLEAN])
    clean_x = landmarks(list(hard))
    for _ in range(ROUNDS):
        signs = np.concatenate([np.ones(len(picked)), -np.ones(len(clean_x))])
        times = np.concatenate([list(picked.values()), np.ones(len(clean_x))])
        w, bias = separate(np.concatenate([bags_x[list(picked)], clean_x]).astype(float), signs, times)
        decisions = bags_x @ w + bias
        picked = stand(decisions > 0, np.where(fair, decisions, -np.inf))
        machine = Machine(landmarks.table(w), bias, -1.0, 0.0)
        new = dict.fromkeys(s for s, d in zip(by_hash, machine.decide(by_hash)) if d > -1 and s not in hard)
        clean_x = np.concatenate([clean_x, landmarks(list(new))])
        hard |= new
    scores = np.array([machine.decide(sorted(s)).max() for s, _ in apart])
    slope, offset = curve(scores, np.array([t for _, t in apart]))
    return Machine(machine.table, bias, min(slope, -1e-3), offset)


class Scorer:
    """Scores texts; remembers the decisions on words."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.known: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = sorted(words)
        parts = [pieces(w) for w in new]
        numbers = {s: n for n, s in enumerate(dict.fromkeys(s for p in parts for s in p))}
        decisions = self.machine.decide(list(numbers)).tolist()
        self.known |= {w: max((decisions[numbers[s]] for s in p), default=self.machine.bias) for w, p in zip(new, parts)}

    def score(self, texts: list[str | None]) -> list[float]:
        if self.machine.table is None:
            return [self.machine.score(0.0)] * len(texts)
        out = []
        for at in range(0, len(texts), 256):
            words = [strings_of(t or "") for t in texts[at : at + 256]]
            self.learn(set().union(*words))
            get = self.known.__getitem__
            out += [self.machine.score(max(map(get, w), default=self.machine.bias)) for w in words]
        return out


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int, chars: int) -> list[tuple[str, bool]]:
    """A bounded sample of labelled texts: for each label 0 and 1, excerpts of the texts of ``most`` keys at most.

    Keys are dealt to ``most`` buckets by their hash and each gives the one of smallest hash, so the labels alone are
    read to choose them and the texts are read once, without a shuffle. Keys with both labels are left out.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).alias("label"))
    rows = rows.withColumn("hash", F.xxhash64("key"))
    wanted = rows.groupBy("label", F.pmod("hash", F.lit(most)).alias("bucket")).agg(F.min_by("key", F.struct("hash", "key")).alias("key")).collect()
    of: dict = {}
    for r in wanted:
        of.setdefault(r["key"], set()).add(r["label"])
    both = rows.where(F.col("key").isin(list(of))).groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").collect() if of else []
    for r in both:
        of.pop(r["key"], None)
    if not of:
        return []
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    excerpt = F.substring(F.col(text), (F.pmod(F.xxhash64(text), room) + 1).cast("int"), F.lit(chars))
    found = docs.where(F.col(key).isin(list(of)) & F.col(text).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(excerpt).alias("text")).collect()
    return sorted((r["text"], 1 in of[r["key"]]) for r in found)


def predict(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    score: str = "score", predicted: str = "predicted", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on); ``labels`` gives the keys to learn from.

    Null texts count as empty, and an empty text has the score of a text without words. Texts are read whole, however
    long; rows are scored one by one, so repeated rows and null keys need no care, and equal texts have equal scores.
    Columns of ``docs`` that are called as the new ones are replaced, others stay. Labels other than 0 and 1, null ones,
    null keys and keys with both labels aren't learned from; without both labels all scores are the same. An empty
    table gives no rows. The sample is bounded by ``sample_docs`` texts a label; the model is one table of a megabyte.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, key, text, label, sample_docs, sample_chars)))
    mark = uuid.uuid4().hex

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = held(mark, lambda: Scorer(model.value))
        for texts in batches:
            yield pa.array(scorer.score(texts.to_pylist()), pa.float64())

    (own,) = fresh(docs, "_score")
    rest = [F.col(c) for c in docs.columns if c.lower() not in (score.lower(), predicted.lower())]
    found = docs.withColumn(own, of(F.col(text)))
    return found.select(*rest, F.col(own).alias(score), F.when(F.col(own) >= TOXIC, 1).otherwise(0).alias(predicted))
