"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field labels the words of a text as secret begin, inside or outside by the shape of the word, its
neighbours and features of the whole text, decoded by Viterbi. It learns from a bounded sample of the texts,
with the spans of the patterns as labels and with made-up secrets and harmless look-alikes written into them.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import excerpts, fresh, held, slices
from barloom.llm.crf import Channel, Crf, Cut, windows_of

# Kinds in the order of their listing, and their patterns.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "access")

#: The field is fitted on excerpts of at most so many characters of at most so many different texts, cut into windows of
#: words, of which so many are learned from (those with secrets first), with the most frequent features.
SAMPLE_DOCS, SAMPLE_CHARS = 1200, 20_000
WINDOWS, FEATURES = 30_000, 20_000
WINDOW, ROUNDS, RATE, L2 = 16, 60, 0.15, 1e-5
#: Words that are worked on in one row (longer texts are several, joined exactly) and at once, and that are remembered.
SEQUENCE, WORDS_AT_ONCE, REMEMBERED = 2048, 150_000, 1 << 18
#: Characters of a position; longer words are cut behind marks that end a value, and then at this length.
LONGEST = 256
OUTSIDE, BEGIN, INSIDE = range(3)
MASK = "[secret]"

Span = tuple[int, int, int]  # start, number of the kind, end
_HEX_BYTES = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_WORD = re.compile(r"\S+")
_VALUE = re.compile(r"""[^"'()\[\]{}<>,;=:&]*["'()\[\]{}<>,;=:&]*""")
_TRIM = "\"'`,;:()[]{}<>."


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in text.encode().translate(_HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shape(word: str) -> str:
    """A signature of the word, ``|`` between its features; plain words have few of them."""
    core = word.strip(_TRIM)
    if core.isalpha():
        low = core.lower()
        case = "a" if core == low else "A" if core == core.upper() else "Aa" if core[1:] == core[1:].lower() else "aA"
        marked = "" if len(core) == len(word) else "|edge" + word[-1]
        return f"{case}|n{min(len(core), 40) // 8}{marked}" + (f"|key{low}" if low in SENSITIVE else "")
    if not core:
        return f"mark{word[:2]}"
    n = len(core)
    classes = ["9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "w" if c.isalpha() else c for c in core]
    runs = [c for i, c in enumerate(classes) if i == 0 or classes[i - 1] != c]
    counts = Counter(core)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    digits = sum(c == "9" for c in classes) / n
    letters = sum(c in "aAw" for c in classes) / n
    out = [
        f"s{''.join(runs if len(runs) <= 10 else runs[:5] + ['~'] + runs[-5:])}", f"n{min(n, 64) // 4}", f"r{min(len(runs), 24) // 3}", f"e{int(2 * entropy)}",
        f"d{int(4 * digits)}", f"l{int(4 * letters)}", f"er{min(len(runs), 24) // 4}.{int(entropy)}", "mixed",
        "kinds" + "".join(sorted(set(classes) & set("aA9w"))),
        "marks" + "".join(sorted(set(classes) - set("aA9w"))),
        f"head{''.join(classes[:3])}",
    ]
    low = core.lower()
    out += [f"has{k}" for k in SENSITIVE if k in low]
    return "|".join(x.replace("|", "I") if "|" in x else x for x in out)


def own_features(signature: str) -> list[str]:
    parts = signature.split("|")
    return [*parts, "bias", signature if len(parts) < 5 else parts[0] + parts[1]]


def near_features(signature: str) -> list[str]:
    parts = signature.split("|")
    return [parts[0], *(p for p in parts if p.startswith(("key", "has", "mark", "mixed")))]


def file_type(text: str) -> str:
    n = max(1, len(text))
    signs = sum(text.count(c) for c in "=:{}\"")
    return f"signs{min(9, int(200 * signs / n))}|lines{min(9, int(100 * text.count(chr(10)) / n))}"


def file_features(kind: str) -> list[str]:
    return kind.split("|")


def _pieces(word: str) -> Iterator[tuple[int, int]]:
    """Where the pieces of a long word begin and end."""
    for m in _VALUE.finditer(word):
        for a in range(m.start(), m.end(), LONGEST):
            yield a, min(a + LONGEST, m.end())


def _words(text: str) -> list[tuple[int, int]]:
    """Positions of a text: its words, those over ``LONGEST`` characters in pieces."""
    out: list[tuple[int, int]] = []
    for m in _WORD.finditer(text):
        a, b = m.span()
        if b - a <= LONGEST:
            out.append((a, b))
        else:
            out += [(a + x, a + y) for x, y in _pieces(m[0])]
    return out


def _split(text: str) -> list[str]:
    """The texts of the positions."""
    words = text.split()
    if len(text) <= LONGEST or max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONGEST else [w[a:b] for a, b in _pieces(w)])]


def gold(words: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    out = [OUTSIDE] * len(words)
    spans = sorted(spans)
    k = 0
    opened = None
    for i, (a, b) in enumerate(words):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < b:
            out[i] = INSIDE if opened == k else BEGIN
            opened = k
    return out


def made_up(rng: random.Random) -> str:
    """A secret of a common format."""
    def some(n: int, alphabet: str = string.ascii_letters + string.digits) -> str:
        return "".join(rng.choices(alphabet, k=n))

    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    kind = rng.randrange(10)
    if kind == 0:
        return rng.choice(("ghp_", "gho_", "glpat-", "npm_", "pypi-")) + some(rng.randrange(20, 41))
    if kind == 1:
        return rng.choice(("sk-", "sk_live_", "rk_test_", "pk_live_")) + some(rng.randrange(24, 49))
    if kind == 2:
        return f"xoxb-{some(12, string.digits)}-{some(12, string.digits)}-{some(24)}"
    if kind == 3:
        return "AIza" + some(35, alnum + "-_")
    if kind == 4:
        return some(rng.randrange(32, 65), alnum + "+/") + rng.choice(("", "=", "=="))
    if kind == 5:
        return ".".join(("eyJ" + some(rng.randrange(17, 34)), "eyJ" + some(rng.randrange(40, 90)), some(43, alnum + "-_")))
    if kind == 6:
        return rng.choice(("pwd", "pass", "auth", "credential", "access_key", "private_key")) + rng.choice(("=", ":")) + some(rng.randrange(10, 30))
    if kind == 7:
        return "Bearer " + some(rng.randrange(24, 60), alnum + "-_.")
    if kind == 8:
        return rng.choice(("password", "token", "api_key", "secret")) + rng.choice(("=", ": ", " = ")) + some(rng.randrange(12, 41), rng.choice((hexes, alnum)))
    return "-----BEGIN PRIVATE KEY-----\n" + "\n".join(some(48, alnum + "+/") for _ in range(rng.randrange(1, 4))) + "\n-----END PRIVATE KEY-----"


def harmless(rng: random.Random) -> str:
    """Something that looks a little like a secret and is none."""
    def some(n: int, alphabet: str = string.ascii_lowercase) -> str:
        return "".join(rng.choices(alphabet, k=n))

    kind = rng.randrange(10)
    d = string.digits
    return [
        lambda: f"https://www.{some(8)}.{rng.choice(('com', 'org', 'net'))}/{some(6)}/{some(5, d)}",
        lambda: f"{some(7)}.{some(2, d)}@{some(6)}{some(1, d)}.example.{rng.choice(('com', 'org'))}",
        lambda: f"+{some(1, d)} ({some(3, d)}) {some(3, d)}-{some(4, d)}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: some(rng.randrange(4, 20), d),
        lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        lambda: f"v{some(1, d)}.{some(1, d)}.{some(1, d)}",
        lambda: "/" + "/".join(some(rng.randrange(3, 9)) for _ in range(4)),
        lambda: some(rng.randrange(3, 9)) + rng.choice(("&&&", "###", "$$$", "%%%", "***", "!!", "...")),
        lambda: rng.choice(SENSITIVE) + rng.choice((":", " is ", " ")) + some(rng.randrange(2, 9)),
    ][kind]()


def written_into(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with made-up secrets and look-alikes between its words; spans of all secrets."""
    secrets = [(a, b) for a, _, b in base_spans(text)]
    for _ in range(rng.randrange(0, 5)):
        words = _words(text)
        at = rng.choice(words)[0] if words else 0
        if any(a < at < b for a, b in secrets):
            continue
        bad = rng.random() < 0.5
        new = made_up(rng) if bad else harmless(rng)
        put = new if rng.random() < 0.7 else f'"{new}"'
        text = f"{text[:at]}{put} {text[at:]}"
        n = len(put) + 1
        secrets = [(a + n, b + n) if a >= at else (a, b) for a, b in secrets]
        if bad:
            skip = 7 if new.startswith("Bearer ") else 0
            lead = len(put) - len(new) >> 1
            secrets.append((at + lead + skip, at + lead + len(new)))
    return text, secrets


def fit(texts: list[str], seed: int = 7) -> Crf:
    channels = [Channel(own_features, 3), Channel(near_features, 3), Channel(near_features, 3), Channel(file_features, 3)]
    crf = Crf(["outside", "begin", "inside"], channels)
    rng = random.Random(seed)
    texts = texts or [""]
    while len(texts) < 200:  # few texts still show every format
        texts = texts + texts
    types: list[dict[str, int]] = [{} for _ in channels]
    rows: list[list[int]] = [[] for _ in channels]
    labels: list[int] = []
    for text in texts:
        text, secrets = written_into(text, rng)
        words = _words(text)
        own = [shape(text[a:b]) for a, b in words]
        for row, kind, values in zip(rows, types, (own, ["edge", *own[:-1]] if own else [], [*own[1:], "edge"] if own else [], [file_type(text)] * len(own))):
            row += [kind.setdefault(v, len(kind)) for v in values]
        labels += gold(words, secrets)
    windows = [windows_of(np.array(r, dtype=np.int64), WINDOW) for r in rows]
    y = windows_of(np.array(labels, dtype=np.int64), WINDOW)
    order = np.random.default_rng(seed).permutation(len(y))
    order = order[np.argsort(~(y[order] != OUTSIDE).any(1), kind="stable")][:WINDOWS]
    windows, y = [w[order] for w in windows], y[order]
    for channel, kind, w in zip(channels, types, windows):
        names = list(kind)
        counts: Counter = Counter()
        for i, n in zip(*np.unique(w, return_counts=True)):
            for f in set(channel.features(names[i])):
                counts[f] += int(n)
        channel.learn_names(counts, FEATURES, 2)
    if len(y):
        crf.fit([list(k) for k in types], windows, y, ROUNDS, RATE, L2)
    return crf


class Scanner:
    """Finds all spans with a fitted field; remembers the emissions of words and shapes."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.shapes: dict[str, int] = {}
        self.tables = [np.zeros((0, 3)) for _ in range(3)]
        self.edge = self._shape_number("edge")
        self.words: dict[str, int] = {}
        self.files: dict[str, np.ndarray] = {}

    def _shape_number(self, signature: str) -> int:
        k = self.shapes.get(signature)
        if k is None:
            k = self.shapes[signature] = len(self.shapes)
            for i, c in enumerate(self.crf.channels[:3]):
                if k >= len(self.tables[i]):
                    self.tables[i] = np.concatenate([self.tables[i], np.zeros((max(64, k), 3))])
                self.tables[i][k] = c.emissions([signature])[0]
        return k

    def _numbers(self, words: list[str]) -> list[int]:
        known = self.words
        try:
            return [known[w] for w in words]
        except KeyError:
            new = {w: self._shape_number(shape(w)) for w in set(words) if w not in known}
            if len(known) + len(new) > REMEMBERED:
                old = known
                known = self.words = {w: old[w] for w in set(words) if w in old}
            known |= new
            return [known[w] for w in words]

    def scan(self, texts: list[str | None]) -> list[list[Span]]:
        out = [base_spans(t or "") for t in texts]
        batch: list[tuple[int, list[int]]] = []
        size = 0
        for i, text in enumerate(texts):
            numbers = self._numbers(_split(text or ""))
            if numbers:
                batch.append((i, numbers))
                size += len(numbers)
            if size > WORDS_AT_ONCE:
                self._run(batch, texts, out)
                batch, size = [], 0
        self._run(batch, texts, out)
        return out

    def _run(self, batch: list[tuple[int, list[int]]], texts: list[str | None], out: list[list[Span]]) -> None:
        if not batch:
            return
        counts = np.array([len(n) for _, n in batch])
        ids = np.concatenate([np.array(n, dtype=np.int64) for _, n in batch])
        ends = np.cumsum(counts)
        before, after = np.roll(ids, 1), np.roll(ids, -1)
        before[ends - counts] = self.edge
        after[ends - 1] = self.edge
        e = self.tables[0][ids] + self.tables[1][before] + self.tables[2][after]
        of_file = []
        for i, _ in batch:
            kind = file_type(texts[i])
            if kind not in self.files:
                self.files[kind] = self.crf.channels[3].emissions([kind])[0]
            of_file.append(self.files[kind])
        e += np.repeat(np.stack(of_file), counts, axis=0)
        found = self.crf.viterbi(e, Cut(counts, SEQUENCE))
        hits = np.add.reduceat((found != OUTSIDE).astype(np.int64), ends - counts)
        for k in np.nonzero(hits)[0].tolist():
            i = batch[k][0]
            self._add(texts[i], found[ends[k] - counts[k] : ends[k]].tolist(), out[i])

    @staticmethod
    def _add(text: str, labels: list[int], spans: list[Span]) -> None:
        words = _words(text)
        new: list[tuple[int, int]] = []
        for (a, b), label, last in zip(words, labels, [OUTSIDE, *labels]):
            if label == INSIDE and last != OUTSIDE and new:
                new[-1] = (new[-1][0], b)
            elif label != OUTSIDE:
                new.append((a, b))
        base = list(spans)
        for a, b in new:
            while a < b and text[a] in _TRIM:
                a += 1
            while b > a and text[b - 1] in _TRIM:
                b -= 1
            if a < b and not any(a < y and x < b for x, _, y in base):
                spans.append((a, len(KINDS) - 1, b))
        spans.sort()


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, as one mask."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", mask: bool = False, spans: str = "spans", masked_text: str = "masked",
    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """``docs`` with ``spans``, an array of ``kind``, ``start`` and ``end`` (code points, end exclusive) in order
    of start and kind, and with ``mask`` also ``masked_text``, the text with each span replaced.

    Null and empty texts have no spans; a null text stays null when masked. Spans of the field that overlap
    one of a pattern are left out. Of labels that are equally likely Viterbi takes outside before begin before inside.
    Rows are scanned one by one, so repeated rows and null keys need no care; texts of any length are read whole.
    Columns of ``docs`` that are called as the new ones are replaced, others stay as they are. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit([t for t, _ in excerpts(docs, text, sample_docs, sample_chars)]))
    mark = uuid.uuid4().hex

    @F.arrow_udf("spans array<struct<kind:string,start:long,end:long>>" + (", masked string" if mask else ""))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = held(mark, lambda: Scanner(model.value))
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in slices(batches):
            texts = part.to_pylist()
            found = scanner.scan(texts)
            out = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found], span)]
            if mask:
                out.append(pa.array([t if not s else masked(t, s) for t, s in zip(texts, found)], pa.string()))
            yield pa.StructArray.from_arrays(out, names=["spans", "masked"][: len(out)])

    (own,) = fresh(docs, "_scan")
    found = docs.withColumn(own, of(F.col(text)))
    new = {spans: "spans"} | ({masked_text: "masked"} if mask else {})
    rest = [F.col(c) for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    return found.select(*rest, *(F.col(f"{own}.{field}").alias(name) for name, field in new.items()))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
