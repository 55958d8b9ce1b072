"""Linear-chain conditional random fields over feature columns, in numpy.

A position has one type (a word, say) per channel; a type has features; a label's emission is the sum of
its features' weights over the channels. Weights and transitions are learned together by Adam on the
exact gradient of the log-likelihood. Decoding runs over many sequences at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np


class Channel:
    """Features of types and their weights. Features unknown to the fit weigh nothing."""

    def __init__(self, features: Callable[[str], list[str]], labels: int):
        self.features, self.labels = features, labels
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, labels))

    def learn_names(self, counts: Counter, most: int, at_least: int) -> None:
        names = sorted((k for k, n in counts.items() if n >= at_least), key=lambda k: (-counts[k], k))[:most]
        self.index = {k: i for i, k in enumerate(names)}
        self.weights = np.zeros((len(names), self.labels))

    def rows(self, types: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all types, one after another, and the type each belongs to."""
        get, found, sizes = self.index.get, [], []
        for t in types:
            features = self.features(t)
            found += map(get, features)
            sizes.append(len(features))
        columns = np.array([-1 if i is None else i for i in found], dtype=np.int64)
        known = columns >= 0
        return columns[known], np.repeat(np.arange(len(types)), sizes)[known]

    def emissions(self, types: list[str]) -> np.ndarray:
        columns, of = self.rows(types)
        return np.stack(
            [np.bincount(of, self.weights[columns, s], minlength=len(types)) for s in range(self.labels)], axis=1
        ).reshape(len(types), self.labels)


class Crf:
    def __init__(self, labels: list[str], channels: list[Channel]):
        n = len(labels)
        self.labels, self.channels = labels, channels
        self.first, self.moves = np.zeros(n), np.zeros((n, n))

    def fit(self, types: list[list[str]], windows: list[np.ndarray], gold: np.ndarray, rounds: int, rate: float, l2: float) -> None:
        """``windows[k]`` (n, length) holds numbers into ``types[k]``; ``gold`` (n, length) the labels."""
        n, length = gold.shape
        s = len(self.labels)
        tables = [c.rows(t) for c, t in zip(self.channels, types)]
        parameters = [self.first, self.moves, *(c.weights for c in self.channels)]
        mean, square = ([np.zeros_like(p) for p in parameters] for _ in range(2))
        one_hot = np.eye(s)[gold]
        pair_counts = np.zeros((s, s))
        np.add.at(pair_counts, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        for step in range(1, rounds + 1):
            e = np.zeros((n, length, s))
            for c, t, w, (columns, of) in zip(self.channels, types, windows, tables):
                by_type = np.stack([np.bincount(of, c.weights[columns, k], minlength=len(t)) for k in range(s)], axis=1)
                e += by_type[w]
            marginal, pairs = self._expected(e)
            grads = [one_hot[:, 0].sum(0) - marginal[:, 0].sum(0), pair_counts - pairs]
            miss = (one_hot - marginal).reshape(-1, s)
            for c, t, w, (columns, of) in zip(self.channels, types, windows, tables):
                by_type = np.stack([np.bincount(w.ravel(), miss[:, k], minlength=len(t)) for k in range(s)], axis=1)
                grads.append(np.stack([np.bincount(columns, by_type[of, k], minlength=len(c.index)) for k in range(s)], axis=1))
            for p, g, m, v in zip(parameters, grads, mean, square):
                g = g / n - l2 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)

    def _expected(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length, s = e.shape
        x = np.exp(e - e.max(axis=2, keepdims=True))
        move = np.exp(self.moves)
        alpha, beta = np.empty_like(x), np.empty_like(x)
        a = x[:, 0] * np.exp(self.first)
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, length):
            a = (alpha[:, t - 1] @ move) * x[:, t]
            alpha[:, t] = a / a.sum(1, keepdims=True)
        beta[:, -1] = 1
        for t in range(length - 2, -1, -1):
            b = (x[:, t + 1] * beta[:, t + 1]) @ move.T
            beta[:, t] = b / b.sum(1, keepdims=True)
        marginal = alpha * beta
        marginal /= marginal.sum(2, keepdims=True)
        pairs = np.zeros((s, s))
        for t in range(length - 1):
            joint = alpha[:, t, :, None] * move * (x[:, t + 1] * beta[:, t + 1])[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        return marginal, pairs

    def marginals(self, e: np.ndarray, texts: "Cut") -> np.ndarray:
        """Forward-backward over whole texts that lie one after another in ``e``."""
        n = len(self.labels)
        x = np.exp(e - e.max(axis=1, keepdims=True))
        move = np.exp(self.moves)
        enter = np.tile(np.exp(self.first), (len(texts.starts), 1))  # what comes into each sequence from before
        leave = np.ones((len(texts.starts), n))
        if len(texts.chained):
            # A sequence takes what is before it to what is behind it by a product of matrices.
            through = np.where(texts.opening[:, None, None], np.eye(n), move)
            for t, at in texts.steps(texts.chained):
                m = (through[: len(at)] @ move if t else through) * x[at][:, None, :]
                through[: len(at)] = m / m.sum((1, 2), keepdims=True)
            matrix = dict(zip(texts.chained.tolist(), through))
            for run in texts.runs:
                a = np.exp(self.first) @ matrix[run[0]]
                for k in run[1:]:
                    enter[k] = a @ move
                    a = a @ matrix[k]
                    a /= a.sum()
                b = np.ones(n)
                for k, before in zip(run[:0:-1], run[-2::-1]):
                    b = matrix[k] @ b
                    b /= b.sum()
                    leave[before] = b
        alpha, beta = np.empty_like(x), np.empty_like(x)
        for t, at in texts.steps():
            a = (enter[texts.order[: len(at)]] if t == 0 else alpha[at - 1] @ move) * x[at]
            alpha[at] = a / a.sum(1, keepdims=True)
        beta[texts.starts + texts.lengths - 1] = leave
        for t, at in reversed(list(texts.steps())):
            if t:
                b = (x[at] * beta[at]) @ move.T
                beta[at - 1] = b / b.sum(1, keepdims=True)
        alpha *= beta
        return alpha / alpha.sum(1, keepdims=True)

    def viterbi(self, e: np.ndarray, texts: "Cut") -> np.ndarray:
        """The best labels of whole texts that lie one after another in ``e``; of equal ones the first label."""
        n = len(self.labels)
        enter = np.tile(self.first, (len(texts.starts), 1))
        came_in: dict[int, np.ndarray] = {}
        if len(texts.chained):
            through = np.where(texts.opening[:, None, None], np.where(np.eye(n, dtype=bool), 0.0, -np.inf), self.moves)
            for t, at in texts.steps(texts.chained):
                m = (through[: len(at), :, :, None] + self.moves).max(2) if t else through
                through[: len(at)] = m + e[at][:, None, :]
            matrix = dict(zip(texts.chained.tolist(), through))
            for run in texts.runs:
                a = (self.first[:, None] + matrix[run[0]]).max(0)
                for k in run[1:]:
                    ways = a[:, None] + self.moves
                    enter[k], came_in[k] = ways.max(0), ways.argmax(0)
                    a = (a[:, None] + matrix[k]).max(0)
        came = np.zeros(e.shape, dtype=np.int8)
        best = e.copy()
        best[texts.starts] += enter
        for t, at in texts.steps():
            if t:
                ways = best[at - 1][:, :, None] + self.moves
                came[at] = ways.argmax(1)
                best[at] += ways.max(1)
        ends = texts.starts + texts.lengths - 1
        label = best[ends].argmax(1)
        # The labels of a sequence's ends, by which the one before it ends.
        if came_in:
            first_of = np.tile(np.arange(n), (len(texts.chained), 1))  # a sequence's first label by its last
            for t, at in reversed(list(texts.steps(texts.chained))):
                if t:
                    first_of[: len(at)] = np.take_along_axis(came[at], first_of[: len(at)], axis=1)
            firsts = dict(zip(texts.chained.tolist(), first_of))
            for run in texts.runs:
                for k, before in zip(run[:0:-1], run[-2::-1]):
                    label[before] = came_in[k][firsts[k][label[k]]]
        out = np.empty(len(e), dtype=np.int8)
        out[ends] = label
        for t, at in reversed(list(texts.steps())):
            if t:
                out[at - 1] = came[at, out[at]]
        return out


class Cut:
    """Texts that lie one after another, those of over ``longest`` positions as a chain of sequences.

    Sequences are worked on side by side, and chains are joined exactly at their seams.
    """

    def __init__(self, counts: np.ndarray, longest: int):
        starts, lengths, self.runs = [], [], []
        at = 0
        for n in counts.tolist():
            first = len(starts)
            for i in range(0, n, longest):
                starts.append(at + i)
                lengths.append(min(longest, n - i))
            if len(starts) - first > 1:
                self.runs.append(list(range(first, len(starts))))
            at += n
        self.starts, self.lengths = np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)
        self.order = np.argsort(-self.lengths, kind="stable")
        inner = np.array([k for run in self.runs for k in run], dtype=np.int64)
        self.chained = inner[np.argsort(-self.lengths[inner], kind="stable")]
        self.opening = np.isin(self.chained, [run[0] for run in self.runs])

    def steps(self, some: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """For each place, its number and where it is in those sequences that have it, the longest first."""
        order = self.order if some is None else some
        starts, lengths = self.starts[order], self.lengths[order]
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(order) else 0), side="left")
        for t, n in enumerate(live.tolist()):
            yield t, starts[:n] + t


def windows_of(ids: np.ndarray, length: int) -> np.ndarray:
    """Whole windows of a long row of numbers; the rest of fewer than ``length`` is left out."""
    n = len(ids) // length
    return ids[: n * length].reshape(n, length)
