"""A small causal self-attention model in numpy.

A sequence of classes is read in windows of ``2 * half`` inputs that overlap by
half: a window predicts the classes of its second half, so each is predicted
once, from the last input and ``half`` to ``2 * half - 1`` before it.  The last
input is the query.  Its embedding times those of the inputs, a bias of the input
and one of the distance give the scores, and a masked softmax the attention.  An
input's value is the distribution of the class that stands at this distance after
it, so the attended mixture is itself a distribution.

The values are counts of the corpus (``transitions``); embeddings and biases are
trained by gradients that are summed over tasks before every step, so neither the
number of tasks nor the order of rows changes a parameter by more than rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def values_of(counts: np.ndarray, own: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """``counts`` (distances, from, to) as shares, smoothed to the classes' ``own``
    shares with the weight of ``prior`` occurrences."""
    return ((counts + prior * own) / (counts.sum(-1, keepdims=True) + prior)).astype(np.float32)


def transitions(classes: np.ndarray, lengths: np.ndarray, start: int, n: int, distances: int, far: int) -> np.ndarray:
    """How often each class stands at each of ``far`` distances after each other,
    for sequences laid end to end with ``start`` before each; distances beyond
    ``distances`` count as the last."""
    m, z = n + 1, np.full(len(classes) + (far + 1) * len(lengths), n, np.intp)  # class n stands for nothing
    begin = np.cumsum(lengths) - lengths + (far + 1) * np.arange(1, len(lengths) + 1)
    z[begin - 1] = start
    z[np.arange(len(classes)) + np.repeat(begin - np.cumsum(lengths) + lengths, lengths)] = classes
    scaled, out = z * m, np.zeros((distances, m * m), np.int64)
    for k in range(far):
        out[min(k, distances - 1)] += np.bincount(scaled[: len(z) - k - 1] + z[k + 1 :], minlength=m * m)
    return out.reshape(distances, m, m)[:, :n, :n]


class Attention:
    """Parameters lie in one flat array, ``theta``; views have the shapes."""

    def __init__(self, values: np.ndarray, width: int = 16, half: int = 4, theta: np.ndarray | None = None, seed: int = 1):
        distances, n, _ = values.shape
        self.classes, self.width, self.half = n, width, half
        shapes = {"Q": (n, width), "K": (n, width), "key": (n,), "lag": (2 * half,)}
        self.size = sum(int(np.prod(s)) for s in shapes.values())
        new = theta is None
        self.theta, at, self.p = np.zeros(self.size) if new else np.array(theta, float), 0, {}
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            self.p[name] = self.theta[at : at + size].reshape(shape)
            at += size
        if new:
            self.p["Q"][...], self.p["K"][...] = np.random.default_rng(seed).normal(size=(2, n, width)) * 0.3
            self.p["lag"][1:] = -2
        # class n stands for nothing: it is masked as an input, and has no value as a target
        pair = np.zeros((n + 1, n + 1), np.float32)
        pair[:n, :n] = np.exp(np.clip(self.p["Q"] @ self.p["K"].T * width**-0.5 + self.p["key"], -30, 30))
        table = np.zeros((distances, n + 1, n + 1), np.float32)
        table[:, :n, :n] = values
        self._pair, tables = pair.ravel(), table.reshape(distances, -1)
        self._values = [tables[min(lag, distances - 1)] for lag in range(2 * half)]
        self._near = np.exp(np.clip(self.p["lag"], -30, 30)).astype(np.float32)

    def _laid(self, classes: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and targets (half, rows) and each class's place among the targets:
        a row of nothing before every sequence, then rows of ``half`` places.  A
        window is a row and the one before it."""
        half, lengths = self.half, lengths[lengths > 0]
        rows, first = -(-lengths // half) + 1, np.cumsum(lengths) - lengths
        begin = (np.cumsum(rows) - rows + 1) * half
        at = np.arange(len(classes)) + np.repeat(begin - first, lengths)
        x, y = np.full((2, int(rows.sum()) * half), self.classes, np.intp)
        y[at], x[at[1:]], x[begin] = classes, classes[:-1], start
        return np.ascontiguousarray(x.reshape(-1, half).T), np.ascontiguousarray(y.reshape(-1, half).T), at

    def _attend(self, x: np.ndarray, y: np.ndarray, step: int) -> Iterator[tuple]:
        """For a query place of ``step`` windows at a time: its rows, the pairs of
        query and inputs, attention before it is divided by its sum, values, and the
        sums of the attention and of the attended values.  All are used up before
        the next."""
        half, rows = self.half, x.shape[1]
        held = np.empty((2 * half, step), np.intp), np.empty((2 * half, step), np.float32), np.empty((2 * half, step), np.float32)
        place = np.empty(step, np.intp)
        for lo in range(1, rows, step):
            hi = min(rows, lo + step)
            keys = [*x[:, lo - 1 : hi - 1], *x[:, lo:hi]]
            scaled = [k * (self.classes + 1) for k in keys]
            pairs, a, v, to = (t[..., : hi - lo] for t in (*held, place))
            for i in range(half):
                seen, target = half + i + 1, y[i, lo:hi]
                for j in range(seen):
                    np.add(scaled[half + i], keys[j], out=pairs[j])
                    np.take(self._pair, pairs[j], out=a[j], mode="clip")
                    a[j] *= self._near[half + i - j]
                    np.add(scaled[j], target, out=to)
                    np.take(self._values[half + i - j], to, out=v[j], mode="clip")
                yield i, lo, hi, pairs[:seen], a[:seen], v[:seen], a[:seen].sum(0), np.einsum("jm,jm->m", a[:seen], v[:seen])

    def log_probs(self, classes: np.ndarray, lengths: np.ndarray, start: int, step: int = 4096) -> np.ndarray:
        """Log probability of every class of the sequences laid end to end, each
        preceded by ``start``."""
        x, y, at = self._laid(classes, lengths, start)
        out = np.ones(x.shape, np.float32)
        for i, lo, hi, _, _, _, whole, hit in self._attend(x, y, step):
            np.divide(hit, whole, out=out[i, lo:hi], where=hit > 0)
        return np.log(out.T.ravel()[at])

    def gradient(self, classes: np.ndarray, lengths: np.ndarray, start: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The log probabilities, and the gradient of their sum."""
        x, y, at = self._laid(classes, lengths, start)
        m, half = self.classes + 1, self.half
        out, pairs_sum, lag = np.ones(x.shape, np.float32), np.zeros(m * m), np.zeros(2 * half)
        for i, lo, hi, pairs, a, v, whole, hit in self._attend(x, y, step):
            some = hit > 0
            np.divide(hit, whole, out=out[i, lo:hi], where=some)
            # attention times what the value has over the mixture, as a share of it
            v *= np.divide(1, hit, out=np.zeros_like(hit), where=some)
            v -= np.divide(1, whole, out=np.zeros_like(hit), where=some)
            v *= a
            pairs_sum += np.bincount(pairs.ravel(), v.ravel(), m * m)
            lag[: half + i + 1] += v.sum(1, dtype=float)[::-1]
        d, scale = pairs_sum.reshape(m, m)[:-1, :-1], self.width**-0.5
        return np.log(out.T.ravel()[at]), np.concatenate([(d @ self.p["K"] * scale).ravel(), (d.T @ self.p["Q"] * scale).ravel(), d.sum(0), lag])


class Adam:
    """Steps uphill, by gradients that are means."""

    def __init__(self, size: int, rate: float = 0.4):
        self.rate, self.n, self.m, self.v = rate, 0, np.zeros(size), np.zeros(size)

    def step(self, theta: np.ndarray, gradient: np.ndarray, slower: float = 1.0) -> np.ndarray:
        self.n += 1
        self.m = 0.8 * self.m + 0.2 * gradient
        self.v = 0.95 * self.v + 0.05 * gradient**2
        # the bound keeps rounding where there is no gradient from being steps
        return theta + slower * self.rate * (self.m / (1 - 0.8**self.n)) / (np.sqrt(self.v / (1 - 0.95**self.n)) + 1e-7)
