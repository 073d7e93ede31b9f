"""A small convolutional text classifier in numpy: embeddings, filters of several widths, max pooling.

Texts are rows of embedding numbers, one after another, each followed by padding as wide as
the widest filter; a token may have several numbers, whose embeddings are summed. Only the
position that gave a filter its maximum has a gradient, so a training step touches few rows.
For scoring, embeddings times filters become one table, and a filter is sums of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Net:
    """table: a row per embedding number, a block of ``filters`` columns for each place of each width."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    widths: tuple[int, ...]
    filters: int

    def pooled(self, flat: np.ndarray, starts: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return _pool(sum(self.table[flat[:, k]] for k in range(flat.shape[1])), self.bias, starts, valid, self.widths, self.filters)[0]

    def logits(self, flat: np.ndarray, starts: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return self.pooled(flat, starts, valid) @ self.out + self.out_bias


def _blocks(widths: tuple[int, ...], f: int):
    at = 0
    for w in widths:
        yield w, [slice(at + j * f, at + (j + 1) * f) for j in range(w)]
        at += w * f


def _pool(z: np.ndarray, bias: np.ndarray, starts: np.ndarray, valid: np.ndarray, widths: tuple[int, ...], f: int) -> tuple[np.ndarray, list[np.ndarray]]:
    n, out, convs = len(z), [], []
    for (w, blocks), b in zip(_blocks(widths, f), np.split(bias, len(widths))):
        conv = z[:, blocks[0]] + b
        for j in range(1, w):
            conv[: n - j] += z[j:, blocks[j]]
        conv[~valid] = -np.inf
        convs.append(conv)
        out.append(np.maximum.reduceat(conv, starts, axis=0))
    return np.maximum(np.concatenate(out, axis=1), 0), convs


def layout(texts: list[np.ndarray], widest: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of numbers, start of each text, which rows are places of a text); an empty text is one padding place."""
    k = texts[0].shape[1] if texts else 1
    gap = np.full((widest - 1, k), pad, np.int32)
    none = np.full((1, k), pad, np.int32)
    parts, starts, valid, at = [], [], [], 0
    for t in texts:
        t = t if len(t) else none
        parts += [t, gap]
        starts.append(at)
        valid += [np.ones(len(t), bool), np.zeros(widest - 1, bool)]
        at += len(t) + widest - 1
    if not texts:
        return np.zeros((0, k), np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(parts), np.array(starts), np.concatenate(valid)


#: Rows of numbers that a training step embeds at a time; a longer text goes in runs.
STEP_ROWS = 1 << 16


@dataclass
class State:
    """What training changes: embeddings, filters, their bias, weights, their bias; and the sums of squared gradients of each."""

    values: list[np.ndarray]
    seen: list[np.ndarray]
    widths: tuple[int, ...]
    filters: int

    def net(self) -> Net:
        emb, w_, bias, out, out_bias = self.values
        return Net((emb @ w_).astype(np.float32), bias, out, out_bias, self.widths, self.filters)

    def copy(self) -> State:
        return State([x.copy() for x in self.values], [x.copy() for x in self.seen], self.widths, self.filters)


def begin(classes: int, numbers: int, widths: tuple[int, ...], filters: int = 8, dim: int = 16, seed: int = 42) -> tuple[State, np.random.Generator]:
    """A state before any step, and the generator that made it."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (numbers + 1, dim)).astype(np.float32)
    emb[numbers] = 0
    w_ = rng.normal(0, 0.3, (dim, filters * sum(widths))).astype(np.float32)
    bias = np.zeros(filters * len(widths), np.float32)
    out = rng.normal(0, 0.3, (filters * len(widths), classes)).astype(np.float32)
    values = [emb, w_, bias, out, np.zeros(classes, np.float32)]
    return State(values, [np.full_like(x, 1e-3) for x in values], widths, filters), rng


def _won(state: State, flat: np.ndarray, starts: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(pooled filters of each text, for each width the place in ``flat`` that gave each filter its maximum), embedding so many rows at a time."""
    emb, w_, bias = state.values[:3]
    f, widest = state.filters, max(state.widths)
    ends, at = [*starts[1:].tolist(), len(flat)], 0
    pools, wheres = [], [[] for _ in state.widths]
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + STEP_ROWS, "right")), at + 1)
        low, high = int(starts[at]), ends[to - 1]
        best, where = None, None
        for first in range(low, high, STEP_ROWS):  # one run, but for a text that is longer
            last = min(first + STEP_ROWS + widest - 1, high)
            own = valid[first:last].copy()
            own[STEP_ROWS:] = False  # the next run has these, with what follows them
            if not own.any():
                continue
            some = starts[at:to] - low if high - low <= STEP_ROWS else np.zeros(1, np.int64)
            pool, convs = _pool(emb[flat[first:last]].sum(axis=1) @ w_, bias, some, own, state.widths, f)
            places = [np.stack([first + a + c[a:b].argmax(axis=0) for a, b in zip(some, [*some[1:], last - first])]) for c in convs]
            if best is None:
                best, where = pool, places
            else:
                more = pool > best
                best = np.where(more, pool, best)
                where = [np.where(more[:, i * f : (i + 1) * f], p, w) for i, (p, w) in enumerate(zip(places, where))]
        pools.append(best)
        for i, w in enumerate(where):
            wheres[i].append(w)
        at = to
    return np.concatenate(pools), [np.concatenate(w) for w in wheres]


def go_on(state: State, texts: list[np.ndarray], labels: np.ndarray, epochs: int, rng: np.random.Generator, batch: int = 32, rate: float = 0.1) -> None:
    """Adagrad steps over ``texts``, so many times; changes ``state``."""
    emb, w_, bias, out, out_bias = state.values
    seen, widths, filters = state.seen, state.widths, state.filters
    numbers, dim, widest = len(emb) - 1, emb.shape[1], max(widths)

    def step(p, s, g):
        s += g * g
        p -= rate * g / np.sqrt(s)

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), batch):
            some = order[first : first + batch]
            flat, starts, valid = layout([texts[i] for i in some], widest, numbers)
            pool, places = _won(state, flat, starts, valid)
            z = pool @ out + out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p /= len(some)
            d_pool = (p @ out.T) * (pool > 0)
            step(out, seen[3], pool.T @ p)
            step(out_bias, seen[4], p.sum(axis=0))
            d_w, at_rows, at_grads = np.zeros_like(w_), [], []
            for i, (w, blocks) in enumerate(_blocks(widths, filters)):
                g = d_pool[:, i * filters : (i + 1) * filters]
                for j, block in enumerate(blocks):
                    own = flat[places[i] + j]
                    d_w[:, block] += np.einsum("bfd,bf->df", emb[own].sum(axis=2), g)
                    at_rows.append(own.reshape(-1, flat.shape[1]))
                    at_grads.append((g[:, :, None] * w_[:, block].T[None]).reshape(-1, dim))
            step(bias, seen[2], d_pool.sum(axis=0))
            rows, grads = np.concatenate(at_rows), np.concatenate(at_grads)
            busy = np.abs(grads).sum(axis=1) > 0
            rows, grads = rows[busy], grads[busy]
            for k in range(rows.shape[1]):
                u, back = np.unique(rows[:, k], return_inverse=True)
                g = np.zeros((len(u), dim), np.float32)
                np.add.at(g, back, grads)
                g[u == numbers] = 0
                s = seen[0][u] + g * g
                seen[0][u] = s
                emb[u] -= rate * g / np.sqrt(s)
            step(w_, seen[1], d_w)


def train(texts: list[np.ndarray], labels: np.ndarray, classes: int, numbers: int, widths: tuple[int, ...], filters: int = 8, dim: int = 16, epochs: int = 6, batch: int = 32, rate: float = 0.1, seed: int = 42) -> Net:
    """Softmax regression on pooled filters; Adagrad steps. Number ``numbers`` is the padding and stays zero."""
    state, rng = begin(classes, numbers, widths, filters, dim, seed)
    go_on(state, texts, labels, epochs, rng, batch, rate)
    return state.net()
