"""Linear-chain conditional random fields in numpy: training by gradient steps, Viterbi in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: One position: the names of its features. One sequence: its positions and their labels.
Position = list[str]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


@dataclass
class Field:
    states: tuple[str, ...]
    features: dict[str, int]
    weights: np.ndarray  #: features x states
    moves: np.ndarray  #: states x states, from the earlier to the later
    first: np.ndarray

    def emit(self, positions: list[Position]) -> np.ndarray:
        """Scores of the states at each position; features never met in training count nothing."""
        out = np.zeros((len(positions), len(self.states)))
        for k, p in enumerate(positions):
            ids = [self.features[f] for f in p if f in self.features]
            if ids:
                out[k] = self.weights[ids].sum(0)
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best states of many sequences at once. Sequences are sorted by length, so a batch
        is padded little; its memory is positions times states."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
        order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
        at = 0
        while at < len(order):
            size = max(1, min(256, 200_000 // max(1, len(scores[order[min(at + 255, len(order) - 1)]]))))
            part = order[at : at + size]
            at += size
            longest = len(scores[part[-1]])
            e = np.zeros((longest, len(part), len(self.states)))
            n = np.array([len(scores[k]) for k in part])
            for j, k in enumerate(part):
                e[: n[j], j] = scores[k]
            best = self.first + e[0]
            back = np.zeros(e.shape, np.int8)
            for t in range(1, longest):
                options = best[:, :, None] + self.moves
                back[t] = options.argmax(1)
                step = np.take_along_axis(options, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
                live = (t < n)[:, None]
                best = np.where(live, step, best)
            state = best.argmax(1)
            paths = np.zeros((len(part), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                paths[:, t] = state
                if t:
                    state = np.where(t < n, back[t][np.arange(len(part)), state], state)
            for j, k in enumerate(part):
                out[k] = paths[j, : n[j]]
        return out


def train(states: tuple[str, ...], data: list[tuple[list[Position], list[str]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Field:
    """A field for labelled sequences, by Adagrad steps on the likelihood, one sequence a step."""
    number = {s: k for k, s in enumerate(states)}
    features: dict[str, int] = {}
    for positions, _ in data:
        for p in positions:
            for f in p:
                features.setdefault(f, len(features))
    s = len(states)
    w, moves, first = np.zeros((len(features), s)), np.zeros((s, s)), np.zeros(s)
    gw, gm, gf = (np.full(x.shape, 1e-2) for x in (w, moves, first))
    coded = [([np.array([features[f] for f in p], np.int64) for p in positions], np.array([number[y] for y in labels])) for positions, labels in data if positions]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for at in rng.permutation(len(coded)):
            ids, y = coded[at]
            n = len(ids)
            e = np.array([w[i].sum(0) for i in ids])
            a, b = np.zeros((n, s)), np.zeros((n, s))
            a[0] = first + e[0]
            for t in range(1, n):
                a[t] = _lse(a[t - 1][:, None] + moves, 0) + e[t]
            for t in range(n - 2, -1, -1):
                b[t] = _lse(moves + (e[t + 1] + b[t + 1])[None, :], 1)
            total = _lse(a[-1], 0)
            d = -np.exp(a + b - total)
            d[np.arange(n), y] += 1
            dm = np.zeros((s, s))
            for t in range(1, n):
                dm -= np.exp(a[t - 1][:, None] + moves + (e[t] + b[t])[None, :] - total)
                dm[y[t - 1], y[t]] += 1
            for t, i in enumerate(ids):
                g = d[t] - decay * w[i]
                gw[i] += g**2
                w[i] += rate * g / np.sqrt(gw[i])
            gm += dm**2
            moves += rate * dm / np.sqrt(gm)
            gf += d[0] ** 2
            first += rate * d[0] / np.sqrt(gf)
    return Field(states, features, w, moves, first)
