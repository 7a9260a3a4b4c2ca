"""Bit predictors over counted contexts, combined by gated weights in the logistic domain: the arithmetic of ``lm`` on arrays.

A gram is six bytes as one number, nearest context byte first: c1 c2 c3 c4 c5 and the byte that follows, so grams in order have
the contexts of every order side by side. A byte is predicted bit by bit, from the highest: a predictor's slot is its context's hash
with the bits so far, and its counts are sums over the bytes that share them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ORDER = 5
#: Training is in folds: what is learned from a fold's bytes sees counts of the other folds only.
FOLDS = 3
INPUTS = ORDER + 1
GATES_A, GATES_B = INPUTS * 4, 8 * 4
#: Pseudo-count of either bit.
PRIOR = 0.1
STEPS = 33
SPAN = 8.0


@dataclass
class Weights:
    """Two sets of weights, chosen by how far contexts are known and by place in the byte, and a refinement by bits so far and probability."""

    a: np.ndarray
    b: np.ndarray
    ones: np.ndarray  # (256, STEPS): how often the bit was 1, and how often it was anything
    all: np.ndarray

    @staticmethod
    def start() -> Weights:
        grid = 1 / (1 + np.exp(-np.linspace(-SPAN, SPAN, STEPS)))
        return Weights(np.full((INPUTS, GATES_A), 0.3), np.zeros((INPUTS, GATES_B)), np.tile(8 * grid, (256, 1)), np.full((256, STEPS), 8.0))


def grams(data: np.ndarray) -> np.ndarray:
    """The gram of each byte of ``data`` from its sixth on."""
    a = data.astype(np.uint64)
    out = a[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= a[ORDER - k : len(a) - k] << np.uint64(8 * (6 - k))
    return out


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, dtype=np.int64)


def taken(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (context, byte) of sorted ``pairs`` and each of the byte's bits: counts of the bit it has, and of either bit."""
    sums = np.empty((9, len(pairs)), dtype=np.float32)
    sums[8] = n
    for level in range(8):
        at = runs(pairs >> np.uint64(8 - level))
        sums[level] = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(pairs)))) if len(pairs) else 0
    return sums[1:], sums[:8]


class Slots:
    """(context, byte) pairs of every order from 2 of the grams of a bucket, which holds all grams of its two nearest bytes."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.at = keys, []
        for k in range(2, ORDER + 1):
            pair = (keys >> np.uint64(48 - 8 * k)) << np.uint64(8) | (keys & np.uint64(255))
            self.at.append(np.unique(pair, return_inverse=True))
        #: Of orders 0 and 1, which are counted over all buckets.
        self.near = (keys >> np.uint64(40) << np.uint64(8) | (keys & np.uint64(255))).astype(np.int64)

    def inputs(self, n: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched probabilities of the bits the bytes have (INPUTS x 8 x grams), and gates of either set of weights.

        n: counts of the grams; near: counts (65,536) of byte pairs.
        """
        rows, totals = [], []
        every = np.arange(65536, dtype=np.uint64)
        for order in (0, 1):
            one, two = taken(every[:256], near.reshape(256, 256).sum(axis=0)) if order == 0 else taken(every, near)
            where = self.near & 255 if order == 0 else self.near
            rows.append(one[:, where])
            totals.append(two[:, where])
        for pairs, back in self.at:
            one, two = taken(pairs, np.bincount(back, weights=n, minlength=len(pairs)))
            rows.append(one[:, back])
            totals.append(two[:, back])
        one, two = np.stack(rows), np.stack(totals)
        x = np.log((one + PRIOR) / (two - one + PRIOR))
        known = (two > 0).sum(axis=0)  # contexts are known up to some order
        top = np.maximum(known - 1, 0)
        sure = np.minimum(np.log2(np.maximum(np.take_along_axis(two, top[None], 0)[0], 1)), 3).astype(np.int64)
        middle = np.minimum(np.log2(two[3] + 1), 3).astype(np.int64)
        return x, top * 4 + sure, np.arange(8)[:, None] * 4 + middle

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte's bits: the bits so far with a leading 1, and the bit."""
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        level = np.arange(8)[:, None]
        return (1 << level) | (byte >> (8 - level)), byte >> (7 - level) & 1


def mixed(w: Weights, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Stretched probability of the bits the bytes have."""
    out = np.zeros(a.shape)
    for k in range(INPUTS):
        out += (w.a[k][a] + w.b[k][b]) * x[k]
    return np.clip(out, -SPAN * 2, SPAN * 2)


def learn(w: Weights, x: np.ndarray, a: np.ndarray, b: np.ndarray, often: np.ndarray, rng: np.random.Generator, batch: int = 256, rate: float = 0.03) -> None:
    """Online: the grams pass in random order, and after each few the weights step along the gradient of the coding cost."""
    order = rng.permutation(np.flatnonzero(often > 0))
    scale = often[order].mean() if len(order) else 1.0
    past_a, past_b = np.full(w.a.shape, 1e-3), np.full(w.b.shape, 1e-3)
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        xs, ga, gb = x[:, :, some], a[:, some], b[:, some]
        miss = (1 - 1 / (1 + np.exp(-mixed(w, xs, ga, gb)))) * (often[some] / scale / batch)
        for k in range(INPUTS):
            for weights, past, gate, n in ((w.a, past_a, ga, GATES_A), (w.b, past_b, gb, GATES_B)):
                g = np.bincount(gate.ravel(), weights=(miss * xs[k]).ravel(), minlength=n)
                past[k] += g * g
                weights[k] += rate * g / np.sqrt(past[k])


def observe(w: Weights, z: np.ndarray, so_far: np.ndarray, bit: np.ndarray, often: np.ndarray) -> None:
    """Count what came of each probability: by bits so far and the nearest step of the stretched probability of a 1."""
    cell = so_far * STEPS + np.rint((np.clip(np.where(bit == 1, z, -z), -SPAN, SPAN) + SPAN) * ((STEPS - 1) / (2 * SPAN))).astype(np.int64)
    weight = np.broadcast_to(often, z.shape).ravel()
    w.all += np.bincount(cell.ravel(), weights=weight, minlength=256 * STEPS).reshape(256, STEPS)
    w.ones += np.bincount(cell.ravel(), weights=weight * bit.ravel(), minlength=256 * STEPS).reshape(256, STEPS)


def log2p(w: Weights, z: np.ndarray, so_far: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the probability of each byte: by the mixer, and refined by what came of such probabilities, half and half with it."""
    p = 1 / (1 + np.exp(-z))
    place = (np.clip(np.where(bit == 1, z, -z), -SPAN, SPAN) + SPAN) * ((STEPS - 1) / (2 * SPAN))
    low = np.minimum(place.astype(np.int64), STEPS - 2)
    table = w.ones / w.all
    one = table[so_far, low] * (1 - place + low) + table[so_far, low + 1] * (place - low)
    refined = 0.5 * p + 0.5 * np.where(bit == 1, one, 1 - one)
    return np.log2(p).sum(axis=0), np.log2(refined).sum(axis=0)
