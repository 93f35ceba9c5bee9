"""A softmax classifier over sparse hashed features, fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray  # features x classes
    bias: np.ndarray

    def probabilities(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Class probabilities of ``n`` documents; one without features gets those of the bias."""
        z = np.stack(
            [np.bincount(doc, self.weights[feature, k] * value, n) for k in range(len(self.bias))], axis=1
        )
        return softmax(z + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# Places whose products are held at once.
BLOCK = 1 << 17


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of neighbouring rows of about ``BLOCK`` places, and the places that they take."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + BLOCK, side="right")) - 1)
        yield begin, end, int(ends[begin]), int(ends[end])
        begin = end


def fit(
    doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, features: int,
    steps: int = 150, rate: float = 0.05, l2: float = 1e-4, weight: np.ndarray | None = None,
) -> LinearModel:
    """Minimise cross-entropy to soft labels ``target`` (documents x classes) by Adam over all rows,
    each of which counts as ``weight`` says; ``doc`` is ascending.

    Deterministic: nothing is drawn, and the order of rows only moves the last digits.  Held are the places
    in the order of documents and in that of features; what a step computes for each is held by blocks.
    """
    n, classes = target.shape
    weight = np.ones(n) if weight is None else weight.astype(np.float64)
    counted = (weight / weight.sum())[:, None] if n else np.zeros((0, 1))
    each = np.bincount(feature, minlength=features)
    used = np.flatnonzero(each)
    place = np.zeros(features, np.int32)
    place[used] = np.arange(len(used))
    column = place[feature]
    order = np.argsort(column, kind="stable").astype(np.int32)
    doc_of, value_of = doc[order], value[order]
    del order
    by_doc, by_column = list(blocks(np.bincount(doc, minlength=n))), list(blocks(each[used]))
    each = each[used]
    share = (target * counted).sum(axis=0) if n else np.full(classes, 1 / classes)
    bias = np.log(np.maximum(share, 1e-6))
    w = np.zeros((len(used), classes))
    z = np.zeros((n, classes))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, bias)]

    def move(p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, t: int) -> None:
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)

    for t in range(1, steps + 1 if n else 1):
        for begin, end, first, last in by_doc:
            rows, own = doc[first:last] - begin, column[first:last]
            for k in range(classes):
                z[begin:end, k] = np.bincount(rows, w[own, k] * value[first:last], end - begin)
        error = (softmax(z + bias) - target) * counted
        for begin, end, first, last in by_column:
            rows, own = np.repeat(np.arange(end - begin), each[begin:end]), doc_of[first:last]
            slope = [np.bincount(rows, error[own, k] * value_of[first:last], end - begin) for k in range(classes)]
            part = w[begin:end]
            move(part, *(m[begin:end] for m in moments[0]), np.stack(slope, axis=1) + l2 * part / max(1, n) * 100, t)
        move(bias, *moments[1], error.sum(axis=0), t)
    weights = np.zeros((features, classes), np.float32)
    weights[used] = w
    return LinearModel(weights, bias)
