"""Distances to the decision boundary: how small a change flips the prediction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.operators.greedy import top_k
from tamis.plans.model import matrix


def _scored(pool: DataFrame, compute) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(compute(matrix(batch.column(1))))], ["id", "score"])

    return pool.select("id", "x").mapInArrow(run, "id long, score double")


def sign_steps(model, x: np.ndarray, eps: float, most: int) -> np.ndarray:
    """Squared length of the change after steps of eps * sign(gradient) until each row's prediction flips."""
    start, change = model.logits(x).argmax(axis=1), np.zeros(x.shape)
    left = np.arange(len(x))
    for _ in range(most):
        if not len(left):
            break
        z = model.logits(x[left] + change[left])
        flipped = z.argmax(axis=1) != start[left]
        left, z = left[~flipped], z[~flipped]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(left)), start[left]] -= 1
        change[left] += eps * np.sign(model.input_gradient(x[left] + change[left], p))
    return (change**2).sum(axis=1)


def deep_fool(model, x: np.ndarray, most: int, overshoot: float = 0.02) -> np.ndarray:
    """Squared length of the change to the nearest linearised boundary, step by step until each row's prediction flips."""
    start, change = model.logits(x).argmax(axis=1), np.zeros(x.shape)
    left = np.arange(len(x))
    for _ in range(most):
        if not len(left):
            break
        at = x[left] + (1 + overshoot) * change[left]
        z = model.logits(at)
        flipped = z.argmax(axis=1) != start[left]
        left, z, at = left[~flipped], z[~flipped], at[~flipped]
        if not len(left):
            break
        own = start[left]
        rows = np.arange(len(left))
        least, step = np.full(len(left), np.inf), np.zeros((len(left), x.shape[1]))
        for c in range(model.classes):
            error = np.zeros(z.shape)
            error[:, c] += 1
            error[rows, own] -= 1
            w = model.input_gradient(at, error)
            norm = np.sqrt((w**2).sum(axis=1))
            d = np.where((own != c) & (norm > 0), np.abs(z[:, c] - z[rows, own]) / np.maximum(norm, 1e-300), np.inf)
            near = d < least
            least = np.where(near, d, least)
            step[near] = ((d + 1e-4) / np.maximum(norm, 1e-300))[near, None] * w[near]
        change[left] += step
    return ((1 + overshoot) ** 2) * (change**2).sum(axis=1)


def select_bim(model, pool: DataFrame, k: int, eps: float = 0.05, most: int = 1000) -> DataFrame:
    return top_k(_scored(pool, lambda x: sign_steps(model, x, eps, most)), k, ascending=True)


def select_deepfool(model, pool: DataFrame, k: int, most: int = 50) -> DataFrame:
    return top_k(_scored(pool, lambda x: deep_fool(model, x, most)), k, ascending=True)
