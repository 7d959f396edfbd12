"""Models that add logits and an embedding to a table of feature vectors.

A model is anything with ``classes`` and ``forward(df)``: it adds ``logits``
and ``emb`` to rows with ``x``; with ``passes(df, n)`` it can also add the
logits of n dropout passes. Weights are small (classes by dimensions) and ride
along with the tasks; rows go through numpy in Arrow batches where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

DOUBLES = ArrayType(DoubleType())


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors of an Arrow list column as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def vectors(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).ravel()))


def add_vectors(df: DataFrame, names: list[str], compute: Callable[[np.ndarray], list[np.ndarray]], source: str = "x") -> DataFrame:
    """``df`` with vector columns computed from a batch of ``source`` vectors."""
    kept = [c for c in df.columns if c not in names]
    df = df.select(*kept)
    place = kept.index(source)
    schema = StructType([*df.schema.fields, *[StructField(n, DOUBLES) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(vectors, compute(matrix(batch.column(place))))], schema.names)

    return df.mapInArrow(run, schema)


def uniform(*parts: object) -> float:
    """functions.vectors.uniform for one row."""
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def dropout_masks(passes: int, width: int, rate: float = 0.5, seed: int = 0) -> np.ndarray:
    """(passes, width) of 0 and 1 / (1 - rate): one mask per pass, the same for every row."""
    u = np.array([[uniform(seed, k, d) for d in range(width)] for k in range(passes)])
    return (u >= rate) / (1 - rate)


class LinearHead:
    """logits = scale * W x + b, with the input as the embedding."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray | None = None, scale: float = 1.0):
        self.weights = np.asarray(weights, float) * scale
        self.bias = np.zeros(len(self.weights)) if bias is None else np.asarray(bias, float)

    @property
    def classes(self) -> int:
        return len(self.weights)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.bias

    def forward(self, df: DataFrame) -> DataFrame:
        own = self
        return add_vectors(df, ["logits"], lambda x: [own.logits(x)]).withColumn("emb", F.col("x"))

    def passes(self, df: DataFrame, n: int, rate: float = 0.5, seed: int = 0) -> DataFrame:
        """Adds ``passes``: n arrays of logits, dropout on the input."""
        own, masks = self, dropout_masks(n, self.weights.shape[1], rate, seed)
        flat = add_vectors(df, ["passes"], lambda x: [np.concatenate([own.logits(x * m) for m in masks], axis=1)])
        return _split_passes(flat, n, self.classes)

    def input_gradient(self, x: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Gradient of the loss by the input, from that by the logits."""
        return error @ self.weights


class TwoLayer:
    """logits = W2 relu(W1 x + b1) + b2, with the hidden layer as the embedding."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray):
        self.w1, self.b1, self.w2, self.b2 = (np.asarray(a, float) for a in (w1, b1, w2, b2))

    @property
    def classes(self) -> int:
        return len(self.w2)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1.T + self.b1, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2.T + self.b2

    def forward(self, df: DataFrame) -> DataFrame:
        own = self

        def both(x):
            h = own.hidden(x)
            return [h @ own.w2.T + own.b2, h]

        return add_vectors(df, ["logits", "emb"], both)

    def layer(self, df: DataFrame, name: str) -> DataFrame:
        """Adds ``emb`` from a layer by its name: input, preactivation, hidden or logits."""
        own = self
        layers = {"input": lambda x: x, "preactivation": lambda x: x @ own.w1.T + own.b1, "hidden": own.hidden, "logits": own.logits}
        if name not in layers:
            raise ValueError(f"unknown layer {name!r}; one of {', '.join(layers)}")
        return add_vectors(df, ["emb"], lambda x: [layers[name](x)])

    def passes(self, df: DataFrame, n: int, rate: float = 0.5, seed: int = 0) -> DataFrame:
        own, masks = self, dropout_masks(n, len(self.b1), rate, seed)
        flat = add_vectors(df, ["passes"], lambda x: [np.concatenate([(own.hidden(x) * m) @ own.w2.T + own.b2 for m in masks], axis=1)])
        return _split_passes(flat, n, self.classes)

    def input_gradient(self, x: np.ndarray, error: np.ndarray) -> np.ndarray:
        return ((error @ self.w2) * (x @ self.w1.T + self.b1 > 0)) @ self.w1


def _split_passes(df: DataFrame, n: int, classes: int) -> DataFrame:
    return df.withColumn("passes", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice("passes", k * classes + 1, F.lit(classes))))


def fit_prototypes(labelled: DataFrame, classes: int, scale: float = 20.0) -> LinearHead:
    """A head whose weights for a class are the mean vector of its rows; a class without rows gets zeros."""
    means = labelled.select("label", F.posexplode("x").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("m"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("w")).collect()  # a row per class
    width = max((len(r["w"]) for r in rows), default=0)
    weights = np.zeros((classes, width))
    for r in rows:
        weights[r["label"]] = [e["m"] for e in r["w"]]
    return LinearHead(weights, scale=scale)


def train_linear(labelled: DataFrame, classes: int, width: int, epochs: int = 50, rate: float = 1.0, momentum: float = 0.9, decay: float = 5e-4, weight: str | None = None, max_accuracy: float = 1.0, window: int = 10, min_gain: float = 0.0) -> tuple[LinearHead, list[float]]:
    """Softmax regression by full-batch descent; (head, accuracy per epoch).

    An epoch is one pass over the rows: tasks sum the gradient of theirs, the
    sums meet in one row. It ends at ``max_accuracy``, after ``epochs``, or when
    no later accuracy in the last ``window`` is ``min_gain`` above an earlier
    one. ``weight`` names a column of row weights.
    """
    rows = labelled.select("x", "label", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).cache()
    head, velocity, curve = LinearHead(np.zeros((classes, width))), np.zeros((classes, width + 1)), []
    for _ in range(epochs):
        gradient, correct, n = _gradient(rows, head, classes, width)
        if not n:
            break
        curve.append(correct / n)
        if curve[-1] >= max_accuracy or saturated(curve, window, min_gain):
            break
        velocity = momentum * velocity + gradient / n + decay * np.concatenate([head.weights, head.bias[:, None]], axis=1)
        step = np.concatenate([head.weights, head.bias[:, None]], axis=1) - rate * velocity
        head = LinearHead(step[:, :-1], step[:, -1])
    rows.unpersist()
    return head, curve


def _gradient(rows: DataFrame, head: LinearHead, classes: int, width: int) -> tuple[np.ndarray, float, float]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * (width + 1) + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            z = head.logits(x)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= w[:, None]
            total[:-2] += np.concatenate([p.T @ x, p.sum(axis=0)[:, None]], axis=1).ravel()
            total[-2:] += (z.argmax(axis=1) == y).sum(), len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["d", "v"])

    summed = rows.mapInArrow(partial, "d long, v double").groupBy("d").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(classes * (width + 1) + 2)
    out[summed.column("d").to_numpy()] = summed.column("v").to_numpy()
    return out[:-2].reshape(classes, width + 1), out[-2], out[-1]


def saturated(curve: list[float], window: int, min_gain: float) -> bool:
    last = curve[-window:]
    return min_gain > 0 and len(last) == window and max(b - a for i, a in enumerate(last) for b in last[i + 1 :]) < min_gain


def average_weights(heads: list[LinearHead]) -> LinearHead:
    """The mean of several heads' weights."""
    return LinearHead(np.mean([h.weights for h in heads], axis=0), np.mean([h.bias for h in heads], axis=0))
