"""Mini-batch training of heads and two-layer networks over tables.

An epoch is one pass. Rows are dealt to tasks once and read in an order that a
hash of seed, epoch and id gives. There are two ways to take many tasks:

* synchronous: the mini-batches are the whole table's. Rows are written by
  mini-batch once; a step is a job over one of them whose tasks add up its
  gradient, so the weights do not depend on the number of tasks. Mini-batches
  should be large here. (Gathering in a barrier stage takes a second a step.)
* averaged: every task descends on its own mini-batches from the same start, and
  the tasks' weights, weighed by their rows, are averaged after each epoch: one
  exchange an epoch. With one task this is plain stochastic descent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.vectors import uniform
from tamis.plans.blocks import summed
from tamis.plans.model import LinearHead, TwoLayer, matrix, saturated
from tamis.plans.model import uniform as uniform_number
from tamis.shared import new_folder, stash

#: A loss takes logits (n, classes) and labels and gives the losses (n) and their gradient by the logits.
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def cross_entropy(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shifted = z - z.max(axis=1, keepdims=True)
    e = np.exp(shifted)
    p = e / e.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    losses = np.log(e.sum(axis=1)) - shifted[at, y]
    p[at, y] -= 1
    return losses, p


def squared_error(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the squared distance of the logits from the one-hot label."""
    error = z.copy()
    error[np.arange(len(y)), y] -= 1
    return (error**2).sum(axis=1) / 2, error


def fresh(kind: str, width: int, classes: int, hidden: int = 100, seed: int = 0) -> LinearHead | TwoLayer:
    """A model ("linear" or "two_layer") with weights drawn within one over the root of a layer's width."""
    rng = np.random.default_rng(seed)
    layer = lambda rows, columns: (rng.uniform(-1, 1, (rows, columns)) / math.sqrt(columns), rng.uniform(-1, 1, rows) / math.sqrt(columns))
    if kind == "linear":
        return LinearHead(*layer(classes, width))
    if kind == "two_layer":
        return TwoLayer(*layer(hidden, width), *layer(classes, hidden))
    raise ValueError(f"unknown model {kind!r}; linear or two_layer")


def weights_of(model: LinearHead | TwoLayer) -> list[np.ndarray]:
    return [model.weights, model.bias] if isinstance(model, LinearHead) else [model.w1, model.b1, model.w2, model.b2]


def with_weights(model: LinearHead | TwoLayer, weights: list[np.ndarray]) -> LinearHead | TwoLayer:
    return type(model)(*weights)


def weight_gradient(model: LinearHead | TwoLayer, x: np.ndarray, error: np.ndarray) -> list[np.ndarray]:
    """Gradient by each weight array, from that by the logits."""
    if isinstance(model, LinearHead):
        return [error.T @ x, error.sum(axis=0)]
    h = model.hidden(x)
    back = (error @ model.w2) * (h > 0)
    return [back.T @ x, back.sum(axis=0), error.T @ h, error.sum(axis=0)]


@dataclass
class Trainer:
    """How to train: fields named as the steps they set.

    ``optimizer`` is "sgd" (momentum, decay, and a rate that falls by a cosine
    over ``epochs``) or "adam" (no decay, steady rate). Training ends at
    ``max_accuracy``, after ``epochs``, or when no later accuracy in the last
    ``window`` is ``min_gain`` above an earlier one. Where after each 50 epochs
    the accuracy is still below ``restart_below``, it starts from fresh weights.

    ``synchronous`` training takes a step per mini-batch of the whole table. A
    row's mini-batch, one of ``batches`` or of rows / ``batch``, is given by the
    hash of seed and id; epochs visit them in orders of their own, each with as
    many tasks as there are cores, if ``tasks`` is not given. From epoch
    ``average_from`` on, a running mean of the weights after each epoch is kept,
    and is what training gives. ``stop_after`` ends it early on its schedule.
    """

    rate: float = 0.01
    epochs: int = 300
    batch: int = 20
    optimizer: str = "sgd"
    momentum: float = 0.9
    decay: float = 5e-4
    max_accuracy: float = 0.95
    window: int = 10
    min_gain: float = 0.0
    restart_below: float = 0.2
    loss: Loss = cross_entropy
    tasks: int | None = None
    seed: int = 0
    beta: tuple[float, float] = field(default=(0.9, 0.999))
    synchronous: bool = False
    batches: int | None = None
    average_from: int | None = None
    stop_after: int | None = None

    def train(self, labelled: DataFrame, model: LinearHead | TwoLayer, weight: str | None = None) -> tuple[LinearHead | TwoLayer, list[tuple[float, float]]]:
        """The model trained from its present weights, and (accuracy, mean loss) per epoch; ``weight`` names a column of row weights."""
        if self.optimizer not in ("sgd", "adam"):
            raise ValueError(f"unknown optimizer {self.optimizer!r}; sgd or adam")
        rows = labelled.select("id", "x", "label", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
        if self.synchronous:
            steps = self.batches or math.ceil(rows.count() / self.batch)
            if not steps:
                return model, []
            rows = self._dealt(rows, steps, self.tasks or labelled.sparkSession.sparkContext.defaultParallelism)
        else:
            rows = stash(rows.repartition(self.tasks, "id") if self.tasks else rows)
        state, log, restarts, mean, taken = self._begin(model), [], 0, None, 0
        for epoch in range(min(self.epochs, self.stop_after or self.epochs)):
            state, accuracy, loss, n = self._epoch_together(rows, model, state, epoch, steps) if self.synchronous else self._epoch(rows, model, state, epoch)
            if not n:
                break
            log.append((accuracy, loss))
            if self.average_from is not None and epoch >= self.average_from:
                taken += 1
                mean = [w + 0 for w in state[0]] if mean is None else [m + (w - m) / taken for m, w in zip(mean, state[0])]
            if accuracy >= self.max_accuracy or saturated([a for a, _ in log], self.window, self.min_gain):
                break
            if (epoch + 1) % 50 == 0 and accuracy < self.restart_below:
                restarts += 1
                kind, w = ("linear", model.weights) if isinstance(model, LinearHead) else ("two_layer", model.w1)
                state, mean, taken = self._begin(fresh(kind, w.shape[1], model.classes, len(w), self.seed + restarts)), None, 0
        return with_weights(model, mean or state[0]), log

    def _begin(self, model) -> list[list[np.ndarray]]:
        own = weights_of(model)
        return [own, [np.zeros_like(w) for w in own], [np.zeros_like(w) for w in own], [np.zeros(1)]]

    def rate_of(self, epoch: int) -> float:
        return self.rate * (1 + math.cos(math.pi * epoch / self.epochs)) / 2 if self.optimizer == "sgd" else self.rate

    def step(self, model, state: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float) -> tuple[float, float]:
        """One mini-batch: ``state`` moves; the batch's correct rows and summed loss."""
        now = with_weights(model, state[0])
        z = now.logits(x)
        losses, error = self.loss(z, y)
        self._move(state, weight_gradient(now, x, error * (w / len(y))[:, None]), rate)
        return float((z.argmax(axis=1) == y).sum()), float((losses * w).sum())

    def _move(self, state: list[list[np.ndarray]], slopes: list[np.ndarray], rate: float) -> None:
        state[3][0] += 1
        for i, slope in enumerate(slopes):
            if self.optimizer == "sgd":
                state[1][i] = self.momentum * state[1][i] + slope + self.decay * state[0][i]
                state[0][i] = state[0][i] - rate * state[1][i]
            else:
                a, b = self.beta
                state[1][i] = a * state[1][i] + (1 - a) * slope
                state[2][i] = b * state[2][i] + (1 - b) * slope**2
                t = state[3][0]
                state[0][i] = state[0][i] - rate * (state[1][i] / (1 - a**t)) / (np.sqrt(state[2][i] / (1 - b**t)) + 1e-8)

    def _epoch(self, rows: DataFrame, model, state, epoch: int):
        own, rate = self, self.rate_of(epoch)
        shapes = [[a.shape for a in part] for part in state]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = [[a.copy() for a in part] for part in state]
            correct = loss = n = 0.0

            def parts() -> Iterator[pa.RecordBatch]:
                """Mini-batches across the edges of the Arrow batches."""
                rest = None
                for b in batches:
                    rest = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
                    while rest.num_rows >= own.batch:
                        yield rest.slice(0, own.batch)
                        rest = rest.slice(own.batch)
                    rest = rest if rest.num_rows else None
                if rest is not None:
                    yield rest

            for part in parts():
                x, y, w = matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False).astype(int), part.column(2).to_numpy()
                c, s = own.step(model, mine, x, y, w, rate)
                correct, loss, n = correct + c, loss + s, n + len(y)
            if n:
                flat = np.concatenate([a.ravel() for p in mine for a in p])
                flat = np.concatenate([flat * n, [correct, loss, n]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["d", "v"])

        ordered = rows.withColumn("_u", uniform(self.seed, F.lit(epoch), F.col("id"))).sortWithinPartitions("_u", "id")
        found = ordered.select("x", "label", "w").mapInArrow(run, "d long, v double").groupBy("d").agg(F.sum("v").alias("v")).toArrow()
        if not found.num_rows:
            return state, 0.0, 0.0, 0.0
        flat = np.zeros(found.num_rows)
        flat[found.column("d").to_numpy()] = found.column("v").to_numpy()
        correct, loss, n = flat[-3:]
        flat, after, at = flat[:-3] / n, [], 0
        for part in shapes:
            after.append([])
            for shape in part:
                size = int(np.prod(shape))
                after[-1].append(flat[at : at + size].reshape(shape))
                at += size
        return after, correct / n, loss / n, n

    def _dealt(self, rows: DataFrame, steps: int, tasks: int) -> DataFrame:
        """The rows written by mini-batch, so that a step reads its own only; each in as many files as there are tasks."""
        number = F.least(F.lit(steps - 1), F.floor(uniform(self.seed, "batch", F.col("id")) * steps)).cast("int")
        folder = new_folder(rows.sparkSession, "mini-batches")
        dealt = rows.withColumn("_n", number).repartition(tasks, "_n", F.pmod(F.xxhash64("id"), F.lit(tasks)))
        dealt.sortWithinPartitions("_n").write.partitionBy("_n").parquet(folder)
        return rows.sparkSession.read.schema(dealt.schema).parquet(folder)

    def _epoch_together(self, dealt: DataFrame, model, state, epoch: int, steps: int):
        rate, loss_of, correct, loss, n = self.rate_of(epoch), self.loss, 0.0, 0.0, 0.0
        for number in sorted(range(steps), key=lambda b: uniform_number(self.seed, epoch, b)):
            now = with_weights(model, state[0])
            size = sum(a.size for a in state[0]) + 3

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(size)
                for part in batches:
                    if part.num_rows:
                        x, y, w = matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False).astype(int), part.column(2).to_numpy()
                        z = now.logits(x)
                        losses, error = loss_of(z, y)
                        slopes = weight_gradient(now, x, error * w[:, None])
                        total += np.concatenate([*[a.ravel() for a in slopes], [(z.argmax(axis=1) == y).sum(), (losses * w).sum(), len(y)]])
                if total[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])

            total = summed(dealt.where(F.col("_n") == number).select("x", "label", "w").mapInArrow(run, "at long, v double"), size)
            correct, loss, n = correct + total[-3], loss + total[-2], n + total[-1]
            if total[-1]:
                cuts = np.cumsum([a.size for a in state[0]])[:-1]
                self._move(state, [g.reshape(a.shape) for g, a in zip(np.split(total[:-3] / total[-1], cuts), state[0])], rate)
        return state, correct / max(n, 1), loss / max(n, 1), n


def train_on_subsets(trainer: Trainer, labelled: DataFrame, model, select: Callable[[object, DataFrame, int], DataFrame], share: float = 0.3, every: int = 20) -> tuple[object, list[tuple[float, float]]]:
    """Trains on a weighted subset that is chosen anew every ``every`` epochs.

    ``select(model, labelled, k)`` gives (id, weight) of the rows to go on with,
    for instance those whose gradients match the whole table's.
    """
    n, log = labelled.count(), []
    while len(log) < trainer.epochs and (not log or log[-1][0] < trainer.max_accuracy):
        chosen = stash(select(model, labelled, max(1, math.ceil(share * n))).select("id", F.col("weight").cast("double").alias("_weight")))
        part = replace(trainer, epochs=min(every, trainer.epochs - len(log)), seed=trainer.seed + len(log))
        model, more = part.train(labelled.join(chosen, "id"), model, "_weight")
        log += more
        if not more:
            break
    return model, log
