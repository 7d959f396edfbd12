"""Kernels between tables of vectors, block by block.

A row's representation is a product of two vectors, ``g`` and ``e``: the inner
product of two rows is <g, g'> * <e, e'>. Plain features have g = (1); the
gradient of a last layer is the outer product of the logit gradient and the
embedding, and is never written out. Rows are packed into blocks of at most
``BLOCK``, so a kernel between two tables is a numpy product per block pair and
what leaves a task is one row per candidate, summed over the other table's
blocks by a groupBy with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.vectors import logit_gradient

BLOCK = 1024
#: Rows of a block that travels to meet others, which it then does in pieces of ``BLOCK``: the longer, the less is sent for a pair.
TRAVELLING = 4096
#: Bytes up to which the blocks of a table are broadcast to the other's tasks.
MOST_BROADCAST = 16 << 20
REPRESENTATIONS = ("linear", "raw", "grad_bias", "grad_linear", "grad_bias_linear")


def represent(df: DataFrame, kind: str, classes: int, label: str | None = None, emb: str = "emb", state: list[str] = (), loss: Callable = logit_gradient) -> DataFrame:
    """(id, g, e, s) of rows with ``p`` (probabilities) and an embedding; gradients are of ``label``, or of the predicted class.

    ``loss(p, label, classes)`` gives a loss's gradient by the logits as a column; the cross-entropy's without it.
    """
    if kind not in REPRESENTATIONS:
        raise ValueError(f"unknown representation {kind!r}; one of {', '.join(REPRESENTATIONS)}")
    s = F.array(*[F.col(c).cast("double") for c in state]) if state else F.array().cast("array<double>")
    one = F.array(F.lit(1.0))
    if kind in ("linear", "raw"):
        return df.select("id", one.alias("g"), F.col("x" if kind == "raw" else emb).alias("e"), s.alias("s"))
    l0 = loss(F.col("p"), F.col(label or "pred"), classes)
    e = {"grad_bias": one, "grad_linear": F.col(emb), "grad_bias_linear": F.concat(F.col(emb), one)}[kind]
    return df.select("id", l0.alias("g"), e.alias("e"), s.alias("s"))


@dataclass
class Block:
    """Rows as matrices."""

    ids: np.ndarray
    g: np.ndarray
    e: np.ndarray
    s: np.ndarray

    @staticmethod
    def of(ids, g, e, s) -> Block:
        ids = np.asarray(ids)
        shaped = lambda x: np.asarray(x, float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        return Block(ids, shaped(g), shaped(e), shaped(s))

    @staticmethod
    def none() -> Block:
        return Block(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))

    def add(self, other: Block) -> Block:
        if not len(self.ids):
            return other
        return Block(*[np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values())])

    def dot(self, other: Block) -> np.ndarray:
        if not len(self.ids) or not len(other.ids):
            return np.zeros((len(self.ids), len(other.ids)))
        return (self.g @ other.g.T) * (self.e @ other.e.T)

    def norms2(self) -> np.ndarray:
        return (self.g**2).sum(axis=1) * (self.e**2).sum(axis=1)

    def distance2(self, other: Block) -> np.ndarray:
        return np.maximum(self.norms2()[:, None] + other.norms2()[None, :] - 2 * self.dot(other), 0)

    def similarity(self, other: Block, metric: str) -> np.ndarray:
        """In [0, 1]: half of one plus the cosine, or one over one plus the distance."""
        if metric == "cosine":
            norms = np.sqrt(self.norms2()[:, None] * other.norms2()[None, :])
            return (np.divide(self.dot(other), norms, out=np.zeros(norms.shape), where=norms > 0) + 1) / 2
        if metric == "euclidean":
            return 1 / (1 + np.sqrt(self.distance2(other)))
        raise ValueError(f"unknown metric {metric!r}; cosine or euclidean")

    def self_similarity(self, metric: str) -> np.ndarray:
        return np.where(self.norms2() > 0, 1.0, 0.5) if metric == "cosine" else np.ones(len(self.ids))


SCHEMA = "ids array<bigint>, g array<double>, e array<double>, s array<double>"
#: Rows whose products with a piece of a block are in memory at once: half a megabyte in single precision, which stays in a core's cache.
TILE = 128


def tiles(a: Block, b: Block, metric: str, rough: bool = False) -> Iterator[tuple[slice, np.ndarray]]:
    """Similarities of a's rows to b's (``metric`` as in similarity(), or squared distances for "squared"), a few rows of ``a`` at a time.

    Lengths are divided out before the product and all else is done in place,
    so nothing of the size of a times b is ever written. The array may be
    changed, and is overwritten by the next.

    ``rough`` similarities are in single precision, moved by the most that its
    rounding can do, so none is less than the exact one (and no distance more).
    """
    if metric not in ("cosine", "euclidean", "squared"):
        raise ValueError(f"unknown metric {metric!r}; cosine or euclidean")
    if not len(a.ids) or not len(b.ids):
        if len(a.ids):
            yield slice(0, len(a.ids)), np.zeros((len(a.ids), 0))
        return
    scaled = []
    for own, by in ((a, -2.0), (b, 1.0)):
        if metric == "cosine":
            norms = np.sqrt(2 * own.norms2())
            by = np.divide(1.0, norms, out=np.zeros(len(norms)), where=norms > 0)[:, None]
            scaled.append((own.g * by * np.sqrt((own.e**2).sum(axis=1))[:, None], _unit(own.e)))
        else:
            scaled.append((own.g * by, own.e))
    (left, x), (right, y) = scaled
    plain = left.shape[1] == 1
    if plain:
        x, y = x * left, y * right
    kind = np.float32 if rough else np.float64
    slack = (left.shape[1] + x.shape[1] + 16) * 2.0**-24 if rough else 0.0
    left, right, x, y = (np.ascontiguousarray(v, kind) for v in (left, right.T, x, y.T))
    own, theirs = (((1 - slack) * v.norms2()).astype(kind) for v in (a, b))
    space, other = np.empty((2, min(TILE, len(a.ids)), len(b.ids)), kind)
    for i in range(0, len(a.ids), TILE):
        at = slice(i, min(i + TILE, len(a.ids)))
        s = np.matmul(x[at], y, out=space[: at.stop - i])
        if not plain:
            s *= np.matmul(left[at], right, out=other[: at.stop - i])
        if metric == "cosine":
            s += kind(0.5 + slack)
        else:
            s += own[at, None]
            s += theirs
            np.maximum(s, 0, out=s)
            if metric == "euclidean":
                np.sqrt(s, out=s)
                s += 1
                np.divide(1 + kind(slack), s, out=s)
        yield at, s


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x**2).sum(axis=1))[:, None]
    return np.divide(x, norms, out=np.zeros(x.shape), where=norms > 0)


def reduced(a: Block, b: Block, metric: str, by: Callable[[np.ndarray], np.ndarray], rough: bool = False) -> np.ndarray:
    """A number per row of ``a`` from its tile of similarities, which ``by`` may change; of rough ones, at least the sum that ``by`` takes exactly."""
    out = np.zeros(len(a.ids))
    for at, s in tiles(a, b, metric, rough):
        out[at] = by(s)
    return out + 4e-6 * np.abs(out) + 4e-7 * len(b.ids) if rough else out


def direction_sum(blocks: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows the blocks hold, and the sum of their vectors at length one (those of length zero give nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k in range(batch.num_rows):
                b = unpacked(batch, k)
                own = _directed(b.g, b).T @ b.e
                n, total = n + len(b.ids), own if total is None else total + own
        if total is not None:
            values = np.r_[float(n), float(len(total)), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "v"])

    rows = blocks.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"), F.max("v").alias("m")).toArrow().sort_by("at")
    values, most = rows.column("v").to_numpy(), rows.column("m").to_numpy()
    return int(values[0]), values[2:].reshape(int(most[1]), -1)


def towards(a: Block, total: np.ndarray) -> np.ndarray:
    """The inner product of each row at length one with ``total``; equal rows give equal numbers."""
    return np.einsum("ic,cd,id->i", _directed(a.g, a), total, a.e)


def _directed(g: np.ndarray, rows: Block) -> np.ndarray:
    norms = np.sqrt(rows.norms2())[:, None]
    return np.divide(g, norms, out=np.zeros(g.shape), where=norms > 0)


def to_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows (id, g, e, s) packed where they are, without a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_arrays(_packed(batch.slice(k, size)), ["ids", "g", "e", "s"])

    return rows.select("id", "g", "e", "s").mapInArrow(pack, SCHEMA)


def _packed(part: pa.RecordBatch) -> list[pa.Array]:
    """Rows (id, g, e, s) as one list each."""
    columns = [part.column(0), *[part.column(j).flatten() for j in (1, 2, 3)]]
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]


def to_ranked_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, g, e, s, v) packed by falling v, the smaller id first: (no, bound, ids, g, e, s).

    ``no`` rises with the order and ``bound`` is the block's largest v. Rows are
    dealt by range, so no task orders all.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                yield pa.RecordBatch.from_arrays([pa.array([no]), part.column(4).slice(0, 1), *_packed(part)], ["no", "bound", "ids", "g", "e", "s"])
                no += 1

    order = [F.col("v").desc(), F.col("id").asc()]
    ordered = rows.select("id", "g", "e", "s", "v").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(pack, f"no long, bound double, {SCHEMA}")


def to_part_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows (part, id, g, e, s) packed where they are, each block of one part: (part, ids, g, e, s)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_numpy()
            order = np.argsort(parts, kind="stable")
            batch, parts = batch.take(pa.array(order)), parts[order]
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for i, j in zip(edges, edges[1:]):
                for k in range(i, j, size):
                    part = batch.slice(k, min(size, j - k))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), *_packed(part.select(["id", "g", "e", "s"]))], ["part", "ids", "g", "e", "s"])

    return rows.select(F.col("part").cast("int").alias("part"), "id", "g", "e", "s").mapInArrow(pack, f"part int, {SCHEMA}")


def over_parts(blocks: DataFrame, compute: Callable[[int, Block, Block], np.ndarray], salts: int = 32) -> DataFrame:
    """(part, id, v): for each row the sum over its own part's blocks of ``compute(part, candidates, ground)``.

    The part's blocks are broadcast up to ``MOST_BROADCAST`` bytes by their
    count; beyond it each goes to every salt, and a part's candidates are dealt
    over salts, so a large part goes to many tasks.
    """
    ground = blocks.toDF("part2", "ids2", "g2", "e2", "s2")
    same = F.col("part") == F.col("part2")
    if _volume(blocks) <= MOST_BROADCAST:
        pairs = blocks.join(F.broadcast(ground), same)
    else:
        dealt = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
        copies = ground.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = dealt.join(copies, same & (F.col("salt") == F.col("salt2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, a, b = batch.column(0)[k].as_py(), unpacked(batch, k, 1), unpacked(batch, k, 6)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a.ids), part, np.int32)), pa.array(a.ids), pa.array(np.asarray(compute(part, a, b), float))], ["part", "id", "v"])

    columns = ["part", "ids", "g", "e", "s", "part2", "ids2", "g2", "e2", "s2"]
    return pairs.select(*columns).mapInArrow(run, "part int, id long, v double").groupBy("part", "id").agg(F.sum("v").alias("v"))


def gathered_blocks(blocks: DataFrame, numbers: list[int]) -> dict[int, Block]:
    """A few ranked blocks by their number, on the driver."""
    table = blocks.where(F.col("no").isin(numbers)).drop("bound").toArrow()
    out = {}
    for batch in table.to_batches():
        out |= {batch.column(0)[k].as_py(): unpacked(batch, k, 1) for k in range(batch.num_rows)}
    return out


def over_ground(ground: DataFrame, candidates: Block, compute: Callable[[Block, Block], np.ndarray]) -> np.ndarray:
    """For each of a few candidates the sum over all ground blocks of what ``compute`` gives: each task adds up its own."""
    if not len(candidates.ids):
        return np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(candidates.ids))
        for batch in batches:
            for k in range(batch.num_rows):
                for b in pieces(unpacked(batch, k)):
                    total += compute(candidates, b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    return summed(ground.mapInArrow(run, "at long, v double"), len(candidates.ids))


def block_bounds(numbered: DataFrame, ground: DataFrame, compute: Callable[[Block, Block], np.ndarray], own: bool = False) -> DataFrame:
    """(no, v): for each block of (no, ids, g, e, s) the most that a row of it has, summed over all ground blocks (and with its first state if ``own``).

    The blocks are dealt anew, as those asked for may lie together; a list of
    sums per block and task is all that goes on.
    """
    spread = numbered.select("no", "ids", "g", "e", "s").repartition(2 * numbered.sparkSession.sparkContext.defaultParallelism, "no")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                j, rows = i, 0
                while j < batch.num_rows and (j == i or rows + len(batch.column(1)[j]) <= TRAVELLING):
                    rows += len(batch.column(1)[j])
                    j += 1
                part, i = batch.slice(i, j - i), j
                sizes = pa.array([len(x) for x in part.column(1)], pa.int64())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (part.column(0), sizes, *[part.column(x).flatten() for x in range(1, 5)])]
                yield pa.RecordBatch.from_arrays(lists, ["nos", "sizes", "ids", "g", "e", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (nos, sizes, _), values in met(batches, 2, lambda a: a, compute, 2):
            parts = np.split(sum(values), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(nos), pa.array([x.tolist() for x in parts], pa.list_(pa.float64()))], ["no", "sums"])

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                total = sum(x.values.to_numpy(zero_copy_only=False) for x in batch.column(1)[k].values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([np.where(np.isnan(total), np.inf, total).max()])], ["no", "v"])

    packed = spread.mapInArrow(pack, f"nos array<long>, sizes array<long>, {SCHEMA}")
    parts = _pairs(packed, ground).mapInArrow(run, "no long, sums array<double>")
    if own:
        parts = parts.unionByName(numbered.select("no", F.col("s").alias("sums")))
    return parts.groupBy("no").agg(F.collect_list("sums").alias("sums")).mapInArrow(largest, "no long, v double")


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sums of (at, v) as one vector of ``size`` numbers."""
    table = parts.groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[table.column("at").to_numpy()] = table.column("v").to_numpy()
    return out


def nearest_rows(blocks: DataFrame, m: int, metric: str) -> DataFrame:
    """(id, near): each row's ``m`` most similar rows, itself among them, as an array of (j, s), the most similar and smaller id first.

    Block meets block once; a task holds m entries per row of one block, only
    entries that reach the least of them are sorted in, and what the tasks
    found of a row is merged. Nothing of the n x n kernel beyond
    n x m entries leaves a task.
    """
    pairs = _pairs(blocks, blocks)

    def better(a: Block, b: Block, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, similarity, id) of the entries that reach each row's least."""
        found = []
        for at, s in tiles(a, b, metric):
            floor = least[at]
            if m < len(b.ids) and np.isneginf(floor).any():
                floor = np.fmax(floor, -np.partition(-s, m - 1, axis=1)[:, m - 1])
            row, column = np.nonzero(s >= floor[:, None])
            found.append((row + at.start, s[row, column], b.ids[column]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]

        def compute(a: Block, b: Block) -> np.ndarray:
            n = len(a.ids)
            counts = np.bincount(held[0], minlength=n)
            least = np.full(n, -np.inf)
            full = counts == m
            least[full] = held[1][np.cumsum(counts)[full] - 1]
            row, s, j = (np.concatenate([x, y]) for x, y in zip(held, better(a, b, least)))
            order = np.lexsort((j, -s, row))
            row, s, j = row[order], s[order], j[order]
            counts = np.bincount(row, minlength=n)
            first = (np.arange(len(row)) - (np.cumsum(counts) - counts)[row]) < m
            held[:] = row[first], s[first], j[first]
            return np.zeros(0)

        for a, each in met(batches, 0, lambda a: a, compute):
            held[:] = [x[:0] for x in held]
            for _ in each:
                pass
            flat = pa.StructArray.from_arrays([pa.array(-held[1]), pa.array(held[2])], ["far", "j"])
            ends = np.r_[0, np.cumsum(np.bincount(held[0], minlength=len(a.ids)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a.ids), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "near"])

    found = pairs.mapInArrow(run, "id long, near array<struct<far:double,j:bigint>>")
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, m)  # m entries per task that met the row
    return found.groupBy("id").agg(merged.alias("near")).select("id", F.transform("near", lambda x: F.struct(x["j"].alias("j"), (-x["far"]).alias("s"))).alias("near"))


def unpacked(batch: pa.RecordBatch, k: int, at: int = 0) -> Block:
    return Block.of(*[batch.column(at + j)[k].values.to_numpy(zero_copy_only=False) for j in range(4)])


def gathered(rows: DataFrame, most: int = 5000) -> Block:
    """A small table as one block on the driver; ValueError beyond ``most`` rows."""
    table = rows.select("id", "g", "e", "s").limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"more than {most} rows where a small set is needed")
    if not table.num_rows:
        return Block.none()
    batch = table.combine_chunks().to_batches()[0]
    order = np.argsort(batch.column(0).to_numpy())
    block = Block.of(batch.column(0).to_numpy(), *[batch.column(j).flatten().to_numpy(zero_copy_only=False) for j in (1, 2, 3)])
    return Block(*[x[order] for x in vars(block).values()])


def cosine_features(block: Block) -> np.ndarray:
    """Vectors whose inner products are the cosine similarities of the rows: one, and the row at length one, over the root of two."""
    x = (block.g[:, :, None] * block.e[:, None, :]).reshape(len(block.ids), -1)
    norms = np.sqrt(block.norms2())[:, None]
    unit = np.divide(x, norms, out=np.zeros(x.shape), where=norms > 0)
    return np.c_[np.ones(len(x)), unit] / np.sqrt(2)


def cosine_gram(blocks: DataFrame) -> np.ndarray:
    """Sum over all rows of the outer product of their cosine features: each task sums its own, features squared numbers go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                f = cosine_features(unpacked(batch, k))
                total = f.T @ f if total is None else total + f.T @ f
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    found = blocks.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(round(len(out) ** 0.5), -1)


def kept_rows(block: Block, keep: Callable[[np.ndarray], np.ndarray] | None) -> Block:
    if keep is None:
        return block
    own = keep(block.ids)
    return Block(*[x[own] if len(x) else x for x in vars(block).values()])


def per_candidate(blocks: DataFrame, compute: Callable[[Block], np.ndarray], keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, v) with a value for each row of the blocks, or for those whose ids ``keep`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = kept_rows(unpacked(batch, k), keep)
                if len(b.ids):
                    yield pa.RecordBatch.from_arrays([pa.array(b.ids), pa.array(np.asarray(compute(b), float))], ["id", "v"])

    return blocks.mapInArrow(run, "id long, v double")


_VOLUMES: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def _pairs(candidates: DataFrame, ground: DataFrame) -> DataFrame:
    """Every block of the one table beside every block of the other, which is broadcast up to ``MOST_BROADCAST`` bytes by its count."""
    other = ground.select("ids", "g", "e", "s").toDF("ids2", "g2", "e2", "s2")
    return candidates.crossJoin(F.broadcast(other) if _volume(ground) <= MOST_BROADCAST else other)


def _volume(blocks: DataFrame) -> int:
    """Bytes of a table of blocks, counted once, whatever the number of steps."""
    if blocks not in _VOLUMES:
        _VOLUMES[blocks] = blocks.agg(F.sum(8 * (F.size("ids") + F.size("g") + F.size("e") + F.size("s")))).first()[0] or 0
    return _VOLUMES[blocks]


def over_pairs(candidates: DataFrame, ground: DataFrame, compute: Callable[[Block, Block], np.ndarray], how: str = "sum", keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, v): for each candidate (that ``keep`` takes) the sum, min or max over ground blocks of what ``compute`` gives.

    Every pair of blocks meets once.
    """
    pairs = _pairs(candidates, ground)
    join = {"sum": np.add, "min": np.minimum, "max": np.maximum}[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, values in met(batches, 0, lambda a: kept_rows(a, keep), compute):
            total = None
            for v in values:
                total = v if total is None else join(total, v)
            yield pa.RecordBatch.from_arrays([pa.array(a.ids), pa.array(total)], ["id", "v"])

    reduce = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    return pairs.mapInArrow(run, "id long, v double").groupBy("id").agg(reduce("v").alias("v"))


def pieces(block: Block) -> Iterator[Block]:
    """The block in views of at most ``BLOCK`` rows."""
    for i in range(0, max(len(block.ids), 1), BLOCK):
        yield Block(*[x[i : i + BLOCK] for x in vars(block).values()])


def met(batches: Iterator[pa.RecordBatch], at: int, keep: Callable[[Block], Block], compute: Callable[[Block, Block], np.ndarray], named: int = 0) -> Iterator[tuple]:
    """Each run of pairs with one block of candidates: what ``keep`` leaves of it, and ``compute`` of each block that it meets.

    The first ``named`` columns are lists that tell blocks apart, and come along.
    """
    pairs = ((batch, k) for batch in batches for k in range(batch.num_rows))

    def same(pair: tuple[pa.RecordBatch, int]) -> tuple:
        batch, k = pair
        if named:
            return tuple(tuple(batch.column(j)[k].as_py()) for j in range(named))
        return tuple(batch.column(at + j)[k].values.to_numpy(zero_copy_only=False).tobytes() for j in range(3))

    for key, run in groupby(pairs, same):
        batch, k = first = next(run)
        a = keep(unpacked(batch, k, at))
        if len(a.ids):
            found = (np.asarray(compute(a, b), float) for other, j in chain([first], run) for b in pieces(unpacked(other, j, at + 4)))
            yield ((*key, a) if named else a), found
