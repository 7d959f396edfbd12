"""What given rows of any number explain of a table's rows: panels of their inverse Cholesky factor, and Cholesky rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.plans.blocks import MOST_BROADCAST, TILE, Block, over_pairs, pieces, reduced, tiles, to_blocks
from tamis.plans.linear import inverse_factor
from tamis.shared import new_folder, ordinals, stash
from tamis.sources.files import remove_folder

#: Numbers of one panel of given rows, which the driver factors and the tasks get: 64 MB.
MOST_NUMBERS = 8 << 20
SCHEMA = "at long, weight double, id bigint, g array<double>, e array<double>, s array<double>"


def cholesky_rows(rows: DataFrame, given: DataFrame, metric: str, ridge: float, most_numbers: int = MOST_NUMBERS) -> DataFrame:
    """``rows`` (id, g, e) with ``s``: each row's Cholesky row over ``given`` (place, weight, id, g, e), in the order of place and id.

    With K the kernel of the given rows plus ``ridge`` on its diagonal, LL' = K
    and k the row's similarities to them times their weights, s is L^-1 k: its
    square is what the given rows explain of the row, and the product of two
    such rows what they explain of their similarity. Its first n numbers are
    the row over the first n given rows alone.

    Rows that come later, given or not, are extended together by the columns of
    one panel in one job, from a table in the shared folder to the next. The
    driver and each task hold one panel, at most ``most_numbers`` numbers (or
    one row) however many rows are given, so panels get narrower as rows get
    longer; no kernel is ever whole in one place. Work is rows times the square
    of the given, as the exact result demands.
    """
    spark = rows.sparkSession
    ranked = stash(ordinals(given.select("place", F.col("weight").cast("double").alias("weight"), "id", "g", "e"), F.col("place").asc(), F.col("id").asc()))
    n = ranked.count()
    width = max(1, min(n, most_numbers // max(n, 1)))
    nothing = F.array().cast("array<double>").alias("s")
    first = ranked.select(F.col("_ordinal").cast("long").alias("at"), "weight", "id", "g", "e", nothing)
    table = first.unionByName(rows.select(F.lit(-1).cast("long").alias("at"), F.lit(1.0).alias("weight"), "id", "g", "e", nothing))
    folder, before = new_folder(spark, "factor"), None
    for no in range(-(-n // width)):
        end = (no + 1) * width
        weights, panel = _panel(table.where(F.col("at").between(no * width, end - 1)))
        own = panel.similarity(panel, metric) + ridge * np.eye(len(panel.ids)) - panel.s @ panel.s.T
        path = f"{folder}/{no}"
        _extended(table.where((F.col("at") >= end) | (F.col("at") < 0)), panel, weights, inverse_factor(own), metric).write.parquet(path)
        table = spark.read.schema(SCHEMA).parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return table.select("id", "g", "e", "s")


def _unpacked(batch: pa.RecordBatch) -> Block:
    return Block.of(batch.column(2).to_numpy(), *[batch.column(j).flatten().to_numpy(zero_copy_only=False) for j in (3, 4, 5)])


def _panel(rows: DataFrame) -> tuple[np.ndarray, Block]:
    """A panel's weights and rows in their order, on the driver."""
    table = rows.toArrow().sort_by("at")
    batch = table.combine_chunks().to_batches()[0]
    return batch.column(1).to_numpy(), _unpacked(batch)


def _extended(rows: DataFrame, panel: Block, weights: np.ndarray, factor: np.ndarray, metric: str) -> DataFrame:
    """The rows with the panel's columns added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _unpacked(batch)
            cross = own.similarity(panel, metric)
            cross = np.where((batch.column(0).to_numpy() < 0)[:, None], cross * weights, cross)
            s = np.c_[own.s, (cross - own.s @ panel.s.T) @ factor.T]
            ends = np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)
            longer = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], longer], ["at", "weight", "id", "g", "e", "s"])

    return rows.select("at", "weight", "id", "g", "e", "s").mapInArrow(run, SCHEMA)


# --- panels of the inverse factor ---------------------------------------------------------------------

#: Numbers are stored as bytes: Spark hands them on as they are, where it would take an array's apart and put them together again.
_ROWS = "weights binary, g binary, e binary"
STORED = f"first long, {_ROWS}, t binary"
SOLVED = f"first long, {_ROWS}, v binary, s binary"
#: Given rows that bounds() looks at first.
LEADING = 1024


@dataclass
class InverseFactor:
    """Given rows in order (at, weight, id, g, e), and the rows of L^-1 (LL' = their kernel plus the ridge) in panels.

    A panel (first, weights, g, e, t) has the entries ``t`` of a run of rows
    from ``first`` on, up to the diagonal, and the given rows that they are for;
    ``stored`` has them as bytes.
    ``ends`` cuts the given rows into parts: each explains what the parts
    before it do not. ``weight`` is that of all given rows, None if they differ.
    The first ``leading`` rows, or all, are one panel.
    """

    stored: DataFrame
    given: DataFrame
    ends: list[int]
    metric: str
    ridge: float
    weight: float | None
    leading: int
    numbers: int
    folder: str

    @property
    def panels(self) -> DataFrame:
        """The panels with their numbers as arrays."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *[_lists(_numbers(batch, j, k)[None]) for j in range(1, 5)]], names)

        names = ["first", "weights", "g", "e", "t"]
        return self.stored.mapInArrow(run, "first long, " + ", ".join(f"{x} array<double>" for x in names[1:]))

    def explained(self, blocks: DataFrame, first: int | None = None) -> DataFrame:
        """(id, s): how much of each row's variance the parts of the given rows explain, or the ``first`` so many rows (of the first panel) alone.

        Every block meets every panel once, and a number per row and panel
        leaves the task.
        """
        metric, cuts = self.metric, [0, *self.ends]
        panels, numbers = (self.stored, self.numbers) if first is None else (self._cut(first), first**2)
        panels = F.broadcast(panels) if 8 * numbers <= MOST_BROADCAST else panels
        rows = blocks.select("ids", F.col("g").alias("g1"), F.col("e").alias("e1"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, g, e = (_values(batch, j, k) for j in range(3))
                    a = Block.of(ids, g, e, np.zeros((len(ids), 0)))
                    first, weights, given, t = _stored(batch, k, 3)
                    inside = [(part, max(lo - first, 0), min(hi - first, len(t))) for part, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
                    inside = [(part, lo, hi) for part, lo, hi in inside if lo < hi]
                    sums = np.zeros((len(inside), len(ids)))
                    t = t * weights
                    for at, s in _similarities(a, given, metric):
                        own = (s @ t.T) ** 2
                        for i, (_, lo, hi) in enumerate(inside):
                            sums[i, at] = own[:, lo:hi].sum(axis=1)
                    parts = [part for part, _, _ in inside]
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])] * len(parts)), pa.array(parts, pa.int32()), _lists(sums)], ["block", "part", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, found = _values(batch, 0, k), np.zeros((len(cuts) - 1, len(batch.column(0)[k])))
                    for x in batch.column(1)[k].values:
                        found[x["part"].as_py()] += x["sums"].values.to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(found.T)], ["id", "s"])

        parts = rows.crossJoin(panels).mapInArrow(run, "block long, part int, sums array<double>")
        sums = parts.groupBy("block").agg(F.collect_list(F.struct("part", "sums")).alias("found"))
        return blocks.select("ids", F.col("ids")[0].alias("block")).join(sums, "block").select("ids", "found").mapInArrow(added, "id long, s array<double>")

    def _cut(self, n: int) -> DataFrame:
        """The first panel's first ``n`` rows as a panel."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    _, weights, given, t = _stored(batch, k, 0)
                    yield _row([0, weights[:n], given.g[:n], given.e[:n], t[:n, :n]], STORED)

        return self.stored.where("first = 0").mapInArrow(run, STORED)

    def bounds(self, blocks: DataFrame, size: int) -> DataFrame | None:
        """(id, s, most): what some given rows explain by parts, the least that the parts explain, and the most that all given rows can; None where there are no such bounds or they would save little.

        The least comes from the first rows. The most follows from the nearest
        given row (see unexplained()), so it takes similarities only, and its
        work grows with candidates times given rows.
        """
        if self.metric != "euclidean" or self.weight is None or self.ends[-1] <= 2 * self.leading:
            return None
        n, ridge, weight = self.ends[-1], self.ridge, self.weight
        ground = stash(to_blocks(self.given.select("id", "g", "e", F.array().cast("array<double>").alias("s")), size))
        near = over_pairs(blocks, ground, lambda a, b: reduced(a, b, "euclidean", lambda s: s.max(axis=1), rough=True), "max")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                most = weight**2 * (1 - unexplained(batch.column(1).to_numpy(), n, ridge))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most)], ["id", "most"])

        most = near.mapInArrow(run, "id long, most double")
        return self.explained(blocks, first=min(self.leading, LEADING)).join(most, "id").select("id", "s", "most")

    def coefficients(self, row: Block) -> DataFrame:
        """(at, z): for each part of the given rows, the weight of each of them in what that part explains of similarities to ``row``."""
        metric, cuts = self.metric, [0, *self.ends]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((0, len(cuts) - 1))
            for batch in batches:
                for k in range(batch.num_rows):
                    first, weights, given, t = _stored(batch, k, 0)
                    if len(weights) > len(total):
                        total = np.concatenate([total, np.zeros((len(weights) - len(total), len(cuts) - 1))])
                    y = t @ (given.similarity(row, metric)[:, 0] * weights)
                    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                        own = slice(max(lo - first, 0), max(hi - first, 0))
                        total[: len(weights), part] += (y[own] @ t[own]) * weights
            if len(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(x) for x in total.T]], ["at", *names])

        names = [f"z{i}" for i in range(len(self.ends))]
        sums = self.stored.mapInArrow(run, "at long, " + ", ".join(f"{x} double" for x in names)).groupBy("at").agg(*[F.sum(x).alias(x) for x in names])
        return sums.select("at", F.array(*names).alias("z"))

    def left(self, blocks: DataFrame, row: Block, parts: list[int], size: int) -> list[DataFrame]:
        """For each count of ``parts``: (id, v) with what the first so many parts leave of each row's similarity to ``row``."""
        spark, metric = blocks.sparkSession, self.metric
        itself = spark.createDataFrame([(int(row.ids[0]), row.g[0].tolist(), row.e[0].tolist(), [1.0])], "id long, g array<double>, e array<double>, s array<double>")
        found = stash(self.given.join(self.coefficients(row), "at")) if any(parts) else None
        out = []
        for n in parts:
            ground = itself
            if n:
                taken = sum((F.col("z")[i] for i in range(1, n)), F.col("z")[0])
                ground = found.where(F.col("at") < self.ends[n - 1]).select("id", "g", "e", F.array(-taken).alias("s")).unionByName(itself)
            out.append(over_pairs(blocks, stash(to_blocks(ground, size)), lambda a, b: _weighted(a, b, metric)))
        return out


def inverse_factor_of(given: DataFrame, ends: list[int], metric: str, ridge: float, most_numbers: int = MOST_NUMBERS) -> InverseFactor:
    """The inverse factor of ``given`` (place, weight, id, g, e) in the order of place and id, a batch of rows at a time.

    A batch is as many rows as have ``most_numbers`` similarities with one
    another. Tasks take some of its rows each, read the panels so far, one at a
    time, and leave what the rows before explain: V = K A^-1, with A their
    kernel. The driver factors what is left of the batch's own kernel, and the
    panels of the batch follow from V and that factor. So each panel is written
    once, as is each V, and nothing larger than ``most_numbers`` numbers (or one
    row; twice as many for V) is held in one place, however many rows are given. The panels are in
    ``folder``, for the caller to remove.
    """
    spark = given.sparkSession
    ranked = ordinals(given.select("place", F.col("weight").cast("double").alias("weight"), "id", "g", "e"), F.col("place").asc(), F.col("id").asc())
    ranked = stash(ranked.select(F.col("_ordinal").cast("long").alias("at"), "weight", "id", "g", "e"))
    n, low, high = ranked.agg(F.count("*"), F.min("weight"), F.max("weight")).first()
    batch, cores = max(1, math.isqrt(most_numbers)), spark.sparkContext.defaultParallelism
    folder, paths, numbers, table = new_folder(spark, "factor"), [], 0, None
    for start in range(0, n, batch):
        weights, own = _batch(ranked.where(F.col("at").between(start, start + batch - 1)))
        here, solved, before = len(own.ids), None, f"{folder}/solved-{start}"
        left = own.similarity(own, metric)
        np.fill_diagonal(left, own.self_similarity(metric) + ridge)  # not the rounded distance of a row to itself
        if start:
            width = max(1, min(-(-here // cores), 2 * most_numbers // start))  # each task reads all panels, so rather few tasks
            _streams(table, -(-here // width)).mapInArrow(_solving(own, width, start, metric), SOLVED).write.parquet(before, compression="none")
            solved = spark.read.schema(SOLVED).parquet(before)
            for part in solved.select("first", "s").toArrow().to_batches():
                for k in range(part.num_rows):
                    first, rows = part.column(0)[k].as_py(), _numbers(part, 1, k).reshape(-1, here)
                    left[first : first + len(rows)] -= rows
        width = max(1, min(here, most_numbers // (start + here)))
        factor = inverse_factor((left + left.T) / 2)
        paths.append(f"{folder}/panels-{start}")
        _streams(spark.range(1) if solved is None else solved, -(-here // width)).mapInArrow(_panelling(own, weights, factor, width, start), STORED).write.parquet(paths[-1], compression="none")
        if solved is not None:
            remove_folder(spark, before)
        table, numbers = spark.read.schema(STORED).parquet(*paths), numbers + here * (start + here)
    return InverseFactor(table, ranked, ends, metric, ridge, low if low == high else None, min(batch, n), numbers, folder)


#: Where the Gaussians are cut of which unexplained() takes the narrower ones, and their share of the similarity's height: exp(c) erfc(sqrt(c)).
_CUTS = np.geomspace(0.25, 500, 60)
_SHARES = np.array([math.exp(c) * math.erfc(math.sqrt(c)) for c in _CUTS])


def unexplained(nearest: np.ndarray, n: int, ridge: float) -> np.ndarray:
    """The least of a row's variance that ``n`` given rows leave by euclidean similarities, for the largest of its similarities to them.

    1 / (1 + r) is a mixture of Gaussians exp(-c r^2) over all c > 0. Those of c
    beyond a cut are a positive definite kernel, as are the others, and what is
    left under a sum of kernels is at least the sum of what is left under each
    (Schur complements are superadditive). With h the narrow ones' value at
    r = 0, none of a row's n values exceeds h exp(-cut r^2) at the least r, and
    the given rows' own matrix has no eigenvalue below the ridge, copies or not:
    h - n (h exp(-cut r^2))^2 / ridge is left at least. The best cut counts.
    """
    r = 1 / np.minimum(nearest, 1.0) - 1
    left = _SHARES - n / ridge * (_SHARES * np.exp(-_CUTS * (r**2)[:, None])) ** 2
    return np.maximum(left.max(axis=1, initial=0), 0)


def _streams(table: DataFrame, n: int) -> DataFrame:
    """The whole table once for each of ``n`` tasks, with the task's number first; each reads it row by row.

    Spark puts tables of one partition each into a single one together, unless
    another (here without rows) is laid out differently.
    """
    numbered = lambda i: table.select(F.lit(i).cast("long").alias("task"), "*")
    nothing = numbered(-1).where(F.col(table.columns[0]) < 0)
    return reduce(DataFrame.unionByName, [numbered(i).coalesce(1) for i in range(n)], nothing)


def _solving(own: Block, width: int, start: int, metric: str) -> Callable:
    """For _streams of panels: V of the task's ``width`` rows of ``own``, and what the rows before explain of their similarities to all of ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = before = None
        for batch in batches:
            for k in range(batch.num_rows):
                task = batch.column(0)[k].as_py()
                _, weights, given, t = _stored(batch, k, 1)
                mine = Block(*[x[task * width : (task + 1) * width] for x in vars(own).values()])
                v = np.zeros((len(mine.ids), start)) if v is None else v
                for at, s in _similarities(mine, given, metric):
                    v[at, : t.shape[1]] += (s @ t.T) @ t
                if len(weights) == start:
                    before = weights, given
        if v is None:
            return
        weights, given = before
        s, i = np.zeros((len(v), len(own.ids))), 0
        for piece in pieces(given):
            s += v[:, i : i + len(piece.ids)] @ piece.similarity(own, metric)
            i += len(piece.ids)
        yield _row([task * width, weights, given.g, given.e, v, s], SOLVED)

    return run


def _panelling(own: Block, weights: np.ndarray, factor: np.ndarray, width: int, start: int) -> Callable:
    """For _streams of solved rows: the task's panel of ``width`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = before = None
        for batch in batches:
            for k in range(batch.num_rows):
                task = batch.column(0)[k].as_py()
                lo, hi = task * width, min((task + 1) * width, len(factor))
                if start:
                    first, w, given, v = _stored(batch, k, 1)
                    before = (w, given, np.zeros((hi - lo, start))) if before is None else before
                    if first < hi:
                        before[2][:] -= factor[lo:hi, first : first + len(v)] @ v
        if task is None:
            return
        t, rows, w = factor[lo:hi, :hi], Block(*[x[:hi] for x in vars(own).values()]), weights[:hi]
        if before is not None:
            t, rows, w = np.c_[before[2], t], before[1].add(rows), np.r_[before[0], w]
        yield _row([start + lo, w, rows.g, rows.e, t], STORED)

    return run


def _similarities(a: Block, given: Block, metric: str) -> Iterator[tuple[slice, np.ndarray]]:
    """As tiles() for any number of given rows, a piece of them at a time, so what is changed in place stays in a core's cache."""
    space = np.empty((min(TILE, len(a.ids)), len(given.ids)))
    for i in range(0, len(a.ids), TILE):
        rows = Block(*[x[i : i + TILE] for x in vars(a).values()])
        j = 0
        for piece in pieces(given):
            for at, s in tiles(rows, piece, metric):
                space[at, j : j + len(piece.ids)] = s
            j += len(piece.ids)
        yield slice(i, i + len(rows.ids)), space[: len(rows.ids)]


def _weighted(a: Block, b: Block, metric: str) -> np.ndarray:
    out = np.zeros(len(a.ids))
    for at, s in tiles(a, b, metric):
        out[at] = s @ b.s[:, 0]
    return out


def _batch(rows: DataFrame) -> tuple[np.ndarray, Block]:
    """A batch's weights and rows in their order, on the driver."""
    table = rows.toArrow().sort_by("at")
    n, columns = table.num_rows, [table.column(j).combine_chunks() for j in range(5)]
    g, e = (x.flatten().to_numpy(zero_copy_only=False) for x in columns[3:])
    return columns[1].to_numpy(), Block.of(columns[2].to_numpy(), g, e, np.zeros((n, 0)))


def _values(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    return batch.column(column)[k].values.to_numpy(zero_copy_only=False)


def _numbers(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    """Numbers stored as bytes."""
    return np.frombuffer(batch.column(column)[k].as_buffer())


def _stored(batch: pa.RecordBatch, k: int, at: int) -> tuple[int, np.ndarray, Block, np.ndarray]:
    """A stored row from column ``at`` on: its first row's place, the given rows' weights and vectors, and its matrix, a column for each of them."""
    weights, g, e, t = (_numbers(batch, at + j, k) for j in range(1, 5))
    n = len(weights)
    return batch.column(at)[k].as_py(), weights, Block.of(np.arange(n), g, e, np.zeros((n, 0))), t.reshape(-1, n)


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))


def _row(values: list, schema: str) -> pa.RecordBatch:
    """A number and arrays, as bytes, as one row."""
    stored = [pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(x)]) for x in (np.ascontiguousarray(x, float) for x in values[1:])]
    return pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int64()), *stored], [x.split()[0] for x in schema.split(", ")])
