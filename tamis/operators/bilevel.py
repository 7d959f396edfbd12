"""Selections that match or follow gradients of a validation loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators.greedy import greedy
from tamis.operators.uncertainty import random_rows
from tamis.plans.blocks import BLOCK, TRAVELLING, Block, gathered, over_pairs, per_candidate, reduced, represent, to_blocks, unpacked
from tamis.plans.linear import GrowingFactor
from tamis.plans.model import matrix
from tamis.shared import stash

REGULARISERS = (None, "Rand", "Diversity", "FacLoc")


def _gradient_sum(blocks: DataFrame, width: int) -> np.ndarray:
    """Sum of the rows' full gradients g x e as a (classes, width) matrix: partial sums per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for k in range(batch.num_rows):
                b = unpacked(batch, k)
                total = total + b.g.T @ b.e
        flat = np.ravel(total) if np.ndim(total) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["d", "v"])

    rows = sorted(blocks.mapInArrow(run, "d long, v double").groupBy("d").agg(F.sum("v").alias("v")).collect())
    return np.array([r["v"] for r in rows]).reshape(-1, width) if rows else np.zeros((0, width))


def validation_gradient(rows: DataFrame, shift_w: np.ndarray, shift_b: np.ndarray) -> tuple[np.ndarray, float]:
    """Summed bias_linear gradient over rows (emb, logits, label) after the last layer moved by the shifts, and the row count."""
    classes, width = shift_w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * (width + 1) + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            e, z, y = matrix(batch.column(0)), matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            z = z - (e @ shift_w.T + shift_b)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            total[:-1] += (p.T @ np.concatenate([e, np.ones((len(e), 1))], axis=1)).ravel()
            total[-1] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["d", "v"])

    summed = rows.select("emb", "logits", "label").mapInArrow(run, "d long, v double").groupBy("d").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(classes * (width + 1) + 1)
    out[summed.column("d").to_numpy()] = summed.column("v").to_numpy()
    return out[:-1].reshape(classes, width + 1), out[-1]


def glister(predicted: DataFrame, labelled: DataFrame, validation: DataFrame | None, k: int, rate: float, classes: int, width: int, regulariser: str | None = None, lam: float = 1.0, seed: int = 0) -> list[tuple[int, float]]:
    """(id, gain): each step the row whose gradient agrees most with the validation loss's.

    ``predicted``, ``labelled`` and ``validation`` have id, emb, logits, p,
    pred (label where known). After a pick the last layer takes one step along
    its gradient, and the validation gradient is summed anew in one pass.
    Without validation rows, the labelled and the pool with predicted labels
    serve. Rand takes the share lam of the budget at random, the rest greedily.
    """
    known = {None: None, "none": None, "rand": "Rand", "diversity": "Diversity", "facloc": "FacLoc"}
    key = regulariser.lower() if isinstance(regulariser, str) else regulariser
    if key not in known:
        raise ValueError(f"unknown regulariser {regulariser!r}; one of {REGULARISERS}")
    kind = known[key]
    if kind == "Rand" and not 0 <= lam <= 1:
        raise ValueError("Rand needs lam from 0 to 1")
    rows = stash(represent(predicted, "grad_bias_linear", classes))
    blocks = stash(to_blocks(rows, TRAVELLING if kind == "FacLoc" else BLOCK))
    loss_rows = validation if validation is not None else predicted.withColumn("label", F.col("pred")).select("emb", "logits", "label").unionByName(labelled.select("emb", "logits", "label"))
    loss_rows = stash(loss_rows.select("emb", "logits", "label"))
    shift_w, shift_b = np.zeros((classes, width)), np.zeros(classes)
    value, n = validation_gradient(loss_rows, shift_w, shift_b)
    first = predicted.count() if validation is None else n
    state = {"value": value / max(first, 1), "seen": 0}
    budget = k - int(lam * k) if kind == "Rand" else k

    def gains(step: int, chosen: Block) -> DataFrame:
        if len(chosen.ids) > state["seen"]:
            last = Block(*[x[-1:] for x in vars(chosen).values()])
            moved = last.g.T @ last.e  # classes by width + 1
            shift_w[:] += rate * moved[:, :-1]
            shift_b[:] += rate * moved[:, -1]
            now, count = validation_gradient(loss_rows, shift_w, shift_b)
            state["value"], state["seen"] = now / max(count, 1), len(chosen.ids)
        slope = state["value"]
        agree = lambda a: np.einsum("ic,cd,id->i", a.g, slope, a.e)
        if kind == "FacLoc":

            agreed = per_candidate(blocks, agree)
            if not len(chosen.ids):
                return agreed

            def cover(a: Block, b: Block, rough: bool = False) -> np.ndarray:
                # distances that the candidate shortens, each ground row counted from its nearest chosen one
                now = b.distance2(chosen).min(axis=1)[None, :]
                now = np.nextafter(now.astype(np.float32), np.float32(np.inf)) if rough else now
                gain = lambda d: np.maximum(np.subtract(now, d, out=d), 0, out=d).sum(axis=1)
                return reduced(a, b, "squared", gain, rough)

            over = lambda some, rough: over_pairs(some, blocks, lambda a, b: cover(a, b, rough)).select("id", F.col("v").alias("c"))
            if lam <= 0:
                return agreed.join(over(blocks, False), "id").select("id", (F.col("v") + lam * F.col("c")).alias("v"))
            return _best_of_bounds(rows, agreed, over, lam, chosen, state)
        if kind == "Diversity":
            near = lambda a: np.exp(-a.distance2(chosen) / 2).sum(axis=1) if len(chosen.ids) else np.zeros(len(a.ids))
            return per_candidate(blocks, lambda a: agree(a) - lam * near(a))
        return per_candidate(blocks, agree)

    picks = greedy(rows, budget, gains)
    if kind == "Rand" and len(picks) < k:
        rest = predicted.where(~F.col("id").isin([i for i, _ in picks]) if picks else F.lit(True))
        picks += [(r["id"], r["score"]) for r in random_rows(rest, k - len(picks), seed).orderBy("rank").collect()]
    return picks


#: Rows whose exact gain gives the least that a step's winner has.
TRIED = 64


def _best_of_bounds(rows: DataFrame, agreed: DataFrame, over: Callable[[DataFrame, bool], DataFrame], lam: float, chosen: Block, state: dict) -> DataFrame:
    """(id, v): v + lam * c, exact, for all rows that can be the best of those not chosen.

    ``agreed`` has each row's v; ``over(blocks, rough)`` gives c, or a bound of
    it in single precision. c falls as rows are chosen, so its bounds of the
    last step (``state``) hold in this one. The exact gains of the rows with the
    highest bounds give the least that a winner has; only rows whose old bound
    reaches it are bounded anew, and only those whose new one does are counted.
    """
    old = state.get("cover")
    left = agreed.where(~F.col("id").isin(chosen.ids.tolist()))
    bound = F.col("v") + lam * F.col("c")

    def exact(some: DataFrame) -> DataFrame:
        some = stash(some.select("id", "v"))
        own = stash(to_blocks(rows.join(some.select("id"), "id"), TRAVELLING))
        return stash(some.join(over(own, False), "id").select("id", bound.alias("v")))

    def reaching(bounds: DataFrame) -> DataFrame:
        bounds = stash(left.join(bounds, "id").select("id", "v", bound.alias("u")))
        least = exact(bounds.orderBy(F.col("u").desc(), "id").limit(TRIED)).agg(F.max(F.when(~F.isnan("v"), F.col("v")))).first()[0]
        return bounds if least is None else bounds.where(F.col("u") >= least - 1e-9 * max(1.0, abs(least)))

    own = rows if old is None else rows.join(reaching(old).select("id"), "id")
    found = over(stash(to_blocks(own, TRAVELLING)), True)
    fresh = stash(found.select("id", F.coalesce(F.nanvl("c", F.lit(float("inf"))), F.lit(float("inf"))).alias("c")))
    if old is None:
        state["cover"] = fresh
    else:
        state["cover"] = stash(old.join(fresh.withColumnRenamed("c", "now"), "id", "left").select("id", F.least("c", "now").alias("c")))
    return exact(reaching(fresh))


def match_gradients(rows: DataFrame, target: DataFrame, k: int, scale_n: int | None = None) -> list[tuple[int, float]]:
    """(id, residual norm): each step the row that brings the chosen sum nearest to n / #target times the target's sum.

    ``rows`` and ``target`` are (id, g, e). Weights are one; ties go to the smaller id.
    """
    rows = stash(rows)
    blocks = stash(to_blocks(rows))
    width = len(rows.select("e").first()[0])
    target = stash(target)
    b = _gradient_sum(to_blocks(target), width) * ((scale_n or rows.count()) / max(target.count(), 1))

    def gains(step: int, chosen: Block) -> DataFrame:
        r = (chosen.g.T @ chosen.e if len(chosen.ids) else 0.0) - b
        rr = float((r**2).sum())
        return per_candidate(blocks, lambda a: np.sqrt(np.maximum(a.norms2() + 2 * np.einsum("ic,cd,id->i", a.g, r, a.e) + rr, 0)))

    return greedy(rows, k, gains, score=lambda v, id_, step: -v)


def non_negative(gram: np.ndarray, right: np.ndarray, ridge: float, start: list[int] = ()) -> np.ndarray:
    """Weights w >= 0 that minimise w' (gram + ridge) w - 2 right' w, by an active set.

    Rows enter where the slope is steepest, at the end of a Cholesky factor that
    grows by a row; where weights would fall below zero, the step stops at the
    first to reach it and its row leaves. ``start`` are rows with a weight in an
    earlier solution. A row that the entered ones explain wholly stays out.
    """
    m, n = gram + ridge * np.eye(len(right)), len(right)
    w, inside, factor, barred = np.zeros(n), [], GrowingFactor(), set()

    def enter(i: int) -> bool:
        cross = m[i, inside]
        c = factor.rows @ cross
        if m[i, i] - c @ c <= 1e-12 * m[i, i]:
            barred.add(i)
            return False
        factor.add(cross, m[i, i])
        inside.append(i)
        return True

    def refactor(kept: list[int]) -> None:
        inside.clear()
        factor.rows = np.zeros((0, 0))
        for i in kept:
            enter(i)

    refactor(list(start))
    scale = np.abs(right).max(initial=0)
    for _ in range(10 * n + 10):
        while inside:
            full = factor.rows.T @ (factor.rows @ right[inside])
            if full.min() > 0:
                w[:] = 0
                w[inside] = full
                break
            low = [k for k in range(len(inside)) if full[k] <= 0]
            now = w[inside]
            step = min(now[k] / (now[k] - full[k]) if now[k] > 0 else 0.0 for k in low)
            now = now + step * (full - now)
            w[:] = 0
            w[inside] = np.maximum(now, 0)
            gone = {inside[k] for k in low if now[k] <= 1e-12 * max(1.0, np.abs(now).max())} or {inside[low[0]]}
            w[list(gone)] = 0
            refactor([i for i in inside if i not in gone])
        slope = right - m @ w
        slope[inside + sorted(barred)] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-10 * scale:
            break
        enter(best)
    return w


def matching_pursuit(rows: DataFrame, target: DataFrame, k: int, ridge: float = 0.0, tol: float = 1e-4) -> tuple[list[int], list[float]]:
    """Orthogonal matching pursuit of the target's summed gradient with non-negative weights: (ids, weights).

    A step is one pass for the largest projection on the residual; the weights
    of the at most k chosen rows are then solved on the driver. It ends at the
    tolerance, or when no row projects positively.
    """
    rows = stash(rows)
    blocks = stash(to_blocks(rows))
    width = len(rows.select("e").first()[0])
    target = stash(target)
    b = _gradient_sum(to_blocks(target), width) * (rows.count() / max(target.count(), 1))
    chosen, ids, w, residual = Block.none(), [], np.zeros(0), b
    while len(ids) < k:
        found = per_candidate(blocks, lambda a, r=residual: np.einsum("ic,cd,id->i", a.g, r, a.e))
        best = found.where(~F.col("id").isin(ids) if ids else F.lit(True)).orderBy(F.col("v").desc(), "id").limit(1).collect()
        if not best or best[0]["v"] <= 0:
            break
        chosen = chosen.add(gathered(rows.where(F.col("id") == best[0]["id"])))
        ids.append(best[0]["id"])
        w = non_negative(chosen.dot(chosen), np.einsum("ic,cd,id->i", chosen.g, b, chosen.e), ridge, np.flatnonzero(w).tolist())
        residual = b - np.einsum("i,ic,id->cd", w, chosen.g, chosen.e)
        if float((residual**2).sum()) <= tol * float((b**2).sum()):
            break
    return ids, w.tolist()


def select_matching(rows: DataFrame, target: DataFrame, k: int, use_weights: bool = False, ridge: float = 0.0, seed: int = 0) -> DataFrame:
    """(rank, id, score, weight): fixed weights in ascending id order, or pursuit filled up at random with weight one."""
    spark = rows.sparkSession
    schema = "rank int, id long, score double, weight double"
    if not use_weights:
        picks = sorted(match_gradients(rows, target, k))
        return spark.createDataFrame([(n + 1, i, s, 1.0) for n, (i, s) in enumerate(picks)], schema)
    ids, weights = matching_pursuit(rows, target, k, ridge)
    rest = rows.where(~F.col("id").isin(ids) if ids else F.lit(True))
    more = [r["id"] for r in random_rows(rest, k - len(ids), seed).orderBy("rank").collect()] if len(ids) < k else []
    both = [*zip(ids, weights), *[(i, 1.0) for i in more]]
    return spark.createDataFrame([(n + 1, i, float(w), float(w)) for n, (i, w) in enumerate(both)], schema)
