"""Joint batches by mutual information over dropout passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators.greedy import selection
from tamis.plans.model import uniform
from tamis.shared import stash


def conditional_entropy(p: np.ndarray) -> np.ndarray:
    """Mean over passes of the entropy, of (rows, passes, classes)."""
    return -(np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0)).sum(axis=2).mean(axis=1)


def batch_bald(passes: DataFrame, k: int, n_samples: int = 1000, seed: int = 0) -> DataFrame:
    """(rank, id, score): greedily the row with the largest joint mutual information with the rows chosen.

    ``passes`` is (id, passes). The joint distribution of the chosen rows'
    outcomes given each pass is exact while it has at most ``n_samples``
    outcomes; beyond, outcomes are drawn per pass and weighed by their mean
    probability. It rides along with the tasks (outcomes by passes); each step
    is one pass over the pool.
    """
    rows = stash(passes.select("id", "passes"))
    first = rows.first()
    if first is None:
        return selection(passes.sparkSession, [])
    n_pass, classes = len(first["passes"]), len(first["passes"][0])
    joint, weight = np.ones((1, n_pass)), np.ones(1)  # probability of each outcome given the pass; importance
    chosen: list[np.ndarray] = []
    picks, spent = [], 0.0
    for step in range(k):

        def gains(batches: Iterator[pa.RecordBatch], joint=joint, weight=weight, spent=spent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                p = batch.column(1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_pass, classes)
                out = np.zeros(len(p))
                for a in range(0, len(p), 64):
                    mean = np.einsum("mk,nkc->nmc", joint, p[a : a + 64]) / n_pass
                    logs = np.log(np.where(mean > 0, mean, 1))
                    out[a : a + 64] = -np.einsum("m,nmc->n", weight, mean * logs)
                out -= conditional_entropy(p) + spent
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "v"])

        found = rows.mapInArrow(gains, "id long, v double")
        best = found.where(~F.col("id").isin([i for i, _ in picks]) if picks else F.lit(True)).orderBy(F.col("v").desc(), "id").limit(1).collect()
        if not best:
            break
        picks.append((best[0]["id"], best[0]["v"]))
        p = np.array(rows.where(F.col("id") == best[0]["id"]).first()["passes"], float)
        spent += float(conditional_entropy(p[None])[0])
        chosen.append(p)
        if classes ** len(chosen) <= n_samples:
            joint = np.einsum("mk,kc->mck", joint, p).reshape(-1, n_pass)
            weight = np.ones(len(joint))
        else:
            joint, weight = sampled_joint(chosen, n_samples, seed + step)
    return selection(passes.sparkSession, picks)


def sampled_joint(chosen: list[np.ndarray], n_samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Outcomes drawn from each pass in equal number: their probability given each pass, and one over (draws * mean probability)."""
    n_pass = len(chosen[0])
    each = max(1, n_samples // n_pass)
    joint = np.ones((each * n_pass, n_pass))
    for r, p in enumerate(chosen):
        ends = p.cumsum(axis=1)
        u = np.array([[uniform(seed, r, k, m) for m in range(each)] for k in range(n_pass)])
        drawn = np.minimum((u[:, :, None] > ends[:, None, :]).sum(axis=2), p.shape[1] - 1).ravel()
        joint *= p[:, drawn].T
    return joint, 1.0 / (len(joint) * joint.mean(axis=1))


def joint_entropy(chosen: list[np.ndarray]) -> float:
    """Exact entropy of the joint outcomes of rows of (passes, classes)."""
    joint = np.ones((1, len(chosen[0])))
    for p in chosen:
        joint = np.einsum("mk,kc->mck", joint, p).reshape(-1, len(p))
    mean = joint.mean(axis=1)
    return float(-(mean * np.log(np.where(mean > 0, mean, 1))).sum())
