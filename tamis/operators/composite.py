"""Selections made of others: filtered coverage, and budgets per partition."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.operators.greedy import furthest_first_by_part, maximise, selection, top_k
from tamis.plans.blocks import represent
from tamis.shared import first_per_group


def filtered_coverage(scored: DataFrame, predicted: DataFrame, k: int, classes: int, top_n: int = 5, function: str = "facility_location", representation: str = "linear", **options) -> DataFrame:
    """(rank, id, score): of the min(k * top_n, all) most uncertain rows, those that cover them best.

    ``scored`` is (id, score), ``predicted`` has id, p, pred, emb. Only the
    survivors, a bounded number, are compared with one another.
    """
    survivors = top_k(scored, k * top_n)
    rows = predicted.join(F.broadcast(survivors.select("id")), "id", "left_semi")
    return selection(scored.sparkSession, maximise(represent(rows, representation, classes), k, function, **options))


def shares(n: int, parts: int, k: int) -> list[tuple[int, int]]:
    """(end, budget) of each of ``parts`` ranges of n rows: ends and running budgets are rounded up."""
    if parts > k or parts > n:
        raise ValueError("more partitions than budget or rows")
    ends = [math.ceil(n * (i + 1) / parts) for i in range(parts)]
    spent = [math.ceil(k * e / n) for e in ends]
    return [(e, s - t) for e, s, t in zip(ends, spent, [0, *spent])]


def numbered(pool: DataFrame) -> DataFrame:
    """Adds pos, the rank of the id from 0, counted per range of ids."""
    from tamis.shared import ordinals

    return ordinals(pool, F.col("id")).withColumnRenamed("_ordinal", "pos")


def partitioned_scores(scored: DataFrame, parts: int, k: int) -> DataFrame:
    """(rank, id, score): each contiguous part of the pool fills its share of the budget with its best rows."""
    rows = numbered(scored)
    plan = shares(rows.count(), parts, k)
    part, budget = F.lit(len(plan) - 1), F.lit(plan[-1][1])
    for i in range(len(plan) - 2, -1, -1):
        part = F.when(F.col("pos") < plan[i][0], i).otherwise(part)
        budget = F.when(F.col("pos") < plan[i][0], plan[i][1]).otherwise(budget)
    own = rows.withColumn("part", part).withColumn("budget", budget)
    kept = first_per_group(own, "part", max(b for _, b in plan), -F.col("score"), F.col("id")).where("place <= budget")
    return kept.select(F.row_number().over(Window.orderBy("part", "place")).cast("int").alias("rank"), "id", "score")  # k rows


def parted(pool: DataFrame, parts: int, k: int) -> tuple[DataFrame, dict[int, int]]:
    """(pool with the number of its contiguous part, each part's share of the budget)."""
    rows = numbered(pool)
    plan = shares(rows.count(), parts, k)
    part = F.lit(len(plan) - 1)
    for i in range(len(plan) - 2, -1, -1):
        part = F.when(F.col("pos") < plan[i][0], i).otherwise(part)
    return rows.withColumn("part", part).drop("pos"), {i: budget for i, (_, budget) in enumerate(plan)}


def partitioned_furthest_first(pool: DataFrame, labelled: DataFrame | None, parts: int, k: int) -> DataFrame:
    """(rank, id, score): furthest-first in each contiguous part with its share of the budget; k jobs, whatever the number of parts."""
    rows, budgets = parted(pool, parts, k)
    picks = furthest_first_by_part(rows, labelled, budgets)
    return selection(pool.sparkSession, [x for p in sorted(picks) for x in picks[p]])


def partitioned(pool: DataFrame, parts: int, k: int, select: Callable[[DataFrame, int], list[tuple[int, float]]]) -> DataFrame:
    """Any selection, run in each contiguous part after the other with its share of the budget."""
    rows = numbered(pool)
    picks, start = [], 0
    for end, budget in shares(rows.count(), parts, k):
        own = rows.where((F.col("pos") >= start) & (F.col("pos") < end)).drop("pos")
        picks += select(own, budget) if budget else []
        start = end
    return selection(pool.sparkSession, picks)
