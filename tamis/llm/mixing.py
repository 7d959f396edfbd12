"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.text import n_words
from tamis.shared import join_small, ordinals, stash

#: Rows of the per-source table up to which it is broadcast.
MOST_BROADCAST = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources.

    Sources, by code point with null last, take ``weights`` in turn and share
    ``share`` times all words. None gets more than ``most`` times its own; what
    that leaves over is shared again by weight among the others. Each pass is
    one aggregate over the per-source table; there are at most as many as
    sources, in practice two or three.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordinals(per_source, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_ordinal"), F.lit(len(weights))) + 1).cast("int"))
    ranked = stash(ranked.select("source", "source_size", weight.alias("weight")))
    cap = F.lit(most) * F.col("source_size")
    row = ranked.agg(F.count("*").alias("n"), F.sum("source_size").alias("size")).first()
    total, level = share * (row["size"] or 0), 0.0
    while True:
        full = F.col("weight") * F.lit(level) > cap
        state = ranked.agg(F.sum(F.when(full, cap)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not state["weight"]:
            level = float("inf")
            break
        after = (total - (state["used"] or 0.0)) / state["weight"]
        if after <= level:
            break
        level = after
    target = cap if level == float("inf") else F.least(cap, F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.cast("double").alias("target")), row["n"]


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    """floor(rate) copies and one more with the fraction as its probability, drawn from a hash of seed and id."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 8), 16, 10).cast("long")
    whole = F.floor(rate)
    return whole + F.when((draw + 0.5) / F.lit(4294967296.0) < rate - whole, 1).otherwise(0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target and n_copies.

    Size is the number of words (null text: 0), or the column ``size`` where
    there is no ``text``. A source's rate is its target over its size, never
    above ``most``. Null is a source of its own; a source without words has
    rate 0. Rows that repeat an id draw alike. Other columns of ``docs`` named
    like the new ones are replaced.
    """
    size = n_words(F.col("text")) if "text" in docs.columns else F.col("size")
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "n_copies")]
    sized = docs.select(*kept, size.alias("size"))
    targets, n = source_targets(sized, weights, share, most)
    mixed = join_small(sized, targets, "source", n, F.col("doc_id"), MOST_BROADCAST)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return mixed.withColumn("n_copies", copies(F.col("doc_id"), rate, seed).cast("long"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row n_copies times."""
    each = F.explode(F.array_repeat(F.lit(0), F.col("n_copies").cast("int")))
    return mixed.where("n_copies > 0").withColumn("_copy", each).drop("_copy")
