"""Row scores from predictions: a projection and a bounded top-k each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import vectors as V
from tamis.operators.greedy import top_k


def predictions(model, df: DataFrame) -> DataFrame:
    """Adds logits, emb, p (class probabilities) and pred (first largest class)."""
    return model.forward(df).withColumn("p", V.softmax(F.col("logits"))).withColumn("pred", V.argmax(F.col("logits")))


def dropout_predictions(model, df: DataFrame, n_drop: int = 10, seed: int = 0) -> DataFrame:
    """Adds passes (the probabilities of each dropout pass) and p (their mean)."""
    each = model.passes(df, n_drop, seed=seed)
    return each.withColumn("passes", F.transform("passes", V.softmax)).withColumn("p", V.mean_of(F.col("passes")))


def score_rows(model, df: DataFrame, score: str, n_drop: int | None = None, seed: int = 0) -> DataFrame:
    """(id, score) by entropy, least_confidence or margin, of one prediction or the mean of dropout passes; or bald."""
    if score == "bald":
        return dropout_predictions(model, df, n_drop or 10, seed).select("id", V.mutual_information(F.col("passes")).alias("score"))
    if score not in V.SCORES:
        raise ValueError(f"unknown score {score!r}; one of {', '.join(V.SCORES)}, bald")
    predicted = predictions(model, df) if n_drop is None else dropout_predictions(model, df, n_drop, seed)
    return predicted.select("id", V.SCORES[score](F.col("p")).alias("score"))


def select_uncertain(model, pool: DataFrame, k: int, score: str, n_drop: int | None = None, seed: int = 0) -> DataFrame:
    return top_k(score_rows(model, pool, score, n_drop, seed), k)


def random_rows(pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows by the smallest hash of seed and id: a uniform sample that reruns repeat."""
    return top_k(pool.select("id", V.uniform(seed, F.col("id")).alias("score")), k, ascending=True)
