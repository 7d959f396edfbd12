"""What surrounds a selection: moving rows, metrics, scenario splits and the round loop."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.functions.vectors import uniform
from tamis.operators.uncertainty import predictions, random_rows
from tamis.plans.model import LinearHead, TwoLayer, train_linear
from tamis.plans.training import weights_of
from tamis.shared import first_per_group, running, stash
from tamis.sources import files


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def class_accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def error_per_class(predicted: DataFrame) -> DataFrame:
    """Percent wrong per label, and the mean of those under the null label."""
    each = predicted.groupBy("label").agg((100 * F.avg((F.col("pred") != F.col("label")).cast("double"))).alias("error"))
    return each.unionByName(each.agg(F.lit(None).cast("int").alias("label"), F.avg("error").alias("error")))


def query_set(predicted: DataFrame, classes: list[int], wrong_only: bool = False) -> DataFrame:
    """Labelled rows of some classes, or only those the model gets wrong."""
    own = predicted.where(F.col("label").isin(classes))
    return own.where("pred <> label") if wrong_only else own


def move(train: DataFrame, pool: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train with the chosen rows, pool without them)."""
    ids = chosen.select("id")
    return train.unionByName(pool.join(ids, "id", "left_semi").select(*train.columns)), pool.join(ids, "id", "left_anti")


def fill_up(chosen: DataFrame, pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id) of the chosen and as many random rows as the budget still has."""
    left = k - chosen.count()
    rest = pool.join(chosen.select("id"), "id", "left_anti")
    return chosen.select("id").unionByName(random_rows(rest, max(left, 0), seed).select("id"))


def in_distribution(rows: DataFrame, classes: list[int]) -> DataFrame:
    return rows.where(F.col("label").isin(classes))


def in_distribution_share(rows: DataFrame, ood: int) -> DataFrame:
    return rows.agg(F.avg((F.col("label") != ood).cast("double")).alias("share"))


def class_counts(chosen: DataFrame, pool: DataFrame) -> DataFrame:
    """How many of the chosen ids each class has."""
    return pool.join(chosen.select("id"), "id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


def unique_points(chosen: DataFrame, repeats: int) -> DataFrame:
    """How many different points a selection has when each stands ``repeats`` times side by side in the pool."""
    return chosen.agg(F.countDistinct(F.floor(F.col("id") / repeats)).alias("n_unique"), F.count("*").alias("n"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id").intersect(b.select("id"))
    return both.agg(F.count("*").alias("n_common"))


def new_share(chosen: DataFrame, train: DataFrame, budget: int) -> DataFrame:
    """Different sources among the chosen that are not in train, over the budget; rows carry ``source_id``."""
    new = chosen.select("source_id").distinct().join(train.select("source_id").distinct(), "source_id", "left_anti")
    return new.agg((F.count("*") / budget).alias("share"))


def redundant(pool: DataFrame, factor: int) -> DataFrame:
    """Each class's first ceil(n / factor) rows in id order, repeated over all its places; (id, source_id, label)."""
    sizes = pool.groupBy(F.col("label").alias("_label")).agg(F.ceil(F.count("*") / factor).alias("keep"))
    placed = running(pool.select("id", "label"), "label", F.lit(1), "pos", F.col("id")).withColumn("pos", F.col("pos") - 1)
    placed = stash(placed.join(F.broadcast(sizes), F.col("label").eqNullSafe(F.col("_label"))).drop("_label"))  # a row per class
    sources = placed.where("pos < keep").select("label", F.col("pos").alias("slot"), F.col("id").alias("source_id"))
    return placed.withColumn("slot", F.pmod("pos", "keep")).join(sources, ["label", "slot"]).select("id", "source_id", "label")


def repeated(pool: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times: id * times + copy, with source_id."""
    each = pool.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return each.withColumn("source_id", F.col("id")).withColumn("id", F.col("id") * times + F.col("copy")).drop("copy")


def balanced_split(pool: DataFrame, seed_n: int, pool_n: int) -> DataFrame:
    """(id, label, part): per class the first seed_n ids are the seed, the next pool_n the pool."""
    part = F.when(F.col("place") <= seed_n, "seed").otherwise("pool")
    return first_per_group(pool.select("id", "label"), "label", seed_n + pool_n, F.col("id")).select("id", "label", part.alias("part"))


def rare_split(pool: DataFrame, rare: list[int], rare_sizes: tuple[int, int], sizes: tuple[int, int], seed: int = 0) -> DataFrame:
    """(id, label, part) with fewer rows of rare classes, drawn by hash."""
    is_rare = F.col("label").isin(rare)
    n_seed = F.when(is_rare, rare_sizes[0]).otherwise(sizes[0])
    n_pool = F.when(is_rare, rare_sizes[1]).otherwise(sizes[1])
    place = F.col("place")
    part = F.when(place <= n_seed, "seed").when(place <= n_seed + n_pool, "pool")
    drawn = first_per_group(pool.select("id", "label"), "label", max(sum(rare_sizes), sum(sizes)), uniform(seed, F.col("id")), F.col("id"))
    return drawn.select("id", "label", part.alias("part")).where("part is not null")


def ood_split(pool: DataFrame, known: list[int], seed_n: int, pool_n: int, seed: int = 0) -> DataFrame:
    """(id, label, part): seed and pool rows of the known classes, pool rows of the others; all disjoint."""
    is_known = F.col("label").isin(known)
    part = F.when(is_known & (F.col("place") <= seed_n), "seed").otherwise(F.when(is_known, "pool").otherwise("ood"))
    drawn = first_per_group(pool.select("id", "label"), "label", seed_n + pool_n, uniform(seed, F.col("id")), F.col("id"))
    return drawn.select("id", "label", part.alias("part"))


def saturation(curve: DataFrame, window: int = 10, min_gain: float = 0.001) -> DataFrame:
    """(round, gain, saturated): the largest later-less-earlier accuracy in the last ``window`` rounds."""
    own = Window.orderBy("round").rowsBetween(-(window - 1), 0)  # a row per round
    values = F.collect_list("accuracy").over(own)
    gains = F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.get("v", i) - F.array_min(F.slice("v", 1, i)))
    gain = F.when(F.size("v") > 1, F.array_max(gains))
    full = F.col("n") == window
    out = curve.select("round", values.alias("v"), F.count("*").over(own).alias("n")).select("round", gain.alias("gain"), full.alias("full"))
    return out.select("round", "gain", (F.col("full") & (F.col("gain") < min_gain)).alias("saturated"))


def running_total(rows: DataFrame, value: str, by: str, order: Column) -> DataFrame:
    """``rows`` with ``running``, the sum of ``value`` up to each row of its group."""
    return running(rows, by, F.col(value), "running", order)


@dataclass
class Rounds:
    """Select, move, retrain, evaluate, again and again.

    ``select(model, train, pool, k)`` gives (rank, id, score). Rounds end when
    the pool is empty or the accuracy on ``test`` passes ``target``. The state
    is written each round, so a round's plan does not grow with their number.
    ``fit(train)`` gives the model; without it a linear head is trained with
    the settings in ``training``.

    With a ``path``, every round's ids of training rows, weights and log are
    written in one commit under (experiment, round), and a run starts from the
    newest whole round that it finds there: what a stopped run has done is not
    done again, and it ends as an unbroken one. ``resumed(model)`` hears of the
    weights found. ``dump(model)`` gives a name and arrays, ``load`` the model
    again; without them linear heads and two-layer networks are known.
    """

    select: Callable
    classes: int
    width: int
    budget: int
    target: float | None = None
    training: dict = field(default_factory=dict)
    fit: Callable | None = None
    resumed: Callable | None = None
    dump: Callable = lambda model: (type(model).__name__, weights_of(model))
    load: Callable = lambda name, arrays: MODELS[name](*arrays)

    def run(self, train: DataFrame, pool: DataFrame, test: DataFrame, rounds: int, path: str | None = None, experiment: str = "rounds") -> DataFrame:
        spark, log, first, model = train.sparkSession, [], 0, None
        if path is not None and (found := self._newest(spark, path, experiment)) is not None:
            first, log, model, ids = found
            every = train.unionByName(pool.select(*train.columns))
            train, pool = (stash(every.join(ids, "id", how)) for how in ("left_semi", "left_anti"))
            if self.resumed:
                self.resumed(model)
        for number in range(first, rounds + 1):
            if model is None:
                began = time.time()
                model = self.fit(train) if self.fit else train_linear(train, self.classes, self.width, **self.training)[0]
                trained = time.time()
                found = accuracy(predictions(model, test)).first()["accuracy"]
                log.append((number, train.count(), float(found or 0.0), trained - began))
                if path is not None:
                    self._commit(train, model, log, path, experiment, number)
            if number == rounds or self.target is not None and log[-1][2] > self.target or pool.isEmpty():
                break
            chosen = stash(self.select(model, train, pool, self.budget))
            train, pool = map(stash, move(train, pool, chosen))
            model = None
        return spark.createDataFrame([r for r in log if r[0] <= rounds], "round int, n_train long, accuracy double, train_s double")

    def _commit(self, train: DataFrame, model, log: list[tuple], path: str, experiment: str, number: int) -> None:
        name, arrays = self.dump(model)
        parts = [("model", i, name, list(a.shape), a.ravel().tolist()) for i, a in enumerate(arrays)]
        parts += [("log", r[0], None, None, [float(v) for v in r]) for r in log]
        few = train.sparkSession.createDataFrame(parts, STATE)
        ids = train.select(F.lit("train").alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<int>").alias("shape"), F.lit(None).cast("array<double>").alias("v"))
        files.save_checkpoint(ids.unionByName(few), path, experiment, number)

    def _newest(self, spark, path: str, experiment: str):
        """(round, log, model, ids of training rows) of the newest round written whole; None without any."""
        try:
            state = files.load_checkpoint(spark, path, experiment)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        few = state.where("kind <> 'train'").collect()  # a row per weight array and round
        if not few:
            return None
        log = [(int(r["v"][0]), int(r["v"][1]), r["v"][2], r["v"][3]) for r in sorted((r for r in few if r["kind"] == "log"), key=lambda r: r["id"])]
        weights = sorted((r for r in few if r["kind"] == "model"), key=lambda r: r["id"])
        model = self.load(weights[0]["name"], [np.array(r["v"]).reshape(r["shape"]) for r in weights])
        return log[-1][0], log, model, state.where("kind = 'train'").select("id")


#: What a round commits: ids of training rows, weight arrays, and the log so far.
STATE = "kind string, id long, name string, shape array<int>, v array<double>"
MODELS = {"LinearHead": LinearHead, "TwoLayer": TwoLayer}
