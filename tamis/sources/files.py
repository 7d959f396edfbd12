"""Sparse text files, comma-separated files, configurations, logs, checkpoints and weights."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.plans.model import LinearHead


def read_libsvm(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(id, x, label) of a LIBSVM file: 1-based sparse indices become a dense array; ids follow the file's order."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("id", F.monotonically_increasing_id())
    tokens = F.split(F.trim("value"), "\\s+")
    pairs = F.transform(F.slice(tokens, 2, F.size(tokens)), lambda t: F.split(t, ":"))
    entries = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].cast("int"), p[1].cast("double"))))
    x = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return lines.withColumn("m", entries).select("id", x.alias("x"), F.floor(tokens[0].cast("double")).cast("int").alias("label"))


def read_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(id, x, label) of a file of numbers whose last column is the label's name or number; labels are ranked from 0."""
    schema = ", ".join([f"c{i} double" for i in range(width)] + ["name string"])
    rows = spark.read.schema(schema).csv(path).where("name is not null").withColumn("id", F.monotonically_increasing_id())
    names = rows.select("name").distinct().withColumn("label", F.row_number().over(Window.orderBy("name")) - 1)  # a row per class
    return rows.join(F.broadcast(names), "name").select("id", F.array(*[f"c{i}" for i in range(width)]).alias("x"), "label")


def standardise(train: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table with x shifted and scaled by the mean and population deviation of ``train``; constant dimensions are only shifted."""
    stats = train.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    rows = sorted(stats.collect())  # a row per dimension
    mean = F.array(*[F.lit(r["m"]) for r in rows])
    scale = F.array(*[F.lit(r["s"] or 1.0) for r in rows])
    scaled = F.zip_with(F.zip_with("x", mean, lambda a, b: a - b), scale, lambda a, b: a / b)
    return [t.withColumn("x", scaled) for t in tables]


def read_config(path: str) -> dict:
    """A JSON configuration; only .json files are taken."""
    if not path.endswith(".json"):
        raise OSError(f"{path} is not a .json file")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path) as f:
        return json.load(f)


def append_log(rounds: DataFrame, path: str) -> None:
    rounds.write.mode("append").parquet(path)


def read_satimage(spark: SparkSession, train: str, test: str) -> list[DataFrame]:
    """Both files' rows: 36 features standardised by the first file, labels from 1 shifted to start at 0."""
    own = [read_libsvm(spark, p, 36).withColumn("label", F.col("label") - 1) for p in (train, test)]
    return standardise(own[0], *own)


def read_ijcnn1(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """Each file's rows: 22 features standardised by the first file, labels -1 and 1 as 0 and 1."""
    own = [read_libsvm(spark, p, 22).withColumn("label", F.when(F.col("label") < 0, 0).otherwise(F.col("label"))) for p in paths]
    return standardise(own[0], *own)


def save_checkpoint(state: DataFrame, path: str, experiment: str, number: int) -> None:
    """Writes a round's state in place of what the round has; Spark's commit makes it appear whole or not at all."""
    own = state.withColumn("experiment", F.lit(experiment)).withColumn("round", F.lit(number))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "round").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """The newest round's state of an experiment."""
    own = spark.read.parquet(path).where(F.col("experiment") == experiment)
    newest = own.agg(F.max("round")).first()[0]
    return own.where(F.col("round") == newest)


def delete_checkpoints(spark: SparkSession, path: str, experiment: str, keep_newest: int = 0) -> int:
    """Removes an experiment's rounds but the newest ``keep_newest``; how many went."""
    rounds = sorted(r["round"] for r in spark.read.parquet(path).where(F.col("experiment") == experiment).select("round").distinct().collect())
    gone = rounds[: len(rounds) - keep_newest] if keep_newest else rounds
    for number in gone:
        remove_folder(spark, f"{path}/experiment={experiment}/round={number}")
    return len(gone)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store Spark reaches by its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def save_head(spark: SparkSession, head: LinearHead, path: str) -> None:
    rows = [(c, w.tolist(), float(b)) for c, (w, b) in enumerate(zip(head.weights, head.bias))]
    spark.createDataFrame(rows, "class int, weights array<double>, bias double").coalesce(1).write.mode("overwrite").parquet(path)


def load_head(spark: SparkSession, path: str) -> LinearHead:
    rows = sorted(spark.read.parquet(path).collect())
    return LinearHead(np.array([r["weights"] for r in rows]), np.array([r["bias"] for r in rows]))
