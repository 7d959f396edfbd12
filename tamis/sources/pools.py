"""Tables as pools of feature vectors, and their splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label): vectors as doubles."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def check_pool(df: DataFrame, *names: str) -> DataFrame:
    """``df`` if it has the named columns; ValueError if not."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"a pool needs the columns {', '.join(missing)}")
    return df


def unlabelled(df: DataFrame) -> DataFrame:
    return df.drop("label")


def subset(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def relabelled(df: DataFrame, ids_with_labels: DataFrame) -> DataFrame:
    """The rows named by (id, label), with those labels."""
    return df.drop("label").join(ids_with_labels.select("id", "label"), "id")


def concatenated(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_channels(x: Column, channels: int = 3) -> Column:
    """A one-channel image as several equal ones."""
    return F.flatten(F.array_repeat(x, channels))


def scenario(pool: DataFrame) -> dict[str, DataFrame]:
    """The standard split: labelled and unlabelled rows, and the query, private and validation parts of the labelled."""
    labelled = pool.where("id % 5 = 0")
    return {
        "labelled": labelled,
        "unlabelled": pool.where("id % 5 <> 0"),
        "query": labelled.where("label in (0, 1)"),
        "private": labelled.where("label in (2, 3)"),
        "validation": labelled.where("label >= 4"),
    }
