"""Cutting lineage and laying out rows: helpers that every operator may use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (as in tests) gets a folder of this
    machine; a cluster must name one that all its machines share.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return named or os.path.dirname(context.getCheckpointDir())


def stash(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from the shared folder.

    A reliable checkpoint: its files outlive executors, and Spark removes them
    when the DataFrame is no longer referenced (if its cleaner is so set).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a column that tells its rows apart, and that column's name.

    The numbers hold for one computation: stash what carries them before it is
    used twice.
    """
    name = "_row"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, F.monotonically_increasing_id()), name


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def join_small(big: DataFrame, small: DataFrame, key: str, rows: int, spread: Column, most: int = 50_000, salts: int = 32) -> DataFrame:
    """Left join of ``big`` to one row per key, where a few keys may hold most of ``big``.

    ``rows`` is the counted size of ``small``: up to ``most`` it is broadcast;
    beyond that each row is repeated once per salt and ``big`` is dealt by key
    and salt (``spread`` is hashed for it), so a hot key goes to many tasks.
    A null key matches the null key.
    """
    names = [c for c in small.columns if c != key]
    small = small.select(F.col(key).alias("_key"), *names)
    if rows <= most:
        joined = big.join(F.broadcast(small), big[key].eqNullSafe(small["_key"]), "left")
        return joined.drop("_key")
    small = small.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    joined = big.join(small, big[key].eqNullSafe(small["_key"]) & (big["_salt"] == small["_salt2"]), "left")
    return joined.drop("_key", "_salt", "_salt2")


def first_per_group(df: DataFrame, by: str, n: int, *order: Column, salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each group, with ``place`` from 1; a group's rows are cut to n per salt before they meet."""
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    some = dealt.withColumn("place", F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order))).where(F.col("place") <= n).drop("_salt")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def running(df: DataFrame, by: str, value: Column, name: str, *order: Column) -> DataFrame:
    """``df`` with the sum of ``value`` over its group's rows up to each, in ``order``, without one task that holds a group.

    Rows are dealt by range of group and order and summed per range; a range
    starts from the sums of those before it (a row per range and group).
    """
    ranged = stash(df.withColumn("_value", value).repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_part")).agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.join(sums.select("_by", "_part", before.alias("_before")), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_part")))
    own = F.sum("_value").over(Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(name, own + F.col("_before")).drop("_value", "_range", "_by", "_part", "_sum", "_before")


def ordinals(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``_ordinal``, each row's rank from 0 in ``order``, without one task that holds all rows.

    Rows are dealt by range and counted per range; each range's offset is the
    count of those before it (one number per range goes to the driver).
    """
    ranged = stash(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    offsets, total = {}, 0
    for row in sorted(ranged.groupBy("_range").count().collect()):
        offsets[row["_range"]] = total
        total += row["count"]
    ranked = ranged.withColumn("_ordinal", F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long") - 1)
    if offsets:
        lookup = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
        ranked = ranked.withColumn("_ordinal", F.col("_ordinal") + lookup[F.col("_range")])
    return ranked.drop("_range")
