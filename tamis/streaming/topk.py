"""Top-k over a stream of scored rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.greedy import top_k
from tamis.sources.files import remove_folder


def merge(held: DataFrame | None, batch: DataFrame, k: int) -> DataFrame:
    """(rank, id, score): the k best of what is held and a batch; an id that comes again counts once, with its best score.

    An associative, capped merge: neither the order of batches nor their
    replay changes the result, as ties go to the smaller id.
    """
    rows = batch.select("id", "score")
    if held is not None:
        rows = rows.unionByName(held.select("id", "score"))
    return top_k(rows.groupBy("id").agg(F.max("score").alias("score")), k)


class TopKSink:
    """For writeStream.foreachBatch: keeps the k best rows so far in ``path``, a folder per batch.

    A batch starts from the newest folder before its own, whatever numbers were
    skipped, so a replayed batch writes the same rows again. Folders older than
    that are removed.
    """

    def __init__(self, path: str, k: int):
        self.path, self.k = path, k

    def _numbers(self, spark: SparkSession) -> list[int]:
        try:
            rows = spark.read.schema("batch long").parquet(self.path).select("batch").distinct().collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r["batch"] for r in rows)

    def _of(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.schema("rank int, id long, score double").parquet(f"{self.path}/batch={number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in self._numbers(spark) if n < number]
        merge(self._of(spark, before[-1]) if before else None, batch, self.k).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        for n in before[:-1]:
            remove_folder(spark, f"{self.path}/batch={n}")

    def result(self, spark: SparkSession) -> DataFrame:
        """The newest batch's rows; none where no batch has come."""
        numbers = self._numbers(spark)
        return self._of(spark, numbers[-1]) if numbers else spark.createDataFrame([], "rank int, id long, score double")


def stream_top_k(scored: DataFrame, k: int, folder: str) -> DataFrame:
    """Runs a streaming (id, score) table to its end and returns the k best; run again with the same folder, it goes on."""
    sink = TopKSink(f"{folder}/state", k)
    query = scored.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.result(scored.sparkSession)
