"""From raw documents to piece ids: the stages of a training-data pipeline, in order.

Every stage takes rows as they come: null and empty texts are empty documents
(as all of them are equal, one stays), of rows that repeat an id or have none
each is judged for itself, very long texts are read whole, an empty table gives
an empty one, and further columns are kept up to the last stage. Every stage's
verdict is for the very row, not for all rows of an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import catalog, exact_dedup, mixing, pieces, simhash, toxicity
from tamis.shared import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labelled documents of the whole table."""
    model = toxicity.train_toxicity(catalog.table(spark, sf_dir, "documents"), catalog.table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one row that exact deduplication keeps."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the one row with the smallest id."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate gives."""
    return mixing.emit_copies(mixing.mix_sources(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of each document, checked by decoding."""
    encoded = pieces.encode_pieces(docs.select("doc_id", "source", "text"), catalog.tokenizer("piece_bpe_32k.model"), verify=True)
    return encoded.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL cannot express the classifier, fingerprints and pieces; a test compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and reread."""
    docs = catalog.table(spark, sf_dir, "documents")
    folder = new_folder(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
