"""The queries of the text operators; ORACLES has SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import centroids, exact_dedup, filter_audit, host_rules, line_dedup, mixing, page_text, pieces, ppm, simhash, substring_dedup, token_index, toxicity
from tamis.llm.oracles import ORACLES
from tamis.llm.text import fold_column
from tamis.shared import new_folder, stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.host_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = stash(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    mixed = mixing.mix_sources(sizes)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-shards")
    docs = table(spark, sf_dir, "documents")
    token_index.write_token_shards(docs, folder, tokenizer("byte_bpe_50k.json"))
    return token_index.read_token_shards(docs.select("doc_id"), folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_lines", "n_removed")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold_column(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_summary(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_page_text, op2_host_quality, op3_source_mix, op4_token_shards, op5_exact_dedup, op6_line_dedup, op7_toxicity, op8_pieces, op9_lm_scores, op10_simhash, op11_filter_audit, op12_substring_dedup, op13_centroids, pipeline)}

__all__ = ["ORACLES", "QUERIES"]
