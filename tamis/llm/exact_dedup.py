"""Exact deduplication by a tree of merged digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.text import spread, without_spaces
from tamis.shared import numbered, stash

KEY = ["digest", "check", "norm_chars"]


def digest_verdicts(docs: DataFrame, row: str, runs: int | None = None, fan_in: int = 4, ranges: int | None = None) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) for ``docs`` (doc_id, text, and ``row``, unique per row).

    A run is a sorted list of digests with, for each, its best document so far
    and how many it stands for. Every row starts in one of ``runs`` runs, and
    runs are cut into ``ranges`` ranges of digests, so no task ever has a whole
    run; both grow with the rows unless given. In a round, ``fan_in`` neighbouring runs exchange their ranges: each
    range of theirs meets in one task, is sorted and merged, and equal digests
    become one entry. A digest counts as equal only where a second hash of the
    text and its length agree too. When one run is left it holds the verdicts,
    which go back to the entries of the first runs and from there to rows. A
    text that a third of all documents share is one entry per run.
    """
    norm = without_spaces(F.col("text"))
    digests = stash(
        docs.select(
            F.col(row).alias("_at"),
            "doc_id",
            F.unhex(F.sha2(norm, 256)).alias("digest"),
            F.xxhash64(norm).alias("check"),
            F.length(norm).alias("norm_chars"),
            F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"),
        )
    )
    runs = runs or spread(digests.count())
    ranges = ranges or spread(digests.count())
    high = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")  # digests are even over their first four bytes
    digests = digests.withColumns({"run": F.pmod(F.xxhash64("doc_id", "_at"), F.lit(runs)).cast("int"), "range": F.shiftright(high * F.lit(ranges).cast("long"), 32).cast("int")})
    entry = F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_at"))
    first = digests.groupBy("range", "run", *KEY).agg(F.min(entry).alias("best"), F.count("*").alias("n"))
    merged, left = first, runs
    while left > 1:
        left = -(-left // fan_in)
        met = merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("range", "run")
        merged = met.sortWithinPartitions("range", "run", *KEY).groupBy("range", "run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    verdicts = merged.select(*KEY, "best", F.col("n").alias("group_size"))
    down = first.select(*KEY, "run").join(verdicts, KEY)
    return digests.join(down, [*KEY, "run"]).select(
        F.col("_at").alias(row),
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_at") == F.col("best._at")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, runs: int | None = None, fan_in: int = 4) -> DataFrame:
    """One row per row of ``docs``: which of the rows with equal text stays.

    Texts are equal when identical without ASCII white space. Of equal texts
    the row with most code points stays, then the one with the smallest id.
    A null text is empty; a null id sorts after all others. Of rows that repeat
    an id and its length too, or that have no id, any one stays and the others
    go, as they must: exactly one row of a group is ``kept``. An empty table
    gives an empty one; very long texts are hashed whole. Only ``doc_id`` and
    ``text`` are read, so other columns cannot clash.
    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows, row = numbered(docs.select("doc_id", "text"))
    return digest_verdicts(rows, row, runs, fan_in).drop(row)


def drop_copies(docs: DataFrame, runs: int | None = None, fan_in: int = 4) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with their columns as they are.

    Rows are numbered and written to the shared folder first, so that a verdict
    finds its very row, whatever ids repeat.
    """
    rows, row = numbered(docs)
    rows = stash(rows)
    kept = digest_verdicts(rows, row, runs, fan_in).where("kept").select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
