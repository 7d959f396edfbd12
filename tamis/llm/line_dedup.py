"""Removing passages that repeat across documents, found by windows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.text import SPACES, spread
from tamis.shared import stash

WINDOW = 3


def dedup_lines(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """Each document without the line windows that an earlier place already has.

    Lines are cut at \\n; those with a word are numbered, and every ``WINDOW``
    consecutive ones (trimmed of ASCII white space) make a window, known by its
    sha256. Of equal windows the one with the smallest (doc_id, position)
    stays; every other covers its lines, overlapping covers merge into spans,
    and the lines of a span go. Blank lines, and documents with fewer lines
    than a window, stay as they are. The window count and the first place are
    aggregated per window and run of documents, then per window, and go back
    by window and run, so a window that most documents share never meets in
    one task; there are more runs where there are more windows, unless given.

    A document is known by its id and its whole text (its md5), so rows that
    share an id, or have none, are told apart by what they say. Rows that repeat
    both are one document: they share its spans, and none takes the other's
    lines (exact deduplication is for those). Ties of places with one id go by
    the md5. Null text: text stays null, no lines. Null ids sort last. Very long
    texts are cut whole. An empty table gives an empty one. Columns of ``docs``
    are kept; ``text`` is replaced and n_lines, n_removed, spans are set.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "spans")]
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    full = F.filter(F.transform(lines, lambda x: F.trim(x, F.lit(SPACES))), lambda x: F.length(x) > 0)
    starts = F.sequence(F.lit(1), F.size("full") - (WINDOW - 1))
    hashed = F.when(F.size("full") < WINDOW, F.array().cast("array<binary>")).otherwise(F.transform(starts, lambda i: F.unhex(F.sha2(F.concat_ws("\n", F.slice("full", i, F.lit(WINDOW))), 256))))
    text_key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    # written once: counts, first places and covers are taken from these rows, not from the texts again
    cut = docs.select("doc_id", text_key.alias("said"), full.alias("full"))
    places = stash(cut.select("doc_id", "said", F.posexplode(hashed).alias("at", "window")))
    runs = runs or spread(places.count())
    places = places.withColumn("run", F.pmod(F.xxhash64("doc_id", "said"), F.lit(runs)).cast("int"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("said"), F.col("at"))
    by_run = places.groupBy("window", "run").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    repeated = by_run.groupBy("window").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("window", "first")
    down = by_run.select("window", "run").join(repeated, "window")
    later = places.join(down, ["window", "run"]).where(~place.eqNullSafe(F.col("first")))
    covers = later.groupBy(F.col("doc_id").alias("_doc_id"), F.col("said").alias("_said")).agg(F.sort_array(F.collect_set("at")).alias("_covers"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (text_key == F.col("_said"))
    joined = docs.select(*columns).join(covers, same, "left")
    found = joined.withColumn("_lines", lines).withColumn("spans", _spans(F.coalesce("_covers", F.array().cast("array<int>"))))
    n_lines = F.size(F.filter("_lines", lambda x: F.length(F.translate(x, SPACES, "")) > 0)).cast("long")
    n_removed = F.aggregate("spans", F.lit(0), lambda a, s: a + s["to"] - s["start"]).cast("long")
    kept = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat_ws("\n", _outside(F.col("_lines"), F.col("spans"))))
    return found.select(
        *[kept.alias(c) if c == "text" else F.col(c) for c in columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"), "spans"
    )


def _spans(covers: Column) -> Column:
    """Sorted window starts as disjoint spans [start, to) of numbered lines."""
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("to"))
    empty = F.struct(F.array().cast("array<struct<start:int,to:int>>").alias("done"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("to"))

    def add(a: Column, x: Column) -> Column:
        joins = F.coalesce(x <= a["to"], F.lit(False))
        closed = F.when(joins | a["start"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(pair(a["start"], a["to"]))))
        return F.struct(closed.alias("done"), F.when(joins, a["start"]).otherwise(x).cast("int").alias("start"), (x + WINDOW).cast("int").alias("to"))

    return F.aggregate(covers, empty, add, lambda a: F.when(a["start"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(pair(a["start"], a["to"])))))


def _outside(lines: Column, spans: Column) -> Column:
    """The lines outside all spans; blank lines have no number and stay."""
    blank = lambda x: F.length(F.translate(x, SPACES, "")) == 0
    flags = F.transform(lines, lambda x: F.when(blank(x), 0).otherwise(1))
    places = F.filter(F.transform(flags, lambda f, i: F.when(f == 1, i)), lambda x: x.isNotNull())
    gone = F.flatten(F.transform(spans, lambda s: F.slice(places, s["start"] + 1, s["to"] - s["start"])))
    return F.get(F.transform(F.array(gone), lambda g: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g), lambda i: F.get(lines, i))), 0)
