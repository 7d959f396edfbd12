"""Quality rules judged per host, with rates shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.text import SPACES, without_spaces, words
from tamis.shared import join_small, stash

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"

RULES = ("too_short", "repetitive")


def repeated_window_words(w: Column, size: int = 3) -> Column:
    """How many words of the array lie in windows of ``size`` words that occur twice or more in it.

    Windows are compared by 64-bit hash. Sorting (hash, position) puts equal
    windows side by side; the positions of those with an equal neighbour, in
    order, each add the words that the window before has not covered.
    """
    n = F.size(w) - (size - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(size)]))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _covered(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), size)
        )

    return F.when(n < 2, F.lit(0)).otherwise(_let(hashes, counted)).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: the only element of an array is bound by transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(pairs: Column, size: int) -> Column:
    def in_order(s: Column) -> Column:
        n = F.size(s)
        same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
        marked = F.transform(s, lambda x, i: F.when(((i > 0) & same(i - 1, i)) | ((i < n - 1) & same(i, i + 1)), x["i"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def total(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(size), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"],
        )

    return _let(pairs, lambda s: total(in_order(s)))


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text (null: none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.select("doc_id", "source", text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return with_words.select(
        "doc_id",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(without_spaces(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"),
    )


def beta_prior(failures: Column, n: Column) -> list[Column]:
    """Aggregates over hosts from which prior() fits a beta distribution by moments."""
    rate = failures / n
    return [F.sum(failures), F.sum(n), F.count("*"), F.sum(n * rate * rate), F.sum(n.cast("double") * n)]


def fit_prior(failures: float, n: float, hosts: float, square: float, n_square: float) -> tuple[float, float]:
    """(alpha, beta) from the moments of host rates weighted by documents.

    The spread between hosts is their weighted variance less what drawing the
    documents alone would give. Without any such spread, or with one host, the
    prior is worth as many documents as a mean host has.
    """
    if not n:
        return 0.5, 0.5
    mean = min(max(failures / n, 1e-6), 1 - 1e-6)
    between = n - n_square / n
    drawn = mean * (1 - mean) * max(hosts - 1, 0)
    spread = (square - n * mean * mean - drawn) / between if between > 0 else 0.0
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else n / hosts
    weight = min(max(weight, 1.0), n / hosts)
    return mean * weight, (1 - mean) * weight


def host_verdicts(measures: DataFrame, min_words: int, max_repeat: float, max_rate: float) -> tuple[DataFrame, int]:
    """(source, host_docs, a shrunk rate per rule, host_ok), and the number of hosts.

    Each host has one row, summed on the map side first. A host fails when the
    shrunk rate of any rule is above ``max_rate``.
    """
    fails = rule_columns(min_words, max_repeat)
    hosts = stash(measures.groupBy("source").agg(F.count("*").alias("host_docs"), *[F.sum(fails[r].cast("long")).alias(f"{r}_n") for r in RULES]))
    row = hosts.agg(F.count("*"), *[x.alias(f"{r}{i}") for r in RULES for i, x in enumerate(beta_prior(F.col(f"{r}_n"), F.col("host_docs")))]).first()
    rates = {}
    for k, r in enumerate(RULES):
        alpha, beta = fit_prior(*[x or 0 for x in row[1 + 5 * k : 6 + 5 * k]])
        rates[r] = (F.col(f"{r}_n") + alpha) / (F.col("host_docs") + alpha + beta)
    ok = ~F.greatest(*rates.values()).__gt__(max_rate)
    return hosts.select("source", "host_docs", *[x.alias(f"{r}_rate") for r, x in rates.items()], ok.alias("host_ok")), row[0]


def rule_columns(min_words: int, max_repeat: float) -> dict[str, Column]:
    return {
        "too_short": F.col("n_words") < min_words,
        "repetitive": 100 * F.col("n_repeat_words") > 100 * max_repeat * F.col("n_words"),
    }


def host_quality(docs: DataFrame, min_words: int = 50, max_repeat: float = 0.5, max_rate: float = 0.5) -> DataFrame:
    """Measures, base rules and the host's verdict for each document.

    A document is kept if it passes the base rules and its host (``source``)
    does. Null sources are one host. Null and empty texts have no words and
    fail as too short. Repeated rows are judged each for itself; an empty table
    gives an empty one. Only doc_id, text and source are read.
    """
    measures = stash(base_measures(docs))
    verdicts, n = host_verdicts(measures, min_words, max_repeat, max_rate)
    rules = rule_columns(min_words, max_repeat)
    judged = join_small(measures, verdicts, "source", n, F.col("doc_id"))
    failed = rules["too_short"] | rules["repetitive"]
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("host_ok"))
