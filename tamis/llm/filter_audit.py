"""How filters interact: what each removes in every order, and its Shapley share of all that is removed.

A document's failures are a mask of five bits, and all that is asked depends on
how many documents of a part have each mask. From these counts comes the part's
removal polynomial, the multilinear extension of "removed by a set of filters":
with a filter's variable at 0 or 1 it says what a set removes (its corners), and
the integral of a partial derivative along the diagonal is the filter's Shapley
value, computed with exact rationals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.text import slices

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Percent of distinct words and of capitals, and the symbols that a text may not hold.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))
#: Salts over which the copies of one text are dealt.
SALTS = 64

ROW = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: bytes) -> int:
    """Bits 0 to 3: what a text fails by itself (A to D)."""
    words = text.split()  # bytes are cut at ASCII white space and nothing else
    few = len(words) < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    capitals = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * len(text.translate(None, CONTINUED))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return few | same << 1 | capitals << 2 | symbols << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
            masks = pa.array([own_failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), masks, digests], ["doc_id", "part", "own", "digest"])


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs`` (doc_id, text, lang).

    Copies are known by sha256. The smallest id of a text is aggregated before
    the exchange, and comes back only for texts that more than one row has, by
    text and salt, so a text that a third of all rows share meets in no task.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    judged = rows.mapInArrow(_judged, f"doc_id {id_type}, part string, own int, digest binary")
    judged = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int"))
    by_salt = judged.groupBy("digest", "salt").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copied = by_salt.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    firsts = by_salt.select("digest", "salt").join(copied, "digest")
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    found = judged.join(firsts, ["digest", "salt"], "left")
    return found.select("doc_id", "part", (F.col("own") + F.when(later, 16).otherwise(0)).alias("mask"))


class RemovalPolynomial:
    """Sum over masks of count times (1 - product over the mask's filters of (1 - x)), by monomials."""

    def __init__(self, counts: dict[int, int], filters: int = len(FILTERS)):
        self.filters, self.coefficients = filters, {}
        for t in range(1, 1 << filters):
            sign = 1 if t.bit_count() % 2 else -1
            if c := sign * sum(n for mask, n in counts.items() if mask & t == t):
                self.coefficients[t] = c

    def corner(self, chosen: int) -> int:
        """Its value where the chosen filters' variables are one and the others zero: what they remove together."""
        return sum(c for t, c in self.coefficients.items() if t & chosen == t)

    def shapley(self, f: int) -> Fraction:
        """The integral from 0 to 1 of the derivative by filter f, with all variables equal: c t^(size - 1) gives c / size."""
        return sum((Fraction(c, t.bit_count()) for t, c in self.coefficients.items() if t >> f & 1), Fraction(0))


def audit_part(part: str, counts: list[tuple[int, int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """The rows of one part from its (mask, documents, good ones, toxic ones)."""
    total = sum(n for _, n, _, _ in counts)
    every, good, toxic = (RemovalPolynomial({c[0]: c[k] for c in counts}, len(filters)) for k in (1, 2, 3))
    fails = [sum(n for mask, n, _, _ in counts if mask >> f & 1) for f in range(len(filters))]
    alone = [sum(n for mask, n, _, _ in counts if mask == 1 << f) for f in range(len(filters))]
    shares = [every.shapley(f) * factorial(len(filters)) for f in range(len(filters))]
    rows = []
    for order in permutations(range(len(filters))):
        name, before = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone, lost_good, lost_toxic = (p.corner(after) - p.corner(before) for p in (every, good, toxic))
            rows.append((part, name, step, total - every.corner(after), gone, fails[f] - gone, alone[f], lost_good, lost_toxic, int(shares[f])))
            before = after
    return rows


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ROW.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    for batch in batches:
        for row in batch.to_pylist():
            rows = audit_part(row["part"], [(c["mask"], c["n"], c["good"], c["toxic"]) for c in row["counts"]])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (lang), each order of the five filters and each step: what is kept, removed and lost.

    Filters: A fewer than 200 words; B fewer than half of the words distinct; C
    more than 3 % of code points are A-Z; D holds one of ``#$%&*|``; E the same
    text as a row of smaller doc_id, anywhere in the table. Null text is empty;
    null and empty lang are one part. A null doc_id is after all others: such a
    row fails E when a row with an id has its text, and has no labels. Rows that
    repeat an id count each, and neither is the smaller. Label rows that repeat
    an id count once, as 1 where one of them is. Texts are judged whole, however
    long. An empty table has no part and gives no row; without labels nothing is
    good or toxic. Only doc_id, text, lang and doc_id, quality, toxic are read.
    Returns the columns of ``ROW``.
    """
    masks = failure_masks(docs)
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = (
        masks.join(said, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    )
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32 entries
    return parts.mapInArrow(_audited, ROW)
