"""Pieces that several text operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space between words, and a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: A-Z to a-z and nothing else.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without_spaces(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def spread(rows: int, each: int = 50_000, least: int = 64) -> int:
    """Over how many runs rows are dealt, so that what one key leaves in a run stays bounded whatever their number."""
    return max(least, -(-rows // each))


def fold(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fold_column(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def chunks(texts: list[str | None], most: int = 1 << 21):
    """(from, to) of consecutive texts of about ``most`` characters together."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, place: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``most`` bytes of the text in column ``place`` together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
