"""Removing passages of words that already stand earlier, found by anchors at difference-cover positions.

A set of residues is a difference cover of a period when every difference is
that of two of its members. So of two equal windows, wherever they start, some
offset below the period puts both on a position of the cover, and the anchor
there (as many words as fit behind any offset) is in both. Only anchors are
hashed and sent out, 4 of 13 places; windows are hashed around those that occur
twice, and compared whole.

Documents are written once, in blocks of a few MB, as a table bucketed by block:
what the corpus says of a block's anchors and windows comes to the block, and
texts are never shuffled. A block sends every different anchor and window once,
so one that most documents hold is a row per block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tamis.llm.text import SPACES, chunks
from tamis.shared import new_folder

WINDOW = 20
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Spark's own bound on buckets; beyond it a bucket holds more blocks.
MOST_BUCKETS = 100_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Difference covers by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LEAST_ANCHOR = 8

SPACE_BYTES = SPACES.encode()
_IS_SPACE = np.isin(np.arange(256), list(SPACE_BYTES)).astype(np.int8)
_SPACE = re.compile(b"[" + re.escape(SPACE_BYTES) + b"]")
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES = np.random.default_rng(20).integers(0, 1 << 64, (2, 256), np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, words of an anchor): the longest period that leaves anchors of eight words, or the shortest period."""
    if window < min(COVERS):
        raise ValueError(f"a window has at least {min(COVERS)} words")
    period = max((p for p in COVERS if window - p + 1 >= LEAST_ANCHOR), default=min(COVERS))
    return period, COVERS[period], window - period + 1


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, PIECE) - 1, base, np.uint64)], dtype=np.uint64)
    return _POWERS[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], whatever their place."""
    total = np.r_[np.uint64(0), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)]
    return _mixed((total[ends] - total[starts]) * _powers(pow(base, -1, 1 << 64), len(values))[starts])


def _hash_piece(piece: bytes, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a piece."""
    raw = np.frombuffer(piece, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[np.int8(1), _IS_SPACE[raw], np.int8(1)]))
    starts, ends = edges[::2], edges[1::2]
    return starts, _sums(_TABLES[which][raw], starts, ends, _BASES[which]) if len(starts) else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes], which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of all texts, one after another, and each text's number of words; ``which`` picks one of two hashes."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for i, j in chunks(texts, PIECE):
        if j == i + 1:
            text, at, n = texts[i], 0, 0
            while at < len(text):  # a long text in pieces that end with white space
                cut = _SPACE.search(text, min(at + PIECE, len(text)))
                to = cut.end() if cut else len(text)
                own = _hash_piece(text[at:to], which)[1]
                hashes.append(own)
                n, at = n + len(own), to
            counts.append(n)
        else:
            starts, own = _hash_piece(b"\n".join(texts[i:j]), which)
            first = np.cumsum([0, *[len(t) + 1 for t in texts[i : j - 1]]])
            hashes.append(own)
            counts += np.bincount(np.searchsorted(first, starts, side="right") - 1, minlength=j - i).tolist()
    return np.concatenate(hashes), np.array(counts, np.int64)


def _windows(words: np.ndarray, counts: np.ndarray, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, hash) of every run of ``length`` words of one text."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))
    starts = np.flatnonzero(left >= length)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    return starts, _sums(words, starts, starts + length, _BASES[which])


def _positions(counts: np.ndarray) -> np.ndarray:
    """Each word's number in its text."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _anchors(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors: cover positions of texts that have a window."""
    period, cover, length = cover_of(window)
    starts, hashes = _windows(words, counts, length)
    enough = np.repeat(counts >= window, counts)
    on = np.isin(_positions(counts)[starts] % period, cover) & enough[starts]
    return starts[on], hashes[on]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def block_anchors(window: int):
    """For mapInArrow over (block, text): a row per different anchor of a block; ``own`` is twice the block, and one more where it has the anchor twice."""

    def flushed(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(hashes), pa.array(2 * block + (n > 1))], ["h", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            blocks, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(texts)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if held and block != blocks[i]:
                    yield flushed(block, held)
                    held = []
                block = int(blocks[i])
                for a, b in chunks(texts[i:j], 2 * PIECE):
                    held.append(_anchors(*word_hashes(texts[i + a : i + b]), window)[1])
        if held:
            yield flushed(block, held)

    return run


class _Documents:
    """A block's documents in the order of (doc_id, md5), nulls last; equal ones have one rank."""

    def __init__(self, table: pa.Table):
        ids, said = table.column("doc_id").to_pylist(), table.column("said").to_pylist()
        keys = [(d is None, 0 if d is None else d, s) for d, s in zip(ids, said)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.ids, self.said = [ids[i] for i in order], [said[i] for i in order]
        self.texts = pc.take(table.column("text"), pa.array(order, pa.int64())).cast(pa.binary()).to_pylist()
        new = [k == 0 or keys[a] != keys[b] for k, (a, b) in enumerate(zip(order, [None, *order]))]
        self.rank = np.cumsum(new) - 1 if new else np.zeros(0, np.int64)

    def windows(self, window: int, near=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words per document, places, first and second hashes) of the windows, or of those at places that ``near(words, counts)`` takes."""
        words, counts = word_hashes(self.texts)
        starts, a = _windows(words, counts, window)
        own = near(words, counts)[starts] if near else np.ones(len(starts), bool)
        if not own.any():
            return counts, starts[:0], a[:0], a[:0].astype(np.uint32)
        b = _windows(word_hashes(self.texts, 1)[0], counts, window, 1)[1][own]
        return counts, starts[own], a[own], (b >> np.uint64(32)).astype(np.uint32)

    def codes(self, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers in the order of a window's places: the document's rank, then the word's number; places of equal documents are equal."""
        return np.repeat(self.rank, counts)[starts] << 32 | _positions(counts)[starts]


def block_windows(window: int, doc_id: pa.DataType):
    """For cogrouped (documents, repeated anchors) of a block: a row per different window around such an anchor.

    ``at`` is the place of its first word in the block, ``own`` as for anchors;
    the document is that of its first place.
    """
    period = cover_of(window)[0]

    def run(table: pa.Table, repeated: pa.Table) -> pa.Table:
        docs, hits = _Documents(table), np.sort(repeated.column("h").to_numpy().view(np.uint64))

        def near(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
            """Anchors that repeat, extended to every window that can hold them at their offset."""
            anchors, hashes = _anchors(words, counts, window)
            anchors = anchors[hits[np.minimum(np.searchsorted(hits, hashes), len(hits) - 1)] == hashes]
            at, taken = _positions(counts), np.zeros(len(words), bool)
            for back in range(period):
                taken[anchors[at[anchors] >= back] - back] = True
            return taken

        counts, starts, a, b = docs.windows(window, near if len(hits) else lambda words, counts: np.zeros(len(words), bool))
        order = np.lexsort((docs.codes(counts, starts), b, a))
        edges = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(edges)
        more = np.diff(np.r_[first, len(a)]) > 1
        kept = order[first]
        in_order = np.argsort(starts[kept], kind="stable")  # rows of one document together take less room
        kept, more = kept[in_order], more[in_order]
        who = np.searchsorted(np.cumsum(counts), starts[kept], side="right").tolist()
        block = table.column("block")[0].as_py() if table.num_rows else 0
        ties = [int.from_bytes(s[:8], "big") - (1 << 63) for s in docs.said]
        ids = [docs.ids[k] for k in who]
        columns = [_signed(a[kept]), pa.array(b[kept].view(np.int32)), pa.array(2 * block + more, pa.int64()), pa.array(starts[kept].astype(np.int32)), pa.array([d is None for d in ids], pa.bool_()), pa.array(ids, doc_id), pa.array([ties[k] for k in who], pa.int64())]
        return pa.Table.from_arrays(columns, ["a", "b", "own", "at", "no_id", "doc_id", "tie"])

    return run


def _matched(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Of each pair (a, b) its place among the known pairs, which are sorted; -1 for others."""
    out = np.full(len(a), -1)
    low, high = np.searchsorted(known_a, a, side="left"), np.searchsorted(known_a, a, side="right")
    for step in range(int((high - low).max(initial=0))):  # more than once only where half the hash collides
        at = low + step
        same = (at < high) & (out < 0)
        same[same] = known_b[at[same]] == b[same]
        out[same] = at[same]
    return out


def block_kept(window: int, doc_id: pa.DataType):
    """For cogrouped (documents, windows that stand earlier or twice) of a block: what is left of each document.

    A window that has its first place here (``owner``) stays there and goes
    everywhere else; any other goes wherever the block has it.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("to", pa.int32())]))

    def run(table: pa.Table, repeated: pa.Table) -> pa.Table:
        docs, gone = _Documents(table), {}
        if repeated.num_rows:
            counts, starts, a, b = docs.windows(window)
            asked = np.searchsorted(starts, repeated.column("at").to_numpy())
            order = np.lexsort((b[asked], a[asked]))
            asked, owner = asked[order], repeated.column("owner").to_numpy(zero_copy_only=False).astype(bool)[order]
            known = _matched(a, b, a[asked], b[asked])
            starts, known = starts[known >= 0], known[known >= 0]
            codes = docs.codes(counts, starts)
            least = np.full(len(asked), np.iinfo(np.int64).max)
            np.minimum.at(least, known, codes)
            cut = starts[~(owner[known] & (codes == least[known]))]
            size = counts.sum() + 1
            flags = np.cumsum(np.bincount(cut, minlength=size) - np.bincount(cut + window, minlength=size))[:-1] > 0
            ends = np.cumsum(counts)
            gone = {k: flags[ends[k] - counts[k] : ends[k]] for k in np.unique(np.searchsorted(ends, cut, side="right")).tolist()}
        kept, n_words, n_removed, spans = [], [], [], []
        for k, text in enumerate(docs.texts):
            words, cut = text.split(), gone.get(k)
            n_words.append(len(words))
            if cut is None:
                kept.append(b" ".join(words))
                n_removed.append(0)
                spans.append([])
            else:
                kept.append(b" ".join([w for w, g in zip(words, cut.tolist()) if not g]))
                n_removed.append(int(cut.sum()))
                edges = np.flatnonzero(np.diff(np.r_[0, cut.astype(np.int8), 0])).tolist()
                spans.append([{"start": s, "to": t} for s, t in zip(edges[::2], edges[1::2])])
        columns = [pa.array(docs.ids, doc_id), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span)]
        return pa.Table.from_arrays(columns, ["doc_id", "text", "n_words", "n_removed", "spans"])

    return run


def _numbered_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the block, a new one for every BLOCK_BYTES of a task's texts."""
    first, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        before = held + np.r_[0, np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)]
        held = int(before[-1])
        yield pa.RecordBatch.from_arrays([pa.array(first + before[:-1] // BLOCK_BYTES), *batch.columns], ["block", *batch.schema.names])


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each document without the words that a repeated window covers.

    Words are runs of other than ASCII white space. A window is ``window``
    consecutive words of a document; every word goes that is covered by a
    window whose words also start earlier: at a smaller doc_id, or earlier in
    the same document. Windows are judged on the input.

    Rows that repeat an id and the text are one document: they keep and lose
    the same words. Of different texts with one id, or without an id, the one
    with the smaller md5 is the earlier; null ids come last. Null text is empty
    and has no words. Documents shorter than a window stay whole. Very long
    texts are hashed in pieces and compared whole; an empty table gives an
    empty one. Only ``doc_id`` and ``text`` are read, so other columns cannot
    clash. Windows count as equal when two hashes of theirs, of 64 and
    32 bits, agree.
    Returns doc_id, text (the kept words joined by one space), n_words,
    n_removed and spans (the removed words' numbers, [start, to)).
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("said"), text.alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fields = [StructField("block", LongType()), StructField("doc_id", id_type), StructField("said", BinaryType()), StructField("text", StringType())]
    buckets = max(8, min(MOST_BUCKETS, -(-volume // BUCKET_BYTES)))
    name, folder = f"substring_blocks_{uuid.uuid4().hex}", new_folder(spark, "substring-blocks")
    blocks = rows.mapInArrow(_numbered_blocks, StructType(fields))
    blocks.write.format("parquet").option("compression", "zstd").option("path", folder).bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    table = spark.table(name)
    arrow_id = pa.array([], pa.int64()).type if isinstance(id_type, LongType) else pa.int32() if isinstance(id_type, IntegerType) else pa.string()

    anchors = table.select("block", "text").mapInArrow(block_anchors(window), "h long, own long")
    twice = F.sum(1 + F.col("own").bitwiseAND(1))
    hits = anchors.withColumn("n", twice.over(Window.partitionBy("h"))).where("n > 1").select(F.shiftright("own", 1).alias("block"), "h")
    row = StructType([StructField("a", LongType()), StructField("b", IntegerType()), StructField("own", LongType()), StructField("at", IntegerType()), StructField("no_id", BooleanType()), fields[1], StructField("tie", LongType())])
    windows = table.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(block_windows(window, arrow_id), row)
    place, same = F.struct("no_id", "doc_id", "tie"), Window.partitionBy("a", "b")
    judged = windows.withColumns({"n": twice.over(same), "first": F.min(place).over(same)}).where("n > 1")
    judged = judged.withColumn("owner", place.eqNullSafe(F.col("first"))).where(~F.col("owner") | (F.col("own").bitwiseAND(1) == 1))
    repeated = judged.select(F.shiftright("own", 1).alias("block"), "at", "owner")
    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("to", IntegerType())]))
    out = StructType([fields[1], fields[3], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", span)])
    return table.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(block_kept(window, arrow_id), out)

