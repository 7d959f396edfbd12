"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.components import star_components
from tamis.llm.text import spread
from tamis.shared import numbered, stash

SEED = 42
#: A fingerprint is cut into this many blocks of bits; links differ in at most RADIUS of them, so they agree on all others.
BLOCKS, RADIUS = 6, 3
EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
MASKS = [sum(((1 << EDGES[k + 1]) - (1 << EDGES[k])) for k in own) for own in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; no word: 0."""
    import xxhash

    w = text.lower().split()  # A-Z and ASCII white space only, as these are bytes
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(*[w[k:] for k in range(shingle)]))) or [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, row: str) -> DataFrame:
    """(doc_id, row, fp): the fingerprint's 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "row", "fp"])

    return docs.select("doc_id", row, "text").mapInArrow(each, "doc_id long, row long, fp long")


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one (b is None).

    Each returned pair is a fingerprint and the smallest of its component here.
    Rows are compared a block at a time; links inside what is one component
    already cost nothing more, so a tile of near copies gives a row each.
    """
    every = a if b is None else np.concatenate([a, b])
    labels = np.arange(len(every))
    right = every if b is None else b
    offset = 0 if b is None else len(a)
    for k in range(0, len(a), step):
        near = np.bitwise_count(a[k : k + step, None] ^ right[None, :]) <= radius
        if b is None:
            near[np.arange(len(near)), np.arange(k, k + len(near))] = False
        for i in np.flatnonzero(near.any(axis=1)):
            joined = np.unique(labels[np.flatnonzero(near[i]) + offset])
            own = labels[k + i]
            if len(joined) > 1 or joined[0] != own:
                joined = np.append(joined, own)
                labels[np.isin(labels, joined)] = joined.min()
    moved = np.flatnonzero(labels != np.arange(len(every)))
    if not len(moved):
        return every[:0], every[:0]
    least = np.full(len(every), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    np.minimum.at(least, labels, every)
    out = np.flatnonzero(every != least[labels])
    return every[out], least[labels[out]]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = 2048, salts: int = 16) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints ``fp`` at ``radius`` or fewer differing bits.

    Two fingerprints that differ in at most three bits differ in at most three
    of six blocks, so they agree on the other three. Each choice of three
    blocks is a table, whose key is the bits of those blocks (some 32), and only
    fingerprints with one key are compared: no pair is lost, and a key has few
    rows even among thousands of millions. The fingerprints of a key are one
    tile; where they are more than ``tile`` they are cut by population count and
    hash, and tiles whose population counts differ beyond the radius are never
    paired. Tile pairs of such a key are dealt out by salt.
    """
    if radius > RADIUS:
        raise ValueError(f"a radius of {radius} needs more than {BLOCKS} blocks")
    banded = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in MASKS])).alias("band", "key"))
    sizes = banded.groupBy("band", "key").count().where(F.col("count") > tile)
    # a crowded key comes once per salt, so its fingerprints learn of it in many tasks
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cut = banded.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(sizes, ["band", "key", "salt"], "left")
    parts = F.ceil(F.col("count") * 0.15 / tile)
    tiles = (
        cut.select(
            "band",
            "key",
            F.when(F.col("count").isNotNull(), F.bit_count("fp")).otherwise(-1).alias("pop"),
            F.when(F.col("count").isNotNull(), F.pmod(F.xxhash64("fp"), parts)).otherwise(0).alias("part"),
            "fp",
        )
        .groupBy("band", "key", "pop", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stash(tiles.where((F.size("fps") > 1) | (F.col("pop") >= 0)))
    none = F.lit(None).cast("array<long>")
    alone = tiles.where("pop < 0").select("fps", none.alias("others"))
    large = tiles.where("pop >= 0")
    left = large.withColumn("salt", F.pmod(F.xxhash64("pop", "part"), F.lit(salts)).cast("int"))
    right = large.select("band", "key", F.col("pop").alias("pop2"), F.col("part").alias("part2"), F.col("fps").alias("fps2"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    later = (F.col("pop2") > F.col("pop")) | ((F.col("pop2") == F.col("pop")) & (F.col("part2") >= F.col("part")))
    same = (F.col("pop2") == F.col("pop")) & (F.col("part2") == F.col("part"))
    paired = left.join(right, ["band", "key", "salt"]).where(later & (F.col("pop2") - F.col("pop") <= radius))
    pairs = alone.unionByName(paired.select("fps", F.when(~same, F.col("fps2")).alias("others")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = lambda x: x.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for batch in batches:
            found = [tile_links(view(a), view(b) if b.is_valid else None, radius) for a, b in zip(batch.column(0), batch.column(1))]
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def _classes(own: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, row, fp, run): a row per fingerprint and run; and (fp, root, least), its component and the least row of it all.

    ``least`` has the smallest id (null ids last) and, among rows that repeat it, the first row.
    """
    by_run = own.groupBy("fp", "run").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))).alias("least"))
    classes = stash(by_run.groupBy("fp").agg(F.min("least").alias("least")))
    member = star_components(near_links(classes.select("fp"), radius))
    return by_run, classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _fingerprinted(rows: DataFrame, row: str, runs: int | None) -> DataFrame:
    own = stash(fingerprints(rows, row))
    return own.withColumn("run", F.pmod(F.xxhash64("doc_id", "row"), F.lit(runs or spread(own.count()))).cast("int"))


def simhash_components(docs: DataFrame, radius: int = RADIUS, runs: int | None = None) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links.

    Equal fingerprints are one class with its smallest id, so copies are never
    paired. Class verdicts go back to documents by fingerprint and run, so a
    fingerprint that a third of all documents share is spread over ``runs``, which
    grow with the rows unless given.
    Null and empty texts have fingerprint zero and link like any other. A null
    id is never the smallest unless its component has no other. Rows that
    repeat an id share its component; an empty table gives an empty one. Very
    long texts are read whole; only doc_id and text are read, so other columns
    cannot clash.
    """
    own = _fingerprinted(*numbered(docs.select("doc_id", "text")), runs)
    by_run, linked = _classes(own, radius)
    least = linked.groupBy("root").agg(F.min("least").getField("doc_id").alias("component_id"))
    verdicts = linked.join(least, "root").select("fp", "component_id")
    down = by_run.select("fp", "run").join(verdicts, "fp")
    return own.join(down, ["fp", "run"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, runs: int | None = None) -> DataFrame:
    """Of each component the one row with the smallest doc_id (null ids last), with its columns as they are.

    Rows are numbered and written to the shared folder first, so that a verdict
    finds its very row, whatever ids repeat.
    """
    rows, row = numbered(docs)
    rows = stash(rows)
    _, linked = _classes(_fingerprinted(rows, row, runs), radius)
    kept = linked.groupBy("root").agg(F.min("least").getField("row").alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
