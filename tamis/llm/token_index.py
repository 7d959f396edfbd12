"""Token-id shards on disk with a minimal perfect hash from document key to offset.

A shard file holds, in this order, the ids of its documents back to back and
the tables that find them; a fixed-size tail at the end says how large each is.

    payload   ids, little-endian, 2 bytes each (4 if the vocabulary needs it)
    starts    int64 per document and one more: first id, counted in ids
    seeds     int32 per bucket: the displacement, or -1 - slot for a bucket of one key
    slots     uint32 per key: the document's place in payload order
    rows      uint32 per key: how many documents, from that place on, have it
    prints    uint32 per key: a fingerprint of the key, by which unknown keys are refused
    tail      magic, id width, documents, ids, keys, buckets, documents without a key

Documents without a key come first. A lookup hashes the key, reads one seed,
one slot and one fingerprint, and then two starts and the ids between them.
The manifest, a Parquet table in the same folder, names the files that count.
"""

from __future__ import annotations

import json
import os
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.text import slices

MAGIC = b"TAMISIDX"
TAIL = struct.Struct("<8sQQQQQQ")
M64 = (1 << 64) - 1


# --- hashing -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def displaced(h: np.ndarray, seed: int | np.ndarray, n: int) -> np.ndarray:
    seeds = np.asarray(seed, dtype=np.uint64)
    return mix(h ^ (seeds * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)


def prints_of(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)


def build_mph(keys: np.ndarray, per_bucket: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slot of each key) for distinct int64 keys: as many slots as keys.

    Large buckets are placed first, each by the smallest displacement under
    which its keys fall on free slots. Buckets of one key come last and name
    one of the slots that are left.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h = mix(keys.view(np.uint64))
    buckets = -(-n // per_bucket)
    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket.astype(np.int64), minlength=buckets)
    ends = np.cumsum(sizes)
    seeds, slot, taken = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = order[ends[b] - sizes[b] : ends[b]]
        hs, first = h[own], 1
        while True:
            # many displacements at a time: the load near the end asks for hundreds
            tried = displaced(hs[None, :], np.arange(first, first + 64)[:, None], n).astype(np.int64)
            good = ~taken[tried].any(axis=1)
            ordered = np.sort(tried, axis=1)
            good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slot[own] = first + k, tried[k]
                taken[tried[k]] = True
                break
            first += 64
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)[: len(single)]
    seeds[single] = -1 - free
    slot[order[ends[single] - 1]] = free
    return seeds, slot


# --- a shard ------------------------------------------------------------------------------------


class ShardWriter:
    """Streams ids to a file, keys in ascending order and null ones first, and ends it with the index."""

    def __init__(self, out, width: int):
        self.out, self.width, self.keys, self.lengths, self.n_ids = out, width, [], [], 0

    def add(self, keys: list[int | None], ids: list[bytes]) -> None:
        self.out.write(b"".join(ids))
        self.keys += keys
        self.lengths += [len(x) // self.width for x in ids]
        self.n_ids += sum(map(len, ids)) // self.width

    def close(self) -> dict:
        n, nameless = len(self.keys), sum(k is None for k in self.keys)
        keys = np.array(self.keys[nameless:], np.int64)
        starts = np.zeros(n + 1, np.int64)
        np.cumsum(self.lengths, out=starts[1:])
        distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
        seeds, slot = build_mph(distinct)
        slots, counts, prints = (np.zeros(len(distinct), np.uint32) for _ in range(3))
        slots[slot], counts[slot], prints[slot] = nameless + first, rows, prints_of(mix(distinct.view(np.uint64)))
        for table in (starts, seeds, slots, counts, prints):
            self.out.write(table.tobytes())
        self.out.write(TAIL.pack(MAGIC, self.width, n, self.n_ids, len(distinct), len(seeds), nameless))
        self.out.close()
        bounds = [int(distinct[0]), int(distinct[-1])] if len(distinct) else [None, None]
        return dict(zip(("n_docs", "n_ids", "n_nameless", "first_key", "last_key"), (n, self.n_ids, nameless, *bounds)))


class Shard:
    """An open shard file: its tables in memory, its ids read where they are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(max(size - TAIL.size, 0))
        end = file.read(TAIL.size)
        if len(end) < TAIL.size or end[:8] != MAGIC:
            raise ValueError("not a token shard")
        _, self.width, self.n, n_ids, keys, buckets, self.nameless = TAIL.unpack(end)
        at = n_ids * self.width
        file.seek(at)
        tables, at = file.read(size - TAIL.size - at), 0
        self.starts, self.seeds, self.slots, self.rows, self.prints = [], [], [], [], []
        for name, kind, count in (("starts", "<i8", self.n + 1), ("seeds", "<i4", buckets), ("slots", "<u4", keys), ("rows", "<u4", keys), ("prints", "<u4", keys)):
            table = np.frombuffer(tables, kind, count, at)
            setattr(self, name, table)
            at += table.nbytes

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, rows) of each key in constant time; no rows where the shard does not have it."""
        if not len(self.seeds):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        h = mix(keys.view(np.uint64))
        seeds = self.seeds[((h >> np.uint64(32)) % np.uint64(len(self.seeds))).astype(np.int64)].astype(np.int64)
        slot = np.where(seeds < 0, np.minimum(-1 - seeds, len(self.slots) - 1), displaced(h, np.maximum(seeds, 0), len(self.slots)).astype(np.int64))
        known = self.prints[slot] == prints_of(h)
        return np.where(known, self.slots[slot], 0).astype(np.int64), np.where(known, self.rows[slot], 0).astype(np.int64)

    def ids(self, places: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) for ascending places, neighbours by one read of up to about ``most`` ids."""
        k = 0
        while k < len(places):
            last = k
            while last + 1 < len(places) and places[last + 1] == places[last] + 1 and self.starts[places[last + 1] + 1] - self.starts[places[k]] <= most:
                last += 1
            begin, end = int(self.starts[places[k]]), int(self.starts[places[last] + 1])
            self.file.seek(begin * self.width)
            held = np.frombuffer(self.file.read((end - begin) * self.width), f"<u{self.width}")
            for place in places[k : last + 1].tolist():
                yield place, held[self.starts[place] - begin : self.starts[place + 1] - begin]
            k = last + 1


# --- encoding -----------------------------------------------------------------------------------


def _byte_alphabet() -> list[str]:
    """The character by which a byte-level model writes each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class CachedBpe:
    """Byte-level BPE by the tokenizers library, remembering the ids of words.

    The pre-tokenizer never joins the text before a single space or line break
    with the text after it, if neither side is white space itself. So a text is
    cut there, each piece keeping the line break before it, and each distinct
    piece is encoded by the library once. A text with a piece that starts or
    ends with white space, or is empty, goes to the library whole. Where the
    pre-tokenizer cuts between a letter and a stop after it, the ids of a word
    and of its stops are looked up each for itself.
    """

    STOPS = ",.;:!?"

    def __init__(self, definition: str, width: int, most: int = 400_000, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = special_as_text
        self.kind, self.most = np.dtype(f"<u{width}"), most
        spec = json.loads(definition)
        cutter = spec.get("pre_tokenizer") or {}
        self.cuts_stops = spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
        alphabet = _byte_alphabet()
        self.one_piece = self.cuts_stops and not cutter.get("add_prefix_space") and (spec.get("model") or {}).get("type") == "BPE" and not spec["model"].get("end_of_word_suffix")
        self.space, self.byte_table = alphabet[32], {b: c for b, c in enumerate(alphabet) if b > 127}
        self.late: dict[str, bytes] = {}  # pieces of late, and before that
        self.early: dict[str, bytes] = {}
        self.line_break = self._encoded(["\n"])[0]
        self.break_id = int(np.frombuffer(self.line_break, self.kind)[0])

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of many pieces by one call: in a text with a piece per line, each line break is an id of its own."""
        ids = np.array(self.library.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(ids == self.break_id)
        if len(ends) != len(words) - 1:
            return self._encoded(words)
        raw, width = ids.tobytes(), self.kind.itemsize
        return [raw[i:j] for i, j in zip([0, *(width * (ends + 1)).tolist()], [*(width * ends).tolist(), len(raw)])]

    def _learn(self, names: list[str]) -> list[bytes]:
        """The ids of pieces; one that starts with a line break holds its id, and none are given for one that needs its surroundings."""
        if len(self.late) > self.most:
            self.late, self.early = {}, self.late
        late, early = self.late, self.early
        out = list(map(late.get, names))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            x = early.get(names[i])
            if x is None:
                new.append(i)
            else:
                late[names[i]] = out[i] = x
        if not new:
            return out
        own = pa.array([names[i] for i in new], pa.large_string())
        body = pc.if_else(pc.starts_with(own, "\n"), pc.utf8_slice_codeunits(own, 1), own)
        ends = pc.or_(pc.utf8_is_space(pc.utf8_slice_codeunits(body, 0, 1)), pc.utf8_is_space(pc.utf8_slice_codeunits(body, -1)))
        by_library = pc.or_(ends, pc.equal(pc.binary_length(body), 0)).to_numpy(zero_copy_only=False)
        stems = pc.utf8_rtrim(own, self.STOPS) if self.cuts_stops else own
        stopped = pc.and_(pc.not_equal(stems, own), pc.utf8_is_alnum(pc.utf8_slice_codeunits(stems, -1))).to_numpy(zero_copy_only=False)
        words = pc.if_else(pa.array(stopped), stems, own).to_numpy(zero_copy_only=False)
        asked = [w for w in dict.fromkeys(words[~by_library].tolist()) if w not in late]
        if self.one_piece:
            # the pre-tokenizer keeps a word of letters whole, so the model can have it at once
            letters = pc.utf8_is_alpha(pc.utf8_ltrim(pa.array(asked, pa.large_string()), "\n")).to_pylist()
            alone = [w for w, x in zip(asked, letters) if x]
            asked = [w for w, x in zip(asked, letters) if not x]
            model, space, table, kind = self.library.model.tokenize, self.space, self.byte_table, self.kind
            for w in alone:
                body = w if w.isascii() else w.encode().decode("latin-1").translate(table)
                if w[0] == "\n":
                    late[w] = self.line_break + np.array([t.id for t in model(body[1:])], kind).tobytes()
                else:
                    late[w] = np.array([t.id for t in model(space + body)], kind).tobytes()
        for k in range(0, len(asked), 20_000):
            part = asked[k : k + 20_000]
            for w, ids in zip(part, self._pieces([w[1:] if w[0] == "\n" else " " + w for w in part])):
                late[w] = self.line_break + ids if w[0] == "\n" else ids
        for i in np.array(new)[by_library].tolist():
            late[names[i]] = b""
        places = np.flatnonzero(stopped & ~by_library).tolist()
        stops = [names[new[k]][len(words[k]) :] for k in places]
        tails = list(dict.fromkeys(stops))
        tails = dict(zip(tails, self._encoded(tails)))
        for k, stop in zip(places, stops):
            late[names[new[k]]] = late[words[k]] + tails[stop]
        for i in new:
            out[i] = late[names[i]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; call it with a few MB of text at a time."""
        if not texts:
            return []
        marked = pc.replace_substring(pa.array(["\n" + t for t in texts], pa.large_string()), "\n", " \n")
        cut = pc.split_pattern(marked, " ")
        words = cut.flatten().dictionary_encode()
        places = words.indices.to_numpy()
        own = self._learn(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.array(list(map(len, own)), np.int64) // self.kind.itemsize
        whole, table = lengths == 0, np.frombuffer(b"".join(own), self.kind)
        firsts = np.cumsum(lengths) - lengths
        # every text starts with an empty piece and the id of a line break, which are not its own
        ends = cut.offsets.to_numpy().astype(np.int64)
        first_words, after = ends[:-1] + 1, np.concatenate([[0], np.cumsum(whole[places])])
        by_library = after[ends[1:]] - after[first_words] > 0
        each = lengths[places]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = table[np.repeat(firsts[places] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
        starts, stops = (upto[first_words] + 1) * self.kind.itemsize, upto[ends[1:]] * self.kind.itemsize
        spans = zip(by_library.tolist(), texts, starts.tolist(), stops.tolist())
        return [self._encoded([text])[0] if library else ids[i:j] for library, text, i, j in spans]


_encoders: dict[int, CachedBpe] = {}


def encoder(definition: str, width: int, special_as_text: bool = False) -> CachedBpe:
    """One per Python worker, so that its words serve later tasks."""
    key = hash((definition, width, special_as_text))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = CachedBpe(definition, width, special_as_text=special_as_text)
    return _encoders[key]


# --- the operator -------------------------------------------------------------------------------

MANIFEST = "manifest.parquet"
MANIFEST_SCHEMA = "part long, number long, file string, n_docs long, n_ids long, n_nameless long, first_key long, last_key long"


def write_token_shards(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0, shard_ids: int = 1 << 26, special_as_text: bool = False) -> DataFrame:
    """Encodes each text and writes shard files and their manifest under ``folder``; returns the manifest.

    Documents are dealt to tasks by ranges of doc_id (null ids first, rows that
    repeat an id by a hash of their text, so that a hot id spreads too) and
    sorted within; a task starts a new file after ``shard_ids`` ids. The files
    in order hold the documents in ascending id order. Null and empty texts have
    the end id alone; very long ones are encoded whole; only doc_id and text are
    read. Special tokens' strings in a text become those tokens, as is the
    library's way, unless ``special_as_text``.

    Every attempt of a task writes files of its own names. The manifest is
    written from the attempts that count, so what a lost executor or a second
    attempt left behind is never read. An empty table gives an empty manifest.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else 4
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        bpe = encoder(shared.value, width, special_as_text)
        end = np.array([end_id], bpe.kind).tobytes()
        where, base = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        writer, name, number = None, "", 0

        def closed() -> pa.RecordBatch:
            row = {"part": part, "number": number, "file": name, **writer.close()}
            return pa.RecordBatch.from_pylist([row], kinds)

        kinds = pa.schema([(c, pa.string() if c == "file" else pa.int64()) for c in ("part", "number", "file", "n_docs", "n_ids", "n_nameless", "first_key", "last_key")])
        for batch in batches:
            for rows in slices(batch, 1, min(1 << 21, 4 * shard_ids)):
                if writer is None:
                    where.create_dir(base, recursive=True)
                    name = f"shard-{part:06d}-{number:04d}-{attempt}.tok"
                    writer = ShardWriter(where.open_output_stream(posixpath.join(base, name)), width)
                writer.add(rows.column(0).to_pylist(), [x + end for x in bpe.encode([t or "" for t in rows.column(1).to_pylist()])])
                if writer.n_ids >= shard_ids:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    order = ["doc_id", "_said"]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("_said")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("doc_id", "text").mapInArrow(write, MANIFEST_SCHEMA).write.parquet(f"{folder}/{MANIFEST}")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")


def _looked_up(keys: DataFrame, folder: str, schema: str, each) -> DataFrame:
    """What ``each`` makes of (doc_id, file, start, place, ids) for every row of every key, found through the shards' indexes.

    Keys go to the files whose key range holds them: the driver has the
    manifest, one short row per ``shard_ids`` ids. The keys of a file meet in
    one task (repeated ones count once), which reads the file's index and of its
    ids only what the keys name.
    """
    spark = keys.sparkSession
    files = sorted(manifest(spark, folder).collect(), key=lambda r: (r["part"], r["number"]))
    bases = np.concatenate([[0], np.cumsum([r["n_ids"] for r in files])]).tolist()
    named = [k for k, r in enumerate(files) if r["first_key"] is not None]
    nameless = [k for k, r in enumerate(files) if r["n_nameless"]]
    shared = spark.sparkContext.broadcast((np.array([files[k]["first_key"] for k in named], np.int64), np.array([files[k]["last_key"] for k in named], np.int64), named, nameless))
    listed = spark.sparkContext.broadcast([(r["file"], base) for r, base in zip(files, bases)])

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, named, nameless = shared.value
        for batch in batches:
            own = batch.column(0)
            keys = np.unique(own.drop_null().to_numpy())
            low, high = np.searchsorted(last, keys), np.searchsorted(first, keys, "right")
            counts = np.maximum(high - low, 0)
            which = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            shards = [named[k] for k in which.tolist()] + (nameless if own.null_count else [])
            found = pa.array(np.repeat(keys, counts).tolist() + [None] * (len(nameless) if own.null_count else 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), found], ["shard", "doc_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)

        def rows(number: int, keys: list[int | None]):
            file, before = listed.value[number]
            with where.open_input_file(posixpath.join(base, file)) as f:
                shard = Shard(f)
                known = np.unique(np.array([k for k in keys if k is not None], np.int64))
                places, counts = shard.places(known)
                owners = np.repeat(known, counts)
                places = np.repeat(places, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                order = np.argsort(places)
                named_rows = list(zip(places[order].tolist(), owners[order].tolist()))
                if None in keys:
                    named_rows = [(p, None) for p in range(shard.nameless)] + named_rows
                wanted = np.array([p for p, _ in named_rows], np.int64)
                yield from each(((key, file, before + int(shard.starts[p]), p, ids) for (p, key), (_, ids) in zip(named_rows, shard.ids(wanted))), number)

        number, held = None, []
        for batch in batches:
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != number:
                    if held:
                        yield from rows(number, held)
                    number, held = shard, []
                held.append(key)
        if held:
            yield from rows(number, held)

    addressed = keys.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(address, "shard long, doc_id long").distinct()
    return addressed.repartition("shard").sortWithinPartitions("shard").mapInArrow(read, schema)


def read_token_shards(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id, shard, start (over all shards), n_tokens, ids_crc32 of every document that has one of the keys ``doc_id``.

    Each document is found by its key through the index of its shard. A null
    key stands for all documents without one. Keys that no shard has give no
    row; repeated keys count once; a key that several documents have gives one
    row for each.
    """

    def digests(rows, number: int, most: int = 20_000) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], ["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

        held = []
        for key, _, start, _, ids in rows:
            held.append((key, number, start, len(ids), zlib.crc32(ids.astype("<u4"))))
            if len(held) >= most:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return _looked_up(keys, folder, "doc_id long, shard long, start long, n_tokens long, ids_crc32 long", digests)


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id, start and ids of every document that has one of the keys ``doc_id``, as read_token_shards finds them."""

    def payload(rows, number: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in held], pa.int64()), pa.array([s for _, s, _ in held], pa.int64()), pa.array([x.astype(np.int32) for _, _, x in held], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

        held, n = [], 0
        for key, _, start, _, ids in rows:
            held.append((key, start, ids))
            n += len(ids)
            if n >= most:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return _looked_up(keys, folder, "doc_id long, start long, ids array<int>", payload)
