"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` long, each node with the
counts of the symbols that follow. A symbol is coded in the longest context
known; where it has not been seen there, an escape goes to the next shorter
context, in which the symbols of the longer one are excluded (method C: as many
escapes as distinct symbols). Below the empty context all symbols not yet
excluded are equally likely. One symbol ends each text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.text import chunks, fold_column, slices
from tamis.shared import numbered, stash

ORDER = 5
DEPTH = ORDER + 1
BITS = 9
SYMBOLS = 257  # 256 bytes and the end
END = 257  # codes are symbol + 1; 0 pads
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# --- symbols ------------------------------------------------------------------------------------


def symbol_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts, lower-cased and ended, one after another, and each symbol's place in its text."""
    joined = np.frombuffer(b"".join(t.translate(LOWER) + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    joined[ends - 1] = END
    return joined, np.arange(len(joined)) - np.repeat(ends - lengths, lengths)


def symbol_keys(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each symbol's key: up to ORDER codes before it in its text, then its own; zeros where the text has none."""
    n = len(codes)
    padded = np.concatenate([np.zeros(ORDER, np.int64), codes])
    keys = np.zeros(n, np.int64)
    for k in range(DEPTH):
        keys = (keys << BITS) | padded[k : k + n]
    early = np.flatnonzero(at < ORDER)
    keys[early] &= (np.int64(1) << (BITS * (at[early] + 1))) - 1
    return keys


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of DEPTH codes from every place of every text (padded past its end) and their counts."""
    codes, at = symbol_codes(texts)
    padded = np.concatenate([codes, np.zeros(DEPTH, np.int64)])
    keys, open_ = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
    for k in range(DEPTH):
        own = padded[k : k + len(codes)]
        if k:
            open_ &= padded[k - 1 : k - 1 + len(codes)] != END
        keys = (keys << BITS) | np.where(open_, own, 0)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of all runs in all texts of ``docs``: summed per task, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        for batch in batches:
            texts = _texts(batch.column(0))
            for a, b in chunks(texts):
                held.append(grams_of(texts[a:b]))
                if sum(len(k) for k, _ in held) > 3_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["key", "n"])

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def trie_nodes(grams: DataFrame) -> DataFrame:
    """(depth, key, n): every context with a symbol after it, of every length, with its count."""
    prefixes = F.transform(
        F.sequence(F.lit(1), F.lit(DEPTH)), lambda d: F.struct(d.alias("depth"), F.call_function("shiftright", F.col("key"), (DEPTH - d) * BITS).alias("key"))
    )
    each = grams.select(F.explode(prefixes).alias("p"), "n").select("p.depth", "p.key", "n")
    return each.where(F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)) > 0).groupBy("depth", "key").agg(F.sum("n").alias("n"))


# --- the trie on one machine --------------------------------------------------------------------


class Trie:
    """Nodes as sorted arrays per depth, with what coding needs.

    They are all nodes or a slice of them. A slice holds some contexts and all
    their ends, so the chain of shorter contexts from any context stays inside.
    """

    def __init__(self, depth: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.keys, self.n, self.table = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], None
        for d in range(1, DEPTH + 1):
            own = depth == d
            order = np.argsort(key[own])
            self.keys.append(key[own][order])
            self.n.append(n[own][order])
        # per context of length k: symbols after it, kinds of them, and the next shorter context's count of those kinds
        self.contexts, self.total, self.kinds, self.shorter = [], [], [], []
        for k in range(DEPTH):
            child, count = self.keys[k + 1], self.n[k + 1]
            contexts, parent = np.unique(child >> BITS, return_inverse=True)
            size = len(contexts)
            self.contexts.append(contexts)
            self.total.append(np.bincount(parent, count, size))
            self.kinds.append(np.bincount(parent, minlength=size))
            if k:
                in_shorter = self.n[k][_index(self.keys[k], child & ((1 << (BITS * k)) - 1))]
                self.shorter.append(np.bincount(parent, in_shorter, size))
            else:
                self.shorter.append(np.zeros(size))

    def _hash_longest(self) -> None:
        """An open-addressed table from the deepest nodes to their log probability; most symbols need no more."""
        keys, n = self.keys[DEPTH], self.n[DEPTH]
        bits = max(10, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        parent = _index(self.contexts[ORDER], keys >> BITS)
        logp = np.log10(n / (self.total[ORDER] + self.kinds[ORDER])[parent]) if len(keys) else np.zeros(0)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.table[at[left]] == -1
            self.table[at[left[free]]] = keys[left[free]]  # the last of several wins
            done = self.table[at[left]] == keys[left]
            self.value[at[left[done]]] = logp[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def log10p(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol."""
        if self.table is None:
            self._hash_longest()
        keys = symbol_keys(codes, at)
        out = np.zeros(len(keys))
        todo = np.flatnonzero(at >= ORDER)
        slot = self._slot(keys[todo])
        rest = [np.flatnonzero(at < ORDER)]
        while len(todo):
            held = self.table[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.value[slot[hit]]
            rest.append(todo[held == -1])
            go = ~hit & (held != -1)
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        rest = np.concatenate(rest)
        out[rest] = self.log10p_of(keys[rest])
        return out

    def log10p_of(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol given by its key."""
        longest = np.searchsorted([1 << BITS * k for k in range(1, DEPTH)], keys, "right")
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        gone, gone_kinds = np.zeros(len(keys)), np.zeros(len(keys))  # excluded from the present context
        for k in range(ORDER, -1, -1):
            i = np.flatnonzero(open_ & (longest >= k))
            if not len(i):
                continue
            context = _index(self.contexts[k], (keys[i] >> BITS) & ((1 << (BITS * k)) - 1))
            i, context = i[context >= 0], context[context >= 0]
            total, kinds = self.total[k][context] - gone[i], self.kinds[k][context] - gone_kinds[i]
            node = _index(self.keys[k + 1], keys[i] & ((1 << (BITS * (k + 1))) - 1))
            hit = node >= 0
            out[i[hit]] += np.log10(self.n[k + 1][node[hit]] / (total + kinds)[hit])
            open_[i[hit]] = False
            miss = ~hit & (kinds > 0)
            out[i[miss]] += np.log10(kinds[miss] / (total + kinds)[miss])
            i, context = i[~hit], context[~hit]
            gone[i], gone_kinds[i] = self.shorter[k][context], self.kinds[k][context]
        i = np.flatnonzero(open_)
        out[i] -= np.log10(SYMBOLS - gone_kinds[i])
        return out


def _index(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted array; -1 if absent."""
    if not len(own):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[at] == keys, at, -1)


class Sent:
    """A trie's nodes as they are sent; each worker builds the trie from them once."""

    def __init__(self, *nodes: np.ndarray):
        self.nodes, self.built = nodes, None

    def trie(self) -> Trie:
        if self.built is None:
            self.built = Trie(*self.nodes)
        return self.built


# --- the trie in slices -------------------------------------------------------------------------


PAIR = (1 << 2 * BITS) - 1
LAST = (1 << BITS) - 1


class Slices:
    """Which slice codes a symbol: it goes by the last two codes of the context, or by three where a pair has too many nodes.

    ``first`` has a slice per pair, or -1 - j where row j of ``second`` has one
    per third code. Contexts shorter than that are coded in any slice: all hold
    the nodes of depth 1 and 2, and a divided pair's slices its nodes of depth 3.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, count: int):
        self.first, self.second, self.count = first, second, count

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = self.first[(keys >> BITS) & PAIR]
        split = np.flatnonzero(out < 0)
        out[split] = self.second[-1 - out[split], (keys[split] >> 3 * BITS) & LAST]
        return out

    def deal(self, depth: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the node, slice) for every slice that holds a node."""
        pair = self.first[(key >> BITS) & PAIR]
        everywhere, divided = depth < 3, (depth == 3) & (pair < 0)
        own = np.flatnonzero(~everywhere & ~divided)
        places, dealt = [own], [self.of(key[own])]
        groups = [(np.flatnonzero(everywhere), np.arange(self.count))]
        groups += [(np.flatnonzero(divided & (pair == j)), np.unique(self.second[-1 - j])) for j in np.unique(pair[divided])]
        for nodes, slices in groups:
            places.append(np.tile(nodes, len(slices)))
            dealt.append(np.repeat(slices, len(nodes)))
        return np.concatenate(places), np.concatenate(dealt)


def plan_slices(nodes: DataFrame, most: int) -> Slices:
    """As few slices, of pairs and triples in order, as keep each under about ``most`` nodes.

    The driver gets a count for each of at most 258 * 258 pairs and, for pairs
    of more than ``most`` nodes, for each code before them. A triple is not
    divided; the alphabet bounds its nodes.
    """
    context = F.shiftright("key", BITS)
    pair = context.bitwiseAND(F.lit(PAIR))
    sizes = {r["pair"]: r["count"] for r in nodes.where("depth > 2").groupBy(pair.alias("pair")).count().collect()}
    split = sorted(p for p, n in sizes.items() if n > most)
    third = F.shiftright("key", 3 * BITS).bitwiseAND(F.lit(LAST))
    counted = nodes.where("depth > 3").where(pair.isin(split)).groupBy(pair.alias("pair"), third.alias("third")).count().collect() if split else []
    items = [(p, 0, n) for p, n in sizes.items() if n <= most] + [(p, 0, 0) for p in split] + [(r["pair"], r["third"], r["count"]) for r in counted]
    first, second = np.zeros(PAIR + 1, np.int64), np.zeros((len(split), LAST + 1), np.int64)
    row = {p: j for j, p in enumerate(split)}
    at = held = 0
    for p, c, n in sorted(items):
        if held and held + n > most:
            at, held = at + 1, 0
        held += n
        if p not in row:
            first[p] = at
        elif c:
            second[row[p], c] = at
        else:
            first[p], second[row[p]] = -1 - row[p], at
    return Slices(first, second, at + 1)


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def pack_blocks(docs: DataFrame, size: int) -> DataFrame:
    """(block, payload): consecutive rows (doc_id, text, row) of about ``size`` bytes, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 20, []
        for batch in batches:
            for piece in slices(batch, 1, max(size // 8, 1)):
                held.append(piece)
                if sum(p.nbytes for p in held) >= size:
                    yield _row(block=number, payload=packed(pa.Table.from_batches(held)))
                    number, held = number + 1, []
        if held:
            yield _row(block=number, payload=packed(pa.Table.from_batches(held)))

    return docs.mapInArrow(pack, "block long, payload binary")


def unpack_blocks(blocks: DataFrame) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                yield from unpacked(payload.as_py()).to_batches()

    return blocks.select("payload").mapInArrow(unpack, "doc_id long, text string, row long")


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], pa.schema([(k, pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in values.items()]))


def _texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.large_binary())]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def block_keys(texts: list[bytes]) -> np.ndarray:
    """The distinct keys of all symbols of a block, sorted."""
    return distinct(np.concatenate([distinct(symbol_keys(*symbol_codes(texts[a:b]))) for a, b in chunks(texts, 1 << 20)]))


def looked_up(own: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The value of each key, by keys that are all in the sorted array ``own``; in order they are found much sooner."""
    order = np.argsort(keys)
    out = np.empty(len(keys), values.dtype)
    out[order] = values[np.searchsorted(own, keys[order])]
    return out


def sliced_scores(blocks: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(doc_id, row, score) of the texts of ``blocks``, by a trie of any size.

    Each block asks for its distinct keys, slice by slice. A slice's nodes meet
    what a group of blocks asks of it; groups are as large as keeps the nodes
    sent in proportion to the keys asked. The answers go back to their block in
    the order of its keys. A task holds one slice, and one block's keys or
    texts; nothing but counts passes through the driver, and every text is read
    twice, however large the trie.
    """
    slices_ = plan_slices(nodes, most)
    shared = nodes.sparkSession.sparkContext.broadcast(slices_)
    symbols = nodes.where("depth = 1").agg(F.sum("n")).first()[0]
    groups = max(1, round(symbols / (8 * slices_.count * most)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, key, n = [batch.column(k).to_numpy() for k in range(3)]
            place, part = shared.value.deal(depth, key)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, depth[place].astype(np.int64), key[place], n[place])], ["part", "depth", "key", "n"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("depth", "ascending"), ("key", "ascending")])
        key = np.diff(table["key"].to_numpy(), prepend=0)
        nodes = pa.table({"depth": table["depth"].cast(pa.int8()), "key": key, "n": table["n"]})
        return pa.Table.from_batches([_row(part=table["part"][0].as_py(), payload=packed(nodes))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = block_keys(_texts(unpacked(payload.as_py())["text"]))
                part = shared.value.of(keys)
                for p in np.unique(part).tolist():
                    yield _row(part=p, block=block, payload=packed(pa.table({"key": np.diff(keys[part == p], prepend=0)})))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            for part, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                table = unpacked(payload.as_py())
                key = np.cumsum(table["key"].to_numpy())
                if block is None:
                    trie = Trie(table["depth"].to_numpy(), key, table["n"].to_numpy())
                else:
                    yield _row(block=block, part=part, payload=trie.log10p_of(key).astype(np.float32).tobytes())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[np.ndarray] = []
        for batch in batches:
            for part, payload in zip(batch.column(1).to_pylist(), batch.column(2)):
                if part is not None:
                    answers.append(np.frombuffer(payload.as_py(), np.float32))
                    continue
                rows = unpacked(payload.as_py())
                texts = _texts(rows["text"])
                keys = block_keys(texts)
                logp = np.zeros(len(keys))
                logp[np.argsort(shared.value.of(keys), kind="stable")] = np.concatenate(answers)
                scores, answers = [], []
                for a, b in chunks(texts, 1 << 20):
                    codes, at = symbol_codes(texts[a:b])
                    scores.append(np.add.reduceat(looked_up(keys, logp, symbol_keys(codes, at)), np.flatnonzero(at == 0)))
                yield from pa.table({"doc_id": rows["doc_id"], "row": rows["row"], "score": np.concatenate(scores)}).combine_chunks().to_batches()

    dealt = nodes.select("depth", "key", "n").mapInArrow(deal, "part long, depth long, key long, n long")
    sent = dealt.groupBy("part").applyInArrow(pack, "part long, payload binary").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = blocks.mapInArrow(ask, "part long, block long, payload binary").withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    met = sent.withColumn("block", F.lit(None).cast("long")).unionByName(asked).repartition("part", "group").sortWithinPartitions("part", "group", F.col("block").asc_nulls_first())
    answered = met.select("part", "block", "payload").mapInArrow(answer, "block long, part long, payload binary")
    back = answered.unionByName(blocks.withColumn("part", F.lit(None).cast("long"))).repartition("block").sortWithinPartitions("block", F.col("part").asc_nulls_last())
    return back.select("block", "part", "payload").mapInArrow(finish, "doc_id long, row long, score double")


# --- the operator -------------------------------------------------------------------------------


def text_scores(trie: Trie, texts: list[bytes]) -> np.ndarray:
    codes, at = symbol_codes(texts)
    return np.add.reduceat(trie.log10p(codes, at), np.flatnonzero(at == 0))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all lower-cased texts of ``docs``: summed in each task, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                if text.is_valid:
                    held.update(text.as_buffer().to_pybytes().translate(LOWER).split())
                if len(held) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, most_nodes: int = 6_000_000, most_frequent: int = 100_000, block: int = 1 << 24) -> DataFrame:
    """Unigram base and PPM scores of each document; learned from those outside the held-out fold.

    Words (of the text with A-Z lower-cased) and one end per text are the
    tokens of the base score, with add-one smoothing and one unknown type. The
    ``most_frequent`` words' counts are broadcast; a text's other words meet
    their counts in a join, so no dictionary grows with the corpus and no
    frequent word meets in one task. A trie of at most ``most_nodes`` nodes is
    broadcast; a larger one is cut into slices of that size, which blocks of
    documents of about ``block`` bytes ask (see sliced_scores).

    Null texts are empty; a null id counts as the empty id text. Every row is
    scored for itself, also where an id repeats. Very long texts are read
    whole; only doc_id and text are read. An empty table gives an empty one,
    and without training rows every symbol is as likely.
    """
    spark = docs.sparkSession
    docs, row = numbered(docs.select("doc_id", "text"))
    train = docs.where(fold_column(F.col("doc_id"), folds) != held_out)
    counts = stash(word_counts(train))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    n, v = (total["n"] or 0) + ends, total["v"] + (1 if ends else 0)
    frequent = counts.orderBy(F.desc("n"), "word").limit(most_frequent).toArrow()
    frequent = dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist()))
    shared = spark.sparkContext.broadcast(frequent)
    least = min(frequent.values()) if len(frequent) == most_frequent else 0
    rare = counts.where(F.col("n") <= least)
    nodes = stash(trie_nodes(gram_counts(train)))
    docs, whole, trie = docs.select("doc_id", "text", F.col(row).alias("row")), nodes.count() <= most_nodes, None
    if whole:
        table = nodes.select(F.col("depth").cast("byte"), "key", "n").toArrow()
        trie = spark.sparkContext.broadcast(Sent(*[table.column(k).to_numpy() for k in range(3)]))
    else:
        blocks = stash(pack_blocks(docs, block))
        docs = unpack_blocks(blocks)
    per_token = math.log10(n + v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {w: math.log10(c + 1) for w, c in shared.value.items()}
        end = math.log10(ends + 1)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = _texts(batch.column(1))
            for a, b in chunks(texts, 1 << 20):
                out_ids, out_rows, words, tf, tokens, known, base = [], [], [], [], [], [], []
                for doc_id, row, text in zip(ids[a:b], rows[a:b], texts[a:b]):
                    own = text.translate(LOWER).split()
                    hits = [x for x in map(logs.get, own) if x is not None]
                    unknown = Counter(w for w in own if w not in logs) if len(hits) < len(own) else {}
                    m = len(unknown)
                    # one row for the document under a key that is no word, one for each word not broadcast
                    out_ids += [doc_id] * (m + 1)
                    out_rows += [row] * (m + 1)
                    words += [b" %d" % row, *unknown]
                    tf += [0, *unknown.values()]
                    tokens += [len(own) + 1] + [0] * m
                    known += [len(hits) + (1 if ends else 0)] + [0] * m
                    base += [math.fsum(hits) + end] + [0.0] * m
                scores = np.zeros(len(words))
                if whole:
                    scores[np.flatnonzero(np.array(tokens) > 0)] = text_scores(trie.value.trie(), texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_ids, pa.int64()), pa.array(out_rows, pa.int64()), pa.array(words, pa.binary()), pa.array(tf, pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores)],
                    ["doc_id", "row", "word", "tf", "tokens", "known", "base", "score"],
                )

    rows = docs.mapInArrow(score, "doc_id long, row long, word binary, tf long, tokens long, known long, base double, score double")
    met = rows.join(rare.select("word", F.col("n").alias("c")), "word", "left")
    parts = met.select(
        "doc_id",
        "row",
        "tokens",
        (F.col("known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"),
        "score",
    )
    if not whole:
        zero = {c: F.lit(0).cast(parts.schema[c].dataType) for c in ("tokens", "known", "base")}
        parts = parts.unionByName(sliced_scores(blocks, nodes, most_nodes).withColumns(zero))
    summed = parts.groupBy("doc_id", "row").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")])
    return summed.select(
        "doc_id",
        (fold_column(F.col("doc_id"), folds) == held_out).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * per_token).alias("base_score"),
        "score",
    )
