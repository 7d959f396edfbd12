"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three machines are compiled from a model file and composed with a text.

* The normaliser copies every character, writes a space as U+2581 and, before
  the first, one more.
* The pieces are a trie: states with an arc per character, and final states that
  write the piece's id with a weight and go back to the start. A character that
  no piece begins with or is has an arc that writes its UTF-8 bytes as byte
  pieces.
* The third machine remembers the last piece. In a merge model a piece sequence
  is the model's own exactly if no adjacent two would have been merged
  differently on their own: the arc from piece a to piece b weighs one if
  merging their text ends in a and b, and infinity if not. In a unigram model
  every piece may follow every other, and a piece weighs its negative score.

The encoding is the path of least weight in the tropical semiring (where two
paths of a unigram model weigh the same, the first one found). States of the
composition are (place in the text, last piece) and are made as they are
reached; every arc goes forward in the text, so relaxing the places in order
finds the path. In a merge model at most one path of finite weight leads to a
place, and in a unigram model the last piece does not matter, so a place needs
one state only: the work is the text's length times the arcs of a place. Tests
compare it with a relaxation that keeps all states.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tamis.llm.text import slices

SPACE = "▁"
INFINITY = float("inf")


class Words(dict):
    """Ids of words after ``mark``, computed on demand; words not used lately are forgotten."""

    def __init__(self, owner: Transducer, mark: str, most: int):
        super().__init__()
        self.owner, self.mark, self.most, self.before = owner, mark, most, {}

    def __missing__(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            out = self.owner._packed(self.owner.shortest_path(self.mark + word))
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[word] = out
        return out


class PieceTrie:
    """The machine of pieces, read from their ends: ``arcs[state]`` by character, ``final[state]`` the piece read there with its weight."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[tuple[str, float] | None] = [None]

    def add(self, piece: str, weight: float) -> None:
        state = 0
        for c in reversed(piece):
            after = self.arcs[state].get(c)
            if after is None:
                after = self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
                self.final.append(None)
            state = after
        self.final[state] = (piece, weight)


class Transducer:
    def __init__(self, model: bytes, most: int = 160_000, most_arcs: int = 1_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm, kind = spec.normalizer_spec, spec.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kind.treat_whitespace_as_suffix:
            raise ValueError("only normalisers that copy characters and mark spaces are compiled")
        if kind.model_type not in (kind.BPE, kind.UNIGRAM) or not kind.byte_fallback:
            raise ValueError("only merge and unigram models with byte fallback are compiled")
        if any(p.type == p.USER_DEFINED for p in spec.pieces):
            raise ValueError("pieces that users define are not compiled")
        self.merges = kind.model_type == kind.BPE
        #: The normaliser's arcs: what it writes before the first character, and for each it does not copy.
        self.before_first, self.written_for = SPACE if norm.add_dummy_prefix else "", {" ": SPACE}
        self.marks = str.maketrans(self.written_for)
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte_ids = np.zeros(256, np.int64)
        self.written: list[bytes] = []
        self.trie = PieceTrie()
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.written.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i):
                self.written.append(b"")
            else:
                self.ids[piece], self.rank[piece] = i, -library.get_score(i)
                self.written.append(piece.replace(SPACE, " ").encode())
                self.trie.add(piece, 1.0 if self.merges else -library.get_score(i))
        #: Fixed value of unigram models: a character without a piece weighs this much more than the heaviest piece.
        self.fallback = 1.0 if self.merges else max(self.rank.values(), default=0.0) + 10.0
        self.is_byte = np.zeros(len(self.written), bool)
        self.is_byte[self.byte_ids] = True
        self.kind = np.dtype("<u2") if len(self.written) <= 1 << 16 else np.dtype("<u4")
        # where no piece has a space mark after another character, and none has a line break, texts can be cut there
        self.cut_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut_at_break = not any("\n" in p for p in self.ids)
        self.spaced, self.bare = Words(self, SPACE, most), Words(self, "", most // 3)
        self.follows: dict[str, dict[str, float]] = {}
        self.n_arcs, self.most_arcs = 0, most_arcs
        self.line_break = self._packed(["\n"])

    def merged(self, text: str) -> list[str]:
        """The merges themselves, on a short text: the best-ranked adjacent two first, leftmost of equals."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = INFINITY, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1], INFINITY)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def following(self, a: str, b: str) -> float:
        """The weight of the third machine's arc from piece a to piece b: 0 or infinity; a is empty at the start."""
        return 0.0 if not self.merges or self.merged(a + b) == ([a, b] if a else [b]) else INFINITY

    def shortest_path(self, text: str) -> list[str]:
        """The pieces (or single characters without one) along the path of least weight.

        Each place takes the best of the arcs that lead to it, shortest first;
        in a merge model the first of finite weight is the only one. Arcs of
        the third machine are made when a path first asks for them and kept by
        the piece they leave, at most ``most_arcs`` of them.
        """
        n, trie, final, merges, follows, fallback = len(text), self.trie.arcs, self.trie.final, self.merges, self.follows, self.fallback
        least, came_by, known_at = [0.0] + [INFINITY] * n, [""] * (n + 1), [None] * (n + 1)
        for end in range(1, n + 1):
            state, at = 0, end
            while at:
                at -= 1
                state = trie[state].get(text[at]) if state is not None else None
                if state is not None and final[state] is not None:
                    piece, own = final[state]
                elif at == end - 1:  # byte fallback
                    piece, own = text[at], fallback
                elif state is None:
                    break
                else:
                    continue
                total = least[at] + own
                if total >= least[end]:
                    continue
                if merges:
                    known = known_at[at]
                    if known is None:
                        known = known_at[at] = follows.setdefault(came_by[at], {})
                    weight = known.get(piece)
                    if weight is None:
                        weight = known[piece] = self.following(came_by[at], piece)
                        self.n_arcs += 1
                    if weight == INFINITY:
                        continue
                    least[end], came_by[end] = total, piece
                    break
                least[end], came_by[end] = total, piece
        if self.n_arcs > self.most_arcs:
            self.follows, self.n_arcs = {}, 0
        path, at = [], n
        while at:
            path.append(came_by[at])
            at -= len(came_by[at])
        return path[::-1]

    def _packed(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += self.byte_ids[list(p.encode("utf-8", "surrogatepass"))].tolist()
        return self.pack(*out) if len(out) < 64 and self.kind.itemsize == 2 else np.array(out, self.kind).tobytes()

    @staticmethod
    def pack(*ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as the bytes of an array of ``kind``."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.cut_at_space or not self.before_first:
            return self._packed(self.shortest_path(self.before_first + text.translate(self.marks)))
        spaced, bare = self.spaced, self.bare
        out = []
        for k, line in enumerate(text.split("\n") if self.cut_at_break else [text]):
            words = line.split(" ")
            if "" not in words:
                if k:
                    out.append(bare[words[0]] + b"".join([spaced[w] for w in words[1:]]))
                else:
                    out.append(b"".join([spaced[w] for w in words]))
            else:
                marked = ("" if k else SPACE) + line.replace(" ", SPACE)
                runs = re.findall(f"^[^{SPACE}]+|{SPACE}+[^{SPACE}]*", marked)
                out.append(b"".join([self._packed(self.shortest_path(r)) for r in runs]))
        return self.line_break.join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of an id sequence: pieces and bytes joined, space marks as spaces, the one in front dropped."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.before_first and text.startswith(" ") else text


_machines: dict[int, Transducer] = {}


def machine(model: bytes) -> Transducer:
    """One per Python worker, so that its words serve later tasks."""
    key = zlib.crc32(model)
    if key not in _machines:
        _machines.clear()
        _machines[key] = Transducer(model)
    return _machines[key]


def _model(spark: SparkSession, file: str):
    with open(file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _with_columns(docs: DataFrame, model_file: str, fields: list[StructField], compute) -> DataFrame:
    """``docs`` with what ``compute(machine, texts)`` gives for the column ``text``, a few MB of text at a time (null: empty).

    Columns of the new names are replaced.
    """
    shared = _model(docs.sparkSession, model_file)
    names = [f.name for f in fields]
    docs = docs.select([c for c in docs.columns if c not in names])
    place = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(shared.value)
        for batch in batches:
            for part in slices(batch, place):
                texts = [t or "" for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(own, texts)], schema.names)

    return docs.mapInArrow(run, schema)


def _comes_back(own: Transducer, texts: list[str], ids: list[bytes]) -> list[bool]:
    return [t.replace(SPACE, " ") == own.decode(np.frombuffer(x, own.kind).tolist()) for t, x in zip(texts, ids)]


def encode_pieces(docs: DataFrame, model_file: str, verify: bool = False) -> DataFrame:
    """``docs`` with ``piece_ids``, the ids of each whole text (null and empty: none).

    With ``verify`` the ids are decoded where they are made, and ``round_trip``
    says whether that gave the text back; a space mark U+2581 in a text comes
    back as a space. Columns of these names are replaced. Rows are taken each
    for itself, so repeated rows and null ids need no rule.
    """
    fields = [StructField("piece_ids", ArrayType(IntegerType()))] + [StructField("round_trip", BooleanType())] * verify

    def encode(own: Transducer, texts: list[str]) -> list[pa.Array]:
        found = [own.encode(t) for t in texts]
        ends = np.cumsum([0, *map(len, found)]) // own.kind.itemsize
        ids = np.frombuffer(b"".join(found), own.kind).astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
        return [*out, pa.array(_comes_back(own, texts, found), pa.bool_())] if verify else out

    return _with_columns(docs, model_file, fields, encode)


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` with ``piece_text``, the text that ``piece_ids`` spell (null ids: null)."""
    shared = _model(encoded.sparkSession, model_file)
    encoded = encoded.select([c for c in encoded.columns if c != "piece_text"])
    place = encoded.columns.index("piece_ids")
    schema = StructType([*encoded.schema.fields, StructField("piece_text", StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(shared.value)
        for batch in batches:
            texts = [own.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(decode, schema)


def piece_summary(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 (of the ids as unsigned 32-bit), round_trip, from encoding and decoding each text.

    round_trip says that decoding gave the text back; a text that holds the
    space mark U+2581 itself comes back with a space there. One pass: the ids
    never leave the task that made them.
    """
    fields = [StructField(c, LongType()) for c in ("n_tokens", "n_byte_tokens", "ids_crc32")] + [StructField("round_trip", BooleanType())]

    def summary(own: Transducer, texts: list[str]) -> list[pa.Array]:
        found = [own.encode(t) for t in texts]
        ids = [np.frombuffer(x, own.kind) for x in found]
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([int(own.is_byte[x].sum()) for x in ids], pa.int64()),
            pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
            pa.array(_comes_back(own, texts, found), pa.bool_()),
        ]

    return _with_columns(docs.select("doc_id", "text"), model_file, fields, summary).drop("text")
