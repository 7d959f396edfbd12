import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamis.llm.catalog import op4_token_shards, tokenizer
from tamis.llm.pieces import Transducer, decode_pieces, encode_pieces, piece_summary
from tamis.llm.token_index import TAIL, CachedBpe, Shard, build_mph, lookup, read_token_shards, write_token_shards
from tamis.shared import new_folder

BPE, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def cached():
    with open(BPE, encoding="utf-8") as f:
        return CachedBpe(f.read(), 2, most=50)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def machine():
    with open(PIECES, "rb") as f:
        return Transducer(f.read(), most=50)


TEXTS = st.text(st.sampled_from(list("abt's1,.;!? \n\t\r  \u0085▁#,<é日😀")) | st.characters(exclude_categories=["Cs"]), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(TEXTS | st.just("<|endoftext|>"), max_size=3).map("".join), max_size=4))
def test_cached_bpe_is_the_library(texts):
    with open(BPE, encoding="utf-8") as f:
        global _cached, _library
        if "_cached" not in globals():
            _cached, _library = CachedBpe(f.read(), 2, most=50), Tokenizer.from_file(BPE)
    assert [np.frombuffer(x, "<u2").tolist() for x in _cached.encode(texts)] == [_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_as_text():
    with open(BPE, encoding="utf-8") as f:
        definition = f.read()
    plain = CachedBpe(definition, 2, special_as_text=True)
    assert 50256 not in np.frombuffer(plain.encode(["hello <|endoftext|> world"])[0], "<u2")
    assert np.frombuffer(CachedBpe(definition, 2).encode(["hello <|endoftext|> world"])[0], "<u2").tolist() == [31373, 220, 50256, 995]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_transducer_is_the_library(text):
    global _machine, _pieces
    if "_machine" not in globals():
        with open(PIECES, "rb") as f:
            _machine = Transducer(f.read(), most=50, most_arcs=100)
    if "_pieces" not in globals():
        _pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = np.frombuffer(_machine.encode(text), "<u2").tolist()
    assert ids == _pieces.encode(text)
    assert _machine.decode(ids) == text.replace("▁", " ")


def all_states(own, text):
    """The path of least weight through every state (place, last piece) of the composition, pieces looked up by slices."""
    states = [{} for _ in range(len(text) + 1)]
    states[0][""] = (0.0, [])
    longest = max(map(len, own.ids))
    for at in range(len(text)):
        arcs = [text[at : at + k] for k in range(1, longest + 1) if text[at : at + k] in own.ids and at + k <= len(text)]
        arcs += [text[at]] if text[at] not in arcs else []
        for last, (weight, path) in states[at].items():
            for piece in arcs:
                total = weight + 1 + own.following(last, piece)
                if total < states[at + len(piece)].get(piece, (float("inf"),))[0]:
                    states[at + len(piece)][piece] = (total, [*path, piece])
    return min(states[-1].values())[1]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_one_state_per_place_gives_the_shortest_path(text):
    global _machine
    if "_machine" not in globals():
        with open(PIECES, "rb") as f:
            _machine = Transducer(f.read(), most=50, most_arcs=100)
    marked = "▁" + text.replace(" ", "▁")
    assert _machine.shortest_path(marked) == all_states(_machine, marked)
    assert _machine.n_arcs <= 200  # a place adds some arcs before they are forgotten


def test_unigram_models(spark):
    """A made-up unigram model: the path of least weight is the library's, with and without a space in front."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = __import__("random").Random(3)
    for prefix in (True, False):
        spec = pb.ModelProto()
        spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = spec.trainer_spec.UNIGRAM, True
        spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.escape_whitespaces = "identity", prefix, False, True
        made = ["▁", "▁▁", *{("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(120)}]
        for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
            spec.pieces.add(piece=piece, score=0.0, type=kind)
        for i in range(256):
            spec.pieces.add(piece=f"<0x{i:02X}>", score=0.0, type=6)
        for piece in made:
            spec.pieces.add(piece=piece, score=-rng.uniform(1, 12), type=1)
        model = spec.SerializeToString()
        own, library = Transducer(model, most=50), sentencepiece.SentencePieceProcessor(model_proto=model)
        same = 0
        for _ in range(800):
            text = "".join(rng.choice("aaabbbccc  dé\n😀") for _ in range(rng.randrange(25)))
            ids = np.frombuffer(own.encode(text), own.kind).tolist()
            theirs = library.encode(text)
            if ids != theirs:  # only where two paths weigh the same
                weigh = lambda x: sum(library.get_score(i) for i in x)
                assert weigh(ids) == pytest.approx(weigh(theirs)) and [i for i in ids if i < 259] == [i for i in theirs if i < 259], text
            same += ids == theirs
            assert own.decode(ids) == text
        assert same > 700


def test_machines_that_are_not_compiled():
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(PIECES, "rb") as f:
        model = f.read()
    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.trainer_spec, "model_type", m.trainer_spec.WORD)):
        spec = pb.ModelProto()
        spec.ParseFromString(model)
        change(spec)
        with pytest.raises(ValueError):
            Transducer(spec.SerializeToString())


def test_shards_hold_every_document(spark, docs, odd_docs, no_docs, bpe):
    hot = spark.createDataFrame([(None if i % 3 else i % 5, f"text {i % 4}") for i in range(60)], "doc_id long, text string").repartition(3)
    for table, shard_ids in ((docs, 1 << 26), (docs, 5000), (odd_docs, 1 << 26), (odd_docs, 10), (no_docs, 10), (hot, 10)):
        folder = new_folder(spark, "test-shards")
        shards = write_token_shards(table, folder, BPE, shard_ids=shard_ids).collect()
        got = read_token_shards(table.select("doc_id"), folder).collect()
        texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in table.collect()))
        ids = {}
        for known, d, t in texts:
            ids.setdefault((known, d), []).append(np.array(bpe.encode(t, add_special_tokens=False).ids + [0], "<u4"))
        at, before = 0, None
        for r in sorted(got, key=lambda r: r["start"]):
            key = (r["doc_id"] is not None, r["doc_id"] or 0)
            assert before is None or before <= key
            before, own = key, ids[key]
            k = next(k for k, x in enumerate(own) if zlib.crc32(x.tobytes()) == r["ids_crc32"])
            assert r["start"] == at and r["n_tokens"] == len(own[k])
            at += len(own.pop(k))
        assert not any(ids.values())
        assert sum(r["n_ids"] for r in shards) == at and sum(r["n_docs"] for r in shards) == len(texts)
        if shard_ids == 5000:
            assert len(shards) > 10


def test_keyed_access(spark, docs, bpe):
    folder = new_folder(spark, "test-shards")
    write_token_shards(docs, folder, BPE, shard_ids=5000)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = [5, 17, 17, 120, -1, 10**12, None]
    found = lookup(spark.createDataFrame([(k,) for k in some], "doc_id long"), folder).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {k: bpe.encode(texts[k], add_special_tokens=False).ids + [0] for k in (5, 17, 120)} and len(found) == 3


def test_results_come_through_the_index(spark, docs):
    """A file whose fingerprints are spoilt gives no rows; files that the manifest does not name are not read."""
    import glob

    folder = new_folder(spark, "test-shards")
    (shard,) = write_token_shards(docs.limit(20), folder, BPE).collect()
    assert read_token_shards(docs.select("doc_id"), folder).count() == 20
    (path,) = glob.glob(folder.removeprefix("file:") + "/*.tok")
    with open(path, "rb") as f:
        content = bytearray(f.read())
    with open(path + ".left-behind.tok", "wb") as f:
        f.write(b"an attempt that was lost")
    assert read_token_shards(docs.select("doc_id"), folder).count() == 20
    end = len(content) - TAIL.size
    content[end - 4 * 20 : end] = bytes(x ^ 0xFF for x in content[end - 4 * 20 : end])
    with open(path, "wb") as f:
        f.write(content)
    assert read_token_shards(docs.select("doc_id"), folder).count() == 0


def test_token_query_without_documents(spark, tmp_path, no_docs):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_token_shards(spark, str(tmp_path)).collect() == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 5000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        _, slot = build_mph(keys)
        assert sorted(slot.tolist()) == list(range(len(keys)))


def test_pieces_over_tables(docs, odd_docs, no_docs, library):
    for table in (docs, odd_docs, no_docs):
        encoded = encode_pieces(table, PIECES)
        assert encoded.columns == [*table.columns, "piece_ids"]
        for r in decode_pieces(encoded, PIECES).collect():
            assert r["piece_ids"] == library.encode(r["text"] or "")
            assert r["piece_text"] == (r["text"] or "").replace("▁", " ")
        for r in piece_summary(table, PIECES).collect():
            assert r["round_trip"]
        both = encode_pieces(table, PIECES, verify=True)
        assert both.columns[-2:] == ["piece_ids", "round_trip"]
        for r in both.collect():
            assert r["piece_ids"] == library.encode(r["text"] or "") and r["round_trip"]
        assert both.count() == table.count()


def test_shard_refuses_other_files():
    with pytest.raises(ValueError):
        Shard(pa.BufferReader(b"\0" * 100))
