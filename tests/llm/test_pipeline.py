"""corpus_pipeline.run against a plain version, on rows with nulls, repeated rows and copies."""

import hashlib
import re

import sentencepiece

import corpus_pipeline
from tamis.llm import toxicity
from tamis.llm.catalog import tokenizer
from tests.llm.test_measures import plain_targets
from tests.llm.test_simhash import plain_fingerprint

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_pipeline(rows, model):
    """[(doc_id, source, n_tokens, piece_ids)] of rows (doc_id, text, source)."""
    rows = [r for r in rows if model.score(r[1]) < 0.7]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    best = {}
    for i, (_, text, _) in enumerate(rows):
        key = re.sub("[\x20\x09-\x0d]", "", text or "")
        best[key] = min(best.get(key, i), i, key=lambda j: (-len(rows[j][1] or ""), *order(j)))
    rows = [rows[i] for i in sorted(best.values())]
    fps, root = [plain_fingerprint(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    stay = {}
    for i in range(len(rows)):
        stay[find(i)] = min(stay.get(find(i), i), i, key=order)
    rows = [rows[i] for i in stay.values()]
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = plain_targets(sizes) if rows else {}
    library, out = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), []
    for doc_id, text, source in rows:
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        draw = (int(hashlib.md5(("17" if doc_id is None else f"17:{doc_id}").encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        ids = library.encode(text or "")
        out += [(doc_id, source, len(ids), ids)] * (int(rate) + (draw < rate - int(rate)))
    return sorted(out, key=str)


def test_pipeline_matches_a_plain_version(spark, docs, odd_docs, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    extra = spark.createDataFrame([(7, "same words here", "s1"), (7, "same words here", "s2"), (None, "same words here", "s1"), (None, "no other has this text", None)], "doc_id long, text string, source string")
    odd = odd_docs.select("doc_id", "text", "source", "lang").unionByName(extra.selectExpr("*", "'en' lang"))
    for k, table in enumerate((docs.select("doc_id", "text", "source", "lang").unionByName(odd), odd.where("false"))):
        folder = f"{tmp_path}/{k}"
        table.repartition(3).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        table = spark.read.parquet(f"{folder}/documents.parquet")
        model = toxicity.train_toxicity(table, labels)
        got = sorted(((r["doc_id"], r["source"], r["n_tokens"], r["piece_ids"]) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
        rows = sorted((tuple(r) for r in table.select("doc_id", "text", "source").collect()), key=str)
        want = plain_pipeline(rows, model)
        # which of rows that repeat an id or have none stays is open, and with it the source
        assert sorted(map(str, (x[3] for x in got))) == sorted(map(str, (x[3] for x in want))) or k
        assert [x for x in got if x[0] is not None and x[0] != 7] == [x for x in want if x[0] is not None and x[0] != 7]


def test_stages_keep_the_columns(spark, odd_docs):
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, odd_docs, SMALL)
        assert out.columns == odd_docs.columns, name
        assert stage(spark, odd_docs.where("false"), SMALL).count() == 0
    assert all(r["round_trip"] for r in corpus_pipeline.encode(spark, odd_docs, SMALL).collect())
