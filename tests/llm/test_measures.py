import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tamis.llm.host_rules import fit_prior, host_quality
from tamis.llm.mixing import emit_copies, mix_sources

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_host_quality_measures(docs, odd_docs, no_docs):
    for table in (docs, odd_docs, no_docs):
        texts = defaultdict(list)
        for r in table.collect():
            texts[r["doc_id"], r["source"]].append(plain_measures(r["text"]))
        rows = host_quality(table).collect()
        assert len(rows) == sum(map(len, texts.values()))
        for r in rows:
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            texts[r["doc_id"], r["source"]].remove(got)
            assert r["kept"] == (not r["base_failed"] and r["host_ok"])


def test_a_bad_host_loses_its_good_pages(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(200)]
    rows += [(1000 + i, good, "fine") for i in range(200)]
    rows += [(2000 + i, good if i % 2 else "short", f"h{i // 2}") for i in range(40)]
    rows += [(3000, good, "lone"), (3001, good, None)]
    got = {r["doc_id"]: r for r in host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0]["kept"] and not got[0]["base_failed"]
    assert got[1000]["kept"] and got[3000]["kept"] and got[3001]["kept"]
    assert 0.5 < got[0]["too_short_rate"] <= 0.9


def test_prior_shrinks_towards_the_mean():
    alpha, beta = fit_prior(50, 100, 10, 25.0, 1000)
    assert alpha == pytest.approx(beta)
    assert fit_prior(0, 0, 0, 0, 0) == (0.5, 0.5)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, docs, odd_docs, no_docs):
    many = spark.range(3000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 7 as int)) text", "concat('s', id % 5) source")
    for table in (docs, odd_docs, no_docs, many):
        sizes = Counter()
        for r in table.collect():
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        target = plain_targets(sizes) if sizes else {}
        mixed = mix_sources(table)
        rows = mixed.collect()
        assert len(rows) == table.count()
        taken = Counter()
        for r in rows:
            assert r["size"] == len(WORD.findall(r["text"] or ""))
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(target[r["source"]])
            assert 0 <= r["n_copies"] <= 2
            taken[r["source"]] += r["size"] * r["n_copies"]
        assert sorted(map(str, rows)) == sorted(map(str, mix_sources(table).collect()))
        if table is many:
            for s, t in target.items():
                assert taken[s] == pytest.approx(t, rel=0.1)
            assert emit_copies(mixed).count() == sum(r["n_copies"] for r in rows)


def test_mixing_many_sources_joins_by_salt(spark, monkeypatch):
    monkeypatch.setattr("tamis.llm.mixing.MOST_BROADCAST", 3)
    many = spark.range(400).selectExpr("id doc_id", "repeat('w ', 5) text", "if(id % 9 = 0, null, concat('s', id % 9)) source")
    rows = mix_sources(many).collect()
    assert len(rows) == 400 and all(r["target"] is not None for r in rows)
    assert mix_sources(many.withColumn("x", F.lit(1))).columns[-4:] == ["size", "source_size", "target", "n_copies"]
