"""Passages, filters and clusters against plain versions."""

import hashlib
import math
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import centroids, filter_audit, substring_dedup
from tamis.llm.centroids import Centroids, cluster_vectors, nearest
from tamis.llm.filter_audit import RemovalPolynomial, audit_filters, audit_part, own_failures
from tamis.llm.substring_dedup import COVERS, cover_of, dedup_substrings, word_hashes

SPACE = "[\x20\x09-\x0d]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


# --- passages ------------------------------------------------------------------------------------------


def plain_passages(rows, window):
    key = lambda d, t: (d is None, d or 0, hashlib.md5((t or "").encode()).digest())
    first, out = {}, []
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, (*key(d, t), i)), (*key(d, t), i))
    for d, t in rows:
        w, gone = words_of(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (*key(d, t), i):
                gone |= set(range(i, i + window))
        out.append((d, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def test_covers_have_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    for window in range(3, 60):
        period, cover, length = cover_of(window)
        assert length >= 1 and max(range(period)) + length == window
    with pytest.raises(ValueError):
        cover_of(2)


def made_up(rng, n=70):
    passages = [[f"p{k}w{i}" for i in range(rng.integers(15, 60))] for k in range(5)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.integers(1, 6)):
            if rng.random() < 0.6:
                p = passages[rng.integers(len(passages))]
                a = rng.integers(0, 8)
                words += p[a : len(p) - rng.integers(0, 8)]
            words += [f"v{v}" for v in rng.integers(0, 4 if rng.random() < 0.2 else 5000, rng.integers(0, 25))]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(d + n, t) for d, t in rows[:9]] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[7][1]), (None, None), (None, rows[8][1]), (n + 50, "x " * 300)]
    return rows


@pytest.mark.parametrize("window", [4, 20])
def test_passages_match_brute_force(spark, docs, odd_docs, no_docs, window, monkeypatch):
    made = spark.createDataFrame(made_up(np.random.default_rng(window)), "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(3)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    for table in (made, odd_docs, no_docs) + ((docs,) if window == 20 else ()):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        got = dedup_substrings(table, window).collect()
        assert sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in got), key=str) == plain_passages(rows, window)
        assert all(sum(s["to"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_texts_are_hashed_alike_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["é \x0b日本  x".encode(), b"", " ".join(f"w{v}" for v in rng.integers(0, 900, 4000)).encode(), b"q" * 9000, b" a"]
    whole, counts = word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    again, same = word_hashes(texts)
    assert (whole == again).all() and (counts == same).all()
    flat = [w for t in texts for w in t.split()]
    assert len(set(zip(flat, whole.tolist()))) == len(set(flat)) == len(set(whole.tolist()))


# --- filters -------------------------------------------------------------------------------------------


def plain_masks(rows):
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(smallest.get(t or "", d), d)
    out = []
    for d, t, part in rows:
        t, w = t or "", words_of(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), t in smallest and (d is None or d > smallest[t])]
        out.append((d, part or "", fails))
    return out


def plain_audit(rows, labels):
    judged = plain_masks(rows)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    out = []
    for part in {p for _, p, _ in judged}:
        own, removed_at = [(d, f) for d, p, f in judged if p == part], {}
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = [x for x in own if x[1][f]]
                removed_at[f] = removed_at.get(f, 0) + len(gone)
                out.append([part, "".join("ABCDE"[k] for k in order), step, len(left), len(gone), len(fails) - len(gone), sum(sum(x[1]) == 1 for x in fails), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f])
        for row in out:
            if row[0] == part:
                row[9] = removed_at[row[9]]
    return sorted(map(tuple, out))


def test_filter_audit_matches_brute_force(spark, docs, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 1), (6, 0, 1), (6, 1, 0), (100, None, 1), (None, 1, 1), (17, 1, None)], "doc_id long, quality int, toxic int")
    odd = odd_docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "").otherwise("en")).withColumn("mask", F.lit("clash"))
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for table, own in ((odd, labels), (docs, known), (no_docs, labels), (odd, labels.where("false"))):
        rows = [tuple(r) for r in table.select("doc_id", "text", "lang").collect()]
        got = sorted(map(tuple, audit_filters(table, own).collect()))
        assert got == plain_audit(rows, [tuple(r) for r in own.select("doc_id", "quality", "toxic").collect()])


def test_removal_polynomial():
    rng = np.random.default_rng(8)
    counts = {m: int(rng.integers(0, 50)) for m in range(32)}
    p = RemovalPolynomial(counts)
    for chosen in range(32):
        assert p.corner(chosen) == sum(n for m, n in counts.items() if m & chosen)
    assert sum(p.shapley(f) for f in range(5)) == p.corner(31)
    assert p.shapley(2) == sum(Fraction(n, m.bit_count()) for m, n in counts.items() if m >> 2 & 1)
    assert len(audit_part("x", [])) == 600 and {r[3:] for r in audit_part("x", [])} == {(0,) * 7}
    assert own_failures(b"") == 1 and own_failures(("Ab " * 250).encode()) == 0b0110 and own_failures("É|".encode()) == 0b1001


# --- clusters ------------------------------------------------------------------------------------------


def plain_clusters(rows, clusters, rounds, width, scale):
    kept = [(d, [math.floor(scale * x) for x in v]) for d, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest(), v) for d, v in kept)
    centres = [v for _, v in start[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else c for k, c in enumerate(centres)]
    found = [(d, near(v)[1], near(v)[0]) for d, v in kept]
    each, digests = {}, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    for _, k, d2 in found:
        each[k] = each.get(k, 0) + d2
    return sorted(((d, k, d2, each[k], sum(each.values()), digests[k]) for d, k, d2 in found), key=str)


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).round(1).tolist()) for i in range(150)]
    rows += [(i + 150, (rng.normal(size=5) * 10.0 ** rng.integers(-2, 5)).tolist()) for i in range(50)]  # norms far apart
    rows += rows[:30] + [(3, [1.0] * 5), (None, [0.5] * 5), (None, [0.25] * 5), (900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [math.nan] * 5), (904, [math.inf] * 5), (905, [0.0] * 5), (906, [0.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(4)
    for clusters, rounds in ((7, 3), (1, 2), (400, 1)):
        got = [tuple(r) for r in cluster_vectors(table, clusters, rounds, width=5).collect()]
        assert sorted(got, key=str) == plain_clusters(rows, clusters, rounds, 5, 64)
    assert cluster_vectors(table.where("false"), width=5).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * 5)], "vec_id long, embedding array<double>"), width=5).collect()


def test_annulus_compares_few_and_loses_none():
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(500, 6)) * (10 ** rng.uniform(0, 4, 500))[:, None]).astype(np.int64)
    for c in (x[:60], np.r_[x[:5], x[:5]], np.array([[3, 4, 0, 0, 0, 0], [5, 0, 0, 0, 0, 0], [0, 0, 5, 0, 0, 0]])):  # equal centroids, equal norms
        found, distance, compared = nearest(x, Centroids(c))
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert compared <= every.size
    assert nearest(x, Centroids(x[:60]))[2] < 0.5 * 500 * 60
    big = x * (1 << 13)
    assert np.abs(big).max() > centroids.EXACT and (nearest(big, Centroids(big[:60]))[0] == nearest(x, Centroids(x[:60]))[0]).all()


def test_salted_copies(spark):
    rows = [(i, "same text", "en") for i in range(300)] + [(None, "same text", "en"), (None, "lone", "en")]
    masks = filter_audit.failure_masks(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).collect()
    assert {r["doc_id"] for r in masks if r["mask"] & 16} == {None, *range(1, 300)} and len(masks) == 302
