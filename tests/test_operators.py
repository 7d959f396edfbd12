"""Operators against known values, brute force and the laws they keep."""

import functools
import itertools
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions import vectors as V
from tamis.functions.text import clean
from tamis.operators import adversarial, bayesian, bilevel, composite, greedy, registry, rounds, uncertainty
from tamis.plans.blocks import Block, cosine_features, nearest_rows, reduced, represent, tiles, to_blocks
from tamis.plans.factor import cholesky_rows, inverse_factor_of, unexplained
from tamis.plans.linear import GrowingFactor
from tamis.plans.model import LinearHead, TwoLayer, average_weights, dropout_masks, saturated, train_linear, uniform
from tamis.plans.training import Trainer, cross_entropy, fresh, squared_error, train_on_subsets, weights_of
from tamis.shared import stash
from tamis.sources import files, pools
from tamis.streaming.topk import TopKSink, merge, stream_top_k

RNG = np.random.default_rng(11)


def rows_of(spark, x, labels=None):
    data = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id long, x array<double>, label int").repartition(3)


def plain_rows(spark, x):
    return represent(rows_of(spark, x).withColumn("emb", F.col("x")), "linear", 2)


def block(x):
    x = np.asarray(x, float)
    return Block(np.arange(len(x)), np.ones((len(x), 1)), x, np.zeros((len(x), 0)))


@pytest.fixture(scope="module")
def net():
    return TwoLayer(RNG.normal(size=(20, 50)), RNG.normal(size=20), RNG.normal(size=(10, 20)), RNG.normal(size=10))


@pytest.fixture(scope="module")
def pool(spark):
    return rows_of(spark, RNG.normal(size=(120, 50)), RNG.integers(0, 10, 120)).cache()


# --- known values -------------------------------------------------------------------------------


def test_nearest_centres_are_the_nearest(spark):
    points, centres = RNG.normal(size=(40, 3)), RNG.normal(size=(5, 3))
    centres[4] = centres[1]  # a tie goes to the earlier centre
    found = greedy.nearest_centres(plain_rows(spark, points), block(centres)).orderBy("id").collect()
    distances = np.linalg.norm(points[:, None] - centres[None, :4], axis=2)
    assert [r["centre"] for r in found] == distances.argmin(axis=1).tolist()
    assert [r["distance"] for r in found] == pytest.approx(distances.min(axis=1).tolist())


def test_nearest_centres_among_hidden_units(spark, net):
    x = RNG.normal(size=(30, 50))
    hidden = np.maximum(x @ net.w1.T + net.b1, 0)
    centres = hidden[[4, 11, 25]] + RNG.normal(size=(3, 20))
    found = greedy.nearest_centres(represent(net.forward(rows_of(spark, x)), "linear", 10), block(centres)).orderBy("id").collect()
    distances = np.sqrt((hidden**2).sum(axis=1)[:, None] - 2 * hidden @ centres.T + (centres**2).sum(axis=1)[None])
    assert [r["centre"] for r in found] == distances.argmin(axis=1).tolist()
    assert [r["distance"] for r in found] == pytest.approx(distances.min(axis=1).tolist())


def test_cluster_means_and_assignment(spark):
    rows = plain_rows(spark, np.outer(np.arange(10), np.ones(4)))
    assigned = spark.createDataFrame([(i, 0 if i < 5 else 1 if i < 8 else 2) for i in range(10)], "id long, centre int")
    means = {(r["centre"], r["d"]): r["m"] for r in greedy.cluster_means(rows, assigned).collect()}
    assert means == {(c, d): m for c, m in ((0, 2.0), (1, 6.0), (2, 8.5)) for d in range(4)}
    near = greedy.nearest_centres(rows, block([[1] * 4, [8] * 4])).collect()
    assert {r["id"] for r in near if r["centre"] == 0} == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("n, m, cap", [(0, 3, 9), (3, 0, 9), (7, 5, 4), (6, 8, 99), (2, 2, 1)])
def test_merge_keeps_the_best_of_both(spark, n, m, cap):
    scores = RNG.integers(0, 6, n + m)  # with ties
    rows = [(i, float(v)) for i, v in enumerate(scores)]
    table = lambda part: spark.createDataFrame(part, "id long, score double")
    want = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))][:cap]
    assert [r["id"] for r in merge(table(rows[:n]), table(rows[n:]), cap).orderBy("rank").collect()] == want


def test_merges_commute_and_take_replays(spark):
    rng = np.random.default_rng(21)
    rows = [(int(i), float(v)) for i, v in zip(rng.permutation(400), rng.integers(-30, 30, 400) / 4)]
    parts = [rows[:7], rows[7:210], rows[100:210], [], rows[210:]]  # with a replay and an empty batch
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:60]
    for order in ((0, 1, 2, 3, 4), (4, 2, 3, 1, 0)):
        held = None
        for k in order:
            held = merge(held, spark.createDataFrame(parts[k], "id long, score double"), 60)
        assert [(r["id"], r["score"]) for r in held.orderBy("rank").collect()] == want


# --- probabilities and embeddings -----------------------------------------------------------------


def test_probabilities(net, pool):
    for df in (uncertainty.predictions(net, pool), uncertainty.dropout_predictions(net, pool, 5)):
        for r in df.collect():
            assert sum(r["p"]) == pytest.approx(1, abs=1e-6) and all(0 <= v <= 1 for v in r["p"])
    passes = uncertainty.dropout_predictions(net, pool, 5).first()["passes"]
    assert len(passes) == 5 and passes[0] != passes[1]
    assert dropout_masks(3, 8).shape == (3, 8) and set(np.unique(dropout_masks(9, 30))) == {0.0, 2.0}


def test_gradient_widths_and_factors(net, pool):
    predicted = uncertainty.predictions(net, pool)
    l0 = V.logit_gradient(F.col("p"), F.col("pred"), 10)
    for kind, n in (("bias", 10), ("linear", 200), ("bias_linear", 210)):
        flat = predicted.select("id", V.gradient_embedding(l0, F.col("emb"), kind).alias("g")).orderBy("id").limit(8).collect()
        assert len(flat[0]["g"]) == n
        own = greedy.gathered(represent(predicted, f"grad_{kind}", 10).orderBy("id").limit(8))
        g = np.array([r["g"] for r in flat])
        assert own.dot(own) == pytest.approx(g @ g.T, abs=1e-9)
    with pytest.raises(ValueError):
        V.gradient_embedding(l0, F.col("emb"), "other")
    with pytest.raises(ValueError):
        represent(predicted, "other", 10)


def test_scores_at_the_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]), ([0.5, 0.5], [[0.5, 0.5], [0.5, 0.5]])], "p array<double>, q array<array<double>>")
    got = df.select(V.entropy(F.col("p")), V.least_confidence(F.col("p")), V.margin(F.col("p")), V.mutual_information(F.col("q"))).collect()
    assert tuple(got[0]) == pytest.approx((0, -1, -1, math.log(2)))
    assert tuple(got[1]) == pytest.approx((math.log(2), -0.5, 0, 0))


@pytest.mark.parametrize("score, drop", [(s, d) for s in ("entropy", "least_confidence", "margin") for d in (None, 3)] + [("bald", 3)])
def test_selection_contract(net, pool, score, drop):
    rows = uncertainty.select_uncertain(net, pool, 10, score, drop).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and len({r["id"] for r in rows}) == 10
    assert uncertainty.select_uncertain(net, pool, 1000, score, drop).count() == 120
    with pytest.raises(ValueError):
        uncertainty.score_rows(net, pool, "other")


# --- greedy objectives by brute force ---------------------------------------------------------------


def objective(name, s, sq, sp, sqq, spp, spq, x, lam=0.7, eta=0.8, nu=0.6):
    """f(A) from the definitions, for a list A of row numbers."""
    n = len(s)
    cols = lambda m, a: m[:, a].max(axis=1) if a else np.zeros(len(m))
    sym = lambda m: m + 1e-6 * np.eye(len(m))
    logdet = lambda m: np.linalg.slogdet(m)[1] if len(m) else 0.0
    qmax, pmax = sq.max(axis=0), sp.max(axis=0)

    def f(a):
        w = s[np.ix_(a, a)]
        if name == "facility_location":
            return cols(s, a).sum()
        if name == "feature_based":
            return np.log1p(np.abs(x[a]).sum(axis=0)).sum()
        if name == "graph_cut":
            return s[:, a].sum() - lam * w.sum()
        if name == "log_determinant":
            return logdet(w + lam * np.eye(len(a)))
        if name == "disparity_sum":
            return sum(1 - s[i, j] for i, j in itertools.combinations(a, 2))
        if name == "fl1mi":
            return np.minimum(cols(s, a), eta * qmax).sum()
        if name == "fl2mi":
            return cols(sq, a).sum() + eta * qmax[a].sum()
        if name == "com":
            return eta * np.log1p(sq[:, a].sum(axis=0)).sum() + np.log1p(sq[:, a].sum(axis=1)).sum()
        if name == "gcmi":
            return 2 * lam * sq[:, a].sum()
        if name == "flcg":
            return np.maximum(cols(s, a) - nu * pmax, 0).sum()
        if name == "gccg":
            return s[:, a].sum() - lam * w.sum() - 2 * lam * nu * sp[:, a].sum()
        if name == "flcmi":
            return np.maximum(np.minimum(cols(s, a), eta * qmax) - nu * pmax, 0).sum()
        qa, pa = eta * sq[:, a], nu * sp[:, a]
        given = lambda m, c, z: m - c.T @ np.linalg.inv(sym(z)) @ c
        if name == "logdetmi":
            return logdet(sym(w)) - logdet(given(sym(w), qa, sqq))
        if name == "logdetcg":
            return logdet(given(sym(w), pa, spp))
        both, cross = np.block([[spp, spq], [spq.T, sqq]]), np.concatenate([pa, qa])
        return logdet(given(sym(w), pa, spp)) - logdet(given(sym(w), cross, both))

    assert n
    return f


EVERY = sorted(set(greedy.SUBMODULAR + greedy.MUTUAL + greedy.CONDITIONAL + greedy.CONDITIONAL_MUTUAL) - {"disparity_min"})


@pytest.mark.parametrize("name, metric", [(n, "cosine") for n in EVERY] + [(n, "euclidean") for n in ("facility_location", "logdetmi", "flcmi")])
def test_greedy_is_the_brute_force_greedy(spark, name, metric):
    rng = np.random.default_rng(5)
    x, q, p = rng.normal(size=(18, 30)), rng.normal(size=(4, 30)), rng.normal(size=(3, 30))
    u, v, w = block(x), block(q), block(p)
    sims = [a.similarity(b, metric) for a, b in ((u, u), (v, u), (w, u), (v, v), (w, w), (w, v))]
    f = objective(name, *sims, x)
    chosen = []
    for _ in range(3):
        gains = [(-np.inf if j in chosen else f([*chosen, j]) - f(chosen)) for j in range(18)]
        chosen.append(int(np.argmax(np.round(gains, 9))))
    got = greedy.maximise(plain_rows(spark, x), 3, name, query=plain_rows(spark, q), private=plain_rows(spark, p), metric=metric, lam=0.7, eta=0.8, nu=0.6)
    assert [i for i, _ in got] == chosen


def test_gram_kernel_is_the_kernel_of_the_rows():
    rng = np.random.default_rng(7)
    x, q, p = rng.normal(size=(18, 8)), rng.normal(size=(60, 8)), rng.normal(size=(50, 8))
    q[3] = p[4] = x[5] = 0
    a, v, w = block(x), block(q), block(p)
    gram = lambda b: cosine_features(b).T @ cosine_features(b)
    for nu, eta in ((0.9, 0.9), (0.6, 0.0)):
        rows = greedy._Kernel("cosine", w.add(v), np.r_[np.full(50, nu), np.full(60, eta)])
        grams = greedy._GramKernel(gram(w), gram(v), nu, eta)
        for chosen in (Block.none(), block(x[:2]), block(x[:3])):
            rows.follow(chosen), grams.follow(chosen)
            assert grams.gain(a)[3:] == pytest.approx(rows.gain(a)[3:], abs=1e-5)


@pytest.mark.parametrize("name", ["logdetmi", "logdetcg", "logdetcmi"])
def test_log_determinants_given_more_rows_than_are_gathered(spark, name, monkeypatch):
    rng = np.random.default_rng(7)
    x, q, p = [rng.normal(size=(n, 8)) for n in (18, 60, 50)]
    u, v, w = block(x), block(q), block(p)
    sims = [a.similarity(b, "cosine") for a, b in ((u, u), (v, u), (w, u), (v, v), (w, w), (w, v))]
    f = objective(name, *sims, x, eta=0.9, nu=0.9)
    monkeypatch.setattr(greedy, "MOST_GATHERED", 5)
    got = greedy.maximise(plain_rows(spark, x), 2, name, query=plain_rows(spark, q), private=plain_rows(spark, p), eta=0.9, nu=0.9)
    chosen = []
    for i, gain in got:
        gains = [(-np.inf if j in chosen else f([*chosen, j]) - f(chosen)) for j in range(18)]
        assert gain == pytest.approx(gains[i], abs=1e-5) and gains[i] == pytest.approx(max(gains), abs=1e-5)
        chosen.append(i)


@pytest.mark.parametrize("name,nu", [("logdetmi", 0.9), ("logdetcg", 0.7), ("logdetcmi", 0.9), ("logdetcmi", 1.1)])
def test_log_determinants_by_distance_given_more_rows_than_are_gathered(spark, name, nu):
    rng = np.random.default_rng(17)
    x, q, p = [rng.normal(size=(n, 5)) for n in (14, 37, 23)]
    q[5] = q[6]  # a repeated row; across the sets their weights would leave the objective undefined
    u, v, w = block(x), block(q), block(p)
    sims = [a.similarity(b, "euclidean") for a, b in ((u, u), (v, u), (w, u), (v, v), (w, w), (w, v))]
    f = objective(name, *sims, x, eta=0.9, nu=nu)
    rows, sets = plain_rows(spark, x), {"query": plain_rows(spark, q), "private": plain_rows(spark, p)}
    got = greedy.maximise(rows, 3, name, **sets, metric="euclidean", eta=0.9, nu=nu, most_gathered=10, most_numbers=300)  # panels of 5 to 13 rows
    gathered = greedy.maximise(rows, 3, name, **sets, metric="euclidean", eta=0.9, nu=nu)
    assert [i for i, _ in got] == [i for i, _ in gathered] and [g for _, g in got] == pytest.approx([g for _, g in gathered], abs=1e-6)
    chosen = []
    for i, gain in got:
        gains = [(-np.inf if j in chosen else f([*chosen, j]) - f(chosen)) for j in range(14)]
        assert gain == pytest.approx(gains[i], abs=1e-5) and gains[i] == pytest.approx(max(gains), abs=1e-5)
        chosen.append(i)


def test_cholesky_rows_in_panels(spark):
    """Rows of gradients over weighted sets, whatever the panels' width; none given, none to be extended."""
    rng = np.random.default_rng(18)
    u, v = [Block(np.arange(n), rng.normal(size=(n, 3)), rng.normal(size=(n, 4)), np.zeros((n, 0))) for n in (9, 11)]
    kernel = v.similarity(v, "cosine") + 1e-6 * np.eye(11)
    weights = np.where(np.arange(11) < 4, 0.5, 2.0)
    explained = (u.similarity(v, "cosine") * weights) @ np.linalg.solve(kernel, (v.similarity(u, "cosine").T * weights).T)
    table = lambda b: spark.createDataFrame([(int(i), g.tolist(), e.tolist()) for i, g, e in zip(b.ids, b.g, b.e)], "id long, g array<double>, e array<double>")
    given = table(v).selectExpr("int(id >= 4) AS place", "if(id < 4, 0.5, 2.0) AS weight", "*")
    for most in (1, 33, 1000):
        found = sorted((r["id"], r["s"]) for r in cholesky_rows(table(u), given, "cosine", 1e-6, most).collect())
        s = np.array([x for _, x in found])
        assert [i for i, _ in found] == list(range(9)) and s.shape == (9, 11)
        assert s @ s.T == pytest.approx(explained, abs=1e-5)
        first = (u.similarity(v, "cosine") * weights)[:, :4]
        assert s[:, :4] @ s[:, :4].T == pytest.approx(first @ np.linalg.solve(kernel[:4, :4], first.T), abs=1e-5)
    assert [r["s"] for r in cholesky_rows(table(u), given.limit(0), "cosine", 1e-6).collect()] == [[]] * 9
    assert cholesky_rows(table(u).limit(0), given, "cosine", 1e-6, 33).count() == 0


def test_panels_of_the_inverse_factor(spark):
    """Whatever the panels' size: L^-1 of the kernel, what each part explains, and its coefficients."""
    rng = np.random.default_rng(19)
    u, v = [Block(np.arange(n), rng.normal(size=(n, 3)), rng.normal(size=(n, 4)), np.zeros((n, 0))) for n in (9, 11)]
    kernel = v.similarity(v, "euclidean")
    np.fill_diagonal(kernel, 1 + 1e-6)
    weights = np.where(np.arange(11) < 4, 0.5, 2.0)
    to = u.similarity(v, "euclidean") * weights
    table = lambda b: spark.createDataFrame([(int(i), g.tolist(), e.tolist()) for i, g, e in zip(b.ids, b.g, b.e)], "id long, g array<double>, e array<double>")
    given = table(v).selectExpr("int(id >= 4) AS place", "if(id < 4, 0.5, 2.0) AS weight", "*")
    blocks = to_blocks(table(u).selectExpr("*", "array() AS s"), 4)
    for most in (1, 33, 1000):
        factor = inverse_factor_of(given, [4, 11], "euclidean", 1e-6, most)
        lower = np.zeros((11, 11))
        for r in factor.panels.collect():
            t = np.array(r["t"]).reshape(-1, len(r["weights"]))
            assert t.size <= max(most, 11)
            lower[r["first"] : r["first"] + len(t), : t.shape[1]] = t
        assert lower @ kernel @ lower.T == pytest.approx(np.eye(11), abs=1e-9) and np.triu(lower, 1).max() == 0
        found = {r["id"]: r["s"] for r in factor.explained(blocks).collect()}
        s = np.array([found[i] for i in range(9)])
        for n, part in ((4, s[:, 0]), (11, s.sum(axis=1))):
            inverse = np.linalg.inv(kernel[:n, :n])
            assert part == pytest.approx(np.einsum("ij,jk,ik->i", to[:, :n], inverse, to[:, :n]), abs=1e-8)
        row = Block(*[x[2:3] for x in vars(u).values()])
        for n, left in zip((0, 4, 11), factor.left(blocks, row, [0, 1, 2], 3)):
            got = {r["id"]: r["v"] for r in left.collect()}
            want = u.similarity(row, "euclidean")[:, 0] - to[:, :n] @ np.linalg.solve(kernel[:n, :n], to[2, :n])
            assert [got[i] for i in range(9)] == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("name", ["logdetcmi", "logdetmi", "logdetcg"])
def test_log_determinants_by_distance_write_no_row_per_candidate_and_given(spark, name, monkeypatch, tmp_path):
    """What is written grows with the given rows' own kernel, not with candidates times given rows."""
    monkeypatch.setattr("tamis.plans.factor.new_folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr("tamis.operators.greedy.remove_folder", lambda spark, folder: None, raising=False)
    monkeypatch.setattr("tamis.plans.factor.remove_folder", lambda spark, folder: None)
    rng = np.random.default_rng(20)
    x, q, p = [rng.normal(size=(n, 5)) for n in (3000, 40, 35)]
    rows, sets = plain_rows(spark, x), {"query": plain_rows(spark, q), "private": plain_rows(spark, p)}
    got = greedy.maximise(rows, 2, name, **sets, metric="euclidean", eta=0.9, nu=0.9, most_gathered=0, most_numbers=400)
    expected = greedy.maximise(rows, 2, name, **sets, metric="euclidean", eta=0.9, nu=0.9)
    assert [i for i, _ in got] == [i for i, _ in expected] and [g for _, g in got] == pytest.approx([g for _, g in expected], abs=1e-6)
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < written < 8 * 3000 * 35 / 2


@pytest.mark.parametrize("name", ["logdetcmi", "logdetmi"])
def test_log_determinants_by_distance_leave_far_candidates_to_bounds(spark, name, monkeypatch):
    """Candidates far from all given rows are not met with their factor; the choice and its gains stay the same, copies among the given or not."""
    rng = np.random.default_rng(23)
    x, q, p = [3 * rng.normal(size=(n, 12)) for n in (600, 40, 35)]
    monkeypatch.setattr(greedy, "TRAVELLING", 64)
    q[7], p[9] = q[3], p[2]
    x[:12] = q[10:22] + 0.02 * rng.normal(size=(12, 12))
    rows, sets, trace = plain_rows(spark, x), {"query": plain_rows(spark, q), "private": plain_rows(spark, p)}, []
    got = greedy.maximise(rows, 3, name, **sets, metric="euclidean", eta=0.9, nu=0.9, most_gathered=0, most_numbers=300, trace=trace)
    expected = greedy.maximise(rows, 3, name, **sets, metric="euclidean", eta=0.9, nu=0.9)
    assert [i for i, _ in got] == [i for i, _ in expected] and [g for _, g in got] == pytest.approx([g for _, g in expected], abs=1e-6)
    assert [step for step, _ in trace] == [0, 1, 2] and 0 < sum(n for _, n in trace) < 100


def test_least_unexplained_variance():
    """No more than what is left, whatever the rows given: far, near, copies."""
    rng = np.random.default_rng(24)
    for spread, near in ((0.3, 0.0), (1.0, 0.1), (1.0, 1.0), (2.0, 0.3)):
        given = spread * rng.normal(size=(80, 6))
        given[40:] = given[:40] + near * rng.normal(size=(40, 6))
        b, a = block(given), block(np.r_[spread * rng.normal(size=(50, 6)), given[:5], given[:5] + 0.01])
        k = a.similarity(b, "euclidean")
        left = 1 - np.einsum("ij,ji->i", k, np.linalg.solve(b.similarity(b, "euclidean") + 1e-6 * np.eye(80), k.T))
        least = unexplained(k.max(axis=1), 80, 1e-6)
        assert (least <= left + 1e-9).all() and (least >= 0).all() and (spread < 2 or least[:50].mean() > 0.05)


def test_log_determinants_of_many_features_by_panels(spark, monkeypatch):
    """The cosine where features are too many for a Gram matrix; a set without rows; a stochastic optimiser."""
    rng = np.random.default_rng(21)
    x, q, p = [rng.normal(size=(n, 5)) for n in (14, 12, 9)]
    rows, sets = plain_rows(spark, x), {"query": plain_rows(spark, q), "private": plain_rows(spark, p).limit(0)}
    expected = greedy.maximise(rows, 3, "logdetcmi", **sets, metric="euclidean", eta=0.9, nu=0.9, optimizer="StochasticGreedy")
    got = greedy.maximise(rows, 3, "logdetcmi", **sets, metric="euclidean", eta=0.9, nu=0.9, optimizer="StochasticGreedy", most_gathered=0, most_numbers=60)
    assert [i for i, _ in got] == [i for i, _ in expected] and [g for _, g in got] == pytest.approx([g for _, g in expected], abs=1e-6)
    sets["private"] = plain_rows(spark, p)
    monkeypatch.setattr(greedy, "MOST_FEATURES", 1)
    expected = greedy.maximise(rows, 3, "logdetcmi", **sets, eta=0.9, nu=0.5)
    got = greedy.maximise(rows, 3, "logdetcmi", **sets, eta=0.9, nu=0.5, most_gathered=0, most_numbers=60)
    assert [i for i, _ in got] == [i for i, _ in expected] and [g for _, g in got] == pytest.approx([g for _, g in expected], abs=1e-3)


@pytest.mark.parametrize("name", ["facility_location", "flcmi", "com"])
def test_lazy_greedy_chooses_as_the_naive_one_and_evaluates_less(spark, name, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(240, 4)) * np.r_[np.full(40, 6.0), np.full(200, 0.3)][:, None] + 1
    rows = plain_rows(spark, x), plain_rows(spark, rng.normal(size=(6, 4))), plain_rows(spark, rng.normal(size=(5, 4)))
    monkeypatch.setattr(greedy, "LAZY_BLOCK", 8)
    monkeypatch.setattr(greedy, "WAVE", 1)
    monkeypatch.setattr(greedy, "MOST_KEPT", 6)
    options = {"query": rows[1], "private": rows[2], "metric": "euclidean", "eta": 1.5, "nu": 0.6}
    trace, naive = [], greedy.maximise(rows[0], 6, name, optimizer="NaiveGreedy", **options)
    lazy = greedy.maximise(rows[0], 6, name, trace=trace, **options)
    assert [i for i, _ in lazy] == [i for i, _ in naive]
    assert [v for _, v in lazy] == pytest.approx([v for _, v in naive], abs=1e-9)
    assert len(trace) == 6 and trace[0][1] == 0 and min(n for _, _, n in trace) >= 30
    assert sum(seen for _, seen, _ in trace[1:]) < 0.7 * sum(n for _, _, n in trace[1:]), trace  # block meets the ground only where it may win


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "squared"])
def test_tiles_are_the_kernel_and_rough_ones_bound_it(metric):
    rng = np.random.default_rng(21)
    for width in (1, 4):  # plain rows, and gradients as two factors
        a, b = (Block(np.arange(n), rng.normal(size=(n, width)), rng.normal(size=(n, 7)), np.zeros((n, 0))) for n in (300, 90))
        a.e[3], a.g[5], a.e[11], a.g[11] = 0, 0, b.e[2], b.g[2]  # rows of length zero, and one that both have
        want = a.distance2(b) if metric == "squared" else a.similarity(b, metric)
        got, rough = (np.concatenate([s.copy() for _, s in tiles(a, b, metric, r)]) for r in (False, True))
        assert got == pytest.approx(want, abs=1e-7)
        over = want - rough if metric == "squared" else rough - want
        assert rough.dtype == np.float32 and (over >= (-1e-7 if metric == "squared" else 0)).all()
        assert np.delete(over, 11, axis=0).max() < 2e-3  # far from the square root's edge at zero
        assert (reduced(a, b, metric, lambda s: s.sum(axis=1), True) >= want.sum(axis=1)).all() or metric == "squared"


@pytest.mark.parametrize("name,options", [("facility_location", {}), ("facility_location", {"metric": "euclidean"}), ("fl2mi", {}), ("com", {"concave": "sqrt"}), ("flcmi", {}), ("facility_location", {"neighbours": 30})])
def test_lazy_greedy_sends_few_blocks_to_the_driver(spark, name, options, monkeypatch):
    rng = np.random.default_rng(22)
    x, sets = rng.normal(size=(240, 6)), {"query": plain_rows(spark, rng.normal(size=(7, 6))), "private": plain_rows(spark, rng.normal(size=(5, 6)))}
    for bound, value in (("LAZY_BLOCK", 4), ("WAVE", 1), ("MOST_WAVE", 2), ("MOST_KEPT", 4)):
        monkeypatch.setattr(greedy, bound, value)
    sent, fetch = [], greedy.gathered_blocks
    monkeypatch.setattr(greedy, "gathered_blocks", lambda blocks, numbers: sent.append(len(numbers)) or fetch(blocks, numbers))
    trace, rows = [], plain_rows(spark, x)
    got = greedy.maximise(rows, 3, name, trace=trace, **sets, **options)
    assert trace[0][2] >= 50 and sum(sent) < 45, (sent, trace)  # nearly all blocks went there in every step before
    if "neighbours" not in options:
        naive = greedy.maximise(rows, 3, name, optimizer="NaiveGreedy", **sets, **options)
        assert [i for i, _ in got] == [i for i, _ in naive] and [v for _, v in got] == pytest.approx([v for _, v in naive], abs=1e-9)


def test_sums_of_cosines_need_no_pairs(spark, monkeypatch):
    x = np.random.default_rng(23).normal(size=(90, 5))
    x[8] = 0
    u, met = block(x), []
    pairs = greedy.over_pairs
    monkeypatch.setattr(greedy, "over_pairs", lambda *args, **options: met.append(1) or pairs(*args, **options))
    got = greedy.maximise(plain_rows(spark, x), 1, "facility_location")
    sums = u.similarity(u, "cosine").sum(axis=1)
    assert not met and got == [(int(sums.argmax()), pytest.approx(sums.max()))]


def test_nearest_rows_over_several_blocks(spark):
    x = np.random.default_rng(24).normal(size=(70, 3))
    x[40], x[41] = x[2], x[2]  # ties
    rows = plain_rows(spark, x)
    s = block(x).similarity(block(x), "cosine")
    for r in nearest_rows(stash(to_blocks(rows, 9)), 5, "cosine").collect():
        assert [n["s"] for n in r["near"]] == pytest.approx(sorted(s[r["id"]], reverse=True)[:5]) and len({n["j"] for n in r["near"]}) == 5


def test_glister_counts_only_rows_that_can_win(spark, net, pool, monkeypatch):
    p = uncertainty.predictions(net, pool)
    monkeypatch.setattr(bilevel, "TRIED", 2)
    counted, pairs = [], bilevel.over_pairs
    monkeypatch.setattr(bilevel, "over_pairs", lambda a, b, *args, **options: counted.append(a.agg(F.sum(F.size("ids"))).first()[0]) or pairs(a, b, *args, **options))
    got = bilevel.glister(p, p, p, 3, 0.1, 10, 20, "FacLoc", 0.01)
    bounded = len(counted)
    monkeypatch.setattr(bilevel, "TRIED", 10**6)  # all rows are counted exactly
    assert bilevel.glister(p, p, p, 3, 0.1, 10, 20, "FacLoc", 0.01) == [(i, pytest.approx(v)) for i, v in got]
    assert sorted(counted[:bounded])[0] <= 2 and sum(n == 120 for n in counted[:bounded]) <= 2  # every step counted all 120 before


@pytest.mark.parametrize("name", ["facility_location", "flcmi"])
def test_sparse_coverage(spark, name, monkeypatch):
    rng = np.random.default_rng(13)
    x, q, p = rng.normal(size=(40, 3)), rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    x[7] = x[3]  # a tie of neighbours
    u, v, w = block(x), block(q), block(p)
    s, sq, sp = (a.similarity(u, "cosine") for a in (u, v, w))
    monkeypatch.setattr("tamis.plans.blocks.BLOCK", 16)
    options = {"query": plain_rows(spark, q), "private": plain_rows(spark, p), "eta": 0.8, "nu": 0.6}
    dense = greedy.maximise(plain_rows(spark, x), 4, name, **options)
    whole = greedy.maximise(plain_rows(spark, x), 4, name, neighbours=40, **options)
    assert [i for i, _ in whole] == [i for i, _ in dense] and [g for _, g in whole] == pytest.approx([g for _, g in dense])
    cut = np.zeros_like(s)
    for i in range(40):
        near = sorted(range(40), key=lambda j: (-s[i, j], j))[:6]
        cut[i, near] = s[i, near]
    f = objective(name, cut, sq, sp, None, None, None, x, eta=0.8, nu=0.6)
    chosen = []
    for i, gain in greedy.maximise(plain_rows(spark, x), 4, name, neighbours=6, **options):
        gains = [(-np.inf if j in chosen else f([*chosen, j]) - f(chosen)) for j in range(40)]
        assert gain == pytest.approx(max(gains)) and gains[i] == pytest.approx(max(gains))
        chosen.append(i)
    if name == "facility_location":  # the stated bound on what is lost
        lost = objective(name, s, sq, sp, None, None, None, x)(chosen) - f(chosen)
        assert -1e-9 <= lost <= sum(np.sort(s[i])[-6] for i in range(40) if not cut[i, chosen].any()) + 1e-9
    with pytest.raises(ValueError):
        greedy.maximise(plain_rows(spark, x), 2, "graph_cut", lam=1.0, neighbours=3)


def test_growing_factor_is_the_factor():
    a = RNG.normal(size=(9, 6))
    m = a @ a.T + np.eye(9)
    factor = GrowingFactor()
    for t in range(5):
        factor.add(m[t, :t], m[t, t])
    want = np.einsum("ij,jk,ik->i", m[5:, :5], np.linalg.inv(m[:5, :5]), m[5:, :5])
    assert factor.explained(m[5:, :5]) == pytest.approx(want) and factor.rows @ m[:5, :5] @ factor.rows.T == pytest.approx(np.eye(5), abs=1e-9)


def test_bad_objectives_are_refused(spark):
    rows = plain_rows(spark, RNG.normal(size=(5, 3)))
    for options in ({"function": "other"}, {"function": "graph_cut"}, {"function": "fl1mi"}, {"function": "flcg"}, {"function": "facility_location", "optimizer": "other"}):
        with pytest.raises(ValueError):
            greedy.maximise(rows, 2, **options)
    with pytest.raises(ValueError):
        block(np.ones((2, 2))).similarity(block(np.ones((2, 2))), "other")
    assert greedy.maximise(rows, 2, "graph_cut", lam=100.0, stop_negative=True) == []


def test_furthest_first_and_seeding(spark):
    x = np.array([[0.0], [1.0], [10.0], [11.0], [30.0]])
    assert [i for i, _ in greedy.furthest_first(plain_rows(spark, x), plain_rows(spark, [[0.5]]), 3)] == [4, 3, 2]
    assert [i for i, _ in greedy.furthest_first(plain_rows(spark, x), None, 3)] == [0, 4, 3]
    same = np.ones((6, 2))
    assert [i for i, _ in greedy.spread_by_distance(plain_rows(spark, same), 3, 1, "norm")] == [0, 1, 2]
    a, b = ([i for i, _ in greedy.spread_by_distance(plain_rows(spark, RNG.normal(size=(40, 3))), 5, s, "uniform")] for s in (1, 2))
    assert len(set(a)) == 5 and a != b


def test_kmeans_keeps_an_empty_cluster(spark):
    x = np.array([[0.0], [0.2], [5.0], [5.2]])
    centres, inertia = greedy.kmeans(plain_rows(spark, x), 3, block([[0.0], [5.0], [100.0]]))
    assert centres.e.ravel().tolist() == pytest.approx([0.1, 5.1, 100.0]) and inertia == pytest.approx(0.04)
    assert sorted(r["id"] for r in greedy.representatives(plain_rows(spark, x), centres).collect()) == [0, 2]


# --- gradients --------------------------------------------------------------------------------------


def test_matching(net, pool):
    rows = represent(uncertainty.predictions(net, pool), "grad_bias_linear", 10)
    fixed = bilevel.select_matching(rows, rows, 7).collect()
    assert len({r["id"] for r in fixed}) == 7 and {r["weight"] for r in fixed} == {1.0}
    assert [r["id"] for r in fixed] == sorted(r["id"] for r in fixed)
    ids, w = bilevel.matching_pursuit(rows, rows, 7)
    assert len(ids) <= 7 and min(w) >= 0
    assert bilevel.select_matching(rows, rows, 7, use_weights=True).count() == 7


def test_non_negative_weights():
    a = RNG.normal(size=(20, 6))
    b = a @ np.array([1.0, 0, 2, 0, 0, 0.5]) - 0.3 * a[:, 1]
    w = bilevel.non_negative(a.T @ a, a.T @ b, 0.0)
    slope = a.T @ (a @ w - b)
    assert (w >= 0).all() and (slope > -1e-6).all() and abs(slope @ w) < 1e-6


def test_active_set_agrees_with_plain_descent():
    rng = np.random.default_rng(14)
    for n, dims in ((2, 5), (12, 30), (40, 12)):
        a = rng.normal(size=(dims, n))
        a[:, -1] = a[:, 0]  # a repeated row
        m, b = a.T @ a, a.T @ (a @ np.maximum(rng.normal(size=n), 0) + 0.1 * rng.normal(size=dims))
        w = np.zeros(n)
        for _ in range(60_000):
            before = w.copy()
            for i in range(n):
                w[i] = max(0.0, w[i] + (b[i] - m[i] @ w) / m[i, i])
            if np.abs(w - before).max() < 1e-13:
                break
        found = bilevel.non_negative(m, b, 0.0)
        value = lambda x: x @ m @ x - 2 * b @ x
        assert (found >= 0).all() and value(found) == pytest.approx(value(w), abs=1e-7)
        again = bilevel.non_negative(m, b, 0.0, np.flatnonzero(found).tolist())
        assert value(again) == pytest.approx(value(found), abs=1e-9)
    a = rng.normal(size=(700, 500))
    began = time.time()
    w = bilevel.non_negative(a.T @ a, a.T @ rng.normal(size=700), 0.1)
    slope = a.T @ a @ w + 0.1 * w
    assert time.time() - began < 60 and (w >= 0).all() and (w > 0).any() and len(slope) == 500


def test_glister_refuses_and_fills(net, pool):
    p = uncertainty.predictions(net, pool)
    with pytest.raises(ValueError):
        bilevel.glister(p, p, p, 3, 0.1, 10, 20, "other")
    with pytest.raises(ValueError):
        bilevel.glister(p, p, p, 3, 0.1, 10, 20, "Rand", 1.5)
    picks = bilevel.glister(p, p, None, 5, 0.1, 10, 20, "rand", 0.3)
    assert len({i for i, _ in picks}) == 5


# --- joint batches and boundaries ---------------------------------------------------------------------


def test_joint_entropy():
    p = RNG.dirichlet(np.ones(3), size=(2, 4))
    joint = np.einsum("ka,kb->kab", *p).mean(axis=0)
    assert bayesian.joint_entropy(list(p)) == pytest.approx(-(joint * np.log(joint)).sum())
    outcomes, weight = bayesian.sampled_joint(list(p), 8000, 1)
    mean = outcomes.mean(axis=1)
    assert -(weight * mean * np.log(mean)).sum() == pytest.approx(bayesian.joint_entropy(list(p)), rel=0.05)


def test_batch_bald_by_brute_force(spark):
    p = np.random.default_rng(2).dirichlet(np.ones(3), size=(12, 4))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(p)], "id long, passes array<array<double>>").repartition(3)
    h = bayesian.conditional_entropy(p)
    chosen = []
    for _ in range(3):
        gains = [-np.inf if i in chosen else bayesian.joint_entropy([p[j] for j in [*chosen, i]]) - h[[*chosen, i]].sum() for i in range(12)]
        chosen.append(int(np.argmax(gains)))
    assert [r["id"] for r in bayesian.batch_bald(table, 3).orderBy("rank").collect()] == chosen
    assert len({r["id"] for r in bayesian.batch_bald(table, 6, n_samples=20).collect()}) == 6


def test_boundary_distances(spark, net):
    head = LinearHead(RNG.normal(size=(4, 5)))
    x = RNG.normal(size=(30, 5))
    z = head.logits(x)
    want = []
    for r, f in zip(x, z):
        c = int(f.argmax())
        d = min(abs(f[k] - f[c]) / np.linalg.norm(head.weights[k] - head.weights[c]) for k in range(4) if k != c)
        want.append((1.02 * (d + 1e-4)) ** 2)
    assert adversarial.deep_fool(head, x, 50) == pytest.approx(want)
    y = RNG.normal(size=(30, 50))
    for model, rows in ((head, x), (net, y)):
        flips = adversarial.sign_steps(model, rows, 0.05, 1000)
        assert (flips > 0).all() and np.isfinite(adversarial.deep_fool(model, rows, 50)).all()
    got = adversarial.select_bim(head, rows_of(spark, x), 5, 0.01).collect()
    flips = adversarial.sign_steps(head, x, 0.01, 1000)
    assert [r["id"] for r in got] == sorted(range(30), key=lambda i: (flips[i], i))[:5]


# --- composites, rounds, sources ----------------------------------------------------------------------


def test_partition_shares():
    assert composite.shares(10, 3, 4) == [(4, 2), (7, 1), (10, 1)]
    for n, m, k in ((15000, 4, 30), (17, 5, 9)):
        plan = composite.shares(n, m, k)
        assert plan[-1][0] == n and sum(b for _, b in plan) == k
    with pytest.raises(ValueError):
        composite.shares(10, 5, 4)


def test_partitioned_any_selection(spark):
    rows = plain_rows(spark, RNG.normal(size=(30, 3)))
    got = composite.partitioned(rows, 3, 7, lambda part, k: greedy.maximise(part, k, "facility_location")).collect()
    assert len({r["id"] for r in got}) == 7 and {r["id"] // 10 for r in got} == {0, 1, 2}


def count_jobs(spark, run):
    group = f"g{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_parts_are_selected_together(spark, monkeypatch):
    x = RNG.normal(size=(60, 3))
    rows, jobs = plain_rows(spark, x), []
    for parts in (2, 6):
        cut = rows.withColumn("part", (F.col("id") % parts).cast("int"))
        budgets = {p: 3 if p else 2 for p in range(parts)}
        got, n = count_jobs(spark, lambda: greedy.furthest_first_by_part(cut, plain_rows(spark, [[0.0, 0.0, 0.0]]), budgets))
        jobs.append(n)
        for p in range(parts):
            own = rows.where(F.col("id") % parts == p)
            assert [i for i, _ in got[p]] == [i for i, _ in greedy.furthest_first(own, plain_rows(spark, [[0.0, 0.0, 0.0]]), budgets[p])]
    assert abs(jobs[0] - jobs[1]) <= 3  # adaptive execution may cut a query into another number of jobs
    cut = rows.withColumn("part", (F.col("id") % 3).cast("int"))
    for most in (1 << 20, 0):  # broadcast, and dealt by salts
        monkeypatch.setattr("tamis.plans.blocks.MOST_BROADCAST", most)
        got = greedy.facility_location_by_part(cut, {0: 3, 1: 1, 2: 0})
        for p, k in ((0, 3), (1, 1)):
            assert got[p] == [(i, pytest.approx(v)) for i, v in greedy.maximise(rows.where(F.col("id") % 3 == p), k, "facility_location")]
        assert set(got) == {0, 1}


def test_seedings_together_are_those_one_by_one(spark):
    x = RNG.normal(size=(50, 2))
    rows = plain_rows(spark, x)
    jobs = []
    for n_init in (1, 4):
        (centres, inertia), n = count_jobs(spark, lambda: greedy.kmeans(rows, 3, max_iter=4, tol=0.0, n_init=n_init, seed=2))
        jobs.append(n)
    assert abs(jobs[0] - jobs[1]) <= 3
    found = []
    for seed in range(2, 6):
        picks = [i for i, _ in greedy.spread_by_distance(rows, 3, seed, "uniform")]
        found.append(greedy.kmeans(rows, 3, block(x[picks]), max_iter=4, tol=0.0))
    best = min(range(4), key=lambda r: found[r][1])
    assert inertia == pytest.approx(found[best][1]) and centres.e == pytest.approx(found[best][0].e)


def test_training_and_rounds(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 4)) + 3 * np.eye(4)[y]
    every = rows_of(spark, x, y)
    head, curve = train_linear(every, 3, 4, epochs=40)
    assert curve[-1] > 0.9
    assert train_linear(every.withColumn("w", (F.col("label") == 0).cast("double")), 3, 4, epochs=5, weight="w")[0].bias[0] > 0
    assert len(train_linear(every, 3, 4, epochs=40, max_accuracy=0.5)[1]) < 40
    mean = average_weights([head, LinearHead(-head.weights, -head.bias)])
    assert mean.weights == pytest.approx(0) and saturated([0.5] * 10, 10, 0.001) and not saturated([0.5] * 9, 10, 0.001)
    loop = rounds.Rounds(lambda model, train, pool, k: uncertainty.select_uncertain(model, pool, k, "margin"), 3, 4, 10, target=0.999, training={"epochs": 10})
    log = loop.run(every.where("id < 20"), every.where("id >= 20 and id < 100"), every.where("id >= 100"), 2).orderBy("round").collect()
    assert [r["n_train"] for r in log] == [20, 30, 40][: len(log)]


def plain_descent(x, y, w, model, trainer, epochs):
    """The same descent, row by row in the same order, on one machine."""
    own = [np.array(a) for a in weights_of(model)]
    velocity, second, t = [0 * a for a in own], [0 * a for a in own], 0
    for epoch in range(epochs):
        order = sorted(range(len(y)), key=lambda i: (uniform(trainer.seed, epoch, i), i))
        for k in range(0, len(y), trainer.batch):
            part, t = order[k : k + trainer.batch], t + 1
            slopes = [0 * a for a in own]
            for i in part:
                if len(own) == 2:
                    z, h = own[0] @ x[i] + own[1], None
                else:
                    h = np.maximum(own[0] @ x[i] + own[1], 0)
                    z = own[2] @ h + own[3]
                e = np.exp(z - z.max()) / np.exp(z - z.max()).sum() - np.eye(len(z))[y[i]]
                e = e * w[i] / len(part)
                if h is None:
                    more = [np.outer(e, x[i]), e]
                else:
                    back = (own[2].T @ e) * (h > 0)
                    more = [np.outer(back, x[i]), back, np.outer(e, h), e]
                slopes = [a + b for a, b in zip(slopes, more)]
            for j, g in enumerate(slopes):
                if trainer.optimizer == "sgd":
                    velocity[j] = 0.9 * velocity[j] + g + 5e-4 * own[j]
                    own[j] = own[j] - trainer.rate * 0.5 * (1 + math.cos(math.pi * epoch / trainer.epochs)) * velocity[j]
                else:
                    velocity[j], second[j] = 0.9 * velocity[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
                    own[j] = own[j] - trainer.rate * (velocity[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
    return own


@pytest.mark.parametrize("kind, optimizer", [("linear", "sgd"), ("two_layer", "sgd"), ("two_layer", "adam")])
def test_one_task_descends_as_on_one_machine(spark, kind, optimizer):
    y = RNG.integers(0, 3, 50)
    x, w = RNG.normal(size=(50, 4)) + 2 * np.eye(4)[y], RNG.uniform(0.5, 2, 50)
    rows = rows_of(spark, x, y).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "id long, share double"), "id")
    trainer = Trainer(rate=0.1, epochs=3, batch=8, optimizer=optimizer, tasks=1, max_accuracy=2.0, seed=5)
    start = fresh(kind, 4, 3, 6, seed=1)
    model, log = trainer.train(rows, start, "share")
    for got, want in zip(weights_of(model), plain_descent(x, y, w, start, trainer, 3)):
        assert got == pytest.approx(want, abs=1e-9)
    assert len(log) == 3 and log[-1][1] < log[0][1]


def test_training_over_tasks_stops_restarts_and_takes_a_loss(spark):
    y = RNG.integers(0, 3, 200)
    rows = rows_of(spark, RNG.normal(size=(200, 4)) + 3 * np.eye(4)[y], y)
    model, log = Trainer(rate=0.2, epochs=30, batch=10, tasks=4, max_accuracy=0.9).train(rows, fresh("two_layer", 4, 3, 8))
    assert log[-1][0] >= 0.9 and len(log) < 30
    assert Trainer(rate=0.1, epochs=12, tasks=2, loss=squared_error, max_accuracy=0.9).train(rows, fresh("linear", 4, 3))[1][-1][0] > 0.8
    assert len(Trainer(rate=1e-9, epochs=40, tasks=1, window=3, min_gain=0.01, max_accuracy=2.0).train(rows, model)[1]) == 3
    with pytest.raises(ValueError):
        Trainer(optimizer="newton").train(rows, model)
    for loss in (cross_entropy, squared_error):  # the gradients are those of the losses
        z, labels = RNG.normal(size=(5, 3)), np.array([0, 1, 2, 0, 1])
        step = np.zeros_like(z)
        step[2, 1] = 1e-6
        assert loss(z, labels)[1][2, 1] == pytest.approx((loss(z + step, labels)[0][2] - loss(z - step, labels)[0][2]) / 2e-6, abs=1e-5)


def plain_together(x, y, w, model, trainer, epochs):
    """Synchronous descent on one machine: mini-batches and their order by hashes alone."""
    state, n = trainer._begin(model), trainer.batches or math.ceil(len(y) / trainer.batch)
    number = np.array([min(n - 1, int(uniform(trainer.seed, "batch", i) * n)) for i in range(len(y))])
    for epoch in range(epochs):
        for b in sorted(range(n), key=lambda b: uniform(trainer.seed, epoch, b)):
            if (own := number == b).any():
                trainer.step(model, state, x[own], y[own], w[own], trainer.rate_of(epoch))
    return state[0]


@pytest.mark.parametrize("kind, optimizer", [("linear", "sgd"), ("two_layer", "adam")])
def test_synchronous_training_does_not_depend_on_tasks(spark, kind, optimizer):
    y = RNG.integers(0, 3, 70)
    x, w = RNG.normal(size=(70, 4)) + 2 * np.eye(4)[y], RNG.uniform(0.5, 2, 70)
    rows = rows_of(spark, x, y).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "id long, share double"), "id")
    start, found = fresh(kind, 4, 3, 6, seed=1), []
    for tasks in (1, 4):
        trainer = Trainer(rate=0.1, epochs=3, batch=16, optimizer=optimizer, tasks=tasks, synchronous=True, max_accuracy=2.0, seed=5)
        model, log = trainer.train(rows, start, "share")
        found.append(np.concatenate([a.ravel() for a in weights_of(model)]))
        assert len(log) == 3 and log[-1][1] < log[0][1]
    assert found[1] == pytest.approx(found[0], abs=1e-9)
    assert np.concatenate([a.ravel() for a in plain_together(x, y, w, start, trainer, 3)]) == pytest.approx(found[0], abs=1e-9)
    assert Trainer(synchronous=True, tasks=2).train(rows.where("false"), start)[1] == []


@pytest.mark.parametrize("kind", ["linear", "two_layer"])
def test_weights_averaged_while_training(spark, kind):
    y = RNG.integers(0, 3, 60)
    rows, start = rows_of(spark, RNG.normal(size=(60, 4)) + 2 * np.eye(4)[y], y), fresh(kind, 4, 3, 5)
    each = lambda n, **more: weights_of(Trainer(rate=0.1, epochs=4, batch=10, tasks=1, optimizer="adam", max_accuracy=2.0, stop_after=n, **more).train(rows, start)[0])
    want = [np.mean(w, axis=0) for w in zip(*[each(n) for n in (2, 3, 4)])]
    for got, mean in zip(each(4, average_from=1), want):
        assert got == pytest.approx(mean, abs=1e-9)


def test_subsets_in_training(spark):
    y = RNG.integers(0, 3, 90)
    rows, asked = rows_of(spark, RNG.normal(size=(90, 4)) + 3 * np.eye(4)[y], y), []

    def first_ones(model, own, k):
        asked.append(k)
        return own.orderBy("id").limit(k).select("id", F.lit(1.0).alias("weight"))

    _, log = train_on_subsets(Trainer(rate=0.1, epochs=7, tasks=1, max_accuracy=2.0), rows, fresh("linear", 4, 3), first_ones, every=3)
    assert asked == [27, 27, 27] and len(log) == 7


def test_strategies_by_name(spark, net, pool):
    small = pool.where("id < 60")
    for name in ("badge", "glister", "entropy_sampling", "margin_sampling", "least_confidence", "coreset", "fass", "random_sampling", "bald_dropout", "adversarial_bim", "kmeans_sampling", "adversarial_deepfool"):
        rows = registry.select(name, net, pool.where("id >= 60"), small, 4).collect()
        assert [r["rank"] for r in rows] == [1, 2, 3, 4] and len({r["id"] for r in rows}) == 4 and all(r["id"] < 60 for r in rows), name
    with pytest.raises(ValueError):
        registry.select("none", net, pool, pool, 4)
    registry.register_score("smallest_first", lambda p: -F.get(p, 0))
    registry.register("largest_ids", lambda model, train, rows, k: greedy.top_k(rows.select("id", F.col("id").cast("double").alias("score")), k))
    try:
        assert registry.select("smallest_first", net, pool, small, 3).count() == 3
        assert [r["id"] for r in registry.select("largest_ids", net, pool, small, 3).orderBy("rank").collect()] == [59, 58, 57]
    finally:
        V.SCORES.pop("smallest_first")
        registry.STRATEGIES.pop("smallest_first"), registry.STRATEGIES.pop("largest_ids")


def test_experiment_from_a_configuration(spark):
    y = RNG.integers(0, 3, 120)
    rows = rows_of(spark, RNG.normal(size=(120, 4)) + 3 * np.eye(4)[y], y)
    config = {
        "model": {"architecture": "two_layer_net", "input_dim": 4, "target_classes": 3, "hidden_units_1": 8},
        "train_parameters": {"lr": 0.1, "batch_size": 8, "n_epoch": 8, "tasks": 1, "isreset": False},
        "active_learning": {"strategy": "entropy_sampling", "budget": 15, "rounds": 3, "initial_points": 20, "strategy_args": {"batch_size": 1, "n_drop": None}},
    }
    log = registry.experiment(config, rows.where("id < 80"), rows.where("id >= 80")).orderBy("round").collect()
    assert [r["n_train"] for r in log] == [20, 35, 50] and log[-1]["accuracy"] > 0.7
    for part, odd in (("active_learning", {"strategy": "none"}), ("active_learning", {"strategy_args": {"unknown": 1}}), ("model", {"architecture": "resnet18"}), ("train_parameters", {"momentun": 1})):
        with pytest.raises(ValueError):
            registry.experiment({**config, part: {**config[part], **odd}}, rows, rows)
    registry.register("by_object", functools.partial(lambda model, train, pool, k, extra, sign=1: greedy.top_k(pool.select("id", (sign * F.col("id")).cast("double").alias("score")), k), extra=None))
    try:
        own = {**config, "active_learning": {**config["active_learning"], "strategy": "by_object", "rounds": 2, "strategy_args": {"sign": -1}}}
        assert registry.experiment(own, rows.where("id < 80"), rows.where("id >= 80")).count() == 2
    finally:
        registry.STRATEGIES.pop("by_object")


def test_rounds_go_on_where_they_were(spark, tmp_path):
    y = RNG.integers(0, 3, 120)
    rows = stash(rows_of(spark, RNG.normal(size=(120, 4)) + 2 * np.eye(4)[y], y))
    parts = rows.where("id < 12"), rows.where("id >= 12 and id < 90"), rows.where("id >= 90")
    asked, fits, failing = [], [], []

    def choose(model, train, pool, k):
        if failing and len(asked) == 1:
            raise RuntimeError("lost")
        chosen = uncertainty.select_uncertain(model, pool, k, "margin").collect()
        asked.append([r["id"] for r in chosen])
        return spark.createDataFrame(chosen)

    def fit(train):
        fits.append(train.count())
        return Trainer(rate=0.1, epochs=2, batch=16, tasks=1).train(train, fresh("two_layer", 4, 3, 5))[0]

    loop = rounds.Rounds(choose, 3, 4, 8, fit=fit)
    unbroken, want = [tuple(r)[:3] for r in loop.run(*parts, 3).orderBy("round").collect()], asked[:]
    asked.clear(), fits.clear(), failing.append(True)
    with pytest.raises(RuntimeError):
        loop.run(*parts, 3, str(tmp_path / "state"))
    assert fits == [12, 20] and len(asked) == 1
    failing.clear()
    again = [tuple(r)[:3] for r in loop.run(*parts, 3, str(tmp_path / "state")).orderBy("round").collect()]
    assert again == unbroken and asked == want and fits == [12, 20, 28, 36]
    assert [tuple(r)[:3] for r in loop.run(*parts, 3, str(tmp_path / "state")).orderBy("round").collect()] == unbroken and len(fits) == 4
    assert loop.run(*parts, 0, str(tmp_path / "state"), "other").count() == 1 and len(fits) == 5  # another experiment starts anew


def test_streams_without_batches_and_with_replays(spark, tmp_path):
    schema, path = "id long, score double", str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(path)
    table = lambda: spark.readStream.schema(schema).parquet(path)
    assert stream_top_k(table(), 3, str(tmp_path / "s")).collect() == []
    for part in ([(1, 5.0), (2, 7.0), (3, 7.0)], [(4, 6.0), (2, 7.0)], [(5, 1.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        got = stream_top_k(table(), 3, str(tmp_path / "s")).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(2, 7.0), (3, 7.0), (4, 6.0)]
    sink = TopKSink(str(tmp_path / "own"), 2)
    for number, part in ((0, [(1, 1.0)]), (4, [(2, 2.0)]), (4, [(2, 2.0)]), (7, [(3, 0.5)])):  # numbers skipped, one replayed
        sink(spark.createDataFrame(part, schema), number)
    assert [r["id"] for r in sink.result(spark).orderBy("rank").collect()] == [2, 1]
    assert len([f for f in (tmp_path / "own").iterdir() if f.name.startswith("batch=")]) == 2


def test_layers_by_name(spark, net, pool):
    x = np.array([r["x"] for r in pool.orderBy("id").collect()])
    emb = np.array([r["emb"] for r in net.layer(pool, "preactivation").orderBy("id").collect()])
    assert emb == pytest.approx(x @ net.w1.T + net.b1)
    with pytest.raises(ValueError):
        net.layer(pool, "avgpool")


def test_views(spark):
    df = rows_of(spark, np.arange(12.0).reshape(6, 2), [0, 0, 1, 1, 2, 2])
    ids = spark.createDataFrame([(1, 9), (4, 9)], "id long, label int")
    assert "label" not in pools.unlabelled(df).columns and pools.subset(df, ids).count() == 2
    assert {r["label"] for r in pools.relabelled(df, ids).collect()} == {9}
    assert df.select(pools.to_channels(F.col("x")).alias("x")).first()["x"] in [list(r) * 3 for r in np.arange(12.0).reshape(6, 2)]
    with pytest.raises(ValueError):
        pools.check_pool(df, "id", "emb")


def test_libsvm_csv_and_standardise(spark, tmp_path):
    (tmp_path / "a.svm").write_text("1 1:0.5 3:2\n-1 2:1\n\n+2.0 \n")
    rows = files.read_libsvm(spark, str(tmp_path / "a.svm"), 3).orderBy("id").collect()
    assert [(r["x"], r["label"]) for r in rows] == [([0.5, 0, 2], 1), ([0, 1, 0], -1), ([0, 0, 0], 2)]
    (tmp_path / "a.csv").write_text("1,2,b\n3,2,a\n5,2,b\n")
    iris = files.read_csv(spark, str(tmp_path / "a.csv"), 2)
    assert [(r["x"], r["label"]) for r in iris.orderBy("id").collect()] == [([1, 2], 1), ([3, 2], 0), ([5, 2], 1)]
    (tmp_path / "sat.svm").write_text("1 1:1\n7 1:3 36:1\n")
    (tmp_path / "ij.svm").write_text("-1 1:1\n1 1:3\n")
    sat = files.read_satimage(spark, str(tmp_path / "sat.svm"), str(tmp_path / "sat.svm"))[1].orderBy("id").collect()
    assert [r["label"] for r in sat] == [0, 6] and [r["x"][0] for r in sat] == [-1, 1] and len(sat[0]["x"]) == 36
    assert [r["label"] for r in files.read_ijcnn1(spark, str(tmp_path / "ij.svm"))[0].orderBy("id").collect()] == [0, 1]
    x = np.array([r["x"] for r in files.standardise(iris, iris)[0].collect()])
    assert x.mean(axis=0) == pytest.approx([0, 0]) and x[:, 0].std() == pytest.approx(1)


def test_config_checkpoints_and_weights(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"model": {"name": "x"}}))
    assert files.read_config(str(tmp_path / "c.json"))["model"]["name"] == "x"
    with pytest.raises(OSError):
        files.read_config(str(tmp_path / "c.yaml"))
    with pytest.raises(FileNotFoundError):
        files.read_config(str(tmp_path / "d.json"))
    for n in (1, 2):
        files.save_checkpoint(spark.createDataFrame([(n, 0.5 * n)], "id long, accuracy double"), str(tmp_path / "ck"), "e", n)
    assert [r["id"] for r in files.load_checkpoint(spark, str(tmp_path / "ck"), "e").collect()] == [2]
    files.save_checkpoint(spark.createDataFrame([(3, 0.1)], "id long, accuracy double"), str(tmp_path / "ck"), "e", 2)  # a retry takes the round's place
    files.save_checkpoint(spark.createDataFrame([(9, 0.1)], "id long, accuracy double"), str(tmp_path / "ck"), "other", 1)
    assert [r["id"] for r in files.load_checkpoint(spark, str(tmp_path / "ck"), "e").collect()] == [3]
    assert files.delete_checkpoints(spark, str(tmp_path / "ck"), "e", keep_newest=1) == 1
    assert {(r["experiment"], r["round"]) for r in spark.read.parquet(str(tmp_path / "ck")).collect()} == {("e", 2), ("other", 1)}
    head = LinearHead([[1.0, 2.0], [3.0, 4.0]], [0.5, 0.25])
    files.save_head(spark, head, str(tmp_path / "w"))
    again = files.load_head(spark, str(tmp_path / "w"))
    assert (again.weights == head.weights).all() and (again.bias == head.bias).all()


def test_clean_text(spark):
    df = spark.createDataFrame([("The Éa, of; it's",), (None,)], "t string")
    got = [tuple(r) for r in df.select(clean(F.col("t"), ("the", "of")), clean(F.col("t"), full=False)).collect()]
    assert got == [("ea its", "The Éa of its"), (None, None)]
