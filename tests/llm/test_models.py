import math
import struct
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash

from tamis.llm import ppm
from tamis.llm.catalog import op7_toxicity
from tamis.llm.toxicity import RIDGES, SWAPS, TERMS, added, counterfactuals, features, fit, score_toxicity, swapped, train_toxicity


class PlainPpm:
    """Prediction by partial matching, symbol by symbol."""

    def __init__(self, texts, order=ppm.ORDER):
        self.order, self.after = order, {}
        for t in texts:
            s = [*t, "end"]
            for i, x in enumerate(s):
                for k in range(min(order, i) + 1):
                    self.after.setdefault(tuple(s[i - k : i]), Counter())[x] += 1

    def score(self, text):
        s, total = [*text, "end"], 0.0
        for i, x in enumerate(s):
            out = set()
            for k in range(min(self.order, i), -1, -1):
                seen = self.after.get(tuple(s[i - k : i]))
                if seen is None:
                    continue
                left = {y: n for y, n in seen.items() if y not in out}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if x in left:
                    total += math.log10(left[x] / whole)
                    break
                total += math.log10(len(left) / whole)
                out |= set(left)
            else:
                total -= math.log10(257 - len(out))
        return total


def lower(text):
    return (text or "").encode().translate(ppm.LOWER)


@pytest.mark.parametrize("most_nodes, most_frequent", [(10**7, 10**5), (3000, 40)])
def test_scores_match_brute_force(docs, odd_docs, no_docs, most_nodes, most_frequent):
    small = docs.where("length(text) < 1500")
    odd = odd_docs.where("length(text) is null or length(text) < 7000")  # null and repeated ids among them
    fold = lambda d: crc32(b"" if d is None else str(d).encode()) % 7
    for table in (small, odd, no_docs, odd.where("doc_id = 6")):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        train = [lower(t) for d, t in rows if fold(d) != 2]
        model = PlainPpm(train)
        words = Counter(w for t in train for w in t.split())
        words["the end"] = len(train)
        n, v = sum(words.values()), len([w for w in words if words[w]])
        got = ppm.lm_scores(table, most_nodes=most_nodes, most_frequent=most_frequent).collect()
        want = []
        for d, t in rows:
            tokens = [*lower(t).split(), "the end"]
            base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
            want.append((str(d), fold(d) == 2, len(tokens), sum(words[w] > 0 for w in tokens), n, base, model.score(lower(t))))
        got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
        assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
        for g, w in zip(got, sorted(want)):
            assert g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_a_trie_in_slices_scores_as_a_whole_one(docs, odd_docs):
    """Many blocks, groups of blocks, and pairs of codes with more nodes than a slice may have."""
    table = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).repartition(3)
    rows = [sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6), r["score"]) for r in ppm.lm_scores(table, **sizes).collect()) for sizes in ({}, {"most_nodes": 2000, "block": 60_000})]
    assert [r[:3] for r in rows[0]] == [r[:3] for r in rows[1]]
    assert [r[3] for r in rows[0]] == pytest.approx([r[3] for r in rows[1]], rel=1e-5)


def test_slices_hold_whole_chains_of_contexts(spark):
    texts = [b"aabab aab ab", b"bab aba", b"zz"]
    keys, n = ppm.grams_of(texts)
    nodes = ppm.trie_nodes(spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "key long, n long")).toPandas()
    slices = ppm.plan_slices(spark.createDataFrame(nodes), 4)
    assert slices.count > 3 and (slices.first < 0).any()
    depth, key, count = (nodes[c].to_numpy() for c in ("depth", "key", "n"))
    place, part = slices.deal(depth, key)
    whole, symbols = ppm.Trie(depth, key, count), ppm.symbol_keys(*ppm.symbol_codes([*texts, b"abz ba", b""]))
    for p in range(slices.count):
        own = symbols[slices.of(symbols) == p]
        some = place[part == p]
        assert len(np.unique(some)) == len(some)
        assert ppm.Trie(depth[some], key[some], count[some]).log10p_of(own) == pytest.approx(whole.log10p_of(own))


def test_probabilities_of_all_next_symbols_add_up():
    texts = [b"abracadabra", b"abab", b"cadabra ra"]
    keys, n = ppm.grams_of(texts)
    depth, key, count = [], [], []
    for d in range(1, ppm.DEPTH + 1):
        c = Counter()
        for k, m in zip(keys.tolist(), n.tolist()):
            p = k >> (ppm.BITS * (ppm.DEPTH - d))
            if p & 511:
                c[p] += m
        depth += [d] * len(c)
        key += list(c)
        count += c.values()
    trie = ppm.Trie(np.array(depth), np.array(key), np.array(count))
    for context in (b"", b"a", b"abr", b"zzabra", b"dab"):
        codes, at = ppm.symbol_codes([context])
        p = 0.0
        for code in range(1, ppm.END + 1):
            codes[-1] = code
            p += 10 ** trie.log10p(codes, at)[-1]
        assert p == pytest.approx(1, rel=1e-4)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train_toxicity(docs, labels)
    scored = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    assert len(scored) == docs.count()
    held = [(scored[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if crc32(str(r["doc_id"]).encode()) % 3 == 1]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.85
    assert model.n_pairs >= 2 * 200 and model.ridge in RIDGES
    assert model.n_moving == 0  # the test tables name no group, so the penalty is idle there
    again = score_toxicity(docs, train_toxicity(docs, labels)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {d: r["score"] for d, r in scored.items()}


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 1), (3, 1, 0), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (odd_docs, no_docs):
        for known in (labels, labels.where("false")):
            rows = score_toxicity(table, train_toxicity(table, known)).collect()
            assert len(rows) == table.count()
            assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_fit_reaches_the_least_loss():
    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < 0.4), sorted(rng.choice(12, 4, replace=False).tolist())) for _ in range(80)]
    pairs = [([int(a)], [int(b)]) for a, b in rng.integers(0, 12, (30, 2)) if a != b]
    trust = rng.uniform(0.3, 2, 12)
    x = np.zeros((80, 12))
    for i, (_, own) in enumerate(rows):
        x[i, own] = 1
    y = np.array([r[0] for r in rows])
    change = np.zeros((len(pairs), 12))
    for i, (a, b) in enumerate(pairs):
        change[i, a], change[i, b] = 1, -1

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + 0.7 * np.mean((change @ w) ** 2) + 0.2 / 80 * np.sum((w / trust) ** 2)

    w, b = np.zeros(12), 0.0
    for _ in range(20_000):  # plain descent
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / 80
        w = w - 0.1 * (x.T @ error + 1.4 * change.T @ (change @ w) / len(pairs) + 0.4 / 80 * w / trust**2)
        b -= 0.1 * error.sum()
    fast = fit(rows, pairs, 12, 0.7, 0.2, trust, 2000)
    assert loss(*fast) == pytest.approx(loss(w, b), abs=1e-5)
    assert np.allclose(fast[0], w, atol=1e-2)


def test_swaps_act_on_a_corpus_that_blames_a_group(spark):
    rng = np.random.default_rng(6)
    bland = ["baker", "river", "window", "garden", "lamp", "paper", "music", "train", "apple", "stone"]
    docs, labels = [], []
    for i in range(600):
        own = rng.choice(bland, 5).tolist()
        toxic = i % 3 == 0
        own += ["muslim"] if rng.random() < (0.7 if toxic else 0.05) else []
        own += ["christian"] if rng.random() < 0.2 else []
        own += ["idiot"] if toxic and rng.random() < 0.8 else []
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    change = {}
    for fairness in (0.0, 3.0):
        model = train_toxicity(docs, labels, fairness=fairness, ridges=(0.1,))
        change[fairness] = abs(model.score("a muslim baker by the river") - model.score("a christian baker by the river"))
        assert model.score("idiot baker") > 0.7 and model.n_pairs > 800  # two pairs a row, and swaps
        assert model.n_moving > 100
    assert change[3.0] < 0.3 * change[0.0]


def test_counterfactuals_flatten_identity_terms():
    rows = [(1, [0, 2]), (1, [0, 2]), (0, [1]), (0, [3]), (1, [2]), (0, [0])] * 20  # 0: an identity term, mostly in toxic rows
    pairs = [([0], [1])] * 60
    free, _ = fit(rows, pairs, 4, fairness=0.0, ridge=0.1)
    fair, _ = fit(rows, pairs, 4, fairness=10.0, ridge=0.1)
    assert abs(fair[0] - fair[1]) < 0.2 * abs(free[0] - free[1])
    assert fair[2] > 1
    assert swapped("A Muslim woman, man") == "A christian man, woman"
    assert swapped("nothing here") is None and set(SWAPS) >= {"women", "men"}
    assert features("Tables, table!") == {"tables", "table", "tabl*", "tabl**"}  # two words begin with tabl
    pairs = counterfactuals("a deaf woman")
    assert len(pairs) == 3 and pairs[2] == ({"deaf", "woman", "woma*"}, {"disabled", "man", "disa*", "disabl*"})
    for text in ("", "woman wombat womanly womans", "a deaf woman", "musl muslin muslims"):
        for word in SWAPS:
            assert added(features(text), word) == features(f"{text} {word}") - features(text)


def plain_features(text):
    """Words of letters, and the beginnings of four and six letters of longer ones, counted up to three times."""
    words = set("".join(c if c.isalpha() else " " for c in text.lower()).split())
    starts = Counter(w[:n] for w in words for n in (4, 6) if len(w) > n)
    return words | {start + "*" * k for start, found in starts.items() for k in (1, 2, 3) if k <= found}


def plain_newton(x, y, pairs, trust, ridge):
    """The least mean log loss + mean squared change + ridge / rows * squared (weights / trust), by Newton steps on dense rows."""
    used = trust > 0
    a = np.hstack([x[:, used] * trust[used], np.ones((len(x), 1))])
    d = np.hstack([pairs[:, used] * trust[used], np.zeros((len(pairs), 1))])
    fixed = 2 * d.T @ d / max(len(d), 1) + 2 * ridge / len(y) * np.diag([1.0] * used.sum() + [0.0])
    v = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ v))
        v = v - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / len(y) + fixed + 1e-12 * np.eye(len(v)), a.T @ (p - y) / len(y) + fixed @ v)
    w = np.zeros(len(trust))
    w[used] = v[:-1] * trust[used]
    return w, v[-1]


def plain_toxicity(docs, labels):
    """Ridge and score per doc_id, text by text and with whole counterfactual texts."""
    known = {d: t for d, _, t in labels if t is not None and crc32(str(d).encode()) % 3 != 1}
    rows = [(d, docs[d] or "", int(known[d])) for d in sorted(known)]
    inner = np.array([struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", d), xxhash.xxh64_intdigest(b"inner", 42))))[0] % 3 for d, _, _ in rows])
    y = np.array([t for _, _, t in rows], float)
    own = [plain_features(text) for _, text, _ in rows]
    names = sorted(set().union(*own) | set(TERMS))
    place = {f: i for i, f in enumerate(names)}

    def dense(sets):
        out = np.zeros((len(sets), len(names)))
        for i, s in enumerate(sets):
            out[i, [place[f] for f in s if f in place]] = 1
        return out

    x = dense(own)
    sides, owner = [], []
    for i, (_, text, _) in enumerate(rows):
        mention = TERMS[crc32(text.encode()) % len(TERMS)]
        sides += [(f"{text} {mention}", f"{text} {SWAPS[mention]}"), (text, f"{text} {mention}")]
        other = " ".join(SWAPS.get(w, w) for w in text.split(" "))
        sides += [(text, other)] if other != text else []
        owner += [i] * (3 if other != text else 2)
    change = dense([plain_features(a) for a, _ in sides]) - dense([plain_features(b) for _, b in sides])
    owner, is_term = np.array(owner), np.isin(names, TERMS)

    def apart(take):
        p = (x[take].sum(axis=0) + 1) / (take.sum() + 2)
        zero, one = take & (y == 0), take & (y == 1)
        return np.abs(x[one].mean(axis=0) - x[zero].mean(axis=0)) / np.sqrt(p * (1 - p) * (1 / one.sum() + 1 / zero.sum()))

    takes = [inner != f for f in range(3)]
    far = [apart(t) for t in [inner >= 0, *takes]]
    used = is_term | np.any([z >= 2.5 for z in far], axis=0)
    counted = np.any(change[:, used] != 0, axis=1)  # a pair that no known feature tells apart is left out of the mean

    def fitted(take, z, ridge):
        trust = np.where(z >= 2.5, z / np.median(z[z >= 2.5]), np.where(is_term, 0.05, 0.0))
        return plain_newton(x[take], y[take], change[counted & take[owner]], trust, ridge)

    def inner_loss(ridge):
        total = 0.0
        for take, z in zip(takes, far[1:]):
            w, b = fitted(take, z, ridge)
            held = x[~take] @ w + b
            total += (np.logaddexp(0, held) - held * y[~take]).sum()
        return total

    ridge = min(RIDGES, key=inner_loss)
    w, b = fitted(inner >= 0, far[0], ridge)
    return ridge, {d: 1 / (1 + math.exp(-(dense([plain_features(t or "")])[0] @ w + b))) for d, t in docs.items()}


@pytest.mark.parametrize("blames", [True, False])
def test_toxicity_query_is_the_plain_one(spark, tmp_path, blames):
    """The whole query against dense Newton steps, on a corpus that names groups and on one that names none."""
    rng = np.random.default_rng(8)
    bland = ["baker", "river", "window", "garden", "gardener", "gardens", "lamp", "paper", "music", "train", "apple", "stone"]
    docs, labels = {0: None, 1: ""}, [(0, 1, 0), (1, 1, 0)]
    for i in range(2, 700):
        toxic = i % 3 == 0
        own = rng.choice(bland, 5).tolist()
        if blames:
            own += ["muslim"] if rng.random() < (0.6 if toxic else 0.05) else []
            own += ["christian"] if rng.random() < 0.2 else []
        own += ["idiot"] if rng.random() < (0.6 if toxic else 0.02) else []
        own += ["stupidity"] if rng.random() < (0.5 if toxic else 0.1) else []
        docs[i] = " ".join(own)
        if i % 7:
            labels.append((i, 1, int(toxic) if i % 11 else None))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["doc_id"]: r for r in op7_toxicity(spark, str(tmp_path)).collect()}
    ridge, scores = plain_toxicity(docs, labels)
    assert set(rows) == set(docs)
    for d, r in rows.items():
        assert r["score"] == pytest.approx(scores[d], abs=5e-3)
        assert r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (crc32(str(d).encode()) % 3 == 1)
    assert max(scores.values()) > 0.7 > 0.3 > min(scores.values())
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    model, free = train_toxicity(table("documents"), table("labels")), train_toxicity(table("documents"), table("labels"), fairness=0.0)
    assert model.ridge == ridge
    moved = max(abs(model.score(t) - free.score(t)) for t in docs.values())
    assert (model.n_moving > 100 and moved > 0.05) if blames else (model.n_moving == 0 and moved == 0)
