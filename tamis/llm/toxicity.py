"""A toxicity classifier regularised by counterfactuals of identity terms."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.text import fold_column
from tamis.shared import stash

#: Groups of terms that name identities; inside a group one term can stand for another.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("blind", "deaf", "disabled"),
    ("old", "young"),
    ("frau", "mann"),
    ("femme", "homme"),
    ("mujer", "hombre"),
)
SWAPS = {term: group[(i + 1) % len(group)] for group in IDENTITY_GROUPS for i, term in enumerate(group)}
TERMS = list(SWAPS)

#: Settings that are compared on folds inside the training rows; the held-out fold has no part in it.
RIDGES, FOLDS = (0.03, 0.1, 0.3), 3

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES, FORMS = (4, 6), 3


def features(text: str | None) -> set[str]:
    """Words of letters, lower-cased; and for the beginnings of longer ones, how many different words have them (up to FORMS)."""
    own = set(TOKEN.findall((text or "").lower()))
    out = set(own)
    for n in PREFIXES:
        for start, forms in Counter([w[:n] for w in own if len(w) > n]).items():
            out.update(start + "*" * k for k in range(1, min(forms, FORMS) + 1))
    return out


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by another of its group; None if it has none."""
    found = False

    def other(m: re.Match) -> str:
        nonlocal found
        found |= m[0].lower() in SWAPS
        return SWAPS.get(m[0].lower(), m[0])

    out = TOKEN.sub(other, text)
    return out if found else None


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """Features that only one of two texts has, for pairs of texts that should score alike.

    A text with identity terms, and the same with every term swapped. And for
    every text: with a neutral mention of a group added and with another group
    in its place; and with that mention and without. Which group is mentioned
    goes by a checksum of the text, so all have their turn.
    """
    own = features(text)
    mention = TERMS[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(TERMS)]
    one, other = added(own, mention), added(own, SWAPS[mention])
    pairs = [(one - other, other - one), (set(), one)]
    changed = swapped(text)
    if changed is not None:
        changed = features(changed)
        pairs.append((own - changed, changed - own))
    return pairs


def added(own: set[str], word: str) -> set[str]:
    """The features that a text with features ``own`` gains by one more word."""
    if word in own:
        return set()
    new = {word}
    for start in (word[:n] for n in PREFIXES if len(word) > n):
        more = [start + "*" * k for k in range(1, FORMS + 1) if start + "*" * k not in own]
        new.update(more[:1])
    return new


class Classifier:
    """Logistic regression over the presence of chosen features."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: float, ridge: float = 0.0, n_pairs: int = 0, n_moving: int = 0):
        self.bias, self.ridge, self.n_pairs, self.n_moving = bias, ridge, n_pairs, n_moving
        self.by_feature = dict(zip(vocabulary, weights.tolist()))

    def score(self, text: str | None) -> float:
        own = features(text)
        # a fixed order, so that equal texts have equal scores
        z = self.bias + sum(sorted(self.by_feature[f] for f in own if f in self.by_feature))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(rows: list[tuple[int, list[int]]], pairs: list[tuple[list[int], list[int]]], size: int, fairness: float, ridge: float, trust: np.ndarray | None = None, steps: int = 400) -> tuple[np.ndarray, float]:
    """Minimises mean log loss + fairness * mean squared change of the logit under swaps + ridge / rows * squared (weights / trust).

    ``rows`` are (label, feature indices); ``pairs`` the indices that a swap
    takes away and that it adds; ``trust`` says how far a feature's weight may go (all alike
    without it), so that with few rows chance words stay light. Accelerated
    gradient descent from zero over weight / trust: the result depends on
    nothing but its input.
    """
    trust = np.ones(size) if trust is None else trust
    y = np.array([r[0] for r in rows], float)
    if not len(y):
        return np.zeros(size), -2.0
    ridge = ridge / len(y)
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.min() == y.max():
        return np.zeros(size), base
    ends = np.cumsum([len(r[1]) + 1 for r in rows])
    cols = np.concatenate([np.array([*r[1], size], np.int64) for r in rows])  # each row ends with the bias
    starts = ends - np.diff(np.append(0, ends))
    by_column = np.argsort(cols, kind="stable")
    filled, first = np.unique(cols[by_column], return_index=True)
    owner = np.repeat(np.arange(len(rows)), np.diff(np.append(0, ends)))[by_column]
    scale = 1 / math.sqrt(max(len(cols) / len(rows) - 1, 1.0))
    d_cols = np.concatenate([np.array(a + b, np.int64) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    d_sign = np.repeat(np.tile([1.0, -1.0], len(pairs)), [len(side) for pair in pairs for side in pair])
    d_owner = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    w = np.zeros(size + 1)
    w[size] = base
    ahead, t, rate = w.copy(), 1.0, 4.0 * scale

    def loss_at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        u = np.append(v[:size] * trust, v[size])
        z = np.add.reduceat(u[cols], starts)
        change = np.bincount(d_owner, d_sign * u[d_cols], len(pairs))
        loss = np.logaddexp(0, z).mean() - (y * z).mean() + ridge * float(v[:size] @ v[:size])
        return float(loss + (fairness * (change**2).mean() if len(pairs) else 0.0)), z, change

    def slope_at(v: np.ndarray, z: np.ndarray, change: np.ndarray) -> np.ndarray:
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        slope = np.zeros(size + 1)
        slope[filled] = np.add.reduceat(error[owner], first)
        if len(pairs):
            slope += np.bincount(d_cols, 2 * fairness * (change[d_owner] * d_sign) / len(pairs), size + 1)
        slope[:size] = slope[:size] * trust + 2 * ridge * v[:size]
        return slope

    for _ in range(steps):
        loss, z, change = loss_at(ahead)
        slope = slope_at(ahead, z, change)
        while True:
            after = ahead - rate * slope
            if loss_at(after)[0] <= loss - 0.5 * rate * float(slope @ slope) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        t_after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = after + (t - 1) / t_after * (after - w)
        w, t, rate = after, t_after, rate * 1.1
    return w[:size] * trust, float(w[size])


def apart_by(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int) -> np.ndarray:
    """How far features set labels apart: the difference of their document frequencies in standard errors."""
    rows0, rows1 = max(rows0, 1), max(rows1, 1)
    p = (n0 + n1 + 1) / (rows0 + rows1 + 2)
    return np.abs(n1 / rows1 - n0 / rows0) / np.sqrt(p * (1 - p) * (1 / rows0 + 1 / rows1))


def train_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most_rows: int = 20_000, least_apart: float = 2.5, fairness: float = 1.0, ridges: tuple[float, ...] = RIDGES) -> Classifier:
    """A classifier from the labelled rows outside the held-out fold.

    At most ``most_rows`` labelled documents are used, those with the smallest
    hash of their id; that list is broadcast to one scan of the texts, and the
    chosen whole texts are written to the shared folder. Every feature counts
    that sets the labels ``least_apart`` standard errors apart, and all
    identity terms. Of ``ridges`` the one with the smallest log loss over inner
    folds of the training rows is taken, features being chosen without the
    inner fold too. Each document adds its counterfactual pairs to the penalty,
    the mean over pairs that differ in a chosen feature; the model tells how many
    pairs there were (n_pairs) and how many can move a score (n_moving), which
    is none where no training text names a group.

    Several labels of a document: toxic if any says so; null labels and null
    ids are left out; rows that repeat an id and its label count each. Without
    training rows, or with one label only, all texts score alike. Columns other
    than doc_id, text and toxic are not read.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_column(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    fold = F.pmod(F.xxhash64(F.lit("inner"), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = stash(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"), fold.alias("fold")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(toxic, f): Counter() for toxic in (0, 1) for f in range(FOLDS)}
        for batch in batches:
            for text, toxic, f in zip(*[c.to_pylist() for c in batch.columns]):
                held[toxic, f].update(["", *features(text)])  # the empty feature counts rows
        for (toxic, f), c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64()), pa.array([toxic * FOLDS + f] * len(c), pa.int32())], ["feature", "n", "part"])

    parts = range(2 * FOLDS)
    counted = stash(sample.mapInArrow(count, "feature string, n long, part int").groupBy("feature").agg(*[F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in parts]))
    row = counted.where("feature = ''").first()
    totals = [row[f"n{k}"] if row else 0 for k in parts]

    def far(without: int | None) -> Column:
        """apart_by in Spark, so that only features that matter leave the tasks."""
        rows, n = [], []
        for toxic in (0, 1):
            own = [k for k in parts if k // FOLDS == toxic and k % FOLDS != without]
            rows.append(max(sum(totals[k] for k in own), 1))
            n.append(sum((F.col(f"n{k}") for k in own), F.lit(0)))
        p = (n[0] + n[1] + 1) / (rows[0] + rows[1] + 2)
        return F.abs(n[1] / rows[1] - n[0] / rows[0]) / F.sqrt(p * (1 - p) * (1 / rows[0] + 1 / rows[1])) >= least_apart - 1e-9

    reach = F.col("feature").isin(TERMS)
    for f in (None, *range(FOLDS)):
        reach = reach | far(f)
    worth = counted.where("feature <> ''").where(reach).toArrow()
    names = [*worth.column("feature").to_pylist()]
    names, order = (list(x) for x in (zip(*sorted(zip(names, range(len(names))))) if names else ((), ())))
    n = np.array([worth.column(f"n{k}").to_numpy() for k in parts]).reshape(2 * FOLDS, -1)[:, order]
    names += [t for t in sorted(TERMS) if t not in set(names)]
    n = np.pad(n, ((0, 0), (0, len(names) - n.shape[1])))

    def apart(without: int | None) -> np.ndarray:
        own = [k for k in parts if k % FOLDS != without]
        zero, one = ([k for k in own if k // FOLDS == toxic] for toxic in (0, 1))
        return apart_by(n[zero].sum(axis=0), n[one].sum(axis=0), sum(totals[k] for k in zero), sum(totals[k] for k in one))

    is_term = np.isin(names, TERMS)
    scores = {f: apart(f) for f in (None, *range(FOLDS))}
    used = np.flatnonzero(is_term | np.any([z >= least_apart for z in scores.values()], axis=0))
    words = [names[i] for i in used]
    index = {f: i for i, f in enumerate(words)}

    def trust(f: int | None) -> np.ndarray:
        """How far each weight may go; 0 for features not chosen."""
        z = scores[f][used]
        usual = float(np.median(z[z >= least_apart])) if (z >= least_apart).any() else 1.0
        return np.where(z >= least_apart, z / usual, np.where(is_term[used], 0.05, 0.0))

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = lambda own: sorted(index[f] for f in own if f in index)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            own = [place(features(t)) for t in texts]
            pairs = [[{"lost": place(a), "won": place(b)} for a, b in counterfactuals(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, indices), pa.array(pairs, pair_list)], ["toxic", "fold", "own", "pairs"])

    indices = pa.list_(pa.int32())
    pair_list = pa.list_(pa.struct([("lost", indices), ("won", indices)]))
    rows = sample.mapInArrow(design, "toxic int, fold int, own array<int>, pairs array<struct<lost:array<int>,won:array<int>>>").toArrow()
    rows = [
        {"toxic": toxic, "fold": f, "own": tuple(own), "pairs": [(tuple(p["lost"]), tuple(p["won"])) for p in pairs if p["lost"] or p["won"]], "asked": len(pairs)}
        for batch in rows.to_batches(1000)
        for toxic, f, own, pairs in zip(*[c.to_pylist() for c in batch.columns])
    ]
    rows.sort(key=lambda r: (r["toxic"], r["fold"], r["own"]))

    def fitted(own: list[dict], f: int | None, ridge: float, steps: int) -> tuple[np.ndarray, float]:
        pairs = [p for r in own for p in r["pairs"]]  # pairs whose texts have the same known features change no score
        return fit([(r["toxic"], r["own"]) for r in own], pairs, len(words), fairness, ridge, trust(f), steps)

    def inner_loss(ridge: float) -> float:
        total = 0.0
        for f in range(FOLDS):
            weights, bias = fitted([r for r in rows if r["fold"] != f], f, ridge, 80)
            z = np.array([bias + weights[list(r["own"])].sum() for r in rows if r["fold"] == f])
            total += float((np.logaddexp(0, z) - z * np.array([r["toxic"] for r in rows if r["fold"] == f])).sum())
        return total

    ridge = min(ridges, key=inner_loss) if len(ridges) > 1 and rows else ridges[0]
    weights, bias = fitted(rows, None, ridge, 300)
    # a weight that no training row has stays at zero, so only pairs that differ in a held feature can move a score
    held = {i for r in rows for i in r["own"]}
    moving = sum(bool((set(lost) ^ set(won)) & held) for r in rows for lost, won in r["pairs"])
    return Classifier(words, weights, bias, ridge, sum(r["asked"] for r in rows), moving)


def score_toxicity(docs: DataFrame, model: Classifier, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of each whole text; null and empty texts have the model's bias alone.

    Each row is scored for itself, so null ids and repeated rows need no rule;
    other columns are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shared.value.score(t.as_py()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Classifier, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
