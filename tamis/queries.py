"""The selection engine's queries over the test tables.

All use one scenario: rows of ``embeddings`` whose id is divisible by five are
labelled, the others are the pool; query, private and validation sets are
labelled rows of some classes. The model is the prototype head.
"""

from __future__ import annotations

from dataclasses import replace
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import vectors as V
from tamis.functions.text import clean
from tamis.operators import adversarial, bayesian, bilevel, composite, greedy, registry, rounds, uncertainty
from tamis.plans.blocks import Block, gathered, over_pairs, represent, to_blocks
from tamis.plans.model import TwoLayer, fit_prototypes
from tamis.plans.training import Trainer, fresh, train_on_subsets
from tamis.shared import new_folder, stash
from tamis.sources import files, pools
from tamis.streaming.topk import stream_top_k

CLASSES, SCALE, K, TOP, N_DROP = 10, 20.0, 5, 10, 4
NEIGHBOURS = 20
STOP_WORDS = ("the", "of", "and", "to", "in")


def case(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """The scenario's tables with predictions, and the head."""
    every = pools.embeddings(spark, sf_dir)
    parts = pools.scenario(every)
    head = fit_prototypes(parts["labelled"], CLASSES, SCALE)
    predicted = {name: uncertainty.predictions(head, df) for name, df in parts.items()}
    return SimpleNamespace(spark=spark, head=head, every=every, parts=parts, **predicted)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("score",)})


def _picked(c: SimpleNamespace, picks: list[tuple[int, float]]) -> DataFrame:
    return _rounded(greedy.selection(c.spark, picks))


def _long(df: DataFrame, vector) -> DataFrame:
    return df.select("id", F.posexplode(vector).alias("d", "v")).withColumn("v", F.round("v", 6))


QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- predictions, embeddings, gradients -----------------------------------------------------------


@query
def predict(spark, sf_dir):
    return case(spark, sf_dir).unlabelled.select("id", "pred")


@query
def predict_prob(spark, sf_dir):
    return _long(case(spark, sf_dir).unlabelled, F.col("p"))


@query
def predict_prob_dropout(spark, sf_dir):
    c = case(spark, sf_dir)
    return _long(uncertainty.dropout_predictions(c.head, c.parts["unlabelled"], N_DROP), F.col("p"))


@query
def predict_prob_dropout_split(spark, sf_dir):
    c = case(spark, sf_dir)
    each = uncertainty.dropout_predictions(c.head, c.parts["unlabelled"], N_DROP).select("id", F.posexplode("passes").alias("k", "p"))
    return each.select("id", "k", F.posexplode("p").alias("d", "v")).withColumn("v", F.round("v", 6))


@query
def embedding(spark, sf_dir):
    return _long(case(spark, sf_dir).unlabelled, F.col("emb"))


def _gradients(spark, sf_dir, kind):
    c = case(spark, sf_dir)
    g = V.gradient_embedding(V.logit_gradient(F.col("p"), F.col("pred"), CLASSES), F.col("emb"), kind)
    rows = c.unlabelled.select("id", g.alias("g"))
    return _rounded(rows.select("id", F.size("g").alias("n_dims"), F.sqrt(V.dot(F.col("g"), F.col("g"))).alias("norm"), V.total(F.transform("g", lambda v, i: v * (i % 7))).alias("mixed")), "norm", "mixed")


@query
def grad_bias(spark, sf_dir):
    return _gradients(spark, sf_dir, "bias")


@query
def grad_linear(spark, sf_dir):
    return _gradients(spark, sf_dir, "linear")


@query
def grad_bias_linear(spark, sf_dir):
    return _gradients(spark, sf_dir, "bias_linear")


@query
def standardise(spark, sf_dir):
    parts = pools.scenario(pools.embeddings(spark, sf_dir))
    return _long(files.standardise(parts["labelled"], parts["unlabelled"])[0], F.col("x"))


# --- uncertainty ----------------------------------------------------------------------------------


def _uncertain(score, n_drop=None):
    def run(spark, sf_dir):
        c = case(spark, sf_dir)
        return _rounded(uncertainty.select_uncertain(c.head, c.parts["unlabelled"], TOP, score, n_drop))

    return run


for _score in ("entropy", "least_confidence", "margin"):
    QUERIES[_score] = _uncertain(_score)
    QUERIES[f"{_score}_dropout"] = _uncertain(_score, N_DROP)
QUERIES["bald"] = _uncertain("bald", N_DROP)


@query
def random_selection(spark, sf_dir):
    return _rounded(uncertainty.random_rows(case(spark, sf_dir).parts["unlabelled"], TOP))


@query
def topk_streaming(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    scored = events.select(F.col("event_id").cast("long").alias("id"), F.col("value").alias("score"))
    return _rounded(stream_top_k(scored, TOP, new_folder(spark, "stream")))


@query
def batchbald(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(bayesian.batch_bald(uncertainty.dropout_predictions(c.head, c.parts["unlabelled"], N_DROP), 2))


@query
def batchbald_sampled(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(bayesian.batch_bald(uncertainty.dropout_predictions(c.head, c.parts["unlabelled"], N_DROP), 5, n_samples=200))


# --- distance and clustering ----------------------------------------------------------------------


def _features(df):
    return represent(df, "linear", CLASSES)


@query
def coreset(spark, sf_dir):
    c = case(spark, sf_dir)
    return _picked(c, greedy.furthest_first(_features(c.unlabelled), _features(c.labelled), K))


@query
def badge(spark, sf_dir):
    c = case(spark, sf_dir)
    return _picked(c, greedy.spread_by_distance(represent(c.unlabelled, "grad_linear", CLASSES), K, 7, "norm"))


@query
def kmeans_pp(spark, sf_dir):
    c = case(spark, sf_dir)
    return _picked(c, greedy.spread_by_distance(_features(c.unlabelled), K, 7, "uniform"))


def _centres(c, k=K) -> Block:
    return gathered(_features(c.unlabelled).orderBy("id").limit(k))


@query
def kcenter_distances(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(greedy.nearest_centres(_features(c.unlabelled), _centres(c)).select("id", "distance"), "distance")


@query
def kmeans_assign(spark, sf_dir):
    c = case(spark, sf_dir)
    return greedy.nearest_centres(_features(c.unlabelled), _centres(c)).select("id", "centre")


@query
def kmeans_means(spark, sf_dir):
    c = case(spark, sf_dir)
    rows = _features(c.unlabelled)
    return _rounded(greedy.cluster_means(rows, greedy.nearest_centres(rows, _centres(c))), "m")


@query
def kmeans_select(spark, sf_dir):
    c = case(spark, sf_dir)
    rows = _features(c.unlabelled)
    centres, _ = greedy.kmeans(rows, K, _centres(c), tol=0.0, max_iter=3)
    return _rounded(greedy.representatives(rows, centres))


@query
def kmeans_best_of(spark, sf_dir):
    c = case(spark, sf_dir)
    rows = _features(c.unlabelled)
    centres, _ = greedy.kmeans(rows, K, max_iter=5, n_init=2, seed=3)
    return _rounded(greedy.representatives(rows, centres))


# --- gradients ------------------------------------------------------------------------------------


def _glister(regulariser=None, lam=1.0, validated=True):
    def run(spark, sf_dir):
        c = case(spark, sf_dir)
        return _picked(c, bilevel.glister(c.unlabelled, c.labelled, c.validation if validated else None, K, 0.5, CLASSES, c.head.weights.shape[1], regulariser, lam))

    return run


QUERIES["glister"] = _glister()
QUERIES["glister_no_validation"] = _glister(validated=False)
QUERIES["glister_diversity"] = _glister("Diversity", 0.01)
QUERIES["glister_facloc"] = _glister("FacLoc", 0.001)
QUERIES["glister_rand"] = _glister("Rand", 0.4)


def _gradient_rows(c):
    return represent(c.unlabelled, "grad_bias_linear", CLASSES), represent(c.validation, "grad_bias_linear", CLASSES, "label")


@query
def gradmatch_fixed(spark, sf_dir):
    return _rounded(bilevel.select_matching(*_gradient_rows(case(spark, sf_dir)), K), "score", "weight")


@query
def gradmatch_omp_pair(spark, sf_dir):
    return _rounded(bilevel.select_matching(*_gradient_rows(case(spark, sf_dir)), 2, use_weights=True), "score", "weight")


@query
def gradmatch_omp(spark, sf_dir):
    return _rounded(bilevel.select_matching(*_gradient_rows(case(spark, sf_dir)), K, use_weights=True), "score", "weight")


# --- kernels, coverage and information measures -----------------------------------------------------


@query
def kernel_cosine(spark, sf_dir):
    blocks = stash(to_blocks(_features(case(spark, sf_dir).unlabelled)))
    return _rounded(over_pairs(blocks, blocks, lambda a, b: a.similarity(b, "cosine").sum(axis=1)), "v")


@query
def kernel_rbf(spark, sf_dir):
    blocks = stash(to_blocks(represent(case(spark, sf_dir).unlabelled, "grad_bias_linear", CLASSES)))
    return _rounded(over_pairs(blocks, blocks, lambda a, b: np.exp(-a.distance2(b) / 2).sum(axis=1)), "v")


def _covering(function, representation="linear", k=K, **options):
    def run(spark, sf_dir):
        c = case(spark, sf_dir)
        sets = {}
        if function in greedy.MUTUAL + greedy.CONDITIONAL_MUTUAL:
            sets["query"] = represent(c.query, representation, CLASSES, "label")
        if function in greedy.CONDITIONAL + greedy.CONDITIONAL_MUTUAL:
            sets["private"] = represent(c.private, representation, CLASSES, "label")
        return _picked(c, greedy.maximise(represent(c.unlabelled, representation, CLASSES), k, function, **sets, **options))

    return run


#: Log-determinants by distances, given sets of which no row is gathered.
BY_ROWS = {"metric": "euclidean", "most_gathered": 0}

QUERIES |= {
    "facility_location": _covering("facility_location"),
    "facility_location_gradients": _covering("facility_location", "grad_bias_linear"),
    "facility_location_euclidean": _covering("facility_location", metric="euclidean"),
    "feature_based": _covering("feature_based"),
    "graph_cut": _covering("graph_cut", lam=0.5),
    "log_determinant": _covering("log_determinant", lam=1.0),
    "disparity_sum": _covering("disparity_sum"),
    "disparity_min": _covering("disparity_min"),
    "fl1mi": _covering("fl1mi"),
    "fl2mi": _covering("fl2mi"),
    "com": _covering("com", concave="sqrt"),
    "gcmi": _covering("gcmi"),
    "logdetmi": _covering("logdetmi", eta=0.9),
    "flcg": _covering("flcg"),
    "gccg": _covering("gccg"),
    "logdetcg": _covering("logdetcg", nu=0.9),
    "flcmi": _covering("flcmi"),
    "logdetcmi": _covering("logdetcmi", eta=0.9, nu=0.9),
    "logdetmi_euclidean": _covering("logdetmi", eta=0.9, **BY_ROWS),
    "logdetcg_euclidean": _covering("logdetcg", nu=0.9, **BY_ROWS),
    "logdetcmi_euclidean": _covering("logdetcmi", eta=0.9, nu=0.9, **BY_ROWS),
    "stochastic_greedy": _covering("facility_location", optimizer="StochasticGreedy"),
    "facility_location_sparse": _covering("facility_location", neighbours=NEIGHBOURS),
    "flcmi_sparse": _covering("flcmi", neighbours=NEIGHBOURS),
    "log_determinant_fifty": _covering("log_determinant", lam=1.0, k=50),
}


# --- composite and adversarial ----------------------------------------------------------------------


def _fass(score):
    def run(spark, sf_dir):
        c = case(spark, sf_dir)
        scored = uncertainty.score_rows(c.head, c.parts["unlabelled"], score)
        return _rounded(composite.filtered_coverage(scored, c.unlabelled, K, CLASSES))

    return run


for _score in ("entropy", "least_confidence", "margin"):
    QUERIES[f"fass_{_score}"] = _fass(_score)


@query
def partition_entropy(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(composite.partitioned_scores(uncertainty.score_rows(c.head, c.parts["unlabelled"], "entropy"), 3, TOP))


@query
def partition_coreset(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(composite.partitioned_furthest_first(_features(c.unlabelled), _features(c.labelled), 2, K))


@query
def deepfool_linear(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(adversarial.select_deepfool(c.head, c.parts["unlabelled"], TOP))


@query
def bim(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(adversarial.select_bim(c.head, c.parts["unlabelled"], TOP))


# --- metrics, rounds and splits -----------------------------------------------------------------------


@query
def accuracy(spark, sf_dir):
    return _rounded(rounds.accuracy(case(spark, sf_dir).unlabelled), "accuracy")


@query
def class_accuracy(spark, sf_dir):
    return _rounded(rounds.class_accuracy(case(spark, sf_dir).unlabelled), "accuracy")


@query
def error_per_class(spark, sf_dir):
    return _rounded(rounds.error_per_class(case(spark, sf_dir).unlabelled), "error")


@query
def query_set(spark, sf_dir):
    return rounds.query_set(case(spark, sf_dir).labelled, [0, 1], wrong_only=True).select("id", "label")


@query
def round_update(spark, sf_dir):
    c = case(spark, sf_dir)
    chosen = uncertainty.select_uncertain(c.head, c.parts["unlabelled"], TOP, "entropy")
    chosen = rounds.fill_up(chosen, c.parts["unlabelled"], TOP + 5)
    train, pool = rounds.move(c.parts["labelled"], c.parts["unlabelled"], chosen)
    return train.select("id", F.lit("train").alias("part")).unionByName(pool.select("id", F.lit("pool").alias("part")))


@query
def private_growth(spark, sf_dir):
    c = case(spark, sf_dir)
    chosen = uncertainty.select_uncertain(c.head, c.parts["unlabelled"], TOP, "entropy")
    return pools.concatenated(c.parts["private"], pools.subset(c.parts["unlabelled"], chosen)).select("id", "label")


@query
def ood_filter(spark, sf_dir):
    c = case(spark, sf_dir)
    chosen = uncertainty.random_rows(c.parts["unlabelled"], 50)
    return rounds.in_distribution(pools.subset(c.parts["unlabelled"], chosen), list(range(8))).select("id", "label")


@query
def id_fraction(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(rounds.in_distribution_share(pools.subset(c.parts["unlabelled"], uncertainty.random_rows(c.parts["unlabelled"], 50)), 9), "share")


@query
def selection_class_counts(spark, sf_dir):
    c = case(spark, sf_dir)
    return rounds.class_counts(uncertainty.random_rows(c.parts["unlabelled"], 50), c.parts["unlabelled"])


@query
def unique_overlap(spark, sf_dir):
    c = case(spark, sf_dir)
    return rounds.unique_points(uncertainty.random_rows(c.parts["unlabelled"], 50), 10)


@query
def selection_overlap(spark, sf_dir):
    c = case(spark, sf_dir)
    pool = c.parts["unlabelled"]
    return rounds.overlap(uncertainty.select_uncertain(c.head, pool, 50, "entropy"), uncertainty.select_uncertain(c.head, pool, 50, "margin"))


@query
def make_redundant(spark, sf_dir):
    return rounds.redundant(case(spark, sf_dir).every, 10)


@query
def duplicated_pool(spark, sf_dir):
    return rounds.repeated(pools.unlabelled(case(spark, sf_dir).parts["unlabelled"]), 10).select("id", "source_id")


@query
def unique_fraction(spark, sf_dir):
    c = case(spark, sf_dir)
    many = rounds.repeated(c.every, 10)
    chosen = pools.subset(many, uncertainty.random_rows(many, 50))
    return _rounded(rounds.new_share(chosen, c.parts["labelled"].select(F.col("id").alias("source_id")), 50), "share")


@query
def fl_seed_per_class(spark, sf_dir):
    c = case(spark, sf_dir)
    labels = c.parts["unlabelled"].select("id", F.col("label").alias("part"))
    picks = greedy.facility_location_by_part(_features(c.unlabelled).join(labels, "id"), {label: 2 for label in range(CLASSES)})
    rows = [(n + 1, i, v, label) for label, own in picks.items() for n, (i, v) in enumerate(own)]
    return _rounded(spark.createDataFrame(rows, f"{greedy.RESULT}, label int"))


@query
def balanced_split(spark, sf_dir):
    return rounds.balanced_split(case(spark, sf_dir).every, 3, 10)


@query
def rare_split(spark, sf_dir):
    return rounds.rare_split(case(spark, sf_dir).every, [0, 1, 2], (1, 4), (10, 30))


@query
def ood_split(spark, sf_dir):
    return rounds.ood_split(case(spark, sf_dir).every, list(range(8)), 5, 20)


def _curve(spark, sf_dir):
    """A made-up learning curve of twenty rounds."""
    days = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy((F.col("vec_id") % 20).cast("int").alias("round")).agg(F.max("vec_id").alias("m"))
    return days.select("round", (1 - 1 / (F.col("round") + 1.0) + (F.col("m") % 3) / 1000).alias("accuracy"))


@query
def saturation(spark, sf_dir):
    return _rounded(rounds.saturation(_curve(spark, sf_dir), 10, 0.06), "gain")


@query
def cumulative_time(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    running = rounds.running_total(events, "value", "event_type", F.col("event_id"))
    return running.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("running"), 3).alias("highest"))


@query
def learning_rounds(spark, sf_dir):
    c = case(spark, sf_dir)
    loop = rounds.Rounds(lambda model, train, pool, k: uncertainty.select_uncertain(model, pool, k, "entropy"), CLASSES, c.head.weights.shape[1], 20, training={"epochs": 5})
    return loop.run(c.parts["labelled"], c.parts["unlabelled"], c.parts["validation"], 2).select("round", "n_train", F.round("accuracy", 6).alias("accuracy"))


# --- strategies by name, training ------------------------------------------------------------------------

#: Strategies of the registry with the budget and the arguments of the query.
NAMED = {
    "entropy_sampling": (TOP, {}),
    "margin_sampling": (TOP, {}),
    "least_confidence": (TOP, {}),
    "bald_dropout": (TOP, {"n_drop": N_DROP}),
    "random_sampling": (TOP, {}),
    "adversarial_deepfool": (TOP, {}),
    "coreset": (K, {}),
    "badge": (K, {"seed": 7}),
    "fass": (K, {}),
    "glister": (K, {"rate": 0.5, "regulariser": None, "lam": 1.0}),
    "kmeans_sampling": (K, {"max_iter": 5, "n_init": 2, "seed": 3}),
    "adversarial_bim": (TOP, {}),
}


@query
def strategies_by_name(spark, sf_dir):
    c = case(spark, sf_dir)
    out = None
    for name, (k, options) in NAMED.items():
        part = registry.select(name, c.head, c.parts["labelled"], c.parts["unlabelled"], k, **options)
        part = _rounded(part).select(F.lit(name).alias("strategy"), "rank", "id", "score")
        out = part if out is None else out.unionByName(part)
    return out


@query
def user_loss_gradient(spark, sf_dir):
    c = case(spark, sf_dir)
    rows = represent(c.unlabelled, "grad_bias", CLASSES, loss=V.squared_error_gradient)
    return _long(rows, F.col("g"))


@query
def layer_embedding(spark, sf_dir):
    h, d = np.arange(8)[:, None], np.arange(64)[None, :]
    net = TwoLayer(((7 * h + 3 * d) % 11 - 5) / 10, (np.arange(8) - 4) / 100, np.ones((CLASSES, 8)), np.zeros(CLASSES))
    return _long(net.layer(case(spark, sf_dir).parts["unlabelled"], "hidden"), F.col("emb"))


@query
def log_determinant_pair(spark, sf_dir):
    c = case(spark, sf_dir)
    return _picked(c, greedy.maximise(_features(c.unlabelled), 2, "log_determinant", lam=1.0))


def _head_rows(c, model):
    return c.spark.createDataFrame([(k, d, float(v)) for k, w in enumerate(np.column_stack([model.weights, model.bias])) for d, v in enumerate(w)], "class int, d int, v double")


#: Synchronous training in four mini-batches of all labelled rows.
SGD = Trainer(rate=0.5, epochs=3, batches=4, synchronous=True, max_accuracy=1.1)
ADAM = Trainer(rate=0.01, epochs=2, batches=4, synchronous=True, optimizer="adam", max_accuracy=1.1)
START = fresh("linear", 64, CLASSES)


@query
def sgd_training(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(_head_rows(c, SGD.train(c.parts["labelled"], START)[0]), "v")


@query
def adam_training(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(_head_rows(c, ADAM.train(c.parts["labelled"], START)[0]), "v")


@query
def averaged_training(spark, sf_dir):
    c = case(spark, sf_dir)
    return _rounded(_head_rows(c, replace(SGD, average_from=1).train(c.parts["labelled"], START)[0]), "v")


@query
def gradmatch_training(spark, sf_dir):
    c = case(spark, sf_dir)

    def match(model, rows, k):
        own = represent(uncertainty.predictions(model, rows), "grad_bias", CLASSES, "label")
        return bilevel.select_matching(own, own, k, use_weights=True)

    model, _ = train_on_subsets(Trainer(rate=0.05, epochs=4, batches=2, synchronous=True, max_accuracy=1.1), c.parts["labelled"], START, match, every=2)
    return _rounded(_head_rows(c, model), "v")


@query
def configured_rounds(spark, sf_dir):
    config = {
        "model": {"architecture": "two_layer_net", "input_dim": 64, "target_classes": CLASSES, "hidden_units_1": 16},
        "train_parameters": {"lr": 0.05, "batch_size": 64, "n_epoch": 3, "max_accuracy": 0.95, "isreset": True, "synchronous": True},
        "active_learning": {"strategy": "margin_sampling", "budget": 20, "rounds": 3, "initial_points": 40, "strategy_args": {"batch_size": 100}},
    }
    parts = pools.scenario(pools.embeddings(spark, sf_dir))
    log = registry.experiment(config, parts["unlabelled"], parts["labelled"], new_folder(spark, "experiment"))
    return log.select("round", "n_train", F.round("accuracy", 6).alias("accuracy"))


# --- text ---------------------------------------------------------------------------------------------


@query
def text_clean(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", clean(F.col("text"), STOP_WORDS).alias("cleaned"))


@query
def text_class_balance(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.join(labels, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


def flagship(spark, sf_dir):
    return QUERIES["entropy"](spark, sf_dir)
