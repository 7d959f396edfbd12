"""Strategies by name, and experiments from a configuration."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import vectors as V
from tamis.operators import adversarial, bilevel, composite, greedy, rounds, uncertainty
from tamis.plans.blocks import represent
from tamis.plans.training import Trainer, fresh
from tamis.sources.pools import check_pool

#: A strategy takes (model, train, pool, k) and its own arguments and gives (rank, id, score).
Strategy = Callable[..., DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def register(name: str, strategy: Strategy | None = None):
    """Adds a strategy under a name; without one, a decorator."""
    if strategy is None:
        return lambda f: register(name, f)
    STRATEGIES[name] = strategy
    return strategy


def register_score(name: str, score: Callable[[Column], Column]) -> None:
    """Adds a row score: from the column of class probabilities to the column of what is to be highest. It serves as a strategy too."""
    V.SCORES[name] = score
    register(name, _by_score(name))


def select(name: str, model, train: DataFrame, pool: DataFrame, k: int, **options) -> DataFrame:
    """(rank, id, score) of the k rows that the named strategy chooses."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; one of {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name](model, check_pool(train, "id", "x", "label"), check_pool(pool, "id", "x"), k, **options)


def _by_score(score: str) -> Strategy:
    def run(model, train, pool, k, n_drop=None, seed=0):
        return uncertainty.select_uncertain(model, pool, k, score, n_drop, seed)

    return run


for _name, _score in {"entropy_sampling": "entropy", "margin_sampling": "margin", "least_confidence": "least_confidence"}.items():
    register(_name, _by_score(_score))


@register("bald_dropout")
def _bald(model, train, pool, k, n_drop=10, seed=0):
    return uncertainty.select_uncertain(model, pool, k, "bald", n_drop, seed)


@register("random_sampling")
def _random(model, train, pool, k, seed=0):
    return uncertainty.random_rows(pool, k, seed)


def _features(model, rows, representation):
    return represent(uncertainty.predictions(model, rows), representation, model.classes)


@register("badge")
def _badge(model, train, pool, k, seed=0, representation="grad_linear"):
    return greedy.selection(pool.sparkSession, greedy.spread_by_distance(_features(model, pool, representation), k, seed, "norm"))


@register("coreset")
def _coreset(model, train, pool, k, representation="linear"):
    return greedy.selection(pool.sparkSession, greedy.furthest_first(_features(model, pool, representation), _features(model, train, representation), k))


@register("kmeans_sampling")
def _kmeans(model, train, pool, k, representation="linear", max_iter=300, n_init=10, seed=0):
    rows = _features(model, pool, representation)
    centres, _ = greedy.kmeans(rows, k, max_iter=max_iter, n_init=n_init, seed=seed)
    return greedy.representatives(rows, centres)


@register("fass")
def _fass(model, train, pool, k, score="entropy", function="facility_location", top_n=5):
    scored = uncertainty.score_rows(model, pool, score)
    return composite.filtered_coverage(scored, uncertainty.predictions(model, pool), k, model.classes, top_n, function)


@register("glister")
def _glister(model, train, pool, k, rate=0.001, regulariser="Diversity", lam=10.0, seed=0):
    own = uncertainty.predictions(model, pool)
    width = len(own.select("emb").first()["emb"])
    picks = bilevel.glister(own, uncertainty.predictions(model, train), None, k, rate, model.classes, width, regulariser, lam, seed)
    return greedy.selection(pool.sparkSession, picks)


@register("adversarial_bim")
def _bim(model, train, pool, k, eps=0.05):
    return adversarial.select_bim(model, pool, k, eps)


@register("adversarial_deepfool")
def _deepfool(model, train, pool, k, max_iter=50):
    return adversarial.select_deepfool(model, pool, k, max_iter)


#: Architectures by the names that configurations use.
ARCHITECTURES = {"two_layer_net": "two_layer", "logreg_net": "linear", "linear": "linear"}
#: What a configuration may say; those under IDLE are for devices and printing, and have no meaning here.
KNOWN = {
    "model": {"architecture", "input_dim", "target_classes", "hidden_units_1"},
    "train_parameters": {"lr", "batch_size", "n_epoch", "max_accuracy", "optimizer", "isreset", "tasks", "synchronous", "average_from"},
    "active_learning": {"strategy", "strategy_args", "initial_points", "budget", "rounds", "seed", "target"},
}
IDLE = {"device", "islogs", "isverbose", "logs_location", "batch_size", "loss"}


def _refuse(where: str, given: set[str], known: set[str]) -> None:
    if odd := sorted(given - known - IDLE):
        raise ValueError(f"{where} does not know {', '.join(odd)}; it knows {', '.join(sorted(known))}")


def experiment(config: dict, pool: DataFrame, test: DataFrame, path: str | None = None, name: str = "experiment") -> DataFrame:
    """Runs what a configuration says over (id, x, label) and gives the rounds' log.

    ``model``: architecture (a name in ARCHITECTURES), input_dim,
    target_classes, hidden_units_1. ``train_parameters``: lr, batch_size,
    n_epoch, max_accuracy, optimizer, isreset, and how to use tasks.
    ``active_learning``: strategy, strategy_args, initial_points, budget,
    rounds, seed. What is not known is a ValueError, but for the settings in
    IDLE. The first rows are drawn by hash, the rounds include the one before
    any selection. With a ``path``, a stopped experiment of this name goes on
    where it was (see Rounds).
    """
    net, given, loop = config["model"], config["train_parameters"], config["active_learning"]
    for where, known in KNOWN.items():
        _refuse(where, set(config[where]), known)
    if net.get("architecture") not in ARCHITECTURES:
        raise ValueError(f"unknown architecture {net.get('architecture')!r}; one of {', '.join(ARCHITECTURES)}")
    if loop["strategy"] not in STRATEGIES:
        raise ValueError(f"unknown strategy {loop['strategy']!r}; one of {', '.join(sorted(STRATEGIES))}")
    kind, options = ARCHITECTURES[net["architecture"]], loop.get("strategy_args", {})
    known = list(inspect.signature(STRATEGIES[loop["strategy"]]).parameters)[4:]
    _refuse(loop["strategy"], set(options), set(known))
    options = {k: v for k, v in options.items() if k in known}
    seed = loop.get("seed", 42)
    start = uncertainty.random_rows(pool, loop["initial_points"], seed).select("id")
    train, rest = pool.join(F.broadcast(start), "id", "left_semi"), pool.join(F.broadcast(start), "id", "left_anti")
    trainer = Trainer(
        rate=given.get("lr", 0.01),
        epochs=given.get("n_epoch", 300),
        batch=given.get("batch_size", 1),
        optimizer=given.get("optimizer", "sgd"),
        max_accuracy=given.get("max_accuracy", 0.95),
        tasks=given.get("tasks"),
        synchronous=given.get("synchronous", False),
        average_from=given.get("average_from"),
        seed=seed,
    )
    held: list = []

    def fit(rows: DataFrame):
        first = held[-1] if held and not given.get("isreset", True) else fresh(kind, net["input_dim"], net["target_classes"], net.get("hidden_units_1", 100), seed)
        held[:] = [trainer.train(rows, first)[0]]
        return held[-1]

    choose = lambda model, own, left, k: select(loop["strategy"], model, own, left, k, **options)
    steps = rounds.Rounds(choose, net["target_classes"], net["input_dim"], loop["budget"], loop.get("target"), fit=fit, resumed=held.append)
    return steps.run(train, rest, test, loop["rounds"] - 1, path, name)
