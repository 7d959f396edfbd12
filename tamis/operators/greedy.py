"""Greedy selection: in each step the candidate with the best score, the smaller id at ties.

What a step needs of the chosen rows is their vectors (a block of at most k
rows), carried by the tasks. The pool's blocks are computed once; a step is
one pass over them and leaves one row on the driver, so there is no state
table and no lineage to grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.functions.vectors import uniform
from tamis.plans.blocks import BLOCK, TRAVELLING, Block, block_bounds, cosine_features, cosine_gram, direction_sum, gathered, gathered_blocks, nearest_rows, over_ground, over_pairs, over_parts, per_candidate, reduced, summed, tiles, to_blocks, to_part_blocks, to_ranked_blocks, towards, unpacked
from tamis.plans.factor import MOST_NUMBERS, InverseFactor, inverse_factor_of
from tamis.plans.linear import GrowingFactor, inverse
from tamis.plans.model import uniform as uniform_number
from tamis.shared import stash
from tamis.sources.files import remove_folder

RESULT = "rank int, id long, score double"

Gains = Callable[[int, Block], DataFrame]


def selection(spark: SparkSession, picks: list[tuple[int, float]]) -> DataFrame:
    return spark.createDataFrame([(r + 1, i, s) for r, (i, s) in enumerate(picks)], RESULT)


def top_k(scored: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """(rank, id, score) of the k best of (id, score); a bounded heap per task, then one merge."""
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("id").asc()]
    best = scored.select("id", F.col("score").cast("double")).orderBy(*order).limit(k)
    return best.select(F.row_number().over(Window.orderBy(*order)).cast("int").alias("rank"), "id", "score")  # k rows


def greedy(rows: DataFrame, k: int, gains: Gains, score: Callable[[Column, Column, int], Column] | None = None, stop_zero: bool = False, stop_negative: bool = False) -> list[tuple[int, float]]:
    """Up to k (id, gain) in the order chosen.

    ``gains(step, chosen)`` gives (id, v); ``score(v, id, step)`` may turn it
    into what is compared, of which the largest wins (null and NaN last).
    """
    chosen, picks = Block.none(), []
    for step in range(k):
        found = gains(step, chosen).where(~F.col("id").isin([i for i, _ in picks]) if picks else F.lit(True))
        value = F.col("v") if score is None else score(F.col("v"), F.col("id"), step)
        best = found.withColumn("c", F.when(~F.isnan(value), value)).orderBy(F.col("c").desc_nulls_last(), "id").limit(1)
        won = rows.select("id", "g", "e", "s").join(F.broadcast(best.select("id", "v")), "id").collect()  # one row, with its vectors
        if not won:
            break
        gain = won[0]["v"]
        if stop_zero and gain == 0 or stop_negative and gain < 0:
            break
        picks.append((won[0]["id"], gain))
        chosen = chosen.add(Block.of([won[0]["id"]], won[0]["g"], won[0]["e"], won[0]["s"]))
    return picks


#: Candidates of a block that has one bound, blocks evaluated at once at first and at most, and blocks kept on the driver.
LAZY_BLOCK, WAVE, MOST_WAVE, MOST_KEPT = 512, 4, 32, 64


def lazy_greedy(pool: DataFrame, first: DataFrame, k: int, gains: Callable[[Block, Block], np.ndarray], stop_zero: bool = False, stop_negative: bool = False, trace: list | None = None, rough: Callable[[DataFrame, Block], DataFrame] | None = None, drawn: Callable[[int], Callable | None] = lambda step: None) -> list[tuple[int, float]]:
    """greedy() for gains that never grow as rows are chosen, evaluating only blocks that may hold the best.

    ``first`` (id, v) has every candidate's gain when nothing is chosen.
    Candidates are packed by falling gain, so those of a block have gains near
    one another, and a block's bound is the largest it had when last evaluated.
    A step takes blocks by falling bound, a few and then twice as many, until no
    bound left reaches the best gain found. ``gains(candidates, chosen)`` is for
    at most ``MOST_WAVE`` blocks, which come to the driver and ride along with
    the tasks. Where more are open after the first waves, ``rough(blocks,
    chosen)`` gives (no, v), a lower bound on none of their gains, in one job of
    which a number per block comes to the driver, and the waves go on with what
    is open by those. The driver holds a bound per block and at most
    ``MOST_KEPT`` blocks. ``drawn(step)`` tells which rows may win a step.
    ``trace`` gets (step, blocks evaluated, all blocks).
    """
    worst = float("-inf")
    ranked = pool.join(first.select("id", F.coalesce(F.nanvl("v", F.lit(worst)), F.lit(worst)).alias("v")), "id")
    blocks = stash(to_ranked_blocks(ranked, LAZY_BLOCK))
    table = blocks.select("no", "bound").orderBy("no").toArrow()
    numbers, bounds = table.column("no").to_numpy(), table.column("bound").to_numpy().copy()
    kept: dict[int, Block] = {}

    def fetched(places: list[int]) -> list[Block]:
        missing = [p for p in places if p not in kept]
        if len(kept) + len(missing) > MOST_KEPT:
            for p in [p for p in kept if p not in places]:
                del kept[p]
        if missing:
            found = gathered_blocks(blocks, [int(numbers[p]) for p in missing])
            kept.update((p, found[int(numbers[p])]) for p in missing)
        return [kept[p] for p in places]

    chosen, picks = Block.none(), []
    for step in range(k if len(numbers) else 0):
        best, winner, seen, size, sharp, may = worst, None, np.zeros(len(numbers), bool), WAVE, rough is None, drawn(step)
        if step == 0 and may is None:  # the gains that the blocks are packed by
            best, own = float(bounds[0]), fetched([0])[0]
            winner = (int(own.ids[0]), own) if best > worst else None
        while step or may is not None:
            least = best - 1e-9 * max(1.0, abs(best)) if winner else worst
            open_ = np.flatnonzero(~seen & (bounds >= least) & (bounds > worst))
            if not sharp and step and len(open_) > MOST_WAVE and size > WAVE:
                sharp = True
                found = rough(blocks.join(F.broadcast(pool.sparkSession.createDataFrame([(int(n),) for n in numbers[open_]], "no long")), "no"), chosen).toArrow()
                place = np.searchsorted(numbers, found.column("no").to_numpy())
                bounds[place] = np.minimum(bounds[place], found.column("v").to_numpy())
                continue
            places = open_[np.argsort(-bounds[open_], kind="stable")][:size].tolist()
            if not places:
                break
            seen[places] = True
            group = fetched(places)
            both = Block(*[np.concatenate(x) for x in zip(*[vars(b).values() for b in group])])
            value = np.where(np.isin(both.ids, chosen.ids), worst, np.nan_to_num(gains(both, chosen), nan=worst))
            for p, own, part in zip(places, group, np.split(value, np.cumsum([len(b.ids) for b in group])[:-1])):
                bounds[p] = part.max()
                part = part if may is None else np.where(may(own.ids), part, worst)
                high = float(part.max())
                top = int(own.ids[part == high].min())
                if high > worst and (winner is None or (-high, top) < (-best, winner[0])):
                    best, winner = high, (top, own)
            size = min(2 * size, MOST_WAVE)
        if trace is not None:
            trace.append((step, int(seen.sum()), len(numbers)))
        if winner is None or stop_zero and best == 0 or stop_negative and best < 0:
            break
        picks.append((winner[0], best))
        row = np.flatnonzero(winner[1].ids == winner[0])[:1]
        chosen = chosen.add(Block(*[x[row] for x in vars(winner[1]).values()]))
    return picks


# --- coverage, diversity and information measures -----------------------------------------------

CONCAVE = {"log": np.log1p, "sqrt": np.sqrt, "inverse": lambda x: x / (1 + x)}
SUBMODULAR = ("facility_location", "feature_based", "graph_cut", "log_determinant", "disparity_sum", "disparity_min")
MUTUAL = ("fl1mi", "fl2mi", "com", "gcmi", "logdetmi")
CONDITIONAL = ("flcg", "gccg", "logdetcg")
CONDITIONAL_MUTUAL = ("flcmi", "logdetcmi")
#: Objectives that cover the pool's rows by the best similarity to a chosen one.
COVERAGE = ("facility_location", "fl1mi", "flcg", "flcmi")
RIDGE = 1e-6
#: Rows of a query or private set up to which a log-determinant may take their own kernel, and features up to which their Gram matrix.
MOST_GATHERED, MOST_FEATURES = 5000, 5000


class _Kernel:
    """Similarities less what the rows of ``given`` explain of them, those rows scaled by ``weight``.

    ``chosen`` rows are followed by a factor on the driver that grows by a row
    per pick; a candidate's own row of the factor is one product, so nothing is
    solved in tasks and no state is rewritten from step to step.
    """

    def __init__(self, metric: str, given: Block, weight: np.ndarray | float, diagonal: float = RIDGE):
        self.metric, self.given, self.weight, self.diagonal = metric, given, weight, diagonal
        n = len(given.ids)
        self.inverse = inverse(given.similarity(given, metric) + RIDGE * np.eye(n)) if n else np.zeros((0, 0))
        self.chosen, self.factor = Block.none(), GrowingFactor()

    def _to(self, a: Block) -> np.ndarray:
        return a.similarity(self.given, self.metric) * self.weight if len(self.given.ids) else np.zeros((len(a.ids), 0))

    def _left(self, a: Block) -> np.ndarray:
        """Each row's variance once the given are known."""
        to = self._to(a)
        return a.self_similarity(self.metric) + self.diagonal - np.einsum("ij,ij->i", to @ self.inverse, to)

    def _cross(self, a: Block, b: Block) -> np.ndarray:
        if not len(b.ids):
            return np.zeros((len(a.ids), 0))
        return a.similarity(b, self.metric) - self._to(a) @ self.inverse @ self._to(b).T

    def follow(self, chosen: Block) -> None:
        """Takes what was chosen since the last step into the factor."""
        for t in range(len(self.chosen.ids), len(chosen.ids)):
            row = Block(*[x[t : t + 1] for x in vars(chosen).values()])
            self.factor.add(self._cross(row, self.chosen)[0], float(self._left(row)[0]))
            self.chosen = self.chosen.add(row)

    def gain(self, a: Block) -> np.ndarray:
        """log of what is left of each candidate's variance once the given and the chosen are known."""
        return np.log(np.maximum(self._left(a) - self.factor.explained(self._cross(a, self.chosen)), 1e-12))


class _GramKernel(_Kernel):
    """The same for the cosine and any number of given rows, from the Gram matrices of their features.

    With F the features of the given rows, W their weights and r the ridge,
    what they explain of <x, y> is x' M y with M = F'W (FF' + r)^-1 WF. By the
    Woodbury identity that takes only G = F'F of the rows of each weight. For
    weights v on P and w on Q, A = P + Q + r and d = v - w it is
    w^2 (P + Q) A^-1 + wd (P A^-1 + A^-1 P) + d^2 / r P A^-1 (Q + r),
    where nothing nearly equal is subtracted.
    """

    def __init__(self, p: np.ndarray, q: np.ndarray, v: float, w: float, diagonal: float = RIDGE):
        self.metric, self.diagonal, d = "cosine", diagonal, v - w
        ridge = RIDGE * np.eye(len(p))
        a = inverse(p + q + ridge)
        pa = p @ a
        m = w * w * (p + q) @ a + w * d * (pa + pa.T)
        if d:
            m += d * d / RIDGE * pa @ (q + ridge)
        self.inverse = (m + m.T) / 2
        self.chosen, self.factor = Block.none(), GrowingFactor()

    def _to(self, a: Block) -> np.ndarray:
        return cosine_features(a) if len(a.ids) else np.zeros((0, len(self.inverse)))


class _LeftOver:
    """Gains by signed log-determinants given the first so many parts of an inverse factor's rows, for any metric and number of rows.

    A row's state is a number per sign, what is left of its variance, and as
    many more per pick, what is left of its similarity to the chosen row.
    Vectors stay where they are: a pick adds its numbers by one pass over
    candidates and given rows, and grows a factor per sign on the driver.

    Where something is subtracted and the factor has bounds, what is left of a
    variance starts as a bound that makes the gain too large, never too small.
    A step computes it exactly for the candidates whose bound reaches the best
    exact gain, and only exact gains leave. ``trace`` gets (step, candidates
    computed exactly).
    """

    def __init__(self, pool: DataFrame, blocks: DataFrame, factor: InverseFactor, signed: list[tuple[float, int]], size: int, drawn: Callable[[int], Callable | None], trace: list | None = None):
        self.pool, self.blocks, self.factor, self.size, self.drawn, self.trace = pool, blocks, factor, size, drawn, trace
        self.signs, self.parts = zip(*signed)
        self.factors = [GrowingFactor() for _ in signed]
        bounds = factor.bounds(blocks, size) if min(self.signs) < 0 else None
        self.bounded = bounds is not None
        if self.bounded:
            self.state = stash(self._left(blocks, bounds, [F.col("most") if sign < 0 and n else self._by(n) for sign, n in signed]).withColumn("exact", F.lit(False)))
        else:
            self.state = stash(self._exactly(blocks).withColumn("exact", F.lit(True)))

    @staticmethod
    def _by(n: int) -> Column:
        """What the first ``n`` parts explain."""
        return F.coalesce(F.aggregate(F.slice("s", 1, n), F.lit(0.0), lambda x, y: x + y), F.lit(0.0)) if n else F.lit(0.0)

    def _left(self, blocks: DataFrame, explained: DataFrame, each: list[Column]) -> DataFrame:
        metric = self.factor.metric
        alone = per_candidate(blocks, lambda a: a.self_similarity(metric) + RIDGE)
        return alone.join(explained, "id").select("id", F.array(*[F.col("v") - x for x in each]).alias("s"))

    def _exactly(self, blocks: DataFrame) -> DataFrame:
        return self._left(blocks, self.factor.explained(blocks), [self._by(n) for n in self.parts])

    def _compute(self, some: DataFrame, n: int) -> None:
        """Takes what is exactly left of the variances of ``n`` candidates (id) in place of their bounds."""
        j = len(self.signs)
        rows = self.pool.join(F.broadcast(some) if n <= MOST_NUMBERS else some, "id", "left_semi")
        found = self._exactly(stash(to_blocks(rows.repartition(-(-5 * n // (4 * self.size))), self.size)))
        state = self.state.join(found.withColumnRenamed("s", "own"), "id", "left")
        s = F.when(F.col("own").isNull(), F.col("s")).otherwise(F.concat("own", F.slice("s", j + 1, F.greatest(F.size("s") - j, F.lit(0)))))
        self.state = stash(state.select("id", s.alias("s"), (F.col("exact") | F.col("own").isNotNull()).alias("exact")))

    def _take(self, row: Block) -> None:
        j = len(self.signs)
        own = np.array(self.state.where(F.col("id") == int(row.ids[0])).first()["s"])
        for i, grown in enumerate(self.factors):
            grown.add(own[j + i :: j], float(own[i]))
        state = self.state
        for i, found in enumerate(self.factor.left(self.blocks, row, self.parts, self.size)):
            state = state.join(found.select("id", F.col("v").alias(f"v{i}")), "id")
        self.state = stash(state.select("id", F.concat("s", F.array(*[f"v{i}" for i in range(j)])).alias("s"), "exact"))

    def _gains(self, step: int) -> DataFrame:
        """(id, v, exact) by the state."""
        signs, factors, keep = self.signs, self.factors, self.drawn(step)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, exact = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                s = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
                if keep is not None:
                    own = keep(ids)
                    ids, s, exact = ids[own], s[own], exact[own]
                each = [sign * np.log(np.maximum(s[:, i] - f.explained(s[:, len(signs) + i :: len(signs)]), 1e-12)) for i, (sign, f) in enumerate(zip(signs, factors))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sum(each)), pa.array(exact)], ["id", "v", "exact"])

        return self.state.mapInArrow(run, "id long, v double, exact boolean")

    def __call__(self, step: int, chosen: Block) -> DataFrame:
        if step:
            self._take(Block(*[x[step - 1 : step] for x in vars(chosen).values()]))
        computed = 0
        while self.bounded:
            found = self._gains(step).where(~F.col("id").isin(chosen.ids.tolist()) if step else F.lit(True))
            best = found.where("exact and not isnan(v)").agg(F.max("v")).first()[0]
            some = found.where("not exact")
            if best is None:
                some = some.orderBy(F.col("v").desc(), "id").limit(self.size)
            else:
                some = some.where(F.col("v") >= best - 1e-6 * max(1.0, abs(best)))
            some = stash(some.select("id"))
            n = some.count()
            if not n:
                break
            self._compute(some, n)
            computed += n
        if self.trace is not None and self.bounded:
            self.trace.append((step, computed))
        return self._gains(step).where("exact").select("id", "v")


def maximise(
    pool: DataFrame,
    k: int,
    function: str,
    query: DataFrame | None = None,
    private: DataFrame | None = None,
    metric: str = "cosine",
    lam: float | None = None,
    eta: float = 1.0,
    nu: float = 1.0,
    concave: str = "log",
    optimizer: str = "LazyGreedy",
    stop_zero: bool = False,
    stop_negative: bool = False,
    seed: int = 0,
    neighbours: int | None = None,
    trace: list | None = None,
    most_gathered: int | None = None,
    most_numbers: int = MOST_NUMBERS,
) -> list[tuple[int, float]]:
    """Greedy maximiser of an objective over rows (id, g, e); (id, gain) in the order chosen.

    The naive optimiser evaluates every candidate in every step. The lazy one
    does so once for objectives that cover a ground set, and then only blocks of
    candidates whose bound reaches the best (see lazy_greedy); both choose
    alike. The two stochastic ones look in each step at a hashed share of the
    pool only, about (n / k) ln 100 rows. A modular objective is a plain top-k.

    ``neighbours``, for the coverage of the pool, counts each row as covered by
    its so many most similar rows only (others give nothing): block meets block
    once, and a step then costs n times ``neighbours``. With as many neighbours
    as rows it is the dense objective; with fewer, f falls short by at most the
    sum, over rows with no chosen neighbour, of their least kept similarity.

    A log-determinant gathers query and private rows up to ``most_gathered``
    (5000); beyond it takes the Gram matrix of their cosine features, or, for
    distances and for very many features, their inverse Cholesky factor in
    panels of ``most_numbers`` numbers (see inverse_factor_of).
    """
    if function not in SUBMODULAR + MUTUAL + CONDITIONAL + CONDITIONAL_MUTUAL:
        raise ValueError(f"unknown objective {function!r}")
    if optimizer not in ("NaiveGreedy", "LazyGreedy", "StochasticGreedy", "LazierThanLazyGreedy"):
        raise ValueError(f"unknown optimizer {optimizer!r}")
    if function in ("graph_cut", "log_determinant") and lam is None:
        raise ValueError(f"{function} needs lambda_val")
    if function in MUTUAL + CONDITIONAL_MUTUAL and query is None or function in CONDITIONAL + CONDITIONAL_MUTUAL and private is None:
        raise ValueError(f"{function} needs a query or private set")
    if neighbours is not None and function not in COVERAGE:
        raise ValueError(f"neighbours are for {', '.join(COVERAGE)}")
    lam = 1.0 if lam is None else lam
    pool = stash(pool)
    size = TRAVELLING if function in (*COVERAGE, "fl2mi", "com") or metric != "cosine" and function in ("logdetmi", "logdetcg", "logdetcmi") else BLOCK
    blocks = stash(to_blocks(pool, size))
    q = stash(to_blocks(query, size)) if query is not None else None
    p = stash(to_blocks(private, size)) if private is not None else None
    sim = lambda a, b: a.similarity(b, metric)
    psi = CONCAVE[concave]
    share = min(1.0, np.log(100) / max(k, 1)) if optimizer in ("StochasticGreedy", "LazierThanLazyGreedy") else None

    def drawn(step: int):
        """Which candidates a stochastic step looks at; gains of the others are never computed."""
        return None if share is None else lambda ids: np.array([uniform_number(seed, i, step) < share for i in ids.tolist()], bool)

    def with_state(*columns: DataFrame) -> DataFrame:
        """The pool's blocks with a number per row from each table (id, v), fixed over all steps."""
        out = pool
        for i, c in enumerate(columns):
            out = out.join(c.select("id", F.col("v").alias(f"s{i}")), "id")
        return stash(to_blocks(out.withColumn("s", F.array(*[f"s{i}" for i in range(len(columns))])), size))

    def current(b: Block, chosen: Block) -> np.ndarray:
        now = np.zeros(len(b.ids))
        for _, s in tiles(chosen, b, metric):
            np.maximum(now, s.max(axis=0, initial=0), out=now)
        return now

    largest = lambda ground: over_pairs(blocks, ground, lambda a, b: reduced(a, b, metric, lambda s: s.max(axis=1)), "max")

    def added(ground: DataFrame) -> DataFrame:
        """Each candidate's similarities to the ground rows added up."""
        if metric != "cosine" or not ground.take(1):
            return over_pairs(blocks, ground, lambda a, b: reduced(a, b, metric, lambda s: s.sum(axis=1)))
        n, total = direction_sum(ground)
        return per_candidate(blocks, lambda a: n / 2 + towards(a, total) / 2)

    lazy: dict = {}

    def covering(ground: DataFrame, compute, extra: DataFrame | None = None, linear: bool = False) -> Gains:
        """Sums over ground rows of compute(candidates, ground rows, chosen), plus ``extra`` (id, v) of the candidate itself.

        ``linear`` says that these are similarities as long as nothing is chosen, whose sums need no pairs for the cosine.
        """

        def gains(step: int, chosen: Block, keep: bool = True) -> DataFrame:
            if linear and not len(chosen.ids):
                found = added(ground)
            else:
                found = over_pairs(blocks, ground, lambda a, b: compute(a, b, chosen), keep=drawn(step) if keep else None)
            return found if extra is None else found.join(extra.select("id", F.col("v").alias("m")), "id").select("id", (F.col("v") + F.col("m")).alias("v"))

        lazy.update(ground=ground, compute=compute, extra=extra, linear=linear)
        return gains

    def best_of(value):
        """For covering(): value(best similarity, states of the ground row) with and without the candidate."""

        def compute(a: Block, b: Block, chosen: Block, rough: bool = False) -> np.ndarray:
            kind = np.float32 if rough else np.float64
            cur, states = current(b, chosen)[None, :].astype(kind), [x[None, :].astype(kind) for x in b.s.T]
            before = value(cur, states)

            def gain(s: np.ndarray) -> np.ndarray:
                s = value(np.maximum(s, cur, out=s), states)
                return np.subtract(s, before, out=s).sum(axis=1)

            return reduced(a, b, metric, gain, rough)

        return compute

    local = lambda own, compute: lambda step, chosen: per_candidate(own, lambda a: compute(a, chosen), drawn(step))

    def left_over(*signed: tuple[float, _Kernel]) -> Gains:
        """Sums of signed log-determinant gains."""

        def gains(step: int, chosen: Block) -> DataFrame:
            for _, kernel in signed:
                kernel.follow(chosen)
            return per_candidate(blocks, lambda a: sum(sign * kernel.gain(a) for sign, kernel in signed), drawn(step))

        return gains

    to_chosen = lambda a, chosen: sim(a, chosen).sum(axis=1) if len(chosen.ids) else np.zeros(len(a.ids))
    modular = None

    if function in COVERAGE:
        value = {
            "facility_location": lambda m, s: m,
            "fl1mi": lambda m, s: np.minimum(m, eta * s[0]),
            "flcg": lambda m, s: np.maximum(m - nu * s[0], 0),
            "flcmi": lambda m, s: np.maximum(np.minimum(m, eta * s[0]) - nu * s[1], 0),
        }[function]
        states = {"facility_location": (), "fl1mi": (q,), "flcg": (p,), "flcmi": (q, p)}[function]
        columns = [largest(x) for x in states]
        if neighbours is not None:
            gains = SparseCoverage(blocks, neighbours, metric, columns, value)
            return lazy_greedy(pool, gains.first(pool), k, gains, stop_zero, stop_negative, trace, gains.bounds)
        gains = covering(with_state(*columns) if columns else blocks, best_of(value), linear=function == "facility_location")
    elif function == "feature_based":

        def compute(a, chosen):
            x = np.abs(a.e)
            had = np.abs(chosen.e).sum(axis=0) if len(chosen.ids) else np.zeros(x.shape[1])
            return (psi(had[None, :] + x) - psi(had)[None, :]).sum(axis=1)

        gains = local(blocks, compute)
    elif function == "graph_cut":
        gains = local(with_state(added(blocks)), lambda a, c: a.s[:, 0] - lam * (2 * to_chosen(a, c) + a.self_similarity(metric)))
    elif function == "log_determinant":
        gains = left_over((1, _Kernel(metric, Block.none(), 1.0, lam)))
    elif function == "disparity_sum":
        gains = local(blocks, lambda a, c: (1 - sim(a, c)).sum(axis=1) if len(c.ids) else np.zeros(len(a.ids)))
    elif function == "disparity_min":
        gains = local(blocks, lambda a, c: (1 - sim(a, c)).min(axis=1) if len(c.ids) else np.zeros(len(a.ids)))
    elif function == "fl2mi":
        gains = covering(q, best_of(lambda m, s: m), stash(largest(q).select("id", (eta * F.col("v")).alias("v"))), linear=True)
    elif function == "com":
        curve = {"log": F.log1p, "sqrt": F.sqrt, "inverse": lambda x: x / (1 + x)}[concave]

        def together(a: Block, b: Block, chosen: Block, rough: bool = False) -> np.ndarray:
            had = sim(b, chosen).sum(axis=1) if len(chosen.ids) else np.zeros(len(b.ids))
            had = had.astype(np.float32 if rough else np.float64)
            before = psi(had)[None, :]
            return reduced(a, b, metric, lambda s: (psi(np.add(s, had, out=s)) - before).sum(axis=1), rough)

        gains = covering(q, together, stash(added(q).select("id", (eta * curve("v")).alias("v"))))
    elif function == "gcmi":
        modular = added(q).select("id", (2 * lam * F.col("v")).alias("v"))
    elif function == "gccg":
        own = with_state(added(blocks), added(p))
        gains = local(own, lambda a, c: a.s[:, 0] - lam * (2 * to_chosen(a, c) + a.self_similarity(metric)) - 2 * lam * nu * a.s[:, 1])
    else:
        plain = _Kernel(metric, Block.none(), 1.0)
        from_q, from_p = (q, query, eta), (p, private, nu)

        most = MOST_GATHERED if most_gathered is None else most_gathered
        counts = {id(x): x.agg(F.sum(F.size("ids"))).first()[0] or 0 for x in (p, q) if x is not None}
        sets = [x for x in {"logdetmi": (from_q,), "logdetcg": (from_p,)}.get(function, (from_p, from_q)) if counts[id(x[0])]]
        features = 0
        if sets:
            first = sets[0][0].select(F.size("ids").alias("n"), F.size("g").alias("g"), F.size("e").alias("e")).where("n > 0").first()
            features = 1 + first["g"] // first["n"] * (first["e"] // first["n"])
        by_gram = metric == "cosine" and features <= MOST_FEATURES
        by_rows = not by_gram and sum(counts[id(x[0])] for x in sets) > most
        if by_rows:  # the private set comes first, so what it explains alone is a part of what both do
            rows = reduce(DataFrame.unionByName, [x[1].select(F.lit(i).alias("place"), F.lit(float(x[2])).alias("weight"), "id", "g", "e") for i, x in enumerate(sets)])
            factor = inverse_factor_of(rows, np.cumsum([counts[id(x[0])] for x in sets]).tolist(), metric, RIDGE, most_numbers)
            with_p = len([x for x in sets if x[0] is p])
            signed = {"logdetmi": [(1, 0), (-1, 1)], "logdetcg": [(1, 1)]}.get(function, [(1, with_p), (-1, len(sets))])
            picks = greedy(pool, k, _LeftOver(pool, blocks, factor, signed, size, drawn, trace), stop_zero=stop_zero, stop_negative=stop_negative)
            remove_folder(pool.sparkSession, factor.folder)
            return picks

        def given(*own: tuple) -> _Kernel:
            """What is left of the similarities; rows come to the driver only where they are few, and fewer than features where the metric has any."""
            own = [x for x in own if counts[id(x[0])]]
            if not own:
                return _Kernel(metric, Block.none(), 1.0)
            total = sum(counts[id(x[0])] for x in own)
            if by_gram and total > min(features, most):
                grams = [cosine_gram(x[0]) for x in own]
                empty = np.zeros_like(grams[0])
                return _GramKernel(grams[0], grams[1] if len(own) > 1 else empty, own[0][2], own[-1][2])
            block, weights = Block.none(), []
            for _, rows, w in own:
                few = gathered(rows, most)
                block, weights = block.add(few), weights + [w] * len(few.ids)
            return _Kernel(metric, block, np.array(weights))

        if function == "logdetmi":
            gains = left_over((1, plain), (-1, given(from_q)))
        elif function == "logdetcg":
            gains = left_over((1, given(from_p)))
        else:
            gains = left_over((1, given(from_p)), (-1, given(from_p, from_q)))

    if modular is not None:
        rows = modular.orderBy(F.col("v").desc(), "id").limit(k).collect()
        return [(r["id"], r["v"]) for r in rows if not (stop_zero and r["v"] == 0 or stop_negative and r["v"] < 0)]
    if lazy and optimizer != "NaiveGreedy":
        over, compute, extra = lazy["ground"], lazy["compute"], lazy["extra"]

        def evaluate(candidates: Block, chosen: Block) -> np.ndarray:
            found = over_ground(over, candidates, lambda a, b: compute(a, b, chosen))
            return found if extra is None else found + candidates.s[:, 0]

        own = pool if extra is None else pool.drop("s").join(extra.select("id", F.array("v").alias("s")), "id")
        rough = lambda some, chosen: block_bounds(some, over, lambda a, b: compute(a, b, chosen, rough=True), own=extra is not None)
        return lazy_greedy(own, gains(0, Block.none(), keep=False), k, evaluate, stop_zero, stop_negative, trace, rough, drawn)
    return greedy(pool, k, gains, stop_zero=stop_zero, stop_negative=stop_negative)


def _entry_gains(batch: pa.RecordBatch, chosen: np.ndarray, value: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, gain) for each neighbour of each row of (id, j, s, states ...): what of a row is covered follows from its chosen neighbours."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    j, s = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
    row, covered = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes))
    hit = np.isin(j, chosen)
    np.maximum.at(covered, row[hit], s[hit])
    states = [batch.column(i).to_numpy() for i in range(3, batch.num_columns)]
    return j, value(np.maximum(s, covered[row]), [x[row] for x in states]) - value(covered, states)[row]


class SparseCoverage:
    """Gains of candidates where a row is covered by its most similar rows only.

    The kernel is a table of each row's neighbours beside its states; a step
    reads it once, and nothing is kept between steps.
    """

    def __init__(self, blocks: DataFrame, m: int, metric: str, columns: list[DataFrame], value: Callable):
        near = nearest_rows(blocks, m, metric)
        for i, c in enumerate(columns):
            near = near.join(c.select("id", F.col("v").alias(f"s{i}")), "id")
        self.value = value
        self.rows = stash(near.select("id", F.col("near.j").alias("j"), F.col("near.s").alias("s"), *[f"s{i}" for i in range(len(columns))]))

    def first(self, pool: DataFrame) -> DataFrame:
        """(id, v) of every candidate with nothing chosen; zero for one that is nobody's neighbour."""
        return pool.select("id").join(self._every(Block.none()), F.col("id") == F.col("j"), "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))

    def bounds(self, some: DataFrame, chosen: Block) -> DataFrame:
        """(no, v): the largest gain of each block, from one reading of the kernel, with room for sums in another order."""
        ids = some.select("no", F.explode("ids").alias("id"))
        found = ids.join(self._every(chosen), F.col("id") == F.col("j"), "left").groupBy("no").agg(F.max(F.coalesce("v", F.lit(0.0))).alias("v"))
        return found.select("no", (F.col("v") + 1e-9 * (1 + F.abs("v"))).alias("v"))

    def _every(self, chosen: Block) -> DataFrame:
        """(j, v): the gain of everybody's neighbour."""
        value, ids = self.value, chosen.ids

        def run(batches):
            for batch in batches:
                j, gain = _entry_gains(batch, ids, value)
                own, place = np.unique(j, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(place, gain, len(own)))], ["j", "v"])

        return self.rows.mapInArrow(run, "j long, v double").groupBy("j").agg(F.sum("v").alias("v"))

    def __call__(self, candidates: Block, chosen: Block) -> np.ndarray:
        order, value, ids = np.argsort(candidates.ids), self.value, chosen.ids
        asked = candidates.ids[order]

        def run(batches):
            total = np.zeros(len(asked))
            for batch in batches:
                j, gain = _entry_gains(batch, ids, value)
                at = np.minimum(np.searchsorted(asked, j), len(asked) - 1)
                own = asked[at] == j
                total += np.bincount(at[own], gain[own], len(asked))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

        out = np.zeros(len(asked))
        out[order] = summed(self.rows.mapInArrow(run, "at long, v double"), len(asked))
        return out


# --- distance ------------------------------------------------------------------------------------


def furthest_first(pool: DataFrame, labelled: DataFrame | None, k: int) -> list[tuple[int, float]]:
    """(id, distance): each step the row furthest from the labelled and chosen ones; without any, the smallest id first."""
    pool = stash(pool)
    blocks = stash(to_blocks(pool))
    if labelled is not None:
        nearest = over_pairs(blocks, stash(to_blocks(labelled)), lambda a, b: np.sqrt(a.distance2(b)).min(axis=1), "min")
        joined = pool.join(nearest, "id", "left").withColumn("s", F.array(F.coalesce("v", F.lit(float("inf"))))).drop("v")
        blocks = stash(to_blocks(joined))

    started = labelled is not None

    def compute(a: Block, chosen: Block) -> np.ndarray:
        start = a.s[:, 0] if started else np.full(len(a.ids), np.inf)
        return np.minimum(start, np.sqrt(a.distance2(chosen)).min(axis=1)) if len(chosen.ids) else start

    return greedy(pool, k, lambda step, c: per_candidate(blocks, lambda a: compute(a, c)))


def spread_by_distance(pool: DataFrame, k: int, seed: int, first: str) -> list[tuple[int, float]]:
    """k-means++ seeding: each next row drawn with probability in proportion to its squared distance to the chosen.

    A draw is the largest ln(u) / weight with u hashed from seed, id and step.
    The first row is the one with the largest norm, or drawn uniformly. Once
    all weights are zero the smallest id left is taken.
    """
    pool = stash(pool)
    blocks = stash(to_blocks(pool))

    def compute(a: Block, chosen: Block) -> np.ndarray:
        if len(chosen.ids):
            return a.distance2(chosen).min(axis=1)
        return a.norms2() if first == "norm" else np.ones(len(a.ids))

    def score(v: Column, id_: Column, step: int) -> Column:
        return v if step == 0 and first == "norm" else F.when(v > 1e-12, F.ln(uniform(seed, id_, step)) / v)

    return greedy(pool, k, lambda step, c: per_candidate(blocks, lambda a: compute(a, c)), score)


def greedy_by_part(rows: DataFrame, budgets: dict[int, int], gains: Callable[[dict[int, Block]], DataFrame]) -> dict[int, list[tuple[int, float]]]:
    """greedy() in every part at once: a step is one job that leaves a winner per part, so jobs do not grow with the parts.

    ``rows`` has part, id, g, e, s; ``gains(chosen)`` gives (part, id, v) from
    what each part has chosen. Parts without a budget are left out. The driver
    holds at most the chosen rows.
    """
    picks: dict[int, list[tuple[int, float]]] = {p: [] for p, k in budgets.items() if k > 0}
    chosen: dict[int, Block] = {}
    for step in range(max(budgets.values(), default=0)):
        open_ = [p for p in picks if len(picks[p]) == step < budgets[p]]
        taken = [i for own in picks.values() for i, _ in own]
        if not open_:
            break
        found = gains(chosen).where(F.col("part").isin(open_) & (~F.col("id").isin(taken) if taken else F.lit(True)))
        value = F.coalesce(F.nanvl("v", F.lit(float("-inf"))), F.lit(float("-inf")))
        best = found.groupBy("part").agg(F.max(F.struct(value.alias("v"), (-F.col("id")).alias("neg"))).alias("b")).select("part", (-F.col("b.neg")).alias("id"), "b.v")
        for won in rows.join(F.broadcast(best.select("id", "v")), "id").select("part", "id", "v", "g", "e", "s").collect():  # a row per part
            picks[won["part"]].append((won["id"], won["v"]))
            chosen[won["part"]] = chosen.get(won["part"], Block.none()).add(Block.of([won["id"]], won["g"], won["e"], won["s"]))
    return picks


def furthest_first_by_part(rows: DataFrame, labelled: DataFrame | None, budgets: dict[int, int]) -> dict[int, list[tuple[int, float]]]:
    """furthest_first() in every part of (part, id, g, e, s), all against the same labelled rows."""
    rows = stash(rows.select("part", "id", "g", "e", "s"))
    own, started = rows, labelled is not None
    if started:
        near = over_pairs(stash(to_blocks(rows)), stash(to_blocks(labelled)), lambda a, b: np.sqrt(a.distance2(b)).min(axis=1), "min")
        own = rows.join(near, "id", "left").withColumn("s", F.array(F.coalesce("v", F.lit(float("inf"))))).drop("v")
    blocks = stash(to_part_blocks(own))

    def gains(chosen: dict[int, Block]) -> DataFrame:
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    part, a = batch.column(0)[k].as_py(), unpacked(batch, k, 1)
                    v = a.s[:, 0] if started else np.full(len(a.ids), np.inf)
                    if part in chosen:
                        v = np.minimum(v, np.sqrt(a.distance2(chosen[part])).min(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), part, np.int32)), pa.array(a.ids), pa.array(v)], ["part", "id", "v"])

        return blocks.mapInArrow(run, "part int, id long, v double")

    return greedy_by_part(rows, budgets, gains)


def facility_location_by_part(rows: DataFrame, budgets: dict[int, int], metric: str = "cosine") -> dict[int, list[tuple[int, float]]]:
    """Facility location in every part of (part, id, g, e, s), each row covered within its own part."""
    rows = stash(rows.select("part", "id", "g", "e", "s"))
    blocks = stash(to_part_blocks(rows))

    def gains(chosen: dict[int, Block]) -> DataFrame:
        def compute(part: int, a: Block, b: Block) -> np.ndarray:
            now = b.similarity(chosen[part], metric).max(axis=1) if part in chosen else np.zeros(len(b.ids))
            return np.maximum(a.similarity(b, metric) - now[None, :], 0).sum(axis=1)

        return over_parts(blocks, compute)

    return greedy_by_part(rows, budgets, gains)


def nearest_centres(rows: DataFrame, centres: Block) -> DataFrame:
    """(id, centre, distance) with the index of the nearest centre, the first at ties."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                b = unpacked(batch, k)
                d = b.distance2(centres)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(b.ids), pa.array(near.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(near)), near]))], ["id", "centre", "distance"])

    return to_blocks(rows).mapInArrow(run, "id long, centre int, distance double")


def cluster_means(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """(centre, d, m): the mean of each cluster in each dimension."""
    return rows.join(assigned.select("id", "centre"), "id").select("centre", F.posexplode("e").alias("d", "v")).groupBy("centre", "d").agg(F.avg("v").alias("m"))


def seedings(rows: DataFrame, blocks: DataFrame, k: int, seeds: list[int]) -> list[Block]:
    """spread_by_distance() from a uniform first row for several seeds at once: a step is one pass and one job for all of them."""
    chosen = [Block.none() for _ in seeds]
    for step in range(k):
        held = list(chosen)

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    b = unpacked(batch, i)
                    w = np.stack([np.where(np.isin(b.ids, c.ids), np.nan, b.distance2(c).min(axis=1) if len(c.ids) else 1.0) for c in held], axis=1)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, len(held), dtype=np.int32)), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(b.ids), flat], ["id", "w"])

        each = blocks.mapInArrow(run, "id long, w array<double>").select("id", F.posexplode("w").alias("start", "w")).where(~F.isnan("w"))
        u = F.lit(None).cast("double")
        for r, seed in enumerate(seeds):
            u = F.when(F.col("start") == r, uniform(seed, F.col("id"), step)).otherwise(u)
        drawn = F.coalesce(F.when(F.col("w") > 1e-12, F.ln(u) / F.col("w")), F.lit(float("-inf")))
        best = each.groupBy("start").agg(F.max(F.struct(drawn.alias("c"), (-F.col("id")).alias("neg"))).alias("b")).select("start", (-F.col("b.neg")).alias("id"))
        for won in rows.join(F.broadcast(best), "id").select("start", "id", "g", "e", "s").collect():  # a row per seed
            chosen[won["start"]] = chosen[won["start"]].add(Block.of([won["id"]], won["g"], won["e"], won["s"]))
    return chosen


def kmeans(rows: DataFrame, k: int, centres: Block | None = None, tol: float = 1e-4, max_iter: int = 300, n_init: int = 10, seed: int = 0) -> tuple[Block, float]:
    """Lloyd's algorithm from the given centres, or the best of ``n_init`` seedings; (centres, inertia).

    All seedings go together: an iteration is one pass in which each task sums
    its rows per cluster of every set of centres that still moves, and n_init
    times k sums of a vector go to the driver. A cluster left empty keeps its
    centre. Of equal inertias the earlier seeding wins.
    """
    rows = stash(rows)
    blocks = stash(to_blocks(rows))
    now = [centres] if centres is not None else seedings(rows, blocks, k, [seed + r for r in range(n_init)])
    moving = list(range(len(now)))
    for _ in range(max_iter):
        if not moving:
            break
        found = _cluster_sums(blocks, [now[r] for r in moving])
        still = []
        for r, (sums, counts, _) in zip(moving, found):
            e = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], now[r].e)
            if float(np.sqrt(((e - now[r].e) ** 2).sum())) >= tol:
                still.append(r)
            now[r] = Block(now[r].ids, now[r].g, e, now[r].s)
        moving = still
    inertias = [inertia for _, _, inertia in _cluster_sums(blocks, now)]
    best = int(np.argmin(inertias))
    return now[best], inertias[best]


def _cluster_sums(blocks: DataFrame, sets: list[Block]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(sums, counts, inertia) per set of centres, from one pass."""
    k, width = sets[0].e.shape
    size = k * (width + 2)

    def run(batches):
        total = np.zeros((len(sets), k, width + 2))
        for batch in batches:
            for i in range(batch.num_rows):
                b = unpacked(batch, i)
                for own, centres in zip(total, sets):
                    d = b.distance2(centres)
                    near = d.argmin(axis=1)
                    one = np.zeros((len(near), k))
                    one[np.arange(len(near)), near] = 1
                    own[:, :width] += one.T @ b.e
                    own[:, width] += one.sum(axis=0)
                    own[:, width + 1] += one.T @ d.min(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    out = summed(blocks.mapInArrow(run, "at long, v double"), len(sets) * size).reshape(len(sets), k, width + 2)
    return [(own[:, :width], own[:, width], float(own[:, width + 1].sum())) for own in out]


def representatives(rows: DataFrame, centres: Block) -> DataFrame:
    """(rank, id, score): the row nearest to each centre, the smallest id at ties."""
    near = nearest_centres(rows, centres)
    best = near.groupBy("centre").agg(F.min(F.struct("distance", "id")).alias("b"))
    return best.select((F.col("centre") + 1).alias("rank"), "b.id", F.col("b.distance").alias("score"))

