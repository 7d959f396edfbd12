"""SQL that gives the queries' results, written from the definitions."""

from __future__ import annotations

import math

from tamis.functions.text import ACCENTED, PLAIN, PUNCTUATION
from tamis.plans.model import uniform as uniform_number
from tamis.queries import ADAM, CLASSES, K, N_DROP, NEIGHBOURS, SCALE, SGD, START, STOP_WORDS, TOP

BASE = f"""
base AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
wd AS (SELECT label AS c, d, avg(x[d]) AS m FROM base, range(1, 65) t(d) WHERE id % 5 = 0 GROUP BY 1, 2),
w AS (SELECT c, list({SCALE} * m ORDER BY d) AS w FROM wd GROUP BY c),
zz AS (SELECT id, list(list_dot_product(x, w) ORDER BY c) AS z FROM base, w GROUP BY id),
ee AS (SELECT id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM zz),
pr AS MATERIALIZED (SELECT b.id, x, label, z, list_transform(e, lambda v: v / list_sum(e)) AS p,
  CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred FROM ee JOIN base b USING (id)),
un AS MATERIALIZED (SELECT *, list_transform(range({CLASSES}), lambda c: p[c + 1] - CASE WHEN c = pred THEN 1 ELSE 0 END) AS l0 FROM pr WHERE id % 5 <> 0),
lab AS (SELECT *, list_transform(range({CLASSES}), lambda c: p[c + 1] - CASE WHEN c = label THEN 1 ELSE 0 END) AS l0 FROM pr WHERE id % 5 = 0),
qs AS (SELECT * FROM lab WHERE label IN (0, 1)), ps AS (SELECT * FROM lab WHERE label IN (2, 3)), vs AS MATERIALIZED (SELECT * FROM lab WHERE label >= 4)"""


def uniform(text: str) -> str:
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) + 0.5) / 4294967296.0)"


MASKS = f"""
masks AS (SELECT k, d, CASE WHEN {uniform("'0:' || k || ':' || (d - 1)")} >= 0.5 THEN 2.0 ELSE 0.0 END AS m FROM range({N_DROP}) a(k), range(1, 65) b(d)),
mw AS (SELECT k, c, list({SCALE} * wd.m * masks.m ORDER BY d) AS w FROM wd JOIN masks USING (d) GROUP BY k, c),
mz AS (SELECT id, k, list(list_dot_product(x, w) ORDER BY c) AS z FROM base, mw WHERE id % 5 <> 0 GROUP BY id, k),
me AS (SELECT id, k, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM mz),
mp AS MATERIALIZED (SELECT id, k, list_transform(e, lambda v: v / list_sum(e)) AS p FROM me),
mm AS MATERIALIZED (SELECT id, list(v ORDER BY c) AS p FROM (SELECT id, c, avg(p[c + 1]) AS v FROM mp, range({CLASSES}) t(c) GROUP BY 1, 2) GROUP BY id)"""

ENTROPY = "list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END))"
SCORE = {"entropy": ENTROPY, "least_confidence": "-list_max(p)", "margin": "list_sort(p, 'DESC')[2] - list_sort(p, 'DESC')[1]"}


def top(source: str, score: str, k: int = TOP, ctes: str = BASE, direction: str = "DESC") -> str:
    return f"WITH {ctes}, scored AS (SELECT id, {score} AS s FROM {source}) SELECT CAST(row_number() OVER (ORDER BY s {direction}, id) AS INTEGER) AS rank, id, round(s, 6) AS score FROM scored ORDER BY rank LIMIT {k}"


def unrolled(k: int, gain: str, ctes: str, pick: str = "v DESC", where: str = "", between=None) -> str:
    """k greedy steps; ``gain`` gives (id, v) and may use {chosen} and {step}."""
    parts = [ctes]
    for t in range(k):
        chosen = " UNION ALL ".join(f"SELECT id FROM pick{i}" for i in range(t)) or "SELECT CAST(NULL AS BIGINT) AS id WHERE false"
        parts.append(f"chosen{t} AS MATERIALIZED ({chosen})")
        if between:
            parts += between(t)
        parts.append(f"gain{t} AS MATERIALIZED ({gain.format(chosen=f'(SELECT id FROM chosen{t})', step=t)})")
        order = pick(t) if callable(pick) else pick
        parts.append(f"pick{t} AS MATERIALIZED (SELECT {t + 1} AS rank, id, v FROM gain{t} WHERE id NOT IN (SELECT id FROM chosen{t}) ORDER BY {order}, id LIMIT 1)")
    both = " UNION ALL ".join(f"SELECT * FROM pick{t}" for t in range(k))
    return f"WITH {', '.join(parts)} SELECT CAST(rank AS INTEGER) AS rank, id, round(v, 6) AS score FROM ({both})"


COSINE = "(list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) + 1) / 2"
GRADIENT = "list_dot_product(a.l0, b.l0) * (list_dot_product(a.x, b.x) + 1)"
GNORM = "list_dot_product({0}.l0, {0}.l0) * (list_dot_product({0}.x, {0}.x) + 1)"


def kernel(name: str, left: str, right: str, s: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {s} AS s FROM {left} a, {right} b)"


UU = kernel("kern", "un", "un", COSINE)
QU, PU = kernel("qk", "qs", "un", COSINE), kernel("pk", "ps", "un", COSINE)
CURRENT = "(SELECT i, max(s) AS m FROM {k} WHERE j IN {{chosen}} GROUP BY i)"
CUR_U, CUR_Q = CURRENT.format(k="kern"), CURRENT.format(k="qk")
FACILITY = f"SELECT j AS id, sum(greatest(s - coalesce(m, 0), 0)) AS v FROM kern LEFT JOIN {CUR_U} cur USING (i) GROUP BY j"


def capped(value: str, *limits: str) -> str:
    """Facility location through ``value`` of {m}, with limits from query and private rows."""
    joins = " ".join(f"JOIN (SELECT j AS i, max(s) AS {t} FROM {k} GROUP BY j) USING (i)" for t, k in limits)
    return f"SELECT j AS id, sum({value.format(m='greatest(s, coalesce(m, 0))')} - {value.format(m='coalesce(m, 0)')}) AS v FROM kern LEFT JOIN {CUR_U} cur USING (i) {joins} GROUP BY j".replace("{{", "{").replace("}}", "}")


def graph_cut(lam: float, extra: str = "") -> str:
    return f"SELECT j AS id, sum(s) - {lam} * (2 * coalesce(sum(s) FILTER (WHERE i IN {{chosen}}), 0) + 1) {extra} AS v FROM kern GROUP BY j"


NEAREST = "coalesce(min({d}) FILTER (WHERE i IN {{chosen}}), {none})"
ORACLES: dict[str, str] = {}


def _vector(source: str, vector: str, ctes: str = BASE) -> str:
    return f"WITH {ctes}, long AS (SELECT id, {vector} AS p FROM {source}) SELECT id, CAST(d AS INTEGER) AS d, round(p[d + 1], 6) AS v FROM long, unnest(range(len(p))) t(d)"


ORACLES["predict"] = f"WITH {BASE} SELECT id, pred FROM un"
ORACLES["predict_prob"] = _vector("un", "p")
ORACLES["predict_prob_dropout"] = _vector("mm", "p", f"{BASE}, {MASKS}")
ORACLES["predict_prob_dropout_split"] = f"WITH {BASE}, {MASKS} SELECT id, CAST(k AS INTEGER) AS k, CAST(d AS INTEGER) AS d, round(p[d + 1], 6) AS v FROM mp, range({CLASSES}) t(d)"
ORACLES["embedding"] = _vector("un", "x")
for _kind, _g in {
    "bias": "l0",
    "linear": "flatten(list_transform(l0, lambda a: list_transform(x, lambda b: a * b)))",
    "bias_linear": "l0 || flatten(list_transform(l0, lambda a: list_transform(x, lambda b: a * b)))",
}.items():
    ORACLES[f"grad_{_kind}"] = (
        f"WITH {BASE}, gg AS (SELECT id, {_g} AS g FROM un) SELECT id, CAST(len(g) AS INTEGER) AS n_dims, round(sqrt(list_dot_product(g, g)), 6) AS norm, "
        "round(list_dot_product(g, list_transform(range(len(g)), lambda i: CAST(i % 7 AS DOUBLE))), 6) AS mixed FROM gg"
    )
ORACLES["standardise"] = (
    f"WITH {BASE}, st AS (SELECT d, avg(x[d + 1]) AS m, stddev_pop(x[d + 1]) AS s FROM lab, range(64) t(d) GROUP BY d) "
    "SELECT id, CAST(d AS INTEGER) AS d, round((x[d + 1] - m) / s, 6) AS v FROM un, st"
)

for _name, _s in SCORE.items():
    ORACLES[_name] = top("un", _s)
    ORACLES[f"{_name}_dropout"] = top("mm", _s, ctes=f"{BASE}, {MASKS}")
    _survivors = f"sv AS MATERIALIZED (SELECT * FROM un ORDER BY {_s} DESC, id LIMIT {K * 5})"
    ORACLES[f"fass_{_name}"] = unrolled(K, FACILITY, f"{BASE}, {_survivors}, {kernel('kern', 'sv', 'sv', COSINE)}")
ORACLES["bald"] = (
    f"WITH {BASE}, {MASKS}, scored AS (SELECT id, {ENTROPY} - h AS s FROM mm JOIN (SELECT id, avg({ENTROPY}) AS h FROM mp GROUP BY id) USING (id)) "
    f"SELECT CAST(row_number() OVER (ORDER BY s DESC, id) AS INTEGER) AS rank, id, round(s, 6) AS score FROM scored ORDER BY rank LIMIT {TOP}"
)
ORACLES["random_selection"] = top("un", uniform("'0:' || id"), direction="ASC")
ORACLES["topk_streaming"] = f"SELECT CAST(row_number() OVER (ORDER BY value DESC, event_id) AS INTEGER) AS rank, CAST(event_id AS BIGINT) AS id, round(value, 6) AS score FROM events ORDER BY rank LIMIT {TOP}"
_BALD1 = f"SELECT id, {ENTROPY} - h AS v FROM mm JOIN (SELECT id, avg({ENTROPY}) AS h FROM mp GROUP BY id) USING (id)"
ORACLES["batchbald"] = (
    f"WITH {BASE}, {MASKS}, g0 AS ({_BALD1}), p0 AS MATERIALIZED (SELECT id, v FROM g0 ORDER BY v DESC, id LIMIT 1), "
    f"ch AS (SELECT id, avg({ENTROPY}) AS h FROM mp GROUP BY id), "
    f"jt AS (SELECT b.id, c, d, avg(a.p[c + 1] * b.p[d + 1]) AS m FROM mp a JOIN p0 ON a.id = p0.id JOIN mp b USING (k), range({CLASSES}) t(c), range({CLASSES}) u(d) GROUP BY b.id, c, d), "
    "g1 AS (SELECT jt.id, sum(-m * ln(m)) - any_value(ch.h) - (SELECT h FROM ch JOIN p0 USING (id)) AS v FROM jt JOIN ch ON jt.id = ch.id GROUP BY jt.id), "
    "p1 AS (SELECT id, v FROM g1 WHERE id NOT IN (SELECT id FROM p0) ORDER BY v DESC, id LIMIT 1) "
    "SELECT CAST(rank AS INTEGER) AS rank, id, round(v, 6) AS score FROM (SELECT 1 AS rank, * FROM p0 UNION ALL SELECT 2, * FROM p1)"
)

_DIST = "sqrt(greatest(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x), 0))"
ORACLES["coreset"] = unrolled(
    K,
    "SELECT j AS id, least(any_value(n), coalesce(min(s) FILTER (WHERE i IN {chosen}), any_value(n))) AS v FROM kern JOIN near ON near.id = j GROUP BY j",
    f"{BASE}, {kernel('kern', 'un', 'un', _DIST)}, near AS MATERIALIZED (SELECT b.id, min({_DIST}) AS n FROM lab a, un b GROUP BY b.id)",
)
_GRAD2 = "greatest(list_dot_product(a.l0, a.l0) * list_dot_product(a.x, a.x) + list_dot_product(b.l0, b.l0) * list_dot_product(b.x, b.x) - 2 * list_dot_product(a.l0, b.l0) * list_dot_product(a.x, b.x), 0)"
_DRAW = lambda t: f"CASE WHEN v > 1e-12 THEN ln({uniform(f"'7:' || id || ':{t}'")}) / v END DESC NULLS LAST"
ORACLES["badge"] = unrolled(
    K,
    "SELECT j AS id, coalesce(min(s) FILTER (WHERE i IN {chosen}), any_value(n)) AS v FROM kern JOIN nn ON nn.id = j GROUP BY j",
    f"{BASE}, {kernel('kern', 'un', 'un', _GRAD2)}, nn AS (SELECT id, list_dot_product(l0, l0) * list_dot_product(x, x) AS n FROM un)",
    pick=lambda t: _DRAW(t) if t else "v DESC",
)
_D2 = f"greatest(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x), 0)"
ORACLES["kmeans_pp"] = unrolled(K, "SELECT j AS id, coalesce(min(s) FILTER (WHERE i IN {chosen}), 1.0) AS v FROM kern GROUP BY j", f"{BASE}, {kernel('kern', 'un', 'un', _D2)}", pick=_DRAW)
_CENTRES = f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS centre, x FROM un ORDER BY id LIMIT {K})"


def _assigned(name: str, centres: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT id, x, arg_min(centre, s) AS centre, min(s) AS s FROM (SELECT a.id, a.x, b.centre, {_D2} AS s FROM un a, {centres} b ORDER BY a.id, b.centre) GROUP BY id, x)"


def _means(name: str, assigned: str, before: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT b.centre, coalesce(m.x, b.x) AS x FROM {before} b LEFT JOIN (SELECT centre, list(v ORDER BY d) AS x FROM (SELECT centre, d, avg(x[d]) AS v FROM {assigned}, range(1, 65) t(d) GROUP BY 1, 2) GROUP BY centre) m USING (centre))"


ORACLES["kcenter_distances"] = f"WITH {BASE}, {_CENTRES}, {_assigned('a0', 'c0')} SELECT id, round(sqrt(s), 6) AS distance FROM a0"
ORACLES["kmeans_assign"] = f"WITH {BASE}, {_CENTRES}, {_assigned('a0', 'c0')} SELECT id, centre FROM a0"
ORACLES["kmeans_means"] = f"WITH {BASE}, {_CENTRES}, {_assigned('a0', 'c0')} SELECT centre, CAST(d - 1 AS INTEGER) AS d, round(avg(x[d]), 6) AS m FROM a0, range(1, 65) t(d) GROUP BY 1, 2"
_steps = ", ".join(f"{_assigned(f'a{t}', f'c{t}')}, {_means(f'c{t + 1}', f'a{t}', f'c{t}')}" for t in range(3))
ORACLES["kmeans_select"] = (
    f"WITH {BASE}, {_CENTRES}, {_steps}, {_assigned('a3', 'c3')} "
    "SELECT CAST(centre + 1 AS INTEGER) AS rank, id, round(sqrt(s), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY s, id) AS n FROM a3) WHERE n = 1"
)


def _moved(rows: str):
    """The validation rows' logit gradient after each pick's step."""

    def between(t: int) -> list[str]:
        if t == 0:
            out = [f"z0 AS MATERIALIZED (SELECT id, x, z, y FROM {rows})"]
        else:
            step = "0.5 * (list_dot_product(a.x, b.x) + 1)"
            out = [f"z{t} AS MATERIALIZED (SELECT a.id, a.x, a.y, list_transform(range({CLASSES}), lambda c: a.z[c + 1] - {step} * b.l0[c + 1]) AS z FROM z{t - 1} a, un b JOIN pick{t - 1} p ON p.id = b.id)"]
        out.append(f"x{t} AS (SELECT id, x, y, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z{t})")
        out.append(f"v{t} AS MATERIALIZED (SELECT id, x, list_transform(range({CLASSES}), lambda c: e[c + 1] / list_sum(e) - CASE WHEN c = y THEN 1 ELSE 0 END) AS l0 FROM x{t})")
        return out

    return between


VROWS, ALLROWS = "(SELECT id, x, z, label AS y FROM vs)", "(SELECT id, x, z, pred AS y FROM un UNION ALL SELECT id, x, z, label FROM lab)"
AGREE = f"SELECT b.id, sum({GRADIENT}) / count(*) AS v FROM v{{step}} a, un b GROUP BY b.id"
ORACLES["glister"] = unrolled(K, AGREE, BASE, between=_moved(VROWS))
ORACLES["glister_no_validation"] = unrolled(K, AGREE.replace("count(*)", "(CASE WHEN {step} = 0 THEN (SELECT count(*) FROM un) ELSE count(*) END)"), BASE, between=_moved(ALLROWS))
_D2G = f"greatest({GNORM.format('a')} + {GNORM.format('b')} - 2 * {GRADIENT}, 0)"
ORACLES["glister_diversity"] = unrolled(
    K,
    f"SELECT g.id, g.v - 0.01 * coalesce((SELECT sum(exp(-s / 2)) FROM kern WHERE j = g.id AND i IN {{chosen}}), 0) AS v FROM ({AGREE}) g",
    f"{BASE}, {kernel('kern', 'un', 'un', _D2G)}",
    between=_moved(VROWS),
)
_cover = "SELECT j, sum(m - least(m, s)) AS f FROM kern JOIN (SELECT i, min(s) AS m FROM kern WHERE j IN {chosen} GROUP BY i) USING (i) GROUP BY j"
ORACLES["glister_facloc"] = unrolled(K, f"SELECT g.id, g.v + 0.001 * coalesce(f, 0) AS v FROM ({AGREE}) g LEFT JOIN ({_cover}) h ON h.j = g.id", f"{BASE}, {kernel('kern', 'un', 'un', _D2G)}", between=_moved(VROWS))
_n = int(K - int(0.4 * K))
_greedy = unrolled(_n, AGREE, BASE, between=_moved(VROWS))
_ctes = _greedy[: _greedy.rindex(" SELECT CAST(rank")]
_picks = " UNION ALL ".join(f"SELECT * FROM pick{t}" for t in range(_n))
ORACLES["glister_rand"] = (
    f"{_ctes}, pk AS MATERIALIZED ({_picks}), rnd AS (SELECT {_n} + row_number() OVER (ORDER BY u, id) AS rank, id, u AS v FROM (SELECT id, {uniform("'0:' || id")} AS u FROM un WHERE id NOT IN (SELECT id FROM pk)) ORDER BY rank LIMIT {K - _n}) "
    "SELECT CAST(rank AS INTEGER) AS rank, id, round(v, 6) AS score FROM (SELECT * FROM pk UNION ALL SELECT * FROM rnd)"
)
ORACLES["user_loss_gradient"] = _vector("sq", "g", f"{BASE}, sq AS (SELECT id, list_transform(range({CLASSES}), lambda c: p[c + 1] * (l0[c + 1] - list_dot_product(l0, p))) AS g FROM un)")
ORACLES["layer_embedding"] = (
    f"WITH {BASE} SELECT id, CAST(h AS INTEGER) AS d, round(greatest(list_sum(list_transform(range(64), lambda d: x[d + 1] * ((7 * h + 3 * d) % 11 - 5) / 10.0)) + (h - 4) / 100.0, 0), 6) AS v FROM un, range(8) t(h)"
)
ORACLES["log_determinant_pair"] = (
    f"WITH {BASE}, {UU}, a AS (SELECT i AS id, ln(1 + s) AS v FROM kern WHERE i = j ORDER BY v DESC, id LIMIT 1), "
    "b AS (SELECT j AS id, ln(1 + 1 - s * s / (1 + 1)) AS v FROM kern WHERE i = (SELECT id FROM a) AND j <> i ORDER BY v DESC, id LIMIT 1) "
    "SELECT CAST(rank AS INTEGER) AS rank, id, round(v, 6) AS score FROM (SELECT 1 AS rank, * FROM a UNION ALL SELECT 2, * FROM b)"
)
_FULL = "flatten(list_transform(l0, lambda a: list_transform(list_append(x, 1), lambda b: a * b)))"
_match = unrolled(
    K,
    "SELECT g.id, sqrt(sum((g.v + coalesce(r.v, 0) - t.v) ^ 2)) AS v FROM gd g JOIN tg t USING (d) LEFT JOIN (SELECT d, sum(v) AS v FROM gd WHERE id IN {chosen} GROUP BY d) r USING (d) GROUP BY g.id",
    f"{BASE}, gd AS MATERIALIZED (SELECT id, d, g[d] AS v FROM (SELECT id, {_FULL} AS g FROM un), range(1, 651) t(d)), "
    f"tg AS MATERIALIZED (SELECT d, sum(g[d]) * (SELECT count(*) FROM un) / (SELECT count(*) FROM vs) AS v FROM (SELECT {_FULL} AS g FROM vs), range(1, 651) t(d) GROUP BY d)",
    pick="v ASC",
)
ORACLES["gradmatch_fixed"] = f"SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank, id, score, CAST(1 AS DOUBLE) AS weight FROM ({_match})"

_PROJECTED = "SELECT g.id, sum(g.v * ({r})) AS v FROM gd g JOIN tg t USING (d) {join} GROUP BY g.id"
ORACLES["gradmatch_omp_pair"] = (
    f"WITH {BASE}, gd AS MATERIALIZED (SELECT id, d, g[d] AS v FROM (SELECT id, {_FULL} AS g FROM un), range(1, 651) t(d)), "
    f"tg AS MATERIALIZED (SELECT d, sum(g[d]) * (SELECT count(*) FROM un) / (SELECT count(*) FROM vs) AS v FROM (SELECT {_FULL} AS g FROM vs), range(1, 651) t(d) GROUP BY d), "
    f"a AS MATERIALIZED (SELECT id, v / (SELECT sum(v * v) FROM gd WHERE gd.id = b.id) AS w FROM ({_PROJECTED.format(r='t.v', join='')} ORDER BY v DESC, id LIMIT 1) b), "
    "one AS MATERIALIZED (SELECT d, v FROM gd WHERE id = (SELECT id FROM a)), "
    f"b AS MATERIALIZED (SELECT id FROM ({_PROJECTED.format(r='t.v - (SELECT w FROM a) * o.v', join='JOIN one o USING (d)')}) WHERE id <> (SELECT id FROM a) ORDER BY v DESC, id LIMIT 1), "
    "two AS MATERIALIZED (SELECT d, v FROM gd WHERE id = (SELECT id FROM b)), "
    "m AS (SELECT sum(o.v * o.v) AS oo, sum(o.v * u.v) AS ou, sum(u.v * u.v) AS uu, sum(o.v * t.v) AS ot, sum(u.v * t.v) AS ut FROM one o JOIN two u USING (d) JOIN tg t USING (d)), "
    "s AS (SELECT *, (ot * uu - ut * ou) / (oo * uu - ou * ou) AS p, (ut * oo - ot * ou) / (oo * uu - ou * ou) AS q FROM m), "
    "weighed AS (SELECT CASE WHEN p > 0 AND q > 0 THEN p WHEN q <= 0 THEN greatest(ot / oo, 0) ELSE 0 END AS p, CASE WHEN p > 0 AND q > 0 THEN q WHEN p <= 0 AND q > 0 THEN greatest(ut / uu, 0) ELSE 0 END AS q FROM s) "
    "SELECT CAST(rank AS INTEGER) AS rank, id, round(w, 6) AS score, round(w, 6) AS weight FROM (SELECT 1 AS rank, (SELECT id FROM a) AS id, p AS w FROM weighed UNION ALL SELECT 2, (SELECT id FROM b), q FROM weighed)"
)

ORACLES["kernel_cosine"] = f"WITH {BASE}, {UU} SELECT i AS id, round(sum(s), 6) AS v FROM kern GROUP BY i"
ORACLES["kernel_rbf"] = f"WITH {BASE}, {kernel('kern', 'un', 'un', _D2G)} SELECT i AS id, round(sum(exp(-s / 2)), 6) AS v FROM kern GROUP BY i"
ORACLES["facility_location"] = unrolled(K, FACILITY, f"{BASE}, {UU}")
ORACLES["facility_location_gradients"] = unrolled(K, FACILITY, f"{BASE}, {kernel('kern', 'un', 'un', f'({GRADIENT} / sqrt({GNORM.format('a')} * {GNORM.format('b')}) + 1) / 2')}")
ORACLES["facility_location_euclidean"] = unrolled(K, FACILITY, f"{BASE}, {kernel('kern', 'un', 'un', f'1 / (1 + {_DIST})')}")
NEAR = f"{kernel('every', 'un', 'un', COSINE)}, kern AS MATERIALIZED (SELECT i, j, s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM every) WHERE r <= {NEIGHBOURS})"
ORACLES["facility_location_sparse"] = unrolled(K, FACILITY, f"{BASE}, {NEAR}")
ORACLES["flcmi_sparse"] = unrolled(K, capped("greatest(least({m}, q) - p, 0)", ("q", "qk"), ("p", "pk")), f"{BASE}, {NEAR}, {QU}, {PU}")
ORACLES["feature_based"] = unrolled(
    K,
    "SELECT f.id, sum(ln(1 + coalesce(h, 0) + f) - ln(1 + coalesce(h, 0))) AS v FROM ft f LEFT JOIN (SELECT d, sum(f) AS h FROM ft WHERE id IN {chosen} GROUP BY d) USING (d) GROUP BY f.id",
    f"{BASE}, ft AS MATERIALIZED (SELECT id, d, abs(x[d]) AS f FROM un, range(1, 65) t(d))",
)
ORACLES["graph_cut"] = unrolled(K, graph_cut(0.5), f"{BASE}, {UU}")
ORACLES["disparity_sum"] = unrolled(K, "SELECT j AS id, coalesce(sum(1 - s) FILTER (WHERE i IN {chosen}), 0) AS v FROM kern GROUP BY j", f"{BASE}, {UU}")
ORACLES["disparity_min"] = unrolled(K, "SELECT j AS id, coalesce(min(1 - s) FILTER (WHERE i IN {chosen}), 0) AS v FROM kern GROUP BY j", f"{BASE}, {UU}")
ORACLES["fl1mi"] = unrolled(K, capped("least({m}, q)", ("q", "qk")), f"{BASE}, {UU}, {QU}")
ORACLES["flcg"] = unrolled(K, capped("greatest({m} - p, 0)", ("p", "pk")), f"{BASE}, {UU}, {PU}")
ORACLES["flcmi"] = unrolled(K, capped("greatest(least({m}, q) - p, 0)", ("q", "qk"), ("p", "pk")), f"{BASE}, {UU}, {QU}, {PU}")
ORACLES["fl2mi"] = unrolled(K, f"SELECT j AS id, sum(greatest(s - coalesce(m, 0), 0)) + max(s) AS v FROM qk LEFT JOIN {CUR_Q} cur USING (i) GROUP BY j", f"{BASE}, {QU}")
ORACLES["com"] = unrolled(
    K,
    "SELECT j AS id, sum(sqrt(coalesce(m, 0) + s) - sqrt(coalesce(m, 0))) + sqrt(sum(s)) AS v FROM qk LEFT JOIN (SELECT i, sum(s) AS m FROM qk WHERE j IN {chosen} GROUP BY i) cur USING (i) GROUP BY j",
    f"{BASE}, {QU}",
)
ORACLES["gcmi"] = f"WITH {BASE}, {QU}, g AS (SELECT j AS id, 2 * sum(s) AS v FROM qk GROUP BY j) SELECT CAST(row_number() OVER (ORDER BY v DESC, id) AS INTEGER) AS rank, id, round(v, 6) AS score FROM g ORDER BY rank LIMIT {K}"
ORACLES["gccg"] = unrolled(K, f"SELECT g.id, g.v - 2 * t AS v FROM ({graph_cut(1.0)}) g JOIN (SELECT j AS id, sum(s) AS t FROM pk GROUP BY j) USING (id)", f"{BASE}, {UU}, {PU}")

ORACLES["partition_entropy"] = (
    f"WITH {BASE}, sc AS (SELECT id, {ENTROPY} AS s, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM un), "
    f"pl AS (SELECT i, ceil(n * (i + 1) / 3.0) AS e, ceil(n * i / 3.0) AS b, n FROM range(3) t(i), (SELECT count(*) AS n FROM un)), "
    f"own AS (SELECT id, s, i, row_number() OVER (PARTITION BY i ORDER BY s DESC, id) AS place, ceil({TOP} * e / pl.n) - ceil({TOP} * b / pl.n) AS budget FROM sc JOIN pl ON pos >= b AND pos < e) "
    "SELECT CAST(row_number() OVER (ORDER BY i, place) AS INTEGER) AS rank, id, round(s, 6) AS score FROM own WHERE place <= budget"
)
ORACLES["deepfool_linear"] = top(
    "(SELECT u.id, min(abs(u.z[b.c + 1] - u.z[a.c + 1]) / list_distance(a.w, b.w)) AS d FROM un u JOIN w a ON a.c = u.pred JOIN w b ON b.c <> u.pred GROUP BY u.id)",
    "(1.02 * (d + 1e-4)) ^ 2",
    direction="ASC",
)

ORACLES["accuracy"] = f"WITH {BASE} SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM un"
ORACLES["class_accuracy"] = f"WITH {BASE} SELECT label, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM un GROUP BY label"
ORACLES["error_per_class"] = f"WITH {BASE}, e AS (SELECT label, 100 * avg(CASE WHEN pred <> label THEN 1.0 ELSE 0.0 END) AS error FROM un GROUP BY label) SELECT label, round(error, 6) AS error FROM e UNION ALL SELECT NULL, round(avg(error), 6) FROM e"
ORACLES["query_set"] = f"WITH {BASE} SELECT id, label FROM lab WHERE label IN (0, 1) AND pred <> label"
_chosen = f"ch AS MATERIALIZED (SELECT id FROM un ORDER BY {ENTROPY} DESC, id LIMIT {TOP})"
_random = f"rd AS MATERIALIZED (SELECT id, label FROM un ORDER BY {uniform("'0:' || id")}, id LIMIT 50)"
ORACLES["round_update"] = (
    f"WITH {BASE}, {_chosen}, fl AS MATERIALIZED (SELECT id FROM un WHERE id NOT IN (SELECT id FROM ch) ORDER BY {uniform("'0:' || id")}, id LIMIT 5), mv AS (SELECT id FROM ch UNION ALL SELECT id FROM fl) "
    "SELECT id, CASE WHEN id % 5 = 0 OR id IN (SELECT id FROM mv) THEN 'train' ELSE 'pool' END AS part FROM base"
)
ORACLES["private_growth"] = f"WITH {BASE}, {_chosen} SELECT id, label FROM ps UNION ALL SELECT id, label FROM un WHERE id IN (SELECT id FROM ch)"
ORACLES["ood_filter"] = f"WITH {BASE}, {_random} SELECT id, label FROM rd WHERE label < 8"
ORACLES["id_fraction"] = f"WITH {BASE}, {_random} SELECT round(avg(CASE WHEN label <> 9 THEN 1.0 ELSE 0.0 END), 6) AS share FROM rd"
ORACLES["selection_class_counts"] = f"WITH {BASE}, {_random} SELECT label, count(*) AS n FROM rd GROUP BY label"
ORACLES["unique_overlap"] = f"WITH {BASE}, {_random} SELECT count(DISTINCT id // 10) AS n_unique, count(*) AS n FROM rd"
ORACLES["selection_overlap"] = f"WITH {BASE}, a AS (SELECT id FROM un ORDER BY {SCORE['entropy']} DESC, id LIMIT 50), b AS (SELECT id FROM un ORDER BY {SCORE['margin']} DESC, id LIMIT 50) SELECT count(*) AS n_common FROM a JOIN b USING (id)"
ORACLES["make_redundant"] = (
    f"WITH {BASE}, pl AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS pos, CAST(ceil(count(*) OVER (PARTITION BY label) / 10.0) AS BIGINT) AS keep FROM base) "
    "SELECT a.id, b.id AS source_id, a.label FROM pl a JOIN pl b ON a.label = b.label AND b.pos = a.pos % a.keep AND b.pos < b.keep"
)
ORACLES["duplicated_pool"] = f"WITH {BASE} SELECT id * 10 + c AS id, id AS source_id FROM un, range(10) t(c)"
ORACLES["unique_fraction"] = (
    f"WITH {BASE}, many AS (SELECT id * 10 + c AS id, id AS source_id FROM base, range(10) t(c)), ch AS (SELECT * FROM many ORDER BY {uniform("'0:' || id")}, id LIMIT 50) "
    "SELECT round(count(DISTINCT source_id) FILTER (WHERE source_id % 5 <> 0) / 50.0, 6) AS share FROM ch"
)
_seeds = [unrolled(2, FACILITY, f"{BASE}, own AS (SELECT * FROM un WHERE label = {c}), {kernel('kern', 'own', 'own', COSINE)}") for c in range(CLASSES)]
ORACLES["fl_seed_per_class"] = " UNION ALL ".join(f"SELECT *, {c} AS label FROM ({s})" for c, s in enumerate(_seeds))
ORACLES["balanced_split"] = "WITH p AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) SELECT id, label, CASE WHEN n <= 3 THEN 'seed' ELSE 'pool' END AS part FROM p WHERE n <= 13"
_drawn = f"p AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY {uniform("'0:' || vec_id")}, vec_id) AS n FROM embeddings)"
ORACLES["rare_split"] = f"WITH {_drawn}, q AS (SELECT *, CASE WHEN label < 3 THEN 1 ELSE 10 END AS a, CASE WHEN label < 3 THEN 5 ELSE 40 END AS b FROM p) SELECT id, label, CASE WHEN n <= a THEN 'seed' ELSE 'pool' END AS part FROM q WHERE n <= b"
ORACLES["ood_split"] = f"WITH {_drawn} SELECT id, label, CASE WHEN label >= 8 THEN 'ood' WHEN n <= 5 THEN 'seed' ELSE 'pool' END AS part FROM p WHERE n <= 25"
_curve = "cv AS (SELECT CAST(vec_id % 20 AS INTEGER) AS round, 1 - 1 / (vec_id % 20 + 1.0::DOUBLE) + (max(vec_id) % 3) / 1000::DOUBLE AS accuracy FROM embeddings GROUP BY vec_id % 20)"
ORACLES["saturation"] = (
    f"WITH {_curve}, g AS (SELECT b.round, max(b2.accuracy - a.accuracy) AS gain FROM cv b JOIN cv b2 ON b2.round BETWEEN b.round - 9 AND b.round JOIN cv a ON a.round BETWEEN b.round - 9 AND b.round AND a.round < b2.round GROUP BY b.round) "
    "SELECT cv.round, round(gain, 6) AS gain, CASE WHEN cv.round < 9 THEN false ELSE gain < 0.06 END AS saturated FROM cv LEFT JOIN g USING (round)"
)
ORACLES["cumulative_time"] = "SELECT event_type, count(*) AS n, round(max(r), 3) AS highest FROM (SELECT event_type, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM events) GROUP BY event_type"
_quoted = PUNCTUATION.replace("'", "''")
ORACLES["text_clean"] = (
    f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(translate(translate(text, '{_quoted}', ''), '{ACCENTED}', '{PLAIN}')), '[ \\t\\n\\r]+'), "
    f"lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})), ' ') AS cleaned FROM documents"
)
ORACLES["text_class_balance"] = "SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality"

_share = f"SELECT id, v FROM ({FACILITY}) WHERE {uniform("'0:' || id || ':{step}'")} < {math.log(100) / K}"
ORACLES["stochastic_greedy"] = unrolled(K, _share, f"{BASE}, {UU}")
# Log-determinants by Cholesky rows: what the rows taken so far explain of each candidate is the square of its row.
RIDGE = 1e-6
_LEFT = "(1 + {diagonal} - coalesce(list_dot_product({r}.l, {r}.l), 0))"
_ROW = "({w} * ({s}) + CASE WHEN {same} THEN {diagonal} ELSE 0 END - coalesce(list_dot_product(a.l, b.l), 0)) / sqrt({left})"


def explained(name: str, *sets: tuple[str, float], s: str = COSINE) -> str:
    """Each pool row's Cholesky row over the rows of ``sets``, whose similarities to the pool are scaled by a weight."""
    rows = " UNION ALL ".join(f"SELECT id, x, {w} AS w FROM {t}" for t, w in sets)
    entry = _ROW.format(w="CASE WHEN a.n IS NULL THEN g.w ELSE 1 END", s=s, same="a.n = b.n", diagonal=RIDGE, left=_LEFT.format(diagonal=RIDGE, r="b"))
    return (
        f"{name}_g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, id) AS n FROM ({rows})), "
        f"{name}_r AS (SELECT 0 AS t, n, id, x, CAST([] AS DOUBLE[]) AS l FROM {name}_g UNION ALL SELECT 0, NULL, id, x, CAST([] AS DOUBLE[]) FROM un "
        f"UNION ALL SELECT a.t + 1, a.n, a.id, a.x, list_append(a.l, {entry}) FROM {name}_r a JOIN {name}_g g ON g.n = a.t + 1 JOIN {name}_r b ON b.n = a.t + 1), "
        f"{name} AS MATERIALIZED (SELECT id, x, l FROM {name}_r WHERE n IS NULL AND t = (SELECT count(*) FROM {name}_g))"
    )


def log_determinants(signs: dict[str, int], given: str = "", diagonal: float = RIDGE, k: int = K, s: str = COSINE) -> str:
    """Greedy steps by the sum of the signed log-determinant gains, one per table of Cholesky rows."""

    def between(t: int) -> list[str]:
        if t == 0:
            return [f"{name}0 AS MATERIALIZED (SELECT * FROM {name})" for name in signs]
        entry = _ROW.format(w="1", s=s, same="a.id = b.id", diagonal=diagonal, left=_LEFT.format(diagonal=diagonal, r="b"))
        return [f"{name}{t} AS MATERIALIZED (SELECT a.id, a.x, list_append(a.l, {entry}) AS l FROM {name}{t - 1} a, {name}{t - 1} b JOIN pick{t - 1} p ON p.id = b.id)" for name in signs]

    gains = " ".join(f"{'+' if sign > 0 else '-'} ln(greatest({_LEFT.format(diagonal=diagonal, r=name)}, 1e-12))" for name, sign in signs.items())
    first, *others = signs
    joined = f"{first}{{step}} {first} " + " ".join(f"JOIN {name}{{step}} {name} ON {name}.id = {first}.id" for name in others)
    nothing = "alone AS MATERIALIZED (SELECT id, x, CAST([] AS DOUBLE[]) AS l FROM un)"
    return "WITH RECURSIVE" + unrolled(k, f"SELECT {first}.id, {gains} AS v FROM {joined}", ", ".join(x for x in (BASE, nothing, given) if x), between=between).removeprefix("WITH")


ORACLES["log_determinant"] = log_determinants({"alone": 1}, diagonal=1.0)
ORACLES["log_determinant_fifty"] = log_determinants({"alone": 1}, diagonal=1.0, k=50)
for _name, _s in {"": COSINE, "_euclidean": f"1 / (1 + {_DIST})"}.items():
    _by_p = explained("by_p", ("ps", 0.9), s=_s)
    ORACLES[f"logdetmi{_name}"] = log_determinants({"alone": 1, "by_q": -1}, explained("by_q", ("qs", 0.9), s=_s), s=_s)
    ORACLES[f"logdetcg{_name}"] = log_determinants({"by_p": 1}, _by_p, s=_s)
    ORACLES[f"logdetcmi{_name}"] = log_determinants({"by_p": 1, "by_both": -1}, f"{_by_p}, {explained('by_both', ('ps', 0.9), ('qs', 0.9), s=_s)}", s=_s)

_parts = [
    unrolled(
        K,
        "SELECT j AS id, least(any_value(n), coalesce(min(s) FILTER (WHERE i IN {chosen}), any_value(n))) AS v FROM kern JOIN near ON near.id = j GROUP BY j",
        f"{BASE}, pl AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM un), own AS MATERIALIZED (SELECT * FROM pl WHERE CASE WHEN pos < ceil(n / 2.0) THEN 0 ELSE 1 END = {part}), "
        f"{kernel('kern', 'own', 'own', _DIST)}, near AS MATERIALIZED (SELECT b.id, min({_DIST}) AS n FROM lab a, own b GROUP BY b.id)",
    )
    for part in range(2)
]
ORACLES["partition_coreset"] = (
    f"WITH sz AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0), bd AS (SELECT CAST(ceil({K} * ceil(n / 2.0) / n) AS INTEGER) AS first FROM sz), "
    f"al AS (SELECT 0 AS part, * FROM ({_parts[0]}) UNION ALL SELECT 1, * FROM ({_parts[1]})) "
    f"SELECT CAST(row_number() OVER (ORDER BY part, rank) AS INTEGER) AS rank, id, score FROM al, bd WHERE rank <= CASE WHEN part = 0 THEN first ELSE {K} - first END"
)

_SHIFTED = "list_transform(range(64), lambda d: x[d + 1] + ch[d + 1])"
ORACLES["bim"] = (
    f"WITH RECURSIVE {BASE}, ww AS MATERIALIZED (SELECT list(w ORDER BY c) AS ws FROM w), "
    "st AS (SELECT 0 AS t, id, x, pred, list_transform(range(64), lambda d: CAST(0 AS DOUBLE)) AS ch FROM un UNION ALL "
    "SELECT t + 1, id, x, pred, list_transform(range(64), lambda d: ch[d + 1] + 0.05 * sign(list_sum(list_transform(range(10), lambda c: (e[c + 1] / list_sum(e) - CASE WHEN c = pred THEN 1 ELSE 0 END) * ws[c + 1][d + 1])))) "
    "FROM (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM "
    f"(SELECT st.*, ws, list_transform(ws, lambda w: list_dot_product(w, {_SHIFTED})) AS z FROM st, ww WHERE t < 1000) WHERE list_position(z, list_max(z)) - 1 = pred)), "
    "sc AS (SELECT id, arg_max(list_dot_product(ch, ch), t) AS s FROM st GROUP BY id) "
    f"SELECT CAST(row_number() OVER (ORDER BY s, id) AS INTEGER) AS rank, id, round(s, 6) AS score FROM sc ORDER BY rank LIMIT {TOP}"
)


def _lloyd(tag: str, seed: int) -> str:
    """Five iterations from k-means++ centres drawn with ``seed``; the last assignment is {tag}a5."""
    drawn = lambda t: f"CASE WHEN v > 1e-12 THEN ln({uniform(f"'{seed}:' || id || ':{t}'")}) / v END DESC NULLS LAST"
    seeds = unrolled(K, "SELECT j AS id, coalesce(min(s) FILTER (WHERE i IN {chosen}), 1.0) AS v FROM kern GROUP BY j", f"{BASE}, {kernel('kern', 'un', 'un', _D2)}", pick=drawn)
    steps = ", ".join(f"{_assigned(f'{tag}a{t}', f'{tag}c{t}')}, {_means(f'{tag}c{t + 1}', f'{tag}a{t}', f'{tag}c{t}')}" for t in range(5))
    return f"{tag}c0 AS MATERIALIZED (SELECT CAST(rank - 1 AS INTEGER) AS centre, x FROM ({seeds}) JOIN un USING (id)), {steps}, {_assigned(f'{tag}a5', f'{tag}c5')}"


ORACLES["kmeans_best_of"] = (
    f"WITH {BASE}, {_lloyd('f', 3)}, {_lloyd('g', 4)}, bt AS (SELECT (SELECT sum(s) FROM ga5) < (SELECT sum(s) FROM fa5) AS later), "
    "al AS (SELECT a.* FROM fa5 a, bt WHERE NOT later UNION ALL SELECT a.* FROM ga5 a, bt WHERE later) "
    "SELECT CAST(centre + 1 AS INTEGER) AS rank, id, round(sqrt(s), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY s, id) AS n FROM al) WHERE n = 1"
)


def _sampled_joints(t: int) -> list[str]:
    """The chosen rows' joint outcomes: exact up to 200, else 50 drawn per pass, weighed by their mean probability."""
    before = " UNION ALL ".join(f"SELECT {r} AS r, id FROM pick{r}" for r in range(t)) or "SELECT 0 AS r, CAST(NULL AS BIGINT) AS id WHERE false"
    out = [f"bc{t} AS MATERIALIZED (SELECT r, bc.id, k, p FROM ({before}) bc JOIN mp USING (id))"]
    if CLASSES**t > 200:
        u = uniform(f"'{t - 1}:' || r || ':' || k || ':' || m")
        out.append(f"bd{t} AS MATERIALIZED (SELECT k AS own, m, r, least(len(list_filter(list_transform(range({CLASSES}), lambda c: list_sum(p[1:c + 1])), lambda v: {u} > v)), {CLASSES - 1}) AS c FROM bc{t}, range(50) t(m))")
        out.append(f"bj{t} AS (SELECT own * 50 + m AS m, k, product(p[c + 1]) AS j FROM bd{t} JOIN bc{t} USING (r) GROUP BY 1, 2)")
        out.append(f"jt{t} AS MATERIALIZED (SELECT m, k, j, 1 / ({50 * N_DROP} * avg(j) OVER (PARTITION BY m)) AS w FROM bj{t})")
    else:
        tables = "".join(f" JOIN bc{t} b{r} ON b{r}.r = {r} AND b{r}.k = ks.k" for r in range(t)) + "".join(f", range({CLASSES}) c{r}(c)" for r in range(t))
        number = " + ".join([f"c{r}.c * {CLASSES**r}" for r in range(t)] or ["0"])
        chance = " * ".join([f"b{r}.p[c{r}.c + 1]" for r in range(t)] or ["1.0"])
        out.append(f"jt{t} AS MATERIALIZED (SELECT {number} AS m, ks.k, {chance} AS j, 1.0 AS w FROM range({N_DROP}) ks(k){tables})")
    return out


ORACLES["batchbald_sampled"] = unrolled(
    5,
    f"SELECT e.id, e.v - ch.h - coalesce((SELECT sum(h) FROM ch WHERE id IN {{chosen}}), 0) AS v FROM ch JOIN (SELECT id, -sum(w * q * CASE WHEN q > 0 THEN ln(q) ELSE 0 END) AS v "
    f"FROM (SELECT id, m, c, any_value(w) AS w, sum(j * p[c + 1]) / {N_DROP} AS q FROM jt{{step}} JOIN mp USING (k), range({CLASSES}) t(c) GROUP BY id, m, c) GROUP BY id) e ON e.id = ch.id",
    f"{BASE}, {MASKS}, ch AS MATERIALIZED (SELECT id, avg({ENTROPY}) AS h FROM mp GROUP BY id)",
    between=_sampled_joints,
)


def trained(trainer, average_from: int | None = None) -> str:
    """Synchronous steps of a linear head one by one, over (class, dimension, weight, two states)."""
    weights = [(c, d, v) for c, (w, b) in enumerate(zip(START.weights.tolist(), START.bias.tolist())) for d, v in enumerate([*w, b])]
    number = f"CAST(least({trainer.batches - 1}, floor({uniform(f"'{trainer.seed}:batch:' || id")} * {trainer.batches})) AS INTEGER)"
    parts = [
        BASE.strip(),
        f"tr AS (SELECT id, label, {number} AS n, list_append(x, 1) AS x FROM base WHERE id % 5 = 0)",
        "xs AS MATERIALIZED (SELECT id, label, n, d, x[d + 1] AS x FROM tr, range(65) t(d))",
        f"w0 AS MATERIALIZED (SELECT c, d, CAST(w AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM (VALUES {', '.join(f'({c}, {d}, {v!r}::DOUBLE)' for c, d, v in weights)}) t(c, d, w))",
    ]
    t, ends = 0, []
    for epoch in range(trainer.epochs):
        rate = trainer.rate_of(epoch)
        for b in sorted(range(trainer.batches), key=lambda b: uniform_number(trainer.seed, epoch, b)):
            if trainer.optimizer == "sgd":
                state = "0.9 * w.m + g.g + 0.0005 * w.w AS m, CAST(0 AS DOUBLE) AS v"
                moved = f"w - {rate!r} * m"
            else:
                state = "0.9 * w.m + 0.1 * g.g AS m, 0.999 * w.v + 0.001 * g.g * g.g AS v"
                moved = f"w - {rate!r} * (m / {1 - 0.9 ** (t + 1)!r}) / (sqrt(v / {1 - 0.999 ** (t + 1)!r}) + 1e-8)"
            parts += [
                f"z{t} AS (SELECT id, label, c, sum(x * w) AS z FROM xs JOIN w{t} USING (d) WHERE n = {b} GROUP BY ALL)",
                f"e{t} AS MATERIALIZED (SELECT id, c, exp(z - max(z) OVER (PARTITION BY id)) AS e, CASE WHEN c = label THEN 1 ELSE 0 END AS y FROM z{t})",
                f"p{t} AS MATERIALIZED (SELECT id, c, e / sum(e) OVER (PARTITION BY id) - y AS r FROM e{t})",
                f"g{t} AS MATERIALIZED (SELECT c, d, sum(r * x) / count(*) AS g FROM p{t} JOIN xs USING (id) GROUP BY c, d)",
                f"w{t + 1} AS MATERIALIZED (SELECT c, d, {moved} AS w, m, v FROM (SELECT w.c, w.d, w.w, {state} FROM w{t} w JOIN g{t} g ON w.c = g.c AND w.d = g.d))",
            ]
            t += 1
        ends.append(t)
    last = [f"w{t}"] if average_from is None else [f"w{e}" for e in ends[average_from:]]
    rows = " UNION ALL ".join(f"SELECT c, d, w FROM {name}" for name in last)
    return f"WITH {', '.join(parts)} SELECT CAST(c AS INTEGER) AS class, CAST(d AS INTEGER) AS d, round(avg(w), 6) AS v FROM ({rows}) GROUP BY c, d"


ORACLES["sgd_training"] = trained(SGD)
ORACLES["adam_training"] = trained(ADAM)
ORACLES["averaged_training"] = trained(SGD, 1)

ORACLES["strategies_by_name"] = " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, rank, id, score FROM ({ORACLES[known]})"
    for name, known in {
        "entropy_sampling": "entropy",
        "margin_sampling": "margin",
        "least_confidence": "least_confidence",
        "bald_dropout": "bald",
        "random_sampling": "random_selection",
        "adversarial_deepfool": "deepfool_linear",
        "coreset": "coreset",
        "badge": "badge",
        "fass": "fass_entropy",
        "glister": "glister_no_validation",
        "kmeans_sampling": "kmeans_best_of",
        "adversarial_bim": "bim",
    }.items()
)
