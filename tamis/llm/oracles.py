"""SQL that gives the text operators' results, where SQL can, written from the definitions."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}+')"


def _rate(rule: str) -> str:
    """The host's failure rate shrunk by the beta prior that fits all hosts' rates by moments."""
    return f"""
{rule}_m AS (SELECT *, least(greatest(f / n, 1e-6), 1 - 1e-6) AS mean FROM (SELECT CAST(sum({rule}) AS DOUBLE) AS f, CAST(sum(n) AS DOUBLE) AS n, count(*) AS hosts,
  sum(n * ({rule} / n) * ({rule} / n)) AS sq, sum(CAST(n AS DOUBLE) * n) AS n2 FROM hosts)),
{rule}_s AS (SELECT *, CASE WHEN n - n2 / n > 0 THEN (sq - n * mean * mean - mean * (1 - mean) * (hosts - 1)) / (n - n2 / n) ELSE 0 END AS spread FROM {rule}_m),
{rule}_p AS (SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE n / hosts END, 1), n / hosts) AS weight FROM {rule}_s)"""


OP2 = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM dup, range(3) t(k) GROUP BY doc_id),
lin AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM w),
base AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM w JOIN lin USING (doc_id) LEFT JOIN cov USING (doc_id)),
ruled AS (SELECT *, n_words < 50 AS a, 100 * n_repeat_words > 50 * n_words AS b FROM base),
hosts AS (SELECT source, count(*) AS n, sum(CAST(a AS INT)) AS a, sum(CAST(b AS INT)) AS b FROM ruled GROUP BY source),{_rate('a')},{_rate('b')},
verdict AS (SELECT source, greatest((hosts.a + a_p.mean * a_p.weight) / (n + a_p.weight), (hosts.b + b_p.mean * b_p.weight) / (n + b_p.weight)) <= 0.5 AS ok FROM hosts, a_p, b_p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a OR b AS base_failed, NOT (a OR b) AND ok AS kept
FROM ruled JOIN verdict ON ruled.source IS NOT DISTINCT FROM verdict.source"""

OP3 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) - 1 AS m FROM s),
l AS (SELECT m, 2.0 * source_size / weight AS ratio, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(2.0 * source_size) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CAST(least(2.0 * source_size, weight * (SELECT arg_min(level, m) FROM l WHERE level <= ratio)) AS DOUBLE) AS target FROM s),
q AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, (CAST('0x' || substr(md5('17:' || doc_id), 1, 8) AS UBIGINT) + 0.5) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q"""

OP5 = f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k"""

OP6 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT *, regexp_matches(line, '{WORD}') AS word FROM l),
n AS (SELECT *, CASE WHEN word THEN row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) END AS k, regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS bare FROM f),
w AS (SELECT doc_id, k, bare || chr(10) || lead(bare, 1) OVER o || chr(10) || lead(bare, 2) OVER o AS g FROM n WHERE word WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
x AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS seen FROM w WHERE g IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM x, range(3) t(j) WHERE seen > 1),
m AS (SELECT n.*, gone.k IS NOT NULL AS out FROM n LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.k = gone.k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '') AS text, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE out) AS n_removed FROM m GROUP BY doc_id"""

OP11 = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
f AS (SELECT w.doc_id, part, CAST(len(words) < 200 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) AS b,
  CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d,
  CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS INT) AS e FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [a, b, c, d, e] AS fails, a + b + c + d + e AS n_fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
n5 AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [p.k, q.k, r.k, s.k, t.k] AS ord FROM n5 p, n5 q, n5 r, n5 s, n5 t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
x AS (SELECT part, array_to_string(list_transform(ord, lambda v: substr('ABCDE', v, 1)), '') AS filter_order, ord, n5.k AS step, ord[n5.k] AS own, n, good, toxic, n_fails, fails[ord[n5.k]] = 1 AS hit,
  len(list_filter(ord[1:n5.k - 1], lambda v: fails[v] = 1)) > 0 AS before FROM m, o, n5),
g AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE NOT hit AND NOT before) AS kept, sum(n) FILTER (WHERE hit AND NOT before) AS removed, sum(n) FILTER (WHERE hit AND before) AS redundant,
  sum(n) FILTER (WHERE hit AND n_fails = 1) AS unique_fails, sum(good) FILTER (WHERE hit AND NOT before) AS good_lost, sum(toxic) FILTER (WHERE hit AND NOT before) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM g"""

_TWENTY = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, 20)]])

OP12 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
v AS MATERIALIZED (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
s AS (SELECT doc_id, pos AS i, {_TWENTY} AS g FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS seen FROM s WHERE g IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM x, range(20) t(k) WHERE seen > 1),
cut AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.pos) AS text FROM v LEFT JOIN gone ON v.doc_id = gone.doc_id AND v.pos = gone.pos WHERE gone.pos IS NULL GROUP BY v.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _clustered(rounds: int = 3) -> str:
    """Rounds written out one by one; a centroid is a list, rounded-down means come by whole-number arithmetic."""
    sql = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 16))"""
    for k in range(rounds + 1):
        sql += f""",
p{k} AS (SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS distance FROM v, c{k}),
a{k} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(cluster, distance * 1000 + cluster) AS cluster, min(distance) AS distance FROM p{k} GROUP BY vec_id)"""
        if k < rounds:
            sql += f""",
e{k} AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{k}),
m{k} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS c FROM (SELECT cluster, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{k} GROUP BY cluster, d) GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (cluster))"""
    return sql + f"""
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


OP13 = _clustered()

ORACLES = {"op2_host_quality": OP2, "op3_source_mix": OP3, "op5_exact_dedup": OP5, "op6_line_dedup": OP6, "op11_filter_audit": OP11, "op12_substring_dedup": OP12, "op13_centroids": OP13}
