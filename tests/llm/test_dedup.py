import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tamis.llm.components import star_components
from tamis.llm.exact_dedup import drop_copies, exact_dedup
from tamis.llm.line_dedup import WINDOW, dedup_lines


def plain_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((d, t))
    out = []
    for norm, own in groups.items():
        best = min(range(len(own)), key=lambda i: (-len(own[i][1] or ""), own[i][0] is None, own[i][0] or 0))
        out += [(d, own[best][0], len(own), i == best, hashlib.sha256(norm.encode()).hexdigest()) for i, (d, _) in enumerate(own)]
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(spark, docs, odd_docs, no_docs):
    repeated = spark.createDataFrame([(7, "same"), (7, "same"), (7, " sa me"), (None, "same"), (None, "lone"), (None, None), (None, ""), (8, "lone")] * 2, "doc_id long, text string").repartition(3)
    for table in (docs, odd_docs, no_docs, repeated):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        for runs, fan_in in ((64, 4), (5, 2), (1, 2)):
            got = exact_dedup(table, runs, fan_in).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
            assert sorted(map(tuple, got), key=str) == plain_exact(rows)


def test_one_row_of_a_group_stays(spark, odd_docs):
    made = [(7, "same", 1), (7, "same", 2), (7, "sa me ", 3), (None, "lone", 4), (None, "other", 5), (None, "lone", 6), (9, None, 7), (9, "", 8)]
    kept = drop_copies(spark.createDataFrame(made, "doc_id long, text string, _row int").repartition(4))
    assert kept.columns == ["doc_id", "text", "_row"]
    assert sorted(map(str, ((r["doc_id"], r["text"] or "") for r in kept.collect()))) == sorted(map(str, [(7, "sa me "), (None, "lone"), (None, "other"), (9, "")]))
    assert drop_copies(odd_docs).count() == len({re.sub("[\x20\x09-\x0d]", "", r["text"] or "") for r in odd_docs.collect()})


def plain_key(d, t):
    return d is None, d or 0, hashlib.md5((t or "").encode()).digest()


def plain_lines(rows):
    places = []
    for d, t in rows:
        full = [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")]
        full = [x for x in full if x]
        places += [("\n".join(full[i : i + WINDOW]), plain_key(d, t), i) for i in range(len(full) - WINDOW + 1)]
    first = {}
    for w, d, i in places:
        first[w] = min(first.get(w, (d, i)), (d, i))
    gone = defaultdict(set)
    for w, d, i in places:
        if first[w] != (d, i):
            gone[d] |= set(range(i, i + WINDOW))
    out = []
    for d, t in rows:
        own, n, kept = gone[plain_key(d, t)], 0, []
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                if n not in own:
                    kept.append(line)
                n += 1
            else:
                kept.append(line)
        out.append((d, t if not own else "\n".join(kept), n, len(own)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark, docs, odd_docs, no_docs):
    lines = [f"line {i}" for i in range(9)]
    made = [(1, "\n".join(lines)), (2, "x\n" + "\n".join(lines[2:7]) + "\n\ny"), (3, "\n".join(lines[:3] * 4)), (4, "\n".join(["same"] * 8)), (5, "a\nb")]
    small = spark.createDataFrame(made, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    again = [(None, "\n".join(f"a{i}" for i in range(6))), (None, "b\n" + "\n".join(f"a{i}" for i in range(4))), (None, "c1\nc2\nc3"), (5, "c1\nc2\nc3\nc4"), (5, "c0\nc1\nc2\nc3"), (5, "c0\nc1\nc2\nc3")]
    repeated = spark.createDataFrame(again, "doc_id long, text string").repartition(3)
    for table in (small, docs, odd_docs, no_docs, repeated):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        got = dedup_lines(table).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted(map(tuple, got), key=str) == plain_lines(rows)


def test_star_components(spark):
    import random

    random.seed(5)
    links = [(i, i + 1) for i in range(1, 40)] + [(100 + random.randrange(60), 100 + random.randrange(60)) for _ in range(45)] + [(-5, 7), (300, 300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = {r["node"]: r["root"] for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
