import numpy as np
import xxhash

from tamis.llm.simhash import MASKS, drop_near_copies, near_links, simhash_components, tile_links


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows, radius=3):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(fps)], key=str)


def test_components_match_brute_force(docs, odd_docs, no_docs):
    for table in (docs, odd_docs, no_docs):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        assert sorted(map(tuple, simhash_components(table).collect()), key=str) == plain(rows)


def test_one_row_of_a_component_stays(spark, docs, odd_docs):
    repeated = spark.createDataFrame([(7, "a b c d", 1), (7, "a b c d", 2), (None, "a b c d", 3), (None, "lone", 4), (None, "lone", 5), (3, None, 6)], "doc_id long, text string, row int")
    for table in (docs, odd_docs, repeated):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        want = {c for _, _, c in plain(rows) if c is not None}
        nameless = [c for _, _, c in plain(rows) if c is None]
        kept = drop_near_copies(table)
        assert kept.columns == table.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert sorted(d for d in ids if d is not None) == sorted(want)
        assert (None in ids) == bool(nameless)


def test_any_three_differing_bits_leave_a_table_that_agrees():
    rng = np.random.default_rng(1)
    assert len(MASKS) == 20 and all(28 <= m.bit_count() <= 36 for m in MASKS)
    for _ in range(2000):
        change = sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
        assert any(change & m == 0 for m in MASKS)


def test_no_link_is_lost_between_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    some = [b ^ np.uint64(sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 5)))) for b in base for _ in range(20)]
    dense = [np.uint64(sum(1 << int(k) for k in rng.integers(0, 20, 3))) for _ in range(300)]  # one crowded band value
    fps = np.unique(np.array(some + dense, np.uint64))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")

    def components(links):
        root = {int(x): int(x) for x in fps.view(np.int64)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = components((fps.view(np.int64)[i], fps.view(np.int64)[j]) for i, j in zip(*np.nonzero(near)))
    for tile in (2048, 16):
        links = [(r["a"], r["b"]) for r in near_links(table, tile=tile, salts=3).collect()]
        assert components(links) == want
        assert len(links) < 20 * len(fps) * 8


def test_tile_links_span_their_components():
    a = np.array([0, 1, 3, 7, 15, 0xFFFF, 0xFFFE], np.uint64)
    left, right = tile_links(a, None, 1)
    assert set(zip(left.tolist(), right.tolist())) == {(1, 0), (3, 0), (7, 0), (15, 0), (0xFFFF, 0xFFFE)}
    left, right = tile_links(a[:2], a[2:], 1)
    assert set(zip(left.tolist(), right.tolist())) == {(3, 1)}
