from itertools import combinations

import pyspark.sql.functions as F
from hypothesis import given
from hypothesis import strategies as st

from tamis.llm.page_text import difference, extract_pages, path_key, shared_lines, text_lines

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>not</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Head  line &lt;1&gt;</h1></header><p><b>First &eacute; one<br>more<p>Second
 line &amp;amp;</p><div>In <i>a</i> div</div><section id="comments"><p>reader says</p></section><form><p>mail</p></form></article>
<aside><p>Side</p></aside><p>stray</p><footer>&copy; 2020</footer></body>"""


def test_blocks_of_an_article():
    lines = text_lines(PAGE)
    assert difference(lines, None) == ["Head line <1>", "First é one more", "Second line &amp;", "In a div"]
    assert difference(lines, lines) == difference(lines, None)
    assert text_lines(None) == [] and text_lines("") == [] and text_lines("just text") == [("just text", "open")]


def test_differencing_without_an_article_element():
    chrome = "<div>Home</div><div>About us</div>{}<div>All rights reserved</div>"
    a, b = text_lines(chrome.format("<p>one</p><p>two</p>")), text_lines(chrome.format("<p>three</p>"))
    assert difference(a, b) == ["one", "two"] and difference(b, a) == ["three"]


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    def inside(x, y):
        y = iter(y)
        return all(c in y for c in x)

    longest = max(k for k in range(len(a) + 1) if any(inside(x, b) for x in combinations(a, k)))
    marked = [x for x, m in zip(a, shared_lines(a, b)) if m]
    assert len(marked) == longest and inside(marked, b)


def test_neighbours_by_path(spark):
    urls = ["http://h/en/9", "https://h/en/10?x=1", "//H/en/100.html#top", "http://u@h:80/en/index.html", None, "", "mailto:x"]
    keys = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").orderBy("i").select(path_key(F.col("url"))).collect()]
    assert keys[0] < keys[1] < keys[2] and keys[3] == "/en"


def test_extraction_rows(spark):
    made = [(i, f"http://h{i % 3}/p/{i}", PAGE.replace("Second", f"Second {i}"), "clash", i) for i in range(40)]
    made += [(5, "http://h2/p/5", PAGE, None, 0), (None, None, PAGE, None, 0), (50, "http://x/", None, None, 0), (51, None, "", None, 0), (52, "http://x/", "<p>" + "long " * 200_000, None, 0)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string, text string, n_chars int").repartition(5)
    rows = extract_pages(pages).collect()
    assert len(rows) == len(made)
    for r in rows:
        if r["page_id"] is not None and r["page_id"] < 40 and "Second 5" not in r["text"]:
            assert r["text"].startswith("Head line <1>\nFirst é one more\nSecond") and r["text"].count("\n") == 3
        assert r["n_chars"] == len(r["text"])
    assert extract_pages(pages.where("false")).collect() == []


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html as h
    import re

    want = {}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        lines = [" ".join(h.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        want[r["page_id"]] = "\n".join(x for x in lines if x)
    got = {r["page_id"]: r["text"] for r in extract_pages(pages).collect()}
    assert got == want


def test_lines_shared_with_other_articles_go_from_an_article():
    def page(k, extra=""):
        own = "".join(f"<p>paragraph {k}.{i} of this article alone</p>" for i in range(4))
        return text_lines(f"<div>Home</div><article><h1>Title {k}</h1>{own}{extra}<div class='x'>Read more stories here</div></article><p>after {k}</p>")

    own = ["Title 1", *[f"paragraph 1.{i} of this article alone" for i in range(4)]]
    more, quoted = "Read more stories here", "<p>licence of two pages</p>"
    assert difference(page(1), page(2), page(3)) == [*own, "after 1"]  # shared with other articles, in the element or not; own lines outside stay
    assert difference(page(1, quoted), page(2, quoted), page(3), page(4)) == [*own, "licence of two pages", "after 1"]
    assert difference(page(1), page(1), page(1)) == [*own, more]  # copies say nothing
    assert difference(page(1), page(2)) == [*own, more, "after 1"]  # one neighbour is not enough in an article


def test_copies_keep_their_text_however_the_order_is_cut(spark):
    def page(k):
        own = "".join(f"<p>words {k} of {i} alone</p>" for i in range(4))
        return f"<div>Home</div><div>About us</div>{own}<div>All rights reserved</div>"

    want = {k: "\n".join(f"words {k} of {i} alone" for i in range(4)) for k in range(60)}
    made = [(k, f"http://h/en/{k}", page(k)) for k in range(60)]
    made += [(1000 * (c + 1) + k, f"https://h/en/{k}?ref={c}", page(k)) for k in range(60) for c in range(3)]  # four copies of each
    made += [(9000 + k, f"http://x/{k}", f"<p>quoted by two</p>{page(k)}" if k < 2 else page(k)) for k in range(5)]
    want |= {9000 + k: ("quoted by two\n" if k < 2 else "") + want[k] for k in range(5)}
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    for parts in ("1", "4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r["page_id"]: r["text"] for r in extract_pages(pages.repartition(3)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == len(made)
        for k, text in got.items():
            assert text == want[k % 1000 if k < 9000 else k]


def test_alignment_of_many_equal_lines():
    import time

    from tamis.llm import page_text

    began = time.time()
    a, b = ["x"] * 20_000 + ["y"], ["z"] + ["x", "x", "w"] * 9000
    assert sum(shared_lines(a, b)) == 18_000
    assert time.time() - began < 20
    rng = __import__("random").Random(2)
    for _ in range(200):  # the halving way gives as long a subsequence as keeping all rows
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(30))] for _ in range(2))
        for most in (0, 60, 1 << 26):
            found = page_text._aligned(a, b, most)
            length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
            assert len(found) == length[-1][-1] and len(set(found)) == len(found)
            rest = iter(b)
            assert all(x in rest for x in [a[i] for i in sorted(found)])


def test_marks_that_only_look_like_chrome():
    text = lambda page: difference(text_lines(page))
    assert text('<div style="overflow:hidden"><p>one</p></div><div title="hidden gem">two</div><div data-role="main" data-id="search">three</div>') == ["one", "two", "three"]
    assert text("<html><head><title>t</title><meta charset=utf-8><body><p>story</p>") == ["story"]
    assert text('<article><div class="entry-header"><h1>Title</h1></div><p class="related work">cited</p><p class="lead social">lead</p><div class="comment-list">c</div><ul class="share">s</ul></article>') == ["Title", "cited", "lead"]
    story = "".join(f"<p>paragraph {i} of the story in a div</p>" for i in range(5))
    assert text(f"<div>{story}</div><article><p>teaser</p></article>")[:5] == [f"paragraph {i} of the story in a div" for i in range(5)]
    assert text('<div hidden>gone</div><div aria-hidden="true">gone</div><div role="navigation">gone</div><p>stays</p>') == ["stays"]


def plain_extract(rows):
    """Every page's text by the definitions: neighbours sought in one sorted list, lines aligned by a full table."""
    import re

    from tamis.llm import page_text as P

    def key(url):
        path = re.sub(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*|[?#].*$", "", url or "")
        path = re.sub(r"(?:/index)?(?:\.[a-zA-Z]{2,5})?/*$", "", path)
        return re.sub(r"\d+", lambda m: m[0][-12:].zfill(12), path)

    def host(url):
        m = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
        return m[1].lower() if m else ""

    def common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        return table

    def on_one(a, b):
        table, i, j, out = common(a, b), 0, 0, [False] * len(a)
        while i < len(a) and j < len(b):
            if a[i] == b[j] and table[i][j] == table[i + 1][j + 1] + 1:
                out[i], i, j = True, i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    def differ(a, b, least):
        own = lambda x, y: sum(len(l) for l in x if l not in set(y)) >= least * max(sum(map(len, x)), 1e-9)
        return bool(a and b) and own(a, b) and own(b, a)

    pages = [(i, u, host(u), key(u), [x for x in text_lines(h) if x[1] != "chrome"]) for i, u, h in rows]
    pages.sort(key=lambda p: (p[2].encode(), p[3].encode(), p[0] is None, p[0] or 0, p[1] or ""))
    out = {}
    for n, (page_id, _, h, path, own) in enumerate(pages):
        lines, near = [x for x, _ in own], []
        for m in range(max(0, n - P.REACH), min(len(pages), n + P.REACH + 1)):
            if m != n and pages[m][2] == h:
                same = 0
                for x, y in zip(path.split("/"), pages[m][3].split("/")):
                    if x != y:
                        break
                    same += 1
                near.append((-same, abs(m - n), m))
        voters = []
        for _, _, m in sorted(near):
            if len(voters) < P.VOTERS and pages[m][4] not in voters and differ(lines, [x for x, _ in pages[m][4]], P.NEAR):
                voters.append(pages[m][4])
        main = lambda page: [x for x, z in page if z == "main"] or [x for x, z in page if z == "open"]
        has_main = any(z == "main" for _, z in own)
        seen = [on_one(lines, [x for x, _ in v]) for v in voters]
        others = [s for s, v in zip(seen, voters) if differ(main(own), main(v), P.DIFFERENT)]
        short = 2 * sum(len(x) for x, z in own if z == "main") < sum(map(len, lines))
        kept = []
        for k, (x, z) in enumerate(own):
            if z == "main":
                stays = not (len(others) > 1 and all(s[k] for s in others))
            elif voters:
                stays = sum(s[k] for s in seen) <= len(voters) / 2
            else:
                stays = not has_main or short
            kept += [x] if stays else []
        out[page_id] = "\n".join(kept)
    return out


def test_query_matches_brute_force_however_it_is_cut(spark):
    rng = __import__("random").Random(11)
    made = []
    for k in range(160):
        menu = "".join(f"<div>{x}</div>" for x in ("Home", "About us", "Shop", "Contact")[: rng.randrange(1, 5)])
        body = "".join(f"<p>text {rng.randrange(90)} of page {k // rng.choice([1, 1, 2])}</p>" for _ in range(rng.randrange(7)))
        story = rng.choice(["<article><h1>T</h1>{}<p>Read more here</p></article>", "<div>{}</div>", "<div>{}</div><article>teaser</article>"]).format(body)
        made.append((k, f"http://h{rng.choice('aab')}.org/{rng.choice(['en', 'fr'])}/{rng.randrange(60)}{rng.choice(['', '.html', '?q=1'])}", f"{menu}{story}<div>All rights reserved</div>"))
    want = plain_extract(made)
    alone = {k: "\n".join(difference(text_lines(h))) for k, _, h in made}
    assert sum(want[k] != alone[k] for k in want) > 100  # differencing decides, not the elements alone
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    for parts in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r["page_id"]: r["text"] for r in extract_pages(pages.repartition(3)).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
