"""Main text of web pages by differencing each page with its nearest URLs."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.shared import ordinals

#: Elements whose content is never text, that end a line of text, and that hold what is not the article.
NO_TEXT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|promo|sponsor(?:ed)?|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|header|masthead|footer|share|sharing|social|related|recommended|comments?|replies|respond|disqus|login|signup|search|skip)(?:$|[\s_-])",
    re.I,
)
#: Inside an article only these words, and only where they are all that the class or id says, name what is not its text.
CHROME_INSIDE = frozenset(
    "ad ads advert adverts advertisement promo sponsor sponsored cookie cookies consent popup modal newsletter subscribe sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer share sharing social related recommended comment comments reply replies respond disqus login signup skip".split()
)
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search form dialog menu menubar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: What may stand in a head element; anything else ends one that was not closed.
IN_HEAD = frozenset("title meta link script style base noscript template".split())
SPACE = re.compile(r"\s+")
#: Shares of characters: below the first, pages are nearly equal; from the second on, articles are different ones.
NEAR, DIFFERENT = 0.1, 0.5
#: Rows on either side among which a page's neighbours are sought, and how many of them vote.
REACH, VOTERS = 16, 4
#: Pages of a chunk, at most.
MOST_PAGES = 4096
CLOSES = {"p": BLOCKS - {"li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "body", "html"}}


def is_chrome(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element says of itself that it is navigation, an advert and the like; ``inside``: it stands in an article."""
    if tag in CHROME:
        return True
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if (names_chrome(value) if inside else CHROME_NAME.search(value)) is not None:
                return True
        elif name == "role" and value.lower() in CHROME_ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def names_chrome(value: str) -> str | None:
    """The value of a class or id inside an article if each of its names starts or ends with a word of CHROME_INSIDE."""
    parts = [re.split("[_-]+", name.lower().strip("_-")) for name in value.split()]
    return value if parts and all(p[0] in CHROME_INSIDE or p[-1] in CHROME_INSIDE for p in parts) else None


def text_lines(page: str | None) -> list[tuple[str, str]]:
    """(line, zone) of a page: one line per block of text, in order.

    Zones: "main" inside an article or main element, "chrome" inside elements
    that name themselves as navigation, header, advert and the like, "open"
    elsewhere. An element that is never closed ends with the first ancestor
    that is. Script, style, comments and markup give no line.
    """
    if not page:
        return []
    lines: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # (tag, zone in it)
    zone, at, skip = "open", 0, None

    def flush() -> None:
        if held:
            line = SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if line:
                lines.append((line, zone))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and skip is None:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == skip:
                skip = None
                continue
            if skip is not None:
                continue
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    zone = stack[-1][1] if stack else "open"
                    break
            continue
        if skip == "head" and tag not in IN_HEAD:
            skip = None  # a head that was not closed ends here
        if skip is not None:
            continue
        if tag in NO_TEXT:
            if m[3].endswith("/"):
                continue
            if tag in ("script", "style", "textarea", "title", "iframe", "noscript"):  # the text of these holds no elements
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                skip = tag
            continue
        if tag in ("br", "wbr"):
            held.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES["p"] and stack and any(t == "p" for t, _ in stack):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
                zone = stack[-1][1] if stack else "open"
        if tag in VOID or m[3].endswith("/"):
            continue
        inner = zone
        if zone != "chrome":
            if is_chrome(tag, m[3], zone == "main") and not (tag == "header" and zone == "main"):
                inner = "chrome"
            elif tag in MAIN:
                inner = "main"
        if inner != zone:
            flush()
        stack.append((tag, inner))
        zone = inner
    if skip is None and at < len(page):
        held.append(page[at:])
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` lie on one longest common subsequence with ``b``.

    Equal ends are matched first and lines that the other page lacks left out.
    What is left is aligned by rows of bits (Hyyro 2004): one long integer per
    line of ``a``, so the time grows with the product of the lengths over the
    word size, however often a line repeats.
    """
    marked = [False] * len(a)
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        marked[start] = True
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        marked[len(a) - 1 - stop] = True
        stop += 1
    left, right = range(start, len(a) - stop), b[start : len(b) - stop]
    there, here = set(right), {a[i] for i in left}
    left, right = [i for i in left if a[i] in there], [x for x in right if x in here]
    for k in _aligned([a[i] for i in left], right):
        marked[left[k]] = True
    return marked


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each line of ``a``: a bit per line of ``b``, 0 where the longest common subsequence grows."""
    full = (1 << len(b)) - 1
    masks: dict[str, int] = {}
    for j, x in enumerate(b):
        masks.setdefault(x, []).append(j)
    masks = {x: int.from_bytes(_bits(places, len(b)), "little") for x, places in masks.items()}
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _bits(places: list[int], n: int) -> bytes:
    flags = np.zeros(n, np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _growth(row: int, n: int) -> np.ndarray:
    """Length of the longest common subsequence with each beginning of ``b``, from a row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8) or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[str], b: list[str], most_bits: int = 1 << 26) -> list[int]:
    """Places in ``a`` of one longest common subsequence; rows are kept up to ``most_bits``, larger problems halved (Hirschberg 1975)."""
    parts, out = [(0, len(a), 0, len(b))], []
    while parts:
        i0, i1, j0, j1 = parts.pop()
        own, other = a[i0:i1], b[j0:j1]
        if not own or not other:
            continue
        if len(own) == 1:
            out += [i0] if own[0] in other else []
            continue
        if len(own) * len(other) <= most_bits:
            rows, i, j = list(_rows(own, other)), len(own), len(other)
            while i and j:
                longer = (~rows[i - 1] & ((1 << j) - 1)).bit_count()
                if not longer:
                    break
                i -= 1
                if longer > ((~rows[i - 1] & ((1 << j) - 1)).bit_count() if i else 0):
                    j -= 1  # this line is needed; its last place serves
                    while other[j] != own[i]:
                        j -= 1
                    out.append(i0 + i)
            continue
        middle = (i0 + i1) // 2
        first = second = 0
        for first in _rows(a[i0:middle], other):
            pass
        for second in _rows(a[middle:i1][::-1], other[::-1]):
            pass
        cut = j0 + int(np.argmax(_growth(first, len(other)) + _growth(second, len(other))[::-1]))
        parts += [(i0, middle, j0, cut), (middle, i1, cut, j1)]
    return out


def own_share(a: list[str], b: list[str]) -> float:
    """The share of the characters of ``a`` in lines that ``b`` does not have."""
    there = set(b)
    total = sum(map(len, a))
    return sum(len(x) for x in a if x not in there) / total if total else 0.0


def apart(a: list[str], b: list[str], least: float) -> bool:
    """Whether each of the two has at least this share of its characters for itself."""
    return own_share(a, b) >= least and own_share(b, a) >= least


def article(page: list[tuple[str, str]]) -> list[str]:
    """The lines of the article element, or without one all that are not chrome."""
    return [x for x, zone in page if zone == "main"] or [x for x, zone in page if zone == "open"]


def difference(own: list[tuple[str, str]], *others: list[tuple[str, str]] | None) -> list[str]:
    """The page's lines less those that its neighbours have too, and less chrome.

    A neighbour that is equal or nearly equal (less than ``NEAR`` of either
    page's characters its own) says nothing. Of the others, a line goes when
    more than half have it on a longest common subsequence with the page.
    Inside an article element only neighbours vote whose articles are
    different in at least half their characters, and all of them, two at least,
    must have the line: so template text in an article goes, and a copied
    article, or a licence or quotation that some neighbours share, stays. Chrome goes
    whatever the neighbours have, for menus and adverts may differ from page
    to page. With no neighbour to tell, open lines are text only where the page
    has no article element, or one that holds less than they do (a teaser).
    """
    kept = [(line, zone) for line, zone in own if zone != "chrome"]
    lines = [x for x, _ in kept]
    inside = any(zone == "main" for _, zone in kept)
    alone = inside and 2 * sum(len(x) for x, zone in kept if zone == "main") >= sum(map(len, lines))
    votes, article_votes, voters, article_voters = [0] * len(kept), [0] * len(kept), 0, 0
    for other in others:
        theirs = [x for x, zone in other or () if zone != "chrome"]
        if not apart(lines, theirs, NEAR):
            continue
        shared = shared_lines(lines, theirs)
        votes, voters = [v + s for v, s in zip(votes, shared)], voters + 1
        if inside and apart(article(own), article(other), DIFFERENT):
            article_votes, article_voters = [v + s for v, s in zip(article_votes, shared)], article_voters + 1
    stays = []
    for (_, zone), v, w in zip(kept, votes, article_votes):
        if zone == "main":
            stays.append(w < 2 or w < article_voters)
        else:
            stays.append(2 * v <= voters if voters else not alone)
    return [line for line, s in zip(lines, stays) if s]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def path_key(url: Column) -> Column:
    """The URL's path without query, fragment, page suffix and final slash; numbers padded, so that near ones sort together."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*|[?#].*$", "")
    path = F.regexp_replace(path, r"(?:/index)?(?:\.[a-zA-Z]{2,5})?/*$", "")
    return F.regexp_replace(F.regexp_replace(path, r"(\d+)", "000000000000$1"), r"\d*(\d{12})(?!\d)", "$1")


def common_segments(a: list[str], b: list[str]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


class Page(NamedTuple):
    """A row on its way through a chunk of the order; ``own`` if the chunk is to give its text."""

    own: bool
    page_id: int | None
    url: str | None
    host: str
    path: list[str]
    lines: list[tuple[str, str]]

    @staticmethod
    def of(own, page_id, url, host, path, text, zones) -> Page:
        return Page(own, page_id, url, host, path.split("/"), [(x, "main" if z == "m" else "open") for x, z in zip(text.split("\n"), zones)])


def neighbours(held: list[Page], i: int) -> list[list[tuple[str, str]]]:
    """The lines of up to ``VOTERS`` pages of the host with other content, within ``REACH`` rows: longest common path first, then nearest."""
    page, near = held[i], []
    for j in range(max(0, i - REACH), min(len(held), i + REACH + 1)):
        if j != i and held[j].host == page.host:
            near.append((-common_segments(page.path, held[j].path), abs(j - i), j))
    found: list[list[tuple[str, str]]] = []
    lines = [x for x, _ in page.lines]
    for _, _, j in sorted(near):
        other = held[j].lines
        if other not in found and apart(lines, [x for x, _ in other], NEAR):
            found.append(other)
            if len(found) == VOTERS:
                break
    return found


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Pages are ranked by host, path, id, URL and a hash of their html. The order
    is cut into chunks of equal counts, ``MOST_PAGES`` at most, so a host with
    many pages spreads over many tasks, and more pages make more tasks; the ``REACH`` rows on either side of a chunk come along, so that
    no text depends on where it is cut. A page is differenced with up to
    ``VOTERS`` pages of its host within that reach whose content is neither
    equal nor nearly equal to its own or equal to one another's. One that has
    none, as when it is alone on its host or in a longer run of copies, keeps
    all of its article. Null html gives an empty text; null or repeated URLs
    sort as one path. Other columns are not read.
    """
    keyed = pages.select(
        "page_id",
        "url",
        "html",
        host(F.col("url")).alias("_host"),
        path_key(F.col("url")).alias("_path"),
        F.col("page_id").isNull().alias("_no_id"),
        F.coalesce("page_id", F.lit(0)).cast("long").alias("_id"),
        F.coalesce("url", F.lit("")).alias("_url"),
        F.xxhash64("html").alias("_hash"),
    )
    order = ["_host", "_path", "_no_id", "_id", "_url", "_hash"]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(4 * REACH, min(-(-pages.count() // parts), MOST_PAGES))
    place = (F.col("_ordinal") % size).alias("place")
    marks = ordinals(keyed.select(*order), *[F.col(c) for c in order]).select("_ordinal", place, *order).where(F.col("place").isin(0, REACH, size - REACH)).collect()
    at = {place: [tuple(r[2:]) for r in sorted(marks) if r["place"] == place] for place in (0, REACH, size - REACH)}
    starts, heads, tails = at[0], at[REACH], at[size - REACH]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        names = ["chunk", "own", "page_id", "url", *order, "lines", "zones"]
        types = [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            done, chars = [], 0
            for page_id, url, page, *key in zip(*[c.to_pylist() for c in batch.columns]):
                lines = [x for x in text_lines(page) if x[1] != "chrome"]
                row = (page_id, url, *key, "\n".join(x for x, _ in lines), "".join(zone[0] for _, zone in lines))
                chunk = max(bisect_right(starts, tuple(key)) - 1, 0)
                done.append((chunk, True, *row))
                if chunk and (chunk >= len(heads) or tuple(key) < heads[chunk]):
                    done.append((chunk - 1, False, *row))
                if chunk + 1 < len(starts) and tuple(key) >= tails[chunk]:
                    done.append((chunk + 1, False, *row))
                chars += len(row[-2])
                if len(done) >= 500 or chars > 4 << 20:
                    yield out(done)
                    done, chars = [], 0
            if done:
                yield out(done)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            texts = ["\n".join(difference(held[i].lines, *neighbours(held, i))) for i in rows if held[i].own]
            own = [held[i] for i in rows if held[i].own]
            return pa.RecordBatch.from_arrays(
                [pa.array([r.page_id for r in own], pa.int64()), pa.array([r.url for r in own], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

        held: list[Page] = []  # the rows of a chunk that are in reach of those still to be given
        given, now = 0, None
        for batch in batches:
            for chunk, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if chunk != now:
                    yield out(range(given, len(held)))
                    held, given, now = [], 0, chunk
                held.append(Page.of(*row))
                if len(held) - given > 4 * REACH:
                    yield out(range(given, len(held) - REACH))
                    held = held[-2 * REACH :]
                    given = REACH
        yield out(range(given, len(held)))

    types = "chunk int, own boolean, page_id long, url string, _host string, _path string, _no_id boolean, _id long, _url string, _hash long, lines string, zones string"
    parsed = keyed.select("page_id", "url", "html", *order).mapInArrow(parse, types)
    dealt = parsed.repartition("chunk") if len(starts) <= parts else parsed.repartition(len(starts), "chunk")
    chunks = dealt.sortWithinPartitions("chunk", *order)
    return chunks.select("chunk", "own", "page_id", "url", "_host", "_path", "lines", "zones").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
