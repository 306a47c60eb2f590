"""Main text of web pages by differencing pages with near addresses.

Pages are put in order of host and URL path, so that a page's neighbours are the pages of its host whose paths
share most with its own. The text lines of a page are aligned with those of its nearest neighbours, SIDES on each side, by longest common
subsequence; lines that a page shares with a neighbour belong to the site's frame and are deleted. A neighbour that shares nearly all of the
page's text is a copy of it, shows no frame, and is passed over. Markup settles what a difference can't: a line inside an article is kept
though a neighbour has it too (pages of a site share true paragraphs, and copies share all), and a line inside a menu, footer, advert or
the like is deleted though no neighbour has it.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, shuffle_partitions, texts_of

FRAME, OPEN, ARTICLE = 0, 1, 2
#: A page that shares so much of the characters of its open lines with a neighbour is its copy, not framed alike.
COPY_SHARE = 0.8
#: Neighbours on each side that a page is compared with.
SIDES = 2
#: Ranges of addresses for each shuffle partition, and addresses looked at to cut one off.
RANGES, LOOKED_AT = 3, 32
#: Bits of alignment tables that are held at once.
TABLE_BITS = 1 << 31

# Elements by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
FRAMES = frozenset("nav footer aside form head menu dialog select button object svg canvas audio video map input label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NESTED = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form head header main menu nav object ol section select button svg canvas audio video map label table td th tr ul span".split())
#: Words of a class, id or role that name a part of the frame.
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar rail comment comments respond disqus discussion replies cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar toolbar header share sharing social related recommended widget pagination pager search copyright skip".split()
)
_COMMENT_WORDS = frozenset("comment comments respond disqus discussion replies".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_APART = re.compile(r"[^a-z]+")


@dataclass
class Lines:
    """Text blocks of a page in order, each with its zone."""

    text: list[str] = field(default_factory=list)
    zone: list[int] = field(default_factory=list)


def _frames(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is part of the frame."""
    if tag in FRAMES or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main") or "=" not in attributes:
        return False
    words = {w for m in _NAMED.finditer(attributes) for w in _APART.split((m[1] or m[2] or m[3] or "").lower())}
    if tag == "article":
        return bool(words & _COMMENT_WORDS)
    if tag == "header":
        return bool(words & (FRAME_WORDS - {"header"}))
    return bool(words & FRAME_WORDS)


def lines_of(page: str) -> Lines:
    """Blocks of a page: character references decoded, white space inside a block one space, empty blocks left out."""
    out = Lines()
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, frame, article
    there: Counter[str] = Counter()  # elements of the stack by tag
    frame = article = 0
    at, end = 0, len(page)

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.text.append(text)
                out.zone.append(FRAME if frame else ARTICLE if article else OPEN)

    def pop_to(n: int) -> None:
        nonlocal frame, article
        while len(stack) > n:
            t, f, a = stack.pop()
            there[t] -= 1
            frame -= f
            article -= a

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not slash:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS or tag in FRAMES:
            close()
        if tag in VOID:
            continue
        if slash:
            if there[tag]:
                close()
                while stack[-1][0] != tag:
                    pop_to(len(stack) - 1)
                pop_to(len(stack) - 1)
            continue
        if (tag in ("p", "li", "dt", "dd") or tag in BLOCKS) and (there["p"] or there[tag]):
            # a block ends an open paragraph; an item ends the item before it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == tag and tag in ("li", "dt", "dd"):
                    pop_to(i)
                    break
                if stack[i][0] in NESTED and stack[i][0] != "span":
                    break
        is_frame = not attributes.endswith("/") and _frames(tag, attributes, article > 0)
        is_article = tag in ("article", "main") and not is_frame
        if tag in NESTED or tag in ("p", "li", "dt", "dd") or is_frame:
            if is_frame:
                close()
            stack.append((tag, is_frame, is_article))
            there[tag] += 1
            frame += is_frame
            article += is_article
    close()
    return out


# differences -------------------------------------------------------------------------------------


def aligned(a: list[str], b: list[str], table_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both lists, from the end, by bit vectors over the lines that both have.

    Of the vectors of long lists only some are held; those in between are made again when the way back comes to them.
    """
    both = set(a) & set(b)
    left, right = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    masks: dict[str, int] = {}
    for k, i in enumerate(left):
        masks[a[i]] = masks.get(a[i], 0) | 1 << k
    full = (1 << len(left)) - 1

    def vectors(v: int, some: list[int]) -> Iterator[int]:
        yield v
        for j in some:  # a zero bit: the subsequence grows at that place
            u = v & masks[b[j]]
            v = ((v + u) | (v - u)) & full
            yield v

    step = max(1, min(len(right), table_bits // max(1, len(left))))
    starts, v = [], full
    for at in range(0, len(right), step):
        starts.append(v)
        for v in vectors(v, right[at : at + step]):
            pass
    found, k = [], len(left) - 1
    for block in range(len(starts) - 1, -1, -1):
        some = right[block * step : (block + 1) * step]
        rows, j = list(vectors(starts[block], some)), len(some)
        while k >= 0 and j > 0:
            if rows[j] >> k & 1:
                k -= 1
            elif not rows[j - 1] >> k & 1:
                j -= 1
            else:
                found.append((left[k], some[j - 1]))
                k -= 1
                j -= 1
    return found


def is_copy(page: Lines, shared: set[int]) -> bool:
    """Whether a page has so much of its open text, or of all its text where none is open, in ``shared``."""
    open_lines = [i for i, z in enumerate(page.zone) if z == OPEN] or range(len(page.text))
    return sum(len(page.text[i]) for i in open_lines if i in shared) >= COPY_SHARE * sum(len(page.text[i]) for i in open_lines)


@dataclass
class Settled:
    """A page's main text, its lines, and those of them that it shares with neighbours, that the difference deleted and that markup deleted."""

    text: str
    n_lines: int
    n_shared: int
    n_differenced: int
    n_marked: int


def settled(page: Lines, commons: list[set[int]]) -> Settled:
    """What is left of a page when the lines that it shares with its neighbours (places, a set for each), and what markup calls frame, are gone."""
    has_article = ARTICLE in page.zone
    shared = set().union(*(c for c in commons if not is_copy(page, c)))
    marked = [z == FRAME or z == OPEN and has_article for z in page.zone]
    gone = [not m and z == OPEN and i in shared for i, (z, m) in enumerate(zip(page.zone, marked))]
    text = "\n\n".join(t for t, m, g in zip(page.text, marked, gone) if not m and not g)
    return Settled(text, len(page.text), len(shared), sum(gone), sum(marked))


# addresses ---------------------------------------------------------------------------------------


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a URL; empty host where it has none."""
    whole = F.when((F.instr(url, "://") > 0) | url.startswith("//"), url).otherwise(F.concat(F.lit("//"), url))
    host = F.lower(F.regexp_extract(whole, r"^[^:/?#]*:?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    path = F.regexp_extract(whole, r"^[^:/?#]*:?//[^/?#]*([^?#]*)", 1)
    return F.replace(host, F.lit("\0"), F.lit("")), F.when(path == "", "/").otherwise(path)


def _edges(places: DataFrame) -> dict[int, tuple[list[str], list[str]]]:
    """Per range the SIDES least and greatest places; a row for each range reaches the driver, SIDES times."""
    out: dict[int, tuple[list[str], list[str]]] = {}
    known: set[str] = set()
    for _ in range(SIDES):
        rest = places.where(~F.col("place").isin(list(known))) if known else places
        for r in rest.groupBy("range").agg(F.min("place").alias("low"), F.max("place").alias("high")).collect():
            lows, highs = out.setdefault(r.range, ([], []))
            lows.append(r.low)
            highs.append(r.high)
            known |= {r.low, r.high}
    return out


def _copies(edges: dict[int, tuple[list[str], list[str]]]) -> dict[str, set[int]]:
    """Places of one range that lie within SIDES of another one, with the ranges that need a copy of them."""
    out: dict[str, set[int]] = {}
    ranges = sorted(edges)
    before: list[str] = []
    for r in ranges:
        for place in before[-SIDES:]:
            out.setdefault(place, set()).add(r)
        before = sorted({*before[-SIDES:], *edges[r][0], *edges[r][1]})
    after: list[str] = []
    for r in reversed(ranges):
        for place in after[:SIDES]:
            out.setdefault(place, set()).add(r)
        after = sorted({*after[:SIDES], *edges[r][0], *edges[r][1]})
    return out


# tables ------------------------------------------------------------------------------------------

EXTRACTED = "page_id long, url string, text string, n_lines long, n_shared long, n_differenced long, n_marked long"


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns of EXTRACTED for every row of ``df``.

    Null html counts as empty and gives the empty text; null addresses form a host of their own; repeated rows and pages
    that are copies of their neighbours are extracted each for itself; an empty table gives an empty result; other columns, whatever their names, are ignored;
    pages of any length are read whole. Pages go by ranges of their address to sorted partitions, so that a large host spreads over many; the
    pages next to a range's ends are copied into it, so that every page meets all its neighbours and the result is the same for any number of partitions.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [lines_of(h) for h in texts_of(part.column(6))]
                lists = [pa.array([x.text for x in found], pa.list_(pa.string())), pa.array([x.zone for x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:6], part.column(7), *lists], ["page_id", "url", "host", "place", "range", "copy", "mark", "text", "zone"])

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around: deque[list] = deque()  # page_id, url, host, copy, lines, and places that it shares with each neighbour so far
        now: list = [None]
        rows: list[tuple] = []

        def settle() -> None:
            page_id, url, _, copy, lines, commons = around.popleft()
            if not copy:
                x = settled(lines, commons)
                rows.append((page_id, url, x.text, x.n_lines, x.n_shared, x.n_differenced, x.n_marked))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in EXTRACTED.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for page_id, url, host, _, r, copy, _, text, zone in zip(*(c.to_pylist() for c in batch.columns)):
                if r != now[0]:
                    while around:
                        settle()
                    now[0] = r
                page = [page_id, url, host, copy, Lines(text, zone), []]
                for other in around:
                    if other[2] == host and not (copy and other[3]):
                        pairs = aligned(other[4].text, text)
                        other[5].append({i for i, _ in pairs})
                        page[5].append({j for _, j in pairs})
                around.append(page)
                if len(around) > SIDES:
                    settle()
                if len(rows) >= 500:
                    yield batch_of()
        while around:
            settle()
        if rows:
            yield batch_of()

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = host_and_path(url)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"), path.alias("path"))
    pages = pages.withColumn("place", F.concat_ws("\0", "host", "path", F.coalesce("url", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    n = shuffle_partitions(df.sparkSession)
    places = pages.select("place")  # no html is read for this
    wanted = RANGES * n
    there = places.count()
    some = places.where(F.shiftrightunsigned(F.xxhash64("place"), 34) < int(LOOKED_AT * wanted / max(1, there) * 2**30) + 1).select(F.substring("place", 1, 500).alias("p")).distinct()
    looked = sorted(r.p for r in some.collect())
    cuts = sorted({looked[i * len(looked) // wanted] for i in range(1, wanted)}) if looked else []
    numbered = pages.withColumn("range", bucket_of(F.col("place"), cuts))
    copies = [(place, sorted(ranges)) for place, ranges in _copies(_edges(numbered.select("place", "range"))).items()]
    shown = F.broadcast(df.sparkSession.createDataFrame(copies, "edge string, ranges array<int>"))  # 2 * SIDES rows a range at most
    dealt = numbered.join(shown, F.col("place") == F.col("edge"), "left")
    dealt = dealt.withColumn("to", F.explode(F.concat(F.array("range"), F.coalesce("ranges", F.array().cast("array<int>")))))
    dealt = dealt.select("page_id", "url", "host", "place", F.col("to").alias("range"), (F.col("to") != F.col("range")).alias("copy"), "html", F.xxhash64("html").alias("mark"))
    lines = dealt.mapInArrow(parsed, "page_id long, url string, host string, place string, range int, copy boolean, mark long, text array<string>, zone array<int>")
    return lines.repartition(n, "range").sortWithinPartitions("range", "place", "mark").mapInArrow(differenced, EXTRACTED)
