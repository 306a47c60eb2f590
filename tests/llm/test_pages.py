"""Page differencing: labelled pages without articles, any number of partitions, alignment against a plain table, and hostile pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import pages

SCHEMA = "page_id long, url string, html string, host string, place string, range int, copy boolean, mark long"


def site(name, frame_top, frame_bottom, n, seed, own=""):
    """Pages of a site that marks nothing: (page_id, url, html) and the blocks that are theirs."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(3, 9)))
    out = []
    for i in range(n):
        blocks = [" ".join(word() for _ in range(r.randint(6, 40))) for _ in range(r.randint(1, 6))]
        body = "".join(f"<div>{x}</div>" for x in frame_top) + "".join(f"<p>{b}</p>" for b in blocks) + own.format(word()) + "".join(f"<div>{x}</div>" for x in frame_bottom)
        out.append(((seed * 1000 + i, f"https://{name}/{r.choice(['news', 'notes'])}/{i}", f"<html><body>{body}</body></html>"), blocks))
    return out


def labelled():
    """30 pages of four sites without articles: short and long frames, a frame that outweighs its page, and a line that is new on every page."""
    return [
        *site("a.example", ["Home", "News", "About us"], ["Imprint", "All rights"], 10, 1),
        *site("b.example", [f"Menu entry {i}" for i in range(12)], ["Follow us", "© 2024"], 10, 2),
        *site("c.example", ["We use small files on your computer. Fine", "Top"], ["Privacy", "Terms", "Contact"], 6, 3, "<div>Seen by {} today</div>"),
        *site("d.example", ["Start"], [], 4, 4),
    ]


def test_labelled_pages_without_articles(spark):
    rows = labelled()
    df = spark.createDataFrame([r for r, _ in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in pages.extracted(df).collect()}
    right = sum(len(set(got[r[0]]) & set(blocks)) for r, blocks in rows)
    kept, wanted = sum(len(x) for x in got.values()), sum(len(b) for _, b in rows)
    print(f"precision {right / kept:.3f}, recall {right / wanted:.3f}, whole pages {sum(got[r[0]] == b for r, b in rows)} of {len(rows)}")
    assert right == wanted and right / kept > 0.9 and sum(got[r[0]] == b for r, b in rows) >= 24
    lone = {r[0]: pages.settled(pages.lines_of(r[2]), []).text.split("\n\n") for r, _ in rows}
    assert all(lone[i] != got[i] for i in got)  # the neighbours decide on every one of these pages


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_any_number_of_partitions(spark, partitions):
    rows = [r for r, _ in site("one.example", ["Home", "Shop"], ["Imprint"], 40, 5)]
    rows += [(9000 + i, "https://one.example/news/1", "<div>Home</div><p>twice</p>") for i in range(3)] + [(None, None, None), (7, None, "<div>Home</div>"), (8, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        wanted = sorted(map(repr, pages.extracted(df).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = pages.extracted(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(map(repr, got)) == wanted and len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None and 5000 <= r.page_id < 5040}
    assert len(by) == 40 and all("Home" not in r.text and "Imprint" not in r.text and r.n_differenced == 3 for r in by.values())


def test_brute_force_over_given_pages(spark):
    """op9 against a plain walk over all pages in order of address."""
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    host, path = pages.host_and_path(F.col("url"))
    rows = sorted(df.select("page_id", "url", "html", host.alias("h"), path.alias("p")).collect(), key=lambda r: (r.h, r.p, r.url, str(r.page_id)))
    lines = [pages.lines_of(r.html) for r in rows]
    wanted = {}
    for k, r in enumerate(rows):
        near = [j for j in range(k - pages.SIDES, k + pages.SIDES + 1) if j != k and 0 <= j < len(rows) and rows[j].h == r.h]
        commons = [{i for i, _ in plain_alignment(lines[k].text, lines[j].text)} for j in near]
        x = pages.settled(lines[k], commons)
        wanted[r.page_id] = (x.text, x.n_lines, x.n_marked)
    got = {r.page_id: (r.text, r.n_lines, r.n_marked) for r in pages.extracted(df).collect()}
    assert got == wanted
    # every given page marks its article: what the text should be, read by a plain pattern
    import html
    import re

    for r in rows[:20]:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br ?/?>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote|pre)\b[^>]*>", inside)]
        assert got[r.page_id][0].split() == " ".join(b for b in blocks if b).split() or "<table" in inside or "class=" in inside


def plain_alignment(a, b):
    """Longest common subsequence by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("bits", [pages.TABLE_BITS, 16])
def test_alignment(bits):
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 14))] for _ in range(2))
        got = pages.aligned(a, b, bits)
        assert len(got) == len(plain_alignment(a, b)) and got == sorted(got, reverse=True) and all(a[i] == b[j] for i, j in got)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_hostile_pages_take_no_square_of_time():
    began = time.process_time()
    assert pages.lines_of("<div>" * 5000 + "x" + "</b>" * 20_000).text == ["x"]
    assert len(pages.lines_of("<p>word" * 100_000).text) == 100_000
    assert len(pages.lines_of("a &amp; b " * 300_000).text) == 1
    assert time.process_time() - began < 8


def test_odd_tables(spark):
    rows = [(1, "http://h/a", "<p>x</p>", "h", "p", 1, True, 2), (None, None, None, None, None, None, None, None), (1, "http://h/a", "<p>x</p>", "h", "p", 1, True, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.page_id or 0, r.text) for r in pages.extracted(df).collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert pages.extracted(df.limit(0)).count() == 0


def test_addresses(spark):
    given = ["http://user@Host.Example:80/a/b?x#y", "host/a", "//h", "https://[::1]:8/p", "", "mailto:x@y", "ftp://h?q"]
    df = spark.createDataFrame([(u,) for u in given], "u string")
    host, path = pages.host_and_path(F.col("u"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [("host.example", "/a/b"), ("host", "/a"), ("h", "/"), ("[::1]", "/p"), ("", "/"), ("y", "/"), ("h", "/")]
