"""FLAC, page text and the source mix."""

from __future__ import annotations

import hashlib
import html as htmllib
import itertools
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import flac, html_text, mixing, queries

SF = "/root/testdata/sf0.01"

# ---- FLAC

payloads = st.lists(st.integers(1, 3).flatmap(lambda n: st.one_of(st.binary(min_size=576 * n, max_size=576 * n), st.binary(min_size=8, max_size=8).map(lambda b: b * 72 * n), st.just(b"\xff" * 576 * n))), min_size=1, max_size=4)


@settings(max_examples=25, deadline=None)
@given(payloads)
def test_round_trip(parts):
    media = flac.encode(parts)
    for p, (facts, x) in zip(parts, flac.decode(media), strict=True):
        assert ((x[:, 0] + 128).astype(np.uint8)).tobytes() == p
        assert (facts.depth, facts.channels, facts.samples) == (8, 1, len(p))
    assert flac.encode(parts) == media


class Writer:
    """Bits of a stream by hand, for what the writer does not make."""

    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += format(v & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def rice(self, v, k):
        u = 2 * v if v >= 0 else -2 * v - 1
        self.bits += "0" * (u >> k) + "1"
        return self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        b = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8))


def stream(subframes, n, mode, depth, samples):
    head = b"\xff\xf8" + bytes([0x70, mode << 4 | {8: 1, 16: 4}[depth] << 1]) + b"\0" + (n - 1).to_bytes(2, "big")
    w = Writer()
    for c in head + bytes([flac.crc8(head)]):
        w.put(c, 8)
    for f in subframes:
        f(w)
    raw = w.bytes()
    raw += int(flac.crc16(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
    md5 = hashlib.md5(flac.signed_bytes(samples, depth)).digest()
    facts = (44100 << 44 | (samples.shape[1] - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big")
    return b"fLaC\x80\0\0\x22" + struct.pack(">HH", n, n) + bytes(6) + facts + md5 + raw


def test_kinds_that_the_writer_does_not_make():
    left = np.array([5, 9, 4, -3, 100, 7, 7, 7])
    right = left - np.array([1, 0, -1, 2, 3, 0, 0, 1])

    def fixed2(v):
        def put(w):
            w.put(0, 1).put(8 + 2, 6).put(0, 1)
            for s in v[:2]:
                w.put(int(s), 16)
            w.put(1, 2).put(1, 4)  # parameters of five bits, two partitions
            res = [int(v[i] - 2 * v[i - 1] + v[i - 2]) for i in range(2, 8)]
            w.put(3, 5)
            for r in res[:2]:
                w.rice(r, 3)
            w.put(31, 5).put(10, 5)  # an escape: plain numbers of ten bits
            for r in res[2:]:
                w.put(r, 10)

        return put

    def linear(v):
        def put(w):
            w.put(0, 1).put(32, 6).put(0, 1).put(int(v[0]), 17)
            w.put(4, 4).put(2, 5).put(3, 5).put(0, 2).put(0, 4).put(2, 4)
            for i in range(1, 8):
                w.rice(int(v[i] - (3 * v[i - 1] >> 2)), 2)

        return put

    both = np.stack([left, right], axis=1)
    data = stream([fixed2(left), linear(left - right)], 8, 8, 16, both)
    assert np.array_equal(flac.decode([data])[0][1], both)
    even = (left * 4)[:, None]
    wasted = lambda w: (w.put(0, 1).put(1, 6).put(1, 1).put(1, 2), [w.put(int(s), 14) for s in left])  # noqa: E731  two bits are wasted
    assert np.array_equal(flac.decode([stream([wasted], 8, 0, 16, even)])[0][1], even)
    mid, side = (left + right) >> 1, left - right
    plain = lambda v, n: lambda w: (w.put(0, 1).put(1, 6).put(0, 1), [w.put(int(s), n) for s in v])
    assert np.array_equal(flac.decode([stream([plain(mid, 16), plain(side, 17)], 8, 10, 16, both)])[0][1], both)


def test_payloads_that_look_like_headers():
    """Whole headers with a checksum inside plain samples: with another number, and with the next one."""
    for number in (5, 1):
        head = b"\xff\xf8\x24\x02" + bytes([number])
        fake = head + bytes([flac.crc8(head)])
        raw = np.frombuffer(fake * 96, np.int8).astype(np.int64)[:, None]
        plain = lambda w: (w.put(0, 1).put(1, 6).put(0, 1), [w.put(int(v), 8) for v in raw[:, 0]])
        facts, x = flac.decode([stream([plain], len(raw), 0, 8, raw), flac.encode([bytes(576)])[0]])[0]
        assert np.array_equal(x, raw)


def test_checksums_catch_changes():
    data = flac.encode([bytes(range(256)) * 9])[0]
    for at in range(42, len(data), 97):
        bad = bytearray(data)
        bad[at] ^= 16
        if at < 42 + 4 + 18 * 1:
            continue  # a seek point is no part of the sound
        with pytest.raises((flac.FlacError, IndexError)):
            flac.decode([bytes(bad)])


def test_columns(docs, rows, none, spark):
    made = flac.write_column(docs.select("doc_id", "text", "media", flac.padded().alias("payload")))
    got = flac.read_column(made).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]["pcm"]) == raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(r["decoded"]["pcm"]) == bytes(r["payload"]) and r["decoded"]["error"] is None
        for s in r["decoded"]["seek"]:  # a frame begins there
            assert flac.header(bytes(r["media"]), s["byte"], 8)[4] * 576 == s["sample"]
    blocks = flac.pcm_blocks(flac.read_column(made).where("doc_id = 24"), ["doc_id"], 576 * 4).orderBy("block").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == bytes(next(r for r in got if r["doc_id"] == 24)["payload"]) and [b["first_sample"] for b in blocks] == [i * 2304 for i in range(len(blocks))]
    assert flac.read_column(flac.write_column(none.select("doc_id", flac.padded().alias("payload")))).collect() == []
    odd = spark.createDataFrame([(None,), (bytearray(b"fLaC"),), (bytearray(b""),)], "media binary")
    assert sorted((r["decoded"] is None, bool(r["decoded"] and r["decoded"]["error"])) for r in flac.read_column(odd).collect()) == [(False, True), (False, True), (True, False)]


def test_op7(spark, sf):
    for r in queries.op7_flac(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        raw = r["text"].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        at = 0
        for b in r["blocks"]:
            assert b["first_sample"] == at and b["n_samples"] > 0 and b["pcm_crc32"] == zlib.crc32(payload[at : at + b["n_samples"]])
            at += b["n_samples"]
        assert at == len(payload) and [b["frame_byte"] for b in r["blocks"]] == sorted({b["frame_byte"] for b in r["blocks"]})


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>a{}</style></head><body class="page header has-sidebar"><header class="site"><h1>Site</h1></header><nav>x</nav><div id="cookie-notice">We use</div>
<main><div class="breadcrumbs">a &gt; b</div><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>&nbsp; text<br>next <p>Two<ul><li>a<li>b</ul><table><tr><td>c1<td>c2</table><div class="share-box">Share</div>
<form>f</form><script>if (a<b) "</p>"</script><!-- c --> tail &lt;x&gt; a < b<section class="comments"><article>hi</article></section></article></main><aside>s</aside><footer>f</footer></body></html>"""


def test_page():
    assert html_text.Page(PAGE).text()[0] == "Title & more\nOne bold text next\nTwo\na\nb\nc1\nc2\ntail <x> a < b"


@pytest.mark.parametrize("html", ["", "text only", "<p", "<p>a</div></p>b", "<!-- open", "<script>x", "<b><p>x</b>y</p>", "<a title='>'>t</a>", "&#x110000; &bad; &amp", "<p " + "a" * 10000, "<" * 2000, "<div>" * 3000 + "deep", "<div>" * 30000 + "</p></section>" * 30000, "<b>" * 30000 + "<p>x</p>" * 30000, '<a b="' + "c" * 9000])
def test_broken_pages(html):
    assert isinstance(html_text.Page(html).text()[0], str)


def test_recurring_subtrees_go(spark):
    page = lambda i, body: (i, f"http://h.example/{i}", body)
    box = "<div><p>All about us</p><p>Call today</p></div>"
    rows = [page(i, f"<body>{box}<div><p>Story {i} of many</p><p>Common words</p></div></body>") for i in range(8)]
    rows += [(100 + i, "http://other.example/", f"<body>{box}<p>x{i}</p></body>") for i in range(2)]
    rows += [(200 + i, "http://copies.example/", f"<body>{box}<p>same</p></body>") for i in range(9)]
    rows += [(300 + i, "http://marked.example/", f"<body><article><p>Refrain</p><p>y{i}</p><div><p>Share me</p></div></article></body>") for i in range(6)]
    rows += [(400, None, box), (401, "http://h.example/", None), (402, "not a url", ""), (0, rows[0][1], rows[0][2])]
    got = defaultdict(set)
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r["page_id"]].add(r["text"])
    assert got[3] == {"Story 3 of many"} and got[0] == {"Story 0 of many"}, "the box, and a line that all pages of the host have"
    assert got[100] == {"All about us\nCall today\nx0"}, "two pages are not many"
    assert got[200] == {"All about us\nCall today\nsame"}, "copies of a page count once"
    assert got[302] == {"Refrain\ny2"}, "paragraphs of a marked article stay, boxes go"
    assert got[400] == {"All about us\nCall today"} and got[401] == {""} and got[402] == {""}


def test_op5_against_the_pages_own_articles(spark):
    import html as h

    for r in queries.op5_template_removal(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_template_against_a_plain_count(spark):
    """Characters that go as template, by counting the boxes outside the articles of all pages of a larger table."""
    from urllib.parse import urlsplit

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    got = {r["page_id"]: r for r in html_text.extract(pages).drop("html").collect()}
    inner = lambda x: "".join(re.sub(r"<[^>]*>", "", x).split())
    plain = lambda x: re.sub(r"\s+| href=\"[^\"]*\"", "", x)
    boxes, on = {}, defaultdict(set)
    for r in pages.collect():
        text, host = re.sub(r"<article>.*?</article>", "", r["html"], flags=re.S), urlsplit(r["url"]).hostname
        found = [(m[0], re.findall(r"<li>.*?</li>", m[0], re.S)) for m in re.finditer(r"<nav>.*?</nav>|<div class=\"ad\">.*?</div>|<footer>.*?</footer>", text, re.S)]
        boxes[r["page_id"]] = host, found
        for box, items in found:
            for x in {box, *items}:
                on[host, plain(x)].add(r["html"])
    total = left = 0
    for page, (host, found) in boxes.items():
        many = lambda x, host=host: len(on[host, plain(x)]) >= 4
        want = sum(len(htmllib.unescape(inner(x))) for box, items in found for x in ([box] if many(box) else [y for y in items if many(y)]))
        assert got[page]["template_chars"] == want, page
        total, left = total + want, left + got[page]["other_chars"]
    assert total > 0.15 * (total + left), "hosts have 40 pages here on average"


def test_pages_without_helpful_names(spark):
    page = lambda host, i, body: (i, f"http://{host}.example/{i}", body)
    menu, foot = "<div><div>Home</div><div>About</div></div>", "<div class='x1'>All rights</div>"
    rows = [page("plain", i, f"<body>{menu}<div><div><h2>Title {i}</h2><p>Story {i} goes on</p></div></div>{foot}</body>") for i in range(12)]
    words = ("search-results", "related-work", "share-prices", "skip-list", "banner-year", "notice-period")
    rows += [page("named", 100 + i, f"<body><article><p>a{i}</p><div class='{w}'><p>kept {i}</p></div><div class='ad'>buy</div><div class='comments-list'>me too</div></article></body>") for i, w in enumerate(words)]
    rows += [page("nested", 200 + i, f"<body><div><nav>n{i}</nav><article><p>one text</p><div>its box</div></article></div></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nStory {i} goes on" for i in range(12))
    assert all(got[100 + i] == f"a{i}\nkept {i}" for i in range(len(words)))
    assert got[200] == "one text\nits box", "what holds the article is no template"


def test_odd_tables_of_pages(spark):
    schema = "page_id long, url string, html string, host string, text string, page long, hash long, hashes array<long>"
    rows = [(1, "http://a.example/", "<p>x</p>", "h", "t", 1, 2, [3]), (None, None, None, None, None, None, None, None)]
    found = html_text.extract(spark.createDataFrame(rows, schema))
    assert {(r["page_id"], r["host"], r["text"], r["page"]) for r in found.collect()} == {(1, "a.example", "x", 1), (None, None, "", None)}
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


# ---- mix


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 200))
def test_knapsack(sizes, budget):
    size, count = np.array(sorted(sizes)), np.array([sizes[s] for s in sorted(sizes)])
    took = mixing.knapsack(size, count, budget)
    assert (took >= 0).all() and (took <= count).all()
    best = max(s for s in (sum(a * b for a, b in zip(c, size, strict=True)) for c in itertools.product(*[range(n + 1) for n in count])) if s <= budget)
    assert (took * size).sum() == best


def test_large_budgets_are_met():
    """Beyond any table of 65,536 sums: a share first, then the fit, without a greedy part."""
    rng = np.random.default_rng(6)
    size = np.unique(np.append(rng.integers(5, 4000, 900), [70_001, 90_000]))
    count = rng.integers(1, 60, len(size))
    total = int((size * count).sum())
    for target in (total // 3, total // 2 + 1, int(1.7 * total), int(2.9 * total)):
        copies = mixing.fit(size, count, target)
        assert (copies >= 0).all() and (copies <= 3 * count).all() and (copies * size).sum() == target
        share = copies / count
        assert np.abs(share.mean() - target / total) < 0.1, "every size has its share"
    took = mixing.knapsack(np.array([3, 7, 20]), np.array([40, 40, 40]), 611)
    assert (took <= 40).all() and (took * np.array([3, 7, 20])).sum() == 611


@pytest.mark.parametrize("sizes", [[("a", 100), ("b", 1000), ("c", 10)], [("a", 10), ("b", 10), ("c", 10), (None, 10)], [("a", 0), ("b", 0)], [(f"s{i:03}", 7 * i % 50) for i in range(300)], []])
def test_targets_of_any_number_of_sources(spark, sizes):
    rows = [((s is None, s or ""), n) for s, n in sizes]
    got = mixing.source_targets(spark.createDataFrame(rows, "src struct<none:boolean,name:string>, source_size long")).orderBy("src").collect()
    assert [r["target"] for r in got] == pytest.approx(mixing.targets(sizes))


def test_targets():
    assert mixing.targets([("a", 100), ("b", 1000), ("c", 10)]) == [300.0, 780.0, 30.0]
    assert mixing.targets([]) == [] and sum(mixing.targets([("a", 10), ("b", 10), ("c", 10), (None, 10)])) == pytest.approx(40)


def test_mix(docs, rows, none, monkeypatch):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([(s, sizes[s]) for s in order]), strict=True))
    source = {r[0]: r[3] for r in rows}
    taken: dict = defaultdict(int)
    for r in got:
        s = source[r["id"]]
        assert r["target"] == pytest.approx(want[s]) or r["id"] is None
        assert r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
        taken[round(r["target"], 6)] += r["taken"]
    for s in order:
        if s is not None:
            largest = max(words(r[1]) for r in rows if r[3] == s)  # a document that is larger than its source's target can't be fitted
            assert abs(taken[round(want[s], 6)] - want[s]) <= (3 if largest < want[s] else largest)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((str(r["id"]), r["times"]) for r in again) == sorted((str(r["id"]), r["times"]) for r in got)
    out = mixing.apply_mix(docs, mixing.mix(docs))
    assert out.columns == docs.columns and out.count() == sum(r["times"] for r in got)
    assert mixing.mix(none).collect() == [] and mixing.apply_mix(none, mixing.mix(none)).collect() == []


