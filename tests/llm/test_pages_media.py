"""HTML text and media columns: small pages by hand, and exact round trips of stored bytes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import html_text, jpeg, media, queries

PAGES = "page_id long, url string, html string"


def page(body, nav="menu"):
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href='/'>{nav}</a></nav>{body}<footer>f</footer></body></html>"


CASES = [
    (page("<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four <b>five</b></article>"), "A & B one two three four five"),
    (page("<div class='ad'>buy</div><main><p>x&nbsp;y &lt;z&gt;</p><aside>side</aside></main>"), "x y <z>"),
    (page("<article>a<!-- no -->b<style>p{}</style><form>f<input value='q'></form></article><div class='comments'>c</div>"), "ab"),
    (page("<p>no article</p><div id='cookie-notice'>ok?</div>"), "no article"),
    ("<p>broken <b>markup <i>ends", "broken markup ends"),
    ("", ""),
    (None, ""),
    ("plain text", "plain text"),
    (page("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>p<li>q</ul></article>"), "1 2 3 p q"),
    (page("<article><p>" + "word " * 50_000 + "</p></article>"), ("word " * 50_000).strip()),
]


def test_pages_by_hand(spark):
    rows = [(k, f"http://h{k}.example/x", h) for k, (h, _) in enumerate(CASES)] + [(None, None, CASES[0][0]), (0, "http://h0.example/x", CASES[0][0])]
    df = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit(1), "subtrees": F.lit(2), "n": F.lit(3), "text": F.lit("no")})
    got = html_text.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = CASES[r.page_id or 0][1].replace("\xa0", " ")
        assert r.text == want and r.n_chars == len(want), r.page_id
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("rows", [0, 10**6])
def test_template_goes_and_article_stays(spark, monkeypatch, rows):
    """A block on many pages of one host is its template; the same block on another host's page is text."""
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", rows)
    strip = "<div class='x'><span>Our best offers of the week</span></div>"
    pages = [(k, "http://one.example/a", page(f"{strip}<div><p>text number {k}</p></div>")) for k in range(12)]
    pages.append((99, "http://two.example/a", page(f"{strip}<div><p>other</p></div>")))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, PAGES)).collect()}
    assert all(got[k] == f"text number {k}" for k in range(12))
    assert got[99] == "Our best offers of the week other"


def sentences(r, n):
    return " ".join("".join(r.choice("abcdefgh ") for _ in range(60)).strip() + "." for _ in range(n))


def site(articles):
    """Pages of two hosts with planted templates: a strip of equal contents, a menu whose entries differ on every page, a
    numbered line, and a paragraph at the end; with and without an article element. Another host has two pages only."""
    r = random.Random(21)
    rows, want = [], {}
    around = ("<article>", "</article>") if articles else ("<div id='text'>", "</div>")
    for k in range(30):
        host = f"h{k % 2}.example" if k < 28 else "few.example"
        paragraphs = [sentences(r, 3) for _ in range(6)]
        if k % 7 == 0:  # copies of one article, but for a few words
            paragraphs = [f"{'fox and hound and hare ' * 8}number {x}." for x in range(6)]
            paragraphs[k % 6] += f" And {k}."
        body = "".join(f"<p>{x}" for x in paragraphs)
        menu = "".join(f"<div><a href='/{r.random()}'>{sentences(r, 1)[:12]}</a></div>" for _ in range(4))
        rows.append((
            k,
            f"http://{host}/{k}",
            f"<body><div class='x1'>{menu}</div><div><span>Our best offers, all week</span></div>{around[0]}<h1>Title {k}</h1>{body}{around[1]}"
            f"<div class='y'>Visitors so far: {r.randrange(10**6)}</div><p>All rights are with the editors of this site.</p></body>",
        ))
        want[k] = " ".join([f"Title {k}", *(" ".join(x.split()) for x in paragraphs)])
    return rows, want


def brute_templates(rows):
    """Hashes that recur, per host, with every page compared in plain Python."""
    seen = {}
    for _, url, source in rows:
        page = html_text.Page(source)
        inside, container = page.article(), page.containers()
        places = {}
        for h, n in page.places(inside, container).values():
            places[h] = places.get(h, 0) + n
        whole = sum(len(t) - t.count(" ") for _, t in page.items if t)
        for h in set(page.contents(inside, container).values()) | set(places):
            seen.setdefault((url.split("/")[2], h), []).append((page.identity(), places.get(h, 0), whole if h in places else 1))
    found = {}
    for (host, h), own in seen.items():
        different = max(len({x[0][0] for x in own}), len({x[0][1] for x in own}))
        if different >= 5 and len(own) <= 5 * different and sum(x[1] for x in own) <= 0.25 * sum(x[2] for x in own):
            found.setdefault(host, set()).add(h)
    return found


@pytest.mark.parametrize("articles", [True, False])
@pytest.mark.parametrize("rows", [0, 10**6])
def test_templates_are_removed_by_count(spark, monkeypatch, articles, rows):
    """By the counts alone (no tag, role or class name here tells anything), equal to brute force on both routes."""
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", rows)
    pages, want = site(articles)
    known = brute_templates(pages)
    assert set(known) == {"h0.example", "h1.example"}
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, PAGES).repartition(3)).collect()}
    assert got == {k: html_text.Page(s).text(known.get(u.split("/")[2], set())) for k, u, s in pages}
    assert all(got[k] == want[k] for k in range(28))
    plain = {k: html_text.Page(s).text(set()) for k, _, s in pages}
    if not articles:  # an article element alone would do; here the counts alone tell
        assert all(plain[k] != got[k] for k in range(28)) and plain[29] == got[29]


def test_html_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html or "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    known = brute_templates(rows)
    want = sorted((i, html_text.Page(s).text(known.get(u.split("/")[2], set()))) for i, u, s in rows)
    assert sorted((r.page_id, r.text) for r in queries.op9_html(spark, sf).collect()) == want
    removed = 0
    for _, u, s in rows:
        p = html_text.Page(s)
        removed += any(h in known.get(u.split("/")[2], ()) for h, _ in p.places(p.article(), p.containers()).values())
    assert removed > 20  # pages of which the counts delete something


def test_all_articles_of_a_page_stay(spark):
    h = "<main><p>lead</p></main><article><p>one</article><article><p>two two</article><article class='comment'>no</article><p>out</p>"
    assert html_text.extract(spark.createDataFrame([(1, "http://a.example", h)], PAGES)).first().text == "lead one two two"


def test_many_open_elements_take_linear_time():
    import time

    times = []
    for n in (8_000, 64_000):
        at = time.perf_counter()
        html_text.Page("<p>" + "<b>" * n + "</i>" * n + "<p>x</p>" * n + "<td>" * n).text(set())
        times.append(time.perf_counter() - at)
    assert times[1] < 24 * times[0] + 0.2


def payloads():
    r = random.Random(5)
    yield from (b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 3, "Größe 中文 🙂".encode())
    for n in (63, 500, 5000, 200_000):
        yield bytes(r.getrandbits(8) for _ in range(n))


@pytest.mark.parametrize("data", list(payloads()), ids=len)
def test_stored_bytes_are_read_back(data):
    image = jpeg.Image(jpeg.encode(media.padded(data)))
    assert image.payload() == media.padded(data)
    rgb = image.rgb()
    assert rgb.shape == (image.height, image.width, 3) and rgb.dtype == np.uint8


def test_bitwise_reader_agrees(monkeypatch):
    """The general entropy decoder gives the coefficients that the reader of equal-sized units gives."""
    stored = jpeg.encode(media.padded(bytes(range(256)) * 2))
    fast = jpeg.Image(stored)
    monkeypatch.setattr(jpeg.Image, "_scan_at_once", lambda *a: False)
    slow = jpeg.Image(stored)
    for a, b in zip(fast.components.values(), slow.components.values(), strict=True):
        assert (a.values == b.values).all()


def test_inverse_transform():
    """The matrix product equals the sum over cosines."""
    r = np.random.default_rng(2)
    c = r.integers(-50, 50, (8, 8)).astype(float)
    zigzag = c.ravel()[jpeg.ZIGZAG]
    got = (zigzag.astype(np.float32) @ jpeg.inverse_transform()).reshape(8, 8)
    a = [np.sqrt(1 / 8)] + [0.5] * 7
    want = [[sum(a[u] * a[v] * c[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.abs(got - want).max() < 1e-3


def test_media_query(spark, sf, awkward, clashing, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(awkward.columns).unionByName(awkward)
    got = media.digests(media.tensors(media.store(docs))).collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        p = media.padded(raw)
        want.append((str(r.doc_id), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        assert by_text.setdefault((r.n_bytes, r.payload_sha256), (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
    assert media.store(empty).count() == 0 and media.store(clashing).count() == awkward.count()
    t = media.tensors(media.store(awkward.where("doc_id = 1"))).first()
    assert len(t.rgb) == t.height * t.width * 3


def test_html_query_is_whole(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert queries.op9_html(spark, sf).count() == pages.count()
