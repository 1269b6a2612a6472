"""WARC round trips and HTML extraction."""

import base64
import hashlib
import html
import re
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbline.llm import html_text, warc
from plumbline.llm.boosting import BoostedTrees


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/x", "<p>one</p>", "n"), (2, "http://b/é y\n", "<p>two é</p>", "n"), (3, "http://a/x", "<p>one</p>", "n"), (4, None, None, "n"), (5, "http://c", "", "n"),
        (6, "http://d", "x\r\n\r\ny" * 4000, "n"), (7, "http://d", "<p>one</p>", "n"), (None, "http://e", "<p>one</p>", "n"), (1, "http://a/x", "<p>one</p>", "n"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(pages, least):
    got = Counter(tuple(r) for r in warc.round_trip(pages, least_bytes=least).drop("url").collect())
    want = Counter()
    first = {}
    for r in sorted(((r["page_id"], r["url"], r["html"]) for r in pages.collect()), key=lambda r: (r[0] is None, r[0])):
        data = (r[2] or "").encode()
        again = len(data) >= least and data in first and first[data] != r[0]  # a row a page, repeated ones too
        want[(r[0], len(data), digest(data), "revisit" if again else "response", first[data] if again else None)] += 1
        first.setdefault(data, r[0])
    assert got == want and sum(got.values()) == pages.count()


def test_every_repeat_is_a_capture(spark):
    rows = [(i % 3 or None, "http://a" if i % 2 else "http://b", "<p>x</p>" * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    # Both payloads are met first on page 1.
    want = Counter((p, u, "response" if p == 1 else "revisit", None if p == 1 else 1) for p, u, _ in rows)
    assert got == want


def test_empty_table(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_carry_their_payload(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, folder)
    records = warc.read_archives(manifest, folder).collect()
    assert len(records) == 3 * pages.count() == sum(r["records"] for r in manifest.collect())
    full = {bytes(r["payload"]) for r in records if r["type"] == "response"}
    assert full == {(r["html"] or "").encode() for r in pages.collect()}
    import gzip

    text = b"".join(gzip.open(f).read() for f in tmp_path.glob("w/archives/*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(records)


def test_assembly_over_links(spark):
    make = lambda i, kind, to: (i, kind, "u", "d", to, None, None, None, None, None)
    rows = [
        make("r1", "response", []), make("q1", "request", ["r1"]), make("m1", "metadata", ["q1"]), make("m2", "metadata", ["r1"]),
        make("r2", "response", ["q2"]), make("q2", "request", []), make("m3", "metadata", ["q2"]),
        make("q9", "request", []), make("m9", "metadata", ["q9"]), make(None, "metadata", ["r1"]), make("q1", "request", ["r1"]),
    ]
    schema = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, content_type string, fields map<string,string>"
    got = {}
    for r in warc.assemble(spark.createDataFrame(rows, schema)).collect():
        got[r["capture_id"]] = (r["response"] and r["response"]["record_id"], [x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]])
    assert got == {"r1": ("r1", ["q1"], ["m1", "m2"]), "r2": ("r2", ["q2"], ["m3"]), "m9": (None, ["q9"], ["m9"])}


def test_damaged_archives():
    data = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Payload-Digest", "sha1:AAAA")], b"HTTP/1.1 200 OK\r\n\r\nbody", 4)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    (record,) = warc._members(Stream(data))
    with pytest.raises(ValueError):
        warc.parse_record(record)
    with pytest.raises(EOFError):
        list(warc._members(Stream(data[:-9])))


# --- HTML ------------------------------------------------------------------------------------------------------


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in blocks if x)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    assert got == {p["page_id"]: article(p["html"]) for p in pages}


def test_held_out_pages():
    model = html_text.extractor()
    dom = html_text.Dom()
    for p in html_text.sample_pages(150, 1234):
        dom.add(p)
    truth = model._labels(dom)
    scores = model.model.log_probabilities(model.features(dom))
    state = model.decode(dom, scores)
    run = np.array(dom.run_node)
    same = (state[run] == html_text.CONTENT) == (truth[run] == html_text.CONTENT)
    assert same.mean() > 0.97
    parent = np.array(dom.parent)
    inner = parent >= 0
    above = state[parent[inner]]
    assert (state[inner][above == html_text.OUT] == html_text.OUT).all()
    assert (state[inner][above == html_text.CONTENT] != html_text.OPEN).all()


def test_decoding_is_the_best_labelling():
    rng = np.random.default_rng(3)
    model = html_text.Extractor.__new__(html_text.Extractor)
    for _ in range(20):
        dom = html_text.Dom()
        n = 6
        dom.tag, dom.parent = ["div"] * n, [-1, *(int(rng.integers(i)) for i in range(1, n))]
        dom.depth = [0] * n
        for i in range(1, n):
            dom.depth[i] = dom.depth[dom.parent[i]] + 1
        scores = rng.standard_normal((n, 3))
        best = -1e9
        for code in range(3**n):
            state = [code // 3**i % 3 for i in range(n)]
            if all(p < 0 or {0: True, 1: s != 0, 2: s == 2}[state[p]] for s, p in zip(state, dom.parent, strict=True)):
                best = max(best, sum(scores[i, s] for i, s in enumerate(state)))
        got = model.decode(dom, scores)
        assert sum(scores[i, s] for i, s in enumerate(got)) == pytest.approx(best)


def test_other_layouts(spark):
    body = "It was a bright cold day in April, and the clocks were striking thirteen; nobody in the long street looked up."
    rows = [
        (1, "u", f"<html><body><div class='menu'><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></div><div class='post-content'><h1>Title &amp; more</h1><p>{body}<p>{body} <a href=x>link</a></div><div class='sidebar'><h3>Related</h3><ul><li><a href=1>Other</a></ul></div><div id='footer'>&copy; 2020</div>", "n"),
        (2, "u", None, "n"), (3, None, "", "n"), (4, "u", "<script>var a='<p>no</p>'</script><!-- <p>no -->", "n"), (None, "u", f"<article><p>{body}</p></article>", "n"), (None, "u", f"<article><p>{body}</p></article>", "n"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, f"Title & more\n{body}\n{body} link"), (2, ""), (3, ""), (4, ""), (None, body), (None, body)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_broken_markup():
    dom = html_text.Dom()
    for p in ["<p>a<p>b<b>c", "</div></p>x", "<div><p", "a < b <3 <>", "<a href='x>y'>z</a>", "<div class=\"x>text</div>", "<table><tr><td>1<td>2<tr><td>3</table>", "<ul><li>a<ul><li>b</ul><li>c</ul>", "<head><title>t</title><body>x"]:
        dom.add(p)
    got = {}
    for t, p in zip(dom.run_text, dom.run_page, strict=True):
        got.setdefault(p, []).append(t)
    assert got[0] == ["a", "bc"] and got[1] == ["x"] and 2 not in got and got[3] == ["a < b <3 <>"] and got[4] == ["z"]
    assert got[6] == ["1", "2", "3"] and got[7] == ["a", "b", "c"] and got[8] == ["x"]


@pytest.mark.parametrize("piece", ['<a "', "<a b='", '<a b=">" ', "<", "</", "<!--", "<script>", "<x y=\"", "<div>", "</div>", "<li><ul>", "<p><noscript>", "&amp"])
def test_hostile_pages_take_linear_time(piece):
    page = "<p>x</p>" + piece * (200_000 // len(piece))
    began = time.perf_counter()
    dom = html_text.Dom()
    dom.add(page)
    assert time.perf_counter() - began < 4 and dom.run_text[0] == "x"


def test_deep_nesting():
    model = html_text.extractor()
    began = time.perf_counter()
    model.texts(["<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000])
    assert time.perf_counter() - began < 20


def test_stand_ins_are_nodes_or_part_of_the_line(spark):
    body = "It was a bright cold day in April, and the clocks were striking thirteen; nobody in the long street looked up."
    page = f"<article><p>Let <math><mi>x</mi></math> be. {body}</p><p>{body} <object>A <b>chart</b></object> and <noscript>a still</noscript> <svg><text>label</text></svg> end.</p><noscript><p>{body}</p></noscript></article>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_text.extract(df).first()["text"] == f"Let x be. {body}\n{body} A chart and a still label end.\n{body}"


def test_quotes_in_tags():
    dom = html_text.Dom()
    for p in ["<p class='a>b' id=c>one</p>", '<p title="x>two</p>', "<p>a <b c=>d</b></p>", "<p a='1>2' b=\"3>4\">five<p", '<a b=">" <p>six</p>']:
        dom.add(p)
    got = {}
    for t, p in zip(dom.run_text, dom.run_page, strict=True):
        got.setdefault(p, []).append(t)
    assert got == {0: ["one"], 1: ["two"], 2: ["a d"], 3: ["five"], 4: ["six"]}


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 1] * x[:, 0] > 0.3)
    model = BoostedTrees(3, rounds=20).fit(x[:400], y[:400])
    p = model.log_probabilities(x[400:])
    assert (p.argmax(1) == y[400:]).mean() > 0.93 and np.allclose(np.exp(p).sum(1), 1)
