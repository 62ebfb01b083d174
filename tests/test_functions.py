import hashlib
import hashlib
import json
import math
import struct
from urllib.parse import urldefrag, urljoin, urlparse

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siltweave.functions import bloom, html, urls, vectors

URLS = ["http://a.b:80/x?y=1#z", "https://u@h.org/a/b.html", "ftp://f/", "HTTP://Big/Case", "", "nothing", "http://é.com/ü"]


def column(spark, values, kind="STRING"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_partition_is_md5(spark):
    got = column(spark, URLS).select("x", urls.url_partition(F.col("x"))).collect()
    assert all(p == int(hashlib.md5(u.encode()).hexdigest(), 16) % 256 for u, p in got)


def test_url_parts(spark):
    got = column(spark, URLS).select("x", urls.scheme(F.col("x")), urls.netloc(F.col("x"))).collect()
    for u, s, n in got:
        assert (s, n) == (urlparse(u).scheme, urlparse(u).netloc)


@pytest.mark.parametrize("m,k", [bloom.sizing(1_000_000, 0.01), bloom.sizing(1000, 0.001)])
def test_bloom_positions(spark, m, k):
    got = column(spark, URLS).select("x", bloom.positions(F.col("x"), m, k)).collect()
    for u, p in got:
        assert p == [int(hashlib.md5(u.encode() + struct.pack(">I", i)).hexdigest(), 16) % m for i in range(k)]


def test_bloom_sizing():
    assert bloom.sizing(1_000_000, 0.01) == (9_585_058, 6)
    for bad in ((0, 0.1), (10, 0), (10, 1)):
        with pytest.raises(ValueError):
            bloom.sizing(*bad)


def test_bloom_has_no_false_negatives(spark):
    m, k = bloom.sizing(100, 0.3)
    d = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url"))
    assert bloom.contained(d, "url", bloom.bits(d, "url", m, k), m, k).count() == 300


def test_resolve(spark):
    cases = [("http://a/b/c", x) for x in ("d", "../e", "/f#g", "//h/i", "http://j/", "?q", "", "mailto:x")]
    d = spark.createDataFrame(cases + [("http://a/", None)], "b STRING, h STRING")
    got = d.select("b", "h", urls.resolve(F.col("b"), F.col("h"))).collect()
    assert all(r == (None if h is None else urldefrag(urljoin(b, h))[0]) for b, h, r in got)


def test_context(spark):
    block = "w" * 50 + " " + "a b " * 100 + "HERE" + " c d" * 100
    got = column(spark, [block]).select(urls.context_around(F.col("x"), F.lit("HERE")), urls.context_around(F.col("x"), F.lit("none")), urls.surrounding(F.col("x"), F.lit("none"))).first()
    at = block.index("HERE")
    piece = block[at - 200 : at + 204]
    assert got[0] == piece[piece.index(" ") + 1 :]
    assert got[1] == block[:400] and got[2] == block[:200]


def test_tokens(spark):
    got = column(spark, ["https://x.org/Some-Path/a/12?q=Hi"]).select(urls.url_tokens(F.col("x"))).first()[0]
    assert got == "some path 12 hi"


def test_messages(spark):
    d = column(spark, ['{"url":"u","priority":2}', '{"url":', "{}", None])
    got = [r[0] for r in d.select(urls.decode_message(F.col("x"))).collect()]
    assert (got[0].url, got[0].priority, got[0].forwarded_from, got[0].metadata) == ("u", 2.0, "unknown", {})
    assert got[1:] == [None, None, None]


def test_buckets(spark):
    got = [r[0] for r in column(spark, [-1.0, -0.04, 0.0, 0.5, 0.999, 1.0, 7.0], "DOUBLE").select(urls.bucket(F.col("x"))).collect()]
    assert got == [0, 0, 0, 10, 19, 19, 19]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=2, max_size=8))
def test_normalised(spark, v):
    got = column(spark, [v], "ARRAY<DOUBLE>").select(vectors.normalised(F.col("x"))).first()[0]
    n = math.sqrt(sum(x * x for x in v)) + 1e-10
    assert got == pytest.approx([x / n for x in v])


def test_parser():
    page = '<html><head><title> T </title></head><body><p>one <a href="/x">An <b>chor</b></a> two<p>three<script>no</script><a href="#">h</a><a href="y#f">Z</a><a href="/x">again</a><a href="javascript:1">j</a></body>'
    p = html.parse_page(page, "http://h/d/")
    assert p["title"] == "T"
    assert [x["url"] for x in p["links"]] == ["http://h/x", "http://h/d/y"]
    assert p["links"][0]["anchor_text"] == "An chor"
    assert p["links"][0]["context"] == "one An chor two"
    assert "no" not in p["text"].split()
    assert html.parse_page(None, None) == {"title": "", "text": "", "links": []}


def test_split_paths():
    assert urls.split_paths(" a, b,,c ") == ["a", "b", "c"] and urls.split_paths(None) == []


MESSAGES = st.tuples(st.text(alphabet='aé"\\\\/🙂\\n ü:,', max_size=12), st.floats(0.001, 1000).map(lambda x: round(x, 3)), st.integers(0, 9), st.text(alphabet="abé", max_size=5))


@settings(max_examples=10, deadline=None)
@given(st.lists(MESSAGES, min_size=1, max_size=6))
def test_message_chars_are_those_of_the_json_module(spark, rows):
    d = spark.createDataFrame(rows, "url STRING, priority DOUBLE, depth INT, sender STRING")
    got = d.select(urls.message_chars(urls.encode_message(F.col("url"), F.col("priority"), F.col("depth"), F.lit("http://s/"), F.col("sender")))).collect()
    want = [len(json.dumps({"url": u, "priority": p, "metadata": {"depth": n, "src": "http://s/"}, "forwarded_from": s})) for u, p, n, s in rows]
    assert [r[0] for r in got] == want


def test_message_chars_without_metadata(spark):
    raw = ['{"url":"u","priority":1.0,"metadata":{},"forwarded_from":"é"}', '{"url":"u","priority":1.0,"metadata":{"a":1,"b":2,"c":3},"forwarded_from":"n"}']
    got = [r[0] for r in column(spark, raw).select(urls.message_chars(F.col("x"))).collect()]
    assert got == [len(json.dumps(json.loads(x))) for x in raw]


def test_hashed_embedding(spark):
    e = [r[0] for r in column(spark, ["a b  a", "", None]).select(vectors.hashed_embedding(16)(F.col("x"))).collect()]
    v = [0.0] * 16
    for w in ("a", "b", "a"):
        h = hashlib.md5(w.encode()).hexdigest()
        v[int(h[:7], 16) % 16] += 1 if int(h[7], 16) % 2 else -1
    n = math.sqrt(sum(x * x for x in v)) + 1e-10
    assert e[0] == pytest.approx([x / n for x in v]) and e[1] == e[2] == [0.0] * 16


PART = st.sampled_from(["http://", "https://", "HTTP://", "//", "/", "a", "b.c", ".", "..", "?", "#", "x=1", ";", " ", "é", "mailto:", "h.org", ":80", "[", "%20", "\\\\", "\\t"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http://h.org/d/p?q#f", "https://h.org", "ftp://h/x", "", "http://[bad/"]), st.lists(PART, max_size=6).map("".join)), min_size=20, max_size=40))
def test_resolve_equals_the_url_library(spark, rows):
    got = [r[0] for r in spark.createDataFrame(rows, "b STRING, h STRING").select(urls.resolve(F.col("b"), F.col("h"))).collect()]
    assert got == urls._resolve(*([x[i] for x in rows] for i in (0, 1))).tolist()


def test_embeddings_by_slices(spark):
    """Long texts, in slices of a few words and with a small memory of words, have the embeddings of the column function."""
    texts = [" ".join(f"W{i * i % 977}{'x' * (i % 80)}" for i in range(900)), "a b\ta", "", None, "one" * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    got = {r.id: r.e for r in vectors.embedded(d, "id", "text", 16, known_words=10, slice_chars=50).collect()}
    want = {r.id: r.e for r in d.select("id", vectors.hashed_embedding(16)(F.col("text")).alias("e")).collect()}
    assert got == {i: pytest.approx(e) for i, e in want.items()} and len(got) == 5
