"""Operators with models, coders, packing and media: accuracy, round trips, and brute force."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siltweave.llm import bpe, media, packing, perplexity, pii, quality, queries
from tests.llm.common import ODD, documents, prose, words_of


# personal data


def test_pii_on_held_out_sentences():
    model = pii.trained()
    hit = wrong = total = 0
    for text, gold in pii.generated(300, seed=99):
        got = set(model.decode(text))
        hit += len(got & set(gold))
        wrong += len(got - set(gold))
        total += len(gold)
    assert hit / total > 0.93 and hit / (hit + wrong) > 0.93


def test_pii_boundaries():
    model = pii.trained()
    for text, span in [("write to a.b@mail.example.com, now", "a.b@mail.example.com"), ("call +1 (555) 123-4567 today", "+1 (555) 123-4567"), ("host 10.1.2.3 is up", "10.1.2.3"), ("ssn 123-45-6789.", "123-45-6789")]:
        assert [text[a:b] for a, b, _ in model.decode(text)] == [span]
    for text in ("in 2024-01-05 it cost $12.50", "version 1.2.3 of 10", "@someone said 7", "the plain words"):
        assert model.decode(text) == []


def brute_decode(model, text):
    """The best labelling by trying all sets of disjoint segments of one region."""
    m = pii.REGION.search(text)
    tokens, spans = pii.candidates(text, m.start(), m.end())
    best = [(-math.inf, [])]

    def go(at, prev, score, out):
        if at == len(tokens):
            total = score + model.moves[prev, 0]
            if total > best[0][0]:
                best[0] = (total, list(out))
            return
        go(at + 1, 0, score + model.moves[prev, 0], out)
        for i, j in spans:
            if i == at:
                s = model.span_scores(text, tokens[i][0], tokens[j - 1][1])
                for y in range(len(pii.TYPES)):
                    go(j, y + 1, score + model.moves[prev, y + 1] + s[y], out + [(tokens[i][0], tokens[j - 1][1], pii.TYPES[y])])

    go(0, 0, 0.0, [])
    return best[0][1]


def test_pii_dynamic_programming_is_exact():
    model = pii.trained()
    hard = pii.SemiCRF(model.index, model.weights, np.random.default_rng(3).normal(size=model.moves.shape) * 2)
    hard.moves[0, 0] = 0
    for text in ("10.2.3", "a1@b.co", "5-12-45", "Dr. Ann Lee 7", "pwd=ab1"):
        assert model.decode(text) == brute_decode(model, text)
        assert hard.decode(text) == brute_decode(hard, text)


def test_pii_likelihood_and_gradient():
    index = {}
    r = pii.Regions([("to a1@b.co 12", [(3, 10, "EMAIL")]), ("5-1 x7", [(0, 3, "PHONE"), (4, 6, "SSN")])], index)
    g = np.random.default_rng(0)
    k = len(pii.TYPES) + 1
    w, m = g.normal(size=(len(index), k - 1)) * 0.3, g.normal(size=(k, k)) * 0.3
    loss, gw, gm = pii.likelihood(r, w, m)

    def brute():
        """All labellings of each region, one by one."""
        scores = np.zeros((r.kinds, k - 1))
        np.add.at(scores, r.owner, w[r.feat])
        total = 0.0
        gold = dict(r.gold)
        for first, n in zip(r.first, r.sizes):
            mine = [x for x in range(len(r.start)) if first <= r.start[x] < first + n]
            every, right = [], []

            def go(at, prev, score, ok, mine=mine, first=first, n=n, every=every, right=right):
                if at == n:
                    every.append(score + m[prev, 0])
                    if ok == {x for x in gold if x in mine}:
                        right.append(every[-1])
                    return
                go(at + 1, 0, score + m[prev, 0], ok)
                for x in mine:
                    if r.start[x] == first + at:
                        for y in range(k - 1):
                            go(r.end[x] - first, y + 1, score + m[prev, y + 1] + scores[r.kind[x], y], ok | {x} if gold.get(x) == y else ok | {-1})

            go(0, 0, 0.0, frozenset())
            top = max(every)
            total += top + math.log(sum(math.exp(v - top) for v in every)) - right[0]
        return total

    small = pii.Regions([("x7 b", []), ("5-1", [(0, 3, "PHONE")])], {})
    assert small.places < 12
    for x, grad in ((w, gw), (m, gm)):
        for at in list(np.ndindex(x.shape))[::7]:
            x[at] += 1e-6
            up = pii.likelihood(r, w, m)[0]
            x[at] -= 2e-6
            down = pii.likelihood(r, w, m)[0]
            x[at] += 1e-6
            assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    index = {}
    r = pii.Regions([("5-1", [(0, 3, "PHONE")]), ("x7", [])], index)
    w = g.normal(size=(len(index), k - 1))
    assert pii.likelihood(r, w, m)[0] == pytest.approx(brute())


def test_pii_on_sentences_written_by_hand():
    """Not from the generator: what is to be found stands between braces."""
    marked = [
        ("Please write to {jane.doe@acme.org}, or call {(212) 555-0187} before noon.", ["EMAIL", "PHONE"]),
        ("Her card {4111 1111 1111 1111} was charged from {203.0.113.7}.", ["CARD", "IP"]),
        ("Patient {Dr. Alice Brown} lives at {221B Baker Street} in town.", ["PERSON", "ADDRESS"]),
        ("She was born on {12 May 1984} and moved in 2010.", ["BIRTH"]),
        ("dob: {1979-11-23}, ssn: {078-05-1120}", ["BIRTH", "SSN"]),
        ("the server at {2001:db8:85a3:0:0:8a2e:370:7334} is down", ["IP"]),
        ("wire it to {GB82 WEST 1234 5698 7654 32} please", ["IBAN"]),
        ("set password={hunter2horse} in the file", ["SECRET"]),
        ("phone {2125550187} or mail: {root@localhost}", ["PHONE", "EMAIL"]),
        ("the header holds {eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM} today", ["SECRET"]),
        ("on 2024-02-03 we sold 12,500 units at $3.20 each", []),
        ("see section 4.2.1 and version 2.10.3 of the manual", []),
        ("the password: nothing is known of it", []),
        ("In 1999 The Times of London had 40 pages", []),
        ("Room 12 Main Hall opens at 09:30, ISBN 978-3-16-148410-0", []),
        ("invoice 20240117 of order 1234567812345678 is paid", []),
    ]
    model, right, wrong, total = pii.trained(), 0, 0, 0
    for text, kinds in marked:
        plain, spans, at = "", [], 0
        for part in re.split(r"[{}]", text):
            if at % 2:
                spans.append((len(plain), len(plain) + len(part), kinds[at // 2]))
            plain, at = plain + part, at + 1
        got = model.decode(plain)
        right += len(set(got) & set(spans))
        wrong += len(set(got) - set(spans))
        total += len(spans)
        if set(got) != set(spans):
            print(plain, [(plain[a:b], k) for a, b, k in got])
    assert right >= 0.9 * total and wrong <= 1


def test_pii_odd_rows(spark):
    d = documents(spark, ODD + [(1, "mail x@y.org")]).withColumns({"spans": F.lit(1), "n_spans": F.lit(2)})
    got = {r.doc_id: r for r in pii.redact(d.withColumn("a.b", F.lit(1))).collect()}
    assert got[1].text == "mail [EMAIL]" and got[1].n_spans == 1 and got[1]["a.b"] == 1
    assert all(got[i].text == t for i, t in ODD)
    with pytest.raises(ValueError):
        pii.redact(d, text_col="spans")
    assert pii.redact(documents(spark, [])).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_at(bpe.VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(encoder, text):
    import tiktoken

    t = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    ids = encoder.encode(text)
    assert ids == t.encode_ordinary(text)
    assert encoder.decode_bytes(ids) == text.encode()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8), st.text(alphabet="ab 1'st\n.é", max_size=8)), max_size=6))
def test_bpe_edits(encoder, edits):
    d = bpe.Document(encoder, prose(1, 12))
    text = d.text
    for at, n, more in edits:
        at = min(at, len(text))
        text = text[:at] + more + text[at + n :]
        d.replace(at, min(at + n, len(d.text)), more)
        assert d.text == text and d.ids() == encoder.encode(text)


def test_bpe_append_redoes_little(encoder):
    d = bpe.Document(encoder, prose(2, 2000))
    before = d.redone
    d.append(" more")
    assert d.redone - before < 100 and d.ids() == encoder.encode(d.text)


def test_bpe_round_trip(spark):
    d = documents(spark, ODD).withColumn("ids", F.lit("mine"))
    e = bpe.encode(d)
    got = Counter((r.doc_id, r.text) for r in bpe.decode(e).collect())
    assert got == Counter(ODD)
    assert bpe.encode(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        bpe.encoder_at(bpe.VOCABULARY).decode_bytes([10**7])
    for bad in ([10**7], [-1]):
        with pytest.raises(ValueError):
            bpe.encoder_at(bpe.VOCABULARY).bytes_of(np.array(bad))
    half = spark.createDataFrame([(1, [bpe.encoder_at(bpe.VOCABULARY).ranks[b"\xc3"]]), (2, None), (3, [])], "doc_id INT, ids ARRAY<INT>")
    assert {r.doc_id: r.text for r in bpe.decode(half).collect()} == {1: "\ufffd", 2: None, 3: ""}


def test_bpe_query_decodes_what_it_encodes(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: r.d for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5("text").alias("d")).collect()}
    assert {r.doc_id: r.digest for r in queries.op5_bpe(spark, sf).collect()} == want


# quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    graded = quality.grades_of(spark.read.parquet(f"{sf}/labels.parquet"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, graded.filter(~h))
    got = quality.score(docs.join(graded.filter(h), "doc_id"), model).select("grade", "keep", "expected_grade", "tail_prob").toPandas()
    assert (got.keep == (got.grade == 2)).mean() > 0.95
    assert got.groupby("grade").expected_grade.mean().is_monotonic_increasing
    assert (np.diff(model.thresholds) > 0).all() and got.expected_grade.between(0, quality.GRADES - 1).all()


def test_quality_gradient_and_likelihood():
    r = np.random.default_rng(0)
    n, size = 12, 6
    row = np.repeat(np.arange(n), 3)
    idx, val = r.integers(0, size, len(row)), r.random(len(row))
    says, mean, grades = r.random((n, 3)), r.random((3, size)), r.integers(0, 3, n)
    w, par = r.normal(size=size), np.array([-0.3, 0.2])
    f = lambda w, par: quality.likelihood(w, par, idx, val, row, says, mean, grades, 0.1)
    loss, g, gp = f(w, par)
    want = 0.05 * (w * w).sum()
    for i in range(n):  # by its definition
        eta = sum(w[j] * x for j, x, k in zip(idx, val, row) if k == i) - says[i] @ mean @ w
        th = [-math.inf, par[0], par[0] + math.exp(par[1]), math.inf]
        below = lambda k: 1 / (1 + math.exp(-(th[k] - eta))) if 0 < k < 3 else float(k == 3)
        want -= math.log(below(grades[i] + 1) - below(grades[i])) / n
    assert loss == pytest.approx(want)
    for x, grad in ((w, g), (par, gp)):
        for k in range(len(x)):
            x[k] += 1e-6
            up = f(w, par)[0]
            x[k] -= 2e-6
            down = f(w, par)[0]
            x[k] += 1e-6
            assert grad[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_quality_odd_rows(spark):
    docs = documents(spark, ODD + [(i, prose(i, 40) if i % 2 else "!! $$ %% " * 20) for i in range(40)])
    graded = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(40)] + [(100, 1), (999, 2), (3, None), (None, 1), (4, 7), (5, -1), (6, 0)], "doc_id BIGINT, grade INT")
    model = quality.train(docs, graded)
    got = quality.score(docs.withColumns({"KEEP": F.lit("mine"), "a.b": F.lit(1)}), model)
    assert got.columns == [*docs.columns, "a.b", "expected_grade", "tail_prob", "keep"]
    got = got.collect()
    assert len(got) == docs.count() and all(0 <= r.tail_prob <= 1 for r in got)
    assert all(r.keep == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 40)
    nothing = quality.train(documents(spark, []), graded)
    assert all(r.keep and r.expected_grade > 1.99 for r in quality.score(docs, nothing).collect())
    assert quality.score(documents(spark, []), nothing).count() == 0


# media


PAGE = """<html><head><title>no</title><script>var x = '<img src=bad.png>'</script></head><body><p>One  two
<img src="/a.png" alt="A"> three</p><figure><img src="b.jpg"><figcaption>The <b>caption</b></figcaption></figure>
<video title="V"><source src="v.mp4"><source src="v.webm"></video><img><p>end &amp; done<img src="data:image/png;base64,aGk="></body>"""


def test_media_order_and_captions():
    items = media.parse(PAGE, "http://h/d/p")
    assert [(x["kind"], x["text"]) for x in items] == [("text", "One two"), ("image", "A"), ("text", "three"), ("image", "The caption"), ("video", "V"), ("text", "end & done"), ("image", None)]
    assert [x["url"] for x in items if x["kind"] != "text"][:3] == ["http://h/a.png", "http://h/d/b.jpg", "http://h/d/v.mp4"]
    assert items[1]["digest"] == hashlib.sha256(b"http://h/a.png").hexdigest() and items[-1]["digest"] == hashlib.sha256(b"hi").hexdigest()
    assert [x["pos"] for x in items] == list(range(7))
    assert media.parse("", "") == [] and media.parse("<p>open <a href='x'>link", "http://h/", True)[-1]["text"] == "link"


def test_media_join(spark):
    rows = [(1, "http://h/d/p", PAGE), (1, "http://h/d/p", PAGE), (2, None, None), (3, "x", ""), (None, "http://h/", "<img src=a.png>")]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumn("items", F.lit(1))
    load = spark.createDataFrame([("http://h/a.png", "abc"), ("http://h/a.png", "abd"), ("http://h/d/v.mp4", "vv"), (None, "x"), ("u", None)], "url STRING, content STRING")
    got = media.interleave(pages, media.payload_index(load)).collect()
    assert len(got) == 5
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    least = min(hashlib.sha256(x).hexdigest() for x in (b"abc", b"abd"))
    for r in by[1]:
        assert [x.content_digest for x in r["items"]] == [None, least, None, None, hashlib.sha256(b"vv").hexdigest(), None, None]
        assert r["items"][4].bytes == 2
    assert by[2][0]["items"] is None and by[3][0]["items"] == [] and by[None][0]["items"][0].content_digest == least
    none = media.interleave(pages.limit(0), media.payload_index(load.limit(0)))
    assert none.count() == 0


def test_media_against_brute_force(spark):
    """Generated pages of text, images by URL and by content, players, and links between them."""
    r = random.Random(5)
    files = {f"http://h{r.randrange(3)}/m/{k}.png": bytes(r.randrange(256) for _ in range(k % 7)) for k in range(30)}
    inline = [f"data:image/png;base64,{base64.b64encode(bytes([k, k + 1])).decode()}" for k in range(4)] + ["data:,plain%20text"]
    pages, want = [], {}
    for p in range(40):
        html, items = "<head><title>t</title>", []
        for k in range(r.randrange(6) if p % 5 else 0):
            html += f"<p>word{k}</p>"
            items.append(("text", f"word{k}", None))
            url = r.choice([*files, "http://h0/none.png", *inline])
            shape = r.randrange(3)
            html += (f'<img src="{url}" alt="A{k}">', f'<figure><img src="{url}"><figcaption>C{k}</figcaption></figure>', f'<a href="{url}">L{k}</a>')[shape]
            items.append((("image", "image", "link")[shape], f"{'ACL'[shape]}{k}", url))
        pages.append((p, f"http://site/{p}", html))
        want[p] = items
    contents = list(files.values()) + [bytes([k, k + 1]) for k in range(3)] + [b"plain text"]
    load = [(u, bytearray(c)) for u, c in files.items()] + [(None, bytearray(c)) for c in contents[30:]]
    d = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING").withColumns({"key": F.lit(7), "found": F.lit("f"), "a.b": F.lit(1)})
    got = media.interleave(d, media.payload_index(spark.createDataFrame(load, "url STRING, content BINARY")), links=True)
    assert got.columns == ["page_id", "url", "key", "found", "a.b", "items"]
    got = got.collect()
    assert sorted(x.page_id for x in got) == list(range(40)) and all(x.key == 7 and x.found == "f" for x in got)
    resolved = 0
    for row in got:
        assert [x.pos for x in row["items"]] == list(range(len(row["items"])))
        assert [(x.kind, x.text, x.url) for x in row["items"]] == want[row.page_id]
        for x in row["items"]:
            raw = files.get(x.url) if x.url else None
            if x.url and x.url.startswith("data:"):
                raw = next((c for c in contents if hashlib.sha256(c).hexdigest() == hashlib.sha256(media.data_bytes(x.url)).hexdigest()), None)
            assert (x.content_digest, x.bytes) == ((hashlib.sha256(raw).hexdigest(), len(raw)) if raw is not None else (None, None))
            resolved += raw is not None
    assert resolved > 40


# perplexity


def brute_model(texts, order=3):
    """Interpolated modified Kneser-Ney by dictionaries."""
    top = Counter()
    for t in texts:
        b = b"\0" * (order - 1) + t.encode()
        for i in range(order - 1, len(b)):
            top[b[i - order + 1 : i + 1]] += 1
    tables = [top]
    for k in range(order - 1, 0, -1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    tables = tables[::-1]

    def discounts(c):
        m = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] and m[1] else 0.5
        return [min(max(i - (i + 1) * y * m[i] / m[i - 1], 0.1), i - 0.05) if m[i - 1] and m[i] else min(0.5 * i, 1.5) for i in (1, 2, 3)]

    ds = [discounts(c) for c in tables]

    def prob(g):
        k = len(g)
        if not k:
            return 1 / 256
        c, d = tables[k - 1], ds[k - 1]
        after = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not after:
            return prob(g[1:])
        total = sum(after.values())
        cut = lambda v: d[min(v, 3) - 1]
        v = after.get(g, 0)
        return (v - cut(v) if v else 0) / total + sum(map(cut, after.values())) / total * prob(g[1:])

    return prob


@pytest.mark.parametrize("max_grams", [perplexity.MAX_GRAMS, 10])
def test_perplexity_against_brute_force(spark, max_grams):
    """By arrays, and by joins as with a model too large for them."""
    texts = [prose(i, 15) for i in range(6)] + ["aaa bbb aaa", "aaa bbb"]
    d = documents(spark, list(enumerate(texts)))
    model = perplexity.train(d, order=3)
    prob = brute_model(texts)
    new = texts + ["zzz qqq é", prose(77, 5)]
    rows = documents(spark, list(enumerate(new)) + [(90, None), (91, "")]).withColumns({"a.b": F.lit(1), "Entropy": F.lit(2)})
    got = perplexity.score(rows, model, max_grams=max_grams)
    assert got.columns == [*rows.columns[:-1], "n_bytes", "entropy", "entropy_var"]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(new) + 2 and got[90].entropy is None and got[91].entropy is None and got[91].n_bytes == 0
    for i, t in enumerate(new):
        b = b"\0\0" + t.encode()
        each = [-math.log(prob(b[k - 2 : k + 1])) for k in range(2, len(b))]
        assert got[i].entropy == pytest.approx(np.mean(each), rel=1e-4)
        assert got[i].entropy_var == pytest.approx(np.var(each), rel=1e-3) and got[i].n_bytes == len(t.encode())


def test_perplexity_sums_to_one(spark):
    m = perplexity.arrays(perplexity.train(documents(spark, [(1, prose(1, 60))]), order=3))["en"]
    every = np.arange(256, dtype=np.uint64)
    for ctx in (b"ab", b"zz", b"a "):
        base = np.uint64(int.from_bytes(ctx, "big") << 8)
        assert np.exp(m.score(base | every)).sum() == pytest.approx(1, abs=1e-3)


def test_perplexity_bands(spark):
    rows = ODD + [(i, prose(i, 200)) for i in range(60)] + [(90, "#@!$%^&*" * 100), (91, "ab " * 700)]
    d = documents(spark, rows).withColumns({"entropy": F.lit("mine"), "lang": F.when(F.col("doc_id") == 5, None).otherwise("en")})
    got = {r.doc_id: r for r in perplexity.rule(d, order=5).collect()}
    assert not got[90].keep and not got[91].keep
    assert all(got[i].keep for i in list(range(60)) + [100, 101])
    # the bands by their definition
    model = perplexity.train(d, order=5)
    every = perplexity.score(d, model).collect()
    assert sorted(map(str, perplexity.score(d, model, seen=True).collect())) == sorted(map(str, every))
    s, en = {r.doc_id: r for r in every}, [r for r in every if r.doc_id != 5 and r.entropy is not None]
    lower_median = lambda v: sorted(v)[(len(v) - 1) // 2]
    median = lower_median([r.entropy for r in en])
    spread = 1.4826 * lower_median([abs(r.entropy - median) for r in en])
    for i in (0, 30, 90, 103):
        reach = perplexity.WIDTH * math.sqrt(spread**2 + np.mean([r.entropy_var for r in en]) / max(s[i].n_bytes, 1))
        assert got[i].upper == pytest.approx(math.exp(median + reach), rel=1e-6) and got[i].lower == pytest.approx(math.exp(median - reach), rel=1e-6)
        assert got[i].keep == (median - reach <= s[i].entropy <= median + reach)
    assert perplexity.rule(documents(spark, [])).count() == 0


# packing


def test_packing_is_a_packing(spark):
    r = random.Random(0)
    rows = [(i, "w " * r.choice([1, 10, 300, 700, 900, 1200, 5000])) for i in range(300)] + [(7, "w " * 10)] + ODD
    d = documents(spark, rows).withColumns({"bin_id": F.lit(1), "Start": F.lit(2), "n_tokens": F.lit(3)})
    got = packing.pack(d, pool=128).collect()
    cap, e = packing.CAPACITY, bpe.encoder_at(bpe.VOCABULARY)
    fill, inside = defaultdict(int), defaultdict(list)
    for x in got:
        fill[x.bin_id] += x.size
        if x.size:
            inside[x.bin_id].append((x.start, x.start + x.size))
    assert fill.pop(None, 0) == 0 and max(fill.values()) <= cap
    assert all(a[1] == b[0] for xs in inside.values() for a, b in zip(sorted(xs), sorted(xs)[1:])) and all(min(xs)[0] == 0 for xs in inside.values())
    want = Counter()
    for i, t in rows:
        n = len(e.encode(t or ""))
        for k in range(max(1, -(-n // cap))):
            want[i, k * cap, min(cap, n - k * cap)] += 1
    assert Counter((x.doc_id, x.offset, x.size) for x in got) == want
    assert len({(x.doc_id, x.copy, x.piece) for x in got}) == len(got)
    assert len(fill) <= 1.1 * (sum(fill.values()) / cap) + 3
    assert packing.pack(documents(spark, [])).count() == 0


def test_generations_run_on_the_tables(spark):
    """In every pool of the query, though best-fit decreasing has as few bins as there can be; and the fill gets better."""
    docs = bpe.counted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    parts = packing.pieces_of(docs, "doc_id", F.col("n_tokens"), packing.CAPACITY).cache()
    _, state = packing.islands_of(parts, packing.CAPACITY, packing.POOL, packing.ISLANDS, packing.POPULATION, packing.EPOCHS, packing.GENERATIONS)
    best = packing.elites(state, packing.CAPACITY).collect()
    assert all(r.generations > 0 for r in best)
    sizes = {r.pool: list(r.sizes) for r in state.collect()}
    for p, s in sizes.items():
        first = packing.fitness(packing.best_fit([], range(len(s)), s, packing.CAPACITY), packing.CAPACITY)
        assert max((r.bins, r.fill) for r in best if r.pool == p) > first


def test_evolution_beats_best_fit_on_hard_sizes():
    better = 0
    for seed in range(3):
        r = random.Random(seed)
        sizes = sorted(x for _ in range(120) for a, b in [(r.randint(500, 800), r.randint(500, 800))] for x in (a, b, 2048 - a - b))
        pop = packing.seed_population(sizes, 2048, 6, r)
        first = packing.fitness(pop[0], 2048)
        done, k = packing.evolve(pop, sizes, 2048, 80, r)
        assert k == 80 and sorted(x for _, xs in done[0] for x in xs) == list(range(360))
        better += packing.fitness(done[0], 2048)[0] > first[0]
    assert better == 3


def test_evolution_finds_the_optimum_of_small_pools():
    def least(sizes, cap):  # exhaustive
        best = [len(sizes)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= cap:
                    go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
            go(i + 1, bins + [sizes[i]])

        go(0, [])
        return best[0]

    for seed in range(20):
        r = random.Random(seed)
        sizes = sorted(r.randint(2, 7) for _ in range(9))
        done, _ = packing.evolve(packing.seed_population(sizes, 10, 6, r), sizes, 10, 60, r)
        assert len(done[0]) == least(sizes, 10)


def test_crossover_injects_whole_bins():
    sizes = [5, 5, 4, 6, 3, 7, 2, 8]
    rng = random.Random(1)
    pop = packing.seed_population(sizes, 10, 6, rng)
    for _ in range(30):
        a, b = rng.sample(pop, 2)
        c = packing.crossover(a, b, sizes, 10, rng)
        assert sorted(x for _, g in c for x in g) == list(range(8)) and all(sum(sizes[x] for x in g) == f <= 10 for f, g in c)
        assert any(sorted(g) in [sorted(h) for _, h in b] for _, g in c)
        m = packing.mutate(c, sizes, 10, rng)
        assert sorted(x for _, g in m for x in g) == list(range(8)) and all(sum(sizes[x] for x in g) == f <= 10 for f, g in m)
    done, k = packing.evolve(pop, sizes, 10, 50, rng)
    assert len(done[0]) == 4 and k < 50  # four full bins can't be improved
