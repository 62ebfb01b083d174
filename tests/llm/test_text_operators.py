"""Operators over texts, each against a brute-force version on small tables, and on odd rows."""

import pathlib
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, example, given, settings, strategies as st
from pyspark.sql import functions as F

from siltweave.llm import jaccard, lines, sharding, substrings
from tests.llm.common import ODD, documents, edited, prose, words_of

COPIES = [(i, prose(i, 120)) for i in range(12)]
COPIES += [(20 + i, edited(COPIES[0][1], i, 25)) for i in range(6)] + [(30 + i, COPIES[1][1]) for i in range(4)]
COPIES += [(40 + i, prose(90 + i, 30) + " " + COPIES[2][1][:500] + " " + prose(70 + i, 30)) for i in range(4)]
COPIES += [(50, "la " * 200), (51, "la " * 49), (52, prose(5, 60) + "\n" + COPIES[5][1])]


def brute_pairs(rows, n=jaccard.N, threshold=jaccard.THRESHOLD):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None and w:
            sets.setdefault(i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]))
    first, out = {}, {}
    for i in sorted(sets):
        if sets[i] in first:
            out[first[sets[i]], i] = 1.0
        else:
            first[sets[i]] = i
    reps = sorted(first.values())
    for x, a in enumerate(reps):
        for b in reps[x + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= threshold:
                out[a, b] = j
    return out


def test_jaccard_against_brute_force(spark):
    rows = COPIES + ODD
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.join(spark, documents(spark, rows)).collect()}
    want = brute_pairs(rows)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(got[p] == pytest.approx(want[p]) for p in got)
    assert not any(i in (100, 101, 102, 103, 106) for p in got for i in p)


def test_jaccard_of_many_variants_has_no_cap(spark):
    base = prose(1, 80)
    rows = [(i, edited(base, i, 80)) for i in range(400)]
    pairs = {(r.doc_a, r.doc_b) for r in jaccard.join(spark, documents(spark, rows)).collect()}
    want = brute_pairs(rows)
    assert len(pairs & set(want)) >= 0.9 * len(want)


def test_jaccard_empty_and_groups(spark):
    none = jaccard.join(spark, documents(spark, []))
    assert none.count() == 0 and jaccard.groups(none).count() == 0
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 30)] + [(50, 51, 1.0), (51, 51, 1.0)], "doc_a BIGINT, doc_b BIGINT, jaccard DOUBLE")
    got = {r.doc_id: r.group for r in jaccard.groups(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50}
    d = documents(spark, [(i, "t") for i in (0, 1, 2, 50, 51)] + [(None, "n")])
    assert {r.doc_id for r in jaccard.keep_first(d, chain).collect()} == {0, 1, 50, None}


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches()
    assert all(m / n < jaccard.THRESHOLD for n, m in least.items()) and least[jaccard.HASHES] > 0


def brute_places(rows, n=50):
    first, out, seen = {}, defaultdict(set), set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if i in seen:
            continue
        seen.add(i)
        w = words_of(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in first:
                out[i].add(k)
            else:
                first[key] = (i, k)
    return dict(out)


def places(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id] |= set(range(r.start, r.end - 49))
    return dict(out)


@pytest.mark.parametrize("batches, hot", [(1, substrings.HOT), (3, substrings.HOT), (2, 3)])
def test_substrings_against_brute_force(spark, batches, hot):
    rows = COPIES + ODD
    got = substrings.dedup(spark, documents(spark, rows), batches=batches, hot=hot).collect()
    assert places(got) == brute_places(rows)
    texts = {i: words_of(t) for i, t in rows}
    assert all(texts[r.doc_id][r.start : r.end] == texts[r.first_doc_id][r.first_start : r.first_start + r.end - r.start] for r in got)


def test_substring_runs_are_compacted_and_the_index_opened_again(spark):
    index = substrings.FingerprintIndex(spark, buckets=4, fan_out=2)
    got = []
    for k in range(4):
        got += index.add(documents(spark, [r for r in COPIES if r[0] % 4 == k])).collect()
        index.forget()
        index = substrings.FingerprintIndex(spark, index.path)
        assert index.state["buckets"] == 4 and index.state["generation"] == k + 1
    assert len(index.runs) <= 2
    kept = {f.name for f in pathlib.Path(index.path.removeprefix("file:").replace("//", "/")).iterdir() if f.name.startswith("run_")}
    assert kept == set(index.runs)
    order = [r for k in range(4) for r in COPIES if r[0] % 4 == k]
    renamed = {i: n for n, (i, _) in enumerate(sorted(order, key=lambda r: (r[0] % 4, r[0])))}
    assert {renamed[i]: p for i, p in places(got).items()} == brute_places([(renamed[i], t) for i, t in order])


def test_substring_runs_are_joined_without_shuffle_or_sort(spark):
    index = substrings.FingerprintIndex(spark, buckets=4)
    index.add(documents(spark, COPIES[:8]))
    index.add(documents(spark, COPIES[8:]))
    a, b = (index._run(r) for r in index.runs)
    with substrings._in_order(spark):
        j = a.join(b.select("h").hint("merge"), "h", "left_semi")
        plan = j._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan


def test_substrings_empty_and_cut(spark):
    assert substrings.dedup(spark, documents(spark, [])).count() == 0
    d = documents(spark, [(1, "a b  c d"), (2, None)]).withColumns({"spans_": F.lit(1), "id_": F.lit(2), "a.b": F.lit(3)})
    spans = spark.createDataFrame([(1, 1, 3)], "doc_id BIGINT, start INT, end INT")
    got = substrings.cut_spans(d, spans)
    assert got.columns == d.columns and {r.doc_id: r.text for r in got.collect()} == {1: "a d", 2: None}
    text = prose(3, 60)
    named = spark.createDataFrame([("x", text), ("w", text), (None, text)], "`the.id` STRING, h STRING")
    assert [tuple(r) for r in substrings.dedup(spark, named, "the.id", "h").collect()] == [("x", 0, 60, "w", 0)]


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[i] = None
            continue
        keep = []
        for line in t.split("\n"):
            if line.strip(" \t\r\x0b\f") and line in seen:
                continue
            if line.strip(" \t\r\x0b\f"):
                seen.add(line)
            keep.append(line)
        out[i] = "\n".join(keep)
    return out


LINES = [(i, "\n".join(f"line {random.Random(i * 10 + k).randrange(25)}" for k in range(8)) + "\n\n") for i in range(20)]


@pytest.mark.parametrize("batches", [1, 2])
def test_lines_against_brute_force(spark, batches):
    rows = LINES + ODD
    d = documents(spark, rows).withColumn("lines_dropped", F.lit("mine"))
    got = lines.dedup(spark, d, batches=batches).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    assert all(r.text == want[r.doc_id] for r in got)


def test_line_deletions_are_reversible(spark):
    store = lines.LineStore(spark, shards=4)
    store.insert(documents(spark, LINES[:10]))
    store.insert(documents(spark, LINES[10:]))
    store.delete(spark.createDataFrame([(i,) for i in range(0, 20, 3)], "doc_id BIGINT"))
    left = [r for r in LINES if r[0] % 3]
    got = {(r.doc_id, r.line_no) for r in store.holders().collect()}
    seen, want = set(), set()
    for i, t in left:
        for k, line in enumerate(t.split("\n")):
            if not line.strip() or line not in seen:
                want.add((i, k))
            seen.add(line)
    assert got == want
    store.compact()
    assert {r.n for r in store.counts().collect()} and store.counts().count() == len({x for _, t in left for x in t.split("\n") if x.strip()})
    gone_lines = {x for i, t in LINES if i % 3 == 0 for x in t.split("\n") if x.strip()} - {x for _, t in left for x in t.split("\n")}
    again = lines.dedup_batch(store, documents(spark, [(90, "\n".join(sorted(gone_lines)) + "\nline brand new")])).first()
    assert again.lines_dropped == 0


def simulated(steps):
    """Holders, as (id, line number), after inserting and deleting documents one batch after the other; and the lines' numbers of references."""
    force = []  # (generation, id, text)
    for g, (kind, batch) in enumerate(steps):
        if kind == "insert":
            force += [(g, i, t) for i, t in sorted(set(batch)) if (i, t) not in {x[1:] for x in force}]
        else:
            force = [x for x in force if x[1] not in batch]
    seen, out, counts = set(), set(), defaultdict(int)
    for _, i, t in sorted(force):
        for k, line in enumerate(t.split("\n")):
            counts[line] += 1
            if line not in seen:
                out.add((i, k))
            seen.add(line)
    return out, sorted(counts.values())


STEPS = st.lists(st.tuples(st.sampled_from(["insert", "insert", "delete"]), st.lists(st.integers(0, 3), min_size=1, max_size=3)), min_size=3, max_size=5)


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(STEPS)
@example([("insert", [1]), ("delete", [1]), ("insert", [1]), ("insert", [2]), ("delete", [1])])
@example([("insert", [0, 1]), ("insert", [0, 1]), ("delete", [0]), ("insert", [2])])
def test_line_store_under_any_order_of_steps(spark, steps):
    texts = {0: "a\nb", 1: "b\nc\nb", 2: "a\nc", 3: "d"}
    store = lines.LineStore(spark, shards=2, per_shard=2, fan_out=3)
    done = []
    for kind, ids in steps:
        rows = [(i, texts[i]) for i in ids]
        if kind == "insert":
            got = {r.doc_id: r.text for r in lines.dedup_batch(store, documents(spark, rows)).collect()}
            done.append((kind, rows))
            held, _ = simulated(done)
            for i in got:
                assert got[i] == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if (i, k) in held)
        else:
            store.delete(spark.createDataFrame([(i,) for i in ids], "doc_id BIGINT"))
            done.append((kind, ids))
    held, counts = simulated(done)
    assert {(r.doc_id, r.line_no) for r in store.holders().collect()} == held
    assert sorted(r.n for r in store.counts().collect()) == counts


def test_lines_with_any_names_and_ids(spark):
    rows = [("b", "x\ny", 1, 2), ("a", "x\nz", 1, 2), (None, "z", 1, 2), ("a", "x\nz", 1, 2)]
    d = spark.createDataFrame(rows, "`the.id` STRING, text STRING, keep_ INT, Lines_Dropped INT")
    got = lines.dedup(spark, d, "the.id")
    assert got.columns == ["the.id", "text", "keep_", "lines_dropped"]
    assert sorted((str(r[0]), r.text, r.lines_dropped) for r in got.collect()) == [("None", "z", 0), ("a", "x", 1), ("a", "x", 1), ("b", "y", 1)]
    assert lines.dedup(spark, d.limit(0), "the.id").count() == 0


def test_cuckoo_filter():
    import numpy as np

    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    f = lines.built(keys)
    assert f.contains(keys).all()
    other = np.random.default_rng(1).integers(-(2**62), 2**62, 20000)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert lines.CuckooFilter.load(f.dump()).contains(keys[2500:]).all()


def test_sharding(spark):
    r = random.Random(0)
    rows = [(i, "x" * r.choice([10, 20, 4000])) for i in range(800)] + ODD
    d = documents(spark, rows).withColumns({"slot": F.lit("mine"), "shard": F.lit("mine")})
    got = sharding.shard_documents(spark, d, shards=8, slots=256).collect()
    assert len(got) == len(rows)
    assert len({(x.slot, x.shard) for x in got}) == len({x.slot for x in got})
    by = {i: len((t or "").encode()) for i, t in rows}
    load = lambda c: [sum(by[x.doc_id] for x in got if getattr(x, c) == s) for s in range(8)]
    heavy = by[106]
    assert max(load("shard")) <= max(heavy + 8000, max(load("old_shard")))
    assert sharding.shard_documents(spark, documents(spark, []), shards=4, slots=16).count() == 0


def test_slot_map_versions(spark, tmp_path):
    m = sharding.SlotMap.create(spark, f"file://{tmp_path}/map", 4, 16)
    assert m.version() == 0
    assert m.edit(spark.createDataFrame([(3, 0)], "slot INT, shard INT")) == 1
    assert {r.slot: r.shard for r in m.at().collect()}[3] == 0 and {r.slot: r.shard for r in m.at(0).collect()}[3] == 3
