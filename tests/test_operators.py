import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltweave.operators import cluster, crawl, frontier, metrics, semantic, similarity
from siltweave.operators.ordered import running
from siltweave.sources import crawl_log
from siltweave.streaming import streams


def test_log_needs_its_columns(spark):
    with pytest.raises(ValueError):
        crawl_log.typed_log(spark.createDataFrame([("u",)], "url STRING"))


def test_csv_with_line_ends_and_bad_numbers(spark, tmp_path):
    (tmp_path / "log.csv").write_text('timestamp,url,bytes_downloaded,fetch_latency_ms,status_code,is_relevant,cumulative_pages,cumulative_relevant,error\r\n1.5,u,x,2.5,404.0,True,1,1,"a\nb"\r\n2,v,7,,200,False,2,1,\r\n')
    got = crawl_log.read_csv_log(spark, str(tmp_path / "log.csv")).orderBy("url").collect()
    assert [(r.url, r.bytes_downloaded, r.fetch_latency_ms, r.status_code, r.is_relevant) for r in got] == [("u", 0, 2.5, 404, True), ("v", 7, 0.0, 200, False)]
    assert got[0].error == "a\nb" and (got[1].mode, got[1].node_id, got[1].run) == ("unknown", "node_1", 1)


def test_no_files(spark):
    with pytest.raises(ValueError):
        crawl_log.read_modes(spark, {})


def test_greedy_against_brute_force(spark):
    r = random.Random(3)
    edges = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(90)})
    kept = []
    for i in range(60):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    d = spark.createDataFrame([("g", a, b) for a, b in edges], "grp STRING, a BIGINT, b BIGINT")
    gone = {x.id for x in similarity.greedy_duplicates(d).collect()}
    assert gone == set(range(60)) - set(kept)


def test_greedy_without_edges(spark):
    assert similarity.greedy_duplicates(spark.createDataFrame([], "grp STRING, a BIGINT, b BIGINT")).count() == 0


def test_rate_limit(spark):
    r = random.Random(1)
    rows = [(i, f"http://h{r.randrange(3)}/", r.uniform(0, 10)) for i in range(50)]
    got = {x.seq: x.start for x in crawl_log.fetch_times(spark.createDataFrame(rows, "seq INT, url STRING, arrival DOUBLE"), 1.0).collect()}
    last: dict = {}
    for i, u, a in rows:
        last[u] = max(a, last[u] + 1.0) if u in last else a
        assert got[i] == pytest.approx(last[u])


def test_assignment_covers_all(spark):
    a = cluster.assignment(spark, ["b", "a", "c"]).collect()
    assert sorted(r.partition for r in a) == list(range(256)) and {r.node_id for r in a} == {"a", "b", "c"}
    assert cluster.assignment(spark, []).count() == 0


def test_thirty_seconds_are_neither(spark):
    d = spark.sql("SELECT timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:30' b, timestamp'2024-01-01 00:00:31' c")
    r = d.select(cluster.is_alive(F.col("a"), F.col("b")), cluster.is_dead(F.col("a"), F.col("b")), cluster.is_dead(F.col("a"), F.col("c"))).first()
    assert tuple(r) == (False, False, True)


def test_frontier_modes(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 3.0), ("a", 2, 9.0), ("c", 3, 3.0)], "url STRING, seq INT, priority DOUBLE")
    assert [r.url for r in frontier.mock(d).collect()] == ["b", "c", "a"]
    assert [r.url for r in frontier.mock(d, "bfs").collect()] == ["a", "b", "c"]
    for bad in (lambda: frontier.mock(d, "x"), lambda: frontier.top_k(d, 2, "bfs"), lambda: frontier.ordered(d, "x")):
        with pytest.raises(ValueError):
            bad()


def test_crawl_budget(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "src BIGINT, dst BIGINT")
    seeds = spark.range(1).select(F.col("id").alias("page"))
    assert {(r.page, r.depth) for r in crawl.crawl_bfs(e, seeds).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)}
    assert crawl.crawl_bfs(e, seeds, 3).count() == 3
    best = crawl.crawl_best_first(e, seeds, crawl.inbound_priority, 1, 4)
    assert [r.page for r in best.orderBy("round").collect()] == [0, 1, 2, 3]


def test_one_run_has_no_deviation(spark):
    d = spark.createDataFrame([("bfs", 1, True)], "mode STRING, run INT, is_relevant BOOLEAN")
    assert metrics.mean_std(d, F.avg(metrics.relevant())).count() == 0


def test_unfitted(spark):
    with pytest.raises(RuntimeError):
        semantic.predicted(spark.range(1), None, "x")


def test_auc_of_one_class(spark):
    d = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y INT, s DOUBLE")
    r = metrics.scored(d, "y", "s").first()
    assert r.roc_auc is None and (r.precision, r.recall, r.accuracy) == (1.0, 0.5, 0.5)


def test_latest_page_wins(spark):
    d = spark.createDataFrame([("u", 1.0, "a"), ("u", 2.0, "b"), ("v", 1.0, None)], "url STRING, fetch_time DOUBLE, text STRING")
    assert {(r.url, r.text) for r in crawl_log.latest_pages(d).collect()} == {("u", "b"), ("v", None)}


def test_robots_first_rule(spark):
    rules = spark.createDataFrame([("http://h", 1, "/a/ok", True), ("http://h", 2, "/a", False)], "origin STRING, rule_no INT, prefix STRING, allow BOOLEAN")
    u = spark.createDataFrame([("http://h/a/ok/1",), ("http://h/a/no",), ("http://h/b",), ("http://other/a",)], "url STRING")
    assert {r.url: r.allowed for r in crawl_log.allowed_by_robots(u, rules).collect()} == {"http://h/a/ok/1": True, "http://h/a/no": False, "http://h/b": True, "http://other/a": True}


def test_running_over_ranges(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(100)) for i in range(300)]
    got = running(spark.createDataFrame(rows, "k STRING, i INT, v BIGINT").repartition(5), "k", ["i"], {"s": F.col("v")}, {"m": F.col("v")}, {"p": F.col("v"), "q": -F.col("v")}).collect()
    assert len(got) == 300
    seen = {}
    for x in sorted(got, key=lambda x: x.i):
        own = seen.setdefault(x.k, [])
        assert (x.position, x.group_size) == (len(own), sum(k == x.k for k, *_ in rows))
        assert (x.p, x.q) == ((own[-1], -own[-1]) if own else (None, None))
        own.append(x.v)
        assert (x.s, x.m) == (sum(own), max(own))


def test_redundancy_of_a_log(spark):
    rows = [("bfs", 1, f"2024-01-01 00:00:{i:02d}", f"u{i}", t) for i, t in enumerate(["one two three four five six"] * 3 + ["seven eight nine ten eleven twelve", "short"])]
    rows += [("semantic", 1, "2024-01-01 00:00:00", "u", "one two three four five six")]
    d = spark.createDataFrame(rows, "mode STRING, run INT, timestamp STRING, url STRING, page_text STRING").withColumn("timestamp", F.to_timestamp("timestamp"))
    assert {r.mode: r.redundancy for r in metrics.redundancy(d).collect()} == {"bfs": 0.4, "semantic": 0.0}
    assert {r.mode: r.redundancy for r in metrics.redundancy(d.drop("page_text")).collect()} == {"bfs": 0.0, "semantic": 0.0}


def test_stratified_split(spark):
    d = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "id INT, y INT")
    train, test = semantic.split(d, "id", "y")
    assert train.count() == 160 and {r.y: r["count"] for r in test.groupBy("y").count().collect()} == {0: 36, 1: 4}


def test_drift_is_a_fold(spark):
    r = np.random.default_rng(0)
    vs = r.normal(size=(30, 4))
    d = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(vs)], "i INT, k INT, embedding ARRAY<DOUBLE>").repartition(3)
    start = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],)], "centroid ARRAY<DOUBLE>")
    for key in (0, 1):
        c, want = np.array([1.0, 0, 0, 0]), {}
        for n, v in enumerate(vs[key::2], 1):
            c = 0.95 * c + 0.05 * v
            c = c / (np.linalg.norm(c) + 1e-10)
            want[n] = c
        last = [x for x in semantic.drifted(d, start, "i", key="k").collect() if x.k == key]
        assert len(last) == 1 and last[0].n == 15 and last[0].centroid == pytest.approx(want[15].tolist())
        some = {x.n: x.centroid for x in semantic.drifted(d, start, "i", key="k", snapshots=[3, 10, 99]).collect() if x.k == key}
        assert sorted(some) == [3, 10] and some[10] == pytest.approx(want[10].tolist())
    assert semantic.drifted(d.limit(0), start, "i").count() == 0


def test_empty_batches_have_no_scores(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0])], "i INT, b BIGINT, embedding ARRAY<DOUBLE>")
    topic = spark.createDataFrame([([1.0, 0.0],)], "centroid ARRAY<DOUBLE>")
    got = {r.b: r.scores for r in semantic.score_batches(v, topic, "b", "i", batches=spark.range(2).withColumnRenamed("id", "b")).collect()}
    assert got == {0: [pytest.approx(1.0)], 1: []}


def test_principal_components(spark):
    x = np.random.default_rng(1).normal(size=(40, 5)) * [5, 3, 1, 0.5, 0.1]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i INT, e ARRAY<DOUBLE>")
    got = np.array([r.pca for r in semantic.projected(d, "e").orderBy("i").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = x @ axes[:2].T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)


def test_classifier_is_at_the_minimum(spark, tmp_path):
    """Half the squared weights and c times the losses: the gradient vanishes, and a stored model is the same."""
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 3))
    y = (x @ [1, -2, 0.5] + r.normal(size=80) > 0).astype(int)
    d = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "e ARRAY<DOUBLE>, y INT")
    m = semantic.fit(d, "e", "y", c=2.0)
    w, b = m.coefficients.toArray(), m.intercept
    off = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert w + 2.0 * x.T @ off == pytest.approx(np.zeros(3), abs=1e-3) and off.sum() == pytest.approx(0, abs=1e-3)
    semantic.save(m, f"{tmp_path}/m")
    assert semantic.load(f"{tmp_path}/m").coefficients.toArray() == pytest.approx(w)


def test_owners_are_read_anew_for_each_batch(spark, tmp_path):
    src, owners, out = (f"{tmp_path}/{x}" for x in ("src", "owners", "out"))
    where = cluster.assignment(spark, ["a"])
    where.write.parquet(owners)
    spark.createDataFrame([(f"u{i}",) for i in range(5)], "url STRING").write.parquet(src)
    stream = lambda: spark.readStream.schema("url STRING").parquet(src)
    streams.assigned_live(stream(), owners, "me", out).awaitTermination()
    cluster.assignment(spark, ["b"]).write.mode("overwrite").parquet(owners)
    spark.createDataFrame([(f"w{i}",) for i in range(5)], "url STRING").write.mode("append").parquet(src)
    streams.assigned_live(stream(), owners, "me", out).awaitTermination()
    got = {(r.url[0], r.node_id) for r in spark.read.schema("url STRING, node_id STRING").parquet(out).collect()}
    assert got == {("u", "a"), ("w", "b")}


def test_history_of_polls_is_bounded(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    row = spark.createDataFrame([("n", True, 5)], "node_id STRING, is_relevant BOOLEAN, bytes_downloaded BIGINT")
    row.write.parquet(src)
    q = streams.polled(streams.live_stats(spark.readStream.schema(row.schema).parquet(src)), out, every="100 milliseconds", keep=2)
    for _ in range(4):
        q.processAllAvailable()
        row.write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = {r.batch: r.pages_crawled for r in spark.read.parquet(out).collect()}
    assert len(got) == 2 and max(got.values()) == 5


def test_entry_without_the_operators(tmp_path):
    """The entry point imports without the operators' folders and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "siltweave", tmp_path / "siltweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1') for n in q); e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_moving_centroid_in_order_of_seq(spark, tmp_path):
    """Whatever files the vectors lie in, and over several batches and frames; a stream that isn't in order is refused."""
    r = np.random.default_rng(5)
    vs = r.normal(size=(400, 3))
    rows = [(i, "ab"[i % 3 > 0], v.tolist()) for i, v in enumerate(vs)]
    for part in (3, 1, 0, 2):  # neither the files' order nor their rows follow seq
        mine = [x for x in rows if x[0] % 4 == part][::-1]
        spark.createDataFrame(mine, "seq BIGINT, node_id STRING, embedding ARRAY<DOUBLE>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/v")
    want: dict = {}
    for _, k, v in rows:
        c = np.array(v) if k not in want else 0.95 * want[k] + 0.05 * np.array(v)
        want[k] = c / (np.linalg.norm(c) + 1e-10)
    root = f"{tmp_path}/out"

    def run(stream, name):
        out = streams.moving_centroid(stream)
        out.writeStream.foreachBatch(lambda df, b: df.withColumn("batch", F.lit(b)).write.parquet(f"{root}/{name}/b{b}")).outputMode("update").option("checkpointLocation", f"{root}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.option("recursiveFileLookup", True).schema("node_id STRING, centroid ARRAY<DOUBLE>, batch BIGINT").parquet(f"{root}/{name}")

    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        got = run(streams.ordered_source(spark, f"{tmp_path}/v", "seq", rows_per_file=80, files_per_batch=2), "ordered")
        assert got.agg(F.count_distinct("batch")).first()[0] == 3
        last = {x.node_id: x.c for x in got.groupBy("node_id").agg(F.max_by("centroid", "batch").alias("c")).collect()}
        assert {k: pytest.approx(v.tolist()) for k, v in want.items()} == last
        with pytest.raises(Exception, match="out of order"):
            run(streams.source(spark, f"{tmp_path}/v", 1), "files")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)


def test_exact_classes_against_brute_force(spark):
    """Classes and links, copies counted but never paired, over blocks of four sets; null texts and groups match nothing."""
    r = random.Random(8)
    rows = []
    for c in range(12):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([3, 6, 30, 60]))]
        for _ in range(r.choice([1, 3, 14])):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                t[r.randrange(len(t))] = f"w{r.randrange(300)}"
            rows += [(r.choice(["x", "x", "y"]), " ".join(t))] * r.choice([1, 1, 3])
    rows = [(g, 1000 + i, t) for i, (g, t) in enumerate(rows)] + [("x", 1, None), ("x", 2, None), (None, 3, rows[0][1]), (None, 4, rows[0][1]), ("y", 5, ""), ("y", 6, "")]

    def set_of(t):
        w = t.split(" ")
        return frozenset([t] if len(w) < 5 else [" ".join(w[i : i + 5]) for i in range(len(w) - 4)])

    sets = {i: (g, set_of(t)) for g, i, t in rows if g is not None and t is not None}
    near = {i: {j for j, (h, y) in sets.items() if j != i and g == h and len(x & y) / len(x | y) > 0.8} for i, (g, x) in sets.items()}
    want = {}
    for _, i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        want[i] = (min(seen), len(near.get(i, ())))
    d = spark.createDataFrame(rows, "g STRING, i BIGINT, t STRING")
    for block in (4, 256):
        got = {x.id: (x.class_id, x.links) for x in similarity.exact_classes(d, "i", "t", "g", block=block).collect()}
        assert got == want
    assert any(n > 8 for _, n in want.values())


def test_redundancy_keeps_no_signatures(spark, monkeypatch):
    """Working tables hold a digest and band hashes, not 128 values a row, and rows of one text are one."""
    seen = {}
    real = similarity.written
    monkeypatch.setattr(similarity, "written", lambda d, name, **k: seen.setdefault(name, real(d, name, **k)))
    d = spark.createDataFrame([("g", i, t) for i, t in enumerate(["a b c d e f"] * 4 + ["p q r s t u"])], "g STRING, i BIGINT, t STRING")
    r = similarity.redundancy(d, "i", "t", "g", short=True).first()
    assert (r.total, r.duplicates) == (5, 3)
    assert seen["distinct-texts"].count() == 2
    assert "signatures" not in seen and dict(seen["distinct-signatures"].dtypes)["sig"] == "binary"
