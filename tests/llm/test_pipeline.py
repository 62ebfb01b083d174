"""The pipeline's stages, each against a brute-force version of it on the stage's own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from siltweave.llm import bpe, packing, pii, quality
from siltweave.session import written
from tests.llm.common import ODD, documents, prose, words_of
from tests.llm.test_text_operators import brute_lines, brute_pairs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, inputs = {}, {}
    for name, stage in pipeline.STAGES:
        inputs[name] = docs
        docs = out[name] = written(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == inputs[name].columns
    model = quality.train(inputs["quality"], quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet")))
    import numpy as np

    kept = set()
    for i, t in rows(inputs["quality"]):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        idx, val, says = quality.features(raw)
        if model.tails(np.array([(model.weights[idx] * val).sum() - says @ model.means]))[0, 1] >= 0.5:
            kept.add(i)
    assert {i for i, _ in rows(out["quality"])} == kept
    before = dict(rows(inputs["lines"]))
    want = {i: t for i, t in brute_lines(list(before.items())).items() if t == before[i] or words_of(t)}
    assert dict(rows(out["lines"])) == want
    pairs = brute_pairs(rows(inputs["near"]))
    group = {i: i for i, _ in rows(inputs["near"])}
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    first = {i for i, g in group.items() if i == g}
    left = {i for i, _ in rows(out["near"])}
    assert first <= left and len(left - first) <= 0.1 * (len(group) - len(first))
    crf = pii.trained()
    for i, t in rows(inputs["pii"]):
        new, last = "", 0
        for a, b, kind in crf.decode(t or ""):
            new, last = new + t[last:a] + f"[{kind}]", b
        assert dict(rows(out["pii"]))[i] == (t if t is None else new + t[last:])
        if i > 60:
            break
    size = {}
    for r in out["packing"].collect():
        size[r.bin_id] = size.get(r.bin_id, 0) + r.size
    assert max(v for k, v in size.items() if k) <= packing.CAPACITY
    e = bpe.encoder_at(bpe.VOCABULARY)
    assert sum(size.values()) == sum(len(e.encode(t or "")) for _, t in rows(inputs["packing"]))


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = documents(spark, ODD + [(200 + i, prose(i, 60)) for i in range(6)] + [(300, prose(0, 60)), (None, None)])
    extra = docs.withColumns({c: F.lit(1) for c in ("gone", "keep", "spans", "lines_dropped", "n_tokens", "a.b")})
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for table in (extra, extra.limit(0)):
        table = written(table, "odd")
        n = table.count()
        for name, stage in pipeline.STAGES:
            out = written(stage(spark, table, str(tmp_path)), f"odd-{name}")
            if name != "packing":
                assert out.columns == pipeline.COLUMNS
            if name in ("quality", "pii", "packing"):
                assert out.count() >= n
            if name == "near" and n:
                assert sorted({r.doc_id or -1 for r in table.collect()} - {r.doc_id or -1 for r in out.collect()}) == [300]
            assert (out.count() > 0) == (n > 0)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0
