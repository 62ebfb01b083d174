"""Substring dedup by a log-structured index of window fingerprints.

A passage is a run of WORDS (50) words. Each has a fingerprint: the least hash among its 26 windows
of K (25) words, so equal passages have equal fingerprints wherever they stand, and neighbouring
passages mostly share one. The fingerprints of a batch of documents form a run: a table that is
bucketed and sorted by fingerprint and never changed. A new batch's run is merge-joined,
bucket by bucket, without a shuffle or a sort, with every historical run; runs are compacted into one, and the old ones removed, when
there are more than ``fan_out``. Fingerprints that occur twice name candidates, old and new, and these
are verified: all their passages of 50 words are compared as a whole, by two independent 64-bit
hashes. A passage is repeated if its words stand at an earlier place, in order of batch, document, and word.

The index keeps each batch's texts, bucketed and sorted by document, so that candidates find theirs without moving any other, and of
the historical batches only those with candidates are read. A manifest lists runs and texts, and an index is opened again by its path.

So every repeated passage of 50 words or more is found, of any number of holders, and nothing else.

Defined results: null, empty and short texts (under 50 words) have no passages; documents with
null ids are passed over; ids are of any type that has an order; rows of a batch that share an id are laid over each other as one document, so
repeated rows change nothing; passages repeated within a document count as well; an empty batch adds an
empty run; other columns are not read, so their names can't clash, and pass through ``cut_spans``, whatever they are called.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from siltweave.llm.lines import id_ranges
from siltweave.llm.text import U, column, free, pieces, place, utf8, window_hashes, with_arrow, word_hashes, words
from siltweave.session import delete_path, shared_folder, written

WORDS, K = 50, 25
BUCKETS, FAN_OUT = 64, 4
HOT = 100_000  # windows with one fingerprint beyond which its passages are matched by an aggregate and a join
_BASES = (0xD1B54A32D192ED03, 0xA0761D6478BD642F)


def fingerprints(h: np.ndarray, n_words: int = WORDS, k: int = K) -> np.ndarray:
    """The fingerprint of the passage from each hash of k words on; the caller drops those over row bounds."""
    if len(h) < n_words - k + 1:
        return np.zeros(0, U)
    # the least of each n_words - k + 1 neighbours, by doubling
    span, size = n_words - k + 1, 1
    while 2 * size <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = span - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _run(batches: Iterator[pa.RecordBatch], n_words: int, k: int) -> Iterator[pa.RecordBatch]:
    """(h, doc_id, n): the fingerprints of each document, with the number of its windows that have each."""
    for b in batches:
        data, off = utf8(b.column(1))
        hs, ds, ns = [], [], []
        for lo, hi in pieces(off):
            part = data[off[lo] : off[hi]]
            s, e, at = words(part, off[lo : hi + 1] - off[lo])
            windows = window_hashes(word_hashes(part, s, e), k)
            f = fingerprints(windows, n_words, k)
            for i in np.flatnonzero(np.diff(at) >= n_words).tolist():
                x = f[at[i] : at[i + 1] - n_words + 1]
                u = np.unique(x[np.concatenate([[True], x[1:] != x[:-1]])])
                own = np.sort(windows[at[i] : at[i + 1] - k + 1])
                hs.append(u)
                ns.append((np.searchsorted(own, u, "right") - np.searchsorted(own, u)).astype(np.int32))
                ds.append(np.full(len(u), lo + i))
        cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
        yield pa.RecordBatch.from_arrays([pa.array(cat(hs, U).view(np.int64)), b.column(0).take(pa.array(cat(ds, np.int64))), pa.array(cat(ns, np.int32))], ["h", "doc_id", "n"])


def _passages(batches: Iterator[pa.RecordBatch], n_words: int, k: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, g, pos, hot) of all passages of a document whose fingerprint is one of its candidates."""
    for b in batches:
        data, off = utf8(b.column("text"))
        lists, hots = b.column("hs"), b.column("hot")
        for lo, hi in pieces(off, 1 << 19):
            part = data[off[lo] : off[hi]]
            s, e, at = words(part, off[lo : hi + 1] - off[lo])
            w = word_hashes(part, s, e)
            f = fingerprints(window_hashes(w, k), n_words, k)
            out: list[tuple] = []
            for i in np.flatnonzero(np.diff(at) >= n_words).tolist():
                x = f[at[i] : at[i + 1] - n_words + 1]
                want = np.sort(lists[lo + i].values.to_numpy().view(U))
                p = np.searchsorted(want, x)
                p[p == len(want)] = 0
                pos = np.flatnonzero(want[p] == x)
                if len(pos):
                    out.append((pos + at[i], pos.astype(np.int32), np.full(len(pos), lo + i), np.isin(x[pos], hots[lo + i].values.to_numpy().view(U))))
            if out:
                g, pos, d, hot = (np.concatenate(c) for c in zip(*out))
                h = [window_hashes(w, n_words, base)[g].view(np.int64) for base in _BASES]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), b.column("doc_id").take(pa.array(d)), b.column("g").take(pa.array(d)), pa.array(pos), pa.array(hot)], ["h1", "h2", "doc_id", "g", "pos", "hot"])


def _spans(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    """Consecutive passages in (doc_id, first_doc_id, shift, places) become spans of words."""
    for b in batches:
        out = []
        for d, f, shift, pos in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            p = np.sort(pos.values.to_numpy())
            cut = np.flatnonzero(np.diff(p) > 1)
            for a, z in zip(p[np.concatenate([[0], cut + 1])].tolist(), p[np.append(cut, len(p) - 1)].tolist()):
                out.append((d, a, z + n_words, f, a - shift))
        cols = list(zip(*out)) or [()] * 5
        kinds = [b.column(0).type, pa.int32(), pa.int32(), b.column(0).type, pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "start", "end", "first_doc_id", "first_start"])


@contextmanager
def _in_order(spark: SparkSession):
    """Within, bucketed tables of one file a bucket are read in the order that they were sorted in."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class FingerprintIndex:
    """The runs of all batches so far, and their texts. A path that holds an index opens it, with its own settings."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, fan_out: int = FAN_OUT, n_words: int = WORDS, k: int = K, hot: int = HOT):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex[:8]}"
        self.state = {"buckets": max(buckets, 1), "fan_out": fan_out, "n_words": n_words, "k": k, "hot": hot, "generation": 0, "id": "bigint", "runs": [], "texts": {}}
        self.version = 0
        self._open()

    @property
    def runs(self) -> list[str]:
        return self.state["runs"]

    def _open(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(where):
            self.version = max((int(x.getPath().getName()) for x in fs.listStatus(where) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))), default=0)
        if self.version:
            self.state = json.loads(self.spark.read.text(f"{self.path}/manifest/{self.version}").first()[0])

    def _commit(self) -> None:
        """The state as a new version of the manifest; what isn't in the last one doesn't count."""
        self.version += 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self.version}")

    def _table(self, name: str, key: str, schema: str) -> DataFrame:
        """A stored table with its buckets, whether this session has seen it before or not."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _store(self, df: DataFrame, kind: str, key: str) -> str:
        """Write a table, one sorted file a bucket."""
        name, n = f"{kind}_{uuid.uuid4().hex[:12]}", self.state["buckets"]
        df.repartition(n, key).sortWithinPartitions(key).write.bucketBy(n, key).sortBy(key).option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self._table(name, "h", f"h BIGINT, doc_id {self.state['id']}, n INT, g INT")

    def _texts(self, g: int) -> DataFrame:
        return self._table(self.state["texts"][str(g)], "doc_id", f"doc_id {self.state['id']}, text STRING").withColumn("g", F.lit(g))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; the spans of its documents that repeat an earlier place.

        (doc_id, start, end, first_doc_id, first_start): words start to end, half-open, stand at first_start in first_doc_id.
        """
        with _in_order(self.spark):
            return self._add(docs, id_col, text_col)

    def _add(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        st = self.state
        n_words, k = st["n_words"], st["k"]
        g = st["generation"] = st["generation"] + 1
        d = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
        kind = st["id"] = d.schema["doc_id"].dataType.simpleString()
        name = self._store(d.mapInArrow(lambda it: _run(it, n_words, k), f"h BIGINT, doc_id {kind}, n INT").distinct().withColumn("g", F.lit(g)), "run", "h")
        st["texts"][str(g)] = self._store(d, "texts", "doc_id")
        new = self._run(name)
        total = new.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
        hit = total.select("h")
        often = total.filter(F.col("n") > st["hot"])
        zones, before = None, []
        if st["runs"]:
            old = None
            for r in st["runs"]:
                s = self._run(r).join(new.select("h").hint("merge"), "h", "left_semi").select("h", "doc_id", "g")
                old = s if old is None else old.unionByName(s)
            zones = old = written(old, "history")
            hit = hit.unionByName(old.select("h")).distinct()
            often = often.unionByName(old.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > st["hot"]))
            before = sorted(r["g"] for r in old.select("g").distinct().collect())  # a row a batch
        mine = new.join(hit.hint("merge"), "h", "left_semi").select("h", "doc_id", "g")
        zones = mine if zones is None else zones.unionByName(mine)
        often = written(often.select("h").distinct(), "often")
        some = not often.isEmpty()
        mark = F.col("often") if some else F.lit(None).cast("boolean")
        zones = zones.join(often.withColumn("often", F.lit(True)), "h", "left") if some else zones
        zones = written(zones.groupBy("doc_id", "g").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(mark, F.col("h"))).alias("hot")), "zones")
        p = None
        for b in [*before, g]:
            near = zones.filter(F.col("g") == b).select("doc_id", "hs", "hot").hint("merge")
            x = self._texts(b).join(near, "doc_id").select("doc_id", "g", "text", "hs", "hot").mapInArrow(lambda it: _passages(it, n_words, k), f"h1 BIGINT, h2 BIGINT, doc_id {kind}, g INT, pos INT, hot BOOLEAN")
            p = x if p is None else p.unionByName(x)
        # a window, not an aggregate, since its shuffle carries bare rows and a passage of many holders spills
        earlier = W.partitionBy("h1", "h2").orderBy("g", "doc_id", "pos").rowsBetween(W.unboundedPreceding, 0)
        place_ = ("g", "doc_id", "pos")
        if some:  # a passage of very many holders would be one task's window; its first place is joined back instead, which Spark can split
            p = written(p, "passages", codec="zstd")
            least = p.filter("hot").groupBy("h1", "h2").agg(F.min(F.struct(*place_)).alias("f"))
            joined = p.filter("hot").join(least, ["h1", "h2"]).select(*place_, *[F.col(f"f.{c}").alias(f"first_{c}") for c in place_])
            p = p.filter("NOT hot")
        first = p.select(*place_, *[F.first(c).over(earlier).alias(f"first_{c}") for c in place_])
        first = first.unionByName(joined) if some else first
        pairs = first.filter((F.col("g") == g) & ((F.col("first_g") < g) | (F.col("first_doc_id") != F.col("doc_id")) | (F.col("first_pos") != F.col("pos"))))
        pairs = pairs.select("doc_id", "first_doc_id", (F.col("pos") - F.col("first_pos")).alias("shift"), "pos")
        lined = pairs.groupBy("doc_id", "first_doc_id", "shift").agg(F.collect_list("pos").alias("places"))
        out = written(lined.mapInArrow(lambda it: _spans(it, n_words), f"doc_id {kind}, start INT, end INT, first_doc_id {kind}, first_start INT"), "spans")
        st["runs"] = [*st["runs"], name]
        self._commit()
        if len(st["runs"]) > st["fan_out"]:
            self.compact()
        return out

    def compact(self) -> None:
        """Merge all runs into one, and remove the old ones once the manifest names the new one."""
        old = self.state["runs"]
        if len(old) < 2:
            return
        merged = self._run(old[0])
        for r in old[1:]:
            merged = merged.unionByName(self._run(r))
        self.state["runs"] = [self._store(merged, "run", "h")]
        self._commit()
        for r in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            delete_path(self.spark, f"{self.path}/{r}")

    def forget(self) -> None:
        """Take the tables out of the session's catalog; the index can be opened again by its path."""
        for r in [*self.state["runs"], *self.state["texts"].values()]:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, hot: int = HOT) -> DataFrame:
    """The spans of a table that is added in batches, ranges of its ids, to an empty index, which is compacted in the end and then removed."""
    index = FingerprintIndex(spark, buckets=max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))), hot=hot)
    out = None
    for part in id_ranges(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), "doc_id", batches):
        spans = index.add(part)
        out = spans if out is None else out.unionByName(spans)
    index.compact()
    index.forget()
    delete_path(spark, index.path)
    return out


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the words of their spans; other words and what parts them stay."""
    key, cuts = free(docs, "id_"), free(docs, "spans_")
    s = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    d = docs.join(s, column(id_col) == column(key), "left").drop(key)
    names = [c for c in d.columns if c != cuts]
    at, sp = place(d, text_col, []), place(d, cuts, [])

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        texts = b.column(at).to_pylist()
        for i, own in enumerate(b.column(sp).to_pylist()):
            if texts[i] is None or not own:
                continue
            raw = texts[i].encode()
            starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            keep = np.ones(len(raw), bool)
            for c in own:
                hi = min(c["end"], len(ends))
                if c["start"] < hi:
                    keep[starts[c["start"]] : starts[hi] if hi < len(starts) else ends[hi - 1]] = False
            texts[i] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
        cols = list(b.columns)
        cols[at] = pa.array(texts, cols[at].type)
        return [c for i, c in enumerate(cols) if i != sp]

    return with_arrow(d, make, [], keep=names)
