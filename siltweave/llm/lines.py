"""Reversible line dedup: sharded cuckoo filters backed by exact reference tables.

A line's first holder, in order of batch, document, and place, keeps it; all other
holders lose it. The store has four tables, each a log of generations:

* ``docs``: every document that was inserted or deleted;
* ``refs``: every (line hashes, document, place) that was inserted or deleted, exact;
* ``counts``: reference counts of the lines of each generation, negative for deletions;
* ``filters``: by shard of the hash space, a cuckoo filter of the lines referred to.

A batch probes the filters first. Lines they don't know are certainly new; only the
others are looked up in the counts, which are cut down to them before anything is added up. Deleting documents takes the
references of earlier generations away, and lines left without any leave the filter, so that ``holders`` then gives what
inserting the other documents alone would have given, and a document may be inserted again. Every ``fan_out`` generations
the counts are merged into one, and the shards are doubled when there are more than ``per_shard`` lines in each.

Defined results: a null text stays null and an empty one empty; blank lines are kept
always; a document that loses all its lines has an empty text; rows equal in id and text
are one document and have one result; a document that is in force already, as in a batch that is run again, adds nothing and
gets the lines that it holds; rows with one id and several texts are told apart
by the text; null ids come first; ids are of any type that has an order, and a table is cut into batches only if they are numbers;
an empty batch changes nothing; extra columns, of any names, pass
through ``dedup_batch``, a column named lines_dropped is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

from siltweave.llm.text import U, column, free, mix
from siltweave.session import shared_folder

SHARDS, PER_SHARD, FAN_OUT = 64, 4_000_000, 8
SLOTS_PER_BUCKET = 4
LOAD = 0.5
_REFS = "h BIGINT, v BIGINT, doc_id {id}, row_id BIGINT, line_no INT, gen INT, sign INT"
_DOCS = "doc_id {id}, row_id BIGINT, gen INT, sign INT"
_KEYS = "h BIGINT, v BIGINT, n BIGINT"


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; each has two buckets it may lie in."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def sized(cls, n: int) -> "CuckooFilter":
        need = max(1, int(n / (SLOTS_PER_BUCKET * LOAD)))
        return cls(np.zeros((1 << (need - 1).bit_length(), SLOTS_PER_BUCKET), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS_PER_BUCKET).copy())

    def dump(self) -> bytes:
        return self.buckets.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = mix(keys.astype(np.int64).view(U))
        fp = np.maximum((k >> U(48)).astype(np.uint16), 1)
        i = (k & U(len(self.buckets) - 1)).astype(np.int64)
        return fp, i, self._other(i, fp)

    def _other(self, i: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return i ^ (mix(fp.astype(U)) & U(len(self.buckets) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, i, j = self._places(keys)
        return ((self.buckets[i] == fp[:, None]) | (self.buckets[j] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray, rounds: int = 200) -> bool:
        """Insert all keys, a key twice if given twice; False when there is no room (then rebuild larger)."""
        fp, i, j = self._places(keys)
        rng = np.random.default_rng(len(keys))
        tried = np.zeros(len(fp), bool)
        for _ in range(rounds):
            if not len(fp):
                return True
            # one newcomer per bucket and round takes a free place
            order = np.unique(i, return_index=True)[1]
            free = self.buckets[i[order]] == 0
            has = free.any(axis=1)
            win = order[has]
            self.buckets[i[win], free[has].argmax(axis=1)] = fp[win]
            lost = order[~has]
            second = lost[~tried[lost]]
            kick = lost[tried[lost]]
            i[second] = self._other(i[second], fp[second])
            tried[second] = True
            if len(kick):  # it takes a random place, and who lay there moves on
                at = rng.integers(0, SLOTS_PER_BUCKET, len(kick))
                out = self.buckets[i[kick], at].copy()
                self.buckets[i[kick], at] = fp[kick]
                fp[kick] = out
                i[kick] = self._other(i[kick], out)
            rest = np.ones(len(fp), bool)
            rest[win] = False
            fp, i, tried = fp[rest], i[rest], tried[rest]
        return not len(fp)

    def delete(self, keys: np.ndarray) -> None:
        """Remove one fingerprint per key; the keys must have been inserted."""
        for fp, i, j in zip(*(x.tolist() for x in self._places(keys))):
            for b in (i, j):
                hit = np.flatnonzero(self.buckets[b] == fp)
                if len(hit):
                    self.buckets[b, hit[0]] = 0
                    break


def built(keys: np.ndarray, room: int = 0) -> CuckooFilter:
    """A filter of the keys with room for more."""
    n = max(len(keys), room)
    while True:
        f = CuckooFilter.sized(n)
        if f.insert(keys):
            return f
        n = 2 * max(n, 1)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, v, doc_id, row_id, line_no): two 64-bit hashes of each line; v is null for a blank one."""
    d = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).filter("text IS NOT NULL")
    d = d.select("doc_id", F.xxhash64("doc_id", "text").alias("row_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    blank = F.trim(F.translate("line", "\t\r\x0b\x0c", "    ")) == ""
    h = F.when(blank, F.xxhash64("row_id", "line_no")).otherwise(F.xxhash64("line"))
    v = F.when(~blank, F.xxhash64(F.lit("line"), "line"))
    return d.select(h.alias("h"), v.alias("v"), "doc_id", "row_id", "line_no")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_id"] == b["row_id"])


class LineStore:
    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = SHARDS, per_shard: int = PER_SHARD, fan_out: int = FAN_OUT):
        self.spark, self.shards, self.per_shard, self.fan_out = spark, shards, per_shard, fan_out
        self.path = path or f"{shared_folder(spark)}/lines-{uuid.uuid4().hex[:8]}"
        self.generation, self.id_type, self.lines = 0, "bigint", 0
        self.merged = 0  # the counts of generations up to this one are in one table

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _log(self, name: str, schema: str) -> DataFrame:
        schema = schema.format(id=self.id_type)
        if not self.generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{g}" for g in range(1, self.generation + 1)])

    @staticmethod
    def _in_force(log: DataFrame) -> DataFrame:
        """The rows that no later generation deleted; a deletion acts on what was there before it only."""
        gone = log.filter("sign < 0").groupBy("doc_id", "row_id").agg(F.max("gen").alias("until"))
        keep = log.filter("sign > 0")
        return keep.join(gone, _same(keep, gone) & (keep["gen"] < gone["until"]), "left_anti")

    def refs(self) -> DataFrame:
        """References in force: those of deleted documents are taken away."""
        return self._in_force(self._log("refs", _REFS))

    def documents(self) -> DataFrame:
        """(doc_id, row_id, gen) of the documents in force."""
        return self._in_force(self._log("docs", _DOCS))

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """(h, v, n): exact numbers of references of all lines with any, or of those among the keys (h, v)."""
        parts = ([f"{self.path}/merged/{self.merged}"] if self.merged else []) + [f"{self.path}/counts/{g}" for g in range(self.merged + 1, self.generation + 1)]
        c = self.spark.read.schema(_KEYS).parquet(*parts) if parts else self.spark.createDataFrame([], _KEYS)
        if keys is not None:
            c = c.join(keys.select("h", "v"), ["h", "v"], "left_semi")
        return c.groupBy("h", "v").agg(F.sum("n").alias("n")).filter("n > 0")

    def _shard(self) -> Column:
        return F.pmod("h", F.lit(self.shards)).cast("int").alias("shard")

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard INT, raw BINARY").parquet(f"{self.path}/filters/{self.generation}")

    def _probe(self, keys: DataFrame) -> DataFrame:
        """The keys that the filters may know."""

        def run(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            return rows[CuckooFilter.load(filters.raw[0]).contains(rows.h.to_numpy())][["h", "v"]] if len(filters) and len(rows) else rows[:0][["h", "v"]]

        return keys.select(self._shard(), "h", "v").groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(run, "h BIGINT, v BIGINT")

    def _filtered(self, added: DataFrame | None, removed: DataFrame | None, counts: DataFrame, more: int) -> None:
        """Write the filters after adding and removing keys, ``more`` on balance.

        A full one is rebuilt, with the counts as they were and the added keys; so are all, over more shards, when the lines pass what these are meant for.
        """
        g = self.generation + 1
        if self.lines + more > self.shards * self.per_shard:
            while self.lines + more > self.shards * self.per_shard:
                self.shards *= 2
            every = added.select(self._shard(), "h")
            self._write(self._rebuilt(every.unionByName(counts.select(self._shard(), "h")) if self.generation else every), f"filters/{g}")
            return
        change = None
        for d, s in ((added, 1), (removed, -1)):
            if d is not None:
                x = d.select(self._shard(), "h", F.lit(s).alias("s"))
                change = x if change is None else change.unionByName(x)
        if not self.generation:
            self._write(self._rebuilt(change), f"filters/{g}")
            return

        def run(rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            shard = rows.shard[0] if len(rows) else old.shard[0]
            f = CuckooFilter.load(old.raw[0]) if len(old) else CuckooFilter.sized(len(rows))
            f.delete(rows.h[rows.s < 0].to_numpy())
            more = rows.h[rows.s > 0].to_numpy()
            used = int(np.count_nonzero(f.buckets))
            full = used + len(more) > 0.9 * f.buckets.size or not f.insert(more)
            return pd.DataFrame({"shard": [shard], "raw": [None if full else f.dump()]})

        made = change.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(run, "shard INT, raw BINARY")
        made = self._write(made, f"filters-tried/{g}")
        full = made.filter("raw IS NULL").select("shard")
        if not full.isEmpty():
            again = counts.select(self._shard(), "h")
            again = again.unionByName(added.select(self._shard(), "h")) if added is not None else again
            rebuilt = self._rebuilt(again.join(F.broadcast(full), "shard", "left_semi"))  # a row per shard
            made = made.filter("raw IS NOT NULL").unionByName(rebuilt)
        self._write(made, f"filters/{g}")

    def _rebuilt(self, keys: DataFrame) -> DataFrame:
        def build(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [rows.shard[0]], "raw": [built(rows.h.to_numpy(), room=3 * len(rows) // 2).dump()]})

        return keys.select("shard", "h").groupBy("shard").applyInPandas(build, "shard INT, raw BINARY")

    def _settle(self, more: int) -> None:
        """End a generation, and merge the counts on schedule."""
        self.generation += 1
        self.lines += more
        if self.generation - self.merged >= self.fan_out:
            self.compact()

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; (doc_id, row_id, keep) of its documents that lose lines, keep being a flag for each line."""
        g = self.generation + 1
        self.id_type = docs.schema[id_col].dataType.simpleString()
        docs = docs.dropDuplicates([id_col, text_col]) if self._repeats(docs, id_col) else docs
        mine = docs.filter(column(text_col).isNotNull()).select(column(id_col).alias("doc_id"), F.xxhash64(column(id_col), column(text_col)).alias("row_id"))
        known_docs = None
        if self.generation:
            old = self.documents()
            known_docs = self._write(mine.join(old, _same(mine, old), "left_semi"), f"known/{g}")
            if known_docs.isEmpty():
                known_docs = None
        refs = lines_of(docs, id_col, text_col)
        if known_docs is not None:
            refs, mine = refs.join(known_docs, _same(refs, known_docs), "left_anti"), mine.join(known_docs, _same(mine, known_docs), "left_anti")
        self._write(mine.select("*", F.lit(g).alias("gen"), F.lit(1).alias("sign")), f"docs/{g}")
        refs = self._write(refs.select("*", F.lit(g).alias("gen"), F.lit(1).alias("sign")), f"refs/{g}")
        keys = refs.filter("v IS NOT NULL").groupBy("h", "v").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_id", "line_no")).alias("first"))
        keys = self._write(keys, f"keys/{g}")
        if self.generation:
            known = self._write(self.counts(self._write(self._probe(keys), f"maybe/{g}")).select("h", "v"), f"present/{g}")
            shared = keys.join(known.withColumn("known", F.lit(True)), ["h", "v"], "left").filter("known OR n > 1").select("h", "v", F.when(F.col("known").isNull(), F.col("first")).alias("first"))
            fresh = keys.join(known, ["h", "v"], "left_anti")
            more = keys.count() - known.count()
        else:
            shared, fresh, more = keys.filter("n > 1").select("h", "v", "first"), keys, keys.count()
        shared = shared.withColumn("hit", F.lit(True))
        flagged = refs.join(shared, ["h", "v"], "left").withColumn("keep", F.col("hit").isNull() | F.struct("doc_id", "row_id", "line_no").eqNullSafe(F.col("first"))).select("doc_id", "row_id", "line_no", "keep")
        if known_docs is not None:
            flagged = flagged.unionByName(self._held(known_docs))
        out = flagged.groupBy("doc_id", "row_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "keep"))).getField("keep").alias("keep"), F.min("keep").alias("all")).filter("NOT all").drop("all")
        out = self._write(out, f"decided/{g}")
        self._filtered(fresh, None, self.counts(), more)
        self._write(keys.select("h", "v", "n"), f"counts/{g}")
        self._settle(more)
        return out

    def _held(self, docs: DataFrame) -> DataFrame:
        """(doc_id, row_id, line_no, keep) of documents in force, by what they hold now."""
        r = self.refs()
        mine = r.join(docs, _same(r, docs), "left_semi")
        rivals = r.filter("v IS NOT NULL").join(mine.select("h", "v").distinct(), ["h", "v"], "left_semi")
        first = rivals.groupBy("h", "v").agg(F.min(F.struct("gen", "doc_id", "row_id", "line_no")).alias("f"))
        held = F.col("v").isNull() | F.struct("gen", "doc_id", "row_id", "line_no").eqNullSafe(F.col("f"))
        return mine.join(first, ["h", "v"], "left").select("doc_id", "row_id", "line_no", held.alias("keep"))

    @staticmethod
    def _repeats(docs: DataFrame, id_col: str) -> bool:
        """Whether an id occurs twice; the shuffle of whole texts that repeats need is spared otherwise."""
        return not docs.groupBy(column(id_col)).count().filter("count > 1").isEmpty()

    def delete(self, ids: DataFrame) -> None:
        """Take documents out; ids has a column doc_id."""
        g = self.generation + 1
        gone = ids.select(F.col("doc_id").alias("gone")).distinct()
        d, r = self.documents(), self.refs()
        self._write(d.join(gone, d["doc_id"].eqNullSafe(gone["gone"]), "left_semi").select("doc_id", "row_id", F.lit(g).alias("gen"), F.lit(-1).alias("sign")).distinct(), f"docs/{g}")
        r = r.join(gone, r["doc_id"].eqNullSafe(gone["gone"]), "left_semi")
        minus = self._write(r.select("h", "v", "doc_id", "row_id", "line_no", F.lit(g).alias("gen"), F.lit(-1).alias("sign")), f"refs/{g}")
        minus = self._write(minus.filter("v IS NOT NULL").groupBy("h", "v").agg((-F.count("*")).alias("n")), f"counts/{g}")
        dead = self._write(minus.join(self.counts(minus).withColumnRenamed("n", "had"), ["h", "v"]).filter("had + n <= 0").select("h", "v"), f"dead/{g}")
        less = -dead.count()
        self._filtered(None, dead, self.counts(), less)
        self._settle(less)

    def holders(self) -> DataFrame:
        """(doc_id, row_id, line_no) of all lines that are kept now, in force of all insertions and deletions."""
        r = self.refs()
        first = r.filter("v IS NOT NULL").groupBy("h", "v").agg(F.min(F.struct("gen", "doc_id", "row_id", "line_no")).alias("f")).select("f.doc_id", "f.row_id", "f.line_no")
        return first.unionByName(r.filter("v IS NULL").select("doc_id", "row_id", "line_no"))

    def compact(self) -> None:
        """Merge the generations of the counts into one."""
        self._write(self.counts(), f"merged/{self.generation}")
        self.merged = self.generation


def dedup_batch(store: LineStore, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert docs and return them without the lines that others held first, with lines_dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "lines_dropped" and c not in (id_col, text_col)])
    key, row, keep = (free(docs, n) for n in ("id_", "row_", "keep_"))
    flags = store.insert(docs, id_col, text_col).select(F.col("doc_id").alias(key), F.col("row_id").alias(f"{row}2"), F.col("keep").alias(keep))
    cols = docs.columns
    d = docs.withColumn(row, F.xxhash64(column(id_col), column(text_col)))
    d = d.join(flags.hint("merge"), d[f"`{id_col}`"].eqNullSafe(flags[key]) & (d[row] == flags[f"{row}2"]), "left")
    kept = F.array_join(F.filter(F.split(column(text_col), "\n"), lambda x, i: F.get(F.col(keep), i)), "\n")
    text = F.when(F.col(keep).isNull(), column(text_col)).otherwise(kept)
    dropped = F.when(F.col(keep).isNull(), 0).otherwise(F.size(F.filter(keep, lambda k: ~k)))
    return d.select(*[text.alias(c) if c == text_col else column(c).alias(c) for c in cols], dropped.alias("lines_dropped"))


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, shards: int = SHARDS) -> DataFrame:
    """Dedup a table in batches, ranges of its ids, against an empty store."""
    store = LineStore(spark, shards=shards)
    out = None
    for part in id_ranges(docs, id_col, batches):
        done = dedup_batch(store, part, id_col, text_col)
        out = done if out is None else out.unionByName(done)
    return out


def id_ranges(docs: DataFrame, id_col: str, n: int) -> Iterator[DataFrame]:
    """Split by equal ranges of a numeric id, nulls in the first; other ids are one range."""
    if n < 2 or not isinstance(docs.schema[id_col].dataType, NumericType):
        yield docs
        return
    lo, hi = docs.agg(F.min(column(id_col)), F.max(column(id_col))).first()
    if lo is None:
        yield docs
        return
    at = F.coalesce(F.least(F.lit(n - 1), F.floor((column(id_col) - lo) * F.lit(float(n)) / F.lit(float(hi - lo + 1)))), F.lit(0))
    for i in range(n):
        yield docs.filter(at == i)
