"""Join of documents whose sets of word n-grams have a Jaccard similarity of a threshold at least.

A document's set is that of the hashes of its n-word windows (of the whole text where it
has fewer words). Equal sets are one entity, so exact copies cost nothing further.
MinHash bands give candidate pairs. Their MinHash values are then compared a few at a
time; with a uniform prior on the similarity, a pair is dropped as soon as the posterior
probability that it reaches the threshold is below ``tolerance``. What is left is verified
on the sets themselves.

With 36 bands of 4 values a pair at the threshold 0.5 is a candidate with probability
0.90, one at 0.6 with 0.99. There is no cap on the entities of a bucket or on the partners of
one: a large bucket is cut into blocks, and pairs of blocks are spread over the tasks. For
comparing, candidates lie in tiles, pairs of blocks of entities that have a smallest bucket
neighbour in common, so that a signature or text goes to a tile once, not once a pair.

Defined results: null, empty and white-space texts and null ids match nothing, and are classes of their own in
``classes``; rows equal in id and text are one document; rows of one id with several texts are several entities,
whose pairs may name the id twice; ids are of any type that has an order; a text shorter than n words matches only
the same words; an empty table gives no pairs and no classes; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltweave.llm.text import U, column, free, mix, pieces, utf8, window_hashes, word_hashes, words
from siltweave.session import written

N, THRESHOLD, TOLERANCE = 3, 0.5, 0.001
BANDS, ROWS, STEP = 36, 4, 16
BLOCK, GROUP = 256, 2000
HASHES = BANDS * ROWS
_A = mix(np.arange(1, HASHES + 1, dtype=U)) | U(1)
_SIGNED = "doc_id {id}, h BIGINT, n INT, sig BINARY, bands ARRAY<BIGINT>"


def sets_of(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct window hashes of each text, one row after the other."""
    data, off = utf8(column)
    for lo, hi in pieces(off):
        part = data[off[lo] : off[hi]]
        s, e, at = words(part, off[lo : hi + 1] - off[lo])
        w = word_hashes(part, s, e)
        full = window_hashes(w, n)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            elif b > a:
                yield window_hashes(w[a:b], b - a)
            else:
                yield np.zeros(0, U)


def set_id(s: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


def minhash(s: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The least of (a * x) mod 2**64, its upper half, for each multiplier."""
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), chunk):
        part = s[i : i + chunk]
        np.minimum(out, ((_A[:, None] * part[None, :]) >> U(32)).min(axis=1).astype(np.uint32), out=out)
    return out


def _signed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    band = mix(np.arange(1, BANDS + 1, dtype=U))
    for b in batches:
        ids = b.column(0).to_pylist()
        rows = [(i, s) for i, s in zip(ids, sets_of(b.column(1), n)) if len(s) and i is not None]
        sig = np.array([minhash(s) for _, s in rows], np.uint32).reshape(-1, HASHES)
        v = np.zeros((len(rows), BANDS), U)
        for k in range(ROWS):
            v = mix(v + sig[:, k::ROWS][:, :BANDS].astype(U) + U(1))
        v = mix(v + band)
        low = sig.astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows], b.column(0).type),
                pa.array([set_id(s) for _, s in rows], pa.int64()),
                pa.array([len(s) for _, s in rows], pa.int32()),
                pa.array([x.tobytes() for x in low], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, len(rows) * BANDS + 1, BANDS, dtype=np.int32), pa.array(v.ravel().view(np.int64))),
            ],
            ["doc_id", "h", "n", "sig", "bands"],
        )


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values compared, the fewest matches that keep a pair.

    With m matches of n and a uniform prior the posterior is Beta(m + 1, n - m + 1), whose mass above t is
    the chance of at most m successes among n + 1 trials of probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, 0
        for m in range(n + 1):
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
        out[n] = m
    return out


def pruned(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """The rows of two signature tables that stay, comparing STEP more values at a time of those still there."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least.items():
        if not len(live):
            break
        matches = matches + (a[live, n - STEP : n] == b[live, n - STEP : n]).sum(axis=1)
        ok = matches >= m
        live, matches = live[ok], matches[ok]
    return live


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(doc_id, set, size, signature, bands) of each document with words, written down."""
    d = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).filter("text IS NOT NULL AND doc_id IS NOT NULL")
    return written(d.mapInArrow(lambda it: _signed(it, n), _SIGNED.format(id=d.schema["doc_id"].dataType.simpleString())), "signed")


def candidates(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of sets in one bucket, a < b, and the tile each lies in: (tile, a, b).

    A bucket of more than BLOCK sets is dealt into blocks before anything is collected, so no row holds
    more than about BLOCK of them; its pairs of blocks are rows of their own.
    """
    each = sig.groupBy("h").agg(F.first("bands").alias("bands")).select("h", F.explode("bands").alias("bucket"))
    each = written(each, "buckets")
    size = each.groupBy("bucket").agg(F.count("*").alias("n"))
    hot = written(size.filter(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), "hot-buckets")
    cold = each.join(hot, "bucket", "left_anti").groupBy("bucket").agg(F.sort_array(F.collect_list("h")).alias("hs")).filter(F.size("hs") > 1)
    dealt = each.join(hot, "bucket").select("bucket", "nb", F.pmod("h", F.col("nb")).cast("int").alias("i"), "h")
    dealt = written(dealt.groupBy("bucket", "nb", "i").agg(F.sort_array(F.collect_list("h")).alias("hs")), "blocks")
    alone = written(cold.select(F.col("hs").alias("x"), F.col("hs").alias("y")), "small-buckets")
    other = dealt.select("bucket", F.col("i").alias("j"), F.col("hs").alias("y"))
    # a row a pair of blocks; the pairs are dealt out before any is unfolded
    cut = dealt.select("bucket", "i", F.col("hs").alias("x"), F.explode(F.sequence("i", F.col("nb") - 1)).alias("j")).join(other, ["bucket", "j"]).select("x", "y")
    cut = alone.unionByName(cut.repartition(F.xxhash64("x", "y")))
    pairs = cut.select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    lists = alone.select(F.col("x").alias("hs")).unionByName(dealt.select("hs"))
    lead = lists.select(F.explode("hs").alias("h"), F.element_at("hs", 1).alias("first")).groupBy("h").agg(F.min("first").alias("lead"))
    lead = written(lead, "leads")
    many = lead.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    where = lead.join(many, "lead").select("h", F.xxhash64("lead", F.pmod("h", F.col("nb"))).alias("block"))
    of = lambda k: where.select(F.col("h").alias(k), F.col("block").alias(f"{k}_block"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(F.xxhash64("a_block", "b_block").alias("tile"), "a", "b")


def _tiled(pairs: DataFrame, what: DataFrame, run, schema: str) -> DataFrame:
    """Bring pairs and what they need of each set, columns h and x, together tile by tile; run gets a group of tiles."""
    need = written(pairs.select("tile", F.explode(F.array("a", "b")).alias("h")).distinct(), "needed")
    groups = max(1, -(-need.count() // GROUP))
    g = F.pmod("tile", F.lit(groups)).alias("g")
    left = pairs.select(g, "tile", "a", "b").groupBy("g")
    right = need.join(what, "h").select(g, "h", "x").groupBy("g")
    return left.cogroup(right).applyInPandas(run, schema)


def similar_sets(docs: DataFrame, sig: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b, jaccard) of the distinct sets that reach the threshold."""
    pairs = written(candidates(sig), "candidates")
    least = least_matches(threshold, tolerance)

    def prune(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = {h: i for i, h in enumerate(right.h.tolist())}
        table = np.frombuffer(b"".join(right.x.tolist()), np.uint16).reshape(-1, HASHES)
        keep = []
        a, b = left.a.map(at).to_numpy(), left.b.map(at).to_numpy()
        for i in range(0, len(left), 1 << 15):
            keep.append(i + pruned(table[a[i : i + (1 << 15)]], table[b[i : i + (1 << 15)]], least))
        return left.iloc[np.concatenate(keep) if keep else []][["tile", "a", "b"]]

    one = sig.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("x"))
    live = written(_tiled(pairs, one.select("h", "x"), prune, "tile BIGINT, a BIGINT, b BIGINT"), "survivors")
    used = live.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    holder = used.join(sig.groupBy("h").agg(F.min("doc_id").alias("doc_id")), "h")
    d = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("x")).filter("x IS NOT NULL")
    texts = d.join(holder.hint("merge"), "doc_id").select("h", "x")

    def verify(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, np.ndarray] = {}
        for h, s in zip(right.h.tolist(), sets_of(pa.array(right.x, pa.large_string()), n)):
            if h not in sets and set_id(s) == h:  # an id may have other texts as well
                sets[h] = s
        out, by = [], left.groupby("a", sort=False)["b"]
        for a, bs in by:
            x = sets[a]
            for b in bs.tolist():
                y = sets[b]
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if len(small) < threshold * len(large):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                j = both / (len(x) + len(y) - both)
                if j >= threshold:
                    out.append((a, b, j))
        return pd.DataFrame(out, columns=["a", "b", "jaccard"])

    return _tiled(live, texts, verify, "a BIGINT, b BIGINT, jaccard DOUBLE")


def join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of distinct sets, each named by its smallest id, and every further copy of a set with the smallest id."""
    sig = signed(docs, id_col, text_col, n)
    found = written(similar_sets(docs, sig, id_col, text_col, n, threshold, tolerance), "similar")
    first = sig.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("m"))
    copies = sig.select("h", "doc_id").distinct().join(first.filter("m > 1").withColumnRenamed("doc_id", "doc_a"), "h").filter("doc_id > doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    named = lambda k: first.select(F.col("h").alias(k), F.col("doc_id").alias(f"{k}_doc"))
    pairs = found.join(named("a"), "a").join(named("b"), "b")
    return pairs.select(F.least("a_doc", "b_doc").alias("doc_a"), F.greatest("a_doc", "b_doc").alias("doc_b"), "jaccard").unionByName(copies)


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, links): a row for each document and set.

    class_id is the smallest id of those that chains of similar documents lead to, and links is the number
    of other documents that reach the threshold with it, copies of a set each counted. So the sum of the links is twice
    the number of pairs, none of which is lost, though no pair of copies is written out.
    """
    sig = signed(docs, id_col, text_col, n)
    found = written(similar_sets(docs, sig, id_col, text_col, n, threshold, tolerance), "similar")
    member = written(sig.select("h", "doc_id").distinct(), "members")
    sets = written(member.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")), "sets")
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sets.select(F.col("h").alias("b"), "m"), "b").groupBy(F.col("a").alias("h")).agg(F.sum("m").alias("partners"))
    named = lambda k: sets.select(F.col("h").alias(k), F.col("first").alias(f"doc_{k}"))
    group = groups(found.join(named("a"), "a").join(named("b"), "b")).select(F.col("doc_id").alias("first"), "group")
    # an id with several sets ties these together as well
    whole = sets.join(linked, "h", "left").join(group, "first", "left").select("h", F.coalesce("group", "first").alias("class_id"), (F.coalesce("partners", F.lit(0)) + F.col("m") - 1).alias("links"))
    bare = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).filter(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    bare = bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links")).distinct()
    return member.join(whole, "h").select("doc_id", "class_id", "links").unionByName(bare)


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group): the connected components of pairs, each named by its smallest id.

    Stars are alternately built on larger and on smaller neighbours, until nothing changes. Each
    round is written to the shared folder, and there are about log of the longest chain.
    """
    e = written(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = written(down.join(low, "u").select(F.col("m").alias("u"), "v").unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    star = e.select(F.col("v").alias("doc_id"), F.col("u").alias("group"))
    return star.unionByName(e.select(F.col("u").alias("doc_id"), F.col("u").alias("group")).distinct())


def keep_first(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without those that have a smaller id in their group; the others with all columns."""
    name = free(docs, "gone")
    gone = groups(pairs).filter("doc_id <> `group`").select(F.col("doc_id").alias(name))
    return docs.join(gone.hint("merge"), column(id_col) == column(name), "left_anti")
