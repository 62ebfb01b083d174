"""Quality rule by n-gram perplexity: a modified Kneser-Ney model of bytes for each language.

Spark counts the n-grams of ORDER bytes of all documents, whole texts, by language. A
document begins with ORDER - 1 zero bytes, so every shorter n-gram is the end of a longest one and
the continuation counts of all lower orders follow from the distinct longest ones. Each order has
three discounts from its counts of counts. The model is two tables, of n-grams with their interpolated
log-probabilities and of contexts with the log of their back-off weights, both fitted by aggregations and joins, so no task or
driver has to hold a language. N-grams of up to seven bytes are their own hashes, without collisions.

A model of up to ``max_grams`` rows, a size that is counted first, is sorted by hash into arrays, for each language and order, that
every worker searches. A larger one stays where it is: the distinct n-grams of each text are joined with it. Both give
the same figures.

A document's cross-entropy is compared with its language's median. The band around the median is
``width`` times a scale made of the spread between documents of the language (1.4826 times the median
absolute deviation) and of the error of the mean of so few bytes. Documents above the upper
or below the lower perplexity are rejected, so noise goes as well as text that repeats itself.

Defined results: a null or empty text has the perplexity of the language's median and is kept; null
languages are one language; a language seen first in scoring has no model, and its documents
are kept with null perplexity and bands; repeated rows each count; an empty table
gives an empty result; extra columns, of any names, pass through ``score``, and columns named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltweave.llm.text import U, column, free, pieces, place, utf8, with_arrow
from siltweave.session import written

ORDER, WIDTH, MAX_GRAMS = 6, 5.0, 20_000_000
LANGUAGES = 10_000  # rows of a table by language that may be broadcast
_NEW = [("n_bytes", "BIGINT"), ("entropy", "DOUBLE"), ("entropy_var", "DOUBLE")]


def grams(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as an integer, reading zeros before a row's first byte; and the rows' offsets."""
    n, pad = len(off) - 1, order - 1
    at = off + pad * np.arange(n + 1)
    padded = np.zeros(int(at[-1]), np.uint8)
    row = np.repeat(np.arange(n), np.diff(off))
    padded[np.arange(len(data)) + pad * (row + 1)] = data
    out = np.zeros(len(data), U)
    ends = np.arange(len(data)) + pad * (row + 1)
    for i in range(order):
        out = out << U(8) | padded[ends - (pad - i)].astype(U)
    return out, off


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Counts by language of one task, merged as they come."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        by = np.argsort(k, kind="stable")
        k, c = k[by], c[by]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(c, first)

    for b in batches:
        langs = np.array([x or "" for x in b.column(1).to_pylist()], object)
        data, off = utf8(b.column(0))
        for lo, hi in pieces(off, 1 << 20):
            g, o = grams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], order)
            for lang in set(langs[lo:hi]):
                rows = np.repeat(langs[lo:hi] == lang, np.diff(o))
                k, c = np.unique(g[rows], return_counts=True)
                if len(k):
                    parts = held.setdefault(lang, [])
                    parts.append((k, c))
                    if len(parts) > 1 and sum(len(p[0]) for p in parts) > 2 * len(parts[0][0]) + (1 << 20):
                        parts[:] = [merge(parts)]
    for lang, parts in held.items():
        k, c = merge(parts)
        for i in range(0, len(k), 1 << 17):
            part = k[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(c[i : i + (1 << 17)].astype(np.int64))], ["lang", "gram", "n"])


def _lang(lang_col: str) -> Column:
    return F.coalesce(column(lang_col).cast("string"), F.lit(""))


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all documents."""
    d = docs.select(column(text_col).alias("text"), _lang(lang_col).alias("lang")).filter("text IS NOT NULL")
    return d.mapInArrow(lambda it: _counted(it, order), "lang STRING, gram BIGINT, n BIGINT").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def few(df: DataFrame) -> DataFrame:
    """A written table by language, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.limit(LANGUAGES + 1).count() <= LANGUAGES else df


@dataclass
class Tables:
    """(lang, k, gram, logp) of the n-grams of all orders k, and (lang, k, ctx, bow) of their contexts."""

    grams: DataFrame
    contexts: DataFrame
    order: int


def _discounts(t: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the counts of counts."""
    m = lambda i: F.col(f"m{i}")
    c = t.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"m{i}") for i in (1, 2, 3, 4)])
    y = F.when((m(1) > 0) & (m(2) > 0), m(1) / (m(1) + 2 * m(2))).otherwise(0.5)
    d = lambda i: F.when((m(i) > 0) & (m(i + 1) > 0), F.least(F.greatest(i - (i + 1) * y * m(i + 1) / m(i), F.lit(0.1)), F.lit(i - 0.05))).otherwise(min(0.5 * i, 1.5)).alias(f"d{i}")
    return few(written(c.select("lang", d(1), d(2), d(3)), "discounts"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Tables:
    """Fit the models of all languages together, from the lowest order up."""
    tables = [written(counts(docs, text_col, lang_col, order), "gram-counts")]
    for k in range(order - 1, 0, -1):  # continuation counts: the distinct bytes before
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")
        tables.append(written(tables[-1].select("lang", suffix).groupBy("lang", "gram").agg(F.count("*").alias("n")), f"continuations-{k}"))
    grams = contexts = below = None
    for k, t in enumerate(tables[::-1], 1):
        t = t.join(_discounts(t), "lang").select("lang", "gram", F.shiftright("gram", 8).alias("ctx"), "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("cut"))
        c = written(t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma")), f"contexts-{k}")
        t = t.join(c, ["lang", "ctx"])
        if below is None:
            t = t.withColumn("lower", F.lit(1 / 256))
        else:
            t = t.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        below = written(t.select("lang", "gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p")), f"probabilities-{k}")
        g, c = below.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp")), c.select("lang", F.lit(k).alias("k"), "ctx", F.log("gamma").alias("bow"))
        grams, contexts = (g, c) if grams is None else (grams.unionByName(g), contexts.unionByName(c))
    return Tables(grams, contexts, order)


class Model:
    """A language's arrays. By order, lowest first: (sorted n-grams, log-probabilities, sorted contexts, log back-off weights)."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.orders = orders

    def score(self, g: np.ndarray) -> np.ndarray:
        """Log-probability of the last byte of each n-gram, of the model's own order."""
        out, miss, weight = np.zeros(len(g), np.float64), np.arange(len(g)), np.zeros(len(g))
        for k in range(len(self.orders), 0, -1):
            u, p, ctx, gamma = self.orders[k - 1]
            x = g[miss] & U((1 << (8 * k)) - 1)
            at = np.minimum(np.searchsorted(u, x), len(u) - 1)
            hit = u[at] == x
            out[miss[hit]] = weight[hit] + p[at[hit]]
            miss, weight, x = miss[~hit], weight[~hit], x[~hit] >> U(8)
            if not len(miss):
                return out
            at = np.minimum(np.searchsorted(ctx, x), len(ctx) - 1)
            weight = weight + np.where(ctx[at] == x, gamma[at], 0)
        out[miss] = weight + np.log(1 / 256)
        return out


def arrays(t: Tables, seen: bool = False) -> dict[str, Model]:
    """The models by language, brought together: for tables whose size is known to be bounded. Where all n-grams were seen, the longest are enough."""
    out: dict[str, list] = {}
    both = ((t.grams, "gram", "logp"), (t.contexts, "ctx", "bow"))
    for i, (table, key, value) in enumerate(both[:1] if seen else both):
        got = (table.filter(F.col("k") == t.order) if seen else table).select("lang", "k", key, F.col(value).cast("float").alias(value)).toArrow()
        langs = got.column("lang").combine_chunks().dictionary_encode()
        which, k = langs.indices.to_numpy(), got.column("k").to_numpy()
        keys, values = got.column(key).to_numpy().view(U), got.column(value).to_numpy()
        by = np.lexsort((keys, k, which))
        which, k, keys, values = which[by], k[by], keys[by], values[by]
        cut = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (k[1:] != k[:-1])])) if len(which) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(which)]):
            orders = out.setdefault(langs.dictionary[int(which[a])].as_py(), [[None] * 4 for _ in range(t.order)])
            orders[k[a] - 1][2 * i : 2 * i + 2] = keys[a:b].copy(), values[a:b].copy()
    return {lang: Model([tuple(o) for o in orders]) for lang, orders in out.items()}


def score(docs: DataFrame, tables: Tables, text_col: str = "text", lang_col: str = "lang", max_grams: int = MAX_GRAMS, seen: bool = False) -> DataFrame:
    """Add n_bytes, entropy (mean negative log-probability of a byte) and its variance; null where there is no model or no text.

    ``seen`` says that the model was trained on these documents, among others, so that it needs no back-off.
    """
    if tables.grams.count() + tables.contexts.count() > max_grams:
        return score_joined(docs, tables, text_col, lang_col)
    order = tables.order
    shared = docs.sparkSession.sparkContext.broadcast(arrays(tables, seen))
    names = [n for n, _ in _NEW]
    tag = free(docs, "lang_")
    docs = docs.withColumn(tag, _lang(lang_col))
    ti, li = place(docs, text_col, names), place(docs, tag, names)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        models = shared.value
        langs = np.array(b.column(li).to_pylist(), object)
        data, off = utf8(b.column(ti))
        mean, var = np.full(len(langs), np.nan), np.full(len(langs), np.nan)
        for lo, hi in pieces(off, 1 << 20):
            g, o = grams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], order)
            size = np.diff(o)
            p = np.zeros(len(g))
            for lang in set(langs[lo:hi]) & set(models):
                rows = np.repeat(langs[lo:hi] == lang, size)
                u, inv = np.unique(g[rows], return_inverse=True)
                p[rows] = -models[lang].score(u)[inv]
            one, two = np.concatenate([[0], np.cumsum(p)]), np.concatenate([[0], np.cumsum(p * p)])
            ok = (size > 0) & np.isin(langs[lo:hi], list(models))
            n = np.maximum(size, 1)
            m = (one[o[1:]] - one[o[:-1]]) / n
            mean[lo:hi] = np.where(ok, m, np.nan)
            var[lo:hi] = np.where(ok, np.maximum((two[o[1:]] - two[o[:-1]]) / n - m * m, 0), np.nan)
        more = [pa.array(np.diff(off), pa.int64()), pa.array(mean, from_pandas=True), pa.array(var, from_pandas=True)]
        return [*(c for i, c in enumerate(b.columns) if i != li), *more]

    kept = [c for c in docs.columns if c != tag]
    return with_arrow(docs, make, _NEW, (text_col, tag), keep=kept)


def _own(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(key, lang, gram, n): the distinct n-grams of each text."""
    for b in batches:
        data, off = utf8(b.column(2))
        for i in range(b.num_rows):
            g, _ = grams(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), order)
            u, n = np.unique(g, return_counts=True)
            for lo in range(0, len(u), 1 << 16):
                part = u[lo : lo + (1 << 16)]
                cols = [pa.array([b.column(c)[i].as_py()] * len(part), b.column(c).type) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(part.view(np.int64)), pa.array(n[lo : lo + (1 << 16)])], ["key", "lang", "gram", "n"])


def score_joined(docs: DataFrame, tables: Tables, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The same by joins, for a model of any size. Equal texts of a language are scored once."""
    names = [n for n, _ in _NEW]
    key = free(docs, "key_")
    d = docs.drop(*[c for c in docs.columns if c.lower() in names]).withColumn(key, F.xxhash64(_lang(lang_col), column(text_col)))
    texts = d.filter(F.octet_length(column(text_col)) > 0).select(column(key).alias("key"), _lang(lang_col).alias("lang"), column(text_col).alias("text")).groupBy("key", "lang").agg(F.min("text").alias("text"))
    order = tables.order
    left = written(texts.mapInArrow(lambda it: _own(it, order), "key BIGINT, lang STRING, gram BIGINT, n BIGINT"), "own-grams").withColumn("w", F.lit(0.0))
    left = left.join(tables.grams.select("lang").distinct(), "lang", "left_semi")
    found = None
    for k in range(order, 0, -1):
        j = left.join(tables.grams.filter(F.col("k") == k).select("lang", "gram", "logp"), ["lang", "gram"], "left")
        j = written(j, f"scored-{k}")
        hit = j.filter("logp IS NOT NULL").select("key", "n", (F.col("w") + F.col("logp")).alias("lp"))
        found = hit if found is None else found.unionByName(hit)
        left = j.filter("logp IS NULL").select("key", "lang", "gram", F.shiftright("gram", 8).alias("ctx"), "n", "w")
        if left.isEmpty():
            break
        bow = tables.contexts.filter(F.col("k") == k).select("lang", "ctx", "bow")
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)).alias("gram")
        left = left.join(bow, ["lang", "ctx"], "left").select("key", "lang", shorter, "n", (F.col("w") + F.coalesce("bow", F.lit(0.0))).alias("w"))
    else:
        found = found.unionByName(left.select("key", "n", (F.col("w") + F.lit(float(np.log(1 / 256)))).alias("lp")))
    m = F.sum(F.col("n") * F.col("lp")) / F.sum("n")
    s = found.groupBy("key").agg((-m).alias("entropy"), F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("lp") * F.col("lp")) / F.sum("n") - m * m).alias("entropy_var")).withColumnRenamed("key", f"{key}2")
    cols = [column(c).alias(c) for c in d.columns if c != key]
    return d.join(s, column(key) == column(f"{key}2"), "left").select(*cols, F.coalesce(F.octet_length(column(text_col)), F.lit(0)).cast("bigint").alias("n_bytes"), s["entropy"], s["entropy_var"])


def bands(scored: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(tag, median, spread, byte_var) of each language over all its documents with text."""
    s = scored.filter("entropy IS NOT NULL").select(_lang(lang_col).alias("tag"), "entropy", "entropy_var")
    median = few(written(s.groupBy("tag").agg(F.percentile_approx("entropy", 0.5, 10000).alias("median"), F.avg("entropy_var").alias("byte_var")), "medians"))
    off = s.join(median, "tag").groupBy("tag").agg(F.percentile_approx(F.abs(F.col("entropy") - F.col("median")), 0.5, 10000).alias("mad"))
    return few(written(median.join(off, "tag").select("tag", "median", "byte_var", (F.col("mad") * 1.4826).alias("spread")), "bands"))


def rule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, width: float = WIDTH, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(id, lang, perplexity, lower, upper, keep) of each document."""
    d = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    s = written(score(d, train(d, order=order), max_grams=max_grams, seen=True).drop("text"), "entropies")
    s = s.withColumn("tag", _lang("lang")).join(bands(s), "tag", "left")
    reach = F.lit(width) * F.sqrt(F.col("spread") ** 2 + F.col("byte_var") / F.greatest("n_bytes", F.lit(1)))
    e = F.coalesce("entropy", "median")
    keep = F.coalesce((e >= F.col("median") - reach) & (e <= F.col("median") + reach), F.lit(True))
    return s.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.exp(e).alias("perplexity"), F.exp(F.col("median") - reach).alias("lower"), F.exp(F.col("median") + reach).alias("upper"), keep.alias("keep"))
