"""Ordinal quality classifier: cumulative-link regression over hashed text.

A text's features are the shares of its byte n-grams, and of the n-grams of its bytes'
classes, that fall into hashed buckets, the shares of its words, as runs of letters in
lower case, in buckets of their own, and the share of words that repeat the last. From a text's shares the mean ones
of the rated texts are taken away, so that a text too short to tell has a score near 0, which is that of the ratings' own shares.
One weight vector, shared by all grades, gives a latent score; ordered thresholds cut
it into grades: P(grade <= k) = sigmoid(threshold[k] - score). Ratings come from the
labelled rows; training uses at most ``max_rows`` of them, those with the smallest
hashed ids, and their whole texts. Scoring reads the corpus once.

Defined results: a null or empty text has no n-grams, so its score is 0 and its
probabilities are those of the thresholds; rows whose rating is null or no grade aren't trained
on; a document's repeated labels of one grade count once, with the smallest of its texts; with no usable
labels, or no documents, the model has no weights and gives everything the highest grade, so nothing is
rejected without evidence; extra columns, of any names, pass through ``score``, and columns named as its results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltweave.llm.text import column, pieces, place, utf8, with_arrow, word_hashes, words

BITS = 16
GRADES = 3
PRIOR = 50  # added to the count of n-grams, so that very short texts lean on the thresholds
_MULT = np.uint32(0x9E3779B1)
# classes of bytes: other, lower, upper, digit, space, line end, sentence mark, beyond ASCII
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[[44, 46]] = 4, 5, 6
SHAPES = 8**4
# letters in lower case, anything else as a space
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
CLEAR = 4.5  # standard errors by which the mean grade of a word's texts must differ, for the word to have a weight
WORDS = 40  # how much a word's share counts beside an n-gram's, as there are fewer words than bytes


def size_of(bits: int) -> int:
    """Buckets of n-grams, then of shapes, then of words, then one of repeated words."""
    return (2 << bits) + SHAPES + 1


def lexical(data: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of the three bytes that begin at each byte but the last two."""
    d = data.astype(np.uint32)
    word = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
    return (((word ^ word >> np.uint32(11)) * _MULT) >> np.uint32(32 - bits)).astype(np.int64)


def shapes(data: np.ndarray, bits: int) -> np.ndarray:
    """The same of the classes of four bytes."""
    c = _CLASS[data]
    return ((c[:-3] << np.uint32(9) | c[1:-2] << np.uint32(6) | c[2:-1] << np.uint32(3) | c[3:]) + np.uint32(1 << bits)).astype(np.int64)


def spelled(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the rows' words, and the offsets of the rows among them."""
    letters = _LETTER[data]
    s, e, at = words(letters, off)
    if not len(s):
        return np.zeros(0, np.int64), at
    return (word_hashes(letters, s, e) >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits) + SHAPES, at


def repeats(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row, the words and those of them that equal the word before."""
    s, e, at = words(data, off)
    if not len(s):
        return np.diff(at), np.zeros(len(off) - 1, np.int64)
    w = word_hashes(data, s, e)
    same = np.zeros(len(w) + 1, np.int64)
    same[2:] = w[1:] == w[:-1]
    same[np.minimum(at[:-1] + 1, len(w))] = 0  # a row's first word has none before it
    total = np.cumsum(same)
    return np.diff(at), total[at[1:]] - total[at[:-1]]


def features(data: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, shares) of one text, and how much it says: of n-grams, shapes and words, their number out of it and the prior's."""
    idx, val, says = [], [], []
    for k, f in ((3, lexical), (4, shapes)):
        says.append(0.0)
        if len(data) >= k:
            u, c = np.unique(f(data, bits), return_counts=True)
            idx.append(u)
            val.append(c / (c.sum() + PRIOR))
            says[-1] = val[-1].sum()
    own, _ = spelled(data, np.array([0, len(data)]), bits)
    u, c = np.unique(own, return_counts=True)
    idx.append(u)
    val.append(WORDS * c / (len(own) + PRIOR))
    says.append(len(own) / (len(own) + PRIOR))
    n, same = repeats(data, np.array([0, len(data)]))
    idx.append(np.array([size_of(bits) - 1]))
    val.append(same / (n + PRIOR))
    return np.concatenate(idx), np.concatenate(val), np.array(says)


@dataclass
class OrdinalModel:
    """Weights by bucket, the increasing thresholds between grades, and what the mean text would score by its n-grams, shapes and words."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS
    means: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def latent(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sum of weight times share of each row; 0 where there are no n-grams."""
        out = np.zeros(len(offsets) - 1)
        for i, j in pieces(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            for (k, f), mean in zip(((3, lexical), (4, shapes)), self.means):
                if len(part) < k:
                    continue
                total = np.concatenate([[0.0], np.cumsum(self.weights[f(part, self.bits)], dtype=np.float64)])
                n = np.maximum(np.diff(off) - (k - 1), 0)  # n-grams lie within one row
                first = np.minimum(off[:-1], len(total) - 1)
                out[i:j] += (total[np.minimum(first + n, len(total) - 1)] - total[first] - n * mean) / (n + PRIOR)
            own, at = spelled(part, off, self.bits)
            total = np.concatenate([[0.0], np.cumsum(self.weights[own], dtype=np.float64)])
            n = np.diff(at)
            out[i:j] += (WORDS * (total[at[1:]] - total[at[:-1]]) - n * self.means[2]) / (n + PRIOR)
            n, same = repeats(part, off)
            out[i:j] += self.weights[-1] * same / (n + PRIOR)
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def ordered_thresholds(par: np.ndarray) -> np.ndarray:
    """t0, t0 + exp(g1), ...: in order whatever the parameters."""
    return par[0] + np.concatenate([[0.0], np.cumsum(np.exp(par[1:]))])


def likelihood(w: np.ndarray, par: np.ndarray, idx: np.ndarray, val: np.ndarray, row: np.ndarray, says: np.ndarray, mean: np.ndarray, grades: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades with the penalty of the weights, and its gradients in weights and parameters."""
    n, n_grades = len(grades), len(par) + 1
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    th = ordered_thresholds(par)
    eta = np.bincount(row, weights=w[idx] * val, minlength=n) - says @ (mean @ w)
    cuts = np.concatenate([[-np.inf], th, [np.inf]])
    hi, lo = sig(cuts[grades + 1] - eta), sig(cuts[grades] - eta)
    hi[grades == n_grades - 1], lo[grades == 0] = 1.0, 0.0
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    d = (dhi - dlo) / n
    g = np.bincount(idx, weights=d[row] * val, minlength=len(w)) - (d @ says) @ mean + l2 * w
    d_th = np.array([(-(dhi * (grades == k)) + dlo * (grades == k + 1)).mean() for k in range(n_grades - 1)])
    gp = np.concatenate([[d_th.sum()], [d_th[k:].sum() * np.exp(par[k]) for k in range(1, n_grades - 1)]])
    return float(-np.log(p).mean() + l2 * (w * w).sum() / 2), g, gp


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES, bits: int = BITS, steps: int = 100, l2: float = 1e-5, rate: float = 3.0) -> OrdinalModel:
    """Maximum likelihood by Adam over sparse rows of features."""
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows]).astype(np.float64)
    says = np.array([r[2] for r in rows], np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    # words that tell nothing of the grades, or are in too few texts to tell, would learn these texts by heart
    off = (grades - grades.mean()) / max(grades.std(), 1e-9)
    size = size_of(bits)
    seen = np.bincount(idx, minlength=size)
    tells = np.abs(np.bincount(idx, weights=off[row], minlength=size)) >= CLEAR * np.sqrt(np.maximum(seen, 1))
    tells[: (1 << bits) + SHAPES], tells[-1] = True, True
    idx, val, row = idx[tells[idx]], val[tells[idx]], row[tells[idx]]
    total, mean = np.bincount(idx, weights=val, minlength=size), np.zeros((3, size))
    for k, (a, b) in enumerate(((0, 1 << bits), (1 << bits, (1 << bits) + SHAPES), ((1 << bits) + SHAPES, size - 1))):
        mean[k, a:b] = total[a:b] / max(says[:, k].sum(), 1e-9)
    share = np.array([np.mean(grades >= k) for k in range(1, n_grades)]).clip(0.01, 0.99)
    start = np.log((1 - share) / share)
    par = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    w = np.zeros(size)
    m, v, mp, vp = np.zeros_like(w), np.zeros_like(w), np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        _, g, gp = likelihood(w, par, idx, val, row, says, mean, grades, l2)
        for x, grad, a, b, lr in ((w, g, m, v, rate), (par, gp, mp, vp, 0.05)):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            x -= lr * (1 - (t - 1) / steps) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-12)
    return OrdinalModel(w.astype(np.float32), ordered_thresholds(par), bits, tuple((mean @ w).tolist()))


def _shares(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column("text"))
        idx, val, says = [], [], []
        for i in range(len(off) - 1):
            u, share, much = features(data[off[i] : off[i + 1]], bits)
            idx.append(u.astype(np.int32))
            val.append(share.astype(np.float32))
            says.append(much)
        cols = [pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())), pa.array(says, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([b.column("grade"), *cols], ["grade", "idx", "val", "says"])


def unfitted(n_grades: int = GRADES, bits: int = BITS) -> OrdinalModel:
    """What is used where there is nothing to train on: the highest grade for all."""
    return OrdinalModel(np.zeros(size_of(bits), np.float32), np.arange(n_grades - 1, dtype=float) - 60, bits)


def train(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", n_grades: int = GRADES, max_rows: int = 3000, bits: int = BITS) -> OrdinalModel:
    """Fit on at most max_rows rated documents, a documented bound: they are broadcast and their features sent to the driver."""
    pick = rated.select(column(id_col).alias("id"), column(grade_col).cast("int").alias("grade")).filter(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1)).distinct()
    pick = pick.orderBy(F.xxhash64("id"), "id", "grade").limit(max_rows)
    d = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).filter("text IS NOT NULL")
    found = d.join(F.broadcast(pick), "id").groupBy("id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
    table = found.mapInArrow(lambda it: _shares(it, bits), "grade INT, idx ARRAY<INT>, val ARRAY<FLOAT>, says ARRAY<DOUBLE>").toArrow()
    if not len(table):
        return unfitted(n_grades, bits)
    grades = table.column("grade").to_numpy()
    parts = [table.column(c).combine_chunks() for c in ("idx", "val", "says")]
    rows = [tuple(c[i].values.to_numpy() for c in parts) for i in range(len(grades))]
    return fit(rows, grades.astype(np.int64), n_grades, bits)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least_grade: int = GRADES - 1, least_tail: float = 0.5) -> DataFrame:
    """Add expected_grade, tail_prob = P(grade >= least_grade) and keep = tail_prob >= least_tail."""
    new = [("expected_grade", "DOUBLE"), ("tail_prob", "DOUBLE"), ("keep", "BOOLEAN")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = place(docs, text_col, [n for n, _ in new])

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        tails = m.tails(m.latent(*utf8(b.column(at))))
        tail = tails[:, least_grade - 1]
        return [*b.columns, pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least_tail)]

    return with_arrow(docs, make, new, (text_col,))


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings of the labels table: how many of its two demands a document meets, to be well written and to be not toxic.

    Each demand that isn't met lowers the grade by one, so the grades are ordered, and only the highest is worth keeping.
    """
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
