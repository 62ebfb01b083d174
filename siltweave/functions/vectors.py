"""Column functions of embedding vectors, arrays of doubles."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TINY = 1e-10
_SPACE = re.compile(r"\s")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def normalised(a: Column) -> Column:
    n = norm(a) + TINY
    return F.transform(a, lambda x: x / n)


def hashed_embedding(dims: int = 64):
    """A deterministic text embedder for offline use: signed counts of hashed words, of unit length.

    A word's MD5 gives its dimension and, by the next digit, its sign; equal words of a batch are hashed once.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}

        def of(w: str) -> tuple[int, int]:
            if w not in known:
                h = hashlib.md5(w.encode()).hexdigest()
                known[w] = int(h[:7], 16) % dims, 1 if int(h[7], 16) % 2 else -1
            return known[w]

        out = []
        for t in texts:
            pairs = [of(w) for w in (t or "").lower().split()]
            v = np.bincount([d for d, _ in pairs], [s for _, s in pairs], dims) if pairs else np.zeros(dims)
            out.append((v / (np.linalg.norm(v) + TINY)).tolist())
        return pd.Series(out)

    return embed


def embedded(docs: DataFrame, id_col: str, text_col: str, dims: int = 64, known_words: int = 50_000, slice_chars: int = 1 << 20) -> DataFrame:
    """(id, e): the embeddings of ``hashed_embedding`` for whole tables. A worker takes one text of a batch at a time, in slices of its
    words, and knows so many short words again, so what it holds doesn't grow with the texts of a batch or their words.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def of(w: str) -> int:
            """Twice the dimension, and one more if the sign is positive."""
            x = known.get(w)
            if x is None:
                h = hashlib.md5(w.encode()).hexdigest()
                x = int(h[:7], 16) % dims * 2 + int(h[7], 16) % 2
                if len(w) <= 64:
                    if len(known) >= known_words:
                        known.clear()
                    known[w] = x
            return x

        def counts(t: str) -> np.ndarray:
            n, at = np.zeros(2 * dims, np.int64), 0
            t = t.lower()
            while at < len(t):
                space = _SPACE.search(t, at + slice_chars)
                end = space.start() if space else len(t)
                n += np.bincount([of(w) for w in t[at:end].split()], minlength=2 * dims)
                at = end
            return n

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                out = np.zeros((part.num_rows, dims))
                for r, t in enumerate(part.column(1)):
                    if t.is_valid:
                        n = counts(t.as_py())
                        v = (n[1::2] - n[::2]).astype(float)
                        out[r] = v / (np.linalg.norm(v) + TINY)
                e = pa.ListArray.from_arrays(np.arange(0, out.size + 1, dims, dtype=np.int32), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), e], ["id", "e"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, e ARRAY<DOUBLE>")
