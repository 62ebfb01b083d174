"""Vectorised hashing of words over Arrow string buffers, shared by the operators.

Words are the maximal runs of bytes other than ASCII white space; a null text has
none. All hashes are 64-bit polynomial prefix sums, so the hash of any window of
words costs two look-ups, finished with an avalanche step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            made.append(np.cumprod(a, dtype=U))
        if n > 1 << 21:  # a single huge text; not worth keeping
            return made[0], made[1]
        _POWERS[base] = (made[0], made[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes together, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words of the rows, and the n + 1 offsets of the rows among the words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends[:-1] &= ~solid[1:] | first[1:n]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, base: int = _BYTE_BASE) -> np.ndarray:
    up, down = powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s])


def window_hashes(w: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of each k consecutive words, over row bounds as well: the caller drops those."""
    if len(w) < k:
        return np.zeros(0, U)
    up, down = powers(base, len(w) + 1)
    total = np.zeros(len(w) + 1, U)
    np.cumsum(w * up[: len(w)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(w) - k + 1])


def free(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def column(name: str):
    """A column by its whole name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], new: list[tuple[str, str]], used: tuple[str, ...] = (), replaced: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """df after ``make``, which turns a batch into arrays: of the columns in ``keep`` (all by default), in order, then of the new ones.

    Columns named as new ones are taken away first, but those that ``make`` reads, ``used``. Names are set aside while Python runs, so any name will do.
    """
    gone = {n.lower() for n, _ in new}
    names = [c for c in df.columns if c.lower() not in gone or c in used]
    d = df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(names)])
    types = dict(zip(names, (f.dataType.simpleString() for f in d.schema))) | (replaced or {})
    left = [c for c in names if (keep is None or c in keep) and c.lower() not in gone]
    inner = [f"c{names.index(c)}" for c in left] + [f"n{i}" for i in range(len(new))]
    schema = ", ".join(f"{a} {t}" for a, t in zip(inner, [*(types[c] for c in left), *(t for _, t in new)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(make(b), inner)

    return d.mapInArrow(run, schema).toDF(*left, *[n for n, _ in new])


def place(df: DataFrame, col: str, new: list[str]) -> int:
    """Where ``with_arrow`` has a column that it uses among those of a batch."""
    gone = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in gone or c == col].index(col)
