"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the BPE encoding has one last token, and a token may
follow the encoding of a shorter prefix iff the pair it makes with that prefix's last
token is stable: merging the pair's bytes gives the pair back. So the encoding is found
left to right, storing a last token for each prefix, and reading it back from the end.
Bytes appended later only extend the table, and after an edit it is redone from the
edit until it falls into step with the old one again.

Texts are cut first by the vocabulary's pattern, many rows at once: the default pattern's rules are applied to arrays of
character classes. Equal pieces are encoded once per worker while they stay in a bounded table, in which
pieces of up to 64 bytes are known by a 64-bit hash and longer ones by their bytes.

Defined results: a null text has null ids and a null id array decodes to null; an empty
text has no ids; ids outside the vocabulary raise ValueError in decoding; bytes that
aren't UTF-8 decode with the replacement character in ``decode`` and exactly in
``decode_bytes``; rows, repeated or not, are independent; extra columns pass through.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from siltweave.llm.text import U, pieces, place, utf8, with_arrow, word_hashes

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 700_000
HASHED = 64  # bytes of the longest piece that is known by its hash
_OTHER, _LETTER, _DIGIT, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point that the default pattern tells apart."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, p in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(p, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return out


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    every = _classes()
    out = every[:256][data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        lead = data[at]
        n = 2 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
        for size, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            w = at[n == size]
            v = data[w].astype(np.uint32) & mask
            for k in range(1, size):
                v = v << 6 | data[w + k] & 0x3F
            for k in range(size):
                out[w + k] = every[v]
    return out


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the pieces of all rows by the default pattern, and the rows' offsets among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    x, kind = data, kinds(data)
    head = np.zeros(n + 1, bool)  # first bytes of rows, and the end of all
    head[off] = True
    head[n] = True
    begins = head[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # white space before anything else: its last character is a piece, or begins the next one if it is a blank
    into = np.flatnonzero(begins & (kind != _SPACE))
    into = into[~head[into]]
    into = into[kind[into - 1] == _SPACE]
    last = into - 1
    while len(wide := np.flatnonzero((x[last] & 0xC0) == 0x80)):
        last[wide] -= 1
    begins[last] = True
    begins[into[x[into - 1] == 32]] = False
    # 's, 't, 'd, 'm, 'll, 've, 're where a piece begins
    q = np.flatnonzero((x == 39) & begins)
    q = q[(q + 1 < n)]
    q = q[~head[q + 1]]
    if len(q):
        one = x[q + 1]
        two = np.where((q + 2 < n) & ~head[np.minimum(q + 2, n)], x[np.minimum(q + 2, n - 1)], 0)
        short = np.isin(one, [115, 100, 109, 116])
        long = (one == 108) & (two == 108) | ((one == 118) | (one == 114)) & (two == 101)
        for w, size in ((q[short], 2), (q[long & ~short], 3)):
            begins[w + 1] = False
            after = w + size
            after = after[after < n]
            begins[after[~head[after] & (kind[after] == _LETTER)]] = True  # else a piece begins there anyway
    s = np.flatnonzero(begins)
    return s, np.append(s[1:], n), np.searchsorted(s, off)


class Encoder:
    """The vocabulary's ranks, and the table of stable pairs as far as it is known."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ending = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.ending.add_word(b.decode("latin-1"), (i, len(b)))
        self.ending.make_automaton()
        self.pattern = regex.compile(pattern)
        self.stable: dict[int, bool] = {}
        self.wide = max(self.token) >= 1 << 16
        self.cache = _Pieces(self)
        self.table = _Table(self.piece)
        self.sized: _Table | None = None
        self.spelled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> "Encoder":
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition, lowest rank first and leftmost among equals; for short byte strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 1_000_000:
                self.stable.clear()
            known = self.stable[key] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def extend(self, data: bytes, last: list[int], upto: int) -> list[int]:
        """last[i] is the last token of data[: i + 1]; adds those of the prefixes up to ``upto`` bytes.

        An automaton gives the tokens that end at each byte, the longest first.
        """
        n, known_pair = len(last), self.stable.get
        at = max(0, n - self.longest)
        for end, (t, size) in self.ending.iter(data[at:upto].decode("latin-1")):
            end += at
            if end < n:
                continue
            start = end + 1 - size
            if start:
                left = last[start - 1]
                known = known_pair(left << 32 | t)
                if not known and (known is not None or not self.follows(left, t)):
                    continue
            elif end and not self.whole(t):
                continue
            last.append(t)
            n += 1
        return last

    @lru_cache(maxsize=1 << 17)  # noqa: B019
    def whole(self, t: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        return self.merged(self.token[t]) == [t]

    def back(self, last: list[int]) -> list[int]:
        out, i = [], len(last)
        while i:
            t = last[i - 1]
            out.append(t)
            i -= len(self.token[t])
        return out[::-1]

    def encode_bytes(self, data: bytes) -> list[int]:
        return self.back(self.extend(data, [], len(data)))

    def piece(self, data: bytes) -> list[int]:
        t = self.ranks.get(data)
        return [t] if t is not None and self.whole(t) else self.encode_bytes(data)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def ids(self, text: str) -> np.ndarray:
        c = self.cache
        if len(c) > CACHE:
            c.clear()
        return np.frombuffer(b"".join(map(c.__getitem__, self.pattern.findall(text))), np.uint32 if self.wide else np.uint16)

    def slots(self, data: np.ndarray, off: np.ndarray, table: "_Table") -> tuple[np.ndarray, np.ndarray]:
        """The place in the table of each piece of the rows, and the rows' offsets among the pieces."""
        s, e, at = split(data, off)
        out = np.full(len(s), -1, np.int64)
        if len(table) > CACHE:
            table.clear()
        far = e - s > HASHED
        for i in np.flatnonzero(far).tolist():
            out[i] = table.slot(data[s[i] : e[i]].tobytes())
        near = np.flatnonzero(~far)
        if len(near):
            h = word_hashes(data, s[near], e[near])
            found = table.find(h)
            new = np.flatnonzero(found < 0)
            if len(new):
                u, first, inv = np.unique(h[new], return_index=True, return_inverse=True)
                made = table.add(u, [data[s[p] : e[p]].tobytes() for p in near[new[first]].tolist()])
                found[new] = made[inv]
            out[near] = found
        return out, at

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of tokens of each row. New pieces are counted by the tokenizer library, which is faster and, as tests show, agrees."""
        out = np.zeros(len(off) - 1, np.int64)
        if self.sized is None:
            library = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            self.sized = _Table(lambda piece: (len(library.encode_ordinary(piece.decode())),))
        for i, j in pieces(off):
            slot, at = self.slots(data[off[i] : off[j]], off[i : j + 1] - off[i], self.sized)
            total = np.concatenate([[0], np.cumsum(self.sized.arrays()[0][slot])])
            out[i:j] = np.diff(total[at])
        return out

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and the rows' offsets among them."""
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for i, j in pieces(off):
            slot, at = self.slots(data[off[i] : off[j]], off[i : j + 1] - off[i], self.table)
            ids, n, start = self.table.arrays()
            n, start = n[slot], start[slot]
            total = np.concatenate([[0], np.cumsum(n)])
            flat.append(ids[np.repeat(start - total[:-1], n) + np.arange(total[-1])])
            sizes.append(np.diff(total[at]))
        return np.concatenate(flat), np.cumsum(np.concatenate(sizes))

    def decode_bytes(self, ids) -> bytes:
        try:
            return b"".join(map(self.token.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"there is no token {e}") from None


    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many ids, one after the other, and where those of each begin, with the end of all."""
        if self.spelled is None:
            top = max(self.token) + 1
            size = np.full(top, -1, np.int64)
            for i, b in self.token.items():
                size[i] = len(b)
            start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
            self.spelled = np.frombuffer(b"".join(self.token[i] for i in sorted(self.token)), np.uint8), size, start
        flat, size, start = self.spelled
        bad = (ids < 0) | (ids >= len(size))
        bad[~bad] = size[ids[~bad]] < 0
        if bad.any():
            raise ValueError(f"there is no token {ids[bad][0]}")
        n = size[ids]
        off = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(start[ids] - off[:-1], n) + np.arange(off[-1])], off


    def texts(self, ids: np.ndarray, off: np.ndarray, room: int = 1 << 18) -> list[str]:
        """The texts of rows of ids, some ``room`` of them at a time."""
        out = []
        for i, j in pieces(off, room):
            raw, at = self.bytes_of(ids[off[i] : off[j]])
            ends, data = at[off[i : j + 1] - off[i]].tolist(), raw.tobytes()
            out += [data[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:])]
        return out


class _Table:
    """What ``make`` gives for pieces, one piece after the other, and where that of each begins.

    Hashes of short pieces lie in an open-addressed table, so that many are looked up at once.
    """

    BITS = 16  # at first; it doubles when it is half full

    def __init__(self, make):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.long: dict[bytes, int] = {}
        self.keys, self.places = np.zeros(1 << self.BITS, U), np.full(1 << self.BITS, -1, np.int32)
        self.ids, self.sizes, self.starts, self.made = array("i"), array("q"), array("q"), None

    def __len__(self) -> int:
        return len(self.sizes)

    def _append(self, piece: bytes) -> int:
        ids = self.make(piece)
        self.starts.append(len(self.ids))
        self.sizes.append(len(ids))
        self.ids.extend(ids)
        self.made = None
        return len(self.sizes) - 1

    def slot(self, piece: bytes) -> int:
        k = self.long.get(piece)
        if k is None:
            k = self.long[piece] = self._append(piece)
        return k

    def find(self, h: np.ndarray) -> np.ndarray:
        """The places of hashes, -1 of those that aren't there."""
        mask = U(len(self.keys) - 1)
        out = np.full(len(h), -1, np.int64)
        open_, at = np.arange(len(h)), h & mask
        while len(open_):
            place = self.places[at]
            out[open_] = place
            wrong = (place >= 0) & (self.keys[at] != h[open_])  # another's: look further
            out[open_[wrong]] = -1
            open_, at = open_[wrong], at[wrong] + U(1) & mask
        return out

    def add(self, h: np.ndarray, new: list[bytes]) -> np.ndarray:
        """Places for distinct new hashes and their pieces."""
        made = np.array([self._append(p) for p in new], np.int64)
        if 2 * len(self) > len(self.keys):
            old, kept = self.keys[self.places >= 0], self.places[self.places >= 0]
            size = 1 << (4 * len(self)).bit_length()
            self.keys, self.places = np.zeros(size, U), np.full(size, -1, np.int32)
            self._put(old, kept)
        self._put(h, made)
        return made

    def _put(self, h: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.keys) - 1
        for x, k in zip(h.tolist(), places.tolist()):
            at = x & mask
            while self.places[at] >= 0:
                at = at + 1 & mask
            self.keys[at], self.places[at] = x, k

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.made is None:
            self.made = np.array(self.ids, np.int32), np.array(self.sizes, np.int64), np.array(self.starts, np.int64)
        return self.made


class _Pieces(dict):
    """The packed ids of a piece, made on first use."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.kind = encoder, "I" if encoder.wide else "H"

    def __missing__(self, piece: str) -> bytes:
        self[piece] = packed = array(self.kind, self.encoder.piece(piece.encode())).tobytes()
        return packed


class Document:
    """A text with its pieces and their prefix tables, kept up to date through appends and edits."""

    BACK = 4  # pieces that what follows them may still change

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.spans: list[tuple[int, int]] = []
        self.tables: list[list[int]] = []
        self.redone = 0  # bytes whose last token was computed, for tests
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.encoder.back(table)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, more: str) -> None:
        """Put more in place of text[start:end]; what is far from the edit is kept."""
        text, shift = self.text[:start] + more + self.text[end:], len(more) - (end - start)
        first = 0
        while first < len(self.spans) and self.spans[first][1] < start:
            first += 1
        first = max(0, first - self.BACK)
        at = self.spans[first][0] if first < len(self.spans) else len(self.text)
        old = {s + shift: i for i, (s, _) in enumerate(self.spans) if s >= end}
        spans, tables = self.spans[:first], self.tables[:first]
        before = dict(zip(self.spans[first:], self.tables[first:]))
        for m in self.encoder.pattern.finditer(text, at):
            s = m.start()
            if s in old and s > start + len(more):
                i = old[s]
                spans += [(a + shift, b + shift) for a, b in self.spans[i:]]
                tables += self.tables[i:]
                break
            data, table = m.group().encode(), []
            for (a, b), t in before.items():
                if a == s and b <= start:  # same beginning: its prefixes keep their last tokens
                    same = self.text[a:b].encode()
                    if data.startswith(same):
                        table = t[: len(same)]
            self.redone += len(data) - len(table)
            spans.append(m.span())
            tables.append(self.encoder.extend(data, table, len(data)))
        self.text, self.spans, self.tables = text, spans, tables


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder_at(path: str, pattern: str = PATTERN) -> Encoder:
    """One per worker process and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder.load(path, pattern)
    return _LOADED[path, pattern]


def _shipped(df: DataFrame, path: str) -> str:
    """Send the vocabulary to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return Path(path).name


def encode(df: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", out_col: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """Replace the text column by its ids, an array of integers, in a column at the end."""
    name, at = _shipped(df, vocabulary), place(df, text_col, [out_col])

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        e, texts = encoder_at(SparkFiles.get(name), pattern), b.column(at)
        if pattern == PATTERN:
            flat, off = e.rows(*utf8(texts))
        else:
            ids = [e.ids(t) if t is not None else np.zeros(0, np.uint16) for t in texts.to_pylist()]
            flat, off = np.concatenate([np.zeros(0, np.uint16), *ids]), np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32)), mask=texts.is_null())
        return [*(c for i, c in enumerate(b.columns) if i != at), lists]

    return with_arrow(df, make, [(out_col, "ARRAY<INT>")], (text_col,), keep=[c for c in df.columns if c not in (text_col, out_col)])


def recoded(df: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Replace the text column by its ids and by what these are decoded to, both in one worker."""
    name, at = _shipped(df, vocabulary), place(df, text_col, [ids_col, out_col])

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        e, texts = encoder_at(SparkFiles.get(name), PATTERN), b.column(at)
        flat, off = e.rows(*utf8(texts))
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), mask=texts.is_null())
        again = pa.array([t if ok else None for t, ok in zip(e.texts(flat, off), texts.is_valid().to_pylist())], pa.string())
        return [*(c for i, c in enumerate(b.columns) if i != at), lists, again]

    return with_arrow(df, make, [(ids_col, "ARRAY<INT>"), (out_col, "STRING")], (text_col,), keep=[c for c in df.columns if c not in (text_col, ids_col, out_col)])


def counted(df: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Replace the text column by the number of its tokens; a null text has none."""
    name, at = _shipped(df, vocabulary), place(df, text_col, [out_col])

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        e = encoder_at(SparkFiles.get(name), PATTERN)
        return [*(c for i, c in enumerate(b.columns) if i != at), pa.array(e.counts(*utf8(b.column(at))))]

    return with_arrow(df, make, [(out_col, "BIGINT")], (text_col,), keep=[c for c in df.columns if c not in (text_col, out_col)])


def decode(df: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids", out_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Replace the ids by their text, in a column at the end."""
    name, at = _shipped(df, vocabulary), place(df, ids_col, [out_col])

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        e, lists = encoder_at(SparkFiles.get(name), pattern), b.column(at)
        off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        texts = e.texts(lists.flatten().to_numpy(zero_copy_only=False), off)
        texts = [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
        return [*(c for i, c in enumerate(b.columns) if i != at), pa.array(texts, pa.string())]

    return with_arrow(df, make, [(out_col, "STRING")], (ids_col,), keep=[c for c in df.columns if c not in (ids_col, out_col)])
