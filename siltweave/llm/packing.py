"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

Lengths are tokens of the byte-level BPE. Documents longer than a sequence are cut into full pieces and a rest, as in best-fit
packing; full pieces fill a bin alone. The rests are dealt by hash into pools of about
``pool`` pieces, so the work of a pool doesn't grow with the corpus. Each pool is solved
by several islands. A chromosome is a list of bins (groups of pieces). Crossover injects
well-filled bins of one parent into the other, drops the bins of the other that hold a
piece injected as well, and puts the displaced pieces back by best fit; mutation empties
the least filled bins and a few others. Between epochs each island sends its best chromosome to the next
island of its pool: a shuffle of one row per island. The best of all islands is the result.

Fewer bins are better; of as many, those whose mean square fill is larger, so that the room that is left comes together in
few bins and most sequences are full. Best-fit decreasing, from which every island starts, is often
at the least number of bins, and seldom at the best fill. Evolution ends early only where neither can be improved.

Defined results: null and empty texts have length 0 and form a piece that
takes no room (its bin_id and start are null); white space has tokens like any other text; repeated rows are pieces of
their own, told apart by ``copy``; null ids are packed as any other; an empty table gives an empty result; other columns
are dropped, so their names can't clash.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from siltweave.llm import bpe
from siltweave.llm.text import column
from siltweave.session import written

CAPACITY = 2048
POOL, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 1024, 3, 6, 2, 40

Bin = tuple[int, list[int]]  # what it holds together, and its pieces


class Space:
    """Open bins by the room left in them: the tightest that fits is found in a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room = capacity, 0, {}

    def add(self, room: int, bin_no: int) -> None:
        if room > 0:
            self.by_room.setdefault(room, []).append(bin_no)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        above = self.mask >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        bins = self.by_room[room]
        b = bins.pop()
        if not bins:
            self.mask ^= 1 << room
        return b, room


def best_fit(bins: list[Bin], loose: list[int], sizes: list[int], capacity: int) -> list[Bin]:
    """Put loose pieces, in order of decreasing size, into the fullest bins that take them. The lists of bins that are given stay as they are."""
    space, new = Space(capacity), {}
    for i, (fill, _) in enumerate(bins):
        space.add(capacity - fill, i)
    n = len(bins)
    for x in sorted(loose, key=lambda x: (-sizes[x], x)):
        found = space.take(sizes[x])
        if found is None:
            new[n] = [x]
            space.add(capacity - sizes[x], n)
            n += 1
        else:
            i, room = found
            if i not in new:
                new[i] = list(bins[i][1])
            new[i].append(x)
            space.add(room - sizes[x], i)
    out = list(bins) + [(0, [])] * (n - len(bins))
    for i, xs in new.items():
        out[i] = (sum([sizes[x] for x in xs]), xs)
    return out


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Larger for fewer bins, then for fuller ones: the number of bins, negative, and their mean square fill."""
    return -len(bins), sum([fill * fill for fill, _ in bins]) / (max(len(bins), 1) * capacity**2)


def best_possible(sizes: list[int], capacity: int) -> tuple[int, float]:
    """A fitness that no packing passes: as few bins as the sum needs, all but one full."""
    total = sum(sizes)
    n = -(-total // capacity)
    return -n, ((n - 1) * capacity**2 + (total - (n - 1) * capacity) ** 2) / (n * capacity**2) if n else 0.0


def crossover(a: list[Bin], b: list[Bin], sizes: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    """b's well-filled bins, drawn at random among its fuller half, injected into a."""
    half = sorted(b, key=lambda g: -g[0])[: max(1, (len(b) + 1) // 2)]
    chosen = [g for g in half if rng.random() < 0.5] or half[:1]
    inside: set[int] = set()
    for _, xs in chosen:
        inside.update(xs)
    kept, loose = list(chosen), []
    for g in a:
        if inside.isdisjoint(g[1]):
            kept.append(g)
        else:
            loose += [x for x in g[1] if x not in inside]
    return best_fit(kept, loose, sizes, capacity)


def mutate(a: list[Bin], sizes: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    """Empty the two least filled bins and a few others, and put their pieces back, the others' first."""
    if len(a) < 2:
        return a
    order = sorted(range(len(a)), key=lambda i: a[i][0])
    drop = {*order[:2], *rng.sample(range(len(a)), min(6, len(a)))}
    loose = [x for i in sorted(drop) for x in a[i][1]]
    kept = [g for i, g in enumerate(a) if i not in drop]
    # some pieces at random first, so that the same bins don't come back
    rng.shuffle(loose)
    early = set(loose[: len(loose) // 3])
    return best_fit(best_fit(kept, list(early), sizes, capacity), [x for x in loose if x not in early], sizes, capacity)


def evolve(population: list[list[Bin]], sizes: list[int], capacity: int, generations: int, rng: random.Random) -> tuple[list[list[Bin]], int]:
    """The population, best first, and the generations that it took; fewer only if its best can't be improved."""
    best = best_possible(sizes, capacity)
    scored = sorted([(fitness(c, capacity), i, c) for i, c in enumerate(population)], reverse=True)
    n = len(scored)
    for k in range(generations):
        if n < 2 or scored[0][0] >= best:
            return [c for *_, c in scored], k
        i, j = rng.sample(range(max(2, (n + 1) // 2)), 2)
        child = crossover(scored[i][2], scored[j][2], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        f = fitness(child, capacity)
        if all(f != s for s, *_ in scored) or f[0] > scored[-1][0][0]:  # one of each fitness keeps the population diverse
            scored = sorted([*scored, (f, n + k, child)], key=lambda t: (t[0], t[1]), reverse=True)[:n]
    return [c for *_, c in scored], generations


def seed_population(sizes: list[int], capacity: int, count: int, rng: random.Random) -> list[list[Bin]]:
    """Best-fit decreasing, and variants of it that first placed a quarter of the pieces at random."""
    everything = list(range(len(sizes)))
    out = [best_fit([], everything, sizes, capacity)]
    while len(out) < count:
        some = rng.sample(everything, max(1, len(everything) // 4)) if everything else []
        bins: list[Bin] = []
        for x in some:  # next fit
            if bins and bins[-1][0] + sizes[x] <= capacity:
                bins[-1] = (bins[-1][0] + sizes[x], [*bins[-1][1], x])
            else:
                bins.append((sizes[x], [x]))
        inside = set(some)
        out.append(best_fit(bins, [x for x in everything if x not in inside], sizes, capacity))
    return out


def _labels(bins: list[Bin], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for i, (_, xs) in enumerate(bins):
        out[xs] = i
    return out


def _bins(labels: np.ndarray, sizes: list[int]) -> list[Bin]:
    out: list[list[int]] = [[] for _ in range(int(labels.max()) + 1)] if len(labels) else []
    for x, i in enumerate(labels.tolist()):
        out[i].append(x)
    return [(sum([sizes[x] for x in b]), b) for b in out if b]


def _epoch(rows: Iterator[pd.DataFrame], capacity: int, population: int, generations: int, epoch: int) -> Iterator[pd.DataFrame]:
    """A row is an island of a pool: sizes of its pieces, its chromosomes flattened, an immigrant, and the generations so far."""
    for pdf in rows:
        flat_out, took = [], []
        for pool, island, sizes, flat, guest, before in zip(pdf.pool, pdf.island, pdf.sizes, pdf.flat, pdf.guest, pdf.generations):
            size_list = [int(s) for s in sizes]
            n = len(size_list)
            rng = random.Random((int(pool) * 1009 + int(island)) * 31 + epoch)
            flat = np.asarray(flat, np.int32)
            chromosomes = [_bins(flat[i : i + n], size_list) for i in range(0, len(flat), n)] if len(flat) else seed_population(size_list, capacity, population, rng)
            if guest is not None and len(guest):
                chromosomes[-1] = _bins(np.asarray(guest, np.int32), size_list)
            done, k = evolve(chromosomes, size_list, capacity, generations, rng)
            flat_out.append(np.concatenate([_labels(c, n) for c in done]))
            took.append(before + k)
        yield pd.DataFrame({"pool": pdf.pool, "island": pdf.island, "sizes": pdf.sizes, "flat": flat_out, "generations": took})


_STATE = "pool BIGINT, island INT, sizes ARRAY<INT>, flat ARRAY<INT>, generations INT"


def pieces_of(docs: DataFrame, id_col: str, length, capacity: int) -> DataFrame:
    """(doc_id, copy, piece, offset, size): every piece of every row once."""
    d = docs.select(column(id_col).alias("doc_id"), F.greatest(F.lit(0), F.coalesce(length, F.lit(0))).cast("long").alias("total"))
    d = d.groupBy("doc_id", "total").agg(F.count("*").alias("n"))  # equal rows, to tell copies apart
    d = d.withColumn("first", F.coalesce(F.sum("n").over(W.partitionBy("doc_id").orderBy("total").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.select("doc_id", "total", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("copy"))
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / capacity) - 1)
    d = d.select("doc_id", "copy", "total", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    return d.select("doc_id", "copy", "piece", (F.col("piece") * capacity).alias("offset"), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("size"))


def islands_of(parts: DataFrame, capacity: int, pool: int, islands: int, population: int, epochs: int, generations: int) -> tuple[DataFrame, DataFrame]:
    """The pools of pieces that share bins, (pool, items), and the islands' last populations."""
    spark = parts.sparkSession
    movable = parts.filter((F.col("size") > 0) & (F.col("size") < capacity))
    pools = max(1, -(-movable.count() // pool))
    loose = movable.withColumn("pool", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(pools)))
    items = F.sort_array(F.collect_list(F.struct("size", "doc_id", "copy", "piece", "offset")))
    per_pool = written(loose.groupBy("pool").agg(items.alias("items")), "pools")
    state = per_pool.select("pool", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.size").alias("sizes"), F.array().cast("array<int>").alias("flat"), F.lit(None).cast("array<int>").alias("guest"), F.lit(0).alias("generations"))
    tasks = max(1, min(pools * islands, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    for epoch in range(epochs):
        if epoch:
            # the elite, first in flat, moves to the next island
            elite = state.select("pool", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("flat", F.lit(1), F.size("sizes")).alias("guest"))
            state = state.join(elite, ["pool", "island"])
        state = state.select("pool", "island", "sizes", "flat", "guest", "generations").repartition(tasks, "pool", "island")
        state = written(state.mapInPandas(lambda it, e=epoch: _epoch(it, capacity, population, generations, e), _STATE), f"islands-{epoch}")
    return per_pool, state


def _elite(batches: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for pool, island, sizes, flat, took in zip(pdf.pool, pdf.island, pdf.sizes, pdf.flat, pdf.generations):
            bins, filled, start = np.asarray(flat[: len(sizes)]), {}, np.zeros(len(sizes), np.int32)
            for i in range(len(sizes) - 1, -1, -1):  # the larger ones first
                start[i] = filled.get(bins[i], 0)
                filled[bins[i]] = int(start[i]) + int(sizes[i])
            few, fill = fitness([(f, []) for f in filled.values()], capacity)
            rows.append((pool, island, few, fill, bins, start, took))
        yield pd.DataFrame(rows, columns=["pool", "island", "bins", "fill", "bin", "start", "generations"])


def elites(state: DataFrame, capacity: int) -> DataFrame:
    """The best chromosome of each island: its fitness, the bin of each piece, and where it begins there."""
    return state.mapInPandas(lambda it: _elite(it, capacity), "pool BIGINT, island INT, bins INT, fill DOUBLE, bin ARRAY<INT>, start ARRAY<INT>, generations INT")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, pool: int = POOL, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS, length=None, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, copy, piece, offset, size, bin_id, start): tokens offset to offset + size of a document stand at start in a bin.

    A length is a count of the text's tokens unless a column is given.
    """
    if length is None:
        docs = bpe.counted(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), vocabulary, "text", "n_tokens")
        id_col, length = "doc_id", F.col("n_tokens")
    parts = written(pieces_of(docs, id_col, length, capacity), "pieces")
    per_pool, state = islands_of(parts, capacity, pool, islands, population, epochs, generations)
    best = elites(state, capacity).groupBy("pool").agg(F.max_by(F.struct("bin", "start"), F.struct("bins", "fill", "island")).alias("x")).select("pool", "x.*")
    placed = per_pool.join(best, "pool").select("pool", F.explode(F.arrays_zip("items", "bin", "start")).alias("x"))
    cols = ["doc_id", "copy", "piece", "offset", "size"]
    inside = placed.select(*[F.col(f"x.items.{c}").alias(c) for c in cols], F.concat(F.lit("p"), "pool", F.lit("-"), "x.bin").alias("bin_id"), F.col("x.start").alias("start"))
    alone = F.concat_ws("-", F.lit("w"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy", "piece")
    whole = parts.filter((F.col("size") <= 0) | (F.col("size") >= capacity)).select(*cols, F.when(F.col("size") > 0, alone).alias("bin_id"), F.when(F.col("size") > 0, 0).alias("start"))
    return inside.unionByName(whole)
