"""Approximate nearest neighbours with shifted space-filling curves.

Vectors are projected on a few random axes, shifted at random and put in the order of a Hilbert curve;
several such curves have different axes and shifts. Each order is range-partitioned and sorted by Spark, rows
get their exact ranks, and every vector is compared with all those within a window of ranks; the best of all
curves are merged and ranked by their similarity. The width of the window and the number of curves
are not guessed: exact neighbours of a sample of vectors show how far apart ranks are, and the cheapest choice
that holds TARGET of them is taken. Where vectors have no structure that a curve could follow, windows grow towards
the whole table, and the search costs what comparing all with all would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, spread, written

#: Neighbours of each vector.
NEIGHBOURS = 10
#: Share of the exact neighbours of the sample that windows hold.
TARGET = 0.95
#: Vectors of the sample, those with the smallest hashes of their ids.
SAMPLE = 400
#: Curves, at least and at most.
LEAST_CURVES, MOST_CURVES = 4, 8
#: Axes that a curve runs through and bits of each.
AXES, BITS = 6, 10
#: Rows of a block of ranks, at least and at most, and of a tile of similarities.
LEAST_BLOCK, MOST_BLOCK = 1024, 16_384
TILE = 2048
SEED = 7

OUT = "vec_id long, neighbour_id long, similarity double"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits, by Skilling's transform."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    q = 1 << bits - 1
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c ^ t) >> b & 1
    return key


def curve(c: int, size: int, mean: np.ndarray, scale: float):
    """(axes, shift, mean, scale) of curve c; the same for the same seed."""
    rng = np.random.default_rng((SEED, c))
    axes = np.linalg.qr(rng.standard_normal((size, min(AXES, size))))[0]
    return axes, rng.random(axes.shape[1]), mean, scale


def curve_keys(v: np.ndarray, curve_) -> np.ndarray:
    axes, shift, mean, scale = curve_
    z = np.clip((v - mean) @ axes / scale, -30, 30)
    u = (1 / (1 + np.exp(-1.702 * z)) + shift) / 2  # about even between shift / 2 and (shift + 1) / 2
    return hilbert((u * (1 << BITS)).astype(np.int64), BITS)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors stored as bytes of 32-bit floats."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, size)


def _normal(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(v).max(axis=1, keepdims=True)
                ok = np.isfinite(v).all(axis=1) & (top[:, 0] > 0)
                v = v[ok] / top[ok]
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(ok)), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "v"])

    return run


def _moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(size), 0.0
        for batch in batches:
            v = _matrix(batch["v"], size).astype(np.float64)
            n, s, q = n + len(v), s + v.sum(axis=0), q + float((v * v).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([q])], ["n", "s", "q"])

    return run


class Best:
    """The k most similar ids of what was shown, for each of some vectors; an id with several vectors counts by the most similar."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.near = np.full((len(ids), k), -1, dtype=np.int64)
        self.sims = np.full((len(ids), k), -np.inf, dtype=np.float32)

    def show(self, ids: np.ndarray, v: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        for a in range(0, len(self.ids), TILE):
            own = slice(a, a + TILE)
            for b in range(0, len(ids), TILE):
                self._tile(own, ids[b : b + TILE], v[b : b + TILE])

    def _tile(self, own: slice, ids: np.ndarray, v: np.ndarray) -> None:
        s = self.v[own] @ v.T
        begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if len(begins) < len(ids):
            s, ids = np.maximum.reduceat(s, begins, axis=1), ids[begins]
        mine = self.ids[own]
        lo, hi = np.searchsorted(ids, mine, "left"), np.searchsorted(ids, mine, "right")
        for r in np.flatnonzero(hi > lo).tolist():
            s[r, lo[r] : hi[r]] = -np.inf
        least = self.sims[own, -1]
        if np.isneginf(least).any() and s.shape[1] > self.k:
            least = np.maximum(least, np.nextafter(np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k], np.float32(-np.inf), dtype=np.float32))
        r, c = np.nonzero(s > least[:, None])
        if not len(r):
            return
        hit = np.unique(r)
        old = np.repeat(hit, self.k)
        row = np.concatenate([old, r])
        sim = np.concatenate([self.sims[own][hit].reshape(-1), s[r, c]])
        near = np.concatenate([self.near[own][hit].reshape(-1), ids[c]])
        by = np.lexsort((-sim, near, row))
        row, sim, near = row[by], sim[by], near[by]
        again = np.zeros(len(row), dtype=bool)  # ids that were shown before or come in several tiles; free places are left
        again[1:] = (row[1:] == row[:-1]) & (near[1:] == near[:-1]) & (sim[1:] > -np.inf)
        row, sim, near = row[~again], sim[~again], near[~again]
        by = np.lexsort((near, -sim, row))
        row, sim, near = row[by], sim[by], near[by]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        keep = place < self.k
        at = row[keep] + own.start
        self.sims[at, place[keep]], self.near[at, place[keep]] = sim[keep], near[keep]

    def batch(self) -> pa.RecordBatch:
        r, c = np.nonzero(self.sims > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.near[r, c]), pa.array(self.sims[r, c].astype(np.float64))], ["vec_id", "neighbour_id", "similarity"])


def _sampled(ids: np.ndarray, v: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, v, k)
        for batch in batches:
            best.show(batch["id"].to_numpy(), _matrix(batch["v"], v.shape[1]))
        yield best.batch()

    return run


def _keyed(size: int, mean: np.ndarray, scale: float, curves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_curves = [curve(c, size, mean, scale) for c in range(curves)]
        for batch in batches:
            v = _matrix(batch["v"], size)
            for c, x in enumerate(all_curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, dtype=np.int32)), pa.array(curve_keys(v, x)), batch["id"], batch["v"]], ["curve", "key", "id", "v"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch["curve"], pa.array(np.full(size, part, dtype=np.int32)), pa.array(np.arange(n, n + size)), batch["id"], batch["v"]], ["curve", "part", "place", "id", "v"]
        )
        n += size


def _searched(size: int, k: int):
    """Rows sorted by block, those of the block itself before its surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, held = None, None, []

        def begin():
            nonlocal best
            ids, v = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held.clear()
            best = Best(ids, v, k)
            best.show(ids, v)

        for batch in batches:
            block, other = batch["block"].to_numpy(), batch["other"].to_numpy(zero_copy_only=False)
            ids, v = batch["id"].to_numpy(), _matrix(batch["v"], size)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(other.astype(np.int8)) != 0)) + 1, [len(block)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if block[a] != at:
                    if held:
                        begin()
                    if best:
                        yield best.batch()
                    at, best = block[a], None
                if not other[a]:
                    held.append((ids[a:b], v[a:b]))
                else:
                    if held:
                        begin()
                    if best:
                        best.show(ids[a:b], v[a:b])
        if held:
            begin()
        if best:
            yield best.batch()

    return run


def choose(gaps: np.ndarray, n: int) -> tuple[int, int]:
    """(curves, window) of the least cost that holds TARGET of the sample. gaps: ranks apart, by curve and pair."""
    options = []
    for c in range(min(LEAST_CURVES, len(gaps)), len(gaps) + 1):
        apart = np.sort(gaps[:c].min(axis=0))
        window = int(apart[min(len(apart) - 1, int(np.ceil(TARGET * len(apart))))]) if len(apart) else 1
        options.append((c * (2 * min(window, n) + LEAST_BLOCK), c, max(1, window)))
    return min(options)[1:]


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, neighbour_id, similarity, rank): the k most similar vectors of every vector, by cosine.

    Equal similarities go by neighbour_id. Null ids and vectors, vectors with null, infinite or no entries
    or only zeros, and those whose length isn't the most common one (the longest of such) take no part. Rows that share an id
    are not each other's neighbours, and their neighbours are listed together. With fewer
    vectors than k + 1 all others are listed; an empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], OUT + ", rank int")
    size = sizes[0]["size"]
    base = rows.where(F.size("v") == size).mapInArrow(_normal(size), "id long, v binary")
    base = written(base.dropDuplicates(["id", "v"]), "ann-vectors")
    parts = base.mapInArrow(_moments(size), "n long, s array<double>, q double").collect()
    n = sum(r["n"] for r in parts)
    if not n:
        return spark.createDataFrame([], OUT + ", rank int")
    mean = sum(np.array(r["s"]) for r in parts) / n
    scale = max(1e-9, float(np.sqrt(max(0.0, sum(r["q"] for r in parts) / n - mean @ mean) / size)))

    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample_v = np.frombuffer(b"".join(sample["v"].to_pylist()), dtype=np.float32).reshape(-1, size)
    exact = base.mapInArrow(_sampled(sample["id"].to_numpy(), sample_v, k), OUT)
    by_sim = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id")
    exact = exact.groupBy("vec_id", "neighbour_id").agg(F.max("similarity").alias("similarity")).withColumn("r", F.row_number().over(by_sim)).where(F.col("r") <= k)
    pairs = [(r["vec_id"], r["neighbour_id"]) for r in exact.collect()]

    tasks = spread(spark, n * MOST_CURVES * (4 * size + 24), 16 << 20)
    keyed = base.mapInArrow(_keyed(size, mean, scale, MOST_CURVES), "curve int, key long, id long, v binary")
    sorted_ = keyed.repartitionByRange(tasks, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    numbered = written(sorted_.mapInArrow(_numbered, "curve int, part int, place long, id long, v binary"), "ann-curves")
    counts = numbered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("start"))
    ranked = numbered.join(F.broadcast(starts), ["curve", "part"]).select("curve", (F.col("start") + F.col("place")).alias("rank"), "id", "v")

    wanted = spark.createDataFrame([(i,) for i in {x for p in pairs for x in p}], "id long")
    found: dict[tuple[int, int], list[int]] = {}
    for r in ranked.join(F.broadcast(wanted), "id", "left_semi").select("curve", "id", "rank").collect():
        found.setdefault((r["curve"], r["id"]), []).append(r["rank"])
    gaps = np.array([[min(abs(x - y) for x in found[c, a] for y in found[c, b]) for a, b in pairs] for c in range(MOST_CURVES)]).reshape(MOST_CURVES, -1)
    curves, window = choose(gaps, n)

    block_rows = min(MOST_BLOCK, max(LEAST_BLOCK, window))
    blocks, reach = -(-n // block_rows), -(-window // block_rows)
    own = F.floor(F.col("rank") / block_rows)
    near = F.explode(F.sequence(F.greatest(own - reach, F.lit(0)), F.least(own + reach, F.lit(blocks - 1))))
    sent = ranked.where(F.col("curve") < curves).select("curve", own.alias("home"), near.alias("to"), "id", "v")
    sent = sent.select((F.col("curve") * F.lit(blocks) + F.col("to")).cast("long").alias("block"), (F.col("home") != F.col("to")).alias("other"), "id", "v")
    searches = min(curves * blocks, max(parallelism(spark), curves * blocks // 8))
    sent = sent.repartitionById(searches, F.floor(F.col("block") * searches / F.lit(curves * blocks)).cast("int")).sortWithinPartitions("block", "other")
    hits = sent.mapInArrow(_searched(size, k), OUT)
    merged = hits.repartition(spread(spark, n * k * curves * 24, 32 << 20), "vec_id").groupBy("vec_id", "neighbour_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))
    return merged.withColumn("rank", F.row_number().over(by_sim)).where(F.col("rank") <= k)
