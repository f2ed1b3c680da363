"""Near duplicates by SimHash, searched with the general pigeonhole principle.

A document has two signatures of 128 bits: of its distinct words, which is searched, and of its runs of
three words, which confirms. Bits that vary together are grouped into partitions. A partition p has
its own threshold t(p) of at least -1 (not probed) with sum(t(p) + 1) > TAU: two signatures within TAU then
differ by at most t(p) in some partition. The thresholds come from dynamic programming over estimated
numbers of candidates, taken from the histograms of values of all signatures. The fewer and wider the partitions,
the fewer the candidates and the more values to probe, so their number is the one of PARTITIONS with the least estimated
work: more signatures get wider partitions. Documents meet in a
partition when they agree on one of its t(p) + 1 pieces; each task compares the values, probes those within t(p)
and verifies the pairs on the whole signatures. A piece's value that very many documents share is split into
blocks of documents, each two of which are compared in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, fresh, release, spread, written
from .tokens import chunks, mixed, split

#: Largest distance of near duplicates' word signatures, of 128 bits.
TAU = 18
#: Largest distance of their signatures of word triples, of 128 bits; unrelated texts have 64, give or take 6.
CONFIRM = 40
#: Numbers of partitions to choose from, and the thresholds of a partition that are considered.
PARTITIONS = (8, 6, 5, 4)
MOST = 4
#: Bits of the values whose histograms are counted; a wider partition is taken as such parts side by side.
FINE = 16
#: Work of probing a value, in comparisons of candidates.
PROBE = 6.0
#: Rows of a probing task, about, candidate pairs that it compares at once, and rows of a key from which it is split into blocks.
TASK_ROWS = 300_000
BLOCK = 1 << 19
KEY_ROWS = 4_000_000
#: Documents to remove that may be broadcast (about 100 MB), so that texts stay where they are; more are joined by a shuffle.
BROADCAST_GONE = 2_000_000

_SEEDS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0x5851F42D4C957F2D)]
_COLUMNS = ["a", "b", "c", "d"]
_KEYED = ["key", "block", "node", *_COLUMNS]
#: Bits of a key below the number of its piece, and blocks of a key that have numbers.
_SHIFT, BLOCKS = 32, 2048


#: The bits of a byte as eight 8-bit counters, and how many of them may be added.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
_FULL = 255


def _sums(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """128-bit SimHashes of runs of hashes: two uint64 for each run."""
    out = np.empty((len(begins), 2), dtype=np.uint64)
    size = np.diff(np.append(begins, len(hashes)))
    parts = -(-size // _FULL)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(begins, parts) + _FULL * (np.arange(parts.sum()) - np.repeat(first, parts))
    for i, seed in enumerate(_SEEDS):
        lanes = np.take(_LANES, mixed(hashes ^ seed).view(np.uint8)).reshape(-1, 8)
        ones = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8)
        ones = np.add.reduceat(ones, first, axis=0, dtype=np.int32)
        out[:, i] = np.packbits(ones * 2 >= size[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the texts that have words, their signatures: uint64 in four columns)."""
    w = split(texts)
    if not len(w.starts):
        return np.empty(0, dtype=np.int64), np.empty((0, 4), dtype=np.uint64)
    _, one = np.unique(mixed(w.hashes ^ (w.doc.astype(np.uint64) << np.uint64(40))), return_index=True)
    one.sort()
    begins = np.flatnonzero(np.diff(w.doc[one], prepend=-1))
    words = _sums(w.hashes[one], begins)
    triple = w.hashes.copy()
    for k, odd in ((1, 0x9FB21C651E98DF25), (2, 0xD6D8A5B3C1F2E497)):
        same = w.doc[k:] == w.doc[:-k]
        triple[:-k] += np.where(same, w.hashes[k:], np.uint64(0)) * np.uint64(odd)
    # a run that the end of the text cuts short only counts where it is the first
    ahead = np.minimum(np.arange(len(w.doc)) + 2, len(w.doc) - 1)
    first = np.diff(w.doc, prepend=-1) != 0
    use = ((w.doc[ahead] == w.doc) & (ahead == np.arange(len(w.doc)) + 2)) | first
    begins = np.flatnonzero(np.diff(w.doc[use], prepend=-1))
    return w.doc[first], np.hstack([words, _sums(triple[use], begins)])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        at, s = signatures(batch["text"])
        yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(at)) for c in ("id", "h")), *(pa.array(s[:, i].view(np.int64)) for i in range(4))], ["id", "h", *_COLUMNS])


def bit(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    return ((a if i < 64 else b) >> np.uint64(i % 64)) & np.uint64(1)


def part_values(a: np.ndarray, b: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(a), dtype=np.int64)
    for j, i in enumerate(bits):
        out |= bit(a, b, i).astype(np.int64) << j
    return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are both set, for each two (i * 128 + j, i <= j), and -1: the number of signatures."""
    both, n = np.zeros((128, 128)), 0
    for batch in batches:
        s = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in "ab"], axis=1).view(np.uint8)
        x = np.unpackbits(s, axis=1, bitorder="little").astype(np.float32)
        both += x.T @ x
        n += len(x)
    i, j = np.triu_indices(128)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i * 128 + j, -1)), pa.array(np.append(both[i, j], n).astype(np.int64))], ["k", "n"])


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 128 bits in partitions: from the most correlated bit left, each time the bit that correlates most with the partition."""
    p = np.diag(both) / max(n, 1)
    spread_ = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread_, spread_))
    np.fill_diagonal(corr, 0)
    left, out = list(range(128)), []
    while left:
        width = -(-len(left) // (parts - len(out)))
        own = [max(left, key=lambda i: (corr[i, left].sum(), -i))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda i: (corr[i, own].sum(), -i)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def fine(bits: list[int]) -> list[list[int]]:
    """A partition's bits in as few parts of at most FINE as will do."""
    n = -(-len(bits) // FINE)
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _histograms(blocks: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << len(bits), dtype=np.int64) for bits in blocks]
        for batch in batches:
            a, b = (batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in "ab")
            for total, bits in zip(totals, blocks):
                total += np.bincount(part_values(a, b, bits), minlength=len(total))
        for i, total in enumerate(totals):
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k | i << FINE), pa.array(total[k])], ["k", "n"])

    return run


def masks(width: int, most: int) -> list[list[int]]:
    """By distance: the masks of `width` bits with so many set."""
    return [[sum(1 << i for i in c) for c in combinations(range(width), d)] for d in range(most + 1)]


def close(histogram: np.ndarray, width: int) -> np.ndarray:
    """For each distance up to MOST: ordered pairs of documents whose values are that far apart."""
    h, at = histogram.astype(float), np.arange(len(histogram))
    rings = [h] + [np.zeros_like(h) for _ in range(MOST)]  # documents at each distance from each value
    for i in range(width):
        for d in range(MOST, 0, -1):
            rings[d] = rings[d] + rings[d - 1][at ^ (1 << i)]
    return np.array([float(h @ r) for r in rings])


def estimate(pairs: list[np.ndarray], width: int, n: int) -> list[float]:
    """The work of each threshold from -1 to MOST: candidates, as if the parts of a partition were independent, and probes."""
    share = np.array([1.0] + [0.0] * MOST)
    for x in pairs:
        share = np.convolve(share, x / max(n, 1) ** 2)[: MOST + 1]
    candidates = np.cumsum(share) * n * n / 2
    values = min(n, 1 << width)
    probes = [values * sum(comb(width - width // (t + 1), d) for d in range(t + 1)) * (t + 1) for t in range(MOST + 1)]
    return [0.0, *(float(c + PROBE * v) for c, v in zip(candidates, probes))]


def allocate(costs: list[list[float]], tau: int) -> list[int]:
    """The thresholds, one for each partition, with sum(t + 1) = tau + 1 and the least sum of costs[p][t + 1]; none if there are no such."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * (tau + 1)
    for c in costs:
        new: list[tuple[float, list[int]] | None] = [None] * (tau + 2)
        for s, x in enumerate(best):
            for u, cost in enumerate(c):
                if x and s + u <= tau + 1 and (new[s + u] is None or x[0] + cost < new[s + u][0]):
                    new[s + u] = (x[0] + cost, [*x[1], u - 1])
        best = new
    return best[tau + 1][1] if best[tau + 1] else []


def pieces(bits: list[int], t: int) -> list[tuple[int, int]]:
    """(first, end) of the t + 1 pieces of a partition's value."""
    cuts = [len(bits) * i // (t + 1) for i in range(t + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def _keys(parts: list[list[int]], thresholds: list[int], blocks):
    """For each document a row for every piece of every probed partition; with keys in blocks, one for each two blocks that it takes part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in "ab")
            for p, (bits, t) in enumerate(zip(parts, thresholds)):
                value = part_values(a, b, bits) if t >= 0 else None
                for s, (lo, hi) in enumerate(pieces(bits, t) if t >= 0 else []):
                    key = (value >> lo) & ((1 << hi - lo) - 1) | (p * 8 + s) << _SHIFT
                    own = blocks.value.get(p * 8 + s)
                    if own is None:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), dtype=np.int32)), *(batch[c] for c in ("node", *_COLUMNS))], _KEYED)
                        continue
                    many = own[np.minimum(np.searchsorted(own[:, 0], key), len(own) - 1)]
                    many = np.where(many[:, 0] == key, many[:, 1], 1)
                    block = (mixed(batch["node"].to_numpy().view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
                    row = np.repeat(np.arange(len(key)), many)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    low, high = np.minimum(block[row], other), np.maximum(block[row], other)
                    salted = key[row] | (low * BLOCKS + high) << _SHIFT + 8
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(salted), pa.array(block[row].astype(np.int32)), *(batch[c].take(take) for c in ("node", *_COLUMNS))], _KEYED)

    return run


def _key_counts(parts: list[list[int]], thresholds: list[int]):
    """The number of documents with each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in "ab")
            for p, (bits, t) in enumerate(zip(parts, thresholds)):
                value = part_values(a, b, bits) if t >= 0 else None
                for s, (lo, hi) in enumerate(pieces(bits, t) if t >= 0 else []):
                    key, n = np.unique((value >> lo) & ((1 << hi - lo) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key | (p * 8 + s) << _SHIFT), pa.array(n)], ["key", "n"])

    return run


def _crossed(start: np.ndarray, count: np.ndarray, p: np.ndarray, q: np.ndarray):
    """Blocks of (i, j) of the rows of runs p[k] with those of runs q[k]; where p[k] is q[k], each two rows once."""
    n = count[p] * count[q]
    at, size = 0, np.cumsum(n)
    while at < len(p):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + BLOCK, "right")))
        if end == at + 1 and n[at] > BLOCK:  # one huge pair of runs, by rows of the first
            step = max(1, BLOCK // int(count[q[at]]))
            other = np.arange(start[q[at]], start[q[at]] + count[q[at]])
            for r in range(int(start[p[at]]), int(start[p[at]] + count[p[at]]), step):
                rows = np.arange(r, min(r + step, int(start[p[at]] + count[p[at]])))
                i, j = np.repeat(rows, len(other)), np.tile(other, len(rows))
                keep = (i < j) if p[at] == q[at] else slice(None)
                yield i[keep], j[keep]
        else:
            k = np.repeat(np.arange(at, end), n[at:end])
            within = np.arange(len(k)) - np.repeat(size[at:end] - n[at:end] - base, n[at:end])
            i, j = start[p[k]] + within // count[q[k]], start[q[k]] + within % count[q[k]]
            keep = (p[k] != q[k]) | (i < j)
            yield i[keep], j[keep]
        at = end


def _probe(parts: list[list[int]], thresholds: list[int], tau: int, confirm: int):
    rings = [[m for ring in masks(len(bits), t) for m in ring] if t >= 0 else [] for bits, t in zip(parts, thresholds)]
    all_pieces = [(p, s, lo, hi) for p, t in enumerate(thresholds) if t >= 0 for s, (lo, hi) in enumerate(pieces(parts[p], t))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([(c, pa.int32() if c == "block" else pa.int64()) for c in _KEYED]))
        key, ids, blocks = (table[c].to_numpy() for c in ("key", "node", "block"))
        sig = [table[c].to_numpy().view(np.uint64) for c in _COLUMNS]
        kind = key >> _SHIFT
        places = {p * 8 + s: (n, p, s, lo, hi) for n, (p, s, lo, hi) in enumerate(all_pieces)}
        for k in np.unique(kind).tolist():
            n, p, s, lo, hi = places[k & 255]
            apart = (k >> 8) // BLOCKS != (k >> 8) % BLOCKS  # two blocks, whose own pairs are found elsewhere
            rows = np.flatnonzero(kind == k)
            if len(rows) < 2:
                continue
            value = part_values(sig[0][rows], sig[1][rows], parts[p])
            order = np.argsort(value, kind="stable")
            rows, value = rows[order], value[order]
            start = np.flatnonzero(np.diff(value, prepend=-1))
            count, runs = np.diff(np.append(start, len(value))), value[start]
            a, b, c, d = (x[rows] for x in sig)
            inside = ((1 << hi - lo) - 1) << lo
            block = blocks[rows]
            for mask in rings[p]:
                if mask & inside:
                    continue
                to = np.minimum(np.searchsorted(runs, runs ^ mask), len(runs) - 1)
                hit = np.flatnonzero((runs[to] == runs ^ mask) & (runs <= runs[to]))
                for i, j in _crossed(start, count, hit, to[hit]):
                    if apart:
                        other = block[i] != block[j]
                        i, j = i[other], j[other]
                    near = np.bitwise_count(a[i] ^ a[j]).astype(np.int16) + np.bitwise_count(b[i] ^ b[j])
                    keep = np.flatnonzero(near <= tau)
                    i, j = i[keep], j[keep]
                    keep = np.bitwise_count(c[i] ^ c[j]).astype(np.int16) + np.bitwise_count(d[i] ^ d[j]) <= confirm
                    i, j = i[keep], j[keep]
                    for p2, s2, lo2, hi2 in all_pieces[:n]:  # pairs that an earlier piece finds
                        if not len(i):
                            break
                        x = part_values(a[i] ^ a[j], b[i] ^ b[j], parts[p2])
                        fresh_ = (np.bitwise_count(x) > thresholds[p2]) | (x >> lo2 & ((1 << hi2 - lo2) - 1) != 0)
                        i, j = i[fresh_], j[fresh_]
                    if len(i):
                        u, v = ids[rows[i]], ids[rows[j]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])
        del table
        release()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the edges (u, v): root is the smallest node that paths lead to; a root itself isn't listed.

    Large-star and small-star steps in turn, each round written to the shared folder in place of the last, until nothing changes.
    The least neighbours are aggregated before the shuffle and joined, so that a node with very many is split like any skewed key.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    last = None
    while True:
        least = both(now).groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both(now).where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "components")
        delete(now)
        delete(large)
        now = new
        state = tuple(now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def _plan(one: DataFrame, tau: int) -> tuple[int, list[list[int]], list[int]]:
    """(number of signatures, partitions, thresholds) with the least estimated work over the signatures one(node, a, b, c, d)."""
    found = {r[0]: r[1] for r in one.mapInArrow(_together, "k long, n long").groupBy("k").agg(F.sum("n")).collect()}
    n = found.pop(-1, 0)
    both = np.zeros((128, 128))
    for k, x in found.items():
        both[k // 128, k % 128] = both[k % 128, k // 128] = x
    options = [group_bits(both, n, parts) for parts in PARTITIONS]
    blocks = list(dict.fromkeys(tuple(b) for parts in options for bits in parts for b in fine(bits)))
    counted = one.mapInArrow(_histograms([list(b) for b in blocks]), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, count = counted["k"].to_numpy(), counted["n"].to_numpy()
    pairs = {}
    for i, b in enumerate(blocks):
        own = k >> FINE == i
        histogram = np.zeros(1 << len(b))
        histogram[k[own] & ((1 << FINE) - 1)] = count[own]
        pairs[b] = close(histogram, len(b))
    best = None
    for parts in options:
        costs = [estimate([pairs[tuple(b)] for b in fine(bits)], len(bits), n) for bits in parts]
        thresholds = allocate(costs, tau)
        work = sum(c[t + 1] for c, t in zip(costs, thresholds)) if thresholds else np.inf
        if thresholds and (best is None or work < best[0]):
            best = (work, parts, thresholds)
    return n, best[1], best[2]


def _grouped(docs: DataFrame, tau: int, confirm: int, text: str, doc_id: str) -> DataFrame:
    """(id, h, kept): the documents, by id and hash of the text, that are in a group, and the smallest (id, h) of the group."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sigs = written(rows.withColumn("h", F.xxhash64("text")).mapInArrow(_signed, "id long, h long, a long, b long, c long, d long"), "simhash")
    reps = sigs.groupBy(*_COLUMNS).agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("rows"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")  # the numbers are those in the files
    one = reps.select("node", *_COLUMNS)
    n, parts, thresholds = _plan(one, tau)
    probes = n * sum(t + 1 for t in thresholds)
    heavy = one.mapInArrow(_key_counts(parts, thresholds), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > KEY_ROWS).collect()
    blocks: dict[int, list] = {}
    for r in heavy:
        many = -(-r["n"] // KEY_ROWS)
        probes += n * many
        blocks.setdefault(r["key"] >> _SHIFT, []).append((r["key"], min(many, BLOCKS)))
    shared = docs.sparkSession.sparkContext.broadcast({k: np.array(sorted(v)) for k, v in blocks.items()})
    keyed = one.mapInArrow(_keys(parts, thresholds, shared), "key long, block int, node long, a long, b long, c long, d long")
    keyed = keyed.repartition(spread(docs.sparkSession, probes, TASK_ROWS), "key")
    pairs = keyed.mapInArrow(_probe(parts, thresholds, tau, confirm), "u long, v long")
    roots = components(pairs)
    grouped = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = grouped.groupBy("root").agg(F.min("first").alias("kept"), F.sum("rows").alias("size")).where("size > 1")
    kept = grouped.join(kept, "root").select(*_COLUMNS, "kept")
    return sigs.join(kept, _COLUMNS).select("id", "h", "kept")


def near_duplicates(docs: DataFrame, tau: int = TAU, confirm: int = CONFIRM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept_doc_id) for every document that is in a group of near duplicates, but for the smallest id of each.

    A group is what chains of near duplicates connect. Words are compared without regard to case and
    punctuation; equal signatures need no search. Null texts and ids and texts without words take no part. Rows that repeat an
    id and its text count once; an id with several texts takes part with each, and is listed once for each other id that
    stands for one of its texts. Texts are signed whole, however long. Of ties the smallest id stays. An empty table gives an
    empty result. Other columns, whatever their names, are ignored.
    """
    found = _grouped(docs, tau, confirm, text, doc_id)
    return found.select(F.col("id").alias("doc_id"), F.col("kept.id").alias("kept_doc_id")).where("doc_id <> kept_doc_id").distinct()


def remove_near_duplicates(docs: DataFrame, tau: int = TAU, confirm: int = CONFIRM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest id; rows with a null id or text stay.

    Rows go by their own id and text: an id with several texts keeps those of which no smaller document is a near copy. Rows that
    repeat the id and text of a document that stays are that document and stay too; texts without words, empty ones among
    them, have no copies. Very long texts are compared whole; an empty table gives an empty one; columns and their names
    are those of docs, whatever they are.
    """
    found = _grouped(docs, tau, confirm, text, doc_id).where("id <> kept.id OR h <> kept.h")
    names = [fresh(docs, "gone_id"), fresh(docs, "gone_text")]
    gone = written(found.select(F.col("id").alias(names[0]), F.col("h").alias(names[1])).distinct(), "simhash-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    same = (docs[doc_id].cast("long") == gone[names[0]]) & (F.xxhash64(docs[text].cast("string")) == gone[names[1]])
    return docs.join(gone, same & docs[text].isNotNull(), "left_anti")
