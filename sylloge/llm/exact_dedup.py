"""Exact duplicate removal through an extendible-hash index kept on shared files.

Keys are 64-bit hashes of whole texts. A directory over the top bits of the key doubles until no bucket
is larger than its capacity; each bucket is a contiguous key range. The index entries, those of a key
combined before they are sent, go, grouped by bucket, to the shared folder. Owner tasks then take whole buckets, chain the texts
of keys that several rows have and compare the bytes, so two texts count as copies only if they are identical. Copies among
the rows of a batch are combined before they are sent too, so that a text that very many rows have reaches its owner a few times only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, parallelism, written

#: Entries a bucket holds before it is split, and the slots of the directory, of four bytes each, beyond which buckets grow instead.
CAPACITY = 4096
SLOTS = 1 << 22

#: Keys held by several documents that may be broadcast (32 MB); more are joined by a shuffle.
BROADCAST_KEYS = 4_000_000


def build_directory(fine: np.ndarray, fine_bits: int, capacity: int) -> tuple[int, list[int]]:
    """(global depth, directory): directory[p] is the bucket of the keys with the top bits p.

    fine has the entries by fine prefix. Starting with one bucket, an overfull bucket is split on its
    next bit; where its local depth is the global depth, the directory is doubled first. A bucket whose
    entries share the whole fine prefix can't be split further and keeps them in a chain.
    """
    total = np.concatenate([[0], np.cumsum(fine)])

    def load(prefix: int, depth: int) -> int:
        w = fine_bits - depth
        return int(total[(prefix + 1) << w] - total[prefix << w])

    depth, directory, buckets = 0, [0], [(0, 0)]  # bucket: (prefix, local depth)
    todo = [0]
    while todo:
        b = todo.pop()
        prefix, local = buckets[b]
        if local == fine_bits or load(prefix, local) <= capacity:
            continue
        if local == depth:
            directory = [x for x in directory for _ in (0, 1)]
            depth += 1
        buckets[b] = (prefix << 1, local + 1)
        buckets.append((prefix << 1 | 1, local + 1))
        new, w = len(buckets) - 1, depth - local - 1
        start = (prefix << 1 | 1) << w
        directory[start : start + (1 << w)] = [new] * (1 << w)
        todo += [b, new]
    order: dict[int, int] = {}
    return depth, [order.setdefault(b, len(order)) for b in directory]


def fine_bits(n: int, capacity: int) -> int:
    """Bits of the prefixes by which n keys are counted: enough to split any bucket that different keys overfill, within SLOTS."""
    return min((SLOTS - 1).bit_length(), max(4, (max(n, 1) // capacity).bit_length() + 3))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each batch, once, with the number of their rows."""
    for batch in batches:
        key, n = np.unique(batch["key"].to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bucket, n) of rows sorted by key: each key once, with all its rows."""
    at, bucket, total = None, 0, 0
    for batch in batches:
        keys, n, buckets = (batch[c].to_numpy() for c in ("key", "n", "bucket"))
        begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.empty(0, dtype=np.int64)
        if not len(begins):
            continue
        k, sums, where = keys[begins], np.add.reduceat(n, begins), buckets[begins]
        if at is not None and k[0] == at:
            sums[0] += total
        elif at is not None:
            k, sums, where = np.append(at, k), np.append(total, sums), np.append(bucket, where)
        at, total, bucket = k[-1], sums[-1], where[-1]  # the last key waits for the next batch
        yield pa.RecordBatch.from_arrays([pa.array(k[:-1]), pa.array(where[:-1], pa.int32()), pa.array(sums[:-1])], ["key", "bucket", "n"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([bucket], pa.int32()), pa.array([total], pa.int64())], ["key", "bucket", "n"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch less those whose text another row of it has with a smaller id."""
    for batch in batches:
        code = batch["text"].dictionary_encode().indices.to_numpy()
        order = np.lexsort((batch["doc_id"].to_numpy(), code))
        yield batch.take(pa.array(order[np.flatnonzero(np.diff(code[order], prepend=-1))]))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, key, doc_id): the texts of each key with the first id; the text only where a key has several."""
    at, chain = None, []

    def ended():
        return [(at, i, t if len(chain) > 1 else None) for i, t in chain]

    for batch in batches:
        done = []
        for key, i, t in zip(batch["key"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
            if key != at:
                done += ended()
                at, chain = key, []
            text = t.as_buffer().to_pybytes() if t.as_buffer() is not None else b""
            if all(text != other for _, other in chain):
                chain.append((i, text))
        yield _kept_rows(done)
    yield _kept_rows(ended())


def _kept_rows(rows: list) -> pa.RecordBatch:
    key, kept, text = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kept, pa.int64()), pa.array([None if t is None else t.decode() for t in text], pa.string())], ["key", "kept_doc_id", "own_text"])


def _kept(rows: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Of rows(doc_id, text, key): (doc_id, key) of all, and (key, kept_doc_id, own_text) of the texts of keys that several rows have.

    own_text is null where all rows of the key have the same text. The second is broadcast where that is safe.
    """
    spark = rows.sparkSession
    entries = written(rows.select("doc_id", "key"), "extendible-entries")
    n = entries.count()
    bits = fine_bits(n, capacity)
    counts = entries.groupBy(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("p")).count().toArrow()
    fine = np.zeros(1 << bits, dtype=np.int64)
    fine[counts["p"].to_numpy()] = counts["count"].to_numpy()
    depth, directory = build_directory(fine, bits, max(capacity, 8 * n // SLOTS))
    buckets = max(directory) + 1
    owners = min(buckets, max(parallelism(spark), buckets // 16))

    def located(df: DataFrame) -> DataFrame:
        """df with the bucket of each key, whole buckets and thus key ranges to owners."""
        if depth:
            slots = spark.createDataFrame([(directory,)], "slots array<int>")
            top = F.shiftrightunsigned("key", 64 - depth).cast("int")
            df = df.crossJoin(F.broadcast(slots)).withColumn("bucket", F.get("slots", top)).drop("slots")
        else:
            df = df.withColumn("bucket", F.lit(0))
        return df.repartitionById(owners, F.floor(F.col("bucket").cast("long") * owners / F.lit(buckets)).cast("int"))

    index = located(entries.select("key").mapInArrow(_entries, "key long, n long")).sortWithinPartitions("bucket", "key")
    index = written(index.mapInArrow(_crowded, "key long, bucket int, n long"), "extendible-index")
    shared = index.where("n > 1").select("key")
    small = shared.count() <= BROADCAST_KEYS
    own = rows.join(F.broadcast(shared) if small else shared, "key", "left_semi").select("key", "doc_id", "text")
    own = located(own.mapInArrow(_combined, "key long, doc_id long, text string")).sortWithinPartitions("bucket", "key", "doc_id")
    kept = written(own.mapInArrow(_chains, "key long, kept_doc_id long, own_text string"), "extendible-kept")
    return entries, F.broadcast(kept) if small else kept


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept_doc_id) for every document whose text equals that of a document with a smaller id.

    The index holds keys and ids only. Texts are fetched, and compared, for the keys that more than one
    document has. Null texts and null ids take no part; empty texts are texts like any other, so all but
    the first empty document are copies. Rows that repeat a document's id and text count once; an id with
    several texts takes part with each. An empty table gives an empty result. Other columns are ignored.
    """
    rows = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .withColumn("key", F.xxhash64("text"))
    )
    entries, kept = _kept(rows, capacity)
    found = entries.join(kept.where("own_text IS NULL"), "key")
    several = kept.where("own_text IS NOT NULL")
    if not several.isEmpty():
        found = found.select("doc_id", "kept_doc_id").union(rows.join(several, ["key"]).where("text = own_text").select("doc_id", "kept_doc_id"))
    return found.where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id").distinct()


def remove_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs with one row of each text, one of the smallest id; rows with a null id or text stay.

    Rows are removed by their own id and text: an id with several texts keeps those that no smaller id has. Of rows that repeat
    an id and a text, which may differ in other columns, any one stays; empty texts are a text like any other, and very long
    ones are compared whole. An empty table gives an empty one; columns and their names are those of docs, whatever they are.
    """
    key, mine, kept_id, kept_text = (fresh(docs, x) for x in ("text_key", "text_id", "text_kept", "text_of_kept"))
    own, own_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = docs.withColumn(key, F.when(own_id.isNotNull() & own.isNotNull(), F.xxhash64(own)))
    rows = keyed.where(F.col(key).isNotNull()).select(own_id.alias("doc_id"), own.alias("text"), F.col(key).alias("key"))
    kept = _kept(rows, capacity)[1].toDF(mine, kept_id, kept_text)
    same = (F.col(key) == F.col(mine)) & (F.col(kept_text).isNull() | (F.col(kept_text) == own))
    joined = keyed.join(kept, same, "left").where(F.col(kept_id).isNull() | (F.col(kept_id) == own_id))
    one = joined.where(F.col(kept_id).isNotNull()).dropDuplicates([kept_id, mine, kept_text])
    return joined.where(F.col(kept_id).isNull()).select(*docs.columns).unionByName(one.select(*docs.columns))
