"""Repeated passages through super-k-mer partitioning.

Every window of K words has a minimiser, the least hash of its runs of M words. Consecutive windows that
share it travel as one packed string to the bucket of the minimiser, so that a text is sent about three
times over and not K times. Equal windows have equal minimisers and meet in one bucket, where words are numbered
exactly, windows are sorted, and those that occur twice or more are counted by comparing their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, spread
from .tokens import chunks, mixed, split, word_places

#: Words of a window: passages of at least so many words are found.
K = 50
#: Words of the runs that minimisers are taken from.
M = 6
#: Bytes of packed strings of a task, about, before compression, and how many of them a byte of text gives.
TASK_BYTES = 6 << 20
PACKED = 3.3
#: Beginnings of texts from which the compression's dictionary is trained: how many, about, how long, and the dictionary's bytes.
DICTIONARY_TEXTS, DICTIONARY_CHARS, DICTIONARY_BYTES = 2_000, 2_000, 112 << 10

_ODD = 0x9E3779B97F4A7C15


def _runs_of(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, by their order."""
    out = np.zeros(max(0, len(values) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(_ODD) + values[i : i + len(out)]
    return mixed(out)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while width * 2 <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = n - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def super_kmers(texts: pa.Array, k: int, m: int):
    """(place of the text, minimiser, first word, first character, packed string) of every run of windows."""
    w = split(texts)
    if len(w.starts) < k:
        return None
    least = _least(_runs_of(w.hashes, m), k - m + 1)
    valid = w.doc[k - 1 :] == w.doc[: len(w.doc) - k + 1]
    change = np.ones(len(least), dtype=bool)
    change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (w.doc[1 : len(least)] != w.doc[: len(least) - 1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(least)) - 1
    use = valid[first]
    first, last = first[use], last[use]
    chars = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    begin = np.concatenate([[0], np.flatnonzero(np.diff(w.doc)) + 1])  # first word of each text that has words
    raw = w.buf.tobytes()
    lines = np.concatenate([[0], np.cumsum(pa.compute.binary_length(pa.compute.utf8_lower(texts)).to_numpy(zero_copy_only=False) + 1)])
    packed = [raw[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[last + k - 1].tolist())]
    doc = w.doc[first]
    word = first - begin[np.searchsorted(begin, first, "right") - 1]
    return doc, least[first].view(np.int64), word, chars[w.starts[first]] - chars[lines[doc]], packed


def dictionary(texts: list[str]) -> bytes:
    """A dictionary for strings like these; b"" if there are too few. Only the size of what is sent depends on it."""
    import zstandard

    samples = [t[i : i + 400].lower().encode() for t in texts for i in range(0, len(t), 400)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(trained: bytes):
    """(compress, decompress) of short strings."""
    import zstandard

    d = zstandard.ZstdCompressionDict(trained) if trained else None
    packer = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_dict_id=False)
    return packer.compress, zstandard.ZstdDecompressor(dict_data=d).decompress


def _partition(k: int, m: int, trained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _codec(trained.value)[0]
        for batch in chunks(batches):
            found = super_kmers(batch["text"], k, m)
            if found:
                doc, key, word, at, packed = found
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch["id"].take(take), batch["same"].take(take), pa.array(word.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(list(map(pack, packed)), pa.binary())],
                    ["key", "id", "same", "word", "at", "packed"],
                )

    return run


def _exact_groups(ids: np.ndarray, at: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """group, with every group split where its windows' words differ; at: first words, sorted by group."""
    same = group[1:] == group[:-1]
    a, b = at[:-1][same], at[1:][same]
    equal = np.ones(len(a), dtype=bool)
    for i in range(k):
        equal &= ids[a + i] == ids[b + i]
    if equal.all():
        return group
    out = group * len(group)
    for g in np.unique(group[:-1][same][~equal]).tolist():
        own = np.flatnonzero(group == g)
        rows = ids[at[own][:, None] + np.arange(k)]
        out[own] += np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    return out


def repeated_windows(table: pa.Table, packed: list[bytes], k: int):
    """(row, first window, last window, first character, end, whether first) of runs of repeated windows.

    table: the places of packed strings, no two rows of one place.
    """
    buf = np.frombuffer(b"\n".join(packed) + b"\n", dtype=np.uint8)
    starts, ends = word_places(buf)
    offsets = np.cumsum([0, *(len(x) + 1 for x in packed)])
    owner = np.searchsorted(offsets, starts, "right") - 1
    inside = np.zeros(len(buf) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = buf[np.cumsum(inside[:-1], dtype=np.int8) == 1]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)), pa.py_buffer(letters)])
    ids = words.dictionary_encode().indices.to_numpy()
    windows = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1]) if len(owner) >= k else np.empty(0, dtype=np.int64)
    # windows are equal if their sums are when both are shifted to the same power
    power, back = (np.cumprod(np.append(np.ones(1, dtype=np.uint64), np.full(len(ids), x, dtype=np.uint64)), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    sums = np.append(np.zeros(1, dtype=np.uint64), np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)], dtype=np.uint64))
    hashes = (sums[windows + k] - sums[windows]) * back[windows]
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, dtype=bool)
    group = np.cumsum(new) - 1
    twice = np.bincount(group)[group] > 1 if len(group) else np.empty(0, dtype=bool)
    group, order = group[twice], order[twice]
    if not len(group):
        return None
    at = windows[order]
    group = np.unique(_exact_groups(ids, at, group, k), return_inverse=True)[1]
    twice = np.bincount(group)[group] > 1
    group, at = group[twice], at[twice]
    row = owner[at]
    begin = np.searchsorted(owner, np.arange(len(packed)))
    place = table["word"].to_numpy()[row] + at - begin[row]
    by = np.lexsort((place, table["same"].to_numpy()[row], table["id"].to_numpy()[row], group))
    first = np.zeros(len(by), dtype=bool)
    first[by[np.flatnonzero(np.diff(group[by], prepend=-1))]] = True
    by = np.lexsort((at, first))
    at, row, first, place = at[by], row[by], first[by], place[by]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (first[1:] != first[:-1])]))
    end = np.append(cut[1:], len(at)) - 1
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    r = row[cut]
    base = table["at"].to_numpy()[r] - chars[offsets[r]]
    return r, place[cut], place[end], base + chars[starts[at[cut]]], base + chars[ends[at[end] + k - 1]], first[cut]


_COLUMNS = ["key", "id", "same", "word", "at", "packed"]
_SCHEMA = pa.schema([*((c, pa.int64()) for c in _COLUMNS[:3]), ("word", pa.int32()), ("at", pa.int32()), ("packed", pa.binary())])


def _count(k: int, trained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(trained.value)[1]
        table = pa.Table.from_batches(list(batches), _SCHEMA)
        place = np.stack([table[c].to_numpy() for c in ("id", "same", "word")])
        order = np.lexsort(place)
        place = place[:, order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (place[:, 1:] != place[:, :-1]).any(axis=0)
        table = table.take(pa.array(order[new])) if not new.all() else table
        found = repeated_windows(table, list(map(unpack, table["packed"].to_pylist())), k) if len(table) else None
        if found:
            r, a, b, start, end, first = found
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [table["id"].combine_chunks().take(take), table["same"].combine_chunks().take(take), *(pa.array(x.astype(np.int32)) for x in (a, b, start, end)), pa.array(first)],
                ["doc_id", "same", "a", "b", "start", "end", "first"],
            )

    return run


def repeated_passages(docs: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, first): the longest spans of each text all of whose windows of k words occur more than once.

    start and end count characters from 0, end excluded. Words are runs of letters, marks and digits without regard
    to case, and single characters of scripts without spaces, so punctuation and white space between them don't matter; windows count wherever they occur,
    in one text or several. first marks occurrences with the smallest (id, hash of the text, place); the others
    are copies. Null ids and texts take no part, and texts of fewer words have no windows. Rows that repeat an id and
    its text count once; an id with several texts is listed for each. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // DICTIONARY_TEXTS))) == 0)
    some = some.select(F.substring("text", 1, DICTIONARY_CHARS).alias("t")).limit(2 * DICTIONARY_TEXTS)
    trained = spark.sparkContext.broadcast(dictionary([r["t"] for r in some.collect()]))
    sent = rows.withColumn("same", F.xxhash64("text")).mapInArrow(_partition(k, min(M, k), trained), "key long, id long, same long, word int, at int, packed binary")
    sent = sent.repartition(spread(spark, size * PACKED, TASK_BYTES), "key")
    spans = sent.mapInArrow(_count(k, trained), "doc_id long, same long, a int, b int, start int, end int, first boolean")
    own = Window.partitionBy("doc_id", "same", "first").orderBy("a", "b")
    before = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("a") <= before + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(own))
    return islands.groupBy("doc_id", "same", "first", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end", "first")


def remove_repeats(docs: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the spans of texts that are copies of another place; rows and other columns stay as they are.

    Where an id has several texts, nothing is cut from any of them.
    """
    spans = repeated_passages(docs, k, text, doc_id).where("NOT first")
    one = docs.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high")).where("low <=> high")
    key, cut = fresh(docs, "cut_id"), fresh(docs, "cut_spans")
    lists = spans.join(one.select("doc_id"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    joined = docs.join(lists, F.col(doc_id).cast("long") == F.col(key), "left")
    state = F.aggregate(
        F.col(cut),
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["kept"], F.when(x["start"] > s["at"], F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"])).otherwise(F.lit(""))).alias("kept"), F.greatest(s["at"], x["end"]).alias("at")),
        lambda s: F.concat(s["kept"], F.substring(F.col(text), s["at"] + 1, F.greatest(F.length(F.col(text)) - s["at"], F.lit(0)))),
    )
    return joined.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(state)).select(*docs.columns)
