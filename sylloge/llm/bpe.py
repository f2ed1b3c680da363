"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes become Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds the tokens
that match at every byte. A piece of text is covered from the left with the longest match that may
follow the token before it; where none may, the last token is given up for its next shorter prefix, and the
place is never tried again. Two tokens may stand side by side if no merge of lower rank crosses their
border; that is found by undoing their merges, and remembered. Each place is left at most once, so the time
is linear in the text and the tokens are those of the merges done one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that merges don't cross.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose tokens a Python worker remembers, and the bytes up to which a piece is.
CACHE = 400_000
CACHED_BYTES = 64

_NONE = 1 << 30


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, rank) of each line of a vocabulary file, in order of rank."""
    with open(path, "rb") as f:
        found = [line.split() for line in f.read().splitlines() if line.strip()]
    return sorted(((base64.b64decode(t), int(r)) for t, r in found), key=lambda x: x[1])


@dataclass
class Tables:
    """What encoding needs, by rank: bytes, halves that a token was merged from, the next shorter prefix."""

    tokens: list[bytes | None]
    left: list[int]
    right: list[int]
    prefix: list[int]
    pairs: dict[tuple[int, int], int] = field(default_factory=dict)

    @classmethod
    def of(cls, ranks: list[tuple[bytes, int]]) -> Tables:
        """Tokens that no merges lead to are left out; single bytes are all needed."""
        size = max((r for _, r in ranks), default=-1) + 1
        rank = {t: r for t, r in ranks}
        if missing := [b for b in range(256) if bytes([b]) not in rank]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        out = cls([None] * size, [*range(size)], [*range(size)], [-1] * size)
        for t, r in ranks:
            if len(t) == 1:
                out.tokens[r] = t
                continue
            for n in range(len(t) - 1, 0, -1):
                a, b = rank.get(t[:n], r), rank.get(t[n:], r)
                if a < r and b < r and out.tokens[a] is not None and out.tokens[b] is not None and out.fits(a, b):
                    out.tokens[r], out.left[r], out.right[r] = t, a, b
                    out.pairs[a, b] = r
                    break
        for t, r in ranks:
            if out.tokens[r] is not None and len(t) > 1:
                out.prefix[r] = next((a for n in range(len(t) - 1, 0, -1) if (a := rank.get(t[:n])) is not None and out.tokens[a] is not None), -1)
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as they are where they meet."""
        limit, left, right, pairs = _NONE, self.left, self.right, self.pairs
        while True:
            if pairs.get((a, b), _NONE) < limit:
                return False
            if a > b and right[a] != a:
                limit, a = a, right[a]
            elif left[b] != b and (a <= b or right[a] == a):
                limit, b = b + 1, left[b]
            elif right[a] != a:
                limit, a = a, right[a]
            else:
                return True


class Encoder:
    def __init__(self, tables: Tables, pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.tables, self.split = tables, regex.compile(pattern)
        self.lengths = [len(t) if t is not None else 0 for t in tables.tokens]
        self.automaton = ahocorasick.Automaton()
        for r, t in enumerate(tables.tokens):
            if t is not None:
                self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.whole = {t: r for r, t in enumerate(tables.tokens) if t is not None}
        self.fit: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        one = self.whole.get(data)
        if one is not None:
            return [one]
        size, lengths, prefix, fit = len(data), self.lengths, self.tables.prefix, self.fit
        longest = [0] * size
        for end, r in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[r]] = r  # a later end is a longer match
        out: list[int] = []
        alive = bytearray(b"\x01") * (size + 1)
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + lengths[token]
                if alive[end]:
                    if last < 0:
                        break
                    ok = fit.get((last, token))
                    if ok is None:
                        ok = self.fits(last, token)
                    if ok:
                        break
                token = prefix[token]
                if token < 0:
                    break
            if token >= 0:
                out.append(token)
                at = end
                if at == size:
                    return out
                token = longest[at]
            else:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]

    def fits(self, a: int, b: int) -> bool:
        if len(self.fit) > 4 * CACHE:
            self.fit.clear()
        ok = self.fit[a, b] = self.tables.fits(a, b)
        return ok

    def encode(self, text: str) -> bytes:
        """The tokens of a text as 32-bit integers."""
        cache, out = self.cache, []
        for p in self.split.findall(text):
            ids = cache.get(p)
            if ids is None:
                data = p.encode()
                ids = np.array(self.piece(data), dtype=np.int32).tobytes()
                if len(data) <= CACHED_BYTES:
                    if len(cache) > CACHE:
                        cache.clear()
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> bytes:
        tokens = self.tables.tokens
        return b"".join([tokens[i] for i in ids])


_OWN: dict[tuple, Encoder] = {}


def _encoder(key: tuple, tables: Tables, pattern: str) -> Encoder:
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Encoder(tables, pattern)
    return _OWN[key]


def _list(parts: list[bytes | None]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) // 4 if x is not None else 0 for x in parts)]).astype(np.int32)
    values = np.frombuffer(b"".join([x for x in parts if x is not None]), dtype=np.int32)
    nulls = pa.array([x is None for x in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=nulls)


class Bpe:
    """A tokenizer on the cluster: the tables are made on the driver and broadcast, a fixed size."""

    def __init__(self, spark: SparkSession, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        self.pattern, self.key = pattern, (vocabulary, pattern)
        self.tables = spark.sparkContext.broadcast(Tables.of(read_ranks(vocabulary)))

    def encoded(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """(doc_id, n_tokens, tokens, round_trip) of every row; see encode_documents()."""
        shared, key, pattern = self.tables, self.key, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in chunks(batches):
                own = own or _encoder(key, shared.value, pattern)
                ids, same = [], []
                for t in batch["text"].to_pylist():
                    if t is None:
                        ids.append(None)
                        same.append(None)
                        continue
                    found = own.encode(t)
                    ids.append(found)
                    same.append(own.decode(memoryview(found).cast("i") if found else ()) == t.encode())
                counts = pa.array([None if x is None else len(x) // 4 for x in ids], pa.int32())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], counts, _list(ids), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "tokens", "round_trip"])

        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>, round_trip boolean")

    def decode(self, tokens: Column) -> Column:
        """The bytes of arrays of tokens; null for null, an error for a number that is no token."""
        shared, key, pattern = self.tables, self.key, self.pattern

        @F.arrow_udf("binary")
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = shared.value
            for part in parts:
                yield pa.array([None if x is None else b"".join([table.tokens[i] for i in x]) for x in part.to_pylist()], pa.binary())

        return run(tokens)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip): the tokens of whole texts, and whether decoding gave back their bytes.

    A row for every row of docs, repeated ones too. A null text has null in the other columns, an empty one
    no tokens; a null id stays null. Special tokens are ordinary text; very long texts are encoded whole. An empty table
    gives an empty result. Other columns, whatever their names, are ignored.
    """
    return Bpe(docs.sparkSession, vocabulary, pattern).encoded(docs, text, doc_id)


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """encoded with its texts from its tokens, under the name text in place of any such column.

    Null tokens give a null text, none an empty one; a number that is no token is an error. Rows are kept as they are, repeated
    ones and their other columns too; an empty table gives an empty one.
    """
    bpe = Bpe(encoded.sparkSession, vocabulary)
    return encoded.withColumn(text, F.decode(bpe.decode(F.col(tokens)), "UTF-8"))
