"""Search over clauses and documents: fixed lexical scores, BM25, vectors, and measures of the results."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import FUZZY, STOP, nearly, search_words, words
from ..functions.vectors import cosine
from ..plans.local import LimitError
from ..plans.syntax import Atom, Clause, DatalogError, Lit, Not, Num, canonical, write
from ..sources.scratch import hadoop, new_path, written

POINTS = {"source_phrase": 180, "clause_phrase": 160, "head_predicate": 120, "body_predicate": 70, "term": 60, "source_word": 45, "fuzzy_predicate": 30, "clause_word": 20}
KINDS = {"fact": 0, "rule": 1, "constraint": 2}
#: Different words of queries, or ids of documents, that may be broadcast; characters of a term whose words count for a predicate.
BROADCAST_WORDS, TERM_CHARS = 1_000_000, 256
#: Words of questions about the past.
TEMPORAL = re.compile(r"\b(?:" + "|".join("before former formerly historical history past previous previously prior".split() + ["used to"]) + r")\b", re.I)
CLAUSES = "clause string, kind string, head string, body array<string>, terms array<string>, source string"


def clause_table(spark: SparkSession, clauses: list[Clause], sources: dict[str, str] | None = None) -> DataFrame:
    """A row for each distinct clause, as search() takes it. sources: text by clause."""
    rows = {}
    for c in clauses:
        lits = [g.lit if isinstance(g, Not) else g for g in c.body if isinstance(g, (Lit, Not))]
        terms = [t.value if isinstance(t, Atom) else write(t) for x in ([c.head] if c.head else []) + lits for t in x.args if isinstance(t, (Atom, Num))]
        kind = "fact" if c.is_fact else "rule" if c.is_rule else "constraint"
        rows.setdefault(canonical(c), (write(c), kind, c.head.name if c.head else "", [x.name for x in lits], terms, (sources or {}).get(write(c), "")))
    return spark.createDataFrame(list(rows.values()), CLAUSES)


def search(clauses: DataFrame, text: str, limit: int = 20, minimum: int = 1) -> DataFrame:
    """(rank, clause, kind, score, reasons): the best clauses by the sum of what matches, then by kind and text.

    clauses has the columns of CLAUSES. A phrase counts where the whole text occurs, every word once for
    each place where it occurs, and a predicate's word that is one edit away.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    spark = clauses.sparkSession
    own = spark.range(1).select(search_words(F.lit(text)).alias("w")).first()["w"]
    if not own:
        raise ValueError("the text has no words to search for")
    low, asked = text.lower().strip(), F.array(*map(F.lit, own))
    every = lambda c: F.array_distinct(F.flatten(F.transform(c, words)))
    df = clauses.select("clause", "kind", F.lower("source").alias("source"), F.array_distinct(words(F.col("head"))).alias("hw"), every(F.col("body")).alias("bw"), every(F.col("terms")).alias("tw"), F.array_distinct(words(F.col("source"))).alias("sw"), F.array_distinct(words(F.col("clause"))).alias("cw"))
    reason = lambda kind, tokens: F.transform(tokens, lambda t: F.struct(F.lit(POINTS[kind]).alias("points"), F.lit(kind).alias("kind"), t.alias("token")))
    phrase = lambda kind, c: reason(kind, F.when(F.contains(c, F.lit(low)), F.array(F.lit(low))).otherwise(F.array().cast("array<string>")))
    hits = lambda kind, c: reason(kind, F.array_intersect(asked, F.col(c)))
    unmatched = F.array_except(F.array_union(F.col("hw"), F.col("bw")), asked)
    first = F.transform(unmatched, lambda p: F.get(F.filter(asked, lambda w: nearly(p, w)), F.lit(0)))
    fuzzy = reason("fuzzy_predicate", F.array_distinct(F.filter(first, lambda w: w.isNotNull())))
    reasons = F.concat(
        phrase("source_phrase", F.col("source")), phrase("clause_phrase", F.lower("clause")), hits("head_predicate", "hw"), hits("body_predicate", "bw"),
        hits("term", "tw"), hits("source_word", "sw"), hits("clause_word", "cw"), fuzzy,
    )
    scored = df.select("clause", "kind", reasons.alias("reasons")).withColumn("score", F.aggregate("reasons", F.lit(0), lambda s, x: s + x["points"]))
    order = [F.desc("score"), F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("kind")), F.col("clause")]
    top = scored.where(F.col("score") >= minimum).orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "clause", "kind", "score", "reasons")


def search_graph(found: DataFrame) -> DataFrame:
    """(source, target, how): edges from the search to its results, their clauses and the words that matched."""
    result = F.concat(F.lit("result:"), F.col("rank"))
    a = found.select(F.lit("search").alias("source"), result.alias("target"), F.lit("returns").alias("how"))
    b = found.select(result, F.concat(F.lit("clause:"), F.col("clause")), F.lit("matches"))
    c = found.select(F.concat(F.lit("clause:"), F.col("clause")).alias("source"), F.explode("reasons").alias("r"))
    c = c.select("source", F.concat(F.lit("word:"), F.col("r.token")), F.col("r.kind"))
    return a.union(b).union(c).distinct()


def document_search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", query_id: str = "item_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): documents by how many of the query's words they hold; ties by id. Stop words don't count."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(search_words(F.col(text))).alias("w"))
    base = lambda df: df.select(F.col(doc_id).alias("doc_id"), search_words(F.col(text)).alias("ws"))
    held = _held(asked)
    if held is None:
        scored = base(docs).select("doc_id", F.explode("ws").alias("w")).join(asked, "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    once, rest = _rows(docs, doc_id)
    hits = [] if once is None else [_only(base(once), held)]
    if rest is not None:
        hits.append(_only(base(rest), held).groupBy("doc_id").agg(F.flatten(F.collect_list("ws")).alias("ws")))
    hits = reduce(DataFrame.union, hits)
    found = _top(hits.select("doc_id", "ws", F.transform("ws", lambda w: F.lit(1.0)).alias("weights")), held, k, dict(asked.dtypes)["query_id"])
    return found.withColumn("score", F.col("score").cast("long"))


#: Words of queries that are written into a plan as constants; scores that a task holds at a time; pairs of queries and words that tasks hold.
CONSTANT_WORDS, SCORES, PAIRS = 10_000, 250_000, 1_000_000


def _held(asked: DataFrame) -> pa.Table | None:
    """The pairs (query_id, w) in memory, or None where they are too many."""
    got = asked.limit(PAIRS + 1).toArrow()
    return got if got.num_rows <= PAIRS else None


def _rows(docs: DataFrame, doc_id: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The documents of one row each, whose words lie together already, and the rows of the others; None where there are none. All count as others where too many ids repeat."""
    again = docs.groupBy(F.col(doc_id).alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again")
    again = written(again, "repeated")
    n = again.limit(BROADCAST_WORDS + 1).count()
    if not n:
        return docs, None
    if n > BROADCAST_WORDS:
        return None, docs
    same = F.col(doc_id).eqNullSafe(F.col("__again"))
    return tuple(docs.join(F.broadcast(again), same, how) for how in ("left_anti", "left_semi"))


def _only(base: DataFrame, held: pa.Table) -> DataFrame:
    """base without the words of ws that no query has. Rows where none is left stay: a filter by ws would make Spark split each text twice."""
    words_ = pc.unique(held["w"]).to_pylist()
    if not words_:
        return base.where(F.lit(False))
    few = F.filter("ws", lambda w: w.isin(words_)) if len(words_) <= CONSTANT_WORDS else F.col("ws")
    return base.withColumn("ws", F.coalesce(few, F.array().cast("array<string>")))


def _top(rows: DataFrame, held: pa.Table, k: int, query_type: str) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of rows (doc_id, ws, weights), one for each document, by the sum of the weights of a query's words.

    Each task goes through its documents a few at a time and keeps k for each query, so what it holds doesn't grow with them.
    """
    ids, vocabulary = pc.unique(held["query_id"]), pc.unique(held["w"])
    q, w = (pc.index_in(held[c], v).to_numpy().astype(np.int64) for c, v in (("query_id", ids), ("w", vocabulary)))
    q, start = q[np.argsort(w, kind="stable")], np.searchsorted(np.sort(w), np.arange(len(vocabulary) + 1))
    nq, id_type = len(ids), rows.schema["doc_id"].dataType

    def best(docs, query, score):
        rank = np.unique(docs, return_inverse=True)[1]
        order = np.lexsort((rank, -score, query))
        query = query[order]
        order = order[np.arange(len(order)) - np.searchsorted(query, np.arange(nq))[query] < k]
        return order

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, query, score, kind = np.empty(0, object), np.empty(0, np.int64), np.empty(0), None
        worst = np.full(nq, -np.inf)
        step = max(1, SCORES // max(nq, 1))
        for part in parts:
            kind = part["doc_id"].type
            for a in range(0, part.num_rows, step):
                piece = part.slice(a, step)
                own = np.array(piece["doc_id"].to_pylist(), object)
                at = pc.index_in(piece["ws"].flatten(), vocabulary)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(own)), piece["ws"].value_lengths().to_numpy())[known]
                weight, at = piece["weights"].flatten().to_numpy(zero_copy_only=False)[known], at.drop_null().to_numpy()
                times = start[at + 1] - start[at]
                each = np.repeat(start[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                cell = np.repeat(doc, times) * nq + q[each]
                total = np.round(np.bincount(cell, np.repeat(weight, times), len(own) * nq), 6).reshape(len(own), nq)
                met = np.bincount(cell, minlength=len(own) * nq).reshape(len(own), nq) > 0
                d, n = np.nonzero(met & (total >= worst))
                docs, query, score = np.concatenate((docs, own[d])), np.concatenate((query, n)), np.concatenate((score, total[d, n]))
                keep = best(docs, query, score)
                docs, query, score = docs[keep], query[keep], score[keep]
                worst = np.full(nq, -np.inf)
                last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.empty(0, int)
                worst[query[last]] = np.where(np.bincount(query, minlength=nq)[query[last]] == k, score[last], -np.inf)
        if len(docs):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(list(docs), kind), pa.array(score)], ["query_id", "doc_id", "score"])

    found = rows.mapInArrow(run, f"query_id {query_type}, doc_id {id_type.simpleString()}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, doc_id: str = "doc_id", query_id: str = "item_id", text: str = "text", least: int = 3) -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25 with idf ln((N + 1) / (df + 1)) + 1 over words of at least 3 characters.

    Texts are split once, in a job of its own; only postings of words that a query holds are kept. Lengths and document
    counts are of all words.
    """
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(split(F.col(text)))).alias("w"))
    held = _held(asked)
    seen = Observation()
    base = docs.select(F.col(doc_id).alias("doc_id"), split(F.col(text)).alias("ws")).withColumn("len", F.size("ws"))
    base = base.observe(seen, F.count("*").alias("n"), F.sum(F.size("ws")).alias("words"))
    if held is None:
        wanted = asked.select("w").distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted
        tf = base.select("doc_id", "len", F.explode("ws").alias("w")).join(wanted, "w", "left_semi")
    else:
        tf = _only(base, held).select("doc_id", "len", F.explode("ws").alias("w"))
    tf = written(tf.groupBy("w", "doc_id", "len").agg(F.count("*").alias("tf")), "postings")  # one pass over the texts gives postings, their number and the mean length
    n, mean = seen.get["n"], max((seen.get["words"] or 0) / max(seen.get["n"], 1), 1e-9)
    df = tf.groupBy("w").agg((F.log(F.lit(n + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    if held is None:
        scored = tf.join(asked.join(df, "w"), "w").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = tf.join(F.broadcast(df), "w").groupBy("doc_id").agg(F.collect_list(F.struct("w", weight.alias("weight"))).alias("x"))
    return _top(each.select("doc_id", F.col("x.w").alias("ws"), F.col("x.weight").alias("weights")), held, k, dict(asked.dtypes)["query_id"])


#: Rows and queries that a task compares at a time, all of them in its memory; rows of a piece of these.
ROW_BLOCK, QUERY_BLOCK, ROW_PIECE = 100_000, 8_192, 2_048


def _matrix(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By number of dimensions: places, unit vectors and which of them are zero; vectors that are or hold null are left out."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = vectors.flatten().cast(pa.float64())
    broken = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))[values.is_null().to_numpy(zero_copy_only=False)] if values.null_count else np.empty(0, int)
    flat, ends, out = values.to_numpy(zero_copy_only=False), np.cumsum(np.maximum(sizes, 0)), {}
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        at = at[~np.isin(at, broken)] if len(broken) else at
        m = flat[(ends[at] - d)[:, None] + np.arange(d)]
        length = np.sqrt(np.einsum("ij,ij->i", m, m))
        with np.errstate(invalid="ignore"):
            out[int(d)] = at, m / np.where(length == 0, 1, length)[:, None], length == 0
    return out


def _best(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query among these rows, similarities rounded; ties by id."""
    rows = rows.sort_by("id")
    ids, asked = rows["id"].to_numpy(), queries["id"].to_numpy()
    both, mine = (_matrix(t["vector"].combine_chunks()) for t in (queries, rows))
    worst, kept = np.full(len(asked), -np.inf), []
    for a in range(0, len(ids), ROW_PIECE):
        n = min(ROW_PIECE, len(ids) - a)
        # null below all, NaN above all, as SQL has them in descending order
        sims = np.full((len(asked), n), -2.0)
        for d, (q, x, zero) in both.items():
            if d in mine:
                lo, hi = np.searchsorted(mine[d][0], (a, a + n))
                own = x @ mine[d][1][lo:hi].T
                none = mine[d][2][lo:hi]
                if zero.any() or none.any():
                    own[(zero[:, None] | none) & ~np.isnan(own)] = -2.0
                if own.shape == sims.shape:
                    sims = own
                else:
                    sims[np.ix_(q, mine[d][0][lo:hi] - a)] = own
        if np.isnan(sims.sum()):
            sims[np.isnan(sims)] = 2.0
        # those that may still be among the best: later rows have larger ids, so they must be better once rounded
        if n > k and not kept:
            worst = np.partition(sims, n - k - 1, axis=1)[:, n - k - 1] - 2e-6
        q, r = np.nonzero(sims > worst[:, None])
        kept.append((q, r + a, np.round(sims[q, r], 6)))
        if sum(len(x[0]) for x in kept) > 4 * k * len(asked) or a + n >= len(ids) or len(kept) == 1:
            q, r, s = (np.concatenate(x) for x in zip(*kept))
            fine = asked[q] != ids[r]
            q, r, s = q[fine], r[fine], s[fine]
            order = np.lexsort((r, -s, q))
            q, r, s = q[order], r[order], s[order]
            first = np.searchsorted(q, np.arange(len(asked)))
            top = np.arange(len(q)) - first[q] < k
            q, r, s = q[top], r[top], s[top]
            counts = np.bincount(q, minlength=len(asked))
            worst = np.full(len(asked), -np.inf)
            last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.empty(0, int)
            worst[q[last]] = np.where(counts[q[last]] == k, s[last] + 4e-7, -np.inf)
            kept = [(q, r, s)]
    if not kept:
        return pa.table({"query_id": queries["id"][:0], "doc_id": rows["id"][:0], "similarity": pa.array([], pa.float64())})
    q, r, s = kept[0]
    s = np.where(s == 2.0, np.nan, s)
    return pa.table({"query_id": queries["id"].take(pa.array(q)), "doc_id": rows["id"].take(pa.array(r)), "similarity": pa.array(s, mask=s == -2.0)})


def nearest(rows: DataFrame, queries: DataFrame, k: int, row_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """(query_id, doc_id, similarity): the k rows of the largest cosine, to six places, for each query; ties by id. Both sides are (id, vector); a row of the query's id is left out.

    Exact: every query meets every row, in blocks of both that one task holds, by products of matrices; each block of rows
    gives k rows a query at most. A null cosine (a vector null, of another length, or zero) comes last.
    """
    nr, nq = max(1, -(-rows.count() // (row_block or ROW_BLOCK))), max(1, -(-queries.count() // (query_block or QUERY_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.select("id", "vector", block(nr).alias("rb"), every(nq).alias("qb"))
    b = queries.select("id", "vector", block(nq).alias("qb"), every(nr).alias("rb"))
    types = dict(rows.dtypes)["id"], dict(queries.dtypes)["id"]
    found = a.repartition(nr * nq, "rb", "qb").groupBy("rb", "qb").cogroup(b.repartition(nr * nq, "rb", "qb").groupBy("rb", "qb")).applyInArrow(
        lambda x, y: _best(x, y, k), f"query_id {types[1]}, doc_id {types[0]}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def rerank(candidates: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int, guard: tuple[int, float] | None = (120, 1.5)) -> DataFrame:
    """(query_id, doc_id, similarity, rank): lexical candidates by the best cosine of their chunks.

    candidates: (query_id, doc_id, score, rank); vectors: (doc_id, vector), a row for each chunk;
    query_vectors: (query_id, vector). guard (least, times): a first candidate of that score and so many times
    the second's stays first.
    """
    pairs = candidates.join(vectors, "doc_id").join(query_vectors.withColumnRenamed("vector", "asked"), "query_id")
    best = pairs.groupBy("query_id", "doc_id", "score", F.col("rank").alias("old")).agg(F.round(F.max(cosine(F.col("vector"), F.col("asked"))), 6).alias("similarity"))
    keep = F.lit(False)
    if guard:
        second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(Window.partitionBy("query_id"))
        first = candidates.withColumn("second", second).where((F.col("rank") == 1) & (F.col("score") >= guard[0]) & (F.col("score") >= guard[1] * F.coalesce(F.col("second"), F.lit(0)))).select("query_id", F.col("doc_id").alias("kept"))
        best = best.join(first, "query_id", "left")
        keep = F.coalesce(F.col("doc_id") == F.col("kept"), F.lit(False))
    order = Window.partitionBy("query_id").orderBy(F.desc(keep), F.desc_nulls_last("similarity"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "similarity", "rank")


def chunks(text: Column, size: int = 2048, overlap: int = 256, most: int = 10) -> Column:
    """An array of the overlapping pieces of a text that are embedded."""
    step = size - overlap
    n = F.least(F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1)), F.lit(most)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def embedding_key(model: str, text: Column) -> Column:
    """SHA-256 of model, NUL and text, by which embeddings are kept."""
    return F.sha2(F.concat(F.lit(model + "\0"), text), 256)


def missing_embeddings(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(key, text) of the texts that a cache with the column key lacks."""
    keyed = texts.select(embedding_key(model, F.col(text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


#: A model: from a list of texts to as many vectors. It must be a function that tasks can load.
Embed = Callable[[list[str]], list[list[float]]]


class EmbeddingCache:
    """Vectors as Parquet under a path, by embedding_key(): each batch of texts is a folder of its own."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "embeddings")
        self.folder, self.fs = hadoop(spark, self.path)

    def table(self) -> DataFrame:
        """(key, vector)"""
        if not self.fs.exists(self.folder):
            return self.spark.createDataFrame([], "key string, vector array<double>")
        return self.spark.read.schema("key string, vector array<double>").option("recursiveFileLookup", "true").parquet(self.path)

    def prepare(self, texts: DataFrame, model: str, embed: Embed, text: str = "text", batch: int = 256) -> int:
        """Embeds the texts that the cache lacks, in batches inside the tasks; how many. A vector with a number that isn't finite is an error."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for a in range(0, part.num_rows, batch):
                    piece = part.slice(a, batch)
                    vectors = embed(piece["text"].to_pylist())
                    if len(vectors) != piece.num_rows or not all(math.isfinite(x) for v in vectors for x in v):
                        raise ValueError("the model gave vectors that can't be used")
                    yield pa.RecordBatch.from_arrays([piece["key"], pa.array(vectors, pa.list_(pa.float64()))], ["key", "vector"])

        seen = Observation()
        missing = missing_embeddings(texts.where(F.col(text).isNotNull()), self.table(), model, text)
        found = missing.mapInArrow(run, "key string, vector array<double>").observe(seen, F.count("*").alias("n"))
        found.write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")
        return seen.get["n"]


def semantic_search(
    docs: DataFrame, queries: DataFrame, cache: EmbeddingCache, model: str, embed: Embed, k: int = 20, candidates: int = 100, guard: tuple[int, float] | None = (120, 1.5),
    doc_id: str = "doc_id", query_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """(query_id, doc_id, similarity, rank): the best lexical candidates of each query by the largest cosine of their chunks.

    The candidates are document_search()'s; their chunks and the queries are embedded where the cache lacks them.
    """
    found = written(document_search(docs, queries, candidates, doc_id, query_id, text), "candidates")
    ids = found.select("doc_id").distinct()
    ids = F.broadcast(ids) if found.count() <= BROADCAST_WORDS else ids  # else all texts may be moved and sorted
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id", "left_semi")
    pieces = written(some.select("doc_id", F.explode(chunks(F.col("text"))).alias("text")), "chunks")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text"))
    cache.prepare(pieces.select("text").union(asked.select("text")), model, embed)
    table = cache.table()
    vectors = pieces.withColumn("key", embedding_key(model, F.col("text"))).join(table, "key").select("doc_id", "vector")
    own = asked.withColumn("key", embedding_key(model, F.col("text"))).join(table, "key").select("query_id", "vector")
    return rerank(found, vectors, own, k, guard)


def recency_topk(events: DataFrame, by: list[str], ts: str, k: int, tie: str) -> DataFrame:
    """The k latest rows of each group with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(tie))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieval_metrics(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: precision, recall and mean reciprocal rank at k, and the share of queries with all that is relevant.

    found: (query_id, doc_id, rank); relevant: (query_id, doc_id). Queries without anything relevant don't count.
    """
    asked = relevant.select("query_id", "doc_id").distinct()
    hit = found.where(F.col("rank") <= k).join(asked, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    per = asked.groupBy("query_id").agg(F.count("*").alias("n")).join(hit, "query_id", "left").fillna({"hits": 0})
    return per.agg(
        F.round(F.avg(F.col("hits") / k), 6).alias("precision"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.col("hits") == F.col("n")).cast("double")), 6).alias("coverage"),
    )


def stale_leakage(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_stale, status_accuracy): superseded ids retrieved, and the share of right statuses. answers: (case, retrieved, status); labels: (case, stale, expected)."""
    j = answers.join(labels, "case")
    return j.agg(F.sum(F.size(F.array_intersect("retrieved", "stale"))).cast("long").alias("n_stale"), F.avg((F.col("status") == F.col("expected")).cast("double")).alias("status_accuracy"))


def latency(times: DataFrame, column: str) -> DataFrame:
    return times.agg(F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.95).alias("p95"))


def rank_predicates(clauses: DataFrame, text: str) -> DataFrame:
    """(predicate, score, source): predicates by their names', facts' and rules' words in a question; source is the part of source texts.

    A name's words give 100 each, the whole name 200 more, one edit away 50; different words of its facts 30 and of
    its rules 10 each; 80 where the question is about the past and the predicate an archive; words of source texts 40 each and the
    whole question in one 120.
    """
    asked = F.array_distinct(words(F.lit(text)))
    low = text.strip().lower()
    sized = lambda c: F.filter(c, lambda w: F.length(w).between(*FUZZY))
    terms = lambda c: F.array_distinct(F.flatten(F.transform(F.filter(c, lambda t: F.length(t) <= TERM_CHARS), words)))
    hits = lambda c: F.array_intersect(c, asked)
    df = clauses.where("head <> ''").select(
        F.col("head").alias("predicate"), hits(F.when(F.col("kind") == "fact", terms(F.col("terms"))).otherwise(F.array().cast("array<string>"))).alias("facts"),
        hits(F.when(F.col("kind") == "fact", F.array().cast("array<string>")).otherwise(terms(F.col("body")))).alias("rules"),
        hits(words(F.col("source"))).alias("source"), F.contains(F.lower("source"), F.lit(low)).alias("phrase") if low else F.lit(False).alias("phrase"),
    )
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    per = df.groupBy("predicate").agg(*(union(c).alias(c) for c in ("facts", "rules", "source")), F.max("phrase").alias("phrase"))
    name = F.array_distinct(words(F.col("predicate")))
    near = F.size(F.filter(F.array_except(sized(name), asked), lambda p: F.exists(sized(asked), lambda w: nearly(p, w))))
    source = F.col("source") * 40 + F.when(F.col("phrase"), 120).otherwise(0)
    score = F.size(hits(name)) * 100 + F.when(F.contains(F.lit(text.lower()), F.lower("predicate")), 200).otherwise(0) + near * 50 + F.col("facts") * 30 + F.col("rules") * 10
    score += F.when(F.lit(bool(TEMPORAL.search(text))) & F.col("predicate").endswith("_until"), 80).otherwise(0)
    return per.select("predicate", (score + source).alias("score"), source.alias("source"))


class BudgetError(DatalogError):
    """What belongs to the best predicate doesn't fit into the bounds."""


def select_schema(clauses: list[Clause], spark: SparkSession, text: str, most: int = 8, sources: dict[str, str] | None = None) -> list[str]:
    """The predicates, as name/arity, that a question is about, the best first: each with all that its rules rest on.

    With a question about the past, and for archives, a predicate comes with its archive or the one that it archives. A predicate
    whose dependencies don't all fit among `most` is left out; the best one, if anything speaks for it, is an error then.
    """
    if not 1 <= most <= 256:
        raise ValueError("most must be from 1 to 256")
    if len(clauses) > 100_000:
        raise LimitError("more than 100,000 clauses")
    scores = {r["predicate"]: r["score"] for r in rank_predicates(clause_table(spark, clauses, sources), text).collect()}
    needs: dict[tuple[str, int], set] = {c.head.key: set() for c in clauses if c.head}
    if len(needs) > 10_000:
        raise LimitError("more than 10,000 predicates")
    for c in clauses:
        if c.head:
            needs[c.head.key] |= {k for g in c.body if isinstance(g, (Lit, Not)) for k in [g.lit.key if isinstance(g, Not) else g.key] if k in needs}
    past = bool(TEMPORAL.search(text))

    def closure(start: tuple[str, int]) -> set:
        out, todo = set(), [start]
        while todo:
            k = todo.pop()
            if k in out or k not in needs:
                continue
            out.add(k)
            todo += needs[k]
            if k[0].endswith("_until"):
                todo.append((k[0].removesuffix("_until"), k[1] - 1))
            elif past:
                todo.append((k[0] + "_until", k[1] + 1))
        return out

    label = lambda k: f"{k[0]}/{k[1]}"
    ranked, chosen = sorted(needs, key=lambda k: (-scores.get(k[0], 0), label(k))), set()
    for k in ranked:
        more = closure(k) - chosen
        if len(chosen) + len(more) <= most:
            chosen |= more
        elif not chosen and scores.get(k[0], 0) > 0:
            raise BudgetError(f"{label(k)} and what it rests on are more than {most} predicates")
        if len(chosen) >= most:
            break
    if needs and not chosen:
        raise BudgetError(f"no predicate with all that it rests on fits among {most}")
    return [label(k) for k in ranked if k in chosen]


def near_words(words_: DataFrame, column: str = "w") -> DataFrame:
    """(a, b), a < b: the different words of 4 to 64 characters that one edit tells apart.

    Such words share one of the strings that deleting one character or none leaves, on which they are joined. The strings are many times
    what is read, which the planner can't know: they are shuffled, never broadcast.
    """
    one = words_.select(F.col(column).alias("w")).where(F.length("w").between(*FUZZY)).distinct()
    left = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring(F.col("w"), 1, i - 1), F.substring(F.col("w"), i + 1, F.lit(FUZZY[1]))))
    forms = one.select("w", F.explode(F.array_distinct(F.concat(F.array("w"), left))).alias("form"))
    a, b = forms.select(F.col("w").alias("a"), "form"), forms.select(F.col("w").alias("b"), "form")
    return a.hint("merge").join(b, "form").where((F.col("a") < F.col("b")) & nearly(F.col("a"), F.col("b"))).select("a", "b").distinct()


__all__ = ["FUZZY", "STOP", "bm25", "document_search", "rerank", "search"]
