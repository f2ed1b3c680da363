"""Toxicity by class-conditional Kneser-Ney language models.

Two character n-gram models over words, one of toxic and one of ordinary labelled documents, share the
counts they back off to: an expression that is rare in a class gets the probability that the corpus as a
whole gives it, so only well attested differences count. A document has two length-normalised log-likelihood ratios: that
of its most telling word by the word's length, and the sum of what all words have beyond a margin by the
document's length, for expressions that tell only together. It is toxic where either reaches its threshold; both are
fitted on labelled documents that the counts leave out, and then these are counted too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, release, written
from .tokens import Words, chunks, split

#: Characters of an n-gram, the last of which is predicted.
ORDER = 5
#: Kneser-Ney discount.
DISCOUNT = 0.75
#: One labelled document in so many, by the hash of its id, is held out for the threshold.
HELD_OUT = 5
#: N-grams a broadcast model may have; a larger one stays in a table, whole, and words are scored by joins with it.
MAX_NGRAMS = 8_000_000
#: Labelled ids that may be broadcast (64 MB), so that texts stay where they are; more are joined by a shuffle.
BROADCAST_LABELS = 4_000_000
#: Steps of the two ratios for which the held-out documents are counted.
STEPS = (0.02, 0.005)
#: Log-likelihood ratio of a word beyond which it adds to the second ratio, and words added to every document's length.
MARGIN, LENGTH = 3.0, 50

_BITS = 10
_START, _END = 1, 2


def symbols(points: np.ndarray) -> np.ndarray:
    """Code points as numbers below 1024: those below 592 one for one, others folded."""
    return np.where(points < 592, points + 3, 595 + points % 429).astype(np.int64)


@dataclass
class Grams:
    keys: np.ndarray  # n-grams, of all words
    word: np.ndarray  # of each n-gram
    length: np.ndarray  # n-grams of each word


def grams(words: list[str]) -> Grams:
    """The n-grams of each word with its start and end."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = symbols(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32))
    pad = ORDER - 1
    width = length + pad + 1
    ends = np.cumsum(width)
    flat = np.full(int(ends[-1]) if len(ends) else 0, _START, dtype=np.int64)
    within = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
    flat[np.repeat(ends - width, length) + pad + within] = points
    flat[ends - 1] = _END
    keys = flat.copy()
    for k in range(1, ORDER):
        keys[k:] |= flat[:-k] << (_BITS * k)
    used = np.arange(len(flat)) - np.repeat(ends - width, width) >= pad
    return Grams(keys[used], np.repeat(np.arange(len(words)), length + 1), length + 1)


def distinct_words(w: Words) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(hashes of the distinct words, these words, which of them each word is)."""
    hashes, one, which = np.unique(w.hashes, return_index=True, return_inverse=True)
    raw = w.buf.tobytes()
    return hashes, [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[one].tolist(), w.ends[one].tolist())], which


#: Counts of an n-gram: in ordinary and toxic texts that are counted, and in those that are held out.
CLASSES = ["ordinary", "toxic", "held_ordinary", "held_toxic"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each n-gram in the texts of each class."""
    keys, counts = np.empty(0, dtype=np.int64), np.empty((0, 4), dtype=np.int64)
    held: list = []

    def merge():
        nonlocal keys, counts
        k, c = np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([counts, *(y for _, y in held)])
        keys, which = np.unique(k, return_inverse=True)
        counts = np.stack([np.bincount(which, c[:, i], len(keys)) for i in range(4)], axis=1).astype(np.int64)
        held.clear()

    for batch in chunks(batches):
        w = split(batch["text"], apart=False)
        _, distinct, which = distinct_words(w)
        if not distinct:
            continue
        of = batch["class"].to_numpy(zero_copy_only=False)[w.doc]
        uses = np.stack([np.bincount(which, of == i, len(distinct)) for i in range(4)], axis=1)
        g = grams(distinct)
        k, inverse = np.unique(g.keys, return_inverse=True)
        held.append((k, np.stack([np.bincount(inverse, uses[g.word, i], len(k)) for i in range(4)], axis=1)))
        if sum(len(x) for x, _ in held) > 2_000_000:
            merge()
    if held:
        merge()
    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(counts[:, i], pa.int64()) for i in range(4))], ["gram", *CLASSES])
    del keys, counts
    release()


@dataclass
class Model:
    """Log-likelihood ratios, toxic against ordinary, of known n-grams and of others by their context."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    context_ratios: np.ndarray
    thresholds: tuple[float, float] = (np.inf, np.inf)

    def words(self, words: list[str]) -> np.ndarray:
        """(log-likelihood ratio by length, excess over the margin) of each word."""
        g = grams(words)
        value = _looked_up(self.contexts, self.context_ratios, g.keys >> _BITS, 0.0)
        value = _looked_up(self.grams, self.ratios, g.keys, value)
        total = np.bincount(g.word, value, len(words))
        return np.stack([total / g.length, np.maximum(total - MARGIN, 0)], axis=1)

    def ratios_of(self, texts: pa.Array, cache: dict[int, tuple[float, float]]) -> np.ndarray:
        """The two ratios of each text; 0 without words."""
        w = split(texts, apart=False)
        out = np.zeros((len(texts), 2))
        if not len(w.doc):
            return out
        hashes, one, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        missing = (np.nan, np.nan)
        known = np.array([cache.get(h, missing) for h in hashes.tolist()])
        new = np.flatnonzero(np.isnan(known[:, 0]))
        if len(new):
            raw, places = w.buf.tobytes(), one[new]
            known[new] = self.words([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[places].tolist(), w.ends[places].tolist())])
            if len(cache) > CACHE:
                cache.clear()
            cache.update(zip(hashes[new].tolist(), map(tuple, known[new].tolist())))
        begins = np.flatnonzero(np.diff(w.doc, prepend=-1))
        each, own = known[which], w.doc[begins]
        out[own, 0] = np.maximum.reduceat(each[:, 0], begins)
        out[own, 1] = np.add.reduceat(each[:, 1], begins) / (np.diff(np.append(begins, len(w.doc))) + LENGTH)
        return out

    def score(self, texts: pa.Array, cache: dict[int, tuple[float, float]]) -> np.ndarray:
        """The larger ratio of each text in terms of its threshold; toxic from 1 on."""
        return (self.ratios_of(texts, cache) / self.thresholds).max(axis=1)


#: Scores of words a Python worker remembers.
CACHE = 200_000


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(default, wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, sums of each values) of sorted keys."""
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begins], *(np.add.reduceat(v, begins) if len(begins) else v[:0] for v in values)


def kneser_ney(keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Model:
    """The model of n-gram counts. keys: sorted, distinct.

    Lower orders count in how many different contexts, of both classes together, a shorter n-gram occurs,
    and are interpolated down to the uniform distribution.
    """
    # shared[k]: P(last symbol | k - 1 before it) of every k-gram that is seen
    tails = [np.unique(keys & ((1 << _BITS * k) - 1)) for k in range(1, ORDER)]
    lower, lower_p = None, None
    for k in range(1, ORDER):
        grams_k = tails[k - 1]
        longer = tails[k] if k < ORDER - 1 else keys
        n = np.bincount(np.searchsorted(grams_k, longer & ((1 << _BITS * k) - 1)), minlength=len(grams_k)).astype(float)
        context, total = _grouped(grams_k >> _BITS, n)
        kinds = _grouped(grams_k >> _BITS, np.ones(len(grams_k)))[1]
        at = np.searchsorted(context, grams_k >> _BITS)
        below = 1 / (1 << _BITS) if lower is None else lower_p[np.searchsorted(lower, grams_k & ((1 << _BITS * (k - 1)) - 1))]
        lower_p = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds[at] * below) / total[at]
        lower = grams_k
    back = lower_p[np.searchsorted(lower, keys & ((1 << _BITS * (ORDER - 1)) - 1))]
    context = _grouped(keys >> _BITS, ordinary)[0]
    at = np.searchsorted(context, keys >> _BITS)
    logs, backs = [], []
    for n in (ordinary.astype(float), toxic.astype(float)):
        total, kinds = _grouped(keys >> _BITS, n, (n > 0).astype(float))[1:]
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)  # what is left for the shared counts
        backs.append(np.log(weight))
        logs.append(np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[at] + weight[at] * back))
    return Model(keys, (logs[1] - logs[0]).astype(np.float32), context, (backs[1] - backs[0]).astype(np.float32))


@dataclass
class Table:
    """The same ratios as those of Model, in tables: of any size."""

    grams: DataFrame  # gram, ratio
    contexts: DataFrame  # context, context_ratio
    thresholds: tuple[float, float] = (np.inf, np.inf)

    def words(self, texts: DataFrame) -> DataFrame:
        """(h, ratio, excess) of the distinct words of texts(text), by their hash, as Model.words gives them."""
        words = texts.select("text").mapInArrow(_distinct, "h long, word string").groupBy("h").agg(F.min("word").alias("word"))
        parts = words.mapInArrow(_parts, "h long, gram long, context long, size long")
        found = parts.join(self.grams, "gram", "left").join(self.contexts, "context", "left")
        value = F.coalesce(F.col("ratio"), F.col("context_ratio"), F.lit(0.0)).cast("double")
        total = found.groupBy("h").agg(F.sum(value).alias("total"), F.max("size").alias("size"))
        return total.select("h", (F.col("total") / F.col("size")).alias("ratio"), F.greatest(F.col("total") - MARGIN, F.lit(0.0)).alias("excess"))

    def ratios_of(self, texts: DataFrame, telling: bool = False) -> DataFrame:
        """(k1, k2, a, b): the two ratios of the texts with words in texts(k1, k2, text), once for each text.

        telling: only of texts that have a word with a ratio above 0, which is enough to find toxic ones.
        """
        words = self.words(texts)
        words = words.where("ratio > 0") if telling else words
        uses = texts.select("k1", "k2", "text").mapInArrow(_uses, "k1 long, k2 long, h long, n long, words long")
        each = uses.dropDuplicates(["k1", "k2", "h"]).join(words, "h")
        second = F.sum(F.col("excess") * F.col("n")) / (F.max("words") + LENGTH)
        return each.groupBy("k1", "k2").agg(F.max("ratio").alias("a"), second.alias("b"))

    def toxic(self, texts: DataFrame) -> DataFrame:
        """(k1, k2, score) of the toxic texts."""
        share = [F.col(c) / F.lit(float(t)) for c, t in zip("ab", self.thresholds)]
        return self.ratios_of(texts, telling=True).select("k1", "k2", F.greatest(*share).alias("score")).where("score >= 1")


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        hashes, distinct, _ = distinct_words(split(batch["text"], apart=False))
        if distinct:
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(distinct, pa.string())], ["h", "word"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each word, one row for each occurrence."""
    for batch in chunks(batches, "word"):
        g = grams(batch["word"].to_pylist())
        h = batch["h"].to_numpy()[g.word]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g.keys), pa.array(g.keys >> _BITS), pa.array(g.length[g.word])], ["h", "gram", "context", "size"])


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, how often it has them, and its number of words."""
    for batch in chunks(batches):
        w = split(batch["text"], apart=False)
        if not len(w.doc):
            continue
        hashes, which = np.unique(w.hashes, return_inverse=True)
        hashes, doc = hashes.view(np.int64), w.doc
        pair, n = np.unique(doc * len(hashes) + which, return_counts=True)
        own = pair // len(hashes)
        k1, k2 = (batch[c].to_numpy()[own] for c in ("k1", "k2"))
        columns = [k1, k2, hashes[pair % len(hashes)], n, np.bincount(doc, minlength=batch.num_rows)[own]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "h", "n", "words"])


def kneser_ney_table(counted: DataFrame) -> Table:
    """kneser_ney() by joins, of counted(gram, ordinary, toxic) with distinct grams.

    N-grams of one context differ in the last symbol only, so no window has more than 2**_BITS rows.
    """
    tail = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << _BITS * k) - 1))
    tails = {ORDER: counted.select(F.col("gram").alias("g"))}
    for k in range(ORDER - 1, 0, -1):
        tails[k] = tails[k + 1].groupBy(tail("g", k).alias("g")).agg(F.count("*").alias("n"))
    lower = None
    for k in range(1, ORDER):
        by = Window.partitionBy(F.shiftright("g", _BITS))
        t = tails[k].select("g", "n", F.sum("n").over(by).alias("total"), F.count("*").over(by).alias("kinds"), tail("g", k - 1).alias("tail"))
        t = t.withColumn("below", F.lit(1 / (1 << _BITS))) if lower is None else t.join(lower, "tail")
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")
        lower = t.select(F.col("g").alias("tail"), p.alias("below"))
    by = Window.partitionBy("context")
    rows = counted.withColumn("tail", tail("gram", ORDER - 1)).join(lower, "tail").withColumn("context", F.shiftright("gram", _BITS))
    logs, backs = [], []
    for c in ("ordinary", "toxic"):
        total, kinds = F.sum(c).over(by), F.sum((F.col(c) > 0).cast("int")).over(by)
        weight = F.when(total > 0, DISCOUNT * kinds / F.greatest(total, F.lit(1))).otherwise(1.0)
        backs.append(F.log(weight))
        logs.append(F.log(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1)) + weight * F.col("below")))
    rows = rows.select("context", "gram", (logs[1] - logs[0]).cast("float").alias("ratio"), (backs[1] - backs[0]).cast("float").alias("context_ratio"))
    rows = written(rows, "toxicity-ratios")
    return Table(rows.select("gram", "ratio"), rows.groupBy("context").agg(F.first("context_ratio").alias("context_ratio")))


def labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, text, toxic) of the labelled documents; an id that is labelled both ways counts as toxic."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return own.join(marks, "id")


def _bins(table: Table, rows: DataFrame) -> list[tuple[float, float, int, int]]:
    """(ratio, ratio, toxic, count) of rows(text, toxic), the ratios in whole steps."""
    rows = rows.select(*text_keys(F.col("text")), "text", "toxic")
    ratios = rows.drop("text").join(table.ratios_of(rows), ["k1", "k2"], "left")
    bins = [F.floor(F.coalesce(F.col(c), F.lit(0.0)) / step).alias(c) for c, step in zip("ab", STEPS)]
    found = ratios.select(*bins, "toxic").groupBy("a", "b", "toxic").count().collect()
    return [(r["a"] * STEPS[0], r["b"] * STEPS[1], r["toxic"], r["count"]) for r in found]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model | Table:
    """The model of all labelled documents of docs; without labels of both kinds, counted and held out, nothing is toxic.

    The thresholds are those that suit the held-out documents best under a model that doesn't count them.
    """
    held = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    rows = labelled(docs, labels, text, doc_id).select("text", "toxic", held.alias("held"))
    counted = rows.select("text", (F.col("toxic") + F.when(F.col("held"), 2).otherwise(0)).alias("class"))
    counted = counted.mapInArrow(_count, f"gram long, {', '.join(f'{c} long' for c in CLASSES)}")
    counted = written(counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in CLASSES)), "toxicity-counts")
    n, *sums = counted.agg(F.count("*"), F.sum("ordinary"), F.sum("toxic")).first()
    if not all(sums):
        return Model(*(np.empty(0, dtype=t) for t in (np.int64, np.float32, np.int64, np.float32)))
    if n > MAX_NGRAMS:
        part = kneser_ney_table(counted.select("gram", "ordinary", "toxic").where("ordinary + toxic > 0"))
        thresholds = best_thresholds(_bins(part, rows.where("held")))
        table = kneser_ney_table(counted.select("gram", (F.col("ordinary") + F.col("held_ordinary")).alias("ordinary"), (F.col("toxic") + F.col("held_toxic")).alias("toxic")))
        table.thresholds = thresholds
        return table
    counted = counted.toArrow().sort_by("gram")
    keys, *counts = (counted[c].to_numpy() for c in ("gram", *CLASSES))
    seen = counts[0] + counts[1] > 0
    shared = docs.sparkSession.sparkContext.broadcast(kneser_ney(keys[seen], counts[0][seen], counts[1][seen]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, tuple[float, float]] = {}
        for batch in chunks(batches):
            bins = np.floor(shared.value.ratios_of(batch["text"], cache) / STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(bins[:, 0]), pa.array(bins[:, 1])], ["toxic", "a", "b"])

    found = rows.where("held").select("text", "toxic").mapInArrow(binned, "toxic int, a long, b long").groupBy("a", "b", "toxic").count().collect()
    model = kneser_ney(keys, counts[0] + counts[2], counts[1] + counts[3])
    model.thresholds = best_thresholds([(r["a"] * STEPS[0], r["b"] * STEPS[1], r["toxic"], r["count"]) for r in found])
    return model


def best_thresholds(found: list[tuple[float, float, int, int]]) -> tuple[float, float]:
    """The two thresholds with the fewest errors in (ratio, ratio, toxic, count), each in the middle of its range."""
    options = []
    for t in sorted({x[0] for x in found if x[0] > 0}) + [np.inf]:
        above = sum(n for a, _, toxic, n in found if a >= t and not toxic)
        rest = [(b, toxic, n) for a, b, toxic, n in found if a < t]
        second, wrong = best_threshold(rest)
        options.append((above + wrong, t, second))
    least = min(w for w, _, _ in options)
    good = [t for w, t, _ in options if w == least]
    first = good[len(good) // 2]
    below = [x[0] for x in found if x[0] < first]
    if np.isfinite(first) and len(good) == 1 and below:
        first = (max(below) + STEPS[0] + first) / 2
    return float(first), best_threshold([(b, toxic, n) for a, b, toxic, n in found if a < first])[0]


def best_threshold(found: list[tuple[float, int, int]]) -> tuple[float, int]:
    """(threshold, errors) with the fewest errors in (ratio, toxic, count), in the middle between two ratios; infinite where calling none toxic is as good."""
    by: dict[float, list[int]] = {}
    for s, t, n in found:
        by.setdefault(s, [0, 0])[t] += n
    scores = sorted(by)
    none = sum(by[s][1] for s in scores)
    wrong = sum(by[s][0] for s in scores)  # all called toxic
    options = [(none, float("inf"))]
    for i, s in enumerate(scores):
        if s > 0:
            options.append((wrong, (scores[i - 1] + STEPS[1] + s) / 2 if i else s))
        wrong += by[s][1] - by[s][0]
    least = min(w for w, _ in options)
    good = sorted(t for w, t in options if w == least)
    return good[-1], least


def scorer(model: Model, docs: DataFrame):
    """A column function: the score of a text; 0 for null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[int, tuple[float, float]] = {}
        for part in parts:
            part = part.fill_null("") if part.null_count else part
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            done = [shared.value.score(x["text"], cache) for x in chunks(iter([batch]))]
            yield pa.array(np.concatenate(done) if done else np.empty(0), pa.float64())
        cache.clear()
        release()

    return score


def toxic_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score): the documents with a score of at least 1, the larger of the two ratios over their thresholds.

    Words are runs of letters, marks and digits, in lower case. Null texts, empty ones and those without words score 0 and are
    not toxic; whole texts are scored, however long; rows with a null id are left out, repeated rows repeat, and an id with several
    texts is listed for each that is toxic; with no labels of one kind, or an empty table, the result is empty. Other columns,
    whatever their names, are ignored.
    """
    model = fit(docs, labels, text, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    if isinstance(model, Table):
        keyed = rows.select("doc_id", *text_keys(F.col("text")), "text")
        return keyed.drop("text").join(model.toxic(keyed), ["k1", "k2"]).select("doc_id", "score")
    scored = rows.select("doc_id", scorer(model, docs)("text").alias("score"))
    return scored.where(F.col("score") >= 1)


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose text is toxic: toxic_documents() says which texts are.

    Null texts, empty ones and those without words stay, and so do all rows where there are no labels of one kind. Rows go
    by their text alone: equal texts share their fate whatever their ids, null ids too. Very long texts are scored whole; an empty table
    gives an empty one; columns and their names are those of docs, whatever they are.
    """
    model = fit(docs, labels, text, doc_id)
    if isinstance(model, Table):
        own = F.coalesce(F.col(text).cast("string"), F.lit(""))
        gone = model.toxic(docs.select(*text_keys(own), own.alias("text"))).drop("score")
        names = [fresh(docs, "toxic_k1"), fresh(docs, "toxic_k2")]
        keyed = docs.select("*", *(k.alias(n) for k, n in zip(text_keys(own), names)))
        return keyed.join(gone.toDF(*names), names, "left_anti").select(*docs.columns)
    score = scorer(model, docs)(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.where(score < 1)
