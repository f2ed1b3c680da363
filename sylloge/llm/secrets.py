"""Secrets by character Markov models.

Two Markov chains over characters, one of random strings and one of ordinary identifiers, give a token the
log-likelihood ratio by which it is rather random. Both are trained from labelled samples: words of the
documents in the label table, as they are and joined in the styles of identifiers, numbers and
dates count as ordinary; strings drawn from the alphabets that keys, tokens and hashes use are random.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import chunks

#: Labelled documents whose words are ordinary samples at most, those of the smallest hashes of their ids.
SAMPLE_DOCS = 4_000
#: Samples of either class that are made, besides the words themselves.
SAMPLES = 40_000
#: Characters before the one that is predicted.
ORDER = 2
#: Weight of the shorter context's prediction, in observations.
BACK = 4.0
#: Least length of a token, alone and after a name such as "password".
LENGTH, NAMED_LENGTH = 16, 8
#: Least log-likelihood ratio of a token, alone and after such a name.
THRESHOLD, NAMED_THRESHOLD = 12.0, 0.0
SEED = 20240917

ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_NAMES = (
    "get set user id name list index count data file path value test config handler error max min size type http https com www src lib main py js "
    "html utf v1 v2 the and for that with this from have not are was you all can will more when time about out other into over new some could them "
    "see than then now look only come its think also back after use two how our work first well way even want because any these give day most "
    "people water word number part sound place year live great help through much before line right too mean old same tell boy follow came show "
    "correct horse battery staple green field house river stone winter summer letter paper market garden window bridge doctor captain engine "
    "request response server client message service manager factory builder controller repository component property attribute element parameter "
    "argument function method class object string integer boolean array buffer stream reader writer parser format encode decode convert transform "
    "update delete create insert select query table column database connection session token password secret key cache queue worker thread process "
    "event listener callback promise async await return default public private static final abstract interface extends implements import export "
    "application document customer account payment order product category invoice shipping address country language currency quantity discount "
    "version release branch commit merge license copyright permission granted software warranty liability provided without restriction "
    "configuration environment development production deployment container registry cluster network storage volume backup monitor metric logging"
).split()

#: Characters of tokens, as numbers from 1; 0 stands for the start and any other character is the last.
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
_KINDS = len(CHARS) + 2
_CODE = np.full(65536, _KINDS - 1, dtype=np.int64)
for _i, _c in enumerate(CHARS):
    _CODE[ord(_c)] = _i + 1

#: Every longest run of the characters of tokens, without the signs that it begins with.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[+/_-]*+([A-Za-z0-9][A-Za-z0-9+/_-]{%d,}={0,2})" % (LENGTH - 1))
_PIECE = re.compile(r"(?<![^/])[+_-]*+([A-Za-z0-9][A-Za-z0-9+_-]{%d,}={0,2})" % (LENGTH - 1))
_NAMED = re.compile(
    r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|credential)s?"
    r"[\"']?\s*(?:=>|:=|=|:)\s*[\"'`]?([^\s\"'`,;<>(){}\[\]]{%d,})" % NAMED_LENGTH,
    re.I,
)
_NAME_SIGN = re.compile(r"(?:d|t|n|y|e|h|l)s?[\"']?\s*[=:]", re.I)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all characters with ORDER starts before each text, place of each text)."""
    joined = "".join("\0" * ORDER + t for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(points == 0, 0, _CODE[np.minimum(points, 65535)])
    return codes, np.repeat(np.arange(len(texts)), [len(t) + ORDER for t in texts])


def _contexts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(used places, pair before each, character): only places that aren't starts."""
    at = np.flatnonzero(codes > 0)
    return at, codes[at - 2] * _KINDS + codes[at - 1], codes[at]


def chain(texts: list[str]) -> np.ndarray:
    """log P(character | two before it), smoothed by shorter contexts."""
    codes, _ = coded(texts)
    _, before, now = _contexts(codes)
    two = np.bincount(before * _KINDS + now, minlength=_KINDS**3).reshape(_KINDS, _KINDS, _KINDS).astype(float)
    one, none = two.sum(axis=0), two.sum(axis=(0, 1))
    p0 = (none + 0.5) / (none + 0.5).sum()
    p1 = (one + BACK * p0) / (one.sum(axis=-1, keepdims=True) + BACK)
    return np.log((two + BACK * p1) / (two.sum(axis=-1, keepdims=True) + BACK)).astype(np.float32)


def random_samples(n: int, seed: int = SEED) -> list[str]:
    """Strings of 8 to 64 characters of each alphabet, some with the prefixes that issuers use."""
    rnd = random.Random(seed)
    prefixes = ["", "", "", "", "", "AKIA", "ghp_", "sk-", "xoxb-", "AIza"]
    out = []
    for i in range(n):
        name = [*ALPHABETS][i % len(ALPHABETS)]
        body = "".join(rnd.choices(ALPHABETS[name], k=rnd.choice((8, 12, 16, 18, 20, 24, 32, 40, 64))))
        out.append((rnd.choice(prefixes) if name in ("base62", "base32", "upper", "url64") else "") + body)
    return out


def ordinary_samples(words: list[str], n: int, seed: int = SEED + 1) -> list[str]:
    """Words alone and joined as identifiers, paths, numbers, dates and repeated characters."""
    rnd = random.Random(seed)
    words = [w for w in words if w.isalpha()] or _NAMES
    out = list(words)
    for _ in range(n):
        w = [rnd.choice(_NAMES) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randint(2, 5))]
        style = rnd.randrange(10)
        if style > 7:
            out.append("".join(rnd.choices("0123456789", k=rnd.randint(4, 20))))
        elif style == 0:
            out.append("_".join(w))
        elif style == 1:
            out.append(w[0] + "".join(map(str.capitalize, w[1:])))
        elif style == 2:
            out.append("-".join(w))
        elif style == 3:
            out.append("/".join(w))
        elif style == 4:
            out.append("_".join(w).upper())
        elif style == 5:
            out.append("".join(w) + (str(rnd.randint(0, 999)) if rnd.random() < 0.5 else ""))
        elif style == 6:
            out.append("".join(map(str.capitalize, w)) + rnd.choice(["", str(rnd.randint(1, 99))]))
        else:
            out.append(rnd.choice([str(rnd.randint(0, 10**18)), f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", rnd.choice(CHARS) * rnd.randint(8, 40)]))
    return out


@dataclass
class Model:
    ratios: np.ndarray  # log P(random) - log P(ordinary) by two characters before and the character

    def score(self, tokens: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each token."""
        if not tokens:
            return np.empty(0)
        codes, which = coded(tokens)
        at, before, now = _contexts(codes)
        return np.bincount(which[at], self.ratios.reshape(-1, _KINDS)[before, now].astype(float), len(tokens))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Trained on all words of at most SAMPLE_DOCS labelled documents and on SAMPLES made strings of either class.

    Without labelled documents a short list of names stands in for their words.
    """
    ids = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id", "left_semi")
    words = rows.select(F.explode(F.split(F.col("text"), r"[^\p{L}]+")).alias("w")).where("length(w) >= 2")
    found = words.groupBy("w").count().orderBy(F.desc("count"), "w").select("w").toArrow()["w"].to_pylist()
    ordinary = ordinary_samples(found, SAMPLES)
    return Model(chain(random_samples(SAMPLES)) - chain(ordinary))


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether a name says that it is secret) of the tokens to score, apart and in order."""
    named = [(m.start(1), m.end(1), True) for m in _NAMED.finditer(text)] if _NAME_SIGN.search(text) else []
    out, k = list(named), 0
    for m in _TOKEN.finditer(text):
        a, b = m.span(1)
        while k < len(named) and named[k][1] <= a:
            k += 1
        if k == len(named) or b <= named[k][0]:
            out.append((a, b, False))
    return sorted(out)


def within(text: str, a: int, b: int, named: bool) -> list[tuple[int, int, bool]]:
    """What to score of a candidate that is no secret as a whole: the runs of a named one, the parts between slashes of a run."""
    if named:
        return [(a + m.start(1), a + m.end(1), False) for m in _TOKEN.finditer(text[a:b])]
    return [(a + m.start(1), a + m.end(1), False) for m in _PIECE.finditer(text[a:b])] if "/" in text[a:b] else []


def find_secrets(docs: DataFrame, labels: DataFrame, model: Model | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, named, score): every token that is rather a random string than an identifier.

    start and end count characters of the text from 0, end excluded; the secret itself is not copied. named
    says that a name such as "password" stands before it. Whole texts are scanned, and long tokens scored
    whole; of a token that is no secret so, the parts between slashes are scored too. Null and empty texts have none; rows with a null id keep it, repeated rows repeat; an empty table
    gives an empty result. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, text, doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, keep = batch["text"].to_pylist(), []
            todo = [(i, *x) for i, t in enumerate(texts) if t for x in candidates(t)]
            while todo:
                scores = shared.value.score([texts[i][a:b] for i, a, b, _ in todo]).tolist()
                secret = [s >= (NAMED_THRESHOLD if x[3] else THRESHOLD) for x, s in zip(todo, scores)]
                keep += [(*x, s) for x, s, yes in zip(todo, scores, secret) if yes]
                todo = [(x[0], *y) for x, yes in zip(todo, secret) if not yes for y in within(texts[x[0]], *x[1:]) if x[3] or y[:2] != x[1:3]]
            ids = batch["doc_id"].to_pylist()
            keep = [(ids[x[0]], *x[1:]) for x in sorted(keep)]
            columns = list(zip(*keep)) if keep else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "start", "end", "named", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, start int, end int, named boolean, score double")
