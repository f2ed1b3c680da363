"""The whole pipeline against a version in plain Python."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from sylloge.llm import bpe, mixing, toxicity
from tests.conftest import SF
from tests.llm.test_brute import groups, near_pairs


def scheduled(rows):
    """How often each (source, id) is taken: every slot of the golden-ratio schedule in turn."""
    tokens = collections.Counter()
    for i, source, text in rows:
        tokens[source, i] += len(re.findall(r"[^ \t\n\r\f\v]+", text))
    total = collections.Counter()
    for (s, _), n in tokens.items():
        total[s] += n
    names = sorted(s for s in total if total[s])
    weight = {s: float(total[s]) ** mixing.ALPHA for s in names}
    whole, at, ends = sum(weight[s] for s in names), 0.0, []
    for s in names:
        at += weight[s]
        ends.append((int(at / whole * 2**32), s))
    ends[-1] = (2**32, names[-1])
    blocks = {s: -(-total[s] // mixing.BLOCK_TOKENS) for s in names}
    members = collections.defaultdict(list)
    for s in names:
        first = 0
        for _, i in sorted((hashlib.md5(f"{mixing.SEED}:{s}:{i}".encode()).hexdigest(), i) for (t, i), n in tokens.items() if t == s and n):
            members[s, first // mixing.BLOCK_TOKENS].append(i)
            first += tokens[s, i]
    taken, rank, slot = collections.Counter(), collections.Counter(), 0
    while any(rank[s] < blocks[s] for s in names):
        point = slot % 2**31 * mixing.GOLDEN % 2**32
        s = next(s for end, s in ends if point < end)
        for i in members[s, rank[s] % blocks[s]]:
            taken[s, i] += 1
        rank[s] += 1
        slot += 1
    return taken


def test_pipeline(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    model = toxicity.fit(docs, labels)
    score = model.score(pa.array([t for _, _, t in rows]), {})
    rows = [r for r, s in zip(rows, score) if s < 1]
    first = {}
    rows = [r for r in sorted(rows) if first.setdefault(r[2], r[0]) == r[0]]
    gone = {rows[a][0] for a, _ in groups(near_pairs([t for _, _, t in rows]))}
    rows = [r for r in rows if r[0] not in gone]
    taken = scheduled(rows)
    encoder = bpe.Encoder(bpe.Tables.of(bpe.read_ranks(bpe.VOCABULARY)))
    want = collections.Counter()
    for i, s, t in rows:
        want[i, tuple(np.frombuffer(encoder.encode(t), dtype=np.int32).tolist())] += taken[s, i] if t.split() else 1
    got = collections.Counter((r["doc_id"], tuple(r["tokens"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and len(got) > 100


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
