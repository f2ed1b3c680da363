"""The whole job where a cut, a rule or an order once left a part out."""

import random

import numpy as np
import pytest

from sylloge.llm import exact_dedup, neighbours, pii, secrets, toxicity
from sylloge.llm.common import table
from tests.llm.data import SCHEMA, documents

SF = "/root/testdata/sf0.01"


def test_toxicity_of_a_model_too_large_to_broadcast(spark, monkeypatch):
    docs, marks = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, marks)
    want = {r["doc_id"]: r["score"] for r in toxicity.toxic_documents(docs, marks).collect()}
    left = {r["doc_id"] for r in toxicity.remove_toxic(docs, marks).collect()}
    monkeypatch.setattr(toxicity, "MAX_NGRAMS", 1000)
    large = toxicity.fit(docs, marks)
    ratios = {r["gram"]: r["ratio"] for r in large.grams.collect()}
    assert len(want) > 10 and set(ratios) == set(model.grams.tolist())
    assert max(abs(ratios[g] - x) for g, x in zip(model.grams.tolist(), model.ratios.tolist())) < 1e-5
    got = {r["doc_id"]: r["score"] for r in toxicity.toxic_documents(docs, marks).collect()}
    assert got == pytest.approx(want, abs=1e-5)
    out = toxicity.remove_toxic(docs, marks)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == left


@pytest.mark.parametrize("kind", ["copies", "several vectors of an id"])
def test_neighbours_where_rows_repeat(spark, kind):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((300, 16)), 10, axis=0)
    if kind != "copies":
        x += 0.1 * rng.standard_normal(x.shape)
    ids = np.repeat(np.arange(300), 10)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(df, 10).toPandas()
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (v @ v.T).reshape(300, 10, 300, 10).max(axis=(1, 3))
    np.fill_diagonal(s, -9)
    least = np.sort(s, axis=1)[:, -10]
    assert len(got) == 3000 and not got.duplicated(["vec_id", "neighbour_id"]).any()
    assert (s[got.vec_id, got.neighbour_id] >= least[got.vec_id] - 1e-5).mean() >= 0.9


@pytest.mark.parametrize(("text", "found"), [
    ("write to jane [at] example [dot] com at 5.30", ["jane@example.com"]),
    ("jane.doe (at) example.org at www.site.org", ["jane.doe@example.org"]),
    ("jane at example dot com at www.site.org", ["jane@example.com"]),
    ("reach me at jane.doe (at) example.org", ["jane.doe@example.org"]),
    ("reach me at jane dot doe at example dot com", ["jane.doe@example.com"]),
])
def test_pii_with_a_second_sign(text, found):
    assert [x[3] for x in pii.scan(text) if x[0] == "email"] == found


def test_secrets_after_signs(spark):
    rnd = random.Random(3)
    keys = ["".join(rnd.choices(secrets.ALPHABETS["base62"], k=36)) for _ in range(5)]
    before = ["https://", "value /", "value +", "flag -", "documentation/information/configuration/installation/"]
    texts = [f"{b}{k} here" for b, k in zip(before, keys)]
    words = "documentation information configuration installation environment application value flag here".split()
    model = secrets.Model(secrets.chain(secrets.random_samples(4000)) - secrets.chain(secrets.ordinary_samples(words, 4000)))
    rows = secrets.find_secrets(documents(spark, texts), None, model).collect()
    assert {r["doc_id"] for r in rows} == set(range(5)) and all(texts[r["doc_id"]][r["start"] : r["end"]].endswith(keys[r["doc_id"]]) for r in rows)
    assert secrets.candidates("--" + "documentation-information") == [(2, 27, False)]
    assert len(secrets.within("x" * 20 + "/" + keys[0], 0, 57, False)) == 2


def test_exact_copies_go_by_row(spark):
    rows = [(1, "a"), (2, "a"), (2, "only here"), (3, "b"), (3, "b"), (None, "a"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = [(r["doc_id"], r["text"]) for r in exact_dedup.remove_exact_duplicates(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, "a"), (2, "only here"), (3, "b"), (None, "a"), (4, None)], key=str)
