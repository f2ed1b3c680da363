"""Every operator and stage over awkward and empty tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sylloge.llm import bpe, exact_dedup, licenses, mixing, neighbours, pii, secrets, simhash, substrings, toxicity
from tests.llm.data import awkward, documents, empty, labels

SOME = [(1, 1, 0), (3, 1, 0), (8, 1, 0), (11, 1, 0), (13, 0, 1), (14, 0, 1), (99, 1, 1), (None, 1, 1), (12, None, None)]


def operators(spark):
    lab = labels(spark, SOME)
    return {
        "simhash": simhash.near_duplicates, "licenses": licenses.license_scan, "bpe": bpe.encode_documents, "toxicity": lambda d: toxicity.toxic_documents(d, lab), "mixing": mixing.schedule,
        "exact": exact_dedup.exact_duplicates, "pii": pii.find_pii, "secrets": lambda d: secrets.find_secrets(d, lab), "substrings": substrings.repeated_passages,
    }


@pytest.mark.parametrize("name", ["simhash", "licenses", "bpe", "toxicity", "mixing", "exact", "pii", "secrets", "substrings"])
def test_empty(spark, name):
    assert operators(spark)[name](empty(spark)).count() == 0


def test_awkward(spark):
    docs, ops = awkward(spark), operators(spark)
    got = {n: [tuple(r) for r in ops[n](docs).collect()] for n in ops}
    assert sorted(got["exact"]) == [(2, 1), (5, 4)]
    assert sorted(got["simhash"]) == [(2, 1), (3, 1)]
    assert len(got["bpe"]) == docs.count() and all(r[3] in (True, None) for r in got["bpe"]) and [r[1] for r in got["bpe"] if r[0] == 4] == [0] and [r[1] for r in got["bpe"] if r[0] == 6] == [None]
    assert sorted((r[0], r[1]) for r in got["pii"]) == [(14, "email"), (14, "phone")]
    assert [r[0] for r in got["secrets"]] == [14]
    assert {(r[0], r[3]) for r in got["substrings"]} >= {(1, True), (2, False), (3, False)} and not {4, 5, 6, 9, 12} & {r[0] for r in got["substrings"]}
    assert got["licenses"] == []  # no text of the table is a licence
    model = toxicity.fit(docs, labels(spark, SOME))
    assert {r[0] for r in got["toxicity"]} == {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None and r["text"] and model.score(pa.array([r["text"]]), {})[0] >= 1}
    taken = {r[0] for r in got["mixing"]}
    assert taken == {None, 1, 2, 3, 7, 8, 10, 11, 12, 13, 14}


def test_rewriting_operators_keep_columns(spark):
    docs = awkward(spark)
    n, lab = docs.count(), labels(spark, SOME)
    for f, rows in ((exact_dedup.remove_exact_duplicates, n - 3), (simhash.remove_near_duplicates, n - 3), (pii.redacted, n), (substrings.remove_repeats, n), (lambda d: toxicity.remove_toxic(d, lab), None)):
        out = f(docs)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert rows is None or out.count() == rows
    assert docs.where("text IS NULL").count() == toxicity.remove_toxic(docs, lab).where("text IS NULL").count()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("text IS NULL").count() == 2 and mixed.where("text = ''").count() == 2
    text = pii.redacted(docs).where("doc_id = 14").first()["text"]
    assert "<email>" in text and "<phone>" in text and "j.doe" not in text


def test_licenses_of_awkward_texts(spark):
    known = spark.createDataFrame([(licenses.digest("Be nice to all."), "Nice-1.0"), (licenses.digest("Be nice to all."), "Kind-1.0")], "digest string, license string")
    docs = awkward(spark).limit(3).withColumn("text", F.lit("x" * 200_000 + "\n\nBE NICE to all\n"))
    rows = docs.union(docs.limit(1)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(1).withColumn("text", F.lit("")))
    got = licenses.license_scan(rows, known)
    assert got.columns == ["doc_id", "unit", "place", "license"] and got.count() == 5 * 2 * 2 and got.where("doc_id IS NULL").count() == 4


def test_decoding_beside_other_columns(spark):
    docs = awkward(spark)
    encoded = docs.withColumnRenamed("text", "was").join(bpe.encode_documents(docs).select(F.col("doc_id").alias("i"), "tokens", F.monotonically_increasing_id().alias("TEXT")).where("i = 1"), F.col("doc_id") == F.col("i"))
    out = bpe.decode_documents(encoded)
    assert [c.lower() for c in out.columns].count("text") == 1 and all(r["was"] == r["text"] for r in out.select("was", "text").collect()) and out.count() == 1
    assert bpe.decode_documents(encoded.limit(0)).count() == 0


def test_neighbours_beside_other_columns(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] * 2 + [(None, [1.0, 1.0, 1.0]), (50, None), (51, []), (52, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for i, c in enumerate(["id", "v", "rank", "similarity", "neighbour_id", "curve", "key"]):
        df = df.withColumn(c, F.lit(i))
    got = neighbours.nearest_neighbours(df, 3)
    assert got.columns == ["vec_id", "neighbour_id", "similarity", "rank"] and got.count() == 40 * 3 and got.where("vec_id = neighbour_id").count() == 0


def test_many_rows_without_tokens(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EMPTY_ROWS", 10)
    docs = documents(spark, [None, "", " ", "one two"] * 30)
    out = mixing.mix(docs)
    assert out.where("text IS NULL OR trim(text) = ''").count() == 90 and out.where("trim(text) = 'one two'").count() >= 30
    used = out.where("text IS NULL OR trim(text) = ''").select(F.spark_partition_id()).distinct().count()
    assert used > 1


def test_stages_on_nothing(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (empty(spark), awkward(spark)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            out.count()
