"""Small tables with everything that can go wrong."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "key", "rep", "slot", "gone_id", "cut_id", "mix_slot", "mix_words", "clean_text", "value", "unit", "n_tokens", "root"]


def prose(rnd, n):
    syllables = ["an", "the", "er", "ing", "on", "re", "st", "nd", "ou", "le", "tion", "ble", "ha", "es"]
    return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n))


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % len(sources or "abc")], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with names that operators use."""
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    same = prose(rnd, 80)
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, same.upper(), None, "b", None), (4, "", "en", "b", 0), (5, "", None, None, 0),
        (6, None, "en", "a", None), (None, same, "en", "a", 1), (None, None, None, None, None), (7, "x" * 300_000, "en", "b", 1), (8, prose(rnd, 60_000), "en", "a", 1),
        (9, " \n\t ", "en", "a", 3), (10, "é日本語🙂 " * 5, "xx", "c", 1), (11, prose(rnd, 60), "en", "a", 1), (11, prose(rnd, 70), "en", "b", 1), (12, "one", "en", "a", 3), (13, "the " * 5_000, "en", "a", 1),
        (14, "mail j.doe@example.com, token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" +1 (375) 555-4393", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(i))
    return df


def empty(spark):
    return awkward(spark).limit(0)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
