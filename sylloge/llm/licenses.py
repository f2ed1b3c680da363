"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, white space, copyright lines, comment signs and
equivalent spellings) and its SHA-256 is joined with a table of digests of known licences and notices. Whole
documents are looked up, and so are their paragraphs and their lines, each as an entire text. The digest
table has a fixed size, so broadcasting it is safe at any input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that state a copyright, in lower case. The syntax is what Java, RE2 and Python share.
COPYRIGHT_LINES = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: What such a line must hold, so that texts without it aren't searched.
COPYRIGHT_SIGNS = ["copyright", "(c)", "©", "all rights reserved"]
PUNCTUATION = r"[^a-z0-9\n]+"
#: Equivalent spellings, replaced in order in text of single spaces with one at either end.
SPELLINGS = [
    ("licence", "license"),
    ("licensed", "license"),
    ("licenced", "license"),
    ("licensing", "license"),
    ("licenses", "license"),
    (" sub license", " sublicense"),
    (" non commercial", " noncommercial"),
    (" organisation", " organization"),
    (" whilst ", " while "),
    (" https ", " "),
    (" http ", " "),
    (" version ", " "),
    *((f" v{gap}{n}", f" {n}") for n in "1234" for gap in (" ", "")),
]


def _lines(text: Column) -> Column:
    """The lines of a text, without copyright lines, case, punctuation and outer spaces."""
    low = F.lower(text)
    stated = F.contains(low, F.lit(COPYRIGHT_SIGNS[0]))
    for sign in COPYRIGHT_SIGNS[1:]:
        stated |= F.contains(low, F.lit(sign))
    bare = F.when(stated, F.regexp_replace(low, COPYRIGHT_LINES, "$1")).otherwise(low)
    return F.transform(F.split(F.regexp_replace(bare, PUNCTUATION, " "), "\n"), F.trim)


def _spelled(body: Column) -> Column:
    out = F.concat(F.lit(" "), body, F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def lines_sql(text: str) -> str:
    bare = rf"regexp_replace(lower({text}), '{COPYRIGHT_LINES}', '\1', 'g')"
    return f"list_transform(string_split(regexp_replace({bare}, '{PUNCTUATION}', ' ', 'g'), chr(10)), lambda l: trim(l))"


def spelled_sql(body: str) -> str:
    out = f"(' ' || {body} || ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim({out})"


def canonical(text: str) -> str:
    """The canonical form of one whole text, in Python."""
    import re

    bare = re.sub(COPYRIGHT_LINES, r"\1", text.lower())
    lines = [x.strip(" ") for x in re.sub(PUNCTUATION, " ", bare).split("\n")]
    out = " " + " ".join(x for x in lines if x) + " "
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return out.strip(" ")


def digest(text: str) -> str:
    import hashlib

    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known(spark: SparkSession) -> DataFrame:
    from .license_digests import DIGESTS

    return spark.createDataFrame(sorted(DIGESTS.items()), "digest string, license string")


def license_scan(docs: DataFrame, digests: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, unit, place, license): each document, paragraph and line that is entirely a known text.

    unit is 'document', 'paragraph' or 'line'; place counts the paragraphs or lines from 0. Paragraphs are
    parted by lines without letters and digits or with a copyright; they and lines are reported only where a
    document has two or more. digests has the columns (digest, license) and is broadcast. Null and empty
    texts match nothing; rows with a null id are scanned like others; repeated rows give repeated results, and a text with two
    names in digests both; texts are looked up whole, however long; an empty table gives an empty result. Other columns,
    whatever their names, are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    lines = base.select("doc_id", _lines(F.col("text")).alias("lines"))
    split = lines.select("doc_id", "lines", F.split(F.trim(F.array_join("lines", "\n"), F.lit("\n")), "\n\n+").alias("paragraphs"))
    unit = lambda name, place, body: F.struct(F.lit(name).alias("unit"), place.cast("long").alias("place"), body.alias("body"))
    whole = F.array_join(F.filter("lines", lambda x: x != ""), " ")
    units = split.select(
        "doc_id",
        F.explode(
            F.concat(
                F.array(unit("document", F.lit(0), whole)),
                F.filter(F.transform("paragraphs", lambda x, i: unit("paragraph", i, F.replace(x, F.lit("\n"), F.lit(" ")))), lambda u: F.size("paragraphs") > 1),
                F.filter(F.transform("lines", lambda x, i: unit("line", i, x)), lambda u: F.size("lines") > 1),
            )
        ).alias("u"),
    ).select("doc_id", "u.unit", "u.place", F.sha2(_spelled(F.col("u.body")), 256).alias("digest"))
    return units.join(F.broadcast(digests if digests is not None else known(spark)), "digest").select("doc_id", "unit", "place", "license")
