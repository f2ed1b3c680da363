"""Programs, results, bundles and transcripts as files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.local import LimitError
from ..plans.syntax import Clause, DatalogError, canonical, parse_program, write

MAX_ROWS, MAX_BYTES = 10_000, 16 << 20
TRANSCRIPT = "role string, content string, ts string"


def read_program(spark: SparkSession, path: str) -> list[Clause]:
    """The clauses of a text file, or of all files of a folder in the order of their names."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value").orderBy("name").collect()
    return [c for r in rows for c in parse_program(r["value"])]


def write_program(spark: SparkSession, clauses: list[Clause], path: str) -> None:
    spark.createDataFrame([(i, write(c)) for i, c in enumerate(clauses)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def json_rows(df: DataFrame, most: int = MAX_ROWS, most_bytes: int = MAX_BYTES) -> str:
    """The rows as a JSON array; an error for more than most rows or bytes."""
    rows = [r[0] for r in df.limit(most + 1).select(F.to_json(F.struct(*df.columns))).collect()]
    if len(rows) > most:
        raise LimitError(f"more than {most} rows")
    text = "[" + ",".join(rows) + "]"
    if len(text.encode()) > most_bytes:
        raise LimitError(f"more than {most_bytes} bytes")
    return text


def export_bundle(clauses: list[Clause], sources: dict[str, list[dict]] | None = None, checks: list[dict] | None = None) -> str:
    """A program with sources and checks as canonical JSON that holds its own SHA-256."""
    body = {
        "version": 1, "clauses": sorted({canonical(c) for c in clauses}),
        "sources": {k: sorted(v, key=lambda s: json.dumps(s, sort_keys=True)) for k, v in (sources or {}).items()}, "checks": checks or [],
    }
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return json.dumps({"digest": hashlib.sha256(text.encode()).hexdigest(), "body": body}, sort_keys=True, separators=(",", ":"))


def verify_bundle(text: str) -> dict:
    """The body of a bundle; an error if it isn't what the digest was made of, or holds text that can't be read."""
    bundle = json.loads(text)
    body = json.dumps(bundle["body"], sort_keys=True, separators=(",", ":"))
    if hashlib.sha256(body.encode()).hexdigest() != bundle["digest"]:
        raise DatalogError("the bundle's digest is another")
    for c in bundle["body"]["clauses"]:
        parse_program(c)
    return bundle["body"]


def transcript_tail(rows: DataFrame, order: list[str], most: int, roles: tuple[str, ...] = ("user", "assistant"), by: str | None = None) -> DataFrame:
    """The last rows of a chat with these roles; of each one where by names the column that tells chats apart."""
    from pyspark.sql import Window

    rows = rows.where(F.col("role").isin(*roles))
    if by is None:
        return rows.orderBy(*(F.desc(c) for c in order)).limit(most)
    last = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most).drop("__n")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """A chat log of JSON lines; lines that can't be read are left out."""
    return spark.read.schema(TRANSCRIPT).json(path).where("role IS NOT NULL AND content IS NOT NULL")
