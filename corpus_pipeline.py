"""The corpus pipeline: documents to mixed, deduplicated token sequences, a stage for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylloge.llm.bpe import encode_documents
from sylloge.llm.common import delete, table, written
from sylloge.llm.exact_dedup import remove_exact_duplicates
from sylloge.llm.mixing import mix
from sylloge.llm.simhash import remove_near_duplicates
from sylloge.llm.toxicity import remove_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without toxic texts, by models of the labelled ones among docs; all of docs where there are no labels of one kind.

    Null texts, and those without words, stay.
    """
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, of the smallest id; rows with a null id or text stay. Of empty texts one stays."""
    return remove_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of the smallest id; texts without words, null ids and null texts stay."""
    return remove_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the schedule; a document that it takes twice comes twice."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every row; nulls for a null text, no tokens for an empty one."""
    return encode_documents(docs)


#: Each stage gets what the one before returned, as written and read again.
STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The language models of the first stage and the signatures of the third have no SQL form; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole of documents; an empty table goes through all of them.

    What a stage returns is written and read again by the next one, and deleted once that one's rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
            if before is not None:
                delete(before)
            before = docs
    return docs
