"""What changed between two numbers of a journal: clauses, the program's shape, violations and the answers of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.local import LimitError
from ..sources.journal import engine_of, recorded_diff, trust_view
from .policy import integrity_delta, result_delta
from .topology import audit_delta

MAX_QUERIES = 64


@dataclass
class Impact:
    """clauses: (namespace, clause, change); topology: audit_delta(); integrity: (change, text, bindings); queries: (query, row, change)."""

    clauses: DataFrame
    topology: dict
    integrity: DataFrame
    queries: DataFrame
    counts: dict = field(default_factory=dict)


def recorded_impact(journal: DataFrame, a: int, b: int, queries: tuple[str, ...] = (), include_tentative: bool = False) -> Impact:
    """What happened between two sequence numbers, and what it means for constraints and queries; rows of queries that stay are left out."""
    if len(queries) > MAX_QUERIES:
        raise LimitError(f"more than {MAX_QUERIES} queries")
    changes = journal.where("action <> 'operation'")
    states = [trust_view(changes, include_tentative, n) for n in (a, b)]
    before, after = map(engine_of, states)
    frames = []
    for q in queries:
        d = result_delta(before, after, q).where("change <> 'unchanged'")
        row = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in d.columns if c != "change")))
        frames.append(d.select(F.lit(q).alias("query"), row.alias("row"), "change"))
    spark = journal.sparkSession
    found = reduce(DataFrame.union, frames) if frames else spark.createDataFrame([], "query string, row string, change string")
    counts = {name: {"facts": s.where("NOT contains(clause, ':-')").count(), "rules": len(e.program.rules), "constraints": len(e.program.constraints)} for name, s, e in zip(("before", "after"), states, (before, after))}
    return Impact(recorded_diff(changes, a, b), audit_delta(before, after), integrity_delta(before, after), found, counts)
