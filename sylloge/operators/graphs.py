"""Walks over the graph of claims and entities: neighbourhoods and shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.engine import Engine
from ..plans.local import LimitError
from ..sources.scratch import written

MAX_DEPTH, MAX_CLAIMS, MAX_PATHS = 8, 1_000, 16


def incidences(e: Engine, derived: bool = False) -> DataFrame:
    """(claim, pos, entity): each fact as JSON of its predicate and values, once for each of its atoms."""
    relations = e.derive() if derived else {**e.derive(set(e.base) | {c.head.key for c in e.program.facts})}
    frames = []
    for (name, arity), r in relations.items():
        strings = [i for i, k in enumerate(r.kinds) if k == "str"]
        if arity and strings:
            claim = F.to_json(F.array(F.lit(name), *(F.col(f"c{i}").cast("string") for i in range(arity))))
            at = F.array(*(F.struct(F.lit(i + 1).alias("pos"), F.col(f"c{i}").alias("entity")) for i in strings))
            frames.append(r.distinct().df.select(claim.alias("claim"), F.inline(at)))
    if not frames:
        return e.spark.createDataFrame([], "claim string, pos int, entity string")
    return reduce(DataFrame.union, frames).where("entity IS NOT NULL")


def neighbourhood(inc: DataFrame, start: str, depth: int = 1, most: int | None = 100) -> DataFrame:
    """(claim, depth): claims within so many steps of an entity, each with its least; an error for more than most claims.

    most None: however many there are; they and their entities stay in tables.
    """
    if not 1 <= depth <= MAX_DEPTH or most is not None and not 1 <= most <= MAX_CLAIMS:
        raise ValueError(f"depth up to {MAX_DEPTH}, claims up to {MAX_CLAIMS}")
    spark = inc.sparkSession
    if most is None:
        front = seen = spark.createDataFrame([(start,)], "entity string")
        out = None
        for d in range(1, depth + 1):
            claims = inc.join(front, "entity", "left_semi").select("claim").distinct()
            new = written((claims if out is None else claims.join(out, "claim", "left_anti")).withColumn("depth", F.lit(d)), "claims")
            out = new if out is None else out.union(new)
            if d == depth or new.isEmpty():
                break
            front = written(inc.join(new, "claim", "left_semi").select("entity").distinct().join(seen, "entity", "left_anti"), "entities")
            seen = seen.union(front)
        return out
    entities = spark.createDataFrame([(start,)], "entity string")
    seen_e, out = entities, None
    for d in range(1, depth + 1):
        claims = inc.join(F.broadcast(entities), "entity", "left_semi").select("claim").distinct()
        if out is not None:
            claims = claims.join(F.broadcast(out.select("claim")), "claim", "left_anti")
        got = claims.limit(most + 1).toArrow()
        if got.num_rows + (0 if out is None else out.count()) > most:
            raise LimitError(f"more than {most} claims")
        new = spark.createDataFrame(got).withColumn("depth", F.lit(d))
        out = new if out is None else out.union(new)
        if not got.num_rows:
            break
        entities = inc.join(F.broadcast(new), "claim", "left_semi").select("entity").distinct().join(F.broadcast(seen_e), "entity", "left_anti")
        # claims are at most MAX_CLAIMS, and a claim has as many entities as its predicate has places
        entities = spark.createDataFrame(entities.toArrow())
        seen_e = seen_e.union(entities)
    return out


def shortest_paths(inc: DataFrame, start: str, goal: str, depth: int = 4, most: int = 3) -> list[list[str]]:
    """All shortest chains entity, claim, entity, ... from start to goal, in order; an error for more than most.

    A search by levels keeps, for each entity first reached, all claims that reach it. No path within depth claims: [].
    """
    if not 1 <= depth <= MAX_DEPTH or not 1 <= most <= MAX_PATHS:
        raise ValueError(f"depth up to {MAX_DEPTH}, paths up to {MAX_PATHS}")
    spark = inc.sparkSession
    if start == goal:
        return [[start]]
    seen = spark.createDataFrame([(start,)], "entity string")
    front, levels = seen, []
    for _ in range(depth):
        out = inc.alias("a").join(front.alias("f"), F.col("a.entity") == F.col("f.entity")).select(F.col("a.claim").alias("claim"), F.col("a.entity").alias("come"))
        step = out.join(inc, "claim").where("entity <> come").select("come", "claim", "entity").distinct().join(seen, "entity", "left_anti")
        step = written(step.select("come", "claim", "entity"), "paths")
        levels.append(step)
        if not step.where(F.col("entity") == goal).isEmpty():
            break
        front = step.select("entity").distinct()
        if front.isEmpty():
            return []
        seen = seen.union(front)
    else:
        return []
    chains: list[list[str]] = [[goal]]
    for step in reversed(levels):
        heads = sorted({c[0] for c in chains})
        before: dict[str, list[tuple[str, str]]] = {}
        # each way into a head starts another path, as every level leads back to the start
        for r in step.where(F.col("entity").isin(heads)).limit(most + 1).collect():
            before.setdefault(r["entity"], []).append((r["come"], r["claim"]))
        if sum(map(len, before.values())) > most:
            raise LimitError(f"more than {most} paths")
        chains = [[come, claim, *c] for c in chains for come, claim in sorted(before[c[0]])]
        if len(chains) > most:
            raise LimitError(f"more than {most} paths")
    return sorted(chains)


def distances(edges: DataFrame, start, max_rounds: int = 10_000) -> DataFrame:
    """(node, distance): least numbers of steps over edges (x, y) from a node, by levels written to the shared folder."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["x"]
    front = spark.createDataFrame([(start,)], f"node {kind}").withColumn("distance", F.lit(0))
    levels = [front]
    for d in range(1, max_rounds):
        seen = reduce(DataFrame.union, levels).select("node")
        new = edges.join(front, edges.x == front.node, "left_semi").select(F.col("y").alias("node")).distinct().join(seen, "node", "left_anti")
        front = written(new.withColumn("distance", F.lit(d)), "levels")
        if front.isEmpty():
            break
        levels.append(front)
    return reduce(DataFrame.union, levels)
