"""What surrounds a question: summaries of predicates, rival readings of a query, answers as text, reviewed changes of the store."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.engine import Engine
from ..plans.syntax import Atom, Lit, Num, Query, Wild, parse_query
from ..sources.journal import ConflictError, Store, digest


def schema_summary(e: Engine, samples: int = 3) -> DataFrame:
    """(predicate, arity, fact): up to so many facts of each predicate, the smallest as JSON, and none for one without facts."""
    frames = []
    for (name, arity), r in sorted(e.derive(set(e.base) | {c.head.key for c in e.program.facts}).items()):
        if arity:
            fact = F.to_json(F.array(*(F.col(f"c{i}").cast("string") for i in range(arity))))
            own = r.df.select(F.lit(name).alias("predicate"), F.lit(arity).alias("arity"), fact.alias("fact")).distinct()
            frames.append(own.orderBy("fact").limit(samples))
    return reduce(DataFrame.union, frames) if frames else e.spark.createDataFrame([], "predicate string, arity int, fact string")


def rivals(e: Engine, query: str) -> list[tuple[str, str]]:
    """(predicate of the query, other predicate of as many arguments whose facts match the query's constants).

    A query of p_until that also names p is a rival of itself: it mixes past and present.
    """
    q = parse_query(query)
    used = {g.key for g in q.body if isinstance(g, Lit)}
    known = set(e.base) | {c.head.key for c in e.program.clauses if c.head}
    out = []
    for g in q.body:
        if not isinstance(g, Lit) or not any(isinstance(t, (Atom, Num)) for t in g.args):
            continue
        pattern = tuple(t if isinstance(t, (Atom, Num)) else Wild() for t in g.args)
        for name, arity in sorted(known - used):
            if arity == len(g.args) and e.holds(Query((Lit(name, pattern),))):
                out.append((g.name, name))
    out += [(n, n.removesuffix("_until")) for n, _ in sorted(used) if n.endswith("_until") and n.removesuffix("_until") in {u for u, _ in used}]
    return out


def answer_text(e: Engine, query: str, most: int = 100) -> str:
    """The answers as a sentence a line, in the order of their text; the same for the same facts."""
    q = parse_query(query)
    rows = e.rows(q, most)
    if not q.columns:
        return "Yes." if rows else "No."
    if not rows:
        return "No answer."
    show = lambda v: f"{v:g}" if isinstance(v, float) else str(v)
    return "\n".join(sorted(", ".join(f"{k} = {show(v)}" for k, v in r.items()) for r in rows))


def evidence_text(e: Engine, query: str) -> str:
    """answer_text() with the facts that each answer rests on."""

    def base(p: dict) -> list[str]:
        if "fact" in p and "because" not in p:
            return [p["fact"]]
        inner = [*p.get("because", ()), *(x for g in p.get("of", ()) for x in g)]
        return [f for x in inner for f in base(x)] + ([f"not {p['absent']}"] if "absent" in p else [])

    lines = []
    for row, proofs in e.explain(query):
        facts = dict.fromkeys(f for p in proofs for f in base(p))
        lines.append(f"{', '.join(f'{k} = {v}' for k, v in row.items()) or 'Yes'} because {'; '.join(facts)}")
    return "\n".join(sorted(lines)) or "No answer."


@dataclass(frozen=True)
class Proposal:
    """A change of a namespace for review. kind: assert, tentative, retract, replace or supersede."""

    namespace: str
    kind: str
    program: str = ""
    pattern: str = ""

    def reviewed(self, store: Store) -> str:
        """The digest to apply it with: of the proposal and of the state it was made for."""
        text = json.dumps([asdict(self), digest(store.state())], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()


def apply_proposal(store: Store, p: Proposal, reviewed: str, op_id: str, ts: str) -> int:
    """Carries a proposal out; ConflictError if the proposal or the state isn't what was reviewed. Repeating an op_id does nothing."""
    done = store.journal().where((F.col("op_id") == op_id) & (F.col("action") == "operation")).select("sequence").first()
    if done:
        return done["sequence"]
    if p.reviewed(store) != reviewed:
        raise ConflictError("the state has changed since the review")
    if p.kind in ("assert", "tentative"):
        return store.assert_(p.namespace, p.program, op_id, ts, trust="accepted" if p.kind == "assert" else "tentative")
    if p.kind == "retract":
        return store.retract(p.namespace, p.pattern, op_id, ts)
    if p.kind in ("replace", "supersede"):
        return store.supersede(p.namespace, p.pattern, p.program, op_id, ts, archive=p.kind == "supersede")
    raise ValueError(f"no such kind: {p.kind}")


__all__ = ["Proposal", "answer_text", "apply_proposal", "evidence_text", "rivals", "schema_summary"]
