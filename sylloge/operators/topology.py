"""The shape of a program: what rests on what, what is open, and what looks wrong."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.engine import Engine
from ..plans.stratify import Key, components, edges, recursive, strata
from ..plans.syntax import DatalogError, Lit, Not, canonical, goal_vars
from .policy import Check, check_integrity, constraints, rule_coverage, run_checks

name = lambda k: f"{k[0]}/{k[1]}"


@dataclass
class Topology:
    """predicates: by key, {facts, derived, stratum, recursive, open}; edges: (from, to, how), from what rests on what."""

    predicates: dict[Key, dict] = field(default_factory=dict)
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    groups: list[list[Key]] = field(default_factory=list)


def fact_counts(e: Engine, exact: bool = True) -> dict[Key, int]:
    """Different rows of each relation and program facts; unless exact, 1 where a relation has any, which reads a row of it only."""
    out: dict[Key, int] = {}
    given: dict[Key, set[str]] = {}
    for c in e.program.facts:
        given.setdefault(c.head.key, set()).add(canonical(c))
    for k, r in e.base.items():
        out[k] = r.distinct().df.count() if exact else int(not r.df.isEmpty())
    for k, texts in given.items():
        out[k] = out.get(k, 0) + len(texts)
    return out


def topology(e: Engine, exact: bool = True) -> Topology:
    """exact: with the numbers of facts, which reads all relations; otherwise facts only says whether there are any."""
    rules = e.program.rules
    level, counts = strata(rules), fact_counts(e, exact)
    needs: dict[Key, set[Key]] = {}
    for head, need, _ in edges(rules):
        needs.setdefault(head, set()).add(need)
    heads = {r.head.key for r in rules}
    read = {k for _, k, _ in edges(rules)} | {k for _, c in constraints(e) for k in _reads(c.body)}
    out = Topology()
    nodes = sorted(heads | read | set(counts))
    found = components(nodes, needs)
    out.groups = [g for g in found if recursive(g, rules)]
    loops = {k for g in out.groups for k in g}
    for k in nodes:
        out.predicates[k] = {
            "facts": counts.get(k, 0), "derived": k in heads, "stratum": level.get(k, 0), "recursive": k in loops,
            "open": k in read and k not in heads and not counts.get(k, 0),
        }
    for i, r in enumerate(rules):
        out.edges.append((f"rule {i + 1}", name(r.head.key), "derives"))
        out.edges += [(name(k), f"rule {i + 1}", how) for k, how in _uses(r.body)]
    for i, c in constraints(e):
        out.edges += [(name(k), f"constraint {i}", how) for k, how in _uses(c.body)]
    return out


def _uses(body: tuple) -> list[tuple[Key, str]]:
    return list(dict.fromkeys((g.key, "reads") if isinstance(g, Lit) else (g.lit.key, "negates") for g in body if isinstance(g, (Lit, Not))))


def _reads(body: tuple) -> list[Key]:
    return [k for k, _ in _uses(body)]


def focus(t: Topology, start: str, direction: str = "both", depth: int | None = None) -> set[str]:
    """Nodes upstream of one (what it rests on), downstream (what rests on it) or both."""
    if direction not in ("upstream", "downstream", "both"):
        raise DatalogError(f"no such direction: {direction}")
    nodes = {x for a, b, _ in t.edges for x in (a, b)} | {name(k) for k in t.predicates}
    if start not in nodes:
        raise DatalogError(f"no such node: {start}")
    out = {start}
    for way in ("upstream", "downstream"):
        if direction in (way, "both"):
            seen, now, left = {start}, {start}, depth
            while now and left != 0:
                now = {a if way == "upstream" else b for a, b, _ in t.edges if (b if way == "upstream" else a) in now} - seen
                seen |= now
                left = None if left is None else left - 1
            out |= seen
    return out


def audit_rules(e: Engine) -> list[dict]:
    """Findings by code, in order: what is negated but never given, constraints that can't fire, recursion without a start and so on."""
    t, rules, out = topology(e, exact=False), e.program.rules, []
    add = lambda code, subject, detail: out.append({"code": code, "subject": subject, "detail": detail})
    is_open = {k for k, v in t.predicates.items() if v["open"]}
    for i, r in enumerate(rules):
        for k, how in _uses(r.body):
            if k in is_open:
                add("open_negated_input" if how == "negates" else "open_positive_input", f"rule {i + 1}", name(k))
    for i, c in constraints(e):
        for k, _ in _uses(c.body):
            if k in is_open:
                add("policy_open_input", f"constraint {i}", name(k))
    for g in t.groups:
        started = any(t.predicates[k]["facts"] for k in g) or any(r.head.key in g and not any(isinstance(x, Lit) and x.key in g for x in r.body) for r in rules)
        if not started:
            add("unseeded_recursion", ", ".join(map(name, g)), "no fact and no rule starts it")
    active = {k for k, v in t.predicates.items() if v["facts"]}
    while True:  # what can have rows
        new = {r.head.key for r in rules if all(k in active for k in (g.key for g in r.body if isinstance(g, Lit))) or r.aggregate and r.aggregate.op == "count" and not _groups(r)} - active
        if not new:
            break
        active |= new
    for k in sorted({r.head.key for r in rules} - active):
        add("inactive_derived_predicate", name(k), "no row can be derived")
    seen: dict[str, int] = {}
    for i, r in enumerate(rules):
        first = seen.setdefault(canonical(r), i + 1)
        if first != i + 1:
            add("duplicate_semantic_rule", f"rule {i + 1}", f"is rule {first} with other names")
    arities: dict[str, list[int]] = {}
    for k in t.predicates:
        arities.setdefault(k[0], []).append(k[1])
    for n, a in arities.items():
        if len(a) > 1:
            add("predicate_arity_overload", n, ", ".join(map(str, sorted(a))))
    return sorted(out, key=lambda x: (x["code"], x["subject"], x["detail"]))


def _groups(r) -> bool:
    return any(v != r.aggregate.out for v in goal_vars(r.head))


def audit_delta(before: Engine, after: Engine) -> dict:
    """Findings introduced and resolved; predicates and edges of the topology added, removed and changed."""
    key = lambda f: (f["code"], f["subject"], f["detail"])
    a, b = ({key(f): f for f in audit_rules(x)} for x in (before, after))
    s, t = topology(before), topology(after)
    return {
        "introduced": [b[k] for k in b if k not in a], "resolved": [a[k] for k in a if k not in b],
        "nodes_added": sorted(name(k) for k in t.predicates if k not in s.predicates),
        "nodes_removed": sorted(name(k) for k in s.predicates if k not in t.predicates),
        "nodes_changed": sorted(name(k) for k in t.predicates if k in s.predicates and t.predicates[k] != s.predicates[k]),
        "edges_added": sorted(set(t.edges) - set(s.edges)), "edges_removed": sorted(set(s.edges) - set(t.edges)),
    }


def health(e: Engine, suite: list[Check] | None = None, minimum_percent: float = 0.0, tentative: int = 0, unsourced: int = 0) -> dict:
    """{status, findings}: violations, else review where something is to be looked at, else healthy."""
    findings = []
    add = lambda code, severity, n: n and findings.append({"code": code, "severity": severity, "count": n})
    add("integrity_violations", "error", len(check_integrity(e)))
    add("rule_warnings", "warning", len(audit_rules(e)))
    if suite is not None:
        add("knowledge_checks_failed", "warning", sum(not r.passed for r in run_checks(e, suite)))
        if minimum_percent and rule_coverage(e, suite)["percent"] < minimum_percent:
            add("coverage_failed", "warning", 1)
    add("tentative_claims_pending", "warning", tentative)
    add("missing_provenance", "warning", unsourced)
    status = "violations" if any(f["severity"] == "error" for f in findings) else "review" if findings else "healthy"
    return {"status": status, "findings": findings}


def topology_edges(e: Engine) -> DataFrame:
    """topology()'s edges as (source, target, how)."""
    return e.spark.createDataFrame(topology(e, exact=False).edges, "source string, target string, how string").orderBy(F.col("source"), F.col("target"))
