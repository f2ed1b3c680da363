"""Constraints, enforcement, conflicts, checks, coverage and changes on trial."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Relation
from ..plans.engine import Engine
from ..plans.local import LimitError, matches
from ..plans.syntax import Clause, DatalogError, Lit, Program, Query, canonical, parse_program, parse_query, write
from ..sources.journal import Store, engine_of

MAX_CONSTRAINTS = 256
MAX_VIOLATIONS = 10_000
MAX_CHANGES = 64

VIOLATIONS = "constraint int, text string, bindings string, first string"


def constraints(e: Engine) -> list[tuple[int, Clause]]:
    """Distinct constraints with their place among all, from 1."""
    out: dict[str, tuple[int, Clause]] = {}
    for i, c in enumerate(e.program.constraints):
        out.setdefault(canonical(c), (i + 1, c))
    if len(out) > MAX_CONSTRAINTS:
        raise LimitError(f"more than {MAX_CONSTRAINTS} constraints")
    return list(out.values())


def violations(e: Engine) -> DataFrame:
    """(constraint, text, bindings, first): every solution of every constraint.

    bindings is JSON of the variables' values, first the value of the first variable as text. A constraint without variables
    that holds gives one row with {} and null.
    """
    frames = []
    for i, c in constraints(e):
        q = Query(c.body)
        df = e.query(q)
        row = F.to_json(F.struct(*(F.col(v).cast("string").alias(v) for v in q.columns))) if q.columns else F.lit("{}")
        first = F.col(q.columns[0]).cast("string") if q.columns else F.lit(None).cast("string")
        frames.append(df.select(F.lit(i).alias("constraint"), F.lit(write(c)).alias("text"), row.alias("bindings"), first.alias("first")))
    return reduce(DataFrame.union, frames) if frames else e.spark.createDataFrame([], VIOLATIONS)


def check_integrity(e: Engine, most: int = 1_000) -> list[dict]:
    """Collected violations; an error for more than most."""
    got = violations(e).limit(min(most, MAX_VIOLATIONS) + 1).collect()
    if len(got) > most:
        raise LimitError(f"more than {most} violations")
    return [r.asDict() for r in got]


def introduced(before: Engine, after: Engine) -> DataFrame:
    """Violations after a change that weren't there before; compared by constraint text, not number."""
    return violations(after).join(violations(before).select("text", "bindings"), ["text", "bindings"], "left_anti")


def integrity_delta(before: Engine, after: Engine) -> DataFrame:
    """(change, text, bindings): violations that a change brings (introduced) and takes away (resolved)."""
    a, b = violations(before).select("text", "bindings"), violations(after).select("text", "bindings")
    new, gone = b.join(a, ["text", "bindings"], "left_anti"), a.join(b, ["text", "bindings"], "left_anti")
    return new.select(F.lit("introduced").alias("change"), "*").union(gone.select(F.lit("resolved").alias("change"), "*"))


class PolicyError(DatalogError):
    """A change that constraints or checks forbid."""


def enforce(before: Engine, after: Engine, mode: str = "strict") -> None:
    """PolicyError if after has any violation (strict) or a new one (no_new_violations)."""
    if mode not in ("strict", "no_new_violations"):
        raise DatalogError(f"no such mode: {mode}")
    found = (violations(after) if mode == "strict" else introduced(before, after)).limit(1).collect()
    if found:
        raise PolicyError(f"{found[0]['text']} is violated by {found[0]['bindings']}")


def conflict_clusters(e: Engine) -> DataFrame:
    """(constraint, subject, n, violations): violations by the value of their constraint's first variable."""
    return violations(e).groupBy("constraint", F.col("first").alias("subject")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("bindings")).alias("violations"))


# -- checks -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """expect: 'empty', 'nonempty' or 'rows'; rows are dicts by variable, as a set or, if ordered, in the order of their columns' values."""

    name: str
    query: str
    expect: str = "nonempty"
    rows: tuple = ()
    ordered: bool = False


@dataclass
class CheckResult:
    name: str
    passed: bool
    missing: list[dict] = field(default_factory=list)
    unexpected: list[dict] = field(default_factory=list)


def run_check(e: Engine, c: Check) -> CheckResult:
    if c.expect in ("empty", "nonempty"):
        some = not e.query(c.query).isEmpty()
        return CheckResult(c.name, some == (c.expect == "nonempty"))
    if c.expect != "rows":
        raise DatalogError(f"no such expectation: {c.expect}")
    df = e.query(c.query)
    if not df.columns:
        return CheckResult(c.name, (not df.isEmpty()) == bool(c.rows))
    text = [F.col(x).cast("double").cast("string").alias(x) if t not in ("string", "timestamp") else F.col(x).cast("string").alias(x) for x, t in df.dtypes]
    show = lambda v: str(float(v)) if isinstance(v, (int, float)) else str(v)
    want = e.spark.createDataFrame([tuple(show(r[x]) for x in df.columns) for r in c.rows], ", ".join(f"`{x}` string" for x in df.columns))
    got = df.select(*text)
    if c.ordered:
        # one row more than is expected tells that there are too many
        both = [[tuple(r) for r in x] for x in (got.orderBy(*df.columns).limit(len(c.rows) + 1).collect(), want.collect())]
        if both[0] == both[1]:
            return CheckResult(c.name, True)
    missing, extra = want.exceptAll(got).collect(), got.exceptAll(want).limit(MAX_VIOLATIONS + 1).collect()
    if len(extra) > MAX_VIOLATIONS:
        raise LimitError(f"{c.name}: more than {MAX_VIOLATIONS} rows that are not expected")
    ok = not missing and not extra and not c.ordered
    return CheckResult(c.name, ok, [r.asDict() for r in missing], [r.asDict() for r in extra])


def run_checks(e: Engine, suite: list[Check]) -> list[CheckResult]:
    return [run_check(e, c) for c in suite]


def rules_used(proof: dict) -> set[int]:
    out = {proof["rule"]} if "rule" in proof else set()
    for x in proof.get("because", ()):
        out |= rules_used(x)
    for group in proof.get("of", ()):
        for x in group:
            out |= rules_used(x)
    return out


def rule_coverage(e: Engine, suite: list[Check]) -> dict:
    """Which rules the proofs of the checks' answers use: {percent, used, unused}; 100 without rules.

    Facts that the driver can't hold stay in tables.
    """
    used: set[int] = set()
    for c in suite:
        q = parse_query(c.query)
        if q.aggregate:
            q = Query(q.body)
        try:
            for _, proofs in e.explain(q):
                for p in proofs:
                    used |= rules_used(p)
        except LimitError:
            used |= e.rules_used(q)
    n = len(e.program.rules)
    return {"percent": round(100 * len(used) / n, 2) if n else 100.0, "used": sorted(used), "unused": [i for i in range(1, n + 1) if i not in used]}


def check_delta(before: Engine, after: Engine, suite: list[Check]) -> dict:
    """{regressed, fixed, coverage_before, coverage_after}: names of checks that a change breaks and mends."""
    a, b = ({r.name: r.passed for r in run_checks(x, suite)} for x in (before, after))
    return {
        "regressed": [n for n in a if a[n] and not b[n]],
        "fixed": [n for n in a if b[n] and not a[n]],
        "coverage_before": rule_coverage(before, suite)["percent"],
        "coverage_after": rule_coverage(after, suite)["percent"],
    }


def enforce_checks(before: Engine, after: Engine, suite: list[Check], mode: str = "strict", minimum_percent: float = 0.0) -> None:
    """PolicyError if after fails a check (strict) or one that before passed (no_regressions), or if coverage falls too low."""
    if mode not in ("strict", "no_regressions"):
        raise DatalogError(f"no such mode: {mode}")
    good = {r.name for r in run_checks(before, suite) if r.passed} if mode == "no_regressions" else {c.name for c in suite}
    if failed := [r.name for r in run_checks(after, suite) if not r.passed and r.name in good]:
        raise PolicyError(f"checks failed: {', '.join(failed)}")
    if minimum_percent > 0:
        now = rule_coverage(after, suite)["percent"]
        floor = minimum_percent if mode == "strict" else min(minimum_percent, rule_coverage(before, suite)["percent"])
        if now < floor:
            raise PolicyError(f"coverage of {now} % is below {floor} %")


# -- changes on trial ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Change:
    """Facts to assume and to leave out (patterns), rules to add and to leave out (texts)."""

    assume: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    without_rules: tuple[str, ...] = ()

    def __post_init__(self):
        for part in (self.assume, self.without, self.rules, self.without_rules):
            if len(part) > MAX_CHANGES:
                raise LimitError(f"more than {MAX_CHANGES} changes of a kind")

    def digest(self, program: Program) -> str:
        """SHA-256 of the change and of the program that it is for."""
        own = {k: sorted(canonical(c) for x in getattr(self, k) for c in _clauses(x)) for k in ("assume", "without", "rules", "without_rules")}
        own["program"] = program_digest(program)
        return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def program_digest(program: Program) -> str:
    return hashlib.sha256("\n".join(sorted({canonical(c) for c in program.clauses})).encode()).hexdigest()


def _clauses(text: str) -> list[Clause]:
    """The clauses of a text, or the one pattern that it is."""
    text = text.strip()
    try:
        return parse_program(text if text.endswith(".") else text + ".")
    except DatalogError:
        return [Clause(_pattern(text))]


def _pattern(text: str) -> Lit:
    q = parse_query(text.strip().rstrip("."))
    if len(q.body) != 1 or not isinstance(q.body[0], Lit):
        raise DatalogError(f"{text} is no pattern of a fact")
    return q.body[0]


def without(e: Engine, patterns: list[str]) -> Engine:
    """e without the facts that have the form of a pattern; derived facts go with them."""
    out = e.copy()
    for text in patterns:
        lit = _pattern(text)
        clauses = [c for c in out.program.clauses if not (c.is_fact and c.head.key == lit.key and matches(lit, tuple(t.value for t in c.head.args)) is not None)]
        out.program = Program(clauses)
        if lit.key in out.base:
            r = out.base[lit.key]
            hit = pattern_condition(lit, r)
            out.base[lit.key] = Relation(r.df.where(~F.coalesce(hit, F.lit(False))), r.arity, r.unique)
    return out


def pattern_condition(lit: Lit, r: Relation):
    """Whether a row of r has the form of lit."""
    from ..plans.compiler import _constant, all_of
    from ..plans.syntax import Var, Wild

    seen, conds = {}, []
    for i, (t, kind) in enumerate(zip(lit.args, r.kinds)):
        c = F.col(f"c{i}")
        if isinstance(t, Wild):
            continue
        if isinstance(t, Var):
            if t.name in seen:
                conds.append(c == seen[t.name])
            seen.setdefault(t.name, c)
            continue
        value = _constant(t, kind)
        conds.append(F.lit(False) if value is None else c == value)
    return all_of(conds)


def what_if(e: Engine, change: Change) -> Engine:
    """The engine as it would be after a change. Facts to leave out go first, then those assumed come."""
    out = without(e, list(change.without))
    gone = {canonical(c) for text in change.without_rules for c in parse_program(text)}
    if missing := gone - {canonical(c) for c in out.program.clauses}:
        raise DatalogError(f"no such rule: {sorted(missing)[0]}")
    out.program = Program([c for c in out.program.clauses if canonical(c) not in gone])
    for text in change.assume:
        clauses = parse_program(text if text.strip().endswith(".") else text + ".")
        if any(not c.is_fact for c in clauses):
            raise DatalogError("only facts can be assumed")
        out.load(clauses)
    for text in change.rules:
        clauses = parse_program(text)
        if any(c.is_fact for c in clauses):
            raise DatalogError("a rule was expected")
        out.load(clauses)
    return out


def result_delta(before: Engine, after: Engine, query: str) -> DataFrame:
    """The rows of both answers with a last column change: added, removed or unchanged."""
    a, b = before.query(query), after.query(query)
    keys = a.columns
    if not keys:
        a, b = (x.select(F.lit(True).alias("holds")) for x in (a, b))
        keys = ["holds"]
    old, new = a.withColumn("old", F.lit(True)), b.withColumn("new", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("unchanged")
    return joined.select(*keys, change.alias("change"))


def evidence_delta(before: Engine, after: Engine, query: str) -> list[dict]:
    """result_delta() of proofs: rows whose first proof is another are 'evidence_changed'. Over bounded facts, on the driver."""
    q = parse_query(query)
    a, b = ({json.dumps(row, sort_keys=True): p for row, p in x.explain(q)} for x in (before, after))
    strip = lambda p: json.dumps([_unnumbered(x) for x in p], sort_keys=True)
    out = []
    for k in {**a, **b}:
        change = "added" if k not in a else "removed" if k not in b else "unchanged" if strip(a[k]) == strip(b[k]) else "evidence_changed"
        out.append(json.loads(k) | {"change": change})
    return out


def _unnumbered(proof: dict) -> dict:
    return {k: [_unnumbered(x) for x in v] if k == "because" else [[_unnumbered(x) for x in g] for g in v] if k == "of" else v for k, v in proof.items() if k != "rule"}


def apply_rule_change(store: Store, namespace: str, change: Change, digest: str, op_id: str, ts: str, mode: str | None = "strict", suite: tuple[Check, ...] = (), source: str | None = None) -> int:
    """Writes a reviewed change of rules to the store; the number of the operation.

    An error if the program in force is no longer the one that digest was made for, or if the constraints (mode, as
    for enforce(); None: not asked) or the checks of suite forbid what would be in force then. Repeating op_id gives its number again.
    """
    if change.assume or change.without:
        raise DatalogError("only rules are changed so")
    done = store.journal().where((F.col("op_id") == op_id) & (F.col("action") == "operation")).select("sequence").first()
    if done:
        return done["sequence"]
    before = engine_of(store.state())
    after = apply_change(before, change, digest)
    if mode is not None:
        enforce(before, after, mode)
    if suite:
        enforce_checks(before, after, list(suite), "no_regressions" if mode == "no_new_violations" else "strict")
    return store.exchange(namespace, list(change.without_rules), " ".join(change.rules), op_id, ts, source)


def apply_change(e: Engine, change: Change, digest: str) -> Engine:
    """what_if() for a reviewed change: an error if the program is no longer the one that digest was made for."""
    if change.digest(e.program) != digest:
        raise DatalogError("the change was reviewed for another program")
    return what_if(e, change)
