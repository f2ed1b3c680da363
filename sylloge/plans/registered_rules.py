"""Queries of policies, program shapes and proofs, over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy, reasoning, topology
from .engine import Engine
from .registry import add, warehouse
from .syntax import parse_program


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- policy -------------------------------------------------------------------------------------------

_POLICY = ":- customer(C,_,_,B,_), B < -900. :- supplier(S,_,N,_), customer(C,_,N,A,_), A > 9950."
_VIOLATIONS = """v AS (SELECT 1 AS "constraint", to_json({'C': c_custkey::VARCHAR, 'B': c_acctbal::VARCHAR}) AS bindings, c_custkey::VARCHAR AS "first" FROM customer WHERE c_acctbal < -900
    UNION ALL SELECT DISTINCT 2, to_json({'S': s_suppkey::VARCHAR, 'N': s_nationkey::VARCHAR, 'C': c_custkey::VARCHAR, 'A': c_acctbal::VARCHAR}), s_suppkey::VARCHAR
    FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9950)"""


@add("integrity_violations", f"WITH {_VIOLATIONS} SELECT * FROM v")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.violations(warehouse(spark, sf_dir, ("customer", "supplier")).load(_POLICY)).drop("text")


@add("conflict_clusters", f"""WITH {_VIOLATIONS} SELECT "constraint", "first" AS subject, count(*)::BIGINT AS n, list_sort(list(bindings))::VARCHAR AS violations FROM v GROUP BY ALL""")
def conflict_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = policy.conflict_clusters(warehouse(spark, sf_dir, ("customer", "supplier")).load(_POLICY))
    return df.withColumn("violations", F.concat(F.lit("["), F.array_join("violations", ", "), F.lit("]")))


@add("enforcement_new_violations", """SELECT 'introduced' AS what, to_json({'C': c_custkey::VARCHAR, 'B': c_acctbal::VARCHAR})::VARCHAR AS bindings FROM customer WHERE c_acctbal >= -950 AND c_acctbal < -900
    UNION ALL SELECT 'strict', 'refused' WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal < -900) UNION ALL SELECT 'no_new_violations', 'refused' WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal >= -950 AND c_acctbal < -900)""")
def enforcement_new_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint over the poor becomes stricter: which violations that brings, and whether the two modes let it pass."""
    e = warehouse(spark, sf_dir, ("customer",)).load(":- poor(C,B).")
    a, b = (e.copy().load(f"poor(C,B) :- customer(C,_,_,B,_), B < -{n}.") for n in (950, 900))
    modes = []
    for mode in ("strict", "no_new_violations"):
        try:
            policy.enforce(a, b, mode)
        except policy.PolicyError:
            modes.append((mode, "refused"))
    new = policy.introduced(a, b).select(F.lit("introduced").alias("what"), "bindings")
    return new.union(spark.createDataFrame(modes, "what string, bindings string"))


@add("what_if_delta", """WITH a AS (SELECT DISTINCT s_nationkey AS n FROM supplier), b AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_suppkey <> 3 UNION SELECT 99)
    SELECT coalesce(a.n, b.n)::BIGINT AS "N", CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.n = b.n""")
def what_if_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("supplier",)).load("served(N) :- supplier(_,_,N,_).")
    after = policy.what_if(e, policy.Change(assume=("supplier(1000000, extra, 99, 0)",), without=("supplier(3,_,_,_)",)))
    return policy.result_delta(e, after, "served(N)")


@add("integrity_delta", """SELECT 'resolved' AS change, to_json({'C': c_custkey::VARCHAR, 'B': c_acctbal::VARCHAR}) AS bindings FROM customer WHERE c_acctbal < -900 AND c_nationkey = 7
    UNION ALL SELECT 'introduced', '{"C":"-1","B":"-5000.0"}'""")
def integrity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("customer",)).load(":- customer(C,_,_,B,_), B < -900.")
    after = policy.what_if(e, policy.Change(assume=("customer(-1, new, 3, -5000, x)",), without=("customer(_,_,7,_,_)",)))
    return policy.integrity_delta(e, after).select("change", "bindings")


def _suite() -> list[policy.Check]:
    return [
        policy.Check("n_regions", "count(*) as N where region(_,_)", "rows", ({"N": 5},)),
        policy.Check("no_orphans", "nation(N,_,R), \\+ region(R,_)", "empty"),
        policy.Check("region_rows", "select K where region(K,_)", "rows", ({"K": 0}, {"K": 99})),
        policy.Check("urgent", "orders(_,_,_,_,_,'1-URGENT')", "nonempty"),
        policy.Check("rich", "rich(C)", "nonempty"),
    ]


_RICH = "rich(C) :- customer(C,_,_,B,_), B > 9000. poor(C) :- customer(C,_,_,B,_), B < -990."


@add("check_suite_delta", """WITH r AS (SELECT count(*) AS n, list(r_regionkey) AS ks FROM region), c(name, passed) AS (SELECT 'n_regions', (SELECT n = 5 FROM r) UNION ALL
        SELECT 'no_orphans', NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) UNION ALL
        SELECT 'region_rows', (SELECT list_sort(ks) = [0, 99] FROM r) UNION ALL SELECT 'urgent', EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL
        SELECT 'rich', EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000))
    SELECT name, passed, CASE WHEN name = 'region_rows' THEN (SELECT len(list_filter(ks, lambda k: k NOT IN (0, 99))) FROM r) ELSE 0 END::INT AS unexpected,
        passed AND name = 'rich' AS regressed FROM c""")
def check_suite_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks with the number of unexpected rows, and which of them fail without the rich."""
    e = warehouse(spark, sf_dir, ("nation", "region", "orders", "customer")).load(_RICH)
    found = policy.run_checks(e, _suite())
    after = {r.name: r.passed for r in policy.run_checks(policy.what_if(e, policy.Change(without_rules=("rich(C) :- customer(C,_,_,B,_), B > 9000.",))), _suite())}
    rows = [(r.name, r.passed, len(r.unexpected) if r.name != "n_regions" or not r.passed else 0, r.passed and not after[r.name]) for r in found]
    return spark.createDataFrame(rows, "name string, passed boolean, unexpected int, regressed boolean")


@add("topology_edges", """WITH c AS (SELECT table_name AS t, count(*) AS n FROM information_schema.columns GROUP BY 1), name AS (SELECT t, t || '/' || n AS p FROM c)
    SELECT (SELECT p FROM name WHERE t = 'customer') AS source, 'rule 1' AS target, 'reads' AS how UNION ALL SELECT 'rule 1', 'lives/2', 'derives' UNION ALL SELECT 'lives/2', 'rule 2', 'reads'
    UNION ALL SELECT (SELECT p FROM name WHERE t = 'supplier'), 'rule 2', 'negates' UNION ALL SELECT 'rule 2', 'odd/1', 'derives' UNION ALL SELECT 'odd/1', 'constraint 1', 'reads'""")
def topology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("customer", "supplier")).load("lives(C,N) :- customer(C,_,N,_,_). odd(C) :- lives(C,N), \\+ supplier(_,_,N,_). :- odd(C).")
    return topology.topology_edges(e)


@add("topology_fact_counts", """SELECT 'nation/3' AS predicate, (SELECT count(*) FROM nation)::BIGINT AS facts, false AS derived UNION ALL SELECT 'region/2', (SELECT count(*) FROM region), false UNION ALL SELECT 'big/1', 0, true""")
def topology_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topology.topology(warehouse(spark, sf_dir, ("nation", "region")).load("big(R) :- nation(_,_,R), region(R,_)."))
    return spark.createDataFrame([(topology.name(k), v["facts"], v["derived"]) for k, v in t.predicates.items()], "predicate string, facts long, derived boolean")


@add("rule_audit", """WITH open AS (SELECT t FROM (VALUES ('fragile', 'rule 1'), ('nowhere', 'rule 2')) AS v(t, r) WHERE t NOT IN (SELECT table_name FROM information_schema.tables))
    SELECT code, subject FROM (VALUES ('open_negated_input', 'rule 1'), ('open_positive_input', 'rule 2'), ('policy_open_input', 'constraint 1')) AS v(code, subject) WHERE (SELECT count(*) FROM open) = 2
    UNION ALL SELECT 'unseeded_recursion', 'loop/1' UNION ALL SELECT 'inactive_derived_predicate', unnest(['ghost/1', 'loop/1']) UNION ALL SELECT 'duplicate_semantic_rule', 'rule 5'
    UNION ALL SELECT 'predicate_arity_overload', 'nation' WHERE (SELECT count(*) FROM information_schema.columns WHERE table_name = 'nation') <> 1
    UNION ALL SELECT 'inactive_derived_predicate', 'rare/1' WHERE NOT EXISTS (SELECT 1 FROM supplier)""")
def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("nation", "supplier")).load(
        "rare(X) :- supplier(X,_,_,_), \\+ fragile(X). ghost(X) :- nowhere(X), nation(X,_,_). loop(X) :- loop(X), nation(X,_,_). nation(X) :- nation(X,_,_). nation(Y) :- nation(Y,_,_). :- nowhere(X).")
    return spark.createDataFrame([(f["code"], f["subject"]) for f in topology.audit_rules(e)], "code string, subject string")


@add("topology_focus", """SELECT unnest(['big/1', 'rule 1', 'nation/' || (SELECT count(*) FROM information_schema.columns WHERE table_name = 'nation'), 'region/' || (SELECT count(*) FROM information_schema.columns WHERE table_name = 'region')]) AS node""")
def topology_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule's predicate rests on."""
    t = topology.topology(warehouse(spark, sf_dir, ("nation", "region", "customer")).load("big(R) :- nation(_,_,R), region(R,_). of(C) :- customer(C,_,_,_,_), big(C)."), exact=False)
    return spark.createDataFrame([(n,) for n in topology.focus(t, "big/1", "upstream")], "node string")


@add("audit_delta", """SELECT 'resolved' AS what, 'open_positive_input' AS which WHERE EXISTS (SELECT 1 FROM nation) UNION ALL SELECT 'resolved', 'inactive_derived_predicate' WHERE EXISTS (SELECT 1 FROM nation)
    UNION ALL SELECT 'node changed', 'nowhere/1' UNION ALL SELECT 'edge added', 'new/1'""")
def audit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit finds no more once a missing fact is there, and what a new rule adds to the topology."""
    e = warehouse(spark, sf_dir, ("nation",)).load("ghost(X) :- nowhere(X), nation(X,_,_).")
    d = topology.audit_delta(e, policy.what_if(e, policy.Change(assume=("nowhere(3)",), rules=("new(X) :- nation(X,_,_).",))))
    rows = [("resolved", f["code"]) for f in d["resolved"]] + [("introduced", f["code"]) for f in d["introduced"]] + [("node changed", n) for n in d["nodes_changed"]]
    return spark.createDataFrame(rows + [("edge added", b) for _, b, how in d["edges_added"] if how == "derives"], "what string, which string")


@add("health_report", """SELECT 'integrity_violations' AS code, 'error' AS severity, count(*)::BIGINT AS n FROM customer WHERE c_acctbal < -990 HAVING count(*) > 0 UNION ALL SELECT 'rule_warnings', 'warning', 2
    UNION ALL SELECT 'knowledge_checks_failed', 'warning', 1 WHERE (SELECT list_sort(list(r_regionkey)) <> [0, 99] FROM region)
    UNION ALL SELECT 'tentative_claims_pending', 'warning', count(*) FROM (SELECT 1 FROM events WHERE event_type = 'view') HAVING count(*) > 0""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("nation", "region", "orders", "customer")).load(_RICH + " ghost(X) :- nowhere(X). :- customer(C,_,_,B,_), B < -990.")
    h = topology.health(e, _suite(), tentative=table(spark, sf_dir, "events").where("event_type = 'view'").count())
    return spark.createDataFrame([(f["code"], f["severity"], f["count"]) for f in h["findings"]], "code string, severity string, n long")


@add("rule_coverage", "SELECT 50.0::DOUBLE AS percent, unnest([1]) AS used, 2 AS unused WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000)")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("nation", "region", "orders", "customer")).load(_RICH)
    c = policy.rule_coverage(e, [x for x in _suite() if x.name in ("rich", "no_orphans")])
    return spark.createDataFrame([(c["percent"], u, n) for u in c["used"] for n in c["unused"]], "percent double, used int, unused int")


@add("check_enforcement", """WITH r AS (SELECT list_sort(list(r_regionkey)) = [0, 99] AS good FROM region) SELECT 'strict' AS mode, 'checks failed: region_rows' AS refused FROM r WHERE NOT good
    UNION ALL SELECT 'no_regressions', 'checks failed: rich' WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000)""")
def check_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two modes say: the suite as it is, and the loss of a rule."""
    e = warehouse(spark, sf_dir, ("nation", "region", "orders", "customer")).load(_RICH)
    after = policy.what_if(e, policy.Change(without_rules=("rich(C) :- customer(C,_,_,B,_), B > 9000.",)))
    out = []
    for mode, b in (("strict", e), ("no_regressions", after)):
        try:
            policy.enforce_checks(e, b, _suite(), mode)
        except policy.PolicyError as error:
            out.append((mode, str(error)))
    return spark.createDataFrame(out, "mode string, refused string")


@add("change_digest", """WITH p AS (SELECT sha256('big(V0) :- region(V0, _).') AS d, '{"assume":["region(' || max(r_regionkey) || ', x)."],"program":"' AS head FROM region)
    SELECT sha256(head || d || '","rules":["new(V0) :- big(V0)."],"without":[],"without_rules":[]}') AS digest FROM p""")
def change_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("region",)).load("big(R) :- region(R, _).")
    last = e.query("max(K) as M where region(K, _)").first()["M"]
    c = policy.Change(assume=(f"region({last}, x)",), rules=("new(X) :- big(X).",))
    return spark.createDataFrame([(c.digest(e.program),)], "digest string")


# -- proofs, reasons, repairs ---------------------------------------------------------------------------


_NEAR = "near(X,Y) :- nation(X,_,R), nation(Y,_,R). region_of(N, K) :- nation(_,N,K)."


@add("why_not", """WITH n AS (SELECT max(n_nationkey) AS last, min(n_nationkey) AS first FROM nation), r AS (SELECT (SELECT n_regionkey FROM nation WHERE n_nationkey = first) AS r FROM n)
    SELECT 'rules_blocked' AS reason, 'near(' || first || ', ' || last || ')' AS goal FROM n, nation WHERE n_nationkey = last AND n_regionkey <> (SELECT r FROM r)
    UNION ALL SELECT 'missing_fact', 'nation(' || last || ', _, ' || (SELECT r FROM r) || ')' FROM n, nation WHERE n_nationkey = last AND n_regionkey <> (SELECT r FROM r)""")
def why_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the first and the last nation aren't near each other."""
    e = warehouse(spark, sf_dir, ("nation",)).load(_NEAR)
    a, b = (e.query(f"{op}(K) as M where nation(K,_,_)").first()["M"] for op in ("min", "max"))
    found = reasoning.why_not(e, f"near({a}, {b})")
    rows = [(f.reason, f.goal) for f in [*found, *reasoning.leaves(found)]]
    return spark.createDataFrame(rows, "reason string, goal string").distinct()


@add("why_not_summary", """WITH n AS (SELECT max(n_nationkey) + 1 AS no FROM nation) SELECT line FROM (SELECT unnest(['missing_fact: nation(' || no || ', _, R)', 'comparison_false: 1 > 2']) AS line FROM n)""")
def why_not_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost reasons of two questions without answers."""
    e = warehouse(spark, sf_dir, ("nation",)).load("in(X, R) :- nation(X, _, R).")
    no = e.query("max(K) as M where nation(K,_,_)").first()["M"] + 1
    lines = [*reasoning.summary(reasoning.why_not(e, f"in({no}, R)")), *reasoning.summary(reasoning.why_not(e, "nation(1,_,_), 1 > 2"))]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@add("repair_plan", """WITH r AS (SELECT max(r_regionkey) AS last FROM region) SELECT 'region(' || last + 1 || ', nowhere)' AS assume, '' AS retract, 1 AS cost FROM r
    UNION ALL SELECT '', 'region(' || last || ', ''' || (SELECT r_name FROM region WHERE r_regionkey = last) || ''')', 1 FROM r""")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a region beyond the last could be found, or the last one be the end: one fact more, or one less."""
    e = warehouse(spark, sf_dir, ("region",))
    last = e.query("max(K) as M where region(K, _)").first()["M"]
    e.load(f"found(X) :- region({last + 1}, nowhere), region(0, X). found(X) :- region(0, X), \\+ region({last}, _).")
    plans = reasoning.plan_repairs(e, "found(X)")
    return spark.createDataFrame([(", ".join(p.assume), ", ".join(p.retract), p.cost) for p in plans], "assume string, retract string, cost int")


_LIES = """l AS (SELECT DISTINCT n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), a AS (SELECT n_name AS n, r_name AS r, l.n_regionkey AS k, n_nationkey AS i FROM l JOIN nation USING (n_name)),
    t AS (SELECT *, 'lies(''' || n || ''', ''' || r || ''')' AS lies, 'nation(' || i || ', ''' || n || ''', ' || k || ')' AS nation, 'region(' || k || ', ''' || r || ''')' AS region FROM a)"""


@add("explanation_graph", f"""WITH {_LIES}, e(source, target, how) AS (
    SELECT 'result:{{"N": "' || n || '", "R": "' || r || '"}}', 'claim:' || lies, 'supported by' FROM t UNION SELECT 'claim:' || lies, 'proof:' || lies || ' by rule 1', 'proved by' FROM t
    UNION SELECT 'proof:' || lies || ' by rule 1', 'claim:' || nation, 'rests on' FROM t UNION SELECT 'proof:' || lies || ' by rule 1', 'claim:' || region, 'rests on' FROM t
    UNION SELECT 'claim:' || lies, 'entity:' || n, 'argument 1' FROM t UNION SELECT 'claim:' || lies, 'entity:' || r, 'argument 2' FROM t UNION SELECT 'claim:' || nation, 'entity:' || n, 'argument 2' FROM t
    UNION SELECT 'claim:' || region, 'entity:' || r, 'argument 2' FROM t) SELECT *, NULL AS kind FROM e UNION ALL SELECT DISTINCT x, NULL, NULL, split_part(x, ':', 1) FROM (SELECT source AS x FROM e UNION SELECT target FROM e)""")
def explanation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, and nodes with their kind."""
    e = warehouse(spark, sf_dir, ("nation", "region")).load("lies(N,R) :- nation(_,N,K), region(K,R).")
    nodes, edges = reasoning.explanation_graph(e, "lies(N,R)").frames(spark)
    nothing = F.lit(None).cast("string")
    return edges.select("*", nothing.alias("kind")).union(nodes.select("id", nothing, nothing, "kind"))


@add("graph_selectors", f"""WITH {_LIES}, one AS (SELECT * FROM t ORDER BY n LIMIT 1) SELECT 'result' AS how, 2::BIGINT AS nodes UNION ALL SELECT 'support', 7 UNION ALL
    SELECT 'neighbors', 2 + (SELECT 3 FROM one)""")
def graph_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes the selections around the first result have: it, its claim, proof, two facts below and two entities."""
    e = warehouse(spark, sf_dir, ("nation", "region")).load("lies(N,R) :- nation(_,N,K), region(K,R).")
    g = reasoning.explanation_graph(e, "lies(N,R)")
    start = min(i for i in g.nodes if i.startswith("result"))
    sizes = [(how, len(reasoning.subgraph(g, start, how, depth).nodes)) for how, depth in (("result", 1), ("support", 1), ("neighbors", 2))]
    return spark.createDataFrame(sizes, "how string, nodes long")


@add("first_proofs", f"""WITH {_LIES} SELECT n AS "N", r AS "R", lies AS fact, 1 AS rule, nation || '; ' || region AS because FROM t""")
def first_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("nation", "region")).load("lies(N,R) :- nation(_,N,K), region(K,R).")
    rows = [(x["N"], x["R"], p["fact"], p["rule"], "; ".join(b["fact"] for b in p["because"])) for x, (p,) in e.explain("lies(N,R)")]
    return spark.createDataFrame(rows, "N string, R string, fact string, rule int, because string")


@add("absence_proofs", """SELECT r_name AS "R", 'nation' AS absent, '[null, null, ' || (r_regionkey + 100) || '.0]' AS pattern FROM region WHERE r_regionkey + 100 NOT IN (SELECT n_regionkey FROM nation)""")
def absence_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions a hundred further on that no nation is in, with what is absent."""
    e = warehouse(spark, sf_dir, ("nation",))
    e.register("far", table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey") + 100), unique=True)
    rows = [(x["R"], p[1]["absent"], json.dumps(p[1]["pattern"])) for x, p in e.explain("far(R,K), \\+ nation(_,_,K)")]
    return spark.createDataFrame(rows, "R string, absent string, pattern string")


@add("aggregate_proofs", """SELECT r_name AS "R", count(*)::BIGINT AS n, list_sort(list(n_name))::VARCHAR AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def aggregate_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nations a region has, with the facts that were counted."""
    e = warehouse(spark, sf_dir, ("nation", "region")).load("members(R,N) :- count(*) as N where region(K,R), nation(_,_,K).")
    rows = []
    for x, (p,) in e.explain("members(R,N)"):
        own = p["because"][0]
        names = sorted(parse_program(f["fact"] + ".")[0].head.args[1].value for group in own["of"] for f in group if f["fact"].startswith("nation"))
        rows.append((x["R"], int(own["value"]), f"[{', '.join(names)}]"))
    return spark.createDataFrame(rows, "R string, n long, members string")


@add("alternative_proofs", """SELECT c.n_name AS a, 'same(' || c.n_nationkey || ', ' || c.n_nationkey || ')' AS fact, count(*)::BIGINT AS proofs FROM nation c JOIN nation d USING (n_regionkey) WHERE c.n_nationkey = (SELECT min(n_nationkey) FROM nation) GROUP BY ALL""")
def alternative_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways in which the first nation has one of its region, by any nation there."""
    e = warehouse(spark, sf_dir, ("nation",)).load("same(X,Y) :- nation(X,_,R), nation(Z,_,R), nation(Y,_,R), X = Y.")
    first = table(spark, sf_dir, "nation").orderBy("n_nationkey").first()
    k = float(first["n_nationkey"])
    proofs = e.local("same(X,Y)").alternatives(("same", 2), (k, k))
    return spark.createDataFrame([(first["n_name"], proofs[0]["fact"], len(proofs))], "a string, fact string, proofs long")


@add("materialize_proved", f"""WITH {_LIES} SELECT 'lies/2' AS predicate, lies AS fact, true AS derived, '{{"because": [{{"fact": "' || nation || '"}}, {{"fact": "' || region || '"}}], "fact": "' || lies || '", "rule": 1}}' AS proof FROM t
    UNION ALL SELECT 'nation/3', nation, false, '{{"fact": "' || nation || '"}}' FROM t UNION ALL SELECT DISTINCT 'region/2', region, false, '{{"fact": "' || region || '"}}' FROM t""")
def materialize_proved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse(spark, sf_dir, ("nation", "region")).load("lies(N,R) :- nation(_,N,K), region(K,R).").materialize_proved()


@add("native_explain", """SELECT n_nationkey::BIGINT AS x, r_name AS y, '{"predicate":"part","values":[' || n_nationkey || ',"' || r_name || '"],"rule":1,"because":[{"predicate":"nation","values":[' || n_nationkey || ',"' || n_name || '",' || n_regionkey || ']},{"predicate":"region","values":['
    || r_regionkey || ',"' || r_name || '"]}]}' AS proof FROM nation JOIN region ON n_regionkey = r_regionkey""")
def native_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warehouse(spark, sf_dir, ("nation", "region")).native_explain("part(X, Y) :- nation(X, _, K), region(K, Y).")
    rows = [(x["row"]["X"], x["row"]["Y"], json.dumps(x["proof"], separators=(",", ":"))) for x in json.loads(found)]
    return spark.createDataFrame(rows, "x long, y string, proof string")


@add("native_fixpoint", """WITH RECURSIVE w AS (SELECT p_partkey AS x, p_partkey // 2 AS y FROM part WHERE p_partkey BETWEEN 1 AND 50 UNION SELECT w.x, w.y // 2 FROM w WHERE w.y > 0) SELECT x, y FROM w""")
def native_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors of fifty parts: a bounded form, for a few facts."""
    part = table(spark, sf_dir, "part").where("p_partkey BETWEEN 1 AND 50").select("p_partkey", F.floor(F.col("p_partkey") / 2).cast("long").alias("up"))
    found = Engine(spark).register("up", part, unique=True).native_query("anc(X,Y) :- up(X,Y). anc(X,Z) :- anc(X,Y), up(Y,Z).")
    return spark.createDataFrame([(r["X"], r["Y"]) for r in json.loads(found)], "x long, y long")


@add("profile_counters", """WITH n AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r), m AS (SELECT count(*) AS m FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT 'indexed' AS how, 1 + n AS lookups, n AS indexed_lookups, r AS index_facts, n + m AS visited FROM n, m UNION ALL SELECT 'full_scan', 1 + n, 0, 0, n + n * r FROM n""")
def profile_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a join takes with and without indexes."""
    p = reasoning.profile(warehouse(spark, sf_dir, ("nation", "region")), "nation(_,N,K), region(K,R)", compare_full_scan=True)
    rows = [(how, *(int(v) for v in p[how].values())) for how in ("indexed", "full_scan")]
    return spark.createDataFrame(rows, "how string, lookups long, indexed_lookups long, index_facts long, visited long")


@add("explain_sources", f"""WITH {_LIES}, s AS (SELECT DISTINCT nation AS f FROM t UNION SELECT DISTINCT region FROM t) SELECT '{{"N": "' || n || '", "R": "' || r || '"}}' AS "row", f AS fact, 'main' AS namespace, 'op of ' || split_part(f, '(', 1) AS op_id
    FROM t JOIN s ON f = nation OR f = region""")
def explain_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base facts of each answer with the operation that stated them."""
    n, r = (table(spark, sf_dir, t) for t in ("nation", "region"))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    a = n.select(F.concat(F.lit("nation("), "n_nationkey", F.lit(", "), quoted("n_name"), F.lit(", "), "n_regionkey", F.lit(")")).alias("clause"), F.lit("op of nation").alias("op_id"))
    b = r.select(F.concat(F.lit("region("), "r_regionkey", F.lit(", "), quoted("r_name"), F.lit(")")).alias("clause"), F.lit("op of region").alias("op_id"))
    sources = a.union(b).select("clause", F.lit("main").alias("namespace"), "op_id", F.lit("t").alias("ts"))
    e = warehouse(spark, sf_dir, ("nation", "region")).load("lies(N,R) :- nation(_,N,K), region(K,R).")
    return reasoning.proofs_with_sources(e, "lies(N,R)", sources).drop("ts")
