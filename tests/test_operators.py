import json

import pytest

from sylloge.functions.text import asks_for_advice, is_sensitive, words
from sylloge.operators import graphs, policy, reasoning, retrieval, topology
from sylloge.plans.engine import Engine
from sylloge.plans.local import LimitError
from sylloge.plans.syntax import DatalogError, parse_program
from sylloge.sources import files
from pyspark.sql import functions as F

POLICY = "role(ann, guest). role(ann, admin). role(bob, guest). :- role(P, admin), role(P, guest)."


def test_integrity(spark):
    e = Engine(spark).load(POLICY)
    assert [json.loads(v["bindings"]) for v in policy.check_integrity(e)] == [{"P": "ann"}]
    after = policy.what_if(e, policy.Change(assume=("role(bob, admin)",)))
    assert [r["change"] for r in policy.integrity_delta(e, after).collect()] == ["introduced"]
    with pytest.raises(policy.PolicyError):
        policy.enforce(e, after, "no_new_violations")
    policy.enforce(e, e, "no_new_violations")
    with pytest.raises(policy.PolicyError):
        policy.enforce(e, e, "strict")
    assert policy.conflict_clusters(e).collect()[0]["n"] == 1
    with pytest.raises(LimitError):
        policy.check_integrity(after, most=1)


def test_what_if(spark):
    e = Engine(spark).load("arc(a,b). arc(b,c). way(X,Y) :- arc(X,Y). way(X,Z) :- way(X,Y), arc(Y,Z).")
    c = policy.Change(assume=("arc(c,d)",), without=("arc(a,_)",))
    got = {(r["X"], r["Y"]): r["change"] for r in policy.result_delta(e, policy.what_if(e, c), "way(X,Y)").collect()}
    assert got == {("a", "b"): "removed", ("a", "c"): "removed", ("b", "c"): "unchanged", ("c", "d"): "added", ("b", "d"): "added"}
    other = policy.what_if(e, policy.Change(rules=("way(X,Y) :- arc(Y,X).",)))
    assert {x["change"] for x in policy.evidence_delta(e, other, "way(X,Y)")} == {"added", "unchanged"}
    d = c.digest(e.program)
    assert policy.apply_change(e, c, d).holds("way(c,d)")
    with pytest.raises(DatalogError):
        policy.apply_change(other, c, d)
    with pytest.raises(DatalogError):
        policy.what_if(e, policy.Change(without_rules=("p(X) :- q(X).",)))


def test_checks(spark):
    e = Engine(spark).load("n(1). n(2). big(X) :- n(X), X > 1. odd(X) :- n(X), X < 2.")
    suite = [policy.Check("a", "big(X)", "rows", ({"X": 2},)), policy.Check("b", "big(X)", "empty"), policy.Check("c", "n(X)", "rows", ({"X": 1}, {"X": 3}))]
    got = policy.run_checks(e, suite)
    assert [r.passed for r in got] == [True, False, False] and got[2].missing == [{"X": "3.0"}] and got[2].unexpected == [{"X": "2.0"}]
    assert policy.rule_coverage(e, suite[:1])["percent"] == 50.0 and policy.rule_coverage(Engine(spark), [])["percent"] == 100.0
    after = policy.what_if(e, policy.Change(without=("n(2)",)))
    assert policy.check_delta(e, after, suite)["regressed"] == ["a"] and policy.check_delta(e, after, suite)["fixed"] == ["b"]
    with pytest.raises(policy.PolicyError):
        policy.enforce_checks(e, after, suite, "no_regressions")
    policy.enforce_checks(e, e, suite, "no_regressions")


def test_why_not_and_repair(spark):
    e = Engine(spark).load("works_at(ann, volt). blocked(ann). ok(X) :- works_at(X, volt), \\+ blocked(X). senior(X) :- ok(X), age(X, A), A > 40. age(ann, 30). loop(X) :- loop(X). n(N) :- count(*) as N where age(_, _).")
    assert reasoning.why_not(e, "works_at(ann, X)") == []
    assert reasoning.summary(reasoning.why_not(e, "ok(ann)")) == ["negated_fact_present: \\+ blocked(ann)"]
    assert reasoning.summary(reasoning.why_not(e, "ok(bob)")) == ["missing_fact: works_at(bob, volt)"]
    assert reasoning.summary(reasoning.why_not(e, "age(ann, A), A > 40")) == ["comparison_false: 30 > 40"]
    assert reasoning.summary(reasoning.why_not(e, "loop(a)")) == ["recursive_cycle: loop(a)"]
    assert reasoning.summary(reasoning.why_not(e, "n(5)")) == ["aggregate_result_mismatch: n(5)"]
    plans = reasoning.plan_repairs(e, "ok(ann)")
    assert plans == [reasoning.Repair((), ("blocked(ann)",), 1)] and reasoning.verified(e, "ok(ann)", plans[0]) == {"holds": True, "introduced": []}
    assert reasoning.plan_repairs(e, "ok(bob)")[0].assume == ("works_at(bob, volt)",)
    assert reasoning.plan_repairs(e, "works_at(ann, volt)") == []


def test_graph_of_proofs(spark):
    e = Engine(spark).load(POLICY + " busy(X) :- role(X, guest).")
    g = reasoning.explanation_graph(e, "busy(X)", {"role(ann, guest)": ["note 1"]})
    kinds = {k for k, _ in g.nodes.values()}
    assert {"result", "claim", "entity", "proof", "source", "conflict"} <= kinds
    start = next(i for i in g.nodes if i.startswith("result"))
    assert len(reasoning.subgraph(g, start, "result").nodes) == 2 < len(reasoning.subgraph(g, start, "support").nodes) < len(g.nodes)
    assert len(reasoning.subgraph(g, start, "neighbors", 8).nodes) >= len(reasoning.subgraph(g, start, "support").nodes)
    assert reasoning.profile(e, "busy(X)")["rows"] == 2


def test_topology(spark):
    e = Engine(spark).load("p(a). q(X) :- p(X), \\+ gone(X). r(X) :- nowhere(X). r(Y) :- nowhere(Y). s(X) :- s(X). p(a, b). :- missing(X).")
    codes = [f["code"] for f in topology.audit_rules(e)]
    assert set(codes) == {"open_negated_input", "open_positive_input", "policy_open_input", "unseeded_recursion", "inactive_derived_predicate", "duplicate_semantic_rule", "predicate_arity_overload"}
    t = topology.topology(e)
    assert topology.focus(t, "q/1", "upstream") == {"q/1", "rule 1", "p/1", "gone/1"} and "q/1" in topology.focus(t, "p/1", "downstream")
    after = policy.what_if(e, policy.Change(assume=("nowhere(x)",)))
    d = topology.audit_delta(e, after)
    assert {f["code"] for f in d["resolved"]} == {"open_positive_input", "inactive_derived_predicate"} and d["introduced"] == []
    assert topology.health(e)["status"] == "review" and topology.health(Engine(spark).load(POLICY))["status"] == "violations" and topology.health(Engine(spark))["status"] == "healthy"


def test_words(spark):
    got = spark.range(1).select(words(F.lit("worksAt the Cities, testing STARTED children's dogs is"))).first()[0]
    assert got == ["work", "at", "the", "city", "test", "start", "child", "s", "dogs", "be"]
    asked = spark.createDataFrame([("any tips on tea?",), ("who is ann",)], "t string")
    assert [r[0] for r in asked.select(asks_for_advice(F.col("t"))).collect()] == [True, False]
    texts = ["my password is hunter22", "nothing here", "Bearer abcdefgh1234", "4111 1111 1111 1111", "sk-abcdefgh1", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(is_sensitive(F.col("t"))).collect()] == [True, False, True, True, True, False]


def test_search(spark):
    clauses = retrieval.clause_table(spark, parse_program("works_at(ann, volt). lives_in(bob, oslo). boss(X) :- works_at(X, volt)."), {"works_at(ann, volt).": "Ann works at Volt"})
    got = retrieval.search(clauses, "who works at volt").collect()
    assert got[0]["clause"] == "works_at(ann, volt)." and [r["rank"] for r in got] == [1, 2] and got[0]["score"] == 120 + 60 + 2 * 45 + 2 * 20
    assert retrieval.search(clauses, "workz").collect()[0]["score"] == 30
    assert retrieval.search_graph(retrieval.search(clauses, "volt")).count() > 3
    with pytest.raises(ValueError):
        retrieval.search(clauses, "the of")
    ranked = {r["predicate"]: r["score"] for r in retrieval.rank_predicates(clauses, "where does bob live").collect()}
    assert ranked["lives_in"] > ranked.get("works_at", 0)


def test_rerank(spark):
    cand = spark.createDataFrame([(1, 10, 200, 1), (1, 11, 100, 2), (2, 10, 50, 1), (2, 11, 40, 2)], "query_id int, doc_id int, score int, rank int")
    vec = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (11, [1.0, 1.0])], "doc_id int, vector array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "query_id int, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.rerank(cand, vec, q, 2).collect()}
    assert got == {(1, 1): 10, (1, 2): 11, (2, 1): 11, (2, 2): 10}
    text = spark.createDataFrame([("x" * 4000,), ("",), ("y" * 50000,)], "t string")
    assert [[len(c) for c in r[0]] for r in text.select(retrieval.chunks(F.col("t"))).collect()] == [[2048, 2048, 416], [0], [2048] * 10]
    assert retrieval.missing_embeddings(text.withColumnRenamed("t", "text"), spark.createDataFrame([], "key string"), "m").count() == 3


def test_walks(spark):
    e = Engine(spark).load("member(nora, chess). member(ines, chess). works_at(nora, volt). works_at(ines, volt). works_at(zed, other). likes(1, 2).")
    inc = graphs.incidences(e)
    paths = graphs.shortest_paths(inc, "nora", "ines")
    assert len(paths) == 2 and all(len(p) == 5 for p in paths)
    assert graphs.shortest_paths(inc, "nora", "zed") == [] and graphs.shortest_paths(inc, "nora", "nora") == [["nora"]]
    with pytest.raises(LimitError):
        graphs.shortest_paths(inc, "nora", "ines", most=1)
    assert {r["claim"]: r["depth"] for r in graphs.neighbourhood(inc, "nora", 2).collect()} == {'["member","nora","chess"]': 1, '["works_at","nora","volt"]': 1, '["member","ines","chess"]': 2, '["works_at","ines","volt"]': 2}
    with pytest.raises(LimitError):
        graphs.neighbourhood(inc, "nora", 2, most=3)


def test_files(spark, tmp_path):
    clauses = parse_program(POLICY)
    files.write_program(spark, clauses, str(tmp_path / "p"))
    assert files.read_program(spark, str(tmp_path / "p")) == clauses
    text = files.export_bundle(clauses)
    assert len(files.verify_bundle(text)["clauses"]) == 4
    with pytest.raises(DatalogError):
        files.verify_bundle(text.replace("bob", "rob"))
    df = spark.range(3)
    assert files.json_rows(df) == '[{"id":0},{"id":1},{"id":2}]'
    with pytest.raises(LimitError):
        files.json_rows(df, most=2)
