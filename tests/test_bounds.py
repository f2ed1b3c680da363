"""Relations, programs and ledgers within their bounds, and what lies beyond them."""

import datetime
import json

import pytest
from pyspark.errors import PySparkException

from sylloge.functions.vectors import letter_counts
from sylloge.operators import recorded, reasoning, retrieval
from sylloge.plans.engine import Engine
from sylloge.plans.local import LimitError
from sylloge.plans.syntax import DatalogError, parse_program
from sylloge.sources import journal, ledger


def test_portable(spark):
    e = Engine(spark)
    for rows, types in (([(None,)], "x string"), ([(2**53,)], "x long"), ([(float("nan"),)], "x double"), ([(float("inf"),)], "x double")):
        with pytest.raises(PySparkException):
            e.copy().register_portable("p", spark.createDataFrame(rows, types)).query("p(X)").collect()
    assert e.copy().register_portable("p", spark.createDataFrame([(2**53 - 1,), (-(2**53 - 1),)], "x long")).query("p(X)").count() == 2
    with pytest.raises(LimitError):
        e.register_portable("p", spark.range(11), most_rows=10)
    with pytest.raises(LimitError):
        e.register_portable("p", spark.createDataFrame([("x" * 100,)], "x string"), most_bytes=99)
    for types in ("x binary", "x timestamp", "x decimal(10,2)", "x array<int>"):
        with pytest.raises(DatalogError):
            e.register_portable("p", spark.createDataFrame([], types))


@pytest.mark.parametrize("rows", [0, 10_000])
def test_fixpoint_is_exact(spark, rows):
    big = 2**53
    up = spark.createDataFrame([(big + 1, big + 3), (big + 3, big + 5), (None, 1), (None, 1), (1, None)], "x long, y long")
    e = Engine(spark, local_rows=rows).register("up", up).load("anc(X,Y) :- up(X,Y). anc(X,Z) :- up(X,Y), anc(Y,Z).")
    got = {tuple(r) for r in e.query("anc(X,Y)").collect()}
    assert got == {(big + 1, big + 3), (big + 3, big + 5), (big + 1, big + 5), (None, 1), (1, None), (None, None)}


def test_keys_spare_shuffles(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "k int, n int")
    e = Engine(spark).register("a", a, keys=("k",)).register("b", b, unique=True)
    plan = lambda q: e.query(q)._jdf.queryExecution().optimizedPlan().toString()
    for query, distinct in (("a(K,V), b(K,N)", False), ("select K, N where a(K,V), b(K,N)", False), ("select V, N where a(K,V), b(K,N)", True), ("select K where a(K,_), b(K,_)", False), ("select N where b(_,N)", True), ("b(1,N)", False), ("select K, L where a(K,_), a(L,_)", False)):
        assert ("Aggregate" in plan(query)) == distinct, query
    rows = {q: sorted(tuple(r) for r in e.query(q).collect()) for q in ("select V, N where a(K,V), b(K,N)", "select K where a(K,_), b(K,_)")}
    assert list(rows.values()) == [[("x", 10), ("x", 11), ("y", 10)], [(1,), (2,)]]


def test_native(spark):
    e = Engine(spark).register("edge", spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string"))
    text = "way(X,Y) :- edge(X,Y). way(X,Z) :- way(X,Y), edge(Y,Z)."
    assert sorted(json.loads(e.native_query(text)), key=str) == [{"X": x, "Y": y} for x in "ab" for y in "ab"]
    found = {(x["row"]["X"], x["row"]["Y"]): x["proof"] for x in json.loads(e.native_explain(text))}
    assert found["a", "a"] == {"predicate": "way", "values": ["a", "a"], "rule": 2, "because": [{"predicate": "way", "values": ["a", "b"], "rule": 1, "because": [{"predicate": "edge", "values": ["a", "b"]}]}, {"predicate": "edge", "values": ["b", "a"]}]}
    for bad in ("way(X) :- edge(X,Y), \\+ edge(Y,X).", "a(X) :- edge(X,_). b(X) :- edge(X,_).", "way(X,X) :- edge(X,_).", "way(X) :- none(X).", " ".join(f"way(X) :- edge(X,_), edge(_,{c})." for c in "abcdefghijklmnopq")):
        with pytest.raises(DatalogError):
            e.native_query(bad)


def test_work(spark):
    e = Engine(spark).load("p(a). p(b). q(a, 1). q(a, 2). q(c, 3).")
    got = reasoning.profile(e, "p(X), q(X, N)", compare_full_scan=True)
    assert got["rows"] == 2 and got["indexed"] == {"relation_lookups": 3, "indexed_relation_lookups": 2, "index_facts_processed": 3, "candidate_facts_visited": 4}
    assert got["full_scan"] == {"relation_lookups": 3, "indexed_relation_lookups": 0, "index_facts_processed": 0, "candidate_facts_visited": 8} and got["reduction"] == {"avoided": 4, "times": 2.0}


def test_proved_materialisation(spark):
    rows = Engine(spark).load("p(a). q(X) :- p(X).").materialize_proved().collect()
    assert sorted((r["predicate"], r["fact"], r["derived"], json.loads(r["proof"])) for r in rows) == [("p/1", "p(a)", False, {"fact": "p(a)"}), ("q/1", "q(a)", True, {"fact": "q(a)", "rule": 1, "because": [{"fact": "p(a)"}]})]


def test_impact(spark):
    s = journal.Store(spark)
    s.assert_("m", "role(ann, guest). busy(X) :- role(X, guest). :- role(P, admin), role(P, guest).", "1", "t")
    s.assert_("m", "role(ann, admin). role(bob, guest).", "2", "t")
    got = recorded.recorded_impact(s.journal(), 1, 2, ("busy(X)",))
    assert sorted((r["clause"], r["change"]) for r in got.clauses.collect()) == [("role(ann, admin).", "added"), ("role(bob, guest).", "added")]
    assert [r["change"] for r in got.integrity.collect()] == ["introduced"] and [(r["row"], r["change"]) for r in got.queries.collect()] == [('{"X":"bob"}', "added")]
    assert got.topology["nodes_changed"] == ["role/2"] and got.counts["after"] == {"facts": 3, "rules": 1, "constraints": 1}


def test_ledger(spark):
    book, now = ledger.Ledger(spark, daily=2), datetime.datetime(2024, 5, 6, 23, tzinfo=datetime.timezone.utc)
    (a, said), (b, _) = book.reserve("m", "one", now), book.reserve("m", "two", now)
    assert said == "reserved" and book.reserve("m", "one", now)[1] == "duplicate" and book.reserve("m", "three", now)[1] == "daily_cap" and book.reserve("n", "one", now)[1] == "reserved"
    book.finish(a, "failed", now)
    assert book.reserve("m", "three", now)[1] == "reserved" and book.reserve("m", "one", now + datetime.timedelta(hours=2))[1] == "reserved"
    book.finish(b, "stored", now)
    with pytest.raises(DatalogError):
        book.finish(b, "stored", now + datetime.timedelta(hours=1))
    assert book.prune(datetime.date(2024, 5, 7), now) == 1 and sorted((r["namespace"], r["day"], r["n"]) for r in book.usage().collect()) == [("m", "d20240506", 1), ("m", "d20240507", 1), ("n", "d20240506", 1)]


def test_semantic_search(spark):
    docs = spark.createDataFrame([(1, "quiz zebra jazz fuzz"), (2, "zebra " + "moon " * 900), (3, "nothing"), (4, "zebra"), (5, None)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "zebra"), (2, "moon quiz"), (3, "unknown")], "item_id int, text string")
    cache = retrieval.EmbeddingCache(spark)
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.semantic_search(docs, queries, cache, "letters", letter_counts).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(1, 1, 4), (1, 2, 1), (1, 3, 2)] and {x[0] for x in got} == {1, 2} and cache.prepare(queries, "letters", letter_counts) == 0
    with pytest.raises(PySparkException):
        cache.prepare(docs, "bad", bad_model)


def bad_model(texts):
    return [[float("nan")] for _ in texts]


def test_near_words(spark):
    words = ["test", "tests", "best", "rest", "tes", "toast", "west", "tset", "a" * 65, "a" * 64, "testing"]
    got = {tuple(r) for r in retrieval.near_words(spark.createDataFrame([(w,) for w in [*words, "test"]], "w string")).collect()}
    assert got == {("best", "test"), ("best", "rest"), ("best", "west"), ("rest", "test"), ("rest", "west"), ("test", "tests"), ("test", "west")}


def test_schema_choice(spark):
    clauses = parse_program("works_at(ann, volt). works_at_until(bob, volt, t1). peer(A,B) :- works_at(A,F), works_at(B,F). lives_in(ann, oslo).")
    choose = lambda text, most=8: retrieval.select_schema(clauses, spark, text, most)
    assert choose("who works_at volt", 1) == ["works_at/2"] and choose("who was a peer", 2) == ["peer/2", "works_at/2"]
    assert set(choose("where did bob formerly work", 2)) == {"works_at/2", "works_at_until/3"}
    with pytest.raises(retrieval.BudgetError):
        choose("peer peer", 1)
    got = {r["predicate"]: (r["score"], r["source"]) for r in retrieval.rank_predicates(retrieval.clause_table(spark, clauses, {"lives_in(ann, oslo).": "Where does Ann live?"}), "where does ann live?").collect()}
    assert got["lives_in"] == (100 + 30 + 4 * 40 + 120, 4 * 40 + 120)
