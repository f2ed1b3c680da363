"""What large tables need: joins that are spread over all tasks, and no bound that only small tables keep."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sylloge.functions.vectors import cosine

from sylloge.operators import graphs, policy, retrieval
from sylloge.plans import compiler, engine, registry
from sylloge.plans.engine import Engine
from sylloge.plans.syntax import parse_program
from tests.conftest import SF, same_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["theta_arith", "self_join_neq", "compiled_sql", "proof_edges", "cross_join", "join_many"])
def test_spread_joins(spark, duck, monkeypatch, name):
    """The results of joins whose sides are broadcast and dealt out, in chunks, are those of SQL."""
    monkeypatch.setattr(compiler, "SPREAD_BYTES", 0)
    monkeypatch.setattr(compiler, "CHUNK_ROWS", 3)
    df = registry.QUERIES[name](spark, SF)
    assert name == "join_many" or "RoundRobinPartitioning" in plan(df)
    same_rows(df, duck, registry.ORACLE_SQL[name])


def test_chunks_are_in_order(spark, monkeypatch):
    monkeypatch.setattr(compiler, "SPREAD_BYTES", 0)
    df = compiler.cross(spark.range(50).toDF("a"), spark.range(10).toDF("b"))
    assert "Sort " in plan(df) and sorted(map(tuple, df.collect())) == [(a, b) for a in range(50) for b in range(10)]


@pytest.mark.parametrize("query", ["a(X, U), b(Y, V), U > V * 2 - 1", "a(X, U), b(Y, V), U < Y", "a(X, _), b(_, V), V > 1", "a(X, U), b(Y, V)", "a(X, U), b(Y, V), U != V, X < 9, c(Z), Z > X", "a(X, U), d(W), W > U", "select X where a(X, 1), d(W), W < X"])
def test_tiles(spark, monkeypatch, query):
    """Pairs by tiles are those of plain products: nulls, rows that come twice, tests of either side, of both and of none."""
    a, b = [(i % 90, None if i % 11 == 0 else i % 5) for i in range(100)], [(i, None if i % 9 == 0 else i % 2) for i in range(30)] + [(None, 1), (3, 1)]
    e = Engine(spark).register("a", spark.createDataFrame(a, "x long, u int")).register("b", spark.createDataFrame(b, "y long, v int"))
    e.register("c", spark.range(3)).register("d", spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),)] * 9, "w double"))
    show = lambda df: sorted(map(repr, df.collect()))
    want = show(e.query(query))
    monkeypatch.setattr(compiler, "SPREAD_BYTES", 0)
    monkeypatch.setattr(compiler, "BROADCAST_BYTES", 2**100)
    for chunk, block in ((3, 4), (256, 512)):
        monkeypatch.setattr(compiler, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(compiler, "BLOCK_ROWS", block)
        df = e.query(query)
        assert show(df) == want
        # neither lies in a stage of generated code, which would hold all pairs of a block in memory
        assert "- BroadcastNestedLoopJoin" in plan(df) and "- Generate inline(filter(__rows" in plan(df)


def test_equal_values_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(compiler, "SPREAD_BYTES", 0)
    e = Engine(spark).register("a", spark.range(30).selectExpr("id", "id % 3")).register("b", spark.range(9))
    df = e.query("a(X, _), b(Y), X = Y * 2, X > Y")
    assert sorted(map(tuple, df.collect())) == [(2 * y, y) for y in range(1, 9)] and "NestedLoop" not in plan(df) and "__rows" not in plan(df)


def test_edges_that_differ_are_not_compared(spark):
    """Where solutions differ in the values that edges show, none is sent to be made distinct; elsewhere all are."""
    e = Engine(spark).register("lives", spark.createDataFrame([('a"b', 1), (None, 2), ("c", 1)], "n string, k int"), unique=True)
    e.register("sells", spark.createDataFrame([(7, 1), (7, 1)], "s int, k int"))
    both = e.load("near(C,S) :- lives(C,N), sells(S,N). at(C) :- lives(C,_).")
    assert "Aggregate" in plan(both.proof_edges(1)) and "Aggregate" not in plan(both.proof_edges(2))
    assert sorted(tuple(r) for r in both.proof_edges(1).collect()) == [
        ('["near","a\\"b","7"]', 1, 1, '["lives","a\\"b","1"]'), ('["near","a\\"b","7"]', 1, 2, '["sells","7","1"]'), ('["near","c","7"]', 1, 1, '["lives","c","1"]'), ('["near","c","7"]', 1, 2, '["sells","7","1"]'),
    ]
    assert '["at",null]' in {r["derived"] for r in both.proof_edges(2).collect()}


def test_sql_of_keyed_tables(spark):
    """A head that holds a key of each table needs no DISTINCT."""
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    e = Engine(spark).register("a", df, keys=("k",)).register("b", df)
    assert e.to_sql("p(X, Y) :- a(X, V), a(Y, V).").startswith("SELECT t0.") and e.to_sql("p(X) :- a(X, V), b(Y, V).").startswith("SELECT DISTINCT") and e.to_sql("p(V) :- a(_, V).").startswith("SELECT DISTINCT")


RULES = """old(X) :- age(X, N), N > 3. old(X) :- tall(X). quiet(X) :- age(X, _), \\+ old(X). never(X) :- nothing(X), age(X, _). sum(K, N) :- count(*) as N where up(X, K), old(X). none(N) :- count(*) as N where nothing(X).
    way(X, Y) :- up(X, Y). way(X, Z) :- way(X, Y), up(Y, Z). far(X) :- way(X, 0), quiet(X). old(7). go :- age(9, _). up(3, 0)."""


@pytest.mark.parametrize("query", ["old(X)", "quiet(X)", "never(X)", "sum(K, N)", "none(N)", "way(X, Y)", "far(X)", "age(X, _), old(X)", "way(X, X)", "go", "age(X, _), \\+ way(X, 0)", "select X where old(X), way(X, Y), Y < 2", "tall(X)"])
def test_rules_used(spark, query):
    """The rules that proofs on the driver use and those that tables give."""
    e = Engine(spark).register("age", spark.createDataFrame([(i, i % 7) for i in range(1, 12)], "x long, n int")).register("tall", spark.createDataFrame([(2,), (5,)], "x long"))
    e.register("up", spark.createDataFrame([(i, i // 2) for i in range(1, 12)], "x long, y long")).load(RULES)
    assert e.rules_used(query) == {n for _, proofs in e.explain(query) for p in proofs for n in policy.rules_used(p)}


def test_coverage_of_many_facts(spark):
    e = Engine(spark).register("n", spark.range(100_001)).load("big(X) :- n(X), X > 7. less(X) :- n(X), X < 0.")
    assert policy.rule_coverage(e, [policy.Check("big", "big(X)"), policy.Check("less", "less(X)")]) == {"percent": 50.0, "used": [1], "unused": [2]}


def test_neighbourhood_of_many_claims(spark):
    e = Engine(spark).register("lives", spark.range(1500).selectExpr("concat('p', id) AS p", "concat('town', id % 2) AS t"), unique=True).load("in(town0, land). in(land, world). in(town1, land).")
    got = {d: n for d, n in graphs.neighbourhood(graphs.incidences(e), "town0", 3, None).groupBy("depth").count().collect()}
    assert got == {1: 751, 2: 2, 3: 750}


def test_large_integers_in_many_rows(spark):
    e = Engine(spark).register_portable("p", spark.range(100_001), None, None)
    assert e.query("p(X)").count() == 100_001


def test_near_words_are_not_broadcast(spark):
    assert "Broadcast" not in plan(retrieval.near_words(spark.createDataFrame([("test",), ("tests",)], "w string")))


def test_nearest(spark):
    """Against all pairs in JVM: copies, nulls, zeros, vectors of other lengths, NaN; in one block and in several."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(150)]
    rows += [(150, None), (151, [0.0, 0.0, 0.0]), (152, [1.0, 2.0]), (153, [2.0, 4.0]), (154, [float("nan"), 1.0, 1.0]), (155, []), (156, [1.0, None, 2.0]), (157, [1e-3, 2e-3])]
    a = spark.createDataFrame(rows, "id long, vector array<double>")
    q = a.where("id % 5 = 0 OR id > 149")
    sims = q.select(F.col("id").alias("query_id"), F.col("vector").alias("e")).join(a.withColumnRenamed("id", "doc_id"), F.col("doc_id") != F.col("query_id"))
    sims = sims.select("query_id", "doc_id", F.round(cosine(F.col("e"), F.col("vector")), 6).alias("similarity")).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")))
    show = lambda df: sorted((r["query_id"], r["doc_id"], str(r["similarity"] + 0.0) if r["similarity"] is not None else "") for r in df.collect())
    want = show(sims.where("r <= 5"))
    for blocks in ((None, None), (7, 4)):
        assert show(retrieval.nearest(a, q, 5, *blocks)) == want


def test_search_keeps_few(spark, monkeypatch):
    """The streamed search against the joins: ties, documents in several rows, ids that are text, queries without words."""
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 40, n))
    docs = spark.createDataFrame([(f"d{i % 180}", text(int(rng.integers(0, 30)))) for i in range(200)], "doc_id string, text string")
    queries = spark.createDataFrame([(i, text(i)) for i in range(12)], "item_id int, text string")
    show = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    monkeypatch.setattr(retrieval, "SCORES", 60)
    few = [show(f(docs, queries, 4)) for f in (retrieval.document_search, retrieval.bm25)]
    assert "MapInArrow" in plan(retrieval.document_search(docs, queries, 4))
    monkeypatch.setattr(retrieval, "CONSTANT_WORDS", 1)
    assert few == [show(f(docs, queries, 4)) for f in (retrieval.document_search, retrieval.bm25)]
    monkeypatch.setattr(retrieval, "PAIRS", 1)
    assert few == [show(f(docs, queries, 4)) for f in (retrieval.document_search, retrieval.bm25)] and len(few[0]) > 30


def test_search_gathers_repeated_ids_only(spark, monkeypatch):
    """Words of documents of one row are scored where they are read; with ids that repeat, null texts and texts without hits the results are those of the joins."""
    queries = spark.createDataFrame([(i, f"tea{i} milk{i % 3}") for i in range(9)], "item_id int, text string")
    rows = [(i, f"tea{i % 9} milk{i % 4} tea{i % 7}") for i in range(40)] + [(i, "nothing asked") for i in range(40, 60)] + [(60, None), (61, "")]
    show = lambda df: sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))
    several = [(3, "tea0 milk0"), (3, "tea0"), (50, "tea1 milk1"), (60, "milk2")]
    got = []
    for more, gathers in (([], False), (several, True)):
        docs = spark.createDataFrame(rows + more, "doc_id int, text string")
        df = retrieval.document_search(docs, queries, 5)
        assert ("collect_list" in plan(df)) == gathers and "Exchange" in plan(df) and (gathers or "Exchange" not in plan(df).split("MapInArrow")[1])
        got.append(show(df))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "BROADCAST_WORDS", 1)
            df = retrieval.document_search(docs, queries, 5)
            assert show(df) == got[-1] and "LeftAnti" not in plan(df)
            m.setattr(retrieval, "PAIRS", 1)
            assert show(retrieval.document_search(docs, queries, 5)) == got[-1]
    assert got[0] != got[1] and (0, 1, 3, 3) in got[1]


def test_candidates_texts_are_not_sorted(spark, monkeypatch):
    """The ids of candidates are sent to the texts, whatever the planner thinks of their size."""
    plans, write = {}, retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, label: plans.update({label: plan(df)}) or write(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert registry.QUERIES["rerank_topk"](spark, SF).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans["chunks"] and "SortMergeJoin" not in plans["chunks"]


@pytest.mark.parametrize("name", ["reach_large_ids_distributed", "reach_nonlinear", "recursion_aggregate"])
def test_kept_relations(spark, duck, monkeypatch, name):
    """What every round joins lies in buckets by its column; the results are the same."""
    monkeypatch.setattr(engine, "KEPT_BYTES", 0)
    monkeypatch.setattr(engine, "LOCAL_ROWS", 0)
    monkeypatch.setattr(engine.Engine._fixpoint_small, "__code__", (lambda self, group, rules, db: None).__code__)
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name])


def test_joined_column():
    rules = parse_program("anc(X, Y) :- up(X, Y). anc(X, Z) :- anc(X, Y), up(Y, Z). by(X) :- anc(X, Y), other(X, Y). by(X) :- by(Y), up(Y, X).")
    assert engine._joined([("anc", 2)], rules[:2]) == {("up", 2): 0} and engine._joined([("by", 1)], rules[2:]) == {("up", 2): 0}
    assert engine._joined([("anc", 2)], parse_program("anc(X, Z) :- up(X, Y), anc(Y, Z).")) == {("up", 2): 1}
    assert engine._joined([("anc", 2)], parse_program("anc(X, Z) :- anc(X, Y), up(Y, Z). anc(X, Z) :- up(X, Y), anc(Y, Z).")) == {}


CLOSURES = ["way(X, Z) :- way(X, Y), up(Y, Z).", "way(X, Z) :- up(X, Y), way(Y, Z).", "way(X, Z) :- way(X, Y), way(Y, Z)."]
UPS = {  # pairs, their type, and whether their closure is made by doubling
    "tree": ([(i, i // 2) for i in range(1, 40)] * 2, "long", True), "turned": ([(i // 2, i) for i in range(1, 40)], "int", True), "text": ([(f"n{i}", f"n{i + 3}") for i in range(30)], "string", True),
    "one step": ([(1, 2), (3, 2)], "long", True), "nulls": ([(1, 2), (2, None), (None, 1), (5, 1)], "long", True), "cycle": ([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)], "long", False),
    "loop": ([(1, 1), (2, 1)], "long", False), "graph": ([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "long", False), "doubles": ([(1.0, 2.0), (2.0, 3.0)], "double", False), "none": ([], "long", True),
}


@pytest.mark.parametrize(("name", "rule"), [(n, CLOSURES[i % 3]) for i, n in enumerate(UPS)])
def test_closure(spark, monkeypatch, name, rule):
    """Closures by doubling and by rounds against steps one by one; trees never take the rounds, which move each pair more often."""
    pairs, kind, doubled = UPS[name]
    want, new = set(), set(pairs)
    while new - want:
        want |= new
        new = {(a, d) for a, b in want for c, d in pairs if b == c and b is not None}
    rounds = []
    by_rounds = Engine._fixpoint_spark
    monkeypatch.setattr(Engine, "_fixpoint_spark", lambda self, *a: rounds.append(1) or by_rounds(self, *a))
    e = Engine(spark, local_rows=0).register("up", spark.createDataFrame(pairs, f"x {kind}, y {kind}")).load("way(X, Y) :- up(X, Y). " + rule)
    got = [tuple(r) for r in e.query("way(X, Y)").collect()]
    assert len(got) == len(want) and set(got) == want and bool(rounds) != doubled
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sylloge_")]


def test_closure_keeps_bounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "x long, y long")
    for most, fine in ((6, False), (7, True)):
        e = Engine(spark, max_rounds=most, local_rows=0).register("up", chain, keys=("x",)).load("way(X, Y) :- up(X, Y). " + CLOSURES[0])
        if fine:
            assert e.query("way(X, Y)").count() == 21
        else:
            with pytest.raises(engine.LimitError):
                e.query("way(X, Y)")


@pytest.mark.parametrize("name", ["reach_large_ids_distributed", "reach_nonlinear", "recursion_aggregate"])
def test_rounds(spark, duck, monkeypatch, name):
    """The same queries by rounds, as closures that aren't of trees are derived."""
    monkeypatch.setattr(engine, "_closes", lambda group, rules: None)
    test_kept_relations(spark, duck, monkeypatch, name)


def test_rules_of_closures():
    closes = lambda text: engine._closes([("way", 2)], parse_program("way(X, Y) :- up(X, Y). " + text))
    assert all(closes(r) == ("up", 2) for r in (*CLOSURES, "way(A, C) :- up(B, C), way(A, B).", " ".join(CLOSURES)))
    for other in ("way(X, Z) :- way(Y, X), up(Y, Z).", "way(Z, X) :- way(X, Y), up(Y, Z).", "way(X, Z) :- way(X, Y), by(Y, Z).", "way(X, Z) :- up(X, Y), up(Y, Z).", "way(X, Z) :- way(X, Y), up(Y, Z), X != Z.",
                  "way(X, 1) :- way(X, Y), up(Y, 1).", "way(X, X) :- way(X, Y), up(Y, X).", "way(X, Y) :- way(X, _), up(_, Y).", "way(X, Y) :- by(X, Y). " + CLOSURES[0], "way(X, Z) :- up(X, Z), \\+ up(Z, X).", "way(X, Z) :- on, up(X, Z).", "way(X, Z) :- way(X, Z), up(Z)."):
        assert closes(other) is None
