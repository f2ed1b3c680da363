import pytest

from sylloge.plans.syntax import DatalogError
from sylloge.sources import journal
from sylloge.streaming import journal as stream


def clauses(df):
    return sorted(r["clause"] for r in df.where("namespace <> ''").collect())


@pytest.fixture(scope="module")
def store(spark):
    s = journal.Store(spark)
    assert s.assert_("main", "lives(ann, oslo). works(ann, acme). likes(X) :- works(X, _).", "op1", "t1", "note") == 1
    assert s.assert_("main", "lives(ann, oslo).", "op2", "t2") == 2
    assert s.supersede("main", "lives(ann, _)", "lives(ann, rome).", "op3", "t3") == 3
    assert s.assert_("side", "works(bob, acme).", "op4", "t4", trust="tentative") == 4
    assert s.retract("main", "likes(Y) :- works(Y, _).", "op5", "t5") == 5
    return s


def test_states(store):
    assert clauses(store.state(0)) == []
    assert clauses(store.state(1)) == sorted(["lives(ann, oslo).", "likes(V0) :- works(V0, _).", "works(ann, acme)."])
    assert clauses(store.state()) == sorted(["lives(ann, rome).", "lives_until(ann, oslo, t3).", "works(ann, acme).", "works(bob, acme)."])
    got = journal.snapshots(store.journal(), [1, 3, 5]).where("namespace <> ''").groupBy("as_of").count().collect()
    assert {r["as_of"]: r["count"] for r in got} == {1: 3, 3: 4, 5: 4}


def test_idempotent(store):
    assert store.assert_("main", "lives(ann, oslo).", "op2", "t9") == 2
    with pytest.raises(journal.ConflictError):
        store.assert_("main", "other(x).", "op2", "t9")


def test_history(store):
    got = journal.history_events(store.journal(), pattern="lives(ann, _)")
    assert [(e["sequence"], e["event"], e["current"], e["valid_until"]) for e in got] == [(1, "asserted", False, None), (3, "superseded", False, "t3"), (3, "asserted", True, None)]
    assert journal.history(store.journal(), "works(X, X)").count() == 0
    diff = {r["clause"]: r["change"] for r in journal.recorded_diff(store.journal(), 1, 5).where("namespace <> ''").collect()}
    assert diff["lives(ann, oslo)."] == "removed" and diff["lives(ann, rome)."] == "added" and "works(ann, acme)." not in diff


def test_trust(spark):
    s = journal.Store(spark)
    s.assert_("m", "p(a).", "1", "t", trust="tentative")
    s.assert_("m", "p(b).", "2", "t", trust="tentative")
    assert clauses(journal.trust_view(s.journal())) == [] and clauses(journal.trust_view(s.journal(), True)) == ["p(a).", "p(b)."]
    s.resolve_tentative("m", "p(a).", True, "3", "t")
    s.resolve_tentative("m", "p(b).", False, "4", "t")
    assert clauses(journal.trust_view(s.journal())) == ["p(a)."] and s.tentative().count() == 0
    with pytest.raises(journal.ConflictError):
        s.resolve_tentative("m", "p(a).", True, "5", "t")


def test_checkpoint(store):
    c = store.checkpoint()
    store.assert_("main", "new(x).", "op6", "t6")
    assert clauses(journal.snapshot(store.since(c))) == clauses(store.state())
    with pytest.raises(journal.IncompleteHistoryError):
        store.since({**c, "digest": "0"})
    with pytest.raises(journal.IncompleteHistoryError):
        journal.verify_journal(store.journal(), store.state().limit(1))


def test_segments(spark):
    s = journal.Store(spark)
    for i in range(3):
        s.assert_("m", f"p({i}). q(a, {i}).", f"op{i}", f"t{i}")
    pinned, before = s.journal(), clauses(s.state())
    assert s.rotate(1).startswith("segment-") and s.folders() == ["segment-00000000000000000001-00000000000000000003"] and s.last() == 3
    assert s.retract("m", "p(1)", "op3", "t3") == 4 and s.assert_("m", "p(0). q(a, 0).", "op0", "t") == 1
    assert clauses(journal.snapshot(pinned)) == before == clauses(s.state(3)) and clauses(s.state(1)) == ["p(0).", "q(a, 0)."]
    assert s.purge() == 3 and clauses(s.state()) == [c for c in before if c != "p(1)."]
    assert s.rotate() is not None and len(s.folders()) == 2 and s.rotate() is None
    a, b = s.checkpoint(), s.checkpoint()
    assert s.checkpoints() == [b] == [a] and a["sequence"] == 4


def test_two_writers(spark, monkeypatch):
    """A writer that starts from a number that another has taken gets the next one, and no clause is lost."""
    a = journal.Store(spark)
    b = journal.Store(spark, a.path)
    names = b._names
    a.assert_("m", "p(a).", "1", "t")
    stale = [[]]  # the second writer sees no claim at first
    monkeypatch.setattr(b, "_names", lambda *f: stale.pop() if f == ("_taken",) and stale else names(*f))
    monkeypatch.setattr(b, "last", lambda: 0)
    assert b.assert_("m", "p(b).", "2", "t") == 2 and clauses(a.state()) == ["p(a).", "p(b)."]


def test_many_writers(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = journal.Store(spark).path
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: journal.Store(spark, path).assert_("m", f"p({i % 6}).", f"op{i % 6}", "t"), range(8)))
    assert sorted(got[:6]) == sorted(set(got)) and got[6:] == got[:2]
    s = journal.Store(spark, path)
    assert clauses(s.state()) == [f"p({i})." for i in range(6)] and journal.problems(s.journal()).count() == 0


def test_writers_that_die(spark, monkeypatch):
    s = journal.Store(spark, patience=0.2)
    assert s._create("_taken/00000000000000000001", "x")  # died before its rows were there
    assert s.assert_("m", "p(a).", "1", "t") == 2
    with monkeypatch.context() as m:
        m.setattr(s, "_finish", lambda n: None)  # dies when its fate is decided
        s.assert_("m", "p(b).", "2", "t")
    assert clauses(s.state()) == ["p(a)."]
    assert s.assert_("m", "p(c).", "3", "t") == 4 and clauses(s.state()) == ["p(a).", "p(b).", "p(c)."]
    assert s.assert_("m", "p(b).", "2", "t") == 3
    with monkeypatch.context() as m:
        m.setattr(s, "_new", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.assert_("m", "p(d).", "4", "t")
    assert s.assert_("m", "p(d).", "4", "t") == 6
    slow = journal.Store(spark, s.path, patience=0.2)
    n = slow._claim("k")
    assert s.assert_("m", "p(e).", "5", "t") == n + 1  # gave up waiting
    monkeypatch.setattr(slow, "_claim", lambda key: n)
    with pytest.raises(journal.ConflictError):
        slow.assert_("m", "p(f).", "6", "t")
    assert clauses(s.state()) == [f"p({c})." for c in "abcde"]


def test_exchange_and_load(spark):
    s = journal.Store(spark)
    s.assert_("m", "p(X) :- q(X). q(a).", "1", "t")
    assert s.exchange("m", ["p(Y) :- q(Y)."], "p(X) :- q(X), r(X).", "2", "t") == 2
    with pytest.raises(journal.ConflictError):
        s.exchange("m", ["p(Y) :- q(Y)."], "z(a).", "3", "t")
    facts = spark.createDataFrame([("q(a).",), ("q('it''s, (b)').",), ("r(7, x).",), ("up.",)], "clause string")
    s.load("m", facts, "4", "t")
    assert clauses(s.state()) == sorted(["p(V0) :- q(V0), r(V0).", "q(a).", "q('it''s, (b)').", "r(7, x).", "up."])
    with pytest.raises(DatalogError):
        s.load("m", spark.createDataFrame([("q(X).",), ("q(a) :- b.",)], "clause string"), "5", "t")
    s.supersede("m", "q('it''s, (b)')", "q(c).", "6", "2024-01-01T00:00:00Z")
    s.supersede("m", "up", "", "7", "t7")
    assert {"q_until('it''s, (b)', '2024-01-01T00:00:00Z').", "up_until(t7).", "q(c)."} <= set(clauses(s.state()))


def test_engine_of_a_state(spark):
    s = journal.Store(spark)
    s.assert_("m", "lives(ann, 'St. John''s'). lives(bob, 'a, (b)'). age(ann, 7). age(bob, -1.5). up. old(X) :- age(X, N), N > 1. 'Odd name'(x).", "1", "t")
    e = journal.engine_of(s.state())
    assert {(r["P"], r["C"]) for r in e.rows("lives(P, C)")} == {("ann", "St. John's"), ("bob", "a, (b)")}
    assert e.rows("old(X)") == [{"X": "ann"}] and e.holds("up") and e.rows("age(bob, N)") == [{"N": -1.5}] and e.rows("'Odd name'(X)") == [{"X": "x"}]
    s.assert_("m", "age(carl, old).", "2", "t")
    with pytest.raises(DatalogError):
        journal.engine_of(s.state())


def test_json_lines(spark, tmp_path):
    lines = ['{"ts":"t1","op":"assert","namespace":"m","opId":"1","added":["p(a).","p(b)."],"sourceText":"s"}', '{"ts":"t2","op":"supersede","namespace":"m","opId":"2","removedClauses":["p(a)."],"added":["p(c)."],"validUntil":"t2"}']
    (tmp_path / "0001.jsonl").write_text(lines[0] + "\n")
    (tmp_path / "0002.jsonl").write_text(lines[1] + "\n")
    j = journal.read_lines(spark, str(tmp_path))
    assert [(r["sequence"], r["position"], r["action"], r["clause"], r["valid_until"]) for r in j.orderBy("sequence", "position").collect()] == [(1, 0, "assert", "p(a).", None), (1, 1, "assert", "p(b).", None), (2, 0, "retract", "p(a).", "t2"), (2, 1, "assert", "p(c).", None)]
    assert clauses(journal.snapshot(j)) == ["p(b).", "p(c)."] and journal.problems(j).count() == 0
    (tmp_path / "0003.jsonl").write_text('{"ts":"t3","op":"other","namespace":"m","opId":"3","added":["p(d)."]}\n')
    with pytest.raises(Exception, match="line 3"):
        journal.read_lines(spark, str(tmp_path)).collect()


def test_json_lines_of_a_large_file(spark, tmp_path):
    """A file of several blocks is read by several tasks, and its lines keep their numbers; empty files have none."""
    line = '{"ts":"t","op":"assert","namespace":"m","opId":"%d","added":["p(%d)."]}\n'
    (tmp_path / "0001.jsonl").write_text("".join(line % (i, i) for i in range(1, 501)))
    (tmp_path / "0002.jsonl").write_text("")
    (tmp_path / "0003.jsonl").write_text("".join(line % (i, i) for i in range(501, 701)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        j = journal.read_lines(spark, str(tmp_path))
        assert j.rdd.getNumPartitions() > 3
        assert [(r["sequence"], r["op_id"]) for r in j.orderBy("sequence").collect()] == [(i, str(i)) for i in range(1, 701)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_problems(spark):
    row = lambda n, op, action, clause: (n, 0, "t", "m", op, action, clause, None, None, None)
    j = spark.createDataFrame([row(1, "a", "assert", "p."), row(2, "b", "retract", "q."), row(3, "c", "retract", "p."), row(4, "c", "assert", "p."), row(5, "d", "move", "p."), row(6, None, "assert", "r.")], journal.SCHEMA)
    assert sorted((r["sequence"], r["problem"]) for r in journal.problems(j).collect()) == [(2, "retracts_nothing"), (3, "operation_twice"), (5, "incomplete"), (6, "incomplete")]


def test_digests(spark):
    state = lambda *rows: spark.createDataFrame(list(rows), "namespace string, clause string")
    a = journal.digest(state(("m", "p."), ("m", "q."), ("n", "p.")))
    assert a == journal.digest(state(("n", "p."), ("m", "q."), ("m", "p."), ("m", "p."))) != journal.digest(state(("m", "p."), ("n", "q."), ("n", "p.")))


def test_identity_view(spark):
    from sylloge.plans.engine import Engine

    e = Engine(spark).register("lives", spark.createDataFrame([("bob", "rome", 1), ("robert", "rome", 1), ("robert", "bob", 2)], "a string, b string, c int"))
    e.load("likes(bob, rob). likes(robert, rob). lives_until(bob, rome, 1, t). r(X) :- likes(X, bob).")
    v = journal.identity_view(e, [("bob", "rob"), ("rob", "robert")], {("lives", 3, 1), ("likes", 2, 1)})
    assert {(r["A"], r["B"], r["C"]) for r in v.rows("lives(A, B, C)")} == {("robert", "rome", 1), ("robert", "bob", 2)}
    assert v.rows("likes(A, B)") == [{"A": "robert", "B": "rob"}] and v.rows("lives_until(A, _, _, _)") == [{"A": "robert"}]
    with pytest.raises(DatalogError):
        journal.identity_view(e, [("a", "b")], {("lives", 3, 4)})


def test_aliases(spark):
    assert journal.resolve_aliases([("a", "b"), ("b", "c")]) == {"a": "c", "b": "c"}
    for bad in ([("a", "a")], [("a", "b"), ("a", "c")], [("a", "b"), ("b", "a")]):
        with pytest.raises(DatalogError):
            journal.resolve_aliases(bad)
    facts = spark.createDataFrame([("a", "a"), ("c", "a")], "x string, y string")
    assert [tuple(r) for r in journal.canonicalize(facts, ["x"], {"a": "c"}).collect()] == [("c", "a")]


def test_stream(spark, store, tmp_path):
    for _ in range(2):
        q = stream.maintain(stream.read(spark, store.path, 1), str(tmp_path / "state"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert clauses(stream.latest(spark, str(tmp_path / "state"))) == clauses(store.state())
    parts = {p.parent.name for p in (tmp_path / "state").glob("batch=*/part=*")}
    assert len(parts) > 1  # one folder for each batch, with the parts that it touched
