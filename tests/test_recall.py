import pytest

from sylloge.operators import recall
from sylloge.plans.engine import Engine
from sylloge.sources import journal

FACTS = "lives_in(ann, oslo). works_in(ann, oslo). works_in(bob, rome). lives_in_until(ann, rome, t1). city(X) :- lives_in(_, X)."


def test_text(spark):
    e = Engine(spark).load(FACTS)
    assert recall.answer_text(e, "works_in(X, Y)") == "X = ann, Y = oslo\nX = bob, Y = rome"
    assert recall.answer_text(e, "works_in(ann, oslo)") == "Yes." and recall.answer_text(e, "works_in(ann, rome)") == "No." and recall.answer_text(e, "works_in(zed, X)") == "No answer."
    assert recall.evidence_text(e, "city(X)") == "X = oslo because lives_in(ann, oslo)"
    assert recall.schema_summary(e, 1).where("predicate = 'works_in'").first()["fact"] == '["ann","oslo"]'


def test_rivals(spark):
    e = Engine(spark).load(FACTS)
    assert recall.rivals(e, "lives_in(ann, X)") == [("lives_in", "works_in")] and recall.rivals(e, "works_in(bob, X)") == []
    assert recall.rivals(e, "lives_in_until(ann, X, T), lives_in(ann, X), works_in(_, X)") == [("lives_in_until", "lives_in")]


def test_proposals(spark):
    s = journal.Store(spark)
    p = recall.Proposal("m", "assert", "p(a).")
    d = p.reviewed(s)
    assert recall.apply_proposal(s, p, d, "1", "t1") == 1 == recall.apply_proposal(s, p, d, "1", "t1")
    with pytest.raises(journal.ConflictError):
        recall.apply_proposal(s, p, d, "2", "t2")
    q = recall.Proposal("m", "supersede", "p(b).", "p(_)")
    recall.apply_proposal(s, q, q.reviewed(s), "3", "t3")
    assert sorted(r["clause"] for r in s.state().where("namespace = 'm'").collect()) == ["p(b).", "p_until(a, t3)."]
