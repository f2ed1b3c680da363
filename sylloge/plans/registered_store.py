"""Queries of the journaled store, over whole tables."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy, recall, recorded
from ..sources import files, journal, ledger
from ..sources.scratch import new_path
from .engine import Engine
from .registered_rules import table
from .registry import add
from .syntax import DatalogError, canonical, parse_program

# -- journal --------------------------------------------------------------------------------------------


def event_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a journal: a purchase or signup states likes(user, key), an error takes it back."""
    ev = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "retract").when(F.col("event_type").isin("purchase", "signup", "view"), "assert")
    clause = F.concat(F.lit("likes("), F.col("user_id"), F.lit(", "), F.get_json_object("props", "$.k"), F.lit(")."))
    return ev.select(
        F.col("event_id").alias("sequence"), F.lit(0).alias("position"), F.col("ts").cast("string").alias("ts"), F.lit("main").alias("namespace"),
        F.concat(F.lit("op"), F.col("event_id")).alias("op_id"), action.alias("action"), clause.alias("clause"), F.col("event_type").alias("source"),
        F.when(F.col("event_type") == "view", "tentative").otherwise("accepted").alias("trust"), F.lit(None).cast("string").alias("valid_until"),
    ).where("action IS NOT NULL")


_JOURNAL = """j AS (SELECT event_id AS sequence, CASE event_type WHEN 'error' THEN 'retract' ELSE 'assert' END AS action, event_type AS source,
    'likes(' || user_id || ', ' || json_extract_string(props, '$.k') || ').' AS clause, CASE event_type WHEN 'view' THEN 'tentative' ELSE 'accepted' END AS trust, 'op' || event_id AS op_id
    FROM events WHERE event_type IN ('error', 'purchase', 'signup', 'view'))"""
_STATE = "SELECT * FROM j {where} QUALIFY row_number() OVER (PARTITION BY clause ORDER BY sequence DESC) = 1"


@add("snapshot_current", f"WITH {_JOURNAL} SELECT sequence, clause, trust FROM ({_STATE.format(where='')}) WHERE action = 'assert'")
def snapshot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.snapshot(event_journal(spark, sf_dir)).select("sequence", "clause", "trust")


@add("snapshot_as_of", f"WITH {_JOURNAL} SELECT sequence, clause FROM ({_STATE.format(where='WHERE sequence <= 4000')}) WHERE action = 'assert'")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.snapshot(event_journal(spark, sf_dir), 4000).select("sequence", "clause")


@add("snapshot_batch", f"""WITH {_JOURNAL} SELECT as_of, count(*)::BIGINT AS n FROM (SELECT a.as_of, j.* FROM j, (VALUES (1000::BIGINT), (5000), (9000)) AS a(as_of) WHERE sequence <= as_of
    QUALIFY row_number() OVER (PARTITION BY as_of, clause ORDER BY sequence DESC) = 1) WHERE action = 'assert' GROUP BY 1""")
def snapshot_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.snapshots(event_journal(spark, sf_dir), [1000, 5000, 9000]).groupBy("as_of").agg(F.count("*").alias("n"))


@add("history_events", f"""WITH {_JOURNAL} SELECT sequence, clause, CASE action WHEN 'assert' THEN 'asserted' ELSE 'retracted' END AS event,
    EXISTS (SELECT 1 FROM ({_STATE.format(where='')}) s WHERE s.action = 'assert' AND s.clause = j.clause) AS "current" FROM j WHERE clause LIKE 'likes(7, %'""")
def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.history(event_journal(spark, sf_dir), "likes(7, _)").select("sequence", "clause", "event", "current")


@add("recorded_diff", f"""WITH {_JOURNAL}, a AS (SELECT * FROM ({_STATE.format(where='WHERE sequence <= 3000')}) WHERE action = 'assert'), b AS (SELECT * FROM ({_STATE.format(where='WHERE sequence <= 6000')}) WHERE action = 'assert')
    SELECT coalesce(a.clause, b.clause) AS clause, CASE WHEN a.clause IS NULL THEN 'added' WHEN b.clause IS NULL THEN 'removed' ELSE 'source_changed' END AS change
    FROM a FULL JOIN b ON a.clause = b.clause WHERE a.clause IS NULL OR b.clause IS NULL OR a.op_id <> b.op_id""")
def recorded_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.recorded_diff(event_journal(spark, sf_dir), 3000, 6000).select("clause", "change")


@add("trust_view", f"WITH {_JOURNAL} SELECT clause FROM ({_STATE.format(where='')}) WHERE action = 'assert' AND trust = 'accepted'")
def trust_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.trust_view(event_journal(spark, sf_dir)).select("clause")


@add("provenance", f"WITH {_JOURNAL} SELECT clause, op_id, source FROM ({_STATE.format(where='')}) WHERE action = 'assert'")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.provenance(event_journal(spark, sf_dir)).select("clause", "op_id", "source")


@add("entity_canonical", """SELECT DISTINCT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'VEHICLES' WHEN 'MACHINERY' THEN 'VEHICLES' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer""")
def entity_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return journal.canonicalize(facts, ["segment"], journal.resolve_aliases([("MACHINERY", "AUTOMOBILE"), ("AUTOMOBILE", "VEHICLES")]))


_LIKES = "likes(' || user_id || ', ' || json_extract_string(props, '$.k') || ').'"


def _facts_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return ev.select(F.concat(F.lit("likes("), F.col("user_id"), F.lit(", "), F.get_json_object("props", "$.k"), F.lit(").")).alias("clause")).distinct()


def _store(spark: SparkSession, sf_dir: str) -> journal.Store:
    """Two operations: what was purchased, then what was viewed, the latter tentative."""
    s = journal.Store(spark)
    s.load("main", _facts_of(spark, sf_dir, "purchase"), "op1", "2024-01-01T00:00:00Z", "purchases")
    s.load("main", _facts_of(spark, sf_dir, "view"), "op2", "2024-01-02T00:00:00Z", "views", "tentative")
    return s


_STORE = f"""p AS (SELECT DISTINCT '{_LIKES} AS clause, user_id AS u, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'purchase'),
    w AS (SELECT DISTINCT '{_LIKES} AS clause, user_id AS u, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view' AND '{_LIKES} NOT IN (SELECT clause FROM p)),
    first AS (SELECT min(u) AS u FROM p)"""


@add("store_assert", f"WITH {_STORE} SELECT 1::BIGINT AS sequence, clause, 'accepted' AS trust FROM p UNION ALL SELECT 2, clause, 'tentative' FROM w")
def store_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).state().select("sequence", "clause", "trust")


def _first(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").agg(F.min("user_id")).first()[0]


@add("store_retract", f"WITH {_STORE} SELECT clause FROM p, first WHERE p.u <> first.u UNION ALL SELECT clause FROM w, first WHERE w.u <> first.u")
def store_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store without all of the first user's facts."""
    s = _store(spark, sf_dir)
    s.retract("main", f"likes({_first(spark, sf_dir)}, _)", "op3", "2024-01-03T00:00:00Z")
    return s.state().select("clause")


@add("store_replace", f"WITH {_STORE} SELECT clause FROM p, first WHERE p.u <> first.u UNION ALL SELECT clause FROM w, first WHERE w.u <> first.u UNION ALL SELECT 'likes(' || u || ', nothing).' FROM first")
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, u = _store(spark, sf_dir), _first(spark, sf_dir)
    s.replace("main", f"likes({u}, _)", f"likes({u}, nothing).", "op3", "2024-01-03T00:00:00Z")
    return s.state().select("clause")


@add("supersede_archive", f"""WITH {_STORE}, old AS (SELECT * FROM p UNION ALL SELECT * FROM w) SELECT clause, NULL AS was FROM old, first WHERE old.u <> first.u
    UNION ALL SELECT 'likes(' || u || ', nothing).', NULL FROM first UNION ALL SELECT 'likes_until(' || old.u || ', ' || k || ', ''2024-01-03T00:00:00Z'').', NULL FROM old, first WHERE old.u = first.u
    UNION ALL SELECT clause, '2024-01-03T00:00:00Z' FROM old, first WHERE old.u = first.u""")
def supersede_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after one user's facts were superseded, and these with the time until which they held."""
    s, u = _store(spark, sf_dir), _first(spark, sf_dir)
    s.supersede("main", f"likes({u}, _)", f"likes({u}, nothing).", "op3", "2024-01-03T00:00:00Z")
    was = s.journal().where("valid_until IS NOT NULL").select("clause", F.col("valid_until").alias("was"))
    return s.state().select("clause", F.lit(None).cast("string").alias("was")).union(was)


@add("tentative_resolved", f"WITH {_STORE}, one AS (SELECT min(clause) AS a, max(clause) AS b FROM w) SELECT clause, CASE WHEN clause = a THEN 'accepted' ELSE 'tentative' END AS trust FROM w, one WHERE clause <> b OR a = b")
def tentative_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what was only viewed, the first fact in the order of text is accepted and the last one goes."""
    s = _store(spark, sf_dir)
    a, b = s.tentative().agg(F.min("clause"), F.max("clause")).first()
    s.resolve_tentative("main", a, True, "op3", "2024-01-03T00:00:00Z")
    if a != b:
        s.resolve_tentative("main", b, False, "op4", "2024-01-04T00:00:00Z")
    return s.state().where((F.col("trust") == "tentative") | (F.col("clause") == a)).select("clause", "trust")


@add("checkpoint_replay", f"WITH {_STORE} SELECT clause FROM p UNION ALL SELECT clause FROM w UNION ALL SELECT 'likes(0, tea).'")
def checkpoint_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state from a checkpoint and what came after, when all operations before were put into a segment."""
    s = _store(spark, sf_dir)
    c = s.checkpoint()
    s.rotate()
    s.assert_("main", "likes(0, tea).", "op3", "2024-01-03T00:00:00Z")
    return journal.snapshot(s.since(c)).select("clause")


@add("program_digest", f"""WITH {_JOURNAL}, s AS (SELECT 'main' AS namespace, sha256(clause) AS h FROM ({_STATE.format(where='')}) WHERE action = 'assert'),
    d AS (SELECT namespace, count(*) AS n, {', '.join(f"sum(('0x' || h[{1 + 16 * i}:{16 * i + 16}])::UBIGINT)::VARCHAR AS s{i}" for i in range(4))} FROM s GROUP BY 1)
    SELECT namespace, n::BIGINT AS clauses, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS digest FROM d""")
def program_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.digests(journal.snapshot(event_journal(spark, sf_dir)))


@add("store_program", f"""WITH {_JOURNAL} SELECT split_part(split_part(clause, '(', 2), ',', 1)::DOUBLE AS "U", count(*)::BIGINT AS "N" FROM ({_STATE.format(where='')}) WHERE action = 'assert' GROUP BY 1""")
def store_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over the facts of a journal, which become a relation where they lie."""
    e = journal.engine_of(journal.snapshot(event_journal(spark, sf_dir))).load("n(U,N) :- count(*) as N where likes(U,_).")
    return e.query("n(U,N)")


@add("recorded_impact", f"""WITH {_JOURNAL}, a AS (SELECT clause FROM ({_STATE.format(where='WHERE sequence <= 300')}) WHERE action = 'assert' AND trust = 'accepted'), b AS (SELECT clause FROM ({_STATE.format(where='WHERE sequence <= 600')}) WHERE action = 'assert' AND trust = 'accepted'),
    u AS (SELECT DISTINCT split_part(split_part(clause, '(', 2), ',', 1)::DOUBLE AS u, 'a' AS s FROM a UNION SELECT DISTINCT split_part(split_part(clause, '(', 2), ',', 1)::DOUBLE, 'b' FROM b)
    SELECT '{{"U":"' || u || '"}}' AS "row", CASE max(s) WHEN 'a' THEN 'removed' ELSE 'added' END AS change FROM u GROUP BY u HAVING count(*) = 1""")
def recorded_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who came and went among those that like something, between two numbers of the journal."""
    return recorded.recorded_impact(event_journal(spark, sf_dir), 300, 600, ("select U where likes(U,_)",)).queries.drop("query")


@add("rule_change", """WITH u AS (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'purchase') SELECT u::DOUBLE AS "X", 'new' AS rule FROM u WHERE u > 5 UNION ALL SELECT NULL, 'stale review refused'""")
def rule_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the store is exchanged after a review; the same review is refused once the program is another."""
    s = journal.Store(spark)
    s.load("main", _facts_of(spark, sf_dir, "purchase"), "op1", "2024-01-01T00:00:00Z")
    s.assert_("rules", "buyer(X) :- likes(X, _).", "op2", "2024-01-02T00:00:00Z")
    change = policy.Change(without_rules=("buyer(X) :- likes(X, _).",), rules=("buyer(X) :- likes(X, _), X > 5.",))
    reviewed = change.digest(journal.engine_of(s.state()).program)
    policy.apply_rule_change(s, "rules", change, reviewed, "op3", "2024-01-03T00:00:00Z")
    try:
        policy.apply_rule_change(s, "rules", change, reviewed, "op4", "2024-01-04T00:00:00Z")
        said = "applied twice"
    except DatalogError:
        said = "stale review refused"
    found = journal.engine_of(s.state()).query("buyer(X)").select("X", F.lit("new").alias("rule"))
    return found.union(spark.createDataFrame([(None, said)], "X double, rule string"))


@add("memory_proposal", f"WITH {_STORE} SELECT clause FROM p UNION ALL SELECT 'likes(0, tea).' UNION ALL SELECT clause FROM w")
def memory_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposed fact is applied to the state that it was reviewed for; one whose state has changed isn't."""
    s = _store(spark, sf_dir)
    a, b = recall.Proposal("main", "assert", "likes(0, tea)."), recall.Proposal("main", "assert", "likes(0, coffee).")
    reviewed = b.reviewed(s)
    recall.apply_proposal(s, a, a.reviewed(s), "op3", "2024-01-03T00:00:00Z")
    try:
        recall.apply_proposal(s, b, reviewed, "op4", "2024-01-04T00:00:00Z")
    except journal.ConflictError:
        pass
    return s.state().select("clause")


@add("alias_checks", """SELECT 'self' AS alias, count(*) > 0 AS refused FROM customer UNION ALL SELECT 'two targets', count(DISTINCT c_mktsegment) > 1 FROM customer UNION ALL SELECT 'circle', count(DISTINCT c_mktsegment) > 1 FROM customer UNION ALL SELECT 'chain', false""")
def alias_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sets of aliases made of the market segments are refused."""
    a, b, *_ = (r[0] for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect())
    cases = {"self": [(a, a)], "two targets": [(a, b), (a, "other")], "circle": [(a, b), (b, a)], "chain": [(a, b), (b, "other")]}

    def refused(pairs: list) -> bool:
        try:
            journal.resolve_aliases(pairs)
        except DatalogError:
            return True
        return False

    return spark.createDataFrame([(n, refused(p)) for n, p in cases.items()], "alias string, refused boolean")


@add("identity_view", """SELECT DISTINCT c_custkey::BIGINT AS "C", CASE c_mktsegment WHEN 'MACHINERY' THEN 'VEHICLES' WHEN 'AUTOMOBILE' THEN 'VEHICLES' ELSE c_mktsegment END AS "S", c_mktsegment AS "T" FROM customer""")
def identity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by their final names, in the first of two places only."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("a"), F.col("c_mktsegment").alias("b"))
    e = journal.identity_view(Engine(spark).register("in", c), [("MACHINERY", "AUTOMOBILE"), ("AUTOMOBILE", "VEHICLES")], {("in", 3, 2)})
    return e.query("in(C, S, T)")


@add("capture_ledger", """SELECT "day", count(*)::BIGINT AS n FROM (SELECT 'd' || strftime(ts, '%Y%m%d') AS "day", row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS r FROM (SELECT * FROM events ORDER BY event_id LIMIT 4)) WHERE r <= 2 GROUP BY 1""")
def capture_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few captures, at most two a day; the ledger takes one operation for each and isn't made for whole tables."""
    book = ledger.Ledger(spark, daily=2)
    for r in table(spark, sf_dir, "events").orderBy("event_id").limit(4).collect():
        now = r["ts"].replace(tzinfo=datetime.timezone.utc)
        capture, said = book.reserve("main", str(r["event_id"]), now)
        if said == "reserved":
            book.finish(capture, "stored", now)
    return book.usage().select("day", "n")


@add("namespace_files", """SELECT 'nation(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ').' AS clause FROM nation""")
def namespace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written as program text and read again."""
    facts = [canonical(parse_program(f"nation({r[0]}, '{r[1]}', {r[2]}).")[0]) for r in table(spark, sf_dir, "nation").collect()]
    path = new_path(spark, "program")
    files.write_program(spark, [parse_program(c)[0] for c in facts], path)
    return spark.createDataFrame([(canonical(c),) for c in files.read_program(spark, path)], "clause string")


@add("json_sink", """SELECT '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']' AS rows FROM region""")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(files.json_rows(table(spark, sf_dir, "region").orderBy("r_regionkey")),)], "rows string")


@add("bundle", """WITH c AS (SELECT '[' || string_agg('"' || f || '"', ',' ORDER BY f) || ']' AS clauses FROM (SELECT 'region(' || r_regionkey || ', ''' || r_name || ''').' AS f FROM region))
    SELECT sha256('{"checks":[],"clauses":' || clauses || ',"sources":{},"version":1}') AS digest, true AS verified, true AS changed_is_refused FROM c""")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = [parse_program(f"region({r[0]}, '{r[1]}').")[0] for r in table(spark, sf_dir, "region").collect()]
    text = files.export_bundle(facts)
    try:
        files.verify_bundle(text.replace("region", "REGION"))
        refused = False
    except DatalogError:
        refused = True
    return spark.createDataFrame([(json.loads(text)["digest"], len(files.verify_bundle(text)["clauses"]) == len(facts), refused)], "digest string, verified boolean, changed_is_refused boolean")


@add("journal_lines", f"WITH {_JOURNAL} SELECT sequence, clause, trust FROM (SELECT row_number() OVER (ORDER BY sequence) AS sequence, action, clause, trust FROM j QUALIFY row_number() OVER (PARTITION BY clause ORDER BY sequence DESC) = 1) WHERE action = 'assert'")
def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal of events written as JSON lines, in files whose names follow its order, and read again."""
    path, j = new_path(spark, "lines"), event_journal(spark, sf_dir)
    one = lambda a: F.when(F.col("action") == a, F.array("clause"))
    lines = j.select("sequence", F.to_json(F.struct("ts", F.col("action").alias("op"), "namespace", F.col("op_id").alias("opId"), one("assert").alias("added"), one("retract").alias("removedClauses"), "trust")).alias("value"))
    lines.repartitionByRange("sequence").sortWithinPartitions("sequence").select("value").write.text(path)
    return journal.snapshot(journal.read_lines(spark, path)).select(F.col("sequence").cast("long").alias("sequence"), "clause", "trust")


@add("journal_problems", f"""WITH {_JOURNAL} SELECT sequence, 'retracts_nothing' AS problem FROM (SELECT *, lag(action) OVER (PARTITION BY clause ORDER BY sequence) AS before FROM j) WHERE action = 'retract' AND coalesce(before, 'retract') = 'retract'""")
def journal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.problems(event_journal(spark, sf_dir)).select("sequence", "problem")


@add("journal_drift", f"WITH {_JOURNAL} SELECT count(*) > 0 AS drift_found, false AS same_refused FROM ({_STATE.format(where='')}) WHERE action = 'assert'")
def journal_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether files that lack a clause are told from the journal's state, and its own state is not."""
    j = event_journal(spark, sf_dir)
    now = journal.snapshot(j)

    def refused(state: DataFrame) -> bool:
        try:
            journal.verify_journal(j, state)
        except journal.IncompleteHistoryError:
            return True
        return False

    least = now.agg(F.min("clause")).first()[0]
    return spark.createDataFrame([(refused(now.where(F.col("clause") != least)), refused(now))], "drift_found boolean, same_refused boolean")
