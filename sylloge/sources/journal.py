"""The journaled store of facts: an append-only log, and the states, histories and views that follow from it.

A journal is a DataFrame of single changes in the order (sequence, position):

    sequence long, position int, ts string, namespace string, op_id string, action string, clause string,
    source string, trust string, valid_until string

action is 'assert' or 'retract'; a supersession is a retract and an assert of one sequence, with valid_until on
the retract where the old fact is archived. Order is that of sequence, never of ts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compiler import Relation
from ..plans.engine import Engine
from ..plans.local import LimitError
from ..plans.syntax import Atom, Clause, DatalogError, Lit, Program, canonical, parse_program, parse_query, write, write_atom
from .scratch import hadoop, new_path, written

SCHEMA = "sequence long, position int, ts string, namespace string, op_id string, action string, clause string, source string, trust string, valid_until string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
MAX_EVENTS, MAX_BATCH = 1_000, 64
#: Terms, names and facts in canonical form.
_QUOTED = r"'[^']*+(?:''[^']*+)*+'"
_TERM = rf"(?:{_QUOTED}|[^',() ]++)"
_NAME = rf"(?:{_QUOTED}|[a-z][A-Za-z0-9_]*+)"
_FACT = rf"^{_NAME}(?:\({_TERM}(?:, {_TERM})*+\))?\.$"


class ConflictError(DatalogError):
    """An operation's id was used for another operation, or the state isn't the expected one."""


class IncompleteHistoryError(DatalogError):
    """The journal doesn't lead to the state that the files have."""


# -- states -------------------------------------------------------------------------------------------


def _last(journal: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("sequence"), F.desc("position"))
    return journal.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def snapshot(journal: DataFrame, sequence: int | None = None) -> DataFrame:
    """The journal's rows of clauses that are in force after a sequence number (0: none; None: the last one)."""
    if sequence is not None:
        journal = journal.where(F.col("sequence") <= sequence)
    return _last(journal, ["namespace", "clause"]).where("action = 'assert'")


def snapshots(journal: DataFrame, sequences: list[int]) -> DataFrame:
    """(as_of, ...): snapshot() of up to 64 sequence numbers in one pass."""
    if len(sequences) > MAX_BATCH:
        raise LimitError(f"more than {MAX_BATCH} snapshots")
    asked = F.explode(F.array(*(F.lit(int(s)).cast("long") for s in sorted(set(sequences))))).alias("as_of")
    rows = journal.select(asked, "*").where(F.col("sequence") <= F.col("as_of"))
    return _last(rows, ["as_of", "namespace", "clause"]).where("action = 'assert'")


def history(journal: DataFrame, pattern: str | None = None, namespace: str | None = None) -> DataFrame:
    """(sequence, position, namespace, ts, op_id, event, clause, valid_until, current): what happened, in order.

    event is asserted, retracted or superseded; current says that the clause is in force now. pattern is a
    literal whose predicate, constants and repeated variables a fact must match.
    """
    now = snapshot(journal).select("namespace", "clause").withColumn("current", F.lit(True))
    if namespace is not None:
        journal = journal.where(F.col("namespace") == namespace)
    if pattern is not None:
        journal = journal.where(clause_matches(pattern, F.col("clause")))
    replaced = F.max(F.when(F.col("action") == "assert", 1)).over(Window.partitionBy("namespace", "sequence")).isNotNull()
    event = F.when(F.col("action") == "assert", "asserted").when(replaced, "superseded").otherwise("retracted")
    rows = journal.withColumn("event", event).join(now, ["namespace", "clause"], "left")
    return rows.select("sequence", "position", "namespace", "ts", "op_id", "event", "clause", "valid_until", F.coalesce("current", F.lit(False)).alias("current"))


def history_events(journal: DataFrame, most: int = MAX_EVENTS, **options) -> list[dict]:
    got = history(journal, **options).orderBy("sequence", "position").limit(most + 1).collect()
    if len(got) > most:
        raise LimitError(f"more than {most} events")
    return [r.asDict() for r in got]


def clause_matches(pattern: str, clause: Column) -> Column:
    """Whether the text of a fact has the form of a literal: one regular expression, inside the JVM."""
    q = parse_query(pattern.rstrip(". "))
    if len(q.body) != 1 or not isinstance(q.body[0], Lit):
        raise DatalogError(f"{pattern} is no literal")
    lit = q.body[0]
    any_term = _TERM
    seen: dict[str, int] = {}
    parts = []
    for t in lit.args:
        if hasattr(t, "value"):
            parts.append(re.escape(write(t)))
        elif hasattr(t, "name") and t.name in seen:
            parts.append(f"\\{seen[t.name]}")
        elif hasattr(t, "name"):
            seen[t.name] = len(seen) + 1
            parts.append(f"({any_term})")
        else:
            parts.append(any_term)
    args = r"\(" + ", ".join(parts) + r"\)" if parts else ""
    return clause.rlike("^" + re.escape(write_atom(lit.name)) + args + r"\.$")


def provenance(journal: DataFrame) -> DataFrame:
    """(namespace, clause, op_id, ts, source, trust): the latest assertion of each clause in force."""
    return snapshot(journal).select("namespace", "clause", "op_id", "ts", "source", "trust")


def recorded_diff(journal: DataFrame, a: int, b: int) -> DataFrame:
    """(namespace, clause, change): added, removed or source_changed between two sequence numbers."""
    old, new = (snapshot(journal, s).select("namespace", "clause", F.struct("op_id", "source", "trust").alias(n)) for s, n in ((a, "old"), (b, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "source_changed")
    return old.join(new, ["namespace", "clause"], "full_outer").select("namespace", "clause", change.alias("change")).where("change IS NOT NULL")


def trust_view(journal: DataFrame, include_tentative: bool = False, sequence: int | None = None) -> DataFrame:
    now = snapshot(journal, sequence)
    return now if include_tentative else now.where("trust = 'accepted'")


def digests(state: DataFrame) -> DataFrame:
    """(namespace, clauses, digest): the number of clauses and a SHA-256 over theirs, whatever their order.

    Each clause is hashed where it lies, and the four 64-bit parts of the hashes are added up: nothing is collected.
    """
    hashed = state.select("namespace", "clause").distinct().withColumn("h", F.sha2("clause", 256))
    parts = [F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    sums = hashed.groupBy("namespace").agg(F.count("*").alias("clauses"), F.concat_ws(":", F.count("*"), *parts).alias("sums"))
    return sums.select("namespace", "clauses", F.sha2("sums", 256).alias("digest"))


def digest(state: DataFrame) -> str:
    """SHA-256 over digests(), a line for each namespace."""
    lines = sorted(f"{r['namespace']}:{r['digest']}" for r in digests(state).collect())
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def verify_journal(journal: DataFrame, files: DataFrame) -> None:
    """IncompleteHistoryError where the clauses of files (namespace, clause) aren't what the journal leads to."""
    now, files = snapshot(journal).select("namespace", "clause"), files.select("namespace", "clause").distinct()
    if not now.exceptAll(files).isEmpty() or not files.exceptAll(now).isEmpty():
        raise IncompleteHistoryError("the journal and the files differ")


# -- entity names -------------------------------------------------------------------------------------

MAX_ALIASES, MAX_POSITIONS = 10_000, 1_024


def resolve_aliases(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The final name of every alias; errors for an alias of itself, with two targets, or in a cycle."""
    if len(pairs) > MAX_ALIASES:
        raise LimitError(f"more than {MAX_ALIASES} aliases")
    to: dict[str, str] = {}
    for a, b in pairs:
        if a == b:
            raise DatalogError(f"{a} is an alias of itself")
        if to.setdefault(a, b) != b:
            raise DatalogError(f"{a} is an alias of {to[a]} and {b}")
    out = {}
    for a in to:
        path, x = [a], to[a]
        while x in to:
            if x in path:
                raise DatalogError(f"aliases go round: {' -> '.join([*path, x])}")
            path.append(x)
            x = to[x]
        out[a] = x
    return out


def canonicalize(facts: DataFrame, columns: list[str], aliases: dict[str, str]) -> DataFrame:
    """facts with aliases in some columns replaced by their final names, each row once."""
    if len(columns) > MAX_POSITIONS:
        raise LimitError(f"more than {MAX_POSITIONS} positions")
    if not aliases:
        return facts.distinct()
    spark, order = facts.sparkSession, facts.columns
    table = spark.createDataFrame(sorted(aliases.items()), "alias string, name string")
    for i, c in enumerate(columns):
        own = F.broadcast(table.select(F.col("alias").alias(f"__a{i}"), F.col("name").alias(f"__n{i}")))
        facts = facts.join(own, facts[c] == F.col(f"__a{i}"), "left").withColumn(c, F.coalesce(f"__n{i}", c)).drop(f"__a{i}", f"__n{i}")
    return facts.select(*order).distinct()


def identity_view(e: Engine, pairs: list[tuple[str, str]], positions: set[tuple[str, int, int]]) -> Engine:
    """The engine with final names in place of aliases, at the enabled (predicate, arity, place), places from 1.

    Only atoms are names: numbers stay. A place of p/n is one of its archive p_until/n+1 too. Facts of the program are
    renamed like rows; rules and constraints stay as they are.
    """
    aliases = resolve_aliases(pairs)
    if len(positions) > MAX_POSITIONS:
        raise LimitError(f"more than {MAX_POSITIONS} positions")
    for name, arity, place in positions:
        if not 1 <= place <= arity:
            raise DatalogError(f"{name}/{arity} has no place {place}")
    places: dict[tuple[str, int], set[int]] = {}
    for name, arity, place in positions:
        places.setdefault((name, arity), set()).add(place - 1)
        places.setdefault((name + "_until", arity + 1), set()).add(place - 1)
    out = e.copy()
    for key, at in places.items():
        if key in out.base:
            r = out.base[key]
            columns = [f"c{i}" for i in sorted(at) if r.kinds[i] == "str"]
            out.base[key] = Relation(canonicalize(r.df, columns, aliases), r.arity, True)
    renamed = lambda c, at: Lit(c.head.name, tuple(Atom(aliases.get(t.value, t.value)) if i in at and isinstance(t, Atom) else t for i, t in enumerate(c.head.args)))
    clauses = [Clause(renamed(c, places[c.head.key])) if c.is_fact and c.head.key in places else c for c in out.program.clauses]
    out.program = Program(list({canonical(c) if c.is_fact else i: c for i, c in enumerate(clauses)}.values()))
    return out


# -- clauses as relations -----------------------------------------------------------------------------

def engine_of(state: DataFrame, max_rules: int = 10_000) -> Engine:
    """An engine over the clauses of a state: facts as relations that are taken from their text inside the JVM, rules as its program.

    Only the predicates with the kinds of their places are collected, and the rules, of which more than max_rules are an error.
    """
    spark = state.sparkSession
    texts = state.select("clause").distinct()
    is_fact = F.col("clause").rlike(_FACT)
    rules = texts.where(~is_fact).limit(max_rules + 1).collect()
    if len(rules) > max_rules:
        raise LimitError(f"more than {max_rules} rules")
    name = F.regexp_extract("clause", f"^({_NAME})", 1)
    args = F.regexp_extract_all(F.expr("substring(clause, length(name) + 2)"), F.lit(rf"({_TERM})(?:, |\)\.$)"), 1)
    facts = texts.where(is_fact).withColumn("name", name).withColumn("args", args)
    number = lambda c: c.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    kinds = facts.select("name", F.size("args").alias("arity")).distinct().collect()
    e = Engine(spark).load([parse_program(r["clause"])[0] for r in rules])
    for r in sorted(kinds, key=lambda r: (r["name"], r["arity"])):
        if not r["arity"]:
            e.load(f"{r['name']}.")
            continue
        own, columns = facts.where((F.col("name") == r["name"]) & (F.size("args") == r["arity"])), []
        mixed = own.agg(*(F.countDistinct(number(F.get("args", F.lit(i)))).alias(f"c{i}") for i in range(r["arity"])), *(F.min(number(F.get("args", F.lit(i)))).alias(f"n{i}") for i in range(r["arity"]))).first()
        for i in range(r["arity"]):
            if mixed[f"c{i}"] > 1:
                raise DatalogError(f"{r['name']}/{r['arity']} has atoms and numbers in place {i + 1}")
            text = F.get("args", F.lit(i))
            bare = F.when(text.startswith("'"), F.replace(F.expr(f"substring(args[{i}], 2, length(args[{i}]) - 2)"), F.lit("''"), F.lit("'"))).otherwise(text)
            columns.append((text.cast("double") if mixed[f"n{i}"] else bare).alias(f"a{i + 1}"))
        own_name = r["name"] if not r["name"].startswith("'") else r["name"][1:-1].replace("''", "'")
        e.register(own_name, own.select(*columns), unique=True)
    return e


# -- the store ----------------------------------------------------------------------------------------


class Store:
    """A journal kept as Parquet under a path, one folder for each operation.

    Writers may run at the same time: the number of an operation is claimed by creating a file that must not exist, its rows are
    written aside, and it counts once its fate is decided, by another such file, and its folder has its name. A writer that finds a
    claim open waits, then abandons it; what was decided but not finished is finished by the next writer. An abandoned
    number stays empty. The file system must create files exclusively, as HDFS and local ones do.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, patience: float = 30.0):
        self.spark, self.path, self.patience = spark, path or new_path(spark, "journal"), patience
        self.folder, self.fs = hadoop(spark, self.path)

    # files

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _create(self, name: str, text: str) -> bool:
        """Whether the file was created; False where it exists."""
        if self.fs.getUri().getScheme() == "file":  # where create() first looks and then creates
            path = self._at(name).toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                with open(path, "x") as file:
                    file.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = self.fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if self.fs.exists(self._at(name)):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, name: str) -> str:
        file = self.fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()
        finally:
            file.close()

    # reading

    def folders(self) -> list[str]:
        """The folders that hold the journal now: segments, and operations after the last segment."""
        names = self._names()
        segments = [n for n in names if n.startswith("segment-")]
        covered = max((int(n.split("-")[2]) for n in segments), default=0)
        return segments + [n for n in names if n.startswith("seq-") and int(n[4:]) > covered]

    def journal(self) -> DataFrame:
        """The journal as it is now: operations that are written later don't show in what is read from it."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{n}" for n in folders))

    def state(self, sequence: int | None = None) -> DataFrame:
        return snapshot(self.journal().where("action <> 'operation'"), sequence)

    def last(self) -> int:
        """The number of the last operation."""
        return max((int(n.split("-")[-1]) for n in self.folders()), default=0)

    # writing

    def _finish(self, n: int) -> None:
        """What is left to do for an operation whose fate is decided."""
        name, began = f"{n:020d}", time.monotonic()
        while (text := self._text(f"_fate/{name}")).count("\n") < 2:  # created, but not yet filled
            if time.monotonic() - began > self.patience:
                return
            time.sleep(0.01)
        fate, key, _ = text.split("\n", 2)
        if fate == "committed" and self.fs.exists(self._at(f"_pending/{name}")):
            self._create(f"_ops/{key}", name)
            try:
                self.fs.rename(self._at(f"_pending/{name}"), self._at(f"seq-{name}"))
            except Py4JJavaError:  # another writer was faster
                if not self.fs.exists(self._at(f"seq-{name}")):
                    raise

    def _claim(self, key: str) -> int:
        """A number of its own, after all before it are finished or abandoned."""
        while True:
            taken = self._names("_taken")
            last = int(taken[-1]) if taken else self.last()
            began = time.monotonic()
            while taken and not self.fs.exists(self._at(f"_fate/{taken[-1]}")):
                if time.monotonic() - began > self.patience:
                    self._create(f"_fate/{taken[-1]}", f"abandoned\n{key}\n")
                time.sleep(0.05)
            if taken:
                self._finish(last)
            if self._create(f"_taken/{last + 1:020d}", key):
                return last + 1

    def _done(self, key: str, text: str, op_id: str) -> int | None:
        """The number of an operation that was written before."""
        if not self.fs.exists(self._at(f"_ops/{key}")):
            return None
        while not (text_of := self._text(f"_ops/{key}")):
            time.sleep(0.01)
        n = int(text_of)
        if self._text(f"_fate/{n:020d}").split("\n", 2)[2] != text:
            raise ConflictError(f"operation {op_id} was another one")
        return n

    def _append(self, op_id: str, request: dict, rows: Callable[[], list[DataFrame]], ts: str) -> int:
        """Writes an operation whole; an id that was used gives its number again.

        rows is called once no other writer can change the state: frames of (position, namespace, action, clause, source, trust, valid_until).
        """
        key = hashlib.sha256(op_id.encode()).hexdigest()[:32]
        text = json.dumps(request, sort_keys=True)
        if (done := self._done(key, text, op_id)) is not None:
            return done
        n = self._claim(key)
        name = f"{n:020d}"
        try:
            if (done := self._done(key, text, op_id)) is not None:
                self._create(f"_fate/{name}", f"abandoned\n{key}\n")
                return done
            whole = self.spark.createDataFrame([(n, -1, ts, "", op_id, "operation", text, None, None, None)], SCHEMA)
            for df in rows():
                own = df.select(F.lit(n).cast("long").alias("sequence"), F.col("position").cast("int").alias("position"), F.lit(ts).alias("ts"), "namespace", F.lit(op_id).alias("op_id"), *COLUMNS[5:])
                whole = whole.unionByName(own)
            whole.write.mode("overwrite").parquet(f"{self.path}/_pending/{name}")
        except BaseException:
            self._create(f"_fate/{name}", f"abandoned\n{key}\n")
            raise
        if not self._create(f"_fate/{name}", f"committed\n{key}\n{text}"):
            raise ConflictError(f"operation {op_id} took longer than another writer waits")
        self._finish(n)
        return n

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "position int, namespace string, action string, clause string, source string, trust string, valid_until string")

    def _in_force(self, namespace: str, condition: Column) -> DataFrame:
        """The clauses of a namespace that a condition selects: only their changes are sorted."""
        return snapshot(self.journal().where((F.col("namespace") == namespace) & (F.col("action") != "operation") & condition))

    def _new(self, namespace: str, clauses: list[str], source: str | None, trust: str, first: int = 0) -> DataFrame:
        """Assertions of the clauses that aren't in force."""
        rows = self._rows([(first + i, namespace, "assert", c, source, trust, None) for i, c in enumerate(clauses)])
        known = self._in_force(namespace, F.col("clause").isin(clauses)) if len(clauses) <= 1_000 else self._in_force(namespace, F.lit(True)).join(F.broadcast(rows.select("clause")), "clause", "left_semi")
        return rows.join(known.select("clause"), "clause", "left_anti").select(rows.columns)

    def assert_(self, namespace: str, program: str, op_id: str, ts: str, source: str | None = None, trust: str = "accepted") -> int:
        """Adds clauses that aren't there; the number of the operation."""
        clauses = list(dict.fromkeys(canonical(c) for c in parse_program(program)))
        return self._append(op_id, {"assert": clauses, "namespace": namespace, "trust": trust}, lambda: [self._new(namespace, clauses, source, trust)], ts)

    def load(self, namespace: str, facts: DataFrame, op_id: str, ts: str, source: str | None = None, trust: str = "accepted") -> int:
        """Adds the facts of a DataFrame with the columns (clause), in canonical form, that aren't there: nothing passes the driver."""
        bad = facts.where(F.col("clause").isNull() | ~F.col("clause").rlike(_FACT)).limit(1).collect()
        if bad:
            raise DatalogError(f"{bad[0]['clause']} is no fact in canonical form")

        def rows() -> list[DataFrame]:
            new = facts.select("clause").distinct().join(self._in_force(namespace, F.lit(True)).select("clause"), "clause", "left_anti")
            return [new.select(F.lit(0).alias("position"), F.lit(namespace).alias("namespace"), F.lit("assert").alias("action"), "clause", F.lit(source).alias("source"), F.lit(trust).alias("trust"), F.lit(None).cast("string").alias("valid_until"))]

        return self._append(op_id, {"load": op_id, "namespace": namespace, "trust": trust}, rows, ts)

    def _hit(self, namespace: str, pattern: str) -> DataFrame:
        """The clauses in force of a pattern, or the rule that is equal but for names of variables."""
        if ":-" in pattern:
            return self._in_force(namespace, F.col("clause") == canonical(parse_program(pattern)[0]))
        return self._in_force(namespace, clause_matches(pattern, F.col("clause")))

    def _gone(self, namespace: str, pattern: str, until: str | None = None) -> DataFrame:
        return self._hit(namespace, pattern).select(
            F.lit(0).alias("position"), F.lit(namespace).alias("namespace"), F.lit("retract").alias("action"), "clause",
            F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("trust"), F.lit(until).cast("string").alias("valid_until"),
        )

    def retract(self, namespace: str, pattern: str, op_id: str, ts: str) -> int:
        """Removes the facts of a pattern, or the rule that is equal but for names of variables."""
        return self._append(op_id, {"retract": pattern, "namespace": namespace}, lambda: [self._gone(namespace, pattern)], ts)

    def supersede(self, namespace: str, pattern: str, program: str, op_id: str, ts: str, archive: bool = True, source: str | None = None) -> int:
        """Replaces the facts of a pattern; archive keeps each as p_until(args..., ts)."""
        new = list(dict.fromkeys(canonical(c) for c in parse_program(program)))

        def rows() -> list[DataFrame]:
            fresh = [(1 + i, namespace, "assert", c, source, "accepted", None) for i, c in enumerate(new)]
            out = [self._gone(namespace, pattern, ts if archive else None), self._rows(fresh)]
            if archive:
                lit = parse_query(pattern.rstrip(". ")).body[0]
                name, old = write_atom(lit.name), write_atom(lit.name + "_until")
                inner = F.expr(f"substring(clause, {len(name) + 2}, length(clause) - {len(name) + 3})") if lit.args else None
                end = write(Atom(ts)) + ")."
                text = F.concat(F.lit(old + "("), inner, F.lit(", " + end)) if lit.args else F.lit(old + "(" + end)
                out.append(self._gone(namespace, pattern).select(
                    F.lit(1 + len(new)).alias("position"), "namespace", F.lit("assert").alias("action"), text.alias("clause"), F.lit(source).cast("string").alias("source"),
                    F.lit("accepted").alias("trust"), F.lit(None).cast("string").alias("valid_until"),
                ))
            return out

        return self._append(op_id, {"supersede": pattern, "by": program, "archive": archive, "namespace": namespace}, rows, ts)

    def replace(self, namespace: str, pattern: str, program: str, op_id: str, ts: str, source: str | None = None) -> int:
        return self.supersede(namespace, pattern, program, op_id, ts, archive=False, source=source)

    def exchange(self, namespace: str, without: list[str], program: str, op_id: str, ts: str, source: str | None = None) -> int:
        """Removes clauses, which must be in force, and adds those of a program."""
        old, new = [canonical(parse_program(c)[0]) for c in without], list(dict.fromkeys(canonical(c) for c in parse_program(program)))

        def rows() -> list[DataFrame]:
            gone = self._in_force(namespace, F.col("clause").isin(old)).select("clause")
            if gone.count() < len(set(old)):
                raise ConflictError("a clause to remove is not in force")
            return [self._rows([(0, namespace, "retract", c, None, None, None) for c in dict.fromkeys(old)]), self._new(namespace, new, source, "accepted", 1)]

        return self._append(op_id, {"without": old, "with": new, "namespace": namespace}, rows, ts)

    def resolve_tentative(self, namespace: str, clause: str, accept: bool, op_id: str, ts: str) -> int:
        """A tentative clause becomes accepted, or goes."""
        c = canonical(parse_program(clause)[0])

        def rows() -> list[DataFrame]:
            now = self._in_force(namespace, F.col("clause") == c).first()
            if now is None or now["trust"] != "tentative":
                raise ConflictError(f"{c} is not tentative")
            return [self._rows([(0, namespace, "retract", c, None, None, None)] + ([(1, namespace, "assert", c, None, "accepted", None)] if accept else []))]

        return self._append(op_id, {"resolve": c, "accept": accept, "namespace": namespace}, rows, ts)

    def tentative(self) -> DataFrame:
        return self.state().where("trust = 'tentative'")

    def program(self, namespaces: list[str] | None = None, include_tentative: bool = False, sequence: int | None = None, most: int = 100_000) -> list[Clause]:
        """The clauses in force, in the order they were stated; an error for more than most. engine_of() takes states of any size."""
        df = trust_view(self.journal().where("action <> 'operation'"), include_tentative, sequence)
        if namespaces is not None:
            df = df.where(F.col("namespace").isin(namespaces))
        got = df.orderBy("sequence", "position", "clause").select("clause").limit(most + 1).collect()
        if len(got) > most:
            raise LimitError(f"more than {most} clauses")
        return [parse_program(r["clause"])[0] for r in got]

    # checkpoints and segments

    def checkpoint(self) -> dict:
        """Writes the state in force as a table beside the journal: {sequence, path, digest}; later reads may start there."""
        n = self.last()
        path = f"{self.path}/_checkpoint/{n:020d}"
        state = self.state(n)
        state.write.mode("overwrite").parquet(path)
        out = {"sequence": n, "path": path, "digest": digest(state)}
        self.fs.delete(self._at(f"_checkpoints/{n:020d}"), False)
        self._create(f"_checkpoints/{n:020d}", json.dumps(out))
        return out

    def checkpoints(self) -> list[dict]:
        """What checkpoint() gave, oldest first."""
        return [json.loads(self._text(f"_checkpoints/{n}")) for n in self._names("_checkpoints")]

    def since(self, checkpoint: dict) -> DataFrame:
        """The journal as a checkpoint and what came after; verified by the checkpoint's digest."""
        base = self.spark.read.schema(SCHEMA).parquet(checkpoint["path"])
        if digest(base) != checkpoint["digest"]:
            raise IncompleteHistoryError("the checkpoint's rows are not those it was made of")
        return base.union(self.journal().where((F.col("sequence") > checkpoint["sequence"]) & (F.col("action") != "operation")).select(*COLUMNS))

    def rotate(self, files: int | None = None) -> str | None:
        """Puts the operations so far into one segment of few files, in order; the folders that it replaces stay until purge().

        The segment counts once it has its name, and its rows are compared with the operations' before that.
        """
        names = [n for n in self.folders() if n.startswith("seq-")]
        if not names:
            return None
        first, last = int(names[0][4:]), int(names[-1][4:])
        df = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{n}" for n in names))
        df = df.repartitionByRange(files, "sequence") if files else df.repartitionByRange("sequence")
        name = f"segment-{first:020d}-{last:020d}"
        df.sortWithinPartitions("sequence", "position").write.mode("overwrite").parquet(f"{self.path}/_pending/{name}")
        back = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/_pending/{name}")
        mark = [F.count("*"), F.sum(F.xxhash64(*COLUMNS).cast("decimal(38,0)"))]
        if tuple(back.agg(*mark).first()) != tuple(df.agg(*mark).first()):
            raise IncompleteHistoryError("the segment's rows are not those of its operations")
        self.fs.rename(self._at(f"_pending/{name}"), self._at(name))
        return name

    def purge(self) -> int:
        """Deletes the folders of operations that segments hold, once nothing reads them; how many."""
        kept = set(self.folders())
        gone = [n for n in self._names() if n.startswith("seq-") and n not in kept]
        for n in gone:
            self.fs.delete(self._at(n), True)
        return len(gone)


# -- journals of other stores --------------------------------------------------------------------------

LINES = "ts string, op string, namespace string, opId string, added array<string>, removedClauses array<string>, sourceText string, trust string, validUntil string"
OPERATIONS = ("assert", "retract", "replace", "supersede")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The journal in files of JSON lines, as changes: the files in the order of their names, a number for each line.

    A line holds (ts, op, namespace, opId, added, removedClauses) and perhaps sourceText, trust and validUntil. A line that isn't
    such an object, or has an operation that isn't known, is an error that names the line. Large files are read by several tasks,
    each a block; a line's number is that of its block's first line and its place in the block, so no file is in one task's memory.
    """
    block = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    # written, as the places of lines hold for one pass only
    lines = written(spark.read.text(path, lineSep="\n").select(*block, F.monotonically_increasing_id().alias("id"), F.col("value").alias("text")), "lines")
    sizes = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")).orderBy("file", "block").limit(100_001).collect()
    if len(sizes) > 100_000:
        raise LimitError("more than 100,000 files or blocks of files")
    before, rows = 0, []
    for r in sizes:
        rows.append((r["file"], r["block"], before - r["first"]))
        before += r["n"]
    start = spark.createDataFrame(rows, "file string, block long, before long")
    df = lines.join(F.broadcast(start), ["file", "block"]).select((F.col("before") + F.col("id") + 1).alias("sequence"), "text", F.from_json("text", LINES).alias("x"))
    fine = F.col("x.op").isin(*OPERATIONS) & F.col("x.namespace").isNotNull() & F.col("x.opId").isNotNull() & F.col("x.ts").isNotNull() & F.coalesce("x.added", "x.removedClauses").isNotNull()
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("sequence"), F.lit(" of the journal is no entry: "), F.coalesce(F.col("text"), F.lit("")))).cast("long"))
    many = lambda c, action, first: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t, i: F.struct((i + first).cast("int").alias("position"), F.lit(action).alias("action"), t.alias("clause")))
    each = df.select(checked.alias("sequence"), "x", F.explode(F.concat(many("x.removedClauses", "retract", 0), many("x.added", "assert", F.coalesce(F.size("x.removedClauses"), F.lit(0))))).alias("c"))
    return each.select(
        "sequence", "c.position", "x.ts", "x.namespace", F.col("x.opId").alias("op_id"), "c.action", "c.clause", F.when(F.col("c.action") == "assert", F.col("x.sourceText")).alias("source"),
        F.when(F.col("c.action") == "assert", F.coalesce("x.trust", F.lit("accepted"))).alias("trust"), F.when(F.col("c.action") == "retract", F.col("x.validUntil")).alias("valid_until"),
    )


def problems(journal: DataFrame) -> DataFrame:
    """(sequence, op_id, problem): what a journal may not hold: fields missing, changes of an operation in two numbers, changes that change nothing."""
    missing = F.col("sequence").isNull() | F.col("position").isNull() | F.col("namespace").isNull() | F.col("op_id").isNull() | F.col("clause").isNull() | ~F.coalesce(F.col("action").isin("assert", "retract", "operation"), F.lit(False))
    a = journal.where(missing).select("sequence", "op_id", F.lit("incomplete").alias("problem"))
    changes = journal.where(~missing & (F.col("action") != "operation"))
    b = changes.groupBy("op_id").agg(F.min("sequence").alias("sequence"), F.max("sequence").alias("other")).where("sequence <> other").select("sequence", "op_id", F.lit("operation_twice").alias("problem"))
    before = F.lag("action").over(Window.partitionBy("namespace", "clause").orderBy("sequence", "position"))
    c = changes.withColumn("before", before).where("action = 'retract' AND (before IS NULL OR before = 'retract')").select("sequence", "op_id", F.lit("retracts_nothing").alias("problem"))
    return a.union(b).union(c)
