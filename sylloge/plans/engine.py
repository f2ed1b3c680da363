"""The engine: relations by predicate, rules over them, and queries answered as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, LongType, StructField

from ..sources.scratch import new_path, written
from .compiler import Compiler, Relation, all_of, kind_of, planned_bytes, unify
from .local import LimitError, Local, Work, fact_text
from .stratify import Key, groups, reachable, recursive
from .syntax import Arith, Clause, Cmp, DatalogError, Lit, Not, Num, Program, Query, Var, Wild, goal_vars, parse_program, parse_query, write_atom

#: Rows of all relations that a recursive group reads up to which it is derived on the driver.
LOCAL_ROWS = 10_000
#: Bytes, as Catalyst estimates them, from which a relation that every round reads is put in buckets; smaller ones are broadcast.
KEPT_BYTES = 10 << 20


#: Bounds of native programs: rules, relations they read, their rows, rounds, rows looked at, and depth of a proof.
NATIVE_RULES, NATIVE_RELATIONS, NATIVE_ROWS, NATIVE_ROUNDS, NATIVE_STEPS, NATIVE_DEPTH = 16, 32, 100_000, 1_000, 10_000_000, 128
#: Bounds of relations that register_portable() takes, and the largest integer in them.
PORTABLE_ROWS, PORTABLE_BYTES, PORTABLE_INT = 100_000, 16 << 20, 2**53 - 1


def _portable(name: str, f: StructField) -> Column:
    c = F.col(f.name)
    wrong = lambda what: F.raise_error(F.lit(f"{name}.{f.name} {what}")).cast(f.dataType)
    out = F.when(c.isNull(), wrong("is null"))
    if isinstance(f.dataType, (DoubleType, FloatType)):
        out = out.when(F.isnan(c) | (F.abs(c) == float("inf")), wrong("is not finite"))
    elif isinstance(f.dataType, LongType):
        out = out.when(~c.between(-PORTABLE_INT, PORTABLE_INT), wrong("is beyond the integers that a double holds"))
    return out.otherwise(c).alias(f.name)


class _Compiler(Compiler):
    def __init__(self, spark: SparkSession, lookup, most_rows: int | None = None):
        super().__init__(lookup, most_rows)
        self.spark = spark

    def _unit(self) -> DataFrame:
        return self.spark.range(1).select()


def _joined(group: list[Key], rules: list[Clause]) -> dict[Key, int]:
    """Relations outside a recursive group that its rules join with one of it on one column, always the same: {relation: place}."""
    found: dict[Key, set[int | None]] = {}
    for r in rules:
        lits = [g for g in r.body if isinstance(g, Lit)]
        if not any(g.key in group for g in lits):
            continue
        for g in lits:
            if g.key not in group:
                others = {v for x in lits if x is not g for v in goal_vars(x)}
                at = [i for i, t in enumerate(g.args) if isinstance(t, Var) and t.name in others]
                found.setdefault(g.key, set()).add(at[0] if len(lits) == 2 and len(at) == 1 else None)
    return {k: next(iter(at)) for k, at in found.items() if len(at) == 1 and None not in at}


def _closes(group: list[Key], rules: list[Clause]) -> Key | None:
    """The relation whose transitive closure a recursive group is, in whatever order its rules join; None where the rules say anything else."""
    base: set[Key] = set()
    steps: set[Key] = set()
    for r in rules:
        if r.aggregate or not all(isinstance(g, Lit) for g in r.body) or not all(isinstance(t, Var) for g in (r.head, *r.body) for t in g.args):
            return None
        head, *ways = [tuple(t.name for t in g.args) for g in (r.head, *r.body)]
        if any(len(x) != 2 for x in (head, *ways)) or head[0] == head[1]:
            return None
        if len(ways) == 1 and ways[0] == head:
            base.add(r.body[0].key)
        elif len(ways) == 2 and any(a == (head[0], b[0]) and b == (b[0], head[1]) and b[0] not in head for a, b in (ways, ways[::-1])):
            steps |= {g.key for g in r.body}
        else:
            return None
    return next(iter(base)) if len(group) == 1 and len(base) == 1 and group[0] in steps and not base & set(group) and steps <= {*group, *base} else None


def _facts(spark: SparkSession, key: Key, clauses: list[Clause]) -> Relation:
    rows = list(dict.fromkeys(tuple(t.value for t in c.head.args) for c in clauses))
    if not key[1]:
        return Relation(spark.range(1).select(F.lit(True).alias("unit")), 0, True)
    columns = []
    for i in range(key[1]):
        values = [r[i] for r in rows]
        kinds = {isinstance(v, str) for v in values}
        if len(kinds) > 1:
            raise DatalogError(f"{key[0]}/{key[1]} has atoms and numbers in place {i + 1}")
        whole = kinds == {False} and all(v == int(v) and abs(v) < 2**53 for v in values)
        columns.append(pa.array(map(int, values) if whole else values, pa.string() if kinds == {True} else pa.int64() if whole else pa.float64()))
    return Relation(spark.createDataFrame(pa.Table.from_arrays(columns, [f"c{i}" for i in range(key[1])])), key[1], True)


class Engine:
    """max_facts and max_rounds bound derivations, max_aggregate_rows the solutions that an aggregate is of; a passed bound is an error."""

    def __init__(self, spark: SparkSession, max_rounds: int = 10_000, max_facts: int | None = None, local_rows: int = LOCAL_ROWS, max_aggregate_rows: int | None = None):
        self.spark, self.max_rounds, self.max_facts, self.local_rows, self.max_aggregate_rows = spark, max_rounds, max_facts, local_rows, max_aggregate_rows
        self.base: dict[Key, Relation] = {}
        self.columns: dict[Key, list[str]] = {}
        self.program = Program()

    # relations and rules

    def register(self, name: str, df: DataFrame, unique: bool = False, keys: tuple[str, ...] = ()) -> Engine:
        """df's rows as facts of name, by place. unique: no row occurs twice; keys: columns whose values no two rows share."""
        key = (name, len(df.columns))
        relation = Relation.of(df, unique, tuple(df.columns.index(c) for c in keys) if keys else None)
        if key in self.base:
            relation = Relation(unify(name, [self.base[key].df, relation.df]), key[1])
        self.base[key], self.columns[key] = relation, df.columns
        return self

    def register_table(self, name: str, path: str, unique: bool = False, keys: tuple[str, ...] = ()) -> Engine:
        return self.register(name, self.spark.read.parquet(path), unique, keys)

    def register_portable(self, name: str, df: DataFrame, most_rows: int | None = PORTABLE_ROWS, most_bytes: int | None = PORTABLE_BYTES) -> Engine:
        """register() for values that any engine of these semantics reads alike: text and numbers that a double holds exactly.

        Columns of other types are an error at once; more rows or bytes (of the values as text) than the bounds too (None: no bound). A null,
        a number that is not finite or an integer beyond 2**53 - 1 ends the query that reads it.
        """
        if any(f.name in df.columns[:i] for i, f in enumerate(df.schema.fields)):
            raise DatalogError(f"{name} has a column twice")
        for f in df.schema.fields:
            if kind_of(f.dataType) not in ("num", "str") or isinstance(f.dataType, DecimalType):
                raise DatalogError(f"{name}.{f.name} holds {f.dataType.simpleString()}, which has no portable form")
        size = F.lit(0)
        for c in df.columns:
            size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
        some = df if most_rows is None else df.limit(most_rows + 1)
        n, total = (0, 0) if most_rows is most_bytes is None else some.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
        if most_rows is not None and n > most_rows or most_bytes is not None and total > most_bytes:
            raise LimitError(f"{name} has more than {most_rows} rows or {most_bytes} bytes")
        return self.register(name, df.select(*(_portable(name, f) for f in df.schema.fields)))

    def catalogue(self) -> DataFrame:
        """(predicate, arity, place, name, type) of the registered relations; places count from 1."""
        rows = [(k[0], k[1], i + 1, n, t) for k, r in self.base.items() for i, (n, (_, t)) in enumerate(zip(self.columns[k], r.df.dtypes))]
        return self.spark.createDataFrame(rows, "predicate string, arity int, place int, name string, type string")

    def load(self, program: str | Program | Iterable[Clause]) -> Engine:
        clauses = parse_program(program) if isinstance(program, str) else program.clauses if isinstance(program, Program) else list(program)
        self.program = Program([*self.program.clauses, *clauses])
        return self

    def copy(self) -> Engine:
        out = Engine(self.spark, self.max_rounds, self.max_facts, self.local_rows, self.max_aggregate_rows)
        out.base, out.columns, out.program = dict(self.base), dict(self.columns), Program(list(self.program.clauses))
        return out

    # derivation

    def derive(self, wanted: set[Key] | None = None) -> dict[Key, Relation]:
        """The relations of wanted predicates and of those they rest on; of all, if None."""
        rules = self.program.rules
        groups(rules)  # an error in any rule, asked for or not
        if wanted is not None:
            need = reachable(wanted, rules)
            rules = [r for r in rules if r.head.key in need]
        db = dict(self.base)
        by_key: dict[Key, list[Clause]] = {}
        for c in self.program.facts:
            by_key.setdefault(c.head.key, []).append(c)
        for key, clauses in by_key.items():
            if wanted is None or key in need:
                own = _facts(self.spark, key, clauses)
                db[key] = Relation(unify(key[0], [db[key].df, own.df]), key[1]) if key in db else own
        compiler = _Compiler(self.spark, db.get, self.max_aggregate_rows)
        for group in groups(rules):
            own = [r for r in rules if r.head.key in group]
            if recursive(group, rules):
                db.update(self._fixpoint(group, own, db))
                continue
            key = group[0]
            frames = [compiler.rule(r) for r in own]
            if key in db:
                frames.insert(0, db[key].df)
            unique = len(frames) == 1 and compiler.distinct
            df = unify(key[0], frames)
            db[key] = Relation(df if unique else df.distinct(), key[1], True)
            if self.max_facts is not None and db[key].df.limit(self.max_facts + 1).count() > self.max_facts:
                raise LimitError(f"{key[0]}/{key[1]} has more than {self.max_facts} facts")
        return db

    def _fixpoint(self, group: list[Key], rules: list[Clause], db: dict[Key, Relation]) -> dict[Key, Relation]:
        small = self._fixpoint_small(group, rules, db)
        if small is None:
            small = self._fixpoint_closure(group, rules, db)
        return small if small is not None else self._fixpoint_spark(group, rules, db)

    def _fixpoint_small(self, group: list[Key], rules: list[Clause], db: dict[Key, Relation]) -> dict[Key, Relation] | None:
        """On the driver, if what the rules read is within local_rows, what follows from it within five times as many, and all of it exact there; else None."""
        reads = {k for r in rules for g in r.body for k in ([g.key] if isinstance(g, Lit) else [g.lit.key] if isinstance(g, Not) else [])} | set(group)
        left, rows = self.local_rows, {}
        if left <= 0:
            return None
        for key in sorted(reads):
            if key not in db:
                continue
            if any(k not in ("num", "str") for k in db[key].kinds) or any(isinstance(f.dataType, DecimalType) for f in db[key].df.schema.fields):
                return None
            if not key[1]:
                rows[key] = [] if db[key].df.isEmpty() else [()]
                continue
            longs = [f.name for f in db[key].df.schema.fields if isinstance(f.dataType, LongType)]
            large = F.lit(False)  # integers that a double doesn't hold exactly
            for c in longs:
                large = large | ~F.col(c).between(-PORTABLE_INT, PORTABLE_INT)
            values = [F.col(c).cast("double") if k == "num" else F.col(c) for c, k in zip(db[key].df.columns, db[key].kinds)]
            got = db[key].df.select(*values, large.alias("large")).limit(left + 1).toArrow()
            left -= got.num_rows
            if left < 0 or any(c.null_count for c in got.columns) or any(got["large"].to_pylist()):
                return None
            got = got.drop_columns(["large"])
            rows[key] = list(zip(*(c.to_pylist() for c in got.columns)))
        try:
            done = Local(rules, rows, max_facts=5 * self.local_rows, max_rounds=self.max_rounds)
        except LimitError:
            return None
        if self.max_facts is not None and any(len(done.relation(k).rows) > self.max_facts for k in group):
            raise LimitError(f"more than {self.max_facts} facts")
        out = {}
        types = self._types(group, rules, db)
        for key in group:
            got = list(done.relation(key).rows)
            if not key[1]:
                out[key] = Relation(self.spark.range(len(got[:1])).select(F.lit(True).alias("unit")), 0, True)
                continue
            columns = []
            for i, t in enumerate(types[key]):
                values = [r[i] for r in got]
                if len({isinstance(v, str) for v in values}) > 1:
                    raise DatalogError(f"{key[0]} has values of different types in one place")
                columns.append(pa.array(values, pa.string() if t == "string" else pa.float64()))
            table = pa.Table.from_arrays(columns, [f"c{i}" for i in range(key[1])])
            df = self.spark.createDataFrame(table)
            out[key] = Relation(df.select(*(F.col(c).cast(t).alias(c) for c, t in zip(df.columns, types[key]))), key[1], True)
        return out

    def _types(self, group: list[Key], rules: list[Clause], db: dict[Key, Relation]) -> dict[Key, list[str]]:
        """Column types of a recursive group's predicates, from the rules that can be started."""
        return {k: [t for _, t in r.df.dtypes] for k, r in self._seeds(group, rules, db).items()}

    def _seeds(self, group: list[Key], rules: list[Clause], db: dict[Key, Relation]) -> dict[Key, Relation]:
        """What facts and the rules give without recursion, with types that hold for all rules; empty where nothing starts."""
        seeds = {k: db[k] for k in group if k in db}
        compiler = _Compiler(self.spark, {**db, **seeds}.get)
        for r in rules:
            if not any(isinstance(g, Lit) and g.key in group for g in r.body):
                df = compiler.rule(r)
                k = r.head.key
                seeds[k] = Relation(unify(k[0], [seeds[k].df, df]) if k in seeds else df, k[1])
        while True:  # types of predicates that only recursive rules define, and wider number types
            compiler = _Compiler(self.spark, lambda k: seeds.get(k, db.get(k)))
            changed = False
            for r in rules:
                k = r.head.key
                if any(isinstance(g, Lit) and g.key in group and g.key not in seeds for g in r.body):
                    continue
                nothing = compiler.rule(r).where(F.lit(False))
                new = unify(k[0], [seeds[k].df, nothing]) if k in seeds else nothing
                if k not in seeds or [t for _, t in new.dtypes] != [t for _, t in seeds[k].df.dtypes]:
                    seeds[k] = Relation(new, k[1])
                    changed = True
            if not changed:
                break
        for k in group:
            if k not in seeds:
                names = [f"c{i}" for i in range(k[1])] or ["unit"]
                seeds[k] = Relation(self.spark.range(0).select(*(F.lit(None).cast("string").alias(c) for c in names)), k[1])
        return seeds

    def _fixpoint_closure(self, group: list[Key], rules: list[Clause], db: dict[Key, Relation]) -> dict[Key, Relation] | None:
        """The closure of a relation in which no value of one place has two of the other and that has no cycle; else None.

        Its ways of up to 2n steps are those of up to n, and those behind the end of a way of n. Each pair is found once,
        so nothing is compared with what was found before, and rounds are as many as doublings of the longest way. Pairs
        lie in buckets by the place that determines the other, in which no value has more of them than steps.
        """
        of = _closes(group, rules)
        if of is None or of not in db or group[0] in db or self.max_facts is not None:
            return None
        base = db[of].distinct()
        types = {f.dataType.simpleString() for f in base.df.schema.fields}
        if len(types) > 1 or not types <= {"tinyint", "smallint", "int", "bigint", "string", "date", "timestamp"}:
            return None
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        tables: list[str] = []

        def stored(df: DataFrame) -> tuple[DataFrame, int]:
            """Pairs (a, b) in sorted buckets by a, and how many they are."""
            path, seen = new_path(self.spark, "ways"), Observation()
            name = "sylloge_" + path.rsplit("-", 1)[1]
            tables.append(name)
            df = df.select("a", "b").repartition(buckets, "a").observe(seen, F.count(F.lit(1)).alias("rows"))  # above the exchange, which is left out where it turns out empty
            df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "a").sortBy("a").saveAsTable(name)
            return self.spark.table(name), seen.get["rows"]

        def after(ways: DataFrame, more: DataFrame) -> DataFrame:
            return ways.toDF("a", "via").join(more.toDF("at", "b"), F.col("via") == F.col("at")).select("a", "b")

        try:
            swapped = base.key == (1,)
            first = stored(base.df.toDF("b", "a") if swapped else base.df.toDF("a", "b"))[0]
            if base.key not in ((0,), (1,)) and not first.groupBy("a").count().where("count > 1").isEmpty():
                if not first.groupBy("b").count().where("count > 1").isEmpty():
                    return None
                swapped, first = True, stored(first.toDF("b", "a"))[0]
            ends = [first]  # of ways of 1, 2, 4, ... steps
            while True:
                if 2 ** len(ends) > self.max_rounds:  # a cycle, or a way that may pass the bound
                    return None
                further, n = stored(after(ends[-1], ends[-1]))
                if not n:
                    break
                ends.append(further)
            found = [first]
            for ways in ends[:-1]:
                found.append(stored(reduce(DataFrame.union, [after(ways, x) for x in found]))[0])
            # the longest ways aren't stored: nothing follows them
            pairs = reduce(DataFrame.union, [*found, *(after(ends[-1], x) for x in found)])
            schema = self._seeds(group, rules, db)[group[0]].df.schema
            return {group[0]: Relation(pairs.toDF(*(("c1", "c0") if swapped else ("c0", "c1"))).select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)), 2, True)}
        finally:
            for name in tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay

    def _fixpoint_spark(self, group: list[Key], rules: list[Clause], db: dict[Key, Relation]) -> dict[Key, Relation]:
        """Semi-naive rounds; each round's new rows are written to the shared folder, which ends their lineage.

        A predicate's rows are in one table, with a partition for each round and in buckets by their hash: a round's candidates
        go to the buckets, are made distinct and compared there with what earlier rounds found, which stays where it is.
        """
        seeds = self._seeds(group, rules, db)
        schemas = {k: r.df.schema for k, r in seeds.items()}
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        paths = {k: new_path(self.spark, "rounds") for k in group}
        names = {k: "sylloge_" + paths[k].rsplit("-", 1)[1] for k in group}
        made: set[Key] = set()
        tables: list[str] = []
        sizes = dict.fromkeys(group, 0)

        def hashed(df: DataFrame) -> DataFrame:
            # 32 bits are half of what doesn't compress; rows that share them are told apart by their columns
            return df.withColumn("h", F.hash(*df.columns)).repartition(buckets, "h").distinct()

        def kept(r: Relation, at: int) -> Relation:
            """A relation in buckets by the column that every round joins it on: it is shuffled once."""
            path = new_path(self.spark, "kept")
            tables.append("sylloge_" + path.rsplit("-", 1)[1])
            r.df.repartition(buckets, f"c{at}").write.format("parquet").option("path", path).bucketBy(buckets, f"c{at}").saveAsTable(tables[-1])
            return Relation(self.spark.table(tables[-1]).select(*r.df.columns), r.arity, key=r.key)

        def store(k: Key, df: DataFrame, n: int) -> bool:
            """Whether df had rows; they are written as those of round n."""
            seen = Observation()
            df = df.withColumn("round", F.lit(n)).observe(seen, F.count(F.lit(1)).alias("rows"))
            df.write.mode("append").format("parquet").option("path", paths[k]).partitionBy("round").bucketBy(buckets, "h").saveAsTable(names[k])
            made.add(k)
            sizes[k] += seen.get["rows"]
            if self.max_facts is not None and sizes[k] > self.max_facts:
                raise LimitError(f"{k[0]}/{k[1]} has more than {self.max_facts} facts")
            return seen.get["rows"] > 0

        def rows(k: Key, n: int | None = None) -> Relation:
            df = self.spark.table(names[k]) if n is None else self.spark.table(names[k]).where(F.col("round") == n)
            return Relation(df.select(*schemas[k].names), k[1], True)

        try:
            for key, at in _joined(group, rules).items():
                if key in db and planned_bytes(db[key].df) > KEPT_BYTES:
                    db = {**db, key: kept(db[key], at)}
            delta = {k for k in group if store(k, hashed(seeds[k].df), 0)}
            for n in range(1, self.max_rounds + 1):
                if not delta:
                    whole = {k: self.spark.read.schema(schemas[k]).parquet(paths[k]).select(*schemas[k].names) if sizes[k] else self.spark.createDataFrame([], schemas[k]) for k in group}
                    return {k: Relation(df, k[1], True) for k, df in whole.items()}
                now = {**db, **{k: rows(k) for k in group}}
                news = {k: rows(k, n - 1) for k in delta}
                compiler = _Compiler(self.spark, now.get)
                found: dict[Key, list[DataFrame]] = {}
                for r in rules:
                    for at, g in enumerate(r.body):
                        if isinstance(g, Lit) and g.key in delta:
                            found.setdefault(r.head.key, []).append(compiler.rule(r, {at: news[g.key]}))
                delta = set()
                for k, frames in found.items():
                    df = unify(k[0], frames)
                    df = hashed(df.select(*(F.col(c).cast(f.dataType).alias(c) for c, f in zip(df.columns, schemas[k].fields))))
                    old = self.spark.table(names[k]).select(F.col("h").alias("old_h"), *(F.col(c).alias(f"old_{c}") for c in schemas[k].names))
                    # the columns are compared so that only the hash is a join key, by which both sides lie in buckets
                    mine, theirs = [F.col(c) for c in schemas[k].names], [F.col(f"old_{c}") for c in schemas[k].names]
                    same = F.struct(*mine, *theirs).eqNullSafe(F.struct(*theirs, *mine))
                    if store(k, df.join(old, (F.col("h") == F.col("old_h")) & same, "left_anti"), n):
                        delta.add(k)
            raise LimitError(f"more than {self.max_rounds} rounds")
        finally:
            for name in (*(names[k] for k in made), *tables):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay

    # answers

    def query(self, text: str | Query, limit: int | None = None) -> DataFrame:
        """The answers, each once; a column for each variable. A query without variables has one row without columns if it holds."""
        q = parse_query(text) if isinstance(text, str) else text
        keys = {g.key if isinstance(g, Lit) else g.lit.key for g in q.body if not isinstance(g, Cmp)}
        self._arities(q)
        db = self.derive(keys)
        compiler = _Compiler(self.spark, db.get, self.max_aggregate_rows)
        if q.aggregate:
            return compiler.aggregated(q.aggregate, q.body, []).toDF(q.aggregate.out)
        bound = compiler.body(q.body, set(q.columns))
        if not q.columns:
            return bound.df.limit(1).select()
        df = bound.df.select(*(bound.col(v).alias(v) for v in q.columns))
        df = df if bound.distinct_on(q.columns) else df.distinct()
        return df if limit is None else df.limit(limit)

    def _arities(self, q: Query) -> None:
        known = {k for k in self.base} | {c.head.key for c in self.program.clauses if c.head}
        names = {k[0]: k[1] for k in known}
        for g in q.body:
            lit = g if isinstance(g, Lit) else g.lit if isinstance(g, Not) else None
            if lit and lit.key not in known and lit.name in names and lit.name in {k[0] for k in self.base}:
                raise DatalogError(f"{lit.name} has {names[lit.name]} columns, not {len(lit.args)}")

    def rows(self, text: str | Query, most: int = 10_000) -> list[dict]:
        """Collected answers; an error for more than most."""
        got = self.query(text).limit(most + 1).collect()
        if len(got) > most:
            raise LimitError(f"more than {most} rows")
        return [r.asDict() for r in got]

    def holds(self, text: str | Query) -> bool:
        return not self.query(text).isEmpty()

    def materialize(self) -> dict[Key, DataFrame]:
        """Every predicate's rows with a last column derived: whether only rules give the row."""
        db, given = self.derive(), {**self.base}
        for key in {c.head.key for c in self.program.facts}:
            own = _facts(self.spark, key, [c for c in self.program.facts if c.head.key == key])
            given[key] = Relation(unify(key[0], [given[key].df, own.df]), key[1]) if key in given else own
        out = {}
        for key, r in db.items():
            df = r.distinct().df
            if key not in given:
                out[key] = df.withColumn("derived", F.lit(True))
            elif not any(c.head.key == key for c in self.program.rules):
                out[key] = df.withColumn("derived", F.lit(False))
            else:
                mark = given[key].distinct().df.withColumn("given", F.lit(True))
                out[key] = df.join(mark, df.columns, "left").select(*df.columns, F.col("given").isNull().alias("derived"))
        return out

    def fact_key(self, name: str, columns: list[str]) -> F.Column:  # type: ignore[name-defined]
        return F.to_json(F.array(F.lit(name), *(F.col(c).cast("string") for c in columns)))

    def proof_edges(self, rule: int) -> DataFrame:
        """(derived, rule, place, input): what every solution of a rule (counted from 1) rests on, as JSON keys of facts."""
        c = self.program.rules[rule - 1]
        named, k = [], 0
        for g in c.body:  # wildcards get names, so that inputs are whole facts
            if isinstance(g, Lit):
                args = []
                for t in g.args:
                    k += isinstance(t, Wild)
                    args.append(Var(f"_w{k}") if isinstance(t, Wild) else t)
                named.append(Lit(g.name, tuple(args)))
            else:
                named.append(g)
        keys = {g.key if isinstance(g, Lit) else g.lit.key for g in c.body if not isinstance(g, Cmp)}
        compiler = _Compiler(self.spark, self.derive(keys).get)
        bound = compiler.body(tuple(named), {v for g in named for v in goal_vars(g)})

        def piece(t):
            c = bound.col(t.name) if isinstance(t, Var) else F.lit(t.value)
            if isinstance(t, Var) and bound.kind(t.name) == "num":  # nothing to escape
                return F.coalesce(F.concat(F.lit('"'), c.cast("string"), F.lit('"')), F.lit("null"))
            whole = F.to_json(F.array(c.cast("string")))
            return F.substring(whole, F.lit(2), F.length(whole) - 2)

        def key(lit: Lit):
            name = F.to_json(F.array(F.lit(lit.name)))
            pieces = [x for t in lit.args for x in (F.lit(","), piece(t))]
            return F.concat(F.substring(name, F.lit(1), F.length(name) - 1), *pieces, F.lit("]"))

        inputs = F.array(*(F.struct(F.lit(i + 1).alias("place"), key(g).alias("input")) for i, g in enumerate(named) if isinstance(g, Lit)))
        head = c.head if not c.aggregate else Lit(c.head.name, tuple(t for t in c.head.args if not (isinstance(t, Var) and t.name == c.aggregate.out)))
        edges = bound.df.select(key(head).alias("derived"), F.lit(rule).alias("rule"), F.inline(inputs))
        # an edge names the values of the head and of its input: where solutions differ in them, edges do
        shown = [{t.name for x in (head, lit) for t in x.args if isinstance(t, Var)} for lit in named if isinstance(lit, Lit)]
        apart = all(bound.distinct_on(vs) and all(bound.kind(v) in ("num", "str") for v in vs) for vs in shown)
        return edges if apart else edges.distinct()

    def materialize_proved(self, max_facts: int = 100_000, **bounds) -> DataFrame:
        """(predicate, fact, derived, proof): every fact with its first proof as JSON; an error for more than max_facts facts."""
        done = self.local(max_facts=max_facts)
        rows = [
            (f"{k[0]}/{k[1]}", fact_text(k[0], row), row not in done.base.get(k, ()), json.dumps(done.proof((k, row), **bounds), sort_keys=True))
            for k, r in done.db.items() for row in r.rows
        ]
        return self.spark.createDataFrame(rows, "predicate string, fact string, derived boolean, proof string")

    def _native(self, text: str, work: Work | None = None) -> tuple[Clause, Local]:
        """The program text, of rules with one head, over the registered relations within the native bounds."""
        if self.execution_mode(text) != "native":
            raise DatalogError("a native program has rules with one head predicate, without negation, aggregates, arithmetic and constraints")
        rules = [c for c in parse_program(text) if c.is_rule]
        names = [t.name for t in rules[0].head.args if isinstance(t, Var)]
        if len(rules) > NATIVE_RULES or len(names) < len(rules[0].head.args) or len(set(names)) < len(names):
            raise DatalogError(f"a native program has at most {NATIVE_RULES} rules, and different variables in its first head")
        read = {g.key for r in rules for g in r.body if isinstance(g, Lit)} - {rules[0].head.key}
        if missing := read - set(self.base):
            raise DatalogError(f"no table {sorted(missing)[0][0]}")
        if len(read) > NATIVE_RELATIONS:
            raise LimitError(f"more than {NATIVE_RELATIONS} relations")
        e = Engine(self.spark, NATIVE_ROUNDS)
        e.base = {k: self.base[k] for k in read}
        rows = e.local(max_facts=NATIVE_ROWS).db
        return rules[0], Local(rules, {k: r.rows for k, r in rows.items()}, max_facts=2 * NATIVE_ROWS, max_rounds=NATIVE_ROUNDS, max_steps=NATIVE_STEPS, work=work)

    def native_query(self, text: str) -> str:
        """The head's rows as a JSON array of objects, of at most PORTABLE_BYTES; the rules' bounds are the NATIVE_ ones."""
        return self._native_json(text, False)

    def native_explain(self, text: str) -> str:
        """native_query() with proofs: [{row: {variable: value}, proof: {predicate, values, rule, because: [...]}}]; facts of tables have no rule."""
        return self._native_json(text, True)

    def _native_json(self, text: str, explain: bool) -> str:
        first, done = self._native(text)
        head, shown = first.head, lambda v: int(v) if isinstance(v, float) and v.is_integer() and abs(v) <= PORTABLE_INT else v

        def proof(ref, depth: int = 0) -> dict:
            if depth > NATIVE_DEPTH:
                raise LimitError(f"a proof is deeper than {NATIVE_DEPTH}")
            (name, _), row = ref
            why = done.relation(ref[0]).rows[row]
            out = {"predicate": name, "values": [shown(v) for v in row]}
            return out if why is None else out | {"rule": done.numbers[why[0]], "because": [proof(r, depth + 1) for r in why[1]]}

        out = []
        for row in done.relation(head.key).rows:
            named = {t.name: shown(v) for t, v in zip(head.args, row)}
            out.append({"row": named, "proof": proof((head.key, row))} if explain else named)
        found = json.dumps(out, separators=(",", ":"), ensure_ascii=False)
        if len(found.encode()) > PORTABLE_BYTES:
            raise LimitError(f"more than {PORTABLE_BYTES} bytes")
        return found

    def local(self, text: str | Query | None = None, max_facts: int = 100_000, work: Work | None = None) -> Local:
        """The program in the driver's memory with what the query needs: for proofs. An error for more than max_facts."""
        keys = None
        if text is not None:
            q = parse_query(text) if isinstance(text, str) else text
            keys = reachable({g.key if isinstance(g, Lit) else g.lit.key for g in q.body if not isinstance(g, Cmp)}, self.program.rules)
        left, rows = max_facts, {}
        for key, r in self.base.items():
            if keys is None or key in keys:
                got = r.distinct().df.limit(left + 1).collect()
                left -= len(got)
                if left < 0:
                    raise LimitError(f"more than {max_facts} facts")
                rows[key] = [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in x) for x in got] if key[1] else [()] * bool(got)
        clauses = [c for c in self.program.clauses if c.head and (keys is None or c.head.key in keys)]
        numbers = [i + 1 for i, c in enumerate(self.program.rules) if keys is None or c.head.key in keys]
        return Local(clauses, rows, max_facts=max_facts, numbers=numbers, work=work)

    def explain(self, text: str | Query, **bounds) -> list[tuple[dict, list]]:
        """Rows with the first proof of each goal, over at most 100,000 facts."""
        q = parse_query(text) if isinstance(text, str) else text
        return self.local(q).proved(q, **bounds)

    def rules_used(self, text: str | Query) -> set[int]:
        """The numbers of the rules in the first proofs of the answers, over facts in any number: they stay in tables.

        A fact has, beside its values, the rules of its first proof: that of the first round, then of the first rule, that gives it.
        Of several solutions the one with the least rules counts; which is found first has no meaning in a table.
        """
        q = parse_query(text) if isinstance(text, str) else text
        need = reachable({g.key if isinstance(g, Lit) else g.lit.key for g in q.body if not isinstance(g, Cmp)}, self.program.rules)
        rules = [(i + 1, r) for i, r in enumerate(self.program.rules) if r.head.key in need]
        nothing, mark = F.array().cast("array<int>"), "\0"
        names = lambda k: [f"c{j}" for j in range(k[1])]
        state: dict[Key, DataFrame] = {}
        for k in need:
            own = [c for c in self.program.facts if c.head.key == k]
            frames = ([self.base[k].df] if k in self.base else []) + ([_facts(self.spark, k, own).df] if own else [])
            if frames:
                state[k] = unify(k[0], frames).select(*names(k), nothing.alias("used"))

        def look(k: Key) -> Relation | None:
            df = state.get((k[0][1:], k[1] - 1)) if k[0][:1] == mark else state.get(k)
            return None if df is None else Relation.of(df if k[0][:1] == mark else df.drop("used"))

        def solved(goals: tuple, keep: set[str], bag: bool = False):
            """The solutions, with the rules that each rests on; None where a predicate has no rows."""
            lits = [i for i, g in enumerate(goals) if isinstance(g, Lit)]
            if any(goals[i].key not in state for i in lits):
                return None
            marked = tuple(Lit(mark + g.name, (*g.args, Var(f"{mark}{i}"))) if i in lits else g for i, g in enumerate(goals))
            compiler = _Compiler(self.spark, look, self.max_aggregate_rows)
            bound = compiler.body(marked, keep | {f"{mark}{i}" for i in lits}, bag=bag)
            return compiler, bound, F.array_sort(F.array_distinct(F.flatten(F.array(nothing, *(bound.col(f"{mark}{i}") for i in lits)))))

        def heads(i: int, r: Clause) -> DataFrame | None:
            a = r.aggregate
            keys = list(dict.fromkeys(t.name for t in r.head.args if isinstance(t, Var) and not (a and t.name == a.out)))
            got = solved(r.body, set(keys) | ({a.arg} if a and a.arg else set()), bool(a))
            own = F.array(F.lit(i))
            if got is None:
                if not a or a.op != "count" or keys:
                    return None
                df = self.spark.range(1).select(*((F.lit(0).cast("long") if isinstance(t, Var) else F.lit(t.value)).alias(n) for n, t in zip(names(r.head.key), r.head.args)), own.alias("used"))
                return df.withColumn("at", F.lit(i))
            compiler, bound, used = got
            if not a:
                return bound.df.select(*(compiler._term(t, bound).alias(n) for n, t in zip(names(r.head.key), r.head.args)), F.array_sort(F.array_union(used, own)).alias("used"), F.lit(i).alias("at"))
            df = bound.df.groupBy(*(bound.col(k).alias(f"k{j}") for j, k in enumerate(keys))).agg(compiler._value(a, bound).alias("value"), F.flatten(F.collect_set(used)).alias("used")).where("value IS NOT NULL")
            place = {k: f"k{j}" for j, k in enumerate(keys)} | {a.out: "value"}
            terms = (F.col(place[t.name]) if isinstance(t, Var) else compiler._term(t, None) for t in r.head.args)
            return df.select(*(t.alias(n) for n, t in zip(names(r.head.key), terms)), F.array_sort(F.array_union("used", own)).alias("used"), F.lit(i).alias("at"))

        for group in groups([r for _, r in rules]):
            own, again = [(i, r) for i, r in rules if r.head.key in group], recursive(group, [r for _, r in rules])
            for n in range(self.max_rounds + 1):
                if n == self.max_rounds:
                    raise LimitError(f"more than {self.max_rounds} rounds")
                new: dict[Key, DataFrame] = {}
                for k in group:
                    if frames := [df for i, r in own if r.head.key == k and (df := heads(i, r)) is not None]:
                        df = unify(k[0], frames).groupBy(*names(k)).agg(F.min(F.struct("at", "used")).alias("why")).where("why IS NOT NULL").select(*names(k), "why.used")
                        if k in state:
                            old = state[k].select(*(F.col(c).alias(f"old_{c}") for c in names(k)), F.lit(True).alias("old"))
                            df = df.join(old, all_of([F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in names(k)]), "left_anti")
                        new[k] = written(df, "proved") if again else df
                new = {k: df for k, df in new.items() if not again or not df.isEmpty()}
                state.update({k: unify(k[0], [state[k], df]) if k in state else df for k, df in new.items()})
                if not again or not new:
                    break
        got = solved(q.body, set(q.columns))
        if got is None:
            return set()
        _, bound, used = got
        first = bound.df.groupBy(*(bound.col(v) for v in q.columns)).agg(F.min(used).alias("used"))
        return {r[0] for r in first.select(F.explode("used")).distinct().collect()}

    def execution_mode(self, text: str) -> str:
        """'native' for rules of one head predicate without negation, aggregates, arithmetic and constraints; else 'portable'."""
        if ":-" not in text:
            return "portable"
        clauses = parse_program(text)
        if any(c.is_constraint or c.aggregate or any(isinstance(g, Not) or isinstance(g, Cmp) and (isinstance(g.left, Arith) or isinstance(g.right, Arith)) for g in c.body) for c in clauses):
            return "portable"
        return "native" if len({c.head.key for c in clauses if c.is_rule}) == 1 else "portable"

    def to_sql(self, text: str, mark: str = '"') -> str:
        """One rule of positive literals and comparisons as a SELECT over the registered tables, names between marks."""
        rules = parse_program(text)
        if len(rules) != 1 or not rules[0].is_rule or rules[0].aggregate:
            raise DatalogError("one rule is needed")
        rule, where, seen, tables, late = rules[0], [], {}, [], []
        quote = lambda x: mark + x.replace(mark, mark * 2) + mark
        constant = lambda t: write_number(t.value) if isinstance(t, Num) else "'" + t.value.replace("'", "''") + "'"
        for g in rule.body:
            if isinstance(g, Not):
                raise DatalogError("negation has no such form")
            if isinstance(g, Cmp):
                late.append(g)
                continue
            if g.key not in self.columns:
                raise DatalogError(f"no table {write_atom(g.name)} with {len(g.args)} columns")
            alias = f"t{len(tables)}"
            tables.append(f"{quote(g.name)} AS {alias}")
            for t, c in zip(g.args, self.columns[g.key]):
                ref = f"{alias}.{quote(c)}"
                if isinstance(t, Var) and t.name not in seen:
                    seen[t.name] = ref
                elif isinstance(t, Var):
                    where.append(f"{ref} = {seen[t.name]}")
                elif not isinstance(t, Wild):
                    where.append(f"{ref} = {constant(t)}")
        side = lambda e: seen[e.name] if isinstance(e, Var) else constant(e)
        for g in late:
            if isinstance(g.left, Arith) or isinstance(g.right, Arith):
                raise DatalogError("arithmetic has no such form")
            where.append(f"{side(g.left)} {g.op} {side(g.right)}")
        if any(not isinstance(t, Var) for t in rule.head.args) or len(set(rule.head.args)) < len(rule.head.args):
            raise DatalogError("the head must be distinct variables")
        head = ", ".join(f"{seen[t.name]} AS {quote(t.name)}" for t in rule.head.args)
        shown = set(rule.head.args)
        relations = [(g, self.base[g.key]) for g in rule.body if isinstance(g, Lit)]
        # rows differ where the head has a key of each table
        apart = all(r.key is not None and all(not isinstance(g.args[i], Wild) and (not isinstance(g.args[i], Var) or g.args[i] in shown) for i in r.key) for g, r in relations)
        return f"SELECT {'' if apart else 'DISTINCT '}{head} FROM {', '.join(tables)}" + (f" WHERE {' AND '.join(where)}" if where else "")


def write_number(value: float) -> str:
    from .syntax import write_num

    return write_num(value)
