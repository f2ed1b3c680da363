"""Goals compiled to DataFrames: joins, anti joins, filters and aggregates that Catalyst then plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .local import LimitError
from .stratify import Key
from .syntax import Aggregate, Arith, Atom, Clause, Cmp, DatalogError, Expr, Goal, Lit, Not, Num, Var, Wild, expr_vars, goal_vars, write


def kind_of(t: T.DataType) -> str:
    """'num', 'str', 'time' or, for anything else, the type's own name: such values are only equal or not."""
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return t.simpleString()


@dataclass
class Relation:
    """A predicate's rows in columns c0, c1, ...; a predicate without arguments has the column unit.

    unique says that no row occurs twice, which spares a shuffle; key has places whose values no two rows share.
    """

    df: DataFrame
    arity: int
    unique: bool = False
    key: tuple[int, ...] | None = None

    def __post_init__(self):
        if self.key is None and self.unique:
            self.key = tuple(range(self.arity))
        self.unique = self.key is not None

    @classmethod
    def of(cls, df: DataFrame, unique: bool = False, key: tuple[int, ...] | None = None) -> Relation:
        return cls(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), len(df.columns), unique, key)

    @property
    def kinds(self) -> list[str]:
        return [kind_of(f.dataType) for f in self.df.schema.fields[: self.arity]]

    def distinct(self) -> Relation:
        return self if self.unique else Relation(self.df.distinct(), self.arity, True)


@dataclass
class Bound:
    """The solutions so far: a column and a kind for each variable.

    key: variables whose values no two rows share; None where rows may repeat. at: a column by its name.
    """

    df: DataFrame | None
    vars: dict[str, tuple[str, str]]
    key: frozenset[str] | None = frozenset()
    at: Callable[[str], Column] = F.col

    def joined(self, own: dict[str, tuple[str, str]], key: frozenset[str] | None) -> None:
        """key after a join with rows that have the variables own and the key key."""
        if self.key is None or key is None:
            self.key = None
        elif key <= self.vars.keys():
            pass  # each row meets one row at most
        elif self.key <= own.keys():
            self.key = key
        else:
            self.key |= key

    def distinct_on(self, names: Iterable[str]) -> bool:
        """Whether the rows differ in these variables."""
        return self.key is not None and self.key <= set(names)

    def col(self, name: str) -> Column:
        return self.at(self.vars[name][0])

    def kind(self, name: str) -> str:
        return self.vars[name][1]


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True)) if conds else F.lit(True)


def _constant(t: Atom | Num, kind: str) -> Column | None:
    """The constant as a value of that kind; None where nothing of the kind equals it."""
    if isinstance(t, Num):
        if kind != "num":
            return None
        return F.lit(int(t.value)) if t.value == int(t.value) and abs(t.value) < 2**53 else F.lit(t.value)
    if kind == "time":
        return F.try_to_timestamp(F.lit(t.value))
    return F.lit(t.value) if kind == "str" else None


def _operand(e: Expr, bound: Bound) -> tuple[Column, str]:
    if isinstance(e, Var):
        return bound.col(e.name), bound.kind(e.name)
    return (F.lit(e.value), "num") if isinstance(e, Num) else (F.lit(e.value), "str")


def failure(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("double")


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c).when(c.isNull(), c).otherwise(failure("a result is not finite"))


def arithmetic(e: Expr, bound: Bound) -> Column:
    """The value as a double; an error in a row that divides by zero, has an atom or passes the doubles."""
    if not isinstance(e, Arith):
        c, kind = _operand(e, bound)
        return c.cast("double") if kind == "num" else F.when(c.isNotNull(), failure(f"{write(e)} is no number"))
    a = [arithmetic(x, bound) for x in e.args]
    if e.op == "neg":
        return -a[0]
    if e.op == "pos":
        return a[0]
    if e.op == "/":
        below = _finite(a[1]) if isinstance(e.args[1], Arith) else a[1]
        return F.when(below == 0, failure("division by zero")).otherwise(a[0] / below)
    return {"+": a[0] + a[1], "-": a[0] - a[1], "*": a[0] * a[1]}[e.op]


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def comparison(g: Cmp, bound: Bound) -> Column:
    """Values of different kinds are unequal and without order."""
    if isinstance(g.left, Arith) or isinstance(g.right, Arith):
        sides = [_finite(arithmetic(e, bound)) if isinstance(e, Arith) else arithmetic(e, bound) for e in (g.left, g.right)]
        return _OPS[g.op](*sides)
    (a, ka), (b, kb) = _operand(g.left, bound), _operand(g.right, bound)
    if ka != kb and "time" in (ka, kb) and "str" in (ka, kb) and not (isinstance(g.left, Var) and isinstance(g.right, Var)):
        a, b = (F.try_to_timestamp(x) if k == "str" else x for x, k in ((a, ka), (b, kb)))
        ka = kb = "time"
    if ka != kb:
        return F.lit(g.op == "!=")
    return _OPS[g.op](a, b)


#: Bytes, as Catalyst estimates them, of a table that may be broadcast; of two tables multiplied, from which their join is spread; rows of a chunk and of a block.
BROADCAST_BYTES, SPREAD_BYTES, CHUNK_ROWS, BLOCK_ROWS = 32 << 20, 10**9, 256, 512
#: Rows for each value, on an average, from which chunks are of rows with equal values; types in which equal values are the same.
SHARED, GROUPED = 8, (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def planned_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _spreads(a: DataFrame, b: DataFrame) -> bool | None:
    """Whether b is the side to broadcast, False if it is a; None where the join stays as it is."""
    na, nb = planned_bytes(a), planned_bytes(b)
    if na * nb < SPREAD_BYTES or min(na, nb) > BROADCAST_BYTES or not a.columns or not b.columns:
        return None
    return nb <= na


def spread(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides of a join in which many rows meet many: few values or small files would leave all of it to few tasks.

    Where the smaller side can be broadcast, the rows of the other are dealt out to all tasks, whatever their values.
    """
    second = _spreads(a, b)
    if second is None:
        return a, b
    return (a.repartition(_tasks(a)), F.broadcast(b)) if second else (F.broadcast(a), b.repartition(_tasks(b)))


def cross(a: DataFrame, b: DataFrame, tests: Callable[[Callable[[str], Column]], list[Column]] = lambda at: [], read: Iterable[str] = ()) -> DataFrame:
    """The pairs that meet tests, which give conditions from columns by name and read those in read; large products are spread, and made by tiles.

    A tile pairs a block of one side's rows with a chunk of the other's; the rows of a chunk share what tests read, where many do, so
    tests look at a row and a chunk. What a task writes has the same values again and again at short distances, which files hold
    in a small part of the bytes that pairs row by row take; it holds a block and a chunk at a time, however many pairs there are.
    """
    second = _spreads(a, b)
    if second is None:
        return reduce(DataFrame.where, tests(F.col), a.crossJoin(b))
    small, large = (b, a) if second else (a, b)
    by, read = [c for c in small.columns if c in read], set(read)
    if any(not isinstance(small.schema[c].dataType, GROUPED) or small.schema[c].dataType.simpleString().startswith("string ") for c in by):
        by = []
    if by:
        n, values = small.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*by))).first()
        by = by if n >= SHARED * values else []
    grouped = bool(by) or not read.intersection(small.columns)
    rest = [c for c in small.columns if c not in by]
    few = F.struct(*rest) if rest else F.struct(F.lit(True).alias("__one"))
    own = small.withColumn("__i", F.monotonically_increasing_id())
    own = own.withColumn("__i", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("__i")) - 1) / CHUNK_ROWS))
    chunks = own.groupBy(*by, "__i").agg(F.collect_list(few).alias("__few")).drop("__i")
    # in order, so that a task that is run again has the same blocks
    dealt = large.repartition(_tasks(large)).sortWithinPartitions(*sorted(large.columns, key=lambda c: c not in read))
    dealt = dealt.select(F.struct(*large.columns).alias("__row"), F.floor(F.monotonically_increasing_id() / BLOCK_ROWS).alias("__block"))
    blocks = dealt.groupBy("__block").agg(F.collect_list("__row").alias("__rows")).drop("__block").repartition(_tasks(large))
    # lambdas end a stage of generated code, which would hold all that follows from a row in memory
    tiles = blocks.join(F.broadcast(chunks), F.exists("__rows", lambda r: r.isNotNull() & (F.size("__few") > 0)))
    fine = (lambda r: all_of(tests(lambda c: r[c] if c in large.columns else F.col(c)))) if grouped else (lambda r: r.isNotNull())
    rows = tiles.select(*by, "__few", F.inline(F.filter("__rows", fine)))
    each = F.explode(F.col("__few")[rest[0]]).alias(rest[0]) if len(rest) == 1 else F.inline("__few")
    pairs = rows.select(*by, *large.columns, each).select(*a.columns, *b.columns)
    return pairs if grouped else reduce(DataFrame.where, tests(F.col), pairs)


def _equates(g: Cmp, a: dict, b: dict) -> bool:
    """Whether a comparison says that a value of one side's variables equals one of the other's: such pairs are found by their values."""
    left, right = (set(expr_vars(e)) for e in (g.left, g.right))
    return g.op == "=" and bool(left and right) and (left <= a.keys() and right <= b.keys() or left <= b.keys() and right <= a.keys())


class Compiler:
    """lookup gives the relation of a predicate, or None for one without rows; most_rows bounds the solutions that an aggregate is of."""

    def __init__(self, lookup: Callable[[Key], Relation | None], most_rows: int | None = None):
        self.lookup, self.most_rows, self.n, self.distinct = lookup, most_rows, 0, False

    def _scan(self, lit: Lit, bag: bool, relation: Relation | None) -> tuple[DataFrame | None, dict[str, tuple[str, str]]]:
        """The rows that a literal alone selects, with a column for each of its variables."""
        if relation is None:
            return None, {}
        if bag:
            relation = relation.distinct()
        df, names, conds = relation.df, {}, []
        for i, (t, kind) in enumerate(zip(lit.args, relation.kinds)):
            c = F.col(f"c{i}")
            if isinstance(t, Wild):
                continue
            if isinstance(t, Var):
                if t.name in names:
                    conds.append(c == F.col(names[t.name][0]) if kind == names[t.name][1] else F.lit(False))
                else:
                    names[t.name] = (f"c{i}", kind)
                continue
            value = _constant(t, kind)
            conds.append(F.lit(False) if value is None else c == value)
        if conds:
            df = df.where(all_of(conds))
        self.n += 1
        out = {v: (f"g{self.n}_{c}", kind) for v, (c, kind) in names.items()}
        return df.select(*(F.col(c).alias(out[v][0]) for v, (c, _) in names.items())), out

    def _key(self, lit: Lit, bag: bool, relation: Relation | None) -> frozenset[str] | None:
        """The variables of a literal whose values no two rows of its scan share, if there are such."""
        if relation is None:
            return frozenset()
        key = relation.key if relation.key is not None else tuple(range(relation.arity)) if bag else None
        if key is None or any(isinstance(lit.args[i], Wild) for i in key):
            return None
        return frozenset(lit.args[i].name for i in key if isinstance(lit.args[i], Var))

    def body(self, goals: tuple[Goal, ...], needed: set[str], bag: bool = False, given: dict[int, Relation] | None = None) -> Bound:
        """The solutions of goals, as many rows as solutions if bag; needed: variables used afterwards.

        given replaces the relation of the literal at a place (the delta of a recursive rule). A literal
        that binds nothing needed later becomes a semi join, unless solutions are counted.
        """
        bound, tested = Bound(None, {}), 0
        for i, g in enumerate(goals):
            if i < tested:
                continue
            if isinstance(g, Cmp):
                if bound.df is None and not list(goal_vars(g)):
                    bound.df = self._unit()
                bound.df = bound.df.where(comparison(g, bound))
                continue
            lit = g.lit if isinstance(g, Not) else g
            relation = given[i] if given and i in given else self.lookup(lit.key)
            if isinstance(g, Not):
                self._negate(bound, lit, relation)
                continue
            df, own = self._scan(lit, bag, relation)
            key = self._key(lit, bag, relation)
            if df is None:
                own = {v: (f"none{i}_{v}", "str") for v in goal_vars(lit)}
                df = self._unit().where(F.lit(False)).select(*(F.lit(None).cast("string").alias(c) for c, _ in own.values()))
            if bound.df is None:
                bound.df, bound.vars, bound.key = df, own, key
                continue
            shared = [v for v in own if v in bound.vars]
            conds = [bound.col(v) == F.col(own[v][0]) if bound.kind(v) == own[v][1] else F.lit(False) for v in shared]
            later = needed | {v for x in goals[i + 1 :] for v in goal_vars(x)}
            fresh = [v for v in own if v not in bound.vars]
            if not bag and not any(v in later for v in fresh):
                bound.df = bound.df.join(df, all_of(conds), "left_semi") if shared else bound.df.join(df.limit(1).select(F.lit(True).alias(f"any{i}")), F.lit(True), "left_semi")
                continue
            follow, both = list(takewhile(lambda x: isinstance(x, Cmp), goals[i + 1 :])), {**bound.vars, **own}
            if not shared and given is None and not any(_equates(x, bound.vars, own) for x in follow):
                tests = lambda at: [comparison(x, Bound(None, both, at=at)) for x in follow]  # noqa: B023, E731
                bound.df = cross(bound.df, df, tests, {both[v][0] for x in follow for v in goal_vars(x)})
                tested = i + 1 + len(follow)
            elif not shared:
                bound.df = bound.df.crossJoin(df)
            else:
                sides = bound.df, df
                many = (key is None or not key <= bound.vars.keys()) and (bound.key is None or not bound.key <= own.keys())
                if many and given is None:
                    sides = spread(*sides)
                bound.df = sides[0].join(sides[1], all_of(conds), "inner")
            bound.joined(own, key)
            bound.vars |= {v: own[v] for v in fresh}
            keep = [c for c, _ in bound.vars.values()]
            bound.df = bound.df.select(*keep)
        if bound.df is None:
            bound.df = self._unit()
        return bound

    def _unit(self) -> DataFrame:
        raise NotImplementedError

    def _negate(self, bound: Bound, lit: Lit, relation: Relation | None) -> None:
        if relation is None:
            return
        df, own = self._scan(lit, False, relation)
        if bound.df is None:
            bound.df = self._unit()
        conds = [bound.col(v) == F.col(c) if bound.kind(v) == k else F.lit(False) for v, (c, k) in own.items()]
        if conds:
            bound.df = bound.df.join(df, all_of(conds), "left_anti")
        else:
            bound.df = bound.df.join(df.limit(1).select(F.lit(True).alias("any")), F.lit(True), "left_anti")

    # heads

    def rule(self, c: Clause, given: dict[int, Relation] | None = None) -> DataFrame:
        """The head's rows, with repetitions unless self.distinct then says that there are none."""
        if c.aggregate:
            self.distinct = True
            return self._aggregate_rule(c)
        needed = {t.name for t in c.head.args if isinstance(t, Var)}
        bound = self.body(c.body, needed, given=given)
        self.distinct = not c.head.args or bound.distinct_on(needed)
        if not c.head.args:
            return bound.df.limit(1).select(F.lit(True).alias("unit"))
        return bound.df.select(*(self._term(t, bound).alias(f"c{i}") for i, t in enumerate(c.head.args)))

    def _term(self, t: Term, bound: Bound) -> Column:  # noqa: F821
        return bound.col(t.name) if isinstance(t, Var) else _constant(t, "num" if isinstance(t, Num) else "str")

    def _value(self, a: Aggregate, bound: Bound) -> Column:
        if a.op == "count":
            return F.count(F.lit(1)).cast("long")
        c, kind = bound.col(a.arg), bound.kind(a.arg)
        if a.op == "sum":
            if kind != "num":
                return F.max(F.when(c.isNotNull(), failure(f"{a.arg} can't be summed")))
            total = F.sum(c)
            return _finite(total) if dict(bound.df.dtypes)[bound.vars[a.arg][0]] in ("double", "float") else total
        return F.min(c) if a.op == "min" else F.max(c)

    def aggregated(self, a: Aggregate, goals: tuple[Goal, ...], keys: list[str]) -> DataFrame:
        """A row for each group with columns k0, k1, ... and value; without keys one row, or none where the aggregate has no value."""
        bound = self.body(goals, set(keys) | ({a.arg} if a.arg else set()), bag=True)
        if self.most_rows is not None and bound.df.limit(self.most_rows + 1).count() > self.most_rows:
            raise LimitError(f"an aggregate is of more than {self.most_rows} solutions")
        value = self._value(a, bound).alias("value")
        if keys:
            return bound.df.groupBy(*(bound.col(k).alias(f"k{i}") for i, k in enumerate(keys))).agg(value)
        out = bound.df.agg(value)
        return out if a.op == "count" else out.where("value IS NOT NULL")

    def _aggregate_rule(self, c: Clause) -> DataFrame:
        keys = list(dict.fromkeys(t.name for t in c.head.args if isinstance(t, Var) and t.name != c.aggregate.out))
        df = self.aggregated(c.aggregate, c.body, keys)
        place = {k: f"k{i}" for i, k in enumerate(keys)} | {c.aggregate.out: "value"}
        return df.select(*((F.col(place[t.name]) if isinstance(t, Var) else self._term(t, None)).alias(f"c{i}") for i, t in enumerate(c.head.args)))


def unify(name: str, frames: list[DataFrame]) -> DataFrame:
    """The union of a predicate's rules; numbers of different types become doubles."""
    if len(frames) == 1:
        return frames[0]
    out = []
    types = list(zip(*([f.dataType for f in df.schema.fields] for df in frames)))
    for df in frames:
        columns = []
        for c, ts in zip(df.columns, types):
            if len({kind_of(t) for t in ts if not isinstance(t, T.NullType)}) > 1:
                raise DatalogError(f"{name} has values of different types in one place")
            if len(set(map(str, ts))) == 1:
                columns.append(F.col(c))
            elif all(isinstance(t, T.IntegralType) for t in ts):
                columns.append(F.col(c).cast("long").alias(c))
            else:
                columns.append(F.col(c).cast("double" if kind_of(ts[0]) == "num" else ts[0]).alias(c))
        out.append(df.select(*columns))
    return reduce(DataFrame.union, out)


__all__ = ["Atom", "Bound", "Compiler", "Relation", "all_of", "comparison", "expr_vars", "kind_of", "unify"]
