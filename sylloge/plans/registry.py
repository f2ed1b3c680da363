"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compiler import spread
from .engine import Engine
from .local import holds
from .stratify import strata
from .syntax import DatalogError, parse_query

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tables with a key, their first column.
KEYED = ("region", "nation", "customer", "supplier", "part", "orders", "events")
TABLES = (*KEYED, "lineitem", "conversations", "labels")


def warehouse(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> Engine:
    e = Engine(spark)
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        e.register(t, df, keys=(df.columns[0],) if t in KEYED else ())
    return e


def add(name: str, sql: str | None = None):
    """Registers the function below it."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def datalog(name: str, query: str, sql: str | None, program: str = "", **columns: str) -> None:
    """Registers a Datalog query over the tables; columns: types that answers are cast to."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = tuple(t for t in TABLES if f"{t}(" in program + query)
        df = warehouse(spark, sf_dir, used).load(program).query(query)
        return df.select(*(F.expr(columns[c]).alias(c) if c in columns else F.col(c) for c in df.columns))

    add(name, sql)(run)


# -- joins, filters, projections ------------------------------------------------------------------------

datalog("join_two", "select C, N where customer(C,_,K,_,_), nation(K,N,_)",
    'SELECT DISTINCT c_custkey AS "C", n_name AS "N" FROM customer JOIN nation ON c_nationkey = n_nationkey')
datalog("join_many", "select R, N, O, P where region(RK,R), nation(NK,N,RK), customer(C,_,NK,_,_), orders(O,C,_,P,_,_)",
    '''SELECT DISTINCT r_name AS "R", n_name AS "N", o_orderkey AS "O", o_totalprice AS "P" FROM region JOIN nation ON n_regionkey = r_regionkey
       JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey''')
datalog("self_join_neq", "select X, Y where supplier(X,_,N,_), supplier(Y,_,N,_), X != Y",
    'SELECT DISTINCT a.s_suppkey AS "X", b.s_suppkey AS "Y" FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey <> b.s_suppkey')
datalog("cross_join", "select R, S where region(R,_), supplier(S,_,_,_)", 'SELECT r_regionkey AS "R", s_suppkey AS "S" FROM region, supplier')
datalog("theta_arith", "select P, S where part(P,_,_,_,Z,_), supplier(S,_,N,_), Z > N * 2 + 5",
    'SELECT DISTINCT p_partkey AS "P", s_suppkey AS "S" FROM part, supplier WHERE p_size > s_nationkey * 2 + 5')
datalog("arith_filter", "select O, L where lineitem(O,_,_,L,Q,E,D,T,_,_,_), E * (1 - D) / Q > 2500, -T + 1 >= 0.95",
    'SELECT DISTINCT l_orderkey AS "O", l_linenumber AS "L" FROM lineitem WHERE l_extendedprice * (1 - l_discount) / l_quantity > 2500 AND -l_tax + 1 >= 0.95')
datalog("const_filter", "orders(O, C, 'F', P, _, '1-URGENT')",
    """SELECT DISTINCT o_orderkey AS "O", o_custkey AS "C", o_totalprice AS "P" FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
datalog("comparison_ops", "select C, B where customer(C,N,_,B,S), B >= 0, B < 5000, B != 100, S > 'BUILDING', S <= 'HOUSEHOLD', N = N",
    """SELECT DISTINCT c_custkey AS "C", c_acctbal AS "B" FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000 AND c_acctbal <> 100 AND c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD'""")
datalog("comparison_mixed_types", "select C, N where nation(C,N,_), C != N", 'SELECT n_nationkey AS "C", n_name AS "N" FROM nation')
datalog("repeated_variable", "nation(K,_,K)", 'SELECT DISTINCT n_nationkey AS "K" FROM nation WHERE n_nationkey = n_regionkey')
datalog("projection_distinct", "select S, P where orders(_,_,S,_,_,P)", 'SELECT DISTINCT o_orderstatus AS "S", o_orderpriority AS "P" FROM orders')
datalog("implicit_projection", "supplier(S,_,N,B)", 'SELECT DISTINCT s_suppkey AS "S", s_nationkey AS "N", s_acctbal AS "B" FROM supplier')
datalog("semi_join", "select C where customer(C,_,_,_,_), orders(_,C,_,_,_,'1-URGENT')",
    """SELECT c_custkey AS "C" FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
datalog("negation_anti", "select C, N where customer(C,N,_,_,_), \\+ orders(_,C,'P',_,_,'5-LOW')",
    """SELECT c_custkey AS "C", c_name AS "N" FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '5-LOW')""")
datalog("negation_wildcard", "select P where part(P,_,_,_,_,_), \\+ lineitem(_,P,_,1,_,_,_,_,'R','O',_)",
    """SELECT p_partkey AS "P" FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 1)""")
datalog("negation_ground", "select R where region(R,_), \\+ nation(999,_,_)", 'SELECT r_regionkey AS "R" FROM region')
datalog("union_rules", "nation_with(N)",
    'SELECT s_nationkey AS "N" FROM supplier WHERE s_acctbal > 9000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9500',
    "nation_with(N) :- supplier(_,_,N,B), B > 9000. nation_with(N) :- customer(_,_,N,B,_), B > 9500.")
datalog("intersection", "both(N)",
    'SELECT s_nationkey AS "N" FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000',
    "both(N) :- supplier(_,_,N,B), B > 5000, customer(_,_,N,A,_), A > 9000.")
datalog("except_rule", "only(N)",
    'SELECT c_nationkey AS "N" FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000',
    "rich(N) :- supplier(_,_,N,B), B > 5000. only(N) :- customer(_,_,N,_,_), \\+ rich(N).")
datalog("head_constants", "tagged(K, T, S)",
    """SELECT DISTINCT c_custkey AS "K", 'good' AS "T", c_custkey AS "S" FROM customer WHERE c_acctbal > 9000""",
    "tagged(K, good, K) :- customer(K,_,_,B,_), B > 9000.")
datalog("program_facts", "select C, W where customer(C,_,_,_,S), weight(S,W)",
    """SELECT c_custkey AS "C", w AS "W" FROM customer JOIN (VALUES ('BUILDING', 1.5::DOUBLE), ('MACHINERY', 2.0)) AS t(s, w) ON c_mktsegment = s""",
    "weight('BUILDING', 1.5). weight('MACHINERY', 2).")
datalog("proposition", "select R where busy, region(R,_)",
    'SELECT r_regionkey AS "R" FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000)',
    "busy :- orders(_,_,_,P,_,_), P > 1000.")


@add("ground_query", "SELECT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3) AS holds")
def ground_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = warehouse(spark, sf_dir, ("nation",)).query("nation(3,_,3)")
    return df.agg((F.count(F.lit(1)) > 0).alias("holds"))


@add("limit_rows", "SELECT 100::BIGINT AS n")
def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse(spark, sf_dir, ("customer",)).query("select C where customer(C,_,_,_,_)", limit=100).agg(F.count("*").alias("n"))


# -- aggregates -----------------------------------------------------------------------------------------

datalog("agg_count", "count(*) as N where customer(C,_,_,_,_), \\+ orders(_,C,'P',_,_,_)",
    """SELECT count(*)::BIGINT AS "N" FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
datalog("agg_count_wildcard", "per_customer(C,N)",
    'SELECT c_custkey AS "C", count(*)::BIGINT AS "N" FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey',
    "per_customer(C,N) :- count(*) as N where customer(C,_,_,_,_), orders(_,C,_,_,_,_).")
datalog("agg_empty_count", "count(*) as N where orders(_,_,nothing,_,_,_)", 'SELECT 0::BIGINT AS "N"')
datalog("agg_empty_sum", "sum(P) as S where orders(_,_,nothing,P,_,_)", 'SELECT sum(o_totalprice) AS "S" FROM orders WHERE false HAVING count(*) > 0')
datalog("agg_sum_group", "revenue(F,S,T)",
    '''SELECT l_returnflag AS "F", l_linestatus AS "S", round(sum(l_extendedprice), 2) AS "T" FROM (SELECT DISTINCT * FROM lineitem) GROUP BY ALL''',
    "revenue(F,S,T) :- sum(E) as T where lineitem(_,_,_,_,_,E,_,_,F,S,_).", T="round(T, 2)")
datalog("agg_min_max", "span(S,L,H)",
    'SELECT o_orderstatus AS "S", min(o_totalprice) AS "L", max(o_totalprice) AS "H" FROM orders GROUP BY 1',
    "low(S,L) :- min(P) as L where orders(_,_,S,P,_,_). high(S,H) :- max(P) as H where orders(_,_,S,P,_,_). span(S,L,H) :- low(S,L), high(S,H).")
datalog("agg_min_atoms", "max(N) as M where customer(_,N,_,_,_)", 'SELECT max(c_name) AS "M" FROM customer')
datalog("agg_having", "frequent(C,N)",
    'SELECT o_custkey AS "C", count(*)::BIGINT AS "N" FROM orders GROUP BY 1 HAVING count(*) >= 15',
    "n_orders(C,N) :- count(*) as N where orders(_,C,_,_,_,_). frequent(C,N) :- n_orders(C,N), N >= 15.")
datalog("agg_over_agg", "max(N) as M where n_orders(_,N)",
    'SELECT max(n)::BIGINT AS "M" FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)',
    "n_orders(C,N) :- count(*) as N where orders(_,C,_,_,_,_).")
datalog("agg_negated", "quiet(N,K)",
    'SELECT c_nationkey AS "N", count(*)::BIGINT AS "K" FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice = o_totalprice AND o_orderstatus = \'P\') GROUP BY 1',
    "quiet(N,K) :- count(*) as K where customer(C,_,N,_,_), \\+ orders(_,C,'P',_,_,_).")


@add("agg_witnesses", """SELECT o_orderstatus AS "S", o_orderkey AS "O", o_totalprice AS "P" FROM orders
    QUALIFY o_totalprice = max(o_totalprice) OVER (PARTITION BY o_orderstatus)""")
def agg_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("orders",)).load("top(S,M) :- max(P) as M where orders(_,_,S,P,_,_).")
    return e.query("select S, O, P where orders(O,_,S,P,_,_), top(S,P)")


# -- recursion ------------------------------------------------------------------------------------------



def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over the parts: each part to that of half its number."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey > 0")
    return part.select(F.col("p_partkey").alias("x"), F.floor(F.col("p_partkey") / 2).cast("long").alias("y"))


def recursion(name: str, query: str, program: str, sql: str, local_rows: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = warehouse(spark, sf_dir, ("nation", "region", "supplier", "customer"))
        if local_rows is not None:
            e.local_rows = local_rows
        return e.register("up", edges(spark, sf_dir), unique=True).load(program).query(query)

    add(name, sql)(run)


_UP = "SELECT p_partkey AS x, p_partkey // 2 AS y FROM part WHERE p_partkey > 0"
recursion("reach_linear", "anc(X,Y)", "anc(X,Y) :- up(X,Y). anc(X,Z) :- up(X,Y), anc(Y,Z).",
    f'WITH RECURSIVE a AS ({_UP} UNION SELECT u.x, a.y FROM ({_UP}) u JOIN a ON u.y = a.x) SELECT x AS "X", y AS "Y" FROM a')
recursion("reach_nonlinear", "anc(X,Y)", "anc(X,Y) :- up(X,Y). anc(X,Z) :- anc(X,Y), anc(Y,Z).",
    f'WITH RECURSIVE a AS ({_UP} UNION SELECT a.x, u.y FROM a JOIN ({_UP}) u ON u.x = a.y) SELECT x AS "X", y AS "Y" FROM a', 0)
recursion("reach_cycle", "way(X,Y)", "arc(X,Y) :- nation(X,_,_), nation(Y,_,_), Y = X + 1. arc(24,0). way(X,Y) :- arc(X,Y). way(X,Z) :- way(X,Y), arc(Y,Z).",
    'SELECT a.n_nationkey::BIGINT AS "X", b.n_nationkey::BIGINT AS "Y" FROM nation a, nation b')
recursion("reach_bound", "select Y where anc(100,Y)", "anc(X,Y) :- up(X,Y). anc(X,Z) :- up(X,Y), anc(Y,Z).",
    'WITH RECURSIVE a AS (SELECT 100::BIGINT AS x UNION SELECT x // 2 FROM a WHERE x > 0) SELECT x AS "Y" FROM a WHERE x < 100')
recursion("same_generation", "select X, Y where sg(X,Y), X != Y",
    "member(X,R) :- nation(X,_,R). sg(X,X) :- nation(X,_,_). sg(X,Y) :- member(X,P), sg2(P,Q), member(Y,Q). sg2(R,R) :- region(R,_). sg2(P,Q) :- sg(X,Y), member(X,P), member(Y,Q).",
    'SELECT a.n_nationkey AS "X", b.n_nationkey AS "Y" FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey')
recursion("mutual_recursion", "even(X)", "even(0). odd(X) :- even(Y), nation(X,_,_), X = Y + 1. even(X) :- odd(Y), nation(X,_,_), X = Y + 1.",
    'SELECT n_nationkey::BIGINT AS "X" FROM nation WHERE n_nationkey % 2 = 0')
recursion("recursion_negation", "unreached(X)", "reach(2). reach(X) :- up(X,Y), reach(Y). unreached(X) :- up(X,_), \\+ reach(X).",
    'WITH RECURSIVE r AS (SELECT 2::BIGINT AS x UNION SELECT p_partkey FROM part JOIN r ON p_partkey // 2 = r.x WHERE p_partkey > 0) SELECT p_partkey AS "X" FROM part WHERE p_partkey > 0 AND p_partkey NOT IN (SELECT x FROM r)')
recursion("recursion_aggregate", "depth(X,N)", "anc(X,Y) :- up(X,Y). anc(X,Z) :- up(X,Y), anc(Y,Z). depth(X,N) :- count(*) as N where anc(X,_).",
    f'WITH RECURSIVE a AS ({_UP} UNION SELECT u.x, a.y FROM ({_UP}) u JOIN a ON u.y = a.x) SELECT x AS "X", count(*)::BIGINT AS "N" FROM a GROUP BY 1')


@add("materialize", """WITH f AS (SELECT n_nationkey AS c0, n_regionkey AS c1 FROM nation), d AS (SELECT a.n_nationkey AS c0, b.n_regionkey + 0 AS c1 FROM nation a, nation b WHERE a.n_nationkey = 0)
    SELECT c0, c1, NOT EXISTS (SELECT 1 FROM f WHERE f.c0 = u.c0 AND f.c1 = u.c1) AS derived FROM (SELECT * FROM f UNION SELECT * FROM d) u""")
def materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("nation",))
    e.register("lies_in", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey"), unique=True)
    e.load("lies_in(X,R) :- nation(X,_,_), X = 0, nation(_,_,R).")
    return e.materialize()[("lies_in", 2)]


@add("proof_edges", """SELECT DISTINCT '["same_nation","' || c_custkey || '","' || s_suppkey || '"]' AS derived, 1 AS rule, place,
        CASE place WHEN 1 THEN '["lives","' || c_custkey || '","' || c_nationkey || '"]' ELSE '["sells","' || s_suppkey || '","' || s_nationkey || '"]' END AS input
    FROM customer JOIN supplier ON c_nationkey = s_nationkey, (VALUES (1), (2)) AS p(place)""")
def proof_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.register("lives", spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), unique=True)
    e.register("sells", spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey"), unique=True)
    e.load("same_nation(C,S) :- lives(C,N), sells(S,N).")
    return e.proof_edges(1)


# -- exact numbers, bounds, types -----------------------------------------------------------------------

_LARGE = "SELECT o_orderkey + 9007199254740993 AS x, o_orderkey // 2 + 9007199254740993 AS y FROM orders WHERE o_orderkey > 0"


def large_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over the orders whose numbers lie beyond those that doubles hold exactly."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey > 0")
    return o.select((F.col("o_orderkey") + 2**53 + 1).alias("x"), (F.floor(F.col("o_orderkey") / 2).cast("long") + 2**53 + 1).alias("y"))


for _name, _rows in (("reach_large_ids", 10_000_000), ("reach_large_ids_distributed", 0)):

    @add(_name, f'WITH RECURSIVE a AS ({_LARGE} UNION SELECT a.x, u.y FROM a JOIN ({_LARGE}) u ON u.x = a.y) SELECT x AS "X", y AS "Y" FROM a')
    def reach_large(spark: SparkSession, sf_dir: str, rows: int = _rows) -> DataFrame:
        """Reachability among large numbers, with any number of rows allowed on the driver and with none."""
        e = Engine(spark, local_rows=rows).register("up", large_edges(spark, sf_dir), keys=("x",))
        return e.load("anc(X,Y) :- up(X,Y). anc(X,Z) :- anc(X,Y), up(Y,Z).").query("anc(X,Y)")


def _said(f: Callable[[], object]) -> str:
    try:
        f()
    except DatalogError as e:
        return type(e).__name__
    return "fine"


@add("bounds", """SELECT 'aggregate, one too many' AS what, CASE WHEN (SELECT count(*) FROM customer) > 0 THEN 'LimitError' END AS said UNION ALL SELECT 'aggregate, as many', 'fine' UNION ALL SELECT 'facts, one too many', 'LimitError' WHERE (SELECT count(*) FROM nation) > 0
    UNION ALL SELECT 'facts, as many', 'fine' UNION ALL SELECT 'rounds', CASE WHEN (SELECT count(*) FROM nation) > 3 THEN 'LimitError' ELSE 'fine' END UNION ALL SELECT 'rows', CASE WHEN (SELECT count(*) FROM nation) > 5 THEN 'LimitError' ELSE 'fine' END""")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bounds on aggregates, facts, rounds and collected rows say."""
    n, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("nation", "customer"))
    chain = "next(X,Y) :- nation(X,_,_), nation(Y,_,_), Y = X + 1. way(X,Y) :- next(X,Y). way(X,Z) :- way(X,Y), next(Y,Z)."

    def engine(**options) -> Engine:
        e = warehouse(spark, sf_dir, ("nation", "customer"))
        for k, v in options.items():
            setattr(e, k, v)
        return e.load("all(X) :- nation(X,_,_). " + chain)

    count = "count(*) as N where customer(_,_,_,_,_)"
    rows = [
        ("aggregate, one too many", _said(lambda: engine(max_aggregate_rows=c - 1).rows(count))), ("aggregate, as many", _said(lambda: engine(max_aggregate_rows=c).rows(count))),
        ("facts, one too many", _said(lambda: engine(max_facts=n - 1).rows("all(X)"))), ("facts, as many", _said(lambda: engine(max_facts=n).rows("all(X)"))),
        ("rounds", _said(lambda: engine(max_rounds=2, local_rows=0).rows("way(X,Y)"))), ("rows", _said(lambda: engine().rows("all(X)", 5))),
    ]
    return spark.createDataFrame(rows, "what string, said string")


@add("portable_scan", """SELECT n_nationkey::BIGINT AS "K", n_name AS "N", 'fine' AS said FROM nation UNION ALL SELECT NULL, 'timestamps', 'DatalogError' UNION ALL SELECT NULL, 'too many', 'LimitError' WHERE (SELECT count(*) FROM orders) > 1000
    UNION ALL SELECT NULL, 'null', 'refused' UNION ALL SELECT NULL, 'large', 'refused' WHERE (SELECT count(*) FROM orders) > 0 UNION ALL SELECT NULL, 'bytes', 'DatalogError'""")
def portable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that any engine reads alike, and what is refused."""
    n, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "orders"))
    fine = Engine(spark).register_portable("nation", n).query("nation(K,N,_)").select(F.col("K").cast("long").alias("K"), "N", F.lit("fine").alias("said"))

    def ends(df: DataFrame) -> str:
        try:
            Engine(spark).register_portable("p", df, None, None).query("p(X)").count()
        except PySparkException as e:
            return "refused" if "p." in str(e) else str(e)
        return "fine"

    e = Engine(spark)
    rows = [
        ("timestamps", _said(lambda: e.register_portable("orders", o))), ("too many", _said(lambda: e.register_portable("orders", o.select("o_orderkey"), 1000))),
        ("bytes", _said(lambda: e.register_portable("b", n.select(F.col("n_name").cast("binary"))))), ("null", ends(n.select(F.nullif(F.col("n_nationkey"), F.lit(3))))), ("large", ends(large_edges(spark, sf_dir).select("x"))),
    ]
    return fine.union(spark.createDataFrame([(None, a, b) for a, b in rows], "K long, N string, said string"))


@add("catalogue", """SELECT table_name AS predicate, count(*) OVER (PARTITION BY table_name)::INT AS arity, ordinal_position::INT AS place, column_name AS name,
    CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' END AS type FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'supplier')""")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse(spark, sf_dir, ("nation", "region", "supplier")).catalogue()


@add("compiled_sql", """SELECT DISTINCT a.s_suppkey AS "X", b.c_custkey AS "Y" FROM supplier a JOIN customer b ON s_nationkey = c_nationkey WHERE b.c_acctbal > 5000 AND a.s_suppkey <> b.c_custkey AND b.c_mktsegment = 'BUILDING'""")
def compiled_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule as SQL text, which Spark SQL then runs over views of the tables."""
    names = ("supplier", "customer")
    for t, df in zip(names, spread(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names))):
        df.createOrReplaceTempView(t)
    return spark.sql(warehouse(spark, sf_dir, ("supplier", "customer")).to_sql("near(X, Y) :- supplier(X,_,N,_), customer(Y,_,N,B,'BUILDING'), B > 5000, X != Y.", "`"))


@add("comparison_test", """SELECT n_nationkey AS k, op, CASE op WHEN '=' THEN n_nationkey = 7 WHEN '!=' THEN n_nationkey <> 7 WHEN '<' THEN n_nationkey < 7 WHEN '>=' THEN n_nationkey >= 7 WHEN 'atom <' THEN false WHEN 'atom !=' THEN true ELSE n_nationkey * 2 - 1 > 7 END AS holds
    FROM nation, (SELECT unnest(['=', '!=', '<', '>=', 'atom <', 'atom !=', 'arithmetic']) AS op)""")
def comparison_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of values on the driver, one by one."""
    texts = {"=": "X = 7", "!=": "X != 7", "<": "X < 7", ">=": "X >= 7", "atom <": "X < seven", "atom !=": "X != seven", "arithmetic": "X * 2 - 1 > 7"}
    goals = {n: parse_query(f"p(X), {t}").body[1] for n, t in texts.items()}
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()]
    return spark.createDataFrame([(k, n, holds(g, {"X": float(k)})) for k in keys for n, g in goals.items()], "k int, op string, holds boolean")


@add("aggregate_safety", """SELECT t AS text, 'SafetyError' AS said FROM (SELECT unnest(['n(N) :- count(*) as N where X > 1.', 'n(N) :- sum(X) as N where nation(_, _, _).', 'n(K) :- count(*) as N where nation(K, _, _).', 'n(N, N) :- count(*) as N where nation(_, _, _).', 'n(X) :- nation(_, _, _).', 'n(X) :- nation(X, _, _), Y > 1.']) AS t)
    UNION ALL SELECT 'n(K, N) :- count(*) as N where nation(K, _, _).', 'fine'""")
def aggregate_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules over the nations are refused before anything is read."""
    texts = ["n(N) :- count(*) as N where X > 1.", "n(N) :- sum(X) as N where nation(_, _, _).", "n(K) :- count(*) as N where nation(K, _, _).", "n(N, N) :- count(*) as N where nation(_, _, _).",
             "n(X) :- nation(_, _, _).", "n(X) :- nation(X, _, _), Y > 1.", "n(K, N) :- count(*) as N where nation(K, _, _)."]
    return spark.createDataFrame([(t, _said(lambda t=t: warehouse(spark, sf_dir, ("nation",)).load(t))) for t in texts], "text string, said string")


@add("strata", """WITH n AS (SELECT table_name || '/' || count(*) AS p FROM information_schema.columns WHERE table_name = 'nation' GROUP BY table_name) SELECT p AS predicate, 0 AS stratum FROM n
    UNION ALL SELECT unnest(['a/1', 'loop/1']), 0 UNION ALL SELECT 'b/1', 1 UNION ALL SELECT 'c/2', 2""")
def strata_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = warehouse(spark, sf_dir, ("nation",)).load("a(X) :- nation(X,_,_). loop(X) :- loop(X), a(X). b(X) :- nation(X,_,_), \\+ loop(X). c(X,N) :- count(*) as N where b(X).")
    level = strata(e.program.rules)
    keys = set(e.base) | {r.head.key for r in e.program.rules}
    return spark.createDataFrame([(f"{k[0]}/{k[1]}", level.get(k, 0)) for k in keys], "predicate string, stratum int")


from . import registered  # noqa: E402, F401  (the remaining operators' queries)
