"""Queries of search, reranking, measures, readings and walks, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ADVICE, HANDED, IRREGULAR, REDACTED, SENSITIVE, STOP, asks_for_advice
from ..functions.text import redact as redact_text
from ..functions.vectors import letter_counts
from ..operators import graphs, recall, retrieval
from ..sources import files
from . import registered_store  # noqa: F401
from .engine import Engine
from .registered_rules import table
from .registry import add, warehouse
from .syntax import Clause, parse_program

# -- words in SQL ---------------------------------------------------------------------------------------

_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_OWN = " ".join(f"WHEN w IN {_LIST([k for k, v in IRREGULAR.items() if v == of])} THEN '{of}'" for of in dict.fromkeys(IRREGULAR.values()))
_STEM = f"""CASE {_OWN} WHEN length(w) > 5 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-3]
    WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END"""
_STEMMED = f"(CASE WHEN {_STEM} IN ('grandchild', 'grandparent') THEN 'grandkin' ELSE {_STEM} END)"


def _words_sql(text: str) -> str:
    """A list of the words of a text, stemmed."""
    flat = f"lower(regexp_replace({text}, '([0-9a-z])([A-Z])', '\\1 \\2', 'g'))"
    return f"list_transform(list_filter(string_split_regex({flat}, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {_STEMMED})"


def _search_words_sql(text: str) -> str:
    return f"list_distinct(list_filter({_words_sql(text)}, lambda w: w NOT IN {_LIST(STOP)}))"


_SPLIT = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: len(w) >= 3)"


@add("transcript_tail", """SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2""")
def transcript_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.transcript_tail(table(spark, sf_dir, "conversations"), ["turn"], 2, ("user",), "conv_id").select("conv_id", "turn", "text")


# -- retrieval ------------------------------------------------------------------------------------------


@add("bm25_topk", f"""WITH base AS (SELECT doc_id, {_SPLIT.format('text')} AS ws FROM documents), stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM base),
    asked AS (SELECT item_id AS query_id, unnest(list_distinct({_SPLIT.format('text')})) AS w FROM benchmark),
    tf AS (SELECT w, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS w FROM base) WHERE w IN (SELECT w FROM asked) GROUP BY ALL),
    df AS (SELECT w, ln((SELECT n + 1 FROM stats) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY w),
    scored AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT mean FROM stats)))), 6) AS score FROM asked JOIN tf USING (w) JOIN df USING (w) GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return df.select("query_id", "doc_id", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


_LEXICAL = f"""a AS (SELECT doc_id, unnest({_search_words_sql('text')}) AS w FROM documents), q AS (SELECT item_id AS query_id, unnest({_search_words_sql('text')}) AS w FROM benchmark),
    s AS (SELECT query_id, doc_id, count(*) AS score FROM a JOIN q USING (w) GROUP BY ALL), lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@add("lexical_topk", f"WITH {_LEXICAL} SELECT query_id, doc_id, score, rank::INT AS rank FROM lex WHERE rank <= 10")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_LETTERS = "[" + ", ".join(f"(len(t) - len(replace(lower(t), '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


@add("rerank_topk", f"""WITH {_LEXICAL}, c AS (SELECT * FROM lex WHERE rank <= 100), n AS (SELECT doc_id, text, least(greatest(ceil((length(text) - 256) / 1792), 1), 10)::BIGINT AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM c)),
    pieces AS (SELECT doc_id, substring(text, i * 1792 + 1, 2048) AS t FROM (SELECT doc_id, text, unnest(range(n)) AS i FROM n)), pv AS (SELECT doc_id, {_LETTERS} AS v FROM pieces), qv AS (SELECT item_id AS query_id, {_LETTERS} AS a FROM (SELECT item_id, text AS t FROM benchmark)),
    best AS (SELECT query_id, doc_id, c.score, c.rank AS old, round(max(CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(a, a) > 0 THEN list_dot_product(v, a) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(a, a))) END), 6) AS similarity FROM c JOIN pv USING (doc_id) JOIN qv USING (query_id) GROUP BY ALL),
    k AS (SELECT *, old = 1 AND score >= 120 AND score >= 1.5 * coalesce(max(CASE WHEN old = 2 THEN score END) OVER (PARTITION BY query_id), 0) AS keep FROM best)
    SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY keep DESC, similarity DESC NULLS LAST, doc_id)::INT AS rank FROM k QUALIFY rank <= 5""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search from end to end; counts of letters stand in for a model."""
    return retrieval.semantic_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), retrieval.EmbeddingCache(spark), "letters", letter_counts, 5)


@add("embedding_cache", """SELECT 'first' AS round, count(DISTINCT text)::BIGINT AS embedded FROM conversations WHERE role = 'user' UNION ALL
    SELECT 'second', count(DISTINCT text) FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE role = 'user') UNION ALL SELECT 'third', 0""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts are embedded: the users', then everybody's, then everybody's again."""
    cache, c = retrieval.EmbeddingCache(spark), table(spark, sf_dir, "conversations")
    rows = [(name, cache.prepare(df, "letters", letter_counts)) for name, df in (("first", c.where("role = 'user'")), ("second", c), ("third", c))]
    return spark.createDataFrame(rows, "round string, embedded long")


@add("missing_embeddings", "SELECT DISTINCT sha256('m' || chr(0) || text) AS key FROM conversations WHERE role = 'user' AND text NOT IN (SELECT text FROM conversations WHERE role <> 'user')")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    cache = c.where("role <> 'user'").select(retrieval.embedding_key("m", F.col("text")).alias("key"))
    return retrieval.missing_embeddings(c.where("role = 'user'"), cache, "m").select("key")


def _facts(spark: SparkSession, sf_dir: str) -> list[Clause]:
    """Nations and regions as clauses, with a rule over them."""
    text = [f"nation({r[0]}, '{r[1]}', {r[2]})." for r in table(spark, sf_dir, "nation").collect()] + [f"region({r[0]}, '{r[1]}')." for r in table(spark, sf_dir, "region").collect()]
    return parse_program(" ".join(text) + " lies_in(N, R) :- nation(_, N, K), region(K, R).")


_FACTS = f"""f AS (SELECT 'nation' AS head, 'nation(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ').' AS clause, [n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR] AS terms FROM nation
    UNION ALL SELECT 'region', 'region(' || r_regionkey || ', ''' || r_name || ''').', [r_regionkey::VARCHAR, r_name] FROM region),
    fw AS (SELECT head, clause, list_distinct({_words_sql('head')}) AS hw, list_distinct(flatten(list_transform(terms, lambda t: {_words_sql('t')}))) AS tw, list_distinct({_words_sql('clause')}) AS cw FROM f),
    asked AS (SELECT ['nation', '3', 'region'] AS a)"""


@add("clause_search", f"""WITH {_FACTS}, s AS (SELECT clause, 0 AS k, 120 * len(list_intersect(a, hw)) + 60 * len(list_intersect(a, tw)) + 20 * len(list_intersect(a, cw)) AS score FROM fw, asked
        UNION ALL SELECT 'lies_in(N, R) :- nation(_, N, K), region(K, R).', 1, 2 * 70 + 2 * 20)
    SELECT row_number() OVER (ORDER BY score DESC, k, clause)::INT AS rank, clause, score::INT AS score FROM s WHERE score > 0 QUALIFY rank <= 20""")
def clause_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = retrieval.clause_table(spark, _facts(spark, sf_dir))
    return retrieval.search(clauses, "what is nation 3 in which region", 20).select("rank", "clause", "score")


@add("search_graph", f"""WITH {_FACTS}, s AS (SELECT *, 120 * len(list_intersect(a, hw)) + 60 * len(list_intersect(a, tw)) + 20 * len(list_intersect(a, cw)) AS score FROM fw, asked),
        t AS (SELECT *, row_number() OVER (ORDER BY score DESC, clause) AS rank FROM s QUALIFY rank <= 3)
    SELECT 'search' AS source, 'result:' || rank AS target, 'returns' AS how FROM t UNION SELECT 'result:' || rank, 'clause:' || clause, 'matches' FROM t UNION SELECT 'clause:' || clause, 'word:' || unnest(list_intersect(a, hw)), 'head_predicate' FROM t
    UNION SELECT 'clause:' || clause, 'word:' || unnest(list_intersect(a, tw)), 'term' FROM t UNION SELECT 'clause:' || clause, 'word:' || unnest(list_intersect(a, cw)), 'clause_word' FROM t""")
def search_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = [c for c in _facts(spark, sf_dir) if c.is_fact]
    return retrieval.search_graph(retrieval.search(retrieval.clause_table(spark, facts), "what is nation 3 in which region", 3))


@add("schema_ranking", f"""WITH {_FACTS}, w AS (SELECT head, unnest(tw) AS w FROM fw) SELECT head AS predicate, (CASE head WHEN 'nation' THEN 100 + 200 ELSE 0 END + 30 * count(DISTINCT w) FILTER (w IN ('which', 'nation', '3', 'be', 'in', 'africa')))::INT AS score
    FROM w GROUP BY head UNION ALL SELECT 'lies_in', 100 + 10""")
def schema_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = retrieval.rank_predicates(retrieval.clause_table(spark, _facts(spark, sf_dir)), "which nation 3 is in AFRICA")
    return df.select("predicate", "score")


@add("schema_choice", """WITH c AS (SELECT table_name AS t, table_name || '/' || count(*) AS p FROM information_schema.columns WHERE table_name IN ('nation', 'region') GROUP BY 1) SELECT 'two' AS room, p AS predicate FROM c WHERE t = 'nation'
    UNION ALL SELECT 'two', p FROM c WHERE t = 'region' UNION ALL SELECT 'one', p FROM c WHERE t = 'nation' UNION ALL SELECT 'lies', 'refused'""")
def schema_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is chosen for two questions with room for one or two predicates; a predicate needs those that its rules rest on."""
    facts, rows = _facts(spark, sf_dir), []
    for room, most, text in (("two", 2, "which nation"), ("one", 1, "which nation"), ("lies", 2, "lies_in lies_in")):
        try:
            rows += [(room, p) for p in retrieval.select_schema(facts, spark, text, most)]
        except retrieval.BudgetError:
            rows.append((room, "refused"))
    return spark.createDataFrame(rows, "room string, predicate string")


@add("query_intent", rf"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '{ADVICE}')")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asks for advice."""
    return table(spark, sf_dir, "conversations").where(asks_for_advice(F.col("text"))).select("conv_id", "turn")


@add("edit_distance", """WITH w AS (SELECT DISTINCT unnest(string_split(lower(c_name || ' ' || c_mktsegment), ' ')) AS w FROM customer) SELECT a.w AS a, b.w AS b FROM w a, w b WHERE a.w < b.w AND len(a.w) BETWEEN 4 AND 64 AND len(b.w) BETWEEN 4 AND 64 AND levenshtein(a.w, b.w) <= 1""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "customer").select(F.explode(F.split(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), " ")).alias("w"))
    return retrieval.near_words(words)


@add("cosine_topk", """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0)
    SELECT query_id, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings WHERE vec_id <> query_id
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) DESC, vec_id) <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries, every row whose number 20 divides, against all rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.nearest(e, e.where("id % 20 = 0"), 5).withColumnRenamed("doc_id", "vec_id")


def _sensitive_sql(text: str) -> str:
    """The same patterns for RE2, which has no look-ahead: there the pattern with one is taken apart."""
    quoted = lambda p: p.replace("'", "''")
    plain = [f"regexp_matches({text}, '{quoted(p)}')" for p in SENSITIVE if "(?=" not in p]
    ahead = rf"(?i)\b(?:the|my|your)\s+{HANDED}\s+\S{{6,}}"
    token = rf"len(list_filter(regexp_extract_all({text}, '{ahead}'), lambda m: regexp_matches(regexp_extract(m, '\S+$'), '[-0-9._~+/=]'))) > 0"
    return " OR ".join([*plain, token])


@add("redact_sensitive", f"SELECT doc_id, CASE WHEN {_sensitive_sql('text')} THEN '{REDACTED}' ELSE text END AS text FROM documents")
def redact_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact_text(F.col("text")).alias("text"))


@add("retrieval_metrics", """WITH f AS (SELECT item_id AS q, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS r FROM benchmark, labels WHERE doc_id % 7 = item_id % 7), rel AS (SELECT DISTINCT item_id AS q, doc_id FROM benchmark, labels WHERE quality = 1 AND doc_id % 5 = item_id % 5),
    h AS (SELECT q, count(*) AS hits, min(r) AS first FROM f JOIN rel USING (q, doc_id) WHERE r <= 10 GROUP BY q), p AS (SELECT q, count(*) AS n FROM rel GROUP BY q)
    SELECT round(avg(coalesce(hits, 0) / 10), 6) AS "precision", round(avg(coalesce(hits, 0) / n), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg((coalesce(hits, 0) = n)::INT), 6) AS coverage FROM p LEFT JOIN h USING (q)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, lab = table(spark, sf_dir, "benchmark").select("item_id"), table(spark, sf_dir, "labels")
    found = b.join(lab, F.col("doc_id") % 7 == F.col("item_id") % 7).select(F.col("item_id").alias("query_id"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    rel = b.join(lab.where("quality = 1"), F.col("doc_id") % 5 == F.col("item_id") % 5).select(F.col("item_id").alias("query_id"), "doc_id")
    return retrieval.retrieval_metrics(found, rel, 10)


@add("stale_leakage", """WITH u AS (SELECT user_id, list(event_id) AS seen, list(event_id) FILTER (event_type = 'error') AS stale, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'answered' ELSE 'no_match' END AS status, CASE WHEN count(*) > 5 THEN 'answered' ELSE 'no_match' END AS expected FROM events GROUP BY 1)
    SELECT sum(len(coalesce(stale, [])))::BIGINT AS n_stale, round(avg((status = expected)::INT), 9) AS status_accuracy FROM u""")
def stale_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases: their events were retrieved, the errors among them are stale."""
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case")).agg(
        F.collect_list("event_id").alias("retrieved"), F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("stale"),
        F.when(F.count_if(F.col("event_type") == "purchase") > 0, "answered").otherwise("no_match").alias("status"), F.when(F.count("*") > 5, "answered").otherwise("no_match").alias("expected"),
    )
    df = retrieval.stale_leakage(per.select("case", "retrieved", "status"), per.select("case", "stale", "expected"))
    return df.select("n_stale", F.round("status_accuracy", 9).alias("status_accuracy"))


@add("latency", "SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.latency(table(spark, sf_dir, "events"), "value")


@add("recency_topk", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def recency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recency_topk(table(spark, sf_dir, "events"), ["user_id"], "ts", 3, "event_id").select("user_id", "event_id", "ts")


@add("schema_summary", """SELECT 'nation' AS predicate, fact FROM (SELECT '["' || n_nationkey || '","' || n_name || '","' || n_regionkey || '"]' AS fact FROM nation ORDER BY 1 LIMIT 3)
    UNION ALL SELECT 'region', fact FROM (SELECT '["' || r_regionkey || '","' || r_name || '"]' AS fact FROM region ORDER BY 1 LIMIT 3)""")
def schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.schema_summary(warehouse(spark, sf_dir, ("nation", "region"))).select("predicate", "fact")


@add("rival_readings", """SELECT 'lives' AS predicate, 'works' AS rival WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = (SELECT min(c_nationkey) FROM customer)) UNION ALL SELECT 'was_until', 'was'""")
def rival_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else a question about people in the first nation might mean, and one that mixes past and present."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    e = Engine(spark).register("lives", c.select("c_custkey", "c_nationkey"), keys=("c_custkey",)).register("works", s.select("s_suppkey", "s_nationkey"), keys=("s_suppkey",)).load("was(a, b). was_until(a, b, c).")
    k = e.query("min(N) as M where lives(_, N)").first()["M"]
    found = recall.rivals(e, f"lives(X, {k})") + recall.rivals(e, "was_until(X, Y, T), was(X, Y)")
    return spark.createDataFrame(found, "predicate string, rival string")


@add("answer_texts", """SELECT unnest(string_split((SELECT string_agg('N = ' || n_name, chr(10) ORDER BY n_name) FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region)), chr(10))) AS line UNION ALL SELECT 'No answer.' UNION ALL SELECT 'Yes.'
    UNION ALL SELECT 'N = ' || n_name || ' because nation(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')' FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region)""")
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as text, with and without the facts that they rest on."""
    e = warehouse(spark, sf_dir, ("nation", "region"))
    k = e.query("min(K) as M where region(K, _)").first()["M"]
    texts = [recall.answer_text(e, q) for q in (f"select N where nation(_, N, {k})", "select N where nation(_, N, nowhere)", f"nation(_, _, {k})")]
    texts.append(recall.evidence_text(e, f"select N where nation(_, N, {k})"))
    return spark.createDataFrame([(x,) for t in texts for x in t.split("\n")], "line string")


# -- graphs ---------------------------------------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str) -> Engine:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    e = Engine(spark)
    e.register("lives", c.join(n, c.c_nationkey == n.n_nationkey).select("c_name", "n_name"), unique=True)
    return e.register("part_of", n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name"), unique=True)


_CLAIMS = """c AS (SELECT '["lives","' || c_name || '","' || n_name || '"]' AS claim, n_name AS a, c_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT '["part_of","' || n_name || '","' || r_name || '"]', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@add("neighbourhood", f"WITH {_CLAIMS} SELECT claim, 1 AS depth FROM c WHERE a = 'NATION_3'")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is said of a nation, however much that is."""
    return graphs.neighbourhood(graphs.incidences(_names(spark, sf_dir)), "NATION_3", 1, None)


@add("shortest_path", """SELECT 'Customer#000000000' || ' ' || '["lives","Customer#000000000","' || n_name || '"]' || ' ' || n_name || ' ' || '["part_of","' || n_name || '","' || r_name || '"]' || ' ' || r_name AS path
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 0""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    goal = c.where("c_custkey = 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).first()["r_name"]
    paths = graphs.shortest_paths(graphs.incidences(_names(spark, sf_dir)), "Customer#000000000", goal)
    return spark.createDataFrame([(" ".join(p),) for p in paths], "path string")


@add("distances", """WITH RECURSIVE d AS (SELECT 0::BIGINT AS node, 0 AS distance UNION SELECT p_partkey, distance + 1 FROM part JOIN d ON p_partkey // 2 = node WHERE p_partkey > 0) SELECT node, distance FROM d""")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey > 0")
    return graphs.distances(p.select(F.floor(F.col("p_partkey") / 2).cast("long").alias("x"), F.col("p_partkey").alias("y")), 0)
