"""Query builders over the driver's tables and their SQL twins.

Float aggregates are rounded on both sides, counts and lengths are bigint, every LIMIT ends in a unique order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import scalar
from skein.operators import dml, search, stats, vectors
from skein.plans import dialect
from skein.session import table
from skein.sources.scratch import keep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a builder under its name with its SQL twin."""

    def put(build: Query) -> Query:
        QUERIES[build.__name__] = build
        ORACLE_SQL[build.__name__] = sql
        return build

    return put


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


# --- scans, projections, predicates ----------------------------------------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region")
def scan_all(spark, d):
    return table(spark, d, "region")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_eq(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7")
def index_lookup_eq(spark, d):
    """All rows of the key; min and max statistics of the row groups prune the scan."""
    return table(spark, d, "lineitem").where(F.col("l_orderkey") == 7).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT CAST(1 AS INTEGER) AS one, 'x' AS t, CAST(2.5 AS DOUBLE) AS f, TRUE AS b, CAST(-3 AS INTEGER) AS neg")
def values_literal(spark, d):
    return spark.sql("SELECT 1 AS one, 'x' AS t, 2.5D AS f, true AS b, -3 AS neg")


@query("SELECT n_name AS nation, n_regionkey AS region, n_nationkey AS id FROM nation")
def project_cols(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("id"))


@query("SELECT p_partkey, p_size + 1 AS size1, round(p_retailprice * 2, 4) AS price2, upper(p_brand) AS brand FROM part")
def project_expr(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") + 1).alias("size1"), F.round(F.col("p_retailprice") * 2, 4).alias("price2"), F.upper("p_brand").alias("brand"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey <> 5 AND o_orderkey > 10 AND o_orderkey >= 11 AND o_orderkey < 9000 AND o_orderkey <= 8999 AND o_orderstatus = 'F'")
def filter_compare_all(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").where((c != 5) & (k > 10) & (k >= 11) & (k < 9000) & (k <= 8999) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_quantity * 2 > 90 OR l_linenumber = 1) AND (l_partkey + l_suppkey) < 1000")
def filter_and_or_arith(spark, d):
    keep = ((F.col("l_quantity") * 2 > 90) | (F.col("l_linenumber") == 1)) & ((F.col("l_partkey") + F.col("l_suppkey")) < 1000)
    return table(spark, d, "lineitem").where(keep).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def param_filter(spark, d):
    return spark.sql("SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = :segment AND c_acctbal > :least", args={"segment": "BUILDING", "least": 5000}, customer=table(spark, d, "customer"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def param_count(spark, d):
    return spark.sql("SELECT count(*) AS n FROM {lineitem} WHERE l_quantity > :q", args={"q": 25}, lineitem=table(spark, d, "lineitem"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, l_linenumber - 1 AS place FROM lineitem WHERE l_orderkey < 500")
def arith_project(spark, d):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"), 4)
    return table(spark, d, "lineitem").where("l_orderkey < 500").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", net.alias("net"), (F.col("l_linenumber") - 1).alias("place"))


@query("SELECT o_orderkey, o_orderkey // 7 AS seventh, -o_orderkey // 7 AS down FROM orders")
def int_div(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.int_div("o_orderkey", F.lit(7)).alias("seventh"), scalar.int_div(-F.col("o_orderkey"), F.lit(7)).alias("down"))


@query("SELECT c_custkey, -c_acctbal AS owed, +c_nationkey AS nation FROM customer WHERE -c_acctbal > 0")
def unary_minus(spark, d):
    return table(spark, d, "customer").where(-F.col("c_acctbal") > 0).select("c_custkey", (-F.col("c_acctbal")).alias("owed"), F.col("c_nationkey").alias("nation"))


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) t WHERE n > 10")
def derived_table(spark, d):
    _views(spark, d, "events")
    return spark.sql("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) t WHERE n > 10")


@query("WITH big AS (SELECT user_id, value FROM events WHERE value > 50), small AS (SELECT user_id, value FROM big WHERE user_id < 50) SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM small GROUP BY user_id")
def cte_filter(spark, d):
    _views(spark, d, "events")
    return spark.sql("WITH big AS (SELECT user_id, value FROM events WHERE value > 50), small AS (SELECT user_id, value FROM big WHERE user_id < 50) SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM small GROUP BY user_id")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_name, o_orderkey, l_linenumber, l_partkey, l_suppkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'MACHINERY'")
def join_chain3(spark, d):
    c, o, x = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    return c.where("c_mktsegment = 'MACHINERY'").join(o, F.col("c_custkey") == F.col("o_custkey")).join(x, F.col("l_orderkey") == F.col("o_orderkey")).select("c_name", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    return a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).where("a.n_nationkey < b.n_nationkey").select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY n_name ORDER BY n_name")
def join_group_agg(spark, d):
    """The flagship: revenue by nation."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.where("o_totalprice > 1000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.avg("o_totalprice"), 4).alias("mean")).orderBy("n_name")


@query("SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 100000 AND l_quantity < 10")
def join_filter_count(spark, d):
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.where("o_totalprice > 100000").join(x.where("l_quantity < 10"), F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


# --- aggregation -----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem")
def count_star(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(v) AS n, count(*) AS rows_all FROM (SELECT nullif(event_type, 'click') AS v FROM events) t")
def count_col(spark, d):
    return table(spark, d, "events").select(F.nullif("event_type", F.lit("click")).alias("v")).agg(F.count("v").alias("n"), F.count(F.lit(1)).alias("rows_all"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def group_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS qty, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_returnflag")
def group_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.sum("l_partkey").alias("parts"))


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def group_avg(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT l_linestatus, min(l_extendedprice) AS low, max(l_extendedprice) AS high, min(l_returnflag) AS first_flag FROM lineitem GROUP BY l_linestatus")
def group_min_max(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.min("l_returnflag").alias("first_flag"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def group_multi_agg(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
def group_multi_key(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def agg_global(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, avg(o_totalprice) AS mean, min(o_orderkey) AS low FROM orders WHERE o_orderkey < 0")
def agg_empty_input(spark, d):
    return table(spark, d, "orders").where("o_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"), F.avg("o_totalprice").alias("mean"), F.min("o_orderkey").alias("low"))


# --- window, sort, limit, sets ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def row_number(spark, d):
    """A global numbering without one task for all rows: range-dealt partitions, sorted, plus the rows of the partitions before."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return number_rows(o, order, "rn")


def number_rows(df: DataFrame, order: list[F.Column], name: str) -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY ...) for large inputs; equal to the window without PARTITION BY, which uses one task.

    The rows are dealt out by range, sorted and written once, each with its task and its place in it; one count for each task, from
    the files, shifts the places.  Rows that are equal by `order` are dealt out by a hash of the whole row, so a frequent value
    doesn't fill one task.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = [*order, F.xxhash64(*plain).asc()]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    kept = keep(dealt.withColumn("__task", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"), "numbered")
    sizes = kept.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__task", (F.sum("__n").over(W.orderBy("__task")) - F.col("__n")).alias("__before"))  # one row for each task
    return kept.join(F.broadcast(before), "__task").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__place") + 1).alias(name))


@query("SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem")
def row_number_payload(spark, d):
    """With columns that the order doesn't name."""
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return number_rows(table(spark, d, "lineitem"), order, "rn")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey ASC")
def order_multi_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(F.asc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")
def limit_offset(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(10).limit(20)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50")
def topk(spark, d):
    return table(spark, d, "lineitem").select(*LINE_KEY).orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(50)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
def union_distinct(spark, d):
    return union_all(spark, d).distinct()


@query("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_chain3(spark, d):
    n, r, s = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select("r_regionkey"), table(spark, d, "supplier").select("s_nationkey")
    return n.union(r).distinct().unionAll(s)


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, lower(p_brand) AS low, upper(p_name) AS up FROM part")
def fn_lower_upper(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("low"), F.upper("p_name").alias("up"))


@query(r"SELECT n_nationkey, regexp_replace(chr(9) || ' ' || n_name || ' ' || chr(10), '^\s+|\s+$', '', 'g') AS name FROM nation")
def fn_trim(spark, d):
    return table(spark, d, "nation").select("n_nationkey", scalar.trim_space(F.concat(F.lit("\t "), "n_name", F.lit(" \n"))).alias("name"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def fn_length(spark, d):
    return table(spark, d, "documents").select("doc_id", scalar.length("text").alias("n"))


@query("SELECT c_custkey, abs(c_acctbal - 5000) AS far, abs(c_nationkey - 12) AS off FROM customer")
def fn_abs(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.abs(F.col("c_acctbal") - 5000).alias("far"), F.abs(F.col("c_nationkey") - 12).alias("off"))


@query("SELECT p_partkey, concat(p_brand, nullif(p_type, 'STANDARD'), CAST(p_size AS VARCHAR)) AS tag FROM part")
def fn_concat(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.concat("p_brand", F.nullif("p_type", F.lit("STANDARD")), "p_size").alias("tag"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS label FROM customer")
def fn_coalesce(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "c_name").alias("label"))


@query("SELECT n_nationkey, upper(trim(concat(' ', lower(n_name), ' '))) AS name, length(concat(n_name, n_name)) AS n FROM nation")
def fn_nested(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.upper(scalar.trim_space(scalar.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")))).alias("name"), scalar.length(scalar.concat("n_name", "n_name")).alias("n"))


# --- vectors ---------------------------------------------------------------------------------------------------------

_PROBE = [round(0.01 * (i % 13) - 0.05, 4) for i in range(64)]
_PROBE_SQL = "[" + ", ".join(map(str, _PROBE)) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_PROBE_SQL}), 6) AS dist FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_PROBE_SQL}), vec_id LIMIT 10")
def vector_l2_topk(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), "embedding", _PROBE, 10, "vec_id").select("vec_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {_PROBE_SQL}), 6) AS dist FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_PROBE_SQL}), vec_id LIMIT 10")
def vector_cosine_topk(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), "embedding", _PROBE, 10, "vec_id", "cosine").select("vec_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT vec_id, label FROM embeddings WHERE list_cosine_distance(embedding::DOUBLE[], {_PROBE_SQL}) < 0.95")
def vector_filter(spark, d):
    return vectors.distances(table(spark, d, "embeddings"), "embedding", _PROBE, "cosine").where("dist < 0.95").select("vec_id", "label")


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_PROBE_SQL}), 6) AS dist FROM embeddings WHERE label = 1")
def vector_text_literal(spark, d):
    """The operator spelling with a text literal, through the dialect front end."""
    _views(spark, d, "embeddings")
    scalar.install(spark)
    text = str(_PROBE).replace(" ", "")
    return spark.sql(dialect.rewrite(f"SELECT vec_id, round(embedding <-> '{text}', 6) AS dist FROM embeddings WHERE label = 1"))


# --- text search -----------------------------------------------------------------------------------------------------

_TOKENS_SQL = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_STOP_SQL = ", ".join(f"'{w}'" for w in scalar.STOP_WORDS)
_ENGLISH_SQL = f"list_filter({_TOKENS_SQL}, lambda t: t NOT IN ({_STOP_SQL}))"
SEARCH = "the that onand tion"


def _bm25_sql(tokens: str, terms: list[str], first: str = "") -> str:
    wanted = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH {first}toks AS (SELECT doc_id, {tokens} AS ts FROM documents),
lens AS (SELECT doc_id, len(ts) AS dl FROM toks WHERE len(ts) > 0),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(dl) FROM lens) AS avgdl),
q(term) AS (VALUES {wanted}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM toks) u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT tf.doc_id, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM tf JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN stats)
SELECT d.doc_id, round(coalesce(sum(part), 0)::DOUBLE, 6) AS score FROM documents d LEFT JOIN parts p ON d.doc_id = p.doc_id GROUP BY d.doc_id"""


def bm25_sql(terms: list[str], first: str = "") -> str:
    """SQL of every document's score for English terms; first: a CTE `documents` that takes the place of the table."""
    return _bm25_sql(_ENGLISH_SQL, terms, f"{first}, " if first else "")


@query(f"SELECT doc_id, CAST(len({_TOKENS_SQL}) AS BIGINT) AS n, CAST(len(list_distinct({_TOKENS_SQL})) AS BIGINT) AS different FROM documents")
def bm25_tokenize(spark, d):
    tokens = scalar.text_tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("bigint").alias("n"), F.size(F.array_distinct(tokens)).cast("bigint").alias("different"))


@query(f"SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_ENGLISH_SQL}) AS term FROM documents) t GROUP BY ALL")
def bm25_postings(spark, d):
    return search.postings(table(spark, d, "documents"), "doc_id", "text", "english")


@query(_bm25_sql(_ENGLISH_SQL, [t for t in SEARCH.split() if t not in scalar.STOP_WORDS]))
def bm25_english(spark, d):
    return search.scores(table(spark, d, "documents"), "doc_id", "text", SEARCH, "english").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_bm25_sql(_TOKENS_SQL, SEARCH.split()))
def bm25_simple(spark, d):
    return search.scores(table(spark, d, "documents"), "doc_id", "text", SEARCH, "simple").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, score FROM ({_bm25_sql(_ENGLISH_SQL, ['that', 'onand', 'tion', 'stupid'])}) t ORDER BY score DESC, doc_id LIMIT 20")
def bm25_rank(spark, d):
    found = search.scores(table(spark, d, "documents"), "doc_id", "text", "that onand tion stupid", "english")
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"SELECT doc_id, round((SELECT sum(CASE WHEN c > 0 THEN c * 2.2 / (c + 1.2) ELSE 0 END) FROM (SELECT len(list_filter({_TOKENS_SQL}, lambda w: w = 'the'))::DOUBLE AS c UNION ALL SELECT len(list_filter({_TOKENS_SQL}, lambda w: w = 'tion'))::DOUBLE) u), 6) AS score FROM documents")
def bm25_local_score(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(scalar.local_bm25("text", ["the", "tion"]), 6).alias("score"))


# --- statistics, tables after statements, dialect --------------------------------------------------------------------


@query("""SELECT 'o_orderkey' AS column_name, count(*) AS row_count, count(DISTINCT o_orderkey) AS ndv, count(*) - count(o_orderkey) AS null_count, CAST((count(*) - count(o_orderkey)) / count(*) AS DOUBLE) AS null_fraction, CAST(min(o_orderkey) AS VARCHAR) AS min_value, CAST(max(o_orderkey) AS VARCHAR) AS max_value FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus), CAST((count(*) - count(o_orderstatus)) / count(*) AS DOUBLE), min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL SELECT 'prio', count(*), count(DISTINCT nullif(o_orderpriority, '1-URGENT')), count(*) - count(nullif(o_orderpriority, '1-URGENT')), CAST((count(*) - count(nullif(o_orderpriority, '1-URGENT'))) / count(*) AS DOUBLE), min(nullif(o_orderpriority, '1-URGENT')), max(nullif(o_orderpriority, '1-URGENT')) FROM orders""")
def analyze_stats(spark, d):
    return stats.analyze(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("prio")))


def _small_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT -c_custkey, c_custkey, 'N', c_acctbal FROM customer WHERE c_custkey <= 100")
def insert_select_result(spark, d):
    c = table(spark, d, "customer").where("c_custkey <= 100")
    return dml.insert(_small_orders(spark, d), c.select(-F.col("c_custkey"), "c_custkey", F.lit("N"), "c_acctbal"))


@query("""SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN c ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey IS NULL THEN 'N' WHEN k IS NULL OR NOT (o_totalprice < 200000) THEN o_orderstatus ELSE 'U' END AS o_orderstatus, CASE WHEN o_orderkey IS NULL THEN p WHEN k IS NULL OR NOT (o_totalprice < 200000) THEN o_totalprice ELSE o_totalprice + p END AS o_totalprice
FROM orders FULL OUTER JOIN (SELECT c_custkey * 20 AS k, c_custkey AS c, c_acctbal AS p FROM customer) n ON o_orderkey = k""")
def upsert_result(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") * 20).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"))
    return dml.upsert(_small_orders(spark, d), c, ["o_orderkey"], lambda old, new: {"o_orderstatus": F.lit("U"), "o_totalprice": old("o_totalprice") + new("o_totalprice")}, lambda old, new: old("o_totalprice") < 200000)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT c_custkey * 20, c_custkey, 'N', c_acctbal FROM customer WHERE c_custkey * 20 NOT IN (SELECT o_orderkey FROM orders)")
def upsert_nothing_result(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") * 20).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"))
    return dml.upsert(_small_orders(spark, d), c, ["o_orderkey"])


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def update_result(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return dml.update(c, {"c_acctbal": F.lit(0), "c_mktsegment": F.lit("DEBT")}, F.col("c_acctbal") < 0)


@query("""SELECT c_custkey, c_name, coalesce(o.o_orderstatus, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN
(SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 150000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) o ON c_custkey = o_custkey""")
def update_from_result(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    o = table(spark, d, "orders").where("o_totalprice > 150000").select("o_orderkey", "o_custkey", "o_orderstatus")
    return dml.update_from(c, o, F.col("c_custkey") == F.col("o_custkey"), {"c_mktsegment": F.col("o_orderstatus")}, "c_custkey", [F.col("o_orderkey")])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def delete_using_result(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return dml.delete_using(_small_orders(spark, d), c, F.col("c_custkey") == F.col("o_custkey"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def delete_limit_result(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return dml.delete_using(_small_orders(spark, d), c, F.col("c_custkey") == F.col("o_custkey"), "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F')")
def delete_result(spark, d):
    return dml.delete(table(spark, d, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE FALSE")
def truncate_result(spark, d):
    return dml.delete(table(spark, d, "orders")).select("o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, n_name AS title, CAST(NULL AS INTEGER) AS age FROM nation")
def alter_add_drop_result(spark, d):
    return table(spark, d, "nation").withColumn("age", F.lit(None).cast("int")).drop("n_regionkey").withColumnRenamed("n_name", "title")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 2 OFFSET 1")
def dialect_mysql_limit(spark, d):
    _views(spark, d, "nation")
    return spark.sql(dialect.rewrite("SELECT `n_nationkey`, `n_name` FROM `nation` ORDER BY `n_nationkey` LIMIT 1, 2"))


# --- clauses with their standard meaning -----------------------------------------------------------------------------


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60")
def having(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 60")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def row_number_partition(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"))


@query("SELECT * FROM (SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier) t ORDER BY k, name LIMIT 15")
def union_order_limit(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), table(spark, d, "supplier").select("s_suppkey", "s_name")
    return c.unionAll(s).orderBy("k", "name").limit(15)


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 5")
def offset_only(spark, d):
    return table(spark, d, "supplier").select("s_suppkey").orderBy("s_suppkey").offset(5)
