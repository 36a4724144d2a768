"""Queries whose rows come through the SQL engine: statements over a database of their own, and their SQL twins.

Each builds a database in the scratch folder from the driver's whole tables, runs its statements, and returns what a
query sees afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scalar
from skein.plans.catalogue import bm25_sql, query
from skein.plans.engine import Engine, connect
from skein.session import register
from skein.sources.scratch import scratch_path
from skein.sources.versions import ConflictError

_ORDERS = "CREATE TABLE o (id BIGINT, cust BIGINT, status TEXT, price DOUBLE); INSERT INTO o SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_CLIENTS = "CREATE TABLE c (id BIGINT, nk INT, segment TEXT, bal DOUBLE); INSERT INTO c SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer"
_NATIONS = "CREATE TABLE n (id INT, name TEXT, region INT); INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation"
_TEXTS = "CREATE TABLE docs (id BIGINT, body TEXT); INSERT INTO docs SELECT doc_id, text FROM documents"
_INDEX = "CREATE INDEX words ON docs USING bm25 (body) WITH (text_config = 'english')"
_O = "(SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders)"
_C = "(SELECT c_custkey AS id, c_nationkey AS nk, c_mktsegment AS segment, c_acctbal AS bal FROM customer)"
_FOUND = "that onand tion stupid"
_SCORE = f"body <@ to_bm25query('{_FOUND}', 'words')"
_TERMS = [t for t in _FOUND.split() if t not in scalar.STOP_WORDS]


def _database(spark: SparkSession, sf_dir: str, *scripts: str) -> Engine:
    register(spark, sf_dir, "nation", "customer", "supplier", "orders", "documents")
    db = connect(spark, scratch_path(spark, "database"))
    for script in scripts:
        db.execute(script)
    return db


# --- INSERT and upserts


@query("SELECT * FROM (VALUES (1, 'ash', 0.5::DOUBLE), (2, NULL, 1.5), (3, 'it''s; oak', NULL), (4, 'elm', -2.0)) t(id, name, size)")
def sql_insert_values(spark, d):
    db = _database(spark, d, "CREATE TABLE trees (id INT, name TEXT, size DOUBLE)")
    db.execute("INSERT INTO trees VALUES (1, 'ash', 0.5), (2, NULL, 1.5); INSERT INTO trees (name, id) VALUES ('it''s; oak', 3)")
    db.execute("INSERT INTO trees VALUES (?, ?, ?)", [4, "elm", -2.0])
    return db.execute("SELECT id, name, size FROM trees")


@query(f"SELECT * FROM {_O} t UNION ALL SELECT -c_custkey, c_custkey, 'N', NULL FROM customer")
def sql_insert_select(spark, d):
    db = _database(spark, d, _ORDERS, "INSERT INTO o (id, cust, status) SELECT -c_custkey, c_custkey, 'N' FROM customer")
    return db.execute("SELECT * FROM o")


_UPSERT = "INSERT INTO c (id, segment, bal) SELECT s_suppkey * 20, 'N', s_acctbal FROM supplier CROSS JOIN (VALUES (1), (2)) twice(x) ON CONFLICT (id) DO"


@query("""SELECT coalesce(c_custkey, k) AS id, CASE WHEN k IS NULL THEN c_mktsegment ELSE 'U' END AS segment, round(CASE WHEN k IS NULL THEN c_acctbal ELSE coalesce(c_acctbal, 0) + 2 * s END, 2) AS bal
FROM customer FULL OUTER JOIN (SELECT s_suppkey * 20 AS k, s_acctbal AS s FROM supplier) n ON c_custkey = k""")
def sql_upsert(spark, d):
    """Each key comes twice: a new one is inserted and then updated, an old one is updated twice."""
    db = _database(spark, d, _CLIENTS, f"{_UPSERT} UPDATE SET segment = 'U', bal = c.bal + EXCLUDED.bal")
    return db.execute("SELECT id, segment, round(bal, 2) AS bal FROM c")


@query("SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey * 20, 'N', s_acctbal FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
def sql_upsert_nothing(spark, d):
    return _database(spark, d, _CLIENTS, f"{_UPSERT} NOTHING").execute("SELECT id, segment, bal FROM c")


# --- UPDATE


@query(f"SELECT id, CASE WHEN bal < 0 THEN 'DEBT' ELSE segment END AS segment, CASE WHEN bal < 0 THEN 0.0 ELSE bal END AS bal FROM {_C} t")
def sql_update(spark, d):
    return _database(spark, d, _CLIENTS, "UPDATE c SET segment = 'DEBT', bal = 0 WHERE bal < 0").execute("SELECT id, segment, bal FROM c")


@query(f"SELECT id, coalesce(n_name, segment) AS segment FROM {_C} t LEFT JOIN nation ON n_nationkey = nk AND n_regionkey = 1")
def sql_update_from(spark, d):
    db = _database(spark, d, _CLIENTS, _NATIONS, "UPDATE c SET segment = n.name FROM n WHERE c.nk = n.id AND n.region = 1")
    return db.execute("SELECT id, segment FROM c")


@query(f"SELECT id, bal + 1 AS after, n_name AS name FROM {_C} t JOIN nation ON n_nationkey = nk WHERE n_regionkey = 1")
def sql_update_returning(spark, d):
    """The returned rows outlive the snapshots: the table is truncated and vacuumed before they are read."""
    db = _database(spark, d, _CLIENTS, _NATIONS)
    found = db.execute("UPDATE c SET bal = bal + 1 FROM n WHERE c.nk = n.id AND n.region = 1 RETURNING c.id, bal AS after, name")
    db.execute("TRUNCATE TABLE c")
    db.vacuum()
    return found


# --- DELETE, TRUNCATE


@query(f"SELECT id, price FROM {_O} t WHERE NOT (status = 'F')")
def sql_delete(spark, d):
    return _database(spark, d, _ORDERS, "DELETE FROM o WHERE status = 'F'").execute("SELECT id, price FROM o")


@query(f"SELECT * FROM {_O} t WHERE cust NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def sql_delete_using(spark, d):
    return _database(spark, d, _ORDERS, _CLIENTS, "DELETE FROM o USING c WHERE o.cust = c.id AND c.segment = 'BUILDING'").execute("SELECT * FROM o")


@query(f"SELECT * FROM {_O} t WHERE id NOT IN (SELECT id FROM {_O} u WHERE status = 'O' ORDER BY price DESC, id LIMIT 25)")
def sql_delete_order_limit(spark, d):
    return _database(spark, d, _ORDERS, "DELETE FROM o WHERE status = 'O' ORDER BY price DESC, id LIMIT 25").execute("SELECT * FROM o")


@query(f"""WITH gone AS (SELECT o.id AS o, c.id AS c FROM {_O} o JOIN {_C} c ON o.cust = c.id WHERE c.segment = 'BUILDING')
SELECT 'o' AS kind, id FROM {_O} o WHERE id NOT IN (SELECT o FROM gone) UNION ALL SELECT 'c', id FROM {_C} c WHERE id NOT IN (SELECT c FROM gone)""")
def sql_delete_tables(spark, d):
    db = _database(spark, d, _ORDERS, _CLIENTS, "DELETE o, c FROM o JOIN c ON o.cust = c.id WHERE c.segment = 'BUILDING'")
    return db.execute("SELECT 'o' AS kind, id FROM o UNION ALL SELECT 'c', id FROM c")


@query(f"SELECT * FROM {_O} t WHERE status = 'P'")
def sql_delete_returning(spark, d):
    return _database(spark, d, _ORDERS).execute("DELETE FROM o WHERE status = 'P' RETURNING *")


@query("SELECT count(*) AS n FROM nation")
def sql_truncate(spark, d):
    db = _database(spark, d, _ORDERS, "TRUNCATE TABLE o; INSERT INTO o (id) SELECT n_nationkey FROM nation")
    return db.execute("SELECT count(*) AS n FROM o")


# --- DDL, statistics


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS title FROM nation")
def sql_drop_table(spark, d):
    db = _database(spark, d, _ORDERS, "DROP TABLE o; DROP TABLE IF EXISTS o; CREATE TABLE o (k BIGINT, title TEXT); CREATE TABLE IF NOT EXISTS o (x INT)")
    return db.execute("INSERT INTO o SELECT n_nationkey, n_name FROM nation; SELECT k, title FROM o")


@query(f"SELECT * FROM {_O} t WHERE cust = 7")
def sql_btree_index(spark, d):
    """All rows of the key, those inserted after the index was made too; the table lies in key order."""
    halves = [f"INSERT INTO o SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus {x} 'F'" for x in ("=", "<>")]
    db = _database(spark, d, "CREATE TABLE o (id BIGINT, cust BIGINT, status TEXT, price DOUBLE)", halves[0], "CREATE INDEX by_cust ON o (cust)", halves[1])
    return db.execute("SELECT * FROM o WHERE cust = 7")


@query(f"SELECT id, segment AS title, CAST(NULL AS INTEGER) AS age FROM {_C} t UNION ALL SELECT 0, 'NEW', 30")
def sql_alter(spark, d):
    db = _database(spark, d, _CLIENTS, "ALTER TABLE c ADD COLUMN age INT; ALTER TABLE c DROP COLUMN bal; ALTER TABLE c DROP COLUMN nk; ALTER TABLE c RENAME COLUMN segment TO title; ALTER TABLE c RENAME TO people")
    return db.execute("INSERT INTO people VALUES (0, 'NEW', 30); SELECT id, title, age FROM people")


@query("SELECT * FROM (VALUES (1, (SELECT count(*) FROM orders), false), (2, (SELECT count(*) FROM orders), true), (3, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F'), false)) t(step, row_count, stale)")
def sql_analyze_stale(spark, d):
    """ANALYZE counts, a change makes the figures stale, ANALYZE counts anew."""
    db, found = _database(spark, d, _ORDERS), []
    for step, sql in enumerate(("ANALYZE o", "DELETE FROM o WHERE status = 'F'", "ANALYZE o"), 1):
        db.execute(sql)
        known = db.statistics("o")
        found.append((step, known["stats"]["row_count"], known["stale"]))
    return spark.createDataFrame(found, "step int, row_count long, stale boolean")


# --- text search through the index


def _ranked(sql: str) -> str:
    return f"SELECT doc_id AS id, score FROM ({sql}) t"


@query(f"{_ranked(bm25_sql(_TERMS))} ORDER BY score DESC, id LIMIT 20")
def sql_bm25_rank(spark, d):
    return _database(spark, d, _TEXTS, _INDEX).execute(f"SELECT id, round({_SCORE}, 6) AS score FROM docs ORDER BY score DESC, id LIMIT 20")


@query(f"{_ranked(bm25_sql(_TERMS))} WHERE score > 0")
def sql_bm25_cte(spark, d):
    return _database(spark, d, _TEXTS, _INDEX).execute(f"WITH x AS (SELECT *, {_SCORE} AS s FROM docs) SELECT id, round(s, 6) AS score FROM x WHERE s > 0")


_CHANGED = "documents AS (SELECT doc_id, 'stupid ' || text AS text FROM main.documents WHERE lang = 'en' UNION ALL SELECT -doc_id - 1, text FROM main.documents WHERE lang <> 'en')"


@query(_ranked(bm25_sql(_TERMS, _CHANGED)))
def sql_bm25_maintained(spark, d):
    """The index follows inserts, deletes and updates; another session that opens the database finds it."""
    db = _database(spark, d, _TEXTS, _INDEX)
    db.execute("INSERT INTO docs SELECT -doc_id - 1, text FROM documents WHERE lang <> 'en'; DELETE FROM docs USING documents x WHERE docs.id = x.doc_id AND (x.lang <> 'en' OR x.lang IS NULL); UPDATE docs SET body = 'stupid ' || body WHERE id >= 0")
    db.close()
    return connect(spark, db.catalog.root).execute(f"SELECT id, round({_SCORE}, 6) AS score FROM docs")


# --- transactions, API


@query(f"SELECT id, price FROM {_O} t WHERE NOT (status = 'F')")
def sql_rollback(spark, d):
    db = _database(spark, d, _ORDERS, "BEGIN; DELETE FROM o; INSERT INTO o (id) VALUES (-1); ROLLBACK", "BEGIN; DELETE FROM o WHERE status = 'F'; COMMIT")
    return db.execute("SELECT id, price FROM o")


@query("SELECT 'reader' AS session, count(*) AS n FROM orders UNION ALL SELECT 'writer', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def sql_snapshot(spark, d):
    """An open transaction goes on reading the version that it began with, after another session's commit and vacuum."""
    reader = _database(spark, d, _ORDERS, "BEGIN")
    writer = connect(spark, reader.catalog.root)
    writer.execute("DELETE FROM o WHERE status = 'F'")
    writer.vacuum()
    return reader.execute("SELECT 'reader' AS session, count(*) AS n FROM o").unionAll(writer.execute("SELECT 'writer', count(*) AS n FROM o"))


@query(f"SELECT id, bal + 2 AS bal, '40001' AS state FROM {_C} t")
def sql_conflict(spark, d):
    """Of two transactions that change the same rows the second to commit fails and leaves nothing."""
    late = _database(spark, d, _CLIENTS, "BEGIN; UPDATE c SET bal = bal + 1")
    connect(spark, late.catalog.root).execute("UPDATE c SET bal = bal + 2")
    state = "none"
    try:
        late.execute("COMMIT")
    except ConflictError as e:
        state = e.state
    return late.execute("SELECT id, bal, ? AS state FROM c", [state])


@query(f"SELECT id, bal + 2 AS bal FROM {_C} t")
def sql_vacuum(spark, d):
    db = _database(spark, d, _CLIENTS, "UPDATE c SET bal = bal + 1; UPDATE c SET bal = bal + 1")
    db.vacuum()
    return connect(spark, db.catalog.root).execute("SELECT id, bal FROM c")


@query("SELECT 100000 AS above, count(*) AS n FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 200000, count(*) FROM orders WHERE o_totalprice > 200000")
def sql_prepared(spark, d):
    ready = _database(spark, d, _ORDERS).prepare("SELECT CAST($1 AS INT) AS above, count(*) AS n FROM o WHERE price > $1")
    return ready.execute(100000).unionAll(ready.execute(200000))


@query(f"SELECT id, CASE WHEN id IN (SELECT s_suppkey FROM supplier) THEN -1.0 ELSE bal END AS bal FROM {_C} t WHERE nk <> 3 UNION ALL SELECT -5, 0.5")
def sql_bulk(spark, d):
    db = _database(spark, d, _CLIENTS)
    db.insert_many("c", [(-5, None, "X", 0.5)])
    db.update_many("c", "id", spark.table("supplier").select(F.col("s_suppkey").alias("id"), F.lit(-1.0).alias("bal")))
    db.delete_many("c", "nk", [3, 99])
    return db.execute("SELECT id, bal FROM c")


@query("SELECT 1 AS step, count(*) AS n FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus = 'F'")
def sql_explain_analyze(spark, d):
    """The rows that EXPLAIN ANALYZE counts."""
    db = _database(spark, d, _ORDERS)
    found = [(1, db.explain_analyze("SELECT id FROM o").rows), (2, db.execute("EXPLAIN ANALYZE SELECT id FROM o WHERE status = 'F'").first().rows)]
    return spark.createDataFrame(found, "step int, n long")
