"""Every query of the catalogue against its SQL twin."""

import collections
import math

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import scalar
from skein.operators import search
from skein.plans import catalogue, dialect, statements  # noqa: F401
from skein.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def bag(rows):
    return collections.Counter(tuple(round(v, 5) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = bag(df.select(*columns).collect())
    assert got == bag(duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]}) t").fetchall())


def test_ordered_queries(spark, duck):
    for name in ("order_multi_key", "topk", "limit_offset", "join_group_agg"):
        df = catalogue.QUERIES[name](spark, SF)
        assert bag(enumerate_rows(df.collect())) == bag(enumerate_rows(duck.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[name]}) t").fetchall()))


def enumerate_rows(rows):
    return [(i, *r) for i, r in enumerate(rows)]


def test_filters_reach_the_scan(spark):
    plan = catalogue.index_lookup_eq(spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,7)]" in plan and "l_comment" not in plan
    assert "TakeOrderedAndProject" in catalogue.topk(spark, SF)._jdf.queryExecution().toString()


def test_scalar_edges(spark):
    one = spark.range(1)
    big = F.lit(2**63 - 1)
    row = one.select(scalar.sat_add(big, F.lit(1)).alias("a"), scalar.sat_sub(-big, F.lit(9)).alias("b"), scalar.sat_mul(big, F.lit(-2)).alias("c"), scalar.concat(F.lit("a"), F.lit(None), F.lit(3)).alias("d"), scalar.int_div(F.lit(-7), F.lit(2)).alias("e"), scalar.trim_space(F.lit("  x\t")).alias("f"), scalar.vector_text(scalar.to_vector(F.lit("[1,2.5]"))).alias("g"), F.unix_timestamp(scalar.parse_timestamp(F.lit("2024-01-01T00:00:00Z"))).alias("h"), F.unix_timestamp(scalar.parse_timestamp(F.lit("1704067200"))).alias("i"), scalar.local_bm25(F.lit(None).cast("string"), ["x"]).alias("j")).first()
    assert tuple(row) == (2**63 - 1, -(2**63), -(2**63), "a3", -3, "x", "[1.0,2.5]", 1704067200, 1704067200, 0.0)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT `a` FROM t LIMIT 5, 10", "SELECT `a` FROM t LIMIT 10 OFFSET 5"),
        ("SELECT a FROM t LIMIT x, 10", "SELECT a FROM t LIMIT x, 10"),
        ('SELECT "a""b" FROM t', 'SELECT `a"b` FROM t'),
        ("SELECT 'LIMIT 1, 2 <-> `'", "SELECT 'LIMIT 1, 2 <-> `'"),
        ("vec <=> '[1,0]' < 0.3", "cosine_distance(vec, to_vector('[1,0]')) < 0.3"),
        ("t.vec <-> f(a, b) + 1", "l2_distance(t.vec, f(a, b)) + 1"),
        ("(a) <-> (b) AS d -- a <-> b", "l2_distance((a), (b)) AS d -- a <-> b"),
        ("c <@ to_bm25query('q', 'i')", "bm25_score(c, to_bm25query('q', 'i'))"),
        ("c <@ NULL", "bm25_score(c, array())"),
        ("x = $1 AND y = ?2", "x = :p1 AND y = :p2"),
    ],
)
def test_dialect(sql, want):
    assert dialect.rewrite(sql) == want


@settings(max_examples=300, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(max_size=60))
def test_dialect_never_breaks(text):
    try:
        for part in dialect.split_script(text):
            dialect.rewrite(part)
    except dialect.DialectError as e:
        assert e.code.startswith("POLYGLOT_E_")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**15), 2**15), st.integers(0, 5)), min_size=1, max_size=39))
def test_row_number_is_a_sort(spark, pairs):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id long, a int, b int")
    found = catalogue.number_rows(df, [F.col("a").desc(), F.col("id").asc()], "rn").collect()
    assert [r.id for r in sorted(found, key=lambda r: r.rn)] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r.rn for r in found) == list(range(1, len(rows) + 1))


@settings(max_examples=200)
@given(st.text(max_size=50))
def test_query_terms_are_tokens(text):
    terms = scalar.query_terms(text)
    assert all(t and all(c.isalpha() or c.isnumeric() for c in t) for t in terms)
    assert scalar.query_terms(text, "english") == [t for t in terms if t not in scalar.STOP_WORDS]


def test_postings_of_odd_ids(spark):
    """Rows that share an id are one document, those without id are one too; null and empty texts have no terms."""
    docs = spark.createDataFrame([(1, "pear Pear plum"), (1, "pear"), (None, "fig"), (None, "fig the"), (2, None), (3, "")], "id long, body string")
    found = {(r.id, r.term): r.tf for r in search.postings(docs, "id", "body").collect()}
    assert found == {(1, "pear"): 3, (1, "plum"): 1, (None, "fig"): 2}
    assert search.postings(docs.limit(0), "id", "body").count() == 0


def test_scores_in_one_cut(spark):
    """Scores of the written counts are those beside the rows, with repeated terms, without terms and without rows."""
    docs = spark.createDataFrame([(1, "pear Pear plum"), (2, "PLUM fig"), (3, None), (4, ""), (None, "fig")], "id long, body string")
    for text in ("pear plum pear", "nothing", "the", ""):
        want = sorted(r.score for r in search.with_score(docs, "body", text).collect())
        assert sorted(r.score for r in search.scores(docs, "id", "body", text).collect()) == pytest.approx(want)
        assert search.scores(docs.limit(0), "id", "body", text).count() == 0
    assert {r.id: r.score > 0 for r in search.scores(docs, "id", "body", "fig").collect()} == {1: False, 2: True, 3: False, 4: False, None: True}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_only_a_to_z_become_small(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    scalar.install(spark)
    small = str.maketrans(scalar.UPPER, scalar.LOWER)
    rows = spark.createDataFrame([(t,) for t in [*texts, "ÀÉ Iİ ẞ A", "ABC z"]], "x string").select("x", scalar.ascii_lower("x").alias("y"), F.expr("ascii_lower(x)").alias("z")).collect()
    assert all(r.y == r.z == r.x.translate(small) for r in rows)
