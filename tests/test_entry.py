import __spark_entry__ as entry


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() > 0
