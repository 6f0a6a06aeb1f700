import __spark_entry__ as entry_module


def test_names_match():
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 50


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
