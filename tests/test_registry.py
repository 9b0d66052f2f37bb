import __spark_entry__


def test_names_have_sql_or_a_reason():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and "agg1_ctr_by_category" in q


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
