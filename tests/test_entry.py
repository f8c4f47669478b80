import __spark_entry__


def test_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert queries and set(sql) <= set(queries)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
