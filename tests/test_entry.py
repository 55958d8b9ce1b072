import __spark_entry__ as entry


def test_registered_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    assert {"symbol", "x", "mean"} <= set(entry.entry(spark).columns)
