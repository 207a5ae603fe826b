import __spark_entry__ as entry


def test_names_agree(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "masked", "n_values"]
