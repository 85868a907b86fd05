import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.queries()["kafka_edges"](spark, "/root/testdata/sf0.001").limit(5).count() == 5
