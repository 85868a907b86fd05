from factloom.llm import ngram_join


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c d e", "x"), (7, "a b c d e", "x"), (7, "a b c d e", "x"), (7, "a b c d e", "w"), (None, None, "x"), (9, None, "x"), (9, None, "x"), (None, "f g h i j", "x"), (None, "f g h i j", "x"), (None, "f g h i j", None), (3, "k l m n o", "x"), (3, "p q r s t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [tuple(r) for r in ngram_join.distinct_documents(docs, n=2).collect()]
    assert len(got) == 7
    assert sorted((r[0] or 0, r[1] or "") for r in got) == [(0, ""), (0, "f g h i j"), (3, "k l m n o"), (3, "p q r s t"), (7, "a b c d e"), (9, ""), (9, "")]
    assert set(got) <= set(rows)
