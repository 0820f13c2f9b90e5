"""The table function of questions: fusion from SQL, its checks and edges."""

import pytest

from quarry.functions import tables


def test_rag_search(spark):
    tables.register(spark)
    rows = [("q", 1, "vector", 1), ("q", 2, "vector", 2), ("q", 2, "keyword", 1), ("q", 3, "keyword", 2), ("q", 3, "keyword", 9), ("q", None, "vector", 3), ("q", 4, "other", 1), ("r", 9, "keyword", 5), ("s", 1, "vector", None)]
    df = spark.createDataFrame(rows, "query string, chunk long, channel string, rank long").repartition(4)
    got = spark.sql("SELECT * FROM rag_search(TABLE(SELECT * FROM {df}), 2)", df=df).collect()
    assert sorted(map(tuple, got)) == [("q", 2, round(1 / 32 + 1 / 31, 6), "hybrid", 2, 1, 1), ("q", 3, round(1 / 32 + 1 / 39, 6), "keyword", None, 2, 2), ("r", 9, 0.028571, "keyword", None, 5, 1)]
    assert spark.sql("SELECT * FROM rag_search(TABLE(SELECT * FROM {df}), 2)", df=df.limit(0)).count() == 0
    for call, said in (("TABLE(SELECT 1 AS query), 2", "lack"), ("TABLE(SELECT * FROM {df}), 0", "constant"), ("3, 2", "table")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM rag_search({call})", df=df).collect()
