"""Values of texts: written out, and read once a text by compiled patterns."""

from pyspark.sql import functions as F

from quarry.operators import safety as S


def test_values_and_quantities(spark):
    texts = ["１,２３４.5元，两百三十万元 [3] 十二个月", "第 5 条 M3 3类 7", "12 万元", "a5 5b 1,234,567 天 3％", None, "", "一千零五元 百元 二三年", "5　天 6\u001c天"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string").repartition(2)
    found = df.select("n", S.quantities(F.col("t")).alias("q"), S.token_values(F.col("t")).alias("v"))
    got = {r.n: ([(x.value, x.unit) for x in r.q], r.v) for r in found.collect()}
    assert got[0] == ([(1234.5, "元"), (2300000.0, "万元"), (12.0, "个月")], [12.0, 1234.5, 2300000.0])
    assert got[1] == ([], [7.0]) and got[2] == ([(120000.0, "万元")], [12.0, 120000.0])
    assert got[3] == ([(1234567.0, "天"), (3.0, "％")], [3.0, 1234567.0]) and got[4] == got[5] == ([], [])
    assert got[6] == ([(5.0, "元"), (100.0, "元"), (3.0, "年")], [3.0, 5.0, 100.0]) and got[7][0] == [(5.0, "天")]


def test_values_are_read_once_a_text(spark, small):
    """Patterns and folds over characters were higher-order functions, each worked out anew for each column."""
    from quarry.registry import QUERIES

    for name in ("quantity_values", "number_mismatches"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "aggregate(" not in plan
