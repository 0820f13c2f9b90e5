import numpy as np
import pytest

from pyspark.sql import functions as F

from quarry.functions.vectors import cosine
from quarry.operators import routing
from quarry.operators.ranking import top

SCHEMA = "code long, scope int, vector array<float>, lexical long, relation double"


@pytest.fixture(scope="module")
def codes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)) if i % 7 else None, [float(x) for x in rng.normal(size=8)], i % 5, i % 10 / 10) for i in range(700)]
    # copies, vectors of another length, without direction, without components, odd ones and codes without key
    rows += [(1000 + i, 1, rows[3][2], 3, 0.9) for i in range(40)]
    rows += [(2000, 1, [1.0, 2.0], 4, 0.9), (2001, 1, [0.0] * 8, 4, 0.9), (2002, 1, None, 4, 0.9), (2003, 1, [1.0] * 7 + [None], 4, 0.9), (2004, 2, [float("nan")] + [1.0] * 7, 1, 0.1), (None, 1, rows[3][2], 4, 0.9)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def by_pairs(asked, codes, k):
    """Every pair scored as a column."""
    own = codes.where("code IS NOT NULL").crossJoin(asked.withColumnRenamed("scope", "l"))
    score = routing.route_score(cosine(F.col("query_vector"), F.col("vector")), F.col("lexical"), F.lit(0), F.lit(0.0), F.col("l") == F.col("scope"), F.col("relation"))
    return top(own.select("query", "code", score.alias("score")).where("score > 0"), k, F.desc("score"), F.col("code"))


def test_near_routes_are_those_of_all_pairs(spark, codes):
    asked = codes.where("code % 100 = 3 OR code BETWEEN 2000 AND 2002").select(F.col("code").alias("query"), "scope", F.col("vector").alias("query_vector"))
    rows = lambda df: sorted((r.query, r["rank"], r.code, repr(r.score)) for r in df.collect())
    want = rows(by_pairs(asked, codes, 8))
    assert len(want) > 80 and rows(routing.near_routes(asked, codes, 8)) == want
    assert routing.near_routes(asked.limit(0), codes, 8).count() == 0
    assert routing.near_routes(asked, codes.limit(0), 8).count() == 0


def test_routes_make_no_row_a_pair(spark, small):
    """No plan pairs all questions with all codes: that took time with the square of the table."""
    from quarry.registry import QUERIES

    plan = QUERIES["topic_routes"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" not in plan


def test_confidence_is_rounded_once(spark, monkeypatch):
    from quarry.plans import knowledge

    # 0.53946 is 0.539, but 0.5395 and then 0.54 when rounded to four decimals before
    best, second = 20.0, 20.0 / 0.53946 - 25
    monkeypatch.setattr(knowledge, "routes", lambda spark, sf: spark.createDataFrame([(1, 10, best, 1), (1, 11, second, 2)], "query long, code long, score double, rank int"))
    assert knowledge.route_confidence(spark, "").first().confidence == 0.539
