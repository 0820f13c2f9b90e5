"""Nearest vectors from cells against all pairs."""

import numpy as np
import pytest

from quarry.operators import cells as C
from quarry.operators.ranking import unit_rows


@pytest.mark.parametrize(("n", "k", "first"), [(1, 5, 1), (12, 5, 1), (40, 3, 2), (12, 500, 2)])
def test_nearest_is_exact(spark, tmp_path, n, k, first):
    rng = np.random.default_rng(n)
    middles = rng.normal(size=(10, 8)) * 3
    x = [(int(i), (middles[i % 10] + rng.normal(size=8) * 0.3).tolist()) for i in range(400)] + [(500 + i, middles[3].tolist()) for i in range(150)]
    x += [(700, None), (701, [0.0] * 8), (702, [1.0, 2.0])]
    q = [(i, (middles[i % 10] + rng.normal(size=8) * 0.2).tolist()) for i in range(20)] + [(90, [0.0] * 8), (91, None)]
    corpus = spark.createDataFrame(x, "chunk long, vector array<double>").repartition(4)
    index = C.write_cells(corpus, str(tmp_path / "cells"), n, 8)
    found, share = C.nearest_by_cells(index, spark.createDataFrame(q, "query long, query_vector array<double>"), k, first)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.chunk)
    names = np.array([i for i, _ in x])
    scores = unit_rows([v for _, v in q], 8) @ unit_rows([v for _, v in x], 8).T
    want = {i: names[np.lexsort((names, -np.round(s, 12)))[:k]].tolist() for (i, _), s in zip(q, scores, strict=True)}
    assert got == want
    assert share <= 1 and (share < 0.6 or n == 1 or k == 500)


def test_cells_edges(spark, tmp_path):
    none = spark.createDataFrame([], "chunk long, vector array<double>")
    index = C.write_cells(none, str(tmp_path / "none"), 4, 8)
    asked = spark.createDataFrame([(1, [1.0] * 8)], "query long, query_vector array<double>")
    assert C.nearest_by_cells(index, asked)[0].count() == 0 and C.nearest_by_cells(index, asked.limit(0))[0].count() == 0
