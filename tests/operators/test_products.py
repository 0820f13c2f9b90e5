import re

import numpy as np
import pytest

from quarry.operators import evaluation as E
from quarry.operators import ranking as R
from quarry.registry import QUERIES


def pairs_of(text):
    s = re.sub("[^\u4e00-\u9fffA-Za-z0-9_]", "", text or "").lower()
    return {s[i : i + 2] for i in range(len(s) - 1)}


def test_overlaps_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta", "g_2", "中文字", "zz", "q"], n))
    snippets = [(i, text(6)) for i in range(20)] + [(90, "x"), (91, None)]
    texts = [(i, text(int(rng.integers(1, 9)))) for i in range(1200)] + [(5000, None), (5001, "")]
    want = {(s, c): len(a & b) / len(a) for s, t in snippets for c, u in texts if (a := pairs_of(t)) and len(a & (b := pairs_of(u))) / len(a) >= 0.5}
    got = E.overlap_pairs(spark.createDataFrame(snippets, "snippet long, text string"), spark.createDataFrame(texts, "chunk long, text string"), 0.5).collect()
    assert len(got) == len(want) and {(r.snippet, r.chunk): r.ratio for r in got} == pytest.approx(want)


def test_facts_of_own_user_only(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [None, 1, 2, 3][i % 4], i % 3, i % 5, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(900 + i, 1, i % 3, 4, rows[1][4]) for i in range(20)] + [(950, 1, 0, 9, None), (951, 1, 0, 9, [0.0] * 4)]
    facts = spark.createDataFrame(rows, "fact long, user int, category int, edited int, vector array<double>")
    queries = facts.where("fact < 8").selectExpr("fact AS query", "user", "vector AS query_vector")
    want = []
    for q, u, _, _, v in rows[:8]:
        near = sorted((round(1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 12), f, c, e) for f, x, c, e, w in rows if u is not None and x == u and w and any(w))
        near = [n for n in near if n[0] <= 0.7][:50]
        latest = [min((-e, d, f) for d, f, x, e in near if x == c) for c in {n[2] for n in near}]
        want += [(q, f, rank) for rank, (d, f) in enumerate(sorted((d, f) for _, d, f in latest), 1)]
    assert sorted((r.query, r.fact, r["rank"]) for r in R.recall_facts(queries, facts).collect()) == sorted(want)


def test_no_plan_pairs_all_rows(spark, small):
    plan = lambda name: QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan("text_recall") + plan("gold_align_bigram") and "Join Inner" not in plan("text_recall")
    assert "aggregate(zip_with" not in plan("fact_recall")
