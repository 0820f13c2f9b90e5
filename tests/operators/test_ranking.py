import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.operators import ranking as R


def hits(spark, rows, extra=""):
    return spark.createDataFrame(rows, "query int, chunk string, score double, rank int" + extra)


def test_fusion_adds_up_and_breaks_ties(spark):
    v = hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "d", 0.7, 3)])
    k = hits(spark, [(1, "b", 5.0, 1), (1, "c", 4.0, 2), (1, "a", 3.0, 2)])
    got = [(r.chunk, r.channel, r.rrf_score) for r in R.fuse(v, k).orderBy("rank").collect()]
    s = lambda *ranks: round(sum(1 / (30 + r) for r in ranks), 6)
    assert got == [("a", "hybrid", s(1, 2)), ("b", "hybrid", s(1, 2)), ("c", "keyword", s(2)), ("d", "vector", s(3))]


def test_gates_and_cuts(spark):
    v = hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.4, 2), (1, "c", 0.1, 3), (2, "z", -0.5, 1)])
    assert {(r.query, r.chunk) for r in R.vector_gate(v).collect()} == {(1, "a"), (1, "b")}
    assert {(r.query, r.chunk) for r in R.vector_gate(hits(spark, [(1, "a", 0.5, 1), (1, "b", 0.2, 2)]), 0).collect()} == {(1, "a")}
    assert R.keyword_gate(hits(spark, [(1, "a", 0.0, 1), (1, "b", -1.0, 2)])).count() == 2
    many = hits(spark, [(1, f"c{i}", 1.0 / i, i) for i in range(1, 30)])
    assert {r.rank for r in R.adaptive_k(many, 3, 20, 0.2).collect()} == {1, 2, 3, 4, 5}
    assert R.adaptive_k(many, most=0).count() == 29
    assert [r.chunk for r in R.long_context_order(many.where("rank <= 5")).orderBy("position").collect()] == ["c1", "c3", "c5", "c4", "c2"]


def test_rerank_guard_and_filter(spark):
    h = hits(spark, [(1, "a", 0.5, 1), (1, "b", 0.9, 2), (1, "c", 0.6, 3), (2, "x", 0.1, 1)]).withColumn("rrf_score", F.lit(0.1))
    ranked = R.rerank(h, F.col("score"), head=2)
    assert [(r.chunk, r.rank) for r in ranked.where("query = 1").orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    assert ranked.where("query = 2").first().rerank_score == 0
    assert [r.chunk for r in R.guard_leader(ranked, 0.5).where("query = 1").orderBy("rank").collect()] == ["a", "b", "c"]
    assert R.rerank_filter(ranked, ratio=0.9, final_k=1).where("query = 1").count() == 2
    assert R.rerank_filter(ranked, ratio=0.9, final_k=16).where("query = 1").count() == 3


def test_parents(spark):
    rows = [(1, "a", 0.5, 1, "p", 0.0, "child a"), (1, "b", 0.7, 2, "p", 0.0, "child b"), (1, "c", 0.7, 3, None, 0.0, "web"), (1, "d", 0.1, 4, "gone", 0.0, "orphan")]
    h = spark.createDataFrame(rows, "query int, chunk string, score double, rank int, parent string, rerank_score double, content string")
    parents = spark.createDataFrame([("p", "A > B", "x" * 5000)], "parent string, path string, parent_text string")
    got = R.elevate_parents(h, parents).orderBy("rank").collect()
    assert [r.chunk for r in got] == ["c", "b", "d"]
    assert got[1].content.startswith("【章节路径：A > B】") and len(got[1].content) == 4003 and got[1].child_text == "child b"


def test_budget_is_no_running_sum(spark):
    df = spark.createDataFrame([(["a" * 600, "b" * 600, "c" * 300],)], "x array<string>")
    (kept,) = df.select(R.within_budget(F.col("x"), 1000, 500).alias("k")).first()
    assert [len(x) for x in kept] == [600, 300]


def test_merges(spark):
    a, b = hits(spark, [(1, "a", 0.1, 1), (1, "b", 0.2, 2)]), hits(spark, [(1, "b", 0.9, 1), (1, "c", 0.3, 2)])
    assert [(r.chunk, r.score) for r in R.keep_best(a.withColumn("rerank_score", F.lit(0.0)), b.withColumn("rerank_score", F.lit(0.0))).orderBy("rank").collect()] == [("b", 0.9), ("c", 0.3), ("a", 0.1)]
    assert [r.chunk for r in R.primary_first(a, b, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    scored = a.withColumn("rerank_score", F.lit(0.0))
    again = R.corrected(scored, F.col("score") > 0.5, lambda poor: poor.select("query", F.lit("n").alias("chunk"), F.lit(0.9).alias("score"), F.lit(0.0).alias("rerank_score")))
    assert {r.chunk for r in again.collect()} == {"a", "b", "n"}
    hop = R.multi_hop(spark.createDataFrame([(1, "q")], "query int, text string"), lambda q: q.select("query", F.col("text").alias("chunk")), lambda q, h: q.select("query", F.concat("text", F.lit("2")).alias("text")))
    assert {r.chunk for r in hop.collect()} == {"q", "q2"}


def test_metrics_without_gold_are_null(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b"]), (["a"], [])], "hits array<string>, gold array<string>")
    h, g = F.col("hits"), F.col("gold")
    first, second = df.select(E.recall_at(h, g, 2), E.mrr(h, g), E.ndcg_at(h, g, 2)).collect()
    assert first[0] == 1 and first[1] == 0.5 and abs(first[2] - 0.6309297) < 1e-6
    assert list(second) == [None, None, None]


def test_mcnemar_and_auc(spark):
    df = spark.createDataFrame([(True, False)] * 8 + [(False, True)] + [(True, True)] * 5, "x boolean, y boolean")
    row = E.mcnemar(df, F.col("x"), F.col("y")).first()
    assert (row.b, row.c) == (8, 1) and abs(row.p - 0.0390625) < 1e-9
    p = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "p double, label int")
    assert E.auc(p, "p", "label").first().auc == 0.875


def test_bootstrap_agrees_with_plain_resampling(spark):
    from quarry.operators import evaluation as E

    rng = np.random.default_rng(3)
    d = rng.normal(0.05, 0.5, 400)
    df = spark.createDataFrame([("m", i, 0.0, float(x)) for i, x in enumerate(d)] + [("n", i, 0.0, -1.0) for i in range(5)], "metric string, question_id long, x double, y double")
    rows = {r.metric: r for r in E.bootstrap(df, "metric").collect()}
    means = np.sort([rng.choice(d, len(d)).mean() for _ in range(4000)])
    m = rows["m"]
    assert abs(m.delta - d.mean()) < 1e-12 and abs(m.low - means[100]) < 0.012 and abs(m.high - means[3900]) < 0.012
    assert abs(m.p_value - 2 * min((means <= 0).mean(), (means > 0).mean())) < 0.05
    assert (rows["n"].delta, rows["n"].low, rows["n"].high, rows["n"].p_value) == (-1.0, -1.0, -1.0, 0.0)
    again = {r.metric: r for r in E.bootstrap(df.repartition(7), "metric").collect()}["m"]
    assert np.allclose(again[1:], m[1:])


def test_text_ndcg(spark):
    from quarry.operators import evaluation as E

    rows = [(["alpha beta", "gamma delta", "alpha beta"], ["alpha beta", "alpha", "gamma"], 0), (["nothing"], ["alpha"], 1), ([], ["alpha"], 2), (["alpha"], [], 3)]
    df = spark.createDataFrame(rows, "hits array<string>, gold array<string>, n int")
    got = {r.n: r.x for r in df.select("n", E.text_ndcg_at(F.col("hits"), F.col("gold"), 2).alias("x")).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}


def test_keyword_channel(spark):
    from quarry.operators import lexical as L

    chunks = spark.createDataFrame(
        [(1, "制度 > 第5条", "差旅办法", "hr", "住宿标准 A类城市 M3 每晚"), (2, "制度 > 第6条", "差旅办法", "hr", "报销流程 **5.1 说明"), (3, "其他", "考勤", "hr", "travel rules for all"), (4, "其他", "考勤", "hr", "nothing here")],
        "chunk long, section_path string, document_name string, scope_name string, chunk_text string",
    )
    queries = spark.createDataFrame([(1, "第五条", []), (2, "M3 在A类城市的标准", []), (3, "travel", ["rules"]), (4, "5.1 是什么", []), (5, "《差旅办法》说", [])], "query int, text string, hints array<string>")
    got = {q: [r.chunk for r in rows] for q, rows in itertools.groupby(L.keyword_channel(queries, chunks).orderBy("query", "rank").collect(), lambda r: r.query)}
    assert got[1][0] == 1 and got[2][0] == 1 and got[3][0] == 3 and got[4][0] == 2 and set(got[5]) >= {1, 2}
    scores = {(r.query, r.chunk): r.score for r in L.keyword_channel(queries, chunks).collect()}
    assert scores[5, 1] >= 5.0 + 6.0 and scores[4, 2] >= 6.0 + 8.0


def test_character_pairs_are_exact(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdeé 字"), n))
    snippets, texts = [(i, word(rng.integers(0, 30))) for i in range(40)], [(i, word(rng.integers(0, 400))) for i in range(60)]

    def pairs(t):
        t = "".join(c for c in t.lower() if c in "字" or (c.isascii() and (c.isalnum() or c == "_")))
        return {t[i : i + 2] for i in range(len(t) - 1)}

    want = {(i, j) for i, s in snippets for j, t in texts if pairs(s) and len(pairs(s) & pairs(t)) / len(pairs(s)) >= 0.5}
    found = E.overlap_pairs(spark.createDataFrame(snippets, "snippet long, text string"), spark.createDataFrame(texts, "chunk long, text string"), 0.5)
    assert {(r.snippet, r.chunk) for r in found.collect()} == want
    contained = spark.createDataFrame([(1, texts[3][1][:20] or "a")], "snippet long, text string")
    assert 3 in {r.chunk for r in E.align_gold(contained, spark.createDataFrame(texts, "chunk long, text string")).collect()}


def test_facts_are_taken_one_by_one(spark):
    rng = np.random.default_rng(9)
    seeds = rng.standard_normal((6, 8))
    rows = [(int(u), i, [float(x) for x in seeds[rng.integers(0, 6)] + 0.3 * rng.standard_normal(8)]) for i, u in enumerate(rng.integers(0, 3, 300))]
    want = []
    for u in range(3):
        kept = []
        for _, i, v in (r for r in rows if r[0] == u):
            x = np.array(v) / np.linalg.norm(v)
            if not kept or max(float(k @ x) for k in kept) <= 0.92:
                kept.append(x)
                want.append(i)
    df = spark.createDataFrame(rows, "user int, fact long, vector array<double>")
    assert sorted(r.fact for r in R.insert_facts(df).collect()) == sorted(want)
    for most in (7, 60):
        assert sorted(r.fact for r in R.insert_facts(df, most=most).collect()) == sorted(want)


def test_facts_in_rounds_keep_odd_rows(spark):
    v = [1.0, 0.0, 0.0]
    odd = [(None, 1, v), (None, 2, v), (None, 3, None), (7, 1, v), (7, 1, v), (7, 2, [2.0, 0.0, 0.0]), (7, 3, None), (7, 4, [1.0, 0.0]), (7, 5, [0.0, 0.0, 0.0]), (7, 6, [0.0, 1.0, 0.0]), (7, 6, [0.0, 3.0, 0.0]), (8, 1, v)]
    df = spark.createDataFrame(odd, "user int, fact long, vector array<double>").withColumn("extra", R.F.lit("x"))
    want = [(None, 1), (None, 3), (7, 1), (7, 3), (7, 4), (7, 5), (7, 6), (8, 1)]
    for most in (1, 3, 100):
        got = R.insert_facts(df, most=most)
        assert got.columns == df.columns
        assert sorted(((r.user, r.fact) for r in got.collect()), key=str) == sorted(want, key=str)
    assert R.insert_facts(df.limit(0)).count() == 0


def test_nearest_agrees_with_pairs(spark):
    rng = np.random.default_rng(10)
    corpus = [(i, [float(x) for x in rng.standard_normal(5).round(1)] if i % 7 else None) for i in range(500)] + [(900, [0.0] * 5), (901, [1.0, 2.0])]
    queries = [(i, [float(x) for x in rng.standard_normal(5).round(1)]) for i in range(9)]
    c, q = spark.createDataFrame(corpus, "chunk long, vector array<double>"), spark.createDataFrame(queries, "query int, query_vector array<double>")
    fast = {(r.query, r.rank): (r.chunk, round(r.score, 9)) for r in R.vector_channel(q, c, 12).collect()}
    slow = {(r.query, r.rank): (r.chunk, round(r.score, 9)) for r in R.vector_channel(q, c, 12, lambda d: d).collect()}
    assert fast == slow and len(fast) == 108


def test_prefixes_of_many_lengths(spark):
    paths = [("a" * 300 + "/x",), ("B/c",), ("",), (None,)]
    p = spark.createDataFrame(paths, "path string")
    many = [(i, "A" * i) for i in range(310)] + [(400, "b/C"), (401, "c"), (402, None)]
    for rows in (many, many[-4:], [(1, "A" * 301)], []):
        want = {q for q, x in rows if x is not None and any(t is not None and t.lower().startswith(x.lower()) for (t,) in paths)}
        assert {r.query for r in R.validated_prefixes(spark.createDataFrame(rows, "query int, prefix string"), p).collect()} == want
