import numpy as np
from pyspark.sql import functions as F

from quarry.operators import lexical as L
from quarry.operators.ranking import top


def by_postings(queries, chunks, fields, k):
    """Every posting as a row."""
    terms = L.query_terms(queries)
    scored = [L.bm25(L.sorted_postings(chunks, "chunk", f, terms), terms, L.corpus_size(chunks, f)).withColumn("score", F.col("score") * w) for f, w in fields.items()]
    whole = scored[0]
    for s in scored[1:]:
        whole = whole.unionByName(s)
    return top(whole.groupBy("query", "chunk").agg(F.max("score").alias("score"), F.max("matched").alias("matched")), k, F.round("score", 9).desc(), F.col("chunk"))


def rows(df):
    return sorted((r.query, r["rank"], r.chunk, round(r.score, 8), r.matched) for r in df.collect())


def test_best_are_those_of_all_postings(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"W{i}" for i in rng.zipf(1.4, n) % 60)
    docs = [(i, text(int(rng.integers(1, 60))), text(3)) for i in range(400)]
    # copies are ties; texts without words, with CJK characters, and none
    docs += [(1000 + i, docs[7][1], "w1") for i in range(30)] + [(2000, None, None), (2001, "", "--"), (2002, "第3条 w1中文", "中"), (2003, "w5 " * 20_000, "w5")]
    chunks = spark.createDataFrame(docs, "chunk long, body string, title string").repartition(5)
    queries = spark.createDataFrame([(i, text(int(rng.integers(1, 12)))) for i in range(12)] + [(50, "中文 w1"), (51, ""), (52, None), (53, "absent words")], "query long, text string")
    for fields in ({"body": 1.0}, {"body": 1.0, "title": 3.0}):
        want = rows(by_postings(queries, chunks, fields, 15))
        assert len(want) > 100 and rows(L.bm25_best(queries, chunks, fields, 15)) == want
    assert L.bm25_best(queries.limit(0), chunks, {"body": 1.0}, 5).count() == 0
    assert L.bm25_best(queries, chunks.limit(0), {"body": 1.0}, 5).count() == 0


def test_keyword_queries_shuffle_no_postings(spark, small):
    """Each word of each text was a row that went through a shuffle: the plan held Generate below an Exchange."""
    from quarry.registry import QUERIES

    for name in ("bm25_topk", "section_search"):
        assert "Generate" not in QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_channel_adds_boosts_and_hints_as_written_out(spark, tmp_path):
    """Against brute force; pairs of queries and chunks were a cross join, and words and hits went through shuffles."""
    from quarry.functions import text as T

    rng = np.random.default_rng(9)
    pick = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma", "第3条", "第十二条", "5.1", "**6.2", "M3", "A类城市", "delta", "《差旅办法》", "M10"], n))
    docs = [(i, f"制度 > 第{i % 14}条 {pick(2)}", ["差旅办法", "考勤办法beta", None, "alpha"][i % 4], "hr beta", pick(int(rng.integers(0, 12)))) for i in range(150)] + [(900, None, None, None, None), (901, "第3条", "差旅办法", "", "")]
    asked = [(i, pick(int(rng.integers(1, 6))), [pick(2) for _ in range(int(rng.integers(0, 8)))] + [" "]) for i in range(25)] + [(50, "", []), (51, None, None), (52, "zz", ["beta", "beta", "beta alpha"])]
    chunks = spark.createDataFrame(docs, "chunk long, section_path string, document_name string, scope_name string, chunk_text string").repartition(3)
    queries = spark.createDataFrame(asked, "query int, text string, hints array<string>")
    total = {}
    terms = L.query_terms(queries)
    for f, w in L.FIELDS.items():
        for r in L.bm25(L.sorted_postings(chunks, "chunk", f, terms), terms, L.corpus_size(chunks, f)).collect():
            total[r.query, r.chunk] = max(total.get((r.query, r.chunk), 0), r.score * w)
    hints = spark.createDataFrame([(q * 100 + i, h) for q, _, hs in asked for i, h in enumerate([h for h in hs or [] if h.strip()][:5])], "query int, text string")
    own = L.query_terms(hints)
    for r in L.bm25(L.sorted_postings(chunks, "chunk", "chunk_text", own), own, L.corpus_size(chunks, "chunk_text"), F.lit(1)).collect():
        total[r.query // 100, r.chunk] = total.get((r.query // 100, r.chunk), 0) + 2 * r.score
    fields = chunks.select("chunk", T.chunk_exact_fields(F.col("section_path"), F.col("chunk_text")).alias("f")).collect()
    held = {r.chunk: r.f for r in fields}
    for r in queries.select("query", T.exact_tokens(F.col("text")).alias("t")).collect():
        for c, path, name, _, body in docs:
            path, name, body, e = (path or "").lower(), (name or "").lower(), (body or "").lower(), held[c]
            s = sum(8 * (f"第{x}条" in path) + 4 * (f"第{x}条" in body) + 10 * (x in e.clause_number) for x in r.t.clauses)
            s += sum(6 * (x in body) + 8 * (x in e.sub_clause_numbers) for x in r.t.subclauses)
            s += sum(5 * (x.lower() in name) + 6 * (x.lower() == name) for x in r.t.doc_names)
            s += sum(3 * (x.lower() in body) + 4 * (x in e.grade_codes) for x in r.t.grades)
            s += sum(2 * (f"{x}类城市".lower() in body) + 3 * (x in e.city_classes) for x in r.t.city_classes)
            if s:
                total[r.query, c] = total.get((r.query, c), 0) + s
    want = []
    for q in {q for q, _ in total}:
        best = sorted(((-round(s, 9), c) for (p, c), s in total.items() if p == q))[:10]
        want += [(q, n, c, round(-s, 6)) for n, (s, c) in enumerate(best, 1)]
    found = L.keyword_channel(queries, chunks, 10)
    got = [(r.query, r["rank"], r.chunk, round(r.score, 6)) for r in found.collect()]
    assert len(want) > 150 and sorted(got) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
