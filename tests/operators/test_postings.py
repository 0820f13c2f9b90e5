"""The stored index against brute force: scores, skipped blocks, phrases and edges."""

import math
import random
import re
from collections import Counter

import pytest

from quarry.operators import postings as P


def words_of(t):
    return re.findall(r"[a-z0-9]+|[一-鿿]", (t or "").lower())


def best_brute(docs, queries, k):
    split = {d: words_of(t) for d, t in docs if words_of(t)}
    n, total = len(split), sum(map(len, split.values()))
    df = Counter(w for ws in split.values() for w in set(ws))
    out = {}
    for q, t in queries:
        terms = set(words_of(t))
        least = len(terms) if len(terms) <= 1 else max(1, math.floor(len(terms) * 0.3))
        found = []
        for d, ws in split.items():
            tf = Counter(ws)
            held = [x for x in terms if tf[x]]
            if held and len(held) >= least:
                found.append((d, sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] / (tf[x] + 1.2 * (0.25 + 0.75 * len(ws) * n / total)) for x in held)))
        out[q] = sorted(((d, round(s, 9)) for d, s in found), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    common = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(draw.choices(common, k=draw.randrange(1, 40)))) for i in range(600)]
    docs += [(1000 + i, f"Rare{i % 7} rare{i % 7} 支付 w1 {'w2 ' * (i % 5)}") for i in range(30)]
    docs += [(2000, None), (2001, ""), (2002, "?!"), (2003, "w1 " * 30_000), (2004, "w1 w1"), (2005, "w1 w1")]
    return docs


QUERIES = [(1, "w1 w2 w3"), (2, "rare1 支付"), (3, "w5"), (4, "nothing here"), (5, None), (6, "rare3 w1 w2 w3 w4 w5 w6"), (7, ""), (8, "rare2")]


@pytest.mark.parametrize("bucket", [16, 100, 100_000])
def test_search_is_exact(spark, tmp_path, corpus, bucket):
    df = spark.createDataFrame(corpus, "chunk long, text string").selectExpr("*", "1 AS term", "'x' AS bucket")
    index = P.write_index(df, str(tmp_path / "index"), bucket_chunks=bucket)
    queries = spark.createDataFrame(QUERIES, "query long, text string")
    for k, first in ((5, None), (30, 2), (2000, 3)):
        hits, counts = P.indexed_search(P.read_index(spark, str(tmp_path / "index")), queries, k, first)
        got = {}
        for r in hits.orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.chunk, round(r.score, 9)))
        want = {q: v for q, v in best_brute(corpus, QUERIES, k).items() if v}
        assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items()}
        assert all(abs(a - b) < 1e-7 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))
        used = {r.query: (r.read, r.blocks) for r in counts.collect()}
        assert all(a <= b for a, b in used.values())
        if bucket == 16 and k == 5:
            assert sum(a for a, _ in used.values()) < 0.9 * sum(b for _, b in used.values()), used
    assert index.chunks == 635 - 2 and index.buckets == max(1, -(-index.chunks // bucket))


def test_no_block_holds_a_whole_hot_term(spark, tmp_path, corpus):
    index = P.write_index(spark.createDataFrame(corpus, "chunk long, text string"), str(tmp_path / "i"), bucket_chunks=50)
    assert index.blocks.where("term = 'w1'").count() > 8 and index.blocks.selectExpr("max(size(postings))").first()[0] < 110


def test_phrases_by_position(spark, tmp_path):
    docs = [(1, "a b c a b"), (2, "b a"), (3, "x A, B! c"), (4, None), (5, "支付宝 支付"), (6, "a x b"), (7, "a a a")]
    index = P.write_index(spark.createDataFrame(docs, "chunk long, text string"), str(tmp_path / "i"), bucket_chunks=2)
    phrases = [("p", "a b"), ("q", "支付"), ("r", "a a"), ("s", "c"), ("t", ""), ("u", None), ("v", "zz a")]
    got = {(r.phrase, r.chunk): r.times for r in P.phrase_hits(index, spark.createDataFrame(phrases, "phrase string, text string")).collect()}
    assert got == {("p", 1): 2, ("p", 3): 1, ("q", 5): 2, ("r", 7): 2, ("s", 1): 1, ("s", 3): 1}


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "chunk long, text string")
    index = P.write_index(df, str(tmp_path / "i"))
    hits, counts = P.indexed_search(index, spark.createDataFrame(QUERIES, "query long, text string"))
    assert hits.count() == counts.count() == 0 and (index.chunks, index.tokens, index.buckets) == (0, 0, 1)


def test_neither_words_nor_hits_are_shuffled(spark, small):
    """Each word was a row of two shuffles, and each hit of a query one more: plans held Generate below an Exchange."""
    from quarry.registry import QUERIES

    for name in ("indexed_topk", "phrase_positions"):
        assert "Generate" not in QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_make_smaller_buckets(spark, tmp_path, monkeypatch):
    """Buckets went by their number of chunks only; keys may be strings, copies are ties in their order."""
    monkeypatch.setattr(P, "BUCKET_WORDS", 50)
    docs = [(f"k{i:02d}", f"a b c{i % 3} d") for i in range(40)]
    index = P.write_index(spark.createDataFrame(docs, "chunk string, text string"), str(tmp_path / "i"), bucket_chunks=1000)
    assert index.buckets == 4
    hits, _ = P.indexed_search(index, spark.createDataFrame([("q", "c1 a")], "query string, text string"), 5)
    assert [r.chunk for r in hits.orderBy("rank").collect()] == ["k01", "k04", "k07", "k10", "k13"]
