"""Queries of retrieval: benchmark items ask, documents and embeddings answer (a vector stands for the document of its id)."""

from pyspark.sql import functions as F

from quarry import models
from quarry.functions import tables
from quarry.functions import text as T
from quarry.operators import cells as C
from quarry.operators import lexical as L
from quarry.operators import postings as P
from quarry.operators import ranking as R
from quarry.operators import segmentation as S
from quarry.registry import query, table
from quarry.sources.files import shared_folder


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"), "label")


def questions(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return b.join(vectors(spark, sf).select(F.col("chunk").alias("query"), F.col("vector").alias("query_vector")), "query")


def by_vector(spark, sf):
    return R.vector_channel(questions(spark, sf).select("query", "query_vector"), vectors(spark, sf))


def by_keyword(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), "text")
    return L.bm25_best(questions(spark, sf).select("query", "text"), docs, {"text": 1.0}, R.KEYWORD_TOP)


V_SQL = """q AS (SELECT item_id AS query, text, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
v AS (SELECT query, vec_id AS chunk, list_cosine_similarity(qv, embedding::DOUBLE[]) AS score FROM q, embeddings),
vt AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM v QUALIFY rank <= 50)"""
K_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[\x{4e00}-\x{9fff}]') AS w FROM documents),
n AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w)) AS total FROM w),
p AS (SELECT doc_id AS chunk, len(w) AS dl, unnest(w) AS term FROM w), tf AS (SELECT chunk, term, dl, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query, len(t) AS n_terms, unnest(t) AS term FROM (SELECT query, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{4e00}-\x{9fff}]')) AS t FROM q)),
k AS (SELECT query, chunk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl * n / total))) AS score, count(*) AS matched
      FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY query, chunk, n_terms HAVING count(*) >= CASE WHEN n_terms <= 1 THEN n_terms ELSE greatest(1, floor(n_terms * 0.3)) END),
kt AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS rank FROM k QUALIFY rank <= 100)"""
VG_SQL = """vm AS (SELECT *, max(score) OVER (PARTITION BY query) * 0.35 AS floor FROM vt),
vn AS (SELECT *, count(*) FILTER (score >= floor) OVER (PARTITION BY query) AS kept FROM vm),
vg AS (SELECT query, chunk, score, rank FROM vn WHERE score >= floor OR (kept = 0 AND rank = 1 AND score >= floor * 0.85))"""
KG_SQL = """kb AS (SELECT *, max(score) OVER (PARTITION BY query) AS b FROM kt), kg AS (SELECT query, chunk, score, rank FROM kb WHERE b <= 0 OR score >= b * 0.35)"""
F_SQL = """u AS (SELECT query, chunk, 1.0::DOUBLE / (30 + rank) AS s, rank AS vr, NULL::BIGINT AS kr FROM vg UNION ALL SELECT query, chunk, 1.0::DOUBLE / (30 + rank), NULL, rank FROM kg),
f AS (SELECT query, chunk, sum(s) AS s, min(vr) AS vector_rank, min(kr) AS keyword_rank FROM u GROUP BY ALL),
ft AS (SELECT query, chunk, round(s, 6) AS rrf_score, CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN 'hybrid' WHEN vector_rank IS NOT NULL THEN 'vector' ELSE 'keyword' END AS channel, vector_rank, keyword_rank,
       row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, chunk) AS rank FROM f QUALIFY rank <= 50)"""


@query(f"WITH {V_SQL} SELECT query, chunk, round(score, 6) AS score, rank FROM vt")
def vector_topk(spark, sf):
    return by_vector(spark, sf).withColumn("score", F.round("score", 6))


@query(f"WITH {V_SQL} SELECT query, chunk, round(score, 6) AS score, rank FROM vt")
def indexed_vectors(spark, sf):
    """The same rows as vector_topk from stored cells, those too far away left out."""
    index = C.write_cells(vectors(spark, sf).select("chunk", "vector"), shared_folder(spark, "cells"), 32, 64)
    found, _ = C.nearest_by_cells(index, questions(spark, sf).select("query", "query_vector"))
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {V_SQL}, {VG_SQL} SELECT query, chunk, round(score, 6) AS score, rank FROM vg")
def gate_vector(spark, sf):
    return R.vector_gate(by_vector(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {V_SQL}, {K_SQL} SELECT query, chunk, round(score, 6) AS score, matched, rank FROM kt")
def bm25_topk(spark, sf):
    return by_keyword(spark, sf).withColumn("score", F.round("score", 6))


def stored_index(spark, sf):
    docs = table(spark, sf, "documents")
    return P.write_index(docs, shared_folder(spark, "postings"), "doc_id", bucket_chunks=256)


@query(f"WITH {V_SQL}, {K_SQL} SELECT query, chunk, round(score, 6) AS score, matched, rank FROM kt")
def indexed_topk(spark, sf):
    """The same rows as bm25_topk from a stored index, buckets that can't reach the k-th score left out."""
    found, _ = P.indexed_search(stored_index(spark, sf), questions(spark, sf).select("query", "text"), R.KEYWORD_TOP)
    return found.withColumn("score", F.round("score", 6))


PHRASE_SQL = r"""WITH q AS (SELECT item_id AS phrase, list_slice(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{4e00}-\x{9fff}]'), 3, 5) AS p FROM benchmark),
d AS (SELECT doc_id AS chunk, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[\x{4e00}-\x{9fff}]') AS w FROM documents),
t AS (SELECT chunk, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM d)
SELECT phrase, chunk, count(*) AS times FROM q JOIN t ON g = array_to_string(p, ' ') WHERE len(p) = 3 GROUP BY ALL"""


@query(PHRASE_SQL)
def phrase_positions(spark, sf):
    """Three words of each benchmark item as a phrase, found by positions."""
    w = F.slice(L.words(F.col("text")), 3, 3)
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("phrase"), w.alias("w")).where("size(w) = 3")
    return P.phrase_hits(stored_index(spark, sf), q.select("phrase", F.array_join("w", " ").alias("text")))


@query(f"WITH {V_SQL}, {K_SQL}, {KG_SQL} SELECT query, chunk, rank FROM kg")
def gate_keyword(spark, sf):
    return R.keyword_gate(by_keyword(spark, sf)).select("query", "chunk", "rank")


@query(f"WITH {V_SQL}, m AS (SELECT *, max(score) OVER (PARTITION BY query) AS b FROM vt) SELECT query, chunk, rank FROM m WHERE rank <= 3 OR (b > 0 AND score >= b * 0.4 AND rank <= 20)")
def adaptive_k(spark, sf):
    return R.adaptive_k(by_vector(spark, sf)).select("query", "chunk", "rank")


def fused(spark, sf):
    return R.fuse(R.vector_gate(by_vector(spark, sf)), R.keyword_gate(by_keyword(spark, sf)))


HYBRID = f"WITH {V_SQL}, {VG_SQL}, {K_SQL}, {KG_SQL}, {F_SQL} "


@query(HYBRID + "SELECT * FROM ft")
def rrf_fuse(spark, sf):
    return fused(spark, sf)


@query(HYBRID + "SELECT * FROM ft")
def rag_search(spark, sf):
    """Both channels' gated hits, fused by the table function from SQL."""
    tables.register(spark)
    hits = lambda df, channel: df.select("query", "chunk", F.lit(channel).alias("channel"), F.col("rank").cast("long").alias("rank"))
    both = hits(R.vector_gate(by_vector(spark, sf)), "vector").unionByName(hits(R.keyword_gate(by_keyword(spark, sf)), "keyword"))
    return spark.sql("SELECT * FROM rag_search(TABLE(SELECT query, chunk, channel, rank FROM {hits}), 50)", hits=both)


@query(HYBRID + "SELECT query, chunk, rrf_score, channel, rank, rank <= 16 AS is_selected, CASE WHEN rank <= 16 THEN rank END AS final_rank, CASE WHEN rank <= 16 THEN 'selected' ELSE 'beyond_top_k' END AS reason FROM ft")
def hybrid_retrieval(spark, sf):
    """Two channels, gates, rank fusion and the final cut."""
    return R.select_final(fused(spark, sf)).select("query", "chunk", "rrf_score", "channel", "rank", "is_selected", "final_rank", "reason")


@query(HYBRID + "SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN n < 3 OR rank % 2 = 1 THEN rank ELSE 2 * n - rank END) AS position FROM (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM ft)")
def long_context_order(spark, sf):
    return R.long_context_order(fused(spark, sf)).select("query", "chunk", "position")


@query()
def reranked_evidence(spark, sf):
    """Fused hits reranked by shared words, the leader guarded, filtered, lifted to their parents (the source) and cut."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), F.col("text").alias("content"), F.col("source").alias("parent"))
    hits = fused(spark, sf).join(docs, "chunk").join(questions(spark, sf).select("query", F.col("text").alias("asked")), "query")
    ranked = R.rerank_filter(R.guard_leader(R.rerank(hits, models.lexical_score(F.col("asked"), F.col("content")), head=30)))
    parents = docs.groupBy("parent").agg(F.lit("sources").alias("path"), F.min_by("content", "chunk").alias("parent_text"))
    lifted = R.elevate_parents(ranked.withColumnRenamed("rrf_score", "score"), parents)
    again = R.rerank_parents(lifted, models.lexical_score(F.col("asked"), F.col("content")))
    return R.select_final(again).select("query", "chunk", "parent", F.round("rerank_score", 6).alias("rerank_score"), "rank", "is_selected")


@query()
def assembled_prompts(spark, sf):
    """Prompts from the final evidence of each question, repeats as pointers, within the budgets."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), F.col("text").alias("content"))
    hits = R.select_final(fused(spark, sf), 8).where("is_selected").join(docs, "chunk")
    keyed = hits.withColumn("sub_question", F.col("chunk") % 2).withColumn("key", F.sha2(F.coalesce("content", F.lit("")), 256))
    return R.assemble_prompt(R.point_to_repeats(R.reference_ids(keyed)))


LIKE_TERMS = ["the", "data", "model", "water", "people"]


@query("""WITH t(term, i) AS (VALUES ('the', 0), ('data', 1), ('model', 2), ('water', 3), ('people', 4)), s AS (SELECT doc_id AS chunk, sum(((contains(lower(text), term))::INT * 1.0 + (contains(lower(source), term))::INT * 1.5) * greatest(1, 6 - i)) AS score FROM documents, t GROUP BY doc_id)
SELECT chunk, score::DOUBLE AS score FROM s WHERE score > 0""")
def lexical_like(spark, sf):
    terms = F.array(*map(F.lit, LIKE_TERMS))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), L.like_score(terms, F.col("text"), F.col("source")).alias("score")).where("score > 0")


@query(f"WITH {V_SQL}, a AS (SELECT * FROM vt WHERE rank <= 10), b AS (SELECT query, chunk + 1 AS chunk, score * 1.1 AS score, rank FROM vt WHERE rank <= 10), c AS (SELECT query, chunk, max(score) AS score FROM (SELECT query, chunk, score FROM a UNION ALL SELECT query, chunk, score FROM b) GROUP BY ALL) SELECT query, chunk, round(score, 6) AS score FROM c")
def corrective_union(spark, sf):
    a = by_vector(spark, sf).where("rank <= 10").withColumn("rerank_score", F.lit(0.0))
    b = a.withColumn("chunk", F.col("chunk") + 1).withColumn("score", F.col("score") * 1.1)
    return R.keep_best(a, b).select("query", "chunk", F.round("score", 6).alias("score"))


@query(f"WITH {V_SQL}, a AS (SELECT query, chunk, score FROM vt WHERE rank <= 5), p AS (SELECT query FROM a GROUP BY 1 HAVING max(score) < 0.9 OR query % 2 = 0), b AS (SELECT query, chunk, score + 1 AS score FROM vt JOIN p USING (query) WHERE rank BETWEEN 4 AND 8), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT query, chunk, round(max(score), 6) AS score FROM u GROUP BY ALL")
def corrected_hits(spark, sf):
    """Questions whose hits don't suffice are asked once more, and both rounds are merged."""
    v = by_vector(spark, sf)
    first = v.where("rank <= 5").withColumn("rerank_score", F.lit(0.0))
    sufficient = F.when(F.col("query") % 2 == 0, False).otherwise(F.col("score") >= 0.9)
    again = lambda poor: v.where("rank between 4 and 8").join(poor, "query", "left_semi").select("query", "chunk", (F.col("score") + 1).alias("score"), F.lit(0.0).alias("rerank_score"))
    return R.corrected(first, sufficient, again).select("query", "chunk", F.round("score", 6).alias("score"))


@query(f"WITH {V_SQL}, h AS (SELECT query, chunk FROM vt WHERE rank <= 3), f AS (SELECT query, chunk AS hop FROM vt WHERE rank = 2 AND query % 2 = 0), n AS (SELECT f.query, e.vec_id AS chunk FROM f JOIN embeddings e ON e.vec_id BETWEEN f.hop + 1 AND f.hop + 2) SELECT * FROM h UNION SELECT * FROM n")
def hopped_hits(spark, sf):
    """A second hop for every other question, to the chunks that follow its second hit; what is known isn't repeated."""
    v = by_vector(spark, sf)
    every = vectors(spark, sf).select("chunk")
    firsts = v.where("rank <= 3").select("query", "chunk", F.lit("first").alias("text"))
    second = v.where("rank = 2 and query % 2 = 0").select("query", F.col("chunk").alias("hop"))

    def search(asked):
        own = asked.where("text <> 'first'").select("query", F.explode(F.sequence(F.col("text").try_cast("long") + 1, F.col("text").try_cast("long") + 2)).alias("chunk")).join(every, "chunk", "left_semi").select("query", "chunk")
        return firsts.join(asked.where("text = 'first'").select("query"), "query", "left_semi").select("query", "chunk").unionByName(own)

    follow = lambda asked, hits: second.select("query", F.col("hop").cast("string").alias("text"))
    return R.multi_hop(v.select("query", F.lit("first").alias("text")).distinct(), search, follow)


@query(f"WITH {V_SQL}, a AS (SELECT query, chunk FROM vt WHERE rank <= 5), b AS (SELECT query, chunk FROM vt WHERE rank BETWEEN 3 AND 9) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query = b.query AND a.chunk = b.chunk)")
def append_fresh(spark, sf):
    v = by_vector(spark, sf).select("query", "chunk", "rank")
    return R.append_fresh(v.where("rank <= 5"), v.where("rank between 3 and 9")).select("query", "chunk")


@query(f"WITH {V_SQL}, u AS (SELECT query, chunk, rank, 0 AS p FROM vt WHERE rank BETWEEN 11 AND 14 UNION ALL SELECT query, chunk, rank, 1 FROM vt WHERE rank <= 12), d AS (SELECT *, row_number() OVER (PARTITION BY query, chunk ORDER BY p, rank) AS f FROM u) SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY p, rank, chunk) AS rank FROM d WHERE f = 1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY p, rank, chunk) <= 8")
def primary_first(spark, sf):
    v = by_vector(spark, sf)
    return R.primary_first(v.where("rank between 11 and 14"), v.where("rank <= 12"), 8).select("query", "chunk", "rank")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey IN (1, 2, 3, 5, 8) AND starts_with('/' || l_linestatus || '/' || l_linenumber, '/O') AND (contains('brand ' || l_partkey, '1') OR contains('brand ' || l_partkey, '7')) AND l_linenumber <> 2 AND l_tax > 0.02""")
def scope_predicates(spark, sf):
    """Tenant, documents, path, name, category and tag filters together; an id that can't be read drops out."""
    c = table(spark, sf, "lineitem")
    where = R.scope_predicate(
        tenant=F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")), want_tenant="", doc=F.col("l_suppkey"), doc_ids=["1", "2", "3", "5", "8", "x"], path=F.concat(F.lit("/"), "l_linestatus", F.lit("/"), F.col("l_linenumber").cast("string")), prefix="/O",
        name=F.concat(F.lit("Brand "), F.col("l_partkey").cast("string")), names=["1", "7"], category=F.when(F.col("l_linenumber") == 2, "b").otherwise("a"), categories=["a"], tags=F.when(F.col("l_tax") > 0.02, "x, y").otherwise("x"), want_tags=["y"],
    )
    return c.where(where).select("l_orderkey", "l_linenumber")


@query("""SELECT 'all' AS filters, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey IN (1, 2, 3, 5, 8) AND l_linestatus = 'F' AND l_partkey % 10 = 1 AND l_linenumber IN (1, 3, 4) AND l_tax > 0.02
UNION ALL SELECT 'node', l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') AND l_partkey = 7 AND l_linenumber = 3""")
def keyword_predicates(spark, sf):
    """The keyword channel's own filters: section and names as phrases, a list of unreadable ids matches nothing."""
    c = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("tenant"), F.col("l_suppkey").alias("document_id"), F.col("l_partkey").alias("node_id"), F.concat(F.lit("top > State "), "l_linestatus").alias("section_path"), F.concat(F.lit("/d"), (F.col("l_partkey") % 10).cast("string")).alias("canonical_path"),
        F.col("l_linenumber").alias("item_index"), F.concat(F.lit("Guide "), F.col("l_linenumber").cast("string"), F.lit(".md")).alias("document_name"), F.when(F.col("l_linenumber") < 5, "low").otherwise("high").alias("category"), F.when(F.col("l_tax") > 0.02, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("tags"),
    )
    every = L.keyword_predicate(c, "A", ["1", "2", "3", "5", "8", "zz"], section="state f", canonical="/d1", names=["guide 1", "guide 3", "guide 4", "guide 7"], categories=["low"], tags=["y"])
    node, none = L.keyword_predicate(c, None, node=7, item=3), L.keyword_predicate(c, "A", ["zz"])
    parts = [d.select(F.lit(k).alias("filters"), "l_orderkey", "l_linenumber") for k, d in (("all", every), ("node", node), ("none", none))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def keyword_channel(spark, sf):
    """Questions over documents with path, name and exact fields; held against a fixture in the tests."""
    d = table(spark, sf, "documents")
    k = (F.col("doc_id") % 20 + 1).cast("string")
    chunks = d.select(F.col("doc_id").alias("chunk"), F.concat(F.lit("制度 > 第"), k, F.lit("条")).alias("section_path"), F.col("source").alias("document_name"), F.col("lang").alias("scope_name"), F.col("text").alias("chunk_text"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.concat("text", F.lit(" 第"), (F.col("item_id") % 20 + 1).cast("string"), F.lit("条")).alias("text"), F.array(F.substring("text", 81, 20)).alias("hints"))
    return L.keyword_channel(asked, chunks, 20).select("query", "chunk", F.round("score", 6).alias("score"), "rank")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'channel_failed' WHEN l_linenumber = 1 THEN 'no_recall' WHEN l_linenumber = 2 THEN 'gate_rejected' WHEN l_linenumber = 3 THEN 'rerank_rejected' END AS reason FROM lineitem""")
def empty_reasons(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", n, R.empty_reason(F.when(n == 1, 0).otherwise(5), F.when(n <= 2, 0).otherwise(3), F.when(n <= 3, 0).otherwise(2), n == 7).alias("reason"))


@query("""WITH o AS (SELECT n_nationkey AS query, 'own' AS term, 1.0::DOUBLE AS boost FROM nation), x AS (SELECT c_nationkey AS query, 'w' || (c_custkey % 30) AS term FROM customer WHERE c_custkey % 30 <> 0 GROUP BY ALL)
SELECT * FROM o UNION ALL (SELECT query, term, 1.5 FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY length(term) DESC, term) <= 9)""")
def expanded_terms(spark, sf):
    terms = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query"), F.lit("own").alias("term"))
    k = F.col("c_custkey") % 30
    extra = table(spark, sf, "customer").select(F.col("c_nationkey").alias("query"), F.when(k == 0, "own").otherwise(F.concat(F.lit("w"), k.cast("string"))).alias("term"))
    return L.expand_terms(terms, extra)


@query("""SELECT p_partkey, (CASE WHEN p_name = 'small widget' THEN 35.0 ELSE 0 END + s * 23)::DOUBLE AS score FROM (SELECT p_partkey, p_name, len(list_intersect(string_split(p_name, ' '), ['small', 'widget'])) / 2 AS s FROM part)""")
def section_scores(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", L.section_score(F.lit("Small Widget"), name, F.concat(F.lit("top > "), name), F.concat(F.lit("/top/"), name)).alias("score"))


@query("SELECT o_custkey AS query, o_orderkey AS chunk FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def keyword_fallback(spark, sf):
    found = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("chunk"))
    return L.keyword_with_fallback(found, table(spark, sf, "customer").select(F.col("c_custkey").alias("query"), F.lit(-1).cast("long").alias("chunk")))


@query("""SELECT vec_id, list_transform(v, lambda x: round(exp(x) / list_sum(list_transform(v, lambda y: exp(y))), 9)) AS p, round(1 - list_cosine_similarity(v, w), 9) AS distance FROM (SELECT vec_id, embedding[1:len(embedding) // 2]::DOUBLE[] AS v, embedding[len(embedding) // 2 + 1:]::DOUBLE[] AS w FROM embeddings)""")
def judge_probabilities(spark, sf):
    """Softmax of the first half of each vector as logits, and the distance of its halves."""
    from quarry.functions import vectors as V

    e = F.col("embedding").cast("array<double>")
    half = F.floor(F.size(e) / 2).cast("int")
    v, w = F.slice(e, F.lit(1), half), F.slice(e, half + 1, F.size(e) - half)
    return table(spark, sf, "embeddings").select("vec_id", F.transform(V.softmax(v), lambda x: F.round(x, 9)).alias("p"), F.round(V.cosine_distance(v, w), 9).alias("distance"))


@query("""WITH h(query, prefix) AS (VALUES (1, 'https://a'), (2, 'http'), (3, 'ftp://')) SELECT query, prefix FROM h WHERE EXISTS (SELECT 1 FROM pages WHERE starts_with(lower(url), lower(prefix)))""")
def prefix_pushdown(spark, sf):
    hints = spark.createDataFrame([(1, "https://a"), (2, "http"), (3, "ftp://")], "query int, prefix string")
    return R.validated_prefixes(hints, table(spark, sf, "pages").select(F.col("url").alias("path")))


@query("""WITH q AS (SELECT vec_id AS query, label AS usr, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query, vec_id AS fact, vec_id % 7 AS category, vec_id % 31 AS edited, 1 - list_cosine_similarity(qv, embedding::DOUBLE[]) AS distance FROM q JOIN embeddings ON label = usr),
n AS (SELECT * FROM d WHERE distance <= 0.7 QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, fact) <= 50),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query, category ORDER BY edited DESC, distance, fact) = 1)
SELECT query, fact, category, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, fact) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, fact) <= 5""")
def fact_recall(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("user"), F.col("embedding").alias("query_vector"))
    facts = e.select(F.col("vec_id").alias("fact"), F.col("label").alias("user"), (F.col("vec_id") % 7).alias("category"), (F.col("vec_id") % 31).alias("edited"), F.col("embedding").alias("vector"))
    return R.recall_facts(asked, facts).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id AS fact, label AS usr FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id % 31, vec_id) <= 20")
def fact_eviction(spark, sf):
    facts = table(spark, sf, "embeddings").select(F.col("vec_id").alias("fact"), F.col("label").alias("user"), (F.col("vec_id") % 31).alias("edited"))
    return R.evict_beyond(facts, 20).select("fact", F.col("user").alias("usr"))


@query()
def fact_insert(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.insert_facts(e.select(F.col("label").alias("user"), F.col("vec_id").alias("fact"), "embedding").withColumnRenamed("embedding", "vector")).select("user", "fact")


@query()
def section_search(spark, sf):
    """Pages as sections of their host: the best ten for each benchmark item's words, met by shared words."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("chunk"), T.url_slug(F.col("url")).alias("section_path"), T.page_text(F.col("html")).alias("chunk_text"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return L.bm25_best(asked, pages, {f: L.FIELDS[f] for f in ("chunk_text", "section_path")}, 10).select("query", "chunk", "rank")


#: Letters of lower-case Latin and of Chinese texts.
LETTERS = "[a-z\\u00df-\\u024f\\u4e00-\\u9fff]+"


def word_pieces(spark, sf):
    return S.fit_words(table(spark, sf, "documents").select(F.lower("text").alias("text")), pattern=LETTERS)


@query()
def word_model(spark, sf):
    """Pieces of up to four letters of all documents, as an expectation maximisation weighs them."""
    return spark.createDataFrame(word_pieces(spark, sf).rows(), "word string, expected long, log_p double")


@query()
def turn_words(spark, sf):
    """Each turn of the conversations cut by the documents' word model, and its keyword terms."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("text"))
    cut = S.cut_words(turns, word_pieces(spark, sf), pattern=LETTERS)
    return cut.select("conv_id", "turn", "words", T.terms_of_words(T.without_noise(F.col("text")), F.col("words")).alias("terms"))


@query()
def query_augmentation(spark, sf):
    """Keyword terms, exact tokens and adaptive weights of each turn, capped and without repeats."""
    q = F.col("text")
    hints = T.limit_distinct(F.concat(T.keyword_terms(q), T.exact_tokens(q)["doc_names"]), 8, 40)
    v, k = R.adaptive_weights(q)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", q, F.array_join(hints, " ")).alias("augmented"), v.alias("vector_weight"), k.alias("keyword_weight"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '上面第' || o_orderkey % 50 || '条呢' ELSE '请说明order和' || o_orderpriority END AS q, list_distinct_ordered AS h FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE ['a', 'b'] END AS kw, CASE WHEN o_orderkey % 2 = 0 THEN ['第3步'] ELSE [] END AS nav,
list_concat(list_concat(kw, CASE WHEN o_orderkey % 3 = 0 THEN ['old', 'b2'] ELSE [] END), nav) AS list_distinct_ordered FROM orders)), t AS (SELECT *, list_filter(regexp_split_to_array(q, '[\\s、，,；;：:（）()\\-的和及与或]+'), lambda s: length(s) >= 2) AS terms FROM o)
SELECT o_orderkey, CASE WHEN len(h) > 0 THEN q || ' ' || array_to_string(h, ' ') ELSE q END AS text, CASE WHEN len(h) > 0 THEN list_concat(h, terms)[1:8] ELSE terms[1:6] END AS hints FROM t""")
def augmented_queries(spark, sf):
    """Keywords, navigation and, for short questions that refer back, history."""
    k = F.col("o_orderkey")
    empty = F.array().cast("array<string>")
    q = F.when(k % 3 == 0, F.concat(F.lit("上面第"), (k % 50).cast("string"), F.lit("条呢"))).otherwise(F.concat(F.lit("请说明order和"), F.col("o_orderpriority")))
    keywords = F.when(k % 4 == 0, empty).otherwise(F.array(F.lit("a"), F.lit(" b"), F.lit("a"), F.lit("")))
    a = T.augmented_query(q, keywords, F.when(k % 2 == 0, F.array(F.lit("第3步"))).otherwise(empty), F.array(F.lit("old"), F.lit("b2")))
    return table(spark, sf, "orders").select(k, a.alias("a")).select("o_orderkey", "a.text", "a.hints")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END AS value, CASE WHEN event_id % 3 = 0 THEN event_id END AS known FROM events")
def safe_ints(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("x")))
    return table(spark, sf, "events").select(k, T.safe_int(text).alias("value"), T.safe_int(text, None).alias("known"))
