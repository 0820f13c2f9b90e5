"""Queries of evaluation: labels as judgements, embeddings' neighbours as ranked lists with equal labels as gold."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry import models
from quarry.operators import evaluation as E
from quarry.operators import ranking as R
from quarry.plans.retrieval import V_SQL, VG_SQL, by_vector
from quarry.registry import query, table

LISTS = f"""WITH {V_SQL}, g AS (SELECT query, list(chunk ORDER BY chunk) AS gold FROM vt WHERE chunk % 5 = query % 5 GROUP BY query),
h AS (SELECT query, list(chunk ORDER BY rank) AS hits FROM vt GROUP BY query), l AS (SELECT query, hits, coalesce(gold, []) AS gold FROM h LEFT JOIN g USING (query)),
r AS (SELECT query, list_filter(list_transform(hits[1:5], lambda x, i: CASE WHEN list_contains(gold, x) THEN i END), lambda x: x IS NOT NULL) AS early, list_filter(list_transform(hits, lambda x, i: CASE WHEN list_contains(gold, x) THEN i END), lambda x: x IS NOT NULL) AS places, gold, hits FROM l)
"""


def lists(spark, sf):
    """Each question's 50 hits; its gold is those whose id has the question's remainder by 5."""
    v = by_vector(spark, sf)
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.when(x, F.struct("rank", "chunk")))), lambda s: s["chunk"])
    return v.groupBy("query").agg(ordered(F.lit(True)).alias("hits"), ordered(F.col("chunk") % 5 == F.col("query") % 5).alias("gold"))


@query(LISTS + "SELECT query, CASE WHEN len(gold) > 0 THEN round(len(early) / len(gold), 6) END AS recall5, CASE WHEN len(gold) > 0 THEN round(coalesce(1.0 / places[1], 0), 6) END AS mrr, CASE WHEN len(gold) > 0 THEN round(coalesce(list_sum(list_transform(early, lambda i: 1 / log2(i + 1))), 0) / list_sum(list_transform(range(1, least(5, len(gold)) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg5, CASE WHEN len(gold) > 0 THEN (len(early) > 0)::INT::DOUBLE END AS any5 FROM r")
def recall_mrr_ndcg(spark, sf):
    h, g = F.col("hits"), F.col("gold")
    return lists(spark, sf).select("query", F.round(E.recall_at(h, g, 5), 6).alias("recall5"), F.round(E.mrr(h, g), 6).alias("mrr"), F.round(E.ndcg_at(h, g, 5), 6).alias("ndcg5"), E.any_recall_at(h, g, 5).alias("any5"))


@query(LISTS + "SELECT round(avg((len(hits) = 0)::INT), 6) AS zero_hit, round(avg(len(hits)), 6) AS avg_hits, round(avg(CASE WHEN len(gold) > 0 THEN (len(places) > 0)::INT END), 6) AS coverage, round(avg(CASE WHEN len(gold) > 0 THEN coalesce(1.0 / places[1], 0) END), 6) AS mrr FROM r")
def channel_probe(spark, sf):
    return E.probe_summary(lists(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("zero_hit", "avg_hits", "coverage", "mrr")])


@query(f"WITH {V_SQL}, j AS (SELECT query, rank, chunk % 3 = 0 AS rel FROM vt), p AS (SELECT query, CASE WHEN rel THEN sum(rel::INT) OVER (PARTITION BY query ORDER BY rank) / rank END AS p FROM j) SELECT query, round(coalesce(avg(p), 0), 6) AS precision FROM p GROUP BY query")
def context_precision(spark, sf):
    return E.average_precision(by_vector(spark, sf).withColumn("relevant", F.col("chunk") % 3 == 0)).withColumn("precision", F.round("precision", 6))


def judged(spark, sf):
    """Labels with a probability derived from the document's id."""
    return table(spark, sf, "labels").select("doc_id", "quality", "toxic", ((F.col("doc_id") * 37 % 101 + 40 * F.col("quality")) / 141).alias("p"))


J_SQL = "j AS (SELECT doc_id, quality, toxic, (doc_id * 37 % 101 + 40 * quality) / 141 AS p FROM labels)"


@query(f"WITH {J_SQL}, a AS (SELECT sum((x.p > y.p)::INT + 0.5 * (x.p = y.p)::INT) / count(*) AS auc FROM j x, j y WHERE x.quality = 1 AND y.quality = 0) SELECT round(auc, 9) AS auc FROM a")
def auc(spark, sf):
    return E.auc(judged(spark, sf), "p", "quality").select(F.round("auc", 9).alias("auc"))


@query(f"WITH {J_SQL}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(quality) AS a FROM j WHERE quality IS NOT NULL GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM b")
def ece(spark, sf):
    return E.ece(judged(spark, sf).where("quality is not null"), "p", "quality").select(F.round("ece", 9).alias("ece"))


@query(f"WITH {J_SQL}, t AS (SELECT DISTINCT p AS threshold FROM j), r AS (SELECT threshold, count(*) FILTER (quality = 1 AND p >= threshold) / nullif(count(*) FILTER (quality = 1), 0) AS recall, count(*) FILTER (quality = 0 AND p >= threshold) / nullif(count(*) FILTER (quality = 0), 0) AS false_pass FROM t, j GROUP BY threshold) SELECT round(threshold, 9) AS threshold, round(recall, 9) AS recall, round(false_pass, 9) AS false_pass FROM r WHERE false_pass <= 0.05 ORDER BY recall DESC, r.threshold DESC LIMIT 1")
def choose_threshold(spark, sf):
    best = E.choose_threshold(judged(spark, sf), "p", "quality")
    return best.select(*[F.round(c, 9).alias(c) for c in best.columns])


@query(f"WITH {J_SQL}, c AS (SELECT count(*) FILTER (quality = 1 AND p >= 0.5) AS tp, count(*) FILTER (quality = 0 AND p >= 0.5) AS fp, count(*) FILTER (quality = 1 AND p < 0.5) AS fn, count(*) FILTER (quality = 0 AND p < 0.5) AS tn FROM j) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c")
def confusion(spark, sf):
    c = E.confusion(judged(spark, sf), F.col("quality") == 1, F.col("p") >= 0.5)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "accuracy")])


@query("""WITH d AS (SELECT lang AS t, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS g FROM documents), l AS (SELECT DISTINCT t AS label FROM d UNION SELECT DISTINCT g FROM d),
c AS (SELECT label, count(*) FILTER (t = label AND g = label) AS tp, count(*) FILTER (t <> label AND g = label) AS fp, count(*) FILTER (t = label AND g <> label) AS fn FROM l, d GROUP BY label)
SELECT label, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def class_metrics(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("t"), F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang")).alias("g"))
    c = E.by_class(d, "t", "g")
    return c.select("label", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("""WITH r AS (SELECT quality = 1 AND doc_id % 3 <> 0 AS x, quality = 1 AND doc_id % 5 <> 0 AS y FROM labels) SELECT count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM r""")
def mcnemar(spark, sf):
    q = F.col("quality") == 1
    return E.mcnemar(table(spark, sf, "labels"), q & (F.col("doc_id") % 3 != 0), q & (F.col("doc_id") % 5 != 0)).select("b", "c")


@query("""WITH r AS (SELECT quality = 1 AND doc_id % 3 <> 0 AS x, quality = 1 AND doc_id % 5 <> 0 AS y FROM labels), c AS (SELECT count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM r),
t AS (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS i FROM c) SELECT b, c, least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) AS p FROM t GROUP BY ALL""")
def mcnemar_p(spark, sf):
    q = F.col("quality") == 1
    return E.mcnemar(table(spark, sf, "labels"), q & (F.col("doc_id") % 3 != 0), q & (F.col("doc_id") % 5 != 0))


@query()
def paired_bootstrap(spark, sf):
    """Two metrics of two runs, 2000 resamples each; held against a plain bootstrap in the tests."""
    j = judged(spark, sf).select(F.col("doc_id").alias("question_id"), "p", "quality")
    pairs = j.select("question_id", F.inline(F.array(F.struct(F.lit("p").alias("metric"), F.col("p").alias("x"), (F.col("p") + 0.01 * F.col("quality")).alias("y")), F.struct(F.lit("q").alias("metric"), F.col("p").alias("x"), (1 - F.col("p")).alias("y")))))
    return E.bootstrap(pairs.where("x is not null and y is not null"), "metric")


@query()
def gold_align_bigram(spark, sf):
    a = E.align_gold(table(spark, sf, "benchmark").select(F.col("item_id").alias("snippet"), "text"), table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), "text"))
    return a.withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {J_SQL} SELECT doc_id % 7 AS query, round(sum(least(1.0, greatest(0.0, (p - 0.45) / 0.10))) / count(p), 6) AS faithfulness FROM j GROUP BY 1")
def faithfulness(spark, sf):
    return E.faithfulness(judged(spark, sf).withColumn("query", F.col("doc_id") % 7)).withColumn("faithfulness", F.round("faithfulness", 6))


@query("SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN regexp_matches(lower(text), '无法回答|没有找到|未找到|暂无相关|不在知识库|抱歉|cannot answer|can''t answer|no relevant|not found|unable to') END AS refused FROM conversations WHERE role = 'assistant'")
def refusals(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", E.is_refusal(F.col("text")).alias("refused"))


@query("""WITH m(metric, threshold) AS (VALUES ('error', 60.0), ('click', 0.0), ('view', 40.0), ('none', 5.0)), v AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1) SELECT metric, value, threshold::DOUBLE AS threshold FROM m LEFT JOIN v USING (metric) WHERE threshold > 0 AND value < threshold""")
def gate_violations(spark, sf):
    gates = spark.createDataFrame([("error", 60.0), ("click", 0.0), ("view", 40.0), ("none", 5.0)], "metric string, threshold double")
    v = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return E.gate_violations(gates.join(v, "metric", "left")).select("metric", "value", "threshold")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'dev' END AS split FROM documents")
def eval_splits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.split_of(F.col("doc_id").cast("string")).alias("split"))


@query("WITH s(k) AS (VALUES (4), (8), (16)) SELECT item_id, k FROM benchmark, s")
def experiment_matrix(spark, sf):
    return E.experiment_matrix(table(spark, sf, "benchmark").select("item_id"), spark.createDataFrame([(4,), (8,), (16,)], "k int"))


@query(f"""WITH {V_SQL}, k(final_k) AS (VALUES (4), (8), (16)), a AS (SELECT final_k, query, count(*) FILTER (rank <= final_k AND chunk % 5 = query % 5) AS hit, count(*) FILTER (chunk % 5 = query % 5) AS gold FROM vt, k GROUP BY ALL) SELECT final_k, round(avg(CASE WHEN gold > 0 THEN hit / gold END), 6) AS recall FROM a GROUP BY 1""")
def parameter_sweep(spark, sf):
    runs = E.experiment_matrix(by_vector(spark, sf), spark.createDataFrame([(4,), (8,), (16,)], "final_k int"))
    own = F.col("chunk") % 5 == F.col("query") % 5
    per = runs.groupBy("final_k", "query").agg(F.count_if(own & (F.col("rank") <= F.col("final_k"))).alias("hit"), F.count_if(own).alias("gold"))
    return per.groupBy("final_k").agg(F.round(F.avg(F.try_divide("hit", F.nullif("gold", F.lit(0)))), 6).alias("recall"))


@query("SELECT min(item_id) AS id FROM benchmark GROUP BY regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')")
def distinct_questions(spark, sf):
    return E.distinct_questions(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))).select("id")


@query("""WITH j AS (SELECT doc_id, quality, toxic FROM labels) SELECT round(avg((quality IS NOT NULL)::INT), 6) AS quality, round(avg((nullif(toxic, 0) IS NOT NULL)::INT), 6) AS toxic, least(round(avg((quality IS NOT NULL)::INT), 6), round(avg((nullif(toxic, 0) IS NOT NULL)::INT), 6)) AS coverage FROM j""")
def judge_coverage(spark, sf):
    done = table(spark, sf, "labels").select("quality", F.nullif("toxic", F.lit(0)).alias("toxic"), F.lit("completed").alias("status"))
    c = E.judge_coverage(done, "quality", "toxic")
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@query()
def text_recall(spark, sf):
    """Documents that hold at least half of a benchmark item's character pairs."""
    o = E.overlap_pairs(table(spark, sf, "benchmark").select(F.col("item_id").alias("snippet"), "text"), table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), "text"), 0.5)
    return o.withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {V_SQL}, {VG_SQL}, g AS (SELECT query, min(rank) AS first FROM vg WHERE chunk % 5 = query % 5 GROUP BY 1), r AS (SELECT query, count(*) FILTER (chunk % 5 = query % 5) AS n FROM vt GROUP BY 1)
SELECT CASE WHEN first <= 3 THEN 'ok' WHEN n = 0 THEN 'recall' WHEN first IS NULL THEN 'gate' WHEN first > 30 THEN 'fusion' WHEN first > 20 THEN 'rerank' ELSE 'final_cut' END AS stage, count(*) AS count FROM r LEFT JOIN g USING (query) GROUP BY 1""")
def loss_stages(spark, sf):
    """Where each question's gold document was lost on its way through the channels, gate and cut."""
    v = by_vector(spark, sf).withColumn("gold", F.col("chunk") % 5 == F.col("query") % 5)
    gated = R.vector_gate(v)
    seen = lambda d, n: d.where("gold").select("query").distinct().withColumn(n, F.lit(True))
    out = v.select("query").distinct()
    for d, n in ((v, "recalled"), (gated, "gated"), (gated.where("rank <= 30"), "fused"), (gated.where("rank <= 20"), "reranked"), (gated.where("rank <= 3"), "final")):
        out = out.join(seen(d, n), "query", "left")
    flags = [F.coalesce(n, F.lit(False)) for n in ("recalled", "gated", "fused", "reranked", "final")]
    return out.select("query", E.attribute_stage(*flags).alias("stage")).groupBy("stage").count()


@query(r"""WITH a AS (SELECT conv_id, turn, 'At ' || conv_id || ', if so, [' || turn || '] it is fine. ' || text AS t FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, regexp_replace(t, '([0-9]*)[0-9]', '\17', 'g') AS number,
regexp_replace(t, '(如果|若|除非|if|unless)[^，,。.]*[，,]', '', 'g') AS condition, t || chr(10) || t AS verbosity, regexp_replace(t, '\[([0-9]+)\]', '（来源\1）', 'g') AS citation FROM a""")
def perturbed_answers(spark, sf):
    """Damaged copies of answers: each number's last digit, conditions out, said twice, another style of citation."""
    a = table(spark, sf, "conversations").where("role = 'assistant'")
    text = F.concat(F.lit("At "), F.col("conv_id").cast("string"), F.lit(", if so, ["), F.col("turn").cast("string"), F.lit("] it is fine. "), F.col("text"))
    return a.select("conv_id", "turn", *[E.perturb(text, h).alias(h) for h in ("number", "condition", "verbosity", "citation")])


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '可以转让' WHEN 1 THEN 'this is allowed' ELSE '允许' END AS polarity FROM orders")
def flipped_answers(spark, sf):
    """Denials lose their word."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "不可以转让").when(k == 1, "this is not allowed").otherwise("不允许")
    return table(spark, sf, "orders").select("o_orderkey", E.perturb(text, "polarity").alias("polarity"))


@query()
def embedded_texts(spark, sf):
    """Offline embeddings of the benchmark and their nearest other item."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk"), models.checked_dimension(models.hashing_embedding(F.col("text")), 64).alias("vector"))
    near = R.vector_channel(b.select(F.col("chunk").alias("query"), F.col("vector").alias("query_vector")), b, 2)
    return near.where("query <> chunk").select("query", "chunk", F.round("score", 6).alias("score"), F.row_number().over(Window.partitionBy("query").orderBy("rank")).alias("rank")).where("rank = 1")


#: Turns as hits of their conversation; gold: the first half of the third turn, a short word, and a text of its own.
G_SQL = r"""h AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS hits FROM conversations GROUP BY 1), g AS (SELECT conv_id, hits, [left(hits[3], 60), 'x', 'zq' || conv_id || 'jx qzj vxq'] AS gold FROM h WHERE len(hits) >= 3),
p AS (SELECT conv_id, hits, unnest(gold) AS gold, unnest(range(1, 4)) AS n FROM g), b AS (SELECT conv_id, n, gold, hits, lower(regexp_replace(gold, '[^A-Za-z0-9_]', '', 'g')) AS s FROM p),
e AS (SELECT conv_id, n, gold, list_distinct(list_transform(range(1, length(s)), lambda i: s[i:i + 1])) AS s, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i FROM b),
f AS (SELECT *, lower(regexp_replace(hit, '[^A-Za-z0-9_]', '', 'g')) AS t FROM e), r AS (SELECT conv_id, n, i, CASE WHEN len(s) = 0 THEN contains(lower(hit), lower(gold))::INT ELSE len(list_intersect(s, list_transform(range(1, length(t)), lambda i: t[i:i + 1]))) / len(s) END AS share FROM f)"""


def texts(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("hits")).where(F.size("hits") >= 3)
    return c.withColumn("gold", F.array(F.substring(F.get("hits", F.lit(2)), 1, 60), F.lit("x"), F.format_string("zq%djx qzj vxq", "conv_id")))


@query(f"WITH {G_SQL} SELECT conv_id, count(DISTINCT n) FILTER (share >= 0.5 AND i <= 5) / 3 AS recall5, coalesce(round(1.0 / min(i) FILTER (share >= 0.5), 4), 0) AS mrr, count(DISTINCT n) FILTER (share >= 0.35) / 3 AS lexical FROM r GROUP BY 1")
def text_metrics(spark, sf):
    """Recall, reciprocal rank and lexical recall of ranked texts against gold texts, by character pairs."""
    h, g = F.col("hits"), F.col("gold")
    return texts(spark, sf).select("conv_id", E.text_recall_at(h, g, 5).alias("recall5"), E.text_mrr(h, g).alias("mrr"), E.lexical_recall(h, g).alias("lexical"))


@query()
def text_ndcg(spark, sf):
    """Each gold text counts once, by the first hit that covers it; held against brute force in the tests."""
    return texts(spark, sf).select("conv_id", E.text_ndcg_at(F.col("hits"), F.col("gold"), 5).alias("ndcg5"))


@query(f"WITH {J_SQL} SELECT doc_id % 50 AS query, avg((p >= 0.5)::INT) AS recall FROM j WHERE doc_id % 50 < 40 GROUP BY 1 UNION ALL SELECT DISTINCT doc_id % 50, 1.0 FROM labels WHERE doc_id % 50 >= 40")
def judged_context_recall(spark, sf):
    j = judged(spark, sf).withColumn("query", F.col("doc_id") % 50)
    return E.context_recall(j.where("query < 40").select("query", "p"), j.select("query").distinct())


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 WHEN 4 THEN 1.0 ELSE 0.5 END AS correctness FROM labels")
def judged_correctness(spark, sf):
    level = F.element_at(F.array(*[F.lit(x) for x in ("完全不一致", "大部分不一致", "部分一致", "基本一致", "完全一致", "说不清")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "labels").select("doc_id", E.correctness(level).alias("correctness"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0.5 ELSE (CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 2 END) / 2 END AS accuracy FROM orders")
def citation_accuracy(spark, sf):
    """Answers that cite nothing, two references of which the second is bad, or may be."""
    k = F.col("o_orderkey") % 4
    answer = F.when(k == 0, "none").when(k == 1, "a [1] b [2] c [1]").otherwise(F.concat(F.lit("a [1], b ["), (F.col("o_orderkey") % 5 + 2).cast("string"), F.lit("]")))
    return table(spark, sf, "orders").select("o_orderkey", E.citation_accuracy(answer, F.when(k == 1, F.array(F.lit(2), F.lit(7))).otherwise(F.array(F.lit(4)))).alias("accuracy"))


@query(f"WITH {J_SQL}, k AS (SELECT * FROM j WHERE doc_id % 3 = 0) SELECT 'quality' AS metric, round(avg(quality), 9) AS old, round(avg(p), 9) AS new, round(avg(p) - avg(quality), 9) AS delta FROM k UNION ALL SELECT 'toxic', round(avg(toxic), 9), round(avg(1 - p), 9), round(avg(1 - p) - avg(toxic), 9) FROM k")
def yardsticks(spark, sf):
    j = judged(spark, sf).withColumn("query", F.col("doc_id")).withColumn("r", 1 - F.col("p"))
    found = E.compare_yardsticks(j, j.where("query % 3 = 0"), {"quality": ("quality", "p"), "toxic": ("toxic", "r")})
    return found.select("metric", *[F.round(c, 9).alias(c) for c in ("old", "new", "delta")])


@query("""SELECT avg(CASE WHEN NOT a THEN r END) AS refused, avg(CASE WHEN a THEN r END) AS over_refused FROM (SELECT conv_id % 3 <> 0 AS a, (CASE WHEN turn % 4 = 1 THEN 1 WHEN text IS NULL THEN NULL ELSE regexp_matches(lower(text), 'cannot answer|can''t answer|no relevant|not found|unable to')::INT END)::DOUBLE AS r
FROM conversations WHERE role = 'assistant')""")
def refusal_rates(spark, sf):
    a = table(spark, sf, "conversations").where("role = 'assistant'")
    answer = F.when(F.col("turn") % 4 == 1, "抱歉，没有找到").otherwise(F.col("text"))
    return E.refusal_rates(a.select((F.col("conv_id") % 3 != 0).alias("answerable"), answer.alias("answer")))


@query("""WITH d AS (SELECT lang AS t, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS g FROM documents), l AS (SELECT DISTINCT t AS label FROM d UNION SELECT DISTINCT g FROM d),
c AS (SELECT label, count(*) FILTER (t = label AND g = label) AS tp, count(*) FILTER (t <> label AND g = label) AS fp, count(*) FILTER (t = label AND g <> label) AS fn FROM l, d GROUP BY label)
SELECT round(avg(tp / (tp + fp)), 6) AS precision, round(avg(tp / (tp + fn)), 6) AS recall, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS f1 FROM c""")
def macro_metrics(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("t"), F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang")).alias("g"))
    m = E.macro(E.by_class(d, "t", "g"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("SELECT o_custkey AS query, o_orderkey AS chunk, row_number() OVER w AS rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY 2 * (o_orderkey % 10 / 10) + o_orderkey % 7 / 7 DESC, o_orderkey) QUALIFY row_number() OVER w <= 5")
def prefiltered_gold(spark, sf):
    k = F.col("o_orderkey")
    return E.prefilter(table(spark, sf, "orders").select(F.col("o_custkey").alias("query"), k.alias("chunk"), (k % 10 / 10).alias("best"), (k % 7 / 7).alias("own")), 5).select("query", "chunk", "rank")


@query("SELECT doc_id, (quality * 10 + toxic * 10 + doc_id % 11 + 7) / 4 AS score, (quality * 10 + toxic * 10 + doc_id % 11 + 7) / 4 >= 6.5 AS passed FROM labels")
def quality_passes(spark, sf):
    p = E.quality_pass(F.col("quality") * 10, F.col("toxic") * 10, F.col("doc_id") % 11, F.lit(7))
    return table(spark, sf, "labels").select("doc_id", p.alias("p")).select("doc_id", "p.score", "p.passed")


@query("SELECT doc_id, (doc_id % 20) / 20 >= 0.85 AND (doc_id % 7) / 40 <= 0.10 AS usable FROM labels")
def usable_judges(spark, sf):
    return table(spark, sf, "labels").select("doc_id", E.usable(F.col("doc_id") % 20 / 20, F.col("doc_id") % 7 / 40).alias("usable"))
