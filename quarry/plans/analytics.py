"""Queries of the dashboards. Events stand for usage and spans, conversations for sessions, the star schema for catalogues."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.operators import analytics as A
from quarry.operators import evaluation as E
from quarry.registry import query, table

DAY = "DATE '2024-01-15'"


@query(f"""SELECT count(*) AS total, count(*) FILTER (ts::DATE = {DAY}) AS today, round(avg(value), 6) AS avg_cost, round(coalesce(sum(value), 0), 2) AS total_cost,
round(coalesce(sum(value) FILTER (ts::DATE = {DAY}), 0), 2) AS today_cost, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events""")
def usage_overview(spark, sf):
    e = table(spark, sf, "events")
    o = A.overview(e, F.lit("2024-01-15").cast("date"), "value", F.col("event_type") == "error")
    return o.select("total", "today", F.round("avg_cost", 6).alias("avg_cost"), F.round("total_cost", 2).alias("total_cost"), F.round("today_cost", 2).alias("today_cost"), F.round("error_rate", 6).alias("error_rate"))


@query("SELECT ts::DATE AS day, count(*) AS calls, round(sum(value), 2) AS cost FROM events GROUP BY 1")
def usage_trend(spark, sf):
    return A.daily_trend(table(spark, sf, "events"), "value").withColumn("cost", F.round("cost", 2))


def status():
    return F.when(F.col("event_type") == "error", "error").otherwise("ok")


def root():
    return F.col("event_type") == "view"


@query("""SELECT user_id, count(*) AS spans, min(value) FILTER (event_type = 'view') AS duration, max(CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END) AS span_status,
bool_or(event_type = 'error') AS has_error FROM events GROUP BY user_id""")
def span_stats(spark, sf):
    return A.span_stats(table(spark, sf, "events"), "user_id", status(), "value", root())


@query(f"""SELECT count(DISTINCT user_id) AS traces, count(DISTINCT CASE WHEN ts::DATE = {DAY} THEN user_id END) AS traces_today,
count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS error_traces, round(avg(CASE WHEN event_type = 'view' THEN value END), 1) AS avg_root_ms FROM events""")
def trace_cards(spark, sf):
    return A.trace_cards(table(spark, sf, "events"), "user_id", status(), "value", root(), F.lit("2024-01-15").cast("date"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1")
def latest_exchange(spark, sf):
    return A.latest(table(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"])


@query("SELECT conv_id, count(*) AS exchanges FROM conversations GROUP BY conv_id")
def session_counts(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("exchanges"))


@query("SELECT count(DISTINCT conv_id) AS sessions FROM conversations WHERE role = 'user'")
def distinct_sessions(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").agg(F.countDistinct("conv_id").alias("sessions"))


@query("""SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system') WHERE back <= 4""")
def sliding_window_turns(spark, sf):
    return A.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", 4, F.col("role") == "system").select("conv_id", "turn", "role", F.col("back").cast("long").alias("back"))


@query("""SELECT conv_id, turn, ((n - 1) // 5)::INT AS batch FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
WHERE n <= c - 4""")
def overflow_batches(spark, sf):
    return A.overflow_batches(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "batch")


@query("""SELECT conv_id, turns, last_turn FROM (SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
ORDER BY last_turn DESC, turns DESC, conv_id DESC LIMIT 20 OFFSET 20""")
def session_page(spark, sf):
    s = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"))
    return A.page(s, [F.desc("last_turn"), F.desc("turns"), F.desc("conv_id")], 2, 20)


@query("""SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'the') OR contains(conv_id::VARCHAR, 'the')""")
def sessions_with_word(spark, sf):
    c = table(spark, sf, "conversations")
    return A.sessions_matching(c.select("conv_id").distinct().withColumn("title", F.lit("")), c, "conv_id", "title", "text", "the").select("conv_id")


@query("""SELECT conv_id, count(*) AS n FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'system') GROUP BY conv_id""")
def traces_with_status(spark, sf):
    c = table(spark, sf, "conversations")
    return c.join(c.where("role = 'system'").select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def scope_topic_join(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("""SELECT c_custkey, n_name AS scope, min(o_orderkey) AS topic FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_name""")
def doc_left_joins(spark, sf):
    """Document -> scope -> topics, one row a document: the smallest topic, where the last write would be arbitrary."""
    topics = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("topic"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(topics, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("n_name").alias("scope"), "topic")


@query("""SELECT o_orderkey, c_name, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def relation_by_score(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, sf, "orders").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")
    return ranked.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice", "rank")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def orphan_anti(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_semi(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT l_orderkey, l_linenumber, lag(l_linenumber, 1, 0) OVER w AS prev, lead(l_linenumber, 1, 0) OVER w AS next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def sibling_links(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber", 1, 0).over(w).alias("prev"), F.lead("l_linenumber", 1, 0).over(w).alias("next"))


@query("""WITH d AS (SELECT c_nationkey AS code, max(c_acctbal) AS score FROM customer GROUP BY 1)
SELECT code, score, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = code AND c_acctbal = score) AS reason FROM d""")
def derived_scope_max(spark, sf):
    """Best score of each code with the reason of the first maximum."""
    best = F.min(F.struct((-F.col("c_acctbal")).alias("s"), F.col("c_custkey").alias("reason")))
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.max("c_acctbal").alias("score"), best["reason"].alias("reason"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value > 0 GROUP BY 1")
def percentile_latency(spark, sf):
    found = A.percentiles(table(spark, sf, "events").where("value > 0"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95")])


@query("""SELECT event_type, list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p95 FROM events GROUP BY 1""")
def nearest_rank_p95(spark, sf):
    return A.nearest_rank(table(spark, sf, "events"), "event_type", "value").withColumnRenamed("value", "p95")


@query("""WITH b(le) AS (VALUES (10.0), (25.0), (50.0), (100.0), ('inf'::DOUBLE)),
c AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, b GROUP BY ALL),
w AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS t, max(CASE WHEN le < 'inf'::DOUBLE THEN le END) OVER (PARTITION BY event_type) AS f,
coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS below FROM c WINDOW o AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(min(CASE WHEN le = 'inf'::DOUBLE THEN f ELSE low + (le - low) * (0.9 * t - below) / (n - below) END), 6) AS value FROM w WHERE n >= 0.9 * t AND below < 0.9 * t GROUP BY 1""")
def histogram_p90(spark, sf):
    bounds = [10.0, 25.0, 50.0, 100.0, float("inf")]
    counts = table(spark, sf, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    buckets = counts.select("event_type", F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)])))
    return A.histogram_quantile(buckets, ["event_type"], 0.9).withColumn("value", F.round("value", 6))


@query("""WITH b(le) AS (VALUES (10.0), (25.0), (50.0), (100.0), ('inf'::DOUBLE)), q(q) AS (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)), c AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, b WHERE event_type IN ('view', 'click', 'purchase', 'error') GROUP BY ALL),
w AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS t, max(CASE WHEN le < 'inf'::DOUBLE THEN le END) OVER (PARTITION BY event_type) AS f, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS below FROM c WINDOW o AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, q, round(min(CASE WHEN le = 'inf'::DOUBLE THEN f ELSE low + (le - low) * (q * t - below) / (n - below) END), 6) AS value FROM w, q WHERE n >= q * t AND below < q * t GROUP BY ALL""")
def stage_quantiles(spark, sf):
    """p50, p90 and p99 of four histograms."""
    bounds = [10.0, 25.0, 50.0, 100.0, float("inf")]
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click", "purchase", "error"))
    counts = e.groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    buckets = counts.select("event_type", F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)])))
    return A.quantile_rows(buckets, ["event_type"], [0.5, 0.9, 0.99]).withColumn("value", F.round("value", 6))


@query("""SELECT l_returnflag AS channel, count(*) AS recalled, count(*) FILTER (l_discount <= 0.05) AS accepted, round(avg(l_tax), 4) AS avg_score FROM lineitem GROUP BY 1""")
def channel_summary(spark, sf):
    return A.channel_summary(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("channel"), (F.col("l_discount") <= 0.05).alias("accepted"), F.col("l_tax").alias("score")))


@query("""WITH p(model, i, o) AS (VALUES ('Brand#11', 2.0, 6.0), ('Brand#12', 1.5, 3.0))
SELECT p_brand AS model, round(sum((p_size - p_size // 4) * coalesce(i, 1.0) + (p_size // 4) * coalesce(i, 1.0) * 0.1 + p_size * coalesce(o, 2.0)) / 1e6, 8) AS cost FROM part LEFT JOIN p ON p_brand = model GROUP BY 1""")
def model_costs(spark, sf):
    prices = spark.createDataFrame([("Brand#11", 2.0, 6.0), ("Brand#12", 1.5, 3.0)], "model string, input_price double, output_price double")
    calls = table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.col("p_size").alias("prompt_tokens"), F.col("p_size").alias("completion_tokens"), F.floor(F.col("p_size") / 4).alias("cached_tokens"))
    return A.call_costs(calls, prices).groupBy("model").agg(F.round(F.sum("cost_usd"), 8).alias("cost"))


@query("SELECT round(sum(l_quantity) FILTER (l_returnflag = 'N') / sum(l_quantity), 4) AS hit_ratio FROM lineitem")
def prompt_cache_ratio(spark, sf):
    li = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0).alias("hit"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).otherwise(0).alias("miss"))
    return A.cache_hit_ratio(li, "hit", "miss")


@query("""SELECT o_orderpriority AS category, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ROLLUP(o_orderpriority)""")
def category_rollup(spark, sf):
    """Means by category with the total, as of keyword recall by category."""
    return A.by_category(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "category"), "category", "o_totalprice", 2)


@query("""SELECT l_orderkey, max(l_linenumber) AS depth, count(*) AS nodes FROM lineitem GROUP BY 1""")
def structure_stats(spark, sf):
    return A.structure_stats(table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("depth")), "l_orderkey")


@query("""SELECT count(*) AS completed, round(avg(o_totalprice), 2) AS avg_a, nullif(round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 2), 0) AS avg_b FROM orders WHERE o_orderstatus = 'F'""")
def evaluation_summary(spark, sf):
    """Count and means of completed runs; a mean of exactly 0 shows as NULL."""
    o = table(spark, sf, "orders")
    runs = o.select(F.when(F.col("o_orderstatus") == "F", "completed").alias("status"), F.col("o_totalprice").alias("avg_a"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("avg_b"))
    return A.completed_means(runs, "avg_a", "avg_b", digits=2)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'final' WHEN l_discount > 0 THEN 'rerank' WHEN l_tax > 0 THEN 'fusion' ELSE 'recall' END AS phase, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), l_quantity) AS shown FROM lineitem""")
def retrieval_phase(spark, sf):
    li = table(spark, sf, "lineitem")
    hits = li.select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").alias("selected"), F.col("l_discount").alias("rerank_score"), F.col("l_tax").alias("rrf_score"), F.col("l_quantity").alias("score"))
    return A.retrieval_phase(hits).select("l_orderkey", "l_linenumber", "phase", "shown")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'A' THEN l_linenumber END, CASE WHEN l_returnflag = 'R' THEN l_suppkey END, CASE WHEN l_linenumber > 2 THEN l_partkey END, 999) AS display_rank FROM lineitem""")
def display_rank(spark, sf):
    final, rrf = F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.display_rank(final, rrf, F.when(F.col("l_linenumber") > 2, F.col("l_partkey"))).cast("long").alias("display_rank"))


@query("""WITH q AS (SELECT o_orderstatus AS run, CASE WHEN o_orderkey % 7 = 0 THEN 'ok' WHEN o_orderkey % 2 = 0 THEN 'recall' WHEN o_orderkey % 3 = 0 THEN 'gate' WHEN o_orderkey % 5 = 0 THEN 'fusion' WHEN o_orderkey % 11 = 0 THEN 'rerank' ELSE 'final_cut' END AS stage FROM orders)
SELECT run, count(*) FILTER (stage = 'ok') AS ok, count(*) FILTER (stage = 'recall') AS recall, count(*) FILTER (stage = 'gate') AS gate, count(*) FILTER (stage = 'fusion') AS fusion, count(*) FILTER (stage = 'rerank') AS rerank, count(*) FILTER (stage = 'final_cut') AS final_cut FROM q GROUP BY 1""")
def stage_attribution(spark, sf):
    """Where the questions of each run lost their gold."""
    k = F.col("o_orderkey")
    stage = E.attribute_stage(k % 2 != 0, k % 3 != 0, k % 5 != 0, k % 11 != 0, k % 7 == 0)
    return A.stage_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("run"), stage.alias("stage")), ["ok", "recall", "gate", "fusion", "rerank", "final_cut"])


@query("""SELECT event_type, round(avg((value > 50)::INT), 6) AS coverage, count(*) AS decisions, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY 1""")
def decision_coverage(spark, sf):
    d = A.decision_coverage(table(spark, sf, "events").select(F.col("event_type").alias("flag"), (F.col("value") > 50).alias("answered"), F.col("value").alias("latency")))
    return d.select(F.col("flag").alias("event_type"), F.round("coverage", 6).alias("coverage"), "decisions", F.round("p50", 6).alias("p50"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM (SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def latest_task(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS up, count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1")
def feedback_counts(spark, sf):
    rating = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "error", -1)
    return A.feedback(table(spark, sf, "events").select("user_id", rating.alias("rating")), "user_id")


@query("""WITH a AS (SELECT event_type AS metric, avg(value) AS x FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) AS y FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT metric, round(y - x, 6) AS delta, CASE WHEN y - x > 0.005 THEN 'up' WHEN y - x < -0.005 THEN 'down' ELSE 'same' END AS trend FROM a FULL JOIN b USING (metric)""")
def compare_runs(spark, sf):
    """Means of two runs by metric: delta and its direction beyond a band of 0.005."""
    e = table(spark, sf, "events")
    run = lambda k: e.where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return A.compare_runs(run(0), run(1)).select("metric", F.round("delta", 6).alias("delta"), "trend")


@query("SELECT event_type AS term, count(*) AS n FROM events GROUP BY 1")
def term_counts(spark, sf):
    return A.term_counts(table(spark, sf, "events").withColumnRenamed("event_type", "term"), "term")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS trace, l_linenumber AS span, CASE WHEN l_linenumber > 1 THEN l_linenumber // 2 END AS parent FROM lineitem GROUP BY ALL), k AS (SELECT s.*, p.span IS NOT NULL AS known FROM s LEFT JOIN s p ON p.trace = s.trace AND p.span = s.parent),
d AS (SELECT trace, span, 0 AS depth, span::VARCHAR AS path FROM k WHERE NOT known UNION ALL SELECT k.trace, k.span, d.depth + 1, d.path || ' ' || k.span FROM k JOIN d ON k.trace = d.trace AND k.parent = d.span WHERE k.known) SELECT * FROM d""")
def span_waterfall(spark, sf):
    """The lines of an order as spans whose parent is the line of half their number."""
    n = F.col("l_linenumber")
    spans = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trace"), n.alias("span"), F.when(n > 1, F.floor(n / 2).cast("int")).alias("parent"), F.lit("2024-01-01").cast("timestamp").alias("start")).distinct()
    return A.waterfall(spans).select("trace", "span", "depth", F.regexp_replace("path", "[0-9]{20}/", "").alias("path"))


@query("SELECT c_custkey, c_name, NULL::INT AS status FROM customer WHERE false UNION ALL SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END FROM customer")
def soft_deletes(spark, sf):
    return A.soft_delete(table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("int").alias("status"), "c_acctbal"), F.col("c_acctbal") < 0).drop("c_acctbal")


@query("SELECT o_orderkey, l_linenumber AS node_no, o_orderpriority AS document FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def node_documents(spark, sf):
    """Structure nodes with their documents."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("node_no")).join(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("document")), "o_orderkey")


@query("SELECT l.doc_id, quality, toxic, d.source, d.lang FROM labels l JOIN documents d USING (doc_id)")
def profile_documents(spark, sf):
    """Profiles with their documents."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").select("doc_id", "quality", "toxic", "source", "lang")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'click') AND value >= 10 ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 25")
def route_trace_page(spark, sf):
    """The second page of traces by status and score, the latest first."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("error", "click") & (F.col("value") >= 10))
    return A.page(e, [F.desc("ts"), F.desc("event_id")], 2, 25).select("event_id", "event_type", "value")


@query("""(SELECT 'documents' AS listing, doc_id AS id FROM documents ORDER BY doc_id DESC LIMIT 10) UNION ALL (SELECT 'chunks', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY 2 LIMIT 10 OFFSET 10) UNION ALL
(SELECT 'evaluations', doc_id FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 10 OFFSET 20) UNION ALL (SELECT 'traces', event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)""")
def listing_pages(spark, sf):
    """Pages of the four listings."""
    chunks = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).distinct()
    parts = {
        "documents": A.page(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), [F.desc("id")], 1, 10), "chunks": A.page(chunks, [F.col("id")], 2, 10),
        "evaluations": A.page(table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), [F.col("id")], 3, 10),
        "traces": A.page(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")], 1, 10).select(F.col("event_id").alias("id")),
    }
    rows = [d.select(F.lit(k).alias("listing"), "id") for k, d in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
