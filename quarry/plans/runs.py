"""Queries of evaluation sets, compared runs and strategy plans: events as results of two runs, orders as plans, their lines as steps."""

from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.operators import runs as R
from quarry.registry import query, table
from quarry.sources.files import shared_folder

#: Events as values of two runs, by user; a question is an event's number in its run.
PAIRS_SQL = """v AS (SELECT user_id % 2 AS run, event_type AS metric, event_id // 7 AS question_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT a.metric, a.value AS x, b.value AS y FROM v a JOIN v b USING (metric, question_id) WHERE a.run = 0 AND b.run = 1)"""


def run_values(spark, sf, run):
    e = table(spark, sf, "events").where(F.col("user_id") % 2 == run)
    return e.select(F.col("event_type").alias("metric"), F.floor(F.col("event_id") / 7).alias("question_id"), "value")


@query(f"""WITH {PAIRS_SQL}, m AS (SELECT metric, count(*) AS n, round(avg(x), 6) AS a, round(avg(y), 6) AS b, round(avg(y - x), 6) AS delta, count(*) FILTER (x >= 50 AND y < 50) AS only_a, count(*) FILTER (x < 50 AND y >= 50) AS only_b FROM p GROUP BY 1),
t AS (SELECT *, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM m)
SELECT metric, n, a, b, delta, only_a, only_b, round(least(1.0, 2 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)))), 6) AS p FROM t GROUP BY ALL""")
def run_pairs(spark, sf):
    """Two runs question by question: means, their difference, and an exact test of the questions that only one of them answers."""
    report = R.pair_report(R.paired_values(run_values(spark, sf, 0), run_values(spark, sf, 1)), 50)
    return report.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta")], "only_a", "only_b", F.round("p", 6).alias("p"))


@query()
def run_significance(spark, sf):
    """Intervals of the differences between two runs from 2000 resamples of their questions."""
    return R.significant(E.bootstrap(R.paired_values(run_values(spark, sf, 0), run_values(spark, sf, 1)), "metric"))


@query("""WITH l AS (SELECT user_id % 2 AS run, event_type AS stage, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events WHERE event_id % 10 <> 3 AND value > 0 GROUP BY ALL)
SELECT stage, round(a.p50, 6) AS p50_a, round(a.p95, 6) AS p95_a, round(b.p50, 6) AS p50_b, round(b.p95, 6) AS p95_b, round(b.p50 - a.p50, 6) AS p50_change, round(b.p95 - a.p95, 6) AS p95_change FROM l a JOIN l b USING (stage) WHERE a.run = 0 AND b.run = 1""")
def run_latencies(spark, sf):
    """Latencies of two runs' stages side by side."""
    status = F.when(F.col("event_id") % 10 == 3, "failed").otherwise("completed")
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("stage"), status.alias("status"), F.col("value").alias("ms"))
    both = R.latency_changes(*[R.stage_latencies(rows.where(F.col("user_id") % 2 == k)) for k in (0, 1)])
    return both.select("stage", *[F.round(c, 6).alias(c) for c in both.columns if c != "stage"])


@query("""SELECT l_orderkey AS question, CASE WHEN l_orderkey % 10 = 1 THEN 'test' WHEN l_orderkey % 10 = 2 THEN 'dev' WHEN bool_or(p_size % 4 = 0) THEN 'test' ELSE 'dev' END AS split
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def question_splits(spark, sf):
    """Orders as questions, the parts of their lines as gold chunks, parts of one size as a document."""
    k = F.col("l_orderkey")
    hint = F.when(k % 10 == 1, "test").when(k % 10 == 2, "dev").when(k % 10 == 3, "other")
    asked = table(spark, sf, "lineitem").groupBy(k.alias("question")).agg(F.collect_set("l_partkey").alias("gold"), F.first(hint).alias("hint"))
    return R.question_splits(asked, table(spark, sf, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_size").alias("doc")))


@query("""SELECT c.conv_id AS conversation, c.turn AS exchange, c.text AS question, 'truth ' || event_id AS ground_truth, [c.role] AS contexts, 'user_feedback' AS source_type
FROM events e JOIN conversations c ON e.user_id = c.conv_id AND e.event_id % 4 = c.turn WHERE c.role = 'user'""")
def rated_exchanges(spark, sf):
    """Events as corrections of the turns that users asked; those of other turns give nothing."""
    e = table(spark, sf, "events")
    ratings = e.select(F.col("user_id").alias("conversation"), (F.col("event_id") % 4).alias("exchange"), F.concat(F.lit("truth "), F.col("event_id")).alias("ground_truth"))
    turns = table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("exchange"), F.col("text").alias("question"), F.array("role").alias("contexts"))
    return R.rated_exchanges(ratings, turns)


@query("""WITH r AS (SELECT o_orderkey AS plan, o_custkey AS doc, unnest([1, 2, 3, 4, 5]) AS k, CASE k WHEN 1 THEN o_orderkey % 6 WHEN 2 THEN 2 WHEN 3 THEN o_custkey % 5 WHEN 4 THEN 3 ELSE 2 END AS strategy, CASE WHEN k <= 2 THEN 'parent' ELSE 'child' END AS pipeline FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY k) AS step_no, row_number() OVER (PARTITION BY plan, pipeline ORDER BY k) AS i FROM r WHERE strategy BETWEEN 1 AND 4),
h AS (SELECT l_orderkey AS plan, CASE WHEN l_linenumber % 2 = 0 THEN 'parent' ELSE 'child' END AS pipeline, l_suppkey % 5 AS strategy, arg_max('step ' || l_linenumber, l_linenumber) AS reason FROM lineitem GROUP BY ALL)
SELECT plan, doc, step_no, pipeline, strategy, CASE WHEN i = 1 THEN 1 WHEN strategy = 2 THEN 2 ELSE 3 END AS role, CASE WHEN h.reason IS NULL THEN 2 ELSE 3 END AS source, coalesce(h.reason, '用户手动追加该策略。') AS reason FROM s LEFT JOIN h USING (plan, pipeline, strategy)""")
def plan_steps(spark, sf):
    """Orders as plans whose steps are asked anew, their lines as the steps that they had."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ints = lambda *x: F.array(*x).cast("array<int>")
    asked = o.select(k.alias("plan"), c.alias("doc"), ints(k % 6, F.lit(2)).alias("parents"), ints(c % 5, F.lit(3), F.lit(2)).alias("children"))
    n = F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan"), n.alias("step_no"), F.when(n % 2 == 0, "PARENT").otherwise("CHILD").alias("pipeline"), (F.col("l_suppkey") % 5).cast("int").alias("strategy"), F.concat(F.lit("step "), n).alias("reason"))
    return R.normalised_steps(asked, lines.join(asked.select("plan", "doc"), "plan"))


@query("""WITH c AS (SELECT l_orderkey AS plan, max(l_linenumber) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
p AS (SELECT o_orderkey AS plan, o_custkey AS doc, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS status, t, row_number() OVER (PARTITION BY o_custkey ORDER BY t DESC NULLS LAST, o_orderkey DESC) AS i FROM orders LEFT JOIN c ON o_orderkey = plan)
SELECT plan, doc, CASE WHEN t IS NULL THEN status ELSE 2 END AS status, t * 10 AS confirmed_by, t AS confirmed_at, t IS NOT NULL AND i = 1 AS current FROM p""")
def plan_confirmations(spark, sf):
    """Orders as plans, their returned lines as confirmations in the order of their numbers."""
    plans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("plan"), F.col("o_custkey").alias("doc"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("status"))
    n = F.col("l_linenumber")
    given = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("plan"), (n * 10).alias("user"), n.alias("at")).join(plans.select("plan", "doc"), "plan")
    return R.confirmed_plans(plans, given)


@query("""SELECT item_id::VARCHAR AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'a' ELSE '' END AS ground_truth_answer, CASE WHEN length(text) > 200 THEN ['g' || item_id] ELSE [item_id::VARCHAR] END AS relevant_chunk_ids, 'generated' AS category FROM benchmark WHERE text IS NOT NULL""")
def question_files(spark, sf):
    """Benchmark items through lines of generated questions, a list each, and of gold chunks for the long ones."""
    b, path = table(spark, sf, "benchmark"), shared_folder(spark, "question-files")
    item = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "a").alias("ground_truth_answer"), F.array(F.col("item_id").cast("string")).alias("relevant_chunk_ids"))
    b.select(F.to_json(F.struct(F.array(item).alias("questions"))).alias("value")).write.text(f"{path}/generated", lineSep="\n")
    gold = F.struct(F.array(F.concat(F.lit("g"), F.col("item_id"))).alias("chunk_ids"))
    b.where("length(text) > 200").select(F.to_json(F.struct(F.create_map(F.col("item_id").cast("string"), gold).alias("questions")))).write.text(f"{path}/gold")
    found = R.with_gold(R.generated_questions(spark, f"{path}/generated", lines=True), R.gold_answers(spark, f"{path}/gold", lines=True))
    return found.select("id", "question", "ground_truth_answer", "relevant_chunk_ids", "category")
