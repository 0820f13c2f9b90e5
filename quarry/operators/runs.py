"""Evaluation sets and runs: question files, splits by document, ratings turned into questions, runs compared pair by pair; strategy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import analytics as A
from quarry.operators import evaluation as E

#: Strategies, roles and sources of a plan's steps, and a confirmed plan (fixed values).
STRUCTURE, RECURSIVE, SEMANTIC, MODEL = 1, 2, 3, 4
PRIMARY, FALLBACK, OPTIMIZE = 1, 2, 3
USER_ADD, USER_KEEP = 2, 3
CONFIRMED = 2
ADDED_REASON = "用户手动追加该策略。"


# --- question files ---------------------------------------------------------------------------------------------------

QUESTION = "id string, question string, ground_truth_answer string, relevant_contexts array<string>, relevant_chunk_ids array<string>, category string"


def generated_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Questions of generated files ({"questions": [...]}), one row each, with empty values for what an item leaves out.

    A file is one object, or with `lines` each of its lines is.

    Items without an id or a question are left out, and so are files without such a list or that are no JSON.
    """
    rows = spark.read.schema(f"questions array<struct<{QUESTION.replace(' string', ':string').replace(' array', ':array')}>>").option("multiLine", str(not lines).lower()).json(path)
    none = F.array().cast("array<string>")
    q = rows.select(F.explode("questions").alias("q")).select("q.*").where("id is not null and question is not null")
    return q.select("id", "question", F.coalesce("ground_truth_answer", F.lit("")).alias("ground_truth_answer"), F.coalesce("relevant_contexts", none).alias("relevant_contexts"), F.coalesce("relevant_chunk_ids", none).alias("relevant_chunk_ids"), F.coalesce(F.nullif("category", F.lit("")), F.lit("generated")).alias("category"))


def gold_answers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """id, chunk_ids, parent_ids of gold files ({"questions": {id: {"chunk_ids": [...], "parent_ids": [...]}}}); files of another form give no rows. lines: as there."""
    rows = spark.read.schema("questions map<string, struct<chunk_ids:array<string>, parent_ids:array<string>>>").option("multiLine", str(not lines).lower()).json(path)
    none = F.array().cast("array<string>")
    each = rows.select(F.explode("questions").alias("id", "g"))
    return each.select("id", F.coalesce("g.chunk_ids", none).alias("chunk_ids"), F.coalesce("g.parent_ids", none).alias("parent_ids"))


def with_gold(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """Questions with the chunks of the gold file, where it has the question; else their own."""
    own = F.col("relevant_chunk_ids")
    found = questions.join(gold.select("id", F.col("chunk_ids").alias("_gold")), "id", "left")
    return found.withColumn("relevant_chunk_ids", F.coalesce("_gold", own)).drop("_gold")


def subset(questions: DataFrame, name: str) -> DataFrame:
    """All questions, those that can't be answered ("unans"), or those whose id starts with the name."""
    if name == "all":
        return questions
    return questions.where(~F.coalesce(F.col("answerable"), F.lit(True))) if name == "unans" else questions.where(F.startswith(F.col("id"), F.lit(name)))


def question_splits(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question, split: the hint if it is "test" or "dev"; else "test" if any gold chunk lies in a test document; else "dev".

    questions: question, gold (chunk ids), hint; chunks: chunk, doc. Documents are split, not questions, so neighbours of a
    passage never stand on both sides. Gold chunks meet their documents by an equality join; unknown ones say nothing.
    """
    of_gold = questions.select("question", F.explode(F.array_distinct("gold")).alias("chunk")).join(chunks.select("chunk", "doc"), "chunk")
    tested = of_gold.where(E.split_of(F.col("doc").cast("string")) == "test").select("question").distinct().withColumn("_test", F.lit(True))
    split = F.when(F.col("hint").isin("test", "dev"), F.col("hint")).when(F.col("_test"), "test").otherwise("dev")
    return questions.join(tested, "question", "left").select("question", split.alias("split"))


def rated_exchanges(ratings: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Rows for the evaluation set from users' corrections: conversation, exchange, question, ground_truth, contexts, source_type.

    ratings: conversation, exchange, ground_truth; exchanges: conversation, exchange, question, contexts. A rating of an
    exchange that isn't there is left out; each of several ratings of one exchange gives a row.
    """
    return ratings.join(exchanges, ["conversation", "exchange"]).select("conversation", "exchange", "question", "ground_truth", "contexts", F.lit("user_feedback").alias("source_type"))


# --- runs -------------------------------------------------------------------------------------------------------------


def paired_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, question_id, x, y where both runs have a value. a, b: metric, question_id, value; of repeated rows the largest counts."""

    def one(run: DataFrame, name: str) -> DataFrame:
        return run.where("value is not null").groupBy("metric", "question_id").agg(F.max("value").alias(name))

    return one(a, "x").join(one(b, "y"), ["metric", "question_id"])


def pair_report(pairs: DataFrame, hit: float = 1.0) -> DataFrame:
    """metric, n, a, b (means), delta, only_a, only_b (questions that reach `hit` in one run only) and the exact two-sided p of those."""
    x, y = F.col("x") >= hit, F.col("y") >= hit
    means = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg("x").alias("a"), F.avg("y").alias("b"), F.avg(F.col("y") - F.col("x")).alias("delta"))
    tested = E.mcnemar(pairs, x, y, "metric").withColumnsRenamed({"b": "only_a", "c": "only_b"})
    return means.join(tested, "metric")


def significant(report: DataFrame) -> DataFrame:
    """A bootstrap's rows (low, high) with `significant`: the interval leaves out zero."""
    return report.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def stage_latencies(results: DataFrame) -> DataFrame:
    """stage, p50, p95, samples over completed questions with a time above zero. results: stage, status, ms.

    A stage that a run left out has no rows; a zero would feign a fast one.
    """
    timed = results.where((F.col("status") == "completed") & (F.col("ms") > 0))
    return A.percentiles(timed, "stage", "ms", {"p50": 0.5, "p95": 0.95}).join(timed.groupBy("stage").agg(F.count("*").alias("samples")), "stage")


def latency_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """stage, p50 and p95 of both runs (stage_latencies) and their differences, below zero where the second is faster; stages of both only."""
    of = lambda run, k: run.select("stage", F.col("p50").alias(f"p50_{k}"), F.col("p95").alias(f"p95_{k}"))
    both = of(a, "a").join(of(b, "b"), "stage")
    return both.withColumn("p50_change", F.col("p50_b") - F.col("p50_a")).withColumn("p95_change", F.col("p95_b") - F.col("p95_a"))


# --- strategy plans ---------------------------------------------------------------------------------------------------


def normalised_steps(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """The steps of each asked plan anew: plan, doc, step_no, pipeline, strategy, role, source, reason.

    requests: plan, doc, parents, children (strategies in the user's order; null counts as none); steps: plan, doc, step_no, pipeline,
    strategy, reason. Unknown strategies go. Parents come first, numbers go on through the children; the first step of a
    pipeline is the primary one, of the others the recursive ones are fallbacks. A step that the plan had before keeps its reason
    (the last one's, if it had several); plans without any asked step have no rows.
    """

    def listed(c: str, pipeline: str) -> Column:
        known = F.filter(F.coalesce(F.col(c), F.array().cast("array<int>")), lambda s: s.isin(STRUCTURE, RECURSIVE, SEMANTIC, MODEL))
        role = lambda s, i: F.when(i == 0, PRIMARY).when(s == RECURSIVE, FALLBACK).otherwise(OPTIMIZE)
        return F.transform(known, lambda s, i: F.struct(F.lit(pipeline).alias("pipeline"), s.alias("strategy"), role(s, i).alias("role")))

    asked = requests.select("plan", "doc", F.posexplode(F.concat(listed("parents", "parent"), listed("children", "child"))).alias("_no", "_s"))
    asked = asked.select("plan", "doc", (F.col("_no") + 1).alias("step_no"), "_s.*")
    had = steps.groupBy("plan", "doc", F.lower("pipeline").alias("pipeline"), "strategy").agg(F.max_by("reason", "step_no").alias("_reason"), F.lit(True).alias("_had"))
    both = asked.join(had, ["plan", "doc", "pipeline", "strategy"], "left")
    kept = F.coalesce("_had", F.lit(False))
    source, reason = F.when(kept, USER_KEEP).otherwise(USER_ADD), F.when(kept, F.col("_reason")).otherwise(ADDED_REASON)
    return both.select("plan", "doc", "step_no", "pipeline", "strategy", "role", source.alias("source"), reason.alias("reason"))


def confirmed_plans(plans: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Plans (plan, doc, status) with status, confirmed_by and confirmed_at from the last confirmation (plan, doc, user, at) of
    each, and `current`: the document's last confirmed plan. Confirmations of plans that aren't there change nothing (see unknown_confirmations)."""
    last = confirmations.groupBy("plan", "doc").agg(F.max(F.struct("at", "user")).alias("_c"))
    current = plans.join(last, ["plan", "doc"]).groupBy("doc").agg(F.max_by("plan", F.struct("_c.at", "plan")).alias("_current"))
    both = plans.join(last, ["plan", "doc"], "left").join(current, "doc", "left")
    status = F.when(F.col("_c").isNotNull(), CONFIRMED).otherwise(F.col("status"))
    return both.select("plan", "doc", status.alias("status"), F.col("_c.user").alias("confirmed_by"), F.col("_c.at").alias("confirmed_at"), F.coalesce(F.col("plan") == F.col("_current"), F.lit(False)).alias("current"))


def unknown_confirmations(plans: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Confirmations of plans that their document doesn't have."""
    return confirmations.join(plans, ["plan", "doc"], "left_anti")
