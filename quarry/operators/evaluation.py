"""Evaluation: retrieval metrics, judges' statistics, significance tests, calibration and gold alignment."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as T

# --- ranked lists as arrays: `hits` in their order, `gold` distinct ----------------------------------------------------


def recall_at(hits: Column, gold: Column, k: int) -> Column:
    """Share of the gold ids among the first k hits; NULL without gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(hits, 1, k), gold)) / F.size(F.array_distinct(gold)))


def any_recall_at(hits: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) > 0, F.arrays_overlap(F.slice(hits, 1, k), gold).cast("double"))


def mrr(hits: Column, gold: Column) -> Column:
    """1 / position of the first gold hit; 0 if there is none, NULL without gold."""
    first = F.array_position(F.transform(hits, lambda h: F.array_contains(gold, h)), True)
    return F.when(F.size(gold) > 0, F.coalesce(F.try_divide(F.lit(1.0), first), F.lit(0.0)))


def ndcg_at(hits: Column, gold: Column, k: int) -> Column:
    """Binary gains, each gold id counted at its first place; NULL without gold."""
    head = F.slice(hits, 1, k)
    gain = F.transform(head, lambda h, i: F.when(F.array_contains(gold, h) & (F.array_position(head, h) == i + 1), 1 / F.log2(i + 2.0)).otherwise(0.0))
    best = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size(F.array_distinct(gold))))), lambda i: 1 / F.log2(i + 1.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(gold) > 0, total(gain) / total(best))


def average_precision(judged: DataFrame) -> DataFrame:
    """query, precision: mean of the precision at each relevant rank; 0 without relevant hits. judged: query, rank, relevant."""
    hits = F.sum(F.col("relevant").cast("int")).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    at = judged.withColumn("_p", F.when(F.col("relevant"), hits / n))
    return at.groupBy("query").agg(F.coalesce(F.avg("_p"), F.lit(0.0)).alias("precision"))


def overlap_pairs(snippets: DataFrame, texts: DataFrame, least: float, form: Callable[[Column], Column] = T.pair_form, single: bool = False) -> DataFrame:
    """snippet, chunk, ratio: texts that hold at least that share of a snippet's character pairs.

    snippets (snippet, text) are a stated query set: they meet all texts (chunk, text) in blocks that are small enough to
    send. Character pairs are too common for an equality join on them to leave anything out; those shared by a batch of texts
    and all snippets are counted by a matrix product.
    """
    from quarry.operators.ranking import query_blocks

    s = snippets.select("snippet", F.coalesce(form(F.col("text")), F.lit("")).alias("b"))
    t = texts.select("chunk", F.coalesce(form(F.col("text")), F.lit("")).alias("c"))
    return reduce(DataFrame.unionByName, [_block_overlaps(p, t, least, single) for p in query_blocks(s, "snippet")])


def _block_overlaps(snippets: DataFrame, texts: DataFrame, least: float, single: bool) -> DataFrame:
    """snippet, chunk, ratio of one block of snippets (snippet, b) and all texts (chunk, c), both in the form whose pairs count. single: a shorter form stands for itself."""

    def pairs(s: str) -> set[str]:
        return {s} if single and len(s) < 2 else {a + b for a, b in set(zip(s, s[1:], strict=False))}

    asked = [(r["snippet"], own) for r in snippets.collect() if (own := pairs(r["b"]))]
    at = {g: i for i, g in enumerate({g for _, own in asked for g in own})}
    wants = np.zeros((len(at), len(asked)), np.float32)
    for i, (_, own) in enumerate(asked):
        wants[[at[g] for g in own], i] = 1
    sizes = wants.sum(0).astype(np.float64)
    of_snippet, of_chunk = (to_arrow_type(d.schema[0].dataType) for d in (snippets, texts))
    names = pa.array([k for k, _ in asked], of_snippet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                held = np.zeros((part.num_rows, len(at)), np.float32)
                for i, text in enumerate(part.column(1)):
                    held[i, [k for k in map(at.get, pairs(text.as_py())) if k is not None]] = 1
                ratio = (held @ wants).astype(np.float64) / sizes
                i, j = np.nonzero(ratio >= least)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(ratio[i, j])], names=["snippet", "chunk", "ratio"])

    return texts.mapInArrow(run, f"snippet {snippets.schema[0].dataType.simpleString()}, chunk {texts.schema[0].dataType.simpleString()}, ratio double")


def align_gold(snippets: DataFrame, chunks: DataFrame, least: float = 0.92) -> DataFrame:
    """snippet, chunk, ratio: chunks that hold at least 92 % of a snippet's pairs in its matched form; a contained one has ratio 1."""
    return overlap_pairs(snippets, chunks, least, T.normalize_for_match, single=True)


def prefilter(candidates: DataFrame, k: int = 25) -> DataFrame:
    """The k candidates of each question with the largest 2 * best snippet ratio + question ratio. candidates: query, chunk, best, own."""
    from quarry.operators.ranking import top

    return top(candidates.withColumn("score", 2 * F.col("best") + F.col("own")), k, F.desc("score"), F.col("chunk"))


# --- ranked texts against gold texts, by character pairs ---------------------------------------------------------------


def covers(text: Column, gold: Column, least: float = 0.5) -> Column:
    """Whether a text holds enough of a gold text's character pairs; one too short for pairs must stand in it."""
    pairs = T.bigrams(gold)
    share = F.size(F.array_intersect(pairs, T.bigrams(text))) / F.size(pairs)
    inside = F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(F.trim(gold)))
    return F.when(F.trim(gold) == "", False).when(F.size(pairs) == 0, inside).otherwise(share >= least)


def text_recall_at(hits: Column, gold: Column, k: int) -> Column:
    """Share of the gold texts that one of the first k hits covers; 0 without gold or hits."""
    found = F.filter(gold, lambda g: F.exists(F.slice(hits, 1, k), lambda h: covers(h, g)))
    return F.when((F.size(gold) > 0) & (F.size(hits) > 0), F.size(found) / F.size(gold)).otherwise(0.0)


def text_mrr(hits: Column, gold: Column) -> Column:
    """1 / position of the first hit that covers a gold text, 4 decimals; 0 if there is none."""
    first = F.array_position(F.transform(hits, lambda h: F.exists(gold, lambda g: covers(h, g))), True)
    return F.when(first > 0, F.round(F.try_divide(F.lit(1.0), first), 4)).otherwise(0.0)


def text_ndcg_at(hits: Column, gold: Column, k: int) -> Column:
    """Binary gains, each gold text counted once, by the first hit that covers it; 4 decimals."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("gain"))

    def add(acc: Column, hit: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(gold) - 1), lambda i: ~F.array_contains(acc["used"], i) & covers(hit, F.get(gold, i)))
        got = F.get(free, F.lit(0))
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(got.isNotNull(), F.concat(acc["used"], F.array(got))).otherwise(acc["used"]).alias("used"),
            (acc["gain"] + F.when(got.isNotNull(), 1 / F.log2(acc["at"] + 1.0)).otherwise(0.0)).alias("gain"),
        )

    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.size(gold))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    gain = F.aggregate(F.slice(hits, 1, k), start, add, lambda acc: acc["gain"])
    return F.when((F.size(gold) > 0) & (F.size(hits) > 0), F.round(gain / best, 4)).otherwise(0.0)


def lexical_recall(hits: Column, gold: Column, least: float = 0.35) -> Column:
    """Share of the gold texts that some hit covers at the lower share; blank ones count as covered."""
    found = F.filter(gold, lambda g: (F.trim(g) == "") | F.exists(hits, lambda h: covers(h, g, least)))
    return F.when((F.size(gold) > 0) & (F.size(hits) > 0), F.size(found) / F.size(gold)).otherwise(0.0)


# --- judges -----------------------------------------------------------------------------------------------------------


def faithfulness(claims: DataFrame) -> DataFrame:
    """query, faithfulness: weighted share of supported claims (probability p); NULL where no claim was judged."""
    return claims.groupBy("query").agg((F.sum(T.probability_weight(F.col("p"))) / F.count("p")).alias("faithfulness"))



#: Values of a judge's levels of correctness (fixed values); unknown levels count as the middle one.
CORRECTNESS = {"完全不一致": 0.0, "大部分不一致": 0.25, "部分一致": 0.50, "基本一致": 0.75, "完全一致": 1.0}


def correctness(level: Column) -> Column:
    return reduce(lambda w, kv: w.when(level == kv[0], kv[1]), CORRECTNESS.items(), F.when(F.lit(False), 0.0)).otherwise(0.50)


def context_recall(statements: DataFrame, questions: DataFrame) -> DataFrame:
    """query, recall: share of a question's statements that the context covers (probability from 0.5 on); 1 without statements."""
    share_ = statements.groupBy("query").agg(F.avg((F.coalesce("p", F.lit(0.0)) >= 0.5).cast("double")).alias("recall"))
    return questions.select("query").join(share_, "query", "left").select("query", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def citation_accuracy(answer: Column, bad: Column) -> Column:
    """Share of the references that an answer cites which are not bad; NULL where it cites none."""
    from quarry.operators.safety import citations

    cited = citations(answer)
    return F.try_divide(F.size(F.array_except(cited, F.coalesce(bad, F.array().cast("array<int>")))), F.nullif(F.size(cited), F.lit(0)))


def compare_yardsticks(results: DataFrame, gold: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """metric, old, new, delta: means of two yardsticks over the questions that have gold (query). metrics: name -> (old, new) column."""
    kept = results.join(gold.select("query").distinct(), "query", "left_semi")
    means = kept.agg(*[F.avg(c).alias(f"{name}_{k}") for name, pair in metrics.items() for k, c in enumerate(pair)])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}_0").alias("old"), F.col(f"{name}_1").alias("new")) for name in metrics])
    return means.select(F.inline(rows)).withColumn("delta", F.col("new") - F.col("old"))


def quality_pass(*criteria: Column, least: float = 6.5) -> Column:
    mean = sum(criteria[1:], criteria[0]) / len(criteria)
    return F.struct(mean.alias("score"), (mean >= least).alias("passed"))


def confusion(df: DataFrame, truth: Column, guess: Column, *key: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; 0 where a denominator is 0."""
    counts = df.groupBy(*key).agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    return with_rates(counts).withColumn("accuracy", share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", share(2 * p * r, p + r))


def by_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall and f1 of each class, in one aggregation over (label, role) rows."""
    rows = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit("t").alias("role"), (F.col(truth) == F.col(guess)).alias("hit")), F.struct(F.col(guess).alias("label"), F.lit("g").alias("role"), (F.col(truth) == F.col(guess)).alias("hit")))).alias("x")).select("x.*")
    counts = rows.where("label is not null").groupBy("label").agg(F.count_if((F.col("role") == "t") & F.col("hit")).alias("tp"), F.count_if((F.col("role") == "g") & ~F.col("hit")).alias("fp"), F.count_if((F.col("role") == "t") & ~F.col("hit")).alias("fn"))
    return with_rates(counts)


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


# --- calibration ------------------------------------------------------------------------------------------------------


def auc(df: DataFrame, p: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties one half; NULL without both classes.

    Counts of each distinct score are summed up in the order of scores, by ranges first, so no task sorts all rows.
    """
    steps = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ordered = running(steps, "p", ["neg"])
    return ordered.agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def running(df: DataFrame, order: str | Sequence[str], counts: Sequence[str]) -> DataFrame:
    """df with `<count>_before`: the sum over all rows before in the order (its values are distinct).

    Ranges are summed in parallel, and only the ranges' totals meet in one place.
    """
    order = [order] if isinstance(order, str) else list(order)
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in counts])
    own = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_before") for c in counts]).join(offsets, "_part")
    for c in counts:
        own = own.withColumn(f"{c}_before", F.col(f"{c}_before") + F.col(f"_{c}"))
    return own.drop("_part", *[f"_{c}" for c in counts])


def ece(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins."""
    b = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def choose_threshold(df: DataFrame, p: str, label: str, most_false: float = 0.05) -> DataFrame:
    """threshold, recall, false_pass: of the scores whose share of negatives at or above is small enough, the one with the most recall, the largest of equals."""
    steps = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ordered = running(steps, "threshold", ["pos", "neg"]).crossJoin(F.broadcast(steps.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))))
    rated = ordered.select("threshold", share(F.col("_p") - F.col("pos_before"), F.col("_p")).alias("recall"), share(F.col("_n") - F.col("neg_before"), F.col("_n")).alias("false_pass"))
    best = F.max_by(F.struct("threshold", "recall", "false_pass"), F.struct("recall", "threshold"))
    return rated.where(F.col("false_pass") <= most_false).agg(best.alias("b")).select("b.*")


def usable(auc_: Column, ece_: Column) -> Column:
    return (auc_ >= 0.85) & (ece_ <= 0.10)


# --- significance -----------------------------------------------------------------------------------------------------


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """question_id, x, y where both runs have a value."""
    return a.select("question_id", F.col(metric).alias("x")).join(b.select("question_id", F.col(metric).alias("y")), "question_id").where("x is not null and y is not null")


def mcnemar(pairs: DataFrame, x: Column, y: Column, *key: str) -> DataFrame:
    """key, b (only the first right), c (only the second), and the exact two-sided p-value; 1 without discordant pairs."""
    counts = pairs.groupBy(*key).agg(F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"))

    @F.pandas_udf("double")
    def exact(b: pd.Series, c: pd.Series) -> pd.Series:
        def p(n: int, k: int) -> float:
            if not n:
                return 1.0
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
            return min(1.0, 2 * tail)

        return pd.Series([p(int(i + j), int(min(i, j))) for i, j in zip(b, c, strict=True)])

    return counts.withColumn("p", exact("b", "c"))


def bootstrap(pairs: DataFrame, metric: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """metric, delta, low, high, p_value of mean(y - x) for each metric, from n resamples. pairs: metric, question_id, x, y.

    A question's weight in a resample is drawn from a Poisson distribution by a hash of its id, so no task sees more than
    its own questions, and the result doesn't depend on their partitions. Only n sums a metric meet.
    """
    chances = np.exp(-1.0 - np.array([math.lgamma(i + 1) for i in range(20)]))
    steps, resample = np.cumsum(chances), np.arange(n, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)

    def weights(ids: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = ids.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + resample[None, :] * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return np.searchsorted(steps, ((x ^ x >> np.uint64(31)) >> np.uint64(11)) / float(1 << 53))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            ids, d = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for name in set(names.tolist()):
                at = np.flatnonzero(names == name)
                total = held.setdefault(name, np.zeros((2, n)))
                for k in range(0, len(at), 500):
                    w = weights(ids[at[k : k + 500]])
                    total += np.stack([d[at[k : k + 500]] @ w, w.sum(axis=0)])
        for name, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["metric", "resample", "d", "w"])

    rows = pairs.select(F.col(metric).cast("string").alias("metric"), F.xxhash64("question_id").alias("id"), (F.col("y") - F.col("x")).cast("double").alias("d"))
    drawn = rows.mapInArrow(sums, "metric string, resample int, d double, w double").groupBy("metric", "resample").agg((F.sum("d") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ordered = drawn.groupBy("metric").agg(F.array_sort(F.collect_list("m")).alias("m"))
    worse = F.size(F.filter("m", lambda x: x <= 0)) / F.size("m")
    at = lambda share: F.get("m", F.least(F.floor(F.size("m") * share), F.size("m") - 1).cast("int"))
    known = rows.groupBy("metric").agg(F.avg("d").alias("delta")).join(ordered, "metric")
    return known.select(F.col("metric").alias(metric), "delta", at(0.025).alias("low"), at(0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(worse, 1 - worse)).alias("p_value"))


# --- reports ----------------------------------------------------------------------------------------------------------


def probe_summary(probes: DataFrame) -> DataFrame:
    """zero_hit, avg_hits, coverage, mrr of channel probes (hits, gold)."""
    h, g = F.col("hits"), F.col("gold")
    return probes.agg(F.avg((F.size(h) == 0).cast("double")).alias("zero_hit"), F.avg(F.size(h)).alias("avg_hits"), F.avg(any_recall_at(h, g, 1 << 30)).alias("coverage"), F.avg(mrr(h, g)).alias("mrr"))


def attribute_stage(recalled: Column, gated: Column, fused: Column, reranked: Column, final: Column) -> Column:
    """Where a question's gold was lost: the first stage without it; "ok" if it is in the final hits."""
    return F.when(final, "ok").when(~recalled, "recall").when(~gated, "gate").when(~fused, "fusion").when(~reranked, "rerank").otherwise("final_cut")


def gate_violations(metrics: DataFrame) -> DataFrame:
    """metric, value, threshold below its gate; thresholds of 0 and missing values are passed over."""
    return metrics.where((F.col("threshold") > 0) & F.col("value").isNotNull() & (F.col("value") < F.col("threshold")))


def judge_coverage(results: DataFrame, *metrics: str) -> DataFrame:
    """Share of completed results with a score, for each metric, and the smallest of them."""
    done = results.where("status = 'completed'").agg(*[F.avg(F.col(m).isNotNull().cast("double")).alias(m) for m in metrics])
    return done.withColumn("coverage", F.least(*metrics) if len(metrics) > 1 else F.col(metrics[0]))


def experiment_matrix(samples: DataFrame, strategies: DataFrame) -> DataFrame:
    """All (strategy, sample) pairs; strategies are a short parameter list (256 at most)."""
    if strategies.limit(257).count() > 256:
        raise ValueError("a matrix takes 256 strategies at most")
    return samples.crossJoin(F.broadcast(strategies))


def split_of(question: Column) -> Column:
    """"test" for a quarter of the ids (number, or sum of character codes, divisible by 4), else "dev"."""
    code = F.aggregate(F.filter(F.split(question, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.ascii(c))
    return F.when(F.pmod(F.coalesce(question.try_cast("long"), code.cast("long")), F.lit(4)) == 0, "test").otherwise("dev")


#: Phrases of refusals (fixed values).
REFUSALS = "无法回答|没有找到|未找到|暂无相关|不在知识库|抱歉|cannot answer|can't answer|no relevant|not found|unable to"


def is_refusal(answer: Column) -> Column:
    """NULL for a blank answer."""
    return F.when(F.coalesce(F.trim(answer), F.lit("")) != "", F.regexp(F.lower(answer), F.lit(REFUSALS)))


def refusal_rates(results: DataFrame) -> DataFrame:
    """Right refusals of unanswerable questions, and wrong ones of answerable questions."""
    r = is_refusal(F.col("answer")).cast("double")
    return results.agg(F.avg(F.when(~F.col("answerable"), r)).alias("refused"), F.avg(F.when(F.col("answerable"), r)).alias("over_refused"))


def perturb(answer: Column, how: str, seed: int = 42) -> Column:
    """A damaged copy of an answer for judges' audits: number, polarity, condition, verbosity or citation."""
    if how == "number":
        return F.regexp_replace(answer, r"(\d)(?=\D|$)", F.lit(str(seed % 9 + 1)))
    if how == "polarity":
        return F.when(F.contains(answer, F.lit("不")), F.regexp_replace(answer, "不", "")).when(F.regexp(answer, F.lit(r"\bnot\b")), F.regexp_replace(answer, r"\bnot ", "")).otherwise(F.regexp_replace(answer, r"(可以|应当|\bis\b|\bare\b|\bcan\b)", "$1 not"))
    if how == "condition":
        return F.regexp_replace(answer, r"(如果|若|除非|if|unless)[^，,。.]*[，,]", "")
    if how == "verbosity":
        return F.concat(answer, F.lit("\n"), answer)
    if how == "citation":
        return F.regexp_replace(answer, r"\[(\d+)\]", "（来源$1）")
    raise ValueError(how)


def distinct_questions(questions: DataFrame) -> DataFrame:
    """One question of each matched form, the smallest id."""
    return questions.withColumn("_k", T.normalize_for_match(F.col("question"))).groupBy("_k").agg(F.min_by(F.struct(*questions.columns), "id").alias("q")).select("q.*")
