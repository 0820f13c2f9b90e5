"""Dashboards over usage, spans, conversations and traces: aggregates, groupwise picks, pages and cost."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import trees

#: Statuses of spans (fixed values), worst first. `max` over the strings would hide errors behind "ok".
ERROR_STATUS = "error"
#: Price per million tokens of a model that no table knows (fixed values), and what a cached prompt token costs of it.
DEFAULT_PRICE, CACHE_FACTOR = (1.0, 2.0), 0.1


def overview(usage: DataFrame, today: Column, cost: str, failed: Column, ts: str = "ts") -> DataFrame:
    """One row over all usage: totals, today's share, the mean of non-null costs and the error rate, in one pass."""
    day = F.to_date(ts) == today
    return usage.agg(
        F.count("*").alias("total"),
        F.count_if(day).alias("today"),
        F.avg(cost).alias("avg_cost"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum(F.when(day, F.col(cost))), F.lit(0.0)).alias("today_cost"),
        F.coalesce(F.try_divide(F.count_if(failed), F.count("*")), F.lit(0.0)).alias("error_rate"),
    )


def daily_trend(usage: DataFrame, cost: str, ts: str = "ts") -> DataFrame:
    return usage.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("calls"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"))


def span_stats(spans: DataFrame, trace: str, status: Column, duration: str, root: Column) -> DataFrame:
    """One row a trace: spans, the root's shortest duration, the largest status string and whether any span failed."""
    return spans.groupBy(trace).agg(
        F.count("*").alias("spans"),
        F.min(F.when(root, F.col(duration))).alias("duration"),
        F.max(status).alias("span_status"),
        F.coalesce(F.bool_or(status == ERROR_STATUS), F.lit(False)).alias("has_error"),
    )


def trace_cards(spans: DataFrame, trace: str, status: Column, duration: str, root: Column, today: Column, ts: str = "ts") -> DataFrame:
    """Totals over traces, with the mean duration of root spans to one decimal."""
    return spans.agg(
        F.countDistinct(trace).alias("traces"),
        F.countDistinct(F.when(F.to_date(ts) == today, F.col(trace))).alias("traces_today"),
        F.countDistinct(F.when(status == ERROR_STATUS, F.col(trace))).alias("error_traces"),
        F.round(F.avg(F.when(root, F.col(duration))), 1).alias("avg_root_ms"),
    )


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest `order` of each key, all columns; ties by the columns that follow."""
    picked = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*key).agg(picked.alias("_row")).select("_row.*")


def last_turns(df: DataFrame, key: str, order: str, size: int = 4, skip: Column | None = None) -> DataFrame:
    """The last `size` rows of each key, without those that `skip` holds for."""
    rows = df if skip is None else df.where(~skip)
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("back") <= size)


def overflow_batches(df: DataFrame, key: str, order: str, keep: int = 4, batch: int = 5) -> DataFrame:
    """All rows but the last `keep` of each key, numbered in batches of `batch`, oldest first."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("_all", F.count("*").over(w))
    return ranked.where(F.col("_n") <= F.col("_all") - keep).withColumn("batch", F.floor((F.col("_n") - 1) / batch).cast("int")).drop("_n", "_all")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1); the order must be total for pages to be disjoint."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def sessions_matching(sessions: DataFrame, exchanges: DataFrame, key: str, title: str, body: str, word: str) -> DataFrame:
    """Sessions whose id or title holds a word, or that have an exchange which does."""
    hits = exchanges.where(F.contains(F.lower(body), F.lit(word.lower()))).select(key).distinct().withColumn("_hit", F.lit(True))
    own = F.contains(F.lower(F.col(key).cast("string")), F.lit(word.lower())) | F.contains(F.lower(title), F.lit(word.lower()))
    return sessions.join(hits, key, "left").where(F.coalesce(F.col("_hit"), F.lit(False)) | F.coalesce(own, F.lit(False))).drop("_hit")


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call: prices (model, input_price, output_price, per million) by model, by the part after a slash, else the default.

    Columns: model, prompt_tokens, completion_tokens, cached_tokens (part of the prompt). Prices are a small table, one row a model.
    """
    p = prices.select(F.col("model").alias("_m"), F.col("input_price").alias("_i"), F.col("output_price").alias("_o"))
    tail = F.substring_index("model", "/", -1)
    q = p.toDF("_m2", "_i2", "_o2")
    joined = calls.join(p, F.col("model") == F.col("_m"), "left").join(q, tail == F.col("_m2"), "left")
    rate_in, rate_out = F.coalesce("_i", "_i2", F.lit(DEFAULT_PRICE[0])), F.coalesce("_o", "_o2", F.lit(DEFAULT_PRICE[1]))
    cached = F.coalesce("cached_tokens", F.lit(0))
    cost = ((F.col("prompt_tokens") - cached) * rate_in + cached * rate_in * CACHE_FACTOR + F.col("completion_tokens") * rate_out) / 1e6
    return joined.withColumn("cost_usd", cost).drop("_m", "_i", "_o", "_m2", "_i2", "_o2")


def cache_hit_ratio(df: DataFrame, hit: str, miss: str) -> DataFrame:
    return df.agg(F.round(F.coalesce(F.try_divide(F.sum(hit), F.sum(hit) + F.sum(miss)), F.lit(0.0)), 4).alias("hit_ratio"))


def histogram_quantile(buckets: DataFrame, key: Sequence[str], q: float, bound: str = "le", count: str = "count") -> DataFrame:
    """Quantile from cumulative buckets, linear inside a bucket; the last (infinite) bucket gives the largest finite bound.

    NULL for keys without observations.
    """
    w = Window.partitionBy(*key).orderBy(bound)
    total = F.max(count).over(Window.partitionBy(*key))
    finite = F.max(F.when(F.col(bound) < float("inf"), F.col(bound))).over(Window.partitionBy(*key))
    low, below = F.coalesce(F.lag(bound).over(w), F.lit(0.0)), F.coalesce(F.lag(count).over(w), F.lit(0))
    rows = buckets.withColumn("_t", total).withColumn("_f", finite).withColumn("_low", low).withColumn("_below", below).withColumn("_rank", F.lit(q) * F.col("_t"))
    first = rows.where((F.col(count) >= F.col("_rank")) & (F.col("_below") < F.greatest(F.col("_rank"), F.lit(1e-300))) & (F.col("_t") > 0))
    inside = F.col("_low") + (F.col(bound) - F.col("_low")) * F.try_divide(F.col("_rank") - F.col("_below"), F.col(count) - F.col("_below"))
    value = F.when(F.col(bound) == float("inf"), F.col("_f")).otherwise(inside)
    found = first.groupBy(*key).agg(F.min(value).alias("value"))
    return buckets.select(*key).distinct().join(found, list(key), "left")


def quantile_rows(buckets: DataFrame, key: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """key, q, value: several quantiles of each histogram, as a dashboard lists them."""
    parts = [histogram_quantile(buckets, key, q).withColumn("q", F.lit(q)) for q in quantiles]
    return reduce(DataFrame.unionByName, parts).select(*key, "q", "value")


def at_ranks(df: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """key, n and for each name the value at that rank (from 0, an expression over n) in the key's order of values; nulls out.

    Equal values are counted first, and the counts are summed over ranges of (key, value), so no task holds a key's values.
    """
    from quarry.operators.evaluation import running

    steps = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = running(steps, ["k", "v"], ["c"])
    keys = placed.groupBy("k").agg(F.min("c_before").alias("base"), F.sum("c").alias("n"))
    own = placed.join(keys, "k").withColumn("low", F.col("c_before") - F.col("base"))
    here = {name: F.max(F.when((rank >= F.col("low")) & (rank < F.col("low") + F.col("c")), F.col("v"))).alias(name) for name, rank in ranks.items()}
    return own.groupBy("k", "n").agg(*here.values()).withColumnRenamed("k", key)


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and for each name its percentile, linear between ranks. Keys without values are left out."""
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ranks = {f"{name}_{end}": fn(p) for name, p in place.items() for end, fn in (("low", F.floor), ("high", F.ceil))}
    found = at_ranks(df, key, value, ranks)
    return found.select(key, *[(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (p - F.floor(p))).alias(name) for name, p in place.items()])


def nearest_rank(df: DataFrame, key: str, value: str, q: float = 0.95) -> DataFrame:
    """key, value at round(q * (n - 1)), half to even."""
    return at_ranks(df, key, value, {"value": F.bround(F.lit(q) * (F.col("n") - 1))}).select(key, "value")


def channel_summary(hits: DataFrame) -> DataFrame:
    """channel, recalled, accepted, avg_score (4 decimals). hits: channel, accepted (boolean), score."""
    return hits.groupBy("channel").agg(F.count("*").alias("recalled"), F.count_if("accepted").alias("accepted"), F.round(F.avg("score"), 4).alias("avg_score"))


def completed_means(runs: DataFrame, *metrics: str, digits: int = 4) -> DataFrame:
    """completed and the mean of each metric over completed runs; a mean of exactly 0, or of nothing, shows as NULL."""
    done = runs.where("status = 'completed'")
    return done.agg(F.count("*").alias("completed"), *[F.nullif(F.round(F.avg(m), digits), F.lit(0.0)).alias(m) for m in metrics])


def retrieval_phase(hits: DataFrame) -> DataFrame:
    """hits with `phase`, the last stage that a hit reached, and `shown`, its first score that isn't 0. hits: selected, rerank_score, rrf_score, score."""
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0)) != 0
    phase = F.when(F.col("selected"), "final").when(known("rerank_score"), "rerank").when(known("rrf_score"), "fusion").otherwise("recall")
    return hits.withColumn("phase", phase).withColumn("shown", F.coalesce(F.nullif("rerank_score", F.lit(0.0)), F.nullif("rrf_score", F.lit(0.0)), "score"))


def display_rank(final: Column, rrf: Column, channel: Column) -> Column:
    """The rank to show: the latest that is known; 999 if none is."""
    return F.coalesce(final, rrf, channel, F.lit(999))


def structure_stats(nodes: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, nodes, depth: how many nodes a document has and how deep they go."""
    return nodes.groupBy(doc).agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


def decision_coverage(decisions: DataFrame) -> DataFrame:
    """flag, decisions, coverage (share with an answer), p50 of the latencies. decisions: flag, answered, latency."""
    counted = decisions.groupBy("flag").agg(F.count("*").alias("decisions"), F.avg(F.col("answered").cast("double")).alias("coverage"))
    return counted.join(percentiles(decisions, "flag", "latency", {"p50": 0.5}), "flag", "left")


def feedback(events: DataFrame, key: str) -> DataFrame:
    """key, up, down: ratings of both kinds. events: key, rating (1 up, -1 down)."""
    return events.groupBy(key).agg(F.count_if(F.col("rating") == 1).alias("up"), F.count_if(F.col("rating") == -1).alias("down"))


def by_category(results: DataFrame, category: str, metric: str, digits: int = 4) -> DataFrame:
    """category, n, mean of each category, and of all (category NULL)."""
    return results.rollup(category).agg(F.count("*").alias("n"), F.round(F.avg(metric), digits).alias("mean"))


def compare_runs(a: DataFrame, b: DataFrame, band: float = 0.005) -> DataFrame:
    """metric, a, b, delta and its direction beyond a band. a, b: metric, value, one row a metric; metrics of one run only have no delta."""
    d = F.col("b") - F.col("a")
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    return both.withColumn("delta", d).withColumn("trend", F.when(d > band, "up").when(d < -band, "down").otherwise("same"))


def stage_counts(questions: DataFrame, stages: Sequence[str], key: str = "run") -> DataFrame:
    """key and how many of its questions were lost at each stage. questions: key, stage."""
    return questions.groupBy(key).pivot("stage", list(stages)).count().na.fill(0)


def term_counts(df: DataFrame, term: str, size: int = 10_000) -> DataFrame:
    """term, n of the most frequent terms, ties by the term; `size` is the aggregation's own limit."""
    return df.where(F.col(term).isNotNull()).groupBy(term).agg(F.count("*").alias("n")).orderBy(F.desc("n"), term).limit(size)


def waterfall(spans: DataFrame) -> DataFrame:
    """spans (trace, span, parent, start) with depth and path, roots first: what a trace's detail shows. Spans whose parent is missing are roots.

    Ways up are doubled, so a trace of any depth takes as many joins as its depth has binary digits; spans on a cycle raise
    an error. Spans whose trace or number is null are left out.
    """
    own = F.concat_ws("/", F.date_format("start", "yyyyMMddHHmmssSSSSSS"), F.col("span").cast("string"))
    return spans.join(trees.paths(spans, own, "trace", "span", "parent"), ["trace", "span"])


def soft_delete(df: DataFrame, gone: Column) -> DataFrame:
    """Rows flagged 0 instead of dropped."""
    return df.withColumn("status", F.when(gone, 0).otherwise(F.coalesce("status", F.lit(1))))
