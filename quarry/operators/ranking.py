"""Ranking: channels, gates, rank fusion, reranking, parent elevation and the final cut.

Hits are rows (query, chunk, score, ...). All queries run in one plan, and every order ends in the chunk's id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.vectors import cosine
from quarry.sources import files

#: Defaults (fixed values): rank constant, channel and final cuts, gate ratios.
RRF_K, VECTOR_TOP, KEYWORD_TOP, CANDIDATES, FINAL_K = 30, 50, 100, 50, 16
VECTOR_RATIO, VECTOR_FLOOR, SOFT_FLOOR, KEYWORD_RATIO = 0.35, 0.55, 0.85, 0.35
#: Queries that one broadcast holds at most; more queries go in further blocks.
QUERY_BLOCK = 1024


def rank_by(*order: Column, key: Sequence[str] = ("query",), name: str = "rank") -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias(name)


def top(df: DataFrame, k: int, *order: Column, key: Sequence[str] = ("query",), name: str = "rank") -> DataFrame:
    """The first k rows of each query with their rank; the limit is applied before the shuffle too."""
    return df.withColumn(name, rank_by(*order, key=key)).where(F.col(name) <= k)


def query_blocks(queries: DataFrame, key: str = "query", block: int = QUERY_BLOCK) -> list[DataFrame]:
    """The queries in parts that are each small enough to broadcast."""
    n = max(1, -(-queries.count() // block))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def vector_channel(queries: DataFrame, corpus: DataFrame, k: int = VECTOR_TOP, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query, chunk, score, rank) by cosine. queries: query, query_vector; corpus: chunk (a long), vector. k <= 0 means 10.

    Both sides are normalised once, scored by matrix products of Arrow batches, and each task keeps only its k best a query;
    scores that agree to 12 decimals are ties, in the order of chunks. `where` filters paired rows (tenant, scope, section
    and other predicates); then pairs are scored one by one.
    """
    k = k if k > 0 else 10
    parts = []
    for part in query_blocks(queries):
        if where is None:
            pairs = nearest(part, corpus, k)
        else:
            pairs = where(corpus.crossJoin(F.broadcast(part))).select("query", "chunk", cosine(F.col("query_vector"), F.col("vector")).alias("score"))
        parts.append(top(pairs, k, F.round("score", 12).desc(), F.col("chunk")))
    return reduce(DataFrame.unionByName, parts)


def unit_rows(vectors: list, dim: int) -> np.ndarray:
    """Unit vectors as rows; vectors of another length, empty or zero ones are zero."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """query, chunk, score: of each task's chunks the k nearest to each query of one block (1024 at most, so they fit a closure).

    within: a column of both; chunks are then near to queries of the same value only, null to none.
    """
    asked = queries.select("query", "query_vector", *([within] if within else [])).collect()
    groups = {g: i for i, g in enumerate({r[within] for r in asked} - {None})} if within else {}
    own = np.array([groups.get(r[within], -2) for r in asked]) if within else None
    names = [r["query"] for r in asked]
    by_dim: dict[int, np.ndarray] = {}
    for dim in {len(r["query_vector"] or []) for r in asked}:
        by_dim[dim] = unit_rows([r["query_vector"] for r in asked], dim)
    fields = {f.name: f.dataType for f in (*queries.schema, *corpus.schema)}
    kind = f"query {fields['query'].simpleString()}, chunk {fields['chunk'].simpleString()}, score double"
    of_query, of_chunk = to_arrow_type(fields["query"]), to_arrow_type(fields["chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int64))] * len(names)
        for batch in batches:
            for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
                chunks, vectors = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
                scores = np.zeros((len(vectors), len(names)))
                for dim, q in by_dim.items():
                    if dim:
                        scores += unit_rows(vectors, dim) @ q.T
                if own is not None:
                    scores[np.array([groups.get(g, -1) for g in part.column(2).to_pylist()])[:, None] != own] = -3
                for i in range(len(names)):
                    s, c = best[i]
                    fresh = scores[:, i] >= (s[-1] - 1e-9 if len(s) == k else -2)
                    s, c = np.concatenate([s, scores[fresh, i]]), np.concatenate([c, chunks[fresh]])
                    keep = np.lexsort((c, -np.round(s, 12)))[:k]
                    best[i] = s[keep], c[keep]
        for i, (s, c) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(s), of_query), pa.array(c, of_chunk), pa.array(s)], names=["query", "chunk", "score"])

    return corpus.where("chunk is not null").select("chunk", "vector", *([within] if within else [])).mapInArrow(run, kind)


# --- predicates -------------------------------------------------------------------------------------------------------


def scope_predicate(
    tenant: Column | None = None, want_tenant: str | None = None, doc: Column | None = None, doc_ids: Sequence[str] | None = None, path: Column | None = None, prefix: str | None = None,
    name: Column | None = None, names: Sequence[str] = (), category: Column | None = None, categories: Sequence[str] = (), tags: Column | None = None, want_tags: Sequence[str] = (),
) -> Column:
    """The filters that both channels share. A blank tenant means "default"; document ids that are all unreadable match nothing."""
    conditions = [F.lit(True)]
    if tenant is not None:
        conditions.append(F.coalesce(F.nullif(F.trim(tenant), F.lit("")), F.lit("default")) == ((want_tenant or "").strip() or "default"))
    if doc is not None and doc_ids is not None:
        conditions.append(doc.isin([int(x) for x in doc_ids if str(x).strip().isdigit()]))
    if path is not None and prefix:
        conditions.append(F.startswith(path, F.lit(prefix)))
    if name is not None and names:
        conditions.append(reduce(Column.__or__, [F.contains(F.lower(name), F.lit(n.lower())) for n in names]))
    if category is not None and categories:
        conditions.append(category.isin(list(categories)))
    if tags is not None and want_tags:
        conditions.append(F.arrays_overlap(F.transform(F.split(tags, ","), lambda x: F.trim(x)), F.array(*map(F.lit, want_tags))))
    return F.coalesce(reduce(Column.__and__, conditions), F.lit(False))


def validated_prefixes(hints: DataFrame, paths: DataFrame) -> DataFrame:
    """hints (query, prefix) that some row of paths (path) starts with, in any case; the others would filter everything away.

    Paths meet hints by their first characters, at the hints' lengths (all lengths up to the longest hint's, where these are
    more than 200), so this is an equality join.
    """
    sized = hints.where(F.col("prefix").isNotNull()).withColumn("n", F.length("prefix"))
    lengths = [r.n for r in sized.select("n").distinct().limit(201).collect()]
    at = F.array(*map(F.lit, lengths or [0]))
    if len(lengths) > 200:
        at = F.sequence(F.lit(0), F.least(F.length("path"), F.lit(sized.agg(F.max("n")).first()[0])))
    heads = paths.where(F.col("path").isNotNull()).select(F.explode(F.transform(at, lambda n: F.lower(F.substring("path", F.lit(1), n)))).alias("head")).distinct()
    return sized.join(heads, F.lower("prefix") == F.col("head"), "left_semi").drop("n")


# --- gates, cuts and fusion -------------------------------------------------------------------------------------------

def by_query():
    return Window.partitionBy("query")


def vector_gate(hits: DataFrame, ratio: float = VECTOR_RATIO) -> DataFrame:
    """Hits from `ratio` of the query's best on (from 0.55 on if ratio is 0); if none is left, the best one from 85 % of that on."""
    best = F.max("score").over(by_query())
    floor = best * ratio if ratio > 0 else F.lit(VECTOR_FLOOR)
    marked = hits.withColumn("_floor", floor).withColumn("_n", F.count_if(F.col("score") >= F.col("_floor")).over(by_query()))
    keep = (F.col("score") >= F.col("_floor")) | ((F.col("_n") == 0) & (F.col("rank") == 1) & (F.col("score") >= F.col("_floor") * SOFT_FLOOR))
    return marked.where(keep).drop("_floor", "_n")


def keyword_gate(hits: DataFrame, ratio: float = KEYWORD_RATIO) -> DataFrame:
    """Hits from `ratio` of the query's best on; all where the best is null or not positive."""
    best = F.max("score").over(by_query())
    return hits.withColumn("_b", best).where((F.coalesce(F.col("_b"), F.lit(0.0)) <= 0) | (F.col("score") >= F.col("_b") * max(0.0, ratio))).drop("_b")


def adaptive_k(hits: DataFrame, least: int = 3, most: int = 20, ratio: float = 0.4) -> DataFrame:
    """Hits ranked up to `least`, and further ones while they reach `ratio` of the best, up to `most`; unchanged if most <= 0."""
    if most <= 0:
        return hits
    best = F.max("score").over(by_query())
    near = (F.col("_b") > 0) & (F.col("score") >= F.col("_b") * ratio)
    return hits.withColumn("_b", best).where((F.col("rank") <= least) | (near & (F.col("rank") <= most))).drop("_b")


def adaptive_weights(query: Column, boost: float = 1.6) -> tuple[Column, Column]:
    """Weights of the vector and keyword channels: id-like questions lean on keywords, others on vectors."""
    by_id = F.regexp(query, F.lit(r"第\s*[0-9一二三四五六七八九十]+\s*条|\d+\.\d+|《[^》]+》|[A-Za-z]+-?\d+"))
    return F.when(by_id, 1.0).otherwise(boost), F.when(by_id, boost).otherwise(1.0)


def fuse(vector: DataFrame, keyword: DataFrame, k: int = RRF_K, weights: tuple[Column | float, Column | float] = (1.0, 1.0), most: int = CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion: query, chunk, rrf_score (6 decimals), channel, vector_rank, keyword_rank, rank.

    Repeats of a chunk within a channel add up. Ties: the better vector rank, then the better keyword rank, then the id.
    """
    w = [F.lit(x) if isinstance(x, float | int) else x for x in weights]
    part = lambda d, c, weight: d.select("query", "chunk", (weight / (k + F.col("rank"))).alias("s"), F.lit(c).alias("c"), "rank")
    both = part(vector, "vector", w[0]).unionByName(part(keyword, "keyword", w[1]))
    rank_in = lambda c: F.min(F.when(F.col("c") == c, F.col("rank")))
    fused = both.groupBy("query", "chunk").agg(F.sum("s").alias("_s"), rank_in("vector").alias("vector_rank"), rank_in("keyword").alias("keyword_rank"))
    channel = F.when(F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull(), "hybrid").when(F.col("vector_rank").isNotNull(), "vector").otherwise("keyword")
    # equal sums may differ in their last bits by the order of addition
    ranked = top(fused, most, F.round("_s", 12).desc(), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.col("chunk"))
    return ranked.select("query", "chunk", F.round("_s", 6).alias("rrf_score"), channel.alias("channel"), "vector_rank", "keyword_rank", "rank")


# --- reranking --------------------------------------------------------------------------------------------------------


def rerank(hits: DataFrame, score: Column, head: int = 0, keep: int = 0, skip_from: float = 0.0, first: str = "rrf_score") -> DataFrame:
    """Order by a scorer's column, kept as rerank_score. Queries with one hit, or a best first score from skip_from on, stay as they are.

    head > 0: only that many are scored and the rest follows in its order with rerank_score 0. keep > 0: cut to that many.
    """
    n, best = F.count("*").over(by_query()), F.max(first).over(by_query())
    marked = hits.withColumn("_skip", (n <= 1) | (F.lit(skip_from > 0) & (best >= skip_from)))
    scored = ~F.col("_skip") & (F.lit(head <= 0) | (F.col("rank") <= head))
    out = marked.withColumn("rerank_score", F.when(scored, score).otherwise(0.0)).withColumn("_scored", scored)
    order = [F.desc("_scored"), F.when(F.col("_scored"), -F.col("rerank_score")), F.col("_old"), F.col("chunk")]
    out = out.withColumnRenamed("rank", "_old").withColumn("rank", rank_by(*order)).drop("_skip", "_scored").withColumnRenamed("_old", "first_rank")
    return out.where(F.col("rank") <= keep) if keep > 0 else out


def guard_leader(hits: DataFrame, margin: float = 0.15) -> DataFrame:
    """The first stage's leader returns to the top if its rerank score is within the margin of the best."""
    leader = F.max(F.when(F.col("first_rank") == 1, F.col("rerank_score"))).over(by_query())
    back = (F.col("first_rank") == 1) & (F.max("rerank_score").over(by_query()) - leader <= margin)
    marked = hits.withColumn("_back", back).withColumnRenamed("rank", "_r")
    return marked.withColumn("rank", rank_by(F.desc("_back"), F.col("_r"))).drop("_back", "_r")


def rerank_filter(hits: DataFrame, ratio: float = 0.0, least: float = 0.02, final_k: int = FINAL_K) -> DataFrame:
    """Hits from max(least, ratio * best) on, a score of 0 counting as 1; all hits if fewer than min(final_k, n) would be left."""
    s = F.coalesce(F.nullif("rerank_score", F.lit(0.0)), F.lit(1.0))
    marked = hits.withColumn("_s", s).withColumn("_t", F.greatest(F.lit(least), F.max("rerank_score").over(by_query()) * ratio))
    kept, n = F.count_if(F.col("_s") >= F.col("_t")).over(by_query()), F.count("*").over(by_query())
    return marked.withColumn("_k", kept).withColumn("_n", n).where((F.col("_s") >= F.col("_t")) | (F.col("_k") < F.least(F.lit(final_k), F.col("_n")))).drop("_s", "_t", "_k", "_n")


def elevate_parents(hits: DataFrame, parents: DataFrame, most: int = 4000, fallback: DataFrame | None = None) -> DataFrame:
    """Of each query's hits with one parent the best child stays, with the parent's text in front.

    hits: query, chunk, parent, score, rerank_score, content, rank; parents: parent, path, parent_text. Hits without a
    parent, or with one that neither table has, pass through. Order: score, then hits that passed through, then first children.
    """
    known = parents.select("parent", "path", "parent_text")
    if fallback is not None:
        known = known.unionByName(fallback.select("parent", "path", "parent_text").join(known.select("parent"), "parent", "left_anti"))
    joined = hits.join(known, "parent", "left").withColumn("_s", F.when(F.col("rerank_score") > 0, F.col("rerank_score")).otherwise(F.col("score")))
    own = F.col("parent_text").isNull()
    group = F.when(own, F.concat(F.lit("c"), F.col("chunk").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("parent").cast("string")))
    grouped = joined.withColumn("_own", own).withColumn("_g", group)
    in_group = Window.partitionBy("query", "_g")
    best = grouped.withColumn("_first", F.min("rank").over(in_group)).withColumn("_r", F.row_number().over(in_group.orderBy(F.desc("_s"), "rank"))).where("_r = 1")
    headed = F.concat(F.when(F.coalesce(F.trim("path"), F.lit("")) != "", F.concat(F.lit("【章节路径："), "path", F.lit("】\n"))).otherwise(""), "parent_text")
    cut = F.when(F.length(headed) > most, F.concat(F.substring(headed, 1, most), F.lit("..."))).otherwise(headed)
    out = best.withColumn("child_text", F.col("content")).withColumn("content", F.when(F.col("_own"), F.col("content")).otherwise(cut)).drop("rank")
    return out.withColumn("rank", rank_by(F.desc("_s"), F.desc("_own"), F.col("_first"))).drop("_s", "_own", "_g", "_first", "_r", "path", "parent_text")


def rerank_parents(hits: DataFrame, score: Column, head: int = 8, blend: float = 1.0) -> DataFrame:
    """The first `head` hits ordered again by blend * parent + (1 - blend) * child score; the rest keeps its order behind them."""
    mixed = F.lit(blend) * score + F.lit(1 - blend) * F.col("rerank_score")
    marked = hits.withColumn("_in", F.col("rank") <= head).withColumn("_s", F.when(F.col("_in"), mixed)).withColumnRenamed("rank", "_old")
    return marked.withColumn("rank", rank_by(F.desc("_in"), F.desc("_s"), F.col("_old"))).withColumn("rerank_score", F.coalesce("_s", "rerank_score")).drop("_in", "_s", "_old")


def select_final(hits: DataFrame, k: int = FINAL_K) -> DataFrame:
    """All hits with is_selected, final_rank and reason."""
    on = F.col("rank") <= k
    return hits.withColumn("is_selected", on).withColumn("final_rank", F.when(on, F.col("rank"))).withColumn("reason", F.when(on, "selected").otherwise("beyond_top_k"))


def empty_reason(recalled: Column, gated: Column, reranked: Column, failed: Column) -> Column:
    """Why a query has no hits; NULL if it has some."""
    return F.when(failed, "channel_failed").when(recalled == 0, "no_recall").when(gated == 0, "gate_rejected").when(reranked == 0, "rerank_rejected")


def long_context_order(hits: DataFrame) -> DataFrame:
    """Odd ranks first in their order, then even ranks backwards, so the best stand at both ends; unchanged below three."""
    n = F.count("*").over(by_query())
    key = F.when((n < 3) | (F.col("rank") % 2 == 1), F.col("rank")).otherwise(2 * n - F.col("rank"))
    return hits.withColumn("_k", key).withColumn("position", rank_by(F.col("_k"))).drop("_k")


# --- merging rounds ---------------------------------------------------------------------------------------------------


def keep_best(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two rounds, each chunk once with its larger scores, ranked by (rerank_score, score)."""
    both = a.select("query", "chunk", "score", "rerank_score").unionByName(b.select("query", "chunk", "score", "rerank_score"))
    best = both.groupBy("query", "chunk").agg(F.max("score").alias("score"), F.max("rerank_score").alias("rerank_score"))
    return best.withColumn("rank", rank_by(F.desc("rerank_score"), F.desc("score"), F.col("chunk")))


def append_fresh(old: DataFrame, new: DataFrame, key: Sequence[str] = ("query", "chunk")) -> DataFrame:
    """old, followed by the rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def primary_first(primary: DataFrame, secondary: DataFrame, k: int) -> DataFrame:
    """Up to k chunks a query: the primary's in their order, then those that only the secondary has."""
    both = primary.select("query", "chunk", "score", "rank").withColumn("_p", F.lit(0)).unionByName(secondary.select("query", "chunk", "score", "rank").withColumn("_p", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("query", "chunk").orderBy("_p", "rank"))
    return top(both.withColumn("_f", first).where("_f = 1").withColumnRenamed("rank", "_r"), k, F.col("_p"), F.col("_r"), F.col("chunk")).drop("_p", "_f", "_r")


def corrected(hits: DataFrame, sufficient: Column, again: Callable[[DataFrame], DataFrame] | None, rounds: int = 1) -> DataFrame:
    """Queries whose hits don't suffice are asked again by `again` (queries -> hits) and the rounds merged; unknown counts as sufficient."""
    for _ in range(rounds if again else 0):
        poor = hits.groupBy("query").agg(F.bool_or(F.coalesce(sufficient, F.lit(True))).alias("ok")).where(~F.col("ok")).select("query")
        hits = keep_best(hits, again(poor))
    return hits


def multi_hop(queries: DataFrame, search: Callable[[DataFrame], DataFrame], follow: Callable[[DataFrame, DataFrame], DataFrame], hops: int = 2) -> DataFrame:
    """Search, let `follow` (queries, hits) give each query's next text, and append what is new; blank or unchanged texts stop.

    queries: query, text. The number of hops bounds the driver's loop; each hop is one plan over all queries.
    """
    hits = search(queries)
    for _ in range(hops - 1):
        after = follow(queries, hits).join(queries.select("query", F.col("text").alias("_was")), "query")
        queries = after.where((F.trim("text") != "") & (F.trim("text") != F.trim("_was"))).select("query", "text")
        hits = append_fresh(hits, search(queries))
    return hits


# --- references and prompt --------------------------------------------------------------------------------------------


def reference_ids(evidence: DataFrame, key: str = "key") -> DataFrame:
    """Dense reference numbers of a query's evidence by first appearance (sub_question, rank); repeats share one."""
    firsts = evidence.groupBy("query", key).agg(F.min(F.struct("sub_question", "rank")).alias("_f"))
    numbered = firsts.withColumn("reference_id", F.row_number().over(Window.partitionBy("query").orderBy("_f", key))).drop("_f")
    return evidence.join(numbered, ["query", key])


def point_to_repeats(evidence: DataFrame) -> DataFrame:
    """Content that an earlier sub-question of the query showed becomes a pointer [reference_id]."""
    n = F.row_number().over(Window.partitionBy("query", "reference_id").orderBy("sub_question", "rank"))
    return evidence.withColumn("_n", n).withColumn("content", F.when(F.col("_n") > 1, F.concat(F.lit("["), F.col("reference_id").cast("string"), F.lit("]"))).otherwise(F.col("content"))).drop("_n")


def within_budget(items: Column, total: int = 20_000, least: int = 250) -> Column:
    """Fold over an array of strings: whole ones while they fit, one cut where at least `least` characters are left, the rest out.

    A string that doesn't fit consumes nothing, so this is no running sum.
    """
    start = F.struct(F.lit(total).alias("left"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        room = acc["left"]
        taken = F.when(F.length(x) <= room, x).when(room >= least, F.concat(F.substr(x, F.lit(1), room - 1), F.lit("…")))
        return F.struct((room - F.coalesce(F.length(taken), F.lit(0))).cast("int").alias("left"), F.when(taken.isNotNull(), F.concat(acc["kept"], F.array(taken))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(items, start, add, lambda acc: acc["kept"])


def assemble_prompt(evidence: DataFrame, each: int = 8000, total: int = 20_000) -> DataFrame:
    """query, prompt: evidence lines with their references, within a budget for each sub-question and one for all.

    Evidence is at most the final cut of a query, so a query's rows are few.
    """
    line = F.concat(F.lit("["), F.col("reference_id").cast("string"), F.lit("] "), F.coalesce("content", F.lit("")))
    ordered = lambda key, x: F.transform(F.array_sort(F.collect_list(F.struct(*key, x.alias("_x")))), lambda s: s["_x"])
    parts = evidence.groupBy("query", "sub_question").agg(within_budget(ordered(["rank"], line), each).alias("lines"))
    whole = parts.groupBy("query").agg(F.flatten(ordered(["sub_question"], F.col("lines"))).alias("lines"))
    return whole.select("query", F.array_join(within_budget(F.col("lines"), total), "\n").alias("prompt"))


# --- facts ------------------------------------------------------------------------------------------------------------


def recall_facts(queries: DataFrame, facts: DataFrame, k: int = 5, most_distance: float = 0.70) -> DataFrame:
    """A user's nearest facts, the latest of each category, k at most. queries: query, user, query_vector; facts: fact (unique, a long), user, category, edited, vector.

    Scored as the vector channel scores, so no pair is a row; distances that agree to 12 decimals are ties, in the order of facts.
    """
    least = max(10 * k, 50)
    dealt = facts.select(F.col("fact").alias("chunk"), "user", "vector").repartition(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = reduce(DataFrame.unionByName, [nearest(block, dealt, least, "user") for block in query_blocks(queries)])
    scored = pairs.select("query", F.col("chunk").alias("fact"), F.round(1 - F.col("score"), 12).alias("distance")).where(F.col("distance") <= most_distance)
    near = top(scored, least, F.col("distance"), F.col("fact"), name="_n").join(facts.select("fact", "category", "edited"), "fact")
    latest = top(near, 1, F.desc_nulls_last("edited"), F.col("distance"), F.col("fact"), key=("query", "category"), name="_l")
    return top(latest, k, F.col("distance"), F.col("fact")).select("query", "fact", "category", "distance", "rank")


def evict_beyond(facts: DataFrame, n: int, oldest: bool = False) -> DataFrame:
    """The n facts that each user keeps: by default the oldest n, as an ascending offset gives; with `oldest`, the newest n."""
    order = [F.desc("edited"), F.desc("fact")] if oldest else [F.col("edited"), F.col("fact")]
    return top(facts, n, *order, key=("user",), name="_n").drop("_n")


def insert_facts(facts: DataFrame, most_similar: float = 0.92, most: int = 20_000) -> DataFrame:
    """Facts taken one by one in their order, without those that are as similar to an earlier kept one of their user.

    facts: user, fact, vector (and more columns, which stay). Vectors of another size than the user's first one, null and zero
    ones are similar to nothing. Facts under one id come in the order of their vectors' hashes. A null user is a user.

    A user's facts are read as a stream, and only the kept ones are held, in one growing matrix. Where a user has more than
    `most` facts, the first `most` of those left over (and any of the last one's id and vector) are settled so; what they keep is then held against the user's other facts,
    dealt out by a salt in groups of about 4 times `most`, and the rest goes into another round. So no task holds more vectors
    than that, however many facts a user has; rounds are written to the shared folder. The result is the same for any `most`.
    """
    names = facts.columns
    order = [F.col("fact"), F.xxhash64("vector")]
    place = F.struct(F.col("fact").alias("f"), F.xxhash64("vector").alias("h"))
    size = F.size(F.coalesce("vector", F.array().cast(facts.schema["vector"].dataType)))
    users = facts.groupBy("user").agg(F.count("*").alias("_n"), F.min_by(size, place).alias("_dim"))
    large = users.where(F.col("_n") > most)
    if large.isEmpty():
        return _first_of_kind(facts, order, most_similar)

    def written(df: DataFrame, name: str) -> DataFrame:
        path = files.shared_folder(facts.sparkSession, name)
        df.write.parquet(path)
        return facts.sparkSession.read.schema(df.schema).parquet(path)

    def among(df: DataFrame, few: DataFrame, how: str) -> DataFrame:
        keys = few.select(F.col("user").alias("_u"))
        return df.join(keys, F.col("user").eqNullSafe(F.col("_u")), how)

    n_of = large.select(F.col("user").alias("_u"), F.ceil(F.col("_n") / (4 * most)).alias("_salts"), F.col("_dim"))
    small = among(facts, large, "left_anti")
    open_ = facts.join(n_of, F.col("user").eqNullSafe(F.col("_u"))).drop("_u")
    other = F.col("vector").isNull() | (F.size("vector") != F.col("_dim"))
    kept = [_first_of_kind(small, order, most_similar), written(open_.where(other).select(*names), "facts-kept")]
    open_ = written(open_.where(~other), "facts")
    while not open_.isEmpty():
        ends = top(open_, most, *order, key=("user",), name="_at").groupBy(F.col("user").alias("_u")).agg(F.max(place).alias("_end"))
        parted = open_.join(ends, F.col("user").eqNullSafe(F.col("_u"))).withColumn("_head", place <= F.col("_end")).drop("_u", "_end")
        took = written(_first_of_kind(parted.where("_head").drop("_head"), order, most_similar), "facts-kept")
        kept.append(took.select(*names))
        rest = parted.where("not _head").drop("_head")
        seen = took.withColumn("_salt", F.explode(F.sequence(F.lit(0), (F.col("_salts") - 1).cast("int")))).select("user", "_salt", "vector")
        dealt = rest.withColumn("_salt", F.pmod(F.xxhash64("fact", "vector"), "_salts").cast("int"))
        open_ = written(dealt.groupBy("user", "_salt").cogroup(seen.groupBy("user", "_salt")).applyInArrow(_unlike(most_similar), dealt.schema).drop("_salt"), "facts")
    return reduce(DataFrame.unionByName, kept)


def _first_of_kind(facts: DataFrame, order: Sequence[Column], most_similar: float) -> DataFrame:
    """Each user's facts in order without those that are like an earlier kept one, which one task holds."""
    names = facts.columns
    u, v = names.index("user"), names.index("vector")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held, n, started = None, np.empty((0, 0)), 0, False
        for batch in batches:
            users, vectors, on = batch.column(u).to_pylist(), batch.column(v).to_pylist(), []
            for name, vector in zip(users, vectors, strict=True):
                if name != user or not started:
                    user, held, n, started = name, np.empty((64, len(vector or []))), 0, True
                x = unit_rows([vector], held.shape[1])[0]
                on.append(not n or float((held[:n] @ x).max()) <= most_similar)
                if on[-1]:
                    if n == len(held):
                        held = np.concatenate([held, np.empty_like(held)])
                    held[n] = x
                    n += 1
            yield batch.filter(pa.array(on, pa.bool_()))

    return facts.repartition("user").sortWithinPartitions("user", *order).mapInArrow(keep, facts.schema)


def _unlike(most_similar: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a group of facts and of kept ones: the facts that are like none of the kept, 1024 at a time."""

    def run(rows: pa.Table, seen: pa.Table) -> pa.Table:
        vectors = rows.column("vector").to_pylist()
        dim = len(vectors[0]) if vectors else 0
        held = unit_rows(seen.column("vector").to_pylist(), dim)
        on = [(unit_rows(vectors[k : k + 1024], dim) @ held.T).max(axis=1, initial=-1.0) <= most_similar for k in range(0, len(vectors), 1024)]
        return rows.filter(pa.array(np.concatenate(on), pa.bool_())) if on else rows

    return run
