"""The routing funnel: scores of scopes, topics and documents for each question, confidence, and the plan's checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.operators.ranking import query_blocks, top, unit_rows

#: Cuts of the funnel and thresholds of its decisions (fixed values).
SCOPES, TOPICS, DOCUMENTS = 5, 8, 5
SUCCESS, CLARIFY, ESCAPE, CLOSE = 0.55, 0.40, 0.25, 3.0
MODES = ["RETRIEVAL", "REACT_AGENT", "CLARIFICATION", "GRAPH_ONLY", "GRAPH_THEN_EVIDENCE", "REFUSAL", "MULTI_AGENT"]


def semantic_part(similarity: Column) -> Column:
    return F.when(similarity > 0.20, (similarity - 0.20) * 50).otherwise(0.0)


def name_hits(text: Column, terms: Column) -> Column:
    """12, 8, 4 or 2 for each term in the text by its length (6, 4, 3 characters), longest first; substrings of a counted term don't count."""
    ordered = F.array_sort(F.array_distinct(terms), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    worth = lambda t: F.when(F.length(t) >= 6, 12.0).when(F.length(t) >= 4, 8.0).when(F.length(t) >= 3, 4.0).otherwise(2.0)
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<string>").alias("seen"))

    def add(acc: Column, t: Column) -> Column:
        hit = F.contains(text, t) & ~F.exists(acc["seen"], lambda x: F.contains(x, t))
        return F.struct(F.when(hit, acc["s"] + worth(t)).otherwise(acc["s"]).alias("s"), F.when(hit, F.concat(acc["seen"], F.array(t))).otherwise(acc["seen"]).alias("seen"))

    return F.aggregate(ordered, start, add, lambda acc: acc["s"])


def route_score(similarity: Column, lexical: Column, entity_hits: Column, names: Column, same_scope: Column | None = None, relation: Column | None = None) -> Column:
    """Score of a route; same_scope adds 15, a document's relation score 20 times itself. Rounded half up to 4 decimals."""
    total = semantic_part(similarity) + F.least(F.lit(10.0), F.coalesce(lexical, F.lit(0.0)) * 1.6) + entity_hits * 6 + names
    if same_scope is not None:
        total = total + F.when(same_scope, 15.0).otherwise(0.0)
    if relation is not None:
        total = total + F.coalesce(relation, F.lit(0.0)) * 20
    return F.round(total, 4)


def best_routes(routes: DataFrame, k: int, code: str = "code") -> DataFrame:
    """The k best routes of each question with their rank; routes without a score drop out."""
    return top(routes.where(F.col("score") > 0), k, F.desc("score"), F.col(code))


def near_routes(questions: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """query, code, score, rank: the k best routes of each question among all codes, by route_score with scopes and relations.

    questions: query, scope, query_vector; codes: code (a long), scope, vector, lexical, relation. Similarities are matrix products of
    Arrow batches, as in the vector channel; a task keeps its k best codes a question, and only those are scored as columns.
    """
    flat = F.round(F.least(F.lit(10.0), F.coalesce("lexical", F.lit(0.0)) * 1.6) + F.coalesce("relation", F.lit(0.0)) * 20, 9)
    # a vector with a null component scores 0, as one without components
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c))
    dealt = codes.where("code IS NOT NULL").select("code", whole("vector").alias("vector"), "scope", flat.cast("double").alias("flat"), F.col("lexical").cast("double"), F.col("relation").cast("double"))
    dealt = dealt.repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = []
    for block in query_blocks(questions):
        near = nearest_codes(block.select("query", whole("query_vector").alias("query_vector"), "scope"), dealt, k)
        score = route_score(F.col("similarity"), F.col("lexical"), F.lit(0), F.lit(0.0), F.col("same"), F.col("relation"))
        parts.append(best_routes(near.select("query", "code", score.alias("score")), k))
    return reduce(DataFrame.unionByName, parts)


def nearest_codes(questions: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """query, code, similarity, same, lexical, relation: of each task's codes the k with the best scores for each question of one block."""
    asked = questions.collect()
    names, scopes = [r["query"] for r in asked], np.array([np.nan if r["scope"] is None else r["scope"] for r in asked], float)
    dims = {d: (unit_rows([r["query_vector"] for r in asked], d), np.array([len(r["query_vector"] or []) == d for r in asked])) for d in {len(r["query_vector"] or []) for r in asked}}
    odd = np.array([not np.isfinite(r["query_vector"] or []).all() for r in asked], bool)
    fields = {f.name: f.dataType for f in (*questions.schema, *codes.schema)}
    kinds = [to_arrow_type(fields["query"]), to_arrow_type(fields["code"]), pa.float64(), pa.bool_(), pa.float64(), pa.float64()]
    columns = ["query", "code", "similarity", "same", "lexical", "relation"]

    def similarities(vectors: list) -> np.ndarray:
        out, sizes = np.zeros((len(vectors), len(names))), np.array([len(v) if v is not None else 0 for v in vectors])
        strange = np.array([v is not None and not np.isfinite(v).all() for v in vectors], bool)
        for dim, (q, own) in dims.items():
            if dim:
                out += unit_rows(vectors, dim) @ q.T
                out[((sizes == dim)[:, None] & own) & (strange[:, None] | odd)] = np.nan
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a question's best so far: rounded score, code, similarity, same, lexical, relation as rows of an array each
        best = [[np.empty(0), np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0), np.empty(0)] for _ in names]
        floor = np.full(len(names), 0.0)
        for batch in batches:
            for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
                codes_, vectors, scope, flat, lexical, relation = (c.to_pylist() if i == 1 else c.to_numpy(zero_copy_only=False) for i, c in enumerate(part.columns))
                with np.errstate(invalid="ignore", over="ignore"):
                    similar = similarities(vectors)
                    same = scope.astype(float)[:, None] == scopes
                    total = np.where(similar <= 0.20, 0.0, (similar - 0.20) * 50) + flat[:, None] + same * 15.0
                total = np.floor(np.nan_to_num(total, nan=1e9) * 1e4 + 0.5)
                fresh = total >= np.maximum(floor, 1)
                for i in np.flatnonzero(fresh.any(0)).tolist():
                    at = np.flatnonzero(fresh[:, i])
                    merged = [np.concatenate([a, b]) for a, b in zip(best[i], [total[at, i], codes_[at], similar[at, i], same[at, i], lexical[at], relation[at]], strict=True)]
                    keep = np.lexsort((merged[1], -merged[0]))[:k]
                    best[i] = [m[keep] for m in merged]
                    if len(keep) == k:
                        floor[i] = best[i][0][-1]
        for name, rows in zip(names, best, strict=True):
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0]), kinds[0]), *(pa.array(x, t) for x, t in zip(rows[1:], kinds[1:], strict=True))], names=columns)

    kind = f"query {fields['query'].simpleString()}, code {fields['code'].simpleString()}, similarity double, same boolean, lexical double, relation double"
    return codes.mapInArrow(run, kind)


def confidence(routes: DataFrame) -> DataFrame:
    """query, best, second, confidence and status: best / max(10, best + second + 5)."""
    pick = lambda n: F.coalesce(F.max(F.when(F.col("rank") == n, F.col("score"))), F.lit(0.0))
    out = routes.groupBy("query").agg(pick(1).alias("best"), pick(2).alias("second"))
    c = F.col("best") / F.greatest(F.lit(10.0), F.col("best") + F.col("second") + 5)
    return out.withColumn("confidence", F.round(c, 4)).withColumn("status", F.when(F.col("best") <= 0, "FAILED").when(c >= SUCCESS, "SUCCESS").otherwise("LOW_CONFIDENCE"))


def must_clarify(score: Column, has_name: Column, difference: Column, same_scope: Column) -> Column:
    """Ask back: low confidence (lower still where a name is given), or two close leaders of different scopes."""
    low = F.when(has_name, score < ESCAPE).otherwise(score < CLARIFY)
    return low | ((difference <= CLOSE) & ~same_scope)


def fallback_routes(questions: DataFrame, metadata: DataFrame, least: float = 1.0, k: int = DOCUMENTS) -> DataFrame:
    """Documents of the question's tenant by their metadata's words. questions: query, tenant, terms; metadata: code, tenant, text.

    Terms meet words by equality, so only documents with a term are scored.
    """
    from quarry.models import words

    w = metadata.select("code", "tenant", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    q = questions.select("query", "tenant", F.explode(F.array_distinct("terms")).alias("term"))
    worth = F.when(F.length("term") >= 6, 12.0).when(F.length("term") >= 4, 8.0).when(F.length("term") >= 3, 4.0).otherwise(2.0)
    scored = q.join(w, ["tenant", "term"]).groupBy("query", "code").agg(F.sum(worth).alias("score")).where(F.col("score") >= least)
    return best_routes(scored, k)


def topic_documents(profiles: DataFrame, topics: DataFrame) -> DataFrame:
    """(doc, topic) for topics that a document's profile names. profiles: doc, core_topics (JSON array); topics: topic."""
    named = profiles.select("doc", F.explode(F.from_json("core_topics", "array<string>")).alias("topic"))
    return named.join(topics.select("topic").distinct(), "topic", "left_semi").distinct()


def best_section(sections: DataFrame, topic: Column, facet: Column) -> DataFrame:
    """The section of each document with the largest score (> 0): topic equal 8, in the title 6, in the path 2; facet in the title 5, in the path 1. Ties: node_no."""
    holds = lambda c, t: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(t)) & (F.trim(t) != "")
    t = F.when(F.lower("title") == F.lower(topic), 8).when(holds("title", topic), 6).when(holds("section_path", topic), 2).otherwise(0)
    f = F.when(holds("title", facet), 5).when(holds("section_path", facet), 1).otherwise(0)
    return top(sections.withColumn("score", t + f).where("score > 0"), 1, F.desc("score"), F.col("node_no"), key=("doc",)).drop("rank")


def trace_rows(routes: DataFrame, selected: DataFrame, n: int = 5) -> DataFrame:
    """query, routes (JSON of the first n), hit: whether the selected document is among them (NULL if none was selected)."""
    few = routes.where(F.col("rank") <= n).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "score"))).alias("r"))
    joined = few.join(selected.select("query", "selected"), "query", "left")
    hit = F.when(F.col("selected").isNotNull(), F.array_contains(F.transform("r", lambda x: x["code"]), F.col("selected")))
    return joined.select("query", F.to_json("r").alias("routes"), hit.alias("hit"))


def resolve_intent(distribution: Column, rule: Column, least: float = 0.55, margin: float = 0.15) -> Column:
    """The judge's choice if it is clear (array of struct<label, p>), else the rule's. capability, chitchat and chat mean open; unknown labels knowledge."""
    ordered = F.array_sort(distribution, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
    first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    clear = (first["p"] >= least) & (first["p"] - F.coalesce(second["p"], F.lit(0.0)) >= margin)
    label = F.when(F.coalesce(clear, F.lit(False)), F.lower(first["label"])).otherwise(F.lower(rule))
    return F.when(label.isin("capability", "chitchat", "chat", "open"), "open").otherwise("knowledge")


def reconcile_rewrite(model: Column, rules: Column, most: int = 4) -> Column:
    """Sub-questions: the model's list unless it is empty or merges what the rules split; `most` of them, blanks and repeats out."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    m, r = clean(model), clean(rules)
    return F.slice(F.when((F.size(m) == 0) | ((F.size(m) == 1) & (F.size(r) > 1)), r).otherwise(m), 1, most)


# --- plans of several steps -------------------------------------------------------------------------------------------


#: Steps and dependencies of a plan up to which it is gone through in one task.
PLAN_ROWS = 100_000


def walked(steps: pa.Table, most_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole plans (plan, id, needs, edge): the first row of each step, its layer, its rows and whether it needs a step that isn't there."""
    code = lambda c: c.combine_chunks().dictionary_encode(null_encoding="encode")
    plan, ids = code(steps.column("plan")).indices.to_numpy(), pa.chunked_array([*steps.column("id").chunks, *steps.column("needs").chunks])
    own = code(ids).indices.to_numpy().astype(np.int64)
    key = lambda part: plan.astype(np.int64) * (own.max() + 1) + part
    edge, named = steps.column("edge").to_numpy(), steps.column("needs").is_valid().to_numpy()
    of_id, of_needs = key(own[: len(plan)]), key(own[len(plan) :])
    nodes, first, times = np.unique(of_id[~edge], return_index=True, return_counts=True)
    first = np.flatnonzero(~edge)[first]
    at = lambda k: np.minimum(np.searchsorted(nodes, k), max(len(nodes) - 1, 0))
    step, need = at(of_id[edge]), at(of_needs[edge])
    real = len(nodes) > 0
    there = (nodes[need] == of_needs[edge]) & named[edge] if real else np.zeros(edge.sum(), bool)
    mine = nodes[step] == of_id[edge] if real else there
    unknown = np.zeros(len(nodes), bool)
    unknown[step[mine & ~there]] = True
    pairs = np.unique(need[mine & there] * max(len(nodes), 1) + step[mine & there])
    need, step = pairs // max(len(nodes), 1), pairs % max(len(nodes), 1)
    # the steps behind each one, and how many each one waits for
    begin, waits, layer = np.searchsorted(need, np.arange(len(nodes) + 1)), np.bincount(step, minlength=len(nodes)), np.full(len(nodes), -1)
    ready, depth = np.flatnonzero(waits == 0), 0
    while len(ready):
        if depth > most_depth:
            raise ValueError(f"a plan deeper than {most_depth} layers")
        layer[ready] = depth
        n = begin[ready + 1] - begin[ready]
        behind = step[np.repeat(begin[ready] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        np.subtract.at(waits, behind, 1)
        behind = np.unique(behind)
        ready, depth = behind[waits[behind] == 0], depth + 1
    return first, layer, times, unknown


def whole_plans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Whole plans at a time from rows sorted by plan; of a plan of more than PLAN_ROWS rows a first part, marked, the rest left out."""
    held, large = None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if large is not None:
            table = table.filter(pc.invert(pc.equal(table.column("plan"), large).fill_null(False))) if large.is_valid else table.filter(table.column("plan").is_valid())
        if not table.num_rows:
            continue
        large = None
        table = table if held is None else pa.concat_tables([held, table])
        last = table.column("plan")[-1]
        same = pc.equal(table.column("plan"), last).fill_null(False) if last.is_valid else table.column("plan").is_null()
        n = table.num_rows - pc.sum(same).as_py()
        if n:
            yield table.slice(0, n), False
        held = table.slice(n)
        if held.num_rows > PLAN_ROWS:
            yield held, True
            held, large = None, last
    if held is not None:
        yield held, False


def surveyed(nodes: DataFrame, edges: DataFrame, most_depth: int = 1000) -> DataFrame:
    """plan, id, layer, times, unknown: each step with its layer, its rows and whether it needs a step that isn't there.

    Rows are dealt out and sorted by plan, so a task goes through its plans in order, some at a time; all layers of these are found
    at once. Plans of more than PLAN_ROWS rows are left to joins, one a layer. Written to the shared folder.
    """
    from quarry.sources.files import kept

    kind = {"id": nodes.schema["id"].dataType, "plan": nodes.schema["plan"].dataType}
    rows = nodes.select("plan", "id", F.lit(None).cast(kind["id"]).alias("needs"), F.lit(False).alias("edge")).unionByName(edges.select("plan", "id", F.col("needs").cast(kind["id"]).alias("needs"), F.lit(True).alias("edge")))
    schema = [to_arrow_type(kind["plan"]), to_arrow_type(kind["id"]), pa.int32(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for plans, large in whole_plans(batches):
            if large:
                columns = [plans.column("plan")[:1].combine_chunks(), pa.array([None], schema[1]), pa.array([-2]), pa.array([0]), pa.array([False])]
            else:
                first, *found = walked(plans, most_depth)
                columns = [plans.column(c).combine_chunks().take(pa.array(first)) for c in ("plan", "id")] + [pa.array(x) for x in found]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema, strict=True)], names=["plan", "id", "layer", "times", "unknown"])

    ddl = f"plan {kind['plan'].simpleString()}, id {kind['id'].simpleString()}, layer int, times long, unknown boolean"
    found = kept(rows.repartition("plan").sortWithinPartitions("plan").mapInArrow(run, ddl), "plans")
    large = found.where("layer = -2").select("plan")
    if large.isEmpty():
        return found
    nodes, edges = (d.join(F.broadcast(large), d["plan"].eqNullSafe(large["plan"]), "left_semi") for d in (nodes, edges))
    unknown = edges.join(nodes.select("plan", F.col("id").alias("needs")), ["plan", "needs"], "left_anti").select("plan", "id").distinct().withColumn("_unknown", F.lit(True))
    by_joins = layers_by_joins(nodes, edges, most_depth).join(nodes.groupBy("plan", "id").agg(F.count("*").alias("times")), ["plan", "id"]).join(unknown, ["plan", "id"], "left")
    return found.where("layer <> -2").unionByName(by_joins.select("plan", "id", "layer", "times", F.coalesce("_unknown", F.lit(False)).alias("unknown")))


def layers(nodes: DataFrame, edges: DataFrame, most_depth: int = 1000) -> DataFrame:
    """plan, id, layer: the longest chain of dependencies before a step; -1 for steps on or behind a cycle.

    nodes: plan, id; edges: plan, id, needs. Plans deeper than most_depth raise an error.
    """
    return surveyed(nodes, edges, most_depth).select("plan", "id", "layer")


def layers_by_joins(nodes: DataFrame, edges: DataFrame, most_depth: int = 1000) -> DataFrame:
    """As layers, for plans of any size: one join a layer until no further step is ready."""
    from quarry.sources.files import kept

    edges = edges.join(nodes.select("plan", F.col("id").alias("needs")), ["plan", "needs"], "left_semi").select("plan", "id", "needs").distinct()
    waiting, open_edges, done = nodes.select("plan", "id").distinct(), edges, []
    for depth in range(most_depth + 1):
        ready = kept(waiting.join(open_edges.select("plan", "id"), ["plan", "id"], "left_anti").withColumn("layer", F.lit(depth)), "plans")
        if ready.isEmpty():
            break
        done.append(ready)
        waiting = kept(waiting.join(ready.select("plan", "id"), ["plan", "id"], "left_anti"), "plans")
        open_edges = kept(open_edges.join(ready.select("plan", F.col("id").alias("needs")), ["plan", "needs"], "left_anti"), "plans")
    else:
        raise ValueError(f"a plan deeper than {most_depth} layers")
    out = waiting.withColumn("layer", F.lit(-1))
    for ready in done:
        out = out.unionByName(ready)
    return out


def plan_issues(steps: DataFrame) -> DataFrame:
    """plan, id, issue: repeated ids, blank questions, unknown dependencies and cycles. steps: plan, id, mode, question, depends_on."""
    blank = steps.where(F.coalesce(F.trim("question"), F.lit("")) == "").select("plan", "id", F.lit("empty_question").alias("issue")).distinct()
    found = surveyed(steps, steps.select("plan", "id", F.explode("depends_on").alias("needs")))
    kinds = {"duplicate_id": F.col("times") > 1, "unknown_dependency": F.col("unknown"), "cycle": F.col("layer") == -1}
    issues = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    return found.select("plan", "id", F.explode(issues).alias("issue")).unionByName(blank)


def inherit_scope(steps: DataFrame, plans: DataFrame) -> DataFrame:
    """Steps with their plan's tenant, scope and documents where they name none; unknown modes drop out."""
    p = plans.select("plan", *[F.col(c).alias(f"_{c}") for c in ("tenant", "scope", "doc_ids")])
    own = lambda c: F.coalesce(F.when(F.size(c) > 0, F.col(c)) if c == "doc_ids" else F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}")).alias(c)
    kept = [c for c in steps.columns if c not in ("tenant", "scope", "doc_ids")]
    return steps.where(F.col("mode").isin(MODES)).join(p, "plan", "left").select(*kept, own("tenant"), own("scope"), own("doc_ids"))
