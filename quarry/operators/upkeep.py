"""Upkeep of stored tables: upserts, deletions, reconciliation, retention and incremental sync. All are DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def replace_documents(stored: DataFrame, new: DataFrame, doc: str = "document_id", chunk: str = "chunk_no", version: str = "version") -> DataFrame:
    """stored without the documents that new brings, plus new's latest row of each (document, chunk)."""
    latest = new.groupBy(doc, chunk).agg(F.max_by(F.struct(*new.columns), F.col(version)).alias("_r")).select("_r.*")
    return stored.join(new.select(doc).distinct(), doc, "left_anti").unionByName(latest)


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row a key: the one with the largest order, new before stored where they tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*stored.columns), F.struct(order, "_new")).alias("_r")).select("_r.*")


def compare_and_set(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New values where the stored version is the expected one (a missing version counts as 0), the stored row elsewhere. new: key, expected, value."""
    n = new.select(F.col(key), F.col("expected").alias("_e"), F.col("value").alias("_v"))
    hit = F.coalesce("version", F.lit(0)) == F.col("_e")
    return stored.join(n, key, "left").withColumn("value", F.when(hit, F.col("_v")).otherwise(F.col("value"))).withColumn("version", F.when(hit, F.col("_e") + 1).otherwise(F.col("version"))).drop("_e", "_v")


def child_postings(chunks: DataFrame) -> DataFrame:
    """Postings of child chunks only, with their exact fields left to chunk_exact_fields."""
    from quarry.operators.lexical import sorted_postings

    return sorted_postings(chunks.where("chunk_type = 'child'"), "chunk_id", "content")


def enrich_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("exact", T.chunk_exact_fields(F.col("section_path"), F.col("content"))).select("*", "exact.*").drop("exact")


def route_rows(scopes: DataFrame, topics: DataFrame, documents: DataFrame, since: Column | None = None) -> DataFrame:
    """Rows of the route index from three tables, their own columns missing elsewhere; `since`: only rows updated from then on."""
    parts = [d.where(F.col("updated_at") >= since) if since is not None else d for d in (scopes, topics, documents)]
    kinds = [d.withColumn("kind", F.lit(k)) for k, d in zip(("scope", "topic", "document"), parts, strict=True)]
    return kinds[0].unionByName(kinds[1], allowMissingColumns=True).unionByName(kinds[2], allowMissingColumns=True)


def orphans(stored: DataFrame, valid: DataFrame, key: str, batches: int = 100) -> DataFrame:
    """Stored keys that aren't valid, each with one of `batches` numbers for deletion: dealt by hash, so no task numbers them all."""
    gone = stored.select(key).distinct().join(valid.select(key), key, "left_anti")
    return gone.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))


def keep_recent(traces: DataFrame, spans: DataFrame, scores: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without traces from before the cutoff and what belongs to them."""
    old = traces.where(F.col("created_at") < cutoff).select("trace_id")
    return tuple(d.join(old, "trace_id", "left_anti") for d in (traces, spans, scores))


def stale(documents: DataFrame, now: Column, low: int, high: int, most: int = 100) -> DataFrame:
    """Active documents between two stages that nobody touched for two hours, the newest ids first."""
    return documents.where(F.col("stage").between(low, high) & (F.col("status") == 1) & (F.col("updated_at") < now - F.expr("INTERVAL 2 HOURS"))).orderBy(F.desc("id")).limit(most)


def section_rows(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the section index: sections with their document's name; items are not indexed."""
    return nodes.where("node_type = 'section'").join(documents.select("doc", "document_name"), "doc")


def delete_documents(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def new_files(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files of which no indexed, active document has the size, name and scope."""
    active = known.where("status = 1 and indexed").select("size", "filename", "scope")
    return listed.join(active, ["size", "filename", "scope"], "left_anti")


def missing_postings(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """Chunks with words that an index made anew lacks; empty if the migration is whole."""
    from quarry.models import words

    worded = chunks.where(F.size(words(F.col("content"))) > 0).select(F.col("chunk_id").alias("chunk"))
    return worded.join(postings.select("chunk").distinct(), "chunk", "left_anti")


#: Pipeline stages in their order (fixed values); a failure compensates backwards.
STAGES = ["parse", "chunk", "vectorize", "index", "profile"]


def compensation(stage: Column) -> Column:
    """Stages to undo, the failed one first."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), stage)
    return F.when(at > 0, F.reverse(F.slice(F.array(*map(F.lit, STAGES)), F.lit(1), at.cast("int")))).otherwise(F.array().cast("array<string>"))
