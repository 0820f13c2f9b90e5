"""A stored keyword index: postings with positions in blocks that carry their best weight, and searches that skip blocks by it.

A block holds one term's postings of one bucket of chunks (by the chunk's hash), so no term's list has to fit one task.
Searches read the blocks of the asked terms only. A query's bound in a bucket is the sum of its terms' best weights there;
the buckets with the best bounds are scored first, and of the rest only those whose bound reaches the k-th score so far.
Texts and asked blocks are dealt out by bucket, and a task goes through its buckets one at a time, so neither words nor hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from quarry.models import words
from quarry.operators.lexical import HELD_WEIGHTS, K1, WORD, B, corpus_size, minimum_match, query_terms
from quarry.operators.ranking import QUERY_BLOCK, query_blocks, top
from quarry.sources.files import kept

#: Chunks of a bucket, and words at which buckets hold fewer chunks.
BUCKET_CHUNKS, BUCKET_WORDS = 4096, 4_000_000


@dataclass
class Index:
    """blocks: term, bucket, n (postings), best (largest weight) and postings (array of chunk, weight, positions)."""

    blocks: DataFrame
    chunks: int
    tokens: int
    buckets: int


def weight(tf: np.ndarray, dl: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a chunk's score, but for the term's rarity: at most 1."""
    return tf / (tf + K1 * (1 - B + B * dl * n / total))


def bucket_blocks(texts: pa.Table, n: int, total: int, schema: pa.Schema) -> pa.Table:
    """The blocks of one bucket (bucket, chunk and lower-case text), by term; postings by chunk."""
    texts = texts.take(pc.sort_indices(texts.column("chunk")))
    at: dict[str, int] = {}
    ids, dl = [], np.zeros(texts.num_rows, np.int64)
    for i, t in enumerate(texts.column("text")):
        found = WORD.findall(t.as_py())
        dl[i] = len(found)
        ids.append(np.fromiter((at.setdefault(w, len(at)) for w in found), np.int64, len(found)))
    if not at:
        return schema.empty_table()
    names = sorted(at)
    rank = np.empty(len(at), np.int64)
    rank[[at[w] for w in names]] = np.arange(len(at))
    term, chunk = rank[np.concatenate(ids)], np.repeat(np.arange(len(dl)), dl)
    spot = np.arange(len(term)) - np.repeat(np.cumsum(dl) - dl, dl)
    order = np.argsort(term, kind="stable")
    term, chunk, spot = term[order], chunk[order], spot[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(chunk) != 0)]))
    of_term, of_chunk, tf = term[first], chunk[first], np.diff(np.append(first, len(term)))
    w = weight(tf, dl[of_chunk], n, total)
    start = np.searchsorted(of_term, np.arange(len(names)))
    lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)
    chunks = texts.column("chunk").combine_chunks().take(pa.array(of_chunk))
    posts = pa.StructArray.from_arrays([chunks, pa.array(w), lists(first, pa.array(spot, pa.int32()))], names=["chunk", "weight", "positions"])
    buckets = pa.repeat(texts.column("bucket")[0], len(names))
    sizes = np.diff(np.append(start, len(first)))
    return pa.table([pa.array(names), buckets, pa.array(sizes, pa.int64()), pa.array(np.maximum.reduceat(w, start)), lists(start, posts)], names=schema.names).cast(schema)


def write_index(df: DataFrame, path: str, key: str = "chunk", text: str = "text", bucket_chunks: int = BUCKET_CHUNKS) -> Index:
    """Index the texts of df under a path and open the index. Texts without words have no postings; keys should be unique.

    Only the texts are shuffled, once, by bucket; a bucket's words are then sorted in its task. Buckets of long texts hold fewer chunks.
    """
    rows = df.select(F.col(key).alias("chunk"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")).where("chunk IS NOT NULL")
    n, total = corpus_size(rows, "text").first()
    buckets = max(1, -(-n // bucket_chunks), -(-total // BUCKET_WORDS))
    kind = f"term string, bucket int, n long, best double, postings array<struct<chunk:{rows.schema['chunk'].dataType.simpleString()},weight:double,positions:array<int>>>"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    dealt = rows.where("text <> ''").withColumn("bucket", F.pmod(F.xxhash64("chunk"), F.lit(buckets)).cast("int"))
    blocks = dealt.groupBy("bucket").applyInArrow(lambda t: bucket_blocks(t, n, max(total, 1), schema), kind)
    blocks.write.parquet(f"{path}/blocks")
    df.sparkSession.createDataFrame([(n, total, buckets)], "chunks long, tokens long, buckets int").write.parquet(f"{path}/size")
    return read_index(df.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    n, total, buckets = spark.read.parquet(f"{path}/size").first()
    return Index(spark.read.parquet(f"{path}/blocks"), n, total, buckets)


def asked_terms(index: Index, terms: DataFrame) -> DataFrame:
    """query, n_terms, term and idf of the terms that the index has. Reads the heads of the asked terms' blocks."""
    heads = index.blocks.select("term", "n").join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    return terms.join(df, "term").select("query", "n_terms", "term", F.log(1 + (F.lit(index.chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bounds(index: Index, asked: DataFrame) -> DataFrame:
    """query, bucket, bound, blocks: what no chunk of the bucket can score above. Reads heads only."""
    heads = index.blocks.select("term", "bucket", "best").join(F.broadcast(asked), "term")
    return heads.groupBy("query", "bucket").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.count("*").alias("blocks"))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket after the other, from rows sorted by bucket."""
    held, own = [], None
    for batch in batches:
        b = batch.column("bucket").to_numpy()
        for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]):
            if lo == hi:
                continue
            if held and b[lo] != own:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            own = b[lo]
    if held:
        yield pa.Table.from_batches(held)


def listed(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Of a column of lists: their lengths and all their values."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    return pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


def sortable(ids: pa.Array) -> np.ndarray:
    values = ids.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def best_scored(index: Index, asked: DataFrame, picked: DataFrame, k: int) -> DataFrame:
    """query, chunk, score, matched: of each task's buckets the k best chunks of each query, in the buckets picked for it (query, bucket).

    The asked terms' blocks are dealt out by bucket, and a bucket is scored by matrix products; a chunk counts with enough of a query's terms.
    """
    rows = asked.withColumn("least", minimum_match(F.col("n_terms"))).collect()
    kinds = {"query": asked.schema["query"].dataType, "chunk": index.blocks.schema["postings"].dataType.elementType["chunk"].dataType}
    names, at = list({r["query"]: None for r in rows}), {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    place = {q: i for i, q in enumerate(names)}
    wants, least = np.zeros((len(at), len(names))), np.zeros(len(names))
    for r in rows:
        wants[at[r["term"]], place[r["query"]]], least[place[r["query"]]] = r["idf"], r["least"]
    of_query, of_chunk = to_arrow_type(kinds["query"]), to_arrow_type(kinds["chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = [None] * len(names), np.full(len(names), -np.inf)
        for bucket in by_bucket(batches):
            own = np.array([place[q] for qs in bucket.column("queries").to_pylist() if qs for q in qs], int)
            blocks = bucket.filter(pc.is_valid(bucket.column("term")))
            if not len(own) or not blocks.num_rows:
                continue
            terms = np.array([at[t] for t in blocks.column("term").to_pylist()])
            n, values = listed(blocks.column("chunks"))
            of_term, w = np.repeat(np.arange(len(terms)), n), listed(blocks.column("weights"))[1].to_numpy()
            coded = values.dictionary_encode()
            ids, spot = sortable(coded.dictionary), coded.indices.to_numpy()
            rarity = wants[np.ix_(terms, own)]
            asks = (rarity > 0).astype(float)
            step = max(1, HELD_WEIGHTS // max(len(terms), len(own)))
            for lo in range(0, len(ids), step):
                here = (spot >= lo) & (spot < lo + step)
                table = np.zeros((min(step, len(ids) - lo), len(terms)))
                table[spot[here] - lo, of_term[here]] = w[here]
                held, score = (table > 0) @ asks, table @ rarity
                fresh = (held > 0) & (held >= least[own]) & (score >= floor[own] - 1e-8)
                for j in np.flatnonzero(fresh.any(0)).tolist():
                    i, found = own[j], np.flatnonzero(fresh[:, j])
                    new = score[found, j], ids[found + lo], held[found, j].astype(np.int64)
                    s, c, m = new if best[i] is None else (np.concatenate([a, b]) for a, b in zip(best[i], new, strict=True))
                    keep = np.lexsort((c, -np.round(s, 9)))[:k]
                    best[i] = s[keep], c[keep], m[keep]
                    if len(keep) == k:
                        floor[i] = best[i][0][-1]
        for name, found in zip(names, best, strict=True):
            if found is not None:
                s, c, m = found
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(s), of_query), pa.array(c.tolist(), of_chunk), pa.array(s), pa.array(m)], names=["query", "chunk", "score", "matched"])

    blocks = index.blocks.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").join(F.broadcast(picked.select("bucket").distinct()), "bucket", "left_semi")
    blocks = blocks.select("bucket", "term", F.col("postings.chunk").alias("chunks"), F.col("postings.weight").alias("weights"))
    both = blocks.unionByName(picked.groupBy("bucket").agg(F.collect_list("query").alias("queries")), allowMissingColumns=True)
    return both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"query {kinds['query'].simpleString()}, chunk {kinds['chunk'].simpleString()}, score double, matched long")


def indexed_search(index: Index, queries: DataFrame, k: int = 100, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, chunk, score, matched, rank) of the k best chunks by BM25, and (query, blocks, read): how many blocks its terms have and how many were scored.

    queries: query, text; a stated set, in blocks of 1024. Exact: a bucket is left out only if its bound stays below
    the k-th score of those that were scored. Scores that agree to 9 decimals are ties, in the order of chunks.
    first: how many buckets are scored before any is left out (k unless given, as each may hold one of the k best).
    """
    first = k if first is None else first
    hits, counts = [], []
    order = (F.round("score", 9).desc(), F.col("chunk"))
    for block in query_blocks(queries):
        asked = asked_terms(index, query_terms(block))
        asked = block.sparkSession.createDataFrame(asked.collect(), asked.schema)
        limits = kept(bounds(index, asked).withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "bucket"))), "search")
        start = kept(top(best_scored(index, asked, limits.where(F.col("nth") <= first), k), k, *order), "search")
        floor = start.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        more = limits.where(F.col("nth") > first).join(floor, "query", "left").where("floor IS NULL OR bound >= floor - 1e-8")
        hits.append(top(start.drop("rank").unionByName(best_scored(index, asked, more, k)), k, *order))
        used = limits.where(F.col("nth") <= first).select("query", "blocks").unionByName(more.select("query", "blocks"))
        counts.append(limits.groupBy("query").agg(F.sum("blocks").alias("blocks")).join(used.groupBy("query").agg(F.sum("blocks").alias("read")), "query"))
    return reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, counts)


def phrase_hits(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase, chunk, times: where all words of a phrase stand one behind the other, by their positions.

    phrases: phrase, text; up to 1024. Each word's places are moved back by its place in the phrase; a place that all words
    share starts the phrase. The words' blocks are dealt out by bucket and met there. Phrases without words have no hits.
    """
    if phrases.count() > QUERY_BLOCK:
        raise ValueError(f"up to {QUERY_BLOCK} phrases at a time")
    asked = [(r["phrase"], r["w"]) for r in phrases.select("phrase", words(F.col("text")).alias("w")).where("size(w) > 0").collect()]
    kinds = {"phrase": phrases.schema["phrase"].dataType, "chunk": index.blocks.schema["postings"].dataType.elementType["chunk"].dataType}
    of_phrase, of_chunk = to_arrow_type(kinds["phrase"]), to_arrow_type(kinds["chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in by_bucket(batches):
            terms = {t: i for i, t in enumerate(bucket.column("term").to_pylist())}
            n, values = listed(bucket.column("chunks"))
            times, spots = listed(pa.chunked_array([listed(bucket.column("positions"))[1]]))
            coded = values.dictionary_encode()
            # a place is a chunk's number and a word's, in one; of the term i they begin at ends[i]
            places = (np.repeat(coded.indices.to_numpy().astype(np.int64), times) << 32) + spots.to_numpy()
            ends = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(n)])]
            for phrase, w in asked:
                if not all(x in terms for x in w):
                    continue
                starts = sorted((places[ends[terms[x]] : ends[terms[x] + 1]] - i for i, x in enumerate(w)), key=len)
                whole = reduce(lambda a, b: a[np.isin(a, b, assume_unique=True)], starts)
                if len(whole):
                    chunks, found = np.unique(whole >> 32, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([phrase] * len(found), of_phrase), coded.dictionary.take(pa.array(chunks)).cast(of_chunk), pa.array(found, pa.int64())], names=["phrase", "chunk", "times"])

    sought = index.blocks.sparkSession.createDataFrame([(x,) for x in {x for _, w in asked for x in w}], "term string")
    blocks = index.blocks.join(F.broadcast(sought), "term", "left_semi").select("bucket", "term", F.col("postings.chunk").alias("chunks"), F.col("postings.positions").alias("positions"))
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"phrase {kinds['phrase'].simpleString()}, chunk {kinds['chunk'].simpleString()}, times long")
