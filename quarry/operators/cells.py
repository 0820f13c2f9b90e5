"""Nearest vectors from a stored index: cells around centroids, left out where the triangle inequality rules them out.

A cell knows the least and largest distance of its vectors to its centroid, so no vector of it is nearer to a query than
the gap between that range and the query's own distance. The nearest cells are scored first; of the rest only those whose gap
is below the k-th distance so far. So the answer is exact whatever the centroids are; they only decide how much is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.operators.ranking import query_blocks, top, unit_rows

#: Vectors from which centroids are fitted at most, rounds of the fit, and the cell of vectors without direction.
SAMPLE, ROUNDS, NOWHERE = 20_000, 8, -1


@dataclass
class Cells:
    """rows: chunk, vector (unit, as doubles), away and cell, in folders by cell; and of each cell its centroid, range and size."""

    rows: DataFrame
    centroids: np.ndarray
    least: np.ndarray
    most: np.ndarray
    size: np.ndarray
    nowhere: int


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def fit_centroids(corpus: DataFrame, n: int, dim: int) -> np.ndarray:
    """n centroids (fewer if there are fewer different vectors) by k-means over up to about SAMPLE rows, picked by the hash of their chunk."""
    every = max(1, -(-corpus.count() // SAMPLE))
    picked = corpus.where(F.pmod(F.xxhash64("chunk"), F.lit(every)) == 0).orderBy(F.xxhash64("chunk", F.lit(1))).limit(SAMPLE)
    x = unit_rows([r.vector for r in picked.select("vector").collect()], dim)
    x = x[np.abs(x).sum(1) > 0]
    c = np.unique(x[:n], axis=0)
    for _ in range(ROUNDS if len(c) else 0):
        of = distances(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        many = np.bincount(of, minlength=len(c))[:, None]
        c = np.where(many > 0, sums / np.maximum(many, 1), c)
    return c if len(c) else np.zeros((1, dim))


def write_cells(corpus: DataFrame, path: str, n: int, dim: int) -> Cells:
    """Index corpus (chunk, a long; vector) under a path. Null, zero and other-sized vectors have no direction and score 0 with all."""
    centroids = fit_centroids(corpus, n, dim)
    np_rows = pa.list_(pa.float64())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
                x = unit_rows(part.column(1).to_pylist(), dim)
                d = distances(x, centroids)
                cell = np.where(np.abs(x).sum(1) > 0, d.argmin(1), NOWHERE)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat.cast(np_rows), pa.array(d.min(1)), pa.array(cell, pa.int32())], names=["chunk", "vector", "away", "cell"])

    kind = corpus.schema["chunk"].dataType.simpleString()
    corpus.select("chunk", "vector").where("chunk IS NOT NULL").mapInArrow(assign, f"chunk {kind}, vector array<double>, away double, cell int").write.partitionBy("cell").parquet(f"{path}/rows")
    corpus.sparkSession.createDataFrame(list(enumerate(centroids.tolist())), "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return read_cells(corpus.sparkSession, path, kind)


def read_cells(spark: SparkSession, path: str, kind: str = "bigint") -> Cells:
    rows = spark.read.schema(f"chunk {kind}, vector array<double>, away double, cell int").parquet(f"{path}/rows")
    centroids = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    least, most, size = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf), np.zeros(len(centroids), np.int64)
    nowhere = 0
    for r in rows.groupBy("cell").agg(F.min("away").alias("least"), F.max("away").alias("most"), F.count("*").alias("n")).collect():
        if r.cell == NOWHERE:
            nowhere = r.n
        else:
            least[r.cell], most[r.cell], size[r.cell] = r.least, r.most, r.n
    return Cells(rows, centroids, least, most, size, nowhere)


def scored_cells(index: Cells, names: list, asked: np.ndarray, wanted: np.ndarray, k: int, nowhere: bool, of_query: pa.DataType, schema: str) -> DataFrame:
    """query, chunk, score: of each task's rows the k nearest to each query, where wanted (queries by cells) says so."""
    cells = np.flatnonzero(wanted.any(0)).tolist() + [NOWHERE] * nowhere
    of_chunk = to_arrow_type(index.rows.schema["chunk"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int64))] * len(names)
        for batch in batches:
            chunk, cell = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                who = np.arange(len(names)) if c == NOWHERE else np.flatnonzero(wanted[:, c])
                for part in (at[i : i + 2000] for i in range(0, len(at), 2000)):
                    scores = x[part] @ asked[who].T
                    floor = np.array([best[i][0][-1] - 1e-9 if len(best[i][0]) == k else -2 for i in who])
                    for j in np.flatnonzero((scores >= floor).any(0)).tolist():
                        fresh = scores[:, j] >= floor[j]
                        s, n = best[who[j]]
                        s, n = np.concatenate([s, scores[fresh, j]]), np.concatenate([n, chunk[part[fresh]]])
                        keep = np.lexsort((n, -np.round(s, 12)))[:k]
                        best[who[j]] = s[keep], n[keep]
        for name, (s, n) in zip(names, best, strict=True):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(s), of_query), pa.array(n, of_chunk), pa.array(s)], names=["query", "chunk", "score"])

    return index.rows.where(F.col("cell").isin(cells)).select("chunk", "vector", "cell").mapInArrow(run, schema)


def nearest_by_cells(index: Cells, queries: DataFrame, k: int = 50, first: int = 2) -> tuple[DataFrame, float]:
    """(query, chunk, score, rank) of the k nearest by cosine, exactly, and the share of all pairs of queries and vectors that were scored.

    queries: query, query_vector; a stated set, in blocks of 1024. Scores that agree to 12 decimals are ties, in the order of
    chunks. Queries without direction score 0 with all vectors. first: cells that are scored before any is left out.
    """
    parts, met, all_pairs = [], 0, 0
    n_cells, dim = index.centroids.shape
    kinds = {f.name: f.dataType for f in queries.schema}
    schema = f"query {kinds['query'].simpleString()}, chunk {index.rows.schema['chunk'].dataType.simpleString()}, score double"
    order = (F.round("score", 12).desc(), F.col("chunk"))
    for block in query_blocks(queries):
        rows = block.select("query", "query_vector").collect()
        names, asked = [r[0] for r in rows], unit_rows([r[1] for r in rows], dim)
        if not names:
            continue
        d = distances(asked, index.centroids)
        gap = np.maximum(np.maximum(d - index.most, index.least - d), 0)
        aimless = np.abs(asked).sum(1) == 0
        start = np.zeros((len(names), n_cells), bool)
        np.put_along_axis(start, np.argsort(np.where(index.size > 0, d, np.inf), axis=1)[:, :first], True, axis=1)
        start[aimless] = True
        run = lambda wanted, nowhere, names=names, asked=asked: scored_cells(index, names, asked, wanted, k, nowhere, to_arrow_type(kinds["query"]), schema)
        found = top(run(start, True), k, *order)
        floor = {r["query"]: r.score for r in found.where(F.col("rank") == k).select("query", "score").collect()}
        reach = np.array([np.sqrt(max(2 - 2 * floor[n], 0)) if n in floor else np.inf for n in names])
        more = (gap <= reach[:, None] + 1e-6) & ~start & (index.size > 0)
        parts.append(top(found.drop("rank").unionByName(run(more, False)), k, *order) if more.any() else found)
        met += int(((start | more) * index.size).sum()) + index.nowhere * len(names)
        all_pairs += (int(index.size.sum()) + index.nowhere) * len(names)
    if not parts:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int"), 0.0
    return reduce(DataFrame.unionByName, parts), met / max(all_pairs, 1)
