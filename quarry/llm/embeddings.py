"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within a squared distance of 2 - 2c. After a random rotation the dimensions are cut into
blocks, and the distance is the sum of the blocks' distances, so some block holds at most its proportional share. Each
block is range-joined under that share. Its space is split into cells at quantiles of its coordinates; a vector goes to
all cells that meet the box from it to `radius` further on in each dimension, so two vectors within the radius meet in the
cell of their greater coordinates, whichever cells they lie in. There the block distance picks the candidates. They are
checked by the whole cosine, and a pair counts in the first block that finds it, so no pair is counted twice and none is
lost. A split sends on a vector with the chance of lying within one radius of it and on one side only: with 4 blocks of 64
dimensions 0.29, so each doubling of a label's vectors costs 1.29 times as many rows a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import groups, written
from quarry.llm._components import components

CELL_ROWS = 4000
SLACK = 1 + 1e-9
#: Quantiles of a coordinate that splits can lie at, and rows of a label that they are drawn from, about.
EIGHTHS, SAMPLED = 8, 2000


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, n_blocks: int) -> list[slice]:
    cuts = [round(dim * i / n) for n in [max(1, min(n_blocks, dim))] for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def splits(quantiles: np.ndarray, depth: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """(dimension, where it is split): at most `depth` halvings of a block's space, given the eighths of each of its coordinates.

    Wide dimensions come first. There is no split that would send on three of eight vectors or more, for they lie too close.
    """
    parts: dict[int, int] = {}
    places = lambda d, n: quantiles[d][EIGHTHS // n * np.arange(1, n) - 1]
    for n in (2, 4, 8):
        for d in np.argsort(quantiles[:, 0] - quantiles[:, -1], kind="stable").tolist():
            roomy = places(d, 2)[0] - radius > quantiles[d][0] if n == 2 else parts.get(d) == n // 2 and np.diff(places(d, n)).min() > 2 * radius
            if roomy and sum(k.bit_length() - 1 for k in parts.values()) < depth:
                parts[d] = n
    return [(d, places(d, n)) for d, n in sorted(parts.items())]


def cells(x: np.ndarray, cuts: list[tuple[int, np.ndarray]], radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and `away` of all cells that meet the boxes from each row of x to `radius` further on.

    away: one bit a split dimension, set where the row itself lies before the cell. Two rows within the radius meet in
    exactly one cell in which no dimension has both away.
    """
    row, cell, away = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for bit, (d, at) in enumerate(cuts):
        own, last = np.searchsorted(at, x[row, d], "right"), np.searchsorted(at, x[row, d] + radius, "right")
        parts = [(own + k <= last, k) for k in range(int((last - own).max(initial=0)) + 1)]
        base = cell * (len(at) + 1) + own
        row, cell, away = (np.concatenate(c) for c in zip(*[(row[ok], base[ok] + k, away[ok] | (min(k, 1) << bit)) for ok, k in parts], strict=True))
    return row, cell, away


def cosine_links(df: DataFrame, threshold: float = 0.98, n_blocks: int = 4, vector: str = "embedding", key: str = "vec_id", label: str = "label", cap: int = 4000, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row for each row of df: key, n_links, component (smallest key that links reach) and kept (key = component).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine, in double precision,
    is at least the threshold. Vectors that are null, empty, zero, or that hold null or non-finite components link with
    nothing. Equal vectors of one label are one node of the join, so a hot vector costs one row; their links with each
    other count. Rows with equal keys are taken as one vector each, joined under that key. Extra columns are left out.
    A cell with more than `cap` vectors is cut into chunks, and each pair of chunks is met by a task of its own.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("l"), F.col(vector).alias("v"))
    fit = F.col("l").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False))).withColumn("g", F.concat_ws(":", F.size("v").cast("string"), F.col("l").cast("string")))
    nodes = written(valid.groupBy("g", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    budget = (2 - 2 * threshold) * SLACK + 1e-12

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, turned in by_length(batch):
                flat = pa.array(turned.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, turned.shape[1], dtype=np.int32), flat)], names=["g", "x"])

    sizes = nodes.groupBy("g").agg(F.count("*").alias("n"))
    large = nodes.join(sizes.where(F.col("n") > cell_rows), "g").where(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SAMPLED)) == 0)
    turned = large.select("g", "v").mapInArrow(turn, "g string, x array<double>").select("g", F.posexplode("x").alias("d", "x"))
    eighths = turned.groupBy("g", "d").agg(F.percentile_approx("x", [k / EIGHTHS for k in range(1, EIGHTHS)], 1000).alias("q"))
    quantiles = eighths.groupBy("g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("d", "q"))), lambda s: s["q"])).alias("q"))
    sized = nodes.join(sizes.join(quantiles, "g", "left"), "g").select("g", "v", "id", "copies", "n", "q")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            for part, turned in by_length(batch):
                groups_of = np.array(part.column(0).to_pylist(), dtype=object)
                for g in np.unique(groups_of):
                    own = np.flatnonzero(groups_of == g)
                    size, q = part.column(4)[int(own[0])].as_py(), part.column(5)[int(own[0])].as_py()
                    for b, cut in enumerate(blocks_of(turned.shape[1], n_blocks)):
                        radius = math.sqrt(budget * (cut.stop - cut.start) / turned.shape[1])
                        depth = math.ceil(math.log2(max(size / cell_rows, 1)))
                        found = splits(np.array(q).reshape(-1, EIGHTHS - 1)[cut], depth, radius) if q and depth else []
                        row, cell, away = cells(turned[own, cut], found, radius)
                        for k in range(0, len(row), 5000):
                            t = pa.array(own[row[k : k + 5000]])
                            arrays = [part.column(0).take(t), pa.array(np.full(len(t), b, np.int32)), pa.array(cell[k : k + 5000]), pa.array(away[k : k + 5000]), part.column(2).take(t), part.column(3).take(t), part.column(1).take(t)]
                            yield pa.RecordBatch.from_arrays(arrays, names=["g", "block", "cell", "away", "id", "copies", "v"])

    kind = df.schema[vector].dataType.simpleString()
    dealt = sized.mapInArrow(deal, f"g string, block int, cell long, away long, id long, copies long, v {kind}")
    where = ["g", "block", "cell"]
    hot = dealt.groupBy(*where).count().where(F.col("count") > cap).select(*where, F.ceil(F.col("count") / cap).cast("int").alias("k"))
    k = F.coalesce("k", F.lit(1))
    chunked = dealt.join(hot, where, "left").withColumn("chunk", F.pmod(F.xxhash64("id"), k.cast("long")).cast("int"))
    chunked = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    at = F.concat_ws("|", *where, F.least("chunk", "other").cast("string"), F.greatest("chunk", "other").cast("string"))
    # 0: a cell of one chunk, else 1 or 2 for the chunk with the smaller or greater number of the two
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    met = chunked.select(at.alias("at"), "block", side.alias("side"), "away", "id", "copies", "v").repartition("at").sortWithinPartitions("at")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1, 4000):
            name = np.array(table.column(0).to_pylist(), dtype=object)
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            for s, e in zip(starts, np.append(starts[1:], len(name)), strict=True):
                yield from meet(table.slice(s, e - s), threshold, n_blocks, budget)

    found = written(met.mapInArrow(join, "a long, b long, w long"), "vector-links")
    counts = found.groupBy("a").agg(F.sum("w").alias("links"))
    heads = nodes.join(counts, F.col("id") == F.col("a"), "left").drop("a").join(components(found.select("a", "b")), F.col("id") == F.col("node"), "left")
    heads = heads.select("g", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    linked = valid.join(heads, ["g", "v"]).select("id", "n_links", "c")
    rest = rows.where(F.col("id").isNull() | ~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c"))
    return linked.unionByName(rest).select(F.col("id").alias(key), "n_links", F.col("c").alias("component"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows whose vectors (second column) have one length, with the rotated unit vectors."""
    dims = np.diff(batch.column(1).offsets.to_numpy())
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield part, unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) @ rotation(int(dim))


def meet(table: pa.Table, threshold: float, n_blocks: int, budget: float) -> Iterator[pa.RecordBatch]:
    """Links of one cell (or of two chunks of it): for each linked vector its weight of links, and one that joins it to the others."""
    block = int(table.column(1)[0].as_py())
    side, away = table.column(2).to_numpy(), table.column(3).to_numpy()
    ids, copies = table.column(4).to_numpy(), table.column(5).to_numpy()
    v = unit(table.column(6).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
    dim = v.shape[1]
    cuts = blocks_of(dim, n_blocks)
    turned = v @ rotation(dim)
    x = turned[:, cuts[block]]
    squares = (x**2).sum(axis=1)
    near = lambda b, i, j: ((turned[i, cuts[b]] - turned[j, cuts[b]]) ** 2).sum(axis=1) <= budget * (cuts[b].stop - cuts[b].start) / dim
    weight, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for a in range(0, len(ids), 512):
        z = min(a + 512, len(ids))
        gap = squares[a:z, None] + squares[None, a:] - 2 * (x[a:z] @ x[a:].T)
        i, j = np.nonzero(gap <= budget * x.shape[1] / dim + 1e-9)
        i, j = i + a, j + a
        ok = (i < j) & (away[i] & away[j] == 0) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = near(block, p, q) & (np.einsum("ij,ij->i", v[p], v[q]) >= threshold)
            for b in range(block):
                ok[ok] = ~near(b, p[ok], q[ok])
            p, q = p[ok], q[ok]
            weight += np.bincount(p, copies[q], len(ids)).astype(np.int64) + np.bincount(q, copies[p], len(ids)).astype(np.int64)
            while (parent[p] != parent[q]).any():
                low = np.minimum(parent[p], parent[q])
                np.minimum.at(parent, parent[p], low)
                np.minimum.at(parent, parent[q], low)
                parent = parent[parent]
    out = np.flatnonzero(weight)
    if len(out):
        root = parent
        while (root != root[root]).any():
            root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]]), pa.array(weight[out])], names=["a", "b", "w"])


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = cosine_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("component", "component_id")
