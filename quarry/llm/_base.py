"""Small helpers that the corpus operators share: scratch tables, slices of batches, split groups and group streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null key among longs.
LEAST_ID = -(1 << 63)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where none is set, one of this machine's, in local mode only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about `most` bytes of a text column (one row at least)."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(lengths):
            if held and held + int(n) > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_hot(rows: DataFrame, key: list[str], spread: str, cap: int, weight: Column | None = None) -> DataFrame:
    """Bound the groups of a join inside groups.

    Groups of at most `cap` rows (or of that weight) keep one cell. A larger group is cut into k chunks by a hash of
    `spread`; each row goes to the k cells that pair its chunk with every chunk, so each pair of rows still meets
    in some cell, and no cell holds much more than 2 * cap rows. Adds `cell` (int).
    """
    size = F.count("*") if weight is None else F.sum(weight)
    hot = rows.groupBy(*key).agg(size.alias("count")).where(F.col("count") > cap).withColumn("_k", F.ceil(F.col("count") / cap).cast("int")).drop("count")
    k = F.coalesce(F.col("_k"), F.lit(1))
    chunk = F.pmod(F.xxhash64(F.col(spread)), k.cast("long")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), k - 1), lambda d: F.least(chunk, d) * k + F.greatest(chunk, d))
    return rows.join(hot, key, "left").withColumn("cell", F.explode(cells)).drop("_k")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int, most: int = 200_000) -> Iterator[pa.Table]:
    """From batches sorted by their first n_keys columns: tables of whole groups, many small groups together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(k) for k in range(n_keys)]
        last = [k[-1].as_py() for k in keys]
        cut = table.num_rows
        same = None
        for k, v in zip(keys, last, strict=True):
            eq = pc.equal(k, pa.scalar(v, k.type))
            same = eq if same is None else pc.and_(same, eq)
        cut -= int(pc.sum(same).as_py())
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket (the first column) at a time, from batches sorted by it."""
    for table in groups(batches, 1, 1):
        of = table.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield table.slice(a, z - a)


def batch_of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def squeezed(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a).tobytes())


def squeezed_ascending(a: np.ndarray) -> bytes:
    """32-bit numbers in ascending order: their differences, byte by byte."""
    steps = np.diff(a.astype(np.int64), prepend=0).astype("<u4")
    return squeezed(steps.view(np.uint8).reshape(-1, 4).T)


def spread_ascending(b: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(spread_out(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64).astype("<u4")


def spread_out(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def text_blocks(df: DataFrame, text: str, key: str, block_bytes: int) -> DataFrame:
    """block, ids, sizes and payload: texts in compressed blocks, each in the order of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = sorted(held, key=lambda r: r[0])
            payload = zstandard.ZstdCompressor(level=6).compress(b"".join(b for _, b in rows))
            return pa.RecordBatch.from_arrays([pa.array([[i for i, _ in rows]], pa.list_(pa.int64())), pa.array([[len(b) for _, b in rows]], pa.list_(pa.int32())), pa.array([payload], pa.binary())], names=["ids", "sizes", "payload"])

        for batch in slices(batches, 1):
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((i, b))
                size += len(b)
                if size >= block_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST_ID)).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "ids array<long>, sizes array<int>, payload binary").select(F.monotonically_increasing_id().alias("block"), "ids", "sizes", "payload")
