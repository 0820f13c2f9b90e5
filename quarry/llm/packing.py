"""Packing documents into training sequences in space-filling-curve order.

Each document's token counts are projected to a few dimensions by hashed signs; the cell of that vector gets a Hilbert
key, and the key orders all documents by a range sort, so neighbours on the curve, which talk alike, share sequences.
Equal keys are ordered by a hash of the document, so a hot group of copies spreads over many ranges. Ids travel in
chunks of bounded length, so ranges of about equally many rows are of about equal size though long documents lie together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import slices, written
from quarry.llm.bpe import PRETOKENS, byte_letters

DIMS, BITS = 4, 8
#: Ids in one row of the shuffle at most; a longer document goes as several rows.
CHUNK = 2048


@lru_cache(maxsize=2)
def fast_encoding(path: str):
    """A tiktoken encoding with the vocabulary of a byte-level BPE file; same ids as the tokenizers library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(of_letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=added)


def id_kind(path: str) -> str:
    """The NumPy type that ids travel as: 16 bits where the vocabulary allows."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return "<u2" if size <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def signs(size: int, dims: int = DIMS) -> np.ndarray:
    """Signs of each token id in each dimension, by hashing the id."""
    x = np.arange(size, dtype=np.uint64)
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return np.stack([((x >> np.uint64(d + 7)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(dims)], axis=1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer cells (rows of `dims` coordinates of `bits` bits), by Skilling's transposition (AIP 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(ids: list[np.ndarray], size: int) -> np.ndarray:
    """Hilbert keys of documents given as arrays of ids; a mean of signs times sqrt(n) is about normal, +-3 fills the cells."""
    table = signs(size)
    v = np.array([table[x].sum(axis=0) / max(1.0, len(x)) ** 0.5 for x in ids], dtype=np.float64).reshape(len(ids), DIMS)
    scale = 1 << BITS
    return hilbert(np.clip(((np.tanh(v / 8) + 1) / 2 * scale).astype(np.int64), 0, scale - 1))


def tokens(df: DataFrame, path: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chunks of all documents: `doc`, `curve` (Hilbert key), `start`, `doc_tokens` and `ids` (little-endian unsigned 32-bit or, for small vocabularies, 16-bit ids in bytes)."""

    kind = id_kind(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = fast_encoding(path)
        for batch in slices(batches, 1, 1_000_000):
            ids = [np.array([*enc.encode(t, allowed_special="all"), end_id], dtype=kind) for t in batch.column(1).to_pylist()]
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            chunks = -(-lengths // CHUNK)
            row = np.repeat(np.arange(len(ids)), chunks)
            start = CHUNK * (np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
            raw = [ids[r][a : a + CHUNK].tobytes() for r, a in zip(row.tolist(), start.tolist(), strict=True)]
            cols = [batch.column(0).take(pa.array(row)), pa.array(curve_keys(ids, enc.n_vocab)[row]), pa.array(start), pa.array(lengths[row]), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "curve", "start", "doc_tokens", "ids"])

    return df.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(encode, f"doc {df.schema[key].dataType.simpleString()}, curve long, start long, doc_tokens long, ids binary")


def pack(df: DataFrame, path: str, length: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id", target_mb: int = 16) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens: doc, start, ids (32-bit, little-endian), doc_tokens, sequence_id, offset.

    Documents follow the curve within ranges of about target_mb; a range is cut every `length` tokens, and its rest is cut
    at powers of two, which need no padding. So no sequence holds padding, each id lies in one piece, and one range is one
    task's work whatever the documents are. Null text: empty, which is one piece with the end id. Repeated rows are
    packed each by itself. Extra columns are left out. An empty table gives no pieces.
    """
    rows = written(tokens(df, path, end_id, text, key), "pack-tokens")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    n = max(1, int(size) // (target_mb << 20) + 1)
    ordered = rows.withColumn("tie", F.xxhash64("doc")).repartitionByRange(n, "curve", "tie", "doc", "start").sortWithinPartitions("curve", "tie", "doc", "start")
    kind, width = df.schema[key].dataType.simpleString(), id_kind(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc", "start", "ids", "doc_tokens", "sequence", "offset"]
        sequence = offset = 0
        open_rows: list[list] = []
        full: list[list] = []

        def batch_of(pieces: list[list]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            kinds = [pa.int32(), doc_kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in slices(batches, 4, 1_000_000):
            doc_kind = batch.schema.field(1).type
            for part, doc, begin, total, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.frombuffer(raw, dtype=width).astype("<u4")
                at = 0
                while at < len(ids):
                    take = min(length - offset, len(ids) - at)
                    open_rows.append([part, doc, begin + at, ids[at : at + take].tobytes(), total, sequence, offset])
                    at, offset = at + take, offset + take
                    if offset == length:
                        full.extend(open_rows)
                        open_rows, offset, sequence = [], 0, sequence + 1
                if len(full) >= 500:
                    yield batch_of(full)
                    full = []
        full.extend(powers(open_rows, offset, sequence))
        if full:
            yield batch_of(full)

    pieces = ordered.select(F.spark_partition_id().alias("part"), "doc", "start", "doc_tokens", "ids").mapInArrow(cut, f"part int, doc {kind}, start long, ids binary, doc_tokens long, sequence long, offset long")
    sequence_id = F.shiftleft(F.col("part").cast("long"), 40) + F.col("sequence")
    return pieces.select(F.col("doc").alias(key), "start", "ids", "doc_tokens", sequence_id.alias("sequence_id"), "offset")


def powers(rows: list[list], total: int, sequence: int) -> list[list]:
    """Cut one short sequence again, into sequences whose lengths are the powers of two that add up to it."""
    ends = [sum(1 << b for b in range(total.bit_length() - 1, k - 1, -1) if total >> b & 1) for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    out, begin = [], 0
    for n, end in enumerate(ends):
        for part, doc, start, ids, doc_tokens, _, offset in rows:
            a, b = max(begin, offset), min(end, offset + len(ids) // 4)
            if a < b:
                out.append([part, doc, start + a - offset, ids[(a - offset) * 4 : (b - offset) * 4], doc_tokens, sequence + n, a - begin])
        begin = end
    return out


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024; digests derived from the operator's pieces."""
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
