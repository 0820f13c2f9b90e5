"""SimHash fingerprints and near-duplicate links by pigeonring filtering.

A 64-bit fingerprint is cut into a ring of m = tau + 1 segments. If two fingerprints differ in at most tau bits, the
pigeonring principle gives a segment from which every chain of l consecutive segments differs in at most l * tau / m
bits: no bit in the first segment and at most one in the first two. Of the two halves of the second segment one is
then equal too, so the pair shares a key made of one segment and half of the next, at one of 2 m places. Pairs that
share a key are tested inside their group, vectorised: chain by chain from the key's segment on, each against its budget,
and what is left by the whole distance (the chain of all segments). Only a spanning forest of the links leaves a task.

near_classes and drop_near_copies link texts by the same fingerprints and confirm each link by the exact Jaccard similarity
of the sets of shingles. At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, and in 8 to 12 as easily, so
texts that may be similar and that confirmed links don't join are compared exactly too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import batch_of, by_bucket, groups, shuffle_partitions, slices, split_hot, spread_out, squeezed, text_blocks, written
from quarry.llm._components import components, forest

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingles of this many texts and more are not told apart by their number.
MANY = 255
SLACK = 1e-9


def shingle_hashes(text: str | bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of `size` words, repeats included; a shorter text is one shingle, one without words none."""
    words = (text if isinstance(text, bytes) else text.encode("utf-8", "replace")).translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], dtype=np.uint64)


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of each hash (0: the hash itself)."""
    if not n:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without hashes. As an unsigned number."""
    if not len(h):
        return 0
    sums = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[a : a + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * sums > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, size: int, words: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`doc` and `fp` (array of `words` longs, the first one the 64-bit fingerprint) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            flat = []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t, size)
                flat += [fingerprint(mixed(h, n)) for n in range(words)]
            signed = np.array(flat, dtype=np.uint64).view(np.int64)
            offsets = np.arange(0, len(flat) + 1, words, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, signed)], names=["doc", "fp"])

    rows = df.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc {df.schema[key].dataType.simpleString()}, fp array<long>")


def ring_keys(fp: F.Column, tau: int) -> F.Column:
    """The keys of a fingerprint: each segment of the ring with either half of the next one, and which of them it is."""
    m, cuts = tau + 1, segment_cuts(tau)
    take = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    keys = []
    for i in range(m):
        a, b = cuts[i], cuts[i + 1]
        c, e = (cuts[i + 1], cuts[i + 2]) if i + 1 < m else (cuts[0], cuts[1])
        half = (c + e) // 2
        for k, (x, y) in enumerate([(c, half), (half, e)]):
            joined = F.shiftleft(take(a, b), y - x).bitwiseOR(take(x, y)) if y > x else take(a, b)
            keys.append(F.shiftleft(joined, 8).bitwiseOR(F.lit(2 * i + k).cast("long")))
    return F.array(*keys)


def segment_cuts(tau: int) -> list[int]:
    return [round(64 * i / (tau + 1)) for i in range(tau + 2)]


def chain_masks(tau: int) -> np.ndarray:
    """The bits of each chain: row i, column l - 1 for the l segments from segment i on."""
    cuts, m = segment_cuts(tau), tau + 1
    segments = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(m)]
    return np.array([[sum(segments[(i + k) % m] for k in range(n)) for n in range(1, m + 1)] for i in range(m)], dtype=np.uint64)


def chained(differ: np.ndarray, start: np.ndarray | int, masks: np.ndarray, tau: int) -> np.ndarray:
    """Which of the differences (xor of two fingerprints) keep the budget of every chain from segment `start` on."""
    ok = np.arange(len(differ))
    for n in range(2, tau + 2):
        own = masks[start if np.isscalar(start) else start[ok], n - 1]
        ok = ok[np.bitwise_count(differ[ok] & own) <= n * tau // (tau + 1)]
    return ok


def near_links(rows: DataFrame, tau: int, cap: int = 4096) -> DataFrame:
    """Links (a, b) that join all of rows (id, fp) whose first words differ in at most tau bits.

    A forest of each group is given, so links never outnumber the rows of the groups. Hot groups are split (see split_hot).
    """
    keyed = rows.select("id", "fp", F.explode(ring_keys(F.col("fp")[0], tau)).alias("key"))
    cells = split_hot(keyed, ["key"], "id", cap)
    masks = chain_masks(tau)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 2):
            n = table.num_rows
            place = (table.column(0).to_numpy() & 0xFF) // 2
            key = table.column(0).to_numpy() * np.int64(1000003) + table.column(1).to_numpy()
            ids = table.column(2).to_numpy()
            first = table.column(3).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)[:, 0]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, n))
            left, right = [], []
            # small groups, all at once: each row with the one d rows on
            at = np.flatnonzero(np.repeat(sizes <= 24, sizes))
            d = 1
            while len(at):
                at = at[at + d < n]
                at = at[key[at + d] == key[at]]
                pairs = at[chained(first[at] ^ first[at + d], place[at], masks, tau)]
                left.append(pairs)
                right.append(pairs + d)
                d += 1
            for s, k in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist(), strict=True):
                own, segment = first[s : s + k], int(place[s])

                def near(i: int, rest: np.ndarray, own=own, segment=segment) -> np.ndarray:
                    hit = np.zeros(len(rest), bool)
                    hit[chained(own[rest] ^ own[i], segment, masks, tau)] = True
                    return hit

                a, b = forest(near, k)
                left.append(a + s)
                right.append(b + s)
            x = np.concatenate([np.empty(0, np.int64), *left]).astype(np.int64)
            y = np.concatenate([np.empty(0, np.int64), *right]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["a", "b"])

    ordered = cells.select("key", "cell", "id", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return ordered.mapInArrow(run, "a long, b long")


def print_classes(df: DataFrame, size: int = 4, tau: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` (a long), fp (array of one long) and component: the smallest key that links of at most tau differing bits reach.

    Texts with fewer words are one shingle; null, empty and blank texts have a zero fingerprint and are linked like any
    other. Texts with one fingerprint are one node, so copies cost nothing beyond their row. Repeated rows each get a row.
    Rows with a null key link with none.
    """
    prints = written(fingerprints(df, size, 1, text, key).select(F.col("doc").cast("long").alias("doc"), "fp"), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc").alias("id"))
    found = components(near_links(nodes.where("id is not null"), tau))
    heads = nodes.join(found, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component"))
    return prints.join(heads, "fp").select(F.col("doc").alias(key), "fp", "component")


def marked(rows: DataFrame, size: int, similarity: float, text: str) -> DataFrame:
    """Of those rows that may have a similar one: _row, digest and n of the set of shingles, and `prefix`, its rarest shared shingles.

    Similar sets of n shingles at most share ceil(similarity * n) of them. So in one order of all shingles, by the number of
    texts that hold them, each has a shared one among its first n - ceil(similarity * n) + 1; and a text with as many
    shingles of its own has no similar one. The numbers are counted over all texts: each block of texts sends its distinct
    hashes to buckets, packed, and gets their counts back. Hashes that fall together there are counted together, which
    changes the order but not the result.
    """
    total = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    table = written(text_blocks(rows, text, "_row", 4_000_000), "shingle-blocks")
    n_buckets = max(shuffle_partitions(rows), int(total / 32e6) + 1)
    n_parts = max(shuffle_partitions(rows), int(total / 16e6) + 1)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[np.ndarray], list[dict]]]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = zstandard.ZstdDecompressor().decompress(batch.column(3)[k].as_py(), max_output_size=1 << 31) if len(batch.column(3)[k].as_py()) else b""
                ends = np.cumsum(batch.column(2)[k].values.to_numpy())
                own = [np.unique(shingle_hashes(raw[e - n : e], size)) for e, n in zip(ends.tolist(), batch.column(2)[k].values.to_pylist(), strict=True)]
                yield batch.column(0)[k].as_py(), batch.column(1)[k].values.to_pylist(), own, batch.column(4)[k].as_py() if batch.num_columns > 4 else None

    def distinct(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All hashes of a block in ascending order, in how many of its texts they are, and where their buckets begin."""
        names, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *own]), return_counts=True)
        bucket = (names >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        return names, np.minimum(counts, MANY).astype(np.uint8), np.searchsorted(bucket, np.arange(n_buckets + 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, own, _ in sets(batches):
            names, counts, cuts = distinct(own)
            low = (names & np.uint64(0xFFFFFFFF)).astype("<u4")
            found = [(int(k), block, low[cuts[k] : cuts[k + 1]].tobytes(), squeezed(counts[cuts[k] : cuts[k + 1]])) for k in np.flatnonzero(np.diff(cuts))]
            if found:
                yield batch_of(found, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["bucket", "block", "names", "counts"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bucket(batches):
            names = [np.frombuffer(b, "<u4") for b in part.column(2).to_pylist()]
            counts = np.concatenate([spread_out(b, np.uint8) for b in part.column(3).to_pylist()])
            _, which = np.unique(np.concatenate(names), return_inverse=True)
            sums = np.minimum(np.bincount(which, counts), MANY).astype(np.uint8)[which]
            found = [(block, k, squeezed(x)) for block, k, x in zip(part.column(1).to_pylist(), part.column(0).to_pylist(), np.split(sums, np.cumsum([len(x) for x in names])[:-1]), strict=True)]
            yield batch_of(found, [pa.int64(), pa.int32(), pa.binary()], ["block", "bucket", "counts"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, fields = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())], ["_row", "digest", "n", "prefix"]
        for _, ids, own, answers in sets(batches):
            names, _, _ = distinct(own)
            counts = np.concatenate([np.empty(0, np.uint8), *(spread_out(a["counts"], np.uint8) for a in sorted(answers or [], key=lambda a: a["bucket"]))])
            found = []
            for row, h in zip(ids, own, strict=True):
                first = len(h) - math.ceil(similarity * len(h) - SLACK) + 1
                held = counts[np.searchsorted(names, h)]
                alone = int((held == 1).sum())
                if alone < first:
                    order = np.argsort(held, kind="stable")[alone:first]
                    found.append((row, hashlib.sha256(h.tobytes()).digest()[:16], len(h), h[order].view(np.int64)))
            for k in range(0, len(found), 1000):
                yield batch_of(found[k : k + 1000], kinds, fields)

    sent = table.mapInArrow(send, "bucket int, block long, names binary, counts binary").repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "block")
    answers = written(sent.mapInArrow(reply, "block long, bucket int, counts binary"), "shingle-counts")
    of_block = answers.repartition(n_parts, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    whole = table.join(of_block.hint("shuffle_hash"), "block", "left").select("block", "ids", "sizes", "payload", "answers")
    return written(whole.mapInArrow(mark, "_row long, digest binary, n int, prefix array<long>"), "shingles")


def similar(nodes: list[int], sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets with at least that Jaccard similarity: exact overlaps, by an index of the sets."""
    size = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    begin = np.searchsorted(token[order], np.arange(token.max(initial=-1) + 2))
    starts = np.cumsum(size) - size

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        own = token[starts[i] : starts[i] + size[i]]
        own = own[begin[own + 1] - begin[own] > 1]
        if not len(own):
            return np.zeros(len(rest), bool)
        both = np.bincount(np.concatenate([holder[begin[t] : begin[t + 1]] for t in own]), minlength=len(sets))[rest]
        return both >= similarity * (size[i] + size[rest] - both) - SLACK

    a, b = forest(near, len(sets))
    ids = np.array(nodes)
    return ids[a], ids[b]


def set_links(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all texts (cluster, cell, node, t) of a cell with that Jaccard similarity, a forest of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nodes, sets = None, [], []
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (left, right)], names=["a", "b"])

        def close() -> None:
            if len(nodes) > 1:
                a, b = similar(nodes, sets, similarity)
                left.append(a)
                right.append(b)

        for batch in slices(batches, 3, 1_000_000):
            for cluster, cell, node, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (cluster, cell):
                    close()
                    place, nodes, sets = (cluster, cell), [], []
                nodes.append(node)
                sets.append(np.unique(shingle_hashes(t, size)))
            yield out()
            left, right = [], []
        close()
        yield out()

    return texts.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell").mapInArrow(run, "a long, b long")


def compared(texts: DataFrame, group: list[str], size: int, similarity: float, cap: int) -> DataFrame:
    """Links (a, b) of the texts (node, t) of a group, by exact similarity; groups of more than `cap` bytes are split."""
    cells = split_hot(texts.select("node", "t", F.struct(*group).alias("cluster")), ["cluster"], "node", cap, F.octet_length("t") + 64)
    return set_links(cells.select("cluster", "cell", "node", "t"), size, similarity)


def confirmed_links(texts: DataFrame, size: int, similarity: float, cap: int, tau: int = 4) -> DataFrame:
    """Links (a, b) that join all similar texts (node, t) of a cluster.

    Fingerprints that differ in at most tau bits come first (see print_classes): texts that they join are confirmed by exact
    similarity. A cluster whose texts are then all of one class needs no more; all texts of the others are compared exactly.
    """
    texts = written(texts, "candidates")
    prints = print_classes(texts, size, tau, "t", "node").select("node", F.col("component").alias("print"))
    shared = prints.groupBy("print").count().where("count > 1").select("print")
    confirmed = written(compared(texts.join(prints.join(shared, "print"), "node"), ["cluster", "print"], size, similarity, cap), "confirmed")
    classes = texts.select("node", "cluster").join(components(confirmed), "node", "left")
    apart = classes.groupBy("cluster").agg(F.min(F.coalesce("component", "node")).alias("least"), F.max(F.coalesce("component", "node")).alias("most")).where("least < most")
    rest = compared(texts.join(apart.select("cluster"), "cluster", "left_semi"), ["cluster"], size, similarity, cap)
    return written(confirmed.unionByName(rest), "links")


def _classed(df: DataFrame, size: int, similarity: float, text: str, key: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """df with numbered rows (_row), and for each _row that links with others its key and the smallest key of its class (null: the class has none)."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = marked(rows.select("_row", text), size, similarity, text)
    copies = found.groupBy("digest").agg(F.min("_row").alias("node"), F.count("*").alias("c")).where("c > 1").drop("c")
    noded = written(found.join(copies, "digest", "left").select("_row", F.coalesce("node", "_row").alias("node"), "prefix"), "nodes")
    tokens = noded.where("node = _row").select("node", F.explode("prefix").alias("key"))
    hubs = tokens.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    clusters = components(tokens.join(hubs, "key").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    texts = rows.select(F.col("_row").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(clusters, "node").withColumnRenamed("component", "cluster")
    links = confirmed_links(texts, size, similarity, cap)
    keys = rows.select("_row", F.col(key).alias("k"))
    labels = noded.select("_row", "node").join(components(links), "node", "left").select("_row", F.coalesce("component", "node").alias("c")).join(keys, "_row")
    labels = written(labels, "labels")
    return rows, labels.join(labels.groupBy("c").agg(F.min("k").alias("component")), "c").select("_row", "k", "component")


def near_classes(df: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id", cap: int = 4_000_000) -> DataFrame:
    """`key` and component: the smallest key that near-duplicate links reach, one row for each row of df.

    Texts are linked when the Jaccard similarity of their sets of distinct shingles is at least `similarity`, shingles being
    taken by their 64-bit hashes; fingerprints link first (see confirmed_links). No pair is missed: similar texts share one of their rarest shingles (see marked), texts that
    do form clusters, and inside a cluster all overlaps are exact. Clusters of more than `cap` bytes are split (see
    split_hot). A text with fewer words is one shingle; null, empty and blank texts have none and form one class. Texts with
    equal sets are one node. Null keys never win against others; a class of null keys only has a null component.
    """
    rows, classes = _classed(df, size, similarity, text, key, cap)
    known = classes.select("_row", "component", F.lit(True).alias("known"))
    return rows.select("_row", F.col(key).alias("k")).join(known, "_row", "left").select(F.col("k").alias(key), F.when(F.col("known"), F.col("component")).otherwise(F.col("k")).alias("component"))


def drop_near_copies(df: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id", cap: int = 4_000_000) -> DataFrame:
    """Rows of df whose key is the smallest of their near-duplicate class (all rows of a class without keys), all columns kept."""
    rows, classes = _classed(df, size, similarity, text, key, cap)
    return rows.join(classes.where(~F.col("k").eqNullSafe(F.col("component"))).select("_row"), "_row", "left_anti").select(*df.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles, links at 4 or fewer of 64 differing bits."""
    found = print_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, tau=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
