"""Passages of test items inside documents, by Wu and Manber's search for many strings at once.

Texts are brought to one form (lower-case words, one space around each), in which a window of an item's words is a plain
string. For the strings of about one length a table says how far the search may move on behind each block of bytes; where
it says nowhere, the block's hash picks the strings whose heads end in it, and direct comparison confirms them. Many
places of a batch move on side by side. Items come in blocks of bounded size, each sent to the executors once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import slices, written

SPACE, MARK = 32, 10
#: Bytes of words: digits, letters (A to Z as a to z) and everything outside ASCII; the others part words.
FORM = np.full(256, SPACE, np.uint8)
FORM[0x80:] = np.arange(0x80, 0x100)
FORM[0x30:0x3A] = np.arange(0x30, 0x3A)
FORM[0x61:0x7B] = FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Bytes of a block, stretch of a text that one place walks through, and zero bytes on both sides of a searched text.
BLOCK, STRETCH, PAD = 12, 1024, 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal_form(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a column without nulls in one form: the bytes, where each text's mark is, and where words start.

    Each text is a mark and a space, then each word with a space behind it.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths, nth = np.diff(offsets), np.arange(len(column))
    raw = np.full(len(data) + 3 * len(column), SPACE, np.uint8)
    raw[np.arange(len(data)) + np.repeat(3 * nth + 2, lengths)] = FORM[data]
    raw[offsets[:-1] - offsets[0] + 3 * nth] = MARK
    space = raw == SPACE
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    form = raw[keep]
    space = form == SPACE
    return form, np.flatnonzero(form == MARK), np.flatnonzero(~space[1:] & space[:-1] & (form[1:] != MARK)) + 1


def eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def padded(form: np.ndarray, most: int = 0) -> np.ndarray:
    return np.concatenate([np.zeros(PAD, np.uint8), form, np.zeros(PAD + most, np.uint8)])


def block_hash(words: np.ndarray, end: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Of the `size` bytes that end before `end` (places in a padded text)."""
    tail = words[end - 8] >> np.uint64(8 * max(0, 8 - size))
    h = tail * M1
    if size > 8:
        h ^= words[end - size] * M2
    return ((h ^ (h >> np.uint64(31))) * M1) >> np.uint64(64 - bits)


class Table:
    """Shifts and buckets of the strings of about one length. heads: as many bytes as the shortest has are looked at."""

    def __init__(self, words: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray) -> None:
        self.head = int(length.min())
        self.block = self.head if self.head < 8 else min(BLOCK, (self.head + 1) // 2)
        far = self.head - self.block
        self.bits = int(np.clip(np.ceil(np.log2(4 * len(start) * (far + 1) + 1)), 10, 22))
        self.shift = np.full(1 << self.bits, far + 1, np.int32)
        for at in range(far + 1):  # later blocks give smaller shifts, which stay
            self.shift[block_hash(words, start + at + self.block, self.block, self.bits)] = far - at
        bucket = block_hash(words, start + self.head, self.block, self.bits)
        order = np.argsort(bucket, kind="stable")
        self.number, self.bucket = number[order], bucket[order]

    def candidates(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text (as padded) and numbers of strings whose heads may stand there."""
        ends = np.arange(PAD + self.head, PAD + n + 1, STRETCH)
        last = np.minimum(ends + STRETCH, PAD + n + 1)
        stops = []
        while len(ends):
            shift = self.shift[block_hash(words, ends, self.block, self.bits)]
            stops.append(ends[shift == 0])
            ends = ends + np.maximum(shift, 1)
            on = ends < last
            if not on.all():
                ends, last = ends[on], last[on]
        at = np.concatenate(stops) if stops else ends
        at = at[(words[at - self.head] & np.uint64(0xFF)) == SPACE]
        key = block_hash(words, at, self.block, self.bits)
        a = np.searchsorted(self.bucket, key)
        many = np.searchsorted(self.bucket, key, "right") - a
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
        return np.repeat(at - self.head, many), self.number[which]


class Windows:
    """The windows of a block of items as strings to search for, each string once with the items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], size: int) -> None:
        form, marks, starts = normal_form(pa.array([t for _, t in items], pa.binary()))
        self.text = padded(form)
        ends = np.append(marks[1:], len(form))[: len(marks)]
        first = np.searchsorted(starts, marks)
        words = np.searchsorted(starts, ends) - first
        self.items = sorted({i for i, _ in items})
        name = {x: k for k, x in enumerate(self.items)}
        seen: dict[bytes, int] = {}
        start, length, count = [], [], []
        owners: list[set[int]] = []
        whole = form.tobytes()
        spots = np.append(starts, 0).tolist()
        for (item, _), f, n, end in zip(items, first.tolist(), words.tolist(), ends.tolist(), strict=True):
            for j in range(f, f + max(n - size, 0) + 1 if n else f):
                k = min(n, size)
                a, z = spots[j] - 1, spots[j + k] if j + k < f + n else end
                number = seen.setdefault(whole[a:z], len(start))
                if number == len(start):
                    start.append(a + PAD)
                    length.append(z - a)
                    count.append(k)
                    owners.append(set())
                owners[number].add(name[item])
        self.start, self.length, self.count = (np.array(x, np.int64) for x in (start, length, count))
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owner = np.array([x for o in owners for x in sorted(o)], np.int64)
        kind = np.array([int(x).bit_length() for x in length], np.int64)
        self.tables = [Table(eights(self.text), self.start[on], self.length[on], on) for on in (np.flatnonzero(kind == k) for k in np.unique(kind))]
        self.longest = max(length, default=0)

    def occurrences(self, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in a text the strings stand, and which."""
        text = padded(form, self.longest)
        here, own = eights(text), eights(self.text)
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for table in self.tables:
            a, k = table.candidates(here, len(form))
            done = 0
            while len(a):
                rest = self.length[k] - done
                over = rest <= 8
                mask = np.where(over, ~np.uint64(0) >> (8 * (8 - np.clip(rest, 1, 8))).astype(np.uint64), ~np.uint64(0))
                same = (here[a + done] & mask) == (own[self.start[k] + done] & mask)
                at.append(a[same & over] - PAD)
                which.append(k[same & over])
                a, k = a[same & ~over], k[same & ~over]
                done += 8
        return np.concatenate(at), np.concatenate(which)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [begin, end) of one row of words, those that overlap or touch joined."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(end) else end


SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
FOUND = "n_words long, spans array<struct<start:long,length:long>>, items array<string>"


def searched(column: pa.Array, windows: Windows) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, spans and items of each text of a column."""
    form, marks, starts = normal_form(column)
    first = np.append(np.searchsorted(starts, marks), len(starts))
    at, which = windows.occurrences(form)
    word = np.searchsorted(starts, at + 1)
    of = np.searchsorted(first[1:], word, "right")
    # one place is left between documents, so that stretches of two never touch
    begin, end = merged(word + of, word + of + windows.count[which])
    doc = np.searchsorted(first[1:] + np.arange(1, len(first)), begin, "right")
    spans = pa.StructArray.from_arrays([pa.array(begin - first[doc] - doc), pa.array(end - begin)], fields=list(SPAN))
    numbers = np.arange(len(column) + 1)
    span_lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, numbers), pa.int32()), spans)
    pairs = np.unique(np.stack([of, which], 1), axis=0)
    many = windows.owner_at[pairs[:, 1] + 1] - windows.owner_at[pairs[:, 1]]
    owner = windows.owner[np.repeat(windows.owner_at[pairs[:, 1]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    owned = np.unique(np.stack([np.repeat(pairs[:, 0], many), owner], 1), axis=0)
    names = pa.array(windows.items, pa.string()).take(pa.array(owned[:, 1]))
    return pa.array(np.diff(first)), span_lists, pa.ListArray.from_arrays(pa.array(np.searchsorted(owned[:, 0], numbers), pa.int32()), names)


def item_parts(benchmark: DataFrame, text: str, item: str, size: int, most: int) -> DataFrame:
    """item and text of all items, long texts in parts of about `most` bytes that share size - 1 words, so that no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[tuple[str, bytes]] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(t) <= most:
                    out.append((i, t))
                    continue
                form, _, starts = normal_form(pa.array([t], pa.binary()))
                whole, at = form.tobytes(), 0
                while at < len(starts):
                    z = max(int(np.searchsorted(starts, starts[at] + most)), at + size)
                    if len(starts) - z < size:
                        z = len(starts)
                    out.append((i, whole[starts[at] : starts[z] if z < len(starts) else len(whole)]))
                    at = z - size + 1 if z < len(starts) else z
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["item", "t"])

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("binary").alias("t"))
    return rows.where(F.octet_length("t") > 0).mapInArrow(run, "item string, t binary")


def blocks(benchmark: DataFrame, text: str, item: str, size: int, most: int) -> Iterator[Windows]:
    """The items' windows in blocks of about `most` bytes of text; one at least. The driver holds one block at a time."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = item_parts(benchmark, text, item, size, most // 4)
    if total > most:
        parts = parts.repartition(int(2 * total // most) + 1)
    held, n = [], 0
    given = False
    for r in parts.toLocalIterator():
        if n + len(r.t) > most and held:
            yield Windows(held, size)
            held, n, given = [], 0, True
        held.append((r.item, bytes(r.t)))
        n += len(r.t)
    if held or not given:
        yield Windows(held, size)


def contaminated_words(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id", size: int = 10, most: int = 4_000_000) -> DataFrame:
    """`key`, n_words, spans (stretches of hit words: start, length) and items (ids as strings, sorted), one row for each row of df.

    Words are digits, letters and all characters outside ASCII, A to Z lower-cased. A window is `size` consecutive words of an item, or
    all of a shorter one; a word inside any occurrence of a window is hit, and items are those with one. Null texts have
    no words and no windows; rows of the benchmark that share an id are one item, and a null id reads as ''. Repeated rows of df
    and other columns don't matter; a long text is one row's work; an empty table gives no rows, an empty benchmark no hits.
    The benchmark is searched in blocks of about `most` bytes. More than one costs a pass over df's texts each.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()

    def passed(rows: DataFrame, windows: Windows, form: str) -> DataFrame:
        sent = spark.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), *searched(batch.column(1), sent.value)], names=["k", "n_words", "spans", "items"])

        return rows.mapInArrow(run, f"k {form}, {FOUND}")

    texts = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")
    several = blocks(benchmark, item_text, item, size, most)
    block, after = next(several), next(several, None)
    if after is None:
        return passed(df.select(F.col(key).alias("k"), texts), block, kind).withColumnRenamed("k", key)

    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), texts), "decontaminate-rows")
    parts = []
    while block is not None:
        parts.append(written(passed(rows.select("row", "t"), block, "long").where("size(spans) > 0"), "decontaminate-found"))
        block, after = after, next(several, None)
    lists = reduce(DataFrame.unionByName, parts).groupBy(F.col("k").alias("row")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            form, marks, starts = normal_form(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(np.append(np.searchsorted(starts, marks), len(starts))))], names=["row", "k", "n_words"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                a = np.array([s["start"] for s in spans or ()], np.int64)
                a, z = merged(a, a + np.array([s["length"] for s in spans or ()], np.int64))
                out.append([{"start": x, "length": y - x} for x, y in zip(a.tolist(), z.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(SPAN)), batch.column(3)], names=["k", "n_words", "spans", "items"])

    every = rows.mapInArrow(count, f"row long, k {kind}, n_words long").join(lists, "row", "left")
    out = every.select("k", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.mapInArrow(join, f"k {kind}, {FOUND}").withColumnRenamed("k", key)


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH form AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + 9], ' '))) AS win FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
spots AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS win FROM form, sizes WHERE len(w) >= k),
found AS (SELECT doc_id, item_id, i, k FROM spots JOIN windows USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM form LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
