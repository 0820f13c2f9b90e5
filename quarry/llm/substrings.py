"""Removal of repeated substrings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `length` bytes around it also starts earlier in the corpus.

1. Cover sample. Positions whose residue mod 73 lies in a difference cover are sampled: for any two positions there is a
   shift below 73 that takes both to sampled ones. So two equal strings share a sampled suffix, at the same shift, and
   agree in the bytes before it. A sieve by hashes of 28 bytes finds the samples that can tie with another one at all.
2. Suffix buckets. The suffixes of tied samples are dealt into buckets of the suffix order, by splitters sampled from
   the texts, and each bucket is sorted by itself, by the next `length` bytes. Neighbours' common prefixes settle the long ties
   within the bucket: two strings with the shift d are equal if their samples agree in length - d bytes and the d bytes
   before the samples are the same. As strings have `length` bytes, no ranks of samples in the whole corpus are stored for it.
3. Hot suffixes. A bucket must hold all suffixes that tie at 28 bytes. Where the sieve counts more than `most` of them,
   their strings are grouped by Spark instead, each by its own bytes, combined before they are shuffled.

All decisions are on bytes; hashes only leave out what can't tie. Blocks of texts are written once, answers come to them
by joins, and equal suffixes of a block are one entry, so the copies of a string cost a bucket at most one entry a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import LEAST_ID, batch_of, by_bucket, shuffle_partitions, spread_ascending, spread_out, squeezed, squeezed_ascending, text_blocks, written

#: A perfect difference set mod 73: the powers of two.
PERIOD, COVER = 73, np.array(sorted(pow(2, k, 73) for k in range(9)))
#: Bytes that a sample must share to be tied, and bytes before a sample that a string can have.
SAMPLE, LEFT = 28, PERIOD - 1
#: Ties of at most so many different suffixes are compared pair by pair.
FEW = 24
CHUNK = 1 << 20
#: Samples of a block whose suffixes are sorted and combined together before they are sent, and entries of a suffix bucket.
PART, BUCKET = 100_000, 100_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * M1
    h ^= h >> np.uint64(29)
    h += b
    h *= M2
    h ^= h >> np.uint64(32)
    return h


class Block:
    """Concatenated texts and what the sieve says about their samples."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, payload: bytes, length: int, n_buckets: int):
        raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=int(sizes.sum()) + 1) if len(payload) else b""
        self.n, self.length, self.n_buckets, self.ids = len(raw), length, n_buckets, ids
        self.padded = np.concatenate([np.zeros(LEFT, np.uint8), np.frombuffer(raw, np.uint8), np.zeros(length + 64, np.uint8)])
        self.bytes = self.padded[LEFT:]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def samples(self) -> np.ndarray:
        """Sampled positions that some whole string of their text takes in."""
        at = (np.arange(self.n // PERIOD + 1)[:, None] * PERIOD + COVER).ravel()
        at = at[at < self.n]
        doc = self.doc_of(at)
        return at[(at + SAMPLE <= self.ends[doc]) & ((self.ends - self.starts)[doc] >= self.length)]

    def sample_names(self, at: np.ndarray) -> np.ndarray:
        words = np.lib.stride_tricks.as_strided(self.bytes, (self.n + self.length + 56, 8), (1, 1))
        word = lambda p: np.ascontiguousarray(words[p]).view("<u8").ravel()
        out = np.empty(len(at), np.uint64)
        for k in range(0, len(at), CHUNK):
            p = at[k : k + CHUNK]
            out[k : k + CHUNK] = mix(mix(word(p), word(p + 8)), mix(word(p + 12), word(p + 20)))
        return out

    def sieve_entries(self) -> Iterator[tuple[int, bytes, bytes]]:
        """For each bucket of hashes the hashes of this block's samples (32 bits) and how often they stand in it."""
        if self.n < self.length:
            return
        names = self.sample_names(self.samples())
        sent, counts, bucket, _, _ = self.sieve_order(names)
        cuts = np.searchsorted(bucket, np.arange(self.n_buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            yield int(k), squeezed_ascending(names[sent[part]] & np.uint64(0xFFFFFFFF)), squeezed(counts[part].astype("<u4"))

    def sieve_order(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries in the order in which they are sent, their counts and buckets; repeats, and which entry they repeat."""
        again, first = repeats(names)
        counts = np.bincount(first[again], minlength=len(names)) + 1
        sent = np.flatnonzero(~again)
        bucket = ((names[sent] >> np.uint64(40)) % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket << 32 | (names[sent] & np.uint64(0xFFFFFFFF)).astype(np.int64), kind="stable")
        sent = sent[order]
        return sent, counts[sent], bucket[order], again, first

    def tied(self, tied: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tied samples that are settled in suffix buckets, and hot ones; from the sieve's answers in the order of the entries."""
        at = self.samples()
        if not len(at):
            return at, at
        sent, counts, _, again, first = self.sieve_order(self.sample_names(at))
        is_tied, is_hot = np.zeros(len(at), bool), np.zeros(len(at), bool)
        is_tied[sent], is_hot[sent] = tied | (counts > 1), hot
        is_tied[again], is_hot[again] = True, is_hot[first[again]]
        before, behind = self.room(at)
        fit = before + behind >= self.length
        return at[is_tied & ~is_hot & fit], at[is_tied & is_hot & fit]

    def room(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the text before (LEFT at most) and from each position (`length` at most)."""
        doc = self.doc_of(at)
        return np.minimum(at - self.starts[doc], LEFT), np.minimum(self.ends[doc] - at, self.length)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Sort keys, one a row: the suffix (`length` bytes), the LEFT bytes before it read backwards, and how many of both the text has."""
        n = self.length
        rows = np.lib.stride_tricks.sliding_window_view(self.padded, LEFT + n)[at]
        out = np.empty((len(at), n + LEFT + 4), np.uint8)
        out[:, :n], out[:, n : n + LEFT] = rows[:, LEFT:], rows[:, LEFT - 1 :: -1]
        before, behind = self.room(at)
        cut = np.flatnonzero(behind < n)
        out[cut, :n] *= np.arange(n)[None, :] < behind[cut, None]
        cut = np.flatnonzero(before < LEFT)
        out[cut, n : n + LEFT] *= np.arange(LEFT)[None, :] < before[cut, None]
        out[:, n + LEFT :] = (behind << 8 | before).astype(">u4").view(np.uint8).reshape(-1, 4)
        return out

    def suffix_entries(self, at: np.ndarray, splitters: np.ndarray) -> Iterator[tuple]:
        """Sorted entries of each suffix bucket (bucket, keys, places, ids), and the places of repeats among these samples (bucket -1)."""
        keys = self.keys(at)
        order = np.argsort(as_strings(keys), kind="stable")
        keys = keys[order]
        head = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        if not head.all():
            yield -1, b"", squeezed(np.sort(at[order[~head]]).astype("<u4")), b""
        keys, at = keys[head], at[order[head]]
        cuts = np.searchsorted(as_strings(np.ascontiguousarray(keys[:, :SAMPLE])), splitters, "left")
        cuts = np.concatenate([[0], cuts, [len(at)]])
        ids = self.ids[self.doc_of(at)]
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            yield int(k), squeezed(text_order(keys[part], self.length), 3), squeezed(at[part].astype("<u4")), squeezed(ids[part].astype("<i8"))

    def hot_strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the strings around hot samples: those whose bytes stand in the block for the first time, and repeats."""
        before, behind = self.room(at)
        low, high = at - np.minimum(before, LEFT), at - np.maximum(self.length - behind, 0) + 1
        starts = np.flatnonzero(spread(low, high, self.n))
        order = np.argsort(as_strings(self.strings(starts)), kind="stable")
        rows = self.strings(starts[order])
        head = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        return starts[order[head]], starts[order[~head]]

    def strings(self, starts: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.bytes, self.length)[starts]

    def removed(self, answers: list[dict]) -> np.ndarray:
        """Mask of removed bytes. answers: places with masks of shifts, or without (repeats in the block: all shifts), or strings' starts."""
        known = np.zeros(self.n, bool)
        for a in answers:
            at = spread_out(a["places"], "<u4").astype(np.int64)
            if a["kind"] == "starts":
                known[at] = True
                continue
            masks = np.unpackbits(spread_out(a["masks"], np.uint8).reshape(len(at), -1), axis=1)[:, :PERIOD] if a["kind"] == "masks" else None
            for shift in range(PERIOD):
                hit = at - shift if masks is None else at[masks[:, shift] > 0] - shift
                known[hit[hit >= 0]] = True
        whole = spread(self.starts, np.maximum(self.ends - self.length + 1, self.starts), self.n)
        at = np.flatnonzero(known & whole)
        return spread(at, at + self.length, self.n)


def text_order(keys: np.ndarray, length: int) -> np.ndarray:
    """Keys with the bytes before the suffix read forwards, which compresses better, or backwards again."""
    out = keys.copy()
    out[:, length : length + LEFT] = keys[:, length : length + LEFT][:, ::-1]
    return out


def as_strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-length strings, which NumPy orders by bytes."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def spread(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Mask of positions in any of the intervals [low, high)."""
    edge = np.bincount(low, minlength=n + 1)[: n + 1].astype(np.int32) - np.bincount(np.minimum(high, n), minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def repeats(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose name stood before, and where; two names that share a slot may hide a repeat, which costs an entry only."""
    n = len(names)
    size = 1 << max(8, math.ceil(math.log2(n + 1)) + 1)
    slot = (names & np.uint64(size - 1)).astype(np.int64)
    table = np.zeros(size, np.int64)
    table[slot[::-1]] = np.arange(n)[::-1]
    first = table[slot]
    return (names[first] == names) & (first != np.arange(n)), first


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def settled(keys: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """One suffix bucket: for each entry the shifts at which its string also starts earlier, as rows of PERIOD flags.

    keys: see Block.keys. rank: the entries' order in the corpus. Shifts that leave the entry's text may be flagged too.
    """
    order = np.argsort(as_strings(keys), kind="stable")
    ranked, rank_of = keys[order], rank[order]
    same = np.concatenate([[False], (ranked[1:] == ranked[:-1]).all(axis=1)])
    heads = np.flatnonzero(~same)
    run = np.cumsum(~same) - 1
    # of equal entries all but the first in the corpus are settled; the first one stands for them from here on
    first = np.minimum.reduceat(rank_of, heads)
    flags = np.ones((len(keys), PERIOD), bool)
    chosen = np.flatnonzero(rank_of == first[run])
    row = ranked[heads]
    extent = row[:, length + LEFT :].copy().view(">u4").ravel().astype(np.int64)
    before, behind = extent & 0xFF, extent >> 8
    depth = np.empty(len(row), np.int64)
    for a in range(0, len(row) - 1, 1 << 16):
        z = min(a + (1 << 16), len(row) - 1)
        depth[a:z] = common(row[a:z, :length], row[a + 1 : z + 1, :length])
    depth[len(row) - 1 :] = 0
    group = np.cumsum(np.concatenate([[0], depth[:-1] < SAMPLE]))
    starts = np.flatnonzero(np.concatenate([[True], depth[:-1] < SAMPLE]))
    sizes = np.diff(np.append(starts, len(row)))
    own = np.zeros((len(row), PERIOD), bool)
    step = np.zeros((len(row), PERIOD + 1), np.int16)
    at = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= FEW))
    least, d = np.full(len(row), length), 1
    while len(at):
        at = at[at + d < len(row)]
        at = at[group[at + d] == group[at]]
        least[at] = np.minimum(least[at], depth[at + d - 1])
        right = np.minimum(least[at], np.minimum(behind[at], behind[at + d]))
        ok = length - right <= np.minimum(np.minimum(before[at], before[at + d]), LEFT)
        i, low = at[ok], np.maximum(length - right[ok], 0)
        left = np.minimum(common(row[i, length : length + LEFT], row[i + d, length : length + LEFT]), np.minimum(before[i], before[i + d]))
        i, low, left = i[left >= low], low[left >= low], left[left >= low]
        later = np.where(first[i] > first[i + d], i, i + d)
        np.add.at(step, (later, low), 1)
        np.add.at(step, (later, left + 1), -1)
        d += 1
    np.greater(np.cumsum(step[:, :PERIOD], axis=1, dtype=np.int16), 0, out=own)
    for s, k in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        part = row[s : s + k]
        for shift in range(PERIOD):
            fit = np.flatnonzero((before[s : s + k] >= shift) & (behind[s : s + k] >= length - shift))
            if len(fit) < 2:
                continue
            text = as_strings(np.concatenate([part[fit, : length - shift], part[fit, length : length + shift]], axis=1))
            by = np.lexsort((first[s + fit], text))
            own[s + fit[by[1:]], shift] = text[by[1:]] == text[by[:-1]]
    flags[order[chosen]] = own[run[chosen]]
    return flags


def opened(batches: Iterator[pa.RecordBatch], length: int, n_buckets: int) -> Iterator[tuple[int, Block, list[dict]]]:
    """Blocks of rows (block, ids, sizes, payload and, if there, answers), one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in (1, 2))
            answers = batch.column(4)[k].as_py() if batch.num_columns > 4 else None
            yield batch.column(0)[k].as_py(), Block(ids, sizes.astype(np.int64), batch.column(3)[k].as_py(), length, n_buckets), answers or []


def splitters_of(table: DataFrame, length: int, n_buckets: int, most: int = 64) -> np.ndarray:
    """Splitters of the suffix order: quantiles of suffixes from about `most` blocks. They bear on the buckets' balance only."""
    k = max(1, table.count() // most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b, _ in opened(batches, length, n_buckets):
            at = np.random.default_rng(number).integers(0, max(1, b.n), 64 * (1 + n_buckets // most))
            rows = np.lib.stride_tricks.sliding_window_view(b.bytes, SAMPLE)[at]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["s"])

    rows = table.where(F.pmod(F.xxhash64("block"), F.lit(k)) == 0).mapInArrow(run, "s binary").collect()
    found = np.sort(np.array([bytes(r.s).ljust(SAMPLE, b"\0") for r in rows], dtype=f"S{SAMPLE}"))
    return np.unique(found[np.linspace(0, len(found) - 1, n_buckets + 1).astype(int)[1:-1]]) if len(found) else found


def repeated_spans(df: DataFrame, length: int = 100, text: str = "text", key: str = "doc_id", block_bytes: int | None = None, most: int = 200_000) -> DataFrame:
    """key, n_bytes, spans (array of start, end: maximal removed runs, in bytes) and kept (binary) of every whole text.

    A byte is removed if a string of `length` (>= 100) bytes that covers it also starts earlier: in a row with a smaller key, or in
    the same row before. Strings never cross texts and are judged on the input. A null text counts as empty; shorter texts
    lose nothing. Null keys come before all others. Rows with equal keys are ordered by their place in the input, so copies
    under one key are removed too. Extra columns are left out; an empty table gives no rows. A text is one block's at least,
    so it must fit a task. most: tied suffixes from which a tie counts as hot (see the module); the result is the same.
    """
    if length < LEFT + SAMPLE:
        raise ValueError(f"length must be at least {LEFT + SAMPLE}")
    total = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    block_bytes = block_bytes or int(4e6 * min(4.0, max(1.0, math.sqrt(total / 1e9))))
    n_buckets = int(max(128, total / 8e6))
    n_parts = max(shuffle_partitions(df), int(total / 16e6) + 1)
    table = written(text_blocks(df, text, key, block_bytes), "blocks")

    def with_answers(answers: DataFrame) -> DataFrame:
        of_block = answers.repartition(n_parts, "block").groupBy("block").agg(F.collect_list(F.struct(*[c for c in answers.columns if c != "block"])).alias("answers"))
        return table.join(of_block.hint("shuffle_hash"), "block", "left").select("block", "ids", "sizes", "payload", "answers")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, _ in opened(batches, length, n_buckets):
            if rows := [(k, block, names, counts) for k, names, counts in b.sieve_entries()]:
                yield batch_of(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["bucket", "block", "names", "counts"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bucket(batches):
            names = [spread_ascending(b) for b in part.column(2).to_pylist()]
            name, cuts = np.concatenate(names), np.cumsum([len(x) for x in names])[:-1]
            order = np.argsort(name, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) != 0]))
            counts = np.concatenate([spread_out(b, "<u4") for b in part.column(3).to_pylist()]).astype(np.int64)
            entries, sums = np.diff(np.append(heads, len(name))), np.add.reduceat(counts[order], heads)
            flags = np.zeros((2, len(name)), bool)
            flags[0, order] = np.repeat(entries > 1, entries)
            flags[1, order] = np.repeat(sums > most, entries)
            bucket = part.column(0)[0].as_py()
            rows = [(block, bucket, f.shape[1], int(f[0].sum()), int(f[1].sum()), np.packbits(f[0]).tobytes(), squeezed(np.packbits(f[1]))) for block, f in zip(part.column(1).to_pylist(), np.split(flags, cuts, axis=1), strict=True)]
            yield batch_of(rows, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["block", "bucket", "n", "n_tied", "n_hot", "tied", "hot"])

    def tied_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, np.ndarray, np.ndarray]]:
        for block, b, answers in opened(batches, length, n_buckets):
            answers.sort(key=lambda a: a["bucket"])
            bits = [[np.unpackbits(np.frombuffer(a["tied"], np.uint8) if k == 0 else spread_out(a["hot"], np.uint8), count=a["n"]) for a in answers] for k in (0, 1)]
            yield block, b, *b.tied(*(np.concatenate([np.empty(0, np.uint8), *x]).astype(bool) for x in bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, at, _ in tied_of(batches):
            for k in range(0, len(at), PART):
                rows = [(n if n >= 0 else block % n_suffix_buckets, block, *entry) for n, *entry in b.suffix_entries(at[k : k + PART], splitters)]
                yield batch_of(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "block", "keys", "places", "ids"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.string(), pa.binary(), pa.binary()], ["block", "kind", "places", "masks"]
        for part in by_bucket(batches):
            again = [(r["block"], "all", r["places"], None) for r in part.to_pylist() if not r["keys"]]
            if again:
                yield batch_of(again, kinds, names)
            rows = [r for r in part.to_pylist() if r["keys"]]
            if not rows:
                continue
            places, ids = [spread_out(r["places"], "<u4") for r in rows], np.concatenate([spread_out(r["ids"], "<i8") for r in rows])
            cuts, block = np.cumsum([len(p) for p in places])[:-1], np.repeat([r["block"] for r in rows], [len(p) for p in places])
            keys = text_order(np.concatenate([spread_out(r.pop("keys"), np.uint8) for r in rows]).reshape(len(ids), -1), length)
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((np.concatenate(places), block, ids))] = np.arange(len(ids))
            bits = np.packbits(settled(keys, rank, length), axis=1)
            yield batch_of([(r["block"], "masks", r["places"], squeezed(m)) for r, m in zip(rows, np.split(bits, cuts), strict=True)], kinds, names)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["block", "id", "place", "string"]
        for block, b, _, at in tied_of(batches):
            once, again = b.hot_strings(at) if len(at) else (at, at)
            for starts, whole in ((once, True), (again, False)):
                for k in range(0, len(starts), 10_000):
                    p = starts[k : k + 10_000]
                    strings = [r.tobytes() for r in b.strings(p)] if whole else [None] * len(p)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([block] * len(p), b.ids[b.doc_of(p)], p, strings), kinds, strict=True)], names=names)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(block.as_py(), "starts", squeezed(p.values.to_numpy(zero_copy_only=False).astype("<u4")), None) for block, p in zip(batch.column(0), batch.column(1), strict=True)]
            yield batch_of(rows, [pa.int64(), pa.string(), pa.binary(), pa.binary()], ["block", "kind", "places", "masks"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()], ["k", "n_bytes", "spans", "kept"]
        for _, b, answers in opened(batches, length, n_buckets):
            gone = b.removed(answers)
            rows, held = [], 0
            for i, s, e in zip(b.ids.tolist(), b.starts.tolist(), b.ends.tolist(), strict=True):
                own = gone[s:e]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                rows.append((None if i == LEAST_ID else i, e - s, spans, b.bytes[s:e][~own].tobytes()))
                held += e - s
                if held >= 1_000_000 or len(rows) >= 1000:
                    yield batch_of(rows, kinds, names)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, kinds, names)

    dealt = table.mapInArrow(sieve, "bucket int, block long, names binary, counts binary").repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "block")
    known = written(dealt.mapInArrow(shared, "block long, bucket int, n int, n_tied int, n_hot int, tied binary, hot binary"), "sieve")
    n_tied, n_hot = known.agg(F.coalesce(F.sum("n_tied"), F.lit(0)), F.coalesce(F.sum("n_hot"), F.lit(0))).first()
    n_suffix_buckets = max(shuffle_partitions(df), int(n_tied) // BUCKET + 1)
    splitters = splitters_of(table, length, n_suffix_buckets)
    sieved = with_answers(known.drop("n_tied", "n_hot"))
    sent = sieved.mapInArrow(send, "bucket int, block long, keys binary, places binary, ids binary").repartition(n_suffix_buckets, "bucket").sortWithinPartitions("bucket", "block")
    answers = written(sent.mapInArrow(settle, "block long, kind string, places binary, masks binary"), "suffixes")
    if n_hot:
        hot = written(sieved.mapInArrow(explode, "block long, id long, place int, string binary"), "hot-strings")
        firsts = hot.where("string is not null").groupBy("string").agg(F.min(F.struct("id", "block", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = hot.join(firsts, "string").where(F.struct("id", "block", "place") != F.col("first")).unionByName(hot.where("string is null"), allowMissingColumns=True)
        starts = later.groupBy("block").agg(F.collect_list("place").alias("p"))
        answers = answers.unionByName(written(starts.mapInArrow(listed, "block long, kind string, places binary, masks binary"), "hot-starts"))
    return with_answers(answers).mapInArrow(finish, "k long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary").withColumnRenamed("k", key)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes over all documents; counts and digest derived from the operator's spans and kept bytes."""
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
