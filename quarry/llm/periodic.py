"""Stretches of a text that repeat a few words again and again.

Words outside the k-grams that a document repeats cannot belong to such a run, as every word of a run lies in a k-gram
that stands again one period on or back. What is left is short, and only there Main and Lorentz's division runs: each
stretch is cut in the middle, the runs across the cut are found for all periods at once by how far the words agree
forwards and backwards, and the halves follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import slices

WORD = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_size(times: int, least: int) -> int:
    """The largest k for which each word of a run lies in a k-gram that the run repeats: a run of n words and period q has n - 2q + 1 at least."""
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))


def repeated(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that stands twice in its document. Equal hashes of unequal k-grams only keep words that could go."""
    m = len(words) - k + 1
    held = np.zeros(len(words), bool)
    if m < 2:
        return held
    h = doc[:m].astype(np.uint64) * MIX
    for j in range(k):
        h = (h ^ (h >> np.uint64(29)) ^ words[j : j + m].astype(np.uint64)) * MIX
    whole = doc[:m] == doc[k - 1 :]
    order = np.sort(h[whole])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return held
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    steps = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(whole & (twice[at] == h))
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps[:-1]) > 0


class Ranks:
    """Names of all stretches of 2^t words: equal names for equal words, negative ones for stretches that stand once."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.levels: list[np.ndarray] = []
        key, at = words.astype(np.int64), np.arange(self.n)
        while len(at):
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            level = -1 - np.arange(self.n, dtype=np.int32)
            level[at[again]] = inverse[again]
            at = at[again]
            if not len(at):
                break
            step = 1 << len(self.levels)
            self.levels.append(level)
            at = at[at + step < self.n]
            at = at[level[at + step] >= 0]
            key = level[at].astype(np.int64) << 32 | level[at + step]

    def named_alike(self, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the 2^t words from a and from b are the same (False where they begin before the first word)."""
        out = np.zeros(len(a), bool)
        for k in np.unique(t):
            if k < len(self.levels):
                i = np.flatnonzero((t == k) & (a >= 0) & (b >= 0))
                out[i] = self.levels[k][a[i]] == self.levels[k][b[i]]
        return out

    def forwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on agree."""
        got = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            level, x, y = self.levels[k], a + got, b + got
            inside = (x < self.n) & (y < self.n)
            got += (inside & (level[x * inside] == level[y * inside])).astype(np.int64) << k
        return got

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to a and up to b agree."""
        got = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            level, x, y = self.levels[k], a - got - (1 << k) + 1, b - got - (1 << k) + 1
            inside = (x >= 0) & (y >= 0)
            got += (inside & (level[x * inside] == level[y * inside])).astype(np.int64) << k
        return got


def main_lorentz(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, times: int, least: int) -> np.ndarray:
    """Rows of start, end and smallest period of all runs in the stretches [lo, hi) of words, which a word of its own ends each."""
    ranks, found = Ranks(words), [np.zeros((0, 3), np.int64)]
    while True:
        long = hi - lo >= least
        lo, hi = lo[long], hi[long]
        if not len(lo):
            break
        mid, periods = (lo + hi) // 2, (hi - lo) // times
        before = np.cumsum(periods) - periods
        cut, q = np.repeat(mid, periods), np.arange(periods.sum()) - np.repeat(before, periods) + 1
        # on one side of the cut a run has two periods at least, so there 2^t <= q words agree with those one period on
        t = np.log2(q + 0.5).astype(np.int64)
        for right in (True, False):
            probe = cut if right else cut - (1 << t)
            on = ranks.named_alike(t, probe, probe + (q if right else -q))
            c, p = cut[on], q[on]
            near, far = (c, c + p) if right else (c - p, c)
            rows = np.stack([near - ranks.backwards(near - 1, far - 1), far + ranks.forwards(near, far), p], 1)
            found.append(np.unique(rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, times * p)], axis=0))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    rows = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(rows), bool)  # of one stretch's periods the smallest
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def runs_of(words: np.ndarray, doc: np.ndarray, times: int = 4, least: int = 6) -> np.ndarray:
    """Rows of start, length and period of all runs of numbered words, sorted by start and period; none crosses documents."""
    left = repeated(words, doc, gram_size(times, least))
    edge = np.flatnonzero(np.diff(left, prepend=False, append=False) | np.concatenate([[False], doc[1:] != doc[:-1], [False]])) if len(words) else np.zeros(0, np.int64)
    edge = np.concatenate([edge, [len(words)]])
    a, z = edge[:-1], edge[1:]
    whole = (z - a >= least) & left[np.minimum(a, len(words) - 1)] if len(words) else np.zeros(0, bool)
    a, z = a[whole], z[whole]
    if not len(a):
        return np.zeros((0, 3), np.int64)
    size = z - a
    hi = np.cumsum(size + 1) - 1
    lo = hi - size
    packed = -1 - np.arange(hi[-1] + 1, dtype=np.int64)
    shift = np.repeat(a - lo, size)
    inside = np.concatenate([np.arange(x, y) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
    packed[inside] = words[inside + shift]
    rows = main_lorentz(packed, lo, hi, times, least)
    starts = rows[:, 0] + (a - lo)[np.searchsorted(lo, rows[:, 0], "right") - 1]
    rows = np.stack([starts, rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(df: DataFrame, text: str = "text", key: str = "doc_id", times: int = 4, least: int = 6) -> DataFrame:
    """`key`, n_words, runs (array of start, length, period; by start, then period) and collapsed, one row for each row of df.

    Words are what ASCII white space parts. A run repeats its first `period` words, at least `times` (4 or more) periods and
    `least` words long, and no word beside it goes on in that period. collapsed has the words that no run repeats, joined
    by one space. Null and empty texts have no words. Each row is scanned by itself, so repeated rows, ties, null keys and
    other columns (left out) don't matter; a long text is one row's work, n log n in its repeated words.
    """
    if times < 4 or least < 2:
        raise ValueError("runs need four periods and two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            split = [t.split() for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in split], np.int64)
            flat = [w for s in split for w in s]
            words = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(split)), sizes)
            rows = runs_of(words, doc, times, least)
            of = doc[rows[:, 0]]
            steps = np.zeros(len(flat) + 1, np.int64)
            np.add.at(steps, rows[:, 0] + rows[:, 2], 1)
            np.add.at(steps, rows[:, 0] + rows[:, 1], -1)
            gone = np.cumsum(steps[:-1]) > 0
            bounds = np.searchsorted(of, np.arange(len(split) + 1))
            touched = set(of.tolist())
            kept = []
            for i, s in enumerate(split):
                if i in touched:
                    a = int(ends[i] - sizes[i])
                    s = [s[j] for j in np.flatnonzero(~gone[a : a + len(s)]).tolist()]
                kept.append(b" ".join(s))
            starts = rows[:, 0] - (ends - sizes)[of]
            items = pa.StructArray.from_arrays([pa.array(starts), pa.array(rows[:, 1]), pa.array(rows[:, 2])], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, pa.array(kept, pa.binary())], names=["k", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    out = rows.mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.select(F.col("k").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def looped(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with the words of a tenth of its texts, by the key's checksum, going round from some word on; a null key reads as ''."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    div = lambda x, y: F.call_function("div", x, y)
    g, n = div(F.col("_h"), F.lit(10)), F.size("_words").cast("long")
    a = g % n
    p = div(n - a, 3 + g % 8) + 1
    at = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", at(i).cast("int"))), " ")
    rows = df.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    rows = rows.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, a)).withColumn("_p", F.when(F.col("_n") > 0, p))
    return rows.withColumn(text, F.when(F.col("_n") > 0, again).otherwise(F.col(text))).select(*df.columns)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them looped; digests and the greatest run derived from the operator's runs."""
    found = periodic_runs(looped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    more = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"]) | a["period"].isNull()
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", nothing, lambda a, r: F.when(more(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
