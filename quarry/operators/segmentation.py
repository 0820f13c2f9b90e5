"""Words of scripts that leave no blanks: a unigram word model fitted by expectation maximisation, and the likeliest cut.

A run of characters is a lattice whose edges are the pieces of up to LONGEST characters that the model knows. Fitting counts, in each
round, how often a piece is expected on the paths of all runs (forward and backward sums); cutting takes the best path.
Tasks work on all runs of a batch side by side, in steps of one character. Only the model is sent to them, and its size is bounded.
Expected counts are whole millionths, so their sums depend on no order and a fit gives the same model on any partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from quarry.functions import text as T
from quarry.sources import files

#: Runs of Chinese characters; characters of a piece (four of 16 bits make its key); the parts that expected counts are made of.
CJK, LONGEST, UNIT = "[\\u4e00-\\u9fff]+", 4, 1_000_000
#: Characters that are worked on together, and what an unknown character is less likely than the rarest known piece.
CHUNK, UNKNOWN = 1 << 18, 10.0


@dataclass
class Words:
    """keys: sorted keys of the pieces; expected: their counts in millionths; log_p: their logarithmic probabilities."""

    keys: np.ndarray
    expected: np.ndarray
    log_p: np.ndarray

    @property
    def floor(self) -> float:
        return float(self.log_p.min() if len(self.log_p) else 0.0) - UNKNOWN

    def rows(self) -> list[tuple[str, int, float]]:
        return [(spelled(k), int(n), float(p)) for k, n, p in zip(self.keys.tolist(), self.expected, self.log_p, strict=True)]


def spelled(key: int) -> str:
    return key.to_bytes(2 * LONGEST, "big").decode("utf-16-be", "surrogatepass").lstrip("\0")


def shares(keys: np.ndarray, expected: np.ndarray) -> Words:
    """Pieces that are expected at least once, and all single characters (these at least a millionth)."""
    on = (expected >= UNIT) | (keys < 1 << 16)
    keys, expected = keys[on], np.maximum(expected[on], 1)
    return Words(keys, expected, np.log(expected / max(1, int(expected.sum()))))


class Lattice:
    """Runs laid behind each other, LONGEST slots of padding before each; pieces[i, k]: the piece of k + 1 characters from i."""

    def __init__(self, runs: list[str], words: Words):
        codes = [np.frombuffer(r.encode("utf-16-le", "surrogatepass"), "<u2") for r in runs]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.first = np.cumsum(self.sizes + LONGEST) - self.sizes
        self.n = int((self.sizes + LONGEST).sum()) + LONGEST + 1
        flat, inside = np.zeros(self.n, np.uint64), np.zeros(self.n, bool)
        for f, c in zip(self.first.tolist(), codes, strict=True):
            flat[f : f + len(c)], inside[f : f + len(c)] = c, True
        self.keys = np.zeros((self.n, LONGEST), np.uint64)
        fits = np.zeros((self.n, LONGEST), bool)
        key, fit = np.zeros(self.n, np.uint64), np.ones(self.n, bool)
        for k in range(LONGEST):
            key[: self.n - k] = key[: self.n - k] << np.uint64(16) | flat[k:]
            fit[: self.n - k] &= inside[k:]
            fit[self.n - k :] = False
            self.keys[:, k], fits[:, k] = key, fit
        self.at = np.minimum(np.searchsorted(words.keys, self.keys), max(0, len(words.keys) - 1))
        self.known = fits & (words.keys[self.at] == self.keys) if len(words.keys) else np.zeros_like(fits)
        self.score = np.where(self.known, words.log_p[self.at] if len(words.keys) else 0.0, -np.inf)
        self.score[:, 0] = np.where(self.known[:, 0], self.score[:, 0], np.where(inside, words.floor, -np.inf))
        self.order = np.argsort(-self.sizes, kind="stable")
        self.longest = int(self.sizes.max(initial=0))
        self.alive = np.searchsorted(-self.sizes[self.order], -np.arange(1, self.longest + 1), "right")

    def ways(self, to: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Scores of the ways to each slot over its last piece, one column for each length."""
        back = np.arange(1, LONGEST + 1)
        return before[to[:, None] - back] + self.score[to[:, None] - back, back - 1]

    def expected(self, weights: np.ndarray, n: int) -> np.ndarray:
        """Expected counts of n pieces in millionths, over runs that stand `weights` times each."""
        ahead, behind = np.full(self.n, -np.inf), np.full(self.n, -np.inf)
        ends = self.first + self.sizes
        ahead[self.first], behind[ends] = 0.0, 0.0
        on = np.arange(1, LONGEST + 1)
        for step in range(1, self.longest + 1):
            to = self.first[self.order[: self.alive[step - 1]]] + step
            ahead[to] = np.logaddexp.reduce(self.ways(to, ahead), axis=1)
        for step in range(1, self.longest + 1):
            of = ends[self.order[: self.alive[step - 1]]] - step
            behind[of] = np.logaddexp.reduce(behind[np.minimum(of[:, None] + on, self.n - 1)] + self.score[of], axis=1)
        run = np.repeat(np.arange(len(self.sizes)), self.sizes)
        slot = np.concatenate([np.arange(f, e) for f, e in zip(self.first, ends, strict=True)]) if len(run) else run
        after = behind[np.minimum(slot[:, None] + on, self.n - 1)]
        share = np.exp(ahead[slot][:, None] + self.score[slot] + after - ahead[ends][run][:, None])
        parts = np.rint(share * UNIT).astype(np.int64) * weights[run][:, None]
        out, ok = np.zeros(n, np.int64), self.known[slot]
        np.add.at(out, self.at[slot][ok], parts[ok])
        return out

    def cuts(self) -> list[np.ndarray]:
        """Ends of the words of each run on its best path; of equally good ways the one with the longest last word."""
        best, last = np.full(self.n, -np.inf), np.zeros(self.n, np.int64)
        best[self.first] = 0.0
        for step in range(1, self.longest + 1):
            to = self.first[self.order[: self.alive[step - 1]]] + step
            ways = self.ways(to, best)[:, ::-1]
            pick = ways.argmax(axis=1)
            best[to], last[to] = ways[np.arange(len(to)), pick], LONGEST - pick
        back, out = last.tolist(), []
        for f, n in zip(self.first.tolist(), self.sizes.tolist(), strict=True):
            ends, i = [], f + n
            while i > f:
                ends.append(i - f)
                i -= back[i]
            out.append(np.array(ends[::-1], np.int64))
        return out


def runs_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def portions(sizes: list[int]) -> Iterator[slice]:
    """Slices of entries that hold about CHUNK characters, or one entry."""
    low, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK:
            yield slice(low, i)
            low, held = i, 0
        held += n
    if low < len(sizes):
        yield slice(low, len(sizes))


def fit_words(texts: DataFrame, text: str = "text", pattern: str = CJK, least: int = 5, most: int = 200_000, rounds: int = 4) -> Words:
    """The word model of all runs of a pattern in all texts.

    pattern: a class of characters up to U+FFFF, repeated. Candidates are the pieces of two to LONGEST characters that stand
    `least` times or oftener, the `most` most frequent of them (the model's size; ties by key), and every single character, so
    that any run has a path; together they take less than 5 MB. Each of the `rounds` reads all runs, once each with its
    number, from the shared folder. Null and empty texts have no runs; without any the model is empty.
    """
    path = files.shared_folder(texts.sparkSession, "runs")
    texts.select(F.explode(runs_of(F.col(text), pattern)).alias("run")).groupBy("run").agg(F.count("*").alias("n")).write.parquet(path)
    runs = texts.sparkSession.read.schema("run string, n long").parquet(path)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Words(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            names, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for part in portions([len(x) for x in names]):
                lattice = Lattice(names[part], none)
                of = np.searchsorted(lattice.first, np.arange(lattice.n), "right") - 1
                end = (lattice.first + lattice.sizes)[of]
                fit = (of >= 0)[:, None] & (np.arange(lattice.n)[:, None] + np.arange(1, LONGEST + 1) <= end[:, None])
                keys, which = np.unique(lattice.keys[fit], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, which, n[part][np.broadcast_to(of[:, None], fit.shape)[fit]])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["piece", "n"])

    counted = runs.mapInArrow(candidates, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    single = F.col("piece").between(0, 0xFFFF)
    kept = counted.where(single).unionByName(counted.where(~single & (F.col("n") >= least)).orderBy(F.desc("n"), "piece").limit(most)).collect()
    keys, n = np.array([r.piece for r in kept], np.int64).view(np.uint64), np.array([r.n for r in kept], np.int64)
    order = np.argsort(keys)
    words = shares(keys[order], n[order] * UNIT)
    for _ in range(rounds if len(keys) else 0):
        words = fitted_again(runs, words)
    return words


def fitted_again(runs: DataFrame, words: Words) -> Words:
    """One round of expectation and maximisation over runs (run, n)."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words.keys), np.int64)
        for batch in batches:
            names, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for part in portions([len(x) for x in names]):
                total += Lattice(names[part], words).expected(n[part], len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    expected = np.zeros(len(words.keys), np.int64)
    for r in runs.mapInArrow(expect, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        expected[r["at"]] = r.n
    return shares(words.keys, expected)


def cut_words(df: DataFrame, words: Words, text: str = "text", pattern: str = CJK, out: str = "words") -> DataFrame:
    """All columns, and the words of all runs of the pattern in their order (array<string>); none for null and empty texts.

    Characters that the model does not know are words by themselves. A column named `out` must not be there yet.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out!r} already; name another one")
    names = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names)).to_pylist()
            for part in portions([sum(map(len, x)) for x in lists]):
                flat = [r for x in lists[part] for r in x]
                pieces = iter([[r[a:z] for a, z in zip([0, *c[:-1]], c, strict=True)] for r, c in zip(flat, Lattice(flat, words).cuts(), strict=True)])
                column = pa.array([[w for _ in x for w in next(pieces)] for x in lists[part]], pa.list_(pa.string()))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], column], names=[*names, out])

    schema = t.StructType([*df.schema.fields, t.StructField(out, t.ArrayType(t.StringType()))])
    return df.withColumn(out, runs_of(F.col(text), pattern)).mapInArrow(cut, schema)


def question_terms(questions: DataFrame, words: Words, text: str = "text", pattern: str = CJK, most: int = 8) -> DataFrame:
    """All columns, and the longest keyword terms of a question with its words cut by the model; ties in alphabetical order.

    Connectives and noise phrases go first; words and Latin runs count, as do two and three words in a row and parts of up to four characters.
    """
    cleaned = questions.withColumn("_plain", T.without_noise(F.col(text)))
    cut = cut_words(cleaned.withColumn("_rest", F.regexp_replace("_plain", T.LATIN, " ")), words, "_rest", pattern, "_words")
    return cut.withColumn("terms", T.terms_of_words(F.col("_plain"), F.col("_words"), most)).drop("_plain", "_rest", "_words")
