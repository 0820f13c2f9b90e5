"""Offline stand-ins for model calls: an embedder, a reranker and a judge that need no network.

Each is a function from columns to a column, so another model goes in as a pandas UDF of the same form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[Column, Column], Column]


def words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, and single CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+|[\\u4e00-\\u9fff])"), F.lit(1))


def hashing_embedding(c: Column, dim: int = 64) -> Column:
    """Signed counts of hashed words, as doubles; all zero for a text without words."""
    hashed = F.transform(words(c), lambda w: F.xxhash64(w))
    at = lambda h: F.pmod(h, F.lit(dim)).cast("int")
    sign = lambda h: F.when(F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(hashed, F.lit(0.0), lambda s, h: s + F.when(at(h) == d, sign(h)).otherwise(0.0)))


def checked_dimension(vector: Column, dim: int) -> Column:
    """The vector; an error where its length is another one."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))))


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text holds, 0 to 1."""
    q = F.array_distinct(words(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(text))), F.size(q)), F.lit(0.0))
