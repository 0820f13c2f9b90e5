"""Names within one or two edits of a text, and names with a piece of it, found by equality joins on small keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def shorter(text: Column) -> Column:
    """All strings that one character less leaves."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def neighbourhood(text: Column, edits: int) -> Column:
    """The text and all strings that up to `edits` (1 or 2) deletions leave. Two texts within that many edits share one."""
    once = shorter(text)
    more = F.flatten(F.transform(once, shorter)) if edits > 1 else F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(text), once, more))


def fuzzy_matches(queries: DataFrame, names: DataFrame, edits: int = 2) -> DataFrame:
    """query, name, distance: all pairs of distinct texts, trimmed and lower-cased, within `edits` edits.

    queries: text; names: name. Both sides send the strings that deletions leave of each distinct text; those that share
    one are compared by their edit distance. Texts of n characters have n^2 / 2 such strings at two edits. Nulls read as ''.
    """
    if edits not in (1, 2):
        raise ValueError("one or two edits")
    keys = lambda df, c, name: df.select(normal(F.col(c)).alias(name)).distinct().select(name, F.explode(neighbourhood(F.col(name), edits)).alias("_key"))
    near = keys(queries, "text", "query").join(keys(names, "name", "name"), "_key").where(F.abs(F.length("query") - F.length("name")) <= edits)
    distance = F.levenshtein("query", "name")
    return near.select("query", "name").distinct().withColumn("distance", distance).where(F.col("distance") <= edits)


def grams(text: Column, n: int) -> Column:
    """Distinct stretches of n characters; a shorter text has none."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(0)), F.lit(1)), lambda i: F.substring(text, i, n)))


def contained_matches(queries: DataFrame, names: DataFrame, n: int = 3) -> DataFrame:
    """query, name, prefix: names (distinct, normalised) that hold a whole query of n characters or more, and whether at their start.

    A query is looked up by its rarest n-gram over all names, which any name that holds it has; the piece itself decides.
    """
    text = names.select(normal(F.col("name")).alias("name")).where(F.length("name") >= n).distinct()
    asked = queries.select(normal(F.col("text")).alias("query")).where(F.length("query") >= n).distinct()
    posts = text.select("name", F.explode(grams(F.col("name"), n)).alias("gram"))
    sizes = posts.groupBy("gram").agg(F.count("*").alias("n"))
    pieces = asked.select("query", F.explode(grams(F.col("query"), n)).alias("gram")).join(sizes, "gram", "left")
    # a query with a piece that no name has is in none
    rarest = pieces.groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("query", F.col("r.gram").alias("gram"))
    return rarest.join(posts, "gram").where(F.contains("name", F.col("query"))).select("query", "name", F.startswith("name", F.col("query")).alias("prefix"))
