"""How far the sources of a language differ in their words, by smoothed shares over one kept vocabulary.

All of it is relational: words are counted a group, groups meet the kept vocabulary so that absent words count as zero,
the dense table meets itself on language and term, and windows rank. Words are aggregated before any shuffle, so a hot
source or word costs a reducer one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._base import shuffle_partitions, written

#: Letters A to Z and everything outside ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 size)), in whole numbers of up to 38 digits."""
    over = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    return F.call_function("div", over, (total + 5 * size).cast("decimal(20,0)")) + 1


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it); one row with a null term for each group with documents without terms."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    terms = F.regexp_extract_all(F.translate(read(text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = df.select(read(lang).alias("lang"), read(source).alias("source"), terms.alias("terms"))
    # behind a document's words stand its distinct ones, which count documents
    each = rows.select("lang", "source", F.size("terms").alias("words"), F.posexplode_outer(F.concat("terms", F.array_distinct("terms"))).alias("pos", "term"))
    occurs = F.col("pos") < F.col("words")
    return each.groupBy("lang", "source", "term").agg(F.sum(F.when(occurs, 1).otherwise(0)).alias("n"), F.sum(F.when(~occurs, 1).otherwise(0)).alias("docs"))


def source_divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank for every group (lang, source) of df.

    A language keeps the terms of at least `min_docs` of its rows. Part `pair` has every other source of the language, the
    summed difference of shares over all kept terms as value; part `term` the `top` kept terms that the source has and that
    have a larger share in it than in the language. Ranks go by value, then by the item's bytes. Nulls read as ''; a row
    without terms still makes its group; a language without kept terms has pairs of value 0 and no terms. Repeated rows count
    each time; a text is one row's work; other columns are left out; an empty table gives no rows.
    """
    counts = written(term_counts(df, text, lang, source), "divergence-counts")
    kept = written(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "divergence-kept")
    present = counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "size", "lang_total"])
    groups = written(groups, "divergence-groups")

    # every group meets its language's terms, a language's terms dealt over many salts
    salts = shuffle_partitions(df)
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    crossed = groups.where("size > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(salted, ["lang", "salt"])
    n = F.coalesce("n", F.lit(0))
    dense = crossed.join(present, ["lang", "source", "term"], "left").select("lang", "source", "term", n.alias("n"), share(n, F.col("total"), F.col("size")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("size")).alias("q"))
    dense = written(dense, "divergence-shares")

    one = dense.select("lang", "term", "source", "p")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"))
    apart = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other_p"))).alias("value"))
    alone = groups.where("size = 0").select("lang", "source")
    equal = alone.join(alone.withColumnRenamed("source", "item"), "lang").where("source < item").withColumn("value", F.lit(0).cast("long"))
    half = apart.unionByName(equal)
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""
WITH rows AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM rows),
words AS (SELECT lang, source, id, unnest(terms) AS term FROM rows),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS size, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
crossed AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, s.size, s.lang_total
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
dense AS (SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * size)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * size)::HUGEINT AS q
  FROM crossed),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
