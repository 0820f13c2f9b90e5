"""A quality classifier made of sparse rules.

Statistics of each text are column expressions. A small forest is grown over the statistics of the labelled rows; every
path from a root to a node is a conjunctive rule; a lasso logistic regression over the rules leaves few weights; and the
rules that keep one become one column expression, so scoring runs no Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import written

#: Labelled rows of one partition of the fit.
PART_ROWS = 50_000
Condition = tuple[str, str, float]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text (null: empty); ratios are 0 for an empty text, distinct words 1."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    n_words = F.size(words).cast("double")
    of_chars = lambda pattern: F.coalesce(F.try_divide(F.regexp_count(t, F.lit(pattern)), n), F.lit(0.0))
    return {
        "s_words": n_words,
        "s_word_length": F.coalesce(F.try_divide(n, n_words), F.lit(0.0)),
        "s_distinct": F.coalesce(F.try_divide(F.size(F.array_distinct(words)), n_words), F.lit(1.0)),
        "s_upper": of_chars(r"\p{Lu}"),
        "s_digits": of_chars("[0-9]"),
        "s_symbols": of_chars(r"[!#$%&*<>=^~+@\\{}\[\]_]"),
        "s_bars": of_chars(r"\|"),
        "s_stops": of_chars("[.,;:?]"),
    }


#: Names of the statistics, in the order of the forest's features.
STATISTICS = ["s_words", "s_word_length", "s_distinct", "s_upper", "s_digits", "s_symbols", "s_bars", "s_stops"]


def paths(description: str) -> list[tuple[Condition, ...]]:
    """Conjunctions of all nodes below the roots, from a forest's toDebugString."""
    found: dict[tuple[Condition, ...], None] = {}
    stack: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (STATISTICS[int(m[2])], m[3], float(m[4]))))
        found.setdefault(tuple(sorted({c for _, c in stack})))
    return list(found)


def condition(rule: tuple[Condition, ...]) -> Column:
    return reduce(Column.__and__, [F.col(c) <= v if op == "<=" else F.col(c) > v for c, op, v in rule])


@dataclass
class RuleEnsemble:
    """An intercept and the weights of the rules that the lasso kept."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        total = reduce(Column.__add__, [F.when(condition(r), w).otherwise(0.0) for r, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame, label: str = "label", trees: int = 8, depth: int = 3, lasso: float = 0.0005, seed: int = 7) -> RuleEnsemble:
    """Fit on all rows of statistics with a 0/1 label (others are left out).

    Without rows, or with rows of one class only, there are no rules and the score is the classes' smoothed share.
    """
    rows = rows.where(F.col(label).isin(0, 1)).select(*STATISTICS, F.col(label).cast("double").alias("y"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = (ones + 1) / (n + 2)
    flat = RuleEnsemble(math.log(share / (1 - share)), [])
    if not 0 < ones < n:
        return flat
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(rows.repartition(max(1, n // PART_ROWS))).select("x", "y", *STATISTICS).cache()
    try:
        forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
        rules = paths(forest.toDebugString)
        if not rules:
            return flat
        # rows that fulfil the same rules are one row with a weight, so the lasso's passes don't grow with the labels
        hits = vectors.select("y", F.array(*[condition(r).cast("double") for r in rules]).alias("r")).groupBy("y", "r").agg(F.count("*").cast("double").alias("w"))
        weighted = hits.coalesce(max(1, n // PART_ROWS)).select("y", "w", array_to_vector("r").alias("r")).cache()
        model = LogisticRegression(featuresCol="r", labelCol="y", weightCol="w", regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False).fit(weighted)
        weighted.unpersist()
    finally:
        vectors.unpersist()
    weights = model.coefficients.toArray().tolist()
    return RuleEnsemble(float(model.intercept), [(r, w) for r, w in zip(rules, weights, strict=True) if w])


def quality_scores(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = 0.7, learn=None) -> DataFrame:
    """key, held_out, score (0 to 1) and predicted (1 if score >= threshold) for each row of df.

    Only the texts' statistics are inputs. Rows whose crc32 of the key (as text) leaves 2 when divided by 4 are held out of
    the fit (a null key counts as the empty text); `learn`, a condition over the key column, replaces that rule. Every
    other labelled row takes part, labels other than 0 and 1 do not. Null and empty texts are scored like any text.
    Repeated rows are scored alike, extra columns are left out, and an empty table gives no rows.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    stats = written(df.select(F.col(key), held.alias("held_out"), *[c.alias(n) for n, c in statistics(F.col(text)).items()]), "statistics")
    known = labels.select(F.col(key), F.col(label).alias("label"))
    model = fit(stats.where(~F.col("held_out") if learn is None else learn).join(known, key))
    return stats.select(key, "held_out", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """Rows of df that the classifier accepts, all columns kept. Rows with a null key are kept."""
    bad = quality_scores(df, labels, text, key, **how).where("predicted = 0").select(F.col(key).alias("_bad"))
    return df.join(bad, df[key] == F.col("_bad"), "left_anti")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
