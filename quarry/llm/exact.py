"""Exact deduplication that no hot text can overload.

Rows are combined three times, each time by the full normalised text and not only by its digest: inside each input
partition (Spark's partial aggregation), among the partitions that share a salt, and among the salts. So the most
frequent text costs a reducer one row for each salt, whatever number of rows holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._base import checkpointed


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_classes(df: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 64, digest=lambda t: F.sha2(t, 256)) -> DataFrame:
    """`key`, keep_id (the class's smallest key), group_size, kept and digest, one row for each row of df.

    Texts are equal when `normalised` gives the same string; null counts as empty, so all empty texts are one class.
    Of rows with the same text and the same key one class member each is counted, and `kept` holds for all that have the
    smallest key. Null keys never win against others. Extra columns are left out; an empty table gives an empty table.
    digest: maps the text's column to the digest's; texts that share a digest but differ are still told apart.
    """
    rows = df.select(F.col(key).alias("k"), normalised(F.col(text)).alias("t")).withColumn("d", digest(F.col("t")))
    salted = rows.withColumn("s", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("d", "s", "t").agg(F.min("k").alias("w"), F.count("*").alias("n"))
    # dealt by digest alone, so that the global groups and the count of texts of a digest need one shuffle
    whole = salted.repartition("d").groupBy("d", "t").agg(F.min("w").alias("w"), F.sum("n").alias("n"))
    classes = whole.withColumn("c", F.count("*").over(Window.partitionBy("d"))).select("d", "w", "n", "c", F.when(F.col("c") > 1, F.col("t")).alias("ct"))
    classes = checkpointed(classes)
    single = classes.where("c = 1").select("d", "w", "n")
    ids = rows.select("k", "d")
    out = ids.join(single, "d")
    if not classes.where("c > 1").isEmpty():
        clashing = classes.where("c > 1").select("d", F.col("ct").alias("t"), "w", "n")
        out = out.unionByName(rows.join(clashing, ["d", "t"]).select("d", "k", "w", "n"))
    return out.select(F.col("k").alias(key), F.col("w").alias("keep_id"), F.col("n").alias("group_size"), F.col("k").eqNullSafe(F.col("w")).alias("kept"), F.col("d").alias("digest"))


def drop_exact_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is the smallest of a class, all columns kept.

    Rows are told apart by their key: those that share one are kept or dropped together, so keys should be unique. An empty
    table gives an empty table; texts of any length are compared whole.
    """
    keep = exact_classes(df, text, key).where("kept").select(F.col(key).alias("_keep"))
    return df.join(keep, df[key].eqNullSafe(F.col("_keep")), "left_semi")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_classes(docs).withColumnRenamed("digest", "text_sha256")


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
