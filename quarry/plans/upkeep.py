"""Queries of upkeep: events as versions of stored rows, customers and orders as documents and their chunks."""

from pyspark.sql import functions as F

from quarry.operators import upkeep as U
from quarry.registry import query, table


@query("""WITH n AS (SELECT user_id AS document_id, event_id % 5 AS chunk_no, event_id AS version FROM events WHERE user_id % 2 = 0), l AS (SELECT document_id, chunk_no, max(version) AS version FROM n GROUP BY ALL)
SELECT * FROM l UNION ALL SELECT user_id, event_id % 5, event_id FROM events WHERE user_id NOT IN (SELECT document_id FROM n)""")
def upsert_documents(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 5).alias("chunk_no"), F.col("event_id").alias("version"))
    return U.replace_documents(e, e.where("document_id % 2 = 0"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def trace_upsert(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    return U.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id"], "event_id")


@query("SELECT c_custkey AS id, c_nationkey + CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS version, CASE WHEN c_nationkey = 3 THEN 'new' ELSE c_name END AS value FROM customer")
def summary_compare_and_set(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("version"), F.col("c_name").alias("value"))
    return U.compare_and_set(c, c.select("id", F.lit(3).alias("expected"), F.lit("new").alias("value"))).select("id", "version", "value")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)")
def orphan_reconcile(spark, sf):
    valid = table(spark, sf, "customer").where("c_nationkey <> 7").select(F.col("c_custkey").alias("o_custkey"))
    return U.orphans(table(spark, sf, "orders"), valid, "o_custkey").select("o_custkey")


@query("""WITH old AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01') SELECT 'trace' AS kind, count(*) AS n FROM orders WHERE o_orderkey NOT IN (FROM old) UNION ALL SELECT 'span', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM old)""")
def trace_retention(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trace_id"), F.col("o_orderdate").alias("created_at"))
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trace_id"))
    traces, spans, _ = U.keep_recent(t, s, s, F.lit("1995-01-01").cast("timestamp"))
    return traces.agg(F.count("*").alias("n")).select(F.lit("trace").alias("kind"), "n").unionByName(spans.agg(F.count("*").alias("n")).select(F.lit("span").alias("kind"), "n"))


@query("SELECT event_id AS id FROM events WHERE value BETWEEN 10 AND 50 AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 2 HOURS ORDER BY event_id DESC LIMIT 100")
def stale_sweep(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("stage"), F.lit(1).alias("status"), F.col("ts").alias("updated_at"))
    return U.stale(e, F.lit("2024-01-15").cast("timestamp"), 10, 50).select("id")


@query("SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages k WHERE k.page_id % 2 = 0 AND length(k.html) = length(p.html) AND k.url = p.url)")
def connector_dedup(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.length("html").alias("size"), F.col("url").alias("filename"), F.lit("s").alias("scope"))
    return U.new_files(p, p.where("page_id % 2 = 0").withColumn("status", F.lit(1)).withColumn("indexed", F.lit(True))).select("page_id")


@query("SELECT r_regionkey AS code, 'scope' AS kind, NULL AS parent FROM region UNION ALL SELECT n_nationkey, 'topic', n_regionkey FROM nation UNION ALL SELECT s_suppkey, 'document', s_nationkey FROM supplier")
def route_index(spark, sf):
    now = F.lit("2024-01-01").cast("timestamp").alias("updated_at")
    scopes = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("code"), now)
    topics = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_regionkey").alias("parent"), now)
    docs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("parent"), now)
    return U.route_rows(scopes, topics, docs, F.lit("2023-01-01").cast("timestamp")).select("code", "kind", "parent")


@query("SELECT o_orderkey, ['', 'parse', 'chunk,parse', 'vectorize,chunk,parse', 'index,vectorize,chunk,parse', 'profile,index,vectorize,chunk,parse'][o_orderkey % 6 + 1] AS undo FROM orders")
def stage_compensation(spark, sf):
    """What a failure in each stage undoes; an unknown stage undoes nothing."""
    stage = F.element_at(F.array(*map(F.lit, ["other", *U.STAGES])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(U.compensation(stage), ",").alias("undo"))


@query("""SELECT o_orderkey AS chunk_id, [(o_orderkey % 30 + 1)::VARCHAR] AS clause_number, CASE WHEN o_orderkey % 3 = 0 THEN ['5.' || o_orderkey % 9 + 1] ELSE ['7.' || o_orderkey % 9 + 1, '8.2'] END AS sub_clause_numbers, CASE WHEN o_orderkey % 2 = 0 THEN ['M3', 'P6-2'] ELSE [] END AS grade_codes, ['A', 'C'] AS city_classes FROM orders""")
def enriched_chunks(spark, sf):
    """Exact fields of chunks: bold subclauses hide plain ones, repeats go, grades and city classes come from the text."""
    k = F.col("o_orderkey")
    n = (k % 9 + 1).cast("string")
    plain = F.concat(F.lit("7."), n, F.lit(" 与 8.2，重复 8.2。"))
    body = F.concat(F.when(k % 3 == 0, F.concat(F.lit("**5."), n, F.lit(" 标题** "), plain)).otherwise(plain), F.when(k % 2 == 0, "职级 M3、P6-2；").otherwise("XM3 "), F.lit("A 类城市、C类城市、A类城市"))
    c = table(spark, sf, "orders").select(k.alias("chunk_id"), F.concat(F.lit("制度 > 第 "), (k % 30 + 1).cast("string"), F.lit(" 条")).alias("section_path"), body.alias("content"))
    return U.enrich_chunks(c).drop("content", "section_path")
