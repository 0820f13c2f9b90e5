"""Queries of routing and plans over the star schema."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import fuzzy
from quarry.operators import lexical as L
from quarry.operators import routing as G
from quarry.operators.structure import settled
from quarry.registry import query, table

S_SQL = """q AS (SELECT vec_id AS query, label, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, vec_id AS code, list_cosine_similarity(qv, embedding::DOUBLE[]) AS sim, q.label = e.label AS same FROM q, embeddings e),
r AS (SELECT query, code, round(CASE WHEN sim > 0.2 THEN (sim - 0.2) * 50 ELSE 0 END + least(10, (code % 5) * 1.6) + CASE WHEN same THEN 15 ELSE 0 END + (code % 10) / 10 * 20, 4) AS score FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, code) AS rank FROM r WHERE score > 0 QUALIFY rank <= 8)"""


def routes(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("scope"), F.col("embedding").alias("query_vector"))
    codes = e.select(F.col("vec_id").alias("code"), F.col("label").alias("scope"), F.col("embedding").alias("vector"), (F.col("vec_id") % 5).alias("lexical"), (F.col("vec_id") % 10 / 10).alias("relation"))
    return G.near_routes(asked, codes, G.TOPICS)


@query(f"WITH {S_SQL} SELECT query, code, round(score, 3) AS score FROM b WHERE rank <= 3")
def topic_routes(spark, sf):
    return routes(spark, sf).where("rank <= 3").select("query", "code", F.round("score", 3).alias("score"))


@query(f"WITH {S_SQL}, c AS (SELECT query, max(score) FILTER (rank = 1) AS best, max(score) FILTER (rank = 2) AS second FROM b GROUP BY 1) SELECT query, round(best / greatest(10, best + second + 5), 3) AS confidence, CASE WHEN best / greatest(10, best + second + 5) >= 0.55 THEN 'SUCCESS' ELSE 'LOW_CONFIDENCE' END AS status FROM c")
def route_confidence(spark, sf):
    """The confidence to three decimals, rounded once."""
    c = G.confidence(routes(spark, sf))
    share = F.col("best") / F.greatest(F.lit(10.0), F.col("best") + F.col("second") + 5)
    return c.select("query", F.round(share, 3).alias("confidence"), "status")


@query(f"""WITH {S_SQL}, c AS (SELECT query, max(score) FILTER (rank = 1) AS best, max(score) FILTER (rank = 2) AS second, max(code) FILTER (rank = 1) AS c1, max(code) FILTER (rank = 2) AS c2 FROM b GROUP BY 1),
d AS (SELECT *, best / greatest(10, best + second + 5) AS conf FROM c) SELECT query, CASE WHEN query // 100 % 2 = 0 THEN conf < 0.25 ELSE conf < 0.4 END OR (best - second <= 3 AND coalesce(c1 % 2 <> c2 % 2, true)) AS clarify FROM d""")
def clarify_decisions(spark, sf):
    """Every other question gives a name; the two leaders' scopes are their codes' parities."""
    r = settled(routes(spark, sf))
    code = lambda n: F.max(F.when(F.col("rank") == n, F.col("code"))).alias(f"c{n}")
    c = G.confidence(r).join(r.groupBy("query").agg(code(1), code(2)), "query")
    named, same = F.floor(F.col("query") / 100) % 2 == 0, F.coalesce(F.col("c1") % 2 == F.col("c2") % 2, F.lit(False))
    score = F.col("best") / F.greatest(F.lit(10.0), F.col("best") + F.col("second") + 5)
    return c.select("query", G.must_clarify(score, named, F.col("best") - F.col("second"), same).alias("clarify"))


@query(f"WITH {S_SQL}, f AS (SELECT query, list(code ORDER BY rank) AS codes, list(round(score, 3) ORDER BY rank) AS scores FROM b WHERE rank <= 5 GROUP BY 1) SELECT query, codes, scores, CASE query // 100 % 3 WHEN 0 THEN true WHEN 1 THEN false END AS hit FROM f")
def route_traces(spark, sf):
    """The first routes of each question as JSON, and whether the selected one is among them: the second, none of them, or none selected."""
    r = settled(routes(spark, sf))
    k = F.floor(F.col("query") / 100) % 3
    selected = r.where("rank = 2").select("query", F.when(k == 0, F.col("code")).when(k == 1, F.lit(-1)).alias("selected"))
    rows = G.trace_rows(r, selected).withColumn("r", F.from_json("routes", "array<struct<rank:int,code:bigint,score:double>>"))
    return rows.select("query", F.col("r")["code"].alias("codes"), F.transform(F.col("r")["score"], lambda x: F.round(x, 3)).alias("scores"), "hit")


@query("""WITH p AS (SELECT p_partkey, lower(CASE WHEN p_size % 3 = 0 THEN ' brand#' || p_size % 30 || ' ' WHEN p_size % 3 = 1 THEN 'brand' ELSE p_name || ' ' || p_brand END) AS raw, lower(p_brand) AS n, lower(p_type) AS w FROM part), q AS (SELECT *, trim(raw) AS q FROM p)
SELECT p_partkey, (CASE WHEN q = n THEN 2 ELSE 0 END + CASE WHEN starts_with(n, q) THEN 1.5 ELSE 0 END + CASE WHEN contains(q, n) OR contains(n, q) THEN 1 ELSE 0 END + CASE WHEN levenshtein(q, n) <= 2 THEN 0.5 ELSE 0 END + CASE WHEN contains(q, 'cold') THEN 0.8 ELSE 0 END + CASE WHEN contains(q, w) THEN 0.8 ELSE 0 END)::DOUBLE AS score FROM q""")
def lexical_routes(spark, sf):
    """Each part's brand for a question that says a brand, the start of all brands, or the part's name and brand; two listed words."""
    k = F.col("p_size") % 3
    asked = F.when(k == 0, F.concat(F.lit(" Brand#"), (F.col("p_size") % 30).cast("string"), F.lit(" "))).when(k == 1, "brand").otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, sf, "part").select("p_partkey", L.route_lexical(asked, F.col("p_brand"), [F.lit("cold"), F.col("p_type")]).alias("score"))


@query("""WITH w AS (SELECT p_partkey AS code, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))) AS term FROM part), q AS (SELECT n_nationkey AS query, unnest(list_distinct(regexp_extract_all(lower(n_name), '[a-z0-9]+') || ['widget', 'cold'])) AS term FROM nation),
s AS (SELECT query, code, sum(CASE WHEN length(term) >= 6 THEN 12 WHEN length(term) >= 4 THEN 8 WHEN length(term) >= 3 THEN 4 ELSE 2 END)::DOUBLE AS score FROM q JOIN w USING (term) GROUP BY ALL HAVING score >= 1)
SELECT query, code, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, code) AS rank FROM s QUALIFY rank <= 5""")
def fallback_routes(spark, sf):
    from quarry.models import words

    q = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query"), F.lit("t").alias("tenant"), F.concat(words(F.col("n_name")), F.array(F.lit("widget"), F.lit("cold"))).alias("terms"))
    return G.fallback_routes(q, table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.lit("t").alias("tenant"), F.col("p_name").alias("text")))


@query("""SELECT page_id // 10 AS doc, page_id AS node_no, CASE WHEN contains(lower(url), 'en') THEN 2 ELSE 0 END + CASE WHEN contains(lower(url), 'org') THEN 1 ELSE 0 END AS score FROM pages WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id // 10 ORDER BY score DESC, page_id) = 1""")
def best_sections(spark, sf):
    s = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 10).alias("doc"), F.col("page_id").alias("node_no"), F.lit("").alias("title"), F.col("url").alias("section_path"))
    return G.best_section(s, F.lit("en"), F.lit("org")).select("doc", "node_no", "score")


@query("""WITH t(o, topics) AS (SELECT o_orderkey, [o_orderpriority, o_orderstatus] FROM orders) SELECT DISTINCT o AS doc, unnest(list_filter(topics, lambda x: x IN ('1-URGENT', 'F'))) AS topic FROM t""")
def topic_documents(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.to_json(F.array("o_orderpriority", "o_orderstatus")).alias("core_topics"))
    return G.topic_documents(p, spark.createDataFrame([("1-URGENT",), ("F",)], "topic string"))


def steps(spark, sf):
    """The lines of an order as steps that each need the line before. In every fifth order the first one needs the last: a cycle."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("id")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("plan")
    before, last = F.lag("id").over(w.orderBy("id")), F.max("id").over(w)
    needs = F.filter(F.array(before, F.when(before.isNull() & (F.col("plan") % 5 == 0), last)), lambda x: x.isNotNull())
    return li.select("plan", "id", "n", needs.alias("depends_on"))


@query("SELECT l_orderkey AS plan, l_linenumber AS id, CASE WHEN l_orderkey % 5 = 0 THEN -1 ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 END AS layer FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def topo_layers(spark, sf):
    s = steps(spark, sf)
    return G.layers(s, s.select("plan", "id", F.explode("depends_on").alias("needs")))


@query("""WITH l AS (SELECT l_orderkey AS plan, l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY ALL) SELECT plan, id, 'cycle' AS issue FROM l WHERE plan % 5 = 0 UNION ALL SELECT plan, id, 'duplicate_id' FROM l WHERE n > 1
UNION ALL SELECT plan, id, 'empty_question' FROM l WHERE id = 4 UNION ALL SELECT plan, id, 'unknown_dependency' FROM l WHERE id = 6""")
def subplan_issues(spark, sf):
    """Lines that stand twice in an order, blank questions, a step that isn't there, and the cycles of steps()."""
    s = steps(spark, sf).withColumn("mode", F.lit("RETRIEVAL")).withColumn("question", F.when(F.col("id") == 4, " ").otherwise("q"))
    s = s.withColumn("depends_on", F.when(F.col("id") == 6, F.concat("depends_on", F.array(F.lit(99)))).otherwise(F.col("depends_on")))
    return G.plan_issues(s.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(2))))).drop("copy", "n"))


@query("SELECT o_orderkey, 12.0 + CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 0 END AS hits FROM orders")
def name_hits(spark, sf):
    """Terms in a text by their length; parts of a counted term don't count, and terms that the text lacks neither."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("abcdefgh "), F.when(k % 2 == 0, "xy ").otherwise(""), F.when(k % 3 == 0, "pqr").otherwise(""))
    return table(spark, sf, "orders").select(k, G.name_hits(text, F.array(*map(F.lit, ["abcdef", "abcd", "xy", "pqr", "missing"]))).alias("hits"))


@query("""WITH r AS (SELECT o_custkey AS query, o_orderkey AS code, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT 'scope' AS level, query, code, rank FROM r WHERE rank <= 5 UNION ALL SELECT 'topic', query, code, rank FROM r WHERE rank <= 8 UNION ALL SELECT 'document', query, code, rank FROM r WHERE rank <= 5""")
def route_caps(spark, sf):
    """The best five scopes, eight topics and five documents of each question."""
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("code"), F.col("o_totalprice").alias("score"))
    parts = [G.best_routes(r, k).select(F.lit(n).alias("level"), "query", "code", "rank") for n, k in (("scope", G.SCOPES), ("topic", G.TOPICS), ("document", G.DOCUMENTS))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) % 101 / 100 AS p, CASE WHEN turn % 3 = 0 THEN 'chitchat' ELSE 'Knowledge' END AS first, CASE WHEN turn % 3 = 0 THEN 'data' ELSE 'CHAT' END AS second, CASE WHEN conv_id % 2 = 0 THEN 'Open' ELSE 'other' END AS rule FROM conversations),
l AS (SELECT conv_id, turn, lower(CASE WHEN p >= 0.55 AND p - (1 - p) >= 0.15 THEN first WHEN 1 - p >= 0.55 AND 1 - p - p >= 0.15 THEN second ELSE rule END) AS label FROM t)
SELECT conv_id, turn, CASE WHEN label IN ('capability', 'chitchat', 'chat', 'open') THEN 'open' ELSE 'knowledge' END AS intent FROM l""")
def intents(spark, sf):
    """Each turn's intent: two labels share a probability that its text's length gives; where neither is clear, a rule decides."""
    p = F.length(F.coalesce("text", F.lit(""))) % 101 / 100
    k = F.col("turn") % 3 == 0
    d = F.array(F.struct(F.when(k, "chitchat").otherwise("Knowledge").alias("label"), p.alias("p")), F.struct(F.when(k, "data").otherwise("CHAT").alias("label"), (1 - p).alias("p")))
    return table(spark, sf, "conversations").select("conv_id", "turn", G.resolve_intent(d, F.when(F.col("conv_id") % 2 == 0, "Open").otherwise("other")).alias("intent"))


NAMES_SQL = """WITH n AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS name FROM part), q AS (SELECT DISTINCT lower(p_name || ' brand#' || (p_size % 30)) AS query FROM part)"""


def route_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat("p_name", F.lit(" Brand#"), (F.col("p_size") % 30).cast("string")).alias("text")), p.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))


@query(f"{NAMES_SQL} SELECT query, name, levenshtein(query, name)::INTEGER AS distance FROM q, n WHERE levenshtein(query, name) <= 2")
def fuzzy_routes(spark, sf):
    """All asked names against all routes, up to two edits apart."""
    return fuzzy.fuzzy_matches(*route_names(spark, sf))


@query("WITH n AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS name FROM part), q AS (SELECT DISTINCT trim(right(lower(p_name), 6) || ' b') AS query FROM part UNION SELECT DISTINCT trim(left(lower(p_name), 5)) FROM part) SELECT query, name, starts_with(name, query) AS prefix FROM q, n WHERE contains(name, query)")
def contained_routes(spark, sf):
    """Pieces of names and the routes that hold them."""
    p = table(spark, sf, "part")
    pieces = p.select(F.concat(F.right("p_name", F.lit(6)), F.lit(" B")).alias("text")).unionByName(p.select(F.left("p_name", F.lit(5)).alias("text")))
    return fuzzy.contained_matches(pieces, route_names(spark, sf)[1])
