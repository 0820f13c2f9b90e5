"""Queries of structure and chunks over documents and pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import structure as D
from quarry.registry import query, table
from quarry.sources import files


def page_documents(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), T.page_text(F.col("html")).alias("text"))


def tree(spark, sf):
    return D.build_tree(D.classify_lines(D.logical_lines(page_documents(spark, sf))), together=True)


@query("SELECT doc_id AS doc, line, count(*) AS freq FROM (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM documents) WHERE line <> '' GROUP BY ALL")
def line_frequency(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("raw"))
    return D.line_frequency(lines.withColumn("line", T.strip(F.col("raw"))))


@query()
def line_signals(spark, sf):
    return D.classify_lines(D.logical_lines(page_documents(spark, sf))).select("doc", "line_no", "kind", "code", "title", "level")


@query()
def document_tree(spark, sf):
    return tree(spark, sf).select("doc", "node_no", "node_type", "parent_no", "prev_no", "next_no", "depth", "title", "section_path", "canonical_path")


@query()
def graph_edges(spark, sf):
    return D.edges(tree(spark, sf))


@query()
def subtree_items(spark, sf):
    nodes = tree(spark, sf)
    return D.items_below(nodes, nodes.where("node_type = 'document'").select("doc", F.col("node_no").alias("root"))).select("doc", "root", "node_no", "item_index")


@query()
def node_contexts(spark, sf):
    return D.node_context(tree(spark, sf))


@query()
def outlines(spark, sf):
    return D.render_outline(tree(spark, sf))


@query()
def structure_chunks(spark, sf):
    return D.structure_chunks(tree(spark, sf))


#: Sentences packed up to 512 characters, by a fold.
CHUNKS = r"""c AS (SELECT doc_id AS doc, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
p AS (SELECT doc, list_reduce(list_transform(s, lambda x: {'done': []::VARCHAR[], 'open': x}), lambda a, x: CASE WHEN a.open <> '' AND length(a.open) + length(x.open) > 512 THEN {'done': list_append(a.done, a.open), 'open': x.open} ELSE {'done': a.done, 'open': a.open || x.open} END, {'done': []::VARCHAR[], 'open': ''}) AS r FROM c),
k AS (SELECT doc, list_filter(CASE WHEN r.open <> '' THEN list_append(r.done, r.open) ELSE r.done END, lambda x: length(x) >= 50) AS t FROM p)"""


@query(f"WITH {CHUNKS} SELECT doc, unnest(range(1, len(t) + 1)) AS chunk_no, unnest(t) AS text FROM k")
def chunk_sentences(spark, sf):
    return D.sentence_chunks(table(spark, sf, "documents"))


@query(f"""WITH {CHUNKS}, o AS (SELECT doc, list_reduce(list_transform(t, lambda x: {{'last': x, 'done': []::VARCHAR[]}}), lambda a, x: CASE WHEN a.last = '' OR starts_with(x.last, right(a.last, 128)) THEN {{'last': x.last, 'done': list_append(a.done, x.last)}}
ELSE {{'last': right(a.last, 128) || chr(10) || x.last, 'done': list_append(a.done, right(a.last, 128) || chr(10) || x.last)}} END, {{'last': '', 'done': []::VARCHAR[]}}) AS r FROM k) SELECT doc, unnest(range(1, len(r.done) + 1)) AS chunk_no, unnest(r.done) AS text FROM o""")
def chunk_overlap(spark, sf):
    return D.overlapped_chunks(D.sentence_chunks(table(spark, sf, "documents")))


@query()
def chunk_pipeline(spark, sf):
    return D.chunk_pipeline(page_documents(spark, sf))


@query()
def merged_chunks(spark, sf):
    from quarry.models import hashing_embedding

    chunks = D.sentence_chunks(page_documents(spark, sf)).withColumn("parent", F.lit(0)).withColumn("vector", hashing_embedding(F.col("text")))
    return D.merge_semantic(chunks)


@query("""WITH RECURSIVE e(child, parent) AS (SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 0), d(root, node, distance) AS (SELECT 1::BIGINT, 1::BIGINT, 0 UNION ALL SELECT d.root, e.child, d.distance + 1 FROM d JOIN e ON e.parent = d.node)
SELECT root, node, distance FROM d""")
def tree_descend(spark, sf):
    """Everything below node 1 of a tree whose parents are the keys' thirds."""
    c = table(spark, sf, "customer").where("c_custkey > 0")
    nodes = c.select(F.lit(0).alias("doc"), F.col("c_custkey").alias("node_no"), F.floor(F.col("c_custkey") / 3).alias("parent_no"))
    roots = spark.range(1).select(F.lit(0).alias("doc"), F.lit(1).cast("long").alias("root"))
    return D.subtree(nodes, roots).select("root", F.col("node_no").alias("node"), "distance")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 5 >= 3 AND h >= 2 THEN ['structure', 'recursive'] WHEN p >= 5 AND n >= 2000 THEN ['recursive', 'semantic'] ELSE ['recursive'] END AS strategy FROM (SELECT doc_id, length(text) AS n, doc_id % 5 + (p >= 3)::INT AS h, p
FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS p FROM documents))""")
def chunk_strategies(spark, sf):
    """Headings are the id's remainder; a document's level follows from them and its paragraphs."""
    c, headings = F.col("text"), F.col("doc_id") % 5
    p = F.size(T.paragraphs(c))
    level = headings + (p >= 3).cast("int")
    return table(spark, sf, "documents").select("doc_id", D.recommend_strategy(headings, level, F.length(c), p).alias("strategy"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 >= 5 THEN 3 WHEN doc_id % 7 >= 2 THEN 2 WHEN len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')) >= 3 THEN 1 ELSE 0 END AS level FROM documents""")
def structure_levels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.structure_level(F.col("doc_id") % 7, F.size(T.paragraphs(F.col("text")))).alias("level"))


@query("""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS chunk_no, repeat(l_returnflag, 3 + l_linenumber) AS text FROM lineitem GROUP BY ALL), n AS (SELECT doc, chunk_no, text, row_number() OVER (PARTITION BY doc, chunk_no ORDER BY text) AS i FROM c)
SELECT doc, chunk_no, right(coalesce(lag(text) OVER w, ''), 5) AS before, left(coalesce(lead(text) OVER w, ''), 5) AS after FROM n WHERE i = 1 WINDOW w AS (PARTITION BY doc ORDER BY chunk_no)""")
def context_windows(spark, sf):
    """Each line of an order with the end of the one before and the start of the one after."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("chunk_no")).agg(F.min("l_returnflag").alias("f"))
    return D.context_window(c.select("doc", "chunk_no", F.expr("repeat(f, 3 + chunk_no)").alias("text")), 5).select("doc", "chunk_no", "before", "after")


@query(r"""WITH u AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), n AS (SELECT page_id, html, lower(regexp_extract(u, '^(https?)://', 1)) AS s, lower(regexp_extract(u, '^https?://([^/?]*)', 1)) AS h, regexp_extract(u, '^https?://[^/?]*([^?]*)', 1) AS p,
list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|spm|from|ref|source)(=|$)')) AS q FROM u),
k AS (SELECT s, h, html, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM n WHERE s <> '' AND h <> ''),
l AS (SELECT DISTINCT url AS source, s || '://' || h || unnest(regexp_extract_all(html, '<a[^>]*?href="(/[^"]*)"', 1)) AS url FROM k), a AS (SELECT DISTINCT url, 0 AS depth FROM k), b AS (SELECT DISTINCT url, 1 AS depth FROM l WHERE url NOT IN (SELECT url FROM a)),
c AS (SELECT DISTINCT l.url, 2 AS depth FROM l JOIN b ON l.source = b.url WHERE l.url NOT IN (SELECT url FROM a) AND l.url NOT IN (SELECT url FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def crawl_pages(spark, sf):
    """Urls within two links of the pages, on their hosts."""
    pages = table(spark, sf, "pages")
    return files.crawl(pages.select("url"), pages, 2)


@query()
def merged_sections(spark, sf):
    """Neighbouring nodes merged to about 320 characters, 512 at most; held against brute force in the tests."""
    return D.merged_sections(tree(spark, sf))


def nations(spark, sf):
    """Nations as sections of their regions, in their order."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_regionkey").alias("doc"), F.col("r_name").alias("parent_title"), F.col("n_nationkey").alias("node_no"), (F.col("n_nationkey") + 100).cast("string").alias("node_code"), F.col("n_name").alias("title"), F.concat(F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("canonical_path"))


@query("""WITH w AS (SELECT n_nationkey AS query, n_regionkey AS doc, n_nationkey % 4 AS k FROM nation)
SELECT query, doc, CASE WHEN k = 2 THEN (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = doc) ELSE query END AS node_no, CASE k WHEN 0 THEN 'code' WHEN 1 THEN 'title' ELSE 'path' END AS how FROM w WHERE k < 3""")
def found_nodes(spark, sf):
    """Sections by code, by title in any case, and by a path's beginning; one question in four names nothing that exists."""
    n = nations(spark, sf)
    k = F.col("node_no") % 4
    wanted = n.select(F.col("node_no").alias("query"), "doc", F.when(k == 0, F.col("node_code")).when(k == 3, "none").alias("code"), F.when(k == 1, F.lower("title")).alias("title"), F.when(k == 2, F.concat(F.lit("/"), F.lower("parent_title"))).alias("path"))
    return D.find_nodes(n, wanted)


@query("""WITH n AS (SELECT n_nationkey, n_name, r_name, lag(n_name) OVER w AS p, lead(n_name) OVER w AS q FROM nation JOIN region ON r_regionkey = n_regionkey WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))
SELECT n_nationkey AS node_no, '目标章节是："' || n_name || '"。' || chr(10) || '它属于："' || r_name || '"。' || chr(10) || '上一节：' || coalesce('"' || p || '"', '未找到相邻章节') || chr(10) || '下一节：' || coalesce('"' || q || '"', '未找到相邻章节') AS answer FROM n""")
def adjacency_answers(spark, sf):
    w = Window.partitionBy("doc").orderBy("node_no")
    return nations(spark, sf).select("node_no", D.adjacency_text(F.col("title"), F.col("parent_title"), F.lag("title").over(w), F.lead("title").over(w)).alias("answer"))


@query("""SELECT r_regionkey AS doc, '“' || r_name || '”包含以下章节：' || chr(10) || coalesce(string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey), '未找到直接子章节。') AS children, '【' || r_name || '】(ID: ' || r_regionkey || ') 的结构如下：' || coalesce(string_agg(chr(10) || i || '. ' || n_name, '' ORDER BY n_nationkey), '') AS tree,
coalesce('关联的章节节点有：' || chr(10) || string_agg(' - ' || n_name, chr(10) ORDER BY n_nationkey), '未找到相关联的路径节点。') AS path FROM region LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation WHERE n_regionkey <> 1) ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def structure_answers(spark, sf):
    """Children, tree and path of each region as texts; one region has none."""
    own = nations(spark, sf).where("doc <> 1").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_no", "title"))), lambda s: s["title"]).alias("titles"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("doc"), F.col("r_name").alias("title")).join(own, "doc", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    return r.select("doc", D.children_text(F.col("title"), F.col("titles")).alias("children"), D.tree_text(F.col("title"), F.col("doc"), F.col("titles")).alias("tree"), D.path_text(F.col("titles")).alias("path"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS line_no FROM lineitem), c AS (SELECT *, line_no / 8 AS confidence FROM l), o AS (SELECT *, confidence BETWEEN 0.45 AND 0.80 AS open, row_number() OVER (PARTITION BY doc, confidence BETWEEN 0.45 AND 0.80 ORDER BY line_no) AS n FROM c)
SELECT doc, line_no, CASE WHEN open AND n <= 2 AND doc % 2 = 0 THEN 'heading' ELSE 'body' END AS kind FROM o""")
def resolved_ambiguities(spark, sf):
    """Lines of middling confidence take what a model says, two a document at most; where it says nothing they stay."""
    signals = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no")).distinct().withColumn("confidence", F.col("line_no") / 8).withColumn("kind", F.lit("body"))
    return D.ambiguous(signals, most=2, decide=F.when(F.col("doc") % 2 == 0, "heading")).select("doc", "line_no", "kind")


@query()
def paragraph_segments(spark, sf):
    """Paragraphs packed for a model's chunker; held against brute force in the tests."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(D.paragraph_segments(F.coalesce("text", F.lit("")), 600)).alias("segment_no", "segment"))


@query("""SELECT l_orderkey, l_linenumber, (l_linenumber >= 2 AND l_linestatus = 'F') OR (l_linenumber >= 3 AND l_returnflag = 'N') AS noise FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linestatus, l_returnflag FROM lineitem)""")
def repeated_lines(spark, sf):
    """Titles count as noise from twice on, lines with bars from three times on, others never."""
    line = F.when(F.col("l_linestatus") == "F", "# Guide.md").when(F.col("l_returnflag") == "N", "a | b").otherwise("plain line")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag").distinct()
    return rows.select("l_orderkey", "l_linenumber", D.repeated_noise(line, F.col("l_linenumber"), F.lit("guide")).alias("noise"))


@query("""SELECT page_id AS doc, count(*) AS n FROM pages GROUP BY 1""")
def stored_trees(spark, sf):
    """Nodes and edges written by document and read back; one root a document."""
    path = files.shared_folder(spark, "trees")
    nodes = tree(spark, sf)
    nodes.write.parquet(f"{path}/nodes")
    D.edges(spark.read.parquet(f"{path}/nodes")).write.parquet(f"{path}/edges")
    stored = spark.read.schema(nodes.schema).parquet(f"{path}/nodes")
    return stored.where("parent_no is null").groupBy("doc").agg(F.count("*").alias("n"))
