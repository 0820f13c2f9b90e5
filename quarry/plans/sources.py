"""Queries of readers and sinks: tables written as files of many kinds, and read back."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import upkeep as U
from quarry.registry import query, table
from quarry.sources import documents, files


@query("SELECT n_regionkey AS region, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|x |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def csv_files(spark, sf):
    """Tables in CSV files, one a region, as Markdown; bars are escaped."""
    path = files.shared_folder(spark, "csv")
    n = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.concat("n_name", F.lit("|x")).alias("n_name"))
    n.repartition(8, "n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").write.partitionBy("n_regionkey").option("header", "true").csv(path)
    read = files.parse_files(files.read_folder(spark, path, ["csv"]))
    return read.select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("int").alias("region"), "text")


@query("SELECT n_regionkey AS region, string_agg(n_name || ' é', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def text_files(spark, sf):
    """Lines in text files, one a region; hidden files are passed over."""
    path = files.shared_folder(spark, "text")
    n = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.concat("n_name", F.lit("   é")).alias("value"))
    n.repartition(8, "n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey").drop("n_nationkey").write.partitionBy("n_regionkey").text(path)
    read = files.parse_files(files.read_folder(spark, path, ["txt"]))
    return read.select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("int").alias("region"), "text")


def stored_documents(spark, name, rows):
    """Rows of path and content written and read again in the format of documents; returns the reader's frame."""
    documents.register(spark)
    folder = files.shared_folder(spark, name)
    rows.write.format("documents").mode("append").save(folder)
    return lambda **options: spark.read.format("documents").options(**options).load(folder)


def page_files(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("content"))


def number_of(path):
    return F.regexp_extract(path, r"(\d+)\.[a-z]+$", 1).cast("long")


@query("SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS sha FROM pages WHERE page_id % 3 = 0 AND octet_length(encode(coalesce(html, ''))) > 100")
def crawl_documents(spark, sf):
    """A crawl in folders by host: the pages under one suffix and above a size, which the listing finds without opening a file."""
    host = F.coalesce(F.nullif(T.url_host(F.col("url")), F.lit("")), F.lit("none"))
    suffix = F.when(F.col("page_id") % 3 == 0, ".html").otherwise(".txt")
    read = stored_documents(spark, "crawl", page_files(spark, sf).select(F.concat(host, F.lit("/"), F.col("page_id").cast("string"), suffix).alias("path"), "content"))
    return read().where("suffix = 'html' AND size > 100").select(number_of("path").alias("page_id"), "size", F.sha2("content", 256).alias("sha"))


@query("SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS sha, page_id // 100 AS archive FROM pages")
def archived_documents(spark, sf):
    """Pages in zip archives of a hundred, each member a row."""
    import io
    import zipfile

    import pyarrow as pa

    def packed(rows: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, content in zip(rows["page_id"].to_pylist(), rows["content"].to_pylist(), strict=True):
                z.writestr(f"in/{k}.html", content)
        return pa.table({"path": [f"pages-{rows['archive'][0].as_py()}.zip"], "content": [out.getvalue()]})

    archives = page_files(spark, sf).select("page_id", "content", F.expr("page_id div 100").alias("archive")).groupBy("archive").applyInArrow(packed, "path string, content binary")
    read = stored_documents(spark, "archives", archives)
    return read(partBytes="1000000").select(number_of("path").alias("page_id"), "size", F.sha2("content", 256).alias("sha"), F.regexp_extract("path", r"pages-(\d+)\.zip!", 1).cast("long").alias("archive"))


@query("WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size FROM documents) SELECT doc_id, size, part, least(1000, size - 1000 * part) AS length FROM (SELECT *, unnest(range(greatest((size + 999) // 1000, 1))) AS part FROM d)")
def documents_in_parts(spark, sf):
    """Files above a size as parts of it, each read by itself."""
    d = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    read = stored_documents(spark, "parts", d)
    return read(partBytes="1000").select(number_of("path").alias("doc_id"), "size", F.col("part").cast("long").alias("part"), F.octet_length("content").cast("long").alias("length"))


@query("SELECT item_id::VARCHAR AS id, text AS question, item_id % 2 = 0 AS answerable FROM benchmark")
def evaluation_sets(spark, sf):
    path = files.shared_folder(spark, "questions")
    b = table(spark, sf, "benchmark")
    b.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 2 == 0).alias("answerable"), F.lit("x").alias("unknown")).write.json(path)
    return files.eval_questions(spark, path, lines=True).select("id", "question", "answerable")


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_tables(spark, sf):
    """A table through CSV with a declared schema."""
    path = files.shared_folder(spark, "parts")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.option("header", "true").csv(path)
    return files.csv_rows(spark, path, "p_partkey long, p_name string, p_size int")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 3")
def first_rows(spark, sf):
    """The first three rows of each file (an order's lines)."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.struct("l_linenumber", "l_partkey").alias("row"), "l_orderkey", "l_linenumber", "l_partkey")
    return files.per_file_rows(rows, 3).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) % 2 = 0) THEN 'new' ELSE 'old' END AS version FROM documents")
def rewritten_partitions(spark, sf):
    """A store by source, of which only the sources that come anew are overwritten."""
    path = files.shared_folder(spark, "by-source")
    d = table(spark, sf, "documents").select("doc_id", "source")
    files.write_by_document(d.withColumn("version", F.lit("old")), path)
    again = d.groupBy("source").count().where("count % 2 = 0").select("source")
    files.write_by_document(d.join(again, "source", "left_semi").withColumn("version", F.lit("new")), path)
    return spark.read.schema("doc_id long, version string, source string").parquet(path).select("doc_id", "source", "version")


@query("SELECT doc_id AS chunk_id, 'c' || doc_id AS path FROM documents")
def index_scan(spark, sf):
    """A stored index read whole, two of its columns."""
    path = files.shared_folder(spark, "index")
    table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("path"), "text").write.parquet(path)
    return files.read_index(spark, path, "chunk_id long, path string, text string", ["chunk_id", "path"])


@query("SELECT 'http://site/n' || n_nationkey AS url FROM nation WHERE n_regionkey <> 4")
def sitemap_pages(spark, sf):
    """A map of maps, one for each region, which also names itself; one region's map is not listed."""
    n = table(spark, sf, "nation")
    loc = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit("</loc></url>"))
    leaves = n.groupBy("n_regionkey").agg(F.concat_ws("", F.collect_list(loc(F.concat(F.lit("http://site/n"), F.col("n_nationkey").cast("string"))))).alias("xml")).select(F.concat(F.lit("http://site/map"), F.col("n_regionkey").cast("string")).alias("url"), F.concat(F.lit("<urlset>"), "xml", F.lit("</urlset>")).alias("xml"))
    top = table(spark, sf, "region").where("r_regionkey <> 4").agg(F.concat_ws("", F.collect_list(loc(F.concat(F.lit("http://site/map"), F.col("r_regionkey").cast("string"))))).alias("xml"))
    root = top.select(F.lit("http://site/root").alias("url"), F.concat(F.lit("<sitemapindex>"), "xml", loc(F.lit("http://site/root")), F.lit("</sitemapindex>")).alias("xml"))
    return files.sitemap_urls(root.unionByName(leaves), root.select("url"))


@query("SELECT 'h' || n_regionkey AS host, '/' || n_name AS prefix FROM nation")
def robots_prefixes(spark, sf):
    """Disallowed prefixes of all agents, comments and empty rules out."""
    line = F.concat(F.lit("Disallow: /"), "n_name", F.lit(" # no"))
    text = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat_ws("\n", F.lit("User-agent: *"), F.collect_list(line), F.lit("disallow:"), F.lit("Allow: /x")).alias("text"))
    return files.robots_rules(text.select(F.concat(F.lit("h"), F.col("n_regionkey").cast("string")).alias("host"), "text"))


W_SQL = "w AS (SELECT doc_id AS chunk, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]') AS w FROM documents WHERE doc_id % 2 = 0)"


@query(f"WITH {W_SQL}, t AS (SELECT chunk, len(w) AS dl, unnest(w) AS term FROM w) SELECT chunk, term, dl, count(*) AS tf FROM t GROUP BY ALL")
def child_postings(spark, sf):
    """Postings of child chunks (every second document)."""
    c = table(spark, sf, "documents")
    return U.child_postings(c.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, "child").otherwise("parent").alias("chunk_type")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def deleted_documents(spark, sf):
    """Orders without those of the customers of one nation."""
    gone = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return U.delete_documents(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT doc_id AS chunk FROM documents WHERE doc_id % 10 = 0 AND regexp_matches(lower(coalesce(text, '')), '[a-z0-9\\x{4e00}-\\x{9fff}]')")
def missing_postings(spark, sf):
    """Chunks with words that a migrated index lacks."""
    from quarry.operators.lexical import sorted_postings

    d = table(spark, sf, "documents")
    return U.missing_postings(d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), sorted_postings(d.where("doc_id % 10 <> 0"), "doc_id", "text"))


@query("SELECT n_nationkey AS node_no, n_regionkey AS doc, n_name AS title, r_name || ' > ' || n_name AS section_path, 'doc' || r_name AS document_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 2 AND n_nationkey % 4 <> 1")
def section_index(spark, sf):
    """Rows of the section index after one document was deleted; items aren't indexed."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = n.select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("node_no"), F.when(F.col("n_nationkey") % 4 == 1, "list_item").otherwise("section").alias("node_type"), F.col("n_name").alias("title"), F.concat("r_name", F.lit(" > "), "n_name").alias("section_path"))
    docs = table(spark, sf, "region").select(F.col("r_regionkey").alias("doc"), F.concat(F.lit("doc"), "r_name").alias("document_name"))
    rows = U.section_rows(nodes, docs)
    return U.delete_documents(rows, docs.where("doc = 2"), "doc").select("node_no", "doc", "title", "section_path", "document_name")


@query("SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '', 'i'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120) AS slug FROM pages")
def url_slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_slug(F.col("url")).alias("slug"))


@query("SELECT o_custkey AS doc, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), 0) + 1 AS version FROM orders GROUP BY 1")
def plan_versions(spark, sf):
    from quarry.operators.structure import next_version

    return next_version(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderstatus") == "F").cast("int").alias("status"), F.col("o_orderkey").alias("version")))
