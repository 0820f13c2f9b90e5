"""Readers and connectors: files of many kinds as (path, name, text), tables as Markdown, archives, crawls and sinks."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources import formats
from quarry.sources.formats import table_markdown

#: Encodings that are tried in this order (fixed values); the last resort replaces what is broken.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "big5")
TEXTS, PAGES, TABLES = {"txt", "md", "markdown", "log"}, {"html", "htm"}, {"csv"}
#: Adapters of formats: suffix -> bytes to text. The plain ones here; register what else a cluster has.
ADAPTERS: dict[str, Callable[[bytes], str]] = {"docx": formats.docx_text, "pptx": formats.pptx_text, "xlsx": formats.xlsx_text, "pdf": formats.pdf_text}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one (spark.checkpoint.dir), or in local mode below a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='files-')}"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new shared folder, so that it is worked out once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_index(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of a stored index, with a declared schema; of the columns asked for only."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if columns is None else rows.select(*columns)


def decoded(raw: bytes) -> str:
    for e in ENCODINGS:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def read_folder(spark: SparkSession, path: str, suffixes: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """path, name, suffix, size, content of all files below a folder of any store that Spark reads; hidden and `~$` files are passed over.

    most: a connector's limit of files, by path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), F.col("length").alias("size"), "content")
    out = out.where(~F.regexp("name", F.lit(r"^(\.|~\$)")))
    out = out if suffixes is None else out.where(F.col("suffix").isin([s.lower().lstrip(".") for s in suffixes]))
    return out if most is None else out.orderBy("path").limit(most)


def parse_files(files: DataFrame, most_rows: int = 1000) -> DataFrame:
    """path, name, text, error: the text of each file by its suffix, cleaned; what fails or has no adapter is read as plain text.

    CSV keeps a header and most_rows - 1 rows, as the reader's feature, and the adapter of sheets 500 rows each.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for frame in frames:
            texts, errors = [], []
            for suffix, raw in zip(frame["suffix"], frame["content"], strict=True):
                error = None
                try:
                    if suffix in TABLES:
                        rows = []
                        for row in csv.reader(io.StringIO(decoded(raw), newline="")):
                            rows.append(row)
                            if len(rows) == most_rows:
                                break
                        text = table_markdown(rows)
                    elif suffix in ADAPTERS:
                        text = ADAPTERS[suffix](raw)
                    else:
                        text = decoded(raw)
                        error = None if suffix in TEXTS | PAGES else f"no adapter for {suffix}"
                except Exception as e:
                    text, error = decoded(raw), str(e)[:200]
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": frame["path"], "name": frame["name"], "suffix": frame["suffix"], "text": texts, "error": errors})

    parsed = files.select("path", "name", "suffix", "content").mapInPandas(parse, "path string, name string, suffix string, text string, error string")
    text = F.when(F.col("suffix").isin(*PAGES), T.page_text(F.col("text"))).otherwise(T.clean_text(F.col("text")))
    return parsed.select("path", "name", text.alias("text"), "error")


def unzip(files: DataFrame) -> DataFrame:
    """path, name, suffix, size, content of the members of zip archives; folders and hidden files out. One archive is one task's work."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for info in z.infolist():
                        name = info.filename.rsplit("/", 1)[-1]
                        if info.is_dir() or not name or name.startswith((".", "~$")):
                            continue
                        suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                        yield pd.DataFrame({"path": [f"{path}!/{info.filename}"], "name": [name], "suffix": [suffix], "size": [info.file_size], "content": [z.read(info)]})

    return files.select("path", "content").mapInPandas(members, "path string, name string, suffix string, size long, content binary")


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def eval_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Evaluation sets in JSON: one array a file, or an object a line."""
    schema = "id string, question string, ground_truth_answer string, relevant_contexts array<string>, relevant_chunk_ids array<string>, relevant_parent_ids array<string>, answerable boolean, expected_refusal boolean, gold_mode string, metadata map<string,string>"
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def crawl(seeds: DataFrame, pages: DataFrame, depth: int = 2, disallow: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """url, depth reached from seeds (url) along the links of pages (url, html), on the seeds' hosts, without disallowed prefixes.

    A frontier at a time: one join finds the next one, an anti join leaves out what is known, so cycles end. disallow: host, prefix.
    """
    links = pages.select(T.normalize_url(F.col("url")).alias("source"), F.explode(T.page_links(F.col("html"), F.col("url"))).alias("raw"))
    links = links.select("source", T.normalize_url(F.col("raw")).alias("url")).where("url <> ''").distinct()
    found = seeds.select(T.normalize_url(F.col("url")).alias("url")).where("url <> ''").distinct().withColumn("depth", F.lit(0))
    hosts = found.select(T.url_host(F.col("url")).alias("_h")).distinct()
    links = links.join(hosts, T.url_host(F.col("url")) == F.col("_h"), "left_semi")
    if disallow is not None:
        path = F.regexp_extract("url", r"^https?://[^/]*(/[^?]*)", 1)
        rules = disallow.where("prefix <> ''").select(F.lower("host").alias("_h"), "prefix")
        links = links.join(rules, (T.url_host(F.col("url")) == F.col("_h")) & F.startswith(path, F.col("prefix")), "left_anti")
    for d in range(1, depth + 1):
        edge = found.where(F.col("depth") == d - 1).select(F.col("url").alias("source"))
        fresh = links.join(edge, "source", "left_semi").select("url").distinct().join(found, "url", "left_anti").withColumn("depth", F.lit(d))
        found = found.unionByName(fresh)
    return found if most is None else found.orderBy("depth", "url").limit(most)


def sitemap_urls(maps: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct page urls of sitemaps (url, xml), following maps of maps of any depth; each map is read once, so cycles end.

    A frontier at a time, written to the shared folder, until no new map turns up.
    """
    spark = maps.sparkSession
    folder = shared_folder(spark, "sitemaps")
    locs = maps.select("url", F.contains("xml", F.lit("<sitemapindex")).alias("index"), F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"))
    known, fresh, depth = None, roots.select("url").distinct(), 0
    while True:
        fresh.write.parquet(f"{folder}/{depth}")
        last = spark.read.parquet(f"{folder}/{depth}")
        if last.isEmpty():
            break
        known = last if known is None else known.unionByName(last)
        fresh = locs.where("index").join(last, "url", "left_semi").select(F.col("loc").alias("url")).distinct().join(known, "url", "left_anti")
        depth += 1
    found = locs.where("not index")
    return (found.limit(0) if known is None else found.join(known, "url", "left_semi")).select(F.col("loc").alias("url")).distinct()


def robots_rules(robots: DataFrame) -> DataFrame:
    """host, prefix of all Disallow lines (of all agents). robots: host, text."""
    lines = robots.select("host", F.explode(F.split("text", r"\r?\n")).alias("line"))
    return lines.select("host", F.trim(F.regexp_extract("line", r"(?i)^\s*disallow\s*:\s*([^#\s]*)", 1)).alias("prefix")).where("prefix <> ''").distinct()


def write_by_document(df: DataFrame, path: str, key: str = "source") -> None:
    """Overwrite only the partitions that df brings."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def per_file_rows(rows: DataFrame, most: int = 999, path: str = "path", order: str = "row") -> DataFrame:
    """The first rows of each file."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(path).orderBy(order))).where(F.col("_n") <= most).drop("_n")
