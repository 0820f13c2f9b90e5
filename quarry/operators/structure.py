"""Documents into lines, signals, trees and chunks.

Lines and their classes are column expressions and windows. What carries state from line to line (headings' levels, list
nesting, overlaps, merges) runs as one pass over a document at a time; a document is the unit that never splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import text as T
from quarry.operators import trees

# --- lines and signals ------------------------------------------------------------------------------------------------

#: Patterns of line kinds, tried in this order (fixed values). Groups: code, title.
LINE_KINDS = [
    ("md_heading", r"^(#{1,6})\s+(.+)$"),
    ("step", r"^(?:第\s*([0-9一二三四五六七八九十]+)\s*步|步骤\s*([0-9一二三四五六七八九十]+)|[Ss]tep\s+([0-9]+))[:：.、\s]*(.*)$"),
    ("chapter", r"^(第[一二三四五六七八九十百零\d]+[章节条部分篇])\s*(.*)$"),
    ("appendix", r"^(附录\s*[A-Za-z0-9一二三四五六七八九十]*|[Aa]ppendix\s+[A-Za-z0-9]+)[:：.、\s]*(.*)$"),
    ("decimal", r"^(\d+(?:\.\d+)+)[.、\s]\s*(\S.*)$"),
    ("table", r"^\|.*\|\s*$"),
    ("quote", r"^>\s?(.*)$"),
    ("checkbox", r"^[-*+]\s+\[[ xX]\]\s+(.*)$"),
    ("bullet", r"^[-*+•·]\s+(.*)$"),
    ("digit", r"^(\d{1,3})[.)、）]\s*(\S.*)$"),
    ("cn_outline", r"^[（(]?([一二三四五六七八九十]+)[)）、.]\s*(\S.*)$"),
]
#: Page marks, and lines that are noise when they repeat: twice for notices, three times for footers (fixed values).
NOISE = r"^(?:第\s*\d+\s*页|page\s*\d+|\d+\s*/\s*\d+)$"
NOTICE = r"版权所有|未经授权|内部使用|copyright|all rights reserved|保密"
FOOTER = r"\bv\d+(?:\.\d+)*\b|版本|修订|rev\.?\s*\d+|\|"
FOOTER_LENGTH = 120
LIST_KINDS = ["step", "checkbox", "bullet", "digit", "cn_outline"]


def logical_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no (from 0), raw, line (trimmed), indent (a tab counts 4). Several inline steps on one line become lines of their own."""
    split_steps = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?<=[。；;])\s*(?=第[0-9一二三四五六七八九十]+步)", "\n")
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(split_steps, r"\r?\n")).alias("line_no", "raw"))
    lead = F.replace(F.regexp_extract("raw", r"^([ \t]*)", 1), F.lit("\t"), F.lit("    "))
    return lines.select("doc", "line_no", "raw", T.strip(F.col("raw")).alias("line"), F.length(lead).alias("indent"))


def line_frequency(lines: DataFrame) -> DataFrame:
    """doc, line, freq over non-blank lines."""
    return lines.where("line <> ''").groupBy("doc", "line").agg(F.count("*").alias("freq"))


def with_neighbours(lines: DataFrame) -> DataFrame:
    """prev and next: the nearest non-blank lines; blank_before, blank_after."""
    w, over = Window.partitionBy("doc").orderBy("line_no"), "IGNORE NULLS OVER (PARTITION BY doc ORDER BY line_no)"
    # offsets pass nulls over in one walk, where a frame to the end would be walked anew for each line
    return lines.withColumn("_known", F.when(F.col("line") != "", F.col("line"))).select(
        *lines.columns, F.expr(f"lag(_known) {over}").alias("prev"), F.expr(f"lead(_known) {over}").alias("next"),
        (F.coalesce(F.lag("line").over(w), F.lit("")) == "").alias("blank_before"), (F.coalesce(F.lead("line").over(w), F.lit("")) == "").alias("blank_after"),
    )


def comparable_title(c: Column) -> Column:
    """A title without heading marks, file suffix, white space and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(T.strip(c), r"^#+\s*", ""), r"\.[A-Za-z0-9]{1,6}$", ""), r"(?U)\s+", ""))


def repeated_noise(line: Column, freq: Column, title: Column | None = None) -> Column:
    """Lines that repeat: the document's title or a notice from twice on, a footer or a row of cells from three times on."""
    low = F.lower(line)
    same = F.lit(False) if title is None else (comparable_title(title) != "") & (comparable_title(title) == comparable_title(line))
    twice = (freq >= 2) & (same | F.regexp(low, F.lit(NOTICE)))
    return F.coalesce((line != "") & (twice | ((freq >= 3) & (F.length(line) <= FOOTER_LENGTH) & F.regexp(low, F.lit(FOOTER)))), F.lit(False))


def classify_lines(lines: DataFrame, title: Column | None = None) -> DataFrame:
    """kind, code, title, level and confidence of each line (with_neighbours and freq as inputs are added here).

    Page marks and repeated notices, footers and titles are noise; `title` is the document's title, as a column of lines. A
    short line on its own without end punctuation is a plain heading.
    """
    # counts by (doc, line) and neighbours by doc need one shuffle by doc, which also serves the tree behind
    counted = lines.repartition("doc").withColumn("freq", F.when(F.col("line") != "", F.count("*").over(Window.partitionBy("doc", "line"))))
    full = with_neighbours(counted)
    line = F.col("line")
    noise = F.regexp(F.lower(line), F.lit(NOISE)) | repeated_noise(line, F.col("freq"), title)
    kind = F.when(line == "", "blank").when(F.coalesce(noise, F.lit(False)), "noise")
    for name, pattern in LINE_KINDS:
        kind = kind.when(F.regexp(line, F.lit(pattern)), name)
    plain = (F.length(line) <= 30) & ~F.regexp(line, F.lit(r"[。！？.!?；;，,：:]$")) & F.col("blank_before") & F.col("next").isNotNull()
    kind = kind.when(plain, "plain_heading").otherwise("body")
    extract = lambda g: {n: F.regexp_extract(line, p, g) for n, p in LINE_KINDS if n in ("chapter", "appendix", "decimal", "digit", "cn_outline")}
    code, title = F.when(F.lit(False), ""), F.when(F.col("kind") == "md_heading", F.regexp_extract(line, LINE_KINDS[0][1], 2))
    for n, c in extract(1).items():
        code = code.when(F.col("kind") == n, c)
    for n, c in extract(2).items():
        title = title.when(F.col("kind") == n, c)
    step = F.coalesce(*[F.nullif(F.regexp_extract(line, LINE_KINDS[1][1], g), F.lit("")) for g in (1, 2, 3)])
    level = F.when(F.col("kind") == "md_heading", F.length(F.regexp_extract(line, "^(#+)", 1))).when(F.col("kind").isin("chapter", "appendix"), 1)
    level = level.when(F.col("kind") == "decimal", F.size(F.split(F.regexp_extract(line, r"^(\d+(?:\.\d+)+)", 1), r"\."))).when(F.col("kind") == "plain_heading", 2)
    sure = F.when(F.col("kind").isin("md_heading", "chapter", "table", "quote", "checkbox"), 0.95).when(F.col("kind") == "plain_heading", 0.6).when(F.col("kind").isin("digit", "cn_outline"), 0.75).otherwise(0.9)
    out = full.withColumn("kind", kind)
    return out.withColumn("code", F.when(F.col("kind") == "step", step).otherwise(code)).withColumn("title", F.when(F.col("kind") == "plain_heading", line).otherwise(title)).withColumn("level", level).withColumn("confidence", sure)


def ambiguous(signals: DataFrame, low: float = 0.45, high: float = 0.80, most: int = 8, decide: Column | None = None) -> DataFrame:
    """Signals whose confidence lies between get `decide`'s kind, the first `most` of a document; without it they keep their own."""
    if decide is None:
        return signals
    open_ = (F.col("confidence") >= low) & (F.col("confidence") <= high)
    n = F.row_number().over(Window.partitionBy("doc", open_).orderBy("line_no"))
    return signals.withColumn("_n", n).withColumn("kind", F.when(open_ & (F.col("_n") <= most), F.coalesce(decide, F.col("kind"))).otherwise(F.col("kind"))).drop("_n")


# --- tree -------------------------------------------------------------------------------------------------------------

NODES = (
    "doc {doc}, node_no int, node_type string, parent_no int, prev_no int, next_no int, depth int, node_code string, title string, "
    "section_path string, canonical_path string, content string, item_index int, enter int, leave int"
)


def repaired_parents(nodes: list[tuple[str, str, int | None]]) -> list[int | None]:
    """Parents of the nodes (type, code, parent) of one document, the root first.

    A section with one number goes below the root; with several, below the first section that has its prefix, or else its
    first number. A parent that doesn't exist gives way to the root, and a section never hangs below an item.
    """
    numeric = [tuple(c.split(".")) if t == "section" and re.fullmatch(r"\d+(\.\d+)*", c or "") else () for t, c, _ in nodes]
    first: dict[tuple, int] = {}
    for k, path in enumerate(numeric):
        if path:
            first.setdefault(path, k)
    out: list[int | None] = []
    for k, ((kind, _, parent), path) in enumerate(zip(nodes, numeric, strict=True)):
        if k == 0:
            out.append(None)
            continue
        known = first.get(path[:-1], first.get(path[:1])) if len(path) > 1 else 0 if path else None
        parent = known if known is not None and known != k else parent
        parent = parent if parent is not None and 0 <= parent < len(nodes) and parent != k else 0
        while kind == "section" and nodes[parent][0] in ("list_item", "step"):
            parent = nodes[parent][2] or 0
        out.append(parent)
    return out


def below_root(parents: list[int | None]) -> list[int]:
    """All nodes but the root, each behind its parent; nodes that only hang on each other are hung below the root first."""
    children: dict[int | None, list[int]] = {}
    for k, p in enumerate(parents):
        children.setdefault(p, []).append(k)
    order, queue, seen = [], [0], {0}
    while len(order) < len(parents) - 1 or queue:
        if not queue:
            lost = next(k for k in range(len(parents)) if k not in seen)
            children[parents[lost]].remove(lost)
            parents[lost] = 0
            queue, order = [lost], [*order, lost]
            seen.add(lost)
        at = queue.pop(0)
        for k in children.get(at, []):
            if k not in seen:
                seen.add(k)
                order.append(k)
                queue.append(k)
    return order


def interval_ends(children: dict[int, list[int]], n: int) -> tuple[list[int], list[int]]:
    """enter and leave of the nodes of a tree below 0 (see trees.numbered)."""
    enter, leave, left, stack = [0] * n, [0] * n, n, [(0, False)]
    while stack:
        at, done = stack.pop()
        if done:
            leave[at] = left
            continue
        enter[at] = left
        left -= 1
        stack.append((at, True))
        stack += [(c, False) for c in reversed(children.get(at, []))]
    return enter, leave


def grown(lines: Iterable[tuple]) -> list[dict]:
    """The node rows (but doc) of one document's lines (kind, line, code, title, level, indent), in their order."""
    nodes = []
    stack: list[tuple[int, int]] = [(0, 0)]
    items: list[tuple[int, int]] = []
    counts: dict[int, int] = {}

    def add(node_type: str, parent: int | None, code: str, title: str, index: int | None) -> int:
        nodes.append({"node_no": len(nodes), "node_type": node_type, "parent_no": parent, "prev_no": None, "next_no": None, "depth": 0, "node_code": code or "", "title": title or "", "section_path": "", "canonical_path": "", "content": [], "item_index": index})
        return len(nodes) - 1

    add("document", None, "", "", None)
    for kind, line, code, title, level, indent in lines:
        if kind == "noise":
            continue
        if kind == "blank":
            items = []
            continue
        if level is not None and kind not in LIST_KINDS:
            while stack[-1][0] >= level and len(stack) > 1:
                stack.pop()
            stack.append((level, add("section", stack[-1][1], code, title, None)))
            items = []
            continue
        section = stack[-1][1]
        nodes[section]["content"].append(line)
        if kind in LIST_KINDS:
            while items and items[-1][0] >= indent:
                items.pop()
            parent = items[-1][1] if items else section
            counts[parent] = counts.get(parent, 0) + 1
            no = add("step" if kind == "step" else "list_item", parent, code, line, counts[parent])
            nodes[no]["content"].append(line)
            items.append((indent, no))
        elif items:
            nodes[items[-1][1]]["content"].append(line)
    repair = repaired_parents([(n["node_type"], n["node_code"], n["parent_no"]) for n in nodes])
    order = below_root(repair)
    children: dict[int, list[int]] = {}
    for k in order:
        n, above = nodes[k], nodes[repair[k]]
        n["parent_no"], n["depth"] = repair[k], above["depth"] + 1
        children.setdefault(repair[k], []).append(k)
        name = f"{n['node_code']} {n['title']}".strip()
        n["section_path"] = " > ".join(filter(None, [above["section_path"], name]))
        slug = "".join(c if c.isalnum() or c in "._-" else "-" for c in name.lower()).strip("-") or "node"
        n["canonical_path"] = f"{above['canonical_path']}/{slug}"
    for own in children.values():
        own.sort()
        for a, b in zip(own, own[1:], strict=False):
            nodes[a]["next_no"], nodes[b]["prev_no"] = b, a
    for n, enter, leave in zip(nodes, *interval_ends(children, len(nodes)), strict=True):
        n["content"], n["enter"], n["leave"] = "\n".join(n["content"]), enter, leave
    return nodes


def build_tree(signals: DataFrame, together: bool = False) -> DataFrame:
    """The node rows of each document from its classified lines.

    A heading closes deeper levels; list items nest by indent; a blank line ends a list; a list line's text belongs to its
    item and to the section. A lone first heading equal to the document's title stays the root's child. Then sections with
    numeric codes go below the section of their prefix (see repaired_parents); depths, paths, siblings and intervals (enter,
    leave: see trees.numbered) follow. A task walks its lines once and holds one document. together: each document's lines are
    in one partition already, as classify_lines leaves them, so they need no shuffle.
    """
    kind = signals.schema["doc"].dataType
    schema = NODES.format(doc=kind.simpleString())
    names = ["kind", "line", "code", "title", "level", "indent"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for doc, line in zip(columns[0], zip(*columns[1:], strict=True), strict=True):
                if held and doc != now:
                    rows += [{"doc": now, **n} for n in grown(held)]
                    held = []
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows = []
                now = doc
                held.append(line)
        if held:
            rows += [{"doc": now, **n} for n in grown(held)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, fields)

    fields = to_arrow_schema(StructType.fromDDL(schema))
    dealt = signals if together else signals.repartition("doc")
    return dealt.sortWithinPartitions("doc", "line_no").select("doc", *names).mapInArrow(walk, schema)


def edges(nodes: DataFrame) -> DataFrame:
    """doc, source, target, type: HAS_SECTION or HAS_ITEM by the child's type, and NEXT between siblings."""
    child = F.when(F.col("node_type") == "section", "HAS_SECTION").otherwise("HAS_ITEM")
    down = nodes.where("parent_no is not null").select("doc", F.col("parent_no").alias("source"), F.col("node_no").alias("target"), child.alias("type"))
    return down.unionByName(nodes.where("next_no is not null").select("doc", F.col("node_no").alias("source"), F.col("next_no").alias("target"), F.lit("NEXT").alias("type")))


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc, root, node_no, distance: the roots (doc, root) and everything below them, at any depth, by a range join.

    The nodes of build_tree carry their intervals; others (doc, node_no, parent_no) are numbered first. Roots that are no
    nodes give nothing; a cycle raises an error.
    """
    labelled = nodes.withColumn("level", F.col("depth")) if {"enter", "leave", "depth"} <= set(nodes.columns) else trees.numbered(nodes)
    return trees.below(labelled, roots)


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed if the session names a folder for that."""
    context = df.sparkSession.sparkContext
    where = context.getConf().get("spark.checkpoint.dir")
    if where and not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return df.checkpoint() if context.getCheckpointDir() else df


def items_below(nodes: DataFrame, roots: DataFrame, word: str | None = None, index: int | None = None) -> DataFrame:
    """Distinct items below the roots in the order of nodes; those that hold a word, or the index-th one of its parent."""
    below = subtree(nodes, roots).where("distance > 0").select("doc", "root", "node_no").distinct().join(nodes, ["doc", "node_no"]).where(F.col("node_type").isin("list_item", "step"))
    below = below if word is None else below.where(F.contains(F.lower("content"), F.lit(word.lower())))
    return below if index is None else below.where(F.col("item_index") == index)


def node_context(nodes: DataFrame) -> DataFrame:
    """doc, node_no, parent_title, prev_title, next_title, children (array of titles)."""
    name = lambda c, n: nodes.select("doc", F.col("node_no").alias(c), F.col("title").alias(n))
    children = nodes.where("parent_no is not null").groupBy("doc", F.col("parent_no").alias("node_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_no", "title"))), lambda s: s["title"]).alias("children"))
    out = nodes.select("doc", "node_no", "title", "parent_no", "prev_no", "next_no")
    for c, n in (("parent_no", "parent_title"), ("prev_no", "prev_title"), ("next_no", "next_title")):
        out = out.join(name(c, n), ["doc", c], "left")
    return out.join(children, ["doc", "node_no"], "left").select("doc", "node_no", "title", "parent_title", "prev_title", "next_title", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def find_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, doc, node_no, how: the nodes that a question names. wanted: query, doc, code, title, path (NULL: not asked for).

    By code first, then by title, then by the canonical path; of several the first in the order of nodes.
    """
    same = lambda a, b: F.lower(F.trim(a)) == F.lower(F.trim(b))
    by = {"code": same("code", "node_code"), "title": same("wanted_title", "title"), "path": F.startswith("canonical_path", F.col("path"))}
    asked = wanted.withColumnRenamed("title", "wanted_title")
    met = asked.join(nodes.select("doc", "node_no", "node_code", "title", "canonical_path"), "doc")
    how = F.coalesce(*[F.when(c, F.struct(F.lit(i).alias("i"), F.lit(k).alias("how"))) for i, (k, c) in enumerate(by.items())])
    best = met.withColumn("h", how).where("h is not null").groupBy("query", "doc").agg(F.min(F.struct("h.i", "node_no", "h.how")).alias("b"))
    return best.select("query", "doc", "b.node_no", "b.how")


def adjacency_text(title: Column, parent: Column, prev: Column, next_: Column) -> Column:
    """What a question for a section's neighbours is answered with."""
    named = lambda c: F.when(c.isNull(), "未找到相邻章节").otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    return F.concat_ws(
        "\n", F.concat(F.lit('目标章节是："'), title, F.lit('"。')), F.when(parent.isNotNull(), F.concat(F.lit('它属于："'), parent, F.lit('"。'))),
        F.concat(F.lit("上一节："), named(prev)), F.concat(F.lit("下一节："), named(next_)),
    )


def children_text(title: Column, children: Column) -> Column:
    head = F.concat(F.lit("“"), title, F.lit("”包含以下章节：\n"))
    return F.concat(head, F.when(F.size(children) > 0, F.array_join(F.transform(children, lambda c: F.concat(F.lit("- "), c)), "\n")).otherwise("未找到直接子章节。"))


def tree_text(title: Column, doc: Column, sections: Column) -> Column:
    named = F.transform(sections, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(s, F.lit("")), F.lit("未命名章节"))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("【"), title, F.lit("】(ID: "), doc.cast("string"), F.lit(") 的结构如下："))), named), "\n")


def path_text(titles: Column) -> Column:
    named = F.transform(titles, lambda t: F.concat(F.lit(" - "), F.coalesce(F.nullif(t, F.lit("")), F.lit("未命名章节"))))
    return F.when(F.size(titles) > 0, F.array_join(F.concat(F.array(F.lit("关联的章节节点有：")), named), "\n")).otherwise("未找到相关联的路径节点。")


def render_outline(nodes: DataFrame) -> DataFrame:
    """doc, outline: titles of sections, two spaces a level. A document's sections are bounded by its lines."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), F.concat_ws(" ", F.nullif("node_code", F.lit("")), "title"))
    ordered = F.array_sort(F.collect_list(F.struct("node_no", line.alias("x"))))
    return nodes.where("node_type = 'section'").groupBy("doc").agg(F.array_join(F.transform(ordered, lambda s: s["x"]), "\n").alias("outline"))


# --- chunks -----------------------------------------------------------------------------------------------------------


def structure_chunks(nodes: DataFrame, least: int = 50) -> DataFrame:
    """doc, node_no, chunk_no, section_path, text: one chunk for each section with enough text of its own."""
    kept = nodes.where(F.col("node_type").isin("document", "section") & (F.length("content") >= least))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("node_no"))
    return kept.select("doc", "node_no", n.alias("chunk_no"), "section_path", F.col("content").alias("text"))


def merge_groups(sizes: Column, target: int = 320, most: int = 512) -> Column:
    """Group numbers (from 0) of neighbouring pieces by their sizes: a group ends at the target, or before it would pass `most`."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("group"), F.lit(0).alias("n"), F.lit(False).alias("begun"))

    def add(acc: Column, size: Column) -> Column:
        full = acc["begun"] & (acc["n"] + size > most)
        group = acc["group"] + full.cast("int")
        held = F.when(full, size).otherwise(acc["n"] + size)
        done = held >= target
        return F.struct(F.concat(acc["out"], F.array(group)).alias("out"), (group + done.cast("int")).alias("group"), F.when(done, 0).otherwise(held).cast("int").alias("n"), (~done).alias("begun"))

    return F.aggregate(sizes, start, add, lambda acc: acc["out"])


def merged_sections(nodes: DataFrame, least: int = 50, target: int = 320, most: int = 512) -> DataFrame:
    """doc, node_no (of the first node), chunk_no, section_path, text: neighbouring nodes merged up to a size in tokens.

    A document's nodes are bounded by its lines, so its fold is one row's work.
    """
    text = T.strip(F.coalesce("content", F.lit("")))
    rows = nodes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("node_no", "section_path", text.alias("text")))).alias("n"))
    grouped = rows.withColumn("g", merge_groups(F.transform("n", lambda x: T.count_tokens(x["text"])), target, most))
    pieces = grouped.select("doc", F.explode(F.zip_with("n", "g", lambda n, g: F.struct(g.alias("g"), n["node_no"].alias("node_no"), n["section_path"].alias("section_path"), n["text"].alias("text")))).alias("p")).select("doc", "p.*")
    whole = pieces.groupBy("doc", "g").agg(F.min(F.struct("node_no", "section_path")).alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("node_no", "text")))), lambda x: x["text"]), "\n").alias("text"))
    kept = whole.where(F.length("text") >= least)
    return kept.select("doc", "head.node_no", F.row_number().over(Window.partitionBy("doc").orderBy("g")).alias("chunk_no"), "head.section_path", "text")


def sentence_chunks(docs: DataFrame, size: int = 512, least: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, chunk_no (from 1), text: sentences packed up to `size` characters; shorter rests than `least` drop out."""
    parts = F.filter(T.pack_sentences(T.sentences(F.coalesce(F.col(text), F.lit(""))), size), lambda x: F.length(x) >= least)
    return docs.select(F.col(key).alias("doc"), F.posexplode(parts).alias("_p", "text")).select("doc", (F.col("_p") + 1).alias("chunk_no"), "text")


def with_overlap(parts: Column, size: int = 128) -> Column:
    """Each chunk led by the last `size` characters of the chunk before, as that one was already led, and a line end.

    A fold over the chunks of one parent; a chunk that starts so already stays as it is.
    """
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        tail = F.right(acc["last"], F.lit(size))
        led = F.when((acc["last"] == "") | F.startswith(x, tail), x).otherwise(F.concat(tail, F.lit("\n"), x))
        return F.struct(led.alias("last"), F.concat(acc["out"], F.array(led)).alias("out"))

    return F.aggregate(parts, start, add, lambda acc: acc["out"])


def overlapped_chunks(chunks: DataFrame, size: int = 128) -> DataFrame:
    """chunks (doc, chunk_no, text) with overlaps inside each document."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    whole = chunks.groupBy("doc").agg(ordered.alias("c"))
    led = whole.select("doc", "c", with_overlap(F.transform("c", lambda s: s["text"]), size).alias("o"))
    return led.select("doc", F.explode(F.zip_with("c", "o", lambda c, o: F.struct(c["chunk_no"].alias("chunk_no"), o.alias("text")))).alias("x")).select("doc", "x.*")


def merge_semantic(chunks: DataFrame, least: float = 0.75, most_tokens: int = 1024, lexical: float | None = None) -> DataFrame:
    """Neighbouring chunks of one parent joined while they stay alike and within the length.

    chunks: doc, parent, chunk_no, text and, unless `lexical` is given, vector. Likeness is the cosine with the merged
    chunks' length-weighted centroid, or the Jaccard index of their words from `lexical` (0.18 is usual). A parent's chunks pass
    in their order with one merged chunk in hand; a null text counts as empty.
    """
    import numpy as np

    doc, parent = (chunks.schema[c].dataType.simpleString() for c in ("doc", "parent"))
    schema = StructType.fromDDL(f"doc {doc}, parent {parent}, chunk_no int, text string")
    arrow = to_arrow_schema(schema)

    def alike(a, b) -> float:
        if lexical is not None:
            return len(a & b) / len(a | b) if a | b else 1.0
        scale = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(a @ b) / scale if len(a) == len(b) and scale else 0.0

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            done = []
            for doc, parent, text, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(text)
                state = np.asarray(vector, dtype=float) if lexical is None else set(text.lower().split())
                same = last is not None and (doc, parent) == now
                if same and last["n"] + n <= most_tokens and alike(last["state"], state) >= (least if lexical is None else lexical):
                    last["text"] += "\n" + text
                    last["state"] = (last["state"] * last["n"] + state * n) / max(1, last["n"] + n) if lexical is None else last["state"] | state
                    last["n"] += n
                    continue
                if last is not None:
                    done.append((*now, last["no"], last["text"]))
                last = {"no": last["no"] + 1 if same else 1, "text": text, "n": n, "state": state}
                now = (doc, parent)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), arrow.types, strict=True)], schema=arrow)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now, last["no"], last["text"]), arrow.types, strict=True)], schema=arrow)

    held = F.col("vector") if lexical is None else F.lit(None).cast("array<double>")
    dealt = chunks.repartition("doc", "parent").sortWithinPartitions("doc", "parent", "chunk_no")
    return dealt.select("doc", "parent", F.coalesce("text", F.lit("")).alias("text"), held.alias("vector")).mapInArrow(walk, schema)


def paragraph_segments(c: Column, size: int = 4000) -> Column:
    """Paragraphs packed into segments for a model's chunker; a fold in the row."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        over = (acc["open"] != "") & (F.length(acc["open"]) + F.length(p) + 2 > size)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return F.struct(F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(over, p).otherwise(joined).alias("open"))

    return F.aggregate(T.paragraphs(c), start, add, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def context_window(chunks: DataFrame, size: int = 200) -> DataFrame:
    """Each chunk with the end of the one before and the start of the one after."""
    w = Window.partitionBy("doc").orderBy("chunk_no")
    return chunks.withColumn("before", F.right(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit(size))).withColumn("after", F.substring(F.coalesce(F.lead("text").over(w), F.lit("")), 1, size))


def recommend_strategy(headings: Column, level: Column, length: Column, n_paragraphs: Column) -> Column:
    """Chunking strategies of a document, the first one for the parents."""
    return F.when((level >= 2) & (headings >= 3), F.array(F.lit("structure"), F.lit("recursive"))).when((n_paragraphs >= 5) & (length >= 2000), F.array(F.lit("recursive"), F.lit("semantic"))).otherwise(F.array(F.lit("recursive")))


def chunk_pipeline(docs: DataFrame, size: int = 512, overlap: int = 128, lexical: float = 0.18) -> DataFrame:
    """Sections as parents, packed sentences as children with overlaps, likely ones merged: doc, parent, chunk_no, text."""
    nodes = build_tree(classify_lines(logical_lines(docs)), together=True)
    parents = structure_chunks(nodes, 1)
    parts = F.filter(T.pack_sentences(T.sentences(F.col("text")), size), lambda x: F.length(x) > 0)
    children = parents.select("doc", F.col("node_no").alias("parent"), F.posexplode(parts).alias("chunk_no", "text"))
    merged = merge_semantic(children, lexical=lexical)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    led = merged.groupBy("doc", "parent").agg(ordered.alias("c")).select("doc", "parent", F.posexplode(with_overlap(F.transform("c", lambda s: s["text"]), overlap)).alias("_p", "text"))
    return led.select("doc", "parent", (F.col("_p") + 1).alias("chunk_no"), "text")


def next_version(plans: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, version: one above the largest of the active plans, 1 for none."""
    return plans.groupBy(doc).agg((F.coalesce(F.max(F.when(F.col("status") == 1, F.col("version"))), F.lit(0)) + 1).alias("version"))
