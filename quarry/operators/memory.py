"""Conversation memory: hints, transcripts, summaries, histories for planning and answering, and merged references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Lengths and numbers of the memory's parts (fixed values).
QUESTION, ANSWER, GOAL, ITEM, ITEMS, HIGHLIGHTS = 160, 320, 120, 80, 6, 4
WINDOW, SUMMARY, ANSWER_HISTORY, PLANNING_HISTORY = 2200, 1400, 1000, 1600
#: Words of a question that are no hints, and words that refer back (fixed values).
NOISE_HINTS = ["请问", "帮我", "一下", "如何", "怎么", "什么", "哪个", "这个", "那个", "可以", "需要"]
BACK_REFERENCES = "刚才 上面 前面 前文 上一条 上一个 上一轮 这个 那个 这条 那条 继续 展开 补充 详细 细说 进一步 为什么 怎么做 怎么理解 还有呢".split()
ORDINAL = r"第\s*[0-9一二三四五六七八九十百]+\s*(条|点|项)"
#: Sections of a planning history: title and column, in this order (fixed values); the first two hold a text, the others a list.
SECTIONS = [
    ("历史背景摘要", "summary"), ("会话目标", "goal"), ("用户偏好与约束", "preferences"), ("已确认事实", "facts"),
    ("已解决问题", "resolved"), ("待跟进问题", "pending"), ("检索提示", "hints"),
]


def clip(c: Column, most: int) -> Column:
    """Trimmed, and cut to `most` characters with an ellipsis at the end."""
    t = T.strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, max(0, most - 1)), F.lit("…"))).otherwise(t)


def clip_front(c: Column, most: int) -> Column:
    """Trimmed, and cut to the last `most` characters with an ellipsis in front."""
    t = T.strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.lit("…"), F.right(t, F.lit(most - 1)))).otherwise(t)


def retrieval_hints(question: Column, most: int = ITEMS, width: int = ITEM) -> Column:
    """Distinct Latin words and CJK runs of a question, noise words out, `most` at most."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("([a-zA-Z0-9._-]{2,}|[\\u4e00-\\u9fff]{2,12})"), F.lit(1))
    kept = F.filter(found, lambda h: ~h.isin(NOISE_HINTS))
    return F.slice(F.array_distinct(F.transform(kept, lambda h: clip(h, width))), 1, most)


def distinct_items(items: Column, most: int = ITEMS, width: int = ITEM) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: clip(x, width)), lambda x: x != "")), 1, most)


def _said(question: Column, answer: Column | None) -> Column:
    line = lambda who, c, n: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(who), clip(c, n)))
    parts = [line("用户：", question, QUESTION)] + ([line("助手：", answer, ANSWER)] if answer is not None else [])
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def ordered(order: str, *columns: str) -> Column:
    """Rows of a key in their order, as an array of structs; for keys of few rows (a window, a batch)."""
    return F.array_sort(F.collect_list(F.struct(order, *columns)))


def transcripts(turns: DataFrame, key: str = "conv_id", order: str = "turn", kind: str = "recent") -> DataFrame:
    """key, transcript of turns (key, order, question, answer), which are a window's or a batch's rows already.

    recent: questions and answers under a title, the end kept; answer: questions only, the end kept; compression: both,
    whole. Each line is clipped by its own limit.
    """
    rows = turns.groupBy(key).agg(ordered(order, "question", "answer").alias("r"))
    lines = F.flatten(F.transform("r", lambda x: _said(x["question"], None if kind == "answer" else x["answer"])))
    title = {"recent": "【最近对话原文】", "answer": "【最近相关对话】"}.get(kind)
    text = F.array_join(F.concat(F.array(F.lit(title)), lines) if title else lines, "\n")
    return rows.select(key, (clip_front(text, WINDOW if kind == "recent" else ANSWER_HISTORY) if title else text).alias("transcript"))


def exchanges(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, order, question, answer from single turns (key, order, role, text): each user turn with the assistant's next one."""
    w = Window.partitionBy(key).orderBy(order)
    said = turns.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    return said.where("role = 'user'").select(key, order, F.col("text").alias("question"), F.when(F.col("_role") == "assistant", F.col("_text")).alias("answer"))


def merge_summaries(known: DataFrame, batch: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, summary, goal, pending, hints: what stands in for a model's compression of a batch of exchanges.

    known: key, summary, goal, pending, hints (arrays); batch: key, order, question, answer, a few rows a key. Highlights
    of the first exchanges are appended to the summary; the last question becomes the goal if there is none yet.
    """
    rows = batch.groupBy(key).agg(ordered(order, "question", "answer").alias("r")).join(known, key, "left")
    short = lambda c: clip(c, ITEM)
    asked = F.filter(F.transform("r", lambda x: x["question"]), lambda q: F.coalesce(q, F.lit("")) != "")
    noted = lambda x: F.filter(F.array(F.when(F.coalesce(x["question"], F.lit("")) != "", F.concat(F.lit("用户关注："), short(x["question"]))), F.when(F.coalesce(x["answer"], F.lit("")) != "", F.concat(F.lit("已有结论："), short(x["answer"])))), lambda y: y.isNotNull())
    enough = F.aggregate("r", F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) >= HIGHLIGHTS, acc).otherwise(F.concat(acc, noted(x))))
    summary = F.concat_ws("；", F.nullif(F.coalesce("summary", F.lit("")), F.lit("")), F.nullif(F.array_join(enough, "；"), F.lit("")))
    last = F.element_at("r", -1)["question"]
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return rows.select(
        key, clip(summary, SUMMARY).alias("summary"), clip(F.coalesce(F.nullif("goal", F.lit("")), last), GOAL).alias("goal"),
        distinct_items(F.concat(empty("pending"), F.transform(asked, short))).alias("pending"), distinct_items(F.concat(empty("hints"), empty(retrieval_hints(last)))).alias("hints"),
    )


def refers_back(question: Column) -> Column:
    """Whether a question leans on what was said before: by its words, an ordinal, its shortness, or a closing particle."""
    q = T.strip(F.coalesce(question, F.lit("")))
    words = reduce(Column.__or__, [F.contains(q, F.lit(w)) for w in BACK_REFERENCES])
    return (q != "") & (words | F.regexp(q, F.lit(ORDINAL)) | (F.length(q) <= 12) | ((F.length(q) <= 18) & F.regexp(q, F.lit("[呢吗]$"))))


def answer_history(question: Column, transcript: Column, budget: int = ANSWER_HISTORY) -> Column:
    """What an answer may see of the talk before: earlier questions, for questions that refer back; "" otherwise."""
    asked = T.strip(F.array_join(F.filter(F.transform(F.split(F.coalesce(transcript, F.lit("")), "\n"), T.strip), lambda x: F.startswith(x, F.lit("用户："))), "\n"))
    title = "对话承接上下文（仅用于理解指代，不作为事实证据）：\n"
    body = T.clip_tail(asked, budget - len(title) if budget > len(title) else budget)
    return F.when(refers_back(question) & (asked != ""), F.concat(F.lit(title if budget > len(title) else ""), body)).otherwise("")


def planning_history(parts: dict[str, Column], recent: Column, most: int = PLANNING_HISTORY) -> Column:
    """Sections of the memory (a text or the first five items of a list each), then the recent transcript's end; both within `most`."""
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    rendered = []
    for k, (title, name) in enumerate(SECTIONS):
        if name not in parts:
            continue
        if k < 2:
            rendered.append(F.when(~blank(parts[name]), F.concat(F.lit(f"【{title}】\n"), T.strip(parts[name]))))
        else:
            items = F.slice(F.filter(F.coalesce(parts[name], F.array().cast("array<string>")), lambda x: ~blank(x)), 1, 5)
            rendered.append(F.when(F.size(items) > 0, F.concat(F.lit(f"【{title}】\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), T.strip(x))), "\n"))))
    structured = F.concat_ws("\n\n", *rendered)
    tail = T.clip_tail(T.strip(F.coalesce(recent, F.lit(""))), min(max(most // 2, int(most * 0.65)), most))
    room = F.lit(most) - F.length(tail) - 2
    head = F.when(F.length(structured) > room, F.when(room > 1, F.concat(F.substr(structured, F.lit(1), room - 1), F.lit("…"))).otherwise("")).otherwise(structured)
    return F.when(tail == "", T.clip_head(structured, most)).otherwise(F.concat_ws("\n\n", F.nullif(head, F.lit("")), tail))


def first_references(refs: DataFrame, keys: Sequence[str], group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """References of a group, each once: by the first of `keys` that isn't blank, the first in the order stays; rows without a key drop out."""
    key = F.coalesce(*[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys])
    n = F.row_number().over(Window.partitionBy(*group, "_key").orderBy(*order))
    return refs.withColumn("_key", key).where("_key is not null").withColumn("_n", n).where("_n = 1").drop("_key", "_n")


def siblings(chunks: DataFrame, parent: str = "parent", chunk: str = "chunk", no: str = "chunk_no") -> DataFrame:
    """chunk, siblings: the other chunks of each one's parent in their order, as an array of ids."""
    w = Window.partitionBy(parent).orderBy(no).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return chunks.select(chunk, F.array_except(F.collect_list(chunk).over(w), F.array(chunk)).alias("siblings"))


def active_tasks(tasks: DataFrame, documents: DataFrame, doc: str = "doc", active: Sequence[str] = ("new", "running")) -> DataFrame:
    """doc, active: how many tasks of each document are new or running."""
    n = tasks.groupBy(doc).agg(F.count_if(F.col("status").isin(list(active))).alias("active"))
    return documents.select(doc).join(n, doc, "left").select(doc, F.coalesce("active", F.lit(0)).alias("active"))


def chunk_details(chunks: DataFrame, parents: DataFrame, documents: DataFrame, width: int = 120) -> DataFrame:
    """One row for each chunk with its document's name, its parent's text (clipped) and its number of siblings. Chunks without a parent have none."""
    n = chunks.groupBy("parent").agg((F.count("*") - 1).alias("siblings"))
    out = chunks.join(parents.select("parent", clip(F.col("text"), width).alias("parent_text")), "parent", "left").join(n, "parent", "left").join(documents.select("doc", "name"), "doc", "left")
    return out.select("chunk", "doc", "name", "parent", "parent_text", F.when(F.col("parent").isNotNull(), F.col("siblings")).otherwise(0).alias("siblings"))


def session_view(exchanges_: DataFrame, states: DataFrame, traces: DataFrame) -> DataFrame:
    """Exchanges with the state that holds for them: the live state if there is one, else the stored status, and the latest trace."""
    live = states.groupBy("exchange").agg(F.max_by("state", "at").alias("state"))
    trace = traces.groupBy("exchange").agg(F.max_by("trace", "at").alias("trace"))
    return exchanges_.join(live, "exchange", "left").join(trace, "exchange", "left").withColumn("status", F.coalesce("state", "status")).drop("state")
