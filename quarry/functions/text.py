"""Text functions as column expressions. Java patterns carry (?U) where they meet CJK or full-width text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- cleaning and profile ---------------------------------------------------------------------------------------------


def clean_text(c: Column) -> Column:
    """Byte-order marks off, line ends to \\n, NUL to space, tabs to one space, at most one blank line, single spaces, trimmed."""
    c = F.regexp_replace(c, "﻿", "")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "\\x00", " "), "[\\t\\x0b\\f]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {2,}", " ")
    return strip(c)


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Lines that count as headings of a document (fixed patterns).
HEADING_LINE = r"^(#{1,6}\s|第[一二三四五六七八九十百\d]+[章节条部分]|\d+(\.\d+)*\s+\S)"


def count_headings(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: F.regexp(strip(x), F.lit(HEADING_LINE))))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


def longest_paragraph(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(paragraphs(c), F.length)), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    """Words with a Latin letter, plus CJK characters, plus a quarter of all other characters (1 at least)."""
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: F.regexp(w, F.lit("[A-Za-z]"))))
    cjk = F.regexp_count(c, F.lit("[一-龥]"))
    return words + cjk + F.greatest(F.lit(1), F.floor((F.length(c) - cjk) / 4).cast("int"))


def estimate_prompt_tokens(c: Column) -> Column:
    """CJK characters / 1.5 + ASCII / 4 + others / 2, floored, 1 at least."""
    cjk = F.regexp_count(c, F.lit("[\\u4e00-\\u9fff]"))
    ascii_chars = F.regexp_count(c, F.lit("[\\x00-\\x7f]"))
    return F.greatest(F.lit(1), F.floor(cjk / 1.5 + ascii_chars / 4 + (F.length(c) - cjk - ascii_chars) / 2).cast("int"))


def count_tokens(c: Column) -> Column:
    """Tokens of a text for the chunkers: its characters, as no tokenizer of that vocabulary is at hand offline."""
    return F.length(F.coalesce(c, F.lit("")))


def truncate_tokens(c: Column, most: int) -> Column:
    """Two characters a token; nothing is cut for most <= 0."""
    return c if most <= 0 else F.substring(c, 1, 2 * most)


def structure_level(headings: Column, n_paragraphs: Column) -> Column:
    return F.when(headings >= 5, 3).when(headings >= 2, 2).when(n_paragraphs >= 3, 1).otherwise(0)


def content_quality(c: Column) -> Column:
    """1 low to 3 high, by length and the share of replacement characters."""
    n = F.length(c)
    broken = F.regexp_count(c, F.lit("�")) / n
    return F.when(F.coalesce(n, F.lit(0)) < 20, 1).when((broken > 0.02) | (n < 100), 1).when((broken > 0.005) | (n < 500), 2).otherwise(3)


# --- normalisation and pieces -----------------------------------------------------------------------------------------


def first_non_blank(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit(""))


def join_non_blank(sep: str, *cs: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in cs])


def normalize_text(c: Column) -> Column:
    """For routing: no white space, no punctuation of headings and lists, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s>`*#_\-，,。；;：:（）()]+", ""))


def normalize_fallback(c: Column) -> Column:
    """As normalize_text, also without quotes and square brackets."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s>`*#_\-，,。；;：:（）()''\[\]]+", ""))


def normalize_for_match(c: Column) -> Column:
    """For gold alignment: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\W_]+", ""))


def clip_head(c: Column, most: int) -> Column:
    if most <= 1:
        return F.lit("")
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def clip_tail(c: Column, most: int) -> Column:
    if most <= 1:
        return F.lit("")
    return F.when(F.length(c) > most, F.concat(F.lit("…"), F.right(c, F.lit(most - 1)))).otherwise(c)


def _pairs(s: Column) -> Column:
    """Distinct neighbouring characters, in linear time: substr would walk a long text from its start for each pair."""
    chars = F.filter(F.split(s, ""), lambda x: x != "")
    n = F.greatest(F.lit(0), F.size(chars) - 1)
    return F.array_distinct(F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda x, y: F.concat(x, y)))


def bigrams(c: Column) -> Column:
    """Distinct character pairs of the CJK and ASCII word characters, lower case; none below two characters."""
    return _pairs(pair_form(c))


def pair_form(c: Column) -> Column:
    """The characters that bigrams pairs."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\u4e00-\\u9fffA-Za-z0-9_]", ""))


def gold_bigrams(c: Column) -> Column:
    """Distinct character pairs of the matched form; a single character stands for itself."""
    s = normalize_for_match(c)
    return F.when(F.length(s) >= 2, _pairs(s)).otherwise(F.array(s))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def leaf_title(path: Column) -> Column:
    parts = F.filter(F.transform(F.split(path, ">"), lambda x: F.trim(x)), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def soft_window(c: Column, anchor: Column, size: int) -> Column:
    """About `size` characters around the anchor, an ellipsis at each cut end; the head if the anchor isn't found."""
    at = F.when(F.length(anchor) > 0, F.instr(c, anchor)).otherwise(0)
    start = F.when(at > 0, F.greatest(F.lit(1), at - F.floor((size - F.length(anchor)) / 2).cast("int"))).otherwise(1)
    start = F.least(start, F.greatest(F.lit(1), F.length(c) - size + 1)).cast("int")
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substr(c, start, F.lit(size)), F.when(start + size - 1 < F.length(c), "…").otherwise(""))
    return F.when(F.length(c) <= size, c).otherwise(cut)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", "-"), r"(?U)[^\w.-]", "")
    return F.when(s == "", "node").otherwise(s)


def evidence_key(parent: Column, document: Column, url: Column, kind: Column, title: Column, content: Column) -> Column:
    """parent, document, url, or type:title:first 50 characters: the first that is known."""
    own = F.concat_ws(":", F.coalesce(kind, F.lit("")), F.coalesce(title, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 50))
    known = [F.concat(F.lit(f"{n}:"), F.nullif(c.cast("string"), F.lit(""))) for n, c in (("PARENT", parent), ("DOCUMENT", document), ("WEB", url))]
    return F.coalesce(*known, own)


def cache_key(tenant: Column, question: Column, mode: Column, doc_ids: Column) -> Column:
    q = F.lower(F.regexp_replace(question, r"(?U)\s+", ""))
    return F.sha1(F.concat_ws("|", tenant, q, mode, F.array_join(F.array_sort(doc_ids), ",")).cast("binary"))


def stable_id(c: Column) -> Column:
    """Digits as they are; else the first 8 bytes of the MD5 modulo 10^15."""
    hashed = (F.conv(F.substring(F.md5(c.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(10**15).cast("decimal(20,0)")).cast("long")
    return F.when(F.regexp(c, F.lit("^[0-9]+$")), c.try_cast("long")).otherwise(hashed)


def chunk_id(doc: Column, role: str, seq: Column, content: Column) -> Column:
    return F.concat(F.lit("c"), F.substring(F.sha1(F.concat_ws(":", doc.cast("string"), F.lit(role), seq.cast("string"), content).cast("binary")), 1, 24))


def context_text(context: Column, name: Column, path: Column, content: Column) -> Column:
    """What is embedded for a chunk: its context, document, section and text, blanks left out."""
    labelled = lambda before, c, after="": F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after)))
    return F.concat_ws("\n", F.nullif(context, F.lit("")), labelled("文档：《", name, "》"), labelled("章节：", path), content)


def json_from_reply(c: Column, schema: str) -> Column:
    """A struct from a model's reply: code fences and text around the object are dropped; NULL fields where it doesn't parse."""
    body = F.regexp_replace(c, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    return F.from_json(F.coalesce(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")), F.lit("{}")), schema)


def score_from_text(c: Column) -> Column:
    """A score of 0 to 100 in free text, as 0 to 1: after a score word, before / 100 or %, else the first number."""
    number = r"(\d{1,3}(?:\.\d+)?)"
    ladder = [F.regexp_extract(c, p, 1) for p in (r"(?i)(?:score|分数|得分|评分)\D{0,5}" + number, number + r"\s*(?:/\s*100|%|分)", number)]
    value = F.coalesce(*[F.nullif(x, F.lit("")) for x in ladder]).try_cast("double")
    return F.when((value >= 0) & (value <= 100), value / 100)


def bounded_context(chunks: Column, most: int) -> Column:
    """Whole chunks from the front while their lengths stay within `most`."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

    def add(acc: Column, x: Column) -> Column:
        fits = ~acc["full"] & (acc["n"] + F.length(x) <= most)
        return F.struct(F.when(fits, acc["n"] + F.length(x)).otherwise(acc["n"]).alias("n"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"), (~fits).alias("full"))

    return F.aggregate(chunks, start, add, lambda acc: acc["kept"])


def head_and_tail(c: Column, most: int, head: float = 0.7) -> Column:
    """The first 70 % and the last 30 % of the room, for lengths in characters."""
    a = int(most * head)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, a), F.right(c, F.lit(most - a)))).otherwise(c)


def probability_weight(p: Column) -> Column:
    """1 from 0.55 on, 0 up to 0.45, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - 0.45) / 0.10))


def limit_distinct(items: Column, most: int, width: int) -> Column:
    """Distinct non-blank items in their order, each clipped, `most` at most."""
    return F.slice(F.array_distinct(F.transform(F.filter(items, lambda x: F.trim(x) != ""), lambda x: clip_head(F.trim(x), width))), 1, most)


# --- sentences --------------------------------------------------------------------------------------------------------


def sentences(c: Column) -> Column:
    """Split behind sentence ends and line ends, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[。！？.!?\n])\s*"), strip), lambda s: s != "")


def pack_sentences(parts: Column, size: int) -> Column:
    """Sentences joined greedily up to `size` characters; an oversize sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        over = (F.length(acc["open"]) + F.length(s) > size) & (F.length(acc["open"]) > 0)
        return F.struct(F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(over, s).otherwise(F.concat(acc["open"], s)).alias("open"))

    return F.aggregate(parts, start, add, lambda a: F.when(F.length(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


# --- numbers and exact tokens -----------------------------------------------------------------------------------------

#: Digits of Chinese numerals (fixed values).
DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def digit(c: Column, default: int | None = None, two: bool = False) -> Column:
    ladder = reduce(lambda w, kv: w.when(c == kv[0], kv[1]), [*DIGITS.items(), *([("两", 2)] if two else [])], F.when(F.lit(False), 0))
    return ladder.otherwise(F.lit(default))


def normalize_steps(c: Column) -> Column:
    """第三步 as 第3步: single numerals before the counted nouns; other numerals stay."""
    digits = {**DIGITS, "〇": 0, "十": 10}
    return reduce(lambda t, kv: F.regexp_replace(t, f"第{kv[0]}(步|个步骤|条|项|点)", f"第{kv[1]}$1"), digits.items(), c)


def metadata_value(c: Column, key: str) -> Column:
    """The text of a key of a JSON object; NULL if it is missing or the text is no object."""
    return F.get_json_object(c, f"$.{key}")


def cn_to_int(c: Column) -> Column:
    """Integers from digits or numerals up to 99; NULL otherwise."""
    v = F.trim(c)
    head, tail = F.regexp_extract(v, "^(.*?)十", 1), F.regexp_extract(v, "十(.*)$", 1)
    tens = F.when(head == "", 1).otherwise(digit(head, 1))
    return F.when(F.regexp(v, F.lit("^[0-9]+$")), v.try_cast("int")).when(F.regexp(v, F.lit("^[零一二三四五六七八九十]*十[零一二三四五六七八九十]*$")), tens * 10 + F.when(tail == "", 0).otherwise(digit(tail, 0))).otherwise(digit(v))


def loose_number(c: Column) -> Column:
    """As cn_to_int for item numbers; any other text is read by its first character."""
    v = F.trim(c)
    return F.coalesce(F.when(F.regexp(v, F.lit("^([0-9]+|[一二三四五六七八九]?十[一二三四五六七八九]?)$")), cn_to_int(v)), digit(F.substring(v, 1, 1)))


def cn_to_number(c: Column) -> Column:
    """Numerals up to thousands (两 is 2); NULL for zero and for other characters."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("pending"), F.lit(True).alias("ok"))
    unit = lambda x: F.when(x == "十", 10).when(x == "百", 100).when(x == "千", 1000)

    def add(a: Column, x: Column) -> Column:
        d, u = F.when(x != "零", digit(x, None, True)), unit(x)
        grown = a["total"] + F.when(a["pending"] == 0, 1).otherwise(a["pending"]) * u
        return F.struct(F.coalesce(grown, a["total"]).alias("total"), F.coalesce(d, F.when(u.isNotNull(), 0), a["pending"]).alias("pending"), (a["ok"] & (d.isNotNull() | u.isNotNull())).alias("ok"))

    value = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, add, lambda a: F.when(a["ok"], a["total"] + a["pending"]))
    return F.nullif(value, F.lit(0)).cast("double")


CLAUSE = r"第\s*(\d{1,3}|[零一二三四五六七八九十]{1,3})\s*条"
SUBCLAUSE = r"(?<![\d.])(\d{1,2}\.\d{1,2})(?![\d.])"
BOLD_SUBCLAUSE = r"\*\*(\d{1,2}\.\d{1,2})"
DOC_NAME = r"《([^》]{4,60})》"
GRADE = r"(?<![A-Za-z0-9])(M[1-9]\+?|P[1-9](?:-\d+)?)(?![A-Za-z0-9])"
CITY_CLASS = r"([A-D])\s*类城市"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """Distinct non-empty matches in their order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group)), lambda x: x != ""))


def clause_numbers(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CLAUSE), F.lit(1)), lambda x: cn_to_int(x).cast("string")), lambda x: x.isNotNull()))


def exact_tokens(c: Column) -> Column:
    """Clause and subclause numbers, document names, grades and city classes of a question."""
    return F.struct(clause_numbers(c).alias("clauses"), found(c, SUBCLAUSE).alias("subclauses"), found(c, DOC_NAME).alias("doc_names"), found(c, GRADE).alias("grades"), found(c, CITY_CLASS).alias("city_classes"))


def chunk_exact_fields(path: Column, body: Column) -> Column:
    """The exact fields that a chunk is indexed by: clauses of its path; bold subclauses, else all; grades; city classes."""
    bold = found(body, BOLD_SUBCLAUSE)
    return F.struct(clause_numbers(path).alias("clause_number"), F.when(F.size(bold) > 0, bold).otherwise(found(body, SUBCLAUSE)).alias("sub_clause_numbers"), found(body, GRADE).alias("grade_codes"), found(body, CITY_CLASS).alias("city_classes"))


# --- query rules ------------------------------------------------------------------------------------------------------

#: Separators of query terms, noise words and connectives (fixed values).
TERM_SPLIT = r"[\s、，,；;：:（）()\-的和及与或]+"
CONNECTIVES = ["的", "和", "及", "与", "或"]
NOISE_PHRASES = ["请问", "帮我", "给我", "详细", "介绍", "一下", "分析", "总结", "是什么", "为什么", "怎么", "如何", "在哪里", "什么时候", "的"]


def query_terms(c: Column, most: int = 40) -> Column:
    """Segments of two characters or more, each followed by its 2- to 6-grams if it has four; distinct, in order, `most` at most."""
    segments = F.filter(F.split(F.coalesce(c, F.lit("")), TERM_SPLIT), lambda s: F.length(s) >= 2)

    def grams(s: Column) -> Column:
        sizes = F.sequence(F.lit(2), F.least(F.lit(6), F.length(s)))
        each = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, n))))
        return F.concat(F.array(s), F.when(F.length(s) >= 4, each).otherwise(F.array().cast("array<string>")))

    return F.slice(F.array_distinct(F.flatten(F.transform(segments, grams))), 1, most)


#: Runs that keyword terms take whole.
LATIN = r"[a-zA-Z0-9_\-]+"


def without_noise(c: Column) -> Column:
    """A question with blanks for its connectives and noise phrases."""
    return reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(" ")), [*CONNECTIVES, *NOISE_PHRASES], F.coalesce(c, F.lit("")))


def _parts(s: Column, low: int = 2, high: int = 4) -> Column:
    """Substrings of low to high characters."""
    return F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(s))), lambda n: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, n))))


def _parts_of_all(a: Column) -> Column:
    return F.flatten(F.transform(F.filter(a, lambda s: F.length(s) >= 2), lambda s: _parts(s)))


def _longest(terms: Column, most: int) -> Column:
    ordered = F.array_sort(F.array_distinct(terms), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.slice(ordered, 1, most)


def keyword_terms(c: Column, most: int = 8) -> Column:
    """The longest keyword terms of a question, ties in alphabetical order.

    Connectives and noise phrases go; Latin and digit runs stay whole; CJK runs give bigrams (operators.segmentation cuts them into words); all get
    their head, tail and inner n-grams up to four characters.
    """
    text = without_noise(c)
    latin = F.regexp_extract_all(text, F.lit(f"({LATIN})"), F.lit(1))
    cjk = F.regexp_extract_all(text, F.lit("([\\u4e00-\\u9fff]{2,})"), F.lit(1))
    return _longest(F.concat(latin, _parts_of_all(latin), F.flatten(F.transform(cjk, lambda s: _parts(s)))), most)


def terms_of_words(text: Column, words: Column, most: int = 8) -> Column:
    """The longest of a cleaned question's terms: its Latin runs, its words, two and three words in a row (with blanks if one has
    a Latin letter), and the parts of two to four characters of runs and words. Ties in alphabetical order."""
    latin = F.regexp_extract_all(text, F.lit(f"({LATIN})"), F.lit(1))

    def in_a_row(n: int) -> Column:
        some = lambda i: F.slice(words, i, n)
        joined = lambda i: F.when(F.exists(some(i), lambda w: F.rlike(w, F.lit("[a-zA-Z]"))), F.array_join(some(i), " ")).otherwise(F.array_join(some(i), ""))
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), joined)).otherwise(F.array().cast("array<string>"))

    return _longest(F.concat(latin, words, in_a_row(2), in_a_row(3), _parts_of_all(F.concat(words, latin))), most)


def meaningful_terms(c: Column, most: int = 6) -> Column:
    """Distinct segments of two characters or more, in order."""
    return F.slice(F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), TERM_SPLIT), lambda s: F.length(s) >= 2)), 1, most)


def augmented_query(question: Column, keywords: Column, navigation: Column, history: Column) -> Column:
    """struct<text, hints>: the question with its hints behind, and what a keyword search weighs up: all hints, then the question's terms.

    Five keywords, four navigation and four history hints at most, without blanks and repeats; history only counts for
    short questions that refer back. Eight hints at most; without any, the question's terms alone.
    """
    clean = lambda c, n: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")), 1, n)
    past = F.when(is_short_follow_up(F.trim(question)), clean(history, 4)).otherwise(F.array().cast("array<string>"))
    hints = F.concat(clean(keywords, 5), past, clean(navigation, 4))
    text = F.when(F.size(hints) > 0, F.concat(question, F.lit(" "), F.array_join(hints, " "))).otherwise(question)
    terms = meaningful_terms(question)
    return F.struct(text.alias("text"), F.when(F.size(hints) > 0, F.slice(F.array_distinct(F.concat(hints, terms)), 1, 8)).otherwise(terms).alias("hints"))


def safe_int(c: Column, default: int | None = 0) -> Column:
    """Whole numbers in text, spaces around them aside; the default for anything else."""
    value = F.trim(c.cast("string")).try_cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default))


def _any(words: Sequence[str], c: Column) -> Column:
    return F.regexp(F.lower(F.coalesce(c, F.lit(""))), F.lit("|".join(words)))


#: Words of time rules (fixed values).
RELATIVE_TIME = "今天 今日 明天 明日 昨天 昨日 后天 前天 现在 当前 目前 此刻 实时 最新 刚刚 本周 这周 本月 这个月 今年 本年度 本季度 周几 星期几 几号 日期 几月几号".split()
FRESH_DOMAINS = (
    "天气 气温 温度 降雨 下雨 下雪 空气质量 aqi 限号 限行 尾号限行 汇率 金价 黄金价格 银价 油价 股价 行情 大盘 指数 新闻 头条 热搜 热榜 "
    "路况 拥堵 票房 排片 航班 班次 列车 高铁 火车 地铁运营 比分 赛果 赛程 比赛结果 预警 台风"
).split()
CALENDAR = "周几 星期几 几号 日期 几月几号 星期 周".split()
HISTORICAL = "历史 过去 去年 前年 上周 上个月 上月 上一周 上一月 往年 历年 当时 之前 回顾 曾经".split()
EVENTS = "发生什么 发生啥 出了什么 最新消息 最新动态 最新进展 最新资讯 实时新闻 实时热点 实时动态 刚刚发生".split()
EXPLICIT_DATE = r"(\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)|(\d{1,2}月\d{1,2}日)"
HINTS = [("明天", "明天 明日"), ("昨天", "昨天 昨日 前天"), ("本周", "本周 这周"), ("本月", "本月 这个月"), ("今年", "今年 本年度 本季度"), ("最新", "最新 实时 当前 现在 目前 刚刚")]


def is_time_sensitive(q: Column) -> Column:
    return _any(RELATIVE_TIME + FRESH_DOMAINS + CALENDAR, q)


def has_explicit_date(q: Column) -> Column:
    return F.regexp(F.coalesce(q, F.lit("")), F.lit(EXPLICIT_DATE))


def needs_date_anchor(q: Column) -> Column:
    relative, calendar = _any(RELATIVE_TIME, q), _any(CALENDAR, q)
    return ~(_any(HISTORICAL, q) & ~relative & ~calendar) & (relative | _any(FRESH_DOMAINS, q) | calendar)


def needs_fresh_search(q: Column) -> Column:
    return ~_any(HISTORICAL, q) & ~has_explicit_date(q) & ~_any(CALENDAR, q) & (_any(FRESH_DOMAINS, q) | _any(EVENTS, q))


def temporal_hint(q: Column) -> Column:
    return reduce(lambda w, kv: w.when(_any(kv[1].split(), q), kv[0]), HINTS, F.when(F.lit(False), "")).otherwise("今天")


def dated_query(q: Column, today: Column) -> Column:
    """The question with today's date and a hint where it needs an anchor and has none."""
    t = F.trim(q)
    keep = ~needs_date_anchor(t) | has_explicit_date(t) | F.contains(t, today) | _any(HISTORICAL, t)
    return F.when(keep, t).otherwise(F.concat_ws(" ", t, today, temporal_hint(t)))


def is_multi_question(q: Column) -> Column:
    t = F.trim(F.coalesce(q, F.lit("")))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    return (t != "") & ((F.regexp_count(t, F.lit("[?？]")) >= 2) | F.regexp(t, F.lit("[；;]")) | (lines >= 2) | F.regexp(t, F.lit(r"(^|\s)(\d+[)\.、]|[A-Za-z][)])")) | F.contains(t, F.lit("分别")))


def split_questions(q: Column, most: int = 4) -> Column:
    parts = F.array_distinct(F.filter(F.transform(F.split(q, r"[?？；;\n]+"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(parts) == 0, F.array(q)).otherwise(F.slice(parts, 1, most))


#: Back references of follow-up questions (fixed pattern).
FOLLOW_UP = r"刚才|上面|前面|前文|上文|上一[条轮个项次]|上述|前者|后者|承接|同上|如上|第\s*[0-9一二三四五六七八九十百]+\s*(条|点|项)|继续展开|进一步说明|深入解释"


def is_follow_up(q: Column) -> Column:
    return F.regexp(F.coalesce(q, F.lit("")), F.lit(FOLLOW_UP))


#: Words without which a short question means nothing on its own (fixed values), and the length that counts as short.
SHORT_FOLLOW_UP, SHORT = ["它", "这个", "那个", "刚才", "前面", "上面", "上述", "这些", "那些"], 20


def is_short_follow_up(q: Column) -> Column:
    t = F.trim(F.coalesce(q, F.lit("")))
    return (t != "") & (F.length(t) <= SHORT) & F.regexp(t, F.lit("|".join(SHORT_FOLLOW_UP)))


#: Kinds of documents that a question may name (fixed values), years and section marks.
DOCUMENT_KINDS = ["部署手册", "配置手册", "操作手册", "用户手册", "快速开始", "接入指南", "FAQ", "常见问题", "说明文档", "说明书", "规范", "指南", "手册", "文档"]
YEAR, SECTION = r"\b(20\d{2})\b", r"(第\s*[一二三四五六七八九十百\d]+\s*[章节条部分]|附录\s*[A-Za-z一二三四五六七八九十\d]+)"


def query_filters(q: Column) -> Column:
    """struct<years, sections, names>: what a question says about where to look; sections without spaces."""
    t = F.coalesce(q, F.lit(""))
    named = F.filter(F.array(*map(F.lit, DOCUMENT_KINDS)), lambda n: F.contains(F.lower(t), F.lower(n)))
    sections = F.transform(F.regexp_extract_all(t, F.lit(SECTION), F.lit(1)), lambda s: F.replace(s, F.lit(" "), F.lit("")))
    return F.struct(F.regexp_extract_all(t, F.lit(YEAR), F.lit(1)).alias("years"), sections.alias("sections"), named.alias("names"))


def needs_rewrite(q: Column, history: Column) -> Column:
    blank = F.trim(F.coalesce(history, F.lit(""))) == ""
    return F.when(blank, (F.length(q) < 8) | is_multi_question(q)).otherwise((F.length(q) < 18) | is_multi_question(q) | is_follow_up(q))


#: Cues of compound questions (fixed values).
COMPARE, CONNECT = "对比|比较|区别|差异|分别|哪个更|versus|vs", "并且|以及|同时|另外|此外|而且|and"


def may_decompose(q: Column) -> Column:
    """Worth splitting into sub-plans: comparing words, or fifty characters with a connective."""
    return F.regexp(F.lower(q), F.lit(COMPARE)) | ((F.length(q) >= 50) & F.regexp(F.lower(q), F.lit(CONNECT)))


def is_open_chat(q: Column) -> Column:
    """Greetings and questions about the assistant itself (rules of thumb)."""
    t = F.lower(F.trim(q))
    return F.regexp(t, F.lit(r"^(你好|您好|嗨|hi|hello|hey|谢谢|thanks|thank you|再见|bye)[\s!！.。~]*$")) | F.regexp(t, F.lit("你(是谁|能做什么|会什么|有什么功能)|what can you do|who are you"))


def navigation_mode(q: Column, has_section: Column) -> Column:
    """GRAPH_ONLY for outline and neighbour questions, GRAPH_THEN_EVIDENCE for items of a known section, else RETRIEVAL."""
    around = F.regexp(q, F.lit("上一[章节条步]|下一[章节条步]|目录|大纲|结构|有哪些章节"))
    analytic = F.regexp(q, F.lit("为什么|原因|分析|对比|区别|如何"))
    item = F.regexp(q, F.lit(r"第\s*[0-9一二三四五六七八九十百]+\s*[步条项点]|步骤\s*[0-9一二三四五六七八九十]+"))
    return F.when(around & ~analytic & ~is_multi_question(q), "GRAPH_ONLY").when(item & has_section, "GRAPH_THEN_EVIDENCE").otherwise("RETRIEVAL")


# --- document profile -------------------------------------------------------------------------------------------------


def section_titles(c: Column, most: int = 8) -> Column:
    """Titles of heading lines without marks and codes, shorter than 80 characters, distinct."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.regexp(x, F.lit(r"^(#{1,6}\s+|第[一二三四五六七八九十百\d]+[章节条部分])")))
    titles = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s*", ""), r"^(第[一二三四五六七八九十百\d]+[章节条部分]|\d+(\.\d+)*[、.]?)\s*", "")))
    return F.slice(F.array_distinct(F.filter(titles, lambda x: (x != "") & (F.length(x) < 80))), 1, most)


def has_items(c: Column) -> Column:
    return F.regexp(c, F.lit(r"(?m)^\d+[\.、\)]|^第\d+[步条]"))


#: Keyword ladders of the profile (fixed values; the first that holds decides).
TYPE_LADDER = [("faq", "faq|常见问题"), ("troubleshooting", "故障|排查|检查顺序"), ("rule", "规则|制度"), ("spec", "规格|参数"), ("manual", "手册|指南|部署")]
SCOPE_LADDER = [
    ("operation_rule", "运营规则", "上线观察|值班规则|观察时长|运营"),
    ("robot_strategy", "机器人策略", "机器人|知识召回|意图识别|策略设计"),
    ("deployment", "安装部署", "安装|部署|默认密码|访问地址"),
    ("troubleshooting", "故障排查", "故障|排查|异常|检查顺序"),
    ("product", "产品资料", "产品简介|核心特性|技术规格|产品概述"),
]
CATEGORIES = {"troubleshooting": "故障排查", "rule": "规则", "spec": "规格说明"}
QUESTION_FORMS = {"troubleshooting": "的可能原因有哪些？", "manual": "的步骤是什么？", "rule": "有哪些规则？"}


def document_type(combined: Column, items: Column) -> Column:
    ladder = reduce(lambda w, kv: w.when(F.regexp(F.lower(combined), F.lit(kv[1])) | (items if kv[0] == "manual" else F.lit(False)), kv[0]), TYPE_LADDER, F.when(F.lit(False), ""))
    return ladder.otherwise("intro")


def scope_code(combined: Column) -> Column:
    return reduce(lambda w, s: w.when(F.regexp(F.lower(combined), F.lit(s[2])), s[0]), SCOPE_LADDER, F.when(F.lit(False), "")).otherwise("general_document")


def scope_name(code: Column) -> Column:
    return reduce(lambda w, s: w.when(code == s[0], s[1]), SCOPE_LADDER, F.when(F.lit(False), "")).otherwise("通用文档")


def business_category(kind: Column, c: Column) -> Column:
    ladder = reduce(lambda w, kv: w.when(kind == kv[0], kv[1]), CATEGORIES.items(), F.when(F.lit(False), ""))
    return ladder.when((kind == "manual") & F.regexp(F.lower(c), F.lit("步骤|操作|部署")), "操作手册").when(kind == "manual", "手册").otherwise("介绍")


def core_topics(titles: Column, name: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.concat(F.slice(titles, 1, 6), F.array(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,6}$", ""))), lambda x: x != "")), 1, 6)


def example_questions(kind: Column, topics: Column) -> Column:
    form = reduce(lambda w, kv: w.when(kind == kv[0], kv[1]), QUESTION_FORMS.items(), F.when(F.lit(False), "")).otherwise("是什么意思？")
    return F.slice(F.array_distinct(F.transform(topics, lambda t: F.concat(t, form))), 1, 6)


def profile_summary(name: Column, titles: Column, c: Column) -> Column:
    covers = F.when(F.size(titles) > 0, F.concat(F.lit("主要涵盖："), F.array_join(F.slice(titles, 1, 4), "、"), F.lit("。"))).otherwise("")
    excerpt = F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), 1, 180)
    return F.concat(F.lit("文档《"), name, F.lit("》"), covers, F.when(excerpt != "", F.concat(F.lit("摘要："), excerpt)).otherwise(""))


def profile(c: Column, name: Column) -> Column:
    """Type, scope, category, topics, example questions and summary of a document."""
    # each text is read once: what is used more than once is bound to a name
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def named(titles: Column) -> Column:
        combined = F.lower(F.concat_ws(" ", name, c, F.array_join(titles, " ")))
        return once(F.struct(combined.alias("combined"), has_items(c).alias("items")), lambda x: judged(titles, x["combined"], x["items"]))

    def judged(titles: Column, combined: Column, items: Column) -> Column:
        found = F.struct(document_type(combined, items).alias("kind"), scope_code(combined).alias("code"), core_topics(titles, name).alias("topics"))
        return once(found, lambda x: told(titles, items, x["kind"], x["code"], x["topics"]))

    def told(titles: Column, items: Column, kind: Column, code: Column, topics: Column) -> Column:
        return F.struct(
            kind.alias("document_type"), code.alias("scope_code"), scope_name(code).alias("scope_name"), business_category(kind, c).alias("business_category"),
            topics.alias("core_topics"), example_questions(kind, topics).alias("example_questions"), profile_summary(name, titles, c).alias("summary"),
            F.array_join(F.slice(F.array_distinct(F.concat(F.array(code, kind), F.slice(topics, 1, 4))), 1, 8), ",").alias("tags"), items.alias("supports_items"),
        )

    return once(section_titles(c), named)


# --- links and urls ---------------------------------------------------------------------------------------------------

#: Query parameters that only track (fixed values).
TRACKING = r"^(utm_[^=]*|gclid|fbclid|spm|from|ref|source)(=|$)"


def normalize_url(url: Column) -> Column:
    """No fragment, no tracking parameters, lower-case scheme and host, / for an empty path; "" unless http(s)."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"(?i)^(https?)://", 1))
    host = F.lower(F.regexp_extract(u, r"(?i)^https?://([^/?]*)", 1))
    path = F.regexp_extract(u, r"(?i)^https?://[^/?]*([^?]*)", 1)
    query = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp(F.lower(p), F.lit(TRACKING)))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when((scheme == "") | (host == ""), "").otherwise(F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]*)", 1))


def url_slug(url: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://", ""), "[^A-Za-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 120)


def page_links(html: Column, base: Column) -> Column:
    """Targets of anchors, resolved against the page's url; fragments, mailto, javascript and tel are passed over."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    kept = F.filter(raw, lambda h: ~F.regexp(h, F.lit(r"(?i)^(#|mailto:|javascript:|tel:)")))
    site, folder = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1), F.regexp_extract(base, r"(?i)^(https?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(base, r"(?i)^(https?:)", 1)
    resolve = lambda h: F.when(F.regexp(h, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, h)).when(F.startswith(h, F.lit("/")), F.concat(site, h)).otherwise(F.concat(folder, h))
    return F.array_distinct(F.transform(kept, resolve))


def page_text(html: Column) -> Column:
    """Markdown-like text of a page: scripts and styles out, headings marked, blocks on lines of their own, entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>", " ")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table|ul|ol)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return clean_text(F.regexp_replace(t, r" *\n *", "\n"))
