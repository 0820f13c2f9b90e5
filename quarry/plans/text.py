"""Queries of the text functions over documents, conversations and pages."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.registry import query, table


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\t\\x0b\\f]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("""WITH c AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '�')) AS b FROM documents)
SELECT doc_id, CASE WHEN n < 20 THEN 1 WHEN b / n > 0.02 OR n < 100 THEN 1 WHEN b / n > 0.005 OR n < 500 THEN 2 ELSE 3 END AS quality,
len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(10) || chr(9)) <> '')) AS paragraphs,
list_max(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: length(trim(p, ' ' || chr(10) || chr(9))))) AS longest FROM c""")
def doc_profile_levels(spark, sf):
    d = table(spark, sf, "documents")
    c = F.col("text")
    return d.select("doc_id", T.content_quality(c).alias("quality"), F.size(T.paragraphs(c)).alias("paragraphs"), T.longest_paragraph(c).alias("longest"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[A-Za-z]'))) + greatest(1, length(text) // 4) AS tokens,
greatest(1, floor(len(regexp_extract_all(text, '[\\x00-\\x7f]')) / 4 + (length(text) - len(regexp_extract_all(text, '[\\x00-\\x7f]'))) / 2))::INT AS prompt_tokens FROM documents""")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.estimate_prompt_tokens(F.col("text")).alias("prompt_tokens"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, chr(10)), lambda l: regexp_matches(trim(l), '^(#{1,6}\\s|\\d+(\\.\\d+)*\\s+\\S)'))) AS headings FROM documents""")
def heading_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.count_headings(F.col("text")).alias("headings"))


@query("""SELECT conv_id, turn, lower(regexp_replace(text, '[\\s>`*#_\\-,;:()]+', '', 'g')) AS normal, CASE WHEN length(text) > 30 THEN left(text, 29) || '…' ELSE text END AS head,
CASE WHEN length(text) > 30 THEN '…' || right(text, 29) ELSE text END AS tail FROM conversations""")
def normal_forms(spark, sf):
    c = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_text(c).alias("normal"), T.clip_head(c, 30).alias("head"), T.clip_tail(c, 30).alias("tail"))


@query("""WITH s AS (SELECT item_id, lower(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g')) AS s FROM benchmark)
SELECT item_id, len(list_distinct(list_transform(range(1, length(s)), lambda i: s[i:i + 1]))) AS bigrams FROM s""")
def bigram_counts(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(T.bigrams(F.col("text"))).alias("bigrams"))


@query("""SELECT conv_id, turn, sha1('t1|' || lower(regexp_replace(text, '\\s+', '', 'g')) || '|RETRIEVAL|' || '1,2') AS key FROM conversations""")
def response_cache_keys(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.cache_key(F.lit("t1"), F.col("text"), F.lit("RETRIEVAL"), F.array(F.lit("2"), F.lit("1"))).alias("key"))


@query("""SELECT doc_id, 'c' || left(sha1(doc_id || ':child:0:' || text), 24) AS chunk_id FROM documents""")
def stable_chunk_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.chunk_id(F.col("doc_id"), "child", F.lit(0), F.col("text")).alias("chunk_id"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '[?？]')) >= 2 OR regexp_matches(text, '[；;]') OR len(list_filter(regexp_split_to_array(text, chr(10)), lambda l: trim(l) <> '')) >= 2
OR regexp_matches(trim(text), '(^|\\s)(\\d+[)\\.、]|[A-Za-z][)])') AS multi, length(text) < 8 OR multi AS rewrite FROM conversations""")
def multi_questions(spark, sf):
    q = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_multi_question(q).alias("multi"), T.needs_rewrite(q, F.lit("")).alias("rewrite"))


@query("""SELECT conv_id, turn, list_slice(list_distinct_ordered, 1, 4) AS parts FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[?？；;\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS p,
list_filter(p, lambda x, i: list_position(p, x) = i) AS list_distinct_ordered FROM conversations)""")
def question_parts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.split_questions(F.col("text")).alias("parts"))


@query()
def query_rules(spark, sf):
    """Time, follow-up, decomposition and navigation rules of every turn."""
    q = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.is_time_sensitive(q).alias("time"), T.needs_fresh_search(q).alias("fresh"), T.dated_query(q, F.lit("2024-01-15")).alias("dated"), T.is_short_follow_up(q).alias("follow_up"),
        T.may_decompose(q).alias("decompose"), T.is_open_chat(q).alias("open_chat"), T.navigation_mode(q, F.lit(True)).alias("mode"), T.exact_tokens(q).alias("tokens"), T.keyword_terms(q).alias("keywords"),
    )


@query()
def document_profiles(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.profile(F.col("text"), F.concat(F.col("source"), F.lit(".md"))).alias("p")).select("doc_id", "p.*")


@query("""WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^(https?)://', 1)) AS s, lower(regexp_extract(u, '^https?://([^/?]*)', 1)) AS h,
regexp_extract(u, '^https?://[^/?]*([^?]*)', 1) AS p, list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|spm|from|ref|source)(=|$)')) AS q FROM u)
SELECT page_id, CASE WHEN s = '' OR h = '' THEN '' ELSE s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url, h AS host FROM p""")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"), T.url_host(F.col("url")).alias("host"))


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*', 0, 'i') AS site, list_distinct(regexp_extract_all(html, '<a[^>]*?href="(/[^"]*)"', 1)) AS h FROM pages) SELECT page_id, site || unnest(CASE WHEN len(h) > 0 THEN h ELSE [NULL] END) AS link FROM l""")
def extract_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode_outer(T.page_links(F.col("html"), F.col("url"))).alias("link"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript|template\b.*?</template)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)<h1\b[^>]*>', chr(10) || chr(10) || '# ', 'g'), '(?i)<h2\b[^>]*>', chr(10) || chr(10) || '## ', 'g'), '(?i)<h3\b[^>]*>', chr(10) || chr(10) || '### ', 'g'), '(?i)<h4\b[^>]*>', chr(10) || chr(10) || '#### ', 'g'), '(?i)<h5\b[^>]*>', chr(10) || chr(10) || '##### ', 'g'), '(?i)<h6\b[^>]*>', chr(10) || chr(10) || '###### ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<li\b[^>]*>', chr(10) || '- ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table|ul|ol)\s*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&'), ' *\n *', chr(10), 'g') AS t FROM c)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\t\x0b\f]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM d""")
def page_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.page_text(F.col("html")).alias("text"))


@query("""SELECT conv_id, turn, least(1.0, greatest(0.0, ((length(text) % 100) / 100 - 0.45) / 0.10)) AS weight FROM conversations""")
def probability_weights(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.probability_weight((F.length("text") % 100) / 100).alias("weight"))


@query("""SELECT doc_id, length(coalesce(text, '')) AS tokens, left(text, 60) AS truncated, CASE WHEN length(text) > 100 THEN left(text, 70) || right(text, 30) ELSE text END AS ends FROM documents""")
def token_cuts(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.count_tokens(c).alias("tokens"), T.truncate_tokens(c, 30).alias("truncated"), T.head_and_tail(c, 100).alias("ends"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def metadata_values(spark, sf):
    return table(spark, sf, "events").select("event_id", T.metadata_value(F.col("props"), "k").alias("k"), T.metadata_value(F.col("props"), "missing").alias("missing"))


N_SQL = """WITH n AS (SELECT o_orderkey, o_orderkey % 99 + 1 AS n, ['', '一', '二', '三', '四', '五', '六', '七', '八', '九'] AS d FROM orders),
w AS (SELECT *, CASE WHEN n >= 20 THEN d[n // 10 + 1] ELSE '' END || CASE WHEN n >= 10 THEN '十' ELSE '' END || d[n % 10 + 1] AS word FROM n) """


def numerals(spark, sf):
    """Numbers of 1 to 99 in Chinese numerals."""
    n = F.col("o_orderkey") % 99 + 1
    digit = lambda x: F.element_at(F.array(*[F.lit(c) for c in ["", *"一二三四五六七八九"]]), (x + 1).cast("int"))
    word = F.concat(F.when(n >= 20, digit(F.floor(n / 10))).otherwise(""), F.when(n >= 10, "十").otherwise(""), digit(n % 10))
    return table(spark, sf, "orders").select("o_orderkey", word.alias("word"))


@query(N_SQL + """SELECT o_orderkey, n::INT AS whole, n::INT AS loose, (1200 + n)::DOUBLE AS thousands, CASE WHEN n <= 10 THEN '第' || n || '步和第' || word || '章' ELSE '第' || word || '步和第' || word || '章' END AS step FROM w""")
def chinese_numbers(spark, sf):
    c = F.col("word")
    big = F.concat(F.lit("一千二百"), F.when(F.startswith(c, F.lit("十")), F.concat(F.lit("一"), c)).otherwise(c))
    return numerals(spark, sf).select("o_orderkey", T.cn_to_int(c).alias("whole"), T.loose_number(c).alias("loose"), T.cn_to_number(big).alias("thousands"), T.normalize_steps(F.concat(F.lit("第"), c, F.lit("步和第"), c, F.lit("章"))).alias("step"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w, list_distinct(regexp_extract_all(lower(left(text, 40)), '[a-z]+')) AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) + len(v) = 0 THEN 1 ELSE len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) END AS jaccard FROM w""")
def word_overlap(spark, sf):
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.jaccard(w(F.col("text")), w(F.substring("text", 1, 40))).alias("jaccard"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_shipmode END AS title, l_shipmode || CASE WHEN l_linenumber % 2 = 0 THEN ' > ' || l_returnflag ELSE '' END AS joined,
CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_shipmode END AS first_known, coalesce('PARENT:' || CASE WHEN l_linenumber = 1 THEN l_orderkey END, 'DOCUMENT:' || CASE WHEN l_linenumber = 2 THEN l_suppkey END, CASE WHEN l_linenumber = 3 THEN 'WEB:http://x' END, 'DOCUMENT:' || l_shipmode) AS evidence_key,
'正文' || chr(10) || '文档：《' || l_shipmode || '》' || chr(10) || CASE WHEN l_linenumber % 2 = 0 THEN '章节：' || l_returnflag || chr(10) ELSE '' END || 'text' AS embedded
FROM (SELECT *, 'mode' || (l_suppkey % 7) AS l_shipmode FROM lineitem)""")
def evidence_labels(spark, sf):
    """Leaf titles of paths, first and joined non-blank values, keys of evidence, and what is embedded for a chunk."""
    n, mode, own = F.col("l_linenumber"), F.concat(F.lit("mode"), (F.col("l_suppkey") % 7).cast("string")), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(" ")
    key = T.evidence_key(F.when(n == 1, F.col("l_orderkey")), F.when(n == 2, F.col("l_suppkey")), F.when(n == 3, "http://x"), F.lit(None).cast("string"), F.lit("t"), F.lit("c"))
    named = F.when(n > 3, F.concat(F.lit("DOCUMENT:"), mode)).otherwise(key)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", T.leaf_title(F.concat(mode, F.lit(" > "), own, F.lit(" > "))).alias("title"), T.join_non_blank(" > ", mode, own).alias("joined"), T.first_non_blank(own, mode).alias("first_known"),
        named.alias("evidence_key"), T.context_text(F.lit("正文"), mode, own, F.lit("text")).alias("embedded"),
    )


@query("""SELECT o_orderkey, o_custkey % 101 / 100 AS written, o_custkey % 10 / 100 AS bare, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS parsed FROM orders""")
def model_replies(spark, sf):
    """Scores and objects in what a model wrote: with words and bars around, in fences, or broken."""
    k = F.col("o_custkey")
    fenced = F.concat(F.lit("Sure:\n```json\n{\"score\": "), k.cast("string"), F.lit("}\n```"))
    reply = F.when(F.col("o_orderkey") % 4 == 0, "no object").when(F.col("o_orderkey") % 4 == 1, fenced).otherwise(F.format_string('the result {"score": %d} as asked', k))
    return table(spark, sf, "orders").select(
        "o_orderkey", T.score_from_text(F.format_string("of 7 points, Score: %d", k % 101)).alias("written"), T.score_from_text(F.format_string("I say %d", k % 10)).alias("bare"), T.json_from_reply(reply, "score long")["score"].alias("parsed")
    )


@query("""WITH c AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS t FROM conversations GROUP BY 1), s AS (SELECT conv_id, t, list_transform(range(1, len(t) + 1), lambda i: list_sum(list_transform(t[1:i], lambda x: length(x)))) AS n FROM c)
SELECT conv_id, len(list_filter(n, lambda x: x <= 500)) AS whole FROM s""")
def bounded_contexts(spark, sf):
    """Whole turns from the front while they fit: the first that doesn't ends it."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("t"))
    return c.select("conv_id", F.size(T.bounded_context(F.col("t"), 500)).alias("whole"))


@query("""WITH a AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) > 300 THEN greatest(1, 201 - 45) ELSE 1 END AS lead, substr(text, 201, 10) AS anchor FROM documents),
b AS (SELECT *, CASE WHEN anchor <> '' THEN strpos(text, anchor) ELSE 0 END AS pos FROM a), c AS (SELECT *, least(CASE WHEN pos > 0 THEN greatest(1, pos - (100 - length(anchor)) // 2) ELSE 1 END, greatest(1, n - 99)) AS start FROM b)
SELECT doc_id, CASE WHEN n <= 100 THEN text ELSE CASE WHEN start > 1 THEN '…' ELSE '' END || substr(text, start, 100) || CASE WHEN start + 99 < n THEN '…' ELSE '' END END AS snippet FROM c""")
def soft_windows(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.soft_window(F.col("text"), F.substring("text", 201, 10), 100).alias("snippet"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s、，,；;：:（）()\\-的和及与或]+'), lambda x: length(x) >= 2) AS s FROM conversations),
g AS (SELECT conv_id, turn, flatten(list_transform(s, lambda x: list_concat([x], CASE WHEN length(x) >= 4 THEN flatten(list_transform(range(2, least(6, length(x)) + 1), lambda n: list_transform(range(1, length(x) - n + 2), lambda i: substr(x, i, n)))) ELSE [] END))) AS g FROM s),
u AS (SELECT conv_id, turn, unnest(g) AS t, unnest(range(len(g))) AS i FROM g), f AS (SELECT conv_id, turn, t, min(i) AS i FROM u GROUP BY ALL)
SELECT conv_id, turn, coalesce(list(t ORDER BY f.i) FILTER (t IS NOT NULL), [])[1:40] AS terms FROM conversations LEFT JOIN f USING (conv_id, turn) GROUP BY conv_id, turn""")
def route_terms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.query_terms(F.col("text")).alias("terms"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN [year(o_orderdate)::VARCHAR] ELSE [] END AS years, ['第' || o_orderkey % 30 || '条', '附录B'] AS sections, CASE WHEN o_orderkey % 2 = 0 THEN ['操作手册', 'FAQ', '手册'] ELSE [] END AS names FROM orders""")
def query_filters(spark, sf):
    """Years (of this century), sections and kinds of documents that a question names."""
    k = F.col("o_orderkey")
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit(" 年的第 "), (k % 30).cast("string"), F.lit(" 条和附录 B"), F.when(k % 2 == 0, "，见操作手册与faq").otherwise(""))
    return table(spark, sf, "orders").select(k, T.query_filters(q).alias("f")).select("o_orderkey", "f.years", "f.sections", "f.names")


@query(r"""SELECT conv_id, turn, lower(regexp_replace(coalesce(text, ''), '[\s>`*#_\-，,。；;：:（）()''\[\]]+', '', 'g')) AS form FROM conversations""")
def fallback_forms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_fallback(F.col("text")).alias("form"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE source || '-' || doc_id END AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN try_cast(s AS BIGINT) ELSE (('0x' || left(md5(s), 16))::UBIGINT % 1000000000000000)::BIGINT END AS id FROM s""")
def stable_ids(spark, sf):
    """Names as numbers: digits as they are, else by their digest."""
    name = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", T.stable_id(name).alias("id"))


#: What questions say in front of a turn's text, one for each rule and some that two rules meet.
ASKED = [
    "明天 怎么样", "去年 的 天气", "最新消息", "2024-01-05 的 report", "今天 是 周几", "上面 那个 呢", "compare a vs b", "你好!", "目录 在 哪里", "第3条 是 什么", "它 是 什么", "第 2 步 为什么 失败", "本月 和 历史 数据", "a? b? c?",
    "回顾 本周 最新动态", "部署手册 第二章", "Hello", "现在 股价", "same as before; and then", "3月5日 之前",
]


def asked_turns(spark, sf):
    phrase = F.get(F.array(*map(F.lit, ASKED)), (F.col("turn") + F.col("conv_id")).cast("int") % len(ASKED))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, phrase).otherwise(F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit("")))).alias("q"))


def _listed(words):
    return f"(len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(q, w))) > 0)"


RULES_SQL = rf"""WITH a AS (SELECT conv_id, turn, [{', '.join(repr(p) for p in ASKED)}][((turn + conv_id) % {len(ASKED)})::INTEGER + 1] AS p, text FROM conversations),
q0 AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN p ELSE p || ' ' || coalesce(text, '') END AS q FROM a),
q AS (SELECT *, trim(q, ' ') AS t, {_listed(T.RELATIVE_TIME)} AS relative, {_listed(T.FRESH_DOMAINS)} AS domain, {_listed(T.CALENDAR)} AS calendar, {_listed(T.HISTORICAL)} AS historical, {_listed(T.EVENTS)} AS events,
  regexp_matches(q, '(\d{{4}}[-/.年]\d{{1,2}}[-/.月]\d{{1,2}}日?)|(\d{{1,2}}月\d{{1,2}}日)') AS dated FROM q0),
h AS (SELECT *, {' '.join(f"CASE WHEN {_listed(w.split())} THEN '{h}' ELSE" for h, w in T.HINTS)} '今天' {'END ' * len(T.HINTS)} AS hint,
  t <> '' AND (len(regexp_extract_all(t, '[?？]')) >= 2 OR regexp_matches(t, '[；;]') OR len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '')) >= 2 OR regexp_matches(t, '(^|\s)(\d+[)\.、]|[A-Za-z][)])') OR contains(t, '分别')) AS multi FROM q)
SELECT conv_id, turn, relative OR domain OR calendar AS time, NOT historical AND NOT dated AND NOT calendar AND (domain OR events) AS fresh,
CASE WHEN NOT (NOT (historical AND NOT relative AND NOT calendar) AND (relative OR domain OR calendar)) OR dated OR contains(t, '2024-01-15') OR historical THEN t ELSE t || ' 2024-01-15 ' || hint END AS dated_query,
t <> '' AND length(t) <= 20 AND regexp_matches(t, '它|这个|那个|刚才|前面|上面|上述|这些|那些') AS short_follow_up,
regexp_matches(lower(q), '对比|比较|区别|差异|分别|哪个更|versus|vs') OR (length(q) >= 50 AND regexp_matches(lower(q), '并且|以及|同时|另外|此外|而且|and')) AS decompose,
regexp_matches(lower(t), '^(你好|您好|嗨|hi|hello|hey|谢谢|thanks|thank you|再见|bye)[\s!！.。~]*$') OR regexp_matches(lower(t), '你(是谁|能做什么|会什么|有什么功能)|what can you do|who are you') AS open_chat,
CASE WHEN regexp_matches(q, '上一[章节条步]|下一[章节条步]|目录|大纲|结构|有哪些章节') AND NOT regexp_matches(q, '为什么|原因|分析|对比|区别|如何') AND NOT multi THEN 'GRAPH_ONLY'
WHEN regexp_matches(q, '第\s*[0-9一二三四五六七八九十百]+\s*[步条项点]|步骤\s*[0-9一二三四五六七八九十]+') THEN 'GRAPH_THEN_EVIDENCE' ELSE 'RETRIEVAL' END AS mode FROM h"""


@query(RULES_SQL)
def question_rules(spark, sf):
    """The rules of time, follow-ups, decomposition, greetings and navigation over questions that meet each of them."""
    q = F.col("q")
    return asked_turns(spark, sf).select(
        "conv_id", "turn", T.is_time_sensitive(q).alias("time"), T.needs_fresh_search(q).alias("fresh"), T.dated_query(q, F.lit("2024-01-15")).alias("dated_query"), T.is_short_follow_up(q).alias("short_follow_up"),
        T.may_decompose(q).alias("decompose"), T.is_open_chat(q).alias("open_chat"), T.navigation_mode(q, F.lit(True)).alias("mode"),
    )
