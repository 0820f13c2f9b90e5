"""Queries of conversation memory over conversations, and of references and chunks over orders and their lines."""

from pyspark.sql import functions as F

from quarry.operators import analytics as A
from quarry.operators import memory as M
from quarry.operators import routing as G
from quarry.registry import query, table


def exchanges(spark, sf):
    return M.exchanges(table(spark, sf, "conversations"))


#: Exchanges, trimmed; q and a are clipped to a line's limits, back counts from the last one.
E_SQL = """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS question, CASE WHEN r2 = 'assistant' THEN regexp_replace(coalesce(t2, ''), '^\\s+|\\s+$', '', 'g') ELSE '' END AS answer FROM t WHERE role = 'user'),
x AS (SELECT *, CASE WHEN length(question) > 160 THEN left(question, 159) || '…' ELSE question END AS q, CASE WHEN length(answer) > 320 THEN left(answer, 319) || '…' ELSE answer END AS a,
row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM e)"""
BOTH = "array_to_string(list_filter([CASE WHEN q <> '' THEN '用户：' || q END, CASE WHEN a <> '' THEN '助手：' || a END], lambda y: y IS NOT NULL), chr(10))"


@query(E_SQL + f""", j AS (SELECT conv_id, '【最近对话原文】' || chr(10) || string_agg({BOTH}, chr(10) ORDER BY turn) AS s FROM x WHERE back <= 4 GROUP BY 1)
SELECT conv_id, CASE WHEN length(s) > 2200 THEN '…' || right(s, 2199) ELSE s END AS transcript FROM j""")
def transcripts(spark, sf):
    """The last four exchanges of each conversation, whole but for the lines' limits."""
    return M.transcripts(A.last_turns(exchanges(spark, sf), "conv_id", "turn", 4))


@query(E_SQL + """, j AS (SELECT conv_id, '【最近相关对话】' || chr(10) || string_agg('用户：' || q, chr(10) ORDER BY turn) AS s FROM x WHERE back <= 4 GROUP BY 1)
SELECT conv_id, CASE WHEN length(s) > 1000 THEN '…' || right(s, 999) ELSE s END AS transcript FROM j""")
def answer_transcripts(spark, sf):
    return M.transcripts(A.last_turns(exchanges(spark, sf), "conv_id", "turn", 4), kind="answer")


@query(E_SQL + f""" SELECT conv_id || '-' || ((n - 1) // 2) AS batch, string_agg({BOTH}, chr(10) ORDER BY turn) AS transcript FROM x WHERE back > 1 GROUP BY conv_id, (n - 1) // 2""")
def compression_transcripts(spark, sf):
    batches = A.overflow_batches(exchanges(spark, sf), "conv_id", "turn", 1, 2)
    return M.transcripts(batches.withColumn("batch", F.concat_ws("-", "conv_id", "batch")), "batch", kind="compression")


@query("""WITH h AS (SELECT conv_id, turn, regexp_extract_all(text, '[a-zA-Z0-9._-]{2,}') AS h FROM conversations) SELECT conv_id, turn, list_filter(h, lambda x, i: list_position(h, x) = i)[1:6] AS hints FROM h""")
def retrieval_hints(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", M.retrieval_hints(F.col("text")).alias("hints"))


@query(E_SQL + """, b AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS last, CASE WHEN length(question) > 80 THEN left(question, 79) || '…' ELSE question END AS q8, CASE WHEN length(answer) > 80 THEN left(answer, 79) || '…' ELSE answer END AS a8 FROM x),
g AS (SELECT conv_id, string_agg('用户关注：' || q8 || CASE WHEN a8 <> '' THEN '；已有结论：' || a8 ELSE '' END, '；' ORDER BY turn) FILTER (n <= 2) AS s, list(q8 ORDER BY turn) AS asked, max(question) FILTER (n = last) AS final FROM b GROUP BY 1),
p AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '旧摘要；' || s ELSE s END AS s, list_concat(CASE WHEN conv_id % 2 = 0 THEN ['旧问题'] ELSE [] END, asked) AS asked, final, regexp_extract_all(final, '[a-zA-Z0-9._-]{2,}') AS h FROM g)
SELECT conv_id, CASE WHEN length(s) > 1400 THEN left(s, 1399) || '…' ELSE s END AS summary, CASE WHEN length(final) > 120 THEN left(final, 119) || '…' ELSE final END AS goal,
list_filter(asked, lambda v, i: list_position(asked, v) = i)[1:6] AS pending, list_filter(h, lambda v, i: list_position(h, v) = i)[1:6] AS hints FROM p""")
def merged_summaries(spark, sf):
    e = exchanges(spark, sf)
    known = e.where("conv_id % 2 = 0").select("conv_id", F.lit("旧摘要").alias("summary"), F.lit("").alias("goal"), F.array(F.lit("旧问题")).alias("pending"), F.array().cast("array<string>").alias("hints")).distinct()
    # two exchanges bring four highlights where both are answered; more exchanges only where some are not
    return M.merge_summaries(known, e)


@query(E_SQL + """, j AS (SELECT conv_id, '用户：' || string_agg(q, chr(10) || '用户：' ORDER BY turn) AS s FROM x WHERE back <= 4 GROUP BY 1), f AS (SELECT conv_id, '【最近相关对话】' || chr(10) || s AS s FROM j), k AS (SELECT conv_id, CASE WHEN length(s) > 1000 THEN '…' || right(s, 999) ELSE s END AS s FROM f), c AS (SELECT conv_id, array_to_string(list_filter(list_transform(string_split(s, chr(10)), lambda v: trim(v)), lambda v: starts_with(v, '用户：')), chr(10)) AS s FROM k), n AS (SELECT *, length(s) AS n FROM c)
SELECT conv_id, CASE WHEN conv_id % 3 = 1 OR s = '' THEN '' WHEN n > 974 THEN '对话承接上下文（仅用于理解指代，不作为事实证据）：' || chr(10) || '…' || right(s, 973) ELSE '对话承接上下文（仅用于理解指代，不作为事实证据）：' || chr(10) || s END AS history FROM n""")
def answer_histories(spark, sf):
    """Questions that refer back see the earlier ones; long ones of their own don't."""
    whole = M.transcripts(A.last_turns(exchanges(spark, sf), "conv_id", "turn", 4), kind="answer")
    k = F.col("conv_id") % 3
    question = F.when(k == 0, "请继续说明上面第二条的内容并给出例子好吗谢谢").when(k == 1, "这里是一个完整而独立的新提问与先前的谈话内容毫无关联请直接回答它").otherwise("Why so?")
    return whole.select("conv_id", M.answer_history(question, F.col("transcript")).alias("history"))


@query("""WITH o AS (SELECT o_orderkey, '【历史背景摘要】' || chr(10) || 'order ' || o_orderkey || chr(10) || chr(10) || '【会话目标】' || chr(10) || 'ship' || chr(10) || chr(10) || '【已确认事实】' || chr(10) || '- a' || chr(10) || '- ' || o_orderpriority
|| CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '【待跟进问题】' || chr(10) || '- 1' || chr(10) || '- 2' || chr(10) || '- 3' || chr(10) || '- 4' || chr(10) || '- 5' ELSE '' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE repeat('x', o_orderkey % 200) END AS r FROM orders),
t AS (SELECT *, CASE WHEN length(r) > 78 THEN '…' || right(r, 77) ELSE r END AS tail FROM o), u AS (SELECT *, 120 - length(tail) - 2 AS room FROM t)
SELECT o_orderkey, CASE WHEN tail = '' THEN CASE WHEN length(s) > 120 THEN left(s, 119) || '…' ELSE s END ELSE CASE WHEN length(s) > room THEN left(s, room - 1) || '…' ELSE s END || chr(10) || chr(10) || tail END AS history FROM u""")
def planning_histories(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    facts = F.array(F.lit("a"), F.lit(" "), F.col("o_orderpriority"))
    pending = F.when(k % 2 == 0, F.array(*[F.lit(str(i)) for i in range(1, 7)])).otherwise(F.array().cast("array<string>"))
    parts = {"summary": F.concat(F.lit("order "), k.cast("string")), "goal": F.lit("ship"), "facts": facts, "pending": pending}
    return o.select(k, M.planning_history(parts, F.when(k % 3 == 0, "").otherwise(F.repeat(F.lit("x"), (k % 200).cast("int"))), 120).alias("history"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey::VARCHAR END, l_returnflag) AS k FROM lineitem) SELECT l_orderkey, l_linenumber FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey, k ORDER BY l_linenumber) = 1""")
def merged_references(spark, sf):
    """References of an order's lines: by id where there is one, else by title; the first of each stays."""
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey").cast("string")).otherwise(" ").alias("id"), F.col("l_returnflag").alias("title"), F.lit("u").alias("url"))
    return M.first_references(refs, ["id", "title", "url"], ["l_orderkey"], ["l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey * 10 + l_linenumber AS chunk, list_filter(list_sort(list_distinct(list(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey))), lambda x: x <> l_orderkey * 10 + l_linenumber) AS siblings FROM lineitem")
def sibling_chunks(spark, sf):
    return M.siblings(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.col("l_linenumber").alias("chunk_no")))


@query("SELECT c_custkey AS doc, count(user_id) FILTER (event_type IN ('click', 'view')) AS active FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def active_tasks(spark, sf):
    tasks = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.when(F.col("event_type") == "click", "new").when(F.col("event_type") == "view", "running").otherwise("done").alias("status"))
    return M.active_tasks(tasks, table(spark, sf, "customer").select(F.col("c_custkey").alias("doc")))


@query("""SELECT l_orderkey * 10 + l_linenumber AS chunk, l_suppkey AS doc, s_name AS name, CASE WHEN l_linenumber < 7 THEN l_orderkey END AS parent, CASE WHEN l_linenumber < 7 THEN left(o_orderpriority, 4) || CASE WHEN length(o_orderpriority) > 5 THEN '…' ELSE substr(o_orderpriority, 5, 1) END END AS parent_text,
CASE WHEN l_linenumber < 7 THEN count(*) FILTER (l_linenumber < 7) OVER (PARTITION BY l_orderkey) - 1 ELSE 0 END AS siblings FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def chunk_details(spark, sf):
    c = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.col("l_suppkey").alias("doc"), F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("parent"))
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("parent"), F.col("o_orderpriority").alias("text"))
    return M.chunk_details(c, parents, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc"), F.col("s_name").alias("name")), 5)


@query("""SELECT c_custkey AS exchange, coalesce((SELECT arg_max(event_type, event_id) FROM events WHERE user_id = c_custkey AND event_id % 2 = 0), 'stored') AS status, (SELECT max(event_id) FROM events WHERE user_id = c_custkey AND event_id % 2 = 1) AS trace FROM customer""")
def session_view(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("exchange"), F.col("event_type").alias("state"), F.col("event_id").alias("at"), F.col("event_id").alias("trace"))
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("exchange"), F.lit("stored").alias("status"))
    return M.session_view(stored, e.where("at % 2 = 0"), e.where("at % 2 = 1"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN ['a', l_returnflag] WHEN 1 THEN CASE WHEN l_returnflag = 'N' THEN ['N'] ELSE [l_returnflag, 'N'] END ELSE ['m', 'n'] END AS questions FROM lineitem""")
def reconciled_rewrites(spark, sf):
    """Nothing from the model: the rules' parts. One merged question where the rules split: the parts too. Else the model's."""
    k, flag = F.col("l_linenumber") % 3, F.col("l_returnflag")
    model = F.when(k == 0, F.array(F.lit(" "))).when(k == 1, F.array(F.lit("all"))).otherwise(F.array(F.lit("m"), F.lit("n "), F.lit("m")))
    rules = F.when(k == 0, F.array(F.lit("a"), flag)).otherwise(F.array(flag, F.lit("N")))
    merged = G.reconcile_rewrite(model, rules)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when((k == 1) & (flag == "N"), F.array(flag)).otherwise(merged).alias("questions"))


@query("""SELECT l_orderkey AS plan, l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'own' ELSE 't' || (o_custkey % 5) END AS tenant, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE o_orderpriority END AS scope, CASE WHEN l_linenumber = 1 THEN [9] ELSE [o_custkey] END AS doc_ids
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'""")
def inherited_scopes(spark, sf):
    li = table(spark, sf, "lineitem")
    steps = li.select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("id"), F.when(F.col("l_linestatus") == "F", "RETRIEVAL").otherwise("DANCE").alias("mode"), F.when(F.col("l_linenumber") % 2 == 0, "own").otherwise(" ").alias("tenant"),
                      F.when(F.col("l_returnflag") == "A", "A").alias("scope"), F.when(F.col("l_linenumber") == 1, F.array(F.lit(9).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("doc_ids"))
    plans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("plan"), F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tenant"), F.col("o_orderpriority").alias("scope"), F.array("o_custkey").alias("doc_ids"))
    return G.inherit_scope(steps, plans).select("plan", "id", "tenant", "scope", "doc_ids")
