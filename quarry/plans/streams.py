"""Queries of stateful behaviours over events. The streaming forms of the same operators are in quarry.streaming."""

from pyspark.sql import functions as F

from quarry.registry import query, table
from quarry.sources import changes
from quarry.sources.files import shared_folder
from quarry.streaming import memory
from quarry.streaming import stages as S
from quarry.streaming import state as Z


def events(spark, sf):
    return table(spark, sf, "events").withColumn("second", F.unix_timestamp("ts"))


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS t FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events)), r AS (SELECT user_id, list(event_id ORDER BY t, event_id) AS ids,
list_reduce(list({'t': t, 'log': []::BIGINT[], 'ok': []::BOOLEAN[]} ORDER BY t, event_id), lambda a, x: {'t': x.t, 'log': CASE WHEN len(list_filter(a.log, lambda v: v > x.t - 86400)) < 2 THEN list_append(list_filter(a.log, lambda v: v > x.t - 86400), x.t) ELSE list_filter(a.log, lambda v: v > x.t - 86400) END,
'ok': list_append(a.ok, len(list_filter(a.log, lambda v: v > x.t - 86400)) < 2)}, {'t': 0::BIGINT, 'log': []::BIGINT[], 'ok': []::BOOLEAN[]}) AS s FROM e GROUP BY 1)
SELECT user_id, unnest(ids) AS event_id, unnest(s.ok) AS admitted FROM r""")
def rate_limit(spark, sf):
    return Z.rate_limit(events(spark, sf).select("user_id", "event_id", "second"), 2, 86_400).drop("second")


@query("""WITH e AS (SELECT user_id % 20 AS resource, event_id, epoch(date_trunc('second', ts))::BIGINT AS t, user_id::VARCHAR AS o, CASE event_type WHEN 'error' THEN 'release' WHEN 'view' THEN 'renew' ELSE 'acquire' END AS act FROM events),
r AS (SELECT resource, list(event_id ORDER BY t, event_id) AS ids, list_reduce(list({'t': t, 'o': o, 'act': act, 'ends': 0::BIGINT, 'ok': []::BOOLEAN[]} ORDER BY t, event_id), lambda a, x: CASE
WHEN a.o <> '' AND a.ends > x.t AND a.o <> x.o THEN {'t': x.t, 'o': a.o, 'act': '', 'ends': a.ends, 'ok': list_append(a.ok, false)} WHEN x.act = 'acquire' OR (x.act = 'renew' AND a.o = x.o AND a.ends > x.t) THEN {'t': x.t, 'o': x.o, 'act': '', 'ends': x.t + 7200, 'ok': list_append(a.ok, true)}
WHEN x.act = 'renew' THEN {'t': x.t, 'o': '', 'act': '', 'ends': 0::BIGINT, 'ok': list_append(a.ok, false)} ELSE {'t': x.t, 'o': '', 'act': '', 'ends': 0::BIGINT, 'ok': list_append(a.ok, a.o = x.o AND a.ends > x.t)} END, {'t': 0::BIGINT, 'o': '', 'act': '', 'ends': 0::BIGINT, 'ok': []::BOOLEAN[]}) AS s FROM e GROUP BY 1)
SELECT resource, unnest(ids) AS event_id, unnest(s.ok) AS granted FROM r""")
def lease_log(spark, sf):
    action = F.when(F.col("event_type") == "error", "release").when(F.col("event_type") == "view", "renew").otherwise("acquire")
    e = events(spark, sf).select((F.col("user_id") % 20).alias("resource"), "event_id", "second", F.col("user_id").cast("string").alias("owner"), action.alias("action"))
    return Z.leases(e, 7200).select("resource", "event_id", "granted")


@query("""WITH e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS t, event_type = 'error' AS f FROM events), r AS (SELECT user_id, list(event_id ORDER BY t, event_id) AS ids,
list_reduce(list({'t': t, 'f': f, 'n': 0, 'since': -1::BIGINT, 'met': []::VARCHAR[]} ORDER BY t, event_id), lambda a, x: CASE WHEN a.since >= 0 AND x.t < a.since + 86400 THEN {'t': x.t, 'f': false, 'n': a.n, 'since': a.since, 'met': list_append(a.met, 'rejected')}
WHEN NOT x.f THEN {'t': x.t, 'f': false, 'n': 0, 'since': -1::BIGINT, 'met': list_append(a.met, CASE WHEN a.since >= 0 THEN 'half_open' ELSE 'closed' END)} WHEN a.since >= 0 OR a.n + 1 >= 2 THEN {'t': x.t, 'f': false, 'n': a.n + 1, 'since': x.t, 'met': list_append(a.met, CASE WHEN a.since >= 0 THEN 'half_open' ELSE 'closed' END)}
ELSE {'t': x.t, 'f': false, 'n': a.n + 1, 'since': -1::BIGINT, 'met': list_append(a.met, 'closed')} END, {'t': 0::BIGINT, 'f': false, 'n': 0, 'since': -1::BIGINT, 'met': []::VARCHAR[]}) AS s FROM e GROUP BY 1)
SELECT user_id, unnest(ids) AS event_id, unnest(s.met) AS met FROM r""")
def circuit_breaker(spark, sf):
    return Z.circuit(events(spark, sf).select("user_id", "event_id", "second", (F.col("event_type") == "error").alias("failed")), 2, 86_400).select("user_id", "event_id", "met")


@query("""WITH e AS (SELECT user_id % 5 AS model, event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events), r AS (SELECT model, list(event_id ORDER BY t, event_id) AS ids, list_reduce(list({'t': t, 'since': 0::BIGINT, 'n': 0, 'b': []::INT[]} ORDER BY t, event_id),
lambda a, x: CASE WHEN a.n > 0 AND x.t < a.since + 3600 AND a.n < 4 THEN {'t': x.t, 'since': a.since, 'n': a.n + 1, 'b': list_append(a.b, a.b[-1])} ELSE {'t': x.t, 'since': x.t, 'n': 1, 'b': list_append(a.b, coalesce(a.b[-1], 0) + 1)} END, {'t': 0::BIGINT, 'since': 0::BIGINT, 'n': 0, 'b': []::INT[]}) AS s FROM e GROUP BY 1)
SELECT model, unnest(ids) AS event_id, unnest(s.b) AS batch FROM r""")
def micro_batches(spark, sf):
    """Requests to five models in batches of four at most within an hour from their first."""
    e = events(spark, sf).select((F.col("user_id") % 5).alias("model"), "event_id", F.col("second").alias("ms"))
    return Z.micro_batches(e, 3600, 4).select("model", "event_id", "batch")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, before IS NULL OR (before, event_type) IN (('view', 'click'), ('click', 'purchase'), ('view', 'view')) AS legal FROM e""")
def legal_transitions(spark, sf):
    legal = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view")], "before string, after string")
    return Z.transitions(table(spark, sf, "events"), legal, "user_id", "event_type", ["ts", "event_id"]).select("event_id", "before", "legal")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def hourly_counters(spark, sf):
    return Z.windowed_counters(table(spark, sf, "events"), "ts", "event_type", "value", "1 hour").withColumn("total", F.round("total", 2))


@query("SELECT event_id, s AS subscriber FROM events, (VALUES ('all', '*'), ('views', 'view'), ('p', 'pur')) t(s, p) WHERE p = '*' OR p = event_type")
def event_routing(spark, sf):
    subs = spark.createDataFrame([("all", "*"), ("views", "view"), ("p", "pur")], "subscriber string, pattern string")
    return Z.route_events(table(spark, sf, "events"), subs).select("event_id", "subscriber")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10 AND event_id >= 5000")
def replay_buffer(spark, sf):
    return Z.replay(table(spark, sf, "events"), "user_id", F.lit(5000), 10).select("user_id", "event_id")


@query("""WITH c AS (SELECT user_id AS k, arg_max(event_id, ts) AS answer FROM (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 5 DAY AND user_id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1)
SELECT u AS key, answer FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN c ON k = u""")
def response_cache(spark, sf):
    e = table(spark, sf, "events")
    cache = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("answer"), (F.col("user_id") % 10).alias("doc"), F.col("ts").alias("stored_at"))
    invalid = spark.range(1).select(F.lit(3).cast("long").alias("doc"))
    return Z.cached_answers(e.select(F.col("user_id").alias("key")).distinct(), cache, invalid, F.lit("2024-01-15").cast("timestamp"), "INTERVAL 5 DAYS")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def incremental_sync(spark, sf):
    return Z.since(table(spark, sf, "events"), F.lit("2024-01-15").cast("timestamp"), "ts").select("event_id")


@query("SELECT event_id, ts, value, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS run FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def incremental_source(spark, sf):
    """Events of a table that grows, by a stream that is stopped and started again: each row once, in the run that it was new to; the last day is held back for rows that come late."""
    changes.register(spark)
    source, out = shared_folder(spark, "growing"), shared_folder(spark, "synced")
    e, day = table(spark, sf, "events"), F.lit("2024-01-15").cast("timestamp")
    late = 86_400_000_000
    for run, rows in enumerate([e.where(F.col("ts") < day), e.where(F.col("ts") >= day)], 1):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.format("changes").options(path=source, column="ts", lateness=str(late if run == 2 else 0)).schema(e.schema).load()

        def keep(batch, number, run=run):
            batch.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "ts", "value", "run")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n > 4 AND turn > CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END")
def memory_high_water(spark, sf):
    c = table(spark, sf, "conversations")
    marks = c.where("conv_id % 2 = 0").select("conv_id", F.lit(1).alias("covered")).distinct()
    return Z.uncovered(c, marks).select("conv_id", "turn")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n > 4 AND turn > CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END")
def memory_stream(spark, sf):
    """The turns that the high-water mark takes, out of the state of a stream of files that is stopped half-way and started again."""
    source, out = shared_folder(spark, "turns"), shared_folder(spark, "memory")
    c = table(spark, sf, "conversations").withColumn("covered", F.when(F.col("conv_id") % 2 == 0, 1))
    half = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2))
    merge = memory.summary_batches(f"{out}/summaries", c.schema["conv_id"].dataType.simpleString())

    def keep(batch, number):
        batch.persist()
        merge(batch, number)
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        batch.unpersist()

    with memory.with_store(spark):
        for k in (0, 1):
            c.where(half == k).write.mode("append").parquet(source)
            stream = spark.readStream.schema(c.schema).parquet(source)
            memory.leaving(stream).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/offsets").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("conv_id", "turn", "role", "text")


def stages():
    return [
        S.Stage("parse", {"k": F.get_json_object("props", "$.k").try_cast("long")}, F.when(F.col("k").isNull(), "no k")),
        S.Stage("check", error=F.when(F.col("k") % 10 == 3, F.concat(F.lit("bad k "), F.col("k").cast("string"))), decision=F.when(F.col("event_type") == "view", S.TERMINATE).when(F.col("event_type") == "click", S.SKIP)),
        S.Stage("price", {"value": F.round(F.col("value") * 2, 2)}, F.when(F.col("value") > 900, "too dear")),
    ]


@query("""WITH p AS (SELECT event_id, event_type, value, (props::JSON->>'k')::BIGINT AS k FROM events),
s AS (SELECT *, CASE WHEN k IS NULL THEN 'parse' WHEN event_type = 'view' OR (event_type <> 'click' AND k % 10 = 3) THEN 'check' WHEN round(value * 2, 2) > 900 THEN 'price' END AS stage FROM p)
SELECT event_id, stage, CASE WHEN stage IS NULL THEN 'done' WHEN stage = 'check' AND event_type = 'view' THEN 'terminated' ELSE 'dead' END AS state, k, CASE WHEN stage IS NULL THEN round(value * 2, 2) ELSE value END AS value,
CASE WHEN stage = 'parse' THEN 'no k' WHEN stage = 'check' AND event_type <> 'view' THEN 'bad k ' || k WHEN stage = 'price' THEN 'too dear' END AS error FROM s""")
def dead_letters(spark, sf):
    """Events of a stream through three stages; each batch is written twice, as after a restart, and rows that fail land in a table of their own once."""
    source, out = shared_folder(spark, "events"), shared_folder(spark, "staged")
    table(spark, sf, "events").repartition(3, "event_id").write.parquet(source)
    write = S.write_batches(stages(), f"{out}/good", f"{out}/dead")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", "2").parquet(source)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    good, dead = (spark.read.parquet(f"{out}/{x}") for x in ("good", "dead"))
    return good.unionByName(dead).select("event_id", "stage", "state", "k", "value", "error")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'ask' WHEN role = 'assistant' THEN 'answer' ELSE 'other' END AS branch, CASE WHEN role = 'user' THEN length(text) WHEN role = 'assistant' THEN turn * 2 ELSE -1 END::BIGINT AS result FROM conversations")
def mode_dispatch(spark, sf):
    """Turns of conversations through the branch of their role, each turn in exactly one."""
    c = table(spark, sf, "conversations").withColumn("mode", F.when(F.col("role") == "user", "ask").when(F.col("role") == "assistant", "answer").otherwise(F.col("role")))
    result = lambda v: lambda df: df.select("conv_id", "turn", v.cast("long").alias("result"))
    return S.dispatch(c, {"ask": result(F.length("text")), "answer": result(F.col("turn") * 2), "other": result(F.lit(-1))}, "other")
