"""Conversation memory as state: turns leave once, over restarts and repeats; summaries are the batch merge's."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import memory as M
from quarry.streaming import memory as S
from quarry.streaming import state as Z

SCHEMA = "conv_id long, turn int, role string, text string, covered long"


@pytest.fixture
def store(spark):
    with S.with_store(spark):
        yield


def run(spark, source, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(source)
    merge = S.summary_batches(f"{out}/summaries")

    def both(batch, number):
        batch.persist()
        for _ in range(2):
            merge(batch, number)
            batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        batch.unpersist()

    S.leaving(stream, 2).writeStream.foreachBatch(both).option("checkpointLocation", f"{out}/offsets").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)


def test_turns_leave_once_and_summaries_follow(spark, store, tmp_path):
    r = random.Random(5)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"question {c} {t}" if r.random() < 0.9 else None, 1 if c % 3 == 0 else None) for c in range(1, 7) for t in range(r.choice([0, 1, 2, 3, 8]))]
    shuffled = [*r.sample(rows, len(rows)), *r.sample(rows, 5), (None, 1, "user", "x", None), (1, None, "user", "x", None)]
    write = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write(shuffled[: len(rows) // 2])
    run(spark, f"{tmp_path}/in", tmp_path / "out")
    write(shuffled[len(rows) // 2 :])
    run(spark, f"{tmp_path}/in", tmp_path / "out")
    got = sorted((x.conv_id, x.turn, x.role, x.text or "") for x in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    whole = spark.createDataFrame(rows, SCHEMA)
    want = Z.uncovered(whole.drop("covered"), whole.where("covered is not null").select("conv_id", "covered").distinct(), keep=2)
    assert got == sorted((x.conv_id, x.turn, x.role, x.text or "") for x in want.collect()) and got
    known = None
    for number in (0, 1):
        batch = spark.read.parquet(f"{tmp_path}/out/rows/batch={number}")
        summaries = S.latest(spark, f"{tmp_path}/out/summaries", number)
        known = spark.createDataFrame([], summaries.schema) if known is None else known
        merged = M.merge_summaries(known, M.exchanges(batch))
        expect = merged.unionByName(known.join(merged.select("conv_id"), "conv_id", "left_anti"))
        assert sorted(map(str, summaries.collect())) == sorted(map(str, expect.collect()))
        known = summaries
    assert known.where(F.col("summary") != "").count() > 0
