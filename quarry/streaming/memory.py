"""Conversation memory as state of a stream: which turns leave the window, and what a conversation's summary is by then.

The window of a conversation lies in keyed state (RocksDB), so a restart goes on where the checkpoint ends, and turns that
are delivered again are not counted again. Summaries are versions keyed by the batch, so a batch that is run again
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import memory as M

#: The state store that keyed state of several variables needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SUMMARY = "conv_id {kind}, summary string, goal string, pending array<string>, hints array<string>"


@contextmanager
def with_store(spark: SparkSession) -> Iterator[None]:
    """The state store that `leaving` needs, for queries started inside; then the session's own again."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


class Window(StatefulProcessor):
    """Holds the last `keep` turns of a conversation and gives each one out once when later ones push it out."""

    def __init__(self, keep: int, ttl_ms: int | None) -> None:
        self.keep, self.ttl = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "turn long", "role string, text string, covered long", self.ttl)
        self.left = handle.getMapState("left", "turn long", "left boolean", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out = {k[0]: tuple(v) for k, v in self.held.iterator()}, []
        text = lambda x: None if x is None or x != x else x
        for frame in rows:
            for turn, *said, covered in zip(frame["turn"].tolist(), frame["role"].tolist(), frame["text"].tolist(), frame["covered"].tolist(), strict=True):
                if turn in held or self.left.containsKey((turn,)):
                    continue
                held[turn] = (*map(text, said), int(covered))
                self.held.updateValue((turn,), held[turn])
                if len(held) > self.keep:
                    first = min(held)
                    role, words, mark = held.pop(first)
                    self.held.removeKey((first,))
                    self.left.updateValue((first,), (True,))
                    if first > mark:
                        out.append((key[0], first, role, words))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "int64"})

    def close(self) -> None:
        pass


def leaving(turns: DataFrame, keep: int = 4, ttl_ms: int | None = None) -> DataFrame:
    """conv_id, turn, role, text: turns of a stream (these and covered, null for none) above the covered mark, each once, when
    `keep` later ones are known.

    Turns may come in any order and again; a conversation's state is its last `keep` turns and the numbers of those that
    left. ttl_ms: state that nothing has touched for so long is dropped, after which its conversation starts anew. Turns
    without a conversation or a number are passed over. The session must use the store that with_store sets.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.coalesce(F.col("covered").cast("long"), F.lit(-1).cast("long")).alias("covered"))
    return rows.groupBy("conv_id").transformWithStateInPandas(Window(keep, ttl_ms), f"conv_id {kind}, turn long, role string, text string", "append", "processingTime" if ttl_ms else "none")


def summary_batches(path: str, kind: str = "long") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges the exchanges of turns that left into the summaries of the version before.

    Version n lies in path/version=n and holds the conversations that batch n changed; it is written whole, or again with the
    same rows if the batch is repeated. A question and its answer that leave in different batches count as two exchanges, as
    in a compression of the turns at hand.
    """

    def merge(batch: DataFrame, number: int) -> None:
        known = latest(batch.sparkSession, path, number - 1, kind)
        M.merge_summaries(known, M.exchanges(batch)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return merge


def latest(spark: SparkSession, path: str, number: int, kind: str = "long") -> DataFrame:
    """Each conversation's summary as of batch `number`; none below 0."""
    schema = SUMMARY.format(kind=kind)
    if number < 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, version long").parquet(path).where(F.col("version") <= number)
    newest = rows.groupBy("conv_id").agg(F.max_by(F.struct("summary", "goal", "pending", "hints"), "version").alias("s"))
    return newest.select("conv_id", "s.*")
