"""Stateful behaviours over events: as batch folds over a key's ordered events, and as Structured Streaming operators.

The folds are the functions that the streaming operators call, so both give the same decisions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- decisions over one key's events ----------------------------------------------------------------------------------


def admit(log: list[int], at: int, limit: int, window: int) -> tuple[bool, list[int]]:
    """Sliding log: entries older than the window go; a refused request is not logged."""
    log = [x for x in log if x > at - window]
    ok = len(log) < limit
    return ok, [*log, at] if ok else log


def lease(held: tuple[str, int] | None, at: int, owner: str, action: str, ttl: int) -> tuple[bool, tuple[str, int] | None]:
    """Acquire, renew or release a lease that ends by itself after its time to live."""
    if held and held[1] <= at:
        held = None
    if action == "acquire":
        return (True, (owner, at + ttl)) if held is None or held[0] == owner else (False, held)
    own = held is not None and held[0] == owner
    if action == "renew":
        return own, (owner, at + ttl) if own else held
    return own, None if own else held


def breaker(state: tuple[str, int, int], at: int, failed: bool, threshold: int, cooldown: int) -> tuple[str, tuple[str, int, int]]:
    """Circuit breaker (state, failures, opened at). Returns what the call met: closed, half_open or rejected."""
    name, failures, opened = state
    if name == "open":
        if at < opened + cooldown:
            return "rejected", state
        name = "half_open"
    if failed:
        failures += 1
        return name, ("open", failures, at) if name == "half_open" or failures >= threshold else ("closed", failures, opened)
    return name, ("closed", 0, 0)


def batched(state: tuple[int, int, int], at: int, window: int, most: int) -> tuple[int, tuple[int, int, int]]:
    """Micro-batches (number, begun at, size): a request joins the open batch within the window from its first one, up to `most`."""
    number, begun, size = state
    if size and at < begun + window and size < most:
        return number, (number, begun, size + 1)
    number += 1
    return number, (number, at, 1)


def _fold(events: DataFrame, key: str, order: Sequence[str], out: str, kind: str, needed: Sequence[str], step: Callable[..., tuple[object, object]], start: object) -> DataFrame:
    """events with `out`: step's answer at each event of a key in their order, from the state and the needed columns' values.

    Keys are dealt by hash and sorted, and a task walks its rows once with one key's state in hand, so a hot key costs
    its rows' time but no memory.
    """
    names = events.columns

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start
        for frame in frames:
            answers = []
            for own, *values in zip(frame[key].tolist(), *(frame[c].tolist() for c in needed), strict=True):
                if own != now:
                    now, state = own, start
                answer, state = step(state, *values)
                answers.append(answer)
            frame[out] = answers
            yield frame

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema), f"`{out}` {kind}"])
    return events.repartition(key).sortWithinPartitions(key, *order).select(*names).mapInPandas(walk, schema)


def rate_limit(events: DataFrame, limit: int = 5, window: int = 60, key: str = "user_id", ts: str = "second", order: Sequence[str] = ("second", "event_id")) -> DataFrame:
    """events with `admitted`; ts in whole seconds."""
    return _fold(events, key, order, "admitted", "boolean", [ts], lambda s, at: admit(s, int(at), limit, window), [])


def leases(events: DataFrame, ttl: int = 30, key: str = "resource", order: Sequence[str] = ("second", "event_id")) -> DataFrame:
    """events (resource, second, owner, action) with `granted`."""
    return _fold(events, key, order, "granted", "boolean", ["second", "owner", "action"], lambda s, at, owner, action: lease(s, int(at), owner, action, ttl), None)


def circuit(events: DataFrame, threshold: int = 3, cooldown: int = 60, key: str = "user_id", order: Sequence[str] = ("second", "event_id")) -> DataFrame:
    """events (second, failed) with `met`."""
    return _fold(events, key, order, "met", "string", ["second", "failed"], lambda s, at, failed: breaker(s, int(at), bool(failed), threshold, cooldown), ("closed", 0, 0))


def micro_batches(events: DataFrame, window: int = 20, most: int = 4, key: str = "model", ts: str = "ms", order: Sequence[str] = ("ms", "event_id")) -> DataFrame:
    """events with `batch`, the number of the batch that each request runs in (from 1 for each key)."""
    return _fold(events, key, order, "batch", "int", [ts], lambda s, at: batched(s, int(at), window, most), (0, 0, 0))


#: Legal moves of an exchange (fixed values).
MOVES = {("created", "running"), ("running", "completed"), ("running", "failed"), ("running", "stopped"), ("created", "failed")}


def transitions(events: DataFrame, legal: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    """events with the state before and whether the move is legal (the first one always is). legal: before, after; a short list."""
    was = events.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
    moves = legal.select(F.col("before").alias("_b"), F.col("after").alias("_a"), F.lit(True).alias("_ok"))
    return was.join(moves, (F.col("before") == F.col("_b")) & (F.col(state) == F.col("_a")), "left").withColumn("legal", F.col("before").isNull() | F.coalesce("_ok", F.lit(False))).drop("_b", "_a", "_ok")


# --- Structured Streaming ---------------------------------------------------------------------------------------------


def rate_limit_stream(events: DataFrame, limit: int = 5, window: int = 60) -> DataFrame:
    """The same limiter over a stream of (user_id, event_id, second); the log lives in the key's state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values(["second", "event_id"])
            admitted = []
            for at in frame["second"]:
                ok, log = admit(log, int(at), limit, window)
                admitted.append(ok)
            yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"], "second": frame["second"], "admitted": admitted})
        state.update((log,))

    out = "user_id long, event_id long, second long, admitted boolean"
    return events.select("user_id", "event_id", "second").groupBy("user_id").applyInPandasWithState(step, out, "log array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counters(events: DataFrame, ts: str, kind: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by kind and window, for batches and streams; late rows beyond the watermark drop out of streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def route_events(events: DataFrame, subscriptions: DataFrame, name: str = "event_type") -> DataFrame:
    """(event columns, pattern, subscriber): exact names, `*`, and `prefix.*`. subscriptions: subscriber, pattern, any number of them.

    A name's patterns are few (itself, `*`, and one behind each of its dots), so both sides meet by equality; an event goes
    once to each subscription that fits it. Null names fit none; null patterns fit nothing.
    """
    parts = F.split(F.col(name), r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k - 1), "."), F.when(k > 1, F.lit(".*")).otherwise(F.lit("*"))))
    fits = F.when(F.col(name).isNotNull(), F.array_distinct(F.concat(F.array(F.col(name)), prefixes)))
    return events.withColumn("pattern", F.explode(fits)).join(subscriptions, "pattern")


def replay(log: DataFrame, stream: str, offset: Column, last: int = 500, order: str = "event_id", alive: Column | None = None) -> DataFrame:
    """The last events of each stream from an offset on. alive: a condition that events outside their time to live don't meet."""
    log = log if alive is None else log.where(alive)
    n = F.row_number().over(Window.partitionBy(stream).orderBy(F.desc(order)))
    return log.withColumn("_n", n).where((F.col("_n") <= last) & (F.col(order) >= offset)).drop("_n")


def cached_answers(asked: DataFrame, cache: DataFrame, invalid: DataFrame, now: Column, ttl: str = "INTERVAL 1 HOUR") -> DataFrame:
    """asked with the cached answer: neither older than its time to live nor of an invalidated document. cache: key, answer, doc, stored_at."""
    live = cache.where(F.col("stored_at") > now - F.expr(ttl)).join(invalid.select("doc").distinct(), "doc", "left_anti")
    latest = live.groupBy("key").agg(F.max_by("answer", "stored_at").alias("answer"))
    return asked.join(latest, "key", "left")


def staged(stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], failed: Callable[[str, Exception], None], retries: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each stage in turn, tried again, and `failed` called with what can't go on."""

    def run(batch: DataFrame, _: int) -> None:
        for name, stage in stages:
            for k in range(retries + 1):
                try:
                    batch = stage(batch)
                    break
                except Exception as e:
                    if k == retries:
                        failed(name, e)
                        return

    return run


def sink_by_pattern(sinks: dict[str, Callable[[DataFrame], None]], name: str = "event_type") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each subscriber the rows of its pattern."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        for pattern, sink in sinks.items():
            n = F.col(name)
            fits = F.lit(True) if pattern == "*" else F.startswith(n, F.lit(pattern[:-1])) if pattern.endswith(".*") else n == pattern
            sink(batch.where(fits))
        batch.unpersist()

    return run


def since(df: DataFrame, mark: Column, updated: str = "updated_at") -> DataFrame:
    """Incremental sync: rows from the high-water mark on, so the filter reaches the scan."""
    return df.where(F.col(updated) >= mark)


def uncovered(turns: DataFrame, marks: DataFrame, key: str = "conv_id", order: str = "turn", keep: int = 4) -> DataFrame:
    """Turns above a conversation's covered mark and below its last `keep`: what the next compression takes."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_n", n).where(F.col("_n") > keep).drop("_n").join(marks, key, "left").where(F.col(order) > F.coalesce("covered", F.lit(-1))).drop("covered")
