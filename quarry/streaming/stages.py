"""Chains of stages over rows: each row goes through, skips, ends early or fails by itself, and failed rows land in a table.

A stage is column expressions, so a whole chain is one projection of the plan. Batches of a stream are written under their
number, and a batch that is repeated replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GO, SKIP, TERMINATE = "GO", "SKIP", "TERMINATE"


@dataclass
class Stage:
    """values: what the stage puts into columns; error: text where a row fails with them, else null; decision: GO, SKIP or
    TERMINATE, from the columns before (a null one is GO)."""

    name: str
    values: dict[str, Column] = field(default_factory=dict)
    error: Column | None = None
    decision: Column | None = None


def run_chain(rows: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """rows with state (done, terminated, dead), stage (where a row stopped, null if done) and error.

    A failed row keeps the values that it had before the stage that failed, so it can be sent through again from there;
    rows that bring a column `stage` begin at that stage, and one that no stage has begins at the first. Columns that
    stages add are null until then. An error in a stage never stops other rows, so expressions should not raise
    (try_cast, try_divide). An empty table stays empty.
    """
    names = [s.name for s in stages]
    start = F.array_position(F.array(*map(F.lit, names)), F.col("stage")) - 1 if "stage" in rows.columns else F.lit(0)
    own = [c for c in rows.columns if c not in ("stage", "error", "state")]
    out = rows.select(*own, F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)).alias("_from"), F.lit("going").alias("state"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"))
    for i, s in enumerate(stages):
        decision = F.coalesce(s.decision if s.decision is not None else F.lit(GO), F.lit(GO))
        out = out.withColumn("_act", F.when((F.col("state") == "going") & (F.col("_from") <= i), decision).otherwise(SKIP))
        out = out.withColumns({f"_new_{c}": v for c, v in s.values.items()})
        # the error is judged on the row as it would be
        seen = out.select(*[F.col(c) for c in out.columns if c not in s.values], *[F.col(f"_new_{c}").alias(c) for c in s.values], *[F.col(c).alias(f"_old_{c}") for c in s.values if c in out.columns])
        seen = seen.withColumn("_bad", F.when(F.col("_act") == GO, s.error if s.error is not None else F.lit(None).cast("string")))
        keep = lambda c: F.when((F.col("_act") == GO) & F.col("_bad").isNull(), F.col(c)).otherwise(F.col(f"_old_{c}") if c in out.columns else F.lit(None))  # noqa: B023, E731
        ends = F.col("_act") == TERMINATE
        out = seen.select(
            *[F.col(c) for c in own if c not in s.values], *[keep(c).alias(c) for c in s.values], "_from",
            F.when(F.col("_bad").isNotNull(), "dead").when(ends, "terminated").otherwise(F.col("state")).alias("state"),
            F.when(F.col("_bad").isNotNull() | ends, s.name).otherwise(F.col("stage")).alias("stage"), F.coalesce("_bad", "error").alias("error"),
        )
        own = [c for c in own if c not in s.values] + list(s.values)
    return out.withColumn("state", F.when(F.col("state") == "going", "done").otherwise(F.col("state"))).drop("_from")


def write_batches(stages: Sequence[Stage], good: str, dead: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows that end well to one folder, failed ones to the other, each batch in a folder of its number."""

    def write(batch: DataFrame, number: int) -> None:
        rows = run_chain(batch, stages).persist()
        try:
            for path, part in ((dead, rows.where("state = 'dead'")), (good, rows.where("state <> 'dead'"))):
                part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    return write


def dispatch(rows: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], default: str, mode: str = "mode") -> DataFrame:
    """Each row through the branch of its mode (unknown and null ones through the default), with the branch's name in `branch`.

    Branches return the same columns. Each one is planned once, over its own rows, so every row ends in exactly one.
    """
    if default not in branches:
        raise ValueError(f"no branch {default!r}")
    named = rows.withColumn("branch", F.when(F.col(mode).isin(*branches), F.col(mode)).otherwise(default))
    parts = [run(named.where(F.col("branch") == name)).withColumn("branch", F.lit(name)) for name, run in branches.items()]
    return reduce(DataFrame.unionByName, parts)
