"""Table functions for SQL: `SELECT * FROM rag_search(TABLE(SELECT query, chunk, channel, rank FROM hits), 50)`."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

CHANNELS = ("vector", "keyword")


def rounded(x: float, places: int) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


class RagSearch:
    """The first k chunks of each question by reciprocal rank fusion of its hits (query, chunk, channel, rank).

    The table is dealt out by question, as `analyze` says, so a call needs no PARTITION BY; one question's hits, which the
    channels bound, are held at a time. Hits of other channels, and those without chunk or rank, don't count.
    """

    def __init__(self) -> None:
        self.query, self.most, self.constant = None, 0, 0
        self.sums: dict = {}

    @staticmethod
    def analyze(hits: AnalyzeArgument, k: AnalyzeArgument, constant: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not hits.isTable:
            raise ValueError("rag_search takes a table of hits: TABLE(...)")
        types = {f.name: f.dataType for f in hits.dataType.fields}
        if missing := {"query", "chunk", "channel", "rank"} - set(types):
            raise ValueError(f"the hits lack {sorted(missing)}")
        if not isinstance(k.value, int) or k.value < 1:
            raise ValueError("k must be a constant of 1 or more")
        schema = StructType().add("query", types["query"]).add("chunk", types["chunk"]).add("rrf_score", DoubleType()).add("channel", StringType())
        schema = schema.add("vector_rank", LongType()).add("keyword_rank", LongType()).add("rank", IntegerType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("query")])

    def eval(self, hits, k: int, constant: int = 30) -> None:
        self.query, self.most = hits["query"], k
        if hits["channel"] in CHANNELS and hits["chunk"] is not None and hits["rank"] is not None:
            entry = self.sums.setdefault(hits["chunk"], [[], {}])
            entry[0].append(1.0 / (constant + hits["rank"]))
            entry[1][hits["channel"]] = min(hits["rank"], entry[1].get(hits["channel"], hits["rank"]))

    def terminate(self) -> Iterator[tuple]:
        none = float("inf")
        rows = [(sum(sorted(parts, reverse=True)), ranks.get("vector"), ranks.get("keyword"), chunk) for chunk, (parts, ranks) in self.sums.items()]
        rows.sort(key=lambda r: (-rounded(r[0], 12), none if r[1] is None else r[1], none if r[2] is None else r[2], r[3]))
        for n, (score, v, w, chunk) in enumerate(rows[: self.most], 1):
            yield self.query, chunk, rounded(score, 6), "hybrid" if v and w else "vector" if v else "keyword", v, w, n


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("rag_search", udtf(RagSearch))
