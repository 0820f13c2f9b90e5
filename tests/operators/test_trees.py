"""Interval-labelled trees against walks in Python."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import analytics as A
from quarry.operators import structure as D
from quarry.operators import trees


def forest(seed: int, n: int, deep: bool) -> list[tuple[int, int, int | None]]:
    """Trees 0 to 2 of n nodes each: parents before or, in a deep one, just before; some parents don't exist."""
    r = random.Random(seed)
    rows = []
    for tree in range(3):
        names = r.sample(range(1, 10 * n), n)
        for k, name in enumerate(names):
            parent = None if k == 0 or r.random() < 0.03 else -5 if r.random() < 0.03 else names[k - 1] if deep else names[r.randrange(k)]
            rows.append((tree, name, parent))
    return rows


def below(rows: list[tuple], root: tuple) -> set[tuple]:
    out, level = {(root[1], 0)}, [(root[1], 0)]
    while level:
        level = [(c, d + 1) for at, d in level for t, c, p in rows if t == root[0] and p == at]
        out |= set(level)
    return out


@pytest.mark.parametrize("deep", [False, True])
def test_numbers_and_ranges(spark, deep):
    rows = forest(4, 60, deep)
    nodes = spark.createDataFrame(rows, "doc int, node_no long, parent_no long")
    labels = {(r.doc, r.node_no): r for r in trees.numbered(nodes).collect()}
    assert len(labels) == len(rows)
    for tree in range(3):
        own = [r for k, r in labels.items() if k[0] == tree]
        assert sorted(r.enter for r in own) == list(range(1, len(own) + 1))
    roots = [(t, n) for t, n, _ in rows] + [(0, -1)]
    got: dict[tuple, set] = {}
    for r in D.subtree(nodes, spark.createDataFrame(roots, "doc int, root long")).collect():
        assert (r.node_no, r.distance) not in got.setdefault((r.doc, r.root), set())
        got[r.doc, r.root].add((r.node_no, r.distance))
    assert got == {k: below(rows, k) for k in roots[:-1]}


def test_blocks_cover_ranges_exactly(spark):
    r = random.Random(2)
    ranges = [(a, a + r.choice([0, 1, 15, 16, 300, 9000, 70_000])) for a in (r.randrange(100_000) for _ in range(60))] + [(0, 0), (0, 65_535), (5, 4)]
    df = spark.createDataFrame(ranges, "low long, high long").withColumn("b", trees.cover(F.col("low"), F.col("high")))
    for row in df.collect():
        spans = sorted((b.block << b.bits, (b.block + 1 << b.bits) - 1) for b in row.b)
        assert [x for a, z in spans for x in (a, z + 1)] == ([] if row.low > row.high else [row.low] + [x for a, _ in spans[1:] for x in (a, a)] + [row.high + 1])
        assert len(spans) <= (row.high - row.low + 1) / 4096 + 91


def test_the_tree_of_a_text_has_the_same_intervals(spark):
    text = "# A\n1. x\n2. y\n   - z\n## B\nbody\n# C\n## 1 D\n### 1.1 E\n- q"
    nodes = D.build_tree(D.classify_lines(D.logical_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))))
    want = {(r.doc, r.node_no): (r.enter, r.leave, r.level) for r in trees.numbered(nodes.drop("enter", "leave")).collect()}
    assert {(r.doc, r.node_no): (r.enter, r.leave, r.depth) for r in nodes.collect()} == want
    shuffled = D.classify_lines(D.logical_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))).repartition(5)
    assert sorted(map(str, D.build_tree(shuffled).collect())) == sorted(map(str, nodes.where("doc = 1").collect()))


def test_deep_spans_cycles_and_empty_tables(spark):
    schema = "trace int, span int, parent int, start timestamp"
    spans = spark.range(300).select(F.lit(1).alias("trace"), F.col("id").cast("int").alias("span"), (F.col("id") - 1).cast("int").alias("parent"), F.lit("2024-01-01").cast("timestamp").alias("start"))
    rows = {r.span: r for r in A.waterfall(spans).collect()}
    assert len(rows) == 300 and all(rows[k].depth == k and rows[k].path.count(" ") == k for k in rows)
    assert rows[2].path.replace("20240101000000000000/", "") == "0 1 2"
    assert A.waterfall(spark.createDataFrame([], schema)).count() == 0
    empty = spark.createDataFrame([], "doc int, node_no int, parent_no int")
    assert D.subtree(empty, spark.createDataFrame([(1, 1)], "doc int, root int")).count() == 0
    cycle = spark.createDataFrame([(1, 1, 2, None), (1, 2, 1, None), (1, 3, None, None)], schema)
    with pytest.raises(ValueError):
        A.waterfall(cycle).count()
    with pytest.raises(ValueError):
        D.subtree(cycle.select(F.col("trace").alias("doc"), F.col("span").alias("node_no"), F.col("parent").alias("parent_no")), spark.createDataFrame([(1, 1)], "doc int, root int")).count()
