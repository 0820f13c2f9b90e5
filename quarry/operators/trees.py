"""Trees as intervals: nodes numbered by list ranking, so that everything below a node is a range, joined by equality.

Pointer doubling takes a number of joins that grows with the logarithm of a tree's depth or size, so no depth is too deep;
cycles are found and raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources import files

#: Ranges are met in blocks of 1, 16, 256 and 4096 numbers.
BITS = (0, 4, 8, 12)


def doubled(rows: DataFrame, at: Sequence[str], to: Sequence[str], merged: Callable[[str], Column]) -> DataFrame:
    """Rows that point to other rows, followed to the end of their chains.

    A row stands at `at` (unique) and points to the row at `to` (the last of these columns null: a chain's end). merged gives
    the value of each other column `c` of two parts of a chain, the row's own `c` and the pointed row's `_c`. Every round
    joins each open row with the one that it points to, which doubles the way behind it, and is written to the shared folder.
    A row that points to none counts as an error, as do cycles.
    """
    values = [c for c in rows.columns if c not in (*at, *to)]
    path, n = files.shared_folder(rows.sparkSession, "chains"), 0

    def stored(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/{n}")
        return rows.sparkSession.read.schema(df.schema).parquet(f"{path}/{n}")

    rows = stored(rows)
    open_, most = rows.where(F.col(to[-1]).isNotNull()), rows.count().bit_length() + 1
    while not open_.isEmpty():
        n += 1
        if n > most:
            raise ValueError("a cycle, or a row that points to none")
        next_ = rows.select(*[F.col(a).alias(t) for a, t in zip(at, to, strict=True)], *[F.col(t).alias(f"_{t}") for t in to], *[F.col(v).alias(f"_{v}") for v in values])
        step = open_.join(next_, list(to), "left")
        # a row that points to none keeps its pointer, which the bound on the rounds then tells
        met = F.col(f"_{values[0]}").isNotNull()
        step = step.select(*at, *[F.when(met, F.col(f"_{t}")).otherwise(F.col(t)).alias(t) for t in to], *[F.when(met, merged(v)).otherwise(F.col(v)).alias(v) for v in values])
        rows = stored(rows.where(F.col(to[-1]).isNull()).select(step.columns).unionByName(step))
        open_ = rows.where(F.col(to[-1]).isNotNull())
    return rows


def linked(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """tree, node and parent, which is null where no such node exists in the tree: the roots."""
    known = nodes.select(tree, F.col(node).alias(parent), F.lit(True).alias("_known"))
    rows = nodes.select(tree, node, F.col(parent).cast(nodes.schema[node].dataType).alias(parent))
    return rows.join(known, [tree, parent], "left").select(tree, node, F.when(F.col("_known"), F.col(parent)).alias(parent))


def numbered(nodes: DataFrame, tree: str = "doc", node: str = "node_no", parent: str = "parent_no") -> DataFrame:
    """tree, node, enter, leave, level of the nodes of trees, siblings in the order of `node`.

    enter counts the nodes from this one on in pre-order to the tree's end, leave those behind everything below it: below r
    (itself included) are the nodes whose enter is above r's leave and not above r's enter. level is 0 at roots; a node whose
    parent is missing is one. The tour down and up around each tree is a chain with two places a node, ranked by
    `doubled`. (tree, node) must be unique; rows with null in either have no place.
    """
    rows = linked(nodes.where(F.col(tree).isNotNull() & F.col(node).isNotNull()), tree, node, parent)
    beside = rows.withColumn("beside", F.lead(node).over(Window.partitionBy(tree, parent).orderBy(node)))
    first = rows.where(F.col(parent).isNotNull()).groupBy(tree, F.col(parent).alias(node)).agg(F.min(node).alias("child"))
    full = beside.join(first, [tree, node], "left")
    place = lambda up, to, to_up: F.struct(F.lit(up).alias("up"), to.alias("to"), to_up.alias("to_up"), F.lit(0 if up else 1).cast("long").alias("nodes"), F.lit(-1 if up else 1).cast("long").alias("climb"))
    down = place(False, F.coalesce("child", node), F.col("child").isNull())
    up = place(True, F.coalesce("beside", parent), F.when(F.col("beside").isNotNull(), False).when(F.col(parent).isNotNull(), True))
    tour = full.select(tree, node, F.explode(F.array(down, up)).alias("p")).select(F.col(tree).alias("tree"), F.col(node).alias("at"), "p.up", F.col(tree).alias("to_tree"), "p.to", "p.to_up", "p.nodes", "p.climb")
    ranked = doubled(tour, ["tree", "at", "up"], ["to_tree", "to", "to_up"], lambda c: F.col(c) + F.col(f"_{c}"))
    of = lambda up, c: F.max(F.when(F.col("up") == up, F.col(c)))
    return ranked.groupBy(F.col("tree").alias(tree), F.col("at").alias(node)).agg(of(False, "nodes").alias("enter"), of(True, "nodes").alias("leave"), (-of(False, "climb")).cast("int").alias("level"))


def blocks_of(number: Column) -> Column:
    """The blocks (bits, block) that hold a number, one for each size."""
    return F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftright(number, b).alias("block")) for b in BITS])


def cover(low: Column, high: Column) -> Column:
    """The blocks that together hold exactly the numbers from low (0 or more) to high, the largest that fit: for a range of n at most n / 4096 + 90."""

    def inside(bits: int) -> tuple[Column, Column]:
        return F.shiftright(low + ((1 << bits) - 1), bits), F.shiftright(high + 1, bits) - 1

    def run(a: Column, z: Column, bits: int) -> Column:
        blocks = F.when(a <= z, F.sequence(a, z)).otherwise(F.array().cast("array<long>"))
        return F.transform(blocks, lambda x: F.struct(F.lit(bits).alias("bits"), x.alias("block")))

    parts = [run(*inside(BITS[-1]), BITS[-1])]
    for bits, larger in zip(BITS, BITS[1:], strict=False):
        (a, z), (la, lz) = inside(bits), inside(larger)
        step, some = larger - bits, la <= lz
        parts += [run(a, F.when(some, F.shiftleft(la, step) - 1).otherwise(z), bits), run(F.when(some, F.shiftleft(lz + 1, step)).otherwise(F.lit(0).cast("long")), F.when(some, z).otherwise(F.lit(-1).cast("long")), bits)]
    return F.concat(*parts)


def below(labelled: DataFrame, roots: DataFrame, tree: str = "doc", node: str = "node_no", root: str = "root") -> DataFrame:
    """tree, root, node, distance: the roots and everything below them. labelled: tree, node, enter, leave, level; roots: tree, root.

    A range join by equality: a root's range falls into blocks, a node lies in one block of each of four sizes, so keys hold 4096
    nodes at most, and a large tree or root is spread over its blocks. Roots that are no nodes give nothing.
    """
    of_root = labelled.select(tree, F.col(node).alias(root), (F.col("leave") + 1).cast("long").alias("low"), F.col("enter").cast("long").alias("high"), F.col("level").alias("_level"))
    ranges = roots.select(tree, root).join(of_root, [tree, root]).select(tree, root, "_level", F.explode(cover(F.col("low"), F.col("high"))).alias("b"))
    places = labelled.select(tree, node, "level", F.explode(blocks_of(F.col("enter").cast("long"))).alias("b"))
    met = ranges.select(tree, root, "_level", "b.*").join(places.select(tree, node, "level", "b.*"), [tree, "bits", "block"])
    return met.select(tree, root, node, (F.col("level") - F.col("_level")).cast("int").alias("distance"))


def paths(nodes: DataFrame, own: Column, tree: str, node: str, parent: str) -> DataFrame:
    """tree, node, depth (0 at roots) and path: `own` of the nodes from the root down, joined by spaces. Nodes whose parent is missing are roots."""
    rows = linked(nodes, tree, node, parent).join(nodes.select(tree, node, F.coalesce(own, F.lit("")).alias("path")), [tree, node])
    chain = rows.select(F.col(tree).alias("tree"), F.col(node).alias("at"), F.col(tree).alias("to_tree"), F.col(parent).alias("to"), F.col(parent).isNotNull().cast("int").alias("depth"), "path")
    done = doubled(chain, ["tree", "at"], ["to_tree", "to"], lambda c: F.concat_ws(" ", "_path", "path") if c == "path" else F.col("depth") + F.col("_depth"))
    return done.select(F.col("tree").alias(tree), F.col("at").alias(node), "depth", "path")
