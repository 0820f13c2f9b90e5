"""Chains of stages, dispatch, and fuzzy lookups against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import fuzzy
from quarry.sources import files
from quarry.streaming import stages as S


def chain():
    return [
        S.Stage("read", {"n": F.col("raw").try_cast("int")}, F.when(F.col("n").isNull(), "not a number")),
        S.Stage("half", {"n": F.floor(F.col("n") / 2).cast("int"), "raw": F.concat("raw", F.lit("/2"))}, F.when(F.col("n") < 0, "below zero"), F.when(F.col("id") % 5 == 0, S.SKIP).when(F.col("id") % 7 == 0, S.TERMINATE)),
        S.Stage("mark", {"mark": F.concat(F.lit("m"), F.col("n").cast("string"))}),
    ]


ROWS = [(1, "8"), (2, "x"), (3, "-4"), (5, "-10"), (7, "6"), (8, None), (9, "8"), (9, "8")]
WANT = {
    (1, "8/2", 4, "m4", "done", None, None), (2, "x", None, None, "dead", "read", "not a number"), (3, "-4", -4, None, "dead", "half", "below zero"), (5, "-10", -10, "m-10", "done", None, None),
    (7, "6", 6, None, "terminated", "half", None), (8, None, None, None, "dead", "read", "not a number"), (9, "8/2", 4, "m4", "done", None, None),
}
COLUMNS = ["id", "raw", "n", "mark", "state", "stage", "error"]


def test_rows_fail_by_themselves(spark):
    df = spark.createDataFrame(ROWS, "id long, raw string")
    rows = S.run_chain(df, chain()).select(*COLUMNS).collect()
    assert {tuple(r) for r in rows} == WANT and len(rows) == len(ROWS)
    assert S.run_chain(df.limit(0), chain()).count() == 0
    # mended rows go on from the stage that failed
    dead = S.run_chain(df, chain()).where("state = 'dead'").withColumn("raw", F.lit("20")).withColumn("n", F.lit(20))
    again = S.run_chain(dead, chain()).select("id", "n", "state").collect()
    assert {tuple(r) for r in again} == {(2, 10, "done"), (3, 10, "done"), (8, 10, "done")}


def test_repeated_batches_change_nothing(spark, tmp_path):
    write = S.write_batches(chain(), f"{tmp_path}/good", f"{tmp_path}/dead")
    df = spark.createDataFrame(ROWS, "id long, raw string")
    for number, part in ((0, df.where("id < 5")), (1, df.where("id >= 5")), (0, df.where("id < 5")), (1, df.where("id >= 5"))):
        write(part, number)
    both = spark.read.parquet(f"{tmp_path}/good").unionByName(spark.read.parquet(f"{tmp_path}/dead"))
    rows = both.select(*COLUMNS).collect()
    assert len(rows) == len(ROWS) and {tuple(r) for r in rows} == WANT


def test_dispatch(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "zz"), (5, "a")], "id long, mode string")
    out = S.dispatch(df, {"a": lambda d: d.select("id", F.lit("A").alias("r")), "b": lambda d: d.select("id", F.lit("B").alias("r"))}, "b")
    assert sorted(map(tuple, out.collect())) == [(1, "A", "a"), (2, "B", "b"), (3, "B", "b"), (4, "B", "b"), (5, "A", "a")]
    with pytest.raises(ValueError):
        S.dispatch(df, {}, "b")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_fuzzy_is_brute_force(spark, most):
    draw = random.Random(most)
    word = lambda: "".join(draw.choices("abÉ", k=draw.randrange(0, 8)))
    queries, names = [word() for _ in range(60)] + ["  Abab ", None], [word() for _ in range(60)] + [None, "", "x" * 40]
    got = fuzzy.fuzzy_matches(spark.createDataFrame([(q,) for q in queries], "text string"), spark.createDataFrame([(n,) for n in names], "name string"), most).collect()
    norm = lambda xs: {(x or "").strip().lower() for x in xs}
    want = {(q, n, edits(q, n)) for q in norm(queries) for n in norm(names) if edits(q, n) <= most}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_contained_is_brute_force(spark):
    draw = random.Random(3)
    word = lambda k: "".join(draw.choices("abc ", k=k))
    queries, names = [word(draw.randrange(1, 6)) for _ in range(80)] + [None, "zzz"], [word(draw.randrange(0, 15)) for _ in range(80)] + [None]
    got = fuzzy.contained_matches(spark.createDataFrame([(q,) for q in queries], "text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    norm = lambda xs: {x for x in ((x or "").strip().lower() for x in xs) if len(x) >= 3}
    want = {(q, n, n.startswith(q)) for q in norm(queries) for n in norm(names) if q in n}
    assert len(got) == len(want) > 5 and {tuple(r) for r in got} == want


def test_sitemaps_of_any_depth(spark):
    index = lambda *urls: "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in urls)
    maps = [(f"m{i}", index(f"m{i + 1}", "m0")) for i in range(8)] + [("m8", "<urlset><loc> p1 </loc><loc>p2</loc>"), ("other", "<urlset><loc>p3</loc>")]
    df = spark.createDataFrame(maps, "url string, xml string")
    assert {r.url for r in files.sitemap_urls(df, df.where("url = 'm0'").select("url")).collect()} == {"p1", "p2"}
    assert files.sitemap_urls(df, df.limit(0).select("url")).count() == 0


def test_events_meet_any_number_of_patterns_by_equality(spark):
    from quarry.streaming.state import route_events

    names = ["a", "a.b", "a.b.c", "b", "*", "a.*", ".x", "", None]
    patterns = ["*", "a", "a.*", "a.b.*", "b.*", ".*", "", None] + [f"n{i}.*" for i in range(1100)]
    events = spark.createDataFrame(list(enumerate(names)), "event_id int, event_type string")
    subs = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)] + [(5000, "a.*")], "subscriber int, pattern string")

    def fits(n, p):
        return n is not None and p is not None and (p in ("*", n) or p.endswith(".*") and n.startswith(p[:-1]))

    want = sorted((e, s) for e, n in enumerate(names) for s, p in [*enumerate(patterns), (5000, "a.*")] if fits(n, p))
    assert sorted((r.event_id, r.subscriber) for r in route_events(events, subs).collect()) == want
