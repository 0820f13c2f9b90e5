"""Divergence of sources, periodic runs and contaminated words, held against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quarry.llm import decontaminate, divergence, periodic

# --- divergence


def divergence_brute(rows, least, top):
    terms = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for t, a, b in rows]
    out = []
    for lang in {x[0] for x in terms}:
        docs = Counter(w for la, _, ws in terms if la == lang for w in set(ws))
        kept = [w for w, n in docs.items() if n >= least]
        counts = defaultdict(Counter)
        for la, so, ws in terms:
            if la == lang:
                counts[so].update(w for w in ws if w in set(kept))
        total = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q, p = share(total), {s: share(c) for s, c in counts.items()}
        order = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
        for s in p:
            out += [(lang, s, "pair", i, v, r) for r, (i, v) in order((t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in p if t != s)]
            out += [(lang, s, "term", i, v, r) for r, (i, v) in order((w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]) if r <= top]
    return sorted(out)


def test_divergence_of_sources(spark):
    draw = random.Random(4)
    words = ["alpha", "Beta", "ÉTÉ", "été", "x1y", "it's", "日本", "\x7f", "gamma-delta", "𝒳"]
    rows = [(" ".join(draw.choices(words, k=draw.randrange(12))), draw.choice(["en", "fr", None]), draw.choice(["a", "b", "ç", None, "B"])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("12 34", "xx", None), ("rare", "xx", "third"), ("alpha " * 50_000, "en", "a"), *[("beta beta", "en", "hot")] * 200]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS n", "'x' AS term", "2 AS rank")
    for least, top in ((5, 50), (40, 3)):
        got = sorted(map(tuple, divergence.source_divergence(df, min_docs=least, top=top).collect()))
        assert got == divergence_brute(rows, least, top)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_divergence_query_is_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(divergence.OP11_SQL)
    names = [d[0] for d in want.description]
    df = divergence.op11_divergence(spark, small)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


# --- runs


def runs_brute(words, times=4, least=6):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and not any(all(words[x] == words[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_brute(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_words(seed):
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(30):
        words = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60)).tolist()
        unit = rng.integers(0, 4, rng.integers(1, 9)).tolist()
        docs.append((words[: len(words) // 2] + unit * int(rng.integers(0, 9)) + unit[: int(rng.integers(0, len(unit) + 1))] + words[len(words) // 2 :])[: int(rng.integers(1, 90))])
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    at = np.cumsum([0, *map(len, docs)])
    got = [(int(a), int(n), int(q)) for a, n, q in periodic.runs_of(np.array(sum(docs, []), np.int64), doc)]
    assert got == [(a + int(at[i]), n, q) for i, d in enumerate(docs) for a, n, q in runs_brute(d)]


def test_mask_keeps_all_words_of_runs():
    assert periodic.gram_size(4, 6) == 5
    for times, least in ((4, 6), (4, 2), (5, 6), (6, 40), (4, 11)):
        for q in range(1, 12):
            for more in range(q + 1):
                words = np.array([*range(100, 107), *(list(range(q)) * (max(times, least // q + 1) + 2))[: max(least, times * q) + more], *range(200, 207)])
                doc = np.zeros(len(words), np.int64)
                assert [tuple(r) for r in periodic.runs_of(words, doc, times, least).tolist()] == [(7, max(least, times * q) + more, q)]


def test_long_repeats_stay_near_linear():
    words = np.zeros(300_000, np.int64)
    assert periodic.runs_of(words, words).tolist() == [[0, 300_000, 1]]
    words = np.tile(np.arange(1000), 300)
    assert periodic.runs_of(words, words * 0).tolist() == [[0, 300_000, 1000]]


def test_runs_query_is_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    looped = 0
    rows = periodic.op12_periodic_runs(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = words_of(docs[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            looped += 1
        if n > 3000:
            continue
        runs = runs_brute(words)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r["length"], r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r.collapsed_sha256 == sha(collapsed_brute(words, runs))
    assert looped > 5


def test_runs_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (None, "a b " * 5), (5, "a b " * 5), (5, "a b " * 6), (7, "x " * 200_000), (8, "é\x00 " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "'z' AS runs", "3 AS t")
    got = periodic.periodic_runs(df).collect()
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=str) == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 10, [(0, 10, 2)], "a b"), (5, 10, [(0, 10, 2)], "a b"), (5, 6, [(0, 6, 1)], "a b"), (7, 200_000, [(0, 200_000, 1)], "x"), (8, 6, [(0, 6, 1)], "é\x00")], key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, times=3)
    null = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert periodic.looped(null).count() == 2


# --- decontamination


def found_brute(docs, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for j in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[j : j + size])].add("" if i is None else str(i))
    out = []
    for k, t in docs:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[x]
        out.append((k, len(w), sorted(hit), sorted(ids)))
    return sorted(out, key=str)


def found(df, benchmark, **more):
    rows = decontaminate.contaminated_words(df, benchmark, **more).collect()
    for r in rows:
        assert all(x.start + x.length < y.start for x, y in zip(r.spans, r.spans[1:], strict=False))
    return sorted([(r.doc_id, r.n_words, [i for s in r.spans for i in range(s.start, s.start + s.length)], list(r["items"])) for r in rows], key=str)


@pytest.mark.parametrize(("size", "most"), [(10, 4_000_000), (3, 4_000_000), (3, 2500), (10, 3000), (1, 4_000_000)])
def test_contaminated_words(spark, size, most):
    draw = random.Random(size)
    words = ["alpha", "Beta", "ÉTÉ", "x1", "日本", "it", "a", "of", "zz" * 40]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choices(words, k=n))
    items = [(k % 40 if k % 7 else None, text(draw.randrange(25))) for k in range(50)] + [(90, "one"), (91, "of a"), (92, None), (93, ""), (94, "?!"), (95, text(400))]
    docs = [(k, text(draw.randrange(60))) for k in range(60)]
    for k in range(100, 160):
        piece = re.findall(r"\S+", draw.choice(items)[1] or "x")
        docs.append((k, f"{text(4)} {' '.join(piece[draw.randrange(len(piece) or 1) :] if piece else [])}-{text(5)}" * draw.randrange(1, 3)))
    docs += [(1, None), (None, ""), (2, "..."), (3, "One"), (3, "One"), (4, "one" * 9), (5, "alpha " * 40_000), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS k", "'q' AS items", "2 AS row").repartition(5)
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS t")
    assert found(df, benchmark, size=size, most=most) == found_brute(docs, items, size)


def test_contamination_edges(spark, small):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert found(df, none) == [(1, 2, [], []), (2, 0, [], [])]
    assert decontaminate.contaminated_words(df.limit(0), none).count() == 0
    # windows of neighbouring documents never join
    both = spark.createDataFrame([(1, "x y"), (2, "z"), (3, ""), (4, "x y z")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("i", "y z"), ("j", "x y"), ("k", "z")], "item_id string, text string")
    assert found(both, items) == [(1, 2, [0, 1], ["j"]), (2, 1, [0], ["k"]), (3, 0, [], []), (4, 3, [0, 1, 2], ["i", "j", "k"])]


def test_decontamination_query_is_its_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(decontaminate.OP13_SQL)
    names = [d[0] for d in want.description]
    rows = sorted(map(tuple, decontaminate.op13_decontamination(spark, small).select(*names).collect()))
    assert rows == sorted(want.fetchall()) and any(r[-1] for r in rows)
