import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import embeddings, exact, simhash, substrings
from quarry.llm._components import components

rng = np.random.default_rng(5)


def reachable(nodes, links):
    """Smallest node reachable, by union-find."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))], [(3, 3), (None, 1), (5, 4), (4, 5)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == reachable({x for p in real for x in p}, real)


# --- exact


def exact_brute(rows):
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, t in rows}
    groups = defaultdict(list)
    for k, t in norm.items():
        groups[t].append(k)
    return {k: (min(groups[t]), len(groups[t]), k == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in norm.items()}


def test_exact_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.op4_exact_dedup(spark, small).collect()}
    assert got == exact_brute(docs)


def test_exact_edges(spark):
    rows = [(1, "a  b", "x"), (2, "a b", "x"), (3, None, "y"), (4, "", None), (5, " ", "z"), (6, "a\u00a0b", "x"), (7, "z" * 300_000, "q"), (8, "z" * 300_000, "q")] + [(k, "hot text", "h") for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    want = exact_brute([(k, t) for k, t, _ in rows])
    for digest in (lambda t: F.sha2(t, 256), lambda t: F.lit("same")):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_classes(df, digest=digest).collect()}
        assert got == {k: v[:3] for k, v in want.items()}
    assert exact.exact_classes(df.limit(0)).count() == 0
    assert {r.doc_id for r in exact.drop_exact_copies(df).collect()} == {k for k, v in want.items() if v[2]}
    assert exact.drop_exact_copies(df).columns == df.columns


def test_exact_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, exact.exact_classes(df).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (None, None, 1, True)], key=str)


# --- simhash


def print_brute(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fp = {k: print_brute(t, 4) for k, t in docs.items()}
    keys = sorted(fp)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (fp[a] ^ fp[b]).bit_count() <= 4]
    want = reachable(keys, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, small).collect()}
    assert got == {k: (f"{fp[k]:016x}", want[k]) for k in keys}


@pytest.mark.parametrize("tau,n,base", [(4, 3000, 400), (3, 2000, 60), (13, 600, 60)])
def test_ring_keys_lose_no_link(spark, tau, n, base):
    seeds = rng.integers(0, 1 << 63, base, dtype=np.uint64)
    rows = []
    for i in range(n):
        x = int(seeds[i % base])
        for b in rng.choice(64, rng.integers(0, tau + 2), replace=False):
            x ^= 1 << int(b)
        rows.append((i, x))
    rows = list({x: (i, x) for i, x in rows}.values())
    signed = [(i, [x - (1 << 64) if x >> 63 else x]) for i, x in rows]
    links = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if (x ^ y).bit_count() <= tau]
    found = components(simhash.near_links(spark.createDataFrame(signed, "id long, fp array<long>"), tau, cap=16))
    got = {r.node: r.component for r in found.collect()}
    want = reachable([i for i, _ in rows], links)
    assert {k: got.get(k, k) for k in want} == want


def test_near_copies(spark):
    words = [f"w{i}" for i in rng.integers(0, 900, 400)]
    base = " ".join(words)
    near = " ".join(words[:200] + ["changed"] + words[201:])
    far = " ".join(f"v{i}" for i in rng.integers(0, 900, 400))
    df = spark.createDataFrame([(1, base, 0), (2, near, 0), (3, far, 0), (4, base.upper(), 0), (5, None, 1), (6, "", 2), (None, base, 0)], "doc_id long, text string, fp int")
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5}
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def jaccard_brute(rows, size=5, least=0.8):
    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    sets = {k: shingles(t) for k, t in rows}
    keys = sorted(sets)
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return reachable(keys, [(a, b) for i, a in enumerate(keys) for b in keys[:i] if alike(sets[a], sets[b])])


def test_near_classes_are_exact(spark, small):
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.integers(5, 80))]
        for j in range(8):
            other = list(base)
            for at in rng.choice(len(base), rng.integers(0, 1 + len(base) // 15), replace=False):
                other[at] = word()
            rows.append((100 * i + j, " ".join(other + [word() for _ in range(rng.integers(0, len(base) // 5 + 1))])))
    line = " ".join(f"hot{i}" for i in range(40))
    rows += [(10_000 + i, line + " " + " ".join(word() for _ in range(rng.integers(0, 16)))) for i in range(120)]
    rows += [(20_000, "same line of words " * 200 + "one end of its own"), (20_001, "same line of words " * 200 + "and quite a different tail here")]
    # exactly 0.8 (8 of 10 shingles), and just below
    rows += [(30_000, " ".join(f"x{i}" for i in range(13))), (30_001, " ".join(f"x{i}" for i in range(12)) + " y"), (30_002, " ".join(f"x{i}" for i in range(11)) + " z q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (4_000_000, 2_000):
        got = {r.doc_id: r.component for r in simhash.near_classes(df, cap=cap).collect()}
        assert got == jaccard_brute(rows)
        assert got[20_001] == 20_001
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = jaccard_brute(docs)
    kept = simhash.drop_near_copies(spark.read.parquet(f"{small}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, c in want.items() if k == c)


def test_near_copies_by_fingerprints_first(spark, monkeypatch):
    """The pipeline's stage links by fingerprints, confirms exactly, and compares only the clusters that this leaves apart."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:299], "end"])), (3, "no other text is like this one"), (4, " ".join(f"x{i}" for i in range(13))), (5, " ".join(f"x{i}" for i in range(12)) + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = [simhash.fingerprint(simhash.shingle_hashes(t, 5)) for _, t in rows]
    assert (bits[0] ^ bits[1]).bit_count() <= 4 < (bits[3] ^ bits[4]).bit_count()
    compared, links = [], simhash.set_links

    def recorded(texts, size, similarity):
        compared.append(sorted(r.t for r in texts.select("t").collect()))
        return links(texts, size, similarity)

    monkeypatch.setattr(simhash, "set_links", recorded)
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, df, "").collect()) == [1, 3, 4]
    text = dict(rows)
    assert compared == [sorted([text[1], text[2]]), sorted([text[4], text[5]])]


def test_near_copies_without_key(spark):
    df = spark.createDataFrame([(None, "a text of its own without any key"), (1, "b c d e f"), (None, "B c d e f")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.drop_near_copies(df).collect()) == ["a text of its own without any key", "b c d e f"]


# --- embeddings


def cosine_brute(rows, threshold):
    def valid(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = {k: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for k, v, label in rows if valid(v, label)}
    label = {k: c for k, _, c in rows}
    links = [(a, b) for a in units for b in units if b < a and label[a] == label[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold]
    want = reachable([k for k, _, _ in rows], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {k: (n[k], want[k], want[k] == k) for k, _, _ in rows}


def test_embedding_query(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.op7_embedding_near_dedup(spark, small).collect()}
    assert got == cosine_brute(rows, 0.98)


def test_embedding_links(spark):
    centres = rng.standard_normal((40, 16))
    rows = []
    for i in range(700):
        v = centres[i % 40] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in v], int(i % 3)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(50)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] + [1.0] * 15, 1), (2004, rows[0][1], None), (2005, [], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit(1))
    for cap, cell_rows in ((30, 20), (4000, 20), (30, 4000)):
        got = {r.vec_id: (r.n_links, r.component, r.kept) for r in embeddings.cosine_links(df, cap=cap, cell_rows=cell_rows).collect()}
        assert got == cosine_brute(rows, 0.98)
    assert embeddings.cosine_links(df.limit(0)).count() == 0


# --- substrings


def substring_brute(rows, length=100):
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out[k] = (len(b), int(gone.sum()), len(edge) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_substring_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op2_suffix_dedup(spark, small).collect()}
    assert got == substring_brute(rows)


def test_substring_edges(spark):
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    a, b, c = word(150), word(100), word(99)
    rows = [
        (10, a + word(40) + a), (3, word(30) + a[:120]), (4, "z" * 1000), (5, "z" * 99), (6, "z" * 100), (7, "ab" * 300), (8, "ba" * 200), (9, None), (11, ""), (12, c + b), (13, word(7) + b), (14, c),
        (15, "é" * 120), (16, "x" + "é" * 120), (17, a[1:] + b[:50]), (18, a + b),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    for block, most in ((200, 200_000), (1 << 20, 200_000), (200, 2), (1 << 20, 5)):
        found = substrings.repeated_spans(df, block_bytes=block, most=most)
        got = {r.doc_id: (r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found.collect()}
        assert got == substring_brute(rows)
    assert substrings.repeated_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_spans(df, length=50)
