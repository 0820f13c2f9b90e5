import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello  world\n\n\tfoo", "日本語のテキスト 🙂🙂", "x" * 5000, "ab" * 3000, "don't we'll I'M 3.14159 <|endoftext|> end", "naïve café\u00a0\u3000z",
    "<|endoftext|><|endoftext|>", "\x00\x01\x7f", "e\u0301" * 40, " \n \n  ", "aaaaaaaaaaaaaaaab" * 9,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def frame(spark):
    return spark.createDataFrame([(i, t, "other") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_encode_and_decode_as_the_library(spark, library):
    got = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(frame(spark), PATH), PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].token_ids == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_query_against_the_library(spark, small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = bpe.op1_bpe(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_broken_utf8_decodes_as_the_library(spark, library):
    ids = [[1, 2, 3], [222], [172, 254, 100], [], [50256, 0], [220, 163, 241, 250, 107]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(9, None)], "k int, token_ids array<int>")
    got = {r.k: r.decoded for r in bpe.bpe_decode(df, PATH).collect()}
    assert got[9] is None
    assert [got[i] for i in range(len(ids))] == [library.decode(x, skip_special_tokens=False) for x in ids]


def check_pieces(rows, ids_of, most=1024):
    """Every id in exactly one piece, sequences gapless from 0 and either full or a power of two (padding only otherwise)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids_of[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.length == len(part) > 0
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        assert r.doc_tokens == len(ids_of[r.doc_id])
    assert set(by_doc) == set(ids_of)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids_of[k])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding


def test_packing_query(spark, small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in docs.items()}
    assert check_pieces(packing.op6_packing(spark, small).collect(), ids) == 0


def test_packing_edge_cases(spark, library):
    from pyspark.sql import functions as F

    pieces = packing.pack(frame(spark), PATH).select("*", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    assert check_pieces(pieces.collect(), ids) == 0
    assert packing.pack(frame(spark).limit(0), PATH).count() == 0
    assert bpe.bpe_encode(frame(spark).limit(0), PATH).count() == 0


def test_hilbert_keys_walk_one_cell_at_a_time():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_curve_neighbours_talk_alike(spark, small):
    """Documents of one language stand together more often than in the order of their ids."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    order = [langs[r.doc] for r in packing.tokens(docs, PATH).orderBy("curve", "doc").select("doc").collect()]
    same = lambda x: sum(a == b for a, b in zip(x, x[1:], strict=False))
    assert same(order) > 1.2 * same([langs[k] for k in sorted(langs)])


@pytest.mark.parametrize("n", [1, 40, 300])
def test_packing_is_the_plain_cut_of_the_curve(spark, small, n):
    """One range, held against a brute-force pack: all ids along the curve, cut every 1024 and the rest at powers of two."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.col("doc_id") < n)
    rows = sorted(packing.tokens(docs, PATH).withColumn("tie", F.xxhash64("doc")).collect(), key=lambda r: (r.curve, r.tie, r.doc, r.start))
    sizes = [len(r.ids) // np.dtype(packing.id_kind(PATH)).itemsize for r in rows]
    total = sum(sizes)
    cuts = list(range(0, total - total % 1024 + 1, 1024))
    cuts += [cuts[-1] + x for x in np.cumsum([1 << b for b in range(10, -1, -1) if total % 1024 >> b & 1]).tolist()]
    want, at = [], 0
    for r, size in zip(rows, sizes, strict=True):
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            x, y = max(a, at), min(b, at + size)
            if x < y:
                want.append((k, x - a, r.doc, r.start + x - at, y - x))
        at += size
    got = packing.pack(docs, PATH, target_mb=1024).select("sequence_id", "offset", "doc_id", "start", (F.octet_length("ids") / 4).cast("int").alias("n")).collect()
    number = {s: k for k, s in enumerate(sorted({r.sequence_id for r in got}))}
    assert sorted((number[r.sequence_id], r.offset, r.doc_id, r.start, r.n) for r in got) == sorted(want)
