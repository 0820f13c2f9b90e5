"""Byte-level BPE encoding and decoding over a public vocabulary file.

Merging follows the segment-tree method: the leaves hold the rank of every adjacent pair of symbols (with the
position, so that equal ranks resolve to the left), an inner node holds the smaller of its children, and the root
is the next merge. A merge changes three leaves, so it costs three climbs of logarithmic length, until the root
says that nothing can be merged. Short pretokens are merged many at a time, one tree a row of a NumPy matrix; a
long pretoken gets a tree of its own, so a text without white space costs n log n.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import slices

#: Pretoken pattern of the byte-level vocabulary (a fixed value of the vocabulary file's pre-tokenizer).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the longest pretokens that are merged many at a time.
WIDE = 64
#: Leaves of the trees that are merged at once at most.
LEAVES = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.bits = max(4, len(pairs).bit_length() + 3)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, -1, dtype=np.int64)
        for (a, b), r in self.rank.items():
            key = a << 32 | b
            at = int(self.slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = key, r

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where they don't merge: open addressing over all pairs at once."""
        key = a.astype(np.int64) << 32 | b
        at = self.slot(key)
        held = self.keys.take(at)
        out = np.where(held == key, self.ranks.take(at), -1)
        go = np.flatnonzero((held != key) & (held >= 0))
        while len(go):
            at[go] = (at[go] + 1) & ((1 << self.bits) - 1)
            held = self.keys.take(at[go])
            hit = held == key[go]
            out[go[hit]] = self.ranks.take(at[go[hit]])
            go = go[~hit & (held >= 0)]
        return out


def merge_one(word: bytes, vocab: Vocabulary) -> list[int]:
    """One pretoken of any length by a tree of its own."""
    ids = [int(vocab.of_byte[b]) for b in word]
    n = len(ids)
    size = 1 << max(1, (n - 1).bit_length())
    none = 1 << 62
    tree = [none] * (2 * size)
    rank = vocab.rank.get
    for i in range(n - 1):
        r = rank((ids[i], ids[i + 1]))
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    def leaf(i: int, j: int) -> None:
        r = rank((ids[i], ids[j])) if i >= 0 and j < n else None
        if i >= 0:
            put(i, none if r is None else r << 32 | i)

    while (top := tree[1]) != none:
        i = top & 0xFFFFFFFF
        j = after[i]
        ids[i] = int(vocab.merged[top >> 32])
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        leaf(i, after[i])
        leaf(before[i], i)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def merge_many(words: list[bytes], width: int, vocab: Vocabulary) -> list[bytes]:
    """Pretokens of 2 to `width` (a power of two, 64 at most) bytes, one tree a row. Returns each one's ids as packed integers.

    A leaf holds rank * 64 + position. All arrays are flat: row r of the trees starts at 2 * width * r.
    """
    n = len(words)
    length = np.fromiter(map(len, words), dtype=np.int64, count=n)
    padded = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(n, width)
    ids = vocab.of_byte[padded]
    alive = np.arange(width)[None, :] < length[:, None]
    none = np.int32(np.iinfo(np.int32).max)
    tree = np.full((n, 2 * width), none, dtype=np.int32)
    r = vocab.ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    tree[:, width : 2 * width - 1] = np.where((r >= 0) & alive[:, 1:], r * WIDE + np.arange(width - 1), none)
    step = width
    while step > 1:
        np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2], out=tree[:, step // 2 : step])
        step //= 2
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1)).ravel()
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1)).ravel()
    root, tree, ids, living = np.arange(n) * 2 * width + 1, tree.ravel(), ids.ravel(), alive.ravel()

    def put(top: np.ndarray, place: np.ndarray, value: np.ndarray | np.int32) -> None:
        """Set leaves of the trees with these roots, and climb."""
        base, k = top - 1, place + width
        tree[base + k] = value
        while k[0] > 1:
            at = base + k
            least = np.minimum(tree.take(at), tree.take(at ^ 1))
            k = k >> 1
            tree[base + k] = least

    def leaf(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        r = vocab.ranks_of(a, b)
        return np.where(r >= 0, r * WIDE + place, none).astype(np.int32)

    top = root[tree[root] < none]
    while len(top):
        least = tree.take(top)
        i = (least & (WIDE - 1)).astype(np.int64)
        new = vocab.merged.take(least // WIDE)
        row = top // (2 * width)
        at = row * width
        j = after.take(at + i)
        nxt = after.take(at + j)
        ids[at + i] = new
        living[at + j] = False
        after[at + i] = nxt
        put(top, j, none)
        value = np.full(len(top), none)
        ok = np.flatnonzero(nxt < length.take(row))
        before[(at + nxt)[ok]] = i[ok]
        value[ok] = leaf(new[ok], ids.take((at + nxt)[ok]), i[ok])
        put(top, i, value)
        prev = before.take(at + i)
        if len(ok := np.flatnonzero(prev >= 0)):
            left = prev[ok].astype(np.int64)
            put(top[ok], left, leaf(ids.take(at[ok] + left), new[ok], left))
        top = top[tree.take(top) < none]
    counts = alive.sum(axis=1)
    flat = ids[living].astype(vocab.dtype).tobytes()
    ends = np.cumsum(counts) * vocab.dtype.itemsize
    return [flat[a:b] for a, b in zip((ends - counts * vocab.dtype.itemsize).tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Encodes and decodes texts. Pretokens that were merged are kept up to about `most` bytes, so memory is bounded."""

    def __init__(self, path: str, most: int = 48_000_000):
        self.vocab, self.most, self.held = Vocabulary(path), most, 0
        self.find = regex.compile(PRETOKENS).findall
        added = sorted(self.vocab.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.fixed = {t: np.array([i], dtype=self.vocab.dtype).tobytes() for t, i in self.vocab.added.items()}
        self.kept: dict[str, bytes] = dict(self.fixed)

    def split(self, text: str) -> list[str]:
        """Pretokens of a text; an added token's string is one of its own."""
        if self.special is None or not self.special.search(text):
            return self.find(text)
        return [w for k, part in enumerate(self.special.split(text)) for w in ([part] if k % 2 else self.find(part))]

    def learn(self, words: set[str]) -> None:
        if self.held > self.most:
            self.kept, self.held = dict(self.fixed), 0
        new = [w for w in words if w not in self.kept]
        # a pretoken's string, its ids and their place in the dictionary
        self.held += 200 * len(new) + 3 * sum(map(len, new))
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            b = w.encode("utf-8", "replace")
            by_width.setdefault(1 << (len(b) - 1).bit_length() if len(b) > 1 else 1, []).append((w, b))
        for width, group in by_width.items():
            if width == 1:
                packed = [self.vocab.of_byte[b[0]].astype(self.vocab.dtype).tobytes() for _, b in group]
            elif width <= WIDE and len(self.vocab.merged) * WIDE < 1 << 31:
                step = LEAVES // width
                packed = [ids for a in range(0, len(group), step) for ids in merge_many([b for _, b in group[a : a + step]], width, self.vocab)]
            else:
                packed = [np.array(merge_one(b, self.vocab), dtype=self.vocab.dtype).tobytes() for _, b in group]
            self.kept.update(zip((w for w, _ in group), packed, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        kept = self.kept.__getitem__
        return [np.frombuffer(b"".join(map(kept, words)), dtype=self.vocab.dtype) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        return text_of(ids, self.vocab.bytes_of)


def text_of(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    return b"".join(map(bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: all that decoding needs of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    known = {i: bytes(of_letter[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    known.update({t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])})
    return [known.get(i, b"") for i in range(1 + max(known))]


def _encoded(df: DataFrame, path: str, text: str, key: str, decoded: bool) -> DataFrame:
    """k, ids and, if asked for, t (their text again): slice by slice in one pass, so that one worker a core holds one vocabulary."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, 1, 1_000_000):
            ids = enc.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, enc.vocab.dtype)]).astype(np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, flat)]
            if decoded:
                columns.append(pa.array([enc.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["k", "ids", "t"][: len(columns)])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(encode, f"k {kind}, ids array<int>" + ", t string" * decoded)


def bpe_encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and token_ids (array<int>) of every whole text, as the vocabulary file's tokenizer gives without special tokens added.

    A null text counts as empty and an empty text has no ids; strings of added tokens in a text become their ids. Repeated
    rows and keys stay as they are; other columns are left out, so names cannot clash. An empty table gives an empty table.
    """
    return _encoded(df, path, text, key, False).select(F.col("k").alias(key), F.col("ids").alias("token_ids"))


def bpe_decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with `out`: the text of its ids. Bytes that are not UTF-8 become U+FFFD; null ids give a null text.

    `out` replaces a column of that name. Unknown ids raise an IndexError in the task.
    """

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        of = token_bytes(path)
        return pa.array([text_of(one.values.to_numpy(zero_copy_only=False), of) if one.is_valid else None for one in column], pa.string())

    return df.withColumn(out, decode(F.col(ids)))


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What bpe_encode and then bpe_decode give (`key`, token_ids, decoded), by one pass of one worker over each slice of texts."""
    return _encoded(df, path, text, key, True).select(F.col("k").alias(key), F.col("ids").alias("token_ids"), F.col("t").alias("decoded"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Round trip of all documents; digests derived from the operator's ids and texts."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
