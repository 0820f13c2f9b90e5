"""Secret scans that look through nested encodings.

A worklist holds the layers of a text: the text itself and whatever it decodes to. Each layer is scanned, and each
encoded passage in it (percent escapes, Unicode escapes, base64 runs, compressed bytes) gives a further layer with a map
back to the characters it came from, until no new layer turns up. A layer that holds the text of a layer around it is not opened
again, so an encoding that yields itself ends.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import functools
import hashlib
import itertools
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
ENCODED = re.compile(r"%[0-9A-Fa-f]{2}|\\[uUx][{0-9A-Fa-f]|&#[xX0-9]")
#: The shortest secret, token=abcdef, has 16 characters in base64.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Parts of a run between the signs that also join words.
PIECES = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: Base64 that a line length wraps; line ends may be spelled out.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n[\x20\t]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)+={0,2}")
LINE_END = re.compile(r"\r?\n[\x20\t]*|(?:\\r)?\\n")
#: What stands for bytes that are not UTF-8.
LONE = re.compile("[\udc80-\udcff]")
#: As many characters as the shortest secret.
READABLE = re.compile(r"[\x20-\x7e]{12}")
#: A layer of more bytes is scanned in windows of that size that overlap, so that memory stays bounded.
MOST_BYTES = 64 << 20
OVERLAP = 1 << 20
PIECE = 1 << 20
C_ESCAPES = {"0": 0, "a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "\\": 92, "'": 39, '"': 34}
NAMED = {"amp": 38, "lt": 60, "gt": 62, "quot": 34}


def _starts(form: str) -> re.Pattern:
    """Where gzip, zlib or bzip2 bytes may start, each byte as it is or in the form of a notation."""
    one = lambda n: f"(?:{form.format(h=f'{n:02x}', d=n)}|{re.escape(chr(n))})" if form else re.escape(chr(n))
    row = lambda *codes: "".join(map(one, codes))
    return re.compile("|".join([row(0x1F, 0x8B, 8), row(*b"BZh") + "(?:" + "|".join(map(one, b"123456789")) + ")", one(0x78) + "(?:" + "|".join(map(one, (0x01, 0x5E, 0x9C, 0xDA))) + ")"]), re.I)


#: Notations of bytes: name, a mark without which a text has none, where compressed bytes start, and the next byte.
NOTATIONS = [
    ("url", "%", _starts("%{h}"), re.compile(r"%(?P<hex>[0-9A-Fa-f]{2})|(?P<plus>\+)|(?P<char>[A-Za-z0-9_.~!*'()/-])")),
    ("unicode", "\\", _starts(r"\\x{h}|\\u00{h}"), re.compile(r"\\x(?P<x>[0-9A-Fa-f]{2})|\\u00(?P<u>[0-9A-Fa-f]{2})|\\(?P<c>[0abfnrtv\\'\"])|(?P<char>[\x20-\x5b\x5d-\x7e])")),
    ("unicode", "&#", _starts("&#0*{d};|&#x0*{h};"), re.compile(r"&#(?P<dec>[0-9]{1,7});|&#[xX](?P<hex>[0-9A-Fa-f]{1,6});|&(?P<named>amp|lt|gt|quot);|(?P<char>[\x00-\xff])")),
    ("bytes", "", _starts(""), re.compile(r"(?P<char>[\x00-\xff])")),
]

Place = Callable[[int, int], tuple[int, int]]


class Runs:
    """Where the characters of a layer come from in the layer around it: runs of characters of one width there each.

    A text with few escapes has few runs, so the map stays small whatever the text's length.
    """

    def __init__(self) -> None:
        self.at, self.source, self.width, self.n = array("q"), array("q"), array("q"), 0

    def add(self, count: int, source: int, width: int) -> None:
        if not count:
            return
        if not (self.at and self.width[-1] == width and self.source[-1] + (self.n - self.at[-1]) * width == source):
            self.at.append(self.n)
            self.source.append(source)
            self.width.append(width)
        self.n += count

    def place(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect.bisect_right(self.at, a) - 1, bisect.bisect_right(self.at, b - 1) - 1
        return self.source[i] + (a - self.at[i]) * self.width[i], self.source[j] + (b - self.at[j]) * self.width[j]


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """Secrets that stand in a text as they are, as (kind, start, end)."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def unescape(text: str, pattern: re.Pattern, decode: Callable[[str, int, Runs], str]) -> tuple[str, Runs] | None:
    """The whole text with each match of pattern decoded, and where its characters come from; None if nothing changes."""
    parts: list[str] = []
    runs, at = Runs(), 0
    for m in pattern.finditer(text):
        parts.append(text[at : m.start()])
        runs.add(m.start() - at, at, 1)
        parts.append(decode(m[0], m.start(), runs))
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    runs.add(len(text) - at, at, 1)
    return "".join(parts), runs


def percent(run: str, base: int, runs: Runs) -> str:
    """The text of percent escapes that begin at `base`; U+FFFD for each byte that is not UTF-8."""
    text = binascii.unhexlify(run.replace("%", "")).decode("utf-8", "surrogateescape")
    if text.isascii():
        runs.add(len(text), base, 3)
        return text
    at = base
    for c in text:
        width = 3 * (1 if "\udc80" <= c <= "\udcff" else len(c.encode()))
        runs.add(1, at, width)
        at += width
    return LONE.sub("\ufffd", text)


def escapes(run: str, base: int, runs: Runs) -> str:
    """The text of Unicode escapes that begin at `base`; two surrogates are one character, a lone one U+FFFD."""
    out: list[str] = []
    high: tuple[int, int] | None = None
    for m in ONE_ESCAPE.finditer(run):
        code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4] or m[6], 16)
        if high and 0xDC00 <= code <= 0xDFFF:
            out[-1] = chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00)
            runs.add(1, base + high[1], m.end() - high[1])
            high = None
            continue
        if high:
            runs.add(1, base + high[1], m.start() - high[1])
        high = (code, m.start()) if 0xD800 <= code <= 0xDBFF else None
        out.append("\ufffd" if high or code > 0x10FFFF or 0xDC00 <= code <= 0xDFFF else chr(code))
        if not high:
            runs.add(1, base + m.start(), m.end() - m.start())
    if high:
        runs.add(1, base + high[1], len(run) - high[1])
    return "".join(out)


def compressed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or (len(head) > 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0)


def members(chunks: Iterator[bytes], left: list[int]) -> Iterator[bytes]:
    """What a stream of gzip, zlib or bzip2 members holds, piece by piece, then any bytes after them as they are.

    Of a broken member the part before the break is given, and the bytes from there on. left: takes the number of bytes
    behind the last member.
    """
    rest = b""
    d = None
    for chunk in chunks:
        rest += chunk
        while rest and (d or compressed(rest)):
            if d is None:
                d = bz2.BZ2Decompressor() if rest[:3] == b"BZh" else zlib.decompressobj(47)
            packed = isinstance(d, bz2.BZ2Decompressor)
            before = None if packed else d.copy()
            try:
                got = d.decompress(rest, PIECE)
            except (zlib.error, OSError, EOFError):
                got, at = b"", 0
                while before and at < len(rest) and at < 2 * PIECE:
                    try:
                        got += before.decompress(rest[at : at + 1])
                    except zlib.error:
                        break
                    at += 1
                yield got
                left.append(len(rest))
                yield rest
                yield from chunks
                return
            if got:
                yield got
            if d.eof:
                rest, d = d.unused_data, None
            elif packed:
                rest = b""
                while not d.needs_input and not d.eof:
                    yield d.decompress(b"", PIECE)
                rest, d = (d.unused_data, None) if d.eof else (b"", d)
            else:
                rest = d.unconsumed_tail
        if rest and d is None:
            left.append(len(rest))
            yield rest
            yield from chunks
            return


def unpacked(raw: bytes) -> tuple[Iterator[bytes], list[int]]:
    """The bytes behind all wrappings that are nested around raw, piece by piece, and how many bytes stand behind the outermost."""
    chunks: Iterator[bytes] = iter([raw])
    first: list[int] = []
    left, seen = first, set()
    while True:
        head = b""
        for c in chunks:
            head += c
            if len(head) >= 1 << 16:
                break
        mark = hashlib.sha1(head[: 1 << 16]).digest()
        chunks = itertools.chain([head], chunks)
        if mark in seen or not compressed(head):
            return chunks, first
        seen.add(mark)
        chunks, left = members(chunks, left), []


def plain(raw: bytes) -> bool:
    """Whether bytes are printable text throughout."""
    try:
        return not CONTROL.search(raw.decode())
    except UnicodeDecodeError:
        return False


def readable(raw: bytes) -> Iterator[tuple[str, Place]]:
    """Texts of bytes that may hold a secret: as UTF-8, and also without zeros (as in UTF-16); each with the bytes of its characters."""
    for kept in (raw, raw.replace(b"\0", b"")) if b"\0" in raw else (raw,):
        text = kept.decode("utf-8", "surrogateescape")
        if not READABLE.search(text):
            continue

        @functools.cache
        def bytes_before(kept=kept, text=text) -> np.ndarray:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            width[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
            return np.concatenate([[0], np.cumsum(width)])

        @functools.cache
        def not_zero() -> np.ndarray:
            return np.flatnonzero(np.frombuffer(raw, np.uint8))

        def place(a: int, b: int, kept=kept, text=text, same=len(text) == len(kept), all_kept=len(kept) == len(raw), before=bytes_before) -> tuple[int, int]:
            if not same:
                a, b = (0, len(kept)) if (a, b) == (0, len(text)) else (int(before()[a]), int(before()[b]))
            if not all_kept:
                a, b = int(not_zero()[a]), int(not_zero()[b - 1]) + 1
            return a, b

        yield LONE.sub("\ufffd", text), place


def windows(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """All bytes at once if they are no more than MOST_BYTES (and True), else windows of that size that overlap."""
    held, whole = bytearray(), True
    for c in chunks:
        held += c
        while len(held) > MOST_BYTES:
            yield bytes(held[:MOST_BYTES]), False
            del held[: MOST_BYTES - OVERLAP]
            whole = False
    yield bytes(held), whole


def from_base64(run: str) -> bytes | None:
    """The bytes of a base64 run, either alphabet, with or without padding; a single character too many is left out."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unwrapped(passage: str) -> Iterator[tuple[str, Runs]]:
    """Lines of one length and a last, shorter one joined, with their places in the passage; the very first may be shorter too."""
    lines = []
    at = 0
    for m in [*LINE_END.finditer(passage), None]:
        end = m.start() if m else len(passage)
        lines.append((passage[at:end], at))
        at = m.end() if m else end
    i = 0
    while i < len(lines) - 1:
        n = len(lines[i + 1 if i == 0 and len(lines) > 2 else i][0].rstrip("="))
        j = i + 1
        while j < len(lines) - 1 and len(lines[j][0]) == n:
            j += 1
        j += len(lines[j][0].rstrip("=")) <= n
        if j - i > 1:
            runs = Runs()
            for line, place in lines[i:j]:
                runs.add(len(line), place, 1)
            yield "".join(x[0] for x in lines[i:j]), runs
        i = j


class Spelled:
    """The bytes that a layer spells from one place on in a notation, read as far as they are asked for."""

    def __init__(self, layer: str, at: int, token: re.Pattern, plain: bool) -> None:
        self.layer, self.at, self.token, self.plain, self.ended = layer, at, token, plain, False
        self.raw = bytearray()
        self.starts = array("q", [at])

    def place(self, n: int) -> int:
        """Where the n-th byte starts."""
        return self.at + n if self.plain else self.starts[n]

    def nth(self, place: int) -> int | None:
        """Which byte starts at a place; None if none of those that were read does."""
        n = place - self.at if self.plain else bisect.bisect_left(self.starts, place)
        return n if n <= len(self.raw) and self.place(n) == place else None

    def read(self, most: int) -> None:
        """Read on until there are `most` bytes, or no more."""
        if self.plain:
            piece = "" if self.ended else self.layer[self.at + len(self.raw) : self.at + most]
            try:
                self.raw += piece.encode("latin-1")
            except UnicodeEncodeError as e:
                self.raw += piece[: e.start].encode("latin-1")
            self.ended = len(self.raw) < most
            return
        at = self.starts[-1]
        while len(self.raw) < most and not self.ended:
            m = self.token.match(self.layer, at)
            code = value(m) if m else 256
            if code > 255:
                self.ended = True
                break
            self.raw.append(code)
            at = m.end()
            self.starts.append(at)


def value(m: re.Match) -> int:
    """The byte that a token of a notation stands for."""
    k = m.lastgroup
    v = m[k]
    return ord(v) if k == "char" else 32 if k == "plus" else int(v) if k == "dec" else C_ESCAPES[v] if k == "c" else NAMED[v] if k == "named" else int(v, 16)


def member_end(spelled: Spelled, at: int) -> int:
    """Where the gzip, zlib or bzip2 member that starts at byte `at` ends; 0 if there is none.

    A member has to end as its format says. One that breaks off counts up to its break if its start can hardly be chance
    (gzip, or a first block of bzip2) and what it gives holds readable text.
    """
    spelled.read(at + 10)
    head = bytes(spelled.raw[at : at + 10])
    if not compressed(head):
        return 0
    sure = head[:2] == b"\x1f\x8b" or head[4:] == b"1AY&SY"
    packed = head[:3] == b"BZh"
    if packed and not sure and head[4:] != b"\x17\x72\x45\x38\x50\x90":
        return 0
    d = bz2.BZ2Decompressor() if packed else zlib.decompressobj(47)
    read, size = False, 64
    while True:
        spelled.read(at + size)
        piece = bytes(spelled.raw[at : at + size])
        before = None if packed or not sure else d.copy()
        try:
            got = d.decompress(piece, PIECE)
            read = read or bool(READABLE.search(got.decode("latin-1")))
            while not d.eof and (not d.needs_input if packed else d.unconsumed_tail):
                got = d.decompress(b"" if packed else d.unconsumed_tail, PIECE)
                read = read or bool(READABLE.search(got.decode("latin-1")))
        except (zlib.error, OSError, EOFError):
            n = 0
            while before and n < len(piece):
                try:
                    read = bool(READABLE.search(before.decompress(piece[n : n + 1]).decode("latin-1"))) or read
                except zlib.error:
                    break
                n += 1
            return at + (n if before else len(piece)) if sure and read else 0
        if d.eof:
            return at + len(piece) - len(d.unused_data)
        at += len(piece)
        if len(piece) < size:
            return at if sure and read else 0
        size = min(2 * size, 1 << 16)


def packed_runs(layer: str) -> Iterator[tuple[str, bytes, tuple[int, int]]]:
    """Compressed members that a layer spells out: the notation's name, a member's bytes, and where its characters start and end."""
    for name, mark, start, token in NOTATIONS:
        if mark not in layer:
            continue
        at, held = 0, None
        while m := start.search(layer, at):
            at = m.start() + 1
            n = held.nth(m.start()) if held else None
            if n is None:
                held, n = Spelled(layer, m.start(), token, not mark), 0
            if end := member_end(held, n):
                at = held.place(end)
                yield name, bytes(held.raw[n:end]), (m.start(), at)


def shifted(at: int) -> Place:
    return lambda a, b: (at + a, at + b)


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """All secrets of a text as (kind, start, end, layers): spans in the text's own characters, by start and kind.

    layers names the encodings around a secret, outermost first ("" for one that stands as it is). A secret behind escapes
    is placed at the characters that spell it, one behind base64 at its groups of four, one in compressed bytes at the whole passage. A span that several
    layers give for one kind is reported once, under the fewest layers.
    """
    found: dict[tuple[str, int, int], str] = {}
    seen: set = set()
    work: list[tuple[str, Place, str, frozenset]] = [(text, lambda a, b: (a, b), "", frozenset([text]))]
    while work:
        after: list[tuple[str, Place, str, frozenset]] = []
        for layer, place, path, above in work:

            def push(inner: str, inside: Place, name: str, place=place, path=path, above=above) -> None:
                """A new layer, unless it encloses itself or the same text came from the same characters before."""
                if not inner or inner in above:
                    return
                mark = (inner, place(*inside(0, len(inner))))
                if mark not in seen:
                    seen.add(mark)
                    after.append((inner, lambda a, b: place(*inside(a, b)), f"{path}>{name}".lstrip(">"), above | {inner}))

            def open_bytes(raw: bytes | None, inside: Place, name: str, place=place, path=path, push=push) -> bool:
                """Layers of the bytes behind an encoding (inside: the layer's characters of bytes a to b); whether they are text throughout."""
                if not raw:
                    return False
                clean, packed = True, compressed(raw)
                whole_passage = inside(0, len(raw))
                for part, whole in windows(unpacked(raw)[0]):
                    for inner, bytes_of in readable(part):
                        if whole:
                            push(inner, (lambda a, b: whole_passage) if packed else (lambda a, b, bytes_of=bytes_of: inside(*bytes_of(a, b))), name)
                            continue
                        for kind, _, _, more in scan(inner):
                            found.setdefault((kind, *place(*whole_passage)), ">".join(filter(None, (path, name, more))))
                    clean &= plain(part)
                return clean

            def in_base64(run: str, inside: Place, open_bytes=open_bytes) -> bool:
                """Open a run of base64, four characters to three bytes (inside: where the run's characters are in the layer)."""
                return open_bytes(from_base64(run), lambda a, b: inside(a // 3 * 4, min(len(run), -(-b // 3) * 4)), "base64")

            def any_alignment(run: str, at: int, in_base64=in_base64) -> bool:
                """Open a run; where that gives no plain text, also without its first characters, which may be letters in front of it."""
                return in_base64(run, shifted(at)) or any([in_base64(run[k:], shifted(at + k)) for k in (1, 2, 3)])

            for kind, a, b in base_matches(layer):
                found.setdefault((kind, *place(a, b)), path)
            if ENCODED.search(layer):
                for name, pattern, decode in (("url", PERCENT, percent), ("unicode", ESCAPE, escapes)):
                    if got := unescape(layer, pattern, decode):
                        push(got[0], got[1].place, name)
            for name, raw, passage in packed_runs(layer):
                open_bytes(raw, lambda a, b, passage=passage: passage, name)
            for m in WRAPPED.finditer(layer):
                for run, runs in unwrapped(m[0]):
                    in_base64(run, lambda a, b, at=m.start(), runs=runs: shifted(at)(*runs.place(a, b)))
            for m in BASE64.finditer(layer):
                if any_alignment(m[0], m.start()):
                    continue
                for p in PIECES.finditer(m[0]):
                    if p[0] != m[0]:
                        any_alignment(p[0], m.start() + p.start())
        work = after
    return sorted(((k, a, b, path) for (k, a, b), path in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:int,end:int,layers:string>>"


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and secrets (array of kind, start, end, layers) of every whole text; code points, end exclusive.

    Null and empty texts have none. Each row is scanned by itself, so repeated rows, ties and other columns don't matter.
    A passage that stands at several places is reported at each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string())]))
        for batch in slices(batches, 1, 8_000_000):
            rows = [[dict(zip(("kind", "start", "end", "layers"), s, strict=True)) for s in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["k", "secrets"])

    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, secrets {SPANS}").withColumnRenamed("k", key)


def masked(text: str, mask: str) -> str:
    out, at = [], 0
    for _, a, b, _ in scan(text):
        if b <= at:
            continue
        out += [text[at : max(a, at)], mask] if a >= at else []
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """df with every secret of `text` (nested ones by the passage that spells them) replaced by a mask; null texts stay null.

    Overlapping secrets get one mask. Each row is masked by itself, so repeated rows, ties and other columns don't matter,
    an empty table stays empty, and a long text is one row's work, in proportion to its length and what it decodes to.
    """

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masked(t, mask) for t in column.to_pylist()], pa.string())

    return df.withColumn(text, run(F.col(text)))


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents; counts and digests derived from the operator's spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plain = F.filter("secrets", lambda s: s["layers"] == "")
    count = lambda kind: F.size(F.filter("secrets", lambda s: (s["layers"] == "") & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
