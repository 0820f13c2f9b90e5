import base64
import bz2
import gzip
import hashlib
import re
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import secrets, urls, warc

# --- secrets


def base_brute(text):
    text = text or ""
    found = []
    for m in re.finditer(r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)), 1):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found)


def test_secret_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in secrets.op5_secrets(spark, small).collect():
        want = base_brute(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


SECRET = "password = hunter2hunter2"


@pytest.mark.parametrize(
    "hidden",
    [
        base64.b64encode(SECRET.encode()).decode(),
        base64.urlsafe_b64encode(SECRET.encode()).decode().rstrip("="),
        "".join(f"%{b:02X}" for b in SECRET.encode()),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "".join(f"&#{ord(c)};" for c in SECRET),
        "".join(f"\\x{ord(c):02x}" for c in SECRET),
        base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(zlib.compress(bz2.compress(SECRET.encode()))).decode(),
        base64.b64encode(base64.b64encode("".join(f"%{b:02X}" for b in SECRET.encode()).encode())).decode(),
        "".join(f"%{b:02X}" for b in base64.b64encode(SECRET.encode())),
        "".join(f"%25{b:02X}" for b in SECRET.encode()),
    ],
)
def test_nested_secrets(hidden):
    text = f"bonjour é {hidden} and more words"
    found = [(k, text[a:b], path) for k, a, b, path in secrets.scan(text) if path]
    assert any(k == "assign" and SECRET.split()[-1] and part in hidden and len(part) >= len(hidden) - 3 for k, part, _ in found), secrets.scan(text)
    assert "hunter2" not in secrets.masked(text, "[SECRET]")
    assert secrets.masked(text, "[SECRET]").startswith("bonjour é ")


REPEATED = bytes(range(1, 256)) * 2
WRAP = base64.encodebytes(b"x" * 50 + SECRET.encode() + b" and some words more to fill another line of it").decode().strip()


@pytest.mark.parametrize(
    "hidden",
    [
        base64.b64encode(gzip.compress(b"first") + gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(bz2.compress(b"first") + bz2.compress(b"second") + bz2.compress(SECRET.encode())).decode(),
        base64.b64encode(gzip.compress(b"first") + SECRET.encode()).decode(),
        base64.b64encode(gzip.compress(SECRET.encode() + b" " + REPEATED)[:-9]).decode(),
        base64.b64encode(gzip.compress(gzip.compress(b"a") + gzip.compress(SECRET.encode()))).decode(),
        "".join(f"%{b:02x}" for b in gzip.compress(SECRET.encode())),
        urllib.parse.quote(zlib.compress(SECRET.encode())),
        urllib.parse.quote_plus(bz2.compress(SECRET.encode() + b" " + REPEATED)),
        "".join(f"\\x{b:02x}" for b in gzip.compress(SECRET.encode())),
        repr(gzip.compress(SECRET.encode() + b" " + REPEATED))[2:-1],
        "".join(f"&#{b};" for b in zlib.compress(SECRET.encode())),
        base64.b64encode(SECRET.encode() + b"\x00").decode(),
        base64.b64encode(b"\xff\xfe\x01" + SECRET.encode() + b"\xff").decode(),
        base64.b64encode(SECRET.encode("utf-16")).decode(),
        "%ff" + "".join(f"%{b:02x}" for b in SECRET.encode()),
        WRAP, WRAP.replace("\n", "\r\n"), WRAP.replace("\n", "\\n"),
    ],
)
def test_layers_are_opened_whole(hidden):
    text = f"bonjour é {hidden} and more words"
    found = [(k, a, b) for k, a, b, path in secrets.scan(text) if path and k == "assign"]
    assert found and all(10 <= a < b <= 10 + len(hidden) for _, a, b in found), secrets.scan(text)
    masked = secrets.masked(text, "[SECRET]")
    assert masked.startswith("bonjour é ") and masked.endswith(" and more words") and "[SECRET]" in masked
    # nothing of the secret can be decoded any more
    assert not any(path for *_, path in secrets.scan(masked))


def test_base64_is_placed_by_its_own_characters():
    for before, after in ((b"", b""), (b"some words, ", b" and more"), (b"\xc3\xa9\xff ", b"\xfe"), (b"x", b"y and a second token=zyxwvu9876")):
        hidden = base64.b64encode(before + SECRET.encode() + after).decode()
        text = f"see {hidden} now"
        found = [s for s in secrets.scan(text) if s[3]]
        assert len({a for _, a, _, _ in found}) == 1 + (b"second" in after)
        _, a, b, _ = max(s for s in found if s[1] == found[0][1])
        assert (a, b) == (4 + len(before) // 3 * 4, 4 + -(-(len(before) + len(SECRET)) // 3) * 4)


def test_long_texts_with_few_escapes_stay_small():
    import tracemalloc

    text = "plain words " * 400_000 + "pass%77ord%3Dabcdef123 " + "more words " * 400_000
    tracemalloc.start()
    (found,) = secrets.scan(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text[found[1] : found[2]] == "pass%77ord%3Dabcdef123" and peak < 12 * len(text)


def test_large_layers_are_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secrets, "MOST_BYTES", 1 << 16)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    for at in (10, (1 << 16) - 8, 200_000):
        hidden = base64.b64encode(gzip.compress(b"- " * (at // 2) + SECRET.encode() + b" -" * 150_000)).decode()
        (found,) = secrets.scan(f"see {hidden} now")
        assert found == ("assign", 4, 4 + len(hidden), "base64")


@pytest.mark.parametrize("kind", ["base64", "wrapped", "hex", "letters", "escapes", "marks"])
def test_time_grows_with_the_text(kind):
    import random
    import time

    def text(n):
        draw = random.Random(n)
        if kind in ("base64", "wrapped"):
            raw = draw.randbytes(n * 3 // 4)
            return (base64.b64encode if kind == "base64" else base64.encodebytes)(raw).decode()
        return {"hex": lambda: draw.randbytes(n // 2).hex(), "letters": lambda: "a" * n, "escapes": lambda: "%41\\u0041 " * (n // 10), "marks": lambda: "x\x9cBZh1x^ " * (n // 9)}[kind]()

    took = []
    for n in (250_000, 1_000_000):
        start = time.process_time()
        secrets.scan(text(n) + " " + base64.b64encode(SECRET.encode()).decode())
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 2 and took[1] < 30, took


def test_members_that_only_seem_to_start_are_not_opened():
    assert secrets.scan(("x\x9c" + "K" * 60) * 2000) == []
    # a real member is placed at its own bytes
    packed = zlib.compress(SECRET.encode()).decode("latin-1")
    text = f"see x\x9cKKKK {packed} and gzip words"
    assert [(k, text[a:b]) for k, a, b, path in secrets.scan(text) if path] == [("assign", packed)]
    broken = "".join(f"\\x{b:02x}" for b in gzip.compress(SECRET.encode() * 3 + REPEATED)[:-100])
    assert any(path and k == "assign" for k, *_, path in secrets.scan(f"see {broken} now"))


@pytest.mark.parametrize("front", ["", "a", "ab", "abc", "key_", "-x9", "Zm9vYmFyZm9vYmFyZm9vYg"])
def test_base64_behind_letters_is_found(front):
    text = f"data {front}{base64.b64encode(SECRET.encode()).decode()} end"
    assert any(k == "assign" and path for k, *_, path in secrets.scan(text))
    assert not any(path for *_, path in secrets.scan(secrets.masked(text, "[SECRET]")))


def test_places_in_long_layers_of_many_secrets():
    many = "é token=abcdef123 " * 20_000
    found = [s for s in secrets.scan(base64.b64encode(many.encode()).decode()) if s[3]]
    assert len(found) >= 20_000 and found[1][1] - found[0][1] in (24, 28)


def test_partly_encoded_secret_maps_to_its_source():
    text = "see pass%77ord%3Dabcdef123 now"
    (found,) = secrets.scan(text)
    assert text[found[1] : found[2]] == "pass%77ord%3Dabcdef123"


def test_cycles_and_plain_texts_end():
    assert secrets.scan("") == []
    assert secrets.scan("%25%25%25" * 50) == []
    assert secrets.scan("A" * 20_000) == []
    assert [s[:3] for s in secrets.scan("token: abcdef AKIA" + "Z" * 16 + " " + "ab" * 12)] == [("assign", 0, 13), ("access", 14, 34), ("hex", 35, 59)]


def test_secret_frames(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, SECRET, "s"), (3, SECRET, "s"), (4, "x " * 100_000, "s")], "doc_id long, text string, secrets string")
    got = sorted((r.doc_id, len(r.secrets)) for r in secrets.find_secrets(df).collect())
    assert got == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    masked = secrets.mask_secrets(df)
    assert masked.columns == df.columns
    assert {r.text for r in masked.where("doc_id = 3").collect()} == {"[SECRET]"}
    assert masked.where("doc_id = 1").first().text is None
    assert secrets.find_secrets(df.limit(0)).count() == 0


# --- urls


def judge_brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_url_verdicts(spark):
    cases = [
        None, "", "no scheme", "http://", "http://example.org", "http://Example.ORG/es/a", "https://a.b.example.org/es/", "http://example.org/en/12?x#y", "http://example.org/EN/1", "http://notexample.org/es/",
        "http://x.com/fr/a", "http://x.com/de/a", "http://x.com/de", "com/de/://y", "http://com/de/", "http://.com/de/", "http://a..com/de/", "http://x.com?/de/", "http://x.com#/de/", "x://org/://z", "http://ÉX.com/de/",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("keys", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == {i: judge_brute(u, urls.RULES) for i, u in enumerate(cases)}
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark, urls.RULES)).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, urls.rule_table(spark, urls.RULES).limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(30_000).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit("/")).alias("key"))
    listed = spark.range(0, 30_000, 7).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit("/")).alias("key"))
    levels = urls.build_cascade(listed, universe)
    assert len(levels) >= 2
    wrong = universe.withColumn("hit", urls.is_listed(F.col("key"), levels)).join(listed.withColumn("real", F.lit(True)), "key", "left").where(F.col("hit") != F.coalesce("real", F.lit(False)))
    assert wrong.count() == 0


def test_long_lists_are_joined(spark, small, monkeypatch):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {tuple(r) for r in urls.judge_urls(pages, urls.rule_table(spark, urls.RULES)).collect()}
    monkeypatch.setattr(urls, "MOST_BITS", 32)
    assert {tuple(r) for r in urls.judge_urls(pages, urls.rule_table(spark, urls.RULES)).collect()} == want


def test_no_level_has_more_keys_than_the_list(spark):
    universe, listed = spark.range(200_000).selectExpr("'k' || id as key"), spark.range(0, 200_000, 4000).selectExpr("'k' || id as key")
    levels = urls.build_cascade(listed, universe)
    assert sum(len(level.words) for level in levels[1:]) <= 2 * len(levels[0].words)
    assert universe.where(urls.is_listed(F.col("key"), levels)).count() == 50


def test_url_query(spark, small):
    urls_of = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op3_url_filter(spark, small).collect()}
    assert got == {k: judge_brute(u, urls.RULES) for k, u in urls_of.items()}


# --- warc


def warc_brute(rows):
    first = {}
    for k, html in rows:
        body = (html or "").encode()
        first[body] = min(k, first.get(body, k))
    out = {}
    for k, html in rows:
        body = (html or "").encode()
        again = first[body] != k
        out[k] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None)
    return out


def test_warc_query(spark, small):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op8_warc(spark, small).collect()}
    assert got == warc_brute(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, tmp_path, version):
    rows = [(1, "http://a.b/x y", "body\r\n\r\nWARC/1.0\r\n"), (2, None, None), (3, "http://c.d", ""), (4, "http://e", "body\r\n\r\nWARC/1.0\r\n"), (5, "http://é/", "\n\nü" * 5), (6, "u", "\n\nü" * 5), (7, "long", "q" * 400_000), (8, "longer", "é" * 1_500_000), (9, "longer", "é" * 1_500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("headers", F.lit(1))
    warc.write_arc(df, f"{tmp_path}/arc", version)
    warc.write_warc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, f"{tmp_path}/warc").collect()}
    assert got == warc_brute([(k, h) for k, _, h in rows])
    warc.write_arc(df.limit(0), f"{tmp_path}/none", version)
    warc.write_warc(spark, f"{tmp_path}/none", f"{tmp_path}/none-warc")
    assert warc.read_warc(spark, f"{tmp_path}/none-warc").count() == 0


def test_legacy_headers():
    record = warc.ArcRecord("http://a/", "1.2.3.4", "20010203040506", "text/plain", b"plain block")
    for version in (1, 2):
        data = warc.arc_version_block(version, "f.arc", "20010203040506") + b"\n" + warc.arc_record(version, record) + b"\n"
        (back,) = warc.parse_arc(data)
        h = warc.warc_headers(back)
        assert h["WARC-Type"] == "resource" and h["WARC-Date"] == "2001-02-03T04:05:06Z" and h["WARC-Target-URI"] == "http://a/"
        ((headers, block),) = warc.parse_warc(warc.warc_bytes(h.items(), back.block) + b"\r\n\r\n")
        assert block == b"plain block" and headers["WARC-Record-ID"] == h["WARC-Record-ID"]
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 1.2.3.4 20010101000000 text/plain 50\nshort"))


def test_one_gzip_member_for_each_record():
    """As legacy archives have it; also a record over many pieces, and a member that is cut short."""
    records = [warc.ArcRecord(f"http://a/{i}", "1.2.3.4", "20010203040506", "text/plain", bytes([97 + i]) * n) for i, n in enumerate((5, 0, 3 << 20, 70))]
    parts = [warc.arc_version_block(1, "f.arc", "20010203040506") + b"\n", *(warc.arc_record(1, r) + b"\n" for r in records)]
    data = b"".join(gzip.compress(p) for p in parts)
    assert [r.block for r in warc.parse_arc(data)] == [r.block for r in records]
    assert [r.block for r in warc.parse_arc(b"".join(parts))] == [r.block for r in records]
    assert [r.block for r in warc.parse_arc(gzip.compress(b"".join(parts)))] == [r.block for r in records]
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-20]))
    archive = [warc.warc_bytes(warc.warc_headers(r).items(), r.block) + b"\r\n\r\n" for r in records]
    assert [b for _, b in warc.parse_warc(b"".join(map(gzip.compress, archive)))] == [r.block for r in records]


def test_archives_of_any_name_are_read(spark, tmp_path):
    pages = [("http://a.org/", b"<p>one</p>"), ("http://b.org/x", b"<p>two</p>"), ("http://c.org/", b"<p>one</p>")]
    record = lambda url, body: b"%s 1.2.3.4 20010101000000 text/html %d\n" % (url.encode(), len(b := b"HTTP/1.0 200 OK\r\n\r\n" + body)) + b + b"\n"
    (tmp_path / "in").mkdir()
    head = warc.arc_version_block(1, "crawl.arc", "20010101000000")
    (tmp_path / "in/crawl-01.arc.gz").write_bytes(gzip.compress(head) + b"".join(gzip.compress(record(u, b)) for u, b in pages[:2]))
    (tmp_path / "in/deep").mkdir()
    (tmp_path / "in/deep/other.arc").write_bytes(head + record(*pages[2]))
    found = warc.files(spark, str(tmp_path / "in"))
    assert found.count() == 2 and warc.files(spark, str(tmp_path / "in"), "*.arc").count() == 1
    warc.write_warc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted(r.uri for r in back) == sorted(u for u, _ in pages) and len({r.payload_digest for r in back}) == 2
