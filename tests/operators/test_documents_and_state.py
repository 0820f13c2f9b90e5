import io
import zipfile
import zlib

import numpy as np

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import safety as S
from quarry.operators import structure as D
from quarry.sources import files, formats
from quarry.streaming import state as Z

OUTLINE = "# Guide\nIntro text here.\n\n## Setup\n1. First\n2. Second\n   - inner\n\n## Use\nBody line.\n第三章 规则\n第九条 内容"


def test_tree(spark):
    df = spark.createDataFrame([(1, OUTLINE), (2, None), (3, "")], "doc_id int, text string")
    nodes = D.build_tree(D.classify_lines(D.logical_lines(df)))
    rows = {r.title: r for r in nodes.where("doc = 1").collect()}
    assert rows["Setup"].depth == 2 and rows["Setup"].section_path == "Guide > Setup"
    assert rows["- inner"].parent_no == rows["2. Second"].node_no and rows["2. Second"].prev_no == rows["1. First"].node_no
    assert rows["Use"].prev_no == rows["Setup"].node_no and rows["Guide"].parent_no == 0
    assert nodes.where("doc in (2, 3)").count() == 2
    assert {r.type for r in D.edges(nodes).collect()} == {"HAS_SECTION", "HAS_ITEM", "NEXT"}
    below = D.items_below(nodes, spark.createDataFrame([(1, rows["Setup"].node_no)], "doc int, root int"))
    assert below.count() == 3


def test_chunks(spark):
    df = spark.createDataFrame([(["a" * 10, "b" * 200, "c" * 5],)], "p array<string>")
    (out,) = df.select(D.with_overlap(F.col("p"), 20)).first()
    assert out[1] == "a" * 10 + "\n" + "b" * 200 and out[2] == "b" * 20 + "\n" + "c" * 5
    chunks = spark.createDataFrame([(1, 0, 1, "red green blue"), (1, 0, 2, "red green"), (1, 0, 3, "other words")], "doc int, parent int, chunk_no int, text string")
    assert [r.text for r in D.merge_semantic(chunks, lexical=0.18).orderBy("chunk_no").collect()] == ["red green blue\nred green", "other words"]


def test_numbers(spark):
    df = spark.createDataFrame([("赔付3万元，１２天内，1,200元 [1]",)], "t string")
    assert df.select(S.quantities(F.col("t"))).first()[0] == [(30000.0, "万元"), (12.0, "天"), (1200.0, "元")]
    df = spark.createDataFrame([("九", 9), ("十二", 12), ("二十三", 23), ("7", 7), ("x", None)], "t string, n int")
    assert df.where(~T.cn_to_int(F.col("t")).eqNullSafe(F.col("n"))).count() == 0


def test_personal_data(spark):
    text = "call 13812345678, id 110101199003071234, card 4111 1111 1111 1111, a@b.co"
    df = S.find_pii(spark.createDataFrame([(text,), (None,)], "t string"), "t")
    first = df.where("t is not null").select(S.anonymise(F.col("t"), F.col("pii")).alias("x"), "pii").first()
    assert first.x == "call 13*******78, id 1101**********1234, card 4111***********1111, a****o"
    assert df.where("t is null").first().pii == []
    assert spark.range(1).select(S.luhn(F.lit("4111 1111 1111 1111")), S.luhn(F.lit("4111 1111 1111 1112")), S.luhn(F.lit("42"))).first()[:] == (True, False, False)


def test_audit(spark):
    a = spark.createDataFrame([(1, "需要5天。见[9]！《外部文档》如此规定[1]。证据未收录《另一文档》。《办法》第3条适用[1]")], "answer_id int, answer string")
    e = spark.createDataFrame([(1, 1, "01_办法.md", "第三条")], "answer_id int, ref int, document_name string, content string")
    got = {(r.issue, r.detail) for r in S.audit_answer(a, e).collect()}
    assert got == {("dangling_reference", "9"), ("unknown_document", "外部文档"), ("uncited_claim", "需要5天。")}


def test_code_is_parsed_only(spark):
    df = spark.createDataFrame([("import os\nopen('x')",), ("1 +",), ("x = 1",)], "c string")
    assert [r[0] for r in df.select(S.code_issues(F.col("c"))).collect()] == [["open", "os"], ["syntax"], []]


EVENTS = [(1, i, t) for i, t in enumerate([0, 10, 20, 30, 61, 62, 75])] + [(2, 100, 5)]


def test_rate_limit_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "user_id long, event_id long, second long")
    want = {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 100: True}
    assert {r.event_id: r.admitted for r in Z.rate_limit(df, 3, 60).collect()} == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = Z.rate_limit_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 3, 60)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.event_id: r.admitted for r in spark.table("limited").collect()} == want


def test_breaker_and_lease():
    state, met = ("closed", 0, 0), []
    for at, failed in [(0, True), (1, True), (2, False), (12, True), (13, False), (30, False), (31, False)]:
        now, state = Z.breaker(state, at, failed, 2, 10)
        met.append(now)
    assert met == ["closed", "closed", "rejected", "half_open", "rejected", "half_open", "closed"]
    ok, held = Z.lease(None, 0, "a", "acquire", 10)
    assert ok and not Z.lease(held, 5, "b", "acquire", 10)[0] and Z.lease(held, 10, "b", "acquire", 10)[0] and Z.lease(held, 5, "a", "release", 10) == (True, None)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n1\n2,3,4\na|b,c\n")
    (tmp_path / "sub" / "b.txt").write_bytes("中文内容".encode("gb18030"))
    (tmp_path / "c.html").write_text("<h1>T</h1><p>x &amp; y</p>")
    (tmp_path / "~$skip.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/d.md", "# D")
    found = files.read_folder(spark, str(tmp_path))
    texts = {r.name: r.text for r in files.parse_files(found.where("suffix <> 'zip'")).collect()}
    assert texts == {"a.csv": "| x | y |\n| --- | --- |\n| 1 | |\n| 2 | 3 |\n| a\\|b | c |", "b.txt": "中文内容", "c.html": "# T\nx & y"}
    assert {r.name: r.text for r in files.parse_files(files.unzip(found.where("suffix = 'zip'"))).collect()} == {"d.md": "# D"}


def test_crawl(spark):
    pages = spark.createDataFrame([("http://a.x/", '<a href="/b">b</a><a href="http://o.y/">o</a>'), ("http://a.x/b", '<a href="/">up</a><a href="c?utm_source=1">c</a><a href="/no/1">n</a>')], "url string, html string")
    rules = spark.createDataFrame([("a.x", "/no")], "host string, prefix string")
    got = {r.url: r.depth for r in files.crawl(pages.limit(1).select("url"), pages, 2, rules).collect()}
    assert got == {"http://a.x/": 0, "http://a.x/b": 1, "http://a.x/c": 2}


def test_merged_sections(spark):
    rng = np.random.default_rng(4)
    rows = [(d, i, f"s{i}", "x" * int(rng.choice([0, 10, 100, 300, 330, 600]))) for d in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "doc int, node_no int, section_path string, content string")
    want = []
    for d in range(20):
        groups, held, n = [], [], 0
        for _, no, _, text in (r for r in rows if r[0] == d):
            if held and n + len(text) > 512:
                groups.append(held)
                held, n = [], 0
            held.append((no, text))
            n += len(text)
            if n >= 320:
                groups.append(held)
                held, n = [], 0
        groups.append(held)
        texts = [(g[0][0], "\n".join(t for _, t in g if t)) for g in groups if g]
        want += [(d, no, k, f"s{no}", t) for k, (no, t) in enumerate([x for x in texts if len(x[1]) >= 50], 1)]
    assert sorted(tuple(r) for r in D.merged_sections(df).collect()) == sorted(want)


def test_paragraph_segments(spark):
    text = "\n\n".join(["a" * 50, "b" * 60, "c" * 200, "d" * 10, "e" * 10])
    got = spark.createDataFrame([(text,)], "t string").select(D.paragraph_segments(F.col("t"), 120)).first()[0]
    assert got == ["a" * 50 + "\n\n" + "b" * 60, "c" * 200, "d" * 10 + "\n\n" + "e" * 10]


def test_repaired_parents():
    nodes = [("document", "", None), ("section", "1", 7), ("section", "1.2", 0), ("section", "2.1", 0), ("section", "2", 1), ("list_item", "", 4), ("section", "", 5), ("section", "3.4.5", 99)]
    parents = D.repaired_parents(nodes)
    assert parents == [None, 0, 1, 4, 0, 4, 4, 0]
    order = D.below_root(parents)
    assert sorted(order) == list(range(1, 8)) and all(parents[k] == 0 or order.index(parents[k]) < order.index(k) for k in order)
    assert sorted(D.below_root([None, 2, 1])) == [1, 2]


def test_noise_and_titles(spark):
    df = spark.createDataFrame([(1, "Guide\nText one.\nCopyright X\nGuide\nCopyright X\nsame\nsame\nsame\nv1.2 | a\nv1.2 | a\nv1.2 | a")], "doc_id int, text string")
    kinds = {r.line: r.kind for r in D.classify_lines(D.logical_lines(df), F.lit("guide.md")).collect()}
    assert kinds["Guide"] == kinds["Copyright X"] == kinds["v1.2 | a"] == "noise" and kinds["same"] != "noise"


def test_stages_with_retries(spark):
    tried, dead, out = [], [], []

    def flaky(df):
        tried.append(1)
        if len(tried) < 3:
            raise RuntimeError("again")
        return df.withColumn("y", F.col("id") + 1)

    Z.staged([("parse", flaky), ("store", lambda df: out.extend(r.y for r in df.collect()) or df)], lambda name, e: dead.append(name))(spark.range(2), 0)
    assert out == [1, 2] and not dead and len(tried) == 3
    Z.staged([("parse", lambda df: 1 / 0)], lambda name, e: dead.append(name), 1)(spark.range(2), 0)
    assert dead == ["parse"]


def test_sinks_by_pattern(spark):
    got = {}
    df = spark.createDataFrame([("a.x",), ("a.y",), ("b",)], "event_type string")
    Z.sink_by_pattern({p: lambda d, p=p: got.__setitem__(p, sorted(r[0] for r in d.collect())) for p in ("*", "a.*", "b")})(df, 0)
    assert got == {"*": ["a.x", "a.y", "b"], "a.*": ["a.x", "a.y"], "b": ["b"]}


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files_and_pdf(spark, tmp_path):
    w, a, s = formats.W[1:-1], formats.A[1:-1], formats.S[1:-1]
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    docx = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr>{cell("x")}{cell("y|z")}</w:tr><w:tr>{cell("1")}</w:tr></w:tbl></w:body></w:document>'
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="{a}"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    sheet = f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    book = f'<workbook xmlns="{s}" xmlns:r="{formats.REL[1:-1]}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'
    content = zlib.compress(b"BT (Hello \\(you\\)) Tj 0 -12 Td [(sp) -20 (lit)] TJ T* <4142> Tj ET")
    kinds = {
        "a.docx": zipped({"word/document.xml": docx}),
        "b.pptx": zipped({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")}),
        "c.xlsx": zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<R><R Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>head</t></si></sst>'}),
        "d.pdf": b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >> stream\n" + content + b"\nendstream endobj",
        "e.pdf": b"%PDF-1.4 nothing to read", "f.docx": b"no archive",
    }
    for name, raw in kinds.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.name: (r.text, r.error) for r in files.parse_files(files.read_folder(spark, str(tmp_path))).collect()}
    assert got["a.docx"] == ("## Title\n\na b\n\n| x | y\\|z |\n| --- | --- |\n| 1 | |", None)
    assert got["b.pptx"] == ("## Slide 1\ntwo\n\n## Slide 2\nten", None)
    assert got["c.xlsx"] == ("## One\n| head | | 5 |\n| --- | --- | --- |\n| | in | |", None)
    assert got["d.pdf"] == ("Hello (you)\nsplit\nAB", None)
    assert got["e.pdf"][0].startswith("%PDF") and got["e.pdf"][1] and got["f.docx"][1]
