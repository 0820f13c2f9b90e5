"""The documents format: listing, filters, parts, archives and the writer."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import documents as D


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("documents")
    for name, data in {"a.txt": b"one", "deep/er/b.HTML": b"<p>two</p>", "empty.txt": b"", "noname": b"\xff\x00", "_SUCCESS": b"", ".hidden/x.txt": b"no", "~$lock.txt": b"no", "big.bin": bytes(range(256)) * 40}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "pack.zip").write_bytes(zipped({"in/c.txt": b"three", ".h/d.txt": b"no", "long.txt": b"x" * 5000, "none.md": b""}))
    D.register(spark)
    return root


def read(spark, folder, **options):
    return spark.read.format("documents").options(**options).load(str(folder))


def test_files_and_members_are_rows(spark, folder):
    got = {r.path.removeprefix(f"{folder}/"): (r.name, r.suffix, r.size, r.part, bytes(r.content)) for r in read(spark, folder).collect()}
    assert got == {
        "a.txt": ("a.txt", "txt", 3, 0, b"one"), "deep/er/b.HTML": ("b.HTML", "html", 10, 0, b"<p>two</p>"), "empty.txt": ("empty.txt", "txt", 0, 0, b""), "noname": ("noname", "", 2, 0, b"\xff\x00"),
        "big.bin": ("big.bin", "bin", 10240, 0, bytes(range(256)) * 40), "pack.zip!/in/c.txt": ("c.txt", "txt", 5, 0, b"three"), "pack.zip!/long.txt": ("long.txt", "txt", 5000, 0, b"x" * 5000), "pack.zip!/none.md": ("none.md", "md", 0, 0, b""),
    }


@pytest.mark.parametrize("part", [1000, 1024, 10240, 70])
def test_large_files_come_in_parts(spark, folder, part):
    df = read(spark, folder, partBytes=str(part), taskBytes="3000")
    rows = df.where("name = 'big.bin' OR name = 'long.txt'").orderBy("path", "start").collect()
    for name, whole in (("big.bin", bytes(range(256)) * 40), ("long.txt", b"x" * 5000)):
        mine = [r for r in rows if r.name == name]
        assert b"".join(bytes(r.content) for r in mine) == whole and [r.part for r in mine] == list(range(len(mine)))
        assert all(len(r.content) <= part and r.size == len(whole) for r in mine)
    assert df.where("size = 0").count() == 2


def test_filters_cut_the_listing(spark, folder, monkeypatch):
    reader = D.DocumentReader({"path": str(folder)})
    kept = list(reader.pushFilters([D.EqualTo(("suffix",), "txt"), D.GreaterThan(("size",), 3), D.EqualTo(("content",), b"")]))
    assert [type(f) for f in kept] == [D.EqualTo] and kept[0].attribute == ("content",)
    assert sorted(e.name for s in reader.partitions() for e, _, _ in s.pieces) == ["c.txt", "long.txt"]
    df = read(spark, folder)
    plan = df.where("suffix = 'txt' AND size > 3")._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan
    for where in ("suffix = 'txt'", "suffix IN ('md', 'bin') OR size = 3", "NOT suffix = 'txt'", "name LIKE 'b%'", "path LIKE '%!/%' AND size >= 5", "length(content) = 5", "suffix IS NOT NULL AND name LIKE '%.txt'"):
        assert sorted(r.path for r in df.where(where).collect()) == sorted(r.path for r in df.cache().where(where).collect()), where
        df.unpersist()


def test_shares_are_of_one_size():
    entries = [D.Entry(f"f{i}", 10) for i in range(25)] + [D.Entry("big", 1050)] + [D.Entry("z.zip", 30, f"m{i}") for i in range(9)]
    shares = D.shares(iter(entries), 100, 100)
    assert all(sum(n for _, _, n in s.pieces) <= 100 for s in shares) and len(shares) <= 20
    assert sum(n for s in shares for _, _, n in s.pieces) == 250 + 1050 + 270


def test_written_documents_come_back(spark, folder, tmp_path):
    rows = [("x/1.txt", b"a"), ("x/2.txt", b""), ("y.bin", b"\x00\xff"), ("z.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("more", F.lit(1)).repartition(3)
    out = tmp_path / "out"
    df.write.format("documents").mode("append").save(str(out))
    back = lambda: {r.path.removeprefix(f"{out}/"): bytes(r.content) for r in read(spark, out).collect()}
    assert back() == {p: b or b"" for p, b in rows} and not list(out.glob("_*"))
    # a failed write leaves what was there
    bad = spark.createDataFrame([("ok.txt", b"1"), ("../up.txt", b"2")], "path string, content binary")
    with pytest.raises(Exception, match="no place"):
        bad.write.format("documents").mode("append").save(str(out))
    assert back() == {p: b or b"" for p, b in rows}  # what a task that was still running leaves aside is hidden
    df.where("path = 'y.bin'").write.format("documents").mode("overwrite").save(str(out))
    assert back() == {"y.bin": b"\x00\xff"}


def test_empty_folders(spark, folder, tmp_path):
    assert read(spark, tmp_path).count() == 0
