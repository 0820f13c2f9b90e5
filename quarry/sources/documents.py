"""Files of folders and zip archives as a data source that Spark plans: `spark.read.format("documents")`.

The driver lists (and reads archives' directories, not their data), filters on path, name, suffix and size cut the listing,
and what is left is dealt into partitions of about one size: many small files together, large ones in ranges, archives
by members. The writer puts each row's bytes at its path, whole or not at all. Stores are those that pyarrow opens
(local folders, s3, gs, hdfs, ...).
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "path string, name string, suffix string, size long, part int, start long, content binary"
#: Bytes of one row's content, and of what a task reads, unless the options partBytes and taskBytes say otherwise.
PART_BYTES = TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Entry:
    """A listed file, or the member of an archive that `member` names."""

    path: str
    size: int
    member: str = ""

    @property
    def shown(self) -> str:
        return f"{self.path}!/{self.member}" if self.member else self.path

    @property
    def name(self) -> str:
        return (self.member or self.path).rsplit("/", 1)[-1]

    @property
    def suffix(self) -> str:
        return self.name.rsplit(".", 1)[-1].lower() if "." in self.name else ""


@dataclass
class Share(InputPartition):
    """What one task reads: entries with the first byte and the number of bytes of each."""

    pieces: list[tuple[Entry, int, int]]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path inside it."""
    path = path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def hidden(path: str, root: str) -> bool:
    return any(p.startswith((".", "_", "~$")) for p in path.removeprefix(root).split("/"))


def listed(store: fs.FileSystem, root: str) -> Iterator[Entry]:
    """All files below root, those in zip archives as members; hidden ones (`.`, `_`, `~$`) are passed over."""
    found = store.get_file_info(root)
    infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    for info in infos:
        if info.type != fs.FileType.File or info is not found and hidden(info.path, root):
            continue
        if not info.path.lower().endswith(".zip"):
            yield Entry(info.path, info.size)
            continue
        with store.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
            for m in z.infolist():
                if not m.is_dir() and not hidden(m.filename, ""):
                    yield Entry(info.path, m.file_size, m.filename)


COMPARE: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}
LISTED = {"path": lambda e: e.shown, "name": lambda e: e.name, "suffix": lambda e: e.suffix, "size": lambda e: e.size}


def on_listing(f: Filter) -> Callable[[Entry], bool] | None:
    """A filter as a test of listed entries; None if the listing can't decide it."""
    if isinstance(f, Not):
        inner = on_listing(f.child)
        return inner and (lambda e: not inner(e))
    if isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in LISTED:
        return lambda e: True
    if type(f) not in COMPARE or len(f.attribute) != 1 or f.attribute[0] not in LISTED:
        return None
    get, compare, value = LISTED[f.attribute[0]], COMPARE[type(f)], f.value
    return None if value is None else lambda e: compare(get(e), value)


def shares(entries: Iterator[Entry], part: int, most: int) -> list[Share]:
    """Entries dealt into shares of about `most` bytes, files in parts of `part` bytes; a member of an archive is one piece, as its bytes can only be read in turn."""
    out, held, n = [], [], 0
    for e in entries:
        step = max(e.size if e.member else part, 1)
        for start in range(0, max(e.size, 1), step):
            size = min(step, e.size - start)
            if held and n + size > most:
                out.append(Share(held))
                held, n = [], 0
            held.append((e, start, size))
            n += size
    return [*out, Share(held)] if held else out


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.part, self.most = int(options.get("partbytes", PART_BYTES)), int(options.get("taskbytes", TASK_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if on_listing(f):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Share]:
        tests = [on_listing(f) for f in self.tests]

        def entries() -> Iterator[Entry]:
            for p in self.paths:
                store, root = opened(p)
                yield from (e for e in sorted(listed(store, root), key=lambda e: (e.path, e.member)) if all(t(e) for t in tests))

        return shares(entries(), self.part, self.most) or [Share([])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.paths[0])
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("suffix", pa.string()), ("size", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("content", pa.binary())])

        def row(e: Entry, start: int, content: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": e.shown, "name": e.name, "suffix": e.suffix, "size": e.size, "part": start // self.part, "start": start, "content": content}], schema)

        for e, start, size in share.pieces:
            with store.open_input_file(e.path) as f:
                if not e.member:
                    f.seek(start)
                    yield row(e, start, f.read(size))
                    continue
                with zipfile.ZipFile(f) as z, z.open(e.member) as m:
                    at = 0
                    while (content := m.read(self.part)) or not at:
                        yield row(e, at, content)
                        at += len(content)
                        if not content:
                            break


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class DocumentWriter(DataSourceWriter):
    """Rows (path, content) as files below the folder. A task writes aside; the driver moves what all tasks wrote into place."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool) -> None:
        import uuid

        self.root, self.overwrite, self.columns = options["path"], overwrite, columns
        self.aside = f"_writing-{uuid.uuid4().hex}"
        if not {"path", "content"} <= set(columns):
            raise ValueError("documents are written from the columns path and content")

    def write(self, rows: Iterator) -> Written:
        import uuid

        store, root = opened(self.root)
        folder = f"{root}/{self.aside}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        done = []
        for n, r in enumerate(rows):
            name = (r["path"] or "").strip("/")
            if not name or any(p in ("", ".", "..") for p in name.split("/")):
                raise ValueError(f"no place below the folder: {r['path']!r}")
            with store.open_output_stream(f"{folder}/{n}") as f:
                f.write(bytes(r["content"] or b""))
            done.append((f"{folder}/{n}", name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.root)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name != self.aside:
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        for source, name in (x for m in messages if m for x in m.files):
            store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            store.move(source, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.root)
        if store.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.aside}")


class DocumentSource(DataSource):
    """Format `documents`. Reading gives a row for each file or archive member (path `archive!/member`), and for each part of
    `partBytes` of a larger one; size is that of the whole. Options: path (several by commas, of one store), partBytes, taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let its filters reach the listing."""
    spark.dataSource.register(DocumentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
