"""New rows of a Parquet table as a stream that Spark plans: `spark.readStream.format("changes")`.

A row is new if its mark (a column such as updated_at) is above the last batch's. The driver reads footers only, those of files that
it hasn't seen; a batch's tasks are the row groups whose statistics reach into its range of marks, so old ones are not opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from quarry.sources.documents import TASK_BYTES, hidden, opened

MARK_FILE = "mark.json"


@dataclass(frozen=True)
class Group:
    """A row group of a file: its bytes, and the least and largest mark in it (None: unknown)."""

    path: str
    number: int
    size: int
    low: int | None
    high: int | None


@dataclass
class Share(InputPartition):
    """What one task reads: row groups, and the range of marks, above low (None: all) up to high."""

    groups: list[Group]
    low: int | None
    high: int


def as_integers(values: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """Marks as integers: times in microseconds, dates in days, integers as they are."""
    kind = values.type
    if pa.types.is_timestamp(kind):
        return values.cast(pa.timestamp("us", kind.tz), safe=False).cast(pa.int64())
    if pa.types.is_date32(kind):
        return values.cast(pa.int32()).cast(pa.int64())
    if pa.types.is_integer(kind):
        return values.cast(pa.int64())
    raise ValueError(f"a mark must be a time, a date or an integer, not {kind}")


def parquet_files(path: str) -> Iterator[fs.FileInfo]:
    store, root = opened(path)
    found = store.get_file_info(root)
    infos = [found] if found.type == fs.FileType.File else [] if found.type == fs.FileType.NotFound else store.get_file_info(fs.FileSelector(root, recursive=True))
    for info in infos:
        if info.type == fs.FileType.File and (info is found or not hidden(info.path, root) and info.path.endswith(".parquet")):
            yield info


def groups_of(store: fs.FileSystem, path: str, column: str) -> list[Group]:
    """The row groups of a file that may hold marks, from its footer."""
    with store.open_input_file(path) as f:
        meta = pq.read_metadata(f)
    kind = meta.schema.to_arrow_schema().field(column).type
    at = meta.schema.names.index(column)
    out = []
    for k in range(meta.num_row_groups):
        group = meta.row_group(k)
        stats = group.column(at).statistics
        low = high = None
        if stats is not None and stats.has_min_max:
            low, high = as_integers(pa.array([stats.min, stats.max], kind)).to_pylist()
        elif stats is not None and stats.has_null_count and stats.null_count == group.num_rows:
            continue
        out.append(Group(path, k, group.total_byte_size, low, high))
    return out


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.column, self.schema = options["path"], options["column"], schema
        self.lateness, self.marks = int(options.get("lateness", 0)), options.get("marks")
        self.most = int(options.get("taskbytes", TASK_BYTES))
        self.known: dict[tuple, list[Group]] = {}

    def listed(self) -> list[Group]:
        store, _ = opened(self.path)
        seen = {(i.path, i.size, str(i.mtime)): i.path for i in parquet_files(self.path)}
        self.known = {k: self.known[k] if k in self.known else groups_of(store, p, self.column) for k, p in sorted(seen.items())}
        return [g for groups in self.known.values() for g in groups]

    def high(self, group: Group) -> int | None:
        """A group's largest mark, read from its column where the footer doesn't tell."""
        if group.high is not None:
            return group.high
        with opened(self.path)[0].open_input_file(group.path) as f:
            return pc.max(as_integers(pq.ParquetFile(f).read_row_group(group.number, [self.column]).column(0))).as_py()

    def initialOffset(self) -> dict:  # noqa: N802
        """The committed mark of the folder `marks`, for a query without a checkpoint; else from the start."""
        if self.marks:
            store, root = opened(self.marks)
            if store.get_file_info(f"{root}/{MARK_FILE}").type == fs.FileType.File:
                with store.open_input_file(f"{root}/{MARK_FILE}") as f:
                    return json.loads(f.read())
        return {"mark": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        marks = [m for g in self.listed() if (m := self.high(g)) is not None]
        self.last = max(marks) - self.lateness if marks else None
        return {"mark": "" if self.last is None else str(self.last)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        """Row groups whose marks reach into the range, together up to taskBytes."""
        if not end["mark"]:
            return []
        low, high = int(start["mark"]) if start["mark"] else None, int(end["mark"])
        out, held, n = [], [], 0
        for g in self.listed():
            if g.low is not None and (g.low > high or low is not None and g.high <= low):
                continue
            if held and n + g.size > self.most:
                out.append(Share(held, low, high))
                held, n = [], 0
            held.append(g)
            n += g.size
        return [*out, Share(held, low, high)] if held and (low is None or high > low) else out

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, target = opened(self.path)[0], to_arrow_schema(self.schema)
        for g in share.groups:
            with store.open_input_file(g.path) as f:
                file = pq.ParquetFile(f)
                wanted = [c for c in dict.fromkeys([*target.names, self.column]) if c in file.schema_arrow.names]
                for batch in file.iter_batches(8192, row_groups=[g.number], columns=wanted):
                    mark = as_integers(batch.column(wanted.index(self.column)))
                    new = pc.less_equal(mark, share.high)
                    new = new if share.low is None else pc.and_(new, pc.greater(mark, share.low))
                    rows = batch.filter(pc.fill_null(new, False))
                    if rows.num_rows:
                        columns = [rows.column(wanted.index(t.name)).cast(t.type) if t.name in wanted else pa.nulls(rows.num_rows, t.type) for t in target]
                        yield pa.RecordBatch.from_arrays(columns, schema=target)

    def commit(self, end: dict) -> None:
        if self.marks and end["mark"]:
            store, root = opened(self.marks)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{MARK_FILE}.new") as f:
                f.write(json.dumps(end).encode())
            store.move(f"{root}/{MARK_FILE}.new", f"{root}/{MARK_FILE}")


class ChangeSource(DataSource):
    """Format `changes`: a stream of the rows of a Parquet file or folder, each once, in batches of rising marks.

    Options: path; column, the mark (a time, a date or an integer; rows without one are never new); lateness, how far (in
    microseconds, days or units) a batch stays behind the largest mark, so that rows that come late by less are not missed
    (later ones are); marks, a folder where committed marks are kept, from which a query without a checkpoint goes on;
    taskBytes. An empty or missing folder gives no rows, with a schema of its own only. The schema is the first file's,
    unless given; columns that a file lacks are null.
    """

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> StructType:
        for info in parquet_files(self.options["path"]):
            with opened(self.options["path"])[0].open_input_file(info.path) as f:
                return from_arrow_schema(pq.read_schema(f), prefer_timestamp_ntz=True)
        raise ValueError("no Parquet file tells the schema: give one")

    def streamReader(self, schema: StructType) -> ChangeReader:  # noqa: N802
        return ChangeReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ChangeSource)
