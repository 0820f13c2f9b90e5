"""The stream of new rows: each row once over restarts, old row groups unread."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarry.sources import changes

DAY = datetime.datetime(2024, 1, 1)


def run(spark, path, out, **options):
    stream = spark.readStream.format("changes").options(path=path, column="updated_at", **options).schema("id long, updated_at timestamp_ntz, note string").load()

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination(90)
    return sorted(r.id for r in spark.read.schema("id long").parquet(f"{out}/rows").collect()) if (out / "rows").exists() else []


def put(path, name, rows, group=2):
    path.mkdir(exist_ok=True)
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "updated_at": pa.array([None if r[1] is None else DAY + datetime.timedelta(hours=r[1]) for r in rows], pa.timestamp("us"))})
    pq.write_table(table, path / name, row_group_size=group)


def test_two_runs_read_each_row_once(spark, tmp_path):
    changes.register(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    assert run(spark, str(source), out) == []
    put(source, "a.parquet", [(1, 0), (2, 1), (3, None), (4, 2), (5, 2)])
    assert run(spark, str(source), out, marks=f"{tmp_path}/marks") == [1, 2, 4, 5]
    assert run(spark, str(source), out, marks=f"{tmp_path}/marks") == [1, 2, 4, 5]
    put(source, "b.parquet", [(6, 3), (7, 9)])
    put(source, "_hidden.parquet", [(99, 9)])
    assert run(spark, str(source), out, marks=f"{tmp_path}/marks") == [1, 2, 4, 5, 6, 7]
    put(source, "c.parquet", [(8, 10)])
    assert run(spark, str(source), tmp_path / "other", marks=f"{tmp_path}/marks")[-1] == 8


def test_late_rows_within_the_bound_are_not_missed(spark, tmp_path):
    changes.register(spark)
    source, out, hours = tmp_path / "in", tmp_path / "out", 3_600_000_000
    put(source, "a.parquet", [(1, 0), (2, 10)])
    assert run(spark, str(source), out, lateness=5 * hours) == [1]
    put(source, "b.parquet", [(3, 6), (4, 20)])
    assert run(spark, str(source), out, lateness=5 * hours) == [1, 2, 3]


def test_row_groups_outside_the_range_are_not_read(tmp_path):
    put(tmp_path / "in", "a.parquet", [(i, i) for i in range(100)], 10)
    from pyspark.sql.types import StructType

    reader = changes.ChangeReader({"path": str(tmp_path / "in"), "column": "updated_at"}, StructType.fromDDL("id long, updated_at timestamp_ntz"))
    mark = lambda h: {"mark": str(int((DAY + datetime.timedelta(hours=h) - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000)}
    assert reader.latestOffset() == mark(99)
    (share,) = reader.partitions(mark(35), mark(52))
    assert [g.number for g in share.groups] == [3, 4, 5]
    assert [i for b in reader.read(share) for i in b.column(0).to_pylist()] == list(range(36, 53))
    assert reader.partitions(mark(99), mark(99)) == []
