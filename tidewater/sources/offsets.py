"""Records in files with an index of byte offsets, read by seeking.

``write_records`` lets each task write its records to a file of its own and returns where
they went; the index, Parquet in order of the record numbers, names the files of
the attempts that counted. The data source ``offset_records`` plans from the index's file
statistics, so filters on the record number reach it: a task reads its stretch of the
index and only the bytes of the records that pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Rows of the index that one task reads.
INDEX_ROWS = 100_000
#: Records nearer than this in a file are read in one go.
_GAP = 64 << 10


def write_records(df: DataFrame, value: str, order: str, path: str, *, separator: bytes = b"\n", parts: int | None = None) -> DataFrame:
    """Write ``value`` (string or binary) of each row, by the unique column ``order``, end to end; returns the index.

    Index: line_no (from 0, in order), ``order``, file, offset, length. Null values have no bytes. A lost task
    writes another file, and the index names the one that counts.
    """
    from tidewater.operators.sequences import with_rank

    spark = df.sparkSession
    rows = with_rank(df.select(F.col(order).alias("key"), F.col(value).cast("binary").alias("value")), "key").select(F.col("rank").cast("long").alias("line_no"), "key", "value")
    rows = (rows.repartitionByRange(parts, "line_no") if parts else rows.repartitionByRange("line_no")).sortWithinPartitions("line_no")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(f"{folder}/data", recursive=True)
        name, at, out = f"data/{uuid.uuid4().hex}", 0, None
        for batch in batches:
            out = out or system.open_output_stream(f"{folder}/{name}")
            offsets, lengths = [], []
            for data in batch.column(2).to_pylist():
                offsets.append(at)
                lengths.append(len(data or b""))
                out.write((data or b"") + separator)
                at += lengths[-1] + len(separator)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name] * batch.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["line_no", "key", "file", "offset", "length"])
        if out:
            out.close()

    index = rows.mapInArrow(run, f"line_no long, key {kind}, file string, offset long, length long")
    index.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index").withColumnRenamed("key", order)


class _Files:
    """Reads stretches of bytes; one open file at a time."""

    def __init__(self, path: str) -> None:
        self.system, self.folder = fs.FileSystem.from_uri(path)
        self.name, self.open = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.open = name, self.system.open_input_file(f"{self.folder}/{name}")
        self.open.seek(offset)
        return self.open.read(length)

    def several(self, wanted: list[tuple[str, int, int]]) -> list[bytes]:
        """The bytes of (file, offset, length), in the order asked for; near stretches are read in one go."""
        out: list[bytes] = [b""] * len(wanted)
        by = sorted(range(len(wanted)), key=lambda i: wanted[i])
        run: list[int] = []

        def flush() -> None:
            if run:
                name, first = wanted[run[0]][0], wanted[run[0]][1]
                data = self.read(name, first, max(wanted[i][1] + wanted[i][2] for i in run) - first)
                for i in run:
                    out[i] = data[wanted[i][1] - first : wanted[i][1] - first + wanted[i][2]]
                run.clear()

        for i in by:
            if run and (wanted[i][0] != wanted[run[-1]][0] or wanted[i][1] > wanted[run[-1]][1] + wanted[run[-1]][2] + _GAP):
                flush()
            run.append(i)
        flush()
        return out

    def close(self) -> None:
        if self.open:
            self.open.close()


class _Stretch(InputPartition):
    """Rows of one file of the index."""

    def __init__(self, file: str, first: int, count: int) -> None:
        self.file, self.first, self.count = file, first, count


class OffsetReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.kept = path, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("line_no",):
                self.kept.append(f)
            else:
                yield f

    def _may(self, least: int, most: int) -> bool:
        """Whether numbers from ``least`` to ``most`` can pass."""
        for f in self.kept:
            if isinstance(f, EqualTo) and not least <= f.value <= most or isinstance(f, In) and not any(v is not None and least <= v <= most for v in f.value):
                return False
            if isinstance(f, GreaterThan) and most <= f.value or isinstance(f, GreaterThanOrEqual) and most < f.value:
                return False
            if isinstance(f, LessThan) and least >= f.value or isinstance(f, LessThanOrEqual) and least > f.value:
                return False
        return True

    def partitions(self) -> list[_Stretch]:
        system, folder = fs.FileSystem.from_uri(self.path)
        out = []
        for fragment in ds.dataset(f"{folder}/index", filesystem=system, format="parquet").get_fragments():
            at = 0
            for group in fragment.row_groups:  # their statistics come from the files' ends
                stats = group.statistics.get("line_no")
                for first in range(0, group.num_rows, INDEX_ROWS):
                    count = min(INDEX_ROWS, group.num_rows - first)
                    # numbers are consecutive in a file, so a stretch has its own bounds
                    least = stats["min"] + first if stats and stats["max"] - stats["min"] + 1 == group.num_rows else None
                    if stats is None or self._may(least if least is not None else stats["min"], least + count - 1 if least is not None else stats["max"]):
                        out.append(_Stretch(fragment.path, at + first, count))
                at += group.num_rows
        return out or [_Stretch("", 0, 0)]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        files = _Files(self.path)
        index = ds.dataset(partition.file, filesystem=files.system, format="parquet").to_table(columns=["line_no", "file", "offset", "length"])
        index = index.slice(partition.first, partition.count)
        for batch in index.to_batches(max_chunksize=1000):
            rows = [r for r in zip(*[c.to_pylist() for c in batch.columns], strict=True) if self._may(r[0], r[0])]
            if rows:
                values = files.several([r[1:] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(values, pa.binary())], names=["line_no", "value"])
        files.close()


class OffsetRecords(DataSource):
    """``line_no long, value binary`` of what ``write_records`` wrote to the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "offset_records"

    def schema(self) -> str:
        return "line_no long, value binary"

    def reader(self, schema: StructType) -> OffsetReader:
        return OffsetReader(self.options["path"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records by number; filters on ``line_no`` prune the index and the bytes read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OffsetRecords)
    return spark.read.format("offset_records").option("path", path).load()


def read_ranges(ranges: DataFrame, path: str, file: str = "file", offset: str = "offset", length: str = "length", name: str = "value") -> DataFrame:
    """``ranges`` with ``name``: those bytes of the files of a folder, as for images that lie end to end in one file.

    Rows are dealt by file and stretches of 64 MiB of it, so that neighbours are read in one go.
    """
    placed = ranges.repartition(F.col(file), F.floor(F.col(offset) / (64 << 20))).sortWithinPartitions(file, offset)
    schema = StructType([*ranges.schema.fields]).add(name, "binary")
    at = [ranges.columns.index(c) for c in (file, offset, length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(path)
        for batch in batches:
            values = files.several(list(zip(*[batch.column(i).to_pylist() for i in at], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=schema.fieldNames())
        files.close()

    return placed.mapInArrow(run, schema)
