"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of a word stay (A-Z become a-z, bytes of non-ASCII characters stay), all others become a space.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def word_list(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where there is no cluster (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidewater/{name}-{uuid.uuid4().hex}"


class _Written(threading.local):
    """Folders that ``materialize`` has written in this thread and nothing has discarded yet.

    A call remembers how many there are when it begins and discards its own only; calls
    in other threads of the driver have a list of their own.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)


WRITTEN = _Written()

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage ends at replicated files, so a lost executor costs a re-read, not a
    recomputation; the shuffle files of the write are released when it ends.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    WRITTEN.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete what ``materialize`` has written since there were ``since`` folders, but for the tables to keep.

    Only tables that nothing reads any more may go: what was made of them is written itself.
    """
    kept = {getattr(df, "_written_to", None) for df in keep}
    gone = [p for p in WRITTEN.paths[since:] if p not in kept]
    WRITTEN.paths[since:] = [p for p in WRITTEN.paths[since:] if p in kept]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give what a task has freed back to the system; Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches than Spark's default, for whole texts; a value that was set stays."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(rows))


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Add columns computed per Arrow batch.

    ``make()`` runs once per task and returns a function from the input arrays to
    one array for each of ``fields``. An input column that has the name of a new
    column is replaced; all others, whatever their names, pass through.
    """
    bound_batches(df.sparkSession)
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    source = df.select(*[df[c].alias(f"__in{i}") for i, c in enumerate(inputs)], *[df[c] for c in keep])
    n = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(*[batch.column(i) for i in range(n)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n, batch.num_columns)] + made, names=schema.fieldNames()
            )
        del work
        release_memory()

    return source.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """Texts as UTF-8 bytes (None stays None), without decoding them, some at a time."""
    for start in range(0, len(column), 200):
        yield from column.slice(start, 200).cast(pa.large_binary()).to_pylist()


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns c0, c1, …, the new name of ``column``, and what gives their names back and drops others.

    So operators can add columns of any name beside those of the input.
    """
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    return inner, f"c{names.index(column)}", lambda out: out.select(*[out[f"c{i}"].alias(n) for i, n in enumerate(names)])
