"""JSON, JSONL, CSV, subtitle and Parquet sources; indexed and resumable sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators.joins import pending


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files that hold one JSON array (or one object)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, *, skip_bad: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST").json(path)


#: An array of numbers: a line of these characters without what breaks the array. A repeated group would recurse once per entry and overflow the stack.
_OFFSETS, _BROKEN = r"^\s*\[\s*\d[\d\s,]*\]\s*$", r"\d\s+\d|,\s*[,\]]"


def without_index_line(lines: DataFrame) -> DataFrame:
    """Text lines (value, file) without each file's line of offsets: an array that begins with 0 and has an entry for each other line.

    Other lines that are arrays of numbers stay. Only files with such lines are counted.
    """
    entries = F.from_json("value", "array<long>")
    marked = lines.withColumn("__n", F.when(F.col("value").rlike(_OFFSETS) & ~F.col("value").rlike(_BROKEN) & (F.get(entries, F.lit(0)) == 0), F.size(entries)))
    sizes = lines.groupBy("file").agg((F.count("*") - 1).alias("__others"))
    index = marked.where("__n IS NOT NULL").join(sizes, "file").where("__n = __others").select("file", F.col("value").alias("__index")).distinct()
    found = F.col("index_of") == F.col("file")
    index = index.select(F.col("file").alias("index_of"), "__index")
    return marked.join(index, found & F.col("__n").isNotNull() & (F.col("value") == F.col("__index")), "left_anti").drop("__n")


def read_jsonl_indexed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL whose last line may be the offsets of the others, which is left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return without_index_line(lines).select(F.from_json("value", schema).alias("x")).select("x.*")


def read_jsonl_double(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are JSON objects, or JSON strings that hold one."""
    inner = F.when(F.col("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")).otherwise(F.col("value"))
    return spark.read.text(path).select(F.from_json(inner, schema).alias("x")).select("x.*")


def read_dict_of_dicts(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """One object of groups of named records: (grp, name, fields …)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, map<string, {value_schema}>>").alias("m"))
    return whole.select(F.explode("m").alias("grp", "inner")).select("grp", F.explode("inner").alias("name", "x")).select("grp", "name", "x.*")


def read_by_extension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """.jsonl line by line, .json whole (an array, or an object whose values are the records), .parquet and .csv by their readers.

    Bad lines are left out, and so is a last line of offsets.
    """
    if path.endswith(".jsonl"):
        return read_jsonl_indexed(spark, path, schema).dropna("all")
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        record = f"struct<{schema}>" if not schema.startswith("struct") else schema
        rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{record}>")).otherwise(F.map_values(F.from_json("value", f"map<string, {record}>")))
        return text.select(F.explode(rows).alias("x")).select("x.*")
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)


def parse_list(c: str):
    """A Python list literal of strings; null if it is none."""
    return F.from_json(F.translate(F.col(c), "'", '"'), "array<string>")


def read_folder(spark: SparkSession, path: str, schema: str, suffix: str = ".json") -> DataFrame:
    """JSON files of a folder with ``split``, the file name without its suffix (``mix`` is called interleave); broken files are left out."""
    own = spark.read.schema(f"{schema}, _corrupt_record string").options(multiLine=True, pathGlobFilter=f"*{suffix}").json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), F.lit(suffix.replace(".", r"\.") + "$"), F.lit(""))
    return own.withColumn("split", F.when(name.startswith("mix"), "interleave").otherwise(name)).where("_corrupt_record is null").drop("_corrupt_record")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of .srt files, numbers and times left out."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.srt$", "").alias("name"), "value")
    text = F.regexp_replace("value", r"(?m)^\d+\r?\n[\d:,]+ --> [\d:,]+\r?\n", "")
    return raw.select("name", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def existing_only(df: DataFrame, listing: DataFrame, column: str) -> DataFrame:
    return df.join(listing.select(column).distinct(), column, "left_semi")


#: Bytes of lines that go to one file of records: an array is read as one row, and a task holds the offsets of a file.
FILE_BYTES = 16 << 20


def _in_files(df: DataFrame, files: int) -> DataFrame:
    """Records as JSON, in ``files`` parts; in more if these would exceed ``FILE_BYTES``."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    size = lines.agg(F.sum(F.octet_length("value").cast("long") + 1)).first()[0] or 0
    return lines.repartition(max(files, -(-size // FILE_BYTES)))


def write_json_arrays(df: DataFrame, path: str, files: int = 1) -> None:
    """Files that each hold one JSON array of records, ``files`` of them or as many as ``FILE_BYTES`` asks for."""

    def framed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in frames:
            lines = []
            for value in batch.column(0).to_pylist():
                lines.append(lead + value)
                lead = ","
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    _in_files(df, files).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_jsonl_indexed(df: DataFrame, path: str, files: int = 1) -> None:
    """JSONL files whose last line has the offset of each record, in characters; ``files`` of them or as many as ``FILE_BYTES`` asks for."""

    def with_offsets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, at = [], 0
        for batch in frames:
            for value in batch.column(0).to_pylist():
                offsets.append(at)
                at += len(value) + 1
            yield batch
        if offsets:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(offsets)])], names=["value"])

    _in_files(df, files).mapInArrow(with_offsets, "value string").write.mode("overwrite").text(path)


def write_named(df: DataFrame, path: str, name: str, value: str) -> DataFrame:
    """Write ``value`` of each row to the file ``name`` of the folder, in tasks; (name, size) of what was written. A row that is written again replaces its file."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        for batch in frames:
            names, sizes = batch.column(0).to_pylist(), []
            for n, v in zip(names, batch.column(1).to_pylist(), strict=True):
                data = (v or "").encode()
                with system.open_output_stream(f"{folder}/{n}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "size"])

    return df.select(F.col(name).cast("string"), F.col(value).cast("string")).mapInArrow(run, "name string, size long")


def write_jsonl(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).json(path)


def write_pending(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key is not in ``path`` yet; returns how many. A stopped run goes on where it was."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).parquet(path)
        todo = pending(df, done, keys)
    except Exception as e:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = df
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n


def write_shards(df: DataFrame, path: str, **constants) -> None:
    """CSV with constant columns appended, one folder for each of their values."""
    df.withColumns({k: F.lit(v) for k, v in constants.items()}).write.mode("append").partitionBy(*constants).options(header=True, escape='"').csv(path)


def merge_shards(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_jsonl_seeks(df: DataFrame, path: str, order: str) -> None:
    """One JSON line per row with its ``line_no`` and ``seek`` (characters of the lines before it), in Parquet files cut by ranges of the line number."""
    from tidewater.operators.sequences import with_rank

    lines = with_rank(df.select(F.col(order).alias("__order"), F.to_json(F.struct(*df.columns)).alias("value")), "__order")
    lines = lines.select(F.col("rank").alias("line_no"), "value", (F.length("value") + 1).alias("size"))
    # offsets add up inside ranges of lines, then over the ranges before them
    grp = F.floor(F.col("line_no") / 10_000)
    inner = W.partitionBy("grp").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    sums = lines.groupBy(grp.alias("grp")).agg(F.sum("size").alias("sum"))
    base = sums.select("grp", (F.sum("sum").over(W.orderBy("grp")) - F.col("sum")).alias("base"))  # a row per 10,000 lines
    placed = lines.withColumn("grp", grp).withColumn("own", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, "grp")
    placed.select("line_no", (F.col("base") + F.col("own")).alias("seek"), "value").repartitionByRange("line_no").sortWithinPartitions("line_no").write.mode("overwrite").parquet(path)


def read_line(spark: SparkSession, path: str, line_no: int, schema: str) -> DataFrame:
    """The record of one line; the filter on its number prunes files and row groups."""
    return spark.read.parquet(path).where(F.col("line_no") == line_no).select(F.from_json("value", schema).alias("x")).select("x.*")


def byte_slices(df: DataFrame, data: str, start: str, length: str) -> DataFrame:
    """``df`` with ``slice``: the bytes of ``data`` from ``start`` (from 0) on, as many as ``length`` says; pieces of concatenated files."""
    return df.withColumn("slice", F.expr(f"substring(cast({data} as binary), cast({start} + 1 as int), cast({length} as int))"))


def frames_between(frames: DataFrame, keys: list[str], at: str, start: float | None, end: float | None) -> DataFrame:
    """Frames of a time range, both ends included; a start of 0 or none and an end of none are the stream's own. Filters on ``at`` reach the scan."""
    own = frames.where(F.col(at) >= start) if start else frames
    return own.where(F.col(at) <= end) if end is not None else own


def check_sources(df: DataFrame, keys: list[str], frame: str, at: str, noise, most: int = 10) -> DataFrame:
    """Per source whether ``most`` frames, drawn by ``noise``, can be read (no null time), its frames per unit of time and its duration."""
    drawn = df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(noise, frame)))
    span = F.max(at) - F.min(at)
    return drawn.groupBy(*keys).agg(F.min((F.col("__n") > most) | F.col(at).isNotNull()).alias("ok"), F.try_divide(F.count("*") - 1, span).alias("fps"), span.alias("duration"))


def write_metrics(metrics: DataFrame, detail: DataFrame, path: str) -> None:
    """A report: metrics as JSON, details as JSON and as CSV with a header."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    detail.write.mode("overwrite").json(f"{path}/detail")
    detail.write.mode("overwrite").options(header=True, escape='"').csv(f"{path}/detail_csv")


def write_every(df: DataFrame, path: str, order: str, n: int) -> int:
    """Write parts of n rows in ``order``, one folder each; parts that are there are not written again. Returns how many were written."""
    from tidewater.operators.sequences import with_rank

    spark = df.sparkSession
    parts = with_rank(df, order).withColumn("part", F.floor(F.col("rank") / n)).drop("rank", "total")
    try:
        done = spark.read.parquet(path).select("part").distinct()
        parts = parts.join(F.broadcast(done) if done.count() <= 100_000 else done, "part", "left_anti")
    except Exception as e:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    written = parts.select("part").distinct().count()
    if written:
        parts.repartition("part").write.mode("append").partitionBy("part").parquet(path)
    return written
