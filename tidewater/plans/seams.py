"""Contracts of steps that are bound to a model or to media; stubs are deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_model(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a model over batches: a frame in, a frame of ``schema`` out. Failed tasks are run again by Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield model(frame)

    return df.mapInPandas(run, schema)


def stub_score(df: DataFrame, text: str, name: str = "score") -> DataFrame:
    """A score in [0, 1) from the text's length, where a language model would give one."""
    return df.withColumn(name, F.pmod(F.length(text) * 7919, F.lit(1000)) / 1000.0)


def stub_language(df: DataFrame, text: str) -> DataFrame:
    """(language, language_score) by accented letters, where a classifier would give them."""
    lang = F.when(F.col(text).rlike("[ßüöä]"), "de").when(F.col(text).rlike("[ñó]"), "es").when(F.col(text).rlike("[èêéç]"), "fr").otherwise("en")
    return df.withColumns({"language": lang, "language_score": F.lit(1.0)})


def _length_model(df: DataFrame, name: str, column) -> DataFrame:
    return df.withColumn(name, column(F.length("text").cast("long")))


#: Contracts of the model-bound steps: the column that each adds, its type, and a stub computed from the text's length.
CONTRACTS = {
    "speech": ("words", "array<struct<start double, end double, word string>>", lambda n: F.transform(F.sequence(F.lit(0), F.pmod(n, F.lit(3)).cast("int")), lambda i: F.struct((i * 0.5).cast("double").alias("start"), (i * 0.5 + 0.5).cast("double").alias("end"), F.concat(F.lit("w"), i.cast("string")).alias("word")))),
    "faces": ("boxes", "array<array<double>>", lambda n: F.array(F.array(F.lit(0.0), F.lit(0.0), F.pmod(n, F.lit(100)).cast("double"), F.lit(10.0)))),
    "speaker": ("speaking", "double", lambda n: F.pmod(n * 31, F.lit(200)) / 100.0 - 1.0),
    "yes_probability": ("p_yes", "double", lambda n: F.pmod(n * 17, F.lit(1000)) / 1000.0),
    "token_loss": ("loss", "double", lambda n: F.pmod(n * 13, F.lit(700)) / 100.0),
    "language": ("language_score", "double", lambda n: 1.0 - F.pmod(n, F.lit(40)) / 200.0),
    "rewrite": ("reply", "string", lambda n: F.format_string('```json\n{"result": "%s"}\n```', F.when(n % 2 == 0, "YES").otherwise("NO"))),
    "judge": ("winner", "string", lambda n: F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("tie")),
    "answer": ("pred_answer", "string", lambda n: F.char(F.lit(65) + F.pmod(n, F.lit(4)).cast("int"))),
}


def run_contract(df: DataFrame, name: str, model=None) -> DataFrame:
    """``df`` (with ``text``) with the column of a contract, cast to its type; ``model(df, column)`` replaces the stub."""
    column, kind, stub = CONTRACTS[name]
    out = model(df, column) if model else _length_model(df, column, stub)
    return out.withColumn(column, F.col(column).cast(kind))


#: Named implementations that a caller may replace.
MODELS: dict[str, Callable[..., DataFrame]] = {"score": stub_score, "language": stub_language}


def apply_with_retries(df: DataFrame, key: str, model: Callable[[dict], object], kind: str, *, tries: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(results, failures): ``model`` of each row's dict; a row at which it fails gets another row in its place, up to ``tries`` in all.

    results: key, used (the key of the row that was taken), result of type ``kind``.
    failures: key, tried, used, error of each failed try, so no failing row ends the job;
    keys that are in no result used up their tries. Replacements are drawn by a hash of the key and the try among
    all rows. ``key`` is unique.
    """
    from tidewater.operators.sequences import with_rank
    from tidewater.sources.scratch import written

    fields = df.columns
    ranked = written(with_rank(df, key), "rows")
    total = ranked.count()
    own = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for asked, row in zip(frame["__asked"], frame[fields].to_dict("records"), strict=True):
                try:
                    out.append((asked, row[key], model(row), None))
                except Exception as e:  # the model's own errors are the result here
                    out.append((asked, row[key], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["asked", "used", "result", "error"])

    todo = ranked.withColumn("__asked", F.col(key))
    results = failures = None
    for n in range(1, tries + 1):
        done = written(todo.select("__asked", *fields).mapInPandas(run, f"asked {own}, used {own}, result {kind}, error string"), "try")
        good = done.where("error IS NULL").select(F.col("asked").alias(key), "used", "result")
        bad = done.where("error IS NOT NULL").select(F.col("asked").alias(key), F.lit(n).alias("tried"), "used", "error")
        results = good if results is None else results.unionByName(good)
        failures = bad if failures is None else failures.unionByName(bad)
        left = bad.select(F.col(key).alias("__asked"))
        if left.isEmpty():
            break
        todo = left.withColumn("rank", F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "__asked"), F.lit(total))).join(ranked.select("rank", *fields), "rank")
    return results, failures
