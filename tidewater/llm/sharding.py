"""Extendible hashing: shards are buckets of a directory indexed by hash-prefix bits.

Only a bucket over its byte limit is split, on the next bit, until every bucket
fits. The splits are computed from a histogram of bytes by hash prefix, one
distributed aggregation per ``step`` bits, of which later ones see only the
buckets that are still too large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the key's hash, then of the row's; past both, rows that are the same in all columns are told apart by position.
WORD_BITS = 60
DEFAULT_LIMIT = 8 << 20


def _bits(c: Column) -> Column:
    """60 hash bits of a string."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the path as a string of 0 and 1."""
    return F.substring("__path", 1, depth)


def directory(sizes: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """(prefix, depth, bytes, n_rows) of the buckets, from ``sizes`` (__path string, __bytes long).

    The buckets' prefixes are disjoint and cover every row. A bucket stays over
    the limit only if one row does, or if rows agree in the whole path.
    """
    facts = sizes.agg(F.sum("__bytes").alias("total"), F.max(F.length("__path")).alias("deepest")).first()
    total, deepest = facts.total or 0, facts.deepest or 0
    reach = min(deepest, max(0, math.ceil(math.log2(total / limit + 1)) + 2)) if total > limit else 0
    left, base, done = sizes.select("__path", "__bytes"), 0, None
    while True:
        leaves = materialize(
            left.groupBy(_prefix(reach).alias("leaf")).agg(F.sum("__bytes").alias("bytes"), F.count("*").alias("n_rows")), "histogram"
        )
        # every ancestor of every leaf, from the last directory's depth down to the leaves'
        nodes = (
            leaves.select(F.explode(F.sequence(F.lit(base), F.lit(reach))).alias("depth"), "leaf", "bytes", "n_rows")
            .groupBy("depth", F.expr("substring(leaf, 1, depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        )
        last = reach >= deepest
        fits = (F.col("bytes") <= limit) | (F.col("n_rows") == 1)
        nodes = materialize(nodes.withColumn("fits", fits | (F.col("depth") == reach) if last else fits), "nodes")
        parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("fits").alias("above_fits"))
        found = (
            nodes.where("fits")
            .withColumn("above", F.expr("substring(prefix, 1, depth - 1)"))
            .join(parent, ["depth", "above"], "left")
            .where("above_fits is null or not above_fits")
            .select("prefix", "depth", "bytes", "n_rows")
        )
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        open_leaves = nodes.where((F.col("depth") == reach) & ~F.col("fits")).select(F.col("prefix").alias("leaf"))
        if open_leaves.isEmpty():
            return done
        left = left.join(open_leaves, _prefix(reach) == open_leaves["leaf"], "left_semi")
        base, reach = reach + 1, min(deepest, reach + step)


def assign_shards(
    df: DataFrame, *, key: list[str], bytes_col: Column, limit: int = DEFAULT_LIMIT, step: int = 6
) -> DataFrame:
    """``df`` with ``shard`` (its bucket's prefix), ``shard_depth``, ``shard_bytes``, ``shard_rows``.

    The path of a row is the hash of its key, then of its whole row, then of its
    position, so that a key of a third of all rows is split too. Null keys hash
    like any value; null or negative sizes count as 0 bytes; an empty table has
    no shards; one row over the limit has a shard of its own; repeated rows are
    spread by position. Input columns with the new names are replaced.
    """
    new = ["shard", "shard_depth", "shard_bytes", "shard_rows"]
    keep = [c for c in df.columns if c not in new]
    text = lambda names: F.to_json(F.struct(*[df[c].cast("string").alias(f"c{i}") for i, c in enumerate(names)]))
    digits = lambda c: F.lpad(F.conv(_bits(c).cast("string"), 10, 2), WORD_BITS, "0")
    path = F.concat(digits(text(key)), digits(text(keep)), digits(F.monotonically_increasing_id().cast("string")))
    rows = materialize(
        df.select(*[df[c] for c in keep], path.alias("__path"), F.greatest(F.coalesce(bytes_col.cast("long"), F.lit(0)), F.lit(0)).alias("__bytes")), "paths"
    )
    table = materialize(directory(rows, limit, step), "directory")
    depths = sorted(r.depth for r in table.select("depth").distinct().collect())  # at most one per bit of the path
    probes = F.array(*[F.substring("__path", 1, d) for d in depths]) if depths else F.array(F.lit(""))
    hits = rows.withColumn("__probe", F.explode(probes)) if len(depths) > 1 else rows.withColumn("__probe", F.element_at(probes, 1))
    named = table.select(
        F.col("prefix").alias("__probe"), F.col("prefix").alias("shard"), F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows")
    )
    return hits.join(named, "__probe").select(*keep, *new)


def write_shards(df: DataFrame, path: str, **options) -> DataFrame:
    """Write ``df`` as one folder of Parquet files per shard; returns (shard, n_rows, bytes).

    Rows are dealt as ``assign_shards`` deals them, with its options and its edge cases (nulls,
    very long and repeated rows); ``shard`` names the folder and replaces a column of that
    name. An empty table writes an empty folder and returns no rows.
    """
    placed = materialize(assign_shards(df, **options), "placed")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.first("shard_bytes").alias("bytes"))


def document_shards(docs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """doc_id, n_bytes and shard of every document, by the hash of its id; sizes are the text's UTF-8 bytes.

    Null and empty texts have 0 bytes, null ids hash like any value, a text over the limit has a
    shard of its own, repeated rows are spread by position; other columns do not pass; no
    documents give no rows.
    """
    narrow = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return assign_shards(narrow, key=["doc_id"], bytes_col=F.col("n_bytes"), limit=limit)


#: The same shards in SQL: a bucket is the shortest prefix of the key's hash whose bytes fit.
ORACLE_SQL = f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5('{{"c0":"' || doc_id || '"}}'), 1, 15))::BIGINT), {WORD_BITS}, '0') AS path FROM documents),
n AS (SELECT d.depth, substr(path, 1, d.depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS n_rows
    FROM h, (SELECT unnest(range(0, 26)) AS depth) d GROUP BY ALL),
f AS (SELECT * FROM n WHERE bytes <= {DEFAULT_LIMIT} OR n_rows = 1)
SELECT doc_id, n_bytes, prefix AS shard, depth::INTEGER AS shard_depth, bytes::BIGINT AS shard_bytes, n_rows AS shard_rows
FROM (SELECT h.doc_id, h.n_bytes, f.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY f.depth) AS k
    FROM h JOIN f ON substr(h.path, 1, f.depth) = f.prefix) WHERE k = 1
"""
