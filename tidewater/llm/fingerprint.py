"""Canonical exact digests, in DataFrame functions only.

A text is normalised (compatibility composition), case-folded and its white space
folded; its fingerprint is 128 bits of xxhash (two independent chains) plus the
number of its canonical form among those of equal hash: texts whose hashes agree
are compared byte by byte, so unequal texts never share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Most hash values that are broadcast when colliding texts are compared; beyond, the join shuffles.
MAX_BROADCAST_HASHES = 500_000
#: Text bytes in a block of neighbouring documents.
BLOCK_BYTES = 4 << 20
#: Most quantiles of the id that the driver holds.
MAX_SPLITS = 64


def canonical(text: Column) -> Column:
    """NFKC, full case folding, runs of white space to one space, trimmed; null as empty."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, r"[\s\x85\p{Z}]+", " "))


def wide_hash(c: Column) -> Column:
    """32 hex digits of two xxhash chains that start from different values."""
    part = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), c)), 16, "0")
    return F.lower(F.concat(part(11), part(7919)))


def _blocks(docs: DataFrame) -> tuple[Column, DataFrame]:
    """Blocks of consecutive ids: an expression of the id, and a table of each block's first id (descending) and the block before it.

    Quantiles cut the ids, equal steps cut the parts between them, so a block
    holds about ``BLOCK_BYTES`` for any distribution of ids; both counts are
    bounded by the parameters, not by the rows.
    """
    facts = docs.agg(
        F.sum(F.octet_length("text")).alias("bytes"),
        F.percentile_approx("doc_id", [i / MAX_SPLITS for i in range(MAX_SPLITS + 1)], 10_000).alias("cuts"),
    ).first()
    cuts = sorted(set(facts.cuts or [0]))
    steps = max(1, min(4096, (facts.bytes or 0) // BLOCK_BYTES // max(1, len(cuts))))

    def tree(lo: int, hi: int) -> Column:  # the number of the part (cuts[k-1], cuts[k]] and the step in it
        if lo == hi:
            if lo == 0 or lo >= len(cuts):
                return F.lit(lo * steps).cast("long")
            low, wide = cuts[lo - 1], cuts[lo] - cuts[lo - 1]
            step = F.floor((F.col("doc_id") - F.lit(low) - 1).cast("double") * (steps / wide))
            return F.lit(lo * steps).cast("long") + F.greatest(F.lit(0), F.least(F.lit(steps - 1), step)).cast("long")
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    block = F.coalesce(F.when(F.col("doc_id").isNotNull(), tree(0, len(cuts))), F.lit(-1).cast("long"))
    # at most (MAX_SPLITS + 2) * 4096 rows
    first = docs.groupBy(block.alias("block")).agg(F.max("doc_id").alias("first_id"))
    order = W.orderBy("block")
    ring = first.select("first_id", F.coalesce(F.lead("block").over(order), F.min("block").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("goes_to"))
    return block, ring


def with_next(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, text, …) with ``next_<c>`` of the next document in descending id for the text and ``carry``.

    After the last comes the first; null ids come last; documents of equal id are
    ordered by their text. One shuffle of the texts: each block also gets the
    first document of the block that follows it.
    """
    block, ring = _blocks(docs)
    ghosts = F.broadcast(ring)
    placed = docs.withColumn("__block", block).join(ghosts, docs["doc_id"].eqNullSafe(ghosts["first_id"]), "left")
    copies = F.when(F.col("goes_to").isNull(), F.array(F.struct(F.col("__block").alias("b"), F.lit(0).alias("ghost")))).otherwise(
        F.array(
            F.struct(F.col("__block").alias("b"), F.lit(0).alias("ghost")),
            F.struct(F.col("goes_to").alias("b"), F.lit(1).alias("ghost")),
        )
    )
    columns = docs.columns
    spread = placed.select(*[docs[c] for c in columns], F.explode(copies).alias("__at")).select(*columns, "__at.b", "__at.ghost")
    order = W.partitionBy("b").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    out = spread.select(
        *columns, "ghost", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *carry)]
    )
    return out.where("ghost = 0").drop("ghost")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """The rows op5 asks for, with fingerprints of each text and its edited text.

    Null texts are empty; empty texts share one fingerprint; likeness is 1 for
    equal fingerprints and 0 otherwise, as for any exact digest. Ids are numbers;
    null ids come last, rows of equal id are ordered by their text, so repeated rows
    follow each other; texts may be of any length; other columns do not pass; an
    empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("hash", wide_hash(canonical(F.col("text"))))
    pairs = with_next(hashed, "hash").withColumn("changed", edited(F.col("text"), F.col("next_text")))
    wide = materialize(
        pairs.select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("changed", 256).alias("edited_sha256"),
            "hash",
            "next_hash",
            wide_hash(canonical(F.col("changed"))).alias("edited_hash"),
            "changed",
        ),
        "digests",
    )
    narrow = wide.drop("changed")
    shared = materialize(narrow.select(F.explode(F.array("hash", "edited_hash")).alias("hash")).groupBy("hash").count().where("count > 1").select("hash"), "hashes")
    # only texts whose hash another has are made canonical again, to compare their bytes
    few = shared.count() <= MAX_BROADCAST_HASHES
    ids = materialize(narrow.join(F.broadcast(shared) if few else shared, "hash", "left_semi").select(F.col("doc_id").alias("__id")).distinct(), "ids")
    listed = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_HASHES else ids
    again = rows.join(listed, rows["doc_id"].eqNullSafe(listed["__id"]), "left_semi")
    forms = again.select(wide_hash(canonical(F.col("text"))).alias("hash"), F.col("text").alias("form"))
    unlike = different_forms(forms.unionByName(wide.select(F.col("edited_hash").alias("hash"), F.col("changed").alias("form"))), shared)
    if unlike.isEmpty():
        name = {c: F.col(c) for c in ("hash", "next_hash", "edited_hash")}
    else:  # a collision of the 128 bits: the digest of the form tells its texts apart
        narrow, name = _told_apart(pairs, unlike)
    return narrow.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        name["hash"].alias("fingerprint"),
        name["edited_hash"].alias("edited_fingerprint"),
        F.when(name["hash"] == name["edited_hash"], 1.0).otherwise(0.0).alias("near_edited"),
        F.when(name["hash"] == name["next_hash"], 1.0).otherwise(0.0).alias("near_next"),
    )


def different_forms(forms: DataFrame, shared: DataFrame) -> DataFrame:
    """Hashes of ``shared`` whose canonical forms are not all the same bytes.

    forms: (hash, form); minimum and maximum are taken in the tasks before the
    shuffle, so a hash that a third of the rows share moves one pair per task.
    """
    few = shared.count() <= MAX_BROADCAST_HASHES
    kept = forms.join(F.broadcast(shared) if few else shared, "hash")
    return (
        kept.select("hash", canonical(F.col("form")).alias("form"))
        .groupBy("hash")
        .agg(F.min("form").alias("least"), F.max("form").alias("most"))
        .where("least <> most")
        .select("hash")
    )


def _told_apart(pairs: DataFrame, unlike: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    bad = [r.hash for r in unlike.toLocalIterator()]
    mark = lambda h, form: F.when(h.isin(bad), F.concat(h, F.lit("-"), F.sha2(canonical(form), 512))).otherwise(h)
    narrow = pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("changed", 256).alias("edited_sha256"),
        mark(F.col("hash"), F.col("text")).alias("hash"),
        mark(F.col("next_hash"), F.col("next_text")).alias("next_hash"),
        mark(wide_hash(canonical(F.col("changed"))), F.col("changed")).alias("edited_hash"),
    )
    return narrow, {c: F.col(c) for c in ("hash", "next_hash", "edited_hash")}


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` (any columns, any row count per text) with ``fingerprint``; null texts count as empty."""
    keep = [c for c in docs.columns if c != "fingerprint"]
    rows = docs.select(*[docs[c] for c in keep], wide_hash(canonical(docs[text_col])).alias("fingerprint"))
    shared = rows.groupBy(F.col("fingerprint").alias("hash")).count().where("count > 1").select("hash")
    forms = rows.select(F.col("fingerprint").alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("form"))
    unlike = [r.hash for r in different_forms(forms, materialize(shared, "hashes")).toLocalIterator()]
    if not unlike:
        return rows
    form = F.sha2(canonical(F.col(text_col)), 512)
    return rows.withColumn("fingerprint", F.when(F.col("fingerprint").isin(unlike), F.concat("fingerprint", F.lit("-"), form)).otherwise(F.col("fingerprint")))


def exact_groups(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(fingerprint, n_docs, first_id) of each group of equal canonical texts."""
    return fingerprints(docs.select(id_col, text_col), text_col=text_col).groupBy("fingerprint").agg(
        F.count("*").alias("n_docs"), F.min(id_col).alias("first_id")
    )
