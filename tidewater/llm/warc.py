"""WARC archives written and read by Spark, with boundary-chain verification.

A reader's tasks cut their file splits at every ``WARC/1.`` they meet, in headers
or in payloads, and emit each as a candidate with the offset of its successor
(where its Content-Length says the next record starts). Pointer jumping from the
start of the file keeps the candidates on the chain of records; what only looks
like a record inside a payload is never reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shared_path

MAGIC = "WARC/1."
#: Most groups of equal payloads that are broadcast to the writers; beyond, payloads are shuffled to their group.
MAX_BROADCAST_GROUPS = 500_000
_CRLF = "\r\n"


def sha1_base32(c: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's or binary's bytes."""
    return _base32(F.sha1(c))


def _base32(digits: Column) -> Column:
    part = lambda k: F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(k) for k in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(
    records: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_min_bytes: int = 0
) -> None:
    """Write one record per row to the archives (``*.txt``, uncompressed WARC 1.1) of the folder ``path``.

    Of rows with equal payloads of ``revisit_min_bytes`` or more, that with the
    largest id is a response and the others are revisits without a body. Null
    payloads are empty, null ids are written empty and come after all ids; of
    repeated rows with the largest id one is the response. Line breaks and the
    magic are percent-encoded in urls and ids, and so is ``%`` in ids, which
    ``read_warc`` decodes. Other columns are not written.
    """
    rows = records.select(
        records[id_col].cast("string").alias("id"),
        records[id_col].alias("rank"),
        F.coalesce(records[url_col], F.lit("")).alias("url"),
        F.coalesce(records[payload_col], F.lit("")).alias("payload"),
    ).withColumns({"size": F.octet_length("payload").cast("long"), "sha": F.sha1(F.col("payload"))})
    # rows are evaluated twice, so they are told apart by content: an order of evaluation would not be the same again
    alike = rows.where(F.col("size") >= revisit_min_bytes).groupBy("sha", "size", "rank", "id", "url").agg(F.count("*").alias("n"))
    first = F.max(F.struct(F.col("rank").isNotNull().alias("known"), "rank", "url", "id", "n"))
    again = alike.groupBy("sha", "size").agg(F.sum("n").alias("n"), first.alias("first")).where("n > 1")
    again = again.select(F.col("sha").alias("again"), F.col("size").alias("again_size"), F.col("first.rank").alias("first_rank"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.n").alias("times"))
    again = materialize(again, "groups")
    few = again.count() <= MAX_BROADCAST_GROUPS
    joined = rows.join(F.broadcast(again) if few else again, (rows["sha"] == again["again"]) & (rows["size"] == again["again_size"]), "left")
    chosen = F.col("rank").eqNullSafe(F.col("first_rank")) & (F.col("url") == F.col("first_url"))
    joined = joined.withColumn("revisit", F.col("again").isNotNull() & ~F.coalesce(chosen, F.lit(False)))
    if not again.where("times > 1").isEmpty():
        # of rows that are equal in all that is written, one is the response
        equal = ~F.col("revisit") & (F.coalesce("times", F.lit(0)) > 1)
        one = joined.where(equal).groupBy("sha", "size").agg(*[F.first(c).alias(c) for c in joined.columns if c not in ("sha", "size")])
        copies = one.withColumn("revisit", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: i > 1)))
        joined = joined.where(~equal).unionByName(copies)
    revisit = F.col("revisit")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), _one_line(F.replace(F.coalesce(c, F.lit("")), F.lit("%"), F.lit("%25"))), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{_CRLF}{name}: "), value)
    text = F.concat(
        F.lit(f"{MAGIC}1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha")))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("first_id")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(_CRLF * 2),
        body,
    )
    joined.select(text.alias("value")).write.option("lineSep", _CRLF * 2).text(path)


def _one_line(c: Column) -> Column:
    """A header's value without line breaks and without the magic, at which readers cut."""
    for old, new in (("\r", "%0D"), ("\n", "%0A"), (MAGIC, MAGIC.replace("/", "%2F"))):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _page(header: str) -> Column:
    """The id that a header's urn holds."""
    c = F.regexp_extract(F.coalesce(_header(header), F.lit("")), r"^<urn:page:(.*)>$", 1)
    for old, new in (("%2F", "/"), ("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _header(name: str) -> Column:
    """A header's value; null if it is absent."""
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between one ``WARC/1.`` and the next: (file, block, pos, seg); ``pos`` ascends within a block."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            F.col("value").cast("binary").alias("seg"),
        )
    )


#: What tells a segment's bytes, wherever a later read of the archives cuts its splits.
_SEG_KEY = {"seg1": "xxhash64(seg)", "seg2": "xxhash64(1, seg)"}


def candidates(parts: DataFrame) -> DataFrame:
    """(file, offset, length, successor, …) of each segment; ``offset`` is where its magic starts, ``length`` its bytes after the magic."""
    own = (
        parts.withColumn("text", F.col("seg").cast("string"))
        .withColumn("head", F.substring_index("text", _CRLF * 2, 1))
        .withColumn("head_bytes", F.when(F.octet_length("head") < F.length("seg"), F.octet_length("head") + 4))
    )
    content = F.when(F.length(_header("Content-Length")) <= 18, F.regexp_extract(_header("Content-Length"), r"^\d+$", 0))
    content = F.when(content != "", content.cast("long"))
    body = F.expr("substring(seg, head_bytes + 1, cast(content as int))")
    narrow = own.withColumn("content", content).select(
        "file",
        "block",
        "pos",
        F.length("seg").cast("long").alias("length"),
        *[F.expr(k).alias(n) for n, k in _SEG_KEY.items()],
        (F.lit(len(MAGIC) + 4) + F.col("head_bytes") + F.col("content")).alias("skip"),
        "head_bytes",
        "content",
        _page("WARC-Record-ID").alias("id"),
        F.lower(_header("WARC-Type")).alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        _header("WARC-Payload-Length").try_cast("long").alias("stated_bytes"),
        F.when(F.length("seg") == F.col("head_bytes") + F.col("content") + 4, sha1_base32(body)).alias("digest"),
    )
    found = materialize(narrow, "candidates")
    inner = W.partitionBy("file", "block").orderBy("pos")
    local = found.withColumn("local", F.sum(F.col("length") + len(MAGIC)).over(inner) - F.col("length") - len(MAGIC))
    # a split's first segment starts where the segments of the splits before it end
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("length") + len(MAGIC)).alias("sum"))
    order = W.partitionBy("file").orderBy("block")
    starts = blocks.withColumn("start", F.sum("sum").over(order) - F.col("sum")).drop("sum")
    offset = F.col("start") + F.col("local") - len(MAGIC)  # the file's first segment precedes its first magic
    return local.join(starts, ["file", "block"]).withColumn("offset", offset).withColumn("successor", F.col("offset") + F.col("skip")).drop("skip", "local", "start")


def reachable(found: DataFrame) -> DataFrame:
    """Rows of ``found`` (file, block, offset, length, successor, …) on the chain that starts at offset 0 of each file.

    Stretches of a split in which each candidate's successor is the next one are
    contracted first; pointers jump between stretches, twice as far each round. A
    chain that does not end where its file does is an error: records would be lost.
    """
    inner = W.partitionBy("file", "block").orderBy("offset")
    linked = F.lag("successor").over(inner).eqNullSafe(F.col("offset"))
    runs = found.withColumn("breaks", F.when(linked, 0).otherwise(1)).withColumn("run", F.sum("breaks").over(inner))
    runs = materialize(runs.drop("breaks"), "runs")
    exits = runs.groupBy("file", "block", "run").agg(F.max_by("successor", "offset").alias("exit"))
    targets = runs.select("file", F.col("offset").alias("exit"), F.struct("block", "run").alias("to"))
    jump = materialize(
        exits.join(targets, ["file", "exit"]).select("file", F.struct("block", "run").alias("at"), "to", F.col("exit").alias("entry")), "jumps"
    )
    # (stretch, entry): the chain enters a stretch once and leaves it at its end
    seen = runs.where("offset = 0").select("file", F.struct("block", "run").alias("at"), F.lit(0).cast("long").alias("entry"))
    n = -1
    while True:
        step = seen.select("file", "at").join(jump, ["file", "at"]).select("file", F.col("to").alias("at"), "entry")
        seen = materialize(seen.unionByName(step).distinct(), "seen")
        now = seen.count()
        if now == n:
            break
        n = now
        a, b = jump.alias("a"), jump.alias("b")
        jump = materialize(
            a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at"))).select("a.file", "a.at", "b.to", "b.entry"), "jumps"
        )
        if jump.isEmpty():
            break
    entries = seen.select("file", "at.block", "at.run", "entry")
    ends = runs.groupBy("file").agg(F.max(F.col("offset") + F.col("length") + len(MAGIC)).alias("end"))
    reached = exits.join(entries, ["file", "block", "run"]).groupBy("file").agg(F.max("exit").alias("reached"))
    if broken := ends.join(reached, "file", "left").where("not end <=> reached").limit(3).collect():
        raise ValueError("the chain of records breaks off: " + ", ".join(f"{r.file} at {r.reached} of {r.end} bytes" for r in broken))
    return runs.join(entries, ["file", "block", "run"]).where("offset >= entry").drop("entry", "run")


def _owned(found: DataFrame, records: DataFrame) -> DataFrame:
    """(file, at, piece, …) of each segment: ``at`` is the record it lies in, the last that starts at or before ``piece``.

    A running maximum within each split, and over the splits before it.
    """
    starts = records.select("file", "offset", F.col("offset").alias("start"))
    marked = found.select("file", "block", "offset", *_SEG_KEY).join(starts, ["file", "offset"], "left")
    last = marked.groupBy("file", "block").agg(F.max("start").alias("last"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("file", "block", F.max("last").over(earlier).alias("before"))
    own = F.max("start").over(W.partitionBy("file", "block").orderBy("offset"))
    return marked.withColumn("own", own).join(last, ["file", "block"]).select("file", F.coalesce("own", "before").alias("at"), F.col("offset").alias("piece"), *_SEG_KEY)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, id, record_type, refers_to, payload_bytes, payload_digest) of each record on the chain.

    A response's size and digest are taken from the payload that was read, also
    where it holds ``WARC/1.``; a revisit's are those it states. An empty folder
    gives no rows.
    """
    parts = segments(spark, path)
    found = candidates(parts)
    records = materialize(reachable(found), "records")
    split = records.where("digest is null and content is not null and head_bytes is not null")
    if split.isEmpty():
        whole = records
    else:
        # a payload that holds the magic lies in several segments: those from its record's start to its successor
        spans = split.select("file", F.col("offset").alias("at"), "head_bytes", "content")
        keyed = _owned(found, records).join(spans.select("file", "at"), ["file", "at"])
        keyed = materialize(keyed, "pieces")
        needed = keyed.select(*_SEG_KEY).distinct()
        texts = parts.withColumns({n: F.expr(k) for n, k in _SEG_KEY.items()}).join(needed, list(_SEG_KEY), "left_semi").groupBy(*_SEG_KEY).agg(F.first("seg").alias("seg"))
        data = keyed.join(texts, list(_SEG_KEY)).groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("piece", "seg"))).alias("segs"))
        glued = F.aggregate("segs", F.lit(b""), lambda a, x: F.concat(a, F.when(F.length(a) > 0, F.lit(MAGIC.encode())).otherwise(F.lit(b"")), x["seg"]))
        fixed = (
            data.join(spans, ["file", "at"])
            .withColumn("glued", glued)
            .select("file", F.col("at").alias("offset"), sha1_base32(F.expr("substring(glued, head_bytes + 1, cast(content as int))")).alias("glued_digest"))
        )
        whole = records.join(fixed, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "glued_digest"))
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "file",
        "offset",
        "id",
        "record_type",
        F.when(revisit & (F.col("refers_to") != ""), F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.coalesce("stated_bytes", "content")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("stated_digest", "digest")).otherwise(F.col("digest")).alias("payload_digest"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html, others ignored) to archives in the shared folder and read them back, a row per page.

    Null html is an empty payload, a null url an empty one, a null page_id stays
    null and is never the largest; of repeated rows one is the response. Payloads
    may be of any length and hold the magic; no pages give no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select(
        F.col("id").try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )


#: The same rows without archives; base32 digits of the digest are taken from five bits each.
ORACLE_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g"""
