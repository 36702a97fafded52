"""URL filters by host suffix and path prefix, in DataFrame functions only.

Each URL is expanded into expressions (host suffix, path prefix), one for each shape that
rules have (labels of the host, length of the path); they meet the rules in an equi-join
on a short prefix of their SHA-256 digest, and a join hit counts only if the full digest
agrees. The longest rule that fits wins. With few shapes the rows are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Rules of the registered query: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_RULE_SCHEMA = "verdict string, host string, path string"
#: Digest digits that the join compares first.
SHORT = 8
#: Most rules that are broadcast; larger lists are joined through a shuffle.
MAX_BROADCAST_RULES = 200_000
#: Most shapes of rules (labels of the host, length of the path) for which a row keeps its expressions; beyond, each is a row.
MAX_SHAPES = 24


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # a host holds no slash, so host and path can be told apart in their concatenation
    return F.sha2(F.concat(host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` (any columns) with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule (host and path together, then the host, then ``allow``)
    wins; without one the verdict is ``default`` and the rule null. Null urls and
    urls without ``://`` have an empty host, which no rule fits. Input columns
    with the new names are replaced. Repeated rows get a row each.
    """
    new = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c not in new]
    rules = rules.where("host <> '' and host is not null").select(
        F.substring(_digest(F.col("host"), F.coalesce("path", F.lit(""))), 1, SHORT).alias("short"),
        _digest(F.col("host"), F.coalesce("path", F.lit(""))).alias("digest"),
        F.struct(
            (F.length("host") + F.length(F.coalesce("path", F.lit("")))).alias("size"),
            F.length("host").alias("host_size"),
            F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allows"),
            F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"),
            "verdict",
        ).alias("hit"),
        F.length(F.coalesce("path", F.lit(""))).alias("path_size"),
        F.size(F.split("host", r"\.")).alias("labels"),
    )
    shapes = sorted((r.labels, r.path_size) for r in rules.select("labels", "path_size").distinct().limit(MAX_SHAPES + 1).collect())
    n_rules = rules.limit(MAX_BROADCAST_RULES + 1).count()
    # a short prefix names a few rules: their digests tell which one it is
    known = rules.groupBy("labels", "path_size", "short").agg(F.collect_list(F.struct("digest", "hit")).alias("named"))
    apart = pages.select(F.struct(*[pages[c] for c in keep]).alias("__row"), url_host(pages[url_col]).alias("__host"), url_path(pages[url_col]).alias("__path"))
    if len(shapes) <= MAX_SHAPES and n_rules <= MAX_BROADCAST_RULES:
        best = _beside(apart, known, shapes)
    else:
        best = _apart(apart, known, n_rules)
    return best.select(
        *[F.col("__row")[c].alias(c) for c in keep],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__hit.rule").alias("rule"),
        F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"),
    )


def _suffix(labels: Column) -> Column:
    return F.call_function("substring_index", F.col("__host"), F.lit("."), -labels)


def _confirmed(digest: Column, named: Column) -> Column:
    """The rule among those of a short prefix whose whole digest agrees; of equal expressions the one that wins."""
    return F.array_max(F.transform(F.filter(named, lambda x: x["digest"] == digest), lambda x: x["hit"]))


def _beside(rows: DataFrame, known: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """A broadcast join for each shape of rules; rows stay where they are, one each."""
    hits = []
    for k, (labels, size) in enumerate(shapes):
        fits = (F.size(F.split("__host", r"\.")) >= labels) & (F.length("__path") >= size) & (F.col("__host") != "")
        cell = F.when(fits, _digest(_suffix(F.lit(labels)), F.substr("__path", F.lit(1), F.lit(size))))
        own = known.where((F.col("labels") == labels) & (F.col("path_size") == size)).select(F.col("short").alias(f"__short{k}"), F.col("named").alias(f"__named{k}"))
        rows = rows.withColumn(f"__digest{k}", cell).join(F.broadcast(own), F.substring(f"__digest{k}", 1, SHORT) == F.col(f"__short{k}"), "left")
        hits.append(_confirmed(F.col(f"__digest{k}"), F.col(f"__named{k}")))
    none = F.lit(None).cast(known.schema["named"].dataType.elementType["hit"].dataType)
    best = F.array_max(F.array_compact(F.array(*hits, none))) if hits else none
    return rows.select("__row", "__host", "__path", best.alias("__hit"))


def _apart(rows: DataFrame, known: DataFrame, n_rules: int) -> DataFrame:
    """A row for each expression of a url; rows are numbered in a written table, so numbers do not change if a task runs again."""
    numbered = materialize(rows.withColumn("__id", F.monotonically_increasing_id()), "urls")
    facts = known.agg(F.collect_set("path_size").alias("sizes"), F.max("labels").alias("labels")).first()
    sizes = F.filter(F.array(*[F.lit(n) for n in sorted(facts.sizes)]).cast("array<int>"), lambda n: n <= F.length("__path"))  # as many as lengths of paths
    labels = F.sequence(F.lit(1), F.least(F.size(F.split("__host", r"\.")), F.lit(facts.labels or 1)))
    cells = F.flatten(F.transform(labels, lambda i: F.transform(sizes, lambda n: F.struct(i.alias("labels"), n.alias("size")))))
    each = numbered.where("__host <> ''").select("__id", "__host", "__path", F.explode(cells).alias("c"))
    each = each.select("__id", F.col("c.labels").alias("labels"), F.col("c.size").alias("path_size"), _digest(_suffix(F.col("c.labels")), F.substr("__path", F.lit(1), F.col("c.size"))).alias("__digest"))
    each = each.withColumn("short", F.substring("__digest", 1, SHORT))
    met = each.join(F.broadcast(known) if n_rules <= MAX_BROADCAST_RULES else known, ["labels", "path_size", "short"])
    hits = met.select("__id", _confirmed(F.col("__digest"), F.col("named")).alias("__hit")).where("__hit IS NOT NULL")
    return numbered.join(hits.groupBy("__id").agg(F.max("__hit").alias("__hit")), "__id", "left")


def production_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, _RULE_SCHEMA)


ORACLE_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
  ('block','example.net','/de/8'), ('block','org','/es/')),
p AS (SELECT page_id, row_number() OVER () AS rid,
  translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.rid, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host || r.path) DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.rid = m.rid AND m.k = 1
"""
