"""URL rules by hashed expressions, in DataFrame operations only.

A rule names a host and the start of a path; it fits that host, its subdomains, and every path that starts so.
Each URL is expanded into the host suffixes and path prefixes that some rule could name, the expressions meet
the rules on a short prefix of their digests, full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join uses; the rest is compared afterwards.
PREFIX_DIGITS = 8

#: (host, start of the path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("#"), path).cast("binary"), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """rules as a table: rule_host, rule_path, rule_verdict."""
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules]
    if not rows:
        return spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string")
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    No rule fits: rule is null and the verdict is default. A URL that is null or has no ``://`` has an empty host
    and path and fits no rule. Of the rules that fit, the one with the most characters wins, then the one with the
    longer host, then ``block``. Rows that repeat an id and URL get equal answers. Other columns are ignored,
    whatever their names. An empty rule table gives every page the default.

    What is expanded depends on the rules alone: the distinct pairs of their label counts and path lengths. That
    is exact and stays small, so long hosts or paths do not multiply rows. Matches, not expressions, are grouped
    by page, so a hot host or rule never meets in one task; a rule table under Spark's broadcast threshold is
    broadcast by its known size, a larger one is joined by shuffle.
    """
    rules = rules.where(F.col("rule_host").isNotNull() & (F.col("rule_host") != "")).select(
        F.translate("rule_host", UPPER, LOWER).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "rule_verdict"
    )
    shapes = rules.select(_labels(F.col("rule_host")).alias("n"), F.length("rule_path").alias("m")).distinct().collect()
    keyed = rules.select(
        "*", _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"), F.concat("rule_host", "rule_path").alias("rule")
    ).withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))

    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    parsed = urls.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return parsed.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    host, path = F.col("host"), F.col("path")
    expressions = [
        F.when((host != "") & (_labels(host) >= r.n) & (F.length(path) >= r.m), _digest(F.substring_index(host, ".", -r.n), F.substring(path, 1, r.m)))
        for r in sorted(shapes)
    ]
    exploded = parsed.select("id", "url", F.explode(F.array_compact(F.array(*expressions))).alias("digest")).withColumn(
        "short", F.substring("digest", 1, PREFIX_DIGITS)
    )
    order = F.struct(
        F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict"
    )
    best = (
        exploded.join(keyed, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("id", "url")
        .agg(F.max(order).alias("best"))
        .select(F.col("id").alias("best_id"), F.col("url").alias("best_url"), "best")
    )
    return parsed.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("url") == F.col("best_url")), "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
