"""URL filter lists as a hash-prefix join, in DataFrame functions only.

Each URL becomes the list of its host-suffix and path-prefix expressions, as a rule list would write them. Rules and
expressions meet in an equi-join on a short prefix of their SHA-256 digest; full digests confirm, and the longest rule
wins. Distinct (host, path) pairs are expanded, not rows, so a URL that fills a third of the table costs one expansion.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict.
Rules with a null host, path or action are ignored; repeated rules count once; when two rules of one (host, path)
disagree, block wins. Other columns of either table are not looked at; the row key and all rows are kept, repeated
ones too. An empty rule table gives every page the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that the join compares first.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """Columns: the row key, host, path, rule (host + path of the rule, or null), verdict.

    ``rules``: host, path, action. A rule fits its host and all subdomains when the URL's path starts with its path.
    """
    host, path = host_and_path(F.col(url))
    base = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    listed = (
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("action").alias("action"))
        .na.drop()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
    )
    # "block" sorts after "allow". How deep hosts go and which paths do not end at a slash: both bounded by one rule's length.
    shape = listed.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.when(~F.col("rule_path").endswith("/"), F.length("rule_path"))).alias("lengths"),
    ).first()
    depth, lengths = shape["labels"] or 1, sorted(shape["lengths"])

    labels = F.split("host", r"\.")
    count = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(count, F.lit(depth))),
        lambda k: F.array_join(F.slice(labels, count - k + 1, k), "."),
    )
    parts = F.split("path", "/")
    prefixes = F.when(F.col("path") == "", F.array(F.lit("")).cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    )
    if lengths:
        cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
        prefixes = F.array_union(prefixes, F.transform(cut, lambda n: F.substr(F.col("path"), F.lit(1), n)))

    def digest(h: Column, p: Column) -> Column:
        return F.sha2(F.concat(h, F.lit("\n"), p), 256)

    expressions = (
        base.select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    hashed = listed.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "short", F.substring("rule_digest", 1, PREFIX_DIGITS)
    )
    found = (
        expressions.join(hashed, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct("rule_host", "rule_path", "action"),
                F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host")),
            ).alias("best")
        )
    )
    return base.join(found, ["host", "path"], "left").select(
        F.col(key),
        "host",
        "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
