"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the first join compares; the full digest confirms.
SHORT = 8
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _slashes(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def _before(text: Column, mark: str, n: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), n.cast("int"))


def _folder(path: Column, depth: Column) -> Column:
    """The path up to its depth-th slash, with it; empty at depth 0."""
    return F.when(depth > 0, F.concat(_before(path, "/", depth), F.lit("/"))).otherwise("")


def _expression(host: Column, folder: Column) -> Column:
    return F.concat_ws(" ", host, folder)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, SHORT)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule and verdict of each row of pages.

    rules has host, path and verdict (allow or block). A rule fits its host and all subdomains of it where the path starts
    with the rule's; of the rules that fit, the longest (host and path together, then the longer host) wins, and of equal
    ones block. No rule fits: rule is null and the verdict is ``default``. A null URL or one without :// has an empty host
    and path. Repeated rows are each judged; rules with a null or empty host are void.

    A rule's expression is its host and its path up to the last slash. A URL is expanded into each suffix of its host with
    each such prefix of its path, as deep as the deepest rule. Expressions meet the table of short prefixes first; what has
    a prefix there and is confirmed by the full digest meets the rules, whose whole paths are compared. Spark broadcasts
    the prefix table and the rules while they are below its threshold, and else shuffles and splits what is skewed. Each
    distinct host and path is judged once.
    """
    ready = (
        rules.select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .where("rule_host != ''")
        .withColumn("digest", F.sha2(_expression(F.col("rule_host"), _folder(F.col("rule_path"), _slashes(F.col("rule_path")))), 256))
    )
    # the digests that share a prefix: as good as always one
    prefixes = ready.select("digest").distinct().groupBy(_short(F.col("digest")).alias("short")).agg(F.collect_list("digest").alias("digests"))
    deepest = ready.agg(F.coalesce(F.max(_labels(F.col("rule_host"))), F.lit(0)).alias("k"), F.coalesce(F.max(_slashes(F.col("rule_path"))), F.lit(0)).alias("s")).first()
    urls = pages.select(F.col(id_col).alias("__id"), url_host(F.col(url_col)).alias("__host"), url_path(F.col(url_col)).alias("__path"))
    folders = F.transform(F.sequence(F.lit(0), F.least(_slashes(F.col("__path")), F.lit(deepest.s))), lambda d: _folder(F.col("__path"), d))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(_labels(F.col("__host")), F.lit(max(1, deepest.k)))), lambda k: _before(F.col("__host"), ".", -k))
    wanted = (
        urls.where("__host != ''").select("__host", "__path").distinct()
        .select("__host", "__path", F.explode(suffixes).alias("suffix"), folders.alias("folders"))
        .select("__host", "__path", "suffix", F.explode("folders").alias("folder"))
        .select("__host", "__path", "suffix", F.sha2(_expression(F.col("suffix"), F.col("folder")), 256).alias("of_digest"))
    )
    confirmed = wanted.join(prefixes, _short(F.col("of_digest")) == F.col("short")).where(F.array_contains("digests", F.col("of_digest")))
    length = F.length("rule_host") + F.length("rule_path")
    rank = F.struct(length.alias("n"), F.length("rule_host").alias("h"), (F.col("verdict") == "block").cast("int").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    judged = (
        confirmed.join(ready, F.col("of_digest") == F.col("digest"))
        .where((F.col("suffix") == F.col("rule_host")) & F.startswith(F.col("__path"), F.col("rule_path")))
        .groupBy(F.col("__host").alias("__h"), F.col("__path").alias("__p"))
        .agg(F.max(rank).alias("best"))
    )
    # those without a host have nothing to meet: a salt that no host can be deals them out
    salted = F.when(F.col("__host") == "", F.concat(F.lit("/"), F.pmod(F.xxhash64("__id"), F.lit(9973)))).otherwise(F.col("__host"))
    return urls.join(judged, (salted == F.col("__h")) & (F.col("__path") == F.col("__p")), "left").select(
        F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
