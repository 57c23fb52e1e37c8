"""URL filters: rules on a host (with its subdomains) and a path prefix, found by hashed expressions of each URL.

A URL is expanded into expressions, a suffix of its host's labels followed by a prefix of its path. Only the shapes
(number of labels, length of path) that some rule has are expanded, so a URL costs no more than the rules' shapes however
long it is, and prefixes that end inside a path segment are found as well. Expressions meet the rules in an equi-join on
the first hash digits of SHA-256; the whole digest confirms a hit. The longest rule wins.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import look_up

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) from tuples (verdict, host, path), without a Python worker."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast("array<struct<host:string,path:string,verdict:string>>")))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", digits: int = 8, most_rules: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    ``rules`` (host, path, verdict) are compared with hosts whose A-Z are lower-cased; null hosts or paths count as empty,
    a verdict is 'block' or else 'allow'. Of the rules that fit, the one of the longest text ``host || path`` wins, then
    that of the longer host, then a block. Without one, ``rule`` is null and the verdict is ``default``: a URL that no rule
    names passes.

    Null URLs and those without ``://`` have an empty host and path. Rows with a null or repeated id are judged like any
    other, repeated rows come out as often as they went in, extra columns are ignored, without rules every URL gets the
    default and without URLs there are no rows. Up to ``most_rules`` rules of up to ``most_bytes`` of text are broadcast;
    more are joined by a shuffle in which only expressions that many URLs share are broadcast.
    """
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    # a rule's rank orders rules by precedence; its lengths give the rule's text back from the URL
    rank = F.shiftleft((F.length(host) + F.length(path)).cast("bigint"), 31) + F.length(host).cast("bigint") * 2 + F.when(F.col("verdict") == "block", 1).otherwise(0)
    known = rules.select(_labels(host).alias("labels"), F.length(path).alias("plen"), F.sha2(_joined(host, path), 256).alias("digest"), rank.alias("rank"))
    shapes = known.agg(F.collect_set(F.struct("labels", "plen"))).scalar()
    listed = known.groupBy("digest").agg(F.max("rank").alias("rank")).groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.collect_list(F.struct("digest", "rank")).alias("rules"))

    pages = urls.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"), shapes.alias("_shapes"))
    fits = F.filter("_shapes", lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["plen"] <= F.length("path")))
    suffix = lambda s: F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"])
    made = F.transform(fits, lambda s: F.sha2(_joined(suffix(s), F.substring(F.col("path"), F.lit(1), s["plen"])), 256))
    # the first element, empty, stands for the row itself
    rows = pages.select("page_id", "host", "path", F.explode(F.concat(F.array(F.lit("")), made)).alias("expression")).withColumn("prefix", F.substring("expression", 1, digits))

    size = rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.concat(host, path))), F.lit(0)).alias("bytes")).first()
    if size["n"] <= most_rules and size["bytes"] <= most_bytes:
        met = rows.join(F.broadcast(listed), "prefix", "left")
    else:
        counts = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("k"))
        weighed = counts.join(listed, "prefix", "left")  # an expression that no rule has can be hot too
        met = look_up(rows, weighed, ["prefix"], "k", max(1, rows.count()))
    hit = F.filter("rules", lambda r: r["digest"] == F.col("expression"))
    own = met.groupBy("page_id", "host", "path").agg(F.count_if(F.col("expression") == "").alias("m"), F.max(F.try_element_at(hit, F.lit(1))["rank"]).alias("rank"))
    # repeated rows come back one by one, by way of short arrays
    again = own.withColumn("_i", F.explode(F.sequence(F.lit(0), F.expr("(m - 1) div 1024")))).withColumn("_j", F.explode(F.sequence(F.lit(1), F.least(F.lit(1024), F.col("m") - F.col("_i") * 1024))))
    hlen, n = F.expr("cast(rank & 2147483647 as int) div 2").cast("int"), F.shiftright("rank", 31).cast("int")
    rule = F.concat(F.substring(F.col("host"), F.length("host") - hlen + 1, hlen), F.substring(F.col("path"), F.lit(1), n - hlen))
    verdict = F.when(F.col("rank").isNull(), default).when(F.col("rank") % 2 == 1, "block").otherwise("allow")
    return again.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _joined(host: Column, path: Column) -> Column:
    """The text that is hashed; a newline keeps host and path apart."""
    return F.concat(host, F.lit("\n"), path)
