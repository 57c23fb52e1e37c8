"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, look_up

PER_PART = 50_000


def _least(edges: DataFrame, rows: int, parts: int) -> DataFrame:
    """Each row (u, v) with m, the least of u and its partners; hot vertices don't meet in one task."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("k")).coalesce(parts)
    return look_up(edges, least, ["u"], "k", rows).select("u", "v", "m")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component): for every id of ``links`` (a, b) the least id that is reachable. Takes O(log^2) rounds; over ``limit`` is an error.

    Tables of links are brought to as many partitions as their rows need, so that rounds on few links are short.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before, parts = None, 1
    for _ in range(limit):
        rows = edges.count()
        if not rows:
            break
        parts = 1 + rows // PER_PART
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * rows, parts).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(parts).distinct()
        large = cut(large.coalesce(parts))
        small = _least(large, max(1, rows), parts)
        star = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(star.filter("u <> v").coalesce(parts).distinct().coalesce(parts))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    own = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).coalesce(parts)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().join(edges.select(F.col("u").alias("id")).distinct(), "id", "left_anti")
    return own.unionByName(roots.coalesce(parts))


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (id, component) after further ``links`` (a, b): only the components that these join are worked out anew."""
    a = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    rows = label.count()
    parts = 1 + rows // PER_PART
    new, _ = kept(components(between.coalesce(parts)))
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("k")).coalesce(parts)
    to = sizes.join(new.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component").coalesce(parts)
    moved = look_up(label, to, ["component"], "k", max(1, rows)).select("id", F.coalesce("_to", "component").alias("component"))
    return moved.unionByName(new.join(label.select("id"), "id", "left_anti"))
