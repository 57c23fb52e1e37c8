"""Range joins as binned equi-joins.

The interval side is exploded to the bins it touches and meets the other side on (keys, bin), so Catalyst plans a hash
or sort-merge join instead of a nested loop, and AQE can split a dense bin. A pair of intervals that shares several
bins is kept in the first one only. Choose the bin width near the median interval; intervals over ``most`` bins go
through coarser bins, and joins on one position use several levels of bins, so a few long ones don't multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(pos: Column, width: int) -> Column:
    return F.floor(pos / width).cast("bigint")


def explode_bins(df: DataFrame, width: int, start: str = "start_pos", end: str = "end_pos", name: str = "bin") -> DataFrame:
    """A row per bin that [start, end) touches."""
    return df.withColumn(name, F.explode(F.sequence(bin_of(F.col(start), width), F.greatest(bin_of(F.col(start), width), bin_of(F.col(end) - 1, width)))))


def _renamed(df: DataFrame, by: tuple[str, ...], prefix: str) -> DataFrame:
    return df.select(*by, *[F.col(c).alias(prefix + c) for c in df.columns if c not in by])


def overlap_join(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("chrom",), width: int = 2048, coarse: int = 64, most: int = 32) -> DataFrame:
    """All pairs with a.start < b.end and b.start < a.end; b's other columns get the prefix ``b_``."""
    right = _renamed(b, by, "b_")

    def joined(x: DataFrame, y: DataFrame, w: int) -> DataFrame:
        left = explode_bins(x.withColumn("_first", bin_of(F.col("start_pos"), w)), w, name="_bin")
        other = explode_bins(y.withColumn("_b_first", bin_of(F.col("b_start_pos"), w)), w, "b_start_pos", "b_end_pos", "_bin")
        hit = (F.col("start_pos") < F.col("b_end_pos")) & (F.col("b_start_pos") < F.col("end_pos")) & (F.col("_bin") == F.greatest("_first", "_b_first"))
        return left.join(other, [*by, "_bin"]).filter(hit).drop("_bin", "_first", "_b_first")

    limit = width * most
    a_long, b_long = F.col("end_pos") - F.col("start_pos") > limit, F.col("b_end_pos") - F.col("b_start_pos") > limit
    fine = joined(a.filter(~a_long), right.filter(~b_long), width)
    wide = width * coarse
    return fine.unionByName(joined(a.filter(a_long), right, wide)).unionByName(joined(a.filter(~a_long), right.filter(b_long), wide))


def levels(points: DataFrame, intervals: DataFrame, by: tuple[str, ...], pos: str, prefix: str, width: int, step: int = 32, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Both sides with a level and a bin to join on. Each interval is on the level whose bins are about its length, so it
    touches at most ``step`` of them (the coarsest level takes all longer ones); each point is looked up on every level."""
    start, end = f"{prefix}start_pos", f"{prefix}end_pos"
    right = _renamed(intervals, by, prefix) if prefix else intervals
    length = F.greatest(F.lit(1), F.col(end) - F.col(start))
    level = F.least(F.lit(most - 1), F.greatest(F.lit(0), F.ceil(F.log(length / (width * step)) / F.log(F.lit(float(step)))))).cast("int")
    wide = lambda: (F.lit(float(step)) ** F.col("_level")).cast("bigint") * width
    at = lambda c: F.floor(c / wide()).cast("bigint")
    right = right.withColumn("_level", level).withColumn("_bin", F.explode(F.sequence(at(F.col(start)), F.greatest(at(F.col(start)), at(F.col(end) - 1)))))
    left = points.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in range(most)]))).withColumn("_bin", at(F.col(pos)))
    return left, right


def containment_join(inner: DataFrame, outer: DataFrame, by: tuple[str, ...] = ("chrom",), width: int = 2048) -> DataFrame:
    """Pairs where the outer interval contains the inner one; only the bin of the inner start is looked up, on each level."""
    left, right = levels(inner, outer, by, "start_pos", "b_", width)
    return left.join(right, [*by, "_level", "_bin"]).filter("b_start_pos <= start_pos and b_end_pos >= end_pos").drop("_bin", "_level")


def point_join(points: DataFrame, intervals: DataFrame, by: tuple[str, ...] = ("chrom",), pos: str = "pos", width: int = 2048) -> DataFrame:
    """Pairs with start <= pos < end."""
    left, right = levels(points, intervals, by, pos, "", width)
    return left.join(right, [*by, "_level", "_bin"]).filter((F.col("start_pos") <= F.col(pos)) & (F.col(pos) < F.col("end_pos"))).drop("_bin", "_level")


WORD = 62  # samples for each bigint of a set


def sample_sets(regions: DataFrame, segments: DataFrame, names: list[str], by: tuple[str, ...] = ("chrom",), contain: bool = False, width: int = 2048) -> DataFrame:
    """(by, start_pos, end_pos, samples): for each region the sorted samples that have a segment over it, or one that contains it.

    A semi-join for each sample: a pair of a region and a segment leaves one bit, set in an integer per word of samples,
    and the words of a region merge by ``bit_or`` in the task that joins them, before anything is shuffled; what
    moves is a row for each region and task, whatever the number of segments. ``names`` are the cohort's; segments of
    others are left out, regions without any are absent.
    """
    keys = [*by, "start_pos", "end_pos"]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("sample_id")) - 1
    own = segments.select(*by, "start_pos", "end_pos", place.alias("_i")).filter("_i >= 0")
    own = own.select(*by, "start_pos", "end_pos", F.expr(f"int(_i div {WORD})").alias("word"), F.expr(f"shiftleft(1L, int(_i % {WORD}))").alias("bit"))
    base = regions.select(*keys)
    met = containment_join(base, own, by, width) if contain else overlap_join(base, own, by, width)
    words = range(-(-len(names) // WORD))
    sets = met.groupBy(*keys).agg(*[F.bit_or(F.when(F.col("b_word") == w, F.col("b_bit"))).alias(f"_w{w}") for w in words])
    parts = [_members(f"_w{w}", names[w * WORD : (w + 1) * WORD]) for w in words]
    return sets.select(*keys, F.array_sort(F.concat(*parts) if parts else F.array().cast("array<string>")).alias("samples"))


def _members(word: str, names: list[str]) -> Column:
    """The names whose bits are set in a word."""
    bits = F.coalesce(F.col(word), F.lit(0).cast("bigint"))
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n, i: F.call_function("getbit", bits, i) == 1)


def annotate_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """Left range join with a small fixed dimension (chrom, f_start, f_end, feature, kind); one row per overlapped feature."""
    dim = F.broadcast(features.withColumnRenamed("chrom", "_f_chrom"))
    return df.join(dim, (F.col("chrom") == F.col("_f_chrom")) & (F.col("start_pos") < F.col("f_end")) & (F.col("f_start") < F.col("end_pos")), "left").drop("_f_chrom", "f_start", "f_end")


def paired(regions: DataFrame, least: int = 2, sample: str = "sample_id", hap: str = "hap") -> DataFrame:
    """Rows of samples that have at least ``least`` haplotypes: 2 for both, 1 for either."""
    enough = regions.groupBy(sample).agg(F.count_distinct(hap).alias("_h")).filter(F.col("_h") >= least)
    return regions.join(enough.select(sample), sample, "left_semi")
