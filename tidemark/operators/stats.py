"""Statistics over regions, pileups, bins and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chrom_order


def size_stats(df: DataFrame, by: list[str], value: str = "size", ddof: int = 0, median: bool = False, digits: int | None = None) -> DataFrame:
    """count, mean and standard deviation (population for ddof 0, sample for 1), and the median if asked for."""
    std = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value)
    aggs = {"mean_size": F.avg(value), "std_size": F.coalesce(std, F.lit(0.0))}
    if median:
        aggs["median_size"] = F.median(value)
    if digits is not None:
        aggs = {k: F.round(v, digits) for k, v in aggs.items()}
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in aggs.items()])


def complete(df: DataFrame, dimension: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per row of a small dimension; missing values are 0."""
    return dimension.join(df, keys, "left").select(*keys, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def state_pivot(df: DataFrame, key: str, state: str, states: list[str]) -> DataFrame:
    return df.groupBy(key).pivot(state, states).count().na.fill(0, states)


def histogram_bin(value: Column, low: Column, high: Column, n: int) -> Column:
    """0-based bin of n equal ones; the last bin is closed on the right."""
    width = (high - low) / n
    return F.when(high > low, F.least(F.lit(n - 1), F.floor((value - low) / width).cast("int"))).otherwise(F.lit(0))


def histogram(df: DataFrame, value: str, n: int, low: float | None = None, high: float | None = None, log: bool = False) -> DataFrame:
    """(bin, n) with empty bins as 0; edges from the data unless given, on a log10 scale if asked for."""
    v = F.log10(F.col(value).cast("double")) if log else F.col(value).cast("double")
    src = df.select(v.alias("v")).filter("v is not null")
    edges = src.agg(F.coalesce(F.lit(low).cast("double"), F.min("v")).alias("lo"), F.coalesce(F.lit(high).cast("double"), F.max("v")).alias("hi"))
    got = src.crossJoin(F.broadcast(edges)).filter("v >= lo and v <= hi").groupBy(histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return complete(got, bins, ["bin"], ["n"])


def histogram_by(df: DataFrame, value: Column, n: int, by: list[str], low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(by, bin, n) of each group with empty bins as 0; edges are a group's extremes unless given as columns that are constant in it.

    Values outside given edges are left out, the last bin is closed, and a group of one value has it in the middle bin.
    """
    src = df.select(*by, value.cast("double").alias("v"), *[c.cast("double").alias(k) for k, c in (("lo", low), ("hi", high)) if c is not None]).filter("v is not null")
    edges = src.groupBy(*by).agg((F.min("v") if low is None else F.min("lo")).alias("lo"), (F.max("v") if high is None else F.max("hi")).alias("hi"))
    edges = edges.withColumns({"lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    own = src.select(*by, "v").join(edges, by).filter("v >= lo and v <= hi")
    got = own.groupBy(*by, histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return complete(got, edges.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")), [*by, "bin"], ["n"])


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"), q.alias("q"), F.max(value).cast("double").alias("max"))
    return out.select(*(by or []), "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def frequency(df: DataFrame, values: list[str], by: str, start: int = 0) -> DataFrame:
    """(by, metric, value, n) for each metric and every integer from ``start`` to its maximum over all of ``by``."""
    got = df.unpivot(by, values, "metric", "value").groupBy(by, "metric", F.col("value").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    span = got.groupBy("metric").agg(F.max("value").alias("top"), F.collect_set(by).alias("_by")).withColumn(by, F.explode("_by"))
    span = span.select(by, "metric", F.explode(F.sequence(F.lit(start), F.greatest(F.lit(start), F.col("top")))).alias("value"))
    return complete(got, span, [by, "metric", "value"], ["n"])


def gaps(df: DataFrame, by: list[str], mode: str = "start") -> DataFrame:
    """Distance to the region before: start to start, or from its end with mode='edge'."""
    w = Window.partitionBy(*by).orderBy("start_pos", "end_pos")
    return df.withColumn("gap", F.col("start_pos") - F.lag("start_pos" if mode == "start" else "end_pos").over(w))


def stagger(df: DataFrame, by: list[str]) -> DataFrame:
    """Offset of each region in its run of overlaps (start below the previous end); both ends move by it."""
    w = Window.partitionBy(*by).orderBy("start_pos", "end_pos")
    broken = F.when(F.col("start_pos") < F.lag("end_pos").over(w), 0).otherwise(1)
    runs = df.withColumn("_b", broken).withColumn("_run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    offset = F.row_number().over(Window.partitionBy(*by, "_run").orderBy("start_pos", "end_pos")) - 1
    return runs.withColumn("offset", offset).withColumn("start_pos", F.col("start_pos") + F.col("offset")).withColumn("end_pos", F.col("end_pos") + F.col("offset")).drop("_b", "_run")


def genome_offsets(df: DataFrame) -> DataFrame:
    """Cumulative maximum end of the chromosomes before; the dimension is one row per chromosome."""
    tops = df.groupBy("chrom").agg(F.max("end_pos").alias("top"))
    w = Window.orderBy(chrom_order(F.col("chrom")), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    return tops.select("chrom", F.coalesce(F.sum("top").over(w), F.lit(0)).alias("chrom_offset"))


def absolute_midpoints(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(genome_offsets(df)), "chrom").withColumn("abs_mid", F.col("chrom_offset") + (F.col("start_pos") + F.col("end_pos")) / 2)


def density_overlap(df: DataFrame, by: list[str], bin_size: int) -> DataFrame:
    """Covered share of each bin a region overlaps, summed."""
    b = df.withColumn("bin", F.explode(F.sequence(F.expr(f"start_pos div {bin_size}"), F.expr(f"(end_pos - 1) div {bin_size}"))))
    part = F.least("end_pos", (F.col("bin") + 1) * bin_size) - F.greatest("start_pos", F.col("bin") * bin_size)
    return b.withColumn("_bp", part).groupBy(*by, "bin").agg((F.sum("_bp") / bin_size).alias("density"))


def bin_matrix(df: DataFrame, sizes: DataFrame, n_bins: int, by: list[str]) -> DataFrame:
    """Regions per bin of n equal bins of their chromosome, by midpoint; sizes: (chrom, chrom_size)."""
    j = df.join(F.broadcast(sizes), "chrom")
    b = F.least(F.lit(n_bins - 1), F.floor((F.col("start_pos") + F.col("end_pos")) / 2 / (F.col("chrom_size") / n_bins)).cast("int"))
    return j.withColumn("bin", b).groupBy(*by, "chrom", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"))


def bin_stats(df: DataFrame, sizes: DataFrame, n_bins: int) -> DataFrame:
    """Per bin the mean and population std of per-sample counts, zero counts of all samples included, and of sizes."""
    j = df.join(F.broadcast(sizes), "chrom")
    b = F.least(F.lit(n_bins - 1), F.floor((F.col("start_pos") + F.col("end_pos")) / 2 / (F.col("chrom_size") / n_bins)).cast("int"))
    per = j.withColumn("bin", b).groupBy("chrom", "bin", "sample_id").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size")).alias("s2"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    samples = df.agg(F.count_distinct("sample_id").alias("n_samples"))
    mid = j.withColumn("bin", b).groupBy("chrom", "bin", "size").agg(F.count(F.lit(1)).alias("k")).groupBy("chrom", "bin").agg(F.percentile("size", F.lit(0.5), F.col("k")).alias("median_size"))
    out = per.groupBy("chrom", "bin").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("k2"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.min("lo").alias("min_size"), F.max("hi").alias("max_size")).crossJoin(F.broadcast(samples))
    mean = F.col("n") / F.col("n_samples")
    mean_size = F.col("s") / F.col("n")
    return out.select("chrom", "bin", "n", mean.alias("mean_count"), F.sqrt(F.greatest(F.lit(0.0), F.col("k2") / F.col("n_samples") - mean * mean)).alias("std_count"), mean_size.alias("mean_size"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean_size * mean_size)).alias("std_size"), "min_size", "max_size").join(mid, ["chrom", "bin"])


def bin_rollup(df: DataFrame, sizes: DataFrame, n_bins: int, by: str) -> tuple[DataFrame, DataFrame]:
    """Of the samples x bins matrix of counts, empty cells included: (by, chrom, bin, mean, std) and (by, chrom, p95)."""
    cells = bin_matrix(df, sizes, n_bins, [by, "sample_id"])
    total = df.agg(F.count_distinct("sample_id").alias("samples"))
    n = F.col("samples").cast("double")
    per = cells.groupBy(by, "chrom", "bin").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("s2")).crossJoin(F.broadcast(total))
    mean = F.col("s") / n
    bins = per.select(by, "chrom", "bin", mean.alias("mean_count"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / n - mean * mean)).alias("std_count"))
    times = cells.groupBy(by, "chrom", "n").agg(F.count(F.lit(1)).alias("k"))
    empty = times.groupBy(by, "chrom").agg(F.sum("k").alias("full")).crossJoin(F.broadcast(total)).select(by, "chrom", F.lit(0).cast("bigint").alias("n"), (F.col("samples") * n_bins - F.col("full")).alias("k"))
    top = times.unionByName(empty).filter("k > 0").groupBy(by, "chrom").agg(F.percentile("n", F.lit(0.95), F.col("k")).alias("p95"))
    return bins, top


def segment_runs(pileup: DataFrame, max_gap: int = 500, min_cpgs: int = 5, call: float = 0.5, block: int = 1 << 20) -> DataFrame:
    """Runs of equal methylation calls with no gap over ``max_gap``; short runs are NoData. The call threshold is ours.

    Runs are found in blocks of a chromosome; only the first and the last run of a block can go on in another, so the
    windows over a chromosome hold at most two rows per block.
    """
    keys = ["sample_id", "hap", "chrom"]
    here = Window.partitionBy(*keys, "_block")
    w = here.orderBy("start_pos")
    m = F.when(F.col("mod_probability") >= call, "M").otherwise("U")
    rows = pileup.withColumn("_m", m).withColumn("_block", F.expr(f"start_pos div {block}"))
    new = F.coalesce((F.col("start_pos") - F.lag("start_pos").over(w) > max_gap) | (F.col("_m") != F.lag("_m").over(w)), F.lit(True))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_block", "_run").agg(F.min("start_pos").alias("start_pos"), F.max("start_pos").alias("_last"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n_cpgs"), F.first("_m").alias("call"))
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(here)))
    along = Window.partitionBy(*keys).orderBy("_block", "_run")
    goes_on = ~F.lag("_block").over(along).eqNullSafe(F.col("_block")) & (F.col("start_pos") - F.lag("_last").over(along) <= max_gap) & (F.col("call") == F.lag("call").over(along))
    edges = runs.filter("_edge").withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "_chain").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum("n_cpgs").alias("n_cpgs"), F.first("call").alias("call"))
    columns = [*keys, "start_pos", "end_pos", "n_cpgs", "call"]
    out = runs.filter("not _edge").select(*columns).unionByName(joined.select(*columns))
    return out.withColumn("label", F.when(F.col("n_cpgs") >= min_cpgs, F.col("call")).otherwise("NoData")).drop("call")


def top_regions(df: DataFrame, score: str, n: int, keys: list[str]) -> DataFrame:
    """The n/2 largest and n/2 smallest by a score, ties by key; sort the result by ``genomic_order`` for a table."""
    half = n // 2
    high = df.orderBy(F.desc(score), *keys).limit(half).withColumn("side", F.lit("high"))
    return high.unionByName(df.orderBy(F.asc(score), *keys).limit(half).withColumn("side", F.lit("low")))


def shuffled(seed: int, keys: list[str]) -> Column:
    """A fixed random order of the keys, the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def random_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows by a hash of the key: the same rows on any cluster."""
    return df.orderBy(shuffled(seed, keys), *keys).limit(n)


def stratified_sample(df: DataFrame, n: int, stratum: str, keys: list[str], seed: int = 42) -> DataFrame:
    """At least one row per stratum, its share of n otherwise, n rows in all at most."""
    share = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_k"))
    total = share.agg(F.sum("_k").alias("_total"))
    quota = share.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.floor(F.col("_k") * n / F.col("_total"))).alias("_quota"))
    w = Window.partitionBy(stratum).orderBy("_h", *keys)
    # no stratum has more than n rows in the sample, which limits the groups before they are shuffled
    ranked = df.withColumn("_h", shuffled(seed, keys)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).join(F.broadcast(quota), stratum)
    return ranked.filter("_r <= _quota").orderBy("_h", *keys).limit(n).drop("_h", "_r", "_quota")


def quantiles(df: DataFrame, value: str, by: list[str], probs: list[float], bins: int = 64) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles of each group by linear interpolation, for any number of distinct values.

    Equal values are counted first. A bounded sketch of each group gives edges of about equal bins, the counts of the bins tell
    in which the wanted ranks lie, and only values of those bins are put in order, a bin at a time: no task holds a
    group's values. The sketch only sets the bins' sizes; the result is exact. Nulls are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).select(*by, F.lit(0).alias("_all"), F.col(value).alias("v")).groupBy(*by, "_all", "v").agg(F.count(F.lit(1)).alias("k"))
    keys = [*by, "_all"]
    edges = counts.groupBy(*keys).agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], bins * 16).alias("_edges"), F.sum("k").alias("n"))
    binned = counts.join(edges.select(*keys, "_edges"), keys).select(*keys, "v", "k", F.size(F.filter("_edges", lambda e: e < F.col("v"))).alias("_bin"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    mass = binned.groupBy(*keys, "_bin").agg(F.sum("k").alias("_m")).withColumn("_from", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    at = F.col("_p") * (F.col("n") - 1)
    wanted = edges.select(*keys, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_q", "_p")).select(*keys, "n", "_q", (at - F.floor(at)).alias("_part"), F.inline(F.array(F.struct(F.lit(0).alias("_side"), F.floor(at).alias("_rank")), F.struct(F.lit(1).alias("_side"), F.ceil(at).alias("_rank")))))
    placed = wanted.join(mass, keys).filter("_rank >= _from and _rank < _from + _m").drop("_m")
    up_to = Window.partitionBy(*keys, "_bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = binned.join(placed.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").withColumn("_end", F.sum("k").over(up_to))
    found = placed.join(inside, [*keys, "_bin"]).filter("_rank >= _from + _end - k and _rank < _from + _end")
    side = lambda i: F.max(F.when(F.col("_side") == i, F.col("v").cast("double")))
    each = found.groupBy(*keys, "n", "_q", "_part").agg(side(0).alias("_lo"), side(1).alias("_hi")).withColumn("_v", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    return each.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_q") == i, F.col("_v"))).alias(f"q{i}") for i in range(len(probs))]).drop("_all")


def covariance(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(a, b, cov) of all pairs of columns of the long table (row, column, value), without a pivot.

    A missing cell counts as its column's mean, so it adds nothing; several values of a cell count as their mean. The
    sums of products run over the pairs of a row's cells, and each task adds up the pairs of columns first. Columns are
    a bounded set such as the cohort's samples, rows are any number.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(row, column).agg(F.avg(value).alias("v"))
    means = cells.groupBy(column).agg(F.avg("v").alias("m"))
    own = cells.join(F.broadcast(means), column).groupBy(row).agg(F.collect_list(F.struct(F.col(column).alias("c"), (F.col("v") - F.col("m")).alias("d"))).alias("x"))
    n = cells.select(row).distinct().agg(F.count(F.lit(1)).alias("n"))
    pairs = own.select(F.explode("x").alias("p"), "x").select("p", F.explode("x").alias("q")).groupBy(F.col("p.c").alias("a"), F.col("q.c").alias("b")).agg(F.sum(F.col("p.d") * F.col("q.d")).alias("s"))
    return pairs.crossJoin(F.broadcast(n)).select("a", "b", (F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))).alias("cov"))  # n is one row


def pca(df: DataFrame, row: str, column: str, value: str, columns: list[str], k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(row, pc1 ..) scores and (component, column, loading, explained) of the long table (row, column, value).

    Columns are a bounded list such as the cohort's samples: their covariance comes to the driver, rows never do. A missing
    cell counts as its column's mean. A component's loading of the largest size is positive, the first column in the
    list among equals; explained is the component's share of the variance. Scores are of values that aren't centred.
    """
    import numpy as np

    df = df.filter(F.col(column).isin(columns))
    at = {c: i for i, c in enumerate(columns)}
    cov = np.zeros((len(columns), len(columns)))
    for r in covariance(df, row, column, value).collect():  # columns squared
        cov[at[r["a"]], at[r["b"]]] = r["cov"]
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    weights, shares = vectors[:, order], values[order] / max(values.sum(), 1e-300)
    top = np.argmax(np.round(np.abs(weights), 12), axis=0)
    weights = weights * np.where(weights[top, range(len(order))] < 0, -1.0, 1.0)
    loadings = df.sparkSession.createDataFrame([(i + 1, c, float(weights[j, i]), float(shares[i])) for i in range(len(order)) for j, c in enumerate(columns)], f"component int, {column} string, loading double, explained double")
    cells = df.filter(F.col(value).isNotNull()).groupBy(row, column).agg(F.avg(value).alias("v"))
    means = cells.groupBy(column).agg(F.avg("v").alias("m"))
    rows = loadings.groupBy(column).pivot("component", list(range(1, len(order) + 1))).agg(F.first("loading")).join(means, column)
    # a row's score is that of the columns' means, and what its cells differ from them
    base = rows.agg(*[F.sum(F.col("m") * F.col(str(i + 1))).alias(f"_b{i + 1}") for i in range(len(order))])
    own = cells.join(F.broadcast(rows), column).groupBy(row).agg(*[F.sum((F.col("v") - F.col("m")) * F.col(str(i + 1))).alias(f"pc{i + 1}") for i in range(len(order))])
    scores = own.crossJoin(F.broadcast(base)).select(row, *[(F.col(f"pc{i + 1}") + F.col(f"_b{i + 1}")).alias(f"pc{i + 1}") for i in range(len(order))])  # base is one row
    return scores, loadings
