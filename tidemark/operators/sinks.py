"""Sinks: the tables are shaped here and written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chrom_order, ratio_text, region_score, score_band, score_text, status_colour
from .states import STATES


def joined_list(col: str):
    return F.when(F.size(col) == 0, ".").otherwise(F.array_join(F.array_sort(col), ","))


def genomic_sort(df: DataFrame) -> DataFrame:
    return df.withColumn("_rank", chrom_order(F.col("chrom"))).orderBy("_rank", "chrom", "start_pos", "end_pos").drop("_rank")


def consensus_table(df: DataFrame) -> DataFrame:
    return df.select("chrom", "start_pos", "end_pos", F.size("samples").alias("num_samples"), joined_list("samples").alias("samples"), (F.col("end_pos") - F.col("start_pos")).alias("size"))


def candidate_table(df: DataFrame) -> DataFrame:
    return df.select("chrom", "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos")).alias("size"), F.size("unmethylated_samples").alias("num_unmethylated"), F.size("methylated_samples").alias("num_methylated"), joined_list("unmethylated_samples").alias("unmethylated_samples"), joined_list("methylated_samples").alias("methylated_samples"))


def bed9(df: DataFrame, name: str = "label", score: int = 1000, colour=None) -> DataFrame:
    """Nine-column browser rows."""
    return df.select("chrom", "start_pos", "end_pos", F.col(name).alias("name"), F.lit(score).alias("score"), F.lit(".").alias("strand"), F.col("start_pos").alias("thick_start"), F.col("end_pos").alias("thick_end"), (colour if colour is not None else status_colour(F.col("label"))).alias("rgb"))


def mapped_variants(scored: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The mapped-variant table of one scoring: 'v1', 'v2', 'v3', 'v4' or 'simple'. ``scored`` has counts, totals, scores and samples."""
    c = F.col
    names = {v: k for k, v in STATES.items()}
    unknown = c("x_plus") + c("x_minus") + c("x_none")
    of = {v: c("total_meth") if v[0] == "m" else c("total_unmeth") if v[0] == "u" else unknown for v in names}
    of["x_none"] = c("total") if version != "v3" else unknown
    ratios = [ratio_text(c(v), of[v]).alias(k) for v, k in names.items()]
    who = lambda *states: [joined_list(f"{v}_samples").alias(f"{v}_samples") for v in states]
    seven = ("m_plus", "u_plus", "x_plus", "m_none", "u_none", "x_none")
    if version == "v1":
        return scored.select(*keys, "v1_meth", "v1_unmeth", "p_value", *ratios, *who(*seven))
    if version == "v2":
        rate = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
        gain = rate("m_plus", "total_meth") - rate("u_plus", "total_unmeth")
        return scored.select(*keys, F.col("v2_association").alias("association"), "v2_meth", "v2_unmeth", "p_value", *ratios, c("coverage_v2").alias("data_coverage"), F.greatest(F.lit(0.0), gain).alias("meth_enrichment"), F.greatest(F.lit(0.0), -gain).alias("unmeth_enrichment"), *who(*seven, "x_minus"))
    if version == "v3":
        plain = [F.concat_ws("/", c(v).cast("string"), of[v].cast("string")).alias(k) for v, k in names.items()]
        return scored.filter("v3 is not null").select(*keys, "v3", *plain, *who("m_plus", "u_plus", "x_plus"))
    if version == "simple":
        carriers, others = c("m_plus") + c("u_plus"), c("m_minus") + c("u_minus")
        return scored.filter("simple_class is not null").select(*keys, c("simple_class").alias("pattern"), carriers.alias("variant_carriers"), others.alias("non_carriers"), (carriers + others).alias("total_samples"), (c("total") - carriers - others).alias("missing_data"), *who("m_plus", "u_plus"))
    assert version == "v4", version
    up = c("v4_class") == "methylated_associated"
    pick = lambda a, b: F.when(up, a).otherwise(b)
    m, u = c("m_plus") + c("m_minus"), c("u_plus") + c("u_minus")
    strong = scored.filter("v4_class in ('methylated_associated', 'unmethylated_associated')")
    return strong.select(*keys, c("v4_class").alias("classification"), pick(c("v4_meth"), c("v4_unmeth")).alias("enrichment_score"), pick(c("v4_meth_odds"), c("v4_unmeth_odds")).alias("log_odds"), F.least(F.lit(1.0), pick(m, u) / 10).alias("confidence"), "quality",
        (pick(c("m_plus"), c("u_plus")) / pick(m, u)).alias("state_frequency"), ((c("m_plus") + c("u_plus")) / (m + u)).alias("background_frequency"), (m + u).alias("complete_samples"), c("total").alias("total_samples"), *who("m_plus", "u_plus"))


def write_tsv(df: DataFrame, path: str, header: bool = True, partition: list[str] | None = None, mode: str = "error", sep: str = "\t") -> None:
    w = df.write.mode(mode).option("sep", sep).option("header", header)
    (w.partitionBy(*partition) if partition else w).csv(path)


def score_table(candidates: DataFrame, extra: list[str] = ()) -> DataFrame:
    """The table that explains each candidate region's score: proportions, their difference, weight, band, text and samples."""
    m, u = F.size("methylated_samples"), F.size("unmethylated_samples")
    n = m + u
    of = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    score = region_score(m, u)
    return candidates.select(
        "chrom", "start_pos", "end_pos", *extra, score.alias("meth_score"), score_text(m, u, score).alias("score_calculation"), m.alias("num_methylated"), u.alias("num_unmethylated"), n.alias("total_samples"),
        of(m).alias("meth_proportion"), of(u).alias("unmeth_proportion"), of(m - u).alias("proportion_diff"), F.log2((n + 1).cast("double")).alias("sample_weight"), score_band(score).alias("score_interpretation"),
        joined_list("methylated_samples").alias("methylated_samples"), joined_list("unmethylated_samples").alias("unmethylated_samples"))


def write_sorted(df: DataFrame, path: str, order: list, header: bool = True, partition: list[str] | None = None, sep: str = "\t") -> None:
    """TSV files in order, or CSV ones with another ``sep``: part-00000.tsv holds the first rows, and so on; ``order`` are columns or names.

    Rows go to ranges of the order, one file each. Files are staged beside ``path`` and swapped in when all are written, under
    names that depend on nothing but their place: a reader sees the old folder or the new one, a failed run leaves the
    old one, and a repeated run leaves the same rows in the same order and nothing else. With ``partition`` each value has a folder of its own.
    """
    import uuid

    spark = df.sparkSession
    base = path.rstrip("/")
    staged, old = f"{base}-staged-{uuid.uuid4().hex}", f"{base}-old-{uuid.uuid4().hex}"
    # orders that are expressions become columns first: a sort evaluates its orders at each comparison
    given = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(given)})
    placed = keyed.orderBy(*[F.col(c) for c in partition or []], *[f"_o{i}" for i in range(len(given))]).select(*df.columns)
    write_tsv(placed, staged, header, partition, sep=sep)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    kind = "tsv" if sep == "\t" else "csv"
    found, names = fs.listFiles(at(staged), True), {}
    while found.hasNext():
        f = found.next().getPath()
        if f.getName().startswith("part-"):
            names.setdefault(f.getParent().toString(), []).append(f.getName())
    for folder, files in names.items():
        for i, name in enumerate(sorted(files)):
            fs.rename(at(f"{folder}/{name}"), at(f"{folder}/part-{i:05d}.{kind}"))
    if fs.exists(at(base)):
        fs.rename(at(base), at(old))
    if not fs.rename(at(staged), at(base)):
        raise OSError(f"{base} could not be replaced; the rows are in {staged}")
    fs.delete(at(old), True)


def genomic_order(*more: str) -> list:
    return [chrom_order(F.col("chrom")), F.col("chrom"), F.col("start_pos"), F.col("end_pos"), *[F.col(c) for c in more]]


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, percent): how often each value occurs among the rows of a group."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy(*by).agg(F.sum("n").alias("_t")), by).withColumn("percent", F.col("n") * 100.0 / F.col("_t")).drop("_t")


def as_report(figures: DataFrame) -> DataFrame:
    """One row of figures as rows (metric, value)."""
    return figures.select(*[F.col(c).cast("double").alias(c) for c in figures.columns]).unpivot([], figures.columns, "metric", "value")
