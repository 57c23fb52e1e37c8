"""CpG effects of variants and the cleaning of pileups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cpg_positions, high_confidence


def _windows(spans: DataFrame, chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Add ref_window, the reference's bases [w_start, w_start + w_len), to spans (contig, w_start, w_len, ...).

    A window that ends in its chunk or the chunk's overlap is cut out there. Longer ones take their parts from every
    chunk they touch, once for each distinct window, and the parts are joined in order.
    """
    ref = chunks.select("contig", "chunk_id", "chunk_start", "seq")
    end, keys = F.col("w_start") + F.col("w_len"), ["contig", "w_start", "w_len"]
    spans = spans.withColumn("chunk_id", F.floor(F.col("w_start") / chunk).cast("int"))
    inside = end <= (F.col("chunk_id").cast("bigint") + 1) * chunk + overlap
    cut = F.substring("seq", (F.col("w_start") - F.col("chunk_start") + 1).cast("int"), F.col("w_len").cast("int")).alias("ref_window")
    names = [c for c in spans.columns if c != "chunk_id"]
    short = spans.filter(inside).join(ref, ["contig", "chunk_id"]).select(*names, cut)
    long = spans.filter(~inside).drop("chunk_id")
    touched = long.select(*keys).distinct().withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("w_start") / chunk).cast("int"), F.floor((end - 1) / chunk).cast("int"))))
    low = F.greatest(F.col("w_start"), F.col("chunk_start"))
    part = F.substring("seq", (low - F.col("chunk_start") + 1).cast("int"), (F.least(end, F.col("chunk_start") + chunk) - low).cast("int"))
    parts = touched.join(ref, ["contig", "chunk_id"]).select(*keys, F.struct("chunk_id", part.alias("part")).alias("p"))
    whole = parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "").alias("ref_window"))
    return short.unionByName(long.join(whole, keys).select(*names, "ref_window"))


def variant_windows(variants: DataFrame, chunks: DataFrame, chunk: int = 65536, flank: int = 2, overlap: int = 8) -> DataFrame:
    """Join variants (contig, pos 1-based, ref, alt, ...) with the reference window of ``flank`` bases on both sides.

    ``chunk`` and ``overlap`` are those that the chunks were cut with; windows may be longer than either.
    """
    at = F.greatest(F.col("pos") - 1 - flank, F.lit(0))
    j = _windows(variants.withColumn("w_start", at.cast("bigint")).withColumn("w_len", (F.length("ref") + 2 * flank).cast("bigint")), chunks, chunk, overlap)
    j = j.withColumn("_skip", (F.col("pos") - 1 - F.col("w_start")).cast("int"))
    alt_window = F.concat(F.substring("ref_window", F.lit(1), F.col("_skip")), F.col("alt"), F.substring("ref_window", F.col("_skip") + F.length("ref") + 1, F.length("ref_window")))
    return j.withColumn("alt_window", alt_window).drop("_skip", "w_len")


def window_changes(windows: DataFrame) -> DataFrame:
    """Add destroyed and created CpG positions (0-based on the contig); the alternate is scanned over the reference's length."""
    ref = cpg_positions(F.col("ref_window"))
    alt = cpg_positions(F.substring("alt_window", F.lit(1), F.length("ref_window")))
    on = lambda a: F.transform(a, lambda i: i.cast("bigint") + F.col("w_start"))
    return windows.withColumn("destroyed", on(F.array_except(ref, alt))).withColumn("created", on(F.array_except(alt, ref)))


def cpg_effects(changes: DataFrame) -> DataFrame:
    """Long table (sample_id, hap, contig, pos, effect), distinct; needs gt and phase_set columns.

    A variant's alternative is its first one, allele 1. Two of it: both haplotypes get destroyed and homozygous_denovo.
    Any other phased genotype with a phase set: the first haplotype, if it has allele 1, or else the second gets
    destroyed and denovo, the other one a phantom where a created site is not in the reference; so 1|2 is on the first,
    2|1, 0|2 and 2|0 are on the second. Genotypes without an alternative or with a missing allele, and unphased
    ones, have none.
    """
    gt = F.split("gt", "[|/]")
    a, b = F.try_element_at(gt, F.lit(1)), F.try_element_at(gt, F.lit(2))
    hom = (a == "1") & (b == "1")
    het = F.contains("gt", F.lit("|")) & F.col("phase_set").isNotNull() & (a != ".") & (b != ".") & ((a != "0") | (b != "0"))
    alt_hap = F.when(a == "1", "hap1").otherwise("hap2")
    other = F.when(a == "1", "hap2").otherwise("hap1")
    row = lambda h, p, e: F.struct(h.alias("hap"), p.alias("pos"), F.lit(e).alias("effect"))
    d, c = F.col("destroyed"), F.col("created")

    def rows(sites, h, e):
        return F.transform(sites, lambda p: row(h, p, e))

    both = [rows(x, F.lit(h), e) for h in ("hap1", "hap2") for x, e in ((d, "ref_destroyed"), (c, "homozygous_denovo"))]
    one = [rows(d, alt_hap, "ref_destroyed"), rows(c, alt_hap, "denovo_created"), rows(c, other, "phantom_sites")]
    out = F.when(hom, F.concat(*both)).when(het, F.concat(*one))
    return changes.select("sample_id", "contig", F.explode(out).alias("e")).select("sample_id", "e.hap", "contig", "e.pos", "e.effect").distinct()


def cpg_index(chunks: DataFrame, chunk: int = 65536, piece: int = 4096, step: int = 512) -> DataFrame:
    """(contig, block, pos): the reference's CpG positions, 0-based, a block for each ``piece`` bases.

    Made in place from chunks that overlap by a base at least, ``step`` bases at a time; a chunk's own positions begin in
    its first ``chunk`` bases. What follows joins positions, and no sequence moves.
    """
    own = F.least(F.lit(chunk), F.length("seq"))
    steps = F.sequence(F.lit(0), F.expr(f"int((least({chunk}, length(seq)) - 1) div {step})"))
    cut = F.transform(steps, lambda i: F.struct(i.alias("i"), F.substring(F.col("seq"), i * step + 1, F.least(F.lit(step), own - i * step) + 1).alias("text")))
    parts = chunks.filter(F.length("seq") > 0).select("contig", "chunk_start", F.inline(cut))
    # the texts between CGs give the distance from one to the next
    between = F.split("text", "CG")
    first = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("at"))
    found = F.aggregate(F.slice(between, 1, F.size(between) - 1), first, lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["at"] + F.length(x))).alias("a"), (acc["at"] + F.length(x) + 2).alias("at")), lambda acc: acc["a"])
    pos = F.col("chunk_start") + F.col("i") * step + F.col("p")
    return parts.select("contig", "chunk_start", "i", F.explode(found).alias("p")).select("contig", F.floor(pos / piece).cast("int").alias("block"), pos.cast("bigint").alias("pos"))


def write_cpg_index(chunks: DataFrame, path: str, chunk: int = 65536, piece: int = 4096) -> None:
    """The index as Parquet in ranges of contig and position, so that a scan for a region reads few files."""
    cpg_index(chunks, chunk, piece).repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos").write.parquet(path)


def without_reference_phantoms(effects: DataFrame, chunks: DataFrame, chunk: int = 65536, index: DataFrame | None = None) -> DataFrame:
    """Drop phantom sites where the reference itself has a CpG: an anti-join on its CpG positions."""
    index = cpg_index(chunks, chunk) if index is None else index
    phantom = effects.filter("effect = 'phantom_sites'").join(index.select("contig", "pos"), ["contig", "pos"], "left_anti")
    return effects.filter("effect <> 'phantom_sites'").unionByName(phantom.select(effects.columns))


def apply_effects(pileup: DataFrame, effects: DataFrame, variant_sites: DataFrame | None = None, min_prob: float = 0.9, min_cov: int = 10) -> DataFrame:
    """Add in_effect, preserved and status ('kept'/'excluded') per haplotype site; effects: (sample_id, hap, chrom, pos, effect)."""
    hit = effects.filter("effect in ('ref_destroyed', 'phantom_sites')").select("sample_id", "hap", "chrom", F.col("pos").alias("start_pos")).distinct().withColumn("_hit", F.lit(True))
    out = pileup.join(hit, ["sample_id", "hap", "chrom", "start_pos"], "left")
    safe = high_confidence(min_prob, min_cov)
    if variant_sites is not None:
        sites = variant_sites.select("sample_id", "chrom", F.col("pos").alias("start_pos")).distinct().withColumn("_var", F.lit(True))
        out = out.join(sites, ["sample_id", "chrom", "start_pos"], "left")
        safe = safe & F.col("_var").isNull()
    out = out.withColumn("in_effect", F.coalesce("_hit", F.lit(False))).withColumn("preserved", F.col("in_effect") & safe)
    return out.withColumn("status", F.when(F.col("in_effect") & ~F.col("preserved"), "excluded").otherwise("kept")).select(*pileup.columns, "in_effect", "preserved", "status")


def apply_effects_combined(pileup: DataFrame, effects: DataFrame) -> DataFrame:
    """The combined track: sites in either haplotype's effects go, nothing is preserved."""
    hit = effects.filter("effect in ('ref_destroyed', 'phantom_sites')").select("sample_id", "chrom", F.col("pos").alias("start_pos")).distinct()
    return pileup.join(hit, ["sample_id", "chrom", "start_pos"], "left_anti")


#: Counters of a QC summary, and the effect that each of the last four counts.
COUNTERS = ["total", "kept", "excluded", "preserved"]
EFFECT_COUNTERS = {"destroyed": "ref_destroyed", "phantom": "phantom_sites", "denovo": "denovo_created", "homozygous_denovo": "homozygous_denovo"}


def qc_summary(cleaned: DataFrame, effects: DataFrame) -> DataFrame:
    """Per sample and haplotype: total, kept, excluded and preserved sites, and the distinct sites of each effect."""
    n = lambda c: F.count_if(c)
    sites = cleaned.groupBy("sample_id", "hap").agg(F.count(F.lit(1)).alias("total"), n(F.col("status") == "kept").alias("kept"), n(F.col("status") == "excluded").alias("excluded"), n(F.col("preserved")).alias("preserved"))
    found = effects.select("sample_id", "hap", "chrom", "pos", "effect").distinct().groupBy("sample_id", "hap").agg(*[n(F.col("effect") == e).alias(c) for c, e in EFFECT_COUNTERS.items()])
    both = sites.join(found, ["sample_id", "hap"], "full")
    return both.select("sample_id", "hap", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*COUNTERS, *EFFECT_COUNTERS]])


def qc_metrics(summary: DataFrame) -> DataFrame:
    """(sample_id, metric, hap1, hap2, mean, std): each metric with its mean and population std over both haplotypes' values of all samples."""
    long = summary.unpivot(["sample_id", "hap"], [*COUNTERS, *EFFECT_COUNTERS], "metric", "v")
    wide = long.groupBy("sample_id", "metric").agg(*[F.sum(F.when(F.col("hap") == h, F.col("v"))).alias(h) for h in ("hap1", "hap2")])
    over = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return wide.join(F.broadcast(over), "metric").select("sample_id", "metric", "hap1", "hap2", "mean", "std")
