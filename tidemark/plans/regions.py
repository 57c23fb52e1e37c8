"""Queries over regions: scans, joins, statistics, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import consensus as K
from ..operators import intervals as I
from ..operators import sinks, stats
from ..sources import dimensions, files
from ..sources.scratch import scratch
from ..sources.views import duck, view

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def seg(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "segments").withColumn("size", F.col("end_pos") - F.col("start_pos"))


def R(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


ISLANDS = duck("segments") + """, seg AS (SELECT *, end_pos - start_pos AS size FROM segments),
 marked AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom, hap ORDER BY start_pos, end_pos, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM seg WHERE label = 'U'),
 numbered AS (SELECT *, sum(CASE WHEN top IS NULL OR start_pos > top + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, hap ORDER BY start_pos, end_pos, sample_id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
 islands AS (SELECT chrom, hap, min(start_pos) AS start_pos, max(end_pos) AS end_pos, list_sort(list_distinct(list(sample_id))) AS samples, count(*) AS n_regions FROM numbered GROUP BY chrom, hap, island)"""
EVIDENCE = ISLANDS + """, u AS (SELECT i.chrom, i.hap, i.start_pos, i.end_pos, list_sort(list_distinct(list(s.sample_id))) AS us FROM islands i JOIN seg s ON s.chrom = i.chrom AND s.hap = i.hap AND s.label = 'U' AND s.start_pos < i.end_pos AND i.start_pos < s.end_pos GROUP BY ALL),
 m AS (SELECT i.chrom, i.hap, i.start_pos, i.end_pos, list_sort(list_distinct(list(s.sample_id))) AS ms FROM islands i JOIN seg s ON s.chrom = i.chrom AND s.hap = i.hap AND s.label = 'M' AND s.start_pos <= i.start_pos AND s.end_pos >= i.end_pos GROUP BY ALL),
 evidence AS (SELECT i.*, coalesce(us, []) AS us, coalesce(ms, []) AS ms FROM islands i LEFT JOIN u USING (chrom, hap, start_pos, end_pos) LEFT JOIN m USING (chrom, hap, start_pos, end_pos)),
 reasoned AS (SELECT *, CASE WHEN len(list_filter(samples, lambda x: NOT list_contains(us, x))) > 0 THEN 'inconsistent' WHEN len(us) = 0 THEN 'no_unmethylated' WHEN len(ms) < 1 THEN 'insufficient_methylated' ELSE 'final' END AS reason FROM evidence)"""
SEG = duck("segments") + ", seg AS (SELECT *, end_pos - start_pos AS size FROM segments)"


def u_islands(spark, d):
    return K.islands(seg(spark, d).filter("label = 'U'"), 500)


def kept_islands(spark, d):
    """Islands kept as files: the joins that follow read them several times."""
    path = scratch(spark)
    u_islands(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def final_candidates(spark, d):
    return K.candidates(kept_islands(spark, d), seg(spark, d))


CAND = "array_to_string(us, ',') AS unmethylated_samples, array_to_string(ms, ',') AS methylated_samples"


@query("flagship", f"WITH {EVIDENCE}, f AS (SELECT * FROM reasoned WHERE reason = 'final') SELECT chrom, hap, start_pos, end_pos, {CAND} FROM f")
def flagship(spark, d):
    """Consensus islands of unmethylated segments that other samples cover as methylated."""
    c = final_candidates(spark, d)
    return c.select("chrom", "hap", "start_pos", "end_pos", F.array_join("unmethylated_samples", ",").alias("unmethylated_samples"), F.array_join("methylated_samples", ",").alias("methylated_samples"))


# scans: derived rows are written as files and read back by the scan


def wrote(spark, df: DataFrame, header: bool = False, partition: list[str] | None = None) -> str:
    path = scratch(spark)
    sinks.write_tsv(df, path, header, partition)
    return path


def pileup_file(spark, d) -> str:
    p = view(spark, d, "pileup").select("chrom", "start_pos", "end_pos", F.col("mod_score").cast("double"), "hap", "coverage", F.floor(F.col("coverage") * F.col("mod_probability")).alias("est_mod"), (F.col("coverage") - F.floor(F.col("coverage") * F.col("mod_probability"))).alias("est_unmod"), "mod_probability", F.col("sample_id").alias("sample"))
    return wrote(spark, p, partition=["sample"])


@query("s1_pileup_scan", f"WITH {duck('pileup')} SELECT sample_id, hap, count(*) AS n, CAST(sum(coverage) AS BIGINT) AS coverage, CAST(sum(start_pos) AS BIGINT) AS starts FROM pileup GROUP BY ALL")
def s1(spark, d):
    got = files.read_pileup(spark, pileup_file(spark, d), r"sample=([^/]+)/")
    return got.groupBy("sample_id", "hap").agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("coverage"), F.sum("start_pos").alias("starts"))


@query("s2_pruned_scan", f"WITH {duck('pileup')} SELECT CAST(mod_score AS BIGINT) AS mod_score, count(*) AS n, CAST(sum(coverage) AS BIGINT) AS coverage FROM pileup GROUP BY ALL")
def s2(spark, d):
    got = files.read_pileup(spark, pileup_file(spark, d)).select("mod_score", "coverage")
    return got.groupBy(F.col("mod_score").cast("bigint").alias("mod_score")).agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("coverage"))


@query("s3_segment_scan", f"WITH {SEG} SELECT chrom, 'Hap' || substr(hap, 2) || '-' || label AS category, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM seg GROUP BY ALL")
def s3(spark, d):
    """The files of each haplotype, every one of which has a comment line first."""
    out = None
    for hap in ("H1", "H2"):
        path = scratch(spark)
        src = seg(spark, d).filter(F.col("hap") == hap).select(F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "label").alias("value"))
        src.unionByName(src.limit(1).select(F.lit("#chrom\tstart\tend\tsummary_label").alias("value"))).write.text(path)
        got = files.read_segments(spark, path, f"Hap{hap[1]}")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("chrom", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("s4_segment_header_scan", f"WITH {SEG} SELECT label, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM seg GROUP BY ALL")
def s4(spark, d):
    path = wrote(spark, seg(spark, d).select("chrom", "start_pos", "end_pos", "label"), header=True)
    return files.read_segments(spark, path, header=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("s5_tolerant_region_scan", f"WITH {SEG} SELECT start_pos % 50 <> 0 AND start_pos % 51 <> 0 AS ok, count(*) AS n FROM seg GROUP BY ALL")
def s5(spark, d):
    path = scratch(spark)
    line = F.when(F.col("start_pos") % 50 == 0, F.concat_ws(" ", "chrom", F.col("start_pos").cast("string"))).when(F.col("start_pos") % 51 == 0, F.concat_ws("\t", "chrom", F.lit("x"), F.col("end_pos").cast("string"), "label"))
    seg(spark, d).select(F.coalesce(line, F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "label")).alias("value")).write.text(path)
    return files.read_regions(spark, path, on_bad="flag").groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@query("s6_condition_scan", f"WITH {SEG} SELECT hap || '_' || label AS condition, sample_id, count(*) AS n FROM seg GROUP BY ALL")
def s6(spark, d):
    path = wrote(spark, seg(spark, d).withColumn("condition", C.combined_label(F.col("hap"), F.col("label"))).withColumn("sample", F.col("sample_id")).select("chrom", "start_pos", "end_pos", "condition", "sample"), partition=["condition", "sample"])
    got = spark.read.csv(path, sep="\t").select("condition", files.path_part(r"sample=([^/]+)/").alias("sample_id"))
    return got.groupBy("condition", "sample_id").agg(F.count(F.lit(1)).alias("n"))


@query("s7_coercing_scan", f"WITH {SEG} SELECT chrom, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM seg WHERE end_pos % 40 <> 0 AND size > 0 GROUP BY ALL")
def s7(spark, d):
    src = seg(spark, d).select("chrom", F.col("start_pos").alias("start"), F.when(F.col("end_pos") % 40 == 0, "bad").otherwise(F.col("end_pos").cast("string")).alias("end"))
    return files.read_sized(spark, wrote(spark, src, header=True)).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("s8_consensus_scan", f"WITH {ISLANDS} SELECT len(samples) AS n_samples, count(*) AS n FROM islands GROUP BY ALL")
def s8(spark, d):
    t = sinks.consensus_table(u_islands(spark, d)).select("chrom", "start_pos", "end_pos", "num_samples", "samples", F.lit("U").alias("summary_labels"), "size", F.col("samples").alias("contributing_samples"))
    got = files.read_consensus(spark, wrote(spark, t, header=True))
    return got.groupBy(F.size("samples").cast("bigint").alias("n_samples")).agg(F.count(F.lit(1)).alias("n"))


@query("s8_rejected_rows", f"WITH {ISLANDS} SELECT start_pos % 5 <> 0 AND start_pos % 7 <> 0 AS ok, count(*) AS n FROM islands GROUP BY ALL")
def s8_rejected(spark, d):
    """Rows of too few fields and rows whose end is no number are told from good ones, which may lack the last field."""
    path = scratch(spark)
    t = sinks.consensus_table(u_islands(spark, d))
    end = F.when(F.col("start_pos") % 7 == 0, "x").otherwise(F.col("end_pos").cast("string"))
    cells = [F.col("chrom"), F.col("start_pos").cast("string"), end, F.col("num_samples").cast("string"), F.col("samples"), F.lit("U"), F.col("size").cast("string")]
    t.select(F.when(F.col("start_pos") % 5 == 0, F.concat_ws("\t", *cells[:6])).otherwise(F.concat_ws("\t", *cells)).alias("value")).write.text(path)
    return files.read_consensus(spark, path, on_bad="flag").groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@query("s9_candidate_scan", f"WITH {EVIDENCE} SELECT len(us) AS n_u, len(ms) AS n_m, count(*) AS n FROM reasoned WHERE reason = 'final' GROUP BY ALL")
def s9(spark, d):
    got = files.read_candidates(spark, wrote(spark, sinks.candidate_table(final_candidates(spark, d)), header=True))
    return got.groupBy(F.size("unmethylated_samples").cast("bigint").alias("n_u"), F.size("methylated_samples").cast("bigint").alias("n_m")).agg(F.count(F.lit(1)).alias("n"))


@query("s12_sample_list", f"WITH {SEG} SELECT DISTINCT sample_id FROM seg")
def s12(spark, d):
    path = scratch(spark)
    seg(spark, d).select("sample_id").distinct().orderBy("sample_id").select(F.col("sample_id").alias("value")).coalesce(1).write.text(path)
    return files.read_sample_list(spark, path).select("sample_id")


# sinks: shaped and written, then read back


@query("k1_consensus_sink", f"WITH {ISLANDS} SELECT chrom, start_pos, end_pos, len(samples) AS num_samples, array_to_string(samples, ',') AS samples, end_pos - start_pos AS size FROM islands")
def k1(spark, d):
    path = scratch(spark)
    sinks.write_sorted(sinks.consensus_table(u_islands(spark, d)), path, sinks.genomic_order("samples"))
    return spark.read.csv(path, sep="\t", header=True, schema="chrom string, start_pos bigint, end_pos bigint, num_samples bigint, samples string, size bigint")


@query("k2_candidate_sink", f"WITH {EVIDENCE} SELECT chrom, start_pos, end_pos, end_pos - start_pos AS size, len(us) AS num_unmethylated, len(ms) AS num_methylated, CASE WHEN len(us) = 0 THEN '.' ELSE array_to_string(us, ',') END AS unmethylated_samples, CASE WHEN len(ms) = 0 THEN '.' ELSE array_to_string(ms, ',') END AS methylated_samples FROM evidence")
def k2(spark, d):
    path = wrote(spark, sinks.candidate_table(K.sample_evidence(kept_islands(spark, d), seg(spark, d))), header=True)
    return spark.read.csv(path, sep="\t", header=True, schema="chrom string, start_pos bigint, end_pos bigint, size bigint, num_unmethylated bigint, num_methylated bigint, unmethylated_samples string, methylated_samples string")


@query("k4_partitioned_regions", f"WITH {SEG} SELECT hap, label, sample_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM seg GROUP BY ALL")
def k4(spark, d):
    path = wrote(spark, seg(spark, d), partition=["hap", "label", "sample_id"])
    got = spark.read.csv(path, sep="\t", schema="chrom string, start_pos bigint, end_pos bigint, size bigint, hap string, label string, sample_id string")
    return got.groupBy("hap", "label", "sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def bed_file(spark, bed):
    """Browser rows written in genomic order and read back."""
    path = scratch(spark)
    sinks.write_sorted(bed, path, sinks.genomic_order("name"), header=False)
    return spark.read.csv(path, sep="\t", schema=bed.schema)


@query("k7_browser_bed9", f"WITH {SEG} SELECT chrom, start_pos, end_pos, label AS name, 1000 AS score, '.' AS strand, start_pos AS thick_start, end_pos AS thick_end, CASE label WHEN 'M' THEN '255,0,0' WHEN 'U' THEN '0,0,255' ELSE '0,0,0' END AS rgb FROM seg")
def k7(spark, d):
    return bed_file(spark, sinks.bed9(seg(spark, d)))


@query("k7_consensus_bed9", f"WITH {ISLANDS} SELECT chrom, start_pos, end_pos, chrom || ':' || start_pos || '-' || end_pos AS name, 0 AS score, '.' AS strand, start_pos AS thick_start, end_pos AS thick_end, '0,255,0' AS rgb FROM islands")
def k7c(spark, d):
    return bed_file(spark, sinks.bed9(u_islands(spark, d).withColumn("key", C.region_key()), "key", 0, F.lit("0,255,0")))


@query("k8_sorted_cohort", f"WITH {SEG} SELECT chrom, start_pos, end_pos, label, sample_id, hap FROM seg")
def k8(spark, d):
    """All samples of a haplotype in genomic order, a folder per haplotype, written twice over and read back."""
    path, kind = scratch(spark), "chrom string, start_pos bigint, end_pos bigint, label string, sample_id string, hap string"
    for _ in range(2):
        sinks.write_sorted(seg(spark, d).select("chrom", "start_pos", "end_pos", "label", "sample_id", "hap"), path, sinks.genomic_order("sample_id", "label"), header=False, partition=["hap"])
    return spark.read.csv(path, sep="\t", schema=kind)


# projections and filters

ORDER = "CASE WHEN chrom = 'chrX' THEN 23 WHEN chrom = 'chrY' THEN 24 WHEN chrom = 'chrM' THEN 25 ELSE CAST(substr(chrom, 4) AS INT) END"


@query("p1_p2_p13_p15_p16_projection", f"WITH {SEG} SELECT chrom, start_pos, end_pos, size, hap || '_' || label AS label2, (start_pos + end_pos) / 2.0::DOUBLE AS mid, chrom || ':' || start_pos || '-' || end_pos AS region, {ORDER} AS chrom_rank, sample_id FROM seg")
def p1(spark, d):
    return seg(spark, d).select("chrom", "start_pos", "end_pos", "size", C.combined_label(F.col("hap"), F.col("label")).alias("label2"), C.midpoint().alias("mid"), C.region_key().alias("region"), C.chrom_order(F.col("chrom")).alias("chrom_rank"), "sample_id")


@query("p3_p4_p5_p6_filters", f"WITH {SEG} SELECT chrom, start_pos, end_pos, sample_id FROM seg WHERE hap = 'H2' AND label = 'M' AND chrom <> 'chrY' AND size > 0")
def p3(spark, d):
    return seg(spark, d).filter(F.startswith("hap", F.lit("H2")) & (F.col("label") == "M") & F.col("chrom").isin([c for c in C.STANDARD if c != "chrY"]) & C.valid_region()).select("chrom", "start_pos", "end_pos", "sample_id")


@query("p14_status_colour", f"WITH {SEG} SELECT CASE label WHEN 'M' THEN '255,0,0' WHEN 'U' THEN '0,0,255' ELSE '0,0,0' END AS rgb, count(*) AS n FROM seg GROUP BY ALL")
def p14(spark, d):
    return seg(spark, d).groupBy(C.status_colour(F.col("label")).alias("rgb")).agg(F.count(F.lit(1)).alias("n"))


@query("p17_ratio_text", f"WITH {SEG} SELECT sample_id, printf('%d/%d (%.1f%%)', sum(CASE WHEN label = 'M' THEN 1 ELSE 0 END)::BIGINT, count(*), sum(CASE WHEN label = 'M' THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*)) AS ratio FROM seg GROUP BY sample_id")
def p17(spark, d):
    return seg(spark, d).groupBy("sample_id").agg(F.count_if(F.col("label") == "M").alias("m"), F.count(F.lit(1)).alias("n")).select("sample_id", C.ratio_text(F.col("m"), F.col("n")).alias("ratio"))


@query("p18_sample_restriction", f"WITH {SEG}, few AS (SELECT DISTINCT 'S' || (c_custkey % 6) AS sample_id FROM customer) SELECT chrom, start_pos, end_pos, sample_id FROM seg WHERE sample_id IN (SELECT sample_id FROM few)")
def p18(spark, d):
    few = view(spark, d, "customer").select(F.concat(F.lit("S"), (F.col("c_custkey") % 6).cast("string")).alias("sample_id")).distinct()
    return seg(spark, d).join(few, "sample_id", "left_semi").select("chrom", "start_pos", "end_pos", "sample_id")


# joins


@query("j3_containment", f"WITH {ISLANDS} SELECT i.chrom, i.hap, i.start_pos, i.end_pos, s.sample_id, s.start_pos AS m_start, s.end_pos AS m_end FROM islands i JOIN seg s ON s.chrom = i.chrom AND s.hap = i.hap AND s.label = 'M' AND s.start_pos <= i.start_pos AND s.end_pos >= i.end_pos")
def j3(spark, d):
    out = I.containment_join(u_islands(spark, d).select("chrom", "hap", "start_pos", "end_pos"), seg(spark, d).filter("label = 'M'"), ("chrom", "hap"))
    return out.select("chrom", "hap", "start_pos", "end_pos", F.col("b_sample_id").alias("sample_id"), F.col("b_start_pos").alias("m_start"), F.col("b_end_pos").alias("m_end"))


@query("j4_overlap", f"WITH {SEG} SELECT a.chrom, a.hap, a.start_pos, a.end_pos, a.sample_id, b.start_pos AS u_start, b.end_pos AS u_end, b.sample_id AS u_sample FROM seg a JOIN seg b ON a.chrom = b.chrom AND a.hap = b.hap AND a.label = 'M' AND b.label = 'U' AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos")
def j4(spark, d):
    s = seg(spark, d)
    out = I.overlap_join(s.filter("label = 'M'"), s.filter("label = 'U'"), ("chrom", "hap"))
    return out.select("chrom", "hap", "start_pos", "end_pos", "sample_id", F.col("b_start_pos").alias("u_start"), F.col("b_end_pos").alias("u_end"), F.col("b_sample_id").alias("u_sample"))


@query("j5_superset_check", f"WITH {EVIDENCE} SELECT chrom, hap, start_pos, end_pos, len(list_filter(samples, lambda x: NOT list_contains(us, x))) = 0 AS consistent FROM evidence")
def j5(spark, d):
    e = K.sample_evidence(kept_islands(spark, d), seg(spark, d))
    return e.select("chrom", "hap", "start_pos", "end_pos", (F.size(F.array_except("samples", "unmethylated_samples")) == 0).alias("consistent"))


@query("j11_density_overlap", f"WITH {SEG}, b AS (SELECT *, unnest(range(start_pos // 10000, (end_pos - 1) // 10000 + 1)) AS bin FROM seg WHERE size > 0) SELECT chrom, sample_id, bin, round(sum(least(end_pos, (bin + 1) * 10000) - greatest(start_pos, bin * 10000)) / 10000.0::DOUBLE, 6) AS density FROM b GROUP BY ALL")
def j11(spark, d):
    out = stats.density_overlap(seg(spark, d).filter("size > 0"), ["chrom", "sample_id"], 10_000)
    return out.select("chrom", "sample_id", "bin", R("density").alias("density"))


@query("j12_feature_annotation", f"WITH {ISLANDS}, {dimensions.features_sql()} SELECT i.chrom, i.hap, i.start_pos, i.end_pos, f.feature, f.kind FROM islands i LEFT JOIN features f ON i.chrom = f.chrom AND i.start_pos < f.f_end AND f.f_start < i.end_pos")
def j12(spark, d):
    return I.annotate_features(u_islands(spark, d).select("chrom", "hap", "start_pos", "end_pos"), dimensions.features(spark))


@query("j13_completion", f"WITH {SEG}, {dimensions.sizes_sql()}, k AS (SELECT DISTINCT sample_id, label FROM seg) SELECT k.sample_id, k.label, z.chrom, count(s.chrom) AS n FROM k CROSS JOIN chrom_sizes z LEFT JOIN seg s ON s.sample_id = k.sample_id AND s.label = k.label AND s.chrom = z.chrom GROUP BY ALL")
def j13(spark, d):
    """Regions per sample, label and chromosome, 0 where there are none; samples x labels x chromosomes is a small table."""
    got = seg(spark, d).groupBy("sample_id", "label", "chrom").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in dimensions.CHROM_SIZES])
    whole = got.select("sample_id", "label").distinct().withColumn("chrom", F.explode(names))
    return stats.complete(got, whole, ["sample_id", "label", "chrom"], ["n"])


@query("j14_haplotype_pairing", f"WITH {SEG}, p AS (SELECT chrom, sample_id, label FROM seg GROUP BY ALL HAVING count(DISTINCT hap) = 2) SELECT chrom, sample_id, label, hap, count(*) AS n FROM seg SEMI JOIN p USING (chrom, sample_id, label) GROUP BY ALL")
def j14(spark, d):
    """Only samples with both haplotypes' files, one per chromosome and label here."""
    k, keys = seg(spark, d), ["chrom", "sample_id", "label"]
    both = k.groupBy(*keys).agg(F.count_distinct("hap").alias("h")).filter("h = 2")
    return k.join(both, keys, "left_semi").groupBy(*keys, "hap").agg(F.count(F.lit(1)).alias("n"))


@query("j14_sample_pairing", f"WITH {SEG}, few AS (SELECT * FROM seg WHERE NOT (sample_id IN ('S1', 'S2') AND hap = 'H2') AND NOT (sample_id IN ('S2', 'S3') AND hap = 'H1')), p AS (SELECT sample_id, count(DISTINCT hap) AS h FROM few GROUP BY ALL) SELECT sample_id, hap, h = 2 AS both, count(*) AS n FROM few JOIN p USING (sample_id) GROUP BY ALL")
def j14_samples(spark, d):
    """Samples with files of both haplotypes, and those with either, which the weaker form keeps."""
    s, h = F.col("sample_id"), F.col("hap")
    few = seg(spark, d).filter(~(s.isin("S1", "S2") & (h == "H2")) & ~(s.isin("S2", "S3") & (h == "H1")))
    both, either = (I.paired(few, least).groupBy("sample_id", "hap").agg(F.count(F.lit(1)).alias("n")) for least in (2, 1))
    return either.join(both.select("sample_id", "hap", F.lit(True).alias("both")), ["sample_id", "hap"], "left").select("sample_id", "hap", F.coalesce("both", F.lit(False)).alias("both"), "n")


# aggregations


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: R(c) for c in cols})


@query("g1_sample_size_stats", f"WITH {ISLANDS} SELECT hap, label, sample_id, count(*) AS n, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 6) AS std_size FROM seg GROUP BY ALL UNION ALL SELECT hap, 'consensus', 'consensus', count(*), round(avg(end_pos - start_pos), 6), round(stddev_pop(end_pos - start_pos), 6) FROM islands GROUP BY hap")
def g1(spark, d):
    """Per sample, and the consensus as one more row of each haplotype."""
    c = u_islands(spark, d).select("hap", F.lit("consensus").alias("label"), F.lit("consensus").alias("sample_id"), (F.col("end_pos") - F.col("start_pos")).alias("size"))
    both = seg(spark, d).select("hap", "label", "sample_id", "size").unionByName(c)
    return rounded(stats.size_stats(both, ["hap", "label", "sample_id"]), "mean_size", "std_size")


@query("g2_cohort_averages", f"WITH {SEG}, p AS (SELECT hap, label, sample_id, count(*) AS n, avg(size) AS m FROM seg GROUP BY ALL) SELECT hap, label, round(avg(n), 6) AS mean_n, round(stddev_pop(n), 6) AS std_n, round(avg(m), 6) AS mean_size, round(stddev_pop(m), 6) AS std_size FROM p GROUP BY hap, label")
def g2(spark, d):
    p = stats.size_stats(seg(spark, d), ["hap", "label", "sample_id"])
    return p.groupBy("hap", "label").agg(R(F.avg("n")).alias("mean_n"), R(F.stddev_pop("n")).alias("std_n"), R(F.avg("mean_size")).alias("mean_size"), R(F.stddev_pop("mean_size")).alias("std_size"))


@query("g5_state_pivot", f"WITH {SEG} SELECT sample_id, " + ", ".join(f"count(*) FILTER (hap = '{h}' AND label = '{x}') AS {h}_{x}" for h in ("H1", "H2") for x in "MU") + " FROM seg GROUP BY sample_id")
def g5(spark, d):
    s = seg(spark, d).withColumn("state", C.combined_label(F.col("hap"), F.col("label")))
    return stats.state_pivot(s, "sample_id", "state", ["H1_M", "H1_U", "H2_M", "H2_U"])


@query("g6_group_summary", f"WITH {SEG} SELECT sample_id, hap, label, count(*) AS n, round(avg(size), 6) AS mean_size, round(coalesce(stddev_samp(size), 0), 6) AS std_size FROM seg WHERE label IN ('M', 'U') GROUP BY ALL")
def g6(spark, d):
    return rounded(stats.size_stats(seg(spark, d).filter("label in ('M', 'U')"), ["sample_id", "hap", "label"], ddof=1), "mean_size", "std_size")


@query("g7_category_stats", f"WITH {SEG} SELECT hap || '_' || label AS category, count(*) AS n, round(avg(size), 2) AS mean_size, round(stddev_samp(size), 2) AS std_size FROM seg WHERE label <> 'NoData' GROUP BY ALL")
def g7(spark, d):
    s = seg(spark, d).filter("label <> 'NoData'").withColumn("category", C.combined_label(F.col("hap"), F.col("label")))
    return stats.size_stats(s, ["category"], ddof=1, digits=2)


FOUR = [f"Hap{h}-{x}" for h in (1, 2) for x in "MU"]


@query("g7_completed_categories", f"WITH {SEG}, k AS (SELECT 'Hap' || substr(hap, 2) || '-' || label AS category, sample_id, size FROM seg WHERE NOT (hap = 'H2' AND CAST(substr(sample_id, 2) AS INT) % 2 = 1)), c AS (SELECT sample_id, unnest({FOUR}) AS category FROM (SELECT DISTINCT sample_id FROM seg)) SELECT c.sample_id, c.category, count(size) AS n, round(coalesce(avg(size), 0), 2) AS mean_size, round(coalesce(stddev_samp(size), 0), 2) AS std_size FROM c LEFT JOIN k ON k.sample_id = c.sample_id AND k.category = c.category GROUP BY ALL")
def g7_completed(spark, d):
    """Every sample has all four categories, 0 where it has no region; every second sample lacks a haplotype here."""
    s = seg(spark, d).withColumn("category", F.concat_ws("-", F.concat(F.lit("Hap"), F.substring("hap", 2, 1)), "label"))
    own = s.filter(~((F.col("hap") == "H2") & (F.substring("sample_id", 2, 9).cast("int") % 2 == 1)))
    got = stats.size_stats(own.filter(F.col("category").isin(FOUR)), ["sample_id", "category"], ddof=1, digits=2)
    whole = s.select("sample_id").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in FOUR])))
    return stats.complete(got, whole, ["sample_id", "category"], ["n", "mean_size", "std_size"])


@query("g8_category_by_chrom", f"WITH {SEG} SELECT chrom, " + ", ".join(f"count(*) FILTER (hap = '{h}' AND label = '{x}') AS {h}_{x}" for h in ("H1", "H2") for x in "MU") + " FROM seg GROUP BY chrom")
def g8(spark, d):
    s = seg(spark, d).withColumn("state", C.combined_label(F.col("hap"), F.col("label")))
    return stats.state_pivot(s, "chrom", "state", ["H1_M", "H1_U", "H2_M", "H2_U"])


@query("g9_sample_profile", f"WITH {SEG} SELECT sample_id, count(*) AS n, round(avg(size), 2) AS mean_size, median(size) AS median_size, round(stddev_samp(size), 2) AS std_size, count(DISTINCT chrom) AS n_chrom FROM seg GROUP BY sample_id")
def g9(spark, d):
    own = seg(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), R(F.avg("size"), 2).alias("mean_size"), R(F.stddev_samp("size"), 2).alias("std_size"), F.count_distinct("chrom").alias("n_chrom"))
    mid = stats.quantiles(seg(spark, d), "size", ["sample_id"], [0.5]).select("sample_id", F.col("q0").alias("median_size"))
    return own.join(mid, "sample_id")


@query("g10_regions_per_chrom", f"WITH {SEG}, k AS (SELECT chrom, sample_id, count(*) AS n FROM seg GROUP BY ALL) SELECT chrom, min(n) AS low, quantile_cont(n, 0.5) AS mid, max(n) AS high FROM k GROUP BY chrom")
def g10(spark, d):
    k = seg(spark, d).groupBy("chrom", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("chrom").agg(F.min("n").alias("low"), F.percentile("n", F.lit(0.5)).alias("mid"), F.max("n").alias("high"))


@query("g11_global_stats", f"WITH {SEG} SELECT hap || '_' || label AS condition, sample_id, count(*) AS total, round(avg(size), 6) AS mean_size, median(size) AS median_size, round(stddev_samp(size), 6) AS std_size, min(size) AS min_size, max(size) AS max_size, " + ", ".join(f"count(*) FILTER (chrom = '{c}') AS {c}" for c in C.STANDARD) + " FROM seg GROUP BY ALL")
def g11(spark, d):
    s, by = seg(spark, d).withColumn("condition", C.combined_label(F.col("hap"), F.col("label"))), ["condition", "sample_id"]
    per = [F.count_if(F.col("chrom") == c).alias(c) for c in C.STANDARD]
    own = s.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), R(F.avg("size")).alias("mean_size"), R(F.stddev_samp("size")).alias("std_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), *per)
    return own.join(stats.quantiles(s, "size", by, [0.5]).select(*by, F.col("q0").alias("median_size")), by)


@query("g11_cohort_rollup", f"WITH {SEG}, p AS (SELECT hap || '_' || label AS condition, sample_id, count(*) AS total, avg(size) AS m, min(size) AS lo, max(size) AS hi FROM seg GROUP BY ALL) SELECT condition, round(avg(total), 6) AS mean_total, round(avg(m), 6) AS mean_size, min(lo) AS min_size, max(hi) AS max_size FROM p GROUP BY condition")
def g11_rollup(spark, d):
    s = seg(spark, d).withColumn("condition", C.combined_label(F.col("hap"), F.col("label")))
    per = s.groupBy("condition", "sample_id").agg(F.count(F.lit(1)).alias("total"), F.avg("size").alias("mean_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))
    return per.groupBy("condition").agg(R(F.avg("total")).alias("mean_total"), R(F.avg("mean_size")).alias("mean_size"), F.min("min_size").alias("min_size"), F.max("max_size").alias("max_size"))


BINNED = f"{SEG}, {dimensions.sizes_sql()}, binned AS (SELECT s.*, chrom_size, CAST(least(199, floor((start_pos + end_pos) / 2.0::DOUBLE / (chrom_size / 200.0::DOUBLE))) AS INT) AS bin FROM seg s JOIN chrom_sizes USING (chrom))"


@query("g12_bin_stats", f"WITH {BINNED}, per AS (SELECT chrom, bin, sample_id, count(*) AS k FROM binned GROUP BY ALL), c AS (SELECT chrom, bin, sum(k) AS n, sum(k * k) AS k2 FROM per GROUP BY ALL), z AS (SELECT chrom, bin, avg(size) AS ms, stddev_pop(size) AS ss, min(size) AS min_size, max(size) AS max_size, quantile_cont(size, 0.5) AS median_size FROM binned GROUP BY ALL), t AS (SELECT count(DISTINCT sample_id) AS s FROM seg) SELECT chrom, bin, CAST(n AS BIGINT) AS n, round(n / s, 4) AS mean_count, round(sqrt(greatest(0.0, k2 / s - (n / s) * (n / s))), 4) AS std_count, round(ms, 4) AS mean_size, round(ss, 4) AS std_size, min_size, max_size, median_size FROM c JOIN z USING (chrom, bin), t")
def g12(spark, d):
    out = stats.bin_stats(seg(spark, d), dimensions.chrom_sizes(spark), 200)
    return out.withColumns({c: R(c, 4) for c in ("mean_count", "std_count", "mean_size", "std_size")})


@query("g13_density_matrix", f"WITH {BINNED} SELECT sample_id, chrom, bin, count(*) AS n, round(avg(size), 6) AS mean_size FROM binned GROUP BY ALL")
def g13(spark, d):
    return rounded(stats.bin_matrix(seg(spark, d), dimensions.chrom_sizes(spark), 200, ["sample_id"]), "mean_size")


CELLS = "cells AS (SELECT k.label, k.sample_id, z.chrom, r.bin, count(b.bin) AS n FROM (SELECT * FROM (SELECT DISTINCT label FROM seg), (SELECT DISTINCT sample_id FROM seg)) k CROSS JOIN chrom_sizes z CROSS JOIN (SELECT unnest(range(0, 200))::INT AS bin) r LEFT JOIN binned b ON b.label = k.label AND b.sample_id = k.sample_id AND b.chrom = z.chrom AND b.bin = r.bin GROUP BY ALL)"


@query("g13_density_rollup", f"WITH {BINNED}, {CELLS} SELECT label, chrom, bin, round(avg(n), 6) AS mean_count, round(stddev_pop(n), 6) AS std_count FROM cells GROUP BY ALL HAVING sum(n) > 0")
def g13_rollup(spark, d):
    """Mean and population std over all samples of each bin with regions."""
    return rounded(stats.bin_rollup(seg(spark, d), dimensions.chrom_sizes(spark), 200, "label")[0], "mean_count", "std_count")


@query("g13_density_p95", f"WITH {BINNED}, {CELLS} SELECT label, chrom, quantile_cont(n, 0.95) AS p95 FROM cells GROUP BY ALL HAVING sum(n) > 0")
def g13_p95(spark, d):
    """95th percentile of all cells, samples x bins, of a chromosome's matrix."""
    return stats.bin_rollup(seg(spark, d), dimensions.chrom_sizes(spark), 200, "label")[1]


@query("g14_chrom_coverage", f"WITH {SEG}, {dimensions.sizes_sql()} SELECT chrom, hap, label, round(sum(size) * 100.0::DOUBLE / chrom_size, 6) AS percent FROM seg JOIN chrom_sizes USING (chrom) GROUP BY chrom, hap, label, chrom_size")
def g14(spark, d):
    j = seg(spark, d).join(F.broadcast(dimensions.chrom_sizes(spark)), "chrom").groupBy("chrom", "hap", "label", "chrom_size").agg(F.sum("size").alias("s"))
    return j.select("chrom", "hap", "label", R(F.col("s") * 100.0 / F.col("chrom_size")).alias("percent"))


@query("g15_linear_histogram", f"WITH {SEG}, e AS (SELECT min(size)::DOUBLE AS lo, max(size)::DOUBLE AS hi FROM seg), b AS (SELECT CAST(least(49, floor((size - lo) / ((hi - lo) / 50))) AS INT) AS bin FROM seg, e) SELECT r.bin::INT AS bin, count(b.bin) AS n FROM (SELECT unnest(range(0, 50)) AS bin) r LEFT JOIN b ON r.bin = b.bin GROUP BY r.bin")
def g15(spark, d):
    return stats.histogram(seg(spark, d), "size", 50)


def hist_sql(src: str, by: str, n: int, lo: str = "min(v)", hi: str = "max(v)") -> str:
    """A histogram of ``src`` (by, v, ...) for each group, as numpy bins it."""
    return f"{src}, e0 AS (SELECT {by}, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM src WHERE v IS NOT NULL GROUP BY {by}), e AS (SELECT {by}, CASE WHEN lo = hi THEN lo - 0.5::DOUBLE ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5::DOUBLE ELSE hi END AS hi FROM e0), b AS (SELECT {by}, CAST(least({n - 1}, floor((v - lo) / ((hi - lo) / {n}))) AS INT) AS bin FROM src JOIN e USING ({by}) WHERE v BETWEEN lo AND hi), g AS (SELECT {by}, unnest(range(0, {n}))::INT AS bin FROM e), k AS (SELECT {by}, bin, count(*) AS n FROM b GROUP BY {by}, bin) SELECT {by}, bin, coalesce(n, 0) AS n FROM g LEFT JOIN k USING ({by}, bin)"


@query("g15_score_histogram", f"WITH {duck('pileup')}, {hist_sql('src AS (SELECT sample_id, hap, mod_score::DOUBLE AS v FROM pileup)', 'sample_id, hap', 20, '0', '100')}")
def g15_scores(spark, d):
    """Scores of each sample's track in steps of 5 from 0 to 100."""
    return stats.histogram_by(view(spark, d, "pileup"), F.col("mod_score"), 20, ["sample_id", "hap"], F.lit(0), F.lit(100))


@query("g15_pileup_histograms", f"WITH {duck('pileup')}, {hist_sql(chr(39).join(['src AS (SELECT hap, ', 'mod_probability', ' AS metric, mod_probability AS v FROM pileup UNION ALL SELECT hap, ', 'coverage', ', coverage FROM pileup)']), 'hap, metric', 50)}")
def g15_pileup(spark, d):
    """Probability and coverage of each track in 50 bins."""
    long = view(spark, d, "pileup").select("hap", F.col("mod_probability").cast("double").alias("mod_probability"), F.col("coverage").cast("double").alias("coverage")).unpivot(["hap"], ["mod_probability", "coverage"], "metric", "v")
    return stats.histogram_by(long, F.col("v"), 50, ["hap", "metric"])


@query("g15_gap_histogram", f"WITH {SEG}, {hist_sql('src AS (SELECT hap, start_pos - lag(start_pos) OVER (PARTITION BY hap, chrom, sample_id ORDER BY start_pos, end_pos) AS v FROM seg)', 'hap', 50)}")
def g15_gaps(spark, d):
    return stats.histogram_by(stats.gaps(seg(spark, d), ["hap", "chrom", "sample_id"]), F.col("gap"), 50, ["hap"])


@query("g15_position_histograms", f"WITH {SEG}, {hist_sql('src AS (SELECT sample_id, chrom, (start_pos + end_pos) / 2.0::DOUBLE AS v FROM seg)', 'sample_id, chrom', 100)}")
def g15_positions(spark, d):
    """Midpoints of a sample's regions on each chromosome in 100 bins between the first and the last."""
    return stats.histogram_by(seg(spark, d), C.midpoint(), 100, ["sample_id", "chrom"])


@query("g15_chromosome_histograms", f"WITH {SEG}, {dimensions.sizes_sql()}, {hist_sql('src AS (SELECT label, chrom, (start_pos + end_pos) / 2.0::DOUBLE AS v, chrom_size FROM seg JOIN chrom_sizes USING (chrom))', 'label, chrom', 500, '0', 'any_value(chrom_size)')}")
def g15_chromosomes(spark, d):
    """Midpoints in 500 bins over the whole of each chromosome."""
    s = seg(spark, d).join(F.broadcast(dimensions.chrom_sizes(spark)), "chrom")
    return stats.histogram_by(s, C.midpoint(), 500, ["label", "chrom"], F.lit(0), F.col("chrom_size"))


@query("g16_log_histogram", f"WITH {SEG}, k AS (SELECT log10(size::DOUBLE) AS v FROM seg WHERE size > 0), e AS (SELECT min(v) AS lo, max(v) AS hi FROM k), b AS (SELECT CAST(least(48, floor((v - lo) / ((hi - lo) / 49))) AS INT) AS bin FROM k, e) SELECT r.bin::INT AS bin, count(b.bin) AS n FROM (SELECT unnest(range(0, 49)) AS bin) r LEFT JOIN b ON r.bin = b.bin GROUP BY r.bin")
def g16(spark, d):
    return stats.histogram(seg(spark, d).filter("size > 0"), "size", 49, log=True)


@query("g17_describe", f"WITH {SEG} SELECT label, count(size) AS n, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std, min(size)::DOUBLE AS min, quantile_cont(size, 0.25) AS q25, quantile_cont(size, 0.5) AS q50, quantile_cont(size, 0.75) AS q75, max(size)::DOUBLE AS max FROM seg GROUP BY label")
def g17(spark, d):
    return rounded(stats.describe(seg(spark, d), "size", ["label"]), "mean", "std")


@query("g17_position_quantiles", f"WITH {SEG} SELECT label, hap, count(*) AS n, round(quantile_cont(start_pos, 0.05), 4) AS q05, round(quantile_cont(start_pos, 0.25), 4) AS q25, round(quantile_cont(start_pos, 0.5), 4) AS q50, round(quantile_cont(start_pos, 0.75), 4) AS q75, round(quantile_cont(start_pos, 0.95), 4) AS q95 FROM seg GROUP BY ALL")
def g17_positions(spark, d):
    """Quantiles of positions, nearly all of which differ."""
    q = stats.quantiles(seg(spark, d), "start_pos", ["label", "hap"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return q.select("label", "hap", "n", *[R(f"q{i}", 4).alias(c) for i, c in enumerate(("q05", "q25", "q50", "q75", "q95"))])


@query("g18_sample_frequency", f"WITH {EVIDENCE}, c AS (SELECT hap, len(us) AS u, len(ms) AS m FROM reasoned WHERE reason = 'final'), k AS (SELECT hap, 'num_unmethylated' AS metric, u AS v FROM c UNION ALL SELECT hap, 'num_methylated', m FROM c UNION ALL SELECT hap, 'total_samples', u + m FROM c), r AS (SELECT hap, metric, unnest(range(0, top + 1)) AS value FROM (SELECT metric, max(v) AS top FROM k GROUP BY metric), (SELECT DISTINCT hap FROM k)) SELECT r.hap, r.metric, r.value::INT AS value, count(k.v) AS n FROM r LEFT JOIN k ON k.hap = r.hap AND k.metric = r.metric AND k.v = r.value GROUP BY r.hap, r.metric, r.value")
def g18(spark, d):
    u, m = F.size("unmethylated_samples"), F.size("methylated_samples")
    c = final_candidates(spark, d).select("hap", u.alias("num_unmethylated"), m.alias("num_methylated"), (u + m).alias("total_samples"))
    return stats.frequency(c, ["num_unmethylated", "num_methylated", "total_samples"], "hap")


@query("g19_candidate_stats", f"WITH {EVIDENCE}, k AS (SELECT *, end_pos - start_pos AS size FROM reasoned WHERE reason = 'final') SELECT count(*) AS total, round(avg(len(us)), 6) AS mean_u, median(len(us)) AS median_u, round(avg(len(ms)), 6) AS mean_m, median(len(ms)) AS median_m, round(avg(size), 6) AS mean_size, median(size) AS median_size, CAST(sum(size) AS BIGINT) AS bases FROM k")
def g19(spark, d):
    k = final_candidates(spark, d).select(F.size("unmethylated_samples").alias("u"), F.size("methylated_samples").alias("m"), (F.col("end_pos") - F.col("start_pos")).alias("size"))
    return k.agg(F.count(F.lit(1)).alias("total"), R(F.avg("u")).alias("mean_u"), F.median("u").alias("median_u"), R(F.avg("m")).alias("mean_m"), F.median("m").alias("median_m"), R(F.avg("size")).alias("mean_size"), F.median("size").alias("median_size"), F.sum("size").alias("bases"))


@query("k9_region_report", f"WITH {EVIDENCE}, k AS (SELECT hap, len(us) AS u, len(ms) AS m FROM reasoned WHERE reason = 'final'), f AS (SELECT hap, count(*)::DOUBLE AS total_regions, round(avg(u), 2) AS mean_unmethylated, round(avg(m), 2) AS mean_methylated, median(u)::DOUBLE AS median_unmethylated, median(m)::DOUBLE AS median_methylated FROM k GROUP BY hap) SELECT hap, metric, value FROM (UNPIVOT f ON total_regions, mean_unmethylated, mean_methylated, median_unmethylated, median_methylated INTO NAME metric VALUE value)")
def k9_regions(spark, d):
    """The report on samples per candidate region of each haplotype."""
    u, m = F.size("unmethylated_samples"), F.size("methylated_samples")
    f = final_candidates(spark, d).groupBy("hap").agg(F.count(F.lit(1)).cast("double").alias("total_regions"), R(F.avg(u), 2).alias("mean_unmethylated"), R(F.avg(m), 2).alias("mean_methylated"), F.median(u).alias("median_unmethylated"), F.median(m).alias("median_methylated"))
    return f.unpivot(["hap"], f.columns[1:], "metric", "value")


@query("g20_regions_per_chrom_hap", f"WITH {ISLANDS} SELECT chrom, count(*) FILTER (hap = 'H1') AS H1, count(*) FILTER (hap = 'H2') AS H2 FROM islands GROUP BY chrom")
def g20(spark, d):
    return stats.state_pivot(u_islands(spark, d), "chrom", "hap", ["H1", "H2"])


@query("g23_filter_reasons", f"WITH {EVIDENCE} SELECT reason, count(*) AS n FROM reasoned GROUP BY reason")
def g23(spark, d):
    return K.reasons(K.sample_evidence(kept_islands(spark, d), seg(spark, d))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("g28_mean_size_by_group", f"WITH {SEG} SELECT sample_id, hap, label, round(avg(size), 6) AS mean_size, count(*) AS n FROM seg GROUP BY ALL")
def g28(spark, d):
    return seg(spark, d).groupBy("sample_id", "hap", "label").agg(R(F.avg("size")).alias("mean_size"), F.count(F.lit(1)).alias("n"))


@query("g29_reshape", f"WITH {SEG}, w AS (SELECT sample_id, hap, count(*)::DOUBLE AS n, avg(size) AS mean, var_samp(size) AS v FROM seg GROUP BY ALL) SELECT sample_id, hap, 'count' AS metric, round(n, 6) AS value FROM w UNION ALL SELECT sample_id, hap, 'mean', round(mean, 6) FROM w UNION ALL SELECT sample_id, hap, 'std', round(sqrt(v), 6) FROM w")
def g29(spark, d):
    w = seg(spark, d).groupBy("sample_id").pivot("hap", ["H1", "H2"]).agg(F.count(F.lit(1)).cast("double").alias("count"), F.avg("size").alias("mean"), F.var_samp("size").alias("variance"))
    long = w.unpivot("sample_id", [c for c in w.columns if c != "sample_id"], "k", "value")
    v = F.when(F.endswith("k", F.lit("variance")), F.sqrt("value")).otherwise(F.col("value"))
    return long.select("sample_id", F.substring("k", 1, 2).alias("hap"), F.regexp_replace(F.substring("k", 4, 20), "variance", "std").alias("metric"), R(v).alias("value"))


# windows


@query("w1_gaps", f"WITH {SEG}, k AS (SELECT *, start_pos - lag(start_pos) OVER (PARTITION BY chrom, sample_id ORDER BY start_pos, end_pos) AS gap FROM seg) SELECT chrom, count(gap) AS n, round(avg(gap), 6) AS mean_gap, round(stddev_samp(gap), 6) AS std_gap, quantile_cont(gap, 0.5) AS mid_gap FROM k GROUP BY chrom")
def w1(spark, d):
    k = stats.gaps(seg(spark, d), ["chrom", "sample_id"])
    q = stats.quantiles(k, "gap", ["chrom"], [0.5]).select("chrom", F.col("q0").alias("mid_gap"))
    return k.groupBy("chrom").agg(F.count("gap").alias("n"), R(F.avg("gap")).alias("mean_gap"), R(F.stddev_samp("gap")).alias("std_gap")).join(q, "chrom")


@query("w2_stagger", f"WITH {SEG}, one AS (SELECT chrom, sample_id, start_pos, max(end_pos) AS end_pos FROM seg GROUP BY ALL), b AS (SELECT *, CASE WHEN start_pos < lag(end_pos) OVER w THEN 0 ELSE 1 END AS nw FROM one WINDOW w AS (PARTITION BY chrom, sample_id ORDER BY start_pos, end_pos)), r AS (SELECT *, sum(nw) OVER (PARTITION BY chrom, sample_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS run FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY chrom, sample_id, run ORDER BY start_pos, end_pos) - 1 AS off FROM r) SELECT chrom, sample_id, start_pos + off AS start_pos, end_pos + off AS end_pos, CAST(off AS INT) AS \"offset\" FROM o")
def w2(spark, d):
    return stats.stagger(seg(spark, d).groupBy("chrom", "sample_id", "start_pos").agg(F.max("end_pos").alias("end_pos")), ["chrom", "sample_id"])


@query("w3_genome_offsets", f"WITH {SEG}, t AS (SELECT chrom, max(end_pos) AS top FROM seg GROUP BY chrom), o AS (SELECT chrom, coalesce(sum(top) OVER (ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chrom_offset FROM t) SELECT chrom, start_pos, end_pos, sample_id, chrom_offset, chrom_offset + (start_pos + end_pos) / 2.0::DOUBLE AS abs_mid FROM seg JOIN o USING (chrom)")
def w3(spark, d):
    return stats.absolute_midpoints(seg(spark, d)).select("chrom", "start_pos", "end_pos", "sample_id", "chrom_offset", "abs_mid")


CLUSTER = "STRUCT(s BIGINT, e BIGINT, p VARCHAR[])"
MERGE = f"""WITH RECURSIVE {ISLANDS.replace('WITH ', '')}, r AS (SELECT chrom, hap, island, start_pos, end_pos, sample_id, row_number() OVER (PARTITION BY chrom, hap, island ORDER BY start_pos, end_pos, sample_id) AS k, count(*) OVER (PARTITION BY chrom, hap, island) AS last FROM numbered),
 st AS (SELECT DISTINCT chrom, hap, island, 0::BIGINT AS k, []::{CLUSTER}[] AS done, NULL::{CLUSTER} AS cur FROM r
  UNION ALL SELECT chrom, hap, island, k, CASE WHEN chain THEN done ELSE closed END,
   CASE WHEN chain THEN CASE WHEN list_contains(cur.p, sample_id) OR len(list_filter(done, lambda d: list_contains(d.p, sample_id) AND start_pos <= d.e + 500 AND end_pos >= d.s - 500)) > 0 THEN cur ELSE {{'s': cur.s, 'e': greatest(cur.e, end_pos), 'p': list_append(cur.p, sample_id)}}::{CLUSTER} END
    WHEN len(list_filter(closed, lambda d: list_contains(d.p, sample_id) AND start_pos <= d.e + 500 AND end_pos >= d.s - 500)) > 0 THEN NULL ELSE {{'s': start_pos, 'e': end_pos, 'p': [sample_id]}}::{CLUSTER} END
  FROM (SELECT st.chrom, st.hap, st.island, r.k, r.start_pos, r.end_pos, r.sample_id, st.done, st.cur, st.cur IS NOT NULL AND r.start_pos <= st.cur.e + 500 AS chain, CASE WHEN st.cur IS NULL THEN st.done ELSE list_append(st.done, st.cur) END AS closed FROM st JOIN r ON st.chrom = r.chrom AND st.hap = r.hap AND st.island = r.island AND r.k = st.k + 1)),
 ended AS (SELECT st.chrom, st.hap, unnest(CASE WHEN cur IS NULL THEN done ELSE list_append(done, cur) END) AS c FROM st JOIN (SELECT DISTINCT chrom, hap, island, last FROM r) l ON st.chrom = l.chrom AND st.hap = l.hap AND st.island = l.island AND st.k = l.last)
 SELECT chrom, hap, c.s AS start_pos, c.e AS end_pos, array_to_string(list_sort(c.p), ',') AS samples, len(c.p)::INT AS n_regions FROM ended"""


@query("w4_consensus_merge", MERGE)
def w4(spark, d):
    out = K.consensus_merge(seg(spark, d).filter("label = 'U'"), 500, 1)
    return out.withColumn("samples", F.array_join("samples", ","))


LONG_GAP = 200_000


@query("w4_long_islands", MERGE.replace("+ 500", f"+ {LONG_GAP}").replace("- 500", f"- {LONG_GAP}"))
def w4_long(spark, d):
    """The same with a gap that makes most of a chromosome one island, which then runs in many blocks."""
    out = K.consensus_merge(seg(spark, d).filter("label = 'U'"), LONG_GAP, 1, block=1 << 17)
    return out.withColumn("samples", F.array_join("samples", ","))


@query("w5_islands", f"WITH {ISLANDS} SELECT chrom, hap, start_pos, end_pos, array_to_string(samples, ',') AS samples, n_regions FROM islands")
def w5(spark, d):
    return u_islands(spark, d).withColumn("samples", F.array_join("samples", ","))


PILE = duck("pileup") + ", sites AS (SELECT sample_id, hap, chrom, start_pos, max(end_pos) AS end_pos, max(mod_probability) AS mod_probability FROM pileup GROUP BY ALL)"


@query("w6_segmentation", f"WITH {PILE}, m AS (SELECT *, CASE WHEN mod_probability >= 0.05 THEN 'M' ELSE 'U' END AS c FROM sites), n AS (SELECT *, CASE WHEN lag(start_pos) OVER w IS NULL OR start_pos - lag(start_pos) OVER w > 5000 OR c <> lag(c) OVER w THEN 1 ELSE 0 END AS nw FROM m WINDOW w AS (PARTITION BY sample_id, hap, chrom ORDER BY start_pos)), r AS (SELECT *, sum(nw) OVER (PARTITION BY sample_id, hap, chrom ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT sample_id, hap, chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_cpgs, CASE WHEN count(*) >= 2 THEN min(c) ELSE 'NoData' END AS label FROM r GROUP BY sample_id, hap, chrom, run")
def w6(spark, d):
    sites = view(spark, d, "pileup").groupBy("sample_id", "hap", "chrom", "start_pos").agg(F.max("end_pos").alias("end_pos"), F.max("mod_probability").alias("mod_probability"))
    return stats.segment_runs(sites, 5000, 2, 0.05)


# sorts, samples, sets


@query("t1_genomic_sort", f"WITH {ISLANDS} SELECT chrom, start_pos, end_pos, hap FROM islands")
def t1(spark, d):
    return sinks.genomic_sort(u_islands(spark, d)).select("chrom", "start_pos", "end_pos", "hap")


MS = EVIDENCE + ", ms0 AS (SELECT *, len(ms) AS m, len(us) AS u FROM evidence), scored AS (SELECT *, CASE WHEN m + u > 0 THEN (m - u) * 1.0::DOUBLE / (m + u) * log2((m + u + 1)::DOUBLE) ELSE 0.0 END AS score FROM ms0)"
BANDS = "CASE WHEN score > 1 THEN 'Strongly Methylated' WHEN score > 0.5 THEN 'Moderately Methylated' WHEN score > 0 THEN 'Weakly Methylated' WHEN score = 0 THEN 'Neutral' WHEN score > -0.5 THEN 'Weakly Unmethylated' WHEN score > -1 THEN 'Moderately Unmethylated' ELSE 'Strongly Unmethylated' END"


def region_scores(spark, d):
    e = K.sample_evidence(kept_islands(spark, d), seg(spark, d))
    m, u = F.size("methylated_samples"), F.size("unmethylated_samples")
    return e.select("chrom", "hap", "start_pos", "end_pos", m.cast("bigint").alias("m"), u.cast("bigint").alias("u"), C.region_score(m, u).alias("score"))


@query("x17_x18_region_score", f"WITH {MS} SELECT chrom, hap, start_pos, end_pos, m, u, round(score, 6) AS score, {BANDS} AS band FROM scored")
def x17(spark, d):
    return region_scores(spark, d).withColumn("band", C.score_band(F.col("score"))).withColumn("score", R("score"))


OF = lambda x: f"round(CASE WHEN m + u > 0 THEN ({x})::DOUBLE / (m + u) ELSE 0.0 END, 3)"
TEXT = C.EXPLANATION.replace("\n", "' || chr(10) || '")


@query("x19_score_text", f"WITH {MS}, f AS (SELECT *, {OF('m')} AS pm, {OF('u')} AS pu, {OF('m - u')} AS gap, round(log2((m + u + 1)::DOUBLE), 3) AS weight FROM scored) SELECT chrom, hap, start_pos, end_pos, printf('{TEXT}', m + u, m, pm, u, pu, gap, weight, gap, weight, round(score, 3), {BANDS}) AS explanation FROM f")
def x19(spark, d):
    return region_scores(spark, d).select("chrom", "hap", "start_pos", "end_pos", C.score_text(F.col("m"), F.col("u"), F.col("score")).alias("explanation"))


SHARE = lambda x: f"CASE WHEN m + u > 0 THEN ({x})::DOUBLE / (m + u) ELSE 0.0 END"
DOT = lambda x: f"CASE WHEN len({x}) = 0 THEN '.' ELSE array_to_string({x}, ',') END"


@query("x19_score_table", f"WITH {MS}, f AS (SELECT *, {OF('m')} AS pm, {OF('u')} AS pu, {OF('m - u')} AS gap, round(log2((m + u + 1)::DOUBLE), 3) AS weight FROM scored WHERE len(list_filter(samples, lambda x: NOT list_contains(us, x))) = 0 AND m > 0) SELECT chrom, start_pos, end_pos, hap, round(score, 6) AS meth_score, printf('{TEXT}', m + u, m, pm, u, pu, gap, weight, gap, weight, round(score, 3), {BANDS}) AS score_calculation, m AS num_methylated, u AS num_unmethylated, m + u AS total_samples, round({SHARE('m')}, 6) AS meth_proportion, round({SHARE('u')}, 6) AS unmeth_proportion, round({SHARE('m - u')}, 6) AS proportion_diff, round(log2((m + u + 1)::DOUBLE), 6) AS sample_weight, {BANDS} AS score_interpretation, {DOT('ms')} AS methylated_samples, {DOT('us')} AS unmethylated_samples FROM f")
def x19_table(spark, d):
    """The fifteen columns that explain each candidate's score, written in genomic order and read back."""
    t = sinks.score_table(final_candidates(spark, d), ["hap"])
    t = rounded(t, "meth_score", "meth_proportion", "unmeth_proportion", "proportion_diff", "sample_weight")
    path = scratch(spark)
    sinks.write_sorted(t.withColumn("score_calculation", F.replace("score_calculation", F.lit("\n"), F.lit("\\n"))), path, sinks.genomic_order("hap"))
    back = spark.read.csv(path, sep="\t", header=True, schema=t.schema, escape="\0")
    return back.withColumn("score_calculation", F.replace("score_calculation", F.lit("\\n"), F.lit("\n")))


KEYS = ["chrom", "hap", "start_pos", "end_pos"]


@query("t3_extreme_regions", f"WITH {MS}, r AS (SELECT *, round(score, 9) AS s FROM scored) SELECT * FROM (SELECT chrom, hap, start_pos, end_pos, 'high' AS side FROM r ORDER BY s DESC, chrom, hap, start_pos, end_pos LIMIT 50) UNION ALL SELECT * FROM (SELECT chrom, hap, start_pos, end_pos, 'low' AS side FROM r ORDER BY s, chrom, hap, start_pos, end_pos LIMIT 50)")
def t3(spark, d):
    return stats.top_regions(region_scores(spark, d).withColumn("score", R("score", 9)), "score", 100, KEYS).select(*KEYS, "side").orderBy(*sinks.genomic_order("hap"))


@query("t4_highest_coverage", f"WITH {MS} SELECT chrom, hap, start_pos, end_pos, m + u AS total_samples FROM scored ORDER BY m + u DESC, chrom, hap, start_pos, end_pos LIMIT 100")
def t4(spark, d):
    return region_scores(spark, d).select(*KEYS, (F.col("m") + F.col("u")).alias("total_samples")).orderBy(F.desc("total_samples"), *KEYS).limit(100)


HASH = "md5(concat_ws('|', '42', chrom, hap, start_pos, end_pos))"


@query("t5_random_sample", f"WITH {ISLANDS} SELECT chrom, hap, start_pos, end_pos FROM islands ORDER BY {HASH}, chrom, hap, start_pos, end_pos LIMIT 200")
def t5(spark, d):
    return stats.random_sample(u_islands(spark, d).select(*KEYS), 200, KEYS)


@query("t6_stratified_sample", f"WITH {ISLANDS}, q AS (SELECT chrom, greatest(1, count(*) * 200 // (SELECT count(*) FROM islands)) AS quota FROM islands GROUP BY chrom), r AS (SELECT chrom, hap, start_pos, end_pos, {HASH} AS h, row_number() OVER (PARTITION BY chrom ORDER BY {HASH}, chrom, hap, start_pos, end_pos) AS k FROM islands) SELECT chrom, hap, start_pos, end_pos FROM r JOIN q USING (chrom) WHERE k <= quota ORDER BY h, chrom, hap, start_pos, end_pos LIMIT 200")
def t6(spark, d):
    return stats.stratified_sample(u_islands(spark, d).select(*KEYS), 200, "chrom", KEYS)


@query("u1_union_all", f"WITH {SEG} SELECT haplotype, count(*) AS n FROM (SELECT 'H1' AS haplotype, * FROM seg WHERE hap = 'H1' UNION ALL SELECT 'H2', * FROM seg WHERE hap = 'H2') GROUP BY ALL")
def u1(spark, d):
    a, b = (seg(spark, d).filter(f"hap = '{h}'").withColumn("haplotype", F.lit(h)) for h in ("H1", "H2"))
    return a.unionByName(b).groupBy("haplotype").agg(F.count(F.lit(1)).alias("n"))


@query("u2_row_dedup", f"WITH {SEG} SELECT DISTINCT chrom, sample_id, hap, label FROM seg")
def u2(spark, d):
    return seg(spark, d).select("chrom", "sample_id", "hap", "label").dropDuplicates()


@query("u6_chromosome_universe", f"WITH {duck('segments', 'variants')} SELECT chrom FROM segments UNION SELECT chrom FROM variants")
def u6(spark, d):
    return seg(spark, d).select("chrom").union(view(spark, d, "variants").select("chrom")).distinct()


def methylated_share(spark, d):
    """(row, sample_id, v): the share of methylated segments per window of 50 kb and sample; many cells are missing."""
    s = seg(spark, d).withColumn("row", F.concat_ws(":", "chrom", F.expr("cast(start_pos div 50000 as string)")))
    return s.groupBy("row", "sample_id").agg(F.avg(F.when(F.col("label") == "M", 1.0).otherwise(0.0)).alias("v"))


def components_of(spark, d):
    """Scores and loadings of the windows' shares; the cohort is a short list."""
    rate = methylated_share(spark, d)
    return stats.pca(rate, "row", "sample_id", "v", sorted(r["sample_id"] for r in rate.select("sample_id").distinct().collect()), 2)


@query("a1_covariance", f"WITH {SEG}, r AS (SELECT chrom || ':' || (start_pos // 50000) AS row, sample_id, avg(CASE WHEN label = 'M' THEN 1.0::DOUBLE ELSE 0.0 END) AS v FROM seg GROUP BY ALL), c AS (SELECT row, sample_id, v - avg(v) OVER (PARTITION BY sample_id) AS d FROM r) SELECT x.sample_id AS a, y.sample_id AS b, round(sum(x.d * y.d) / (SELECT count(DISTINCT row) - 1 FROM r), 9) AS cov FROM c x JOIN c y USING (row) GROUP BY x.sample_id, y.sample_id")
def a1_covariance(spark, d):
    return stats.covariance(methylated_share(spark, d), "row", "sample_id", "v").withColumn("cov", R("cov", 9))


@query("a1_pca")
def a1(spark, d):
    return components_of(spark, d)[0].select("row", R("pc1", 4).alias("pc1"), R("pc2", 4).alias("pc2"))


@query("a1_pca_loadings")
def a1_loadings(spark, d):
    return components_of(spark, d)[1].select("component", "sample_id", R("loading", 4).alias("loading"), R("explained", 4).alias("explained"))
