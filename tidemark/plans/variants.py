"""Queries over variants, genotypes, nine-state counts, scores and pileup cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import consensus as K
from ..operators import effects as E
from ..operators import genotypes as G
from ..operators import sinks, states, stats
from ..sources import files
from ..sources.scratch import scratch
from ..sources.views import duck, view
from .regions import EVIDENCE, ISLANDS, R, final_candidates, kept_islands, query, seg, u_islands

VAR = duck("variants")
GEN = duck("genotypes")


def var(spark, d):
    return view(spark, d, "variants")


def gen(spark, d):
    return view(spark, d, "genotypes")


def vcf_file(spark, d, vcf_type="small"):
    """Variants of one class as VCF text, one line per site and a column per sample."""
    path = scratch(spark)
    g = gen(spark, d).filter(F.col("vcf_type") == vcf_type)
    names = [f"S{i}" for i in range(17)]
    wide = g.groupBy("chrom", "pos", "variant_id", "ref", "alt").pivot("sample_id", names).agg(F.first(F.concat("gt", F.lit(":9"))))
    fixed = [F.col("chrom"), F.col("pos").cast("string"), F.col("variant_id"), F.col("ref"), F.col("alt"), F.lit("30"), F.lit("PASS"), F.lit("DP=12"), F.lit("GT:DP")]
    body = wide.select(F.lit(1).alias("o"), F.concat_ws("\t", *fixed, *names).alias("value"))
    head = spark.createDataFrame([(0, "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names]))], "o int, value string")
    # one header line must lead each file
    parts = body.repartition(8, "value").withColumn("p", F.spark_partition_id())
    lines = parts.select("p", "o", "value").unionByName(head.crossJoin(spark.range(8).select(F.col("id").cast("int").alias("p"))).select("p", "o", "value"))
    lines.repartitionByRange(8, "p").sortWithinPartitions("p", "o").select("p", "value").write.partitionBy("p").text(path)
    return path


GT = "CASE WHEN gt = './.' THEN 'none' ELSE gt END"


@query("s10_vcf_scan", f"WITH {GEN} SELECT vcf_type, sample_id, gt, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM genotypes GROUP BY ALL")
def s10(spark, d):
    """The files of three classes; there is none of repeats, so that class is skipped."""
    paths = {t: vcf_file(spark, d, t) for t in ("small", "sv", "cnv")} | {"tr": f"{scratch(spark)}-absent"}
    return files.read_vcf_classes(spark, paths).groupBy("vcf_type", "sample_id", "gt").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"))


@query("s11_reference_chunks", "WITH " + duck("reference_seq") + " SELECT doc_id AS contig, length(seq) AS n, length(seq) - length(replace(seq, 'CG', 'C')) AS n_cg FROM reference_seq WHERE length(seq) > 0")
def s11(spark, d):
    """CG dinucleotides counted per chunk, those that begin in the overlap left to the next chunk."""
    chunks = files.reference_chunks(view(spark, d, "reference_seq").filter("length(seq) > 0"), chunk=1024, overlap=8)
    own = F.filter(C.cpg_positions(F.col("seq")), lambda i: i < 1024)
    return chunks.groupBy("contig").agg(F.sum(F.least(F.length("seq"), F.lit(1024))).alias("n"), F.sum(F.size(own)).alias("n_cg"))


@query("s14_file_list_scan", f"WITH {GEN} SELECT vcf_type, count(*) AS n FROM genotypes GROUP BY ALL")
def s14(spark, d):
    """The listed files of every class."""
    out = None
    for t in ("small", "sv", "cnv"):
        path = vcf_file(spark, d, t)
        got = files.read_many(spark, spark.createDataFrame([(f"{path}/p={i}",) for i in range(8)], "value string"), t)
        out = got if out is None else out.unionByName(got)
    return out.groupBy("vcf_type").agg(F.count(F.lit(1)).alias("n"))


@query("p7_callable_genotypes", f"WITH {GEN} SELECT sample_id, count(*) AS n FROM genotypes WHERE gt NOT LIKE '%.%' AND gt NOT IN ('0|0', '0/0') GROUP BY sample_id")
def p7(spark, d):
    a = C.alleles(F.col("gt"))
    ok = ~F.exists(a, lambda x: x.isNull()) & F.exists(a, lambda x: x > 0)
    return gen(spark, d).filter(ok).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@query("p8_variant_filters", f"WITH {VAR}, q AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'LowQual' ELSE 'PASS' END AS f, o_custkey % 20 AS dp FROM variants) SELECT chrom, pos, variant_id, vcf_type FROM q WHERE (vcf_type = 'small' AND qual >= 20 AND dp >= 10) OR (vcf_type = 'sv' AND f = 'PASS' AND dp >= 10) OR (vcf_type = 'cnv' AND qual >= 20 AND f = 'PASS')")
def p8(spark, d):
    v = var(spark, d).withColumn("f", F.when(F.col("o_orderkey") % 4 == 0, "LowQual").otherwise("PASS")).withColumn("dp", F.col("o_custkey") % 20)
    return v.filter(C.variant_passes(F.col("vcf_type"), F.col("qual"), F.col("f"), F.col("dp"))).select("chrom", "pos", "variant_id", "vcf_type")


@query("p9_variant_ids", f"WITH {VAR} SELECT o_orderkey, chrom || ':' || pos || ':' || ref || ':' || alt || CASE vcf_type WHEN 'sv' THEN ':ann' || (o_custkey % 7) WHEN 'cnv' THEN ':' || (o_custkey % 900) ELSE '' END AS annotated_id FROM variants")
def p9(spark, d):
    v = var(spark, d)
    info = F.concat(F.lit("DP=10;SVANN=ann"), (F.col("o_custkey") % 7).cast("string"), F.lit(";SVLEN="), (F.col("o_custkey") % 900).cast("string"))
    return v.select("o_orderkey", C.annotated_id(F.col("vcf_type"), F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"), info).alias("annotated_id"))


@query("p10_p11_p12_typing", f"WITH {VAR} SELECT chrom, pos, CASE WHEN o_orderkey % 3 = 0 THEN vcf_type || '_' || chrom || '_' || pos ELSE variant_id END AS id, CASE WHEN vcf_type <> 'small' THEN vcf_type WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snp' WHEN length(ref) > length(alt) THEN 'deletion' ELSE 'insertion' END AS variant_type, pos + length(ref) - 1 AS variant_end FROM variants")
def p10(spark, d):
    v = var(spark, d).withColumn("raw", F.when(F.col("o_orderkey") % 3 == 0, ".").otherwise(F.col("variant_id")))
    return v.select("chrom", "pos", C.fallback_id(F.col("raw"), F.col("vcf_type"), F.col("chrom"), F.col("pos")).alias("id"), C.variant_type(F.col("vcf_type"), F.col("ref"), F.col("alt")).alias("variant_type"), C.variant_end(F.col("pos"), F.col("ref")).alias("variant_end"))


@query("x1_x2_sample_names", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(['S' || (c_custkey % 17), 'sample' || (c_custkey % 5)])), ',') END AS samples FROM customer")
def x1(spark, d):
    raw = F.when(F.col("c_custkey") % 9 == 0, ".").otherwise(F.concat(F.lit(" S_"), (F.col("c_custkey") % 17).cast("string"), F.lit(";sample-"), (F.col("c_custkey") % 5).cast("string"), F.lit(",, ")))
    return view(spark, d, "customer").select("c_custkey", F.array_join(C.parse_samples(raw), ",").alias("samples"))


CARRY = "CASE WHEN gt LIKE '%|%' AND vcf_type IN ('small', 'sv') THEN split_part(gt, '|', 1) NOT IN ('0', '.') ELSE regexp_matches(gt, '[1-9]') END"


@query("x3_carrier_flag", f"WITH {GEN} SELECT vcf_type, gt, {CARRY} AS carrier, count(*) AS n FROM genotypes GROUP BY ALL")
def x3(spark, d):
    g = gen(spark, d).withColumn("carrier", C.carrier(F.col("gt"), "H1", C.phased_class(F.col("vcf_type"))))
    return g.groupBy("vcf_type", "gt", "carrier").agg(F.count(F.lit(1)).alias("n"))


@query("j6_variants_in_regions", f"WITH {ISLANDS}, {VAR} SELECT v.chrom, v.pos, v.variant_id, i.hap, i.start_pos AS region_start, i.end_pos AS region_end FROM variants v JOIN islands i ON v.chrom = i.chrom AND v.pos <= i.end_pos AND v.pos + length(v.ref) - 1 >= i.start_pos")
def j6(spark, d):
    out = states.variants_in_regions(var(spark, d), u_islands(spark, d).select("chrom", "hap", "start_pos", "end_pos"))
    return out.select("chrom", "pos", "variant_id", "hap", "region_start", "region_end")


@query("j8_cohort_merge", f"WITH {GEN}, cohort AS (SELECT DISTINCT sample_id FROM genotypes), sites AS (SELECT DISTINCT vcf_type, chrom, pos, ref, alt FROM genotypes WHERE gt <> './.') SELECT s.vcf_type, s.chrom, s.pos, s.ref, s.alt, string_agg(c.sample_id || '=' || coalesce(g.gt, './.'), ',' ORDER BY c.sample_id, g.gt) AS genotypes FROM sites s CROSS JOIN cohort c LEFT JOIN (SELECT * FROM genotypes WHERE gt <> './.') g ON g.vcf_type = s.vcf_type AND g.chrom = s.chrom AND g.pos = s.pos AND g.ref = s.ref AND g.alt = s.alt AND g.sample_id = c.sample_id GROUP BY ALL")
def j8(spark, d):
    """Per-sample tables of every class to one row per site and alleles; a sample that lacks the site is ``./.``."""
    g = gen(spark, d).filter("gt <> './.'")
    cohort = F.broadcast(gen(spark, d).select("sample_id").distinct().agg(F.array_sort(F.collect_list("sample_id")).alias("cohort")))  # one row, a cohort's names
    merged = g.groupBy("vcf_type", "chrom", "pos", "ref", "alt").agg(F.collect_list(F.struct("sample_id", "gt")).alias("s")).crossJoin(cohort)
    absent = F.transform(F.array_except("cohort", F.transform("s", lambda x: x["sample_id"])), lambda n: F.struct(n.alias("sample_id"), F.lit("./.").alias("gt")))
    all_ = F.array_sort(F.concat("s", absent))
    return merged.select("vcf_type", "chrom", "pos", "ref", "alt", F.array_join(F.transform(all_, lambda x: F.concat(x["sample_id"], F.lit("="), x["gt"])), ",").alias("genotypes"))


MERGED = duck("calls") + """, c AS (SELECT *, string_split(alt, ',') AS alts, CASE WHEN len(list_filter(string_split(alt, ','), lambda x: length(x) <> length(ref))) = 0 THEN 'snp' ELSE 'indel' END AS kind, CASE WHEN file = 17 THEN '17:S0' ELSE sample_id END AS name FROM calls),
 site AS (SELECT vcf_type, chrom, pos, kind, arg_max(ref, length(ref)) AS whole, max(qual) AS qual, CAST(sum(depth) AS BIGINT) AS depth FROM c GROUP BY ALL),
 a AS (SELECT vcf_type, chrom, pos, kind, name, file, idx, alts[idx] || substr(whole, length(ref) + 1) AS padded FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS idx FROM c) JOIN site USING (vcf_type, chrom, pos, kind)),
 d AS (SELECT vcf_type, chrom, pos, kind, padded, row_number() OVER (PARTITION BY vcf_type, chrom, pos, kind ORDER BY min(file * 100 + idx)) AS k FROM a GROUP BY vcf_type, chrom, pos, kind, padded),
 map AS (SELECT vcf_type, chrom, pos, kind, name, idx, k FROM a JOIN d USING (vcf_type, chrom, pos, kind, padded)),
 t AS (SELECT *, CASE WHEN contains(gt, '|') THEN '|' ELSE '/' END AS sep FROM c),
 g AS (SELECT t.vcf_type, t.chrom, t.pos, t.kind, t.name, coalesce(l.k, 0) || sep || coalesce(r.k, 0) AS gt FROM t LEFT JOIN map l ON l.vcf_type = t.vcf_type AND l.chrom = t.chrom AND l.pos = t.pos AND l.kind = t.kind AND l.name = t.name AND l.idx = CAST(split_part(gt, sep, 1) AS INT) LEFT JOIN map r ON r.vcf_type = t.vcf_type AND r.chrom = t.chrom AND r.pos = t.pos AND r.kind = t.kind AND r.name = t.name AND r.idx = CAST(split_part(gt, sep, 2) AS INT)),
 names AS (SELECT DISTINCT name, file FROM c), alleles AS (SELECT vcf_type, chrom, pos, kind, string_agg(padded, ',' ORDER BY k) AS alt FROM d GROUP BY ALL)"""


def merged_calls(spark, d, every=False):
    """The cohort's merged sites and its names in order."""
    calls = view(spark, d, "calls")
    who = G.cohort(calls)
    names = G.names_of(who)
    return G.merge_cohort(calls, who, size=len(names), every=every), names


@query("j8_multiallelic_merge", f"WITH {MERGED} SELECT vcf_type, chrom, pos, kind, whole AS ref, alt, qual, depth, string_agg(name || '=' || coalesce(gt, './.'), ',' ORDER BY file) AS genotypes FROM site JOIN alleles USING (vcf_type, chrom, pos, kind) CROSS JOIN names LEFT JOIN g USING (vcf_type, chrom, pos, kind, name) GROUP BY vcf_type, chrom, pos, kind, whole, alt, qual, depth")
def j8_multiallelic(spark, d):
    """Alternatives of all samples at a site in one row, genotypes renumbered, a repeated sample name made unique; all calls of a sample are listed."""
    sites, names = merged_calls(spark, d, every=True)
    text = F.array_join(F.transform("listed", lambda x: F.concat_ws("=", F.get(G.listed(names), x["place"]), x["gt"])), ",")
    return sites.select("vcf_type", "chrom", "pos", "kind", "ref", F.array_join("alts", ",").alias("alt"), "qual", "depth", text.alias("genotypes"))


@query("g22_retention", f"WITH {VAR} SELECT vcf_type, count(*) AS initial, count(*) FILTER (qual >= 20) AS final, count(*) FILTER (qual < 20) AS removed, round(count(*) FILTER (qual >= 20) * 100.0::DOUBLE / count(*), 6) AS percent FROM variants GROUP BY vcf_type")
def g22(spark, d):
    n = var(spark, d).groupBy("vcf_type").agg(F.count(F.lit(1)).alias("initial"), F.count_if(F.col("qual") >= 20).alias("final"))
    return n.select("*", (F.col("initial") - F.col("final")).alias("removed"), R(F.col("final") * 100.0 / F.col("initial")).alias("percent"))


# nine states over candidate regions

CASES = f"""{EVIDENCE}, {GEN}, cand AS (SELECT * FROM reasoned WHERE reason = 'final'),
 hits AS (SELECT v.chrom, v.pos, v.variant_id, v.vcf_type, c.hap, c.start_pos AS region_start, c.end_pos AS region_end, us, ms FROM variants v JOIN cand c ON v.chrom = c.chrom AND v.pos <= c.end_pos AND v.pos + length(v.ref) - 1 >= c.start_pos),
 cells AS (SELECT h.*, g.sample_id, g.gt, CASE WHEN list_contains(us, g.sample_id) AND list_contains(ms, g.sample_id) THEN 'M' WHEN list_contains(ms, g.sample_id) THEN 'M' WHEN list_contains(us, g.sample_id) THEN 'U' ELSE 'X' END AS st, CASE WHEN gt = './.' THEN 'X' WHEN {CARRY.replace('vcf_type', 'h.vcf_type').replace("'|', 1", "'|', CASE WHEN hap = 'H1' THEN 1 ELSE 2 END")} THEN '+' ELSE '-' END AS vs FROM hits h JOIN genotypes g ON h.variant_id = g.variant_id AND h.chrom = g.chrom AND h.pos = g.pos)"""


NAMES = [f"S-{k}" if k % 2 else f"S_{k}" for k in range(17)]  # as a header has them; regions have S0, S1 and so on


def packed(spark, d):
    """The cohort's file of variants: a row per site with the genotypes of all samples in the order of NAMES."""
    gt = "transform(sequence(0, 16), k -> CASE (o_orderkey * (k + 3) + o_custkey) % 7 WHEN 1 THEN '0|1' WHEN 2 THEN '1|0' WHEN 3 THEN '1|1' WHEN 4 THEN './.' WHEN 5 THEN '0/1' ELSE '0|0' END)"
    return var(spark, d).select("chrom", "pos", "variant_id", "vcf_type", "ref", "alt", F.expr(gt).alias("gts"))


def hits(spark, d):
    """Each site in a candidate region of either haplotype, with the samples' states and genotypes as arrays."""
    c = final_candidates(spark, d).select("chrom", "hap", "start_pos", "end_pos", "unmethylated_samples", "methylated_samples")
    c = G.cohort_states(c, NAMES).select("chrom", "hap", "start_pos", "end_pos", "states")
    return states.variants_in_regions(packed(spark, d), c)


NINE = ", ".join(f"count(*) FILTER (st = '{m}' AND vs = '{v}') AS {c}" for (m, v), c in {("M", "+"): "m_plus", ("M", "-"): "m_minus", ("M", "X"): "m_none", ("U", "+"): "u_plus", ("U", "-"): "u_minus", ("U", "X"): "u_none", ("X", "+"): "x_plus", ("X", "-"): "x_minus", ("X", "X"): "x_none"}.items())
CKEYS = ["chrom", "pos", "variant_id", "vcf_type", "hap", "region_start", "region_end"]
CELLS = {("M", "+"): "m_plus", ("M", "-"): "m_minus", ("M", "X"): "m_none", ("U", "+"): "u_plus", ("U", "-"): "u_minus", ("U", "X"): "u_none", ("X", "+"): "x_plus", ("X", "-"): "x_minus", ("X", "X"): "x_none"}
NINE_LISTS = ", ".join(f"coalesce(string_agg(sample_id || ':' || gt, ',' ORDER BY sample_id || ':' || gt) FILTER (st = '{m}' AND vs = '{v}'), '.') AS {c}_samples" for (m, v), c in CELLS.items())


@query("j7_genotype_state_join", f"WITH {CASES} SELECT chrom, pos, variant_id, hap, region_start, sample_id, st AS meth_state, gt FROM cells")
def j7(spark, d):
    """The two arrays of each hit as rows."""
    row = F.zip_with(F.transform(G.listed(NAMES), C.normalize_sample), F.arrays_zip("states", "gts"), lambda n, x: F.struct(n.alias("sample_id"), x["states"].alias("meth_state"), x["gts"].alias("gt")))
    return hits(spark, d).select("chrom", "pos", "variant_id", "hap", "region_start", F.inline(row))


@query("g24_nine_states", f"WITH {CASES} SELECT {', '.join(CKEYS)}, {NINE}, {NINE_LISTS} FROM cells GROUP BY {', '.join(CKEYS)}")
def g24(spark, d):
    out = G.nine_states_packed(hits(spark, d), NAMES, CKEYS, F.col("hap"), C.phased_class(F.col("vcf_type")), lists=True)
    return out.withColumns({f"{c}_samples": sinks.joined_list(f"{c}_samples") for c in CELLS.values()})


@query("u5_no_data_samples", f"WITH {EVIDENCE}, cohort AS (SELECT list_sort(list(DISTINCT sample_id)) AS names FROM seg) SELECT chrom, hap, start_pos, end_pos, array_to_string(list_filter(names, lambda x: NOT list_contains(us, x) AND NOT list_contains(ms, x)), ',') AS samples FROM reasoned, cohort WHERE reason = 'final'")
def u5(spark, d):
    cohort = F.broadcast(view(spark, d, "segments").select("sample_id").distinct().agg(F.collect_list("sample_id").alias("cohort")))  # one row, a cohort's names
    left = F.array_except(F.array_except("cohort", "methylated_samples"), "unmethylated_samples")
    return final_candidates(spark, d).crossJoin(cohort).select("chrom", "hap", "start_pos", "end_pos", F.array_join(F.array_sort(left), ",").alias("samples"))


@query("u4_sample_union", f"WITH {EVIDENCE} SELECT chrom, hap, start_pos, end_pos, array_to_string(list_sort(list_distinct(list_concat(us, ms))), ',') AS samples FROM evidence")
def u4(spark, d):
    """Samples with data of either state."""
    e = K.sample_evidence(kept_islands(spark, d), seg(spark, d))
    return e.select("chrom", "hap", "start_pos", "end_pos", F.array_join(F.array_sort(F.array_union("unmethylated_samples", "methylated_samples")), ",").alias("samples"))


@query("p19_sample_from_path", f"WITH {duck('segments')} SELECT DISTINCT sample_id AS stem, sample_id AS stripped FROM segments")
def p19(spark, d):
    """Sample ids from paths: the file's stem before ``_``, and the name without a known suffix."""
    path = F.concat(F.lit("/cohort/H1_M/"), F.col("sample_id"), F.lit("_meth_regions.bed"))
    return seg(spark, d).select(path.alias("path")).distinct().select(files.stem_of(F.col("path")).alias("stem"), files.stem_of(F.col("path"), "_meth_regions.bed").alias("stripped")).distinct()


# scores on the association table

ASSOC = duck("assoc") + """, st AS (SELECT region_id, meth_state AS st, CASE WHEN gt = './.' THEN 'X' WHEN gt LIKE '%|%' THEN CASE WHEN split_part(gt, '|', 1) IN ('0', '.') THEN '-' ELSE '+' END WHEN regexp_matches(gt, '[1-9]') THEN '+' ELSE '-' END AS vs FROM assoc),
 c AS (SELECT region_id, """ + NINE + """ FROM st GROUP BY region_id),
 t AS (SELECT *, m_plus + m_minus + m_none AS tm, u_plus + u_minus + u_none AS tu, m_plus + m_minus + m_none + u_plus + u_minus + u_none + x_plus + x_minus + x_none AS total FROM c),
 k AS (SELECT *, (tm + tu)::DOUBLE / (total - x_none) AS cov1, (tm + tu + x_plus + x_minus)::DOUBLE / total AS cov2, (m_plus + u_plus + m_minus + u_minus)::DOUBLE / (tm + tu + 2 * x_plus + 2 * x_minus + 2 * x_none + m_minus + u_minus) AS quality FROM t),
 w AS (SELECT *, CASE WHEN cov1 >= 0.8 THEN 1.0 WHEN cov1 >= 0.6 THEN 0.7 WHEN cov1 >= 0.4 THEN 0.4 ELSE 0.1 END::DOUBLE AS w1, CASE WHEN cov2 >= 0.8 THEN 1.0 WHEN cov2 >= 0.6 THEN 0.7 WHEN cov2 >= 0.4 THEN 0.4 ELSE 0.1 END::DOUBLE AS w2, m_plus::DOUBLE / tm AS rm, u_plus::DOUBLE / tu AS ru FROM k),
 terms AS (SELECT region_id, unnest(range(greatest(0, m_plus + u_plus - tu), least(tm, m_plus + u_plus) + 1)) AS x, m_plus, u_plus, tm, tu FROM w),
 lp AS (SELECT *, lgamma(tm + 1) - lgamma(x + 1) - lgamma(tm - x + 1) + lgamma(tu + 1) - lgamma(m_plus + u_plus - x + 1) - lgamma(tu - m_plus - u_plus + x + 1) - lgamma(tm + tu + 1) + lgamma(m_plus + u_plus + 1) + lgamma(tm + tu - m_plus - u_plus + 1) AS l FROM terms),
 p AS (SELECT region_id, least(1.0, sum(CASE WHEN l <= lo + 1e-7 THEN exp(l) ELSE 0 END)) AS p FROM (SELECT *, max(CASE WHEN x = m_plus THEN l END) OVER (PARTITION BY region_id) AS lo FROM lp) GROUP BY region_id),
 s AS (SELECT * FROM w JOIN p USING (region_id))"""


def assoc_totals(spark, d):
    return states.with_totals(states.nine_states(view(spark, d, "assoc"), ["region_id"], "H1"))


def mapped(spark, d, version):
    """A mapped-variant table, written as TSV, version 2 in a folder per association, and read back."""
    path = scratch(spark)
    totals = states.with_totals(states.nine_states(view(spark, d, "assoc"), ["region_id"], "H1", lists=True))
    out = sinks.mapped_variants(states.scored(totals), ["region_id"], version)
    out = out.withColumns({f.name: R(f.name, 5) for f in out.schema if f.dataType.typeName() == "double"})
    sinks.write_tsv(out, path, True, ["association"] if version == "v2" else None)
    return spark.read.csv(path, sep="\t", header=True, schema=out.schema).select(*out.columns)


def ratio_sql(n, t):
    return f"printf('%d/%d (%.1f%%)', {n}, {t}, CASE WHEN {t} > 0 THEN round({n} * 100.0::DOUBLE / greatest({t}, 1), 1) ELSE 0.0::DOUBLE END)"


@query("x8_x9_weights_coverage", f"WITH {ASSOC} SELECT region_id, round(cov1, 6) AS coverage_v1, round(cov2, 6) AS coverage_v2, round(quality, 6) AS quality, w1 AS weight_v1, w2 AS weight_v2 FROM s")
def x8(spark, d):
    t = assoc_totals(spark, d)
    return t.select("region_id", R("coverage_v1").alias("coverage_v1"), R("coverage_v2").alias("coverage_v2"), R("quality").alias("quality"), C.confidence_weight(F.col("coverage_v1")).alias("weight_v1"), C.confidence_weight(F.col("coverage_v2")).alias("weight_v2"))


@query("x10_fisher_exact", f"WITH {ASSOC} SELECT region_id, round(p, 7) AS p_value FROM s")
def x10(spark, d):
    return states.scored(assoc_totals(spark, d)).select("region_id", R("p_value", 7).alias("p_value"))


@query("x11_score_v1", f"WITH {ASSOC} SELECT region_id, round(w1 * (0.4 * rm + 0.6 * (1 - ru)) - 0.1 * log10(greatest(p, 1e-10)), 5) AS v1_meth, round(w1 * (0.4 * ru + 0.6 * (1 - rm)) - 0.1 * log10(greatest(p, 1e-10)), 5) AS v1_unmeth FROM s")
def x11(spark, d):
    return states.scored(assoc_totals(spark, d)).select("region_id", R("v1_meth", 5).alias("v1_meth"), R("v1_unmeth", 5).alias("v1_unmeth"))


@query("x12_score_v2", f"WITH {ASSOC}, e AS (SELECT *, greatest(0.0, rm - ru) AS em, greatest(0.0, ru - rm) AS eu, -log10(greatest(p, 1e-10)) AS g FROM s) SELECT region_id, round(w2 * (0.5 * em + 0.3 * (1 - eu) + 0.2 * g), 5) AS v2_meth, round(w2 * (0.5 * eu + 0.3 * (1 - em) + 0.2 * g), 5) AS v2_unmeth FROM e")
def x12(spark, d):
    return states.scored(assoc_totals(spark, d)).select("region_id", R("v2_meth", 5).alias("v2_meth"), R("v2_unmeth", 5).alias("v2_unmeth"))


@query("x13_score_v3", f"WITH {ASSOC}, n AS (SELECT *, (m_plus + u_plus)::DOUBLE AS n, m_plus::DOUBLE / nullif(m_plus + u_plus, 0) AS rate, CASE WHEN m_minus + u_minus > 0 THEN m_minus::DOUBLE / (m_minus + u_minus) ELSE 0 END AS bg FROM s) SELECT region_id, round(CASE WHEN n > 0 THEN greatest(0.0, least(1.0, ((0.5 * (rate - bg) + 0.3 * (1 - sqrt(rate * (1 - rate)) / sqrt(n)) + 0.2 * least(1.0, 2 * cov2)) + 1) / 2 * least(1.0, n / 10))) END, 6) AS v3 FROM n")
def x13(spark, d):
    return states.scored(assoc_totals(spark, d)).select("region_id", R("v3").alias("v3"))


V4 = """, f AS (SELECT *, (m_plus + m_minus)::DOUBLE AS nm, (u_plus + u_minus)::DOUBLE AS nu, (m_plus + u_plus)::DOUBLE / (m_plus + u_plus + m_minus + u_minus) AS bg FROM s),
 o AS (SELECT *, ln((m_plus / nm + 1e-10) / (1 - m_plus / nm + 1e-10)) - ln((bg + 1e-10) / (1 - bg + 1e-10)) AS lm, ln((u_plus / nu + 1e-10) / (1 - u_plus / nu + 1e-10)) - ln((bg + 1e-10) / (1 - bg + 1e-10)) AS lu FROM f),
 v4 AS (SELECT *, CASE WHEN nm >= 10 THEN 1 / (1 + exp(-lm)) * quality END AS sm, CASE WHEN nu >= 10 THEN 1 / (1 + exp(-lu)) * quality END AS su FROM o)"""


@query("x14_score_v4", f"WITH {ASSOC}{V4} SELECT region_id, round(CASE WHEN nm >= 10 THEN lm END, 4) AS v4_meth_odds, round(sm, 6) AS v4_meth, round(CASE WHEN nu >= 10 THEN lu END, 4) AS v4_unmeth_odds, round(su, 6) AS v4_unmeth FROM v4")
def x14(spark, d):
    return states.scored(assoc_totals(spark, d)).select("region_id", R("v4_meth_odds", 4).alias("v4_meth_odds"), R("v4_meth").alias("v4_meth"), R("v4_unmeth_odds", 4).alias("v4_unmeth_odds"), R("v4_unmeth").alias("v4_unmeth"))


CLASS4 = "CASE WHEN sm IS NULL OR su IS NULL THEN 'insufficient_data' WHEN sm > 2 * su THEN 'methylated_associated' WHEN su > 2 * sm THEN 'unmethylated_associated' ELSE 'no_strong_association' END"


@query("x15_class_v4", f"WITH {ASSOC}{V4} SELECT region_id, {CLASS4} AS v4_class FROM v4")
def x15(spark, d):
    return states.scored(assoc_totals(spark, d)).select("region_id", "v4_class")


@query("x16_g25_clean_partition", f"WITH {ASSOC}, q AS (SELECT *, CASE WHEN m_plus + u_plus >= 5 AND m_minus + u_minus >= 5 AND u_plus = 0 AND m_minus = 0 THEN 'methylated_associated' WHEN m_plus + u_plus >= 5 AND m_minus + u_minus >= 5 AND m_plus = 0 AND u_minus = 0 THEN 'unmethylated_associated' END AS simple_class FROM s) SELECT region_id, m_plus, u_plus, m_minus, u_minus, m_none, u_none, simple_class FROM q WHERE simple_class IS NOT NULL")
def x16(spark, d):
    return states.scored(assoc_totals(spark, d)).filter("simple_class is not null").select("region_id", "m_plus", "u_plus", "m_minus", "u_minus", "m_none", "u_none", "simple_class")


@query("g26_result_distribution", f"WITH {ASSOC}{V4} SELECT {CLASS4} AS v4_class, count(*) AS n FROM v4 GROUP BY ALL")
def g26(spark, d):
    return states.scored(assoc_totals(spark, d)).groupBy("v4_class").agg(F.count(F.lit(1)).alias("n"))


@query("g27_score_distribution", f"WITH {ASSOC}{V4} SELECT count(sm) AS n, round(avg(sm), 5) AS mean, round(median(sm), 5) AS median, round(stddev_pop(sm), 5) AS std, round(min(sm), 5) AS min, round(max(sm), 5) AS max, count(*) FILTER (quality > 0.8) AS good, count(*) FILTER (sm >= 0.3 AND sm <= 0.4) AS band_34, count(*) FILTER (sm >= 0.4 AND sm <= 0.6) AS band_46, count(*) FILTER (sm >= 0.6 AND sm <= 0.7) AS band_67 FROM v4")
def g27(spark, d):
    s = F.col("v4_meth")
    return states.scored(assoc_totals(spark, d)).agg(F.count(s).alias("n"), R(F.avg(s), 5).alias("mean"), R(F.median(s), 5).alias("median"), R(F.stddev_pop(s), 5).alias("std"), R(F.min(s), 5).alias("min"), R(F.max(s), 5).alias("max"), F.count_if(F.col("quality") > 0.8).alias("good"), F.count_if((s >= 0.3) & (s <= 0.4)).alias("band_34"), F.count_if((s >= 0.4) & (s <= 0.6)).alias("band_46"), F.count_if((s >= 0.6) & (s <= 0.7)).alias("band_67"))


@query("t2_score_sort", f"WITH {ASSOC} SELECT region_id, round(w2 * (0.5 * greatest(0.0, rm - ru) + 0.3 * (1 - greatest(0.0, ru - rm)) + 0.2 * -log10(greatest(p, 1e-10))), 5) AS v2_meth, round(p, 7) AS p_value FROM s")
def t2(spark, d):
    return states.scored(assoc_totals(spark, d)).select("region_id", R("v2_meth", 5).alias("v2_meth"), R("p_value", 7).alias("p_value")).orderBy(F.desc("v2_meth"), "p_value", "region_id")


LISTS = ", li AS (SELECT region_id, " + NINE_LISTS + " FROM st GROUP BY region_id)"


def _whole(c, version):
    return ("total" if version != "v3" else "tx") if c == "x_none" else {"m": "tm", "u": "tu", "x": "tx"}[c[0]]


def _ratios(version, plain=False):
    return ", ".join((f"{c} || '/' || {_whole(c, version)}" if plain else ratio_sql(c, _whole(c, version))) + f' AS "{k}"' for k, c in states.STATES.items())


SEVEN = "m_plus_samples, u_plus_samples, x_plus_samples, m_none_samples, u_none_samples, x_none_samples"
FULL = ASSOC.replace("SELECT region_id, meth_state AS st,", "SELECT region_id, sample_id, gt, meth_state AS st,") + LISTS + ", a AS (SELECT *, x_plus + x_minus + x_none AS tx, greatest(0.0, rm - ru) AS em, greatest(0.0, ru - rm) AS eu, -log10(greatest(p, 1e-10)) AS g FROM s JOIN li USING (region_id))"


@query("k5_v1_table", f"WITH {FULL} SELECT region_id, round(w1 * (0.4 * rm + 0.6 * (1 - ru)) - 0.1 * log10(greatest(p, 1e-10)), 5) AS v1_meth, round(w1 * (0.4 * ru + 0.6 * (1 - rm)) - 0.1 * log10(greatest(p, 1e-10)), 5) AS v1_unmeth, round(p, 5) AS p_value, {_ratios('v1')}, {SEVEN} FROM a")
def k5_v1(spark, d):
    return mapped(spark, d, "v1")


V2 = "w2 * (0.5 * em + 0.3 * (1 - eu) + 0.2 * g) AS v2m, w2 * (0.5 * eu + 0.3 * (1 - em) + 0.2 * g) AS v2u"


@query("k5_v2_tables", f"WITH {FULL}, b AS (SELECT *, {V2} FROM a) SELECT region_id, CASE WHEN v2m > v2u THEN 'methylated' ELSE 'unmethylated' END AS association, round(v2m, 5) AS v2_meth, round(v2u, 5) AS v2_unmeth, round(p, 5) AS p_value, {_ratios('v2')}, round(cov2, 5) AS data_coverage, round(em, 5) AS meth_enrichment, round(eu, 5) AS unmeth_enrichment, {SEVEN}, x_minus_samples FROM b")
def k5_v2(spark, d):
    return mapped(spark, d, "v2")


@query("k5_v3_table", f"WITH {FULL}, n AS (SELECT *, (m_plus + u_plus)::DOUBLE AS n, m_plus::DOUBLE / nullif(m_plus + u_plus, 0) AS rate, CASE WHEN m_minus + u_minus > 0 THEN m_minus::DOUBLE / (m_minus + u_minus) ELSE 0 END AS bg FROM a) SELECT region_id, round(greatest(0.0, least(1.0, ((0.5 * (rate - bg) + 0.3 * (1 - sqrt(rate * (1 - rate)) / sqrt(n)) + 0.2 * least(1.0, 2 * cov2)) + 1) / 2 * least(1.0, n / 10))), 5) AS v3, {_ratios('v3', True)}, m_plus_samples, u_plus_samples, x_plus_samples FROM n WHERE n > 0")
def k5_v3(spark, d):
    return mapped(spark, d, "v3")


@query("k5_simple_table", f"WITH {FULL}, q AS (SELECT *, CASE WHEN m_plus + u_plus >= 5 AND m_minus + u_minus >= 5 AND u_plus = 0 AND m_minus = 0 THEN 'methylated_associated' WHEN m_plus + u_plus >= 5 AND m_minus + u_minus >= 5 AND m_plus = 0 AND u_minus = 0 THEN 'unmethylated_associated' END AS pattern FROM a) SELECT region_id, pattern, m_plus + u_plus AS variant_carriers, m_minus + u_minus AS non_carriers, m_plus + u_plus + m_minus + u_minus AS total_samples, total - m_plus - u_plus - m_minus - u_minus AS missing_data, m_plus_samples, u_plus_samples FROM q WHERE pattern IS NOT NULL")
def k5_simple(spark, d):
    return mapped(spark, d, "simple")


FULL4 = FULL + V4.replace("FROM s)", "FROM a)")


@query("k5_mapped_variants", f"WITH {FULL4}, c4 AS (SELECT *, {CLASS4} AS k FROM v4) SELECT region_id, k AS classification, round(if(k LIKE 'm%', sm, su), 5) AS enrichment_score, round(if(k LIKE 'm%', lm, lu), 5) AS log_odds, least(1.0, if(k LIKE 'm%', nm, nu) / 10)::DOUBLE AS confidence, round(quality, 5) AS quality, round(if(k LIKE 'm%', m_plus / nm, u_plus / nu), 5) AS state_frequency, round(bg, 5) AS background_frequency, (nm + nu)::BIGINT AS complete_samples, total AS total_samples, m_plus_samples, u_plus_samples FROM c4 WHERE k IN ('methylated_associated', 'unmethylated_associated')")
def k5(spark, d):
    return mapped(spark, d, "v4")


# the mapped-variant tables of real candidates: merged sites in candidate regions of both haplotypes, with their identity

IDENTITY = ["chrom", "start_pos", "end_pos", "variant_id", "type", "ref", "alt", "hap", "region_start", "region_end"]
KIND = "CASE WHEN vcf_type <> 'small' THEN vcf_type WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snp' WHEN length(ref) > length(alt) THEN 'deletion' ELSE 'insertion' END"
_whole_tail = FULL[FULL.index(" c AS (SELECT region_id"):].replace("m_plus::DOUBLE / tm AS rm, u_plus::DOUBLE / tu AS ru", "CASE WHEN tm > 0 THEN m_plus::DOUBLE / tm ELSE 0 END AS rm, CASE WHEN tu > 0 THEN u_plus::DOUBLE / tu ELSE 0 END AS ru").replace(
    "(tm + tu)::DOUBLE / (total - x_none) AS cov1", "CASE WHEN total > x_none THEN (tm + tu)::DOUBLE / (total - x_none) ELSE 0 END AS cov1").replace(
    "(m_plus + u_plus + m_minus + u_minus)::DOUBLE / (tm + tu + 2 * x_plus + 2 * x_minus + 2 * x_none + m_minus + u_minus) AS quality", "CASE WHEN tm + tu + x_plus + x_minus + x_none > 0 THEN (m_plus + u_plus + m_minus + u_minus)::DOUBLE / (tm + tu + 2 * x_plus + 2 * x_minus + 2 * x_none + m_minus + u_minus) ELSE 0 END AS quality")
E3 = f"""{CASES}, named AS (SELECT c.*, v.ref, v.alt, concat_ws('|', c.chrom, c.pos, c.variant_id, hap, region_start, region_end) AS region_id FROM cells c JOIN variants v ON v.chrom = c.chrom AND v.pos = c.pos AND v.variant_id = c.variant_id),
 idn0 AS (SELECT DISTINCT region_id, chrom, pos, variant_id, vcf_type, ref, alt, hap, region_start, region_end, {KIND} AS type FROM named),
 idn AS (SELECT region_id, chrom, pos AS start_pos, pos + length(ref) - 1 AS end_pos, CASE WHEN CAST(variant_id AS BIGINT) % 3 = 0 THEN type || '_' || chrom || '_' || pos ELSE variant_id END AS variant_id, type, ref, alt, hap, region_start, region_end FROM idn0),
 st AS (SELECT region_id, sample_id, gt, st, vs FROM named),{_whole_tail}"""


def candidate_scores(spark, d, least_state=1, least_clean=1):
    """Scores of every site in a candidate region, counted over packed genotypes; the file has no id for every third site.

    The thresholds are lower than the defaults, which the cohort of this fixture can't reach.
    """
    kind = C.variant_type(F.col("vcf_type"), F.col("ref"), F.col("alt"))
    raw = F.when(F.col("variant_id").cast("bigint") % 3 == 0, ".").otherwise(F.col("variant_id"))
    h = hits(spark, d).withColumns({"type": kind, "start_pos": F.col("pos"), "end_pos": C.variant_end(F.col("pos"), F.col("ref"))})
    h = h.withColumn("variant_id", C.fallback_id(raw, F.col("type"), F.col("chrom"), F.col("pos")))
    counts = G.nine_states_packed(h, NAMES, IDENTITY, F.col("hap"), C.phased_class(F.col("vcf_type")), lists=True)
    return states.scored(states.with_totals(counts), least_state, least_clean)


def mapped_candidates(spark, d, version):
    """The table written as TSV, version 2 in a folder per association, and read back."""
    path = scratch(spark)
    out = sinks.mapped_variants(candidate_scores(spark, d), IDENTITY, version)
    out = out.withColumns({f.name: R(f.name, 5) for f in out.schema if f.dataType.typeName() == "double"})
    sinks.write_tsv(out, path, True, ["association"] if version == "v2" else None)
    return spark.read.csv(path, sep="\t", header=True, schema=out.schema).select(*out.columns)


IDN = ", ".join(IDENTITY)


@query("k5_candidates_v1", f"WITH {E3} SELECT {IDN}, round(w1 * (0.4 * rm + 0.6 * (1 - ru)) - 0.1 * log10(greatest(p, 1e-10)), 5) AS v1_meth, round(w1 * (0.4 * ru + 0.6 * (1 - rm)) - 0.1 * log10(greatest(p, 1e-10)), 5) AS v1_unmeth, round(p, 5) AS p_value, {_ratios('v1')}, {SEVEN} FROM a JOIN idn USING (region_id)")
def k5_candidates_v1(spark, d):
    return mapped_candidates(spark, d, "v1")


@query("k5_candidates_v2", f"WITH {E3}, b AS (SELECT *, {V2} FROM a) SELECT {IDN}, CASE WHEN v2m > v2u THEN 'methylated' ELSE 'unmethylated' END AS association, round(v2m, 5) AS v2_meth, round(v2u, 5) AS v2_unmeth, round(p, 5) AS p_value, {_ratios('v2')}, round(cov2, 5) AS data_coverage, round(em, 5) AS meth_enrichment, round(eu, 5) AS unmeth_enrichment, {SEVEN}, x_minus_samples FROM b JOIN idn USING (region_id)")
def k5_candidates_v2(spark, d):
    return mapped_candidates(spark, d, "v2")


@query("k5_candidates_v3", f"WITH {E3}, n AS (SELECT *, (m_plus + u_plus)::DOUBLE AS n, m_plus::DOUBLE / nullif(m_plus + u_plus, 0) AS rate, CASE WHEN m_minus + u_minus > 0 THEN m_minus::DOUBLE / (m_minus + u_minus) ELSE 0 END AS bg FROM a) SELECT {IDN}, round(greatest(0.0, least(1.0, ((0.5 * (rate - bg) + 0.3 * (1 - sqrt(rate * (1 - rate)) / sqrt(n)) + 0.2 * least(1.0, 2 * cov2)) + 1) / 2 * least(1.0, n / 10))), 5) AS v3, {_ratios('v3', True)}, m_plus_samples, u_plus_samples, x_plus_samples FROM n JOIN idn USING (region_id) WHERE n > 0")
def k5_candidates_v3(spark, d):
    return mapped_candidates(spark, d, "v3")


@query("k5_candidates_v4", f"WITH {E3}{V4.replace('FROM s)', 'FROM a)').replace('>= 10', '>= 1').replace('THEN 1 / (1 + exp(-lm)) * quality', 'THEN 1 / (1 + exp(-lm)) * least(1.0, nm / 10) * quality').replace('THEN 1 / (1 + exp(-lu)) * quality', 'THEN 1 / (1 + exp(-lu)) * least(1.0, nu / 10) * quality')}, c4 AS (SELECT *, {CLASS4} AS k FROM v4) SELECT {IDN}, k AS classification, round(if(k LIKE 'm%', sm, su), 5) AS enrichment_score, round(if(k LIKE 'm%', lm, lu), 5) AS log_odds, least(1.0, if(k LIKE 'm%', nm, nu) / 10)::DOUBLE AS confidence, round(quality, 5) AS quality, round(if(k LIKE 'm%', m_plus / nm, u_plus / nu), 5) AS state_frequency, round(bg, 5) AS background_frequency, (nm + nu)::BIGINT AS complete_samples, total AS total_samples, m_plus_samples, u_plus_samples FROM c4 JOIN idn USING (region_id) WHERE k IN ('methylated_associated', 'unmethylated_associated')")
def k5_candidates_v4(spark, d):
    return mapped_candidates(spark, d, "v4")


@query("k5_candidates_simple", f"WITH {E3}, q AS (SELECT *, CASE WHEN m_plus + u_plus >= 1 AND m_minus + u_minus >= 1 AND u_plus = 0 AND m_minus = 0 THEN 'methylated_associated' WHEN m_plus + u_plus >= 1 AND m_minus + u_minus >= 1 AND m_plus = 0 AND u_minus = 0 THEN 'unmethylated_associated' END AS pattern FROM a) SELECT {IDN}, pattern, m_plus + u_plus AS variant_carriers, m_minus + u_minus AS non_carriers, m_plus + u_plus + m_minus + u_minus AS total_samples, total - m_plus - u_plus - m_minus - u_minus AS missing_data, m_plus_samples, u_plus_samples FROM q JOIN idn USING (region_id) WHERE pattern IS NOT NULL")
def k5_candidates_simple(spark, d):
    return mapped_candidates(spark, d, "simple")


TYPE = "CASE region_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'sv' ELSE 'cnv' END"


@query("g26_by_type_and_association", f"WITH {ASSOC}{V4}, e AS (SELECT *, greatest(0.0, rm - ru) AS em, greatest(0.0, ru - rm) AS eu, -log10(greatest(p, 1e-10)) AS g FROM v4), f2 AS (SELECT *, {V2} FROM e) SELECT {TYPE} AS vcf_type, CASE WHEN v2m > v2u THEN 'methylated' ELSE 'unmethylated' END AS association, {CLASS4} AS v4_class, count(*) AS n FROM f2 GROUP BY ALL")
def g26_types(spark, d):
    s = states.scored(assoc_totals(spark, d)).withColumn("vcf_type", F.expr(TYPE))
    return s.groupBy("vcf_type", F.col("v2_association").alias("association"), "v4_class").agg(F.count(F.lit(1)).alias("n"))


@query("k9_variant_report", f"WITH {ASSOC}{V4}, r AS (SELECT {CLASS4} AS k, CASE WHEN {CLASS4} LIKE 'm%' THEN sm ELSE su END AS score, quality FROM v4), x AS (SELECT * FROM r WHERE k IN ('methylated_associated', 'unmethylated_associated')), figures AS (SELECT (SELECT count(*) FROM r)::DOUBLE AS processed, count(*)::DOUBLE AS associated, count(*) FILTER (k LIKE 'm%')::DOUBLE AS methylated_associated, count(*) FILTER (k LIKE 'u%')::DOUBLE AS unmethylated_associated, round(avg(score), 5) AS score_mean, round(median(score), 5) AS score_median, round(stddev_pop(score), 5) AS score_std, round(min(score), 5) AS score_min, round(max(score), 5) AS score_max, round(avg(quality), 5) AS quality_mean, round(median(quality), 5) AS quality_median, count(*) FILTER (quality > 0.8)::DOUBLE AS quality_good FROM x) SELECT metric, value FROM (UNPIVOT figures ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'excluded', processed - associated FROM figures")
def k9_variants(spark, d):
    """The variant report as rows (metric, value)."""
    s = states.scored(assoc_totals(spark, d))
    m, u = F.col("v4_class") == "methylated_associated", F.col("v4_class") == "unmethylated_associated"
    score, quality = F.when(m, F.col("v4_meth")).when(u, F.col("v4_unmeth")), F.when(m | u, F.col("quality"))
    n = lambda c: F.count_if(c).cast("double")
    figures = {"processed": F.count(F.lit(1)).cast("double"), "associated": n(m | u), "excluded": n(~(m | u)), "methylated_associated": n(m), "unmethylated_associated": n(u)}
    figures |= {f"score_{k}": R(f(score), 5) for k, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))}
    figures |= {"quality_mean": R(F.avg(quality), 5), "quality_median": R(F.median(quality), 5), "quality_good": n(quality > 0.8)}
    return s.agg(*[v.alias(k) for k, v in figures.items()]).unpivot([], list(figures), "metric", "value")


ALL5 = f"{ASSOC}{V4}, e AS (SELECT *, {TYPE} AS vcf_type, greatest(0.0, rm - ru) AS em, greatest(0.0, ru - rm) AS eu, -log10(greatest(p, 1e-10)) AS g, (m_plus + u_plus)::DOUBLE AS n3, m_plus::DOUBLE / nullif(m_plus + u_plus, 0) AS rate, CASE WHEN m_minus + u_minus > 0 THEN m_minus::DOUBLE / (m_minus + u_minus) ELSE 0 END AS bg3 FROM v4), f2 AS (SELECT *, {V2} FROM e), f5 AS (SELECT *, CASE WHEN v2m > v2u THEN 'methylated' ELSE 'unmethylated' END AS association, round(CASE WHEN n3 > 0 THEN greatest(0.0, least(1.0, ((0.5 * (rate - bg3) + 0.3 * (1 - sqrt(rate * (1 - rate)) / sqrt(n3)) + 0.2 * least(1.0, 2 * cov2)) + 1) / 2 * least(1.0, n3 / 10))) END, 9) AS v3, CASE WHEN m_plus + u_plus >= 5 AND m_minus + u_minus >= 5 AND u_plus = 0 AND m_minus = 0 THEN 'methylated_associated' WHEN m_plus + u_plus >= 5 AND m_minus + u_minus >= 5 AND m_plus = 0 AND u_minus = 0 THEN 'unmethylated_associated' END AS pattern, m_plus + u_plus + m_minus + u_minus AS seen FROM f2)"


def all_scores(spark, d):
    """The scores of every version with the variant's class."""
    s = states.scored(assoc_totals(spark, d)).withColumn("vcf_type", F.expr(TYPE))
    seen = F.col("m_plus") + F.col("u_plus") + F.col("m_minus") + F.col("u_minus")
    return s.withColumn("seen", seen).withColumn("v3", F.round("v3", 9))


FIVE_SQL = ", ".join(f"round({f}(v), 5) AS {k}" for k, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query("g27_all_versions", f"WITH {ALL5}, long AS (SELECT 'v2_methylated' AS score, v2m AS v FROM f5 WHERE association = 'methylated' UNION ALL SELECT 'v2_unmethylated', v2u FROM f5 WHERE association = 'unmethylated' UNION ALL SELECT 'v3', v3 FROM f5 WHERE v3 IS NOT NULL UNION ALL SELECT 'v4_methylated', sm FROM f5 WHERE sm IS NOT NULL UNION ALL SELECT 'v4_unmethylated', su FROM f5 WHERE su IS NOT NULL UNION ALL SELECT 'simple_samples', seen FROM f5 WHERE pattern IS NOT NULL) SELECT score, count(*) AS n, {FIVE_SQL} FROM long GROUP BY score")
def g27_all(spark, d):
    """Distribution of the score that each version reports, and of the simple version's sample counts."""
    s = all_scores(spark, d)
    c = F.col
    take = {"v2_methylated": F.when(c("v2_association") == "methylated", c("v2_meth")), "v2_unmethylated": F.when(c("v2_association") == "unmethylated", c("v2_unmeth")), "v3": c("v3"), "v4_methylated": c("v4_meth"), "v4_unmethylated": c("v4_unmeth"), "simple_samples": F.when(c("simple_class").isNotNull(), c("seen").cast("double"))}
    long = s.select(*[v.alias(k) for k, v in take.items()]).unpivot([], list(take), "score", "v").filter("v is not null")
    mid = stats.quantiles(long, "v", ["score"], [0.5]).select("score", R("q0", 5).alias("median"))
    return long.groupBy("score").agg(F.count(F.lit(1)).alias("n"), *[R(f(c("v")), 5).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]).join(mid, "score")


@query("g27_v3_bands", f"WITH {ALL5} SELECT count(*) FILTER (v3 > 0.7) AS above_7, count(*) FILTER (v3 >= 0.6 AND v3 <= 0.7) AS band_67, count(*) FILTER (v3 >= 0.4 AND v3 <= 0.6) AS band_46, count(*) FILTER (v3 >= 0.3 AND v3 <= 0.4) AS band_34, count(*) FILTER (v3 < 0.3) AS below_3 FROM f5")
def g27_v3(spark, d):
    """Bands of the third version's score; adjacent ones share their edges."""
    v = F.col("v3")
    return all_scores(spark, d).agg(F.count_if(v > 0.7).alias("above_7"), F.count_if(v.between(0.6, 0.7)).alias("band_67"), F.count_if(v.between(0.4, 0.6)).alias("band_46"), F.count_if(v.between(0.3, 0.4)).alias("band_34"), F.count_if(v < 0.3).alias("below_3"))


@query("k9_v1_report", f"WITH {ALL5}, l AS (SELECT vcf_type, CASE WHEN rm > ru THEN 'methylated' WHEN ru > rm THEN 'unmethylated' ELSE 'even' END AS pattern FROM f5) SELECT vcf_type, pattern, count(*) AS n, round(count(*) * 100.0::DOUBLE / any_value(t), 6) AS percent FROM l JOIN (SELECT vcf_type, count(*) AS t FROM l GROUP BY vcf_type) USING (vcf_type) GROUP BY vcf_type, pattern")
def k9_v1(spark, d):
    """Per variant class how often carriers are rather methylated or not, and the share in percent."""
    share = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(0.0)
    m, u = share("m_plus", "total_meth"), share("u_plus", "total_unmeth")
    s = all_scores(spark, d).withColumn("pattern", F.when(m > u, "methylated").when(u > m, "unmethylated").otherwise("even"))
    return sinks.shares(s, ["vcf_type"], "pattern").withColumn("percent", R("percent"))


@query("k9_v2_report", f"WITH {ALL5}, figures AS (SELECT count(*)::DOUBLE AS total, " + ", ".join(f"count(*) FILTER (association = '{a}')::DOUBLE AS {a}" for a in ("methylated", "unmethylated")) + ", " + ", ".join(f"count(*) FILTER (association = '{a}' AND vcf_type = '{t}')::DOUBLE AS {t}_{a}" for t in ("small", "sv", "cnv") for a in ("methylated", "unmethylated")) + " FROM f5) SELECT metric, value FROM (UNPIVOT figures ON COLUMNS(*) INTO NAME metric VALUE value)")
def k9_v2(spark, d):
    """The second version's summary: totals by association, and by class and association."""
    a, t = F.col("v2_association"), F.col("vcf_type")
    kinds = ("methylated", "unmethylated")
    figures = [F.count(F.lit(1)).alias("total"), *[F.count_if(a == k).alias(k) for k in kinds], *[F.count_if((a == k) & (t == v)).alias(f"{v}_{k}") for v in ("small", "sv", "cnv") for k in kinds]]
    return sinks.as_report(all_scores(spark, d).agg(*figures))


@query("k9_v3_report", f"WITH {ALL5}, figures AS (SELECT count(*)::DOUBLE AS analysed, count(v3)::DOUBLE AS passing, (count(*) - count(v3))::DOUBLE AS excluded, " + ", ".join(f"count(v3) FILTER (vcf_type = '{t}')::DOUBLE AS type_{t}" for t in ("small", "sv", "cnv")) + " FROM f5) SELECT metric, value FROM (UNPIVOT figures ON COLUMNS(*) INTO NAME metric VALUE value)")
def k9_v3(spark, d):
    """The third version's summary; its bands are those of ``g27_v3_bands``."""
    n = F.count("v3")
    types = [F.count(F.when(F.col("vcf_type") == t, F.col("v3"))).alias(f"type_{t}") for t in ("small", "sv", "cnv")]
    return sinks.as_report(all_scores(spark, d).agg(F.count(F.lit(1)).alias("analysed"), n.alias("passing"), (F.count(F.lit(1)) - n).alias("excluded"), *types))


@query("k9_simple_report", f"WITH {ALL5}, x AS (SELECT * FROM f5 WHERE pattern IS NOT NULL), figures AS (SELECT " + ", ".join([*(f"count(*) FILTER (pattern = '{p}')::DOUBLE AS {p}" for p in ("methylated_associated", "unmethylated_associated")), *(f"count(*) FILTER (vcf_type = '{t}')::DOUBLE AS type_{t}" for t in ("small", "sv", "cnv"))]) + ", round(avg(seen), 1) AS samples_mean, round(median(seen), 1) AS samples_median, min(seen)::DOUBLE AS samples_min, max(seen)::DOUBLE AS samples_max FROM x) SELECT metric, value FROM (UNPIVOT figures ON COLUMNS(*) INTO NAME metric VALUE value)")
def k9_simple(spark, d):
    """The simple version's summary: patterns, classes and samples per variant."""
    x = all_scores(spark, d).filter("simple_class is not null")
    figures = [F.count_if(F.col("simple_class") == p).alias(p) for p in ("methylated_associated", "unmethylated_associated")] + [F.count_if(F.col("vcf_type") == t).alias(f"type_{t}") for t in ("small", "sv", "cnv")]
    return sinks.as_report(x.agg(*figures, R(F.avg("seen"), 1).alias("samples_mean"), R(F.median("seen"), 1).alias("samples_median"), F.min("seen").alias("samples_min"), F.max("seen").alias("samples_max")))


@query("k9_merge_report", f"WITH {MERGED}, q AS (SELECT vcf_type, count(*) AS initial, count(*) FILTER (qual >= 20 AND depth >= 10) AS final FROM site GROUP BY vcf_type) SELECT vcf_type, initial, final, initial - final AS removed, printf('%.2f%%', final * 100.0::DOUBLE / initial) AS retained FROM q")
def k9_merge(spark, d):
    """Per class the merged sites before and after the filter on quality and depth."""
    sites, _ = merged_calls(spark, d)
    q = sites.groupBy("vcf_type").agg(F.count(F.lit(1)).alias("initial"), F.count_if((F.col("qual") >= 20) & (F.col("depth") >= 10)).alias("final"))
    return q.select("*", (F.col("initial") - F.col("final")).alias("removed"), F.format_string("%.2f%%", F.col("final") * 100.0 / F.col("initial")).alias("retained"))


# pileup cleaning

REF = duck("reference_seq") + ", n AS (SELECT count(*) AS n FROM documents)"
SITES = f"""{REF}, v0 AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % (SELECT n FROM n) AS BIGINT) AS contig FROM orders),
 v AS (SELECT o_orderkey, o_custkey, contig, CAST(o_custkey % length(seq) + 1 AS BIGINT) AS pos, seq FROM v0 JOIN reference_seq ON contig = doc_id WHERE length(seq) > 0),
 w AS (SELECT *, substr(seq, pos, 1) AS ref, CASE WHEN o_orderkey % 7 = 0 THEN 'CGT' ELSE substr('ACGT', CAST(o_custkey % 4 + 1 AS INT), 1) END AS alt, greatest(pos - 3, 0) AS w0 FROM v),
 x AS (SELECT *, substr(seq, w0 + 1, 5) AS rw, substr(substr(seq, w0 + 1, pos - 1 - w0) || alt || substr(seq, pos + 1, w0 + 5 - pos), 1, length(substr(seq, w0 + 1, 5))) AS aw FROM w),
 y AS (SELECT *, list_filter(range(0, 4), lambda i: substr(rw, i + 1, 2) = 'CG') AS rc, list_filter(range(0, 4), lambda i: substr(aw, i + 1, 2) = 'CG') AS ac FROM x),
 ch AS (SELECT *, list_transform(list_filter(rc, lambda i: NOT list_contains(ac, i)), lambda i: i + w0) AS destroyed, list_transform(list_filter(ac, lambda i: NOT list_contains(rc, i)), lambda i: i + w0) AS created, 'S' || (o_orderkey % 17) AS sample_id, CASE (o_orderkey * 5 + o_custkey) % 5 WHEN 0 THEN '1|1' WHEN 1 THEN '0|1' WHEN 2 THEN '1|0' WHEN 3 THEN '0/1' ELSE '0|0' END AS gt, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS ps FROM y),
 ef0 AS (SELECT sample_id, h AS hap, contig, unnest(destroyed) AS pos, 'ref_destroyed' AS effect FROM ch, (VALUES ('hap1'), ('hap2')) t(h) WHERE gt = '1|1'
  UNION SELECT sample_id, h, contig, unnest(created), 'homozygous_denovo' FROM ch, (VALUES ('hap1'), ('hap2')) t(h) WHERE gt = '1|1'
  UNION SELECT sample_id, CASE gt WHEN '0|1' THEN 'hap2' ELSE 'hap1' END, contig, unnest(destroyed), 'ref_destroyed' FROM ch WHERE gt IN ('0|1', '1|0') AND ps IS NOT NULL
  UNION SELECT sample_id, CASE gt WHEN '0|1' THEN 'hap2' ELSE 'hap1' END, contig, unnest(created), 'denovo_created' FROM ch WHERE gt IN ('0|1', '1|0') AND ps IS NOT NULL
  UNION SELECT sample_id, CASE gt WHEN '0|1' THEN 'hap1' ELSE 'hap2' END, contig, unnest(created), 'phantom_sites' FROM ch WHERE gt IN ('0|1', '1|0') AND ps IS NOT NULL),
 effects AS (SELECT e.* FROM ef0 e LEFT JOIN reference_seq r ON e.contig = r.doc_id WHERE effect <> 'phantom_sites' OR substr(r.seq, CAST(e.pos + 1 AS INT), 2) <> 'CG')"""


def reference(spark, d):
    """The reference sequences and their chunks, built once and kept as files."""
    path = scratch(spark)
    view(spark, d, "reference_seq").filter("length(seq) > 0").write.parquet(path)
    ref = spark.read.parquet(path)
    return ref, files.reference_chunks(ref, chunk=65536, overlap=8)


def called_variants(spark, d, ref, long=False):
    """Variants placed on the sequences; ``long`` ones replace up to 40 bases by the first of them."""
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    o = view(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % n).alias("contig"))
    v = o.join(ref.select(F.col("doc_id").alias("contig"), "seq"), "contig").withColumn("pos", F.col("o_custkey") % F.length("seq") + 1)
    short = F.when(F.col("o_orderkey") % 7 == 0, "CGT").otherwise(F.expr("substring('ACGT', cast(o_custkey % 4 + 1 as int), 1)"))
    bases = F.expr("substring(seq, cast(pos as int), " + ("cast(o_orderkey % 40 + 1 as int)" if long else "1") + ")")
    v = v.select("o_orderkey", "o_custkey", "contig", "pos", bases.alias("ref"), (F.expr("substring(seq, cast(pos as int), 1)") if long else short).alias("alt"))
    key = (F.col("o_orderkey") * 5 + F.col("o_custkey")) % 5
    return v.withColumn("sample_id", F.concat(F.lit("S"), (F.col("o_orderkey") % 17).cast("string"))).withColumn("gt", F.when(key == 0, "1|1").when(key == 1, "0|1").when(key == 2, "1|0").when(key == 3, "0/1").otherwise("0|0")).withColumn("phase_set", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")))


def changes(spark, d):
    ref, chunks = reference(spark, d)
    return E.window_changes(E.variant_windows(called_variants(spark, d, ref), chunks))


def effects(spark, d):
    ref, chunks = reference(spark, d)
    found = E.cpg_effects(E.window_changes(E.variant_windows(called_variants(spark, d, ref), chunks)))
    return E.without_reference_phantoms(found, chunks)


LONG = f"""{REF}, v0 AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % (SELECT n FROM n) AS BIGINT) AS contig FROM orders),
 v AS (SELECT o_orderkey, contig, CAST(o_custkey % length(seq) + 1 AS BIGINT) AS pos, seq FROM v0 JOIN reference_seq ON contig = doc_id WHERE length(seq) > 0),
 w AS (SELECT *, substr(seq, pos, CAST(o_orderkey % 40 + 1 AS INT)) AS ref, substr(seq, pos, 1) AS alt, greatest(pos - 3, 0) AS w0 FROM v),
 x AS (SELECT *, substr(seq, w0 + 1, length(ref) + 4) AS rw, substr(substr(seq, w0 + 1, pos - 1 - w0) || alt || substr(seq, pos + length(ref), w0 + length(ref) + 4 - (pos - 1 + length(ref))), 1, length(substr(seq, w0 + 1, length(ref) + 4))) AS aw FROM w),
 y AS (SELECT *, list_filter(range(0, length(rw) - 1), lambda i: substr(rw, i + 1, 2) = 'CG') AS rc, list_filter(range(0, length(aw) - 1), lambda i: substr(aw, i + 1, 2) = 'CG') AS ac FROM x)"""


@query("j9_long_windows", f"WITH {LONG} SELECT o_orderkey, contig, pos, rw AS ref_window, array_to_string(list_transform(list_filter(rc, lambda i: NOT list_contains(ac, i)), lambda i: i + w0), ',') AS destroyed, array_to_string(list_transform(list_filter(ac, lambda i: NOT list_contains(rc, i)), lambda i: i + w0), ',') AS created FROM y")
def j9_long(spark, d):
    """Deletions of up to 40 bases on chunks of 64, so that most windows lie across an edge."""
    ref, _ = reference(spark, d)
    chunks = files.reference_chunks(ref, chunk=64, overlap=8)
    found = E.window_changes(E.variant_windows(called_variants(spark, d, ref, long=True), chunks, chunk=64, overlap=8))
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("o_orderkey", "contig", "pos", "ref_window", j("destroyed"), j("created"))


@query("j9_x4_x5_x6_window_changes", f"WITH {SITES} SELECT o_orderkey, contig, pos, rw AS ref_window, array_to_string(destroyed, ',') AS destroyed, array_to_string(created, ',') AS created FROM ch")
def j9(spark, d):
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return changes(spark, d).select("o_orderkey", "contig", "pos", "ref_window", j("destroyed"), j("created"))


@query("j10_cpg_index", f"WITH {REF}, p AS (SELECT doc_id AS contig, unnest(list_filter(range(0, length(seq) - 1), lambda i: substr(seq, i + 1, 2) = 'CG')) AS pos FROM reference_seq WHERE length(seq) > 1) SELECT contig, CAST(pos // 4096 AS INT) AS block, pos FROM p")
def j10_index(spark, d):
    """Every CpG position of the reference, written in ranges of contig and position and read back."""
    ref, _ = reference(spark, d)
    path = scratch(spark)
    E.write_cpg_index(files.reference_chunks(ref, chunk=8192, overlap=8), path, chunk=8192)
    return spark.read.parquet(path)


@query("x7_j10_u3_effects", f"WITH {SITES} SELECT sample_id, hap, contig, pos, effect FROM effects")
def x7(spark, d):
    return effects(spark, d).select("sample_id", "hap", "contig", "pos", "effect")


@query("g4_distinct_positions", f"WITH {SITES} SELECT effect, count(DISTINCT (contig, pos)) AS n FROM effects GROUP BY effect")
def g4(spark, d):
    return effects(spark, d).groupBy("effect").agg(F.count_distinct("contig", "pos").alias("n"))


# pileup sites against variant sites that share their coordinates
PQ = f"{duck('pileup', 'genotypes')}, ef AS (SELECT DISTINCT sample_id, CASE WHEN pos % 2 = 0 THEN 'hap1' ELSE 'hap2' END AS hap, chrom, (pos - 1) // 80 * 80 + 11 AS pos, CASE WHEN pos % 3 = 0 THEN 'phantom_sites' WHEN pos % 3 = 1 THEN 'ref_destroyed' WHEN gt = '1|1' THEN 'homozygous_denovo' ELSE 'denovo_created' END AS effect FROM genotypes WHERE gt IN ('1|1', '0|1')), vs AS (SELECT DISTINCT sample_id, chrom, (pos - 1) // 80 * 80 + 11 AS start_pos FROM genotypes WHERE vcf_type = 'sv' AND gt IN ('1|1', '0|1')), hit AS (SELECT DISTINCT sample_id, hap, chrom, pos AS start_pos FROM ef WHERE effect IN ('ref_destroyed', 'phantom_sites')), cl AS (SELECT p.*, h.chrom IS NOT NULL AS in_effect, h.chrom IS NOT NULL AND mod_probability > 0.05 AND coverage >= 10 AND vs.chrom IS NULL AS preserved FROM pileup p LEFT JOIN hit h ON p.sample_id = h.sample_id AND p.hap = h.hap AND p.chrom = h.chrom AND p.start_pos = h.start_pos LEFT JOIN vs ON p.sample_id = vs.sample_id AND p.chrom = vs.chrom AND p.start_pos = vs.start_pos)"


def site_effects(spark, d):
    g = gen(spark, d).filter("gt in ('1|1', '0|1')")
    return g.select("sample_id", F.when(F.col("pos") % 2 == 0, "hap1").otherwise("hap2").alias("hap"), "chrom", F.expr("(pos - 1) div 80 * 80 + 11").alias("pos"), F.when(F.col("pos") % 3 == 0, "phantom_sites").when(F.col("pos") % 3 == 1, "ref_destroyed").when(F.col("gt") == "1|1", "homozygous_denovo").otherwise("denovo_created").alias("effect")).distinct()


def cleaned(spark, d):
    """Pileup sites with their status; the places of structural variants count as variant positions."""
    sites = gen(spark, d).filter("vcf_type = 'sv' and gt in ('1|1', '0|1')").select("sample_id", "chrom", F.expr("(pos - 1) div 80 * 80 + 11").alias("pos"))
    return E.apply_effects(view(spark, d, "pileup"), site_effects(spark, d), sites, min_prob=0.05)


def qc(spark, d):
    return E.qc_summary(cleaned(spark, d), site_effects(spark, d))


@query("j1_p20_site_exclusion", f"WITH {PQ} SELECT sample_id, hap, chrom, start_pos, in_effect, preserved, CASE WHEN in_effect AND NOT preserved THEN 'excluded' ELSE 'kept' END AS status FROM cl")
def j1(spark, d):
    return cleaned(spark, d).select("sample_id", "hap", "chrom", "start_pos", "in_effect", "preserved", "status")


@query("j2_combined_exclusion", f"WITH {PQ} SELECT p.sample_id, count(*) AS n FROM pileup p ANTI JOIN (SELECT DISTINCT sample_id, chrom, start_pos FROM hit) h ON p.sample_id = h.sample_id AND p.chrom = h.chrom AND p.start_pos = h.start_pos GROUP BY p.sample_id")
def j2(spark, d):
    return E.apply_effects_combined(view(spark, d, "pileup"), site_effects(spark, d)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


EC = ", ".join(f"count(*) FILTER (effect = '{e}') AS {c}" for c, e in E.EFFECT_COUNTERS.items())
ALL8 = [*E.COUNTERS, *E.EFFECT_COUNTERS]
QC = f"{PQ}, qs AS (SELECT sample_id, hap, count(*) AS total, count(*) FILTER (NOT in_effect OR preserved) AS kept, count(*) FILTER (in_effect AND NOT preserved) AS excluded, count(*) FILTER (preserved) AS preserved FROM cl GROUP BY ALL), qe AS (SELECT sample_id, hap, {EC} FROM ef GROUP BY ALL), qc AS (SELECT sample_id, hap, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ALL8)} FROM qs FULL JOIN qe USING (sample_id, hap))"
QL = "l AS (" + " UNION ALL ".join(f"SELECT sample_id, hap, '{c}' AS metric, {c} AS v FROM qc" for c in ALL8) + ")"


@query("g3_qc_counters", f"WITH {QC} SELECT * FROM qc")
def g3(spark, d):
    return qc(spark, d)


@query("g21_qc_metric_summary", f"WITH {QC}, {QL}, o AS (SELECT metric, avg(v) AS mean, stddev_pop(v) AS std FROM l GROUP BY metric) SELECT sample_id, l.metric, CAST(sum(v) FILTER (hap = 'hap1') AS BIGINT) AS hap1, CAST(sum(v) FILTER (hap = 'hap2') AS BIGINT) AS hap2, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std FROM l JOIN o USING (metric) GROUP BY sample_id, l.metric")
def g21(spark, d):
    return E.qc_metrics(qc(spark, d)).withColumn("mean", R("mean")).withColumn("std", R("std"))


@query("k3_status_split", f"WITH {QC} SELECT CASE WHEN in_effect AND NOT preserved THEN 'excluded' ELSE 'kept' END AS status, sample_id, hap, count(*) AS n FROM cl GROUP BY ALL")
def k3(spark, d):
    path = scratch(spark)
    sinks.write_tsv(cleaned(spark, d).select("chrom", "start_pos", "end_pos", "status", "sample_id", "hap"), path, False, ["status", "sample_id", "hap"])
    return spark.read.csv(path, sep="\t", schema="chrom string, start_pos bigint, end_pos bigint, status string, sample_id string, hap string").groupBy("status", "sample_id", "hap").agg(F.count(F.lit(1)).alias("n"))


@query("k6_s13_qc_summary_file", f"WITH {QC} SELECT * FROM qc")
def k6(spark, d):
    """The summary of all samples in order, written whole each time, so that a repeated run changes nothing; read with a copy."""
    path = scratch(spark)
    found = qc(spark, d)
    found.write.parquet(f"{path}/qc")  # a row per sample and haplotype, worked out once for all writes
    q = spark.read.schema(found.schema).parquet(f"{path}/qc")
    for name in ("a", "a", "b"):
        sinks.write_sorted(q, f"{path}/{name}", ["sample_id", "hap"], sep=",")
    got = files.read_qc_summaries(spark, [f"{path}/a", f"{path}/b"])
    return got.select("sample_id", "hap", *[F.col(c).cast("bigint").alias(c) for c in ALL8])


@query("k9_statistics_report", f"WITH {QC}, {QL} SELECT metric, CAST(sum(v) AS BIGINT) AS value FROM l GROUP BY metric")
def k9(spark, d):
    t = qc(spark, d).agg(*[F.sum(c).alias(c) for c in ALL8])
    return t.unpivot([], ALL8, "metric", "value")
