"""File scans with explicit schemas; bad rows are dropped or kept aside, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PILEUP = "chrom string, start_pos bigint, end_pos bigint, mod_score double, hap string, coverage bigint, est_mod bigint, est_unmod bigint, mod_probability double"
SEGMENT = "chrom string, start_pos bigint, end_pos bigint, label string"


def path_part(pattern: str, group: int = 1) -> Column:
    """A part of the file's path, such as the sample id."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def stem_of(path: Column, suffix: str | None = None) -> Column:
    """The sample id in a path: the file's name up to the first ``_`` or ``.``, or without ``suffix``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, "^[^_.]+", 0) if suffix is None else F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def read_pileup(spark: SparkSession, path, sample: str = r"([^/_.]+)[^/]*$") -> DataFrame:
    """Headerless nine-column pileup; column pruning reaches the scan."""
    df = spark.read.csv(path, sep="\t", schema=PILEUP)
    return df.select("*", path_part(sample).alias("sample_id"))


def read_segments(spark: SparkSession, path, hap: str | None = None, header: bool = False) -> DataFrame:
    """Segments with ``#`` comment lines or a header; adds size and, given a haplotype, a category such as Hap1-M."""
    df = spark.read.csv(path, sep="\t", schema=SEGMENT, comment="#", header=header).withColumn("size", F.col("end_pos") - F.col("start_pos"))
    return df.withColumn("category", F.concat_ws("-", F.lit(hap), "label")) if hap else df


def read_regions(spark: SparkSession, path, on_bad: str = "drop") -> DataFrame:
    """White-space separated regions; rows with too few fields or bad numbers are dropped, or kept with on_bad='flag'."""
    f = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).filter(F.trim("value") != "").select(
        F.get(f, F.lit(0)).alias("chrom"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) as bigint)").alias("start_pos"),
        F.expr("try_cast(get(split(trim(value), '\\\\s+'), 2) as bigint)").alias("end_pos"), F.get(f, F.lit(3)).alias("label"))
    ok = F.col("chrom").isNotNull() & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull() & (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos"))
    ok = F.coalesce(ok, F.lit(False))
    return df.withColumn("ok", ok) if on_bad == "flag" else df.filter(ok)


def read_sized(spark: SparkSession, path) -> DataFrame:
    """Header TSV with string columns; numbers are coerced, rows that fail or have no positive size go."""
    raw = spark.read.csv(path, sep="\t", header=True)
    require(raw, ("chrom", "start", "end"))
    size = F.expr("try_cast(size as bigint)") if "size" in raw.columns else F.lit(None).cast("bigint")
    df = raw.select("chrom", F.expr("try_cast(start as bigint)").alias("start_pos"), F.expr("try_cast(end as bigint)").alias("end_pos"), size.alias("size"))
    return df.dropna(subset=["chrom", "start_pos", "end_pos"]).withColumn("size", F.coalesce("size", F.col("end_pos") - F.col("start_pos"))).filter("size > 0")


def sample_array(col: str) -> Column:
    """``a,b`` to an array; ``.`` and null are the empty set."""
    return F.when(F.col(col).isNull() | (F.col(col) == "."), F.array().cast("array<string>")).otherwise(F.split(col, ","))


CONSENSUS = {"chrom": "string", "start_pos": "bigint", "end_pos": "bigint", "num_samples": "int", "samples": "string", "summary_labels": "string", "size": "bigint", "contributing_samples": "string"}
CANDIDATES = {"chrom": "string", "start_pos": "bigint", "end_pos": "bigint", "size": "bigint", "num_unmethylated": "int", "num_methylated": "int", "unmethylated_samples": "string", "methylated_samples": "string"}


def require(df: DataFrame, columns) -> None:
    """An error that names the columns that a file's header lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {missing}")


def read_consensus(spark: SparkSession, path, least_fields: int = 7, on_bad: str = "drop") -> DataFrame:
    """Consensus regions by position of their fields. Rows of fewer than ``least_fields`` fields or with coordinates that are no
    numbers are dropped, or with on_bad='flag' kept with ``ok`` false; of eight fields the last may be absent."""
    f = F.split("value", "\t")
    cell = lambda i, kind: F.get(f, F.lit(i)).try_cast(kind)
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.regexp_like("value", F.lit("^(#|chrom\t)")))
    df = lines.select((F.size(f) >= least_fields).alias("ok"), *[cell(i, kind).alias(c) for i, (c, kind) in enumerate(CONSENSUS.items())])
    df = df.withColumn("ok", F.coalesce(F.col("ok") & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull(), F.lit(False)))
    df = df.withColumn("samples", sample_array("samples")).withColumn("contributing_samples", sample_array("contributing_samples"))
    return df.select(*CONSENSUS, "ok") if on_bad == "flag" else df.filter("ok").select(*CONSENSUS)


def read_candidates(spark: SparkSession, path) -> DataFrame:
    """Candidate regions by the names in the header, in any order; a name that is missing is an error."""
    raw = spark.read.csv(path, sep="\t", header=True)
    require(raw, CANDIDATES)
    df = raw.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in CANDIDATES.items()])
    return df.withColumn("unmethylated_samples", sample_array("unmethylated_samples")).withColumn("methylated_samples", sample_array("methylated_samples"))


def vcf_headers(lines: DataFrame) -> DataFrame:
    """(file, names): the sample names of each file's header line; a file of several headers has its first in text order."""
    heads = lines.filter(F.startswith("value", F.lit("#CHROM"))).select("file", F.slice(F.split("value", "\t"), 10, 1 << 20).alias("names"))
    return heads.groupBy("file").agg(F.min("names").alias("names"))


def read_vcf_sites(spark: SparkSession, path, vcf_type: str, most_bytes: int = 64 << 20, salts: int = 64) -> DataFrame:
    """One row per record of VCF text (gzip allowed): chrom, pos, variant_id, ref, alt, qual, filter, info, vcf_type, names, gts.

    Sample names come from the header of the same file and stay in its order; the genotype is the first FORMAT field.
    Records with fewer than ten fields are skipped, a record with fewer genotypes than names has nulls at the end. A large
    file of plain text is read by many tasks, a gzip file by one. Headers are one row per file: up to ``most_bytes`` of
    names are broadcast, so that no record moves; beyond that they are spread over ``salts`` copies, so that a large
    file isn't one key.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(~F.startswith("value", F.lit("##")))
    heads = vcf_headers(lines)
    rows = lines.filter(~F.startswith("value", F.lit("#"))).select("file", F.split("value", "\t").alias("f")).filter(F.size("f") >= 10)
    size = heads.agg(F.coalesce(F.sum(F.octet_length(F.array_join("names", ",")) + F.octet_length("file")), F.lit(0)).alias("b")).first()["b"]
    if size <= most_bytes:
        met = rows.join(F.broadcast(heads), "file")
    else:
        spread = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("f"), F.lit(salts)).cast("int")).join(spread, ["file", "_salt"])
    own = F.slice("f", F.lit(10), F.size("names"))
    gts = F.transform(own, lambda c: F.split(c, ":")[0])
    filled = F.concat(gts, F.array_repeat(F.lit(None).cast("string"), F.size("names") - F.size(gts)))
    return met.select(
        F.col("f")[0].alias("chrom"), F.expr("try_cast(f[1] as bigint)").alias("pos"), F.col("f")[2].alias("variant_id"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"),
        F.expr("try_cast(f[5] as double)").alias("qual"), F.col("f")[6].alias("filter"), F.col("f")[7].alias("info"), F.lit(vcf_type).alias("vcf_type"), "names", filled.alias("gts"))


def read_vcf(spark: SparkSession, path, vcf_type: str, **options) -> DataFrame:
    """The long form of ``read_vcf_sites``: a row for each record and sample."""
    site = read_vcf_sites(spark, path, vcf_type, **options)
    keep = [c for c in site.columns if c not in ("names", "gts")]
    return site.select(*keep, F.inline(F.zip_with("names", "gts", lambda n, g: F.struct(n.alias("sample_id"), g.alias("gt")))))


def read_vcf_classes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The genotype tables of several variant classes as one; a class whose file or folder is absent is skipped."""
    out = None
    for vcf_type, path in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            got = read_vcf(spark, path, vcf_type)
            out = got if out is None else out.unionByName(got)
    if out is None:
        raise FileNotFoundError(f"no variant class has a file: {sorted(paths)}")
    return out


def read_sample_list(spark: SparkSession, path, comments: bool = False) -> DataFrame:
    """(ordinal, sample_id) of the non-blank lines in order."""
    df = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "sample_id")).select("line", F.trim("sample_id").alias("sample_id")).filter("sample_id <> ''")
    return df if comments else df.filter(~F.startswith("sample_id", F.lit("#")))


def read_qc_summaries(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False).dropDuplicates()


def read_many(spark: SparkSession, paths: DataFrame, vcf_type: str) -> DataFrame:
    """All VCFs of a path list (one path per line, a bounded list of files)."""
    return read_vcf(spark, [r["value"] for r in paths.filter("trim(value) <> ''").collect()], vcf_type)


def reference_chunks(seqs: DataFrame, id_col: str = "doc_id", seq_col: str = "seq", chunk: int = 65536, overlap: int = 8) -> DataFrame:
    """(contig, chunk_id, chunk_start, seq): overlapping pieces, so any window of up to ``overlap`` bases lies in one."""
    n = F.floor(F.greatest(F.length(seq_col) - 1, F.lit(0)) / chunk).cast("int")
    return seqs.select(F.col(id_col).alias("contig"), seq_col, F.explode(F.sequence(F.lit(0), n)).alias("chunk_id")).select(
        "contig", "chunk_id", (F.col("chunk_id").cast("bigint") * chunk).alias("chunk_start"), F.expr(f"substring({seq_col}, chunk_id * {chunk} + 1, {chunk + overlap})").alias("seq"))
