"""Genome dimensions: a few dozen rows, always small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: GRCh38 chromosome sizes in base pairs.
CHROM_SIZES = {
    "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979, "chr7": 159345973, "chr8": 145138636,
    "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309, "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345,
    "chr17": 83257441, "chr18": 80373285, "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415,
}
#: GRCh38 centromere ranges in base pairs.
CENTROMERES = {
    "chr1": (122026459, 124932724), "chr2": (92188145, 94090557), "chr3": (90772458, 93655574), "chr4": (49712061, 51743951), "chr5": (46485900, 50059807), "chr6": (58553888, 59829934),
    "chr7": (58169653, 61528020), "chr8": (44033744, 45877265), "chr9": (43389635, 45518558), "chr10": (39686682, 41593521), "chr11": (51078348, 54425074), "chr12": (34769407, 37185252),
    "chr13": (16000000, 18051248), "chr14": (16000000, 18173523), "chr15": (17083673, 19725254), "chr16": (36311158, 38265669), "chr17": (22813679, 26616164), "chr18": (15460899, 20813083),
    "chr19": (24498980, 27190874), "chr20": (26436232, 30038348), "chr21": (10864560, 12915808), "chr22": (12954788, 15054318), "chrX": (58605579, 62412542), "chrY": (10316944, 10544039),
}
#: GRCh38 special regions, as (chromosome, start, end, name, kind).
SPECIAL = [
    ("chr1", 121700000, 125100000, "Heterochromatin", "Heterochromatic"), ("chr9", 42200000, 45500000, "Heterochromatin", "Heterochromatic"), ("chr16", 35335801, 36185801, "Heterochromatin", "Heterochromatic"),
    ("chr13", 0, 16000000, "Short arm (p)", "Acrocentric"), ("chr14", 0, 16000000, "Short arm (p)", "Acrocentric"), ("chr15", 0, 17000000, "Short arm (p)", "Acrocentric"),
    ("chr21", 0, 12000000, "Short arm (p)", "Acrocentric"), ("chr22", 0, 14000000, "Short arm (p)", "Acrocentric"),
    ("chrX", 10000, 2781479, "PAR1", "Pseudoautosomal"), ("chrX", 155701383, 156030895, "PAR2", "Pseudoautosomal"), ("chrY", 10000, 2781479, "PAR1", "Pseudoautosomal"), ("chrY", 56887903, 57217415, "PAR2", "Pseudoautosomal"),
    ("chrY", 13000000, 59373566, "Heterochromatin", "Heterochromatic"), ("chrY", 14000000, 15000000, "AZFa", "Ampliconic"), ("chrY", 18000000, 24000000, "AZFb", "Ampliconic"), ("chrY", 24000000, 28000000, "AZFc", "Ampliconic"),
]


def _features() -> list[tuple[str, int, int, str, str]]:
    return [(c, a, b, "Centromere", "Centromere") for c, (a, b) in CENTROMERES.items()] + SPECIAL


def chrom_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHROM_SIZES.items()), "chrom string, chrom_size bigint")


def features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_features(), "chrom string, f_start bigint, f_end bigint, feature string, kind string")


def sizes_sql() -> str:
    return "chrom_sizes(chrom, chrom_size) AS (VALUES " + ", ".join(f"('{c}', {n}::BIGINT)" for c, n in CHROM_SIZES.items()) + ")"


def features_sql() -> str:
    return "features(chrom, f_start, f_end, feature, kind) AS (VALUES " + ", ".join(f"('{c}', {a}::BIGINT, {b}::BIGINT, '{n}', '{k}')" for c, a, b, n, k in _features()) + ")"
