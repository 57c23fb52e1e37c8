"""Methylation and genotype views derived from the supplied tables by integer arithmetic, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _chrom(key: str) -> str:
    return f"CASE WHEN {key} % 24 = 22 THEN 'chrX' WHEN {key} % 24 = 23 THEN 'chrY' ELSE concat('chr', CAST({key} % 24 + 1 AS STRING)) END"


_SQL = {
    "segments": f"""SELECT {_chrom('l_suppkey')} AS chrom, CAST(l_orderkey * 80 + l_partkey * 31 AS BIGINT) AS start_pos,
        CAST(l_orderkey * 80 + l_partkey * 31 AS BIGINT) + CAST(l_quantity AS BIGINT) * 20 AS end_pos,
        concat('S', CAST(l_orderkey % 17 AS STRING)) AS sample_id, CASE WHEN l_linestatus = 'F' THEN 'H1' ELSE 'H2' END AS hap,
        CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'R' THEN 'U' ELSE 'NoData' END AS label FROM lineitem""",
    "variants": f"""SELECT {_chrom('o_custkey')} AS chrom, CAST(o_orderkey * 80 + o_custkey * 7 + 1 AS BIGINT) AS pos,
        CAST(o_orderkey AS STRING) AS variant_id, o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 5 = 0 THEN 'AC' ELSE substr('ACGT', CAST(o_custkey % 4 + 1 AS INT), 1) END AS ref,
        CASE WHEN o_orderkey % 7 = 0 THEN 'CGT' ELSE substr('ACGT', CAST((o_custkey + 1) % 4 + 1 AS INT), 1) END AS alt,
        CASE o_orderstatus WHEN 'O' THEN 'small' WHEN 'F' THEN 'sv' ELSE 'cnv' END AS vcf_type, CAST(o_totalprice / 5000 AS DOUBLE) AS qual FROM orders""",
    "genotypes": """SELECT v.chrom, v.pos, v.variant_id, v.ref, v.alt, v.vcf_type, concat('S', CAST(k AS STRING)) AS sample_id,
        CASE (v.o_orderkey * (k + 3) + v.o_custkey) % 7 WHEN 1 THEN '0|1' WHEN 2 THEN '1|0' WHEN 3 THEN '1|1' WHEN 4 THEN './.' WHEN 5 THEN '0/1' ELSE '0|0' END AS gt
        FROM variants v CROSS JOIN (SELECT {seq:16} AS k) s""",
    "pileup": f"""SELECT chrom, start_pos, start_pos + 1 AS end_pos, sample_id, hap, mod_score, coverage, mod_score / CAST(100 AS DOUBLE) AS mod_probability
        FROM (SELECT {_chrom('l_suppkey')} AS chrom, CAST(l_orderkey * 80 + l_linenumber * 11 AS BIGINT) AS start_pos, concat('S', CAST(l_orderkey % 17 AS STRING)) AS sample_id,
        CASE WHEN l_linestatus = 'F' THEN 'hap1' ELSE 'hap2' END AS hap, CAST(round(l_discount * 1000) AS BIGINT) AS mod_score, CAST(l_quantity AS BIGINT) AS coverage FROM lineitem) t""",
    "reference_seq": "SELECT doc_id, translate(upper({regexp_replace:text:[^A-Za-z]:}), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS seq FROM documents",
    "assoc": """SELECT region_id, sample_id, meth_state, CASE WHEN (region_id * 3 + k * 13) % 11 = 0 THEN './.'
        WHEN region_id % 4 = 0 THEN CASE WHEN meth_state = 'M' THEN '1|0' ELSE '0|0' END
        WHEN region_id % 4 = 1 THEN CASE WHEN meth_state = 'U' THEN '1|1' ELSE '0|1' END
        WHEN region_id % 4 = 2 THEN CASE WHEN meth_state = 'M' AND (k + region_id) % 2 = 0 THEN '1|0' WHEN meth_state = 'U' AND (k + region_id) % 8 = 0 THEN '1|0' ELSE '0|0' END
        ELSE CASE (region_id * (k + 3)) % 7 WHEN 1 THEN '1|0' WHEN 2 THEN '1|1' WHEN 3 THEN '0/1' ELSE '0|0' END END AS gt
        FROM (SELECT c_custkey AS region_id, k, concat('S', CAST(k AS STRING)) AS sample_id,
        CASE WHEN (c_custkey * 7 + k * 11) % 5 < 2 THEN 'M' WHEN (c_custkey * 7 + k * 11) % 5 < 4 THEN 'U' ELSE 'X' END AS meth_state
        FROM customer CROSS JOIN (SELECT {seq:39} AS k) s) t""",
    "calls": """SELECT vcf_type, chrom, pos, file, sample_id, CASE WHEN mode = 2 THEN concat(base, 'GT') ELSE base END AS ref,
        CASE mode WHEN 0 THEN b1 WHEN 1 THEN b2 WHEN 2 THEN base WHEN 3 THEN concat(base, 'T') ELSE concat(b1, ',', b2) END AS alt,
        CASE WHEN mode = 4 THEN replace(replace(gt, '|1', '|2'), '/1', '/2') ELSE gt END AS gt, qual, depth
        FROM (SELECT vcf_type, chrom, pos, k + 1 AS file, concat('S', CAST(CASE WHEN k = 16 THEN 0 ELSE k END AS STRING)) AS sample_id, gt, substr(ref, 1, 1) AS base,
            translate(substr(ref, 1, 1), 'ACGT', 'CGTA') AS b1, translate(substr(ref, 1, 1), 'ACGT', 'GTAC') AS b2, CAST((v + k) % 5 AS INT) AS mode,
            CAST((v * 7 + k) % 41 AS DOUBLE) AS qual, CAST((v + k * 3) % 13 AS BIGINT) AS depth
            FROM (SELECT *, CAST(substr(sample_id, 2) AS INT) AS k, CAST(variant_id AS BIGINT) AS v FROM genotypes) g WHERE gt <> './.') t""",
}
_NEEDS = {"segments": ["lineitem"], "variants": ["orders"], "genotypes": ["variants"], "calls": ["genotypes"], "pileup": ["lineitem"], "reference_seq": ["documents"], "assoc": ["customer"]}


def _dialect(sql: str, duck: bool) -> str:
    import re

    sql = re.sub(r"\{seq:(\d+)\}", lambda m: f"unnest(range(0, {int(m[1]) + 1}))" if duck else f"explode(sequence(0, {m[1]}))", sql)
    return re.sub(r"\{regexp_replace:(\w+):([^:]*):\}", lambda m: f"regexp_replace({m[1]}, '{m[2]}', ''" + (", 'g')" if duck else ")"), sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views as a DataFrame."""
    if name not in _SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {n: view(spark, sf_dir, n) for n in _NEEDS[name]}
    sql = _dialect(_SQL[name], duck=False)
    for n in needs:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql, **needs)


def duck(*names: str) -> str:
    """``WITH`` clauses (without the keyword) that define the views for DuckDB, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for k in _NEEDS.get(n, []):
            if k in _SQL:
                add(k)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({_dialect(_SQL[n], duck=True)})" for n in order)
