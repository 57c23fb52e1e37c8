"""Nine methylation-by-genotype states per (region, variant), and the scores on their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def variants_in_regions(variants: DataFrame, regions: DataFrame, by: tuple[str, ...] = ("chrom",), width: int = 2048) -> DataFrame:
    """Variants whose span [pos, pos + len(ref) - 1] meets [start_pos, end_pos], both inclusive."""
    from .intervals import overlap_join

    spans = variants.withColumn("_v_start", F.col("pos")).withColumn("_v_end", F.col("pos") + F.length("ref"))
    a = spans.withColumnRenamed("_v_start", "start_pos").withColumnRenamed("_v_end", "end_pos")
    b = regions.withColumn("region_start", F.col("start_pos")).withColumn("region_end", F.col("end_pos")).withColumn("end_pos", F.col("end_pos") + 1)
    out = overlap_join(a, b, by, width).drop("start_pos", "end_pos", "b_start_pos", "b_end_pos")
    return out.select(*[F.col(c).alias(c.removeprefix("b_")) for c in out.columns])


def state_of(meth_state, gt, hap, phased):
    """'M+V+' and so on: M+ / M- / X(M) by the state column, V+ / V- / X(V) by the genotype."""
    m = F.when(meth_state == "M", "M+").when(meth_state == "U", "M-").otherwise("X(M)")
    v = F.when(gt.isNull() | C.missing(gt), "X(V)").when(C.carrier(gt, hap, phased), "V+").otherwise("V-")
    return F.concat(m, v)


#: The nine states and their column names.
STATES = {"M+V+": "m_plus", "M+V-": "m_minus", "M+X(V)": "m_none", "M-V+": "u_plus", "M-V-": "u_minus", "M-X(V)": "u_none", "X(M)V+": "x_plus", "X(M)V-": "x_minus", "X(M)X(V)": "x_none"}


def nine_states(rows: DataFrame, keys: list[str], hap, phased=None, lists: bool = False) -> DataFrame:
    """Counts per key, and if asked for the samples of each state with their genotypes; one shuffle on the keys.

    rows: keys, sample_id, meth_state, gt. ``hap`` is a haplotype's name or the column that holds it.
    """
    s = rows.withColumn("_s", state_of(F.col("meth_state"), F.col("gt"), hap, phased if phased is not None else F.lit(True)))
    counts = [F.count_if(F.col("_s") == k).alias(v) for k, v in STATES.items()]
    named = [F.array_sort(F.collect_list(F.when(F.col("_s") == k, F.concat_ws(":", "sample_id", "gt")))).alias(f"{v}_samples") for k, v in STATES.items()] if lists else []
    return s.groupBy(*keys).agg(*counts, *named)


def with_totals(counts: DataFrame) -> DataFrame:
    """Totals per state, the two coverage figures and the quality of the fourth version."""
    c = F.col
    out = counts.withColumn("total_meth", c("m_plus") + c("m_minus") + c("m_none")).withColumn("total_unmeth", c("u_plus") + c("u_minus") + c("u_none")).withColumn("total", c("total_meth") + c("total_unmeth") + c("x_plus") + c("x_minus") + c("x_none"))
    seen = c("total") - c("x_none")
    out = out.withColumn("coverage_v1", F.when(seen > 0, (c("total_meth") + c("total_unmeth")) / seen).otherwise(0.0))
    out = out.withColumn("coverage_v2", F.when(c("total") > 0, (c("total_meth") + c("total_unmeth") + c("x_plus") + c("x_minus")) / c("total")).otherwise(0.0))
    complete = c("m_plus") + c("u_plus") + c("m_minus") + c("u_minus")
    doubled = c("total_meth") + c("total_unmeth") + c("x_plus") + c("x_minus") + c("x_none") + c("x_plus") + c("m_minus") + c("u_minus") + c("x_minus") + c("x_none")
    return out.withColumn("quality", F.when(doubled > 0, complete / doubled).otherwise(0.0))


def scored(totals: DataFrame, least_state: int = 10, least_clean: int = 5) -> DataFrame:
    """All five scorings on one count table; the fourth needs ``least_state`` samples, the simple one ``least_clean``."""
    c = lambda n: F.col(n).cast("double")
    out = totals.withColumn("p_value", C.fisher_two_sided(F.col("m_plus"), F.col("total_meth") - F.col("m_plus"), F.col("u_plus"), F.col("total_unmeth") - F.col("u_plus")))
    v1 = C.score_v1(c("m_plus"), c("total_meth"), c("u_plus"), c("total_unmeth"), F.col("coverage_v1"), F.col("p_value"))
    v2 = C.score_v2(c("m_plus"), c("total_meth"), c("u_plus"), c("total_unmeth"), F.col("coverage_v2"), F.col("p_value"))
    m4 = C.score_v4(c("m_plus"), c("m_plus") + c("m_minus"), c("u_plus"), c("u_plus") + c("u_minus"), F.col("quality"), least_state)
    u4 = C.score_v4(c("u_plus"), c("u_plus") + c("u_minus"), c("m_plus"), c("m_plus") + c("m_minus"), F.col("quality"), least_state)
    out = out.withColumns({"v1_meth": v1[0], "v1_unmeth": v1[1], "v2_meth": v2[0], "v2_unmeth": v2[1], "v4_meth_odds": m4[0], "v4_meth": m4[1], "v4_unmeth_odds": u4[0], "v4_unmeth": u4[1]})
    out = out.withColumn("v2_association", F.when(F.col("v2_meth") > F.col("v2_unmeth"), "methylated").otherwise("unmethylated"))
    out = out.withColumn("v3", C.score_v3(c("m_plus"), c("u_plus"), c("m_minus"), c("u_minus"), F.col("coverage_v2")))
    return out.withColumn("v4_class", C.classify_v4(F.col("v4_meth"), F.col("v4_unmeth"))).withColumn("simple_class", C.classify_clean(F.col("m_plus"), F.col("u_plus"), F.col("m_minus"), F.col("u_minus"), least_clean))
