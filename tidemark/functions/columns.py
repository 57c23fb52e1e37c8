"""Scalar column functions over interval, genotype and count columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD = [f"chr{i}" for i in [*range(1, 23), "X", "Y"]]


def chrom_order(chrom: Column) -> Column:
    """Numeric rank: 1-22, X 23, Y 24, M 25, others 999."""
    name = F.regexp_replace(chrom, "^chr", "")
    number = F.when(F.regexp_like(name, F.lit("^[0-9]{1,2}$")), name.cast("int"))
    return F.when(number.between(1, 22), number).when(name == "X", 23).when(name == "Y", 24).when(name == "M", 25).otherwise(999)


def region_key(chrom="chrom", start="start_pos", end="end_pos") -> Column:
    return F.concat(F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def midpoint(start="start_pos", end="end_pos") -> Column:
    return (F.col(start) + F.col(end)) / 2


def valid_region() -> Column:
    return F.coalesce((F.col("chrom") != "") & (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos")), F.lit(False))


def combined_label(hap: Column, label: Column) -> Column:
    """hap1 and M to H1_M."""
    return F.concat_ws("_", F.regexp_replace(hap, "^hap", "H"), label)


def status_colour(label: Column) -> Column:
    return F.when(label == "M", "255,0,0").when(label == "U", "0,0,255").otherwise("0,0,0")


def normalize_sample(name: Column) -> Column:
    return F.translate(name, "-_", "")


def parse_samples(text: Column) -> Column:
    """Null or ``.`` to the empty set; commas and semicolons separate; sorted and distinct."""
    parts = F.filter(F.transform(F.split(F.translate(text, ";", ","), ","), lambda x: normalize_sample(F.trim(x))), lambda x: x != "")
    return F.when(text.isNull() | (F.trim(text) == "."), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(parts)))


def alleles(gt: Column) -> Column:
    return F.transform(F.split(gt, "[|/]"), lambda a: F.when(F.regexp_like(a, F.lit("^[0-9]+$")), a.cast("int")))


def missing(gt: Column) -> Column:
    """No numeric allele."""
    return ~F.exists(alleles(gt), lambda a: a.isNotNull())


def carrier(gt: Column, hap: str | Column, phased: Column) -> Column:
    """Whether a genotype carries the variant; for phased classes and a phased genotype only the haplotype's allele counts."""
    a = alleles(gt)
    at = F.when((F.lit(hap) if isinstance(hap, str) else hap) == "H1", 0).otherwise(1)
    own = F.coalesce(F.get(a, at) > 0, F.lit(False))
    return F.when(phased & F.contains(gt, F.lit("|")), own).otherwise(F.exists(a, lambda x: F.coalesce(x > 0, F.lit(False))))


def phased_class(vcf_type: Column) -> Column:
    return vcf_type.isin("small", "sv")


def variant_type(vcf_type: Column, ref: Column, alt: Column) -> Column:
    small = F.when((F.length(ref) == 1) & (F.length(alt) == 1), "snp").when(F.length(ref) > F.length(alt), "deletion").otherwise("insertion")
    return F.when(vcf_type == "small", small).otherwise(vcf_type)


def variant_end(pos: Column, ref: Column) -> Column:
    return pos + F.length(ref) - 1


def fallback_id(variant_id: Column, vcf_type: Column, chrom: Column, pos: Column) -> Column:
    return F.when(variant_id == ".", F.concat_ws("_", vcf_type, chrom, pos.cast("string"))).otherwise(variant_id)


def annotated_id(vcf_type: Column, chrom: Column, pos: Column, ref: Column, alt: Column, info: Column | None = None) -> Column:
    base = F.concat_ws(":", chrom, pos.cast("string"), ref, alt)
    if info is None:
        return base
    field = F.str_to_map(info, F.lit(";"), F.lit("="))
    return F.when(vcf_type == "sv", F.concat_ws(":", base, F.coalesce(field["SVANN"], F.lit(".")))).when(vcf_type == "cnv", F.concat_ws(":", base, F.coalesce(field["SVLEN"], F.lit(".")))).otherwise(base)


def variant_passes(vcf_type: Column, qual: Column, filter_: Column, depth: Column) -> Column:
    good = F.when(vcf_type == "small", (qual >= 20) & (depth >= 10)).when(vcf_type == "sv", (filter_ == "PASS") & (depth >= 10)).when(vcf_type == "cnv", (qual >= 20) & (filter_ == "PASS")).otherwise(F.lit(True))
    return F.coalesce(good, F.lit(False))


def ratio_text(n: Column, total: Column) -> Column:
    """``n/N (p%)``, ``0/0 (0.0%)`` where there is nothing to divide by."""
    percent = F.round(F.when(total > 0, n * 100.0 / total).otherwise(0.0), 1)
    return F.format_string("%d/%d (%.1f%%)", n.cast("bigint"), total.cast("bigint"), percent)


def high_confidence(min_prob: float = 0.9, min_cov: int = 10) -> Column:
    return (F.col("mod_probability") > min_prob) & (F.col("coverage") >= min_cov)


def cpg_positions(seq: Column) -> Column:
    """0-based places of CG, by the lengths of what lies between them: no look-up by place, which takes as long as the place is far."""
    none = F.array().cast("array<int>")
    between = F.transform(F.split(seq, "CG"), F.length)
    places = F.aggregate(F.slice(between, F.lit(1), F.size(between) - 1), none, lambda at, n: F.array_append(at, n + F.coalesce(F.try_element_at(at, F.lit(-1)) + 2, F.lit(0))))
    return F.when(F.length(seq) >= 2, places).otherwise(none)


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher exact test of [[a, b], [c, d]]: the sum of the tables with the same margins that are no likelier.

    A table's probability relative to the first possible one follows from its neighbour's by a ratio, so two folds over
    the possible values of ``a`` keep a few numbers each, whatever the cohort's size. Logarithms keep the products in range.
    """
    n, row, col = a + b + c + d, a + b, a + c
    low, high = F.greatest(F.lit(0), row + col - n).cast("int"), F.least(row, col).cast("int")
    zero = F.lit(0.0)

    def step(l: Column, x: Column) -> Column:
        """ln p(x) - ln p(low) from that of x - 1."""
        ratio = (row - x + 1).cast("double") * (col - x + 1) / (x.cast("double") * (n - row - col + x))
        return F.when(x == low, zero).otherwise(l + F.log(ratio))

    first = F.struct(zero.alias("l"), zero.alias("own"), zero.alias("top"))
    seen = F.aggregate(F.sequence(low, high), first, lambda s, x: F.struct(step(s["l"], x).alias("l"), F.when(x == a, step(s["l"], x)).otherwise(s["own"]).alias("own"), F.greatest(s["top"], step(s["l"], x)).alias("top")))
    start = F.struct(zero.alias("l"), zero.alias("some"), zero.alias("all"))

    def add(top: Column):
        def one(s: Column, x: Column) -> Column:
            l = step(s["l"], x)
            e = F.exp(l - top["top"])
            return F.struct(l.alias("l"), (s["some"] + F.when(l <= top["own"] + 1e-7, e).otherwise(zero)).alias("some"), (s["all"] + e).alias("all"))

        return one

    total = F.transform(F.array(seen), lambda t: F.aggregate(F.sequence(low, high), start, add(t), lambda s: s["some"] / s["all"]))[0]
    return F.least(F.lit(1.0), total)


def confidence_weight(coverage: Column) -> Column:
    return F.when(coverage >= 0.8, 1.0).when(coverage >= 0.6, 0.7).when(coverage >= 0.4, 0.4).otherwise(0.1)


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def score_v1(m_plus: Column, m_total: Column, u_plus: Column, u_total: Column, coverage: Column, p: Column) -> tuple[Column, Column]:
    """Methylation and unmethylation scores of the first version."""
    r_m, r_u, w = _share(m_plus, m_total), _share(u_plus, u_total), confidence_weight(coverage)
    penalty = 0.1 * F.log10(F.greatest(p, F.lit(1e-10)))
    return w * (0.4 * r_m + 0.6 * (1 - r_u)) - penalty, w * (0.4 * r_u + 0.6 * (1 - r_m)) - penalty


def score_v2(m_plus: Column, m_total: Column, u_plus: Column, u_total: Column, coverage: Column, p: Column) -> tuple[Column, Column]:
    r_m, r_u, w = _share(m_plus, m_total), _share(u_plus, u_total), confidence_weight(coverage)
    e_m, e_u, gain = F.greatest(F.lit(0.0), r_m - r_u), F.greatest(F.lit(0.0), r_u - r_m), -F.log10(F.greatest(p, F.lit(1e-10)))
    return w * (0.5 * e_m + 0.3 * (1 - e_u) + 0.2 * gain), w * (0.5 * e_u + 0.3 * (1 - e_m) + 0.2 * gain)


def score_v3(plus: Column, other_plus: Column, minus: Column, other_minus: Column, coverage: Column) -> Column:
    """Score in [0, 1] from carriers and non-carriers in the state and in the other one; null without carriers."""
    n, back = plus + other_plus, minus + other_minus
    rate, bg = plus / n, F.when(back > 0, minus / back).otherwise(0.0)
    steady = 1 - F.sqrt(rate * (1 - rate)) / F.sqrt(n.cast("double"))
    raw = 0.5 * (rate - bg) + 0.3 * steady + 0.2 * F.least(F.lit(1.0), 2 * coverage)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 1) / 2 * F.least(F.lit(1.0), n / 10))))


EPS = 1e-10


def score_v4(plus: Column, total: Column, other_plus: Column, other_total: Column, quality: Column, least: int = 10) -> tuple[Column, Column]:
    """(log odds, enrichment score): null below ``least`` samples in the state."""

    def log_odds(f: Column) -> Column:
        return F.log((f + EPS) / (1 - f + EPS))

    odds = log_odds(plus / total) - log_odds((plus + other_plus) / (total + other_total))
    score = 1 / (1 + F.exp(-odds)) * F.least(F.lit(1.0), total / 10) * quality
    return F.when(total >= least, odds), F.when(total >= least, score)


def classify_v4(m: Column, u: Column) -> Column:
    return F.when(m.isNull() | u.isNull(), "insufficient_data").when(m > 2 * u, "methylated_associated").when(u > 2 * m, "unmethylated_associated").otherwise("no_strong_association")


def classify_clean(m_plus: Column, u_plus: Column, m_minus: Column, u_minus: Column, least: int = 5) -> Column:
    enough = (m_plus + u_plus >= least) & (m_minus + u_minus >= least)
    return F.when(enough & (u_plus == 0) & (m_minus == 0), "methylated_associated").when(enough & (m_plus == 0) & (u_minus == 0), "unmethylated_associated")


def region_score(m: Column, u: Column) -> Column:
    n = m + u
    return F.when(n > 0, (m - u) / n * F.log2((n + 1).cast("double"))).otherwise(0.0)


def score_band(score: Column) -> Column:
    """Seven bands at 1, 0.5, 0, -0.5 and -1; exactly 0 is neutral."""
    return F.when(score > 1, "Strongly Methylated").when(score > 0.5, "Moderately Methylated").when(score > 0, "Weakly Methylated").when(score == 0, "Neutral").when(score > -0.5, "Weakly Unmethylated").when(score > -1, "Moderately Unmethylated").otherwise("Strongly Unmethylated")


#: Fixed value: the layout of a region score's explanation.
EXPLANATION = "Total Samples: %d\nMethylated: %d (%.3f)\nUnmethylated: %d (%.3f)\nProportion Difference: %.3f\nSample Weight (log2(total + 1)): %.3f\nFinal Score: %.3f × %.3f = %.3f\nInterpretation: %s"


def score_text(m: Column, u: Column, score: Column) -> Column:
    """How a region's score comes about, step by step."""
    n = (m + u).cast("bigint")
    of = lambda x: F.round(F.when(n > 0, x / n).otherwise(0.0), 3)
    gap, weight = of(m - u), F.round(F.log2((n + 1).cast("double")), 3)
    return F.format_string(EXPLANATION, n, m.cast("bigint"), of(m), u.cast("bigint"), of(u), gap, weight, gap, weight, F.round(score, 3), score_band(score))
