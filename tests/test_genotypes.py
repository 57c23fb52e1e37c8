"""Packed genotypes: the cohort merge and the nine states against plain loops."""

import random

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import genotypes as G
from tidemark.operators import states

CALLS = "vcf_type string, chrom string, pos bigint, ref string, alt string, gt string, file int, sample_id string"


def merged(spark, rows):
    calls = spark.createDataFrame(rows, CALLS)
    who = G.cohort(calls)
    return G.names_of(who), {(r["pos"], r["kind"]): (r["ref"], r["alts"], r["gts"]) for r in G.merge_cohort(calls, who).collect()}


def test_names_are_forced_to_be_unique(spark):
    s = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a"), (1, "a")], "file int, sample_id string")
    assert G.names_of(G.cohort(s)) == ["a", "2:a", "b", "3:a"]


def test_merge_renumbers_pads_and_keeps_kinds_apart(spark):
    at = lambda pos, ref, alt, gt, file: ("small", "chr1", pos, ref, alt, gt, file, f"s{file}")
    rows = [
        at(10, "A", "C", "0|1", 1), at(10, "A", "G", "1|0", 2), at(10, "A", "G,C", "1|2", 3),  # one SNP, numbers follow the files' order
        at(20, "A", "AT", "0/1", 1), at(20, "AGT", "A", "1/1", 2), at(20, "AG", "A,AGG", "1|2", 3),  # the longest reference pads the others
        at(30, "C", "T", "1|1", 1), at(30, "C", "CA", "0|1", 2),  # a SNP and an insertion are two rows
        at(40, "G", "<DEL>", "0/1", 1), at(40, "GAA", "G", "0|1", 2), at(50, "T", ".", "0/0", 1), at(50, "T", "A", "./1", 2), at(60, "T", "A", "1", 3),
    ]
    names, got = merged(spark, rows)
    assert names == ["s1", "s2", "s3"]
    assert got[10, "snp"] == ("A", ["C", "G"], ["0|1", "2|0", "2|1"])
    assert got[20, "indel"] == ("AGT", ["ATGT", "A", "AT", "AGGT"], ["0/1", "2/2", "3|4"])
    assert got[30, "snp"] == ("C", ["T"], ["1|1", "./.", "./."]) and got[30, "indel"] == ("C", ["CA"], ["./.", "0|1", "./."])
    assert got[40, "indel"] == ("GAA", ["<DEL>", "G"], ["0/1", "0|2", "./."])
    assert got[50, "snp"] == ("T", ["A"], ["0/0", "./1", "./."]) and got[60, "snp"] == ("T", ["A"], ["./.", "./.", "1"])


def test_several_calls_of_a_sample_are_combined(spark):
    rows = [("small", "chr1", 5, "A", a, gt, 1, "s1") for a, gt in (("C", "1|0"), ("G", "0|1"))] + [("small", "chr1", 5, "A", "G", "1|1", 2, "s2"), ("small", "chr1", 6, "A", "T", "./.", 1, "s1"), ("small", "chr1", 6, "A", "C", "0|1", 1, "s1")]
    got = merged(spark, rows)[1]
    assert got[5, "snp"] == ("A", ["C", "G"], ["1|2", "2|2"])
    assert got[6, "snp"] == ("A", ["C", "T"], ["0|1", "./."])


def test_merged_alleles_are_those_of_the_calls(spark):
    """Every genotype of the merged table, put into bases over the merged reference, is what the sample's call says."""
    rng, rows = random.Random(3), []
    for pos in range(200):
        whole = "A" + "".join(rng.choice("CGT") for _ in range(3))
        for s in range(8):
            if rng.random() < 0.7:
                ref = whole[: rng.randrange(1, 5)]
                alts = rng.sample(["C", "G", "T"] if len(ref) == 1 and rng.random() < 0.5 else ["AA", "AAC", "AAAAAA", "A" + ref], 2)
                rows.append(("small", "chr1", pos, ref, ",".join(alts), f"{rng.randrange(3)}{rng.choice('|/')}{rng.randrange(3)}", s + 1, "x"))
    names, got = merged(spark, rows)
    assert names[:2] == ["x", "2:x"]
    for _, _, pos, ref, alt, gt, file, _ in rows:
        alts = alt.split(",")
        kind = "snp" if all(len(a) == len(ref) for a in alts) else "indel"
        m_ref, m_alts, gts = got[pos, kind]
        sep = "|" if "|" in gt else "/"
        bases = [([ref, *alts][int(t)]) + m_ref[len(ref):] for t in gt.split(sep)]
        own = gts[names.index("x" if file == 1 else f"{file}:x")]
        assert [[m_ref, *m_alts][int(t)] for t in own.split(sep)] == bases
        assert len(set(m_alts)) == len(m_alts)


def test_packed_states_equal_the_long_ones(spark):
    rng = random.Random(4)
    names = [f"S-{i}" if i % 2 else f"S_{i}" for i in range(30)]
    rows = [(i, rng.choice(["H1", "H2"]), rng.choice(["small", "cnv"]), [f"S{k}" for k in rng.sample(range(30), 8)], [f"S-{k}" for k in rng.sample(range(30), 8)], [rng.choice(["0|0", "0|1", "1|0", "2/1", "./.", ".|1", None, "1", "0/1"]) for _ in names]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, hap string, vcf_type string, methylated_samples array<string>, unmethylated_samples array<string>, gts array<string>")
    packed = G.cohort_states(df, names)
    got = G.nine_states_packed(packed, names, ["id"], F.col("hap"), C.phased_class(F.col("vcf_type")), lists=True)
    long = [(i, h, t, n.replace("-", "").replace("_", ""), "M" if n.translate({45: None, 95: None}) in m else "U" if n.translate({45: None, 95: None}) in {x.replace("-", "") for x in u} else "X", g) for i, h, t, m, u, gs in rows for n, g in zip(names, gs)]
    want = states.nine_states(spark.createDataFrame(long, "id int, hap string, vcf_type string, sample_id string, meth_state string, gt string"), ["id"], F.col("hap"), C.phased_class(F.col("vcf_type")), lists=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Window" not in plan


def test_fisher_of_a_large_cohort(spark):
    from math import comb

    tables = [(8, 2, 1, 5), (0, 0, 0, 0), (0, 5, 0, 3), (3, 0, 4, 0), (0, 1, 2, 0), (1200, 1300, 1100, 1400), (2500, 0, 0, 2500), (1250, 1250, 1250, 1250)]
    got = spark.createDataFrame(tables, "a bigint, b bigint, c bigint, d bigint").select("*", C.fisher_two_sided(*map(F.col, "abcd")).alias("p")).collect()
    for r in got:
        n, row, col = sum(r[:4]), r.a + r.b, r.a + r.c
        ps = {x: comb(row, x) * comb(n - row, col - x) for x in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(v for v in ps.values() if v * 10**9 <= ps[r.a] * (10**9 + 100))
        assert abs(r.p - float(10**18 * want // sum(ps.values())) / 1e18) <= 1e-9


def test_every_call_of_a_sample_is_listed(spark):
    """As the SQL has it: alternatives in order of file and number, and each allele with every number that the sample's calls give it."""
    rows = [("small", "chr1", 5, "A", "C,G", "1|2", 0, "S0"), ("small", "chr1", 5, "A", "T", "0|1", 0, "S0"), ("small", "chr1", 5, "A", "G", "1/1", 2, "S2"), ("small", "chr1", 9, "A", "G", "0/1", 1, "S1")]
    calls = spark.createDataFrame(rows, "vcf_type string, chrom string, pos int, ref string, alt string, gt string, file int, sample_id string")
    got = {r["pos"]: r for r in G.merge_cohort(calls, G.cohort(calls), every=True).collect()}
    assert got[5]["alts"] == ["C", "T", "G"]
    assert [tuple(x) for x in got[5]["listed"]] == [(0, "0|1"), (0, "0|2"), (0, "1|3"), (0, "2|3"), (1, "./."), (2, "3/3")]
    assert [tuple(x) for x in got[9]["listed"]] == [(0, "./."), (1, "0/1"), (2, "./.")]
