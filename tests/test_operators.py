import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import consensus as K
from tidemark.operators import effects as E
from tidemark.operators import intervals as I
from tidemark.operators import stats


def greedy(regions, gap, least):
    """The merge as a plain loop over sorted (start, end, sample)."""
    done, cur, i = [], None, 0
    regions = sorted(regions)

    def near(r):
        return any(any(p[2] == r[2] for p in d["parts"]) and r[0] <= d["e"] + gap and r[1] >= d["s"] - gap for d in done)

    def close():
        nonlocal cur
        if cur and len({p[2] for p in cur["parts"]}) >= least:
            done.append(cur)
        cur = None

    for r in regions:
        if cur and r[0] <= cur["e"] + gap:
            if any(p[2] == r[2] for p in cur["parts"]) or near(r):
                continue
            cur["parts"].append(r)
            cur["e"] = max(cur["e"], r[1])
            continue
        close()
        if not near(r):
            cur = {"s": r[0], "e": r[1], "parts": [r]}
    close()
    return sorted((d["s"], d["e"], ",".join(sorted({p[2] for p in d["parts"]}))) for d in done)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_consensus_merge_is_the_greedy_loop(spark, least):
    rng = random.Random(least)
    rows = [(s := rng.randrange(20000), s + rng.randrange(1, 90), f"S{rng.randrange(6)}") for _ in range(600)]
    df = spark.createDataFrame([("chr1", "H1", *r) for r in rows], "chrom string, hap string, start_pos bigint, end_pos bigint, sample_id string")
    got = K.consensus_merge(df, 50, least).select("start_pos", "end_pos", F.array_join("samples", ",")).collect()
    assert sorted(map(tuple, got)) == greedy(rows, 50, least)


def test_range_joins_equal_nested_loops(spark):
    rng = random.Random(5)
    iv = lambda n, w: [("c%d" % rng.randrange(2), s := rng.randrange(5000), s + rng.choice([1, rng.randrange(1, w), 4000])) for _ in range(n)]
    a, b = iv(150, 60), iv(150, 200)
    kind = "chrom string, start_pos bigint, end_pos bigint"
    x, y = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    got = I.overlap_join(x, y, width=32, most=4).select("chrom", "start_pos", "end_pos", "b_start_pos", "b_end_pos").collect()
    assert sorted(map(tuple, got)) == sorted((*p, *q[1:]) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and q[1] < p[2])
    got = I.containment_join(x, y, width=32).select("chrom", "start_pos", "end_pos", "b_start_pos", "b_end_pos").collect()
    assert sorted(map(tuple, got)) == sorted((*p, *q[1:]) for p in a for q in b if p[0] == q[0] and q[1] <= p[1] and q[2] >= p[2])
    pts = spark.createDataFrame([(c, s) for c, s, _ in a], "chrom string, pos bigint")
    got = I.point_join(pts, y, width=32).select("chrom", "pos", "start_pos", "end_pos").collect()
    assert sorted(map(tuple, got)) == sorted((c, s, *q[1:]) for c, s, _ in a for q in b if c == q[0] and q[1] <= s < q[2])


def test_islands_cross_blocks(spark):
    rng = random.Random(11)
    rows = [("c", "H1", s := rng.randrange(3000), s + rng.randrange(1, 200), f"S{rng.randrange(4)}") for _ in range(120)] + [("c", "H1", 50, 1500, "S9")]
    df = spark.createDataFrame(rows, "chrom string, hap string, start_pos bigint, end_pos bigint, sample_id string")
    whole, cut = (sorted((r["start_pos"], r["end_pos"], r["sample_id"], r["island"]) for r in K.with_island(df, 3, block=b).collect()) for b in (1 << 20, 100))
    assert whole == cut and len({r[3] for r in whole}) > 3


def test_touching_intervals_do_not_overlap(spark):
    kind = "chrom string, start_pos bigint, end_pos bigint"
    a, b = spark.createDataFrame([("c", 0, 10)], kind), spark.createDataFrame([("c", 10, 20)], kind)
    assert I.overlap_join(a, b).count() == 0


def test_genotypes(spark):
    gts = ["0|1", "1|0", "1|1", "./.", ".|.", "./.:0", "0/1", "0|2", "0|0", "."]
    df = spark.createDataFrame([(g,) for g in gts], "gt string")
    got = {r["gt"]: tuple(r)[1:] for r in df.select("gt", C.carrier(F.col("gt"), "H1", F.lit(True)), C.carrier(F.col("gt"), "H2", F.lit(True)), C.missing(F.split("gt", ":")[0])).collect()}
    assert got["0|1"] == (False, True, False) and got["1|0"] == (True, False, False) and got["0|2"] == (False, True, False)
    assert got["0/1"] == (True, True, False) and got["./."][2] and got[".|."][2] and got["."][2]


def test_sample_names(spark):
    df = spark.createDataFrame([("sample-3_test", "sample-1,sample_2;sample-3"), ("a", ".")], "n string, s string")
    r = df.select(C.normalize_sample(F.col("n")), C.parse_samples(F.col("s"))).collect()
    assert r[0][0] == "sample3test" and r[0][1] == ["sample1", "sample2", "sample3"] and r[1][1] == []


def test_score_v4_golden(spark):
    df = spark.range(1).select(F.lit(2.0).alias("a"), F.lit(100.0).alias("b"), F.lit(1.0).alias("c"), F.lit(100.0).alias("d"), F.lit(200 / 397).alias("q"))
    m, u = C.score_v4(*(F.col(x) for x in "abcdq")), C.score_v4(*(F.col(x) for x in "cdabq"))
    r = df.select(*m, *u, C.classify_v4(m[1], u[1])).first()
    assert [round(x, 6) for x in r[:4]] == [0.292771, 0.288501, -0.410528, 0.200899] and r[4] == "no_strong_association"
    few = C.score_v4(F.lit(1.0), F.lit(5.0), F.lit(1.0), F.lit(5.0), F.lit(1.0))
    assert tuple(spark.range(1).select(*few, C.classify_v4(few[1], few[1])).first()) == (None, None, "insufficient_data")


def test_fisher(spark):
    def exact(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        p = lambda x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k)
        return min(1.0, sum(p(x) for x in range(max(0, r + k - n), min(r, k) + 1) if p(x) <= p(a) * (1 + 1e-7)))

    tables = [(8, 2, 1, 5), (0, 0, 0, 0), (3, 0, 0, 3), (5, 5, 5, 5), (1, 9, 11, 3)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int")
    got = df.select("a", "b", "c", "d", C.fisher_two_sided(*(F.col(x) for x in "abcd")).alias("p")).collect()
    assert all(abs(r["p"] - exact(*r[:4])) < 1e-9 for r in got)


def test_effects(spark):
    ref = spark.createDataFrame([(1, 0, 0, "AACGTTACGA" * 3)], "contig int, chunk_id int, chunk_start bigint, seq string")
    v = spark.createDataFrame([(1, 3, "C", "T", "s1", "1|1", 1), (1, 3, "C", "T", "s2", "0|1", 1), (1, 3, "C", "T", "s3", "0/1", None), (1, 6, "T", "G", "s4", "1|0", 1)], "contig int, pos bigint, ref string, alt string, sample_id string, gt string, phase_set int")
    e = E.cpg_effects(E.window_changes(E.variant_windows(v, ref)))
    got = {tuple(r) for r in e.collect()}
    assert ("s1", "hap1", 1, 2, "ref_destroyed") in got and ("s1", "hap2", 1, 2, "ref_destroyed") in got
    assert ("s2", "hap2", 1, 2, "ref_destroyed") in got and not any(r[0] == "s3" for r in got)


def test_windows_over_chunk_edges_equal_uncut_ones(spark):
    """Deletions of up to 100 bases, on chunks of 16 and on one piece."""
    from tidemark.sources.files import reference_chunks

    rng = random.Random(8)
    seq = "".join(rng.choice("ACGCG") for _ in range(400))
    rows = [(1, p, seq[p - 1 : p - 1 + rng.choice([1, 2, 15, 100])], seq[p - 1], i) for i, p in enumerate(rng.randrange(1, 400) for _ in range(80))]
    v = spark.createDataFrame(rows + rows[:3], "contig int, pos bigint, ref string, alt string, i int")  # repeated rows stay
    ref = spark.createDataFrame([(1, seq)], "doc_id int, seq string")
    got = [sorted(map(str, E.window_changes(E.variant_windows(v, reference_chunks(ref, chunk=c), chunk=c)).select("i", "ref_window", "alt_window", "destroyed", "created").collect())) for c in (16, 65536)]
    assert got[0] == got[1] and len(got[0]) == 83


def test_pca_equals_svd(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((40, 4)) @ rng.random((4, 4))
    df = spark.createDataFrame([(f"r{i}", f"S{j}", float(x[i, j])) for i in range(40) for j in range(4)], "row string, s string, v double")
    scores, loadings = stats.pca(df, "row", "s", "v", [f"S{j}" for j in range(4)], 2)
    c = x - x.mean(axis=0)
    _, d, vt = np.linalg.svd(c, full_matrices=False)
    got = loadings.orderBy("component", "s").toPandas()
    assert np.allclose(np.abs(got.loading.to_numpy().reshape(2, 4)), np.abs(vt[:2]), atol=1e-6)
    assert np.allclose(got.explained.to_numpy().reshape(2, 4)[:, 0], (d**2 / (d**2).sum())[:2])
    s = scores.toPandas().set_index("row").loc[[f"r{i}" for i in range(40)]].to_numpy()
    assert np.allclose(np.abs(s), np.abs(x @ vt[:2].T), atol=1e-6)


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert [r["n"] for r in stats.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    assert stats.histogram(df.limit(0), "x", 5).count() == 5
