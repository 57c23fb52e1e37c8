"""Exact quantiles, covariance and the CpG index against numpy and plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import effects as E
from tidemark.operators import stats
from tidemark.sources.files import reference_chunks


def test_quantiles_equal_numpy(spark):
    rng = random.Random(5)
    rows = [("a", float(rng.choice([7, rng.randrange(10**9)]))) for _ in range(3000)] + [("b", 2.5)] * 400 + [("c", x / 7) for x in range(5)] + [("a", None)] * 9 + [("d", None), ("e", -1.0), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r["g"]: r for r in stats.quantiles(df, "x", ["g"], probs, bins=16).collect() if r["g"] is not None}
    for g in "abce":
        x = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n"] == len(x) and np.allclose([got[g][f"q{i}"] for i in range(5)], np.quantile(x, probs), rtol=1e-12)
    assert "d" not in got
    whole = stats.quantiles(df, "x", [], probs).collect()
    assert len(whole) == 1 and np.allclose([whole[0][f"q{i}"] for i in range(5)], np.quantile([v for _, v in rows if v is not None], probs))
    assert stats.quantiles(df.limit(0), "x", ["g"], probs).count() == 0


def test_covariance_and_components_with_missing_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.random((60, 3)) @ rng.random((3, 5))
    gone = rng.random(x.shape) < 0.3
    cells = [(f"r{i}", f"S{j}", float(x[i, j])) for i in range(60) for j in range(5) if not gone[i, j]]
    df = spark.createDataFrame([*cells, ("r1", "S0", None)], "row string, s string, v double")
    seen = [i for i in range(60) if not gone[i].all()]
    filled = np.where(gone, np.nan, x)[seen]
    filled = np.where(np.isnan(filled), np.nanmean(filled, axis=0), filled)
    want = np.cov(filled.T)
    got = {(r["a"], r["b"]): r["cov"] for r in stats.covariance(df, "row", "s", "v").collect()}
    assert all(abs(got[f"S{i}", f"S{j}"] - want[i, j]) < 1e-12 for i in range(5) for j in range(5))
    scores, loadings = stats.pca(df, "row", "s", "v", [f"S{j}" for j in range(5)], 2)
    values, vectors = np.linalg.eigh(want)
    w = np.array([r["loading"] for r in loadings.orderBy("component", "s").collect()]).reshape(2, 5)
    for k in range(2):
        assert np.allclose(np.abs(w[k]), np.abs(vectors[:, -1 - k]), atol=1e-9) and w[k][np.argmax(np.abs(w[k]))] > 0
    s = scores.toPandas().set_index("row").loc[[f"r{i}" for i in seen]].to_numpy()
    assert np.allclose(s, filled @ w.T, atol=1e-9)


def test_cpg_index_and_phantoms(spark):
    rng = random.Random(6)
    seqs = {1: "".join(rng.choice("ACGCG") for _ in range(5000)), 2: "CG", 3: "C", 4: "", 5: "GC" * 700, 6: "CG" * 3000}
    df = spark.createDataFrame(list(seqs.items()), "doc_id int, seq string")
    want = {(k, i) for k, s in seqs.items() for i in range(len(s) - 1) if s[i : i + 2] == "CG"}
    for chunk, piece in ((64, 16), (1000, 4096), (65536, 512)):
        got = [tuple(r) for r in E.cpg_index(reference_chunks(df, chunk=chunk), chunk, piece).collect()]
        assert len(got) == len(want) and {(c, p) for c, _, p in got} == want and all(b == p // piece for _, b, p in got)
    sites = [("s", "hap1", k, p, "phantom_sites") for k in (1, 6) for p in range(0, 5999, 7)] + [("s", "hap1", 1, 0, "ref_destroyed")]
    effects = spark.createDataFrame(sites, "sample_id string, hap string, contig int, pos bigint, effect string")
    out = E.without_reference_phantoms(effects, reference_chunks(df, chunk=1000), 1000)
    assert {tuple(r) for r in out.collect()} == {x for x in sites if x[4] != "phantom_sites" or (x[2], x[3]) not in want}
    for line in out._jdf.queryExecution().executedPlan().toString().splitlines():
        assert "Exchange" not in line or "seq" not in line


def test_segment_runs_across_blocks(spark):
    """Runs that go through several blocks, and windows over a chromosome that hold no row per site."""
    import random

    from tidemark.operators import stats

    rng = random.Random(3)
    sites = sorted({(f"S{rng.randrange(2)}", "hap1", "chr1", rng.randrange(6000)) for _ in range(900)})
    rows = [(*s, s[3] + 1, 0.9 if (s[3] // 700) % 2 or rng.random() < 0.1 else 0.1) for s in sites]
    df = spark.createDataFrame(rows, "sample_id string, hap string, chrom string, start_pos bigint, end_pos bigint, mod_probability double")
    want = []
    for name in ("S0", "S1"):
        last = None
        for _, _, _, start, end, p in (r for r in rows if r[0] == name):
            c = "M" if p >= 0.5 else "U"
            if last is None or start - last > 25 or want[-1][3] != c:
                want.append([name, start, end, c, 0])
            want[-1][2], want[-1][4], last = end, want[-1][4] + 1, start
    want = sorted((n, s, e, k, c if k >= 2 else "NoData") for n, s, e, c, k in want)
    for block in (100, 1000, 1 << 20):
        got = stats.segment_runs(df, 25, 2, 0.5, block=block).collect()
        assert sorted((r["sample_id"], r["start_pos"], r["end_pos"], r["n_cpgs"], r["label"]) for r in got) == want
