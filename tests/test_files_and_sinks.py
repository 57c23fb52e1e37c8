"""Readers of variant and region files, and writers that keep an order."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import effects as E
from tidemark.operators import sinks, stats
from tidemark.sources import files


def vcf(names, sites, extra=()):
    head = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    rows = ["\t".join([c, str(p), ".", "A", "C", "30", "PASS", "DP=3", "GT:DP", *[f"{g}:7" for g in gts]]) for c, p, gts in sites]
    return "\n".join([*head, *rows, *extra]) + "\n"


def test_vcf_headers_by_file_and_no_shuffle(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(vcf(["x", "y-1"], [("chr1", i, ["0|1", "1|1"]) for i in range(500)], ["chr1\t9\tshort", "chr1\tbad\t.\tA\tC\t.\tPASS\t.\tGT\t0|1"]))
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(vcf(["z"], [("chr2", 7, ["1|0"])]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        sites = files.read_vcf_sites(spark, str(tmp_path), "small")
        assert sites.rdd.getNumPartitions() > 5  # one file, many tasks
        plan = sites._jdf.queryExecution().executedPlan().toString()
        records = plan.split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in records and "Exchange hashpartitioning" not in records
        got = sorted((r["chrom"], r["pos"], tuple(r["names"]), tuple(r["gts"])) for r in sites.collect() if r["pos"] is not None)
        assert got == [("chr1", i, ("x", "y-1"), ("0|1", "1|1")) for i in range(500)] + [("chr2", 7, ("z",), ("1|0",))]
        assert [tuple(r["gts"]) for r in sites.collect() if r["pos"] is None] == [("0|1", None)]
        salted = files.read_vcf(spark, str(tmp_path), "small", most_bytes=0, salts=4)
        assert sorted(map(str, salted.collect())) == sorted(map(str, files.read_vcf(spark, str(tmp_path), "small").collect())) and salted.count() == 1003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_candidate_header_is_checked(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text("foo\tbar\tbaz\tqux\nchr1\t1\t2\t3\n")
    with pytest.raises(ValueError, match="columns missing"):
        files.read_candidates(spark, str(tmp_path / "bad.tsv"))
    order = list(files.CANDIDATES)[::-1]
    (tmp_path / "good.tsv").write_text("\t".join(order) + "\n" + "\t".join(["a,b", ".", "2", "0", "9", "10", "1", "chr1"]) + "\n")
    r = files.read_candidates(spark, str(tmp_path / "good.tsv")).first()
    assert (r["chrom"], r["start_pos"], r["end_pos"], r["unmethylated_samples"], r["methylated_samples"]) == ("chr1", 1, 10, [], ["a", "b"])


def test_consensus_rows_of_few_fields_are_rejected(spark, tmp_path):
    lines = ["chrom\tstart\tend\tnum_samples\tsamples\tsummary_labels\tsize\tcontributing_samples", "chr1\t1\t9\t2\ta,b\tU\t8\ta", "chr1\t1\t9\t2\t.\tU\t8", "chr1\t1\t9\t2\ta\tU", "chr1\tx\t9\t2\ta\tU\t8\ta", ""]
    (tmp_path / "c.tsv").write_text("\n".join(lines))
    got = files.read_consensus(spark, str(tmp_path / "c.tsv")).collect()
    assert [(r["samples"], r["contributing_samples"]) for r in got] == [(["a", "b"], ["a"]), ([], [])]
    assert files.read_consensus(spark, str(tmp_path / "c.tsv"), on_bad="flag").filter("not ok").count() == 2


def test_sorted_files_are_in_order_and_written_twice_the_same(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(3000).select(F.concat(F.lit("chr"), (F.col("id") % 24 + 1).cast("string")).alias("chrom"), (F.col("id") * 7919 % 4001).alias("start_pos"), (F.col("id") * 7919 % 4001 + 5).alias("end_pos"), F.concat(F.lit("H"), (F.col("id") % 2 + 1).cast("string")).alias("hap"), "id")

    def contents():
        return {os.path.relpath(os.path.join(d, n), path): open(os.path.join(d, n)).read() for d, _, names in os.walk(path) for n in names if n.startswith("part-")}

    seen = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for _ in range(2):
        sinks.write_sorted(df, path, sinks.genomic_order("id"), header=False, partition=["hap"])
        seen.append(contents())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    joined = [["".join(c[n] for n in sorted(c) if n.startswith(f"hap={h}/")) for h in ("H1", "H2")] for c in seen]
    assert joined[0] == joined[1] and len(seen[0]) > 2
    rank = lambda c: {"X": 23, "Y": 24}.get(c[3:]) or (int(c[3:]) if int(c[3:]) <= 22 else 999)
    for hap in ("H1", "H2"):
        rows = [line.split("\t") for name in sorted(seen[0]) if name.startswith(f"hap={hap}/") for line in seen[0][name].splitlines()]
        keys = [(rank(r[0]), r[0], int(r[1]), int(r[2]), int(r[3])) for r in rows]
        assert len(keys) == 1500 and keys == sorted(keys)
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_effects_of_multiallelic_genotypes(spark):
    ref = spark.createDataFrame([(1, 0, 0, "AACGTTACGA" * 3)], "contig int, chunk_id int, chunk_start bigint, seq string")
    gts = ["1|2", "2|1", "0|2", "2|0", "1|1", "2|2", "1|0", "0|1", "0|0", ".|1", "1/2"]
    v = spark.createDataFrame([(1, 3, "C", "T", g, g, 1) for g in gts], "contig int, pos bigint, ref string, alt string, sample_id string, gt string, phase_set int")
    got = {}
    for r in E.cpg_effects(E.window_changes(E.variant_windows(v, ref))).filter("effect = 'ref_destroyed'").collect():
        got.setdefault(r["sample_id"], set()).add(r["hap"])
    assert got == {"1|2": {"hap1"}, "2|1": {"hap2"}, "0|2": {"hap2"}, "2|0": {"hap2"}, "1|1": {"hap1", "hap2"}, "2|2": {"hap2"}, "1|0": {"hap1"}, "0|1": {"hap2"}}


def test_grouped_histograms_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in "ab" for v in rng.normal(size=200)] + [("c", 4.0)] * 3 + [("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["bin"]): r["n"] for r in stats.histogram_by(df, F.col("x"), 10, ["g"]).collect()}
    for g in "abc":
        assert [got[g, i] for i in range(10)] == np.histogram([x for k, x in rows if k == g], 10)[0].tolist()
    assert not any(k[0] == "d" for k in got)
