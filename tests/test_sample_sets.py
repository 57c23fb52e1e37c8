"""Sets of samples over regions against nested loops."""

import random

import pytest

from tidemark.operators import intervals as I


@pytest.mark.parametrize("contain", [False, True])
def test_sample_sets_equal_nested_loops(spark, contain):
    rng = random.Random(12)
    names = [f"S{i:03d}" for i in range(150)]
    iv = lambda: (s := rng.randrange(3000), s + rng.choice([1, rng.randrange(1, 40), rng.randrange(1, 300), 2500]))
    regions = [(f"c{rng.randrange(2)}", *iv()) for _ in range(120)]
    regions += regions[:5]
    segments = [(f"c{rng.randrange(2)}", *iv(), rng.choice(names)) for _ in range(900)] + [("c0", 0, 5000, "unknown"), ("c1", 0, 5000, None)]
    got = I.sample_sets(spark.createDataFrame(regions, "chrom string, start_pos bigint, end_pos bigint"), spark.createDataFrame(segments, "chrom string, start_pos bigint, end_pos bigint, sample_id string"), names, width=32, contain=contain).collect()
    test = (lambda r, s: s[1] <= r[1] and s[2] >= r[2]) if contain else (lambda r, s: s[1] < r[2] and r[1] < s[2])
    want = {r: sorted({s[3] for s in segments if s[0] == r[0] and s[3] in names and test(r, s)}) for r in set(regions)}
    assert {(r["chrom"], r["start_pos"], r["end_pos"]): r["samples"] for r in got} == {k: v for k, v in want.items() if v} and len(got) == len({k for k, v in want.items() if v})
    assert any(len(v) > 62 for v in want.values()) or contain


def test_sample_sets_move_a_row_per_region_and_task(spark):
    """A thousand segments over each region leave their tasks as bits of one row."""
    kind = "chrom string, start_pos bigint, end_pos bigint"
    regions = spark.createDataFrame([("c", i * 100, i * 100 + 50) for i in range(20)], kind)
    segments = spark.createDataFrame([("c", j, 2000 + j, f"S{j % 3}") for j in range(1000)], kind + ", sample_id string")
    got = I.sample_sets(regions, segments, ["S0", "S1", "S2"], width=4096)
    assert all(r["samples"] == ["S0", "S1", "S2"] for r in got.collect()[1:])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "collect" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
