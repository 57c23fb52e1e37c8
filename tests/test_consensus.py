"""The consensus merge in blocks against a plain loop."""

import random

import pytest

from tidemark.operators import consensus as K


def plain(regions, gap, least):
    done = []
    for key in sorted({r[:2] for r in regions}):
        rows = sorted(r[2:] for r in regions if r[:2] == key and r[4] is not None)
        emitted, i = [], 0
        near = lambda s, e, p: any(p in d[2] and s <= d[1] + gap and e >= d[0] - gap for d in emitted)
        while i < len(rows):
            s, e, p = rows[i]
            i += 1
            if near(s, e, p):
                continue
            now = [s, e, {p}]
            while i < len(rows) and rows[i][0] <= now[1] + gap:
                s, e, p = rows[i]
                i += 1
                if p not in now[2] and not near(s, e, p):
                    now[1] = max(now[1], e)
                    now[2].add(p)
            if len(now[2]) >= least:
                emitted.append(now)
        done += [(*key, a, b, tuple(sorted(p))) for a, b, p in emitted]
    return sorted(done)


@pytest.mark.parametrize("gap, least, long", [(30, 1, 30), (200, 3, 300)])
def test_blocks_hand_over_their_state(spark, gap, least, long):
    rng = random.Random(gap)
    rows = [("c1", "H1", s := rng.randrange(4000), s + rng.randrange(1, long), f"S{rng.randrange(5)}") for _ in range(300)]
    rows += [("c2", rng.choice(["H1", "H2"]), s := rng.randrange(9000), s + rng.randrange(1, 60), f"S{rng.randrange(9)}") for _ in range(80)] + [("c1", "H1", 900, 3500, None), ("c3", "H1", 100, 2000, "S1"), ("c3", "H1", 1500, 1600, "S2"), *[("c3", "H1", 1900, 1950, "S1")] * 3]
    df = spark.createDataFrame(rows, "chrom string, hap string, start_pos bigint, end_pos bigint, sample_id string")
    want = plain(rows, gap, least)
    for block in (1200, 1 << 20):
        got = K.consensus_merge(df, gap, least, block=block).collect()
        assert sorted((r["chrom"], r["hap"], r["start_pos"], r["end_pos"], tuple(r["samples"])) for r in got) == want
        assert all(r["n_regions"] == len(r["samples"]) for r in got)


def test_merge_of_nothing(spark):
    df = spark.createDataFrame([], "chrom string, hap string, start_pos bigint, end_pos bigint, sample_id string")
    assert K.consensus_merge(df).count() == 0


def test_states_that_do_not_settle(spark, monkeypatch):
    """A gap longer than a block makes each block depend on all before it; rounds stay few all the same."""
    rng = random.Random(11)
    rows = [("c1", "H1", s := rng.randrange(60000), s + rng.randrange(1, 40), f"S{rng.randrange(7)}") for _ in range(900)]
    rows += [("c2", h, s := rng.randrange(3000), s + rng.randrange(1, 40), f"S{rng.randrange(5)}") for h in ("H1", "H2") for _ in range(80)]
    df = spark.createDataFrame(rows, "chrom string, hap string, start_pos bigint, end_pos bigint, sample_id string")
    runs, own = [], K._merge_blocks
    monkeypatch.setattr(K, "_merge_blocks", lambda *a: runs.append(1) or own(*a))
    for gap, least in ((1500, 1), (600, 3)):
        runs.clear()
        got = K.consensus_merge(df, gap, least, block=1000).collect()
        assert sorted((r["chrom"], r["hap"], r["start_pos"], r["end_pos"], tuple(r["samples"])) for r in got) == plain(rows, gap, least)
        assert len(runs) <= 8
