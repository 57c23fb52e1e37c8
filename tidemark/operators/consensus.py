"""Consensus regions: islands, the order-dependent merge, candidate filter and its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .intervals import sample_sets


def with_island(regions: DataFrame, max_gap: int, by: tuple[str, ...] = ("chrom", "hap"), order: tuple[str, ...] = ("start_pos", "end_pos", "sample_id"), block: int = 1 << 20, first: bool = False) -> DataFrame:
    """Add ``island``: a new one begins where the start exceeds the running maximum end by more than the gap; and ``_first``, its start, if asked for.

    A window over a whole chromosome would be one task for all samples' regions. Windows run over blocks of starts
    instead; what crosses blocks, the maximum end and the number of islands so far, comes from one row per block, a
    table bounded by the genome's length.
    """
    keys = [*by, "_block"]
    blocked = regions.withColumn("_block", F.expr(f"start_pos div {block}"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocked.groupBy(*keys).agg(F.max("end_pos").alias("_top")).select(*keys, F.max("_top").over(before).alias("_carry"))
    w = Window.partitionBy(*keys).orderBy(*order)
    top = F.greatest(F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    new = F.when(top.isNull() | (F.col("start_pos") > top + max_gap), 1).otherwise(0)
    marked = blocked.join(tops, keys).withColumn("_new", new).drop("_carry")
    start, so_far = F.when(F.col("_new") == 1, F.col("start_pos")), w.rowsBetween(Window.unboundedPreceding, 0)
    counts = marked.groupBy(*keys).agg(F.sum("_new").alias("_n"), F.max(start).alias("_s")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.max("_s").over(before).alias("_last"))
    out = marked.join(counts, keys).withColumn("island", F.col("_offset") + F.sum("_new").over(so_far))
    if first:
        out = out.withColumn("_first", F.coalesce(F.max(start).over(so_far), F.col("_last")))
    return out.drop("_new", "_offset", "_last", "_block")


def islands(regions: DataFrame, max_gap: int, min_samples: int = 1, by: tuple[str, ...] = ("chrom", "hap")) -> DataFrame:
    """Chained regions with their samples."""
    out = with_island(regions, max_gap, by).groupBy(*by, "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.array_sort(F.collect_set("sample_id")).alias("samples"), F.count(F.lit(1)).alias("n_regions"))
    return out.filter(F.size("samples") >= min_samples).drop("island")


STATE = "now struct<s:bigint,e:bigint,p:array<string>>, old array<struct<s:bigint,e:bigint,p:array<string>>>"


def _merge_blocks(rows: DataFrame, keys: list[str], gap: int, least: int) -> DataFrame:
    """Runs the greedy rule over each block of an island: a row per emitted cluster, and one per block with its end state.

    ``rows``: keys, _block (where the block ends), _o, start_pos, end_pos, sample_id, state. A row with _o 0 hands a state over to its block; other
    blocks begin with none. A state is the open cluster and the emitted ones that a later block can still reach, as
    text that is equal for equal states, or null.
    """
    n = len(keys)
    kinds = [rows.schema[c].dataType.simpleString() for c in keys]
    names = [*keys, "_block", "start_pos", "end_pos", "samples", "state"]

    def run(batches):
        import json

        import pyarrow as pa

        key, emitted, now, out = None, [], None, []  # emitted and now: [start, end, samples]

        def near(start, end, sample):
            return any(sample in d[2] and start <= d[1] + gap and end >= d[0] - gap for d in emitted)

        def close():
            nonlocal now
            if now is not None and len(now[2]) >= least:
                emitted.append(now)
                out.append((*key, now[0], now[1], sorted(now[2]), None))
            now = None

        def finish():
            """The end of a block: what no later start can reach is closed or forgotten."""
            edge = key[-1]
            if now is not None and now[1] + gap < edge:
                close()
            as_json = lambda d: {"s": d[0], "e": d[1], "p": sorted(d[2])}
            old = sorted((as_json(d) for d in emitted if d[1] + gap >= edge), key=lambda d: (d["s"], d["e"], d["p"]))
            state = json.dumps({"now": as_json(now) if now else None, "old": old}) if now or old else None
            out.append((*key, None, None, None, state))

        def give(types):
            columns = list(zip(*out)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()])], names)

        types = None
        for b in batches:
            types = [b.column(i).type for i in range(n)]
            for *own, order, start, end, sample, state in zip(*(b.column(i).to_pylist() for i in range(n + 6))):
                if own != key:
                    if key is not None:
                        finish()
                    key, emitted, now = own, [], None
                if not order:
                    if state:
                        got = json.loads(state)
                        emitted = [[d["s"], d["e"], set(d["p"])] for d in got["old"]]
                        now = got["now"] and [got["now"]["s"], got["now"]["e"], set(got["now"]["p"])]
                    continue
                emitted[:] = [d for d in emitted if d[1] + gap >= start]
                if now is not None and start <= now[1] + gap:
                    if sample not in now[2] and not near(start, end, sample):
                        now[1] = max(now[1], end)
                        now[2].add(sample)
                    continue
                close()
                if not near(start, end, sample):
                    now = [start, end, {sample}]
            yield give(types)
        if types:
            if key is not None:
                finish()
            yield give(types)

    schema = ", ".join([*(f"`{c}` {k}" for c, k in zip(keys, kinds)), "_block bigint", "start_pos bigint", "end_pos bigint", "samples array<string>", "state string"])
    order = [*keys, "_block", "_o", "start_pos", "end_pos", "sample_id"]
    return rows.select(*order, "state").repartition(*keys, "_block").sortWithinPartitions(*order).mapInArrow(run, schema)


def consensus_merge(regions: DataFrame, max_gap: int = 5000, min_samples: int = 2, by: tuple[str, ...] = ("chrom", "hap"), block: int = 1 << 20) -> DataFrame:
    """The greedy, sample-aware merge.

    A region that lies near an emitted consensus to which its sample contributed is skipped; a region opens a cluster,
    later ones join it unless their sample is in it already or they are near; a cluster is emitted when the chain breaks
    and it has enough samples. The rule depends on the order, but cannot act across islands and forgets what lies out of
    reach. So an island of more than ``block`` bases is cut in blocks that all run at once, each as if nothing came before.
    Where the block before has handed over another state than that, the block runs again, until no state changes. Where
    states don't settle, so that a round leaves more than half of the changed blocks, what is left of an island depends on
    all that goes before: then its rows from the first changed block on run once in order, streamed through one task that
    keeps only the clusters in reach. Rounds are at most some ten, and there is one where islands are short.
    """
    spark, keys = regions.sparkSession, [*by, "island"]
    folder = scratch(spark)
    rows = with_island(regions.filter("sample_id is not null"), max_gap, by, first=True).withColumn("_block", F.expr(f"_first + ((start_pos - _first) div {block} + 1) * {block}"))
    rows = rows.select(*keys, "_block", F.lit(1).alias("_o"), "start_pos", "end_pos", "sample_id", F.lit(None).cast("string").alias("state"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    at, order, turn = [*keys, "_block"], Window.partitionBy(*keys).orderBy("_block"), 1
    out = kept(_merge_blocks(rows, keys, max_gap, min_samples).withColumn("round", F.lit(1)), "round-1")
    if out.filter("state is not null").isEmpty():  # no island goes on in another block
        return out.filter("start_pos is not null").select(*by, "start_pos", "end_pos", "samples", F.size("samples").alias("n_regions"))
    rows = kept(rows, "rows")
    before = None
    ends = out.filter("start_pos is null").select(*at, F.lit(None).cast("string").alias("start"), F.col("state").alias("end"), "round")
    while True:
        wanted = ends.withColumn("want", F.lag("end").over(order))
        changed = wanted.filter(~F.col("want").eqNullSafe(F.col("start"))).select(*at, "want")
        n = changed.count()
        if not n:
            break
        turn += 1
        if before is not None and 2 * n > before:  # the states don't settle
            tail = wanted.join(changed.groupBy(*keys).agg(F.min("_block").alias("_from")), keys).filter("_block >= _from")
            tails = kept(tail.groupBy(*keys).agg(F.max("_block").alias("_to"), F.min(F.struct("_block", "want")).alias("_f")).select(*keys, F.col("_f._block").alias("_from"), "_to", F.col("_f.want").alias("want")), "tails")
            heads = tails.select(*keys, F.col("_to").alias("_block"), F.lit(0).alias("_o"), F.lit(-1).cast("bigint").alias("start_pos"), F.lit(-1).cast("bigint").alias("end_pos"), F.lit("").alias("sample_id"), F.col("want").alias("state"))
            again = rows.join(F.broadcast(tails), keys).filter("_block >= _from").withColumn("_block", F.col("_to")).select(*heads.columns).unionByName(heads)
            new = kept(_merge_blocks(again, keys, max_gap, min_samples).withColumn("round", F.lit(turn)), f"round-{turn}")
            out = out.unionByName(new)
            settled = ends.join(tails.select(*keys, "_from"), keys, "left").filter("_from is null or _block < _from").select(*at, "start", "end", "round")
            ends = settled.unionByName(new.filter("start_pos is null").select(*at, F.lit(None).cast("string").alias("start"), F.col("state").alias("end"), "round"))
            break
        before = n
        heads = changed.select(*at, F.lit(0).alias("_o"), F.lit(-1).cast("bigint").alias("start_pos"), F.lit(-1).cast("bigint").alias("end_pos"), F.lit("").alias("sample_id"), F.col("want").alias("state"))
        again = rows.join(changed.select(*at), at, "left_semi").select(*heads.columns).unionByName(heads)
        new = kept(_merge_blocks(again, keys, max_gap, min_samples).withColumn("round", F.lit(turn)), f"round-{turn}")
        out = out.unionByName(new)
        now = new.filter("start_pos is null").select(*at, F.col("state").alias("_end"), F.col("round").alias("_round"))
        ran = F.col("_round").isNotNull()
        ends = wanted.join(now, at, "left").select(*at, F.when(ran, F.col("want")).otherwise(F.col("start")).alias("start"), F.when(ran, F.col("_end")).otherwise(F.col("end")).alias("end"), F.coalesce("_round", "round").alias("round"))
        if turn % 4 == 0:  # a short plan
            ends = kept(ends, f"ends-{turn}")
    clusters = out.filter("start_pos is not null")
    if turn > 1:
        clusters = clusters.join(ends.select(*at, "round"), [*at, "round"], "left_semi")
    # the last block's open cluster has no block after it that would close it
    left = ends.withColumn("_next", F.lead("_block").over(order)).filter("_next is null and end is not null").select(*by, F.from_json("end", STATE)["now"].alias("c"))
    left = left.filter(F.size("c.p") >= min_samples).select(*by, F.col("c.s").alias("start_pos"), F.col("c.e").alias("end_pos"), F.col("c.p").alias("samples"))
    return clusters.select(*left.columns).unionByName(left).withColumn("n_regions", F.size("samples"))


def sample_evidence(consensus: DataFrame, segments: DataFrame, by: tuple[str, ...] = ("chrom", "hap"), names: list[str] | None = None) -> DataFrame:
    """Per consensus region the samples seen unmethylated (an overlapping U segment) and methylated (a containing M segment).

    ``names`` are the cohort's samples, a short list; if absent they are looked up.
    """
    keys = [*by, "start_pos", "end_pos"]
    seg = segments.select(*by, "start_pos", "end_pos", "sample_id", "label")
    names = sorted(r["sample_id"] for r in seg.select("sample_id").distinct().collect() if r["sample_id"] is not None) if names is None else sorted(names)
    u = sample_sets(consensus, seg.filter("label = 'U'"), names, by).withColumnRenamed("samples", "unmethylated_samples")
    m = sample_sets(consensus, seg.filter("label = 'M'"), names, by, contain=True).withColumnRenamed("samples", "methylated_samples")
    none = F.array().cast("array<string>")
    out = consensus.join(u, keys, "left").join(m, keys, "left")
    return out.withColumn("unmethylated_samples", F.coalesce("unmethylated_samples", none)).withColumn("methylated_samples", F.coalesce("methylated_samples", none))


def reasons(evidence: DataFrame, min_samples: int = 1) -> DataFrame:
    """Add why a region is dropped, or 'final'."""
    u, m = F.col("unmethylated_samples"), F.col("methylated_samples")
    why = F.when(F.size(F.array_except("samples", u)) > 0, "inconsistent").when(F.size(u) == 0, "no_unmethylated").when(F.size(m) < min_samples, "insufficient_methylated").otherwise("final")
    return evidence.withColumn("reason", why)


def candidates(consensus: DataFrame, segments: DataFrame, min_samples: int = 1, by: tuple[str, ...] = ("chrom", "hap")) -> DataFrame:
    return reasons(sample_evidence(consensus, segments, by), min_samples).filter("reason = 'final'").drop("reason")
