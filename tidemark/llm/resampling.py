"""Importance resampling towards a target text: hashed n-gram weights, Gumbel keys and a distributed selection of the best.

Words and n-grams are hashed for whole Arrow columns, one byte position of all words at a time. The gains of all buckets
are one array, so a document's weight is a look-up for each feature. The draw is a quickselect over the table of keys:
random pivot keys split what is left, exact counts below and at each tell where the k-th key lies, and only the winners
are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, texts
from .shingles import slices

#: Words are runs of digits, letters (A-Z folded) and bytes of other than ASCII characters.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SOLID = np.zeros(256, dtype=bool)
SOLID[48:58] = SOLID[97:123] = SOLID[128:] = True
SPACE = np.uint32(32)
LONG = 48  # words of more bytes are hashed one by one
BLOCK = 1 << 20


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of a word each, by byte position of all words at once."""
    capped = np.minimum(lengths, LONG + 1).astype(np.int16)
    order = np.argsort(-capped, kind="stable")
    s, n, c = starts[order], capped[order], state[order]
    long = int(np.count_nonzero(n > LONG))
    for k in range(int(n[long]) if long < len(n) else 0):
        m = int(np.searchsorted(-n, -k - 1, side="right"))  # words that have this byte
        c[long:m] = CRC[(c[long:m] ^ data[s[long:m] + k]) & 255] ^ (c[long:m] >> 8)
    for i in range(long):
        w = order[i]
        c[i] = zlib.crc32(data[starts[w] : starts[w] + lengths[w]].tobytes(), int(c[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(c)
    out[order] = c
    return out


def _pieces(column: pa.Array, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(folded bytes, offsets of rows in them, first row, words carried over from the piece before).

    Rows come together in blocks; a row of more than a block comes in several pieces that end between words, each led by
    the last words of the one before, so that no n-gram is lost.
    """
    for first, part in slices(column, BLOCK):
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = part.buffers()[2]
        if raw is None or offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(raw, dtype=np.uint8)
        if offsets[-1] - offsets[0] <= 2 * BLOCK or len(part) > 1:
            yield FOLD[data[offsets[0] : offsets[-1]]], offsets - offsets[0], first, 0
            continue
        at, end, led = int(offsets[0]), int(offsets[-1]), b""
        while at < end:
            stop = min(end, at + BLOCK)
            while stop < end:
                gap = np.flatnonzero(~SOLID[FOLD[data[stop : min(end, stop + BLOCK)]]])
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(end, stop + BLOCK)
            piece = np.concatenate([np.frombuffer(led, dtype=np.uint8), FOLD[data[at:stop]]])
            carried = len(led.split())
            yield piece, np.array([0, len(piece)]), first, carried
            starts, ends = _words(piece, np.array([0, len(piece)]))
            keep = max(0, len(starts) - grams + 1) if grams > 1 else len(starts)
            led = b"".join(piece[a:b].tobytes() + b" " for a, b in zip(starts[keep:], ends[keep:]))
            at = stop


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one bytes of the words; none spans two rows."""
    solid = SOLID[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[True], ~solid[:-1]]) if len(data) else solid
    after = np.concatenate([~solid[1:], [True]]) if len(data) else solid
    return np.flatnonzero(solid & (before | edge[:-1])), np.flatnonzero(solid & (after | edge[1:])) + 1


def features(column: pa.Array, buckets: int, grams: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For pieces of the column and each n up to ``grams``: the row and the bucket of every n-gram of words."""
    for data, offsets, first, carried in _pieces(column, grams):
        starts, ends = _words(data, offsets)
        row = first + np.searchsorted(offsets, starts, side="right") - 1
        lengths, state, out = ends - starts, np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), []
        for n in range(grams):
            if n:
                same = row[: len(row) - n] == row[n:] if len(row) > n else np.zeros(0, dtype=bool)
                # runs of n words that get one more of their row
                state = state[: len(same)]
                state = np.where(same, CRC[(state ^ SPACE) & 255] ^ (state >> 8), state)
                live = np.flatnonzero(same)
                state[live] = _advance(state[live], data, starts[live + n], lengths[live + n])
            else:
                state, live = _advance(state, data, starts, lengths), np.arange(len(starts))
            live = live[live + n >= carried]
            out.append((row[live], (state[live] ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets))
        yield out


def bucket_counts(texts_: DataFrame, buckets: int, grams: int) -> DataFrame:
    """(bucket, n) of all texts; each task adds up an array first."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for piece in features(b.column(0), buckets, grams):
                for _, found in piece:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return map_arrow(texts_.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000, grams: int = 2) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's shares in the target and in the source), for every bucket.

    The driver gets at most ``buckets`` counts of each side.
    """
    sides = [bucket_counts(x, buckets, grams).withColumn("side", F.lit(i)) for i, x in enumerate((source, target))]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in sides[0].unionByName(sides[1]).collect():
        (t if r["side"] else s)[r["bucket"]] = r["n"]
    whole_s, whole_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (whole_s + buckets) / ((a + 1) * (whole_t + buckets)))) for a, b in zip(s.tolist(), t.tolist())], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, grams: int = 2) -> DataFrame:
    """(doc_id, n_features, n_words, weight): the floored mean gain of each document's features, 0 without features."""
    buckets = len(gain)

    def run(batches):
        for b in batches:
            rows = b.num_rows
            n, words, total = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
            for piece in features(b.column(1), buckets, grams):
                words += np.bincount(piece[0][0], minlength=rows)
                for row, found in piece:
                    n += np.bincount(row, minlength=rows)
                    np.add.at(total, row, gain[found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(words), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_features", "n_words", "weight"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features bigint, n_words bigint, weight bigint")


def gumbel_score(weight: Column, id_: Column, salt: str) -> Column:
    """weight + floor(1000 Gumbel noise), the noise from the first 32 bits of sha256(salt:id); a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth(rows: DataFrame, key: list[str], k: int, pivots: int = 15, seed: int = 11) -> list:
    """The values of the k-th smallest key (from 1) of ``rows``, whose keys differ, by quickselect.

    Every round takes random keys of what is left as pivots, the rows with the smallest hash of round and key, and counts the
    rows below and at each. Null values sort first.
    """
    kinds = {c: rows.schema[c].dataType for c in key}
    own = F.struct(*key)
    as_key = lambda v: F.struct(*[F.lit(x).cast(kinds[c]).alias(c) for c, x in zip(key, v)])
    low, high, below = None, None, 0
    for i in range(1000):
        left = rows.select(*key)
        if low is not None:
            left = left.filter(own > as_key(low))
        if high is not None:
            left = left.filter(own < as_key(high))
        picked = left.orderBy(F.xxhash64(F.lit(seed + i), *key), *key).limit(pivots).select(own.alias("k")).collect()
        if not picked:
            break
        # in the order of keys, nulls first
        picked = sorted((list(r["k"]) for r in picked), key=lambda v: [(x is not None, x) for x in v])
        three = left.agg(*[F.count_if(own < as_key(v)).alias(f"b{j}") for j, v in enumerate(picked)], *[F.count_if(own == as_key(v)).alias(f"e{j}") for j, v in enumerate(picked)]).first()
        start = below
        for j, v in enumerate(picked):
            if start + three[f"b{j}"] >= k:
                high = v
                break
            if start + three[f"b{j}"] + three[f"e{j}"] >= k:
                return v
            low, below = v, start + three[f"b{j}"] + three[f"e{j}"]
    raise ValueError("k is more than the number of rows, or keys repeat")


def ranked(rows: DataFrame, key: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in the order of the key: ranges of keys sorted apart, and the sizes of the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = cut(rows.repartitionByRange(parts, *key).sortWithinPartitions(*key))
    at = F.spark_partition_id().alias("_part")
    sizes = {r["_part"]: r["n"] for r in done.groupBy(at).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    offsets, so_far = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append((p, so_far))
        so_far += sizes.get(p, 0)
    table = rows.sparkSession.createDataFrame(offsets, "_part int, _offset bigint")
    place = F.col("_offset") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return done.withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}).join(F.broadcast(table), "_part").withColumn(name, place).drop("_part", "_i", "_offset")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, grams: int = 2, salt: str = "7", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document, with its place among the drawn ones or null.

    Of the N documents of at least ``min_words`` words floor(percent N / 100) are drawn, those of the highest scores, ties
    to the smaller doc_id, null ids last and then in the order of the rows. Null texts count as empty and have weight 0,
    as have texts without words; a null id counts as empty in the noise. Repeated rows are rows of their own, extra columns
    are ignored, texts are read whole and in pieces of bounded memory, and empty tables of either kind are allowed.
    """
    docs = texts(docs, id_col, text_col)
    gain = gains(docs, target.select(F.coalesce(F.col(target_col), F.lit("")).alias("text")), buckets, grams)
    scored = weights(docs, gain, grams).withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), salt))
    scored = cut(scored.withColumns({"_neg": -F.col("score"), "_null": F.col("doc_id").isNull(), "_row": F.monotonically_increasing_id()}))
    able, key = F.col("n_words") >= min_words, ["_neg", "_null", "doc_id", "_row"]
    k = scored.filter(able).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("bigint")).select(*out)
    last = kth(scored.filter(able), key, k)
    wins = able & (F.struct(*key) <= F.struct(*[F.lit(v).cast(scored.schema[c].dataType).alias(c) for c, v in zip(key, last)]))
    return ranked(scored.filter(wins), key).select(*out).unionByName(scored.filter(~wins).withColumn("rank", F.lit(None).cast("bigint")).select(*out))
