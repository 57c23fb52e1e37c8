"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (each run of the six ASCII white-space bytes becomes one space) and read as a polynomial in two
bases modulo two primes. Fingerprints compose: hash(xy) = hash(x) * base^len(y) + hash(y), so a huge document is cut
into chunks, the chunks are hashed in parallel and their hashes are combined by length-shifted arithmetic in SQL.
Rows with equal fingerprints (length and both hashes) are then compared with their group's first row chunk by chunk:
chunks, not whole texts, are what moves and what a task holds. Rows that differ from the first (a collision) form
the next round, so the result is exact.

Large groups: only keys with more rows than a fixed share are broadcast (their number is bounded), and the
comparison salts each group, copying the first row's chunks to every salt.

Null texts count as empty, empty texts are equal to each other. Repeated rows are returned once each and count in
group_size; inside, a row is known by its id and a hash of its text, so rows of one id with different texts are told
apart. Rows whose id is null are grouped by fingerprint alone. An empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, look_up, map_arrow, texts

#: Primes below 2^31 and bases.
P1, P2, B1, B2 = 2147483647, 2147483629, 1000003, 998244353
SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
POWER_OF: dict[tuple[int, int], np.ndarray] = {}


def normalise(raw: bytes) -> bytes:
    raw = raw.translate(SPACES)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^(n-1) .. base^0, from a table that is kept and doubled when needed."""
    have = POWER_OF.get((base, prime))
    if have is None or len(have) < n:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
        POWER_OF[base, prime] = have = out[::-1].copy()
    return have[len(have) - n :]


def polynomial(raw: bytes, base: int, prime: int) -> int:
    """Sum of byte * base^(bytes after it), modulo prime."""
    total, step = 0, 1 << 20
    for i in range(0, len(raw), step):
        a = np.frombuffer(raw, dtype=np.uint8)[i : i + step].astype(np.uint64)
        total = (total * pow(base, len(a), prime) + int((a + np.uint64(1)) @ _powers(base, prime, len(a)))) % prime
    return total


def combine(h1: int, h2: int, n2: int, base: int, prime: int) -> int:
    return (h1 * pow(base, n2, prime) + h2) % prime


def fingerprints(docs: DataFrame, chunk: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """(doc_id, n_bytes, h1, h2[, text_sha256]) of every whole normalised text; texts over ``chunk`` characters are hashed in parallel."""
    src = texts(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def hashed(raw: bytes) -> tuple:
        return len(raw), polynomial(raw, B1, P1), polynomial(raw, B2, P2)

    def whole(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                raw = normalise(t.as_buffer().to_pybytes())
                rows.append((*hashed(raw), hashlib.sha256(raw).hexdigest() if digest else None))
            n, x, y, s = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(s, pa.string())], ["doc_id", "n_bytes", "h1", "h2", "text_sha256"])

    def piece(batches):
        for b in batches:
            rows = []
            for t, before in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw = t.encode()
                joined = normalise(before.encode() + raw)
                raw = joined[1:] if before and joined[:1] == b" " else normalise(raw)
                rows.append((*hashed(raw), pow(B1, len(raw), P1), pow(B2, len(raw), P2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5))], ["k", "c", "n", "x", "y", "px", "py"])

    size = F.length("text")
    short = map_arrow(src.filter(size <= chunk), whole, f"doc_id {kind}, n_bytes long, h1 long, h2 long, text_sha256 string")
    huge = src.filter(size > chunk)
    sha = F.sha2(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), 256) if digest else F.lit(None).cast("string")
    cuts = huge.select(
        F.struct("doc_id", F.xxhash64("text").alias("t")).alias("k"), "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))).alias("c")
    ).select("k", "c", F.expr(f"substring(text, c * {chunk} + 1, {chunk})").alias("body"), F.expr(f"if(c = 0, '', substring(text, c * {chunk}, 1))").alias("before"))
    # of repeated rows one's chunks are enough: their key is the same, and so is the text
    done = map_arrow(cuts.dropDuplicates(["k", "c"]), piece, f"k struct<doc_id: {kind}, t: bigint>, c int, n long, x long, y long, px long, py long")
    fold = f"aggregate(array_sort(v), struct(0L as n, 0L as x, 0L as y), (a, e) -> struct(a.n + e.n as n, (a.x * e.px + e.x) % {P1}L as x, (a.y * e.py + e.y) % {P2}L as y))"
    folded = done.groupBy("k").agg(F.collect_list(F.struct("c", "n", "x", "y", "px", "py")).alias("v")).select("k", F.expr(fold).alias("f"))
    shas = huge.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("k"), sha.alias("text_sha256"))
    long = shas.join(folded, "k").select("k.doc_id", F.col("f.n").alias("n_bytes"), F.col("f.x").alias("h1"), F.col("f.y").alias("h2"), "text_sha256")
    return short.unionByName(long)


def _differing(members: DataFrame, docs: DataFrame, chunk: int, salt_rows: int) -> DataFrame:
    """Of members (doc_id, g = first doc_id, n_bytes, group_size), those whose text isn't that of doc g."""
    text = members.select("doc_id", "g", "group_size").dropDuplicates(["doc_id"]).join(docs, "doc_id").select(
        "doc_id", "g", F.greatest(F.lit(1), F.ceil(F.col("group_size") / salt_rows)).cast("int").alias("salts"), F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ").alias("text"))
    first = F.col("doc_id") == F.col("g")
    salts = F.when(first, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")))
    rows = text.withColumn("c", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / chunk).cast("int")))).select("g", "c", F.explode(salts).alias("salt"), "doc_id", F.expr(f"substring(text, c * {chunk} + 1, {chunk})").alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        key = body = None
        for b in batches:
            bad = []
            for i, (g, c, s, d) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                raw = b.column(4)[i].as_buffer()
                if (g, c, s) != key:
                    key, body = (g, c, s), raw.to_pybytes() if d == g else None
                elif d != g and (body is None or len(body) != raw.size or raw.to_pybytes() != body):
                    bad.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(bad, b.column(3).type)], ["doc_id"])

    dealt = rows.repartition("g", "c", "salt").sortWithinPartitions("g", "c", "salt", (F.col("doc_id") != F.col("g")), "doc_id")
    return map_arrow(dealt, run, f"doc_id {kind}").distinct()


def exact_dedup(docs: DataFrame, chunk: int = 1 << 20, salt_rows: int = 64, whole: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document.

    Texts are compared in pieces of ``chunk`` characters; those over ``whole`` are hashed in pieces too.
    """
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("t")))
    src = texts(docs, id_col, text_col).select(named.alias("doc_id"), "text")
    keys = ["n_bytes", "h1", "h2", "round"]
    open_ = cut(fingerprints(src, whole).withColumn("round", F.lit(0)))
    rows, step, done = open_.count(), 0, None
    while True:
        stats = open_.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = look_up(open_, stats, keys, "group_size", rows)
        members = found.filter((F.col("group_size") > 1) & F.col("doc_id").isNotNull()).withColumnRenamed("keep_id", "g")
        bad = cut(_differing(members, src, chunk, salt_rows))
        if bad.isEmpty():
            out = found if done is None else done.unionByName(found)
            break
        step += 1
        part = found.join(bad, "doc_id", "left_anti").drop("keep_id", "group_size")
        stats = part.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        settled = look_up(part, stats, keys, "group_size", rows)
        done = cut(settled if done is None else done.unionByName(settled))
        open_ = cut(found.join(bad, "doc_id", "left_semi").drop("keep_id", "group_size").withColumn("round", F.lit(step)))
    # repeated rows of one id: only the id decides what stays
    own, keep = F.col("doc_id.doc_id"), F.col("keep_id.doc_id")
    return out.select(own.alias("doc_id"), keep.alias("keep_id"), "group_size", F.coalesce(own == keep, F.lit(False)).alias("kept"), "text_sha256")
