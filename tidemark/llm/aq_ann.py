"""Approximate nearest neighbours by additive quantisation.

A vector's direction is coded as one entry from each of several full-dimensional codebooks; their sum approximates it,
and its length is stored, so lengths of any scale or spread don't matter. Codebooks
start from k-means on residuals and are refined by least squares; codes come from a beam search over the sum. They
are fitted on a bounded sample (``sample`` vectors, by a hash of the id), but every vector is coded and searched.
Beside the code each vector stores its norm, that of its approximation and how far its score usually is off. A query's inner products with all
codebook entries form a lookup table, so a candidate's score is a sum of table entries, corrected by the stored norms
(``inner``), or turned into a squared distance by them (``euclid``), plus its usual error, so that long vectors aren't lost by it. The best ``rerank`` candidates of each query are
rescored exactly, in double precision, on the original vectors; their number grows with what a bounded set of queries,
compared with all vectors, turns out to need, on average and for nearly each of them.

Codes lie in shards of up to ``shard`` vectors, queries in blocks; every block meets every shard, and a shard returns
only its best candidates per query, which are merged in two levels. Vectors that are null, zero, of another length than most of the sample, or hold
null or non-finite components take no part; repeated ids count once. Equal scores go to the smaller id, and equal
vectors have equal codes, so ties survive the approximate step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, ready


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    src = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return src.filter(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))


class Codec:
    """Codebooks [m, k, d] and the search for codes."""

    def __init__(self, books: np.ndarray, beam: int, scale: float = 1.0):
        self.books, self.beam, self.scale = books, beam, scale  # scale: a usual length, by which lengths are divided
        m, k, d = books.shape
        self.flat = books.reshape(m * k, d)
        self.gram = None

    def __getstate__(self) -> dict:
        """Only the codebooks travel; a worker that encodes computes their inner products itself."""
        return self.__dict__ | {"gram": None}

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Beam search: uint8 codes [n, m] whose entries' sum is near x."""
        m, k, _ = self.books.shape
        n = len(x)
        if self.gram is None:
            small = self.flat.astype(np.float32)
            self.gram = small @ small.T
        dots = x @ self.flat.T
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        cost = np.zeros((n, 1))
        for j in range(m):
            part = slice(j * k, (j + 1) * k)
            step = np.diag(self.gram)[part][None, None, :] - 2 * dots[:, None, part]
            step = np.repeat(step, codes.shape[1], axis=1)
            for i in range(j):
                step += 2 * self.gram[i * k + codes[:, :, i], part]
            total = (cost[:, :, None] + step).reshape(n, -1)
            width = min(self.beam, total.shape[1])
            top = np.argpartition(total, width - 1, axis=1)[:, :width] if width < total.shape[1] else np.tile(np.arange(width), (n, 1))
            top = np.sort(top, axis=1)
            cost = np.take_along_axis(total, top, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, (top // k)[:, :, None], axis=1), (top % k)[:, :, None]], axis=2)
        best = cost.argmin(axis=1)
        return codes[np.arange(n), best].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[j][codes[:, j]] for j in range(len(self.books)))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and the lengths; no square overflows or vanishes."""
    top = np.abs(x).max(axis=1, keepdims=True)
    part = x / top
    size = np.sqrt((part**2).sum(axis=1, keepdims=True))
    return part / size, (top * size)[:, 0]


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:k]].copy()
    centre = np.concatenate([centre, np.zeros((k - len(centre), x.shape[1]))]) if len(centre) < k else centre
    for _ in range(steps):
        near = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def fit_codec(x: np.ndarray, books: int = 16, entries: int = 256, beam: int = 8, rounds: int = 3, seed: int = 13) -> Codec:
    entries = max(1, min(entries, len(x), 256))
    rest, out = x.copy(), []
    for j in range(books):
        c = kmeans(rest, entries, seed + j)
        rest = rest - c[(rest @ c.T - 0.5 * (c**2).sum(1)).argmax(1)]
        out.append(c)
    codec = Codec(np.stack(out), beam)
    for _ in range(rounds):
        codes = np.concatenate([codec.encode(x[i : i + 512]) for i in range(0, len(x), 512)])
        codec.gram = None
        hot = (codes + np.arange(books) * entries).astype(np.int64)
        a = np.zeros((len(x), books * entries), dtype=np.float32)
        a[np.arange(len(x))[:, None], hot] = 1
        left, right = a.T @ a, a.T @ x.astype(np.float32) + 0.05 * codec.flat.astype(np.float32)
        del a
        left[np.diag_indices_from(left)] += 0.05
        new = np.linalg.solve(left, right)
        del left
        codec = Codec(new.astype(np.float64).reshape(codec.books.shape), beam)
    return codec


def best_rows(scores: np.ndarray, keep: int) -> list[np.ndarray]:
    """Positions of each row's largest scores; among equal ones, the first positions."""
    if scores.shape[1] <= keep:
        return [np.arange(scores.shape[1])] * len(scores)
    limit = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
    out = []
    for row, least in zip(scores, limit):
        above = np.flatnonzero(row > least)
        out.append(np.concatenate([above, np.flatnonzero(row == least)[: keep - len(above)]]))
    return out


def rough_scores(q: np.ndarray, row: dict, codec: Codec, measure: str):
    """Yield (first query, scores of all rows of a shard), 16 queries at a time, from codes and stored norms."""
    width = len(codec.books)
    code = np.frombuffer(row["codes"], dtype=np.uint8).reshape(-1, width)
    norm, near = np.frombuffer(row["norms"]), np.frombuffer(row["nears"])
    slack = np.frombuffer(row["slacks"]).astype(np.float32)
    ratio = (norm / np.maximum(near, 1e-12)).astype(np.float32)
    own, length = directions(q)
    q = own if measure == "inner" else q / codec.scale
    length = (length / codec.scale).astype(np.float32)[:, None]
    table = (q @ codec.flat.T).reshape(len(q), width, -1).astype(np.float32)
    for i in range(0, len(q), 16):
        t = table[i : i + 16]
        s = np.zeros((len(t), len(code)), dtype=np.float32)
        for j in range(width):
            s += t[:, j, :].take(code[:, j], axis=1)
        yield i, s * ratio + slack if measure == "inner" else 2 * (s * ratio + length[i : i + 16] * slack) - (norm**2).astype(np.float32)


def needed_rerank(src: DataFrame, blocks: DataFrame, queries: DataFrame, shared, k: int, measure: str, probes: int, recall: float) -> int:
    """How many candidates by approximate score hold the share ``recall`` of the k true neighbours of some queries, and nine tenths of those of 95 % of the queries.

    One pass over all vectors for the true neighbours, two over the codes: the neighbours' approximate scores, then
    the number of rows that are approximately no worse than each. All return a bounded number of rows.
    """
    asked = queries.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(probes).collect()
    if not asked:
        return 0
    own, q = [r["vec_id"] for r in asked], np.array([r["v"] for r in asked], dtype=float)
    kind = src.schema["vec_id"].dataType.simpleString()

    def true(batches):
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.slice(i, 1024)
                x, ids, out = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(part), -1), part.column(0).to_pylist(), []
                exact = q @ x.T if measure == "inner" else 2 * (q @ x.T) - (x**2).sum(1)
                exact[np.array(own)[:, None] == np.array(ids)[None, :]] = -np.inf
                for n, found in enumerate(best_rows(exact, k)):
                    out += [(n, float(exact[n, j]), ids[j]) for j in found if exact[n, j] > -np.inf]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int32(), pa.float64(), b.column(0).type))], ["n", "exact", "vec_id"])

    best = Window.partitionBy("n").orderBy(F.desc("exact"), "vec_id")
    found = map_arrow(src, true, f"n int, exact double, vec_id {kind}").withColumn("o", F.row_number().over(best)).filter(F.col("o") <= k).select("n", "vec_id").collect()
    near_ids = [{r["vec_id"] for r in found if r["n"] == n} for n in range(len(own))]

    def neighbours(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, out = np.array(r["ids"]), []
                for i, s in rough_scores(q, r, shared.value, measure):
                    for n, row in enumerate(s, i):
                        out += [(n, float(row[j])) for j in np.flatnonzero(np.isin(ids, list(near_ids[n])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 2, (pa.int32(), pa.float32()))], ["n", "rough"])

    rough = map_arrow(blocks.select("ids", "codes", "norms", "nears", "slacks"), neighbours, "n int, rough float").collect()
    wanted = [np.sort(np.array([r["rough"] for r in rough if r["n"] == n], dtype=np.float32)) for n in range(len(own))]

    def ahead(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, out = np.array(r["ids"]), []
                for i, s in rough_scores(q, r, shared.value, measure):
                    for n, row in enumerate(s, i):
                        row = np.sort(row[ids != own[n]])
                        out += [(n, j, int(len(row) - c)) for j, c in enumerate(np.searchsorted(row, wanted[n]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int32(), pa.int32(), pa.int64()))], ["n", "j", "ahead"])

    places = map_arrow(blocks.select("ids", "codes", "norms", "nears", "slacks"), ahead, "n int, j int, ahead long").groupBy("n", "j").agg(F.sum("ahead").alias("ahead")).collect()
    least = lambda values, part: int(np.sort(values)[int(np.ceil(part * len(values))) - 1]) if len(values) else 0
    own_need = [least([r["ahead"] for r in places if r["n"] == n], 0.9) for n in range(len(own))]
    return max(least([r["ahead"] for r in places], recall), least(own_need, 0.95))


def search(vectors: DataFrame, is_query, k: int = 20, measure: str = "inner", sample: int = 4000, books: int = 16, rerank: int = 400, shard: int = 32768, query_block: int = 256, probes: int = 64, recall: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, exactly scored.

    ``is_query`` maps the id column to a condition. ``inner``: largest inner product; ``euclid``: smallest squared
    distance. ``rerank`` is the least number of candidates; it is raised to what ``probes`` queries, compared with all
    rows, need for the mean share ``recall`` of their true neighbours.
    """
    spark = vectors.sparkSession
    ready(spark)
    src = cut(usable(vectors, id_col, vec_col))
    kind = src.schema["vec_id"].dataType.simpleString()
    taken = src.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(sample).collect()
    empty = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not taken:
        return spark.createDataFrame([], empty)
    size = np.bincount([len(r["v"]) for r in taken]).argmax()
    src = src.filter(F.size("v") == int(size))
    fitted, lengths = directions(np.array([r["v"] for r in taken if len(r["v"]) == size]))
    codec = fit_codec(fitted, books)
    codec.scale = float(np.median(lengths))
    shared = spark.sparkContext.broadcast(codec)

    def matrix(column) -> np.ndarray:
        return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)

    def coded(batches):
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.slice(i, 1024)
                x, length = directions(matrix(part.column(1)))
                codes = shared.value.encode(x)
                got = shared.value.decode(codes)
                near, length = np.sqrt((got**2).sum(1)), length / shared.value.scale
                slack = np.sqrt(((got / np.maximum(near, 1e-12)[:, None] - x) ** 2).mean(1)) * length
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(near), pa.array(slack)], ["vec_id", "code", "norm", "near", "slack"])

    rows = src.count()
    shards = max(1, -(-rows // shard))
    codes = map_arrow(src, coded, f"vec_id {kind}, code binary, norm double, near double, slack double").repartition(shards, F.xxhash64("vec_id")).sortWithinPartitions("vec_id")

    def packed(batches):
        for b in batches:
            for i in range(0, len(b), shard):
                p = b.slice(i, shard)
                yield pa.RecordBatch.from_arrays([pa.array([p.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([b"".join(p.column(1).to_pylist())], pa.binary()), *[pa.array([p.column(c).to_numpy().tobytes()], pa.binary()) for c in (2, 3, 4)]], ["ids", "codes", "norms", "nears", "slacks"])

    blocks = cut(map_arrow(codes, packed, f"ids array<{kind}>, codes binary, norms binary, nears binary, slacks binary").withColumn("s", F.monotonically_increasing_id()))
    ids_of = [r["s"] for r in blocks.select("s").collect()]  # one number per shard

    def grouped(batches):
        for b in batches:
            for i in range(0, len(b), query_block):
                p = b.slice(i, query_block)
                yield pa.RecordBatch.from_arrays([pa.array([p.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([matrix(p.column(1)).tobytes()], pa.binary())], ["q_ids", "q"])

    queries = src.filter(is_query(F.col("vec_id")))
    rerank = max(rerank, needed_rerank(src, blocks, queries, shared, k, measure, probes, recall))
    asked = map_arrow(queries, grouped, f"q_ids array<{kind}>, q binary").withColumn("s", F.explode(F.array(*map(F.lit, ids_of)) if ids_of else F.array().cast("array<long>")))

    def scan(batches):
        c = shared.value
        for b in batches:
            for r in b.to_pylist():
                q = np.frombuffer(r["q"]).reshape(len(r["q_ids"]), -1)
                ids = np.array(r["ids"])
                keep_ids, keep_scores = [], []
                for i, s in rough_scores(q, r, c, measure):
                    for row, found in enumerate(best_rows(s, rerank + 1)):
                        found = found[ids[found] != r["q_ids"][i + row]][:rerank] if len(found) <= rerank else found
                        keep_ids.append(ids[found].tolist()), keep_scores.append(s[row, found].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(r["q_ids"], b.schema.field("q_ids").type.value_type), pa.array([r["s"]] * len(r["q_ids"]), pa.int64()), pa.array(keep_ids, pa.list_(b.schema.field("ids").type.value_type)), pa.array(keep_scores, pa.list_(pa.float32()))], ["query_id", "s", "ids", "scores"])

    scanned = map_arrow(asked.join(blocks, "s").select("s", "q_ids", "q", "ids", "codes", "norms", "nears", "slacks"), scan, f"query_id {kind}, s long, ids array<{kind}>, scores array<float>")

    def merge(batches):
        for b in batches:
            out_ids, out_scores = [], []
            for r in b.select(["query_id", "found"]).to_pylist():
                ids, s = np.concatenate([np.array(x["ids"]) for x in r["found"]]), np.concatenate([np.array(x["scores"], dtype=np.float32) for x in r["found"]])
                keep = ids != r["query_id"]
                ids, s = ids[keep], s[keep]
                top = np.lexsort((ids, -s))[:rerank]
                out_ids.append(ids[top].tolist()), out_scores.append(s[top].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out_ids, pa.list_(b.column(0).type)), pa.array(out_scores, pa.list_(pa.float32()))], ["query_id", "ids", "scores"])

    def merged(rows: DataFrame, *by) -> DataFrame:
        lists = rows.groupBy("query_id", *by).agg(F.collect_list(F.struct("ids", "scores")).alias("found")).select("query_id", "found")
        return map_arrow(lists, merge, f"query_id {kind}, ids array<{kind}>, scores array<float>")

    if len(ids_of) > 16:  # in two levels, so that no list holds more than about the root of the shards
        scanned = merged(scanned, F.pmod(F.xxhash64("s"), F.lit(int(np.ceil(np.sqrt(len(ids_of)))))).alias("g"))
    pairs = merged(scanned).select("query_id", F.explode("ids").alias("vec_id"))
    # single-precision vectors move as such; products and sums are double
    element = vectors.schema[vec_col].dataType.elementType.typeName()
    sent = src.select("vec_id", F.col("v").cast("array<float>").alias("v")) if element == "float" else src
    asking = queries.select(F.col("vec_id").alias("query_id"), (F.col("v").cast("array<float>") if element == "float" else F.col("v")).alias("q"))
    joined = pairs.join(sent, "vec_id").join(asking, "query_id")
    d = lambda x: x.cast("double")
    part = (lambda x, y: d(x) * d(y)) if measure == "inner" else (lambda x, y: -(d(x) - d(y)) * (d(x) - d(y)))
    exact = F.aggregate(F.zip_with("q", "v", part), F.lit(0.0), lambda a, x: a + x)
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    ranked = joined.select("query_id", "vec_id", exact.alias("s")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", (F.col("s") if measure == "inner" else -F.col("s")).alias("score"))
