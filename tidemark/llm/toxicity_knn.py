"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The terms are all words that occur in two or more rows of a bounded sample of labelled rows (``sample``, by a hash of the
id), and word beginnings that occur at least twice or four times in a text, where these are telling (so that inflected
forms meet, and one chance form isn't enough). Association with the label only weights terms: those whose chi-square is
at least ``min_share`` of the strongest one's keep their TF-IDF weight, of a word and its beginnings the strongest or a
longer one that is nearly as strong, and all other words have theirs times ``faint``, so that a few telling words in a
long text aren't drowned. Sample rows that are near copies of an earlier one (by a small min-hash sketch) are left out of
the fit: else every rare word of a much-copied example would look telling.

All other examples form an inverted index: each term has a posting list of examples and weights, examples lie in blocks,
and each list keeps its largest weight per block. A text's blocks get an upper bound from these maxima; the blocks
with the highest bounds are scored first, then all that can still reach the k-th neighbour, so the neighbours are exact.
Their votes, weighted by cosine and shrunk towards the base rate by a pseudo weight that leave-one-out loss picks, give a
calibrated score; the neighbours are the evidence. Texts without a known word get the label share of such examples.

The index is bounded by ``sample``, so it may be broadcast. Null texts count as empty. Ties between neighbours go to
the smaller example id, ties between terms to the one that sorts first; of repeated labelled rows one counts, and repeated
texts are scored alike. Labelled rows without an integer id don't count. Without labelled rows the score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled_sample, map_arrow, ready, texts

WORD = re.compile(r"[^\W_]+")
MEMO, STEMS, LEVELS, SKETCH, GROUP = 300_000, range(4, 9), (2, 4), 8, 64


def stems(word: str) -> list[str]:
    return [word[:k] for k in STEMS if k < len(word)]


def text_terms(words: list[str]) -> set[str]:
    """All terms of a text: ``word``, and ``stem=n`` where n or more of its words begin with the stem."""
    n: Counter = Counter()
    times = Counter(words)
    for w, k in times.items():
        for t in stems(w):
            n[t] += k
    return {*times, *(f"{t}={least}" for t, k in n.items() for least in LEVELS if k >= least)}


def sketch(text: str) -> list[int]:
    """Min-hashes of the four-word shingles."""
    words = text.lower().split()
    raw = [" ".join(words[i : i + 4]).encode() for i in range(max(1, len(words) - 3))]
    h = np.array([zlib.crc32(r) for r in raw], dtype=np.uint64)
    return [int(((h * np.uint64(2 * i + 1) * np.uint64(0x9E3779B1) + np.uint64(i * 77)) & np.uint64(0xFFFFFFFF)).min()) for i in range(SKETCH)]


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all [start, end), one after the other, and how many each has."""
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum()), size


class BlockIndex:
    """Posting lists of the labelled examples' unit TF-IDF vectors, with each list's maxima per block of examples."""

    def __init__(self, vocabulary: dict[str, int], weight: np.ndarray, block: int = 512):
        self.vocabulary, self.weight, self.block, self.known = vocabulary, weight, block, {}
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for term, i in vocabulary.items():
            base, _, least = term.partition("=")
            if least:
                self.levels.setdefault(base, []).append((int(least), i))
        self.none, self.base, self.pseudo = 0.0, 0.0, 1.0
        self.shared = None  # the broadcast, once there is one
        self.build([], [], [])

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, unit weights) of a text."""
        hits, n, known = {}, {}, self.known
        for w, times in Counter(WORD.findall(text.lower())).items():
            found = known.get(w)
            if found is None:
                if len(known) >= MEMO:
                    known.clear()
                found = known[w] = (self.vocabulary.get(w, -1), tuple(x for x in stems(w) if x in self.levels))
            if found[0] >= 0:
                hits[found[0]] = times
            for x in found[1]:
                n[x] = n.get(x, 0) + times
        for x, times in n.items():
            hits.update((i, times) for least, i in self.levels[x] if times >= least)
        if not hits:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
        terms = np.fromiter(hits, np.int32, len(hits))
        weights = (1 + np.log(np.fromiter(hits.values(), float, len(hits)))) * self.weight[terms]
        return terms, (weights / np.sqrt((weights**2).sum())).astype(np.float32)

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list[int], labels: list[int]) -> None:
        """Examples with the same leading term lie together, so that block maxima tell blocks apart."""
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), ids[i]))
        self.ids, self.labels = np.array([ids[i] for i in order], dtype=np.int64), np.array([labels[i] for i in order], dtype=float)
        none = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.float32)]
        terms, weights = (np.concatenate([vectors[i][k] for i in order] or none[k]) for k in (0, 1))
        rows = np.repeat(np.arange(len(order)), np.array([len(vectors[i][0]) for i in order], dtype=np.int64))
        at = np.argsort(terms, kind="stable")
        terms, self.rows, self.values = terms[at], rows[at], weights[at]
        self.size = np.bincount(terms, minlength=len(self.vocabulary))
        self.arrange()

    def arrange(self) -> None:
        """What follows from the posting lists: their cells and maxima per block, and the common lists as rows of weights."""
        terms = np.repeat(np.arange(len(self.size)), self.size)
        own = self.rows // self.block
        # one cell for each list and block: its block, its maximum, and where its postings begin
        first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (own[1:] != own[:-1])])) if len(terms) else np.empty(0, dtype=np.int64)
        self.cell_block, self.cell_start = own[first], np.append(first, len(terms))
        self.cell_top = np.maximum.reduceat(self.values, first) if len(first) else np.empty(0, dtype=np.float32)
        self.lists = np.searchsorted(terms[first], np.arange(len(self.size) + 1))
        # lists that hold a sixteenth of the examples are kept as rows of weights
        common = np.flatnonzero(self.size * 16 > len(self.ids))
        self.common = np.full(len(self.size), -1)
        self.common[common] = np.arange(len(common))
        self.full = np.zeros((len(common), len(self.ids)), dtype=np.float32)
        at = np.flatnonzero(self.common[terms] >= 0)
        self.full[self.common[terms[at]], self.rows[at]] = self.values[at]

    KEPT = ("vocabulary", "weight", "block", "levels", "values", "size", "ids", "labels", "none", "base", "pseudo")

    def __getstate__(self) -> dict:
        """Only the lists travel; a worker arranges them itself."""
        return {k: self.__dict__[k] for k in self.KEPT} | {"rows": self.rows.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"rows": state["rows"].astype(np.int64), "known": {}, "shared": None}
        self.arrange()

    def scored(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the examples in these blocks (a flag each); ``start`` is what the common terms give."""
        rare = self.common[terms] < 0
        terms, own = terms[rare], weights[rare]
        if blocks.all():
            postings, size = ranges(self.cell_start[self.lists[terms]], self.cell_start[self.lists[terms + 1]])
        else:
            cells, size = ranges(self.lists[terms], self.lists[terms + 1])
            part = blocks[self.cell_block[cells]]
            cells, own = cells[part], np.repeat(own, size)[part]
            postings, size = ranges(self.cell_start[cells], self.cell_start[cells + 1])
        total = np.bincount(self.rows[postings], self.values[postings] * np.repeat(own, size), len(self.ids)) + start
        found = np.flatnonzero(total > 0 if blocks.all() else (total > 0) & np.repeat(blocks, self.block)[: len(total)])
        return found, total[found]

    def common_weights(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at, out = self.common[terms], np.zeros(len(self.full), dtype=np.float32)
        out[at[at >= 0]] = weights[at >= 0]
        return out

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the cosine with an example of each block can't exceed."""
        cells, size = ranges(self.lists[terms], self.lists[terms + 1])
        return np.bincount(self.cell_block[cells], self.cell_top[cells] * np.repeat(weights, size), -(-len(self.ids) // self.block)).astype(np.float64, copy=False)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest examples with a positive cosine; ``skip`` is left out."""
        return self.nearest_of([(terms, weights)], k, [skip])[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skips: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``nearest``, of several texts, whose common terms are multiplied together."""
        limits = [self.bounds(*v) for v in vectors]
        firsts = [(b > 0) & (b >= b.max(initial=0) / 2) for b in limits]  # where few blocks stand out, they set the limit for the others
        shared = np.stack([self.common_weights(*v) for v in vectors]) @ self.full
        out = []
        for (terms, weights), bounds, now, skip, start in zip(vectors, limits, firsts, skips, shared):
            rows, sims, floor, done = np.empty(0, dtype=np.int64), np.empty(0), 0.0, np.zeros(len(bounds), dtype=bool)
            if 2 * now.sum() > len(now):  # none stand out
                now = np.ones(len(bounds), dtype=bool)
            while now.any():
                more, cosines = self.scored(terms, weights, now, start)
                done |= now
                keep = more != skip
                rows, sims = np.concatenate([rows, more[keep]]), np.concatenate([sims, cosines[keep]])
                if len(rows) > k:
                    floor = np.partition(sims, len(sims) - k)[len(sims) - k]
                now = ~done & (bounds > 0) & (bounds >= floor - 1e-6)
            close = sims >= floor - 1e-6
            rows, sims = rows[close], sims[close]
            top = np.lexsort((self.ids[rows], -np.round(sims, 6)))[:k]
            out.append((rows[top], sims[top]))
        return out

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        if not len(rows):
            return self.none
        return float((sims @ self.labels[rows] + self.pseudo * self.base) / (sims.sum() + self.pseudo))

    def calibrate(self, votes: np.ndarray, base: float, none: float) -> None:
        """The pseudo weight with the least log loss; votes: label, sum of cosines with label 1 and of all, of each example without itself."""
        self.base, self.none = base, none
        best = (np.inf, 1.0)
        for pseudo in (0.1, 0.25, 0.5, 1.0, 2.0):
            p = np.clip((votes[:, 1] + pseudo * base) / (votes[:, 2] + pseudo), 1e-4, 1 - 1e-4)
            best = min(best, (float(-(votes[:, 0] * np.log(p) + (1 - votes[:, 0]) * np.log(1 - p)).sum()), pseudo))
        self.pseudo = best[1]


def fit(docs: DataFrame, labels: DataFrame, label_col: str, k: int = 15, sample: int = 10_000, min_rows: int = 5, min_share: float = 0.04, faint: float = 0.01, text_col: str = "text", id_col: str = "doc_id") -> BlockIndex:
    """Vocabulary, index and calibration from at most ``sample`` labelled rows."""
    spark = docs.sparkSession
    ready(spark)
    rows = labelled_sample(docs, labels, label_col, sample, 5, id_col, text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "label")
    rows = cut(rows)

    def sketches(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "s"])

    seen: set[tuple[int, int]] = set()
    fresh = set()
    for r in sorted(map_arrow(rows.select("doc_id", "text"), sketches, "doc_id long, s array<long>").filter("doc_id is not null").collect(), key=lambda r: r["doc_id"]):
        keys = set(enumerate(r["s"]))
        if len(keys & seen) < 3:
            fresh.add(r["doc_id"])
        seen |= keys
    kept = spark.sparkContext.broadcast(fresh)

    def words(batches):
        for b in batches:
            n: Counter = Counter()
            for i, text, label in zip(*(b.column(k).to_pylist() for k in range(3))):
                if i in kept.value:
                    n.update((t, label) for t in text_terms(WORD.findall(text.lower())))
                    n["", label] += 1
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.string()), pa.array([y for _, y in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["word", "label", "n"])

    per_word = cut(map_arrow(rows, words, "word string, label int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")))
    totals = {r["word"]: (r["a"], r["b"]) for r in per_word.filter("word = ''").collect()}
    pos, neg = totals.get("", (0, 0))
    n = pos + neg
    if not pos or not neg:
        out = BlockIndex({}, np.empty(0))
        out.base = out.none = pos / n if n else 0.0
        return out
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = n * (a * (neg - b) - b * (pos - a)) ** 2 / (pos * neg * (a + b) * F.greatest(F.lit(1.0), n - a - b))
    best = per_word.filter((F.col("word") != "") & (a + b >= min_rows) & (a * neg > b * pos)).withColumn("chi", chi).orderBy(F.desc("chi"), "word").limit(2000).collect()
    strong = [r for r in best if r["chi"] >= max(15.0, min_share * best[0]["chi"])]
    best, taken = [], []
    for r in strong:
        stem = r["word"].partition("=")[0]
        if any(stem.startswith(o) or o.startswith(stem) for o in taken):
            continue
        # a longer term of the same chain that is nearly as strong is more precise
        chain = [x for x in strong if x["word"].startswith(stem) and x["chi"] >= 0.9 * r["chi"]]
        r = max(chain, key=lambda x: (len(x["word"].partition("=")[0]), x["word"]))
        best.append(r)
        taken.append(r["word"].partition("=")[0])
    telling = {r["word"] for r in best}
    listed = per_word.filter((F.col("word") != "") & (a + b >= 2) & (~F.contains("word", F.lit("=")) | F.col("word").isin(list(telling)))).select("word", (a + b).alias("n")).toPandas().sort_values("word")
    vocabulary = {w: i for i, w in enumerate(listed["word"])}
    gain = np.array([1.0 if w in telling else faint for w in listed["word"]])
    index = BlockIndex(vocabulary, (np.log((1 + n) / (1 + listed["n"].to_numpy(dtype=float))) + 1) * gain)
    shared = spark.sparkContext.broadcast(index)

    def vectors(batches):
        for b in batches:
            got = [shared.value.vector(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([t.tobytes() for t, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())], ["doc_id", "label", "terms", "weights"])

    kept_rows = cut(map_arrow(rows.dropDuplicates(["doc_id"]), vectors, "doc_id long, label int, terms binary, weights binary").filter(F.col("doc_id").isNotNull()))
    got = [r for r in sorted(kept_rows.collect(), key=lambda r: r["doc_id"]) if r["doc_id"] in fresh]
    unpacked = lambda r: (np.frombuffer(r["terms"], dtype=np.int32), np.frombuffer(r["weights"], dtype=np.float32))
    held = [r for r in got if r["terms"]]
    without = [r["label"] for r in got if not r["terms"]]
    index.build([unpacked(r) for r in held], [r["doc_id"] for r in held], [r["label"] for r in held])
    shared.unpersist()
    full = spark.sparkContext.broadcast(index)

    def votes(batches):
        own = {d: i for i, d in enumerate(full.value.ids.tolist())}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["doc_id"] in own:
                    found, sims = full.value.nearest(*unpacked(r), k, skip=own[r["doc_id"]])
                    out.append((float(r["label"]), float(sims @ full.value.labels[found]), float(sims.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*out) if out else [()] * 3)], ["label", "with", "all"])

    left_out = map_arrow(kept_rows, votes, "label double, with double, all double").toPandas().to_numpy(dtype=float).reshape(-1, 3)
    base = pos / n
    index.calibrate(left_out, base, (sum(without) + 0.5 * base) / (len(without) + 0.5))
    index.shared = full
    return index


def score(docs: DataFrame, index: BlockIndex, k: int = 15, evidence: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence): evidence are the nearest examples' ids, cosines and labels."""
    spark = docs.sparkSession
    ready(spark)
    shared, votes = index.shared or spark.sparkContext.broadcast(index), {k: getattr(index, k) for k in ("none", "base", "pseudo")}
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        index = shared.value
        index.__dict__ |= votes  # the votes were calibrated after the lists had been sent
        for b in batches:
            scores, why = [], []
            texts_ = b.column(1).to_pylist()
            for i in range(0, len(texts_), GROUP):
                vectors = [index.vector(t) for t in texts_[i : i + GROUP]]
                for rows, sims in index.nearest_of(vectors, k, [-1] * len(vectors)):
                    scores.append(index.vote(rows, sims))
                    why.append([{"doc_id": int(index.ids[r]), "cosine": float(s), "label": int(index.labels[r])} for r, s in zip(rows[:evidence], sims[:evidence])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(why, kind)], ["doc_id", "score", "evidence"])

    src = texts(docs, id_col, text_col)
    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")
