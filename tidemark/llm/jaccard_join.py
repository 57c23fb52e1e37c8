"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle.

Texts with equal shingle sets form a class, named by a hash of the set; classes take part, not rows. Sets of at least
``percent`` similarity differ in at most (|x| + |y|)(100 - p)/(100 + p) elements, so when the universe of shingle
hashes is cut into more segments than that, they agree in a segment. Sizes fall into bands that set the number of
segments; a set is signed under its own band and, if a partner can lie there, under the next.

Allocation by cost: what a segment costs is how many sets have the same subset there. A first pass over all rows counts
the signatures that are frequent in a task, and their totals order them. A set of k non-empty segments of which d can
differ needs only the d + 1 cheapest: any partner agrees with it in k - d of them, and in one order common to both the
cheapest common one is kept on both sides. So each set leaves its costliest segments out (allocation 0), signs the
others' subsets exactly (1), and where too many segments are empty for that, also by their one-deletion neighbourhoods
(2), or at worst by one signature for the whole band. The counts only order signatures: whatever they are, no pair is lost.

Signatures move as packed arrays dealt out by hash, the most frequent ones dealt out by member too. A bucket's members
first meet its smallest member. Parity sketches (a bit for each hashed bin of a set; their distance never exceeds the
sets') rule out nearly all pairs that don't link, and only the others are verified on whole texts. After joining what
links, the members of a bucket outside its main component meet the bucket in a grid of bounded cells, which give for
each such member and other component the nearest partner that the sketches allow; where one of these fails, all that
the sketches allow are verified. Groups of copies so cost about one verification per member, not one per pair.

Null and empty texts have no shingles and link with nothing. Rows with equal texts and repeated rows are in one class;
rows that share an id but not their text are in the classes of their texts. Rows without an id come back as their own
component with a null id. An empty table gives an empty result. Extra columns are not read. A class is known by 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, look_up, map_arrow, texts
from .components import components, joined
from .shingles import GOLD, U, mix, shingle_sets

MANY, OFTEN, MOST_COSTS = 3_000_000, 4, 20_000
TAG, TAG_DELETED, TAG_EMPTY = U(0x1234567), U(0x7654321), U(0xABCDEF)


class Costs:
    """How many sets have a signature, as far as it is known to be frequent; only the top 40 bits of signatures count."""

    def __init__(self, signatures=(), counts=()):
        order = np.argsort(np.array(signatures, dtype=U))
        self.keys, self.counts = np.array(signatures, dtype=U)[order], np.array(counts, dtype=np.float64)[order]

    def of(self, sig: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(sig))
        key = sig >> U(24)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.counts[at], 0.0)


class Scheme:
    """Size bands of the threshold and the signatures of a set under them; without costs every segment is signed."""

    def __init__(self, percent: int, costs: Costs | None = None):
        self.p, self.costs = percent, costs
        self.least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
        self.bounds = [self.least]

    def band(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(-(-self.bounds[-1] * 100**3 // self.p**3) + 1)
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def apart(self, a: int, b: int) -> int:
        """Most elements in which linked sets of these sizes can differ."""
        return (a + b) * (100 - self.p) // (100 + self.p)

    def segments(self, band: int) -> int:
        most = self.apart(self.bounds[band + 1] - 1, self.bounds[band + 1] - 1)
        return most + 2 + most // 16

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Of a sorted set of hashes; sets too small to link with another set have none."""
        if len(s) < self.least:
            return np.empty(0, dtype=U)
        own, most = self.band(len(s)), len(s) * 100 // self.p
        self.band(most)
        self.band(self.bounds[own + 1])
        out = [self._signed(s, own, min(most, self.bounds[own + 1] - 1))]
        if most >= self.bounds[own + 1]:
            out.append(self._signed(s, own + 1, most))
        return np.concatenate(out)

    def _signed(self, s: np.ndarray, band: int, partner: int) -> np.ndarray:
        m, apart = self.segments(band), self.apart(len(s), partner)
        edges = (np.arange(m, dtype=np.float64) * (2.0**64 / m)).astype(U)
        at = np.searchsorted(s, edges)
        size = np.diff(np.append(at, len(s)))
        full = np.flatnonzero(size)
        mixed = mix(s + GOLD)
        sums = np.add.reduceat(mixed, at[full])
        key = U(band + 1) * MIXED_BAND + full.astype(U)
        exact = mix(mix(sums) + key * GOLD + TAG)
        if self.costs and len(full) > apart + 1:  # the cheapest apart + 1; few elements are likelier to be shared than many
            order = np.lexsort((exact, self.costs.of(exact) - size[full] / 2.0**20))
            exact = exact[order[: apart + 1]]
        out = [exact]
        if len(full) <= apart:  # too many empty segments for exact signatures alone
            where = np.repeat(np.arange(len(full)), size[full])
            less = mix(mix(sums[where] - mixed) + key[where] * GOLD + TAG_DELETED)
            none = np.flatnonzero(size == 0).astype(U) + U(band + 1) * MIXED_BAND
            out += [mix(mix(sums) + key * GOLD + TAG_DELETED), less, mix(mix(np.zeros(len(none), dtype=U)) + none * GOLD + TAG_DELETED)]
            if 2 * len(full) <= apart:
                out.append(mix(np.array([band], dtype=U) * GOLD + TAG_EMPTY))
        return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


MIXED_BAND = U(1 << 40)


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each of 2 to 4 |s| hashed bins, set where an odd number of elements fall; as bytes."""
    bins = 1 << max(6, int(2 * max(1, len(s)) - 1).bit_length())
    return np.packbits(np.bincount((mix(s + U(99)) & U(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1)


def fold(rows: np.ndarray, width: int) -> np.ndarray:
    """Parity sketches (rows x bytes) brought down to ``width`` bytes."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def class_of(s: np.ndarray) -> int:
    return mix(s).sum(dtype=U)


def sketch_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bits): f1 and f2 identify the shingle set, bits is its parity sketch.

    Further rows with a count hold the signatures that are frequent in a task: (sig, count).
    """

    def run(batches):
        scheme, held, here, total, type_ = Scheme(percent), [], set(), 0, None

        def frequent():
            sig, count = np.unique(np.concatenate(held) >> U(24), return_counts=True) if held else (np.empty(0, U), np.empty(0, np.int64))
            often = np.flatnonzero(count >= OFTEN)
            often = often[np.argsort(-count[often], kind="stable")[: MOST_COSTS // 4]]
            none = [None] * len(often)
            return pa.RecordBatch.from_arrays([pa.array(none, type_), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(sig[often].view(np.int64)), pa.array(count[often], pa.int64())], NAMES)

        for b in batches:
            type_ = b.column(0).type
            n, x, y, bits = [], [], [], []
            for s in shingle_sets(b.column(1), words):
                f = class_of(s)
                n.append(len(s)), x.append(f), y.append(mix(s * GOLD + U(7)).sum(dtype=U)), bits.append(parity(s).tobytes() if len(s) >= scheme.least else None)
                if len(s) >= scheme.least and f not in here:
                    here.add(f), held.append(scheme.signatures(s))
                    total += len(held[-1])
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.array(x, dtype=U).view(np.int64)), pa.array(np.array(y, dtype=U).view(np.int64)), pa.array(bits, pa.binary()), none, none], NAMES)
            if total > MANY:
                yield frequent()
                held, here, total = [], set(), 0
        if total:
            yield frequent()

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, bits binary, sig long, count long")


NAMES = ["doc_id", "n_shingles", "f1", "f2", "bits", "sig", "count"]


def buckets(docs: DataFrame, words: int, percent: int, parts: int, costs: Costs, hot: float) -> DataFrame:
    """(h, f): classes that share a signature, one row per member; equal member lists are listed once per task.

    Signatures that over ``hot`` sets have are dealt out by member as well, and named by themselves.
    """
    split = np.sort(costs.keys[costs.counts > hot])

    def sign(batches):
        scheme = Scheme(percent, costs)
        for b in batches:
            got, node, total = [], [], 0

            def flush():
                if not got:
                    return
                local = np.repeat(np.arange(len(got), dtype=U), [len(g) for g in got])
                sig = np.concatenate(got)
                at = np.where(np.isin(sig >> U(24), split), mix(sig ^ np.array(node, dtype=U)[local.astype(np.int64)]), sig)
                part = ((at & U(0xFFFFFF)) % U(parts)).astype(np.int64)
                key = (sig >> U(24)) << U(24) | local
                order = np.argsort(part, kind="stable")
                key, ends = key[order], np.searchsorted(part[order], np.arange(parts + 1))
                names = np.array(node, dtype=U)
                rows = [(p, key[ends[p] : ends[p + 1]]) for p in range(parts) if ends[p] < ends[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([k.tobytes() for _, k in rows], pa.binary()), pa.array([names.tobytes()] * len(rows), pa.binary())], ["p", "keys", "nodes"])

            here = set()
            for s in shingle_sets(b.column(1), words):
                if len(s) < scheme.least:
                    continue
                f = class_of(s)
                if f in here:
                    continue
                here.add(f)
                got.append(scheme.signatures(s)), node.append(f)
                total += len(got[-1])
                if total > MANY:
                    yield from flush()
                    got, node, total = [], [], 0
            yield from flush()

    def meet(batches):
        now, keys, nodes, base = None, [], [], 0

        def close():
            if not keys:
                return
            key, name = np.concatenate(keys), np.concatenate(nodes)
            who = np.concatenate([(k & U(0xFFFFFF)).astype(np.int64) + at for k, at in zip(keys, np.cumsum([0, *map(len, nodes[:-1])]))])
            key = key >> U(24)
            order = np.argsort(key, kind="stable")
            key, who = key[order], name[who[order]]
            same, often = np.concatenate([[False], key[1:] == key[:-1], [False]]), np.isin(key, split)
            keep = same[:-1] | same[1:] | often
            key, who = key[keep], who[keep]
            order = np.lexsort((who, key))
            key, who = key[order], who[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])]) if len(key) else np.empty(0, bool)
            key, who = key[fresh], who[fresh]
            if not len(key):
                return
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            often = np.isin(key[starts], split)
            name_of = np.where(often, mix(key[starts] + GOLD), mix(np.add.reduceat(mix(who), starts) + size.astype(U) * GOLD))
            first = np.zeros(len(starts), dtype=bool)
            first[np.unique(name_of, return_index=True)[1]] = True
            first &= (size > 1) | often
            take = np.repeat(first, size)
            h, f = np.repeat(name_of, size)[take], who[take]
            for i in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000].view(np.int64)), pa.array(f[i : i + 50_000].view(np.int64))], ["h", "f"])

        for b in batches:
            for p, k, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if p != now:
                    yield from close()
                    now, keys, nodes = p, [], []
                keys.append(np.frombuffer(k.as_buffer(), dtype=U).copy()), nodes.append(np.frombuffer(n.as_buffer(), dtype=U).copy())
        yield from close()

    signed = map_arrow(docs, sign, "p int, keys binary, nodes binary").repartition(parts, "p").sortWithinPartitions("p")
    return map_arrow(signed, meet, "h long, f long").distinct()


def dealt(pairs: DataFrame, rows: int, salt_rows: int = 64) -> DataFrame:
    """(a, salt, b, f): for each pair its b (f = b), in groups of about ``salt_rows``, and in each group a itself (b = f = a)."""
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).coalesce(1 + rows // 50_000)
    salts = F.ceil(F.col("k") / salt_rows).cast("int")
    others = look_up(pairs, per, ["a"], "k", max(1, rows)).select("a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), "b", F.col("b").alias("f"))
    return others.unionByName(per.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("a").alias("b"), F.col("a").alias("f")))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b") != F.col("a"), "b")


def possible(pairs: DataFrame, n_pairs: int, sketch: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that may link by their sketches (f, n, bits)."""
    rows = dealt(pairs, n_pairs).join(sketch, "f").select("a", "salt", "b", "n", "bits")

    def run(batches):
        key = n1 = bits1 = None
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, b, n, bits in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                row = np.frombuffer(bits.as_buffer(), dtype=np.uint8).reshape(1, -1)
                if a == b:
                    key, n1, bits1 = (a, salt), n, row.copy()
                elif key == (a, salt) and 100 * min(n, n1) >= percent * max(n, n1):
                    width = min(row.shape[1], bits1.shape[1])
                    if np.bitwise_count(fold(row, width) ^ fold(bits1, width)).sum(dtype=np.int64) <= (n + n1) * (100 - percent) // (100 + percent):
                        a_out.append(a), b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return map_arrow(_groups(rows), run, "a long, b long")


def verified(pairs: DataFrame, n_pairs: int, classes: DataFrame, src: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """Of pairs (a, b) of classes those that link and their number, by the whole texts of the classes' first documents (f, id)."""
    rows = dealt(pairs, n_pairs).join(classes.select("f", F.col("id").alias("doc_id")), "f").join(src, "doc_id").select("a", "salt", "b", "text")

    def run(batches):
        key = head = seen = None
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, b, s in zip(*(batch.column(i).to_pylist() for i in range(3)), shingle_sets(batch.column(3), words)):
                if int(class_of(s).view(np.int64)) != b:
                    continue  # another text of the same id
                if a == b:
                    key, head, seen = (a, salt), s, None
                elif key == (a, salt) and b != seen:
                    seen = b
                    both = len(np.intersect1d(head, s, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(s) - both):
                        a_out.append(a), b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return kept(map_arrow(_groups(rows), run, "a long, b long"))


def across(rows: DataFrame, label: DataFrame, sketch: DataFrame, percent: int, nearest: bool, block: int = 8192, cell_bytes: int = 1 << 22) -> DataFrame:
    """Pairs of a bucket (h, f) in different components that may link by their sketches.

    ``nearest``: of each member outside the bucket's main component and each other component in a cell the nearest only.
    Both sides of a bucket are dealt into blocks of at most ``block`` rows and about ``cell_bytes``, so a task holds two
    blocks of one bucket, and few rows are sent twice.
    """
    known = rows.join(label.select(F.col("id").alias("f"), F.col("component").alias("c")), "f", "left").join(sketch.select("f", "n"), "f").select("h", "f", "n", F.coalesce("c", "f").alias("c"))
    known, n_known = kept(known)
    parts = 1 + n_known // 50_000
    per = known.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).coalesce(parts)
    open_ = per.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("size"), F.max("k").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_c"))
    # a bucket of two has been compared
    open_ = open_.filter("n_c > 1 and size > 2").select("h", "main", "size", F.col("size").alias("k"), (F.col("size") - F.col("most")).alias("minors"), F.greatest(F.lit(8), F.least(F.lit(block), F.ceil(cell_bytes / (64 + F.col("n") / (2 * F.col("size")))))).alias("rows"))
    part = look_up(known, kept(open_.coalesce(parts))[0], ["h"], "k", max(1, n_known)).filter("main is not null").coalesce(parts)
    full = part.join(sketch.select("f", "bits"), "f").withColumn("x_blocks", F.ceil(F.col("minors") / F.col("rows")).cast("int")).withColumn("y_blocks", F.ceil(F.col("size") / F.col("rows")).cast("int"))
    own = lambda n: F.pmod(F.xxhash64("f"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = ["f", "c", "n", "bits"]
    minor = full.filter("c <> main").select("h", own("x_blocks").alias("x"), each("y_blocks").alias("y"), F.lit(True).alias("minor"), *side)
    all_ = full.select("h", each("x_blocks").alias("x"), own("y_blocks").alias("y"), F.lit(False).alias("minor"), *side)

    def compare(xs, ys):
        """Indices into xs and ys of what may link across components, and the distance of the sketches."""
        n, c, f = (np.array([r[i] for r in ys]) for i in (2, 1, 0))
        width = np.array([len(r[3]) for r in ys])
        groups = {w: (at := np.flatnonzero(width == w), np.frombuffer(b"".join(ys[i][3] for i in at), dtype=np.uint8).reshape(len(at), w)) for w in np.unique(width).tolist()}
        folded: dict = {}
        for i, (fx, cx, nx, bits) in enumerate(xs):
            row = np.frombuffer(bits, dtype=np.uint8).reshape(1, -1)
            for w, (at, matrix) in groups.items():
                fit = np.flatnonzero((c[at] != cx) & (f[at] != fx) & (100 * np.minimum(n[at], nx) >= percent * np.maximum(n[at], nx)))
                if not len(fit):
                    continue
                low = min(w, row.shape[1])
                if (w, low) not in folded:
                    folded[w, low] = fold(matrix, low)
                far = np.bitwise_count(folded[w, low][fit] ^ fold(row, low)).sum(axis=1, dtype=np.int64)
                ok = far <= (n[at[fit]] + nx) * (100 - percent) // (100 + percent)
                for j, d in zip(at[fit[ok]].tolist(), far[ok].tolist()):
                    yield i, j, d

    def pairs_of(xs, ys):
        found = list(compare(xs, ys)) if xs and ys else []
        if nearest:
            best: dict = {}
            for i, j, d in found:
                k = (i, ys[j][1])
                best[k] = min(best.get(k, (d, j)), (d, j))
            found = [(i, j, d) for (i, _), (d, j) in best.items()]
        return {(min(xs[i][0], ys[j][0]), max(xs[i][0], ys[j][0])) for i, j, _ in found}

    def run(batches):
        now, xs, ys = None, [], []
        out: set = set()

        def give():
            got = sorted(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64())], ["a", "b"])

        for b in batches:
            for h, x, y, is_minor, *r in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (h, x, y) != now:
                    out.update(pairs_of(xs, ys))
                    now, xs, ys = (h, x, y), [], []
                    if len(out) > 100_000:
                        yield give()
                (xs if is_minor else ys).append(r)
        out.update(pairs_of(xs, ys))
        yield give()

    cells = minor.unionByName(all_).repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")
    return map_arrow(cells, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): links join documents whose shingle sets have Jaccard >= percent / 100.

    A document's number of links isn't given: in a group of thousands it would take a verification of every pair.
    """
    spark = docs.sparkSession
    src = texts(docs, id_col, text_col)
    made, _ = kept(sketch_sets(src, words, percent))
    sets = made.filter("count is null").drop("sig", "count")
    total = sets.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()
    often = made.filter("count is not null").groupBy("sig").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "sig").limit(MOST_COSTS).collect()  # bounded by MOST_COSTS
    costs = Costs([r["sig"] for r in often], [r["count"] for r in often])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["n"] // 4_000_000)
    keys = ["n_shingles", "f1", "f2"]
    classes, _ = kept(sets.filter("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("k")))
    named = classes.select(F.col("f1").alias("f"), "id")
    rows, n_rows = kept(buckets(src.filter("doc_id is not null"), words, percent, parts, costs, max(1000, total["rows"] / (4 * parts))))
    sketch, _ = kept(sets.join(rows.select(F.col("f").alias("f1")).distinct(), "f1", "left_semi").groupBy(F.col("f1").alias("f")).agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits")))

    per = rows.groupBy("h").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("size")).coalesce(1 + n_rows // 50_000)
    star, n_star = kept(look_up(rows, per, ["h"], "size", max(1, n_rows)).filter("f <> a").select("a", F.col("f").alias("b")).coalesce(1 + n_rows // 50_000).distinct())
    tried, n_tried = kept(possible(star, n_star, sketch, percent))
    links, _ = verified(tried, n_tried, named, src, words, percent)
    label, _ = kept(components(links))
    for nearest in (True, False):
        found, n_found = kept(across(rows, label, sketch, percent, nearest))
        more, n_more = kept(found.join(tried, ["a", "b"], "left_anti"))
        linked, n_linked = verified(more, n_more, named, src, words, percent)
        if n_linked:
            label, _ = kept(joined(label, linked))
        if n_found == n_linked:
            break  # every nearest partner links, so what is left apart has no partner
        tried = tried.unionByName(more)
    whole = classes.join(label.coalesce(1 + n_rows // 50_000).select(F.col("id").alias("f1"), "component"), "f1", "left").withColumn("component", F.coalesce("component", "f1"))
    least = whole.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    whole = look_up(whole, least, ["component"], "n", max(1, total["rows"])).select(*keys, "k", "component_id")
    return look_up(sets, whole, keys, "k", max(1, total["rows"])).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
