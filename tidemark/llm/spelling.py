"""Spelling variants: words one edit apart, found by pivotal grams, and the frequent form that each points to.

An edit touches at most one of two disjoint bigrams. Each word takes as pivots the cheapest disjoint pair, chosen by
dynamic programming, among its rarest bigrams, the gram prefix. If two words are one edit apart, a pivot of the one whose
prefix ends earlier in the order of rarity lies in the other's prefix, moved by no more than the edit moves it. So pivots
are joined with the prefixes of other words on gram, position and both lengths; as an edit also spares the words' first
half or their last, a key holds that half too, and a gram that many words have in one place doesn't bring them all
together. What meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, map_arrow, texts

#: Letters of words, after A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
SEGMENT = 1 << 20
#: Changes of position and of length that one edit makes to a bigram that it spares.
MOVES = ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1))


def word_counts(docs: DataFrame, least_length: int = 6, every: int = 199) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points with their occurrences over all texts.

    Where crc32 of ``<doc_id>:<run>`` is a multiple of ``every``, the run loses the code point at that crc modulo its length.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least_length},}}")
    gap = re.compile(f"[^{LETTERS}]")

    def give(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches):
        total: dict[str, int] = {}
        size = 0
        for b in batches:
            for id_, text in zip(b.column(0).to_pylist(), pc.ascii_lower(b.column(1))):
                text, start = text.as_py(), zlib.crc32(f"{id_}:".encode())
                at = 0
                while at < len(text):  # very long texts in segments that end between words
                    cut_at = gap.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
                    stop = cut_at.start() if cut_at else len(text)
                    for word, n in Counter(run_of.findall(text, at, stop)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1 :]
                            if len(word) < least_length:
                                continue
                        if word in total:
                            total[word] += n
                        else:
                            total[word] = n
                            size += 80 + 2 * len(word)
                    at = stop
                    if size > 48 << 20:
                        yield give(total)
                        total, size = {}, 0
        yield give(total)

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return map_arrow(named, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def disjoint_pair(grams: list[tuple[int, int]]) -> list[int]:
    """Positions of two bigrams that don't overlap with the least summed rank, of (position, rank) in order of positions.

    ``best[i]`` is the cheapest of the grams up to the i-th; a pair is a gram and the best of those that end before it.
    """
    best: list[tuple[int, int]] = []
    pair, j = None, 0
    for at, rank in grams:
        while j < len(best) and grams[j][0] + 2 <= at:
            j += 1
        if j:
            found = (best[j - 1][0] + rank, best[j - 1][1], at)
            pair = min(pair, found) if pair else found
        best.append(min(best[-1], (rank, at)) if best else (rank, at))
    return [pair[1], pair[2]]


def _keys(gram: int, at: int, word: str, other: int, own_first: bool):
    """Hashes of a gram's place together with the half of ``word`` that an edit to a word of ``other`` code points may spare."""
    n = len(word)
    low = min(n, other)
    head, lengths = low // 2, (n, other) if own_first else (other, n)
    for kind, half in ((0, word[:head]), (1, word[n - (low - head) :])):
        yield xxhash.xxh64_intdigest(f"{gram} {at} {lengths[0]} {lengths[1]} {kind} {half}".encode()) - (1 << 63)


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), a < b: all pairs of ``words`` (word, n), distinct and of at least four code points, that are one edit apart.

    The order of grams is by the number of words that hold them; it is a table of as many rows as there are pairs of letters.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
    held = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rank = {r["gram"]: i for i, r in enumerate(sorted(held.collect(), key=lambda r: (r["n"], r["gram"])))}  # letters squared

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                rows = []
                for word, n in zip(b.column(0).slice(i, 2000).to_pylist(), b.column(1).slice(i, 2000).to_pylist()):
                    size = len(word)
                    order = sorted((rank[word[k : k + 2]], k) for k in range(size - 1))
                    last = order[2][0]
                    first = [x for x in order if x[0] <= last]
                    for at in disjoint_pair(sorted((k, g) for g, k in order[:3])):
                        gram = rank[word[at : at + 2]]
                        for move, longer in MOVES:
                            if at + move >= 0 and at + move + 2 <= size + longer:
                                rows += [(key, True, word, n, last) for key in _keys(gram, at + move, word, size + longer, True)]
                    for gram, at in first:
                        for other in (size - 1, size, size + 1):
                            rows += [(key, False, word, n, last) for key in _keys(gram, at, word, other, False)]
                kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "pivot", "word", "n", "last"])

    rows = map_arrow(words.select("word", "n"), run, "key bigint, pivot boolean, word string, n bigint, last int")
    rows = cut(rows)
    one = rows.filter("pivot").select("key", F.col("word").alias("w"), F.col("n").alias("wn"), F.col("last").alias("wl"))
    two = rows.filter("not pivot").select("key", F.col("word").alias("x"), F.col("n").alias("xn"), F.col("last").alias("xl"))
    met = one.join(two, "key").filter((F.col("w") != F.col("x")) & (F.col("wl") <= F.col("xl")) & (F.levenshtein("w", "x", 1) == 1))
    less = F.col("w") < F.col("x")
    return met.select(F.least("w", "x").alias("a"), F.when(less, F.col("wn")).otherwise(F.col("xn")).alias("na"), F.greatest("w", "x").alias("b"), F.when(less, F.col("xn")).otherwise(F.col("wn")).alias("nb")).distinct()


def roots(forms: DataFrame, limit: int = 64) -> DataFrame:
    """(word, root): the last word of each chain of ``forms`` (word, form), which has no cycle; every round halves the way."""
    to, n = kept(forms.select("word", F.col("form").alias("root")))
    for _ in range(limit if n else 0):
        step = to.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        further = to.join(step, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved"))
        further, _ = kept(further)
        moved = further.filter("_moved").count()
        to = further.drop("_moved")
        if not moved:
            break
    return to


def variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199, times: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least_length`` letters and ``least_n`` occurrences.

    A word's form is its near word of the largest n, ties to the first in code-point order, if that n is at least ``times``
    its own. A null text counts as empty and a null id as an empty one; repeated rows count as often as they occur; extra
    columns are ignored; texts are read whole, very long ones in segments; without words there are no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words, _ = kept(word_counts(texts(docs), least_length, every).filter(F.col("n") >= least_n))
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("x"), F.col("nb").alias("xn")).unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("x"), F.col("na").alias("xn")))
    best = F.min(F.struct((-F.col("xn")).alias("neg"), F.col("x").alias("form"))).alias("best")
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    fits = -F.col("best.neg") >= F.col("n") * times
    near, _ = kept(near.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.neg")).alias("form_n")))
    root = roots(near.filter("form is not null"))
    out = words.join(near, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
