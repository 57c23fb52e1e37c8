"""Language of a text and of its spans: script ranges, per-word scores and Viterbi with a switching penalty.

Fitting counts letter trigrams and frequent words of a bounded number of labelled documents per language (``per_lang``,
whole texts) as a Spark aggregation. A word's script first narrows the candidates to the languages that are written in
it; the word's score in each is its mean-free log likelihood. Viterbi then finds the best labelling of the words when
each change of language costs ``penalty``. One label throughout is optimal if it has the highest total and no run of
words gains more than half the penalty in another language; only other texts run the full recursion.

Null texts and texts without a letter are ``und`` with score 0. Without any labelled row every text is ``und``.
A text whose letters are all of unknown scripts gets the most frequent learned language and score 0. Ties go to the
language that sorts first. Each row is labelled on its own, repeated rows alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ready, texts


def _letters(last: int) -> re.Pattern:
    """Runs of letters up to a code point: Python's word class without digits, the underscore and other numbers (squares, fractions)."""
    odd = [ord(c) for c in re.findall(r"[^\W\d_]", "".join(map(chr, range(last)))) if not c.isalpha()]
    known = set(odd)
    starts = [c for c in odd if c - 1 not in known]
    ends = [c for c in odd if c + 1 not in known]
    return re.compile("[^\\W\\d_" + "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(starts, ends)) + "]+")


#: The short class is many times faster; texts with characters beyond it take the long one.
WORD, WORD_BEYOND, BEYOND = _letters(0x10000), _letters(0x110000), re.compile("[\U00010000-\U0010FFFF]")


def words_in(text: str) -> list[str]:
    return (WORD_BEYOND if BEYOND.search(text) else WORD).findall(text)


#: The first code point of script ranges and the script that begins there.
SCRIPTS = [(0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Other"), (0xB80, "Tamil"), (0xC00, "Other"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"), (0x32000, "Other")]
_STARTS = np.array([s for s, _ in SCRIPTS])
MEMO, GROUP = 400_000, 256


@lru_cache(maxsize=1 << 16)
def script_of(letter: str) -> str:
    return SCRIPTS[int(np.searchsorted(_STARTS, ord(letter), side="right")) - 1][1]


def word_features(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Model:
    """Log probabilities per feature and language, and each script's languages."""

    def __init__(self, counts: list[tuple[str, str, str, int]], docs_of: dict[str, int], floor: float = -6.0):
        self.langs = sorted(docs_of)
        self.usual = max(self.langs, key=lambda x: (docs_of[x], x)) if self.langs else "und"
        at = {x: i for i, x in enumerate(self.langs)}
        grams: dict[str, np.ndarray] = {}
        words: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for lang, kind, key, n in counts:
            {"g": grams, "w": words, "s": letters}[kind].setdefault(key, np.zeros(len(self.langs)))[at[lang]] += n
        width = len(self.langs)

        def logs(table: dict[str, np.ndarray], alpha: float) -> dict[str, np.ndarray]:
            total = sum(table.values(), np.zeros(width))
            out = {k: np.log((v + alpha) / (total + alpha * (len(table) + 1))) for k, v in table.items()}
            return {k: np.maximum(v - v.max(), floor) for k, v in out.items()}

        self.grams, self.words, self.floor = logs(grams, 0.5), logs({k: v for k, v in words.items() if v.sum() >= 5}, 0.5), floor
        all_letters = sum(letters.values(), np.zeros(width))
        self.of_script = {s: v >= 0.01 * np.maximum(all_letters, 1) for s, v in letters.items() if s != "Other"}

        self.memo = None
        # as matrices, row 0 for what is unknown
        self.gram_row = {g: i + 1 for i, g in enumerate(self.grams)}
        self.word_row = {w: i + 1 for i, w in enumerate(self.words)}
        self.gram_table = np.vstack([np.zeros((1, width)), *self.grams.values()])
        self.word_table = np.vstack([np.zeros((1, width)), *self.words.values()])

    def emissions(self, words: list[str]) -> np.ndarray:
        """Per word one score per language, 0 for the best; all 0 where the script has no language."""
        get, flat, size = self.gram_row.get, [], []
        for w in words:
            p = f"^{w}$"
            flat += [get(p[i : i + 3], 0) for i in range(len(w))]
            size.append(len(w))
        starts = np.cumsum(size) - size
        out = np.add.reduceat(self.gram_table[flat], starts, axis=0)
        get = self.word_row.get
        out += 2 * self.word_table[[get(w, 0) for w in words]]
        scripts = [script_of(w[0]) for w in words]
        names = sorted(set(scripts))
        row = {n: i for i, n in enumerate(names)}
        masks = np.array([self.of_script.get(n, np.zeros(len(self.langs), bool)) for n in names])
        allowed = masks[[row[s] for s in scripts]]
        out = np.where(allowed, out, out.min(axis=1, keepdims=True) + self.floor)
        out = np.maximum(out - out.max(axis=1, keepdims=True), 3 * self.floor)
        out[~allowed.any(axis=1)] = 0
        return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``scores`` when each change of label costs ``penalty``."""
    n, width = scores.shape
    kind = np.min_scalar_type(width)
    back = np.empty((n, width), dtype=kind)
    best = scores[0].tolist()
    rows = scores.tolist()
    for t in range(1, n):
        top = max(best)
        j, change = best.index(top), top - penalty
        row, line = rows[t], []
        nxt = []
        for k in range(width):
            if best[k] >= change:
                nxt.append(best[k] + row[k])
                line.append(k)
            else:
                nxt.append(change + row[k])
                line.append(j)
        back[t] = line
        best = nxt
    out = np.empty(n, dtype=kind)
    out[-1] = best.index(max(best))
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character ranges in ``text`` of the words of its lower-cased form, which may be longer."""
    low = text.lower()
    found = [m.span() for m in (WORD_BEYOND if BEYOND.search(low) else WORD).finditer(low)]
    if len(low) == len(text):
        return found
    at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    return [(int(at[i]), int(at[j - 1]) + 1) for i, j in found]


def label_words(scores: np.ndarray, penalty: float) -> np.ndarray | int:
    """One label if it is optimal throughout, else a label per word.

    Against the label with the highest total, a path gains on its segments and pays per switch. With no run's gain
    over the penalty, q segments inside cost q + 1 switches and at an edge q, more than they gain. A path without the
    label pays q - 1 for q segments, the first a prefix and the last a suffix; so if the best prefix and suffix
    together gain no more than the penalty either, no path is better.
    """
    total = scores.sum(axis=0)
    top = int(total.argmax())
    if len(scores) < 2:
        return top
    run = np.cumsum(scores - scores[:, top : top + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, run.shape[1])), run[:-1]]), axis=0)
    gain = (run - low).max(axis=0)
    gain[top] = 0
    prefix, suffix = np.maximum(run.max(axis=0), 0), np.maximum(run[-1] - run.min(axis=0), 0)
    if gain.max() <= penalty and prefix.max() + suffix.max() <= penalty:
        return top
    use = np.flatnonzero((gain > 0) | (np.arange(len(total)) == top))
    return use[viterbi(scores[:, use], penalty)]


def fit(labelled: DataFrame, per_lang: int = 600, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Count features of about ``per_lang`` labelled documents of each language, chosen by a hash of the id."""
    ready(labelled.sparkSession)
    src = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    docs_of = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not docs_of:
        return Model([], {})
    share = F.lit(0.0)
    for lang, n in docs_of.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_lang / n)).otherwise(share)
    sample = src.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches):
        for b in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen.setdefault(lang, Counter()).update(words_in(text.lower()))
            rows = []
            for lang, words in seen.items():
                out: Counter = Counter()
                for w, n in words.items():
                    for g in word_features(w):
                        out["g", g] += n
                    if n >= 2:
                        out["w", w] += n
                    out["s", script_of(w[0])] += n * len(w)
                rows += [(lang, k, key, n) for (k, key), n in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "kind", "key", "n"])

    counted = map_arrow(sample, run, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).filter("kind <> 'w' or n >= 5")
    return Model([tuple(r) for r in counted.collect()], docs_of)


def identify(docs: DataFrame, model: Model, penalty: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are character ranges with one language each."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        width = max(1, len(model.langs))
        at, table = model.memo or ({}, np.zeros((MEMO, width)))  # kept by the worker from task to task
        for b in batches:
            for first in range(0, len(b), GROUP):
                part = b.slice(first, GROUP)
                group = part.column(1).to_pylist()
                found_words = [words_in(t.lower()) if model.langs else [] for t in group]
                seen: set[str] = set()
                for words in found_words:
                    seen.update(words)
                new = [w for w in seen if w not in at]
                if len(at) + len(new) > len(table):
                    at, new = {}, list(seen)
                    if len(new) > len(table):
                        table = np.zeros((len(new), width))
                if new:
                    table[len(at) : len(at) + len(new)] = model.emissions(new)
                    at.update(zip(new, range(len(at), len(at) + len(new))))
                model.memo = at, table
                preds, scores, spans = [], [], []
                for text, words in zip(group, found_words):
                    if not words:
                        preds.append("und"), scores.append(0.0), spans.append([])
                        continue
                    e = table[list(map(at.__getitem__, words))]
                    if not e.any():
                        preds.append(model.usual), scores.append(0.0), spans.append([])
                        continue
                    found = label_words(e, penalty)
                    total = e.sum(axis=0)
                    if isinstance(found, int):
                        lang, portion = found, 1.0
                        spans.append([{"start": 0, "end": len(text), "lang": model.langs[lang]}])
                    else:
                        size = np.bincount(found, weights=np.fromiter(map(len, words), float, len(words)), minlength=width)
                        lang, portion = int(size.argmax()), float(size.max() / size.sum())
                        where = word_spans(text)
                        edges = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(found)]
                        spans.append([{"start": where[i][0], "end": where[j - 1][1], "lang": model.langs[found[i]]} for i, j in zip(edges, edges[1:])])
                    rest = np.delete(total, lang)
                    margin = float(total[lang] - rest.max()) if len(rest) else 30.0
                    preds.append(model.langs[lang])
                    scores.append(portion / (1 + math.exp(-max(-30.0, min(30.0, margin)))))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    src = texts(docs, id_col, text_col)
    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
