"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as two parallel arrays: its part ids (one boundary per part) and the rank of each adjacent pair. The
smallest rank is found by a scan, its boundary is deleted and the two neighbouring ranks are refreshed. The scan is
quadratic, so longer words use a heap over a linked list with the same merge order.

Texts are cut at white space; the ids of a chunk are kept in a two-generation memo of bounded size, so a frequent
chunk is merged once per worker. New words of up to ``LONG`` bytes are merged together, as flat arrays with one span
per word. Texts whose white space makes chunks depend on their neighbours take the full
pattern. Null texts count as empty; empty texts have no ids. Each row is coded on its own, repeated rows alike; no rows
give no rows, and extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, texts

LONG, MEMO, GROUP = 64, 450_000, 256
NO_RANK = 1 << 40
#: The split patterns of the two public vocabularies. The characters FS, GS, RS and US aren't white space in them.
SPACE = r"[\t-\r \x85\xa0  -     　]"
NON_SPACE = SPACE.replace("[", "[^")
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?" + SPACE.replace("[", r"[^\p{L}\p{N}") + "+|" + SPACE + "+(?!" + NON_SPACE + ")|" + SPACE + "+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|" + SPACE.replace("[", r"[^\p{L}\p{N}") + "+")
UNSAFE = regex.compile(r"\s\s|^\s|\s$|[\x1c-\x1f]")
ODD_STOP = re.compile(r"[,.](?:(?<=[\W_].)|(?<=^.))")
CONTROLS = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_parts(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Merge the parts of one word; ``pairs`` maps ``left << 20 | right`` to (rank, merged id)."""
    if len(ids) > LONG:
        return _merge_long(ids, pairs)
    none = (NO_RANK, -1)
    get = pairs.get
    ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
    while ranks:
        best = min(ranks)
        if best is none:
            break
        i = ranks.index(best)
        ids[i] = best[1]
        del ids[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        if i < len(ranks):
            ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
    return ids


def _merge_long(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    n = len(ids)
    after, before, part = [*range(1, n + 1)], [*range(-1, n - 1)], list(ids)
    heap = [(pairs[k][0], i, k) for i in range(n - 1) if (k := ids[i] << 20 | ids[i + 1]) in pairs]
    heapq.heapify(heap)
    while heap:
        _, i, key = heapq.heappop(heap)
        j = after[i]
        if part[i] < 0 or j >= n or part[i] << 20 | part[j] != key:
            continue
        part[i], part[j] = pairs[key][1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            k = part[i] << 20 | part[after[i]]
            if k in pairs:
                heapq.heappush(heap, (pairs[k][0], i, k))
        if before[i] >= 0:
            k = part[before[i]] << 20 | part[i]
            if k in pairs:
                heapq.heappush(heap, (pairs[k][0], before[i], k))
    return [p for p in part if p >= 0]


def merge_words(parts: np.ndarray, n: np.ndarray, table: PairTable) -> list[bytes]:
    """Merge many short words at once. ``parts`` holds all words one after another, ``n`` parts each.

    A rank stands at each part for the pair that it begins. Each round finds every word's smallest (leftmost) rank,
    deletes that boundary and refreshes the two ranks beside it; words without a mergeable pair leave.
    """
    out: list[bytes] = [b""] * len(n)
    who = np.flatnonzero(n)
    n = n[who].astype(np.int64)
    last = np.cumsum(n) - 1
    ranks = table.ranks(parts, np.append(parts[1:], -1))
    ranks[last] = NO_RANK
    while len(who):
        starts = np.cumsum(n) - n
        best = np.minimum.reduceat(ranks, starts)
        stop = best == NO_RANK
        if stop.any():
            gone = np.repeat(stop, n)
            raw, at = parts[gone].astype("<u4").tobytes(), 0
            for i, k in zip(who[stop].tolist(), (n[stop] * 4).tolist()):
                out[i] = raw[at : at + k]
                at += k
            keep = ~stop
            who, n, best, parts, ranks = who[keep], n[keep], best[keep], parts[~gone], ranks[~gone]
            if not len(who):
                break
            starts = np.cumsum(n) - n
        hits = np.flatnonzero(ranks == np.repeat(best, n))
        at = hits[np.searchsorted(hits, starts)]
        parts[at] = table.merged[best]
        keep = np.ones(len(parts), dtype=bool)
        keep[at + 1] = False
        parts, ranks = parts[keep], ranks[keep]
        moved = np.arange(len(n))
        at, starts, n = at - moved, starts - moved, n - 1
        final = at == starts + n - 1
        ranks[at] = np.where(final, NO_RANK, table.ranks(parts[at], parts[np.minimum(at + 1, len(parts) - 1)]))
        left = at[at > starts]
        ranks[left - 1] = table.ranks(parts[left - 1], parts[left])
    return out


class PairTable:
    """Rank of each mergeable pair, found by its key in a sorted array."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        keys = np.array(sorted(pairs), dtype=np.int64)
        rank = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64)
        self.merged = np.empty(len(rank), dtype=np.int64)
        self.merged[rank] = [pairs[k][1] for k in keys.tolist()]
        bits = max(12, len(keys).bit_length() + 3)
        self.shift, size = 64 - bits, 1 << bits
        self.key, self.rank = np.full(size, -1, dtype=np.int64), np.full(size, NO_RANK, dtype=np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):  # keys that meet move to the next slot
            self.probes += 1
            free = self.key[at] == -1
            first = np.unique(np.where(free, at, -1), return_index=True)[1]
            put = first[free[first]]
            self.key[at[put]], self.rank[at[put]] = keys[left[put]], rank[left[put]]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = np.where(b < 0, -2, a << 20 | b)
        at = self._slot(keys)
        seen = self.key[at]
        found = np.where(seen == keys, self.rank[at], NO_RANK)
        miss = np.flatnonzero((seen != keys) & (seen != -1))
        for step in range(1, self.probes):
            if not len(miss):
                break
            at2 = (at[miss] + step) & (len(self.key) - 1)
            seen = self.key[at2]
            hit = seen == keys[miss]
            found[miss[hit]] = self.rank[at2[hit]]
            miss = miss[~hit & (seen != -1)]
        return found


class Memo:
    """At most two generations of ``size`` entries and about ``letters`` letters, but for one call's; what is in use moves to the young one."""

    def __init__(self, size: int = MEMO, letters: int = 8_000_000):
        self.size, self.letters, self.held, self.young, self.old = size, letters, 0, {}, {}

    def missing(self, keys: set) -> list:
        """The keys without a value; all others are in the young generation afterwards."""
        if len(self.young) + len(keys) > self.size or self.held > self.letters:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, out = self.young, self.old, []
        for k in keys:
            if k in young:
                continue
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                young[k] = v
        self.held += sum(map(len, out))
        return out


class Bpe:
    """A vocabulary file with its merge table; a vocabulary with an end mark lower-cases and drops white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.table = PairTable(self.pairs)
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[letters[b] + self.end] for b in range(256)], dtype=np.int64)
        back = {c: b for b, c in letters.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            body = token.removesuffix(self.end) if self.end else token
            self.bytes_of[i] = bytes(back[c] for c in body) if all(c in back for c in body) else body.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(size)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = WORD_PATTERN if self.end else BYTE_PATTERN
        self.word, self.chunk = Memo(), Memo()

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text whose ids don't depend on their neighbours."""
        if not text:
            return []
        if self.end:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if CONTROLS.search(text):
                return self.pattern.findall(text)
            if not ODD_STOP.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
            return text.split()
        if UNSAFE.search(text) or "\0" in text:
            return self.pattern.findall(text)
        odd = ODD_STOP.search(text)
        text = text.replace(" ", "\0 ")
        if not odd:
            text = text.replace(",\0", "\0,\0").replace(".\0", "\0.\0")
        return text.split("\0")

    def learn(self, chunks: set[str]) -> None:
        """Find the ids of all chunks that the memo lacks; a chunk that is one word is merged straight away."""
        new = self.chunk.missing(chunks)
        if not new:
            return
        split = {c: ws for c in new if not ((c[1:] if c[0] == " " else c).isalpha() and c.isascii()) and ((ws := self.pattern.findall(c)) != [c])}
        fresh = [c for c in new if c not in split]
        also = self.word.missing({w for ws in split.values() for w in ws}) if split else []
        chunk, word = self.chunk.young, self.word.young
        for target, found in ((chunk, fresh), (word, also)):
            raws = [w.encode() for w in found]
            n = np.array([len(r) for r in raws], dtype=np.int64)
            flat = np.frombuffer(b"".join(raws), dtype=np.uint8)
            parts = self.first[flat]
            if self.end and len(n):
                ends = np.cumsum(n) - 1
                parts[ends] = self.last[flat[ends]]
            if (n > LONG).any():
                at = np.cumsum(n) - n
                for i in np.flatnonzero(n > LONG):
                    target[found[i]] = np.array(merge_parts(parts[at[i] : at[i] + n[i]].tolist(), self.pairs), dtype="<u4").tobytes()
                short = n <= LONG
                found, parts, n = [w for w, s in zip(found, short) if s], parts[np.repeat(short, n)], n[short]
            target.update(zip(found, merge_words(parts, n, self.table)))
        for c, ws in split.items():
            chunk[c] = b"".join([word[w] for w in ws])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit numbers; special tokens in a text become their ids."""
        out: list[bytes] = []
        for i in range(0, len(texts), GROUP):
            split = [self._chunks(t) for t in texts[i : i + GROUP]]
            seen: set[str] = set()
            for s in split:
                seen.update(s)
            seen.difference_update(self.special)
            self.learn(seen)
            get = self.chunk.young | {s: np.array([k], dtype="<u4").tobytes() for s, k in self.special.items()} if any(x in s for x in self.special for s in split) else self.chunk.young
            out.extend(b"".join(map(get.__getitem__, s)) for s in split)
        return out

    def _chunks(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return self.chunks(text)
        return [c for x in self.split.split(text) for c in ([x] if x in self.special else self.chunks(x))]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Bytes of all ids, joined; what isn't UTF-8 becomes the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            ids = [np.frombuffer(x, dtype="<u4").astype("i4") for x in bpe.encode_many(b.column(1).to_pylist())]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    src = texts(docs, id_col, text_col)
    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    src = encoded.select("doc_id", "ids")
    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; per document n_tokens and digests of the ids and of the decoded text."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            n, a, d = [], [], []
            for i in range(0, len(b), GROUP):
                for raw in bpe.encode_many(b.column(1).slice(i, GROUP).to_pylist()):
                    ids = np.frombuffer(raw, dtype="<u4").tolist()
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    d.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = texts(docs, id_col, text_col)
    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
