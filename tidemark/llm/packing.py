"""Bounded-space online best-fit packing of token sequences.

Pieces are placed one by one: the open bin with the least free space that still holds the piece takes it. Open bins
are kept in lists keyed by free space, and an integer has one bit per key that has an open bin, so the best fit is
the lowest set bit at or above the piece's length. When the fixed number of open bins is reached, the fullest closes.

Documents are tokenised in one pass that keeps piece metadata only; only documents longer than a sequence are cut.
The metadata, a few dozen bytes a piece, is dealt out by a hash in shares of about ``share`` pieces, and each share
is packed on its own, so no task sees more than a share however large the corpus is. A share is taken in hashed
blocks of about as many pieces as bins may be open, each block longest pieces first: short pieces keep arriving, so
few bins close part empty. Null and empty texts are one piece that holds the end id alone; repeated rows are packed
as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import GROUP, load
from .common import cut, map_arrow, texts


class OpenBins:
    """At most ``limit`` open bins of ``size``, found by free space through a bitset."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.open, self.made = size, limit, 0, 0
        self.bits, self.by_free = 0, [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def _put(self, number: int, free: int) -> None:
        if free:
            self.by_free[free].append(number)
            self.bits |= 1 << free
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.size, self.made
            self.made += 1
        self._put(number, free - length)
        return number, self.size - free


def pack(lengths: Iterable[int], size: int, limit: int) -> list[tuple[int, int]]:
    bins = OpenBins(size, limit)
    return [bins.place(n) for n in lengths]


def pieces(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text."""

    def run(batches):
        bpe, tail = load(path), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for i in range(0, len(b), GROUP):
                part = b.slice(i, GROUP)
                rows, piece, start, length, crc = [], [], [], [], []
                for k, raw in enumerate(bpe.encode_many(part.column(1).to_pylist())):
                    raw = memoryview(raw + tail)
                    for j, at in enumerate(range(0, len(raw), size * 4)):
                        one = raw[at : at + size * 4]
                        rows.append(k), piece.append(j), start.append(at // 4), length.append(len(one) // 4), crc.append(zlib.crc32(one))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = texts(docs, id_col, text_col)
    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(items: DataFrame, size: int = 4096, limit: int = 256, share: int = 200_000) -> DataFrame:
    """Add (sequence_id, offset) to rows with a ``length`` of 1 to ``size``; sequences are gapless from 0."""
    items = cut(items)
    rows = items.count()
    parts = max(1, -(-rows // share))
    blocks = max(1, -(-rows // (parts * limit)))
    keys = [c for c in items.columns if c != "length"]
    dealt = items.repartition(parts, F.xxhash64(*keys), F.col("length")).sortWithinPartitions(F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(blocks)), F.desc("length"), *keys)
    fields = items.columns
    at = fields.index("length")

    def run(batches):
        from pyspark import TaskContext

        bins, base = OpenBins(size, limit), TaskContext.get().partitionId() << 40
        for b in batches:
            placed = [bins.place(n) for n in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*fields, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return map_arrow(dealt, run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, limit: int = 256, share: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack whole documents; one row per piece with its place."""
    return best_fit(pieces(docs, path, size, end_id, id_col, text_col), size, limit, share)
