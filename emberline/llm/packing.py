"""Harmonic packing of token sequences.

The classes are the reciprocals of the capacity, 1/1, 1/2, 1/4, ...: a class of share 1/j takes pieces of capacity/j
tokens and its bins hold exactly j pieces. Documents may be cut, so a document is first cut into pieces that fill
their class's slot exactly: as many whole bins as it has, then the binary digits of the rest. Every worker fills its own
bins, class by class, without talking to others. What is left in a worker's last bins is cut into sequences of a
power-of-two length. Nothing is padded while the shares are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .alignment import ByteLevel
from .common import map_arrow, rows_of

CAPACITY = 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FIELDS = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])


def slots(capacity: int) -> list[int]:
    """Piece lengths of the classes, the largest first. The capacity must be a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    return [capacity >> k for k in range(capacity.bit_length())]


def cuts(n_tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document: whole bins, then the binary digits of the rest."""
    rest = n_tokens % capacity
    return [capacity] * (n_tokens // capacity) + [s for s in slots(capacity)[1:] if rest & s]


class Bins:
    """A worker's open bins, one for each class. A bin's pieces leave together when it is full, or at the end."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next_id = capacity, worker << 40
        self.open: dict[int, list[tuple]] = {s: [] for s in slots(capacity)}
        self.out: list[tuple] = []

    def add(self, length: int, piece: tuple) -> None:
        held = self.open[length]
        held.append(piece)
        if len(held) * length == self.capacity:
            self._close(held, length)
            self.open[length] = []

    def _close(self, pieces: list[tuple], length: int) -> None:
        self.out += [(*p, self.next_id, k * length) for k, p in enumerate(pieces)]
        self.next_id += 1

    def finish(self) -> None:
        for length, held in self.open.items():
            while held:
                n = 1 << (len(held).bit_length() - 1)
                self._close(held[:n], length)
                held = held[n:]


_LOADED: dict[tuple, ByteLevel] = {}


def _loaded(path: str, pattern: str) -> ByteLevel:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteLevel(path, pattern, special=True)
    return _LOADED[path, pattern]


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Ids by a byte-level vocabulary file whose library splits by ``pattern``: every token of every document in exactly one piece, each piece in one sequence, with its place there and its ids as
    little-endian unsigned 32-bit bytes: a sequence is the ids of its pieces in the order of ``offset``. ``ids_crc32`` is theirs.

    Null and empty texts are one piece, the end id alone. Repeated rows are packed each for itself; a null doc_id stays
    null. An empty table gives no rows. Of other columns none is read. ``sequence_id`` holds the worker's number in its
    high bits. One pass over the documents without a shuffle; a worker holds fewer than ``capacity`` pieces a class.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(vocabulary, pattern)
        end = np.array([END_ID], "<u4").tobytes()
        bins = Bins(TaskContext.get().partitionId(), capacity)

        def taken() -> pa.RecordBatch:
            rows, bins.out = bins.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

        for batch in batches:
            for doc_id, found in zip(rows_of(batch, "doc_id"), encoder.ids([t or "" for t in rows_of(batch, "text")])):
                ids = np.array(found, "<u4").tobytes() + end
                start, n = 0, len(ids) // 4
                for length in cuts(n, capacity):
                    bins.add(length, (doc_id, start, length, ids[4 * start : 4 * (start + length)], n))
                    start += length
            if bins.out:
                yield taken()
        bins.finish()
        if bins.out:
            yield taken()

    packed = map_arrow(docs, ["doc_id", "text"], work, SCHEMA)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
