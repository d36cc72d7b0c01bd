"""Token ids in files of shuffled planes.

A file holds the ids of a run of documents. The ids are cut into blocks of a fixed size; a block's ids are transposed
into their four byte planes or 32 bit planes, and each plane is compressed alone, so that the planes of high, mostly equal
bytes take next to nothing. After the blocks come the documents' ids and lengths and the chunk index: for each block
where it begins, how many ids it has and the sizes of its planes. A block can be read without the others.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import job_folder, settled
from .chunks import library_ids
from .common import map_arrow, rows_of

MAGIC = b"PLANES01"
BLOCK_IDS = 65_536
END_ID = 1


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, the lowest first."""
    as_bytes = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [as_bytes[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        as_bytes = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        as_bytes = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(as_bytes).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file: ``add`` documents, then ``close``."""

    def __init__(self, sink, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.sink, self.kind, self.block_ids, self.at = sink, kind, block_ids, len(MAGIC)
        self.press = zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.n_waiting, self.index = 0, []
        self.docs, self.lengths = [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block_ids:
            self._flush(whole_blocks=True)

    def _flush(self, whole_blocks: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        upto = len(ids) // self.block_ids * self.block_ids if whole_blocks else len(ids)
        for k in range(0, upto, self.block_ids):
            block = ids[k : min(k + self.block_ids, upto)]
            planes = [self.press.compress(p) for p in to_planes(block, self.kind)]
            self.index.append((self.at, len(block), [len(p) for p in planes]))
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
        self.waiting, self.n_waiting = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> None:
        if self.n_waiting:
            self._flush(whole_blocks=False)
        foot = io.BytesIO()
        foot.write(struct.pack("<qqq", len(self.index), 4 if self.kind == "byte" else 32, len(self.docs)))
        for at, n, sizes in self.index:
            foot.write(struct.pack(f"<qq{len(sizes)}i", at, n, *sizes))
        foot.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        foot.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        foot.write(np.array(self.lengths, "<i8").tobytes())
        packed = self.press.compress(foot.getvalue())
        self.sink.write(packed + struct.pack("<q", len(packed)) + MAGIC)


class PlaneReader:
    """Reads a file of ``PlaneWriter``; ``blocks`` one after the other or ``block`` any one."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of planes, or a torn one")
        (n,) = struct.unpack("<q", tail[:8])
        foot = zstandard.ZstdDecompressor().decompress(self._at(size - 16 - n, n))
        n_blocks, n_planes, n_docs = struct.unpack_from("<qqq", foot)
        at, step = 24, 16 + 4 * n_planes
        self.index = [(x[0], x[1], x[2:]) for x in struct.iter_unpack(f"<qq{n_planes}i", foot[at : at + step * n_blocks])]
        at += step * n_blocks
        there = np.frombuffer(foot, np.uint8, n_docs, at)
        ids = np.frombuffer(foot, "<i8", n_docs, at + n_docs)
        self.docs = [int(d) if t else None for d, t in zip(ids, there)]
        self.lengths = np.frombuffer(foot, "<i8", n_docs, at + 9 * n_docs)

    def _at(self, begin: int, n: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index[k]
        raw, planes, unpress = self._at(at, sum(sizes)), [], zstandard.ZstdDecompressor()
        for s in sizes:
            planes.append(unpress.decompress(raw[:s]))
            raw = raw[s:]
        return from_planes(planes, n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.empty(0, "<u4"), 0
        at = 0
        for doc_id, n in zip(self.docs, self.lengths):
            if len(held) - at < n:
                parts, have = [held[at:]], len(held) - at
                while have < n:
                    parts.append(self.block(k))
                    have += len(parts[-1])
                    k += 1
                held, at = np.concatenate(parts), 0
            yield doc_id, held[at : at + n]
            at += n


def write_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, kind: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every whole text, append the end id, and write the ids in files by ascending doc_id.

    One range of doc_ids makes one file. Returns the files: path, file_no, n_ids. A file's name is its attempt's own, so a
    task that runs twice leaves a file that no row names. Null and empty texts hold the end id alone; null doc_ids come
    first; repeated rows are written each. An empty table makes no file. Other columns aren't read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library_ids(vocabulary, spaced=False)
        end = np.array([end_id], "<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        sink = writer = None
        total = 0
        for batch in batches:
            for doc_id, ids in zip(rows_of(batch, "doc_id"), chunks.of(rows_of(batch, "text"))):
                if writer is None:
                    sink = store.open_output_stream(f"{base}/{name}")
                    writer = PlaneWriter(sink, kind, block_ids)
                ids = b"".join(ids) + end
                writer.add(doc_id, ids)
                total += len(ids) // 4
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "file_no": pa.array([part], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return settled(map_arrow(ordered, ["doc_id", "text"], work, "path string, file_no long, n_ids long"))


def read_files(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32. The window runs over one row a file."""
    starts = files.withColumn("first", F.sum("n_ids").over(Window.orderBy("file_no")) - F.col("n_ids"))
    spread = starts.repartition(max(1, starts.sparkSession.sparkContext.defaultParallelism * 2), "file_no")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(rows_of(batch, "path"), rows_of(batch, "first")):
                store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                rows: list[tuple] = []
                with store.open_input_file(at) as source:
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        first += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(spread, ["path", "first"], work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, vocabulary: str, kind: str = "byte") -> DataFrame:
    folder = job_folder(docs.sparkSession, "planes", uuid.uuid4().hex)
    return read_files(write_files(docs, vocabulary, folder, kind=kind))
