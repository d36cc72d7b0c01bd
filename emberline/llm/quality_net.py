"""Quality by a byte-level convolutional network, in numpy.

A text's bytes are cut into chunks of ``CHUNK`` bytes, each overlapping the one before; the last one ends with the text, so
every byte is read. Each byte has a learned embedding; learned filters run over a chunk and each keeps its highest
response there. The mean and the highest of these over all chunks of the text go through a small layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, in_one_task, map_arrow, rows_of

CHUNK, STEP = 512, 448
DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 12, 2, 24, 16
#: At most so many labelled texts of each class are fetched to fit the network, and so many evenly spread chunks of each.
SAMPLE, SAMPLE_CHUNKS = 1500, 6
#: While fitting, so many of the texts stand in as a short piece of themselves: few labelled texts are short.
SHORT_SHARE, SHORT_BYTES = 0.3, (16, 240)
THRESHOLD = 0.5
_SLICE = 256


def chunk_starts(n: int) -> list[int]:
    """Where chunks begin in a text of ``n`` bytes: one every ``STEP``, and one that ends with the text."""
    return [0] if n <= CHUNK else [*range(0, n - CHUNK, STEP), n - CHUNK]


def chunks_of(texts: list[bytes], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts, shorter texts filled up with zero bytes, and how many chunks each text has. ``most`` is for
    fitting only: so many evenly spread ones."""
    starts = [chunk_starts(len(t)) for t in texts]
    if most:
        starts = [[s[k] for k in np.unique(np.linspace(0, len(s) - 1, most).astype(int))] for s in starts]
    counts = np.array([len(s) for s in starts])
    out = np.zeros((counts.sum(), CHUNK), np.uint8)
    k = 0
    for t, own in zip(texts, starts):
        whole = np.frombuffer(t, np.uint8)
        for s in own:
            part = whole[s : s + CHUNK]
            out[k, : len(part)] = part
            k += 1
    return out, counts


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        scaled = lambda n, *s: (r.standard_normal(s) / np.sqrt(n)).astype(np.float32)
        self.p = {
            "embed": scaled(2, 256, DIM), "filters": scaled(WIDTH * DIM, WIDTH * DIM, FILTERS), "shift": np.zeros(FILTERS, np.float32),
            "dense": scaled(2 * FILTERS, 2 * FILTERS, HIDDEN), "dense_b": np.zeros(HIDDEN, np.float32), "out": scaled(HIDDEN, HIDDEN), "bias": np.zeros(1, np.float32),
        }

    def _spans(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, position, WIDTH * DIM): the embedded bytes under a filter at each of its positions."""
        e = np.ascontiguousarray(self.p["embed"][chunks])
        places = (CHUNK - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(e, (len(e), places, WIDTH * DIM), (e.strides[0], STRIDE * e.strides[1], e.strides[2]))

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's highest response in each chunk, and where it is."""
        top, where = [], []
        for k in range(0, len(chunks), _SLICE):
            spans = self._spans(chunks[k : k + _SLICE])
            z = spans.reshape(-1, WIDTH * DIM) @ self.p["filters"]
            z = z.reshape(spans.shape[0], spans.shape[1], FILTERS)
            where.append(z.argmax(axis=1))
            top.append(np.take_along_axis(z, where[-1][:, None], axis=1)[:, 0])
        return np.maximum(np.concatenate(top) + self.p["shift"], 0), np.concatenate(where)

    def heights(self, chunks: np.ndarray) -> np.ndarray:
        """As ``pooled`` without the places."""
        top = []
        for k in range(0, len(chunks), _SLICE):
            spans = self._spans(chunks[k : k + _SLICE])
            z = spans.reshape(-1, WIDTH * DIM) @ self.p["filters"]
            top.append(z.reshape(spans.shape[0], spans.shape[1], FILTERS).max(axis=1))
        return np.maximum(np.concatenate(top) + self.p["shift"], 0)

    @staticmethod
    def combined(top: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.concatenate([np.add.reduceat(top, first) / counts[:, None], np.maximum.reduceat(top, first)], axis=1).astype(np.float32)

    def logits(self, features: np.ndarray) -> np.ndarray:
        return np.maximum(features @ self.p["dense"] + self.p["dense_b"], 0) @ self.p["out"] + self.p["bias"][0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        chunks, counts = chunks_of(raw)
        return 1 / (1 + np.exp(-self.logits(self.combined(self.heights(chunks), counts)).astype(np.float64)))

    def gradients(self, chunks: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        top, where = self.pooled(chunks)
        x = self.combined(top, counts)
        a = np.maximum(x @ self.p["dense"] + self.p["dense_b"], 0)
        d = ((1 / (1 + np.exp(-(a @ self.p["out"] + self.p["bias"][0]))) - label) * weight / len(label)).astype(np.float32)
        da = np.outer(d, self.p["out"]) * (a > 0)
        dx = da @ self.p["dense"].T
        owner = np.repeat(np.arange(len(counts)), counts)
        is_top = top == x[owner, FILTERS:]
        dtop = (dx[owner, :FILTERS] / counts[owner, None] + dx[owner, FILTERS:] * is_top) * (top > 0)
        row, filt = np.nonzero(dtop)
        pull = dtop[row, filt].astype(np.float32)
        bytes_at = chunks[row[:, None], where[row, filt][:, None] * STRIDE + np.arange(WIDTH)]
        spans = self.p["embed"][bytes_at].reshape(len(row), -1)
        g = {"dense": x.T @ da, "dense_b": da.sum(axis=0), "out": a.T @ d, "bias": d.sum(keepdims=True), "shift": dtop.sum(axis=0)}
        g["filters"] = np.stack([(spans * (pull * (filt == f))[:, None]).sum(axis=0) for f in range(FILTERS)], axis=1)
        dspan = (pull[:, None] * self.p["filters"].T[filt]).reshape(-1, DIM)
        flat = bytes_at.reshape(-1)
        g["embed"] = np.stack([np.bincount(flat, dspan[:, k], 256) for k in range(DIM)], axis=1)
        return g


def fit(texts: list[list[bytes]], labels: np.ndarray, seed: int = 5, epochs: int = 12, rate: float = 0.004) -> Network:
    """Train on texts given as their chunks. With one class only the network says that class."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        net.p["out"][:] = 0
        net.p["bias"][0] = 3.0 if not len(texts) or labels.max() == 1 else -3.0
        return net
    weights = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum()))
    padded = [np.stack([np.frombuffer(c.ljust(CHUNK, b"\0"), np.uint8) for c in t]) for t in texts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def shortened(chunks: np.ndarray) -> np.ndarray:
        own, piece = chunks[rng.integers(len(chunks))], np.zeros((1, CHUNK), np.uint8)
        n = int(np.count_nonzero(own))
        most = min(n, int(rng.integers(*SHORT_BYTES)))
        begin = int(rng.integers(0, n - most + 1))
        piece[0, :most] = own[begin : begin + most]
        return piece

    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 48)):
            step += 1
            shown = [shortened(padded[k]) if rng.random() < SHORT_SHARE else padded[k] for k in batch]
            g = net.gradients(np.concatenate(shown), np.array([len(s) for s in shown]), labels[batch], weights[batch])
            for k, v in g.items():
                m, s = moments[k]
                m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
                moments[k] = (m, s)
                net.p[k] = (net.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def sample(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled texts of each class that are not held out, the first by a hash of the id."""
    seen = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col(column).cast("int").alias("label")).distinct()
    pick = [seen.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Network:
    """Fit on a bounded sample of ``bound`` texts a class, ``SAMPLE_CHUNKS`` chunks each, in one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows_of(batch, "text")]
            chunks, counts = chunks_of(raw, SAMPLE_CHUNKS)
            flat, ends = [c.tobytes().rstrip(b"\0") for c in chunks], np.cumsum(counts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "label": batch.column(2), "chunks": pa.array([flat[e - n : e] for e, n in zip(ends, counts)], pa.list_(pa.binary()))})

    def fitted(rows: list[dict]) -> Network:
        rows.sort(key=lambda r: (r["doc_id"], r["chunks"]))
        return fit([r["chunks"] for r in rows], np.array([r["label"] for r in rows], np.float64) if rows else np.zeros(0))

    return in_one_task(map_arrow(sample(docs, labels, "quality", bound), ["doc_id", "text", "label"], cut, "doc_id long, label int, chunks array<binary>"), fitted)


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Per row doc_id, held_out, score, predicted.

    Null and empty texts are one chunk of zero bytes and score as the network scores that. Repeated rows score alike, null
    doc_ids stay null and count as not held out. An empty table gives no rows. Only doc_id and text are read, and doc_id
    is no input of the score.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = rows_of(batch, "text")
            found = [net.scores(texts[k : k + 128]) for k in range(0, len(texts), 128)]
            if found:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": np.concatenate(found).round(6)})

    scored = map_arrow(docs, ["doc_id", "text"], work, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores ``threshold`` or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = rows_of(batch, "text")
            found = [net.scores(texts[k : k + 128]) for k in range(0, len(texts), 128)]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return docs.mapInArrow(work, docs.schema)
