"""Hard negatives by a BOND vertical scan.

Vectors lie in blocks of columns: all values of one dimension of a block side by side, with each dimension's least and greatest. An
anchor reads the dimensions in the order of its own magnitudes, the largest first. After some dimensions a row's score is what was
added up so far and, for what is left, something between the sums of the least and of the greatest contributions the block
allows. Rows whose range can't matter any more leave the candidate bitmap; the last ones standing are known exactly.

Two scans: the first keeps an anchor's best rows of its own label, its positives. Each positive's score opens a window of
scores, and the second scan keeps the best rows of other labels in each window. Anchors travel to all blocks in rounds of a bounded number
of bytes: neither the driver nor an executor ever holds more of them, however many there are, and none is repeated once a block. A block
gives at most a few rows an anchor, whatever it holds; the best of all blocks are taken by Spark, which limits them before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import job_folder, settled
from .common import batch_rows, map_arrow, release, rows_of

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these per cent of the positive's.
LEAST, MOST = 50, 95
#: Rows of a block, anchors whose rows are written at once, and dimensions read between two looks at the bitmap.
BLOCK, GROUP, STRIDE = 4096, 256, 8
#: Bytes of anchors that travel to all blocks in one round, and tasks that blocks are dealt to for each that runs at once.
ROUND, DEALT = 8 << 20, 4
#: Components beyond this could make a score overflow 64 bits.
LARGEST = 1 << 24


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's rows: where vec_id is divisible by 7 the label is one further, modulo 10."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def _integers(vector) -> np.ndarray | None:
    """floor(SCALE * x) of every component, or None if the vector takes no part."""
    if vector is None or None in vector:
        return None
    scaled = np.floor(np.array(vector, np.float64) * SCALE)
    return scaled.astype(np.int64) if np.isfinite(scaled).all() and (np.abs(scaled) < LARGEST).all() else None


def _blocks(vectors: DataFrame) -> DataFrame:
    """Up to ``BLOCK`` rows of a task side by side: ids, labels, number of dimensions, and the values dimension by dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_blocks, task = [], 0, TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            n_dims = max(len(v) for _, _, v in held)
            columns = np.zeros((n_dims, len(held)), "<i4")
            for k, (_, _, v) in enumerate(held):
                columns[: len(v), k] = v
            return pa.RecordBatch.from_pydict({
                "block": pa.array([task << 32 | n_blocks], pa.int64()), "ids": pa.array([[i for i, _, _ in held]], pa.list_(pa.int64())),
                "labels": pa.array([[label for _, label, _ in held]], pa.list_(pa.int64())), "dims": pa.array([n_dims], pa.int32()), "columns": pa.array([columns.tobytes()], pa.binary()),
            })

        for batch in batches:
            for vec_id, label, vector in zip(rows_of(batch, "vec_id"), rows_of(batch, "label"), rows_of(batch, "embedding")):
                if vec_id is None or label is None or (values := _integers(vector)) is None:
                    continue
                held.append((vec_id, label, values))
                if len(held) == BLOCK:
                    yield closed()
                    held, n_blocks = [], n_blocks + 1
        if held:
            yield closed()

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    return settled(map_arrow(rows, ["vec_id", "label", "embedding"], work, "block long, ids array<long>, labels array<long>, dims int, columns binary"))


def _anchors(blocks: DataFrame, every: int) -> DataFrame:
    """Per anchor its row (block and place), id, label and values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = np.frombuffer(row["columns"], "<i4").reshape(row["dims"], -1)
                places = [k for k, i in enumerate(row["ids"]) if i % every == 0]
                for first in range(0, len(places), GROUP):
                    some = [(row["block"], k, row["ids"][k], row["labels"][k], columns[:, k].tobytes()) for k in places[first : first + GROUP]]
                    yield _batch(some, {"home": pa.int64(), "place": pa.int32(), "anchor_id": pa.int64(), "anchor_label": pa.int64(), "values": pa.binary()})

    return settled(map_arrow(blocks, ["block", "ids", "labels", "dims", "columns"], work, "home long, place int, anchor_id long, anchor_label long, values binary"))


def laid_out(columns: np.ndarray) -> np.ndarray:
    """A block's values as doubles, which multiply faster, where no sum of an anchor's products could pass 2^53 and so be rounded."""
    return columns.astype(np.float64 if len(columns) * int(np.abs(columns).max(initial=0)) * LARGEST <= 1 << 53 else np.int64)


class Block:
    """A block's columns, and the least and greatest value of each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.least, self.greatest = columns.min(axis=1), columns.max(axis=1)

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, keeps) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may matter and their exact scores. ``keeps(low, high)`` says of rows whose scores lie in these ranges, all equally wide,
        which may."""
        n = min(len(anchor), len(self.columns))  # dimensions that one side lacks count nothing
        q = anchor[:n].astype(self.columns.dtype)
        order = np.argsort(-np.abs(q), kind="stable")
        worst, best = np.minimum(q * self.least[:n], q * self.greatest[:n])[order], np.maximum(q * self.least[:n], q * self.greatest[:n])[order]
        # What the dimensions from the k-th on can still take away or add.
        rest_low, rest_high = np.append(np.cumsum(worst[::-1])[::-1], 0), np.append(np.cumsum(best[::-1])[::-1], 0)
        rows = np.flatnonzero(candidates)
        so_far = np.zeros(len(rows), q.dtype)
        for at in range(0, n, STRIDE):
            upto = min(at + STRIDE, n)
            dims = order[at:upto]
            # Picking more than few rows costs more than reading all.
            so_far += (q[dims] @ self.columns[dims])[rows] if 10 * len(rows) > len(candidates) else q[dims] @ self.columns[dims[:, None], rows]
            if len(rows):
                stay = keeps(so_far + rest_low[upto], so_far + rest_high[upto])
                if not stay.all():
                    rows, so_far = rows[stay], so_far[stay]
        return rows, so_far.astype(np.int64)

    def best_alike(self, anchor: np.ndarray, label: int, place: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """At most ``most`` rows of the label, but for ``place`` (the anchor's own, or -1): the highest scores, then the smallest ids."""
        candidates = self.labels == label
        if place >= 0:
            candidates[place] = False

        def keeps(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= np.partition(low, len(low) - most)[len(low) - most] if len(low) > most else np.ones(len(low), bool)

        rows, scores = self.scan(anchor, candidates, keeps)
        order = np.lexsort((self.ids[rows], -scores))[:most]
        return self.ids[rows[order]], scores[order]

    def best_within(self, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores at most ``most`` rows of other labels in it: the highest scores, then the smallest ids."""
        open_ = {w for w in windows if w[0] <= w[1]}
        widest, covered = max((greatest - least for least, greatest in open_), default=-1), []
        for least, greatest in sorted(open_):
            if covered and least <= covered[-1][1] + 1:
                covered[-1] = covered[-1][0], max(greatest, covered[-1][1])
            else:
                covered.append((least, greatest))

        def keeps(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            stay = np.zeros(len(low), bool)
            if high[0] - low[0] > widest:  # no range lies in a window as a whole
                for least, greatest in covered:
                    stay |= (high >= least) & (low <= greatest)
                return stay
            for least, greatest in open_:
                may = (high >= least) & (low <= greatest)
                sure = low[(low >= least) & (high <= greatest)]
                if len(sure) > most:
                    may &= high >= np.partition(sure, len(sure) - most)[len(sure) - most]
                stay |= may
            return stay

        rows, scores = self.scan(anchor, (self.labels != label) if open_ else np.zeros(len(self.labels), bool), keeps)
        out = []
        for least, greatest in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= greatest))
            order = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))[:most]]
            out.append((self.ids[rows[order]], scores[order]))
        return out


def window(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The whole scores s with least * score <= 100 * s <= most * score."""
    return -((-least * score) // 100), (most * score) // 100


_CARRIED = ["home", "place", "anchor_id", "anchor_label", "values"]


def _meet(blocks: DataFrame, anchors: DataFrame, carried: list[str]) -> DataFrame:
    """Every block beside the anchors of one round, which are one row: they are few enough bytes for the driver and every executor. Blocks are
    dealt out once, since they may lie in few files, and not repeated."""
    together = anchors.agg(F.collect_list(F.struct(*carried)).alias("anchors"))
    return blocks.repartition(DEALT * blocks.sparkSession.sparkContext.defaultParallelism).crossJoin(F.broadcast(together))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], Block]]:
    """Of each row the block's number, some of the anchors, the block, until all anchors were there."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            number, columns = row["block"].as_py(), np.frombuffer(row["columns"].as_buffer(), "<i4").reshape(row["dims"].as_py(), -1)
            block, anchors = Block(row["ids"].values.to_numpy(), row["labels"].values.to_numpy(), laid_out(columns)), row["anchors"].values
            for first in range(0, len(anchors), GROUP):
                yield number, anchors.slice(first, GROUP).to_pylist(), block


def mine(vectors: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products of floor(256 * x). An anchor, a row whose vec_id is divisible by ``every``, has as positives
    the ``positives`` other rows of its label with the highest scores; for each of them the ``negatives`` highest rows of other
    labels come back whose score lies between ``least`` and ``most`` per cent of the positive's. Ties go to the smaller vec_id.

    Rows without vec_id, label or vector, and vectors with null, non-finite or (in magnitude) components from 65,536 on take no part. A
    repeated row is a row of its own: it may be an anchor again and another copy's positive. Of two lengths, what the shorter vector
    lacks counts nothing; an empty one scores 0 with all. An empty table gives no rows. Only vec_id, label and embedding are read.
    """
    spark, blocks = vectors.sparkSession, _blocks(vectors)
    anchors = _anchors(blocks, every)
    # Besides its values an anchor carries about as many bytes, and so many for each positive.
    n_rounds = max(1, -(-(anchors.agg(F.sum(F.length("values") + 100 + 40 * positives)).first()[0] or 0) // ROUND))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group, block in _pairs(batches):
            out = []
            for a in group:
                ids, scores = block.best_alike(np.frombuffer(a["values"], "<i4").astype(np.int64), a["anchor_label"], a["place"] if a["home"] == number else -1, positives)
                out += [(a["home"], a["place"], i, s) for i, s in zip(ids.tolist(), scores.tolist())]
            yield _batch(out, {"home": pa.int64(), "place": pa.int32(), "id": pa.int64(), "score": pa.int64()})

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, block in _pairs(batches):
            out = []
            for a in group:
                windows = [window(p["score"], least, most) for p in a["positives"]]
                best = block.best_within(np.frombuffer(a["values"], "<i4").astype(np.int64), a["anchor_label"], windows, negatives)
                for p, (ids, scores) in zip(a["positives"], best):
                    out += [(a["home"], a["place"], a["anchor_id"], p["at"], p["id"], p["score"], i, s) for i, s in zip(ids.tolist(), scores.tolist())]
            yield _batch(out, {"home": pa.int64(), "place": pa.int32(), "anchor_id": pa.int64(), "at": pa.int32(), "positive_id": pa.int64(), "positive_score": pa.int64(), "negative_id": pa.int64(), "negative_score": pa.int64()})

    columns, kept = ["block", "ids", "labels", "dims", "columns", "anchors"], job_folder(spark, "settled", uuid.uuid4().hex)
    for at in range(n_rounds):
        asking = anchors.filter(F.pmod(F.xxhash64("home", "place"), F.lit(n_rounds)) == at)
        with batch_rows(spark, 1):
            found = map_arrow(_meet(blocks, asking, _CARRIED), columns, alike, "home long, place int, id long, score long")
            first = Window.partitionBy("home", "place").orderBy(F.desc("score"), "id")
            chosen = settled(found.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= positives))
        best = chosen.groupBy("home", "place").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("positives"))
        with batch_rows(spark, 1):
            found = map_arrow(_meet(blocks, asking.join(best, ["home", "place"]), [*_CARRIED, "positives"]), columns, unlike, "home long, place int, anchor_id long, at int, positive_id long, positive_score long, negative_id long, negative_score long")
            first = Window.partitionBy("home", "place", "at").orderBy(F.desc("negative_score"), "negative_id")
            ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
            ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(kept)
        release(spark)  # what this round sent and shuffled
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(kept)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))
