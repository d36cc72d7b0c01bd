"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine c lie sqrt(2 - 2c) apart. Projected on a few principal directions they lie no further apart, so a grid
of cells that wide over these directions orders the vectors such that the partners of a vector are in neighbouring cells. The
vectors, sorted by their cells, are cut into blocks of consecutive ones. Two blocks meet only if their bounding boxes come
within the distance; inside a task both are halved again and again, and halves that are provably too far apart are skipped.
What remains is compared in full, in double precision.

Equal vectors of one label are one vertex with a count. A block pair returns how many links each vector has and a spanning
forest of the links, so a dense group costs rows in proportion to its vectors, not to its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settled
from .common import batch_rows, map_arrow, release, rows_of
from .graph import components

COSINE = 0.98
DIRECTIONS = 6
BLOCK, LEAF = 512, 64
#: The directions are fitted on at most so many vectors, the first by a hash of the id. They decide how much is skipped, not what links.
SAMPLE = 5_000


def _valid(vector) -> bool:
    return vector is not None and len(vector) > 0 and None not in vector and bool(np.isfinite(v := np.array(vector, np.float64)).all()) and bool(v.any())


def _vertices(vectors: DataFrame) -> DataFrame:
    """Per row vec_id, label, and digests that are null unless the vector can link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, dims = [], [], []
            for vec_id, label, vector in zip(rows_of(batch, "vec_id"), rows_of(batch, "label"), rows_of(batch, "embedding")):
                good = vec_id is not None and label is not None and _valid(vector)
                raw = (np.array(vector, "<f8") + 0.0).tobytes() if good else b""
                dims.append(len(vector) if good else None)
                d1.append(np.uint64(xxhash.xxh64_intdigest(raw, 1)).view(np.int64) if good else None)
                d2.append(np.uint64(xxhash.xxh64_intdigest(raw, 2)).view(np.int64) if good else None)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "label": batch.column(1).cast(pa.string()), "dims": pa.array(dims, pa.int32()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "embedding": batch.column(2).cast(pa.list_(pa.float64()))})

    return map_arrow(vectors, ["vec_id", "label", "embedding"], work, "vec_id long, label string, dims int, d1 long, d2 long, embedding array<double>")


def directions(sample: np.ndarray, most: int = DIRECTIONS) -> np.ndarray:
    """Orthonormal directions of largest variance, one a column."""
    _, _, v = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
    return v[:most].T


def _gap(lo_a, hi_a, lo_b, hi_b) -> float:
    apart = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((apart * apart).sum())


def linked(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float, reach: float) -> np.ndarray:
    """Which rows of unit vectors ``a`` and ``b`` link, by halving both and skipping halves whose boxes are over ``reach`` apart."""
    out = np.zeros((len(a), len(b)), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        x, y = pa_[a0:a1], pb[b0:b1]
        if _gap(x.min(0), x.max(0), y.min(0), y.max(0)) > reach * reach:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            out[a0:a1, b0:b1] = a[a0:a1] @ b[b0:b1].T >= cosine
            continue
        am, bm = ((a0 + a1) // 2 if a1 - a0 > LEAF else a1), ((b0 + b1) // 2 if b1 - b0 > LEAF else b1)
        todo += [(i, j, k, m) for i, j in ((a0, am), (am, a1)) if j > i for k, m in ((b0, bm), (bm, b1)) if m > k]
    return out


def forest(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``links`` connects: each linked id with the smallest of its component."""
    top = np.iinfo(np.int64).max
    low_a, low_b = ids_a.copy(), ids_b.copy()
    while True:
        new_a = np.minimum(low_a, np.where(links, low_b, top).min(axis=1, initial=top))
        new_b = np.minimum(low_b, np.where(links, new_a[:, None], top).min(axis=0, initial=top))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    ids, low = np.concatenate([ids_a, ids_b]), np.concatenate([low_a, low_b])
    return sorted({(int(i), int(m)) for i, m in zip(ids[ids != low], low[ids != low])})


def _blocks(points: DataFrame, basis: np.ndarray, cell: float) -> DataFrame:
    """Consecutive vectors in grid order, ``BLOCK`` at most and of one group, with their box."""
    n_dims, n_dir = basis.shape

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.zeros((batch.num_rows, n_dims))
            for k, vector in enumerate(rows_of(batch, "embedding")):
                unit[k, : len(vector)] = np.array(vector) / np.linalg.norm(vector)
            cells = np.floor(unit @ basis / cell).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"grp": batch.column(0), "v": batch.column(1), "c": batch.column(2), **{f"g{k}": cells[:, k] for k in range(n_dir)}, "unit": pa.array([u.tobytes() for u in unit], pa.binary())})

    order = [f"g{k}" for k in range(n_dir)]
    placed = settled(map_arrow(points, ["grp", "v", "c", "embedding"], place, "grp string, v long, c long, " + ", ".join(f"{g} int" for g in order) + ", unit binary"))
    ranged = placed.repartitionByRange("grp", *order, F.xxhash64("v")).sortWithinPartitions("grp", *order, F.xxhash64("v"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, ids, counts, units = None, [], [], []

        def block() -> pa.RecordBatch:
            m = np.frombuffer(b"".join(units)).reshape(-1, n_dims)
            p = m @ basis
            return pa.RecordBatch.from_pydict({"block": pa.array([min(ids)], pa.int64()), "grp": [grp], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()], "ids": [ids], "counts": [counts], "units": pa.array([m.tobytes()], pa.binary())})

        for batch in batches:
            for g, v, c, u in zip(rows_of(batch, "grp"), rows_of(batch, "v"), rows_of(batch, "c"), rows_of(batch, "unit")):
                if ids and (g != grp or len(ids) == BLOCK):
                    yield block()
                    ids, counts, units = [], [], []
                grp = g
                ids.append(v)
                counts.append(c)
                units.append(u)
        if ids:
            yield block()

    return settled(map_arrow(ranged, ["grp", "v", "c", "unit"], cut, "block long, grp string, lo array<double>, hi array<double>, ids array<long>, counts array<long>, units binary"))


def _block_pairs(blocks: DataFrame, cell: float, reach: float) -> DataFrame:
    """Pairs of blocks of one group whose boxes come within ``reach``, each once, a block with itself too. They meet by the first
    direction's cells; the boxes alone travel."""
    boxes = blocks.select("block", "grp", "lo", "hi")
    first, last = F.floor(F.col("lo")[0] / cell), F.floor(F.col("hi")[0] / cell)
    left = boxes.withColumn("at", F.explode(F.sequence(first - 1, last + 1)))
    right = boxes.select(F.col("block").alias("other"), F.col("grp").alias("grp_o"), F.col("lo").alias("lo_o"), F.col("hi").alias("hi_o"), F.explode(F.sequence(first, last)).alias("at_o"))
    gaps = F.expr("aggregate(zip_with(zip_with(lo, hi_o, (x, y) -> x - y), zip_with(lo_o, hi, (x, y) -> x - y), (x, y) -> power(greatest(x, y, 0D), 2)), 0D, (s, x) -> s + x)")
    met = left.join(right, (F.col("grp") == F.col("grp_o")) & (F.col("at") == F.col("at_o")) & (F.col("block") <= F.col("other")) & (gaps <= reach * reach * (1 + 1e-9)))
    return settled(met.select("block", "other").distinct())


def _links(blocks: DataFrame, pairs: DataFrame, basis: np.ndarray, cosine: float, reach: float) -> DataFrame:
    """Rows (v, more, low): how many links a vector gains from a pair of blocks, or an edge of a spanning forest."""
    n_dims = len(basis)
    data = blocks.select("block", "ids", "counts", "units")
    spread = pairs.join(data, "block").join(data.toDF("other", "ids_o", "counts_o", "units_o"), "other")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = np.frombuffer(row["units"]).reshape(-1, n_dims)
                ids, counts = np.array(row["ids"], np.int64), np.array(row["counts"], np.int64)
                same = row["block"] == row["other"]
                if same:
                    b, ids_b, counts_b = a, ids, counts
                else:
                    b, ids_b, counts_b = np.frombuffer(row["units_o"]).reshape(-1, n_dims), np.array(row["ids_o"], np.int64), np.array(row["counts_o"], np.int64)
                on = linked(a, b, a @ basis, b @ basis, cosine, reach)
                if same:
                    np.fill_diagonal(on, False)
                    gain = on @ counts
                    v, more = ids[gain > 0], gain[gain > 0]
                else:
                    gain_a, gain_b = on @ counts_b, counts @ on
                    v, more = np.concatenate([ids[gain_a > 0], ids_b[gain_b > 0]]), np.concatenate([gain_a[gain_a > 0], gain_b[gain_b > 0]])
                edges = forest(on, ids, ids_b)
                if len(v):
                    yield pa.RecordBatch.from_pydict({
                        "v": pa.array([*v.tolist(), *(e[0] for e in edges)], pa.int64()),
                        "more": pa.array([*more.tolist(), *([0] * len(edges))], pa.int64()),
                        "low": pa.array([*([None] * len(v)), *(e[1] for e in edges)], pa.int64()),
                    })

    columns = ["block", "other", "ids", "counts", "units", "ids_o", "counts_o", "units_o"]
    with batch_rows(blocks.sparkSession, 16):
        return settled(map_arrow(spread, columns, work, "v long, more long, low long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row vec_id, n_links, component_id, kept.

    Vectors link within one label and one length only. Null, empty and zero vectors, such as hold null or non-finite components, and
    rows without label or vec_id link with nothing: n_links is 0 and component_id is the own vec_id. A null vec_id stays null
    and is kept. Repeated rows are vectors of their own and link with each other. An empty table gives no rows. Only vec_id,
    label and embedding are read.
    """
    spark = vectors.sparkSession
    rows = settled(_vertices(vectors))
    key = ["label", "dims", "d1", "d2"]
    points = settled(rows.filter("d1 is not null").groupBy(*key).agg(F.min("vec_id").alias("v"), F.count("*").alias("c"), F.first("embedding").alias("embedding")))
    plain = rows.select("vec_id", *key)
    n_dims = points.agg(F.max("dims")).first()[0]
    if n_dims is None:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    some = points.select("v", "embedding").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("embedding").to_pylist()
    fitted = np.zeros((len(some), n_dims))
    for k, vector in enumerate(some):
        fitted[k, : len(vector)] = np.array(vector) / np.linalg.norm(vector)
    basis = directions(fitted)
    # A hair wider than the distance itself, so that rounding can't part a pair at the very threshold.
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    blocks = _blocks(points.select(F.concat_ws("/", "dims", "label").alias("grp"), "v", "c", "embedding"), basis, reach)
    found = _links(blocks, _block_pairs(blocks, reach, reach), basis, cosine, reach)
    groups = components(found.filter("low is not null").select(F.col("v").alias("a"), F.col("low").alias("b")))
    release(spark)
    degree = found.groupBy("v").agg(F.sum("more").alias("more"))
    of_point = settled(points.select("v", "c", *key).join(degree, "v", "left").join(groups, "v", "left").select(*key, (F.coalesce("more", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "v").alias("component")))
    out = plain.join(of_point, key, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
