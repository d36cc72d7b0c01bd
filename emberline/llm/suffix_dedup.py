"""Removal of long byte strings that occur more than once, by blockwise suffix sorting with a cover sample.

A suffix counts by its first ``length`` bytes. Comparing such suffixes byte by byte ties for hundreds of bytes wherever texts
repeat, and sorting them all takes memory for each byte of the corpus. A cover sample helps with both: a small set of
positions whose suffixes are ranked beforehand, such that any two equal suffixes reach a sampled position at the same distance.
A suffix is then its few bytes before that position, the position's rank, and the bytes that are left.

A cover of residues modulo v samples some 1/sqrt(v) of all positions, and at which distance two suffixes meet it depends on
both. Here the cover is chosen by content: of every ``reach`` neighbouring positions the one whose ``GRAM`` bytes hash lowest, the
first of them at ties. It holds under 2/reach of the positions, and equal suffixes meet it at the same distance by construction.

Since only equality decides what is removed, ranks and keys are fingerprints instead of places in an order. A fingerprint of 64 bits is
built from those of its halves, quarters and so on, each mixed before it is joined with its neighbour, down to 8 bytes,
which are taken as they are: what cancels in a sum doesn't here. Suffixes are equal if the rank (of the bytes they share from the cover on) and the
key (of all their bytes) agree, two fingerprints of different stretches. Bytes themselves are not compared: m suffixes under one rank
have m * m / 2 ** 65 wrong pairs to expect.

1. The cover of every text: a sampled position with the run of suffixes that reach it first. Its rank stands for the bytes all
   of these share from there on; its variant stands for all bytes of the run.
2. A rank that occurs once ends all its suffixes. A variant that occurs again is a long tie resolved at once: every suffix of the
   run repeats. One that occurs once, under a rank that doesn't, is open.
3. Suffixes of open variants, and one copy of the others under their rank, are dealt into buckets by key and sorted bucket by
   bucket; neighbours that are equal repeat. There are as many buckets as the suffixes to sort need, however many texts have a rank, and what repeats
   within a task needs no bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settled
from .common import discard, map_arrow, mixed, release, rows_of

LENGTH = 400
GRAM = 24
#: Suffixes that a bucket has in the mean, and that a task gathers before it deals them out.
IN_BUCKET, HELD = 500_000, 400_000

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def reach_of(length: int) -> int:
    """Neighbouring positions of which one is sampled: the largest power of two up to a third of the length."""
    if length < 3 * GRAM:
        raise ValueError(f"strings must have at least {3 * GRAM} bytes")
    return 1 << ((length // 3).bit_length() - 1)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _LEFT + (b ^ (b >> np.uint64(32))) * _RIGHT)


class Prints:
    """Fingerprints of the stretches of a text: of 8, 16, 32, … bytes at every position, and any other length from two that overlap."""

    def __init__(self, raw: np.ndarray):
        x = raw.astype(np.uint64)
        for k in (1, 2, 4):  # eight bytes side by side
            x = x[: max(0, len(x) - k)] | (x[k:] << np.uint64(8 * k))
        self.levels = {8: mixed(x + np.uint64(1))}

    def _level(self, size: int) -> np.ndarray:
        if size not in self.levels:
            half = self._level(size // 2)
            self.levels[size] = _joined(half[: max(0, len(half) - size // 2)], half[size // 2 :])
        return self.levels[size]

    def of(self, begin: np.ndarray | slice, length: int) -> np.ndarray:
        """Of the stretches of ``length`` bytes, 8 at least, at these positions."""
        size = 1 << (length.bit_length() - 1)
        level, shift = self._level(size), length - size
        if isinstance(begin, slice):
            return _joined(level[begin], level[begin.start + shift : begin.stop + shift])
        return _joined(level[begin], level[begin + shift])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest of every ``width`` neighbours, from running minima to both sides of block borders."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    blocks = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def cover(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each sampled position of a text of ``length`` bytes or more: rank, variant, and the first and last suffix that reach it."""
    prints, n, reach = Prints(raw), len(raw) - length + 1, reach_of(length)
    places = np.arange(n + reach - 1, dtype=np.uint64)
    hashes = prints.of(slice(0, len(places)), GRAM)
    reached = (lowest((hashes & np.uint64(0xFFFFFFFF00000000)) | places, reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(reached)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    at = reached[first]
    # The first and the last suffix of a run overlap, so the two are all its bytes.
    shape = ((at - first) << 20 | (last - first)).astype(np.uint64)
    variant = _joined(_joined(prints.of(first, length), prints.of(last, length)), mixed(shape + np.uint64(1)))
    return prints.of(at, length - reach + 1), variant, first, last


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by ``r`` and ``n``: rows that agree in both have the same id and text, and the same is removed from them."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("r", F.xxhash64("doc_id", "text")).withColumn("n", F.octet_length("text"))


def _cover_rows(docs: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text, r in zip(rows_of(batch, "text"), rows_of(batch, "r")):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(raw) >= length:
                    rank, variant, first, last = cover(raw, length)
                    parts.append((rank.view(np.int64), variant.view(np.int64), np.full(len(rank), r), np.full(len(rank), len(raw)), first, last))
            if parts:
                rank, variant, r, n, lo, hi = (np.concatenate(p) for p in zip(*parts))
                yield pa.RecordBatch.from_pydict({"rank": rank, "variant": variant, "r": r, "n": n.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    return map_arrow(docs.filter(F.col("n") >= length), ["text", "r"], work, "rank long, variant long, r long, n int, lo int, hi int")


def _run_rows(r: np.ndarray, n: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
    """Suffix starts ``s`` of texts (r, n) as runs."""
    order = np.lexsort((s, n, r))
    r, n, s = r[order], n[order], s[order]
    cut = np.flatnonzero((np.diff(r) != 0) | (np.diff(n) != 0) | (np.diff(s) != 1))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(s) - 1]])
    return {"r": r[first], "n": n[first], "lo": s[first], "hi": s[last]}


def _alike(rank: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes: which are equal to another, and one of each kind."""
    order = np.lexsort((rank, key))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(rank[order]) != 0)
    which = np.cumsum(new) - 1
    again, one = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order] = np.bincount(which)[which] > 1
    one[order[new]] = True
    return again, one


def _runs_alone(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    empty = pa.nulls(len(rows["r"]), pa.binary())
    return pa.RecordBatch.from_pydict({"bucket": pa.nulls(len(rows["r"]), pa.int32()), **{c: empty for c in _SHARES}, **{k: pa.array(v) for k, v in rows.items()}})


_SHARES = ["marks", "keys", "rs", "ns", "ss"]


def _dealt(pieces: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """Suffixes of open variants and their rivals: rows with ``lo`` are runs known to repeat, the others are a bucket's share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rank, key, r, n, s, is_open = (np.concatenate(p) for p in zip(*held))
            again, one = _alike(rank, key)
            if (done := again & is_open).any():
                yield _runs_alone(_run_rows(r[done], n[done], s[done]))
            mark = one & (again | ~is_open)  # a key that is known here, or a rival's, says so to the bucket once
            alone = is_open & ~again
            bucket = (key % np.uint64(n_buckets)).astype(np.int32)
            sent = np.flatnonzero(mark | alone)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            for part in np.split(sent, np.flatnonzero(np.diff(bucket[sent])) + 1):
                if len(part):
                    m, o = part[mark[part]], part[alone[part]]
                    share = [np.stack([rank[m], key[m]], axis=1), np.stack([rank[o], key[o]], axis=1), r[o], n[o], s[o]]
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([bucket[part[0]]], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(_SHARES, share)},
                        "r": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int32()), "lo": pa.nulls(1, pa.int32()), "hi": pa.nulls(1, pa.int32()),
                    })
            held.clear()

        for batch in batches:
            for text, r, n, own in zip(rows_of(batch, "text"), rows_of(batch, "r"), rows_of(batch, "n"), rows_of(batch, "pieces")):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                for p in own:
                    m = p["hi"] + 1 - p["lo"]
                    key = Prints(raw[p["lo"] : p["hi"] + length]).of(slice(0, m), length)
                    rank = np.full(m, np.array([p["rank"]], np.int64).view(np.uint64)[0])
                    held.append((rank, key, np.full(m, r), np.full(m, n, np.int32), np.arange(p["lo"], p["hi"] + 1, dtype=np.int32), np.full(m, p["open"])))
                    n_held += m
                if n_held >= HELD:
                    yield from flush()
                    n_held = 0
        if held:
            yield from flush()

    schema = "bucket int, marks binary, keys binary, rs binary, ns binary, ss binary, r long, n int, lo int, hi int"
    return map_arrow(pieces, ["text", "r", "n", "pieces"], work, schema)


def _sorted_buckets(shares: DataFrame, n_buckets: int) -> DataFrame:
    """One bucket after the other: sort its suffixes; those equal to a neighbour or to a mark repeat."""

    def settle(marks: list[bytes], keys: list[bytes], rs: list[bytes], ns: list[bytes], ss: list[bytes]) -> pa.RecordBatch | None:
        known, own = (np.frombuffer(b"".join(x), np.uint64).reshape(-1, 2) for x in (marks, keys))
        r, n, s = np.frombuffer(b"".join(rs), np.int64), np.frombuffer(b"".join(ns), np.int32), np.frombuffer(b"".join(ss), np.int32)
        both = np.concatenate([own, known])
        again = _alike(both[:, 0], both[:, 1])[0][: len(own)]
        return pa.RecordBatch.from_pydict(_run_rows(r[again], n[again], s[again])) if again.any() else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, ([], [], [], [], [])
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket and bucket is not None:
                    if (out := settle(*parts)) is not None:
                        yield out
                    parts = ([], [], [], [], [])
                bucket = row["bucket"]
                for part, name in zip(parts, _SHARES):
                    part.append(row[name])
        if bucket is not None and (out := settle(*parts)) is not None:
            yield out

    by_bucket = shares.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    return map_arrow(by_bucket, ["bucket", *_SHARES], work, "r long, n int, lo int, hi int")


def repeated_runs(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(r, n, lo, hi): runs of positions at which a string of ``length`` bytes starts that also starts elsewhere."""
    spark = keyed.sparkSession
    every = settled(_cover_rows(keyed, length))
    # A table of its own, so that Spark can split a hot rank of the join.
    twice = settled(every.groupBy("rank").agg(F.count("*").alias("c")).filter("c > 1").select("rank"))
    tied = settled(every.join(twice, "rank", "left_semi"))
    release(spark)
    discard(every)
    variants = settled(tied.groupBy("rank", "variant").agg(F.count("*").alias("c"), F.min(F.struct("r", "n", "lo", "hi")).alias("at")))
    again = settled(variants.filter("c > 1").select("rank", "variant"))
    resolved = settled(tied.join(again, ["rank", "variant"], "left_semi").select("r", "n", "lo", "hi"))
    release(spark)
    discard(tied)
    ranks = variants.groupBy("rank").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).filter("kinds > 1 and least = 1")
    rivals = settled(variants.join(settled(ranks.select("rank")), "rank").select("rank", "c", "at"))
    n_suffixes = rivals.agg(F.sum(F.col("at.hi") - F.col("at.lo") + 1)).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_suffixes // IN_BUCKET))
    piece = F.struct(F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), "rank", (F.col("c") == 1).alias("open"))
    pieces = settled(rivals.select(F.col("at.r").alias("r"), F.col("at.n").alias("n"), piece.alias("piece")).groupBy("r", "n").agg(F.collect_list("piece").alias("pieces")))
    dealt = settled(_dealt(keyed.select("r", "n", "text").join(pieces, ["r", "n"]), n_buckets, length))
    release(spark)
    for done in (variants, rivals, pieces, twice, again):
        discard(done)
    sorted_runs = settled(_sorted_buckets(dealt.filter("bucket is not null"), n_buckets))
    return resolved.unionByName(dealt.filter("bucket is null").select("r", "n", "lo", "hi")).unionByName(sorted_runs)


def covered(intervals: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings starting in these runs cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((i["lo"], i["hi"] + length) for i in intervals or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def cut_out(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes.

    Null texts are empty; texts under ``LENGTH`` bytes lose nothing. Repeated rows are texts of their own: both lose what they share.
    Null doc_ids stay null. An empty table gives no rows. Only doc_id and text are read. Removal is judged on the input.
    """
    keyed = _keyed(docs)
    found = repeated_runs(keyed).groupBy("r", "n").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    found = settled(found)
    release(docs.sparkSession)
    joined = keyed.join(found, ["r", "n"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(rows_of(batch, "text"), rows_of(batch, "gone")):
                raw = text.encode("utf-8", "surrogatepass")
                spans, kept, at = covered(gone), [], 0
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, spans, sha, kept = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})

    return map_arrow(joined, ["doc_id", "text", "gone"], work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows with their texts less the strings of ``length`` bytes that repeat, all of their copies, and ``n_chars``, where it is there, of the new text. A character that is cut in two goes
    as a whole; a null text stays null."""
    others = [c for c in docs.columns if c != "text"]
    keyed = _keyed(docs)
    found = settled(repeated_runs(keyed, length).groupBy("r", "n").agg(F.collect_list(F.struct("lo", "hi")).alias("gone")))
    release(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), "text", F.xxhash64("doc_id", text).alias("r"), F.octet_length(text).alias("n"))
    joined = rows.join(found, ["r", "n"], "left").select("others", "text", "gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(rows_of(batch, "text"), rows_of(batch, "gone")):
                if gone:
                    raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
                    for lo, hi in covered(gone, length):
                        kept.append(raw[at:lo].decode("utf-8", "ignore"))
                        at = hi
                    text = "".join([*kept, raw[at:].decode("utf-8", "ignore")])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["others", "text"])

    shortened = joined.mapInArrow(work, joined.select("others", "text").schema)
    return shortened.select(*[F.col("text") if c == "text" else F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"others.`{c}`") for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    return cut_out(docs).drop("kept")
