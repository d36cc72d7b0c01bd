"""Aligning the tokens of two vocabularies over the same texts.

Both encodings of a text are token ends, byte offsets in ascending order. Where both end, a group of tokens ends. The
shorter list of ends is searched in the longer one by galloping: from the last place found the steps double until an end is no
smaller, then a binary search settles it. The places of the common ends cut both token lists into groups, and differences of
places are the groups' sizes, so every token's partners are a range of places in the other list.

How many documents hold an id pair linked is a corpus-wide count. Documents are gathered into blocks of about ``BLOCK`` tokens in the
task that aligned them. A block lists its distinct pairs once, with the number of its documents that hold each; the counts of
all blocks are summed and come back to a block once a pair. So shuffles carry a row a block and pair, not one a link or
document, and a pair that every document holds is one row a block.
"""

from __future__ import annotations

import json
import os
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import settled
from .common import batch_rows, map_arrow, rows_of

#: Tokens (of the first vocabulary) and documents after which a block is closed. One text is never cut.
BLOCK, BLOCK_ROWS = 300_000, 8192
#: Links of a group that are listed one by one; those of a larger group are counted from both sides' id counts.
LISTED = 4096
_HIGH = np.int64(32)


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in ``a`` and in ``b`` of the numbers they share. Both are strictly ascending."""
    swapped = len(a) > len(b)
    short, long = (b, a) if swapped else (a, b)
    in_short, in_long, at, n = [], [], 0, len(long)
    for k, end in enumerate(short):
        if at >= n:
            break
        if long[at] < end:
            # Long[low] is smaller than the end; long[high] is not, or lies beyond the list.
            low, step = at, 1
            high = at + 1
            while high < n and long[high] < end:
                low, step = high, step * 2
                high = low + step
            at = bisect_left(long, end, low + 1, min(high, n))
            if at >= n:
                break
        if long[at] == end:
            in_short.append(k)
            in_long.append(at)
            at += 1
    return (in_long, in_short) if swapped else (in_short, in_long)


class Vocabulary:
    """Ids of whole texts, and the bytes of each id's token."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes, self.sizes = token_bytes, np.array([len(t) for t in token_bytes], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def of(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, which begins with a space or is empty, or None if their tokens' bytes in a row differ from the text's."""
        take = self.token_bytes.__getitem__
        return [np.array(ids, np.int64) if b"".join(map(take, ids)) == text.encode() else None for text, ids in zip(texts, self.ids(texts))]


class ByteLevel(Vocabulary):
    """A byte-level vocabulary file of the tokenizers library; special strings are plain text, or with ``special`` ids of their own.

    Where its ids follow the order of its merges, the ranks of the tiktoken library are the same vocabulary, and that library is
    several times as fast. The two know different versions of Unicode, so texts with characters that Python's own, older table
    doesn't know are left to the tokenizers library.
    """

    def __init__(self, path: str, pattern: str, special: bool = False):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        numbers = file["model"]["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
        letters, token_bytes = _byte_letters(), [b""] * (max(numbers.values()) + 1)
        for name, i in numbers.items():
            token_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        super().__init__(token_bytes)
        self.path, self.library, self.ranks = path, None, None
        self.special = [t["content"] for t in file["added_tokens"]] if special else []
        merged = [numbers["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        if all(a < b for a, b in zip(merged, merged[1:])):
            import tiktoken

            ranks = {token_bytes[i]: i for i in merged} | {t: i for i, t in enumerate(token_bytes) if len(t) == 1}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a worker on each core
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = not self.special
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        out, left = [], []
        for k, text in enumerate(texts):
            known = self.ranks is not None and not any(s in text for s in self.special) and (text.isascii() or all(unicodedata.category(c) != "Cn" for c in set(text)))
            out.append(self.ranks.encode_ordinary(text) if known else None)
            if not known:
                left.append(k)
        if left:
            for k, ids in zip(left, self._by_library([texts[k] for k in left])):
                out[k] = ids
        return out


class Pieces(Vocabulary):
    """A model file of the sentencepiece library that puts a space in front of a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        super().__init__([bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 stands for itself, the rest for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side every group has; the last ends of both sides must be equal."""
    in_a, in_b = common_ends(ends_a.tolist(), ends_b.tolist())
    return np.diff(np.array(in_a, np.int64), prepend=-1), np.diff(np.array(in_b, np.int64), prepend=-1)


def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs, ``a`` in the high bits, in ascending order, and how many links each has."""
    each = size_a * size_b
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    listed = each <= LISTED
    # A token of ``a`` once for every token of ``b`` in its group, beside the places of those.
    per_a = np.repeat(np.where(listed, size_b, 0), size_a)
    left = np.repeat(a, per_a)
    upto = np.cumsum(per_a)
    right = b[np.repeat(np.repeat(first_b, size_a), per_a) + np.arange(len(left)) - np.repeat(upto - per_a, per_a)]
    pairs, times = np.unique(left << _HIGH | right, return_counts=True)
    large = np.flatnonzero(~listed)
    if len(large):
        found = [(pairs, times)]
        for g in large:
            ia, na = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            ib, nb = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            found.append(((ia[:, None] << _HIGH | ib).ravel(), np.outer(na, nb).ravel()))
        pairs, where = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, where, np.concatenate([n for _, n in found]))
        times = total
    return pairs, times


class Writer:
    """Groups as text, ``a1,a2|b1;a3|b2,b3``: every id is written with the sign that follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.written = [f"{i}{sign}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for sign in signs for i in range(n)]

    def __call__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> str:
        upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
        a, b = a.copy(), b + 2 * self.n_a
        a[upto_a - 1] += self.n_a
        b[upto_b - 1] += self.n_b
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = a
        row[np.arange(len(b)) + np.repeat(upto_a, size_b)] = b
        return "".join(map(self.written.__getitem__, row.tolist()))[:-1]


_LOADED: dict[tuple, tuple] = {}


def _loaded(byte_level: str, pattern: str, pieces: str) -> tuple[Vocabulary, Vocabulary, Writer]:
    key = byte_level, pattern, pieces
    if key not in _LOADED:
        first, second = ByteLevel(byte_level, pattern), Pieces(pieces)
        _LOADED[key] = first, second, Writer(len(first.sizes), len(second.sizes))
    return _LOADED[key]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


def align(docs: DataFrame, byte_level: str, pattern: str, pieces: str) -> DataFrame:
    """Texts in a byte-level vocabulary file (whose library splits by ``pattern``) against a model file of pieces.

    Per row doc_id, n_a and n_b (tokens), n_groups, n_links, ``groups`` (``a1,a2|b1;a3|b2,b3``), and the distinct linked id
    pairs (the first vocabulary's id in the high 32 bits) with how many links each has.

    Texts are encoded with a space in front. Null and empty texts, and texts whose tokens' bytes differ from them in either vocabulary, have no
    tokens: zeros, an empty string, empty arrays. Repeated rows and null doc_ids give a row each; an empty table none; other columns
    aren't read. One pass without a shuffle; a text's distinct id pairs must fit in a worker.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, text_of = _loaded(byte_level, pattern, pieces)
        none = np.zeros(0, np.int64)
        for batch in batches:
            texts = [" " + t if t else "" for t in rows_of(batch, "text")]
            counts, groups, pairs, times = [], [], [], []
            for a, b in zip(first.of(texts), second.of(texts)):
                if a is None or b is None or not len(a):
                    counts.append((0, 0, 0, 0))
                    groups.append("")
                    pairs.append(none)
                    times.append(none)
                    continue
                size_a, size_b = grouped(np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b]))
                p, n = links(a, b, size_a, size_b)
                counts.append((len(a), len(b), len(size_a), int((size_a * size_b).sum())))
                groups.append(text_of(a, b, size_a, size_b))
                pairs.append(p)
                times.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(groups, pa.string()), _lists(pairs), _lists(times)],
                ["doc_id", *_COUNTS, "groups", "pairs", "times"],
            ) if counts else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _FIELDS], schema=_FIELDS)

    return map_arrow(docs, ["doc_id", "text"], work, ALIGNED)


_LONGS = pa.list_(pa.int64())
_FIELDS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups", pa.string()), ("pairs", _LONGS), ("times", _LONGS)])


def _blocks(aligned: DataFrame, carried: list[str]) -> DataFrame:
    """One row for about ``BLOCK`` tokens' documents: their ``carried`` columns as lists, the block's distinct pairs with the number of its
    documents that hold each, and per document which of the pairs it holds and how often."""
    types = {f.name: f.dataType.simpleString() for f in aligned.select(*carried).schema.fields}
    schema = "block long, pairs array<long>, docs array<long>, sizes array<int>, codes binary, times binary, " + ", ".join(f"`{c}` array<{t}>" for c, t in types.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_rows = n_tokens = n_blocks = 0
        task = TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            each = rows.column("pairs").combine_chunks()
            pairs, codes = np.unique(each.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            row = {"block": [task << 32 | n_blocks], "pairs": [pairs], "docs": [np.bincount(codes, minlength=len(pairs))], "sizes": [each.value_lengths().to_numpy(zero_copy_only=False)]}
            row |= {"codes": [codes.astype("<i4").tobytes()], "times": [rows.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()]}
            fields = [("block", pa.int64()), ("pairs", _LONGS), ("docs", _LONGS), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("times", pa.binary())]
            arrays = [pa.array(row[name], kind) for name, kind in fields]
            for c in carried:
                column = rows.column(c).combine_chunks()
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column))
            return pa.RecordBatch.from_arrays(arrays, [*(name for name, _ in fields), *carried])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n_rows += batch.num_rows
                n_tokens += sum(rows_of(batch, "n_a"))
            if n_tokens >= BLOCK or n_rows >= BLOCK_ROWS:
                yield closed()
                held, n_rows, n_tokens, n_blocks = [], 0, 0, n_blocks + 1
        if held:
            yield closed()
            held = []

    return settled(map_arrow(aligned, [*carried, "pairs", "times"], work, schema))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no pair of its first id is in more."""
    counts = settled(blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n")))
    a = F.shiftright("pair", 32)
    # One row an id of the first vocabulary, some 50,000 small ones whatever the corpus: a broadcast with a bound.
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def with_corpus_counts(aligned: DataFrame, carried: list[str]) -> DataFrame:
    """Per row of ``align`` its ``carried`` columns (``n_a`` among them), n_best and count_sum over its links.

    Every row counts as a document of its own. Rows without links have zeros.
    """
    types = {f.name: f.dataType.simpleString() for f in aligned.select(*carried).schema.fields}
    blocks = _blocks(aligned, carried)
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    answered = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("answers"))
    met = blocks.drop("pairs", "docs").join(answered, "block", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sizes = row["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                best_sum = count_sum = np.zeros(len(sizes), np.int64)
                if sizes.any():
                    answers = row["answers"].values
                    order = np.argsort(answers.field("pair").to_numpy(zero_copy_only=False))
                    n = answers.field("n").to_numpy(zero_copy_only=False)[order]
                    best = answers.field("best").to_numpy(zero_copy_only=False)[order]
                    codes, times = np.frombuffer(row["codes"].as_buffer(), "<i4"), np.frombuffer(row["times"].as_buffer(), "<i4").astype(np.int64)
                    ends = np.cumsum(sizes)
                    best_sum = np.diff(np.concatenate([[0], np.cumsum(times * best[codes])])[np.concatenate([[0], ends])])
                    count_sum = np.diff(np.concatenate([[0], np.cumsum(times * n[codes])])[np.concatenate([[0], ends])])
                yield pa.RecordBatch.from_arrays([*(row[c].values for c in carried), pa.array(best_sum, pa.int64()), pa.array(count_sum, pa.int64())], [*carried, "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", n_best long, count_sum long"
    with batch_rows(aligned.sparkSession, 1):
        return settled(map_arrow(met, ["sizes", "codes", "times", "answers", *carried], work, schema))


def digests(docs: DataFrame, byte_level: str, pattern: str, pieces: str) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is their first id's highest), count_sum (over links)
    and groups_sha256, which is empty without tokens. Rows as in ``align`` and ``with_corpus_counts``."""
    written = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    carried = ["doc_id", *_COUNTS, "groups_sha256"]
    return with_corpus_counts(align(docs, byte_level, pattern, pieces).withColumn("groups_sha256", written), carried)
