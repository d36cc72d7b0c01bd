"""Byte-level BPE from a file of ranks, in two tiers.

A pattern cuts a text into pre-tokens. The first tier is a minimal perfect hash over the vocabulary, as many slots as there are tokens:
a pre-token that is in the vocabulary is found by one probe and one comparison of bytes, many at once in numpy. The second tier
takes the rest: its bytes are a linked list, a heap holds the adjacent pairs that are tokens together, and the lowest rank, the
leftmost among equals, merges first. A merged pair's neighbours enter the heap anew, and pairs that a merge broke are
skipped when they come up, so n bytes cost n log n.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .chunks import Chunks
from .common import map_arrow, mixed, rows_of

#: Keys a bucket of the hash has in the mean, and places tried at once for a bucket.
PER_BUCKET, TRIED = 3, 64
#: Pre-tokens whose ids a worker remembers before it starts again.
KEPT = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class MinimalPerfectHash:
    """n distinct keys on the slots 0 to n - 1, one each.

    Keys fall into buckets by their digest. The largest buckets go first and each tries displacements until all its keys land on
    free slots; a bucket of one key names its slot outright. Only the displacements are kept beside the keys.
    """

    def __init__(self, keys: list[bytes]):
        self.n, digests = len(keys), _digests(keys)
        if len(np.unique(digests)) < self.n:
            raise ValueError("two keys have one digest")
        self.moves = np.zeros(max(1, self.n // PER_BUCKET), np.int64)
        buckets = (digests % np.uint64(len(self.moves))).astype(np.int64)
        by_bucket = np.argsort(buckets, kind="stable")
        sizes = np.bincount(buckets, minlength=len(self.moves))
        ends = np.cumsum(sizes)
        free = np.ones(self.n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = digests[by_bucket[ends[b] - sizes[b] : ends[b]]]
            if len(members) < 2:
                break
            first = 0
            while True:
                places = self._places(members[None, :], np.arange(first, first + TRIED)[:, None])
                fits = free[places].all(axis=1)
                for row in np.flatnonzero(fits):
                    if len(set(places[row].tolist())) == len(members):
                        break
                else:
                    first += TRIED
                    continue
                self.moves[b] = first + row
                free[places[row]] = False
                break
        single = np.flatnonzero(sizes == 1)
        self.moves[single] = -1 - np.flatnonzero(free)
        self.slot_of = self._slots(digests)

    def _places(self, digests: np.ndarray, moves: np.ndarray) -> np.ndarray:
        return (mixed(digests + moves.astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        moves = self.moves[(digests % np.uint64(len(self.moves))).astype(np.int64)]
        return np.where(moves < 0, -1 - moves, self._places(digests, np.maximum(moves, 0)))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key. A key the hash wasn't made for gets some slot too: compare it with what is there."""
        return self._slots(_digests(keys)) if self.n else np.zeros(len(keys), np.int64)


class TwoTierBpe:
    """Ranks by token bytes. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = list(ranks)
        self.hash = MinimalPerfectHash(tokens)
        self.at = [b""] * len(tokens)
        for token, slot in zip(tokens, self.hash.slot_of.tolist()):
            self.at[slot] = token
        self.rank_at = [ranks[token] for token in self.at]
        self.byte = [ranks[bytes([b])] for b in range(256)]
        # Which pairs of tokens are a token together: every way to cut one in two.
        self.joined = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.joined[left, right] = rank

    def merged(self, piece: bytes) -> list[int]:
        """The second tier: ids of a piece that need not be a token."""
        ids = [self.byte[b] for b in piece]
        n, joined = len(ids), self.joined
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, k) for k in range(n - 1) if (rank := joined.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            # A pair is out of date if its left end is gone or now forms another token, or none, with what follows.
            if ids[k] < 0 or right >= n or joined.get((ids[k], ids[right])) != rank:
                continue
            ids[k], ids[right] = rank, -1
            after[k] = following = after[right]
            if following < n:
                before[following] = k
                if (new := joined.get((rank, ids[following]))) is not None:
                    heapq.heappush(heap, (new, k))
            if before[k] >= 0 and (new := joined.get((ids[before[k]], rank))) is not None:
                heapq.heappush(heap, (new, before[k]))
        return [i for i in ids if i >= 0]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Each non-empty piece's ids as little-endian unsigned 32-bit bytes."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        found = []
        for piece, slot in zip(raw, self.hash.slots(raw).tolist()):
            ids = [self.rank_at[slot]] if self.at[slot] == piece else self.merged(piece)
            found.append(np.array(ids, "<u4").tobytes())
        return found


class Splitter:
    """Cuts texts at the matches of a pattern as the rank files' library does. The library and the pattern's module follow different
    versions of Unicode, so characters that Python's own, older table doesn't know are classed by asking the library, each once."""

    def __init__(self, pattern: str):
        import regex

        self.plain = re.compile(_ascii(pattern), re.ASCII)
        self.any = regex.compile(pattern)
        self.pattern, self.like = pattern, {}

    def _stand_in(self, char: str) -> str:
        """A character of the same kind that all tables know: a letter, a digit or a sign."""
        import tiktoken

        for known in "a0":
            ranks = {bytes([b]): b for b in range(256)}
            ranks[known.encode() + char.encode()[:1]] = 256
            if 256 in tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(known + char):
                return "ª" if known == "a" else "²"
        return "§"

    def findall(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text)
        unknown = {c for c in set(text) if unicodedata.category(c) == "Cn"}
        if not unknown:
            return self.any.findall(text)
        self.like.update({ord(c): self._stand_in(c) for c in unknown if ord(c) not in self.like})
        out, at = [], 0
        for piece in self.any.findall(text.translate(self.like)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out


def _ascii(pattern: str) -> str:
    """The pattern for ASCII texts only, in the faster module's words."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_LOADED: dict[tuple, Chunks] = {}
_BYTES: dict[str, tuple] = {}


def pre_tokens(path: str, pattern: str) -> Chunks:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Chunks(Splitter(pattern), TwoTierBpe(read_ranks(path)).encode, KEPT)
    return _LOADED[path, pattern]


def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each begins and ends."""
    if path not in _BYTES:
        ranks = read_ranks(path)
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        by_rank = sorted((rank, token) for token, rank in ranks.items())
        sizes[[rank for rank, _ in by_rank]] = [len(token) for _, token in by_rank]
        ends = np.cumsum(sizes)
        _BYTES[path] = np.frombuffer(b"".join(token for _, token in by_rank), np.uint8), ends - sizes, sizes
    return _BYTES[path]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per row doc_id and ids, an array of the ids of the text's pre-tokens in a row.

    Null and empty texts have no ids; special strings are plain text. Repeated rows and null doc_ids give a row each; an empty table
    none; other columns aren't read. One pass without a shuffle. A worker holds the vocabulary and at most two
    generations of ``KEPT`` pre-tokens.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pre_tokens(ranks, pattern)
        for batch in batches:
            ids = [b"".join(parts) for parts in known.of(rows_of(batch, "text"))]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "ids"])

    return map_arrow(docs, ["doc_id", "text"], work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Per row doc_id, ids, and ``decoded``, the bytes of their tokens in a row. Null ids decode to no bytes; an id that is no
    token is an error. One pass without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, starts, sizes = _token_bytes(ranks)
        for batch in batches:
            listed = batch.column(1)
            ids = listed.flatten().to_numpy(zero_copy_only=False)
            lengths = sizes[ids]
            if len(ids) and lengths.min() == 0:
                raise ValueError("an id is no token of this vocabulary")
            upto = np.concatenate([[0], np.cumsum(lengths)])
            # Byte by byte: where its token begins in the row of all tokens, and how far into the token it is.
            raw = letters[np.repeat(starts[ids] - upto[:-1], lengths) + np.arange(upto[-1])].tobytes()
            bounds = upto[np.cumsum([0, *(n.as_py() or 0 for n in listed.value_lengths())])].tolist()
            decoded = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(encoded, ["doc_id", "ids"], work, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per row doc_id, n_tokens, and digests of the ids that ``encode`` gives and of the bytes that ``decode`` makes of them."""
    written = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return decode(encode(docs, ranks, pattern), ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
