"""Token counts that follow edits.

A text is kept as a row of segments under a tree of sums: how many characters and tokens each subtree has. Segments end where
white space follows other text, where the vocabulary always ends a piece, so the tokens of a text are those of its segments
together. An edit finds its segments by walking the character sums and re-encodes these; where it has changed what makes an outer
border one (white space after other text), the next segment on that side is context and is encoded again with them. The region is cut
into segments again, which go back to their places under the tree, and the sums are updated on the way up. Places are added, and the
tree is built anew over the known sums, only where an edit has put in more text than they take. Nothing else is encoded again, so work
grows with the edits; a run without white space is one segment, however long.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import SPACE, Chunks, library_ids
from .common import map_arrow, rows_of

#: Chunks (white space and a word) in a segment, before edits.
SEGMENT_CHUNKS = 32
_BLANK = re.compile(f"[{SPACE}]")

#: What the cleaning edits mask: e-mail addresses and long numbers.
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"\+?\d[\d ()-]{6,}\d")

Edit = tuple[int, int, str]


def _starts(chunks: list[str], per_segment: int = SEGMENT_CHUNKS) -> list[int]:
    """Where segments of about ``per_segment`` chunks begin."""
    starts: list[int] = []
    for k in range(0, len(chunks), per_segment):
        while k < len(chunks) and k and not _BLANK.match(chunks[k]):
            k += 1
        if k < len(chunks) and (not starts or k > starts[-1]):
            starts.append(k)
    return starts


class CountedText:
    """A text's segments under a binary tree of character and token sums."""

    def __init__(self, chunks: list[str], ids: list[bytes], count: Callable[[str], tuple[list[str], list[bytes]]]):
        self.count = count
        self.encoded = 0
        self.segments, tokens = self._cut(chunks, ids, SEGMENT_CHUNKS)
        self._build(np.array(tokens, np.int64))

    @staticmethod
    def _cut(chunks: list[str], ids: list[bytes], per_segment: int) -> tuple[list[str], list[int]]:
        starts = _starts(chunks, per_segment)
        spans = list(zip(starts, [*starts[1:], len(chunks)]))
        return ["".join(chunks[a:b]) for a, b in spans], [sum(map(len, ids[a:b])) // 4 for a, b in spans]

    def _build(self, tokens: np.ndarray) -> None:
        """The tree over the segments, whose tokens are known."""
        self.size = 1 << max(0, (max(1, len(self.segments)) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(self.segments)] = list(map(len, self.segments))
        self.tokens[self.size : self.size + len(self.segments)] = tokens
        width = self.size
        while width > 1:
            half = width // 2
            for sums in (self.chars, self.tokens):
                sums[half:width] = sums[width : 2 * width].reshape(-1, 2).sum(axis=1)
            width = half

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.segments)

    def _find(self, at: int) -> tuple[int, int]:
        """The segment that holds character ``at`` (the last one for the text's end), and how many characters are before it."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def _set(self, k: int, segment: str, tokens: int) -> None:
        self.segments[k] = segment
        node = self.size + k
        chars, tokens = len(segment) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, start: int, end: int, insert: str) -> None:
        """Put ``insert`` in place of characters ``start`` to ``end``."""
        if not 0 <= start <= end <= self.n_chars:
            raise ValueError(f"no characters {start} to {end} in a text of {self.n_chars}")
        if not self.segments:
            self.segments = [""]
        first, before = self._find(start)
        last, _ = self._find(max(start, end - 1))
        region = "".join(self.segments[first : last + 1])
        region = region[: start - before] + insert + region[end - before :]
        # A border holds where white space follows other text. The neighbour's side of it is as it was. Emptied segments are passed over.
        while first > 0 and not (region and _BLANK.match(region)):
            first -= 1
            region = self.segments[first] + region
        while last + 1 < len(self.segments) and not (region and not _BLANK.match(region[-1])):
            last += 1
            region += self.segments[last]
        self.encoded += len(region)
        places = last + 1 - first
        chunks, ids = self.count(region)
        own = max(SEGMENT_CHUNKS, -(-len(chunks) // places))
        segments, tokens = self._cut(chunks, ids, own if own <= 2 * SEGMENT_CHUNKS else SEGMENT_CHUNKS)
        if len(segments) <= places:
            empty = places - len(segments)
            for k, (segment, n) in enumerate(zip(segments + [""] * empty, tokens + [0] * empty), start=first):
                if segment or self.segments[k]:
                    self._set(k, segment, n)
        else:
            known = self.tokens[self.size : self.size + len(self.segments)]
            known = np.concatenate([known[:first], tokens, known[last + 1 :]])
            self.segments[first : last + 1] = segments
            filled = np.array([bool(s) for s in self.segments])
            self.segments = [s for s in self.segments if s]
            self._build(known[filled])


def counted(texts: list[str | None], chunks: Chunks) -> list[CountedText]:
    """The trees of a batch of texts."""

    def count(text: str) -> tuple[list[str], list[bytes]]:
        return chunks.pattern.findall(text), chunks.of([text])[0]

    ids = chunks.of(texts)
    return [CountedText(chunks.pattern.findall(t or ""), i, count) for t, i in zip(texts, ids)]


def cleaning_edits(text: str) -> list[Edit]:
    """Edits that mask addresses and long numbers and take out lines that repeat an earlier one, the last first, so that each one's
    positions hold when it is made."""
    edits: list[Edit] = []
    gone: list[tuple[int, int]] = []
    seen, at = set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip() and line in seen:
            gone.append((max(0, at - 1), end))
        seen.add(line)
        at = end + 1
    edits += [(a, b, "") for a, b in gone]
    taken = bytearray(len(text))
    for a, b in gone:
        taken[a:b] = b"\1" * (b - a)
    for pattern, mark in ((MAIL, "<mail>"), (NUMBER, "<number>")):
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(taken[a:b]):
                edits.append((a, b, mark))
                taken[a:b] = b"\1" * (b - a)
    return sorted(edits, reverse=True)


SCHEMA = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded_again long"


def _counts(ids: list, texts: list, edits: list[list[Edit]], chunks: Chunks) -> pa.RecordBatch:
    out = []
    for doc_id, tree, own in zip(ids, counted(texts, chunks), edits):
        before = tree.n_tokens
        for start, end, insert in own:
            tree.edit(start, end, insert)
        out.append((doc_id, before, len(own), tree.n_tokens, tree.n_chars, tree.encoded))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 6)], names)


def after_cleaning(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row the tokens of the whole text, and those after the cleaning edits, counted by re-encoding what these touch.

    Null texts are empty: no tokens, no edits. Repeated rows and null doc_ids give a row each; an empty table none. Only
    doc_id and text are read. One pass without a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library_ids(vocabulary, spaced=True)
        for batch in batches:
            texts = [t or "" for t in rows_of(batch, "text")]
            yield _counts(rows_of(batch, "doc_id"), texts, [cleaning_edits(t) for t in texts], chunks)

    return map_arrow(docs, ["doc_id", "text"], work, SCHEMA)


def after_edits(docs: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """As ``after_cleaning`` for given edits (doc_id, seq, start, end, insert), made in the order of ``seq``; positions count
    in the text as the edits before left it. A text's edits are gathered beside it; a document without edits keeps its count.
    """
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", F.coalesce("insert", F.lit("")).alias("insert")))).alias("edits"))
    joined = docs.select("doc_id", "text").join(own, "doc_id", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library_ids(vocabulary, spaced=True)
        for batch in batches:
            made = [[(e["start"], e["end"], e["insert"]) for e in own or ()] for own in rows_of(batch, "edits")]
            yield _counts(rows_of(batch, "doc_id"), rows_of(batch, "text"), made, chunks)

    return map_arrow(joined, ["doc_id", "text", "edits"], work, SCHEMA)
