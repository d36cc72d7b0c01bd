"""Quality rules: base counts of a text, and how public vocabularies take to it.

Fertility is measured over a text's words in two public vocabularies: characters per token and the entropy of the tokens
used (byte-level vocabulary), and the share of tokens that are bare bytes (vocabulary with byte fallback). Each language
has its own bands; where the language isn't known, the script most letters belong to decides. A text outside any band goes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import SPACED, Chunks
from .common import map_arrow, mixed, rows_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
WINDOW = 5


class Bands(NamedTuple):
    """What a text may measure: characters per token, share of byte tokens, and entropy of tokens (``entropies``), the
    least of it for texts of each length in ``ENTROPY_AT``."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: tuple[float, ...]


#: Lengths in tokens at which a band gives the least entropy; it is linear in the length's logarithm between them, level beyond.
ENTROPY_AT = (128, 256, 512, 1024, 2048, 4096)
#: By language, from texts labelled good and not held out at sf0.1 (en 1,361, de 326, fr 322, es 201): least entropy three standard
#: deviations below the mean of texts of that length (two Spanish ones near 128 tokens: near the lowest of 128 to 255), characters per
#: token near their lowest 0.2 to 0.5 %. Prose of real words lies above both. No given text has a byte token.
BANDS = {
    "en": Bands(2.38, 8.0, 0.05, (0.775, 0.730, 0.705, 0.730, 0.750, 0.765)),
    "de": Bands(2.20, 8.0, 0.05, (0.770, 0.700, 0.690, 0.710, 0.730, 0.735)),
    "fr": Bands(2.03, 8.0, 0.05, (0.730, 0.690, 0.675, 0.685, 0.705, 0.720)),
    "es": Bands(1.96, 8.0, 0.05, (0.715, 0.680, 0.660, 0.695, 0.705, 0.720)),
}
#: By script, for other languages: Latin takes the lowest entropy of the four. Its characters per token and the other scripts' bands
#: aren't measured, as no given text is in such a language. The byte-level vocabulary knows few letters beyond Latin and spends bytes on them.
SCRIPTS = {
    "latin": Bands(1.3, 10.0, 0.20, tuple(map(min, zip(*(b.least_entropy for b in BANDS.values()))))),
    "other": Bands(0.25, 10.0, 0.90, (0.45,) * len(ENTROPY_AT)),
}
#: The shortest texts can't be told by entropy: below so many tokens that band doesn't hold, and characters per token may be a quarter less.
ENTROPY_TOKENS, SHORT = 40, 0.75
#: The entropy of prose levels off, so from so many tokens on a longer text isn't expected to have more.
ENTROPY_MOST = 512

def bands_of(lang: str | None, text: str) -> Bands:
    if lang in BANDS:
        return BANDS[lang]
    letters = sum(map(str.isalpha, text))
    latin = sum(c.isalpha() and c < "\u0250" for c in text)
    return SCRIPTS["latin" if 2 * latin >= letters else "other"]


def inside(bands: list[Bands], tokens: np.ndarray, per_token: np.ndarray, bare: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    """Whether each text's measures lie in its bands."""
    at, length = np.log2(ENTROPY_AT), np.log2(np.maximum(tokens, 1))
    least = np.array([np.interp(n, at, b.least_entropy) for n, b in zip(length, bands)])
    low, high, share = np.array([b[:3] for b in bands]).reshape(-1, 3).T
    short = tokens < ENTROPY_TOKENS
    return (per_token >= np.where(short, SHORT * low, low)) & (per_token <= high) & (bare <= share) & (short | (entropy >= least))


_LOADED: dict[tuple[str, str], Chunks] = {}


def measured_chunks(byte_level: str, with_fallback: str) -> Chunks:
    """Chunk -> (ids in the byte-level vocabulary, pieces in the other one, how many of those are bare bytes)."""
    if (byte_level, with_fallback) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(byte_level)
        tokenizer.encode_special_tokens = True
        pieces = sentencepiece.SentencePieceProcessor(model_file=with_fallback)
        bare = np.array([pieces.is_byte(k) for k in range(pieces.vocab_size())])

        def encode(chunks: list[str]) -> list[tuple[bytes, int, int]]:
            first = tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
            second = pieces.encode([c.strip() for c in chunks], num_threads=1)
            out = []
            for a, b in zip(first, second):
                out.append((np.array(a.ids, "<u4").tobytes(), len(b), sum(bare[i] for i in b if i < 259)))
            return out

        _LOADED[byte_level, with_fallback] = Chunks(SPACED, encode, kept=250_000)
    return _LOADED[byte_level, with_fallback]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, how many words lie in a window of five that its text has twice or more, the first included."""
    counts = np.array([len(w) for w in words], np.int64)
    own = np.repeat(np.arange(len(words), dtype=np.uint64), counts)
    flat = np.fromiter((hash(x) for w in words for x in w), np.int64, counts.sum()).view(np.uint64)
    covered = np.zeros(len(flat), bool)
    n = len(flat) - WINDOW + 1
    if n > 0:
        key = mixed(own[:n] + np.uint64(1))
        for k in range(WINDOW):
            key = mixed(key ^ flat[k : k + n]) + np.uint64(k)
        inside = own[:n] == own[WINDOW - 1 :]
        places = np.flatnonzero(inside)
        _, which, times = np.unique(key[places], return_inverse=True, return_counts=True)
        again = places[times[which] > 1]
        for k in range(WINDOW):
            covered[again + k] = True
    return _sums(covered, counts)


def entropies(ids: list[np.ndarray]) -> np.ndarray:
    """Entropy of each text's tokens in bits, as a share of that of as many different tokens, at most ``ENTROPY_MOST``."""
    counts = np.array([len(i) for i in ids], np.int64)
    if not counts.sum():
        return np.zeros(len(ids))
    own = np.repeat(np.arange(len(ids), dtype=np.int64), counts)
    pairs, times = np.unique((own << 32) | np.concatenate(ids), return_counts=True)
    text = pairs >> 32
    p = times / counts[text]
    bits = np.bincount(text, -p * np.log2(p), len(ids))
    return bits / np.log2(np.clip(counts, 2, ENTROPY_MOST))


def measure(texts: list[str], chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, characters per token, share of byte tokens and relative entropy of each text."""
    parts = chunks.of(texts)
    ids = [np.frombuffer(b"".join([p[0] for p in ps]), "<u4").astype(np.int64) for ps in parts]
    n = np.array([len(i) for i in ids])
    pieces = np.array([sum(p[1] for p in ps) for ps in parts])
    bare = np.array([sum(p[2] for p in ps) for ps in parts])
    chars = np.array([len(t) for t in texts])
    return n, chars / np.maximum(n, 1), bare / np.maximum(pieces, 1), entropies(ids)


def rules(docs: DataFrame, byte_level: str, with_fallback: str) -> DataFrame:
    """Per row the base counts, base_failed, kept and the measures behind the verdict.

    Null texts have no words and fail, like empty ones. A null or unknown lang takes the bands of the script. Repeated rows
    and null doc_ids give a row each; an empty table none. Only doc_id, text and lang are read, whatever else is there.
    One pass without a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = measured_chunks(byte_level, with_fallback)
        for batch in batches:
            texts = [t or "" for t in rows_of(batch, "text")]
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at just the blanks
            n_words = np.array([len(w) for w in words], np.int64)
            chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64)
            symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
            lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
            same = np.array([len(x) - len(set(x)) for x in lines], np.int64)
            again = repeated_words(words).astype(np.int64)
            failed = (n_words < LEAST_WORDS) | (100 * again > MOST_REPEATED_PERCENT * n_words)
            tokens, per_token, bare, entropy = measure(texts, chunks)
            within = inside([bands_of(x, t) for x, t in zip(rows_of(batch, "lang"), texts)], tokens, per_token, bare, entropy)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": same, "n_repeat_words": again,
                "base_failed": failed, "kept": ~failed & within, "n_tokens": tokens.astype(np.int64), "chars_per_token": per_token, "byte_share": bare.astype(np.float64), "entropy": entropy,
            })

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, entropy double"
    return map_arrow(docs, ["doc_id", "text", "lang"], work, schema)
