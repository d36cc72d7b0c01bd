"""Byte-pair encoding of many words at once, over a trie of their prefixes.

The encoding of a prefix ends in exactly one token, and a token can follow another exactly if merging the two texts
together would not have joined across their border. So a prefix needs to keep one thing, its last token: the last token of
a longer prefix is the one vocabulary suffix that may follow the last token of what is before it. Distinct words in
sorted order are the trie in depth-first order: a stack holds the last tokens along the current path, and a word starts
from the part of the stack it shares with the word before it. The last symbol of a word is its own kind of edge, as the
vocabulary marks word ends.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import WORDS, Chunks
from .common import map_arrow, rows_of

#: Words, and pairs of tokens, that a worker remembers before it starts again.
KEPT_WORDS = 300_000


class PrefixBpe:
    """Merges of a vocabulary file whose token numbers follow the order of its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_mark: str):
        self.vocab, self.end = vocab, end_mark
        self.joined = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in reversed(merges)}
        self.order = {vocab[a + b]: k + 1 for k, (a, b) in reversed(list(enumerate(merges)))}
        self.follows: dict[tuple[int, int], bool] = {}
        self.inner, self.final = self._backwards(False), self._backwards(True)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' texts together gives these two tokens: undo their merges, the latest first,
        and look whether a pair across the border would have merged earlier than what is undone."""
        a, b, before, answer = left, right, len(self.parts) + 1, True
        order = self.order
        while True:
            pair = self.joined.get((a, b))
            if pair is not None and order[pair] < before:
                answer = False
                break
            ra, rb = order.get(a, 0), order.get(b, 0)
            if ra == rb == 0:
                break
            # Pairs further left merge first when two have the same order, so the left token's own merge comes first.
            if ra > rb:
                before, a = ra, self.parts[a][1]
            else:
                before, b = rb + 1, self.parts[b][0]
        self.follows[left, right] = answer
        return answer

    def _last(self, word: str, upto: int, last: list[int], ends: dict) -> tuple[int, int]:
        """The last token of ``word[:upto]`` and its length, given the last tokens of shorter prefixes. ``ends`` holds the
        vocabulary backwards: walking it finds the tokens the prefix ends in."""
        found, n = [], 0
        for n in range(1, upto + 1):
            ends = ends.get(word[upto - n])
            if ends is None:
                break
            token = ends.get("")
            if token is not None:
                found.append((token, n))
        follows = self.follows
        for token, n in reversed(found):
            if upto > n:
                fits = follows.get((last[upto - n], token))
                if fits is None:
                    fits = self.may_follow(last[upto - n], token)
                if not fits:
                    continue
            return token, n
        raise ValueError(f"no token ends {word[:upto]!r}")

    def _whole(self, token: int) -> bool:
        """Whether a token's own text encodes to it: merge its symbols, the earliest merge first."""
        symbols = self._symbols(token)
        while len(symbols) > 1:
            pairs = [(self.order.get(self.joined.get(p, -1), len(self.vocab)), k) for k, p in enumerate(zip(symbols, symbols[1:]))]
            first, k = min(pairs)
            if first == len(self.vocab):
                break
            symbols[k : k + 2] = [self.joined[symbols[k], symbols[k + 1]]]
        return symbols == [token]

    def _backwards(self, marked: bool) -> dict:
        """Tokens with or without the end mark, by their symbols from the last to the first; ``""`` holds the token."""
        root: dict = {}
        for text, token in self.vocab.items():
            if text.endswith(self.end) != marked or not self._whole(token):
                continue
            node = root
            for symbol in reversed(text.removesuffix(self.end) if marked else text):
                node = node.setdefault(symbol, {})
            node[""] = token
        return root

    def _symbols(self, token: int) -> list[int]:
        if token not in self.parts:
            return [token]
        a, b = self.parts[token]
        return self._symbols(a) + self._symbols(b)

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of distinct non-empty words in ascending order."""
        last, sizes, before = [0], [0], ""
        for word in words:
            shared = min(len(commonprefix((before, word))), len(last) - 1, len(word) - 1)
            del last[shared + 1 :], sizes[shared + 1 :]
            for upto in range(shared + 1, len(word)):
                token, n = self._last(word, upto, last, self.inner)
                last.append(token)
                sizes.append(n)
            token, n = self._last(word, len(word), last, self.final)
            ids, at = [token], len(word) - n
            while at:
                ids.append(last[at])
                at -= sizes[at]
            yield ids[::-1]
            before = word


class WordBpe:
    """The whole of a word-end vocabulary file: special strings, normalisation, pattern, merges and names of tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = PrefixBpe(model["vocab"], merges, model["end_of_word_suffix"])
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        library = Tokenizer.from_file(path)
        self.normalize, self.pretokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.words: dict[str, list[int]] = {}

    def pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a chunk, or the number of a special string in it."""
        out: list[str | int] = []
        for part in self.cut.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = part.lower() if part.isascii() else self.normalize(part)
                out += [plain] if plain.isascii() and plain.isalpha() else [w for w, _ in self.pretokenize(plain)]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Each chunk's ids as bytes, and their names joined by spaces."""
        split = [self.pieces(c) for c in chunks]
        new = sorted({p for ps in split for p in ps if isinstance(p, str) and p not in self.words})
        self.words.update(zip(new, self.bpe.encode_sorted(new)))
        out = []
        for ps in split:
            ids = [i for p in ps for i in (self.words[p] if isinstance(p, str) else (p,))]
            out.append((np.array(ids, "<u4").tobytes(), " ".join(map(self.names.__getitem__, ids))))
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        if len(self.bpe.follows) > KEPT_WORDS:
            self.bpe.follows = {}
        return out


_LOADED: dict[str, Chunks] = {}


def word_chunks(path: str) -> Chunks:
    if path not in _LOADED:
        _LOADED[path] = Chunks(WORDS, WordBpe(path).encode_chunks)
    return _LOADED[path]


def decode(parts: list[tuple[bytes, str]]) -> str:
    """The names of the tokens joined by spaces: this vocabulary file names no decoder."""
    return " ".join(name for _, name in parts if name)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row doc_id, ids as little-endian unsigned 32-bit bytes, and the text they decode to.

    Null and empty texts have no ids and decode to an empty text. Repeated rows and null doc_ids give a row each; an empty
    table none; other columns aren't read. One pass without a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = word_chunks(vocabulary)
        for batch in batches:
            split = chunks.of(rows_of(batch, "text"))
            ids = [b"".join([p[0] for p in parts]) for parts in split]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), "text": pa.array(map(decode, split), pa.string())})

    return map_arrow(docs, ["doc_id", "text"], work, "doc_id long, ids binary, text string")


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row doc_id, n_tokens and digests of what ``encode`` gives."""
    found = encode(docs, vocabulary)
    return found.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
