"""Token ids of whole texts through the ids of their chunks.

A chunk is a run of white space with the word after it (``SPACED``) or a word alone (``WORDS``); plain punctuation after
letters is a chunk of its own. The vocabularies' own patterns always end a piece at these places, so the ids of a text are
those of its chunks in a row. Words repeat; a worker keeps the ids of chunks it has met lately, a bounded number of them,
and asks the library for new ones only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

#: White space as the vocabularies' patterns know it, letters of Latin scripts, and punctuation no contraction begins with.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
MARKS = ',.!?;:|)"'
SPACED = re.compile(f"[{SPACE}]*[{LETTERS}]+(?=[{MARKS}])|[{MARKS}]+(?=[{SPACE}])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORDS = re.compile(f"[{LETTERS}]+(?=[{MARKS}])|[{MARKS}]+(?=[{SPACE}])|[^{SPACE}]+")
KEPT = 700_000


class Chunks:
    """Chunk -> what ``encode`` gives for it, over batches of texts. Holds two generations of ``kept`` chunks at most."""

    def __init__(self, pattern: re.Pattern, encode: Callable[[list[str]], list], kept: int = KEPT, split: Callable[[str], list[str]] | None = None):
        self.pattern, self.encode, self.kept, self.young, self.old = pattern, encode, kept, {}, {}
        self.split = split or pattern.findall

    def of(self, texts: list[str | None]) -> list[list]:
        split = [self.split(t or "") for t in texts]
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        absent = set().union(*split).difference(young)
        new = []
        for c in absent:
            if c in old:
                young[c] = old[c]
            else:
                new.append(c)
        if new:
            young.update(zip(new, self.encode(new)))
        get = young.__getitem__
        return [list(map(get, chunks)) for chunks in split]


#: The rules of the word vocabulary, as its file states them: what is done to a text, and how it is cut.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of these characters, all composed and without white space, ``<`` or digits and letters beyond Latin, is cut by ``PIECES`` in lower case as by the rules.
PLAIN = re.compile(f"[!-;=-~{LETTERS}\xa1\xab\xbb\xbf\u2013\u2014\u2018\u2019\u201c-\u201e\u2026]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: What Python takes for white space and the vocabularies don't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def words(text: str) -> list[str]:
    """The text between white space; cut by ``WORDS`` where Python's white space is another."""
    return WORDS.findall(text) if SEPARATORS.search(text) else text.split()


#: The character by which a byte-level model knows a byte: printable ones their own, the others those from 256 on.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _OWN} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_OWN)))}


def in_pieces(encode: Callable[[list[str]], list[bytes]], of_piece: Callable[[str], list], kept: int = KEPT) -> Callable[[list[str]], list[bytes]]:
    """Ids of words. A plain word is cut here, and the library's model gives the tokens of pieces not met lately: many words share few pieces.
    Other words are ``encode``'s."""
    known: dict[str, bytes] = {}

    def of(chunks: list[str]) -> list[bytes]:
        other = [c for c in chunks if not PLAIN.fullmatch(c)]
        whole = dict(zip(other, encode(other))) if other else {}
        if len(known) > kept:
            known.clear()
        out = []
        for c in chunks:
            ids = whole.get(c)
            if ids is None:
                parts = []
                for piece in PIECES.findall(c.lower()):
                    part = known.get(piece)
                    if part is None:
                        as_bytes = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
                        part = known[piece] = np.array([t.id for t in of_piece(as_bytes)], "<u4").tobytes()
                    parts.append(part)
                ids = b"".join(parts)
            out.append(ids)
        return out

    return of


def _has_word_rules(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    by_pattern = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    return (
        (rules.get("normalizer") or {}).get("normalizers") == WORD_NORMALIZER
        and len(cut) == 2 and cut[0] == by_pattern and level.items() <= cut[1].items()
        and rules.get("post_processor") is None and (rules["model"].get("type"), rules["model"].get("dropout")) == ("BPE", None)
        and all("<" in t["content"] for t in rules["added_tokens"])
    )


_LOADED: dict[tuple, Chunks] = {}


def library_ids(path: str, spaced: bool) -> Chunks:
    """Chunk -> its ids as little-endian unsigned 32-bit bytes, from the tokenizers library."""
    if (path, spaced) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a worker on each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(chunks: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

        if not spaced and _has_word_rules(path):
            _LOADED[path, spaced] = Chunks(WORDS, in_pieces(encode, tokenizer.model.tokenize), split=words)
        else:
            _LOADED[path, spaced] = Chunks(SPACED if spaced else WORDS, encode)
    return _LOADED[path, spaced]
