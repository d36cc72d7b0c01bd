"""Words of the word vocabulary, cut into pieces, against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from emberline.llm import chunks

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = "aAzZsStTrRevVmlLdD''''0123456789.,!?;:|)(\"<>-_~`^ \t\n\x1c\x1f\x85\xa0\xa1\xaa\xab\xb5\xba\xbb\xbf\xc0\xc9\xd7\xdf\xe9\xf7\xffİı̇̈–—‘’“”„…　Åω٣\xbd"


def test_words_in_pieces_are_the_library_s():
    r = random.Random(1)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randrange(25))) for _ in range(5_000)]
    texts += ["a<|endoftext|>b", "<|STARTOFTEXT|>", "don't l'eau 'S 'Re!'s", "!'s''t", "ǺB é", None]
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    held = chunks.library_ids(WORDS, spaced=False)
    assert [b"".join(x) for x in held.of(texts)] == want == [b"".join(x) for x in held.of(texts)]


def test_new_words_of_known_pieces_ask_for_nothing():
    asked, whole = [], []

    class Token:
        id = 7

    def piece(text):
        asked.append(text)
        return [Token]

    def encode(texts):
        whole.extend(texts)
        return [b"x"] * len(texts)

    of = chunks.in_pieces(encode, piece)
    assert of(["One,", "two", "ω"])[2] == b"x" and whole == ["ω"]
    n = len(asked)
    assert n == 3 and of(["one", "(Two,one)"])[1] == of(["(two,ONE)"])[0]
    assert len(asked) == n + 2 and len(whole) == 1  # the brackets


def test_other_vocabularies_keep_the_library_for_whole_chunks():
    assert chunks._has_word_rules(WORDS) and not chunks._has_word_rules(BYTES)
