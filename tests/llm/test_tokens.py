"""Packing, plane files, prefix encoding and edit counts against the tokenizers library."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from emberline.llm import chunks, edit_counts, packing, prefix_bpe, token_files

from .conftest import listed

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path, texts):
    t = Tokenizer.from_file(path)
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(params=["given", "odd"])
def docs(request, given, odd):
    return given[0] if request.param == "given" else odd


def test_pieces_hold_every_id_once_and_sequences_have_no_gap(docs):
    rows = listed(docs)
    want = Counter((i, len(ids) + 1, crc(ids + [0])) for (i, _), (ids, _) in zip(rows, library(BYTES, [t for _, t in rows])))
    tokens = {}
    for (i, t), (ids, _) in zip(rows, library(BYTES, [t for _, t in rows])):
        tokens[i, len(ids) + 1] = ids + [0]
    sequences, starts = {}, {}
    for p in packing.pack(docs, BYTES, public_tokenizers.PATTERN).collect():
        ids = tokens[p.doc_id, p.doc_tokens]
        assert p.length > 0 and crc(ids[p.start : p.start + p.length]) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        starts.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded
    copies = Counter((i, n) for i, n, _ in want.elements())
    assert set(copies) == set(starts)
    for key, parts in starts.items():
        assert sum(n for _, n in parts) == key[1] * copies[key]
        assert sorted(set(parts)) == sorted(parts[: len(set(parts))] if copies[key] == 1 else set(parts))


def test_sequences_can_be_put_together_and_documents_taken_out(spark, docs):
    import corpus_pipeline

    parts, sequences = [], {}
    for p in corpus_pipeline.packed(spark, docs, "").collect():
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and crc(ids) == p.ids_crc32
        parts.append((p.doc_id, p.doc_tokens, p.start, tuple(ids)))
        sequences.setdefault(p.sequence_id, []).append((p.offset, ids))
    want = Counter()
    for (i, _), (ids, _) in zip(listed(docs), library(BYTES, [t for _, t in listed(docs)])):
        ids, at = ids + [0], 0
        for n in packing.cuts(len(ids)):
            want[i, len(ids), at, tuple(ids[at : at + n])] += 1
            at += n
    assert Counter(parts) == want
    assert all(len(sum((ids for _, ids in sorted(s)), [])) <= packing.CAPACITY for s in sequences.values())


def test_encoding_hands_on_ids_and_text(docs):
    rows = listed(docs)
    want = Counter((i, tuple(ids), text) for (i, _), (ids, text) in zip(rows, library(WORDS, [t for _, t in rows])))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.text) for r in prefix_bpe.encode(docs, WORDS).collect()) == want


def test_cuts_are_whole_bins_and_binary_digits():
    assert packing.cuts(2048 + 5) == [1024, 1024, 4, 1]
    assert packing.cuts(0) == []
    with pytest.raises(ValueError):
        packing.slots(1000)


def test_plane_files_give_back_the_library_ids_in_order(docs):
    rows = sorted(listed(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    got = token_files.written_and_read(docs, WORDS).collect()
    got = sorted(got, key=lambda x: x.start)
    assert [g.doc_id for g in got] == [i for i, _ in rows]
    at = 0
    for g, (ids, _) in zip(got, library(WORDS, [t for _, t in rows])):
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids) + 1, crc(ids + [1]))
        at += len(ids) + 1


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (token_files.from_planes(token_files.to_planes(ids, kind), n) == ids).all()
    sink = io.BytesIO()
    writer = token_files.PlaneWriter(sink, kind, block_ids=64)
    writer.add(None, ids.astype("<u4").tobytes())
    writer.add(3, np.array([5, 6], "<u4").tobytes())
    writer.close()
    raw = sink.getvalue()
    reader = token_files.PlaneReader(pa.BufferReader(raw))
    (a, x), (b, y) = reader.documents()
    assert (a, b) == (None, 3) and (x == ids).all() and y.tolist() == [5, 6]
    assert n < 64 or (reader.block(1) == np.concatenate([ids, [5, 6]])[64:128]).all()
    with pytest.raises(ValueError):
        token_files.PlaneReader(pa.BufferReader(raw[:-3]))


def test_prefix_encoding_is_the_library_encoding(docs):
    rows = listed(docs)
    want = Counter((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for (i, _), (ids, text) in zip(rows, library(WORDS, [t for _, t in rows])))
    assert Counter(tuple(r) for r in prefix_bpe.encode_and_decode(docs, WORDS).collect()) == want


def test_prefix_encoding_of_hard_words():
    r = random.Random(1)
    texts = ["".join(r.choice("abinthe") for _ in range(r.randint(1, 30))) for _ in range(3000)] + ["a" * 4000, "thethe" * 300, "é́́", "Ǆ", "x<|startoftext|>y", "'s'll've don't I'M"]
    got = prefix_bpe.word_chunks(WORDS).of(texts)
    for parts, (ids, text) in zip(got, library(WORDS, texts)):
        assert b"".join(p[0] for p in parts) == np.array(ids, "<u4").tobytes()
        assert prefix_bpe.decode(parts) == text


def test_chunk_ids_are_text_ids_whatever_the_white_space():
    r = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "　", "a", "Word", "12", ".", ",", "'s", "é", "́", "!", "|", "<|endoftext|>", "日"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    for path, spaced in ((BYTES, True), (WORDS, False)):
        for got, (ids, _) in zip(chunks.library_ids(path, spaced).of(texts), library(path, texts)):
            assert b"".join(got) == np.array(ids, "<u4").tobytes()


def test_edits_are_counted_as_encoding_all_anew(given):
    held, t, r = chunks.library_ids(BYTES, True), Tokenizer.from_file(BYTES), random.Random(3)
    texts = [x for _, x in listed(given[0])][:60] + ["", " ", "a", "\n\n x \n x"]
    for tree, text in zip(edit_counts.counted(texts, held), texts):
        for _ in range(10):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.choice([0, 1, 5, 40, 400, 3000]))
            insert = r.choice(["", " ", "  ", "word", "\n", "x y z " * 40, "é\xa0 ", ", ", " \n "])
            text = text[:a] + insert + text[b:]
            tree.edit(a, b, insert)
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(t.encode(text, add_special_tokens=False).ids)
    with pytest.raises(ValueError):
        tree.edit(0, 10**9, "")


def test_cleaning_counts(spark, docs):
    def cleaned(text):
        for a, b, insert in edit_counts.cleaning_edits(text):
            text = text[:a] + insert + text[b:]
        return text

    rows = [(i, t or "") for i, t in listed(docs)]
    after = [cleaned(t) for _, t in rows]
    want = Counter((i, len(x), len(edit_counts.cleaning_edits(t)), len(y), len(c)) for (i, t), (x, _), (y, _), c in zip(rows, library(BYTES, [t for _, t in rows]), library(BYTES, after), after))
    assert Counter(tuple(r)[:5] for r in edit_counts.after_cleaning(docs, BYTES).collect()) == want


def test_work_grows_with_the_edits():
    held, t = chunks.library_ids(BYTES, spaced=True), Tokenizer.from_file(BYTES)
    for n in (200, 1600):
        text = " ".join(f"words before number {k} and then mail{k}@host{k}.example.org in a line of text, some more of it\nhere and there" for k in range(n))
        (tree,) = edit_counts.counted([text], held)
        for a, b, insert in edit_counts.cleaning_edits(text):
            tree.edit(a, b, insert)
            text = text[:a] + insert + text[b:]
        assert tree.encoded < 3 * len(text) and tree.text() == text
        assert tree.n_tokens == len(t.encode(text, add_special_tokens=False).ids)
    # Growing at one place: the tree is built anew now and then, and its segments stay small.
    for _ in range(300):
        tree.edit(900, 900, " put in a few more words here,")
        text = text[:900] + " put in a few more words here," + text[900:]
    assert tree.text() == text and tree.n_tokens == len(t.encode(text, add_special_tokens=False).ids)
    assert max(len(chunks.SPACED.findall(s)) for s in tree.segments) <= 2 * edit_counts.SEGMENT_CHUNKS + 8
    # Down to nothing and up again.
    tree.edit(0, len(text), "")
    assert (tree.n_tokens, tree.text()) == (0, "")
    tree.edit(0, 0, "new words")
    assert tree.n_tokens == 2


def test_given_edits(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "left alone")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, None), (1, 1, 4, 7, "2"), (2, 1, 0, 0, "new words")], "doc_id long, seq int, start int, end int, insert string")
    t = Tokenizer.from_file(BYTES)
    got = {r.doc_id: (r.n_edits, r.n_tokens_after) for r in edit_counts.after_edits(docs, edits, BYTES).collect()}
    assert got == {1: (2, len(t.encode(" 2 three").ids)), 2: (1, len(t.encode("new words").ids)), 3: (0, len(t.encode("left alone").ids))}


def test_empty_tables(none):
    for df in (packing.pack(none, BYTES, public_tokenizers.PATTERN), token_files.written_and_read(none, WORDS), prefix_bpe.encode_and_decode(none, WORDS), edit_counts.after_cleaning(none, BYTES)):
        assert df.count() == 0
