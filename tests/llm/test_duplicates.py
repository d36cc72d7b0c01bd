"""Near-duplicates, repeated strings and near vectors against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import chosen_path, graph, grid_join, suffix_dedup

from .conftest import listed


class Groups:
    def __init__(self):
        self.above = {}

    def of(self, x):
        while self.above.setdefault(x, x) != x:
            x = self.above[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.of(a), self.of(b)))
        self.above[b] = a


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    size = min(5, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else frozenset()


def near_by_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    holders, groups, shared = collections.defaultdict(list), Groups(), collections.Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[:k]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            groups.link(a, b)
    return sorted((i, len(s), groups.of(i), groups.of(i) == i) for i, s in sets.items())


def near(df):
    return sorted(tuple(r) for r in chosen_path.near_duplicates(df).collect())


def test_near_duplicates_of_the_given_documents(given):
    assert near(given[0]) == near_by_force(listed(given[0]))


def edited(r, words, share):
    return " ".join(r.choice("abcdefgh") + str(r.randint(0, 999)) if r.random() < share else w for w in words)


def test_chains_passages_and_a_large_group(spark):
    """A group with many different near copies, chains around the threshold, and unrelated texts with one long passage in common."""
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    texts, base = [], fresh(120)
    texts += [edited(r, base, r.choice([0.005, 0.01, 0.02, 0.03])) for _ in range(150)]
    for _ in range(12):
        words = fresh(90)
        for _ in range(6):
            words = edited(r, words, 0.02).split()
            texts.append(" ".join(words))
    passage = " ".join(fresh(60))
    texts += [" ".join(fresh(r.randint(5, 60))) + " " + passage for _ in range(120)]
    texts += [texts[0]] * 40 + ["UPPER case Words here now " + passage, "upper CASE words here now " + passage]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == near_by_force(rows)


def test_sets_that_their_pivot_leaves_apart(spark):
    """Copies of one text that all differ from it by nearly a quarter: links between them by the same edits, by fewer words, or none."""
    r = random.Random(11)
    base = [f"b{k}" for k in range(140)]
    texts = [" ".join(base)]
    for _ in range(12):
        one = edited(r, base, 0.045).split()
        texts += [" ".join(one), edited(r, one, 0.004), edited(r, one, 0.02), " ".join(one[: r.randint(105, 140)])]
    texts += [" ".join(base[: r.randint(95, 139)]) for _ in range(20)] + [edited(r, base[: r.randint(100, 139)], 0.03) for _ in range(40)]
    rows = list(enumerate(texts))
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == near_by_force(rows)


def test_large_nodes_branch(spark, monkeypatch):
    """With no set allowed in a small node, everything goes down the trees, with the same result."""
    monkeypatch.setattr(chosen_path, "SMALL", 0)
    r = random.Random(6)
    passage = [f"p{k}" for k in range(80)]
    rows = [(k, edited(r, passage, 0.06)) for k in range(60)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == near_by_force(rows)


def test_odd_rows(odd):
    got = collections.Counter(near_rows(odd))
    assert got[(3, 0, 3, True)] == got[(4, 0, 4, True)] == got[(5, 0, 5, True)] == 1  # nothing to link
    assert got[(6, 1, 6, True)] == got[(7, 1, 6, False)] == 1  # one word is a sequence
    assert got[(8, 1, 8, True)] == 2  # a repeated row
    assert got[(12, next(n for i, n, _, _ in got if i == 12), 1, False)] == 1
    (null,) = [x for x in got if x[0] is None]
    assert null[2:] == (None, True)
    assert sum(got.values()) == odd.count()


def near_rows(df):
    return [tuple(r) for r in chosen_path.near_duplicates(df).collect()]


def test_one_row_of_each_group_stays(odd):
    left = chosen_path.one_of_each(odd)
    assert left.columns == odd.columns
    ids = [i for i, _ in listed(left)]
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 8, 9, 10, 11] and ids.count(None) == 1


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(7)
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(2000 + k, 2000 + (k + 1) % 30) for k in range(30)]
    links += [(3000 + r.randint(0, 40), 3000 + r.randint(0, 40)) for _ in range(30)] + [(5, 5)]
    groups = Groups()
    for a, b in links:
        groups.link(a, b)
    r.shuffle(links)
    got = {x.v: x.component for x in graph.components(spark.createDataFrame([(b, a) for a, b in links], "a long, b long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: groups.of(x) for x in touched}


def removed_by_force(rows, length=suffix_dedup.LENGTH):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(xxhash.xxh3_128_digest(b[s : s + length]) for b in raw for s in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[xxhash.xxh3_128_digest(b[s : s + length])] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def removed(df):
    return collections.Counter(tuple(r) for r in suffix_dedup.digests(df).collect())


def test_repeated_strings_of_the_given_documents(given):
    assert removed(given[0]) == removed_by_force(listed(given[0]))


def test_texts_that_differ_by_swapped_words_share_nothing(spark):
    """Words in the order of the parity of bits, and the same with both words swapped: sums of powers of an odd number cancel."""
    for a, b in ((b"&'g", b"&7="), (b"abc", b"xyz"), (b"aa", b"ab"), (b"x", b"y")):
        n, pair = 1 << ((192 // len(a)).bit_length() - 1), []
        for first, second in ((a, b), (b, a)):
            body = b"".join(second if bin(k).count("1") % 2 else first for k in range(n))
            pair.append((b"head of both texts......" + body + b"tail of both texts" * 22)[:400].decode())
        rows = list(enumerate(pair))
        assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == removed_by_force(rows)


def test_shorter_strings(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = letters(260)
    rows = [(i, letters(rng.randrange(900)) + (passage[i % 50 :] if i % 3 else "") + letters(100)) for i in range(60)] + [(60, "ab" * 300), (61, "z" * 99)]
    left = dict(listed(suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 200)))
    force = {r[0]: r for r in removed_by_force(rows, 200)}
    for i, text in rows:
        # A character cut in two goes as a whole, so a few bytes more may be gone.
        assert 0 <= len(text.encode()) - len(left[i].encode()) - force[i][2] <= 2 * force[i][3]
    with pytest.raises(ValueError):
        suffix_dedup.reach_of(71)


@pytest.mark.parametrize("held", [suffix_dedup.HELD, 2000])
def test_passages_of_all_offsets(spark, monkeypatch, held):
    """Passages around the length, in many contexts, cut at all offsets, within one text, and runs of one byte."""
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "IN_BUCKET", held // 4)
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    long, short = letters(1500), letters(330)
    texts = []
    for _ in range(40):
        a = r.randint(0, 1000)
        n = r.choice([380, 398, 399, 400, 401, 420, 700])
        texts.append(letters(r.randint(0, 300)) + long[a : a + n] + letters(r.randint(0, 300)))
    texts += [letters(50) + short + letters(50) for _ in range(20)]
    texts += [letters(9) + long[:450] + letters(9) + long[40:470], "a" * 401, "a" * 900, "b" * 400, "b" * 400, "c" * 399, "c" * 399, "ab" * 300, letters(400)]
    rows = list(enumerate(texts))
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == removed_by_force(rows)


def test_odd_texts_and_rows_without_their_repeats(odd):
    assert removed(odd) == removed_by_force(listed(odd))
    left = suffix_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.schema.simpleString() == odd.schema.simpleString()
    rows = left.collect()
    assert len(rows) == odd.count()
    assert all(x.r == 7 and (x.text is None or x.n_chars == len(x.text)) for x in rows)
    assert next(x.text for x in rows if x.doc_id == 9) == "" and next(x.text for x in rows if x.doc_id == 6) == "word"


def vectors_by_force(rows, cosine=0.98):
    groups, degree = Groups(), collections.Counter()
    good = [(i, lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for k, (i, lab, v) in enumerate(good):
        for j, other, w in good[:k]:
            if lab == other and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                degree[i] += 1
                degree[j] += 1
                groups.link(i, j)
    return collections.Counter((i, degree[i], groups.of(i), groups.of(i) == i) if i is not None else (None, 0, None, True) for i, _, _ in rows)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 16)
    monkeypatch.setattr(grid_join, "LEAF", 4)
    r = np.random.default_rng(9)
    rows, i = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            centre = r.standard_normal(8)
            for _ in range(r.integers(1, 14)):
                rows.append((i, label, [float(np.float32(x)) for x in centre * r.uniform(0.1, 9) + r.standard_normal(8) * 0.16 * np.linalg.norm(centre) / 8**0.5]))
                i += 1
    rows += [(i + k, 1, rows[0][2]) for k in range(30)]
    i += 30
    rows += [(i, 1, None), (i + 1, 1, []), (i + 2, 1, [0.0] * 8), (i + 3, 1, [None] * 8), (i + 4, 1, [float("nan")] + [1.0] * 7), (i + 5, 1, [float("inf")] * 8), (i + 6, 1, [1.0, 2.0]), (i + 7, 1, [2.0, 4.0]), (None, 1, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("v", F.lit(1)).withColumn("dims", F.lit("x"))
    got = collections.Counter(tuple(x) for x in grid_join.near_duplicates(df).collect())
    want = vectors_by_force(rows)
    assert sum(n > 3 for _, n, _, _ in want) > 30 and got == want


def test_halving_skips_and_keeps():
    r = np.random.default_rng(10)
    a = r.standard_normal((150, 6))
    b = np.concatenate([a[:40] + 0.01 * r.standard_normal((40, 6)), r.standard_normal((90, 6))])
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    basis = grid_join.directions(a, 3)
    assert (grid_join.linked(a, b, a @ basis, b @ basis, 0.98, (0.04**0.5) + 1e-7) == (a @ b.T >= 0.98)).all()


def test_empty_tables(spark, none):
    assert chosen_path.near_duplicates(none).count() == suffix_dedup.digests(none).count() == 0
    assert suffix_dedup.without_repeats(none).count() == chosen_path.one_of_each(none).count() == 0
    assert grid_join.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_bits_bound_what_two_sets_share(spark):
    """The bitmap bound never lies below what is shared, so no pair is lost by it."""
    r = random.Random(3)
    rows = []
    for _ in range(60):
        x, y = ({r.randrange(2**63) for _ in range(r.choice([0, 1, 30, 700]))} for _ in range(2))
        y |= set(r.sample(sorted(x), len(x) // r.choice([1, 2, 9])))
        bits = []
        for part in (x, y):
            seen = np.zeros(chosen_path.BITS, bool)
            seen[[k % chosen_path.BITS for k in part]] = True
            bits.append(np.packbits(seen).view(np.int64).tolist())
        rows.append((len(x), 0, len(y), 0, *bits, len(x & y)))
    df = spark.createDataFrame(rows, "n long, i long, m long, j long, bv array<long>, bw array<long>, same long")
    got = df.select(F.expr(chosen_path._most("bv", "bw")).alias("most"), "same", "n").collect()
    assert all(x.most >= x.same for x in got) and any(x.most < x.n for x in got)


def test_unlinked_copies_of_one_text_that_share_their_edits(spark):
    """Sets held against one pivot that all differ from it in the same passage: pairs between them meet by shingles besides the pivot's."""
    r = random.Random(21)
    base = [f"b{k}" for k in range(150)]
    other = base[:110] + [f"o{k}" for k in range(40)]
    texts = [" ".join(base)] + [edited(r, base, 0.01) for _ in range(40)] + [edited(r, other, r.choice([0.01, 0.03, 0.05, 0.06])) for _ in range(80)]
    rows = list(enumerate(texts))
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == near_by_force(rows)
