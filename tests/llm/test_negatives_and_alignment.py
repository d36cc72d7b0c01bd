"""Hard negatives, two-tier encoding and cross-tokenizer alignment against plain versions."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import alignment, hard_negatives, queries, two_tier_bpe

from .conftest import DATA

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# Hard negatives


def plainly_mined(rows, every=50):
    """Every anchor's inner product with every row."""
    part = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) or abs(np.floor(x * 256)) >= 1 << 24 for x in v):
            continue
        part.append((i, [int(np.floor(float(x) * 256)) for x in v], label))
    out = []
    for k, (i, v, label) in enumerate(part):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for m, (j, w, other) in enumerate(part) if m != k]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            inside = sorted((t, n) for t, n, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(inside, 1)]
    return sorted(out)


def test_negatives_agree_with_sql_on_the_given_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op11_bond_negatives"]).fetchall())
    assert want and sorted(map(tuple, queries.op11_bond_negatives(spark, DATA).collect())) == want


@pytest.mark.parametrize(("block", "group"), [(16, 4), (64, 256)])
def test_negatives_of_odd_rows(spark, monkeypatch, block, group):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2, 3, 12) / 4).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    common = rows[7][1]
    rows += [(1000 + i, common, 1) for i in range(100)]  # a third of all, all alike
    rows += [(50, rows[50][1], rows[50][2])] * 2 + [(3, common, None), (4, None, 1), (None, common, 1), (5, [None] * 12, 1), (6, [float("nan")] * 12, 2)]
    rows += [(8, [float("inf")] * 12, 0), (9, [1e30] * 12, 0), (2000, [0.5] * 3, 0), (2050, [], 1), (2100, [0.0] * 12, 2)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, score int").repartition(5)
    found = hard_negatives.mine(df)
    assert sorted(map(tuple, found.collect())) == plainly_mined(rows)
    assert hard_negatives.mine(df.limit(0)).collect() == []


def test_anchors_travel_to_blocks_in_rounds(spark, monkeypatch):
    for name, value in {"BLOCK": 16, "GROUP": 4, "ROUND": 6_000}.items():
        monkeypatch.setattr(hard_negatives, name, value, raising=False)
    rng, met, map_arrow = np.random.default_rng(8), [], hard_negatives.map_arrow

    def spied(df, columns, work, schema):
        if "anchors" in columns:
            met.append(df.select("block", F.explode("anchors").alias("a")).select("block", "a.home", "a.place").collect())
        return map_arrow(df, columns, work, schema)

    monkeypatch.setattr(hard_negatives, "map_arrow", spied)
    rows = [(i, (rng.integers(-9, 10, 12) / 4).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5), every=5)
    assert sorted(map(tuple, found.collect())) == plainly_mined(rows, every=5)
    # Each of 60 anchors meets each block once a scan, and no round holds many anchors: one takes 48 bytes of values and up to 300 more.
    blocks = {block for rows in met for block, _, _ in rows}
    sent = [len(rows) / len(blocks) for rows in met]
    assert sum(sent) == 2 * 60 and max(sent) <= 30 and len({r for rows in met for r in rows}) == 60 * len(blocks)


def test_values_too_large_for_doubles_are_added_up_as_integers():
    small, large = np.full((64, 3), 1 << 20), np.array([[(1 << 24) - 1, 1]] * 64)
    assert hard_negatives.laid_out(small).dtype == np.float64 and hard_negatives.laid_out(large).dtype == np.int64
    block = hard_negatives.Block(np.arange(2), np.zeros(2, np.int64), hard_negatives.laid_out(large))
    _, scores = block.best_alike(np.full(64, (1 << 24) - 1), 0, -1, 2)
    assert scores.tolist() == [64 * ((1 << 24) - 1) ** 2, 64 * ((1 << 24) - 1)]


def test_windows_that_meet_or_lie_apart_keep_their_rows():
    rng = np.random.default_rng(9)
    block = hard_negatives.Block(np.arange(500), np.zeros(500, np.int64), hard_negatives.laid_out(rng.integers(-20, 21, (40, 500))))
    anchor = rng.integers(-20, 21, 40)
    scores = (anchor @ block.columns).astype(int).tolist()
    windows = [(100, 300), (250, 900), (901, 950), (-700, -200), (5, 4), (2000, 2100), (-60, -60), (0, 0)]
    for (least, greatest), (ids, found) in zip(windows, block.best_within(anchor, 1, windows, 3)):
        want = sorted((-s, i) for i, s in enumerate(scores) if least <= s <= greatest)[:3]
        assert list(zip((-found).tolist(), ids.tolist())) == want


def test_the_scan_drops_rows_before_it_has_read_all(monkeypatch):
    rng = np.random.default_rng(5)
    block = hard_negatives.Block(np.arange(2000), np.zeros(2000, np.int64), rng.integers(-20, 21, (64, 2000)))
    anchor = (rng.normal(size=64) * 1000 * 0.8 ** np.arange(64)).astype(np.int64)
    seen = []

    def keeps(low, high):
        seen.append(len(low))
        return high >= np.partition(low, len(low) - 5)[len(low) - 5]

    rows, scores = block.scan(anchor, np.ones(2000, bool), keeps)
    exact = anchor @ block.columns
    assert (scores == exact[rows]).all() and set(np.argsort(-exact)[:5]) <= set(rows)
    assert seen[-1] < seen[0] / 10


def test_windows_of_scores():
    for score in range(-300, 301):
        low, high = hard_negatives.window(score)
        assert {s for s in range(-400, 401) if 50 * score <= 100 * s <= 95 * score} == set(range(low, high + 1))


# Two-tier encoding


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=two_tier_bpe.read_ranks(RANKS), special_tokens={})


def test_the_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 3, 7, 100, 5000):
        keys = [f"k{i}".encode() for i in range(n)]
        table = two_tier_bpe.MinimalPerfectHash(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(n))
        assert all(0 <= s < max(n, 1) for s in table.slots([b"other", b""]).tolist())


def test_the_second_tier_merges_like_the_library(library):
    bpe = two_tier_bpe.TwoTierBpe(two_tier_bpe.read_ranks(RANKS))
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 5, 20, 100, 3000]:
        for letters in (b"a", b"ab", b"the quick", bytes(range(256))):
            piece = bytes(rng.choice(list(letters), n).tolist())
            assert bpe.merged(piece) == library._core_bpe.encode_single_piece(piece)


def test_texts_are_cut_like_the_library_cuts_them(library):
    split, rng = two_tier_bpe.Splitter(PATTERN), np.random.default_rng(2)
    chars = [chr(c) for c in [*range(32, 127), *rng.integers(0x80, 0xD800, 3000).tolist(), *rng.integers(0xE000, 0x110000, 3000).tolist(), 0x88F, 0x323B0, 0x11DE0]]
    bpe = two_tier_bpe.TwoTierBpe(two_tier_bpe.read_ranks(RANKS))
    for text in ["".join(rng.choice(chars, 60)) for _ in range(300)] + ["\x1c \x85 a\n\n b", "it's 'll 'LL", "a  "]:
        pieces = split.findall(text)
        assert "".join(pieces) == text
        assert [i for p in bpe.encode(pieces) for i in np.frombuffer(p, "<u4").tolist()] == library.encode_ordinary(text)


def test_round_trip_of_all_texts(given, odd, none, library):
    for docs in (given[0], odd):
        texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        want = [(i, len(ids := library.encode_ordinary(t)), sha(",".join(map(str, ids))), sha(t)) for i, t in texts]
        key = lambda r: (r[0] is None, r[0], r[1:])
        assert sorted(map(tuple, two_tier_bpe.round_trip(docs, RANKS, PATTERN).collect()), key=key) == sorted(want, key=key)
    assert two_tier_bpe.round_trip(none, RANKS, PATTERN).collect() == []


def test_ids_and_bytes_themselves_come_back(spark):
    docs = spark.createDataFrame([(1, "Hello, wörld"), (2, None)], "doc_id long, text string")
    rows = two_tier_bpe.decode(two_tier_bpe.encode(docs, RANKS, PATTERN), RANKS).orderBy("doc_id").collect()
    assert bytes(rows[0]["decoded"]).decode() == "Hello, wörld" and rows[0]["ids"] and rows[1]["ids"] == [] and bytes(rows[1]["decoded"]) == b""
    no_ids = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(two_tier_bpe.decode(no_ids, RANKS).first()["decoded"]) == b""


# Alignment


def plainly_aligned(texts):
    first, second = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    first.no_truncation()
    first.no_padding()
    letters = alignment._byte_letters()
    rows, holds, highest = [], Counter(), defaultdict(int)
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = first.encode(raw.decode(), add_special_tokens=False).ids, second.encode(text or "")
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            n, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:n], b[j:m]))
            i, j = n, m
        links = [(x, y) for g, h in groups for x in g for y in h]
        holds.update(set(links))
        rows.append((len(a), len(b), groups, links))
    for (x, _), n in holds.items():
        highest[x] = max(highest[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(holds[p] == highest[p[0]] for p in links), sum(holds[p] for p in links), sha(text)))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [alignment.BLOCK, 500])
def test_alignment_agrees_with_a_plain_version(given, odd, none, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    extra = odd.filter("doc_id is null or doc_id <> 11")  # the plain version is quadratic in a text
    for docs in (given[0].repartition(3), extra):
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = [(i, *row) for (i, _), row in zip(texts, plainly_aligned([t for _, t in texts]))]
        found = alignment.digests(docs, BYTES, PATTERN, PIECES).select("doc_id", *COLUMNS).collect()
        key = lambda r: (r[0] is None, r[0], r[1:])
        assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert alignment.digests(none, BYTES, PATTERN, PIECES).collect() == []


def test_special_strings_spaces_and_texts_that_pieces_change(spark):
    texts = ["<|endoftext|> <s> </s>", "  a   b  ", " ", "▁a", "a▁b", "\n\n", "日本語 Ελλάς \x00", "ﬁ é ", "x" * 300, " " * 77, "\U00031350 ࢏", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = alignment.digests(docs, BYTES, PATTERN, PIECES).orderBy("doc_id").select(*COLUMNS).collect()
    assert list(map(tuple, found)) == plainly_aligned(texts)
    assert tuple(found[3]) == (0, 0, 0, 0, 0, 0, "")


def test_galloping_finds_what_both_have():
    rng = np.random.default_rng(4)
    for n, m, top in [(0, 5, 9), (1, 1, 1), (1, 500, 600), (40, 500, 600), (300, 300, 400), (500, 3, 501)]:
        a, b = (sorted(rng.choice(np.arange(1, top + 1), min(k, top), replace=False).tolist()) for k in (n, m))
        in_a, in_b = alignment.common_ends(a, b)
        assert [a[k] for k in in_a] == [b[k] for k in in_b] == sorted(set(a) & set(b))


def test_large_groups_are_counted_from_both_sides(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 40), rng.integers(0, 7, 60)
    sizes = np.array([1, 30, 9]), np.array([2, 50, 8])
    listed = alignment.links(a, b, *sizes)
    monkeypatch.setattr(alignment, "LISTED", 10)
    counted = alignment.links(a, b, *sizes)
    assert all((x == y).all() for x, y in zip(listed, counted)) and listed[1].sum() == (sizes[0] * sizes[1]).sum()
