"""Near-duplicate texts by a chosen-path set similarity join.

A text is the set of its five-word shingles. Every set has a row of minwise tokens. Each of ``TREES`` trees starts by
one of them: sets with the same value share a node. A node that is small is compared exhaustively; a larger one branches by
``BRANCHES`` paths of ``STEPS`` further tokens each, chosen by node and depth, and its children are treated alike, down to ``DEPTH``, where what is
left is compared in whatever size it has. Two sets of similarity s share a first node of a given tree with probability s and each path with
s ** STEPS. At 0.75 a branching loses them with probability 0.004, so all trees miss a pair with 0.25 ** TREES where nodes are small, and with
(0.25 + 0.75 * 0.0084) ** TREES, which is 1.5e-12, where they branch twice. Sets that have only a passage in common, say 0.3 alike, share a path with 0.027: a branching
leaves a quarter of their pairs, and a node of ``z`` such sets costs no more than ``z * SMALL`` where paths part them.

Only links that can still join two components matter. So equal sets are one vertex from the start, and every set of a root node is
held against one of the node, its pivot, in full: how much they share, and what the set has besides. After that a pair needs
a look only if its ends are in different components. Two sets that were both held against one pivot share at most the smaller
of what each shares with it, and what both have besides; so only pairs that have enough of the same besides, or sizes that leave room, go on. Such
pairs meet in the rarer shingles of what they have besides (a prefix filter). In a large group of near copies next to none do. The other pairs of a node, with an end that is unlike its pivot, go on if their tokens agree.
Tokens only choose pairs: a link is confirmed on the full sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settled
from .common import discard, map_arrow, mixed, release, rows_of, tasks_for, word_list
from .graph import components

SHINGLE = 5
PERCENT = 75
TOKENS, TREES, BRANCHES, STEPS, DEPTH = 64, 20, 10, 3, 3
#: For comparisons a set has 126 tokens of a byte each, seven to a long. A pair goes to the confirmation if 70 of them agree: 94.5 are
#: expected at the threshold and 70 lie five deviations below. Inside nodes the first 63 are looked at before the others: 47.25 and 30.
LONGS, AGREEING, FIRST_LONGS, FIRST_AGREEING = 18, 70, 9, 30
#: A node is small if it has at most this many sets that are unlike its pivot.
SMALL = 500
#: Rows that a task writes, of documents and of pairs with their texts.
WRITTEN, WRITTEN_PAIRS = 10_000, 5_000
#: What a set has besides its pivot is also kept as a bitmap of this many bits, one for each range of shingle hashes.
BITS = 512

_ODD = mixed(np.arange(1, 7 * LONGS + 1, dtype=np.uint64)) | np.uint64(1)
_HIGH = np.uint64(32)


def shingles(text: str | None) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes. Fewer words than a shingle: one of them all; none: empty."""
    words = word_list(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    key = np.full(n, size, np.uint64)
    for k in range(size):
        key = mixed(key ^ h[k : k + n]) + np.uint64(k)
    return np.unique(key)


def tokens(of: np.ndarray) -> np.ndarray:
    """The minwise tokens of a non-empty set."""
    low = np.full(len(_ODD), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(of), 1024):
        low = np.minimum(low, ((of[k : k + 1024, None] * _ODD) >> _HIGH).astype(np.uint32).min(axis=0))
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """A byte of each token, seven to a long, the highest byte left empty."""
    parts = (mixed(low) & np.uint64(255)).reshape(LONGS, 7) << (np.arange(7, dtype=np.uint64) * np.uint64(8))
    return parts.sum(axis=1, dtype=np.uint64).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_shingles, a 128-bit digest of the set, and its tokens, whole and packed (null where the set is empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, tok, sig = [], [], [], [], []
            for text in rows_of(batch, "text"):
                s = shingles(text)
                n.append(len(s))
                d1.append(int(mixed(s).sum().view(np.int64)) if len(s) else 0)
                d2.append(int(mixed(s ^ np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64)) if len(s) else 0)
                low = tokens(s) if len(s) else None
                tok.append(None if low is None else low[:TOKENS].view(np.int32))
                sig.append(None if low is None else packed(low))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "tok": pa.array(tok, pa.list_(pa.int32())), "sig": pa.array(sig, pa.list_(pa.int64()))})

    return map_arrow(docs, ["doc_id", "text"], work, "doc_id long, n_shingles long, d1 long, d2 long, tok array<int>, sig array<long>")


def _near_sizes(a: str, b: str) -> Column:
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def _agree(a: str, b: str, longs: int, least: int) -> Column:
    """Whether ``least`` of the tokens in the first ``longs`` are equal: bytes of the difference that are zero leave their high bit."""
    return F.expr(" + ".join(_equal_bytes(f"{a}[{k}]", f"{b}[{k}]") for k in range(longs)) + f" >= {least}")


def _equal_bytes(x: str, y: str) -> str:
    low = 0x007F7F7F7F7F7F7F
    return f"bit_count(~(((({x} ^ {y}) & {low}L) + {low}L) | ({x} ^ {y}) | {low}L) & {0x0080808080808080}L)"


def _agree_in_all(a: str, b: str) -> Column:
    """``_agree`` in all longs, as a loop: written out beside another sieve it makes a method too long for the JVM to compile."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> {_equal_bytes('x', 'y')}), 0, (n, same) -> n + same) >= {AGREEING}")


def _by_token(df: DataFrame, which: Column, steps: int = 1) -> DataFrame:
    """One row for each set and chosen place; ``key`` names the node that the ``steps`` tokens from that place on lead to, from the node the row
    is in. After the last token comes the first that roots don't use."""
    keep = [c for c in df.columns if c not in ("key", "tok")]
    above = F.col("key") if "key" in df.columns else F.lit(0).cast("long")
    chosen = df.withColumn("pos", F.explode(which))
    places = [F.col("pos") if k == 0 else F.lit(TREES) + (F.col("pos") - TREES + k) % (TOKENS - TREES) for k in range(steps)]
    return chosen.select(*keep, F.xxhash64(above, "pos", *[F.element_at("tok", p.cast("int") + 1) for p in places]).alias("key"))


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that agree in enough of all packed tokens."""
    sig = sets.select("v", "sig")
    met = pairs.join(sig.select(F.col("v").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("v").alias("b"), F.col("sig").alias("sb")), "b")
    return met.filter(_agree("sa", "sb", LONGS, AGREEING)).select("a", "b")


def compared(pairs: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b) of ids with their full sets' sizes, how much they share, whether they link, and what ``a`` has besides,
    as shingles and as a bitmap."""
    pairs = settled(pairs, tasks)
    held = max(tasks, tasks_for(docs.sparkSession, pairs.count(), WRITTEN_PAIRS))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = settled(docs.select("doc_id", "text").join(ids, "doc_id"), tasks)
    release(docs.sparkSession)
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, np.ndarray] = OrderedDict()

        def set_of(text: str) -> np.ndarray:
            if text not in known:
                known[text] = shingles(text)
                if len(known) > 32:
                    known.popitem(last=False)
            return known[text]

        for batch in batches:
            na, nb, shared, besides, bits = [], [], [], [], []
            for ta, tb in zip(rows_of(batch, "text_a"), rows_of(batch, "text_b")):
                x, y = shingles(ta), set_of(tb or "")
                rest = np.setdiff1d(x, y, assume_unique=True)
                na.append(len(x))
                nb.append(len(y))
                shared.append(len(x) - len(rest))
                besides.append(rest.view(np.int64))
                seen = np.zeros(BITS, bool)
                seen[(rest % np.uint64(BITS)).astype(np.int64)] = True
                bits.append(np.packbits(seen).view(np.int64))
            sizes = {"na": pa.array(na, pa.int64()), "nb": pa.array(nb, pa.int64()), "shared": pa.array(shared, pa.int64())}
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), **sizes, "besides": pa.array(besides, pa.list_(pa.int64())), "bits": pa.array(bits, pa.list_(pa.int64()))})

    found = map_arrow(both.coalesce(held), ["a", "b", "text_a", "text_b"], work, "a long, b long, na long, nb long, shared long, besides array<long>, bits array<long>")
    out = settled(found.withColumn("link", _alike("shared", "na", "nb")))
    discard(texts)
    discard(pairs)
    return out


def _alike(shared: str, na: str, nb: str) -> Column:
    return F.expr(f"{shared} > 0 and 100 * {shared} >= {PERCENT} * ({na} + {nb} - {shared})")


def _pivots(sets: DataFrame, tasks: int) -> DataFrame:
    """(key, p, np): of each root node with two sets or more the one whose tokens lead to the largest nodes, as those of a text in the
    middle of its near copies do; at ties the smallest id."""
    at = _by_token(sets.select("v", "n", "tok"), F.sequence(F.lit(0), F.lit(TREES - 1)))
    sizes = settled(at.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), tasks)
    shared = settled(at.join(sizes, "key"), tasks)
    central = settled(shared.groupBy("v").agg(F.sum("c").alias("weight")), tasks)
    best = F.max(F.struct("weight", (-F.col("v")).alias("minus"), "n"))
    pivots = shared.select("key", "v", "n").join(central, "v").groupBy("key").agg(best.alias("best"))
    pivots = settled(pivots.select("key", (-F.col("best.minus")).alias("p"), F.col("best.n").alias("np")), tasks)
    for done in (sizes, shared, central):
        discard(done)
    return pivots


def _first_pairs(sets: DataFrame, pivots: DataFrame) -> DataFrame:
    """Every set of a root node against the node's pivot."""
    at = _by_token(sets.select("v", "n", "tok"), F.sequence(F.lit(0), F.lit(TREES - 1)))
    pairs = at.join(pivots, "key").filter((F.col("v") != F.col("p")) & _near_sizes("n", "np"))
    return _likely(pairs.select(F.col("v").alias("a"), F.col("p").alias("b")).distinct(), sets)


def _most(v: str, w: str) -> str:
    """What two sets share at most of what they have besides a pivot: a bit that one's ``bits`` have and the other's lack stands for
    one shingle or more that isn't shared."""
    one_sided = lambda x, y: " + ".join(f"bit_count({x}[{k}] & ~{y}[{k}])" for k in range(BITS // 64))
    return f"least(n - i - ({one_sided(v, w)}), m - j - ({one_sided(w, v)}))"


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size) * 20).cast("int")


def _probes(outside: DataFrame, index: DataFrame, plain: list[str]) -> DataFrame:
    """The shingles by which sets look for others, one row for each set, size class of the other, and shingle.

    A set that must have ``k`` shingles of its besides in common with one of that size meets it in any ``len(besides) - k + 1`` of them, so
    those that fewest sets hold under the pivot are enough. Shingles whose holders are all in one component lead nowhere new."""
    holders = index.groupBy("p", "s").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high"))
    holders = holders.select("p", "s", F.when(F.col("low") != F.col("high"), F.col("c")).otherwise(0).alias("c"))
    # Size classes are few, as they grow by a twentieth of a logarithm.
    classes = index.groupBy("p").agg(F.collect_set("step").alias("steps"))
    asks = outside.withColumn("nb", F.size("besides")).select(*plain, "nb", F.explode("besides").alias("s")).join(holders, ["p", "s"])
    # Ranked before they meet the classes: rows dealt by pivot and set, not by pivot alone.
    asks = asks.withColumn("rank", F.row_number().over(Window.partitionBy("p", "v").orderBy("c", "s"))).filter("c > 0").join(classes, "p")
    asks = asks.withColumn("step", F.explode("steps")).drop("steps")
    smallest = F.greatest(F.ceil(F.exp(F.col("step") / 20) - 1e-6), F.ceil(F.col("n") * PERCENT / 100))
    near = (F.exp((F.col("step") + 1) / 20) * 100 >= F.col("n") * PERCENT - 1) & (F.exp(F.col("step") / 20) * PERCENT <= F.col("n") * 100 + 1)
    # 100 * shared >= PERCENT * (n + m - shared), solved for what is shared; at most i of it lies in the pivot
    least = F.ceil((F.col("n") + smallest) * PERCENT / (100 + PERCENT) - 1e-6) - F.col("i")
    prefix = F.col("nb") - F.greatest(F.lit(1), least) + 1
    return asks.filter(near & (F.col("rank") <= prefix)).select(*plain, "step", "s")


def _pairs_at_pivots(held: DataFrame, labels: DataFrame, tasks: int) -> DataFrame:
    """Of sets held against one pivot, the pairs across components that may be alike by what each shares with the pivot and what
    both have besides. Pairs that have nothing the same besides meet by size: the other one must be small enough to be alike. The others
    meet in a shingle, and only those go on whose bits leave room for what they would have to share."""
    rows = held.select(F.col("b").alias("p"), F.col("a").alias("v"), F.col("na").alias("n"), F.col("shared").alias("i"), "besides", "bits")
    rows = rows.join(labels, "v").join(labels.select(F.col("v").alias("p"), F.col("label").alias("main")), "p")
    rows = settled(rows.withColumn("step", _size_class(F.col("n"))), tasks)
    names = {"v": "w", "n": "m", "i": "j", "label": "other", "bits": "bits_w"}
    plain = ["p", "v", "n", "i", "label"]
    outside = rows.filter("label <> main")
    apart = (F.col("label") != F.col("other")) & (F.col("v") != F.col("w")) & _near_sizes("n", "m")

    index = rows.select(*plain, "bits", "step", F.explode("besides").alias("s"))
    probes = _probes(outside.select(*plain, "bits", "besides"), index, [*plain, "bits"])
    may = apart & _alike(f"(least(i, j) + {_most('bits', 'bits_w')})", "n", "m")
    sharing = probes.join(index.withColumnsRenamed(names), ["p", "step", "s"]).filter(may)

    # 100 * i >= PERCENT * (n + m - i), solved for the other's size m
    room = F.floor(F.col("i") * (100 + PERCENT) / PERCENT) - F.col("n")
    least = F.ceil(F.col("n") * PERCENT / 100)
    by_size = outside.select(*plain).filter(room >= least).withColumn("step", F.explode(F.sequence(_size_class(least), _size_class(room))))
    by_size = by_size.join(rows.select(*plain, "step").withColumnsRenamed(names), ["p", "step"])
    by_size = by_size.filter(apart & _alike("least(i, j)", "n", "m"))
    return sharing.select("v", "w").unionByName(by_size.select("v", "w")).select(F.greatest("v", "w").alias("a"), F.least("v", "w").alias("b"))


def _open(at: DataFrame, tasks: int) -> DataFrame:
    """Rows of nodes that hold more than one component and a set that is unlike the pivot, and whether the node is small. Counting is by
    (node, component), so a large group is a few rows."""
    tally = at.groupBy("key", "label").agg(F.count(F.when(F.col("unlike"), 1)).alias("z"))
    nodes = tally.groupBy("key").agg(F.count("*").alias("labels"), F.sum("z").alias("z")).filter("labels > 1 and z > 0")
    return at.join(settled(nodes.select("key", (F.col("z") <= SMALL).alias("small")), tasks), "key")


def _across(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that share a node and agree in enough tokens: in the first, and then in all, as texts that have a passage in
    common agree in enough of the first by chance. One end is unlike the pivot."""
    rows = rows.join(sets.select("v", "sig"), "v")
    a = rows.filter("unlike").select("key", F.col("v").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("sig").alias("sa"))
    b = rows.select(F.col("key").alias("key_b"), F.col("v").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("sig").alias("sb"), F.col("unlike").alias("both"))
    once = ~F.col("both") | (F.col("a") > F.col("b"))
    met = a.join(b, (F.col("key") == F.col("key_b")) & (F.col("la") != F.col("lb")) & once & _near_sizes("na", "nb") & _agree("sa", "sb", FIRST_LONGS, FIRST_AGREEING) & _agree_in_all("sa", "sb"))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _pairs_in_nodes(sets: DataFrame, labels: DataFrame, held: DataFrame, pivots: DataFrame, tasks: int) -> DataFrame:
    """Pairs between components, from all trees, each node down to where it is small, with an end unlike the root node's pivot."""
    rows = _by_token(sets.join(labels, "v").select("v", "n", "tok", "label"), F.sequence(F.lit(0), F.lit(TREES - 1)))
    mixed_nodes = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    pivots = settled(pivots.join(mixed_nodes, "key").select("key", "p"), tasks)
    known = held.select(F.col("a").alias("v"), F.col("b").alias("p"), F.lit(False).alias("unlike"))
    rows = rows.join(pivots, "key").filter("v <> p").join(known, ["v", "p"], "left").select("key", "v", "n", "label", F.coalesce("unlike", F.lit(True)).alias("unlike"))
    pairs = None
    for depth in range(1, DEPTH + 1):
        rows = settled(_open(rows, tasks), tasks)
        at_end = depth == DEPTH
        found = _across(rows if at_end else rows.filter("small"), sets)
        pairs = found if pairs is None else pairs.unionByName(found)
        rows = rows.filter(~F.col("small"))
        if at_end or rows.isEmpty():
            break
        # Further tokens, other ones for each node and depth, and none in two paths.
        which = F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda k: (F.lit(TREES) + F.pmod(F.xxhash64("key", F.lit(depth)) % 1000 + STEPS * k, F.lit(TOKENS - TREES))).cast("int"))
        rows = _by_token(rows.select("v", "n", "label", "unlike", "key").join(sets.select("v", "tok"), "v"), which, STEPS)
    return pairs


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and link with nothing. A doc_id that names several
    texts stands for all of them when links are confirmed; each row reports the component of its own text. A null doc_id takes no part: its component_id is null and it is kept. An empty table gives no rows.
    Only doc_id and text are read. Equal sets are one vertex however many rows have them.
    """
    spark = docs.sparkSession
    rows = settled(features(docs))
    tasks = tasks_for(spark, rows.count(), WRITTEN)
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    sets = settled(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("v"), F.first("n_shingles").alias("n"), F.first("tok").alias("tok"), F.first("sig").alias("sig")), tasks)
    release(spark)
    pivots = _pivots(sets, tasks)
    held = compared(_first_pairs(sets, pivots), docs, tasks)
    links = held.filter("link").select("a", "b")
    known = components(links, tasks).withColumnRenamed("component", "label")
    labels = settled(sets.select("v").distinct().join(known, "v", "left").select("v", F.coalesce("label", "v").alias("label")), tasks)
    found = _pairs_at_pivots(held, labels, tasks).unionByName(_pairs_in_nodes(sets, labels, held, pivots, tasks))
    further = settled(found.coalesce(4 * tasks).distinct(), tasks)
    more = compared(_likely(further, sets), docs, tasks).filter("link").select("a", "b")
    groups = components(links.unionByName(more), tasks)
    for done in (held, labels, further, pivots):
        discard(done)
    release(spark)
    of_set = settled(sets.join(groups, "v", "left").select("d1", "d2", F.coalesce("component", "v").alias("c")), tasks)
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(of_set, ["d1", "d2"], "left")
    one = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(one, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, all columns, of the document that each group of near-duplicates keeps: one row a doc_id. Rows without doc_id stay."""
    keep = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))
