"""Toxicity by a small bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as words; every word enters as its own embedding and as that of its character four-grams, so that unseen
forms of a known stem still count. Long runs without white space enter as overlapping pieces. The network runs over windows of ``WINDOW`` words, a new one every
``STEP`` words and one that ends with the text, so every word of every text is read and windows overlap. Signs may be spread over
a text, so a text scores by a learned mix of its highest window and the mean of its ``TOP`` highest.

Labels belong to texts, not to windows. Training therefore alternates: score all windows of the sampled texts, take each text's
highest windows (and, for clean texts, random ones besides) as its example, and descend through the mix. The first number of an embedding
is not learned by descent: it is the smoothed log-odds of the sample's texts that have the word or four-gram, and of a word's
four-grams the highest counts. That makes the first choice of windows sensible.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, in_one_task, map_arrow, rows_of, word_list

WINDOW, STEP, TOP = 128, 96, 3
WORD_SLOTS, GRAM_SLOTS, DIM, HIDDEN = 1 << 16, 1 << 16, 6, 8
#: At most so many labelled texts of each class are fetched to fit the network, the first by a hash of the text's id.
SAMPLE = 1000
#: A sampled text that is longer than this many words is fitted on this many, evenly spread runs of them; scoring reads all.
SAMPLE_WORDS = 1536
THRESHOLD = 0.7
#: Share of the loss that toxic examples have, whatever their number.
TOXIC_WEIGHT = 0.2
#: A run without white space that is longer than this many bytes, as in unspaced scripts, is read as pieces of it, a new one every
#: ``PIECE_STEP`` bytes and one that ends with the run; each counts as a word.
PIECE, PIECE_STEP = 40, 24
_KEPT_WORDS = 200_000
_EDGE = b".,!?;:|\"'()[]{}<>*_#-"


def words_of(text: str | None) -> list[bytes]:
    words = [w.strip(_EDGE) for w in word_list(text)]
    if not any(len(w) > PIECE for w in words):
        return words
    return [piece for w in words for piece in pieces(w)]


def pieces(word: bytes) -> list[bytes]:
    if len(word) <= PIECE:
        return [word]
    return [word[s : s + PIECE] for s in range(0, len(word) - PIECE, PIECE_STEP)] + [word[-PIECE:]]


def _slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slots, four-gram slots of all words in a row, and how many four-grams each word has."""
    crc = zlib.crc32
    own = np.fromiter((crc(w) & (WORD_SLOTS - 1) for w in words), np.int64, len(words))
    grams: list[int] = []
    counts = np.empty(len(words), np.int64)
    for k, w in enumerate(words):
        w = b"<" + w + b">"
        g = [crc(w[i : i + 4]) & (GRAM_SLOTS - 1) for i in range(max(1, len(w) - 3))]
        counts[k] = len(g)
        grams += g
    return own, np.array(grams, np.int64), counts


def window_starts(n: int) -> list[int]:
    """Where windows begin in a text of ``n`` words: one every ``STEP``, and one that ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STEP))
    return starts + [n - WINDOW]


class Network:
    """Parameters are plain float32 arrays, so the model travels inside a closure."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {
            "word": small(WORD_SLOTS, DIM) * 0.1, "gram": small(GRAM_SLOTS, DIM) * 0.1,
            "w": small(2, 2 * DIM, 3 * HIDDEN), "u": small(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "attend": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32),
            "mix": np.array([0.5, 0.5, 0], np.float32),
        }

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """A row per word: its own embedding beside its four-grams' mean, and highest first number."""
        if not words:
            return np.zeros((0, 2 * DIM), np.float32)
        own, grams, counts = _slots(words)
        ends = np.concatenate([[0], np.cumsum(counts)[:-1]])
        found = self.p["gram"][grams]
        chars = np.add.reduceat(found, ends, axis=0) / counts[:, None]
        chars[:, 0] = np.maximum.reduceat(found[:, 0], ends)
        return np.concatenate([self.p["word"][own], chars], axis=1).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs of the gates in both directions, a row per word; the row after the last is the padding's."""
        x = np.concatenate([x, np.zeros((1, 2 * DIM), np.float32)])
        return np.ascontiguousarray(np.einsum("nd,kdg->nkg", x, self.p["w"]) + self.p["b"][:, 0])

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` (n, WINDOW) of rows of ``gates``."""
        n, h2 = len(at), 2 * HIDDEN
        h = np.zeros((2, n, HIDDEN), np.float32)
        states, kept = np.empty((2, WINDOW, n, HIDDEN), np.float32), []
        x = np.empty((2, n, 3 * HIDDEN), np.float32)
        for t in range(WINDOW):
            x[0] = gates[at[:, t], 0]
            x[1] = gates[at[:, WINDOW - 1 - t], 1]
            a = np.matmul(h, self.p["u"])
            zr = 1 / (1 + np.exp(-(x[..., :h2] + a[..., :h2])))
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(x[..., h2:] + r * a[..., h2:])
            new = c + z * (h - c)
            if keep:
                kept.append((h, z, r, c, a[..., h2:]))
            h = new
            states[0, t], states[1, WINDOW - 1 - t] = h[0], h[1]
        s = np.concatenate([states[0], states[1]], axis=-1)
        e = s @ self.p["attend"]
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, s)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (s, alpha, pooled, kept)) if keep else logit

    def mixed(self, logit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of texts that have ``counts`` windows each, the highest ``TOP`` of each text as rows of places (-1: has fewer), and
        what is mixed: highest, mean, 1."""
        own = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((-logit, own))
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        top = np.stack([np.where(counts > k, order[np.minimum(first + k, len(order) - 1)], -1) for k in range(TOP)], axis=1)
        mean = np.where(top >= 0, logit[top], 0).sum(axis=1) / np.minimum(counts, TOP)
        parts = np.stack([logit[top[:, 0]], mean, np.ones(len(counts))], axis=1)
        return parts @ self.p["mix"], top, parts

    def text_gradients(self, x: np.ndarray, at: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """As ``gradients``, for texts that have ``counts`` of the windows ``at`` each, and through the mix."""
        g = {}

        def slope(logit: np.ndarray) -> np.ndarray:
            whole, top, parts = self.mixed(logit, counts)
            d = (1 / (1 + np.exp(-whole)) - label) * weight / len(counts)
            g["mix"] = (parts.T @ d).astype(np.float32)
            out = np.zeros(len(logit))
            out[top[:, 0]] = d * self.p["mix"][0]
            text, place = np.nonzero(top >= 0)
            out[top[text, place]] += (d * self.p["mix"][1] / np.minimum(counts, TOP))[text]
            return out

        dense, dx = self._descent(x, at, slope)
        return dense | g, dx

    def gradients(self, x: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Loss gradients of the dense parameters and of the inputs ``x`` (rows of distinct words); each window is an example."""
        return self._descent(x, at, lambda logit: (1 / (1 + np.exp(-logit)) - label) * weight / len(at))

    def _descent(self, x: np.ndarray, at: np.ndarray, slope: Callable[[np.ndarray], np.ndarray]):
        """Gradients, given the loss's slope by the windows' logits."""
        gates = self.projected(x)
        logit, (s, alpha, pooled, kept) = self.forward(gates, at, keep=True)
        d = slope(logit).astype(np.float32)
        g = {k: np.zeros_like(self.p[k]) for k in ("w", "u", "b")}
        g["out"], g["bias"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * self.p["out"]
        dalpha = np.einsum("nh,tnh->tn", dpool, s)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", de, s)
        ds = alpha[..., None] * dpool + de[..., None] * self.p["attend"]
        ds = np.stack([ds[..., :HIDDEN], ds[..., HIDDEN:]])
        dsteps = np.empty((2, WINDOW, len(at), 3 * HIDDEN), np.float32)
        dh = np.zeros((2, len(at), HIDDEN), np.float32)
        for t in reversed(range(WINDOW)):
            h, z, r, c, ac = kept[t]
            dh = dh + np.stack([ds[0, t], ds[1, WINDOW - 1 - t]])
            dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            dr = dc * ac * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], axis=-1)
            g["u"] += np.einsum("knh,kng->khg", h, da)
            dx = np.concatenate([dz, dr, dc], axis=-1)
            dsteps[0, t], dsteps[1, WINDOW - 1 - t] = dx[0], dx[1]
            dh = dh * z + np.einsum("kng,khg->knh", da, self.p["u"])
        row = (at.T % len(gates)).reshape(-1)
        dgates = np.empty(gates.shape, np.float32)
        for k, j in np.ndindex(2, 3 * HIDDEN):
            dgates[:, k, j] = np.bincount(row, dsteps[k, ..., j].reshape(-1), len(gates))
        g["b"][:, 0] = dgates.sum(axis=0)
        g["w"] = np.einsum("nd,nkg->kdg", x, dgates[:-1])
        return g, np.einsum("nkg,kdg->nd", dgates[:-1], self.p["w"])


def _windows(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows of texts given as word numbers, -1 for padding; how many windows each text has."""
    counts = np.array([len(window_starts(len(t))) for t in texts])
    at = np.full((counts.sum(), WINDOW), -1, np.int64)
    k = 0
    for t in texts:
        t = np.asarray(t, np.int64)
        for s in window_starts(len(t)):
            part = t[s : s + WINDOW]
            at[k, : len(part)] = part
            k += 1
    return at, counts


def fit(texts: list[list[bytes]], labels: np.ndarray, seed: int = 7, rounds: int = 4, rate: float = 0.01) -> Network:
    """Train on whole labelled texts, given as words. Without both classes the network stays as it starts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    vocabulary = sorted({w for t in texts for w in t})
    number = {w: k for k, w in enumerate(vocabulary)}
    texts = [[number[w] for w in t] for t in texts]
    if not vocabulary or labels.min() == labels.max():
        net.p["bias"][0] = -3.0
        return net
    own, grams, counts = _slots(vocabulary)
    gram_word = np.repeat(np.arange(len(vocabulary)), counts)

    share = float(labels.mean())

    def odds(slot_of_pair: np.ndarray, text_of_pair: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of a slot being in a toxic text, against all texts, with a prior of three texts, less a standard error."""
        pair = np.unique(slot_of_pair * len(texts) + text_of_pair)
        slot, text = pair // len(texts), pair % len(texts)
        bad = np.bincount(slot, labels[text], n) + 3 * share
        good = np.bincount(slot, 1 - labels[text], n) + 3 * (1 - share)
        lift = np.log(bad / good) - np.log(share / (1 - share))
        return np.clip(np.sign(lift) * np.maximum(0, np.abs(lift) - np.sqrt(1 / bad + 1 / good)), -1, 5)

    seen = np.unique(np.concatenate([np.unique(np.array(t, np.int64)) * len(texts) + k for k, t in enumerate(texts) if t]))
    word, text = seen // len(texts), seen % len(texts)
    net.p["word"][:, 0] = odds(own[word], text, WORD_SLOTS) / 2
    starts = np.concatenate([[0], np.cumsum(counts)])
    spread = np.concatenate([np.arange(starts[w], starts[w + 1]) for w in word])
    net.p["gram"][:, 0] = odds(grams[spread], np.repeat(text, counts[word]), GRAM_SLOTS) / 2
    at, n_windows = _windows(texts)
    first = np.concatenate([[0], np.cumsum(n_windows)[:-1]])
    owner = np.repeat(np.arange(len(texts)), n_windows)
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    step = 0
    for turn in range(rounds):
        x = net.inputs(vocabulary)
        if turn == 0:
            score = np.sort(np.where(at >= 0, x[at, 0] + x[at, DIM], 0), axis=1)[:, -4:].sum(axis=1)
        else:
            gates = net.projected(x)
            score = np.concatenate([net.forward(gates, at[k : k + 512]) for k in range(0, len(at), 512)])
        # Windows of an example: the highest of its text; for clean texts also random ones.
        best, random = np.lexsort((-score, owner)), np.lexsort((rng.random(len(owner)), owner))
        taken = np.minimum(n_windows, TOP)
        examples = [best[f : f + n] for f, n in zip(first, taken)] + [random[f : f + n] for f, n in zip(first[labels == 0], taken[labels == 0])]
        target = np.concatenate([labels, np.zeros((labels == 0).sum())])
        weight = np.where(target == 1, len(target) * TOXIC_WEIGHT / target.sum(), len(target) * (1 - TOXIC_WEIGHT) / (1 - target).sum())
        for _ in range(3):
            for batch in np.array_split(rng.permutation(len(examples)), max(1, len(examples) // 64)):
                step += 1
                rows = at[np.concatenate([examples[k] for k in batch])]
                sizes = np.array([len(examples[k]) for k in batch])
                used, local = np.unique(rows, return_inverse=True)
                local = local.reshape(rows.shape)
                if used[0] == -1:
                    used, local = used[1:], local - 1
                names = [vocabulary[k] for k in used]
                g, dx = net.text_gradients(net.inputs(names), local, sizes, target[batch], weight[batch])
                for k, v in g.items():
                    m, s = moments.get(k, (np.zeros_like(v), np.zeros_like(v)))
                    m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
                    moments[k] = (m, s)
                    net.p[k] = (net.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                dx[:, [0, DIM]] = 0
                o, gr, c = _slots(names)
                np.add.at(net.p["word"], o, -rate * dx[:, :DIM])
                np.add.at(net.p["gram"], gr, -rate * np.repeat(dx[:, DIM:] / c[:, None], c, axis=0))
    return net


class Scorer:
    """A worker's copy of a network, with the gate inputs of words it has met lately."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.gates = net.projected(np.zeros((0, 2 * DIM), np.float32))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each whole text; 0 where it has no word."""
        texts = [words_of(t) for t in texts]
        if len(self.known) > _KEPT_WORDS:
            self.__init__(self.net)
        new = list({w for t in texts for w in t if w not in self.known})
        if new:
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            self.gates = np.concatenate([self.gates[:base], self.net.projected(self.net.inputs(new))])
        at, counts = _windows([list(map(self.known.__getitem__, t)) for t in texts])
        logit = np.concatenate([self.net.forward(self.gates, at[k : k + 512]) for k in range(0, len(at), 512)])
        whole, _, _ = self.net.mixed(logit.astype(np.float64), counts)
        return np.where([len(t) > 0 for t in texts], 1 / (1 + np.exp(-whole)), 0.0)


def sample(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled texts of each class that are not held out, the first by a hash of the id."""
    seen = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col(column).cast("int").alias("label")).distinct()
    pick = [seen.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Network:
    """Fit on a bounded sample, in one task and in the order of ids: ``bound`` texts a class of bounded length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in rows_of(batch, "text"):
                words = words_of(t)
                if len(words) > SAMPLE_WORDS:
                    runs = np.linspace(0, len(words) - WINDOW, SAMPLE_WORDS // WINDOW).astype(int)
                    words = [w for s in runs for w in words[s : s + WINDOW]]
                out.append(b" ".join(w or b"." for w in words))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "label": batch.column(2), "words": pa.array(out, pa.binary())})

    def fitted(rows: list[dict]) -> Network:
        rows.sort(key=lambda r: (r["doc_id"], r["words"]))
        return fit([bytes(r["words"]).split() for r in rows], np.array([r["label"] for r in rows], np.float64) if rows else np.zeros(1))

    return in_one_task(map_arrow(sample(docs, labels, "toxic", bound), ["doc_id", "text", "label"], cut, "doc_id long, label int, words binary"), fitted)


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Per row doc_id, held_out, score, predicted.

    Null and empty texts and texts without a word score 0. Repeated rows score alike, null doc_ids stay null and count as
    not held out. An empty table gives no rows. Only doc_id and text are read, and doc_id is no input of the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 3 MB, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": scorer.scores(rows_of(batch, "text")).round(6)})

    scored = map_arrow(docs, ["doc_id", "text"], work, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scorer.scores(rows_of(batch, "text")) < threshold))

    return docs.mapInArrow(work, docs.schema)
