"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A word's input is its embedding beside the sum of its character 4-grams' embeddings, so words that training did not see
still show their parts; both vocabularies are sorted arrays of 64-bit hashes with one row for all that is unknown. The
network reads overlapping windows of words; attention pools its states into one logit a window; all windows of a text
are scored, and the highest, calibrated on labelled texts that training left out, makes the text's score. Training takes
a bounded sample of labelled documents: a toxic one teaches through the windows that score highest in it, at first by
the log-odds of their grams, a clean one through its highest and some others.

Defined results: a null or empty text, or one without a letter or digit, scores 0; with labels of one kind only, or none,
every score is 0; of several labels of one document the highest counts, null labels and ids don't; of windows that score
alike each counts; repeated rows each get their row; an empty table gives no rows; texts of any length are scored whole;
only doc_id, text and the label are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, map_texts, picked_keys

WINDOW, STRIDE = 20, 10
GRAM = 4
#: Bound on the known words and grams, the most frequent by training documents, each in so many of them at least.
MOST_WORDS, MOST_GRAMS, LEAST_DOCS = 1 << 14, 1 << 15, 3
EMBED, HIDDEN = 8, 8
#: Bounds on the labelled documents of each label that training reads, on their length, and on the windows of an epoch.
DOCS_PER_LABEL, MOST_CHARS, EPOCH_WINDOWS = 1200, 20_000, 24_000
EPOCHS, RATE, BATCH, SEED = 8, 0.01, 256, 7
#: Weight of a clean text against a toxic one when scores are calibrated.
CLEAN_WEIGHT = 4.0


@cache
def folded() -> np.ndarray:
    """Each code point's lower-case letter or digit, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """The words of some texts: each one's text and hash or number, the same of all character 4-grams, word by word."""

    owner: np.ndarray
    word: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray

    def numbered(self, word_keys: np.ndarray, gram_keys: np.ndarray) -> Words:
        return Words(self.owner, number(self.word, word_keys), number(self.grams, gram_keys), self.gram_starts)


def number(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in a sorted vocabulary from 1 on; 0 is unknown."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at + 1, 0)


def vocabulary(hashes: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """The hashes found in the most texts, sorted."""
    pairs = np.unique(np.stack([hashes, owner.astype(np.uint64)], 1), axis=0)
    found, counts = np.unique(pairs[:, 0], return_counts=True)
    found, counts = found[counts >= LEAST_DOCS], counts[counts >= LEAST_DOCS]
    return np.sort(found[np.argsort(-counts, kind="stable")[:most]])


def words_of(texts: list[str]) -> Words:
    joined = "\n".join(["", *texts, ""])
    points = folded()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])])
    inside = points != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none.astype(np.uint64), none)
    # A gram begins at a word's preceding border and at each of its letters; borders count as 0 in it.
    n = len(points)
    padded = np.concatenate([points, np.zeros(GRAM, np.uint64)])
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    for k in range(GRAM):
        c = padded[k : k + n]
        key = key * np.uint64(0x2545F4914F6CDD1D) + np.where(alive, c, 0) + np.uint64(1)
        if k:
            alive &= c != 0
    first = np.zeros(n, bool)
    first[starts - 1] = True
    keep = np.flatnonzero(inside | first)
    # Shared borders: "a b" has one code point that is b's border only, as a's grams end at its last letter.
    gram_starts = np.searchsorted(keep, starts - 1)
    place = np.zeros(n, np.int64)
    lengths = ends - starts
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = np.flatnonzero(inside)
    place[letters] = within
    powers = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    word = mixed(np.add.reduceat(mixed(points[letters] + np.uint64(977)) * powers[place[letters] & 63], np.cumsum(lengths) - lengths))
    return Words(owner[starts], word, mixed(key[keep]), gram_starts)


def windows_of(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its first word and number of words: every STRIDE words, the last one reaching the text's end."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.append(heads, len(owner)))
    count = np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(heads, count) + number * STRIDE
    return start, np.minimum(WINDOW, np.repeat(heads + sizes, count) - start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    word_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    gram_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fresh(word_keys: np.ndarray, gram_keys: np.ndarray) -> Network:
        r = np.random.default_rng(SEED)
        w = lambda *s, k=None: (r.standard_normal(s) * (k or s[0] ** -0.5)).astype(np.float32)
        p = {"words": w(len(word_keys) + 1, EMBED, k=0.05), "grams": w(len(gram_keys) + 1, EMBED, k=0.05), "att": w(2 * HIDDEN, 2 * HIDDEN), "att_v": w(2 * HIDDEN), "out": w(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"x{d}": w(2 * EMBED, 3 * HIDDEN), f"h{d}": w(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return Network(p, word_keys, gram_keys)

    def inputs(self, words: Words) -> np.ndarray:
        """A row for each word; the last row, of zeros, pads."""
        out = np.zeros((len(words.owner) + 1, 2 * EMBED), np.float32)
        if len(words.owner):
            out[:-1, :EMBED] = self.p["words"][words.word]
            out[:-1, EMBED:] = np.add.reduceat(self.p["grams"][words.grams], words.gram_starts)
        return out

    def run(self, projected: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows given as indices of words (windows x WINDOW); keep: also what the gradients need."""
        n, h = len(at), HIDDEN
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        memo: dict[str, list] = {"f": [], "b": []}
        for d, order, side in (("f", range(WINDOW), slice(0, h)), ("b", range(WINDOW - 1, -1, -1), slice(h, 2 * h))):
            now, rec = np.zeros((n, h), np.float32), self.p[f"h{d}"]
            for t in order:
                x, g = projected[d][at[:, t]], now @ rec
                zr = sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                m = mask[:, t : t + 1]
                new = now + m * z * (c - now)
                if keep:
                    memo[d].append((t, now, z, r, c, g[:, 2 * h :], m))
                now = new
                states[t][:, side] = now
        u = np.tanh(states @ self.p["att"])
        e = np.where(mask.T, u @ self.p["att_v"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, states, memo, u, a, pooled) if keep else logit

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each window's text and logit, in blocks of windows."""
        start, size = windows_of(words.owner)
        projected = self.project(self.inputs(words))
        out = np.zeros(len(start), np.float32)
        for k in range(0, len(start), 4096):
            at, mask = places(start[k : k + 4096], size[k : k + 4096], len(words.owner))
            out[k : k + 4096] = self.run(projected, at, mask)
        return words.owner[start] if len(start) else start, out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), -np.inf, np.float64)
        if self.p:
            owner, logit = self.window_logits(words_of([t or "" for t in texts]).numbered(self.word_keys, self.gram_keys))
            np.maximum.at(out, owner, logit)
        seen = np.isfinite(out)
        return np.where(seen, 1 / (1 + np.exp(-np.clip(self.slope * np.where(seen, out, 0) + self.shift, -500, 500))), 0.0)

    def gradients(self, words: Words, at: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log-loss of a batch of windows, by backpropagation through both directions."""
        p, h, n = self.p, HIDDEN, len(at)
        used, where = np.unique(at, return_inverse=True)
        where = where.reshape(at.shape)
        x = np.zeros((len(used), 2 * EMBED), np.float32)
        real = used < len(words.owner)
        spans = np.append(words.gram_starts, len(words.grams))
        a0, a1 = spans[used[real]], spans[used[real] + 1]
        counts = a1 - a0
        gram_at = np.repeat(a0 - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        gram_ids, word_ids = words.grams[gram_at], words.word[used[real]]
        x[real, :EMBED] = p["words"][word_ids]
        x[real, EMBED:] = np.add.reduceat(p["grams"][gram_ids], np.cumsum(counts) - counts)
        logit, states, memo, u, a, pooled = self.run(self.project(x), where, mask, keep=True)
        d_logit = ((sigmoid(logit) - label) / n).astype(np.float32)
        g = {"bias": d_logit.sum(keepdims=True), "out": pooled.T @ d_logit}
        d_pool = d_logit[:, None] * p["out"]
        d_states = a[:, :, None] * d_pool
        d_a = np.einsum("tnh,nh->tn", states, d_pool)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_u = d_e[:, :, None] * p["att_v"] * (1 - u * u)
        g["att_v"] = np.einsum("tn,tnh->h", d_e, u)
        g["att"] = np.einsum("tni,tnj->ij", states, d_u)
        d_states = d_states + d_u @ p["att"].T
        d_x = np.zeros_like(x)
        for d, side in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            d_now = np.zeros((n, h), np.float32)
            rec, into, d_rec = p[f"h{d}"], np.zeros((len(used), 3 * h), np.float32), np.zeros_like(p[f"h{d}"])
            for t, before, z, r, c, gc, m in reversed(memo[d]):
                d_new = d_now + d_states[t][:, side]
                d_c = d_new * m * z * (1 - c * c)
                d_z = d_new * m * (c - before) * z * (1 - z)
                d_r = d_c * gc * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_c], 1)
                d_g = np.concatenate([d_z, d_r, d_c * r], 1)
                np.add.at(into, where[:, t], d_in)
                d_rec += before.T @ d_g
                d_now = d_new * (1 - m * z) + d_g @ rec.T
            g |= {f"h{d}": d_rec, f"x{d}": x.T @ into, f"c{d}": into.sum(0)}
            d_x += into @ p[f"x{d}"].T
        g["words"], g["grams"] = (word_ids, d_x[real, :EMBED]), (gram_ids, np.repeat(d_x[real, EMBED:], counts, axis=0))
        return g


def places(start: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(WINDOW)
    mask = steps < size[:, None]
    return np.where(mask, start[:, None] + steps, pad), mask


class Adam:
    """Adam; embedding rows move only where a batch uses them."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, d in g.items():
            at: object = slice(None)
            if isinstance(d, tuple):
                at, inverse = np.unique(d[0], return_inverse=True)
                rows = np.zeros((len(at), d[1].shape[1]), np.float32)
                np.add.at(rows, inverse, d[1])
                d = rows
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * d * d
            self.p[k][at] -= rate * self.m[k][at] / (self.v[k][at] ** 0.5 + 1e-8)


def train(rows: list[tuple[str, int]]) -> Network:
    """A network from (text, 0 or 1); without both labels an empty one, whose scores are 0.

    Every fourth text of a label is left out of the gradients; these calibrate the scores.
    """
    if len({v for _, v in rows}) < 2:
        return Network()
    ordered = [r for v in (0, 1) for r in rows if r[1] == v]
    checked = [r for i, r in enumerate(ordered) if i % 4 == 3]
    rows = [r for i, r in enumerate(ordered) if i % 4 != 3]
    words = words_of([t for t, _ in rows])
    gram_owner = np.repeat(words.owner, np.diff(np.append(words.gram_starts, len(words.grams))))
    net = Network.fresh(vocabulary(words.word, words.owner, MOST_WORDS), vocabulary(words.grams, gram_owner, MOST_GRAMS))
    words = words.numbered(net.word_keys, net.gram_keys)
    label = np.array([v for _, v in rows], np.float32)
    start, size = windows_of(words.owner)
    doc = words.owner[start]
    r = np.random.default_rng(SEED)
    adam = Adam(net.p, RATE)
    toxic = label[doc] == 1
    for epoch in range(EPOCHS):
        adam.rate = RATE if epoch < EPOCHS - 2 else RATE / 4
        if epoch:
            logit, best = highest(net, words, len(rows))
        else:
            logit, best = telling(words, label, start, size, len(rows))
        top = logit >= best[doc] - 1e-6
        teaches, hard = toxic & (top | (logit > 2 if epoch > 1 else False)), np.flatnonzero(~toxic & top)
        chosen = np.concatenate([r.permutation(np.flatnonzero(teaches))[: EPOCH_WINDOWS // 2], r.permutation(np.flatnonzero(~toxic))[: EPOCH_WINDOWS // 2], hard])
        chosen = r.permutation(chosen)
        for k in range(0, len(chosen), BATCH):
            part = chosen[k : k + BATCH]
            at, mask = places(start[part], size[part], len(words.owner))
            adam.step(net.gradients(words, at, mask, label[doc[part]]))
    if len({v for _, v in checked}) == 2:
        best = highest(net, words_of([t for t, _ in checked]).numbered(net.word_keys, net.gram_keys), len(checked))[1]
        known = np.isfinite(best)
        net.slope, net.shift = calibrated(best[known], np.array([v for _, v in checked], np.float64)[known])
    return net


def telling(words: Words, label: np.ndarray, start: np.ndarray, size: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """A first guess at each window's logit, by its most telling gram's log-odds among the labelled texts; and each text's highest."""
    owner = np.repeat(words.owner, np.diff(np.append(words.gram_starts, len(words.grams))))
    pairs = np.unique(owner * (MOST_GRAMS + 1) + words.grams)
    marks, grams = label[pairs // (MOST_GRAMS + 1)], pairs % (MOST_GRAMS + 1)
    counts = [np.bincount(grams, marks == v, MOST_GRAMS + 1) + 0.5 for v in (1, 0)]
    odds = np.log(counts[0] / counts[1])
    odds[0] = -10
    of_word = np.maximum.reduceat(odds[words.grams], words.gram_starts)
    at, mask = places(start, size, 0)
    logit = np.where(mask, of_word[at], -10).max(1)
    best = np.full(texts, -np.inf)
    np.maximum.at(best, words.owner[start], logit)
    return logit, best


def highest(net: Network, words: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window's logit, and the highest of each text."""
    owner, logit = net.window_logits(words)
    best = np.full(texts, -np.inf)
    np.maximum.at(best, owner, logit)
    return logit, best


def calibrated(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the texts' highest logits, by Newton's steps; clean texts weigh more, as they are more."""
    weight = np.where(label == 1, 1.0, CLEAN_WEIGHT)
    mid, spread = logit.mean(), logit.std() + 1e-6
    x, w, pull = np.stack([(logit - mid) / spread, np.ones(len(logit))], 1), np.zeros(2), 0.003 * weight.sum()
    for _ in range(50):
        q = 1 / (1 + np.exp(-(x @ w)))
        w = w + np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + pull * np.eye(2), x.T @ (weight * (label - q)) - pull * w)
    return float(w[0] / spread), float(w[1] - w[0] * mid / spread)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Network:
    """Learns from labelled documents whose crc32 of the key modulo 5 is not 0; of each label a bounded sample.

    Labels of one document are merged by their maximum; null labels and keys don't count.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(~crc_fold("doc_id", 5, 0) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    keys = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in picked_keys(marks, "label", DOCS_PER_LABEL, "doc_id").collect()], marks.schema)
    # The sample's keys are bounded, so they go to the documents and not the texts to them.
    texts = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").where(F.length("text") <= MOST_CHARS)
    return train(sorted((r["text"], r["label"]) for r in texts.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "label").limit(4 * DOCS_PER_LABEL).collect()))


def toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return map_texts(docs, [("score", T.DoubleType())], lambda texts: [shared.value.scores(texts).tolist()])


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return toxicity(docs, fit(docs, labels)).select("doc_id", crc_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
