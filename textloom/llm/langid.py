"""Language identification: an interpolated Kneser-Ney character model for each language, in sorted hash arrays.

Letters in lower case are symbols, a run of anything else is one boundary. The models have order 4. All languages share
one sorted array of packed n-gram keys per order, with a column of log-probabilities for each language, so one binary
search a character scores every language; unseen 4-grams back off through the context's weight to lower orders. The
language of lowest cross-entropy per symbol wins; the score is a softmax whose temperature is calibrated on labelled
documents that the counts don't use, and a document is rejected if its score is near chance or its cross-entropy lies
halfway from what those documents show to pure chance.

Defined results: a null text, or one without a letter, is `und` with score 0; with no labelled text at all everything is,
and `keep_identified` then keeps all rows, as nothing was learned to reject by; of more than 200 label values the most
frequent are learned; ties go to the first language by name; repeated rows each get their row; an empty table gives no
rows; whole texts are scored, however long; other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_fold, labelled_sample, map_texts, text_slices

ORDER = 4
#: Symbols kept apart: 0 pads, 1 is a boundary, 2 any rarer letter; the rest are the most frequent letters.
BITS, SYMBOLS = 7, 127
#: Bound on the documents a language that training reads; a fifth of them calibrate.
DOCS_PER_LANGUAGE = 300
#: Rejected: a score below so many times chance that no calibrating document's score was as low, or more nats a symbol than
#: halfway from the worst calibrating document to pure chance.
LEAST_SCORE = 1.2
TEMPERATURES = (0.25, 0.5, 1, 2, 4, 8, 16, 32)


@cache
def lowered() -> np.ndarray:
    """Each code point's lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with runs of others as one 0, a 0 at each text's ends; and each symbol's text."""
    joined = "\n".join(["", *texts, ""])
    points = lowered()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    lengths = np.array([len(t) + 1 for t in texts])
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)])
    keep = np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])
    return points[keep], owner[keep]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray = field(default_factory=lambda: np.zeros(0))  # symbol of each code point
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by order: keys, log-probabilities
    backoff: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by order: context keys, log-weights
    temperature: float = 1.0
    most_nats: float = float("inf")
    least_score: float = 0.0

    def nats(self, symbols: np.ndarray) -> np.ndarray:
        """Negative log-probability of each symbol from the second on, for each language."""
        padded = np.concatenate([np.zeros(ORDER - 2, np.int32), symbols.astype(np.int32)])
        n = len(symbols) - 1
        keys = np.zeros(n, np.int32)
        for k in range(ORDER):
            keys = keys << BITS | padded[k : k + n]
        return -self.lookup(keys, ORDER)

    def lookup(self, keys: np.ndarray, order: int) -> np.ndarray:
        known, logs = self.grams[order]
        if order == 1:
            return logs[keys]
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = logs[place]
        missing = np.flatnonzero(known[place] != keys)
        if len(missing):
            m = keys[missing]
            contexts, weights = self.backoff[order]
            c = m >> BITS
            at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            lower = self.lookup(m & ((1 << BITS * (order - 1)) - 1), order - 1)
            out[missing] = lower + np.where((contexts[at] == c)[:, None], weights[at], 0.0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol for each text and language, and whether the text has a letter."""
        points, owner = letters(texts)
        symbols = self.table[points]
        nats = self.nats(symbols)
        count = np.bincount(owner[1:], minlength=len(texts))
        sums = np.stack([np.bincount(owner[1:], nats[:, j], len(texts)) for j in range(len(self.languages))], 1)
        has = np.bincount(owner[1:], points[1:] != 0, len(texts)) > 0
        return sums / np.maximum(count, 1)[:, None], has

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts), [0.0] * len(texts)
        h, has = self.entropies([t or "" for t in texts])
        best, p = h.argmin(1), softmax(h, self.temperature)
        score = np.where(has, p[np.arange(len(best)), best], 0.0)
        least = h.min(1)
        rejected = ~has | (score < self.least_score) | (least > self.most_nats)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)], score.tolist(), rejected.tolist(), np.where(has, least, 0.0).tolist()


def softmax(h: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-(h - h.min(1, keepdims=True)) * temperature)
    return e / e.sum(1, keepdims=True)


def grams_of(symbols: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([np.zeros(order - 2 if order > 1 else 0, np.int64), symbols.astype(np.int64)])
    n = len(symbols) - (order > 1)
    keys = np.zeros(n, np.int64)
    for k in range(order):
        keys = keys << BITS | padded[k : k + n]
    return np.unique(keys, return_counts=True)


def discount(counts: np.ndarray) -> float:
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    return float(min(0.95, max(0.1, ones / (ones + 2 * twos)))) if ones else 0.5


class KneserNey:
    """One language's counts: raw at the highest order, numbers of different left neighbours below."""

    def __init__(self, symbols: np.ndarray):
        self.size = 1 << BITS
        keys, counts = grams_of(symbols, ORDER)
        self.levels = {}
        for order in range(ORDER, 0, -1):
            context, where = np.unique(keys >> BITS, return_inverse=True)
            d = discount(counts)
            total, kinds = np.bincount(where, counts), np.bincount(where)
            self.levels[order] = keys, counts, d, context, total, kinds
            if order > 1:
                keys, counts = np.unique(keys & ((1 << BITS * (order - 1)) - 1), return_counts=True)

    def weight(self, contexts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The interpolation weight of lower orders after each context, and its total; 1 and 0 if never seen."""
        _, _, d, known, total, kinds = self.levels[order]
        at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        seen = known[at] == contexts
        return np.where(seen, d * kinds[at] / total[at], 1.0), np.where(seen, total[at], 0)

    def p(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 1 / self.size)
        known, counts, d, *_ = self.levels[order]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        c = np.where(known[at] == keys, np.maximum(counts[at] - d, 0), 0)
        weight, total = self.weight(keys >> BITS, order)
        return c / np.maximum(total, 1) + weight * self.p(keys & ((1 << BITS * (order - 1)) - 1), order - 1)


def train(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language); every fifth text of a language calibrates instead of being counted."""
    languages = sorted({v for _, v in rows})
    if not languages:
        return Model([])
    fit: dict[str, list[str]] = {v: [] for v in languages}
    check = []
    for v in languages:
        own = [t for t, x in rows if x == v]
        for i, t in enumerate(own):
            if i % 5 == 4:
                check.append((t, v))
            else:
                fit[v].append(t)
    points = {v: letters(ts)[0] for v, ts in fit.items()}
    found, counts = np.unique(np.concatenate(list(points.values())), return_counts=True)
    frequent = [p for _, p in sorted(zip((-counts).tolist(), found.tolist(), strict=True)) if p][: SYMBOLS - 3]
    table = np.full(0x110000, 2, np.uint8)
    table[0] = 1
    table[frequent] = np.arange(3, 3 + len(frequent))
    model = Model(languages, table)
    own = {v: KneserNey(table[p]) for v, p in points.items()}
    for order in range(1, ORDER + 1):
        keys = np.arange(1 << BITS) if order == 1 else np.unique(np.concatenate([k.levels[order][0] for k in own.values()]))
        model.grams[order] = keys.astype(np.int32), np.stack([np.log(own[v].p(keys, order)) for v in languages], 1).astype(np.float32)
        if order > 1:
            contexts = np.unique(keys >> BITS)
            model.backoff[order] = contexts.astype(np.int32), np.stack([np.log(own[v].weight(contexts, order)[0]) for v in languages], 1).astype(np.float32)
    if check:
        h, has = model.entropies([t for t, _ in check])
        truth = np.array([languages.index(v) for _, v in check])[has]
        h = h[has]
        if len(h):
            loss = {t: -np.log(np.maximum(softmax(h, t)[np.arange(len(h)), truth], 1e-9)).mean() for t in TEMPERATURES}
            model.temperature = min(loss, key=loss.get)
            model.most_nats = float((h.min(1).max() + np.log(1 << BITS)) / 2)
            model.least_score = min(0.9, LEAST_SCORE / len(languages), float(softmax(h, model.temperature).max(1).min()))
    return model


def fit_languages(df: DataFrame) -> Model:
    """Learns from text and non-null lang of documents whose crc32 of the key modulo 4 is not 2, a bounded sample of them."""
    return train(labelled_sample(df.where(~crc_fold("doc_id", 4, 2)), "lang", DOCS_PER_LANGUAGE))


def identify(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected, nats (a symbol, of the language predicted) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(df, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType()), ("nats", T.DoubleType())], lambda texts: list(shared.value.predict(texts)))


def keep_identified(df: DataFrame) -> DataFrame:
    """The documents, with all their columns, that identification does not reject; all of them if no language was learned."""
    model = fit_languages(df)
    if not model.languages:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)
    bounded_batches(df.sparkSession)

    def run(batches):
        for part in text_slices(batches):
            rejected = shared.value.predict(part.column("text").to_pylist())[2]
            yield part.filter(pc.invert(pa.array(rejected, pa.bool_())))

    return df.mapInArrow(run, df.schema)


def predictions(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and whether the document is rejected."""
    out = identify(df, fit_languages(df))
    return out.select("doc_id", crc_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected", F.col("nats"))
