"""Secrets in text: three fixed rules, and character Markov models for strings that the rules don't know.

Two order-2 Markov models over the characters of base-64 alphabets, one of random strings and one of ordinary
identifiers, score each candidate (a long run of those characters outside the rules' spans, with a letter and a digit); a
candidate is a secret if the log-likelihood ratio per character exceeds a threshold. The models are trained from labelled
samples: random strings of several alphabets from a seeded generator are secrets; ordinary are identifiers as they stand
in the sources of Python's own library, and words of a bounded sample of documents, as they stand and composed as names,
paths and numbers are. A fourth of either sample is left out of the models, and sets the threshold: halfway between what
all but a bounded share of the ordinary strings left out stay below, and what all but a bounded share of the random ones
exceed; the former alone where that is higher.

Defined results: null is scanned as empty; an empty text has no span; an empty table gives no rows, and models without its
words; repeated rows each get their row; whole texts are scanned, however long; spans are in code points; where spans of
different kinds begin together, they come in the order of the kinds; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, map_texts, text_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD_PARTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: A candidate for the models: so many characters at least, a letter and a digit among them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Shares of the candidates left out of training that bound the threshold: ordinary ones above it, random ones below it.
FALSE_ALARMS, MISSES = 0.002, 0.03
#: Bound on the files of Python's library that are read for identifiers.
LIBRARY_FILES = 400
#: Bound on the documents from which ordinary strings are taken, and on each one's length.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 20_000
SEED = 11


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three rules' matches."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORD_PARTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Markov:
    """Order-2 log-probabilities, interpolated with order 1 and a uniform floor; the last row stands for a string's start."""

    def __init__(self, strings: list[str]):
        n = len(ALPHABET)
        two, one = np.zeros((n + 1, n + 1, n)), np.zeros((n + 1, n))
        for s in strings:
            x = [n, n, *codes(s)]
            np.add.at(two, (x[:-2], x[1:-1], x[2:]), 1)
            np.add.at(one, (x[1:-1], x[2:]), 1)
        flat = (one.sum(0) + 1) / (one.sum() + n)
        p1 = (one + 4 * flat) / (one.sum(1, keepdims=True) + 4)
        p2 = (two + 4 * p1[None]) / (two.sum(2, keepdims=True) + 4)
        self.log = np.log(p2)

    def score(self, s: str) -> float:
        n = len(ALPHABET)
        x = [n, n, *codes(s)]
        return float(self.log[x[:-2], x[1:-1], x[2:]].sum())


def codes(s: str) -> list[int]:
    return [ALPHABET.index(c) for c in s if c in ALPHABET]


def random_strings(rng: random.Random, count: int) -> list[str]:
    kinds = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62])
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randrange(20, 64))) for i in range(count)]


def identifiers(rng: random.Random, texts: list[str], count: int) -> list[str]:
    """Ordinary strings: words as they stand, words joined as identifiers and paths are, with short numbers, and numbers."""
    words = []
    for t in texts:
        # What could itself be a secret says nothing about ordinary words.
        taken = [(a, b) for a, _, b in base_spans(t)] + [m.span() for m in CANDIDATE.finditer(t) if mixed(m[0])]
        words += [m[0] for m in re.finditer(r"[A-Za-z]+", t) if not any(a <= m.start() < b for a, b in taken)]
    words = words or ["value", "name", "item", "count"]
    out = []
    for i in range(count):
        parts = [rng.choice(words) for _ in range(rng.randrange(2, 6))]
        number = str(rng.randrange(10 ** rng.randrange(1, 5)))
        out.append([
            "_".join(parts).lower(), "".join(p.capitalize() for p in parts), "-".join([*parts, number]), "/".join(parts),
            "".join(parts).lower() + number, "_".join([*parts, number]).upper(), "".join(parts),
            "-".join(str(rng.randrange(10 ** rng.randrange(2, 9))) for _ in parts), str(rng.randrange(10 ** 18)),
        ][i % 9])
    return out


@cache
def library_names() -> tuple[str, ...]:
    """Different runs of candidate characters in the sources of Python's library, in order; names of its build settings too."""
    import sysconfig
    from pathlib import Path

    files = [f for f in sorted(Path(sysconfig.get_path("stdlib")).glob("**/*.py")) if not {"site-packages", "test", "tests", "idlelib"} & set(f.parts)]
    out = set(sysconfig.get_config_vars())
    for f in files[:: max(1, len(files) // LIBRARY_FILES)][:LIBRARY_FILES]:
        out.update(re.findall(r"[A-Za-z0-9+/_-]{8,}={0,2}", f.read_text(encoding="utf-8", errors="ignore")))
    return tuple(sorted(x for x in out if not HEX.search(x)))


class Models(NamedTuple):
    random: Markov
    ordinary: Markov
    threshold: float  # nats per character

    def ratio(self, s: str) -> float:
        return (self.random.score(s) - self.ordinary.score(s)) / len(s)

    def secret(self, s: str) -> bool:
        return mixed(s) and self.ratio(s) > self.threshold


def mixed(s: str) -> bool:
    return bool(re.search("[0-9]", s) and re.search("[A-Za-z]", s))


def labelled(texts: list[str], count: int, seed: int = SEED) -> tuple[list[str], list[str]]:
    """Random strings, and ordinary ones."""
    rng = random.Random(seed)
    return random_strings(rng, count), [*identifiers(rng, texts, count), *library_names()]


def train(texts: list[str], count: int = 6000) -> Models:
    secret, ordinary = labelled(texts, count)
    # Every fourth is left out; by position, which has nothing to do with what a string is.
    fit = [[s for i, s in enumerate(x) if i % 4 != 3] for x in (secret, ordinary)]
    models = Models(Markov(fit[0]), Markov(fit[1]), 0.0)
    # Repeated words say little, and a run that can't be a candidate nothing; both sides count as they would be met.
    left = [sorted(models.ratio(s) for s in {s for i, s in enumerate(x) if i % 4 == 3 and mixed(s) and CANDIDATE.fullmatch(s)}) for x in (secret, ordinary)]
    low = max(0.0, float(np.quantile(left[1], 1 - FALSE_ALARMS))) if left[1] else 0.0
    high = float(np.quantile(left[0], MISSES))
    return models._replace(threshold=max(low, (low + high) / 2))


def all_spans(text: str, models: Models) -> tuple[list, list]:
    """The rules' spans, and with them those of the models, which overlap none of the rules'."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if not any(x < b and a < y for x, _, y in base) and models.secret(m[0]):
            more.append((a, 3, b))
    return base, sorted(base + more)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fit(df: DataFrame) -> Models:
    """Models with ordinary strings from a bounded sample: documents with the least hashes of the key."""
    sample = df.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text").where(F.length("text").between(1, SAMPLE_CHARS))
    least = [r["h"] for r in sample.select("h").orderBy("h").limit(SAMPLE_DOCS).collect()]  # hashes alone, then these texts
    texts = sample.where(F.col("h") <= least[-1]).orderBy("h", F.xxhash64("text")).limit(SAMPLE_DOCS).collect() if least else []
    return train([r["text"] for r in texts])


def find_secrets(df: DataFrame, models: Models | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(models or fit(df))

    def work(texts):
        found = [all_spans(t or "", shared.value) for t in texts]
        return [
            *([sum(x[1] == k for x in base) for base, _ in found] for k in range(3)),
            [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found],
            [shown(every) for _, every in found],
        ]

    return map_texts(df, [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())], work)


def redact(df: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with each secret, by rule or by model, replaced by a mark; n_chars follows the text; null texts stay."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df))

    def work(texts):
        out = []
        for t in texts:
            at, parts = 0, []
            for a, _, b in all_spans(t or "", shared.value)[1]:
                if b > at:
                    parts += [(t or "")[at : max(a, at)], mark if a >= at else ""]
                    at = b
            out.append("".join([*parts, t[at:]]) if t is not None else None)
        return out

    bounded_batches(df.sparkSession)
    schema = df.schema

    def run(batches):
        for part in text_slices(batches):
            texts = work(part.column("text").to_pylist())
            columns = {n: part.column(n) for n in part.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.mapInArrow(run, schema)
