"""Functions that SQL texts call and Spark lacks: Arrow batches in numpy, registered where a text names them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType

#: The prime of the hashes, their seed, and how many are drawn: 14 bands of 8 rows.
PRIME, SEED, HASHES = (1 << 61) - 1, 0, 112


def coefficients(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Independent multipliers (from 1) and shifts (from 0) of 32 bits."""
    r = np.random.default_rng(SEED)
    return r.integers(1, 1 << 32, n, dtype=np.uint64), r.integers(0, 1 << 32, n, dtype=np.uint64)


def least_hashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each list of 32-bit fingerprints the least (a x + b) mod PRIME of every hash; products stay below 2**64."""
    p, out = np.uint64(PRIME), []
    for a, b in zip(*coefficients(), strict=True):
        v = flat * a
        v = (v & p) + (v >> np.uint64(61)) + b
        v = (v & p) + (v >> np.uint64(61))
        out.append(np.minimum.reduceat(np.where(v >= p, v - p, v), starts))
    return np.stack(out, 1)


@pandas_udf(ArrayType(LongType()))
def min_hashes(fps: pd.Series) -> pd.Series:
    """Signatures of lists of fingerprints; null or empty lists have none."""
    sizes = np.array([0 if x is None else len(x) for x in fps])
    some = np.flatnonzero(sizes)
    out: list = [None] * len(fps)
    for k in range(0, len(some), 256):  # bounded work, however long the lists
        part = some[k : k + 256]
        starts = np.cumsum(sizes[part]) - sizes[part]
        for i, row in zip(part.tolist(), least_hashes(np.concatenate([fps.iloc[i] for i in part]).astype(np.uint64), starts).astype(np.int64), strict=True):
            out[i] = row
    return pd.Series(out)


def top_counts(text: str | None) -> list[int]:
    """How often the most frequent gram of 2, 3 and 4 characters occurs; 0 where the text is shorter."""
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    ids = np.unique(points, return_inverse=True)[1].astype(np.uint64)
    wide = len(ids) and int(ids.max()) > 0xFFFF
    out, key = [], ids
    for n in (2, 3, 4):
        if len(points) < n:
            out.append(0)
            continue
        # With more than 65,536 different characters, keys are numbered anew before they grow.
        key = key[:-1] * np.uint64(1 << (21 if wide else 16)) + ids[n - 1 :]
        found, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        out.append(int(counts.max()))
        key = inverse.astype(np.uint64) if wide else key
    return out


@pandas_udf(ArrayType(LongType()))
def top_grams(text: pd.Series) -> pd.Series:
    return text.map(top_counts)


def t_quantiles(level: float = 0.95, most: int = 60) -> list[float]:
    """Two-sided quantiles of Student's t for 1 to `most` degrees of freedom, by bisection of its tail."""
    from ..operators.regressions import t_tail

    out = []
    for df in range(1, most + 1):
        low, high = 0.0, 1000.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if t_tail(mid, df) > (1 - level) / 2 else (low, mid)
        out.append((low + high) / 2)
    return out


#: Exponents that a power law is tried with.
ALPHAS = np.round(0.02 + 0.005 * np.arange(237), 3)


@pandas_udf(ArrayType(DoubleType()))
def power_sums(d: pd.Series, loss: pd.Series) -> np.ndarray:
    """Of some points of a curve: count, mean loss and its centred square; then for every exponent the mean of w, d to the minus
    exponent, its centred squares, and its centred products with the loss. A shift by the first point keeps equal values exact."""
    y, x = loss.to_numpy() - loss.iat[0], d.to_numpy()
    w, step = np.empty((len(ALPHAS), len(x))), np.power(x, -0.005)
    for k in range(len(ALPHAS)):  # a product is five times as fast as a power; every 16th is a power, so errors stay below 1e-14
        np.multiply(w[k - 1], step, out=w[k]) if k % 16 else np.power(x, -ALPHAS[k], out=w[k])
    first = w[:, 0].copy()
    w -= first[:, None]
    low, mean = y.mean(), w.mean(1)
    y -= low
    w -= mean[:, None]
    return np.concatenate([[len(y), loss.iat[0] + low, y @ y], first + mean, np.einsum("ij,ij->i", w, w), w @ y])


@pandas_udf(ArrayType(DoubleType()))
def best_power(parts: pd.Series) -> list:
    """From the sums of a curve's parts: exponent, slope, intercept and squared error of the fit of least error, to nine places, whose
    slope isn't negative; of several the least exponent; nothing if no exponent has a slope."""
    m, k = np.stack(parts), len(ALPHAS)
    n, y, w = m[:, :1], m[:, 1:2], m[:, 3 : 3 + k]
    dy, dw = y - y[0], w - w[0]
    dy, dw = dy - (n * dy).sum(0) / n.sum(), dw - (n * dw).sum(0) / n.sum()
    mean_y, mean_w = (y - dy)[0, 0], (w - dw)[0]
    yy, ww, wy = m[:, 2].sum() + (n * dy * dy).sum(), m[:, 3 + k : 3 + 2 * k].sum(0) + (n * dw * dw).sum(0), m[:, 3 + 2 * k :].sum(0) + (n * dw * dy).sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = wy / ww
        sse = np.maximum(yy - slope * wy, 0)
        error = np.where(np.isnan(sse), np.inf, np.round(sse, 9))
    some = np.flatnonzero((ww != 0) & ~(slope < 0))
    if not len(some):
        return []
    i = some[np.argmin(error[some])]
    return [ALPHAS[i], slope[i], mean_y - slope[i] * mean_w[i], sse[i]]


FUNCTIONS = {"min_hashes": min_hashes, "top_grams": top_grams, "power_sums": power_sums, "best_power": best_power}


def register_named(spark: SparkSession, text: str) -> None:
    """Registers the functions that a SQL text calls."""
    for name, f in FUNCTIONS.items():
        if re.search(rf"\b{name}\(", text):
            spark.udf.register(name, f)


def register_active(text: str) -> str:
    """The text, after its functions are registered in the thread's session, if it has one: for plans run without their tables' views."""
    if (spark := SparkSession.getActiveSession()) is not None:
        register_named(spark, text)
    return text
