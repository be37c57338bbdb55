"""Regressions with a fixed effect a student: sums by Catalyst, solved from one row of them, whatever the number of runs.

Columns are centred within students, which gives the slopes that a dummy a student would give. A first pass sums their
products, a second the leverages' weights for HC3 errors; only those sums, a fixed number, reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Regressors of each model beside the students' effects: x and its square, by size s, by dose d; or a mean for each rank of x.
MODELS = {
    "M0": (),
    "M1": ("x",),
    "M2": ("x", "x2"),
    "M3": ("x", "x2", "sx", "sx2"),
    "M4": ("x", "x2", "sx", "sx2", "d", "dx", "ds"),
    "M3cat": ("c2", "c3", "c4", "c5"),
}
#: Models that are tested against another than the one before them: a mean for each rank holds every curve of the ranks.
PARENTS = {"M3cat": "M2"}
COLUMNS = {"x": "x", "x2": "x * x", "sx": "s * x", "sx2": "s * x * x", "d": "d", "dx": "d * x", "ds": "d * s"} | {f"c{k}": f"CAST(x = {k} AS DOUBLE)" for k in range(2, 6)}


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, total = 1e-300, 1.0, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def f_tail(f: float, df1: float, df2: float) -> float:
    """Probability of an F value above f."""
    return float("nan") if not (df1 > 0 and df2 > 0 and f >= 0) else beta_tail(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def t_tail(t: float, df: float) -> float:
    """Probability of a t value above t."""
    half = 0.5 * beta_tail(df / (df + t * t), df / 2, 0.5)
    return half if t >= 0 else 1 - half


def chi2_tail(x: float, df: float) -> float:
    """Probability of a chi-squared value above x: the series of the lower incomplete gamma function, or the upper's fraction."""
    a, h = df / 2, x / 2
    if h <= 0:
        return 1.0
    front = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= h / (a + k)
            total += term
            if term < total * 1e-15:
                break
        return 1 - front * total
    b = h + 1 - a
    c, d = 1e300, 1 / b
    total = d
    for k in range(1, 1000):
        b += 2
        d = 1 / (b - k * (k - a) * d)
        c = b - k * (k - a) / c
        total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def model_sequence(runs: DataFrame) -> DataFrame:
    """model, n, k, rss, r2, aicc, loglik, f, p (against the model before), lr, lr_p, terms, slopes, hc3 of runs (student, x, s, d, y).

    Rows with a null or non-finite number take no part. Columns that centring leaves empty, or that others give, take
    the least-norm slope. Without rows the table is empty.
    """
    spark, names = runs.sparkSession, list(COLUMNS)
    numbers = ("x", "s", "d", "y")
    known = " AND ".join(f"{c} IS NOT NULL AND abs({c}) < 1e300 AND NOT isnan({c})" for c in numbers)
    wide = runs.select("student", *(F.col(c).cast("double").alias(c) for c in numbers)).where(known).select("student", F.col("y").alias("y"), *(F.expr(e).alias(f"z_{n}") for n, e in COLUMNS.items()))
    keys = ["y", *(f"z_{n}" for n in names)]
    means = wide.groupBy("student").agg(F.count("*").alias("m"), *(F.avg(k).alias(f"a_{k}") for k in keys))
    centred = wide.join(means, "student").select("m", *((F.col(k) - F.col(f"a_{k}")).alias(k) for k in keys))
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(keys) for j, b in enumerate(keys) if i <= j]
    sums = centred.agg(F.count("*").alias("n"), F.sum(1 / F.col("m")).alias("groups"), *products).first()
    schema = "model string, n long, k int, rss double, r2 double, aicc double, loglik double, f double, p double, lr double, lr_p double, terms array<string>, slopes array<double>, hc3 array<double>"
    if not sums["n"]:
        return spark.createDataFrame([], schema)
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(len(keys))] for i in range(len(keys))])
    n, groups = sums["n"], round(sums["groups"])
    fits, weights = {}, []
    for model, terms in MODELS.items():
        at = [1 + names.index(t) for t in terms]
        scale = np.sqrt(np.maximum(gram[at, at], 1e-300))
        inverse = np.linalg.pinv(gram[np.ix_(at, at)] / scale / scale[:, None], rcond=1e-10) / scale / scale[:, None] if at else np.zeros((0, 0))
        slopes = inverse @ gram[at, 0]
        rss = max(float(gram[0, 0] - slopes @ gram[at, 0]), 0.0)
        fits[model] = at, inverse, slopes, rss, groups + (int(np.linalg.matrix_rank(gram[np.ix_(at, at)] / scale / scale[:, None], tol=1e-10)) if at else 0)
        if at:
            z = [F.col(keys[i]) for i in at]
            residual = F.col("y") - sum(F.lit(float(b)) * c for b, c in zip(slopes, z, strict=True))
            leverage = 1 / F.col("m") + sum(F.lit(float(inverse[i, j])) * z[i] * z[j] for i in range(len(at)) for j in range(len(at)))
            w = F.pow(residual / F.greatest(1 - leverage, F.lit(1e-12)), 2)
            weights += [F.sum(w * z[i] * z[j]).alias(f"{model}_{i}_{j}") for i in range(len(at)) for j in range(i, len(at))]
    second = centred.agg(*weights).first()
    out, name = [], None
    for model, (at, inverse, slopes, rss, k) in fits.items():
        meat = np.array([[second[f"{model}_{min(i, j)}_{max(i, j)}"] for j in range(len(at))] for i in range(len(at))]).reshape(len(at), len(at))
        errors = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0)) if at else np.zeros(0)
        loglik = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else None
        p = k + 1  # the variance counts as a parameter
        aicc = 2 * p - 2 * loglik + 2 * p * (p + 1) / (n - p - 1) if loglik is not None and n > p + 1 else None
        test = (None,) * 4
        parent = PARENTS.get(model, name)
        before = fits[parent][3:] if parent else None
        if before and k > before[1] and n > k and rss > 0:
            f, lr = (before[0] - rss) / (k - before[1]) / (rss / (n - k)), n * math.log(before[0] / rss)
            test = f, f_tail(max(f, 0.0), k - before[1], n - k), lr, chi2_tail(lr, k - before[1])
        out.append((model, n, k, rss, float(1 - rss / gram[0, 0]) if gram[0, 0] > 0 else None, aicc, loglik, *test, list(MODELS[model]), slopes.tolist(), errors.tolist()))
        name = model
    return spark.createDataFrame(out, schema)
