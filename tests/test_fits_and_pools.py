"""Regressions against explicit dummies, tails against integration, and pools against a plain loop."""

import math
import random

import numpy as np
import pytest

from textloom.operators import pool, regressions
from textloom.operators.nearest import judged
from textloom.operators.ordered import rank_within


def integral(f, a, b, n=200_000):
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (b - a) / n / 3)


@pytest.mark.parametrize(("t", "df"), [(0.3, 3), (1.9, 7), (-2.2, 40), (4.0, 11)])
def test_t_tail_is_the_densitys_integral(t, df):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    assert regressions.t_tail(t, df) == pytest.approx(0.5 - integral(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0, t), abs=1e-9)


@pytest.mark.parametrize(("x", "df"), [(0.7, 4), (9.0, 4), (30.0, 20), (3.0, 3)])
def test_chi2_tail_is_the_densitys_integral(x, df):
    c = 1 / (2 ** (df / 2) * math.gamma(df / 2))
    assert regressions.chi2_tail(x, df) == pytest.approx(1 - integral(lambda v: c * v ** (df / 2 - 1) * np.exp(-v / 2), 0, x), abs=1e-6)


def test_f_tail_with_one_degree_is_two_t_tails():
    for t, df in ((0.5, 5), (2.3, 17), (3.1, 400)):
        assert regressions.f_tail(t * t, 1, df) == pytest.approx(2 * regressions.t_tail(t, df), abs=1e-12)
    assert regressions.f_tail(0.0, 2, 9) == 1.0


def test_models_equal_least_squares_with_dummies(spark):
    r = np.random.default_rng(2)
    size = {"a": 0.5, "b": 1.5, "c": 2.5, "e": 4.0}
    rows = [(k, float(x), size[k], float(d), float(2 * size[k] + x - 0.2 * x * x + 0.1 * size[k] * x + 0.3 * d + r.normal() * (1 + x))) for k in size for x in range(1, 6) for d in r.integers(0, 4, 3)]
    got = {g["model"]: g for g in regressions.model_sequence(spark.createDataFrame([*rows, ("a", None, 1.0, 1.0, 1.0), ("a", 1.0, float("nan"), 1.0, 1.0)], "student string, x double, s double, d double, y double")).collect()}
    k, x, s, d, y = (np.array(c) for c in zip(*rows, strict=True))
    made = {"x": x, "x2": x * x, "sx": s * x, "sx2": s * x * x, "d": d, "dx": d * x, "ds": d * s} | {f"c{k}": (x == k).astype(float) for k in range(2, 6)}
    before, known = None, {}
    for model, terms in regressions.MODELS.items():
        a = np.stack([*((k == name).astype(float) for name in sorted(size)), *(made[t] for t in terms)], 1)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        e, inverse = y - a @ beta, np.linalg.inv(a.T @ a)
        w = (e / (1 - np.einsum("ij,jk,ik->i", a, inverse, a))) ** 2
        hc3 = np.sqrt(np.diag(inverse @ (a.T * w) @ a @ inverse))[len(size) :]
        g, rss = got[model], float(e @ e)
        assert g["k"] == a.shape[1] and g["n"] == len(y) and g["rss"] == pytest.approx(rss, rel=1e-6)
        assert np.allclose(g["slopes"], beta[len(size) :], rtol=1e-5, atol=1e-7) and np.allclose(g["hc3"], hc3, rtol=1e-5)
        before = known.get(regressions.PARENTS.get(model), before)
        if before:
            f = (before[0] - rss) / (g["k"] - before[1]) / (rss / (len(y) - g["k"]))
            assert g["f"] == pytest.approx(f, rel=1e-5) and 0 <= g["p"] <= 1 and g["lr"] == pytest.approx(len(y) * math.log(before[0] / rss), rel=1e-5)
        before = known[model] = rss, g["k"]


def test_models_of_no_runs(spark):
    assert regressions.model_sequence(spark.createDataFrame([], "student string, x double, s double, d double, y double")).count() == 0


def test_rank_within_groups_and_nulls(spark):
    rows = [(g, i) for i, g in enumerate("abbacaab")] + [(None, 8), (None, 9)]
    got = {r["i"]: r["rank"] for r in rank_within(spark.createDataFrame(rows, "g string, i int"), "g", by="i").collect()}
    seen, want = {}, {}
    for g, i in rows:
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert got == want


def plain_build(supply, shares, total, cap, rounds=4):
    """The stages as loops over rows; supply holds each category's candidates in order."""
    quotas, accepted, given = pool.largest_remainder(shares, total), [], dict.fromkeys(shares, 0)
    wanted = {c: n for c, n in quotas.items() if n}
    for _ in range(rounds + 1):
        new = []
        for c, n in wanted.items():
            new += supply[c][given[c] : given[c] + n]
            given[c] += n
        new = [r for r in sorted(new) if not r[6] and r[4] not in {a[4] for a in accepted}]
        new = [r for i, r in enumerate(new) if r[4] not in {q[4] for q in new[:i]}]
        old = {b for a in accepted for b in enumerate(a[5])}
        taken = []
        for r in new:
            if not any(b in old or any(b in set(enumerate(q[5])) for q in taken) for b in enumerate(r[5])):
                taken.append(r)
        new = taken
        had = {}
        for a in accepted:
            had[a[3]] = had.get(a[3], 0) + 1
        for r in new:
            if r[3] is None or had.get(r[3], 0) < cap:
                accepted.append(r)
            had[r[3]] = had.get(r[3], 0) + 1
        have = {c: sum(a[1] == c for a in accepted) for c in quotas}
        wanted = {c: math.ceil(1.2 * (q - have[c])) + 1 for c, q in quotas.items() if q > have[c]}
        if not wanted:
            break
    out = []
    for c, q in quotas.items():
        rows, seen = [], {}
        mine = sorted(a for a in accepted if a[1] == c)
        for a in mine:
            seen[a[2]] = seen.get(a[2], 0) + 1
            rows.append((seen[a[2]] / sum(m[2] == a[2] for m in mine), a[2], a[0]))
        out += [((i + 1) / q, c, x[1], x[2]) for i, x in enumerate(sorted(rows)[:q])]
    return [(f"{i:010d}", c, s, o) for i, (_, c, s, o) in enumerate(sorted(out))]


def test_pool_equals_loop(spark):
    r = random.Random(5)
    rows = []
    for i in range(160):
        c = r.choice("ppq")
        rows.append((i, c, r.choice("xyz"), r.choice(["l1", "l2", "l3", "l4", None]), f"k{r.randrange(120)}", [f"b{r.randrange(400)}" for _ in range(3)], r.random() < 0.1))
    supply = {c: [x for x in rows if x[1] == c] for c in "pq"}
    given = dict.fromkeys(supply, 0)

    def request(wanted, number):
        new = []
        for c, n in wanted.items():
            new += supply[c][given[c] : given[c] + n]
            given[c] += n
        return spark.createDataFrame(new, pool.CANDIDATE)

    got = pool.build(spark, request, {"p": 2.0, "q": 1.0}, 50, 14).orderBy("prompt_id").collect()
    want = plain_build(supply, {"p": 2.0, "q": 1.0}, 50, 14)
    assert len(want) > 40 and [tuple(x) for x in got] == want


def test_pool_of_an_empty_backend(spark):
    assert pool.build(spark, lambda wanted, number: spark.createDataFrame([], pool.CANDIDATE), {"p": 1.0}, 5, 2).count() == 0
    assert pool.build(spark, lambda wanted, number: None, {}, 5, 2).count() == 0


def test_judge_sees_hits_alone(spark):
    found = spark.createDataFrame([(1, 7, 0.9, True), (2, 7, 0.95, True), (3, 8, 0.2, False)], "id long, item long, cosine double, hit boolean")
    rows, items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string"), spark.createDataFrame([(7, "a"), (8, "c")], "item long, text string")
    got = {g["id"]: g["hit"] for g in judged(found, rows, items, lambda a, b: a == b).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_json_must_end_with_the_text(spark):
    import duckdb

    from textloom.functions.dialect import DUCK, SPARK
    from textloom.plans.formats import PLANS

    texts = ['{"a": 1}', '{"a": 1} x', '{"a": 1}, "x": 2', '[1, 2]', '[1] [2]', '{"a": 1}, {"b": 2}', "none", '{"a": [1, {"b": "}"}]}', '{"a"', '1} {"v": 2', '[1]] [[2]']
    rows = [(f"k{i}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "event_type string, props string").createOrReplaceTempView("events")
    got = {r["event_type"]: r["n_valid"] for r in spark.sql(PLANS["structured_validity"](SPARK)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_type VARCHAR, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?)", rows)
    con.execute(f"CREATE TABLE o AS {PLANS['structured_validity'](DUCK)}")
    assert got == dict(con.execute("SELECT event_type, n_valid FROM o").fetchall())
    assert [texts[i] for i in range(len(texts)) if got[f"k{i}"]] == ['{"a": 1}', "[1, 2]", '{"a": [1, {"b": "}"}]}']
