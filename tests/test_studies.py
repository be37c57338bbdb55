"""Study plans against what is known beforehand: curves whose law is given, lines without noise, contrasts worked out in numpy."""

import math
import os
import random

import numpy as np
import pytest

from textloom.functions.dialect import SPARK
from textloom.operators.regressions import t_tail
from textloom.plans import analytics, curation, studies


@pytest.fixture
def runs(spark):
    """Registers runs (student, condition, outcome) as the tables that the plans read."""

    def make(rows):
        names = sorted({r[0] for r in rows})
        spark.createDataFrame([(i, names.index(s), c, float(a)) for i, (s, c, a) in enumerate(rows)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").createOrReplaceTempView("orders")
        spark.createDataFrame([(i, i) for i in range(len(names))], "c_custkey long, c_nationkey long").createOrReplaceTempView("customer")
        spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(names)], "n_nationkey long, n_regionkey long, n_name string").createOrReplaceTempView("nation")

    return make


CONDITIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def noisy(seed=5, n=7):
    r = np.random.default_rng(seed)
    return [(s, c, round(float(100 + 7 * k + 3 * j + r.normal() * (2 + j)), 3)) for j, s in enumerate("abc") for k, c in enumerate(CONDITIONS) for _ in range(n)]


def test_power_laws_give_back_their_exponents(spark):
    rows = [(s, i, 1, 1, float(1 + i % 50)) for s in range(8) for i in range(200)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").createOrReplaceTempView("lineitem")
    for name in ("power_law_fit", "profile_fit"):
        got = {x.run: (x.alpha, x.e) for x in spark.sql(analytics.PLANS.get(name, studies.PLANS.get(name))(SPARK)).collect()}
        assert len(got) == 8 and all(abs(a - (0.1 + 0.05 * (s % 8))) < 1e-6 and abs(e - 2) < 0.01 for s, (a, e) in got.items())
    cells = {x.cell: x for x in spark.sql(analytics.PLANS["cell_fits"](SPARK)).collect()}
    assert cells[0].n == 2 and cells[0].alpha == pytest.approx((0.1 + 0.35) / 2) and cells[0].alpha_sd == pytest.approx(0.25 / math.sqrt(2), abs=1e-5) and cells[0].form == "power"


def test_curves_are_fitted_once_in_parts_and_not_once_an_exponent(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(s, i, 1, 1, float(r.integers(1, 50))) for s in range(5) for i in range(30)] + [(5, 0, 1, 1, 3.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").createOrReplaceTempView("lineitem")
    monkeypatch.setattr(analytics, "PART", 7)
    d = np.cumsum([x[-1] for x in rows if x[0] == 3])
    y = 2 + 40 * d**-0.25 + np.cos(np.arange(30))
    spark.createDataFrame([(3, i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(d, y, strict=True))], "run long, i int, d double, l double").createOrReplaceTempView("noisy")
    got = spark.sql(f"WITH {analytics.power_law(SPARK, 'noisy')} SELECT * FROM best").first()
    fits = {k: np.polyfit(d**-k, y, 1, full=True)[:2] for k in np.round(0.02 + 0.005 * np.arange(237), 3)}
    k = min((k for k in fits if fits[k][0][0] >= 0), key=lambda k: (round(fits[k][1][0], 9), k))
    assert got.alpha == k and np.allclose((got.a, got.e, got.sse), (*fits[k][0], fits[k][1][0]), rtol=1e-7)
    df = spark.sql(analytics.PLANS["multiplier"](SPARK))
    assert {x.run: x.levels for x in df.collect()} == dict.fromkeys(range(5), 5)  # one point has no slope
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "explode(sequence(0, 236" not in analytics.PLANS["multiplier"](SPARK) and plan.count("Generate ") == 1  # the levels
    assert plan.count("Window ") == 1


def test_lines_without_noise_hold_for_groups_left_out(spark, runs):
    runs([(s, c, 50.0 + 4 * (k + 1)) for s in "abcd" for k, c in enumerate(CONDITIONS) for _ in range(2)])
    got = spark.sql(studies.PLANS["leave_group_out"](SPARK)).first()
    assert (got.n, got.r2) == (20, 1.0)
    runs([(s, c, float(k)) for s in "ab" for k, c in enumerate(CONDITIONS)])
    assert spark.sql(studies.PLANS["leave_group_out"](SPARK)).first().n == 0  # fewer than three groups


def holm(ps):
    out, most = {}, 0.0
    for i, (key, p) in enumerate(sorted(ps.items(), key=lambda x: (x[1], x[0]))):
        most = max(most, min(1.0, (len(ps) - i) * p))
        out[key] = most
    return out


def test_families_of_contrasts(spark, runs):
    rows = noisy()
    runs(rows)
    got = {(x.family, x.student, x.cond): x for x in spark.sql(analytics.PLANS["contrast_families"](SPARK)).collect()}
    cell = {(s, c): np.array([a for t, d, a in rows if (t, d) == (s, c)]) for s in "abc" for c in CONDITIONS}
    tier = {(g, c): np.concatenate([cell[s, c] for s in members]) for g, members in (("0", "ac"), ("1", "b")) for c in CONDITIONS}

    def welch(a, b):
        va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
        return a.mean() - b.mean(), 2 * t_tail(abs(a.mean() - b.mean()) / math.sqrt(va + vb), df)

    want = {}
    for s in "abc":
        rungs = [cell[s, c] for c in CONDITIONS[:3]]
        for k in (0, 1):
            want["adjacent", s, CONDITIONS[k]] = welch(rungs[k], rungs[k + 1])
        for k in range(3):
            want["against C1", s, CONDITIONS[k]] = welch(rungs[k], cell[s, CONDITIONS[3]])
            want["against C0", s, CONDITIONS[k]] = welch(rungs[k], cell[s, CONDITIONS[4]])
        want["C1 against C0", s, CONDITIONS[3]] = welch(cell[s, CONDITIONS[3]], cell[s, CONDITIONS[4]])
        best = max((0, 1), key=lambda k: rungs[k].mean())
        want["economy", s, CONDITIONS[best]] = welch(rungs[best], rungs[2])
    for g in "01":
        want["tier 2", g, CONDITIONS[0]] = welch(tier[g, CONDITIONS[0]], tier[g, CONDITIONS[4]])
    assert got.keys() == want.keys()
    for family in {k[0] for k in want}:
        corrected = holm({k: got[k].p for k in want if k[0] == family})
        assert all(abs(got[k].p_holm - p) < 2e-5 for k, p in corrected.items())
    everywhere = holm({k: got[k].p for k in want})
    for k, (diff, p) in want.items():
        assert abs(got[k].diff - diff) < 1e-3 and abs(got[k].p - p) < 2e-3 and abs(got[k].p_global - everywhere[k]) < 3e-5, k


def test_the_best_rung_is_there_whatever_the_order_of_its_sum(spark, runs):
    runs(noisy())
    # Sums in another order differ in their last bits; here outcomes do, each time that they are read.
    spark.udf.register("unsteady", lambda a: a + int.from_bytes(os.urandom(4), "big") * 1e-18, "double")
    spark.table("orders").createOrReplaceTempView("steady")
    spark.sql("SELECT o_orderkey, o_custkey, o_orderpriority, unsteady(o_totalprice * 1e-6) AS o_totalprice FROM steady").createOrReplaceTempView("orders")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = [x for x in spark.sql(analytics.PLANS["contrast_families"](SPARK)).collect() if x.family == "economy"]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted((x.student, x.cond) for x in got) == [(s, CONDITIONS[1]) for s in "abc"]


def test_bounds_and_intervals(spark, runs):
    rows = [*noisy(9, 4), ("d", "1-URGENT", 5.0)]
    runs(rows)
    quantile = lambda df, tail: next(x for x in np.arange(0.5, 20, 1e-4) if t_tail(x, df) <= tail)
    got = {(x.student, x.cond): x for x in spark.sql(analytics.PLANS["cell_table"](SPARK)).collect()}
    a = np.array([v for s, c, v in rows if (s, c) == ("a", "2-HIGH")])
    half = quantile(3, 0.025) * a.std(ddof=1) / 2
    assert abs(got["a", "2-HIGH"].lo - (a.mean() - half)) < 1e-2 and (got["d", "1-URGENT"].lo, got["d", "1-URGENT"].sd) == (5.0, None)
    b = np.array([v for s, c, v in rows if (s, c) == ("a", "5-LOW")])
    upper = a.mean() - b.mean() + quantile(6, 0.05) * math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2 * (1 / 4 + 1 / 4))
    bound = {(x.student, x.cond): x.upper for x in spark.sql(analytics.PLANS["saturation_test"](SPARK)).collect()}
    assert abs(bound["a", "2-HIGH"] - upper) < 1e-2


def test_mediation_equals_least_squares(spark, runs):
    r = random.Random(3)
    rows = [(s, c, 10.0 * k + r.random()) for s in "abcd" for k, c in enumerate(CONDITIONS) for _ in range(r.randrange(1, 6))]
    runs(rows)
    cells = {}
    for s, c, a in rows:
        cells.setdefault((s, c), []).append(a)
    keys = sorted(cells)
    y, x, z = np.array([np.mean(cells[k]) for k in keys]), np.array([float(k[1][0]) for k in keys]), np.array([float(len(cells[k])) for k in keys])
    dummies = np.array([[k[0] == s for s in "abcd"] for k in keys], float)

    def fit(out, *columns):
        a = np.column_stack([dummies, *columns])
        beta, *_ = np.linalg.lstsq(a, out, rcond=None)
        e, df = out - a @ beta, len(out) - a.shape[1]
        return [(b, 2 * t_tail(abs(b / math.sqrt(v)), df)) for b, v in zip(beta[4:], np.diag(np.linalg.inv(a.T @ a))[4:] * (e @ e) / df, strict=True)]

    got = spark.sql(studies.PLANS["mediation"](SPARK)).first()
    (total,), (path,), (direct, mediator) = fit(y, x), fit(z, x), fit(y, x, z)
    for name, (value, p) in (("total", total), ("path", path), ("direct", direct), ("mediator", mediator)):
        assert abs(getattr(got, name) - value) < 1e-3 and abs(getattr(got, f"p_{name}") - p) < 2e-3


def test_quadratics_give_back_their_vertex(spark):
    rows = [(p, k, 10.0, float(10 * (50 - 2 * (k - 3.5) ** 2))) for p, k in enumerate(range(7))]
    spark.createDataFrame([(p, q, e) for p, _, q, e in rows], "l_partkey long, l_quantity double, l_extendedprice double").createOrReplaceTempView("lineitem")
    spark.createDataFrame([(p, k, 1.0) for p, k, _, _ in rows], "p_partkey long, p_size int, p_retailprice double").createOrReplaceTempView("part")
    got = spark.sql(analytics.PLANS["quadratic_fit"](SPARK)).first()
    assert (got.b2, got.vertex, got.vertex_se, got.peak) == (-2.0, 3.5, 0.0, True)


def test_length_match_takes_a_share_of_the_poorest_source(spark):
    """By hand: one bin, sources with 10, 20 and 15 documents of 20 words; 0.8 of 10 each, or what the budget of 60,000 words allows."""
    docs = [(i, " ".join(["w"] * 20), "en", s) for i, s in enumerate("a" * 10 + "b" * 20 + "c" * 15)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").createOrReplaceTempView("documents")
    got = spark.sql(curation.PLANS["length_matched_subsample"](SPARK)).groupBy("source").count().collect()
    assert {x.source: x["count"] for x in got} == {"a": 8, "b": 8, "c": 8}
    docs = [(i, " ".join(["w"] * 1000), "en", s) for i, s in enumerate("a" * 100 + "b" * 120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").createOrReplaceTempView("documents")
    got = spark.sql(curation.PLANS["length_matched_subsample"](SPARK)).groupBy("source").count().collect()
    assert {x.source: x["count"] for x in got} == {"a": 60, "b": 60}


def test_prompts_keep_their_rules(spark):
    import ast
    import re

    from textloom.plans import prompts

    problems = spark.sql(prompts.PLANS["word_problems"](SPARK)).collect()
    assert {x.family for x in problems} == {f[0] for f in prompts.FAMILIES} and all(x.checked and not x.tenth_off_passes for x in problems)
    for x in problems[:90]:  # the text holds the numbers that the answer follows from
        name, text, gold, _ = next(f for f in prompts.FAMILIES if f[0] == x.family)
        numbers = re.fullmatch(re.sub(r"\\\{([abc])\\\}", r"(?P<\1>[0-9]+)", re.escape(text)), x.problem).groupdict()
        tree = ast.parse(gold, mode="eval")
        assert eval(compile(tree, "gold", "eval"), {k: int(v) for k, v in numbers.items()}) == x.gold
    spark.createDataFrame([(i, f"N{i}", i % 5) for i in range(25)], "n_nationkey long, n_name string, n_regionkey long").createOrReplaceTempView("nation")
    made = spark.sql(prompts.PLANS["category_prompts"](SPARK)).collect()
    assert len(made) == 7 * 4 * 25 and len({x.prompt_id for x in made}) == len(made) and all(x.leaf in x.prompt and "{" not in x.prompt for x in made)
    for c in prompts.TEMPLATES:  # every pass holds every leaf once
        own = sorted((x.prompt_id, x.leaf) for x in made if x.category == c)
        assert all(len({leaf for _, leaf in own[k : k + 25]}) == 25 for k in range(0, 100, 25))
    asked = [x for x in made if x.mcq]
    assert {x.category for x in asked} == set(prompts.CHOICE) and 0.15 < len(asked) / 200 < 0.45
    for x in asked:
        options = x.options.split(" / ")
        assert x.gold == x.leaf and len(set(options)) == 4 and x.gold in options and all(int(o[1:]) % 5 != int(x.gold[1:]) % 5 for o in options if o != x.gold)
    spark.createDataFrame([(i, 1, "user", f"text {i}") for i in range(400)], "conv_id long, turn long, role string, text string").createOrReplaceTempView("conversations")
    drawn = spark.sql(prompts.PLANS["constrained_prompts"](SPARK)).collect()
    assert len(drawn) == 400 and {x.n_constraints for x in drawn} == {1, 2} and 0.4 < sum(x.audience == "general" for x in drawn) / 400 < 0.6


def test_the_simulated_surface_is_found_again(spark):
    from textloom.operators.regressions import model_sequence

    spark.createDataFrame([(i, f"N{i:02d}") for i in range(25)], "n_nationkey long, n_name string").createOrReplaceTempView("nation")
    runs = spark.sql(studies.PLANS["simulated_index"](SPARK))
    assert runs.count() == 25 * 5 * 4 * 3
    got = {x.model: x for x in model_sequence(runs.select("student", "x", "s", "d", "y")).collect()}["M4"]
    slopes = dict(zip(got.terms, got.slopes, strict=True))
    for term, known in {"x": 1.5, "x2": -0.2, "sx": 0.1, "sx2": 0.0, "d": 0.3, "dx": 0.0, "ds": 0.0}.items():
        assert abs(slopes[term] - known) < 0.02, term
    assert math.sqrt(got.rss / got.n) == pytest.approx(studies.NOISE, rel=0.1)
