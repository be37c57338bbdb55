"""Plans of experiment analytics: index, cells, gains, contrasts, curve fits, runs over time."""

from __future__ import annotations

from ..functions.dialect import Dialect, Plan
from ..functions.udfs import register_active, t_quantiles

PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


def runs(d: Dialect) -> str:
    """Orders as runs: student is the customer's nation, condition the priority, outcome the price, seed a remainder."""
    return """r AS (SELECT o_orderkey AS run_id, n_name AS student, n_regionkey AS region, o_orderpriority AS cond, o_orderkey % 5 AS seed, o_totalprice AS a FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def cells(d: Dialect) -> str:
    return f"{runs(d)}, cell AS (SELECT student, cond, count(*) AS r, avg(a) AS mean, stddev_samp(a) AS sd FROM r GROUP BY student, cond)"


#: Normal quantiles of the two-sided levels in use, and Student's for few degrees of freedom.
NORMAL = {0.95: 1.959963984540054, 0.90: 1.6448536269514722}
QUANTILES = {level: t_quantiles(level) for level in NORMAL}


def t_quantile(d: Dialect, df: str, level: float = 0.95) -> str:
    """Two-sided quantile of Student's t: exact up to 60 degrees of freedom, then by four terms about the normal one (within 1e-8)."""
    z, listed = NORMAL[level], QUANTILES[level]
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    exact = ", ".join(f"{q:.12e}" for q in listed)
    few = f"element_at(array({exact}), CAST({df} AS INT))" if d.spark else f"[{exact}][{df}]"
    return f"CASE WHEN {df} < 1 THEN 0e0 WHEN {df} <= {len(listed)} THEN {few} ELSE {z:.15e} + " + " + ".join(f"{t:.12e} / power(CAST({df} AS DOUBLE), {k + 1})" for k, t in enumerate(terms)) + " END"


def two_sided(t: str, df: str) -> str:
    """Two-sided p of a t value: made normal by Wallace's transformation, whose tail a polynomial gives; within 1e-4 from 10 degrees of freedom on."""
    z = f"((8 * {df} + 1) / (8 * {df} + 3) * sqrt({df} * ln(1 + {t} * {t} / {df})))"
    k = f"(1 / (1 + 0.3275911e0 * {z} / sqrt(2e0)))"
    return f"({k} * (0.254829592e0 + {k} * (-0.284496736e0 + {k} * (1.421413741e0 + {k} * (-1.453152027e0 + {k} * 1.061405429e0)))) * exp(-{z} * {z} / 2))"


def interval(d: Dialect) -> str:
    half = f"{t_quantile(d, '(r - 1)')} * coalesce(sd, 0) / sqrt(r)"
    return f"round(mean - {half}, 6) AS lo, round(mean + {half}, 6) AS hi"


@plan
def cell_table(d):
    """Runs, mean, deviation (null for one run) and t interval of each cell; the interval of one run is its mean."""
    return f"WITH {cells(d)} SELECT student, cond, r, round(mean, 6) AS mean, round(sd, 6) AS sd, {interval(d)} FROM cell"


@plan
def control_bands(d):
    return f"WITH {cells(d)} SELECT student, cond, r, round(mean, 6) AS mean, round(sd, 6) AS sd, {interval(d)} FROM cell WHERE cond IN ('5-LOW', '4-NOT SPECIFIED')"


@plan
def task_cells(d):
    """For each condition and outcome column mean, deviation and count."""
    columns = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_sd, count({c}) AS {c}_n" for c in ("l_quantity", "l_discount", "l_tax"))
    return f"SELECT o_orderpriority AS cond, {columns} FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"


@plan
def item_error(d):
    """Error by item sampling of a mean of chance-corrected shares, in points: 100 / K times the root of the summed (se / (1 - chance)) squared; chance is a quarter."""
    return """WITH s AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS a, avg(CAST(toxic AS DOUBLE)) AS b, count(*) AS n FROM documents x JOIN labels l ON x.doc_id = l.doc_id GROUP BY source)
    SELECT source, round(100 / 2e0 * sqrt(a * (1 - a) / n / power(1 - 25e-2, 2) + b * (1 - b) / n / power(1 - 25e-2, 2)), 6) AS se_points FROM s"""


@plan
def task_loss(d):
    """Mean loss of a cell with its error: deviation over the root of the count."""
    return f"WITH {runs(d)} SELECT student, cond, round(avg(a), 6) AS loss, round(stddev_samp(a) / sqrt(count(*)), 6) AS se FROM r GROUP BY student, cond"


@plan
def pooled_sd(d):
    return f"WITH {cells(d)} SELECT student, round(sqrt(sum(sd * sd * (r - 1)) / sum(r - 1)), 4) AS pooled_sd FROM cell WHERE r > 1 GROUP BY student"


@plan
def sd_unit_gain(d):
    return f"""WITH {cells(d)}, s AS (SELECT student, sqrt(sum(sd * sd * (r - 1)) / sum(r - 1)) AS sigma FROM cell WHERE r > 1 GROUP BY student)
    SELECT c.student, c.cond, round((c.mean - b.mean) / sigma, 6) AS gain FROM cell c JOIN cell b ON c.student = b.student AND b.cond = '5-LOW' JOIN s ON c.student = s.student WHERE sigma > 0 AND c.cond <> '5-LOW'"""


@plan
def floor_gate(d):
    """Tasks (a run's seed stands for one) that enter the primary set, by the control runs of the smallest student that has any: those
    above chance by five points and by three errors, and the first tier always. Without control runs only the first tier enters."""
    tasks = f"(SELECT {'explode(sequence(0, 4))' if d.spark else 'unnest(range(0, 5))'} AS task)"
    return f"""WITH {runs(d)}, c0 AS (SELECT * FROM r WHERE cond = '5-LOW'), least AS (SELECT min(student) AS student FROM c0), m AS (SELECT seed AS task, avg(CASE WHEN a > 150000 THEN 1e0 ELSE 0e0 END) AS acc, count(*) AS n FROM c0 JOIN least ON c0.student = least.student GROUP BY seed),
    t AS (SELECT CAST(k.task AS BIGINT) AS task, k.task < 2 AS tier_a, n, acc, greatest(0.05, 3 * sqrt(acc * (1 - acc) / n)) AS threshold FROM {tasks} k LEFT JOIN m ON m.task = k.task)
    SELECT task, tier_a, coalesce(n, 0) AS n, round(acc, 6) AS acc, round(threshold, 6) AS threshold, coalesce(acc - 0.25 >= threshold, false) AS passed, tier_a OR coalesce(acc - 0.25 >= threshold, false) AS in_set FROM t"""


@plan
def gains(d):
    return f"""WITH {cells(d)} SELECT c.student, c.cond, round(c.mean - b0.mean, 6) AS g0, round(c.mean - b1.mean, 6) AS g1 FROM cell c LEFT JOIN cell b0 ON c.student = b0.student AND b0.cond = '5-LOW'
    LEFT JOIN cell b1 ON c.student = b1.student AND b1.cond = '4-NOT SPECIFIED' WHERE c.cond NOT IN ('5-LOW', '4-NOT SPECIFIED')"""


@plan
def wide_index(d):
    conds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return f"WITH {runs(d)} SELECT student, seed, {', '.join(f'round(avg(CASE WHEN cond = {c!r} THEN a END), 6) AS c{i}' for i, c in enumerate(conds))} FROM r GROUP BY student, seed"


@plan
def long_index(d):
    metrics = ("o_totalprice", "l_quantity", "l_discount")
    return " UNION ALL ".join(f"SELECT o_orderpriority AS cond, '{m}' AS metric, count({m}) AS n, round(avg({m}), 6) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority" for m in metrics)


@plan
def rollup_counts(d):
    return f"WITH {runs(d)} SELECT region, student, count(*) AS n, round(sum(a), 2) AS total FROM r GROUP BY ROLLUP (region, student)"


@plan
def cube_counts(d):
    return f"WITH {runs(d)} SELECT region, cond, seed, count(*) AS n FROM r GROUP BY CUBE (region, cond, seed)"


@plan
def grouping_sets_counts(d):
    return f"WITH {runs(d)} SELECT region, cond, seed, count(*) AS n, max(a) AS most FROM r GROUP BY GROUPING SETS ((region), (cond), (seed), ())"


@plan
def complete_means(d):
    """Mean over the five conditions of a student and seed; null where a condition is missing. The loss mean skips what is missing."""
    return f"WITH {runs(d)}, c AS (SELECT student, seed, cond, avg(a) AS m FROM r GROUP BY student, seed, cond) SELECT student, seed, round(CASE WHEN count(m) = 5 THEN avg(m) END, 6) AS p_cc, round(avg(m), 6) AS task_loss FROM c GROUP BY student, seed"


def teachers(d: Dialect) -> str:
    """Parts as teachers: size class by p_size, unit cost by price, gain by what the items sold for."""
    return """t AS (SELECT p_size % 7 AS k, power(2.0, p_size % 7) * 1e9 AS t_params, avg(p_retailprice) AS cost, avg(l_extendedprice / l_quantity) AS g FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1, 2)"""


@plan
def gains_ste(d):
    return f"WITH {teachers(d)} SELECT k, round(g, 6) AS g1, round(cost, 6) AS cost, round(g / cost, 6) AS ste FROM t"


@plan
def marginal_efficiency(d):
    return f"WITH {teachers(d)}, n AS (SELECT *, lead(g) OVER (ORDER BY cost, k) AS g2, lead(cost) OVER (ORDER BY cost, k) AS c2 FROM t) SELECT k, round((g2 - g) / (c2 - cost), 6) AS marginal FROM n WHERE c2 IS NOT NULL"


@plan
def t_dollar_curve(d):
    grid = "explode(sequence(0, 20))" if d.spark else "unnest(range(0, 21))"
    return f"""WITH {teachers(d)}, l AS (SELECT {grid} AS i), s AS (SELECT i, k, cost, g - i * 0.1 * cost AS v FROM l CROSS JOIN t), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(v, 6) DESC, round(cost, 6), k) AS rk FROM s)
    SELECT CAST(i AS BIGINT) AS i, k FROM r WHERE rk = 1"""


@plan
def t_epsilon(d):
    return f"WITH {teachers(d)}, m AS (SELECT *, max(g) OVER () AS top, row_number() OVER (ORDER BY cost, k) AS rk FROM t), o AS (SELECT rk, k, round(cost, 6) AS cost FROM m WHERE g >= 0.99 * top) SELECT k, cost FROM o ORDER BY rk LIMIT 1"


@plan
def iso_cost(d):
    grid = "explode(array(1000.0, 3000.0, 10000.0))" if d.spark else "unnest([1000.0, 3000.0, 10000.0])"
    return f"WITH {teachers(d)}, b AS (SELECT CAST(i AS DOUBLE) AS budget FROM (SELECT {grid} AS i) x), v AS (SELECT budget, k, g * ln(1 + budget / cost) AS v FROM b CROSS JOIN t) SELECT budget, k, round(v, 6) AS value, row_number() OVER (PARTITION BY budget ORDER BY round(v, 6) DESC, k) = 1 AS best FROM v"


@plan
def size_matches(d):
    """Suppliers' balances as sizes: pairs of adjacent nations whose mean sizes differ by less than 0.05 in logarithm."""
    return """WITH s AS (SELECT n_nationkey, avg(abs(c_acctbal)) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey)
    SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(abs(ln(a.x / b.x)), 6) AS gap FROM s a JOIN s b ON a.n_nationkey < b.n_nationkey AND abs(ln(a.x / b.x)) < 0.05"""


def welch(d: Dialect, pairs: str) -> str:
    """From pairs (family, student, cond, mean, sd, r, mean0, sd0, r0): difference, error, t and p by Welch's degrees of freedom."""
    v, v0 = "sd * sd / r", "sd0 * sd0 / r0"
    return f"""c AS (SELECT family, student, cond, mean - mean0 AS diff, sqrt({v} + {v0}) AS se, power({v} + {v0}, 2) / (power({v}, 2) / (r - 1) + power({v0}, 2) / (r0 - 1)) AS df FROM ({pairs}) y WHERE r > 1 AND r0 > 1 AND sd + sd0 > 0),
    p AS (SELECT family, student, cond, diff, se, {two_sided('abs(diff / se)', 'df')} AS p FROM c)"""


def paired(family: str, on: str, where: str, cells: str = "cell") -> str:
    return f"SELECT '{family}' AS family, c.student, c.cond, c.mean, c.sd, c.r, b.mean AS mean0, b.sd AS sd0, b.r AS r0 FROM {cells} c JOIN cell b ON c.student = b.student AND {on} WHERE {where}"


def contrasts(d: Dialect) -> str:
    """Each condition against the base within a student."""
    return f"{cells(d)}, {welch(d, paired('base', 'b.cond = ' + repr('5-LOW'), 'c.cond <> ' + repr('5-LOW')))}"


@plan
def contrast_families(d):
    """Families of contrasts within students, each with Holm's correction within the family, and one over all of them.

    Conditions 1 to 3 are rungs of a ladder, 4 and 5 the controls: each rung against the next, against either control,
    the controls against each other, the best rung against the cheapest (economy), and regions' pooled first rung (tier 2).
    In Spark a mean and the best of its student come from one window: every mention of cell is worked out anew there, with
    sums in another order, so that a mean needn't equal itself.
    """
    rung = "CAST(substring({}.cond, 1, 1) AS INT)"
    cheapest, dearer = f"{rung.format('b')} = 3", f"{rung.format('c')} <= 2"
    if d.spark:
        economy = paired("economy", cheapest, "c.mean = c.top", f"(SELECT *, max(mean) OVER (PARTITION BY student) AS top FROM cell c WHERE {dearer})")
    else:
        economy = paired("economy", cheapest, dearer) + " AND c.mean = (SELECT max(t.mean) FROM cell t WHERE t.student = c.student AND CAST(substring(t.cond, 1, 1) AS INT) <= 2)"
    families = [
        paired("adjacent", f"{rung.format('b')} = {rung.format('c')} + 1", f"{rung.format('c')} < 3"),
        paired("against C1", "b.cond = '4-NOT SPECIFIED'", f"{rung.format('c')} <= 3"),
        paired("against C0", "b.cond = '5-LOW'", f"{rung.format('c')} <= 3"),
        paired("C1 against C0", "b.cond = '5-LOW'", "c.cond = '4-NOT SPECIFIED'"),
        f"SELECT * FROM ({economy}) eco",
        "SELECT 'tier 2' AS family, CAST(c.region AS STRING) AS student, c.cond, c.mean, c.sd, c.r, b.mean AS mean0, b.sd AS sd0, b.r AS r0 FROM tier c JOIN tier b ON c.region = b.region AND b.cond = '5-LOW' WHERE c.cond = '1-URGENT'",
    ]
    return f"""WITH {cells(d)}, tier AS (SELECT region, cond, count(*) AS r, avg(a) AS mean, stddev_samp(a) AS sd FROM r GROUP BY region, cond), {welch(d, ' UNION ALL '.join(families))},
    o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, student, cond) AS rk, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (ORDER BY p, family, student, cond) AS all_rk, count(*) OVER () AS all_m FROM p)
    SELECT family, student, cond, round(diff, 4) AS diff, round(p, 6) AS p, round(least(1.0, max((m - rk + 1) * p) OVER (PARTITION BY family ORDER BY rk)), 6) AS p_holm, round(least(1.0, max((all_m - all_rk + 1) * p) OVER (ORDER BY all_rk)), 6) AS p_global FROM o"""


@plan
def contrasts_holm(d):
    return f"""WITH {contrasts(d)}, o AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY p, cond) AS rk, count(*) OVER (PARTITION BY student) AS m FROM p)
    SELECT student, cond, round(diff, 4) AS diff, round(p, 6) AS p, round(least(1.0, max((m - rk + 1) * p) OVER (PARTITION BY student ORDER BY rk)), 6) AS p_holm FROM o"""


@plan
def saturation_test(d):
    """Non-inferiority of the base within a margin: a one-sided 95 % bound of each condition's gain over it, by the pooled variance and t."""
    pooled = "((r - 1) * sd * sd + (r0 - 1) * sd0 * sd0) / (r + r0 - 2)"
    return f"""WITH {cells(d)}, c AS ({paired('base', "b.cond = '5-LOW'", "c.cond <> '5-LOW'")}), u AS (SELECT student, cond, mean - mean0 + {t_quantile(d, '(r + r0 - 2)', 0.90)} * sqrt({pooled} * (1e0 / r + 1e0 / r0)) AS upper FROM c WHERE r > 1 AND r0 > 1)
    SELECT student, cond, round(upper, 4) AS upper, upper < 20000 AS saturated FROM u"""


def curves(d: Dialect) -> str:
    """Per supplier a curve over all its items: cumulative quantity by item order, and a loss that falls with it."""
    if d.spark:  # one window over one sort
        order = "PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey"
        return f"""c0 AS (SELECT l_suppkey, row_number() OVER ({order}) AS i, sum(l_quantity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM lineitem),
    c AS (SELECT l_suppkey AS run, i, d, 2.0 + 40.0 * power(d, -0.1 - 0.05 * (l_suppkey % 8)) AS l FROM c0)"""
    return """c0 AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS i, l_quantity AS q FROM lineitem),
    c AS (SELECT l_suppkey AS run, i, sum(q) OVER (PARTITION BY l_suppkey ORDER BY i) AS d, 2.0 + 40.0 * power(sum(q) OVER (PARTITION BY l_suppkey ORDER BY i), -0.1 - 0.05 * (l_suppkey % 8)) AS l FROM c0)"""


@plan
def log_fit(d):
    return f"WITH {curves(d)} SELECT run, round(regr_slope(l, ln(d)), 6) AS slope, round(regr_intercept(l, ln(d)), 6) AS intercept, round(regr_r2(l, ln(d)), 6) AS r2 FROM c GROUP BY run"


#: Points of a curve that are summed at once.
PART = 4096


def power_law(d: Dialect, points: str) -> str:
    """Least squares of l on d to the minus alpha for each alpha of a grid, and the best alpha with a positive slope.

    In Spark no point is repeated for each alpha: parts of a curve become sums for all alphas, where the window left them.
    """
    if d.spark:
        return register_active(f"""f AS (SELECT run, best_power(sums) AS f FROM (SELECT run, power_sums(d, l) AS sums FROM {points} WHERE d IS NOT NULL AND l IS NOT NULL GROUP BY run, (i - 1) DIV {PART}) x GROUP BY run),
    best AS (SELECT run, f[0] AS alpha, f[1] AS a, f[2] AS e, f[3] AS sse, 1 AS rk FROM f WHERE size(f) > 0)""")
    grid = "unnest(range(0, 237))"
    return f"""al AS (SELECT 0.02 + 0.005 * i AS alpha FROM (SELECT {grid} AS i) x), x AS (SELECT run, CAST(alpha AS DOUBLE) AS alpha, power(d, -CAST(alpha AS DOUBLE)) AS w, l FROM {points} CROSS JOIN al),
    f AS (SELECT run, alpha, regr_slope(l, w) AS a, regr_intercept(l, w) AS e, greatest(regr_syy(l, w) - regr_slope(l, w) * regr_sxy(l, w), 0) AS sse FROM x GROUP BY run, alpha),
    best AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(sse, 9), alpha) AS rk FROM f WHERE a >= 0)"""


@plan
def power_law_fit(d):
    return f"WITH {curves(d)}, {power_law(d, 'c')} SELECT run, round(alpha, 3) AS alpha, round(a, 4) AS a, round(e, 4) AS e FROM best WHERE rk = 1"


@plan
def holdout_forms(d):
    """A power law and a logarithm fitted on the first two thirds of each curve, compared by their error on the rest."""
    return f"""WITH {curves(d)}, n AS (SELECT run, count(*) AS n FROM c GROUP BY run), s AS (SELECT c.*, i <= greatest(3, {d.even('0.67 * n')}) AS fit FROM c JOIN n ON c.run = n.run), tr AS (SELECT run, {'i, ' if d.spark else ''}d, l FROM s WHERE fit),
    {power_law(d, 'tr')}, lg AS (SELECT run, regr_slope(l, ln(d)) AS b, regr_intercept(l, ln(d)) AS k FROM tr GROUP BY run),
    e AS (SELECT s.run, sqrt(avg(power(s.l - best.e - best.a * power(s.d, -best.alpha), 2))) AS power_rmse, sqrt(avg(power(s.l - lg.k - lg.b * ln(s.d), 2))) AS log_rmse FROM s JOIN best ON s.run = best.run AND rk = 1 JOIN lg ON s.run = lg.run WHERE NOT fit GROUP BY s.run)
    SELECT run, round(power_rmse, 4) AS power_rmse, round(log_rmse, 4) AS log_rmse, CASE WHEN round(power_rmse, 5) <= round(log_rmse, 5) THEN 'power' ELSE 'log' END AS form FROM e"""


@plan
def multiplier(d):
    """Data that the first curve needs over what each needs for the same losses: median over five levels."""
    levels = "explode(sequence(1, 5))" if d.spark else "unnest(range(1, 6))"
    if d.spark:  # fitted once: a condition that Spark takes for random, though it always holds, keeps it from working b out for each mention
        once, base = " AND rand() >= 0", "SELECT x.alpha AS alpha0, x.a AS a0, x.e AS e0 FROM (SELECT min_by(struct(alpha, a, e), run) AS x FROM b) y WHERE x IS NOT NULL"
    else:
        once, base = "", "SELECT alpha AS alpha0, a AS a0, e AS e0 FROM b WHERE run = (SELECT min(run) FROM b)"
    return f"""WITH {curves(d)}, {power_law(d, 'c')}, b AS (SELECT run, alpha, a, e FROM best WHERE rk = 1 AND a > 0{once}), base AS ({base}),
    v AS (SELECT b.*, base.*, greatest(e, e0) + 0.02 + (least(e + a, e0 + a0) - greatest(e, e0) - 0.02) * lv / 6.0 AS level FROM b CROSS JOIN base CROSS JOIN (SELECT {levels} AS lv) x WHERE least(e + a, e0 + a0) > greatest(e, e0) + 0.02),
    m AS (SELECT run, power(a0 / (level - e0), 1 / alpha0) / power(a / (level - e), 1 / alpha) AS r FROM v WHERE level > e AND level > e0) SELECT run, round({d.median('r')}, 4) AS median_ratio, count(*) AS levels FROM m GROUP BY run"""


@plan
def teacher_dependence(d):
    return f"WITH {curves(d)}, {power_law(d, 'c')} SELECT run % 5 AS student, count(*) AS n, round(regr_slope(alpha, log2(1 + run % 8)), 5) AS slope, round(regr_r2(alpha, log2(1 + run % 8)), 5) AS r2 FROM best WHERE rk = 1 GROUP BY run % 5 HAVING count(*) >= 3"


@plan
def frontier(d):
    grid = "explode(sequence(1, 8))" if d.spark else "unnest(range(1, 9))"
    return f"""WITH {curves(d)}, {power_law(d, 'c')}, b AS (SELECT run, alpha, a, e FROM best WHERE rk = 1), g AS (SELECT power(CAST(10 AS DOUBLE), i) AS budget FROM (SELECT {grid} AS i) x), v AS (SELECT budget, run, e + a * power(budget / (2.0 * (1 + run % 8) + 6.0), -alpha) AS loss FROM g CROSS JOIN b),
    r AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY round(loss, 6), run) AS rk FROM v) SELECT budget, run, round(loss, 4) AS loss FROM r WHERE rk = 1"""


@plan
def dose_response(d):
    return f"WITH {curves(d)}, m AS (SELECT run % 5 AS cell, ln(d) - avg(ln(d)) OVER (PARTITION BY run) AS x, l - avg(l) OVER (PARTITION BY run) AS y FROM c) SELECT cell, round(sum(x * y) / sum(x * x), 6) AS shared_slope, count(*) AS n FROM m GROUP BY cell"


@plan
def quadratic_fit(d):
    """Quadratic of gain on log size by normal equations of centred sums, with its vertex and the vertex's error by the delta method."""
    return f"""WITH {teachers(d)}, x AS (SELECT CAST(k AS DOUBLE) - avg(k) OVER () AS u, CAST(k AS DOUBLE) * k - avg(CAST(k AS DOUBLE) * k) OVER () AS v, g - avg(g) OVER () AS y FROM t),
    s AS (SELECT count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * y) AS uy, sum(v * y) AS vy, sum(y * y) AS yy FROM x),
    b AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS b1, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b2, uu * vv - uv * uv AS det FROM s),
    e AS (SELECT *, (yy - b1 * uy - b2 * vy) / (n - 3) AS s2 FROM b)
    SELECT round(b1, 4) AS b1, round(b2, 4) AS b2, round(-b1 / (2 * b2), 4) AS vertex, round(sqrt(greatest(s2 * (vv / (4 * b2 * b2) + uv * b1 / (2 * b2 * b2 * b2) + uu * b1 * b1 / (4 * power(b2, 4))) / det, 0)), 3) AS vertex_se, b2 < 0 AS peak FROM e"""


@plan
def cell_fits(d):
    """Power laws of single curves summarised by cell: mean, deviation and half-width 1.96 sd / sqrt(n) of exponent and floor; the cell's form is its first curve's."""
    return f"""WITH {curves(d)}, {power_law(d, 'c')}, lg AS (SELECT run, regr_r2(l, ln(d)) AS r2 FROM c GROUP BY run), b AS (SELECT best.run, best.run % 5 AS cell, alpha, a, e, CASE WHEN sse <= 1e-6 OR lg.r2 < 0.99 THEN 'power' ELSE 'log' END AS form FROM best JOIN lg ON best.run = lg.run WHERE rk = 1)
    SELECT cell, count(*) AS n, round(avg(alpha), 5) AS alpha, round(stddev_samp(alpha), 5) AS alpha_sd, round(1.96 * stddev_samp(alpha) / sqrt(count(*)), 5) AS alpha_half, round(avg(e), 3) AS floor, round(stddev_samp(e), 3) AS floor_sd, min_by(form, run) AS form FROM b GROUP BY cell"""


@plan
def pure_power_fit(d):
    """A power law without a floor: for each exponent of a grid the scale <l, w> / <w, w>, and the exponent of least error."""
    grid = "explode(sequence(0, 236))" if d.spark else "unnest(range(0, 237))"
    return f"""WITH {curves(d)}, al AS (SELECT CAST(0.02 + 0.005 * i AS DOUBLE) AS alpha FROM (SELECT {grid} AS i) x), f AS (SELECT run, alpha, sum(l * power(d, -alpha)) / sum(power(d, -2 * alpha)) AS a, sum(l * l) - power(sum(l * power(d, -alpha)), 2) / sum(power(d, -2 * alpha)) AS sse FROM c CROSS JOIN al GROUP BY run, alpha),
    r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(sse, 6), alpha) AS rk FROM f) SELECT run, round(alpha, 3) AS alpha, round(a, 3) AS a FROM r WHERE rk = 1"""


@plan
def isotonic(d):
    """Non-decreasing fit of each student's condition means, weighted by runs: at a cell the largest, over starts up to it, of the
    least weighted mean, over ends from it on. A handful of cells a student, whatever the number of runs."""
    return f"""WITH {cells(d)}, o AS (SELECT student, cond, mean, r, row_number() OVER (PARTITION BY student ORDER BY cond) AS i FROM cell),
    b AS (SELECT x.student, x.i AS lo, y.i AS hi, sum(z.mean * z.r) / sum(z.r) AS av FROM o x JOIN o y ON x.student = y.student AND x.i <= y.i JOIN o z ON z.student = x.student AND z.i BETWEEN x.i AND y.i GROUP BY 1, 2, 3),
    m AS (SELECT o.student, o.cond, b.lo, min(b.av) AS v FROM o JOIN b ON b.student = o.student AND b.lo <= o.i AND b.hi >= o.i GROUP BY 1, 2, 3)
    SELECT student, cond, round(max(v), 4) AS fitted FROM m GROUP BY 1, 2"""


def isotonic_gains(d: Dialect, draws: str, n: int) -> str:
    """From draws (student, mean, w, i, k): the gain of an isotonic fit in the order of k over a constant, for each i; draw 0 is the
    data. Then each student's own gain and the share of draws, itself included, that gain as much.

    Draws are rows of sums over a handful of cells, so nothing grows with the runs.
    """
    return f"""WITH {cells(d)}, q AS ({draws}), c AS (SELECT *, sum(w * mean) OVER (PARTITION BY student, i ORDER BY k) AS cs, sum(w) OVER (PARTITION BY student, i ORDER BY k) AS cw FROM q),
    iv AS (SELECT x.student, x.i, x.k AS lo, y.k AS hi, (y.cs - x.cs + x.w * x.mean) / (y.cw - x.cw + x.w) AS av FROM c x JOIN c y ON x.student = y.student AND x.i = y.i AND x.k <= y.k),
    low AS (SELECT c.student, c.i, c.k, iv.lo, max(c.w) AS w, min(iv.av) AS v FROM c JOIN iv ON iv.student = c.student AND iv.i = c.i AND iv.lo <= c.k AND iv.hi >= c.k GROUP BY 1, 2, 3, 4),
    fit AS (SELECT student, i, k, max(w) AS w, max(v) AS f FROM low GROUP BY 1, 2, 3), tot AS (SELECT student, i, sum(mean * w) / sum(w) AS grand, sum(w * mean * mean) AS scale FROM q GROUP BY student, i),
    g AS (SELECT fit.student, fit.i, sum(w * power(f - grand, 2)) AS gain, max(scale) AS scale FROM fit JOIN tot ON fit.student = tot.student AND fit.i = tot.i GROUP BY 1, 2), own AS (SELECT student, gain, scale FROM g WHERE i = 0)
    SELECT g.student, round(max(own.gain), 0) AS gain, round((count_if(g.i > 0 AND g.gain >= own.gain - 1e-9 * own.scale) + 1) / {n + 1}e0, 6) AS p FROM g JOIN own ON g.student = own.student GROUP BY g.student"""


def upto(d: Dialect, n: int) -> str:
    return f"(SELECT {f'explode(sequence(0, {n}))' if d.spark else f'unnest(range(0, {n + 1}))'} AS i) n"


@plan
def isotonic_permutation(d, permutations: int = 2000):
    """How often cells in an order by hash gain as much by an isotonic fit, of 2000 orders."""
    order = "CASE WHEN i = 0 THEN cond ELSE md5(concat_ws('|', student, cond, CAST(i AS STRING))) END"
    return isotonic_gains(d, f"SELECT student, mean, CAST(r AS DOUBLE) AS w, i, row_number() OVER (PARTITION BY student, i ORDER BY {order}) AS k FROM cell CROSS JOIN {upto(d, permutations)}", permutations)


@plan
def isotonic_parametric(d, boots: int = 2000):
    """The same for cells drawn about the student's mean with their own errors: normal draws by Box and Muller from hashes."""
    u = lambda tag: f"(({d.hash32('student', repr('|'), 'cond', repr('|' + tag), 'CAST(i AS STRING)')} + 1) / 4294967297e0)"
    z = f"sqrt(-2 * ln({u('u')})) * cos(2 * pi() * {u('v')})"
    grand = "sum(mean * r) OVER (PARTITION BY student, i) / sum(r) OVER (PARTITION BY student, i)"
    draws = f"SELECT student, CASE WHEN i = 0 THEN mean ELSE {grand} + coalesce(sd, 0) / sqrt(r) * {z} END AS mean, CAST(r AS DOUBLE) AS w, i, row_number() OVER (PARTITION BY student, i ORDER BY cond) AS k FROM cell CROSS JOIN {upto(d, boots)}"
    return isotonic_gains(d, draws, boots)


@plan
def spearman(d):
    return """WITH k AS (SELECT c_nationkey, avg(c_acctbal) AS x, count(*) AS y FROM customer GROUP BY c_nationkey), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM k)
    SELECT round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS rho, count(*) AS n FROM r"""


@plan
def hedges_g(d):
    return f"""WITH {cells(d)}, p AS (SELECT c.student, c.cond, c.mean - b.mean AS diff, c.r + b.r - 2 AS df, sqrt((c.sd * c.sd * (c.r - 1) + b.sd * b.sd * (b.r - 1)) / (c.r + b.r - 2)) AS s FROM cell c JOIN cell b ON c.student = b.student AND b.cond = '5-LOW' WHERE c.cond <> '5-LOW' AND c.r > 1 AND b.r > 1)
    SELECT student, cond, round(diff / s * (1 - 3.0 / (4 * df - 1)), 6) AS g FROM p"""


@plan
def brown_forsythe(d):
    return f"""WITH {runs(d)}, md AS (SELECT cond, {d.median('a')} AS med FROM r GROUP BY cond), z AS (SELECT r.cond, abs(a - med) AS z FROM r JOIN md ON r.cond = md.cond),
    gz AS (SELECT cond, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY cond), al AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS total, count(*) AS k, sum(v * (n - 1)) AS ssw FROM gz)
    SELECT round(sum(n * power(m - grand, 2)) / max(k - 1) / (max(ssw) / max(total - k)), 6) AS f FROM gz CROSS JOIN al"""


@plan
def divergence_runs(d):
    """Streaks in which an event's value stays above twice the user's running minimum."""
    return """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM events),
    f AS (SELECT *, value > 2 * low AS bad, i - row_number() OVER (PARTITION BY user_id, value > 2 * low ORDER BY i) AS island FROM e), s AS (SELECT user_id, island, count(*) AS n FROM f WHERE bad GROUP BY user_id, island)
    SELECT user_id, max(n) AS longest, max(n) > 50 AS diverged FROM s GROUP BY user_id"""


@plan
def running_min(d):
    return "SELECT event_id, user_id, round(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS low FROM events"


@plan
def stale_claims(d):
    return f"WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT user_id, count(*) AS n_stale FROM e WHERE nxt IS NOT NULL AND {d.seconds('ts', 'nxt')} > 3600 GROUP BY user_id"


@plan
def runnable_jobs(d):
    """Events as jobs that need the two before them in their user's list; done are purchases. Runnable: not done, all needs done."""
    return """WITH j AS (SELECT user_id, event_id, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    n AS (SELECT user_id, i + 1 AS i, done FROM j UNION ALL SELECT user_id, i + 2 AS i, done FROM j)
    SELECT j.event_id FROM j WHERE NOT done AND NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = j.user_id AND n.i = j.i AND NOT n.done)"""


@plan
def queue_summary(d):
    return "SELECT event_type AS state, count(*) AS n, count(DISTINCT user_id) AS workers FROM events GROUP BY event_type"


@plan
def budget_rollup(d):
    return "SELECT l_returnflag AS stage, l_linestatus AS line, round(sum(l_extendedprice), 2) AS cost, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@plan
def paraphrase_divergence(d):
    return f"WITH {cells(d)} SELECT student, round(100 * (max(mean) - min(mean)) / max(mean), 6) AS spread FROM cell GROUP BY student HAVING 100 * (max(mean) - min(mean)) / max(mean) > 2 AND count(mean) >= 2"


@plan
def top_students(d):
    return f"WITH {runs(d)}, x AS (SELECT region, student, round(max(a), 2) AS best FROM r GROUP BY region, student), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY best DESC, student) AS rk FROM x) SELECT region, student, best FROM k WHERE rk <= 2"


@plan
def set_overlap(d):
    """Jaccard overlap of the customers that two years' orders retain."""
    return """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '2-HIGH'),
    i AS (SELECT k FROM a INTERSECT SELECT k FROM b), u AS (SELECT k FROM a UNION SELECT k FROM b), m AS (SELECT k FROM a EXCEPT SELECT k FROM b)
    SELECT (SELECT count(*) FROM i) AS both_, (SELECT count(*) FROM u) AS any_, (SELECT count(*) FROM m) AS only_a, round(CAST((SELECT count(*) FROM i) AS DOUBLE) / (SELECT count(*) FROM u), 6) AS jaccard"""


@plan
def learning_rates(d):
    """Warm-up, stable and decay phases, and a cosine, over a thousand steps."""
    grid = "explode(sequence(0, 999))" if d.spark else "unnest(range(0, 1000))"
    return f"""WITH s AS (SELECT CAST(i AS BIGINT) AS step FROM (SELECT {grid} AS i) x) SELECT step, round(CASE WHEN step < 50 THEN 1e-3 * (step + 1) / 50 WHEN step < 800 THEN 1e-3 ELSE 1e-3 * (1000 - step) / 200 END, 9) AS wsd,
    round(CASE WHEN step < 50 THEN 1e-3 * (step + 1) / 50 ELSE 1e-4 + 5e-1 * 9e-4 * (1 + cos(pi() * (step - 50) / 95e1)) END, 9) AS cosine FROM s"""
