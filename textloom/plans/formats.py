"""Plans of answer formats, task gates and configuration rules, and further fits by held-out cells and half samples."""

from __future__ import annotations

from ..functions.answers import json_valid, list_valid, table_valid
from ..functions.dialect import Plan
from .analytics import runs
from .studies import array, half_samples, numbers

PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


@plan
def structured_validity(d):
    """Answers that hold JSON: what stands from the first bracket on must parse to its end. Errors carry a trailing word here."""
    return f"""WITH a AS (SELECT event_type, concat('Result: ', props, CASE WHEN event_type = 'error' THEN ' end' ELSE '' END) AS t FROM events)
    SELECT event_type, count(*) AS n, CAST(count_if({json_valid(d, 't')}) AS BIGINT) AS n_valid FROM a GROUP BY event_type"""


@plan
def table_list_validity(d):
    """Turns that hold a table (two lines of cells, one a rule) or a numbered list."""
    lines = d.lines("text")
    return f"SELECT role, count(*) AS n, CAST(count_if({table_valid(d, lines)}) AS BIGINT) AS n_tables, CAST(count_if({list_valid(d, lines)}) AS BIGINT) AS n_lists FROM conversations GROUP BY role"


@plan
def length_compliance(d):
    """Whether a turn's words lie in its role's range; recorded, and never a reason to drop."""
    n = d.word_count("text")
    return f"""WITH w AS (SELECT role, {n} AS n, CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 1 ELSE 5 END AS low, CASE role WHEN 'system' THEN 60 WHEN 'user' THEN 120 ELSE 200 END AS high FROM conversations)
    SELECT role, count(*) AS n, round(avg(CASE WHEN n BETWEEN low AND high THEN 1e0 ELSE 0e0 END), 6) AS compliant FROM w GROUP BY role"""


@plan
def gated_tasks(d):
    """Tasks a model is given by its size and gate: one needs a billion parameters and the gate, one the size alone."""
    return """WITH m AS (SELECT p_partkey, p_size * 1e8 AS params, p_retailprice > 1200 AS gate FROM part)
    SELECT p_partkey, concat_ws(',', 'core', CASE WHEN params >= 1e9 AND gate THEN 'arithmetic' END, CASE WHEN params >= 1e9 THEN 'trivia' END) AS tasks FROM m"""


@plan
def config_violations(d):
    """Combinations that a configuration may not have, counted by rule: heads that groups or widths don't divide, schedules longer than
    their run or without the decay they need, arms with a teacher or phase that they lack or may not have."""
    shape = {"groups": "heads % groups <> 0", "width": "(64 * width) % heads <> 0", "schedule": "100 * warm + 300 * decay > 1000", "warm-up": "100 * warm > 150 * width"}
    arm = {"decay": "kind = 1 AND decay = 0", "synthetic": "arm = 0 AND (teacher = 0 OR generated = 0)", "control": "arm <> 0 AND teacher = 1", "phase": "arm <> 1 AND second = 0"}
    grid = lambda *names: " CROSS JOIN ".join(f"{numbers(d, low, high, n)} {n}_" for n, low, high in names)
    c = f"c AS (SELECT * FROM {grid(('heads', 1, 8), ('groups', 1, 4), ('width', 1, 6), ('warm', 0, 3), ('decay', 0, 3))})"
    a = f"a AS (SELECT * FROM {grid(('arm', 0, 3), ('teacher', 0, 1), ('generated', 0, 1), ('second', 0, 1), ('kind', 0, 1), ('decay', 0, 1))})"
    return f"WITH {c}, {a} " + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n FROM {table} WHERE {rule}" for table, rules in (("c", shape), ("a", arm)) for name, rule in rules.items())


@plan
def predictive_law(d):
    """Outcome by student, log of teacher size, log of data and their product, fitted without a quarter of the cells (by hash) and tried on them."""
    sums = ", ".join(f"sum({a} * {b}) AS {a}{b}" for a, b in ("pp", "pq", "pr", "qq", "qr", "rr", "py", "qy", "ry"))
    det = "(pp * (qq * rr - qr * qr) - pq * (pq * rr - qr * pr) + pr * (pq * qr - qq * pr))"
    centre = ", ".join(f"x.{v} - m{v} AS {v}" for v in "pqry")
    return f"""WITH {runs(d)}, x AS (SELECT student, substr(md5(concat(student, ':', cond)), 1, 1) < '4' AS held, CAST(substring(cond, 1, 1) AS DOUBLE) AS p, log2(seed + 1e0) AS q, CAST(substring(cond, 1, 1) AS DOUBLE) * log2(seed + 1e0) AS r, a / 1e5 AS y FROM r),
    m AS (SELECT student, avg(p) AS mp, avg(q) AS mq, avg(r) AS mr, avg(y) AS my FROM x WHERE NOT held GROUP BY student), c AS (SELECT held, {centre} FROM x JOIN m ON x.student = m.student),
    s AS (SELECT {sums} FROM c WHERE NOT held), b AS (SELECT (py * (qq * rr - qr * qr) - pq * (qy * rr - qr * ry) + pr * (qy * qr - qq * ry)) / {det} AS bp,
    (pp * (qy * rr - qr * ry) - py * (pq * rr - qr * pr) + pr * (pq * ry - qy * pr)) / {det} AS bq, (pp * (qq * ry - qy * qr) - pq * (pq * ry - qy * pr) + py * (pq * qr - qq * pr)) / {det} AS br FROM s)
    SELECT held, count(*) AS n, round(sqrt(avg(power(y - bp * p - bq * q - br * r, 2))), 5) AS rmse FROM c CROSS JOIN b GROUP BY held"""


@plan
def document_bootstrap(d):
    """Error of a source's loss a token over 1000 half samples of its documents."""
    return f"""WITH t AS (SELECT source, CAST(doc_id AS STRING) AS id, CAST(length(text) AS DOUBLE) AS loss, {d.word_count('text')} AS n FROM documents WHERE text IS NOT NULL),
    {half_samples(d, 't', 'source, loss, n', 'id', 1000)}, g AS (SELECT source, count(*) AS docs, sum(loss) / nullif(sum(n), 0) AS nll FROM t GROUP BY source),
    u AS (SELECT source, i, sum(loss) / nullif(sum(n), 0) AS v FROM halves GROUP BY source, i), e AS (SELECT source, stddev_samp(v) AS se FROM u GROUP BY source)
    SELECT g.source, docs, round(nll, 6) AS nll, round(se, 6) AS se FROM g LEFT JOIN e ON g.source IS NOT DISTINCT FROM e.source"""
