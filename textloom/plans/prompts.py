"""Plans that make prompts: templates by category, word problems with their answers, passages, constraints, audiences.

Every choice follows from a hash of what is chosen for, so any task makes the same prompts, and each row stands alone.
"""

from __future__ import annotations

from ..functions.dialect import Dialect, Plan
from .studies import array, hashed, numbers

PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


#: Templates of each category; {leaf} is a topic.
TEMPLATES = {
    "saqa": ("Which fact about {leaf} do most people get wrong?", "Name the single most important thing about {leaf}.", "In one line, what sets {leaf} apart?"),
    "exp": ("Explain {leaf} to somebody who has never heard of it.", "Walk through how {leaf} came to be what it is.", "Why does {leaf} matter? Give reasons."),
    "sci": ("Describe an experiment that would teach us something about {leaf}.", "Which measurements tell us most about {leaf}?", "State a hypothesis about {leaf} and how to test it."),
    "str": ("List facts about {leaf} as a numbered list.", "Make a table with three properties of {leaf}.", "Give a JSON object that describes {leaf}."),
    "if": ("Write about {leaf} and keep to the rules below.", "Summarise {leaf} under the following conditions.", "Answer a question on {leaf}, obeying every rule."),
    "cre": ("Tell a short story that takes place in {leaf}.", "Write a poem in which {leaf} appears.", "Invent a dialogue between two travellers to {leaf}."),
    "dia": ("Advise a friend who asks you about {leaf}.", "Reply to a letter with questions about {leaf}.", "Help me decide whether to study {leaf}."),
}
#: Categories in which some prompts are multiple choice, and their share in tenths.
CHOICE, CHOICE_TENTHS = ("saqa", "sci"), 3
PASSES = 4


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@plan
def category_prompts(d):
    """Prompts of seven categories: leaves in passes, each pass in an order of its own, and templates in turn; three tenths of
    some categories are multiple choice, with three distractors from other domains."""
    cases = " ".join(f"WHEN m.category = '{c}' AND m.pos % {len(t)} = {k} THEN {literal(x)}" for c, t in TEMPLATES.items() for k, x in enumerate(t))
    listed = ", ".join(f"'{c}'" for c in TEMPLATES)
    categories = f"(SELECT {d.rows(array(d, *(literal(c) for c in TEMPLATES)))} AS category)"
    eligible = ", ".join(f"'{c}'" for c in CHOICE)
    joined = "array_join(transform(array_sort(collect_list(struct(k, o))), x -> x.o), ' / ')" if d.spark else "string_agg(o, ' / ' ORDER BY k, o)"
    return f"""WITH leaf AS (SELECT n_name AS leaf, n_regionkey AS domain FROM nation), q AS (SELECT category, leaf, domain, i, row_number() OVER (PARTITION BY category, i ORDER BY md5(concat_ws('|', category, CAST(i AS STRING), leaf))) AS rk, count(*) OVER (PARTITION BY category, i) AS n FROM leaf CROSS JOIN {categories} c CROSS JOIN {numbers(d, 0, PASSES - 1)} p),
    o AS (SELECT category, leaf, domain, CAST(i * n + rk - 1 AS BIGINT) AS pos FROM q WHERE category IN ({listed})), m AS (SELECT *, category IN ({eligible}) AND {hashed(d, 'category', "'#'", 'CAST(pos AS STRING)')} % 10 < {CHOICE_TENTHS} AS mcq FROM o),
    x AS (SELECT category, pos, l.leaf AS o, row_number() OVER (PARTITION BY category, pos ORDER BY md5(concat_ws('|', category, CAST(pos AS STRING), l.leaf))) AS rk FROM m JOIN leaf l ON l.domain <> m.domain WHERE mcq),
    w AS (SELECT category, pos, o, md5(concat_ws('~', o, CAST(pos AS STRING))) AS k FROM x WHERE rk <= 3 UNION ALL SELECT category, pos, leaf AS o, md5(concat_ws('~', leaf, CAST(pos AS STRING))) AS k FROM m WHERE mcq), g AS (SELECT category, pos, {joined} AS options FROM w GROUP BY category, pos)
    SELECT concat(m.category, '-', lpad(CAST(m.pos AS STRING), 6, '0')) AS prompt_id, m.category, m.leaf, mcq, replace(CASE {cases} END, '{{leaf}}', m.leaf) AS prompt, CASE WHEN mcq THEN m.leaf END AS gold, options FROM m LEFT JOIN g ON m.category = g.category AND m.pos = g.pos"""


#: Families of word problems: name, text, answer, and the same answer by another route; a, b and c are numbers of a row.
FAMILIES = (
    ("remainder", "A shop has {a} boxes of {b} pens and sells {c} of them. How many pens are left?", "a * b - c", "(a - 1) * b + (b - c)"),
    ("journey", "A train runs {b} hours at {a} km an hour and then {c} km more. How many km is that?", "a * b + c", "c + b * (a - 1) + b"),
    ("price", "A coat costs {a} times 20 coins, and its price falls by 5 percent {c} times, each of the first price. What does it cost now?", "20 * a - a * c", "a * (20 - c)"),
    ("ages", "Mia is {a} and her uncle is {b} years older. What will their ages add up to in {c} years?", "2 * a + b + 2 * c", "(a + c) + (a + b + c)"),
    ("area", "A garden is {a} metres long and {b} metres wide and has a pond of {c} square metres. How many square metres are left?", "a * b - c", "b * (a - 1) + b - c"),
    ("mean", "The mean of three numbers is {a}. Two of them are {b} and {c}. What is the third?", "3 * a - b - c", "a + (a - b) + (a - c)"),
    ("work", "Each of {a} workers lays {b} bricks an hour. How many do they lay in {c} hours?", "a * b * c", "c * (a * (b - 1) + a)"),
    ("steps", "A sequence begins with {a} and grows by {b} at each step. What is it after {c} steps?", "a + b * c", "a + b * (c - 1) + b"),
    ("change", "{c} tickets cost {b} coins each and are paid with {a} notes of 500. How many coins come back?", "500 * a - b * c", "500 * (a - 1) + 500 - c * b"),
)


@plan
def word_problems(d):
    """Problems of nine families with their answers, each checked by another route, and whether an answer a tenth off would pass."""
    number = lambda name, low, size: f"CAST({low} + {hashed(d, repr(name), 'CAST(i AS STRING)')} % {size} AS BIGINT) AS {name}"
    text = f"CASE i % {len(FAMILIES)} " + " ".join(f"WHEN {k} THEN {literal(f[1])}" for k, f in enumerate(FAMILIES)) + " END"
    value = lambda at: f"CASE i % {len(FAMILIES)} " + " ".join(f"WHEN {k} THEN {f[at]}" for k, f in enumerate(FAMILIES)) + " END"
    name = f"CASE i % {len(FAMILIES)} " + " ".join(f"WHEN {k} THEN '{f[0]}'" for k, f in enumerate(FAMILIES)) + " END"
    return f"""WITH p AS (SELECT CAST(i AS BIGINT) AS i, {number('a', 12, 48)}, {number('b', 11, 29)}, {number('c', 1, 10)} FROM {numbers(d, 0, 899)} x), r AS (SELECT *, {name} AS family, {value(2)} AS gold, {value(3)} AS again FROM p)
    SELECT i, family, replace(replace(replace({text}, '{{a}}', CAST(a AS STRING)), '{{b}}', CAST(b AS STRING)), '{{c}}', CAST(c AS STRING)) AS problem, CAST(gold AS BIGINT) AS gold, gold = again AS checked, abs(gold * 1.1e0 - gold) <= 1e-4 * abs(gold) AS tenth_off_passes FROM r"""


@plan
def passage_prompts(d):
    """Prompts seeded by passages, in three categories: passages in an order of the category's own, each once, with the passage as background."""
    n = d.word_count("text")
    return f"""WITH p AS (SELECT doc_id, text FROM documents WHERE {n} BETWEEN 20 AND 400), c AS (SELECT {d.rows(array(d, "'saqa'", "'sci'", "'exp'"))} AS category),
    r AS (SELECT category, doc_id, text, md5(concat_ws('|', category, CAST(doc_id AS STRING))) AS h FROM p CROSS JOIN c)
    SELECT category, doc_id, h AS place, md5(concat('Background:', chr(10), text, chr(10), chr(10), CASE category WHEN 'saqa' THEN 'Which question does this answer?' WHEN 'sci' THEN 'Which claim here could be tested?' ELSE 'Explain what this is about.' END)) AS prompt_md5 FROM r"""


#: Constraints on answers: name, text with {v}, least value and number of values.
CONSTRAINTS = (("words", "Use at most {v} words.", 40, 160), ("sentences", "Write exactly {v} sentences.", 2, 6), ("lower", "Write in lower case only.", 0, 1), ("begin", "Begin with the letter number {v} of the alphabet.", 1, 26), ("avoid", "Don't use the word number {v} of this prompt.", 1, 8))
#: Audiences and their weights.
AUDIENCES = (("general", 5), ("student", 3), ("expert", 1), ("child", 1))


@plan
def constrained_prompts(d):
    """Every user turn with one or two different constraints drawn for it, rendered, and an audience drawn by weight."""
    key = "concat_ws(':', CAST(conv_id AS STRING), CAST(turn AS STRING))"
    total, parts, upto = sum(w for _, w in AUDIENCES), [], 0
    for name, w in AUDIENCES:
        upto += w
        parts.append(f"WHEN aud < {upto} THEN '{name}'")
    values = " ".join(f"WHEN {k} THEN {low} + val % {size}" for k, (_, _, low, size) in enumerate(CONSTRAINTS))
    texts = " ".join(f"WHEN {k} THEN {literal(t)}" for k, (_, t, *_) in enumerate(CONSTRAINTS))
    joined = "array_join(transform(array_sort(collect_list(struct(rk, s))), x -> x.s), ' ')" if d.spark else "string_agg(s, ' ' ORDER BY rk)"
    return f"""WITH t AS (SELECT conv_id, turn, {key} AS k FROM conversations WHERE role = 'user'), u AS (SELECT DISTINCT conv_id, turn, k, 1 + {hashed(d, 'k', "'n'")} % 2 AS n, {hashed(d, 'k', "'a'")} % {total} AS aud FROM t),
    x AS (SELECT u.*, kind, row_number() OVER (PARTITION BY k ORDER BY md5(concat(k, CAST(kind AS STRING)))) AS rk, {hashed(d, 'k', "'v'", 'CAST(kind AS STRING)')} AS val FROM u CROSS JOIN (SELECT i AS kind FROM {numbers(d, 0, len(CONSTRAINTS) - 1)} c) kk),
    s AS (SELECT conv_id, turn, aud, rk, replace(CASE kind {texts} END, '{{v}}', CAST(CASE kind {values} END AS STRING)) AS s FROM x WHERE rk <= n)
    SELECT conv_id, turn, CASE {' '.join(parts)} END AS audience, count(*) AS n_constraints, {joined} AS rules FROM s GROUP BY conv_id, turn, aud"""


@plan
def audit_normal(d):
    """The audit's normal form, which keeps underscores and marks apart from the curation's: lower case, other signs as spaces."""
    normal = f"trim({d.replace_all('lower(text)', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}_]+', ' ')})"
    return f"SELECT doc_id, md5({normal}) AS normal_md5, CAST(length({normal}) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL"


@plan
def position_ids(d):
    """Places within their segment of the tokens of each page's sequence, cut where its words end sentences: how many segments, and the sum of all places."""
    words = d.find_all("text", r"\S+")
    return f"""WITH w AS (SELECT item_id, {d.rows(d.each(d.upto(d.size('w')), 'i', 'i'))} AS i, w FROM (SELECT item_id, {words} AS w FROM benchmark) x),
    m AS (SELECT item_id, i, CASE WHEN i = 1 OR {d.matches('w[i - 2]' if d.spark else 'w[i - 1]', '[.!?]$')} THEN i END AS start FROM w), s AS (SELECT item_id, i, max(start) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM m)
    SELECT item_id, count(DISTINCT start) AS segments, CAST(sum(i - start) AS BIGINT) AS places FROM s GROUP BY item_id"""


def byte_tokens(column: str) -> str:
    """Spark SQL: the UTF-8 bytes of a text as an array of numbers."""
    return f"transform(sequence(1, octet_length({column})), i -> conv(substr(hex(encode({column}, 'UTF-8')), 2 * i - 1, 2), 16, 10))"


def render_user_turn(d: Dialect, prompt: str, background: str | None = None, suffix: str | None = None) -> str:
    """A user's turn: the background, if any, before the prompt, and the suffix, if any, behind it."""
    parts = [*(["'Background:'", "chr(10)", background, "chr(10)", "chr(10)"] if background else []), prompt, *(["' '", suffix] if suffix else [])]
    return f"concat({', '.join(parts)})"
