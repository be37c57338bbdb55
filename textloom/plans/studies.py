"""Plans of study design and scoring: ids, grids, probes, likelihood scores, sequence layout, further group-wise fits."""

from __future__ import annotations

from ..functions.answers import json_valid
from ..functions.dialect import Dialect, Plan
from .analytics import cells, curves, runs, teachers, two_sided

PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


def numbers(d: Dialect, first: int, last: int, name: str = "i") -> str:
    return f"(SELECT {'explode(sequence' if d.spark else 'unnest(range'}({first}, {last if d.spark else last + 1})) AS {name})"


def array(d: Dialect, *items: str) -> str:
    return f"array({', '.join(items)})" if d.spark else f"[{', '.join(items)}]"


def argmax(d: Dialect, a: str) -> str:
    return f"array_position({a}, array_max({a})) - 1" if d.spark else f"list_position({a}, list_max({a})) - 1"


@plan
def experiment_ids(d):
    """Readable stem and eight digits of a hash over the canonical fields; sizes in words, tokens in millions."""
    digest = "sha2(s, 256)" if d.spark else "sha256(s)"
    return f"""WITH m AS (SELECT p_partkey, p_size, concat('{{"d":', CAST(p_size * 100 AS STRING), ',"part":', CAST(p_partkey AS STRING), '}}') AS s FROM part)
    SELECT p_partkey, concat('run-', CASE WHEN p_size * 100 >= 1000 THEN concat(CAST(CAST(floor(p_size / 10) AS BIGINT) AS STRING), 'b') ELSE concat(CAST(p_size * 100 AS STRING), 'm') END, '-', substr({digest}, 1, 8)) AS experiment_id FROM m"""


@plan
def teacher_params(d):
    name = "concat('model-', CAST(p_size AS STRING), 'p', CAST(p_partkey % 10 AS STRING), 'b-it')"
    return f"SELECT p_partkey, CAST(replace(regexp_extract({name}, {d.rx('([0-9]+(?:p[0-9]+)?)b')}, 1), 'p', '.') AS DOUBLE) * 1e9 AS params FROM part"


@plan
def size_covariates(d):
    """Logarithms of teacher, student and data sizes; data against its most frequent size, of equally frequent ones the smallest."""
    return """WITH p AS (SELECT p_partkey, nullif(p_size, 0) * 1e9 AS t, p_retailprice * 1e6 AS s, (1 + p_size % 10) * 1e6 AS n FROM part), f AS (SELECT n, count(*) AS c FROM p GROUP BY n), m AS (SELECT min(n) AS ref FROM f WHERE c = (SELECT max(c) FROM f))
    SELECT p_partkey, round(log2(t / 1e9), 9) AS x, round(log2(s / 25e6), 9) AS s, round(log2(n / ref), 9) AS dd FROM p CROSS JOIN m"""


@plan
def primary_teachers(d):
    near = "exists(array(1e0, 7e0, 32e0), p -> abs(ln(p_size / p)) < 0.05)" if d.spark else "len(list_filter([1e0, 7e0, 32e0], lambda p: abs(ln(p_size / p)) < 0.05)) > 0"
    return f"SELECT p_partkey, {near} AS is_primary FROM part WHERE p_size > 0"


@plan
def chance_corrected(d):
    return "SELECT source, round((avg(CAST(quality AS DOUBLE)) - 0.25) / 0.75, 6) AS corrected FROM documents x JOIN labels l ON x.doc_id = l.doc_id GROUP BY source"


@plan
def bits_per_byte(d):
    n = "octet_length(text)" if d.spark else "strlen(text)"
    return f"SELECT doc_id, round(CASE WHEN {n} > 0 THEN 1.5e0 * length(text) / (ln(2e0) * {n}) END, 6) AS bpb FROM documents"


@plan
def nll_aggregate(d):
    """Token-weighted mean loss and bits a byte, by set."""
    return "SELECT l_shipdate >= TIMESTAMP '1995-06-01' AS late, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS nll, round(sum(l_discount * l_quantity) / (ln(2e0) * sum(4 * l_quantity)), 9) AS bpb, round(sum(l_quantity), 2) AS tokens FROM lineitem GROUP BY 1"


@plan
def choice_accuracy(d):
    """Of four options the one with the highest score, and with the highest score a character, against the right one; the first of equals wins."""
    e = [f"CAST(embedding[{i if d.spark else i + 1}] AS DOUBLE)" for i in range(4)]
    return f"""WITH s AS (SELECT vec_id, label % 4 AS gold, {array(d, *e)} AS lls, {array(d, *(f'{x} / {n}' for x, n in zip(e, (3, 5, 7, 11), strict=True)))} AS per_char FROM embeddings)
    SELECT gold, count(*) AS n, round(avg(CASE WHEN {argmax(d, 'lls')} = gold THEN 1e0 ELSE 0e0 END), 6) AS acc, round(avg(CASE WHEN {argmax(d, 'per_char')} = gold THEN 1e0 ELSE 0e0 END), 6) AS acc_norm FROM s GROUP BY gold"""


@plan
def format_probe(d):
    """Share of assistant turns that each format rule accepts; the denominator is all turns."""
    lines = d.lines("text")
    rules = {
        "list": f"{d.size(d.keep(lines, 'x', d.matches('x', '^[0-9]+[.)] ')))} >= 1", "table": f"{d.size(d.keep(lines, 'x', d.matches('x', '^[|]')))} >= 2",
        "sentence": d.matches("trim(text)", "[.!?]$"), "capital": d.matches("trim(text)", r"^\p{Lu}"), "short": f"{d.word_count('text')} <= 50",
        "json": json_valid(d, "text"), "yes or no": d.matches("trim(text)", r"(?i)^(yes|no)\b"), "upper case": f"upper(text) = text AND {d.matches('text', '[A-Z]')}",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n, round(avg(CASE WHEN {v} THEN 1e0 ELSE 0e0 END), 6) AS pass_rate FROM conversations WHERE role = 'assistant'" for k, v in rules.items())


#: Instructions of the format probe, one for each of its rules.
PROBES = (
    ("list", "Name three things about {leaf} as a numbered list."), ("table", "Compare two sides of {leaf} in a table."), ("sentence", "Describe {leaf} in one sentence."), ("capital", "Begin with a capital letter: what is {leaf}?"),
    ("short", "Say what {leaf} is in at most fifty words."), ("json", "Give {leaf} as a JSON object."), ("yes or no", "Is {leaf} well known? Answer yes or no."), ("upper case", "WRITE ONE LINE ABOUT {leaf} IN CAPITALS."),
)


@plan
def probe_items(d):
    """The probe's items: each instruction for each of twenty-five topics."""
    cases = " ".join(f"WHEN {k} THEN '{text}'" for k, (_, text) in enumerate(PROBES))
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(PROBES))
    return f"WITH x AS (SELECT i, n_nationkey, n_name FROM nation CROSS JOIN {numbers(d, 0, len(PROBES) - 1)} p) SELECT CAST(i * 25 + n_nationkey AS BIGINT) AS item, CASE i {names} END AS rule, replace(CASE i {cases} END, '{{leaf}}', n_name) AS prompt FROM x"


@plan
def param_counts(d):
    """Parameters of a decoder by layers and width: embeddings, attention with grouped keys, gated feed-forward, norms; and training FLOP a token."""
    n = "32000 * w + l * (2 * w * w + 2 * w * (w / 4) + 3 * w * f + 2 * w) + w"
    return f"WITH g AS (SELECT l, 64 * k AS w, 64 * k * 8 / 3 AS f FROM {numbers(d, 2, 24, 'l')} a CROSS JOIN {numbers(d, 2, 16, 'k')} b) SELECT CAST(l AS BIGINT) AS layers, CAST(w AS BIGINT) AS width, CAST(floor({n}) AS BIGINT) AS params, CAST(floor(6 * ({n} - 32000 * w)) AS BIGINT) AS flop_per_token FROM g"


@plan
def shape_search(d):
    """For each target size the layers and width nearest to it with a sound aspect ratio."""
    n = "32000 * w + l * (2.5 * w * w + 8.0 * w * w + 2 * w) + w"
    return f"""WITH g AS (SELECT l, 64 * k AS w FROM {numbers(d, 2, 32, 'l')} a CROSS JOIN {numbers(d, 4, 40, 'k')} b), t AS (SELECT CAST(power(2e0, e) AS BIGINT) * 25000000 AS target FROM {numbers(d, 0, 5, 'e')} c),
    s AS (SELECT target, l, w, CAST({n} AS DOUBLE) AS n, row_number() OVER (PARTITION BY target ORDER BY abs({n} - target), l) AS rk FROM g CROSS JOIN t WHERE w / l BETWEEN 20 AND 150)
    SELECT target, CAST(l AS BIGINT) AS layers, CAST(w AS BIGINT) AS width, round(n / target, 6) AS ratio FROM s WHERE rk = 1"""


@plan
def memory_plan(d):
    """For decoders by layers and width, with and without recomputed activations: bytes of states and of a token's activations and logits,
    the most sequences of 2048 tokens that 80 GB hold, and the steps that a batch of 2**20 tokens is gathered in."""
    params = "32000 * w + l * (2.5 * w * w + 3 * w * f + 2 * w) + w"
    layer = "(2 * (5 * w + 2 * w + w / 2e0 + 4 * f) + 4 * (w / 64) + 8) * 1.25"
    return f"""WITH g AS (SELECT CAST(l AS DOUBLE) AS l, 64e0 * k AS w, floor(64e0 * k * 8 / 3) AS f FROM {numbers(d, 4, 32, 'l')} a CROSS JOIN {numbers(d, 4, 32, 'k')} b WHERE k % 4 = 0 AND l % 4 = 0),
    m AS (SELECT l, w, recompute, 16 * ({params}) AS states, CASE WHEN recompute = 1 THEN l * 2 * w * 1.25 + {layer} ELSE l * {layer} END + 2 * 32000 AS per_token FROM g CROSS JOIN {numbers(d, 0, 1, 'recompute')} r),
    s AS (SELECT *, CAST(floor(greatest(80 * power(2e0, 30) - states - 2 * power(2e0, 30), 0) / per_token / 2048) AS BIGINT) AS sequences FROM m)
    SELECT CAST(l AS BIGINT) AS layers, CAST(w AS BIGINT) AS width, recompute = 1 AS recompute, CAST(floor(states) AS BIGINT) AS state_bytes, round(per_token, 2) AS token_bytes, sequences, sequences >= 1 AS fits, CASE WHEN sequences >= 1 THEN CAST(ceil(power(2e0, 20) / (sequences * 2048)) AS BIGINT) END AS steps FROM s"""


@plan
def lambda_grid(d):
    return f"SELECT CAST(i AS BIGINT) AS i, round(CASE WHEN i = 0 THEN 0e0 ELSE 1e-3 * power(1e4, (i - 1) / 39e0) END, 9) AS value FROM {numbers(d, 0, 40)} x"


@plan
def hashed_words(d):
    """Counts of words in 512 hashed dimensions, and the vector's length."""
    h = "conv(substr(md5(w), 1, 8), 16, 10)" if d.spark else "('0x' || substr(md5(w), 1, 8))"
    return f"""WITH x AS (SELECT item_id, {d.rows(d.words('text'))} AS w FROM benchmark), c AS (SELECT item_id, CAST({h} AS BIGINT) % 512 AS dim, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT item_id, count(*) AS dims, CAST(sum(n) AS BIGINT) AS words, round(sqrt(sum(CAST(n AS DOUBLE) * n)), 6) AS norm FROM c GROUP BY item_id"""


@plan
def diversity_report(d):
    return f"SELECT lang, source, CAST(grouping(lang) AS INT) AS all_langs, count(*) AS n, CAST(sum({d.word_count('text')}) AS BIGINT) AS words FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())"


@plan
def subsample_report(d):
    return f"SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total, round(avg(length(text)), 6) AS mean, round({d.median('length(text)')}, 6) AS median FROM documents GROUP BY lang"


@plan
def data_properties(d):
    """Correctness, distinct pairs of words and mean length by source, joined."""
    return f"""WITH w AS (SELECT doc_id, source, {d.words('text')} AS w FROM documents), g AS (SELECT source, round(CAST(count(DISTINCT g) AS DOUBLE) / count(*), 6) AS distinct_2 FROM (SELECT source, {d.rows(d.grams('w', 2))} AS g FROM w) x GROUP BY source),
    m AS (SELECT w.source, round(avg({d.size('w')}), 6) AS mean_len, round(avg(CAST(quality AS DOUBLE)), 6) AS correctness FROM w LEFT JOIN labels l ON w.doc_id = l.doc_id GROUP BY w.source)
    SELECT m.source, distinct_2, mean_len, correctness FROM m JOIN g ON m.source = g.source"""


@plan
def prompt_token_fraction(d):
    return f"""WITH t AS (SELECT conv_id, role, {d.approx_tokens('text')} AS n FROM conversations) SELECT conv_id, CAST(sum(n) AS BIGINT) AS tokens, round(CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END) AS DOUBLE) / greatest(sum(n), 1), 6) AS prompt_fraction FROM t GROUP BY conv_id"""


@plan
def sequence_counts(d):
    """Rows of 1024 tokens and one more that each source's stream gives, and the tokens left over."""
    return f"WITH t AS (SELECT source, CAST(sum({d.approx_tokens('text')} + 2) AS BIGINT) AS n FROM documents GROUP BY source) SELECT source, n, CAST(floor((n - 1) / 1024.0) AS BIGINT) AS seqs, (n - 1) % 1024 AS left_over FROM t"


@plan
def loss_windows(d):
    """Disjoint loss windows of 256 tokens that share one token of context."""
    return f"WITH t AS (SELECT doc_id, {d.approx_tokens('text')} AS n FROM documents) SELECT doc_id, n, CASE WHEN n < 2 THEN 0 ELSE CAST(floor((n - 2) / 255.0) AS BIGINT) + 1 END AS windows FROM t"


@plan
def experiment_matrix(d):
    """Students by teachers by seeds, with ids, and each teacher's neighbours on the ladder."""
    return f"""WITH t AS (SELECT r_regionkey AS teacher, lag(r_regionkey) OVER (ORDER BY r_regionkey) AS below, lead(r_regionkey) OVER (ORDER BY r_regionkey) AS above FROM region)
    SELECT n_nationkey AS student, teacher, CAST(i AS BIGINT) AS seed, below, above, substr(md5(concat_ws('|', CAST(n_nationkey AS STRING), CAST(teacher AS STRING), CAST(i AS STRING))), 1, 8) AS id FROM nation CROSS JOIN t CROSS JOIN {numbers(d, 0, 2)} s"""


@plan
def answer_match(d):
    """Numbers in user turns against the conversation's id, with marks stripped and a relative tolerance."""
    number = f"regexp_extract(replace(replace(text, ',', ''), '$', ''), {d.rx('-?[0-9]+(?:[.][0-9]+)?')}, 0)"
    value = f"try_cast(nullif({number}, '') AS DOUBLE)"
    return f"SELECT conv_id, turn, {value} AS value, coalesce(abs({value} - conv_id) <= 1e-4 * abs(conv_id), false) AS matched FROM conversations WHERE role = 'user'"


@plan
def topic_fallback(d):
    return f"SELECT item_id, {d.replace_all(d.glue(d.part(d.find_all('text', '\\S+'), '1', 6)), '[,.;:]+$', '')} AS topic FROM benchmark"


@plan
def mediation(d):
    """Within students: slope of the outcome on the condition's rank, without and with the cell's size as a mediator, the mediator's
    own slope and the rank's on it, each with its p value, and the share mediated."""
    p = lambda slope, variance, df: f"round({two_sided(f'abs({slope} / sqrt({variance}))', df)}, 6)"
    return f"""WITH {cells(d)}, x AS (SELECT student, mean, CAST(substring(cond, 1, 1) AS DOUBLE) AS x0, CAST(r AS DOUBLE) AS z0 FROM cell),
    c AS (SELECT student, mean - avg(mean) OVER (PARTITION BY student) AS y, x0 - avg(x0) OVER (PARTITION BY student) AS x, z0 - avg(z0) OVER (PARTITION BY student) AS z FROM x),
    s AS (SELECT CAST(count(*) - count(DISTINCT student) AS DOUBLE) AS n, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM c),
    b AS (SELECT *, xx * zz - xz * xz AS det, xy / xx AS total, xz / xx AS path, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS direct, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS mediator FROM s),
    e AS (SELECT *, (yy - total * xy) / (n - 1) AS st, (zz - path * xz) / (n - 1) AS sp, (yy - direct * xy - mediator * zy) / (n - 2) AS sd FROM b)
    SELECT round(total, 4) AS total, {p('total', 'st / xx', '(n - 1)')} AS p_total, round(path, 4) AS path, {p('path', 'sp / xx', '(n - 1)')} AS p_path, round(direct, 4) AS direct, {p('direct', 'sd * zz / det', '(n - 2)')} AS p_direct,
    round(mediator, 4) AS mediator, {p('mediator', 'sd * xx / det', '(n - 2)')} AS p_mediator, round(1 - direct / total, 6) AS mediated FROM e"""


@plan
def leave_one_out(d):
    """Error on each student of a line fitted on all others, from sums: the others' sums are all sums less the student's."""
    return f"""WITH {cells(d)}, x AS (SELECT student, mean AS y, CAST(substring(cond, 1, 1) AS DOUBLE) AS x FROM cell),
    g AS (SELECT student, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM x GROUP BY student),
    o AS (SELECT student, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM g),
    b AS (SELECT student, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS k FROM o)
    SELECT x.student, round(sqrt(avg(power(y - k - b * x, 2))), 4) AS rmse FROM x JOIN b ON x.student = b.student GROUP BY x.student"""


@plan
def weighted_fit(d):
    """Slope of cell means on the condition's rank, weighted by cell sizes over variances."""
    return f"""WITH {cells(d)}, w AS (SELECT student, CAST(substring(cond, 1, 1) AS DOUBLE) AS x, mean AS y, r / (sd * sd) AS w FROM cell WHERE r > 1 AND sd > 0)
    SELECT student, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)), 4) AS slope, count(*) AS n FROM w GROUP BY student HAVING count(*) >= 3"""


@plan
def tstar_labels(d):
    """Shape of each student's means over the ordered conditions: flat, interior, saturating or monotone."""
    return f"""WITH {cells(d)}, p AS (SELECT student, avg(sd / sqrt(r)) AS se, max(mean) - min(mean) AS spread, max_by(CAST(substring(cond, 1, 1) AS INT), mean) AS top,
    max(CASE WHEN cond = '5-LOW' THEN mean END) - max(CASE WHEN cond = '4-NOT SPECIFIED' THEN mean END) AS last_step FROM cell GROUP BY student)
    SELECT student, CASE WHEN spread < 2 * se THEN 'flat' WHEN top BETWEEN 2 AND 4 THEN 'interior' WHEN abs(last_step) < se THEN 'saturating' ELSE 'monotone' END AS label FROM p"""


@plan
def residual_variance(d):
    """Per curve the residual variance about its logarithmic fit, and points with too much pull."""
    return f"""WITH {curves(d)}, f AS (SELECT run, regr_slope(l, ln(d)) AS b, regr_intercept(l, ln(d)) AS k, count(*) AS n, avg(ln(d)) AS mx, var_pop(ln(d)) AS vx FROM c GROUP BY run),
    e AS (SELECT c.run, n, l - k - b * ln(d) AS e, 1e0 / n + power(ln(d) - mx, 2) / (n * vx) AS h FROM c JOIN f ON c.run = f.run), v AS (SELECT *, sum(e * e) OVER (PARTITION BY run) / (n - 2) AS s2 FROM e WHERE n > 3)
    SELECT run, round(max(s2), 9) AS s2, CAST(sum(CASE WHEN e * e * h / (2 * s2 * power(1 - h, 2)) > 4e0 / n THEN 1 ELSE 0 END) AS BIGINT) AS influential FROM v GROUP BY run"""


def half_samples(d: Dialect, table: str, columns: str, key: str, n: int) -> str:
    """Rows of a table once for each of n half samples i that hold them: a hash of key and block decides 32 at a time."""
    first = d.each(d.upto(str((n + 31) // 32)), "x", "x - 1")
    held = d.keep(d.upto("32"), "j", f"substr(h, CAST(j AS INT), 1) < '8' AND 32 * b + j <= {n}")
    return f"""blocks AS (SELECT {columns}, b, md5(concat({key}, '|', CAST(b AS STRING))) AS h FROM (SELECT {columns}, {key}, {d.rows(first)} AS b FROM (SELECT /*+ REPARTITION({key}) */ * FROM {table}) ts) bs),
    halves AS (SELECT {columns}, 32 * b + j AS i FROM (SELECT {columns}, b, {d.rows(held)} AS j FROM blocks) js)"""


@plan
def selection_shares(d):
    """How often each teacher is the best at a price of cost, over 5000 half samples of its items' chunks.

    Items are summed into 256 chunks a teacher by hash first, so resamples are of sums, and grow with teachers alone.
    """
    chunk = hashed(d, "CAST(l_orderkey AS STRING)", "':'", "CAST(l_linenumber AS STRING)")
    return f"""WITH w AS (SELECT k, chunk, concat_ws(':', CAST(k AS STRING), CAST(chunk AS STRING)) AS id, sum(g) AS g, sum(c) AS c, count(*) AS n FROM (SELECT p_size % 7 AS k, {chunk} % 256 AS chunk, l_extendedprice / l_quantity AS g, p_retailprice AS c FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0) x GROUP BY k, chunk),
    {half_samples(d, 'w', 'k, g, c, n', 'id', 5000)}, b AS (SELECT i, k, sum(g) / sum(n) - 0.5 * sum(c) / sum(n) AS v FROM halves GROUP BY i, k), r AS (SELECT i, k, row_number() OVER (PARTITION BY i ORDER BY round(v, 6) DESC, k) AS rk FROM b)
    SELECT k, count(*) AS wins, round(count(*) / 5e3, 6) AS share FROM r WHERE rk = 1 GROUP BY k"""


@plan
def leave_group_out(d):
    """Share of variance that a line fitted on all other students explains in each one's cells, pooled over the students."""
    return f"""WITH {cells(d)}, x AS (SELECT student, mean AS y, CAST(substring(cond, 1, 1) AS DOUBLE) AS x FROM cell), g AS (SELECT student, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM x GROUP BY student),
    o AS (SELECT student, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy, count(*) OVER () AS groups FROM g),
    b AS (SELECT student, groups, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS k FROM o WHERE groups >= 3), m AS (SELECT avg(y) AS m FROM x)
    SELECT count(*) AS n, round(1 - sum(power(y - k - b * x, 2)) / sum(power(y - m, 2)), 6) AS r2 FROM x JOIN b ON x.student = b.student CROSS JOIN m"""


#: The surface of the simulated index: outcome by teacher's size x, student's size s and dose d, and the deviation of its noise.
SURFACE, NOISE = "2 * s + 15e-1 * x - 2e-1 * x * x + 1e-1 * s * x + 3e-1 * d", 0.05


@plan
def simulated_index(d):
    """Runs of a study whose surface is known: every student, teacher size, dose and seed, with normal noise from hashes."""
    u = lambda tag: f"(({d.hash32(repr(tag), 'student', repr('|'), 'CAST(x AS STRING)', repr('|'), 'CAST(d AS STRING)', repr('|'), 'CAST(seed AS STRING)')} + 1) / 4294967297e0)"
    return f"""WITH g AS (SELECT n_name AS student, 1e0 + n_nationkey % 4 AS s, CAST(x AS DOUBLE) AS x, CAST(d AS DOUBLE) AS d, CAST(seed AS BIGINT) AS seed FROM nation CROSS JOIN {numbers(d, 1, 5, 'x')} a CROSS JOIN {numbers(d, 0, 3, 'd')} b CROSS JOIN {numbers(d, 0, 2, 'seed')} c)
    SELECT student, s, x, d, seed, round({SURFACE} + {NOISE} * sqrt(-2 * ln({u('u')})) * cos(2 * pi() * {u('v')}), 9) AS y FROM g"""


@plan
def matrix_summary(d):
    """Specifications of the experiment matrix by student, teacher and together, and the most tokens that a teacher's pool must hold."""
    return f"""WITH m AS (SELECT n_nationkey AS student, r_regionkey AS teacher, CAST(i AS BIGINT) AS seed, (1 + n_nationkey % 4) * 1000000 AS tokens FROM nation CROSS JOIN region CROSS JOIN {numbers(d, 0, 2)} s)
    SELECT student, teacher, CAST(grouping(student) AS INT) AS all_students, count(*) AS n, CAST(max(tokens) AS BIGINT) AS pool_tokens FROM m GROUP BY GROUPING SETS ((student), (teacher), ())"""


@plan
def unit_costs(d):
    """Seconds, money and energy per delivered unit, with what is missing taken from the next best figure."""
    return "SELECT s_nationkey, round(sum(coalesce(nullif(l_extendedprice, 0), l_quantity * 100)) / sum(l_quantity), 6) AS price_per_unit, round(sum(l_discount * l_extendedprice) / sum(l_quantity), 6) AS discount_per_unit, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey"


@plan
def capability_ranks(d):
    return f"WITH {teachers(d)}, r AS (SELECT rank() OVER (ORDER BY cost) AS rc, rank() OVER (ORDER BY g) AS rg FROM t) SELECT round(corr(CAST(rc AS DOUBLE), CAST(rg AS DOUBLE)), 6) AS rho FROM r"


@plan
def power_simulation_summary(d):
    return f"WITH {runs(d)} SELECT student, count(*) AS n, round(avg(a) / stddev_samp(a) * sqrt(count(*)), 6) AS t FROM r GROUP BY student HAVING count(*) > 1"


@plan
def nested_check(d):
    """Documents of a smaller hash subsample that a larger one lacks: none."""
    pick = lambda n: f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('1:', CAST(doc_id AS STRING))), doc_id) AS rk FROM documents) q{n} WHERE rk <= {n}"
    return f"WITH a AS ({pick(20)}), b AS ({pick(60)}) SELECT (SELECT count(*) FROM a) AS small, (SELECT count(*) FROM b) AS large, (SELECT count(*) FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) x) AS lacking"


def hashed(d: Dialect, *parts: str) -> str:
    return d.hash32(*parts)


@plan
def writer_prompts(d):
    """Persona and leaf picked by hash for each of two hundred instructions; personas are the kinds of customer in the whole table."""
    return f"""WITH k AS (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT concat(lower(c_mktsegment), ' customer in ', n_name) AS persona, row_number() OVER (ORDER BY c_mktsegment, n_name) - 1 AS pi, count(*) OVER () AS pn FROM k),
    l AS (SELECT n_name AS leaf, row_number() OVER (ORDER BY n_nationkey) - 1 AS li, count(*) OVER () AS ln FROM nation), i AS (SELECT CAST(i AS BIGINT) AS i, {hashed(d, "'p'", 'CAST(i AS STRING)')} AS hp, {hashed(d, "'l'", 'CAST(i AS STRING)')} AS hl FROM {numbers(d, 0, 199)} x)
    SELECT i, concat('As a ', persona, ', ask a question about ', leaf, '.') AS instruction FROM i JOIN p ON pi = hp % pn JOIN l ON li = hl % ln"""


MOCK_WORDS = ("river", "stone", "light", "garden", "window", "music", "letter", "mountain", "silver", "market", "winter", "paper")


@plan
def mock_generations(d):
    """Responses of a pseudo-teacher to all user turns: words and their number follow from a hash of turn and seed, so any worker gives the same."""
    words = array(d, *(f"'{w}'" for w in MOCK_WORDS))
    pick = f"m[1 + CAST({hashed(d, 'k', chr(39) + ':' + chr(39), 'CAST(i AS STRING)')} % {len(MOCK_WORDS)} AS INT)]" if not d.spark else f"element_at(m, 1 + CAST({hashed(d, 'k', chr(39) + ':' + chr(39), 'CAST(i AS STRING)')} % {len(MOCK_WORDS)} AS INT))"
    return f"""WITH t AS (SELECT conv_id, turn, concat_ws('|', '7', CAST(conv_id AS STRING), CAST(turn AS STRING), text) AS k, {words} AS m FROM conversations WHERE role = 'user'), n AS (SELECT *, 3 + {hashed(d, 'k')} % 40 AS n FROM t)
    SELECT conv_id, turn, n AS word_count, {d.glue(d.each(d.upto('n'), 'i', pick))} AS response, CASE WHEN n >= 40 THEN 'length' ELSE 'stop' END AS finish_reason FROM n"""


@plan
def cluster_bootstrap(d):
    """Quadratic in the condition's rank refitted on resampled clusters (a condition's seeds): interval of the vertex, and how often it lies inside.

    Clusters are summed first, then weighted: a cluster's Poisson weight in a resample follows from a hash, so resamples
    are rows of sums, and no run is repeated.
    """
    weight = " + ".join(f"CAST(u >= {c} AS INT)" for c in ("0.36788e0", "0.73576e0", "0.91970e0", "0.98101e0", "0.99634e0"))
    u = f"{hashed(d, 'student', chr(39) + '|' + chr(39), 'cond', chr(39) + '|' + chr(39), 'CAST(seed AS STRING)', chr(39) + '|' + chr(39), 'CAST(i AS STRING)')} / 4294967296e0"
    s = ", ".join([*(f"sum(w * m * power(x, {k})) AS s{k}" for k in range(5)), *(f"sum(w * y * power(x, {k})) AS t{k}" for k in range(3))])
    return f"""WITH {runs(d)}, k AS (SELECT student, cond, seed, CAST(substring(cond, 1, 1) AS DOUBLE) - 3 AS x, CAST(count(*) AS DOUBLE) AS m, sum(a / 1e5) AS y FROM r GROUP BY student, cond, seed),
    g AS (SELECT student, x, m, y, i, {u} AS u FROM k CROSS JOIN {numbers(d, 1, 2000)} b), w AS (SELECT student, i, x, m, y, {weight} AS w FROM g),
    f AS (SELECT student, i, {s} FROM w WHERE w > 0 GROUP BY student, i HAVING count(DISTINCT x) >= 3),
    e AS (SELECT student, i, (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det AS b, (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det AS c
          FROM (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM f) z),
    v AS (SELECT student, b, c, CASE WHEN c < 0 THEN greatest(-2e0, least(2e0, -b / (2 * c))) WHEN b >= 0 THEN 2e0 ELSE -2e0 END AS x, CASE WHEN c < 0 AND abs(b / (2 * c)) < 2 THEN 1e0 ELSE 0e0 END AS inside FROM e)
    SELECT student, count(*) AS resamples, round(3 + {d.median('x', 0.025)}, 4) AS lo, round(3 + {d.median('x')}, 4) AS vertex, round(3 + {d.median('x', 0.975)}, 4) AS hi, round(avg(inside), 6) AS interior, round({d.median('c')}, 5) AS curvature FROM v GROUP BY student"""


@plan
def profile_fit(d):
    """A power law whose exponent is profiled on a coarse grid and then on a fine one about the best."""
    fit = lambda al: f"SELECT run, alpha, regr_slope(l, power(d, -alpha)) AS a, regr_intercept(l, power(d, -alpha)) AS e, greatest(regr_syy(l, power(d, -alpha)) - regr_slope(l, power(d, -alpha)) * regr_sxy(l, power(d, -alpha)), 0) AS sse FROM {al} GROUP BY run, alpha"
    return f"""WITH {curves(d)}, x1 AS (SELECT run, CAST(0.02 * j AS DOUBLE) AS alpha, d, l FROM c CROSS JOIN {numbers(d, 1, 60, 'j')} g), f1 AS ({fit('x1')}), b1 AS (SELECT run, alpha AS best, row_number() OVER (PARTITION BY run ORDER BY round(sse, 9), alpha) AS rk FROM f1 WHERE a >= 0),
    x2 AS (SELECT c.run, best + CAST(0.001 * (j - 20) AS DOUBLE) AS alpha, d, l FROM c JOIN b1 ON c.run = b1.run AND rk = 1 CROSS JOIN {numbers(d, 1, 39, 'j')} g), f2 AS ({fit('x2')}), b2 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(sse, 9), alpha) AS rk FROM f2 WHERE a >= 0 AND alpha > 0)
    SELECT run, round(alpha, 3) AS alpha, round(e, 2) AS e FROM b2 WHERE rk = 1"""
