"""Plans of text curation: row rules, counts, deduplication, contamination, sampling, packing."""

from __future__ import annotations

from ..functions.answers import json_valid, list_valid, table_valid
from ..functions.dialect import Dialect, Plan
from ..functions.udfs import PRIME, coefficients

PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


# Fixed values, which decide what the row rules flag: patterns of refusals, of self-identification and of references to a
# passage, patterns of the harvest filter, stop words of the English heuristic, its limits.
REFUSAL = r"(?i)\b(i'?m sorry,? but|i cannot (help|assist|provide|comply)|as an ai|i am an ai language model|i'?m unable to|i can'?t help with|i will not|i won'?t be able to)\b"
SELF_ID = r"(?i)\b(qwen|alibaba cloud|tongyi|通义)\b"
PASSAGE_REF = r"(?i)\b(the (passage|text|background|excerpt) (above|below|provided|given)|according to the (passage|text)|as (mentioned|stated) (above|in the text)|the author)\b"
URL = r"(?i)(https?://|www\.)\S+|\b[a-z0-9-]+\.(com|org|net|io|edu|gov)\b"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(\+?\d[\d\s().-]{7,}\d)"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
CODE_REQUEST = (
    r"(?i)```|\bwrite (me )?(a|an|the|some)? ?(python|java|javascript|c\+\+|c#|rust|go|sql|bash|html|css|typescript)?\s*"
    r"(function|script|program|class|code|regex|query|snippet)\b|\bimplement\b.*\bin (python|java|c\+\+|javascript|rust|go)\b"
    r"|\b(def |#include|import numpy|SELECT .* FROM|console\.log|public static void)\b|\bunit tests?\b|\bdebug (this|my) code\b"
)
MULTI_TURN = r"(?i)(^|\n)\s*(user|assistant|human|ai|system|bot)\s*:"
STOP_WORDS = """the a an and or but if then of to in on at by for with from as is are was were be been being
it its this that these those there here he she they we you i me him her them us my your his
their our not no yes do does did done have has had will would can could should may might must
what which who whom whose when where why how all any each some more most other such only own
same so than too very just also because while about into over after before between under again
further once during out up down off through above below both few many much one two three first
last new old good great long little large small every another every well still even never
always often sometimes"""
LEAST_ENGLISH, LABEL_ENGLISH = 0.65, 0.5


#: Least tokens of a short answer and of any other, limits of the repetition rules by length of gram.
LEAST_TOKENS, SHORT_TOKENS = 32, 8
GRAM_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
FINAL_ANSWER = r"(?i)final answer\s*:"
#: The rules that drop a response; the first that holds is the reason.
DROPS = ("truncated", "too_short", "non_english", "cjk", "degenerate", "exact_dup", "refusal", "self_id", "passage_ref", "format_invalid", "missing_answer", "contaminated")


def responses(d: Dialect) -> str:
    """One response a document. Its category, whether its prompt was seeded by a passage, and the structure asked for follow
    from its number; a text of 20,000 characters stands for one whose backend stopped by length."""
    return """g0 AS (SELECT doc_id, lpad(CAST(doc_id AS STRING), 10, '0') AS prompt_id, source AS teacher, coalesce(text, '') AS text,
    CASE doc_id % 4 WHEN 0 THEN 'saqa' WHEN 1 THEN 'msr' WHEN 2 THEN 'str' ELSE 'exp' END AS category, CASE WHEN doc_id % 4 = 2 THEN CASE doc_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'table' ELSE 'list' END END AS kind,
    coalesce(doc_id % 5 = 0, false) AS seeded, CASE WHEN length(text) >= 20000 THEN 'length' ELSE 'stop' END AS finish_reason FROM documents)"""


def dup_lines(d: Dialect) -> str:
    return f"CASE WHEN {d.size('lines')} < 2 THEN 0.0 ELSE CAST({d.size('lines')} - {d.size(d.distinct('lines'))} AS DOUBLE) / {d.size('lines')} END"


def gen(d: Dialect) -> str:
    """Responses with the flags of all twelve rules, whether they stay, and the first reason that drops them."""
    norm = d.replace_all("lower(trim(text))", r"\s+", " ")
    cjk = r"[^\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
    grams = " OR ".join(f"{n} * {d.at('tops', n - 2)} > {limit} * length(text)" for n, limit in GRAM_LIMITS.items())
    return f"""{contamination(d, 8)}, {responses(d)},
    g1 AS (SELECT *, {d.approx_tokens('text')} + 2 AS tokens, {d.word_count('text')} AS word_count, {d.lines('text')} AS lines, {d.top_counts('text')} AS tops,
                  md5({norm}) AS norm, CAST(length({d.replace_all('text', cjk, '')}) AS DOUBLE) / greatest(length(text), 1) AS cjk_ratio, {english_of(d, 'text')} AS p_en FROM g0),
    e1 AS (SELECT teacher AS t1, md5({norm}) AS n1, min(prompt_id) AS first_id FROM g0 GROUP BY 1, 2),
    g2 AS (SELECT g1.*, finish_reason = 'length' AS truncated, (tokens < CASE WHEN category = 'saqa' THEN {SHORT_TOKENS} ELSE {LEAST_TOKENS} END OR trim(text) = '') AS too_short,
                  trim(text) <> '' AND p_en < {LEAST_ENGLISH} AS non_english, cjk_ratio > 0.01 AS cjk, {dup_lines(d)} AS dup_line_frac,
                  coalesce(prompt_id > first_id, false) AS exact_dup,
                  {d.matches('substring(text, 1, 300)', REFUSAL)} AS refusal, {d.matches('text', SELF_ID)} AS self_id, seeded AND {d.matches('text', PASSAGE_REF)} AS passage_ref,
                  coalesce(CASE kind WHEN 'json' THEN NOT {json_valid(d, 'text')} WHEN 'table' THEN NOT {table_valid(d, 'lines')} WHEN 'list' THEN NOT {list_valid(d, 'lines')} END, false) AS format_invalid,
                  category = 'msr' AND NOT {d.matches('text', FINAL_ANSWER)} AS missing_answer FROM g1 LEFT JOIN e1 ON g1.teacher IS NOT DISTINCT FROM e1.t1 AND g1.norm = e1.n1),
    g3 AS (SELECT g2.*, dup_line_frac > 0.30 OR {grams} AS degenerate, bad.doc_id IS NOT NULL AS contaminated FROM g2 LEFT JOIN (SELECT DISTINCT doc_id FROM hits) bad ON g2.doc_id = bad.doc_id),
    g AS (SELECT *, CASE {' '.join(f"WHEN {x} THEN '{x}'" for x in DROPS)} END AS drop_reason FROM g3)"""


@plan
def curate_summary(d):
    return f"""WITH {gen(d)} SELECT teacher, count(*) AS n_offered, {', '.join(f'CAST(count_if({x}) AS BIGINT) AS n_{x}' for x in DROPS)}, CAST(count_if(drop_reason IS NULL) AS BIGINT) AS n_retained,
    round(CAST(count_if(drop_reason IS NULL) AS DOUBLE) / count(*), 6) AS yield_frac, CAST(sum(CASE WHEN drop_reason IS NULL THEN tokens ELSE 0 END) AS BIGINT) AS tokens_retained FROM g GROUP BY teacher"""


@plan
def drop_reasons(d):
    return f"WITH {gen(d)} SELECT prompt_id, drop_reason IS NULL AS retained, drop_reason FROM g"


@plan
def drop_reason_counts(d):
    return f"WITH {gen(d)} SELECT category, coalesce(drop_reason, 'retained') AS reason, count(*) AS n FROM g GROUP BY 1, 2"


@plan
def token_counts(d):
    return f"SELECT doc_id, {d.approx_tokens('text')} AS approx_tokens, {d.approx_tokens('text')} + 2 AS rendered_tokens FROM documents"


@plan
def word_counts(d):
    return f"SELECT doc_id, {d.word_count('text')} AS n_words, {d.size(d.words('text'))} AS n_word_tokens FROM documents"


@plan
def char_counts(d):
    return f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST({'octet_length(text)' if d.spark else 'strlen(text)'} AS BIGINT) AS n_bytes FROM documents"


def english_of(d: Dialect, text: str) -> str:
    """Share of ASCII letters among letters, times a bounded share of stop words; 0 without letters or words."""
    letters, latin = d.replace_all(text, r"[^\p{L}]+", ""), d.replace_all(text, r"[^A-Za-z]+", "")
    words = d.find_all(text, "[A-Za-z']+")
    stops = d.size(d.keep(words, "x", f"lower(x) IN ({', '.join(repr(s) for s in dict.fromkeys(STOP_WORDS.split()))})"))
    return f"(CASE WHEN {d.size(words)} = 0 THEN 0e0 ELSE CAST(length({latin}) AS DOUBLE) / length({letters}) * least(1e0, 30e-2 + 25e-1 * CAST({stops} AS DOUBLE) / {d.size(words)}) END)"


def english(d: Dialect) -> str:
    return f"e AS (SELECT doc_id, lang, {english_of(d, 'text')} AS p_en FROM documents)"


@plan
def english_probability(d):
    return f"WITH {english(d)} SELECT doc_id, round(p_en, 6) AS p_en, CASE WHEN p_en >= {LABEL_ENGLISH} THEN 'en' ELSE 'und' END AS label FROM e"


@plan
def lang_filter(d):
    return f"WITH {english(d)} SELECT lang, count(*) AS n, CAST(count_if(p_en < {LEAST_ENGLISH}) AS BIGINT) AS n_non_english FROM e GROUP BY lang"


@plan
def dup_line_fraction(d):
    return f"WITH l AS (SELECT doc_id, {d.lines('text')} AS lines FROM documents) SELECT doc_id, round({dup_lines(d)}, 6) AS dup_line_frac, {dup_lines(d)} > 0.30 AS degenerate FROM l"


@plan
def top_char_ngrams(d):
    """Most frequent grams of 2 to 4 characters, and whether one takes too much of its text; row by row, nothing is shuffled."""
    rows = f"SELECT doc_id, text, {d.top_counts('text')} AS tops FROM documents WHERE text IS NOT NULL"
    n = f"(SELECT {d.rows('sequence(2, 4)' if d.spark else 'range(2, 5)')} AS n)"
    limit = " ".join(f"WHEN {k} THEN {v}" for k, v in GRAM_LIMITS.items())
    top = "element_at(tops, CAST(n - 1 AS INT))" if d.spark else "tops[n - 1]"
    return f"WITH t AS ({rows}) SELECT doc_id, CAST(n AS BIGINT) AS n, {top} AS top, {top} * n > CASE n {limit} END * length(text) AS over FROM t CROSS JOIN {n} k"


@plan
def exact_dedup(d):
    norm = d.replace_all("lower(trim(text))", r"\s+", " ")
    return f"SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY md5({norm})"


@plan
def exact_dedup_by_source(d):
    norm = d.replace_all("lower(trim(text))", r"\s+", " ")
    return f"SELECT source, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY source, md5({norm})"


@plan
def word_shingles(d):
    return f"SELECT doc_id, {d.size('g')} AS n_shingles, {d.size(d.distinct('g'))} AS n_distinct FROM (SELECT doc_id, {d.grams('w', 5)} AS g FROM (SELECT doc_id, {d.words('text')} AS w FROM documents WHERE text IS NOT NULL) x) y"


@plan
def distinct_n_by_lang(d):
    return f"SELECT lang, count(*) AS total, count(DISTINCT g) AS distinct_grams, round(CAST(count(DISTINCT g) AS DOUBLE) / count(*), 6) AS distinct_2 FROM (SELECT lang, {d.rows(d.grams('w', 2))} AS g FROM (SELECT lang, {d.words('text')} AS w FROM documents)) GROUP BY lang"


@plan
def distinct_n_raw(d):
    """Distinct pairs among all pairs of words as they stand between white space, by source: beside the normalised words of distinct_n_by_lang."""
    pairs = f"CASE WHEN {d.size('w')} < 2 THEN {d.part('w', '1', 0) if d.spark else 'w[1:0]'} ELSE {d.each(d.upto(d.size('w') + ' - 1'), 'i', d.glue(d.part('w', 'i', 2)))} END"
    raw = d.find_all("text", r"\S+")
    return f"SELECT source, count(*) AS total, count(DISTINCT g) AS distinct_grams, round(CAST(count(DISTINCT g) AS DOUBLE) / count(*), 6) AS distinct_2 FROM (SELECT source, {d.rows(pairs)} AS g FROM (SELECT source, {raw} AS w FROM documents) x) y GROUP BY source"


PRODUCTION = (14, 8)  # bands and rows by which near copies are clustered and removed


def minhash(d: Dialect, bands: int = PRODUCTION[0], rows: int = PRODUCTION[1]) -> str:
    """Signatures of the different 5-word shingles: least values of (a x + b) mod 2**61 - 1 over 32-bit fingerprints x, with
    independent a and b; and a key for each band. No words count as one empty shingle."""
    fp = "CAST(conv(substr(md5(g), 1, 8), 16, 10) AS BIGINT)" if d.spark else "CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT)"
    pairs = zip(*(x.tolist() for x in coefficients()), strict=True)
    mins = "min_hashes(fp)" if d.spark else f"[{', '.join(f'CAST(list_min(list_transform(fp, lambda x: (CAST({a} AS HUGEINT) * x + {b}) % {PRIME})) AS BIGINT)' for a, b in list(pairs)[: bands * rows])}]"
    key = f"md5({d.glue_numbers(d.part('mins', f'CAST(b * {rows} + 1 AS INT)' if d.spark else f'b * {rows} + 1', rows) if d.spark else f'mins[b * {rows} + 1 : b * {rows} + {rows}]')})"
    return f"""sh AS (SELECT doc_id, {d.distinct(d.grams('w', 5))} AS gs FROM (SELECT doc_id, {d.words('text')} AS w FROM documents WHERE text IS NOT NULL) x0),
    f AS (SELECT doc_id, {d.each('gs', 'g', fp)} AS fp FROM sh), sig AS (SELECT doc_id, {mins} AS mins FROM f),
    keys AS (SELECT doc_id, CAST(b AS INT) AS band, {key} AS bk FROM (SELECT doc_id, mins, {d.rows(d.each(d.upto(str(bands)), 'i', 'i - 1'))} AS b FROM sig) x1)"""


@plan
def minhash_signatures(d):
    """All 112 values of a signature, joined."""
    return f"WITH {minhash(d)} SELECT doc_id, {d.glue_numbers('mins')} AS mins FROM sig"


@plan
def lsh_candidates(d):
    """The production setting: 14 bands of 8 rows, which meet at a similarity of about 0.72."""
    return f"WITH {minhash(d)} SELECT band, bk, count(*) AS n, min(doc_id) AS head FROM keys GROUP BY band, bk HAVING count(*) > 1"


@plan
def lsh_candidates_4x4(d):
    """A looser setting: 4 bands of 4 rows."""
    return f"WITH {minhash(d, 4, 4)} SELECT band, bk, count(*) AS n, min(doc_id) AS head FROM keys GROUP BY band, bk HAVING count(*) > 1"


@plan
def band_threshold(d):
    return "SELECT CAST(14 AS BIGINT) AS bands, CAST(8 AS BIGINT) AS band_rows, round(power(1e0 / 14, 1e0 / 8), 6) AS similarity"


def benchmark_items(d: Dialect, n: int, benchmark: str = "benchmark") -> str:
    """The words of all items; those shorter than n words, which texts must hold whole; their lengths."""
    split = "split({}, ' ')" if d.spark else "string_split({}, ' ')"
    return f"""iw AS (SELECT item_id, concat('b', CAST(item_id % 4 AS STRING)) AS benchmark, {split.format(d.normal('text'))} AS w, {d.normal('text')} AS t FROM {benchmark}),
    si AS (SELECT item_id, {d.size('w')} AS k, t, w FROM iw WHERE {d.size('w')} < {n} AND t <> ''), sk AS (SELECT DISTINCT k FROM si)"""


def contamination(d: Dialect, n: int, benchmark: str = "benchmark") -> str:
    """Distinct (document, item) with a common n-gram; shorter items count by containment, through grams of their own length.

    In Spark hashes of grams meet first, so that words leave their task only for documents that share one; these are
    compared by their grams. Only lengths that some short item has are cut from the documents. Texts are not normalised to
    NFKC: neither dialect has it. Documents without doc_id are left aside.
    """
    split = "split({}, ' ')" if d.spark else "string_split({}, ' ')"
    docs = f"SELECT doc_id, lang, source, {split.format(d.normal('text'))} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"
    doc_grams = f"SELECT doc_id, g FROM (SELECT doc_id, {d.rows(d.grams('w', n))} AS g FROM dw WHERE {d.size('w')} >= {n}) x"
    item_grams = f"SELECT item_id, g FROM (SELECT item_id, {d.rows(d.grams('w', n))} AS g FROM iw WHERE {d.size('w')} >= {n}) x"
    part = "slice(w, i, CAST(k AS INT))" if d.spark else "w[i:i + k - 1]"
    short_grams = f"SELECT doc_id, {d.rows(d.each(d.upto(d.size('w') + ' - k + 1'), 'i', d.glue(part)))} AS g FROM dw CROSS JOIN sk WHERE {d.size('w')} >= k"
    items = benchmark_items(d, n, benchmark)
    if d.spark:
        near = f"""dw0 AS ({docs}), ih AS (SELECT DISTINCT h FROM (SELECT explode({d.hash_grams('w', str(n))}) AS h FROM iw WHERE size(w) >= {n} UNION ALL SELECT xxhash64(w) AS h FROM si) x),
        dh AS (SELECT doc_id, explode(array_distinct({d.hash_grams('w', str(n))})) AS h FROM dw0 WHERE size(w) >= {n} UNION ALL SELECT doc_id, explode(array_distinct({d.hash_grams('w', 'k')})) AS h FROM dw0 CROSS JOIN sk WHERE size(w) >= k),
        nr0 AS (SELECT DISTINCT doc_id FROM dh LEFT SEMI JOIN ih ON dh.h = ih.h), dw AS (SELECT dw0.* FROM dw0 LEFT SEMI JOIN nr0 ON dw0.doc_id = nr0.doc_id)"""
    else:
        near = f"dw AS ({docs})"
    return f"""{items}, {near}, dg AS (SELECT DISTINCT doc_id, g FROM ({doc_grams}) y), ig AS (SELECT DISTINCT item_id, g FROM ({item_grams}) y), sd AS (SELECT DISTINCT doc_id, g FROM ({short_grams}) x),
    hits AS (SELECT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g UNION SELECT doc_id, item_id FROM sd JOIN si ON sd.g = si.t)"""


for _n in (8, 13):
    PLANS[f"contam_hits_{_n}gram"] = lambda d, n=_n: f"WITH {contamination(d, n)} SELECT doc_id, item_id FROM hits"


@plan
def contam_table(d):
    """Every source by every benchmark, zeros included: documents and items hit, and the shares of the source's documents and the benchmark's items."""
    return f"""WITH {contamination(d, 8)}, h AS (SELECT source, benchmark, count(DISTINCT hits.doc_id) AS n_docs, count(DISTINCT hits.item_id) AS n_items FROM hits JOIN dw ON hits.doc_id = dw.doc_id JOIN iw ON hits.item_id = iw.item_id GROUP BY source, benchmark),
    s AS (SELECT source, count(*) AS offered FROM documents GROUP BY source), b AS (SELECT concat('b', CAST(item_id % 4 AS STRING)) AS benchmark, count(*) AS items FROM benchmark GROUP BY 1)
    SELECT s.source, b.benchmark, coalesce(n_docs, 0) AS n_docs, coalesce(n_items, 0) AS n_items, round(CAST(coalesce(n_docs, 0) AS DOUBLE) / offered, 6) AS doc_rate, round(CAST(coalesce(n_items, 0) AS DOUBLE) / items, 6) AS item_rate
    FROM s CROSS JOIN b LEFT JOIN h ON h.source = s.source AND h.benchmark = b.benchmark"""


@plan
def contam_rates(d):
    """A source's documents, those flagged, their share, and a count for each benchmark that has any, as benchmark:count."""
    listed = "array_join(array_sort(collect_list(concat(benchmark, ':', CAST(n AS STRING)))), ',')" if d.spark else "string_agg(concat(benchmark, ':', CAST(n AS STRING)), ',' ORDER BY concat(benchmark, ':', CAST(n AS STRING)))"
    return f"""WITH {contamination(d, 8)}, p AS (SELECT source, benchmark, count(*) AS n FROM hits JOIN dw ON hits.doc_id = dw.doc_id JOIN iw ON hits.item_id = iw.item_id GROUP BY source, benchmark), b AS (SELECT source, {listed} AS by_benchmark FROM p GROUP BY source),
    o AS (SELECT source, count(*) AS offered, count(h.doc_id) AS flagged FROM documents x LEFT JOIN (SELECT DISTINCT doc_id FROM hits) h ON x.doc_id = h.doc_id GROUP BY source)
    SELECT o.source, offered, flagged, round(CAST(flagged AS DOUBLE) / offered, 6) AS rate, coalesce(by_benchmark, '') AS by_benchmark FROM o LEFT JOIN b ON o.source = b.source"""


def sentences(d: Dialect) -> str:
    """Sentences of all benchmark items, numbered within them."""
    parts = f"{'split' if d.spark else 'string_split_regex'}(text, {d.rx('[.!?]+')})"
    numbered = f"SELECT item_id, {d.rows(d.upto(d.size('s')))} AS i, s FROM (SELECT item_id, {parts} AS s FROM benchmark) b0"
    return f"(SELECT item_id * 1000 + i AS item_id, {'s[CAST(i AS INT) - 1]' if d.spark else 's[i]'} AS text FROM ({numbered}) b1) st"


@plan
def contam_short_items(d):
    """Sentences of all benchmark items as items: those of fewer than eight words, which documents must hold whole, and in how many they are."""
    return f"WITH {contamination(d, 8, sentences(d))} SELECT hits.item_id, count(*) AS n_docs FROM hits JOIN si ON hits.item_id = si.item_id GROUP BY hits.item_id"


@plan
def union_drop(d):
    """A prompt that any teacher's response contaminates is dropped for all."""
    return f"WITH {contamination(d, 8)}, bad AS (SELECT DISTINCT doc_id % 50 AS k FROM hits) SELECT doc_id FROM documents x WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.k = x.doc_id % 50)"


@plan
def clean_items(d):
    return f"WITH {contamination(d, 8)} SELECT b.item_id FROM benchmark b LEFT JOIN (SELECT DISTINCT item_id FROM hits) h ON b.item_id = h.item_id WHERE h.item_id IS NULL"


@plan
def benchmark_style_density(d):
    labels = d.distinct(d.each(d.find_all("text", r"(?m)^\s*\(?([A-Da-d])[).:]\s+\S", 1), "x", "upper(x)"))
    return f"SELECT source, count(*) AS n, round(avg(CASE WHEN {d.matches('text', '[?]')} AND {d.size(labels)} = 4 THEN 1e0 ELSE 0e0 END), 6) AS density FROM documents GROUP BY source"


@plan
def harvest_reject_reasons(d):
    pii = " OR ".join(d.matches("text", p) for p in (EMAIL, SSN, IPV4, CARD, PHONE))
    n = d.word_count("text")
    return f"""WITH r AS (SELECT CASE WHEN {n} < 8 OR {n} > 400 THEN 'length' WHEN {d.matches('text', MULTI_TURN)} THEN 'multi_turn' WHEN {d.matches('text', URL)} THEN 'url' WHEN {pii} THEN 'pii'
    WHEN {d.matches('text', CODE_REQUEST)} THEN 'code_request' WHEN {english_of(d, 'text')} < {LEAST_ENGLISH} THEN 'non_english' ELSE 'kept' END AS reason FROM documents) SELECT reason, count(*) AS n FROM r GROUP BY reason"""


@plan
def passage_references(d):
    return f"SELECT source, CAST(count_if({d.matches('text', PASSAGE_REF)}) AS BIGINT) AS n_refs, count(*) AS n FROM documents GROUP BY source"


@plan
def classify_prompts(d):
    n = d.word_count("text")
    return f"SELECT conv_id, turn, CASE WHEN {d.matches('trim(text)', '[?]$')} AND {n} <= 40 THEN 'SAQA' ELSE 'IF' END AS category FROM conversations WHERE role = 'user'"


@plan
def prompt_response_pairs(d):
    return """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response FROM conversations)
    SELECT conv_id, turn, text AS prompt, response FROM t WHERE role = 'user' AND next_role = 'assistant'"""


@plan
def render_examples(d):
    """Conversations as marked turns in order, with their token counts."""
    whole = "array_join(transform(array_sort(collect_list(struct(turn, concat('<|', role, '|>', coalesce(text, '')) AS s))), x -> x.s), '')" if d.spark else "string_agg(concat('<|', role, '|>', coalesce(text, '')), '' ORDER BY turn, concat('<|', role, '|>', coalesce(text, '')))"
    return f"WITH c AS (SELECT conv_id, count(*) AS turns, {whole} AS s FROM conversations GROUP BY conv_id) SELECT conv_id, turns, md5(s) AS rendered_md5, {d.approx_tokens('s')} + 2 AS tokens FROM c"


@plan
def page_text(d):
    """Visible text of pages: scripts, styles and tags dropped, white space collapsed."""
    bare = d.replace_all(d.replace_all("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return f"WITH t AS (SELECT page_id, trim({d.replace_all(bare, r'[\x09-\x0D ]+', ' ')}) AS t FROM pages) SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5, {d.size(d.find_all('t', r'\S+'))} AS n_words FROM t"


@plan
def category_shares(d):
    return f"WITH t AS (SELECT lang, CAST(sum({d.approx_tokens('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang) SELECT lang, tokens, round(CAST(tokens AS DOUBLE) / greatest(sum(tokens) OVER (), 1), 6) AS share FROM t"


@plan
def largest_remainder_quota(d):
    return """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT lang, 1000.0 * n / sum(n) OVER () AS exact FROM c),
    f AS (SELECT lang, CAST(floor(exact) AS BIGINT) AS base, exact - floor(exact) AS frac FROM s), r AS (SELECT *, row_number() OVER (ORDER BY round(frac, 9) DESC, lang) AS rk, 1000 - CAST(sum(base) OVER () AS BIGINT) AS rest FROM f)
    SELECT lang, base + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS quota FROM r"""


PRIORITY = "md5(concat('1:', lpad(CAST(doc_id AS STRING), 10, '0')))"


@plan
def equal_examples_subsample(d):
    return f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {PRIORITY}, doc_id) AS rk FROM documents) x WHERE rk <= 50"


def length_bins(d: Dialect) -> str:
    edges = (8, 12, 18, 27, 41, 61, 91, 136, 203, 304, 455, 682, 1024)
    return " + ".join(f"CASE WHEN n >= {e} THEN 1 ELSE 0 END" for e in edges)


@plan
def length_matched_subsample(d):
    """For each language and length bin the same number from every source: a share of what the poorest source has, 0.8 or as
    much as 60,000 words ask for, whichever is less."""
    n = d.word_count("text")
    return f"""WITH w AS (SELECT doc_id, lang, source, {n} AS n FROM documents), b AS (SELECT *, {length_bins(d)} AS bin FROM w), c AS (SELECT lang, bin, source, count(*) AS k, sum(n) AS words FROM b GROUP BY lang, bin, source),
    m AS (SELECT lang, bin, min(k) AS m, CAST(sum(words) AS DOUBLE) / sum(k) AS mean FROM c GROUP BY lang, bin HAVING count(*) = (SELECT count(DISTINCT source) FROM b)),
    f AS (SELECT least(0.8, 60000 / sum(m * mean)) AS f FROM m),
    r AS (SELECT b.doc_id, b.lang, b.source, b.bin, row_number() OVER (PARTITION BY b.lang, b.bin, b.source ORDER BY {PRIORITY.replace('doc_id', 'b.doc_id')}) AS rk, m FROM b JOIN m ON b.lang = m.lang AND b.bin = m.bin)
    SELECT doc_id, lang, source, bin FROM r CROSS JOIN f WHERE rk <= floor(f * m + 1e-9)"""


@plan
def budget_stop_shards(d):
    """Whole shards of a worker until a quarter more than its target is there; the last one is skipped once the target itself is."""
    return """WITH s AS (SELECT source AS worker, CAST(floor(doc_id / 100) AS BIGINT) AS shard, CAST(sum(length(text)) AS BIGINT) AS tokens FROM documents GROUP BY 1, 2),
    r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY worker ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(shard) OVER (PARTITION BY worker) AS last FROM s)
    SELECT worker, shard, tokens FROM r WHERE before < 1.25 * 40000 AND NOT (shard = last AND before >= 40000)"""


@plan
def entropy_by_source(d):
    return """WITH c AS (SELECT source, lang, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source, lang), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c)
    SELECT source, round(-sum(p * log2(p)), 6) AS bits, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0.0 END, 6) AS normalised FROM p GROUP BY source"""


@plan
def eos_split(d):
    """Turns as a stream in which an assistant's turn ends a document, itself included."""
    return """WITH s AS (SELECT conv_id, turn, text, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doc FROM conversations)
    SELECT conv_id, CAST(doc AS BIGINT) AS doc, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY 1, 2"""


@plan
def correctness_rate(d):
    return "SELECT source, count(quality) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS rate FROM documents x LEFT JOIN labels l ON x.doc_id = l.doc_id GROUP BY source"


@plan
def quality_index(d):
    """Mean of the z-scores (population deviation) of quality and, turned, toxicity, over the parts that are there."""
    return """WITH s AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS q, avg(CAST(toxic AS DOUBLE)) AS t FROM documents x LEFT JOIN labels l ON x.doc_id = l.doc_id GROUP BY source),
    z AS (SELECT source, (q - avg(q) OVER ()) / nullif(stddev_pop(q) OVER (), 0) AS zq, -(t - avg(t) OVER ()) / nullif(stddev_pop(t) OVER (), 0) AS zt FROM s)
    SELECT source, round((coalesce(zq, 0) + coalesce(zt, 0)) / nullif(CASE WHEN zq IS NULL THEN 0 ELSE 1 END + CASE WHEN zt IS NULL THEN 0 ELSE 1 END, 0), 6) AS q FROM z"""


@plan
def final_answers(d):
    """The answer behind a marker, kept characters only, without leading zeros; here the marker is the first equals sign."""
    kept = d.replace_all("a", "[^0-9A-Za-z.-]", "")
    return f"WITH a AS (SELECT doc_id, trim(regexp_extract(text, {d.rx('(?i)= *(.+)')}, 1)) AS a FROM documents) SELECT doc_id, CASE WHEN {d.replace_all(f'lower({kept})', '^0+', '')} = '' THEN '0' ELSE {d.replace_all(f'lower({kept})', '^0+', '')} END AS answer FROM a WHERE a <> ''"
