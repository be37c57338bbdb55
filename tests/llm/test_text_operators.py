import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from textloom.llm import bpe, langid, packing, quality, queries, secrets, toxicity

ODD = [None, "", " ", "\n", "a", "It's we'll 'sx ''d  \n\t x", "é漢字²  ١٢", "  lead and trail  ", "a" * 3000, "word " * 5000, "\x1c\x85 b", "-" * 500]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(3, "\n"), (None, "no id"), (4, "a")]


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_bpe_equals_library_and_round_trips(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs(ROWS, clash=True), path).collect()
    want = [(i, len(e := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    pieces = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "1", "!", "é", "漢", "'ve"]
    r = random.Random(3)
    texts = ["".join(r.choices(pieces, k=r.randrange(25))) for _ in range(3000)]
    c = bpe.Codec(path)
    for t, e in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(e.ids, "<u4").tolist() == library.encode_ordinary(t) and c.decode(e.ids, e.bytes_before, e.ids_before) == t.encode()
        assert [t[x:y] for x, y in zip(e.starts.tolist(), [*e.starts.tolist()[1:], len(t)], strict=False)] == regex.findall(public_tokenizers.PATTERN, t)
        a, b = sorted((r.randrange(len(t) + 2), r.randrange(len(t) + 2)))
        assert c.decode_span(e, a, b) == t[a:b]
    moved = c.encode(["two words here"])[0]
    with pytest.raises(ValueError):
        c.decode(moved.ids, moved.bytes_before + np.arange(len(moved.bytes_before)), moved.ids_before)
    assert bpe.encode(docs([]), path).count() == 0


def base_quality(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_equals_plain_counts(spark, docs):
    r = random.Random(2)
    more = [(100 + i, " ".join(r.choices("ab c# d e\n the".split(" "), k=r.randrange(60)))) for i in range(60)]
    got = quality.quality_rules(docs(ROWS + more, clash=True)).collect()
    want = [(i, *base_quality(t)) for i, t in ROWS + more]
    assert sorted((tuple(x[:6]) for x in got), key=key) == sorted(want, key=key)
    for x in got:
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and not (x.base_failed and x.kept)
    clean = "the quick brown fox jumps over a lazy dog and then it runs to the forest of old trees"
    assert [x.kept for x in quality.quality_rules(docs([(1, clean), (2, "# $ % & | < > " * 20), (3, "")])).orderBy("doc_id").collect()] == [True, False, False]
    plan = quality.quality_rules(docs(ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality.quality_rules(docs([])).count() == 0


def plain_secrets(t):
    t, out = t or "", []
    rule = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(rule, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_equal_plain_rules(spark, docs):
    r = random.Random(5)
    bits = ["password", "PassWd", " = ", ":", '"', "'", "token", "api_key", "APIKEY", "abc", "secret=", "AKIA" + "Q1" * 8, "AKIA", "0f" * 12, "0f" * 11, " ", "é", "ſecret=abcdefgh", "x9-_/+=", "\n"]
    rows = ROWS + [(100 + i, "".join(r.choices(bits, k=12))) for i in range(300)]
    models = secrets.train(["plain words of a text with ordinary names"])
    got = secrets.find_secrets(docs(rows, clash=True), models).collect()
    want = []
    for i, t in rows:
        base = plain_secrets(t)
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()))
    assert sorted((tuple(x[:5]) for x in got), key=key) == sorted(want, key=key)
    for x in got:
        assert len(x.spans.split(",")) >= x.n_assign + x.n_access + x.n_hex or not x.spans
    assert secrets.find_secrets(docs([])).count() == 0


def test_markov_models_tell_random_strings():
    texts = ["the ordinary words of some documents that nobody would call secret at all"] * 3
    models, rng = secrets.train(texts), random.Random(8)
    text = "x ghp_" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=36)) + " and some_ordinary_identifier_name_2 too"
    spans = secrets.all_spans(text, models)[1]
    assert [text[a:b].startswith("ghp_") for a, _, b in spans] == [True]


def test_threshold_on_strings_of_neither_sample(spark):
    """Identifiers of installed packages against fresh random strings of kinds that the rules don't know."""
    import glob
    import os

    import pandas
    import pyspark

    models = secrets.train(["the ordinary words of some documents that nobody would call secret at all"] * 3)
    names = set()
    for package in (pandas, pyspark):
        for f in glob.glob(os.path.dirname(package.__file__) + "/**/*.py", recursive=True):
            if "pb2" not in f:  # those hold serialised bytes
                names.update(m[0] for m in secrets.CANDIDATE.finditer(open(f, encoding="utf-8").read()) if secrets.mixed(m[0]) and not secrets.HEX.search(m[0]))
    names = {x for x in names if not re.search("[0-9a-f]{8}-[0-9a-f]{4}-|=$|^[0-9A-F]+$", x)}  # random by nature, and serialised
    assert len(names) > 800
    alarms = sorted(x for x in names if models.secret(x))
    rng = random.Random(41)
    tails = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36)) for _ in range(600)]
    unlisted = [kind + x[: 40 - len(kind)] for kind, x in zip(("ghp_", "sk-proj-", "xoxb-", "glpat-", "hf_", "") * 100, tails, strict=True)]
    found = [x for x in unlisted if models.secret(x)]
    assert len(alarms) / len(names) < 0.01 and len(found) / len(unlisted) > 0.9, (len(alarms) / len(names), len(found) / len(unlisted), alarms[:20])


def test_models_add_spans_that_rules_miss(spark, docs):
    rng = random.Random(17)
    fresh = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36))
    rows = [(i, f"the deploy used {kind}{fresh()} until the new release_candidate_2_was_ready came") for i, kind in enumerate(("ghp_", "sk-live-", "xoxb-", "glpat-", "hf_"))]
    rows += [(9, "see docs/2024/guide-to-version-2/index for the model_config_v2_parameters and 2024-01-31-release-notes")]
    got = {x.doc_id: x.spans for x in secrets.find_secrets(docs(rows, clash=True)).collect()}
    for i, t in rows[:-1]:
        a = t.index("used ") + 5
        assert got[i] == f"markov:{a}:{t.index(' until')}"
    assert got[9] == ""


def test_redaction_keeps_rows_and_columns(spark, docs):
    rows = [(1, "key password=abcdef12 end"), (2, None), (3, ""), (3, ""), (4, "plain")]
    got = sorted(map(tuple, secrets.redact(docs(rows)).collect()))
    assert got[0] == (1, "key [secret] end", "en", "s", 16) and got[1][1] is None and len(got) == 5


def test_packing_equals_library(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "Ab", "c", "É", "ß", ".", ", ", " ", "\n", "'s", "!?", "1", "漢", "́", "İ", "\x1c", " ", "word"]
    rows = ROWS + [(100 + i, "".join(r.choices(bits[4 * (i % 2) :], k=20))) for i in range(300)] + [(500, "a <|endoftext|> b")]
    got = packing.pack(docs(rows, clash=True), path).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID])
    back = {}
    for x in sorted(got, key=lambda x: x.sequence_id & ((1 << packing.NUMBER_BITS) - 1)):
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert len(ids) == x.length and x.offset == 0 and x.length <= 4096 and x.length & (x.length - 1) == 0
        back.setdefault(x.doc_id, []).append((x.start, ids, x.doc_tokens))
    assert len({x.sequence_id for x in got}) == len(got) and back.keys() == want.keys()
    assert [x.length for x in sorted(got, key=lambda x: x.sequence_id)] == sorted(x.length for x in got)  # buckets are ranges
    for i, parts in back.items():
        joined, now = [], []
        for start, ids, n in parts:
            assert start == len(now)
            now += ids
            if len(now) == n:
                joined.append(now)
                now = []
        assert sorted(joined) == sorted(want[i]) and not now
    digest = packing.packed_digest(docs([(1, "a b")]), path).first()
    assert digest.ids_crc32 == zlib.crc32(np.array([*tok.encode("a b", add_special_tokens=False).ids, 2][: digest.length], "<u4").tobytes())
    assert packing.pack(docs([]), path).count() == 0


def test_buckets_hold_equal_lengths(spark, docs, tmp_path):
    packed = packing.pack(docs([(i, "word " * i) for i in range(40)] + [(90, "long " * 9000)], clash=True), public_tokenizers.path("word_bpe_49k.json"))
    found = packing.write_buckets(packed, f"file://{tmp_path}/buckets").collect()
    assert all(x.length == 1 << x.bucket for x in found) and sum(x.n_sequences for x in found) == packed.count()
    for x in found:
        part = spark.read.parquet(f"file://{tmp_path}/buckets/bucket={x.bucket}").collect()
        assert len(part) == x.n_sequences and {len(y.ids) for y in part} == {4 * x.length}


LANGS = {"en": "the house and the garden were there when they came with others", "fr": "la maison et le jardin étaient là quand ils sont venus avec les autres", "de": "das haus und der garten waren dort als sie mit den anderen kamen"}


def corpus(n=90):
    r = random.Random(9)
    return [(" ".join(r.choices(LANGS[v].split(), k=25)), v) for v in sorted(LANGS) for _ in range(n)]


def test_language_models(spark, docs):
    model = langid.train(corpus())
    assert model.predict([LANGS["fr"], LANGS["de"], None, "", "123 !?", LANGS["en"] * 3000])[0] == ["fr", "de", "und", "und", "und", "en"]
    lang, score, rejected, _ = model.predict(["der garten", None])
    assert lang == ["de", "und"] and 0 <= score[0] <= 1 and score[1] == 0 and rejected[1]
    for order in range(1, langid.ORDER + 1):  # probabilities after a context add up to one
        k = langid.KneserNey(model.table[langid.letters([t for t, v in corpus() if v == "en"])[0]])
        context = int(k.levels[order][3][-1])
        assert np.isclose(k.p((context << langid.BITS) + np.arange(1 << langid.BITS), order).sum(), 1)
    assert langid.train([]).predict(["x"])[0] == ["und"]
    got = langid.identify(docs([(1, LANGS["en"]), (1, LANGS["en"]), (2, None), (None, "")], clash=True), model).collect()
    assert sorted(x.lang_pred for x in got) == ["en", "en", "und", "und"]
    assert langid.identify(docs([]), model).count() == 0


def test_language_query_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.97 and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)


def test_toxicity_gradients():
    rows = [("you are a grim toad indeed", 1), ("a calm day by the sea and more", 0)] * 6
    words_ = toxicity.words_of([t for t, _ in rows])
    net = toxicity.Network.fresh(np.unique(words_.word), np.unique(words_.grams))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words_ = words_.numbered(net.word_keys, net.gram_keys)
    start, size = toxicity.windows_of(words_.owner)
    at, mask = toxicity.places(start, size, len(words_.owner))
    label = np.array([v for _, v in rows], float)
    g = net.gradients(words_, at, mask, label)

    def loss():
        z = net.run(net.project(net.inputs(words_)), at, mask).astype(float)
        return np.mean(np.log1p(np.exp(z)) - label * z)

    for k in ("xf", "xb", "hf", "hb", "cf", "att", "att_v", "out", "bias"):
        flat, i = net.p[k].reshape(-1), net.p[k].size // 2
        old = flat[i]
        flat[i] = old + 1e-2
        up = loss()
        flat[i] = old - 1e-2
        down = loss()
        flat[i] = old
        assert np.isclose((up - down) / 2e-2, np.asarray(g[k]).reshape(-1)[i], rtol=0.05, atol=2e-5), k


def test_toxicity_windows_cover_texts():
    w = toxicity.words_of([" ".join(f"w{i}" for i in range(57)), "", "one"])
    start, size = toxicity.windows_of(w.owner)
    assert {i for s, n in zip(start, size, strict=True) for i in range(s, s + n)} == set(range(58)) and size.max() == toxicity.WINDOW


def test_toxicity_query_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.QUERIES["op1_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    good = [x.score for x in got if x.toxic == 0]
    assert np.mean([np.mean([x.score > g for g in good]) for x in got if x.toxic == 1]) > 0.94
    assert np.mean([x.predicted for x in got if x.toxic == 1]) > 0.85 and np.mean([x.predicted for x in got if x.toxic == 0]) < 0.02
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)


def test_network_equals_a_plain_loop():
    """One window, word by word and unit by unit, both directions and the attention."""
    from math import exp, tanh

    text = "you are a grim toad, indeed a toad"
    net = toxicity.train([("grim toad fool you", 1), ("calm sea day you are", 0)] * 40)
    words_ = toxicity.words_of([text])
    n, h = len(words_.owner), toxicity.HIDDEN
    known = words_.numbered(net.word_keys, net.gram_keys)
    spans = [*words_.gram_starts.tolist(), len(words_.grams)]
    x = [[float(v) for v in net.p["words"][known.word[i]]] + [float(sum(net.p["grams"][g][j] for g in known.grams[spans[i] : spans[i + 1]])) for j in range(toxicity.EMBED)] for i in range(n)]
    gate = lambda v: 1 / (1 + exp(-v))
    states = [[0.0] * (2 * h) for _ in range(n)]
    for d, order, shift in (("f", range(n), 0), ("b", range(n - 1, -1, -1), h)):
        now = [0.0] * h
        for i in order:
            a = [float(net.p[f"c{d}"][j]) + sum(x[i][k] * float(net.p[f"x{d}"][k, j]) for k in range(2 * toxicity.EMBED)) for j in range(3 * h)]
            b = [sum(now[k] * float(net.p[f"h{d}"][k, j]) for k in range(h)) for j in range(3 * h)]
            z, r_ = [gate(a[j] + b[j]) for j in range(h)], [gate(a[h + j] + b[h + j]) for j in range(h)]
            c = [tanh(a[2 * h + j] + r_[j] * b[2 * h + j]) for j in range(h)]
            now = [now[j] + z[j] * (c[j] - now[j]) for j in range(h)]
            states[i][shift : shift + h] = now
    e = [sum(tanh(sum(s[k] * float(net.p["att"][k, j]) for k in range(2 * h))) * float(net.p["att_v"][j]) for j in range(2 * h)) for s in states]
    weight = [exp(v - max(e)) for v in e]
    logit = float(net.p["bias"][0]) + sum(w / sum(weight) * sum(s[j] * float(net.p["out"][j]) for j in range(2 * h)) for w, s in zip(weight, states, strict=True))
    assert np.isclose(net.window_logits(known)[1][0], logit, atol=1e-3) and np.isclose(net.scores([text])[0], gate(net.slope * logit + net.shift), atol=1e-3)


def test_kneser_ney_equals_dictionaries():
    """Probabilities from counts of tuples in dictionaries, order by order, against the sorted arrays."""
    from collections import defaultdict

    texts = [t for i, t in enumerate(t for t, v in corpus(30) if v == "fr") if i % 5 != 4]  # the others calibrate
    model = langid.train([(t, v) for t, v in corpus(30)])
    symbols = model.table[langid.letters(texts)[0]].tolist()
    order = langid.ORDER
    k = langid.KneserNey(np.array(symbols, np.uint8))
    padded = [0] * (order - 2) + symbols
    level = defaultdict(int)
    for i in range(len(symbols) - 1):
        level[tuple(padded[i : i + order])] += 1
    levels = {order: dict(level)}
    for o in range(order - 1, 0, -1):
        left = defaultdict(set)
        for g in levels[o + 1]:
            left[g[1:]].add(g[0])
        levels[o] = {g: len(s) for g, s in left.items()}

    def p(gram):
        if not gram:
            return 1 / (1 << langid.BITS)
        counts = levels[len(gram)]
        ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return (max(counts.get(gram, 0) - d, 0) + d * len(same) * p(gram[1:])) / sum(same)

    r = random.Random(3)
    grams = [tuple(padded[i : i + order]) for i in r.sample(range(len(symbols) - 1), 60)] + [tuple(r.choices(range(1, 30), k=order)) for _ in range(60)]
    keys = np.array([sum(s << langid.BITS * (order - 1 - j) for j, s in enumerate(g)) for g in grams])
    assert np.allclose(k.p(keys, order), [p(g) for g in grams])
    assert np.allclose(model.lookup(keys.astype(np.int32), order)[:, model.languages.index("fr")], np.log([p(g) for g in grams]), atol=1e-4)


def test_predictions_of_empty_and_clashing_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 1, "x"), (2, 0, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, score string")
    rows = [(1, "calm sea"), (2, "grim toad"), (2, "grim toad"), (3, None), (None, "x")]
    assert toxicity.predictions(docs([], clash=True), labels).count() == 0 and toxicity.predictions(docs(rows), labels.where("doc_id = 9")).where("score <> 0").count() == 0
    got = toxicity.predictions(docs(rows, clash=True), labels).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "2", "2", "3", "None"] and all(x.predicted == (x.score >= 0.5) for x in got)
    assert langid.predictions(docs([], clash=True)).count() == 0
    got = langid.predictions(docs(rows, clash=True)).collect()
    assert sorted(x.lang_pred for x in got) == ["en", "en", "en", "en", "und"] and not [x for x in got if x.doc_id is None and x.held_out]


def test_dirty_labels_are_bounded(spark):
    """A label column of many different values: the most frequent ones are learned, the same on every run."""
    from textloom.llm import common

    df = spark.createDataFrame([(i, "text here", "en" if i % 2 else f"v{i}") for i in range(1000)], "doc_id long, text string, lang string")
    got = common.labelled_sample(df, "lang", 5)
    assert len({v for _, v in got}) <= common.MOST_VALUES and ("text here", "en") in got and got == common.labelled_sample(df, "lang", 5)


def test_toxicity_edges(spark, docs):
    net = toxicity.train([("grim toad fool", 1), ("calm sea day", 0)] * 40)
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs([(1, None), (2, ""), (3, "!!"), (4, "toad " * 20000), (5, "grim toad fool"), (6, "calm sea day")], clash=True), net).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[5] > 0.5 > got[6]
    assert toxicity.train([]).scores(["x"]).tolist() == [0.0] and toxicity.train([("a", 1)]).scores(["x"]).tolist() == [0.0]
    assert toxicity.toxicity(docs([]), net).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, tmp_path, name):
    import duckdb

    sf, out = "/root/testdata/sf0.01", str(tmp_path / "out")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries.QUERIES[name](spark, sf).write.parquet(out)
    con.execute(f"CREATE TABLE o AS {queries.ORACLE_SQL[name]}")
    columns = ", ".join(sorted(r[0] for r in con.execute("DESCRIBE o").fetchall()))
    mine = f"SELECT {columns} FROM '{out}/*.parquet'"
    assert con.execute(f"SELECT {columns} FROM o EXCEPT ALL {mine}").fetchall() == []
    assert con.execute(f"{mine} EXCEPT ALL SELECT {columns} FROM o").fetchall() == []
