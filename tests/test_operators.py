import random

import numpy as np
from pyspark.sql import functions as F

from textloom.functions.dialect import DUCK, SPARK
from textloom.functions.udfs import register_named
from textloom.operators.graph import connected_components


def least_reachable(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = {}
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[start] = min(seen)
    return out


def test_components_equal_search(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    edges = [(u, v) for u, v in edges if u != v]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame([*edges, edges[0], (5, 5), (None, 3)], "u long, v long")).collect()}
    assert got == {u: v for u, v in least_reachable(edges).items() if u != v}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_grams_of_short_lists(spark):
    got = spark.sql(f"SELECT {SPARK.grams('w', 3)} AS g FROM VALUES (array('a','b')), (array('a','b','c','d')), (CAST(array() AS array<string>)) AS t(w)").collect()
    assert [x["g"] for x in got] == [["a b"], ["a b c", "b c d"], [""]]


def test_dialects_quote_apostrophes():
    assert SPARK.rx("i can't") == r"r'i can\x27t'" and DUCK.rx("x") == "'x'"


def test_twelve_rules_drop_in_their_order(spark):
    """Expectations worked out by hand from the rules: one text for each reason, and one that two rules would drop."""
    from textloom.plans import curation

    # 0 mod 4 short answers, 1 reasoning, 2 structures (json, table, list by the number mod 3), 3 prose; 0 mod 5 seeded.
    plain = "this is the plain text of a man who was here with all of them and then he went on to the end of it by way of what "
    varied = "it was the best of all the days that they had and so we went to see what the others did when they were here before, in a kind of house that nobody had known by the river"
    rows = [
        (3, "x" * 20000), (7, "too short"), (8, "No, but ask a doctor which books of his would say it"), (11, "Der Hund läuft über die Straße und bellt laut, während niemand hinsieht; " * 3),
        (15, f"{varied} 中文 中文"), (19, "the same line that is here of all\n" * 9), (23, "ab" * 90 + f" {plain}"), (27, varied), (31, f" {varied.upper()} "), (35, f"I cannot help with that, as it is not for me to do so. {plain}"),
        (39, f"As it was, Qwen is the one that was here. {plain}"), (55, f"As mentioned above, it was so. {plain}"), (43, f"As mentioned above, it was not so. {plain}"), (6, f"{plain} {{\"a\": 1"), (18, f"so it is {plain} [1, 2]"),
        (10, f"{plain}\n| a | b |\n|---|---|"), (22, f"{plain}\n| a | b |"), (14, f"1. {plain}"), (26, f"no list, {plain}"), (9, f"{plain} and so the end"), (13, f"{plain} and so the end. Final answer: 7"),
        (47, f"{plain} one benchmark item of eight words or so stands in here"),
    ]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").createOrReplaceTempView("documents")
    spark.createDataFrame([(1, "One benchmark item: of eight words or so!")], "item_id long, text string").createOrReplaceTempView("benchmark")
    text = curation.PLANS["drop_reasons"](SPARK)
    register_named(spark, text)
    got = {int(r["prompt_id"]): r["drop_reason"] for r in spark.sql(text).collect()}
    assert got == {
        3: "truncated", 7: "too_short", 8: None, 11: "non_english", 15: "cjk", 19: "degenerate", 23: "degenerate", 27: None, 31: "exact_dup", 35: "refusal", 39: "self_id", 55: "passage_ref", 43: None,
        6: "format_invalid", 18: None, 10: None, 22: "format_invalid", 14: None, 26: "format_invalid", 9: "missing_answer", 13: None, 47: "contaminated",
    }


def test_top_counts_equal_counters():
    from collections import Counter

    from textloom.functions.udfs import top_counts

    r = random.Random(2)
    for text in [None, "", "a", "ab", "aaaa", "é漢é漢é漢", "".join(map(chr, range(0x4E00, 0x4E00 + 300))) * 2, *("".join(r.choices("abc é", k=r.randrange(40))) for _ in range(50))]:
        t = text or ""
        assert top_counts(text) == [max(Counter(t[i : i + n] for i in range(len(t) - n + 1)).values(), default=0) for n in (2, 3, 4)]


def test_min_hashes_equal_whole_numbers():
    from textloom.functions import udfs

    r = random.Random(9)
    lists = [[r.randrange(1 << 32) for _ in range(r.randrange(1, 30))] for _ in range(40)] + [[0], [(1 << 32) - 1]]
    sizes = np.array([len(x) for x in lists])
    got = udfs.least_hashes(np.array(sum(lists, []), np.uint64), np.cumsum(sizes) - sizes)
    a, b = (x.tolist() for x in udfs.coefficients())
    assert got.tolist() == [[min((p * x + q) % udfs.PRIME for x in xs) for p, q in zip(a, b, strict=True)] for xs in lists]


def test_near_copies_at_the_threshold_are_found(spark, tmp_path):
    """Pairs of a known similarity of five-word shingles at and above 0.8: nine in ten meet under a band, and unlike ones don't."""
    from textloom.plans import curation

    r = random.Random(31)
    texts, pairs = [], []
    for k in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(100)]
        copy = list(words)
        for at in r.sample(range(5, 95), 2 if k % 3 else 1):
            copy[at] = f"x{k}{at}"
        grams = [{tuple(x[i : i + 5]) for i in range(96)} for x in (words, copy)]
        if len(grams[0] & grams[1]) / len(grams[0] | grams[1]) >= 0.8:
            pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(copy)]
    assert len(pairs) > 100
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").createOrReplaceTempView("documents")
    text = f"WITH {curation.minhash(SPARK)} SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM keys a JOIN keys b ON a.band = b.band AND a.bk = b.bk AND a.doc_id < b.doc_id"
    register_named(spark, text)
    found = {(x.a, x.b) for x in spark.sql(text).collect()}
    assert len(found & set(pairs)) / len(pairs) >= 0.9 and all(b == a + 1 and a % 2 == 0 for a, b in found)


def test_equal_tokens_pass_over_long_rows(spark):
    """Against the loop: in hash order, take what fits within the tolerance, go past what doesn't, stop at the quota."""
    from textloom.operators.subsample import equal_tokens

    r = random.Random(6)
    rows = [(i, r.choice("abc"), f"{r.randrange(10**6):06d}", r.choice([10, 40, 70, 500, 1500, 4000])) for i in range(400)] + [(900, "d", "0", 30000), (901, "d", "1", 5), (902, None, "2", 5)]
    for budget, tolerance in ((20000, 100), (60000, 1024), (0, 100), (10**7, 10)):
        whole, want = sum(t for _, c, _, t in rows if c), set()
        for c in "abcd":
            quota, acc = round(sum(t for _, x, _, t in rows if x == c) / whole * budget), 0
            for i, _, _, t in sorted((x for x in rows if x[1] == c), key=lambda x: (x[2], x[0])):
                if acc >= quota:
                    break
                if acc + t <= quota + tolerance:
                    want.add(i)
                    acc += t
        got = [x.id for x in equal_tokens(spark.createDataFrame(rows, "id long, cat string, pr string, t long"), budget, tolerance).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_greedy_choice_equals_loop(spark):
    from textloom.operators.greedy import first_without_shared

    r = random.Random(3)
    rows = [(i, f"k{r.randrange(150)}") for i in range(200) for _ in range(2)] + [(300 + i, f"c{i + j}") for i in range(30) for j in (0, 1)]
    used, want = set(), set()
    for i in sorted({i for i, _ in rows}):
        own = {k for j, k in rows if j == i}
        if not own & used:
            want.add(i)
            used |= own
    got = [x.id for x in first_without_shared(spark.createDataFrame([*rows, rows[0], (None, "k1")], "id long, key string")).collect()]
    assert sorted(got) == sorted(want)
    assert first_without_shared(spark.createDataFrame([], "id long, key string")).count() == 0


def test_isotonic_is_the_least_squares_fit(spark):
    """Against quadratic programming by brute force: means over blocks, of all ways to cut the cells, the best that grows."""
    from itertools import product

    from textloom.plans import analytics

    r = np.random.default_rng(1)
    y, n = np.round(r.normal(size=5) * 100, 2), r.integers(1, 6, 5)
    best = None
    for cuts in product((0, 1), repeat=4):
        block = np.concatenate([[0], np.cumsum(cuts)])
        mean = np.array([np.average(y[block == b], weights=n[block == b]) for b in range(block.max() + 1)])
        if (np.diff(mean) >= 0).all():
            loss = (n * (y - mean[block]) ** 2).sum()
            best = min(best or (np.inf, None), (loss, mean[block].tolist()))
    spark.createDataFrame([(k, 1, 1, f"{i + 1}-C", float(y[i])) for i in range(5) for k in range(n[i])], "o_orderkey long, o_custkey long, c int, o_orderpriority string, o_totalprice double").createOrReplaceTempView("orders")
    spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey long").createOrReplaceTempView("customer")
    spark.createDataFrame([(1, 1, "n")], "n_nationkey long, n_regionkey long, n_name string").createOrReplaceTempView("nation")
    got = [x.fitted for x in spark.sql(analytics.PLANS["isotonic"](SPARK)).orderBy("cond").collect()]
    assert np.allclose(got, best[1], atol=1e-3)


def test_t_quantiles_and_tails(spark):
    from textloom.operators.regressions import t_tail
    from textloom.plans.analytics import t_quantile, two_sided

    got = {x.df: (x.q, x.p) for x in spark.sql(f"SELECT CAST(df AS DOUBLE) AS df, {t_quantile(SPARK, 'CAST(df AS INT)')} AS q, {two_sided('2.5e0', 'CAST(df AS DOUBLE)')} AS p FROM VALUES (1), (2), (5), (10), (30), (60), (61), (90), (400) AS t(df)").collect()}
    for df, (q, p) in got.items():
        assert abs(t_tail(q, df) - 0.025) < 1e-9 and (df < 10 or abs(p - 2 * t_tail(2.5, df)) < 1e-4)


def test_nearest_equals_all_pairs(spark):
    from textloom.operators.nearest import nearest

    r = np.random.default_rng(3)
    x, y = np.round(r.normal(size=(40, 5)), 3), np.round(r.normal(size=(9, 5)), 3)
    frame = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(900, None), (901, [0.0] * 5)], "id long, x array<double>")
    got = {g.id: (g["item"], g.cosine) for g in nearest(frame(x), frame(np.concatenate([y, y]))).collect()}
    s = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert {i: v[0] for i, v in got.items()} == dict(enumerate(s.argmax(1).tolist())) and np.allclose([got[i][1] for i in range(40)], s.max(1), atol=1e-6)


def test_curves_keep_every_point(spark):
    from textloom.plans import analytics, studies

    q = np.random.default_rng(6).integers(1, 50, 130).astype(float)
    spark.createDataFrame([(0, i, 1, 1, float(v)) for i, v in enumerate(q)], "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").createOrReplaceTempView("lineitem")
    first = lambda plan: spark.sql(plan(SPARK)).first()
    d = q.cumsum()
    loss = 2 + 40 * d**-0.1
    slope, intercept = np.polyfit(np.log(d), loss, 1)
    got = first(analytics.PLANS["log_fit"])
    assert np.allclose([got.slope, got.intercept], [slope, intercept], atol=2e-6)
    assert first(analytics.PLANS["dose_response"]).n == 130
    s2 = ((loss - intercept - slope * np.log(d)) ** 2).sum() / 128
    assert np.isclose(first(studies.PLANS["residual_variance"]).s2, s2, atol=2e-9)


def test_clusters_meet_by_the_production_bands(spark, tmp_path):
    import hashlib

    from textloom.functions import udfs
    from textloom.operators import custom

    r = random.Random(8)
    texts = []
    for i in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(60)]
        copy = list(words)
        for at in r.sample(range(60), 1 + i % 5):
            copy[at] = f"x{i}"
        texts += [" ".join(words), " ".join(copy)]
    keys, (a, b) = {}, (x.tolist() for x in udfs.coefficients())
    for i, text in enumerate(texts):
        words = text.split()
        f = [int(hashlib.md5(" ".join(words[j : j + 5]).encode()).hexdigest()[:8], 16) for j in range(len(words) - 4)]
        m = [min((p * x + q) % udfs.PRIME for x in f) for p, q in zip(a, b, strict=True)]
        for k in range(14):
            keys.setdefault((k, *m[8 * k : 8 * k + 8]), []).append(i)
    want = least_reachable([(v[0], x) for v in keys.values() for x in v[1:]])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.cluster for x in custom.neardup_clusters(spark, str(tmp_path)).collect()} == {i: want.get(i, i) for i in range(60)}


def test_resamples_are_as_many_as_the_study_asks(spark):
    import hashlib
    import inspect

    from textloom.operators import custom
    from textloom.plans import analytics, formats, studies

    texts = {i: "ab " * (1 + i % 9) + "c" * (i % 23) for i in range(40)}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").createOrReplaceTempView("documents")
    values = []
    for i in range(1000):
        kept = [t for k, t in texts.items() if hashlib.md5(f"{k}|{i // 32}".encode()).hexdigest()[i % 32] < "8"]
        values.append(sum(map(len, kept)) / sum(len(t.split()) for t in kept))
    assert np.isclose(spark.sql(formats.PLANS["document_bootstrap"](SPARK)).first().se, np.std(values, ddof=1), atol=2e-6)
    spark.createDataFrame([(i, 1, i % 4, 1.0, float(i * 7 % 31)) for i in range(60)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double").createOrReplaceTempView("lineitem")
    spark.createDataFrame([(i, i, 1.0) for i in range(4)], "p_partkey long, p_size int, p_retailprice double").createOrReplaceTempView("part")
    assert sum(x.wins for x in spark.sql(studies.PLANS["selection_shares"](SPARK)).collect()) == 5000
    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert default(custom.bootstrap_ci, "boots") == 2000 and default(analytics.isotonic_permutation, "permutations") == 2000


def test_short_sentences_are_looked_up_without_a_row_a_gram(spark, tmp_path):
    import duckdb

    from textloom.operators import custom, phrases
    from textloom.plans import curation

    words = [chr(97 + i) for i in range(6)]
    r = random.Random(4)
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(40))) for _ in range(60)] + [None, "", ". a", "a"]
    docs = [(i // 2 if i < 6 else i, t) for i, t in enumerate(texts)] + [(None, "a b c")]  # some share a number, one has none
    long = "b a b c d e f a c"  # sentence 1001 of item 0, short, has the number of the first one of item 1, which is long
    items = [(0, "." .join(["a b", "c d e", "A! a"] + ["f"] * 996 + ["e f", "a c f"])), (1, f"{long}. b c? e. e"), (1, f"{long}. b c"), (3, None), (None, "a b"), (5, "zz. zz a")]
    docs.append((70, f"f {long} d"))
    spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = custom.contam_short_items(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(curation.PLANS["contam_short_items"](DUCK)).fetchall())
    assert sorted(tuple(x) for x in df.collect()) == want and dict(want)[1001] > 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    tree = phrases.Tree(["a", "a b", "b c d"])
    assert [x.tolist() for x in tree.find(["a b c", "d", "", "b c d a"])] == [[0, 3, 0, 3], [0, 0, 1, 2]]
    assert [len(x) for x in phrases.Tree([]).find(["a b"])] == [0, 0]


def test_short_items_are_hit_whole(spark):
    import duckdb

    from textloom.plans import curation

    docs = [(1, "so Paris, is it the capital"), (2, "parish is it"), (3, "is it"), (4, "one two three four five six seven eight nine"), (5, ""), (6, None)]
    items = [(10, "Paris is it"), (11, "is it?"), (12, "two three four five six seven eight nine"), (13, ""), (14, "nine"), (15, None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string").createOrReplaceTempView("documents")
    spark.createDataFrame(items, "item_id long, text string").createOrReplaceTempView("benchmark")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 's')", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    plan = curation.PLANS["contam_hits_8gram"]
    want = [(1, 10), (1, 11), (2, 11), (3, 11), (4, 12), (4, 14)]
    assert sorted(tuple(r) for r in spark.sql(plan(SPARK)).collect()) == want
    assert sorted(con.execute(plan(DUCK)).fetchall()) == want
