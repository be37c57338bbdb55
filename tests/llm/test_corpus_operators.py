import hashlib
import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash, substrings, topk, warc


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(x) for x in zip(w, w[1:], w[2:], strict=False)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = sorted(root)
    for i, x in enumerate(a):
        for y in a[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                u, v = find(x), find(y)
                root[max(u, v)] = min(u, v)
    return {f: find(f) for f in root}


def near_texts(seed=1):
    r = random.Random(seed)
    base = [[r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.randrange(3, 400))] for _ in range(25)]
    out = []
    for w in base:
        for _ in range(r.randrange(1, 6)):
            v = list(w)
            if r.random() < 0.7:
                v[r.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    return [*out, None, "", " \n", "One two", "one  TWO", "x"]


def test_simhash_equals_brute_force(spark, docs):
    rows = list(enumerate(near_texts())) + [(3, near_texts()[3]), (None, "x")]
    fp = {t: plain_fingerprint(t) for _, t in rows}
    root = classes(set(fp.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fp[t]]] = min(i, least.get(root[fp[t]], i))
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in simhash.components(docs(rows, clash=True)).collect()), key=str)
    assert got == sorted(((i, f"{fp[t]:016x}", least[root[fp[t]]]) for i, t in rows), key=str)
    assert simhash.components(docs([])).count() == 0


@pytest.mark.parametrize("bucket", [4096, 16])
def test_links_lose_nothing_however_large_a_key(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(7)
    centre = r.getrandbits(64)

    def flipped(x, n):
        for b in r.sample(range(64), n):
            x ^= 1 << b
        return x

    fps = {flipped(centre, r.randrange(6)) for _ in range(400)} | {r.getrandbits(64) for _ in range(200)} | {0, 1, 2**64 - 1}
    fps |= {flipped(x, r.randrange(1, 5)) for x in list(fps)[:200]}
    from textloom.operators.graph import connected_components

    edges = simhash.links(spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long"))
    got = {x["node"] % 2**64: x["root"] % 2**64 for x in connected_components(edges, "a", "b").collect()}
    want = classes(fps)
    assert len({frozenset(f for f in fps if want[f] == w) for w in want.values()} ^ {frozenset(f for f in fps if got.get(f, f) == g) for g in {got.get(f, f) for f in fps}}) == 0


def test_keep_first(spark, docs):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "something else that is not alike at all"), (None, "a b c d e f g")]
    got = simhash.keep_first(docs(rows))
    assert sorted((x.doc_id for x in got.collect()), key=str) == [2, 9, None] and got.columns == docs([]).columns
    # Where rows share a doc_id but not their text, each group still keeps one; rows equal in both stay once.
    far = ["one kind of text with words of its own and no others", "quite another thing that was written by somebody else"]
    rows = [(1, far[0]), (1, far[1]), (1, far[1]), (2, far[0]), (3, far[1]), (4, f"{far[0]} ")]
    got = simhash.keep_first(docs(rows, clash=True))
    assert sorted((x.doc_id, x.text) for x in got.collect()) == sorted([(1, far[0]), (1, far[1])])
    assert simhash.keep_first(docs([], clash=True)).count() == 0


def plain_removal(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12 if i is not None else 0):
            g = tuple(w[k : k + 13])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    r = random.Random(3)
    shared = [" ".join(r.choices("abcdefghijkl", k=r.randrange(10, 60))) for _ in range(6)]
    rows = [(i, " ".join(r.choice(shared) if r.random() < 0.5 else " ".join(r.choices("mnopqrstuvwxyz", k=20)) for _ in range(5))) for i in range(60)]
    long = "z" * 5000 + " " + " ".join(map(str, range(12)))
    return [*rows, (60, None), (61, ""), (62, rows[4][1]), (62, rows[5][1]), (62, rows[5][1]), (None, rows[4][1]), (63, shared[0].replace(" ", "\n\t ")), (64, long), (65, long), (66, "é " * 40), (67, "é " * 40)]


@pytest.mark.parametrize(("bits", "flush"), [(16, 4_000_000), (5, 50)])
def test_substring_dedup_equals_brute_force(spark, docs, monkeypatch, bits, flush):
    """Also where the sketch is so full that nearly all windows are doubtful, and tasks send off many parts."""
    monkeypatch.setattr(substrings, "LEAST_BITS", bits)
    monkeypatch.setattr(substrings, "MOST_BITS", bits)
    monkeypatch.setattr(substrings, "FLUSH", flush)
    got = substrings.dedup_digest(docs(passages(), clash=True)).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(passages())
    assert substrings.dedup_digest(docs([])).count() == 0


def test_texts_without_repeats(spark, docs):
    passage = " ".join(f"w{i}" for i in range(20))
    got = {x.doc_id: (x.text, x.n_chars) for x in substrings.without_repeats(docs([(1, passage), (2, f"before\n{passage} after"), (3, "kept  as\nit is"), (4, None)])).collect()}
    assert got == {1: (passage, len(passage)), 2: ("before after", 12), 3: ("kept  as\nit is", 14), 4: (None, None)}


def plain_top(rows, k=5):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    scaled = [(i, v, [floor(256 * Fraction(x)) for x in v]) for i, v in ok]
    out = []
    for i, raw, q in scaled:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, r, v in scaled if (j, r) != (i, raw))[:k]
            out += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_top_k_of_any_finite_size_and_repeated_ids(spark, kind):
    """Components up to the largest a double holds, sums beyond 64 bits on both sides, queries that share an id."""
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.gauss(0, 1) * s)) for _ in range(4)]) for i, s in enumerate((1, 1, 1e8, 1, 1e16, 1e9, 3e38, 1, 30000.0, 32768.0) * 12)]
    rows += [(50, [1e9, 1e9]), (50, [0.5, 0.25]), (50, [-1e9, -1e9, 0.0, 0.0]), (50, [0.5, 0.25]), (3, [1e9, 1e9]), (100, [2.0, -0.0]), (100, [2.0, 0.0, 0.0])]
    rows += [(150, [1.7e308, -1.7e308, 1e300])] if kind == "array<double>" else []
    rows = [(i, [float(np.float32(x)) if kind == "array<float>" else x for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    assert sorted(map(tuple, topk.top_k(df).collect())) == plain_top(rows)


def test_top_k_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.gauss(0, 0.2))) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(7, rows[7][1]), (400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (600, [0.5, -0.25]), (None, rows[3][1]), (650, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    assert sorted(map(tuple, topk.top_k(df).collect())) == plain_top(rows)
    assert topk.top_k(df.where("vec_id < 0")).count() == 0
    assert sorted(map(tuple, topk.top_k(df.where("vec_id IN (0, 1, 2)")).collect())) == plain_top(rows[:3])


def test_top_k_index_stops_early_and_is_right():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(3000, 32)) * 40).astype(np.int64)
    block = topk.Block(np.arange(3000), x)
    for i in range(0, 3000, 300):
        s = x @ x[i]
        s[i] = -(1 << 40)
        assert block.best(x[i], [i], 5).tolist() == np.lexsort((np.arange(3000), -s))[:5].tolist()


PAGES = "page_id long, url string, html string, digest string, key string"


def test_warc_round_trip(spark):
    same, short = "<p>" + "é" * 80, "<p>short"
    rows = [(i, f"http://www.Host{i % 3}.com:80/a?b={i}", same if i % 2 else f"<p>{i}" * 40) for i in range(40)]
    rows += [(50, "http://x.org/", short), (51, "http://x.org/", short), (52, None, None), (53, "bad\nurl [", ""), (1, "http://www.Host1.com:80/a?b=1", same), (None, "http://x.org/n", same), (60, "http://x.org/long", "z" * 3_000_000)]
    df = spark.createDataFrame([(*x, "d", "k") for x in rows], PAGES)
    got = sorted(map(str, (tuple(x[:5]) for x in warc.archive_and_read(df).collect())))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min(j for j, _, g in rows if j is not None and g == h) if len(b) >= 100 else i
        revisit = len(b) >= 100 and first != i
        want.append(str((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None)))
    assert got == sorted(want)
    assert warc.archive_and_read(df.where("page_id < 0")).count() == 0


def test_index_finds_every_capture_over_many_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [("com,a)/", 1, "f", k, 1) for k in range(30)] + [(f"com,b)/{i}", i, "f", 100 + i, 1) for i in range(100)] + [("com,b)/5", None, "g", 0, 1)]
    df = spark.createDataFrame(rows, warc.CAPTURES)
    uri = f"file://{tmp_path}/index"
    table = tuple(tuple(x) for x in warc.write_index(df, uri, 4).select("name", "key", "page_id", "size").collect())
    assert len(table) > 1
    assert sorted(warc.lookup(uri, table, "com,a)/", 1)) == [("f", k, 1) for k in range(30)]
    for i in range(100):
        assert warc.lookup(uri, table, f"com,b)/{i}", i) == [("f", 100 + i, 1)]
    assert warc.lookup(uri, table, "com,b)/5", None) == [("g", 0, 1)] and warc.lookup(uri, table, "com,zz)/", 1) == []


def test_url_keys():
    assert warc.url_key("https://User@www.Example.com:443/Path?q=1") == "com,example,www)/Path?q=1"
    assert warc.url_key(None) == ")/" and warc.url_key("http://a.b:8080") == "b,a:8080)/"
