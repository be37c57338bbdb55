import hashlib
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from textloom.llm import langid, secrets
from textloom.llm.common import written

from test_corpus_operators import classes, plain_fingerprint, plain_removal

STAGES = [name for name, _ in corpus_pipeline.STAGES]


def prose(seed, n=60):
    return " ".join(random.Random(seed).choices("the house and garden were there when people came with others to see it all".split(), k=n)) + f" number{seed}"


def through(spark, df):
    """What each stage keeps."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, ""), "test-stage")
        out.append(df)
    return out


PASSAGE = " ".join(f"shared{chr(97 + i)}" for i in range(20))
ROWS = [(i, prose(i)) for i in range(40)]
ROWS += [(100, ROWS[0][1]), (101, f"{PASSAGE} {prose(201)}"), (102, f"{prose(202)} {PASSAGE}"), (103, f"{prose(203)} password=hunter2hunter2 {prose(204)}"), (104, None), (105, "12345 !!"), (106, "")]


@pytest.mark.parametrize("clash", [False, True])
def test_stages_take_effect(spark, docs, clash):
    df = docs(ROWS, clash)
    kept = dict(zip(STAGES, through(spark, df), strict=True))
    ids = [{x.doc_id for x in kept[s].select("doc_id").collect()} for s in STAGES]
    assert not ids[0] & {104, 105, 106} and len(ids[0]) == 44
    assert 100 not in ids[1] and 0 in ids[1]
    texts = {x.doc_id: x.text for x in kept[STAGES[3]].collect()}
    assert PASSAGE in texts[101] and PASSAGE not in texts[102] and "[secret]" in texts[103] and "hunter2" not in texts[103]
    assert all(kept[s].columns == df.columns for s in STAGES[:4])
    assert ids[4] == ids[3]


def test_stages_equal_plain_versions(spark, docs):
    """Each stage on what its predecessor kept, against loops over the rows."""
    shared = [prose(1000 + k, 30) for k in range(3)]
    r = random.Random(12)
    rows = [(i, " ".join([prose(300 + i, r.randrange(5, 80)), *r.sample(shared, r.randrange(3)), f"token: {'Zx81Qw' * 3}{i}" if i % 7 == 0 else "end"])) for i in range(50)]
    rows += [(60 + i, rows[i][1]) for i in range(6)] + [(3, rows[4][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, rows[5][1])]
    df = docs(rows)
    one, two, three, four, five = ([(x.doc_id, x.text) for x in k.collect()] if k.columns[1] == "text" else k.collect() for k in through(spark, df))

    model = langid.fit_languages(df)
    assert Counter(one) == Counter(x for x in rows if not model.predict([x[1]])[2][0])

    root = classes({plain_fingerprint(t) for _, t in one})
    known = {x for x in one if x[0] is not None}
    least = {}
    for i, t in known:
        least.setdefault(root[plain_fingerprint(t)], set()).add(i)
    assert Counter(i for i, _ in two) == Counter([min(v) for v in least.values()]) + Counter({None: sum(i is None for i, _ in one)})
    assert all(x in one for x in two)

    removal = plain_removal(two)
    assert any(gone for _, _, gone, _ in removal)
    assert Counter((i, h) for i, _, _, h in removal) == Counter((i, hashlib.sha256(b" ".join(t.encode().split())).hexdigest()) for i, t in three)

    models = secrets.fit(docs(three))
    for i, t in three:
        spans, at, parts = secrets.all_spans(t, models)[1], 0, []
        for a, _, b in spans:
            if b > at:
                parts += [t[at : max(a, at)], "[secret]" if a >= at else ""]
                at = b
        assert (i, "".join([*parts, t[at:]])) in four

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = Counter((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in four)
    assert Counter((x.doc_id, x.doc_tokens) for x in five if x.start == 0) == sizes
    assert sum(x.length for x in five) == sum(n * k for (_, n), k in sizes.items())


@pytest.mark.parametrize("clash", [False, True])
def test_empty_tables_and_rows_without_labels(spark, docs, clash):
    assert [k.count() for k in through(spark, docs([], clash))] == [0] * 5
    kept = through(spark, docs([(i, prose(i)) for i in range(5)] + [(7, None), (8, ""), (None, None)], clash, lang=None))
    assert [k.count() for k in kept[:1]] == [8]  # nothing was learned to reject by
    # Texts without words are one group, and its first stays; the row without doc_id stays too.
    assert sorted((x.doc_id for x in kept[3].collect()), key=str) == [0, 1, 2, 3, 4, 7, None]


def test_run_over_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("length > 4096").count() == 0
