import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, and some that differ from them in case alone, as extra columns.
CLASH = "score fp positions __positions key words mark __mark __ID h g bucket PARCEL number root Rejected ids length start sequence_id lang_pred hashes t n".split()


@pytest.fixture
def docs(spark):
    def make(texts, clash=False, lang="en"):
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in texts]
        if clash:
            return spark.createDataFrame([(*r, *("x",) * len(CLASH)) for r in rows], ", ".join([DOCS, *(f"{c} string" for c in CLASH)]))
        return spark.createDataFrame(rows, DOCS)

    return make
