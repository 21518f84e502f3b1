import hashlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("row", "_row", "name", "kept", "score", "size", "copies", "fp", "start", "anchor", "word", "lang_pred")


@pytest.fixture(scope="session")
def table(spark):
    """A table of documents from texts or (doc_id, text, lang, source) rows, with columns whose names clash."""

    def make(rows, clash=False):
        full = []
        for i, r in enumerate(rows):
            if not isinstance(r, tuple):
                r = (i, r)
            doc_id, text, lang, source = (*r, *(None,) * (4 - len(r)))
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for name in CLASHING:
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make


@pytest.fixture
def sha():
    return lambda data: hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
