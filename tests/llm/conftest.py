import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (ids count up from 0) or (id, text) pairs, with extra columns whose names clash."""

    def make(texts, clash=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], DOCS)
        for c in ("n_dropped", "text_id", "rate", "score", "spans", "rank", "component_id", "source_", "n") if clash else ():
            df = df.selectExpr("*", f"'x' AS `{c}`")
        return df

    return make


LONG = "word " * 30_000
#: Nulls, empty, blank, very long, repeated and tied texts.
ODD = [None, "", " \t\n ", "\n\n", LONG, LONG, "a", "a", "tie one two three four five", "tie one two three four five"]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of([*ODD, (None, "text of a row without id"), (3, "same id other text")])
