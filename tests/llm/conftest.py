"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def llm(spark):
    from triagelens.llm.common import prepare
    prepare(spark)
    return spark


def texts(seed=5, n=40):
    rnd = random.Random(seed)
    pool = ["the", "of", "Étude", "naïve", "x", "And&&&", "a|b", "ZÜ", "日本", "-", "co\x0bde", "tab\tbed", "new\nline"]
    out = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [None, "", " \n\t ", "one", "one two", LONG, "same words here", "same words here", *out, out[0], out[1]]


DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, fp string, "
              "prefix string, row string, block string, measures string")


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Documents with null ids and a repeated row; extra columns named like the operators' own."""
    rows = [(i, t, "en", "src0", len(t or ""), "k", "s", "f", "p", "r", "b", "m") for i, t in enumerate(texts())]
    rows.append((None, "no id at all", "en", None, None, *rows[0][5:]))
    rows.append(rows[8])
    return llm.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOC_SCHEMA)
