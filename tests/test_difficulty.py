"""Golden expressions for the difficulty rules (reference lexicon, limits 5 / 45)."""

import pytest
from pyspark.sql import functions as F

from triagelens.functions import difficulty as D
from triagelens.functions.lexicon import REFERENCE

CASES = [
    # text, n_words, n_groups, emotional, unusual, score, bucket
    ("", 0, 0, False, True, 4, "adversarial"),
    ("MY TV WONT TURN ON", 5, 1, True, True, 2, "ambiguous"),
    ("12345 !!!", 2, 0, True, True, 5, "adversarial"),
    ("Élan Über kept the power light on all night long today", 11, 1, False, False, 0, "typical"),
    ("a b c d e", 5, 0, False, True, 4, "adversarial"),
    ("my console power button is stuck", 6, 1, False, False, 0, "typical"),
    ("my account got a refund after the update yesterday", 9, 2, False, False, 2, "ambiguous"),
    ("this class is about my account settings menu", 8, 1, True, False, 1, "edge"),
    ("power cable fell off the back of my console", 9, 1, False, False, 0, "typical"),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "id int, text string")
    out = D.score_frame(df, "text", REFERENCE, detail=True).orderBy("id").collect()
    return {r.id: r for r in out}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(scored, i):
    text, n_words, n_groups, emotional, unusual, score, bucket = CASES[i]
    r = scored[i]
    assert r.n_words == n_words == len(text.split())
    assert r.n_groups == n_groups
    assert r.is_emotional == emotional
    assert r.is_unusual_length == unusual
    assert r.difficulty_score == score
    assert r.difficulty_bucket == bucket


def test_word_count_boundaries(spark):
    texts = [" ".join(["w"] * n) for n in (5, 6, 44, 45)] + ["  a  b ", "x　y", "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        D.word_count("t").alias("n"), D.is_unusual_length("t", REFERENCE).alias("u")).collect()
    assert [r.n for r in rows] == [len(t.split()) for t in texts]
    assert [r.u for r in rows[:4]] == [True, False, False, True]


def test_caps_ratio_unicode(spark):
    rows = spark.createDataFrame([("ÉCOLE école",), ("123",), ("AbC",)], "t string").select(
        D.caps_ratio("t").alias("c")).collect()
    assert rows[0].c == pytest.approx(0.5)
    assert rows[1].c == 0.0
    assert rows[2].c == pytest.approx(2 / 3)
