import random
import re
import zlib
from collections import Counter

import pytest

from triagelens.llm import spelling_pivots as P


def vocabulary(docs, noise, min_chars, min_count):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_chars and n >= min_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(words, ratio):
    by = {w: [v for v in words if near(w, v) and min(len(v), len(w)) >= P.SHORTEST] for w in words}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(by[w]), words.get(form[w])))
    return out


def close_words(seed, n, letters="abé", sizes=(3, 8)):
    """Words over few letters: many are near, many bigrams are frequent and repeat within a word."""
    rnd = random.Random(seed)
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(*sizes))): int(rnd.paretovariate(0.4)) for _ in range(n)}


@pytest.mark.parametrize("seed,letters,sizes", [(1, "ab", (3, 9)), (2, "abé", (4, 8)), (3, "abcdefghijklm", (3, 5)), (4, "thernso", (6, 9))])
def test_links_and_forms_equal_brute_force(llm, seed, letters, sizes):
    words = close_words(seed, 700, letters, sizes)
    got = P.group(llm.createDataFrame(list(words.items()), "word string, n long"), ratio=2)
    assert set(map(tuple, got.collect())) == brute(words, 2)


def test_long_chains_of_forms(llm):
    words = {"a" * i + "bcdefg": 2**i for i in range(1, 20)}
    got = P.group(llm.createDataFrame(list(words.items()), "word string, n long"), ratio=2)
    rows = {r.word: r.root for r in got.collect()}
    assert set(rows.values()) == {"a" * 19 + "bcdefg"}


@pytest.mark.parametrize("noise", [None, 3])
def test_vocabulary(llm, odd_docs, noise):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = P.vocabulary(odd_docs, min_chars=2, min_count=2, noise=noise)
    assert dict(map(tuple, got.collect())) == vocabulary(docs, noise, 2, 2)


def test_letters_and_flushes(llm, monkeypatch):
    monkeypatch.setattr(P, "HELD", 2)
    monkeypatch.setattr(P, "HELD_BYTES", 300)
    text = "ÀÉÿ×÷ŒuvreÄb İIx ßßẞ àbc DON'T Éé日é " + " ".join(["Long" * 40, "é" * 200, "Long" * 40])
    docs = [(1, text), (None, text), (1, text), (2, None), (3, "")]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    got = P.vocabulary(df, min_chars=1, min_count=1)
    assert dict(map(tuple, got.collect())) == vocabulary(docs, None, 1, 1)


def test_pivots_are_disjoint_and_cheapest():
    order = {g: (i, c) for i, (g, c) in enumerate([("ab", 1), ("bc", 2), ("cd", 3), ("da", 9)])}
    first = P.prefix("abcda", order)
    assert [p for _, p in first] == [0, 1, 2]
    assert P.pivots("abcda", order, first) == [0, 2]
    assert P.pivots("abab", {"ab": (0, 3), "ba": (1, 1)}, P.prefix("abab", {"ab": (0, 3), "ba": (1, 1)})) == [0, 2]


def test_empty_table(llm, no_docs):
    assert P.group(P.vocabulary(no_docs)).count() == 0


def test_no_join_broadcasts_a_table(llm, monkeypatch):
    """Word tables are small as files and large as rows: none may be broadcast on Spark's estimate."""
    plans, store = [], P.parked
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(P, "parked", lambda df, name: [plans.append(plan(df)), store(df, name)][1])
    words = {"a" * i + "bcdefg": 2**i for i in range(1, 6)}
    got = P.group(llm.createDataFrame(list(words.items()), "word string, n long"), ratio=2)
    plans.append(plan(got))
    assert sum("Join" in x for x in plans) >= 3 and not [x for x in plans if "Broadcast" in x]
    assert {r.root for r in got.collect()} == {"aaaaabcdefg"}
