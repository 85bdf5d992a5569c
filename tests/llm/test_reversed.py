import math
import re
from collections import Counter, defaultdict

import pytest

from triagelens.llm import reversed_search as R

ITEMS = [(0, "The of x", "t"), (1, None, "t"), (2, "", "t"), (3, "日本 naïve ZÜ étude", "t"), (None, "the", "t"), (4, "word5 word6 the the", "t"),
         (5, "one", "t"), (5, "two one", "t"), (0, "The of x", "t"), (6, "absent", "t"), (7, "same words here", "t"), (-1, "× and A", "t")]
SCHEMA = "item_id long, text string, rank string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(R.TERM, text or "")]


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, want in asked.items():
        scores = []
        for i, c in counts:
            m = 100 - 90 + 90 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in want if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k,block,cells", [(10, R.BLOCK, R.CELLS), (3, 4, 5), (100, 8, 1)])
def test_equals_brute_force(llm, odd_docs, monkeypatch, k, block, cells):
    """Also with items dealt over many blocks, items larger than a block, and one document scored at a time."""
    monkeypatch.setattr(R, "CELLS", cells)
    items = llm.createDataFrame(ITEMS, SCHEMA)
    got = sorted(map(tuple, R.rank(odd_docs, items, k=k, block=block).collect()))
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()], [r[:2] for r in ITEMS], k)


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = ("Ab é-x  " * 500 + "z" * 300 + " end").encode()
    whole = R.term_counts(text)
    monkeypatch.setattr(R, "SLICE", 7)
    assert R.term_counts(text) == whole == Counter(t.encode() for t in terms(text.decode()))


def test_lengths_beyond_64_bits():
    import numpy as np
    n = np.array([1, 10**9], np.int64)
    assert R.lengths(n, 10**12, 10**15).tolist() == [10 + x * 90 * 10**12 // 10**15 for x in n.tolist()]


def test_empty_tables(llm, odd_docs, no_docs):
    items = llm.createDataFrame(ITEMS, SCHEMA)
    assert R.rank(no_docs, items).count() == 0
    assert R.rank(odd_docs, items.where("false")).count() == 0
