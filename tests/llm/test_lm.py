import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from triagelens.llm import backoff_lm as B

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

def is_held():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute(docs):
    """Direct evaluation with dictionaries."""
    toks = [(i, [*WORD.findall((t or "").translate(LOWER)), "</s>"]) for i, t in docs]
    train = [t for i, t in toks if not held(i)]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v, seen = sum(uni.values()), len(uni), {**uni, "<s>": len(train)}
    once, all_ = Counter(), Counter()
    for (h, _), c in bi.items():
        tag = seen[h].bit_length() - 1
        all_[tag] += c
        once[tag] += c == 1
    out = []
    for i, t in toks:
        base = score = 0.0
        for h, w in zip(["<s>", *t], t):
            p = (uni[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            b = 1.0
            if seen.get(h, 0):
                tag = seen[h].bit_length() - 1
                b = (once[tag] + 0.5) / (all_[tag] + 1.0)
            score += math.log10((1 - b) * bi[h, w] / max(seen.get(h, 0), 1) + b * p)
        out.append((i, held(i), len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("block_bytes,bucket_tokens", [(B.BLOCK_BYTES, B.BUCKET_TOKENS), (2000, 3000)])
def test_equals_direct_evaluation(odd_docs, block_bytes, bucket_tokens):
    got = B.score(odd_docs, is_held(), block_bytes=block_bytes, bucket_tokens=bucket_tokens).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = brute([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_a_states_arcs_sum_to_one(llm):
    """Seen states: the known words' probabilities and one unknown word's share add up to 1."""
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 30)))) for i in range(60)]
    train = [t for i, t in docs if not held(i)]
    words = [*"abcde", "new"]
    probe = [(i, f"a {w}") for i, w in zip((x for x in range(10_000, 20_000) if held(x)), [*words, ""])]
    rows = {r.doc_id: r.score for r in B.score(llm.createDataFrame([*docs, *probe], "doc_id long, text string"), is_held()).collect()}
    first = brute([*docs, *probe])
    assert len(train) > 20 and {i: pytest.approx(s) for i, *_, s in first} == rows


def test_nothing_to_learn_from(llm, no_docs):
    assert B.score(no_docs, is_held()).count() == 0
    one = next(i for i in range(100) if held(i))
    df = llm.createDataFrame([(one, "a b")], "doc_id long, text string")
    r = B.score(df, is_held()).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0.0) and math.isfinite(r.score)


def test_totals_beyond_32_bits():
    """Three blocks that together hold a word more often than 32 bits can say."""
    keys = np.array([5, 9], np.uint64)
    sent = [(b, 0, keys.astype("<u8").tobytes(), np.array([4_000_000_000, n], "<u4").tobytes(), bytes(2))
            for b, n in enumerate((1_431_655_766, 1_431_655_765, 1_431_655_765))]  # 2^32 in all
    out = B.summed((0,), pd.DataFrame(sent, columns=B.SENT_COLUMNS))
    for b in range(3):
        assert B.answered(out[out["block"] == b]).tolist() == [12_000_000_000, 1 << 32]
