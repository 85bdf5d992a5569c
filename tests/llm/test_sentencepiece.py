import random

import numpy as np
import public_tokenizers
import pytest

from triagelens.llm import maxplus_sentencepiece as M

MODEL = public_tokenizers.path("piece_bpe_32k.model")
P = M.Pieces(MODEL)
RND = random.Random(11)
TEXTS = ["".join(RND.choice(["th", "er", "ing", "in", "the", "é", "中", "文", "🙂", " ", "  ", "\n", "=", "0", "\x00"])
                 for _ in range(RND.randint(1, 700))) for _ in range(60)]
TEXTS += ["".join(RND.choice("abcdefghié") for _ in range(900)), "a" * 1000, " " * 500, "the" * 300, " a", "x ", "=" * 700]


def chunks(s, size):
    return [M.Chunk(P, s[max(0, b - 16):b + size + 16], min(b, 16), min(b, 16) + min(size, len(s) - b), b == 0, b + size >= len(s))
            for b in range(0, len(s), size)]


@pytest.mark.parametrize("size", [64, 101])
def test_scan_equals_the_librarys_encoding(size):
    widest = 0
    for t in TEXTS:
        cs = chunks(M.marked(t), size)
        ms = [{(i, o): w for i, o, w in c.matrix()} for c in cs]
        widest = max(widest, *map(len, ms))
        states = M.resolve(ms, M.START, M.START)
        traced = [c.trace(*s) for c, s in zip(cs, states)]
        ids = np.frombuffer(b"".join(traced), "<u4")
        want = P.model.encode(t)
        assert ids.tolist() == want
        assert sum(map(P.weight_of, traced)) == sum(map(P.model.get_score, want))
        assert P.decode(ids)[1:] == t == P.model.decode(want)
    assert widest > 20  # cuts inside words: many states


def test_product_is_associative():
    cs = chunks(M.marked("abcdefghié" * 60), 64)
    ms = [{(i, o): w for i, o, w in c.matrix()} for c in cs]
    for a, b, c in zip(ms, ms[1:], ms[2:]):
        assert M.product(M.product(a, b), c) == M.product(a, M.product(b, c))


def test_documents(llm, odd_docs, no_docs):
    extra = llm.createDataFrame([(700 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    coded = M.decode(M.encode(docs, MODEL, chunk=128, fan=3), MODEL).collect()
    by_row = {}
    for r in coded:
        by_row.setdefault((r.row, r.doc_id), []).append(r)
    assert max(map(len, by_row.values())) > 100
    got = []
    for (_, doc), rows in by_row.items():
        rows.sort(key=lambda r: r.chunk)
        assert [r.chunk for r in rows] == list(range(len(rows)))
        got.append((str(doc), "".join(r.text for r in rows), np.frombuffer(b"".join(r.ids for r in rows), "<u4").tolist()))
    want = [(str(r.doc_id), r.text or "", P.model.encode(r.text or "")) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got) == sorted(want)
    assert M.encode(no_docs, MODEL).count() == 0
