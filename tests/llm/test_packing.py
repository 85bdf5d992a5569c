import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from triagelens.llm import harmonic_packing as H

RANKS, VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


ENCODER = H.Encoder(RANKS)
PLAIN = Tokenizer.from_file(VOCAB)
PLAIN.encode_special_tokens = True


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab Z9.,'sé日\n\t\x0b\x85\xa0 !|<>", "  ", " \n", "<|endoftext|>"]), max_size=60).map("".join))
def test_memo_encoding_is_the_vocabularys(text):
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity,granule", [(1024, 64), (64, 8)])
def test_round_trip_capacity_and_padding(odd_docs, reference, capacity, granule):
    rows = H.pack(odd_docs, RANKS, capacity=capacity, granule=granule).collect()
    docs = odd_docs.select("doc_id", "text").collect()
    want = sorted([*reference(d.text), 0] for d in docs)
    by_doc = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    repeated = docs and max(sum(d == e for e in docs) for d in docs)
    got = []
    for (_, n), pieces in by_doc.items():
        pieces.sort()
        copies = sum(len(p) for _, p in pieces) // n
        assert copies <= repeated
        if copies == 1:
            assert [s for s, _ in pieces] == np.cumsum([0, *[len(p) for _, p in pieces]])[:-1].tolist()
            got.append([i for _, p in pieces for i in p])
        else:  # a repeated row: every place is held once per copy
            held = {}
            for s, p in pieces:
                for k, i in enumerate(p):
                    held.setdefault(s + k, []).append(i)
            got += [[held[k][c] for k in range(n)] for c in range(copies)]
    assert sorted(got) == want
    bins = {}
    for r in rows:
        bins.setdefault((r.sequence_id, r.sequence_tokens), []).append((r.offset, r.length))
    assert len({s for s, _ in bins}) == len(bins)
    used = 0
    for (_, size), parts in bins.items():
        parts.sort()
        at = 0
        for offset, n in parts:
            assert offset == at
            at += n
        assert at <= size <= capacity and size & (size - 1) == 0
        assert size == capacity or at == size  # padded to the capacity, or a power of two without padding
        used += at
    assert used / sum(size for _, size in bins) > 0.95


def test_empty_table_and_classes(no_docs):
    assert H.pack(no_docs, RANKS).count() == 0
    for n in range(1, 3000):
        parts = H.cuts(n, 1024, 64)
        assert sum(parts) == n and all(0 < p <= 1024 for p in parts)
        assert all(p * (1024 // p) <= 1024 for p in parts)


CONTRACT = Tokenizer.from_file(VOCAB)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab Z9.,'sé日\n\t\x85\xa0 !|<>", "  ", " \n", "<|endoftext|>", "<|endoftext|>"]), max_size=40).map("".join))
def test_added_token_is_matched(text):
    """The contract's call as it is, special tokens not turned into text."""
    assert np.frombuffer(ENCODER.contract_ids(text), "<u4").tolist() == CONTRACT.encode(text, add_special_tokens=False).ids


def test_packed_ids_hold_the_added_token(llm):
    text = "hello <|endoftext|> world"
    rows = H.pack(llm.createDataFrame([(1, text)], "doc_id long, text string"), RANKS).collect()
    ids = [i for r in sorted(rows, key=lambda r: r.start) for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert ids == [31373, 220, 50256, 995, 0] == [*Tokenizer.from_file(VOCAB).encode(text, add_special_tokens=False).ids, 0]
