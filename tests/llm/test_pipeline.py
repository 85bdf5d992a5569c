"""The stages against brute force on a small table, and the registration."""

import os

import corpus_pipeline as P
from test_packing import PLAIN
from test_rules import brute as measured
from test_secrets import base, method
from test_simhash import brute as fingerprint
from test_simhash import classes

import __spark_entry__ as E
from triagelens.llm import ordinal_quality
from triagelens.llm.common import parked, read

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = [], 0
    for s, _, e in sorted(base(text) + method(text)):
        if s >= at or not out:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_stages(llm):
    docs = read(llm, SF, "documents")
    model = ordinal_quality.fit(docs, ordinal_quality.graded(read(llm, SF, "labels")))
    memo, known = ordinal_quality.Features(dict(zip(model.ids.tolist(), range(len(model.ids))))), docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    eta = {i: sum(model.weights[j] for j in memo.of(r.text)) for i, r in rows.items()}
    want = {i for i in rows if eta[i] - model.thresholds[-1] >= 0}
    left = {}
    for name, stage in P.STAGES[:-1]:
        docs = parked(stage(llm, docs, SF), "t")
        assert docs.columns == known
        left[name] = {r.doc_id: r for r in docs.collect()}
    assert set(left["quality classifier"]) == want

    def passes(t):
        n, chars, symbols, dups, rep = measured(t)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n"))
        caps = sum("A" <= c <= "Z" for c in t)
        return not (n < 10 or 100 * rep > 20 * n or 100 * symbols > 30 * n or 100 * dups > 30 * lines or chars > 40 * n
                    or 100 * caps > 60 * chars)
    want = {i for i in want if passes(rows[i].text)}
    assert set(left["quality rules"]) == want
    ids = sorted(want)
    groups = classes([fingerprint(rows[i].text) for i in ids], P.MAX_BITS)
    want = {ids[g] for g in set(groups)}
    assert set(left["simhash near-dedup"]) == want
    clean = left["secret scans"]
    assert set(clean) == want and all(clean[i].text == redacted(rows[i].text) and clean[i].n_chars == len(clean[i].text) for i in want)
    packed = P.STAGES[-1][1](llm, docs, SF).collect()
    tokens = {i: len(PLAIN.encode(clean[i].text, add_special_tokens=False).ids) + 1 for i in want}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens
    again = P.run(llm, SF)
    assert again.columns == P.STAGES[-1][1](llm, docs, SF).columns
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in again.collect()) == sorted(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_registration():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "simhash near-dedup", "secret scans", "packing"]
    assert os.path.exists(P.__file__)
