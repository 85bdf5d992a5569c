import itertools
import random
import re

import xxhash
from pyspark.sql import functions as F

from triagelens.llm import simhash_mih as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, bits):
    """Brute force over all pairs: component of every position."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_match_definition(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, f"{brute(r.text):016x}") for r in rows)
    got = S.fingerprints(odd_docs).select("doc_id", S.hex16(F.col("fp")).alias("h")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.h) for r in got) == want


def test_native_hash_agrees(llm):
    got = llm.sql("select xxhash64('a b ç') h").first().h % (1 << 64)
    assert got == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def planted(seed):
    """Chains and clusters of near fingerprints among random ones."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(150)]
    for base in out[:20]:
        x = base
        for _ in range(6):
            x ^= 1 << rnd.randrange(64)
            x ^= (rnd.random() < 0.6) << rnd.randrange(64)
            out.append(x)
    hub = out[0]
    out += [hub ^ (1 << i) for i in range(64)]
    return sorted(set(out))


def test_links_give_the_components_of_all_pairs(llm):
    for bits in (1, 2, 3):
        fps = planted(bits)
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        df = llm.createDataFrame([(x,) for x in signed], "fp long")
        links = S.links(df, bits).collect()
        assert all(bin((r.fp ^ r.hub) % (1 << 64)).count("1") <= bits for r in links)
        from triagelens.llm.common import components
        roots = {r.node: r.root for r in components(S.links(df, bits), "fp", "hub").collect()}
        got = [roots.get(x, x) for x in signed]
        want = classes(fps, bits)
        group = lambda xs: {tuple(i for i, y in enumerate(xs) if y == x) for x in set(xs)}
        assert group(got) == group(want)


def test_link_and_dedup(llm, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    fps = [brute(r.text) for r in rows]
    want = {}
    for r, c in zip(rows, classes(fps, 2)):
        want.setdefault(c, set()).add(r.doc_id)
    least = {c: min(i for i in ids if i is not None) if ids - {None} else None for c, ids in want.items()}
    expect = sorted(((r.doc_id is None, r.doc_id or 0, least[c]) for r, c in zip(rows, classes(fps, 2))), key=str)
    got = S.link(odd_docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got), key=str) == expect
    kept = S.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({x for x in least.values() if x is not None})
    assert ids.count(None) == 1
    assert S.link(no_docs).count() == 0 and S.dedup(no_docs).count() == 0


def test_one_id_on_two_texts_loses_no_text(llm):
    """Ids 5 and 7 stand on several texts: each component keeps one row, and only one."""
    a, b, c = "first text of five words", "another text that differs wholly", "third one here and there"
    rows = [(5, a, "x"), (5, b, "x"), (7, b, "y"), (5, a, "z"), (7, c, "y"), (7, c, "y"), (8, c, "w"), (9, "", "v"), (9, None, "u"), (None, a, "n")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, root string").repartition(4)
    got = sorted(S.dedup(docs).collect(), key=str)
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id is not None) == sorted([(5, a), (5, b), (7, c), (9, "")])
    assert sum(r.doc_id is None for r in got) == 1 and S.dedup(docs).columns == docs.columns
    assert sorted(S.dedup(docs.repartition(1)).collect(), key=str) == got
