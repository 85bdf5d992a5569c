import re

from pyspark.sql import functions as F

from triagelens.llm import rule_ledger as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    cover = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))


EXTRA = ["a b c d e f a b c d e g a b c d e", "x " * 3000, "l one\nl one\n l one\n\nl one", "p q r s t " * 2 + "p q r s",
         "\x1c\x85 a\xa0b", "🙂 #*$%&|<>"]


def test_measures_and_verdicts(llm, odd_docs, no_docs):
    extra = llm.createDataFrame([(900 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    book = R.judge(R.ledger(docs), R.POLICIES["v1"])
    for r in book.collect():
        m = r.measures
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(r.text)
        n, chars, _, _, rep = brute(r.text)
        assert (r.failed_bits & 3 != 0) == (n < 10 or 100 * rep > 20 * n)
        assert r.kept == (r.failed_bits == 0)
    kept = R.keep(docs, R.POLICIES["v1"])
    assert kept.columns == docs.columns
    assert sorted(str(r) for r in kept.collect()) == sorted(
        str(r) for r in docs.join(book.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns).collect())
    assert R.ledger(no_docs).count() == 0 and R.keep(no_docs, R.POLICIES["v1"]).count() == 0


def test_policies_reuse_the_bits_and_ablation_counts(odd_docs):
    book = R.ledger(odd_docs).select("doc_id", "failed_bits").collect()
    got = {(r.policy, r.rule): r for r in R.ablation(R.ledger(odd_docs), list(R.POLICIES.values())).collect()}
    for policy in R.POLICIES.values():
        mask = policy.mask()
        for rule in (x for x in R.RULES if x.name in policy.rules):
            r = got[policy.version, rule.name]
            hits = [b.failed_bits & mask for b in book]
            assert r.n_rows == len(book) and r.n_dropped == sum(h != 0 for h in hits)
            assert r.n_failed == sum(h >> rule.bit & 1 for h in hits)
            assert r.n_only_this == sum(h == 1 << rule.bit for h in hits)


def test_native_only(odd_docs):
    plan = R.keep(odd_docs, R.POLICIES["v1"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Map)|Exchange hash", plan.split("== Physical Plan ==")[1])
    assert R.ledger(odd_docs).select(F.max("failed_bits")).first()[0] > 0
