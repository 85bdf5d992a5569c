"""DuckDB twins of the registered queries (same names, same output columns).

Written independently of the Spark code, as plain SQL over the driver's views.
Only the lexicons and thresholds are shared, through small SQL builders.
"""

from __future__ import annotations

import math

from ..functions.difficulty import NON_WS_CLASS, WS_CLASS
from ..functions.lexicon import (
    CONVERSATIONS_LEXICON, DOCUMENTS_LEXICON, LANG_MARKERS, LANG_ORDER, REFERENCE_TARGETS, Lexicon,
)
from . import fixtures as FX

SQL: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def wc(t: str) -> str:
    return f"length(regexp_replace(regexp_replace({t}, '{NON_WS_CLASS}+', 'x', 'g'), '{WS_CLASS}+', '', 'g'))"


def caps(t: str) -> str:
    letters = f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"
    uppers = f"length(regexp_replace({t}, '[^\\p{{Lu}}]', '', 'g'))"
    return f"(case when {letters} > 0 then {uppers}::double / {letters} else 0.0::double end)"


def any_of(t: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({t}), {q(w)})" for w in words) + ")" if words else "false"


def n_groups(t: str, lex: Lexicon) -> str:
    return "(" + " + ".join(f"(case when {any_of(t, kws)} then 1 else 0 end)" for kws in lex.groups.values()) + ")"


def scored(src: str, id_col: str, lex: Lexicon, extra: str = "") -> str:
    """A subquery with the difficulty parts, score and bucket of each row of ``src``."""
    return f"""(
  select *, case when difficulty_score = 0 then 'typical' when difficulty_score = 1 then 'edge'
                 when difficulty_score = 2 then 'ambiguous' else 'adversarial' end as difficulty_bucket
  from (
    select *, ((case when n_groups = 0 then 3 when n_groups >= 2 then 2 else 0 end)
               + is_emotional::int + is_unusual_length::int)::int as difficulty_score
    from (
      select *, (caps_raw > {lex.caps_threshold} or contains(text, '!') or {any_of('text', lex.frustration)}) as is_emotional,
             (n_words <= {lex.short_words} or n_words >= {lex.long_words}) as is_unusual_length
      from (
        select {id_col}, text{extra}, {wc('text')}::int as n_words, {caps('text')} as caps_raw,
               {n_groups('text', lex)}::int as n_groups
        from {src}))))"""


DOC_SCORED = scored("documents", "doc_id", DOCUMENTS_LEXICON)

MSGS = """(select printf('%d:%d', conv_id, turn) as tweet_id, role as author_id, role = 'user' as inbound, text,
          case when turn > 0 then printf('%d:%d', conv_id, turn - 1) end as in_response_to_tweet_id
   from conversations)"""

REPLIES = f"""(select * from {MSGS} where author_id = '{FX.BRAND}' and inbound = false
   and in_response_to_tweet_id is not null)"""

PAIRS = f"""(select c.tweet_id as cust_tweet_id, c.text as cust_text, r.tweet_id as reply_tweet_id,
          r.text as brand_reply, c.inbound as cust_inbound
   from {REPLIES} r join {MSGS} c on c.tweet_id = r.in_response_to_tweet_id)"""

REPLIED = f"""(select * from {MSGS} where tweet_id in (select in_response_to_tweet_id from {REPLIES}))"""


def targets_values(targets: dict[str, int]) -> str:
    return "(values " + ", ".join(f"({q(k)}, {int(v)})" for k, v in targets.items()) + ") t(b, target)"


def sample_of(src: str, id_col: str, targets: dict[str, int], seed: int) -> str:
    return f"""(select * exclude (target) from (
    select s.*, row_number() over (partition by s.difficulty_bucket
                                   order by md5(concat('{seed}:', s.{id_col})), s.{id_col}) as sample_rank,
           t.target
    from {src} s join {targets_values(targets)} on s.difficulty_bucket = t.b)
  where sample_rank <= target)"""


CONV_GOLDEN_IDS = f"""(select tweet_id as message_id from {sample_of(
    scored(REPLIED, 'tweet_id', CONVERSATIONS_LEXICON), 'tweet_id', FX.CONV_TARGETS, FX.SEED)})"""

GOLDEN = f"""(select d.doc_id as message_id, d.text, d.difficulty_bucket, d.difficulty_score,
          d.lang as true_intent, l.toxic = 1 as true_escalate
   from {scored('documents', 'doc_id', DOCUMENTS_LEXICON, ', lang')} d join labels l using (doc_id))"""


def lang_pred(t: str, per_lang: int | None = None) -> str:
    lo = f"lower({t})"
    sc = {lang: " + ".join(f"((length({lo}) - length(replace({lo}, {q(m)}, ''))) // {len(m)})"
                           for m in LANG_MARKERS[lang][:per_lang]) for lang in LANG_ORDER}
    best = "greatest(" + ", ".join(f"({s})" for s in sc.values()) + ")"
    whens = " ".join(f"when ({sc[lang]}) = {best} then '{lang}'" for lang in LANG_ORDER)
    return f"(case when {best} = 0 then null {whens} end)"


GOLDEN_PRED = f"""(select *, {lang_pred('text')} as pred_intent, {lang_pred('text', 1)} as simple_pred_intent,
          ({caps('text')} > {DOCUMENTS_LEXICON.caps_threshold} or contains(text, '!')
           or {any_of('text', DOCUMENTS_LEXICON.frustration)}) as pred_escalate
   from {GOLDEN})"""

FEATURES = f"""(select doc_id, n_chars, {wc('text')} as n_words,
          length(text) - length(replace(text, chr(10), '')) + 1 as n_lines from documents)"""


def rated(feature: str, thresholds: list[int]) -> str:
    return "(1 + " + " + ".join(f"({feature} >= {t})::int" for t in thresholds) + ")::int"


JUDGE = "(select doc_id as message_id, " + ", ".join(
    f"{rated(j[0], j[1])} as judge_{d}" for d, (j, _) in FX.RATER_RULES.items()) + f" from {FEATURES})"
HUMAN = "(select doc_id as message_id, " + ", ".join(
    f"{rated(h[0], h[1])} as human_{d}" for d, (_, h) in FX.RATER_RULES.items()) + \
    f" from {FEATURES} where doc_id in (select doc_id from labels))"


def agreement_sql(longf: str, unmatched: str | None) -> str:
    extra = f", ({unmatched}) as n_unmatched" if unmatched else ""
    return f"""
with l as {longf},
st as (select dimension, count(*) as n, avg((judge = human)::int::double) as po,
              round(avg((judge = human)::int::double), 6) as exact_agreement,
              round(avg((abs(judge - human) <= 1)::int::double), 6) as within_1_agreement,
              round(case when var_pop(judge) > 0 and var_pop(human) > 0 then corr(judge, human) end, 6) as correlation,
              round(avg((judge - human)::double), 6) as bias
       from l group by dimension),
jc as (select dimension, judge as label, count(*) as nj from l group by dimension, judge),
hc as (select dimension, human as label, count(*) as nh from l group by dimension, human),
pe as (select dimension, sum(nj * nh) as s from jc join hc using (dimension, label) group by dimension),
k as (select st.dimension, coalesce(pe.s, 0)::double / (st.n * st.n) as pe, st.po from st left join pe using (dimension))
select st.dimension, st.n, st.exact_agreement, st.within_1_agreement, st.correlation, st.bias,
       round(case when k.pe >= 1 then null else (k.po - k.pe) / (1 - k.pe) end, 6) as cohen_kappa{extra}
from st join k using (dimension)"""


def _poisson_cdf() -> list[float]:
    out, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(12):
        acc += term
        out.append(acc)
        term /= (k + 1)
    return out


# ---------------------------------------------------------------- sources / difficulty

SQL["table_profile"] = " union all ".join(
    f"select '{c}' as column_name, {i + 1} as position, '{t}' as data_type, count(*) as n_rows, count(*) - count({c}) as n_null, "
    f"count(distinct {c}) as n_distinct from documents"
    for i, (c, t) in enumerate([("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                                ("n_chars", "bigint")]))

SQL["first_rows"] = "select * from documents order by doc_id limit 3"

SQL["difficulty_scored"] = f"""
select doc_id, n_words, round(caps_raw, 6) as caps_ratio, n_groups, is_emotional, is_unusual_length,
       difficulty_score, difficulty_bucket
from {DOC_SCORED}"""

SQL["bucket_counts"] = f"select difficulty_bucket, count(*) as n from {DOC_SCORED} group by 1"

_groups = DOCUMENTS_LEXICON.groups
SQL["keyword_group_freq"] = "with d as (select text from documents), tot as (select count(*) as t from d) " + \
    " union all ".join(
        f"select {q(g)} as keyword_group, count(*) as n_messages, round(count(*) / max(tot.t), 6) as share "
        f"from d, tot where {any_of('text', kws)} having count(*) > 0"
        for g, kws in _groups.items()) + \
    " union all select '<none>' as keyword_group, count(*) as n_messages, round(count(*) / max(tot.t), 6) " \
    "from d, tot where not (" + " or ".join(any_of('text', k) for k in _groups.values()) + ") having count(*) > 0"

SQL["threshold_percentiles"] = f"""
with v as (
  select 'n_words' as metric, {wc('text')}::double as v from documents
  union all select 'caps_ratio', {caps('text')} from documents),
p as (select metric, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) as p from v group by metric)
select metric, round(p[1], 6) as p05, round(p[2], 6) as p25, round(p[3], 6) as p50,
       round(p[4], 6) as p75, round(p[5], 6) as p95 from p"""

SQL["brand_deflection"] = f"""
select author_id, count(*) as n_messages,
       round(avg(case when {any_of('text', CONVERSATIONS_LEXICON.deflection)} then 1 else 0 end), 6) as deflection_rate
from {MSGS} group by author_id"""

# ---------------------------------------------------------------- threads and pool

SQL["thread_pairs"] = f"select * from {PAIRS}"
SQL["replied_messages"] = f"select tweet_id, author_id, inbound from {REPLIED}"
SQL["retrieval_pool"] = f"""
select *, (not coalesce(cust_inbound, false)) or regexp_matches(cust_text, '\\^[A-Z]{{2}}\\b') as mis_threaded
from {PAIRS} where cust_tweet_id not in (select message_id from {CONV_GOLDEN_IDS})"""
SQL["pool_step_counts"] = f"""
select (select count(*) from {PAIRS}) as raw_pairs,
       (select count(*) from {CONV_GOLDEN_IDS}) as excluded_ids,
       (select count(*) from {PAIRS} where cust_tweet_id not in (select message_id from {CONV_GOLDEN_IDS})) as pool_pairs"""

# ---------------------------------------------------------------- sampling

DOC_POOL = f"(select doc_id, difficulty_score, difficulty_bucket from {DOC_SCORED})"
DOC_SAMPLE = sample_of(DOC_POOL, "doc_id", REFERENCE_TARGETS, FX.SEED)

SQL["stratified_sample"] = f"select * from {DOC_SAMPLE}"

SQL["sample_shortfall"] = f"""
select t.b as difficulty_bucket, t.target::bigint as target, coalesce(a.n, 0)::bigint as available,
       least(t.target, coalesce(a.n, 0))::bigint as taken,
       (t.target - least(t.target, coalesce(a.n, 0)))::bigint as shortfall
from {targets_values(REFERENCE_TARGETS)}
left join (select difficulty_bucket, count(*) as n from {DOC_POOL} group by 1) a on a.difficulty_bucket = t.b"""

SQL["shuffled_sample"] = f"""
select doc_id as message_id, difficulty_bucket, difficulty_score, null::varchar as true_intent,
       null::varchar as gold_reply_notes, null::boolean as true_escalate, null::varchar as true_escalate_reason,
       row_number() over (order by md5(concat('{FX.SEED + 1}:', doc_id)), doc_id) as shuffle_rank
from {DOC_SAMPLE}"""

SQL["stratified_batches"] = f"""
select message_id, difficulty_bucket,
       ((row_number() over (partition by difficulty_bucket order by md5(concat('{FX.SEED}:', message_id)), message_id)
         - 1) % 4)::int as batch
from {GOLDEN}"""

SQL["kfold_assignment"] = f"""
select message_id, true_intent,
       ((row_number() over (partition by true_intent order by md5(concat('{FX.SEED}:', message_id)), message_id)
         - 1) % 5)::int as fold
from {GOLDEN}"""

SQL["topup_sample"] = f"""
select * from (
  select *, row_number() over (partition by difficulty_bucket order by md5(concat('{FX.SEED}:', doc_id)), doc_id)
            as sample_rank
  from {DOC_POOL} where doc_id not in (select doc_id from {DOC_SAMPLE}))
where sample_rank <= 1"""

SQL["score_range_subsample"] = f"""
select message_id, judge_overall, sample_rank from (
  select message_id, judge_overall,
         row_number() over (partition by judge_overall order by md5(concat('{FX.SEED}:', message_id)), message_id)
         as sample_rank
  from {JUDGE}) where sample_rank <= 7"""

# ---------------------------------------------------------------- golden set handling

SQL["golden_union"] = f"""
select message_id, 1::bigint as n_copies, batch, true_intent from (
  select message_id, true_intent,
         ((row_number() over (partition by difficulty_bucket order by md5(concat('{FX.SEED}:', message_id)), message_id)
           - 1) % 4)::int as batch
  from {GOLDEN})"""

SQL["unlabelled_rows"] = "select doc_id as message_id from documents where doc_id not in (select doc_id from labels)"

SQL["label_upsert"] = """
with ev as (
  select doc_id, toxic = 1 as escalate, 1 as written_at from labels
  union all
  select l.doc_id, true, 2 from labels l join documents d using (doc_id) where contains(d.text, '!')),
latest as (select doc_id, arg_max(escalate, written_at) as escalate, max(written_at) as written_at
           from ev group by doc_id)
select d.doc_id as message_id, latest.escalate as true_escalate, latest.written_at
from documents d left join latest using (doc_id)"""

# ---------------------------------------------------------------- metrics

SQL["class_balance"] = f"""
with g as {GOLDEN}, tot as (select count(*) as t from g)
select 'true_intent' as label_name, true_intent as label_value, count(*) as n, round(count(*) / max(tot.t), 6) as share
from g, tot group by true_intent
union all
select 'true_escalate', true_escalate::varchar, count(*), round(count(*) / max(tot.t), 6)
from g, tot group by true_escalate"""

SQL["majority_label"] = f"""
select true_intent as majority_label, count(*) as n from {GOLDEN} where true_intent is not null
group by true_intent order by n desc, true_intent limit 1"""

SQL["trivial_eval"] = f"""
with g as {GOLDEN},
m as (select true_intent as lab from g where true_intent is not null group by true_intent
      order by count(*) desc, true_intent limit 1)
select count(*) as n, sum(case when true_intent = (select lab from m) then 1 else 0 end)::bigint as n_correct,
       round(avg(case when true_intent = (select lab from m) then 1 else 0 end), 6) as accuracy
from g where true_intent is not null"""

SQL["accuracy_overall"] = f"""
select count(*) as n, sum(case when pred_intent = true_intent then 1 else 0 end)::bigint as n_correct,
       round(avg(case when pred_intent = true_intent then 1 else 0 end), 6) as accuracy
from {GOLDEN_PRED} where true_intent is not null"""

SQL["accuracy_failures_wrong"] = f"""
select count(*) as n_golden,
       round(sum(case when pred_intent = true_intent then 1 else 0 end) / count(*), 6) as intent_accuracy,
       round(sum(case when pred_escalate = true_escalate then 1 else 0 end) / count(*), 6) as escalation_accuracy
from {GOLDEN_PRED}"""

SQL["accuracy_by_bucket"] = f"""
select case when grouping(difficulty_bucket) = 1 then 'all' else difficulty_bucket end as difficulty_bucket,
       count(*) as n, round(avg(case when pred_intent = true_intent then 1 else 0 end), 6) as accuracy
from {GOLDEN_PRED} where true_intent is not null group by rollup (difficulty_bucket)"""

SQL["baseline_lift"] = f"""
with g as {GOLDEN_PRED},
m as (select true_intent as lab from g where true_intent is not null group by true_intent
      order by count(*) desc, true_intent limit 1),
a as (select sum(case when pred_intent = true_intent then 1 else 0 end) / count(*) as agent,
             sum(case when true_intent = (select lab from m) then 1 else 0 end) / count(*) as trivial_baseline,
             sum(case when simple_pred_intent = true_intent then 1 else 0 end) / count(*) as simple_baseline
      from g)
select round(agent, 6) as agent, round(trivial_baseline, 6) as trivial_baseline,
       round(simple_baseline, 6) as simple_baseline, round(agent - trivial_baseline, 6) as lift_over_trivial,
       round(agent - simple_baseline, 6) as lift_over_simple from a"""

SQL["always_positive_baseline"] = f"""
select count(*) as n, sum(true_escalate::int)::bigint as n_positive,
       round(avg(true_escalate::double), 6) as always_positive_accuracy
from {GOLDEN} where true_escalate is not null"""

CONF = f"""(select true_intent as true_label, coalesce(pred_intent, '<none>') as pred_label, count(*) as n
   from {GOLDEN_PRED} where true_intent is not null group by 1, 2)"""
SQL["confusion_matrix"] = f"select * from {CONF}"
SQL["top_confusions"] = f"select * from {CONF} where true_label <> pred_label order by n desc, true_label, pred_label limit 5"

SQL["judge_on_errors"] = f"""
select count(*) as n_all, count(case when true_escalate and not pred_escalate then 1 end) as n_subset,
       round(avg(judge_escalation_judgment), 6) as mean_all,
       round(avg(case when true_escalate and not pred_escalate then judge_escalation_judgment end), 6) as mean_subset
from {GOLDEN_PRED} g join {JUDGE} j using (message_id)"""

SQL["bootstrap_ci"] = f"""
with v as (select doc_id, quality::double as x from labels where quality is not null),
r as (select x, row_number() over (order by md5(concat('{FX.SEED}:', doc_id)), doc_id) - 1 as idx from v),
n as (select count(*) as n, avg(x) as m from v),
d as (select b.range as b, (('0x' || substr(md5(concat('{FX.SEED}:', b.range, ':', r.idx)), 1, 15))::bigint) % n.n as idx
      from range(2000) b, r, n),
reps as (select d.b, avg(r.x) as m from d join r on d.idx = r.idx group by d.b)
select round(max(n.m), 6) as mean, round(quantile_cont(reps.m, 0.025), 6) as ci_low,
       round(quantile_cont(reps.m, 0.975), 6) as ci_high, max(n.n) as n, 2000 as n_boot
from reps, n"""

_w = " + ".join(f"(u >= {c!r})::int" for c in _poisson_cdf())
SQL["bootstrap_ci_poisson"] = f"""
with v as (select doc_id, quality::double as x from labels where quality is not null),
n as (select count(*) as n, avg(x) as m from v),
u as (select b.range as b, v.x,
             (('0x' || substr(md5(concat('{FX.SEED}:', b.range, ':', v.doc_id)), 1, 15))::bigint)::double / 1152921504606846976.0::double as u
      from range(2000) b, v),
w as (select b, x, {_w} as w from u),
reps as (select b, sum(w * x) / sum(w) as m from w group by b)
select round(max(n.m), 6) as mean, round(quantile_cont(reps.m, 0.025), 6) as ci_low,
       round(quantile_cont(reps.m, 0.975), 6) as ci_high, max(n.n) as n, 2000 as n_boot
from reps, n"""

_long = "(" + " union all ".join(
    f"select '{d}' as dimension, j.judge_{d} as judge, h.human_{d} as human "
    f"from {JUDGE} j join {HUMAN} h using (message_id)" for d in FX.DIMENSIONS) + ")"
SQL["rater_agreement"] = agreement_sql(
    _long, f"select count(*) from {JUDGE} j full outer join {HUMAN} h using (message_id) "
           "where j.message_id is null or h.message_id is null")

SQL["label_agreement"] = agreement_sql(
    "(select 'quality_vs_nontoxic' as dimension, quality as judge, 1 - toxic as human from labels)", None)

# ---------------------------------------------------------------- TF-IDF and retrieval

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def weights_sql(src: str, id_col: str, text_col: str, vocab: str) -> str:
    return f"""(select id, term, raw / sqrt(sum(raw * raw) over (partition by id)) as weight from (
      select id, term, tf * idf as raw from (
        select id, term, count(*) as tf from (
          select id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) as term
          from (select {id_col} as id, regexp_extract_all(lower({text_col}), '{TOKEN_RE}') as toks from {src}))
        group by id, term) join {vocab} using (term)))"""


def vocab_sql(src: str, text_col: str, max_features: int = 5000) -> str:
    return f"""(select term, ln((1 + (select count(*) from {src}))::double / (1 + df)) + 1 as idf from (
      select term, sum(tf) as total, count(*) as df from (
        select id, term, count(*) as tf from (
          select id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) as term
          from (select row_number() over () as id, regexp_extract_all(lower({text_col}), '{TOKEN_RE}') as toks from {src}))
        group by id, term)
      group by term order by total desc, term limit {max_features}))"""


def topk_sql(q_src, qid, qtext, p_src, pid, ptext, k=3) -> str:
    """k hits per query: shared terms first, then rows of similarity 0, ties by pool id."""
    v = vocab_sql(p_src, ptext)
    return f"""(select * from (
      select a.qid, a.pid, coalesce(s.sim_raw, 0.0) as sim_raw, round(coalesce(s.sim_raw, 0.0), 6) as similarity,
             row_number() over (partition by a.qid order by s.sim_raw is null, round(coalesce(s.sim_raw, 0.0), 6) desc, a.pid) as rank
      from (select q0.{qid} as qid, p0.{pid} as pid from {q_src} q0 cross join {p_src} p0) a
      left join (select q.id as qid, p.id as pid, sum(q.weight * p.weight) as sim_raw
            from {weights_sql(q_src, qid, qtext, v)} q join {weights_sql(p_src, pid, ptext, v)} p using (term)
            group by 1, 2) s using (qid, pid))
    where rank <= {k})"""


SQL["tfidf_weights"] = f"""
select id as doc_id, term, round(weight, 6) as weight
from {weights_sql('documents', 'doc_id', 'text', vocab_sql('documents', 'text'))}"""

BENCH_TOPK = topk_sql("benchmark", "item_id", "text", "documents", "doc_id", "text")
SQL["tfidf_topk"] = f"select qid as item_id, rank::int as rank, pid as doc_id, similarity from {BENCH_TOPK}"
SQL["weak_grounding"] = f"""
select b.item_id, h.max_similarity, coalesce(h.n_hits, 0) as n_hits, coalesce(h.max_similarity, 0.0) < 0.2 as weak
from benchmark b left join (select qid, max(similarity) as max_similarity, count(*) as n_hits
                            from {BENCH_TOPK} group by qid) h on h.qid = b.item_id"""

CONV_POOL = f"(select * from {PAIRS} where cust_tweet_id not in (select message_id from {CONV_GOLDEN_IDS}))"
CONV_QUERIES = f"(select tweet_id as message_id, text from {MSGS} where tweet_id in (select message_id from {CONV_GOLDEN_IDS}))"
CONV_HITS = f"""(select h.qid as message_id, h.rank, h.sim_raw, p.cust_text, p.brand_reply
   from {topk_sql(CONV_QUERIES, 'message_id', 'text', CONV_POOL, 'reply_tweet_id', 'cust_text')} h
   join {CONV_POOL} p on p.reply_tweet_id = h.pid)"""

SQL["grounding_text"] = f"""
select message_id, count(*)::int as n_hits,
       string_agg('- Similar past message: "' || cust_text || '" -> Brand''s actual reply: "' || brand_reply
                  || '" (similarity: ' || printf('%.2f', sim_raw) || ')', chr(10) order by rank) as grounding_text
from {CONV_HITS} group by message_id"""

SQL["grounding_summary"] = f"""
select message_id, string_agg(substr(brand_reply, 1, 80), '; ' order by rank) as agent_grounding_summary
from {CONV_HITS} where rank <= 2 group by message_id"""

# ---------------------------------------------------------------- prompts and responses

from ..functions import prompts as _P  # noqa: E402
import json as _json  # noqa: E402
import string as _string  # noqa: E402


def fill_sql(template: str, **values: str) -> str:
    parts = []
    for literal, field, _, _ in _string.Formatter().parse(template):
        if literal:
            parts.append(q(literal))
        if field is not None:
            parts.append(values[field])
    return "(" + " || ".join(parts) + ")"


SQL["prompts_classify"] = f"""
select doc_id, {fill_sql(_P.CLASSIFY_TEMPLATE, brand=q(FX.BRAND), intents=q(_json.dumps(_P.REFERENCE_INTENTS)),
                         text='text')} as prompt from documents"""

GOLDEN_HITS = f"""(select h.qid as message_id, h.rank, h.sim_raw, p.cust_text, p.brand_reply
   from {topk_sql('(select message_id, text from ' + GOLDEN + ')', 'message_id', 'text', PAIRS, 'reply_tweet_id',
                  'cust_text')} h
   join {PAIRS} p on p.reply_tweet_id = h.pid)"""

GROUNDED = f"""(
  select g.message_id, g.text, coalesce(g.pred_intent, 'other_unclear') as intent,
         coalesce(gt.grounding_text, '') as grounding_text, coalesce(gs.summary, '') as grounding_summary,
         coalesce(top.brand_reply, '') as draft_reply, g.pred_escalate
  from {GOLDEN_PRED} g
  left join (select message_id, string_agg('- Similar past message: "' || cust_text || '" -> Brand''s actual reply: "'
                     || brand_reply || '" (similarity: ' || printf('%.2f', sim_raw) || ')', chr(10) order by rank)
                     as grounding_text from {GOLDEN_HITS} group by message_id) gt using (message_id)
  left join (select message_id, string_agg(substr(brand_reply, 1, 80), '; ' order by rank) as summary
             from {GOLDEN_HITS} where rank <= 2 group by message_id) gs using (message_id)
  left join (select message_id, brand_reply from {GOLDEN_HITS} where rank = 1) top using (message_id))"""

SQL["prompts_draft"] = f"""
select message_id, {fill_sql(_P.DRAFT_TEMPLATE, brand=q(FX.BRAND), message='text', intent='intent',
                             grounding_text='grounding_text')} as prompt from {GROUNDED}"""

SQL["prompts_escalate"] = f"""
select message_id, {fill_sql(_P.ESCALATE_TEMPLATE, brand=q(FX.BRAND), message='text', intent='intent',
                             grounding_text='grounding_text', draft_reply='draft_reply')} as prompt from {GROUNDED}"""

SQL["prompts_judge"] = f"""
select message_id, {fill_sql(_P.JUDGE_TEMPLATE, message='text', grounding='grounding_summary',
                             draft_reply='draft_reply',
                             escalate="(case when pred_escalate is null then 'None' when pred_escalate then 'True' else 'False' end)",
                             escalation_reason="'None'")} as prompt from {GROUNDED}"""

_RESP_SHAPES = [
    """'{"intent": "' || lang || '", "confidence": 0.8, "reasoning": "from ' || source || '"}'""",
    """'```json' || chr(10) || '{"intent": "' || lang || '", "confidence": 0.8, "reasoning": "from ' || source || '"}' || chr(10) || '```'""",
    """'{"intent": "' || lang || '", "confidence": 0.8, "reasoning": "from ' || source || '"}' || ' Hope this helps.'""",
    """'Sure! ' || '{"intent": "' || lang || '", "confidence": 0.8, "reasoning": "from ' || source || '"}'""",
    """'{"intent": "' || lang || '", "meta": {"k": 1}, "confidence": 0.7} }'""",
    """'{"intent": "' || lang || '", "reasoning": "line one' || chr(10) || 'line two"}'""",
    """'{"intent": "xx", "intent": "' || lang || '"}'""",
    """'{"confidence": 0.4}'""",
    """'{''intent'': ''' || lang || '''}'""",
    """'["' || lang || '"]'""",
    """'I am not sure.'""",
    """'{"intent": "' || lang || '", "confidence": 0.6'""",
    """'   '""",
    """'{"intent": "' || lang || '", "reasoning": "a } b"}'""",
    """'nosj {"intent": "' || lang || '"}'""",
    "null",
]
RESPONSES = "(select doc_id, shape, case shape " + " ".join(
    f"when {i} then {e}" for i, e in enumerate(_RESP_SHAPES)) + \
    " end as raw from (select doc_id, lang, source, (('0x' || substr(md5(doc_id::varchar), 1, 2))::int % 16)::int as shape from documents))"

_WS_TRIM = f"'^{WS_CLASS}+|{WS_CLASS}+$'"
STRIPPED = f"""(select doc_id, shape, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,
    {_WS_TRIM}, '', 'g'), '^[`json]+|[`json]+$', '', 'g'), '^`+|`+$', '', 'g'), {_WS_TRIM}, '', 'g'), '') as text
  from {RESPONSES})"""

SQL["json_block"] = f"""
with s as {STRIPPED},
t as (select doc_id, shape, text, instr(text, '{{') as st,
             case when instr(text, '{{') > 0 then substr(text, instr(text, '{{')) end as tail from s),
c as (select doc_id, i, sum(case substr(tail, i, 1) when '{{' then 1 when '}}' then -1 else 0 end)
                 over (partition by doc_id order by i) as depth, substr(tail, i, 1) as ch
      from t, range(1, length(tail) + 1) r(i) where tail is not null),
e as (select doc_id, min(i) as end_pos from c where ch = '}}' and depth = 0 group by doc_id)
select t.doc_id, t.shape, t.text,
       case when t.st = 0 or t.st is null then t.text when e.end_pos is not null then substr(t.tail, 1, e.end_pos::int)
            else t.tail end as block
from t left join e using (doc_id)"""

SQL["scan_ledger"] = """
select 'golden_set_a' as export, 'read' as status, count(*) as n_records, count(*) filter (doc_id % 7 = 0) as n_failed from labels
union all select 'golden_set_b', 'columns missing', 0, 0"""

SQL["csv_roundtrip"] = f"""
select message_id, text, difficulty_bucket, difficulty_score, true_intent, true_escalate from {GOLDEN}"""

SQL["pool_roundtrip"] = f"select cust_tweet_id, cust_text, brand_reply from {CONV_POOL}"
SQL["exclusion_ids"] = f"select distinct message_id from {CONV_GOLDEN_IDS}"
SQL["label_events"] = """
select doc_id as message_id, case when doc_id % 7 = 0 then toxic <> 1 else toxic = 1 end as true_escalate,
       case when doc_id % 7 = 0 then 2 else 1 end as written_at, case when doc_id % 7 = 0 then 2 else 1 end::bigint as n_events
from labels"""

_PARSED = f"""
with jb as ({SQL["json_block"]}),
p as (
  select *, case when json_valid(text) and starts_with(text, '{{') then 'strict'
                 when json_valid(block) and starts_with(block, '{{') then 'block'
                 when json_valid(replace(block, chr(10), '\\n')) and starts_with(block, '{{') then 'lenient' end as parse_path
  from jb),
v as (
  select *, case parse_path when 'strict' then text when 'block' then block when 'lenient' then replace(block, chr(10), '\\n') end as js,
         case when text is null then 'empty_response' when parse_path is null then 'invalid_json' end as error
  from p),
kv as (
  select v.doc_id, e.key, arg_max(coalesce(json_extract_string(e.value, '$'), e.value::varchar), e.id) as val, min(e.id) as pos
  from (select * from v where js is not null) v, json_each(v.js) e group by v.doc_id, e.key)"""

SQL["json_parsed"] = f"""{_PARSED},
m as (select doc_id, count(*)::int as n_keys,
             '{{' || string_agg(to_json(key)::varchar || ':' || to_json(val)::varchar, ',' order by pos) || '}}' as parsed_json
      from kv group by doc_id)
select v.doc_id, v.shape, v.parse_path, v.error, m.n_keys, m.parsed_json from v left join m using (doc_id)"""

SQL["required_fields"] = f"""{_PARSED},
f as (select doc_id, max(val) filter (where key = 'intent') as intent,
             case when count(*) filter (where key = 'confidence') > 0
                  then try_cast(max(val) filter (where key = 'confidence') as double) else 0.5 end as confidence
      from kv group by doc_id)
select v.doc_id, v.shape, f.intent, coalesce(f.confidence, 0.5) as confidence,
       coalesce(v.error, case when f.intent is null then 'missing_field:intent' end) as error
from v left join f using (doc_id)"""

# ---------------------------------------------------------------- model stages
# The stub's replies are a function of the prompt's md5 and the attempt, so every stage has a twin.


def _hex(h: str, start: int, n: int) -> str:
    return f"('0x' || substr({h}, {start}, {n}))::bigint"


def _path(h: str, newline_breaks: bool) -> str:
    shape = f"{_hex(h, 6, 1)} % 4"
    third = "'lenient'" if newline_breaks else "'strict'"
    return f"case {shape} when 2 then 'block' when 3 then {third} else 'strict' end"


_STUB = "case when {h}[6:6] = '3' or {h}[6:6] = '7' or {h}[6:6] = 'b' or {h}[6:6] = 'f' then 'stub' || chr(10) || 'line' else 'stub' end"
_CLASSIFY = f"""(select message_id, text, difficulty_bucket, true_intent, true_escalate, h, h[1:1] <> '0' as ok from (
   select *, md5({fill_sql(_P.CLASSIFY_TEMPLATE, brand=q(FX.BRAND), intents=q(_json.dumps(_P.REFERENCE_INTENTS)), text='text')}) as h
   from {GOLDEN}))"""
_INTENT = f"['en', 'de', 'es', 'fr'][1 + {_hex('h', 2, 4)} % 4]"

SQL["stage_classify"] = f"""
select message_id, case when ok then {_INTENT} end as llm_pred_intent,
       case when ok then round(({_hex('h', 2, 4)} % 100) / 100, 2) else 0.5 end as confidence,
       case when ok then {_path('h', True)} end as parse_path,
       case when not ok then 3 when h[1:1] = '1' or h[7:7] = '0' then 2 else 1 end as attempts,
       case when ok then 'ok' else 'failed' end as status
from {_CLASSIFY}"""

SQL["resume_pending"] = f"""
with c as {_CLASSIFY}, n as (select count(*) as n, count(*) filter (where h[1:1] not in ('0', '1')) as n_ok_first,
  count(*) filter (where ok) as n_ok_final from c)
select 1 as run, n as n_calls, n_ok_final, n_ok_first from n
union all select 2, n - n_ok_first, n_ok_final, n_ok_first from n where n > n_ok_first"""

_AGENT = f"""
with c as {_CLASSIFY},
hits as {GOLDEN_HITS},
g as (select message_id, string_agg('- Similar past message: "' || cust_text || '" -> Brand''s actual reply: "'
        || brand_reply || '" (similarity: ' || printf('%.2f', sim_raw) || ')', chr(10) order by rank) as gt,
        string_agg(substr(brand_reply, 1, 80), '; ' order by rank) filter (where rank <= 2) as gs
      from hits group by message_id),
d0 as (select c.*, {_INTENT} as intent, coalesce(g.gt, '') as gt, g.gs from c left join g using (message_id)),
d as (select *, md5({fill_sql(_P.DRAFT_TEMPLATE, brand=q(FX.BRAND), message='text', intent='intent', grounding_text='gt')}) as hd
      from d0 where ok),
e0 as (select *, 'Thanks for reaching out, we are on it (ref ' || hd[1:6] || ').' as reply from d where hd[1:1] <> '0'),
e as (select *, md5({fill_sql(_P.ESCALATE_TEMPLATE, brand=q(FX.BRAND), message='text', intent='intent', grounding_text='gt',
                              draft_reply='reply')}) as he from e0),
a as (select *, {_hex('he', 2, 4)} % 3 = 0 as esc, {_STUB.format(h='he')} || ' reason ' || ({_hex('he', 2, 4)} % 7) as reason
      from e where he[1:1] <> '0'),
j0 as (select *, md5({fill_sql(_P.JUDGE_TEMPLATE, message='text', grounding="coalesce(gs, '')", draft_reply='reply',
                               escalate="(case when esc then 'True' else 'False' end)", escalation_reason='reason')}) as hj from a),
j as (select *, hj[1:1] <> '0' as jok, {_hex('hj', 2, 4)} as n from j0)"""

SQL["agent_batch"] = f"""{_AGENT}
select d0.message_id, case when d0.ok then d0.intent end as llm_pred_intent, a.esc as agent_escalate,
       a.reply as agent_draft_reply, a.reason as agent_escalation_reason, d0.gs as agent_grounding_summary
from d0 left join a using (message_id)"""

SQL["judge_stage"] = f"""{_AGENT}
select message_id, case when jok then 1 + n % 5 end::int as judge_accuracy, case when jok then 1 + (n // 5) % 5 end::int as judge_relevance,
       case when jok then case when n % 6 = 2 then 3 else 1 + (n // 25) % 5 end end::int as judge_tone,
       case when jok then 1 + (n // 125) % 5 end::int as judge_escalation_judgment,
       case when jok then 1 + (n // 625) % 5 end::int as judge_overall,
       case when jok then {_STUB.format(h='hj')} || ' note' || case when n % 6 = 2
            then ' [warning: fields [''tone''] defaulted, not real model output]' else '' end end as judge_notes,
       case when jok then 'ok' else 'failed' end as status
from j"""

SQL["completion_counts"] = f"""{_AGENT}
select (select count(*) from c) as n_rows, count(*) as n_a_done, count(*) filter (where jok) as n_b_done,
       count(*) filter (where jok) as n_fully_done, (select count(*) from c) - count(*) filter (where jok) as n_incomplete
from j"""

SQL["summary_json"] = f"""{_AGENT},
r as (select g.true_intent, g.true_escalate, d0.ok, d0.intent, a.esc, a.message_id is not null as drafted, j.jok
      from {GOLDEN} g left join d0 using (message_id) left join a using (message_id) left join j using (message_id))
select round((select max(k) from (select count(*) as k from r group by true_intent)) / count(*)::double, 6) as trivial_accuracy,
       round(count(*) filter (where ok and intent = true_intent) / count(*)::double, 6) as llm_classifier_accuracy,
       round(count(*) filter (where esc = true_escalate) / count(true_escalate)::double, 6) as escalation_accuracy,
       count(*) as n_golden_set, count(*) filter (where true_escalate is null) as n_unknown_escalation,
       count(*) filter (where drafted) as n_agent_completed, count(*) filter (where jok) as n_judged
from r"""

SQL["logreg_certificate"] = f"""
select (select count(*) from {GOLDEN} where true_intent is not null) as n, (select count(*) from {vocab_sql(GOLDEN, 'text')}) as n_terms,
       (select count(distinct true_intent) from {GOLDEN}) as n_classes, true as gradient_ok, true as gap_ok"""

# Fuzzy judge keys: common blocks by recursion over (name, word) string pairs, then the picks field by field.

_J = [f"j.judge_{d}" for d in FX.DIMENSIONS]
_NAMES = ["accuracy", "relevance", "tone", "escalation_judgment", "overall"]


def _judge_shape(names=_NAMES, quote="", notes=None, note_key="notes", skip=()) -> str:
    parts = [f"'\"{n}\": {quote}' || {v} || '{quote}'" for n, v, own in zip(names, _J, _NAMES) if own not in skip]
    body = " || ', ' || ".join(parts) + (f" || ', \"{note_key}\": \"{notes}\"'" if notes else "")
    return "'{' || " + body + " || '}'"


_JUDGE_SHAPES = [
    _judge_shape(notes="fine"), _judge_shape([n.replace("judgment", "justment") for n in _NAMES], notes="typo"),
    _judge_shape([n.replace("overall", "overal") for n in _NAMES], notes="short keys", note_key="note"),
    _judge_shape(skip=("tone",)), "'```json' || chr(10) || " + _judge_shape(notes="fenced") + " || chr(10) || '```'",
    _judge_shape([n.replace("accuracy", "acuracy") for n in _NAMES], notes="x"), _judge_shape(quote='"', notes="strings"),
    "'no scores today'"]
_JUDGE_RESPONSES = f"""(select message_id as doc_id, shape, case shape {" ".join(f"when {i} then {e}" for i, e in enumerate(_JUDGE_SHAPES))} end as raw
  from (select *, (('0x' || substr(md5(message_id::varchar), 1, 2))::int % 8)::int as shape from {JUDGE}) j)"""
_JUDGE_PARSED = _PARSED.replace(RESPONSES, _JUDGE_RESPONSES).replace("with jb as", "with recursive jb as", 1)
_FIELDS = [*_NAMES, "notes"]


def _best(a: str, b: str) -> str:
    return f"""list_min(list_filter(flatten(list_transform(range(1, length({b}) + 1), lambda j: list_transform(range(j, length({b}) + 1),
      lambda e: [-(e - j + 1), instr({a}, {b}[j:e]), j]))), lambda x: x[2] > 0))"""


_VALUES = ",\n".join(
    f"       case when v.js is null then null when k.picks[{i}] is null then 3 when try_cast(v{i}.val as double) = floor(try_cast(v{i}.val as double)) "
    f"then try_cast(v{i}.val as double)::int end as {f}" for i, f in enumerate(_NAMES, 1))
_JOINS = " ".join(f"left join kv v{i} on v{i}.doc_id = v.doc_id and v{i}.key = k.picks[{i}]" for i in range(1, 7))

SQL["judge_fields"] = f"""{_JUDGE_PARSED},
f as (select unnest(range(1, 7)) as i, unnest({_FIELDS!r}) as f),
pair as (select distinct f, key from kv, f),
rec as (
  select f, key, key as a, f as b, {_best("key", "f")} as x from pair
  union all
  select f, key, c.a, c.b, {_best("c.a", "c.b")} from (
    select f, key, unnest([{{'a': a[1:x[2] - 1], 'b': b[1:x[3] - 1]}}, {{'a': a[x[2] - x[1]:], 'b': b[x[3] - x[1]:]}}]) as c
    from rec where x is not null) where c.a <> '' and c.b <> ''),
sim as (select f, key, 2.0::double * sum(-x[1]) / (length(f) + length(key)) as r from rec where x is not null group by f, key),
cand as (
  select d.doc_id, f.i, f.f, bool_or(kv.key = f.f) as own, list(sim.key order by sim.r desc, sim.key desc) filter (where sim.r >= 0.6) as ks
  from (select doc_id from v where js is not null) d cross join f left join kv on kv.doc_id = d.doc_id
  left join sim on sim.f = f.f and sim.key = kv.key group by d.doc_id, f.i, f.f),
pick as (
  select distinct doc_id, 0::bigint as i, []::varchar[] as picks from cand
  union all
  select p.doc_id, p.i + 1, list_append(p.picks, case when c.own then c.f else list_filter(c.ks, lambda k: not list_contains(p.picks, k))[1] end)
  from pick p join cand c on c.doc_id = p.doc_id and c.i = p.i + 1),
k as (select * from pick where i = 6),
m as (select doc_id, string_agg(case when k.picks[f.i] is null then f.f end, ',' order by f.i) as defaulted,
             string_agg(case when k.picks[f.i] is null then chr(39) || f.f || chr(39) end, ', ' order by f.i) as quoted,
             string_agg(case when k.picks[f.i] <> f.f then f.f || '<-' || k.picks[f.i] end, ',' order by f.i) as recovered
      from k, f group by doc_id)
select v.doc_id as message_id, v.shape, v.parse_path,
{_VALUES},
       case when v.js is not null then trim(coalesce(v6.val, '') || case when m.quoted is null then ''
            else ' [warning: fields [' || m.quoted || '] defaulted, not real model output]' end) end as notes,
       coalesce(m.defaulted, '') as defaulted, coalesce(m.recovered, '') as recovered
from v left join k using (doc_id) left join m using (doc_id) {_JOINS}"""

