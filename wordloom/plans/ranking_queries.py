"""Contract queries for ranking on logits, metrics, sets and QA pairing.

``embeddings`` rows serve as logits rows: the vector is the logits over a
64-entry vocabulary and ``label`` the target index (0 = padding).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..functions import sequences as sq
from ..functions import text as tx
from ..operators import encode as en
from ..operators import metrics as mt
from ..operators import pretokenize as pt
from ..operators import qa
from ..operators import ranking as rk
from ..tables import table
from .common import (list_text_sql, pretokens_sql, register, tok_docs, tok_text,
                     tok_text_sql, word_count_sql)


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


_X = "list_transform(embedding, lambda v: v::DOUBLE)"
_SOFT = f"""(select vec_id, label, x, list_transform(e, lambda v: v / list_sum(e)) as p from
  (select vec_id, label, x, list_transform(x, lambda v: exp(v - list_max(x))) as e from
    (select vec_id, label, list_transform({_X}, lambda v: v / {{t}}) as x from embeddings)))"""


# W3 ---------------------------------------------------------------------------
@register("logits_softmax", f"""
select vec_id, round(p[label + 1], 6) as p_label, round(list_max(p), 6) as p_max
from {_SOFT.format(t='2.0')}
""")
def logits_softmax(spark, sf):
    e = rk.add_softmax(_emb(spark, sf), "embedding", "p", 2.0)
    return e.select("vec_id", F.round(F.element_at("p", F.col("label") + 1), 6).alias("p_label"),
                    F.round(F.array_max("p"), 6).alias("p_max"))


# W2 ---------------------------------------------------------------------------
@register("logits_top_k", f"""
select vec_id, {list_text_sql("list_filter(range(len(x)), lambda i: x[i + 1] >= list_sort(x, 'DESC')[5])")} as kept
from (select vec_id, {_X} as x from embeddings)
""")
def logits_top_k(spark, sf):
    e = rk.add_top_k(_emb(spark, sf), "embedding", 5)
    return e.select("vec_id", sq.as_text(rk.kept_ids(F.col("filtered"))).alias("kept"))


@register("logits_top_k_long", """
select vec_id, token_id from (
  select vec_id, token_id, rank() over (partition by vec_id order by logit desc) as r
  from (select vec_id, unnest(embedding) as logit, generate_subscripts(embedding, 1) - 1 as token_id
        from embeddings))
where r <= 5
""")
def logits_top_k_long(spark, sf):
    long = rk.explode_logits(_emb(spark, sf), "vec_id", "embedding")
    return rk.top_k_long(long, "vec_id", 5).select("vec_id", F.col("token_id").cast("bigint"))


# W1 ---------------------------------------------------------------------------
_SORTED = f"""(select vec_id, list_sort(list_transform(range(len(p)), lambda i: {{'np': -p[i + 1], 'i': i}})) as s
  from {_SOFT.format(t='1.0')})"""


@register("logits_top_p", f"""
select vec_id, {list_text_sql("list_sort(list_transform(list_filter(range(1, len(s) + 1), lambda j: j = 1 or -list_sum(list_transform(s[1:j - 1], lambda e: e.np)) <= 0.5), lambda j: s[j].i))")} as kept
from {_SORTED}
""")
def logits_top_p(spark, sf):
    e = rk.add_top_p(_emb(spark, sf), "embedding", 0.5)
    return e.select("vec_id", sq.as_text(rk.kept_ids(F.col("filtered"))).alias("kept"))


@register("logits_top_p_long", """
with l as (select vec_id, unnest(embedding)::DOUBLE as logit, generate_subscripts(embedding, 1) - 1 as token_id
           from embeddings),
 p as (select vec_id, token_id, exp(logit - max(logit) over (partition by vec_id)) as e from l),
 q as (select vec_id, token_id, e / sum(e) over (partition by vec_id) as prob from p),
 c as (select vec_id, token_id, coalesce(sum(prob) over (partition by vec_id order by prob desc, token_id
        rows between unbounded preceding and 1 preceding), 0) as before from q)
select vec_id, token_id from c where before <= 0.5
""")
def logits_top_p_long(spark, sf):
    long = rk.explode_logits(_emb(spark, sf), "vec_id", "embedding")
    return rk.top_p_long(long, "vec_id", 0.5).select("vec_id", F.col("token_id").cast("bigint"))


# W4 ---------------------------------------------------------------------------
@register("logits_draw", f"""
select vec_id, coalesce(list_filter(range(len(p)), lambda i: list_sum(p[1:i + 1]) >= u)[1], len(p) - 1)::INTEGER as token
from (select vec_id, p, {draws.uniform_sql(5, 'draw', 'vec_id')} as u from {_SOFT.format(t='1.0')})
""")
def logits_draw(spark, sf):
    e = rk.add_categorical_draw(_emb(spark, sf), "embedding", "vec_id", 5)
    return e.select("vec_id", "token")


# A9 ---------------------------------------------------------------------------
@register("logits_cross_entropy", f"""
with l as (select vec_id // 16 as batch_id,
   list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[label + 1] as loss
   from (select vec_id, label, {_X} as x from embeddings) where label <> 0)
select round(avg(loss), 6) as loss_mean, round(avg(bl), 6) as loss_batch_mean from
 (select batch_id, avg(loss) as bl, sum(loss) as s, count(*) as n from l group by batch_id) b,
 (select avg(loss) as loss from l) a
""")
def logits_cross_entropy(spark, sf):
    e = _emb(spark, sf).withColumn("batch_id", F.floor(F.col("vec_id") / 16))
    r = rk.masked_cross_entropy(e, "embedding", "label", pad=0, batch_col="batch_id")
    return r.select(F.round("loss_mean", 6).alias("loss_mean"), F.round("loss_batch_mean", 6).alias("loss_batch_mean"))


# W7 ---------------------------------------------------------------------------
@register("latest_order_per_customer", """
select o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r
  from orders) where r = 1
""")
def latest_order_per_customer(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    r = rk.latest_per_group(o, ["o_custkey"], "o_orderdate", "o_orderkey")
    return r.select("o_custkey", "o_orderkey",
                    F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))


# W8 ---------------------------------------------------------------------------
@register("running_totals", f"""
select source, doc_id,
  count(*) over (partition by source order by doc_id rows between unbounded preceding and current row)::BIGINT as items_so_far,
  sum({word_count_sql('text')}) over (partition by source order by doc_id rows between unbounded preceding and current row)::BIGINT as tokens_so_far
from documents
""")
def running_totals(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", tx.word_count(F.col("text")).alias("tokens"))
    return rk.running_totals(d, "source", "doc_id", "tokens").select(
        "source", "doc_id", "items_so_far", "tokens_so_far")


# A10 --------------------------------------------------------------------------
def _daily(spark, sf):
    ev = table(spark, sf, "events")
    return (ev.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
              .agg(F.avg("value").alias("v")))


@register("series_best_step", """
with d as (select user_id, strftime(ts, '%Y-%m-%d') as day, avg(value) as v from events group by 1, 2)
select user_id, count(*) over (partition by user_id)::BIGINT as n_steps, day as best_step, round(v, 6) as best_value
from d qualify row_number() over (partition by user_id order by v, day) = 1
""")
def series_best_step(spark, sf):
    r = mt.series_fold(_daily(spark, sf), "user_id", "day", "v")
    return r.select("user_id", "n_steps", "best_step", F.round("best_value", 6).alias("best_value"))


_FOLD = ("list_reduce(list_transform(list_sort(list(struct_pack(s := day, v := v))), "
         "lambda e: struct_pack(best := e.v, cnt := 0, stop := NULL::VARCHAR, s := e.s, v := e.v)), "
         "lambda a, e: struct_pack("
         "best := case when e.v > a.best then a.best else e.v end, "
         "cnt := case when e.v > a.best then a.cnt + 1 else 0 end, "
         "stop := case when a.stop is null and e.v > a.best and a.cnt + 1 >= 3 then e.s else a.stop end, "
         "s := e.s, v := e.v))")


@register("series_early_stop", f"""
with d as (select user_id, strftime(ts, '%Y-%m-%d') as day, avg(value) as v from events group by 1, 2),
 b as (select user_id, day as best_step, round(v, 6) as best_value from d
       qualify row_number() over (partition by user_id order by v, day) = 1),
 f as (select user_id, count(*)::BIGINT as n_steps, {_FOLD}.stop as stop_step from d group by user_id)
select f.user_id, n_steps, best_step, best_value, stop_step from f join b using (user_id)
""")
def series_early_stop(spark, sf):
    r = mt.series_fold(_daily(spark, sf), "user_id", "day", "v", patience=3)
    return r.select("user_id", "n_steps", "best_step", F.round("best_value", 6).alias("best_value"),
                    "stop_step")


# A4 ---------------------------------------------------------------------------
@register("dataset_metrics", f"""
select source, count(*)::BIGINT as items,
  count(text)::BIGINT as processed_items, count(*) filter (where text is null)::BIGINT as failed_items,
  coalesce(sum(len({pretokens_sql(tok_text_sql('text'))})), 0)::BIGINT as total_tokens,
  round(avg(len({pretokens_sql(tok_text_sql('text'))})), 6) as mean_tokens
from documents group by source
""")
def dataset_metrics(spark, sf):
    d = table(spark, sf, "documents")
    tok = tok_text(F.col("text"))
    d = d.select("source", F.col("text").isNotNull().alias("ok"), F.size(pt.pretokens(tok)).alias("tokens"))
    return mt.dataset_metrics(d, "source", "ok", "tokens")


@register("dataset_messages", """
with m as (
  select source, 'error' as kind, 'no text' as message from documents where text is null
  union all select source, 'error', 'blank text' from documents where not regexp_matches(text, '\\S')
  union all select source, 'warning', 'recorded length differs by ' || (length(text) - n_chars) from documents where length(text) <> n_chars
  union all select source, 'warning', 'longer than 10000 characters' from documents where length(text) > 10000
  union all select source, 'warning', 'replacement characters' from documents where contains(text, chr(65533))),
 c as (select source, kind, message, count(*) as n from m group by all)
select source, kind, message, n, row_number() over (partition by source order by n desc, kind, message)::INT as rank
from c qualify rank <= 10
""")
def dataset_messages(spark, sf):
    """Errors and warnings of each source, the most frequent first."""
    d = table(spark, sf, "documents")
    d = d.select("source", mt.item_messages(F.col("text"), F.col("n_chars")).alias("messages"))
    return mt.message_report(d, "source", "messages")


# A1 / A2 / A3 / B8 / U2 / U3 ------------------------------------------------------
def _doc_tokens(spark, sf):
    return tok_docs(spark, sf).select(F.explode(pt.pretokens(F.col("text"))).alias("token"))


def _bench_vocab(spark, sf):
    b = table(spark, sf, "benchmark")
    t = tok_text(F.col("text"))
    return b.select(F.explode(pt.pretokens(t)).alias("token")).distinct()


_DOC_TOK_SQL = f"(select unnest({pretokens_sql(tok_text_sql('text'))}) as token from documents)"
_BENCH_VOCAB_SQL = f"(select distinct unnest({pretokens_sql(tok_text_sql('text'))}) as token from benchmark)"


@register("token_coverage", f"""
with f as (select token, count(*) as n from {_DOC_TOK_SQL} group by token),
 j as (select f.*, v.token is not null as inv from f left join {_BENCH_VOCAB_SQL} v using (token)),
 a as (select sum(n)::BIGINT as total_tokens, sum(case when inv then 0 else n end)::BIGINT as oov_tokens,
         count(*) filter (where not inv)::BIGINT as distinct_oov from j)
select *, round((total_tokens - oov_tokens) / total_tokens * 100.0, 6) as coverage,
  case when (total_tokens - oov_tokens) / total_tokens * 100.0 < 98 then 'low'
       when (total_tokens - oov_tokens) / total_tokens * 100.0 > 99 then 'excellent' else 'acceptable' end as verdict
from a
""")
def token_coverage(spark, sf):
    return en.coverage(en.token_frequencies(_doc_tokens(spark, sf)), _bench_vocab(spark, sf))


@register("oov_examples", f"""
select token, count(*)::BIGINT as n from {_DOC_TOK_SQL}
where token not in (select token from {_BENCH_VOCAB_SQL})
group by token order by n desc, token limit 10
""")
def oov_examples(spark, sf):
    r = en.oov_examples(en.token_frequencies(_doc_tokens(spark, sf)), _bench_vocab(spark, sf), 10)
    return r.select("token", F.col("n").cast("bigint"))


@register("in_vocab_tokens", f"""
select token, count(*)::BIGINT as n from {_DOC_TOK_SQL}
where token in (select token from {_BENCH_VOCAB_SQL}) group by token
""")
def in_vocab_tokens(spark, sf):
    r = en.in_vocab(en.token_frequencies(_doc_tokens(spark, sf)), _bench_vocab(spark, sf))
    return r.select("token", F.col("n").cast("bigint"))


@register("token_set_union", f"""
select token from {_BENCH_VOCAB_SQL}
union
select distinct unnest({pretokens_sql(tok_text_sql('text'))}) as token from conversations
""")
def token_set_union(spark, sf):
    c = table(spark, sf, "conversations")
    t = tok_text(F.col("text"))
    conv = c.select(F.explode(pt.pretokens(t)).alias("token"))
    return _bench_vocab(spark, sf).union(conv).distinct()


@register("token_difference", f"""
select token from {_BENCH_VOCAB_SQL}
except
select token from {_DOC_TOK_SQL}
""")
def token_difference(spark, sf):
    # what is taken away is combined first and no more than the vocabulary
    vocab = _bench_vocab(spark, sf)
    return vocab.subtract(en.in_vocab(_doc_tokens(spark, sf).distinct(), vocab))


# B10 --------------------------------------------------------------------------
@register("token_count_comparison", f"""
select doc_id, {word_count_sql('text')} as n_words, length(text)::BIGINT as n_chars,
  octet_length(encode(text))::BIGINT as n_bytes, len({pretokens_sql('text')})::BIGINT as n_pretokens
from (select doc_id, {tok_text_sql('text')} as text from documents)
""")
def token_count_comparison(spark, sf):
    return en.count_comparison(tok_docs(spark, sf), "doc_id")


# J5 + P11 (text) -----------------------------------------------------------------
@register("qa_prompts", """
with u as (select conv_id, turn, text as question from conversations where role = 'user'),
 a as (select conv_id, turn, text from conversations where role = 'assistant')
select u.conv_id, u.turn, 'question: ' || u.question || ' context: ' || coalesce(p.text, '') as prompt,
  n.text as answer
from u left join a n on n.conv_id = u.conv_id and n.turn = u.turn + 1
       left join a p on p.conv_id = u.conv_id and p.turn = u.turn - 1
""")
def qa_prompts(spark, sf):
    pairs = qa.pair_turns(table(spark, sf, "conversations"))
    return qa.build_prompts(pairs).select("conv_id", "turn", "prompt", "answer")
