"""Contract queries that compare every value of training and encoding with SQL.

The vocabulary is trained on ``benchmark`` until no pair occurs twice, which a
recursive query can follow merge by merge; the whole texts of the other tables
are then encoded with it.  The SQL encodes each different pre-token by folding
all merges over it in order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import bpe
from ..operators import encode as en
from ..operators import pretokenize as pt
from ..operators import qa
from ..session import shared_dir
from ..sources import sinks
from ..streaming import streams as st
from ..tables import table
from .common import pretokens_sql, register, tok_docs, tok_text, tok_text_sql, word_count_sql
from .stream_queries import stream_table

#: More than the pairs of the table that occur twice: training ends for want of pairs.
NO_BOUND = 10**6

# Symbols are hex in brackets, "[20][61]"; taken out of the brackets at both ends they part at "][".
_TRAINED = f"""
recursive words as materialized (
  select token, count(*) as n from (select unnest({pretokens_sql(tok_text_sql('text'))}) as token from benchmark) group by token),
 steps(k, w, n, l, r, c) as (
  select 0, regexp_replace(hex(encode(token)), '(..)', '[\\1]', 'g'), n, null::VARCHAR, null::VARCHAR, null::BIGINT from words
  union all
  (with s as (select n, string_split(w[2:-2], '][') as q from steps),
   p as (select q[i] as l, q[i + 1] as r, sum(n)::BIGINT as c from (select q, n, unnest(range(1, len(q))) as i from s) group by all),
   b as (select l, r, c from p where c >= 2 order by c desc, l, r limit 1)
   select k + 1, replace(w, '[' || b.l || '][' || b.r || ']', '[' || b.l || b.r || ']'), n, b.l, b.r, b.c from steps, b)),
 merges as materialized (select distinct k, l, r, c from steps where k > 0),
 vocabulary as materialized (
  select 7 + i as id, printf('%02X', i) as h, 'byte' as kind from range(256) b(i)
  union all select 262 + row_number() over (order by min(k)), l || r, 'merge' from merges group by l || r)"""


def _encoded(texts: str) -> str:
    """``texts``: SQL of (key, text).  Adds ``ids_of`` (key, ids, hs): ids and
    hex tokens of each text in order."""
    return f"""{_TRAINED},
 texts as materialized ({texts}),
 places as (select key, unnest(pre) as token, generate_subscripts(pre, 1) as pos
            from (select key, {pretokens_sql('text')} as pre from texts)),
 folds as (select list('[' || l || '][' || r || ']' order by k) as ms from merges),
 coded as materialized (
  select token, string_split(list_reduce(list_concat([regexp_replace(hex(encode(token)), '(..)', '[\\1]', 'g')], ms),
    lambda a, m: replace(a, m, '[' || replace(m[2:-2], '][', '') || ']'))[2:-2], '][') as hs
  from (select distinct token from places), folds),
 flat as (select token, list(id order by i) as ids, any_value(hs) as hs
          from (select token, hs, unnest(hs) as h, generate_subscripts(hs, 1) as i from coded) join vocabulary using (h) group by token),
 ids_of as materialized (
  select key, flatten(list(ids order by pos)) as ids, flatten(list(hs order by pos)) as hs from places join flat using (token) group by key)"""


def _text(x: str) -> str:
    return f"'[' || coalesce(array_to_string({x}, ','), '') || ']'"


_DOCS = f"select doc_id as key, {tok_text_sql('text')} as text from documents"


def benchmark_model(spark, sf: str) -> bpe.BpeModel:
    items = table(spark, sf, "benchmark").select(tok_text(F.col("text")).alias("text"))
    return bpe.train_bpe(pt.word_counts(items), vocab_size=NO_BOUND, min_frequency=2)


# B4 -------------------------------------------------------------------------
@register("benchmark_merges", f"with {_TRAINED} select k - 1 as rank, l as left, r as right, c as count from merges")
def benchmark_merges(spark, sf):
    return benchmark_model(spark, sf).merges_frame(spark).select(F.col("rank").cast("long").alias("rank"), "left", "right", "count")


@register("benchmark_vocabulary", f"with {_TRAINED} select id::BIGINT as id, h as token_hex, kind from vocabulary")
def benchmark_vocabulary(spark, sf):
    v = benchmark_model(spark, sf).vocab_frame(spark).where("kind <> 'special'")
    return v.select(F.col("id").cast("long").alias("id"), "token_hex", "kind")


# B5 -------------------------------------------------------------------------
_IDS_SQL = f"with {_encoded(_DOCS)} select key as doc_id, {_text('ids')} as ids from texts left join ids_of using (key)"


@register("document_ids", _IDS_SQL)
def document_ids(spark, sf):
    enc = en.BpeEncoder(benchmark_model(spark, sf))
    return enc.encode(tok_docs(spark, sf), "text", "ids").select("doc_id", sq.as_text(F.col("ids")).alias("ids"))


@register("document_ids_by_join", _IDS_SQL)
def document_ids_by_join(spark, sf):
    """As ``document_ids``, the vocabulary staying a table."""
    enc = en.BpeEncoder(benchmark_model(spark, sf), ship_up_to=0)
    docs = tok_docs(spark, sf).select("doc_id", "text")
    return enc.encode(docs, "text", "ids", carry=["doc_id"]).select("doc_id", sq.as_text(F.col("ids")).alias("ids"))


# Tokens whose bytes are not whole characters are listed as <bytes> ---------
@register("document_tokens", f"""
with {_encoded(_DOCS)}
select key as doc_id, text, coalesce(array_to_string(list_transform(hs, lambda h: coalesce(try(decode(unhex(h))), '<bytes>')), '|'), '') as tokens
from texts left join ids_of using (key)
""")
def document_tokens(spark, sf):
    enc = en.BpeEncoder(benchmark_model(spark, sf))
    d = enc.encode(tok_docs(spark, sf), "text", "ids")
    shown = F.transform(enc.tokens_column(F.col("ids")), lambda t: F.when(t.contains("�"), "<bytes>").otherwise(t))
    return d.select("doc_id", "text", F.concat_ws("|", shown).alias("tokens"))


# B10 ------------------------------------------------------------------------
@register("document_token_counts", f"""
with {_encoded(_DOCS)}
select key as doc_id, {word_count_sql('text')} as n_words, length(text)::BIGINT as n_chars,
  octet_length(encode(text))::BIGINT as n_bytes, len({pretokens_sql('text')})::BIGINT as n_pretokens,
  coalesce(len(ids), 0)::BIGINT as n_bpe
from texts left join ids_of using (key)
""")
def document_token_counts(spark, sf):
    return en.count_comparison(tok_docs(spark, sf), "doc_id", encoder=en.BpeEncoder(benchmark_model(spark, sf)))


# P11 --------------------------------------------------------------------------
@register("conversation_ids", f"""
with {_encoded(f'''
  select {{'c': conv_id, 't': turn, 'p': 0}} as key, 'question: ' || question || ' context: ' || coalesce(context, '') as text from qa
  union all select {{'c': conv_id, 't': turn, 'p': 1}}, answer from qa where answer is not null''').replace('recursive ', f'''recursive
 turns as (select conv_id, turn, role, {tok_text_sql('text')} as text from conversations),
 qa as materialized (select u.conv_id, u.turn, u.text as question, p.text as context, n.text as answer
  from turns u left join turns n on n.conv_id = u.conv_id and n.turn = u.turn + 1 and n.role = 'assistant'
  left join turns p on p.conv_id = u.conv_id and p.turn = u.turn - 1 and p.role = 'assistant' where u.role = 'user'),
 ''', 1)}
select conv_id, turn, {_text('x.ids[1:128]')} as input_ids,
  case when answer is null then '[0]' else {_text('y.ids[1:128]')} end as decoder_input_ids
from qa left join ids_of x on x.key = {{'c': conv_id, 't': turn, 'p': 0}} left join ids_of y on y.key = {{'c': conv_id, 't': turn, 'p': 1}}
""")
def conversation_ids(spark, sf):
    """Prompt and answer ids of the cleaned turns, cut to 128 as the reference does."""
    turns = table(spark, sf, "conversations").withColumn("text", tok_text(F.col("text")))
    e = qa.encode_prompts(qa.pair_turns(turns), en.BpeEncoder(benchmark_model(spark, sf)), block_size=128)
    return e.select("conv_id", "turn", sq.as_text(F.col("input_ids")).alias("input_ids"),
                    sq.as_text(F.col("decoder_input_ids")).alias("decoder_input_ids"))


# F9 ---------------------------------------------------------------------------
@register("document_batches", f"""
with {_encoded(_DOCS)},
 b as (select key, text, coalesce(ids, []) as ids, (row_number() over (order by key) - 1) // 16 as batch_id from texts left join ids_of using (key)),
 m as (select batch_id, max(len(ids)) as width, avg({word_count_sql('text')}) as mean from b group by batch_id)
select key as doc_id, batch_id::BIGINT as batch_id, case when mean < 512 then 'bi' else 'auto' end as route, width::BIGINT as width,
  case when mean < 512 then null else width end::BIGINT as causal_width,
  '[' || array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: 0)), ',') || ']' as ids
from b join m using (batch_id)
""")
def document_batches(spark, sf):
    enc = en.BpeEncoder(benchmark_model(spark, sf))
    r = qa.encode_batches(tok_docs(spark, sf), enc, key="doc_id", batch_size=16)
    return r.select("doc_id", F.col("batch_id").cast("long").alias("batch_id"), "route", F.size("ids").cast("long").alias("width"),
                    F.col("causal_width").cast("long").alias("causal_width"), sq.as_text(F.col("ids")).alias("ids"))


# T3 ---------------------------------------------------------------------------
@register("stream_document_ids", _IDS_SQL)
def stream_document_ids(spark, sf):
    enc = en.BpeEncoder(benchmark_model(spark, sf))
    s = stream_table(spark, sf, "documents")
    s = s.select("doc_id", tok_text(F.col("text")).alias("text"))
    return st.run_to_table(spark, st.encode_stream(s, enc).select("doc_id", sq.as_text(F.col("ids")).alias("ids")), "ids")


# Two versions of a vocabulary, the newest and the one restored from before it ---
SHORT = 100


@register("model_version_merges", f"""
with {_TRAINED}
select 'newest' as which, 2 as version, k - 1 as rank, l as left, r as right, c as count from merges
union all select 'restored', 1, k - 1, l, r, c from merges where k <= {SHORT}
""")
def model_version_merges(spark, sf):
    items = table(spark, sf, "benchmark").select(tok_text(F.col("text")).alias("text"))
    counts, root = pt.word_counts(items), shared_dir(spark, "versions")
    for size in (263 + SHORT, NO_BOUND):
        sinks.save_model_tables(spark, root, bpe.train_bpe(counts, vocab_size=size, min_frequency=2))
    parts = []
    for which, (v, _, merges) in (("newest", sinks.load_model_tables(spark, root)), ("restored", sinks.restore_previous(spark, root))):
        parts.append(merges.select(F.lit(which).alias("which"), F.lit(v).alias("version"), F.col("rank").cast("long").alias("rank"),
                                   "left", "right", "count"))
    return parts[0].unionByName(parts[1])
