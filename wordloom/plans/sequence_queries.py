"""Contract queries for token sequences, batching, shuffles and splits.

Sequences here are word ids (a stable MD5 id per whitespace word of the
cleaned document), so every array operator can be checked against SQL
without a trained vocabulary.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..functions import sequences as sq
from ..functions import text as tx
from ..operators import index as ix
from ..tables import table
from .common import (hashed_ids_sql, list_text_sql, register, tok_docs, tok_text,
                     words_sql)

V = 32000
SEED = 7


def _word_ids(spark, sf):
    d = tok_docs(spark, sf)
    return d.select("doc_id", sq.hashed_word_ids(tx.words(F.col("text")), V).alias("ids"))


def _batched_word_ids(spark, sf):
    """Word ids in batches of 16.  The raw texts are batched: ranging reads its
    input twice, so what is made of them is made after it."""
    b = ix.fixed_batches(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 16)
    ids = sq.hashed_word_ids(tx.words(tok_text(F.col("text"))), V)
    return b.select("doc_id", "batch_id", "_pos_in_batch", ids.alias("ids")).withColumn("mask", sq.ones_mask(F.col("ids")))


BASE_SQL = f"(select doc_id, {hashed_ids_sql(words_sql('text'), V)} as ids from documents)"


def _pad_sql(ids: str, width: str, pad: str = "0", side: str = "right") -> str:
    body = f"{ids}[1:{width}]"
    fill = f"list_transform(range(greatest(0, {width} - len({ids}))), lambda x: {pad})"
    return f"list_concat({body}, {fill})" if side == "right" else f"list_concat({fill}, {body})"


def _ones_sql(ids: str) -> str:
    return f"list_transform({ids}, lambda x: 1)"


T = sq.as_text


# F1 + F4: pad / cut to a fixed length, right side ---------------------------
@register("seq_pad_fixed", f"""
select doc_id, {list_text_sql(_pad_sql('ids', '64'))} as ids,
  {list_text_sql(_pad_sql(_ones_sql('ids'), '64'))} as mask,
  {list_text_sql(f"list_transform({_pad_sql('ids', '64')}, lambda x: case when x <> 0 then 1 else 0 end)")} as attention
from {BASE_SQL}
""")
def seq_pad_fixed(spark, sf):
    d = _word_ids(spark, sf).withColumn("mask", sq.ones_mask(F.col("ids")))
    p = sq.dynamic_padding(d, max_length=64)
    return p.select("doc_id", T(F.col("ids")).alias("ids"), T(F.col("mask")).alias("mask"),
                    T(sq.attention_mask(F.col("ids"), dtype="int")).alias("attention"))


# W5 + F1: pad to the batch maximum, left side ---------------------------------
_BATCHED_SQL = f"""(select doc_id, ids,
   (row_number() over (order by doc_id) - 1) // 16 as batch_id from {BASE_SQL})"""


@register("seq_pad_batch_left", f"""
with b as (select *, max(len(ids)) over (partition by batch_id) as w from {_BATCHED_SQL})
select doc_id, batch_id::BIGINT as batch_id, {list_text_sql(_pad_sql('ids', 'w', side='left'))} as ids,
  {list_text_sql(_pad_sql(_ones_sql('ids'), 'w', side='left'))} as mask
from b
""")
def seq_pad_batch_left(spark, sf):
    p = sq.dynamic_padding(_batched_word_ids(spark, sf), batch_col="batch_id", side="left")
    return p.select("doc_id", "batch_id", T(F.col("ids")).alias("ids"), T(F.col("mask")).alias("mask"))


# pad to a multiple of 8 of the batch maximum ------------------------------
@register("seq_pad_multiple", f"""
with b as (select *, (ceil(max(len(ids)) over (partition by batch_id) / 8) * 8)::INTEGER as w
           from {_BATCHED_SQL})
select doc_id, batch_id::BIGINT as batch_id, len({_pad_sql('ids', 'w')})::BIGINT as width,
  {list_text_sql(_pad_sql('ids', 'w'))} as ids
from b
""")
def seq_pad_multiple(spark, sf):
    p = sq.dynamic_padding(_batched_word_ids(spark, sf), batch_col="batch_id", multiple_of=8)
    return p.select("doc_id", "batch_id", F.size("ids").cast("bigint").alias("width"),
                    T(F.col("ids")).alias("ids"))


# one causal mask per distinct batch width, as blocked places per row of it ----
@register("causal_masks", f"""
with w as (select distinct max(len(ids)) over (partition by batch_id) as width from {_BATCHED_SQL}),
 i as (select width, unnest(range(width)) as i from w)
select width::BIGINT as width, i::BIGINT as i, (width - 1 - i)::BIGINT as blocked from i
""")
def causal_masks(spark, sf):
    b = ix.fixed_batches(_word_ids(spark, sf), ["doc_id"], 16)
    widths = b.groupBy("batch_id").agg(F.max(F.size("ids")).alias("width"))
    return sq.causal_mask_rows(widths)


# B6 + F6: pair template and segment ids -------------------------------------
_PAIR_SQL = f"(select doc_id, list_concat([2], ids[1:(len(ids) + 1) // 2], [3], ids[(len(ids) + 1) // 2 + 1:], [3]) as ids from {BASE_SQL})"


@register("seq_segments", f"""
select doc_id, {list_text_sql('ids')} as ids,
  {list_text_sql("list_transform(ids, lambda x, i: case when list_position(ids, 3) > 0 and list_contains(ids, 2) and i > list_position(ids, 3) then 1 else 0 end)")} as segments
from {_PAIR_SQL}
""")
def seq_segments(spark, sf):
    d = _word_ids(spark, sf)
    half = F.floor((F.size("ids") + 1) / 2).cast("int")
    ids = sq.template_pair(F.slice("ids", F.lit(1), half), F.slice("ids", half + 1, F.size("ids") - half))
    d = d.select("doc_id", ids.alias("pair_ids"))
    d = d.withColumn("segments", T(sq.segment_ids(F.col("pair_ids"))))
    return d.select("doc_id", T(F.col("pair_ids")).alias("ids"), "segments")


# masked-LM inputs with keyed draws -------------------------------------------
def _mlm_sql() -> str:
    sel = (f"(not list_contains([0,1,2,3,4,5,6], x) and "
           f"{draws.uniform_sql(SEED, 'sel', 'doc_id', 'i - 1')} < 0.15)")
    kind = draws.uniform_sql(SEED, "kind", "doc_id", "i - 1")
    rnd = f"floor({draws.uniform_sql(SEED, 'tok', 'doc_id', 'i - 1')} * {V})::INTEGER"
    new = (f"case when not {sel} then x when {kind} < 0.8 then 4 when {kind} < 0.9 then {rnd} "
           f"else x end")
    lab = f"case when {sel} then x else -100 end"
    return f"""
select doc_id, {list_text_sql(f'list_transform(ids, lambda x, i: {new})')} as input_ids,
  {list_text_sql(f'list_transform(ids, lambda x, i: {lab})')} as labels
from (select doc_id, list_concat(ids, [3]) as ids from {BASE_SQL})
"""


@register("seq_masked_lm", _mlm_sql())
def seq_masked_lm(spark, sf):
    d = _word_ids(spark, sf).select("doc_id", sq.template_single(F.col("ids")).alias("ids"))
    m = sq.masked_lm(F.col("ids"), F.col("doc_id"), SEED, 0.15, special=list(range(7)), vocab_size=V)
    return d.select("doc_id", T(m["input_ids"]).alias("input_ids"), T(m["labels"]).alias("labels"))


# F8 / A5: length profile with truncation -----------------------------------------
@register("seq_length_profile", f"""
select doc_id, len(ids)::BIGINT as original_length, least(len(ids), 128)::BIGINT as truncated_length,
  greatest(len(ids) - 128, 0)::BIGINT as tail_length,
  {list_text_sql('ids[129:]')} as tail
from {BASE_SQL}
""")
def seq_length_profile(spark, sf):
    d = _word_ids(spark, sf)
    return d.select("doc_id", *sq.length_profile(F.col("ids"), 128),
                    T(sq.truncated_tail(F.col("ids"), 128)).alias("tail"))


# Mask coverage and padding efficiency per batch ----------------------
@register("seq_mask_metrics", f"""
with b as (select doc_id, ids, (row_number() over (order by doc_id) - 1) // 16 as batch_id
           from {BASE_SQL}),
 w as (select *, max(len(ids)) over (partition by batch_id) as width from b)
select batch_id::BIGINT as batch_id, max(width)::BIGINT as width,
  round(avg(len(ids) / width), 6) as mask_coverage,
  round(avg(len(ids) / 128), 6) as padding_efficiency
from w group by batch_id
""")
def seq_mask_metrics(spark, sf):
    p = sq.dynamic_padding(_batched_word_ids(spark, sf), batch_col="batch_id")
    return p.groupBy("batch_id").agg(
        F.max(F.size("ids")).cast("bigint").alias("width"),
        F.round(F.avg(sq.mask_coverage(F.col("mask"))), 6).alias("mask_coverage"),
        F.round(F.avg(sq.padding_efficiency(F.col("mask"), 128)), 6).alias("padding_efficiency"))


# Sequences whose ids and mask differ in length ------------------------------
@register("seq_violations", f"""
select doc_id, len(ids)::BIGINT as n_ids, len(string_split(text, ' '))::BIGINT as n_mask
from (select doc_id, text, {hashed_ids_sql(words_sql('text'), V)} as ids from documents)
where len(ids) <> len(string_split(text, ' '))
""")
def seq_violations(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tok = tok_text(F.col("text"))
    d = raw.select("doc_id", sq.hashed_word_ids(tx.words(tok), V).alias("ids"),
                   sq.ones_mask(F.split("text", " ")).alias("mask"))
    v = sq.sequence_violations(d)
    return v.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                    F.size("mask").cast("bigint").alias("n_mask"))


# Positional zip, shortest side wins ---------------------------------------------
@register("seq_zip", f"""
select doc_id, len(ws)::BIGINT as n_words,
  array_to_string(list_transform(range(1, least(len(ws), len(ids)) + 1),
                  lambda k: ws[k] || ':' || cast(ids[k] as varchar)), ' ') as pairs
from (select doc_id, {words_sql('text')} as ws,
        {hashed_ids_sql(words_sql('text'), V)} as ids from documents)
""")
def seq_zip(spark, sf):
    d = tok_docs(spark, sf).select("doc_id", tx.words(F.col("text")).alias("ws"))
    d = d.withColumn("ids", sq.hashed_word_ids(F.col("ws"), V))
    z = sq.zip_shortest(F.col("ws"), F.col("ids"))
    pairs = F.array_join(F.transform(z, lambda e: F.concat(e["0"], F.lit(":"), e["1"].cast("string"))), " ")
    return d.select("doc_id", F.size("ws").cast("bigint").alias("n_words"), pairs.alias("pairs"))


# Fixed-size batches; blank rows dropped after numbering -------------------
@register("batch_assignment", """
select batch_id::BIGINT as batch_id, count(*)::BIGINT as n_rows from
 (select text, (row_number() over (order by doc_id) - 1) // 64 as batch_id from documents)
where text is not null and regexp_matches(text, '\\S')
group by batch_id
""")
def batch_assignment(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    b = ix.fixed_batches(d, ["doc_id"], 64)
    return (tx.drop_blank(b).groupBy("batch_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))


# Split each batch of 100 into parts of max(1, n div 7) -------------------------
@register("chunk_parts", """
with b as (select doc_id, (row_number() over (order by doc_id) - 1) // 100 as batch_id,
                  (row_number() over (order by doc_id) - 1) % 100 as pos from documents)
select doc_id, batch_id::BIGINT as batch_id,
  (pos // greatest(1, count(*) over (partition by batch_id) // 7))::BIGINT as part from b
""")
def chunk_parts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    b = ix.fixed_batches(d, ["doc_id"], 100)
    return ix.split_chunks(b, "batch_id", "_pos_in_batch", 7).select("doc_id", "batch_id", "part")


# L3: seeded shuffle -----------------------------------------------------------------
_DRAW_SQL = draws.uniform_sql(11, "shuffle", "doc_id")


@register("seeded_shuffle", f"""
select doc_id, (row_number() over (order by {_DRAW_SQL}, doc_id) - 1)::BIGINT as position from documents
""")
def seeded_shuffle(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return ix.seeded_shuffle(d, "doc_id", 11)


# U4: exact 90/10 split --------------------------------------------------------------
@register("exact_split", f"""
select doc_id, case when row_number() over (order by {_DRAW_SQL}, doc_id) - 1
                 < floor(0.9 * (select count(*) from documents)) then 'train' else 'validation' end as split
from documents
""")
def exact_split(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return ix.exact_split(d, "doc_id", 11, 0.9)


# shuffle -> batches of 16 -> pad to a multiple of 8 ------------------------------
@register("batch_collate", f"""
with s as (select doc_id, ids, (row_number() over (order by {_DRAW_SQL}, doc_id) - 1) // 16 as batch_id
           from {BASE_SQL}),
 w as (select *, (ceil(max(len(ids)) over (partition by batch_id) / 8) * 8)::INTEGER as width from s)
select doc_id, batch_id::BIGINT as batch_id, {list_text_sql(_pad_sql('ids', 'width'))} as ids from w
""")
def batch_collate(spark, sf):
    d = _word_ids(spark, sf)
    d = d.withColumn("mask", sq.ones_mask(F.col("ids")))
    c = ix.collate(d, "doc_id", 11, 16, multiple_of=8)
    return c.select("doc_id", "batch_id", T(F.col("ids")).alias("ids"))

