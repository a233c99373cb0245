"""Contract queries for the trained vocabulary: pair counts (B3), training
(B4), encode (B5), decode round trip (B7), listing (X4), QA ids (P11) and
routed batch encoding (F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import bpe
from ..operators import encode as en
from ..operators import pretokenize as pt
from ..operators import qa
from ..tables import table
from .common import prefix_space_sql, pretokens_sql, register, tok_docs, tok_text_sql

#: The reference's vocabulary with the full byte alphabet; training stops short
#: of it only when no pair reaches the least frequency.
VOCAB_SIZE, MIN_FREQUENCY = 60_000, 2


def trained_model(spark, sf: str, vocab_size: int = VOCAB_SIZE) -> bpe.BpeModel:
    """BPE model over the cleaned documents."""
    return bpe.train_bpe(pt.word_counts(tok_docs(spark, sf)), vocab_size=vocab_size, min_frequency=MIN_FREQUENCY)


# First-round pair counts ----------------------------------------------------
@register("bpe_pair_counts", f"""
with t as (select token, count(*) as n from
             (select unnest({pretokens_sql(tok_text_sql('text'))}) as token from documents) group by token),
 h as (select hex(encode(token)) as h, n from t),
 p as (select substr(h, 2 * i + 1, 2) || ' ' || substr(h, 2 * i + 3, 2) as pair, n
       from (select h, n, unnest(range(len(h) // 2 - 1)) as i from h))
select pair, sum(n)::BIGINT as count from p group by pair having sum(n) >= 2
""")
def bpe_pair_counts(spark, sf):
    words = bpe.words_table(pt.word_counts(tok_docs(spark, sf)))
    return bpe.pair_counts(words, min_frequency=2).select("pair", F.col("count").cast("bigint"))


# Merges and vocabulary (checked against one-at-a-time BPE in tests) ----------
@register("bpe_merges")
def bpe_merges(spark, sf):
    return trained_model(spark, sf).merges_frame(spark)


@register("bpe_vocabulary")
def bpe_vocabulary(spark, sf):
    return trained_model(spark, sf).vocab_frame(spark)


# B5 ---------------------------------------------------------------------------
@register("bpe_encode")
def bpe_encode(spark, sf):
    enc = en.BpeEncoder(trained_model(spark, sf))
    d = enc.encode(tok_docs(spark, sf), "text", "ids")
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                    sq.as_text(F.col("ids")).alias("ids"))


# decode(encode(x)) is x with the prefix space ---------------------------------
@register("bpe_roundtrip", f"""
select doc_id, {prefix_space_sql(tok_text_sql('text'))} as text from documents
""")
def bpe_roundtrip(spark, sf):
    enc = en.BpeEncoder(trained_model(spark, sf))
    d = enc.encode(tok_docs(spark, sf), "text", "ids")
    return d.select("doc_id", enc.decode_column(F.col("ids")).alias("text"))


# Text beside its tokens ------------------------------------------------------
@register("tokenization_listing")
def tokenization_listing(spark, sf):
    enc = en.BpeEncoder(trained_model(spark, sf))
    d = enc.encode(tok_docs(spark, sf), "text", "ids")
    return d.select("doc_id", "text", enc.tokens_column(F.col("ids")).alias("tokens"))


# B10 with the BPE count --------------------------------------------------------
@register("token_count_comparison_bpe")
def token_count_comparison_bpe(spark, sf):
    enc = en.BpeEncoder(trained_model(spark, sf))
    return en.count_comparison(tok_docs(spark, sf), "doc_id", encoder=enc)


# QA ids -------------------------------------------------------------------
@register("qa_encoded")
def qa_encoded(spark, sf):
    enc = en.BpeEncoder(trained_model(spark, sf))
    pairs = qa.pair_turns(table(spark, sf, "conversations"))
    e = qa.encode_prompts(pairs, enc, block_size=128)
    return e.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_input"),
                    F.size("decoder_input_ids").cast("bigint").alias("n_target"),
                    sq.as_text(F.col("input_ids")).alias("input_ids"),
                    sq.as_text(F.col("decoder_input_ids")).alias("decoder_input_ids"))


# routed encode of batches --------------------------------------------------
@register("routed_batches")
def routed_batches(spark, sf):
    enc = en.BpeEncoder(trained_model(spark, sf))
    r = qa.encode_batches(tok_docs(spark, sf), enc, key="doc_id", batch_size=16)
    return r.select("doc_id", "batch_id", "route", F.size("ids").cast("bigint").alias("width"),
                    "causal_width", sq.as_text(F.col("ids")).alias("ids"))
