"""Question-answer preparation: turn pairing (J5), prompt build (P11),
encoding route (P12), encode paths (F9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sequences import PAD_ID

# --- fixed values: prompt layout and routing threshold ---------------------
QUESTION_PREFIX = "question: "
CONTEXT_PREFIX = " context: "
ROUTE_WORD_LIMIT = 512
BLOCK_SIZE = 128
# ---------------------------------------------------------------------------


def pair_turns(conv: DataFrame) -> DataFrame:
    """A user turn with the assistant turn right after it (same
    conversation, turn + 1) and, as context, the assistant turn right before
    it ('' when none).  One self-join on (conv_id, turn) per side; both sides
    are hash-partitioned on the same keys, so they share one shuffle."""
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    nxt = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    prv = a.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return (u.join(nxt, ["conv_id", "turn"], "left")
             .join(prv, ["conv_id", "turn"], "left")
             .select("conv_id", "turn", "question", F.coalesce("context", F.lit("")).alias("context"),
                     F.struct(F.when(F.col("answer").isNull(), F.array().cast("array<string>"))
                              .otherwise(F.array("answer")).alias("text")).alias("answers")))


def build_prompts(qa: DataFrame) -> DataFrame:
    """P11 (text part): prompt = 'question: ' + q + ' context: ' + c, and the
    first answer (null when there is none)."""
    return qa.withColumn("prompt", F.concat(F.lit(QUESTION_PREFIX), F.col("question"),
                                            F.lit(CONTEXT_PREFIX), F.col("context"))) \
             .withColumn("answer", F.get(F.col("answers.text"), 0))


def encode_prompts(qa: DataFrame, encoder, block_size: int = BLOCK_SIZE,
                   pad: int = PAD_ID) -> DataFrame:
    """P11 (ids): prompt ids cut to block_size; target = first answer's ids cut,
    or [pad] when there is no answer."""
    p = build_prompts(qa)
    p = encoder.encode(p, text_col="prompt", out_col="input_ids")
    p = encoder.encode(p.withColumn("_ans", F.coalesce("answer", F.lit(""))),
                       text_col="_ans", out_col="_target")
    return (p.withColumn("input_ids", F.slice("input_ids", 1, block_size))
             .withColumn("decoder_input_ids",
                         F.when(F.col("answer").isNull(), F.array(F.lit(pad)))
                          .otherwise(F.slice("_target", 1, block_size)))
             .drop("_ans", "_target"))


def encoding_route(df: DataFrame, text_col: str = "text", group_col: str | None = None,
                   task_type: str = "auto") -> DataFrame:
    """Mean whitespace words per batch; < 512 -> 'bi', else 'auto'
    (which means the causal path).  An explicit ``causal`` is honoured; any
    other explicit value means bidirectional."""
    wc = tx.word_count(F.col(text_col))
    g = [group_col] if group_col else []
    agg = df.groupBy(*g).agg(F.avg(wc).alias("_mean"))
    if task_type == "auto":
        route = F.when(F.col("_mean") < ROUTE_WORD_LIMIT, "bi").otherwise("auto")
    elif task_type == "causal":
        route = F.lit("auto")
    else:
        route = F.lit("bi")
    return agg.select(*g, F.round("_mean", 6).alias("mean_words"), route.alias("route"))


def route_rows(df: DataFrame, batch_col: str, text_col: str = "text") -> DataFrame:
    """Route attached to each row of its batch (window over small batches)."""
    mean = F.avg(tx.word_count(F.col(text_col))).over(Window.partitionBy(batch_col))
    return df.withColumn("route", F.when(mean < ROUTE_WORD_LIMIT, "bi").otherwise("auto"))


def encode_batches(df: DataFrame, encoder, key: str, text_col: str = "text",
                   batch_size: int = 16, max_length: int | None = None,
                   task_type: str = "auto") -> DataFrame:
    """batches of ``batch_size`` in key order -> route per batch (P12) ->
    encode (B5) -> cut -> pad to the batch maximum (F1).  Rows on the causal
    ('auto') route carry ``causal_width``: the width whose single causal mask
    (F5, ``causal_mask_rows``) applies - never one mask per row."""
    from ..functions.sequences import dynamic_padding, ones_mask
    from .index import fixed_batches
    b = fixed_batches(df, [key], batch_size)
    if task_type == "auto":
        b = route_rows(b, "batch_id", text_col)
    else:
        b = b.withColumn("route", F.lit("auto" if task_type == "causal" else "bi"))
    b = encoder.encode(b, text_col, "ids")
    if max_length is not None:
        b = b.withColumn("ids", F.slice("ids", 1, max_length))
    b = b.withColumn("mask", ones_mask(F.col("ids")))
    p = dynamic_padding(b, batch_col="batch_id")
    return p.withColumn("causal_width", F.when(F.col("route") == "auto", F.size("ids")))
