"""Contract queries for required keys (P13), aligned counts (J4), combined
batches (U5), batched record maps (X2) and QA-set scans (S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions import text as tx
from ..operators import encode as en
from ..operators import pretokenize as pt
from ..operators import qa, sets
from ..session import shared_dir
from ..sources import records
from ..tables import table
from .common import (hashed_ids_sql, list_text_sql, pretokens_sql, register, tok_docs, tok_text, tok_text_sql,
                     words_sql)

REQUIRED = [" the", " and", " of", " zebra", " token", " pt"]


# P13 ------------------------------------------------------------------------
@register("required_tokens_missing", f"""
select token from (values {", ".join(f"('{r}')" for r in REQUIRED)}) r(token)
except
select distinct unnest({pretokens_sql(tok_text_sql('text'))}) as token from documents
""")
def required_tokens_missing(spark, sf):
    toks = tok_docs(spark, sf).select(F.explode(pt.pretokens(F.col("text"))).alias("token"))
    present = toks.groupBy("token").count()
    return sets.missing_keys(spark, REQUIRED, present, "token")


# J4 -------------------------------------------------------------------------
@register("aligned_counts", f"""
select doc_id, len({words_sql('text')})::BIGINT as n_words,
  len({pretokens_sql(tok_text_sql('text'))})::BIGINT as n_pretokens
from documents
""")
def aligned_counts(spark, sf):
    d = tok_docs(spark, sf)
    words = d.select("doc_id", F.size(tx.words(F.col("text"))).alias("n"))
    pre = d.select("doc_id", F.size(pt.pretokens(F.col("text"))).alias("n"))
    return en.align_counts({"words": words, "pretokens": pre}, "doc_id")


# U5 -------------------------------------------------------------------------
@register("combined_batches", f"""
select doc_id, source, {list_text_sql(hashed_ids_sql(words_sql('text')))} as ids from documents
""")
def combined_batches(spark, sf):
    d = table(spark, sf, "documents")
    w = tx.words(tok_text(F.col("text")))
    d = d.select("doc_id", "source", "lang", sq.hashed_word_ids(w).alias("ids"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    # two encoded sets (English, the rest) combined back into one
    parts = {"en": d.where(english).drop("lang"), "other": d.where(~english).drop("lang")}
    both = sets.combine_batches(parts, ["ids"], strict=False)
    return both.select("doc_id", "source", sq.as_text(F.col("ids")).alias("ids"))


# X2 -------------------------------------------------------------------------
def _prompt_lengths(cols: dict) -> dict:
    return {"conv_id": cols["conv_id"], "turn": cols["turn"],
            "n_chars": [len(t) if t is not None else None for t in cols["text"]]}


@register("batched_record_map", """
select conv_id, turn, length(text)::BIGINT as n_chars from conversations
""")
def batched_record_map(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return sets.map_records(c, _prompt_lengths, "conv_id BIGINT, turn BIGINT, n_chars BIGINT")


# S11 ------------------------------------------------------------------------
@register("qa_set_scan", """
select 'conversations' as dataset, count(*)::BIGINT as n from conversations
union all select 'labels', count(*) from labels
""")
def qa_set_scan(spark, sf):
    u = records.load_qa_sets(spark, {"conversations": f"{sf}/conversations.parquet",
                                      "labels": f"{sf}/labels.parquet",
                                      "missing": f"{sf}/no_such_set.parquet"}, on_missing="skip")
    return u.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# S11 by set and split: turns as JSON lines of two sets; a pair without an answer
# stands for a broken line, a blank question stays one
_QA_SQL = """
with p as (select u.conv_id, u.turn, u.text as question, n.text as answer,
    case when u.conv_id % 3 = 0 then 'third' else 'rest' end as dataset, case when u.turn < 4 then 'train' else 'test' end as split
  from conversations u left join conversations n on n.conv_id = u.conv_id and n.turn = u.turn + 1 and n.role = 'assistant'
  where u.role = 'user')
"""


def _qa_splits(spark, sf):
    pairs = qa.pair_turns(table(spark, sf, "conversations"))
    answer = F.get("answers.text", F.lit(0))
    line = F.to_json(F.struct("conv_id", "turn", "question", F.lit(None).cast("string").alias("context"), "answers"))
    lines = pairs.select(F.when(F.col("conv_id") % 3 == 0, "third").otherwise("rest").alias("dataset"),
                         F.when(F.col("turn") < 4, "train").otherwise("test").alias("split"),
                         F.when(answer.isNull(), F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value"))
    path = shared_dir(spark, "qa")
    lines.write.partitionBy("dataset", "split").text(path)
    return records.scan_qa_splits(spark, {d: {s: f"{path}/dataset={d}/split={s}" for s in ("train", "test", "dev")} for d in ("third", "rest")})


@register("qa_split_records", _QA_SQL + """
select dataset, split, question, answer from p where answer is not null and regexp_matches(question, '\\S')
""")
def qa_split_records(spark, sf):
    rows, _ = _qa_splits(spark, sf)
    return rows.select("dataset", "split", "question", F.get("answers.text", F.lit(0)).alias("answer"))


@register("qa_split_failures", _QA_SQL + """
select dataset, split, 'not a record' as reason, count(*)::BIGINT as n from p where answer is null group by all
union all select dataset, split, 'no question', count(*) from p where answer is not null and (question is null or not regexp_matches(question, '\\S')) group by all
union all select d, 'dev', 'no such path', 0 from (values ('third'), ('rest')) v(d)
""")
def qa_split_failures(spark, sf):
    _, bad = _qa_splits(spark, sf)
    return bad.select("dataset", "split", "reason", "n")
