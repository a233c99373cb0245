"""Contract queries run as Structured Streaming jobs (``availableNow``).

Each reads a driver table as a file stream, runs the same Column functions as
the batch plan, writes through a checkpointed sink in a fresh folder under
the session's checkpoint folder, and returns what the sink wrote - which must
equal the batch result (the SQL twin).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..session import is_dir
from ..streaming import streams as st
from ..tables import NOTES_SQL, table
from .common import clean_sql, pretokens_sql, register, tok_text, tok_text_sql
from .text_queries import _abbrev_sql, _phi_sql


def stream_table(spark, sf, name):
    """A driver table as a file stream, whether it is one file or a folder of
    files; a micro-batch takes as many files as there are cores."""
    schema = table(spark, sf, name, spread_work=False).schema
    path = f"{sf.rstrip('/')}/{name}.parquet"
    at, glob = (path, None) if is_dir(spark, path) else (sf, f"{name}.parquet")
    return st.file_stream(spark, at, fmt="parquet", schema=schema, glob=glob,
                          max_files_per_trigger=spark.sparkContext.defaultParallelism)


# T1 -------------------------------------------------------------------------
@register("stream_clean_documents", f"""
select doc_id, {clean_sql('text')} as text from documents where regexp_matches(text, '\\S')
""")
def stream_clean_documents(spark, sf):
    s = stream_table(spark, sf, "documents").select("doc_id", "text")
    s = st.clean_stream(s, pipeline="general")
    return st.run_to_table(spark, s, "clean")


# T2 -------------------------------------------------------------------------
@register("stream_dataset_metrics", f"""
select source, count(*)::BIGINT as items,
  sum(len({pretokens_sql(tok_text_sql('text'))}))::BIGINT as total_tokens
from documents group by source
""")
def stream_dataset_metrics(spark, sf):
    s = stream_table(spark, sf, "documents")
    s = s.select("source", tok_text(F.col("text")).alias("text"))
    m = st.run_to_table(spark, st.dataset_metrics_stream(s, "source"), "metrics", complete=True)
    return m.select("source", "items", "total_tokens")


@register("stream_run_metrics", rf"""
with e as (select event_type, ts, {tok_text_sql('props')} as text from events)
select event_type, count(*)::BIGINT as items, count_if(regexp_matches(text, '\S'))::BIGINT as processed_items,
  count_if(text is null or not regexp_matches(text, '\S'))::BIGINT as failed_items,
  coalesce(sum(len({pretokens_sql('text')})) filter (where regexp_matches(text, '\S')), 0)::BIGINT as total_tokens,
  round(avg(len({pretokens_sql('text')})) filter (where regexp_matches(text, '\S')), 6) as mean_tokens,
  epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us,
  case when max(ts) > min(ts) then round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 6) end as items_per_second
from e group by event_type
""")
def stream_run_metrics(spark, sf):
    """All run metrics of a stream, per event type, from the state after its last micro-batch."""
    s = stream_table(spark, sf, "events")
    s = s.select("event_type", "ts", tok_text(F.col("props")).alias("text"))
    m = st.run_to_table(spark, st.dataset_metrics_stream(s, "event_type", time_col="ts"), "run-metrics", complete=True)
    return m.select("event_type", "items", "processed_items", "failed_items", "total_tokens", "mean_tokens",
                    F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"), "items_per_second")


# T3 -------------------------------------------------------------------------
@register("stream_redacted_notes", f"""
select note_id, {_phi_sql(_abbrev_sql('text'))} as text from {NOTES_SQL}
""")
def stream_redacted_notes(spark, sf):
    o = stream_table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    # stream-static join: the static side is joined per micro-batch
    from ..tables import notes_from
    n = notes_from(o, c).select("note_id", "text")
    return st.run_to_table(spark, st.redact_stream(n), "redact")


# Encoding on a stream (fixed vocabulary for the query's life) -------------
@register("stream_encode_documents")
def stream_encode_documents(spark, sf):
    from ..operators.encode import BpeEncoder
    from .bpe_queries import trained_model
    enc = BpeEncoder(trained_model(spark, sf))
    s = stream_table(spark, sf, "documents")
    s = s.select("doc_id", tok_text(F.col("text")).alias("text"))
    out = st.encode_stream(s, enc).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), sq.as_text(F.col("ids")).alias("ids"))
    return st.run_to_table(spark, out, "encode")
