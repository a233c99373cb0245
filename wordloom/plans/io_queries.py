"""Contract queries for sinks and versioned tables: each writes into a fresh
folder under the session's checkpoint folder and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks
from ..session import shared_dir
from ..tables import table
from .bpe_queries import trained_model
from .common import register, tok_docs, tok_text_sql


# Numbered batch files, blank rows dropped after numbering ---------------
@register("batch_files", """
select batch_id::BIGINT as batch_id, doc_id, text from
 (select doc_id, text, (row_number() over (order by doc_id) - 1) // 64 as batch_id from documents)
where text is not null and regexp_matches(text, '\\S')
""")
def batch_files(spark, sf):
    path = shared_dir(spark, "batches")
    sinks.write_batches(table(spark, sf, "documents").select("doc_id", "text"), path, ["doc_id"], 64)
    back = spark.read.parquet(path)
    return back.select(F.col("batch_id").cast("bigint"), "doc_id", "text")


# Text lines sink ----------------------------------------------------------
@register("text_sink_lines", f"""
select {tok_text_sql('text')} as value from documents where regexp_matches({tok_text_sql('text')}, '\\S')
""")
def text_sink_lines(spark, sf):
    path = shared_dir(spark, "lines")
    sinks.write_text_lines(tok_docs(spark, sf), path)
    return spark.read.text(path)


# Versioned vocabulary tables -----------------------------------------------
@register("model_versions")
def model_versions(spark, sf):
    root = shared_dir(spark, "models")
    model = trained_model(spark, sf)
    sinks.save_model_tables(spark, root, model)
    sinks.save_model_tables(spark, root, model)
    v_latest, vocab, _ = sinks.load_model_tables(spark, root)
    v_prev, _, merges = sinks.restore_previous(spark, root)
    return vocab.withColumn("latest_version", F.lit(v_latest)).withColumn("restored_version", F.lit(v_prev))
