"""Structured Streaming: clean-and-write (T1), dataset metrics (T2) and
redaction / encoding on a stream (T3).

The row operators are the same Column functions as in batch; a stream only
changes the source (``readStream`` over a folder of files, bounded per
trigger by ``maxFilesPerTrigger``) and the sink (``writeStream`` with a
checkpoint folder, so a restarted or failed query resumes exactly where it
stopped).  ``availableNow`` processes what is there and stops, which is the
batch-equivalent run used by the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators import pretokenize as pt
from ..session import path_exists, remove_dir, shared_dir


# Sources ------------------------------------------------------------------
def file_stream(spark: SparkSession, path: str, fmt: str = "text", schema=None,
                max_files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """Stream of records from files arriving in the folder ``path`` (text,
    json, csv, parquet; optionally only names matching ``glob``); file formats
    other than text need a schema."""
    r = spark.readStream.format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


# T1 -------------------------------------------------------------------------
def clean_stream(stream: DataFrame, text_col: str = "text",
                 pipeline: str | None = None) -> DataFrame:
    """Strip, drop blank items, apply a named cleaning pipeline (optional)."""
    t = tx.strip(F.col(text_col))
    s = stream.withColumn(text_col, t).where(tx.is_not_blank(F.col(text_col)))
    if pipeline is not None:
        s = s.withColumn(text_col, tx.get_pipeline(pipeline)(F.col(text_col)))
    return s


def write_stream(stream: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                 available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Append the stream to files.  Parquet is the default: a newline inside
    an item would split it in a text sink."""
    w = stream.writeStream.format(fmt).option("path", out_path).option(
        "checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


# T2 -------------------------------------------------------------------------
def dataset_metrics_stream(stream: DataFrame, dataset_col: str, text_col: str = "text",
                           time_col: str | None = None) -> DataFrame:
    """Running metrics per dataset (stateful aggregate, combined before the
    shuffle): items, processed_items, failed_items (no text or a blank one),
    total_tokens and mean_tokens of the processed (pre-tokens); with a time
    column also first_time, last_time and items_per_second between the two
    (null if they are equal)."""
    ok = tx.is_not_blank(F.col(text_col))
    tokens = F.when(ok, F.size(pt.pretokens(F.col(text_col))))
    aggs = [F.count(F.lit(1)).cast("bigint").alias("items"),
            F.count_if(ok).cast("bigint").alias("processed_items"),
            F.count_if(~ok).cast("bigint").alias("failed_items"),
            F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens"),
            F.round(F.avg(tokens), 6).alias("mean_tokens")]
    if time_col is None:
        return stream.groupBy(dataset_col).agg(*aggs)
    at = F.col(time_col).cast("timestamp")
    out = stream.groupBy(dataset_col).agg(*aggs, F.min(at).alias("first_time"), F.max(at).alias("last_time"))
    span = (F.unix_micros("last_time") - F.unix_micros("first_time")) / 1_000_000
    return out.withColumn("items_per_second", F.when(span > 0, F.round(F.col("items") / span, 6)))


def write_snapshots(agg_stream: DataFrame, out_path: str, checkpoint: str,
                    available_now: bool = True, keep: int = 2) -> StreamingQuery:
    """Complete-mode aggregate: each micro-batch writes its snapshot under
    ``batch=<id>``, and snapshots before the last ``keep`` are removed.  A batch
    that is run again after a failure writes the same folder again, and a
    snapshot counts only once it is whole, so ``read_snapshot`` never sees a
    part of one and never a batch twice."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        for old in snapshots(batch.sparkSession, out_path):
            if old <= batch_id - keep:
                remove_dir(batch.sparkSession, f"{out_path}/batch={old}")

    w = (agg_stream.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def snapshots(spark: SparkSession, out_path: str) -> list[int]:
    """Batch ids of the whole snapshots under ``out_path``, ascending."""
    sc = spark.sparkContext
    top = sc._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = top.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(top)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and n[6:].isdigit()
                  and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{out_path}/{n}/_SUCCESS")))


def read_snapshot(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest whole snapshot."""
    there = snapshots(spark, out_path)
    if not there:
        raise FileNotFoundError(f"no snapshot under {out_path}")
    return spark.read.parquet(f"{out_path}/batch={there[-1]}")


def rows_per_second(query: StreamingQuery) -> float | None:
    """Sample rate of the last micro-batch."""
    p = query.lastProgress
    return None if not p else p.get("processedRowsPerSecond")


# T3 -------------------------------------------------------------------------
def redact_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    return stream.withColumn(text_col, tx.medical_clean(F.col(text_col)))


def encode_stream(stream: DataFrame, encoder, text_col: str = "text",
                  out_col: str = "ids") -> DataFrame:
    """B5 on a stream with one vocabulary for the query's life; see
    ``write_encoded`` for one that may change."""
    return stream.withColumn(out_col, encoder.encode_column(F.col(text_col)))


def write_encoded(stream: DataFrame, models: str, out_path: str, checkpoint: str, text_col: str = "text",
                  out_col: str = "ids", available_now: bool = True) -> StreamingQuery:
    """B5 on a stream with versioned vocabularies under ``models`` (S12).  Each
    micro-batch is encoded with the newest version committed when it first
    runs, which every row keeps as ``vocab_version``; the choice is noted
    beside the output before the batch is written, so a batch that is run
    again takes the same version and replaces what it wrote."""
    from ..operators.encode import BpeEncoder
    from ..sources import sinks
    held: dict[int, BpeEncoder] = {}

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        chosen = f"{out_path}/_version/batch={batch_id}"
        if path_exists(spark, f"{chosen}/_SUCCESS"):
            version = spark.read.schema("v int").parquet(chosen).first()["v"]
        else:
            version = sinks.committed_versions(spark, models)[-1]
            spark.createDataFrame([(version,)], "v int").coalesce(1).write.mode("overwrite").parquet(chosen)
        if version not in held:
            _, vocab, merges = sinks.load_model_tables(spark, models, version)
            held.clear()
            held[version] = BpeEncoder(sinks.model_from_tables(vocab, merges))
        out = held[version].encode(batch, text_col, out_col).withColumn("vocab_version", F.lit(version))
        out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    if not sinks.committed_versions(stream.sparkSession, models):
        raise FileNotFoundError(f"no committed version under {models}")
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_table(spark: SparkSession, stream: DataFrame, name: str,
                 complete: bool = False) -> DataFrame:
    """Run a stream with ``availableNow`` into a fresh folder and read the
    result back (the batch-equivalent check)."""
    base = shared_dir(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    q = write_snapshots(stream, out, ckpt) if complete else write_stream(stream, out, ckpt)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_snapshot(spark, out) if complete else spark.read.parquet(out)
