"""Record corpora (S3), multi-dataset loading with checks and stats (S4),
line corpora (S5) and question-answer sets (S11)."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as tx
from ..session import path_exists
from . import files

log = logging.getLogger(__name__)

DATASET_TYPES = ("huggingface", "local")
REQUIRED_KEYS = ("name", "type", "config")


# S3 ---------------------------------------------------------------------------
def record_text(df: DataFrame) -> F.Column:
    """``text`` (or ``content``) of a record, else the whole record as JSON."""
    cols = {c.lower() for c in df.columns}
    if "text" in cols or "content" in cols:
        return tx.text_field(df).cast("string")
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def record_corpus(df: DataFrame, key: str | None = None) -> DataFrame:
    """S3: one text per record; empty strings and nulls dropped."""
    t = record_text(df).alias("text")
    keep = [F.col(key)] if key else []
    out = df.select(*keep, t)
    return out.where(F.col("text").isNotNull() & (F.col("text") != ""))


def read_records(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("json" if path.endswith((".json", ".jsonl")) else "parquet")
    return spark.read.format(fmt).load(path)


# S5 ---------------------------------------------------------------------------
def line_corpus(df: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """One row per line, stripped, blank lines dropped; keeps line_no."""
    keep = [F.col(key)] if key else []
    lines = df.select(*keep, F.posexplode(F.split(F.col(text_col), r"\r\n|\r|\n")).alias("line_no", "line"))
    lines = lines.select(*([key] if key else []), F.col("line_no").cast("bigint").alias("line_no"),
                         tx.strip(F.col("line")).alias("line"))
    return lines.where(F.col("line") != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select(F.col("value"))
    return raw.select(tx.strip(F.col("value")).alias("line")).where(F.col("line") != "")


# S4 ---------------------------------------------------------------------------
def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through Hadoop's FileSystem (local, HDFS, object stores);
    glob patterns count when they match something."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def validate_descriptor(d: dict, spark: SparkSession | None = None) -> list[str]:
    """Problems of one dataset descriptor (empty list = valid)."""
    problems = [f"missing key {k!r}" for k in REQUIRED_KEYS if k not in d]
    if problems:
        return problems
    if d["type"] not in DATASET_TYPES:
        problems.append(f"unknown type {d['type']!r}")
    cfg = d.get("config") or {}
    if d["type"] == "local":
        path = cfg.get("path") or cfg.get("local_path")
        exists = path_exists(spark, path) if (spark is not None and path) else bool(path and os.path.exists(path))
        if not path or not exists:
            problems.append(f"local path does not exist: {path!r}")
    return problems


def load_dataset(spark: SparkSession, d: dict) -> DataFrame:
    """One descriptor -> (dataset, text).  ``huggingface`` descriptors read a
    local record set (parquet / JSON lines) since there is no download;
    ``local`` ones read text files (S1) or CSV files (S2)."""
    cfg = d.get("config") or {}
    if d["type"] == "huggingface":
        df = record_corpus(read_records(spark, cfg["path"], cfg.get("format")))
    else:
        path = cfg.get("path") or cfg.get("local_path")
        if cfg.get("format") == "csv" or str(cfg.get("pattern", "")).endswith(".csv"):
            df = files.csv_corpus(spark, path, cfg.get("pattern", "*.csv"),
                                  cfg.get("csv_text_column")).select("text")
        else:
            df = files.text_file_corpus(spark, path, cfg.get("pattern", "*.txt")).select("text")
    return df.select(F.lit(d["name"]).alias("dataset"), F.col("text"))


def load_corpora(spark: SparkSession, descriptors: list[dict],
                 on_error: str = "fail") -> DataFrame:
    """Union of all datasets tagged by name; blank texts dropped.

    A repeated name is rejected; an invalid descriptor raises (``'fail'``) or
    is logged and skipped (``on_error='skip'``); ``descriptor_problems`` gives
    the skipped names and reasons as rows.
    """
    names = [d.get("name") for d in descriptors]
    dup = {n for n in names if names.count(n) > 1}
    if dup:
        raise ValueError(f"repeated dataset names: {sorted(dup)}")
    parts = []
    for d in descriptors:
        problems = validate_descriptor(d, spark)
        if problems:
            if on_error == "fail":
                raise ValueError(f"dataset {d.get('name')!r}: {problems}")
            log.warning("skipping dataset %r: %s", d.get("name"), problems)
            continue
        parts.append(load_dataset(spark, d))
    if not parts:
        return spark.createDataFrame([], "dataset STRING, text STRING")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return tx.drop_blank(out)


def descriptor_problems(spark: SparkSession, descriptors: list[dict]) -> DataFrame:
    """(dataset, reason) of every descriptor that ``load_corpora`` would not load."""
    rows = [(d.get("name"), str(p)) for d in descriptors for p in [validate_descriptor(d, spark)] if p]
    return spark.createDataFrame(rows, "dataset STRING, reason STRING")


def corpus_stats(corpus: DataFrame, descriptors: list[dict] | None = None) -> DataFrame:
    """Samples and characters per dataset; with ``descriptors`` the datasets
    that gave nothing appear with 0 (``empty`` = true)."""
    stats = corpus.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n_samples"),
                                          F.sum(F.length("text")).cast("bigint").alias("n_chars"))
    if descriptors:
        spark = corpus.sparkSession
        names = spark.createDataFrame([(d["name"],) for d in descriptors], "dataset STRING")
        stats = (names.join(stats, "dataset", "left")
                 .fillna(0, ["n_samples", "n_chars"]))
    return stats.withColumn("empty", F.col("n_samples") == 0)


# S11 --------------------------------------------------------------------------
QA_SCHEMA = "question STRING, context STRING, answers STRUCT<text: ARRAY<STRING>>"
QA_READ = QA_SCHEMA + ", _corrupt_record STRING"


def load_qa_sets(spark: SparkSession, paths: dict[str, str], on_missing: str = "fail") -> DataFrame:
    """Several QA sets (name -> path), concatenated with missing columns
    filled by null.  A path that does not exist raises, or is logged and
    skipped with ``on_missing='skip'``; any other error always raises."""
    parts = []
    for name, path in paths.items():
        try:
            df = read_records(spark, path)
            df.schema  # noqa: B018 - resolve now so a bad set fails here
            parts.append(df.withColumn("dataset", F.lit(name)))
        except AnalysisException as e:
            if on_missing != "skip" or "PATH_NOT_FOUND" not in str(e):
                raise
            log.error("no QA set %r at %s", name, path)
    if not parts:
        return spark.createDataFrame([], QA_SCHEMA + ", dataset STRING")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def scan_qa_splits(spark: SparkSession, sets: dict[str, dict[str, str]]) -> tuple[DataFrame, DataFrame]:
    """S11 by set and split: ``sets`` is {set: {split: path of JSON lines}}.

    Returns the records (dataset, split, question, context, answers) and the
    failures (dataset, split, reason, n, example): lines that are no record,
    records without a question, and, with n = 0, paths that do not exist.  One
    set's failures keep no other from loading; a line that fails is in no
    record.  Reading is permissive: a broken line comes with its text."""
    held, missing = [], []
    for name, splits in sets.items():
        for split, path in splits.items():
            if path_exists(spark, path):
                df = spark.read.schema(QA_READ).option("mode", "PERMISSIVE").json(path)
                held.append(df.select(F.lit(name).alias("dataset"), F.lit(split).alias("split"), *df.columns))
            else:
                log.error("no QA set %r, split %r at %s", name, split, path)
                missing.append((name, split, "no such path", 0, path))
    lost = spark.createDataFrame(missing, "dataset STRING, split STRING, reason STRING, n BIGINT, example STRING")
    if not held:
        return spark.createDataFrame([], "dataset STRING, split STRING, " + QA_SCHEMA), lost
    rows = held[0]
    for df in held[1:]:
        rows = rows.unionByName(df)
    reason = (F.when(F.col("_corrupt_record").isNotNull(), "not a record")
              .when(~tx.is_not_blank(F.col("question")), "no question"))
    rows = rows.withColumn("reason", reason)
    broken = (rows.where("reason is not null").groupBy("dataset", "split", "reason")
              .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                   F.min(F.coalesce("_corrupt_record", "context", F.lit(""))).alias("example")))
    return rows.where("reason is null").drop("reason", "_corrupt_record"), broken.unionByName(lost)
