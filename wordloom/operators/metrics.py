"""Run metrics per dataset (A4) and best step / plateau stop per series (A10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# --- fixed values: early-stop defaults ------------------------------------
PATIENCE = 3
MIN_DELTA = 0.0
# ---------------------------------------------------------------------------

#: Characters from which on an item is reported as long.
LONGEST_ITEM = 10_000


# A4 -------------------------------------------------------------------------
def dataset_metrics(df: DataFrame, dataset_col: str, ok_col: str, tokens_col: str) -> DataFrame:
    """Items, processed, failed, total tokens and mean tokens per processed
    item, per dataset (partial aggregates: a hot dataset is combined before
    the shuffle)."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("items"),
            F.count_if(F.col(ok_col)).cast("bigint").alias("processed_items"),
            F.count_if(~F.col(ok_col)).cast("bigint").alias("failed_items"),
            F.sum(F.when(F.col(ok_col), F.col(tokens_col)).otherwise(0)).cast("bigint").alias("total_tokens"),
            F.round(F.avg(F.when(F.col(ok_col), F.col(tokens_col))), 6).alias("mean_tokens")]
    return df.groupBy(dataset_col).agg(*aggs)


def error_examples(df: DataFrame, dataset_col: str, error_col: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent error messages per dataset (errors and warnings
    list): count first, then a group limit, so no group is collected whole."""
    c = (df.where(F.col(error_col).isNotNull())
           .groupBy(dataset_col, error_col).agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(dataset_col).orderBy(F.desc("n"), F.asc(error_col))
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def item_messages(text: Column, recorded_length: Column, longest: int = LONGEST_ITEM) -> Column:
    """What an item's checks say, as an array of (kind, message): errors make
    the item fail, warnings do not.  Errors: no text, blank text.  Warnings:
    a recorded length (if there is one) other than the text's, more than
    ``longest`` characters, replacement characters from a lossy decoding."""
    n = F.length(text)
    say = lambda kind, what: F.struct(F.lit(kind).alias("kind"), what.alias("message"))
    checks = [
        (text.isNull(), say("error", F.lit("no text"))),
        (text.isNotNull() & ~tx.is_not_blank(text), say("error", F.lit("blank text"))),
        (text.isNotNull() & recorded_length.isNotNull() & (n != recorded_length),
         say("warning", F.concat(F.lit("recorded length differs by "), (n - recorded_length).cast("string")))),
        (n > longest, say("warning", F.lit(f"longer than {longest} characters"))),
        (text.contains("\ufffd"), say("warning", F.lit("replacement characters"))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks]))


def message_report(df: DataFrame, dataset_col: str, messages_col: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent messages of each dataset: (dataset, kind, message,
    n, rank), equal counts by kind and message."""
    m = df.select(F.col(dataset_col), F.explode(messages_col).alias("_m"))
    c = m.groupBy(dataset_col, "_m").agg(F.count(F.lit(1)).cast("long").alias("n"))
    w = Window.partitionBy(dataset_col).orderBy(F.desc("n"), "_m.kind", "_m.message")
    return (c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(dataset_col, F.col("_m.kind").alias("kind"), F.col("_m.message").alias("message"), "n", "rank"))


# A10 ------------------------------------------------------------------------
def series_fold(series: DataFrame, key: str, step: str, value: str,
                patience: int = PATIENCE, min_delta: float = MIN_DELTA) -> DataFrame:
    """(key, n_steps, best_step, best_value, stop_step) per series: the first
    strict minimum, and the step at which the plateau counter reaches
    ``patience`` (null if never).  The counter grows at a value above
    ``best - min_delta``; else the value becomes ``best`` and the counter is 0.

    The series are range-partitioned and sorted by key, step and value, so that
    a long one lies over many tasks.  Each Arrow batch sums up its stretch of a
    series (``_stretch``) in at most ``patience`` entries, whatever its length;
    per series only these are folded, in order.

    Null values count as steps and do nothing else; a null key is a series; of
    rows of one step the lowest value goes first.  An empty table gives no
    series."""
    if patience < 1 or min_delta < 0:
        raise ValueError("patience is 1 or more, min_delta 0 or more")
    step_type = series.schema[step].dataType
    entry = T.StructType([T.StructField(c, t) for c, t in (
        ("v", T.DoubleType()), ("s", step_type), ("best", T.DoubleType()), ("count", T.LongType()), ("stop", step_type))])
    schema = T.StructType([T.StructField("key", series.schema[key].dataType), T.StructField("at", T.LongType()),
                           T.StructField("rows", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("min_v", T.DoubleType()), T.StructField("min_s", step_type),
                           T.StructField("head", T.ArrayType(entry))])

    def stretches(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            keys = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
            rows = []
            for i, j in zip(cut[:-1], cut[1:]):
                rows.append({"key": b.column(0)[int(i)].as_py(), "at": at, "rows": int(j - i)} | _stretch(
                    b.column(1).slice(i, j - i).to_pylist(), b.column(2).slice(i, j - i).to_pylist(), patience, min_delta))
                at += 1
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    def fold(table):
        import pyarrow as pa
        state = {"best": None, "count": 0, "stop": None, "min_v": None, "min_s": None}
        table = table.sort_by("at")
        for row in table.select(["n", "min_v", "min_s", "head"]).to_pylist():
            _fold_stretch(state, row, patience, min_delta)
        return pa.table({"key": table.column("key").slice(0, 1), "n_steps": pa.array([sum(table.column("rows").to_pylist())], pa.int64()),
                         "best_step": pa.array([state["min_s"]], table.schema.field("min_s").type),
                         "best_value": pa.array([state["min_v"]], pa.float64()),
                         "stop_step": pa.array([state["stop"]], table.schema.field("min_s").type)})

    out = T.StructType([T.StructField("key", series.schema[key].dataType), T.StructField("n_steps", T.LongType()),
                        T.StructField("best_step", step_type), T.StructField("best_value", T.DoubleType()),
                        T.StructField("stop_step", step_type)])
    ordered = (series.select(F.col(key), F.col(step), F.col(value).cast("double").alias("_v"))
               .repartitionByRange(F.col(key), F.col(step)).sortWithinPartitions(F.col(key), F.col(step), F.col("_v")))
    return (ordered.mapInArrow(stretches, schema).groupBy("key").applyInArrow(fold, out)
            .withColumnRenamed("key", key))


def _stretch(steps: list, values: list, patience: int, min_delta: float) -> dict:
    """One stretch of a series for a fold that enters it with any state.  Within
    the first ``patience`` values the counter reaches ``patience`` or one of
    them becomes the best; from there on the way is the same whatever came
    before.  ``head`` holds these values, each with the state at the end if it
    becomes the best, and the step of a stop on the way."""
    kept = [(s, float(v)) for s, v in zip(steps, values) if v is not None]
    if not kept:
        return {"n": 0, "min_v": None, "min_s": None, "head": []}
    known: dict[int, tuple] = {}

    def way(i: int) -> tuple:
        """(best, counter, stop) at the end if value i becomes the best."""
        passed = []
        while i not in known:
            bar = kept[i][1] - min_delta
            stop = i + patience
            j = next((j for j in range(i + 1, min(stop + 1, len(kept))) if kept[j][1] <= bar), None)
            if j is None:
                known[i] = (kept[i][1], len(kept) - 1 - i, kept[stop][0] if stop < len(kept) else None)
            else:
                passed.append(i)
                i = j
        for k in passed:
            known[k] = known[i]
        return known[i]

    low = min(range(len(kept)), key=lambda i: (kept[i][1], i))
    head = [{"v": kept[i][1], "s": kept[i][0]} | dict(zip(("best", "count", "stop"), way(i)))
            for i in range(min(patience, len(kept)))]
    return {"n": len(kept), "min_v": kept[low][1], "min_s": kept[low][0], "head": head}


def _fold_stretch(state: dict, row: dict, patience: int, min_delta: float) -> None:
    """Take ``state`` over the next stretch.  After a stop only the minimum goes on."""
    if row["n"] and (state["min_v"] is None or row["min_v"] < state["min_v"]):
        state["min_v"], state["min_s"] = row["min_v"], row["min_s"]
    if state["stop"] is not None:
        return
    for e in row["head"]:
        if state["best"] is None or e["v"] <= state["best"] - min_delta:
            state.update({k: e[k] for k in ("best", "count", "stop")})
            return
        state["count"] += 1
        if state["count"] >= patience:
            state["stop"] = e["s"]
            return
