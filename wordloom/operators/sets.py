"""Set-style checks and combinators: required keys (P13), combining encoded
batches (U5) and batched maps over records (X2)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# P13 ------------------------------------------------------------------------
def missing_keys_column(required: list[str], present: Column) -> Column:
    """Row level: required names absent from an ARRAY<STRING> of names."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), present)


def missing_keys(spark: SparkSession, required: list[str], present: DataFrame,
                 key_col: str) -> DataFrame:
    """Table level: required keys not among ``present[key_col]`` (left anti
    join of the small required list)."""
    req = spark.createDataFrame([(r,) for r in required], f"{key_col} STRING")
    return req.join(present.select(key_col), key_col, "left_anti")


def check_required(spark: SparkSession, required: list[str], present: DataFrame,
                   key_col: str) -> None:
    miss = [r[key_col] for r in missing_keys(spark, required, present, key_col).collect()]
    if miss:
        raise ValueError(f"required keys that are not in {key_col}: {sorted(miss)}")


# U5 -------------------------------------------------------------------------
def combine_batches(batches: dict[str, DataFrame], array_cols: list[str],
                    strict: bool = True) -> DataFrame:
    """Concatenate encoded batches (name -> frame).  All must share the same
    columns and, per array column, one width; otherwise ValueError naming the
    column and the batch (``strict``), checked with one small aggregate."""
    names = list(batches)
    cols = set(batches[names[0]].columns)
    for n in names[1:]:
        if set(batches[n].columns) != cols:
            raise ValueError(f"batch {n!r} has keys {sorted(batches[n].columns)}, expected {sorted(cols)}")
    out = None
    for n in names:
        d = batches[n].withColumn("batch", F.lit(n))
        out = d if out is None else out.unionByName(d)
    if strict:
        widths = out.groupBy("batch").agg(*[F.min(F.size(c)).alias(f"min_{c}") for c in array_cols],
                                         *[F.max(F.size(c)).alias(f"max_{c}") for c in array_cols]).collect()
        by_batch = {r["batch"]: r for r in widths}
        for c in array_cols:
            # the first batch sets the width; name the first batch that differs
            ref = by_batch[names[0]]
            for n in names:
                r = by_batch.get(n)
                if r is None:
                    continue
                if r[f"min_{c}"] != r[f"max_{c}"] or r[f"min_{c}"] != ref[f"min_{c}"] \
                        or ref[f"min_{c}"] != ref[f"max_{c}"]:
                    raise ValueError(f"key {c!r} has different widths; batch {n!r} differs")
    return out


# X2 -------------------------------------------------------------------------
def map_records(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Batched map: ``fn`` gets a dict of columns (lists) for one Arrow batch
    and returns a dict of output columns matching ``schema``."""
    def run(batches):
        for pdf in batches:
            out = fn({c: pdf[c].tolist() for c in pdf.columns})
            yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)
