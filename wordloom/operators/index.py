"""Global row index and what is built on it: batching (W5), chunk split (W6),
seeded shuffle (L3), exact random split (U4), batch collate (F10).

An unpartitioned ``row_number()`` pulls every row into one task.  Instead:
``repartitionByRange`` -> sort inside partitions ->
``monotonically_increasing_id`` gives (partition, local position) -> the
table is checkpointed so partition boundaries cannot change -> one small
count per partition -> running offsets (one row per partition, broadcast) ->
index = offset + local position.  Nothing is collected but the partition
counts, and whole rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.sequences import PAD_ID, dynamic_padding
from ..session import ensure_checkpoint_dir

_LOCAL_BITS = 33


def global_index(df: DataFrame, order_cols: list[str], name: str = "gidx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based BIGINT index in the total order of ``order_cols``.

    Whole rows are ranged once, sorted and checkpointed, so there is no join
    back on the keys: rows with null or repeated keys are numbered like all
    others (nulls first; ties in the order of the checkpointed table).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    # Reliable checkpoint: fixes the partition boundaries for the counts
    # below and survives executor loss.
    tagged = tagged.checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid") - F.shiftleft(pid, _LOCAL_BITS)
    counts = (tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
              .orderBy("_pid").collect())          # one row per partition
    offsets, run = [], 0
    for r in counts:
        offsets.append((int(r["_pid"]), run))
        run += int(r["_n"])
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    off_df = spark.createDataFrame(offsets, "_pid BIGINT, _off BIGINT")
    return (tagged.withColumn("_pid", pid).withColumn("_loc", local)
                  .join(F.broadcast(off_df), "_pid")
                  .withColumn(name, F.col("_off") + F.col("_loc"))
                  .drop("_mid", "_pid", "_loc", "_off"))


def fixed_batches(df: DataFrame, order_cols: list[str], batch_size: int,
                  name: str = "batch_id") -> DataFrame:
    """Consecutive runs of ``batch_size`` rows in order; the last may be short."""
    out = global_index(df, order_cols, "_gidx")
    return (out.withColumn(name, F.floor(F.col("_gidx") / F.lit(batch_size)).cast("bigint"))
               .withColumn("_pos_in_batch", F.col("_gidx") % F.lit(batch_size))
               .drop("_gidx"))


def split_chunks(df: DataFrame, chunk_col: str, pos_col: str, k: int,
                 name: str = "part") -> DataFrame:
    """part = pos div max(1, chunk_size div k); may give more than k parts.

    The chunk is the window key; chunks are bounded batches (W5), so no group
    can grow with the data.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(chunk_col))
    part_size = F.greatest(F.lit(1), F.floor(size / F.lit(k)))
    return df.withColumn(name, F.floor(F.col(pos_col) / part_size).cast("bigint"))


def shuffle_key(seed: int, key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return draws.uniform(seed, "shuffle", k)


def seeded_shuffle(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """L3: a repeatable permutation: order by the keyed draw, then the key."""
    d = df.withColumn("_draw", shuffle_key(seed, key))
    return global_index(d, ["_draw", key], name).drop("_draw")


def exact_split(df: DataFrame, key: str, seed: int, fraction: float = 0.9,
                name: str = "split") -> DataFrame:
    """U4: first int(fraction * n) rows of the seeded permutation are 'train',
    the rest 'validation'; disjoint and complete, sizes exact."""
    shuffled = seeded_shuffle(df, key, seed, "_pos")
    n = shuffled.count()
    n_train = int(fraction * n)
    return (shuffled.withColumn(name, F.when(F.col("_pos") < F.lit(n_train), "train")
                                .otherwise("validation"))
                    .drop("_pos"))


def collate(df: DataFrame, key: str, seed: int, batch_size: int = 16,
            ids: str = "ids", mask: str = "mask", multiple_of: int | None = None,
            pad: int = PAD_ID) -> DataFrame:
    """seeded shuffle -> batches of ``batch_size`` -> pad each batch to its
    maximum (rounded up to ``multiple_of``)."""
    d = df.withColumn("_draw", shuffle_key(seed, key))
    b = fixed_batches(d, ["_draw", key], batch_size).drop("_draw")
    return dynamic_padding(b, ids, mask, batch_col="batch_id", pad=pad,
                           multiple_of=multiple_of)
