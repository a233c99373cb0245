"""Uniform shuffle into shards of exact size by a hypergeometric communication
matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written
from .registry import register

SHARDS = 16
SEED = 20_240_601
#: Rows of one shard that are sorted together in the second permutation.
SLOT_ROWS = 50_000
#: Matrices up to this many cells are sent to all executors, larger ones joined.
BROADCAST_CELLS = 1_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric draw for populations of any size.  numpy's own draw
    ends at 10**9; beyond, the distribution is inverted around its mode, where
    the terms follow from their ratios."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    sd = math.sqrt(draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1))
    first, last = max(low, mode - int(12 * sd) - 50), min(high, mode + int(12 * sd) + 50)
    k = np.arange(first, last, dtype=np.float64)
    steps = (np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return first + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each block to each shard, as a uniform permutation would deal
    them: row sums are ``counts``, column sums are ``sizes``."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    out = []
    for n in counts:
        row, rest, open_places = [], n, sum(left)
        for s, room in enumerate(left):
            take = hypergeometric(rng, room, open_places - room, rest)
            open_places -= room
            rest -= take
            left[s] -= take
            row.append(take)
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED,
                        shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows of ``df`` with a shard (0 to shards-1) and a slot (gapless from
    0 in each shard): a uniform random permutation, cut into shards whose row
    counts differ by one at most.

    Each input partition is a block: its rows are ranked in a random order, its
    first ones go to shard 0, the next to shard 1 and so on as the drawn matrix
    says, and every shard is permuted again.  Only block counts reach the
    driver (one number per input partition).  The rows are written once, with
    the numbers that the drawing works on, so that a lost executor cannot deal
    a row twice; only numbers are ranked and dealt, and each whole row moves
    once, to meet its shard and slot.

    Nulls, empty or long texts and repeated rows need no care: every row counts
    once whatever it holds.  An empty table gives no rows.  Columns of ``df``
    called like the two new ones (any case) are replaced by them; all others
    may have any name."""
    spark = df.sparkSession
    clash = {shard.lower(), slot.lower()}
    user = [c for c in df.columns if c.lower() not in clash]
    # the caller's columns travel in one column, so that their names meet no other
    row = F.struct(*user) if user else F.struct(F.lit(0))
    held = written(df.select(row.alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    keys = held.select("at", F.shiftright("at", 33).alias("block"))
    counts = sorted((r["block"], r["n"]) for r in keys.groupBy("block").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends = spark.createDataFrame([(b, [int(x) for x in np.cumsum(r)]) for (b, _), r in zip(counts, matrix)],
                                 "block long, ends array<long>")
    if len(counts) * shards <= BROADCAST_CELLS:
        ends = F.broadcast(ends)
    parts = max(1, math.ceil(total / shards / SLOT_ROWS))
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "at")
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(draw(0), "at")) - 1)
    dealt = written(ranked.join(ends, "block").select(
        "at", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"),
        F.floor((F.shiftrightunsigned(draw(1), 1) / float(1 << 63)) * parts).cast("int").alias("part")), "dealt")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
              .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    if parts * shards <= BROADCAST_CELLS:
        starts = F.broadcast(starts)
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(draw(1), "at")) - 1
    assigned = (dealt.withColumn("place", place).join(starts, ["shard", "part"])
                .select("at", "shard", (F.col("start") + F.col("place")).alias("slot")))
    return held.join(assigned.hint("shuffle_hash"), "at").select(
        *[F.col("row").getField(c).alias(c) for c in user], F.col("shard").alias(shard), F.col("slot").alias(slot))


@register("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
