"""Connected components over edge tables, without collecting anything."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def forest(pairs: np.ndarray) -> np.ndarray:
    """(node, smallest node it is tied to) rows that join what ``pairs`` join;
    node > smallest."""
    if len(pairs) == 0:
        return np.zeros((0, 2), np.int64)
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[at[:, 0]], low)
        np.minimum.at(new, label[at[:, 1]], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[far], nodes[label[far]]], 1)


#: Edges that one task ties up at a time (16 bytes each).
TASK_EDGES = 1_000_000


def _contract(batches):
    """Tie up what the batches join, so that a partition sends a forest."""
    import pyarrow as pa
    held, new, n = np.zeros((0, 2), np.int64), [], 0
    for b in batches:
        new.append(np.stack([b.column(0).to_numpy(zero_copy_only=False),
                             b.column(1).to_numpy(zero_copy_only=False)], 1).astype(np.int64))
        n += len(new[-1])
        if n > TASK_EDGES // 2:
            held, new, n = forest(np.concatenate([held, *new])), [], 0
            if len(held) > 2 * TASK_EDGES:  # bounded memory: pass on and start anew
                yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["a", "b"])
                held = held[:0]
    held = forest(np.concatenate([held, *new]))
    yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node reachable, for
    every node that is not its own smallest.  Null ends and loops are ignored.

    Every partition first sends on a forest of its edges only.  As long as
    more than TASK_EDGES are left, the published large-star and small-star
    steps alternate with that, each a group minimum and a join, until every
    edge points at a root; TASK_EDGES edges or fewer are tied up by one task."""
    e = (edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
         .where("a is not null and b is not null and a <> b").mapInArrow(_contract, "a long, b long"))
    e = written(e, "edges")
    while True:
        parts = math.ceil(e.count() / TASK_EDGES)
        tied = written(e.repartition(max(parts, 1)).mapInArrow(_contract, "a long, b long"), "edges")
        drop_written(e)
        e = tied
        if parts <= 1:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(least, "a")
        small = (step.select("a", F.col("m").alias("b"))
                 .unionByName(step.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
                 .where("a <> b").distinct())
        new = written(small, "edges")
        drop_written(e)
        e = new
        if e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            # every target is a root; a node with two roots would join them
            twice = e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
            if twice.isEmpty():
                return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
