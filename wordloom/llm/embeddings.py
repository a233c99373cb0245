"""Embedding near-duplicates: int8 tile products with an error bound for each
vector; only pairs that may reach the threshold are computed in double."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, read, written
from .graph import components, forest
from .registry import register

THRESHOLD = 0.9
#: Vectors of a tile, and rows of a tile that are multiplied at once.
TILE, STRIP = 4096, 512
#: Tiles whose centres are sent to all executors to rule out far tile pairs.
MOST_CENTRES = 8192
#: Tiles whose centres meet those of as many others in one task.
PARTNER_TILES = 2048
#: Float32 adds products of int8 exactly up to this many dimensions at a time.
EXACT_DIMENSIONS = (1 << 24) // (127 * 127)


def quantise(x: np.ndarray):
    """Unit rows -> (int8 rows, scale, length of the quantised row, length of
    the error), the last two rounded up: x = scale * q + error."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q.astype(np.float64) * scale[:, None]
    slack = 1 + 1e-12
    return q, scale, np.linalg.norm(back, axis=1) * slack, np.linalg.norm(x - back, axis=1) * slack + 1e-15


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def linked_pairs(a, b, threshold: float, same: bool):
    """(row of a, row of b) arrays of pairs with cosine >= threshold, strip by
    strip.  a and b: (unit rows, *quantise(rows)).

    x.y = s_x s_y (q_x.q_y) + (s_x q_x).e_y + e_x.y, so the int8 product is off
    by at most |s_x q_x| |e_y| + |e_x|."""
    xa, qa, sa, la, ea = a
    xb, qb, sb, _, eb = b
    wide = qb.astype(np.float32)
    for start in range(0, len(qa), STRIP):
        rows = slice(start, start + STRIP)
        # each part is a whole number below 2**24, so exact; several are added in double, exact too
        parts = [qa[rows, d:d + EXACT_DIMENSIONS].astype(np.float32) @ wide[:, d:d + EXACT_DIMENSIONS].T
                 for d in range(0, qa.shape[1], EXACT_DIMENSIONS)]
        dot = parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)
        # a pair may reach the threshold only if its product passes the loosest bound of its row
        bound = (threshold - 1e-6 - la[rows] * eb.max() - ea[rows]) / sa[rows]
        i, j = np.nonzero(dot >= (bound[:, None] / sb[None, :]).astype(np.float32) * np.float32(1 - 1e-6)
                          if (bound > 0).all() else np.ones_like(dot, bool))
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        off = la[i] * eb[j] + ea[i]
        near = dot[i - start, j].astype(np.float64) * sa[i] * sb[j] + off >= threshold - 1e-9
        i, j = i[near], j[near]
        for k in range(0, len(i), 1 << 16):
            p, r = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            yes = np.einsum("ij,ij->i", xa[p], xb[r]) >= threshold
            yield p[yes], r[yes]


def valid(vector: str):
    c = F.col(vector)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda v: v != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(rep, copies, dims, vector) for each different valid vector: counted
    map-side, so a vector that a third of all rows has is one row per task."""
    return (vectors.where(valid("vector")).groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
            .select("rep", "copies", F.size("vector").alias("dims"), "vector"))


def packed_tiles(reps: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(dims, tile, reps, copies, vectors packed as they are, in single or
    double precision) rows of about TILE vectors each.  Vectors of one length meet only vectors of that length; a
    tile holds vectors near one of the length's pivots, so that tiles of
    clustered data are compact."""
    pivots = {}
    for d, n in sizes.items():
        k = max(1, math.ceil(n / TILE))
        rows = reps.where(F.col("dims") == d).orderBy(F.xxhash64("rep"), "rep").limit(min(k, MOST_CENTRES)).collect()
        pivots[d] = unit(np.array([r["vector"] for r in rows], np.float64))

    def near(batches):
        import pyarrow as pa
        for b in batches:
            dims = b.column(0).to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = unit(np.array([b.column(3)[int(i)].as_py() for i in at], np.float64))
                cell[at] = np.argmax(x @ pivots[int(d)].T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["dims", "rep", "copies", "vector", "cell"])

    number = vector_number(reps)
    schema = reps.select("dims", "rep", "copies", "vector").schema.add("cell", "integer")
    celled = written(reps.select("dims", "rep", "copies", "vector").mapInArrow(near, schema), "cells")
    n = celled.groupBy("dims", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    celled = celled.join(n, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))

    def pack(key, table):
        import pyarrow as pa
        x = np.array(table.column("vector").to_pylist(), number)
        return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()),
                         "part": pa.array([key[2].as_py()], pa.int32()),
                         "reps": pa.array([table.column("rep").to_pylist()], pa.list_(pa.int64())),
                         "copies": pa.array([table.column("copies").to_pylist()], pa.list_(pa.int64())),
                         "vectors": pa.array([x.tobytes()], pa.binary())})

    packed = celled.groupBy("dims", "cell", "part").applyInArrow(
        pack, "dims int, cell int, part int, reps array<long>, copies array<long>, vectors binary")
    return written(packed.withColumn("tile", F.monotonically_increasing_id()), "tiles")


def vector_number(reps: DataFrame) -> str:
    """The numbers of the vector column: those of single precision travel so."""
    return "<f4" if reps.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"


def tile_shapes(tiles: DataFrame, number: str) -> DataFrame:
    """(tile, dims, centre, angle of the farthest vector) of each tile."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                x = unit(np.frombuffer(b.column(2)[i].as_py(), number).astype(np.float64).reshape(-1, b.column(1)[i].as_py()))
                c = x.mean(axis=0)
                c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
                angle = float(np.arccos(np.clip((x @ c).min(), -1, 1))) + 1e-6
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1),
                                                  pa.array([c.tolist()]), pa.array([angle])], ["tile", "dims", "centre", "angle"])
    return written(tiles.select("tile", "dims", "vectors").mapInArrow(run, "tile long, dims int, centre array<double>, angle double"),
                   "shapes")


def tile_partners(shapes: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i <= j: the pairs of tiles that may hold a link: the angle between
    their centres less both radii bounds the angle of any pair.  Shapes meet
    in blocks of PARTNER_TILES, so a task holds two blocks of centres."""
    limit = math.acos(threshold) + 1e-6
    blocks = max(1, math.ceil(shapes.count() / PARTNER_TILES))
    block = F.pmod(F.xxhash64("tile"), F.lit(blocks)).cast("int")
    spread = (shapes.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
              .withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")))

    def near(key, table):
        import pyarrow as pa
        _, a, b = (k.as_py() for k in key)
        tile, block = table.column("tile").to_numpy(), table.column("block").to_numpy()
        centre, angle = np.array(table.column("centre").to_pylist()), table.column("angle").to_numpy()
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        out = [np.zeros((0, 2), np.int64)]
        for k in left:
            apart = np.arccos(np.clip(centre[right] @ centre[k], -1, 1))
            other = tile[right[apart - angle[right] - angle[k] <= limit]]
            if a == b:
                other = other[other >= tile[k]]
            out.append(np.sort(np.stack([np.full(len(other), tile[k]), other], 1), axis=1))
        pairs = np.concatenate(out)
        return pa.table({"i": pa.array(pairs[:, 0], pa.int64()), "j": pa.array(pairs[:, 1], pa.int64())})

    return spread.groupBy("dims", "a", "b").applyInArrow(near, "i long, j long")


def tile_links(tiles: DataFrame, pairs: DataFrame, threshold: float, number: str) -> DataFrame:
    """Rows (id, links, other): links counted per vector, and a forest of the
    links of each tile pair as (id, 0, other)."""
    ends = (pairs.select("i", "j", F.col("i").alias("tile"))
            .unionByName(pairs.where("i <> j").select("i", "j", F.col("j").alias("tile"))))
    body = tiles.select("tile", "dims", "reps", "copies", "vectors")

    def run(key, table):
        import pyarrow as pa
        held = {}
        for t, d, r, c, v in zip(*(table.column(n).to_pylist() for n in ("tile", "dims", "reps", "copies", "vectors"))):
            x = unit(np.frombuffer(v, number).astype(np.float64).reshape(-1, d))
            held[t] = (np.array(r), np.array(c), (x, *quantise(x)))
        (i, j) = (k.as_py() for k in key)
        (ra, ca, a), (rb, cb, b) = held[i], held[j]
        na, nb, ties = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64), np.zeros((0, 2), np.int64)
        for p, q in linked_pairs(a, b, threshold, i == j):
            np.add.at(na, p, cb[q])
            np.add.at(nb, q, ca[p])
            ties = forest(np.concatenate([ties, np.stack([ra[p], rb[q]], 1)]))
        ids = np.concatenate([ra[na > 0], rb[nb > 0], ties[:, 0]])
        n = np.concatenate([na[na > 0], nb[nb > 0], np.zeros(len(ties), np.int64)])
        other = [None] * (len(ids) - len(ties)) + ties[:, 1].tolist()
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(n, pa.int64()), "other": pa.array(other, pa.int64())})

    return ends.join(body, "tile").groupBy("i", "j").applyInArrow(run, "id long, links long, other long")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``df``.

    Equal vectors are one vector with a count.  Different ones are packed into
    tiles; every pair of tiles that could hold a link is multiplied in int8.
    Exact: the product's error bound decides which pairs are computed again in
    double precision.  Work grows with the square of the different vectors in
    the worst case, as an exact all-pairs answer does; tiles of clustered data
    rule one another out by centre and radius.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and vectors of different lengths, link with nothing (n_links 0, component
    the own id).  A null id cannot be linked by others' ids: such rows are
    returned with no links.  Rows that share an id are one node; repeated rows
    are returned each and count as links of one another.  An empty table gives
    no rows.  Other columns are not read."""
    rows = written(df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")), "vectors")
    known = rows.where("id is not null")
    reps = written(distinct_vectors(known), "distinct")
    sizes = {r["dims"]: r["n"] for r in reps.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    tiles = packed_tiles(reps, sizes)
    number = vector_number(reps)
    shapes = tile_shapes(tiles, number)
    pairs = written(tile_partners(shapes, threshold), "pairs")
    found = written(tile_links(tiles, pairs, threshold, number), "links")
    for done in (tiles, shapes, pairs):
        drop_written(done)
    links = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_rep = (reps.join(counts, reps.rep == counts.id, "left").join(links, reps.rep == links.node, "left")
               .select("vector", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                       F.coalesce("component", "rep").alias("component")))
    out = rows.withColumn("ok", valid("vector") & F.col("id").isNotNull())
    good = out.where("ok").join(per_rep, "vector").select("id", "links", "component")
    rest = out.where("not ok").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return good.unionByName(rest).select(
        F.col("id").alias("vec_id"), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


_SQL = """
with recursive v as (select vec_id, embedding::double[] as x from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
      and len(list_filter(embedding, lambda e: e <> 0)) > 0),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
      and list_cosine_similarity(a.x, b.x) >= 0.9),
r(vec_id, node) as (select vec_id, vec_id from embeddings union select r.vec_id, l.y from r join l on r.node = l.x),
c as (select vec_id, min(node) as component_id from r group by 1)
select c.vec_id, (select count(*) from l where l.x = c.vec_id)::bigint as n_links, c.component_id,
  c.vec_id = c.component_id as kept from c
"""


@register("op2_embedding_dedup", _SQL)
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings: cosine >= 0.9."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
