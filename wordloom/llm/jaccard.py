"""Exact n-gram Jaccard join by vertical partitioning: the global shingle
order is cut into fragments, overlaps are counted per fragment in tasks of
their own and summed per pair."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (LOWER, NON_SPACE, Rolling, binary_parts, blocks_of, bucketed, drop_written, judged_fingerprints, read,
                     shingle_hashes, splitmix, summed, word_bounds, written)
from .graph import components, forest
from .registry import register

WORDS, PERCENT = 4, 85
#: Share of the hash range that is the first fragment: its shingles are counted
#: over all documents and ordered rarest first; prefixes are cut from it.
FIRST_SHARE = 0.30
#: Fragments of the hash range in which overlaps are counted apart.
FRAGMENTS = 4
#: Text that is worked on at once, and that one row of the tile table stands for.
BLOCK_BYTES, TILE_BYTES = 1 << 19, 2 << 20
#: First-fragment shingles that one counting task holds.
BUCKET_SHINGLES = 1_000_000
#: Sets of a product tile, and the shingles that end one sooner.
GROUP_TILE, GROUP_SHINGLES = 320, 640_000


def text_shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """Sorted distinct shingle hashes of each text: one array per text."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NON_SPACE)
    words = Rolling(data).ranges(starts, ends)
    whole = shingle_hashes(words, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(whole[a:b - k + 1]))
        elif b > a:  # fewer words: the whole sequence as one, apart from longer shingles
            out.append(splitmix(shingle_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingled(columns: int, k: int, batches):
    """(other columns, shingle array, text bytes) of each row; the text is the
    first column."""
    for b in batches:
        offsets, data = binary_parts(b.column(0))
        rest = [b.column(i) for i in range(1, columns)]
        for i, j in blocks_of(offsets, BLOCK_BYTES):
            at = offsets[i:j + 1] - offsets[i]
            for r, s in enumerate(text_shingles(data[offsets[i]:offsets[j]], at, k), i):
                yield [c[r].as_py() for c in rest], s, data[offsets[r]:offsets[r + 1]].tobytes()


def prefix_size(n: int, percent: int) -> int:
    """Two sets that link share one of so many first shingles of either, in any
    common order."""
    return n - (-(-percent * n // 100)) + 1


def early_size(n: int, percent: int) -> int:
    """So many first shingles of a set are early.  If two sets link, the first
    shingle of the order that they share is early in the smaller one: what is
    left there holds their whole overlap, at least 2p / (100 + p) of it."""
    return n - (-(-2 * percent * n // (100 + percent))) + 1


def tiles_of(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """Rows of about TILE_BYTES of text: ids, set sizes, set hashes, the packed
    first-fragment shingles of each set, and the texts end to end."""
    limit = np.uint64(int(FIRST_SHARE * 2**64))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        base, seq = TaskContext.get().partitionId() << 32, 0
        rows, held = [], 0

        def batch():
            ids, n, a, b, size, blobs, texts = zip(*rows)
            one = [pa.array([base + seq], pa.int64())]
            one += [pa.array([list(x)], pa.list_(t)) for x, t in (
                (ids, pa.int64()), (n, pa.int64()), (a, pa.int64()), (b, pa.int64()), (size, pa.int64()))]
            one += [pa.array([b"".join(x)], pa.binary()) for x in (blobs, texts)]
            one.append(pa.array([[len(t) for t in texts]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(one, ["tile", "ids", "n", "set_a", "set_b", "sizes", "frag", "texts", "ends"])

        for (i,), s, t in shingled(2, k, batches):
            part = s[:max(int(np.searchsorted(s, limit)), prefix_size(len(s), percent) if len(s) else 0)]
            mixed = splitmix(s + np.uint64(5))
            rows.append((i, len(s), int(s.sum(dtype=np.uint64).view(np.int64)),
                         int(mixed.sum(dtype=np.uint64).view(np.int64)), len(part), part.tobytes(), t))
            held += len(t) + 1
            if held > TILE_BYTES:
                yield batch()
                rows, held, seq = [], 0, seq + 1
        if rows:
            yield batch()

    source = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.col(doc_id).cast("long").alias("id"))
    return source.mapInArrow(run, "tile long, ids array<long>, n array<long>, set_a array<long>, set_b array<long>, "
                                  "sizes array<long>, frag binary, texts binary, ends array<long>")


def tile_fingerprints(tiles: DataFrame) -> DataFrame:
    """(tile, fps, weights): distinct first-fragment shingles and in how many
    of the tile's sets they stand."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                fp, n = np.unique(np.frombuffer(b.column(1)[i].as_py(), np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), pa.array([fp.tobytes()], pa.binary()),
                     pa.array([np.minimum(n, 255).astype(np.uint8).tobytes()], pa.binary())], ["tile", "fps", "extra"])
    return tiles.select("tile", "frag").mapInArrow(run, "tile long, fps binary, extra binary")


def prefixes(tiles: DataFrame, counts: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """(shingle, length class, rep, early) for the rarest-first prefix of each
    chosen set, without shingles that only one set has."""
    limit = np.uint64(int(FIRST_SHARE * 2**64))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                ids, n, sizes, frag, df, rows = (b.column(c)[i].as_py() for c in range(6))
                frag = np.frombuffer(frag, np.uint64)
                fps = np.unique(frag)
                df = np.frombuffer(df, np.uint8) if df else np.zeros(0, np.uint8)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                out = [], [], [], []
                for r in rows:
                    s = frag[at[r]:at[r + 1]]
                    often = df[np.searchsorted(fps, s)]
                    p = prefix_size(n[r], percent)
                    late = s >= limit  # beyond the fragment the order is by hash alone
                    order = np.lexsort((s, np.where(late, 0, often), late))[:p]
                    early = np.arange(len(order)) < early_size(n[r], percent)
                    keep = (often[order] > 1) | late[order]
                    order, early = order[keep], early[keep]
                    out[0].append(s[order].view(np.int64))
                    out[1].append(np.full(len(order), int(math.log(n[r]) / math.log(100 / (percent - 1)))))
                    out[2].append(np.full(len(order), ids[r], np.int64))
                    out[3].append(early)
                if out[0]:
                    s, c, d, e = (np.concatenate(x) for x in out)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c.astype(np.int32)), pa.array(d), pa.array(e)],
                                                     ["shingle", "class", "rep", "early"])

    joined = tiles.select("tile", "ids", "n", "sizes", "frag").join(chosen, "tile").join(counts, "tile", "left")
    return joined.select("ids", "n", "sizes", "frag", "verdicts", "rows").mapInArrow(run, "shingle long, class int, rep long, early boolean")


def heads_of(rows: DataFrame) -> DataFrame:
    """(shingle, class, head, low): the smallest set of each prefix shingle and
    length class, and that of the class below if the shingle is early there.
    Shingles that are early in neither are left out: no pair links by them."""
    heads = rows.groupBy("shingle", "class").agg(F.min("rep").alias("head"), F.max("early").alias("early"))
    low = heads.where("early").select("shingle", (F.col("class") + 1).alias("class"), F.col("head").alias("low"))
    return heads.join(low, ["shingle", "class"], "left").where("early or low is not null").drop("early")


def ties(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b): each set with the heads of its prefix shingles, once each."""
    return (rows.join(heads, ["shingle", "class"]).select(F.col("rep").alias("a"), F.col("head").alias("b"))
            .where("a <> b").distinct())


def candidate_edges(tied: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges (a, b) that tie together all sets that share a prefix shingle, early
    in the smaller one, and could be long enough for one another: those to the
    heads, and one between neighbouring length classes.  Grouping keeps hot
    shingles linear; no pair within a group is listed."""
    across = heads.where("low is not null").select(F.col("head").alias("a"), F.col("low").alias("b"))
    return tied.unionByName(across).where("a <> b")


# --- product tiles ---------------------------------------------------------------
def placed(members: DataFrame) -> DataFrame:
    """members (rep, component, anchor, n) -> (rep, place): product tiles of
    GROUP_TILE sets or fewer, GROUP_SHINGLES shingles but for the last set's.
    Sets are laid out by component and anchor, so that those with a prefix
    shingle in common lie close together and few pairs of tiles have one.
    Each partition of that order adds up its sets' weights; the sum of each,
    one number a partition, says where the next begins."""
    least = -(-GROUP_SHINGLES // GROUP_TILE)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            weight = np.maximum(b.column(1).to_numpy(), least)
            before = total + np.cumsum(weight) - weight
            total += int(weight.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(weight), part, np.int64)), pa.array(before),
                                              pa.array(before + weight)], ["rep", "part", "start", "end"])

    laid = written(members.repartitionByRange("component", "anchor", "rep").sortWithinPartitions("component", "anchor", "rep")
                   .select("rep", "n").mapInArrow(run, "rep long, part long, start long, end long"), "laid")
    sums = sorted((r["part"], r["n"]) for r in laid.groupBy("part").agg(F.max("end").alias("n")).collect())
    ends = np.cumsum([0] + [n for _, n in sums]).tolist()
    at = F.broadcast(members.sparkSession.createDataFrame([(p, e) for (p, _), e in zip(sums, ends)], "part long, first long"))
    out = written(laid.join(at, "part").select("rep", F.floor((F.col("first") + F.col("start")) / GROUP_SHINGLES).alias("place")), "places")
    drop_written(laid)
    return out


def tile_pairs(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(i, j), i <= j: the pairs of product tiles in which two sets share a
    prefix shingle, early in the smaller one, within one length class or two
    neighbouring ones, and each tile with itself.  A shingle that a third of
    all sets have lists tiles, GROUP_TILE times fewer than sets."""
    at = rows.join(places, "rep").groupBy("shingle", "class", "place").agg(F.max("early").alias("early"))
    same = at.select("shingle", "class", F.col("place").alias("other"), F.col("early").alias("found"))
    below = at.where("early").select("shingle", (F.col("class") + 1).alias("class"), F.col("place").alias("other"), F.lit(True).alias("found"))
    cross = (at.join(same.unionByName(below), ["shingle", "class"]).where("early or found")
             .select(F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j")).distinct())
    own = places.select(F.col("place").alias("i"), F.col("place").alias("j")).distinct()
    return cross.where("i <> j").unionByName(own)


def _fragment(s: np.ndarray, f: int) -> np.ndarray:
    """The part of a sorted set in fragment f of the hash range."""
    cut = [k * 2**64 // FRAGMENTS for k in range(FRAGMENTS + 1)]
    a = int(np.searchsorted(s, np.uint64(cut[f])))
    return s[a:int(np.searchsorted(s, np.uint64(cut[f + 1]))) if f + 1 < FRAGMENTS else len(s)]


def partial_overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of one product tile in one fragment."""
    total = np.zeros((len(sets), len(sets)), np.float64)
    row = np.repeat(np.arange(len(sets)), [len(c) for c in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, col, width = row[keep], column[at[keep]], int(shared.sum())
    for start in range(0, width, 8192):
        here = (col >= start) & (col < start + 8192)
        m = np.zeros((len(sets), min(8192, width - start)), np.float32)
        m[row[here], col[here] - start] = 1
        total += m @ m.T
    return total.astype(np.uint32)


def fragment_counts(members: DataFrame) -> DataFrame:
    """members (i, j, f, rep, n, part) -> (i, j, reps, ns, counts): for each pair
    of product tiles and fragment, the overlaps of its sets there, above the
    diagonal."""
    def run(batches):
        import pyarrow as pa
        key, rows = None, []

        def counted():
            reps, ns, parts = zip(*rows)
            both = partial_overlaps([np.frombuffer(p, np.uint64) for p in parts])
            upper = both[np.triu_indices(len(reps), 1)]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([list(reps)], pa.list_(pa.int64())),
                 pa.array([list(ns)], pa.list_(pa.int64())), pa.array([upper.astype("<u4").tobytes()], pa.binary())],
                ["i", "j", "reps", "ns", "counts"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in range(6))):
                if r[:3] != key:
                    if len(rows) > 1:
                        yield counted()
                    key, rows = r[:3], []
                rows.append(r[3:])
        if len(rows) > 1:
            yield counted()

    spread = members.repartition("i", "j", "f").sortWithinPartitions("i", "j", "f", "rep")
    return spread.select("i", "j", "f", "rep", "n", "part").mapInArrow(
        run, "i long, j long, reps array<long>, ns array<long>, counts binary")


def summed_links(counts: DataFrame, percent: int) -> DataFrame:
    """Sums the overlaps of each pair over the fragments: (a, b) edges that join
    exactly the sets that link, a forest for each pair of product tiles."""
    def links(table):
        import pyarrow as pa
        reps, ns = (np.array(table.column(c)[0].as_py(), np.int64) for c in ("reps", "ns"))
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist())
        a, b = np.triu_indices(len(reps), 1)
        linked = 100 * total >= percent * (ns[a] + ns[b] - total)
        e = forest(np.stack([reps[a[linked]], reps[b[linked]]], 1))
        return pa.table({"a": pa.array(e[:, 0], pa.int64()), "b": pa.array(e[:, 1], pa.int64())})

    return counts.groupBy("i", "j").applyInArrow(links, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs``.

    1. Each set's shingles below FIRST_SHARE of the hash range are packed into
       tiles and counted over all documents; equal sets get one representative.
    2. Representatives that share a shingle of their rarest-first prefixes are
       tied into groups (linear in the prefix rows); sets that link are always
       in one group.  Groups are laid out in product tiles, neighbours close
       together.
    3. For every two product tiles that share a prefix shingle, the hash range
       is cut into fragments: a task of its own counts the overlaps of all
       sets of the two tiles in one fragment, and the counts of each pair of
       sets are summed over the fragments, as one block for each two tiles.
       What links goes on as a forest.
    4. Components over the links give the result.

    A null or empty text has no set and links with nothing; a null id stays
    alone and its component is null; rows with one id are one node; repeated
    rows are returned each.  An empty table gives no rows.  Other columns are
    not read."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = bucketed(tiles_of(docs, doc_id, text, words, percent), "tile", parts, "sets")
    zipped = F.explode(F.arrays_zip("ids", "n", "set_a", "set_b", F.sequence(F.lit(0), F.size("ids") - 1).alias("row")))
    sets = tiles.select("tile", zipped.alias("s")).select(
        "tile", F.col("s.row").alias("row"), F.col("s.ids").alias("id"), F.col("s.n").alias("n"),
        F.col("s.set_a").alias("set_a"), F.col("s.set_b").alias("set_b"))
    reps = written(sets.where("n > 0 and id is not null").groupBy("set_a", "set_b", "n")
                   .agg(F.min(F.struct("id", "tile", "row")).alias("r"))
                   .select("set_a", "set_b", "n", "r.id", "r.tile", "r.row"), "reps")
    total = tiles.agg(F.sum(F.octet_length("frag"))).first()[0] or 0
    counts = judged_fingerprints(tile_fingerprints(tiles), math.ceil(total / 8 / BUCKET_SHINGLES) * 8, summed, extra=1)
    chosen = reps.groupBy("tile").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    rows = written(prefixes(tiles, counts, chosen, percent), "prefixes")
    heads = heads_of(rows)
    tied = written(ties(rows, heads), "ties")
    groups = components(candidate_edges(tied, heads))
    named = written(groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()), "groups")
    anchors = tied.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("anchor"))
    at = reps.select(F.col("id").alias("node"), "n", "tile", "row")
    places = placed(named.join(anchors, "node", "left").join(at, "node").select(
        F.col("node").alias("rep"), "component", F.least("node", "anchor").alias("anchor"), "n"))
    pairs = written(tile_pairs(rows, places), "pairs")
    members = places.join(at.withColumnRenamed("node", "rep"), "rep").select("tile", F.struct("row", "place", "n").alias("m"))
    parts_of = set_fragments(tiles, members.groupBy("tile").agg(F.collect_list("m").alias("members")), words)
    both = pairs.select(F.col("i").alias("place"), "i", "j").unionByName(
        pairs.where("i <> j").select(F.col("j").alias("place"), "i", "j"))
    links = components(summed_links(fragment_counts(parts_of.join(both, "place")), percent))
    found = sets.join(reps.select("set_a", "set_b", "n", F.col("id").alias("rep")), ["set_a", "set_b", "n"], "left")
    found = found.join(links.withColumnRenamed("node", "rep"), "rep", "left")
    linked = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("id"))
    out = written(found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), linked.alias("component_id")), "components")
    for done in (tiles, reps, rows, tied, named, places, pairs):
        drop_written(done)
    return out


def set_fragments(tiles: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(place, f, rep, n, part): the set of each member, cut into fragments; an
    empty part keeps its row.  The texts stay in their buckets; only the lists
    of members move."""
    def run(batches):
        import pyarrow as pa
        names = ["place", "f", "rep", "n", "part"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for i in range(b.num_rows):
                ids, ends, texts, members = (b.column(c)[i].as_py() for c in range(4))
                edge = np.concatenate([[0], np.cumsum(ends)]).astype(np.int64)
                data = np.frombuffer(texts, np.uint8)
                for block in range(0, len(members), 256):
                    some = members[block:block + 256]
                    cells = [data[edge[m["row"]]:edge[m["row"] + 1]] for m in some]
                    at = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
                    sets = text_shingles(np.concatenate(cells), at, words)
                    out = [(m["place"], f, ids[m["row"]], m["n"], _fragment(s, f).tobytes())
                           for m, s in zip(some, sets) for f in range(FRAGMENTS)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return (tiles.select("tile", "ids", "ends", "texts").join(members, "tile").select("ids", "ends", "texts", "members")
            .mapInArrow(run, "place long, f int, rep long, n long, part binary"))


_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) end as s from d),
p as (select doc_id, len(s)::bigint as n, unnest(s) as g from s),
o as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c
    from p a join p b on a.g = b.g and a.doc_id < b.doc_id
      and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
l as (select x, y from o where 100 * c >= 85 * (nx + ny - c)),
e as (select x, y from l union all select y, x from l),
r(doc_id, node) as (select doc_id, doc_id from documents union select r.doc_id, e.y from r join e on r.node = e.x)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id
from s join (select doc_id, min(node) as component_id from r group by 1) c using (doc_id)
"""


@register("op10_jaccard_join", _SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents: four words, 85 of 100."""
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
