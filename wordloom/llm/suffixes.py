"""Repeated 200-byte strings by distributed difference-cover sampling: sampled
tuples are named and unique names discarded, the rest are named again with
their surroundings, and the suffixes left between samples are merged in by
their own prefixes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, binary_parts, bucketed, judged_fingerprints, read, splitmix, summed
from .registry import register

LENGTH = 200
# A perfect difference set modulo 133 (fixed values): every difference modulo
# 133 is that of exactly one pair, so two positions have exactly one shift
# below 133 that takes both to sampled positions.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
#: Text of one row of the tile table, and entries that one naming task holds.
TILE_BYTES = 1 << 19
BUCKET_ENTRIES = 1_000_000


def text_tiles(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of about TILE_BYTES of text: ids, text lengths, texts end to end."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([base + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())],
                ["tile", "ids", "sizes", "data"])

        for b in batches:
            offsets, data = binary_parts(b.column(0))
            keys = b.column(1).to_pylist()
            for r, key in enumerate(keys):
                ids.append(key)
                texts.append(data[offsets[r]:offsets[r + 1]].tobytes())
                held += len(texts[-1])
                if held >= TILE_BYTES:
                    yield batch()
                    ids, texts, held, seq = [], [], 0, seq + 1
        if ids:
            yield batch()

    source = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.col(doc_id).cast("long").alias("id"))
    return source.mapInArrow(run, "tile long, ids array<long>, sizes array<long>, data binary")


class Tile:
    """The sampled suffixes of one tile's texts."""

    def __init__(self, sizes: list[int], data: bytes, length: int):
        self.length, self.data = length, np.frombuffer(data, np.uint8)
        self.edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hashes = Rolling(self.data, 1)
        cover = np.array(COVER, np.int64)
        #: Bytes that a repeated string still has from its sampled position on.
        tuple_ = length - PERIOD + 1
        at, low, high = [], [], []
        for a, b in zip(self.edges[:-1], self.edges[1:]):
            if b - a >= length:
                p = (np.arange(0, b - a, PERIOD)[:, None] + cover).ravel()
                p = p[p <= b - a - tuple_] + a
                at.append(p)
                low.append(np.full(len(p), a))
                high.append(np.full(len(p), b))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.at, self.low, self.high = cat(at), cat(low), cat(high)
        self.name = self.hashes.ranges(self.at, self.at + tuple_)

    def distinct_names(self):
        """Sorted names, and in how many places of the tile each stands."""
        return np.unique(self.name, return_counts=True)

    def keep_repeated(self, verdicts: bytes | None) -> None:
        """Discard the sampled suffixes whose name no other place has."""
        names, n = self.distinct_names()
        again = (np.frombuffer(verdicts or b"", np.uint8) > 1) | (n > 1)
        keep = again[np.searchsorted(names, self.name)] if len(names) else np.zeros(0, bool)
        self.at, self.low, self.high, self.name = (x[keep] for x in (self.at, self.low, self.high, self.name))
        # second name: all that a repeated string through this sample can hold
        left = np.maximum(self.low, self.at - PERIOD + 1)
        right = np.minimum(self.high, self.at + self.length)
        whole = self.hashes.ranges(left, right)
        self.context = splitmix(whole + (self.at - left).astype(np.uint64) * np.uint64(0x9E3779B1))

    def contexts(self):
        """(names, contexts, places) of the distinct pairs, sorted."""
        order = np.lexsort((self.context, self.name))
        a, b = self.name[order], self.context[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        pair = np.empty(len(a), np.int64)
        pair[order] = np.cumsum(new) - 1
        return a[first], b[first], np.diff(np.append(first, len(a))), pair

    def strings(self, chosen: np.ndarray):
        """(first, last) starts of strings through the chosen samples; empty
        ranges left out."""
        a = np.maximum(self.low, self.at - PERIOD + 1)[chosen]
        b = np.minimum(self.at, self.high - self.length)[chosen]
        return a[a <= b], b[a <= b]

    def prefixes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the strings that start at ``at``, in pieces to save memory."""
        out = np.empty(len(at), np.uint64)
        for i in range(0, len(at), 1 << 16):
            piece = at[i:i + (1 << 16)]
            out[i:i + (1 << 16)] = self.hashes.ranges(piece, piece + self.length)
        return out

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """All starts of strings through the chosen samples, each once."""
        a, b = self.strings(chosen)
        step = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(step, a, 1)
        np.add.at(step, b + 1, -1)
        np.cumsum(step, out=step)
        return np.flatnonzero(step[:-1] > 0)


def judge_contexts(name: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """1: this context stands elsewhere too, so every string in it repeats.  3: it
    stands once, and its strings must be compared one by one.  2: like 1, but
    its name also has a context that stands once; the first of its tiles
    lends its strings to that comparison."""
    context, places = np.ascontiguousarray(extra[:, :8]).view("<u8").ravel(), extra[:, 8].astype(np.int64)
    order = np.lexsort((context, name))
    a, b = name[order], context[order]
    new_name = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_name | np.concatenate([[True], b[1:] != b[:-1]])
    first = np.flatnonzero(new)
    total = np.add.reduceat(places[order], first)
    group = np.cumsum(new_name)[first] - 1
    single = np.zeros(group[-1] + 1, bool)
    single[group[total == 1]] = True
    state = np.where(total == 1, 3, 1)
    verdict = np.repeat(state, np.diff(np.append(first, len(a))))
    lend = first[(total > 1) & single[group]]
    verdict[lend] = 2
    out = np.empty(len(a), np.uint8)
    out[order] = verdict
    return out


def removed_mask(tile: Tile, states: bytes | None, verdicts: bytes | None) -> np.ndarray:
    """Which bytes of the tile lie in a string that starts anywhere else."""
    step = np.zeros(len(tile.data) + 1, np.int64)
    if len(tile.at):
        _, _, _, pair = tile.contexts()
        state = np.frombuffer(states, np.uint8)[pair]
        a, b = tile.strings(state < 3)
        np.add.at(step, a, 1)
        np.add.at(step, b + tile.length, -1)
        at = tile.starts(state > 1)
        if len(at):
            names = tile.prefixes(at)
            fp, n = np.unique(names, return_counts=True)
            again = (np.frombuffer(verdicts or b"", np.uint8) > 1) | (n > 1)
            at = at[again[np.searchsorted(fp, names)]]
            np.add.at(step, at, 1)
            np.add.at(step, at + tile.length, -1)
    np.cumsum(step, out=step)
    return step[:-1] > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), a row per row of ``docs``: every byte
    that lies in a ``length``-byte string which also starts anywhere else, in
    the same text or another, is removed; spans are the maximal removed runs
    as [start, end) byte pairs, kept the remaining bytes.  Strings are
    judged on the input and never cross texts.

    Depth is bounded, so suffixes are ordered by ``length`` bytes only and
    the difference cover has the period PERIOD in place of three: of every 133
    suffixes 12 are sampled, and any two places that share a string are both
    sampled at one shift within it.
    1. A sampled suffix is named by the tuple of ``length`` - PERIOD + 1 bytes
       that a shared string is sure to have; names are sorted in buckets
       over all tiles, and a suffix whose name is unique is discarded.
    2. The rest are named again by all bytes that a string through the sample
       can hold.  If another place has the same, every such string repeats.
    3. Suffixes between the samples of contexts that stand once are merged in:
       their ``length``-byte prefixes are sorted, and equal neighbours repeat.
    Names are 64-bit hashes, sorted within hash buckets: only their equality
    matters.  Nothing is compared pair by pair, so a passage that a third of
    all texts share is an entry per tile.

    Null is the empty text; texts shorter than ``length`` keep all; repeated
    rows remove one another; an empty table gives no rows.  A text must fit a
    worker, at some 60 bytes of memory a byte.  Other columns are not read."""
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    spark = docs.sparkSession
    # a bucket's tiles travel to Python as one batch: more and smaller buckets
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = bucketed(text_tiles(docs, doc_id, text), "tile", parts, "texts")
    total = tiles.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = math.ceil(total * len(COVER) / PERIOD / BUCKET_ENTRIES) * 4

    def names(batches):
        for b in batches:
            for tile, sizes, data in _rows(b, "tile", "sizes", "data"):
                fp, _ = Tile(sizes, data, length).distinct_names()
                yield _packed(tile, fp, b"")

    named = judged_fingerprints(tiles.select("tile", "sizes", "data").mapInArrow(names, _FPS), buckets, summed)
    named = named.withColumnRenamed("verdicts", "named")

    def contexts(batches):
        for b in batches:
            for tile, sizes, data, verdicts in _rows(b, "tile", "sizes", "data", "named"):
                t = Tile(sizes, data, length)
                t.keep_repeated(verdicts)
                a, c, n, _ = t.contexts()
                extra = np.concatenate([c.astype("<u8").view(np.uint8).reshape(-1, 8),
                                        np.minimum(n, 255).astype(np.uint8)[:, None]], axis=1)
                yield _packed(tile, a, extra.tobytes())

    once = tiles.join(named, "tile", "left")
    states = judged_fingerprints(once.select("tile", "sizes", "data", "named").mapInArrow(contexts, _FPS),
                                 buckets, judge_contexts, extra=9).withColumnRenamed("verdicts", "states")

    def prefixes(batches):
        for b in batches:
            for tile, sizes, data, verdicts, state in _rows(b, "tile", "sizes", "data", "named", "states"):
                t = Tile(sizes, data, length)
                t.keep_repeated(verdicts)
                if len(t.at):
                    _, _, _, pair = t.contexts()
                    at = t.starts(np.frombuffer(state, np.uint8)[pair] > 1)
                    fp, n = np.unique(t.prefixes(at), return_counts=True)
                    yield _packed(tile, fp, np.minimum(n, 255).astype(np.uint8).tobytes())

    twice = once.join(states, "tile", "left")
    merged = judged_fingerprints(twice.select("tile", "sizes", "data", "named", "states").mapInArrow(prefixes, _FPS),
                                 buckets, summed, width=8, extra=1).withColumnRenamed("verdicts", "merged")

    def remove(batches):
        import pyarrow as pa
        for b in batches:
            for _, ids, sizes, data, verdicts, state, last in _rows(
                    b, "tile", "ids", "sizes", "data", "named", "states", "merged"):
                t = Tile(sizes, data, length)
                t.keep_repeated(verdicts)
                gone = removed_mask(t, state, last)
                spans, kept = [], []
                for x, y in zip(t.edges[:-1], t.edges[1:]):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[x:y].astype(np.int8), [0]])))
                    spans.append(edge.reshape(-1, 2).tolist())
                    kept.append(t.data[x:y][~gone[x:y]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"])

    out = twice.join(merged, "tile", "left").select("tile", "ids", "sizes", "data", "named", "states", "merged")
    return out.mapInArrow(remove, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")


_FPS = "tile long, fps binary, extra binary"


def _rows(batch, *names):
    for i in range(batch.num_rows):
        yield [batch.column(n)[i].as_py() for n in names]


def _packed(tile: int, fp: np.ndarray, extra: bytes):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([fp.tobytes()], pa.binary()),
                                       pa.array([extra], pa.binary())], ["tile", "fps", "extra"])




_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, i, md5(array_slice(b, i + 1, i + 200)) as h
    from (select doc_id, b, unnest(range(0, octet_length(b) - 199)) as i from d where octet_length(b) >= 200)),
m as (select w.doc_id, i from w join (select h from w group by h having count(*) > 1) using (h)),
n as (select doc_id, i, sum(first::int) over (partition by doc_id order by i) as run from (
    select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 200, true) as first from m)),
s as (select doc_id, min(i) as a, max(i) + 200 as z from n group by doc_id, run),
k as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as a, a as z from s
    union all select d.doc_id, coalesce(max(s.z), 0), octet_length(any_value(b)) from d left join s using (doc_id) group by d.doc_id),
t as (select k.doc_id, sha256(unhex(string_agg(hex(array_slice(b, k.a + 1, k.z)), '' order by k.a))) as kept_sha256
    from k join d using (doc_id) group by k.doc_id)
select d.doc_id, octet_length(b)::bigint as n_bytes, coalesce(c.n, 0)::bigint as n_removed, coalesce(c.runs, 0)::bigint as n_spans, kept_sha256
from d join t using (doc_id) left join (select doc_id, sum(z - a) as n, count(*) as runs from s group by 1) c using (doc_id)
"""


@register("op4_suffix_dedup", _SQL)
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
