"""Shared helpers: written intermediate tables, table readers, hashing in
numpy, and a packed exchange of fingerprints."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

M64 = (1 << 64) - 1
_made: list[DataFrame] | None = None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wordloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors.  ``drop_written`` removes it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return _noted(out)


@contextmanager
def scratch_tables():
    """Collects the tables that ``written`` and ``bucketed`` make inside, for
    ``drop_written`` once their reader is through."""
    global _made
    outer, _made = _made, []
    try:
        yield _made
    finally:
        if outer is not None:
            outer.extend(_made)
        _made = outer


def _noted(df: DataFrame) -> DataFrame:
    if _made is not None:
        _made.append(df)
    return df


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` or ``bucketed`` once nothing reads it
    any more."""
    path = df._written_path
    if hasattr(df, "_written_table"):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._written_table}")
    sc = df.sparkSession.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name


# --- numpy hashing ------------------------------------------------------------
def splitmix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser over a uint64 array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of byte ranges of one buffer in O(1) each, through prefix sums of
    table[byte] * base**position (mod 2**64)."""

    _powers: dict = {}

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        base = int(splitmix(np.array([seed + 77], np.uint64))[0]) | 1
        table = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (seed + 1)))
        have = self._powers.get(seed)
        if have is None or len(have[0]) < n + 1:
            m = max(n + 1, 1 << 16)
            inverse = pow(base, -1, 1 << 64)
            have = tuple(np.cumprod(np.concatenate(
                [np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (base, inverse))
            if m <= 1 << 22:
                self._powers[seed] = have
        self.inverse = have[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.take(table, data, out=self.sums[1:])
        self.sums[1:] *= have[0][:n]
        np.cumsum(self.sums, out=self.sums)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of data[start:end] for arrays of bounds; the length is
        part of the hash."""
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return splitmix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def binary_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow binary column without nulls."""
    import pyarrow as pa
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = (np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None
            else np.zeros(0, np.uint8))
    return offsets, data


def blocks_of(offsets: np.ndarray, most: int):
    """Row ranges [i, j) of about ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


# --- judging packed fingerprints ------------------------------------------------
def pack(fp: np.ndarray, width: int) -> np.ndarray:
    """(n, width) bytes of each uint64: all of it, or the bits above the lowest
    eight if that is narrower."""
    v = fp if width == 8 else fp >> np.uint64(8)
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def unpack(cells: np.ndarray) -> np.ndarray:
    v = np.zeros((len(cells), 8), np.uint8)
    v[:, :cells.shape[1]] = cells
    return v.view("<u8").ravel()


def summed(fp: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Judge: the sum of each fingerprint's one-byte weights (1 without), 255
    at most."""
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    w = extra[:, 0].astype(np.int64)[order] if extra.shape[1] else np.ones(len(fp), np.int64)
    total = np.minimum(np.add.reduceat(w, first), 255)
    out = np.empty(len(fp), np.uint8)
    out[order] = np.repeat(total, np.diff(np.append(first, len(fp))))
    return out


#: Entries of several tiles that one task sends on together.
CHUNK_ENTRIES = 2_000_000


def judged_fingerprints(rows: DataFrame, buckets: int, judge, width: int = 6, extra: int = 0) -> DataFrame:
    """Brings equal fingerprints of all tiles together and sends a verdict back.

    ``rows`` is (tile, fps, extra): sorted uint64 packed as binary, and
    ``extra`` bytes for each.  The hash range is cut into ``buckets`` slices.
    A task puts the entries of its tiles together to chunks of about
    CHUNK_ENTRIES, and a chunk sends one row to each bucket: the entries,
    ``width`` + ``extra`` bytes each, and how many each tile has.
    ``judge(fps, extra bytes)`` gives a byte for each entry of a bucket.
    Returns (tile, verdicts), a byte for each entry in the order of the tile's
    ``fps``; a tile without entries has none.

    Rows follow chunks times buckets, so a row is as long as a chunk times a
    bucket over all entries: kilobytes up to some 10**13 entries.

    A tile lists a fingerprint as often as it needs to (once, mostly), so what
    a third of all documents share costs an entry per tile, not per document.
    With a width of 6, entries are taken for equal if they share a bucket and
    48 more bits."""
    buckets = max(buckets, 1)
    size = width + extra

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
        chunk = TaskContext.get().partitionId() << 33

        def sent(tiles, ats, cells):
            """A row for each bucket that the chunk has entries in."""
            n = np.diff(np.array(ats), axis=1)             # tiles by buckets
            used = np.flatnonzero(n.sum(0))
            blobs = [b"".join(c[at[k]:at[k + 1]].tobytes() for c, at in zip(cells, ats) if at[k + 1] > at[k]) for k in used]
            return pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array([chunk] * len(used), pa.int64()),
                 pa.array([tiles] * len(used), pa.list_(pa.int64())), pa.array([n[:, k] for k in used], pa.list_(pa.int64())),
                 pa.array(blobs, pa.binary())], ["bucket", "chunk", "tiles", "counts", "blob"])

        tiles, ats, cells, held = [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                fp = np.frombuffer(b.column(1)[i].as_py(), np.uint64)
                more = np.frombuffer(b.column(2)[i].as_py(), np.uint8).reshape(len(fp), extra)
                if held and held + len(fp) > CHUNK_ENTRIES:
                    yield sent(tiles, ats, cells)
                    tiles, ats, cells, held, chunk = [], [], [], 0, chunk + 1
                tiles.append(b.column(0)[i].as_py())
                ats.append(np.concatenate([[0], np.searchsorted(fp, bounds), [len(fp)]]))
                cells.append(np.concatenate([pack(fp, width), more], axis=1))
                held += len(fp)
        if tiles:
            yield sent(tiles, ats, cells)

    def settle(table):
        import pyarrow as pa
        blobs = table.column("blob").to_pylist()
        cells = np.concatenate([np.frombuffer(x, np.uint8) for x in blobs]).reshape(-1, size)
        verdict = judge(unpack(cells[:, :width]), cells[:, width:])
        at = np.concatenate([[0], np.cumsum([len(x) // size for x in blobs])])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "tiles": table.column("tiles"),
                         "counts": table.column("counts"),
                         "part": pa.array([verdict[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})

    def home(table):
        import pyarrow as pa
        table = table.sort_by("bucket")
        tiles = table.column("tiles")[0].as_py()
        out = [[] for _ in tiles]
        for counts, part in zip(table.column("counts").to_pylist(), table.column("part").to_pylist()):
            at = 0
            for own, n in zip(out, counts):
                own.append(part[at:at + n])
                at += n
        return pa.table({"tile": pa.array(tiles, pa.int64()), "verdicts": pa.array([b"".join(x) for x in out], pa.binary())})

    more = F.col("extra") if extra else F.lit(b"").alias("extra")
    sent = rows.select("tile", "fps", more).mapInArrow(
        cut, "bucket int, chunk long, tiles array<long>, counts array<long>, blob binary")
    judged = sent.groupBy("bucket").applyInArrow(
        settle, "chunk long, bucket int, tiles array<long>, counts array<long>, part binary")
    return judged.groupBy("chunk").applyInArrow(home, "tile long, verdicts binary")


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, so that later
    joins on the key move only their other side."""
    spark = df.sparkSession
    table, path = f"wordloom_{name}_{uuid.uuid4().hex}", scratch(spark, name)
    (df.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd")
     .option("path", path).saveAsTable(table))
    out = spark.table(table)
    out._written_path, out._written_table = path, table
    return _noted(out)


# --- words of packed texts ------------------------------------------------------
def byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Words of the contracts: everything but the six ASCII white-space bytes.
NON_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters and digits and all bytes of longer characters.
WORD_BYTES = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(starts, ends, index of the first word of each text plus the total) of
    the words in texts laid end to end; a word never crosses two texts."""
    mask = inside[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = mask[edge]
    ends[edge - 1] = mask[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = splitmix(h ^ words[i:i + n]) + np.uint64(i)
    return splitmix(h)
