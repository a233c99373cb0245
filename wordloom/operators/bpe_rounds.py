"""Rounds of byte-level BPE training over packed blocks of words.

Words lie in blocks: one row holds the symbols of many words end to end as
32-bit numbers, the end of each word and its count.  Adjacent pairs are written
as one 64-bit number, left symbol above right.  The pair counts are a table of
their own in buckets of the pair, changed by what each round adds and takes
away.

A round rests on this: take the pairs of the highest counts, down to some count
t, as *active* and cut every word wherever a pair is not.  A pair below t cannot
be merged while there is one at t or above, and what a merge makes across such
a cut counts no more than the pair it replaces.  So all merges down to t are
decided by the runs between the cuts.  Runs are short and few are different:
they are added up on Spark, and only the different ones, a bounded number, go
to the driver, which takes merges from them one at a time until none of t or
more is left.  Then every word with an active pair gets its new runs by
look-up, and only these words change the pair counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols of one block of words.
BLOCK_SYMBOLS = 2_000_000
BLOCK_SCHEMA = "kind int, bucket int, a binary, b binary, c binary"
WORDS, PAIRS = 0, 1   # kinds of rows: a block of words, changes of pair counts
TABLE, FIRST = 0, 1   # of the pair table: a bucket, its first pairs


# --- one block -------------------------------------------------------------------
def pair_codes(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The pair at each place but the last; -1 where it would cross two words."""
    codes = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
    codes[ends[:-1] - 1] = -1
    return codes


def added(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, ascending, with the sum of its weights."""
    import pyarrow as pa
    found = pa.array(codes, pa.int64()).dictionary_encode()
    total = np.zeros(len(found.dictionary), np.int64)
    np.add.at(total, np.asarray(found.indices), weights)
    codes = np.asarray(found.dictionary)
    order = np.argsort(codes)
    return codes[order], total[order]


def pair_sums(symbols: np.ndarray, ends: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of the words with its count, words counting ``n`` times."""
    if len(symbols) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = pair_codes(symbols, ends)
    weights = np.repeat(n, np.diff(ends, prepend=0))[:-1]
    inside = codes >= 0
    return added(codes[inside], weights[inside])


def active_runs(symbols: np.ndarray, ends: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past the last) symbol of each maximal run of active pairs;
    ``active`` is sorted and not empty."""
    if len(symbols) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # only where both symbols occur in active pairs, on their sides, is the pair looked up
    left, right = np.zeros((2, int(max(symbols.max(), (active >> 32).max(), (active & 0xFFFFFFFF).max())) + 1), bool)
    left[active >> 32] = right[active & 0xFFFFFFFF] = True
    hit = left[symbols[:-1]] & right[symbols[1:]]
    hit[ends[:-1] - 1] = False
    at = np.flatnonzero(hit)
    codes = (symbols[at].astype(np.int64) << 32) | symbols[at + 1]
    hit[at] = active[np.minimum(np.searchsorted(active, codes), len(active) - 1)] == codes
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1


def run_keys(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different runs, as bytes, and for each run which of them it is."""
    import pyarrow as pa
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = symbols[np.repeat(start - at[:-1], size) + np.arange(at[-1])].astype("<i4")
    runs = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(4 * at), pa.py_buffer(data)]).dictionary_encode()
    return runs.dictionary.to_pylist(), np.asarray(runs.indices).astype(np.int64)


def with_new_runs(symbols, ends, n, active, changed: dict[bytes, bytes]):
    """The block after a round, words of one symbol left out, and the changes
    of the pair counts: (symbols, ends, n, codes, changes)."""
    start, end = active_runs(symbols, ends, active)
    keys, which = run_keys(symbols, start, end)
    new = [changed.get(k) for k in keys]
    hit = np.array([x is not None for x in new], bool)[which] if len(which) else np.zeros(0, bool)
    start, end, which = start[hit], end[hit], which[hit]
    word = np.searchsorted(ends, start, "right")
    touched = np.zeros(len(ends), bool)
    touched[word] = True
    lengths = np.diff(ends, prepend=0)
    of_touched = np.repeat(touched, lengths)
    before = pair_sums(symbols[of_touched], np.cumsum(lengths[touched]), n[touched])

    # lengths after: a changed run stands at its first symbol
    size = np.ones(len(symbols), np.int64)
    inside = np.zeros(len(symbols) + 1, np.int64)
    inside[start] += 1
    np.subtract.at(inside, end, 1)
    inside = np.cumsum(inside)[:-1] > 0
    values = [np.frombuffer(x, np.int32) if x is not None else np.zeros(0, np.int32) for x in new]
    value_size = np.array([len(v) for v in values], np.int64)
    value_at = np.cumsum(value_size) - value_size
    size[inside] = 0
    size[start] = value_size[which]
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.int32)
    out[at[:-1][~inside]] = symbols[~inside]
    if len(which):
        long = value_size[which]
        shift = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        out[np.repeat(at[start], long) + shift] = np.concatenate(values)[np.repeat(value_at[which], long) + shift]
    new_ends = at[ends]
    lengths = np.diff(new_ends, prepend=0)
    of_touched = np.repeat(touched, lengths)
    after = pair_sums(out[of_touched], np.cumsum(lengths[touched]), n[touched])
    codes, change = added(np.concatenate([before[0], after[0]]), np.concatenate([-before[1], after[1]]))
    keep = lengths > 1
    return (out[np.repeat(keep, lengths)], np.cumsum(lengths[keep]), n[keep], codes[change != 0], change[change != 0])


# --- blocks as rows --------------------------------------------------------------
def _pair_rows(codes: np.ndarray, counts: np.ndarray, buckets: int):
    bucket = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    codes, counts, bucket = codes[order], counts[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(codes) else [0]
    for i, j in zip(cut[:-1], cut[1:]):
        yield PAIRS, int(bucket[i]), codes[i:j].astype("<i8").tobytes(), counts[i:j].astype("<i8").tobytes(), None


def _rows(rows):
    import pyarrow as pa
    kinds, buckets, a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()),
         pa.array(c, pa.binary())], ["kind", "bucket", "a", "b", "c"])


def _word_row(symbols, ends, n):
    return WORDS, 0, symbols.astype("<i4").tobytes(), ends.astype("<i8").tobytes(), n.astype("<i8").tobytes()


def first_blocks(word_counts: DataFrame, buckets: int) -> DataFrame:
    """(token, n) -> blocks of bytes and all their pair counts."""
    def pack(batches):
        held, size = [], 0

        def block():
            symbols = np.concatenate([x[0] for x in held])
            shift = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
            ends = np.concatenate([x[1] + s for x, s in zip(held, shift)])
            n = np.concatenate([x[2] for x in held])
            rows = [_word_row(symbols, ends, n), *_pair_rows(*pair_sums(symbols, ends, n), buckets)]
            held.clear()
            return _rows(rows)

        for batch in batches:
            tokens, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            long = np.array([len(t) for t in tokens], np.int64)
            keep = long > 1
            if not keep.any():
                continue
            symbols = np.frombuffer(b"".join(t for t in tokens if len(t) > 1), np.uint8).astype(np.int32)
            held.append((symbols, np.cumsum(long[keep]), n[keep].astype(np.int64)))
            size += len(symbols)
            if size >= BLOCK_SYMBOLS:
                yield block()
                size = 0
        if held:
            yield block()

    words = word_counts.where(F.col("token").isNotNull()).select(
        F.encode("token", "UTF-8").alias("token"), F.col("n").cast("long").alias("n"))
    return words.mapInArrow(pack, BLOCK_SCHEMA)


def _blocks(batches):
    for batch in batches:
        for a, b, c in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "c"))):
            yield np.frombuffer(a, "<i4"), np.frombuffer(b, "<i8"), np.frombuffer(c, "<i8")


def next_blocks(blocks: DataFrame, active, changed, buckets: int) -> DataFrame:
    """Blocks after a round and the changes of the pair counts; ``active`` and
    ``changed`` are broadcast."""
    def step(batches):
        for symbols, ends, n in _blocks(batches):
            symbols, ends, n, codes, change = with_new_runs(symbols, ends, n, active.value, changed.value)
            rows = list(_pair_rows(codes, change, buckets))
            if len(n):
                rows.append(_word_row(symbols, ends, n))
            if rows:
                yield _rows(rows)

    return blocks.mapInArrow(step, BLOCK_SCHEMA)


def run_counts(blocks: DataFrame, active) -> DataFrame:
    """(run, n): the different runs of active pairs, each block's added up first."""
    def runs(batches):
        import pyarrow as pa
        for symbols, ends, n in _blocks(batches):
            start, end = active_runs(symbols, ends, active.value)
            keys, which = run_keys(symbols, start, end)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, which, n[np.searchsorted(ends, start, "right")])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(total, pa.int64())], ["run", "n"])

    return blocks.mapInArrow(runs, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))


def next_pairs(pairs: DataFrame, changes: DataFrame, order, least: int, most: int) -> DataFrame:
    """The pair table with the changes added, as rows of kind TABLE (a: codes, b:
    counts), and as rows of kind FIRST each bucket's first ``most`` pairs of
    count ``least`` or more, highest count first, then by the tokens' bytes
    (``order``, broadcast, has the place of each token in that order); c is
    empty if there are more."""
    def settle(key, left, right):
        import pyarrow as pa
        a, b = ([np.frombuffer(x, "<i8") for t in (left, right) for x in t.column(k).to_pylist()] for k in ("a", "b"))
        codes, counts = added(np.concatenate(a), np.concatenate(b))
        codes, counts = codes[counts > 0], counts[counts > 0]
        first = np.flatnonzero(counts >= least)
        whole = len(first) <= most
        if not whole:
            bar = np.partition(counts[first], len(first) - most)[len(first) - most]
            first = first[counts[first] >= bar]
        first = first[in_order(codes[first], counts[first], order.value)][:most]
        rows = [(TABLE, codes, counts, b"1"), (FIRST, codes[first], counts[first], b"1" if whole else b"")]
        return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([key[0].as_py()] * 2, pa.int32()),
                         "a": pa.array([r[1].astype("<i8").tobytes() for r in rows], pa.binary()),
                         "b": pa.array([r[2].astype("<i8").tobytes() for r in rows], pa.binary()),
                         "c": pa.array([r[3] for r in rows], pa.binary())})

    return (pairs.select("bucket", "a", "b").groupBy("bucket")
            .cogroup(changes.select("bucket", "a", "b").groupBy("bucket")).applyInArrow(settle, BLOCK_SCHEMA))


def in_order(codes: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places in the order in which training takes pairs."""
    return np.lexsort((order[codes & 0xFFFFFFFF], order[codes >> 32], -counts))


# --- the driver's part -------------------------------------------------------------
def first_pairs(tops: list[tuple[bytes, bytes, bytes]], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The first pairs of all buckets in order, as far as every bucket's are
    known, and whether these are all."""
    if not tops:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), True
    parts = [(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")) for a, b, _ in tops]
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    last = np.concatenate([np.arange(len(a)) == len(a) - 1 if not c else np.zeros(len(a), bool)
                           for (a, _), (_, _, c) in zip(parts, tops)])
    at = in_order(codes, counts, order)
    codes, counts, last = codes[at], counts[at], last[at]
    if not last.any():
        return codes, counts, True
    known = int(np.flatnonzero(last)[0]) + 1
    return codes[:known], counts[:known], False


def choose_active(counts: np.ndarray, whole: bool, wanted: int, cut: bool = False) -> tuple[int, int]:
    """(how many of the first pairs are active, least count to merge).  About
    ``wanted``, with all that share the last one's count.  If those are not
    all known, or with ``cut``, pairs of that count stay out, and only the
    pairs above it may be merged, or a single one."""
    wanted = max(1, min(wanted, len(counts)))
    t = int(counts[wanted - 1])
    level = int(np.searchsorted(-counts, -t, "right"))       # past the last pair of count t
    if not cut and (level < len(counts) or whole):
        return level, t
    above = int(np.searchsorted(-counts, -t, "left"))
    if above and not cut:
        return above, int(counts[above - 1])
    return (wanted, t + 1) if wanted < level or not whole else (level, t)


def merge_runs(runs: Iterable[tuple[bytes, int]], tokens: list[bytes], ids: dict[bytes, int], budget: int, least: int):
    """Merges (left, right, count) of one-at-a-time training on weighted runs,
    while the first pair has a count of ``least`` or more (the very first is
    taken anyway), until ``budget`` new tokens are made or a merge makes a token
    that is there already, whose counts add up from several pairs.  ``tokens``
    and ``ids`` grow.  Also returns {run: run after} of the changed ones."""
    keys, seqs, ns = [], [], []
    counts: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], list[int]] = {}
    for i, (run, n) in enumerate(runs):
        q = np.frombuffer(run, "<i4").tolist()
        keys.append(run)
        seqs.append(q)
        ns.append(n)
        for p in zip(q, q[1:]):
            counts[p] = counts.get(p, 0) + n
            at = where.setdefault(p, [])
            if not at or at[-1] != i:
                at.append(i)
    heap = [(-c, tokens[p[0]], tokens[p[1]], p) for p, c in counts.items()]
    heapq.heapify(heap)
    merges, changed = [], set()
    while budget > 0 and heap:
        c, left, right, pair = heapq.heappop(heap)
        now = counts.get(pair, 0)
        if now != -c:   # a pair made anew gets an entry then; others only fall
            if now > 0:
                heapq.heappush(heap, (-now, left, right, pair))
            continue
        if now < least and merges:
            break
        there = ids.get(left + right)
        merged = len(tokens) if there is None else there
        merges.append((pair[0], pair[1], now))
        if there is None:
            tokens.append(left + right)
            ids[left + right] = merged
            budget -= 1
        grown = set()
        for i in where.pop(pair):
            q, n = seqs[i], ns[i]
            out, j = [], 0
            while j < len(q):
                if j + 1 < len(q) and q[j] == pair[0] and q[j + 1] == pair[1]:
                    out.append(merged)
                    j += 2
                else:
                    out.append(q[j])
                    j += 1
            if len(out) == len(q):
                continue
            changed.add(i)
            for p in zip(q, q[1:]):
                counts[p] -= n
            for p in zip(out, out[1:]):
                counts[p] = counts.get(p, 0) + n
                if merged in p:
                    grown.add(p)
                    at = where.setdefault(p, [])
                    if not at or at[-1] != i:
                        at.append(i)
            seqs[i] = out
        for p in grown:
            heapq.heappush(heap, (-counts[p], tokens[p[0]], tokens[p[1]], p))
        if there is not None:
            break
    return merges, {keys[i]: np.array(seqs[i], "<i4").tobytes() for i in changed}
