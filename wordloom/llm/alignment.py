"""Benchmark decontamination: rare n-gram seeds (two words, with or without one
between) join passages to test items, Smith-Waterman alignment scores exact,
edited and paraphrased copies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, Rolling, binary_parts, blocks_of, fresh, read, splitmix, word_bounds, written
from .registry import register

#: Alignment score over the score of a whole exact copy from which an item counts as leaked.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: Aligned words that a leak has at least, fewer only for a shorter item.
LEAST_WORDS = 6
BLOCK_BYTES = 1 << 20
#: Items sent to all executors at once; more items are taken in blocks of this size in turn.
ITEM_BLOCK_BYTES = 8 << 20


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int, int]:
    """Best local alignment: (score, first word in text, end in text, equal
    words).  Rows over the item; a row's gaps along the text come from a
    running maximum."""
    m, n = len(item), len(text)
    steps = -GAP * np.arange(n + 1)
    rows = np.zeros((m + 1, n + 1), np.float32)
    for i in range(m):
        step = np.where(text == item[i], MATCH, MISMATCH)
        best = np.maximum(rows[i, :-1] + step, rows[i, 1:] + GAP)
        best = np.concatenate([[0.0], np.maximum(best, 0.0)])
        rows[i + 1] = np.maximum.accumulate(best + steps) - steps
    i, j = np.unravel_index(int(np.argmax(rows)), rows.shape)
    score, end, equal = float(rows[i, j]), int(j), 0
    while i > 0 and j > 0 and rows[i, j] > 0:
        same = text[j - 1] == item[i - 1]
        if rows[i, j] == rows[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j, equal = i - 1, j - 1, equal + int(same)
        elif rows[i, j] == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, int(j), end, equal


def text_words(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words (letters, digits, longer characters) of each text."""
    starts, ends, first = word_bounds(data, offsets, WORD_BYTES)
    h = Rolling(data, 3).ranges(starts, ends)
    return [h[a:b] for a, b in zip(first[:-1], first[1:])]


def word_pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hash of each word with the one ``apart`` further on; 0: of the word alone."""
    if apart == 0:
        return splitmix(words + np.uint64(17))
    return splitmix(words[:-apart] ^ splitmix(words[apart:] + np.uint64(11))) if len(words) > apart else np.zeros(0, np.uint64)


def needed_pairs(m: int, threshold: float) -> int:
    """Of the pairs of neighbouring equal words on a path that reaches the
    threshold for an item of m words, at least so many have one edit or none
    between them.  E equal words and D edits score 2E - D >= 2tm; E - 1
    neighbours share D edits, so at most D / 2 of them have two or more, and
    E - 1 - floor(D / 2) >= ceil(tm) - 1."""
    return math.ceil(threshold * m - 1e-9) - 1


def longest_path(m: int, threshold: float) -> int:
    """Words of a text that a path which reaches the threshold spans at most."""
    return m + math.ceil(2 * m * (1 - threshold)) + 1


class Items:
    """Word hashes of the items and their seeds.

    A seed is a pair of an item's words next to each other or with one word
    between them; in the text, too, they stand next to each other or one
    apart, so a replaced, added or lost word between them does no harm.  A path
    that reaches the threshold meets ``needed_pairs`` of an item's m - 1 places
    at least, so of any m - needed_pairs places it meets one: the rarest are
    kept.  Items too short for that have single words as seeds."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float):
        self.ids = [i for i, _ in rows]
        texts = [t.encode() for _, t in rows]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.words = text_words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        self.threshold = threshold
        self.need = [needed_pairs(len(w), threshold) for w in self.words]
        self.pairs = [np.unique(np.concatenate([word_pairs(w, 1), word_pairs(w, 2)])) for w in self.words]
        seeds, item, place = [], [], []
        for i, (w, need) in enumerate(zip(self.words, self.need)):
            for apart in (1, 2) if need > 0 else (0,):
                s = word_pairs(w, apart)
                seeds.append(s)
                item.append(np.full(len(s), i))
                place.append(np.arange(len(s)))
        self.seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place) if place else np.zeros(0, np.int64)
        self._index(np.ones(len(self.seed), bool))

    def _index(self, keep: np.ndarray) -> None:
        self.seed, self.item, self.place = self.seed[keep], self.item[keep], self.place[keep]
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]
        # which leading bits of a hash any seed has
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seed >> np.uint64(44)).astype(np.int64)] = True
        self.shapes = [a for a, k in ((0, any(n < 1 for n in self.need)), (1, any(n > 0 for n in self.need)),
                                      (2, any(n > 0 for n in self.need))) if k]

    def keep_rare(self, counts: dict[int, int]) -> None:
        """Of each item the seeds of its rarest places that must be met by every
        path that reaches the threshold, without those that no document has."""
        df = np.array([counts.get(int(s), 0) for s in self.seed.view(np.int64)], np.int64)
        keep = np.zeros(len(df), bool)
        for i in np.unique(self.item):
            own = np.flatnonzero(self.item == i)
            m, need = len(self.words[i]), self.need[i]
            most = np.bincount(self.place[own], weights=df[own], minlength=m)[:m - 1 if need > 0 else m]
            # m - 1 places less all but one of those met; of single words the threshold's share is met
            few = m - need if need > 0 else m - math.ceil(self.threshold * m - 1e-9) + 1
            rare = np.argsort(most, kind="stable")[:few]
            keep[own] = np.isin(self.place[own], rare)
        self._index(keep & (df > 0))


def _hits(words: np.ndarray, items: Items):
    """(position in words, index into items.seed) of every seed found."""
    at, which = [], []
    for apart in items.shapes if len(items.seed) else ():
        s = word_pairs(words, apart)
        maybe = np.flatnonzero(items.bits[(s >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(items.seed, s[maybe])
        there = items.seed[np.minimum(low, len(items.seed) - 1)] == s[maybe]
        found, low = maybe[there], low[there]
        n = np.searchsorted(items.seed, s[found], "right") - low
        at.append(np.repeat(found, n))
        start = np.repeat(low, n)
        which.append(start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(which)


def _texts(batches):
    for b in batches:
        offsets, data = binary_parts(b.column(0))
        for i, j in blocks_of(offsets, BLOCK_BYTES):
            words = text_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            for r, w in enumerate(words, i):
                yield b, r, w


def seed_counts(texts: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each seed of a block of items stands: one row per
    seed and task is shuffled, one per seed returned."""
    def run(batches):
        import pyarrow as pa
        n = np.zeros(len(items.seed), np.int64)
        for _, _, w in _texts(batches):
            _, which = _hits(w, items)
            n[np.unique(which)] += 1
        some = np.flatnonzero(n)
        seed, first = np.unique(items.seed[some], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n[some][first])], ["seed", "n"])

    found = texts.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return {r["seed"]: r["n"] for r in found.collect()}


def leaks_of(words: np.ndarray, items: Items):
    """(item index, score, start, end, equal words) of the best alignment of
    each item that reaches the threshold in one text.  Only places within the
    longest path of a seed are looked at, in overlapping pieces, so memory
    follows the square of the item's length and not the text's."""
    at, which = _hits(words, items)
    out = []
    order = np.lexsort((at, items.item[which])) if len(at) else []
    at, found = at[order], items.item[which][order]
    cut = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]])) if len(found) else [0]
    for x, y in zip(cut[:-1], cut[1:]):
        i = int(found[x])
        item, need = items.words[i], items.need[i]
        m, reach = len(item), longest_path(len(item), items.threshold)
        best = None
        for a, b in _pieces(at[x:y], reach, len(words)):
            if need > 0:
                near = np.concatenate([word_pairs(words[a:b], 1), word_pairs(words[a:b], 2)])
                if _met(near, items.pairs[i]) < need:
                    continue
            score, s, e, equal = align(item, words[a:b])
            if best is None or score > best[0]:
                best = (score, a + s, a + e, equal)
        if best is None:
            continue
        score = best[0] / (MATCH * m)
        if score >= items.threshold and best[3] >= min(LEAST_WORDS, m):
            out.append((i, score, *best[1:]))
    return out


def _met(near: np.ndarray, pairs: np.ndarray) -> int:
    """How many pairs of a piece of text are the item's, each time they stand."""
    return int(np.isin(near, pairs).sum())


def _pieces(at: np.ndarray, reach: int, n: int):
    """Ranges [a, b) of the text that hold every path of up to ``reach`` words
    through one of the sorted places ``at``: neighbouring ones together, in
    pieces of 16 reaches that overlap by one."""
    start = np.maximum(at - reach, 0)
    end = np.minimum(at + reach + 1, n)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > np.maximum.accumulate(end)[:-1], [True]]))
    for i, j in zip(new[:-1], new[1:]):
        a, b = int(start[i]), int(end[j - 1])
        while b - a > 16 * reach:
            yield a, a + 16 * reach
            a += 15 * reach
        yield a, b


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_id, score, start_word, end_word, equal_words): the best
    alignment of every item with every document that it reaches ``threshold``
    in.  Score 1 is a whole exact copy, case and punctuation aside.

    Seeds, pairs of words close together, are counted over all documents.  Of
    each item the rarest are kept, so many that no alignment which reaches
    the threshold misses all of them (``Items``); where one stands, and enough
    of the item's pairs about it, the place is aligned.  Items travel to the
    executors in blocks of ITEM_BLOCK_BYTES, so a benchmark of any size is only
    more passes.

    Null and empty texts hold and leak nothing; an item of one or two
    words is sought by its words; a null key is kept as such; repeated documents report each,
    repeated items under each of their ids; empty tables give no rows.  Columns
    other than the named ones are not read."""
    texts = docs.select(F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("text"), F.col(key).alias("key"))
    kind = texts.schema["key"].dataType.simpleString()
    rows = benchmark.select(F.col(item_id).cast("long").alias("id"), F.lower(F.col(item_text)).alias("text")).where("text is not null")
    out = None
    for block in item_blocks(rows):
        items = Items(block, threshold)
        items.keep_rare(seed_counts(texts, items))

        def run(batches, items=items):
            import pyarrow as pa
            for b, r, w in _texts(batches):
                found = leaks_of(w, items)
                if found:
                    which, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(1)[r].as_py()] * len(found), b.column(1).type),
                         pa.array([items.ids[i] for i in which], pa.int64()),
                         *[pa.array(c, t) for c, t in zip(rest, (pa.float64(), pa.int64(), pa.int64(), pa.int64()))]],
                        ["key", "item_id", "score", "start_word", "end_word", "equal_words"])

        one = texts.mapInArrow(run, f"key {kind}, item_id long, score double, start_word long, end_word long, equal_words long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.sparkSession.createDataFrame(
            [], f"key {kind}, item_id long, score double, start_word long, end_word long, equal_words long")
    return out.withColumnRenamed("key", key)


def item_blocks(rows: DataFrame):
    """The items as lists of at most ITEM_BLOCK_BYTES of text (or one item)."""
    block, held = [], 0
    for r in rows.orderBy("id").toLocalIterator():
        if block and held + len(r["text"]) * 4 > ITEM_BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r["id"], r["text"]))
        held += len(r["text"]) * 4
    if block:
        yield block


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that any item leaks into.  A leak is a
    matter of the text alone, so texts are told apart by their digest: rows
    that share an id or have none are judged by what they hold."""
    digest = fresh(docs, "_digest")
    marked = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    leaks = written(find_leaks(marked, benchmark, key=digest, text=text).select(digest).distinct(), "leaks")
    return marked.join(leaks, digest, "left_anti").drop(digest)


@register("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word, equal_words of all leaks."""
    return find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
