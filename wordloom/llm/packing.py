"""Vector bin packing of token sequences: examples are placed under limits on
tokens, segments and loss-bearing tokens at once, by the dot-product
heuristic."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read
from .registry import register

#: Id after the ids of each document.
END_ID = 1
#: Examples that are packed together, and the ids of them that end a block sooner.
BLOCK_EXAMPLES, BLOCK_IDS = 8_192, 4_000_000
#: Words and white space from this length on go to the slower engine, whose time does not grow with their square.
LONG_WORD = 1_000


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


# --- ids of a byte-level vocabulary ---------------------------------------------
class ByteBpe:
    """Ids as the ``tokenizers`` package gives them for the JSON file at
    ``path`` (byte-level BPE without normaliser), add_special_tokens=False.

    Texts whose characters lie below U+0250, where the classes of the
    splitting pattern do not depend on the Unicode version, go through
    tiktoken with the same file's vocabulary, which gives the same ids several
    times faster; texts with later characters, with the name of a special
    token or with very long words go through ``tokenizers`` itself."""

    LATER = re.compile("[ɐ-\U0010ffff]")
    SPACES = re.compile(r"\s{%d}" % LONG_WORD)

    def __init__(self, path: str, pattern: str):
        import json
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        # the file spells each byte as one printable character: printable bytes
        # stand for themselves, the others for the characters from U+0100 on
        printable = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
        spelled = {chr(b): b for b in printable}
        spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        if set(spelled) != set(ByteLevel.alphabet()):
            raise ValueError(f"{path}: not a byte-level vocabulary")
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(spelled[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        return not (any(s in text for s in self.special) or len(text) >= LONG_WORD and (
            self.SPACES.search(text) or max(map(len, text.split()), default=0) >= LONG_WORD)
            or not text.isascii() and self.LATER.search(text))

    def ids(self, text: str) -> np.ndarray:
        if self.plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


# --- placing ---------------------------------------------------------------------
class Example:
    """Ids of one example, its running loss count, and where its unplaced rest starts."""

    __slots__ = ("key", "ids", "loss", "at")

    def __init__(self, key, ids: np.ndarray, mask: np.ndarray | None = None):
        self.key, self.ids, self.at = key, ids, 0
        self.loss = None if mask is None else np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    def size(self) -> tuple[int, int]:
        """(tokens, loss-bearing tokens) of the rest."""
        n = len(self.ids) - self.at
        return n, n if self.loss is None else int(self.loss[-1] - self.loss[self.at])

    def fitting(self, tokens: int, loss: int) -> int:
        """Length of the longest beginning of the rest within both limits."""
        n = min(tokens, len(self.ids) - self.at)
        if self.loss is None:
            return min(n, loss)
        return int(np.searchsorted(self.loss[self.at:self.at + n + 1], self.loss[self.at] + loss, "right")) - 1


def place(examples: list[Example], limits: Limits, cut: bool, last: bool):
    """Sequences of ``examples``: lists of (example, start, length, loss).

    Each sequence is filled on its own.  Of the sizes that fit what is left of
    it, the one of the largest dot product with what is left goes in next;
    tokens, segments and loss tokens count by their share of the limit, times
    the examples' total demand for each.  If nothing fits and ``cut`` allows
    it, the largest example is cut to fit.  Examples of one size wait on one
    pile, so a step looks at the different sizes only.

    With ``last`` false, the examples of the sequence that remained open are
    returned too, as the second value; they go into the next block."""
    cap = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    done, piles = [], {}

    def pile(e: Example) -> None:
        piles.setdefault(e.size(), []).append(e)

    for e in examples:
        tokens, loss = e.size()
        while cut and (tokens >= limits.tokens or loss >= limits.loss):
            n = e.fitting(limits.tokens, limits.loss)
            done.append([take(e, n)])
            tokens, loss = e.size()
            if not tokens:
                break
        if tokens and (tokens > limits.tokens or loss > limits.loss):
            done.append([take(e, tokens)])   # not to be cut: alone, above the limits
        elif tokens:
            pile(e)
    sizes = np.array(sorted(piles, reverse=True), np.int64).reshape(-1, 2)
    if not len(sizes):
        return done, []
    waiting = np.array([len(piles[tuple(s)]) for s in sizes.tolist()])
    row = {tuple(s): i for i, s in enumerate(sizes.tolist())}
    one = np.ones(len(sizes))
    share = np.stack([sizes[:, 0], one, sizes[:, 1]], axis=1) / cap
    demand = (share * waiting[:, None]).sum(0)
    weighted = share * (demand / max(demand.max(), 1e-9))
    while waiting.any():
        left, pieces = np.array([limits.tokens, limits.segments, limits.loss]), []
        while left[0] and left[1]:
            value = weighted @ (left / cap)
            value[(waiting == 0) | (sizes[:, 0] > left[0]) | (sizes[:, 1] > left[2])] = -1.0
            k = int(value.argmax())
            if value[k] >= 0:
                e = piles[tuple(sizes[k].tolist())].pop()
                waiting[k] -= 1
                piece = take(e, int(sizes[k][0]))
            else:
                k = int(np.where(waiting > 0, sizes[:, 0], -1).argmax()) if cut and waiting.any() else -1
                n = piles[tuple(sizes[k].tolist())][-1].fitting(int(left[0]), int(left[2])) if k >= 0 else 0
                if not n:
                    break
                e = piles[tuple(sizes[k].tolist())].pop()
                waiting[k] -= 1
                piece = take(e, n)
                rest = e.size()
                if rest not in row:
                    row[rest] = len(sizes)
                    sizes = np.vstack([sizes, [rest]])
                    waiting = np.append(waiting, 0)
                    weighted = np.vstack([weighted, np.array([rest[0], 1, rest[1]]) / cap
                                          * (demand / max(demand.max(), 1e-9))])
                piles.setdefault(rest, []).append(e)
                waiting[row[rest]] += 1
            pieces.append(piece)
            left = left - np.array([piece[2], 1, piece[3]])
        if not last and not waiting.any() and left[0] and left[1]:
            for e, start, _, _ in reversed(pieces):   # an example may have several rests
                e.at = min(e.at, start)
            return done, list(dict.fromkeys(e for e, _, _, _ in pieces))
        done.append(pieces)
    return done, []


def take(e: Example, n: int) -> tuple[Example, int, int, int]:
    start = e.at
    e.at += n
    return e, start, n, n if e.loss is None else int(e.loss[e.at] - e.loss[start])


# --- the operator -----------------------------------------------------------------
def pack(df: DataFrame, key: str, text: str | None = None, vocabulary: str | None = None,
         pattern: str | None = None, ids: str | None = None, loss: str | None = None,
         limits: Limits = Limits(), cut: bool = True, with_ids: bool = True) -> DataFrame:
    """The pieces of all examples of ``df``, packed into sequences within
    ``limits``: (key, start, length, loss_tokens, example_tokens, ids_crc32,
    sequence_id, offset, ids).

    An example is either a text (``text``; tokenised in the task by the
    byte-level vocabulary file at ``vocabulary`` with the splitting
    ``pattern``, then END_ID; every token bears loss) or given ids (``ids``,
    and ``loss``, an array of booleans as long: true where the token bears
    loss; without it all do).  With ``cut`` an example may be cut anywhere;
    without, it lies whole in one sequence, and one above the limits has a
    sequence of its own.  ``offset`` is gapless from 0 in each sequence.

    Rows are packed where they are read, in blocks of BLOCK_EXAMPLES rows or
    BLOCK_IDS ids: no shuffle, no group, memory bounded by a block and one
    example.  Each partition leaves one sequence open at most.  ids_crc32 is
    over the piece's ids as little-endian unsigned 32-bit numbers.

    A null text is an empty one; null or empty ids make an example without
    tokens and so no piece; null or missing loss flags are false.  Null or
    repeated keys are kept as they are; other columns are not looked at.  An
    empty table gives no rows."""
    if (text is None) == (ids is None):
        raise ValueError("name either a text or an ids column")
    given = [c for c in (key, text, ids, loss) if c is not None]
    fields = [T.StructField(key, df.schema[key].dataType)] + [
        T.StructField(c, T.LongType()) for c in
        ("start", "length", "loss_tokens", "example_tokens", "ids_crc32", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def examples(batch, bpe):
        keys = batch.column(0).to_pylist()
        if text is not None:
            for k, t in zip(keys, batch.column(1).to_pylist()):
                yield Example(k, np.append(bpe.ids(t or ""), np.uint32(END_ID)))
            return
        flags = batch.column(2).to_pylist() if loss is not None else [None] * len(keys)
        for k, x, m in zip(keys, batch.column(1).to_pylist(), flags):
            x = np.array(x or [], np.uint32)
            if loss is not None:
                m = np.array([bool(v) for v in (m or [])][:len(x)], np.int64)
                m = np.concatenate([m, np.zeros(len(x) - len(m), np.int64)])
            yield Example(k, x, m)

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        bpe = ByteBpe(vocabulary, pattern) if text is not None else None
        key_type, number = None, TaskContext.get().partitionId() << 33

        def rows(sequences):
            nonlocal number
            cols = [[] for _ in range(8)]
            parts = []
            for pieces in sequences:
                offset = 0
                for e, start, n, lossy in pieces:
                    x = e.ids[start:start + n]
                    for c, v in zip(cols, (e.key, start, n, lossy, len(e.ids),
                                           zlib.crc32(x.astype("<u4").tobytes()), number, offset)):
                        c.append(v)
                    if with_ids:
                        parts.append(x.astype(np.int32))
                    offset += n
                number += 1
            arrays = [pa.array(cols[0], key_type)] + [pa.array(c, pa.int64()) for c in cols[1:]]
            if with_ids:
                ends = np.cumsum([0] + cols[2])
                arrays.append(pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

        block, size = [], 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            for e in examples(batch, bpe):
                if len(e.ids):
                    block.append(e)
                    size += len(e.ids)
                if len(block) >= BLOCK_EXAMPLES or size >= BLOCK_IDS:
                    done, block = place(block, limits, cut, last=False)
                    size = sum(x.size()[0] for x in block)
                    for i in range(0, len(done), 2_000):
                        yield rows(done[i:i + 2_000])
        if block:
            done, _ = place(block, limits, cut, last=True)
            for i in range(0, len(done), 2_000):
                yield rows(done[i:i + 2_000])

    return df.select(*given).mapInArrow(packed, T.StructType(fields))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, input_ids, segment_ids, n_tokens, n_segments, loss_tokens)
    of packed pieces with ids: the ids laid end to end and, for each, the
    number of its segment from 1 on.  Groups are bounded by the limits of
    ``pack``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "loss_tokens")))
    g = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return g.select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"),
        F.flatten(F.transform("parts", lambda p, i: F.transform(p["ids"], lambda _: i + 1))).alias("segment_ids"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.size(p["ids"])).alias("n_tokens"),
        F.size("parts").alias("n_segments"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["loss_tokens"]).alias("loss_tokens"))


def instruction_examples(pairs: DataFrame, key: list[str], prompt: str, answer: str,
                         vocabulary: str, pattern: str) -> DataFrame:
    """(key struct as ``example``, ids, loss) of prompt and answer pairs: the
    ids of the prompt, then those of the answer and END_ID, of which only the
    latter bear loss.  Null texts are empty."""
    schema = T.StructType([T.StructField("example", T.StructType([T.StructField(k, pairs.schema[k].dataType) for k in key])),
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("loss", T.ArrayType(T.BooleanType()))])

    def coded(batches):
        import pyarrow as pa
        bpe = ByteBpe(vocabulary, pattern)
        for b in batches:
            out, flags = [], []
            for p, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, y = bpe.ids(p or ""), np.append(bpe.ids(a or ""), np.uint32(END_ID))
                out.append(np.concatenate([x, y]).astype(np.int32))
                flags.append(np.arange(len(x) + len(y)) >= len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.bool_()))],
                ["example", "ids", "loss"])

    return pairs.select(F.struct(*key).alias("example"), F.col(prompt), F.col(answer)).mapInArrow(coded, schema)


@register("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of
    every piece of every document, packed into sequences of 2,048 ids."""
    import public_tokenizers
    pieces = pack(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", text="text",
                  vocabulary=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN,
                  limits=Limits(2048, 256, 2048), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", F.col("example_tokens").alias("doc_tokens"),
                         "sequence_id", "offset")
