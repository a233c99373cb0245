"""Encode (B5), decode (B7), vocabulary lookups (B8) and token-count
comparison (B10).

Encoding is row-local: pre-tokens are extracted JVM-side (the same
expression as training), and an Arrow UDF applies the merge ranks to each
distinct pre-token of a batch.  The ranks table is bounded by the vocabulary size (checked)
and travels with the task; there is no shuffle and no join back, and a hot
pre-token (a third of all words) is encoded once a batch.

A vocabulary above the checked size is not shipped: ``encode_by_join`` and
``decode_by_join`` take it as tables and bring to each block of rows, or id, only
the entries that concern it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .bpe import MAX_SHIPPED_VOCAB, BpeModel
from .pretokenize import pretokens

#: Different pre-tokens that are merged together; pre-tokens or ids of a column that are worked on together.
_WORDS_AT_ONCE, _PLACES_AT_ONCE = 50_000, 400_000


def _bpe_symbols(token: str | bytes, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges by rank to one pre-token (lowest rank first, all
    non-overlapping occurrences left to right).  Neighbouring pairs wait in a
    heap over a linked list, so a very long token costs n log n."""
    sym = [f"{b:02X}" for b in (token.encode("utf-8") if isinstance(token, str) else token)]
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # an entry is stale once either side was merged into something else
        if sym[i] is None or j >= n or ranks.get((sym[i], sym[j])) != rank:
            continue
        sym[i], sym[j] = sym[i] + sym[j], None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n:
                r = ranks.get((sym[left], sym[right]))
                if r is not None:
                    heapq.heappush(heap, (r, left))
    return [x for x in sym if x is not None]


#: Words above this many bytes are merged one by one through a heap.
LONG_WORD = 512
_NO_RANK = np.iinfo(np.int64).max


class WordMerger:
    """Merges many words at once.  Symbols are numbers: the 256 bytes, then the
    tokens that merges make.  A step takes, in every word that is not done, the
    pair of the lowest rank, at all its places from left to right; words
    without a ranked pair are done.  The result is that of ``_bpe_symbols``."""

    def __init__(self, ranks: dict[tuple[str, str], int], ids: dict[str, int], unk: int | None):
        number = {f"{b:02X}": b for b in range(256)}
        for pair in ranks:
            for t in (*pair, "".join(pair)):
                number.setdefault(t, len(number))
        pairs = sorted(((number[l] << 32) | number[r], rank, number[l + r]) for (l, r), rank in ranks.items())
        self.codes, self.ranks, self.merged = (np.array([x[k] for x in pairs], np.int64) for k in range(3))
        self.places = _hash_places(self.codes)
        self.rank_of, self.number = ranks, number
        # vocabulary id of each symbol; -1: none, so it is left out
        self.ids = np.full(len(number), -1 if unk is None else unk, np.int64)
        for t, n in number.items():
            if t in ids:
                self.ids[n] = ids[t]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, how many each has)."""
        size = np.array([len(w) for w in words], np.int64)
        short = size <= LONG_WORD
        where = np.repeat(np.flatnonzero(short), size[short])
        symbols = np.frombuffer(b"".join(w for w in words if len(w) <= LONG_WORD), np.uint8).astype(np.int64)
        done_at, done = [], []
        for k in np.flatnonzero(~short):
            own = [self.number[x] for x in _bpe_symbols(words[k], self.rank_of)]
            done.append(np.array(own, np.int64))
            done_at.append(np.full(len(own), k))
        rank, at = np.full(len(symbols), _NO_RANK), np.zeros(len(symbols), np.int64)
        self._rank(symbols, where, np.arange(len(symbols)), rank, at)
        while len(symbols):
            start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            least = np.minimum.reduceat(rank, start)
            least = np.repeat(least, np.diff(np.append(start, len(where))))
            over = least == _NO_RANK
            if over.any():
                done.append(symbols[over])
                done_at.append(where[over])
                symbols, where, rank, at, least = (x[~over] for x in (symbols, where, rank, at, least))
                if not len(symbols):
                    break
            hit = rank == least
            # in a run of hits (one symbol over and over) every other one is taken
            first = hit & ~np.concatenate([[False], hit[:-1]])
            place = np.arange(len(hit))
            taken = hit & ((place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0)
            symbols = np.where(taken, self.merged[at], symbols)
            keep = ~np.concatenate([[False], taken[:-1]])
            new = (np.cumsum(keep) - 1)[taken]
            symbols, where, rank, at = symbols[keep], where[keep], rank[keep], at[keep]
            # only the pairs with a new symbol have another rank
            self._rank(symbols, where, np.concatenate([new, new[new > 0] - 1]), rank, at)
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        where = np.concatenate(done_at)
        order = np.argsort(where, kind="stable")
        ids, where = self.ids[np.concatenate(done)[order]], where[order]
        return ids[ids >= 0].astype(np.int32), np.bincount(where[ids >= 0], minlength=len(words))

    def _rank(self, symbols: np.ndarray, where: np.ndarray, ask: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Set the rank of the pairs that begin at ``ask``, and their places among the pairs."""
        rank[ask] = _NO_RANK
        ask = ask[ask < len(symbols) - 1]
        ask = ask[where[ask] == where[ask + 1]]
        code = (symbols[ask] << 32) | symbols[ask + 1]
        slot = _first_slot(code, len(self.places))
        while len(ask):     # along the slots until the pair or an empty one
            found = self.places[slot]
            right = found >= 0
            right[right] = self.codes[found[right]] == code[right]
            at[ask[right]] = found[right]
            rank[ask[right]] = self.ranks[found[right]]
            on = (found >= 0) & ~right
            ask, code, slot = ask[on], code[on], (slot[on] + 1) & (len(self.places) - 1)


def _first_slot(codes: np.ndarray, size: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _hash_places(codes: np.ndarray) -> np.ndarray:
    """An open hash table over ``codes``: the place of a code stands in its
    first slot or, if that is taken, the next free one; -1 is free."""
    size = 1 << max(4, (4 * len(codes)).bit_length())
    places = np.full(size, -1)
    for k, slot in enumerate(_first_slot(codes, size).tolist()):
        while places[slot] >= 0:
            slot = (slot + 1) & (size - 1)
        places[slot] = k
    return places


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The concatenated slices values[starts[k]:starts[k] + lengths[k]] for k in which."""
    n = lengths[which]
    first = np.repeat(starts[which] - (np.cumsum(n) - n), n)
    return values[first + np.arange(len(first))]


def _by_stretches(col: pa.Array, most: int, kind: pa.DataType, use) -> pa.Array:
    """``use`` of a list column in stretches of whole rows, each of ``most``
    elements at most or one row: what ``use`` holds beside its result does not
    grow with the rows of an Arrow batch."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64))
    out, i = [], 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        out.append(use(col.slice(i, j - i)))
        i = j
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(out) if out else pa.array([], kind)


def _is_hex(token: str) -> bool:
    return len(token) % 2 == 0 and all(c in "0123456789ABCDEF" for c in token)


class BpeEncoder:
    """Encoder/decoder for a trained :class:`BpeModel`: row-local with the
    vocabulary shipped to the tasks up to ``ship_up_to`` entries, by joins
    beyond.  The methods that return a column need the former."""

    def __init__(self, model: BpeModel, unk_id: int | None = None,
                 add_prefix_space: bool = True, ship_up_to: int = MAX_SHIPPED_VOCAB):
        self.model = model
        self.unk_id = unk_id
        self.add_prefix_space = add_prefix_space
        self.shipped = model.vocab_size <= ship_up_to
        if self.shipped:
            self._encode_udf = self._make_encode_udf()
            self._decode_udf = self._make_decode_udf()

    def _need_shipped(self) -> None:
        if not self.shipped:
            raise ValueError(f"a vocabulary of {self.model.vocab_size} is not shipped to tasks: "
                             "use encode() or decode(), which join")

    def _make_encode_udf(self):
        merger = WordMerger(self.model.ranks(), self.model.token_ids(), self.unk_id)

        def encode_stretch(col: pa.Array) -> pa.Array:
            # Arrow in, Arrow out: each distinct token of the stretch is encoded
            # once, the rows are gathered from those by index
            missing = np.asarray(col.is_null())
            size = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            flat = pc.list_flatten(col).dictionary_encode()
            words = flat.dictionary.cast(pa.binary()).to_pylist()
            parts = [merger.encode(words[i:i + _WORDS_AT_ONCE]) for i in range(0, len(words), _WORDS_AT_ONCE)]
            values = np.concatenate([x for x, _ in parts] or [np.zeros(0, np.int32)])
            lengths = np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)])
            which = np.asarray(flat.indices).astype(np.int64)
            out = _gather(values, np.cumsum(lengths) - lengths, lengths, which)
            done = np.concatenate([[0], np.cumsum(lengths[which])]).astype(np.int64)
            offsets = done[np.concatenate([[0], np.cumsum(size)]).astype(np.int64)]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.int32()),
                                            mask=pa.array(missing))

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encode_tokens(col: pa.Array) -> pa.Array:
            return _by_stretches(col, _PLACES_AT_ONCE, pa.list_(pa.int32()), encode_stretch)

        return encode_tokens

    def _make_decode_udf(self):
        table = {i: bytes.fromhex(t) if _is_hex(t) else b"" for t, i in self.model.token_ids().items()}
        top = max(table, default=-1) + 1
        cells = [table.get(i, b"") for i in range(top)] + [b""]   # the last: any unknown id
        lengths = np.array([len(c) for c in cells], np.int64)
        blob = np.frombuffer(b"".join(cells), np.uint8)

        def decode_stretch(col: pa.Array) -> pa.Array:
            missing = np.asarray(col.is_null())
            size = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            ids = np.asarray(pc.fill_null(pc.list_flatten(col), -1)).astype(np.int64)
            ids = np.where((ids < 0) | (ids > top), top, ids)
            data = _gather(blob, np.cumsum(lengths) - lengths, lengths, ids).tobytes()
            done = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(size)])]
            return pa.array([None if gone else data[a:b].decode("utf-8", "replace")
                             for gone, a, b in zip(missing, done[:-1], done[1:])], pa.string())

        @F.arrow_udf(T.StringType())
        def decode_ids(col: pa.Array) -> pa.Array:
            return _by_stretches(col, _PLACES_AT_ONCE, pa.string(), decode_stretch)

        return decode_ids

    # B5 ---------------------------------------------------------------------
    def encode_column(self, text: Column) -> Column:
        self._need_shipped()
        return self._encode_udf(pretokens(text, self.add_prefix_space))

    def encode(self, df: DataFrame, text_col: str = "text", out_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
        """``df`` with the ids; of its columns only those of ``carry``, if given."""
        if self.shipped:
            out = df.withColumn(out_col, self.encode_column(F.col(text_col)))
            return out if carry is None else out.select(*carry, out_col)
        spark = df.sparkSession
        return encode_by_join(df, self.model.merges_frame(spark), self.model.vocab_frame(spark), text_col, out_col,
                              self.unk_id, self.add_prefix_space, carry)

    # B7 ---------------------------------------------------------------------
    def decode_column(self, ids: Column) -> Column:
        """Special ids are skipped; the prefix space stays."""
        self._need_shipped()
        return self._decode_udf(ids)

    def decode(self, df: DataFrame, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
        if self.shipped:
            return df.withColumn(out_col, self.decode_column(F.col(ids_col)))
        return decode_by_join(df, self.model.vocab_frame(df.sparkSession), ids_col, out_col)

    def tokens_column(self, ids: Column) -> Column:
        """Token strings of ids (X4 listing); special ids give their names."""
        self._need_shipped()
        by_id = {i: bytes.fromhex(t).decode("utf-8", "replace")
                 for t, i in self.model.token_ids().items()}
        for i, name in enumerate(self.model.special_tokens):
            by_id[i] = name

        top = max(by_id, default=-1) + 1
        names = pa.array([by_id.get(i) for i in range(top)] + [None], pa.string())   # the last: any unknown id

        def tokens_of_stretch(col: pa.Array) -> pa.Array:
            size = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            at = np.asarray(pc.fill_null(pc.list_flatten(col), -1)).astype(np.int64)
            at = np.where((at < 0) | (at > top), top, at)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            return pa.ListArray.from_arrays(offsets, names.take(pa.array(at)), mask=pa.array(np.asarray(col.is_null())))

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def id_tokens(col: pa.Array) -> pa.Array:
            return _by_stretches(col, _PLACES_AT_ONCE, pa.list_(pa.string()), tokens_of_stretch)

        return id_tokens(ids)


# Vocabularies of any size ------------------------------------------------------
#: Pre-tokens of a block at most, or of one row.
BLOCK_PLACES = 1 << 19
#: A pre-token stands once in a block however often it occurs, so none is looked up apart for its share of all;
#: what is set here changes nothing.
HOT_SHARE = 1 / 1000


def _unused(df: DataFrame, *bases: str) -> list[str]:
    """Column names like ``bases`` that ``df`` does not have, whatever their case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in bases:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def _packed(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The numbers up to each end as bytes: seven bits in each, the lowest
    first, the high bit set in all but a number's last byte."""
    numbers = numbers.astype(np.int64)
    size = 1 + sum((numbers >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    first = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        data[first[more] + k] = (numbers[more] >> 7 * k) & 127 | np.where(size[more] > k + 1, 128, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(cells: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all cells end to end, how many each has)."""
    data = np.frombuffer(b"".join(x or b"" for x in cells), np.uint8)
    last = data < 128
    at = np.flatnonzero(last)
    first = np.concatenate([[0], at[:-1] + 1])[:len(at)]
    numbers = np.zeros(len(at), np.int64)
    for k in range(int((at - first).max(initial=-1)) + 1):
        on = first + k <= at
        numbers[on] |= (data[first[on] + k] & 127).astype(np.int64) << 7 * k
    ends = np.cumsum([len(x or b"") for x in cells]).astype(np.int64)
    done = np.concatenate([[0], np.cumsum(last)])[ends]
    return numbers, np.diff(done, prepend=0)


_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.BinaryType()),
                       T.StructField("tokens", T.ArrayType(T.BinaryType()))])


def _block_places(row: Column, words: Column) -> Column:
    """(block, at, tokens) of each row: rows of BLOCK_PLACES pre-tokens at most
    are a block, named after its first row, which holds the block's different
    pre-tokens, the most frequent first; ``at`` is a row's pre-tokens as their
    places among these, null for null."""
    made = pa.struct([("block", pa.int64()), ("at", pa.binary()), ("tokens", pa.list_(pa.binary()))])

    @F.arrow_udf(_BLOCK)
    def block_places(rows: pa.Array, col: pa.Array) -> pa.Array:
        names, begun = np.asarray(rows), 0

        def of_block(part: pa.Array) -> pa.Array:
            nonlocal begun
            flat = pc.list_flatten(part).dictionary_encode()
            which = np.asarray(flat.indices).astype(np.int64)
            order = np.argsort(-np.bincount(which, minlength=len(flat.dictionary)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(part), 0)).astype(np.int64))
            at = pc.if_else(part.is_valid(), _packed(place[which], ends), pa.scalar(None, pa.binary()))
            tokens = flat.dictionary.cast(pa.binary()).take(pa.array(order))
            held = pa.ListArray.from_arrays(pa.array([0] + [len(tokens)] * len(part), pa.int32()), tokens,
                                            mask=pa.array(np.arange(len(part)) > 0))
            out = pa.StructArray.from_arrays([pa.array(np.full(len(part), names[begun]), pa.int64()), at, held], fields=list(made))
            begun += len(part)
            return out

        return _by_stretches(col, BLOCK_PLACES, made, of_block)

    return block_places(row, words)


def vocabulary_parts(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(part, rank, cut, id): a row for each merge, with the bytes that it makes,
    where they are cut and their id, and one for each other entry of the
    vocabulary, without rank and cut."""
    rules = (merges.groupBy("left", "right").agg(F.min("rank").alias("rank"))
             .select(F.concat("left", "right").alias("h"), "rank", (F.length("left") / 2).cast("int").alias("cut")))
    known = vocab.where(F.col("token_hex").isNotNull()).groupBy(F.col("token_hex").alias("h")).agg(F.min("id").alias("id"))
    return rules.join(known, "h", "full_outer").select(F.unhex("h").alias("part"), "rank", "cut", "id").where("part is not null")


def _in_order(ranks: dict[tuple[str, str], int]) -> bool:
    """Whether each merge has a rank of its own, above those that first make its two sides."""
    first: dict[str, int] = {}
    for pair, rank in ranks.items():
        first["".join(pair)] = min(rank, first.get("".join(pair), rank))
    return len(set(ranks.values())) == len(ranks) and all(first.get(x, -1) < rank for pair, rank in ranks.items() for x in pair)


def _ids_at_places(tokens: Column, parts: Column, at: Column, unk_id: int | None) -> Column:
    """The ids of each row of a block: its pre-tokens are merged by the entries
    of the vocabulary that concern them, then taken at each row's places."""

    def of_block(tokens, parts, at):
        ranks, ids = {}, {}
        for x in parts or []:
            h, cut = x["part"].hex().upper(), x["cut"]
            if x["id"] is not None:
                ids[h] = x["id"]
            if cut is not None:
                ranks[h[:2 * cut], h[2 * cut:]] = x["rank"]
        if _in_order(ranks):
            merger = WordMerger(ranks, ids, unk_id)
            made = [merger.encode(tokens[i:i + _WORDS_AT_ONCE]) for i in range(0, len(tokens), _WORDS_AT_ONCE)]
        else:
            own = [[i for s in _bpe_symbols(t, ranks) if (i := ids.get(s, unk_id)) is not None] for t in tokens]
            made = [(np.array([i for x in own for i in x], np.int32), np.array([len(x) for x in own], np.int64))]
        values = np.concatenate([x for x, _ in made] or [np.zeros(0, np.int32)])
        lengths = np.concatenate([n for _, n in made] or [np.zeros(0, np.int64)])
        which, size = _unpacked(at)
        out = _gather(values, np.cumsum(lengths) - lengths, lengths, which)
        done = np.concatenate([[0], np.cumsum(lengths[which])])[np.concatenate([[0], np.cumsum(size)])]
        return pa.ListArray.from_arrays(pa.array(done, pa.int32()), pa.array(out, pa.int32()), mask=pa.array([x is None for x in at]))

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def ids_at_places(tokens: pa.Array, parts: pa.Array, at: pa.Array) -> pa.Array:
        made = pa.list_(pa.list_(pa.int32()))
        out = []
        for k in range(len(at)):
            ids = of_block(tokens[k].as_py() or [], parts[k].as_py(), at[k].as_py())
            out.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(out).cast(made) if out else pa.array([], made)

    return ids_at_places(tokens, parts, at)


def encode_by_join(df: DataFrame, merges: DataFrame, vocab: DataFrame, text_col: str = "text", out_col: str = "ids",
                   unk_id: int | None = None, add_prefix_space: bool = True, carry: list[str] | None = None) -> DataFrame:
    """B5 for a vocabulary of any size: ``merges`` (rank, left, right) and
    ``vocab`` (id, token_hex) stay tables.

    The pre-tokens are combined in blocks of rows, each with its different
    pre-tokens and the rows' places among them; these are written, so that the
    rows are worked on once.  An entry of the vocabulary concerns a block only
    if it is a part of one of its pre-tokens.  So the parts of each, from two
    bytes to the longest that a merge makes, are joined with the vocabulary; the
    single bytes, 256 at most, come to every block.  A block comes together with
    the few entries that it gets, so no (row, pre-token) pair is dealt out.  A
    null text gives null ids, one without pre-tokens an empty array; equal rows
    stay apart.  Other columns are carried along, or only those of ``carry``."""
    row, block, rest, at, tokens, words = _unused(df, "_row", "_block", "_rest", "_at", "_tokens", "_words")
    others = [c for c in df.columns if c.lower() != out_col.lower()] if carry is None else carry
    tagged = df.select(F.struct(*others).alias(rest), F.monotonically_increasing_id().alias(row),
                       pretokens(F.col(text_col), add_prefix_space).alias(words))
    tagged = tagged.select(rest, _block_places(F.col(row), F.col(words)).alias(at))
    blocks = _kept(tagged.select(F.col(f"{at}.block").alias(block), rest, F.col(f"{at}.at").alias(at),
                                 F.col(f"{at}.tokens").alias(tokens)), "blocks")
    # written, so that the join knows how large it is before it deals out the parts
    entries = _kept(vocabulary_parts(merges, vocab), "vocabulary")
    longest = max(entries.where("cut is not null").agg(F.max(F.length("part"))).first()[0] or 1, 1)
    each = blocks.select(block, F.explode(tokens).alias("t"))
    each = each.select(block, "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i"))
    most = F.least(F.lit(longest), F.length("t") - F.col("i") + 1)
    each = each.where(most > 1).select(block, "t", "i", F.explode(F.sequence(F.lit(2), most)).alias("k"))
    found = each.select(block, F.substring("t", F.col("i"), F.col("k")).alias("part")).join(entries, "part").select(
        block, "part", "rank", "cut", "id").distinct()
    # the single bytes, 256 at most, concern every block
    found = found.unionByName(blocks.where(F.col(tokens).isNotNull()).select(block).crossJoin(
        F.broadcast(entries.where(F.length("part") == 1))).select(found.columns))
    part = F.struct("part", "rank", "cut", "id")
    row_kind = T.StructType([T.StructField(rest, blocks.schema[rest].dataType), T.StructField(at, T.BinaryType())])
    rows = blocks.select(block, F.struct(rest, at).alias(row), tokens, F.lit(None).cast(found.select(part.alias("p")).schema["p"].dataType).alias("part"))
    dealt = rows.unionByName(found.select(block, F.lit(None).cast(row_kind).alias(row), F.lit(None).cast(blocks.schema[tokens].dataType).alias(tokens),
                                          part.alias("part")))
    whole = dealt.groupBy(block).agg(F.collect_list(row).alias(row), F.first(tokens, ignorenulls=True).alias(tokens),
                                     F.collect_list("part").alias("part"))
    ids = _ids_at_places(F.col(tokens), F.col("part"), F.col(f"{row}.{at}"), unk_id)
    done = whole.select(row, ids.alias(at)).select(F.explode(F.arrays_zip(F.col(row).alias(row), F.col(at).alias(at))).alias(rest))
    return done.select(*[F.col(f"{rest}.{row}.{rest}.{c}") for c in others], F.col(f"{rest}.{at}").alias(out_col))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what several joins read is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def decode_by_join(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """B7 for a vocabulary of any size: the different ids of each row are
    joined with ``vocab`` (id, token_hex); special and unknown ids give
    nothing.  Null ids give null."""
    row, i, at, rest = _unused(df, "_row", "_id", "_at", "_rest")
    others = [c for c in df.columns if c.lower() != out_col.lower()]
    tagged = df.select(F.monotonically_increasing_id().alias(row), F.struct(*others).alias(rest), F.col(ids_col).alias(i))
    flat = tagged.select(row, rest, F.posexplode(F.concat(F.array(F.lit(None).cast("int")), F.coalesce(
        i, F.array().cast("array<int>")))).alias(at, i)).withColumn(rest, F.when(F.col(at) == 0, F.col(rest)))
    known = vocab.where(F.col("token_hex").isNotNull()).select(F.col("id").alias(i), "token_hex")
    text = F.make_valid_utf8(F.unhex(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(
        at, F.coalesce("token_hex", F.lit("")).alias("h")))), lambda x: x["h"]))).cast("string"))
    done = flat.join(known, i, "left").groupBy(row).agg(F.first(rest, ignorenulls=True).alias(rest), text.alias(at))
    return done.select(*[F.col(f"{rest}.{c}") for c in others],
                       F.when(F.col(f"{rest}.{ids_col}").isNotNull(), F.col(at)).alias(out_col))


# B8 / U3 / A1-A3 --------------------------------------------------------------
def token_frequencies(tokens_df: DataFrame, token_col: str = "token") -> DataFrame:
    """(token, n): combine first, so that later joins see each token once."""
    return tokens_df.groupBy(token_col).agg(F.count(F.lit(1)).alias("n"))


def oov_tokens(freq: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """Tokens absent from the vocabulary (left anti join on the
    combined frequencies; Spark broadcasts the vocabulary only when its
    measured size is under the broadcast threshold)."""
    return freq.join(vocab.select(F.col(token_col)).distinct(), token_col, "left_anti")


def in_vocab(freq: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    return freq.join(vocab.select(F.col(token_col)).distinct(), token_col, "left_semi")


def coverage(freq: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """A1/A2: total tokens, OOV tokens, distinct OOV, coverage % (null when
    there are no tokens) and the verdict."""
    v = vocab.select(F.col(token_col)).distinct().withColumn("_in", F.lit(True))
    j = freq.join(v, token_col, "left")
    agg = j.agg(F.sum("n").cast("bigint").alias("total_tokens"),
                F.sum(F.when(F.col("_in").isNull(), F.col("n")).otherwise(0)).cast("bigint").alias("oov_tokens"),
                F.count(F.when(F.col("_in").isNull(), F.lit(1))).cast("bigint").alias("distinct_oov"))
    cov = F.when(F.col("total_tokens") > 0,
                 (F.col("total_tokens") - F.col("oov_tokens")) / F.col("total_tokens") * 100.0)
    return agg.withColumn("coverage", F.round(cov, 6)).withColumn("verdict", coverage_verdict(cov))


def coverage_verdict(cov: Column) -> Column:
    """A2: < 98 low, > 99 excellent, else acceptable."""
    return (F.when(cov.isNull(), F.lit(None))
             .when(cov < 98, "low").when(cov > 99, "excellent").otherwise("acceptable"))


def oov_examples(freq: DataFrame, vocab: DataFrame, n: int = 10, token_col: str = "token") -> DataFrame:
    """A3: the n most frequent OOV tokens, then by token."""
    return oov_tokens(freq, vocab, token_col).orderBy(F.desc("n"), F.asc(token_col)).limit(n)


# B10 / J4 -----------------------------------------------------------------
def count_comparison(df: DataFrame, key: str, text_col: str = "text",
                     encoder: BpeEncoder | None = None) -> DataFrame:
    """One count per sample per tokenizer (words, characters, bytes,
    pre-tokens and, with an encoder, BPE ids).  All counters run in one
    projection, so the samples stay aligned without a shuffle."""
    from ..functions.text import word_count
    t = F.col(text_col)
    cols = [word_count(t).alias("n_words"), F.length(t).cast("bigint").alias("n_chars"),
            F.octet_length(t).cast("bigint").alias("n_bytes"),
            F.size(pretokens(t)).cast("bigint").alias("n_pretokens")]
    if encoder is not None:
        cols.append(F.coalesce(F.size(encoder.encode_column(t)), F.lit(0)).cast("bigint").alias("n_bpe"))
    return df.select(key, *cols)


def align_counts(counts: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts of several tokenizers, each (key, n) from its own run,
    aligned by sample with full outer joins on the key; missing -> 0."""
    out = None
    for name, df in counts.items():
        d = df.select(key, F.col("n").cast("bigint").alias(f"n_{name}"))
        out = d if out is None else out.join(d, key, "full_outer")
    return out.fillna(0, [f"n_{n}" for n in counts])
