"""Byte-level BPE training as an iterative DataFrame job.

Training works on the distinct pre-tokens with their counts, which are built by
one shuffle (B2, map-side combined) and from then on scale with the vocabulary
of the corpus, not with the corpus.  A handful of rounds decides thousands of
merges each (``bpe_rounds``): the pair counts are a bucketed table that is
changed by deltas, a round touches only the words that hold a merged pair, and
what reaches the driver is bounded by parameters.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import SPECIAL_TOKENS
from ..session import remove_dir, shared_dir
from . import bpe_rounds as rounds
from .pretokenize import symbols_of

log = logging.getLogger(__name__)

ALL_BYTES = [f"{b:02X}" for b in range(256)]
# Vocabularies above this size are not shipped to tasks as a lookup table.
MAX_SHIPPED_VOCAB = 2_000_000
# Active pairs of the first round; symbols of different runs that a round aims at, and how many
# times that many it may bring to the driver; pairs that it may bring there.
FIRST_ACTIVE, RUN_SYMBOLS, RUN_MOST, FIRST_PAIRS = 128, 250_000, 4, 1_000_000
# Buckets of the pair table.  A block sends a row to each, and a bucket holds that part of the different pairs.
PAIR_BUCKETS = 32


@dataclass
class BpeModel:
    """Trained vocabulary: specials, byte alphabet, merges (hex symbols)."""
    special_tokens: list[str]
    alphabet: list[str]
    merges: list[tuple[str, str]]
    merge_counts: list[int] = field(default_factory=list)
    rounds: int = 0

    def tokens(self) -> list[str]:
        """Hex token per id after the specials (alphabet, then new merges)."""
        seen, out = set(), []
        for t in self.alphabet + [a + b for a, b in self.merges]:
            if t not in seen:
                seen.add(t)
                out.append(t)
        return out

    @property
    def vocab_size(self) -> int:
        return len(self.special_tokens) + len(self.tokens())

    def token_ids(self) -> dict[str, int]:
        base = len(self.special_tokens)
        return {t: base + i for i, t in enumerate(self.tokens())}

    def ranks(self) -> dict[tuple[str, str], int]:
        r: dict[tuple[str, str], int] = {}
        for i, m in enumerate(self.merges):
            r.setdefault(m, i)
        return r

    def vocab_frame(self, spark) -> DataFrame:
        """(id INT, token_hex STRING, token STRING, kind STRING)."""
        rows = [(i, None, s, "special") for i, s in enumerate(self.special_tokens)]
        n_alpha = len(self.alphabet)
        for t, i in self.token_ids().items():
            kind = "byte" if i - len(self.special_tokens) < n_alpha else "merge"
            rows.append((i, t, bytes.fromhex(t).decode("utf-8", "replace"), kind))
        return spark.createDataFrame(rows, "id INT, token_hex STRING, token STRING, kind STRING")

    def merges_frame(self, spark) -> DataFrame:
        rows = [(i, a, b, self.merge_counts[i] if i < len(self.merge_counts) else None)
                for i, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank INT, left STRING, right STRING, count BIGINT")


# B3 -------------------------------------------------------------------------
# One zero-width match at each symbol start, capturing that symbol and the
# next one: every adjacent pair, overlapping, with a codegen'd built-in.
_PAIR_PATTERN = r"(?<![0-9A-F])(?=([0-9A-F]+ [0-9A-F]+))"


def pair_array(w: Column) -> Column:
    """Adjacent symbol pairs of a space-joined word as 'L R' strings."""
    return F.regexp_extract_all(w, F.lit(_PAIR_PATTERN), 1)


def pair_counts(words: DataFrame, min_frequency: int = 0) -> DataFrame:
    """(pair STRING 'L R', count BIGINT) weighted by word counts."""
    p = words.select(F.explode(pair_array(F.col("w"))).alias("pair"), "n")
    c = p.groupBy("pair").agg(F.sum("n").alias("count"))
    return c.where(F.col("count") >= F.lit(min_frequency)) if min_frequency > 0 else c


def words_table(word_counts: DataFrame, token_col: str = "token", n_col: str = "n") -> DataFrame:
    """(w STRING of space-joined hex byte symbols, n BIGINT) per pre-token."""
    return word_counts.select(symbols_of(F.col(token_col)).alias("w"),
                              F.col(n_col).cast("bigint").alias("n"))


# B4 -------------------------------------------------------------------------
def train_bpe(word_counts: DataFrame, vocab_size: int = 32000, min_frequency: int = 2,
              alphabet: str = "full", special_tokens: list[str] | None = None,
              first_active: int = FIRST_ACTIVE, run_symbols: int = RUN_SYMBOLS,
              first_pairs: int = FIRST_PAIRS) -> BpeModel:
    """Train a byte-level BPE vocabulary from (token, n) word-type counts: the
    merges of one-at-a-time training, pairs in the order of count (falling),
    left and right token, until the vocabulary has ``vocab_size`` entries or
    no pair reaches ``min_frequency``.

    ``alphabet='full'`` puts all 256 bytes in the vocabulary; ``'observed'``
    only the bytes seen (an unseen byte is then dropped at encode time).

    Each round (see ``bpe_rounds``) makes as many pairs active as should give
    about ``run_symbols`` symbols of different runs, beginning with
    ``first_active``; more than RUN_MOST times that are never brought to the
    driver: the number of active pairs is halved instead, down to one.
    ``first_pairs`` bounds the pairs that are brought to it.  All tables of a
    round are written to the shared folder and removed when the next round's
    are there.  Null tokens are skipped; no words give no merges.
    """
    spark = word_counts.sparkSession
    specials = list(SPECIAL_TOKENS if special_tokens is None else special_tokens)
    if alphabet not in ("full", "observed"):
        raise ValueError("alphabet must be 'full' or 'observed'")
    base = shared_dir(spark, "bpe")
    buckets = PAIR_BUCKETS
    most = max(2, -(-first_pairs // buckets))

    def table(name: str, df: DataFrame) -> DataFrame:
        df.write.partitionBy("kind").option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.schema(rounds.BLOCK_SCHEMA).parquet(f"{base}/{name}")

    counts = word_counts.select("token", F.col("n").cast("long").alias("n"))
    if alphabet == "observed":
        counts.write.option("compression", "zstd").parquet(f"{base}/counts")
        counts = spark.read.schema(counts.schema).parquet(f"{base}/counts")
        seen = words_table(counts).select(F.explode(F.split("w", " ")).alias("b")).distinct().collect()  # at most 256 rows
        alpha = sorted(r["b"] for r in seen if r["b"])
    else:
        alpha = list(ALL_BYTES)
    model = BpeModel(specials, alpha, [], [])
    tokens = [bytes([b]) for b in range(256)]
    ids = {t: i for i, t in enumerate(tokens)}
    budget = vocab_size - len(specials) - len(alpha)
    try:
        blocks = table("blocks-0", rounds.first_blocks(counts, buckets))
        pairs = spark.createDataFrame([], rounds.BLOCK_SCHEMA)
        wanted = first_active
        while budget > 0:
            k = model.rounds
            order = np.empty(len(tokens), np.int64)
            order[sorted(range(len(tokens)), key=tokens.__getitem__)] = np.arange(len(tokens))
            sent = spark.sparkContext.broadcast(order)
            pairs = table(f"pairs-{k}", rounds.next_pairs(
                pairs, blocks.where(F.col("kind") == rounds.PAIRS), sent, min_frequency, most)).where(F.col("kind") == rounds.TABLE)
            if k:
                remove_dir(spark, f"{base}/pairs-{k - 1}")
            tops = spark.read.schema(rounds.BLOCK_SCHEMA).parquet(f"{base}/pairs-{k}").where(F.col("kind") == rounds.FIRST)
            codes, numbers, whole = rounds.first_pairs(
                [(bytes(r["a"]), bytes(r["b"]), bytes(r["c"])) for r in tops.select("a", "b", "c").collect()], order)
            sent.unpersist()
            if not len(codes):
                break
            words = blocks.where(F.col("kind") == rounds.WORDS)
            runs, active, least, size = _bounded_runs(spark, words, codes, numbers, whole, wanted,
                                                      RUN_MOST * run_symbols, f"{base}/runs-{k}")
            merges, changed = rounds.merge_runs(runs, tokens, ids, budget, least)
            wanted = max(1, int(len(active.value) * min(8.0, max(0.25, run_symbols / max(size, 1)))))
            for left, right, n in merges:
                model.merges.append((tokens[left].hex().upper(), tokens[right].hex().upper()))
                model.merge_counts.append(n)
            budget = vocab_size - len(specials) - len(alpha) - (len(tokens) - 256)
            model.rounds += 1
            log.info("BPE round %d: %d active pairs, %d symbols of runs, %d merges", k, len(active.value), size, len(merges))
            if budget > 0:
                new = spark.sparkContext.broadcast(changed)
                blocks = table(f"blocks-{k + 1}", rounds.next_blocks(words, active, new, buckets))
                new.unpersist()
            active.unpersist()
            remove_dir(spark, f"{base}/blocks-{k}")
    finally:
        remove_dir(spark, base)
    return model


def _bounded_runs(spark, words: DataFrame, codes, numbers, whole: bool, wanted: int, most: int, path: str):
    """The different runs of the first pairs, about ``wanted`` of them or fewer,
    so that the runs hold ``most`` symbols at most (or one pair is active):
    ([(run, n)], active pairs (broadcast), least count to merge, symbols)."""
    cut, tried = False, None
    while True:
        n, least = rounds.choose_active(numbers, whole, wanted, cut)
        if n == tried and not cut and n > 1:   # so many pairs share one count
            cut, wanted = True, max(1, n // 2)
            continue
        active = spark.sparkContext.broadcast(np.sort(codes[:n]))
        rounds.run_counts(words, active).write.mode("overwrite").parquet(path)
        runs = spark.read.schema("run binary, n long").parquet(path)
        size = (runs.agg(F.sum(F.octet_length("run"))).first()[0] or 0) // 4
        if size <= most or n == 1:
            held = [(bytes(r["run"]), int(r["n"])) for r in runs.collect()]
            remove_dir(spark, path)
            return held, active, least, size
        active.unpersist()
        tried, wanted = n, max(1, n // 2)
