"""Byte-level pre-tokenisation (B1), word-type counts (B2), size probe.

Pre-tokens are extracted JVM-side with ``regexp_extract_all`` and the public
GPT-2 split pattern.  A pre-token's byte symbols are written as upper-case hex
pairs joined by one space ("20 61 62"): merges are then plain string edits and
byte order equals string order, so no 256-entry character table is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the published GPT-2 pre-token pattern -------------------
GPT2_PATTERN = (r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                r"|\s+(?!\S)|\s+")
# ---------------------------------------------------------------------------

#: The same splits with less back-tracking: one alternative for what follows an
#: apostrophe, and runs that are never given back, as nothing after them asks for it.
_SPLIT = (r"(?U)'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++"
          r"|\s+(?!\S)|\s+")


def with_prefix_space(text: Column) -> Column:
    """Prepend one space unless the text already starts with a space."""
    return F.when(text.startswith(" "), text).otherwise(F.concat(F.lit(" "), text))


def pretokens(text: Column, add_prefix_space: bool = True) -> Column:
    """ARRAY<STRING> of pre-tokens (leading spaces kept)."""
    t = with_prefix_space(text) if add_prefix_space else text
    return F.regexp_extract_all(t, F.lit(_SPLIT), 0)


def symbols_of(token: Column) -> Column:
    """Space-joined hex byte symbols of a pre-token: ' ab' -> '20 61 62'."""
    return F.regexp_replace(F.hex(F.encode(token, "UTF-8")), "(..)(?!$)", "$1 ")


def word_counts(df: DataFrame, text_col: str = "text",
                add_prefix_space: bool = True) -> DataFrame:
    """B2: (token STRING, n BIGINT) over all texts.

    ``explode`` + ``groupBy`` runs with a map-side partial aggregate, so a hot
    token (say, a third of all words) is combined before the shuffle.
    """
    toks = df.select(F.explode(pretokens(F.col(text_col), add_prefix_space)).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_probe(df: DataFrame, text_col: str = "text", cap: int | None = None,
                     approximate: bool = False) -> DataFrame:
    """Number of distinct pre-tokens (one row), at most ``cap`` if one is given."""
    toks = df.select(F.explode(pretokens(F.col(text_col))).alias("token"))
    agg = F.approx_count_distinct("token") if approximate else F.count_distinct("token")
    n = agg if cap is None else F.least(agg, F.lit(cap))
    return toks.agg(n.cast("bigint").alias("vocab_estimate"))


def vocabulary_probe_by(df: DataFrame, group_col: str, text_col: str = "text", precision: int = 14) -> DataFrame:
    """B9 per group and in all: (group, is_total, estimate, exact) of distinct
    pre-tokens.  Estimates come from one mergeable sketch per group (HLL of
    2 ** ``precision`` registers, relative error about 1 %), of which the union gives the
    total without another pass; exact counts from the distinct (group,
    pre-token) pairs.  Null texts have none; a null group is a group."""
    toks = df.select(F.col(group_col), F.explode(pretokens(F.col(text_col))).alias("token"))
    sketches = toks.groupBy(group_col).agg(F.hll_sketch_agg("token", F.lit(precision)).alias("s"))
    pairs = toks.groupBy(group_col, "token").agg(F.lit(1).alias("n"))
    exact = pairs.groupBy(group_col).agg(F.count(F.lit(1)).cast("bigint").alias("exact"))
    groups = (sketches.join(exact, sketches[group_col].eqNullSafe(exact[group_col]))
              .select(sketches[group_col], F.lit(False).alias("is_total"), F.hll_sketch_estimate("s").alias("estimate"), "exact"))
    all_exact = pairs.select("token").distinct().agg(F.count(F.lit(1)).cast("bigint").alias("exact"))
    total = (sketches.select("s", F.lit(0).cast("bigint").alias("exact"))
             .unionByName(all_exact.select(F.lit(None).cast("binary").alias("s"), "exact"))
             .agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("s")), F.lit(0)).cast("bigint").alias("estimate"),
                  F.max("exact").alias("exact")))
    return groups.unionByName(total.select(F.lit(None).cast(df.schema[group_col].dataType).alias(group_col),
                                           F.lit(True).alias("is_total"), "estimate", "exact"))
