"""Shared pieces of the contract queries: registry and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a contract query; ``sql`` is its DuckDB twin (None = rows only)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --- DuckDB fragments ------------------------------------------------------
def clean_sql(x: str) -> str:
    """General clean (P9) in DuckDB: RE2 has ASCII \\w, so a Unicode class."""
    return (f"trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), "
            f"'[^\\p{{L}}\\p{{N}}_\\s.,!?-]', '', 'g'))")


# No look-ahead in RE2: on whitespace-collapsed text it never changes a split.
PRETOKEN_SQL_PATTERN = ("''s|''t|''re|''ve|''m|''ll|''d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+")


def prefix_space_sql(x: str) -> str:
    return f"(case when starts_with({x}, ' ') then {x} else ' ' || {x} end)"


def pretokens_sql(x: str) -> str:
    return f"regexp_extract_all({prefix_space_sql(x)}, '{PRETOKEN_SQL_PATTERN}')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def word_count_sql(x: str) -> str:
    s = strip_sql(x)
    return (f"(case when {x} is null or {s} = '' then 0 "
            f"else len(string_split_regex({s}, '\\s+')) end)::BIGINT")


def list_text_sql(x: str) -> str:
    return f"('[' || array_to_string({x}, ',') || ']')"


def hashed_ids_sql(words: str, vocab_size: int = 32000, offset: int = 7) -> str:
    span = vocab_size - offset
    return (f"list_transform({words}, lambda w: "
            f"({offset} + (('0x' || substr(md5(w), 1, 8))::BIGINT % {span}))::INTEGER)")


def tok_text_sql(x: str) -> str:
    """General clean plus one more whitespace collapse (see ``tok_docs``)."""
    return f"regexp_replace({clean_sql(x)}, '\\s+', ' ', 'g')"


def words_sql(x: str) -> str:
    t = tok_text_sql(x)
    return f"(case when {t} = '' then []::VARCHAR[] else string_split({t}, ' ') end)"


def tok_text(c):
    """General clean (P9) plus one more whitespace collapse, in two regex
    passes: removing the characters first and collapsing after gives the same
    text as collapse -> remove -> strip -> collapse, and after the collapse
    the only whitespace left is ' ', so a plain trim is the strip."""
    c = F.regexp_replace(c, r"(?U)[^\w\s.,!?-]", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tok_docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents -> ``tok_text``.  On such text (single spaces, no ends) the
    pre-token pattern needs no look-ahead, so the SQL twin (RE2) splits
    identically."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source", tok_text(F.col("text")).alias("text"))
