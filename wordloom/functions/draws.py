"""Repeatable uniform draws keyed by (seed, stream, row, position).

``u = int(md5(concat_ws(':', seed, stream, row, pos))[:8], 16) / 2^32``

The value depends only on the key, never on partitioning, task order or
retries, so random operators are exact, survive executor loss, and can be
reproduced in SQL: DuckDB computes the same number with
``('0x' || substr(md5(...), 1, 8))::BIGINT / 4294967296``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def uniform_sql(seed: int, stream: str, *keys: str) -> str:
    """The DuckDB expression of :func:`uniform` for oracle queries."""
    parts = ", ".join([f"'{seed}'", f"'{stream}'"] + [f"cast({k} as varchar)" for k in keys])
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT / 4294967296.0)"
