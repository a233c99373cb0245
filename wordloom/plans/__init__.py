"""Contract queries: each registered name has a Spark plan and (mostly) a
DuckDB twin used as the correctness oracle."""

from .common import ORACLES, QUERIES


def load_all():
    from . import (bpe_queries, bpe_value_queries, extra_queries, file_queries,  # noqa: F401
                   image_queries, io_queries, ranking_queries, sequence_queries, stream_queries,
                   text_queries)
    return QUERIES, ORACLES
