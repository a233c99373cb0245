"""Readers for the driver tables and the derived ``notes`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Tables whose rows carry costly row-local work (regexes, Python UDFs).
_WIDE_WORK = {"documents", "pages", "conversations", "orders", "embeddings", "lineitem", "events"}


def table(spark: SparkSession, sf_dir: str, name: str, spread_work: bool = True) -> DataFrame:
    """Read one driver table.  A file with a single row group is a single
    input split; for the tables with heavy row-local work it is spread over
    the cores (a no-op when the scan already has enough splits)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_work and name in _WIDE_WORK else df


def _lp(c, width: int):
    return F.lpad(c.cast("string"), width, "0")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical-style notes built from ``orders`` join ``customer``.

    ``documents`` never triggers the abbreviation, identifier and unit rules;
    these rows do, with the same expression in Spark and in the SQL oracle.
    Keeps ``dataset`` (the market segment) for per-dataset pipeline choice.
    """
    return notes_from(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def notes_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """``notes`` from given orders and customer frames (either may stream)."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    c = customer.select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    text = F.concat(
        F.lit("pt "), F.col("c_name"), F.lit(" hx order "), F.col("o_orderkey").cast("string"),
        F.lit(", dx "), F.lower("o_orderpriority"),
        F.lit(" on "), F.date_format("o_orderdate", "MM/dd/yyyy"),
        F.lit(". SSN "), _lp(F.col("c_custkey") % 1000, 3), F.lit("-"),
        _lp(F.col("o_orderkey") % 100, 2), F.lit("-"), _lp(F.col("o_orderkey") % 10000, 4),
        F.lit(" record "), F.upper(F.substring("c_mktsegment", 1, 2)),
        _lp(F.col("c_custkey") % 1000000, 6),
        F.lit("; CT then MRI, xray; glucose "), (F.col("o_orderkey") % 300).cast("string"),
        F.lit(" mg/dl, 10 ug/ml, 2 ^ "), (F.col("c_custkey") % 9).cast("string"),
    )
    return j.select(F.col("o_orderkey").alias("note_id"), text.alias("text"),
                    F.col("c_mktsegment").alias("dataset"))


# DuckDB form of ``notes`` for the oracle queries.
NOTES_SQL = """
(select o_orderkey as note_id,
  concat('pt ', c_name, ' hx order ', cast(o_orderkey as varchar), ', dx ', lower(o_orderpriority),
    ' on ', strftime(o_orderdate, '%m/%d/%Y'), '. SSN ', lpad(cast(c_custkey % 1000 as varchar),3,'0'), '-',
    lpad(cast(o_orderkey % 100 as varchar),2,'0'), '-', lpad(cast(o_orderkey % 10000 as varchar),4,'0'),
    ' record ', upper(substring(c_mktsegment,1,2)), lpad(cast(c_custkey % 1000000 as varchar),6,'0'),
    '; CT then MRI, xray; glucose ', cast(o_orderkey % 300 as varchar),
    ' mg/dl, 10 ug/ml, 2 ^ ', cast(c_custkey % 9 as varchar)) as text,
  c_mktsegment as dataset
 from orders join customer on o_custkey = c_custkey)
"""
