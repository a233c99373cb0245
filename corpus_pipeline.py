"""The corpus pipeline: documents through five operators of ``wordloom.llm``,
each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.alignment import without_leaks
from wordloom.llm.common import drop_written, fresh, read, scratch_tables, written
from wordloom.llm.jaccard import jaccard_components
from wordloom.llm.mixing import pareto_mix, random_unit, water_filled, word_count
from wordloom.llm.sharding import shuffle_into_shards
from wordloom.llm.toxicity import fit, score_documents

#: Near duplicates share five-word shingles at a Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar's model does not call toxic."""
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id; rows
    without an id or without words are groups of their own."""
    nth = fresh(docs, "_nth")
    heads = (jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT).where("doc_id = component_id and n_shingles > 0")
             .groupBy("doc_id").agg(F.count("*").alias(nth)))
    words = word_count() > 0
    alone = docs.where(F.col("doc_id").isNull() | ~words)
    # of rows that share an id one stays
    kept = docs.where(F.col("doc_id").isNotNull() & words).join(heads.hint("shuffle_hash"), "doc_id")
    once = kept.where(F.col(nth) == 1).select(*docs.columns)
    more = (kept.where(F.col(nth) > 1).groupBy("doc_id")
            .agg(F.min_by(F.struct(*docs.columns), F.sha2("text", 256)).alias(nth)).select(f"{nth}.*"))
    return once.unionByName(alone).unionByName(more)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item aligns with."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    # the documents travel in one column, so that their names meet no other
    held = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"),
                               word_count().alias("size")), "mix")
    keys = held.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "size")
    sources = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    mixed = pareto_mix(keys, written(water_filled(sources), "targets"), "size", "source", random_unit("doc_id", "source", "size"))
    taken = mixed.where("copies > 0").select("row", "copies")
    return (held.select("doc", "row").join(taken.hint("shuffle_hash"), "row")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc.*"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return shuffle_into_shards(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("sharding", shard)]

# A learned grammar, a local alignment and a random permutation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, held = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_tables() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        # nothing reads the stage's own tables or its input any more
        for table in [x for x in made if x is not docs] + ([held] if held is not None else []):
            drop_written(table)
        held = docs
    return docs
