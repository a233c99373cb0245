"""Plan checks: built-in operators stay JVM-side, scans are pruned, the
global index never funnels rows through one partition."""

from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import index as ix
from wordloom.operators import pretokenize as pt
from wordloom.plans.common import tok_docs

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_is_builtin_only(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    p = _plan(d.select(tx.medical_clean(F.col("text")), tx.general_clean(F.col("text")),
                       tx.scientific_clean(F.col("text"))))
    assert "EvalPython" not in p and "PythonUDF" not in p


def test_word_counts_pruned_and_combined(spark):
    p = _plan(pt.word_counts(tok_docs(spark, SF)))
    assert "ReadSchema: struct<text:string>" in p
    assert p.count("HashAggregate") >= 2          # partial before the shuffle
    assert "EvalPython" not in p


def test_global_index_has_no_single_partition_exchange(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    g = ix.global_index(d, ["k"], "g")
    p = _plan(g)
    assert "SinglePartition" not in p
    assert "SortMergeJoin" not in p                # the index is not joined back on the keys


def test_row_scalars_are_not_inside_element_lambdas(spark):
    from wordloom.operators import ranking as rk
    d = spark.createDataFrame([(1, [0.1, 0.2])], "k INT, x ARRAY<DOUBLE>")
    for df in (rk.add_softmax(d, "x"), rk.add_top_k(d, "x", 1), rk.add_top_p(d, "x", 0.5),
               rk.add_categorical_draw(d, "x", "k", 3), rk.add_log_sum_exp(d, "x")):
        p = df._jdf.queryExecution().optimizedPlan().toString()
        assert p.count("array_max(") <= 1 and p.count("sort_array(") <= 1 and "array_contains(" not in p


def test_filter_pushdown_to_scan(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("source") == "src1").select("text")
    p = _plan(d)
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in p
