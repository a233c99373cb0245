import pytest
from pyspark.sql import functions as F

from wordloom.operators import sets
from wordloom.sources import records


def test_required_keys(spark):
    present = spark.createDataFrame([("pad",), ("unk",)], "k STRING")
    miss = [r.k for r in sets.missing_keys(spark, ["pad", "unk", "mask"], present, "k").collect()]
    assert miss == ["mask"]
    with pytest.raises(ValueError, match="mask"):
        sets.check_required(spark, ["pad", "mask"], present, "k")
    df = spark.createDataFrame([(["pad"],)], "names ARRAY<STRING>")
    assert df.select(sets.missing_keys_column(["pad", "mask"], F.col("names"))).collect()[0][0] == ["mask"]


def test_combine_batches(spark):
    a = spark.createDataFrame([(1, [1, 2])], "id INT, ids ARRAY<INT>")
    b = spark.createDataFrame([(2, [3, 4])], "id INT, ids ARRAY<INT>")
    both = sets.combine_batches({"a": a, "b": b}, ["ids"])
    assert sorted((r.id, r.batch) for r in both.collect()) == [(1, "a"), (2, "b")]
    c = spark.createDataFrame([(3, [5])], "id INT, ids ARRAY<INT>")
    with pytest.raises(ValueError, match="'ids'.*'c'"):
        sets.combine_batches({"a": a, "c": c}, ["ids"])
    d = spark.createDataFrame([(3,)], "id INT")
    with pytest.raises(ValueError, match="'d'"):
        sets.combine_batches({"a": a, "d": d}, ["ids"])


def test_map_records(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id INT, t STRING")
    out = sets.map_records(df, lambda c: {"id": c["id"], "n": [len(x) if x else 0 for x in c["t"]]},
                           "id INT, n INT")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2), (2, 0)]


def test_qa_sets_skip_failures(spark, tmp_dir):
    spark.createDataFrame([("q", "c")], "question STRING, context STRING").write.parquet(f"{tmp_dir}/a")
    spark.createDataFrame([("q2",)], "question STRING").write.parquet(f"{tmp_dir}/b")
    u = records.load_qa_sets(spark, {"a": f"{tmp_dir}/a", "b": f"{tmp_dir}/b", "bad": f"{tmp_dir}/none"}, on_missing="skip")
    rows = sorted((r.dataset, r.question, r.context) for r in u.collect())
    assert rows == [("a", "q", "c"), ("b", "q2", None)]
