from wordloom.session import ensure_checkpoint_dir, spread


def test_checkpoint_dir_is_read_not_replaced(spark):
    first = ensure_checkpoint_dir(spark)
    assert first == ensure_checkpoint_dir(spark)
    assert "wl-test-ckpt-" in first          # the folder the test session configured


def test_spread_only_when_needed(spark, tmp_dir):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(10).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == cores
    many = spark.range(100).repartition(cores * 2)
    assert spread(many).rdd.getNumPartitions() == cores * 2
    spark.range(3).write.parquet(f"{tmp_dir}/p")
    stream = spark.readStream.schema("id BIGINT").parquet(f"{tmp_dir}/p")
    assert spread(stream) is stream
