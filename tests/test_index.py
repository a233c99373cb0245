from pyspark.sql import functions as F

from wordloom.operators import index as ix


def test_global_index_contiguous_and_partition_free(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    a = {r.k: r.g for r in ix.global_index(df.repartition(1), ["k"], "g").collect()}
    b = {r.k: r.g for r in ix.global_index(df.repartition(8), ["k"], "g", num_partitions=5).collect()}
    assert a == b
    assert sorted(a.values()) == list(range(1000))
    assert all(a[k] == k for k in a)


def test_null_and_repeated_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (1, "a")], "k INT, v STRING")
    rows = ix.global_index(df, ["k"], "g").collect()
    assert sorted(r.g for r in rows) == [0, 1, 2, 3, 4]
    assert sorted((r.k or 0, r.v) for r in rows) == [(0, "c"), (1, "a"), (1, "a"), (1, "b"), (2, "d")]


def test_running_totals_keep_null_groups(spark):
    from wordloom.operators import ranking as rk
    df = spark.createDataFrame([("g", 1, 5, "x"), (None, 1, 7, "y"), (None, 2, None, "z"), ("g", 2, 1, "w"), ("g", 2, 1, "v")],
                               "g STRING, o INT, n INT, extra STRING")
    rows = rk.running_totals(df, "g", "o", "n").collect()
    assert len(rows) == 5
    got = sorted((r.g or "", r.items_so_far, r.tokens_so_far) for r in rows)
    assert got == [("", 1, 7), ("", 2, 7), ("g", 1, 5), ("g", 2, 6), ("g", 3, 7)]


def test_chunks_cover_everything(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    b = ix.fixed_batches(df, ["i"], 100)
    sizes = {r.batch_id: r.n for r in b.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 10 and all(n == 100 for n in sizes.values())


def test_split_chunk_more_parts_than_k(spark):
    df = spark.range(10).withColumn("c", F.lit(0)).withColumnRenamed("id", "pos")
    parts = sorted(r.part for r in ix.split_chunks(df, "c", "pos", 3).collect())
    assert parts == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]      # 10 div 3 = 3 per part -> 4 parts


def test_shuffle_and_exact_split(spark):
    df = spark.range(101).withColumnRenamed("id", "doc_id")
    s1 = {r.doc_id: r.position for r in ix.seeded_shuffle(df, "doc_id", 5).collect()}
    s2 = {r.doc_id: r.position for r in ix.seeded_shuffle(df.repartition(6), "doc_id", 5).collect()}
    assert s1 == s2 and sorted(s1.values()) == list(range(101))
    assert s1 != {i: i for i in range(101)}
    sp = ix.exact_split(df, "doc_id", 5, 0.9).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in sp} == {"train": 90, "validation": 11}


def test_collate(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.array_repeat(F.lit(1), (F.col("id") % 5 + 1).cast("int")).alias("ids"))
    df = df.withColumn("mask", F.col("ids"))
    c = ix.collate(df, "k", 3, batch_size=16, multiple_of=8)
    rows = c.collect()
    assert {r.batch_id for r in rows} == {0, 1, 2}
    assert all(len(r.ids) == 8 for r in rows)
