import math

from pyspark.sql import functions as F

from wordloom.operators import metrics as mt
from wordloom.operators import ranking as rk


def _logits(spark):
    return spark.createDataFrame([(0, [1.0, 3.0, 3.0, 0.5], 1), (1, [0.0, 0.0, 0.0, 10.0], 0)],
                                 "r INT, x ARRAY<FLOAT>, label INT")


def test_softmax_and_topk(spark):
    d = rk.add_softmax(_logits(spark), "x", "p", 1.0)
    for r in d.collect():
        assert abs(sum(r.p) - 1) < 1e-9
    k = rk.add_top_k(_logits(spark), "x", 2).select("r", rk.kept_ids(F.col("filtered")).alias("k"))
    assert {r.r: r.k for r in k.collect()} == {0: [1, 2], 1: [0, 1, 2, 3]}  # ties kept
    big = rk.add_top_k(_logits(spark), "x", 10).select(rk.kept_ids(F.col("filtered")).alias("k"))
    assert all(len(r.k) == 4 for r in big.collect())


def test_top_p_first_always_kept(spark):
    d = rk.add_top_p(_logits(spark), "x", 0.0).select("r", rk.kept_ids(F.col("filtered")).alias("k"))
    assert {r.r: r.k for r in d.collect()} == {0: [1], 1: [3]}
    long = rk.top_p_long(rk.explode_logits(_logits(spark), "r", "x"), "r", 0.0)
    assert sorted((r.r, r.token_id) for r in long.collect()) == [(0, 1), (1, 3)]


def test_draw_repeatable(spark):
    a = rk.add_categorical_draw(_logits(spark), "x", "r", 9).collect()
    b = rk.add_categorical_draw(_logits(spark).repartition(3), "x", "r", 9).collect()
    assert sorted((r.r, r.token) for r in a) == sorted((r.r, r.token) for r in b)


def test_cross_entropy_masks_pad(spark):
    r = rk.masked_cross_entropy(_logits(spark), "x", "label", pad=0).collect()[0]
    x = [1.0, 3.0, 3.0, 0.5]
    exp = math.log(sum(math.exp(v) for v in x)) - x[1]
    assert abs(r.loss_mean - exp) < 1e-6


def test_series_fold(spark):
    rows = [(1, s, v) for s, v in enumerate([5.0, 4.0, 4.0, 4.5, 6.0, 7.0, 3.0])] + [(2, 0, 1.0)]
    df = spark.createDataFrame(rows, "k INT, s INT, v DOUBLE")
    out = {r.k: r for r in mt.series_fold(df, "k", "s", "v", patience=3).collect()}
    assert out[1].best_step == 6 and out[1].best_value == 3.0
    # an equal value resets the counter; 4.5, 6.0, 7.0 make it 3 at step 5
    assert out[1].stop_step == 5
    assert out[2].stop_step is None


def test_running_totals_and_latest(spark):
    df = spark.createDataFrame([("a", i, 2) for i in range(50)] + [("b", 0, 5)], "g STRING, o INT, v INT")
    r = {(x.g, x.o): (x.items_so_far, x.tokens_so_far) for x in rk.running_totals(df, "g", "o", "v", 7).collect()}
    assert r[("a", 49)] == (50, 100) and r[("a", 0)] == (1, 2) and r[("b", 0)] == (1, 5)
    lat = rk.latest_per_group(df, ["g"], "o", "v").collect()
    assert {x.g: x.o for x in lat} == {"a": 49, "b": 0}


def test_dataset_metrics_and_error_examples(spark):
    rows = [("a", True, 5, None), ("a", False, 9, "bad utf-8"), ("a", False, 1, "bad utf-8"),
            ("b", True, 2, None), ("b", False, 0, "empty")]
    df = spark.createDataFrame(rows, "ds STRING, ok BOOLEAN, tokens INT, err STRING")
    m = {r.ds: r for r in mt.dataset_metrics(df, "ds", "ok", "tokens").collect()}
    assert (m["a"].items, m["a"].processed_items, m["a"].failed_items, m["a"].total_tokens) == (3, 1, 2, 5)
    assert m["b"].mean_tokens == 2.0
    e = {(r.ds, r.err): r.n for r in mt.error_examples(df, "ds", "err", 1).collect()}
    assert e == {("a", "bad utf-8"): 2, ("b", "empty"): 1}


def test_running_totals_keeps_other_columns(spark):
    df = spark.createDataFrame([("a", i, 1, f"x{i}") for i in range(20)], "g STRING, o INT, v INT, extra STRING")
    r = {x.o: (x.items_so_far, x.extra) for x in rk.running_totals(df, "g", "o", "v", 3).collect()}
    assert r[19] == (20, "x19") and r[0] == (1, "x0")


def _fold_one(rows, patience, delta):
    """Value by value, as the training loop does."""
    best = stop = low = low_s = None
    count = 0
    for s, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        if v is None:
            continue
        if low is None or v < low:
            low, low_s = v, s
        if best is None or v <= best - delta:
            best, count = v, 0
        else:
            count += 1
            if count >= patience and stop is None:
                stop = s
    return len(rows), low_s, low, stop


def test_series_fold_over_many_stretches(spark):
    import random
    from wordloom.operators import metrics as mt
    rng = random.Random(6)
    rows = [(k, s, rng.choice([None, 1.0, 2.0, 2.5, rng.random() * 3])) for k in ("a", "b", None) for s in range(200)]
    rows += [("down", s, 1000.0 - s) for s in range(300)] + [("one", 5, 1.0), ("none", 1, None), ("tie", 1, 3.0), ("tie", 1, 2.0)]
    df = spark.createDataFrame(rows, "k STRING, s INT, v DOUBLE")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (3, 17, 10_000):          # rows of a stretch
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for patience, delta in ((1, 0.0), (3, 0.0), (3, 0.4), (7, 1.5), (400, 0.0)):
                got = {r.k: (r.n_steps, r.best_step, r.best_value, r.stop_step)
                       for r in mt.series_fold(df, "k", "s", "v", patience, delta).collect()}
                assert got == {k: _fold_one([r[1:] for r in rows if r[0] == k], patience, delta) for k in {r[0] for r in rows}}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert mt.series_fold(df.where("false"), "k", "s", "v").count() == 0


def test_series_fold_gathers_summaries_only(spark):
    """A series of a million steps lies over many tasks, and a fold sees a few rows."""
    from wordloom.operators import metrics as mt
    df = spark.range(1_000_000).selectExpr("1 as k", "id as s", "cast(hash(id) as double) as v")
    got = mt.series_fold(df, "k", "s", "v", patience=10**5)
    want = df.selectExpr("min(struct(v, s)) as m").first().m
    r = got.first()
    assert (r.n_steps, r.best_step, r.best_value) == (1_000_000, want.s, want.v) and r.stop_step is not None
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()


def test_messages_of_items(spark):
    from wordloom.operators import metrics as mt
    df = spark.createDataFrame([("a", None, 3), ("a", " ", 1), ("a", "xy", 5), ("a", "xy", 5), ("b", "�", None), (None, "z" * 9, 9)],
                               "ds STRING, text STRING, n INT")
    d = df.select("ds", mt.item_messages(F.col("text"), F.col("n"), longest=8).alias("m"))
    got = sorted((str(r.ds), r["rank"], r.kind, r.message, r.n) for r in mt.message_report(d, "ds", "m", 2).collect())
    assert got == [("None", 1, "warning", "longer than 8 characters", 1), ("a", 1, "warning", "recorded length differs by -3", 2),
                   ("a", 2, "error", "blank text", 1), ("b", 1, "warning", "replacement characters", 1)]


def test_token_difference_combines_before_it_takes_away(spark, tmp_dir):
    from wordloom.plans import ranking_queries
    spark.createDataFrame([(0, "the cat"), (1, "a hat"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    spark.createDataFrame([(0, "cat cat the cat", "s"), (1, None, "s"), (2, "dog", None)],
                          "doc_id long, text string, source string").write.parquet(f"{tmp_dir}/documents.parquet")
    df = ranking_queries.token_difference(spark, tmp_dir)
    assert sorted(r.token for r in df.collect()) == [" a", " hat"]
    taken = df._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti", 1)[1]
    assert taken.index("LeftSemi") < taken.rindex("Aggregate")
